"""Approximate nearest neighbours by inner product with score-aware quantisation.

Vectors are quantised in pairs of components to 16 codewords each, four bits a code. The
codebooks minimise an anisotropic loss: the part of a residual parallel to its vector, which
shifts large inner products, costs more than the part across it. A search scans the four-bit
codes through a table of each query's products with the codewords, two codes to a byte, and
ranks the best of each block again by exact inner products on the original vectors. The
codebooks are fitted on a bounded sample; every vector is encoded and scanned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, require

#: Vectors the codebooks are fitted on, at most (about).
SAMPLE = 10_000
CODEWORDS = 16
SUBSPACE = 2
#: Inner products from this share of the norms on are to be kept exact.
SCORE_SHARE = 0.3
ROUNDS = 6
#: Rows of a block of codes, queries of a block, rows of each block ranked exactly.
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
RERANK = 160


@dataclass
class Quantiser:
    codebooks: np.ndarray  # subspaces x codewords x components, float64
    dimension: int
    weight: float  # of the parallel error, the error across counting 1

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows as subspaces x rows x components; components are padded with zeros."""
        m, _, d = self.codebooks.shape
        padded = np.zeros((len(x), m * d))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), m, d).transpose(1, 0, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x subspaces): coordinate descent on the anisotropic loss."""
        parts = self.split(x)
        units = self.split(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
        codes = np.zeros((len(x), len(parts)), np.uint8)
        along = np.zeros(len(x))  # parallel error of all subspaces so far
        for s, part in enumerate(parts):
            gap = part[:, None, :] - self.codebooks[s]
            codes[:, s] = (gap**2).sum(2).argmin(1)
            along += (units[s] * (part - self.codebooks[s][codes[:, s]])).sum(1)
        for _ in range(sweeps):
            for s, part in enumerate(parts):
                gap = part[:, None, :] - self.codebooks[s]
                own = np.einsum("nd,nkd->nk", units[s], gap)
                rest = along - own[np.arange(len(x)), codes[:, s]]
                loss = (gap**2).sum(2) + (self.weight - 1) * (rest[:, None] + own) ** 2
                codes[:, s] = loss.argmin(1)
                along = rest + own[np.arange(len(x)), codes[:, s]]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Codewords that minimise the loss for given codes, one subspace after another."""
        parts = self.split(x)
        units = self.split(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
        gaps = [parts[s] - self.codebooks[s][codes[:, s]] for s in range(len(parts))]
        along = sum((u * g).sum(1) for u, g in zip(units, gaps))
        d = parts.shape[2]
        for s, part in enumerate(parts):
            rest = along - (units[s] * gaps[s]).sum(1) + (units[s] * part).sum(1)
            for k in range(self.codebooks.shape[1]):
                own = codes[:, s] == k
                n = int(own.sum())
                if n:
                    u = units[s][own]
                    left = n * np.eye(d) + (self.weight - 1) * u.T @ u
                    right = part[own].sum(0) + (self.weight - 1) * (u * rest[own][:, None]).sum(0)
                    self.codebooks[s][k] = np.linalg.solve(left, right)
            gaps[s] = part - self.codebooks[s][codes[:, s]]
            along = rest - (units[s] * part).sum(1) + (units[s] * gaps[s]).sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of one query: its products with two neighbouring subspaces' codewords, pairs x 256."""
        each = np.einsum("md,mkd->mk", self.split(q[None])[:, 0], self.codebooks)
        return (each[1::2, :, None] + each[0::2, None, :]).reshape(len(each) // 2, -1).astype(np.float32)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte, the second subspace in the high half: pairs x rows."""
    return np.ascontiguousarray((codes[:, 0::2] | codes[:, 1::2] << 4).T)


def fit_quantiser(x: np.ndarray, rounds: int = ROUNDS) -> Quantiser:
    """Anisotropic codebooks for a sample of vectors."""
    n, dimension = x.shape
    m = -(-dimension // SUBSPACE)
    m += m % 2
    share = SCORE_SHARE**2
    quantiser = Quantiser(np.zeros((m, CODEWORDS, SUBSPACE)), dimension, max(1.0, (dimension - 1) * share / (1 - share)))
    rng = np.random.default_rng(11)
    for s, part in enumerate(quantiser.split(x)):
        centres = part[rng.choice(n, CODEWORDS, replace=n < CODEWORDS)].copy()
        for _ in range(8):
            own = ((part[:, None, :] - centres) ** 2).sum(2).argmin(1)
            for k in range(CODEWORDS):
                if (own == k).any():
                    centres[k] = part[own == k].mean(0)
        quantiser.codebooks[s] = centres
    for _ in range(rounds):
        quantiser.refit(x, quantiser.encode(x, 1))
    return quantiser


def _finite(vector: Column) -> Column:
    """Neither null nor zero, and no component null or not finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def top_rows(scores: np.ndarray, count: int) -> np.ndarray:
    """Indices of the ``count`` largest scores; of equal ones at the end, the first."""
    if len(scores) <= count:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - count)[len(scores) - count]
    above = np.flatnonzero(scores > least)
    return np.concatenate((above, np.flatnonzero(scores == least)[: count - len(above)]))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest of all other rows, largest inner product first.

    Scores are exact, in double precision; ties go to the smaller id. All candidates are
    returned if there are fewer than ``k``. Null ids, and vectors that are null, zero, hold
    a null or non-finite component or have another length than most, take no part. Rows
    that repeat a query's id are not its neighbours; repeated rows are one neighbour. Ids are integers; others are an error. Other columns are not read.
    """
    require(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where(_finite(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("query").cast("bigint")).alias("q")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths or not lengths[0]["q"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dimension, total, queries = lengths[0]
    rows = rows.where(F.size("vector") == dimension)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < min(1.0, SAMPLE / total) * (1 << 30)) if total > SAMPLE else rows
    sample = np.array([r[0] for r in chosen.select("vector").collect()], float).reshape(-1, dimension)
    shared = spark.sparkContext.broadcast(fit_quantiser(sample if len(sample) else np.eye(dimension)))
    blocks, query_blocks = math.ceil(total / BLOCK_ROWS), math.ceil(queries / QUERY_ROWS)

    def numbers(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Code blocks' parts: (block, ids, codes, vectors), a row for each block and batch."""
        for batch in batches:
            x, ids, block = numbers(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = np.concatenate([shared.value.encode(x[i : i + 4096]) for i in range(0, len(x), 4096)])
            out = [(int(b), ids[at].tobytes(), codes[at].tobytes(), x[at].tobytes()) for b in np.unique(block) for at in [block == b]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "ids", "codes", "vectors"])

    index = rows.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).mapInArrow(lean(build), "block bigint, ids binary, codes binary, vectors binary")
    index = cut(index.groupBy("block").agg(F.collect_list(F.struct("ids", "codes", "vectors")).alias("parts")), "codes")
    asked = rows.where("query").select(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(query_blocks)).alias("q"), F.struct("vec_id", "vector").alias("v"))
    asked = asked.groupBy("q").agg(F.collect_list("v").alias("queries"))
    # a query block goes to every block of codes: both are tables of blocks, met by key
    asked = asked.select("q", "queries", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = shared.value
        for batch in batches:
            for parts, queries in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in parts])
                codes = np.concatenate([np.frombuffer(p["codes"], np.uint8).reshape(-1, len(quantiser.codebooks)) for p in parts])
                x = np.concatenate([np.frombuffer(p["vectors"]).reshape(-1, dimension) for p in parts])
                order = np.argsort(ids, kind="stable")
                ids, x, packed = ids[order], x[order], pack_codes(codes[order])
                out = []
                for q in queries:
                    vector = np.array(q["vector"])
                    tables = quantiser.tables(vector)
                    scores = tables[0].take(packed[0])
                    for table, code in zip(tables[1:], packed[1:]):
                        scores += table.take(code)
                    at = top_rows(scores, rerank + 1)
                    at = at[ids[at] != q["vec_id"]]
                    exact = (x[at] * vector).sum(1)  # row by row, so that equal vectors have equal scores
                    best = np.lexsort((ids[at], -exact))
                    best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])[:k]]  # repeated rows once
                    out.append((np.full(len(best), q["vec_id"]), ids[at][best], exact[best]))
                a, b, c = (np.concatenate(z) for z in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    met = index.join(asked, "block").select("parts", "queries").repartition(max(1, min(blocks * query_blocks, 10_000)))
    found = met.mapInArrow(lean(scan), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all other vectors for every vector whose id is divisible by 20."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
