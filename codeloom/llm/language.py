"""Language identification by nearest centroids.

A text is the vector of its letters' hashed 1-, 2- and 3-grams, weighted by TF-IDF and of
length one. Each language has several centroids, found by spherical k-means among its
labelled texts. A text gets the language of the centroid with the largest cosine, and is
rejected if it lies farther from that centroid than its members do, by a margin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, require
from .tokenization import slices, text_sizes

#: Vector size; labelled texts of each language used at most (about); centroids of each; k-means rounds.
DIMENSIONS = 4096
SAMPLE_PER_LANGUAGE = 1000
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected below this share of its centroid's low quantile of cosines.
LOW_QUANTILE = 0.01
MARGIN = 0.4
UNKNOWN = "und"
_CHUNK = 1_000_000
_words = re.compile(r"[^\W\d_]+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def ngram_counts(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of the whole text's words: runs of letters, lower-cased, a space between them."""
    folded = f" {' '.join(_words.findall(text.lower()))} "
    counts = np.zeros(dimensions, np.int64)
    shift = np.uint64(64 - dimensions.bit_length() + 1)
    for at in range(0, len(folded), _CHUNK):
        codes = np.frombuffer(folded[at : at + _CHUNK + 2].encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        last = at + _CHUNK >= len(folded)
        starts = len(codes) if last else _CHUNK
        gram = np.zeros(len(codes), np.uint64)
        for n in range(3):
            end = len(codes) - n
            if end <= 0:
                break
            gram = gram[:end] * _FACTORS[2] + (codes[n:] + np.uint64(n + 1)) * _FACTORS[0]
            counts += np.bincount((((gram ^ (gram >> np.uint64(29))) * _FACTORS[1]) >> shift)[: min(starts, end)].astype(np.int64), minlength=dimensions)
    return counts


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Up to ``k`` unit centroids; starts from the mean's nearest row, then the rows farthest from all so far."""
    centres = [rows[int((rows @ unit(rows.mean(0))).argmax())]]
    near = rows @ centres[0]
    while len(centres) < min(k, len(rows)):
        # a low quantile rather than the farthest row of all, which is often junk
        at = int(np.argsort(near, kind="stable")[len(rows) // 50])
        if near[at] > 1 - 1e-9:
            break
        centres.append(rows[at])
        near = np.maximum(near, rows @ centres[-1])
    centroids = np.array(centres)
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(1)
        centroids = np.array([unit(rows[own == i].mean(0)) if (own == i).any() else centroids[i] for i in range(len(centroids))])
    return centroids


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # cosine under which a text is rejected, of each centroid

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts).astype(np.float32) * self.idf)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of counts: the nearest centroid, its cosine, whether it is rejected."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(1)
        score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(np.float64)
        return best, score, score < self.least[best]


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of the documents, fixed by their ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS, dimensions: int = DIMENSIONS) -> LanguageModel:
    """Fit centroids on rows with a language and letters outside the held-out fifth.

    Of a language with more than ``per_language`` such rows, about that many are used,
    chosen by a hash of the id. The sample's sparse counts reach the driver: at most
    ``per_language`` times the number of languages. Without such rows the model is empty.
    """
    require(docs, id_col, text_col, lang_col)
    usable = docs.where(F.col(lang_col).isNotNull() & has_letter(text_col) & ~held_out(id_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sizes = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(lang_col).alias("l")).count().collect()
    if not sizes:
        return LanguageModel([], np.zeros((0, dimensions), np.float32), np.ones(dimensions, np.float32), np.zeros(0))
    rates = F.create_map(*[F.lit(x) for r in sizes for x in (r["l"], min(1.0, per_language / r["count"]))])
    chosen = usable.where(F.pmod(F.xxhash64(F.col("i"), F.lit(7)), F.lit(1 << 30)) < F.element_at(rates, F.col("l")) * (1 << 30))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for text in batch.column(1).to_pylist():
                counts = ngram_counts(text, dimensions)
                nonzero = np.flatnonzero(counts)
                at.append(nonzero.astype("<u4").tobytes())
                n.append(counts[nonzero].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["i", "l", "at", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sorted(chosen.select("i", "t", "l").mapInArrow(lean(sparse), f"i {kind}, l string, at binary, n binary").collect(), key=lambda r: (r["l"], r["i"], bytes(r["at"]), bytes(r["n"])))
    if not rows:
        return LanguageModel([], np.zeros((0, dimensions), np.float32), np.ones(dimensions, np.float32), np.zeros(0))
    tf = np.zeros((len(rows), dimensions), np.float32)
    for k, r in enumerate(rows):
        tf[k, np.frombuffer(r["at"], "<u4")] = np.log1p(np.frombuffer(r["n"], "<u4"))
    idf = np.log((1 + len(rows)) / (1 + (tf > 0).sum(0))).astype(np.float32) + 1
    tf *= idf
    tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-12)
    labels = np.array([r["l"] for r in rows])
    names, found, least = [], [], []
    for language in sorted(set(labels)):
        own = tf[labels == language]
        centres = spherical_kmeans(own, centroids)
        cosines = own @ centres.T
        nearest = cosines.argmax(1)
        for i, centre in enumerate(centres):
            if (nearest == i).any():
                names.append(str(language))
                found.append(centre)
                least.append(MARGIN * float(np.quantile(cosines[nearest == i, i], LOW_QUANTILE)))
    return LanguageModel(names, np.array(found, np.float32), idf, np.array(least))


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add (lang_pred string, score double, rejected boolean) to every row.

    ``score`` is the cosine to the nearest centroid, from 0 to 1. A null text, one without a
    letter, and any text under an empty model is ``und``, score 0, rejected. A rejected
    text otherwise keeps the nearest language. Columns of these names are replaced;
    ``keep`` names the columns to return, all by default, whatever their names. Repeated rows
    are rows of their own; of equally near centroids the first language in order counts; an
    empty table gives an empty table.
    """
    require(docs, text_col)
    added = ("lang_pred", "score", "rejected")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dimensions = len(m.idf)
        for batch in batches:
            for lo, hi in slices([max(x, 8000) for x in text_sizes(batch.column(0))], 4_000_000):
                part = batch.slice(lo, hi - lo)
                texts, letters = part.column(0).to_pylist(), part.column(1).to_pylist()
                at = [k for k, x in enumerate(letters) if x and m.languages]
                langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if at:
                    best, score, far = m.predict(np.stack([ngram_counts(texts[k], dimensions) for k in at]))
                    for k, b, s, f in zip(at, best.tolist(), score.tolist(), far.tolist()):
                        langs[k], scores[k], rejected[k] = m.languages[b], s, f
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(langs), pa.array(scores), pa.array(rejected)], names=[*keep, *added])

    out = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    text, letter = fresh(docs.columns, "text", "letter")
    return docs.select(F.col(text_col).alias(text), has_letter(text_col).alias(letter), *keep).mapInArrow(lean(run), f"{out}lang_pred string, score double, rejected boolean")


def op2_language_identification(spark, sf_dir: str) -> DataFrame:
    """Predicts the language of every document; learns from labelled documents outside the held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify_languages(docs, learn_languages(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
