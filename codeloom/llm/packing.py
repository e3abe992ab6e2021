"""Best-fit packing of token pieces into sequences.

The lengths' histogram states a configuration linear program: choose how often to use
each configuration (a multiset of lengths that fits a sequence) so that every length is
covered and as few sequences as possible are used. Multiplicative weights solve it: the
weights of uncovered lengths are prices, an unbounded-knapsack dynamic programme finds
the dearest configurations at these prices, and their use lowers the prices of what they
cover. The fractional solution is rounded to whole configurations in several ways, and the
pieces left over go to the fullest sequence that holds them (best fit). Only the histogram, of at most ``capacity`` entries, reaches the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lean, rank_in_groups, require
from .tokenization import CACHE_PIECES, encoder, slices, text_sizes, tokenizer_path

CAPACITY = 2048
#: Rounds of multiplicative weights, and how strongly cover lowers a price.
ROUNDS = 300
ETA = 30.0


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache_pieces: int = CACHE_PIECES, at_once: int = 8_000_000) -> DataFrame:
    """Tokenize whole texts, append ``end_id``, and cut documents longer than ``capacity``.

    Returns (doc_id, piece, start, length, token_ids binary of little-endian unsigned
    32-bit ids). Of a long document all pieces have ``capacity`` ids but the first, which
    has the rest. Null and empty texts are the end id alone; null ids stay null; repeated
    rows are documents of their own; other columns of ``docs`` are not read. ``cache_pieces`` words
    seen before and ``at_once`` bytes of text are what a worker holds; they change no result.
    """
    require(docs, id_col, text_col)
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_out = ("doc_id", "piece", "start", "length", "token_ids")
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, cache_pieces).encode
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(text_sizes(texts), at_once):
                rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
                for k, got in enumerate(encode(texts.slice(lo, hi - lo))):
                    got += end
                    n = len(got) // 4
                    at, size, piece = 0, (n - 1) % capacity + 1, 0
                    while at < n:
                        for column, value in zip(rows, (lo + k, piece, at, size, got[4 * at : 4 * (at + size)])):
                            column.append(value)
                        at, size, piece = at + size, capacity, piece + 1
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], names=list(arrow_out))

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(pieces), f"doc_id {kind}, piece int, start bigint, length bigint, token_ids binary")


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every size up to ``capacity``: the dearest multiset of lengths that fits, and the length it takes first (0: none)."""
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for size in range(1, capacity + 1):
        k = fitting[size]
        if k:
            worth = prices[:k] + best[size - lengths[:k]]
            j = int(worth.argmax())
            best[size], first[size] = worth[j], lengths[j]
        if best[size - 1] >= best[size]:
            best[size], first[size] = best[size - 1], 0
    return best, first


def price_configurations(lengths: np.ndarray, wanted: np.ndarray, prices: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """For each wanted length the dearest configuration that holds it."""
    _, first = knapsack(lengths, prices, capacity)
    real = np.maximum.accumulate(np.where(first > 0, np.arange(capacity + 1), 0))  # skips sizes that take nothing
    parts: list[list[int]] = [[int(x)] for x in wanted]
    left = real[capacity - wanted]
    at = np.flatnonzero(left)
    while at.size:
        take = first[left[at]]
        for i, x in zip(at.tolist(), take.tolist()):
            parts[i].append(x)
        left[at] = real[left[at] - take]
        at = at[left[at] > 0]
    return [tuple(sorted(p, reverse=True)) for p in parts]


def fractional_configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, eta: float = ETA) -> dict[tuple[int, ...], float]:
    """Multiplicative weights on the configuration program; a use for each configuration met.

    A length's price starts at its share of a sequence and falls by exp(-eta) for each
    whole cover of its demand that it is ahead of the others. In each round every length
    behind the common target gets the dearest configuration that holds it.
    """
    use: dict[tuple[int, ...], float] = {}
    covered = np.zeros(len(lengths))
    index = {int(x): i for i, x in enumerate(lengths)}
    for t in range(1, rounds + 1):
        ahead = covered / demand
        prices = lengths / capacity * np.exp(-eta * np.clip(ahead - t / rounds, -3, 3))
        behind = np.flatnonzero(ahead < t / rounds)
        if not behind.size:
            continue
        for i, configuration in zip(behind.tolist(), price_configurations(lengths, lengths[behind], prices, capacity)):
            missing = t / rounds * demand[i] - covered[i]
            if missing <= 0:
                continue
            times = missing / configuration.count(int(lengths[i]))
            use[configuration] = use.get(configuration, 0.0) + times
            for x in configuration:
                covered[index[x]] += times
    return use


def best_fit_rest(rest: dict[int, int], bins: list[tuple[int, tuple[int, ...]]], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Put left-over lengths, longest first, into the fullest sequence that holds them, else into new ones."""
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for times, parts in bins:
        open_bins.setdefault(capacity - sum(parts), []).append((times, parts))
    for length in sorted((x for x, n in rest.items() if n), reverse=True):
        n = rest[length]
        gaps = sorted(g for g in open_bins if g >= length)
        while n and gaps:
            gap = gaps[0]
            held = open_bins[gap]
            times, parts = held.pop()
            if not held:
                del open_bins[gap]
                gaps.pop(0)
            taken = min(times, n)
            if taken < times:
                open_bins.setdefault(gap, []).append((times - taken, parts))
            open_bins.setdefault(gap - length, []).append((taken, (*parts, length)))
            if gap - length >= length and gap - length not in gaps:
                gaps = sorted([*gaps, gap - length])
            n -= taken
        each = capacity // length
        if n >= each:
            open_bins.setdefault(capacity - each * length, []).append((n // each, (length,) * each))
        if n % each:
            open_bins.setdefault(capacity - n % each * length, []).append((1, (length,) * (n % each)))
    return [x for held in open_bins.values() for x in held]


def round_configurations(use: dict[tuple[int, ...], float], rest: dict[int, int], capacity: int, limits: Sequence[Callable[[float], int]], order: Callable) -> list[tuple[int, tuple[int, ...]]]:
    """Whole configurations for a fractional solution: one pass for each limit, as often as it and the demand allow; then best fit."""
    rest, times = dict(rest), Counter()
    ordered = sorted(use.items(), key=order)
    counts = {c: Counter(c) for c, _ in ordered}
    for limit in limits:
        for c, x in ordered:
            k = min(limit(x), min(rest[y] // m for y, m in counts[c].items()))
            if k > 0:
                times[c] += k
                for y, m in counts[c].items():
                    rest[y] -= k * m
    return best_fit_rest(rest, [(k, c) for c, k in sorted(times.items())], capacity)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, tuple[int, ...]]]:
    """Configurations with how many sequences use each; together they hold every piece exactly once.

    The fractional solution is rounded in four ways, and the one with the fewest sequences
    kept: down and to the nearest, down and up in the order of waste or of the longest
    piece, and down only. Few pieces of each length favour less rounding up, many more.
    """
    rest = {x: n for x, n in histogram.items() if n}
    full = rest.pop(capacity, 0)
    chosen: list[tuple[int, tuple[int, ...]]] = []
    if rest:
        lengths = np.array(sorted(rest), np.int64)
        use = fractional_configurations(lengths, np.array([rest[int(x)] for x in lengths], float), capacity, rounds)
        by_waste = lambda c: (capacity - sum(c[0]), -c[1], c[0])
        by_longest = lambda c: (-c[0][0], capacity - sum(c[0]), -c[1], c[0])
        down, nearest, up = int, lambda x: int(x + 0.5), math.ceil
        ways = (((down, nearest), by_waste), ((down, up), by_longest), ((down, up), by_waste), ((down,), by_waste))
        chosen = min((round_configurations(use, rest, capacity, limits, order) for limits, order in ways), key=lambda found: sum(k for k, _ in found))
    return [(full, (capacity,))] * bool(full) + chosen


def slot_table(chosen: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each configuration and length in it: which ranks of that length go there, sorted by (length, first rank)."""
    rows, used, sequence = [], Counter(), 0
    for times, parts in chosen:
        offset = 0
        for length, count in sorted(Counter(parts).items(), reverse=True):
            rows.append((length, used[length], times, sequence, offset))
            used[length] += times * count
            offset += length * count
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "times", "sequence", "offset"), columns))


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), rounds: int = ROUNDS) -> DataFrame:
    """Add (sequence_id long, offset long) to a table of pieces of at most ``capacity`` tokens.

    Offsets are gapless from 0 in each sequence. Columns of these two names in ``pieces``
    are replaced; all others stay. A null length or one below 1 takes no room: its
    sequence_id and offset are null. A length over ``capacity`` is an error. Repeated rows
    are pieces of their own; an empty table gives an empty table.
    """
    require(pieces, length_col, *order)
    spark = pieces.sparkSession
    pieces = cut(pieces.drop("sequence_id", "offset"), "pieces")
    takes = F.coalesce(F.col(length_col) > 0, F.lit(False))
    histogram = {int(r[0]): int(r[1]) for r in pieces.where(takes).groupBy(length_col).count().collect()}
    if histogram and max(histogram) > capacity:
        raise ValueError(f"a piece has {max(histogram)} tokens, over the capacity of {capacity}")
    table = spark.sparkContext.broadcast(slot_table(solve(histogram, capacity, rounds)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.value
        keys = (slots["length"] << 44) + slots["first"]
        for batch in batches:
            length = batch.column(names.index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            inner = rank - slots["first"][at]
            sequence = slots["sequence"][at] + inner % slots["times"][at]
            offset = slots["offset"][at] + inner // slots["times"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = pieces.columns
    ranked = rank_in_groups(pieces.where(takes), [length_col], [F.col(c) for c in order], fresh(names, "rank")[0])
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = ranked.mapInArrow(lean(place), f"{out}, sequence_id bigint, offset bigint")
    if pieces.schema[length_col].nullable:
        none = F.lit(None).cast("bigint")
        placed = placed.union(pieces.where(~takes).select("*", none.alias("sequence_id"), none.alias("offset")))
    return placed


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Packs all documents; see ``tokenize_pieces`` and ``best_fit_pack``."""
    pieces = tokenize_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digested = pieces.select("doc_id", "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"))
    return best_fit_pack(digested)
