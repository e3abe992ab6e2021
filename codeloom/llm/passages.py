"""Substring deduplication by MinHash banding of paragraphs.

A paragraph is any run of 50 words, so a passage of at least 50 words that two documents share
holds paragraphs of both, wherever it stands in them. Paragraphs are similar if their sets of
five-word shingles have a Jaccard similarity of at least 0.75.

Bands. The signature of a paragraph holds two minima for each stretch of 20 of its 46 shingles;
a band is a stretch. Similar paragraphs lack at most 6 of each other's shingles, and a place
where their order breaks costs 4 at least, so they have one such place at most and a common
stretch of 20 or more: one band of theirs is equal for certain. (Where shingles repeat inside
a paragraph this is only nearly so.) Minima of sliding stretches are shared by most paragraphs
around, so a text gives about one key for five words.

Join. The documents of a band key are compared with the one of least id: the exact chains of
equal runs between the two texts, each cut into its longest passages that are similar enough;
if a place is in none, the paragraphs that hold it decide, by exact Jaccard. Documents that are
not joined at some place meet the least of these at this key, and after that the least of those
that also have the next shingle beyond either end of what they share with it, and so on: each
round a group shares one shingle more, and when it shares a paragraph's worth all are joined, so
a group of any size costs a few pairs a document; five documents or fewer that are left with a key are
all compared. (Of a larger group, two that share just what their leads share, and go on together only
behind an edit at that very place, meet by a minimum over the shingles behind it: nearly always. Words are compared by
hashes of 32 bits, so two different words pass for equal with a chance of one in 4 * 10^9.)

Removal. Documents that share passages form clusters (connected components). A passage stays
in the lesser document, and is removed from the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import components, cut, fresh, lean, partitions, require
from .shingles import _stir, shingle_hashes, text_buffers, word_hashes
from .tokenization import slices, text_sizes

PARAGRAPH = 50
WORDS = 5
STRETCH = 20
THRESHOLD = 0.75
SLICE = 1_000_000
#: Keys of a block at most, about.
BLOCK = 250_000
BROADCAST_ROWS = 500_000
#: Shingles behind an edit of which the minimum is taken, and how far behind the run's end they start.
BEYOND = 14
EDIT = 6
#: Documents of one key, not joined yet, up to which all are compared with each other.
TOGETHER = 5
PAIRS_AT_ONCE = 4_000_000
#: The first pairs are verified in so many shares of the documents, one after the other, so that the words sent around at a time take that much less disk.
SHARES = 4


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def band_keys(data: np.ndarray, offsets: np.ndarray, paragraph: int = PARAGRAPH, k: int = WORDS, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, place): band keys of all paragraphs of the texts, once for each run of equal keys, in order of place.

    ``place`` is the word at which the first minimum's shingle starts. Keys depend on the shingles alone: the first
    minimum is of 32 bits, above the place's 32, whatever the number of words, the second of 64.
    """
    words, bounds = word_hashes(data, offsets)
    none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    span = stretch + k - 1
    if len(words) < paragraph:
        return none
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = (text[: len(words) - span + 1] == text[span - 1 :]) & (sizes[text[: len(words) - span + 1]] >= paragraph)
    if not inside.any():
        return none
    owner = text[: len(inside)]
    grams = shingle_hashes(words, k)
    bits = np.uint64(32)
    places = np.arange(len(grams), dtype=np.uint64)
    first = sliding_minimum((_stir(grams + np.uint64(0xD6E8FEB86659FD93)) >> bits << bits) | places, stretch)
    second = sliding_minimum(_stir(grams + np.uint64(0xA0761D6478BD642F)), stretch)
    new = inside.copy()
    new[1:] &= (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    key = _stir(_stir(first[at] >> bits) + second[at])
    place = (first[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) - bounds[owner[at]]
    return key, owner[at], place


def _star(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(key, b, a, b's place) of keys of several documents, a being the least, itself too; the rows of all least ones.

    Rows are sorted by key and document. Where a has the shingle, verification looks up.
    """
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    lead = np.repeat(first, size)
    other = doc != doc[lead]
    several = np.repeat(np.logical_or.reduceat(other, first), size)
    return (key[several], doc[several], doc[lead[several]], place[several]), np.flatnonzero(~other)


def colliding_paragraphs(docs: DataFrame, blocks: int) -> DataFrame:
    """(key, b, a, pb): each place of a document with a band key that another has, and the least document with the key.

    The least of a slice is found there, and it alone goes on to the key's block, so no block gets more
    rows of a key than there are slices. Then the least of all takes the place of the slices' ones, by a join that
    may split a key's rows: what is compared does not depend on how the documents are dealt out.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(text_sizes(batch.column(1)), SLICE):
                part = batch.slice(lo, hi - lo)
                key, owner, place = band_keys(*text_buffers(part.column(1)))
                if not len(key):
                    continue
                doc = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[owner]
                order = np.lexsort((place, doc, key))
                key, doc, place = key[order], doc[order], place[order]
                met, lead = _star(key, doc, place)
                rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
                if len(met[0]):
                    for column, value in zip(rows, (-1 - int(met[0][0] % np.uint64(997)), *(m.tobytes() for m in met))):
                        column.append(value)
                key, doc, place = key[lead], doc[lead], place[lead]
                block = (key >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
                edges = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    for column, value in zip(rows, (int(block[x]), key[x:y].tobytes(), doc[x:y].tobytes(), place[x:y].astype("<u4").tobytes(), b"")):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["block", "w", "x", "y", "z"])

    def out(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["key", "b", "a", "pb"])

    def meet(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, doc, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((place, doc, key))
        return out(*_star(key[order], doc[order], place[order])[0])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for i, n in enumerate(numbers):
                parts = [batch.column(c)[i].as_buffer() for c in range(1, 5)]  # no copies
                if n < 0:
                    yield out(*(np.frombuffer(p, "<i8") for p in parts))
                    continue
                if n != block and held:
                    yield meet(held)
                    held = []
                block = n
                held.append([np.array(np.frombuffer(p, kind)) for p, kind in zip(parts, ("<u8", "<i8", "<u4"))])
        if held:
            yield meet(held)

    dealt = docs.mapInArrow(lean(spread), "block bigint, w binary, x binary, y binary, z binary").repartition(partitions(docs.sparkSession), "block")
    met = dealt.sortWithinPartitions("block").mapInArrow(lean(gather), "key bigint, b bigint, a bigint, pb bigint")
    met = cut(met.where("a <> b"), "met-in-slices")
    least = met.groupBy("key").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least < most").select("key", "least")
    least = cut(least, "least-documents")  # a table of its own, so that the join's hot keys can be split
    return met.join(least, "key", "left").select("key", "b", F.coalesce("least", "a").alias("a"), "pb").where("a <> b")


class Held:
    """A text's words and shingles; ``index`` says where it has each shingle."""

    def __init__(self, words: np.ndarray, k: int = WORDS):
        self.words, self.grams = words, shingle_hashes(words, k)
        self.order: np.ndarray | None = None

    def index(self) -> None:
        if self.order is None:
            self.padded = np.concatenate((self.grams, np.zeros(64, np.uint64)))
            self.order = np.argsort(self.grams, kind="stable")
            ordered = self.grams[self.order]
            self.ends = np.searchsorted(ordered, ordered, "right")
            self.ordered = ordered

    def ranges(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the shingles starts and ends in ``order``."""
        self.index()
        if not len(self.ordered):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        lo = np.searchsorted(self.ordered, grams)
        at = np.minimum(lo, len(self.ordered) - 1)
        return lo, np.where(self.ordered[at] == grams, self.ends[at], lo)


def equal_run(x: np.ndarray, y: np.ndarray) -> int:
    """The number of equal elements that two arrays start with."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:  # in steps, so a long passage costs its length once
        differ = x[at : min(at + step, n)] != y[at : min(at + step, n)]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = at + len(differ), min(4096, 4 * step)
    return n


class Alignment:
    """The shingles that two texts x and y share, and passages around them.

    A chain of equal runs and edits between them has a Jaccard similarity of at least t just
    if its score is not negative: 1 - t for each shared shingle, less t for each other one on
    either side. So an edit may be as long as what is equal around it pays for.
    """

    def __init__(self, x: Held, y: Held, threshold: float = THRESHOLD, k: int = WORDS):
        self.x, self.y, self.gx, self.gy, self.threshold, self.k = x, y, x.grams, y.grams, threshold, k
        self.lo, self.hi = y.ranges(self.gx)
        self.shared = self.hi > self.lo
        self.common = np.flatnonzero(self.shared)

    def hopeless(self, places: np.ndarray, paragraph: int = PARAGRAPH) -> bool:
        """Whether no paragraph around a shingle like those of the places can have enough of y's shingles: all of the text's differ, and too few are shared."""
        n = paragraph - self.k + 1
        counts = np.concatenate(([0], np.cumsum(self.shared)))
        starts = (places[:, None] - np.arange(n)).ravel()
        starts = starts[(starts >= 0) & (starts <= len(self.gx) - n)]
        if len(starts) and (counts[starts + n] - counts[starts]).max() >= self.threshold * n:
            return False
        return len(np.unique(self.gx)) == len(self.gx)

    def run(self, u: int) -> tuple[int, int]:
        """The longest run of x's shingles around a shared one that is equal in y: its start and end."""
        runs = [(u - equal_run(self.gx[:u][::-1], self.gy[:v][::-1]), u + equal_run(self.gx[u:], self.gy[v:])) for v in self.meets(u).tolist()]
        return max(runs, key=lambda r: r[1] - r[0])

    def meets(self, u: int) -> np.ndarray:
        """Where y has x's shingle u, in order."""
        return self.y.order[self.lo[u] : self.hi[u]]

    def longest(self, u: int, after: int) -> tuple[int, int]:
        """(v, shingles) of the longest equal run from u in x on; of several the first from ``after`` on, or else the first."""
        there = self.meets(u)
        if len(there) == 1:
            return int(there[0]), equal_run(self.gx[u:], self.gy[int(there[0]) :])
        best, tied = 0, there[:0]
        for lo in range(0, len(there), 2048):
            alive, at = there[lo : lo + 2048], 0
            while True:
                part = self.gx[u + at : u + at + 64]
                if not len(part):
                    n = np.zeros(len(alive), np.int64)
                    break
                same = self.y.padded[alive[:, None] + (at + np.arange(len(part)))] == part
                same &= alive[:, None] + (at + np.arange(len(part))) < len(self.gy)
                whole = same.all(1)
                if len(part) < 64 or not whole.any():
                    n = np.where(whole, len(part), same.argmin(1))
                    break
                alive, at = alive[whole], at + 64
            if at + int(n.max()) > best:
                best, tied = at + int(n.max()), alive[n == n.max()]
            elif at + int(n.max()) == best:
                tied = np.concatenate((tied, alive[n == n.max()]))
        on = tied[tied >= after]
        return int(on[0] if len(on) else tied[0]), best

    def chains(self) -> list[list[tuple[int, int, int]]]:
        """All equal runs (u, v, shingles) of the texts, each put on the nearest chain that goes on in both texts."""
        t, gain, chains = self.threshold, 1 - self.threshold, []
        open_: list[list] = []  # end in x, end in y, equal shingles, runs
        i = after = 0
        while i < len(self.common):
            u = int(self.common[i])
            v, n = self.longest(u, after)
            near, best = math.inf, None
            for c in open_:
                gap = u - c[0] + v - c[1]
                if v >= c[1] and gap < near and t * gap <= gain * (c[2] + min(len(self.gx) - u, len(self.gy) - v)):
                    near, best = gap, c
            if best is None:
                best = [0, 0, 0, []]
                chains.append(best[3])
                open_ = [c for c in open_ if t * (u - c[0]) <= gain * (c[2] + len(self.gx) - u)]
                open_.append(best)
            best[3].append((u, v, n))
            best[0], best[1], best[2] = u + n, v + n, best[2] + n
            after = v + n
            i = int(np.searchsorted(self.common, u + n))
        return chains

    def similar(self, xa: int, xb: int, ya: int, yb: int) -> bool:
        """Whether the exact shingle sets of two passages, from word to word, are similar enough."""
        a, b = (np.unique(g) for g in (self.gx[xa : xb - self.k + 1], self.gy[ya : yb - self.k + 1]))
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= self.threshold * (len(a) + len(b) - both)

    def passages(self, runs: list[tuple[int, int, int]], paragraph: int = PARAGRAPH) -> list[tuple[int, int, int, int]]:
        """(start in x, start in y, words in x, words in y) of the longest parts of a chain that are similar enough."""
        found, todo, t, k = [], [runs], self.threshold, self.k
        while todo:
            runs = todo.pop()
            if min(runs[-1][c] + runs[-1][2] - runs[0][c] for c in (0, 1)) + k - 1 < paragraph:
                continue
            before, after, score = [], [], 0.0
            for i, (u, v, n) in enumerate(runs):
                if i:
                    score -= t * (u + v - runs[i - 1][0] - runs[i - 1][1] - 2 * runs[i - 1][2])
                before.append(score)
                score += (1 - t) * n
                after.append(score)
            lows: list[int] = []
            for i, s in enumerate(before):
                if not lows or s < before[lows[-1]]:
                    lows.append(i)
            best, longest = None, 0
            for j in range(len(runs) - 1, -1, -1):
                while lows and (lows[-1] > j or after[j] >= before[lows[-1]] - 1e-9):
                    i = lows.pop()
                    size = min(runs[j][c] + runs[j][2] - runs[i][c] for c in (0, 1)) + k - 1
                    if i <= j and size > longest:
                        best, longest = (i, j), size
            if best is None or longest < paragraph:
                continue
            i, j = best
            (xa, ya, _), (xb, yb, n) = runs[i], runs[j]
            xb, yb = xb + n + k - 1, yb + n + k - 1
            if i == j or self.similar(xa, xb, ya, yb):
                found.append((xa, ya, xb - xa, yb - ya))
                todo += [part for part in (runs[:i], runs[j + 1 :]) if part]
            else:  # repeated shingles count once in a set
                found += [(u, v, n + k - 1, n + k - 1) for u, v, n in runs if n + k - 1 >= paragraph]
        return found

    def paragraphs(self, places: np.ndarray, paragraph: int = PARAGRAPH) -> list[tuple[int, int, int, int]]:
        """Similar paragraphs of the texts that hold the shared shingle of one of the places of x, over equal words to both sides.

        Every paragraph of x with such a place meets every paragraph of y with a shingle of the
        places near it, by exact Jaccard; of paragraphs with the same shingles one is compared.
        """
        n = paragraph - self.k + 1
        found: list[tuple[int, int, int, int]] = []
        if min(len(self.gx), len(self.gy)) < n or not len(places):
            return found
        near = np.cumsum(np.concatenate(([0], (places[1:] - places[:-1] >= n) | (places[1:] // 256 != places[:-1] // 256))))
        for own in np.split(places, np.flatnonzero(near[1:] != near[:-1]) + 1):
            (starts, which), xw = different_windows(self.gx, own, n)
            best, mate = self.mates(own, xw, n)
            if len(best) and best.max() >= self.threshold:
                for u in own.tolist():
                    if any(a <= u < a + m for a, _, m, _ in found):
                        continue
                    i, j = np.searchsorted(starts, (u - n + 1, u + 1))
                    if best[which[i:j]].max() >= self.threshold:
                        w = i + int(best[which[i:j]].argmax())
                        found.append(self.extended(int(starts[w]), int(mate[which[w]]), paragraph))
        return found

    def mates(self, places: np.ndarray, xw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the paragraphs of x that start at ``xw`` the similarity of the most similar paragraph of y, 0 where none can do, and its start."""
        best, mate, yw = np.zeros(len(xw)), np.zeros(len(xw), np.int64), None
        at = np.arange(n)
        for lo in range(0, len(xw), 128):
            inside = xw[lo : lo + 128, None] + at
            names, ids = np.unique(self.gx[inside], return_inverse=True)
            ids = ids.reshape(inside.shape)
            has = np.zeros((len(inside), len(names)), np.float32)
            has[np.arange(len(inside))[:, None], ids] = 1
            size = has.sum(1)
            there = np.zeros(len(names), np.float32)
            there[ids[self.shared[inside]]] = 1
            may = np.flatnonzero(has @ there >= self.threshold * size)  # the others lack too much, whatever y's paragraphs
            if not len(may):
                continue
            if yw is None:
                of = np.concatenate([self.meets(u) for u in places.tolist()])
                _, yw = different_windows(self.gy, np.unique(of), n)
            for lo_y in range(0, len(yw), 512):
                other = self.gy[yw[lo_y : lo_y + 512, None] + at]
                ids = np.minimum(np.searchsorted(names, other), len(names) - 1)
                same = names[ids] == other
                met = np.zeros((len(other), len(names)), np.float32)
                met[np.nonzero(same)[0], ids[same]] = 1
                other.sort(1)
                many = 1 + (other[:, 1:] != other[:, :-1]).sum(1)
                both = has[may] @ met.T
                share = both / (size[may][:, None] + many - both)
                j = share.argmax(1)
                top = share[np.arange(len(may)), j]
                better = top > best[lo + may]
                best[lo + may[better]], mate[lo + may[better]] = top[better], yw[lo_y + j[better]]
        return best, mate

    def extended(self, xa: int, ya: int, paragraph: int) -> tuple[int, int, int, int]:
        """Two similar paragraphs, with the equal words to each side where they stay similar so."""
        x, y, xb, yb = self.x.words, self.y.words, xa + paragraph, ya + paragraph
        n = equal_run(x[:xa][::-1], y[:ya][::-1])
        if n and self.similar(xa - n, xb, ya - n, yb):
            xa, ya = xa - n, ya - n
        n = equal_run(x[xb:], y[yb:])
        if n and self.similar(xa, xb + n, ya, yb + n):
            xb, yb = xb + n, yb + n
        return xa, ya, xb - xa, yb - ya


def different_windows(grams: np.ndarray, places: np.ndarray, n: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((starts of all windows of ``n`` that hold a place, which different one each is), starts of the different ones)."""
    holds = np.zeros(len(grams) + 1, np.int64)
    np.add.at(holds, np.maximum(places - n + 1, 0), 1)
    np.add.at(holds, np.minimum(places, len(grams) - n) + 1, -1)
    starts = np.flatnonzero(np.cumsum(holds)[: len(grams) - n + 1] > 0)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_stir(grams + np.uint64(n)))))
    _, first, which = np.unique(sums[starts + n] - sums[starts], return_index=True, return_inverse=True)
    return (starts, which), starts[first]


def shared_passages(x: np.ndarray | Held, y: np.ndarray | Held, places: Iterable[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """The passages that x shares with y: (start in x, start in y, words in x, words in y); and what is in none: (place, start, end).

    ``places`` are shingles of x that y may have; wherever else x has them counts as well. If a
    place is in no passage of the texts' chains, all paragraphs around it decide, wherever y has
    its shingle. Of the given places those in none of these are returned with the run of shingles
    around each that is equal in y; of places with the same words around them the first.
    """
    x, y = (w if isinstance(w, Held) else Held(w) for w in (x, y))
    if len(x.words) == len(y.words) and len(x.words) >= PARAGRAPH and (x.words == y.words).all():
        return [(0, 0, len(x.words), len(x.words))], []
    found = Alignment(x, y)
    given = np.unique(np.fromiter(places, np.int64))
    given = given[given < len(x.grams)]
    if found.hopeless(given):
        return [], [(u, *found.run(u)) for u in given.tolist() if found.shared[u]]
    chains = found.chains()
    kept = [p for runs in chains for p in found.passages(runs)]
    at = np.flatnonzero(np.isin(x.grams, x.grams[given]))
    at = outside(at, merge([(a, a + n) for a, _, n, _ in kept]))
    if not len(at):
        return kept, []
    extra = found.paragraphs(at[found.shared[at]])
    runs = sorted((u, u + n) for c in chains for u, _, n in c)
    starts = np.array([u for u, _ in runs], np.int64)
    rest, seen, n = [], set(), PARAGRAPH - found.k + 1
    for u in outside(given, merge([(a, a + m) for a, _, m, _ in kept + extra])).tolist():
        i = int(np.searchsorted(starts, u, "right")) - 1
        around = x.grams[max(0, u - n) : u + n].tobytes()
        if i >= 0 and u < runs[i][1] and around not in seen:
            seen.add(around)
            rest.append((u, *runs[i]))
    return kept + extra, rest


def outside(places: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The places in none of the spans, which are apart and in order."""
    if not spans:
        return places
    starts, ends = np.array(spans, np.int64).T
    i = np.searchsorted(starts, places, "right") - 1
    return places[(i < 0) | (places >= ends[i])]


def next_keys(grams: np.ndarray, start: int, end: int) -> list[int | None]:
    """What may go on beyond a run of shingles: the run and the one before, or the one after, or a minimum behind an edit to either side."""
    before, after = grams[max(0, start - EDIT - BEYOND) : max(0, start - EDIT)], grams[end + EDIT : end + EDIT + BEYOND]
    whole = grams[start:end].tobytes()
    out = [grams[start - 1 : end].tobytes() if start else None, grams[start : end + 1].tobytes() if end < len(grams) else None]
    out += [way + whole + _stir(part + np.uint64(1)).min().tobytes() if len(part) == BEYOND else None for way, part in ((b"<", before), (b">", after))]
    return [None if x is None else xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in out]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SHAPE = ("doc_id", "start_word", "n_words", "kept_doc_id", "kept_start_word", "kept_n_words", "before", "after", "behind", "beyond", "key")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The removals: (doc_id, start_word, n_words, kept_doc_id, kept_start_word, kept_n_words, cluster_id), one row per passage.

    ``kept_doc_id`` is less than ``doc_id`` and has the passage, or one similar enough; it may
    be removed there in favour of a still lesser document. Of similar paragraphs with a common
    band at most one stays whole, but for the rare case named above; the rows do not depend on how ``docs`` is partitioned. ``cluster_id``
    is the least document of all that share passages with either, directly or not. Passages of
    one document may overlap; a passage that one document holds twice is no repeat by itself.
    Null texts, texts of fewer than 50 words and null ids have no passages; rows with one id
    are one document; other columns are not read; an empty table gives an empty table. Ids may be of any
    type that can be sorted; those that are no integers are numbered in their order, and named again in the result.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        ordered = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().repartitionByRange(partitions(spark), "id").sortWithinPartitions("id")
        named = cut(ordered.withColumn("number", F.monotonically_increasing_id()), "numbered-ids")
        numbered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(named, "id").select(F.col("number").alias("doc_id"), "text")
        found = repeated_passages(numbered)
        for column in ("doc_id", "kept_doc_id", "cluster_id"):
            found = found.join(named.select(F.col("number").alias(column), F.col("id").alias(f"{column}_name")), column).drop(column).withColumnRenamed(f"{column}_name", column)
        return found.select(*_SHAPE[:6], "cluster_id")
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(8 * partitions(spark), math.ceil(size / 30 / BLOCK))  # about one key for 30 bytes
    found = cut(colliding_paragraphs(texts, blocks), "colliding-paragraphs")
    ids = documents_of(found)
    few = ids.count() <= BROADCAST_ROWS

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(text_sizes(batch.column(1)), SLICE):
                part = batch.slice(lo, hi - lo)
                words, bounds = word_hashes(*text_buffers(part.column(1)))
                small = (words >> np.uint64(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([small[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())], names=["doc_id", "words"])

    involved = texts.join(F.broadcast(ids) if few else ids, texts.doc_id == ids.id, "left_semi")
    words = cut(involved.mapInArrow(lean(hashes), "doc_id bigint, words binary"), "passage-words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, Held] | None = None
        for batch in batches:
            for lo, hi in slices([a + b + 100 for a, b in zip(text_sizes(batch.column(3)), text_sizes(batch.column(4)))], PAIRS_AT_ONCE):
                rows: list[tuple[int | None, ...]] = []
                for b, a, seeds, x, y in zip(*(c.to_pylist() for c in batch.slice(lo, hi - lo).columns)):
                    x, y = (np.frombuffer(w, "<u4").astype(np.uint64) for w in (x, y))
                    if last is None or last[0] != a or len(last[1].words) != len(y) or (last[1].words != y).any():
                        last = (a, Held(y))
                    x = Held(x)
                    passages, rest = shared_passages(x, last[1], {s["pb"] for s in seeds})
                    rows += [(b, start, n, a, kept_start, kept_n, None, None, None, None, None) for start, kept_start, n, kept_n in passages]
                    go_on = {place: (b, start, 0, a, place, 0, *next_keys(x.grams, start, end)) for place, start, end in rest}
                    rows += [(*go_on[s["pb"]], s["key"]) for s in seeds if s["pb"] in go_on]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_SHAPE))], names=_SHAPE)

    def verified_pairs(seeds: DataFrame, own: DataFrame, shares: int = 1) -> tuple[DataFrame, DataFrame]:
        """Of seeds (key, b, a, pb) and their documents: the passages; and (doc, place, start, before, after, behind, beyond, key), the places that are in none and the keys of what may go on there."""
        small = own.count() <= BROADCAST_ROWS

        def words_of(role: str) -> DataFrame:
            """The words of the documents in a role; where the documents are few only theirs are sent around."""
            if not small:
                return words
            named = own.where(role).select("id")
            return words.join(F.broadcast(named), words.doc_id == named.id, "left_semi")

        def verified_share(seeds: DataFrame, x: DataFrame) -> DataFrame:
            pairs = seeds.groupBy("b", "a").agg(F.collect_list(F.struct("key", F.col("pb").cast("int").alias("pb"))).alias("seeds"))
            both = pairs.join(x.toDF("b", "x"), "b").join(words_of("as_a").toDF("a", "y"), "a").select("b", "a", "seeds", "x", "y")
            return cut(both.mapInArrow(lean(verify), ", ".join(f"{c} bigint" for c in _SHAPE)), "passages")

        if shares == 1:
            out = verified_share(seeds, words_of("as_b"))
        else:
            share = [F.pmod(F.xxhash64(c), F.lit(shares)) for c in ("b", "doc_id")]
            out = reduce(DataFrame.union, [verified_share(seeds.where(share[0] == i), words_of("as_b").where(share[1] == i)) for i in range(shares)])
        return out.where("n_words > 0").select(*_SHAPE[:6]), out.where("n_words = 0").select(F.col("doc_id").alias("doc"), F.col("kept_start_word").alias("place"), F.col("start_word").alias("start"), *_SHAPE[6:])

    verified, failed = verified_pairs(found, ids, SHARES)
    rest = cut(unsettled(failed.select("key", "doc", "place").distinct(), verified), "unsettled")
    first = True
    while not rest.isEmpty():
        # few documents of a key meet all at once; of many, each meets the least, and in each round what they share grows by a shingle, so it comes to an end
        sizes = rest.groupBy("key").agg(F.min("doc").alias("least"), F.countDistinct("doc").alias("n"))
        sizes = cut(sizes, "unsettled-keys")
        many = sizes.where(F.col("n") > TOGETHER)
        few_docs = rest.join(sizes.where(F.col("n") <= TOGETHER).select("key"), "key", "left_semi").select("key", F.col("doc").alias("a")).distinct()
        leads = many.select("key", F.col("least").alias("a")).union(few_docs)
        led = cut(rest.join(leads, "key").where("doc > a").select("key", F.col("doc").alias("b"), "a", F.col("place").alias("pb")), "led")
        more, failed = verified_pairs(led, documents_of(led))
        verified = verified.union(more)
        failed = failed.join(many.select("key"), "key", "left_semi")
        on = failed.select("doc", F.col("start").alias("place"), F.explode(F.array(*(_SHAPE[6:10] if first else _SHAPE[6:8]))).alias("key")).where("key is not null").select("key", "doc", "place")
        rest, first = cut(unsettled(on.distinct(), more), "unsettled"), False
    # of several documents that hold the same passage the least keeps it
    least = F.min(F.struct("kept_doc_id", "kept_start_word", "kept_n_words")).alias("k")
    removals = verified.groupBy("doc_id", "start_word", "n_words").agg(least).select("doc_id", "start_word", "n_words", "k.*")
    clusters = components(verified.select(F.col("doc_id").alias("a"), F.col("kept_doc_id").alias("b")))
    return removals.join(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster_id")), "doc_id")


def documents_of(pairs: DataFrame) -> DataFrame:
    """(id, as_b, as_a): the documents of pairs (b, a), and on which sides they are."""
    sides = F.explode(F.array(*[F.struct(F.col(c).alias("id"), F.lit(c == "b").alias("as_b"), F.lit(c == "a").alias("as_a")) for c in ("b", "a")]))
    return cut(pairs.select(sides.alias("s")).select("s.*").groupBy("id").agg(F.max("as_b").alias("as_b"), F.max("as_a").alias("as_a")), "passage-documents")


def unsettled(rest: DataFrame, verified: DataFrame) -> DataFrame:
    """Of (key, doc, place) the rows outside of all passages to be removed, of keys that several documents still have."""
    gone = verified.select("doc_id", "start_word", (F.col("start_word") + F.col("n_words")).alias("end_word")).distinct()
    rest = rest.join(gone, (rest.doc == gone.doc_id) & (rest.place >= gone.start_word) & (rest.place < gone.end_word), "left_anti")
    several = rest.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("key")
    return rest.join(several, "key", "left_semi")


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """Cut the passages' words out of their documents' texts; all rows and columns stay, whatever their names.

    White space after a removed passage goes with it. A text without passages, a null text and
    a row with a null id stay as they are; where an id is repeated all its rows are cut alike;
    an empty table gives an empty table. ``count_col`` names a column that holds the text's
    number of characters, to be set anew where the text changed.
    """
    require(docs, id_col, text_col, *([count_col] if count_col else []))
    names = docs.columns
    key, spans = fresh(names, "id", "spans")
    found = passages.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start_word", "n_words")).alias(spans))
    joined = docs.join(found, docs[id_col] == found[key], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = names.index(text_col)
        for batch in batches:
            cuts = batch.column(len(names)).to_pylist()
            texts = [without_words(text, [(s["start_word"], s["start_word"] + s["n_words"]) for s in spans]) if spans and text is not None else text for text, spans in zip(batch.column(where).to_pylist(), cuts)]
            columns = list(batch.columns[: len(names)])
            columns[where] = pa.array(texts, pa.string())
            if count_col:
                i = names.index(count_col)
                columns[i] = pa.array([old if s is None or t is None else len(t) for t, s, old in zip(texts, cuts, columns[i].to_pylist())], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*[docs[c] for c in names], spans).mapInArrow(lean(run), docs.schema)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; words are numbered from 0."""
    data = text.encode()
    dark = np.frombuffer(data, np.uint8)
    blank = (dark == 32) | ((dark >= 9) & (dark <= 13))
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))).tolist()
    parts, at = [], 0
    for a, b in merge(spans):
        if a < len(starts):
            parts.append(data[at : starts[a]])
            at = starts[b] if b < len(starts) else len(data)
    parts.append(data[at:])
    return b"".join(parts).decode()


def op4_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that documents share, with what is to be removed."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
