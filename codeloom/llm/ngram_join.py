"""N-gram Jaccard join of documents, exact.

The documents' incidence with n-grams is a sparse matrix; the join is its product with its
own transpose, of which only the classes of linked rows are wanted. Equal rows are one node.
The product is taken in blocks of n-grams and cut down by bounds that lose no link:

1. Probe. Half of the n-gram space, a block at a time: an n-gram of one node alone counts
   against that node. A node with more such n-grams than a partner may lack has no link.
2. Order. The remaining nodes' n-grams are ordered by how many nodes share them. Two linked
   nodes meet in the rarest ones: in the first n - ceil(t n) + 1 of each.
3. Pivots. The nodes that share such an n-gram are compared with one of them, so that a
   group of copies of any size gives as many pairs as it has nodes, and not all its pairs.
4. Rest. Nodes of one n-gram that still lie in different components: those of a few are
   compared in pairs; those of a group of hundreds by a blocked matrix product inside tasks, which gives out links only; first
   of marks of the sets, as long as the sets are large, which rule most pairs out, and of whole sets only where they leave many.
   Either leaves out what the bounds on size and position forbid: at the first n-gram that two linked
   nodes share, both have enough n-grams left, so near copies that are no links meet nobody. A larger
   group is ordered anew, by how many of *its* nodes share an n-gram, and its nodes meet again
   in what is rare within the group, so that one frequent line does not make all pairs of
   those that have it. Where the smaller groups have more pairs than the group they come from,
   it is multiplied once, block by block, and they are left out.

Every link is decided on the exact overlap of two whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, cut_whole, fresh, lean, partitions, require
from .shingles import shingle_sets
from .tokenization import slices, text_sizes

WORDS = 5
THRESHOLD = (75, 100)
#: Entries of a block of the probe, and blocks at least; bytes of text hashed at a time.
BLOCK = 1_000_000
LEAST_BLOCKS = 64
SLICE = 1_000_000
#: Pairs of sets that are unpacked at a time.
ROWS = 256
#: Bits of a set's mark for each n-gram, at least, and bytes at least; by marks most pairs of a product are told apart
#: before the sets themselves are moved.
MARK_BITS = 2
LEAST_MARK = 16
#: Nodes whose ids may be broadcast to fetch their texts, 16 bytes each; beyond, a shuffled join.
BROADCAST_ROWS = 500_000
#: Pivots of a node compared in a round, and rounds; the rest is compared afterwards.
PIVOTS = 3
ROUNDS = 3
#: The rest: a group of up to so many nodes is compared in pairs, up to so many by a product in blocks of so many nodes
#: and n-grams, and a larger one is split by n-grams rare in it, so many times at most. No setting changes the result.
FEW = 16
WHOLE = 4096
GROUP = 512
GROUP_GRAMS = 1_000_000
DEPTH = 8
#: N-grams of a range of the product, and of a dense block of it.
RANGE = 200_000
CHUNK = 4096


def node_of(found: np.ndarray) -> int:
    """A set's identity: the signed 64-bit xxh3 of its sorted hashes."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches (id, text, ...) with the shingle sets of their texts."""
    for batch in batches:
        for lo, hi in slices(text_sizes(batch.column(1)), SLICE):
            part = batch.slice(lo, hi - lo)
            yield part, list(shingle_sets(part.column(1), k))


def describe_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, node, n, probe): a set's identity (null if empty), its size, its n-grams in the probed half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            half = np.uint64(1 << 63)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(np.searchsorted(s, half)) for s in sets], pa.int64())],
                names=["doc_id", "text_hash", "node", "n", "probe"],
            )

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema[0].dataType.simpleString()}, text_hash bigint, node bigint, n bigint, probe bigint")


def shared_counts(docs: DataFrame, k: int, blocks: int) -> DataFrame:
    """(node, shared): at least the number of a node's probed n-grams that another node has.

    An n-gram that several nodes of one slice have is settled there, and goes out once, so a
    block gets no more rows of an n-gram than there are slices, however many documents have it.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, done = np.uint64(1 << 63), set()
        for _, sets in _sets(batches, k):
            nodes, parts = [], []
            for s in sets:
                if len(s) and (node := node_of(s)) not in done:
                    done.add(node)
                    nodes.append(node)
                    parts.append(s[: np.searchsorted(s, half)])
            if len(done) > 1_000_000:
                done.clear()
            if not nodes:
                continue
            grams = np.concatenate(parts)
            owner = np.repeat(np.arange(len(nodes), dtype=np.int64), [len(p) for p in parts])
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            same = grams[1:] == grams[:-1]
            several = np.concatenate((same, [False])) | np.concatenate(([False], same))
            first = np.concatenate(([True], ~same))
            rows: tuple[list, list, list, list] = ([], [], [], [])
            counts = np.bincount(owner[several], minlength=len(nodes))
            have = np.flatnonzero(counts)
            ids = np.array(nodes, np.int64)
            for column, value in zip(rows, (-1 - int(ids[0] % 997), ids[have].tobytes(), counts[have].astype("<u4").tobytes(), b"")):
                column.append(value)
            keep = ~several | first
            grams, owner = grams[keep], np.where(several[keep], -1, owner[keep])
            block = (grams >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(31)
            short = ((grams ^ (grams >> np.uint64(32)) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            order = np.lexsort((owner, block))
            block, owner, short = block[order], owner[order], short[order]
            edges = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)])) if len(block) else np.array([0])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                who, at = np.unique(owner[a:b], return_index=True)
                sizes = np.diff(np.concatenate((at, [b - a])))
                for column, value in zip(rows, (int(block[a]), np.where(who < 0, 0, ids[who]).astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), short[a:b].tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["block", "nodes", "sizes", "grams"])

    def product(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.concatenate([np.repeat(np.frombuffer(a, "<i8"), np.frombuffer(b, "<u4")) for a, b, _ in rows])
        grams = np.concatenate([np.frombuffer(c, "<u4") for _, _, c in rows])
        ids, index = np.unique(nodes, return_inverse=True)
        key = np.sort(grams.astype(np.uint64) << np.uint64(32) | index.astype(np.uint64))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        gram, at = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        size = np.diff(np.concatenate((first, [len(gram)])))
        settled = np.logical_or.reduceat(ids[at] == 0, first)
        live = np.repeat((size > 1) | settled, size)
        counts = np.bincount(at[live], minlength=len(ids))
        have = np.flatnonzero((counts > 0) & (ids != 0))
        return ids[have], counts[have]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        out = lambda ids, counts: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts.astype(np.int64))], names=["node", "shared"])
        for batch in batches:
            for b, nodes, sizes, grams in zip(*(c.to_pylist() for c in batch.columns)):
                if b < 0:
                    yield out(np.frombuffer(nodes, "<i8"), np.frombuffer(sizes, "<u4"))
                    continue
                if b != block and held:
                    yield out(*product(held))
                    held = []
                block = b
                held.append((nodes, sizes, grams))
        if held:
            yield out(*product(held))

    spread_out = docs.mapInArrow(lean(spread), "block bigint, nodes binary, sizes binary, grams binary")
    dealt = spread_out.repartition(min(blocks, 4 * partitions(docs.sparkSession)), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(lean(gather), "node bigint, shared bigint").groupBy("node").agg(F.sum("shared").alias("shared"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose sets are at least as similar as the threshold."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append((num + den) * both >= num * (len(x) + len(y)))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a bigint, b bigint")


def _fits(n1: str, n2: str, threshold: tuple[int, int]) -> Column:
    num, den = threshold
    return F.expr(f"{den} * least({n1}, {n2}) >= {num} * greatest({n1}, {n2})")


def rare_prefixes(sets: DataFrame, threshold: tuple[int, int], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, gram, node, n, place, alone, prev, short): of each node its rarest n-grams, as many as a linked node may not all lack.

    N-grams of one node alone come first and meet nobody, so they are only counted. Those that
    the same nodes have stand together; ``prev`` is the one before, null for the first. A pair
    meets where the smaller set is ``short``. With ``by`` (bigint columns of ``sets``), all this
    is counted in groups, and a node may be in several.
    """
    num, den = threshold

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for lo, hi in slices(text_sizes(batch.column(last)), SLICE):
                grams = [np.frombuffer(x, "<i8") for x in batch.column(last).slice(lo, hi - lo).to_pylist()]
                at = pa.array(np.repeat(np.arange(lo, hi), [len(g) for g in grams]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), *(batch.column(i).take(at) for i in range(last))], names=["gram", *by, "node", "n"])

    keys = "".join(f"{k} bigint, " for k in by)
    entries = sets.select(*by, "node", "n", "grams").mapInArrow(lean(explode), f"gram bigint, {keys}node bigint, n bigint")
    frequent = entries.groupBy(*by, "gram").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("node")).alias("who")).where("df > 1")
    own = Window.partitionBy(*by, "node")
    order = own.orderBy("df", "who", "gram")
    live = entries.join(frequent, [*by, "gram"]).withColumn("alone", F.col("n") - F.count("*").over(own))
    placed = live.withColumn("place", F.row_number().over(order) + F.col("alone")).withColumn("prev", F.lag("gram").over(order))
    short = F.expr(f"place <= n - ({2 * num} * n + {num + den - 1}) div {num + den} + 1")
    return placed.where(F.expr(f"place <= n - ({num} * n + {den - 1}) div {den} + 1")).select(*by, "gram", "node", "n", "place", "alone", "prev", short.alias("short"))


def _with_component(prefixes: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return prefixes.withColumn("c", F.col("node"))
    return prefixes.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def linked_components(sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(node, component) of all nodes with a link; ``sets`` has (node, n, grams binary of sorted hashes, mark)."""
    num, den = threshold
    prefixes = cut(rare_prefixes(sets, threshold), "prefixes")
    links, found = None, None
    for k in range(ROUNDS):
        now = _with_component(prefixes, found)
        central = F.struct((-F.col("alone") / F.col("n")), F.xxhash64("node", F.lit(k))) if k == 0 else F.struct(F.xxhash64("node", F.lit(k)).cast("double"), F.lit(0).cast("bigint"))
        pivots = now.groupBy("gram").agg(F.max(F.struct(central.alias("key"), F.col("node").alias("node"), F.col("n").alias("n"), F.col("c").alias("c"))).alias("p"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
        met = now.join(pivots.select("gram", F.col("p.node").alias("pivot"), F.col("p.n").alias("m"), F.col("p.c").alias("d")), "gram").where("c <> d").where(_fits("n", "m", threshold))
        counted = met.groupBy("node", "pivot").agg(F.count("*").alias("shared"))
        best = counted.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "pivot"))).where(F.col("r") <= PIVOTS)
        pairs = best.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        new = cut(verified(pairs, sets, threshold), "links")
        if new.isEmpty():
            break
        links = new if links is None else links.union(new)
        joined = links
        found = cut_whole(sets.sparkSession, lambda: components(joined), "components")
    now = cut(_with_component(prefixes, found), "placed")
    for new in across_components(now, sets, threshold):
        links = new if links is None else links.union(new)
        found = None
    if links is None:
        return sets.select("node", F.col("node").alias("component")).limit(0)
    return found if found is not None else components(links)


def across_components(prefixes: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> list[DataFrame]:
    """Tables of links (a, b) that join what is still apart; ``prefixes`` are those of all nodes, with their components ``c``.

    No two nodes with a link stay in different components; of the links within a large group
    only those are returned that are needed for that.
    """
    num, den = threshold
    none = F.lit(None).cast("bigint")
    # of two linked nodes the smaller one is short where they meet first, so a node that is too far on for the least such one meets nobody there
    meets = F.expr(f"{num + den} * (1 + n - place) >= {num} * (n + least)")
    now, found, large = prefixes.select("gram", "node", "n", "place", "prev", "short", "c", F.col("gram").alias("grp"), none.alias("of"), none.alias("parent")), [], None
    for depth in range(DEPTH + 1):
        groups = now.groupBy("grp").agg(
            F.count("*").alias("m"), F.sum("n").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.when(F.col("short"), F.col("n"))).alias("least"),
            F.count("prev").alias("later"), F.min("prev").alias("p"), F.max("prev").alias("q"), F.max("of").alias("of"), F.max("parent").alias("parent"),
        )
        # where all of a group have the same n-gram before, they meet in that one
        groups = groups.where("lo <> hi and least is not null and not (later = m and p = q)")
        no_smaller = F.lit(depth == DEPTH) | F.coalesce(2 * F.col("m") > F.col("of"), F.lit(False))
        kind = F.when(F.col("m") <= FEW, "pairs").when((F.col("m") <= WHOLE) | no_smaller, "product").otherwise("split")
        groups = cut(groups.select("grp", "m", "size", "least", "of", "parent", kind.alias("kind")), "groups")
        if large is not None:
            # a group that this does not split: its own pairs are fewer than those of all it comes to
            dense = groups.groupBy("parent").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("all"), F.max("of").alias("of")).where("all > double(of) * of")
            dense = cut(dense.select(F.col("parent").alias("grp")), "dense")
            if not dense.isEmpty():
                found.append(cut(product_links(_counted(large.join(dense, "grp").where(meets)), sets, threshold), "links"))
                groups = cut(groups.join(dense.toDF("parent"), "parent", "left_anti"), "groups")
        groups = groups.select("grp", "m", "size", "least", "kind")
        kinds = {r["kind"] for r in groups.select("kind").distinct().collect()}  # three at most
        members = now.drop("of", "parent").join(groups, "grp")
        if "pairs" in kinds:
            found.append(cut(verified(_pairs(members.where("kind = 'pairs'").where(meets), threshold), sets, threshold), "links"))
        if "product" in kinds:
            found.append(cut(product_links(_counted(members.where("kind = 'product'").where(meets)), sets, threshold), "links"))
        if "split" not in kinds:
            break
        large = cut(members.where("kind = 'split'").select("grp", "m", "least", "node", "n", "c", "prev", "place"), "members")
        inner = rare_prefixes(large.select("grp", "node").join(sets, "node"), threshold, ("grp",))
        now = inner.join(large.select("grp", "node", "c", F.col("m").alias("of")), ["grp", "node"]).withColumn("parent", F.col("grp")).withColumn("grp", F.xxhash64("grp", "gram"))
        now = cut(now.select("gram", "node", "n", "place", "prev", "short", "c", "grp", "of", "parent"), "placed")
    return [x for x in found if not x.isEmpty()]


def _counted(members: DataFrame) -> DataFrame:
    """(grp, m, size, node, c, prev, place): members with the number of their group's nodes and of those nodes' n-grams."""
    members = cut(members.select("grp", "node", "n", "c", "prev", "place"), "met")
    counts = members.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("grp", "m", "size")
    return members.drop("n").join(counts, "grp")


def _pairs(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of a group's nodes in different components that pass the bounds on size and position."""
    num, den = threshold
    a = members.select("grp", F.col("node").alias("a"), F.col("n").alias("an"), F.col("place").alias("ap"), F.col("c").alias("ac"))
    b = members.select("grp", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("place").alias("bp"), F.col("c").alias("bc"))
    enough = F.expr(f"{num + den} * (1 + least(an - ap, bn - bp)) >= {num} * (an + bn)")
    return a.join(b, "grp").where("a < b and ac <> bc").where(_fits("an", "bn", threshold)).where(enough).select("a", "b").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of one list shares with each of the other: their product, by ranges and dense blocks of n-grams."""
    out = np.zeros((len(left), len(right)), np.int64)
    ranges = 1 + sum(map(len, left)) // RANGE
    limits = [np.uint64(i * (1 << 64) // ranges) for i in range(ranges)]

    def part(sets: list[np.ndarray], i: int) -> tuple[np.ndarray, np.ndarray]:
        cuts = [(np.searchsorted(s, limits[i]), np.searchsorted(s, limits[i + 1]) if i + 1 < ranges else len(s)) for s in sets]
        return np.concatenate([s[x:y] for s, (x, y) in zip(sets, cuts)]), np.repeat(np.arange(len(sets)), [y - x for x, y in cuts])

    for i in range(ranges):
        (xs, x_of), (ys, y_of) = part(left, i), part(right, i)
        both = np.intersect1d(xs, ys)
        if left is right:
            grams, counts = np.unique(xs, return_counts=True)
            both = grams[counts > 1]
        for lo in range(0, len(both), CHUNK):
            block = both[lo : lo + CHUNK]
            dense = []
            for grams, of, rows in ((xs, x_of, len(left)), (ys, y_of, len(right))):
                at = np.minimum(np.searchsorted(block, grams), len(block) - 1)
                hit = block[at] == grams
                table = np.zeros((rows, len(block)), np.float32)  # counts up to CHUNK are exact
                table[of[hit], at[hit]] = 1
                dense.append(table)
            out += (dense[0] @ dense[1].T).astype(np.int64)
    if left is right:
        np.fill_diagonal(out, 0)
    return out


def mark_of(found: np.ndarray) -> bytes:
    """A bit for each value that a set's hashes have modulo a power of two, which is as large as the set asks for."""
    bits = np.zeros(max(8 * LEAST_MARK, 1 << (MARK_BITS * len(found) - 1).bit_length()), np.uint8)
    bits[(found & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(marks: list[bytes], width: int) -> np.ndarray:
    """Marks of at least so many bytes as the marks of the same sets that have just so many, a row each."""
    out = np.zeros((len(marks), width), np.uint8)
    sizes = np.array([len(m) for m in marks])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        same = np.frombuffer(b"".join([marks[k] for k in at.tolist()]), np.uint8)
        out[at] = np.bitwise_or.reduce(same.reshape(len(at), size // width, width), axis=1)
    return out


def candidates(tiles: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(grp, i, j, a, b, share): the pairs of each tile's nodes in different components that their marks allow a link.

    Each bit that one mark alone has stands for an n-gram that the other set lacks, so no link is lost; of marks of
    two lengths the longer is folded. ``tiles`` has (grp, i, j, own, node, c, prev, place, n, mark); nodes with the same n-gram
    before meet in that one, and so do those whose places leave too few n-grams for a link. ``share`` is the n-grams that a pair would move, of those of the tile. A tile of more pairs
    than nodes gives one row instead, with a null pair, for a product of its whole sets, so no tile gives more rows than it gets.
    """
    num, den = threshold

    def near(n: np.ndarray, mark: np.ndarray, width: np.ndarray, x: np.ndarray, y: np.ndarray, open_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Nodes of x and y by the shorter mark of two, and which of the open pairs may be linked."""
        for w in np.unique(width).tolist():
            fits = (width >= w) & (num * n <= den * n[width == w].max())
            fit_x, fit_y = np.flatnonzero(fits[x]), np.flatnonzero(fits[y])
            left = open_[np.ix_(fit_x, fit_y)]
            some_x, some_y = left.any(1), left.any(0)
            left, p, q = left[np.ix_(some_x, some_y)], x[fit_x[some_x]], y[fit_y[some_y]]
            if not len(p) or not len(q):
                continue
            one, two = folded([mark[k] for k in p.tolist()], w), folded([mark[k] for k in q.tolist()], w)
            both, size_p, size_q = np.zeros((len(p), len(q))), np.zeros(len(p)), np.zeros(len(q))
            for lo in range(0, w, CHUNK // 8):
                a, b = (np.unpackbits(m[:, lo : lo + CHUNK // 8], axis=1).astype(np.float32) for m in (one, two))
                both += a @ b.T
                size_p += a.sum(1)
                size_q += b.sum(1)
            most = np.minimum((n[p] - size_p)[:, None], (n[q] - size_q)[None, :]) + both
            yield p, q, left & ((num + den) * most >= num * (n[p][:, None] + n[q][None, :])) & (np.minimum(width[p][:, None], width[q][None, :]) == w)

    def tile(i: int, j: int, own: np.ndarray, node: np.ndarray, c: np.ndarray, prev: np.ndarray, first: np.ndarray, place: np.ndarray, n: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        width = np.array([len(m) for m in mark])
        ends = [np.zeros((0, 2), np.int64)]
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        open_ = (num + den) * (1 + np.minimum((n - place)[x][:, None], (n - place)[y][None, :])) >= num * (n[x][:, None] + n[y][None, :])
        open_ &= c[x][:, None] != c[y][None, :]
        open_ &= (prev[x][:, None] != prev[y][None, :]) | first[x][:, None]
        for p, q, close in near(n, mark, width, x, y, np.triu(open_, 1) if i == j else open_):
            at = np.argwhere(close)
            ends.append(np.stack((p[at[:, 0]], q[at[:, 1]]), axis=1))
        p, q = np.concatenate(ends).T
        return None if len(p) > len(node) else (np.minimum(node[p], node[q]), np.maximum(node[p], node[q]), (n[p] + n[q]) / n.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(parts: list[tuple]) -> pa.RecordBatch:
            keys, ends = [x[0] for x in parts], [x[1] for x in parts]
            sizes = [1 if e is None else len(e[0]) for e in ends]
            grp, i, j = (np.repeat(np.array([k[f] for k in keys], np.int64), sizes) for f in range(3))
            none = np.repeat([e is None for e in ends], sizes)
            a, b, share = (np.concatenate([np.zeros(1, kind) if e is None else e[f] for e in ends]) for f, kind in enumerate((np.int64, np.int64, np.float64)))
            return pa.RecordBatch.from_arrays([pa.array(grp), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(x, mask=none) for x in (a, b, share))], names=["grp", "i", "j", "a", "b", "share"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            prev = batch.column(6)
            new = [batch.column(f).to_numpy() for f in range(6)] + [prev.fill_null(0).to_numpy(), prev.is_null().to_numpy(zero_copy_only=False), batch.column(7).to_numpy(), batch.column(8).to_numpy()]
            new.append(np.array([*batch.column(9).to_pylist(), None], object)[:-1])
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            grp, i, j = held[:3]
            at = [0, *(np.flatnonzero((grp[1:] != grp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()]
            if len(at) > 1:  # the last tile may go on in the next batch
                yield given([((grp[lo], i[lo], j[lo]), tile(i[lo], j[lo], *(x[lo:hi] for x in held[3:]))) for lo, hi in zip(at, at[1:])])
            held = [x[at[-1] :] for x in held]
        if held is not None and len(held[0]):
            yield given([((held[0][0], held[1][0], held[2][0]), tile(held[1][0], held[2][0], *held[3:]))])

    dealt = tiles.select("grp", "i", "j", "own", "node", "c", "prev", "place", "n", "mark").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return dealt.mapInArrow(lean(run), "grp bigint, i int, j int, a bigint, b bigint, share double")


def product_links(members: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join nodes of one group, from (grp, m, size, node, c), by the product of their marks, then of their sets, in tasks.

    Two nodes with the same non-null ``prev``, if ``members`` has that too, meet in another group; so do two that ``place``,
    if it has that, puts too far on for a link. A pair that meets in
    several tiles belongs to one; a tile whose pairs would move more n-grams than it has is multiplied whole.
    A group of more than ``GROUP`` nodes or ``GROUP_GRAMS`` n-grams is dealt over blocks by the
    nodes' hashes, and each two blocks meet in a task of their own, so none holds a whole group.
    """
    num, den = threshold
    for name, value in (("prev", None), ("place", 1)):
        if name not in members.columns:
            members = members.withColumn(name, F.lit(value).cast("bigint"))
    blocks = F.greatest(F.ceil(F.col("m") / GROUP), F.ceil(F.col("size") / GROUP_GRAMS)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "c", "prev", F.col("place").cast("bigint").alias("place"))

    def run(tile: pa.Table) -> pa.Table:
        nodes, c, own = (tile.column(x).to_numpy() for x in ("node", "c", "own"))
        grams = [np.frombuffer(x.as_buffer(), "<u8") for x in tile.column("grams")]
        i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        left = [grams[k] for k in x]
        right = left if i == j else [grams[k] for k in y]
        links: tuple[list, list] = ([], [])
        if len(x) and len(y):
            n = np.array([len(g) for g in grams])
            linked = (num + den) * overlaps(left, right) >= num * (n[x][:, None] + n[y][None, :])
            linked &= c[x][:, None] != c[y][None, :]
            root: dict[int, int] = {}

            def top(v: int) -> int:
                while (up := root.get(v, v)) != v:
                    root[v] = root.get(up, up)
                    v = up
                return v

            for p, q in np.argwhere(linked).tolist():
                one, two = top(int(c[x[p]])), top(int(c[y[q]]))
                if one != two:
                    root[max(one, two)] = min(one, two)
                    links[0].append(int(nodes[x[p]]))
                    links[1].append(int(nodes[y[q]]))
        return pa.table([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64())], names=["a", "b"])

    near = cut(candidates(tiles.join(sets.select("node", "n", "mark"), "node"), threshold), "candidates")
    pairs = cut(near.where("a is not null").groupBy("a", "b").agg(F.min(F.struct("grp", "i", "j", "share")).alias("t")).select("a", "b", "t.*"), "pairs")
    full = pairs.groupBy("grp", "i", "j").agg(F.sum("share").alias("share")).where("share > 1").select("grp", "i", "j")
    full = cut(full.union(near.where("a is null").select("grp", "i", "j")), "full")
    links = verified(pairs.join(full, ["grp", "i", "j"], "left_anti").select("a", "b"), sets, threshold)
    whole = tiles.join(full, ["grp", "i", "j"], "left_semi")
    return links.union(whole.join(sets.select("node", "grams"), "node").groupBy("grp", "i", "j").applyInArrow(run, "a bigint, b bigint"))


def jaccard_join(docs: DataFrame, k: int = WORDS, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the size of its set, and the least id reachable by links.

    Null and wordless texts have an empty set and are linked with nothing, not even each
    other; fewer than ``k`` words are one shingle. Rows with equal sets are linked, rows
    with equal ids are rows of their own. A null id takes part in no link and has a null
    component. Other columns are not read; an empty table gives an empty table.
    """
    return _joined_rows(docs, k, threshold, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _joined_rows(docs: DataFrame, k: int, threshold: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, cluster, n_shingles, component_id) per row; ``cluster`` names its component, null without words."""
    require(docs, id_col, text_col)
    num, den = threshold
    if not 0 < num <= den:
        raise ValueError("the threshold is a share (numerator, denominator) over 0 and up to 1")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    rows = cut(describe_sets(texts, k), "sets")
    known = rows.where("node is not null and doc_id is not null")
    nodes = known.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("probe").alias("probe"))
    nodes = cut(nodes, "nodes")
    total = nodes.agg(F.sum("probe")).first()[0] or 0
    shared = shared_counts(texts.where("doc_id is not null"), k, max(LEAST_BLOCKS, math.ceil(total / BLOCK)))
    # a linked node may lack n - ceil(t n) n-grams of its partner's, so no more are its own alone
    linkable = nodes.join(shared, "node", "left").where(F.expr(f"probe - coalesce(shared, 0) <= n - ({num} * n + {den - 1}) div {den}"))
    linkable = cut(linkable.select("least", "node"), "linkable")
    few = linkable.count() <= BROADCAST_ROWS
    chosen = texts.join(F.broadcast(linkable) if few else linkable, texts.doc_id == linkable.least).select("node", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            keep = [(n, s) for n, s in zip(part.column(0).to_pylist(), sets) if len(s) and node_of(s) == n]
            columns = [pa.array([n for n, _ in keep], pa.int64()), pa.array([len(s) for _, s in keep], pa.int64()), *(pa.array([f(s) for _, s in keep], pa.binary()) for f in (np.ndarray.tobytes, mark_of))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "grams", "mark"])

    sets = cut(chosen.mapInArrow(lean(build), "node bigint, n bigint, grams binary, mark binary").dropDuplicates(["node"]), "linkable-sets")
    found = linked_components(sets, threshold)
    least = found.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("group_least"))
    named = nodes.select("node", "least").join(found, "node", "left").join(least, "component", "left").select("node", F.coalesce("component", "node").alias("cluster"), F.coalesce("group_least", "least").alias("component_id"))
    out = rows.join(named, "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "cluster", F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = WORDS, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of linked ones: that of the least id, and of the least text hash of that id.

    Rows are told apart by id and text, so where an id is repeated with other texts those stay.
    Of a row repeated with the same id and text one stays, any where other columns differ. Rows
    with a null id, a null text or no words are in no group and all stay. Columns may have any
    names; an empty table gives an empty table.
    """
    rows = cut_whole(docs.sparkSession, lambda: _joined_rows(docs, k, threshold, id_col, text_col).where("cluster is not null and doc_id is not null"), "joined-rows")
    same = rows.where("doc_id = component_id").groupBy("cluster", "doc_id").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last"))
    more = rows.join(same.where("first <> last"), ["cluster", "doc_id"]).where("text_hash <> first")
    gone = cut(rows.where("doc_id > component_id").select("doc_id", "text_hash").union(more.select("doc_id", "text_hash")).distinct(), "near-duplicates")
    again = cut(rows.where("doc_id = component_id").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_hash"), "repeated-rows")
    left = _matching(docs, gone, "left_anti", id_col, text_col)
    if again.isEmpty():
        return left
    return _matching(left, again, "left_anti", id_col, text_col).union(_matching(left, again, "left_semi", id_col, text_col).dropDuplicates([id_col, text_col]))


def _matching(docs: DataFrame, found: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` with or without their (id, hash of the text) in a table, which is broadcast if it is small."""
    i, h = fresh(docs.columns, "id", "hash")
    found = found.toDF(i, h)
    few = found.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(found) if few else found, (docs[id_col] == found[i]) & (F.xxhash64(docs[text_col]) == found[h]), how)


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Links all documents of similarity 0.75 or more on five-word shingles."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP10_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
both_have AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM both_have JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = w.doc_id
"""
