import hashlib
import math
import random
import zlib
from collections import defaultdict

from codeloom.llm import prefix_trie, registry

SCHEMA = "conv_id bigint, turn int, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def trie(convs):
    nodes, ended = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
        ended[tuple(turns)].append(c)
    children = defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, ms in nodes.items():
        own = (len(ms) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += p not in children
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ended[p]))).encode()).hexdigest()
    return sorted((min(ms), len(p), min(nodes[p[:-1]]) if p else -1, len(ms), children[p], leaves[p], saved[p], digest(p)) for p, ms in nodes.items())


def compare(spark, rows, extra=False):
    table = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("d", "a", "b", "part", "place", "rank", "n_convs", "chars", "h"):
            table = table.selectExpr("*", f"'x' AS {name}")
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(table))
    assert got.columns == COLUMNS
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got.collect()) == trie(rebuilt(rows))


def talks(rng, ids, most):
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice("pqé") * rng.randrange(3)) for c in ids for t in range(rng.randrange(most))]


def test_random_conversations(spark):
    rng = random.Random(1)
    compare(spark, talks(rng, range(350), 9), extra=True)


def test_bases_absent_or_short(spark):
    rng = random.Random(2)
    ids = [c for c in range(100, 400) if c not in (200,)]
    compare(spark, [r for r in talks(rng, ids, 8) if r[0] != 300 or r[1] < 2])


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (2, 3, "b", "t"), (2, 3, "a", "t"), (2, 3, "a", "s"), (7, 0, "", ""), (7, 0, "", ""), (0, 5, "é", "ü" * 3), (-5, 0, "u", "v"), (10**12 + 6, 1, "u", "w" * 200_000)]
    compare(spark, rows, extra=True)
    compare(spark, [])
    compare(spark, [(None, 1, "user", "lost")])


def test_only_turnless(spark):
    """Conversations whose turns are all dropped end at the root."""
    lone = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2]
    compare(spark, [(c, 0, "u", "gone") for c in lone])


def test_nested_chain(spark):
    """Each conversation is the beginning of the next: the compressed tree is as high as there are conversations."""
    turns = spark.createDataFrame([(c, 0, d, c % 1, 7 * d, 3) for c in range(1, 41) for d in range(1, c + 1)], "conv_id bigint, part int, d bigint, a bigint, b bigint, chars bigint")
    depths = spark.createDataFrame([(c, c) for c in range(1, 41)], "conv_id bigint, depth bigint")
    got = prefix_trie.prefix_trie(turns, depths).collect()
    texts = {c: [("r", f"{d:03}") for d in range(1, c + 1)] for c in range(1, 41)}
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == trie(texts)


def test_hot_conversation_and_copies(spark):
    """A conversation with a third of the turns, in several ranges of the sorted rows, and a hundred copies of another."""
    rng = random.Random(3)
    rows = [(5, t, "user", rng.choice("ab")) for t in range(1500)] + [(c, t, "user", "same") for c in range(1000, 1100) for t in range(7)] + talks(rng, range(200, 350), 9)
    rng.shuffle(rows)
    compare(spark, rows)


def test_many_ends_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 3)
    compare(spark, [(c, t, "user", "same") for c in range(600) for t in range(7)])


def test_query_matches_sql(against_sql):
    against_sql(registry.QUERIES["op12_conversation_prefix_trie"], registry.ORACLE_SQL["op12_conversation_prefix_trie"])


def test_query_by_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = registry.QUERIES["op12_conversation_prefix_trie"](spark, sf_dir)
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got.collect()) == trie(rebuilt(rows))
