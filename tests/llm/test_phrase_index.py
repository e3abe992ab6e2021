import hashlib
import random
import re

from codeloom.llm import registry
from codeloom.llm.phrase_index import build_index, contamination, keyed, numbered_phrases, phrase_matches, phrases, proximity_matches, term_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def judged(text, items, size):
    w, hit, found = split(text), set(), set()
    for item_id, said in items:
        q = split(said)
        n = min(size, len(q))
        for s in range(len(q) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == q[s : s + n]:
                    hit |= set(range(p, p + n))
                    found |= {str(item_id)} - {"None"}
    return len(w), len(hit), len(found), sorted(found), bool(hit)


def compare(spark, docs, items, size=10, id_type="bigint", item_type="bigint"):
    table = spark.createDataFrame([(*d, 0, "x", 1) for d in docs], f"doc_id {id_type}, text string, a int, term string, pos int")
    asked = spark.createDataFrame([(*i, 7, "y") for i in items], f"item_id {item_type}, text string, pid int, phrase string")
    got = contamination(table, asked, size).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *judged(t, items, size))) for i, t in docs)


def drawn(rng, n, words="a b c d e f".split()):
    return " ".join(rng.choice(words) for _ in range(n))


def test_few_words_many_overlaps(spark):
    rng = random.Random(3)
    items = [(i, drawn(rng, rng.choice([1, 2, 3, 4, 6, 9]))) for i in range(12)]
    docs = [(i, drawn(rng, rng.randrange(60))) for i in range(40)]
    compare(spark, docs, items, 4)


def test_planted_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(50)]
    items = [(i, drawn(rng, rng.randrange(10, 40), vocabulary)) for i in range(10)]
    docs = []
    for i in range(30):
        words = drawn(rng, 200, vocabulary).split()
        if i % 3 == 0:
            q = items[i % 10][1].split()
            k = rng.randrange(8, len(q)) if len(q) > 8 else len(q)
            at = rng.randrange(len(words))
            words[at:at] = q[-k:]
        docs.append((i, " ".join(words)))
    compare(spark, docs, items)


def test_odd_rows(spark):
    ten = "One, two;three FOUR five\nsix seven_eight Éa ten"
    items = [(1, ten), (2, None), (3, ""), (4, "... !"), (None, "alone"), (5, "One two"), (5, "ten"), (6, "One two"), (1, ten), (7, "never said")]
    docs = [(1, "x " + ten.upper().replace("É", "é") + " y"), (1, "x " + ten + " y"), (2, None), (3, ""), (4, "?!"), (None, "alone"), (None, None), (None, "alone"), (5, "one two one two alone"), (5, "one two one two alone"), (6, "éA TEN ten")]
    compare(spark, docs, items)
    compare(spark, [("p", "a b c"), ("q", "b c"), (None, "a")], [("u", "B, c"), ("é", "a"), ("u,v", "c")], 2, "string", "string")


def test_empty_tables(spark):
    compare(spark, [], [(1, "a b")])
    compare(spark, [(1, "a b")], [])
    compare(spark, [], [])


def test_very_long_text(spark):
    said = " ".join(f"q{i}" for i in range(12))
    long = " ".join(f"w{i % 5000}" for i in range(300_000)) + " " + said
    compare(spark, [(1, long), (2, said), (3, said[:20])], [(1, said)])


def test_common_text_and_common_item(spark):
    """Many equal rows, many items of one text: a row for each, all alike."""
    said = "k l m n o p q r s t u"
    compare(spark, [(i % 3, said + " v") for i in range(300)], [(i, said) for i in range(40)])


def test_number_of_lists_changes_nothing(spark):
    rng = random.Random(5)
    docs = keyed(spark.createDataFrame([(i, drawn(rng, 80)) for i in range(20)], "doc_id int, text string"))
    listed, _ = numbered_phrases(phrases(spark.createDataFrame([(i, drawn(rng, 6)) for i in range(9)], "item_id int, text string"), 4))
    found = [sorted(map(tuple, phrase_matches(docs, listed, lists).collect())) for lists in (1, 2, 3, 9)]
    assert found[0] and all(f == found[0] for f in found)


def test_proximity(spark):
    rng = random.Random(6)
    texts, asked = [drawn(rng, 60, "a b c d e f g h".split()) for _ in range(15)], [drawn(rng, n, "a b c d e f g h".split()) for n in (1, 2, 2, 3, 4, 5)] + ["a z", "z"]
    docs = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    key = {(r.a, r.b): r.id for r in docs.collect()}
    queries = spark.createDataFrame([(i, q.split()) for i, q in enumerate(asked)], "pid bigint, phrase array<string>")
    for span in (1, 4, 7):
        got = {(r.pid, key[r.a, r.b], r.start) for r in proximity_matches(build_index(docs), queries, span).collect()}
        want = set()
        for p, q in enumerate(asked):
            for d, text in enumerate(texts):
                w = text.split()
                want |= {(p, d, s) for s in range(len(w)) if w[s] in q.split() and set(q.split()) <= set(w[s : s + span])}
        assert got == want


def test_index_holds_every_posting_of_its_terms(spark):
    docs = keyed(spark.createDataFrame([(1, "b A b"), (2, "c"), (3, None)], "doc_id int, text string"))
    ids = {(r.a, r.b): r.id for r in docs.collect()}
    rows = lambda df: sorted((r.term, ids[r.a, r.b], r.pos) for r in df.collect())
    assert rows(build_index(docs)) == [("a", 1, 1), ("b", 1, 0), ("b", 1, 2), ("c", 2, 0)]
    terms = spark.createDataFrame([("b",), ("z",)], "term string")
    assert rows(build_index(docs, terms)) == [("b", 1, 0), ("b", 1, 2)]
    assert [tuple(r) for r in term_counts(docs, terms).collect()] == [("b", 2)]


def test_query_matches_sql(against_sql):
    against_sql(registry.QUERIES["op11_benchmark_decontamination"], registry.ORACLE_SQL["op11_benchmark_decontamination"])


def test_query_by_brute_force(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {}
    for i, said in items:
        q = split(said)
        for s in range(max(len(q) - 9, 1)):
            windows.setdefault(tuple(q[s : s + 10]), set()).add(str(i))
    want = {}
    for d, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        w, hit, found = split(text), set(), set()
        for p in range(len(w)):
            if tuple(w[p : p + 10]) in windows:
                hit |= set(range(p, min(p + 10, len(w))))
                found |= windows[tuple(w[p : p + 10])]
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    got = registry.QUERIES["op11_benchmark_decontamination"](spark, sf_dir).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)
    assert 0 < sum(r.contaminated for r in got) < len(got)
