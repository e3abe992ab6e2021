"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import registry

LONG = " ".join(f"w{i}" for i in range(3000))
TEXTS = [None, "", " ", "A.", "?!", LONG, LONG, LONG.upper(), "naïve  Straße x", "naïve strasse x", "\u0000a ▁b <|endoftext|>", "a b c d e", "A B C D E", "a b c d"]
CLASHING = "node string, component_id int, n int, sequence_id string, offset int, length string, rejected int, score string, rank int, r int, grp string, shard string, slot int, digest string, _text int, _letter int, _id string, _spans string, _gone int, id int, spans int, hash string, text_hash string, cluster int, salt string, base string, inner string, k0 string, _rank int, _base int, _inner int, _k0 int, letter int, key string, lang_pred int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t and i % 2 else None, "s") for i, t in enumerate(TEXTS)]
    rows += [(3, "A.", "en", "s"), (None, LONG, "en", "s"), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


@pytest.fixture(scope="module")
def wide(docs):
    """The same rows with columns whose names the operators use inside or return."""
    return docs.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in CLASHING.split(", ")])


def expected_texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_packing(spark, docs, wide):
    from tokenizers import Tokenizer

    from codeloom.llm.packing import best_fit_pack, tokenize_pieces
    from codeloom.llm.tokenization import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = tokenize_pieces(wide)
    packed = best_fit_pack(pieces).collect()
    assert len(packed) == pieces.count()
    whole = {}
    for r in sorted(packed, key=lambda r: r.piece):
        assert r.length == len(r.token_ids) // 4 <= 2048
        whole.setdefault((r.doc_id, r.piece == 0 and id(r)), []).append(r)
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in expected_texts(docs) if i is not None and t != LONG)
    got = sorted(np.frombuffer(r.token_ids, "<u4").tolist() for r in packed if r.doc_id is not None and r.doc_id not in (5, 6, 7))
    assert [w for w in want if len(w) <= 2048 and len(w) < 1500] == [g for g in got if len(g) < 1500]
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert best_fit_pack(tokenize_pieces(docs.limit(0))).count() == 0
    named = pieces.drop("token_ids").select("*", *[F.lit(i).alias(c) for i, c in enumerate(["_rank", "rank", "_base", "base", "_inner", "inner", "salt", "_salt", "n", "k0", "_k0"])])
    assert best_fit_pack(named).columns == [*named.columns, "sequence_id", "offset"] and best_fit_pack(named).count() == pieces.count()
    odd = spark.createDataFrame([(1, None), (2, 0), (3, 7), (3, 7)], "doc_id bigint, length bigint").withColumn("piece", F.lit(0))
    assert sorted((r.doc_id, r.offset) for r in best_fit_pack(odd).collect() if r.offset is not None) == [(3, 0), (3, 7)]
    with pytest.raises(ValueError):
        best_fit_pack(odd.withColumn("length", F.lit(4000).cast("bigint")))


def test_packing_solver_holds_every_piece():
    from collections import Counter

    from codeloom.llm.packing import solve

    rng = random.Random(5)
    for draw in (lambda: rng.randint(1, 64), lambda: rng.randint(20, 40), lambda: 33):
        histogram = Counter(draw() for _ in range(3000))
        chosen = solve(histogram, 64, 40)
        held = Counter()
        for times, parts in chosen:
            assert sum(parts) <= 64
            for x in parts:
                held[x] += times
        assert held == histogram
    exact = solve({21: 300, 43: 300}, 64, 40)  # pairs fill a sequence exactly
    assert sum(n for n, _ in exact) == 300


def test_language(spark, docs, wide):
    from codeloom.llm.language import identify_languages, learn_languages

    model = learn_languages(wide)
    found = identify_languages(wide, model).collect()
    assert len(found) == docs.count()
    for r in found:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred == "en" and 0 <= r.score <= 1
    nothing = learn_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in identify_languages(docs, nothing).collect()} == {"und"}
    assert identify_languages(docs.limit(0), model).count() == 0


def test_sharding(spark, docs, wide):
    from codeloom.llm.sharding import shard_documents

    rows = shard_documents(wide, 4).collect()
    assert len(rows) == docs.count()
    sizes = [[r.slot for r in rows if r.shard == s] for s in range(4)]
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes)
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in expected_texts(docs))
    third = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(300)], "doc_id bigint, text string")
    placed = shard_documents(third, 10).collect()
    assert len({r.shard for r in placed if r.doc_id % 3 == 0}) <= 5  # a group of 100 over shards of 30
    assert shard_documents(docs.limit(0)).count() == 0


def test_passages(spark, docs, wide):
    from codeloom.llm.passages import remove_passages, repeated_passages, without_words

    found = repeated_passages(wide)
    assert {(r.doc_id, r.start_word, r.n_words, r.kept_doc_id, r.cluster_id) for r in found.collect()} == {(6, 0, 3000, 5, 5), (7, 0, 3000, 5, 5)}
    cleaned = {r.doc_id: r.text for r in remove_passages(wide, found).collect()}
    assert cleaned[6] == cleaned[7] == "" and cleaned[5] == LONG and cleaned[0] is None
    assert remove_passages(wide, found).columns == wide.columns
    assert repeated_passages(docs.limit(0)).count() == 0
    assert without_words("a b\n c  d", [(1, 3)]) == "a d" and without_words("a b", [(0, 9)]) == "" and without_words("é  x", []) == "é  x"


@pytest.mark.parametrize("lead", [0, 1, 7, 40])
def test_embedded_passage_is_found(spark, lead):
    from codeloom.llm.passages import repeated_passages

    rng = random.Random(lead)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    shared, short = words(51), words(40)
    rows = [(i, " ".join([*words(lead + 13 * i), *shared, *words(5 + i)])) for i in range(3)] + [(10 + i, " ".join([*words(30), *short, *words(30)])) for i in range(2)]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.start_word, r.n_words, r.kept_doc_id) for r in found} == {(1, lead + 13, 51, 0), (2, lead + 26, 51, 0)}


def test_sentencepiece(spark, docs, wide):
    from codeloom.llm.sentencepieces import decode_pieces, encode_documents, piece_table
    from codeloom.llm.tokenization import tokenizer_path

    rows = encode_documents(wide, decode=True).collect()
    assert sorted(repr((r.doc_id, r.decoded)) for r in rows) == sorted(repr((i, t or "")) for i, t in expected_texts(docs))
    assert all(r.n_tokens == len(r.token_ids) // 4 for r in rows)
    table = piece_table(tokenizer_path("piece_bpe_32k.model"))
    assert decode_pieces(b"", table) == ""
    assert encode_documents(docs.limit(0)).count() == 0


def test_sentencepiece_matches_library():
    import struct

    from sentencepiece import SentencePieceProcessor

    from codeloom.llm.sentencepieces import UnigramEncoder, piece_table
    from codeloom.llm.tokenization import tokenizer_path

    path = tokenizer_path("piece_bpe_32k.model")
    table, model = piece_table(path), SentencePieceProcessor(model_file=path)

    def number(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    def part(field, data):
        return number(field << 3 | 2) + number(len(data)) + data

    proto = b""
    for i in range(model.get_piece_size()):
        kind = 6 if model.is_byte(i) else 2 if model.is_unknown(i) else 3 if model.is_control(i) else 1
        score = float(table.scores[i]) if kind == 1 else 0.0
        proto += part(1, part(1, model.id_to_piece(i).encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + number(3 << 3) + number(kind))
    proto += part(2, number(3 << 3) + number(1) + number(35 << 3) + number(1))
    proto += part(3, part(1, b"identity") + number(3 << 3) + number(1) + number(4 << 3) + number(0) + number(5 << 3) + number(1))
    library = SentencePieceProcessor(model_proto=proto)
    rng = random.Random(4)
    texts = ["", " ", "a  b ", "Hello world, this is tokenization.", "日本語 \U0001f600x", "x" * 200]
    texts += ["".join(rng.choice("ab é日\n\U0001f600zq.,") for _ in range(rng.randint(0, 25))) for _ in range(500)]
    cost = lambda ids: sum(float(table.scores[i]) if table.normal[i] else 0.0 for i in ids)
    for text, got in zip(texts, UnigramEncoder(table).encode(texts)):
        ids, want = np.frombuffer(got, "<u4").tolist(), library.encode(text)
        assert ids == want or (len(ids) == len(want) and abs(cost(ids) - cost(want)) < 1e-3), text  # equal scores may fall either way


def test_token_files(spark, docs, wide):
    from tokenizers import Tokenizer

    from codeloom.llm.common import shared_path
    from codeloom.llm.token_files import read_token_files, write_token_files
    from codeloom.llm.tokenization import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    folder = shared_path(spark, "files")
    rows = read_token_files(write_token_files(wide, folder, files=3), folder).collect()
    assert sorted(repr((r.doc_id, np.frombuffer(r.token_ids, "<u4").tolist())) for r in rows) == sorted(repr((i, [*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in expected_texts(docs))
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    empty = shared_path(spark, "files")
    assert read_token_files(write_token_files(docs.limit(0), empty), empty).count() == 0


def test_token_blocks_round_trip(tmp_path):
    import io

    from codeloom.llm.token_files import BLOCK, TokenFileReader, TokenFileWriter, decode_block, encode_block

    rng = np.random.default_rng(1)
    for ids in (np.zeros(1), np.full(7, 2**32 - 1), rng.integers(0, 2**32, BLOCK), np.concatenate((rng.integers(5, 900, 4000), rng.integers(0, 2**32, 20)))):
        ids = ids.astype(np.uint32)
        assert (decode_block(encode_block(ids)) == ids).all()

    class Kept(io.BytesIO):
        def close(self):
            self.data = self.getvalue()
            super().close()

    out = Kept()
    writer = TokenFileWriter(out)
    documents = [rng.integers(0, 49408, n).astype("<u4") for n in (0, 3, 5 * BLOCK + 1, 300 * BLOCK, 1)]
    for i, d in enumerate(documents):
        writer.add(None if i == 0 else i, d.tobytes())
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = TokenFileReader(Source(out.data))
    assert reader.doc_ids == [None, 1, 2, 3, 4]
    assert [b for b in reader.documents()] == [d.tobytes() for d in documents]
    assert all((reader.document(k) == documents[k]).all() for k in range(5))


def test_warc(spark):
    from codeloom.llm.common import shared_path
    from codeloom.llm.warc import assemble_transactions, plan_captures, read_archives, write_captures

    rows = [(1, "u", None), (2, "http://x/é\r\n q", "x" * 200), (3, None, "x" * 200), (3, None, "x" * 200), (2, "http://x/é\r\n q", "x" * 200), (None, "z", "x" * 200), (5, "a", "é" * 50), (6, "a", "é" * 49), (7, "a", "é" * 49), (8, "a", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("ordinal", F.lit("x"))
    folder = shared_path(spark, "warc")
    captures = assemble_transactions(read_archives(write_captures(plan_captures(pages), folder), folder)).collect()
    assert len(captures) == len(rows) and len({c.capture_id for c in captures}) == len(rows)
    got = sorted((c.metadata.strip() or "-", c.warc_type, len(c.response.payload)) for c in captures)
    assert got == sorted([("page_id: 1", "response", 0), ("page_id: 2", "response", 200), ("page_id: 2", "revisit", 0), ("page_id: 3", "revisit", 0), ("page_id: 3", "revisit", 0), ("-", "revisit", 0), ("page_id: 5", "response", 100), ("page_id: 6", "response", 98), ("page_id: 7", "response", 98), ("page_id: 8", "revisit", 0)])
    response = next(c.capture_id for c in captures if c.warc_type == "response" and c.metadata == "page_id: 2\r\n")
    assert {c.response.refers_to for c in captures if c.warc_type == "revisit" and c.response.payload_digest.endswith(hashlib.sha256(b"x" * 200).hexdigest())} == {response}
    assert all(c.request.startswith("GET /") for c in captures)
    empty = shared_path(spark, "warc")
    assert assemble_transactions(read_archives(write_captures(plan_captures(pages.limit(0)), empty), empty)).count() == 0


def test_nearest(spark):
    from codeloom.llm.nearest import nearest_neighbours

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 10))
    x[50:150] = x[50]  # many equal vectors
    rows = [(i, x[i].tolist()) for i in range(400)] + [(1000, None), (1001, [0.0] * 10), (1002, [float("nan")] * 10), (1003, [None] * 10), (1004, [1.0] * 3), (1005, [float("inf")] * 10), (None, [1.0] * 10), (7, x[7].tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0)).withColumn("block", F.lit(0))
    found = {}
    for r in nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 400, 20))
    hits = 0
    for q, got in found.items():
        exact = (x * x[q]).sum(1)
        best = [int(i) for i in np.lexsort((np.arange(400), -exact)) if i != q][:20]
        assert [r for r, *_ in sorted(got)] == list(range(1, 21))
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in got)
        hits += len(set(best) & {i for _, i, _ in got})
    assert hits >= 0.9 * 20 * len(found)
    few = nearest_neighbours(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert nearest_neighbours(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_fingerprints(spark, docs, wide):
    from codeloom.llm.fingerprints import canonical, compare_with_edits, digest, edit, split_collisions

    rows = compare_with_edits(wide).collect()
    assert len(rows) == docs.count()
    one = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    for r in compare_with_edits(one).collect():
        text, following = TEXTS[r.doc_id] or "", TEXTS[r.doc_id - 1] or ""
        changed = edit(text, following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (digest(text), digest(changed))
        assert (r.near_edited, r.near_next) == (float(digest(text) == digest(changed)), float(digest(text) == digest(following)))
    assert digest("naïve  Straße x") == digest("naïve strasse x") and digest(None) == digest("") == digest(" ")
    assert canonical("ﬁ A") == b"fi a" == unicodedata.normalize("NFKC", "fi a").encode()
    alone = compare_with_edits(one.where("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert compare_with_edits(docs.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "h", b"x"), (2, "h", b"y"), (3, "h", b"x"), (4, "g", b"z")], "doc_id bigint, fingerprint string, canonical binary")
    split = {r.doc_id: r.fingerprint for r in split_collisions(clash.select("doc_id", "fingerprint"), clash).collect()}
    assert split == {1: "h", 2: "h-2", 3: "h", 4: "g"}


def brute_force_components(texts, num=75, den=100):
    import re

    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(group[a], group[b])
            changed |= group[a] != m or group[b] != m
            group[a] = group[b] = m
    return {i: (len(sets[i]), group[i]) for i in ids}


def test_jaccard_join(spark, docs, wide):
    from codeloom.llm.ngram_join import drop_near_duplicates, jaccard_join

    rows = jaccard_join(wide).collect()
    assert len(rows) == docs.count()
    want = brute_force_components([(i, t) for i, t in enumerate(TEXTS)])
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    kept = drop_near_duplicates(wide)
    assert kept.columns == wide.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 13]
    again = [(1, "x y z", 1), (2, "x y z", 2), (2, "q r s", 3), (1, "X y z", 4), (2, "q r s", 5), (7, None, 6), (7, None, 7), (8, " ", 8), (8, " ", 8)]
    rows = drop_near_duplicates(spark.createDataFrame(again, "doc_id bigint, text string, hash int")).collect()
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in rows)) == [(1, "x y z"), (2, "q r s"), (7, ""), (7, ""), (8, " "), (8, " ")]
    assert jaccard_join(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard_join(docs, threshold=(0, 100))


def test_tables_on_the_way_are_deleted_before_the_next_stage(spark, wide):
    from pathlib import Path

    import corpus_pipeline
    from codeloom.llm import common

    for stage, kept in ((corpus_pipeline.near_duplicates, {"joined-rows", "near-duplicates", "repeated-rows"}), (corpus_pipeline.passages, {"repeated-passages"})):
        made = set(common._made)
        out = stage(spark, wide, "")
        new = {p.rsplit("/", 1)[1] for p in set(common._made) - made}
        assert new and {p.rsplit("-", 1)[0] for p in new} <= kept
        there = {p.name for p in Path(common.shared_dir(spark).removeprefix("file://")).iterdir()} - {p.rsplit("/", 1)[1] for p in made}
        assert new <= there and not {p for p in there if p.rsplit("-", 1)[0] in ("sets", "nodes", "linkable-sets", "passage-words", "met-in-slices")} - {p.rsplit("/", 1)[1] for p in made}
        assert out.count() > 0


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_join_on_chains_and_edits(spark, seed):
    """Groups whose members are linked only through others, and edits near the threshold."""
    from codeloom.llm.ngram_join import jaccard_join

    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(10**6)}"
    texts, shared = [], [word() for _ in range(60)]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(8, 120))]
        for _ in range(12):
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join([*base, *(shared if rng.random() < 0.3 else [])]))
    texts += [" ".join([*shared, *(word() for _ in range(12))]) for _ in range(15)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_force_components(rows)


@pytest.mark.parametrize("few,group,grams,depth", [(16, 512, 10**6, 8), (2, 12, 10**6, 8), (2, 12, 1500, 1), (0, 0, 900, 0)])
def test_jaccard_join_on_common_lines(spark, monkeypatch, few, group, grams, depth):
    """Texts of few lines out of many that all share: split groups, products and their blocks all give the same."""
    from codeloom.llm import ngram_join

    for name, value in (("FEW", few), ("GROUP", max(group, 1)), ("GROUP_GRAMS", grams), ("DEPTH", depth), ("ROUNDS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(few + depth)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([20, 30]))) for _ in range(10)]
    chosen = [rng.sample(lines, rng.choice([4, 5])) for _ in range(150)]
    texts = ["\n".join(x) for x in chosen] + ["\n".join([*x, *rng.sample(lines, 1)]) for x in chosen[:30]] + [" ".join([*x[0].split(), *(f"o{i}-{j}" for j in range(8))]) for i, x in enumerate(chosen[:40])]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_force_components(rows)


def test_products_move_marks_and_not_whole_sets_of_unlike_texts(spark, monkeypatch):
    """A group of texts that share a line: no whole set of those that cannot be linked is moved; near ones are found, and groups of many near ones too."""
    from codeloom.llm import ngram_join

    rng = np.random.default_rng(4)
    line = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    sets = [np.unique(np.concatenate([line, rng.integers(0, 1 << 63, 80).astype(np.uint64)])) for _ in range(60)]
    sets.append(np.unique(np.concatenate([sets[0][5:], rng.integers(0, 1 << 63, 5).astype(np.uint64)])))
    base = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    alike = [np.unique(np.concatenate([base[rng.permutation(100)[:97]], rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for _ in range(40)]
    rows = [(k, len(x), bytearray(x.tobytes()), bytearray(ngram_join.mark_of(x))) for k, x in enumerate([*sets, *alike])]
    table = spark.createDataFrame(rows, "node bigint, n bigint, grams binary, mark binary")
    members = table.select(F.when(F.col("node") < len(sets), 1).otherwise(2).cast("bigint").alias("grp"), F.lit(100).cast("bigint").alias("m"), F.lit(10_000).cast("bigint").alias("size"), "node", F.col("node").alias("c"))
    seen, cut = {}, ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df, name: seen.setdefault(name, cut(df, name)))
    got = {(min(r), max(r)) for r in map(tuple, ngram_join.product_links(members, table, (75, 100)).collect())}
    linked = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (i < len(sets)) == (j < len(sets)) and 175 * len(np.intersect1d([*sets, *alike][i], [*sets, *alike][j])) >= 75 * (rows[i][1] + rows[j][1])}
    assert got <= linked and (0, 60) in got and len(linked) > 100
    assert {r.grp for r in seen["candidates"].where("a is null").collect()} == {2}
    assert {(r.a, r.b) for r in seen["candidates"].where("a is not null").collect()} == {(0, 60)}
    top = {k: k for k in range(len(rows))}
    for a, b in sorted(got):
        top = {k: top[a] if v == top[b] else v for k, v in top.items()}
    assert len({top[k] for k in range(len(sets), len(rows))}) == 1


@pytest.mark.parametrize("few,whole,depth", [(2, 12, 8), (2, 12, 1)])
def test_jaccard_join_where_groups_are_split_or_are_too_dense_for_it(spark, monkeypatch, few, whole, depth):
    """Families that share many n-grams and hardly any link: split groups and those multiplied once give the same."""
    from codeloom.llm import ngram_join

    for name, value in (("FEW", few), ("WHOLE", whole), ("GROUP", 16), ("DEPTH", depth), ("ROUNDS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    rng, word = random.Random(whole), lambda: f"w{rng.randrange(10**6)}"
    lines = [" ".join(word() for _ in range(rng.choice([20, 30]))) for _ in range(10)]
    texts = ["\n".join(rng.sample(lines, rng.choice([4, 5]))) for _ in range(60)]
    for _ in range(2):
        base = [word() for _ in range(100)]
        for k in range(50):
            texts.append(" ".join(w if rng.random() < 0.95 or k < 3 else word() for w in base))
    texts += [" ".join([*x.split()[3:], *(word() for _ in range(rng.randint(1, 9)))]) for x in texts[:20] + texts[60:90]]
    rows, dense = list(enumerate(texts)), []
    cut = ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df, name: (out := cut(df, name), dense.append(out.count()) if name == "dense" else None)[0])
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_force_components(rows)
    assert sum(dense) > 0


def test_marks_grow_with_the_sets_and_pairs_that_meet_in_many_groups_are_compared_once(spark, monkeypatch):
    """Large sets of a line alike: marks tell them apart, other lengths too; a pair of many groups is one pair."""
    from codeloom.llm import ngram_join

    rng = np.random.default_rng(5)
    some = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    line = some(20)
    sets = [np.unique(np.concatenate([line, some(n)])) for n in [1500] * 30 + [1000, 1030] * 15]
    near = [np.unique(np.concatenate([sets[k][: len(sets[k]) - cut], some(more)])) for k, cut, more in ((0, 60, 0), (30, 0, 60), (31, 200, 0))]
    rows = [(k, len(x), bytearray(x.tobytes()), bytearray(ngram_join.mark_of(x))) for k, x in enumerate([*sets, *near])]
    table = spark.createDataFrame(rows, "node bigint, n bigint, grams binary, mark binary")
    members = table.select(F.explode(F.expr("sequence(1L, 40L)")).alias("grp"), F.lit(len(rows)).alias("m"), F.lit(80_000).cast("bigint").alias("size"), "node", F.col("node").alias("c"))
    members = members.withColumn("prev", F.when(F.col("grp") > 20, F.col("grp") - 1))
    seen, cut = {}, ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df, name: seen.setdefault(name, cut(df, name)))
    got = sorted((min(r), max(r)) for r in map(tuple, ngram_join.product_links(members, table, (75, 100)).collect()))
    assert got == [(0, 60), (30, 61), (31, 62)]
    assert {(r.a, r.b) for r in seen["candidates"].collect()} == set(got)
    assert seen["candidates"].where("grp > 20").count() == 0 and seen["candidates"].count() == 60


def test_near_copies_without_links_make_no_pairs(spark, monkeypatch):
    """Many edits of one text, too far from each other for a link, longer ones too: few pairs are compared, and no link is lost."""
    from codeloom.llm import ngram_join

    rng = random.Random(7)
    base, texts = [f"b{k}" for k in range(150)], []
    for k in range(240):
        words = [*base, *(f"l{j}" for j in range(rng.choice([0, 0, 0, 2, 25])))]
        for at in rng.sample(range(2, 148), 4):
            words[at] = f"e{k}-{at}"
        texts.append(" ".join(words))
    rows = [*enumerate([*texts, *(" ".join(["o", *x.split()[3:]]) for x in texts[::40])])]
    seen, cut = [], ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df, name: (out := cut(df, name), seen.append(out.where("a is not null").count()) if name == "candidates" else None)[0])
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_force_components(rows)
    assert sum(seen) <= len(rows)


def test_overlaps_by_ranges_and_blocks(monkeypatch):
    from codeloom.llm import ngram_join

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 64, 400, np.uint64)
    sets = [np.unique(rng.choice(pool, k)) for k in (0, 1, 40, 200, 399)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    for span, chunk in ((10**6, 4096), (50, 7)):
        monkeypatch.setattr(ngram_join, "RANGE", span)
        monkeypatch.setattr(ngram_join, "CHUNK", chunk)
        assert ngram_join.overlaps(sets, sets[1:]).tolist() == [w[1:] for w in want]
        own = ngram_join.overlaps(sets, sets)
        assert own.tolist() == [[0 if i == j else w for j, w in enumerate(row)] for i, row in enumerate(want)]


def test_components(spark):
    from codeloom.llm.common import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(20)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{50 + i: 50 for i in range(20)}, 100: 50}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(name, against_sql):
    against_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_intermediates_can_be_discarded(spark, tmp_path):
    from codeloom.llm import common

    table = common.cut(spark.range(5).toDF("x"), "kept")
    path = common._made[-1].removeprefix("file://")
    assert table.count() == 5
    import os

    assert os.path.isdir(path)
    before, common._made[:] = common._made[:-1], common._made[-1:]
    common.discard_intermediates(spark)
    common._made[:] = before
    assert not os.path.isdir(path)
