"""The pipeline stage by stage against brute force, and figures of the fitted operators on the shared tables."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm.common import cut

from tests.llm.test_small_tables import brute_force_components

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows before each stage and after the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(cut(stage(spark, tables[-1], sf_dir), name))
    return [t.toPandas() for t in tables]


def test_columns_and_languages(stages):
    for table in stages[:-1]:
        assert list(table.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    kept, dropped = set(stages[1].doc_id), stages[0][~stages[0].doc_id.isin(stages[1].doc_id)]
    assert len(kept) >= 0.98 * len(stages[0]) and all(len(t.split()) < 5 for t in dropped.text)


def test_near_duplicates(stages):
    want = brute_force_components(list(zip(stages[1].doc_id, stages[1].text)))
    assert set(stages[2].doc_id) == {i for i, (_, c) in want.items() if i == c}


def test_passages(stages):
    """Of every 50 words that two documents share, at most the least document still has them."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in zip(stages[3].doc_id, stages[3].text)}
    owners = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            owners[tuple(w[k : k + 50])].add(i)
    assert all(len(o) == 1 for o in owners.values())
    before = dict(zip(stages[2].doc_id, stages[2].text))
    changed = [i for i, t in zip(stages[3].doc_id, stages[3].text) if t != before[i]]
    assert set(before) == set(words) and len(changed) < 0.2 * len(before)
    assert (stages[3].n_chars == stages[3].text.str.len()).all()


def test_packing(stages):
    packed = stages[4]
    assert set(packed.doc_id) == set(stages[3].doc_id)
    for _, rows in packed.sort_values("offset").groupby("sequence_id"):
        ends = rows.offset + rows.length
        assert list(rows.offset) == [0, *ends[:-1]] and ends.iloc[-1] <= 2048
    least = -(-int(packed.length.sum()) // 2048)
    assert packed.sequence_id.nunique() <= 1.03 * least + 1


def through(spark, docs):
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(cut(stage(spark, tables[-1], ""), name))
    return tables


def test_stages_on_odd_rows(spark):
    """Nulls everywhere, empty, wordless and very long texts, repeated rows and ids, clashing columns; an unlabelled and an empty table."""
    from tests.llm.test_small_tables import CLASHING

    source = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = [tuple(r) for r in source.where("doc_id < 300").collect()]
    long = " ".join(r[1] for r in rows if r[1] and r[2] == "en")
    first = next(r for r in rows if r[2] == "en" and len(r[1].split()) > 200)
    odd = [(None, first[1], "en", None, None), (1001, None, "en", "s", 0), (1002, "", None, "s", 0), (1003, " \n", "en", "s", 2), (1004, "12 34 !", "en", "s", 7), (1005, long, "en", "s", len(long)), first, first, (first[0], long + " the end", "en", "s", 1), (None, None, None, None, None)]
    schema = source.schema
    docs = spark.createDataFrame(rows + odd, schema)
    extra = [x.split() for x in CLASHING.split(", ")] + [["rejected", "int"], ["score", "int"], ["doc_id_", "int"]]
    extra = {n: t for n, t in extra if n not in docs.columns}
    wide = docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in extra.items()])
    tables = through(spark, wide)
    assert all(t.columns == wide.columns for t in tables[:-1])
    kept = [(r.doc_id, r.text) for r in tables[1].collect()]
    assert not {1001, 1002, 1003, 1004} & {i for i, _ in kept} and kept.count((first[0], first[1])) == 3 and (None, first[1]) in kept and (1005, long) in kept
    left = [(r.doc_id, r.text) for r in tables[2].collect()]
    assert left.count((first[0], first[1])) == 1 and (None, first[1]) in left and len(set(left)) == len(left)
    cleaned = tables[3].collect()
    assert len(cleaned) == len(left) and all(r.n_chars == len(r.text) for r in cleaned if (r.doc_id, r.text) not in left)
    assert {r.doc_id for r in tables[4].collect()} == {i for i, _ in left}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(repr, corpus_pipeline.language(spark, unlabelled, "").collect())) == sorted(map(repr, unlabelled.collect()))
    assert [t.count() for t in through(spark, docs.limit(0))] == [0] * 5


def test_run_is_the_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, stages[4][key].values))


def test_language_accuracy_on_held_out_documents(spark):
    from codeloom.llm.language import op2_language_identification

    truth = {r.doc_id: (r.lang, len(r.text)) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = op2_language_identification(spark, LARGER).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) >= 0.99


def test_texts_far_from_all_languages_are_rejected(spark):
    from codeloom.llm.language import identify_languages, learn_languages

    model = learn_languages(spark.read.parquet(f"{LARGER}/documents.parquet"))
    far = spark.createDataFrame([(1, "日本語の文章です"), (2, "Это русский текст"), (3, "zqxj kvwq xzkq jqvx wqzk")], "doc_id bigint, text string")
    assert [r.rejected for r in identify_languages(far, model).orderBy("doc_id").collect()] == [True, True, True]


def test_recall_of_nearest_neighbours(spark):
    from codeloom.llm.nearest import op8_nearest_neighbours

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    found = defaultdict(set)
    for r in op8_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        found[r.query_id].add(r.vec_id)
    hits = []
    for k in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[k]
        scores[k] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -scores))[:20]].tolist()) & found[ids[k]]) / 20)
    assert np.mean(hits) >= 0.95


def test_token_ids_match_the_library(spark):
    from array import array

    from tokenizers import Tokenizer

    from codeloom.llm.tokenization import PieceEncoder, tokenizer_path

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = np.random.default_rng(6)
    texts += ["".join(rng.choice(list("ab é'1.\n\t  ́\x1c\x85\0$ "), rng.integers(0, 14))) for _ in range(2000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(tokenizer_path(name))
        library.encode_special_tokens = True
        want = [array("I", e.ids).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        encoder = PieceEncoder(tokenizer_path(name), 5000)
        assert encoder.encode(texts) == want and encoder.encode(texts) == want


def test_pieces_of_latin_letters_go_through_the_library_joined():
    """Only pieces of other letters or with white space at their end go alone; all ids are the library's."""
    from array import array

    from tokenizers import Tokenizer

    from codeloom.llm.tokenization import PieceEncoder, tokenizer_path

    rng = np.random.default_rng(7)
    letters = list("abÈéßñçŉǰůĿŐƏɏ'.\nÉ$1sS")
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 9))) + "é" for _ in range(rng.integers(1, 40))) for _ in range(300)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(tokenizer_path(name))
        for more in ([], ["x İé Σé é́  é 中é ΑΣ Σ. ﬁé"]):
            encoder, alone = PieceEncoder(tokenizer_path(name), 50_000), []
            one = encoder._alone
            encoder._alone = lambda pieces: one(alone.extend(pieces) or pieces)
            want = [array("I", e.ids).tobytes() for e in library.encode_batch(texts + more, add_special_tokens=False)]
            assert encoder.encode(texts + more) == want
            assert more or not [p for p in alone if p[:1] == " "]
