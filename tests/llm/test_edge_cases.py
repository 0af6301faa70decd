"""All queries and the pipeline over odd rows: nulls, empty, wordless and long texts, repeated rows, odd columns, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from trialspark.llm import licenses
from trialspark.llm.queries import QUERIES

PASSAGE = " ".join(f"passage{i}" for i in range(40))
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [
    None, "", " \t\n", "!!! ???", "one", "one", "Ünïcode wörds äöü", PASSAGE, f"start {PASSAGE} end", f"start {PASSAGE} end", LONG, LONG + " tail",
    "Licensed under the Apache License, Version 2.0. You idiot.", "a a a a a a a a a a " * 8, "you 1d10t and m0r0n", "the quick brown fox jumps over the lazy dog near the river bank today",
]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("odd"))
    rows = [(k if k != 3 else None, t, ["en", "de", None][k % 3], ["s1", "s2", None][k % 3], len(t or ""), "clash", k, "x") for k, t in enumerate(TEXTS)]
    rows += [rows[7], rows[7], (5, "another text of the same id", "en", "s1", 27, "clash", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, size int, row string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(12)] + [(None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the river bank today"), (2, None), (3, ""), (None, "x y z"), (4, "one")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    html = "<p>" + "x" * 200 + "</p>"
    pages = [(1, "http://a", html), (2, None, html), (3, "u\r\nv", None), (4, "u", "WARC/1.0\r\nWARC-Type: response\r\n\r\nshort"), (5, "u", "é" * 100), (5, "u", "é" * 100), (None, "u", html)]
    turns = [(1, 0, "user", "hi."), (1, 0, "user", "hi."), (1, 1, None, "x"), (2, None, "assistant", None), (None, 1, "user", ""), (None, None, None, None)]
    spark.createDataFrame([(*t, "y") for t in turns], "conv_id long, turn long, role string, text string, _key string").write.parquet(f"{top}/conversations.parquet")
    spark.createDataFrame([(*p, "y") for p in pages], "page_id long, url string, html string, digest string").repartition(2).write.parquet(f"{top}/pages.parquet")
    return top


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{top}/{t}.parquet")
    return top


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_pipeline_of_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op3_warc", "op8_benchmark_leaks", "op9_token_counts", "op13_conversation_repair"}))
def test_a_row_for_each_odd_row(spark, odd_dir, name):
    ids = sorted(str(r.doc_id) for r in QUERIES[name](spark, odd_dir).collect())
    assert ids == sorted(str(r.doc_id) for r in spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id").collect())


def test_op1_takes_each_sources_target(spark, odd_dir):
    rows = QUERIES["op1_mix_sources"](spark, odd_dir).collect()
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 1 for t, n in by.values())


def test_op2_base_scan(spark, odd_dir):
    docs = {str(r.doc_id): r.text for r in spark.read.parquet(f"{odd_dir}/documents.parquet").filter("doc_id <> 5").collect()}
    for r in QUERIES["op2_licenses"](spark, odd_dir).filter("doc_id <> 5").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.phrases(docs[str(r.doc_id)], licenses.BASE)


def test_op3_pages(spark, odd_dir):
    out = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in QUERIES["op3_warc"](spark, odd_dir).collect()), key=str)
    assert out == sorted([(1, 207, "response", None), (2, 207, "revisit", 1), (3, 0, "response", None), (4, 38, "response", None), (5, 200, "response", None), (5, 200, "response", None), (None, 207, "revisit", 1)], key=str)


def test_op5_matches_brute_force(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").collect()
    told = sorted((str(d.doc_id), *x) for d, x in zip(docs, brute.repeats([d.text for d in docs], 35), strict=True))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_repeated_windows"](spark, odd_dir).collect()) == told


def test_op6_groups(spark, odd_dir):
    rows = QUERIES["op6_similar_documents"](spark, odd_dir).collect()
    of = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id != 5}
    told = brute.groups([(k, t) for k, t in enumerate(TEXTS) if k not in (3, 5)])
    assert {k: v for k, v in of.items() if k is not None} == told
    assert sorted((r.n_shingles, r.component_id) for r in rows if r.doc_id == 5) == [(1, 4), (2, 5)]


def test_op7_equal_texts_and_edits(spark, odd_dir):
    rows = QUERIES["op7_fingerprints"](spark, odd_dir).collect()
    prints = {}
    for r in rows:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[8] == prints[9] and prints[0] == {""} and len(prints[5]) == 2
    assert next(r for r in rows if r.doc_id == 9).near_next == 1.0


def test_op8_finds_the_item(spark, odd_dir):
    assert {(r.doc_id, r.item_id) for r in QUERIES["op8_benchmark_leaks"](spark, odd_dir).collect()} >= {(15, 1)}
    assert not {r.doc_id for r in QUERIES["op8_benchmark_leaks"](spark, odd_dir).filter("item_id = 1").collect()} - {15}


def test_op9_sections_tile_the_text(spark, odd_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{odd_dir}/documents.parquet").filter("doc_id <> 5 AND doc_id <> 7").collect()}
    by = {}
    for r in QUERIES["op9_token_counts"](spark, odd_dir).filter("doc_id <> 5 AND doc_id <> 7").orderBy("doc_id", "section").collect():
        by.setdefault(r.doc_id, []).append((r.char_start, r.char_end))
    assert set(by) == set(docs)
    for k, spans in by.items():
        assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]] and spans[0][0] == 0 and spans[-1][1] == len(docs[k])


def test_op10_unknown(spark, odd_dir):
    out = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op10_languages"](spark, odd_dir).collect()}
    assert out[0] == out[1] == out[2] == ("und", 0.0) and out[None] == ("und", 0.0)
    assert out[6][0] in ("en", "de")


def test_stages_keep_columns_and_clean_rows(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, odd_dir)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), before.schema)
        assert {r._key for r in docs.collect()} == {"clash"}
    ids = {r.doc_id for r in docs.collect()}
    assert {4, 6, 12, 14} <= ids and not {0, 1, 2, None, 9, 15} & ids
