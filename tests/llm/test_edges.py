"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from barloom.llm import decontaminate, embedding_dedup, language_id, line_dedup, lm_score, ngram_jaccard, sentencepiece_fst, token_count, toxicity, url_filter

LONG = "word and another word of a very long text " * 3000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, ids string, rep long"


def docs(spark, empty=False):
    rows = [
        (1, "Hello world, this is a text with some words in it.", "en"), (2, None, "en"), (3, "", None), (4, "   \n\t ", "en"), (5, "12345 %%% !!!", "de"), (6, LONG, "en"), (7, LONG, "en"),
        (8, "Hello world, this is a text with some words in it.", "fr"), (8, "Hello world, this is a text with some words in it.", "fr"), (None, "A text without an id but with a good number of words.", "en"), (9, "x", None),
        (10, "日本語 😀 \u0000 é", "ja"),
    ]
    rows = [] if empty else rows
    return spark.createDataFrame([(*r, "s", 1, 0.5, "h", "i", 7) for r in rows], SCHEMA).repartition(2)


def benchmark(spark):
    return spark.createDataFrame([(1, "a very long text word and another word of"), (2, None), (3, ""), (None, "x y z"), (4, "two words")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, 0, None), (8, 1, 0), (8, 1, 1), (10, 1, 1)], "doc_id long, quality int, toxic int")


#: Degenerate texts: a run of spaces, a word without a break, one word again and again, one long line of signs.
HUGE = {"spaces": " " * 2_000_000, "unbroken": "x7Qfé" * 400_000, "repeated": "la " * 200_000, "signs": "#" * 1_000_000}

OPERATORS = {
    "tokens": lambda s, d: token_count.count_tokens(d), "lm": lambda s, d: lm_score.score_documents(d), "pieces": lambda s, d: sentencepiece_fst.encode_documents(d, decoded=True),
    "toxicity": lambda s, d: toxicity.classify(d, labels(s)), "jaccard": lambda s, d: ngram_jaccard.near_duplicates(d), "tiling": lambda s, d: decontaminate.with_hits(d, benchmark(s)),
    "tiling_joined": lambda s, d: decontaminate.with_hits(d, benchmark(s), max_shared_chars=0), "lines": lambda s, d: line_dedup.dedup_lines(d), "language": lambda s, d: language_id.identify(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    rows = OPERATORS[name](spark, docs(spark)).collect()
    assert len(rows) >= 12 if name == "tokens" else len(rows) == 12
    assert OPERATORS[name](spark, docs(spark, empty=True)).collect() == []


@pytest.mark.parametrize("kind", HUGE)
@pytest.mark.parametrize("name", OPERATORS)
def test_huge_text(spark, name, kind):
    d = spark.createDataFrame([(1, HUGE[kind], "en", "s"), (2, "A short text of some words.", "en", "s")], "doc_id long, text string, lang string, source string")
    rows = OPERATORS[name](spark, d).collect()
    if name == "pieces":
        assert {r["doc_id"]: r["decoded"] for r in rows}[1] == HUGE[kind]
    if name == "tokens":
        assert max(r["end"] for r in rows if r["doc_id"] == 1) == len(HUGE[kind]) + 5
    assert {r["doc_id"] for r in rows} == {1, 2}


def test_repeated_words_against_a_benchmark_of_them(spark):
    d = spark.createDataFrame([(1, HUGE["repeated"])], "doc_id long, text string")
    b = spark.createDataFrame([(7, "la " * 400), (8, "la la la lo " * 100)], "item_id long, text string")
    for most in (32_000_000, 0):
        (r,) = decontaminate.with_hits(d, b, max_shared_chars=most).collect()
        assert [(h["item_id"], h["coverage"], h["n_tiles"]) for h in r["hits"]] == [(7, 1.0, 1)]


def test_defined_results(spark):
    d = docs(spark)
    lang = {r["doc_id"]: r for r in language_id.identify(d).collect()}
    assert {k for k, r in lang.items() if r["lang_pred"] == "und"} == {2, 3, 4, 5} and lang[2]["score"] == 0 and all(0 <= r["score"] <= 1 for r in lang.values())
    near = {r["doc_id"]: r for r in ngram_jaccard.near_duplicates(d).collect()}
    assert (near[6]["class_id"], near[7]["class_id"], near[7]["kept"]) == (6, 6, False)
    assert near[1]["n_links"] == 2 and near[8]["text_id"] == 1 and near[None]["kept"] and near[None]["n_links"] == 0 and all(near[k]["n_links"] == 0 and near[k]["kept"] for k in (2, 3, 4, 9))
    hits = {r["doc_id"]: r["hits"] for r in decontaminate.with_hits(d, benchmark(spark)).collect()}
    assert [h["item_id"] for h in hits[6]] == [1] and hits[6][0]["coverage"] == 1 and hits[2] == [] and hits[1] == []
    text = {r["doc_id"]: r for r in sentencepiece_fst.encode_documents(d, decoded=True).collect()}
    assert text[2]["ids"] == [] and text[2]["decoded"] == "" and text[10]["decoded"] == "日本語 😀 \u0000 é" and text[10]["n_byte_pieces"] > 0
    lm = {r["doc_id"]: r for r in lm_score.score_documents(d).collect()}
    assert lm[2]["n_tokens"] == lm[3]["n_tokens"] == lm[4]["n_tokens"] == 1 and lm[6]["n_tokens"] == 27001
    kept = {r["doc_id"]: r for r in line_dedup.dedup_lines(d).collect()}
    assert kept[2]["n_lines"] == 1 and kept[2]["kept"] == "" and kept[4]["n_lines"] == 2
    tox = toxicity.classify(d, labels(spark).limit(0)).collect()
    assert not any(r["toxic"] for r in tox)


def test_urls(spark):
    schema = "page_id long, url string, html string, host string, verdict int"
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "<a href='http://X.org/'>"), (4, "http://Sub.Example.org/es/a?q#f", None), (4, "http://Sub.Example.org/es/a?q#f", None), (5, "http://h.com", ""), (6, "a://b://c/d", None)]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame([(*r, "h", 1) for r in rows], schema)).collect()}
    assert got[1]["host"] == got[3]["host"] == "" and got[1]["verdict"] == "allow" and got[1]["rule"] is None
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("sub.example.org", "/es/a", "example.org/es/", "block")
    assert got[5]["path"] == "" and got[6]["host"] == "b:" and got[6]["path"] == "//c/d"
    assert url_filter.filter_urls(spark.createDataFrame([], schema)).collect() == []


def test_vectors(spark):
    v = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 0.0, 0.0, 0.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0] * 4, 1), (8, [1.0, None, 0.0, 0.0], 1), (9, [float("nan"), 0.0, 0.0, 1.0], 1), (10, [], 1), (None, v, 1), (11, [1.0, 0.0], 1)]
    schema = "vec_id long, embedding array<float>, label int"
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame([(*r, 5) for r in rows], schema + ", rep long")).collect()}
    assert {k: r["n_links"] for k, r in got.items()} == {1: 3, 2: 3, 3: 3, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 0, None: 0, 11: 0}
    assert got[3]["component_id"] == 1 and not got[3]["kept"] and got[None]["kept"]
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage(spark, tmp_path, stage):
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    d = docs(spark)
    out = stage[1](spark, d, str(tmp_path))
    rows = out.collect()
    ids = sorted((r["doc_id"] for r in rows), key=str)
    want = {"language_id": [1, 10, 6, 7, 8, 8, 9, None], "ngram_jaccard": [1, 10, 2, 3, 4, 5, 6, 9, None], "decontamination": [1, 10, 2, 3, 4, 5, 8, 8, 9, None]}
    if stage[0] in want:
        assert set(ids) <= set(want[stage[0]]) if stage[0] == "language_id" else ids == want[stage[0]]
    else:
        assert len(ids) == 12
    if stage[0] != "sentencepiece":
        assert out.columns == d.columns
    else:
        assert all(r["round_trip"] for r in rows)
    assert stage[1](spark, docs(spark, empty=True), str(tmp_path)).collect() == []
    assert all(r["source"] == "s" and r["rep"] == 7 for r in rows)
