"""Importance resampling, the Merkle manifest and personal data against plain versions of their definitions."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import common, decontaminate, importance, lm_score, merkle, ngram_jaccard, pii

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# 11


def grams(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def resampled(docs, aims, n, buckets, share, least, seed=2024):
    crc = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(crc(g) for x in texts for g in grams(x, n)[1]) for texts in ([d for _, d in docs], aims))
    total = lambda c: float(sum(c.values()) + buckets)
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * total(s) / (float(s[b] + 1) * total(t))))
    out = []
    for i, text in docs:
        w, f = grams(text, n)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(crc(g)) for g in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: share * len(enough) // 100]):
        r[4] = k + 1
    return sorted((r[:5] for r in out), key=repr)


def rows_of(df):
    return sorted((list(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_follows_its_definition(spark, n):
    texts = [None, "", "a b a b a b", "A-b'c d 12 é É", "the cat sat on the mat " * 9, "x " * 50, "only the mat"]
    docs = [(i, texts[i % 7]) for i in range(40)] + [(3, texts[3])] * 5 + [(None, texts[4]), (None, None)]
    aims = ["the mat", None, "a b c", ""]
    table = spark.createDataFrame([(i, t, 1.5, "z") for i, t in docs], "doc_id long, text string, weight double, buckets string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in aims], "text string")
    got = importance.resample(table, aim, n=n, buckets=50, share=40, min_words=3)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == resampled(docs, aims, n, 50, 40, 3)


def test_resampling_of_empty_tables(spark):
    docs, aim = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance.resample(docs, aim).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert rows_of(importance.resample(some, aim, share=100, min_words=1)) == resampled([(1, "a b c")], [], 1, 10_000, 100, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .é", max_size=60), min_size=1, max_size=5), st.integers(1, 5), st.integers(1, 30))
def test_suffix_array_runs_find_every_gram(texts, n, most):
    pieces = [(i, p) for i, t in enumerate(texts) for p in importance.pieces(t, most, n)]
    got = [Counter() for _ in texts]
    for (i, _), b in zip(pieces, importance.segment_buckets([p for _, p in pieces], n, 997)):
        got[i].update(b.tolist())
    assert got == [Counter(zlib.crc32(g.encode()) % 997 for g in grams(t, n)[1]) for t in texts]


def test_grams_are_hashed_once_a_run(monkeypatch):
    seen = []
    real = zlib.crc32
    monkeypatch.setattr(importance.zlib, "crc32", lambda b: seen.append(b) or real(b))
    importance.segment_buckets([(0, ["a", "b"] * 500)] * 4, 2, 100)
    assert sorted(seen) == [b"a", b"a b", b"b", b"b a"]


def test_ranks_of_one_repeated_row_span_ranges(spark):
    docs = spark.createDataFrame([(7, "w " * 30)] * 400, "doc_id long, text string").repartition(5)
    got = importance.resample(docs, spark.createDataFrame([("w",)], "text string"), share=50)
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 201))


# 12


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes, fanout):
    """Root, and each node's steps (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            first = a - a % fanout
            run = nodes[first : first + fanout]
            paths[i].append(("".join(run[: a - first]), "".join(run[a - first + 1 :])))
        nodes, at = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)], [a // fanout for a in at]
    return nodes[0], paths


def plain_manifest(rows, fanout):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(enc(r[k]) for k in (0, 3, 2, 4, 1)))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]], fanout) for g in names}
    root, above = tree([trees[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, above):
        for r, path in zip(groups[g], trees[g][1]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            d = leaf((r[0], re.sub("[A-Z]", lambda m: m.group().lower(), r[1]), *r[2:])) if bad else leaf(r)
            for left, right in path + up:
                d = sha(left + d + right)
            out.append([r[0], leaf(r), trees[g][0], root, sha("".join(a + b for a, b in path + up)), d, d == root])
    return sorted(out, key=repr)


def test_manifest_follows_its_definition(spark, monkeypatch):
    sizes = {None: 3, "": 1, "a": 16, "B": 17, "é": 33, "hot": 300}
    rows, n = [], 0
    for source, k in sizes.items():
        for _ in range(k):
            rows.append((n * 7 % 1000, None if n % 11 == 0 else f"Text {n} É\n" * (n % 4), None if n % 5 else "en", source, n if n % 3 else None))
            n += 1
    rows += [rows[40]] * 20 + [(None, "A", None, "a", None), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", grp string, place int").repartition(4)
    want = plain_manifest(rows, 16)
    assert rows_of(merkle.verified(docs)) == want
    real = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda d, c, **k: real(d, c, depth=1, **k))  # several rounds of blocks
    assert rows_of(merkle.verified(docs)) == want


def test_manifest_of_one_row_and_of_none(spark):
    one = (5, "A", "en", "s", 1)
    got = rows_of(merkle.verified(spark.createDataFrame([one], SCHEMA)))
    assert got == plain_manifest([one], 16) and got[0][4] == sha("") and got[0][1] == got[0][2] == got[0][3]
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).count() == 0


def test_proofs_of_other_fanouts(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source"))
    out = merkle.manifest(docs, ["doc_id", "text"], fanout=3, depth=2)
    leaves = [sha(f"{len(str(i))}:{i}{len(str(i)) + 1}:t{i}") for i in range(50)]
    root, paths = tree(leaves, 3)
    for r in out.collect():
        assert r["root"] == root and [tuple(s) for s in r["path"]] == paths[r["doc_id"]]
    assert out.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


# 13


def plain_base(text):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            odd, even = d[-1::-2], d[-2::-2]
            check = sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 12 <= len(d) <= 19 and check % 10 == 0 or k == 3 and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("a@.-+%_ 1", max_size=40), st.text("0123456789.+ ()-", max_size=60), st.text("04 -", min_size=12, max_size=30), st.text("é٣a1@. ", max_size=20)))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_base_of_every_document(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs)).collect()}
    for i, text in texts.items():
        own = plain_base(text)
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in own)
        assert got[i]["base_sha256"] == sha(said) and [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(k == j for _, j, _ in own) for k in range(4)]
        assert set(filter(None, said.split(","))) <= set(got[i]["spans"].split(","))


@pytest.mark.parametrize("text", ["9" * 2_000_000, "1 " * 1_000_000, "a" * 2_000_000, "a@" * 500_000, "+1(" * 500_000, "at a.b " * 200_000, "1.1." * 300_000])
def test_long_texts_take_time_in_proportion(text):
    start = time.time()
    pii.base_spans(text)
    assert sum(1 for _ in pii.candidates(text)) <= 40 * len(text) and time.time() - start < 60


def planted(rng, n):
    """Texts with personal data in plain forms, numbers that are none, and words."""
    word = lambda: "".join(rng.choice(list("aeiounrstlmd"), rng.integers(2, 8)))
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out = []
    for i in range(n):
        card = "4" + digits(14)
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        things = [f"{word()}.{word()}@{word()}.{'mail.' * (i % 2)}com", ".".join(str(v) for v in rng.integers(1, 256, 4)), card, f"+1 ({digits(3)}) 555-{digits(4)}", f"order {digits(9)} of {word()} at {word()}. The", f"{digits(4)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(2)}.{digits(1)}"]
        out.append(" ".join(x for k in range(6) for x in (word(), word(), things[(i + k * 3) % 7] if k < 3 else word())))
    return out


def test_trees_find_other_forms_and_leave_clean_texts(spark):
    rng = np.random.default_rng(3)
    hidden = ["jane.doe at mail dot example dot com", "sid[at]post.org", "10[.]20[.]30[.]40", "4556.7375.8689.9855", "0015551234567 ext", "call (499) 555-6503 now"]
    clean = ["the cat sat at home. The dog 12 of 1999-10-11 left", "v1.22.3 and order 123456789 of ten at noon. It", "plain words only " * 20]
    rows = [(i, t) for i, t in enumerate(planted(rng, 600))] + [(1000 + i, f"some words {t} more words") for i, t in enumerate(hidden)] + [(2000 + i, t) for i, t in enumerate(clean)]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    hits = [found[1000 + i]["added"] for i in range(6)]
    assert sum(bool(h) for h in hits[:4]) >= 3
    assert all(not found[2000 + i]["added"] and not found[2000 + i]["base"] for i in range(3))
    assert found[1000]["redacted"] == "some words [EMAIL] more words"
    wrong = [r["added"] for i, r in found.items() if i < 600 and r["added"]]
    assert len(wrong) <= 6
    for r in found.values():
        spans = sorted((s["start"], s["end"]) for s in r["added"])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert not any(s["start"] < b["end"] and b["start"] < s["end"] for s in r["added"] for b in r["base"])


def test_trees_and_their_calibration():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 3, 3000), rng.normal(size=3000)])
    y = ((x[:, 0] > 0.3) & (x[:, 1] == 1)).astype(float)
    m = pii.fit(x, y, np.arange(3000) % 4)
    p = m.probability(x)
    assert ((p > 0.5) == y).mean() > 0.995 and p[y == 1].mean() > 0.95 and (np.diff(m.p) >= 0).all()
    noise = pii.fit(x, rng.integers(0, 2, 3000).astype(float), np.arange(3000) % 4)
    assert 0.3 < noise.probability(x).mean() < 0.7 and noise.probability(x).max() < 0.95
    same = pii.fit(np.zeros((60, 2)), np.r_[np.zeros(30), np.ones(30)], np.arange(60) % 4)
    assert np.allclose(same.probability(np.zeros((1, 2))), 30 / 62)


def test_personal_data_edges(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a@b.co", "z"), (2, "é😀 a@b.co 1.2.3.4", "w"), (2, "é😀 a@b.co 1.2.3.4", "w")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string, base string"))
    got = sorted((list(r) for r in pii.digest(found).collect()), key=repr)
    assert [r[0] for r in got] == [1, 1, 2, 2, None] and got[2] == got[3] and got[2][-1] == "email:3:9,ip:10:17" and got[0][-1] == "" and got[0][5] == sha("")
    assert sorted(str(r["redacted"]) for r in found.collect()) == ["", "None", "[EMAIL]", "é😀 [EMAIL] [IP]", "é😀 [EMAIL] [IP]"]
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pii.redacted("abcdef", [(1, 3, 4), (2, 2, 5)]) == "a[PHONE]f"


# Hot keys of the earlier operators


def test_repeats_of_one_document_are_sent_once(spark, monkeypatch):
    """A document repeated 20,000 times beside a near copy: one text a task reaches the join, one the bucket."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
    docs = rows.unionByName(spark.createDataFrame([(9, text + " more"), (11, "other words of no interest here at all")], "doc_id long, text string"))
    sent = []
    real = ngram_jaccard.blocked
    monkeypatch.setattr(ngram_jaccard, "blocked", lambda df, *a: sent.append(df.groupBy("bucket").count().agg(F.max("count")).first()[0]) or real(df, *a))
    got = ngram_jaccard.near_duplicates(docs)
    by = {r["doc_id"]: (r["class_id"], r["n_links"], r["n"]) for r in got.groupBy("doc_id", "class_id", "n_links").agg(F.count("*").alias("n")).collect()}
    assert by == {7: (7, 20_000, 20_000), 9: (7, 20_000, 1), 11: (11, 0, 1)} and sent == [2]
    assert common.once_a_task(docs, "doc_id").count() <= 4 + 2 + 4


def test_a_phrase_of_all_documents_and_items_makes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    word = lambda n: " ".join("w" + str(v) for v in rng.integers(0, 10**9, n))
    phrase = "one two three four five"
    items = [(k, f"{word(30)} {phrase} {word(30)}") for k in range(40)]
    docs = [(i, f"{word(20)} {phrase} {word(20)}") for i in range(200)] + [(1000, word(9) + " " + items[3][1]), (1001, items[5][1]), (1001, items[5][1])]
    stored, sizes = decontaminate.stored, {}

    def spy(df, name):
        out = stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(decontaminate, "stored", spy)
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    large = decontaminate.contaminated(table, bench, max_shared_chars=0)
    assert sorted((r["doc_id"], r["item_id"]) for r in large.collect()) == [(1000, 3), (1001, 5), (1001, 5)] and sizes["pairs"] == 2
    assert sorted(map(str, large.collect())) == sorted(map(str, decontaminate.contaminated(table, bench).collect()))


def test_mixture_weights_stay_below_one():
    m = lm_score.expectation_maximisation(np.full(20, 3), np.ones(20), np.full(20, 1e-9), np.ones(20), 1e-4)
    assert 0.9 < m.bigram[3] < 1 and m.unigram < 1


def test_languages_learn_from_every_text(spark, monkeypatch):
    """Models and bounds come from all texts, not from 500 kB a language: rates equal those of a plain model of every
    taught text, in one model and over many models and parts of models."""
    from barloom.llm import language_id

    rng = np.random.default_rng(5)
    words = {lang: ["".join(rng.choice(list(letters), 6)) for _ in range(3000)] for lang, letters in (("a", "abcdefgh"), ("b", "efghijkl"), ("c", "ijklmnop"))}
    rows = [(i, " ".join(rng.choice(words["abc"[i % 3]][: 30 * (i // 3 + 1)], 2500 if i % 3 < 2 else 50)), "abc"[i % 3]) for i in range(300)]
    d = spark.createDataFrame([*rows, *rows[:2], (900, None, "a"), (901, "", "b"), (902, "12", "d"), (903, "abc ijk", None)], "doc_id long, text string, lang string").repartition(5)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    taught, unseen = {}, {}
    for i, t, lang in [*rows, *rows[:2], (902, "12", "d")]:
        (unseen if held(i) else taught).setdefault(lang, []).append(t)
    assert sum(map(len, taught["a"])) > 1_000_000
    m = language_id.train(taught)
    cost = {t: c for t, c in zip([r[1] for r in rows], language_id.code_lengths(m, [r[1] for r in rows]))}
    bound = {lang: 1.02 * np.median([cost[t][m.languages.index(lang)] / len(t) for t in unseen[lang]]) for lang in "abc"}
    for room in (language_id.MODEL_BYTES, 90_000):
        monkeypatch.setattr(language_id, "MODEL_BYTES", room)
        got = {r["doc_id"]: r for r in language_id.identify(d, times=1.02).collect()}
        assert len(got) == 304 and got[900]["lang_pred"] == got[901]["lang_pred"] == got[902]["lang_pred"] == "und"
        for i, t, lang in rows:
            rate = cost[t].min() / len(t)
            assert got[i]["lang_pred"] == m.languages[cost[t].argmin()] and got[i]["bits_per_byte"] == pytest.approx(rate, rel=1e-9)
            assert got[i]["fits"] == (rate <= bound[got[i]["lang_pred"]] + 64 / len(t))
        assert len({r["fits"] for r in got.values()}) == 2


def test_merge_arcs_are_weighed_late():
    """The search weighs an arc only when no open one reaches farther, and finds the path of the sweep by position."""
    from barloom.llm import sentencepiece_fst

    m = sentencepiece_fst.Transducer(sentencepiece_fst.read_model(sentencepiece_fst.MODEL))
    assert len(m.shortest_path("▁the")) == 1 and m.rows.held == 1
    rng = np.random.default_rng(3)
    for k in range(2000):
        s = "".join(rng.choice(list("aeinorst▁▁thé語😀.,!\n01"), rng.integers(1, 60)))
        assert m.shortest_path(s) == m._swept(s)
