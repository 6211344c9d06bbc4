"""Every operator against a plain version of the same definition."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from barloom.llm import common, decontaminate, embedding_dedup, language_id, line_dedup, lm_score, ngram_jaccard, registry, sentencepiece_fst, token_count, toxicity, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def duck(sql, **tables):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, df in tables.items():
        c.execute(f"drop view if exists {name}")
        c.register(name, df)
    return sorted(map(repr, c.execute(f"select {', '.join(sorted(x[0] for x in c.execute(sql).description))} from ({sql})").fetchall()))


def plain(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", registry.ORACLES)
def test_against_sql(spark, name):
    assert plain(registry.QUERIES[name](spark, SF)) == duck(registry.ORACLES[name])


def test_entry_has_every_query():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


# 1


def test_links_spread_trust_and_distrust(spark):
    link = lambda *hosts: " ".join(f'<a href="https://{h}/x">' for h in hosts)
    rows = [
        (1, "http://good.org/a", link("friend.net", "friend.net", "good.org")), (2, "http://friend.net/", link("far.net")), (3, "http://far.net/", ""),
        (4, "http://bad.com/de/x", link("friend.net")), (5, "http://spam.net/", link("bad.com", "bad.com")), (6, "http://farm.net/", link("spam.net", "Bad.com:80")), (7, "http://alone.net/", "<a href='/in'>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = url_filter.filter_urls(pages)
    got = {r["page_id"]: r for r in out.collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow"}
    assert plain(out) == duck(url_filter.oracle(), pages=pages.toPandas())
    ranks = {}
    edges = {"allow": [("good.org", "friend.net", 2), ("friend.net", "far.net", 1), ("bad.com", "friend.net", 1), ("spam.net", "bad.com", 2), ("farm.net", "spam.net", 1), ("farm.net", "bad.com:80", 1)]}
    edges["block"] = [(b, a, w) for a, b, w in edges["allow"]]
    for kind, seed in (("allow", "good.org"), ("block", "bad.com")):
        r = {seed: 1.0}
        for _ in range(10):
            new, lost = defaultdict(float), 0.0
            for h, m in r.items():
                outs = [(b, w) for a, b, w in edges[kind] if a == h]
                for b, w in outs:
                    new[b] += 0.85 * m * w / sum(w for _, w in outs)
                lost += 0 if outs else m
            new[seed] += 0.15 + 0.85 * lost
            r = new
        ranks[kind] = r
    for r in got.values():
        worse = ranks["block"].get(r["host"], 0) > ranks["allow"].get(r["host"], 0)
        assert r["host_verdict"] == ("block" if worse else "allow")


def test_distrust_reaches_far_hosts(spark):
    link = lambda k: f"<a href='http://h{k + 1}.net/'>"
    rows = [(k, f"http://h{k}.net/", link(k)) for k in range(14)] + [(14, "http://h14.net/", "<a href='http://bad.com/'>"), (15, "http://bad.com/de/x", ""), (16, "http://apart.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages).collect()}
    assert got == {k: "allow" if k == 16 else "block" for k in range(17)}


def test_a_chain_of_1500_hosts_gets_verdicts(spark):
    """The walk ends with the mass that still moves, however long a path is."""
    rows = [(k, f"http://h{k}.net/", f"<a href='http://{f'h{k + 1}.net' if k < 1499 else 'bad.com'}/'>") for k in range(1500)] + [(1500, "http://bad.com/de/x", "")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 1501 and all(got[k] == "block" for k in range(1430, 1501)) and got[0] == "allow"


def test_many_blocked_hosts_are_joined_by_salt(spark):
    rows = [(k, f"http://{'bad.com/de' if k % 3 else f'h{k}.net'}/{k}", "<a href='http://bad.com/'>" if k % 2 else None) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    small, large = (plain(url_filter.filter_urls(pages, p=url_filter.Spread(most_broadcast=n, tolerance=0.1))) for n in (1000, 0))
    assert small == large and len(large) == 60


# 2


def test_tokens_of_sections(docs, texts):
    enc, size = token_count.encoder(token_count.read_ranks(token_count.VOCABULARY))
    rows = token_count.count_tokens(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    full = {r["doc_id"]: f"{r['source']} {r['lang']} {r['text']}" for r in docs.collect()}
    for i, parts in by.items():
        parts.sort(key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in parts) == len(enc.encode_ordinary(full[i])) and parts[-1]["end"] == len(full[i])
        assert [r["field"] for r in parts[:2]] == ["source", "lang"] and len(parts) == 3 + texts[i].count("\n")
    for i, parts in by.items():
        tokens_by_character(enc, size, full[i], parts)


def tokens_by_character(enc, size, text, parts):
    """Every token takes the characters that it has a byte of; it goes to the section with most of them."""
    char = [k for k, c in enumerate(text) for _ in c.encode()]
    edges, want, cross, at = [0, *(r["end"] for r in parts)], Counter(), Counter(), 0
    where = [k for k, (a, b) in enumerate(zip(edges, edges[1:])) for _ in range(a, b)]
    for t in enc.encode_ordinary(text):
        own = Counter(where[c] for c in sorted({*char[at : at + size[t]]}))
        best = min(k for k, n in own.items() if n == max(own.values()))
        want[best] += 1
        cross[best] += len(own) > 1
        at += size[t]
    assert at == len(char) and [(want[k], cross[k]) for k in range(len(parts))] == [(r["n_tokens"], r["n_crossing"]) for r in parts]


def test_multi_byte_tokens_over_edges(spark):
    enc, size = token_count.encoder(token_count.read_ranks(token_count.VOCABULARY))
    rows = [(1, "ñ日", "😀é", "日本語\n語ñ\n\n\n  \n😀😀\n…"), (2, "é", "", "\u3000\u3000\n\u2003é\r\n\r\n\t\t\tende\n\n")]
    split = lambda values: [(k, v[a : a + 1]) for k, v in enumerate(values) for a in range(len(v))] or [(0, "")]
    for how in ({}, {"split": split}):
        by = defaultdict(list)
        for r in token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), **how).collect():
            by[r["doc_id"]].append(r)
        for i, *values in rows:
            text = "".join(values) if how else " ".join(values)
            tokens_by_character(enc, size, text, sorted(by[i], key=lambda r: r["section"]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "\u2003", " " * 9, "\n" * 8, "a", "日", "1", "!"]), max_size=30))
def test_long_runs_of_space_give_the_same_tokens(parts):
    enc, _ = token_count.encoder(token_count.read_ranks(token_count.VOCABULARY))
    text, kept = "".join(parts), token_count._long_run
    try:
        token_count._long_run = re.compile(f"[{token_count.SPACES}]{{3,}}")
        assert token_count.encode(enc, text) == enc.encode_ordinary(text)
    finally:
        token_count._long_run = kept


@pytest.mark.parametrize("rule,owner", [("first", [0, 0, 1]), ("last", [0, 1, 1]), ("majority", [0, 0, 1])])
def test_boundary_rules(rule, owner):
    got, crossing = token_count.attribute(np.array([0, 2, 6]), np.array([2, 6, 8]), np.array([4, 8]), rule)
    assert got.tolist() == owner and crossing.tolist() == [False, True, False]


# 3


def test_language_model(spark, docs, texts):
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs, chunk_tokens=3000, part_keys=4000).collect()}
    tok = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + ["</s>"] for i, t in texts.items()}
    pairs = {i: list(zip(["<s>", *w[:-1]], w)) for i, w in tok.items()}

    def count(keep):
        return Counter(w for i in tok if keep(i) for w in tok[i]), Counter(p for i in tok if keep(i) for p in pairs[i]), sum(map(keep, tok))

    uni, bi, texts_ = count(lambda i: fold(i, 7) != 2)
    rest, rest2, rest_texts = count(lambda i: fold(i, 7) not in (2, 5))
    n, v = sum(uni.values()), len(uni)
    events = [(rest_texts if a == "<s>" else rest[a], rest2[a, b], rest[b]) for i in tok if fold(i, 7) == 5 for a, b in pairs[i]]
    c, c2, c1 = np.array(events, float).T
    m = lm_score.expectation_maximisation(lm_score.bucket(c), np.where(c > 0, c2 / np.maximum(c, 1), 0), c1 / sum(rest.values()), np.ones(len(c)), 1 / (len(rest) + 1))
    for i, words in tok.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (fold(i, 7) == 2, len(words), n) and r["n_known"] == sum(uni[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        s = 0.0
        for a, b in pairs[i]:
            ctx = texts_ if a == "<s>" else uni[a]
            lam = m.bigram[lm_score.bucket(np.array([ctx]))[0]]
            s += math.log10((lam * bi[a, b] / ctx if ctx else 0) + (1 - lam) * (m.unigram * uni[b] / n + (1 - m.unigram) / (v + 1)))
        assert r["score"] == pytest.approx(s, abs=2e-3 * len(words))  # the weights come from a grid of estimates
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_mixture_weights_find_the_source():
    rng = np.random.default_rng(0)
    take = rng.random(20000) < 0.7
    m = lm_score.expectation_maximisation(np.full(20000, 3), np.where(take, 0.9, 0.0), np.full(20000, 1e-3), np.ones(20000), 1e-4)
    assert m.bigram[3] == pytest.approx(0.7, abs=0.02) and m.bigram[0] == 0 and m.bigram[10] == m.bigram[3]


# 4


@pytest.fixture(scope="module")
def machine():
    return sentencepiece_fst.Transducer(sentencepiece_fst.read_model(sentencepiece_fst.MODEL)), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("aehintos .,'\n  ▁éñ日😀0-_²")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_pieces_equal_the_library(machine, s):
    m, lib = machine
    assert m.encode(s).tolist() == lib.encode(s) and m.decode(lib.encode(s)) == lib.decode(lib.encode(s))


def test_documents_equal_the_library(machine, spark, docs, texts):
    m, lib = machine
    for r in sentencepiece_fst.decode_documents(sentencepiece_fst.encode_documents(docs, decoded=True), to="again").collect():
        assert r["ids"] == lib.encode(texts[r["doc_id"]]) and r["decoded"] == r["again"] == texts[r["doc_id"]]


def test_pair_rule_is_merging(machine):
    m, _ = machine
    rng = np.random.default_rng(1)
    pieces = sorted(p for p in m.stands if sentencepiece_fst.MARK not in p and len(p) < 7)
    for a, b in zip(rng.choice(pieces, 3000), rng.choice(pieces, 3000)):
        assert m._follows(str(a), str(b)) == (m._merged(str(a) + str(b)) == [a, b])


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value]) if number < 16 else bytes([(number << 3) & 127 | 128, number >> 4, value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def test_unigram_model_equals_the_library():
    words = [("<unk>", 0.0, 2), ("▁", -3.0, 1), *((c, -4.0 - k / 7, 1) for k, c in enumerate("abcd")), ("ab", -5.1, 1), ("abc", -6.3, 1), ("bcd", -5.7, 1), ("▁a", -4.4, 1), ("cd", -5.2, 1)]
    pieces = b"".join(_message((1, _message((1, w.encode()), (2, s), (3, k)))) for w, s, k in words)
    model = pieces + _message((2, _message((3, 1), (4, len(words)), (40, 0))), (3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    m = sentencepiece_fst.Transducer(model)
    for s in ("abcd", "a bcdabc ab", "dcba", "  abcabcd", "abxd", "abxyzd x y", "xx"):
        assert m.encode(s).tolist() == lib.encode(s)
    block, text = sentencepiece_fst.BLOCK, "abcdcabbcda bcd" * 40
    try:
        sentencepiece_fst.BLOCK = 16
        assert m.encode(text).tolist() == lib.encode(text)
    finally:
        sentencepiece_fst.BLOCK = block


def test_squeezing_normaliser():
    for s in ("", " ", "   ", "a", " a", "a ", "  a  b c   ", "a▁ b"):
        short = re.sub(" +", " ", s.strip(" "))
        for prefix in (True, False):
            assert sentencepiece_fst.Normaliser(prefix, True)(s) == ("▁" if prefix and short else "") + short.replace(" ", "▁")
            assert sentencepiece_fst.Normaliser(prefix, False)(s) == ("▁" if prefix and s else "") + s.replace(" ", "▁")


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aeinst▁.é日")), min_size=1, max_size=12))
def test_path_is_the_least_of_all(machine, s):
    """All paths of the lattice, weighed one by one."""
    m, _ = machine

    def paths(at, memory, cost, labels):
        if at == len(s):
            yield cost, labels
        for size, label in m.arcs(s, at) if at < len(s) else ():
            w = m.weight(memory, label)
            if w < math.inf:
                yield from paths(at + size, label, cost + w, [*labels, label])

    found = list(paths(0, sentencepiece_fst.START, 0.0, []))
    assert len(found) == 1 and m.shortest_path(s) == m._swept(s) == found[0][1]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(list("aehintos.é日")), min_size=30, max_size=200))
def test_sweep_in_blocks(machine, s):
    m, lib = machine
    block = sentencepiece_fst.BLOCK
    try:
        sentencepiece_fst.BLOCK = 8
        assert np.frombuffer(m._ids("▁" + s), np.int32).tolist() == lib.encode(s)
    finally:
        sentencepiece_fst.BLOCK = block


# 5


def test_toxicity_on_held_out_labels(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learn, test = labels.where("doc_id % 3 > 0"), {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 3 = 0").collect()}
    rows = [r for r in toxicity.classify(d, learn).collect() if r["doc_id"] in test]
    hit = sum(r["toxic"] and test[r["doc_id"]] for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.9 and hit / sum(test.values()) > 0.85


def test_chain_uses_earlier_category():
    rng = np.random.default_rng(2)
    a = rng.random(600) < 0.5
    b = np.where(rng.random(600) < 0.9, a, ~a)
    texts_ = [("alpha " if x else "omega ") + " ".join(f"w{k}" for k in rng.integers(0, 50, 5)) for x in a]
    chain = toxicity.train(texts_, np.stack([a, b], 1), ["first", "second"])
    assert chain.earlier[0].size == 0 and chain.earlier[1].size == 1
    p = np.array([chain.probabilities(t) for t in texts_])
    assert ((p[:, 0] > 0.5) == a).mean() > 0.99 and ((p[:, 1] > 0.5) == a).mean() > 0.99


def plain_fit(x, y, penalty, steps=6000):
    """Proximal gradient on a dense matrix whose last column is constant."""
    w = np.zeros(x.shape[1])
    rate = 4 * len(y) / np.linalg.norm(x, 2) ** 2
    for _ in range(steps):
        w = w - rate * x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * penalty, 0)
    return w


def test_chain_against_dense_models(spark):
    """The same chain from dense matrices: folds, out-of-fold probabilities, thresholds, all through the query's path."""
    rng = np.random.default_rng(5)
    a, b = rng.random(160) < 0.4, rng.random(160) < 0.5
    texts_ = [" ".join([*(["bad"] if x and rng.random() < 0.8 else ["good"]), *(["vile"] if x and y else []), *(f"w{k}" for k in rng.integers(0, 12, 6))]) for x, y in zip(a, b)]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not x), int(x and y)) for i, (x, y) in enumerate(zip(a, b))], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels, ["quality", "toxic"], 5000, 12_000_000)
    assert len(rows) == 160
    order = [r["text"] for r in rows]
    words = sorted(w for w, n in Counter(w for t in order for w in toxicity.features(t)).items() if n >= 4)
    x = np.array([[w in toxicity.features(t) for w in words] for t in order], float)
    y = np.array([[r["quality"] == 0, r["toxic"] == 1] for r in rows], float)
    first: dict = {}
    fold_of = np.array([first.setdefault(t, i % 5) for i, t in enumerate(order)])
    prob = lambda m, w: 1 / (1 + np.exp(-m @ w))
    before, models, cuts = np.zeros((160, 0)), [], []
    for k in range(2):
        m = np.hstack([x, before, np.ones((160, 1))])
        models.append(plain_fit(m, y[:, k], 3e-3))
        out = np.zeros(160)
        for f in range(5):
            test = fold_of == f
            out[test] = prob(m[test], plain_fit(m[~test], y[~test, k], 3e-3))
        before = np.hstack([before, out[:, None]])
        f1 = {t: 2 * y[out >= t, k].sum() / ((out >= t).sum() + y[:, k].sum()) for t in out}
        cuts.append(max(f1.values()))
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels, penalty=3e-3).collect()}
    chain = toxicity.train(order, y > 0, ["low_quality", "toxic"], penalty=3e-3)
    for i, t in enumerate(texts_):
        m = np.array([[w in toxicity.features(t) for w in words]], float)
        p1 = prob(np.hstack([m, [[1.0]]]), models[0])[0]
        p2 = prob(np.hstack([m, [[p1]], [[1.0]]]), models[1])[0]
        assert (got[i]["p_low_quality"], got[i]["p_toxic"]) == (pytest.approx(p1, abs=0.03), pytest.approx(p2, abs=0.03))
        assert [got[i]["p_low_quality"], got[i]["p_toxic"]] == pytest.approx(chain.probabilities(t), abs=1e-9)
        assert got[i]["toxic"] == (got[i]["p_toxic"] >= chain.threshold[1])
    for k in range(2):
        yes = before[:, k] >= chain.threshold[k]
        assert 2 * y[yes, k].sum() / (yes.sum() + y[:, k].sum()) > cuts[k] - 0.03


def test_fit_is_the_optimum():
    """At the optimum of an L1 model no gradient exceeds the penalty, and it equals it where a weight is not 0."""
    rng = np.random.default_rng(9)
    x = rng.random((300, 20)) < 0.3
    y = (x[:, 0] | (rng.random(300) < 0.3)).astype(float)
    row, col = np.nonzero(x)
    s = toxicity.Sparse(row, col, 20, np.ones((300, 1)))
    w = toxicity.fit(s, y, 5e-3, steps=3000)
    grad = s.dot_t(toxicity._sigmoid(s.dot(w)) - y) / 300
    assert abs(grad[-1]) < 1e-4 and (np.abs(grad[:-1]) < 5e-3 + 1e-4).all()
    assert np.allclose(grad[:-1][w[:-1] != 0], -5e-3 * np.sign(w[:-1][w[:-1] != 0]), atol=1e-4)


def test_training_rows_are_bounded(spark):
    rows = [(1, "long " * 1000), (2, "a b"), (2, "c d"), (2, "c d"), (3, "e f"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 4, 5)], "doc_id long, quality int, toxic int")
    got = [r["text"] for r in toxicity.training_rows(docs.where("text is not null"), labels, ["quality", "toxic"], 10, 4000)]
    assert len(got) == 2 and "e f" in got


# 6


def jaccard_brute(texts, t=0.8):
    sets = {}
    for i, x in texts.items():
        w = x.split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    links = {i: set() for i in texts}
    items = sorted(texts)
    for k, i in enumerate(items):
        for j in items[k + 1 :]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    return links


def reach(links):
    out = {}
    for i in sorted(links):
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += links[x]
    return out


def test_near_duplicates(spark, texts):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 4000, 200)]
    group = {}
    for i in range(1000, 1140):  # one large group of near copies, over several blocks
        w = list(words)
        for k in rng.integers(0, 200, 3):
            w[k] = f"x{rng.integers(0, 9)}"
        group[i] = " ".join(w)
    every = {**texts, **group, **{2000 + k: group[1000] for k in range(30)}}
    links = jaccard_brute(every)
    comp = reach(links)
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    for r in ngram_jaccard.near_duplicates(df, block_rows=32).collect():
        i = r["doc_id"]
        assert r["n_links"] == len(links[i]) and r["class_id"] == comp[i] and r["kept"] == (comp[i] == i)


def test_rows_with_one_id_and_different_texts(spark):
    words = [[f"{c}{k}" for k in range(60)] for c in "ab"]
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(words[0])), (1, " ".join(words[1])), (2, near(words[0])), (3, near(words[1])), (4, "a text of its own, apart from all"), (1, " ".join(words[0]))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = sorted((r["doc_id"], r["n_links"], r["class_id"], r["kept"]) for r in ngram_jaccard.near_duplicates(docs).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert kept == sorted({rows[0], rows[1], rows[4]})
    more = spark.createDataFrame([(0, near(words[0]), "en"), *[(i, t, "en") for i, t in rows]], docs.schema)
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, more, "").collect())
    assert kept == sorted([(0, near(words[0])), rows[1], rows[4]])  # one of the two texts of id 1 goes


def test_banding_reaches_the_recall():
    b, r = ngram_jaccard.banding(0.8, 0.99995)
    assert 1 - (1 - 0.8**r) ** b >= 0.99995 and b * r <= 200


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1200)]
    links = defaultdict(set)
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    want = {k: v for k, v in reach(links).items() if links[k] - {k}}
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# 7


def tiling_brute(doc, item, least):
    """The textbook loop: all maximal matches of unmarked tokens, longest first."""
    md, mi, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not md[i + k] and not mi[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return total
        total += best[0]
        for k in range(best[0]):
            md[best[1] + k] = mi[best[2] + k] = True


@pytest.mark.parametrize("seed", range(25))
def test_tiling(seed):
    rng = np.random.default_rng(seed)
    item = [f"t{k}" for k in rng.integers(0, 12, 30)]
    parts = [item[a : a + rng.integers(3, 12)] for a in rng.integers(0, 25, 4)]
    doc = [w for p in parts for w in [*p, f"z{rng.integers(0, 3)}"]]
    got = decontaminate.Items([(7, " ".join(item))], 3).hits(" ".join(doc), 0.0)
    assert (round(got[0]["coverage"] * len(item)) if got else 0) == tiling_brute(doc, item, 3)


def test_repeated_words_are_tiled_too():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, doc = (list(rng.choice(["la", "li"], n, p=[0.8, 0.2])) for n in (24, 60))
        got = decontaminate.Items([(7, " ".join(item)), (8, "la " * 24)], 3).hits(" ".join(doc), 0.0)
        assert {h["item_id"]: round(h["coverage"] * 24) for h in got}.get(7, 0) == tiling_brute(doc, item, 3)


def test_equal_hashes_are_not_equal_words():
    tok = np.array([5, 6, 7, 8, 9, 10], np.uint64)
    side = lambda: decontaminate.Side(tok, np.arange(6))
    assert decontaminate.tiles(side(), side(), 3, lambda i, j, n: True) == [(6, 0, 0)] and decontaminate.tiles(side(), side(), 3, lambda i, j, n: False) == []


def test_reordered_passage_and_both_ways(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    text = bench.first()["text"].split()
    third = len(text) // 3
    extra = spark.createDataFrame([(9001, " ".join(["before", *text[2 * third :], "mid", *text[third : 2 * third], "more", *text[:third], "after"])), (9002, " ".join(text[:third]))], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionAll(extra)
    a, b = decontaminate.contaminated(every, bench), decontaminate.contaminated(every, bench, max_shared_chars=0)
    assert plain(a) == plain(b)
    found = {r["doc_id"]: r for r in a.collect()}
    assert found[9001]["coverage"] > 0.9 and found[9001]["n_tiles"] >= 3 and 9002 not in found


def test_tiling_joined_by_any_id(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight"), (1, "red green blue black white pink grey"), (2, "one two three four five six nine ten")], "item_id long, text string")
    dirty, clean, other = "so one two three four five six seven eight", "nothing of the kind is said in here at all", "red green blue black white pink grey"
    rows = [(None, dirty), (None, clean), ("a", dirty), ("a", clean), ("a", other), ("b", dirty), ("b", dirty), ("c", None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    small, large = ([(r["doc_id"], r["text"], [(h["item_id"], h["coverage"]) for h in r["hits"]]) for r in decontaminate.with_hits(docs, bench, max_shared_chars=n).collect()] for n in (32_000_000, 0))
    assert sorted(map(repr, small)) == sorted(map(repr, large)) and len(large) == 9
    assert all(bool(h) == (t in (dirty, other)) for _, t, h in large)


# 8


def test_small_filters_change_nothing(spark, docs):
    want = plain(line_dedup.dedup_lines(docs, min_chars=10, min_docs=2))
    assert want == plain(line_dedup.dedup_lines(docs, min_chars=10, min_docs=2, max_filter_bits=line_dedup.SEGMENT))
    rows = {r["doc_id"]: r["text"].split("\n") for r in docs.collect()}
    holders = defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, lines in rows.items():
        for x in lines:
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    drop = {k: max(v) for k, v in holders.items() if len(v) >= 2}
    for r in line_dedup.dedup_lines(docs, min_chars=10, min_docs=2).collect():
        keep = [x for x in rows[r["doc_id"]] if drop.get(key(x), r["doc_id"]) == r["doc_id"]]
        assert r["kept"] == "\n".join(keep) and r["n_dropped"] == len(rows[r["doc_id"]]) - len(keep)


def test_lines_of_rows_without_an_id(spark):
    line = [f"line number {k} that is long enough to be a key of its own" for k in range(4)]
    rows = [(i, line[0]) for i in range(6)] + [(None, f"{line[0]}\n{line[k % 4]}\nrest {k}") for k in range(9)] + [(i, line[1]) for i in range(6)] + [(5, f"{line[0]}\nmore")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_dropped"], r["kept"]) for r in out.collect())
    drop = {line[0]: 5, line[1]: 5}
    want = []
    for i, t in rows:
        keep = [x for x in t.split("\n") if drop.get(x, i) == i]
        want.append((i is None, i or 0, t.count("\n") + 1 - len(keep), "\n".join(keep)))
    assert got == sorted(want)


# 9


def test_code_lengths_are_exact(texts):
    some = list(texts.values())[:6]
    m = language_id.train({"a": some[:3], "b": some[3:]})
    counts = {}
    for lang, own in (("a", some[:3]), ("b", some[3:])):
        c = defaultdict(Counter)
        for t in own:
            d = language_id.padded(t, 4)
            for i in range(4, len(d)):
                for k in range(5):
                    c[d[i - k : i]][d[i]] += 1
        counts[lang] = c
    for q in (list(texts.values())[10][:500], "zß", ""):
        d = language_id.padded(q, 4)
        want = []
        for lang in ("a", "b"):
            total = 0.0
            for i in range(4, len(d)):
                for k in range(4, -1, -1):
                    c = counts[lang].get(d[i - k : i])
                    if c:
                        n, kinds = sum(c.values()), len(c)
                        if d[i] in c:
                            total -= math.log2(c[d[i]] / (n + kinds))
                            break
                        total -= math.log2(kinds / (n + kinds))
                else:
                    total += 8
            want.append(total)
        assert language_id.code_lengths(m, [q], chunk=64)[0] == pytest.approx(want)


def test_held_out_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in d.collect()}
    rows = [r for r in language_id.identify(d).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.98 and all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in rows)


def sample(rows, most):
    return language_id.texts_of(language_id.training_sample(rows, most, language_id.learned(rows, most)))


def test_training_sample_of_few_long_texts(spark):
    rows = [(i, f"lang a {i} " * 12_000, "a") for i in range(3)] + [(i, f"lang b {i} " * 400, "b") for i in range(40)]
    rows += [(1000 + i, f"lang c {i} " * (20_000 if i < 8 else 10), "c") for i in range(400)] + [(7, "lang d " * 10, "d")] * 3000
    rows += [(1, "é" * 50_000, "e"), (2, None, "a"), (3, "", "f"), (4, "no language", None)]
    got = sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3000)
    size = {k: sum(len(t.encode()) for t in v) for k, v in got.items()}
    assert set(got) == set("abcde") and all(3000 <= size[k] <= 6000 for k in "abc") and 3000 <= size["e"] <= 4200
    assert len(got["a"]) >= 2 and len(got["b"]) >= 8 and len(got["c"]) >= 8 and got["d"] == ["lang d " * 10]
    few = spark.createDataFrame([(i, f"text {i} " * 100, "a") for i in range(5)], "doc_id long, text string, lang string")
    assert sorted(sample(few, 1 << 20)["a"]) == [f"text {i} " * 100 for i in range(5)]
    assert sample(few.limit(0), 3000) == {}


def test_several_models_judge_as_one(spark, monkeypatch):
    """Languages dealt over many models: predictions, scores and rates of one model that holds them all."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d = d.withColumn("lang", F.when(F.col("doc_id") % 9 == 0, F.concat("lang", F.lit("x"))).otherwise(F.col("lang")))
    d = d.unionByName(d.limit(3)).unionByName(spark.createDataFrame([(None, "the text", "en", "s", 1), (5000, None, None, "s", 1), (5001, "123 !", None, "s", 1)], d.schema))
    key = lambda df: sorted(((str(r["doc_id"]), r["held_out"], r["lang_pred"], round(r["score"], 9), r["bits_per_byte"] and round(r["bits_per_byte"], 9), r["fits"], r["source"]) for r in df.collect()), key=repr)
    one = key(language_id.identify(d, times=3.0, carry=("source",), max_train_bytes=20_000))
    monkeypatch.setattr(language_id, "MODEL_BYTES", 40_000)
    assert key(language_id.identify(d, times=3.0, carry=("source",), max_train_bytes=20_000)) == one
    assert len({r[2] for r in one}) > 5
    carried = language_id.identify(d, carry=("text", "source"), max_train_bytes=20_000)
    assert carried.columns == ["doc_id", "held_out", "text", "source", "lang_pred", "score", "bits_per_byte"] and carried.count() == len(one)


def test_six_hundred_languages(spark):
    """A noisy lang column: a row for every document."""
    words = {f"l{k:03d}": f"{chr(97 + k % 26)}{chr(97 + k // 26)}qz " for k in range(600)}
    rows = [(4 * k + j, w * 6, lang) for k, (lang, w) in enumerate(words.items()) for j in range(3)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    assert len(got) == 1800 and np.mean([r["lang_pred"] == f"l{r['doc_id'] // 4:03d}" for r in got]) > 0.9


def test_language_stage_drops_unlearned_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600)
    other = [
        "Dzisiaj rano poszliśmy do sklepu, żeby kupić chleb i mleko na śniadanie.", "Tänä aamuna kävimme kaupassa ostamassa leipää ja maitoa aamiaiseksi.",
        "Leo asubuhi tulienda dukani kununua mkate na maziwa kwa ajili ya kifungua kinywa.", "Сегодня утром мы пошли в магазин купить хлеб и молоко.",
        "今天早上我们去商店买了面包和牛奶当早餐。", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08",
    ]
    new = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(other)], "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, d.unionByName(new, allowMissingColumns=True), "").select("doc_id").collect()}
    assert got == {r["doc_id"] for r in d.collect() if r["text"] and any(map(str.isalpha, r["text"]))}


# 10


def test_vectors_over_blocks(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(6, 24))
    rows = [(i, (centre[i % 6] + rng.normal(0, [0.05, 0.25, 0.4][i % 3], 24)).tolist(), i % 2) for i in range(600)] + [(700 + i, centre[0].tolist(), 0) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    v = {i: (np.array(x) / np.linalg.norm(x), lab) for i, x, lab in rows}
    links = {i: {j for j in v if j != i and v[j][1] == v[i][1] and v[i][0] @ v[j][0] >= 0.93} for i in v}
    comp = reach(links)
    for how in ({"width": 8, "block_rows": 40}, {"width": 8, "block_rows": 200, "small": 0}, {}):
        for r in embedding_dedup.near_vectors(df, **how).collect():
            assert r["n_links"] == len(links[r["vec_id"]]) and r["component_id"] == comp[r["vec_id"]]


def test_sizes_of_vectors_and_repeated_ids(spark):
    a, b = np.array([3.0, 4.0, 0.5]), np.array([-1.0, 2.0, 7.0])
    rows = [(1, a, 1), (2, a * 1e200, 1), (3, a * 1e-200, 1), (4, a * 1e-320, 1), (5, b * 1e300, 1), (6, b, 1), (1, b * 2, 1), (7, -a, 1)]
    df = spark.createDataFrame([(i, v.tolist(), c) for i, v, c in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [(1, 2, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 2, 1, False), (6, 2, 1, False), (7, 0, 7, True)]


def test_boxes_lose_no_pair_and_rule_out_others():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 16)).repeat(50, axis=0) + rng.normal(0, 0.1, (2000, 16))
    near = lambda p, q: ((p[:, None] - q[None]) ** 2).sum(-1) <= 0.5
    for left, right in ((np.arange(2000), None), (np.arange(1200), np.arange(1200, 2000))):
        found, tested = 0, 0
        for i, j in embedding_dedup.meetings(x, left, right, 0.5, leaf=32):
            hit = near(x[i], x[j])
            found += int(hit.sum() if i is not j else (hit.sum() - len(i)) // 2)
            tested += len(i) * len(j)
        full = near(x[left], x[left if right is None else right])
        assert found == (full.sum() if right is not None else (full.sum() - 2000) // 2) and tested < 0.15 * full.size


# Pipeline


def test_pipeline_against_plain_stages(spark, texts):
    """Each stage on its predecessor's rows, decided by the plain versions."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = {}
    for name, f in corpus_pipeline.STAGES:
        d = common.stored(f(spark, d, SF), name)
        out[name] = {r["doc_id"]: r["text"] for r in d.collect()}
    assert set(out["language_id"]) == {i for i, t in texts.items() if any(map(str.isalpha, t))}
    near = reach(jaccard_brute(out["line_dedup"]))
    assert set(out["ngram_jaccard"]) == set(near.values())
    clean = set()
    for i, t in out["ngram_jaccard"].items():
        words = re.findall(r"\w+", t.lower())
        if not any(tiling_near(words, re.findall(r"\w+", b.lower())) for _, b in bench):
            clean.add(i)
    assert set(out["decontamination"]) == clean and out["sentencepiece"] == out["decontamination"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == clean


def tiling_near(doc, item):
    """Half of the item covered by tiles of five tokens; the slow loop runs only where five tokens in a row are shared."""
    grams = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
    at = [k for k in range(len(doc) - 4) if tuple(doc[k : k + 5]) in grams]
    if not at:
        return False
    near = sorted({x for k in at for x in range(k, k + 5)})
    part, last = [], None
    for x in near:
        part += ([None] if last is not None and x != last + 1 else []) + [doc[x]]
        last = x
    return tiling_brute(part, item, 5) >= 0.5 * len(item)
