"""Toxicity by classifier chains: linear models in sequence, each fed the earlier categories' probabilities."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import renamed, sliced

TOKEN = re.compile(r"\w+")
#: The chain: (category, column of labels, value that means yes).
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


#: Lengths of the word beginnings that are features of their own.
BEGINNINGS = (3, 4, 5, 6)


def features(text: str | None) -> set[str]:
    """The distinct lower-cased words of the whole text, the beginnings of longer words as ``xxx~``, and as
    ``xxx~2`` those that occur twice or more."""
    count = Counter(TOKEN.findall(text.lower())) if text else Counter()
    out = set(count)
    for word, n in count.items():
        for size in BEGINNINGS:
            if len(word) <= size:
                break
            start = word[:size] + "~"
            if n > 1 or start in out:
                out.add(start + "2")
            out.add(start)
    return out


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


class Sparse:
    """0/1 features of rows plus a few dense columns."""

    def __init__(self, row: np.ndarray, col: np.ndarray, width: int, dense: np.ndarray):
        self.row, self.col, self.width, self.dense = row, col, width, dense
        self.n = len(dense)

    def rows(self, keep: np.ndarray) -> "Sparse":
        """The rows that a mask keeps, renumbered."""
        use = keep[self.row]
        return Sparse((np.cumsum(keep) - 1)[self.row[use]], self.col[use], self.width, self.dense[keep])

    def columns(self, keep: np.ndarray) -> "Sparse":
        use = keep[self.col]
        return Sparse(self.row[use], (np.cumsum(keep) - 1)[self.col[use]], int(keep.sum()), self.dense)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n) + self.dense @ w[self.width :]

    def dot_t(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, weights=g[self.row], minlength=self.width), self.dense.T @ g])


def screened(x: Sparse, y: np.ndarray, most: int) -> np.ndarray:
    """A mask of the columns whose rate of positives departs most from the mean, by its z-score."""
    n = np.bincount(x.col, minlength=x.width)
    hit = np.bincount(x.col, weights=y[x.row], minlength=x.width)
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    z = np.abs(hit - n * rate) / np.sqrt(np.maximum(n, 1) * rate * (1 - rate))
    keep = np.zeros(x.width, bool)
    keep[np.argsort(-z, kind="stable")[:most]] = True
    return keep


def fit_screened(x: Sparse, y: np.ndarray, penalty: float, most: int) -> np.ndarray:
    """fit() on the screened columns; weights of all columns."""
    keep = screened(x, y, most)
    w = fit(x.columns(keep), y, penalty)
    out = np.zeros(x.width + x.dense.shape[1])
    out[np.flatnonzero(keep)] = w[: int(keep.sum())]
    out[x.width :] = w[int(keep.sum()) :]
    return out


def fit(x: Sparse, y: np.ndarray, penalty: float, steps: int = 300) -> np.ndarray:
    """Logistic regression with an L1 penalty on all but the last (constant) column, by accelerated proximal gradient."""
    w = z = np.zeros(x.width + x.dense.shape[1])
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(base / (1 - base))
    z, t, rate = w.copy(), 1.0, 1.0

    def loss(v):
        s = x.dot(v)
        return np.mean(np.logaddexp(0, s) - y * s), s

    for _ in range(steps):
        value, s = loss(z)
        grad = x.dot_t(_sigmoid(s) - y) / x.n
        while True:
            new = z - rate * grad
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
            d = new - z
            if loss(new)[0] <= value + grad @ d + (d @ d) / (2 * rate) + 1e-12 or rate < 1e-8:
                break
            rate /= 2
        if (new - w) @ (z - new) > 0:  # restart the momentum
            t = 1.0
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, moved = new + (t - 1) / ahead * (new - w), np.abs(new - w).max()
        w, t, rate = new, ahead, rate * 1.3
        if moved < 1e-5:
            break
    return w


@dataclass
class Chain:
    """Per category: word weights, weights of the earlier categories' probabilities, constant, decision threshold."""

    names: list[str]
    words: list[dict[str, float]]
    earlier: list[np.ndarray]
    constant: list[float]
    threshold: list[float]

    def probabilities(self, text: str | None) -> list[float]:
        have, out = features(text), []
        for words, earlier, constant in zip(self.words, self.earlier, self.constant):
            s = constant + sum(words[w] for w in sorted(have & words.keys())) + float(np.dot(earlier, out) if out else 0.0)
            out.append(float(_sigmoid(s)))
        return out


@dataclass
class Training:
    """The training rows: vocabulary, their features as (row, column) pairs, fold of each row, labels, and how to fit."""

    vocabulary: list[str]
    row: np.ndarray
    col: np.ndarray
    fold: np.ndarray
    labels: np.ndarray
    max_words: int
    penalty: float

    def fit(self, k: int, earlier: np.ndarray, without: int) -> np.ndarray:
        """Weights of category k from all rows but those of one fold (-1: from all rows)."""
        x = Sparse(self.row, self.col, len(self.vocabulary), np.hstack([earlier, np.ones((len(self.fold), 1))]))
        y, keep = self.labels[:, k].astype(float), self.fold != without
        return fit_screened(x.rows(keep), y[keep], self.penalty, self.max_words)


def fit_here(data: Training, jobs: list[tuple[int, np.ndarray, int]]) -> list[np.ndarray]:
    return [data.fit(*j) for j in jobs]


def fit_in_tasks(spark):
    """The fits of one category as one task each; the training rows, which have a bound, are broadcast once."""
    shared: list = []

    def run(data: Training, jobs: list[tuple[int, np.ndarray, int]]) -> list[np.ndarray]:
        if not shared:
            shared.append(spark.sparkContext.broadcast(data))
        rows, (k, earlier, _) = shared[0], jobs[0]
        before = spark.sparkContext.broadcast(earlier)

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for without in batch.column("without").to_pylist():
                    w = rows.value.fit(k, before.value, without)
                    used = np.flatnonzero(w)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([without], pa.int32()), pa.array([used.tolist()], pa.list_(pa.int64())), pa.array([w[used].tolist()], pa.list_(pa.float64()))], names=["without", "at", "w"]
                    )

        n = len(jobs)
        job = F.col("id").cast("int")
        dealt = spark.range(0, n, 1, n).select(F.element_at(F.array(*[F.lit(j[2]) for j in jobs]), job + 1).alias("without"))
        found = {r["without"]: r for r in dealt.mapInArrow(one, "without int, at array<long>, w array<double>").collect()}
        out = []
        for _, _, without in jobs:
            w = np.zeros(len(data.vocabulary) + earlier.shape[1] + 1)
            w[found[without]["at"]] = found[without]["w"]
            out.append(w)
        return out

    return run


def train(
    texts: list[str], labels: np.ndarray, names: list[str], folds: int = 5, min_docs: int = 4, max_words: int = 2000, penalty: float = 3e-4,
    fits=fit_here,
) -> Chain:
    """Fit the chain: each category sees, besides the words, out-of-fold probabilities of the categories before it.

    ``fits`` does the fits of a category, which do not depend on each other. Folds are dealt in the order of the texts; equal texts share a fold. The max_words most telling
    features are chosen within each fit. Thresholds give the best F1 of the out-of-fold
    probabilities (0.5 where a category has no positive or no negative).
    """
    count: Counter = Counter()
    for t in texts:
        count.update(features(t))
    vocabulary = sorted(w for w, n in count.items() if n >= min_docs)
    del count
    index = {w: i for i, w in enumerate(vocabulary)}
    cols = [np.array(sorted(index[w] for w in features(t) if w in index), np.int64) for t in texts]
    row, col = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate([*cols, np.zeros(0, np.int64)])
    first: dict[str, int] = {}
    fold = np.array([first.setdefault(t, i % folds) for i, t in enumerate(texts)])
    chain = Chain(list(names), [], [], [], [])
    data = Training(vocabulary, row, col, fold, labels, max_words, penalty)
    earlier = np.zeros((len(texts), 0))
    apart = [f for f in range(folds) if (fold == f).any() and not (fold == f).all()]
    for k in range(len(names)):
        w, *held = fits(data, [(k, earlier, f) for f in (-1, *apart)])
        x = Sparse(row, col, len(vocabulary), np.hstack([earlier, np.ones((len(texts), 1))]))
        out = np.full(len(texts), 0.5)
        for f, v in zip(apart, held):
            out[fold == f] = _sigmoid(x.rows(fold == f).dot(v))
        used = np.flatnonzero(w[: len(vocabulary)])
        chain.words.append({vocabulary[i]: float(w[i]) for i in used})
        chain.earlier.append(w[len(vocabulary) : -1].copy())
        chain.constant.append(float(w[-1]))
        chain.threshold.append(best_threshold(out, labels[:, k].astype(float)))
        earlier = np.hstack([earlier, out[:, None]])
    return chain


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1, in the middle of the gap below the last accepted probability."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    s, hit = p[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def training_rows(docs: DataFrame, labels: DataFrame, columns: list[str], max_rows: int, max_bytes: int) -> list:
    """Labelled documents in the order of a hash: at most max_rows of them, and whole texts until max_bytes are
    passed. A text above a twentieth of max_bytes is no training text; of several texts of a doc_id one counts.

    Labels without a null are thinned by hash first, so the sort and the broadcast are over a bounded number of ids.
    """
    known = labels.where(" and ".join(f"`{c}` is not null" for c in ["doc_id", *columns]))
    known = known.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns]).withColumn(
        "u", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(1 << 40)) / float(1 << 40)
    )
    n = known.count()
    chosen = known.where(F.col("u") < 4.0 * max_rows / max(1, n))
    sized = docs.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h")).where(F.col("size") <= max_bytes // 20)
    sizes = (
        sized.join(F.broadcast(chosen), "doc_id")  # about 4 max_rows ids at most
        .groupBy("doc_id", "u", *columns).agg(F.min(F.struct("h", "size")).alias("t")).select("doc_id", "u", *columns, "t.*")
    )
    order = Window.orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    picked = sizes.withColumn("ahead", F.coalesce(F.sum("size").over(order), F.lit(0))).where(F.col("ahead") < max_bytes)
    ids = picked.drop("size", "ahead").orderBy("u", "doc_id").limit(max_rows)
    rows = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "h"]).dropDuplicates(["doc_id"])
    return sorted(rows.select("u", "text", *columns).collect(), key=lambda r: (r["u"], r["text"]))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = shared.value
        for batch in sliced(batches, "text"):
            p = np.array([chain.probabilities(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(chain.names))
            yes = p >= np.array(chain.threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(p.shape[1])), *(pa.array(yes[:, k]) for k in range(p.shape[1]))],
                names=["doc_id", *(f"p_{c}" for c in chain.names), *chain.names],
            )

    return run


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain=CHAIN,
    max_train_rows: int = 8000, max_train_bytes: int = 20_000_000, **how,
) -> DataFrame:
    """Per input row: doc_id, p_<category> and <category> (boolean) for each category of the chain.

    The models are fitted on a bounded sample of labelled rows (max_train_rows documents,
    max_train_bytes bytes of whole texts), the folds in tasks of their own; every whole text is
    classified, however long it is. Null or empty text has no
    words: its probabilities come from the constants alone. Without any labelled row all
    probabilities are practically 0 (below 1e-200) and all categories false. Labels with a null are ignored; of several labels
    of a document the least counts. Rows are judged one by one, so repeated rows get equal results.
    """
    base = renamed(docs, doc_id=id_col, text=text_col)
    rows = training_rows(base.where("text is not null"), labels, [c for _, c, _ in chain], max_train_rows, max_train_bytes)
    names = [c for c, _, _ in chain]
    if rows:
        y = np.array([[r[column] == yes for _, column, yes in chain] for r in rows])
        model = train([r["text"] for r in rows], y, names, **{"fits": fit_in_tasks(docs.sparkSession), **how})
    else:
        k = len(names)
        model = Chain(names, [{}] * k, [np.zeros(i) for i in range(k)], [float("-inf")] * k, [0.5] * k)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = [f"doc_id {base.schema['doc_id'].dataType.simpleString()}", *(f"p_{c} double" for c in names), *(f"{c} boolean" for c in names)]
    return base.mapInArrow(_predict(shared), ", ".join(schema))
