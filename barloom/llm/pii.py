"""Personal data: rules find the plain forms; generators propose further spans, which boosted trees judge."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import renamed, sliced

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The rules' spans by start and kind; each kind leftmost and without overlap, in time linear in the text."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, end := m.end()))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


AT = re.compile(r"@|[\[({<][Aa][Tt][\])}>]|\b[Aa][Tt]\b")
NAME = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?\Z")
LABEL = re.compile(r" ?([A-Za-z0-9-]{1,63})")
DOT = re.compile(r"\.(?! )| \. | ?[\[({<](?:\.|[Dd][Oo][Tt])[\])}>]| [Dd][Oo][Tt]\b")
RUN = re.compile(r"[0-9]+")
GAP = re.compile(r"[\x20().\-/_,:+\[\]]{1,3}")
MOST_DIGITS = 19


def candidates(text: str) -> Iterator[Span]:
    """Overlapping spans that may be personal data in any form, a bounded number for each mark or number of the text.

    Addresses with a written-out or bracketed at and dot; every way to read neighbouring numbers
    as four parts, as 12 to 19, or as 7 to 15 digits.
    """
    for m in AT.finditer(text):
        low = max(0, m.start() - 66)
        if not (name := NAME.search(text[low : m.start()])):
            continue
        at, labels = m.end(), 0
        while labels < 6 and (label := LABEL.match(text, at)):
            labels += 1
            if labels > 1:
                yield low + name.start(), 0, label.end()
            dot = DOT.match(text, label.end())
            if not dot:
                break
            at = dot.end()
    held: list[tuple[int, int]] = []
    for m in RUN.finditer(text):
        if held and not (m.start() - held[-1][1] <= 3 and GAP.fullmatch(text, held[-1][1], m.start())):
            yield from _numbers(text, held)
            held = []
        held.append(m.span())
        if len(held) >= 512:  # those that follow start in a list with all that they can be read with
            yield from _numbers(text, held, 512 - MOST_DIGITS)
            held = held[512 - MOST_DIGITS :]
    yield from _numbers(text, held)


def _numbers(text: str, held: list[tuple[int, int]], starts: int | None = None) -> Iterator[Span]:
    for i, (start, _) in enumerate(held[:starts]):
        n = 0
        lead = start - (start > 0 and text[start - 1] in "+(") - (start > 1 and text[start - 2 : start] == "+(")
        for j in range(i, len(held)):
            n += held[j][1] - held[j][0]
            if n > MOST_DIGITS:
                break
            if j == i + 3 and max(b - a for a, b in held[i : j + 1]) <= 3:
                yield start, 1, held[j][1]
            if n >= 12:
                yield start, 2, held[j][1]
            if 7 <= n <= 15:
                yield lead, 3, held[j][1]


#: Words before a span that name what follows.
CUES = (("mail", "contact", "write"), ("ip", "host", "server", "addr"), ("card", "visa", "credit", "pay"), ("tel", "phone", "call", "mobile", "fax"))
SEPARATORS = " .-/()"


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span: numbers, separators, checks, neighbours, words before it."""
    start, kind, end = span
    s = text[start:end]
    runs = RUN.findall(s)
    digits = "".join(runs)
    sizes = [len(r) for r in runs] or [0]
    before, after = text[max(0, start - 32) : start], text[end : end + 32]
    cues = before.lower()
    mark = AT.search(s) if kind == 0 else None
    tail = re.split(r"[\s.\[\](){}<>]+", s) if kind == 0 else [""]
    out = [
        float(end - start), float(len(digits)), float(len(runs)), float(min(sizes)), float(max(sizes)), float(sizes[0]), float(sizes[-1]),
        float(luhn(digits)) if 12 <= len(digits) <= MOST_DIGITS else -1.0, float(digits[:1] or -1), float(digits[:2] or -1),
        max(float(r) if len(r) <= 3 else 1000.0 for r in runs) if runs else -1.0, float(s[:1] == "+"), float(digits[:2] == "00"),
        float(sum(not c.isalnum() for c in s)), float(len({c for c in s if not c.isalnum()})),
        *(float(s.count(c)) for c in SEPARATORS),
        float(mark.end() - mark.start()) if mark else -1.0, float(s.count("@")), float(len(tail[-1])), float(tail[-1].isalpha() and tail[-1].islower()), float(len(DOT.findall(s[mark.end() :])) if mark else 0),
        float(len(re.findall(r"[\[({< ][Dd][Oo][Tt]", s))), float(sum(t[:1].isupper() for t in tail[1:])),
        float(sum(c in cues for c in CUES[kind])), float("0" <= before[-1:] <= "9" or before[-2:-1].isdigit()), float("0" <= after[:1] <= "9" or after[1:2].isdigit()),
        float(len(_digits(before))), float(len(_digits(after))), float(before[-1:].isalpha() or after[:1].isalpha()),
    ]
    return out


def disguises(kind: int, s: str) -> Iterator[str]:
    """Other forms of a found value, which the rules miss."""
    if kind == 0:
        for at, dot in ((" at ", " dot "), ("[at]", "."), ("(at)", "[dot]"), (" @ ", "."), (" [at] ", " [dot] ")):
            name, _, domain = s.partition("@")
            yield name + at + domain.replace(".", dot)
    elif kind == 1:
        yield from (s.replace(".", d) for d in ("[.]", " . ", "(.)", ","))
    elif kind == 2:
        d = _digits(s)
        yield from (x.join(d[i : i + 4] for i in range(0, len(d), 4)) for x in (".", "/", " - ", "_"))
        yield s
    else:
        yield s[1:]
        yield "00" + s[1:]
        yield "00" + _digits(s)
        if "(" in s:
            yield s[s.index("(") :]
        yield s[1:].replace(" ", "/").replace("-", "/")
        yield s[1:].replace(" ", ".").replace("-", ".")


def spoiled(kind: int, s: str) -> Iterator[str]:
    """Values that look alike and are none."""
    if kind == 1:
        yield ".".join(str(int(p) + 256) for p in s.split("."))
    if kind == 2:
        yield s[:-1] + str((int(s[-1]) + 3) % 10)
    if kind == 3:
        yield _digits(s)[:8]


def examples(text: str, spans: list[Span], most: int = 16) -> Iterator[tuple[int, bool, list[float]]]:
    """(kind, whether it is personal data, features) of a training text.

    Found values in other forms are the positives, in the place where they were found and, if they are numbers,
    also next to another number. Negatives are candidates that touch no found value, that cut a disguised one
    short, go beyond it or take it for another kind, and spoiled values.
    """
    made = [[0, 0] for _ in KINDS]

    def take(kind: int, yes: bool, text: str, span: Span):
        if made[kind][yes] < most * (1 + yes):
            made[kind][yes] += 1
            yield kind, yes, features(text, span)

    for start, kind, end in spans:
        left, right = text[max(0, start - 200) : start], text[end : end + 200]
        for k, s in enumerate([*disguises(kind, text[start:end]), *spoiled(kind, text[start:end])]):
            yes = k < len(list(disguises(kind, text[start:end])))
            ahead = "4203 " if kind == 2 and yes and s == text[start:end] else ""
            new, at = left + ahead + s + right, len(left) + len(ahead)
            yield from take(kind, yes, new, (at, kind, at + len(s)))
            for c in candidates(new) if yes else ():
                if c[0] < at + len(s) and at < c[2] and c != (at, kind, at + len(s)):
                    yield from take(c[1], False, new, c)
    for c in candidates(text):
        if not any(a < c[2] and c[0] < b for a, _, b in spans):
            yield from take(c[1], False, text, c)


@dataclass
class Trees:
    """Boosted trees of equal depth as arrays, then the calibration: steps of the score and their probabilities."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float
    steps: np.ndarray
    p: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.p[np.searchsorted(self.steps, self.score(x), side="right")]


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Gradient-boosted trees for the logistic loss: Newton steps, cuts at quantiles of the features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)])  # bin b: cut b - 1 < value <= cut b
    width, inner = bins + 1, 2**depth - 1
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base, np.zeros(0), np.zeros(1))
    z, offset = np.full(len(y), base), np.arange(x.shape[1]) * width
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            cell = (binned[rows] + offset).ravel()
            sums = [np.bincount(cell, weights=np.repeat(v[rows], x.shape[1]), minlength=width * x.shape[1]).reshape(-1, width).cumsum(axis=1) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, (s[:, -1:] for s in sums)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, b] > 1e-9 and b < len(cuts[f]):
                out.feature[t, node], out.cut[t, node] = f, cuts[f][b]
            at[rows] = 2 * node + 1 + (x[rows, out.feature[t, node]] > out.cut[t, node])
        leaf = at - inner
        out.value[t] = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        z += out.value[t][leaf]
    return out


def calibrated(score: np.ndarray, y: np.ndarray, prior: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """An increasing step function from score to probability (isotonic regression); each step is drawn towards 0 by ``prior`` negatives."""
    order = np.argsort(score, kind="stable")
    levels: list[list[float]] = []  # positives, rows, lowest score
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        if levels and levels[-1][3] == s:
            levels[-1][0] += v
            levels[-1][1] += 1
        else:
            levels.append([v, 1, s, s])
        while len(levels) > 1 and levels[-2][0] * levels[-1][1] >= levels[-1][0] * levels[-2][1]:
            a, n, _, high = levels.pop()
            levels[-1][0] += a
            levels[-1][1] += n
            levels[-1][3] = high
    p = [a / (n + prior) for a, n, _, _ in levels]
    return np.array([low for _, _, low, _ in levels]), np.maximum.accumulate([0.0, *p])


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int = 4) -> Trees:
    """Trees of all rows, calibrated on the scores of trees that have not seen a row's document."""
    out = np.zeros(len(y))
    for f in range(folds):
        rest = fold != f
        if (~rest).any():
            out[~rest] = boosted(x[rest], y[rest]).score(x[~rest]) if rest.any() else 0.0
    model = boosted(x, y)
    model.steps, model.p = calibrated(out, y)
    return model


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        rows = [(u, *e) for u, text in zip(batch.column("u").to_pylist(), batch.column("text").to_pylist()) for e in examples(text, base_spans(text))]
        u, kind, yes, x = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array(kind, pa.int32()), pa.array(yes, pa.bool_()), pa.array(x, pa.list_(pa.float64()))], names=["u", "kind", "yes", "x"]
        )


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["u", "yes", "key"], kind="stable")
    m = fit(np.array(rows["x"].tolist()), rows["yes"].to_numpy(float), (rows["u"] % 4).to_numpy())
    return pd.DataFrame([{
        "kind": int(rows["kind"].iloc[0]), "feature": m.feature.ravel().tolist(), "cut": m.cut.ravel().tolist(), "value": m.value.ravel().tolist(),
        "base": m.base, "trees": len(m.feature), "steps": m.steps.tolist(), "p": m.p.tolist(),
    }])


#: What may hold personal data in some form at all.
LIKELY = r"@|[0-9][0-9 ().,/_:+\[\]-]{5,}[0-9]"


def train(docs: DataFrame, max_docs: int, max_bytes: int, max_examples: int) -> dict[int, Trees]:
    """The trees of each kind, fitted in a task a kind, from a bounded sample: about max_docs documents that may hold
    personal data, by hash of the text, none above max_bytes, and max_examples positives and negatives a kind.
    Equal texts count once. A kind without 20 positives and 20 negatives gets no trees."""
    likely = docs.where(F.col("text").rlike(LIKELY) & (F.octet_length("text") <= max_bytes)).select("text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("u"))
    n = likely.select(F.approx_count_distinct("u")).first()[0]
    sample = likely.where(F.col("u") < int((1 << 40) * min(1.0, max_docs / max(1, n)))).dropDuplicates(["u"])
    found = sample.mapInArrow(_examples, "u long, kind int, yes boolean, x array<double>").withColumn("key", F.xxhash64("u", "x"))
    first = F.row_number().over(Window.partitionBy("kind", "yes").orderBy("key", "u"))
    kept = found.withColumn("n", first).where(F.col("n") <= max_examples)
    side = lambda c: F.sum(c.cast("int")).over(Window.partitionBy("kind"))
    enough = kept.withColumn("pos", side(F.col("yes"))).withColumn("neg", side(~F.col("yes"))).where("pos >= 20 and neg >= 20").drop("pos", "neg", "n")
    kinds = "kind int, feature array<long>, cut array<double>, value array<double>, base double, trees int, steps array<double>, p array<double>"
    out = {}
    for r in enough.groupBy("kind").applyInPandas(_fit, kinds).collect():  # four rows at most
        shape = (r["trees"], -1)
        out[r["kind"]] = Trees(np.array(r["feature"]).reshape(shape), np.array(r["cut"]).reshape(shape), np.array(r["value"]).reshape(shape), r["base"], np.array(r["steps"]), np.array(r["p"]))
    return out


def chosen(models: dict[int, Trees], text: str, base: list[Span], least: float) -> list[tuple[Span, float]]:
    """Candidates of at least that probability which touch no base span; the longest first, then the most probable, none touching one before it."""
    if not models:
        return []
    taken = np.array([(a, b) for a, _, b in base], np.int64).reshape(-1, 2)
    good: list[tuple[Span, float]] = []
    block: list[Span] = []

    def judge():
        for kind, model in models.items():
            own = [c for c in block if c[1] == kind]
            if own:
                p = model.probability(np.array([features(text, c) for c in own]))
                good.extend((c, float(v)) for c, v in zip(own, p) if v >= least)
        block.clear()

    ends = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    for c in candidates(text):
        k = int(np.searchsorted(taken[:, 0], c[2])) if len(taken) else 0  # base spans that start before its end
        if not k or ends[k - 1] <= c[0]:
            block.append(c)
            if len(block) >= 4096:
                judge()
    judge()
    out: list[tuple[Span, float]] = []
    used = _Taken()
    for c, p in sorted(good, key=lambda x: (x[0][0] - x[0][2], -x[1], x[0])):
        if used.add(c[0], c[2]):
            out.append((c, p))
    return sorted(out)


class _Taken:
    """Intervals without overlap, found by their thousands."""

    def __init__(self):
        self.by: dict[int, list[tuple[int, int]]] = {}

    def add(self, a: int, b: int) -> bool:
        cells = range(a // 1000, (b - 1) // 1000 + 1)
        if any(x < b and a < y for c in cells for x, y in self.by.get(c, ())):
            return False
        for c in cells:
            self.by.setdefault(c, []).append((a, b))
        return True


def redacted(text: str, spans: list[Span]) -> str:
    """The text with its spans, which may overlap across kinds, replaced by [EMAIL] and so on."""
    out, end = [], 0
    for a, kind, b in sorted(spans):
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


SPANS = "array<struct<kind:string,start:long,end:long>>"


def _find(shared, least: float):
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    judged = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            base, more, clean = [], [], []
            for text in batch.column("text").to_pylist():
                own = base_spans(text or "")
                new = chosen(shared.value, text or "", own, least)
                base.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in own])
                more.append([{"kind": KINDS[k], "start": a, "end": b, "p": p} for (a, k, b), p in new])
                clean.append(None if text is None else redacted(text, [*own, *(s for s, _ in new)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(base, spans), pa.array(more, judged), pa.array(clean, pa.string())], names=["doc_id", "base", "added", "redacted"]
            )

    return run


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.95,
    max_train_docs: int = 6000, max_train_bytes: int = 200_000, max_examples: int = 3000,
) -> DataFrame:
    """Per input row: doc_id, base and added (arrays of kind, start, end in code points; added with its probability), redacted text.

    base are the rules' spans of the whole text, of any length. The trees are fitted on a bounded sample
    (see ``train``); a candidate that touches no base span is added if its calibrated probability is ``least`` or
    more and no longer one overlaps it. A null or empty text has no span. Rows are judged one by
    one, so repeated rows get equal results. In a corpus without enough found values nothing is added.
    """
    base = renamed(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(train(base, max_train_docs, max_train_bytes, max_examples))  # a few thousand numbers a kind
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_find(shared, least), f"doc_id {kind}, base {SPANS}, added array<struct<kind:string,start:long,end:long,p:double>>, redacted string")


def joined(*lists: Column) -> Column:
    """kind:start:end of all spans by start, then kind in its usual order, joined by commas."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    flat = F.concat(*[F.transform(c, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))) for c in lists])
    return F.array_join(F.transform(F.array_sort(flat), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The rows of ``find`` as counts and digests."""
    n = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == k), False)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("base"), F.col("added")).alias("spans"))
