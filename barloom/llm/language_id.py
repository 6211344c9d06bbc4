"""Language identification by prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import once_a_task, ranked, renamed, sliced, stored, typed

UNDETERMINED = "und"


class Lookup:
    """A read-only hash table from non-zero 64-bit keys to row numbers; -1 if absent. Works on whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # every round each free slot takes one of its claimants; the rest step on
            free = self.keys[slot] == 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.rows[slot[put]] = keys[todo[put]], todo[put]
            todo, slot = todo[~put], slot[~put]
            slot = np.where(self.keys[slot] == 0, slot, (slot + 1) & self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.rows[slot], -1)
        open_ = np.flatnonzero((have != keys) & (have != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            have = self.keys[slot]
            hit = have == keys[open_]
            out[open_[hit]] = self.rows[slot[hit]]
            go = ~hit & (have != 0)
            open_, slot = open_[go], slot[go]
        return out


def windows(data: np.ndarray, order: int) -> np.ndarray:
    """Per byte after the first ``order``: it and its context, packed; a leading 1 keeps keys of each order apart from 0."""
    n = len(data) - order
    key = np.ones(n, np.uint64)
    for k in range(order + 1):
        key = (key << np.uint64(8)) | data[k : k + n]
    return key


def padded(text: str, order: int) -> bytes:
    return b"\n" * order + text.encode("utf-8", "replace").lower()


def pieces(texts: list[str], order: int, chunk: int) -> Iterator[list[tuple[int, bytes]]]:
    """(number of the text, bytes) of all texts in groups of about ``chunk`` bytes; long texts in pieces that overlap by the context."""
    group: list[tuple[int, bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        data = padded(text, order)
        for start in range(0, max(1, len(data) - order), chunk):
            group.append((i, piece := data[start : start + chunk + order]))
            held += len(piece)
            if held >= chunk:
                yield group
                group, held = [], 0
    if group:
        yield group


def shard_of(pair, shards: int):
    """The part of a model that holds the contexts that end in these two bytes; for columns and arrays alike."""
    wide = pair * 2_654_435_761
    return (F.shiftright(wide, 16) if isinstance(wide, Column) else wide >> np.uint64(16)) % shards


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def window_counts(texts: list[str], order: int, chunk: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The windows of whole texts and how often each occurs."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for group in pieces(texts, order, chunk):
        data = np.frombuffer(b"".join(x for _, x in group), np.uint8)
        inside = np.ones(len(data) - order, bool)
        ends = np.cumsum([len(x) for _, x in group])[:-1]
        inside[(ends[:, None] - np.arange(1, order + 1)).ravel()] = False  # windows that span two pieces
        found.append(np.unique(windows(data, order)[inside], return_counts=True))
    return summed(*map(np.concatenate, zip(*found)))


@dataclass
class Model:
    """Code lengths in bits for each order: of seen (context, byte) and of the escape from a context, one column per language.

    A part (shard) of several has from order 2 up only the contexts that end in its pairs of bytes, and codes only
    the bytes after those; the code length of a text is the sum over the parts.
    """

    languages: list[str]
    order: int
    symbols: list[tuple[Lookup, np.ndarray]]
    escapes: list[tuple[Lookup, np.ndarray]]
    shard: int = 0
    shards: int = 1

    def bits(self, data: np.ndarray) -> np.ndarray:
        """(len(data) - order) x languages: the exact code length of each byte after its context; 0 for other parts' bytes."""
        key = windows(data, self.order)
        out = np.zeros((len(key), len(self.languages)))
        at = np.arange(len(key))
        if self.shards > 1:
            at = np.flatnonzero(shard_of((key >> np.uint64(8)) & np.uint64(0xFFFF), self.shards) == self.shard)
            key = key[at]
        for k in range(self.order, -1, -1):
            key = shorter(key, k)
            look, cost = self.symbols[k]
            row = look(key)
            hit = row >= 0
            out[at[hit]] += cost[row[hit]]
            at, key = at[~hit], key[~hit]
            if not len(at):
                return out
            look, cost = self.escapes[k]
            row = look(key >> np.uint64(8))
            seen = row >= 0
            out[at[seen]] += cost[row[seen]]
        out[at] += 8.0
        return out


def shorter(keys: np.ndarray, order: int) -> np.ndarray:
    """The windows of a lower order at the same bytes."""
    return (keys & np.uint64((1 << 8 * (order + 1)) - 1)) | np.uint64(1 << 8 * (order + 1))


Counts = dict[str, tuple[np.ndarray, np.ndarray]]


def fitted(counts: Counts, order: int, low: Counts | None = None, shard: int = 0, shards: int = 1) -> Model:
    """Contexts of 0..order bytes per language (escape method C, no exclusion) and their code lengths, from counts of windows.

    A byte that a language never saw after a context costs that context's escape, if the language
    knows the context, plus its cost in the context one byte shorter; below order 0 each byte costs 8 bits.
    Counts of a shorter context are sums over the longer ones. A part of a model takes the counts of its own
    windows, and those of order 1 over all parts (low).
    """
    languages = sorted(counts)
    if not languages:
        return Model([], order, [], [])
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    symbols, escapes = [], []
    lower_keys = lower = None
    for k in range(order + 1):
        of_order = counts if low is None or k > 1 else low
        per = [summed(shorter(keys, k), n) for keys, n in (of_order.get(lang, none) for lang in languages)]
        union = np.unique(np.concatenate([p[0] for p in per]))
        contexts, of = np.unique(union >> np.uint64(8), return_inverse=True)
        cost, escape = np.zeros((len(union), len(languages))), np.zeros((len(contexts), len(languages)))
        if k:
            below = lower[np.searchsorted(lower_keys, shorter(union, k - 1))]
        else:
            below = np.full((len(union), len(languages)), 8.0)
        for j, (keys, n) in enumerate(per):
            at = np.searchsorted(union, keys)
            total = np.bincount(of[at], weights=n, minlength=len(contexts))
            kinds = np.bincount(of[at], minlength=len(contexts))
            known = kinds > 0
            escape[known, j] = -np.log2(kinds[known] / (total + kinds)[known])
            cost[:, j] = escape[of, j] + below[:, j]
            cost[at, j] = -np.log2(n / (total + kinds)[of[at]])
        symbols.append((Lookup(union), cost))
        escapes.append((Lookup(contexts), escape))
        lower_keys, lower = union, cost
    return Model(languages, order, symbols, escapes, shard, shards)


@dataclass
class Learned:
    """Counts of a model, or part of one. The tables, several times as large, are made where they are used, once a worker."""

    counts: Counts
    order: int
    low: Counts | None = None
    shard: int = 0
    shards: int = 1

    @property
    def languages(self) -> list[str]:
        return sorted(self.counts)

    @functools.cached_property
    def model(self) -> Model:
        return fitted(self.counts, self.order, self.low, self.shard, self.shards)


def train(texts: dict[str, list[str]], order: int = 4) -> Model:
    """The model of a few texts per language."""
    return fitted({lang: window_counts(own, order) for lang, own in texts.items()}, order)


def code_lengths(model: Model, texts: list[str], chunk: int = 1 << 19) -> np.ndarray:
    """texts x languages: bits of each whole text; long texts go through in pieces that overlap by the context."""
    out = np.zeros((len(texts), len(model.languages)))
    for group in pieces(texts, model.order, chunk):
        bits = model.bits(np.frombuffer(b"".join(x for _, x in group), np.uint8))
        end = 0
        for i, x in group:
            n = len(x) - model.order  # windows that end in this piece; those that span two pieces are skipped
            out[i] += bits[end : end + n].sum(axis=0)
            end += len(x)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior under equal priors, and bits per byte of the best language."""
    lang, score, rate = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
    which = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
    if which:
        cost = code_lengths(model, [texts[i] for i in which])
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(which)), best]
        score[which] = 1.0 / np.exp2(np.maximum(least[:, None] - cost, -1000.0)).sum(axis=1)
        rate[which] = least / np.array([max(1, len(texts[i].encode("utf-8", "replace"))) for i in which])
        for i, b in zip(which, best):
            lang[i] = model.languages[b]
    return lang, score, rate


#: Bytes of the windows (8 each, once a language) that one model or part of a model holds. A language counts for a
#: sixteenth of it at least, so a model has about 16 languages at most and its tables, one column a language, stay bounded.
MODEL_BYTES = 16_000_000


def _draw(max_bytes: int):
    """Per lang: cap, the bytes that one text may give; share, the u below which rows are drawn; least, its smallest u.

    The cap is the smallest power of two, from about a twelfth of max_bytes up, by which the texts
    fill max_bytes. The draw is by capped bytes: either all rows are drawn or 32 at least are expected.
    """

    def run(found: pd.DataFrame) -> pd.DataFrame:  # a few dozen rows
        k = (max_bytes // 16).bit_length()
        held = lambda k: int(np.where(found["width"] <= k, found["bytes"], found["n"] * (1 << k)).sum())
        while held(k) < max_bytes and (found["width"] > k).any():
            k += 1
        return pd.DataFrame([{"lang": found["lang"].iloc[0], "cap": 1 << k, "share": 4.0 * max_bytes / held(k), "least": found["least"].min()}])

    return run


def learned(docs: DataFrame, max_bytes: int) -> DataFrame:
    """(lang, cap, share, least) of every language of (doc_id, text, lang): what training_sample draws of it."""
    sizes = _usable(docs).groupBy("lang", F.length(F.bin("bytes")).cast("int").alias("width")).agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("u").alias("least")
    )
    return stored(sizes.groupBy("lang").applyInPandas(_draw(max_bytes), "lang string, cap long, share double, least double"), "languages")


def _usable(docs: DataFrame) -> DataFrame:
    docs = docs.where("lang is not null and text is not null and text <> ''")
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.substring(F.md5("text"), 1, 8)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return docs.withColumn("u", u).withColumn("bytes", F.octet_length("text").cast("long"))


def training_sample(docs: DataFrame, max_bytes: int, languages: DataFrame) -> DataFrame:
    """(lang, u, text): texts per language, in the order of a hash of the id, until max_bytes are passed.

    docs has (doc_id, text, lang). A share of rows is taken first so that the sort that follows
    is over a bounded number of rows in each language, however many rows one language has; the first
    row is always among them. A long text gives its beginning only, if others fill the rest. Equal
    rows count once.
    """
    ahead = F.sum(F.octet_length("text")).over(
        Window.partitionBy("lang").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    # about cap bytes, in whole characters
    part = F.expr("substring(text, 1, cast(greatest(1, least(char_length(text), cap * char_length(text) div bytes)) as int))")
    return (
        _usable(docs).join(languages, "lang")
        .where((F.col("u") < F.col("share")) | (F.col("u") <= F.col("least")))
        .select("lang", "u", "doc_id", part.alias("text")).distinct()
        .withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < max_bytes)
        .select("lang", "u", "text")
    )


def texts_of(sample: DataFrame) -> dict[str, list[str]]:
    """The sampled texts by language: at most max_bytes and one text's part for each."""
    out: dict[str, list[str]] = {}
    for r in sample.orderBy("lang", "u", F.md5("text")).collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def counted(rows: DataFrame, order: int, most: int = 4_000_000) -> DataFrame:
    """(lang, win, n): how often each window occurs in all whole texts of (lang, text). Tasks add up what they see, in
    turns of about ``most`` windows, and Spark adds up the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged() -> int:
            for lang, found in held.items():
                held[lang] = [summed(*map(np.concatenate, zip(*found)))]
            return sum(len(found[0][0]) for found in held.values())

        def out() -> Iterator[pa.RecordBatch]:
            for lang, ((keys, n),) in held.items():
                for i in range(0, len(keys), 1 << 16):
                    own = keys[i : i + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own), pa.array(n[i : i + (1 << 16)])], names=["lang", "win", "n"])
            held.clear()

        pending = 0
        for batch in sliced(batches, "text"):
            own: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own.setdefault(lang, []).append(text)
            for lang, texts in own.items():
                found = window_counts(texts, order)
                held.setdefault(lang, []).append(found)
                pending += len(found[0])
            if pending >= most:
                pending = 0
                if merged() >= most // 2:
                    yield from out()
        merged()
        yield from out()

    parts = rows.select("lang", "text").mapInArrow(run, "lang string, win long, n long")
    return stored(parts.groupBy("lang", "win").agg(F.sum("n").alias("n")), "language-windows")


def dealt(counts: DataFrame, order: int) -> DataFrame:
    """(lang, grp, shards): the model, 0, 1..., that learns each language, and how many parts that model has."""
    own = F.greatest(F.col("n_windows") * 8, F.lit(MODEL_BYTES // 16))
    sizes = counts.groupBy("lang").agg(F.count("*").alias("n_windows")).withColumn("size", own)
    before = F.sum("size").over(Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")  # one row a language
    grouped = sizes.withColumn("grp", F.floor(before / MODEL_BYTES).cast("int"))
    held = F.sum(F.col("n_windows") * 8).over(Window.partitionBy("grp"))
    shards = F.ceil(held / MODEL_BYTES).cast("int") if order > 1 else F.lit(1)
    return stored(grouped.select("lang", "grp", shards.alias("shards")), "languages")


def packed(counts: DataFrame) -> Counts:
    """The counts of (lang, win, n), which fit the driver, by way of tables of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            of, win, n = lang.indices.to_numpy(), batch.column("win").to_numpy(), batch.column("n").to_numpy()
            for j, name in enumerate(lang.dictionary.to_pylist()):
                held.setdefault(name, []).append((win[of == j], n[of == j]))
        parts = [[np.concatenate(x).tobytes() for x in zip(*own)] for own in held.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array([w for w, _ in parts], pa.binary()), pa.array([n for _, n in parts], pa.binary())], names=["lang", "wins", "ns"]
        )

    found: dict[str, list] = {}
    for r in counts.mapInArrow(run, "lang string, wins binary, ns binary").collect():
        found.setdefault(r["lang"], []).append((np.frombuffer(r["wins"], np.uint64), np.frombuffer(r["ns"], np.int64)))
    return {lang: tuple(map(np.concatenate, zip(*own))) for lang, own in found.items()}


def model_of(counts: DataFrame, languages: DataFrame, grp: int, order: int, shard: int = 0, shards: int = 1) -> Learned:
    """One model, or one part of it: the driver holds no more of the counts than that."""
    own = counts.join(F.broadcast(languages.where(F.col("grp") == grp).select("lang")), "lang").select("lang", "win", "n")
    if shards == 1:
        return Learned(packed(own), order)
    low = packed(own.groupBy("lang", (F.col("win").bitwiseAND(0xFFFF) + 0x10000).alias("win")).agg(F.sum("n").alias("n")))
    part = packed(own.where(shard_of(F.shiftright("win", 8).bitwiseAND(0xFFFF), shards) == shard))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Learned({lang: part.get(lang, none) for lang in low}, order, low, shard, shards)


def medians(rates: DataFrame) -> dict[str, float]:
    """The exact median of (lang, rate) for each language, from places in a distributed order."""
    placed = ranked(rates, [F.col("rate")], "language-rates", "lang")
    middle = (F.col("place") == F.floor((F.col("total") + 1) / 2)) | (F.col("place") == F.floor(F.col("total") / 2) + 1)
    return {r["lang"]: r["m"] for r in placed.where(middle).groupBy("lang").agg(F.avg("rate").alias("m")).collect()}


def _rates(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.model
        place = {lang: j for j, lang in enumerate(model.languages)}
        for batch in sliced(batches, "text"):
            own = [(t, lang) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()) if lang in place and has_letter(t)]
            cost = code_lengths(model, [t for t, _ in own])
            rate = [cost[i, place[lang]] / len(t.encode("utf-8", "replace")) for i, (t, lang) in enumerate(own)]
            yield pa.RecordBatch.from_arrays([pa.array([lang for _, lang in own], pa.string()), pa.array(rate, pa.float64())], names=["lang", "rate"])

    return run


def loosest(bounds: np.ndarray) -> np.ndarray:
    """Bounds where a language without one has the loosest of the others, or none."""
    return np.where(np.isnan(bounds), np.nanmax(bounds) if (bounds == bounds).any() else np.inf, bounds)


def fits(model: Model, bounds: np.ndarray, text: str | None, lang: str, rate: float, spare: float = 64.0) -> bool:
    """Whether the rate of a text is within its language's bound; ``spare`` bits more for what few bytes cannot tell."""
    if lang == UNDETERMINED:
        return False
    return bool(rate <= bounds[model.languages.index(lang)] + spare / max(1, len(text.encode("utf-8", "replace"))))


def _score(shared, bounds: np.ndarray | None, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.model
        for batch in sliced(batches, column):
            texts = batch.column(column).to_pylist()
            lang, score, rate = predict(model, texts)
            rest = [c for c in batch.schema.names if c != "_text"]
            new = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "bits_per_byte": pa.array(rate, pa.float64(), from_pandas=True)}
            if bounds is not None:
                new["fits"] = pa.array([fits(model, bounds, *x) for x in zip(texts, lang, rate)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *new.values()], names=[*rest, *new])

    return run


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4,
    max_train_bytes: int | None = None, folds: int = 4, held: int = 2, carry: tuple[str, ...] = (),
    times: float | None = None,
) -> DataFrame:
    """Per input row: doc_id, the carried columns, held_out, lang_pred, score, bits_per_byte.

    Learns one byte model per non-null language from every whole text of the documents whose crc32(doc_id as text) mod
    folds is not ``held``; repeated rows count as often as they occur. (``max_train_bytes``, for trials, draws texts up to so many bytes a
    language instead.) Every whole text is then coded under every language; lang_pred is the shortest code
    (ties: the first by name), score its posterior under equal priors, bits_per_byte its rate.
    ``und`` with score 0 and null rate if the text is null, has no letter, or no language was
    learned. A null doc_id counts as the empty text in the fold rule. Rows are judged one by one,
    so repeated rows get equal results; a very long text is coded whole, in pieces that overlap by the
    context. Windows are counted by Spark; what exceeds one model's room (MODEL_BYTES), be it many languages or many windows
    of one, goes to further models and parts of models, which code the texts one after
    another; any number of languages is possible, and the work grows with it, as the method codes every text under every language.

    With ``times``, a column fits is added: whether bits_per_byte is at most so many times the median
    rate of the language's held-out texts, all of them, with 64 bits a text to spare.
    """
    base = renamed(docs, doc_id=id_col, text=text_col, lang=lang_col)
    fold = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == held, F.lit(False))
    usable = base.where("lang is not null and text is not null and text <> ''")
    taught, unseen = usable.where(~fold(F.col("doc_id"))), usable.where(fold(F.col("doc_id")))
    if max_train_bytes is not None:
        taught = training_sample(taught, max_train_bytes, learned(taught, max_train_bytes))
    counts = counted(taught, order)
    languages = dealt(counts, order)
    models = [(r["grp"], r["shards"]) for r in languages.select("grp", "shards").distinct().orderBy("grp").collect()]
    spark = docs.sparkSession
    text = text_col if text_col in carry else "_text"  # a carried text goes to the tasks once
    own = [] if text in carry else [F.col(f"`{text_col}`").alias(text)]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), fold(F.col(f"`{id_col}`")).alias("held_out"), *[F.col(f"`{c}`") for c in carry], *own)
    if sum(shards for _, shards in models) > 1:
        return _by_models(rows, text, counts, languages, models, order, unseen if times is not None else None, times)
    model = model_of(counts, languages, models[0][0], order) if models else Learned({}, order)
    shared, bounds = spark.sparkContext.broadcast(model), None
    if times is not None:
        found = medians(unseen.select("lang", "text").mapInArrow(_rates(shared), "lang string, rate double"))
        bounds = loosest(np.array([times * found.get(lang, np.nan) for lang in model.languages]))
    fields = [*typed(rows, "_text"), "lang_pred string", "score double", "bits_per_byte double", *(["fits boolean"] if bounds is not None else [])]
    return rows.mapInArrow(_score(shared, bounds, text), ", ".join(fields))


def _costs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.model
        for batch in sliced(batches, "text"):
            cost = code_lengths(model, batch.column("text").to_pylist())
            ends = np.arange(len(cost) + 1, dtype=np.int32) * len(model.languages)
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.ListArray.from_arrays(pa.array(ends), pa.array(cost.ravel()))], names=["h1", "h2", "costs"])

    return run


def _by_models(
    rows: DataFrame, text: str, counts: DataFrame, languages: DataFrame, models: list[tuple[int, int]], order: int, unseen: DataFrame | None, times: float | None
) -> DataFrame:
    """identify() for more than one model holds: one model, or part of one, after another codes all texts, each text once
    however often it repeats. Code lengths add up over a model's parts; the least code length of each text is a min
    aggregate over the models.

    The driver and every worker hold one model, or part of one, at a time.
    """
    spark = rows.sparkSession
    hashes = lambda c: (F.xxhash64(c), F.xxhash64(F.lit(1), F.reverse(c)))
    h1, h2 = hashes(text)
    texts = stored(
        rows.where(F.col(text).isNotNull()).select(h1.alias("h1"), h2.alias("h2"), F.col(text).alias("text")).transform(lambda df: once_a_task(df, "h1", "h2")), "language-texts"
    )
    if unseen is not None:  # without texts
        u1, u2 = hashes("text")
        unseen = stored(unseen.where(F.col("text").rlike(r"\p{L}")).select("lang", u1.alias("h1"), u2.alias("h2"), F.octet_length("text").alias("bytes")), "language-held")
    found, rates, known_languages = [], [], []
    for g, shards in models:
        parts = []
        for part in range(shards):
            model = model_of(counts, languages, g, order, part, shards)
            shared = spark.sparkContext.broadcast(model)
            parts.append(stored(texts.mapInArrow(_costs(shared), "h1 long, h2 long, costs array<double>").distinct(), "language-costs").withColumn("part", F.lit(part)))
            shared.destroy()
        names = F.array(*map(F.lit, model.languages))
        costs = functools.reduce(DataFrame.unionByName, parts).groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("part", "costs"))).alias("p"))  # one entry a part
        zero = F.array_repeat(F.lit(0.0), len(model.languages))
        costs = costs.select("h1", "h2", F.aggregate("p", zero, lambda a, x: F.zip_with(a, x["costs"], lambda b, c: b + c)).alias("costs")).withColumn("bits", F.array_min("costs"))
        z = F.aggregate("costs", F.lit(0.0), lambda a, c: a + F.pow(F.lit(2.0), F.greatest(F.col("bits") - c, F.lit(-1000.0))))
        costs = stored(costs.select("h1", "h2", "costs", "bits", F.element_at(names, F.array_position("costs", F.col("bits")).cast("int")).alias("lang"), z.alias("z")), "language-best")
        found.append(costs.drop("costs"))
        known_languages += model.languages
        if unseen is not None:
            of = unseen.withColumn("_at", F.array_position(names, F.col("lang")).cast("int")).where("_at > 0")
            rates.append(of.join(costs.select("h1", "h2", "costs"), ["h1", "h2"]).select("lang", (F.element_at("costs", F.col("_at")) / F.col("bytes")).alias("rate")))
    every = functools.reduce(DataFrame.unionByName, found)
    best = every.groupBy("h1", "h2").agg(F.min(F.struct("bits", "lang", "z")).alias("b"), F.collect_list(F.struct("bits", "z")).alias("all"))  # one entry a model
    z = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["z"] * F.pow(F.lit(2.0), F.greatest(F.col("b.bits") - x["bits"], F.lit(-1000.0))))
    best = stored(best.select("h1", "h2", F.col("b.lang").alias("_lang"), F.col("b.bits").alias("_bits"), (1 / z).alias("_score")), "language-best")
    judged = rows.withColumn("_h1", h1).withColumn("_h2", h2).join(best, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")), "left")
    known = F.col("_lang").isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rate = F.col("_bits") / F.greatest(F.octet_length(text), F.lit(1))
    out = judged.withColumns({
        "lang_pred": F.when(known, F.col("_lang")).otherwise(F.lit(UNDETERMINED)), "score": F.when(known, F.col("_score")).otherwise(0.0), "bits_per_byte": F.when(known, rate),
    })
    names = [c for c in rows.columns if c != "_text"] + ["lang_pred", "score", "bits_per_byte"]
    if unseen is not None:
        middle = medians(functools.reduce(DataFrame.unionByName, rates))
        bounds = loosest(np.array([times * middle.get(lang, np.nan) for lang in known_languages]))
        limits = spark.createDataFrame([(k, float(v)) for k, v in zip(known_languages, bounds)], "_of string, _limit double")
        out = out.join(limits, F.col("lang_pred") == F.col("_of"), "left")  # one row a language
        out = out.withColumn("fits", F.coalesce(known & (F.col("bits_per_byte") <= F.col("_limit") + 64.0 / F.greatest(F.octet_length(text), F.lit(1))), F.lit(False)))
        names.append("fits")
    return out.select(*names)
