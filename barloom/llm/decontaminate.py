"""Benchmark decontamination by greedy string tiling over word tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once_a_task, renamed, sliced, stored, typed
from .ngram_jaccard import _U, _hashes

TOKEN = re.compile(r"\w+")
#: Base of the rolling hash.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's words: runs of letters, digits and _, lower-cased."""
    words = TOKEN.findall(text.lower()) if text else []
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def rolling(tok: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n tokens."""
    out = np.zeros(max(0, len(tok) - n + 1), np.uint64)
    if len(out):
        for k in range(n):
            out = out * _U(BASE) + tok[k : k + len(out)]
    return out


class Side:
    """One side of a tiling: its tokens, and how many unmarked ones in a row begin at each place."""

    def __init__(self, tok: np.ndarray, places: np.ndarray):
        """places: the place of each token in its text; tokens that are no neighbours there make no match together."""
        n = len(tok)
        power, self.down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
        power[1:], self.down[1:] = BASE, INVERSE
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(self.down, out=self.down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tok * power[:-1], out=self.sums[1:])
        cut = np.append(np.flatnonzero(np.diff(places) != 1) + 1, n)
        self.places, self.free = places, cut[np.searchsorted(cut, np.arange(n), "right")] - np.arange(n)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(Karp-Rabin hashes, starts) of the windows of unmarked tokens; each hash in one step from the running sums."""
        at = np.flatnonzero(self.free >= size)
        return (self.sums[at + size] - self.sums[at]) * self.down[at], at

    def mark(self, at: int, size: int) -> None:
        self.free[at : at + size] = 0
        self.free[:at] = np.minimum(self.free[:at], at - np.arange(at))


def tiles(doc: Side, item: Side, least: int, same) -> list[tuple[int, int, int]]:
    """Greedy tiling: again and again the longest match of unmarked tokens (ties: first in the document, then in
    the item), until none is ``least`` long. As (size, start, start in the item).

    The length of the next match never grows. It is found by halving, as a shared window of some
    length has shared shorter ones in it, and all matches of that length are marked before the
    next search, so memory stays in proportion to both sides, however often their words repeat.
    ``same(i, j, size)`` compares the words themselves.
    """
    out: list[tuple[int, int, int]] = []
    top = int(min(doc.free.max(initial=0), item.free.max(initial=0)))
    while top >= least:
        low = least - 1
        while low < top:
            size = (low + top + 1) // 2
            low, top = (size, top) if np.isin(item.windows(size)[0], doc.windows(size)[0]).any() else (low, size - 1)
        if top < least:
            break
        key, at = item.windows(top)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        hashes, starts = doc.windows(top)
        first, stop = np.searchsorted(key, hashes, "left"), np.searchsorted(key, hashes, "right")
        passed: dict[int, int] = {}
        for h in np.flatnonzero(stop > first):
            i, f = int(starts[h]), int(first[h])
            if doc.free[i] < top:
                continue
            k = passed.get(f, f)
            while k < stop[h] and item.free[at[k]] < top:  # marked for good
                k += 1
            passed[f] = k
            for j in map(int, at[k : stop[h]]):
                if item.free[j] >= top and same(int(doc.places[i]), j, top):
                    out.append((top, int(doc.places[i]), j))
                    doc.mark(i, top)
                    item.mark(j, top)
                    break
            if item.free.max() < top:
                break
        top -= 1
    return out


class Items:
    """Benchmark items with the sorted windows of all of them."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.least = least
        self.ids, self.texts = [r[0] for r in rows], [r[1] for r in rows]
        windows, size = [], []
        for text in self.texts:
            tok = tokens(text)
            size.append(len(tok))
            windows.append(rolling(tok, least))
        self.size = np.array(size, np.int64)
        key = np.concatenate([*windows, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(w) for w in windows])
        place = np.concatenate([*(np.arange(len(w), dtype=np.int32) for w in windows), np.zeros(0, np.int32)])
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.place = key[order], owner[order], place[order]

    def candidates(self, seeds: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray]]:
        """(item, its shared seeds) of the items that all shared seeds together cover to the threshold."""
        a, b = np.searchsorted(self.key, seeds, "left"), np.searchsorted(self.key, seeds, "right")
        seed = np.flatnonzero(b > a)
        if not len(seed):
            return []
        n = (b - a)[seed]
        at = np.repeat(a[seed], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # at most all windows of the benchmark
        at = at[np.lexsort((self.place[at], self.owner[at]))]
        owner, place = self.owner[at], self.place[at]
        first = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
        step = np.full(len(at), self.least)
        inside = owner[1:] == owner[:-1]
        step[:-1][inside] = np.minimum(np.diff(place)[inside], self.least)
        reach = np.add.reduceat(step, first[:-1])
        return [(int(owner[s]), np.unique(self.key[at[s:e]])) for s, e, r in zip(first, first[1:], reach) if r >= threshold * self.size[owner[s]]]

    def hits(self, text: str | None, threshold: float) -> list[dict]:
        """Items that the text covers to the threshold at least: coverage, tiles and longest tile in tokens."""
        tok = tokens(text)
        win = rolling(tok, self.least)
        out: list[dict] = []
        found = self.candidates(np.unique(win), threshold)
        if not found:
            return out
        order = np.argsort(win, kind="stable")
        win, words = win[order], TOKEN.findall(text.lower())
        for k, seeds in found:
            ranges = zip(np.searchsorted(win, seeds, "left"), np.searchsorted(win, seeds, "right"))
            near = np.zeros(len(tok) + 1, np.int32)
            for a, b in ranges:
                near[order[a:b]] += 1
                near[order[a:b] + self.least] -= 1
            near = np.flatnonzero(np.cumsum(near[:-1]))  # tokens in a shared seed
            item = TOKEN.findall(self.texts[k].lower())
            same = lambda i, j, n: words[i : i + n] == item[j : j + n]  # noqa: B023, E731
            tiling = tiles(Side(tok[near], near), Side(tokens(self.texts[k]), np.arange(len(item))), self.least, same)
            matched = sum(t[0] for t in tiling)
            if tiling and matched >= threshold * self.size[k]:
                out.append({"item_id": self.ids[k], "coverage": matched / int(self.size[k]), "n_tiles": len(tiling), "longest": tiling[0][0]})
        return sorted(out, key=lambda h: tuple(h.values()))


#: Parts of the documents that hold a window, in the join by window.
SALTS = 8
HITS = "array<struct<item_id:bigint,coverage:double,n_tiles:bigint,longest:bigint>>"
_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest", pa.int64())]))


def _against_all(shared, column: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in sliced(batches, column):
            hits = [items.hits(t, threshold) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, _TYPE)], names=[*batch.schema.names, "hits"])

    return run


def _windows(least: int):
    """(window hash, id) of each text, every hash once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [np.unique(rolling(tokens(t), least)) for t in batch.column("text").to_pylist()]
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
            keys = np.concatenate([*found, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), ids], names=["key", "id"])

    return run


def _places(least: int):
    """(window hash, id, place, size) of every window of an item of size tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            tok = [tokens(t) for t in batch.column("text").to_pylist()]
            found = [rolling(t, least) for t in tok]
            n = [len(f) for f in found]
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(found)), n)))
            keys = np.concatenate([*found, np.zeros(0, np.uint64)])
            place = np.concatenate([*(np.arange(k, dtype=np.int32) for k in n), np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), ids, pa.array(place), pa.array(np.repeat([len(t) for t in tok], n).astype(np.int32))], names=["key", "id", "place", "size"])

    return run


def _pairwise(least: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            ids, hits = [], []
            for key, text, item_id, item in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "item_id", "item"))):
                if found := Items([(item_id, item)], least).hits(text, threshold):
                    ids.append(key)
                    hits.append(found[0])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(hits, _TYPE.value_type)], names=["id", "hit"])

    return run


def with_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", least: int = 5, threshold: float = 0.5, max_shared_chars: int = 32_000_000,
) -> DataFrame:
    """Add hits to every row of docs: the benchmark items that it contains, by item_id, with coverage, n_tiles, longest.

    Seeds are windows of ``least`` tokens that document and item share. Per candidate pair the
    longest unmarked matches are marked one after another, none overlapping on either side, until
    none of ``least`` tokens is left; marked tokens over the item's tokens is the coverage, so
    passages in another order count fully. Windows are found by their hashes and compared word by
    word before they are marked. Items with coverage >= threshold are hits.

    A benchmark of at most max_shared_chars characters goes to every task whole; a larger one is
    joined by window hash (documents' windows shuffled, the item's covered places counted for each pair, both texts
    sent only for pairs that can reach the threshold), each text under a 128-bit hash of itself, so that results do not depend on the size or on ids.
    Null or empty texts, and items of fewer than ``least`` tokens, match nothing. Repeated items
    each count under their item_id; items with a null id are left out. Repeated rows of docs are
    judged alike. A very long text costs time and memory in proportion to its length, a text that
    repeats a few words too. A column of docs called hits is replaced.
    """
    spark = docs.sparkSession
    items = renamed(benchmark, item_id=item_id_col, item=item_text_col).where("item_id is not null and item is not null")
    items = items.groupBy("item_id", "item").agg(F.lit(1).alias("_")).drop("_")
    chars = items.agg(F.sum(F.length("item")).alias("n")).first()["n"] or 0
    docs = docs.drop("hits")
    if chars <= max_shared_chars:
        shared = spark.sparkContext.broadcast(Items([(r["item_id"], r["item"]) for r in items.collect()], least))
        return docs.mapInArrow(_against_all(shared, text_col, threshold), ", ".join([*typed(docs), f"hits {HITS}"]))
    text_key = F.substring(F.unhex(F.sha2(F.col(f"`{text_col}`"), 256)), 1, 16)
    base = renamed(docs.select(text_key.alias("id"), F.col(f"`{text_col}`").alias("text")), id="id", text="text").where("text is not null")
    # a pair goes on only if the item's places that all shared windows together cover reach the threshold; texts follow then
    once = once_a_task(base, "id")
    seeds = once.mapInArrow(_windows(least), "key long, id binary").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    marks = stored(items.select(F.col("item_id").alias("id"), F.col("item").alias("text")).mapInArrow(_places(least), "key long, id long, place int, size int"), "item-windows")
    marks = marks.withColumnRenamed("id", "item_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a common window's documents are dealt over tasks
    step = lambda places, i: F.when(i + 1 < F.size(places), F.least(F.get(places, i + 1) - F.get(places, i), F.lit(least))).otherwise(F.lit(least))
    shared_ = seeds.join(marks, ["key", "salt"]).groupBy("id", "item_id", "size").agg(F.array_sort(F.collect_set("place")).alias("p"))
    reach = F.aggregate(F.transform("p", lambda _, i: step(F.col("p"), i)), F.lit(0), lambda a, x: a + x)
    pairs = stored(shared_.where(reach >= threshold * F.col("size")).select("id", "item_id").distinct(), "pairs")
    once = once.join(pairs.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    whole = pairs.join(items, "item_id").join(once, "id").select("id", "text", "item_id", "item")
    hits = whole.mapInArrow(_pairwise(least, threshold), f"id binary, hit {HITS[6:-1]}").groupBy("id").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    hits = stored(hits.withColumnRenamed("id", "_text_key"), "hits")
    out = docs.withColumn("_text_key", text_key).join(hits, "_text_key", "left").drop("_text_key")
    return out.withColumn("hits", F.coalesce("hits", F.array().cast(HITS)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per document and benchmark item that it contains: doc_id, item_id, coverage, n_tiles, longest."""
    rows = with_hits(docs, benchmark, id_col=id_col, **how).where(F.size("hits") > 0)
    return rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode("hits").alias("h")).select("doc_id", "h.*")
