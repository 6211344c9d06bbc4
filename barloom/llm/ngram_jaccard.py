"""Near-duplicate join on word n-grams: MinHash banding for candidates, full n-gram sets for the verdict."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocked, components, link_summary, once_a_task, renamed, runs, sliced, stored

_U = np.uint64


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = Hashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word n-grams; a shorter text is one gram of all its words."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return np.unique(mixed(out))


@lru_cache
def banding(similarity: float, recall: float, hashes: int = 200) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands reach the recall for pairs at the similarity within so many hashes.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands.
    """
    best = None
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


def band_hashes(grams: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """One 64-bit hash per band of the minima of rows random hash functions."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * _U(2) + _U(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), 4096):
        part = grams[start : start + 4096]
        np.minimum(least, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        out = mixed(out * _U(0x9E3779B97F4A7C15) + column)
    return out


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in sliced(batches, "text"):
            size, fp1, fp2, sigs = [], [], [], []
            for text in batch.column("text").to_pylist():
                grams = shingles(text, n)
                fp = xxhash.xxh3_128_digest(grams.tobytes())
                if fp not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[fp] = band_hashes(grams, bands, rows).astype(np.int64).tolist() if len(grams) else []
                size.append(len(grams))
                fp1.append(int.from_bytes(fp[:8], "big", signed=True))
                fp2.append(int.from_bytes(fp[8:], "big", signed=True))
                sigs.append(known[fp])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x, pa.int64()) for x in (size, fp1, fp2)), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_grams", "fp1", "fp2", "bands"],
            )

    return run


def common_grams(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left x right matrix of the sizes of set intersections, by products of 0/1 blocks of shared grams."""
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[gram]
    which, gram = which[use], column[gram[use]]
    order = np.argsort(gram, kind="stable")
    which, gram = which[order], gram[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(gram, [start, start + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[which[a:b], gram[a:b] - start] = 1
        out += x[left] @ x[right].T
    return out.astype(np.int64)


def _verify(n: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_out, cnt_out, root_out = [], [], []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids_out, cnt_out, root_out)], names=["node", "cnt", "root"])
            for x in (ids_out, cnt_out, root_out):
                x.clear()
            return out

        for group in runs(batches, ["bucket", "bi", "bj"]):
            ids, first = np.unique(group.column("node").to_numpy(), return_index=True)  # repeated rows of a document
            if len(ids) < 2:
                continue
            group = group.take(pa.array(first))
            size, blk = group.column("copies").to_numpy(), group.column("blk").to_numpy()
            bands = np.array(group.column("bands").to_pylist(), np.int64)
            sets = [shingles(t, n) for t in group.column("text").to_pylist()]
            length = np.array([len(s) for s in sets])
            bi, bj, band = (group.column(c)[0].as_py() for c in ("bi", "bj", "band"))
            left, right = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
            if len(ids) <= 6:
                pairs = [(x, y) for x in left for y in right if (x < y or bi != bj)]
                common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in pairs])
                i, j = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            else:
                full = common_grams(sets, left, right)
                a, b = np.nonzero(full * (1 + similarity) >= similarity * (length[left][:, None] + length[right][None, :]) - 1e-6)
                i, j, common = left[a], right[b], full[a, b]
                if bi == bj:
                    up = i < j
                    i, j, common = i[up], j[up], common[up]
            if not len(i):
                continue
            ok = common / np.maximum(1, length[i] + length[j] - common) >= similarity
            i, j = i[ok], j[ok]
            mine = np.zeros(len(i), bool)
            for s in range(0, len(i), 65536):  # a pair counts in the first band that it shares only
                mine[s : s + 65536] = (bands[i[s : s + 65536]] == bands[j[s : s + 65536]]).argmax(axis=1) == band
            i, j = i[mine], j[mine]
            if len(i):
                cnt, root = link_summary(ids, size, i, j)
                linked = cnt > 0
                ids_out.append(ids[linked])
                cnt_out.append(cnt[linked])
                root_out.append(root[linked])
                if len(ids_out) > 2000:
                    yield flush()
        if ids_out:
            yield flush()

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, recall: float = 0.99995,
    block_rows: int = 512, block_grams: int = 400_000,
) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, text_id, kept, text_hash (Spark's xxhash64 of the text).

    Words are runs of non-space; n-grams of words make a text's set. Texts with equal sets enter
    once (text_id: their smallest doc_id). Banding, chosen for ``recall`` at the given similarity,
    finds candidates among class representatives; all pairs in a bucket are verified on the full
    sets by exact Jaccard >= similarity. Buckets with the same members are verified once; large
    ones are cut into pairs of blocks, and only sums and star edges leave a task, never all pairs.
    n_links counts the other rows whose text is linked directly (copies included), class_id is the
    smallest doc_id reachable by links, kept marks that document. Links are between texts, so rows
    with one doc_id and different texts each have their own.

    A text shorter than n words is one gram of all its words. Texts without a word (null, empty)
    link with nothing: class and text are their own doc_id. Rows with a null doc_id take no part:
    null class and text, no links, kept. Repeated rows count as copies. A very long text is one set
    of all its grams; large sets are met in smaller blocks.
    """
    bands, rows = banding(similarity, recall)
    base = renamed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    signed = stored(
        base.mapInArrow(_sign(n, bands, rows), "doc_id long, text_hash long, n_grams long, fp1 long, fp2 long, bands array<long>"), "signatures"
    )
    alive = F.col("doc_id").isNotNull() & (F.col("n_grams") > 0)
    live = signed.where(alive)
    classes = stored(  # node: a number of the class, fixed as the table is written
        live.groupBy("fp1", "fp2").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("r"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")
        ).select(F.monotonically_increasing_id().alias("node"), "fp1", "fp2", F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("rep_hash"), "copies", "n_grams", "bands"),
        "classes",
    )
    banded = classes.select("node", "n_grams", F.posexplode("bands").alias("band", "bucket"))
    token = F.xxhash64("node")
    same = (
        banded.groupBy("bucket").agg(
            F.count("*").alias("members"), F.sum("n_grams").alias("grams"), F.min("band").alias("band"),
            F.bit_xor(token).alias("x"), F.sum((token % (1 << 31))).alias("s"),
        )
        .where("members > 1")
        .groupBy("members", "x", "s").agg(F.min(F.struct("band", "bucket", "grams")).alias("b"))
    )
    buckets = stored(
        same.select(
            "b.bucket", "b.band",
            F.greatest(F.ceil(F.col("members") / block_rows), F.ceil(F.col("b.grams") / block_grams), F.lit(1)).cast("int").alias("blocks"),
        ),
        "buckets",
    )
    of_node = (
        banded.select("node", "bucket").join(buckets, "bucket")
        .groupBy("node").agg(F.collect_list(F.struct("bucket", "band", "blocks")).alias("b"))  # at most one bucket a band
        .join(classes.select("node", "rep", "rep_hash", "copies", "bands"), "node")
    )
    # one text of each representative: repeated rows go once a task to the join, and once on from there
    texts = once_a_task(base.where("doc_id is not null"), "doc_id", "text_hash")
    met = texts.join(of_node, (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).dropDuplicates(["doc_id", "text_hash"])
    meet = met.select("node", "copies", "bands", "text", F.explode("b").alias("b")).select("node", "copies", "bands", "text", "b.bucket", "b.band", "b.blocks")
    links = stored(
        blocked(meet, ["bucket"], "blocks", "node").mapInArrow(_verify(n, similarity), "node long, cnt long, root long"), "links"
    )
    reach = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    smallest = reach.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    about = stored(
        classes.select("node", "fp1", "fp2", "rep", "copies")
        .join(links.groupBy("node").agg(F.sum("cnt").alias("cnt")), "node", "left")
        .join(reach.join(smallest, "component").select("node", "class_id"), "node", "left")
        .select("fp1", "fp2", "rep", (F.col("copies") - 1 + F.coalesce("cnt", F.lit(0))).alias("n_links"), F.coalesce("class_id", "rep").alias("class_id")),
        "class-links",
    )
    out = live.select("doc_id", "text_hash", "fp1", "fp2").join(about, ["fp1", "fp2"]).select(
        "doc_id", "class_id", "n_links", F.col("rep").alias("text_id"), (F.col("doc_id") == F.col("class_id")).alias("kept"), "text_hash"
    )
    alone = signed.where(~alive).select(  # apart from the join, where all rows without a word would meet under one key
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("text_id"), F.lit(True).alias("kept"), "text_hash"
    )
    return out.unionByName(alone)
