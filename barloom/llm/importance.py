"""Importance resampling towards a target: hashed n-gram models, repeated n-grams found in word-id suffix arrays."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ranked, renamed, sliced, stored

#: Digits, lower-case letters and everything beyond ASCII make words.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BREAK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` ids that follow (or more), by prefix doubling."""
    rank, k = ids.astype(np.int64), 1
    while k < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-k] = rank[k:] + 1
        rank, k = np.unique(rank * (len(rank) + rank.max() + 2) + after, return_inverse=True)[1].astype(np.int64), 2 * k
    return np.argsort(rank, kind="stable")


def common_prefix(ids: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """Per suffix but the first in sa: the ids, ``depth`` at most, that it shares with the one before."""
    out, same = np.zeros(max(0, len(sa) - 1), np.int64), np.ones(max(0, len(sa) - 1), bool)
    a, b = sa[:-1].copy(), sa[1:].copy()
    for _ in range(depth):
        same &= np.maximum(a, b) < len(ids)
        same[same] = ids[a[same]] == ids[b[same]]
        out += same
        a += 1
        b += 1
    return out


def segment_buckets(segments: list[tuple[int, list[str]]], n: int, buckets: int) -> list[np.ndarray]:
    """The buckets of each segment's n-grams of 1..n words, from one suffix array over all segments.

    A segment is its words and how many of them at the front only give context: an n-gram counts if it
    ends behind those. Every segment ends with an id of its own, so no repeated run spans two of them. Each
    run of suffixes that share k words is one k-gram: it is hashed once and its bucket is scattered
    back to all its places.
    """
    size = np.array([len(w) + 1 for _, w in segments], np.int64)
    start = np.cumsum(size) - size
    index: dict[str, int] = {}
    ids = np.empty(int(size.sum()), np.int64)
    words: list[str] = []
    for (_, w), s in zip(segments, start):
        ids[s : s + len(w)] = [index.setdefault(x, len(index)) for x in w]
        words += w
        words.append("")
    ids[start + size - 1] = len(index) + np.arange(len(segments))
    place = np.arange(len(ids)) - np.repeat(start, size)
    left, ahead = np.repeat(size, size) - 1 - place, place - np.repeat([c for c, _ in segments], size)
    sa = suffix_array(ids, n)
    lcp = common_prefix(ids, sa, n)
    found = np.full((n, len(ids)), -1, np.int64)
    for k in range(1, n + 1):
        first = np.concatenate([[True], lcp < k])
        run = np.cumsum(first) - 1
        at = sa[first]
        hashed = np.zeros(len(at), np.int64)
        use = np.flatnonzero(left[at] >= k)
        hashed[use] = [zlib.crc32(" ".join(words[p : p + k]).encode("utf-8", "replace")) % buckets for p in at[use]]
        counts = (left >= k) & (ahead + k > 0)
        found[k - 1, sa] = hashed[run]
        found[k - 1, ~counts] = -1
    out = []
    for s, m in zip(start, size):
        own = found[:, s : s + m].ravel()
        out.append(own[own >= 0].astype(np.int32))
    return out


def pieces(text: str, most: int, n: int) -> Iterator[tuple[int, list[str]]]:
    """The words of a text in pieces of about ``most`` characters, each after the n - 1 words before it."""
    at, before = 0, []
    while True:
        cut = BREAK.search(text, at + most)
        own = WORD.findall(text, at, cut.start() if cut else len(text))
        yield len(before), before + own
        if not cut:
            return
        at, before = cut.start(), (before + own)[1 - n :] if n > 1 else []


def _features(n: int, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", most):
            got: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            n_words = np.zeros(batch.num_rows, np.int64)
            held: list[tuple[int, tuple[int, list[str]]]] = []
            room = most

            def flush():
                if held:
                    for (i, _), b in zip(held, segment_buckets([s for _, s in held], n, buckets)):
                        got[i].append(b)
                    held.clear()

            for i, text in enumerate(batch.column("text").to_pylist()):
                for segment in pieces(text or "", most, n):
                    held.append((i, segment))
                    n_words[i] += len(segment[1]) - segment[0]
                    room -= sum(map(len, segment[1]))
                    if room < 0:
                        flush()
                        room = most
            flush()
            flat = [np.concatenate(g) for g in got]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*flat, np.zeros(0, np.int32)])))],
                names=["doc_id", "n_words", "buckets"],
            )

    return run


def features(docs: DataFrame, n: int, buckets: int, block_chars: int = 2 << 20) -> DataFrame:
    """(doc_id, n_words, buckets array<int>) per row of (doc_id, text): the bucket of every n-gram of 1..n words, repeats included.

    Suffix arrays are over blocks of about block_chars characters within a partition, so memory does
    not grow with a text; a longer text goes through in pieces.
    """
    rows = docs.select("doc_id", ascii_lower(F.col("text")).alias("text"))
    return rows.mapInArrow(_features(n, buckets, block_chars), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, buckets array<int>")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows; a task sends one count for each bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: the log ratio of its smoothed shares of target and source, in whole thousandths, rounded down."""
    b = len(source)
    s_all, t_all = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weigh(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            col = batch.column("buckets")
            ends = col.offsets.to_numpy().astype(np.int64)
            total = np.concatenate([[0], np.cumsum(gain[col.flatten().to_numpy()])])
            ends -= ends[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(np.diff(ends)), pa.array(total[ends[1:]] - total[ends[:-1]])],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return run


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    n: int = 1, buckets: int = 10_000, share: int = 10, min_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """Per input row: doc_id, n_features, weight, score, rank (null: not drawn), all long but doc_id.

    Features are all runs of 1..n words; each falls into a bucket by its CRC-32. A bucket's gain is the
    log ratio of its share in the target's texts and in docs; a row's weight is the sum of its
    features' gains, its score adds Gumbel noise from a hash of seed and id. Of the rows with min_words words, the
    share (percent) with the highest scores is drawn, which is a draw without replacement by importance;
    ties go to the smaller id, a null id last. A null or empty text has no features and weight 0.
    Repeated rows count, and are drawn, one by one. Without target texts all gains come from the
    source alone. Very long texts are read whole.
    """
    base = renamed(docs, doc_id=id_col, text=text_col)
    aims = target.select(F.lit(0).alias("doc_id"), F.col(f"`{target_text_col}`").alias("text"))
    found = stored(features(base, n, buckets), "importance-features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(aims, n, buckets), buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    kind = base.schema["doc_id"].dataType.simpleString()
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = found.mapInArrow(_weigh(shared), f"doc_id {kind}, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise)
    enough = F.col("n_words") >= min_words
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    placed = ranked(scored.where(enough), order, "importance-ranges")
    drawn = share * found.where(enough).count() // 100
    out = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("long")).drop("place", "total")
    return out.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).drop("n_words")


#: CRC-32 in SQL: its table from the polynomial, then a byte at a time. Needs a list of bytes.
CRC_SQL = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an SQL text, in a query that joins crc_table."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda b: (strpos('0123456789ABCDEF', substr(hex(encode({text})), 2*b::INT+1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({text})), 2*b::INT+2, 1)) - 1)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}::BIGINT[], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = f"""WITH {CRC_SQL},
texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
aims AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark WHERE text IS NOT NULL),
places AS (SELECT r, unnest(w) AS w FROM texts),
hashed AS (SELECT w, {crc_sql('w')} % 10000 AS bucket FROM (SELECT w FROM places UNION SELECT w FROM aims), crc_table),
source AS (SELECT bucket, count(*) AS s FROM places JOIN hashed USING (w) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS n FROM aims JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM places)::DOUBLE + 10000 AS s_all, (SELECT count(*) FROM aims)::DOUBLE + 10000 AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(n, 0)::DOUBLE + 1) * s_all / ((s::DOUBLE + 1) * t_all)))::BIGINT AS g FROM source LEFT JOIN target USING (bucket), sums),
weights AS (SELECT r, sum(g)::BIGINT AS weight FROM places JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM texts LEFT JOIN weights USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END::BIGINT AS rank FROM scored LEFT JOIN placed USING (r)"""
