"""Line deduplication with two Bloom filters: once-seen and twice-seen line keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed, sliced, stored

SPACE = " \t\n\x0b\x0c\r"
PROBES = 3
#: Bits of a filter that one row of the merge carries.
SEGMENT = 1 << 19


def line_key(line: str) -> bytes:
    """The line without white space at its ends, A-Z lower-cased, as UTF-8."""
    return line.strip(SPACE).encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only


def keys_of(text: str | None, min_chars: int) -> list[bytes]:
    """The distinct keys of a text with at least min_chars code points."""
    if not text or len(text) < min_chars:
        return []
    return list({line_key(x) for x in text.split("\n") if len(x) >= min_chars and len(x.strip(SPACE)) >= min_chars})


def positions(keys: list[bytes], bits: int) -> np.ndarray:
    """PROBES bit positions per key (rows) by double hashing one 64-bit hash."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * b[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def filter_bits(lines: int, most: int) -> int:
    """A power of two: about 16 bits a line, but never more than ``most``."""
    bits = SEGMENT
    while bits < 16 * lines and bits < most:
        bits *= 2
    return bits


def _partial(bits: int, min_chars: int):
    """Per task: the bits of keys in one document at least (b1) and in two at least (b2), by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b1, b2, any_key = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), False
        for batch in batches:
            for text in batch.column(0):
                keys = keys_of(text.as_py(), min_chars)
                if not keys:
                    continue
                any_key = True
                at = positions(keys, bits)
                byte, mask = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
                seen = ((b1[byte] & mask) != 0).all(axis=1)
                if seen.any():
                    np.bitwise_or.at(b2, byte[seen].ravel(), mask[seen].ravel())
                np.bitwise_or.at(b1, byte.ravel(), mask.ravel())
        if any_key:
            step = SEGMENT // 8
            for s in range(bits // SEGMENT):
                x = b1[s * step : (s + 1) * step]
                if x.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([b2[s * step : (s + 1) * step].tobytes()], pa.binary())],
                        names=["segment", "b1", "b2"],
                    )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OR the parts of each segment; a bit set by two parts also goes to the twice-seen filter."""
    parts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for s, x, y in zip(*(batch.column(i) for i in range(3))):
            a, b = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
            have = parts.get(s.as_py())
            if have is None:
                parts[s.as_py()] = [a.copy(), b.copy()]
            else:
                have[1] |= b | (have[0] & a)
                have[0] |= a
    for s, (a, b) in parts.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([s], pa.int32()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["segment", "b1", "b2"]
        )


def twice_seen(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The twice-seen filter of all documents (text): every key in two documents has its bits set.

    Two merge rounds (first within random groups, then by segment) keep what one task reads small.
    The driver gets the merged filter only, bits / 8 bytes, which ``filter_bits`` bounds.
    """
    schema = "segment int, b1 binary, b2 binary"
    part = docs.select("text").mapInArrow(_partial(bits, min_chars), schema)
    rounds = part.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(16)))
    once = rounds.repartition("segment", "g").drop("g").mapInArrow(_merge, schema)
    full = once.repartition("segment").mapInArrow(_merge, schema).select("segment", "b2")
    out = np.zeros(bits // 8, np.uint8)
    step = SEGMENT // 8
    for row in full.toLocalIterator():
        out[row["segment"] * step : (row["segment"] + 1) * step] = np.frombuffer(row["b2"], np.uint8)
    return out


def _suspects(shared, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b2 = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, rows, found = [], [], []
            for doc_id, text, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                keys = keys_of(text.as_py(), min_chars)
                if not keys:
                    continue
                at = positions(keys, bits)
                hit = ((b2[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
                for i in np.flatnonzero(hit):
                    ids.append(doc_id)
                    rows.append(row)
                    found.append(hashlib.sha256(keys[i]).digest()[:16])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())], names=["key", "doc_id", "text_hash"])

    return run


def _keep(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column("_text"), batch.column("_drop")):
                text, drop = text.as_py() or "", drop.as_py()
                lines = text.split("\n")
                n_lines.append(len(lines))
                if drop:
                    gone = set(drop)
                    lines = [
                        x for x in lines
                        if len(x) < min_chars or len(x.strip(SPACE)) < min_chars or hashlib.sha256(line_key(x)).digest()[:16] not in gone
                    ]
                    text = "\n".join(lines)
                kept.append(text)
                n_dropped.append(n_lines[-1] - len(lines))
            rest = [c for c in batch.schema.names if c not in ("_text", "_drop")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[*rest, "kept", "n_lines", "n_dropped"],
            )

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
    max_filter_bits: int = 1 << 27, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per input row: doc_id, the carried columns, kept (text), n_lines, n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least
    min_chars code points that min_docs distinct doc_ids hold lose all their lines, except in the
    largest doc_id that holds them. The first pass fills a once-seen and a twice-seen Bloom filter;
    in the second pass only keys that the twice-seen filter knows leave their task, as (128 bits of
    SHA-256, doc_id), and are counted exactly. The filters never exceed max_filter_bits, so what is
    broadcast is bounded; beyond about max_filter_bits / 16 distinct lines they pass more unique
    lines to the exact step, which costs shuffle but changes no result.

    Null or empty text is one empty line, never dropped. Rows with a null doc_id count as no
    document and keep no line that others keep. Repeated rows with one doc_id count once and are
    treated alike. A document whose lines all go keeps the empty text. Very long texts and lines are
    taken whole; a task holds the keys of one text at a time.
    """
    base = renamed(docs, doc_id=id_col, text=text_col)
    n = base.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n")).first()["n"] or 0
    bits = filter_bits(int(n), max_filter_bits)
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(base, bits, min_chars).tobytes())
    hashed = base.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    suspects = stored(hashed.mapInArrow(_suspects(shared, bits, min_chars), "key binary, doc_id long, text_hash long"), "suspect-lines")
    drops = stored(  # a table of its own, so that the join below can split a hot line's rows
        suspects.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("key").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs),
        "repeated-lines",
    )
    lost = (  # by id and text, so that a set holds the lines of one text, even where many rows have no id
        suspects.join(drops, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("_drop"))
        .withColumnsRenamed({"doc_id": "_lost_id", "text_hash": "_lost_hash"})
    )
    extra = [F.col(f"`{c}`") for c in carry]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *extra, F.col(f"`{text_col}`").alias("_text"))
    same = rows["doc_id"].eqNullSafe(lost["_lost_id"]) & (F.xxhash64(rows["_text"]) == lost["_lost_hash"])
    joined = rows.join(lost, same, "left").drop("_lost_id", "_lost_hash")
    fields = [f for f in joined.schema.fields if f.name not in ("_text", "_drop")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "kept string", "n_lines long", "n_dropped long"])
    return joined.mapInArrow(_keep(min_chars), schema)


ORACLE = r"""
with l as (
  select doc_id, row_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from (select doc_id, text, row_number() over () as row_id from documents)),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
d as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select k.doc_id, count(*) as n_lines, count(d.key) filter (k.doc_id is distinct from d.keeper) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (d.key is null or k.doc_id is not distinct from d.keeper), '')) as kept_sha256
from k left join d on d.key = k.key group by k.row_id, k.doc_id"""
