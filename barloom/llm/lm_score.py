"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Counting and looking up go by chunks of about a million tokens. A chunk keeps its token sequence
and asks for the corpus counts of its distinct unigrams and bigrams: sorted hashes, delta-coded,
cut by hash range into parts. Each part adds up the counts of all chunks and answers every chunk
in the order it asked. So a frequent n-gram costs a row entry per chunk, not per occurrence, no
table of counts is broadcast or collected, and both exchanges are dealt evenly by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed, runs, stored

_U = np.uint64
#: Hashes of the end of a text, which is counted as a token, and of the place before its start, a context only.
END, START = 1, 2
TRAIN, TUNE, HELD = 0, 1, 2
#: Half octaves: the grid on which held-out events are counted for the mixture weights.
GRID = 2
NONE = 9999


class Hashes(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[token] = max(3, xxhash.xxh3_64_intdigest(token))
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at runs of space and \\t \\n \\v \\f \\r."""
    return text.encode("utf-8", "replace").lower().split() if text else []  # bytes.lower() and split() know ASCII only


def _chunks(limit: int):
    """Chunk rows from rows (doc_id, text, fold): ids, lengths, folds, sorted distinct token hashes, and the sequence as places in them.

    The tune documents are in the chunk (their counts are part of the training counts), and again
    in a row of their own with the number -1 - chunk, for the mixture weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, number = Hashes(), TaskContext.get().partitionId(), 0
        ids, folds, lens, seq = [], [], [], []

        def row(chunk, pick):
            uni, inv = np.unique(np.concatenate([seq[i] for i in pick]), return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int64()), pa.array([[ids[i] for i in pick]], pa.list_(pa.int64())), pa.array([[lens[i] for i in pick]], pa.list_(pa.int32())),
                    pa.array([[folds[i] for i in pick]], pa.list_(pa.int32())), pa.array([packed(np.diff(uni, prepend=_U(0)))], pa.binary()), pa.array([packed(inv.astype(np.uint32))], pa.binary()),
                ],
                names=["chunk", "ids", "lens", "folds", "uni", "inv"],
            )

        def flush():
            nonlocal number
            chunk = (part << 32) + number
            number += 1
            yield row(chunk, range(len(ids)))
            if tune := [i for i, f in enumerate(folds) if f == TUNE]:
                yield row(-1 - chunk, tune)
            for x in (ids, folds, lens, seq):
                x.clear()

        held = 0
        for batch in batches:
            for doc_id, text, fold in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("fold").to_pylist()):
                words = tokens(text.as_py())
                h = np.empty(len(words) + 1, np.uint64)
                h[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                h[-1] = END
                ids.append(doc_id)
                folds.append(fold)
                lens.append(len(h))
                seq.append(h)
                held += len(h)
                if held >= limit:
                    yield from flush()
                    held = 0
        if ids:
            yield from flush()

    return run


def _sequence(uni: bytes, inv: bytes, lens: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, their places, bigram hashes, starts of texts)."""
    table, place = np.cumsum(unpacked(uni, np.uint64), dtype=np.uint64), unpacked(inv, np.uint32)
    h = table[place]
    starts = np.cumsum([0, *lens[:-1]])
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    before[starts] = START
    return table, place, _mixed(before * _U(0x9E3779B97F4A7C15) + h), starts


def _ask(parts: int):
    """Requests of each chunk: per order and part of the hash range the sorted keys and their counts in training texts."""
    shift = _U(64 - (parts - 1).bit_length()) if parts > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                chunk, lens, folds, uni, inv = (batch.column(c)[r].as_py() for c in ("chunk", "lens", "folds", "uni", "inv"))
                table, place, pairs, _ = _sequence(uni, inv, lens)
                fold = np.repeat(folds, lens) if chunk >= 0 else np.full(len(place), HELD)
                key2, place2 = np.unique(pairs, return_inverse=True)
                out = []
                for order, keys, at in ((1, table, place), (2, key2, place2)):
                    counts = np.stack([np.bincount(at[fold == f], minlength=len(keys)) for f in (TRAIN, TUNE)]).astype(np.uint32)
                    cut = np.searchsorted((keys >> shift).astype(np.int64), np.arange(parts + 1)) if parts > 1 else np.array([0, len(keys)])
                    for p in np.flatnonzero(np.diff(cut)):
                        a, b = cut[p], cut[p + 1]
                        out.append((order, int(p), chunk, packed(np.diff(keys[a:b], prepend=_U(0))), packed(counts[:, a:b].ravel()) if counts[:, a:b].any() else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["ord", "part", "chunk", "keys", "counts"],
                )

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (order, part): add up the counts of equal keys and answer every chunk in its own order.

    Chunks of texts get counts over all training texts, tune rows those without the tune texts. A
    row without chunk carries the part's totals of unigrams.
    """
    for group in runs(batches, ["ord", "part"]):
        order, part = group.column("ord")[0].as_py(), group.column("part")[0].as_py()
        keys = [np.cumsum(unpacked(k.as_py(), np.uint64), dtype=np.uint64) for k in group.column("keys")]
        size = [len(k) for k in keys]
        counts = [unpacked(c.as_py(), np.uint32).reshape(2, -1) if c.is_valid else np.zeros((2, n), np.uint32) for c, n in zip(group.column("counts"), size)]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        rest, tune = (np.bincount(at, weights=np.concatenate([c[k] for c in counts])).astype(np.uint64) for k in (0, 1))
        chunks = group.column("chunk").to_pylist()
        every = rest + tune
        out, end = [], 0
        for chunk, n in zip(chunks, size):
            where = at[end : end + n]
            out.append((chunk, order, part, packed((every if chunk >= 0 else rest)[where]), None, None, None, None))
            end += n
        if order == 1:
            out.append((None, order, part, None, int(every.sum()), int((every > 0).sum()), int(rest.sum()), int((rest > 0).sum())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4))],
            names=["chunk", "ord", "part", "found", "n_all", "v_all", "n_rest", "v_rest"],
        )


def _answered(batches: Iterator[pa.RecordBatch]):
    """Per chunk: its row, counts of each token, of each bigram, and of each bigram's context; starts of texts."""
    for group in runs(batches, ["chunk"]):
        order = group.column("ord").to_numpy()
        head = int(np.flatnonzero(order == 0)[0])
        row = {c: group.column(c)[head].as_py() for c in ("chunk", "ids", "lens", "folds", "uni", "inv")}
        found = group.column("found")
        part = group.column("part").to_numpy()
        of = lambda k: np.concatenate([unpacked(found[int(i)].as_py(), np.uint64) for i in sorted(np.flatnonzero(order == k), key=lambda i: part[i])]).astype(np.float64)  # noqa: B023, E731
        table, place, pairs, starts = _sequence(row["uni"], row["inv"], row["lens"])
        unigram = of(1)
        c1 = unigram[place]
        c2 = of(2)[np.unique(pairs, return_inverse=True)[1]]
        context = np.concatenate([np.zeros(1), c1[:-1]])
        context[starts] = unigram[np.searchsorted(table, _U(END))]  # as many starts as ends
        yield row, c1, c2, context, starts


def bucket(context: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for an unseen context, else 1 + the octave of its count."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _events(n_rest: int):
    """Held-out events of the tune rows on a grid: bucket, bigram and unigram estimate; number and mean logarithms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c1, c2, context, _ in _answered(batches):
            with np.errstate(divide="ignore", invalid="ignore"):
                log2 = np.where(c2 > 0, np.log2(c2 / context), 0.0)
                log1 = np.where(c1 > 0, np.log2(c1 / max(1, n_rest)), 0.0)
            key = np.stack([
                bucket(context), np.where(c2 > 0, np.floor(log2 * GRID), NONE).astype(np.int64), np.where(c1 > 0, np.floor(log1 * GRID), NONE).astype(np.int64),
            ])
            kind, at, n = np.unique(key, axis=1, return_inverse=True, return_counts=True)
            at = at.ravel()
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(kind[i].astype(np.int32)) for i in range(3)), pa.array(n.astype(np.int64)), pa.array(np.bincount(at, weights=log2)), pa.array(np.bincount(at, weights=log1))],
                names=["b", "q2", "q1", "n", "log2", "log1"],
            )

    return run


@dataclass
class Mixture:
    """Weight of the bigram estimate per context bucket, and of the unigram against the uniform estimate."""

    bigram: np.ndarray
    unigram: float


def expectation_maximisation(b, p2, p1, n, uniform: float, steps: int = 200) -> Mixture:
    """Weights that maximise the likelihood of n held-out events with bigram estimate p2 in context
    bucket b and unigram estimate p1. An unseen context (bucket 0) has weight 0; buckets without
    events take the weight of the next lower one that has some. One pseudo-event a bucket (and one in all), explained
    by the lower order, keeps every weight below 1, so that no continuation ends with probability 0."""
    size = 64
    w, u = np.full(size, 0.5), 0.9
    w[0] = 0.0
    total = np.bincount(b, weights=n, minlength=size)
    for _ in range(steps):
        low = u * p1 + (1 - u) * uniform
        p = w[b] * p2 + (1 - w[b]) * low
        high = n * w[b] * p2 / p
        new = np.where(total > 0, np.bincount(b, weights=high, minlength=size) / (total + 1), w)
        new[0] = 0.0
        rest = n - high
        mass = rest.sum()
        v = float((rest * u * p1 / low).sum() / (mass + 1)) if mass > 0 else u
        done = max(np.abs(new - w).max(), abs(v - u)) < 1e-7
        w, u = new, v
        if done:
            break
    for k in range(2, size):
        if not total[k]:
            w[k] = w[k - 1]
    return Mixture(w, u)


def _score(mixture: Mixture, n_all: int, v_all: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, c1, c2, context, starts in _answered(batches):
            weight = mixture.bigram[bucket(context)]
            low = mixture.unigram * c1 / max(1, n_all) + (1 - mixture.unigram) / (v_all + 1)
            p = weight * c2 / np.maximum(context, 1) + (1 - weight) * low
            base = np.log10((c1 + 1) / (n_all + v_all + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()), pa.array([f == HELD for f in row["folds"]]), pa.array(row["lens"], pa.int64()),
                    pa.array(np.add.reduceat((c1 > 0).astype(np.int64), starts)), pa.array(np.full(len(starts), n_all, np.int64)),
                    pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(p), starts)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, tune: int = 5,
    chunk_tokens: int = 1_000_000, part_keys: int = 2_000_000,
) -> DataFrame:
    """Per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id as text) mod folds is ``held`` are held out; all others train. The
    model is P(w | v) = L(c(v)) c(v w) / c(v) + (1 - L) (M c(w) / N + (1 - M) / (V + 1)), with one L for each
    octave of the context's count and 0 for unseen contexts. L and M come from expectation
    maximisation on the training documents of fold ``tune``, under the counts of the others (their
    events are counted on a grid of half octaves of the two estimates); the scores use the counts
    of all training documents. score is the log10 probability of all tokens, the end included, the
    start being the first context; base_score adds up log10((c + 1) / (N + V + 1)), n_known the tokens with c > 0.

    Null or empty text is the end token alone. A null doc_id counts as the empty text in the fold
    rule. Repeated rows count as often as they occur. A very long text is one
    document of a chunk of its own size. Without training rows every estimate is
    uniform, so both scores are 0.
    """
    spark = docs.sparkSession
    base = renamed(docs, doc_id=id_col, text=text_col)
    mod = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    fold = F.when(mod == held, HELD).when(mod == tune, TUNE).otherwise(TRAIN)
    rows = base.select(F.col("doc_id").cast("long"), "text", fold.cast("int").alias("fold"))
    chunks = stored(rows.mapInArrow(_chunks(chunk_tokens), "chunk long, ids array<long>, lens array<int>, folds array<int>, uni binary, inv binary"), "lm-chunks")
    n = chunks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    parts = 1 << max(0, (n // part_keys).bit_length())
    asked = chunks.mapInArrow(_ask(parts), "ord int, part int, chunk long, keys binary, counts binary")
    dealt = asked.repartition("ord", "part").sortWithinPartitions("ord", "part")
    answers = stored(
        dealt.mapInArrow(_answer, "chunk long, ord int, part int, found binary, n_all long, v_all long, n_rest long, v_rest long"), "lm-counts"
    )
    total = answers.where("chunk is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_all", "v_all", "n_rest", "v_rest")]).first()
    both = chunks.withColumns({"ord": F.lit(0), "part": F.lit(0), "found": F.lit(None).cast("binary")}).unionByName(
        answers.where("chunk is not null").select("chunk", "ord", "part", "found"), allowMissingColumns=True
    )
    meet = lambda rows: rows.repartition("chunk").sortWithinPartitions("chunk", "ord", "part")
    events = (
        meet(both.where("chunk < 0")).mapInArrow(_events(total["n_rest"]), "b int, q2 int, q1 int, n long, log2 double, log1 double")
        .groupBy("b", "q2", "q1").agg(*[F.sum(c).alias(c) for c in ("n", "log2", "log1")])
        .collect()  # a grid of fixed size: octaves of contexts by half octaves of two estimates
    )
    get = lambda c: np.array([e[c] for e in events], np.float64)
    n_events = get("n")
    estimate = lambda q, log: np.where(get(q) == NONE, 0.0, np.exp2(get(log) / np.maximum(n_events, 1)))
    mixture = expectation_maximisation(get("b").astype(np.int64), estimate("q2", "log2"), estimate("q1", "log1"), n_events, 1.0 / (total["v_rest"] + 1))
    if not total["n_all"]:
        mixture = Mixture(np.zeros(64), 0.0)
    return meet(both.where("chunk >= 0")).mapInArrow(
        _score(mixture, total["n_all"], total["v_all"]),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
