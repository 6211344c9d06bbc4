"""Near-duplicate vectors: a subspace pigeonhole join finds candidates, double-precision cosines decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocked, components, link_summary, renamed, runs, stored

SLACK = 1e-9


@lru_cache
def rotation(dim: int, seed: int = 3) -> np.ndarray:
    """A fixed random orthogonal matrix: it spreads any vector's length evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def subspaces(dim: int, width: int) -> list[slice]:
    return [slice(a, min(a + width, dim)) for a in range(0, dim, width)]


def radii(dim: int, width: int, cosine: float) -> list[float]:
    """Each block's radius: unit vectors with that cosine lie within squared distance 2 - 2 cosine, so
    in one block at least within the share of it that the block has of the dimensions."""
    total = 2.0 - 2.0 * cosine
    return [math.sqrt(total * (s.stop - s.start) / dim) + SLACK for s in subspaces(dim, width)]


def usable(v) -> np.ndarray | None:
    if v is None or not len(v) or any(x is None for x in v):
        return None
    x = np.asarray(v, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def stored_form(x: np.ndarray) -> bytes:
    """Floats where that is exact, else doubles."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return (y if (y == x).all() else x).tobytes()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that can link as bytes of doubles, with two hashes; null otherwise."""
    for batch in batches:
        good = [usable(v) if label is not None and i is not None else None for i, label, v in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vec")))]
        data = [None if x is None else x.tobytes() for x in good]
        fp = [(None, None) if x is None else divmod(xxhash.xxh3_128_intdigest(x), 1 << 64) for x in data]
        half = lambda k: pa.array([None if f[k] is None else f[k] - (1 << 63) for f in fp], pa.int64())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), half(0), half(1), pa.array([None if x is None else stored_form(x) for x in good], pa.binary()), pa.array([0 if x is None else len(x) for x in good], pa.int32())],
            names=["vec_id", "label", "fp1", "fp2", "data", "dim"],
        )


def vectors(data: list[bytes], dim: int) -> np.ndarray:
    """Stored vectors as doubles; each is kept as floats where that is exact."""
    return np.array([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64) for x in data], np.float64)


def unit_vectors(data: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors; each is first scaled by a power of two, exactly, so that no square overflows or vanishes."""
    x = vectors(data, dim)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def grid_axes(n, group_rows: int, most: int = 3):
    """On how many coordinates of a block a group of n vectors is cut into cells: each leaves about 0.36 of
    the rows in the fullest cell, as cells are about as wide as a coordinate's deviation."""
    axes = F.lit(0)
    for k in range(most):
        axes = F.when(n * 0.36**k > group_rows, k + 1).otherwise(axes)
    return axes


def ahead(axes: int) -> list[tuple[int, int, int]]:
    """The own cell, and of each pair of opposite neighbour cells one."""
    steps = product(*[(-1, 0, 1) if k < axes else (0,) for k in range(3)])
    return [s for s in steps if s >= (0, 0, 0)]


CELL = ["label", "dim", "block", "cx", "cy", "cz"]


def _cells(width: int, cosine: float):
    """Rows of the range join. A group without grid axes is one cell for all blocks (block -1). Else each vector
    is once in its own cell of each block, and as a visitor in the neighbour cells ahead, if within the
    radius. Cells are as wide as the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, axes_of = batch.column("dim").to_numpy(), batch.column("axes").to_numpy()
            for dim, axes in {*zip(dims.tolist(), axes_of.tolist())}:
                rows = batch.filter(pa.array((dims == dim) & (axes_of == axes)))
                at, keys = [], []
                if not axes:
                    at.append(np.arange(rows.num_rows))
                    keys.append(np.tile([-1, 0, 0, 0, 0], (rows.num_rows, 1)))
                else:
                    y = unit_vectors(rows.column("data").to_pylist(), dim) @ rotation(dim)
                    for b, (block, r) in enumerate(zip(subspaces(dim, width), radii(dim, width, cosine))):
                        xyz = np.zeros((len(y), 3))
                        part = y[:, block][:, :axes]
                        xyz[:, : part.shape[1]] = part
                        cell = np.floor(xyz / r).astype(np.int64)
                        low, high = xyz - cell * r, (cell + 1) * r - xyz
                        for step in ahead(axes):
                            gap = sum((high if d > 0 else low)[:, k] ** 2 for k, d in enumerate(step) if d)
                            near = np.flatnonzero(np.broadcast_to(gap, len(y)) <= r * r + SLACK)
                            at.append(near)
                            fixed = lambda v: np.full((len(near), 1), v)  # noqa: B023, E731
                            keys.append(np.hstack([fixed(b), cell[near] + step, fixed(int(any(step)))]))
                at, keys = np.concatenate(at), np.concatenate(keys)
                take = rows.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*(take.column(c) for c in ("node", "label", "copies", "data", "dim")), *(pa.array(keys[:, k].astype(np.int32)) for k in range(5))],
                    names=["node", "label", "copies", "data", "dim", "block", "cx", "cy", "cz", "visitor"],
                )

    return run


class Tree:
    """Points split at medians of their widest coordinate; boxes of all nodes."""

    def __init__(self, points: np.ndarray, rows: np.ndarray, leaf: int):
        x = points[rows]
        self.rows, self.low, self.high, self.parts = rows, x.min(axis=0), x.max(axis=0), ()
        if len(rows) > leaf:
            order = np.argpartition(x[:, (self.high - self.low).argmax()], len(rows) // 2)
            self.parts = tuple(Tree(points, rows[o], leaf) for o in (order[: len(rows) // 2], order[len(rows) // 2 :]))


def meetings(points: np.ndarray, left: np.ndarray, right: np.ndarray | None, r2: float, leaf: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of rows (of left, of right) whose boxes come within the radius: all coordinates of the block count.
    Without right, pairs of left with itself, each once; one group may then be on both sides."""
    if not len(left) or right is not None and not len(right):
        return
    a = Tree(points, left, leaf)
    todo = [(a, a if right is None else Tree(points, right, leaf))]
    while todo:
        a, b = todo.pop()
        gap = np.maximum(0, np.maximum(a.low - b.high, b.low - a.high))
        if gap @ gap > r2:
            continue
        if a is b and a.parts:
            todo += [(a.parts[0], a.parts[0]), (a.parts[0], a.parts[1]), (a.parts[1], a.parts[1])]
        elif a.parts and len(a.rows) >= len(b.rows):
            todo += [(x, b) for x in a.parts]
        elif b.parts:
            todo += [(a, x) for x in b.parts]
        elif a.parts:
            todo += [(x, b) for x in a.parts]
        else:
            yield a.rows, b.rows


class Links:
    """Counts of partners and star edges of the pairs added so far; rows in the order of their nodes."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.total = copies, np.zeros(len(copies))
        self.root = np.arange(len(copies))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        n = len(self.total)
        self.total += np.bincount(i, weights=self.copies[j], minlength=n) + np.bincount(j, weights=self.copies[i], minlength=n)
        held = np.flatnonzero(self.root != np.arange(n))
        _, self.root = link_summary(np.arange(n), np.ones(n), np.concatenate([held, i]), np.concatenate([self.root[held], j]))


def _verify(width: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, [*CELL, "bi", "bj"]):
            if group.num_rows < 2:
                continue
            group = group.sort_by("node")
            nodes, copies, blk, visitor = (group.column(c).to_numpy() for c in ("node", "copies", "blk", "visitor"))
            dim, block, bi, bj = (group.column(c)[0].as_py() for c in ("dim", "block", "bi", "bj"))
            unit = unit_vectors(group.column("data").to_pylist(), dim)
            turned = unit @ rotation(dim)
            blocks, r2 = subspaces(dim, width), [r * r + SLACK for r in radii(dim, width, cosine)]
            links = Links(copies)
            # members with members and visitors; visitors do not meet each other here
            some = lambda k, v: np.flatnonzero((blk == k) & (visitor == v))  # noqa: B023, E731
            if bi == bj:
                sides = [(some(bi, 0), None), (some(bi, 0), some(bi, 1))]
            else:
                sides = [(some(bi, 0), np.flatnonzero(blk == bj)), (some(bi, 1), some(bj, 0))]
            for b in range(len(blocks)) if block < 0 else [block]:
                part = np.ascontiguousarray(turned[:, blocks[b]])
                for left, right in sides:
                    for rows, cols in meetings(part, left, right, r2[b]):
                        p, q = part[rows], part[cols]
                        d = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T
                        x, y = np.nonzero(d <= r2[b])
                        i, j = rows[x], cols[y]
                        if rows is cols:
                            i, j = i[x < y], j[x < y]
                        for e in range(b):  # a pair counts in the first block that finds it only
                            diff = turned[i][:, blocks[e]] - turned[j][:, blocks[e]]
                            new = (diff * diff).sum(1) > r2[e]
                            i, j = i[new], j[new]
                        ok = (unit[i] * unit[j]).sum(1) >= cosine
                        if ok.any():
                            links.add(i[ok], j[ok])
            linked = links.total > 0
            if linked.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[linked]), pa.array(links.total[linked].astype(np.int64)), pa.array(nodes[links.root[linked]])], names=["node", "cnt", "root"]
                )

    return run


def near_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93,
    width: int = 16, block_rows: int = 4096, small: int = 100_000,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of equal non-null label (and dimension) link if their cosine in double precision is at
    least ``cosine``. Equal vectors are one class and enter once. Unit vectors are rotated and split
    into blocks of ``width`` coordinates; a linked pair is within its share of the squared distance
    in one block at least, so a range join per block finds every such pair, and the exact cosine is
    tested in the first block that finds it. A label of up to block_rows vectors goes to one task
    once, for all blocks; a larger one goes per block into grid cells over one to three coordinates.
    In a task, boxes over all coordinates of the block rule out most pairs. Full cells are cut into
    pairs of groups; only link counts and star edges leave a task. n_links counts the other rows
    linked directly, copies included; component_id is the smallest vec_id reachable, kept marks it.
    Links are between vectors, so rows with one vec_id and different vectors each have their own.

    Vectors that are null, empty, zero, or hold a null or non-finite value, and rows with a null
    label or vec_id, link with nothing; their component is their own vec_id and they are kept. Very
    large and very small finite values are scaled first. Repeated rows count as copies.
    """
    base = renamed(table, vec_id=id_col, vec=vector_col, label=label_col).select(
        F.col("vec_id").cast("long"), F.col("label").cast("string"), "vec"
    )
    rows = stored(base.mapInArrow(_read, "vec_id long, label string, fp1 long, fp2 long, data binary, dim int"), "vectors")
    live = rows.where("data is not null")
    classes = stored(  # node: a number of the class, fixed as the table is written
        live.groupBy("label", "fp1", "fp2", "dim")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("data").alias("data"))
        .select(F.monotonically_increasing_id().alias("node"), "*"),
        "vector-classes",
    )
    groups = stored(
        classes.groupBy("label", "dim").count().where("count > 1").select("label", "dim", grid_axes(F.col("count"), block_rows).alias("axes")), "label-groups"
    )
    spread = classes.join(F.broadcast(groups) if groups.count() <= small else groups, ["label", "dim"])
    # as many tasks as a grouped shuffle has: a row of a large label makes several rows a block
    spread = spread.select("node", "label", "copies", "data", "dim", "axes").repartition("node")
    placed = spread.mapInArrow(
        _cells(width, cosine), "node long, label string, copies long, data binary, dim int, block int, cx int, cy int, cz int, visitor int"
    )
    cells = stored(
        placed.groupBy(*CELL).agg(F.count("*").alias("n"), F.min("visitor").alias("v")).where("n > 1 and v = 0")
        .select(*CELL, F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")),
        "cells",
    )
    meet = placed.join(F.broadcast(cells) if cells.count() <= small else cells, CELL)
    links = stored(blocked(meet, CELL, "blocks", "node").mapInArrow(_verify(width, cosine), "node long, cnt long, root long"), "vector-links")
    reach = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    smallest = reach.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    about = stored(
        classes.select("label", "fp1", "fp2", "dim", "node", "rep", "copies")
        .join(links.groupBy("node").agg(F.sum("cnt").alias("cnt")), "node", "left")
        .join(reach.join(smallest, "component").select("node", "component_id"), "node", "left")
        .select("label", "fp1", "fp2", "dim", (F.col("copies") - 1 + F.coalesce("cnt", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")),
        "vector-class-links",
    )
    out = live.select("vec_id", "label", "fp1", "fp2", "dim").join(about, ["label", "fp1", "fp2", "dim"]).select(
        "vec_id", F.col("n_links").cast("long"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")
    )
    alone = rows.where("data is null").select(  # apart from the join, where they would meet under one key
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return out.unionByName(alone)


#: All pairs of a label, for the small tables of the comparison; components by repeated minima.
ORACLE = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) as component_id, e.vec_id <= coalesce(c.c, e.vec_id) as kept
from embeddings e left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id
left join (select a, min(b) as c from reach group by a) c on c.a = e.vec_id"""
