"""A Merkle manifest of a table: a tree of digests in each group, a tree of the groups' roots, a proof for each row."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ranked, stored
from .importance import CRC_SQL, crc_sql

#: One level of a proof: the run's other digests, before and after the own one.
STEP = "struct<left string, right string>"
HEX = 64


def field(c: Column) -> Column:
    """A value as byte count, colon, bytes; ``-`` if null."""
    return F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest (lowercase hex SHA-256) of a row's fields."""
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def hashed_rows(digests: np.ndarray, fanout: int) -> np.ndarray:
    """The next level: each run of ``fanout`` rows of a (nodes, 64) matrix of hex digits becomes one digest."""
    n, whole = len(digests), len(digests) // fanout
    runs = [*digests[: whole * fanout].reshape(whole, fanout * HEX), *([digests[whole * fanout :].ravel()] if n % fanout else [])]
    return np.frombuffer(b"".join(hashlib.sha256(r).hexdigest().encode() for r in runs), np.uint8).reshape(-1, HEX)


def levels_of(digests: np.ndarray, fanout: int, height: int) -> list[np.ndarray]:
    """The matrices of a block from its nodes up, ``height`` levels above them."""
    out = [np.ascontiguousarray(digests)]
    for _ in range(height):
        out.append(hashed_rows(out[-1], fanout))
    return out


def steps_of(levels: list[np.ndarray], fanout: int) -> list[list[dict]]:
    """Per node of the lowest matrix: at each level the digests of its run before and after it, by index arithmetic."""
    flat = [m.tobytes().decode("ascii") for m in levels[:-1]]
    out = []
    for i in range(len(levels[0])):
        path, at = [], i
        for text, m in zip(flat, levels):
            first = at - at % fanout
            end = min(first + fanout, len(m))
            path.append({"left": text[first * HEX : at * HEX], "right": text[(at + 1) * HEX : end * HEX]})
            at //= fanout
        out.append(path)
    return out


def _matrix(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The order of a block's rows by place, and its digests in that order as rows of hex digits."""
    order = np.argsort(block.column("place").to_numpy(), kind="stable")
    digests = np.frombuffer("".join(block.column("digest").to_pylist()).encode("ascii"), np.uint8).reshape(-1, HEX)
    return order, digests[order]


def _tops(fanout: int):
    def run(block: pa.Table) -> pa.Table:
        _, digests = _matrix(block)
        top = levels_of(digests, fanout, block.column("height")[0].as_py())[-1].tobytes().decode("ascii")
        grp, place, total = (block.column(c)[0].as_py() for c in ("grp", "block", "above"))
        return pa.table({"grp": [grp], "place": [place], "total": [total], "digest": [top]})

    return run


def _paths(fanout: int, fields: list[str]):
    """Paths of a block's nodes: their steps in the block, then the block's own path further up."""
    steps = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(block: pa.Table, upper: pa.Table) -> pa.Table:
        order, digests = _matrix(block)
        levels = levels_of(digests, fanout, block.column("height")[0].as_py())
        above, subroot = upper.column("path")[0].as_py(), upper.column("subroot")[0].as_py()
        rows = block.take(pa.array(order))
        cols = {c: rows.column(c) for c in fields}
        cols["path"] = pa.array([s + above for s in steps_of(levels, fanout)], steps)
        return pa.table({**cols, "subroot": [subroot] * rows.num_rows})

    return run


class Tree:
    """The trees of all groups of (grp, place, total, digest, more...); places are 0, 1, 2... in each group.

    Each group is cut into aligned blocks of fanout ** depth nodes, one task group each, whose tops are the
    nodes of the next round, until every group has one. A group of any size is spread over its blocks.
    """

    def __init__(self, nodes: DataFrame, fanout: int, depth: int, name: str):
        self.fanout, self.rounds, self.tops = fanout, [], nodes
        size = fanout**depth
        while not self.rounds or (self.tops.agg(F.max("total")).first()[0] or 0) > 1:
            height = sum(((F.col("total") > fanout**k).cast("int") for k in range(depth)), F.lit(0))
            above = F.floor((F.col("total") + (size - 1)) / size).cast("long")
            block = F.floor(F.col("place") / size).cast("long")
            self.rounds.append(stored(self.tops.withColumn("height", height).withColumn("above", above).withColumn("block", block), f"{name}-nodes"))
            rows = self.rounds[-1].select("grp", "place", "digest", "height", "above", "block")
            self.tops = stored(rows.groupBy("grp", "block").applyInArrow(_tops(fanout), "grp string, place long, total long, digest string"), f"{name}-tops")

    def roots(self) -> DataFrame:
        return self.tops.select("grp", "digest")

    def paths(self, above: DataFrame, carry: list[str]) -> DataFrame:
        """(carry..., path, subroot) of every node; above is (grp, path): what follows a group's root."""
        upper = above.join(self.roots().withColumnRenamed("digest", "subroot"), "grp").select("grp", F.lit(0).cast("long").alias("block"), "path", "subroot")
        for i, level in reversed(list(enumerate(self.rounds))):
            fields = carry if i == 0 else ["grp", "place"]
            kinds = [f"`{c}` {level.schema[c].dataType.simpleString()}" for c in fields]
            own = level.select(*dict.fromkeys([*fields, "grp", "block", "place", "digest", "height"]))
            found = own.groupBy("grp", "block").cogroup(upper.groupBy("grp", "block")).applyInArrow(_paths(self.fanout, fields), ", ".join([*kinds, f"path array<{STEP}>", "subroot string"]))
            upper = stored(found.withColumnRenamed("place", "block"), "merkle-paths") if i else found
        return upper


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and the steps of its proof give."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All digests of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(
    docs: DataFrame, columns: list[str], order_col: str = "doc_id", group_col: str = "source", fanout: int = 16, depth: int = 3,
    claims: dict[str, Column] | None = None,
) -> DataFrame:
    """Per input row: order_col, leaf, subroot, root, path (array of left and right siblings), and the claims.

    A leaf is the digest of the row's columns; leaves ascend by order_col within their group (a null
    first, equal ids by digest), every ``fanout`` consecutive nodes become the digest of their hex digits, and what remains
    is the group's subroot. Subroots, by group (null first, bytewise), give the root in the same way.
    A group's or table's single node is its own root, with an empty path. Rows that are equal are leaves of
    their own. An empty table gives no rows. claims are expressions over the input that travel with
    the row, such as the leaf of a copy to verify: folded(claim, path) must be the root.
    """
    col = lambda c: F.col(f"`{c}`")
    claims = claims or {}
    grp = F.when(col(group_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), col(group_col).cast("string")))
    rows = docs.select(col(order_col).alias("_id"), grp.alias("grp"), leaf(*map(col, columns)).alias("digest"), *[c.alias(f"_claim_{k}") for k, c in claims.items()])
    extra = ["_id", "digest", *(f"_claim_{k}" for k in claims)]
    placed = ranked(rows, [F.col("_id").asc_nulls_first(), F.col("digest")], "merkle-ranges", "grp")
    zero = lambda df: df.withColumn("place", F.col("place").cast("long") - 1)
    inner = Tree(zero(placed), fanout, depth, "merkle")
    groups = ranked(inner.roots().withColumnRenamed("grp", "_grp"), [F.col("_grp")], "merkle-groups")
    outer = Tree(zero(groups.withColumn("grp", F.lit("all"))), fanout, depth, "merkle-all")
    none = docs.sparkSession.createDataFrame([("all", [])], f"grp string, path array<{STEP}>")
    above = outer.paths(none, ["_grp"]).select(F.col("_grp").alias("grp"), "path", F.col("subroot").alias("root"))
    above = stored(above, "merkle-above")
    root = above.first()
    out = inner.paths(above.select("grp", "path"), extra)
    return out.select(F.col("_id").alias(order_col), F.col("digest").alias("leaf"), "subroot", F.lit(root and root["root"]).alias("root"), "path", *[F.col(f"_claim_{k}").alias(k) for k in claims])


#: The columns of a leaf of documents, in order.
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of documents, with a folded proof for every row; where 5 divides the CRC-32 of a
    doc_id (never of a null one), of the row with its text's A-Z in lower case."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    claim = leaf(*[text if c == "text" else F.col(c) for c in COLUMNS])
    out = manifest(docs.select(*COLUMNS), COLUMNS, claims={"claim": claim})
    proof = F.sha2(siblings(F.col("path")).cast("binary"), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("claim"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(name: str, leaves: str) -> str:
    """SQL for the levels of trees (grp, lev, pos, digest, n) and each leaf's steps, from leaves (r, grp, pos, digest, n)."""
    return f"""{name}_levels(grp, lev, pos, digest, n) AS (
  SELECT grp, 0, pos, digest, n FROM {leaves}
  UNION ALL
  SELECT grp, lev + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM {name}_levels WHERE n > 1 GROUP BY grp, lev, pos // 16),
{name}_runs AS (SELECT grp, lev, pos // 16 AS run, list(digest ORDER BY pos) AS ds FROM {name}_levels WHERE n > 1 GROUP BY grp, lev, pos // 16),
{name}_paths AS (SELECT r, list(array_to_string(list_slice(ds, 1, own), '') || '|' || array_to_string(list_slice(ds, own + 2, len(ds)), '') ORDER BY lev) AS path FROM (
  SELECT r, lev, ds, (pos // (16 ** lev)::BIGINT) % 16 AS own FROM {leaves} l JOIN {name}_runs s ON l.grp = s.grp AND l.pos // (16 ** (lev + 1))::BIGINT = s.run) GROUP BY r),
{name}_roots AS (SELECT grp, digest FROM {name}_levels WHERE n = 1)"""


def _leaf_sql(*columns: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')" for c in columns) + ")"


_TAMPERED = f"CASE WHEN {crc_sql('coalesce(doc_id::VARCHAR, chr(48))')} % 5 = 0 AND doc_id IS NOT NULL THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
ORACLE = f"""WITH RECURSIVE {CRC_SQL},
hashed AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || source, '0') AS grp, {_leaf_sql('doc_id', 'source', 'lang', 'n_chars', 'text')} AS digest, {_leaf_sql('doc_id', 'source', 'lang', 'n_chars', _TAMPERED)} AS claim FROM documents, crc_table),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM hashed),
{_levels('inner', 'leaves')},
subroots AS (SELECT grp AS r, digest, 'all' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM inner_roots),
{_levels('outer', 'subroots')},
found AS (SELECT doc_id, l.digest AS leaf, claim, s.digest AS subroot, t.digest AS root, coalesce(i.path, []) || coalesce(o.path, []) AS path
  FROM leaves l JOIN inner_roots s USING (grp) CROSS JOIN outer_roots t LEFT JOIN inner_paths i ON l.r = i.r LEFT JOIN outer_paths o ON l.grp = o.r),
proofs AS (SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
  list_reduce([claim] || path, lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root FROM found)
SELECT *, folded_root = root AS verified FROM proofs"""
