"""The condition language: a JSON tree of comparators, crosses, logic and calendar ops becomes one Column.

Missing values compare as False, except ``ne``, which is True; ``not`` complements that result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import all_of, any_of, by_time
from . import calendar, registry


@dataclass
class Context:
    """What names mean: columns of the frame, materialised features by id, and bound parameters, numbers or columns."""

    columns: list[str]
    features: dict[str, str] = field(default_factory=dict)
    params: dict[str, float | Column] = field(default_factory=dict)
    key: str = "asset"
    #: What an empty list of conditions is: False in node trees, True for an empty node of a frame mask.
    empty: bool = False

    def resolve(self, name: str) -> Column:
        """Feature id, then exact column, then ``price.*``, then any case; else an error."""
        if name in self.features:
            return F.col(f"`{self.features[name]}`")
        if name in self.columns:
            return F.col(f"`{name}`")
        short = name.removeprefix("price.").lower()
        for c in self.columns:
            if c.lower() in (short, name.lower()):
                return F.col(f"`{c}`")
        raise KeyError(f"unknown field {name!r}")


ALIASES = {">": "gt", ">=": "ge", "<": "lt", "<=": "le", "==": "eq", "!=": "ne", "crosses_above": "cross_up", "crosses_below": "cross_down", "and": "all", "or": "any"}
COMPARE = {
    "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b,
}


def operand(x, ctx: Context) -> Column:
    """A constant, a name, or {field | feature_ref | fid | param_ref | value}."""
    if isinstance(x, bool) or x is None:
        raise ValueError(f"bad operand {x!r}")
    if isinstance(x, (int, float)):
        return F.lit(float(x))
    if isinstance(x, str):
        return ctx.resolve(x)
    for k in ("field", "feature_ref", "fid", "source"):
        if k in x:
            return ctx.resolve(x[k])
    if "param_ref" in x:
        if x["param_ref"] not in ctx.params:
            raise KeyError(f"unbound parameter {x['param_ref']!r}")
        value = ctx.params[x["param_ref"]]
        return value if isinstance(value, Column) else F.lit(float(value))
    if "value" in x:
        return F.lit(float(x["value"]))
    raise ValueError(f"bad operand {x!r}")


def compile_node(node, ctx: Context) -> Column:
    """The mask of a node; a bare list is a conjunction, an unknown op an error."""
    if isinstance(node, list):
        return all_of([compile_node(n, ctx) for n in node], ctx.empty)
    if not node:
        return F.lit(True)
    op = ALIASES.get(node["op"], node["op"])
    kids = node.get("nodes", node.get("conditions", []))
    if op == "all":
        return all_of([compile_node(n, ctx) for n in kids], ctx.empty)
    if op == "any":
        return any_of([compile_node(n, ctx) for n in kids], False)
    if op == "not":
        return ~compile_node(node["node"] if "node" in node else kids[0], ctx)
    if op in COMPARE or op in ("cross_up", "cross_down"):
        a = operand(node["left"], ctx)
        b = operand(node["right"] if "right" in node else {"field": node["right_field"]}, ctx)
        if op in COMPARE:
            return F.coalesce(COMPARE[op](a, b), F.lit(op == "ne"))
        w = by_time(ctx.key)
        pa, pb = F.lag(a).over(w), F.lag(b).over(w)
        hit = (a > b) & (pa <= pb) if op == "cross_up" else (a < b) & (pa >= pb)
        return F.coalesce(hit, F.lit(False))
    if op == "session.same_session_close":
        return F.lit(False)
    if op.startswith("calendar.") or op == "every_session":
        return calendar.mask(node, columns=ctx.columns)
    raise ValueError(f"unknown op {node['op']!r}; known: {', '.join(sorted(registry.OPS))}")


def with_mask(df: DataFrame, node, name: str = "mask", **ctx) -> DataFrame:
    rows = calendar.with_edges(df, node)
    return rows.withColumn(name, compile_node(node, Context(columns=rows.columns, **ctx))).select(*[c for c in df.columns if c != name], name)
