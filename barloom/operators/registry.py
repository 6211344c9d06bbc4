"""Names of all ops with their parameters, and a checker that validates documents before planning."""

from __future__ import annotations

#: op -> (kind, required parameters, optional parameters)
OPS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    **{f"indicator.{n}": ("indicator", (), ("source", "period")) for n in ("sma", "ema", "momentum", "zscore")},
    "indicator.volatility": ("indicator", (), ("source", "period", "annualize")),
    "indicator.percentile": ("indicator", (), ("source", "period", "percentile")),
    "indicator.bollinger": ("indicator", (), ("source", "period", "stddev", "band")),
    "indicator.rsi": ("indicator", (), ("source", "period")),
    "indicator.macd": ("indicator", (), ("source", "fast", "slow", "signal", "output")),
    "indicator.atr": ("indicator", (), ("period", "method")),
    **{n: ("compare", ("left",), ("right", "right_field")) for n in ("gt", "ge", "lt", "le", "eq", "ne", "cross_up", "cross_down")},
    **{n: ("logic", (), ("nodes", "conditions", "node")) for n in ("all", "any", "not")},
    "calendar.every_session": ("calendar", (), ()),
    "calendar.month_in": ("calendar", ("months",), ()),
    "calendar.weekday_eq": ("calendar", ("weekday",), ()),
    **{f"calendar.{u}_{s}": ("calendar", (), ("months",)) for u in ("month", "quarter", "year") for s in ("start", "end")},
    "calendar.last_weekday_of_month": ("calendar", ("weekday",), ("months",)),
    "calendar.nth_weekday_of_month": ("calendar", ("weekday", "ordinal"), ("months",)),
    "calendar.event_date": ("calendar", (), ("dates", "path", "adjustment_policy")),
    "signal.change": ("trigger", (), ()),
    "time_stop_bars": ("execution", ("bars",), ("mode", "reset_on_reentry")),
    "session.same_session_close": ("execution", (), ()),
    **{f"template.{n}": ("template", (), ()) for n in ("single_signal", "ranked_rotation", "calendar_rotation", "factor_rank")},
}
ALIASES = {
    ">": "gt", ">=": "ge", "<": "lt", "<=": "le", "==": "eq", "!=": "ne", "crosses_above": "cross_up", "crosses_below": "cross_down",
    "and": "all", "or": "any", "every_session": "calendar.every_session", "timer_bars": "time_stop_bars",
}


def problems(node, path: str = "$") -> list[str]:
    """What is wrong with a condition tree: unknown ops and missing or unknown parameters, each with its place."""
    if isinstance(node, list):
        return [p for i, n in enumerate(node) for p in problems(n, f"{path}[{i}]")]
    if not node:
        return []
    op = ALIASES.get(node.get("op"), node.get("op"))
    if op not in OPS:
        return [f"{path}: unknown op {node.get('op')!r}"]
    _, need, may = OPS[op]
    out = [f"{path}: {op} needs {n}" for n in need if n not in node]
    out += [f"{path}: {op} has no parameter {k}" for k in node if k not in ("op", "id", *need, *may)]
    for k in ("nodes", "conditions"):
        out += problems(node.get(k, []), f"{path}.{k}")
    return out + (problems(node["node"], f"{path}.node") if "node" in node else [])


def support_report(document: dict) -> dict:
    """Ops used in a document by kind, and its problems."""
    used: dict[str, set[str]] = {}

    def walk(x):
        if isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            op = ALIASES.get(x.get("op"), x.get("op"))
            if op in OPS:
                used.setdefault(OPS[op][0], set()).add(op)
            for y in x.values():
                walk(y)

    walk(document)
    bad = [p for k in ("entry", "exit", "conditions") if k in document for p in problems(document[k], f"$.{k}")]
    return {"supported": not bad, "used": {k: sorted(v) for k, v in sorted(used.items())}, "problems": bad}


_extensions: dict = {}


def register_indicator(name: str, build) -> None:
    """Add an indicator: build(column, **params) -> Column."""
    if f"indicator.{name}" in OPS:
        raise ValueError(f"indicator.{name} exists")
    OPS[f"indicator.{name}"] = ("indicator", (), ("source", "period"))
    _extensions[f"indicator.{name}"] = build


def extension(op: str):
    return _extensions.get(op)
