"""Running a JSON strategy document: validate, plan, then one lazy frame from panel to equity curve."""

from __future__ import annotations

import copy
import hashlib
import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import by_time, control, upto
from ..operators import calendar, contract, factors, indicators, matrix, portfolio, registry, signals, simulate, wfa
from ..operators.conditions import Context, compile_node

#: Stages of a run: all but the last are window or join plans, the last may be a fold.
STAGES = ("load", "features", "factors", "conditions", "ranking", "weights", "rebalance", "accounting")
DEFAULTS = {"features": {}, "allocation": {"type": "equal_weight", "position_limit": 1.0}, "rebalance": {"op": "calendar.month_start"}, "cost": 0.0, "slippage": 0.0, "execution": "close"}
EXECUTIONS = ("close", "next_open", "same_session", "bar_offset", "event_overlay")
EVERY = ("calendar.every_session", "every_session")

TEMPLATES = {
    "single_signal": {"features": {"fast": {"op": "indicator.sma", "period": 3}, "slow": {"op": "indicator.sma", "period": 5}}, "entry": {"op": "cross_up", "left": "fast", "right": "slow"}, "exit": {"op": "cross_down", "left": "fast", "right": "slow"}, "rebalance": {"op": "signal.change"}},
    "ranked_rotation": {"features": {"score": {"op": "indicator.momentum", "period": 3}}, "selector": {"score": "score", "top_n": 2}, "rebalance": {"op": "calendar.every_session"}},
    "calendar_rotation": {"features": {"score": {"op": "indicator.momentum", "period": 3}}, "selector": {"score": "score", "top_n": 1}, "rebalance": {"op": "calendar.month_start"}},
    "factor_rank": {
        "factors": {
            "raw": {"momentum": {"op": "momentum", "lookback": 5}, "calm": {"op": "volatility", "lookback": 5}},
            "clean": [{"op": "fill", "how": "cross_section_median"}, {"op": "winsorize"}, {"op": "standardize"}],
            "composite": {"name": "score", "method": "manual_weight", "weights": {"momentum": 1.0, "calm": -1.0}},
        },
        "selector": {"score": "score", "top_n": 2}, "rebalance": {"op": "calendar.every_session"},
    },
    "event_overlay": {"overlay": {"event": {"op": "calendar.month_start"}, "weights": {}}, "allocation": {"type": "fixed_weight", "weights": {}}, "execution": "event_overlay"},
}


def normalized(doc: dict) -> dict:
    """With defaults; unknown ops, missing parameters and look-ahead are errors."""
    out = {**copy.deepcopy(DEFAULTS), **copy.deepcopy(doc)}
    bad = [p for k in ("entry", "exit") for p in registry.problems(out.get(k), f"$.{k}")]
    bad += [f"$.features.{n}: unknown op {f.get('op')!r}" for n, f in out["features"].items() if f.get("op") not in registry.OPS]
    if out["execution"] not in EXECUTIONS:
        bad.append(f"$.execution: unknown {out['execution']!r}")
    if out["execution"] == "bar_offset" and not {"enter", "leave"} <= set(out.get("offset", {})):
        bad.append("$.offset: bar_offset execution needs enter and leave")
    if out["execution"] == "event_overlay" and not {"event", "weights"} <= set(out.get("overlay", {})):
        bad.append("$.overlay: event_overlay execution needs event and weights")
    if out.get("risk_gates") and out["execution"] not in ("close", "next_open"):
        bad.append(f"$.risk_gates: not with {out['execution']} execution")
    bad += signals.lookahead_problems(out["execution"], fields(out.get("entry")), set(out["features"]))
    if bad:
        raise ValueError("; ".join(bad))
    return out


def fields(node) -> list[str]:
    """Names that a condition tree reads."""
    if isinstance(node, list):
        return [f for n in node for f in fields(n)]
    if not isinstance(node, dict):
        return []
    own = [x if isinstance(x, str) else x.get("field", "") if isinstance(x, dict) else "" for x in (node.get("left"), node.get("right"), node.get("right_field"))]
    return [f for f in own if f] + [f for k in ("nodes", "conditions", "node") for f in fields(node.get(k))]


def bound(doc: dict, params: dict) -> dict:
    """The document with every {param_ref: name} replaced by its value."""
    def walk(x):
        if isinstance(x, dict):
            return params[x["param_ref"]] if set(x) == {"param_ref"} else {k: walk(v) for k, v in x.items()}
        return [walk(y) for y in x] if isinstance(x, list) else x

    return walk(doc)


def plan_hash(doc: dict) -> str:
    return hashlib.sha256(json.dumps(doc, sort_keys=True).encode()).hexdigest()


def plan(doc: dict) -> dict:
    """Stages, the kind of accounting (closed_form, segments between rebalances, or a fold for gates), and features that share a
    definition (computed once)."""
    doc = normalized(doc)
    closed = not doc.get("risk_gates") and (doc["rebalance"].get("op") in EVERY or doc["execution"] not in ("close", "next_open"))
    by_spec: dict[str, list[str]] = {}
    for name, spec in doc["features"].items():
        by_spec.setdefault(plan_hash(spec), []).append(name)
    return {"stages": STAGES, "accounting": "closed_form" if closed else "fold" if doc.get("risk_gates") else "segments", "features": sorted(by_spec.values()), "hash": plan_hash(doc)}


def with_features(panel: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """Every distinct definition once; names that share it are copies of the column."""
    rows = indicators.with_helpers(panel)
    first: dict[str, str] = {}
    recursive, windows = {}, {}
    build = {
        "sma": lambda x, s: indicators.sma(x, s.get("period", 14)), "momentum": lambda x, s: indicators.momentum(x, s.get("period", 14)),
        "volatility": lambda x, s: indicators.volatility(x, s.get("period", 14), s.get("annualize", True), F.col("ret")), "zscore": lambda x, s: indicators.zscore(x, s.get("period", 14)),
        "percentile": lambda x, s: indicators.percentile(x, s.get("period", 14), s.get("percentile", 50)),
        "bollinger": lambda x, s: indicators.bollinger(x, s.get("period", 20), s.get("stddev", 2.0), s.get("band", "middle")), "rsi": lambda x, s: indicators.rsi(F.col("change"), s.get("period", 14)),
    }
    for name, spec in specs.items():
        key, op = plan_hash(spec), spec["op"].removeprefix("indicator.")
        if key in first:
            continue
        first[key] = name
        if op in ("ema", "macd", "atr"):
            recursive[name] = {**spec, "op": op}
        elif op in build:
            windows[name] = build[op](F.col(spec.get("source", "close")), spec)
        else:
            windows[name] = registry.extension(spec["op"])(F.col(spec.get("source", "close")), **{k: v for k, v in spec.items() if k not in ("op", "source")})
    rows = rows.withColumns(windows)
    rows = indicators.recursive(rows, recursive) if recursive else rows
    return rows.withColumns({n: F.col(first[plan_hash(s)]) for n, s in specs.items() if first[plan_hash(s)] != n})


def with_factors(rows: DataFrame, stage: dict, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The factor stage as one column: raw factors, each cleaned step by step over its date, then the composite.

    raw: name -> {op: momentum | volatility | ratio | column, ...}; clean: a list of steps fill, winsorize,
    standardize, neutralize, rank; composite: {method: equal_weight | manual_weight, weights}.
    """
    build = {
        "momentum": lambda s: factors.price_momentum(F.col(s.get("source", "close")), s.get("lookback", 126), s.get("skip", 0)),
        "volatility": lambda s: factors.realized_volatility(F.col("ret"), s.get("lookback", 126)),
        "ratio": lambda s: factors.ratio(F.col(s["left"]), F.col(s["right"])), "column": lambda s: F.col(s["source"]),
    }
    clean = {
        "fill": lambda c, s: factors.fill_missing(c, s.get("how", "cross_section_median"), s.get("value", 0.0), keys), "standardize": lambda c, s: factors.standardize(c, keys),
        "winsorize": lambda c, s: factors.winsorize(c, s.get("low", 0.01), s.get("high", 0.99), keys), "rank": lambda c, s: factors.percentile_rank(c, keys),
        "neutralize": lambda c, s: factors.neutralize(c, F.col(s["group"]) if s.get("group") in rows.columns else None, keys),
    }
    names = {n: f"{out}_{n}" for n in stage["raw"]}
    rows = rows.withColumns({names[n]: build[s["op"]](s) for n, s in stage["raw"].items()})
    for step in stage.get("clean", []):
        rows = rows.withColumns({c: clean[step["op"]](F.col(c), step) for c in names.values()})
    c = stage.get("composite", {})
    weights = {names[n]: w for n, w in c.get("weights", {}).items()}
    return rows.withColumn(out, factors.combine(c.get("method", "equal_weight"), list(names.values()), weights)).drop(*names.values())


def targets_long(panel: DataFrame, docs: dict[str, dict]) -> DataFrame:
    """Target weights and rebalance flags of many documents in one long frame, keyed by backtest_id.

    Features, factor scores and condition masks are computed once for each distinct definition, in
    windows over the panel; then every row is repeated for each document, and what follows (ranks,
    held positions, weights, changes) is windows keyed by backtest_id. If the panel has a column
    slice, each slice is a history of its own and ids are ``id|slice``.
    """
    docs = {k: normalized(d) for k, d in docs.items()}
    if any("|" in k for k in docs):
        raise ValueError("ids must not contain |")
    cut = ("slice",) if "slice" in panel.columns else ()
    rows = panel.withColumn("_name", F.col("asset"))
    if cut:
        rows = rows.withColumn("asset", F.concat_ws("|", "slice", "asset"))
    tag = lambda x: plan_hash(x)[:16]
    rows = with_features(rows, {f"_f{tag(s)}": s for d in docs.values() for s in d["features"].values()})
    stages = {tag(d["factors"]): d["factors"] for d in docs.values() if d.get("factors")}
    for key, stage in stages.items():
        rows = with_factors(rows, stage, f"_s{key}", cut)
    rows = calendar.with_edges(rows, *[d.get(k) for d in docs.values() for k in ("entry", "exit", "rebalance", "overlay", "selector")])
    context, masks = {}, {}
    for k, d in docs.items():
        names = {n: f"_f{tag(s)}" for n, s in d["features"].items()}
        if d.get("factors"):
            names[d["factors"].get("composite", {}).get("name", "score")] = f"_s{tag(d['factors'])}"
        context[k] = Context(columns=rows.columns, features=names)

    def masked(k: str, node) -> str:
        name = f"_m{tag([node, sorted(context[k].features.items())])}"
        masks[name] = compile_node(node, context[k])
        return name

    never = {"op": "not", "node": {"op": "every_session"}}
    used = {k: {"entry": masked(k, d["entry"]), "exit": masked(k, d.get("exit", never))} for k, d in docs.items() if "entry" in d}
    eligible = {k: masked(k, d["selector"]["eligible"]) for k, d in docs.items() if "selector" in d and d["selector"].get("eligible")}
    rows = rows.withColumns(masks)
    for k, u in used.items():
        if timer := docs[k].get("timer"):  # replaces the exit mask, by one fold over each asset
            new = f"_m{tag([u, timer])}"
            if new not in rows.columns:
                rows = simulate.timer_exit(rows.withColumns({"entry": F.col(u["entry"]), "exit": F.col(u["exit"])}), timer["bars"], timer.get("combine", "or"), timer.get("reset", False))
                rows = rows.drop("entry").withColumnRenamed("exit", new)
            u["exit"] = new
    none = lambda kind: F.lit(None).cast(kind)

    def variant(k: str, d: dict):
        alloc, s = d["allocation"], d.get("selector")
        score = context[k].resolve(s["score"]).cast("double") if s else none("double")
        ok = score.isNotNull() & F.col(eligible[k]) if k in eligible else score.isNotNull()
        event = signals.state_event(F.col(used[k]["entry"]), F.col(used[k]["exit"]), d.get("conflict", "exit_then_entry")) if k in used and not s else none("int")
        if alloc["type"] not in ("equal_weight", "fixed_weight", "target_weight_frame"):
            raise ValueError(f"unknown allocation {alloc['type']!r}")
        fixed = none("double")
        if alloc["type"] == "fixed_weight":
            fixed = signals.fixed_weight(alloc.get("weights", {}), alloc.get("weight_profiles"), alloc.get("profile_id"), alloc.get("normalize_if_overweight", True), "_name")
        frame = F.coalesce(F.col(alloc["frame"]).cast("double"), F.lit(0.0)) if alloc["type"] == "target_weight_frame" else none("double")
        calm = none("boolean") if d["rebalance"]["op"] == "signal.change" else calendar.mask(d["rebalance"], columns=rows.columns)
        over = d.get("overlay", {})
        return F.struct(
            F.lit(k).alias("id"), F.lit("rank" if s else "state" if k in used else "all").alias("mode"), score.alias("score"), ok.alias("ok"),
            (score if s and s.get("ascending") else -score).alias("order"), F.lit(s.get("top_n", 1) if s else 0).alias("top_n"), event.alias("event"),
            F.lit(float(alloc.get("position_limit", 1.0))).alias("limit"), fixed.alias("fixed"), frame.alias("frame"), F.lit(bool(alloc.get("allow_short", False))).alias("short"),
            F.lit(float(alloc.get("max_gross", 1.0))).alias("gross"), calm.alias("calm"),
            (calendar.mask(over["event"], columns=rows.columns) if over else none("boolean")).alias("overlaid"),
            (signals.fixed_weight(over["weights"], asset="_name", signed=True) if over else none("double")).alias("overlay"),
        )

    rows = rows.select("asset", "_name", "ts", "open", "close", *cut, F.explode(F.array(*[variant(k, d) for k, d in docs.items()])).alias("v"))
    rows = rows.select("_name", "asset", "ts", "open", "close", "v.*", (F.concat_ws("|", "v.id", *cut) if cut else F.col("v.id")).alias("backtest_id"))
    return _weights(rows, any(d["rebalance"]["op"] == "signal.change" for d in docs.values()))


def _weights(rows: DataFrame, change: bool) -> DataFrame:
    """Target weights and rebalance flags from what a variant says of each row: mode, score, ok, order, top_n, event, limit,
    fixed, frame, short, gross, calm, overlaid, overlay."""
    key = ("backtest_id",)
    w = Window.partitionBy(*key, "ts", "ok").orderBy("order", "asset")
    rows = rows.withColumns({"rank": F.when(F.col("ok"), F.row_number().over(w)), "_held": F.coalesce(F.last("event", ignorenulls=True).over(upto(*key, "asset")), F.lit(0))})
    chosen = F.when(F.col("mode") == "rank", F.coalesce(F.col("rank") <= F.col("top_n"), F.lit(False))).when(F.col("mode") == "state", F.col("_held") == 1).otherwise(True)
    rows = rows.withColumn("selected", chosen)
    given = F.when(F.col("short"), F.col("frame")).otherwise(F.greatest("frame", F.lit(0.0)))
    rows = rows.withColumns({"_given": given, "_equal": signals.equal_weight(F.col("selected"), F.col("limit"), key)})
    total = F.sum(F.abs("_given")).over(Window.partitionBy(*key, "ts"))
    framed = F.when(total > F.col("gross"), F.col("_given") * F.col("gross") / total).otherwise(F.col("_given"))
    rows = rows.withColumn("target", F.when(F.col("frame").isNotNull(), framed).when(F.col("fixed").isNotNull(), F.when(F.col("selected"), F.col("fixed")).otherwise(0.0)).otherwise(F.col("_equal")))
    rows = signals.with_change(rows, name="_change", keys=key) if change else rows.withColumn("_change", F.lit(False))
    return rows.select(
        *key, "ts", F.col("_name").alias("asset"), "open", "close", "score", "rank", "selected", "target", F.coalesce("calm", "_change").alias("rebalance"),
        F.coalesce("overlaid", F.lit(False)).alias("event"), F.coalesce("overlay", F.lit(0.0)).alias("overlay"),
    )


def targets(panel: DataFrame, doc: dict, backtest_id: str | None = None) -> DataFrame:
    """Target weights and rebalance flags of one document."""
    return targets_long(panel, {backtest_id or plan_hash(normalized(doc))[:12]: doc})


def accounts(rows: DataFrame, docs: dict[str, dict]) -> DataFrame:
    """Equity curves of targets_long's rows, by the documents' execution, which must be one and the same.

    close and next_open have a closed form if every session is traded without gates, segments between
    sparse rebalances, and one fold a backtest with gates; same_session, bar_offset and event_overlay are windows.
    """
    docs = {k: normalized(d) for k, d in docs.items()}
    kinds = {(d["execution"], plan(d)["accounting"]) for d in docs.values()}
    if len({e for e, _ in kinds}) > 1:
        raise ValueError("documents of one run must share their execution")
    (execution, _), closed = next(iter(kinds)), all(a == "closed_form" for _, a in kinds)
    cost, one = {k: d["cost"] for k, d in docs.items()}, next(iter(docs.values()))
    if execution == "same_session":
        return portfolio.session_portfolio(rows, cost, {k: d["slippage"] for k, d in docs.items()})
    if execution == "bar_offset":
        o = one["offset"]
        if any(d["offset"] != o for d in docs.values()):
            raise ValueError("documents of one run must share their offset")
        return portfolio.offset_portfolio(rows, o["enter"], o["leave"], cost, o.get("enter_at", "open"), o.get("leave_at", "close"))
    if execution == "event_overlay":
        return portfolio.event_overlay(rows.withColumn("base", F.col("target")), cost)
    if closed:
        return portfolio.every_bar(rows, cost) if execution == "close" else portfolio.next_open(rows, cost)
    gates = {k: portfolio.Gates(**d["risk_gates"]) for k, d in docs.items() if d.get("risk_gates")}
    return portfolio.account(rows, cost, gates, at=execution)


def with_contract(panel: DataFrame, doc: dict, sources: dict[str, DataFrame] | None = None) -> DataFrame:
    """The panel with the features of the document's contract, which its conditions and selectors then use by name."""
    return contract.materialize(panel, sources or {}, doc["contract"], audit=False) if doc.get("contract") else panel


def run(panel: DataFrame, doc: dict, backtest_id: str | None = None, sources: dict[str, DataFrame] | None = None) -> DataFrame:
    """Equity curve of one document over a panel (asset, ts, open, high, low, close, volume) and, if it has a contract, its sources.

    A curve of portfolio.account also answers portfolio.holdings, rebalance_audit, account_trades and gate_events.
    """
    docs = {backtest_id or plan_hash(normalized(doc))[:12]: doc}
    return accounts(targets_long(with_contract(panel, doc, sources), docs), docs)


#: Names of parameters and fields that are lengths of time in bars.
LENGTHS = ("window", "period", "lookback", "span")


def max_lookback(doc: dict, params: dict | None = None) -> int:
    """The longest look-back, in bars, that a document asks for: the largest number under a name of a window, period, look-back
    or span anywhere in its graph; a parameter counts by its value in ``params``, or by the largest of its domain."""
    params, longest = params or {}, 0
    domains = {k: matrix.expand({"stop": v.get("end"), **v}) if isinstance(v, dict) else list(v) for k, v in {**doc.get("domains", {}), **doc.get("parameter_domains", {})}.items()}
    is_length = lambda name: any(x in str(name).lower() for x in LENGTHS)

    def number(v):
        return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0

    def walk(x, name=""):
        nonlocal longest
        if isinstance(x, dict):
            if set(x) == {"param_ref"}:
                key = x["param_ref"]
                values = [params[key]] if key in params else domains.get(key, [])
                if is_length(name) or is_length(key):
                    longest = max([longest, *map(number, values)])
                return
            for k, v in x.items():
                if k not in ("domains", "parameter_domains"):
                    walk(v, k)
        elif isinstance(x, list):
            for v in x:
                walk(v, name)
        elif is_length(name):
            longest = max(longest, number(x))

    walk(doc)
    free = {k: v for k, v in domains.items() if k not in params and is_length(k)}
    for k, values in [*free.items(), *((k, [v]) for k, v in params.items() if is_length(k))]:
        longest = max([longest, *map(number, values)])
    return longest


def variants(doc: dict, combos: list[dict]) -> dict[str, dict]:
    return {f"v{i}": bound(doc, p) for i, p in enumerate(combos)}


#: Where parameters may stand in a document whose bindings are rows of a table.
GRID = re.compile(r"features\.[^.]+\.(?!op$|source$)[^.]+|(entry|exit|selector\.eligible)\..*|allocation\.position_limit|selector\.top_n|cost")


def refs(doc, at: str = "") -> dict[str, str]:
    """Path -> parameter of every reference in a document."""
    if isinstance(doc, dict):
        if set(doc) == {"param_ref"}:
            return {at: doc["param_ref"]}
        return {p: r for k, v in doc.items() for p, r in refs(v, f"{at}.{k}" if at else str(k)).items()}
    return {p: r for i, v in enumerate(doc) for p, r in refs(v, f"{at}.{i}").items()} if isinstance(doc, list) else {}


def gridable(doc: dict) -> bool:
    """Whether a document's parameters can be a table (see targets_grid)."""
    doc = normalized(doc)
    plain = doc["execution"] in ("close", "next_open") and not any(doc.get(k) for k in ("risk_gates", "timer", "factors", "overlay"))
    return plain and doc["allocation"]["type"] in ("equal_weight", "fixed_weight") and all(GRID.fullmatch(p) for p in refs(doc))


def targets_grid(panel: DataFrame, doc: dict, combos: list[dict]) -> DataFrame:
    """targets_long for all bindings v0, v1... of one document, with the parameters as data.

    Each distinct definition of a feature is one column of the panel, whatever the number of combinations; a table of one row
    a combination names the definitions it uses and holds its numbers. The panel in long form by the first such feature meets the table
    by the definition's key, other features are looked up in the row. Conditions, ranks and weights are
    compiled once, so the plan does not grow with the combinations. The table is control data (matrix.combos caps it).
    """
    doc = normalized(doc)
    tag = lambda x: plan_hash(x)[:16]
    cut = ("slice",) if "slice" in panel.columns else ()
    base = panel.withColumn("_name", F.col("asset"))
    if cut:
        base = base.withColumn("asset", F.concat_ws("|", "slice", "asset"))
    moving = [n for n, spec in doc["features"].items() if refs(spec)]
    used = [{n: bound(doc["features"][n], c) for n in moving} for c in combos]
    specs = {f"_f{tag(s)}": s for s in [*(doc["features"][n] for n in doc["features"] if n not in moving), *(s for u in used for s in u.values())]}
    base = calendar.with_edges(with_features(base, specs), *[doc.get(k) for k in ("entry", "exit", "rebalance", "selector")])
    names = sorted({r for p, r in refs(doc).items() if not p.startswith("features.")})
    table = [(f"v{i}", *(f"_f{tag(u[n])}" for n in moving), *(float(c[r]) for r in names)) for i, (c, u) in enumerate(zip(combos, used))]
    kinds = ", ".join(["_id string", *(f"_k{j} string" for j in range(len(moving))), *(f"_q{j} double" for j in range(len(names)))])
    params = base.sparkSession.createDataFrame(table, kinds)
    keys = sorted({f"_f{tag(s)}" for u in used for s in u.values()})
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys]) if keys else F.array(F.struct(F.lit("").alias("key"), F.lit(None).cast("double").alias("value")))
    first = sorted({f"_f{tag(u[moving[0]])}" for u in used}) if moving else [""]
    rows = base.withColumn("_cells", cells).withColumn("_k0" if moving else "_one", F.explode(F.array(*map(F.lit, first)))).drop(*keys)
    rows = rows.join(control(params), "_k0") if moving else rows.join(control(params.withColumn("_one", F.lit(""))), "_one")  # one row a combination
    find = lambda j: F.element_at(F.filter("_cells", lambda c: c["key"] == F.col(f"_k{j}")), 1)["value"]
    rows = rows.withColumns({f"_x{j}": find(j) for j in range(len(moving))}).withColumn("_bk", F.concat_ws("|", "_id", "asset"))
    features = {n: f"_x{moving.index(n)}" if n in moving else f"_f{tag(s)}" for n, s in doc["features"].items()}
    number = {r: F.col(f"_q{j}") for j, r in enumerate(names)}
    context = Context(columns=rows.columns, features=features, params=number, key="_bk")
    value = lambda x: number[x["param_ref"]] if isinstance(x, dict) else F.lit(float(x))
    alloc, s = doc["allocation"], doc.get("selector")
    none = lambda kind: F.lit(None).cast(kind)
    masks = {}
    if "entry" in doc:
        masks = {"_entry": compile_node(doc["entry"], context), "_exit": compile_node(doc.get("exit", {"op": "not", "node": {"op": "every_session"}}), context)}
    if s and s.get("eligible"):
        masks["_eligible"] = compile_node(s["eligible"], context)
    rows = rows.withColumns(masks) if masks else rows
    score = context.resolve(s["score"]).cast("double") if s else none("double")
    ok = score.isNotNull() & F.col("_eligible") if "_eligible" in masks else score.isNotNull()
    event = signals.state_event(F.col("_entry"), F.col("_exit"), doc.get("conflict", "exit_then_entry")) if "_entry" in masks and not s else none("int")
    fixed = none("double")
    if alloc["type"] == "fixed_weight":
        fixed = signals.fixed_weight(alloc.get("weights", {}), alloc.get("weight_profiles"), alloc.get("profile_id"), alloc.get("normalize_if_overweight", True), "_name")
    change = doc["rebalance"]["op"] == "signal.change"
    rows = rows.select(
        "_name", "asset", "ts", "open", "close", F.concat_ws("|", "_id", *cut).alias("backtest_id"), F.lit("rank" if s else "state" if "_entry" in masks else "all").alias("mode"), score.alias("score"), ok.alias("ok"),
        (score if s and s.get("ascending") else -score).alias("order"), (value(s.get("top_n", 1)) if s else F.lit(0.0)).alias("top_n"), event.alias("event"), value(alloc.get("position_limit", 1.0)).alias("limit"),
        fixed.alias("fixed"), none("double").alias("frame"), F.lit(False).alias("short"), F.lit(1.0).alias("gross"), (none("boolean") if change else calendar.mask(doc["rebalance"], columns=rows.columns)).alias("calm"),
        none("boolean").alias("overlaid"), none("double").alias("overlay"),
    )
    return _weights(rows, change)


def run_matrix(panel: DataFrame, doc: dict, combos: list[dict]) -> DataFrame:
    """All bindings of a document's parameters, costs and gates included, in one long frame and one account; the parameters are
    rows of a table where the document allows it."""
    if gridable(doc) and combos:
        plain, cost = normalized(bound(doc, combos[0])), normalized(doc)["cost"]
        rows, costs = targets_grid(panel, doc, combos), [float(bound({"cost": cost}, c)["cost"]) for c in combos]
        if plan(plain)["accounting"] == "closed_form":
            return portfolio.every_bar(rows, costs) if plain["execution"] == "close" else portfolio.next_open(rows, costs)
        return portfolio.account(rows, costs, at=plain["execution"])
    docs = variants(doc, combos)
    return accounts(targets_long(panel, docs), docs)


def walk_forward(panel: DataFrame, doc: dict, combos: list[dict], plan_: list[tuple]) -> DataFrame:
    """Scores of every (window, part, binding) of any document, as wfa.select wants them: each slice of the
    panel is a history of its own, all slices and bindings are one frame."""
    slices = wfa.sliced(panel.sparkSession, panel, plan_).withColumn("slice", F.concat_ws("|", "window_id", "part")).drop("window_id", "part")
    curves = run_matrix(slices, doc, combos)
    at = F.split("backtest_id", r"\|")
    rows = curves.withColumns({"combo_id": F.substring(at[0], 2, 20).cast("long"), "window_id": at[1].cast("int"), "part": at[2]})
    keys = ("window_id", "part", "combo_id")
    last = F.coalesce(F.lag("equity").over(by_time(*keys)), F.lit(100.0))
    return wfa.path_scores(rows.withColumn("ret", F.coalesce(F.try_divide(F.col("equity"), last) - 1, F.lit(0.0))), keys)


def _measured(panel: DataFrame, doc: dict, rows: list[dict], names: tuple[str, ...]) -> list[tuple]:
    """The named scores (as in wfa.path_scores) of each binding, from one run_matrix."""
    curves = run_matrix(panel, doc, rows)
    last = F.coalesce(F.lag("equity").over(by_time("backtest_id")), F.lit(100.0))
    found = wfa.path_scores(curves.withColumn("ret", F.coalesce(F.try_divide(F.col("equity"), last) - 1, F.lit(0.0))), ("backtest_id",))
    by = {r["backtest_id"]: tuple(r[n] for n in names) for r in found.select("backtest_id", *names).collect()}  # a few numbers a combination
    return [by.get(f"v{i}", (None,) * len(names)) for i in range(len(rows))]


def optimum(panel: DataFrame, doc: dict, domains: dict[str, dict], budget: int, objective: str = "total_return", batch: int = 8, seed: int = 42) -> list[tuple[dict, float]]:
    """Parameters of a document by sequential search (matrix.search), each batch one run_matrix; scores as in wfa.path_scores."""
    return matrix.search(lambda rows: [v for (v,) in _measured(panel, doc, rows, (objective,))], domains, budget, batch, seed)


def frontier(
    panel: DataFrame, doc: dict, domains: dict[str, dict], budget: int, objectives: dict[str, str] = {"sharpe": "max", "calmar": "max", "max_drawdown": "max"}, batch: int = 8, seed: int = 42,  # noqa: B006
) -> list[tuple[dict, tuple, int]]:
    """Parameters by a search for several objectives (matrix.search_front): (binding, scores, front), front 0 first."""
    names = tuple(objectives)
    return matrix.search_front(lambda rows: _measured(panel, doc, rows, names), domains, budget, tuple(objectives.values()), batch, seed)


def pruned(panel: DataFrame, doc: dict, combos: list[dict], objective: str = "total_return", shares: tuple[float, ...] = (1 / 9, 1 / 3, 1.0), keep: float = 1 / 3) -> tuple[list[tuple[dict, float]], list[dict]]:
    """Successive halving over bindings (matrix.halved): all on the first share of the sessions, the best of them on more.

    The report has the sessions and the bars (rows of the panel times bindings) that each rung read.
    """
    sessions = panel.groupBy("ts").agg(F.count("*").alias("n"))
    place = F.percent_rank().over(Window.orderBy("ts"))  # one row a session
    read = []

    def evaluate(rows: list[dict], share: float) -> list[float]:
        if share >= 1:
            part = panel
        else:
            last = sessions.withColumn("p", place).where(F.col("p") < share).agg(F.max("ts")).first()[0]
            part = panel.where(F.col("ts") <= F.lit(last))
        read.append(part.count() * len(rows))
        return [v for (v,) in _measured(part, doc, rows, (objective,))]

    scores, report = matrix.halved(evaluate, combos, shares, keep)
    return scores, [{**r, "bars": n} for r, n in zip(report, read)]


def template(name: str, **changes) -> dict:
    return {**copy.deepcopy(TEMPLATES[name]), **changes}
