"""Hand-made cases for the engine's operators."""

import datetime as dt
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import align, blocks, calendar, clean, contract, factors, indicators, matrix, metrics, portfolio, registry, signals, simulate, stats, wfa
from barloom.operators.conditions import with_mask
from barloom.plans import research, strategy
from barloom.sources import readers, sinks

DAY = dt.date(2024, 1, 1)


def panel(spark, closes, asset="a", opens=None, start=DAY):
    rows = [(asset, start + dt.timedelta(days=i), float(o), float(max(o, c)), float(min(o, c)), None if c is None else float(c), 1.0) for i, (c, o) in enumerate(zip(closes, opens or closes))]
    return spark.createDataFrame(rows, "asset string, ts date, open double, high double, low double, close double, volume double")


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def bars(spark, closes, entry, exit_, opens=None):
    df = panel(spark, closes, opens=opens)
    sig = spark.createDataFrame([(DAY + dt.timedelta(days=i), float(e), float(x)) for i, (e, x) in enumerate(zip(entry, exit_))], "ts date, entry double, exit double")
    return df.join(sig, "ts")


def test_long_trade(spark):
    out = simulate.simulate(bars(spark, [100, 110, 120, 130], [1, 0, 0, 0], [0, 0, -1, 0]), simulate.Rules())
    assert column(out, "position") == [1, 1, 0, 0] and column(out, "action") == [1, 0, 4, 0]
    assert column(out, "equity") == pytest.approx([100, 110, 120, 120]) and column(out, "ret") == pytest.approx([0, 0.1, 1 / 11, 0])


def test_short_trade_and_delay(spark):
    out = simulate.simulate(bars(spark, [100, 90, 80, 70], [-1, 0, 0, 0], [0, 0, 1, 0]), simulate.Rules())
    assert column(out, "position") == [-1, -1, 0, 0] and column(out, "equity") == pytest.approx([100, 110, 120, 120])
    out = simulate.simulate(bars(spark, [100, 100, 110, 120, 120], [1, 0, 0, 0, 0], [0, 0, -1, 0, 0]), simulate.Rules(delay=1))
    assert column(out, "position") == [0, 1, 1, 0, 0]


def test_costs_once_a_side_and_timer_from_fill(spark):
    out = simulate.simulate(bars(spark, [100] * 4, [1, 0, 0, 0], [0, 0, -1, 0]), simulate.Rules(cost=0.01, slippage=0.02))
    fee = 0.99 * 0.98
    assert column(out, "equity") == pytest.approx([100 * fee, 100 * fee, 100 * fee * fee, 100 * fee * fee])
    out = simulate.simulate(bars(spark, [100] * 6, [1, 0, 0, 0, 0, 0], [0] * 6), simulate.Rules(delay=1, long_bars=2))
    assert column(out, "action") == [0, 1, 0, 4, 0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_simulator_properties(seed):
    rng = np.random.default_rng(seed)
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))
    entry, exit_ = rng.choice([0, 1], 120, p=[0.9, 0.1]), -rng.choice([0, 1], 120, p=[0.9, 0.1])
    base = simulate.fold(entry, exit_, price, simulate.Rules(cost=0.001))
    dear = simulate.fold(entry, exit_, price, simulate.Rules(cost=0.01))
    assert (dear["equity"] <= base["equity"] + 1e-9).all()
    assert simulate.fold(entry, exit_, 7 * price, simulate.Rules(cost=0.001))["equity"] == pytest.approx(base["equity"])
    late = simulate.fold(entry, exit_, price, simulate.Rules(delay=2))
    assert np.flatnonzero(late["action"] == 1)[0] >= np.flatnonzero(base["action"] == 1)[0]
    short, long = (np.flatnonzero(simulate.fold(entry, 0 * exit_, price, simulate.Rules(long_bars=n))["action"] == 4)[0] for n in (3, 8))
    assert long >= short


def test_same_session_skips_bad_prices_and_overlap_is_an_error(spark):
    df = panel(spark, [110, 120, 0], opens=[100, 100, 100]).withColumn("entry", F.lit(True))
    out = simulate.same_session(df, 0.0, 0.0)
    assert column(out, "traded") == [True, True, False] and column(out, "skipped") == [False, False, True] and column(out, "equity") == pytest.approx([110, 132, 132])
    with pytest.raises(Exception, match="overlapping"):
        simulate.bar_offset(panel(spark, [1, 2, 3, 4, 5]).withColumn("entry", F.lit(True)), 1, 3).collect()


def test_timer_exit(spark):
    df = bars(spark, [1] * 6, [1, 0, 0, 1, 0, 0], [0] * 6).select("asset", "ts", F.expr("entry = 1").alias("entry"), F.expr("exit = 1").alias("exit"))
    assert column(simulate.timer_exit(df, 2), "exit") == [False, False, True, False, False, True]


def test_state_position_conflicts(spark):
    df = bars(spark, [1] * 3, [1, 0, 1], [0, 0, 1])
    e, x = F.col("entry") == 1, F.col("exit") == 1
    assert column(df.withColumn("p", signals.state_position(e, x)), "p") == [1, 1, 1]
    assert column(df.withColumn("p", signals.state_position(e, x, "flat_on_conflict")), "p") == [1, 1, 0]


def test_conditions_with_missing_values(spark):
    df = spark.createDataFrame([("a", DAY, None, 1.0), ("a", DAY + dt.timedelta(days=1), 2.0, 1.0)], "asset string, ts date, x double, y double")
    for op, want in (("gt", [False, True]), ("ne", [True, True]), ("eq", [False, False]), ("cross_up", [False, False])):
        assert column(with_mask(df, {"op": op, "left": "x", "right": "y"}), "mask") == want
    assert column(with_mask(df, {"op": "not", "node": {"op": "gt", "left": "x", "right": 1}}), "mask") == [True, False]
    assert column(with_mask(df, []), "mask") == [False, False] and column(with_mask(df, [], empty=True), "mask") == [True, True] and column(with_mask(df, {}), "mask") == [True, True]
    with pytest.raises(ValueError):
        with_mask(df, {"op": "nope"})
    with pytest.raises(KeyError):
        with_mask(df, {"op": "gt", "left": "zzz", "right": 1})


def test_registry_reports_places():
    assert registry.problems([{"op": "gt", "left": "x"}, {"op": "what"}]) == ["$[1]: unknown op 'what'"]
    report = registry.support_report({"entry": {"op": ">", "left": "x", "right": 1}, "features": [{"op": "indicator.sma"}]})
    assert report["supported"] and report["used"] == {"compare": ["gt"], "indicator": ["indicator.sma"]}


def test_calendar_targets_are_not_rolled(spark):
    days = spark.createDataFrame([(dt.date(2024, 5, d),) for d in (1, 2, 3, 28, 29)], "ts date")
    node = {"op": "calendar.nth_weekday_of_month", "weekday": "mon", "ordinal": 4}
    assert not any(column(days.withColumn("m", calendar.mask(node)), "m"))
    rows = calendar.event_frame(days, node).collect()
    assert [(r["raw_event_date"], r["triggered"], r["skip_reason"]) for r in rows] == [(dt.date(2024, 5, 27), False, "no_session")]
    events = spark.createDataFrame([(dt.date(2024, 5, 27),), (dt.date(2024, 4, 1),)], "event date")
    back = calendar.event_sessions(days, events, "previous_trading_day")
    assert column(back, "resolved_session_date", "raw_event_date") == [None, dt.date(2024, 5, 3)]
    assert column(calendar.event_sessions(days, events, "next_trading_day"), "resolved_session_date", "raw_event_date") == [dt.date(2024, 5, 1), dt.date(2024, 5, 28)]
    with pytest.raises(ValueError):
        calendar.weekday_number("xx")


def test_as_of_tolerance_across_years_and_duplicates(spark):
    base = spark.createDataFrame([(dt.date(2023, 12, 30),), (dt.date(2024, 1, 2),), (dt.date(2024, 1, 20),)], "ts date")
    source = spark.createDataFrame([(dt.date(2023, 12, 31), 5.0)], "ts date, x double")
    assert column(align.as_of(base, source, ["x"]), "x") == [None, 5.0, 5.0]
    assert column(align.as_of(base, source, ["x"], bars=1), "x") == [None, 5.0, None]
    twice = source.unionAll(source)
    with pytest.raises(Exception, match="duplicate source keys"):
        align.equi_join(base, twice, ["ts"]).collect()
    with pytest.raises(ValueError):
        align.fill_stale(F.lit(1), 1, "bfill")
    with pytest.raises(ValueError):
        align.resolve_instrument(["ts"], ["ts", "asset"], 2)


def test_as_of_tolerance_is_a_length_of_time(spark):
    at = lambda m, s=0: dt.datetime(2025, 9, 24, 9, m, s)
    base = spark.createDataFrame([(at(5 * k),) for k in range(6)], "ts timestamp")
    source = spark.createDataFrame([(at(0), 1.0), (at(9, 30), 2.0)], "ts timestamp, x double")
    assert column(align.as_of(base, source, ["x"]), "x") == [1, 1, 2, 2, 2, 2]
    assert column(align.as_of(base, source, ["x"], bars=1), "x") == [1, 1, 2, None, None, None]
    assert align.median_gap(base) == 300
    keyed = align.as_of(base.withColumn("k", F.lit("a")), source.withColumn("k", F.lit("a")), ["x"], by=["k"], bars=2)
    assert column(keyed, "x") == [1, 1, 2, 2, None, None]
    assert align.as_of(base.limit(0), source, ["x"], bars=1).collect() == [] and column(align.as_of(base, source.limit(0), ["x"], bars=1), "x") == [None] * 6


def test_mean_of_five_counts_the_missing_row(spark):
    df = panel(spark, [10, 20, 30, 40, 50, 60]).withColumn("close", F.when(F.col("close") != 60, F.col("close")))
    assert column(df.withColumn("f", clean.fill(F.col("close"), "mean5")), "f") == [10, 20, 30, 40, 50, 35]


def test_calendar_edges_equal_windows(spark):
    days = [DAY + dt.timedelta(days=11 * k) for k in range(40)]
    df = spark.createDataFrame([(a, d) for a in "ab" for d in days], "asset string, ts date")
    for unit in ("month", "quarter", "year"):
        for side in ("start", "end"):
            node = {"op": f"calendar.{unit}_{side}"}
            rows = calendar.with_edges(df, {"op": "all", "nodes": [node]})
            both = rows.select("ts", calendar.mask(node, columns=rows.columns).alias("x"), calendar.mask(node).alias("y"))
            assert both.where("x <> y").count() == 0 and both.where("x").count() > 1
            assert with_mask(df, node).columns == ["asset", "ts", "mask"]


def test_held_return_leaves_out_entry_and_exit_costs():
    r = simulate.fold(np.array([1, 0, 0, 0]), np.array([0, 0, -1, 0]), np.array([100.0, 110.0, 121.0, 130.0]), simulate.Rules(cost=0.01))
    assert r["held_ret"] == pytest.approx([0, 0.1, 0.1, 0]) and r["ret"][2] == pytest.approx(1.1 * 0.99 - 1)


def test_recursive_indicators_with_gaps(spark):
    df = panel(spark, [1, 2, 3, 4, 5]).withColumn("close", F.when(F.col("close") != 3, F.col("close")))
    out = indicators.recursive(df, {"e": {"op": "ema", "period": 3}})
    got = pd.Series(column(out, "e"), dtype=float)
    want = pd.Series([1, 2, np.nan, 4, 5.0]).ewm(span=3, adjust=False, min_periods=3).mean()
    assert got.fillna(-1).tolist() == pytest.approx(want.fillna(-1).tolist())
    with pytest.raises(ValueError):
        indicators.bollinger(F.col("close"), band="none")


def test_as_of_over_a_crowded_day(spark):
    """Most base rows fall on one day, which is cut into many blocks; values come over blocks without a source row."""
    rng = np.random.default_rng(8)
    t0 = dt.datetime(2024, 3, 1)
    base = [(k, t0 + dt.timedelta(seconds=int(s))) for k in "ab" for s in [*sorted(rng.integers(0, 80_000, 900)), -90_000, 400_000, 500_000]]
    source = [(k, t0 + dt.timedelta(seconds=int(s)), float(i)) for k in "ab" for i, s in enumerate(sorted(rng.choice(100_000, 40, replace=False) - 10_000))]
    left, right = spark.createDataFrame(base, "k string, ts timestamp").repartition(4), spark.createDataFrame(source, "k string, ts timestamp, x double")
    at = blocks.cuts([left, right], rows=60)
    assert blocks.with_block(left.where(F.to_date("ts") == "2024-03-01"), at).select("_block").distinct().count() > 20
    frame = lambda rows, cols: pd.DataFrame(rows, columns=cols).assign(ts=lambda f: f.ts.astype("datetime64[us]")).sort_values("ts")
    want = pd.merge_asof(frame(base, ["k", "ts"]), frame(source, ["k", "ts", "x"]), on="ts", by="k")
    got = align.as_of(left, right, ["x"], by=["k"], block_rows=60)
    key = lambda rows: sorted((r.k, str(r.ts), -1.0 if pd.isna(r.x) else r.x) for r in rows)
    assert key(got.toPandas().itertuples()) == key(want.itertuples())
    whole = align.as_of(left.where("k = 'a'").drop("k"), right.where("k = 'a'").drop("k"), ["x"], bars=3, block_rows=60)
    one = align.as_of(left.where("k = 'a'").drop("k"), right.where("k = 'a'").drop("k"), ["x"], bars=3)
    assert sorted(map(str, whole.collect())) == sorted(map(str, one.collect()))


def bars_of(spark, n, assets=("SPY",)):
    rows = [(a, DAY + dt.timedelta(days=t), 100.0 + t) for a in assets for t in range(n)]
    return spark.createDataFrame(rows, "asset string, ts date, close double")


def test_contract_as_of_respects_tolerance(spark):
    vix = spark.createDataFrame([(DAY, 10.0), (DAY + dt.timedelta(days=3), 40.0)], "time date, vix double")
    doc = {
        "primary_key": {"time_field": "ts"}, "alignment_policy": {"join_mode": "asof", "asof_tolerance_bars": 1},
        "features": [{"field": "feature.vix", "source": {"source_id": "vix", "column": "vix", "time_field": "time"}, "staleness_max_bars": 1}, {"field": "price", "source": {"column": "close"}, "lag_bars": 1}],
    }
    for size in (200_000, 2):
        out = contract.materialize(bars_of(spark, 5), {"vix": vix}, doc, block_rows=size)
        get = lambda c: column(out.withColumnRenamed(c, "_c"), "_c")  # noqa: B023, E731
        assert get("feature.vix") == [10, 10, None, 40, 40] and get("price") == [None, 100, 101, 102, 103]
        assert get("__audit__feature_vix__value_origin") == ["exact", "asof", "missing", "exact", "asof"] and get("__audit__feature_vix__age_bars") == [0, 1, None, 0, 1]
        assert get("__audit__price__value_origin") == ["missing", *["base_frame"] * 4] and get("__audit__price__age_bars") == [None, 1, 1, 1, 1]


def test_contract_of_three_sources_in_one_pass(spark):
    day = lambda t: DAY + dt.timedelta(days=t)
    base = bars_of(spark, 4, ("SPY", "QQQ"))
    score = spark.createDataFrame([("SPY", day(-1), 10.0), ("QQQ", day(-1), 90.0), ("SPY", day(1), 11.0), ("QQQ", day(1), 91.0)], "symbol string, seen date, score double")
    event = spark.createDataFrame([("SPY", day(1), 1.0), ("SPY", day(3), 2.0)], "asset string, ts date, event double")
    flag = spark.createDataFrame([("SPY", day(t), float(t)) for t in (0, 2, 3)] + [("QQQ", day(2), 7.0)], "asset string, ts date, flag double")
    src = lambda i, c, t="ts", k="asset": {"source_id": i, "column": c, "time_field": t, "instrument_field": k}
    doc = {
        "primary_key": {"time_field": "ts", "instrument_field": "asset"},
        "features": [
            {"field": "score", "source": src("score", "score", "seen", "symbol"), "staleness_max_bars": 1, "lag_bars": 1}, {"field": "event", "source": src("event", "event"), "join_mode": "left", "fill_policy": "zero"},
            {"field": "held", "source": src("event", "event"), "join_mode": "left", "fill_policy": "ffill", "staleness_max_bars": 1}, {"field": "flag", "source": src("flag", "flag"), "join_mode": "inner"},
        ],
    }
    sources = {"score": score, "event": event, "flag": flag}
    out = contract.materialize(base, sources, doc)
    got = {(r["asset"], (r["ts"] - DAY).days): r for r in out.collect()}
    assert sorted(got) == [("QQQ", 2), ("SPY", 0), ("SPY", 2), ("SPY", 3)]
    spy = [got["SPY", t] for t in (0, 2, 3)]
    assert [r["score"] for r in spy] == [None, 10, 11] and [r["event"] for r in spy] == [0, 0, 2] and [r["held"] for r in spy] == [None, None, 2] and [r["flag"] for r in spy] == [0, 2, 3]
    assert [r["__audit__event__value_origin"] for r in spy] == ["zero_fill", "zero_fill", "exact"] and [r["__audit__score__stale_flag"] for r in spy] == [False, False, True]
    plan = contract.materialize(base, sources, {**doc, "features": doc["features"][:3]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    with pytest.raises(Exception, match="requires unique source keys"):
        contract.materialize(base, {**sources, "event": event.union(event)}, doc).collect()
    bad = {**doc, "features": [{"field": "a", "source": src("no", "x"), "fill_policy": "bfill"}, {"field": "a", "source": {"source_id": "flag", "column": "flag"}, "join_mode": "outer", "lag_bars": -1}]}
    assert len(contract.problems(bad, sources)) == 6
    with pytest.raises(ValueError, match="leak"):
        contract.materialize(base, sources, bad)


def choice(spark, **values):
    base = {"window_id": 0, "combo_id": 1, "objective": "sharpe", "fallback": False, **{f"{s}_{m}": 1.0 for s in ("is", "oos") for m in ("sharpe", "calmar", "total_return", "max_drawdown")}}
    return spark.createDataFrame([{**base, **values}])


def test_acceptance_by_objective(spark):
    got = lambda df, **k: wfa.accepted(df, **k).select("accepted", "oos_is_ratio", "reasons").first()
    assert tuple(got(choice(spark, is_sharpe=-0.2, oos_sharpe=1.0))) == (True, None, ["OOS/IS ratio diagnostic only"])
    assert tuple(got(choice(spark, is_sharpe=2.0, oos_sharpe=1.0, fallback=True), min_ratio=0.75)) == (False, 0.5, ["OOS/IS ratio < 0.75", "selection_constraints_fallback requires explicit acceptance opt-in"])
    row = got(choice(spark, objective="calmar", oos_calmar=0.8, oos_sharpe=-5.0, fallback=True), min_calmar=0.5, min_ratio=0.5, allow_fallback=True)
    assert row["accepted"] and row["oos_is_ratio"] == pytest.approx(0.8) and row["reasons"] == ["selection_constraints_fallback explicitly allowed"]
    assert not got(choice(spark, objective="total_return", oos_total_return=0.0))["accepted"] and got(choice(spark, objective="total_return", oos_total_return=0.0), positive=False)["accepted"]
    assert got(choice(spark))["reasons"] == ["accepted"]


def test_gates_on_mean_metrics(spark):
    def run(row, **k):
        return wfa.gated(spark.createDataFrame([row]), **k).first()

    bad = run({"is_sharpe": "not-a-number", "oos_sharpe": "also-bad", "oos_is_ratio": "bad"})
    assert not bad["accepted"] and bad["robust_score"] is None and "oos_sharpe_not_positive" in bad["reasons"]
    low = run({"is_sharpe": 2.0, "oos_sharpe": 1.0})
    assert low["reasons"] == ["oos_is_ratio_below_threshold"] and low["oos_is_ratio"] == 0.5
    free = run({"is_sharpe": -2.0, "oos_sharpe": 0.5, "oos_is_ratio": 0.1}, min_oos_sharpe=-1.0)
    assert free["accepted"] and free["robust_score"] == 0.5
    floors = {"min_oos_calmar": 0.5, "max_drawdown_floor": -0.2, "min_profit_factor": 1.2, "min_win_rate": 0.55, "min_trade_count": 20}
    all_ = run({"is_sharpe": 1.0, "oos_sharpe": 0.8, "oos_calmar": 0.4, "max_drawdown": -0.35, "profit_factor": 1.1, "win_rate": 0.5, "trade_count": 10}, **floors)
    assert len(all_["reasons"]) == 5 and "profit_factor_below_threshold" in all_["reasons"]
    with pytest.raises(ValueError, match="unknown"):
        run({"is_sharpe": 1.0, "oos_sharpe": 1.0}, min_luck=1)


def test_viability_and_its_fallback(spark):
    rows = [(0, "train", 0, 10, 5, 3, 0.9, 4), (0, "train", 1, 10, 1, 0, 0.0, 9), (1, "train", 0, 10, 0, 0, 0.0, 4)]
    scores = spark.createDataFrame(rows, "window_id int, part string, combo_id int, n int, active_bars int, active_rebalances int, exposure_ratio double, max_lookback int")
    rule = wfa.Constraints(min_active_rebalances=1, min_exposure_ratio=0.5, min_nonzero_days=2, max_lookback_fraction=0.5)
    got = {(r["window_id"], r["combo_id"]): r for r in wfa.viability(scores, rule).collect()}
    assert got[0, 0]["viability"] == ["meets_selection_constraints"] and got[0, 0]["pool_count"] == 1 and not got[0, 1]["fallback"] and got[1, 0]["fallback"] and got[1, 0]["pool_count"] == 1
    assert got[0, 1]["viability"] == ["is_active_rebalances_below_1", "is_exposure_ratio_below_0.5", "is_nonzero_return_days_below_2", "lookback_fraction_above_0.5"]
    with pytest.raises(ValueError, match="max_lookback"):
        wfa.viability(scores.drop("max_lookback"), rule)
    doc = {
        "parameter_domains": {"fast_window": {"type": "range", "start": 5, "end": 15, "step": 5}, "slow_period": [20, 40]},
        "computed_fields": [{"name": "fast_ma", "period": {"param_ref": "fast_window"}}, {"name": "slow_ma", "lookback": {"param_ref": "slow_period"}}, {"name": "literal_ma", "sma_period": 30}],
    }
    assert strategy.max_lookback(doc) == 40 and strategy.max_lookback(doc, {"slow_period": 25, "extra_window": 60}) == 60 and strategy.max_lookback({"top_n": 99}) == 0


def test_window_sizes_from_a_target():
    five = wfa.targeted(100, 0.5, 0.2, 5)
    assert len(five) == 5 and five[0][1] == 0 and five[-1][4] <= 100 and all(b - a == 50 and d - c == 20 for _, a, b, c, d in five)
    assert wfa.targeted(10, 0.9, 0.5, 3) == [] and len(wfa.targeted(12, 0.5, 0.4, 9)) == 3
    plan, sizes = wfa.automatic(1300)
    assert sizes == {"train": 300, "test": 100, "step": 100, "factor": pytest.approx(3.0), "least_train": 100, "windows": 10} and len(plan) == 10
    assert wfa.automatic(1300, lookback=250)[1]["train"] == 500 and wfa.automatic(7, target=1, train_ratio=9, test_ratio=0.1)[1]["windows"] >= 1


def plain_unit_root(x, lags=None):
    """The regression by least squares: lags by the information criterion on one sample, then fitted on all rows left."""
    dx, most = np.diff(x), stats.most_lags(len(x)) if lags is None else lags

    def fit(p, start):
        y = dx[start:]
        a = np.column_stack([x[start:-1], *(dx[start - k : len(dx) - k] for k in range(1, p + 1)), np.ones(len(y))])
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        e = y - a @ beta
        return len(y) * np.log(e @ e / len(y)) + 2 * a.shape[1], beta[0] / np.sqrt(e @ e / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])

    best = lags if lags is not None else min(range(most + 1), key=lambda p: fit(p, most)[0])
    return fit(best, best)[1]


def plain_level(x):
    n, e = len(x), x - x.mean()
    g = [e[k:] @ e[: n - k] / (n / 2) for k in range(n)]
    few = int(n ** (2 / 9))
    s0, s1 = e @ e / n + sum(g[1 : few + 1]), sum(k * g[k] for k in range(1, few + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    s2 = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[: n - k]) for k in range(1, lags + 1))) / n
    return lags, (np.cumsum(e) ** 2).sum() / (n * n * s2)


def test_stationarity_statistics(spark):
    rng = np.random.default_rng(7)
    ar = np.zeros(300)
    for t in range(1, 300):
        ar[t] = 0.8 * ar[t - 1] + rng.normal()
    series = {"noise": rng.normal(size=150), "walk": 1000 + np.cumsum(rng.normal(size=230)), "ar": ar, "short": rng.normal(size=12), "tiny": rng.normal(size=5)}
    rows = [(k, DAY + dt.timedelta(days=t), float(v)) for k, x in series.items() for t, v in enumerate(x)] + [("noise", DAY + dt.timedelta(days=999), None)]
    df = spark.createDataFrame(rows, "asset string, ts date, x double").repartition(3)
    got = {r["asset"]: r for r in stats.stationarity(df, "x").collect()}
    level = {r["asset"]: r for r in stats.level_stationarity(df, "x").collect()}
    one = {r["asset"]: r["adf"] for r in stats.unit_root(df, "x", 1).collect()}
    for k in ("noise", "walk", "ar", "short"):
        assert got[k]["adf"] == pytest.approx(plain_unit_root(series[k]), rel=1e-6) and one[k] == pytest.approx(plain_unit_root(series[k], 1), rel=1e-6)
        assert (level[k]["lags"], level[k]["kpss"]) == (plain_level(series[k])[0], pytest.approx(plain_level(series[k])[1])) and got[k]["kpss"] == level[k]["kpss"]
    assert got["noise"]["adf_stationary"] and not got["walk"]["adf_stationary"] and got["noise"]["kpss_stationary"] and not got["walk"]["kpss_stationary"] and level["ar"]["lags"] > 3
    assert got["tiny"]["adf"] is None and got["tiny"]["adf_p"] is None and not got["tiny"]["adf_stationary"]


def test_partial_autocorrelations_use_their_own_number_of_pairs(spark):
    x = np.sin(np.arange(120) / 3) + np.random.default_rng(1).normal(size=120)
    df = spark.createDataFrame([("a", DAY + dt.timedelta(days=t), float(v)) for t, v in enumerate(x)], "asset string, ts date, x double")
    got = column(stats.partial_autocorrelation(metrics.autocorrelation(df, "x", 30, adjusted=True)).orderBy("lag"), "pacf", ["lag"])
    e = x - x.mean()
    r = np.array([e[k:] @ e[: 120 - k] / (120 - k) for k in range(31)])
    want = [np.linalg.solve([[r[abs(i - j)] for j in range(k)] for i in range(k)], r[1 : k + 1])[-1] for k in range(1, 31)]
    assert got == pytest.approx(want)


def test_parameters_as_data_equal_bound_documents(spark):
    """Periods, thresholds, sizes and costs as rows of a table: the curves of the documents bound one by one."""
    ref = lambda k: {"param_ref": k}
    cross = {**strategy.template("single_signal"), "cost": ref("cost")}
    cross["features"] = {"fast": {"op": "indicator.sma", "period": ref("fast")}, "slow": {"op": "indicator.ema", "period": ref("slow")}}
    level = {
        "features": {"z": {"op": "indicator.zscore", "period": ref("n")}}, "entry": {"op": "gt", "left": "z", "right": ref("up")}, "exit": {"op": "lt", "left": "z", "right": 0.0},
        "rebalance": {"op": "calendar.every_session"}, "allocation": {"type": "equal_weight", "position_limit": ref("limit")}, "execution": "next_open", "cost": 0.002,
    }
    rank = {**strategy.template("ranked_rotation"), "selector": {"score": "score", "top_n": ref("k")}, "cost": 0.001}
    for doc, combos in (
        (cross, [{"fast": f, "slow": s, "cost": c} for f in (2, 3) for s in (4, 6) for c in (0.0, 0.01)]), (level, [{"n": n, "up": u, "limit": w} for n in (3, 5) for u in (0.2, 0.8) for w in (0.4, 1.0)]),
        (rank, [{"k": 1}, {"k": 2}]),
    ):
        assert strategy.gridable(doc)
        got = strategy.run_matrix(two(spark), doc, combos)
        docs = strategy.variants(doc, combos)
        want = strategy.accounts(strategy.targets_long(two(spark), docs), docs)
        for c in ("equity", "turnover"):
            assert column(got, c, ["backtest_id", "ts"]) == pytest.approx(column(want, c, ["backtest_id", "ts"]), abs=1e-9)
    assert not strategy.gridable({**cross, "risk_gates": {"max_drawdown": 0.1}}) and not strategy.gridable({**cross, "rebalance": {"op": "calendar.nth_session", "n": ref("n")}})


def test_planning_does_not_grow_with_combinations(spark):
    import time

    doc = {**strategy.template("single_signal"), "cost": 0.001}
    doc["features"]["slow"]["period"], doc["entry"] = {"param_ref": "slow"}, {"op": "gt", "left": "fast", "right": {"param_ref": "level"}}
    took = []
    for n in (20, 2000):
        combos = [{"slow": 4 + k % 5, "level": k / 10} for k in range(n)]
        start = time.perf_counter()
        out = strategy.run_matrix(two(spark), doc, combos)
        out._jdf.queryExecution().executedPlan()
        took.append(time.perf_counter() - start)
    assert took[1] < 10 and len(out._jdf.queryExecution().executedPlan().toString()) < 200_000
    assert out.select("backtest_id").distinct().count() == 2000


def test_fronts_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    v = np.round(rng.normal(size=(150, 3)), 1)
    v[7] = v[3]
    left, want, k = set(range(150)), {}, 0
    while left:
        best = [i for i in left if not any((v[j] >= v[i]).all() and (v[j] > v[i]).any() for j in left)]
        want |= {i: k for i in best}
        left -= set(best)
        k += 1
    assert matrix.sorted_fronts(v).tolist() == [want[i] for i in range(150)]
    assert [i for i in range(150) if matrix.best_rows(v, 16)[i]] == [i for i in range(150) if want[i] == 0]
    df = spark.createDataFrame([(i, float(a), float(-b), float(c)) for i, (a, b, c) in enumerate(v)] + [(999, None, 0.0, 0.0)], "i int, a double, b double, c double").repartition(5)
    assert sorted(column(matrix.front(df, {"a": "max", "b": "min", "c": "max"}), "i", ["i"])) == [i for i in range(150) if want[i] == 0]
    gaps = matrix.crowding(np.array([[0.0, 4.0], [1.0, 3.0], [3.0, 1.0], [4.0, 0.0]]))
    assert gaps.tolist() == [math.inf, 1.5, 1.5, math.inf] and matrix.crowding(np.ones((3, 2))).tolist()[1] == 0


def test_search_for_several_objectives():
    axes = {"x": {"type": "range", "start": 0, "stop": 20}, "y": {"type": "range", "start": 0, "stop": 20}}
    goal = lambda p: (-((p["x"] - 5) ** 2) - p["y"], -((p["x"] - 15) ** 2) - p["y"], p["y"])
    found = matrix.search_front(lambda rows: [goal(p) for p in rows], axes, 120)
    best = [p for p, _, k in found if k == 0]
    assert len(found) == 120 and found[0][2] == 0 and len({tuple(p.values()) for p, _, _ in found}) == 120
    whole = np.array([goal({"x": x, "y": y}) for x in range(21) for y in range(21)]) * [1, 1, -1]
    values = np.array([goal(p) for p in best]) * [1, 1, -1]
    assert all(not matrix.dominates(values[i : i + 1], values).any() for i in range(len(best)))
    true = {tuple(t) for t in whole[matrix.best_rows(whole)]}
    assert sum(tuple(t) in true for t in values) >= 8


def test_halving_finds_the_optimum_and_reads_less(spark):
    rows = [(a, DAY + dt.timedelta(days=t), float(p)) for a, s in (("a", 15), ("b", 25)) for t, p in enumerate(100 + s * np.sin(np.arange(180) / 5))]
    df = spark.createDataFrame(rows, "asset string, ts date, close double").withColumns({c: F.col("close") for c in ("open", "high", "low")}).withColumn("volume", F.lit(1.0))
    doc = {**strategy.template("single_signal"), "cost": 0.001}
    doc["features"]["fast"]["period"], doc["features"]["slow"]["period"] = {"param_ref": "fast"}, {"param_ref": "slow"}
    combos = [{"fast": f, "slow": s} for f in (2, 3, 5) for s in (8, 13, 21)]
    best, report = strategy.pruned(df, doc, combos, shares=(1 / 3, 1.0), keep=1 / 3)
    every = strategy.optimum(df, doc, {"fast": {"type": "set", "values": [2, 3, 5]}, "slow": {"type": "set", "values": [8, 13, 21]}}, 9)
    assert best[0][0] == every[0][0] and best[0][1] == pytest.approx(every[0][1]) and [r["evaluated"] for r in report] == [9, 3]
    assert sum(r["bars"] for r in report) < 360 * 9
    points = strategy.frontier(df, doc, {"fast": {"type": "set", "values": [2, 3]}, "slow": {"type": "set", "values": [8, 13]}}, 4, {"total_return": "max", "max_drawdown": "max"})
    assert len(points) == 4 and points[0][2] == 0


def test_quantiles_are_selected_exactly(spark):
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=3000), np.r_[np.zeros(2000), rng.normal(size=1000)], np.ones(50), rng.integers(0, 4, 1001).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in x], "v double")
        for share in (0.0, 0.5, 0.93, 1.0):
            assert align.quantile(df, "v", share, most=40) == pytest.approx(np.quantile(x, share), abs=1e-12)
    assert align.quantile(df.limit(0), "v", 0.5) is None


def test_members_meet_dates_by_buckets(spark):
    rng = np.random.default_rng(6)
    day = dt.date(2000, 1, 1)
    spans = [(f"m{i}", day + dt.timedelta(days=int(a)), None if i % 5 == 0 else day + dt.timedelta(days=int(a + n))) for i, (a, n) in enumerate(zip(rng.integers(-9000, 9000, 120), rng.integers(-3, 4000, 120)))]
    dates = [day + dt.timedelta(days=int(t)) for t in rng.integers(-9500, 13_000, 80)] + [day]
    got = align.as_of_members(spark.createDataFrame(spans, "asset string, start date, end date"), spark.createDataFrame([(t,) for t in dates], "ts date"))
    want = sorted((t, a) for t in dates for a, s, e in spans if s <= t and (e is None or t <= e))
    assert sorted((r["ts"], r["asset"]) for r in got.collect()) == want
    assert not any(k in got._jdf.queryExecution().toString() for k in ("NestedLoop", "Cartesian"))


def test_averages_over_blocks_equal_one_pass(spark):
    """Blocks of a few rows, gaps of any length, two assets of different length, one of them without a value."""
    rng = np.random.default_rng(4)
    x = {"a": rng.normal(100, 10, 300), "b": rng.normal(5, 1, 90), "c": np.full(40, np.nan)}
    x["a"][rng.random(300) < 0.3] = np.nan
    x["a"][100:160] = np.nan
    x["b"][:7] = np.nan
    rows = [(k, DAY + dt.timedelta(days=t), None if np.isnan(p) else float(p), float(abs(p)) + 1, float(abs(p)) - 1) for k, v in x.items() for t, p in enumerate(v)]
    rows = [(k, t, p, h if h == h else 1.0, low if low == low else 0.0) for k, t, p, h, low in rows]
    df = spark.createDataFrame(rows, "asset string, ts date, close double, high double, low double").repartition(3)
    specs = {
        "e": {"op": "ema", "period": 6}, "m": {"op": "macd", "fast": 3, "slow": 7, "signal": 4, "output": "signal"}, "h": {"op": "macd", "fast": 3, "slow": 7, "signal": 4, "output": "histogram"},
        "w": {"op": "atr", "period": 9}, "we": {"op": "atr", "period": 9, "method": "ema"}, "l": {"op": "legacy_ema", "period": 40},
    }
    one = indicators.recursive(df, specs).toPandas().sort_values(["asset", "ts"]).reset_index(drop=True)
    for size in (7, 50):
        many = indicators.recursive(df, specs, size).toPandas().sort_values(["asset", "ts"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(one, many, rtol=1e-10, atol=1e-10)
    for k in "ab":
        want = pd.Series(x[k]).ewm(span=6, adjust=False, min_periods=6).mean()
        assert one[one.asset == k]["e"].fillna(-1).tolist() == pytest.approx(want.fillna(-1).tolist())
    line = pd.Series(x["b"]).ewm(span=3, adjust=False, min_periods=3).mean() - pd.Series(x["b"]).ewm(span=7, adjust=False, min_periods=7).mean()
    assert one[one.asset == "b"]["m"].fillna(-1).tolist() == pytest.approx(line.ewm(span=4, adjust=False, min_periods=4).mean().fillna(-1).tolist())
    tr = [h - low for h, low in ((r[3], r[4]) for r in rows if r[0] == "c")]
    assert one[one.asset == "c"]["w"].tolist()[8:] == pytest.approx([np.mean(tr[:9])] * 32) and one[one.asset == "c"]["e"].isna().all()


def test_cuts_follow_the_rows(spark):
    """Most rows in one hour: it is cut, the year around it is not."""
    crowd = spark.range(20_000).select((F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 180_000)).alias("ts"))
    quiet = spark.range(300).select(F.timestamp_micros(F.lit(1_690_000_000_000_000) + F.col("id") * 86_400_000_000).alias("ts"))
    both = crowd.unionByName(quiet)
    at = blocks.cuts([crowd, quiet], rows=1000)
    sizes = blocks.with_block(both, at).groupBy("_block").count().toPandas()["count"]
    assert 18 <= len(sizes) <= 22 and sizes.max() <= 1600
    assert blocks.cuts([quiet], rows=1000) == [] and blocks.cuts([crowd.limit(0)], rows=10) == []


def test_clean(spark):
    df = spark.createDataFrame([("1,234.5", 1), ("2.5k", 2), ("3M", 3), ("1b", 4), ("n/a", 5), (None, 6)], "t string, i int")
    assert column(df.withColumn("x", clean.number(F.col("t"))), "x", "i") == [1234.5, 2500.0, 3e6, 1e9, None, None]
    std = clean.standard_columns(spark.createDataFrame([(1, 2, 3)], ["Date", "timestamp", "c"]))
    assert std.columns == ["Time", "timestamp", "Close"]
    assert clean.required_columns(std).columns == ["Time", "Open", "High", "Low", "Close", "Volume"]
    d = spark.createDataFrame([("16/01/2024",), ("02/01/2024",)], "t string")
    assert column(clean.inferred_dates(d, "t"), "ts") == [dt.date(2024, 1, 2), dt.date(2024, 1, 16)]


def test_closed_form_equals_fold_with_costs(spark):
    rng = np.random.default_rng(5)
    rows = [("b", DAY + dt.timedelta(days=t), a, float(p), float(w)) for a in "xyz" for t, (p, w) in enumerate(zip(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 40))), rng.dirichlet(np.ones(40)) * 10))]
    df = spark.createDataFrame(rows, "backtest_id string, ts date, asset string, close double, target double")
    df = df.withColumn("target", signals.frame_weight(F.col("target")))
    a, b = portfolio.every_bar(df, 0.002), portfolio.folded_account(df.withColumn("rebalance", F.lit(True)), 0.002)
    assert column(a, "equity") == pytest.approx(column(b, "equity"), abs=1e-9)


def test_closed_forms_equal_folds_through_losses(spark):
    """Prices that fall to 0 or jump, short targets: window forms and folds agree, with and without fills at the open."""
    rng = np.random.default_rng(15)
    rows = []
    for b in range(4):
        for a in "xyz":
            px = 100 * np.exp(np.cumsum(rng.normal(0, 0.05, 30)))
            if b % 2 and a == "x":
                px[12:] = 0.0
            if b > 1 and a == "y":
                px[20:] *= 40
            opens = px * rng.uniform(0.97, 1.03, 30)
            rows += [(f"b{b}", DAY + dt.timedelta(days=t), a, float(o), float(c), float(w)) for t, (o, c, w) in enumerate(zip(opens, px, rng.uniform(-1.2, 1.2, 30)))]
    df = spark.createDataFrame(rows, "backtest_id string, ts date, asset string, open double, close double, target double")
    every = df.withColumn("rebalance", F.lit(True))
    for a, b in ((portfolio.every_bar(df, 0.002), portfolio.folded_account(every, 0.002)), (portfolio.next_open(df, 0.002), portfolio.folded_account(every, 0.002, at="next_open"))):
        for name in ("equity", "turnover"):
            assert column(a, name, ["backtest_id", "ts"]) == pytest.approx(column(b, name, ["backtest_id", "ts"]), rel=1e-9, abs=1e-9)
    bad = portfolio.every_bar(df, 0.002).where("equity <= 0").count()
    assert bad >= 10
    one = spark.createDataFrame([("a", DAY, 10.0, 10.0, True), ("a", DAY + dt.timedelta(days=1), 10.0, 25.0, True), ("a", DAY + dt.timedelta(days=2), 10.0, 10.0, True)], "asset string, ts date, open double, close double, entry boolean")
    assert column(simulate.same_session(one, 0.0, 0.0, side=-1), "equity") == pytest.approx([100, -50, -50])
    gone = one.withColumn("close", F.when(F.col("close") == 25, 1e-300).otherwise(F.col("close")))
    assert column(simulate.same_session(gone, 0.0, 0.0), "equity") == pytest.approx([100, 0, 0], abs=1e-9)


@pytest.mark.parametrize("at", ["close", "next_open"])
def test_segments_equal_the_fold(spark, at):
    """Sparse rebalances, gaps, shorts, prices that fall to 0 or jump, several total losses between two rebalances."""
    rng = np.random.default_rng(25)
    rows = []
    for b in range(6):
        traded = rng.random(60) < (0.02, 0.1, 0.3, 0.1, 1.0, 0.1)[b]
        for a in "wxyz":
            px = 100 * np.exp(np.cumsum(rng.normal(0, 0.05, 60)))
            if b == 2 and a == "x":
                px[12:] = 0.0
            if b in (3, 4) and a == "y":
                px[20:] *= 40
                px[24:] *= 30
                px[26:] *= 20
            side = 1 if b in (0, 1) else rng.choice([-1, 1])
            opens = px * rng.uniform(0.97, 1.03, 60)
            for t in range(60):
                if b == 5 and rng.random() < 0.1:
                    continue
                rows.append((f"b{b}", DAY + dt.timedelta(days=t), a, float(opens[t]), float(px[t]) if b != 5 or t % 17 else None, float(side * rng.uniform(0, 0.25 if b < 2 else 0.6)), bool(traded[t])))
    df = spark.createDataFrame(rows, "backtest_id string, ts date, asset string, open double, close double, target double, rebalance boolean")
    a, b = portfolio.account(df, 0.002, at=at), portfolio.folded_account(df, 0.002, at=at)
    for name in ("equity", "ret", "turnover", "trade_cost", "selected", "gross", "gross_size", "cash"):
        assert column(a, name, ["backtest_id", "ts"]) == pytest.approx(column(b, name, ["backtest_id", "ts"]), rel=1e-8, abs=1e-8), name
    for name in ("weights", "before", "contributions"):
        for x, y in zip(column(a, name, ["backtest_id", "ts"]), column(b, name, ["backtest_id", "ts"])):
            assert x == pytest.approx(y, rel=1e-7, abs=1e-8), name
    assert a.where("equity <= 0").count() >= 10
    assert "ArrowPython" not in a._jdf.queryExecution().toString() and "InPandas" not in a._jdf.queryExecution().toString()
    s = {r["backtest_id"]: r for r in portfolio.accounting_summary(a).collect()}
    last = {r["backtest_id"]: r["equity"] for r in b.orderBy("ts").collect()}
    assert s["b1"]["final_equity"] == pytest.approx(last["b1"]) and s["b1"]["checkpoints"] == 60 and s["b1"]["start_equity"] == 100


def test_gross_limit_is_by_size(spark):
    rows = [("b", DAY + dt.timedelta(days=t), a, 10.0, w) for t in range(2) for a, w in (("x", 1.5), ("y", -1.0))]
    df = spark.createDataFrame(rows, "backtest_id string, ts date, asset string, close double, target double")
    for curve in (portfolio.every_bar(df, 0.0), portfolio.account(df.withColumn("rebalance", F.lit(True)), 0.0), portfolio.folded_account(df.withColumn("rebalance", F.lit(True)), 0.0)):
        found = portfolio.invariant_breaches(curve, long_only=False, max_gross=1.0).collect()
        assert [(r["code"], r["value"]) for r in found] == [("max_gross", 2.5)] * 2 and column(curve, "gross") == [0.5, 0.5]


def test_account_frames(spark):
    rows = [("b", DAY + dt.timedelta(days=t), a, 10.0 + t * k, w, t in (0, 2)) for t in range(4) for a, k, w in (("x", 1.0, 0.5), ("y", -1.0, 0.5))]
    df = spark.createDataFrame(rows, "backtest_id string, ts date, asset string, close double, target double, rebalance boolean")
    curve = portfolio.account(df, 0.01, portfolio.Gates(max_drawdown=0.005, action="reduce_exposure"))
    assert portfolio.rebalance_audit(curve).count() == 2
    trades = {(r["ts"], r["asset"]): r for r in portfolio.account_trades(curve).collect()}
    late = DAY + dt.timedelta(days=2)
    # two days of +1 and -1 on prices of 10 leave the account as it was and weights at 0.6 and 0.4; a drawdown of the entry cost halves the target
    events = [(r["ts"], r["gate"], r["limit"], round(r["observed"], 6)) for r in portfolio.gate_events(curve).collect()]
    assert events == [(late, "max_drawdown", -0.005, -0.01)]
    assert trades[late, "x"]["before"] == pytest.approx(0.6) and trades[late, "y"]["before"] == pytest.approx(0.4) and trades[late, "x"]["target"] == 0.25
    paid = {r["ts"]: r["trade_cost"] for r in curve.collect()}
    assert sum(t["cost"] for k, t in trades.items() if k[0] == late) == pytest.approx(paid[late]) and trades[late, "x"]["cost"] == pytest.approx(paid[late] * 0.35 / 0.5)
    assert {(r["asset"], r["weight"]) for r in portfolio.holdings(curve).where(F.col("ts") == late).collect()} == {("x", 0.25), ("y", 0.25)}
    assert portfolio.position_breaches(curve, df, portfolio.account_trades(curve)).collect() == []
    worse = curve.withColumn("equity", F.col("equity") + 1).withColumn("weights", F.create_map(F.lit("x"), F.lit(-0.5)))
    bad = {r["code"] for r in portfolio.position_breaches(worse, df.withColumn("close", F.lit(float("nan"))), portfolio.account_trades(curve).withColumn("cost", F.lit(-1.0))).collect()}
    assert bad == {"equity_cash_market_value_mismatch", "long_only_negative_position", "market_value_positions_prices_mismatch", "non_finite_price", "trade_record_negative_or_non_finite_fee", "trade_record_position_reconciliation_mismatch"}


def test_gates():
    g = portfolio.Gates(max_daily_loss=0.02, max_drawdown=0.1, max_positions=1, max_order_size=0.3, action="flatten")
    t, b = np.array([0.5, 0.4]), np.array([0.1, 0.0])
    assert g.apply(t, b, 100, 100, 0.0)[0] == pytest.approx([0.4, 0.0])
    w, events = g.apply(t, b, 80, 100, -0.03)
    assert w == pytest.approx([0, 0]) and [e[0] for e in events] == ["max_daily_loss", "max_drawdown"]
    assert portfolio.Gates(max_daily_loss=0.02, action="block_new_orders").apply(t, b, 1, 1, -1)[0] == pytest.approx([0.1, 0.0])


def test_invariants(spark):
    df = spark.createDataFrame([("b", DAY, 100.0, 0.0, 0.1, 0.0, 1.2), ("b", DAY, float("nan"), 0.0, 0.1, -1.0, 0.5)], "backtest_id string, ts date, equity double, ret double, turnover double, trade_cost double, gross double")
    assert sorted(column(portfolio.invariant_breaches(df), "code", "code")) == ["max_gross", "negative_cash", "negative_fee", "non_finite_equity"]


def test_factor_neutral_and_reserved(spark):
    df = spark.createDataFrame([(DAY, a, g, float(x)) for a, g, x in (("a", "p", 1), ("b", "p", 3), ("c", "q", 5), ("d", None, 7))], "ts date, asset string, g string, x double")
    assert column(df.withColumn("n", factors.neutralize(F.col("x"), F.col("g"))), "n", "asset") == [-1, 1, 0, 7]
    with pytest.raises(NotImplementedError):
        factors.combine("ic_weight", ["x"])


def test_clusters(spark):
    assert [matrix.cluster_count(n) for n in (1, 3, 4, 8, 9, 16, 100)] == [1, 1, 2, 2, 3, 4, 5]
    df = spark.createDataFrame([(1.0, 10.0, 0.1), (2.0, 10.0, 0.2), (9.0, 10.0, 0.9)], "a double, b double, s double")
    assert [r["a"] for r in matrix.clusters(df, ["a", "b"], "s").where("representative").collect()] == [2.0]
    tie = spark.createDataFrame([(1.0, 0.1), (3.0, 0.9), (2.5, 0.3), (1.5, 0.4)], "a double, s double").where("a in (1, 3)")
    assert [r["a"] for r in matrix.clusters(tie, ["a"], "s").where("representative").collect()] == [3.0]


def test_page_metrics_over_months(spark):
    days = [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 5), dt.date(2024, 2, 20), dt.date(2024, 3, 1)]
    path = metrics.with_path(spark.createDataFrame([("a", d, e) for d, e in zip(days, (100.0, 110.0, 99.0, 99.0, 198.0))], "asset string, ts date, equity double"))
    r = metrics.page_metrics(path).first()
    assert (r["best_month"], r["worst_month"], r["positive_month_ratio"]) == pytest.approx((1.0, -0.1, 2 / 3))
    assert (r["win_rate"], r["gain_loss_ratio"], r["profit_factor"], r["average_drawdown"]) == pytest.approx((2 / 3, 0.55 / 0.1, 11.0, -0.04))


def test_matrix_domains():
    assert matrix.expand({"type": "range", "start": 0.1, "stop": 0.3, "step": 0.1}) == pytest.approx([0.1, 0.2, 0.3])
    rows, warn = matrix.combos({"a": {"type": "set", "values": [1, 2]}, "b": {"type": "fixed", "value": 3}}, warn_cap=1)
    assert rows == [{"a": 1, "b": 3}, {"a": 2, "b": 3}] and warn
    with pytest.raises(ValueError):
        matrix.combos({"a": {"type": "range", "start": 1, "stop": 10}}, hard_cap=5)
    assert len(matrix.sampled([{"a": i} for i in range(10)], 4)) == 4


def test_sequential_search(spark):
    domains = {"a": {"type": "range", "start": 0, "stop": 30}, "b": {"type": "set", "values": list(range(20))}}
    calls = []

    def evaluate(rows):
        calls.append(len(rows))
        return [None if r["a"] == 0 else -((r["a"] - 21) ** 2) - (r["b"] - 5) ** 2 for r in rows]

    found = matrix.search(evaluate, domains, 80, batch=10)
    even = max(-((r["a"] - 21) ** 2) - (r["b"] - 5) ** 2 for r in matrix.sampled(matrix.combos(domains)[0], 80))
    assert len(found) == 80 and calls == [10] * 8 and len({tuple(p.values()) for p, _ in found}) == 80 and found[0][1] >= max(even, -8)
    assert found == matrix.search(evaluate, domains, 80, batch=10)
    small = matrix.search(lambda rows: [1.0] * len(rows), {"a": {"type": "set", "values": [1, 2, 3]}}, 10)
    assert sorted(p["a"] for p, _ in small) == [1, 2, 3]
    doc = {**strategy.template("single_signal"), "cost": 0.01}
    doc["features"]["slow"]["period"] = {"param_ref": "slow"}
    best = strategy.optimum(two(spark), doc, {"slow": {"type": "set", "values": [4, 5, 6]}}, 3)
    alone = {k: column(strategy.run(two(spark), strategy.bound(doc, {"slow": k})), "equity")[-1] / 100 - 1 for k in (4, 5, 6)}
    assert best[0][1] == pytest.approx(max(alone.values())) and {p["slow"] for p, _ in best} == {4, 5, 6}


def test_p_values_of_stationarity():
    assert [round(stats.adf_p(v), 2) for v in (-3.43, -2.86, -2.57)] == [0.01, 0.05, 0.1] and stats.adf_p(3.0) == 1.0 and stats.adf_p(-20.0) == 0.0
    assert abs(stats.adf_p(-1.61) - stats.adf_p(-1.6099)) < 2e-3
    assert [stats.kpss_p(v) for v in (0.1, 0.347, 0.463, 0.739, 5.0)] == pytest.approx([0.1, 0.1, 0.05, 0.01, 0.01])


def test_windows():
    assert wfa.windows(10, 4, 2) == [(0, 0, 4, 4, 6), (1, 2, 6, 6, 8), (2, 4, 8, 8, 10)]
    assert wfa.windows(10, 4, 2, anchored=True)[-1] == (2, 0, 8, 8, 10)
    assert wfa.sized(100, 0.5, 0.25)[0] == (0, 0, 50, 50, 75)


def test_statistics():
    assert stats.correlation_p(0.5, 20) == pytest.approx(0.0247, abs=1e-3)
    rng = np.random.default_rng(1)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    # see test_stationarity_statistics for the statistics themselves
    assert stats.durbin(np.array([0.5, 0.25, 0.125])) == pytest.approx([0.5, 0, 0], abs=1e-12)


def test_normality_statistics(spark):
    x = np.sort(np.random.default_rng(3).normal(2, 3, 50))
    df = spark.createDataFrame([("a", DAY, float(v)) for v in x], "asset string, ts date, x double")
    row = stats.distribution(df, "x").first()
    phi = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    q = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in (x - x.mean()) / x.std(ddof=1)])
    i = np.arange(1, 51)
    assert row["ks"] == pytest.approx(max((i / 50 - phi).max(), (phi - (i - 1) / 50).max()))
    assert row["anderson"] == pytest.approx(-50 - ((2 * i - 1) * (np.log(q) + np.log(1 - q[::-1]))).sum() / 50)


def test_metrics_edge_cases(spark):
    flat = metrics.with_path(spark.createDataFrame([("a", DAY + dt.timedelta(days=i), 100.0) for i in range(3)], "asset string, ts date, equity double"))
    row = metrics.summary(flat).first()
    assert row["sharpe"] == 0 and row["calmar"] == 0 and row["max_drawdown"] == 0
    assert metrics.drawdown_stats(flat).first()["longest_periods"] == 0


def test_strategy_documents(spark):
    doc = strategy.template("single_signal", cost=0.001)
    assert strategy.plan(doc)["accounting"] in ("fold", "segments") and strategy.plan(strategy.template("ranked_rotation"))["accounting"] == "closed_form"
    out = strategy.run(panel(spark, [5, 4, 3, 4, 5, 6, 7, 8, 7, 6, 5, 4]), doc)
    assert out.count() == 12 and out.agg(F.max("gross")).first()[0] == 1
    with pytest.raises(ValueError, match="unknown op"):
        strategy.normalized({"entry": {"op": "zap"}})
    with pytest.raises(ValueError, match="after the bar closes"):
        strategy.normalized({**doc, "execution": "same_session"})
    shared = {"a": {"op": "indicator.sma", "period": 3}, "b": {"op": "indicator.sma", "period": 3}}
    assert strategy.plan({"features": shared})["features"] == [["a", "b"]]
    assert strategy.bound({"x": {"param_ref": "p"}}, {"p": 4}) == {"x": 4}


def two(spark):
    up = [5, 4, 3, 4, 5, 6, 7, 8, 7, 6, 5, 4, 6, 8, 7, 9]
    return panel(spark, up).unionByName(panel(spark, [9, 8, 9, 7, 6, 8, 9, 5, 4, 5, 6, 8, 9, 7, 5, 6], "b"))


def test_matrix_is_its_single_runs(spark):
    doc = strategy.template("single_signal", risk_gates={"max_drawdown": {"param_ref": "down"}})
    doc["features"]["slow"]["period"], doc["cost"] = {"param_ref": "slow"}, {"param_ref": "cost"}
    combos = [{"slow": 4, "cost": 0.0, "down": 0.9}, {"slow": 5, "cost": 0.01, "down": 0.9}, {"slow": 5, "cost": 0.05, "down": 0.05}]
    rows = strategy.run_matrix(two(spark), doc, combos).collect()
    seen = set()
    for i, c in enumerate(combos):
        alone = column(strategy.run(two(spark), strategy.bound(doc, c)), "equity")
        assert [r["equity"] for r in sorted(rows, key=lambda r: r["ts"]) if r["backtest_id"] == f"v{i}"] == pytest.approx(alone)
        seen.add(tuple(alone))
    assert len(seen) == 3 and any(r["gates"] for r in rows if r["backtest_id"] == "v2")
    swept = strategy.run_matrix(two(spark), strategy.template("ranked_rotation", cost={"param_ref": "cost"}), [{"cost": 0.0}, {"cost": 0.02}])
    end = {r["backtest_id"]: r["equity"] for r in swept.orderBy("ts").collect()}
    assert end["v0"] > end["v1"]
    with pytest.raises(ValueError, match="share"):
        strategy.accounts(None, {"a": strategy.template("ranked_rotation"), "b": strategy.template("ranked_rotation", execution="next_open")})


def test_document_options(spark):
    base = strategy.template("single_signal", rebalance={"op": "calendar.every_session"})
    plain_, timed = (column(strategy.targets(panel(spark, [5, 4, 3, 4, 5, 6, 7, 8, 9, 10]), d), "target") for d in (base, {**base, "timer": {"bars": 2}}))
    first = plain_.index(1.0)
    assert plain_[first:] == [1.0] * (10 - first) and timed[first : first + 3] == [1.0, 1.0, 0.0]
    profiles = {"type": "fixed_weight", "weight_profiles": {"p": {"a": 0.9, "b": 0.6}, "q": {"a": -1, "b": 0.2}}, "profile_id": {"param_ref": "id"}}
    doc = {"allocation": profiles, "rebalance": {"op": "calendar.every_session"}}
    got = {(r["backtest_id"], r["asset"]): round(r["target"], 6) for r in strategy.targets_long(two(spark), strategy.variants(doc, [{"id": "p"}, {"id": "q"}])).collect()}
    assert got == {("v0", "a"): 0.6, ("v0", "b"): 0.4, ("v1", "a"): 0.0, ("v1", "b"): 0.2}
    with pytest.raises(ValueError, match="profile"):
        strategy.targets(two(spark), strategy.bound(doc, {"id": "z"}))
    framed = two(spark).withColumn("w", F.when(F.col("asset") == "a", 0.9).otherwise(-0.6))
    for short, want in ((False, {"a": 0.9, "b": 0.0}), (True, {"a": 0.6, "b": -0.4})):
        doc = {"allocation": {"type": "target_weight_frame", "frame": "w", "allow_short": short}, "rebalance": {"op": "calendar.every_session"}}
        assert {r["asset"]: round(r["target"], 6) for r in strategy.targets(framed, doc).collect()} == want
    some = strategy.template("ranked_rotation")
    some["selector"] = {**some["selector"], "top_n": 1, "eligible": {"op": "calendar.weekday_eq", "weekday": "monday"}}
    assert all(r["ts"].weekday() == 0 for r in strategy.targets(two(spark), some).where("selected").collect())
    for bad, what in (({"execution": "zap"}, "unknown 'zap'"), ({"execution": "bar_offset"}, "needs enter"), ({"execution": "event_overlay"}, "needs event"), ({"execution": "same_session", "risk_gates": {"max_positions": 1}}, "not with")):
        with pytest.raises(ValueError, match=what):
            strategy.normalized(bad)


def test_walk_forward_over_documents(spark):
    entry = {"op": "gt", "left": "fast", "right": "slow"}
    average = lambda k: {"op": "indicator.sma", "period": {"param_ref": k}}
    doc = {"features": {"fast": average("fast"), "slow": average("slow")}, "entry": entry, "exit": {"op": "not", "node": entry}, "rebalance": {"op": "signal.change"}, "cost": 0.01}
    combos = [{"fast": 2, "slow": 3}, {"fast": 2, "slow": 4}]
    plan = wfa.windows(16, 6, 4, 3)
    scores = strategy.walk_forward(two(spark), doc, combos, plan)
    rows = {(r["window_id"], r["part"], r["combo_id"]): r for r in scores.collect()}
    assert set(rows) == {(w[0], p, c) for w in plan for p in ("train", "test") for c in (0, 1)}
    w = plan[1]
    days = [DAY + dt.timedelta(days=k) for k in range(16)]
    alone = strategy.run(two(spark).where(F.col("ts").between(days[w[1]], days[w[2] - 1])), strategy.bound(doc, combos[1]))
    assert rows[1, "train", 1]["total_return"] == pytest.approx(column(alone, "equity")[-1] / 100 - 1) and rows[1, "train", 1]["n"] == 6
    chosen = wfa.accepted(wfa.select(scores, labels=()))
    assert {r["window_id"] for r in chosen.collect()} == {w[0] for w in plan} and wfa.ranking_report(chosen, labels=()).count() >= 1



def test_sources_and_sinks(spark, tmp_path):
    wide = spark.createDataFrame([("2024-01-01", 1.0, float("nan")), ("2024-01-02", 2.0, 3.0)], "Date string, A double, B double")
    long = readers.multi_field({"close": wide, "volume": wide})
    assert long.count() == 4 and long.where("close is null").count() == 1
    calls = []

    def load():
        calls.append(1)
        return wide

    for _ in range(2):
        assert readers.cached(spark, str(tmp_path / "cache"), {"s": "A"}, load).count() == 2
    assert len(calls) == 1
    readers.cached(spark, str(tmp_path / "cache"), {"s": "A"}, load, now=4e9)
    assert len(calls) == 2
    wide.write.option("header", True).csv(str(tmp_path / "p.csv"))
    assert readers.predictor(spark, str(tmp_path / "p.csv")).columns == ["ts", "A", "B"]
    with pytest.raises(ValueError):
        readers.scan(spark, "x.unknown")
    curve = spark.createDataFrame([("b", DAY, 100.0, {"a": 1.0})], "backtest_id string, ts date, equity double, weights map<string,double>")
    sinks.portfolio({"equity_curve": curve}, str(tmp_path / "out"), {"a": 1}, {}, csv=True)
    assert spark.read.parquet(str(tmp_path / "out/equity_curve")).count() == 1
    sinks.metrics(curve, str(tmp_path / "m"), {})
    assert dict(spark.read.parquet(str(tmp_path / "m/metrics")).dtypes)["equity"] == "float"


def test_other_readers(spark, tmp_path):
    t = lambda n: str(tmp_path / n)
    spark.createDataFrame([("2024-01-01", "1", "x", 3.0)], "date string, o string, h string, close double").write.option("header", True).csv(t("p.csv"))
    one = readers.single_asset(spark, t("p.csv")).first()
    assert (one["Open"], one["High"], one["Low"], one["Close"]) == (1.0, None, None, 3.0)
    spark.createDataFrame([("A", "2024-01-01", None), ("B", "2024-01-01", "2024-02-01")], "Symbol string, start_date string, end_date string").write.parquet(t("u.parquet"))
    assert [tuple(r) for r in readers.universe(spark, t("u.parquet")).orderBy("asset").collect()] == [("A", DAY, None), ("B", DAY, dt.date(2024, 2, 1))]
    spark.createDataFrame([("2024-01-01",), ("2024-01-01",), ("none",)], "date string").write.json(t("e.json"))
    with_bad = readers.scan(spark, t("e.json")).where("date <> 'none'")
    with_bad.write.json(t("f.jsonl"))
    assert [r["event"] for r in readers.event_dates(spark, t("f.jsonl")).collect()] == [DAY]
    price, outside = panel(spark, [1, 2]), spark.createDataFrame([(DAY, 7.0)], "ts date, x double")
    assert readers.joined_predictor(price, outside).count() == 1
    with pytest.raises(Exception, match="no common time"):
        readers.joined_predictor(price, outside.withColumn("ts", F.lit(dt.date(2020, 1, 1)))).collect()
    a, b = (spark.createDataFrame([(DAY, s, v)], "ts date, asset string, close double") for s, v in (("A", 1.0), ("B", 2.0)))
    assert column(readers.with_retried(a, b.unionAll(a.withColumn("close", F.lit(9.0)))), "close", "asset") == [1.0, 2.0]
    a.write.parquet(t("runs/1.parquet"))
    b.write.parquet(t("runs/2.parquet"))
    assert {r["source_file"].split("/")[-2] for r in readers.runs(spark, t("runs/*.parquet")).collect()} == {"1.parquet", "2.parquet"}


def test_other_sinks(spark, tmp_path):
    t = lambda n: str(tmp_path / n)
    df = spark.createDataFrame([("b", 1.0)], "backtest_id string, x double")
    sinks.trade_records(df, t("r"), ("parquet", "csv", "json", "orc"), audit=df)
    assert spark.read.orc(t("r/orc")).count() == spark.read.json(t("r/audit_jsonl")).count() == 1
    with pytest.raises(ValueError):
        sinks.trade_records(df, t("r"), ("xlsx",))
    sinks.factors({"raw": df}, t("f"))
    sinks.walk_forward(df, df, t("w"))
    sinks.report(df, t("p"))
    assert spark.read.parquet(t("f/raw")).count() == spark.read.parquet(t("w/selected_optimum")).count() == spark.read.json(t("p/json")).count() == 1
    assert spark.read.option("header", True).csv(t("w/ranking")).columns == ["backtest_id", "x"]


def test_whole_account_is_written(spark, tmp_path):
    doc = strategy.template("single_signal", cost=0.01, risk_gates={"max_positions": 1})
    curve = strategy.run(two(spark), doc, "one")
    frames = {"equity_curve": curve, "holdings": portfolio.holdings(curve), "rebalance_audit": portfolio.rebalance_audit(curve), "rebalance_trades": portfolio.account_trades(curve), "risk_gate_events": portfolio.gate_events(curve)}
    sinks.portfolio(frames, str(tmp_path / "out"), doc, {"ok": True}, csv=True)
    assert spark.read.parquet(str(tmp_path / "out/rebalance_trades")).count() == frames["rebalance_trades"].count() > 0
    assert spark.read.parquet(str(tmp_path / "out/equity_curve")).count() == 16


def test_registered_indicator_in_a_document(spark):
    registry.register_indicator("last_two_sum", lambda c, period=2: c + F.lag(c).over(Window.partitionBy("asset").orderBy("ts")))
    with pytest.raises(ValueError):
        registry.register_indicator("sma", None)
    doc = {"features": {"s": {"op": "indicator.last_two_sum"}}, "selector": {"score": "s", "top_n": 1}, "rebalance": {"op": "calendar.every_session"}}
    rows = strategy.targets(two(spark), doc)
    assert column(rows.where("asset = 'a'"), "score")[:3] == [None, 9.0, 7.0]


def test_event_frame_of_event_dates(spark):
    days = spark.createDataFrame([(DAY + dt.timedelta(days=k),) for k in (0, 1, 4)], "ts date")
    node = {"op": "calendar.weekday_eq", "weekday": "tuesday"}
    assert [r["ts"] for r in calendar.trigger_sessions(days, node).collect()] == [DAY + dt.timedelta(days=1)]


def test_paged_source(spark):
    spark.sparkContext.addPyFile(str(Path(__file__).with_name("paged_fixture.py")))
    spark.dataSource.register(readers.PagedBars)
    df = spark.read.format("paged_bars").options(symbols="A,B", start=0, end=86400 * 7, page=3, fetch="paged_fixture:fetch").load()
    assert df.groupBy("asset").count().collect()[0]["count"] == 8 and not math.isnan(df.first()["open"])


def test_walk_forward_queries_cover_all_sessions(spark, monkeypatch):
    closes = [100 + 5 * math.sin(i / 3) + i / 10 for i in range(44)]
    bars = panel(spark, closes).unionByName(panel(spark, closes[::-1], "b"))
    monkeypatch.setattr(research, "event_bars", lambda s, d: bars)
    got = {(r["window_id"], r["part"]) for r in research.wfa_scores(spark, "").select("window_id", "part").distinct().collect()}
    assert got == {(k, p) for k in range(5) for p in ("train", "test")}
    assert {r["window_id"] for r in research.wfa_timeline(spark, "").collect()} == set(range(5))
    monkeypatch.setattr(research, "event_bars", lambda s, d: bars.where("ts < '2024-01-10'"))
    assert research.wfa_scores(spark, "").collect() == []


def test_lag_queries_cover_all_lags(spark, monkeypatch):
    y = [math.sin(i * i) for i in range(140)]
    bars = panel(spark, [100 * math.exp(sum(y[: i + 1]) / 50) for i in range(140)])
    qty = spark.createDataFrame([(DAY + dt.timedelta(days=i), y[i + 17]) for i in range(123)], "ts date, qty double")
    monkeypatch.setattr(research, "order_bars", lambda s, d: bars)
    monkeypatch.setattr(research, "ship_feature", lambda s, d: qty)
    assert sorted(r["lag"] for r in research.stats_correlation_p_values(spark, "").collect()) == sorted(stats.LAGS)
    assert [tuple(r) for r in research.stats_best_lag_all(spark, "").collect()] == [("a", 17, 17)]


def test_feature_quality_audits_carried_values(spark):
    """Every session of every asset is audited, and values that are carried show as filled and stale (with one feature known
    anew before every bar nothing ever was)."""
    from barloom.plans import catalog
    from barloom.sources.bars import order_bars

    d = "/root/testdata/sf0.001"
    bars = order_bars(spark, d).select("asset", "ts").toPandas()
    sessions, own = sorted(set(bars["ts"])), bars.groupby("asset")["ts"].apply(set)
    got = {(r["asset"], r["feature"]): r for r in catalog.QUERIES["report_feature_quality"](spark, d).collect()}
    assert len(got) == 2 * len(own)
    for asset, days in own.items():
        age, ages, before = None, [], None
        for s in sessions:  # a bar is known a day later; until the next one its value is carried
            source = max((x for x in days if x < s), default=None)
            age = None if source is None else 0 if source != before else age + 1
            before = source
            ages.append(age)
        known = [a for a in ages if a is not None]
        r = got[asset, "close"]
        assert (r["rows"], r["filled_rows"], r["stale_rows"], r["max_age_bars"]) == (len(sessions), sum(a > 0 for a in known), sum(a > 1 for a in known), max(known))
        assert r["filled_rows"] > 0 and got[asset, "month_close"]["max_age_bars"] >= 5 and "max_age" in got[asset, "month_close"]["warnings"]
