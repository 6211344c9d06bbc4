"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from ..sources.bars import EVENT_BARS, ORDER_BARS, SHIP

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
CTES = {"EB": EVENT_BARS, "OB": ORDER_BARS, "SHIP": SHIP}


#: Columns that hold dates; queries return them as ISO text so that every client reads them alike.
DATES = (
    "ts", "source_ts", "raw_event_date", "resolved_session_date", "enter_ts", "leave_ts", "entry_ts", "exit_ts", "peak_ts", "trough_ts",
    "recovery_ts", "period", "known_at",
)


def dated(f: Callable) -> Callable:
    """f with date columns as text."""

    @wraps(f)
    def g(spark, sf_dir):
        df = f(spark, sf_dir)
        return df.withColumns({c: df[c].cast("string") for c in df.columns if c in DATES})

    return g


def dated_sql(sql: str) -> str:
    """The same for SQL; the marker column keeps the pattern from matching nothing."""
    names = ", ".join(f"'{c}'" for c in (*DATES, "_d"))
    return (
        f"select * exclude (_d) from (select columns(lambda c: c in ({names}))::varchar, columns(lambda c: c not in ({names})) "
        f"from (select *, null as _d from (\n{sql}\n)))"
    )


def query(sql: str | None = None):
    """Register a query under its function's name. {EB}, {OB} and {SHIP} in the SQL stand for the shared bodies."""

    def add(f):
        QUERIES[f.__name__] = dated(f)
        if sql is not None:
            text = sql
            for k, v in CTES.items():
                text = text.replace("{" + k + "}", v)
            ORACLES[f.__name__] = dated_sql(text)
        return f

    return add
