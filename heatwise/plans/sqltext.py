"""SQL text helpers for the DuckDB oracles (constants typed as DOUBLE on both sides)."""

from __future__ import annotations

from heatwise.sources.bridge import READINGS_SQL, SCORED_SQL


def d(x: float) -> str:
    """A DOUBLE literal; bare decimals are DECIMAL in both engines."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def case_factor(col: str, factors: dict, default: float = 1.0) -> str:
    arms = " ".join(f"WHEN {col} = '{k}' THEN {d(v)}" for k, v in factors.items())
    return f"(CASE {arms} ELSE {d(default)} END)"


READINGS_CTE = f"readings AS ({READINGS_SQL})"
VALID_CTE = ("valid AS (SELECT * FROM readings "
             "WHERE temperature > CAST(250 AS DOUBLE) AND temperature < CAST(1000 AS DOUBLE))")
SCORED_CTE = f"scored AS ({SCORED_SQL})"


def r6(expr: str) -> str:
    return f"round({expr}, 6)"
