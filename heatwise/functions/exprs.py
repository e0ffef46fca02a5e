"""Scalar column expressions shared by the operators.

All of them are built from ``pyspark.sql.functions`` so they stay inside whole-stage
codegen; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heatwise.policies import HOLE_SIZES

# Temperature category upper edges (right-closed), risk and action tiers.
TEMP_CATEGORY_UPPER_EDGES = (285.0, 295.0, 305.0, 315.0, 325.0, 350.0)  # then (350, inf) -> 6
RISK_TIERS = ((0.7, "HIGH"), (0.4, "MEDIUM"))                            # else LOW
ACTION_TIERS = ((0.8, "IMMEDIATE ATTENTION REQUIRED"), (0.6, "Monitor closely"),
                (0.3, "Schedule inspection"))                             # else Normal operation


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_double(v: float) -> Column:
    return F.lit(float(v)).cast("double")


def safe_div(num, den) -> Column:
    """Division that yields null for a zero/null denominator (ANSI-safe)."""
    return F.try_divide(_col(num), _col(den))


def hole_factor(hole_size, factors: dict, default: float = 1.0) -> Column:
    """Per-hole-size multiplier as one CASE expression."""
    hs = _col(hole_size)
    expr = None
    for size, f in factors.items():
        expr = (F.when(hs == size, lit_double(f)) if expr is None
                else expr.when(hs == size, lit_double(f)))
    return expr.otherwise(lit_double(default)) if expr is not None else lit_double(default)


def hole_size_from_name(name, default: str = "30mm", sizes=HOLE_SIZES) -> Column:
    """First size (in the given order) whose digits occur in the lower-cased name.

    Substring rule kept as in the reference: ``25mm, 1200mm-...`` contains "20" and is
    therefore 20mm; a name with none of the digits gets ``default``.
    """
    low = F.lower(_col(name))
    expr = None
    for size in sizes:
        digits = size.replace("mm", "")
        cond = low.contains(digits)
        expr = F.when(cond, F.lit(size)) if expr is None else expr.when(cond, F.lit(size))
    return expr.otherwise(F.lit(default))


def hole_size_from_path(path) -> Column:
    """Hole size from the directory name, e.g. ``.../25mm/file`` -> ``25mm``; null if none."""
    got = F.regexp_extract(_col(path), r"/(\d+mm)/[^/]*$", 1)
    return F.when(got == "", F.lit(None).cast("string")).otherwise(got)


def flag(value: Column, condition: Column) -> Column:
    """1 where the condition on the value holds, else 0; a missing value never holds."""
    return F.coalesce(condition & ~F.isnan(value), F.lit(False)).cast("int")


def temp_category(temp) -> Column:
    """Right-closed categories (0,285] .. (325,350] (350,inf) -> 0..6; T <= 0 or missing -> null."""
    t = _col(temp)
    expr = F.when(t.isNull() | F.isnan(t) | (t <= 0), F.lit(None).cast("int"))
    for i, upper in enumerate(TEMP_CATEGORY_UPPER_EDGES):
        expr = expr.when(t <= upper, F.lit(i))
    return expr.otherwise(F.lit(len(TEMP_CATEGORY_UPPER_EDGES)))


def equal_width_bin(x, lo, hi, k: int) -> Column:
    """Equal-width right-closed bin index 0..k-1 over [lo, hi], bitwise like pandas ``cut``.

    Edges are ``lo + i*step`` (i < k) and ``hi``; when lo < hi the first edge is lowered
    by 0.1 % of the range so the minimum is included; when lo == hi both ends are
    widened by 0.1 % of |lo| (0.001 if zero). ``lo``/``hi`` are columns (e.g. from a
    broadcast one-row statistics frame), so no driver round trip is needed.
    ``width_bucket`` is left-closed and ``Bucketizer`` too, so neither matches.  The bin is
    guessed by division and corrected against its neighbouring edges, so the expression has the
    same size for every ``k``.  Null and NaN have no bin.
    """
    x, lo, hi = _col(x), _col(lo), _col(hi)
    same = lo == hi
    w_lo = F.when(lo == 0, lit_double(0.001)).otherwise(F.abs(lo) * 0.001)
    w_hi = F.when(hi == 0, lit_double(0.001)).otherwise(F.abs(hi) * 0.001)
    a = F.when(same, lo - w_lo).otherwise(lo)
    b = F.when(same, hi + w_hi).otherwise(hi)
    step = (b - a) / F.lit(float(k))
    first = F.when(same, a).otherwise(a - (b - a) * 0.001)

    # at most one bin off: compared with the guessed bin's upper and lower edge
    guess = _clipped(F.ceil((x - a) / step) - 1, k)
    upper = F.when(guess == k - 1, b).otherwise((guess + 1) * step + a)
    lower = F.when(guess == 0, first).otherwise(guess * step + a)
    bins = guess + F.when(x > upper, 1).when(x <= lower, -1).otherwise(0)
    return F.when(x.isNotNull() & ~F.isnan(x), bins).cast("int")


def _clipped(guess: Column, k: int) -> Column:
    """A guessed bin as 0..k-1; rounding moves the quotient by far less than a bin."""
    return F.greatest(F.least(guess, F.lit(k - 1)), F.lit(0)).cast("int")


def left_closed_bin(x, lo, hi, k: int) -> Column:
    """Equal-width left-closed bin index 0..k-1 over [lo, hi], bitwise like numpy ``histogram``
    (edges ``lo + i*step``, the last bin closed): the number of inner edges at or below x."""
    x, lo, hi = _col(x), _col(lo), _col(hi)
    step = (hi - lo) / F.lit(float(k))
    guess = _clipped(F.floor((x - lo) / step), k)
    up = (guess < k - 1) & (x >= (guess + 1) * step + lo)
    bins = guess + F.when(up, 1).when((guess > 0) & (x < guess * step + lo), -1).otherwise(0)
    return F.when(x.isNotNull() & ~F.isnan(x), bins).cast("int")


def equal_width_bin_sql(x: str, lo: str, hi: str, k: int) -> str:
    """The same rule as :func:`equal_width_bin` as portable SQL text (for oracles)."""
    same = f"({lo} = {hi})"
    w_lo = f"(CASE WHEN {lo} = 0 THEN 0.001 ELSE abs({lo}) * 0.001 END)"
    w_hi = f"(CASE WHEN {hi} = 0 THEN 0.001 ELSE abs({hi}) * 0.001 END)"
    a = f"(CASE WHEN {same} THEN {lo} - {w_lo} ELSE {lo} END)"
    b = f"(CASE WHEN {same} THEN {hi} + {w_hi} ELSE {hi} END)"
    step = f"(({b} - {a}) / CAST({k} AS DOUBLE))"
    first = f"(CASE WHEN {same} THEN {a} ELSE {a} - ({b} - {a}) * 0.001 END)"
    terms = [f"(CASE WHEN {first} < {x} THEN 1 ELSE 0 END)"]
    for i in range(1, k):
        terms.append(f"(CASE WHEN CAST({i} AS DOUBLE) * {step} + {a} < {x} THEN 1 ELSE 0 END)")
    terms.append(f"(CASE WHEN {b} < {x} THEN 1 ELSE 0 END)")
    return "(" + " + ".join(terms) + " - 1)"


def risk_level(p) -> Column:
    p = _col(p)
    expr = None
    for cut, name in RISK_TIERS:
        expr = F.when(p > cut, F.lit(name)) if expr is None else expr.when(p > cut, F.lit(name))
    return expr.otherwise(F.lit("LOW"))


def action_tier(p) -> Column:
    p = _col(p)
    expr = None
    for cut, name in ACTION_TIERS:
        expr = F.when(p > cut, F.lit(name)) if expr is None else expr.when(p > cut, F.lit(name))
    return expr.otherwise(F.lit("Normal operation"))
