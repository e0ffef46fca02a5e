"""Exact order statistics without ordering rows: counting passes over shrinking value ranges.

``values_at`` finds the value at given 0-based ranks of a column, per group.  A range of values
that holds a wanted rank is cut into ``CELLS`` cells by a monotone function of the value; one
grouped count (combined before the shuffle) tells which cell holds the rank, and that cell's
own smallest and largest value become the next range.  A range of at most ``FINE`` rows is
read out, a range of one value is the answer.  No task holds the values of a group, hot values
are only counted, and a pass sends at most CELLS rows for each open range and task.

Cells are equal steps of the value; when such a pass hardly narrows the ranges (values over
many orders of magnitude) the next one takes equal steps of the signed logarithm.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatwise.operators.common import built_once, track

CELLS = 1024
FINE = 100_000


def _linear(x: Column, lo: Column, hi: Column, whole: bool) -> Column:
    """Place of x between lo and hi, 0..1, never falling as x grows."""
    if whole:
        def gap(a, b):                  # a difference past 64 bits is taken of doubles
            return F.coalesce(F.try_subtract(a, b).cast("double"), a.cast("double") - b.cast("double"))
        return gap(x, lo) / gap(hi, lo)
    return (F.when(hi - lo < float("inf"), (x - lo) / (hi - lo))
            .otherwise((x / 2 - lo / 2) / (hi / 2 - lo / 2)))


def _magnitude(x: Column) -> Column:
    d = x.cast("double")
    return F.when(d > 0, F.log(d) + 746).when(d < 0, -(F.log(-d) + 746)).otherwise(0.0)


def _cell(x: Column, lo: Column, hi: Column, whole: bool, logs: bool) -> Column:
    place = _linear(x, lo, hi, whole)
    if logs:
        a, b = _magnitude(lo), _magnitude(hi)
        place = F.when(a < b, (_magnitude(x) - a) / (b - a)).otherwise(place)
    return F.least(F.floor(place * CELLS), F.lit(CELLS - 1)).cast("int")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, list[Column]]:
    """The right side with renamed keys, and the null-safe conditions of the join."""
    own = right.withColumnsRenamed({k: f"_to_{k}" for k in keys})
    return own, [F.col(k).eqNullSafe(F.col(f"_to_{k}")) for k in keys]


def _ranges(want: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """The distinct ranges of some wanted ranks; of ranks that the driver holds without a job."""
    names = [*keys, "_lo", "_hi", *more]
    held = getattr(want, "_heatwise_rows", None)
    if held is None:
        return want.select(*names).distinct()
    unique = list(dict.fromkeys(tuple(r[n] for n in names) for r in held))
    out = want.sparkSession.createDataFrame(unique, T.StructType([want.schema[n] for n in names]))
    out._heatwise_rows = unique
    return out


def _chosen(want: DataFrame, which: Column, test: Callable) -> DataFrame:
    """The wanted ranks for which ``which`` holds; ``test`` tells the same of a row."""
    out = want.where(which)
    held = getattr(want, "_heatwise_rows", None)
    if held is not None:
        out._heatwise_rows = [r for r in held if test(r)]
    return out


def _small(table: DataFrame, source: DataFrame) -> DataFrame:
    """``table`` (made of ``source``) marked for broadcast where the driver holds ``source``: at
    most LOCAL_RANKS rows.  Spark does not know the size of rows from the driver and would move
    and sort the other side by its few groups instead."""
    return F.broadcast(table) if getattr(source, "_heatwise_rows", None) is not None else table


def _within(rows: DataFrame, col: str, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that lie in a range, with the range's ``_lo`` and ``_hi``.

    Ranges of one group do not overlap.  Without groups there are at most as many as wanted
    ranks; they go into the plan as literals, so the scan itself can skip the other rows.  With
    groups the ranges go to the rows, which stay where they are.
    """
    x = F.col(col)
    if keys:
        own, on = _same(rows, _small(ranges, ranges), keys)
        return rows.join(own, [*on, x >= F.col("_lo"), x <= F.col("_hi")]).drop(*[f"_to_{k}" for k in keys])
    kind = rows.schema[col].dataType
    lo = hi = F.lit(None).cast(kind)
    held = getattr(ranges, "_heatwise_rows", None)
    some = sorted((r[0], r[1]) for r in (ranges.select("_lo", "_hi").collect() if held is None else held))
    for a, b in reversed(some):
        inside = (x >= F.lit(a).cast(kind)) & (x <= F.lit(b).cast(kind))
        lo, hi = F.when(inside, F.lit(a).cast(kind)).otherwise(lo), F.when(inside, F.lit(b).cast(kind)).otherwise(hi)
    if not some:
        return rows.where(F.lit(False)).withColumns({"_lo": lo, "_hi": hi})
    kept = rows.where((x >= F.lit(some[0][0]).cast(kind)) & (x <= F.lit(max(b for _, b in some)).cast(kind)))
    return kept.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_lo").isNotNull())


def _whole(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))


def values_at(df: DataFrame, col: str, ranks: Callable[[Column], Column], group_cols=(),
              known: DataFrame | None = None) -> DataFrame:
    """(group..., n, rank, value): the value at each rank of a group's sorted values.

    ``ranks`` gives an array of 0-based ranks from the group's count of values.  Nulls and NaN
    are no values.  ``known``: (group..., n, _lo, _hi), the count, least and greatest value of
    each group, where the caller has them already."""
    keys = list(group_cols)
    x = F.col(col)
    rows = df.select(*keys, col).where(x.isNotNull() if _whole(df.schema[col].dataType) else x.isNotNull() & ~F.isnan(x))
    stats = known if known is not None else rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    want = stats.where("n > 0").select(
        *keys, "n", F.explode(F.array_distinct(ranks(F.col("n")).cast("array<bigint>"))).alias("rank"), "_lo", "_hi",
        F.lit(0).cast("long").alias("_before"), F.col("n").alias("_rows"))
    return narrowed(rows, col, want.where((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))), keys)


#: Up to so many wanted ranks (one or two for each group and quantile) are held by the driver, so
#: that the next pass is planned with their size known; more stay a persisted table.
LOCAL_RANKS = 10_000


def _settled(want: DataFrame, wide: Column, tuples: bool) -> tuple[DataFrame, int | None, int, int]:
    """(the wanted ranks evaluated once, rows in ranges still too wide, ranges to read out, wide
    ranges of one value)."""
    want = track(want.persist())
    some = want.limit(LOCAL_RANKS + 1).collect()
    if len(some) <= LOCAL_RANKS:
        want.unpersist()
        want = want.sparkSession.createDataFrame(some, want.schema)
        want._heatwise_rows = some
        left = few = hot = 0
        for r in some:
            spread, many = r["_lo"] < r["_hi"], r["_rows"] > FINE
            left += r["_rows"] if spread and many else 0
            few += not many and (spread or tuples)
            hot += many and not spread
        return want, left, few, hot
    row = want.agg(F.sum(F.when(wide, F.col("_rows"))),
                   F.count_if((F.col("_rows") <= FINE) & ((F.col("_lo") < F.col("_hi")) | tuples)),
                   F.count_if((F.col("_rows") > FINE) & ~wide)).first()
    return want, *row


def narrowed(rows: DataFrame, col: str, want: DataFrame, keys: list[str], by=()) -> DataFrame:
    """The counting passes.  ``want``: (group..., n, rank, _lo, _hi, _before, _rows), a range of
    values known to hold the rank, with the rows before it and in it.

    With ``by``, rows are ordered by (col, *by) and ``value`` is the struct of these at the
    rank; rows that agree in all of them stand together at their first one's rank."""
    whole, by, x = _whole(rows.schema[col].dataType), list(by), F.col(col)
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_rows") > FINE)
    logs, before = False, None
    while True:
        want, left, few, hot = _settled(want, wide, bool(by))
        if not left:
            break
        ranges = _ranges(_chosen(want, wide, lambda r: r["_lo"] < r["_hi"] and r["_rows"] > FINE), keys)
        logs = not logs and before is not None and left * 8 > before
        before = left
        cell = _cell(x, F.col("_lo"), F.col("_hi"), whole, logs)
        counted = (_within(rows, col, ranges, keys)
                   .groupBy(*keys, "_lo", cell.alias("_cell"))
                   .agg(F.count(F.lit(1)).alias("_c"), F.min(x).alias("_a"), F.max(x).alias("_b")))
        below = Window.partitionBy(*keys, "_lo").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_below", F.coalesce(F.sum("_c").over(below), F.lit(0)))
        own, on = _same(want, counted.withColumnRenamed("_lo", "_from"), keys)
        at = F.col("rank") - F.col("_before")
        found = (_small(want.where(wide), want).join(own, [*on, F.col("_lo") == F.col("_from"), at >= F.col("_below"),
                                             at < F.col("_below") + F.col("_c")])
                 .select(*keys, "n", "rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"),
                         (F.col("_before") + F.col("_below")).alias("_before"), F.col("_c").alias("_rows")))
        want = want.where(~wide).unionByName(found)
    if by:
        return _tuples_at(rows, col, by, want, keys, hot)
    flat = want.where(~(F.col("_lo") < F.col("_hi"))).select(*keys, "n", "rank", F.col("_lo").alias("value"))
    if not few:
        return flat
    spread = _chosen(want, F.col("_lo") < F.col("_hi"), lambda r: r["_lo"] < r["_hi"])
    return flat.unionByName(_read_out(rows, col, x, spread, keys))


def _read_out(rows: DataFrame, col: str, value: Column, few: DataFrame, keys: list[str]) -> DataFrame:
    """Sort the rows of each remaining range, at most ``FINE`` of them, and take the ranks."""
    ranges = _ranges(few, keys)
    listed = (_within(rows, col, ranges, keys).groupBy(*keys, "_lo")
              .agg(F.sort_array(F.collect_list(value)).alias("_all")).withColumnRenamed("_lo", "_from"))
    own, on = _same(few, listed, keys)
    return (_small(few, few).join(own, [*on, F.col("_lo") == F.col("_from")])
            .select(*keys, "n", "rank", F.get("_all", (F.col("rank") - F.col("_before")).cast("int")).alias("value")))


def _tuples_at(rows: DataFrame, col: str, by: list[str], want: DataFrame, keys: list[str], hot: int) -> DataFrame:
    whole = F.struct(col, *by)
    few = F.col("_rows") <= FINE
    read = _read_out(rows, col, whole, _chosen(want, few, lambda r: r["_rows"] <= FINE), keys)
    if not hot:
        return read
    hot = _chosen(want, ~few, lambda r: r["_rows"] > FINE)  # more than FINE rows of one value
    least = (_within(rows, col, _ranges(hot, keys), keys).groupBy(*keys, "_lo")
             .agg(F.min(whole).alias("value")).withColumnRenamed("_lo", "_from"))
    own, on = _same(hot, least, keys)
    return read.unionByName(_small(hot, hot).join(own, [*on, F.col("_lo") == F.col("_from")]).select(*keys, "n", "rank", "value"))


def lerp(lo: Column, hi: Column, t: Column) -> Column:
    """numpy's linear interpolation (the form used for t >= 0.5 differs)."""
    d = hi - lo
    return F.when(t >= 0.5, hi - d * (F.lit(1.0) - t)).otherwise(lo + d * t)


def exact_quantiles(df: DataFrame, col: str, probs, names=None, group_cols=(), known=None) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas/numpy ``linear``), one row per group; one
    row of nulls for a frame without values and without groups.  ``known`` as in ``values_at``."""
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q{int(round(p * 100)):02d}" for p in probs]
    keys = list(group_cols)

    ranks, aggs, values = _quantile_columns(tuple(probs), tuple(names))
    found = values_at(df.withColumn(col, F.col(col).cast("double")), col, lambda n: ranks, keys, known)
    return found.groupBy(*keys).agg(*aggs).select(*keys, *values)


@built_once
def _quantile_columns(probs: tuple, names: tuple) -> tuple[Column, list, list]:
    """The ranks beside each quantile among ``n`` values, their values and what lies between."""
    def place(n, p):
        return (n - 1) * F.lit(p)
    n, rank, value = F.col("n"), F.col("rank"), F.col("value")
    ranks = F.array(*[f(place(n, p)).cast("long") for p in probs for f in (F.floor, F.ceil)])
    aggs = [F.max(F.when(rank == f(place(n, p)), value)).alias(f"_{nm}_{side}")
            for p, nm in zip(probs, names) for side, f in (("lo", F.floor), ("hi", F.ceil))]
    return ranks, [F.max("n").alias("n"), *aggs], [
        lerp(F.col(f"_{nm}_lo"), F.col(f"_{nm}_hi"), place(n, p) - F.floor(place(n, p))).alias(nm)
        for p, nm in zip(probs, names)]


HASH_BITS = 12


def hash_cells(rows: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """(group..., _c, _a, _b, _below, n): rows, least and greatest value of each of 4096 equal
    cells of a 64-bit hash, the group's rows in cells below, and the group's rows."""
    x = F.col(col)
    cell = F.shiftright(x, 64 - HASH_BITS)
    cells = rows.groupBy(*keys, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_c"), F.min(x).alias("_a"), F.max(x).alias("_b"))
    group = Window.partitionBy(*(keys or [F.col("_cell").isNull()]))
    below = F.sum("_c").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    return track(cells.withColumns({"_below": F.coalesce(below, F.lit(0)), "n": F.sum("_c").over(group)}).persist())


def tuples_at(rows: DataFrame, col: str, by, cells: DataFrame, ranks: Column, keys: list[str]) -> DataFrame:
    """(group..., n, rank, value): the struct (col, *by) at each of a group's ``ranks``, from its
    :func:`hash_cells`; ranks past the end give no row."""
    rank = F.col("rank")
    want = (cells.withColumn("rank", F.explode(ranks)).where((rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_c")))
            .select(*keys, "n", "rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"),
                    F.col("_below").alias("_before"), F.col("_c").alias("_rows")))
    return narrowed(rows, col, want, keys, by)


def column_quantiles(df: DataFrame, probs: dict[str, list[float]]) -> dict[str, list]:
    """Exact quantiles of several columns by the same passes: {column: [value of each prob]}.

    Columns are stacked as (name, value) rows and selected together; all quantiles come to the
    driver as one small row for each column (None for a column without values)."""
    names = list(probs)
    asked = sorted({p for ps in probs.values() for p in ps})
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v"))
                                         for c in names])).alias("s")).select("s.*")
    rows = {r["name"]: r for r in exact_quantiles(long, "v", asked, [f"p{i}" for i in range(len(asked))], ["name"]).collect()}
    return {c: [rows[c][f"p{asked.index(p)}"] if c in rows else None for p in ps] for c, ps in probs.items()}
