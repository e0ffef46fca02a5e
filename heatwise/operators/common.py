"""Small shared helpers: persisted tables, one-row statistics attach, rounding."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CACHED: list = []


def materialize(df: DataFrame) -> tuple[DataFrame, int]:
    """Persist a frame that several jobs of one operator read (count, sample, totals,
    final pass) and count it once.  ``release_cached()`` drops them after a query."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _CACHED.append(df)
    return df, df.count()


def track(df: DataFrame) -> DataFrame:
    """Register a frame persisted elsewhere so :func:`release_cached` drops it too."""
    _CACHED.append(df)
    return df


def release_cached() -> None:
    """Unpersist every frame persisted by :func:`materialize`."""
    while _CACHED:
        _CACHED.pop().unpersist()


def built_once(build: Callable) -> Callable:
    """Columns are expressions without a frame, and each function in them is a call to the JVM:
    what depends on a few plain arguments is built for their first call only, so the many small
    batches of a stream do not spend their time on it."""
    kept = {}

    @wraps(build)
    def get(*args):
        key = repr(args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]
    return get


def attach_one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row frame (a global aggregate, or the bucket-edge array) to every row.

    The only cross join in the library: callers pass frames that are one row by
    construction (an ungrouped ``agg``), so the broadcast side has a proven size bound
    and no pairs are multiplied."""
    return df.crossJoin(F.broadcast(stats))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (oracle hygiene) and turn NaN into null.

    Rounds as ``round(x * 10^d) / 10^d`` -- the form SQL engines use for doubles -- so
    a value sitting on a rounding tie lands on the same side in Spark and the oracle."""
    scale = float(10 ** digits)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            cols.append(F.when(F.isnan(c), F.lit(None).cast("double"))
                        .otherwise(F.round(c * scale) / scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round_sig(c, digits: int = 10):
    """Round to ``digits`` significant digits (for statistics of large magnitude),
    in the ``round(x * 10^k) / 10^k`` form so SQL oracles round identically."""
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), k)
    return F.when(c.isNull() | (c == 0) | F.isnan(c), c).otherwise(F.round(c * scale) / scale)
