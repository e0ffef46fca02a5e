"""Reading files: discovery, delimited parsing with per-file separator detection,
labelled CSV upload, scoring batches.

``read_readings`` is one lazy plan over *all* files (no per-file loop, no union chain):

1. ``spark.read.text`` (+ ``_metadata``) -> one row per non-blank line, with an order key
   ``(file_block_start, monotonically_increasing_id)`` that is increasing within a file
   (lines are compared within a block by the id, blocks by their start);
2. per file and candidate separator (``,`` ``\\t`` ``\\s+`` ``;`` in that order): field
   count of the first line (``min_by``) and the largest field count -- a separator is
   accepted when the first line has at least 4 fields and no line has more (pandas
   raises on longer rows); the first accepted wins; a file whose winner has != 4
   fields, or with none, is rejected (the reference returns an empty frame);
3. the per-file decision (one row per file; size-checked broadcast) is joined back and
   the lines are split with the chosen separator; tokens in pandas' NA set and short
   rows drop, x/y/T are ``try_cast`` (NaN -> null), then 250 < T < 1000.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatwise.functions.exprs import hole_size_from_name, hole_size_from_path
from heatwise.operators.common import built_once, materialize
from heatwise.operators.labels import valid_temperature

# Fixed values --------------------------------------------------------------------------
SEPARATORS = (",", "\t", r"\s+", ";")                 # tried in this order
EXPECTED_FIELDS = 4
READING_EXTENSIONS = ("csv", "txt", "dat")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tiff")
# pandas read_csv default NA strings
PANDAS_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Defaults of the labelled CSV upload and of scoring points.
LABELLED_DEFAULTS = {"hole_size": "30mm", "file_name": "direct_upload",
                     "classification_method": "direct_label"}
SCORING_DEFAULTS = {"x": 0.0, "y": 0.0, "temperature": 300.0, "hole_size": "30mm"}
# ---------------------------------------------------------------------------------------

READING_SCHEMA = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("file_name", T.StringType()),
    T.StructField("node_number", T.StringType()), T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()), T.StructField("temperature", T.DoubleType())])


def _glob(exts) -> str:
    return "*.{" + ",".join(exts) + "}"


def read_lines(spark: SparkSession, path, extensions=READING_EXTENSIONS,
               recursive: bool = True) -> DataFrame:
    """Non-blank lines with file path and an in-file order key.  ``extensions=None``
    reads every file given (e.g. the discovered list of the batch pipeline)."""
    reader = spark.read
    if extensions:
        reader = reader.option("pathGlobFilter", _glob(extensions))
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    with few_listing_tasks(spark):
        raw = reader.text(path if isinstance(path, str) else list(path))
    return (raw.select(F.col("value"), decoded_path(F.col("_metadata.file_path")).alias("file_path"),
                       F.col("_metadata.file_block_start").alias("_blk"),
                       F.monotonically_increasing_id().alias("_mid"))
            .filter(not_blank(F.col("value"))))


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def listing_tasks(spark: SparkSession) -> str:
    return str(min(int(spark.conf.get(LISTING)), 4 * spark.sparkContext.defaultParallelism))


@contextmanager
def few_listing_tasks(spark: SparkSession):
    """Folders are listed when a reader is made: by some tasks for each core, not by one task
    (up to 10 000) for each folder, as reading files may lie in a folder each."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, listing_tasks(spark))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def decoded_path(meta_path: Column) -> Column:
    """``_metadata.file_path`` is a percent-encoded URI (a blank is ``%20``); decode it so it
    equals the listing's path (``binaryFile``) and the file's real name.  A literal ``+``
    is protected first (URL decoding would turn it into a blank)."""
    protected = F.replace(meta_path, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(protected), meta_path)


def strip_ws(c: Column) -> Column:
    """Remove leading/trailing whitespace of any kind (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def not_blank(c: Column) -> Column:
    return c.rlike(r"\S")


def _tokens(value: Column, sep: str) -> Column:
    """Fields of a line; ``\\s+`` splits the stripped line (leading blanks or tabs are not
    a field, as with pandas' whitespace delimiter)."""
    line = strip_ws(value) if sep == r"\s+" else value
    return F.split(line, sep, -1)


def field_count(value: Column, sep: str) -> Column:
    """Number of fields ``_tokens`` would give, without building the array: separator
    occurrences + 1 (a run of blanks counts once for ``\\s+`` on the trimmed line)."""
    if sep == r"\s+":
        return F.regexp_count(strip_ws(value), F.lit(r"\s+")) + 1
    return F.length(value) - F.length(F.replace(value, F.lit(sep), F.lit(""))) + 1


def separator_decisions(lines: DataFrame, separators=SEPARATORS,
                        expected: int = EXPECTED_FIELDS) -> DataFrame:
    """One row per file: file_path, n_lines, sep_index (null = none accepted),
    n_fields of the winner, accepted (winner has exactly ``expected`` fields)."""
    # first by block, then by file: orders of one number each, so lines need no sort
    by_block, by_file, decided = _decision_columns(tuple(separators), expected)
    return lines.groupBy("file_path", "_blk").agg(*by_block).groupBy("file_path").agg(*by_file).select(*decided)


@built_once
def _decision_columns(separators: tuple, expected: int) -> tuple[list, list, list]:
    """What :func:`separator_decisions` sums for each block and for each file, and its result."""
    counts = {}
    for i, sep in enumerate(separators):
        counts[i] = field_count(F.col("value"), sep) if len(sep) == 1 or sep == r"\s+" \
            else F.size(_tokens(F.col("value"), sep))
    by_block = [F.count(F.lit(1)).alias("_n"), *[
        a for i, n in counts.items() for a in (F.min_by(n, "_mid").alias(f"_f{i}"), F.max(n).alias(f"_m{i}"))]]
    by_file = [F.sum("_n").alias("n_lines"), *[
        a for i in counts for a in (F.min_by(f"_f{i}", "_blk").alias(f"_first{i}"), F.max(f"_m{i}").alias(f"_max{i}"))]]
    idx = None
    fields = None
    for i in range(len(separators)):
        ok = (F.col(f"_first{i}") >= expected) & (F.col(f"_max{i}") <= F.col(f"_first{i}"))
        idx = F.when(ok, F.lit(i)) if idx is None else idx.when(ok, F.lit(i))
        fields = (F.when(ok, F.col(f"_first{i}")) if fields is None
                  else fields.when(ok, F.col(f"_first{i}")))
    return by_block, by_file, [F.col("file_path"), F.col("n_lines"), idx.alias("sep_index"), fields.alias("n_fields"),
                               F.coalesce(fields == expected, F.lit(False)).alias("accepted")]


def _is_na(tok: Column) -> Column:
    return tok.isNull() | tok.isin(*PANDAS_NA)


def _num(tok: Column) -> Column:
    """pandas ``to_numeric(errors='coerce')``: bad text -> null; NaN -> null.
    (ANSI ``cast`` would raise, so ``try_cast``.)"""
    return _no_nan(tok.try_cast("double"))


def _no_nan(d: Column) -> Column:
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def read_readings(spark: SparkSession, path, extensions=READING_EXTENSIONS,
                  separators=SEPARATORS, valid_only: bool = True) -> DataFrame:
    """All reading files under ``path`` as one DataFrame:
    file_path, file_name, node_number (string), x, y, temperature."""
    return parse_lines(read_lines(spark, path, extensions), separators, valid_only)


def parse_lines(lines: DataFrame, separators=SEPARATORS, valid_only: bool = True) -> DataFrame:
    """Lines (value, file_path, _blk, _mid) -> readings; shared by batch and stream."""
    dec = separator_decisions(lines, separators).filter(F.col("accepted"))
    dec, _ = materialize(dec.select("file_path", "sep_index"))      # its size is known before the join
    tokens, complete, fields, readings = _parse_columns(tuple(separators))
    j = lines.join(dec, "file_path").select("file_path", tokens).filter(complete).select("file_path", fields)
    out = j.select(*readings).na.drop(subset=["x", "y", "temperature"])
    return valid_temperature(out) if valid_only else out


@built_once
def _parse_columns(separators: tuple) -> tuple:
    """The steps of :func:`parse_lines`: a line's tokens, whether they are complete, its fields, a reading."""
    toks = None
    for i, sep in enumerate(separators):
        t = _tokens(F.col("value"), sep)
        toks = F.when(F.col("sep_index") == i, t) if toks is None else toks.when(
            F.col("sep_index") == i, t)
    # a generator's columns are never folded back into what reads them: each line is split and
    # each number read once, not once more for every condition and output column
    tokens = F.explode(F.array(F.transform(toks, strip_ws))).alias("_t")
    # try_element_at: short rows give null (``arr[i]`` raises under ANSI)
    fields = [F.try_element_at(F.col("_t"), F.lit(i + 1)) for i in range(EXPECTED_FIELDS)]
    complete = F.size("_t") >= EXPECTED_FIELDS
    for f in fields:
        complete = complete & ~_is_na(f)
    names = ("node_number", "x", "y", "temperature")
    parsed = [f if n == "node_number" else f.try_cast("double") for f, n in zip(fields, names)]
    return (tokens, complete, F.inline(F.array(F.struct(*[v.alias(n) for v, n in zip(parsed, names)]))), [
        F.col("file_path"), F.element_at(F.split("file_path", "/"), -1).alias("file_name"),
        F.col("node_number"), *[_no_nan(F.col(n)).alias(n) for n in names[1:]]])


def ingest_report(spark: SparkSession, path, extensions=READING_EXTENSIONS,
                  separators=SEPARATORS) -> DataFrame:
    """Per file: lines, chosen separator, field count, accepted -- for ingest stats."""
    dec = separator_decisions(read_lines(spark, path, extensions), separators)
    sep_name = None
    for i, sep in enumerate(separators):
        sep_name = (F.when(F.col("sep_index") == i, F.lit(sep)) if sep_name is None
                    else sep_name.when(F.col("sep_index") == i, F.lit(sep)))
    return dec.withColumn("separator", sep_name)


def with_hole_size(df: DataFrame, source: str = "path", default: str = "30mm") -> DataFrame:
    """Hole size from the parent directory (batch pipeline) or the file name (upload)."""
    if source == "path":
        return df.withColumn("hole_size", hole_size_from_path(F.col("file_path")))
    return df.withColumn("hole_size", hole_size_from_name(F.col("file_name"), default))


# ---- discovery -----------------------------------------------------------------------

def list_files(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """File listing (path, length) without reading contents (binaryFile prunes them)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length")


def discover_files(spark: SparkSession, base: str, sizes=("20mm", "25mm", "30mm", "40mm"),
                   listing: DataFrame | None = None) -> DataFrame:
    """Data files directly under ``base/<size>/``: not hidden, and the name holds the
    size digits, ``test`` or any digit.  Columns: hole_size, path, name, length, kind."""
    files = listing if listing is not None else list_files(spark, base)
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.element_at(F.split("path", "/"), -2)
    grand = F.element_at(F.split("path", "/"), -3)
    low = F.lower(name)
    data_cond = None
    for s in sizes:
        c = (parent == s) & (low.contains(s.replace("mm", "")) | low.contains("test")
                             | low.rlike("[0-9]"))
        data_cond = c if data_cond is None else data_cond | c
    img_ext = "|".join(IMAGE_EXTENSIONS)
    img_cond = (parent == "contours") & grand.isin(*sizes) & low.rlike(rf"\.({img_ext})$")
    out = files.select("path", "length", name.alias("name"), parent.alias("_parent"),
                       grand.alias("_grand"), low.alias("_low"))
    out = out.filter(~F.col("name").startswith("."))
    kind = F.when(data_cond, F.lit("data")).when(img_cond, F.lit("image"))
    out = out.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    hs = F.when(F.col("kind") == "data", F.col("_parent")).otherwise(F.col("_grand"))
    return out.select(hs.alias("hole_size"), "path", "name", "length", "kind")


def discovery_counts(discovered: DataFrame) -> DataFrame:
    """Per hole size: data files and images."""
    return discovered.groupBy("hole_size").agg(
        F.count_if(F.col("kind") == "data").alias("file_count"),
        F.count_if(F.col("kind") == "image").alias("image_count"))


# ---- labelled CSV and scoring batches -------------------------------------------------

def read_labelled_csv(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    """Header CSV that already carries ``leak_status``; absent columns are filled
    (hole_size 30mm, file_name direct_upload, leak_confidence = 0.8*leak + 0.1,
    classification_method direct_label, criteria_count = 2*leak + 1)."""
    reader = spark.read.option("header", "true")
    df = reader.schema(schema).csv(path) if schema else reader.option(
        "inferSchema", "false").csv(path)
    if "leak_status" not in df.columns:
        raise ValueError("labelled CSV must have a leak_status column")
    ren = {"x-coordinate": "x", "y-coordinate": "y", "nodenumber": "node_number"}
    for a, b in ren.items():
        if a in df.columns:
            df = df.withColumnRenamed(a, b)
    for c in ("x", "y", "temperature"):
        if c in df.columns:
            df = df.withColumn(c, _num(F.col(c).cast("string")))
    def number(name: str) -> Column:
        value = F.col(name).cast("string").try_cast("double")
        return F.when(~F.isnan(value), value)

    leak = number("leak_status").cast("int")
    fills = {
        "hole_size": F.lit(LABELLED_DEFAULTS["hole_size"]),
        "file_name": F.lit(LABELLED_DEFAULTS["file_name"]),
        "leak_confidence": leak * 0.8 + 0.1,
        "classification_method": F.lit(LABELLED_DEFAULTS["classification_method"]),
        "criteria_count": leak * 2 + 1,
    }
    for name, kind in (("leak_confidence", "double"), ("criteria_count", "int")):
        if name in df.columns:
            df = df.withColumn(name, number(name).cast(kind))
    df = df.withColumns({k: v for k, v in fills.items() if k not in df.columns})
    return df.withColumn("leak_status", leak)


def read_scoring_batch(spark: SparkSession, path, fmt: str = "csv") -> DataFrame:
    """Scoring points (x, y, temperature, hole_size) with the reference defaults."""
    schema = "x double, y double, temperature double, hole_size string"
    reader = spark.read.schema(schema)
    df = reader.option("header", "true").csv(path) if fmt == "csv" else reader.json(path)
    return df.select(*[F.coalesce(F.col(c), F.lit(v)).alias(c)
                       for c, v in SCORING_DEFAULTS.items()])
