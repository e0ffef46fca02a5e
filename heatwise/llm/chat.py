"""Chat logs: collapse cumulative snapshots, then render, DataFrame functions only.

A conversation logged several times while it grew shows up as conversations whose turns
are a prefix of a longer one.  The rolling hash of a prefix is the running XOR of a 64-bit
hash of (position, turn), kept twice with different mixing (128 bits); it needs no value of
the previous turn, so a conversation with a third of all rows is hashed in pieces: turns
are range-partitioned by (conversation, turn), ranked and folded within each piece, and the
pieces' counts and folds (at most one row for each piece of a conversation) give the start
of every piece.  A conversation goes if its last hash is the hash of a proper prefix of
another one (anti-join on distinct hashes); of equal conversations the smallest id stays.

Rendering gives one row for each turn, in ChatML form: a conversation's text is the rows'
``rendered`` in order of ``position``.  No conversation is gathered into one value.

Defined cases: turns order by ``turn`` (null first), then by content; exact repeats of a row
are one logged turn; null role or text count as empty; rows with a null conversation id
form one conversation; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from heatwise.llm.scratch import Scratch


def _positions(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """(key, conv_id, turn, cid, position, x, y): prefix hashes x, y up to each turn."""
    spark = scratch.spark
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.keep(
        turns.select("key", "conv_id", "turn", "cid")
        .repartitionByRange(pieces, F.col("key"), F.col("turn").asc_nulls_first(), F.col("cid"))
        .withColumn("piece", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("key", "piece").orderBy(F.col("turn").asc_nulls_first(), "cid")
    ahead = (Window.partitionBy("key").orderBy("piece")
             .rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy("key", "piece").agg(F.count("*").alias("n"))
    starts = counts.select("key", "piece", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    ranked = (dealt.join(starts, ["key", "piece"])
              .withColumn("position", F.col("start") + F.row_number().over(inside))
              .withColumn("x1", F.xxhash64("position", "cid"))
              .withColumn("y1", F.xxhash64("cid", F.lit("y"), "position")))
    ranked = scratch.keep(ranked.drop("start"), "ranked")
    folds = ranked.groupBy("key", "piece").agg(F.bit_xor("x1").alias("x"), F.bit_xor("y1").alias("y"))
    before = folds.select("key", "piece", F.coalesce(F.bit_xor("x").over(ahead), F.lit(0)).alias("x0"),
                          F.coalesce(F.bit_xor("y").over(ahead), F.lit(0)).alias("y0"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (ranked.join(before, ["key", "piece"])
            .select("key", "conv_id", "turn", "cid", "position",
                    F.bit_xor("x1").over(running).bitwiseXOR(F.col("x0")).alias("x"),
                    F.bit_xor("y1").over(running).bitwiseXOR(F.col("y0")).alias("y")))


def maximal_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, position, n_turns) of the conversations that stay."""
    scratch = Scratch(turns.sparkSession, "chat")
    logged = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                          F.coalesce("text", F.lit("")).alias("text"))
    logged = (logged.withColumn("key", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")))
              .withColumn("cid", F.md5(F.concat_ws("\x1f", "role", "text"))))
    # exact repeats collapse on the digest; the texts are taken up again at the end
    ids = logged.select("key", "conv_id", "turn", "cid").distinct()
    placed = scratch.keep(_positions(scratch, ids), "placed")
    sizes = placed.groupBy("key").agg(F.count("*").alias("n_turns"))
    with_n = placed.join(sizes, "key")
    last = (with_n.where("position = n_turns").groupBy("position", "x", "y")
            .agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key", "n_turns")).alias("c")))
    proper = with_n.where("position < n_turns").select("position", "x", "y").distinct()
    stay = last.join(proper, ["position", "x", "y"], "left_anti").select("c.key", "c.n_turns")
    kept = placed.join(stay, "key").select("key", "turn", "cid", "position", "n_turns")
    bodies = logged.dropDuplicates(["key", "turn", "cid"])
    same = ((kept["key"] == bodies["key"]) & (kept["cid"] == bodies["cid"]) & kept["turn"].eqNullSafe(bodies["turn"]))
    return kept.join(bodies, same).select(bodies["conv_id"], bodies["turn"], "role", "text", "position", "n_turns")


def render(turns: DataFrame) -> DataFrame:
    """Maximal conversations in ChatML, one row for each turn."""
    return maximal_turns(turns).select(
        "conv_id", "turn", "position", "n_turns", "role",
        F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("rendered"))
