"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A logged conversation that another one continues (its turns are the first turns of a longer one) is a snapshot and
goes; of equal conversations the smallest conv_id stays. What remains is rendered, CHUNK turns a row, so that no
conversation, however long, is gathered in one row.

Turns are ordered by (turn, role, text), nulls first. A null conv_id is a conversation like any other; null roles
render as "none", null texts as nothing, and both differ from empty ones when conversations are compared. Repeated
rows are repeated turns. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, shuffle_partitions, written

CHUNK = 64
TURN = ("<|im_start|>", "\n", "<|im_end|>\n")


def _carried(parts: DataFrame, total, what: str) -> DataFrame:
    """Per conversation and task: what the tasks before hold of it. Its window has a row a task at most."""
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return parts.groupBy("conv_id", "task").agg(*[f.alias(f"_{k}") for k, f in enumerate(total)]).select(
        F.col("conv_id").alias("_conv"), F.col("task").alias("_task"),
        *[F.coalesce((F.sum if what == "sum" else F.bit_xor)(F.col(f"_{k}")).over(earlier), F.lit(0).cast("long")).alias(f"_c{k}") for k in range(len(total))],
    )


def prefixes(conversations: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Every turn with its place from 1 and a 128-bit hash of the turns up to it, as p1 and p2; and the tables made for it.

    The hash of a prefix is the XOR of hashes of (place, role, text), so it rolls on over tasks: each has a range of
    (conversation, turn) and adds what the tasks before it carried. A long conversation is spread over many tasks.
    """
    spark = conversations.sparkSession
    order = ["turn", "role", "text"]
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(max(2, shuffle_partitions(spark)), "conv_id", *order).withColumn("task", F.spark_partition_id())
    dealt = written(dealt, "turns")
    local = Window.partitionBy("conv_id", "task").orderBy(*order)
    joined = lambda d, c: d.join(c, d.conv_id.eqNullSafe(c._conv) & (d.task == c._task)).drop("_conv", "_task")
    ranked = joined(dealt.withColumn("_n", F.row_number().over(local)), _carried(dealt, [F.count(F.lit(1))], "sum"))
    ranked = ranked.withColumn("place", F.col("_n") + F.col("_c0")).drop("_n", "_c0")
    own = [F.col("place"), F.col("role").isNull().cast("int"), F.col("text").isNull().cast("int"), F.col("role"), F.col("text")]
    hashed = written(ranked.withColumn("e1", F.xxhash64(F.lit(1), *own)).withColumn("e2", F.xxhash64(F.lit(2), *own)), "turn-hashes")
    upto = Window.partitionBy("conv_id", "task").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumn("_r1", F.bit_xor("e1").over(upto)).withColumn("_r2", F.bit_xor("e2").over(upto))
    rolled = joined(rolled, _carried(hashed, [F.bit_xor("e1"), F.bit_xor("e2")], "xor"))
    out = rolled.select("conv_id", "place", "role", "text", F.col("_r1").bitwiseXOR(F.col("_c0")).alias("p1"), F.col("_r2").bitwiseXOR(F.col("_c1")).alias("p2"), "e1", "e2")
    return out, (dealt, hashed)


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations to keep, and how many equal ones each stands for."""
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("place"), F.bit_xor("e1").alias("p1"), F.bit_xor("e2").alias("p2"))
    equal = whole.groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"), F.max(F.col("conv_id").isNull()).alias("_null"))
    # a null id sorts first, as in ORDER BY
    equal = equal.withColumn("conv_id", F.when(~F.col("_null"), F.col("conv_id"))).drop("_null")
    seen = turns.groupBy("place", "p1", "p2").agg(F.count(F.lit(1)).alias("n_seen"))
    keys = ["place", "p1", "p2"]
    longer = seen.join(equal.select(*keys, "n_equal"), keys).where("n_seen > n_equal").select(*keys)
    return equal.join(longer, keys, "left_anti").select("conv_id", "n_equal")


def format_chats(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rendered maximal conversations: conv_id, chunk (from 0), n_turns, n_equal, text."""
    turns, over = prefixes(conversations)
    turns = written(turns, "prefixes")
    dropped(*over)
    keep = maximal(turns).select(F.col("conv_id").alias("_keep"), "n_equal")
    body = F.concat(F.lit(TURN[0]), F.coalesce("role", F.lit("none")), F.lit(TURN[1]), F.coalesce("text", F.lit("")), F.lit(TURN[2]))
    kept = turns.join(keep, turns.conv_id.eqNullSafe(keep._keep)).select("conv_id", "n_equal", "place", F.floor((F.col("place") - 1) / chunk).cast("long").alias("chunk"), body.alias("body"))
    return kept.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n_turns"), F.max("n_equal").alias("n_equal"), F.array_sort(F.collect_list(F.struct("place", "body"))).alias("_t")).select(
        "conv_id", "chunk", "n_turns", "n_equal", F.array_join(F.transform("_t", lambda x: x["body"]), "").alias("text")
    )


def op5(spark, sf_dir):
    from .common import table

    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, role, text FROM conversations
), p AS (
  SELECT conv_id, place, role, text,
         list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY place) AS prefix
  FROM t
), w AS (SELECT conv_id, max(place) AS n, arg_max(prefix, place) AS whole FROM p GROUP BY conv_id
), e AS (SELECT min(conv_id) AS conv_id, count(*) AS n_equal, n, whole FROM w GROUP BY n, whole
), k AS (
  SELECT conv_id, n_equal FROM e
  WHERE NOT EXISTS (SELECT 1 FROM p JOIN w USING (conv_id) WHERE p.prefix = e.whole AND w.n > e.n)
)
SELECT p.conv_id, CAST((place - 1) // 64 AS BIGINT) AS chunk, count(*) AS n_turns, max(n_equal) AS n_equal,
       string_agg('<|im_start|>' || coalesce(role, 'none') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM p JOIN k USING (conv_id) GROUP BY ALL
"""
