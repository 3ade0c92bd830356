"""Chat text from logged conversations, after snapshots of one conversation are collapsed.

Logs often hold a conversation again after each of its turns. A turn's prefix hash stands for all turns up to it. A
conversation whose last prefix hash also occurs inside a longer one is a snapshot of that one and is left out; of
conversations that are equal as a whole the smallest conv_id stays. What remains is rendered.

The prefix hash is a running sum over turns of two 64-bit hashes of (position, role, text), so it is a window function over
numbers; turns are summed in blocks, so that one endless conversation does not become one task. 128 bits and the number of
turns stand for equality.

Results for odd input: turns are ordered by turn, role, text with nulls first; a null role or text differs from an empty one
in the hash and is rendered as empty; turns without a conv_id form one conversation of their own; repeated rows are turns;
an empty table gives no rows; other columns are not read. Only DataFrame functions are used.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256              # values of ``turn`` summed together
PART = 256               # turns to a rendered row


def _positions(turns: DataFrame) -> DataFrame:
    """conv_id, block, position (from 0), role, text."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("nth", F.row_number().over(inside))
    return rows.join(firsts, rows["conv_id"].eqNullSafe(firsts["c"]) & rows["block"].eqNullSafe(firsts["b"])).select(
        "conv_id", (F.col("first") + F.col("nth") - 1).cast("long").alias("position"), "role", "text")


def _hashes() -> list[Column]:
    """Two hashes of a turn at its place; nulls are told from empty strings."""
    told = [F.col("position"), F.col("role").isNull(), F.col("text").isNull(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    return [F.xxhash64(F.lit("one"), *told), F.xxhash64(F.lit("two"), *reversed(told))]


def _running(value: str, window) -> Column:
    """A running sum modulo 2**64, in exact decimals."""
    return F.sum(F.col(value).cast("decimal(20,0)")).over(window)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, position, role, text, h1, h2: the hashes stand for all turns up to this one."""
    one, two = _hashes()
    placed = _positions(turns).withColumn("v1", one).withColumn("v2", two).withColumn("block", F.floor(F.col("position") / BLOCK))
    sums = placed.groupBy("conv_id", "block").agg(F.sum(F.col("v1").cast("decimal(20,0)")).alias("s1"), F.sum(F.col("v2").cast("decimal(20,0)")).alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("r1", _running("v1", inside)).withColumn("r2", _running("v2", inside))
    return placed.join(bases, placed["conv_id"].eqNullSafe(bases["c"]) & placed["block"].eqNullSafe(bases["b"])).select(
        "conv_id", "position", "role", "text", (F.col("b1") + F.col("r1")).cast("decimal(38,0)").alias("h1"), (F.col("b2") + F.col("r2")).cast("decimal(38,0)").alias("h2"))


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that stay."""
    lasts = hashed.groupBy("conv_id").agg(F.max(F.struct("position", "h1", "h2")).alias("last")).select("conv_id", "last.*")
    whole = lasts.groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    last_of = lasts.select(F.col("conv_id").alias("c"), F.col("position").alias("p"))
    same = hashed["conv_id"].eqNullSafe(last_of["c"]) & (hashed["position"] == last_of["p"])
    inner = hashed.join(last_of, same, "left_anti").select("position", "h1", "h2").distinct()
    return whole.join(inner, ["position", "h1", "h2"], "left_anti").select("conv_id", (F.col("position") + 1).alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """Rendered rows of the conversations that stay: conv_id, n_turns, part (from 0), text. Parts in order give the whole."""
    hashed = prefix_hashes(turns)
    stay = maximal(hashed).select(F.col("conv_id").alias("c"), "n_turns")
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    rows = hashed.join(stay, hashed["conv_id"].eqNullSafe(stay["c"])).select(
        "conv_id", "n_turns", F.floor(F.col("position") / PART).alias("part"), F.struct("position", line.alias("line")).alias("turn"))
    return rows.groupBy("conv_id", "n_turns", "part").agg(F.array_sort(F.collect_list("turn")).alias("turns")).select(
        "conv_id", "n_turns", "part", F.concat_ws("", F.transform("turns", lambda t: t["line"])).alias("text"))
