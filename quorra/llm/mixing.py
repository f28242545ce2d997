"""Mixing sources to target weights: hash-random order within each source, exact cuts by distributed prefix sums.

Every document gets a hash-random key. Within a source documents are taken in key order; a source whose target is
more than its size repeats whole epochs, and the last epoch is cut at the exact budget by a running sum. The running
sum is in two levels: the key's leading bits are a slice, sums over slices give each slice its offset, and rows are
only sorted within a slice, so that one hot source spreads over as many tasks as it has slices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorra.llm.common import WORD, as_long, saved

WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its size.
EPOCHS = 3
#: Rows of a slice, about.
SLICE = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def row_key(doc_id: Column, text_key: Column, source: Column) -> Column:
    """One string for the three, nulls apart from any value."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text_key.cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of sizes(source, source_size), one row a source.

    Sources in code-point order, null last, have the weights in turn. They share the total by weight, none above
    epochs times its size; what is above is shared again by weight until none is. The fixed point is one level L
    with target = min(weight * L, epochs * size): sources ordered by epochs * size / weight saturate one after the
    other, and L follows from the sums over those that are saturated. The table has a row a source, no documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    one = sizes.withColumn("n", F.row_number().over(order) - 1).withColumn("weight", F.get(cycle, F.pmod("n", F.lit(len(weights)))))
    one = one.withColumn("cap", (F.col("source_size") * epochs).cast("long")).withColumn("ratio", F.col("cap") / F.col("weight"))
    until = Window.orderBy("ratio", "n").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("ratio", "n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = one.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(until), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(until), F.lit(0))).alias("share"),
    )
    one = one.withColumn("level", F.col("left") / F.col("share"))
    # the first source that the level of those not yet saturated does not fill sets the level of all after it
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "n", "level"))).over(everything)["level"]
    one = one.withColumn("final", level)
    return one.select("source", "source_size", F.least(F.col("weight") * F.col("final"), F.col("cap").cast("double")).alias("target"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, files: int | None = None) -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, taken) for each row of docs(doc_id, source, text).

    size is the number of words (null text: 0); taken counts the words that the mix takes of the row, repeats
    included: whole epochs, then part of one up to the budget, the target rounded down. The order is md5 of
    doc_id and text (nulls as empty), so that ids that are null or repeat spread like any others, then doc_id, then the
    text's hash; rows equal in all are interchangeable.
    Sources are compared by code point, null is a source of its own. A source without words takes
    nothing. Empty table: empty result. Other columns are ignored. The table of slices has at most ``files`` files, if given.
    """
    key = F.md5(F.concat(F.coalesce(as_long(F.col("doc_id")).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select(as_long(F.col("doc_id")).alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), F.xxhash64("text").alias("text_key"), word_count(F.col("text")).alias("size"))
    rows = saved(rows, "mixing-rows")
    total = rows.count()
    digits = min(5, max(1, math.ceil(math.log(max(1, total / SLICE), 16)))) if total > SLICE else 1
    rows = rows.withColumn("slice", F.substring("key", 1, digits))
    slices = saved(rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "mixing-slices", files=files)
    goal = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, epochs)
    ahead = F.coalesce(F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goal = goal.select(F.col("source").alias("g"), "source_size", "target")
    offsets = slices.withColumn("ahead", ahead).join(goal, F.col("source").eqNullSafe(F.col("g")))
    offsets = offsets.select(F.col("source").alias("s"), F.col("slice").alias("c"), "ahead", "source_size", "target")
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("c")))
    budget = F.floor("target").cast("long")
    fit = F.greatest(F.col("source_size"), F.lit(1))
    full = F.floor(budget / fit).cast("long")
    rest = budget - full * F.col("source_size") - F.col("ahead") - F.col("before")
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    return placed.select("doc_id", "source", "text_key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, files: int | None = None) -> DataFrame:
    """docs as the mix takes them: one row for each whole epoch of a document, and a last one cut to the budget's words.

    Rows of which no word is taken are left out; a row without words is kept once, since it costs nothing.
    The cut text ends with its last word taken; n_chars, if there, follows the text. Null texts stay null, repeated rows
    are taken one by one, other columns pass through, whatever their names. files: see mixture. Empty table: empty result.
    """
    plan = mixture(docs, weights, epochs, files)
    order = Window.partitionBy("wanted").orderBy("taken")
    plan = plan.select(row_key(F.col("doc_id"), F.col("text_key"), F.col("source")).alias("wanted"), "size", "taken")
    plan = plan.withColumn("nth", F.row_number().over(order))
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # names cannot clash inside
    mine = docs.select(columns, row_key(as_long(F.col("doc_id")), F.xxhash64("text"), F.col("source")).alias("key"))
    mine = mine.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("key")))  # equal rows in turn
    both = mine.join(plan, (F.col("key") == F.col("wanted")) & (F.col("place") == F.col("nth")))
    size, text = F.greatest("size", F.lit(1)), F.col("row.text")
    whole = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / size)).cast("int")
    part = F.when(F.col("size") == 0, 0).otherwise(F.col("taken") - whole * F.col("size")).cast("int")
    pieces = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = both.select("row", F.explode(pieces).alias("words"))
    spaced = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.concat_ws("", F.slice(spaced, F.lit(1), F.greatest(F.col("words"), F.lit(1))))
    out = out.select("row.*", F.when(F.col("words") < 0, text).otherwise(cut).alias("mixed text"))
    made = {"text": F.col("mixed text")} | ({"n_chars": F.length("mixed text").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns])


def op4(docs: DataFrame) -> DataFrame:
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB.
OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM n),
r AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM r) - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
               / CAST((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
      FROM r WINDOW b AS (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS final FROM l WHERE level <= ratio ORDER BY ratio, n LIMIT 1),
t AS (SELECT source, source_size, least(weight * final, CAST(cap AS DOUBLE)) AS target FROM l, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (budget // greatest(source_size, 1)) * size
            + greatest(0, least(size, budget - (budget // greatest(source_size, 1)) * source_size - before)) END AS BIGINT) AS taken
FROM p
"""
