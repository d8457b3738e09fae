"""Operator 5: mix sources to target weights by hash-random order and distributed prefix sums.

Every row gets a key from a hash of its id. Keys are cut into equal ranges; a first small aggregate holds
the words of each (source, range), prefix sums over it give where each range begins, and a window inside
one range gives where each row begins. So no task ever holds a source, however hot.
Only built-in functions are used.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null id
has the key of the empty string; repeated rows count each; an empty table gives an empty result;
a source without words gets target 0 and takes nothing. Other columns are ignored.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Leading hex digits of the key that name a key range; 16**3 ranges a source.
RANGE_DIGITS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, epochs=MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Weights repeat over the sources in order; what a source cannot take (epochs times its size) is shared
    among the rest by weight. Sorted by cap over weight, the first k sources are full for one k, and
    running sums find it. One row a source passes through one task."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    every = Window.partitionBy(F.lit(0))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    level = (F.col("all_words") * F.lit(share) - F.col("cap_before")) / (F.col("all_weights") - F.col("weight_before"))
    out = (
        sizes.withColumn("place", place)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * F.lit(epochs))
        .withColumn("all_words", F.sum("source_size").over(every))
        .withColumn("all_weights", F.sum("weight").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", level)
        .withColumn("open_level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
        .withColumn("level", F.first("open_level", ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, 0)))
    )
    target = F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))
    return out.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, text="text", source="source", doc_id="doc_id", weights=WEIGHTS, share=SHARE, epochs=MOST_EPOCHS) -> DataFrame:
    """Return doc_id, source, size, source_size, target and taken, one row for each row of docs."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.expr(f"regexp_count(`{text}`, '{WORD}')"), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("key"),
    ).withColumn("part", F.substring("key", 1, RANGE_DIGITS))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    aims = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, epochs)
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(ahead), F.lit(0))).drop("part_size").alias("s")
    aims = aims.alias("t")
    marks = starts.join(aims, F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        "s.source", "part", "part_start", "source_size", "target"
    ).alias("m")
    within = Window.partitionBy("r.source", "r.part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.alias("r")
        .withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(marks, F.col("r.source").eqNullSafe(F.col("m.source")) & (F.col("r.part") == F.col("m.part")))
        .withColumn("start", F.col("part_start") + F.col("inside"))
    )
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def sql_over(docs: str) -> str:
    """The same over a DuckDB relation of documents."""
    return rf"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS key FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place FROM s),
w AS (SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap FROM p),
c AS (SELECT *, sum(source_size) OVER ()::BIGINT AS all_words, sum(weight) OVER ()::BIGINT AS all_weights,
             coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER b, 0)::BIGINT AS weight_before
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (all_words::DOUBLE * 1.5::DOUBLE - cap_before::DOUBLE) / (all_weights - weight_before)::DOUBLE AS level0 FROM c),
o AS (SELECT *, first_value(CASE WHEN level0 * weight::DOUBLE <= cap::DOUBLE THEN level0 END IGNORE NULLS)
             OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM l),
t AS (SELECT source, source_size, coalesce(level * weight::DOUBLE, cap::DOUBLE)::DOUBLE AS target FROM o),
q AS (SELECT r.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r)
SELECT q.doc_id, q.size, t.source_size, t.target,
       (CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END * q.size
        + greatest(0, least(q.size, floor(t.target)::BIGINT
          - CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END * t.source_size - q.start)))::BIGINT AS taken
FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source"""


ORACLE = sql_over("documents")
