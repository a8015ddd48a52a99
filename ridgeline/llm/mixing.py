"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import cut, splits, table

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20


def sizes(docs: DataFrame, text_col: str = "text") -> Column:
    """Number of words of the text; null has none."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target to rows of source and source_size: one row for each source.

    Sources in code point order, null last, take the weights in turn. share times all sizes is dealt by weight; no target passes most
    times its source's size, and what is over goes to the others by weight until nothing is. That fixes a level such that each target is
    the smaller of its cap and level * weight: sources reach their caps in order of cap / weight, so that one cumulative sum finds it.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    t = t.withColumns({
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
        "whole": F.sum("source_size").over(all_) * F.lit(float(share)),
    }).withColumn("level", (F.col("whole") - F.col("capped")) / F.col("open"))
    # the level is that of the first source whose cap is not reached
    level = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_)["level"]
    t = t.withColumn("level", level)
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """Per row: id, size, source_size, target, copies, taken (copies * size), own (a hash of the text).

    Every document of a source has the same expected number of copies, target / source_size. The documents lie in a row by
    size and id; a document is taken once for each whole number that the running sum of expected copies, begun at a random offset of the
    source, passes within it. So copies differ by one at most, never pass most, and, as neighbours are alike in size, the words taken
    come near the target. The offset hangs on seed and source alone: reruns agree. Sources of no words, and texts that are null or empty,
    take nothing. Rows that repeat an id count as documents of their own; those of null id come first of their size.

    The running sum is taken in two steps: rows are dealt by ranges of (source, size, id), numbered within each range, and
    each range adds the rows of its source in the ranges before it. A source with a third of all rows thus spreads over many ranges.
    """
    n = splits(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), sizes(docs, text_col).alias("size"), F.xxhash64(text_col).alias("own"))
    base = cut(base)
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    base = base.withColumn("tie", F.monotonically_increasing_id())
    dealt = base.repartitionByRange(n, "source", "size", "id", "tie").withColumn("part", F.spark_partition_id())
    dealt = cut(dealt)  # partition numbers must not move between the two uses below
    parts = dealt.groupBy("source", "part").agg(F.count("*").alias("rows"))
    # a row for each source in each range: at most sources + ranges rows
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(targets(totals, weights, share, most).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "before", "source_size", "target")
    within = Window.partitionBy("part", "source").orderBy("size", "id", "tie")
    rows = dealt.withColumn("n", F.row_number().over(within)).join(parts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumns({"n": F.col("n") + F.col("before"), "rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))})
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))), 256)
    u = F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = F.floor(F.col("n") * F.col("rate") + u) - F.floor((F.col("n") - 1) * F.col("rate") + u)
    rows = rows.withColumn("copies", copies.cast("long"))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "own")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. Rows that repeat both id and text are taken alike: as the one of them taken most."""
    taken = mix_sources(docs, id_col, text_col, **how).groupBy(F.col(id_col).alias("id"), "own").agg(F.max("copies").alias("copies")).filter("copies > 0")
    inner = [f"c{i}" for i in range(len(docs.columns))]  # so that no column clashes
    rows, id_, text = docs.toDF(*inner), F.col(inner[docs.columns.index(id_col)]), inner[docs.columns.index(text_col)]
    out = rows.join(taken, id_.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("own")))
    return out.select(*inner, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(*inner).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             sum(source_size) OVER () * 1.5::DOUBLE AS whole FROM w),
l AS (SELECT (whole - capped) / open AS level FROM c WHERE (whole - capped) / open * weight < cap ORDER BY cap / weight LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM l) IS NULL THEN cap ELSE least(cap, (SELECT level FROM l) * weight) END AS target FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS n,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(sha256('{SEED}:' || coalesce('=' || d.source, '-')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       ((floor(n * rate + u) - floor((n - 1) * rate + u))::BIGINT * size)::BIGINT AS taken
FROM r
"""
