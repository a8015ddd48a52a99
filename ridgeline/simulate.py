"""Simulated panels of workers and firms. Every number is a hash of its row's keys and the seed: any size, any partitioning, the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = (2005, 2014)


def uniform(seed: int, name: str, *keys) -> Column:
    """In (0, 1), by a hash of the keys."""
    h = F.xxhash64(F.lit(name), F.lit(seed), *keys)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, name: str, *keys) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, name, *keys))) * F.cos(2 * math.pi * uniform(seed, name + "'", *keys))


def logistic(x: Column) -> Column:
    """The normal distribution function, nearly."""
    return 1 / (1 + F.exp(-1.702 * x))


def simulate_akm(spark: SparkSession, n_workers: int, n_firms: int | None = None, seed: int = 1, years: tuple[int, int] = YEARS, observed: float = 0.85, move: float = 0.08, sd_worker: float = 0.4, sd_firm: float = 0.25, sd_noise: float = 0.3, sorting: float = 0.4, keep_effects: bool = False) -> DataFrame:
    """worker_id, firm_id, year, age and its powers, log_earn (and the true effects). Workers move with probability `move` a year; better ones
    to better firms, with correlation `sorting`; a worker's year is seen with probability `observed`."""
    firms = n_firms or max(n_workers // 15, 50)
    w, y = F.col("w"), F.col("y")
    rows = spark.range(n_workers).select(F.col("id").alias("w"), F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))).alias("y"))
    rows = rows.filter(uniform(seed, "seen", w, y) < observed)
    ability = normal(seed, "worker", w)
    moves = F.size(F.filter(F.sequence(F.lit(years[0]), y), lambda t: (t > years[0]) & (uniform(seed, "move", w, t) < move)))
    draw = logistic(sorting * F.col("z") + math.sqrt(1 - sorting**2) * normal(seed, "firm", w, F.col("spell")))
    rows = rows.select("w", "y", ability.alias("z"), moves.alias("spell")).withColumn("f", F.least(F.floor(draw * firms), F.lit(firms - 1)).cast("long"))
    place = (F.col("f") + 0.5) / firms
    rows = rows.withColumns({"a": F.col("z") * sd_worker, "p": F.ln(place / (1 - place)) / 1.702 * sd_firm, "age": 20 + F.floor(uniform(seed, "age", w) * 30) + y - years[0]})
    age = F.col("age").cast("double")
    rows = rows.withColumns({"q": age**2 / 100, "c": age**3 / 1000})
    earn = 10 + F.col("a") + F.col("p") + 0.08 * F.col("q") - 0.012 * F.col("c") + sd_noise * normal(seed, "noise", w, y)
    effects = [F.col("a").alias("true_worker_effect"), F.col("p").alias("true_firm_effect")] if keep_effects else []
    return rows.select((7 * w + 1_000_000).alias("worker_id"), F.concat(F.lit("F"), F.col("f").cast("string")).alias("firm_id"), y.cast("int").alias("year"), age.alias("age"), F.col("q").alias("age_squared"), F.col("c").alias("age_cubed"), earn.alias("log_earn"), *effects)


def simulate_rich(spark: SparkSession, n_workers: int, seed: int = 1, **how) -> DataFrame:
    """The panel of simulate_akm with regions, cohorts, a treatment, categories, weights, missing values and an endogenous variable with its instruments."""
    df = simulate_akm(spark, n_workers, seed=seed, **how)
    key = [F.col("worker_id"), F.col("year")]
    u, z = lambda name, *k: uniform(seed, name, *(k or key)), lambda name, *k: normal(seed, name, *(k or key))
    df = df.withColumns({
        "state": F.floor(u("state", F.col("firm_id")) * 12).cast("int"),
        "cohort": F.floor((F.col("year") - F.col("age")) / 10).cast("int"),
        "treat": (F.col("worker_id") % 3 == 0).cast("long"),
        "occ": F.floor(u("occ") * 6).cast("int"),
        "cat": F.concat(F.lit("k"), F.floor(u("cat") * 3).cast("string")),
        "x_na": F.when(u("missing") < 0.05, None).otherwise(z("x_na")),
        "wa": 0.5 + 1.5 * u("wa"),
        "wf": (1 + F.floor(u("wf") * 4)).cast("double"),
        "z1": z("z1"), "z2": z("z2"), "shock": z("shock"),
    })
    df = df.withColumn("region", F.col("state") % 4).withColumn("x2", 0.8 * F.col("z1") + 0.5 * F.col("z2") + 0.6 * F.col("shock") + z("x2"))
    return df.withColumns({"y2": 0.5 * F.col("log_earn") + z("y2"), "y_iv": F.col("log_earn") + 0.7 * F.col("x2") + F.col("shock")}).drop("shock")


def simulate_trends(spark: SparkSession, n_workers: int, seed: int = 1, years: tuple[int, int] = YEARS, **how) -> DataFrame:
    """The panel of simulate_akm with an outcome y that has a linear and a quadratic trend of each worker, and covariates."""
    df = simulate_akm(spark, n_workers, seed=seed, years=years, **how)
    w, key = F.col("worker_id"), [F.col("worker_id"), F.col("year")]
    z = lambda name, *k: normal(seed, name, *(k or key))
    t, mid = F.col("year").cast("double"), sum(years) / 2
    df = df.withColumns({"t": t, "t2": (t - mid) ** 2, "x": z("x") + 0.1 * (t - mid) * z("tx", w), "z": z("z"), "v": z("v"), "wa": 0.5 + 1.5 * uniform(seed, "wa", *key)})
    df = df.withColumn("xe", 0.7 * F.col("z") + 0.5 * F.col("v"))
    return df.withColumn("y", F.col("log_earn") + 0.5 * F.col("x") + 0.3 * F.col("xe") + 0.2 * (t - mid) * z("t1", w) + 0.02 * F.col("t2") * z("t2", w) + F.col("v") + 0.3 * z("e"))


def simulate_bottleneck(spark: SparkSession, n_workers: int = 2000, n_firms: int = 40, n_bridge: int = 6, years: int = 4, seed: int = 1, keep_effects: bool = False) -> DataFrame:
    """Two blocks of firms that n_bridge movers alone tie together: the difference of the blocks is weakly identified."""
    half = n_firms // 2
    w, t = F.col("w"), F.col("t")
    rows = spark.range(n_workers).select(F.col("id").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(years - 1))).alias("t"))
    block, late = (w % 2).cast("int"), t >= years // 2
    home = F.floor(uniform(seed, "home", w) * half)
    away = F.floor(uniform(seed, "away", w) * half)
    moved = late & (uniform(seed, "move", w) < 0.5)
    firm = F.when(late & (w < n_bridge), (1 - block) * half + away).otherwise(block * half + F.when(moved, away).otherwise(home)).cast("long")
    rows = rows.select("w", "t", firm.alias("f")).withColumns({"a": 0.4 * normal(seed, "worker", w), "p": 0.25 * normal(seed, "firm", F.col("f")) + 0.2 * F.floor(F.col("f") / half)})
    effects = [F.col("a").alias("true_worker_effect"), F.col("p").alias("true_firm_effect")] if keep_effects else []
    return rows.select(w.alias("worker_id"), F.concat(F.lit("F"), F.col("f").cast("string")).alias("firm_id"), (10 + F.col("a") + F.col("p") + 0.3 * normal(seed, "noise", w, t)).alias("log_earn"), *effects)


def shuffled(df: DataFrame, seed: int = 1) -> DataFrame:
    """The rows in an order by hash: for tests that nothing hangs on order."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)))
