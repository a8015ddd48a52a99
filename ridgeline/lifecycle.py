"""What surrounds estimation: profiles of a model before it runs, left-over tables, warnings, sessions."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import formula as fo
from ridgeline.plans.absorb import MOST_CELLS, MOST_LEVELS
from ridgeline.plans.cache import remove, shared
from ridgeline.sources import source


class ExperimentalWarning(UserWarning):
    """For features whose results or names may still change."""


@dataclass
class Profile:
    """What a model will take, from one scan: rows, levels, and the sizes of what the driver would hold."""

    rows: int
    levels: dict[str, int]
    columns: int
    stream: str | None
    driver_mb: float
    table_mb: float
    notes: list[str] = field(default_factory=list)

    def summary(self) -> str:
        lines = [f"{self.rows} rows, {self.columns} columns in the design", *(f"  {k}: about {v} levels" for k, v in self.levels.items())]
        lines += [f"taken out by groups: {self.stream}"] if self.stream else []
        lines += [f"driver: about {self.driver_mb:.0f} MB; tables: about {self.table_mb:.0f} MB before compression", *self.notes]
        return "\n".join(lines)


def profile(fml: str, data, memory_mb: float | None = None, stream: str | None = None) -> Profile:
    """Counts rows and (approximately) levels in one pass and works out what the fit holds. With memory_mb, a note says if the driver's part passes it."""
    df = source(data)
    m = fo.parse(fml)
    design = fo.Compiler(df).design(m[0])
    dims = m[0].fe
    pairs = F.approx_count_distinct(F.struct(*[f.level.alias(f"f{i}") for i, f in enumerate(dims)])) if len(dims) > 1 else F.lit(0)
    row = df.agg(F.count("*"), pairs, *[F.approx_count_distinct(f.level) for f in dims]).first()
    n, cells, levels = row[0], row[1], {f.name: int(x) for f, x in zip(dims, row[2:], strict=True)}
    k = 1 + len(design.x) + len(design.endog) + len(design.z)
    first = stream or (max(levels, key=levels.get) if levels else None)
    solved = sum(v for name, v in levels.items() if name != first)
    driver = 8e-6 * (k * k + solved * k * 6 + (cells * (len(dims) + k + 1) if len(dims) > 1 and cells <= MOST_CELLS else 0))
    notes = []
    if len(dims) > 1 and cells > MOST_CELLS:
        notes.append("cells stay a table: products with the reduced system are jobs")
    if solved > MOST_LEVELS:
        notes.append(f"more than {MOST_LEVELS} levels besides {first}: the fit will refuse")
    if memory_mb is not None and driver > memory_mb:
        notes.append(f"the driver's part passes {memory_mb:.0f} MB")
    return Profile(n, levels, k, first, driver, 8e-6 * n * (2 * k + len(dims) + 1), notes)


def cleanup(spark: SparkSession | None = None, older_than_hours: float = 24.0, dry_run: bool = False) -> list[str]:
    """Deletes tables that runs which broke off have left in the shared folder: those of this library's names that nothing has changed for so long."""
    import re

    spark = spark or SparkSession.getActiveSession()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(shared(spark))
    fs, gone = root.getFileSystem(conf), []
    if not fs.exists(root):
        return gone
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if re.fullmatch(r"[0-9a-f]{32}", name) and time.time() - status.getModificationTime() / 1000 >= older_than_hours * 3600:
            gone.append(status.getPath().toString())
            if not dry_run:
                remove(spark, gone[-1])
    return gone


def session(threads: int | str = "*", memory: str = "8g", **options) -> SparkSession:
    """A local session with that many threads: the cap on what a fit takes of one machine."""
    b = SparkSession.builder.master(f"local[{threads}]").config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    for k, v in options.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def limit_threads(n: int) -> SparkSession:
    """Stops the active local session, if it has other than n threads, and gives one that has n. Sessions of clusters are left to their managers."""
    active = SparkSession.getActiveSession()
    if active is not None:
        master = active.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("the cluster's manager decides on threads here")
        if master == f"local[{n}]":
            return active
        active.stop()
    return session(n)


