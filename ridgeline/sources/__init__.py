"""Sources and sinks of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(data, spark: SparkSession | None = None) -> DataFrame:
    """A DataFrame as it is, a pandas or Arrow table, or the path or glob of Parquet files."""
    if isinstance(data, DataFrame):
        return data
    spark = spark or SparkSession.getActiveSession()
    if isinstance(data, (str, list, tuple)) or hasattr(data, "__fspath__"):
        paths = [str(p) for p in data] if isinstance(data, (list, tuple)) else [str(data)]
        return spark.read.parquet(*paths)
    return spark.createDataFrame(data)


#: Plans of these nodes alone give the same rows in the same partitions each time they run.
STEADY = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "SubqueryAlias", "View"}


def steady(df: DataFrame) -> bool:
    """Whether a plan only reads, selects and filters: no shuffle, limit or sample that another run may deal otherwise."""
    node = df._jdf.queryExecution().optimizedPlan()
    while True:
        name, children = node.nodeName(), node.children()
        if name.split()[0] not in STEADY or children.size() > 1 or not node.deterministic():
            return False
        if not children.size():
            return True
        node = children.apply(0)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds a number that tells rows apart. A plan that another run may deal otherwise is written out once with its numbers, which thus hold."""
    from ridgeline.plans.cache import cut

    out = df.withColumn(name, F.monotonically_increasing_id())
    return out if steady(df) else cut(out)


def sink(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> str:
    """Writes Parquet, in folders by columns if asked."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def group_batches(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """function(iterator of Arrow tables, each a whole group) over rows dealt by keys: for operators that need all rows of a group in one piece.

    A group lies in one task, whose memory it must fit; its batches are joined, and several small groups follow each other."""

    def whole(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            codes = [t[k].combine_chunks() for k in keys]
            change = [i for i in range(1, t.num_rows) if any(c[i] != c[i - 1] for c in codes)]
            for x, y in zip([0, *change], change):
                yield t.slice(x, y - x)
            held = t.slice(change[-1] if change else 0)
        if held is not None and held.num_rows:
            yield held

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: function(whole(batches)), schema)
