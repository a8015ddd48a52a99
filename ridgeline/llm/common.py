"""What several operators share: tables, checkpoints, ASCII folding, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U = np.uint64
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: Column) -> Column:
    """Text with A-Z, and nothing else, in lower case; null gives the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where it is unset, a temporary one if Spark runs on this machine alone; else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def by_bytes(spark: SparkSession) -> None:
    """Bounds the batches of rows sent to Python by their bytes: texts may be long, and every task holds some batches on both sides. Left alone where the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # the default
        spark.conf.set(name, str(BATCH_BYTES))


class Owner(list):
    """The tables that are cut while it is entered; when it is left, what is left of them is deleted: for callers that have written the result by then."""

    open: list[Owner] = []

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark = spark

    def __enter__(self) -> Owner:
        Owner.open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Owner.open.remove(self)
        for path in self:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written as a table to the shared folder and read again: without lineage, compressed, of known size.

    Executors may come and go: what was written stays. discard() deletes it."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    if Owner.open:
        Owner.open[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() made and that nothing reads any more; others are left alone."""
    for t in tables:
        path = getattr(t, "_cut_at", None)
        if path:
            delete(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no DataFrame refers to any more: it does so when the driver collects its garbage, which is
    rare in a driver that does little, while the executors' disks fill."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def splits(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of splitmix64)."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHash(dict):
    """64-bit hashes of words (bytes), kept for words seen before; bounded, as it is emptied when full."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        """Hashes of the words [^\\x20\\x09-\\x0D]+ of a UTF-8 text with A-Z folded."""
        words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles, in order; with fewer words, of the whole sequence."""
    k = min(k, len(words))
    out = np.zeros(max(len(words) - k + 1, 0) if k else 0, U)
    for i in range(k):
        out = out * U(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i]
    return mix(out + U(k))


def utf8(column) -> list[bytes | None]:
    """The values of an Arrow string column as bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def kept(name, make):
    """A value that a Python worker makes once and keeps between tasks (functions come anew with each task): one at a time, as workers live on from stage to stage."""
    import sys

    held = sys.__dict__.setdefault("_ridgeline_kept", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]
