"""Exact dedup by a tree-merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import by_bytes, cut, discard, splits, table

RADIX, BLOCK = 8, 4096
#: An entry of a run: a text's digest, its length and a second hash (which verify that equal digests are equal texts), the id that stays, if any, its row, and the rows it stands for.
ENTRY = np.dtype([("digest", "S32"), ("n_bytes", "<i8"), ("check", "<i8"), ("known", "?"), ("keep", "<i8"), ("row", "<i8"), ("size", "<i8")])
#: Runs travel as blocks of sorted entries, which name their sender and their first digest.
RUN = "at long, first binary, block binary"
FOUND = "digest binary, n_bytes long, check long, row long, size long, keep long"


def united(run: np.ndarray, keep: str) -> np.ndarray:
    """A sorted run with neighbours of equal digest, length and second hash made one: the id that stays (null only if there is no other; then the smallest row), the number of rows."""
    if len(run) < 2:
        return run
    same = (run["digest"][1:] == run["digest"][:-1]) & (run["n_bytes"][1:] == run["n_bytes"][:-1]) & (run["check"][1:] == run["check"][:-1])
    if not same.any():
        return run
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(run))))
    known = np.logical_or.reduceat(run["known"], start)
    usable = run["known"] == known[of]
    worst, best = (np.iinfo(np.int64).min, np.maximum) if keep == "max" else (np.iinfo(np.int64).max, np.minimum)
    stays = best.reduceat(np.where(usable, run["keep"], worst), start)
    usable &= run["keep"] == stays[of]
    out = run[start].copy()
    out["known"], out["keep"], out["size"] = known, stays, np.add.reduceat(run["size"], start)
    out["row"] = np.minimum.reduceat(np.where(usable, run["row"], np.iinfo(np.int64).max), start)
    return out


def merge(a: np.ndarray, b: np.ndarray, keep: str) -> np.ndarray:
    """Two sorted runs as one: each entry of b is put where it belongs in a; both are read once, and none is sorted again."""
    return united(np.insert(a, np.searchsorted(a["digest"], b["digest"], "right"), b), keep)


def send(run: np.ndarray, at: int, n: int, step: int, radix: int) -> Iterator[tuple[int, bytes, bytes]]:
    """A partition's run in blocks, each for the partition that has the entries' digit of the next round."""
    if step:
        to = np.array([int.from_bytes(d[:4].ljust(4, b"\0"), "big") for d in run["digest"].tolist()], np.int64) % n // step % radix
        parts = [(at + (digit - at // step % radix) * step, run[to == digit]) for digit in range(radix)]
    else:
        parts = [(at, run)]
    for where, part in parts:
        for i in range(0, len(part), BLOCK):
            yield where, part["digest"][i].ljust(32, b"\0"), part[i : i + BLOCK].tobytes()


def blocks(rows: list[tuple[int, bytes, bytes]]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["at", "first", "block"])


def first_runs(batches: Iterator, keep: str, n: int, radix: int) -> Iterator:
    """Each batch of rows, sorted once, as a run of this partition; sent to where its first digit belongs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        run = np.zeros(batch.num_rows, ENTRY)
        run["digest"] = batch["digest"].to_pylist()
        known = np.asarray(batch["id"].is_valid())
        run["known"], run["keep"] = known, batch["id"].fill_null(0).to_numpy(zero_copy_only=False)
        for c in ("n_bytes", "check", "row"):
            run[c] = batch[c].to_numpy(zero_copy_only=False)
        run["size"] = 1
        run = united(run[np.lexsort((run["check"], run["n_bytes"], run["digest"]))], keep)
        yield blocks(list(send(run, int(batch["at"][0].as_py()) % n, n, 1, radix)))


def merged_runs(batches: Iterator, keep: str, n: int, step: int, radix: int) -> Iterator:
    """Merges the runs that a partition got. Their blocks come in order of their first digests, so that each run has one open block at most: what lies before
    the next block's first digest is final and goes on. step: the next round's; 0 in the last, whose entries come out as rows."""
    open_, at = np.zeros(0, ENTRY), None

    def out(run: np.ndarray):
        return blocks(list(send(run, at, n, step, radix))) if step else entries(run)

    for batch in batches:
        for where, first, block in zip(batch["at"].to_pylist(), batch["first"].to_pylist(), batch["block"].to_pylist(), strict=True):
            final = np.searchsorted(open_["digest"], np.array(first, "S32"), "left")
            if final >= BLOCK:
                yield out(open_[:final])
                open_ = open_[final:]
            at = where
            open_ = merge(open_, np.frombuffer(block, ENTRY), keep)
    if len(open_):
        yield out(open_)


def entries(e: np.ndarray):
    """Entries that stand for two rows or more, as rows."""
    import pyarrow as pa

    e = e[e["size"] > 1]
    digest = pa.array([d.ljust(32, b"\0") for d in e["digest"].tolist()], pa.binary())
    cols = [pa.array(np.ascontiguousarray(e[c])) for c in ("n_bytes", "check", "row", "size")]
    return pa.RecordBatch.from_arrays([digest, *cols, pa.array(np.ascontiguousarray(e["keep"]), mask=~e["known"])], names=["digest", "n_bytes", "check", "row", "size", "keep"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (SHA-256, binary), n_bytes, check (a second hash), row and at (the partition): written once, so that row numbers hold."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("check"))
    return cut(out.withColumns({"row": F.monotonically_increasing_id(), "at": F.spark_partition_id().cast("long")}))


def copies(rows: DataFrame, keep: str = "min", radix: int = RADIX) -> DataFrame:
    """One row per digest that two rows or more have: keep (the id that stays), row (its row number), size.

    Each partition sorts its digests into runs and merges equal ones. In round r, the partitions whose numbers differ only in digit r
    (to base radix) exchange runs: each takes what has its digit and merges the runs that it gets, in a stream that holds an open block of each. After
    as many rounds as numbers have digits, a digest lies in one partition alone. As every level merges equal digests before it sends them, a digest that a
    third of all rows have costs each run one entry a round.
    """
    n, rounds = radix, 1
    while n < splits(rows.sparkSession):
        n, rounds = n * radix, rounds + 1
    by_bytes(rows.sparkSession)
    run = rows.mapInArrow(lambda b: first_runs(b, keep, n, radix), RUN)
    for r in range(rounds):
        step = radix ** (r + 1) if r + 1 < rounds else 0
        run = run.repartitionById(n, F.col("at").cast("int")).sortWithinPartitions("first").mapInArrow(lambda b, step=step: merged_runs(b, keep, n, step, radix), RUN if step else FOUND)
    return run


def groups_of(rows: DataFrame, keep: str) -> DataFrame:
    """rows (those of digests()) with keep_id, group_size and kept."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    # Groups of one need no link. A digest that many rows have makes a large join partition, which AQE splits.
    groups = copies(rows, keep).select("digest", "n_bytes", "check", F.col("keep").alias("keep_id"), F.col("row").alias("kept_row"), F.col("size").alias("group_size"))
    single = F.col("group_size").isNull()
    return rows.join(groups, ["digest", "n_bytes", "check"], "left").select(
        "id", "digest", "check",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("kept_row"))).alias("kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256. Texts are equal when they are identical (SHA-256, verified by length and a second hash); null counts as empty.

    keep: "min" or "max", the id that stays; among rows that repeat that id, one row stays. A null id stays only in a group without
    other ids. An empty table gives no rows. Other columns are never read.
    """
    out = groups_of(digests(docs, id_col, text_col), keep)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that stay: all columns, one row for each text; of rows that repeat both id and text, any. Rows travel once, to be parted from those that go."""
    inner = [f"c{i}" for i in range(len(docs.columns))]  # so that no column clashes
    source, id_ = docs.toDF(*inner), F.col(inner[docs.columns.index(id_col)]).cast("long")
    text = F.coalesce(F.col(inner[docs.columns.index(text_col)]), F.lit(""))
    rows = digests(docs, id_col, text_col)
    told = cut(groups_of(rows, keep).filter("group_size > 1").groupBy("id", "check").agg(F.max("kept").alias("stays"), F.count("*").alias("rows")))
    discard(rows)
    mine = id_.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("check"))
    out = source.join(told.filter("NOT stays OR rows > 1").select("id", "check"), mine, "left_anti")
    twice = told.filter("stays AND rows > 1").select("id", "check")
    if twice.limit(1).count():
        one = source.join(twice, mine).groupBy("id", "check").agg(F.first(F.struct(*inner)).alias("r")).select("r.*")
        out = out.unionByName(one)
    return out.toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


SQL = """
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST)
"""
