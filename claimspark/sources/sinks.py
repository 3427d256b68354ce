"""Sinks (SNK-01..10): DataFrame writers.  Every writer is a single
distributed write (one task per partition); nothing is buffered on the
driver."""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-01 / SNK-08 / SNK-10: JSON lines (``overwrite`` first, then
    ``append``); NULL fields are omitted by the writer (Q25)."""
    df.write.mode(mode).json(path)


def write_gzip_jsonl(df: DataFrame, path: str, max_records: int = 200_000, partition_by: str | None = None,
                     mode: str = "overwrite") -> None:
    """SNK-02 / ING-09: gzip JSONL split in files of at most ``max_records``
    rows, optionally one folder per day."""
    w = df.write.mode(mode).option("compression", "gzip").option("maxRecordsPerFile", max_records)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def write_named_jsonl(df: DataFrame, path: str, prefix: str, day: str, max_records: int = 200_000) -> int:
    """SNK-02: gzip JSONL files ``prefix-day-index.jsonl.gz`` of at most
    ``max_records`` rows, in one folder; returns their number.  Spark writes
    and commits part files in a hidden folder beside them first, so a failed
    job leaves no named file; then each is renamed, which moves no data.
    The index of a day goes on after the files that stand; rows without a day
    are named ``none``."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path
    staging = f"{path.rstrip('/')}/_staging-{os.urandom(6).hex()}"
    write_gzip_jsonl(df.withColumn("_day", F.coalesce(F.col(day).cast("string"), F.lit("none"))), staging, max_records, "_day")
    fs, n = file(staging).getFileSystem(conf), 0
    for folder in fs.listStatus(file(staging)):
        if not folder.isDirectory():
            continue
        stem = f"{prefix}-{unquote(folder.getPath().getName().split('=', 1)[1])}"
        taken = [f.getPath().getName()[len(stem) + 1:].split(".")[0] for f in fs.globStatus(file(f"{path}/{stem}-*.jsonl.gz")) or []]
        index = 1 + max((int(x) for x in taken if x.isdigit()), default=-1)
        for part in sorted((f.getPath() for f in fs.listStatus(folder.getPath())), key=lambda p: p.getName()):
            if not fs.rename(part, file(f"{path}/{stem}-{index}.jsonl.gz")):
                raise OSError(f"could not name {part.toString()}")
            index, n = index + 1, n + 1
    fs.delete(file(staging), True)
    return n


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    """SNK-03 / SNK-04 / SNK-07: CSV with quoting of multi-line text."""
    df.write.mode(mode).option("header", str(header).lower()).option("escape", '"').csv(path)


def append_if_new(table_path: str, new_rows: DataFrame, key: list[str]) -> DataFrame:
    """SNK-05: append rows whose key is not in the stored table; returns
    the rows appended (existence check is one anti join, JOIN-06)."""
    spark = new_rows.sparkSession
    from claimspark.operators.ingest import anti_join_stored
    from claimspark.session import checkpoint_dir, path_exists
    first = not path_exists(spark, table_path)
    fresh = new_rows if first else anti_join_stored(new_rows, spark.read.parquet(table_path), key)
    # materialise the anti join once (reliable checkpoint in the shared
    # folder) so the rows returned are exactly the rows appended
    checkpoint_dir(spark)
    fresh = fresh.checkpoint(eager=True)
    fresh.write.mode("append").parquet(table_path)
    return fresh


def write_ids(df: DataFrame, id_col: str, path: str) -> None:
    """SNK-06: one inserted id per line."""
    df.select(F.col(id_col).cast("string")).write.mode("overwrite").text(path)


def write_mirrored(df: DataFrame, path: str, subdir: str = "subdir") -> None:
    """SNK-09: output files mirrored per input sub-directory."""
    df.write.mode("overwrite").partitionBy(subdir).json(path)
