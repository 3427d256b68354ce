"""Small planning helpers shared by operators: size-checked broadcast,
top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A side is broadcast only under this many (estimated) bytes; above it the
# join is left to Spark (sort-merge, AQE re-plan and skew-join splitting).
BROADCAST_MAX_BYTES = 100 << 20
ROW_BYTES = 50          # a row of a claim term index
PART_TEXT_BYTES = 4 << 20  # text of one part, before its tokens become rows
VECTOR_ROW_BYTES = 8 << 10  # a row with a vector of up to a thousand doubles


def broadcast_if(df: DataFrame, rows: int | None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise AQE decides."""
    if rows is not None and rows * row_bytes <= BROADCAST_MAX_BYTES:
        return F.broadcast(df)
    return df


def text_bytes(df: DataFrame, text: str) -> tuple[int, int]:
    """(rows, average bytes of a row) of a table of texts, for a size check."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return int(r["n"]), int(r["b"]) // max(int(r["n"]), 1) + ROW_BYTES


def top_k(df: DataFrame, by, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """TOP-01/02/05 and the selection extension point (UDF-03: k, order and
    tie rule are the window specification): the first ``k`` rows per group with a deterministic
    tie rule (``order`` must end in a unique key).  Spark plans this as a
    WindowGroupLimit before the final window, so at most k rows per group and
    partition cross the shuffle."""
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
              .filter(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def score_key(score: str | Column, digits: int = 9) -> Column:
    """Ordering key of a floating score: rounded so that mathematically equal
    scores summed in a different order tie (and fall to the id tie rule)."""
    c = F.col(score) if isinstance(score, str) else score
    # Spark orders NaN above every number: a NaN score must never win (Q20)
    return F.round(F.when(F.isnan(c), F.lit(float("-inf"))).otherwise(c), digits)


def by_key(df: DataFrame, key: str, assume_partitioned: bool = False, *, text: str) -> DataFrame:
    """Hash-partition ``df`` by ``key`` once, into parts of about
    ``PART_TEXT_BYTES`` of ``text``: a text's tokens take some hundred times
    its size as rows, so the parts, not a fixed setting, bound what a task
    holds.  Where that gives fewer parts than cores, the session's shuffle
    partitions are kept, which AQE coalesces.  With ``assume_partitioned`` (a
    table bucketed / partitioned by the key) no exchange is added."""
    if assume_partitioned:
        return df
    rows, row_bytes = text_bytes(df, text)
    n = -(-rows * row_bytes // PART_TEXT_BYTES)
    return df.repartition(n, key) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(key)


def spread(df: DataFrame, key: str, per_core: int = 4) -> DataFrame:
    """Rows dealt over all cores by a key where the input has few splits (a
    small table in one file); an input of many splits is read as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < per_core * cores else df
