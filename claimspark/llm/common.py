"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimspark.session import scratch_path

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; all other characters stay."""
    return F.translate(c, UPPER, LOWER)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it
    back: cuts the lineage in a form that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: str, order: list[str], nulls_last: bool = False,
           max_broadcast_rows: int = 200_000) -> DataFrame:
    """Add ``_g`` (number of the row's group in the groups' order), ``_i``
    (its place within the group) and ``_n`` (the group's rows), all from 0
    upwards and gapless.  A group's null is a group of its own, first or last;
    nulls of ``order`` come first, and wholly tied rows are numbered anyhow.

    No group meets in one task: rows are range-partitioned by group and
    order (tied rows too may be split), written with their place in their
    partition, and a table of one row per partition and group that lies in
    it holds what comes before.  Callers pass written, narrow rows, since
    range partitioning reads its input twice."""
    keys = [F.col(group).asc_nulls_last() if nulls_last else F.col(group).asc_nulls_first(),
            *(F.col(c).asc_nulls_first() for c in order), F.col("_tie")]
    placed = materialise(df.withColumn("_tie", F.monotonically_increasing_id())
                         .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
                         .withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_part", F.call_function("shiftright", F.col("_at"), F.lit(33)))
    parts = materialise(placed.groupBy("_part", F.col(group).alias("_group"))
                        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c")), "parts")
    within = Window.partitionBy("_group").orderBy("_part")
    parts = parts.select("*", F.sum("_c").over(Window.partitionBy("_group")).alias("_n"),
                         (F.sum("_c").over(within) - F.col("_c")).alias("_before"),
                         (F.row_number().over(within) == 1).cast("bigint").alias("_new"))
    # groups that begin in earlier partitions: a window over one row per partition
    begun = parts.groupBy("_part").agg(F.sum("_new").alias("_b")).select(
        "_part", (F.sum("_b").over(Window.orderBy("_part")) - F.col("_b")).alias("_begun"))
    parts = parts.join(begun, "_part").withColumn(
        "_g", F.col("_begun") + F.sum("_new").over(Window.partitionBy("_part").orderBy("_first")) - 1)
    parts = materialise(parts.select(F.col("_part").alias("_p"), "_group", "_first", "_n", "_before", "_g"), "parts")
    if parts.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        parts = F.broadcast(parts)
    return placed.join(parts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group"))).select(
        *df.columns, "_g", (F.col("_before") + F.col("_at") - F.col("_first")).alias("_i"), "_n")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph given as edge rows;
    component is the smallest node reachable.  Alternating large-star and
    small-star steps: each hangs a node's neighbours on its smallest
    neighbour, so the number of rounds grows with the logarithm of the
    graph's diameter.  Minima are pre-aggregated before the shuffle and the
    joins on a hub node are plain shuffled joins that AQE may split; every
    round is written to the shared scratch folder.  Self loops and repeated
    edges are allowed; an empty input gives an empty result."""
    def star(sym: DataFrame) -> DataFrame:
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return sym.join(low, "u")

    e = materialise(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
                    .where("u <> v").distinct(), "edges")
    while True:
        sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (star(sym).where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct())
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = star(down)
        small = (low.select(F.col("m").alias("u"), "v").union(low.select(F.col("m").alias("u"), F.col("u").alias("v")))
                 .where("u <> v").distinct())
        nxt = materialise(small, "edges")
        left, right = (d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
                       for d in (e, nxt))
        e = nxt
        if left == right:
            break
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")) \
        .union(e.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()


def fit_in_task(sample: DataFrame, fit: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray | None:
    """Train on a bounded sample (the caller's limit) in one executor task,
    which a lost executor repeats; the driver sees the numbers only.  None
    where the sample is empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in batches if len(pdf)]
        if parts:
            yield pd.DataFrame({"model": [fit(pd.concat(parts, ignore_index=True)).astype("<f8").tobytes()]})

    found = sample.coalesce(1).mapInPandas(run, "model binary").collect()
    return np.frombuffer(found[0]["model"], "<f8").copy() if found else None


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Unsigned 64-bit XXH64 of each word (seed 42)."""
    from xxhash import xxh64_intdigest
    return np.fromiter((xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
