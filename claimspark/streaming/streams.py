"""Structured Streaming jobs (ING-06/07/10/11).

* ``score_stream`` -- per micro-batch scoring through ``foreachBatch``; each
  batch is written to its own ``batch_id`` folder with overwrite, so a batch
  replayed after a failure replaces its own output (exactly-once output on
  top of the checkpointed source offsets).
* ``dedup_forever`` -- the reference's "insert if never seen": each batch
  keeps its first row per key and anti-joins the keys already in the sink
  table before appending.  Exact, state = the sink table itself.
* ``dedup_keyed`` -- the same with one state entry per key in the state store:
  neither the table nor its keys are read again.
* ``dedup_within_watermark`` -- bounded-state alternative that forgets keys
  older than the watermark.
* ``daily_distinct_counts`` -- tumbling-day event counts and approximate
  distinct users with a watermark for late data.
* ``daily_sketches`` -- the same as mergeable sketches, each day written once
  when the watermark has passed it; ``users_of_spans`` unites them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators.ingest import anti_join_stored, first_per_key, request_batches
from claimspark.session import checkpoint_dir, path_exists, scratch_path


def stage_files(df: DataFrame, path: str, n_files: int) -> str:
    """Producer side for tests / replays: land a DataFrame as ``n_files``
    Parquet files that a file stream then picks up one trigger at a time."""
    df.repartition(n_files).write.mode("overwrite").parquet(path)
    return path


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def _run(writer, checkpoint: str):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def score_stream(stream: DataFrame, batch_fn, sink: str, checkpoint: str | None = None):
    """ING-10: run a batch scoring function on every micro-batch."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "ckpt-score")

    def each(batch: DataFrame, batch_id: int):
        batch_fn(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    return _run(stream.writeStream.foreachBatch(each), checkpoint)


def request_stream(stream: DataFrame, id_col: str, n: int, fetch, out: str, checkpoint: str):
    """ING-08 / JOIN-12 with resume: ids that arrive as files are asked for in
    requests of ``n`` by ``fetch``, a function of the request table (batch,
    n_ids, ids).  The checkpoint is the ledger of finished batches and each
    batch writes one folder, so a run that broke goes on with the batch it
    broke in and asks for no finished one again."""
    return score_stream(stream, lambda batch: fetch(request_batches(batch, id_col, n)), out, checkpoint)


def dedup_forever(stream: DataFrame, table: str, keys: list[str], order: str, checkpoint: str | None = None):
    """ING-06 (exact): append rows whose key was never stored.  Batches are
    processed in order, so keys of earlier batches are in the table."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "ckpt-dedup")

    def each(batch: DataFrame, batch_id: int):
        firsts = first_per_key(batch, keys, order)
        if path_exists(batch.sparkSession, table):
            firsts = anti_join_stored(firsts, batch.sparkSession.read.parquet(table), keys)
        firsts.write.mode("append").parquet(table)
    return _run(stream.writeStream.foreachBatch(each), checkpoint)


def dedup_keyed(stream: DataFrame, keys: list[str], order: str, out: str, stored: str | None = None,
                checkpoint: str | None = None):
    """ING-06 (exact): rows whose key was never stored, appended to ``out``.

    A key's entry in the state store says that it is known; of a micro-batch
    the first row in ``order`` of every unknown key passes.  ``stored``, a
    table of earlier rows, is a second stream source, so each of its files is
    read once in the life of the checkpoint, and only its keys.  The file
    sink's log makes the output exactly-once over restarts.  State grows with
    the keys and is partitioned by them; on a cluster keep it on disk
    (``spark.sql.streaming.stateStore.providerClass`` = RocksDB)."""
    spark = stream.sparkSession
    rows = stream.select("*", F.lit(False).alias("_known"))
    if stored is not None:
        past = spark.readStream.schema(stream.select(*keys).schema).parquet(stored)
        rows = rows.unionByName(past.select("*", F.lit(True).alias("_known")), allowMissingColumns=True)
    columns = stream.columns

    def first(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, best = state.exists, None
        for pdf in batches:
            new = pdf[~pdf["_known"].astype(bool)]
            known = known or len(new) < len(pdf)
            if not known and len(new):
                row = new.nsmallest(1, order)
                best = row if best is None or row[order].iloc[0] < best[order].iloc[0] else best
        if not state.exists:
            state.update((True,))
        if not known and best is not None:
            yield best[columns]

    kept = rows.groupBy(*keys).applyInPandasWithState(first, stream.schema, "known boolean", "append", "NoTimeout")
    return sink_to_parquet(kept, out, checkpoint or scratch_path(spark, "ckpt-dedup"))


def dedup_within_watermark(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """ING-06 (bounded state): drop repeats of a key seen within ``delay``."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_distinct_counts(stream: DataFrame, ts: str, user: str, delay: str = "1 hour") -> DataFrame:
    """ING-11: per tumbling UTC day: events and approximate distinct users;
    a day is emitted once the watermark passes its end (append mode)."""
    return (stream.withWatermark(ts, delay)
                  .groupBy(F.window(ts, "1 day").alias("w"))
                  .agg(F.count(F.lit(1)).alias("n_events"), F.approx_count_distinct(user).alias("approx_users")))


def daily_sketches(stream: DataFrame, ts: str, user: str, delay: str = "1 hour", lg_k: int = 12) -> DataFrame:
    """ING-11 / AGG-01: per tumbling UTC day the events and a sketch of the
    distinct users, for append mode: a day is emitted once, when the
    watermark passes its end; rows later than ``delay`` are left out."""
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"))
                  .agg(F.count(F.lit(1)).alias("n_events"), F.hll_sketch_agg(user, F.lit(lg_k)).alias("users")))


def users_of_spans(daily: DataFrame, span: Column, name: str) -> DataFrame:
    """Events, days and distinct users of any spans of whole days, from the
    days' sketches alone; the error is that of one sketch (1.04 / 2^(lg_k / 2))."""
    return daily.groupBy(span.alias(name)).agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("n_events").alias("n_events"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("approx_users"))


def stage_in_order(df: DataFrame, path: str, ts: str, n_files: int) -> str:
    """Producer side for replays of a log: files by rising ``ts``, written
    one after the other, as a file stream then reads them."""
    at = F.col(ts).cast("double")
    cuts = df.select(at.alias("t")).approxQuantile("t", [i / n_files for i in range(1, n_files)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df if low is None else df.where(at > low)
        part = part if high is None else part.where(at <= high)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def sink_to_parquet(agg: DataFrame, sink: str, checkpoint: str | None = None, mode: str = "append"):
    spark = agg.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "ckpt-agg")
    return _run(agg.writeStream.format("parquet").outputMode(mode).option("path", sink), checkpoint)


__all__ = ["stage_files", "stage_in_order", "file_stream", "score_stream", "request_stream", "dedup_forever", "dedup_keyed",
           "dedup_within_watermark", "daily_distinct_counts", "daily_sketches", "users_of_spans", "sink_to_parquet",
           "checkpoint_dir"]


def thin_tree_stream(spark: SparkSession, root: str, schema, out: str, select_cols, condition,
                     checkpoint: str | None = None, exts: str = "*.{jsonl,json,gz}"):
    """ING-07 on ``readStream``: new files under ``root/<subdir>/`` are
    filtered, projected and written to a tree mirrored per sub-directory
    (file sink, partitioned by ``subdir``)."""
    import os
    from urllib.parse import urlparse
    rp = (urlparse(root).path if "://" in root else os.path.abspath(root)).rstrip("/")
    src = (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", exts)
           .option("maxFilesPerTrigger", 8).json(root)
           .withColumn("subdir", F.regexp_extract(F.col("_metadata.file_path"), r"\Q" + rp + r"\E/([^/]+)/", 1)))
    thin = src.filter(condition & ~F.col("subdir").startswith(".")).select(*select_cols, "subdir")
    checkpoint = checkpoint or scratch_path(spark, "ckpt-thin")
    return _run(thin.writeStream.format("json").partitionBy("subdir").option("path", out), checkpoint)
