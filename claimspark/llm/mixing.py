"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words (split at ASCII white space).
Sources share the size of all documents by weight; a target stops at ``cap``
times its source's size, and the excess is shared by weight among the rest
until none is above.  Every document of a source expects target / size
copies.  These are prefix-summed along the source, one random offset per
source is added, and a document is emitted once per integer boundary that its
stretch crosses: so its copies are its expectation rounded down or up, never
more than ``cap``.  Documents lie in order of size, largest first, so that
each step of the sample meets all sizes and the words taken stay near the
target: they differ from it by at most one step, so by less than the
source's largest document.

The arithmetic is of whole numbers (an expectation is a fraction of two of
them), so no rounding depends on the order of sums, and a rerun agrees.  A
source may hold all rows: places come from ``ranked``, the sources' table
is as long as there are sources, and the driver sees three numbers of it a
round.

Edge cases: null text has size 0; null source is a source of its own, the
last in order; a source without words has target 0 and no copies; rows that
repeat are documents of their own; an empty table gives an empty result;
other columns are ignored by ``mix`` and kept by ``take_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import materialise, ranked

WEIGHTS, CAP, SEED = (1, 2, 3), 3, 11


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def water_fill(sources: DataFrame, cap: int) -> DataFrame:
    """Add to rows (size, weight) the fraction ``num / den`` that each
    source's size is to be multiplied with, and ``target``.  A round caps the
    sources whose share is above ``cap`` times their size and shares the rest
    anew; the capped only grow in number."""
    total = int(sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    size, weight = F.col("size").cast("decimal(38,0)"), F.col("weight")

    def whole(n: int) -> Column:
        return F.lit(str(n)).cast("decimal(38,0)")

    rest, weights, n_capped = total, None, -1
    capped = F.lit(False)
    while True:
        n, spent, free = sources.agg(F.count_if(capped), F.sum(F.when(capped, size * cap)),
                                     F.sum(F.when(~capped, weight))).first()
        rest, weights = total - int(spent or 0), int(free or 1)
        if n == n_capped:
            break
        n_capped = n
        capped = whole(weights * cap) * size < whole(rest) * weight
    none = F.col("size") == 0
    return sources.select(
        "*",
        F.when(none, whole(0)).when(capped, whole(cap)).otherwise(whole(rest) * weight).alias("num"),
        F.when(none | capped, whole(1)).otherwise(whole(weights) * size).alias("den"),
        F.when(capped, (F.col("size") * cap).cast("double"))
         .otherwise(F.lit(float(rest)) * weight / F.lit(weights)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies) of
    every row."""
    rows = materialise(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"),
                                   n_words(F.col("text")).alias("size")).withColumn("_order", -F.col("size")), "sizes")
    rows = ranked(rows, "source", ["_order", "doc_id", "text_hash"], nulls_last=True)
    cycle = F.array(*map(F.lit, weights))
    sources = materialise(rows.groupBy("_g").agg(F.sum("size").alias("size")).withColumn(
        "weight", F.get(cycle, (F.col("_g") % len(weights)).cast("int"))), "sources")
    filled = water_fill(sources, cap).select(F.col("_g").alias("_s"), F.col("size").alias("source_size"),
                                             "num", "den", "target")
    # 32 random bits make the offset, a fraction of a step
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10)
    offset = F.expr("(_bits * den) div 4294967296")
    met = F.col("_i").cast("decimal(38,0)")
    return (rows.join(filled, F.col("_g") == F.col("_s"))
            .withColumn("_bits", bits.cast("decimal(38,0)"))
            .withColumns({"_from": met * F.col("num") + offset, "_to": (met + 1) * F.col("num") + offset})
            .select("doc_id", "source", "text_hash", "size", "source_size", "target",
                    (F.expr("_to div den") - F.expr("_from div den")).alias("copies")))


def take_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed table: each document of ``docs`` as often as ``mixed`` says,
    with all its columns.  Rows equal in doc_id, source and text are one
    document, which gets the copies of all of them."""
    plan = mixed.groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").cast("int").alias("n")).where("n > 0")
    kept = (docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d"), F.col("source").alias("s"),
                        F.xxhash64("text").alias("h")).dropDuplicates(["d", "s", "h"]))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) \
        & (F.col("h") == F.col("text_hash"))
    return kept.join(plan, same).withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).select("row.*")
