"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item's windows are its runs of ``width`` consecutive words; an
item with fewer words, but not none, is one window.  A document word inside
any occurrence of a window is hit.

Shingles are ordered by rarity: a window's words by their number of
occurrences in the documents, then by the word itself.  A window is wholly
contained or not, so a matching document must hold the window's rarest word:
the necessary prefix is that one word.  Document words are joined with
the prefix words; each match at position p of a window whose prefix word
stands at offset o proposes the start p - o, which must leave room for the
whole window (positional bound) inside the document (length bound), and is
then compared word by word.

Documents are read twice (word counts of benchmark words, then the join)
and their texts are never shuffled: words are exploded, joined and verified
in one stage, and only hits and one row per document reach the exchange.
The benchmark side is broadcast in blocks of at most ``block_chars``
characters of item text, counted first; a larger benchmark is asked in
several blocks, so no item is dropped.  Built-in functions only.

Edge cases: null text has no words; items without words have no window;
repeated items (same id) count once, items of one text under each id; a null
item id counts as ''; repeated documents get a row each; extra columns are
ignored by ``find_contamination`` and kept by ``drop_contaminated``; empty
tables give zero hits or an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import ascii_lower

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; empty for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, items): each distinct window with the ids it occurs in."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                         words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return (w.select("item", "w", F.explode(starts).alias("i"))
            .select("item", F.slice("w", F.col("i"), F.lit(width)).alias("window"))
            .groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")))


def prefix_index(windows: DataFrame, docs_words: DataFrame) -> DataFrame:
    """(token, entries): per prefix word its windows as (window, offset,
    items).  The windows of one block are small by ``block_chars``."""
    tokens = windows.select("window", "items", F.posexplode("window").alias("offset", "token"))
    vocabulary = tokens.select("token").distinct()
    counts = (docs_words.select(F.explode("w").alias("token")).join(F.broadcast(vocabulary), "token")
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rarest = (tokens.join(counts, "token", "left")
              .groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset"))
                                     .alias("first"), F.first("items").alias("items")))
    return (rarest.where("first.n > 0")  # a word no document holds: nothing to find
            .groupBy(F.col("first.token").alias("token"))
            .agg(F.collect_list(F.struct("window", F.col("first.offset").alias("offset"), "items")).alias("entries")))


def _blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars) or 1
    if n == 1:
        return [benchmark]
    cell = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [benchmark.where(cell == i) for i in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10,
                       block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per
    document row."""
    split = docs.select("doc_id", words(F.col("text")).alias("w"))
    blocks = []
    for i, part in enumerate(_blocks(benchmark.select("item_id", "text"), block_chars)):
        index = prefix_index(item_windows(part, width), split)
        # each document also carries one mark, the empty word, which matches
        # no window and brings the document's own row to the aggregate
        mark = F.array(F.lit("")) if i == 0 else F.slice(F.array(F.lit("")), 1, 0)
        blocks.append(_hits(split, mark, index))
    hits = blocks[0]
    for b in blocks[1:]:
        hits = hits.unionByName(b)
    per_doc = hits.groupBy("row_id", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "len"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))
    return per_doc.select(
        "doc_id", F.col("n_words").cast("bigint"), F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"),
        F.size("ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _hits(split: DataFrame, mark: Column, index: DataFrame) -> DataFrame:
    """Verified window occurrences (row_id, doc_id, n_words, start, len, items)
    and, by the mark, one row without a start per document."""
    spark = split.sparkSession
    entry = index.schema["entries"].dataType.simpleString()
    table = index.unionByName(spark.range(1).select(F.lit("").alias("token"),
                                                    F.array().cast(entry).alias("entries")))
    exploded = (split.withColumn("row_id", F.monotonically_increasing_id())
                .select("row_id", "doc_id", "w", F.posexplode(F.concat(mark, "w")).alias("at", "token")))
    joined = (exploded.join(F.broadcast(table), "token")
              .select("row_id", "doc_id", "w", "at", F.size(mark).alias("shift"), F.explode_outer("entries").alias("e")))
    start = F.col("at") - F.col("shift") - F.col("e.offset")
    length = F.size("e.window")
    fits = (start >= 0) & (start + length <= F.size("w"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.greatest(length, F.lit(0))) == F.col("e.window")
    return joined.where(F.col("e").isNull() | (fits & same)).select(
        "row_id", "doc_id", F.size("w").alias("n_words"), F.when(F.col("e").isNotNull(), start).alias("start"),
        F.when(F.col("e").isNotNull(), length).alias("len"), F.col("e.items").alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Documents without any benchmark window.  A repeated id goes when any
    of its rows holds one; rows with a null id are judged together."""
    bad = find_contamination(docs, benchmark, width).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")
