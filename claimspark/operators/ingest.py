"""Ingestion operators: insert-if-new with generated ids (ING-01/02,
WIN-02, JOIN-06, AGG-18), JSON projection (PRJ-01/02), record reshaping
(PRJ-03..06), article dedup (ING-06, JOIN-07), request batches (ING-08),
pending files (JOIN-12), newest groups (WIN-05), HTML cards (PRJ-07),
ordered digests (AGG-17) and configuration overlay (FN-28).
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.text import collapse_ws, drop_last_char
from claimspark.operators.common import BROADCAST_MAX_BYTES, ROW_BYTES
from claimspark.session import checkpoint_dir


# ------------------------------------------------------------- dense ids
def dense_ids(df: DataFrame, order: list[str], base: int | Column = 0, id_col: str = "id") -> DataFrame:
    """Consecutive ids ``base+1 ..`` in ``order`` without a single-task
    window: range-partition and sort within partitions, take each row's
    index inside its partition from ``monotonically_increasing_id`` (partition
    id in the upper bits), and add the running count of the preceding
    partitions (a P-row table, broadcast).  The numbered rows are
    checkpointed into the shared checkpoint folder, so the numbering is
    fixed even if executors are lost and tasks re-run, and no second
    shuffle of the data is needed."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    s = (df.repartitionByRange(*order).sortWithinPartitions(*order)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_rn", F.monotonically_increasing_id() - F.col("_pid").cast("bigint") * F.lit(1 << 33))
           .checkpoint(eager=True))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    b = base if isinstance(base, Column) else F.lit(base)
    return (s.join(F.broadcast(offs), "_pid")
             .withColumn(id_col, (b + F.col("_off") + F.col("_rn") + 1).cast("bigint"))
             .drop("_pid", "_off", "_rn"))


def first_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """WIN-02: first row per key in input order.  ``min_by`` is a plain
    aggregate (partial aggregation before the shuffle, no window sort)."""
    others = [c for c in df.columns if c not in key]
    agg = F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order)).alias("_r")
    return df.groupBy(*key).agg(agg).select(*key, *[F.col(f"_r.{c}").alias(c) for c in others])


def anti_join_stored(new: DataFrame, stored: DataFrame, keys: list[str],
                     max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """JOIN-06: rows of ``new`` whose key is not in ``stored``.

    When the new keys are few (a batch against a large store) they are
    broadcast to filter the stored keys where they lie (semi join, no
    shuffle of the store) and the few matches are then removed by a
    broadcast anti join.  Otherwise a plain shuffled anti join.
    """
    new_keys = new.select(*keys).distinct()
    width = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) + ROW_BYTES for k in keys), F.lit(0))
    size = new_keys.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    if size <= max_broadcast_bytes:
        hit = stored.select(*keys).join(F.broadcast(new_keys), keys, "left_semi").distinct()
        return new.join(F.broadcast(hit), keys, "left_anti")
    return new.join(stored.select(*keys).distinct(), keys, "left_anti")


def insert_if_new(incoming: DataFrame, stored: DataFrame, *, key: list[str], order: str,
                  id_col: str | None = "id") -> tuple[DataFrame, DataFrame]:
    """ING-01 / ING-02: rows of ``incoming`` whose natural key is not stored.

    Duplicates inside the batch keep their first row (Q7 fixed); the anti
    join (JOIN-06) replaces one existence query per record; new ids continue
    after ``max(stored.id)`` in ``order``.  Returns (inserted rows, counts
    with given / inserted / success -- AGG-18, Q32)."""
    firsts = first_per_key(incoming, key, order)
    new = anti_join_stored(firsts, stored, key)
    if id_col is not None:
        base = stored.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
        new = dense_ids(new, [order], base=int(base), id_col=id_col)
    counts = (incoming.select(F.lit(1).alias("g"), F.lit(0).alias("i"))
              .unionByName(new.select(F.lit(0).alias("g"), F.lit(1).alias("i")))
              .agg(F.sum("g").cast("bigint").alias("given"), F.sum("i").cast("bigint").alias("inserted"))
              .withColumn("success", F.col("given") == F.col("inserted")))
    return new, counts


# ----------------------------------------------------------- projections
def project_tree(df: DataFrame, tree: dict, prefix: str = "") -> list[Column]:
    """PRJ-01: columns for a nested tree of ``True`` leaves; sub-trees become
    structs (nested column pruning reaches the reader).  Missing leaves and
    parents are NULL (Q25, Q26)."""
    cols = []
    for k, v in tree.items():
        path = f"{prefix}{k}"
        if v is True:
            cols.append(F.col(path).alias(k))
        elif isinstance(v, dict):
            cols.append(F.struct(*project_tree(df, v, f"{path}.")).alias(k))
    return cols


def project_with_defaults(template: dict, prefix: str = "") -> list[Column]:
    """PRJ-02: like :func:`project_tree` but every leaf carries a default
    that replaces an absent / NULL value."""
    cols = []
    for k, v in template.items():
        path = f"{prefix}{k}"
        if isinstance(v, dict):
            cols.append(F.struct(*project_with_defaults(v, f"{path}.")).alias(k))
        else:
            cols.append(F.coalesce(F.col(path), F.lit(v)).alias(k))
    return cols


def fixed_columns(arr: str, n: int, prefix: str) -> list[Column]:
    """PRJ-05: first ``n`` elements of an array as columns, blank-filled."""
    return [F.coalesce(F.get(F.col(arr), i), F.lit("")).alias(f"{prefix}{i + 1}") for i in range(n)]


def claims_to_rows(claims: DataFrame, *, keep_id: bool) -> DataFrame:
    """PRJ-03 / UDF-04 / FN-22 (JSON encode): claim record -> misinformation row: text, sources as
    JSON ``{"list": [...]}``, reliability 1, the rest as JSON ``misc``; the
    id is kept (first format) or left to the store (second format)."""
    cols = [F.col("canonical_sentence").alias("text"),
            F.to_json(F.struct(F.col("sources").alias("list"))).alias("url"),
            F.col("origin").alias("source"), F.lit(1.0).alias("reliability"),
            F.to_json(F.struct("category", "pos_variations", "neg_variations", "reliability_score")).alias("misc")]
    if keep_id:
        cols = [F.col("id")] + cols
    return claims.select(*cols)


# ------------------------------------------------------------ dedup etc.
def dedup_articles(batch: DataFrame, stored: DataFrame, *, keys=("category", "url"),
                   order: str = "seq") -> DataFrame:
    """ING-06 / JOIN-07 (Q31): first article per (category, url) in the
    batch, minus keys already stored."""
    keys = list(keys)
    return anti_join_stored(first_per_key(batch, keys, order), stored, keys)


def request_batches(ids: DataFrame, id_col: str, n: int) -> DataFrame:
    """ING-08 / WIN-04 / FN-26: ids in groups of ``n`` in id order, joined
    with commas; positions come from :func:`dense_ids` (no global window)."""
    pos = dense_ids(ids.select(id_col), [id_col], 0, "_pos")
    return (pos.withColumn("batch", F.floor((F.col("_pos") - 1) / n).cast("bigint"))
               .groupBy("batch")
               .agg(F.count(F.lit(1)).alias("n_ids"),
                    F.array_join(F.array_sort(F.collect_list(id_col)), ",").alias("ids")))


def newest_groups(df: DataFrame, group_col: Column, m: int, name: str = "grp") -> DataFrame:
    """WIN-05: rows of the newest ``m`` groups.  The distinct groups are
    few; their top m is a TakeOrdered, joined back by broadcast -- no
    single-partition dense_rank over the rows."""
    g = df.withColumn(name, group_col)
    top = g.select(name).distinct().orderBy(F.col(name).desc()).limit(m)
    return g.join(F.broadcast(top), name)


class _CardParser(HTMLParser):
    """The ``<article>`` elements of a page in order of their start, nested
    ones too: [id, link, strings of the first link in the first ``h2`` of the
    first ``header``].  Comments, scripts and tags inside attribute values are
    what the parser takes them for; an element left open ends with the one
    around it."""
    PATH = ("header", "h2", "a")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cards, self.open = [], []  # open: (card, steps of PATH entered, whether the path has ended)

    def handle_starttag(self, tag, attrs):
        for state in self.open:
            if not state[2] and tag == self.PATH[min(state[1], 2)] and state[1] < 3:
                state[1] += 1
                if state[1] == 3:
                    state[0][1] = dict(attrs).get("href") or ""
        if tag == "article":
            self.cards.append([dict(attrs).get("id") or "", "", []])
            self.open.append([self.cards[-1], 0, False])

    def handle_endtag(self, tag):
        if tag == "article" and self.open:
            self.open.pop()
        for state in self.open:
            if tag in self.PATH[:state[1]]:
                # the heading's link ends the search; an element that holds none does so too (its first one counts)
                state[2] = True

    def handle_data(self, data):
        for card, step, ended in self.open:
            if step == 3 and not ended and data and self.cdata_elem is None:
                card[2].append(data)


@F.udtf(returnType="card_idx bigint, id string, href string, strings array<string>")
class _ArticleCards:
    def eval(self, html: str):
        if html:
            parser = _CardParser()
            parser.feed(html)
            parser.close()
            for i, (name, href, strings) in enumerate(parser.cards):
                yield i, name, href, strings


def html_cards(pages: DataFrame, *, html: str = "html", origin: str = "fact-check-cards") -> DataFrame:
    """PRJ-07 / TRN-07: every ``<article>`` card -> claim record: the card's
    id attribute, the link of its heading (``header h2 a``), the heading's
    first string without its last character as status (FN-09), the strings
    after it with white space normalised (FN-05) as claim, constant origin.
    A heading of one string is a claim without a status (null); a card
    without a heading link has an empty id, link and claim where they are
    missing.  Pages are parsed in a table function joined laterally; null and
    empty pages have no card."""
    cards = pages.select(F.col(html).alias("_html")).lateralJoin(_ArticleCards(F.col("_html").outer()))
    both = F.size("strings") > 1
    claim = F.when(both, F.array_join(F.slice("strings", 2, F.greatest(F.size("strings") - 1, F.lit(0))), "")) \
        .otherwise(F.array_join("strings", ""))
    return cards.select("id", "card_idx", "href", collapse_ws(claim).alias("claim"),
                        F.when(both, drop_last_char(F.get("strings", 0))).alias("status"),
                        F.lit(origin).alias("origin"))


def ordered_digest(lines: DataFrame, order: list[str], text: str, bucket_rows: int = 1024) -> DataFrame:
    """AGG-17 at scale: a Merkle-style ordered digest.  Level 0 is the md5 of
    every line; each level hashes the ordered digests of ``bucket_rows``
    consecutive items; levels repeat until at most ``bucket_rows`` digests
    remain, whose ordered md5 is the result.  Every group is bounded by
    ``bucket_rows`` and the value is fixed by the order."""
    # lines are reduced to their digests before numbering: the checkpoint
    # holds 32-character digests, not the texts
    lvl = dense_ids(lines.select(*order, F.md5(F.col(text)).alias("h")), order, 0, "_pos") \
        .select((F.col("_pos") - 1).alias("pos"), "h")
    n_lines = lvl.count()
    n = n_lines

    def roll(df):
        return df.groupBy(F.floor(F.col("pos") / bucket_rows).alias("pos")).agg(
            F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda s: s["h"]),
                               "")).alias("h"))
    lvl = roll(lvl)
    n = -(-n // bucket_rows)
    while n > bucket_rows:
        lvl = roll(lvl).checkpoint(eager=True)
        n = -(-n // bucket_rows)
    return lvl.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))),
                                                  lambda s: s["h"]), "")).alias("digest")) \
        .withColumn("n_lines", F.lit(n_lines).cast("bigint"))


def overlay(defaults: DataFrame, overrides: DataFrame, keys=("entity", "key"), value: str = "value") -> DataFrame:
    """FN-28 / ING-05: nested overlay in long form: (entity, key path,
    value); overrides win, new keys are added, blank overrides are dropped
    first (FLT-14)."""
    keys = list(keys)
    o = overrides.filter(F.col(value).isNotNull() & (F.col(value) != "")).withColumnRenamed(value, "_o")
    d = defaults.withColumnRenamed(value, "_d")
    return d.join(o, keys, "full").select(*keys, F.coalesce("_o", "_d").alias(value))


def pending_inputs(inputs: DataFrame, outputs: DataFrame, *, path: str = "path", out_path: str = "out",
                   out_exts=(".jsonl", ".jsonl.gz")) -> DataFrame:
    """JOIN-12 / SET-05 / FN-27: input files whose stem has no processed
    output in any of the output extensions (union of the done sets, anti
    join on the stem)."""
    from claimspark.functions.misc import path_basename, path_stem
    pat = "(" + "|".join(e.replace(".", r"\.") for e in sorted(out_exts, key=len, reverse=True)) + ")$"
    done = outputs.select(F.regexp_replace(path_basename(out_path), pat, "").alias("stem")).distinct()
    return inputs.withColumn("stem", path_stem(path)).join(done, "stem", "left_anti")


def annotation_inputs(rows: DataFrame) -> DataFrame:
    """PRJ-04 (input side) with FLT-08: non-blank annotation rows -> input
    records keyed by tweet id (first row per id in file order)."""
    ok = rows.filter((F.length("label") > 0) & (F.length("tweet_id") > 0))
    return first_per_key(ok.select("doc_id", F.col("tweet_id").alias("source_id"), F.col("tweet").alias("text"),
                                   F.lit("Twitter").alias("source_type")), ["source_id"], "doc_id")


def load_annotations(raw: DataFrame, stored_inputs: DataFrame, stored_outputs: DataFrame, label: Column, *,
                     model_id: str = "human") -> tuple[DataFrame, DataFrame]:
    """ING-03: the new inputs (source_id, text, source_type, doc_id, id) and
    new outputs (input_id, model_id, misinfo_id, label_id, confidence, doc_id,
    id) of an annotation file: inputs are inserted if new (ING-01), every
    labelled row is joined to its input, new or stored (JOIN-03), and outputs
    are inserted if new by (input, model, claim).  A file loaded again, or
    again with more rows, adds only what is not stored."""
    inputs, _ = insert_if_new(annotation_inputs(raw), stored_inputs, key=["source_id"], order="doc_id")
    ids = inputs.select("source_id", "id").unionByName(stored_inputs.select("source_id", "id")) \
        .withColumnRenamed("id", "input_id")
    rows = raw.filter((F.length("label") > 0) & (F.length("tweet_id") > 0))
    outputs = rows.join(ids, rows["tweet_id"] == ids["source_id"]).select(
        "input_id", F.lit(model_id).alias("model_id"), F.col("misconception_id").alias("misinfo_id"),
        label.cast("bigint").alias("label_id"), F.lit(1.0).alias("confidence"), "doc_id")
    return inputs, insert_if_new(outputs, stored_outputs, key=["input_id", "model_id", "misinfo_id"], order="doc_id")[0]


# UDF-04: per-format record reshapers, applied with ``df.transform(RESHAPERS[name])``.
RESHAPERS = {
    "initial_wiki": lambda df: claims_to_rows(df, keep_id=True),
    "old_jsonl_format": lambda df: claims_to_rows(df, keep_id=False),
    "old_csv_format": annotation_inputs,
}


def reshape(df: DataFrame, custom_type: str) -> DataFrame:
    """UDF-04: reshape raw records of a known format; unknown formats raise."""
    return df.transform(RESHAPERS[custom_type])
