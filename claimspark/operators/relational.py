"""Store queries over input / output tables (JOIN-01, FLT-03/04/06/07, TOP-03).

Semantics follow the reference where it is consistent and fix its quirks
as recorded in the semantics ledger (Q1, Q2, Q4, Q5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.operators.common import broadcast_if, text_bytes


def input_output_pairs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """JOIN-01: inputs ⨝ outputs on input.id = output.input_id.  Plain
    equi-join: Spark / AQE choose broadcast or sort-merge from sizes."""
    i = inputs.select([F.col(c).alias(f"input_{c}") if c != "id" else F.col("id").alias("input_id")
                       for c in inputs.columns])
    o = outputs.select([F.col(c).alias("output_id") if c == "id" else F.col(c) for c in outputs.columns])
    return i.join(o, "input_id")


def date_condition(from_date=None, until_date=None, date_col: str = "date") -> Column:
    """Half-open [from, until) (Q3); a missing bound is not applied (Q1, Q2)."""
    cond = F.lit(True)
    if from_date is not None:
        cond = cond & (F.col(date_col) >= F.to_timestamp(F.lit(from_date)))
    if until_date is not None:
        cond = cond & (F.col(date_col) < F.to_timestamp(F.lit(until_date)))
    return cond


def pairs_by_date(pairs: DataFrame, from_date=None, until_date=None, date_col: str = "date") -> DataFrame:
    """FLT-06: half-open [from, until) on the output date.  Pushed into the
    scan when the date column comes straight from Parquet."""
    return pairs.filter(date_condition(from_date, until_date, date_col))


def recent_pairs(pairs: DataFrame, k: int | None = None, id_col: str = "output_id") -> DataFrame:
    """TOP-03 (Q4 fixed): newest k by id (TakeOrderedAndProject, a bounded
    per-partition heap); without k every pair in ascending id order."""
    if k is None:
        return pairs.orderBy(F.col(id_col).asc())
    return pairs.orderBy(F.col(id_col).desc()).limit(k)


def outputs_filter(outputs: DataFrame, model=None, input_id=None, misinfo_id=None) -> DataFrame:
    """FLT-07 (Q5 fixed): conjunctive, independent filters on model, input
    and misinfo; each one is a Parquet pushed filter."""
    cond = F.lit(True)
    if model is not None:
        cond = cond & (F.col("model_id") == model)
    if input_id is not None:
        cond = cond & (F.col("input_id") == input_id)
    if misinfo_id is not None:
        cond = cond & (F.col("misinfo_id") == misinfo_id)
    return outputs.filter(cond)


def by_source(df: DataFrame, source=None, col: str = "source_type") -> DataFrame:
    """FLT-03 / FLT-04: optional source equality."""
    return df if source is None else df.filter(F.col(col) == source)


def keyword_filter(df: DataFrame, *, tokens: Column, any_of=(), all_of=(), phrases=(), text: str | None = None,
                   lang: str | None = None, lang_col: str = "lang", allow_hosts=(), deny_hosts=(),
                   host_col: str = "host", date_col: str | None = None, from_date=None, until_date=None) -> DataFrame:
    """FLT-13: a crawl query as a filter on a text table -- OR group, AND
    group, exact phrases, language, host allow / deny suffixes and a
    half-open date range; one conjunctive predicate (no UDF)."""
    cond = F.lit(True)
    if any_of:
        cond = cond & F.exists(tokens, lambda t: t.isin(*any_of))
    for k in all_of:
        cond = cond & F.array_contains(tokens, k)
    for ph in phrases:
        cond = cond & F.lower(F.col(text)).contains(ph.lower())
    if lang is not None:
        cond = cond & (F.col(lang_col) == lang)
    if allow_hosts:
        ok = F.lit(False)
        for h in allow_hosts:
            ok = ok | F.col(host_col).endswith(h)
        cond = cond & ok
    for h in deny_hosts:
        cond = cond & ~F.col(host_col).endswith(h)
    if date_col is not None and from_date is not None:
        cond = cond & (F.col(date_col) >= from_date)
    if date_col is not None and until_date is not None:
        cond = cond & (F.col(date_col) < until_date)
    return df.filter(cond)


def match_queries(df: DataFrame, queries: DataFrame, *, tokens: Column, id_col: str, text: str) -> DataFrame:
    """FLT-13 for many crawl queries at once: (query_id, id) of every pair
    that ``keyword_filter`` keeps.  ``queries``: query_id and the arrays
    any_of, all_of, phrases.  Each text is tokenised once and meets only the
    queries that share a word with it, by a join on the word; phrases are
    looked up in the pairs left.  A query of phrases alone would meet every
    text and is refused; null arrays are empty."""
    q = queries.select("query_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c)
                                     for c in ("any_of", "all_of", "phrases")])
    if q.where("size(any_of) + size(all_of) = 0").limit(1).count():
        raise ValueError("a crawl query needs a keyword")
    words = q.select("query_id", F.explode(F.array_distinct("any_of")).alias("token"), F.lit(1).alias("any"), F.lit(0).alias("all")) \
        .union(q.select("query_id", F.explode(F.array_distinct("all_of")), F.lit(0), F.lit(1)))
    need = q.select("query_id", (F.size("any_of") > 0).alias("has_any"), F.size(F.array_distinct("all_of")).alias("n_all"),
                    F.transform("phrases", lambda p: F.lower(p)).alias("phrases"))
    found = df.select(id_col, F.explode(F.array_distinct(tokens)).alias("token"))
    hits = (found.join(broadcast_if(words, *text_bytes(words, "token")), "token").groupBy("query_id", id_col)
            .agg(F.max("any").alias("any"), F.sum("all").alias("all")))
    pairs = hits.join(need, "query_id").where("(not has_any or any = 1) and all = n_all")
    plain = pairs.where("size(phrases) = 0").select("query_id", id_col)
    texts = df.select(id_col, F.lower(F.col(text)).alias("_text"))
    held = pairs.where("size(phrases) > 0").join(texts, id_col).where(
        F.forall("phrases", lambda p: F.col("_text").contains(p)))
    return plain.union(held.select("query_id", id_col))


def page(df: DataFrame, order: list[Column], size: int = 100, number: int = 0) -> DataFrame:
    """TOP-07: one page of a sorted result (sort, then offset / limit)."""
    return df.orderBy(*order).offset(size * number).limit(size)
