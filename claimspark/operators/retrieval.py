"""Sparse retrieval: TF-IDF cosine and BM25 as inverted-index term joins
(RET-01, RET-05, RET-08), top-k selection and zero fill (TOP-01/05,
JOIN-11, SET-02), claim variations (RET-10).

No cross join anywhere: the posts x claims scoring grid (JOIN-04) is an
equi-join on the term, so a post meets a claim only through a shared term.
The claim catalogue is the small side; it is broadcast behind a size check.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.text import word_tokens
from claimspark.operators.common import broadcast_if, by_key, score_key, top_k


def term_counts(df: DataFrame, id_col: str, text: str = "text", tokenizer=word_tokens,
                out_id: str | None = None, assume_partitioned: bool = False) -> DataFrame:
    """Bag of words: (id, tok, tf).

    The input is first hash-partitioned by id (moving compact text, not token
    rows; parts of bounded size); every later per-id aggregation and
    id join then reuses this partitioning without another exchange.  A table
    already bucketed by id skips the exchange (``assume_partitioned``).
    """
    out_id = out_id or id_col
    return (by_key(df.select(F.col(id_col).alias(out_id), F.col(text)), out_id, assume_partitioned,
                   text=text)
              .select(out_id, F.explode(tokenizer(F.col(text))).alias("tok"))
              .groupBy(out_id, "tok").agg(F.count(F.lit(1)).alias("tf")))


def _catalogue_stats(claims: DataFrame, text: str, tokenizer) -> tuple[int, int]:
    """Number of claims and total claim tokens (one small job): the idf
    constant and the broadcast size check."""
    r = claims.agg(F.count(F.lit(1)).alias("n"),
                   F.coalesce(F.sum(F.size(tokenizer(F.col(text)))), F.lit(0)).alias("t")).first()
    return int(r["n"]), int(r["t"])


class TfidfIndex(NamedTuple):
    """Claim side of RET-01, built once and reusable across post batches
    (RET-06): claim count, total claim tokens (size check), claim document
    frequencies, claim terms with both idf forms, post-free claim norms."""
    n: int
    n_tok: int
    dfm: DataFrame
    ct: DataFrame
    mb: DataFrame


def tfidf_index(claims: DataFrame, *, claim_id: str, claim_text: str = "text", tokenizer=word_tokens,
                persist: bool = False) -> TfidfIndex:
    """Build the claim-side tables once; ``persist`` keeps them cached for a
    stream of post batches (the catalogue is the small, static side)."""
    n, n_tok = _catalogue_stats(claims, claim_text, tokenizer)
    nn = float(n)
    mt = term_counts(claims, claim_id, claim_text, tokenizer, "cid").withColumnRenamed("tf", "tf_m")
    dfm = mt.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    ct = (mt.join(dfm, "tok")
            .withColumn("i0", F.log((F.lit(nn) + 2) / (F.col("df") + 1)) + 1)
            .withColumn("i1", F.log((F.lit(nn) + 2) / (F.col("df") + 2)) + 1))
    mb = ct.groupBy("cid").agg(F.sum(F.col("tf_m") ** 2 * F.col("i0") ** 2).alias("bb"))
    if persist:
        dfm, ct, mb = dfm.cache(), ct.cache(), mb.cache()
    return TfidfIndex(n, n_tok, dfm, ct, mb)


def tfidf_cosine(posts: DataFrame, claims: DataFrame | None = None, *, post_id: str, claim_id: str,
                 text: str = "text", claim_text: str | None = None,
                 tokenizer=word_tokens, posts_partitioned: bool = False,
                 index: TfidfIndex | None = None) -> DataFrame:
    """RET-01: cosine of smooth-idf TF-IDF vectors with the vectoriser fitted
    on (all claims + the post being scored), for every post at once.

    Closed form: with N claims and claim document frequency d(t), a term of
    the post has idf ``ln((N+2)/(d+2))+1`` and a claim term absent from the
    post ``ln((N+2)/(d+1))+1``; the claim norm is its post-free norm plus a
    correction over the shared terms.  Result: (post_id, claim_id, score) for
    pairs with a shared term (all other pairs score 0).  A prebuilt ``index``
    (:func:`tfidf_index`) replaces ``claims``.
    """
    if index is None:
        index = tfidf_index(claims, claim_id=claim_id, claim_text=claim_text or text, tokenizer=tokenizer)
    n, n_tok, dfm, ct, mb = index
    nn = float(n)
    pt = term_counts(posts, post_id, text, tokenizer, "pid", assume_partitioned=posts_partitioned)
    # the post norm is a window over the post's own terms: the rows are
    # already hash-partitioned by post, so no exchange and -- unlike a
    # separate aggregate joined back -- the texts are tokenised only once
    pi = (pt.join(broadcast_if(dfm, n_tok), "tok", "left")
            .withColumn("i1", F.log((F.lit(nn) + 2) / (F.coalesce(F.col("df"), F.lit(0)) + 2)) + 1)
            .withColumn("nn", F.sum(F.col("tf") ** 2 * F.col("i1") ** 2).over(Window.partitionBy("pid"))))
    hit = (pi.select("pid", "tok", "tf", "i1", "nn")
             .join(broadcast_if(ct.select("tok", "cid", "tf_m", F.col("i0").alias("i0m")), n_tok), "tok")
             .groupBy("pid", "cid")
             .agg(F.sum(F.col("tf") * F.col("tf_m") * F.col("i1") ** 2).alias("dot"),
                  F.sum(F.col("tf_m") ** 2 * (F.col("i1") ** 2 - F.col("i0m") ** 2)).alias("corr"),
                  F.first("nn").alias("nn")))
    return (hit.join(broadcast_if(mb, n), "cid")
               .select(F.col("pid").alias(post_id), F.col("cid").alias(claim_id),
                       (F.col("dot") / F.sqrt(F.col("nn") * (F.col("bb") + F.col("corr")))).alias("score")))


def bm25(posts: DataFrame, claims: DataFrame, *, post_id: str, claim_id: str,
         text: str = "text", claim_text: str | None = None, k1: float = 0.9, b: float = 0.4,
         tokenizer=word_tokens, posts_partitioned: bool = False) -> DataFrame:
    """RET-05: BM25 of every post (as the query) against the claim index.

    ``idf = ln(1 + (N - df + 0.5)/(df + 0.5))``; per matched term
    ``idf * tf / (tf + k1 (1 - b + b len/avglen))``; a query term repeated q
    times counts q times.  Exact token lengths (no lossy length encoding).
    Returns (post_id, claim_id, score) for claims sharing a term.
    """
    claim_text = claim_text or text
    n, n_tok = _catalogue_stats(claims, claim_text, tokenizer)
    avg_len = (n_tok / n) if n else 0.0
    lens = claims.select(F.col(claim_id).alias("cid"), F.size(tokenizer(F.col(claim_text))).alias("len"))
    mt = term_counts(claims, claim_id, claim_text, tokenizer, "cid").withColumnRenamed("tf", "tf_m")
    dfm = mt.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    ct = (mt.join(dfm, "tok").join(lens, "cid")
            .select("tok", "cid",
                    (F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
                     * F.col("tf_m")
                     / (F.col("tf_m") + k1 * (1 - b + b * F.col("len") / F.lit(avg_len)))).alias("w")))
    pt = term_counts(posts, post_id, text, tokenizer, "pid", assume_partitioned=posts_partitioned)
    return (pt.join(broadcast_if(ct, n_tok), "tok")
              .groupBy("pid", "cid").agg(F.sum(F.col("tf") * F.col("w")).alias("score"))
              .select(F.col("pid").alias(post_id), F.col("cid").alias(claim_id), "score"))


def top_claims(scores: DataFrame, *, post_id: str, claim_id: str, score: str = "score",
               k: int = 5, rank_col: str = "rank") -> DataFrame:
    """TOP-01/05: best ``k`` claims per post, ties on claim id ascending (Q16)."""
    return top_k(scores, post_id, [score_key(score).desc(), F.col(claim_id).asc()], k, rank_col)


def zero_fill_top_k(hits: DataFrame, posts: DataFrame, claim_ids: DataFrame, *, post_id: str,
                    claim_id: str, k: int, score: str = "score",
                    rank_col: str = "rank") -> DataFrame:
    """JOIN-11 / SET-02 with TOP-05: the best ``k`` hits of every post, then
    claims that were not hit, at score 0 and in id order, until the post has
    ``min(k, #claims)`` rows.  ``k`` is the caller's choice: the number of
    claims gives the whole fill, which is a posts x claims output; the sparse
    scores, with 0 for every missing pair, say the same in far fewer rows.

    Only the first k claim ids can ever be needed for filling, so they are
    taken once as a bounded literal array (k values).  Hits (at most k per
    post) and the post ids meet in one grouping by post, so the scoring plan
    runs once and no post x claim grid is built.
    """
    best = top_claims(hits, post_id=post_id, claim_id=claim_id, score=score, k=k, rank_col=rank_col)
    ctype = claim_ids.schema[claim_id].dataType.simpleString()
    first_ids = [r[0] for r in claim_ids.select(claim_id).orderBy(claim_id).limit(k).collect()]
    pool = F.array(*[F.lit(v).cast(ctype) for v in first_ids]) if first_ids else F.array().cast(f"array<{ctype}>")
    hit_t = f"struct<c:{ctype},s:double,r:bigint>"
    rows = (best.select(post_id, F.struct(F.col(claim_id).alias("c"), F.col(score).cast("double").alias("s"),
                                          F.col(rank_col).cast("bigint").alias("r")).alias("h"))
                .unionByName(posts.select(post_id, F.lit(None).cast(hit_t).alias("h"))))
    per_post = rows.groupBy(post_id).agg(F.collect_list("h").alias("hits"))
    n_hits = F.size("hits")
    fill_ids = F.slice(F.array_except(pool, F.transform("hits", lambda h: h["c"])), 1,
                       F.greatest(F.lit(k) - n_hits, F.lit(0)))
    fills = F.transform(fill_ids, lambda c, i: F.struct(c.alias("c"), F.lit(0.0).alias("s"),
                                                        (n_hits + i + 1).cast("bigint").alias("r")))
    return (per_post.select(post_id, F.inline(F.concat("hits", fills)))
                    .select(post_id, F.col("c").alias(claim_id), F.col("s").alias(score), F.col("r").alias(rank_col)))


def explode_variations(claims: DataFrame, *, id_col: str = "id", variations: str = "pos_variations",
                       first_only: bool = False, out: str = "variation") -> DataFrame:
    """RET-10: one row per positive variation (with its index), or only the
    first variation of each claim."""
    if first_only:
        return (claims.filter(F.size(variations) > 0)
                      .select("*", F.lit(0).alias("var_idx"), F.get(F.col(variations), 0).alias(out)))
    return claims.select("*", F.posexplode(variations).alias("var_idx", out))


def with_batch_columns(scores: DataFrame, *, post_id: str, claim_id: str, model_id: str,
                       score: str = "score") -> DataFrame:
    """RET-08: the prediction record (input_id, model_id, label_id, misinfo_id,
    confidence); retrieval rows carry no label (Q21: NULL)."""
    return scores.select(F.col(post_id).alias("input_id"), F.lit(model_id).alias("model_id"),
                         F.lit(None).cast("int").alias("label_id"),
                         F.col(claim_id).alias("misinfo_id"), F.col(score).alias("confidence"))
