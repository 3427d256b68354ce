"""Stance operators (STN-04..08): pair features, a linear softmax head,
two-stage combination with the retrieval threshold and the single-post
agree/disagree pipeline -- all column expressions over pair rows.

Trained MLlib heads (STN-01..03, STN-05) live in ``operators.mlheads``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.vectors import (
    argmax, combine_stages, forced_binary, linear_head, pair_features, softmax, stance_word,
)
from claimspark.operators.common import VECTOR_ROW_BYTES, broadcast_if

RELEVANCE_THRESHOLD = 0.4  # fixed value: relevance threshold of the online pipeline


def rule_weights(n_out: int, dim: int) -> tuple[list[list[float]], list[float]]:
    """Deterministic stand-in weights for a linear head (exact decimals):
    ``W[c][j] = ((31c + 17j) mod 11 - 5) / 10``, ``b[c] = (c - 1) / 10``."""
    w = [[((31 * c + 17 * j) % 11 - 5) / 10.0 for j in range(dim)] for c in range(n_out)]
    return w, [(c - 1) / 10.0 for c in range(n_out)]


def attach_vectors(pairs: DataFrame, post_vecs: DataFrame, claim_vecs: DataFrame, *,
                   post_id: str = "input_id", claim_id: str = "misinfo_id",
                   n_claims: int | None = None) -> DataFrame:
    """(post, claim) pairs + u (post vector) + v (claim vector).  The claim
    vectors are the small side (broadcast behind the size check)."""
    pv = post_vecs.select(F.col(post_vecs.columns[0]).alias(post_id), F.col("vec").alias("u"))
    cv = claim_vecs.select(F.col(claim_vecs.columns[0]).alias(claim_id), F.col("vec").alias("v"))
    return pairs.join(pv, post_id).join(broadcast_if(cv, n_claims, VECTOR_ROW_BYTES), claim_id)


def linear_softmax(pairs: DataFrame, weights, bias, *, parts=("u", "v", "absdiff")) -> DataFrame:
    """STN-04 / STN-08: features -> logits -> probabilities; label = arg max,
    confidence = max probability."""
    x = pair_features("u", "v", parts)
    return (pairs.withColumn("logits", linear_head(x, weights, bias))
                 .withColumn("probs", softmax("logits"))
                 .withColumn("label_id", argmax("probs"))
                 .withColumn("confidence", F.array_max("probs")))


def relevance(scores: DataFrame, score: str = "score", threshold: float = RELEVANCE_THRESHOLD):
    """FLT-10: relevant iff score >= threshold; NaN / NULL is irrelevant (Q20)."""
    s = F.col(score)
    return s.isNotNull() & ~F.isnan(s) & (s >= threshold)


def attach_vectors_if(pairs: DataFrame, post_vecs: DataFrame, claim_vecs: DataFrame, cond, *,
                      post_id: str = "input_id", claim_id: str = "misinfo_id",
                      n_claims: int | None = None) -> DataFrame:
    """Left-join u / v only onto the rows where ``cond`` holds (NULL
    elsewhere): one pass over ``pairs`` instead of scoring a filtered copy and
    joining it back, so the scoring plan upstream runs once."""
    pv = post_vecs.select(F.col(post_vecs.columns[0]).alias("_p"), F.col("vec").alias("u"))
    cv = claim_vecs.select(F.col(claim_vecs.columns[0]).alias("_c"), F.col("vec").alias("v"))
    j = pairs.join(pv, (F.col(post_id) == F.col("_p")) & cond, "left").drop("_p")
    return j.join(broadcast_if(cv, n_claims, VECTOR_ROW_BYTES), (F.col(claim_id) == F.col("_c")) & cond, "left").drop("_c")


def two_stage(scores: DataFrame, post_vecs: DataFrame, claim_vecs: DataFrame, head, *,
              post_id: str = "input_id", claim_id: str = "misinfo_id", score: str = "score",
              threshold: float = RELEVANCE_THRESHOLD, n_claims: int | None = None) -> DataFrame:
    """STN-06 (JOIN-05, FN-17): relevance by the threshold; only relevant
    pairs receive vectors, so only they are classified; label = 2 for
    irrelevant pairs, else agree (0) unless disagree is more probable."""
    rel = scores.withColumn("rel", F.when(relevance(scores, score, threshold), 0).otherwise(2))
    j = attach_vectors_if(rel, post_vecs, claim_vecs, F.col("rel") == 0, post_id=post_id, claim_id=claim_id,
                          n_claims=n_claims)
    return head(j).withColumn("label_id", combine_stages("rel", "probs"))


def agree_disagree(best: DataFrame, post_vecs: DataFrame, claim_vecs: DataFrame, head, *,
                   post_id: str = "input_id", claim_id: str = "misinfo_id", score: str = "score",
                   threshold: float = RELEVANCE_THRESHOLD, n_claims: int | None = None) -> DataFrame:
    """STN-07: best claim per post -> threshold -> forced binary stance over
    the first two logits -> 'agrees' / 'disagrees' (relevant posts only)."""
    flagged = best.withColumn("relevant", relevance(best, score, threshold))
    j = attach_vectors_if(flagged, post_vecs, claim_vecs, F.col("relevant"), post_id=post_id,
                          claim_id=claim_id, n_claims=n_claims)
    return (head(j).withColumn("label_id", F.when(F.col("relevant"), forced_binary("logits")))
                   .withColumn("label", F.when(F.col("relevant"), stance_word("label_id"))))
