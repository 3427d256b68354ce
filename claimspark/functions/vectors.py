"""Dense-vector Column helpers on ``array<float|double>`` (FN-13..20).

These are higher-order SQL functions (``zip_with`` / ``aggregate``): fine
for the per-row work of small vectors.  Block products over many pairs are
done with numpy inside ``mapInPandas`` (see ``operators.vector_search``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "dot", "l2norm", "l2_normalize", "cosine", "f1_of", "softmax", "argmax",
    "array_max_prob", "pair_features", "linear_head", "check_same_dim",
    "forced_binary", "combine_stages", "stance_word",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x))


def l2_normalize(a) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = l2norm(a)
    return F.transform(_c(a), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def cosine(a, b) -> Column:
    """FN-13: cosine similarity, 0 when either side has zero norm (Q15)."""
    return F.coalesce(F.try_divide(dot(a, b), l2norm(a) * l2norm(b)), F.lit(0.0))


def f1_of(p, r) -> Column:
    """FN-14: harmonic combination 2PR/(P+R); NULL when P+R = 0."""
    return F.try_divide(2 * _c(p) * _c(r), _c(p) + _c(r))


def softmax(logits) -> Column:
    """FN-15: numerically stable softmax of an array of logits."""
    l = _c(logits)
    m = F.array_max(l)
    ex = F.transform(l, lambda x: F.exp(x - m))
    s = F.aggregate(ex, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / s)


def argmax(arr) -> Column:
    """AGG-13: 0-based index of the first maximum."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def array_max_prob(arr) -> Column:
    return F.array_max(_c(arr))


def check_same_dim(a, b) -> Column:
    """FN-20: fail the query when two vectors differ in length."""
    return F.when(F.size(_c(a)) != F.size(_c(b)),
                  F.raise_error(F.lit("Embedding dimensions must match"))).otherwise(F.lit(True))


def pair_features(u, v, parts=("u", "v", "absdiff")) -> Column:
    """FN-18: concatenation of u, v, |u-v| and optionally u*v."""
    cu, cv = _c(u), _c(v)
    pieces = {
        "u": cu,
        "v": cv,
        "absdiff": F.zip_with(cu, cv, lambda x, y: F.abs(x - y)),
        "prod": F.zip_with(cu, cv, lambda x, y: x * y),
    }
    return F.concat(*[pieces[p] for p in parts])


def linear_head(x, weights: list[list[float]], bias: list[float]) -> Column:
    """FN-19: ``W x + b`` with a small fixed weight matrix as a literal."""
    cx = _c(x)
    rows = []
    for w_row, b in zip(weights, bias):
        w = F.array(*[F.lit(float(v)) for v in w_row])
        rows.append(dot(w, cx) + F.lit(float(b)))
    return F.array(*rows)


def forced_binary(logits) -> Column:
    """FN-16: 0 if logit[0] >= logit[1] else 1 (third class ignored)."""
    l = _c(logits)
    return F.when(l[0] >= l[1], F.lit(0)).otherwise(F.lit(1))


def combine_stages(relevance_label, probs) -> Column:
    """FN-17: irrelevant (2) stays 2; else agree (0) unless disagree is larger (Q18)."""
    p = _c(probs)
    return (F.when(_c(relevance_label) == 2, F.lit(2))
            .when(p[0] >= p[1], F.lit(0)).otherwise(F.lit(1)))


def stance_word(code) -> Column:
    """FN-12."""
    return F.when(_c(code) == 0, F.lit("agrees")).otherwise(F.lit("disagrees"))
