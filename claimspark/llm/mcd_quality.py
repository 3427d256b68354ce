"""Quality rules with robust multivariate outliers.

Base rules count words (split at ASCII white space), word characters,
symbols, repeated lines and words in repeated 8-word windows of the whole
text.  Documents that pass them get a vector of transformed statistics: log
mean word length, symbol, repeated-line and repeated-word rates (asinh), log
word count.  Per language and source a minimum-covariance-determinant
estimate gives centre and scatter of the tighter half of the rows, and a
document is rejected when its squared Mahalanobis distance exceeds the
chi-square quantile of ``tail``.

The estimate is made by concentration steps over all rows: each step bins
the rows of a group by the logarithm of their distance and sums count,
first and second moments per bin (pre-aggregated before the shuffle, a
bounded number of bins); the innermost bins that hold at least half the
rows give the next centre and scatter.  Two starts, medians with absolute
deviations and the classical estimate, run side by side, and the one with the
smaller determinant wins.  ``FLOORS`` is added to the scatter as the
tolerance in each direction, since a statistic that is constant in most
documents would otherwise have none.

Documents in groups of fewer than ``min_rows`` are judged by an estimate
over the small groups of their language or, where these hold fewer together,
over all documents that pass the base rules; only a table in which fewer than
``min_rows`` documents pass them rejects nothing more.  Estimates are
broadcast while there are at most ``max_groups`` groups; beyond, rows are
salted and the estimates replicated, so a hot source is not one task.

Edge cases: null text has no words and fails the base rules; null language
or source is a value of its own; repeated rows are judged alike; an empty
table gives an empty result; other columns are ignored by ``judge``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import materialise

WINDOW = 8
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
# per statistic: the tolerance added to the scatter (a standard deviation)
FLOORS = (0.06, 0.25, 0.25, 0.25, 0.75)
P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def repeated_window_words(words: list, width: int = WINDOW) -> int:
    """Words inside ``width``-word windows that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index: dict = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint64, len(words))
    if len(index) == len(words):
        return 0
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i:n + i]
    _, first, counts = np.unique(mixed, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[first] > 1)
    if not len(again):
        return 0
    # equal mixes are compared word by word
    exact = np.stack([ids[again + i] for i in range(width)], axis=1)
    _, group, counts = np.unique(exact, axis=0, return_inverse=True, return_counts=True)
    again = again[counts[group.ravel()] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The base statistics of one text, in the order of ``STATS``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_window_words(words))


def stats_of(text: Column) -> Column:
    """The base statistics as a struct column."""
    @F.pandas_udf(STATS)
    def udf(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t) for t in texts], columns=[c.split()[0] for c in STATS.split(", ")])
    return udf(text)


def transformed() -> list[Column]:
    """The statistic vector; pseudo-words of five characters keep short
    texts near the common mean word length."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log((F.col("word_chars") + 500) / (n + 100)), F.asinh(20 * F.col("n_symbols") / n),
            F.asinh(20 * F.col("n_dup_lines") / n), F.asinh(2 * F.col("n_repeat_words") / n), F.log(n)]


def chi2_cdf(x: float, df: int) -> float:
    """Series of the regularised lower incomplete gamma function."""
    a, z = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= z / k
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < q else (low, mid)
    return high


def _distance(centre: str, inverse: str) -> Column:
    """Squared Mahalanobis distance of x0.. to the arrays of an estimate."""
    d = [F.col(f"x{i}") - F.col(centre)[i] for i in range(P)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + (1 if i == j else 2) * F.col(inverse)[k] * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def _estimate(n: float, sums: np.ndarray, squares: np.ndarray, factor: float) -> tuple[list, list, float]:
    """Centre, upper triangle of the inverse scatter, log determinant."""
    centre = sums / n
    scatter = np.zeros((P, P))
    for k, (i, j) in enumerate(PAIRS):
        scatter[i, j] = scatter[j, i] = squares[k] / n - centre[i] * centre[j]
    values, vectors = np.linalg.eigh(factor * scatter)  # rounding may leave tiny negative values
    scatter = (vectors * np.maximum(values, 0)) @ vectors.T + np.diag(np.square(FLOORS))
    inverse = np.linalg.inv(scatter)
    return centre.tolist(), [float(inverse[i, j]) for i, j in PAIRS], float(np.linalg.slogdet(scatter)[1])


EST = "grp string, start int, centre array<double>, inverse array<double>, logdet double"


def _join_small(rows: DataFrame, small: DataFrame, key: str, n_small: int, max_small: int, salts: int = 32,
                how: str = "inner") -> DataFrame:
    """Join on a hot key: broadcast up to ``max_small`` rows, else salted."""
    if n_small <= max_small:
        return rows.join(F.broadcast(small), key, how)
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
            .join(small.withColumn("_salt", salt), [key, "_salt"], how).drop("_salt"))


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f"x{i}") for i in range(P)]).alias("s"),
        F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in PAIRS]).alias("q"))


def _select_half(bins: DataFrame, factor: float) -> DataFrame:
    """Per group and start the estimate from the innermost bins."""
    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = pdf["n"].to_numpy()
        upto = int(np.searchsorted(np.cumsum(n), (n.sum() + 1) // 2)) + 1
        s, q = np.stack(pdf["s"].to_numpy())[:upto].sum(0), np.stack(pdf["q"].to_numpy())[:upto].sum(0)
        return pd.DataFrame([(pdf["grp"].iloc[0], pdf["start"].iloc[0],
                              *_estimate(float(n[:upto].sum()), s, q, factor if upto < len(n) else 1.0))],
                            columns=[c.split()[0] for c in EST.split(", ")])
    return bins.groupBy("grp", "start").applyInPandas(inner, EST)


def mcd(vectors: DataFrame, n_groups: int, max_groups: int, max_steps: int = 10) -> DataFrame:
    """(grp, centre, inverse) of the rows (doc_id, grp, x0..)."""
    factor = 0.5 / chi2_cdf(chi2_quantile(0.5, P), P + 2)  # consistency at the normal model

    def classical(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(g, 1, *_estimate(float(n), np.asarray(s), np.asarray(q), 1.0))
                             for g, n, s, q in zip(pdf["grp"], pdf["n"], pdf["s"], pdf["q"])],
                            columns=[c.split()[0] for c in EST.split(", ")])

    whole = _moments(vectors, "grp").mapInPandas(lambda it: map(classical, it), EST)
    medians = vectors.groupBy("grp").agg(
        F.array(*[F.percentile_approx(f"x{i}", 0.5, 1000) for i in range(P)]).alias("centre"))
    spread = _join_small(vectors, medians, "grp", n_groups, max_groups).groupBy("grp").agg(
        *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col("centre")[i]), 0.5, 1000).alias(f"m{i}") for i in range(P)])
    scale = [F.lit(1.0) / (F.pow(1.4826 * F.col(f"m{i}"), F.lit(2)) + F.lit(FLOORS[i] ** 2)) for i in range(P)]
    inverse = F.array(*[scale[i] if i == j else F.lit(0.0) for i, j in PAIRS])
    robust = medians.join(spread, "grp").select("grp", F.lit(0).alias("start"), "centre", inverse.alias("inverse"),
                                                F.lit(math.inf).alias("logdet"))
    estimates, before = materialise(robust.unionByName(whole), "mcd"), None
    for _ in range(max_steps):
        near = _join_small(vectors, estimates, "grp", 2 * n_groups, max_groups)
        near = near.withColumn("bin", F.floor(16 * F.log(_distance("centre", "inverse") + 1e-6)).cast("int"))
        estimates = materialise(_select_half(_moments(near, "grp", "start", "bin"), factor), "mcd")
        now = estimates.agg(F.sum("logdet")).first()[0]
        if before is not None and now is not None and abs(now - before) <= 1e-3 * n_groups:
            break
        before = now
    best = F.min_by(F.struct("centre", "inverse"), F.struct("logdet", "start")).alias("e")
    return estimates.groupBy("grp").agg(best).select("grp", "e.centre", "e.inverse")


def judge(docs: DataFrame, min_rows: int = 100, tail: float = 1e-6, max_groups: int = 20_000) -> DataFrame:
    """(doc_id, base statistics, base_failed, kept, distance2) of every row."""
    names = [c.split()[0] for c in STATS.split(", ")]
    cell = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"),
                       stats_of(F.col("text")).alias("s"))
    rows = rows.select("doc_id", "lang", cell.alias("cell"), *[F.col(f"s.{c}") for c in names])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = materialise(rows.withColumn("base_failed", failed)
                       .withColumns({f"x{i}": c for i, c in enumerate(transformed())}), "stats")
    passed = rows.where("not base_failed")
    cells = passed.groupBy("cell", "lang").agg(F.count(F.lit(1)).alias("n"))
    pools = (cells.where(F.col("n") < min_rows).groupBy("lang").agg(F.sum("n").alias("pool")))
    named = cells.join(pools, cells["lang"].eqNullSafe(pools["lang"]), "left").drop(pools["lang"])
    small = F.when(F.col("pool") >= min_rows, F.concat(F.lit("lang "), F.coalesce("lang", F.lit("\0")))) \
        .otherwise(F.lit("all"))
    named = materialise(named.select("cell", F.when(F.col("n") >= min_rows, F.concat(F.lit("cell "), "cell"))
                                     .otherwise(small).alias("grp"), "n"), "cells")
    # documents no group of their own can judge are judged by all that passed
    left_over = bool(named.where("grp = 'all'").limit(1).count())
    enough = named.agg(F.sum("n")).first()[0] or 0
    fitted = named.where("grp <> 'all'" if enough < min_rows else "true").select("cell", "grp")
    n_cells, n_groups = named.count(), fitted.select("grp").distinct().count()
    fits = fitted.where("grp <> 'all'")
    if left_over and enough >= min_rows:
        fits = fits.unionByName(named.select("cell", F.lit("all").alias("grp")))
    vectors = _join_small(passed, fits, "cell", 2 * n_cells, max_groups).select(
        "doc_id", "grp", *[f"x{i}" for i in range(P)])
    estimates = mcd(materialise(vectors, "vectors"), n_groups, max_groups)
    by_cell = fitted.join(estimates, "grp").select("cell", "centre", "inverse")
    judged = _join_small(rows, by_cell, "cell", n_cells, max_groups, how="left") \
        .withColumn("distance2", _distance("centre", "inverse"))
    cutoff = chi2_quantile(1 - tail, P)
    far = F.coalesce(F.col("distance2") > cutoff, F.lit(False)) & F.col("centre").isNotNull()
    return judged.select("doc_id", *names, "base_failed", (~F.col("base_failed") & ~far).alias("kept"),
                         F.when(F.col("centre").isNotNull(), F.col("distance2")).alias("distance2"))
