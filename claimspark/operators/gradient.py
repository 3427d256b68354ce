"""Softmax regression trained by distributed sums (STN-01..03, STN-09/10).

Examples are rows (id, key, x) of their non-zero features, the constant of the
bias under the key ''.  A round sums the logits per example, the errors of
the class probabilities, and the errors times x per key: two aggregates over
the features, which stay partitioned by example for all rounds, and one
weight row per key and class.  Each round writes the weights to the shared
scratch folder.  They are broadcast, which takes them through the driver once
a round, only where the rounds together stay below a size limit; else they are
joined by key to a second copy of the features that lies by key, and only
logits and errors per example are shuffled.  So the vocabulary may grow with
the data.

Steps are accelerated (Nesterov) with a fixed length of 2 / (greatest squared
norm of an example), the inverse of a bound of the loss's curvature; the
number of rounds is fixed, so a run can be repeated number by number.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.text import strip_accents, word_tokens
from claimspark.operators.common import BROADCAST_MAX_BYTES, ROW_BYTES, broadcast_if
from claimspark.operators.mlheads import bow_vocabulary
from claimspark.session import scratch_path

CLASSES = 3


def with_bias(features: DataFrame, ids: DataFrame) -> DataFrame:
    """Features (id, key, x) with the bias feature of every example."""
    return features.unionByName(ids.select("id", F.lit("").alias("key"), F.lit(1.0).alias("x")))


def bow_features(data: DataFrame, vocabulary: DataFrame, *, id_col: str,
                 sides=("sentence1", "sentence2")) -> DataFrame:
    """STN-01's features: per side the uni- and bigrams of the cleaned text
    that the vocabulary (side, term, idf) holds, as tf * idf of length 1."""
    parts = []
    for s in sides:
        toks = data.select(F.col(id_col).alias("id"), word_tokens(F.coalesce(strip_accents(s), F.lit(""))).alias("w"))
        pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))),
                           F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))),
                           lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(toks.select("id", F.lit(s).alias("side"), F.explode(F.concat("w", pairs)).alias("term")))
    terms = parts[0]
    for p in parts[1:]:
        terms = terms.unionByName(p)
    tf = terms.groupBy("id", "side", "term").agg(F.count(F.lit(1)).alias("tf"))
    x = tf.join(broadcast_if(vocabulary.select("side", "term", "idf"), vocabulary.count()), ["side", "term"]) \
        .withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") ** 2).over(Window.partitionBy("id", "side")))
    return with_bias(x.select("id", F.concat_ws("|", "side", "term").alias("key"), (F.col("x") / norm).alias("x")),
                     data.select(F.col(id_col).alias("id")))


def vector_features(data: DataFrame, vec: Column, *, id_col: str) -> DataFrame:
    """STN-03's features: the numbers of a vector, by place."""
    x = data.select(F.col(id_col).alias("id"), F.posexplode(vec).alias("at", "x"))
    return with_bias(x.where("x <> 0").select("id", F.col("at").cast("string").alias("key"), F.col("x").cast("double")),
                     data.select(F.col(id_col).alias("id")))


def _logits(prefix: str) -> list[Column]:
    return [F.sum(F.col("x") * F.coalesce(F.col(f"{prefix}{c}"), F.lit(0.0))) for c in range(CLASSES)]


def _shares() -> list[Column]:
    """The class probabilities of logits."""
    top = F.greatest("z0", "z1", "z2")
    e = [F.exp(F.col(f"z{c}") - top) for c in range(CLASSES)]
    total = e[0] + e[1] + e[2]
    return [v / total for v in e]


def _errors(shares: list[Column]) -> list[Column]:
    return [F.sum(F.col("x") * (p - (F.col("label") == c).cast("double"))).alias(f"g{c}") for c, p in enumerate(shares)]


def fit_softmax(features: DataFrame, labels: DataFrame, *, rounds: int, l2: float = 0.0) -> DataFrame:
    """Weights (key, w0, w1, w2) after ``rounds`` steps from 0 for the
    examples that ``labels`` (id, label) names.  ``l2`` is the penalty per
    example; the bias has none."""
    spark = features.sparkSession
    data = features.join(labels.select("id", "label"), "id").repartition("id").sortWithinPartitions("id") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    n, longest = data.groupBy("id").agg(F.sum(F.col("x") ** 2).alias("q")).agg(
        F.count(F.lit(1)), F.coalesce(F.max("q"), F.lit(1.0))).first()
    rate = 2.0 / longest
    names = [f"{v}{c}" for v in "wy" for c in range(CLASSES)]
    state = None  # per key the weights w and the point y ahead of them that the gradient is taken at
    of_key = None  # the features by key, once the weights are too many to be broadcast every round
    for r in range(rounds):
        if state is not None and n_keys * rounds * ROW_BYTES > BROADCAST_MAX_BYTES:
            if of_key is None:
                of_key = data.select("id", "key", "x").repartition("key").persist(StorageLevel.MEMORY_AND_DISK)
            z = of_key.join(state.select("key", "y0", "y1", "y2"), "key").groupBy("id").agg(
                *[s.alias(f"z{c}") for c, s in enumerate(_logits("y"))])
            p = z.select("id", *[s.alias(f"p{c}") for c, s in enumerate(_shares())])
            grad = data.join(p, "id").groupBy("key").agg(*_errors([F.col(f"p{c}") for c in range(CLASSES)])).join(state, "key")
        else:
            here = data.withColumns({v: F.lit(0.0) for v in names}) if state is None else data.join(F.broadcast(state), "key")
            of_example = Window.partitionBy("id")
            z = here.select("key", "x", "label", *names,
                            *[s.over(of_example).alias(f"z{c}") for c, s in enumerate(_logits("y"))])
            grad = z.groupBy("key").agg(*[F.any_value(v).alias(v) for v in names], *_errors(_shares()))
        penalty = F.when(F.col("key") == "", 0.0).otherwise(l2)
        grad = grad.withColumns({f"v{c}": F.col(f"y{c}") - rate * (F.col(f"g{c}") / n + penalty * F.col(f"y{c}"))
                                 for c in range(CLASSES)})
        ahead = (r + 1.0) / (r + 4.0)
        path = scratch_path(spark, "weights")
        grad.select("key", *[F.col(f"v{c}").alias(f"w{c}") for c in range(CLASSES)],
                    *[(F.col(f"v{c}") + ahead * (F.col(f"v{c}") - F.col(f"w{c}"))).alias(f"y{c}")
                      for c in range(CLASSES)]).write.parquet(path)
        state = spark.read.parquet(path)
        n_keys = n_keys if r else state.count()  # the keys stay the same
    data.unpersist()
    if of_key is not None:
        of_key.unpersist()
    return state.select("key", "w0", "w1", "w2")


def predict(features: DataFrame, weights: DataFrame) -> DataFrame:
    """STN-02: (id, prediction, probability) of the likeliest class, equal
    ones to the smaller code."""
    z = features.join(broadcast_if(weights, weights.count()), "key", "left").groupBy("id").agg(
        *[s.alias(f"z{c}") for c, s in enumerate(_logits("w"))])
    top = F.greatest("z0", "z1", "z2")
    best = F.when(F.col("z0") >= top, 0).when(F.col("z1") >= top, 1).otherwise(2)
    total = sum((F.exp(F.col(f"z{c}") - top) for c in range(CLASSES)), F.lit(0.0))
    return z.select("id", best.cast("bigint").alias("prediction"), (1.0 / total).alias("probability"))
