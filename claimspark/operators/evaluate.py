"""Evaluation of retrieval and stance models (EVL-01..05, WIN-01, AGG-03..08).

All models are evaluated in one pass: every aggregate is grouped by
``model_id``; no per-model driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Model families of the reference's evaluation registry.
SIMILARITY_MODELS = [
    "bow-cosine", "bert-base-cosine", "bert-ft-cosine", "ct-bert-cosine", "bert-score-base",
    "bert-score-ft", "bert-score-ct", "glove-avg-cosine", "pyserini",
]
STANCE_MODELS = [
    "bow-log-snli", "bow-log-mnli", "bow-log-mednli", "boe-log-snli", "boe-log-mnli",
    "boe-log-mednli", "bilstm-snli", "bilstm-mnli", "bilstm-mednli", "sbert-snli", "sbert-mnli",
    "sbert-mednli", "sbert-snli-ct", "sbert-mnli-ct", "sbert-mednli-ct", "sbert-fever-ct",
    "sbert-scifact-ct", "sbert-ann-ct", "comb-bilstm-snli", "comb-bilstm-mnli",
    "comb-bilstm-mednli", "comb-sbert-snli-ct", "comb-sbert-mnli-ct", "comb-sbert-mednli-ct",
    "comb-sbert-fever-ct", "comb-sbert-scifact-ct", "comb-sbert-ann-ct",
]
CLASSES = (0, 1, 2)


def model_registry(spark: SparkSession) -> DataFrame:
    """EVL-05: (model_id, family) lookup, a 36-row dimension."""
    rows = [(m, "similarity") for m in SIMILARITY_MODELS] + [(m, "stance") for m in STANCE_MODELS]
    return spark.createDataFrame(rows, "model_id string, family string")


def average_rank(preds: DataFrame, *, by: str = "input_id", score: str = "confidence",
                 partition_extra: tuple[str, ...] = ("model_id",), out: str = "rank") -> DataFrame:
    """WIN-01: rank of ``score`` within ``by`` (descending), ties averaged;
    NULL score -> NULL rank.  rank() + (ties - 1) / 2 equals the mean of
    the tied positions."""
    keys = [c for c in partition_extra if c in preds.columns] + [by]
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last())
    # ties counted with a RANGE frame of the same window (peers of the row):
    # one partitioning and one sort for both expressions
    tie = w.rangeBetween(Window.currentRow, Window.currentRow)
    r = F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2.0
    return preds.withColumn(out, F.when(F.col(score).isNull(), F.lit(None)).otherwise(r.cast("double")))


def retrieval_report(gold: DataFrame, preds: DataFrame, models: list[str], *, ks=(1, 5, 10),
                     n_claims: int | None = None, score: str = "confidence") -> DataFrame:
    """EVL-01 / EVL-04 / AGG-07 (MRR) / AGG-08 (Hits@k): Hits@k and MRR for
    positives and for positives+negatives; predictions are ranked here, for
    retrieval models only (EVL-04).

    ``gold`` (input_id, misinfo_id, gold_label); ``preds`` (model_id,
    input_id, misinfo_id, confidence).  Every model in ``models`` (a short,
    fixed list) is evaluated on the full gold set in one pass.

    Predictions are first reduced to the gold posts (semi join), ranked with
    averaged ties (WIN-01), and the ranks of a post's gold claims, which come
    along with the semi join, are kept per (model, post), so the scoring plan
    is read once and no more ranks than annotations are gathered.  Gold rows with labels 0/1 are kept
    (FLT-11).  With ``n_claims`` the predictions are read as a sparse table
    whose missing pairs score 0: such a pair takes the mean rank of the tied
    zero block, ``h + (n_claims - h + 1) / 2`` with h positive scores of the
    post.  Without it unmatched rows count in the Hits denominator and are
    skipped by the MRR mean (Q10).  Hits are percentages, unrounded.
    """
    g = gold.filter(F.col("gold_label").isin(0, 1)).select("input_id", "misinfo_id", "gold_label")
    p = preds.join(g.groupBy("input_id").agg(F.collect_set("misinfo_id").alias("_gold")), "input_id")
    ranked = average_rank(p, by="input_id", score=score)
    wanted = F.when(F.array_contains("_gold", F.col("misinfo_id")), F.struct("misinfo_id", "rank"))
    per_post = ranked.groupBy("model_id", "input_id").agg(
        F.map_from_entries(F.collect_list(wanted)).alias("ranks"),
        F.count_if(F.col(score) > 0).alias("n_pos"))
    e = (g.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model_id"))
          .join(per_post, ["model_id", "input_id"], "left"))
    r = F.try_element_at(F.col("ranks"), F.col("misinfo_id"))
    if n_claims is not None:
        zero = F.coalesce(F.col("n_pos"), F.lit(0)) + (F.lit(n_claims) - F.coalesce(F.col("n_pos"), F.lit(0)) + 1) / 2.0
        r = F.coalesce(r, zero)
    e = e.withColumn("rank", r).withColumn("inv", F.try_divide(F.lit(1.0), F.col("rank")))
    pos = F.col("gold_label") == 0
    aggs = []
    for k in ks:
        aggs.append((100.0 * F.sum(F.when(pos & (F.col("rank") <= k), 1).otherwise(0))
                     / F.sum(F.when(pos, 1).otherwise(0))).alias(f"pos_hits_{k}"))
    aggs.append(F.avg(F.when(pos, F.col("inv"))).alias("pos_mrr"))
    for k in ks:
        aggs.append((100.0 * F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)) / F.count(F.lit(1)))
                    .alias(f"both_hits_{k}"))
    aggs.append(F.avg("inv").alias("both_mrr"))
    return e.groupBy("model_id").agg(*aggs)


def confusion_cells(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """AGG-03 as one row per model with the nine cells ``c{gold}{pred}``.

    Gold ⟕ predictions on (input_id, misinfo_id) (JOIN-02); rows with a NULL
    label on either side are left out of the matrix."""
    e = (gold.select("input_id", "misinfo_id", "gold_label")
             .join(preds.select("model_id", "input_id", "misinfo_id", "label_id"),
                   ["input_id", "misinfo_id"], "inner"))
    cells = [F.sum(F.when((F.col("gold_label") == g) & (F.col("label_id") == p), 1).otherwise(0))
             .cast("bigint").alias(f"c{g}{p}") for g in CLASSES for p in CLASSES]
    return e.groupBy("model_id").agg(*cells)


def confusion_long(cells: DataFrame) -> DataFrame:
    """AGG-03 long form incl. zero cells: (model_id, gold_label, label_id, n)."""
    stack = ", ".join(f"{g}, {p}, c{g}{p}" for g in CLASSES for p in CLASSES)
    return cells.select("model_id", F.expr(f"stack(9, {stack}) AS (gold_label, label_id, n)")) \
        .select("model_id", F.col("gold_label").cast("bigint"), F.col("label_id").cast("bigint"), "n")


def stance_report(cells: DataFrame) -> DataFrame:
    """EVL-02 / AGG-04 (accuracy), AGG-05 (per-class P/R/F1), AGG-06 (macro
    P/R/F1): accuracy, macro P/R/F1 and per-class P/R/F1.

    Per-class values are NULL where the reference yields NaN (0/0, Q11);
    macro averages run over labels present in gold or predictions, an
    undefined value counting 0 (sklearn's zero-division rule).
    """
    c = lambda g, p: F.col(f"c{g}{p}")
    total = sum(c(g, p) for g in CLASSES for p in CLASSES)
    out = [F.col("model_id"), F.try_divide(sum(c(i, i) for i in CLASSES).cast("double"), total).alias("accuracy")]
    names = {0: "pos", 1: "neg", 2: "na"}
    prec, rec, f1, present = {}, {}, {}, {}
    for i in CLASSES:
        col_sum = sum(c(g, i) for g in CLASSES)
        row_sum = sum(c(i, p) for p in CLASSES)
        prec[i] = F.try_divide(c(i, i).cast("double"), col_sum)
        rec[i] = F.try_divide(c(i, i).cast("double"), row_sum)
        f1[i] = F.try_divide(2 * prec[i] * rec[i], prec[i] + rec[i])
        present[i] = F.when((col_sum + row_sum) > 0, 1).otherwise(0)
    n_present = sum(present[i] for i in CLASSES)
    for nm, d in (("precision", prec), ("recall", rec), ("f1", f1)):
        # sklearn macro F1 averages per-class F1 with 0 for undefined
        out.append(F.try_divide(sum(F.coalesce(d[i], F.lit(0.0)) * present[i] for i in CLASSES),
                                n_present).alias(f"macro_{nm}"))
    for i in CLASSES:
        out += [prec[i].alias(f"{names[i]}_precision"), rec[i].alias(f"{names[i]}_recall"),
                f1[i].alias(f"{names[i]}_f1")]
    return cells.select(*out)


def report_line(report: DataFrame, cols: list[str], digits: int = 1) -> DataFrame:
    """EVL-01/02 display form (FN-21, Q12): the metrics of each model
    rounded half-to-even and joined with ' & ' in a fixed order."""
    return report.select("model_id", F.concat_ws(" & ", *[F.bround(F.col(c), digits).cast("string") for c in cols])
                         .alias("line"))
