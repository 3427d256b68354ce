"""A trained stance head as a persisted MLlib pipeline (STN-01, STN-02, STN-10).
Heads trained by distributed sums are in ``gradient`` and ``tanh_net``.

* BoW logistic: per side RegexTokenizer -> uni+bigrams -> CountVectorizer
  (min df 2) -> smooth idf **+1** (the sklearn weighting; MLlib's ``IDF``
  lacks the +1, so the fitted idf vector + 1 becomes an
  ``ElementwiseProduct``) -> L2 ``Normalizer``; both sides assembled;
  multinomial L2 logistic regression with ``regParam = 1 / (C * n_train)``
  (MLlib averages the loss, the reference's solver sums it).

Training data is persisted once (memory and disk) because every optimizer
iteration scans it.
"""

from __future__ import annotations

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer,
                                SQLTransformer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.text import WORD_PATTERN, strip_accents


# Rows per partition for optimizer passes: every iteration ships one dense
# gradient per task, so tiny partitions cost more than they compute.
ROWS_PER_TRAIN_PARTITION = 50_000


def _size_partitions(df: DataFrame, n_rows: int) -> DataFrame:
    """Coalesce (no shuffle) to about ROWS_PER_TRAIN_PARTITION rows per task."""
    want = max(1, -(-n_rows // ROWS_PER_TRAIN_PARTITION))
    return df.coalesce(want) if want < df.rdd.getNumPartitions() else df


class AccentFolder(Transformer, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """FN-04 as a stage, so that cleaning is saved with the model (STN-10): each
    input column without accents as the output column; a null text is empty."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({out: F.coalesce(strip_accents(c), F.lit(""))
                               for c, out in zip(self.getInputCols(), self.getOutputCols())})


def folder(sides) -> AccentFolder:
    return AccentFolder(inputCols=list(sides), outputCols=[f"{s}_clean" for s in sides])


def judge_stance(pairs: DataFrame, model: Transformer) -> DataFrame:
    """UDF-05: any stance model, own or the user's, as a Transformer that adds
    ``prediction`` (class code) and ``probability`` (of the classes, an array
    or a vector): the pairs with ``label_id`` and ``confidence``."""
    scored = model.transform(pairs)
    p = F.col("probability") if scored.schema["probability"].dataType.typeName() == "array" else vector_to_array("probability")
    return scored.select(*pairs.columns, F.col("prediction").cast("bigint").alias("label_id"),
                         F.array_max(p).alias("confidence"))


def vocabulary_size(df: DataFrame, terms: str, min_df: int) -> int:
    """Number of terms in at least ``min_df`` rows: the vectoriser keeps them
    all, whatever its own default size."""
    df_of = df.select(F.explode(F.array_distinct(terms)).alias("t")).groupBy("t").count()
    return max(1, df_of.where(F.col("count") >= min_df).count())


def _term_stages(side: str) -> list:
    """Uni- and bigrams of a cleaned text column."""
    return [
        RegexTokenizer(inputCol=f"{side}_clean", outputCol=f"{side}_uni", pattern=WORD_PATTERN, gaps=False,
                       toLowercase=True, minTokenLength=1),
        NGram(n=2, inputCol=f"{side}_uni", outputCol=f"{side}_bi"),
        SQLTransformer(statement=f"SELECT *, concat({side}_uni, {side}_bi) AS {side}_terms FROM __THIS__"),
    ]


def bow_vocabulary(train: DataFrame, *, sides=("sentence1", "sentence2"), min_df: int = 2) -> DataFrame:
    """STN-01's vocabularies as a table (side, term, df, idf): every term in
    at least ``min_df`` rows, idf = ln((n + 1) / (df + 1)) + 1."""
    data = folder(sides).transform(train)
    n = data.count()
    out = None
    for s in sides:
        terms = PipelineModel(stages=_term_stages(s)).transform(data).select(F.explode(F.array_distinct(f"{s}_terms")).alias("term"))
        one = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df) \
            .select(F.lit(s).alias("side"), "term", "df", (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))
        out = one if out is None else out.unionByName(one)
    return out


def fit_bow_logistic(train: DataFrame, *, sides=("sentence1", "sentence2"), label: str = "label",
                     C: float = 1.0, max_iter: int = 100, min_df: int = 2) -> PipelineModel:
    """STN-01: one ``PipelineModel`` with both vectorisers and the
    classifier (Q33: a single artefact for training and scoring)."""
    data = folder(sides).transform(train).persist(StorageLevel.MEMORY_AND_DISK)
    n = data.count()
    stages, fitted = [], []
    for s in sides:
        terms = _term_stages(s)
        stages += [
            *terms,
            CountVectorizer(inputCol=f"{s}_terms", outputCol=f"{s}_tf", minDF=float(min_df),
                            vocabSize=vocabulary_size(PipelineModel(stages=terms).transform(data), f"{s}_terms", min_df)),
            IDF(inputCol=f"{s}_tf", outputCol=f"{s}_idf0"),
        ]
    vec = Pipeline(stages=stages).fit(data)
    for m in vec.stages:
        fitted.append(m)
        if m.__class__.__name__ == "IDFModel":
            side = m.getInputCol()[: -len("_tf")]
            fitted.append(ElementwiseProduct(scalingVec=Vectors.dense(m.idf.toArray() + 1.0),
                                             inputCol=f"{side}_tf", outputCol=f"{side}_tfidf"))
            fitted.append(Normalizer(p=2.0, inputCol=f"{side}_tfidf", outputCol=f"{side}_vec"))
    fitted.append(VectorAssembler(inputCols=[f"{s}_vec" for s in sides], outputCol="features"))
    feats = PipelineModel(stages=fitted).transform(data).select("features", F.col(label).cast("double").alias("label"))
    feats = feats.persist(StorageLevel.MEMORY_AND_DISK)
    feats.count()  # at the input's width, before the optimiser's coalesce
    lr = LogisticRegression(family="multinomial", regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0,
                            maxIter=max_iter, standardization=False, featuresCol="features", labelCol="label")
    model = lr.fit(_size_partitions(feats, n))
    feats.unpersist()
    data.unpersist()
    return PipelineModel(stages=[folder(sides), *fitted, model])


def accuracy_by_split(scored: DataFrame, split: str = "split", label: str = "label",
                      prediction: str = "prediction") -> DataFrame:
    """STN-09 / AGG-04: accuracy per split, one aggregate."""
    return scored.groupBy(split).agg(F.count(F.lit(1)).alias("n"),
                                     F.avg((F.col(label).cast("double") == F.col(prediction)).cast("double"))
                                     .alias("accuracy"))
