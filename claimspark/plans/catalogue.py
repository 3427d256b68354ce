"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the given tables (or views Spark derives from them) in
full; limits appear only where they are the feature (top-k).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import StreamingQueryException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.functions.misc import ANNOTATION_CODES, NLI_CODES, day_window, json_overlay, label_code, utc_stamp
from claimspark.functions.text import glove_tokens, word_tokens
from claimspark.functions.vectors import pair_features as _pf
from claimspark.operators import claim_index as CI
from claimspark.operators import evaluate as EV
from claimspark.operators import gradient as GR
from claimspark.operators import ingest as IG
from claimspark.operators import mlheads as ML
from claimspark.operators import relational as RL
from claimspark.operators import retrieval as R
from claimspark.operators import stance as ST
from claimspark.operators import tanh_net as TN
from claimspark.operators import training as TR
from claimspark.operators import vector_search as VS
from claimspark.operators.common import broadcast_if, text_bytes
from claimspark.operators.common import top_k as _top_k
from claimspark.plans import fixtures as FX
from claimspark.session import checkpoint_dir, scratch_path
from claimspark.sources import files as SR
from claimspark.sources import sinks as SK
from claimspark.streaming import streams as SM

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- retrieval
@register("tfidf_top5")
def tfidf_top5(spark, sf):
    """Flagship: TF-IDF cosine of every post against every claim, top 5."""
    posts, claims = FX.posts(spark, sf), FX.table(spark, sf, "benchmark")
    top = CI.tfidf_top_k(posts, claims, post_id="input_id", claim_id="item_id", k=5)
    return top.select("input_id", F.col("item_id").alias("misinfo_id"),
                      F.round("score", 6).alias("confidence"), "rank")


@register("bm25_top5")
def bm25_top5(spark, sf):
    """RET-05 + TOP-05: the five best claims per post by BM25."""
    posts, claims = FX.posts(spark, sf), FX.table(spark, sf, "benchmark")
    top = CI.bm25_top_k(posts, claims, post_id="input_id", claim_id="item_id", k=5)
    return top.select("input_id", F.col("item_id").alias("misinfo_id"),
                      F.round("score", 6).alias("confidence"), "rank")


@register("kept_index_batches")
def kept_index_batches(spark, sf):
    """RET-06: two batches of posts, by language, against a claim index that
    the first one writes and the second one reads."""
    claims, posts = FX.table(spark, sf, "benchmark"), FX.posts(spark, sf)
    folder = scratch_path(spark, "claim-index")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    parts = [CI.tfidf_top_k(posts.where(c), claims, post_id="input_id", claim_id="item_id", k=5, folder=folder)
             for c in (english, ~english)]
    return parts[0].unionByName(parts[1]).select("input_id", F.col("item_id").alias("misinfo_id"),
                                                 F.round("score", 6).alias("confidence"), "rank")


@register("tfidf_scores")
def tfidf_scores(spark, sf):
    """RET-08 batch scoring record for every scored pair (others are 0)."""
    posts, claims = FX.posts(spark, sf), FX.table(spark, sf, "benchmark")
    s = R.tfidf_cosine(posts, claims, post_id="input_id", claim_id="item_id", text="text")
    out = R.with_batch_columns(s, post_id="input_id", claim_id="item_id", model_id="bow-cosine")
    return out.withColumn("confidence", F.round("confidence", 6))


@register("bm25_zero_filled")
def bm25_zero_filled(spark, sf):
    """RET-05 + TOP-05 + JOIN-11: 86 best BM25 claims per post, zero-filled."""
    posts, claims = FX.posts(spark, sf), FX.table(spark, sf, "benchmark")
    s = CI.bm25_top_k(posts, claims, post_id="input_id", claim_id="item_id", k=86).drop("rank")
    z = R.zero_fill_top_k(s, posts, claims, post_id="input_id", claim_id="item_id", k=86)
    return z.select("input_id", F.col("item_id").alias("misinfo_id"),
                    F.round("score", 6).alias("confidence"), "rank")


# --------------------------------------------------------------- evaluation

RETRIEVAL_FIXTURE_MODELS = ["bow-cosine", "pyserini"]


def _round_doubles(df, digits: int = 6):
    """Report form: every double column rounded (raw values stay available
    from the library functions)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double"
                       else F.col(f.name) for f in df.schema.fields])


@register("avg_rank_ties")
def avg_rank_ties(spark, sf):
    """WIN-01 on scores rounded to hundredths (many ties)."""
    p = FX.retrieval_preds(spark, sf).withColumn("confidence", F.round("confidence", 2))
    return EV.average_rank(p, by="input_id", score="confidence") \
        .select("model_id", "input_id", "misinfo_id", "confidence", "rank")


@register("retrieval_report")
def retrieval_report(spark, sf):
    """EVL-01/03/04: Hits@1/5/10 and MRR of TF-IDF and BM25 against the
    annotator's gold pairs; pairs a model did not score rank in the zero block.
    Only annotated posts are scored (the semi join runs before tokenising)."""
    p = FX.retrieval_preds(spark, sf, only_posts=FX.gold_posts(spark, sf))
    n = FX.n_rows(spark, sf, "benchmark")
    return _round_doubles(EV.retrieval_report(FX.gold(spark, sf), p, RETRIEVAL_FIXTURE_MODELS, n_claims=n))


@register("confusion_matrix")
def confusion_matrix(spark, sf):
    """AGG-03: 3x3 gold x predicted counts per stance model, zero cells kept."""
    cells = EV.confusion_cells(FX.gold(spark, sf), FX.stance_preds(spark, sf))
    return EV.confusion_long(cells)


@register("stance_report")
def stance_report(spark, sf):
    """EVL-02 / AGG-04..06 per stance model."""
    return _round_doubles(EV.stance_report(EV.confusion_cells(FX.gold(spark, sf), FX.stance_preds(spark, sf))))


# ------------------------------------------------------------ dense models


@register("wordvec_cosine_top5")
def wordvec_cosine_top5(spark, sf):
    """RET-02: averaged word vectors (FN-01 tokens), cosine, top 5 claims."""
    wv, key = FX.word_vectors(spark, sf)
    vocab = VS.load_vocab(wv)
    pm = VS.wordvec_average(FX.posts(spark, sf), wv, id_col="input_id", tokenizer=glove_tokens, word_key=key, vocab=vocab)
    cm = VS.wordvec_average(FX.table(spark, sf, "benchmark"), wv, id_col="item_id", tokenizer=glove_tokens,
                            word_key=key, vocab=vocab)
    top = VS.cosine_top_k(pm, cm, q_id="input_id", c_id="item_id", k=5)
    return top.select("input_id", F.col("item_id").alias("misinfo_id"),
                      F.round("score", 6).alias("confidence"), "rank")


@register("embedding_cosine_top5")
def embedding_cosine_top5(spark, sf):
    """RET-03: each embedding's 5 most cosine-similar other embeddings."""
    e = FX.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    top = VS.cosine_top_k(e, e.withColumnRenamed("vec_id", "neighbor_id"), q_id="vec_id",
                          c_id="neighbor_id", k=5, exclude_self=True)
    return top.select("vec_id", "neighbor_id", F.round("score", 6).alias("score"), "rank")


@register("user_scorer_top5")
def user_scorer_top5(spark, sf):
    """UDF-02: the search with a scorer of the caller's, here the negative L1
    distance; the stated query set, ids divisible by 50, against all rows."""
    def negative_l1(q, c):
        return np.stack([-np.abs(c - row).sum(axis=1) for row in q])

    e = FX.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    top = VS.cosine_top_k(e.where("vec_id % 50 = 0"), e.withColumnRenamed("vec_id", "neighbor_id"), q_id="vec_id",
                          c_id="neighbor_id", k=5, exclude_self=True, scorer=negative_l1)
    return top.select("vec_id", "neighbor_id", F.round("score", 6).alias("score"), "rank")


@register("token_softmatch_prf")
def token_softmatch_prf(spark, sf):
    """RET-04: soft precision / recall / F1 of whole posts against whole
    claims with word-vector tokens; best 5 claims per post by F1."""
    wv, key = FX.word_vectors(spark, sf)
    top = VS.token_softmatch_top_k(FX.posts(spark, sf), FX.table(spark, sf, "benchmark"), wv,
                                   post_id="input_id", claim_id="item_id", k=5, word_key=key)
    return top.select("input_id", F.col("item_id").alias("misinfo_id"),
                      F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                      F.round("f1", 6).alias("f1"), "rank")


# ------------------------------------------------------------------ stance

STANCE_DIM_PARTS = ("u", "v", "absdiff")


def _stance_fn(spark, sf, parts=STANCE_DIM_PARTS, posts=None):
    pv, cv = FX.sentence_vectors(spark, sf, only_posts=posts)
    d = 64 * len(parts)
    w, b = ST.rule_weights(3, d)
    n = FX.n_rows(spark, sf, "benchmark")

    def fn(pairs):
        return ST.linear_softmax(ST.attach_vectors(pairs, pv, cv, n_claims=n), w, b, parts=parts)
    return fn


def _probs_cols(df):
    return [F.round(F.col("probs")[i], 6).alias(f"p{i}") for i in range(3)]


@register("linear_softmax_head")
def linear_softmax_head(spark, sf):
    """STN-04 / STN-08: [u, v, |u-v|] -> linear -> softmax for each post's
    best claim."""
    out = _stance_fn(spark, sf)(FX.tfidf_best(spark, sf))
    return out.select("input_id", "misinfo_id", F.col("label_id").cast("bigint"),
                      F.round("confidence", 6).alias("confidence"), *_probs_cols(out))


@register("softmax_stance_report")
def softmax_stance_report(spark, sf):
    """EVL-02 / EVL-05 of a real model: the softmax head reads every annotated
    pair, and its confusion cells give accuracy and P/R/F1.  Only annotated
    posts are encoded."""
    g = FX.gold(spark, sf)
    head = _stance_fn(spark, sf, posts=g.select("input_id").distinct())
    preds = head(g.select("input_id", "misinfo_id")).withColumn("model_id", F.lit("linear-softmax"))
    return _round_doubles(EV.stance_report(EV.confusion_cells(g, preds)))


@register("pair_features")
def pair_features(spark, sf):
    """FN-18 with the element-wise product: summary of [u, v, |u-v|, u*v]."""
    pv, cv = FX.sentence_vectors(spark, sf)
    pairs = ST.attach_vectors(FX.tfidf_best(spark, sf), pv, cv)
    x = _pf("u", "v", ("u", "v", "absdiff", "prod"))
    return pairs.select("input_id", "misinfo_id", F.size(x).cast("bigint").alias("n_features"),
                        F.round(F.aggregate(x, F.lit(0.0), lambda a, y: a + y), 6).alias("feature_sum"),
                        F.round(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y)), 6).alias("feature_norm"))


@register("cross_entropy")
def cross_entropy(spark, sf):
    """AGG-15: mean cross-entropy of the head's logits against gold labels.
    Only annotated posts can contribute, so only they are scored and encoded
    (the semi join runs before any text is tokenised)."""
    g = FX.gold(spark, sf).select("input_id", "misinfo_id", "gold_label")
    posts = FX.posts(spark, sf).join(g.select("input_id").distinct(), "input_id", "left_semi")
    index, cv, wv, key, vocab = claim_side(spark, sf, persist=False)
    best = CI.best_claims(posts, index, post_id="input_id", k=1).drop("rank")
    pv = VS.wordvec_average(posts, wv, id_col="input_id", tokenizer=glove_tokens, word_key=key, vocab=vocab)
    w, b = ST.rule_weights(3, 64 * len(STANCE_DIM_PARTS))
    out = ST.linear_softmax(ST.attach_vectors(best, pv, cv, n_claims=index.n), w, b, parts=STANCE_DIM_PARTS)
    e = out.join(g, ["input_id", "misinfo_id"])
    l = F.col("logits")
    m = F.array_max(l)
    lse = m + F.log(F.aggregate(F.transform(l, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, y: a + y))
    return e.agg(F.count(F.lit(1)).alias("n_pairs"),
                 F.round(F.avg(lse - F.get(l, F.col("gold_label").cast("int"))), 6).alias("mean_loss"))


@register("triplet_margin_loss")
def triplet_margin_loss(spark, sf):
    """AGG-16: triplets (a, a+1, a+2 mod n) of embeddings; margin 1, L2
    distance with eps 1e-6 added to the difference."""
    e = FX.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    n = FX.n_rows(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("v").alias("a"),
                 ((F.col("vec_id") + 1) % n).alias("p_id"), ((F.col("vec_id") + 2) % n).alias("n_id"))
    t = (a.join(e.select(F.col("vec_id").alias("p_id"), F.col("v").alias("p")), "p_id")
          .join(e.select(F.col("vec_id").alias("n_id"), F.col("v").alias("nv")), "n_id"))

    def dist(x, y):
        d = F.zip_with(x, y, lambda s, t: (s.cast("double") - t.cast("double") + 1e-6) ** 2)
        return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, z: acc + z))
    loss = F.greatest(F.lit(0.0), dist("a", "p") - dist("a", "nv") + 1.0)
    return t.agg(F.count(F.lit(1)).alias("n_triplets"), F.round(F.avg(loss), 6).alias("mean_loss"))


@register("two_stage_label")
def two_stage_label(spark, sf):
    """STN-06: relevance by TF-IDF >= 0.4, stance only for relevant pairs."""
    pv, cv = FX.sentence_vectors(spark, sf)
    w, b = ST.rule_weights(3, 64 * len(STANCE_DIM_PARTS))
    out = ST.two_stage(FX.tfidf_scores(spark, sf), pv, cv,
                       lambda j: ST.linear_softmax(j, w, b, parts=STANCE_DIM_PARTS),
                       n_claims=FX.n_rows(spark, sf, "benchmark"))
    return out.select("input_id", "misinfo_id", F.col("label_id").cast("bigint"),
                      F.round("score", 6).alias("confidence"))


def agree_disagree_for(spark, sf, posts, static=None):
    """STN-07 for any set of posts (a table or one micro-batch): best
    TF-IDF claim, threshold 0.4, [u, v, |u-v|] head, forced binary stance.
    ``static`` = the result of :func:`claim_side`, built once for a stream.
    Irrelevant posts keep their best claim for reference and take the n/a
    class code (2); the stance word is given for relevant posts only."""
    index, cv, wv, key, vocab = static or claim_side(spark, sf, persist=False)
    # one row per post, written to the shared checkpoint folder: the stance
    # encoder then reads only the posts that passed the threshold
    checkpoint_dir(spark)
    best = CI.best_claims(posts, index, post_id="input_id", k=1).drop("rank").checkpoint(eager=True)
    relevant_ids = best.filter(ST.relevance(best, "score")).select("input_id")
    pv = VS.wordvec_average(posts.join(relevant_ids, "input_id", "left_semi"), wv, id_col="input_id",
                            tokenizer=glove_tokens, word_key=key, vocab=vocab)
    w, b = ST.rule_weights(3, 64 * len(STANCE_DIM_PARTS))
    out = ST.agree_disagree(best, pv, cv, lambda j: ST.linear_softmax(j, w, b, parts=STANCE_DIM_PARTS),
                            n_claims=index.n)
    return out.select("input_id", "misinfo_id", "relevant",
                      F.coalesce(F.col("label_id"), F.lit(2)).cast("bigint").alias("label_id"), "label")


def claim_side(spark, sf, persist: bool):
    """Static side of the stance pipeline: TF-IDF index, claim vectors
    (RET-06), word vectors with their key and broadcast, optionally cached for
    the lifetime of a stream."""
    claims = FX.table(spark, sf, "benchmark").withColumnRenamed("item_id", "misinfo_id")
    index = CI.prepare(claims, claim_id="misinfo_id")
    wv, key = FX.word_vectors(spark, sf)
    vocab = VS.load_vocab(wv)
    cv = VS.wordvec_average(claims, wv, id_col="misinfo_id", tokenizer=glove_tokens, word_key=key, vocab=vocab)
    return index, (cv.cache() if persist else cv), wv, key, vocab


@register("pipeline_agree_disagree")
def pipeline_agree_disagree(spark, sf):
    """STN-07: best claim per post, threshold 0.4, forced agree/disagree."""
    return agree_disagree_for(spark, sf, FX.posts(spark, sf))


# ------------------------------------------------------------ store / ingest

_TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _pairs(spark, sf):
    return RL.input_output_pairs(FX.io_inputs(spark, sf), FX.io_outputs(spark, sf))


@register("input_output_pairs")
def input_output_pairs(spark, sf):
    """JOIN-01."""
    return _pairs(spark, sf).select("input_id", "output_id", "input_source_type",
                                    F.round("confidence", 6).alias("confidence"),
                                    F.date_format("date", _TS_FMT).alias("date"))


@register("pairs_by_date")
def pairs_by_date(spark, sf):
    """FLT-06: pairs in [1995-01-01, 1996-01-01)."""
    p = RL.pairs_by_date(_pairs(spark, sf), "1995-01-01", "1996-01-01")
    return p.select("input_id", "output_id", F.date_format("date", _TS_FMT).alias("date"))


@register("pairs_by_date_bounds")
def pairs_by_date_bounds(spark, sf):
    """FLT-06 bound variants (from only, until only, both, none) counted in
    one pass over the pairs: each variant is a conditional count."""
    variants = [("from", "1995-01-01", None), ("until", None, "1996-01-01"),
                ("both", "1995-01-01", "1996-01-01"), ("none", None, None)]
    p = _pairs(spark, sf)
    aggs = [F.count_if(RL.date_condition(a, b)).alias(name) for name, a, b in variants]
    stack = ", ".join(f"'{name}', `{name}`" for name, _, _ in variants)
    return p.agg(*aggs).select(F.expr(f"stack({len(variants)}, {stack}) AS (variant, n_pairs)"))


@register("recent_k_pairs")
def recent_k_pairs(spark, sf):
    """TOP-03: the 10 newest pairs by output id."""
    return RL.recent_pairs(_pairs(spark, sf), 10).select("input_id", "output_id")


@register("outputs_by_model_input_misinfo")
def outputs_by_model_input_misinfo(spark, sf):
    """FLT-07: outputs of model 'R' (the filter reaches the Parquet scan)."""
    o = RL.outputs_filter(FX.li_outputs(spark, sf), model="R")
    return o.select(F.col("id").alias("output_id"), "input_id", "misinfo_id", "label_id",
                    F.round("confidence", 6).alias("confidence"))


@register("inputs_by_source")
def inputs_by_source(spark, sf):
    """FLT-03: posts of source 'src3'."""
    return RL.by_source(FX.posts(spark, sf), "src3").select("input_id", "source_id")


@register("claims_by_source")
def claims_by_source(spark, sf):
    """FLT-04 over the claim table built by PRJ-03."""
    rows = IG.claims_to_rows(FX.claims(spark, sf).withColumn("origin", F.get(F.col("sources"), 0)), keep_id=True)
    return RL.by_source(rows, "src1", col="source").select("id", "text", "source")


@register("insert_if_new")
def insert_if_new(spark, sf):
    """ING-01: incoming event keys not yet stored, first per key, new ids."""
    new, _ = IG.insert_if_new(FX.incoming_inputs(spark, sf), FX.stored_inputs(spark, sf),
                              key=["source_id"], order="event_id")
    return new.select("id", "source_id", "event_id")


@register("insert_counts")
def insert_counts(spark, sf):
    """ING-02 / AGG-18: given vs inserted rows and the success flag."""
    _, counts = IG.insert_if_new(FX.incoming_inputs(spark, sf), FX.stored_inputs(spark, sf),
                                 key=["source_id"], order="event_id", id_col=None)
    return counts


@register("annotation_csv_load")
def annotation_csv_load(spark, sf):
    """ING-03: inputs (deduplicated by tweet id, ids generated), then every
    annotation row as an output joined to its input id (JOIN-03)."""
    raw = FX.annotation_rows(spark, sf)
    rows = raw.filter((F.length("label") > 0) & (F.length("tweet_id") > 0))
    inputs, _ = IG.insert_if_new(IG.reshape(raw, "old_csv_format"),
                                 spark.createDataFrame([], "source_id string, id bigint"),
                                 key=["source_id"], order="doc_id")
    ids = inputs.select(F.col("source_id").alias("tweet_id"), F.col("id").alias("input_id"))
    return (rows.join(ids, "tweet_id")
                .select("input_id", F.col("misconception_id").alias("misinfo_id"),
                        label_code("label", ANNOTATION_CODES, 2).cast("bigint").alias("label_id"),
                        F.lit(1.0).alias("confidence"), F.lit("human").alias("model_id")))


@register("annotation_outputs_insert")
def annotation_outputs_insert(spark, sf):
    """ING-03: an annotation file loaded in two passes, inputs and then
    outputs, and loaded again when it has grown: only new rows are added."""
    raw = FX.annotation_rows(spark, sf)
    base = scratch_path(spark, "annotations")
    inputs = spark.createDataFrame([], "source_id string, id bigint")
    outputs = spark.createDataFrame([], "input_id bigint, model_id string, misinfo_id bigint, id bigint")
    code = label_code("label", ANNOTATION_CODES, 2)
    for load, rows in enumerate((raw.where("doc_id % 2 = 0"), raw)):
        for name, new in zip(("input", "output"), IG.load_annotations(rows, inputs, outputs, code)):
            new.withColumn("load", F.lit(load)).write.mode("append").parquet(f"{base}/{name}")
        inputs, outputs = (spark.read.parquet(f"{base}/{n}") for n in ("input", "output"))
    return outputs.select("load", "id", "input_id", "misinfo_id", "label_id", "model_id")


@register("claims_to_table")
def claims_to_table(spark, sf):
    """PRJ-03 / ING-04: claim records -> misinformation rows keyed by text."""
    rows = IG.claims_to_rows(FX.claims(spark, sf), keep_id=True)
    new, _ = IG.insert_if_new(rows, spark.createDataFrame([], "text string"), key=["text"], order="id",
                              id_col=None)
    return new.select("id", "text", "url", "source", "reliability", "misc")


MINIMAL_TREE = {"id": True, "created_at": True, "lang": True, "user": {"id_str": True}, "props": {"k": True}}
DEFAULTS_TEMPLATE = {"id": -1, "lang": "und", "user": {"id_str": "", "followers_count": 0.0},
                     "props": {"k": 0, "note": "n/a"}}


def _flat(df):
    return df.select("id", *[c for c in df.columns if c != "id"])


@register("minimize_json")
def minimize_json(spark, sf):
    """PRJ-01 + FLT-01 (lang 'en') + FLT-02 (no retweets)."""
    t = FX.tweets(spark, sf).filter((F.col("lang") == "en") & F.col("retweeted_status").isNull())
    m = t.select(*IG.project_tree(t, MINIMAL_TREE))
    return m.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), "lang",
                    F.col("user.id_str").alias("user_id_str"), F.col("props.k").cast("bigint").alias("props_k"))


@register("minimize_json_defaults")
def minimize_json_defaults(spark, sf):
    """PRJ-02: template projection; absent / NULL leaves take the template value."""
    t = FX.tweets(spark, sf)
    m = t.select(*IG.project_with_defaults(DEFAULTS_TEMPLATE))
    return m.select("id", "lang", F.col("user.id_str").alias("user_id_str"),
                    F.round("user.followers_count", 6).alias("user_followers_count"),
                    F.col("props.k").cast("bigint").alias("props_k"), F.col("props.note").alias("props_note"))


@register("unique_counts")
def unique_counts(spark, sf):
    """AGG-01: rows, distinct ids, texts and users (sources) of the posts.
    Distinct texts are counted on their 128-bit md5 digests (16 bytes per row
    through the shuffle instead of the whole text; a collision among 10^12
    texts has probability ~1e-15)."""
    d = FX.table(spark, sf, "documents")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_ids"),
                 F.count_distinct(F.unhex(F.md5("text"))).alias("n_texts"),
                 F.count_distinct("source").alias("n_users"))


KEYWORDS_ANY = ["the", "with"]
KEYWORDS_ALL = ["and"]
DENY_HOST_SUFFIX = ".example.org"


@register("keyword_domain_filter")
def keyword_domain_filter(spark, sf):
    """FLT-13 + TOP-07: keyword groups (any / all), language, host deny
    list, date range; newest first, first page of 100."""
    a = FX.articles(spark, sf)
    toks = F.regexp_extract_all(F.lower(F.col("html")), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    f = RL.keyword_filter(a, tokens=toks, any_of=KEYWORDS_ANY, all_of=KEYWORDS_ALL, lang="en",
                          deny_hosts=[DENY_HOST_SUFFIX], date_col="publishedAt",
                          from_date="2024-01-03", until_date="2024-01-28")
    return RL.page(f, [F.col("publishedAt").desc(), F.col("page_id").asc()], 100, 0) \
        .select("page_id", "host", "publishedAt")


@register("crawl_queries")
def crawl_queries(spark, sf):
    """FLT-13: a crawl query per claim (any of its first three words, all of
    the next two, the sixth as a phrase) against every page at once."""
    word = F.lit(r"[\p{L}\p{N}_]{2,}")
    w = F.regexp_extract_all(F.lower("text"), word, 0)
    q = FX.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), w.alias("w")).where("size(w) > 0").select(
        "query_id", F.slice("w", 1, 3).alias("any_of"), F.slice("w", 4, 2).alias("all_of"), F.slice("w", 6, 1).alias("phrases"))
    a = FX.articles(spark, sf)
    return RL.match_queries(a, q, tokens=F.regexp_extract_all(F.lower("html"), word, 0), id_col="page_id", text="html")


@register("article_dedup")
def article_dedup(spark, sf):
    """ING-06 / JOIN-07: batch articles (events after the split day) new by
    (category, url) against the stored ones."""
    e = FX.table(spark, sf, "events").select(
        F.col("event_type").alias("category"), F.concat(F.lit("https://news.example/"), F.col("user_id").cast("string")).alias("url"),
        F.col("event_id").alias("seq"), "ts")
    split = F.to_timestamp(F.lit(FX.SPLIT_TS))
    new = IG.dedup_articles(e.filter(F.col("ts") >= split).drop("ts"), e.filter(F.col("ts") < split))
    return new.select("category", "url", "seq")


FIXED_INSTANT = "2024-02-01 12:34:56"


@register("article_rows")
def article_rows(spark, sf):
    """PRJ-06 + FLT-12 + FN-24: {url, title, publishedAt or ''} of error-free
    articles, stamped with a fixed crawl instant."""
    a = FX.articles(spark, sf).filter(F.col("errorCode").isNull())
    return a.select("url", "title", F.coalesce("publishedAt", F.lit("")).alias("publishedAt"),
                    utc_stamp(F.to_timestamp(F.lit(FIXED_INSTANT))).alias("addedAt"))


@register("default_day_window")
def default_day_window(spark, sf):
    """FLT-15 / FN-25: one bound given -> the other is one day away; both
    variants tagged in one scan."""
    e = FX.table(spark, sf, "events")
    tags, conds = [], []
    for name, since, until in (("since", "2024-01-05", None), ("until", None, "2024-01-20")):
        lo, hi = day_window(since, until)
        c = (F.col("ts") >= lo.cast("timestamp")) & (F.col("ts") < hi.cast("timestamp"))
        conds.append(c)
        tags.append(F.when(c, F.lit(name)))
    # the OR of the windows reaches the Parquet reader (row groups outside are skipped)
    any_window = conds[0] | conds[1]
    return e.filter(any_window).select(F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull())).alias("variant"),
                                       "event_id")


@register("request_batches")
def request_batches(spark, sf):
    """ING-08 / WIN-04 / FN-26: post ids in request batches of 100."""
    return IG.request_batches(FX.table(spark, sf, "documents"), "doc_id", 100)


@register("pending_files")
def pending_files(spark, sf):
    """JOIN-12 / SET-05 / FN-27: input files (page paths) without a
    processed output of the same stem in either output extension."""
    from claimspark.functions.misc import path_stem
    from claimspark.functions.text import hash_mod
    p = FX.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.lit(".jsonl")).alias("path"), "url")
    done_a = p.filter(hash_mod("url", 3) == 0).select(F.concat(F.lit("out/"), path_stem("path"), F.lit(".jsonl")).alias("out"))
    done_b = p.filter(hash_mod("url", 3) == 1).select(F.concat(F.lit("out/"), path_stem("path"), F.lit(".jsonl.gz")).alias("out"))
    return IG.pending_inputs(p.select("path"), done_a.unionByName(done_b)).select("path", "stem")


@register("latest_months")
def latest_months(spark, sf):
    """WIN-05: orders of the newest three order months."""
    o = FX.table(spark, sf, "orders")
    r = IG.newest_groups(o, F.date_format("o_orderdate", "yyyy-MM"), 3, "month")
    return r.select("o_orderkey", "month")


@register("html_cards_to_claims")
def html_cards_to_claims(spark, sf):
    """PRJ-07 / TRN-07: fact-check cards -> claim records."""
    return IG.html_cards(FX.card_pages(spark, sf))


@register("variant_columns_wide")
def variant_columns_wide(spark, sf):
    """PRJ-05 / SNK-07 rows: 5 sources, 5 positive and 5 negative variations
    and the first category as fixed columns."""
    c = FX.claims(spark, sf)
    return c.select("id", *IG.fixed_columns("sources", 5, "source_"), *IG.fixed_columns("pos_variations", 5, "pos_"),
                    *IG.fixed_columns("neg_variations", 5, "neg_"),
                    F.coalesce(F.get(F.col("category"), 0), F.lit("")).alias("category"))


@register("dataset_digest")
def dataset_digest(spark, sf):
    """AGG-17: ordered digest of all claim variation lines."""
    lines = FX.claims(spark, sf).select("id", F.posexplode("pos_variations").alias("var_idx", "line"))
    return IG.ordered_digest(lines, ["id", "var_idx"], "line", bucket_rows=16)


@register("config_overlay")
def config_overlay(spark, sf):
    """FN-28 / FLT-14 / ING-05: nation defaults overlaid by values derived
    from customers (blank overrides dropped, new keys added)."""
    n = FX.table(spark, sf, "nation")
    defaults = n.select(F.col("n_nationkey").alias("entity"),
                        F.explode(F.create_map(F.lit("name"), F.col("n_name"),
                                               F.lit("region"), F.col("n_regionkey").cast("string"),
                                               F.lit("status"), F.lit("active"))).alias("key", "value"))
    c = FX.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("entity")).agg(
        F.max(F.when(F.col("c_acctbal") < 0, F.lit("in-debt")).otherwise(F.lit(""))).alias("status"),
        F.max("c_mktsegment").alias("segment"))
    overrides = c.select("entity", F.explode(F.create_map(F.lit("status"), F.col("status"),
                                                          F.lit("segment"), F.col("segment"))).alias("key", "value"))
    return IG.overlay(defaults, overrides).select(F.col("entity").cast("bigint"), "key", "value")


@register("nested_overlay")
def nested_overlay(spark, sf):
    """FN-28: each customer's settings, JSON of three levels, over those of
    the nation."""
    n = FX.table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(
        F.col("n_name").alias("name"), F.struct(
            F.struct(F.lit(0).alias("min"), F.lit(9999).alias("max")).alias("balance"),
            F.lit("plain").alias("tier")).alias("limits"))).alias("base"))
    c = FX.table(spark, sf, "customer")
    debt = F.to_json(F.struct(F.struct(F.struct(F.floor("c_acctbal").alias("min")).alias("balance")).alias("limits"),
                              F.struct(F.lit(True).alias("debt")).alias("flags")))
    plain = F.to_json(F.struct(F.struct(F.col("c_mktsegment").alias("tier")).alias("limits")))
    both = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", json_overlay("base", F.when(F.col("c_acctbal") < 0, debt).otherwise(plain)).alias("m"))
    at = lambda path: F.get_json_object("m", path)
    return both.select(F.col("c_custkey").cast("bigint"), at("$.name").alias("name"),
                       at("$.limits.balance.min").cast("bigint").alias("balance_min"),
                       at("$.limits.balance.max").cast("bigint").alias("balance_max"),
                       at("$.limits.tier").alias("tier"), at("$.flags.debt").alias("debt"))


# ------------------------------------------------- variations / readable


@register("topk_posts_per_claim")
def topk_posts_per_claim(spark, sf):
    """RET-09 / TOP-02: for every claim variation the 5 posts with the best
    soft-match F1 (ties: post text descending, then id)."""
    var = FX.variations(spark, sf)
    wv, key = FX.word_vectors(spark, sf)
    posts = FX.posts(spark, sf)
    few = VS.first_copies(posts, "input_id", "text", 5)
    cand = VS.token_softmatch_top_k(few, var, wv, post_id="input_id", claim_id="vid",
                                    claim_text="line", per="claim", k=5, word_key=key)
    # the tie rule needs the text of the (few) candidates only: broadcast them
    # (size-checked) against the posts, which are then read without a shuffle
    checkpoint_dir(spark)
    # every task gives candidates: those beyond the k-th score go before the
    # posts are read again, ties at it stay
    best = F.round(F.coalesce("f1", F.lit(float("-inf"))), 9).desc()
    place = F.rank().over(Window.partitionBy("vid").orderBy(best))
    cand = cand.withColumn("_r", place).where("_r <= 5").drop("_r").checkpoint(eager=True)
    cand = posts.select("input_id", F.col("text").alias("tweet")).join(broadcast_if(cand, cand.count()), "input_id")
    top = _top_k(cand, "vid", [best, F.col("tweet").desc(), F.col("input_id").asc()], 5)
    return (top.join(var, "vid")
               .select(F.col("item_id").alias("id"), "var_idx", F.col("line").alias("pos_variation"),
                       "input_id", "tweet", F.round("f1", 6).alias("score"), "rank"))


@register("topk_csv_roundtrip")
def topk_csv_roundtrip(spark, sf):
    """SNK-03: the top posts per claim variation as the result CSV (id,
    pos_variation, tweet, score), read back."""
    base = scratch_path(spark, "topkcsv")
    SK.write_csv(topk_posts_per_claim(spark, sf).select("id", "pos_variation", "tweet", "score"), base)
    r = spark.read.schema("id long, pos_variation string, tweet string, score double") \
        .option("header", "true").option("multiLine", "true").option("escape", '"').csv(base)
    return r.select("id", F.md5("pos_variation").alias("variation_md5"), F.md5("tweet").alias("tweet_md5"), "score")


@register("first_variation_best")
def first_variation_best(spark, sf):
    """RET-10, first-variation form: each claim stands for its first
    variation; best claim per post by TF-IDF."""
    first = R.explode_variations(FX.claims(spark, sf), id_col="id", first_only=True) \
        .select(F.col("id").alias("item_id"), F.col("variation").alias("line"))
    best = CI.tfidf_top_k(FX.posts(spark, sf), first, post_id="input_id", claim_id="item_id", k=1, claim_text="line")
    return best.select("input_id", F.col("item_id").alias("misinfo_id"), F.lit(0).cast("bigint").alias("var_idx"),
                       F.round("score", 6).alias("confidence"))


@register("best_variation_per_claim")
def best_variation_per_claim(spark, sf):
    """RET-10 + TOP-04: TF-IDF of every post against every variation; a
    claim scores its best variation; the best claim per post (max_by)."""
    var = FX.variations(spark, sf)
    # variations are numbered by (claim, variation), so ties fall as they should
    best = CI.tfidf_top_k(FX.posts(spark, sf), var, post_id="input_id", claim_id="vid", k=1, claim_text="line")
    best = best.join(broadcast_if(var.select("vid", "item_id", "var_idx"), var.count()), "vid")
    return best.select("input_id", F.col("item_id").alias("misinfo_id"), "var_idx",
                       F.round("score", 6).alias("confidence"))


@register("readable_predictions")
def readable_predictions(spark, sf):
    """RET-07 / PRJ-08: per post {input, relevant, predictions[{score,
    claim}]} (top 5 by TF-IDF), exploded back to rows."""
    top = FX.tfidf_best(spark, sf, 5)
    cl = FX.table(spark, sf, "benchmark").select(F.col("item_id").alias("misinfo_id"), F.col("text").alias("claim"))
    nested = (top.join(broadcast_if(cl, *text_bytes(cl, "claim")), "misinfo_id")
                 .groupBy("input_id")
                 .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("score").alias("misinformation_score"),
                                                           "misinfo_id", "claim"))).alias("predictions"))
                 .withColumn("relevant", F.col("predictions")[0]["misinformation_score"] >= 0.4))
    return nested.select("input_id", "relevant", F.inline("predictions")) \
        .select("input_id", "relevant", "rank", "misinfo_id",
                F.round("misinformation_score", 6).alias("misinformation_score"), "claim")


# ---------------------------------------------------------- training sets


def _sets_str(col):
    return F.array_join(F.transform(col, lambda s: F.array_join(s.cast("array<string>"), ",")), ";")


@register("fever_convert")
def fever_convert(spark, sf):
    """TRN-01: FEVER claims + wiki pages -> sentences and evidence indices."""
    c = TR.fever_convert(FX.fever_claims(spark, sf), FX.wiki(spark, sf))
    return c.select("id", "claim", "label", F.size("sentences").cast("bigint").alias("n_sentences"),
                    F.md5(F.array_join("sentences", "\n")).alias("sentences_md5"),
                    _sets_str(F.col("evidence_sets")).alias("evidence_sets"))


@register("fever_examples")
def fever_examples(spark, sf):
    """TRN-02: training pairs from the converted FEVER set (seeded samples)."""
    c = TR.fever_convert(FX.fever_claims(spark, sf), FX.wiki(spark, sf))
    e = TR.fever_examples(c, seed="fever", neg_sample=True)
    return e.select("id", "kind", F.col("set_idx").cast("bigint"), "rationale", F.col("label").cast("bigint"))


@register("scifact_examples")
def scifact_examples(spark, sf):
    """TRN-03: SciFact training pairs."""
    corpus, claims = FX.scifact(spark, sf)
    e = TR.scifact_examples(corpus, claims, seed="scifact")
    return e.select("claim_id", "doc_id", "kind", F.col("set_idx").cast("bigint"), "rationale",
                    F.col("label").cast("bigint"))


@register("nli_examples")
def nli_examples(spark, sf):
    """TRN-04: NLI pairs with the three gold labels, coded."""
    e = TR.nli_examples(FX.nli_pairs(spark, sf), NLI_CODES)
    return e.select("conv_id", "turn", "sentence1", "sentence2", "label")


@register("batch_mean_accuracy")
def batch_mean_accuracy(spark, sf):
    """AGG-14: exact accuracy vs the mean of per-batch accuracies (batches
    of 32 examples in (conv_id, turn) order) of a simulated predictor."""
    e = TR.nli_examples(FX.nli_pairs(spark, sf), NLI_CODES)
    e = e.withColumn("correct", ((FX._h(F.col("conv_id"), F.col("turn"), "p") % 3) == F.col("label")).cast("double"))
    pos = IG.dense_ids(e.select("conv_id", "turn", "correct"), ["conv_id", "turn"], 0, "pos")
    b = pos.groupBy(F.floor((F.col("pos") - 1) / 32).alias("batch")).agg(
        F.avg("correct").alias("acc"), F.count(F.lit(1)).alias("n"))
    return b.agg(F.sum("n").cast("bigint").alias("n_examples"), F.count(F.lit(1)).alias("n_batches"),
                 F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 6).alias("exact_accuracy"),
                 F.round(F.avg("acc"), 6).alias("batch_mean_accuracy"))


@register("retriever_training_set")
def retriever_training_set(spark, sf):
    """TRN-05: per source title its posts as positives and half as many
    seeded negatives from the whole pool (long form)."""
    d = FX.table(spark, sf, "documents")
    r = TR.retriever_set(d, question="source", ctx_id="doc_id", text="text", neg_scale=0.5, seed="dpr")
    return r.select("question", "kind", "ctx_idx", "ctx_id", "text")


@register("seeded_split")
def seeded_split(spark, sf):
    """TRN-06: seeded shuffle of the posts over 4 workers."""
    return TR.seeded_split(FX.table(spark, sf, "documents"), "doc_id", 4, seed="split")


@register("vocab_min_count")
def vocab_min_count(spark, sf):
    """AGG-19: token vocabulary (count >= 2) of the NLI sentences."""
    e = TR.nli_examples(FX.nli_pairs(spark, sf), NLI_CODES)
    toks = e.select(F.explode(F.concat(glove_tokens("sentence1"), glove_tokens("sentence2"))).alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") >= 2)


@register("bigram_df")
def bigram_df(spark, sf):
    """AGG-11 / FN-03: document frequency of word uni- and bigrams, min df 2."""
    from claimspark.functions.text import word_ngrams
    d = FX.table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    # tokens materialised as a column first: the n-gram lambda then reads the
    # array instead of re-running the tokeniser for every position
    toks = d.select("doc_id", word_tokens("text").alias("toks"))
    terms = toks.select("doc_id", F.explode(F.array_distinct(word_ngrams(F.col("toks"), 2))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= 2)


# --------------------------------------------------------- sources / sinks


@register("jsonl_gz_roundtrip")
def jsonl_gz_roundtrip(spark, sf):
    """SNK-01/02 + SRC-03/04 + ING-09: posts written as JSONL and as gzip
    JSONL (bounded files, one folder per language), read back."""
    base = scratch_path(spark, "jsonl")
    d = FX.table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    SK.write_jsonl(d.select("doc_id", "text"), f"{base}/plain")
    SK.write_gzip_jsonl(d, f"{base}/gz", partition_by="lang")
    gz = SR.read_jsonl_tree(spark, f"{base}/gz", "doc_id long, source string, text string")
    plain = spark.read.schema("doc_id long, text string").json(f"{base}/plain")
    texts = SR.read_text_field(spark, f"{base}/plain", "text")
    n_plain = texts.count()
    return (gz.join(plain.withColumnRenamed("text", "plain_text"), "doc_id", "left")
              .select("doc_id", F.regexp_extract("subdir", "lang=(.*)", 1).alias("lang"), "source",
                      F.md5("text").alias("text_md5"), (F.col("text") == F.col("plain_text")).alias("same_plain"),
                      F.lit(n_plain).cast("bigint").alias("n_plain")))


@register("named_files_roundtrip")
def named_files_roundtrip(spark, sf):
    """SNK-02: events as ``events-day-index.jsonl.gz`` of at most 500 rows,
    read back with the day of the file's name and the size of its file."""
    base = scratch_path(spark, "named")
    e = FX.table(spark, sf, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    SK.write_named_jsonl(e, base, "events", "day", 500)
    back = spark.read.schema("event_id long, event_type string, day string").json(f"{base}/events-*.jsonl.gz") \
        .withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1))
    small = back.groupBy("file").agg((F.count(F.lit(1)) <= 500).alias("bounded"))
    return back.join(small, "file").select(
        "event_id", "event_type", F.regexp_extract("file", r"^events-(\d{4}-\d{2}-\d{2})-\d+\.jsonl\.gz$", 1).alias("day"),
        (F.col("day") == F.substring("file", 8, 10)).alias("same_day"), "bounded")


@register("file_unique_counts")
def file_unique_counts(spark, sf):
    """AGG-01: files listed and read, distinct ids, texts and users of a
    tree of gzip JSONL (one file per part) beside files of another kind."""
    base = scratch_path(spark, "count")
    d = FX.table(spark, sf, "documents").select("doc_id", "text", "source", (F.col("doc_id") % 8).alias("part")) \
        .repartition("part")
    d.write.partitionBy("part").option("compression", "gzip").json(f"{base}/posts")
    d.select("doc_id", "part").write.partitionBy("part").json(f"{base}/other")
    files = SR.count_files(spark, base).first()
    r = spark.read.schema("doc_id long, text string, source string").json(f"{base}/posts")
    return r.agg(F.lit(files["n_files_listed"]).cast("bigint").alias("n_files_listed"), F.lit(files["n_files_read"]).cast("bigint").alias("n_files_read"),
                 F.count_distinct("doc_id").alias("n_ids"), F.count_distinct(F.unhex(F.md5("text"))).alias("n_texts"),
                 F.count_distinct("source").alias("n_users"))


@register("mirrored_tree_thin")
def mirrored_tree_thin(spark, sf):
    """SRC-05 + ING-07 + SNK-09: a day-folder tree of tweet JSONL thinned
    (English, no retweets, minimal fields) into a mirrored tree."""
    base = scratch_path(spark, "tree")
    t = FX.tweets(spark, sf).withColumn("day", F.date_format("created_at", "yyyy-MM-dd")) \
        .withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    t.write.mode("overwrite").partitionBy("day").json(f"{base}/in")
    schema = ("id long, created_at string, lang string, user struct<id_str:string,followers_count:double>, "
              "props struct<k:int,note:string>, retweeted_status long")
    src = SR.read_jsonl_tree(spark, f"{base}/in", schema)
    thin = src.filter((F.col("lang") == "en") & F.col("retweeted_status").isNull()) \
        .select(*IG.project_tree(src, MINIMAL_TREE), "subdir")
    SK.write_mirrored(thin, f"{base}/out")
    back = SR.read_jsonl_tree(spark, f"{base}/out", "id long, lang string, user struct<id_str:string>, props struct<k:int>")
    return back.select(F.regexp_extract("subdir", r"(\d{4}-\d{2}-\d{2})", 1).alias("day"), "id", "lang",
                       F.col("user.id_str").alias("user_id_str"), F.col("props.k").cast("bigint").alias("props_k"))


@register("csv_annotation_roundtrip")
def csv_annotation_roundtrip(spark, sf):
    """SNK-03 + SRC-06: headerless 7-column annotation CSV written and read."""
    base = scratch_path(spark, "anncsv")
    a = FX.annotation_rows(spark, sf).select(
        F.lit("r1").alias("rand1"), F.col("misconception_id"), F.lit("m").alias("misconception"), "tweet",
        F.lit("r2").alias("rand2"), "label", "tweet_id")
    SK.write_csv(a, base, header=False)
    r = SR.read_annotation_csv(spark, base)
    return r.select("misconception_id", F.md5("tweet").alias("tweet_md5"),
                    F.coalesce("label", F.lit("")).alias("label"), F.coalesce("tweet_id", F.lit("")).alias("tweet_id"))


@register("csv_news_roundtrip")
def csv_news_roundtrip(spark, sf):
    """SRC-07 + AGG-02: headered labelled-news CSV -> posts grouped by title."""
    base = scratch_path(spark, "newscsv")
    d = FX.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").cast("string").alias("tweet_id"),
        F.lit("tweet").alias("tweet_type"), F.col("source").alias("source_title"), F.lit("news").alias("source_type"),
        F.col("text").alias("tweet"), F.lit("real").alias("source_veracity"))
    SK.write_csv(d, base, header=True)
    r = SR.read_news_csv(spark, base)
    return r.groupBy("source_title").agg(F.count(F.lit(1)).alias("n_tweets"),
                                         F.sum(F.length("tweet")).cast("bigint").alias("total_chars"))


@register("csv_predictions_roundtrip")
def csv_predictions_roundtrip(spark, sf):
    """SNK-04 + SRC-08 + STN-08: prediction records with the probability
    list in ``misc`` written as CSV and parsed back."""
    base = scratch_path(spark, "predcsv")
    p = FX.stance_preds(spark, sf).select(
        "input_id", "model_id", F.col("label_id").cast("int"), "misinfo_id", "confidence",
        F.to_json(F.array(F.col("confidence"), F.lit(1.0) - F.col("confidence"), F.lit(0.0))).alias("misc"))
    SK.write_csv(p, base, header=True)
    r = SR.read_predictions_csv(spark, base)
    return r.select("model_id", "input_id", "misinfo_id", F.col("label_id").cast("bigint"),
                    F.round("confidence", 6).alias("confidence"), F.round(F.col("probs")[1], 6).alias("p1"))


@register("claims_jsonl_roundtrip")
def claims_jsonl_roundtrip(spark, sf):
    """SRC-01: claim records written as JSONL and read one row per variation."""
    base = scratch_path(spark, "claims")
    c = FX.claims(spark, sf).withColumn("reliability_score", F.col("reliability_score").cast("string"))
    SK.write_jsonl(c, base)
    r = SR.read_claims_jsonl(spark, base)
    return r.select("id", F.col("var_idx").cast("bigint"), "sentence", "reliability_score")


@register("claims_table_roundtrip")
def claims_table_roundtrip(spark, sf):
    """PRJ-03 -> table -> SRC-02: claims with JSON misc, read back aligned."""
    base = scratch_path(spark, "misinfo")
    IG.claims_to_rows(FX.claims(spark, sf), keep_id=True).write.mode("overwrite").parquet(base)
    r = SR.claims_from_table(spark.read.parquet(base))
    return r.select("id", F.col("var_idx").cast("bigint"), "sentence", "source")


@register("fever_jsonl_roundtrip")
def fever_jsonl_roundtrip(spark, sf):
    """SNK-10 + SRC-13: converted FEVER records written and read back."""
    base = scratch_path(spark, "fever")
    SK.write_jsonl(TR.fever_convert(FX.fever_claims(spark, sf), FX.wiki(spark, sf)), base)
    r = spark.read.schema("id long, claim string, label string, sentences array<string>, "
                          "evidence_sets array<array<int>>").json(base)
    return r.select("id", "label", F.size("sentences").cast("bigint").alias("n_sentences"),
                    _sets_str(F.col("evidence_sets")).alias("evidence_sets"))


@register("word_vector_file")
def word_vector_file(spark, sf):
    """SRC-10: embeddings written as a ``word v1 .. vd`` text file and parsed."""
    base = scratch_path(spark, "wvec")
    e = FX.table(spark, sf, "embeddings")
    e.select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")),
                         F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("value")) \
        .write.mode("overwrite").text(base)
    r = SR.read_word_vectors(spark, base)
    return r.select("word", F.size("vec").cast("bigint").alias("dim"),
                    F.round(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("vec_sum"))


@register("id_list_roundtrip")
def id_list_roundtrip(spark, sf):
    """ING-04 / SNK-06 + SRC-17: ids of inserted rows written one per line,
    read back trimmed."""
    base = scratch_path(spark, "ids")
    new, _ = IG.insert_if_new(FX.incoming_inputs(spark, sf), FX.stored_inputs(spark, sf),
                              key=["source_id"], order="event_id")
    SK.write_ids(new.select(F.concat(F.lit("  "), F.col("id").cast("string"), F.lit(" ")).alias("id")), "id", base)
    return SR.read_id_lists(spark, base).select(F.col("id").cast("bigint").alias("id"))


@register("append_table_roundtrip")
def append_table_roundtrip(spark, sf):
    """SNK-05: stored keys written, new keys appended once (a second append
    of the same batch adds nothing), table read back."""
    base = scratch_path(spark, "table")
    stored = FX.stored_inputs(spark, sf).select("source_id", "event_id")
    stored.write.mode("overwrite").parquet(base)
    firsts = IG.first_per_key(FX.incoming_inputs(spark, sf).select("source_id", "event_id"), ["source_id"], "event_id")
    SK.append_if_new(base, firsts, ["source_id"])
    SK.append_if_new(base, firsts, ["source_id"])
    return spark.read.parquet(base).select("source_id", "event_id")


@register("wide_sheet_roundtrip")
def wide_sheet_roundtrip(spark, sf):
    """SNK-07: the wide annotation sheet (PRJ-05) written as CSV and read."""
    base = scratch_path(spark, "sheet")
    SK.write_csv(variant_columns_wide(spark, sf), base, header=True)
    cols = ["id"] + [f"source_{i}" for i in range(1, 6)] + [f"pos_{i}" for i in range(1, 6)] + \
        [f"neg_{i}" for i in range(1, 6)] + ["category"]
    r = spark.read.schema(", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in cols)) \
        .option("header", "true").option("multiLine", "true").option("escape", '"').csv(base)
    return r.select("id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols[1:]])


# ---------------------------------------------------------------- streaming


@register("stream_stance")
def stream_stance(spark, sf):
    """ING-10: posts arriving as files, scored per micro-batch with the
    STN-07 pipeline (foreachBatch, one output folder per batch id)."""
    base = scratch_path(spark, "stream-stance")
    posts = FX.posts(spark, sf)
    # two micro-batches, each of as many files as half the input has splits
    files = max(1, -(-posts.rdd.getNumPartitions() // 2))
    SM.stage_files(posts, f"{base}/in", 2 * files)
    stream = SM.file_stream(spark, f"{base}/in", posts.schema, files_per_trigger=files)
    static = claim_side(spark, sf, persist=True)   # stream-static: claims prepared once
    SM.score_stream(stream, lambda b: agree_disagree_for(spark, sf, b, static), f"{base}/out")
    static[1].unpersist()
    return spark.read.parquet(f"{base}/out").drop("batch_id")


@register("article_dedup_stream")
def article_dedup_stream(spark, sf):
    """ING-06 streaming twin: incoming articles as a file stream, of which
    only keys never stored pass (exact dedup by keyed state)."""
    base = scratch_path(spark, "stream-dedup")
    e = FX.table(spark, sf, "events").select(
        F.col("event_type").alias("category"),
        F.concat(F.lit("https://news.example/"), F.col("user_id").cast("string")).alias("url"),
        F.col("event_id").alias("seq"), "ts")
    split = F.to_timestamp(F.lit(FX.SPLIT_TS))
    e.filter(F.col("ts") < split).select("category", "url", "seq").write.mode("overwrite").parquet(f"{base}/stored")
    incoming = e.filter(F.col("ts") >= split).select("category", "url", "seq")
    incoming.repartition(4, "category", "url").write.mode("overwrite").parquet(f"{base}/in")
    stream = SM.file_stream(spark, f"{base}/in", incoming.schema)
    SM.dedup_keyed(stream, ["category", "url"], "seq", f"{base}/new", stored=f"{base}/stored")
    return spark.read.schema(incoming.schema).parquet(f"{base}/new")


def _stream_daily(spark, sf):
    base = scratch_path(spark, "stream-counts")
    ev = FX.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    ev.repartitionByRange(4, "ts").write.mode("overwrite").parquet(f"{base}/in")
    stream = SM.file_stream(spark, f"{base}/in", ev.schema)
    agg = SM.daily_distinct_counts(stream, "ts", "user_id")
    ckpt = scratch_path(spark, "ckpt-counts")

    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out")
    q = agg.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", ckpt) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"),
                                                    "n_events", "approx_users")


@register("stream_unique_counts")
def stream_unique_counts(spark, sf):
    """ING-11: events as a stream; per UTC day the event count and whether
    the approximate number of distinct users is within three standard errors
    (5 % each) of the exact one."""
    exact = FX.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")) \
        .agg(F.count_distinct("user_id").alias("n_users"))
    near = F.abs(F.col("approx_users") - F.col("n_users")) <= 0.15 * F.col("n_users") + 1
    return _stream_daily(spark, sf).join(exact, "day").select("day", "n_events", "n_users", near.alias("within_bound"))


@register("stream_daily_events")
def stream_daily_events(spark, sf):
    """ING-11 exact part: streamed tumbling-day event counts."""
    return _stream_daily(spark, sf).select("day", "n_events")


@register("resumed_requests")
def resumed_requests(spark, sf):
    """ING-08 / JOIN-12: post ids in four files, asked for in requests of 100;
    the run breaks in its third batch and is started again.  Per post the
    length of what came and how often it was written."""
    base = scratch_path(spark, "requests")
    docs = FX.table(spark, sf, "documents").select("doc_id", "text")
    SM.stage_files(docs.select("doc_id"), f"{base}/in", 4)
    calls = []

    def fetch(requests):
        calls.append(1)
        if len(calls) == 3:
            raise ConnectionError("the service went away")
        ids = requests.select("batch", F.explode(F.split("ids", ",").cast("array<bigint>")).alias("doc_id"))
        return ids.join(docs, "doc_id").select("doc_id", F.length("text").cast("bigint").alias("n_chars"))

    for _ in range(2):
        stream = SM.file_stream(spark, f"{base}/in", docs.select("doc_id").schema)
        try:
            SM.request_stream(stream, "doc_id", 100, fetch, f"{base}/out", f"{base}/ledger")
        except StreamingQueryException:
            if len(calls) != 3:
                raise
    return spark.read.parquet(f"{base}/out").groupBy("doc_id", "n_chars").agg(F.count(F.lit(1)).alias("n_written"))


@register("stream_weekly_users")
def stream_weekly_users(spark, sf):
    """ING-11 / AGG-01: the log as a stream in order; each day's sketch is
    stored once the watermark has passed it, and weeks are united from the
    stored days: whether their distinct users are within three standard
    errors of the exact number."""
    base = scratch_path(spark, "stream-sketches")
    ev = FX.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    SM.stage_in_order(ev, f"{base}/in", "ts", 4)
    stream = SM.file_stream(spark, f"{base}/in", ev.schema)
    SM.sink_to_parquet(SM.daily_sketches(stream, "ts", "user_id"), f"{base}/days")
    days = spark.read.parquet(f"{base}/days")
    week = F.date_format(F.date_trunc("week", "w.start"), "yyyy-MM-dd")
    found = SM.users_of_spans(days, week, "week")
    exact = ev.join(days.select("w"), (F.col("ts") >= F.col("w.start")) & (F.col("ts") < F.col("w.end"))
                    & (F.to_date("ts") == F.to_date("w.start"))) \
        .groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")) \
        .agg(F.count_distinct("user_id").alias("n_users"))
    near = F.abs(F.col("approx_users") - F.col("n_users")) <= 3 * 1.04 / 64 * F.col("n_users") + 1
    return found.join(exact, "week").select("week", "n_days", "n_events", "n_users", near.alias("within_bound"))


# ------------------------------------------------------------- MLlib heads

def _nli_split(spark, sf):
    e = TR.nli_examples(FX.nli_pairs(spark, sf), NLI_CODES).withColumn("ex_id", F.concat_ws(":", "conv_id", "turn"))
    s = TR.seeded_split(e.select("ex_id"), "ex_id", 4, seed="nli")
    return e.join(s, "ex_id").withColumn("split", F.when(F.col("worker") == 3, "dev").otherwise("train"))


@register("nli_split_sizes")
def nli_split_sizes(spark, sf):
    """STN-09: labels of the seeded train and dev split."""
    return _nli_split(spark, sf).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("bow_vocabulary")
def bow_vocabulary(spark, sf):
    """STN-01: both vocabularies of the BoW head with df and idf."""
    v = ML.bow_vocabulary(_nli_split(spark, sf).filter(F.col("split") == "train"))
    return v.select("side", "term", "df", F.round("idf", 6).alias("idf"))


def _written(df, name):
    """A table that a training reads many times, written once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _trained_bow(spark, sf):
    """The NLI split, its features, and the weights of the BoW head trained
    on its train part, each a table on shared storage (STN-10)."""
    data = _written(_nli_split(spark, sf).select("ex_id", "label", "split", "sentence1", "sentence2"), "nli")
    train = data.where("split = 'train'")
    vocabulary = _written(ML.bow_vocabulary(train), "vocabulary")
    features = _written(GR.bow_features(data, vocabulary, id_col="ex_id"), "features")
    labels = train.select(F.col("ex_id").alias("id"), "label")
    return data, features, GR.fit_softmax(features, labels, rounds=12, l2=1.0 / max(labels.count(), 1))


@register("bow_logreg_accuracy")
def bow_logreg_accuracy(spark, sf):
    """STN-01/02/09/10: BoW softmax regression trained on the NLI train split
    by distributed sums, its weights saved and read, and scored on train and
    dev."""
    data, features, weights = _trained_bow(spark, sf)
    scored = GR.predict(features, weights)
    return ML.accuracy_by_split(data.join(scored, data["ex_id"] == scored["id"]))


@register("bow_logreg_weights")
def bow_logreg_weights(spark, sf):
    """STN-01: the trained weights of every term and class."""
    return _trained_bow(spark, sf)[2].select("key", *[F.round(f"w{c}", 6).alias(f"w{c}") for c in range(3)])


def _nli_vectors(spark, sf, data):
    wv, key = FX.word_vectors(spark, sf)
    vocab = VS.load_vocab(wv)
    u = VS.wordvec_average(data.select("ex_id", F.col("sentence1").alias("text")), wv, id_col="ex_id",
                           tokenizer=glove_tokens, word_key=key, vocab=vocab).withColumnRenamed("vec", "u")
    v = VS.wordvec_average(data.select("ex_id", F.col("sentence2").alias("text")), wv, id_col="ex_id",
                           tokenizer=glove_tokens, word_key=key, vocab=vocab).withColumnRenamed("vec", "v")
    return data.join(u, "ex_id").join(v, "ex_id")


@register("boe_logreg_accuracy")
def boe_logreg_accuracy(spark, sf):
    """STN-03: logistic regression on both averaged word vectors."""
    d = _written(_nli_vectors(spark, sf, _nli_split(spark, sf)).select("ex_id", "label", "split", "u", "v"), "pairs")
    features = GR.vector_features(d, F.concat("u", "v"), id_col="ex_id")
    labels = d.where("split = 'train'").select(F.col("ex_id").alias("id"), "label")
    scored = GR.predict(features, GR.fit_softmax(features, labels, rounds=8, l2=1.0 / max(labels.count(), 1)))
    return ML.accuracy_by_split(d.join(scored, d["ex_id"] == scored["id"]))


def _pair_examples(spark, sf):
    d = _nli_vectors(spark, sf, _nli_split(spark, sf))
    return _written(d.select("ex_id", "label", "split", _pf("u", "v", ("u", "v", "absdiff", "prod")).alias("features")),
                    "pairs")


@register("mlp_pair_classifier")
def mlp_pair_classifier(spark, sf):
    """STN-05: three hidden tanh layers on [u, v, |u-v|, u*v] pair features,
    trained data-parallel."""
    d = _pair_examples(spark, sf)
    layers = TN.fit(d.where("split = 'train'"), id_col="ex_id")
    z = TN.logits_column(spark, F.col("features"), layers)
    return ML.accuracy_by_split(d.withColumn("z", z).withColumn(
        "prediction", F.array_position("z", F.array_max("z")) - 1))


@register("tanh_forward")
def tanh_forward(spark, sf):
    """STN-05: the forward pass of every pair for stated weights, the sines
    of their places over the root of the layer's inputs."""
    d = _pair_examples(spark, sf)
    sizes = [len(d.first()["features"]), 8, 8, 8, 3] if d.count() else [1, 8, 8, 8, 3]
    layers = [(np.sin(7.0 * np.arange(a)[:, None] + 13.0 * np.arange(b)[None, :] + 17.0 * l + 1.0) / np.sqrt(a),
               np.cos(np.arange(b) + 3.0 * l)) for l, (a, b) in enumerate(zip(sizes, sizes[1:]))]
    z = TN.logits_column(spark, F.col("features"), layers)
    return d.select("ex_id", z.alias("z")).select("ex_id", *[F.round(F.get("z", F.lit(c)), 6).alias(f"z{c}") for c in range(3)])


@register("seed_yaml_roundtrip")
def seed_yaml_roundtrip(spark, sf):
    """SRC-09: seed dimensions written as one YAML file per region, read back
    from the store through Spark."""
    n = FX.table(spark, sf, "nation")
    record = F.concat(F.lit("  - id: "), F.col("n_nationkey").cast("string"), F.lit("\n    name: \""), F.col("n_name"),
                      F.lit("\"\n"))
    files = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(record)), "").alias("r")).select(
        F.col("n_regionkey").alias("region"), F.concat(F.lit("table_class: Label\nrecords:\n"), "r").alias("value"))
    base = scratch_path(spark, "seeds")
    files.write.partitionBy("region").text(base)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("misc", T.StringType())])
    return SR.read_seed_yaml(spark, f"{base}/region=*", schema)


class OverlapStance(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stance model as a user may bring it: by the share of the reply's
    different words that the claim holds."""
    least = Param(Params._dummy(), "least", "share from which a reply is about the claim", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(least=0.1)

    def _transform(self, df):
        said = F.array_distinct(word_tokens("sentence2_clean"))
        share = F.coalesce(F.try_divide(F.size(F.array_intersect(said, word_tokens("sentence1_clean"))), F.size(said)), F.lit(0.0))
        least = self.getOrDefault(self.least)
        part = F.when(share >= least, F.array(share, 1 - share, F.lit(0.0))).otherwise(F.array(F.lit(0.0), share, 1 - share))
        return df.withColumn("probability", part).withColumn(
            "prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


@register("user_stance_model")
def user_stance_model(spark, sf):
    """UDF-05 / STN-10: a user's model, with the cleaning before it, saved as
    one pipeline, loaded and applied."""
    path = scratch_path(spark, "user-stance")
    mine = OverlapStance()
    mine._set(least=0.2)
    PipelineModel(stages=[ML.folder(("sentence1", "sentence2")), mine]).write().overwrite().save(path)
    pairs = _nli_split(spark, sf).select("ex_id", "label", "sentence1", "sentence2")
    return ML.judge_stance(pairs, PipelineModel.load(path)).select(
        "ex_id", "label", "label_id", F.round("confidence", 6).alias("confidence"))


# ------------------------------------------------------- more operators
@register("user_encoder_topk")
def user_encoder_topk(spark, sf):
    """UDF-01 + RET-03: posts and claims encoded by a user encoder (pandas
    UDF, loaded once per worker), cosine top 5 claims per post."""
    fac = VS.hashing_encoder_factory(64)
    p = VS.encode_texts(FX.posts(spark, sf).select("input_id", "text"), "text", fac, 64).select("input_id", "vec")
    c = VS.encode_texts(FX.table(spark, sf, "benchmark").select("item_id", "text"), "text", fac, 64).select("item_id", "vec")
    top = VS.cosine_top_k(p, c, q_id="input_id", c_id="item_id", k=5)
    return top.select("input_id", F.col("item_id").alias("misinfo_id"), F.round("score", 6).alias("confidence"), "rank")


@register("unique_counts_approx")
def unique_counts_approx(spark, sf):
    """AGG-01 approximate option: HyperLogLog++ distinct counts per event
    type (standard error 2 %), held against the exact ones."""
    e = FX.table(spark, sf, "events")
    # one row per user first: beside an exact distinct count Spark would keep
    # a sketch per user, not per event type
    users = e.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    near = F.abs(F.approx_count_distinct("user_id", 0.02) - F.count("user_id"))
    return users.groupBy("event_type").agg(F.sum("n").alias("n_events"), F.count("user_id").alias("n_users"),
                                           (near <= 0.06 * F.count("user_id") + 1).alias("within_bound"))


@register("all_models_report")
def all_models_report(spark, sf):
    """EVL-05: every model of the registry that has predictions, evaluated
    in one job (retrieval metrics for similarity models, stance metrics for
    stance models), long form (model_id, family, metric, value)."""
    reg = EV.model_registry(spark)
    p = FX.retrieval_preds(spark, sf, only_posts=FX.gold_posts(spark, sf))
    n = FX.n_rows(spark, sf, "benchmark")
    rr = EV.retrieval_report(FX.gold(spark, sf), p, RETRIEVAL_FIXTURE_MODELS, n_claims=n)
    sr = EV.stance_report(EV.confusion_cells(FX.gold(spark, sf), FX.stance_preds(spark, sf)))

    def longform(df):
        cols = [c for c in df.columns if c != "model_id"]
        stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
        return df.select("model_id", F.expr(f"stack({len(cols)}, {stack}) AS (metric, value)"))
    out = longform(rr).unionByName(longform(sr)).join(F.broadcast(reg), "model_id")
    return out.select("model_id", "family", "metric", F.round("value", 6).alias("value"))


@register("html_files_roundtrip")
def html_files_roundtrip(spark, sf):
    """SRC-16: pages as one HTML file each (many in one folder), read whole,
    cards extracted (PRJ-07)."""
    base = scratch_path(spark, "html")
    FX.card_pages(spark, sf).select(F.col("html").alias("value")).repartition(32) \
        .write.option("maxRecordsPerFile", 1).text(base)
    return IG.html_cards(SR.read_html_dir(spark, base))


@register("nli_jsonl_roundtrip")
def nli_jsonl_roundtrip(spark, sf):
    """SRC-15 + TRN-04: NLI pairs as JSONL, read and coded."""
    base = scratch_path(spark, "nli")
    SK.write_jsonl(FX.nli_pairs(spark, sf).select("sentence1", "sentence2", "gold_label"), base)
    e = TR.nli_examples(SR.read_nli(spark, base), NLI_CODES)
    return e.select("sentence1", "sentence2", "label")


@register("fever_files_convert")
def fever_files_convert(spark, sf):
    """SRC-12 + SRC-13 + TRN-01: the wiki dump and the claims as JSONL
    files, read with explicit schemas and converted."""
    base = scratch_path(spark, "feverin")
    SK.write_jsonl(FX.wiki(spark, sf), f"{base}/wiki")
    SK.write_jsonl(FX.fever_claims(spark, sf), f"{base}/claims")
    w = spark.read.schema("id string, lines string").json(f"{base}/wiki")
    c = SR.read_fever_claims(spark, f"{base}/claims")
    conv = TR.fever_convert(c, w)
    return conv.select("id", "claim", "label", F.size("sentences").cast("bigint").alias("n_sentences"),
                       F.md5(F.array_join("sentences", "\n")).alias("sentences_md5"),
                       _sets_str(F.col("evidence_sets")).alias("evidence_sets"))


@register("scifact_files_examples")
def scifact_files_examples(spark, sf):
    """SRC-14 + TRN-03: corpus and claims (evidence map) as JSONL files."""
    base = scratch_path(spark, "scifact")
    corpus, claims = FX.scifact(spark, sf)
    SK.write_jsonl(corpus, f"{base}/corpus")
    SK.write_jsonl(claims, f"{base}/claims")
    c2, cl2 = SR.read_scifact(spark, f"{base}/corpus", f"{base}/claims")
    e = TR.scifact_examples(c2, cl2, seed="scifact")
    return e.select("claim_id", "doc_id", "kind", F.col("set_idx").cast("bigint"), "rationale",
                    F.col("label").cast("bigint"))


REPORT_COLUMNS = ["pos_hits_1", "pos_hits_5", "pos_hits_10", "pos_mrr", "both_hits_1", "both_hits_5",
                  "both_hits_10", "both_mrr"]


@register("retrieval_report_line")
def retrieval_report_line(spark, sf):
    """EVL-01 display line: Hits@1/5/10 (1 decimal) and MRR (2 decimals),
    half-to-even, ' & '-joined in the reference's order."""
    p = FX.retrieval_preds(spark, sf, only_posts=FX.gold_posts(spark, sf))
    n = FX.n_rows(spark, sf, "benchmark")
    r = EV.retrieval_report(FX.gold(spark, sf), p, RETRIEVAL_FIXTURE_MODELS, n_claims=n)
    r = r.select("model_id", *[F.bround(F.col(c), 2 if c.endswith("mrr") else 1).alias(c) for c in REPORT_COLUMNS])
    return EV.report_line(r, REPORT_COLUMNS, 2)


@register("retriever_jsonl_roundtrip")
def retriever_jsonl_roundtrip(spark, sf):
    """SNK-08: retriever training records {question, answers, kind, ctx:
    {title, text}} written as JSONL (one context per line) and read back."""
    base = scratch_path(spark, "dpr")
    d = FX.table(spark, sf, "documents")
    r = TR.retriever_set(d, question="source", ctx_id="doc_id", text="text", neg_scale=0.5, seed="dpr")
    rec = r.select("question", F.array().cast("array<string>").alias("answers"), "kind", "ctx_idx",
                   F.struct(F.lit(None).cast("string").alias("title"), F.col("text"), F.col("ctx_id").alias("id")).alias("ctx"))
    SK.write_jsonl(rec, base)
    back = spark.read.schema("question string, answers array<string>, kind string, ctx_idx long, "
                             "ctx struct<title:string,text:string,id:long>").json(base)
    return back.select("question", "kind", "ctx_idx", F.col("ctx.id").alias("ctx_id"), F.col("ctx.text").alias("text"),
                       F.size("answers").cast("bigint").alias("n_answers"))



@register("retriever_records")
def retriever_records(spark, sf):
    """SNK-08 / TRN-05 / AGG-02: nested retriever records of at most 100
    contexts written as JSONL and read back."""
    base = scratch_path(spark, "dprrec")
    d = FX.table(spark, sf, "documents")
    r = TR.retriever_set(d, question="source", ctx_id="doc_id", text="text", neg_scale=0.5, seed="dpr")
    SK.write_jsonl(TR.retriever_records(r, d, ctx_id="doc_id", text="text", max_ctxs=100), base)
    ctxs = "array<struct<title:string,text:string,id:bigint>>"
    back = spark.read.schema(f"question string, record bigint, answers array<string>, positive_ctxs {ctxs}, "
                             f"negative_ctxs {ctxs}, hard_negative_ctxs {ctxs}").json(base)

    def ids(c):
        return F.array_join(F.transform(c, lambda x: x["id"].cast("string")), ",")
    texts = F.transform(F.concat("positive_ctxs", "negative_ctxs"), lambda x: F.md5(x["text"]))
    return back.select("question", "record", ids("positive_ctxs").alias("pos_ids"), ids("negative_ctxs").alias("neg_ids"),
                       F.md5(F.array_join(texts, "")).alias("texts_md5"),
                       (F.size("answers") + F.size("hard_negative_ctxs")).cast("bigint").alias("n_empty"))


@register("mirrored_tree_stream")
def mirrored_tree_stream(spark, sf):
    """ING-07 streaming twin: the day-folder tweet tree consumed as a file
    stream, thinned and written to a mirrored tree by the file sink."""
    base = scratch_path(spark, "tree-stream")
    t = FX.tweets(spark, sf).withColumn("day", F.date_format("created_at", "yyyy-MM-dd")) \
        .withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    t.write.mode("overwrite").partitionBy("day").json(f"{base}/in")
    schema = ("id long, created_at string, lang string, user struct<id_str:string,followers_count:double>, "
              "props struct<k:int,note:string>, retweeted_status long")
    cond = (F.col("lang") == "en") & F.col("retweeted_status").isNull()
    cols = [F.col("id"), F.col("created_at"), F.col("lang"), F.struct(F.col("user.id_str").alias("id_str")).alias("user"),
            F.struct(F.col("props.k").alias("k")).alias("props")]
    SM.thin_tree_stream(spark, f"{base}/in", schema, f"{base}/out", cols, cond)
    back = SR.read_jsonl_tree(spark, f"{base}/out", "id long, lang string, user struct<id_str:string>, props struct<k:int>")
    return back.select(F.regexp_extract("subdir", r"(\d{4}-\d{2}-\d{2})", 1).alias("day"), "id", "lang",
                       F.col("user.id_str").alias("user_id_str"), F.col("props.k").cast("bigint").alias("props_k"))
