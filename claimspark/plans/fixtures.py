"""Fixture views over the driver's tables (FIXTURES.md part B).

Each function derives one reference input shape from the given tables with
plain DataFrame expressions, so the work of every query grows with the
tables.  The DuckDB twins live in ``plans.sqlfix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.text import hash32, hash_mod
from claimspark.sources.tables import read_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def posts(spark, sf) -> DataFrame:
    """input / tweets: documents as posts."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("input_id"), "text", F.col("source").alias("source_type"),
        F.col("doc_id").cast("string").alias("source_id"), "lang")


def claims(spark, sf) -> DataFrame:
    """A1 claim records from benchmark: variations = non-blank lines."""
    b = table(spark, sf, "benchmark")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda l: F.length(F.trim(l)) > 0)
    return b.select(
        F.col("item_id").alias("id"), F.col("text").alias("canonical_sentence"),
        F.array(F.concat(F.lit("src"), (F.col("item_id") % 3).cast("string"))).alias("sources"),
        F.array((F.col("item_id") % 4).cast("string")).alias("category"),
        lines.alias("pos_variations"),
        F.array().cast("array<string>").alias("neg_variations"),
        F.lit(1).alias("reliability_score"), F.lit("benchmark").alias("origin"))


def n_rows(spark, sf, name) -> int:
    """Row count of a table: a scalar for modulo / idf constants."""
    return table(spark, sf, name).count()


def gold(spark, sf) -> DataFrame:
    """EVL-03 gold table of the annotator ('human' model outputs), here from
    labels: misinfo = doc_id % n_items; gold label
    toxic -> 1 (disagrees), quality -> 0 (agrees), else 2."""
    n_items = n_rows(spark, sf, "benchmark")
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("input_id"), (F.col("doc_id") % n_items).alias("misinfo_id"),
        F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 0).otherwise(2)
        .cast("bigint").alias("gold_label"),
        F.lit("human").alias("model_id"))


__all__ = ["table", "posts", "claims", "gold", "hash32", "hash_mod"]


# Stance models simulated by the ``preds`` fixture.
STANCE_FIXTURE_MODELS = ["bow-log-snli", "sbert-snli", "comb-sbert-fever-ct"]


def gold_posts(spark, sf) -> DataFrame:
    """Ids of the posts with a positive or negative gold pair."""
    return gold(spark, sf).filter(F.col("gold_label").isin(0, 1)).select("input_id").distinct()


def retrieval_preds(spark, sf, only_posts: DataFrame | None = None) -> DataFrame:
    """Real retrieval predictions: sparse TF-IDF ('bow-cosine') and BM25
    ('pyserini') scores of every post against every claim (missing pairs
    score 0).  A post's scores and ranks depend on that post and the claims
    only, so an evaluation may restrict scoring to ``only_posts`` (the
    annotated ones) before any text is tokenised."""
    from claimspark.operators import retrieval as R
    p, c = posts(spark, sf), table(spark, sf, "benchmark")
    if only_posts is not None:
        p = p.join(only_posts, "input_id", "left_semi")
    tf = R.tfidf_cosine(p, c.withColumnRenamed("item_id", "misinfo_id"),
                        post_id="input_id", claim_id="misinfo_id")
    bm = R.bm25(p, c.withColumnRenamed("item_id", "misinfo_id"), post_id="input_id", claim_id="misinfo_id")
    return (tf.select(F.lit("bow-cosine").alias("model_id"), "input_id", "misinfo_id",
                      F.round("score", 9).alias("confidence"))
            .unionByName(bm.select(F.lit("pyserini").alias("model_id"), "input_id", "misinfo_id",
                                   F.round("score", 9).alias("confidence"))))


def stance_preds(spark, sf) -> DataFrame:
    """preds(model): a simulated stance model per name, agreeing with gold
    on ~70% of the rows; confidence in hundredths (ties on purpose)."""
    g = gold(spark, sf)
    m = F.col("model_id")
    key = F.concat(m, F.col("input_id").cast("string"))
    return (g.select("input_id", "misinfo_id", "gold_label",
                     F.explode(F.array(*[F.lit(x) for x in STANCE_FIXTURE_MODELS])).alias("model_id"))
             .select("model_id", "input_id", "misinfo_id",
                     F.when(hash_mod(key, 10) < 7, F.col("gold_label"))
                      .otherwise(hash_mod(F.concat(F.col("input_id").cast("string"), m), 3))
                      .cast("bigint").alias("label_id"),
                     (hash_mod(F.concat(key, F.lit("c")), 100) / 100.0).alias("confidence")))


def word_vectors(spark, sf):
    """Word-vector file stand-in, keyed by a hashing vocabulary: a token's
    vector is embedding row h(token) % n_vec, so every token is scored.
    Returns (vectors(word=vec_id, vec), word_key) where ``word_key`` maps a
    token Column to its vocabulary key."""
    n_vec = n_rows(spark, sf, "embeddings")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec"))

    def word_key(w):
        return hash32(w) % n_vec
    return vectors, word_key


def sentence_vectors(spark, sf, only_posts=None) -> tuple[DataFrame, DataFrame]:
    """Sentence encoder stand-in: mean-pooled word vectors (AGG-10) of every
    post (or those of ``only_posts``) and every claim -> (input_id, vec),
    (misinfo_id, vec)."""
    from claimspark.operators.vector_search import load_vocab, wordvec_average
    wv, key = word_vectors(spark, sf)
    vocab = load_vocab(wv)
    p = posts(spark, sf)
    if only_posts is not None:
        p = p.join(only_posts, "input_id", "left_semi")
    pv = wordvec_average(p, wv, id_col="input_id", word_key=key, vocab=vocab)
    cv = wordvec_average(table(spark, sf, "benchmark").withColumnRenamed("item_id", "misinfo_id"),
                         wv, id_col="misinfo_id", word_key=key, vocab=vocab)
    return pv, cv


def tfidf_scores(spark, sf) -> DataFrame:
    """(input_id, misinfo_id, score) for every post/claim pair sharing a term."""
    from claimspark.operators import retrieval as R
    return R.tfidf_cosine(posts(spark, sf), table(spark, sf, "benchmark").withColumnRenamed("item_id", "misinfo_id"),
                          post_id="input_id", claim_id="misinfo_id")


def tfidf_best(spark, sf, k: int = 1) -> DataFrame:
    """TOP-01/04: the ``k`` best claims per post by TF-IDF cosine (ties:
    lower claim id)."""
    from claimspark.operators import claim_index as CI
    best = CI.tfidf_top_k(posts(spark, sf), table(spark, sf, "benchmark").withColumnRenamed("item_id", "misinfo_id"),
                          post_id="input_id", claim_id="misinfo_id", k=k)
    return best.drop("rank") if k == 1 else best


# ----------------------------------------------------------- store views
def io_inputs(spark, sf) -> DataFrame:
    """input table from customer."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("text"),
        F.col("c_mktsegment").alias("source_type"), F.col("c_custkey").cast("string").alias("source_id"))


def io_outputs(spark, sf) -> DataFrame:
    """output table from orders."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("input_id"),
        F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("confidence"))


def li_outputs(spark, sf) -> DataFrame:
    """output table from lineitem (model = return flag)."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("input_id"),
        F.col("l_partkey").alias("misinfo_id"), F.col("l_returnflag").alias("model_id"),
        (F.col("l_linenumber") % 3).cast("bigint").alias("label_id"), F.col("l_discount").alias("confidence"))


SPLIT_TS = "2024-01-11 00:00:00"


def event_keys(spark, sf) -> DataFrame:
    """incoming(batch): events keyed by event_type:user_id, ordered by event_id."""
    return table(spark, sf, "events").select(
        "event_id", "ts", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("source_id"),
        "event_type", "user_id")


def stored_inputs(spark, sf) -> DataFrame:
    """Rows already stored: first event per key before the split day; id =
    that event id."""
    from claimspark.operators.ingest import first_per_key
    e = event_keys(spark, sf).filter(F.col("ts") < F.to_timestamp(F.lit(SPLIT_TS)))
    return first_per_key(e, ["source_id"], "event_id").withColumn("id", F.col("event_id"))


def incoming_inputs(spark, sf) -> DataFrame:
    return event_keys(spark, sf).filter(F.col("ts") >= F.to_timestamp(F.lit(SPLIT_TS)))


def annotation_rows(spark, sf) -> DataFrame:
    """annotation CSV rows from documents ⟕ labels (FIXTURES B)."""
    n_items = n_rows(spark, sf, "benchmark")
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels")
    label = (F.when(F.col("toxic") == 1, "neg").when(F.col("quality") == 1, "pos")
              .when(F.col("toxic").isNotNull(), "na").otherwise(""))
    return d.join(lab, "doc_id", "left").select(
        "doc_id", (F.col("doc_id") % n_items).alias("misconception_id"), F.col("text").alias("tweet"),
        label.alias("label"),
        F.when(F.col("doc_id") % 50 == 0, F.lit("")).otherwise((F.col("doc_id") % 500).cast("string")).alias("tweet_id"))


def tweets(spark, sf) -> DataFrame:
    """tweet JSONL stand-in from events."""
    langs = F.array(F.lit("en"), F.lit("fr"), F.lit("de"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.get(langs, (F.col("event_id") % 3).cast("int")).alias("lang"),
        F.struct(F.col("user_id").cast("string").alias("id_str"), F.col("value").alias("followers_count")).alias("user"),
        F.from_json("props", "k int, note string").alias("props"),
        F.when(F.col("event_type") == "error", F.col("user_id")).alias("retweeted_status"))


def articles(spark, sf) -> DataFrame:
    """article list from pages: title from <h1>, publishedAt day, category
    from the host; pages whose url carries a fragment come back with an
    error code."""
    from claimspark.functions.text import collapse_ws
    p = table(spark, sf, "pages")
    host = F.call_function("parse_url", F.col("url"), F.lit("HOST"))
    return p.select(
        "page_id", "url", collapse_ws(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("title"),
        F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 30).cast("int")), "yyyy-MM-dd")
        .alias("publishedAt"),
        F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("category"),
        host.alias("host"), F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"), "html",
        F.when(F.col("url").contains("#"), F.lit(500)).alias("errorCode"))


CARD_STATUS = ("FALSE:", "MISLEADING:", "No evidence:")


def card_pages(spark, sf) -> DataFrame:
    """fact-check pages: each page's article becomes a card with an id and a
    linked heading of status and title."""
    status = F.get(F.array(*[F.lit(x) for x in CARD_STATUS]), (F.col("page_id") % len(CARD_STATUS)).cast("int"))
    head = F.concat(F.lit('<article id="post-'), F.col("page_id").cast("string"), F.lit('"><header><h2><a href="'),
                    F.col("url"), F.lit('"><span>'), status, F.lit("</span> "))
    html = F.replace(F.replace(F.col("html"), F.lit("<article><h1>"), head), F.lit("</h1>"), F.lit("</a></h2></header>"))
    return table(spark, sf, "pages").select("page_id", html.alias("html"))


def variations(spark, sf) -> DataFrame:
    """RET-10: one row per positive variation with a dense variation id."""
    from claimspark.operators.ingest import dense_ids
    from claimspark.operators.retrieval import explode_variations
    v = explode_variations(claims(spark, sf), id_col="id").select(
        F.col("id").alias("item_id"), F.col("var_idx").cast("bigint"), F.col("variation").alias("line"))
    return dense_ids(v, ["item_id", "var_idx"], 0, "vid")


# ------------------------------------------------------- training inputs
def _h(*parts) -> Column:
    return hash32(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def wiki(spark, sf) -> DataFrame:
    """wiki dump: id = string(doc_id); lines = 'i<TAB>line' joined by newlines."""
    d = table(spark, sf, "documents")
    numbered = F.transform(F.split(F.col("text"), "\n"), lambda l, i: F.concat(i.cast("string"), F.lit("\t"), l))
    return d.select(F.col("doc_id").cast("string").alias("id"), F.array_join(numbered, "\n").alias("lines"))


def fever_claims(spark, sf) -> DataFrame:
    """FEVER claims from benchmark: two evidence sets of 1-2 (page, line);
    pages drawn from 1.05 x the number of documents, so some are missing."""
    n_pages = n_rows(spark, sf, "documents") * 105 // 100
    i = F.col("item_id")
    labels = F.array(F.lit("SUPPORTS"), F.lit("REFUTES"), F.lit("NOT ENOUGH INFO"))
    ev = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda s: F.transform(
        F.sequence(F.lit(0), (_h(i, "s", s) % 2).cast("int")),
        lambda j: F.struct((_h(i, s, j) % n_pages).cast("string").alias("page"),
                           (_h(i, s, j, "l") % 3).cast("int").alias("line"))))
    return table(spark, sf, "benchmark").select(
        i.alias("id"), F.col("text").alias("claim"), F.get(labels, (i % 3).cast("int")).alias("label"),
        ev.alias("evidence"))


def scifact(spark, sf) -> tuple[DataFrame, DataFrame]:
    """SciFact corpus (doc_id, abstract = lines) and claims with an
    evidence map doc_id -> [{sentences, label}] over existing documents;
    every fifth claim has no evidence and two cited documents."""
    corpus = table(spark, sf, "documents").select("doc_id", F.split(F.col("text"), "\n").alias("abstract"))
    n_docs = n_rows(spark, sf, "documents")
    i = F.col("item_id")
    b = table(spark, sf, "benchmark").select(i, F.col("text").alias("claim"))
    # evidence documents (1-2 per claim), their abstract length, then 1-2 sets of 1-2 sentences
    ed = (b.filter(i % 5 != 0)
           .select(i, F.explode(F.sequence(F.lit(0), (_h(i, "d") % 2).cast("int"))).alias("j"))
           .select(i, (_h(i, "d", F.col("j")) % n_docs).alias("doc_id")).distinct()
           .join(corpus.select("doc_id", F.size("abstract").alias("n")), "doc_id"))
    d = F.col("doc_id")
    sets = F.transform(F.sequence(F.lit(0), (_h(i, d, "n") % 2).cast("int")), lambda s: F.struct(
        F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), (_h(i, d, s, "m") % 2).cast("int")),
                                                  lambda t: (_h(i, d, s, t) % F.col("n")).cast("int")))).alias("sentences"),
        F.when(_h(i, d) % 2 == 0, F.lit("SUPPORT")).otherwise(F.lit("CONTRADICT")).alias("label")))
    evmap = ed.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct(d, sets))).alias("evidence"))
    cited = F.array((_h(i, "c0") % n_docs), (_h(i, "c1") % n_docs))
    claims_ = (b.join(evmap, "item_id", "left")
                .select(i.alias("id"), "claim",
                        F.coalesce("evidence", F.create_map().cast("map<bigint,array<struct<sentences:array<int>,label:string>>>"))
                        .alias("evidence"),
                        F.when(i % 5 == 0, cited).otherwise(F.array().cast("array<bigint>")).alias("cited_doc_ids")))
    return corpus, claims_


def nli_pairs(spark, sf) -> DataFrame:
    """NLI pairs from conversations: a user turn and the next turn of the
    same conversation; gold label from a hash of (conv_id, turn)."""
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("sentence1"))
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2"))
    labels = F.array(*[F.lit(x) for x in ("entailment", "contradiction", "neutral", "-")])
    return u.join(a, ["conv_id", "turn"]).select(
        "conv_id", "turn", "sentence1", "sentence2",
        F.get(labels, (_h(F.col("conv_id"), F.col("turn")) % 4).cast("int")).alias("gold_label"))
