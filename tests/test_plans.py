"""Plan-shape checks: sparse scorers are term joins,
the post side is read and shuffled once, filters and columns reach the scan."""

import contextlib
import io

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["tfidf_top5", "tfidf_scores", "bm25_zero_filled", "retrieval_report",
                                  "best_variation_per_claim", "two_stage_label", "pipeline_agree_disagree",
                                  "wordvec_cosine_top5", "token_softmatch_prf", "insert_if_new",
                                  "annotation_csv_load", "fever_convert", "scifact_examples"])
def test_no_pair_grid(spark, name):
    p = plan_of(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_flagship_reads_and_shuffles_posts_once(spark):
    p = plan_of(E.queries()["tfidf_top5"](spark, SF))
    assert p.count("documents.parquet") == 1
    assert p.count("hashpartitioning(pid") == 1


def test_pushdown_and_pruning(spark):
    p = plan_of(E.queries()["outputs_by_model_input_misinfo"](spark, SF))
    assert "EqualTo(l_returnflag,R)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_discount:double,l_returnflag:string>" in p
    p2 = plan_of(E.queries()["pairs_by_date"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in p2 and "LessThan(o_orderdate" in p2


def test_bucketed_posts_need_no_exchange(spark, tmp_path):
    """A posts table bucketed by id feeds TF-IDF without any post-side shuffle."""
    from pyspark.sql import functions as F
    from claimspark.operators import retrieval as R
    from claimspark.plans import fixtures as FX
    posts = FX.posts(spark, SF).select("input_id", "text")
    spark.sql("DROP TABLE IF EXISTS posts_bucketed")
    posts.write.bucketBy(4, "input_id").mode("overwrite").option("path", str(tmp_path / "pb")) \
        .saveAsTable("posts_bucketed")
    pb = spark.table("posts_bucketed")
    claims = FX.table(spark, SF, "benchmark")
    s = R.tfidf_cosine(pb.withColumnRenamed("input_id", "pid"), claims, post_id="pid", claim_id="item_id",
                       posts_partitioned=True)
    p = plan_of(s)
    assert "hashpartitioning(pid" not in p
    ref = R.tfidf_cosine(posts.withColumnRenamed("input_id", "pid"), claims, post_id="pid", claim_id="item_id")
    a = {(r["pid"], r["item_id"]): round(r["score"], 12) for r in s.collect()}
    b = {(r["pid"], r["item_id"]): round(r["score"], 12) for r in ref.collect()}
    assert a == b
    spark.sql("DROP TABLE IF EXISTS posts_bucketed")


def test_store_anti_join_broadcasts_new_keys(spark):
    """Few new keys against a store: the keys are broadcast into a semi join
    on the store (no shuffle of the store), then removed by a broadcast anti join."""
    from claimspark.operators.ingest import anti_join_stored
    store = spark.range(0, 50_000).selectExpr("CAST(id AS STRING) AS k")
    new = spark.createDataFrame([("1",), ("x",)], "k string")
    out = anti_join_stored(new, store, ["k"])
    p = plan_of(out)
    assert "BroadcastHashJoin LeftSemi" in p and "BroadcastHashJoin LeftAnti" in p
    assert [r["k"] for r in out.collect()] == ["x"]


@pytest.mark.parametrize("name", ["wordvec_cosine_top5", "token_softmatch_prf", "embedding_cosine_top5"])
def test_dense_top_k_ranked_inside_tasks(spark, name):
    """Single-chunk dense scorers rank inside the Arrow task: no window and
    no exchange after the block scorer."""
    p = plan_of(E.queries()[name](spark, SF))
    head = p.split("MapInPandas")[0]
    assert "Window" not in head and "Exchange" not in head
