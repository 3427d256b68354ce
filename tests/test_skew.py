"""Hot keys (one key holding a third of all rows) are combined map-side or
split before the shuffle."""

import contextlib
import io

from pyspark.sql import functions as F

from claimspark.operators import ingest as IG
from claimspark.operators import training as TR


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_first_per_key_combines_map_side(spark):
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
                               .alias("k"), F.col("id").alias("seq"), (F.col("id") * 2).alias("v"))
    out = IG.first_per_key(df, ["k"], "seq")
    p = plan_of(out)
    assert "partial_min_by" in p            # aggregated before the exchange
    hot = out.filter(F.col("k") == "hot").first()
    assert hot["seq"] == 0 and out.count() == 1 + 2 * n // 3


def test_hot_question_negatives_are_chunked(spark):
    ctx = spark.range(300).select(F.when(F.col("id") < 200, F.lit("hot")).otherwise(F.lit("cold")).alias("q"),
                                  F.col("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    out = TR.retriever_set(ctx, question="q", ctx_id="id", text="text", neg_scale=1000.0, seed="s")
    p = plan_of(out)
    assert "hashpartitioning(question" in p  # chunk list spread before the inner explode
    negs = out.filter(F.col("kind") == "negative")
    assert negs.filter(F.col("question") == "hot").count() == 200_000
    # the slots cycle over all contexts of the other question, and only those
    assert negs.filter(F.col("question") == "hot").select("ctx_id").distinct().count() == 100
    assert negs.join(ctx, negs["ctx_id"] == ctx["id"]).filter("q = question").count() == 0
