"""Plans whose cost must not grow with a fixed setting: text parts, soft
matching, averages, dense search, trained weights, sketches."""

import io
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimspark.functions.text import word_tokens
from claimspark.operators import claim_index as CI
from claimspark.operators import common as C
from claimspark.operators import gradient as GR
from claimspark.operators import vector_search as VS
from claimspark.plans import catalogue as CAT
from claimspark.plans import fixtures as FX

WORDS = [f"w{i}" for i in range(40)]


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def texts(n, seed, size=12):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS, size))) for i in range(n)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(w, [float(x) for x in rng.normal(size=4)]) for w in WORDS],
                                 "word string, vec array<float>").cache()


def test_parts_of_texts_grow_with_the_text(spark, monkeypatch):
    posts = spark.createDataFrame(texts(60, 1), "id long, text string")
    few = C.by_key(posts, "id", text="text").rdd.getNumPartitions()
    monkeypatch.setattr(C, "PART_TEXT_BYTES", 200)
    many = C.by_key(posts, "id", text="text").rdd.getNumPartitions()
    assert few <= 8 and many >= 20
    assert C.by_key(posts, "id", text="text").count() == 60


def rows(df, names):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


@pytest.mark.parametrize("per", ["post", "claim"])
def test_soft_match_ships_no_vectors_though_similarities_exceed_the_limit(spark, vectors, monkeypatch, per):
    posts = spark.createDataFrame(texts(30, 1), "pid long, text string")
    claims = spark.createDataFrame(texts(9, 2), "cid long, text string")
    args = dict(post_id="pid", claim_id="cid", k=3, per=per, tokenizer=word_tokens)
    names = ["pid", "cid", "precision", "recall", "f1"]
    with monkeypatch.context() as m:
        m.setattr(VS, "VOCAB_PLAN_MAX_BYTES", 8)
        want = rows(VS.token_softmatch_top_k(posts, claims, vectors, **args), names)
    # the word vectors fit, words x claim words do not
    monkeypatch.setattr(VS, "VOCAB_PLAN_MAX_BYTES", 40 * 4 * 8)
    monkeypatch.setattr(VS, "_softmatch_catalogue", None)
    assert rows(VS.token_softmatch_top_k(posts, claims, vectors, **args), names) == want


def test_similarity_store_renews_itself(monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(50, 4)).astype(np.float32)
    cv, offs, cnt, cids = np.arange(10), np.array([0, 4]), np.ones(10), np.arange(2)
    monkeypatch.setattr(VS, "STORE_BYTES", 8 * 12 * 7)  # seven words
    store = VS._Similarities(("k", v, cv, np.arange(10), offs, cnt, cids))
    assert len(store.sim) == 7
    u = VS._unit(v.astype(float))
    for _ in range(20):
        words = rng.choice(50, rng.integers(1, 30), replace=False)
        counts = rng.integers(1, 4, len(words))
        sim = u[words] @ u[cv].T
        p, r = store.score(words, counts)
        assert np.allclose(p, counts @ np.maximum.reduceat(sim, offs, axis=1) / counts.sum())
        assert np.allclose(r, np.add.reduceat(sim.max(axis=0), offs) / [4, 6])


def test_averages_stay_out_of_python(spark, vectors):
    docs = spark.createDataFrame([(1, "w1 w1 w2"), (2, "zzz"), (3, None), (1, "w3")], "id long, text string")
    out = VS.wordvec_average(docs, vectors, id_col="id")
    assert "InPandas" not in plan(out)
    got = {r["id"]: r["vec"] for r in out.collect()}
    v = {r["word"]: np.array(r["vec"]) for r in vectors.collect()}
    assert np.allclose(got[1], (2 * v["w1"] + v["w2"] + v["w3"]) / 4)
    assert got[2] == got[3] == [0.0] * 4


def test_dense_catalogue_beyond_a_worker_is_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    e = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in range(50)], "a long, vec array<float>")
    args = dict(q_id="a", c_id="b", k=4, exclude_self=True)
    want = rows(VS.cosine_top_k(e, e.withColumnRenamed("a", "b"), **args), ["a", "b", "score", "rank"])
    monkeypatch.setattr(VS, "CATALOGUE_MAX_BYTES", 100)
    blocks = VS.cosine_top_k(e, e.withColumnRenamed("a", "b"), **args)
    assert "FlatMapCoGroupsInPandas" in plan(blocks)
    assert rows(blocks, ["a", "b", "score", "rank"]) == want


def test_batches_of_posts_are_scored_in_slices():
    pdf = pd.DataFrame({"pid": range(5), "h": [[1, 2, 3], None, [4], [5, 6], []]})
    assert pd.concat(list(CI._slices(pdf, 3)))["pid"].tolist() == list(range(5))
    assert max(sum(len(t or []) for t in s["h"]) for s in CI._slices(pdf, 3)) <= 5
    assert len(list(CI._slices(pdf, 3))) > 1


def test_many_weights_are_not_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = [(i, f"k{j}", float(rng.normal())) for i in range(30) for j in rng.choice(8, 3, replace=False)]
    feats = GR.with_bias(spark.createDataFrame(data, "id long, key string, x double"), spark.range(30))
    labels = spark.range(30).select("id", (F.col("id") % 3).alias("label"))
    want = {r["key"]: (r["w0"], r["w1"], r["w2"]) for r in GR.fit_softmax(feats, labels, rounds=5, l2=0.01).collect()}
    monkeypatch.setattr(GR, "BROADCAST_MAX_BYTES", 0)

    def never(*_):
        raise AssertionError("weights broadcast")
    monkeypatch.setattr(GR.F, "broadcast", never)
    got = {r["key"]: (r["w0"], r["w1"], r["w2"]) for r in GR.fit_softmax(feats, labels, rounds=5, l2=0.01).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_no_sketch_per_user(spark, monkeypatch):
    e = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 2), ("a", 3)], "event_type string, user_id long")
    monkeypatch.setattr(FX, "table", lambda *_: e)
    out = CAT.QUERIES["unique_counts_approx"](spark, "")
    assert sorted(map(tuple, out.collect())) == [("a", 4, 2, True), ("b", 1, 1, True)]
    keys = [p for p in plan(out).split("\n\n") if "approx_count_distinct" in p and "Keys" in p]
    assert keys and not any("user_id" in line for p in keys for line in p.splitlines() if line.startswith("Keys"))


def test_stream_files_grow_with_the_input(spark, monkeypatch):
    posts = spark.range(400).select(F.col("id").alias("input_id"), F.lit("a").alias("text")).repartition(10, "input_id")
    monkeypatch.setattr(FX, "posts", lambda *_: posts)
    seen = {}

    def stage(df, path, n):
        seen["files"] = n
        raise InterruptedError
    monkeypatch.setattr(CAT.SM, "stage_files", stage)
    with pytest.raises(InterruptedError):
        CAT.QUERIES["stream_stance"](spark, "")
    assert seen["files"] == 10


@pytest.mark.parametrize("per,most", [("post", 256 << 20), ("claim", 256 << 20), ("post", 1 << 20), ("claim", 1 << 20)])
def test_word_vectors_beyond_the_driver_are_not_collected(spark, vectors, monkeypatch, per, most):
    """70 000 vectors of 64 numbers (18 MB), 40 of them of the texts' words;
    one word has two vectors, one none, and ids come twice or are null."""
    posts = spark.createDataFrame(texts(30, 1) + texts(5, 9) + [(None, "w1 w2 w2"), (77, "zz"), (78, None)],
                                  "pid long, text string")
    claims = spark.createDataFrame(texts(9, 2) + [(3, "w7 w8"), (50, "zz")], "cid long, text string")
    args = dict(post_id="pid", claim_id="cid", k=3, per=per, tokenizer=word_tokens)
    names = ["pid", "cid", "precision", "recall", "f1"]
    some = vectors.where("word <> 'w5'").select("word", F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.element_at("vec", (i % 4 + 1).cast("int")) * (1 + i / 9)).cast("array<float>").alias("vec"))
    some = some.union(some.where("word = 'w2'").select("word", F.reverse("vec"))).cache()
    want = rows(VS.token_softmatch_top_k(posts, claims, some, **args).na.fill(-1, "pid"), names)
    rest = spark.range(70_000).selectExpr("concat('x', id) word", "array_repeat(CAST(id AS FLOAT), 64) vec")
    monkeypatch.setattr(VS, "_collect_vocab", None)
    monkeypatch.setattr(VS, "VOCAB_PLAN_MAX_BYTES", most)  # in blocks, or joined by Spark
    monkeypatch.setattr(VS, "STORE_BYTES", 64 * 150)  # words and posts in blocks of a few
    got = rows(VS.token_softmatch_top_k(posts, claims, some.union(rest), **args).na.fill(-1, "pid"), names)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-8)
