"""Literal cases mirroring the reference's unit tests (FIXTURES A3-A6)."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.functions.vectors import cosine, f1_of
from claimspark.operators import vector_search as VS
from claimspark.operators.common import top_k
from claimspark.operators.ingest import overlay
from claimspark.functions.misc import map_overlay, drop_blank_values, json_overlay


def _vocab(spark):
    # three orthogonal unit vectors in R^4, one per word
    return spark.createDataFrame([("ea", [1.0, 0.0, 0.0, 0.0]), ("eb", [0.0, 1.0, 0.0, 0.0]),
                                  ("ec", [0.0, 0.0, 1.0, 0.0])], "word string, vec array<double>")


def test_softmatch_literal_matrices(spark):
    seqs = spark.createDataFrame([(1, "ea eb"), (2, "ea eb ec")], "id long, text string")
    # candidate 1 vs reference 2: P = 1, R = 2/3, F1 = 0.8 ; candidate 2 vs reference 1: P = 2/3, R = 1
    res = VS.token_softmatch_top_k(seqs, seqs.withColumnRenamed("id", "rid"), _vocab(spark), post_id="id",
                                   claim_id="rid", k=5).collect()
    m = {(r["id"], r["rid"]): (r["precision"], r["recall"], r["f1"]) for r in res}
    assert m[(1, 1)] == pytest.approx((1, 1, 1))
    assert m[(1, 2)] == pytest.approx((1, 2 / 3, 0.8))
    assert m[(2, 1)] == pytest.approx((2 / 3, 1, 0.8))
    assert m[(2, 2)] == pytest.approx((1, 1, 1))
    assert len(m) == 4


def test_softmatch_general_plan_matches(spark, monkeypatch):
    seqs = spark.createDataFrame([(1, "ea eb"), (2, "ea eb ec")], "id long, text string")
    monkeypatch.setattr(VS, "VOCAB_PLAN_MAX_BYTES", 8)  # force the per-post plan
    res = VS.token_softmatch_top_k(seqs, seqs.withColumnRenamed("id", "rid"), _vocab(spark), post_id="id",
                                   claim_id="rid", k=5).collect()
    m = {(r["id"], r["rid"]): (r["precision"], r["recall"]) for r in res}
    assert m[(2, 1)] == pytest.approx((2 / 3, 1))


def test_softmatch_p_r_symmetry(spark):
    """P(a, b) = R(b, a)."""
    seqs = spark.createDataFrame([(1, "ea eb eb"), (2, "ea ec"), (3, "eb ec ec ea")], "id long, text string")
    res = VS.token_softmatch_top_k(seqs, seqs.withColumnRenamed("id", "rid"), _vocab(spark), post_id="id",
                                   claim_id="rid", k=5).collect()
    m = {(r["id"], r["rid"]): (r["precision"], r["recall"]) for r in res}
    for (a, b), (p, _) in m.items():
        assert p == pytest.approx(m[(b, a)][1])


def test_cosine_orthogonal_identity(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, -1.0])], "id long, vec array<double>")
    pairs = df.alias("a").join(df.alias("b")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"),
                                                     cosine(F.col("a.vec"), F.col("b.vec")).alias("c"))
    m = {(r["i"], r["j"]): r["c"] for r in pairs.collect()}
    assert m[(0, 0)] == pytest.approx(1) and m[(1, 1)] == pytest.approx(1)
    assert m[(0, 1)] == pytest.approx(0) and m[(1, 0)] == pytest.approx(0)
    top = VS.cosine_top_k(df, df.withColumnRenamed("id", "cid"), q_id="id", c_id="cid", k=1).collect()
    assert {(r["id"], r["cid"]) for r in top} == {(0, 0), (1, 1)}


def test_dimension_mismatch_raises(spark):
    a = spark.createDataFrame([(0, [1.0, 1.0])], "id long, vec array<double>")
    b = spark.createDataFrame([(0, [1.0, 1.0, 0.0])], "cid long, vec array<double>")
    with pytest.raises(Exception, match="dimensions"):
        VS.cosine_top_k(a, b, q_id="id", c_id="cid", k=1).collect()


def test_topk_of_score_rows(spark):
    rows = [(r, i, float(i + 1 + r)) for r in range(2) for i in range(6)]
    df = spark.createDataFrame(rows, "row long, idx long, score double")
    out = top_k(df, "row", [F.col("score").desc(), F.col("idx").asc()], 5).collect()
    for r in range(2):
        idx = [x["idx"] for x in sorted([x for x in out if x["row"] == r], key=lambda x: x["rank"])]
        assert idx == [5, 4, 3, 2, 1]


def test_overlay_long_and_map(spark):
    d = spark.createDataFrame([(1, "test", "yay"), (1, "10", "a")], "entity long, key string, value string")
    o = spark.createDataFrame([(1, "test", "wow"), (1, "new", "b"), (1, "10", "")],
                              "entity long, key string, value string")
    got = {(r["key"], r["value"]) for r in overlay(d, o).collect()}
    assert got == {("test", "wow"), ("10", "a"), ("new", "b")}
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": ""})], "x map<string,string>, y map<string,string>")
    r = m.select(map_overlay(drop_blank_values("x"), drop_blank_values("y")).alias("z")).first()["z"]
    assert r == {"a": "1", "b": "3"} or r == {"a": "1", "b": "3", "c": None}


def test_json_overlay_at_any_depth(spark):
    cases = [('{"a":{"b":{"c":1,"d":2},"e":3},"f":4}', '{"a":{"b":{"c":9,"x":{"y":1}}},"g":[1]}',
              {"a": {"b": {"c": 9, "d": 2, "x": {"y": 1}}, "e": 3}, "f": 4, "g": [1]}),
             ('{"a":{"b":1}}', '{"a":2}', {"a": 2}), ('{"a":2}', '{"a":{"b":1}}', {"a": {"b": 1}}),
             ('{"a":[1,2]}', '{"a":[3]}', {"a": [3]}), ('{"a":{"b":1}}', '{"a":{}}', {"a": {"b": 1}}),
             ('{"a":1}', '{"a":null}', {"a": None}), (None, '{"a":1}', {"a": 1}), ('{"a":"\u00e9"}', None, {"a": "\u00e9"}),
             (None, None, None)]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(cases)], "i int, x string, y string")
    got = {r["i"]: r["z"] and json.loads(r["z"]) for r in rows.select("i", json_overlay("x", "y").alias("z")).collect()}
    assert got == {i: z for i, (_, _, z) in enumerate(cases)}


def test_f1_zero_guard(spark):
    r = spark.range(1).select(f1_of(F.lit(0.0), F.lit(0.0)).alias("f")).first()["f"]
    assert r is None or math.isnan(r)


def test_stance_rules(spark):
    from claimspark.functions.vectors import argmax, combine_stages, forced_binary, softmax
    from claimspark.operators.stance import relevance
    df = spark.createDataFrame([(0.5, [1.0, 1.0, 5.0], 0), (float("nan"), [0.0, 2.0, 1.0], 0),
                                (0.3, [3.0, 1.0, 0.0], 2), (None, [1.0, 1.0, 1.0], 0)],
                               "s double, l array<double>, rel int")
    r = df.select(relevance(df, "s").alias("r"), argmax(softmax("l")).alias("a"), forced_binary("l").alias("f"),
                  combine_stages("rel", softmax("l")).alias("c"),
                  F.aggregate(softmax("l"), F.lit(0.0), lambda a, x: a + x).alias("sum")).collect()
    assert [x["r"] for x in r] == [True, False, False, False]      # NaN and NULL are irrelevant (Q20)
    assert [x["a"] for x in r] == [2, 1, 0, 0]                     # first maximum
    assert [x["f"] for x in r] == [0, 1, 0, 0]                     # ties -> 0 (Q18)
    assert [x["c"] for x in r] == [0, 1, 2, 0]
    assert all(abs(x["sum"] - 1) < 1e-12 for x in r)


def test_cosine_top_k_chunked_catalogue(spark, monkeypatch):
    import random
    rnd = random.Random(3)
    q = spark.createDataFrame([(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(40)], "id long, vec array<double>")
    c = spark.createDataFrame([(100 + j, [rnd.uniform(-1, 1) for _ in range(8)]) for j in range(60)],
                              "cid long, vec array<double>")
    one = {(r["id"], r["rank"]): r["cid"] for r in VS.cosine_top_k(q, c, q_id="id", c_id="cid", k=3).collect()}
    monkeypatch.setattr(VS, "MAX_BROADCAST_BYTES", 0)   # forces the cogrouped plan
    monkeypatch.setattr(VS, "TILE_BYTES", 60 * 8 * 8 // 5)   # in 5 x 4 blocks
    many = {(r["id"], r["rank"]): r["cid"] for r in VS.cosine_top_k(q, c, q_id="id", c_id="cid", k=3).collect()}
    assert one == many and len(one) == 120
    none = VS.cosine_top_k(q, c.limit(0), q_id="id", c_id="cid", k=3)
    assert none.count() == 0 and none.columns == ["id", "cid", "score", "rank"]


def test_tiles_give_the_same_top_k(monkeypatch):
    rng = np.random.default_rng(4)
    q, c = rng.normal(size=(30, 6)), np.repeat(rng.normal(size=(40, 6)), 2, axis=0)   # every score tied
    ids = np.arange(80)
    whole = VS._block_top_k(ids[:30], q, ids, c, 7, VS.cosine_scores, True)
    monkeypatch.setattr(VS, "TILE_BYTES", 8 * 256 * 9)   # nine columns a tile
    tiled = VS._block_top_k(ids[:30], q, ids, c, 7, VS.cosine_scores, True)
    assert all(np.array_equal(a, b) for a, b in zip(whole[:2], tiled[:2])) and len(whole[0]) == 210
    s = np.round(VS.cosine_scores(q, c), 9)
    for i in range(30):
        want = [j for j in sorted(ids, key=lambda j: (-s[i, j], j)) if j != i][:7]
        assert whole[1][whole[0] == i].tolist() == want


def test_copies_do_not_flood_the_claim_side(spark):
    posts = spark.createDataFrame([(i, "same words here") for i in range(300)] + [(900, "other words")], "id long, text string")
    few = sorted(r["id"] for r in VS.first_copies(posts, "id", "text", 5).collect())
    assert few == [0, 1, 2, 3, 4, 900]
