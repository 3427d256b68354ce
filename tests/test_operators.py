"""Invariants of the relational operators."""

import pytest
from pyspark.sql import functions as F

from claimspark.operators import evaluate as EV
from claimspark.operators import ingest as IG
from claimspark.operators import relational as RL
from claimspark.operators import retrieval as R
from claimspark.functions.text import glove_tokens, word_tokens, strip_accents, drop_line_number
from claimspark.functions.text import word_tokens as VS_TOKENS


def test_average_rank_ties(spark):
    df = spark.createDataFrame([("m", 1, 1, 0.5), ("m", 1, 2, 0.5), ("m", 1, 3, 0.9), ("m", 1, 4, None)],
                               "model_id string, input_id long, misinfo_id long, confidence double")
    got = {r["misinfo_id"]: r["rank"] for r in EV.average_rank(df).collect()}
    assert got == {1: 2.5, 2: 2.5, 3: 1.0, 4: None}


def test_insert_if_new_idempotent(spark):
    stored = spark.createDataFrame([("a", 1)], "source_id string, id long")
    inc = spark.createDataFrame([("a", 10), ("b", 11), ("b", 12), ("c", 13)], "source_id string, seq long")
    new, counts = IG.insert_if_new(inc, stored, key=["source_id"], order="seq")
    rows = sorted((r["source_id"], r["seq"], r["id"]) for r in new.collect())
    assert rows == [("b", 11, 2), ("c", 13, 3)]
    c = counts.first()
    assert (c["given"], c["inserted"], c["success"]) == (4, 2, False)
    stored2 = stored.unionByName(new.select("source_id", "id"))
    new2, _ = IG.insert_if_new(inc, stored2, key=["source_id"], order="seq")
    assert new2.count() == 0


def test_dense_ids_consecutive(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    out = IG.dense_ids(df, ["k"], 10, "pos").collect()
    assert sorted(r["pos"] for r in out) == list(range(11, 1011))
    assert all(r["pos"] == r["k"] + 11 for r in out)


def test_pairs_by_date_half_open(spark):
    i = spark.createDataFrame([(1, "t", "s")], "id long, text string, source_type string")
    o = spark.createDataFrame([(10, 1, "1900-01-01 00:00:00"), (11, 1, "2000-01-01 00:00:00"), (12, 1, "2100-01-01 00:00:00")],
                              "id long, input_id long, date string").withColumn("date", F.to_timestamp("date"))
    p = RL.input_output_pairs(i, o)
    assert p.count() == 3
    assert RL.pairs_by_date(p, "1900-01-01", "2100-01-01").count() == 2
    assert RL.pairs_by_date(p, None, "2000-01-01").count() == 1
    assert [r["output_id"] for r in RL.recent_pairs(p, 1).collect()] == [12]


def test_confusion_total_and_hits_monotone(spark):
    gold = spark.createDataFrame([(i, i % 3, i % 3) for i in range(30)], "input_id long, misinfo_id long, gold_label long")
    preds = spark.createDataFrame([("m", i, i % 3, (i * 7) % 3) for i in range(30)],
                                  "model_id string, input_id long, misinfo_id long, label_id long")
    cells = EV.confusion_cells(gold, preds)
    assert EV.confusion_long(cells).agg(F.sum("n")).first()[0] == 30
    preds2 = spark.createDataFrame([("m", i, c, float((i * c) % 7)) for i in range(30) for c in range(3)],
                                   "model_id string, input_id long, misinfo_id long, confidence double")
    rep = EV.retrieval_report(gold, preds2, ["m"]).first()
    assert rep["both_hits_1"] <= rep["both_hits_5"] <= rep["both_hits_10"]


def test_tokenisers(spark):
    r = spark.createDataFrame([("Hello, WORLD! it's a-b \\\\x  ",)], "t string").select(
        glove_tokens("t").alias("g"), word_tokens("t").alias("w"), strip_accents(F.lit("Éléphant çà")).alias("a"),
        drop_line_number(F.lit("3\tfoo\tbar")).alias("d"), drop_line_number(F.lit("plain")).alias("e")).first()
    assert r["g"] == ["hello", "world", "its", "a-b", "x"]
    assert r["w"] == ["hello", "world", "it"]
    odd = "a\u00a0b\u2003c"
    assert spark.createDataFrame([(odd,)], "t string").select(glove_tokens("t").alias("g")).first()["g"] == odd.split()
    folds = spark.createDataFrame([("\u1ebf\ufb01\uff21\u01c4 e\u0301",), (None,)], "t string").select(strip_accents("t").alias("a"))
    assert [x["a"] for x in folds.collect()] == ["efiADZ e", None]
    assert r["a"] == "Elephant ca"
    assert r["d"] == "foo bar" and r["e"] == "plain"


def test_tfidf_matches_refit(spark):
    """Closed form equals refitting smooth-idf TF-IDF on (claims + post)."""
    import math
    import re
    from collections import Counter
    claims = [(0, "the cat sat"), (1, "dogs bark loudly"), (2, "the cat and the dog")]
    posts = [(10, "the cat barked at the dog"), (11, "nothing shared here")]
    cdf = spark.createDataFrame(claims, "item_id long, text string")
    pdf = spark.createDataFrame(posts, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in
           R.tfidf_cosine(pdf, cdf, post_id="doc_id", claim_id="item_id").collect()}

    def vec(doc, corpus):
        n = len(corpus)
        df = Counter(t for d in corpus for t in set(re.findall(r"\w{2,}", d.lower())))
        tf = Counter(re.findall(r"\w{2,}", doc.lower()))
        v = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}
    for pid, ptxt in posts:
        corpus = [c for _, c in claims] + [ptxt]
        pv = vec(ptxt, corpus)
        for cid, ctxt in claims:
            cv = vec(ctxt, corpus)
            exp = sum(pv[t] * cv.get(t, 0.0) for t in pv)
            assert got.get((pid, cid), 0.0) == pytest.approx(exp, abs=1e-12)


def test_wordvec_average_both_plans(spark, monkeypatch):
    from claimspark.operators import vector_search as VS
    vecs = spark.createDataFrame([("aa", [1.0, 0.0]), ("bb", [0.0, 2.0])], "word string, vec array<double>")
    docs = spark.createDataFrame([(1, "aa bb bb"), (2, "zz"), (3, "aa")], "id long, text string")
    small = {r["id"]: r["vec"] for r in VS.wordvec_average(docs, vecs, id_col="id").collect()}
    monkeypatch.setattr(VS, "VOCAB_PLAN_MAX_BYTES", 8)
    big = {r["id"]: list(r["vec"]) for r in VS.wordvec_average(docs, vecs, id_col="id").collect()}
    for out in (small, big):
        assert out[1] == pytest.approx([1 / 3, 4 / 3])
        assert out[2] == pytest.approx([0.0, 0.0])
        assert out[3] == pytest.approx([1.0, 0.0])


def test_seed_yaml_and_id_lists(spark, tmp_path):
    from pyspark.sql import types as T
    from claimspark.sources import files as SR
    y = tmp_path / "label.yaml"
    y.write_text("table_class: Label\nrecords:\n  - id: 0\n    name: positive\n  - id: 1\n    name: negative\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    assert [tuple(r) for r in SR.read_seed_yaml(spark, str(y), schema).collect()] == [(0, "positive"), (1, "negative")]
    f = tmp_path / "ids.txt"
    f.write_text("  12 \n\n7\n")
    assert sorted(r["id"] for r in SR.read_id_lists(spark, str(f)).collect()) == ["12", "7"]


def test_stream_dedup_forever_sequential(spark, tmp_path):
    """Keys seen in an earlier micro-batch are not appended again."""
    from claimspark.streaming import streams as SM
    schema = "category string, url string, seq long"
    src = tmp_path / "in"
    spark.createDataFrame([("a", "u1", 1), ("a", "u1", 2)], schema).coalesce(1).write.parquet(str(src / "b1"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
    table = str(tmp_path / "table")
    SM.dedup_forever(stream, table, ["category", "url"], "seq", checkpoint=str(tmp_path / "ck"))
    spark.createDataFrame([("a", "u1", 3), ("b", "u2", 4)], schema).coalesce(1).write.parquet(str(src / "b2"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
    SM.dedup_forever(stream, table, ["category", "url"], "seq", checkpoint=str(tmp_path / "ck"))
    got = sorted(tuple(r) for r in spark.read.parquet(table).collect())
    assert got == [("a", "u1", 1), ("b", "u2", 4)]


def test_ordered_digest_levels(spark):
    import hashlib
    lines = [(i, f"line {i}") for i in range(11)]
    df = spark.createDataFrame(lines, "k long, t string")
    got = IG.ordered_digest(df, ["k"], "t", bucket_rows=2).first()

    def md5(s):
        return hashlib.md5(s.encode()).hexdigest()
    level = [md5(t) for _, t in lines]
    level = [md5("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
    while len(level) > 2:
        level = [md5("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
    assert got["digest"] == md5("".join(level)) and got["n_lines"] == 11


def test_retriever_set_cycles(spark):
    from claimspark.operators import training as TR
    ctx = spark.createDataFrame([("q1", i, f"t{i}") for i in range(5)] + [("q2", 9, "t9")],
                                "q string, id long, text string")
    out = TR.retriever_set(ctx, question="q", ctx_id="id", text="text", neg_scale=3.0, seed="s").collect()
    negs = [r for r in out if r["kind"] == "negative"]
    assert len([r for r in negs if r["question"] == "q1"]) == 15 and len([r for r in negs if r["question"] == "q2"]) == 3
    assert len([r for r in out if r["kind"] == "positive"]) == 6
    own = {(r["question"], r["ctx_id"]) for r in out if r["kind"] == "positive"}
    assert not own & {(r["question"], r["ctx_id"]) for r in negs}


def test_softmatch_plans_agree_on_fixture(spark, monkeypatch):
    """The vocabulary plan and the general plan give the same top-k on real
    posts and claims (sf0.001)."""
    from claimspark.operators import vector_search as VS
    from claimspark.plans import fixtures as FX
    sf = "/root/testdata/sf0.001"
    wv, key = FX.word_vectors(spark, sf)
    posts, claims = FX.posts(spark, sf), FX.table(spark, sf, "benchmark")

    def run():
        out = VS.token_softmatch_top_k(posts, claims, wv, post_id="input_id", claim_id="item_id", k=3, word_key=key)
        return {(r["input_id"], r["rank"]): (r["item_id"], round(r["f1"], 9)) for r in out.collect()}
    fast = run()
    monkeypatch.setattr(VS, "VOCAB_PLAN_MAX_BYTES", 8)
    general = run()
    assert fast == general and len(fast) > 0
    # a claim side above the broadcast limit is scored in blocks of claims
    monkeypatch.setattr(VS, "MAX_BROADCAST_BYTES", 150_000)
    assert 1 < len(VS._claim_blocks(claims, wv, "item_id", "text", VS_TOKENS, "word", "vec", key)) < 12
    assert run() == fast


def test_reshaper_registry(spark):
    from claimspark.plans import fixtures as FX
    c = FX.claims(spark, "/root/testdata/sf0.001")
    with_id = IG.reshape(c, "initial_wiki")
    without = IG.reshape(c, "old_jsonl_format")
    assert "id" in with_id.columns and "id" not in without.columns
    assert with_id.count() == without.count() == c.count()
    r = IG.reshape(FX.annotation_rows(spark, "/root/testdata/sf0.001"), "old_csv_format")
    assert r.select("source_id").distinct().count() == r.count()
    with pytest.raises(KeyError):
        IG.reshape(c, "unknown")


def test_seeded_sample_reproducible(spark):
    from claimspark.operators import training as TR
    df = spark.range(0, 3000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    a = sorted((r["g"], r["id"]) for r in TR.seeded_sample(df, by=["g"], key=["id"], k=4, seed="s").collect())
    b = sorted((r["g"], r["id"]) for r in TR.seeded_sample(df.repartition(7), by=["g"], key=["id"], k=4, seed="s").collect())
    assert a == b and len(a) == 12
    c = sorted((r["g"], r["id"]) for r in TR.seeded_sample(df, by=["g"], key=["id"], k=4, seed="t").collect())
    assert c != a


def test_dedup_within_watermark(spark, tmp_path):
    """Bounded-state dedup keeps one row per key among rows within the delay."""
    from claimspark.streaming import streams as SM
    schema = "category string, url string, ts timestamp"
    rows = [("a", "u1", "2024-01-01 00:00:00"), ("a", "u1", "2024-01-01 00:10:00"),
            ("b", "u2", "2024-01-01 00:05:00"), ("a", "u1", "2024-01-01 00:20:00")]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "category string, url string, ts string") \
        .withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(src))
    stream = SM.file_stream(spark, str(src), schema)
    out = str(tmp_path / "out")
    SM.sink_to_parquet(SM.dedup_within_watermark(stream, ["category", "url"], "ts", "1 hour"), out,
                       checkpoint=str(tmp_path / "ck"))
    got = sorted((r["category"], r["url"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", "u1"), ("b", "u2")]


def test_many_crawl_queries_equal_each_alone(spark):
    texts = ["masks help people", "Vaccines cause harm, they say", "vaccines do not cause harm", "", None, "harm harm masks"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    queries = [("a", ["masks", "vaccines"], [], []), ("b", [], ["harm", "vaccines", "harm"], None), ("c", ["masks", "they"], ["harm"], []),
               ("d", ["vaccines"], None, ["Cause Harm,", "say"]), ("e", ["nowhere"], ["masks"], []), ("f", ["masks", "masks"], [], ["p peo"])]
    q = spark.createDataFrame(queries, "query_id string, any_of array<string>, all_of array<string>, phrases array<string>")
    toks = F.split(F.lower("text"), "[^a-z]+")
    got = sorted(tuple(r) for r in RL.match_queries(df, q, tokens=toks, id_col="id", text="text").collect())
    due = sorted((k, r["id"]) for k, some, every, phrases in queries for r in RL.keyword_filter(
        df, tokens=toks, any_of=some or (), all_of=every or (), phrases=phrases or (), text="text").collect())
    assert got == due and {k for k, _ in due} == set("abcdf")
    with pytest.raises(ValueError):
        RL.match_queries(df, q.select("query_id", F.lit(None).cast("array<string>").alias("any_of"),
                                      F.array().cast("array<string>").alias("all_of"), "phrases"), tokens=toks, id_col="id", text="text")


def test_keyword_filter_and_page(spark):
    df = spark.createDataFrame([
        (1, "a.example.com", "en", "Vaccines cause harm says post", "2024-01-02"),
        (2, "b.example.org", "en", "vaccines are safe", "2024-01-03"),
        (3, "c.example.com", "fr", "les vaccins", "2024-01-04"),
        (4, "d.example.com", "en", "masks and vaccines cause harm", "2024-01-05")],
        "id long, host string, lang string, text string, day string")
    toks = F.split(F.lower(F.col("text")), " ")
    got = RL.keyword_filter(df, tokens=toks, any_of=["vaccines"], all_of=["cause"], phrases=["cause harm"],
                            text="text", lang="en", allow_hosts=[".example.com"], date_col="day",
                            from_date="2024-01-01", until_date="2024-01-05")
    assert [r["id"] for r in got.collect()] == [1]
    pg = RL.page(df, [F.col("day").desc()], size=2, number=1).collect()
    assert [r["id"] for r in pg] == [2, 1]


def test_nan_score_never_wins(spark):
    from claimspark.operators.retrieval import top_claims
    df = spark.createDataFrame([(1, 10, float("nan")), (1, 11, 0.2), (1, 12, 0.5)], "p long, c long, score double")
    got = [r["c"] for r in top_claims(df, post_id="p", claim_id="c", k=3).orderBy("rank").collect()]
    assert got == [12, 11, 10]
