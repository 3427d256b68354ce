"""Readers and writers on small files (FIXTURES A1, SRC-05, SNK-02)."""

import gzip
import json

from pyspark.sql import functions as F

from claimspark.sources import files as SR
from claimspark.sources import sinks as SK


def test_claims_jsonl_one_record(spark, tmp_path):
    rec = {"id": 7, "canonical_sentence": "Claim text", "sources": ["a", "b"], "category": [],
           "pos_variations": ["first variation", "second"], "neg_variations": [], "reliability_score": "na",
           "origin": "wiki"}
    p = tmp_path / "claims.jsonl"
    p.write_text(json.dumps(rec) + "\n")
    rows = SR.read_claims_jsonl(spark, str(p)).orderBy("var_idx").collect()
    assert [r["sentence"] for r in rows] == ["first variation", "second"]
    assert rows[0]["reliability_score"] is None and rows[0]["category"] == []
    first = SR.read_claims_jsonl(spark, str(p), first_only=True).collect()
    assert len(first) == 1 and first[0]["sentence"] == "first variation"


def test_jsonl_tree_skips_hidden_ignored_and_other_extensions(spark, tmp_path):
    root = tmp_path / "root"
    for sub in ("a", "b", ".hidden", "skip"):
        (root / sub).mkdir(parents=True)
        (root / sub / "x.jsonl").write_text(json.dumps({"id": 1, "sub": sub}) + "\n")
    with gzip.open(root / "b" / "y.gz", "wt") as f:
        f.write(json.dumps({"id": 2, "sub": "b"}) + "\n")
    (root / "a" / "notes.txt").write_text("not json\n")
    df = SR.read_jsonl_tree(spark, str(root), "id long, sub string", ignore=("skip",))
    got = sorted((r["subdir"], r["id"]) for r in df.collect())
    assert got == [("a", 1), ("b", 1), ("b", 2)]


def test_gzip_writer_bounded_files(spark, tmp_path):
    df = spark.range(250).select(F.col("id"), (F.col("id") % 2).cast("string").alias("day"))
    out = tmp_path / "gz"
    SK.write_gzip_jsonl(df, str(out), max_records=50, partition_by="day")
    files = list(out.rglob("*.json.gz"))
    assert len(files) >= 4
    for f in files:
        with gzip.open(f, "rt") as fh:
            assert sum(1 for _ in fh) <= 50
    assert spark.read.json(str(out)).count() == 250


def test_named_files_go_on_and_a_failed_job_leaves_none(spark, tmp_path):
    import os
    import pytest
    from pyspark.sql import functions as F
    from claimspark.sources.sinks import write_named_jsonl
    path = str(tmp_path / "named")
    df = spark.range(10, numPartitions=1).withColumn("day", F.when(F.col("id") < 7, F.lit("2024-01-01")))
    assert write_named_jsonl(df, path, "p", "day", 4) == 3
    assert write_named_jsonl(df.where("id < 2"), path, "p", "day", 4) == 1
    names = {"p-2024-01-01-0.jsonl.gz", "p-2024-01-01-1.jsonl.gz", "p-2024-01-01-2.jsonl.gz", "p-none-0.jsonl.gz"}
    seen = lambda: {f for f in os.listdir(path) if f.startswith("p-")}
    assert seen() == names and spark.read.json(f"{path}/p-*.jsonl.gz").count() == 12
    broken = df.withColumn("x", F.when(F.col("id") == 9, F.raise_error(F.lit("stop"))))
    with pytest.raises(Exception):
        write_named_jsonl(broken, path, "p", "day", 4)
    assert seen() == names


def test_html_cards_multiple_and_nested(spark):
    from claimspark.operators.ingest import html_cards
    html = ("<html><body><article data-id='no' id='a'><header><h2><a class='t' href='http://x.example/1?a&amp;b'><span>False:</span>"
            "  the <b>moon</b>\n is &lt;cheese&gt; </a></h2></header></article><p>x</p>"
            "<article id=\"b\"><header><h2><a href=\"/2\">water is wet</a></h2></header></article>"
            "<article><h1>no card</h1></article></body></html>")
    pages = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    got = [tuple(r)[:5] for r in html_cards(pages).orderBy("card_idx").collect()]
    assert got == [("a", 0, "http://x.example/1?a&b", "the moon is <cheese>", "False"),
                   ("b", 1, "/2", "water is wet", None), ("", 2, "", "", None)]


def test_html_cards_as_a_parser_sees_them(spark):
    from claimspark.operators.ingest import html_cards
    heads = [
        # nested cards, an unquoted attribute, a comment and a script with markup in them
        "<article id=out><header><h2><a href=/1>True: <!-- <b>no</b> -->one</a></h2></header>"
        "<article id='in'><header><h2><a href='/2'><i>False:</i> two</a></h2></header></article></article>",
        "<!-- <article id='gone'></article> --><script>var s = \"<article id='s'></article>\";</script>"
        "<article id='c'><header><p><h2><a href='/3?x=1&amp;y=2'>Half: <script>if (a < b) {}</script>&eacute;t&#233; &hellip;</a></header></article>",
        # nothing closed, a tag's end inside an attribute, upper case
        "<ARTICLE ID='d' title='a > b'><HEADER><H2><A HREF='/4'><B>Wrong:</B> four",
        "<article id='e'><header><h2>no link</h2><h2><a href='/5'>later</a></h2></header></article></article>"]
    pages = spark.createDataFrame([(h,) for h in heads], "html string")
    got = {r["id"]: (r["card_idx"], r["href"], r["claim"], r["status"]) for r in html_cards(pages).collect()}
    assert got == {"out": (0, "/1", "one", "True:"), "in": (1, "/2", "two", "False"),
                   "c": (0, "/3?x=1&y=2", "\u00e9t\u00e9 \u2026", "Half:"), "d": (0, "/4", "four", "Wrong"),
                   "e": (0, "", "", None)}


def test_claims_from_table_keeps_alignment(spark):
    from claimspark.operators.ingest import claims_to_rows
    claims = spark.createDataFrame(
        [(1, "c1", ["s"], ["x"], ["v1", "v2"], [], "1", "o"), (2, "c2", ["s"], [], [], [], "1", "o")],
        "id long, canonical_sentence string, sources array<string>, category array<string>, "
        "pos_variations array<string>, neg_variations array<string>, reliability_score string, origin string")
    rows = SR.claims_from_table(claims_to_rows(claims, keep_id=True)).orderBy("id", "var_idx").collect()
    assert [(r["id"], r["var_idx"], r["sentence"]) for r in rows] == [(1, 0, "v1"), (1, 1, "v2")]
