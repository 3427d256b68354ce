"""Keyed dedup state over restarts and daily sketches with late rows."""

import datetime as dt

from pyspark.sql import functions as F

from claimspark.streaming import streams as SM

SCHEMA = "category string, url string, seq long"


def land(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def seen(spark, out):
    return sorted(((r.category, r.url, r.seq) for r in spark.read.schema(SCHEMA).parquet(out).collect()), key=str)


def test_dedup_keyed_over_restarts(spark, tmp_path):
    src, stored, out, ck = (str(tmp_path / n) for n in ("in", "stored", "out", "ck"))
    keys = ["category", "url"]
    land(spark, [("a", "old", 1), (None, "old", 2)], stored)
    land(spark, [("a", "u", 7), ("a", "u", 5), ("a", "old", 6), (None, "old", 8), (None, "n", 9), ("b", None, 4)], src)

    def run():
        stream = SM.file_stream(spark, src, spark.read.parquet(src).schema)
        return SM.dedup_keyed(stream, keys, "seq", out, stored=stored, checkpoint=ck)

    def stored_rows(query):
        found = [s for p in query.recentProgress for s in p["sources"] if "/stored" in s["description"]]
        return sum(s["numInputRows"] for s in found)

    assert stored_rows(run()) == 2
    first = [("a", "u", 5), ("b", None, 4), (None, "n", 9)]
    assert seen(spark, out) == sorted(first, key=str)
    # stopped and started again: known keys stay known, nothing stored is read again
    land(spark, [("a", "u", 1), ("c", "u", 3), (None, "n", 1), ("a", "old", 1)], src)
    land(spark, [("c", "u", 2), ("d", "u", 2)], src)
    assert stored_rows(run()) == 0
    assert seen(spark, out) == sorted(first + [("c", "u", 3), ("d", "u", 2)], key=str)
    run()
    assert len(seen(spark, out)) == 5


def test_daily_sketches_append_once_and_leave_late_rows_out(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    day = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, user long"

    def rows(d, users, hour=12):
        return [(day + dt.timedelta(days=d, hours=hour, seconds=u % 3000), u) for u in users]

    def run():
        SM.sink_to_parquet(SM.daily_sketches(SM.file_stream(spark, src, spark.read.parquet(src).schema), "ts", "user"), out, ck)
        return spark.read.parquet(out)

    land(spark, rows(0, range(3000)) + rows(1, range(2000, 4000)), src, schema)
    assert run().count() == 1  # the second day may still grow
    land(spark, rows(0, range(9000, 9100)) + rows(1, range(50)) + rows(3, range(10)), src, schema)
    days = run()
    got = {r.d: r.n_events for r in days.select(F.dayofmonth("w.start").alias("d"), "n_events").collect()}
    assert got == {1: 3000, 2: 2050}  # rows of the first day came too late
    week = SM.users_of_spans(days, F.date_trunc("week", "w.start"), "week").first()
    assert (week.n_days, week.n_events) == (2, 5050)
    assert abs(week.approx_users - 4000) <= 3 * 1.04 / 64 * 4000


def test_requests_go_on_after_a_crash(spark, tmp_path):
    """Each batch is written once, and no finished one is asked for again."""
    import pytest
    from pyspark.errors import StreamingQueryException
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for f in range(4):
        land(spark, [(10 * f + i,) for i in range(10)], src, "id long")
    asked = []

    def fetch(requests):
        rows = requests.collect()
        asked.append(sorted(int(i) for r in rows for i in r.ids.split(",")))
        assert all(r.n_ids <= 3 for r in rows) and len(rows) == 4
        if len(asked) == 3:
            raise ConnectionError
        return requests.select("ids")

    def run():
        stream = SM.file_stream(spark, src, "id long")
        SM.request_stream(stream, "id", 3, fetch, out, ck)

    with pytest.raises(StreamingQueryException):
        run()
    run()
    run()
    assert len(asked) == 5 and asked[2] == asked[3]
    assert sorted(i for a in asked[:2] + asked[3:] for i in a) == list(range(40))
    written = [int(i) for r in spark.read.parquet(out).collect() for i in r.ids.split(",")]
    assert sorted(written) == list(range(40))
