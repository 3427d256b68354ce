"""Mixing, periodic runs and the Merkle manifest against brute force, and
their edge cases: nulls, empty and very long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from claimspark.llm import merkle, mixing, periodic_runs, queries
from claimspark.llm.common import ranked

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size string, runs string, "
          "digest string, g string, copies string, _at string, i string")


def words(t):
    return WORDS.findall(t or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeXYZ") for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 12, 40, 80, 200])) for _ in range(150)]
    texts += ["la " * 40, "a b c " * 9 + "d", "x " * 12, "x " * 11, None, "", " \n\t ", "one", texts[0], texts[1],
              prose(rng, 20_000) + " tail" * 500, "Àé  Ω m " * 20, "end of\x1cline " * 9]
    out = [(i, t, [None, "de", "en", "en"][i % 4] if i != 7 else "xx", [None, "s1", "s2", "s10", "", "s1"][i % 6],
            len(t) if t else None) for i, t in enumerate(texts)]
    out += [out[3], out[3], (5, "other text", "en", "s1", 1), (None, "a", None, "s2", 1), (None, None, None, None, None)]
    return [r + ("x",) * 7 for r in out]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows(), SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def collected(df):
    return Counter(tuple(r) for r in df.collect())


# --- helper: places in distributed order ----------------------------------

@pytest.mark.parametrize("nulls_last", [True, False])
def test_ranked_numbers_groups_and_rows(spark, data, nulls_last):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("source", "doc_id", "lang")
    found = ranked(docs, "source", ["doc_id"], nulls_last=nulls_last).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[r[3]].append(r[0])
    names = sorted((g for g in groups if g is not None))
    names = names + [None] if nulls_last else [None] + names
    assert {(r._g, r.source, r._n) for r in found} == {(i, g, len(groups[g])) for i, g in enumerate(names)}
    for g in groups:
        got = [r.doc_id for r in sorted((r for r in found if r.source == g), key=lambda r: r._i)]
        assert got == sorted(groups[g], key=lambda d: -1 if d is None else d)
        assert sorted(r._i for r in found if r.source == g) == list(range(len(got)))


def test_ranked_splits_one_hot_group(spark):
    docs = spark.range(50_000).selectExpr("'a' as k", "1 as o", "id")
    found = ranked(docs, "k", ["o"]).selectExpr("_i").collect()
    assert sorted(r._i for r in found) == list(range(50_000))


# --- 11 systematic mixing -------------------------------------------------

def expected_mix(docs):
    size = {}
    for r in docs:
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: Fraction(3 * size[s]) if s in capped else Fraction(rest * weight[s], free) for s in names}
        more = {s for s in names if target[s] > 3 * size[s]}
        if not more:
            return size, target
        capped |= more


def test_mix_against_exact_fractions(spark, data):
    docs = rows()
    size, target = expected_mix(docs)
    found = mixing.mix(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter((d[0], d[3], len(words(d[1]))) for d in docs)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.source_size == size[r.source] and math.isclose(r.target, float(target[r.source]))
        rate = target[r.source] / size[r.source] if size[r.source] else 0
        assert r.copies in (math.floor(rate), math.ceil(rate)) and r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mix(spark.read.parquet(f"{data}/documents.parquet").repartition(3)).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_mix_caps_and_shares_the_excess(spark):
    # s0 and s1 reach three times their size, the rest shares by weight
    docs = [(i, " ".join("w" * 10), f"s{i % 4}") for i in range(40)] + [(100 + i, "w " * 10, "s3") for i in range(400)] \
        + [(900 + i, "w " * 10, "s2") for i in range(60)]
    found = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    got = {r.source: (r.target, r.source_size, r.t) for r in found.groupBy("source", "target", "source_size")
           .agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "t").collect()}
    total = 10 * len(docs)
    assert got["s0"][:2] == (300.0, 100) and got["s1"][:2] == (300.0, 100)
    assert got["s2"][0] == 2100.0 and math.isclose(got["s3"][0], total - 2700)
    assert all(abs(10 * t - target) <= 10 for target, _, t in got.values())


def test_take_copies_gives_whole_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mixed = mixing.mix(docs)
    out = mixing.take_copies(docs, mixed)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixed.collect():
        want[(r.doc_id, r.source)] += r.copies
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +want


# --- 12 periodic runs -----------------------------------------------------

def brute_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(least, 2 * q) and not any(w[s:s + n - r] == w[s + r:s + n] for r in range(1, q)):
                out.append((s, n, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        n, k = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 10 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, n // 3)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least in (12, 3):
            assert periodic_runs.find_runs(np.array(w, int), least) == brute_runs(w, least), w


def test_runs_of_very_long_texts():
    n = 100_000
    assert periodic_runs.find_runs(np.zeros(n, int)) == [(0, n, 1)]
    assert periodic_runs.find_runs(np.arange(n) % (n // 3)) == [(0, n, n // 3)]
    assert periodic_runs.find_runs(np.arange(n)) == []


def expected_row(doc_id, text):
    w = words(text)
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w) if len(w) < 1000 else periodic_runs.find_runs(np.unique(w, return_inverse=True)[1])
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in
           ("".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(x for i, x in enumerate(w) if i not in gone))]
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, *sha)


def test_runs_query_against_brute_force(spark, data):
    assert collected(queries.op12_lcp_runs(spark, data)) == Counter(expected_row(r[0], r[1]) for r in rows())


def test_detect_replaces_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 7, "x", 5)], "id int, body string, runs string, n_runs int")
    r = periodic_runs.detect(docs, "body").first()
    assert (r.n_runs, [tuple(x) for x in r.runs], r.collapsed) == (1, [(0, 14, 2)], "a b")


# --- 13 Merkle manifest ---------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    """(root, per digest its siblings (left, right) level by level)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8:i // 8 * 8 + 8]
            paths[k].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
        level = [H(*level[i:i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def expected_manifest(docs):
    def leaf(r, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])

    langs = defaultdict(list)
    for r in docs:
        tampered = r[1]
        if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            tampered = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        langs[r[2]].append((-1 if r[0] is None else r[0], leaf(r, r[1]), leaf(r, tampered)))
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for _, leaf, _ in sorted(langs[g])]) for g in order}
    root, upper = tree([trees[g][0] for g in order])
    out = Counter()
    for g, above in zip(order, upper):
        subroot, paths = trees[g]
        for (doc_id, leaf_, seen), path in zip(sorted(langs[g]), paths):
            cur = seen
            for left, right in path + above:
                cur = H(left, cur, right)
            proof = H("".join(left + right for left, right in path + above))
            out[(None if doc_id < 0 else doc_id, leaf_, subroot, root, proof, cur, cur == root)] += 1
    return out


def test_manifest_against_brute_force(spark, data):
    found = collected(queries.op13_merkle_manifest(spark, data))
    assert found == expected_manifest(rows())
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_manifest_of_one_group(spark, n):
    docs = [(i, "t", "en", "s", 1) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.verify(df).collect()
    assert all(r.verified for r in found)
    want = {k[1]: k for k in expected_manifest([(i, "t", "en", "s", 1) for i in range(n)])}
    assert {(r.leaf, r.root, r.proof_sha256) for r in found} == {(k[1], k[3], k[4]) for k in want.values()}


def test_manifest_shows_changed_fields(spark, data):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{data}/documents.parquet")
    changed = {"n_chars": F.when(F.col("doc_id") == 9, F.lit(-1)).otherwise(F.col("n_chars"))}
    bad = {r.doc_id for r in merkle.verify(docs, changed).where("not verified").collect()}
    assert bad == {9}


# --- all -------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op11_systematic_mixing", "op12_lcp_runs", "op13_merkle_manifest"])
def test_empty_table_gives_an_empty_result(spark, nothing, data, name):
    df = queries.QUERIES[name](spark, nothing)
    assert df.count() == 0 and df.schema.simpleString() == queries.QUERIES[name](spark, data).schema.simpleString()
