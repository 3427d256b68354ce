"""The training-data operators against brute force on small tables, and
their edge cases: nulls, empty and very long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from claimspark.llm import (decontam, hilbert, license_digest, mcd_quality, packing, queries, semicrf_pii,
                            simhash_tiles, substring_chain, subword_toxicity, url_trie)
from claimspark.llm.common import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, w string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def rows(seed=1):
    """A table with every edge case."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(40)]
    texts += [texts[0], texts[1] + " x", texts[2], None, "", " \n\t ", "one", "two words", prose(rng, 30_000), "ÀÉ Ωmega"]
    out = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 0.5, "x", "y")
           for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, texts[4], "en", "s1", 3, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)] + [(1, 1, None), (None, 0, 1)],
                                 "doc_id bigint, quality int, toxic int")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- 1 substring chains ---------------------------------------------------

def test_chain_picks_the_collinear_matches():
    x, y = np.array([0, 10, 20, 25, 30]), np.array([5, 15, 2, 25, 35])
    best = substring_chain.chain(x, y)[0]
    assert [(x[i], y[i]) for i in best] == [(0, 5), (10, 15), (25, 25), (30, 35)]


def test_chain_score_equals_quadratic_programming():
    rng = np.random.default_rng(3)
    for _ in range(30):
        pts = np.unique(rng.integers(0, 60, (25, 2)), axis=0)
        x, y = pts[:, 0], pts[:, 1]
        score = []
        for i in range(len(x)):
            ways = [score[j] - 0.04 * (x[i] + y[i] - x[j] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            score.append(5 + max([0.0, *ways]))
        path = substring_chain.chain(x, y)[0]
        got = 5 * len(path) - 0.04 * (x[path[-1]] + y[path[-1]] - x[path[0]] - y[path[0]])
        assert got == pytest.approx(max(score))


def test_minimizers_cover_every_run():
    rng = random.Random(5)
    words = prose(rng, 300).encode().split()
    _, at = substring_chain.seeds_of(words)
    assert np.diff(at).max() <= substring_chain.WINDOW and at[0] < substring_chain.WINDOW


@pytest.mark.parametrize("min_words", [40, 16])
def test_texts_seeded_together_have_each_its_own_seeds(monkeypatch, min_words):
    rng = random.Random(min_words)
    few, many = ["a", "B", "\u00fc", "Zz", "\x1cq"], prose(rng, 400).split()
    ids, texts = np.array(rng.sample(range(1000), 120)), []
    for _ in ids:
        words = rng.choice([few[:1], few[:2], few, many])
        blanks = [" ", "  ", "\n", "\t\x0b", "\r\x0c"]
        texts.append("".join(rng.choice(blanks) + rng.choice(words) for _ in range(rng.choice([0, 5, 16, 39, 40, 60, 150]))))
    due = set()
    for doc_id, text in zip(ids.tolist(), texts):
        words = text.encode().lower().split()
        if len(words) < min_words:
            continue
        due |= {(h, doc_id, 2 * at) for h, at in zip(*(c.tolist() for c in substring_chain.seeds_of(words)))}
        starts = substring_chain.seeds_of(words, window=substring_chain.SPARSE)[1]
        whole = substring_chain.long_seeds_of(substring_chain.word_hashes(words), starts, min_words - substring_chain.SPARSE + 1)
        due |= {(h, doc_id, 2 * at + 1) for h, at in zip(*(c.tolist() for c in whole))}
    calls, one = [], substring_chain._minimizers
    monkeypatch.setattr(substring_chain, "_minimizers", lambda *a: calls.append(1) or one(*a))
    found = substring_chain._texts_seeds(ids, pa.array(texts), substring_chain.K, substring_chain.WINDOW, min_words)
    rows = [r for h, doc_id, at in found for r in zip(h.view(np.uint64).tolist(), doc_id.tolist(), at.tolist())]
    assert len(rows) == len(due) and set(rows) == due
    assert len(calls) == 2  # for all texts at once, not for each


def test_common_words_is_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert substring_chain.common_words(a, b) == table[-1][-1]


def test_shared_passages_are_found(spark, docs, empty):
    rng = random.Random(9)
    passage = prose(rng, 60).split()
    fuzzy = list(passage)
    fuzzy[20], fuzzy[40] = "CHANGED", "again"
    repeated = "same " * 80
    table = [(100, f"{prose(rng, 50)} {' '.join(passage)} {prose(rng, 40)}"),
             (200, f"{prose(rng, 10)} {' '.join(passage).upper()}"), (300, f"{' '.join(fuzzy)} {prose(rng, 90)}"),
             (400, prose(rng, 200)), (500, repeated), (600, prose(rng, 30) + " " + repeated)]
    # short lines repeated have a single distinct minimizer
    table += [(700, "tick tock " * 40), (800, prose(rng, 20) + " tick tock" * 45),
              (900, prose(rng, 15) + "\n" + "one line of six words here\n" * 12), (950, "one line of six words here\n" * 20)]
    found = substring_chain.shared_passages(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    assert pairs == {(200, 100), (300, 100), (600, 500), (800, 700), (950, 900)}
    texts = {i: lower(t).split() for i, t in table}
    for r in found:
        a, b = texts[r.doc_id][r.start:r.end], texts[r.other_id][r.other_start:r.other_end]
        assert len(a) >= 58 and r.matched == sum(p == q for p, q in zip(a, b)) and r.identity >= 0.9
    edge = substring_chain.shared_passages(docs).collect()
    long = {i for i in (0, 1, 2) if len(rows()[i][1].split()) >= substring_chain.MIN_WORDS}
    assert {(r.doc_id, r.other_id) for r in edge} == {(40 + i, i) for i in long} and long
    assert substring_chain.shared_passages(empty).count() == 0


@pytest.mark.parametrize("exact,differing,shared", [(50, 16, 8), (50, 20, 16), (55, 20, 12), (60, 22, 20), (50, 26, 50)])
def test_an_exact_passage_survives_a_gap_and_a_short_run(exact, differing, shared):
    rng = random.Random(4)
    head, tail = prose(rng, exact).split(), prose(rng, shared).split()
    a, b = (head + prose(rng, differing).split() + tail for _ in range(2))
    at = [*range(0, exact - 4, 9), *range(exact + differing, len(a) - 4, 2)]
    found = [r for r in substring_chain.align(a, b, at, at) if r[1] - r[0] >= 40 and r[4] >= 0.8 * (r[1] - r[0])]
    assert len(found) == 1 + (shared >= 40) and found[0][0] == 0 and found[0][1] >= exact


@pytest.mark.parametrize("parts", [(26, 26), (30, 30), (38, 38), (20, 20, 20), (39, 1), (1, 39)])
def test_parts_of_an_exact_passage_have_other_first_holders(spark, parts):
    rng = random.Random(sum(parts))
    table, passages = [], []
    for case in range(6):
        shared = [prose(rng, n) for n in parts]
        table += [(100 * case + i, f"{prose(rng, 30)} {p} {prose(rng, 30)}") for i, p in enumerate(shared)]
        b, c = 100 * case + 50, 100 * case + 51
        table += [(i, f"{prose(rng, 35)} {' '.join(shared)} {prose(rng, 25)}") for i in (b, c)]
        passages.append((c, b))
    found = substring_chain.shared_passages(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in found if r.end - r.start >= sum(parts)} == set(passages)


@pytest.mark.parametrize("words,rate", [(50, 0.1), (50, 0.15), (60, 0.15), (80, 0.15)])
def test_changed_passages_are_found(spark, words, rate):
    rng = random.Random(words)
    table = []
    for case in range(40):
        a = prose(rng, words).split()
        b = list(a)
        for i in rng.sample(range(words), round(rate * words)):
            b[i] = prose(rng, 1) + "z"
        table += [(2 * case + n, f"{prose(rng, 40)} {' '.join(t)} {prose(rng, 40)}") for n, t in enumerate((a, b))]
    found = substring_chain.shared_passages(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    assert pairs <= {(2 * case + 1, 2 * case) for case in range(40)} and len(pairs) >= 34


def changed(rng, words, rate, indels):
    """The words with about ``rate`` of them substituted, or, half of the
    time if ``indels``, left out or followed by another word."""
    out = []
    at = set(rng.sample(range(len(words)), round(rate * len(words))))
    for i, w in enumerate(words):
        kind = rng.choice("ssid" if indels else "s") if i in at else "-"
        out += {"s": [prose(rng, 1) + "z"], "i": [w, prose(rng, 1) + "z"], "d": [], "-": [w]}[kind]
    return out


@pytest.mark.parametrize("words,rate", [(50, 0.1), (60, 0.15), (80, 0.15)])
def test_passages_with_words_left_out_and_put_in(spark, words, rate):
    rng = random.Random(words + 1)
    table, due = [], set()
    for case in range(40):
        a = prose(rng, words).split()
        b = changed(rng, a, rate, True)
        if substring_chain.common_words(a, b) >= 0.8 * max(len(a), len(b)) and len(b) >= 40:  # brute force
            due.add((2 * case + 1, 2 * case))
        table += [(2 * case + n, f"{prose(rng, 40)} {' '.join(t)} {prose(rng, 40)}") for n, t in enumerate((a, b))]
    found = substring_chain.shared_passages(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    assert len(due) >= 30 and len(due & pairs) >= 0.9 * len(due)


def test_a_changed_passage_whose_halves_stand_in_earlier_documents(spark):
    rng = random.Random(77)
    table, due = [], set()
    for case in range(60):
        halves = [prose(rng, 30).split() for _ in range(2)]
        passage = halves[0] + halves[1]
        texts = [*halves, passage, changed(rng, passage, 0.1, False)]
        table += [(10 * case + i, f"{prose(rng, 35)} {' '.join(t)} {prose(rng, 35)}") for i, t in enumerate(texts)]
        due.add((10 * case + 3, 10 * case + 2))
    found = substring_chain.shared_passages(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    assert len(due & {(r.doc_id, r.other_id) for r in found}) >= 54


@pytest.mark.parametrize("cases,holders,few", [(40, 5, substring_chain.FEW), (5, 40, None)])
def test_a_changed_passage_whose_halves_stand_in_many_earlier_documents(spark, cases, holders, few):
    rng = random.Random(holders)
    table, due = [], set()
    for case in range(cases):
        halves = [prose(rng, 30).split() for _ in range(2)]
        passage = halves[0] + halves[1]
        texts = halves * holders + [passage, changed(rng, passage, 0.1, False)]
        table += [(100 * case + i, f"{prose(rng, 35)} {' '.join(t)} {prose(rng, 35)}") for i, t in enumerate(texts)]
        due.add((100 * case + 2 * holders + 1, 100 * case + 2 * holders))
    found = substring_chain.shared_passages(spark.createDataFrame(table, "doc_id bigint, text string"), few=few).collect()
    assert {(r.doc_id, r.other_id) for r in found} <= due and len(found) >= 0.9 * cases


@pytest.mark.parametrize("few", [None, 5])
def test_links_of_all_holders_equal_brute_force(spark, few):
    rng = random.Random(8)
    seeds = sorted({(h, rng.randrange(30), 2 * rng.randrange(50)) for h in range(60) for _ in range(rng.randint(1, 9))})
    first = {h: min((d, at) for g, d, at in seeds if g == h) for h in range(60)}
    matches = [(h, d, at, *first[h]) for h, d, at in seeds if d != first[h][0]]
    found = [(d, at // 2 - 1, at // 2 + 9, o, 0, 10, 9, 0.9) for h, d, at, o, _ in matches if rng.random() < 0.4]

    def met(d, at, o):
        return any(f[0] == d and f[3] == o and f[1] <= at // 2 and at // 2 + 5 <= f[2] for f in found)

    due = set()
    for h, d, at, o, _ in matches:
        group = [m for m in matches if m[0] == h]
        if few is None or len(group) < few:
            due |= {(h, d, at, m[1], m[2]) for m in group
                    if d > m[1] and not (met(d, at, o) and met(m[1], m[2], o))}
    matches = spark.createDataFrame(matches, "h bigint, doc_id bigint, at bigint, other_id bigint, other_at bigint")
    found = spark.createDataFrame(found, "doc_id bigint, start bigint, end bigint, other_id bigint, other_start bigint, "
                                         "other_end bigint, matched bigint, identity double")
    got = substring_chain.pair_links(matches, substring_chain._alone(matches, found, substring_chain.K), few)
    assert {tuple(r) for r in got.collect()} == due and due


def test_the_query_links_all_holders_however_many(spark, monkeypatch):
    """A passage whose halves 20 earlier documents hold each, and in blocks."""
    monkeypatch.setattr(substring_chain, "PAIR_BLOCK", 3)
    rng = random.Random(21)
    halves = [prose(rng, 30).split() for _ in range(2)]
    passage = halves[0] + halves[1]
    # the copy lacks a word at the seam: no seed goes across
    texts = halves * 20 + [passage, passage[:29] + ["seam"] + passage[30:]]
    table = [(i, f"{prose(rng, 35)} {' '.join(t)} {prose(rng, 35)}") for i, t in enumerate(texts)]
    found = substring_chain.shared_passages(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(41, 40)}


def test_links_equal_brute_force_where_a_seed_is_hot(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, *range(3, 40)]), rng.randrange(4000), 2 * rng.randrange(90)) for _ in range(9000)]
    rows = [(h, d, at + h % 2) for h, d, at in rows]
    first = {h: min((d, at) for g, d, at in rows if g == h) for h in {r[0] for r in rows}}
    due = sorted((h, d, at, *first[h]) for h, d, at in rows
                 if d != first[h][0] or (at % 2 and at != first[h][1]))
    got = substring_chain.links(spark.createDataFrame(rows, substring_chain.SEED_SCHEMA).repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == due


# --- 2 quality ------------------------------------------------------------

def brute_stats(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_text_stats():
    rng = random.Random(4)
    texts = [None, "", "a", "a b\n\na b\nc #$", "\x85 \xa0x\x1c y", " ".join("abcd") * 1]
    texts += [" ".join(rng.choice("ab") for _ in range(40)) for _ in range(20)]
    texts += [("l1 a b c d e f g h\n" * 3) + prose(rng, 30)]
    for t in texts:
        assert mcd_quality.text_stats(t) == brute_stats(t)


def test_chi_square():
    assert mcd_quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_outliers_are_rejected(spark, docs, empty):
    rng = random.Random(8)
    table = [(i, prose(rng, rng.randint(40, 200)), "en", f"s{i % 2}") for i in range(400)]
    table += [(1000 + i, " ".join(w + "###" for w in prose(rng, 60).split()), "en", "s0") for i in range(60)]
    got = {r.doc_id: r for r in mcd_quality.judge(
        spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(400)) and not any(got[1000 + i].kept for i in range(60))
    texts = {r[0]: r[1] for r in rows()}
    edge = mcd_quality.judge(docs).collect()
    assert len(edge) == len(rows())
    for r in edge:
        if r.doc_id is not None and r.doc_id != 48:
            b = brute_stats(texts[r.doc_id])
            assert tuple(r[1:6]) == b and r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
            assert r.kept == (not r.base_failed)  # too few rows to reject anything
    assert mcd_quality.judge(empty).count() == 0


def test_small_groups_are_judged_by_all_documents(spark):
    rng = random.Random(9)
    table = [(i, prose(rng, rng.randint(40, 200)), "en", "s0") for i in range(300)]
    odd = [" ".join(w + "###" for w in prose(rng, 60).split()) for _ in range(4)]
    table += [(1000 + i, t, f"l{i}", "rare") for i, t in enumerate(odd)]
    table += [(2000 + i, prose(rng, 80), f"l{i}", "rare") for i in range(4)]
    got = {r.doc_id: r.kept for r in mcd_quality.judge(
        spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string")).collect()}
    assert len(got) == 308 and not any(got[1000 + i] for i in range(4))
    assert all(got[i] for i in range(300)) and all(got[2000 + i] for i in range(4))


def test_the_scatter_is_as_tight_as_that_of_many_starts(spark):
    """Concentration from 300 random subsets, exact half sets, in numpy."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (160, 5)) @ rng.normal(0, 1, (5, 5)), rng.normal(30, 0.5, (60, 5))])
    floors = np.diag(np.square(mcd_quality.FLOORS))
    factor = 0.5 / mcd_quality.chi2_cdf(mcd_quality.chi2_quantile(0.5, 5), 7)
    best, nearest = np.inf, None
    for _ in range(300):
        half = rng.choice(len(x), 6, replace=False)
        for _ in range(30):
            inverse = np.linalg.inv(np.cov(x[half].T, bias=True) * factor + floors)
            d = x - x[half].mean(0)
            half = np.argsort(np.einsum("ij,jk,ik->i", d, inverse, d))[:(len(x) + 1) // 2]
        scatter = np.cov(x[half].T, bias=True) * factor + floors
        if np.linalg.slogdet(scatter)[1] < best:
            best, d = np.linalg.slogdet(scatter)[1], x - x[half].mean(0)
            nearest = np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter), d)
    names = ", ".join(f"x{i} double" for i in range(5))
    table = spark.createDataFrame([(i, "g", *map(float, v)) for i, v in enumerate(x)], f"doc_id int, grp string, {names}")
    found = mcd_quality.mcd(table, 1, 100).first()
    inverse = np.zeros((5, 5))
    for k, (i, j) in enumerate(mcd_quality.PAIRS):
        inverse[i, j] = inverse[j, i] = found.inverse[k]
    assert -np.linalg.slogdet(inverse)[1] <= best + 0.5  # within a bin's width of the best half set
    d = x - np.array(found.centre)
    cutoff = mcd_quality.chi2_quantile(1 - 1e-6, 5)
    far = np.einsum("ij,jk,ik->i", d, inverse, d) > cutoff
    assert (far == (nearest > cutoff)).all() and far[160:].all() and not far[:160].any()


def test_salted_join_equals_broadcast(spark):
    rng = random.Random(8)
    table = spark.createDataFrame([(i, prose(rng, rng.randint(20, 60)), "en", f"s{i % 2}") for i in range(300)],
                                  "doc_id bigint, text string, lang string, source string")
    a, b = (sorted(map(tuple, mcd_quality.judge(table, max_groups=m).select("doc_id", "kept").collect())) for m in (0, 100))
    assert a == b


# --- 3 toxicity -----------------------------------------------------------

def test_unseen_misspellings_score_high(spark):
    rng = random.Random(6)
    bad = ["scumbag", "worthless", "disgusting"]

    def text(toxic):
        words = prose(rng, 60).split()
        if toxic:
            for _ in range(4):
                w = rng.choice(bad)
                words[rng.randrange(60)] = w if rng.random() < 0.7 else w + rng.choice("xyz")
        return " ".join(words)

    table = [(i, text(i % 5 == 0)) for i in range(800)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(800)], "doc_id bigint, toxic int")
    model = subword_toxicity.fit(docs, labels)
    clean = [prose(rng, 60) for _ in range(50)]
    toxic = [c + " scumbagq disgustingw worthlessy scumbagz" for c in clean]
    assert (model.scores([t.split() for t in toxic]) > 0.5).mean() > 0.9
    assert (model.scores([t.split() for t in clean]) < 0.5).mean() > 0.95
    got = subword_toxicity.judge(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.9


def test_toxicity_edges(spark, docs, empty, labels):
    got = subword_toxicity.judge(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (43, 44, 45)}) == 1
    none = labels.limit(0)
    assert all(r.score < 1e-9 for r in subword_toxicity.judge(docs, none).collect())
    assert subword_toxicity.judge(empty, labels).count() == 0
    kept = subword_toxicity.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()


# --- 4 packing ------------------------------------------------------------

def brute_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [np.array(e.ids + [1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(got, texts):
    """Pieces tile each document, sequences are gapless and unpadded."""
    ids = dict(zip(texts, brute_ids(texts.values())))
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        spans = sorted((r.start, r.length) for r in pieces)
        assert spans[0][0] == 0 and all(r.doc_tokens == len(ids[d]) for r in pieces)
        assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:])) and sum(spans[-1]) == len(ids[d])
        assert all(zlib.crc32(ids[d][r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    for pieces in by_seq.values():
        spans = sorted((r.offset, r.length) for r in pieces)
        total = sum(spans[-1])
        assert spans[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert total <= 2048 and total & (total - 1) == 0


def test_packing_round_trip(spark, empty):
    rng = random.Random(3)
    odd = ["", None, "<|endoftext|> a", "it's  \n\n x\u00a0y", "\u0130\u1e9e \U0001f600", "1234567 ...!!", "a" * 5000, "\r\n\t"]
    texts = dict(enumerate(odd + [prose(rng, rng.randint(1, 900)) for _ in range(60)] + [prose(rng, 9000)]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    check_packing(packing.pack_documents(docs, queries.rank_file(), block_tokens=20_000).collect(), texts)
    assert packing.pack_documents(empty, queries.rank_file()).count() == 0


def test_packing_groups_are_balanced():
    packer = packing.Packer((256, 512, 1024, 2048), 8192, 0)
    rng = random.Random(1)
    for i in range(300):
        packer.add(i, rng.randint(1, 3000))
    packer.pack(True)
    loads = {}
    for _, tokens, group, _ in packer.take():
        loads[group] = loads.get(group, 0) + tokens
    assert max(loads.values()) - min(loads.values()) <= 2048


def test_packing_edges(docs):
    got = packing.pack_documents(docs, queries.rank_file()).collect()
    tokens = sum(map(len, brute_ids([r[1] for r in rows()])))
    assert sum(r.length for r in got) == tokens


def test_long_blank_runs_are_encoded():
    encode = packing.encoder(queries.rank_file())
    for text in ("a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x" + " \n" * 20_000 + " y", " " * 9_999 + "z"):
        assert encode(text) + [1] == brute_ids([text])[0].tolist()


# --- 5 simhash ------------------------------------------------------------

def brute_simhash(text):
    words = WORDS.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(pairs, radius=2):
    """doc_id -> smallest reachable id, for (id, fingerprint) pairs."""
    prints = sorted({p for _, p in pairs})
    group = {p: p for p in prints}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= radius:
                group[root(p)] = root(q)
    low = {}
    for d, p in pairs:
        if d is not None:
            low[root(p)] = min(d, low.get(root(p), d))
    return {(d, p): low.get(root(p)) for d, p in pairs}


def test_simhash_groups(spark, docs, empty):
    pairs = [(r[0], brute_simhash(r[1])) for r in rows()]
    want = brute_components(pairs)
    got = simhash_tiles.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got if r.doc_id is not None) == sorted(
        (d, p, want[d, p]) for d, p in pairs if d is not None)
    kept = simhash_tiles.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for (d, _), c in want.items() if c is not None})
    assert simhash_tiles.near_duplicates(empty).count() == 0 and simhash_tiles.keep_one_per_group(empty).count() == 0


def test_one_row_per_group_where_ids_repeat(spark):
    rng = random.Random(11)
    x, y, z, u = (prose(rng, 60) for _ in range(4))
    table = [(3, x, "a"), (5, x, "b"), (5, y, "c"), (5, y, "c"), (None, z, "d"), (None, z, "d"), (None, x, "e"), (7, u, "f"),
             (None, None, "g"), (8, u, "h")]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, _fp string").repartition(3)
    docs = docs.select("_fp", "text", "doc_id", docs["_fp"].alias("component"), docs["_fp"].alias("print"))
    kept = simhash_tiles.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = [(3, x), (5, y), (7, u), (None, z), (None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("tile_rows,blocks", [(3, 4), (8192, 4), (3, 8)])
def test_tiles_find_every_link(spark, tile_rows, blocks):
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for p in prints[:100]:
        for _ in range(rng.randint(0, 3)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                p ^= 1 << b
            prints.append(p)
    prints = sorted(set(prints + [0, 1, 3, (1 << 64) - 1]))
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint").repartition(3)
    edges = simhash_tiles.near_edges(fps, 2, blocks, tile_rows)
    groups = {r.node % (1 << 64): r.component % (1 << 64) for r in connected_components(edges).collect()}
    want = brute_components([(i, p) for i, p in enumerate(prints)])
    ours, theirs = {}, {}
    for i, p in enumerate(prints):
        ours.setdefault(groups.get(p, p), set()).add(p)
        theirs.setdefault(want[i, p], set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (100, 101), (1, 0)], "a bigint, b bigint")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# --- 6 Hilbert ------------------------------------------------------------

@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3)])
def test_curve_visits_neighbours(spark, dims, bits):
    cells = spark.range(1 << (dims * bits))
    names = [f"c{i}" for i in range(dims)]
    cells = cells.selectExpr(*[f"cast(shiftright(id, {i * bits}) & {(1 << bits) - 1} as int) as {n}" for i, n in enumerate(names)])
    got = sorted((r.curve, tuple(r[n] for n in names)) for r in hilbert.hilbert_index(cells, names, bits).collect())
    assert [c for c, _ in got] == list(range(1 << (dims * bits)))
    assert all(sum(abs(p - q) for p, q in zip(a, b)) == 1 for (_, a), (_, b) in zip(got, got[1:]))


def test_shards(spark, docs, empty, tmp_path):
    got = hilbert.shard(docs).collect()
    assert len(got) == len(rows())
    count = [sum(r.shard == s for r in got) for s in range(40)]
    assert max(count) - min(count) <= 1 and all(0 <= r.shard < 40 for r in got)
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in got)
    texts = {r[0]: r[1] or "" for r in rows()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
               for r in got if r.doc_id is not None)
    assert hilbert.shard(empty).count() == 0
    hilbert.write_shards(docs, str(tmp_path / "shards"), 4)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows())


def test_written_shards_hold_their_rows(spark, tmp_path):
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(100)]
    table = [(i, t, "en", f"s{i % 3}", "x", 1, 2) for i, t in enumerate(texts)] + [(500, "hot", "en", "s1", "x", 1, 2)] * 90
    schema = "doc_id bigint, text string, lang string, source string, shard string, text_crc32 int, _crc int"
    docs = spark.createDataFrame(table, schema).repartition(4)
    column = hilbert.write_shards(docs, str(tmp_path / "cut"), 7)
    assert column == "shard_"
    back = spark.read.parquet(str(tmp_path / "cut"))
    want, got = {}, {}
    for r in hilbert.shard(docs, 7).collect():
        want.setdefault(r.shard, []).append(r.doc_id)
    for r in back.collect():
        got.setdefault(r.shard_, []).append(r.doc_id)
    assert {s: sorted(v) for s, v in got.items()} == {s: sorted(v) for s, v in want.items()}
    assert sorted(map(tuple, back.drop(column).collect())) == sorted(table)
    for s in range(7):  # slots run on through a shard's files
        files = sorted((tmp_path / "cut" / f"shard_={s}").glob("*.parquet"))
        ids = [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()]
        assert len(ids) == len(want[s])


def test_shards_are_pruned_by_minimum_and_maximum(spark):
    """A predicate on one value reads the shards whose range holds it: far
    fewer than all, and not many more than really hold it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = docs.join(hilbert.shard(docs).select("doc_id", "shard"), "doc_id").select("lang", "source", "shard").collect()
    for name, most in (("lang", 1.25), ("source", 2.0)):
        held = {}
        for r in placed:
            if r[name] is not None:
                held.setdefault(r.shard, set()).add(r[name])
        values = {v for vs in held.values() for v in vs}
        read = sum(min(vs) <= v <= max(vs) for v in values for vs in held.values()) / len(values)
        hold = sum(v in vs for v in values for vs in held.values()) / len(values)
        print(name, read, hold)
        assert hold <= read <= most * hold


# --- 7 personal data ------------------------------------------------------

def brute_spans(text):
    text, out = text or "", []

    def luhn(x):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(x))) % 10 == 0

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], semicrf_pii.KINDS.index(s[0])))


def test_base_spans():
    rng = random.Random(1)
    texts = [None, "", "a@b.c", "@x.y", "a@b", "a@b@c.de", "x..y@-.- a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 ١.٢.٣.٤",
             "+1 (415) 555-0100 tel 4111 1111 1111 1111", "4111111111111111", "+1 2", "0000.00.0.255"]
    texts += ["".join(rng.choice("a1@.+- ()") for _ in range(60)) for _ in range(400)]
    for t in texts:
        assert semicrf_pii.base_spans(t) == brute_spans(t), t


def test_marginals_sum_over_all_segmentations():
    zone = semicrf_pii.Zone("4111 1111 1111 1111 x 1.2.3.4")
    rng = np.random.default_rng(0)
    w = rng.normal(0, 0.3, semicrf_pii.BUCKETS)
    scores = {(i, j, k): w[f].sum() for j, segs in zone.ending.items() for i, k, f in segs}
    out = [w[f].sum() for f in zone.outside]

    def walk(at):
        if at == zone.n:
            yield 0.0, ()
            return
        for s, path in walk(at + 1):
            yield s + out[at], path
        for (i, j, k), x in scores.items():
            if i == at:
                for s, path in walk(j):
                    yield s + x, ((i, j, k), *path)

    every = list(walk(0))
    total = sum(np.exp(s) for s, _ in every)
    got, _ = zone.marginals(w)
    for seg in scores:
        assert got[seg] == pytest.approx(sum(np.exp(s) for s, p in every if seg in p) / total)
    assert tuple(zone.best(w)) == max(every)[1]


def test_field_adds_what_patterns_miss(spark, docs, empty):
    rng = random.Random(2)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if semicrf_pii.luhn(d + c))

    def text():
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        mail = f"{prose(rng, 1)}.{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com"
        ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        parts = [prose(rng, 5), rng.choice([phone, mail, ip, card()]), prose(rng, 4), f"page {rng.randint(1, 9999)}"]
        return " ".join(parts)

    table = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id bigint, text string")
    w = semicrf_pii.fit(table)
    number = card()
    glued = f"call +1 (269) 555-3296 {number} and 1 (415) 555-0199 now"
    base, every = semicrf_pii.all_spans(glued, w)
    found = {(k, glued[s:e]) for k, s, e in every}
    assert ("phone", "+1 (269) 555-3296") in found and ("card", number) in found and ("phone", "1 (415) 555-0199") in found
    for clean in ("page 12 of 300 in 2024", "7ccfcfa5a2be58db3a9b3425282c8cfa808515fc", "v 1.2.3 and 10 20 30"):
        assert semicrf_pii.all_spans(clean, w)[1] == []
    edge = semicrf_pii.find_spans(docs, w).collect()
    texts = {r[0]: r[1] for r in rows()}
    for r in edge:
        want = semicrf_pii.joined(brute_spans(texts.get(r.doc_id))) if r.doc_id is not None else ""
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert semicrf_pii.find_spans(empty).count() == 0 and len(edge) == len(rows())


def test_masking(spark, docs):
    table = spark.createDataFrame([(1, "a b@c.de, 1.2.3.4", 17), (2, None, 3)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: r for r in semicrf_pii.mask(table).collect()}
    assert got[1].text == "a [EMAIL], [IP]" and got[1].n_chars == 15 and got[2].text is None and got[2].n_chars == 3
    assert semicrf_pii.mask(docs).columns == docs.columns and semicrf_pii.mask(docs).count() == docs.count()


# --- 8 decontamination ----------------------------------------------------

def brute_hits(text, items, width=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, ids = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            win = w[i:i + width]
            for s in range(len(words) - len(win) + 1):
                if words[s:s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_chars", [50, 4_000_000])
def test_contamination(spark, docs, empty, block_chars):
    texts = {r[0]: r[1] for r in rows()}
    items = [(7, " ".join(texts[3].split()[5:20])), (11, "Two, WORDS"), (2, ""), (3, None), (7, "one"), (9, "one"),
             (5, "absent words " * 9), (12, "a a a a a a a a a a a a")]
    extra = [(900, "a " * 15), (901, "x one one-one ÀÉ"), (902, "no")]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts |= dict(extra)
    got = decontam.find_contamination(all_docs, bench, block_chars=block_chars).collect()
    assert len(got) == len(rows()) + 3
    for r in got:
        if r.doc_id is not None and r.doc_id != 48:
            assert tuple(r[1:]) == brute_hits(texts[r.doc_id], items), r.doc_id
    assert decontam.find_contamination(empty, bench).count() == 0
    none = decontam.find_contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows()) and not any(r.contaminated for r in none)
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.contaminated and r.doc_id not in (900, 901, 902)}


# --- 9 urls ---------------------------------------------------------------

def brute_rule(host, path, rules):
    fit = [(h.count("."), len(p), v == "block", v, h + p) for v, h, p in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else None


@pytest.mark.parametrize("max_rules", [1, 3, 1000])
def test_urls(spark, max_rules):
    rules = url_trie.RULES + [("allow", "a.b.net", "/x"), ("block", "a.b.net", "/x"), ("block", "b.net", "/x/y"),
                              ("allow", "b.net", ""), ("block", "b.net", "/x/y/")]
    hosts = ["net", "NET", "a.b.net", "xb.net", "b.net", "q.a.b.net", "example.net", "www.example.com", "org", "net.", "b.net:80"]
    paths = ["", "/", "/en/1", "/en", "/de/x?y=/", "/x", "/xy", "/x/y", "/x/yz", "/x/y/z#a/b", "/fr/", "?q=/en/", "//"]
    urls = [None, "", "example.net/en/", "://", "a://b://c"] + [f"http://{h}{p}" for h in hosts for p in paths]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r.judged for r in url_trie.filter_urls(table, rules, max_rules=max_rules).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.split(r"[/?#]", rest)[0])
        path = re.split(r"[?#]", rest[len(host):])[0]
        want = brute_rule(host, path, rules)
        assert (got[i].host, got[i].path) == (host, path)
        assert (got[i].verdict, got[i].rule) == (want or ("allow", None)), u
    assert url_trie.filter_urls(table.limit(0), rules).count() == 0


# --- 10 licences ----------------------------------------------------------

def test_licenses(spark, docs, empty):
    known = license_digest.known_licenses(spark)
    mit = license_digest.KNOWN["MIT"]
    varied = "Copyright (c) 2020 Someone\nAll rights reserved.\n" + mit.upper().replace(",", " ;").replace("SUBLICENSE", "sublicence")
    table = spark.createDataFrame([(1, varied), (2, mit + " extra"), (3, None), (4, "copyright x"), (5, "licence licence")],
                                  "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_digest.scan_licenses(table, known).collect()}
    assert got[1].license_id == "MIT" and got[2].license_id is None
    assert got[3].digest == got[4].digest == hashlib.sha256(b"").hexdigest() and got[3].license_id is None
    assert got[5].digest == hashlib.sha256(b"license license").hexdigest()
    far = license_digest.scan_licenses(table, known, max_broadcast_rows=0).collect()
    assert sorted(map(str, far)) == sorted(map(str, got.values()))
    assert license_digest.scan_licenses(docs, known).count() == len(rows())
    assert license_digest.scan_licenses(empty, known).count() == 0


def test_license_layouts(spark):
    import textwrap
    notice = "Copyright (c) 2020-2024, Some Body <a@b.c>\nAll rights reserved.\n\n"
    table, want = [], []
    for name, text in license_digest.KNOWN.items():
        for title in ("", *(t + "\n\n" for t in license_digest.TITLES.get(name, ()) if t not in ("BSD License", "The BSD License"))):
            for width in (20, 41, 60, 72, 80, 100):
                want.append(name)
                table.append((len(table), title + notice + textwrap.fill(text, width)))
    isc = license_digest.KNOWN["ISC"].replace("\n", " ").replace("above copyright notice", "above\ncopyright notice")
    want.append("ISC")
    table.append((len(table), "ISC License\n\nCopyright 2004 by Some Body\n\n" + isc))
    got = license_digest.scan_licenses(spark.createDataFrame(table, "doc_id bigint, text string"),
                                       license_digest.known_licenses(spark)).collect()
    assert [r.license_id for r in sorted(got)] == want


def test_published_licenses(spark):
    files = sorted(license_digest.TEXTS.glob("*.txt"))
    names = [f.name.removesuffix(".txt") for f in files]
    assert {"Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense",
            "BSL-1.0", "CC0-1.0"} <= set(names)
    whole = [f.read_text("utf-8") for f in files]
    cut = [t.split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS\n" if "END OF TERMS AND CONDITIONS" in t else t
           for t in whole]
    texts = [*whole, *(t.upper().replace(",", " ,") for t in whole), *cut, *(t.replace("\n", "\r\n") for t in whole)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(license_digest.scan_licenses(table, license_digest.known_licenses(spark)).collect())
    assert [r.license_id for r in got] == names * 4
    assert not any(r.license_id for r in license_digest.scan_licenses(
        spark.createDataFrame([(i, t[:len(t) // 2]) for i, t in enumerate(whole)], "doc_id bigint, text string"),
        license_digest.known_licenses(spark)).collect())
