"""The claim index: exact top-k with and without pruning, kept postings, and
the way beyond the broadcast limit."""

import numpy as np
import pytest

from claimspark.operators import claim_index as CI
from claimspark.operators import retrieval as R


def zipf_texts(rng, n, words, vocab=400):
    p = 1.0 / np.arange(1, vocab + 1)
    p /= p.sum()
    return [" ".join(f"word{w}" for w in rng.choice(vocab, words, p=p)) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    claims = [(i, t) for i, t in enumerate(zipf_texts(rng, 300, 12))] + [(300, ""), (301, None), (302, "word7 word7")]
    claims += [(303, claims[5][1]), (304, claims[5][1])]  # ties
    posts = [(i, t) for i, t in enumerate(zipf_texts(rng, 60, 15))]
    posts += [(100, None), (101, ""), (102, "unseen words only"), (103, claims[5][1]), (103, claims[6][1])]
    return (spark.createDataFrame(posts, "pid int, text string"), spark.createDataFrame(claims, "cid long, text string"))


def rows(df):
    return sorted((r.pid, r.cid, round(r.score, 9), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("bm25", [False, True])
@pytest.mark.parametrize("prune_rows", [0, 10**9])
def test_top_k_equals_the_term_joins(tables, bm25, prune_rows):
    posts, claims = tables
    posts = posts.dropDuplicates(["pid"])
    ready = CI.prepare(claims, claim_id="cid", bm25=bm25)
    found = CI.top_k(posts, ready.postings, post_id="pid", claim_id="cid", k=4, index=ready.index, prune_rows=prune_rows)
    scores = (R.bm25 if bm25 else R.tfidf_cosine)(posts, claims, post_id="pid", claim_id="cid")
    assert rows(found) == rows(R.top_claims(scores, post_id="pid", claim_id="cid", k=4))


def test_posts_with_one_id_are_ranked_apart(tables):
    posts, claims = tables
    found = CI.tfidf_top_k(posts.where("pid = 103"), claims, post_id="pid", claim_id="cid", k=1)
    assert sorted(r.cid for r in found.collect()) == [5, 6]


def test_beyond_the_limit_term_joins_take_over(tables, monkeypatch):
    posts, claims = tables
    want = rows(CI.tfidf_top_k(posts.limit(60), claims, post_id="pid", claim_id="cid", k=3))
    monkeypatch.setattr(CI, "MAX_BROADCAST_BYTES", 100)
    ready = CI.prepare(claims, claim_id="cid")
    assert ready.index is None
    assert rows(CI.best_claims(posts.limit(60), ready, post_id="pid", k=3)) == want


def test_frequent_terms_only_complete_candidates():
    """Claims that share one rare name and, all of them, the same stock
    words: the stock words' postings are looked up, not read through."""
    rng = np.random.default_rng(1)
    n, names = 20_000, 2_000
    claim = np.concatenate([np.arange(n)] * 4)
    term = np.concatenate([names + np.zeros(n, int), names + 1 + np.zeros(n, int), names + 2 + np.zeros(n, int),
                           rng.integers(0, names, n)])
    order = np.lexsort((claim, term))
    claim, term = claim[order], term[order]
    terms, first = np.unique(term, return_index=True)
    a = np.where(term >= names, rng.uniform(0.01, 0.05, len(term)), rng.uniform(2, 4, len(term)))
    index = CI.Index(np.arange(n), terms, np.append(first, len(term)), claim, a, np.zeros(len(a)), np.ones(n), np.ones(n),
                     np.maximum.reduceat(a, first), np.zeros(len(terms)), 0.0)
    wanted = np.searchsorted(terms, [7, names, names + 1, names + 2])
    tf = np.array([1.0, 3.0, 2.0, 1.0])
    got, dot, _, read = CI.pruned(index, wanted, tf, 3)
    full = np.zeros(n)
    for t, f in zip(wanted, tf):
        s, e = index.first[t:t + 2]
        np.add.at(full, claim[s:e], f * a[s:e])
    best = np.argsort(-full)[:3]
    assert set(best) <= set(got) and np.allclose(full[got], dot)
    assert read * 500 < 3 * n  # 60 000 postings without pruning


def test_an_index_is_built_once_per_catalogue(spark, tables, tmp_path, monkeypatch):
    posts, claims = tables
    folder, built = str(tmp_path / "kept"), []

    def build(*args, **kw):
        built.append(1)
        return CI.tfidf_postings(*args, **kw)

    first = CI.kept_postings(claims, folder, build, claim_id="cid")
    again = CI.kept_postings(claims.repartition(3), folder, build, claim_id="cid")
    assert len(built) == 1 and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan parquet" in plan
    more = claims.union(spark.createDataFrame([(999, "a new claim")], claims.schema))
    assert CI.kept_postings(more, folder, build, claim_id="cid").where("cid = 999").count() == 2 and len(built) == 2
    # a build that broke off before its end is built again
    import os
    for d in os.listdir(folder):
        os.remove(f"{folder}/{d}/_SUCCESS")
    CI.kept_postings(claims, folder, build, claim_id="cid")
    assert len(built) == 3
