"""Sparse top-k against a claim index (RET-01, RET-05, TOP-01/04/05) and an
index kept between queries (RET-06).

The index is a table of postings, one row per claim and term, with the term's
weight in the claim.  It depends on the claims only, so it is written once
per state of the catalogue, under the catalogue's digest, and every later
query reads it.  Below ``MAX_BROADCAST_BYTES`` it is broadcast as sorted
arrays and posts are scored inside their scan's tasks: no row per shared term
and no exchange of posts, only the k best claims of each post leave a task.
A larger catalogue is scored by the term joins of ``retrieval``.

Within a task, posts whose terms have few postings are scored together.  For
the others (more than ``PRUNE_ROWS`` postings) terms come in order of their
greatest possible contribution.  Once the contributions of the terms still to
come cannot lift a new claim to the k-th best score so far, those terms, the
frequent ones, only complete claims that are already candidates and can still
get there; nothing is lost, and ties are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.text import word_tokens
from claimspark.operators import retrieval as R
from claimspark.operators.common import spread
from claimspark.operators.vector_search import MAX_BROADCAST_BYTES
from claimspark.session import path_exists, scratch_path

PRUNE_ROWS = 50_000
CHUNK_ROWS = 1 << 20
BATCH_TOKENS = 1 << 18
POSTING_BYTES = 40
SLACK = 1 - 1e-9  # sums in another order may differ in their last digits


class Index(NamedTuple):
    """Postings sorted by (term, claim); claims are numbered in id order.
    A claim's score is ``dot / sqrt(norm * (base + corr))``, where ``dot``
    and ``corr`` are sums over shared terms of ``tf * a`` and ``b``, and
    ``norm`` is the post's (1 where ``absent`` is 0)."""
    ids: np.ndarray
    terms: np.ndarray    # hash of each term, ascending
    first: np.ndarray    # its first posting; one more entry at the end
    claim: np.ndarray
    a: np.ndarray
    b: np.ndarray
    base: np.ndarray     # per claim
    low: np.ndarray      # per claim: least value of base + corr
    peak: np.ndarray     # per term: greatest a / sqrt(low)
    weight: np.ndarray   # per term: its part of the post's norm
    absent: float        # the same for a term no claim has


def _terms(claims: DataFrame, claim_id: str, text: str, tokenizer) -> DataFrame:
    """(cid, tok, tf, len, df); windows, since a catalogue that is indexed is
    below the broadcast limit."""
    toks = tokenizer(F.col(text))
    counts = (claims.select(F.col(claim_id).alias("cid"), toks.alias("toks"))
              .select("cid", F.size("toks").alias("len"), F.explode("toks").alias("tok"))
              .groupBy("cid", "tok").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len")))
    return counts.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("tok")))


def tfidf_postings(claims: DataFrame, n: int, n_tok: int, *, claim_id: str, text: str = "text",
                   tokenizer=word_tokens) -> DataFrame:
    """RET-01's postings (h, cid, a, b, base, low, weight, absent) of ``n``
    claims with ``n_tok`` tokens."""
    i0, i1 = (F.log((F.lit(float(n)) + 2) / (F.col("df") + d)) + 1 for d in (1, 2))
    rows = _terms(claims, claim_id, text, tokenizer).withColumns({"i0": i0, "i1": i1})
    of_claim = Window.partitionBy("cid")
    absent = (F.log((F.lit(float(n)) + 2) / 2) + 1) ** 2
    return rows.select(
        F.xxhash64("tok").alias("h"), "cid", (F.col("tf") * F.col("i1") ** 2).alias("a"),
        (F.col("tf") ** 2 * (F.col("i1") ** 2 - F.col("i0") ** 2)).alias("b"),
        F.sum(F.col("tf") ** 2 * F.col("i0") ** 2).over(of_claim).alias("base"),
        F.sum(F.col("tf") ** 2 * F.col("i1") ** 2).over(of_claim).alias("low"),
        (F.col("i1") ** 2).alias("weight"), absent.alias("absent"))


def bm25_postings(claims: DataFrame, n: int, n_tok: int, *, claim_id: str, text: str = "text", tokenizer=word_tokens,
                  k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """RET-05's postings, the same weights as in ``retrieval.bm25``."""
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    long = 1 - b + b * F.col("len") / F.lit(n_tok / n if n else 1.0)
    one, none = F.lit(1.0), F.lit(0.0)
    return _terms(claims, claim_id, text, tokenizer).select(
        F.xxhash64("tok").alias("h"), "cid", (idf * F.col("tf") / (F.col("tf") + k1 * long)).alias("a"),
        none.alias("b"), one.alias("base"), one.alias("low"), none.alias("weight"), none.alias("absent"))


def kept_postings(claims: DataFrame, folder: str, build=tfidf_postings, *, claim_id: str, text: str = "text",
                  tokenizer=word_tokens) -> DataFrame | None:
    """RET-06: the postings of this state of the catalogue, read from
    ``folder`` or, where they are not there yet, built and written; None for
    a catalogue beyond the broadcast limit.  The name is of the kind and a
    digest of ids and texts, whatever their order."""
    spark = claims.sparkSession
    r = claims.agg(F.count(F.lit(1)).alias("n"),
                   F.coalesce(F.sum(F.size(tokenizer(F.col(text)))), F.lit(0)).alias("n_tok"),
                   F.sum(F.xxhash64(claim_id, text).cast("decimal(38,0)")).alias("s"),
                   F.sum(F.xxhash64(text, claim_id, F.lit(1)).cast("decimal(38,0)")).alias("t")).first()
    if r["n_tok"] * POSTING_BYTES > MAX_BROADCAST_BYTES:
        return None
    path = f"{folder.rstrip('/')}/{build.__name__}-{r['n']}-{r['s'] or 0}-{r['t'] or 0}"
    if not path_exists(spark, f"{path}/_SUCCESS"):  # written last: a broken build is built again
        build(claims, r["n"], r["n_tok"], claim_id=claim_id, text=text, tokenizer=tokenizer) \
            .coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load(postings: DataFrame) -> Index | None:
    """The postings (of a catalogue within the limit) as arrays; None if two
    terms of a claim share a hash."""
    pdf = postings.toPandas()
    n = len(pdf)
    ids, claim = np.unique(pdf["cid"].to_numpy(), return_inverse=True)
    h = pdf["h"].to_numpy(np.int64)
    order = np.lexsort((claim, h))
    h, claim = h[order], claim[order].astype(np.int64)
    terms, first = np.unique(h, return_index=True)
    if n and ((h[1:] == h[:-1]) & (claim[1:] == claim[:-1])).any():
        return None
    a, b, base, low, weight = (pdf[c].to_numpy(np.float64)[order] for c in ("a", "b", "base", "low", "weight"))
    per_claim = np.zeros(len(ids)), np.ones(len(ids))
    per_claim[0][claim], per_claim[1][claim] = base, low
    peak = np.maximum.reduceat(a / np.sqrt(low), first) if n else np.empty(0)
    return Index(ids, terms, np.append(first, n), claim, a, b, *per_claim, peak, weight[first] if n else weight,
                 float(pdf["absent"].iloc[0]) if n else 0.0)


def _expand(index: Index, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``term``, posting) for every posting of the terms."""
    size = index.first[term + 1] - index.first[term]
    which = np.repeat(np.arange(len(term)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size - index.first[term], size)


def _sums(index: Index, key: np.ndarray, tf: np.ndarray, posting: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, dot, corr) of posting rows."""
    if key.max(initial=0) < 2 * len(key):  # dense enough to count without sorting
        found = np.flatnonzero(np.bincount(key))
        return found, np.bincount(key, tf * index.a[posting])[found], np.bincount(key, index.b[posting])[found]
    found, place = np.unique(key, return_inverse=True)
    return found, np.bincount(place, tf * index.a[posting], len(found)), np.bincount(place, index.b[posting], len(found))


def pruned(index: Index, term: np.ndarray, tf: np.ndarray, k: int, block: int = 4096) -> tuple[np.ndarray, ...]:
    """(claims, dot, corr, postings read) of one post: every claim that may
    be among its k best, scored by all terms."""
    order = np.argsort(-tf * index.peak[term], kind="stable")
    term, tf = term[order], tf[order]
    rest = np.append(np.cumsum((tf * index.peak[term])[::-1])[::-1], 0.0)
    size = np.cumsum(index.first[term + 1] - index.first[term])
    claim, dot, corr = np.empty(0, np.int64), np.empty(0), np.empty(0)
    at = read = 0
    floor = 0.0
    while at < len(term) and rest[at] >= floor * SLACK:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + block, "right")))
        which, posting = _expand(index, term[at:end])
        read += len(posting)
        more = _sums(index, index.claim[posting], tf[at:end][which], posting)
        merged, place = np.unique(np.concatenate([claim, more[0]]), return_inverse=True)
        dot = np.bincount(place, np.concatenate([dot, more[1]]), len(merged))
        corr = np.bincount(place, np.concatenate([corr, more[2]]), len(merged))
        claim, at = merged, end
        if len(claim) >= k:
            floor = np.partition(dot / np.sqrt(index.base[claim]), len(claim) - k)[len(claim) - k]
    # the remaining terms complete what can still reach the k-th best
    keep = dot / np.sqrt(index.low[claim]) + rest[at] >= floor * SLACK
    claim, dot, corr = claim[keep], dot[keep], corr[keep]
    for t, n in zip(term[at:], tf[at:]):
        s, e = index.first[t], index.first[t + 1]
        place = s + np.searchsorted(index.claim[s:e], claim)
        hit = place < e
        hit[hit] = index.claim[place[hit]] == claim[hit]
        read += int(hit.sum())
        dot[hit] += n * index.a[place[hit]]
        corr[hit] += index.b[place[hit]]
    return claim, dot, corr, read


def score_batch(index: Index, tokens: list[np.ndarray], k: int, prune_rows: int = PRUNE_ROWS,
                chunk_rows: int = CHUNK_ROWS) -> tuple[np.ndarray, ...]:
    """(post number, claim number, score, rank) of each post's k best."""
    post = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    h = np.concatenate([np.asarray(t, np.int64) for t in tokens] + [np.empty(0, np.int64)])
    order = np.lexsort((h, post))
    post, h = post[order], h[order]
    start = np.flatnonzero(np.r_[True, (post[1:] != post[:-1]) | (h[1:] != h[:-1])][:len(h)])
    tf = np.diff(np.append(start, len(h))).astype(np.float64)
    post, h = post[start], h[start]
    term = np.minimum(np.searchsorted(index.terms, h), max(len(index.terms) - 1, 0))
    known = index.terms[term] == h if len(index.terms) else np.zeros(len(h), bool)
    part = np.full(len(h), index.absent)
    part[known] = index.weight[term[known]]
    norm = np.bincount(post, tf * tf * part, len(tokens)) if index.absent else np.ones(len(tokens))
    post, term, tf = post[known], term[known], tf[known]
    rows = index.first[term + 1] - index.first[term]
    per_post = np.bincount(post, rows, len(tokens))
    n, found = max(len(index.ids), 1), []
    heavy = per_post > prune_rows
    light = ~heavy[post]
    cuts = np.flatnonzero(np.diff(np.cumsum(rows[light]) // chunk_rows, prepend=0))
    # chunks end where a post does
    posts = post[light]
    cuts = np.unique(np.searchsorted(posts, posts[cuts])) if len(cuts) else cuts
    for p, t, f in zip(*(np.split(x[light], cuts) for x in (post, term, tf))):
        which, posting = _expand(index, t)
        if len(which):
            key, dot, corr = _sums(index, (p[which] - p[0]) * n + index.claim[posting], f[which], posting)
            found.append((key // n + p[0], key % n, dot, corr))
    for p in np.flatnonzero(heavy):
        s, e = np.searchsorted(post, [p, p + 1])
        claim, dot, corr, _ = pruned(index, term[s:e], tf[s:e], k)
        found.append((np.full(len(claim), p), claim, dot, corr))
    p, c, dot, corr = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4
    score = dot / np.sqrt(norm[p] * (index.base[c] + corr))
    order = np.lexsort((c, -np.round(score, 9), p))
    p, c, score = p[order], c[order], score[order]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]][:len(p)])
    rank = np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p)))) + 1
    best = rank <= k
    return p[best], c[best], score[best], rank[best]


def _slices(pdf: pd.DataFrame, tokens: int = BATCH_TOKENS) -> Iterator[pd.DataFrame]:
    """An Arrow batch in slices of about ``tokens`` terms: scoring holds some
    ten arrays as long as a slice."""
    place = np.cumsum([0 if t is None else len(t) for t in pdf["h"]]) // tokens
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1), len(pdf)]
    for s, e in zip(cuts, cuts[1:]):
        if e > s:
            yield pdf.iloc[s:e]


def top_k(posts: DataFrame, postings: DataFrame, *, post_id: str, claim_id: str, k: int, index: Index,
          text: str = "text", tokenizer=word_tokens, prune_rows: int = PRUNE_ROWS) -> DataFrame:
    """(post_id, claim_id, score, rank): the k best claims of every post that
    shares a term with any, ties to the smaller claim id; ``index`` holds the
    ``postings``."""
    spark = posts.sparkSession
    ids = dict(postings.dtypes)["cid"]
    shared = spark.sparkContext.broadcast(index)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for whole in batches:
            for pdf in _slices(whole):
                p, c, score, rank = score_batch(ix, [t if t is not None else [] for t in pdf["h"]], k, prune_rows)
                yield pd.DataFrame({post_id: pdf["pid"].to_numpy()[p], claim_id: ix.ids[c], "score": score, "rank": rank})

    dealt = spread(posts.select(F.col(post_id).alias("pid"), F.col(text).alias("text")), "pid")
    hashed = dealt.select("pid", F.transform(tokenizer(F.col("text")), lambda t: F.xxhash64(t)).alias("h"))
    kind = posts.schema[post_id].dataType.simpleString()
    return hashed.mapInPandas(best, f"`{post_id}` {kind}, `{claim_id}` {ids}, score double, rank bigint")


class Prepared(NamedTuple):
    """A claim catalogue made ready once for any number of batches of posts
    (RET-06, streams): its index, or the claims for term joins beyond the
    index's limit."""
    claims: DataFrame
    claim_id: str
    text: str
    joins: Callable
    n: int
    postings: DataFrame | None
    index: Index | None


def prepare(claims: DataFrame, *, claim_id: str, text: str = "text", bm25: bool = False,
            folder: str | None = None) -> Prepared:
    """With ``folder`` the index is kept there for later jobs."""
    build, joins = (bm25_postings, R.bm25) if bm25 else (tfidf_postings, R.tfidf_cosine)
    folder = folder or scratch_path(claims.sparkSession, "postings")
    postings = kept_postings(claims, folder, build, claim_id=claim_id, text=text)
    return Prepared(claims, claim_id, text, joins, claims.count(), postings, None if postings is None else load(postings))


def best_claims(posts: DataFrame, ready: Prepared, *, post_id: str, k: int, text: str = "text") -> DataFrame:
    """The k best claims of every post (TOP-01/04/05)."""
    if ready.index is not None:
        return top_k(posts, ready.postings, post_id=post_id, claim_id=ready.claim_id, k=k, text=text, index=ready.index)
    scores = ready.joins(posts, ready.claims, post_id=post_id, claim_id=ready.claim_id, text=text, claim_text=ready.text)
    return R.top_claims(scores, post_id=post_id, claim_id=ready.claim_id, k=k)


def tfidf_top_k(posts: DataFrame, claims: DataFrame, *, post_id: str, claim_id: str, k: int, text: str = "text",
                claim_text: str | None = None, folder: str | None = None) -> DataFrame:
    """RET-01 with TOP-01/04."""
    ready = prepare(claims, claim_id=claim_id, text=claim_text or text, folder=folder)
    return best_claims(posts, ready, post_id=post_id, k=k, text=text)


def bm25_top_k(posts: DataFrame, claims: DataFrame, *, post_id: str, claim_id: str, k: int, text: str = "text",
               claim_text: str | None = None, folder: str | None = None) -> DataFrame:
    """RET-05 with TOP-05."""
    ready = prepare(claims, claim_id=claim_id, text=claim_text or text, bm25=True, folder=folder)
    return best_claims(posts, ready, post_id=post_id, k=k, text=text)
