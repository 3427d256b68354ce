"""Periodic runs of words by uniting suffix classes.

A run is a stretch of words with smallest period q, at least ``2 * q`` and
``min_words`` long, that neither neighbour extends.  A text's suffixes are
sorted (prefix doubling on word numbers), and classes of suffixes are united
by decreasing length l of common prefixes, as Kruskal does with edges; each
class keeps its positions in order, and the smaller joins the larger.  Where
i < j of the two classes become neighbours in the united order, the words at
i and j agree for exactly l words; if j - i <= l they are a run of period
j - i from i to j + l, once no word before i extends it.  No position between
i and j shares l words with them, so j - i is the smallest period; and the
start of every run meets its second period so.  Every run is found once.

Only common prefixes of half ``min_words`` can make a run, so a text without
two equal stretches of that length (found by hashes) is done at once, and
shorter prefixes unite nothing.

Tasks work text by text: sorting takes n log^2 n steps for n words, uniting n
log n look-ups; memory is some hundred bytes a word of one text.

Edge cases: null and empty texts have no run and collapse to ''; rows with
equal or null doc_ids are texts of their own; an empty table gives an empty
result; other columns are kept, but for those named ``n_runs``, ``runs`` and
``collapsed``, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each suffix) of numbered words."""
    n = len(codes)
    rank, step = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[:n - step] += rank[step:] + 1  # a suffix that ends here comes first
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank, step = new, 2 * step
        if rank[order[-1]] == n - 1 or step >= 2 * n:
            return order, rank


def common_prefixes(codes: list[int], order: list[int], rank: list[int]) -> list[int]:
    """Words that each suffix shares with the one before it in the order."""
    n, shared = len(codes), 0
    out = [0] * n
    for i in range(n):
        r = rank[i]
        if r == 0:
            shared = 0
            continue
        j = order[r - 1]
        top = n - max(i, j)
        while shared < top and codes[i + shared] == codes[j + shared]:
            shared += 1
        out[r] = shared
        if shared:
            shared -= 1
    return out


def has_repeat(codes: np.ndarray, width: int) -> bool:
    """Whether two stretches of ``width`` words have equal hashes."""
    if len(codes) <= width:
        return False
    words = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    words ^= words >> np.uint64(32)
    h = np.zeros(len(codes) - width + 1, np.uint64)
    for i in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i:len(h) + i]
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def find_runs(codes: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    least = -(-min_words // 2)
    if not has_repeat(codes, least):
        return []
    order, rank = suffix_array(codes)
    order, words = order.tolist(), codes.tolist()
    shared = np.array(common_prefixes(words, order, rank.tolist()))
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    runs = []

    def root(i: int) -> int:
        top = i
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[i] != top:
            parent[i], i = top, parent[i]
        return top

    def seed(i: int, j: int, length: int) -> None:
        period = j - i
        if period <= length and length + period >= min_words and (i == 0 or words[i - 1] != words[j - 1]):
            runs.append((i, length + period, period))

    edges = np.flatnonzero(shared >= least)
    for at in edges[np.argsort(-shared[edges], kind="stable")].tolist():
        length = int(shared[at])
        a, b = root(order[at - 1]), root(order[at])
        large, small = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        for k, s in enumerate(small):  # neighbours in the united order, one from each class
            p = bisect_left(large, s)
            if p and (k == 0 or small[k - 1] < large[p - 1]):
                seed(large[p - 1], s, length)
            if p < len(large) and (k + 1 == len(small) or small[k + 1] > large[p]):
                seed(s, large[p], length)
        if len(small) * 16 > len(large):
            large += small
            large.sort()  # merges two sorted stretches
        else:
            for s in small:
                insort(large, s)
        parent[b] = a
        members[a] = large
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that some run holds after its first period."""
    kept, done = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        if start > done:
            kept += words[done:start]
        done = max(done, end)
    return b" ".join(kept + words[done:])


def detect(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``n_runs``, ``runs`` (start, length, period in words, by
    start, then period) and ``collapsed``, the text with every run cut to its
    first period and single spaces."""
    rest = [c for c in docs.columns if c not in ("n_runs", "runs", "collapsed")]

    @F.pandas_udf(f"runs {RUNS}, collapsed string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                words = (t or "").encode("utf-8", "surrogatepass").split()  # ASCII white space only
                runs = find_runs(pd.factorize(np.array(words, object))[0], min_words) if len(words) >= min_words else []
                out.append(([dict(zip(("start", "length", "period"), r)) for r in runs],
                            collapse(words, runs).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["runs", "collapsed"])

    return docs.select(*rest, found(F.col(text)).alias("_f")).select(
        *rest, F.size("_f.runs").cast("bigint").alias("n_runs"), "_f.runs", "_f.collapsed")
