"""Dense scoring: averaged word vectors (RET-02, AGG-09), embedding cosine
top-k (RET-03, RET-06) and token soft matching (RET-04, AGG-12).

Plan shape: the claim catalogue is the small side.  It is collected once,
behind a size check, into numpy arrays and shipped to the executors as a
broadcast variable; the large side (posts) is streamed through
``mapInPandas`` in Arrow batches where a BLAS matrix product scores a whole
block of posts against the catalogue and only the best ``k`` claims per post
leave the task.  No post x claim rows are ever materialised (JOIN-04 as a
block product).  The pair scorer (UDF-02) is either a Column expression
(``functions.vectors``) or a block scorer passed in.  Scores are formed in
tiles of at most ``TILE_BYTES`` with a running top-k, so a task's memory does
not grow with the catalogue.  A catalogue above the broadcast limit never
passes through the driver: both sides are cut into blocks that Spark cogroups,
and the per-block top-k are merged by a window.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.text import glove_tokens
from claimspark.operators.common import PART_TEXT_BYTES, by_key, score_key, text_bytes, top_k

# Catalogue bytes (rows x dim x 8) shipped in one broadcast; larger
# catalogues are split into chunks of at most this size.
MAX_BROADCAST_BYTES = 256 << 20
# Vocabulary plans (whole word-vector table, vocabulary x claim-vector
# similarity) are used only under this size.
VOCAB_PLAN_MAX_BYTES = 256 << 20
# Scores a task forms at once, and each side of a cogrouped block.  A worker
# holds a few copies of either, and an executor has a worker per core.
TILE_BYTES = 16 << 20
# Similarities that a worker keeps for soft matching.
STORE_BYTES = 256 << 20
# Word vectors that soft matching collects as one table, of which the driver
# holds some twenty times as much meanwhile; and the blocks of larger ones.
COLLECT_MAX_BYTES = 16 << 20
VECTOR_BLOCK_BYTES = 4 << 20
# Catalogue of dense vectors that every worker may hold; above, blocks.
CATALOGUE_MAX_BYTES = 64 << 20


# ----------------------------------------------------------------- averages
def token_counts(df: DataFrame, id_col: str, text: str, tokenizer=glove_tokens, word_key=None,
                 keep_empty: bool = False) -> DataFrame:
    """(id, word, cnt) after repartitioning the texts by id.  With
    ``word_key`` (a function Column -> Column) tokens are first mapped to a
    vocabulary key (NULL = out of vocabulary) and counted per key.  With
    ``keep_empty`` every id keeps at least one row (word NULL when it has no
    in-vocabulary token), so no join back to the ids is needed."""
    exploder = F.explode_outer if keep_empty else F.explode
    toks = (by_key(df.select(F.col(id_col).alias("id"), F.col(text)), "id", text=text)
              .select("id", exploder(tokenizer(F.col(text))).alias("word")))
    if word_key is not None:
        toks = toks.select("id", word_key(F.col("word")).alias("word"))
        if not keep_empty:
            toks = toks.filter(F.col("word").isNotNull())
    return toks.groupBy("id", "word").agg(F.count(F.lit(1)).alias("cnt"))


def _vocab_size(vectors: DataFrame, vec: str) -> tuple[int, int]:
    r = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    return int(r["n"]), int(r["d"] or 0)


def _number_bytes(vectors: DataFrame, vec: str) -> int:
    return 4 if vectors.schema[vec].dataType.simpleString() == "array<float>" else 8


def _collect_vocab(vectors: DataFrame, word: str, vec: str):
    """Words and their vectors, in the numbers' own width."""
    pdf = vectors.select(word, vec).toPandas()
    kind = np.float32 if _number_bytes(vectors, vec) == 4 else np.float64
    mat = np.stack([np.asarray(x, dtype=kind) for x in pdf[vec]]) if len(pdf) else np.zeros((0, 0))
    return pdf[word].tolist(), mat


@dataclass
class Vocab:
    """A word-vector table (word, vec) that fits one broadcast."""
    vectors: DataFrame
    dim: int


def load_vocab(vectors: DataFrame, word: str = "word", vec: str = "vec") -> Vocab | None:
    """The table, its size found once for several texts or for a whole
    stream; None above the size limit."""
    n, d = _vocab_size(vectors, vec)
    if n * d * _number_bytes(vectors, vec) > VOCAB_PLAN_MAX_BYTES:
        return None
    return Vocab(vectors.select(F.col(word).alias("word"), F.col(vec).alias("vec")).where("vec is not null"), d)


def wordvec_average(df: DataFrame, vectors: DataFrame, *, id_col: str, text: str = "text",
                    tokenizer=glove_tokens, word: str = "word", vec: str = "vec",
                    word_key=None, vocab: Vocab | None = None) -> DataFrame:
    """RET-02 encoder (AGG-09 + JOIN-10): element-wise mean of the vectors
    of the in-vocabulary tokens (out-of-vocabulary tokens dropped); a text
    without any known token gets the zero vector.

    A vocabulary that fits one broadcast (size-checked) is joined to the
    token counts where these lie, one copy per executor, and each place of
    the vectors is summed per text: no vector is shuffled or enters Python.
    A larger vocabulary is joined by Spark (shuffle join) and averaged with
    MLlib's ``Summarizer`` (weighted mean, map-side partial aggregation).
    ``vocab`` is a table already sized by :func:`load_vocab`.
    """
    vocab = vocab or load_vocab(vectors, word, vec)
    if vocab:
        # every text keeps a row (explode_outer + left join), so texts without
        # known tokens need no join back: one exchange (texts by id)
        known = (token_counts(df, id_col, text, tokenizer, word_key, keep_empty=True)
                 .join(F.broadcast(vocab.vectors), "word", "left"))
        sums = known.groupBy("id").agg(
            F.sum(F.when(F.col("vec").isNotNull(), F.col("cnt"))).alias("n"),
            *[F.sum(F.col("cnt") * F.get("vec", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(vocab.dim)])
        mean = [F.coalesce(F.col(f"s{i}") / F.col("n"), F.lit(0.0)) for i in range(vocab.dim)]
        return sums.select(F.col("id").alias(id_col), F.array(*mean).cast("array<double>").alias("vec"))
    _, d = _vocab_size(vectors, vec)
    counts = token_counts(df, id_col, text, tokenizer, word_key)
    v = vectors.select(F.col(word).alias("word"), array_to_vector(F.col(vec)).alias("v"))
    means = (counts.join(v, "word")
                   .groupBy("id").agg(Summarizer.mean(F.col("v"), F.col("cnt").cast("double")).alias("m"))
                   .select("id", vector_to_array("m").alias("vec")))
    return (df.select(F.col(id_col).alias("id")).join(means, "id", "left")
              .select(F.col("id").alias(id_col),
                      F.coalesce(F.col("vec"), F.array_repeat(F.lit(0.0), d)).alias("vec")))


# ------------------------------------------------------------- catalogue io
def _matrix(rows, dim: int | None = None) -> np.ndarray:
    """Vectors as rows of one matrix; unequal dimensions are an error (FN-20)."""
    rows = [np.asarray(x, dtype=np.float64) for x in rows]
    if len({len(r) for r in rows} | ({dim} if dim is not None else set())) > 1:
        raise ValueError("Embedding dimensions must match")
    return np.stack(rows) if rows else np.zeros((0, dim or 0))


def _sorted_catalogue(pdf: pd.DataFrame, c_id: str, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) in id order, so that a lower place wins a tie."""
    pdf = pdf.sort_values(c_id, ignore_index=True)
    return pdf[c_id].to_numpy(), _matrix(pdf[vec])


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, m / np.where(n > 0, n, 1.0), 0.0)


def _row_topk(scores: np.ndarray, ids: np.ndarray, k: int):
    """Indices of the best k per row: score (rounded to 9 places) desc, id asc."""
    r = np.round(scores, 9)
    kk = min(k, r.shape[1])
    if kk == 0:
        return [np.zeros(0, dtype=int)] * r.shape[0]
    kth = -np.partition(-r, kk - 1, axis=1)[:, kk - 1]
    out = []
    for i in range(r.shape[0]):
        cand = np.nonzero(r[i] >= kth[i])[0]
        order = np.lexsort((ids[cand], -r[i, cand]))
        out.append(cand[order[:kk]])
    return out


# ------------------------------------------------------------ cosine top-k
def cosine_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of every row pair; zero vectors score 0 (Q15)."""
    return _unit(q) @ _unit(c).T


def _block_top_k(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int, scorer,
                 exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, catalogue place, score) of the best ``k`` per query in
    rank order.  Scores exist one tile at a time, with a running top-k."""
    cols = max(1, min(len(c), TILE_BYTES // (8 * 256)))
    rows = max(1, TILE_BYTES // (8 * cols))
    out = []
    for i in range(0, len(q), rows):
        part = q[i:i + rows]
        best, at = np.empty((len(part), 0)), np.empty((len(part), 0), np.int64)
        for j in range(0, len(c), cols):
            s = scorer(part, c[j:j + cols])
            s = np.where(np.isnan(s), -np.inf, s)  # an undefined score never wins (Q20)
            if exclude_self:
                s = np.where(qids[i:i + rows, None] == cids[None, j:j + cols], -np.inf, s)
            pick = np.stack(_row_topk(s, np.arange(s.shape[1]), k))
            best, at = np.hstack([best, np.take_along_axis(s, pick, 1)]), np.hstack([at, pick + j])
            order = np.lexsort((at, -np.round(best, 9)), axis=1)[:, :k]
            best, at = np.take_along_axis(best, order, 1), np.take_along_axis(at, order, 1)
        y, x = np.nonzero(best > -np.inf)
        out.append((y + i, at[y, x], best[y, x]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _ranked(qids: np.ndarray, cids: np.ndarray, found, names: list[str]) -> pd.DataFrame:
    y, x, score = found
    first = np.r_[True, y[1:] != y[:-1]] if len(y) else np.empty(0, bool)
    place = np.arange(len(y))
    rank = place - np.maximum.accumulate(np.where(first, place, 0)) + 1 if len(y) else place
    return pd.DataFrame(dict(zip(names, (qids[y], cids[x], score, rank.astype(np.int64)))))


def cosine_top_k(queries: DataFrame, catalogue: DataFrame, *, q_id: str, c_id: str,
                 vec: str = "vec", k: int = 5, exclude_self: bool = False, rank_col: str = "rank",
                 scorer: Callable[[np.ndarray, np.ndarray], np.ndarray] = cosine_scores) -> DataFrame:
    """RET-03 / RET-02: the ``k`` catalogue rows most cosine-similar to each
    query row (zero vectors score 0, Q15).  ``exclude_self`` drops the pair
    of a row with itself (kNN within one table).  ``scorer`` may be any
    function of two matrices that gives the score of every row pair (UDF-02);
    undefined scores are left out."""
    spark = queries.sparkSession
    qtype = queries.schema[q_id].dataType.simpleString()
    ctype = catalogue.schema[c_id].dataType.simpleString()
    schema, names = f"{q_id} {qtype}, {c_id} {ctype}, score double, {rank_col} bigint", [q_id, c_id, "score", rank_col]
    stats = catalogue.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    size = stats["n"] * max(stats["d"] or 0, 1) * 8
    if size > min(MAX_BROADCAST_BYTES, CATALOGUE_MAX_BYTES):
        return _cogrouped_top_k(queries, catalogue, size, stats["d"], q_id, c_id, vec, k, exclude_self, rank_col,
                                scorer, schema, names)
    ids, mat = _sorted_catalogue(catalogue.select(c_id, vec).toPandas(), c_id, vec)
    if not len(ids):
        return spark.createDataFrame([], schema)
    bc = spark.sparkContext.broadcast((ids, mat))

    def score_blocks(batches):
        cids, cm = bc.value
        for pdf in batches:
            if not pdf.empty:
                qids = pdf[q_id].to_numpy()
                yield _ranked(qids, cids, _block_top_k(qids, _matrix(pdf[vec], cm.shape[1]), cids, cm, k, scorer,
                                                       exclude_self), names)

    # every query row is ranked completely inside its task
    return queries.select(q_id, vec).mapInPandas(score_blocks, schema)


def _cogrouped_top_k(queries, catalogue, size, dim, q_id, c_id, vec, k, exclude_self, rank_col, scorer, schema, names):
    """Both sides in blocks of about ``TILE_BYTES``; each pair of blocks is
    one group, and a window merges the blocks' top-k."""
    n_c = -(-size // TILE_BYTES)
    n_q = -(-queries.count() * max(dim, 1) * 8 // TILE_BYTES) or 1

    def cell(key: str, n: int):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # names of their own: both sides may be one table, and a cogroup of equal columns loses them
    q = queries.select(F.col(q_id).alias("_q"), F.col(vec).alias("_u"), cell(q_id, n_q).alias("_a"), every(n_c).alias("_b"))
    c = catalogue.select(F.col(c_id).alias("_c"), F.col(vec).alias("_v"), cell(c_id, n_c).alias("_b"), every(n_q).alias("_a"))

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        qids, (cids, cm) = left["_q"].to_numpy(), _sorted_catalogue(right, "_c", "_v")
        if not len(qids) or not len(cids):
            return pd.DataFrame(columns=names)
        return _ranked(qids, cids, _block_top_k(qids, _matrix(left["_u"], cm.shape[1]), cids, cm, k, scorer,
                                                exclude_self), names)

    found = q.groupBy("_a", "_b").cogroup(c.groupBy("_a", "_b")).applyInPandas(block, schema)
    return top_k(found.drop(rank_col), q_id, [score_key("score").desc(), F.col(c_id).asc()], k, rank_col)


# ---------------------------------------------------------- soft matching
def _claim_blocks(claims: DataFrame, vectors: DataFrame, claim_id: str, claim_text: str, tokenizer, word, vec,
                  word_key) -> list[DataFrame]:
    """The claims in as many blocks as keep each block's token table and
    word vectors below what the driver and every worker may hold (one claim is
    never cut)."""
    v = vectors.select(F.col(word).alias("word"), F.size(vec).alias("d"))
    n = (token_counts(claims, claim_id, claim_text, tokenizer, word_key).join(v, "word")
         .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("w"), F.max("d").alias("d")).first())
    size = max(n["n"] * 32, (n["w"] or 0) * (n["d"] or 0) * 8)
    count = -(-size // min(MAX_BROADCAST_BYTES, CATALOGUE_MAX_BYTES)) or 1
    if count == 1:
        return [claims]
    cell = F.pmod(F.xxhash64(claim_id), F.lit(count))
    return [claims.where(cell == i) for i in range(count)]


def _softmatch_catalogue(claims: DataFrame, v: DataFrame, claim_id: str, claim_text: str, tokenizer,
                         word_key=None):
    """Claim side of soft matching as numpy: distinct claim words x dim
    (unit rows), and per claim its word indices and counts.  Bounded by
    :func:`_claim_blocks`; a word with several vectors counts with each."""
    counts = token_counts(claims, claim_id, claim_text, tokenizer, word_key)
    cw = v.join(counts.select("word").distinct(), "word", "left_semi").toPandas()
    ymat = _unit(np.stack([np.asarray(x, dtype=np.float64) for x in cw["vec"]])) if len(cw) else np.zeros((0, 1))
    cl = counts.toPandas().merge(pd.DataFrame({"word": cw["word"], "w": np.arange(len(cw))}), on="word")
    cl = cl.sort_values(["id", "w"])
    cids = cl["id"].drop_duplicates().to_numpy()
    offsets = np.searchsorted(cl["id"].to_numpy(), cids)
    return (cids, offsets, cl["w"].to_numpy().astype(np.int64), cl["cnt"].to_numpy().astype(np.float64), ymat)


class _Places:
    """Where the vectors of a word lie in a table that has one row per vector."""

    def __init__(self, words):
        codes, known = pd.factorize(words)
        self.known, self.many = pd.Index(known), np.bincount(codes, minlength=len(known))
        self.order, self.first = np.argsort(codes, kind="stable"), np.cumsum(self.many) - self.many

    def entries(self, text: np.ndarray, words, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, row, count) of every vector of each word, by text; words
        without one go."""
        code = self.known.get_indexer(words)
        text, counts, code = text[code >= 0], counts[code >= 0], code[code >= 0]
        n = self.many[code]
        again = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text, row = np.repeat(text, n), self.order[np.repeat(self.first[code], n) + again]
        by_text = np.argsort(text, kind="stable")
        return text[by_text], row[by_text], np.repeat(counts, n)[by_text].astype(np.float64)


def _tile_scores(ids: np.ndarray, text: np.ndarray, row: np.ndarray, cnt: np.ndarray, vectors_at: Callable,
                 catalogue) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, precision, recall) of texts against all claims, from the places
    of the texts among ``ids``, the rows of their words' vectors and the counts,
    by text; a text without a vector is left out.  Texts are taken as many at
    once, and words in blocks of as many, as ``STORE_BYTES / 8`` of
    similarities hold; a word's are formed once for the texts of a tile."""
    cids, offs, loc, ccnt, y = catalogue
    length = np.add.reduceat(ccnt, offs)
    texts = max(1, STORE_BYTES // 8 // (8 * (len(y) + 6 * len(cids))))
    width = max(1, STORE_BYTES // 8 // (8 * (len(y) + len(cids))))
    step, few = max(1, TILE_BYTES // (32 * len(loc))), min(width, 256)
    block = np.empty((few, len(y)))
    for lo in range(0, len(ids), texts):
        s, e = np.searchsorted(text, [lo, lo + texts])
        if s == e:
            continue
        n = min(texts, len(ids) - lo)
        prec, nmax = np.zeros((n, len(cids))), np.full((n, len(y)), -np.inf)
        used, at = np.unique(row[s:e], return_inverse=True)
        order = np.argsort(at // width * n + text[s:e] - lo, kind="stable")
        t, at, c = text[s:e][order] - lo, at[order], cnt[s:e][order]
        cuts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (at[1:] // width != at[:-1] // width), True])
        now = -1
        for s, e in zip(cuts[:-1], cuts[1:]):  # the words of a block that a text has
            if at[s] // width != now:
                now = at[s] // width
                part = used[now * width:(now + 1) * width]
                sim, best = np.empty((len(part), len(y))), np.empty((len(part), len(cids)))
                for i in range(0, len(part), step):
                    sim[i:i + step] = _unit(vectors_at(part[i:i + step]).astype(np.float64)) @ y.T
                    best[i:i + step] = np.maximum.reduceat(sim[i:i + step][:, loc], offs, axis=1)
            for i in range(s, e, few):
                a = at[i:min(i + few, e)] - now * width
                prec[t[s]] += c[i:min(i + few, e)] @ best[a]
                seen = np.take(sim, a, axis=0, out=block[:len(a)], mode="clip").max(axis=0)
                np.maximum(nmax[t[s]], seen, out=nmax[t[s]])
        total = np.bincount(t, weights=c, minlength=n)
        has = total > 0
        yield (ids[lo:lo + n][has], prec[has] / total[has, None],
               np.add.reduceat(nmax[has][:, loc] * ccnt, offs, axis=1) / length)


def _broadcast_blocks(v: DataFrame, size: int) -> list:
    """The word vectors (word, vec) as broadcast variables of about
    ``VECTOR_BLOCK_BYTES``, collected one at a time: (words, matrix)."""
    kind = np.float32 if _number_bytes(v, "vec") == 4 else np.float64

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(pdf["word"].to_numpy(), np.stack(pdf["vec"].to_numpy()).astype(kind)) for pdf in batches if len(pdf)]
        if parts:
            yield pd.DataFrame({"block": [pickle.dumps(tuple(np.concatenate(x) for x in zip(*parts)), protocol=5)]})

    sc = v.sparkSession.sparkContext
    packed = v.repartition(-(-size // VECTOR_BLOCK_BYTES), "word").mapInPandas(pack, "block binary")
    return [sc.broadcast(pickle.loads(r["block"])) for r in packed.toLocalIterator()]


class _Similarities:
    """Per Python worker: similarities of vocabulary words to the distinct
    claim words, and their maxima per claim, formed where a text first has
    the word and kept in at most ``TILE_BYTES`` (all of them where they fit;
    else a full store starts anew)."""
    kept: _Similarities | None = None

    def __init__(self, value):
        self.key, self.words, cv, self.loc, self.offs, self.ccnt, self.cids = value
        self.claim_words = _unit(self.words[cv].astype(np.float64))
        self.length = np.add.reduceat(self.ccnt, self.offs) if len(self.offs) else np.zeros(0)
        rows = max(1, min(len(self.words), STORE_BYTES // (8 * max(1, len(cv) + len(self.cids)))))
        self.sim, self.best = np.empty((rows, len(cv))), np.empty((rows, len(self.cids)))
        self.block = np.empty((min(rows, 256), len(cv)))
        self.place, self.used = np.full(len(self.words), -1, np.int32), 0

    @classmethod
    def of(cls, bc) -> _Similarities:
        if cls.kept is None or cls.kept.key != bc.value[0]:
            cls.kept = None
            cls.kept = cls(bc.value)
        return cls.kept

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Places of different words, at most as many as a block holds."""
        new = words[self.place[words] < 0]
        if self.used + len(new) > len(self.sim):
            self.place.fill(-1)
            self.used, new = 0, words
        step = max(1, TILE_BYTES // (32 * max(1, len(self.loc))))
        for i in range(0, len(new), step):
            part = new[i:i + step]
            at = slice(self.used, self.used + len(part))
            self.sim[at] = _unit(self.words[part].astype(np.float64)) @ self.claim_words.T
            self.best[at] = np.maximum.reduceat(self.sim[at][:, self.loc], self.offs, axis=1)
            self.place[part] = np.arange(at.start, at.stop)
            self.used = at.stop
        return self.place[words]

    def score(self, words, counts) -> tuple[np.ndarray, np.ndarray]:
        """(precision, recall) of a text against every claim."""
        words, counts = np.asarray(words, dtype=np.int64), np.asarray(counts, dtype=np.float64)
        prec, nmax = np.zeros(len(self.cids)), np.full(self.sim.shape[1], -np.inf)
        step = len(self.block)
        for i in range(0, len(words), step):
            at = self.rows(words[i:i + step])
            prec += counts[i:i + step] @ self.best[at]
            np.maximum(nmax, np.take(self.sim, at, axis=0, out=self.block[:len(at)], mode="clip").max(axis=0), out=nmax)
        return prec / counts.sum(), np.add.reduceat(nmax[self.loc] * self.ccnt, self.offs) / self.length


def _f1(prec, rec):
    den = prec + rec
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(den != 0, 2 * prec * rec / np.where(den != 0, den, 1.0), np.nan)


def token_softmatch_top_k(posts: DataFrame, claims: DataFrame, vectors: DataFrame, *, post_id: str,
                          claim_id: str, text: str = "text", claim_text: str | None = None,
                          tokenizer=None, k: int = 5, order_by: str = "f1", per: str = "post",
                          word: str = "word", vec: str = "vec", word_key=None) -> DataFrame:
    """RET-04 / RET-09: token-level soft matching of every post against
    every claim.

    With unit token vectors x (post) and y (claim):
    ``P = mean_x max_y x.y``, ``R = mean_y max_x x.y``, ``F1 = 2PR/(P+R)``;
    out-of-vocabulary tokens are dropped, a side without tokens gives no
    row.  ``per='post'`` keeps the best ``k`` claims of each post;
    ``per='claim'`` keeps a running top ``k`` of posts per claim in each task
    (ties at the boundary kept, undefined scores left out) and returns these
    candidates for a final window; :func:`first_copies` keeps copies of one
    text from tying without end.  P, R and F1 are always returned.

    Three plans, chosen by size checks:

    * vocabulary plan -- the word-vector table fits one broadcast: each worker
      computes a word's similarity to the distinct claim words where a post
      first has it and keeps it in a store of bounded size; a post then costs
      one gather over its distinct words.  Posts ship only (vocabulary index,
      count) arrays, never vectors.
    * block plan -- above ``COLLECT_MAX_BYTES`` the table is broadcast in
      blocks of ``VECTOR_BLOCK_BYTES``, which the driver collects one at a time.  Posts ship
      only (word, count) arrays; a word's similarities to the claim words are
      formed once for a tile of posts, in blocks of bounded size.
    * part plan -- a table that a worker should not hold stays in Spark.  Posts
      are dealt into parts of bounded text, Spark joins each part's distinct
      words, not each post's, to their vectors and cogroups them with the part's
      word counts, scored as in the block plan.
    """
    from claimspark.functions.text import word_tokens
    tokenizer = tokenizer or word_tokens
    claim_text = claim_text or text
    args = dict(post_id=post_id, claim_id=claim_id, text=text, claim_text=claim_text, tokenizer=tokenizer, k=k,
                order_by=order_by, per=per, word=word, vec=vec, word_key=word_key)
    blocks = _claim_blocks(claims, vectors, claim_id, claim_text, tokenizer, word, vec, word_key)
    out = _softmatch_block(posts, blocks[0], vectors, **args)
    for b in blocks[1:]:
        out = out.unionByName(_softmatch_block(posts, b, vectors, **args))
    if len(blocks) == 1 or per != "post":
        return out
    # rounded as inside a task, so that blocks and ties rank alike
    return top_k(out.drop("rank"), post_id, [F.round(score_key(order_by), 9).desc(), F.col(claim_id).asc()], k, "rank")


def _softmatch_block(posts: DataFrame, claims: DataFrame, vectors: DataFrame, *, post_id: str, claim_id: str, text: str,
                     claim_text: str, tokenizer, k: int, order_by: str, per: str, word: str, vec: str,
                     word_key) -> DataFrame:
    """:func:`token_softmatch_top_k` for one block of claims."""
    spark = posts.sparkSession
    ptype = posts.schema[post_id].dataType.simpleString()
    ctype = claims.schema[claim_id].dataType.simpleString()
    schema = f"{post_id} {ptype}, {claim_id} {ctype}, precision double, recall double, f1 double"
    n_vocab, dim = _vocab_size(vectors, vec)
    wtype = vectors.schema[word].dataType.simpleString()

    rank = ", rank bigint"

    def chosen(pids: np.ndarray, cids_: np.ndarray, P: np.ndarray, Rm: np.ndarray, top: np.ndarray | None):
        """The rows that leave the task, and for per='claim' the best k keys
        seen, ``top`` with these posts'."""
        F1 = _f1(P, Rm)
        key = {"f1": F1, "precision": P, "recall": Rm}[order_by]
        key = np.where(np.isnan(key), -np.inf, key)
        if per == "post":
            pick = _row_topk(key, cids_, k)
            ri = np.repeat(np.arange(len(pids)), [len(x) for x in pick])
            ci = np.concatenate(pick) if pick else np.zeros(0, dtype=int)
            rk = np.concatenate([np.arange(1, len(x) + 1) for x in pick]) if pick else np.zeros(0, dtype=int)
        else:
            r = np.round(key, 9)
            top = r if top is None else np.concatenate([top, r])
            if len(top) > k:
                top = -np.partition(-top, k - 1, axis=0)[:k]
            bound = top.min(axis=0) if len(top) == k else np.full(len(cids_), -np.inf)
            ri, ci = np.nonzero((r >= bound) & (r > -np.inf))
            rk = np.zeros(len(ri), dtype=int)
        return pd.DataFrame({post_id: pids[ri], claim_id: cids_[ci], "precision": P[ri, ci],
                             "recall": Rm[ri, ci], "f1": F1[ri, ci], "rank": rk.astype(np.int64)}), top

    if n_vocab * dim * _number_bytes(vectors, vec) <= min(VOCAB_PLAN_MAX_BYTES, COLLECT_MAX_BYTES):
        words, vmat = _collect_vocab(vectors, word, vec)
        index = spark.createDataFrame([(w, i) for i, w in enumerate(words)], f"word {wtype}, vidx int")
        ccdf = token_counts(claims, claim_id, claim_text, tokenizer, word_key) \
            .join(F.broadcast(index), "word").select("id", "vidx", "cnt")
        cc = ccdf.toPandas().sort_values(["id", "vidx"])
        cv, loc = np.unique(cc["vidx"].to_numpy(), return_inverse=True)
        if not len(cv):
            return spark.createDataFrame([], schema + (rank if per == "post" else ""))
        cids = cc["id"].drop_duplicates().to_numpy()
        offs = np.searchsorted(cc["id"].to_numpy(), cids)
        bc = spark.sparkContext.broadcast((uuid.uuid4().hex, vmat, cv, loc.astype(np.int64), offs,
                                           cc["cnt"].to_numpy().astype(np.float64), cids))
        pgroups = (token_counts(posts, post_id, text, tokenizer, word_key)
                   .join(F.broadcast(index), "word")
                   .groupBy("id").agg(F.collect_list("vidx").alias("vidx"), F.collect_list("cnt").alias("cnt")))

        def score(batches):
            store = _Similarities.of(bc)
            step = max(1, TILE_BYTES // (48 * max(1, len(store.cids))))  # six arrays of posts x claims
            top = None
            for whole in batches:
                for at in range(0, len(whole), step):
                    pdf = whole.iloc[at:at + step]
                    res = [store.score(a, b) for a, b in zip(pdf["vidx"], pdf["cnt"])]
                    out, top = chosen(pdf["id"].to_numpy(), store.cids, np.vstack([r[0] for r in res]),
                                      np.vstack([r[1] for r in res]), top)
                    yield out

        res = pgroups.mapInPandas(score, schema + rank)
    else:
        v = vectors.select(F.col(word).alias("word"), F.col(vec).alias("vec")).where("vec is not null")
        cat = _softmatch_catalogue(claims, v, claim_id, claim_text, tokenizer, word_key)
        if not len(cat[0]):
            return spark.createDataFrame([], schema + (rank if per == "post" else ""))
        bc = spark.sparkContext.broadcast(cat)
        size = n_vocab * dim * _number_bytes(vectors, vec)
        if size <= VOCAB_PLAN_MAX_BYTES:
            blocks = _broadcast_blocks(v, size)
            pgroups = (token_counts(posts, post_id, text, tokenizer, word_key)
                       .groupBy("id").agg(F.collect_list("word").alias("word"), F.collect_list("cnt").alias("cnt")))

            def score_blocks(batches):
                mats, places = [b.value[1] for b in blocks], _Places(np.concatenate([b.value[0] for b in blocks]))
                ends = np.cumsum([len(m) for m in mats])

                def vectors_at(rows: np.ndarray) -> np.ndarray:  # rising
                    cuts = np.searchsorted(rows, np.r_[0, ends])
                    return np.concatenate([m[rows[i:j] - (e - len(m))] for m, e, i, j in zip(mats, ends, cuts, cuts[1:])])

                top = None
                for pdf in batches:
                    text = np.repeat(np.arange(len(pdf)), pdf["cnt"].map(len))
                    found = places.entries(text, np.concatenate(pdf["word"].to_numpy()), np.concatenate(pdf["cnt"].to_numpy()))
                    for pids, P, Rm in _tile_scores(pdf["id"].to_numpy(), *found, vectors_at, bc.value):
                        out, top = chosen(pids, bc.value[0], P, Rm, top)
                        yield out

            res = pgroups.mapInPandas(score_blocks, schema + rank)
        else:
            n_posts, row_bytes = text_bytes(posts, text)
            n = max(-(-n_posts * row_bytes // PART_TEXT_BYTES), spark.sparkContext.defaultParallelism)
            toks = (posts.select(F.col(post_id).alias("id"), F.col(text))
                    .withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n))).repartition(n, "part")
                    .select("part", "id", F.explode(tokenizer(F.col(text))).alias("word")))
            toks = toks.withColumn("word", word_key(F.col("word"))) if word_key is not None else toks
            counts = toks.groupBy("part", "id", "word").agg(F.count(F.lit(1)).alias("cnt"))
            # names of their own: a cogroup of equal columns loses them
            near = (toks.select("part", "word").distinct().join(v, "word")
                    .select(F.col("part").alias("_b"), F.col("word").alias("_w"), F.col("vec").alias("_v")).repartition(n, "_b"))

            def score_part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                out, top = [pd.DataFrame(columns=[x.split()[0] for x in (schema + rank).split(", ")])], None
                if len(left) and len(right):
                    text, ids = pd.factorize(left["id"], use_na_sentinel=False)
                    vecs = right["_v"].to_numpy()
                    found = _Places(right["_w"]).entries(text, left["word"], left["cnt"].to_numpy())
                    for pids, P, Rm in _tile_scores(np.asarray(ids), *found, lambda rows: np.stack(vecs[rows]), bc.value):
                        best, top = chosen(pids, bc.value[0], P, Rm, top)
                        out.append(best)
                return pd.concat(out[1:]) if len(out) > 1 else out[0]

            res = counts.groupBy("part").cogroup(near.groupBy("_b")).applyInPandas(score_part, schema + rank)
        if per == "claim":  # every task or part gives candidates: those beyond the k-th score go, ties at it stay
            place = F.rank().over(Window.partitionBy(claim_id).orderBy(score_key(order_by).desc()))
            res = res.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")
    # per='post': each post is scored and ranked completely inside one task
    # (no window); per='claim': candidates for a window by claim
    res = res.withColumn("f1", F.when(F.isnan("f1"), F.lit(None)).otherwise(F.col("f1")))
    return res if per == "post" else res.drop("rank")


def first_copies(posts: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """The ``k`` smallest ids of each distinct text: copies tie in every
    score, so no other copy can be among the best ``k`` when ties go by id.
    Only digests and ids are shuffled for the choice, at most ``k`` per text
    and partition."""
    few = top_k(posts.select(id_col, F.md5(text).alias("_h")), "_h", [F.col(id_col).asc()], k, "_r")
    return posts.join(few.select(id_col), id_col, "left_semi")


# ------------------------------------------------------------ user encoder
def encode_texts(df: DataFrame, text: str, encoder_factory, dim: int, out: str = "vec") -> DataFrame:
    """UDF-01: a user-supplied text encoder as an Iterator pandas UDF.

    ``encoder_factory()`` is called once per Python worker (model load), then
    every Arrow batch of texts is encoded in one call returning an
    (n x dim) array.  Output: ``out`` array<double>.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder_factory()
        for s in batches:
            m = np.asarray(encode(s.fillna("").tolist()), dtype=np.float64).reshape(len(s), dim)
            yield pd.Series(list(m))
    return df.withColumn(out, enc(F.col(text)))


def hashing_encoder_factory(dim: int = 64):
    """Stand-in encoder: lower-case word tokens hashed (md5, first 8 hex
    digits) into ``dim`` buckets, counts per bucket."""
    def factory():
        import hashlib

        import regex
        pat = regex.compile(r"[\p{L}\p{N}_]{2,}")

        buckets: dict[str, int] = {}  # token -> bucket, reused across batches of this worker

        def bucket(tok):
            b = buckets.get(tok)
            if b is None:
                b = buckets[tok] = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % dim
            return b

        def encode(texts):
            out = np.zeros((len(texts), dim))
            for r, t in enumerate(texts):
                idx = [bucket(tok) for tok in pat.findall(t.lower())]
                if idx:
                    np.add.at(out[r], idx, 1.0)
            return out
        return encode
    return factory
