"""Training-set construction (TRN-01..06): nested evidence regrouping,
reproducible sampling and dataset splits.

Randomness is replaced by a seeded md5 order (Q28): a row's rank within its
group by ``md5(seed | key)`` decides the sample, so results are identical
across runs, engines and executor failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.text import drop_line_number, fever_unescape
from claimspark.operators.ingest import dense_ids

# Label codes of the training sets (match the stance classes).
FEVER_CODES = {"SUPPORTS": 0, "REFUTES": 1, "NOT ENOUGH INFO": 2}
SCIFACT_CODES = {"SUPPORT": 0, "CONTRADICT": 1, "NOT_ENOUGH_INFO": 2}
NEI = "NOT ENOUGH INFO"


def seeded_key(seed: str, *parts) -> Column:
    """md5(seed | part1 | part2 ...) as the sampling order key."""
    cols = [F.lit(seed)] + [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def pick_smallest(indices: Column, seed: str, key: Column, k: Column | int) -> Column:
    """The ``k`` indices of an array with the smallest md5(seed|key|index) --
    a reproducible sample without replacement, row-local (no shuffle)."""
    kk = k if isinstance(k, Column) else F.lit(k)
    ordered = F.array_sort(F.transform(indices, lambda i: F.struct(
        F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string"))).alias("h"), i.alias("i"))))
    return F.transform(F.slice(ordered, 1, kk), lambda s: s["i"])


# -------------------------------------------------------------- FEVER


def fever_convert(claims: DataFrame, wiki: DataFrame) -> DataFrame:
    """TRN-01 (JOIN-08, WIN-03, TOP-06): per claim, the non-empty sentences
    of its evidence pages in (page id, line) order and its evidence sets as
    sorted sentence indices, duplicates removed in first-seen order; a
    missing page turns the label into NOT ENOUGH INFO (Q27); evidence on a
    missing page or an empty line is dropped.

    One pass over the dump: only the referenced pages are read (semi join
    against the distinct page ids), their lines are grouped per claim (a
    claim's few pages bound the group), and the (page, line) -> index
    lookup of the evidence is row-local on that claim row.
    """
    refs = (claims.select("id", F.explode(F.flatten("evidence")).alias("e"))
                  .select("id", F.col("e.page").alias("page")).distinct())
    pages = (wiki.select(F.col("id").alias("page"), "lines")
                 .join(refs.select("page").distinct(), "page", "left_semi"))
    lines = (refs.join(pages, "page", "left")
                 .select("id", "page", F.col("lines").isNull().alias("miss"),
                         F.posexplode_outer(F.split(fever_unescape(F.col("lines")), "\n")).alias("line", "raw"))
                 .select("id", "page", "miss", F.col("line").cast("int").alias("line"),
                         drop_line_number(F.col("raw")).alias("sentence")))
    per = lines.groupBy("id").agg(
        F.max("miss").alias("missing"),
        F.array_sort(F.collect_list(F.when(F.length("sentence") > 0, F.struct("page", "line", "sentence")))).alias("s"))
    keys = F.transform("s", lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line")))
    sets = F.transform("evidence", lambda es: F.array_sort(F.filter(
        F.transform(es, lambda e: (F.array_position(keys, F.struct(e["page"].alias("page"),
                                                                  e["line"].cast("int").alias("line"))) - 1).cast("int")),
        lambda i: i >= 0)))
    return (claims.select("id", "claim", "label", "evidence").join(per, "id", "left")
                  .select("id", "claim",
                          F.when(F.col("missing"), F.lit(NEI)).otherwise(F.col("label")).alias("label"),
                          F.coalesce(F.transform("s", lambda x: x["sentence"]), F.array().cast("array<string>"))
                          .alias("sentences"),
                          F.coalesce(F.array_distinct(F.filter(sets, lambda x: F.size(x) > 0)),
                                     F.array().cast("array<array<int>>")).alias("evidence_sets")))


def fever_examples(converted: DataFrame, seed: str = "fever", neg_sample: bool = True) -> DataFrame:
    """TRN-02 (FN-10, SET-03, SET-06): (claim, rationale, label) examples:
    one per evidence set; a NOT ENOUGH INFO claim gives one sampled
    sentence; with ``neg_sample`` a supported / refuted claim adds one
    sampled non-evidence sentence labelled NOT ENOUGH INFO.  Row-local: all
    example kinds of a claim are built on its row and exploded once."""
    code = F.create_map(*[x for k, v in FEVER_CODES.items() for x in (F.lit(k), F.lit(v))])
    n = F.size("sentences")
    allidx = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    join_idx = lambda idx: F.array_join(F.transform(idx, lambda i: F.get(F.col("sentences"), i)), " ")
    ex_t = "array<struct<kind:string,set_idx:int,rationale:string,label:int>>"
    empty = F.array().cast(ex_t)
    nei_code = F.lit(FEVER_CODES[NEI])

    def ex(kind, set_idx, rationale, label):
        return F.struct(F.lit(kind).alias("kind"), set_idx.cast("int").alias("set_idx"),
                        rationale.alias("rationale"), label.cast("int").alias("label"))
    is_nei = F.col("label") == NEI
    evid = F.when(~is_nei, F.transform("evidence_sets", lambda s, i: ex("evidence", i, join_idx(s), code[F.col("label")])))
    nei = F.when(is_nei & (n > 0), F.array(ex("nei", F.lit(0), join_idx(pick_smallest(allidx, seed, F.col("id"), 1)),
                                                nei_code)))
    parts = [F.coalesce(evid, empty), F.coalesce(nei, empty)]
    if neg_sample:
        non = F.array_except(allidx, F.flatten("evidence_sets"))
        neg = F.when(~is_nei & (n > 0) & (F.size(non) > 0),
                     F.array(ex("negative", F.lit(0), join_idx(pick_smallest(non, seed, F.col("id"), 1)), nei_code)))
        parts.append(F.coalesce(neg, empty))
    return converted.select("id", "claim", F.inline(F.concat(*parts)))


# ------------------------------------------------------------ SciFact
def scifact_examples(corpus: DataFrame, claims: DataFrame, seed: str = "scifact") -> DataFrame:
    """TRN-03 (JOIN-09, SET-03/04/06): per evidence set, per document all
    evidence merged (label of the first set), and 1-2 sampled non-evidence
    sentences; a claim without evidence samples 1-2 sentences of each cited
    document.  Sentences are trimmed (FN-10).

    The (claim, document) needs of both cases meet the corpus in one join;
    every example of a row is then built on that row and exploded once."""
    code = F.create_map(*[x for k, v in SCIFACT_CODES.items() for x in (F.lit(k), F.lit(v))])
    nei = F.lit(SCIFACT_CODES["NOT_ENOUGH_INFO"])
    sets_t = "array<struct<sentences:array<int>,label:string>>"
    need = (claims.filter(F.cardinality("evidence") > 0)
                  .select(F.col("id").alias("claim_id"), "claim", F.explode("evidence").alias("doc_id", "sets"))
                  .unionByName(claims.filter(F.cardinality("evidence") == 0)
                               .select(F.col("id").alias("claim_id"), "claim", F.explode("cited_doc_ids").alias("doc_id"),
                                       F.lit(None).cast(sets_t).alias("sets"))))
    rows = need.join(corpus.select("doc_id", "abstract"), "doc_id")
    join_idx = lambda idx: F.array_join(F.transform(idx, lambda i: F.trim(F.get(F.col("abstract"), i))), " ")
    key = F.concat_ws("|", F.col("claim_id").cast("string"), F.col("doc_id").cast("string"))
    k12 = (F.lit(1) + (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key, F.lit("k"))), 1, 8), 16, 10)
                       .cast("bigint") % 2)).cast("int")
    n = F.size("abstract")
    allidx = F.sequence(F.lit(0), n - 1)
    # SET-04: union of the evidence indices of the document
    idx = F.array_sort(F.array_distinct(F.flatten(F.transform("sets", lambda s_: s_["sentences"]))))
    non = F.array_except(allidx, idx)

    def ex(kind, set_idx, rationale, label):
        return F.struct(F.lit(kind).alias("kind"), set_idx.cast("int").alias("set_idx"),
                        rationale.alias("rationale"), label.cast("int").alias("label"))
    evidence_rows = F.concat(
        F.transform("sets", lambda es, i: ex("set", i, join_idx(es["sentences"]), code[es["label"]])),
        F.array(ex("all", F.lit(0), join_idx(idx), code[F.col("sets")[0]["label"]])),
        F.array(ex("negative", F.lit(0), join_idx(F.array_sort(pick_smallest(non, seed, key, F.least(k12, F.size(non))))),
                   nei)))
    cited_rows = F.array(ex("cited", F.lit(0), join_idx(pick_smallest(allidx, seed, key, F.least(k12, n))), nei))
    return rows.select("claim_id", "doc_id", "claim",
                       F.inline(F.when(F.col("sets").isNotNull(), evidence_rows).otherwise(cited_rows)))


# --------------------------------------------------------- NLI / DPR
def nli_examples(pairs: DataFrame, codes: dict[str, int]) -> DataFrame:
    """TRN-04 (FLT-05, FN-11): keep the three gold labels, code them."""
    m = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    keep = [k for k, v in codes.items() if v in (0, 1, 2)]
    return pairs.filter(F.col("gold_label").isin(*keep)).withColumn("label", m[F.col("gold_label")].cast("bigint"))


SLOT_STRIDE = 1_000_003  # a prime


def retriever_set(contexts: DataFrame, *, question: str, ctx_id: str, text: str, neg_scale: float,
                  seed: str = "dpr") -> DataFrame:
    """TRN-05 (AGG-02, FLT-09): per question its positive contexts and
    ``int(n_pos * neg_scale)`` negatives drawn without replacement from the
    non-empty texts of all *other* questions in a seeded order, cycling when
    that pool is short (Q30); a question that owns the whole pool gets none.
    Long form (question, kind, ctx_idx, ctx_id, text; ctx_idx
    is the negative slot, -1 for positives): no
    question's contexts are ever collected into one row, so a question
    holding a third of the data is still split across tasks.

    The pool is numbered question by question (in a seeded order of both), so
    a question's own contexts are one block [first, first + own).  Slot i reads
    place (offset + i * stride) of the other n - own places, counted from the
    end of the block around the circle: an equi-join on the pool position, no
    pairs and no own context.  The stride is a prime that does not divide
    n - own, so a draw repeats only after all places were read, and questions
    read differently ordered samples."""
    pos = contexts.select(F.col(question).alias("question"), F.lit("positive").alias("kind"),
                          F.col(ctx_id).alias("ctx_id"), F.col(text).alias("text"))
    pos = pos.withColumn("ctx_idx", F.lit(-1).cast("bigint"))  # positives have no negative slot
    # the pool order is numbered on hashes and ids only -- the texts are
    # joined back for the chosen negatives, never copied into the checkpoint
    pool = contexts.filter(F.length(text) > 0).select(F.col(ctx_id).alias("ctx_id"), seeded_key(seed, question).alias("hq"),
                                                      seeded_key(seed, ctx_id).alias("h"))
    pool = dense_ids(pool, ["hq", "h", "ctx_id"], 0, "p").select("p", "hq", "ctx_id")
    n_pool = pool.count()
    blocks = pool.groupBy("hq").agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("own"))
    texts = contexts.select(F.col(ctx_id).alias("ctx_id"), F.col(text).alias("text"))
    counts = (contexts.groupBy(F.col(question).alias("question"))
                      .agg(F.floor(F.count(F.lit(1)) * F.lit(neg_scale)).cast("bigint").alias("neg_size")))
    sizes = (counts.withColumn("hq", seeded_key(seed, "question")).join(blocks, "hq", "left")
                   .withColumn("others", F.lit(n_pool) - F.coalesce("own", F.lit(0)))
                   .withColumn("after", F.coalesce(F.col("first") - 1 + F.col("own"), F.lit(0)))
                   .filter(F.col("others") > 0))
    off = F.conv(F.substring(F.col("hq"), 1, 8), 16, 10).cast("bigint") % F.col("others")
    # a question may own a large share of all rows: its negative slots are
    # generated in chunks of CHUNK, the chunk list is spread over tasks
    # before the inner explode, so no single task produces all of them
    chunk = 100_000
    chunks = (sizes.filter(F.col("neg_size") > 0)
                   .select("question", "neg_size", "others", "after", off.alias("o"),
                           F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("neg_size") - 1) / chunk)
                                                .cast("bigint"))).alias("c"))
                   .repartition("question", "c"))
    stride = F.when(F.col("others") % SLOT_STRIDE == 0, F.lit(1)).otherwise(F.lit(SLOT_STRIDE)).cast("bigint")
    place = (F.col("o") + F.col("ctx_idx") * stride) % F.col("others")
    want = (chunks.select("question", "o", "others", "after", F.explode(F.sequence(
                F.col("c") * chunk, F.least(F.col("neg_size"), (F.col("c") + 1) * chunk) - 1)).alias("ctx_idx"))
            .withColumn("p", (F.col("after") + place) % F.lit(max(n_pool, 1)) + 1))
    neg = (want.join(pool, "p").join(texts, "ctx_id")
               .select("question", F.lit("negative").alias("kind"), "ctx_id", "text", "ctx_idx"))
    return pos.unionByName(neg)


def retriever_records(rows: DataFrame, texts: DataFrame, *, ctx_id: str, text: str, max_ctxs: int = 1000) -> DataFrame:
    """SNK-08 / AGG-02: the long form of :func:`retriever_set` as training
    records (question, record, answers, positive_ctxs, negative_ctxs,
    hard_negative_ctxs) with contexts {title, text, id}.  A record holds at
    most ``max_ctxs`` contexts, positives first, so a question with a third of
    all rows becomes many bounded records.  Only ids are numbered; ``texts``
    (ctx_id, text) are joined to the numbered rows."""
    keys = rows.select("question", (F.col("kind") != "positive").cast("int").alias("neg"), "ctx_idx", "ctx_id")
    pos = dense_ids(keys, ["question", "neg", "ctx_idx", "ctx_id"], 0, "p")
    first = pos.groupBy(F.col("question").alias("q")).agg(F.min("p").alias("first"))
    full = (pos.join(first, pos["question"].eqNullSafe(first["q"]))
            .join(texts.select(F.col(ctx_id).alias("ctx_id"), F.col(text).alias("text")), "ctx_id"))

    def side(neg: int) -> Column:
        ctx = F.struct("p", F.lit(None).cast("string").alias("title"), "text", F.col("ctx_id").alias("id"))
        listed = F.array_sort(F.collect_list(F.when(F.col("neg") == neg, ctx)))
        return F.transform(listed, lambda c: F.struct(c["title"].alias("title"), c["text"].alias("text"), c["id"].alias("id")))

    none = F.array().cast("array<struct<title:string,text:string,id:bigint>>")
    return (full.groupBy("question", F.expr(f"(p - first) div {max_ctxs}").alias("record"))
            .agg(side(0).alias("positive_ctxs"), side(1).alias("negative_ctxs"))
            .select("question", "record", F.array().cast("array<string>").alias("answers"), "positive_ctxs",
                    "negative_ctxs", none.alias("hard_negative_ctxs")))


def seeded_split(df: DataFrame, id_col: str, world_size: int, seed: str = "split") -> DataFrame:
    """TRN-06: seeded shuffle, then worker r takes positions r, r+w, r+2w..
    (the distributed-sampler layout); positions from :func:`dense_ids`."""
    o = dense_ids(df.select(id_col, seeded_key(seed, id_col).alias("h")), ["h", id_col], 0, "pos")
    return o.select(id_col, ((F.col("pos") - 1) % world_size).cast("bigint").alias("worker"),
                    ((F.col("pos") - 1) / world_size).cast("bigint").alias("local_idx"))


def seeded_sample(df: DataFrame, *, by: list[str], key: list[str], k: int, seed: str = "sample") -> DataFrame:
    """Q28: reproducible sample without replacement of ``k`` rows per group
    -- the rows with the smallest md5(seed | key).  Planned as a window top-k
    whose partial limit runs before the shuffle, so a hot group ships at most
    k rows per input partition."""
    from claimspark.operators.common import top_k
    return top_k(df.withColumn("_h", seeded_key(seed, *key)), by, [F.col("_h"), *[F.col(c) for c in key]], k,
                 "_r").drop("_h", "_r")
