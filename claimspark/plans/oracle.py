"""DuckDB SQL twins of the registered queries (the correctness oracle)."""

from __future__ import annotations

from claimspark.plans.fixtures import CARD_STATUS
from claimspark.plans.sqlfix import CLAIMS, GOLD, H, tokens

ORACLE: dict[str, str] = {}

# TF-IDF closed form (RET-01) -> tfidf_sc(doc_id, item_id, score)
TFIDF = f"""
t_mt AS (SELECT item_id, tok, count(*) AS tf FROM (SELECT item_id, unnest({tokens('text')}) AS tok FROM benchmark) GROUP BY ALL),
t_n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM benchmark),
t_df AS (SELECT tok, count(*) AS df FROM t_mt GROUP BY tok),
t_pt AS (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS tok FROM documents) GROUP BY ALL),
t_pi AS (SELECT p.doc_id, p.tok, p.tf, ln((n.n + 2) / (2 + coalesce(d.df, 0))) + 1 AS i1
       FROM t_pt p LEFT JOIN t_df d ON p.tok = d.tok CROSS JOIN t_n n),
t_pn AS (SELECT doc_id, sum(tf * tf * i1 * i1) AS nn FROM t_pi GROUP BY doc_id),
t_mb AS (SELECT m.item_id, sum(m.tf * m.tf * power(ln((n.n + 2) / (1 + d.df)) + 1, 2)) AS bb
       FROM t_mt m JOIN t_df d ON m.tok = d.tok CROSS JOIN t_n n GROUP BY m.item_id),
t_hit AS (SELECT p.doc_id, m.item_id, sum(p.tf * m.tf * p.i1 * p.i1) AS dot,
        sum(m.tf * m.tf * (p.i1 * p.i1 - power(ln((n.n + 2) / (1 + d.df)) + 1, 2))) AS corr
        FROM t_pi p JOIN t_mt m ON p.tok = m.tok JOIN t_df d ON d.tok = m.tok CROSS JOIN t_n n
        GROUP BY p.doc_id, m.item_id),
tfidf_sc AS (SELECT h.doc_id, h.item_id, h.dot / sqrt(pn.nn * (mb.bb + h.corr)) AS score
       FROM t_hit h JOIN t_pn pn ON pn.doc_id = h.doc_id JOIN t_mb mb ON mb.item_id = h.item_id)"""

# BM25 (RET-05) -> bm25_sc(doc_id, item_id, score)
BM25 = f"""
b_ct AS (SELECT item_id, {tokens('text')} AS toks FROM benchmark),
b_n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(len(toks)) / count(*) AS avgl FROM b_ct),
b_mt AS (SELECT item_id, tok, count(*) AS tf FROM (SELECT item_id, unnest(toks) AS tok FROM b_ct) GROUP BY ALL),
b_df AS (SELECT tok, count(*) AS df FROM b_mt GROUP BY tok),
b_w AS (SELECT m.tok, m.item_id,
         ln(1 + (n.n - d.df + 0.5) / (d.df + 0.5)) * m.tf / (m.tf + 0.9 * (1 - 0.4 + 0.4 * len(c.toks) / n.avgl)) AS w
       FROM b_mt m JOIN b_df d ON m.tok = d.tok JOIN b_ct c ON c.item_id = m.item_id CROSS JOIN b_n n),
b_pt AS (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS tok FROM documents) GROUP BY ALL),
bm25_sc AS (SELECT p.doc_id, c.item_id, sum(p.tf * c.w) AS score FROM b_pt p JOIN b_w c ON p.tok = c.tok GROUP BY ALL)"""

RETRIEVAL_PREDS = TFIDF + "," + BM25 + """,
rpreds AS (SELECT 'bow-cosine' AS model_id, doc_id AS input_id, item_id AS misinfo_id, round(score, 9) AS confidence FROM tfidf_sc
           UNION ALL
           SELECT 'pyserini', doc_id, item_id, round(score, 9) FROM bm25_sc)"""

STANCE_MODELS_SQL = "['bow-log-snli', 'sbert-snli', 'comb-sbert-fever-ct']"
STANCE_PREDS = GOLD + f""",
spreds AS (SELECT model_id, input_id, misinfo_id,
  CAST(CASE WHEN {H("model_id || CAST(input_id AS VARCHAR)")} % 10 < 7 THEN gold_label
       ELSE {H("CAST(input_id AS VARCHAR) || model_id")} % 3 END AS BIGINT) AS label_id,
  ({H("model_id || CAST(input_id AS VARCHAR) || 'c'")} % 100) / 100.0 AS confidence
  FROM (SELECT input_id, misinfo_id, gold_label, unnest({STANCE_MODELS_SQL}) AS model_id FROM gold))"""

ORACLE["tfidf_top5"] = "WITH " + TFIDF + """
SELECT doc_id AS input_id, item_id AS misinfo_id, round(score, 6) AS confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM tfidf_sc)
WHERE rank <= 5"""

ORACLE["kept_index_batches"] = ORACLE["tfidf_top5"]

ORACLE["bm25_top5"] = "WITH " + BM25 + """
SELECT doc_id AS input_id, item_id AS misinfo_id, round(score, 6) AS confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM bm25_sc)
WHERE rank <= 5"""

ORACLE["tfidf_scores"] = "WITH " + TFIDF + """
SELECT doc_id AS input_id, 'bow-cosine' AS model_id, CAST(NULL AS INTEGER) AS label_id,
       item_id AS misinfo_id, round(score, 6) AS confidence FROM tfidf_sc"""

ORACLE["bm25_zero_filled"] = "WITH " + BM25 + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM bm25_sc) WHERE rank <= 86),
nh AS (SELECT d.doc_id, count(b.item_id) AS n_hits FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id GROUP BY d.doc_id),
fill AS (SELECT nh.doc_id, c.item_id, 0.0 AS score,
           nh.n_hits + row_number() OVER (PARTITION BY nh.doc_id ORDER BY c.item_id) AS rank
         FROM nh CROSS JOIN benchmark c
         WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.doc_id = nh.doc_id AND b.item_id = c.item_id))
SELECT doc_id AS input_id, item_id AS misinfo_id, round(score, 6) AS confidence, rank FROM best
UNION ALL
SELECT doc_id, item_id, CAST(0.0 AS DOUBLE), rank FROM fill WHERE rank <= 86"""

_AVG_RANK = """rank() OVER (PARTITION BY model_id, input_id ORDER BY confidence DESC)
      + (count(*) OVER (PARTITION BY model_id, input_id, confidence) - 1) / 2.0"""

ORACLE["avg_rank_ties"] = "WITH " + RETRIEVAL_PREDS + f""",
r AS (SELECT model_id, input_id, misinfo_id, round(confidence, 2) AS confidence FROM rpreds)
SELECT model_id, input_id, misinfo_id, confidence, {_AVG_RANK} AS rank FROM r"""

ORACLE["retrieval_report"] = "WITH " + RETRIEVAL_PREDS + "," + GOLD + f""",
ranked AS (SELECT model_id, input_id, misinfo_id, {_AVG_RANK} AS rank FROM rpreds),
npos AS (SELECT model_id, input_id, count(*) FILTER (WHERE confidence > 0) AS n_pos FROM rpreds GROUP BY ALL),
nc AS (SELECT count(*) AS n FROM benchmark),
e AS (SELECT m.model_id, g.input_id, g.misinfo_id, g.gold_label,
        coalesce(r.rank, np.n_pos + ((SELECT n FROM nc) - np.n_pos + 1) / 2.0, ((SELECT n FROM nc) + 1) / 2.0) AS rank
      FROM gold g CROSS JOIN (SELECT unnest(['bow-cosine', 'pyserini']) AS model_id) m
      LEFT JOIN ranked r ON r.model_id = m.model_id AND r.input_id = g.input_id AND r.misinfo_id = g.misinfo_id
      LEFT JOIN npos np ON np.model_id = m.model_id AND np.input_id = g.input_id
      WHERE g.gold_label IN (0, 1))
SELECT model_id,
  100.0 * sum(CASE WHEN gold_label = 0 AND rank <= 1 THEN 1 ELSE 0 END) / sum(CASE WHEN gold_label = 0 THEN 1 ELSE 0 END) AS pos_hits_1,
  100.0 * sum(CASE WHEN gold_label = 0 AND rank <= 5 THEN 1 ELSE 0 END) / sum(CASE WHEN gold_label = 0 THEN 1 ELSE 0 END) AS pos_hits_5,
  100.0 * sum(CASE WHEN gold_label = 0 AND rank <= 10 THEN 1 ELSE 0 END) / sum(CASE WHEN gold_label = 0 THEN 1 ELSE 0 END) AS pos_hits_10,
  avg(CASE WHEN gold_label = 0 THEN 1.0 / rank END) AS pos_mrr,
  100.0 * sum(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) / count(*) AS both_hits_1,
  100.0 * sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) / count(*) AS both_hits_5,
  100.0 * sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) / count(*) AS both_hits_10,
  avg(1.0 / rank) AS both_mrr
FROM e GROUP BY model_id"""

_CELLS = ",\n".join(
    f"CAST(sum(CASE WHEN gold_label = {g} AND label_id = {p} THEN 1 ELSE 0 END) AS BIGINT) AS c{g}{p}"
    for g in range(3) for p in range(3))
_STANCE_CELLS = "WITH " + STANCE_PREDS + f""",
cells AS (SELECT p.model_id, {_CELLS}
          FROM gold g JOIN spreds p ON p.input_id = g.input_id AND p.misinfo_id = g.misinfo_id
          GROUP BY p.model_id)"""

ORACLE["confusion_matrix"] = _STANCE_CELLS + """
SELECT model_id, CAST(g AS BIGINT) AS gold_label, CAST(p AS BIGINT) AS label_id,
  CASE g * 3 + p WHEN 0 THEN c00 WHEN 1 THEN c01 WHEN 2 THEN c02 WHEN 3 THEN c10 WHEN 4 THEN c11
   WHEN 5 THEN c12 WHEN 6 THEN c20 WHEN 7 THEN c21 ELSE c22 END AS n
FROM cells, (SELECT unnest([0, 1, 2]) AS g), (SELECT unnest([0, 1, 2]) AS p)"""


def _stance_report_sql(src: str) -> str:
    def pr(i):
        col = " + ".join(f"c{g}{i}" for g in range(3))
        row = " + ".join(f"c{i}{p}" for p in range(3))
        return (f"CASE WHEN ({col}) = 0 THEN NULL ELSE c{i}{i} * 1.0 / ({col}) END",
                f"CASE WHEN ({row}) = 0 THEN NULL ELSE c{i}{i} * 1.0 / ({row}) END",
                f"CASE WHEN ({col}) + ({row}) > 0 THEN 1 ELSE 0 END")
    parts = []
    names = {0: "pos", 1: "neg", 2: "na"}
    f1s, ps, rs, pres = {}, {}, {}, {}
    for i in range(3):
        p, r, pr_ = pr(i)
        ps[i], rs[i], pres[i] = p, r, pr_
        f1s[i] = f"CASE WHEN ({p}) + ({r}) = 0 THEN NULL ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END"
    npres = " + ".join(f"({pres[i]})" for i in range(3))
    total = " + ".join(f"c{g}{p}" for g in range(3) for p in range(3))
    parts.append(f"(c00 + c11 + c22) * 1.0 / ({total}) AS accuracy")
    for nm, d in (("precision", ps), ("recall", rs), ("f1", f1s)):
        s = " + ".join(f"coalesce({d[i]}, 0.0) * ({pres[i]})" for i in range(3))
        parts.append(f"({s}) / ({npres}) AS macro_{nm}")
    for i in range(3):
        parts += [f"{ps[i]} AS {names[i]}_precision", f"{rs[i]} AS {names[i]}_recall",
                  f"{f1s[i]} AS {names[i]}_f1"]
    return f"SELECT model_id, {', '.join(parts)} FROM {src}"


ORACLE["stance_report"] = _STANCE_CELLS + "\n" + _stance_report_sql("cells")


def _rounded(sql: str, cols: list[str]) -> str:
    """Report form of a metrics query: double columns rounded to 6 places."""
    return "WITH r AS (" + sql + ")\nSELECT model_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + " FROM r"


def _wv(tok_expr_docs: str, tok_expr_bench: str) -> str:
    """word -> vec_id table (twin of fixtures.word_vectors)."""
    return f"""
wv AS (SELECT word, {H('word')} % (SELECT count(*) FROM embeddings) AS vec_id FROM (
        SELECT DISTINCT word FROM (SELECT unnest({tok_expr_docs}) AS word FROM documents
                                   UNION ALL SELECT unnest({tok_expr_bench}) AS word FROM benchmark))),
ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""


def glove_toks(x: str) -> str:
    return (f"list_filter(list_transform(string_split_regex(trim({x}), '\\s+'), "
            f"lambda w: lower(regexp_replace(w, '[.,!?\\\\''\"]', '', 'g'))), lambda w: length(w) > 0)")


def _mean_vec(name: str, src: str, id_col: str) -> str:
    return f"""
{name}_c AS (SELECT {id_col} AS id, word, count(*) AS cnt FROM (SELECT {id_col}, unnest({glove_toks('text')}) AS word FROM {src}) GROUP BY ALL),
{name}_e AS (SELECT c.id, c.cnt, ev.e FROM {name}_c c JOIN wv ON wv.word = c.word JOIN ev ON ev.vec_id = wv.vec_id),
{name}_d AS (SELECT id, i, sum(cnt * x) / sum(cnt) AS x FROM (SELECT id, cnt, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM {name}_e) GROUP BY id, i),
{name}_m AS (SELECT s.{id_col} AS id, coalesce(v.vec, list_transform(range((SELECT len(embedding) FROM embeddings LIMIT 1)), lambda i: 0.0::DOUBLE)) AS vec
             FROM {src} s LEFT JOIN (SELECT id, list(x ORDER BY i) AS vec FROM {name}_d GROUP BY id) v ON v.id = s.{id_col})"""


ORACLE["wordvec_cosine_top5"] = "WITH " + _wv(glove_toks("text"), glove_toks("text")) + "," \
    + _mean_vec("pm", "documents", "doc_id") + "," + _mean_vec("cm", "benchmark", "item_id") + """,
sc AS (SELECT p.id AS input_id, c.id AS misinfo_id, coalesce(CASE WHEN list_dot_product(p.vec, p.vec) = 0 OR list_dot_product(c.vec, c.vec) = 0 THEN 0.0
         ELSE list_dot_product(p.vec, c.vec) / sqrt(list_dot_product(p.vec, p.vec) * list_dot_product(c.vec, c.vec)) END, 0.0) AS score
       FROM pm_m p CROSS JOIN cm_m c)
SELECT input_id, misinfo_id, round(score, 6) AS confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY round(score, 9) DESC, misinfo_id) AS rank FROM sc)
WHERE rank <= 5"""

ORACLE["embedding_cosine_top5"] = """WITH ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sc AS (SELECT a.vec_id, b.vec_id AS neighbor_id,
         list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS score
       FROM ev a JOIN ev b ON a.vec_id <> b.vec_id)
SELECT vec_id, neighbor_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, neighbor_id) AS rank FROM sc)
WHERE rank <= 5"""

ORACLE["token_softmatch_prf"] = "WITH " + _wv(tokens("text"), tokens("text")) + f""",
pc AS (SELECT t.doc_id, wv.vec_id, count(*) AS cnt FROM (SELECT doc_id, unnest({tokens('text')}) AS word FROM documents) t
       JOIN wv ON wv.word = t.word GROUP BY ALL),
cc AS (SELECT t.item_id, wv.vec_id, count(*) AS cnt FROM (SELECT item_id, unnest({tokens('text')}) AS word FROM benchmark) t
       JOIN wv ON wv.word = t.word GROUP BY ALL),
pv AS (SELECT DISTINCT vec_id FROM pc), cv AS (SELECT DISTINCT vec_id FROM cc),
sim AS (SELECT a.vec_id AS pv, b.vec_id AS cv,
          list_dot_product(ea.e, eb.e) / sqrt(list_dot_product(ea.e, ea.e) * list_dot_product(eb.e, eb.e)) AS s
        FROM pv a CROSS JOIN cv b JOIN ev ea ON ea.vec_id = a.vec_id JOIN ev eb ON eb.vec_id = b.vec_id),
m AS (SELECT sim.pv, cc.item_id, max(sim.s) AS m FROM sim JOIN cc ON cc.vec_id = sim.cv GROUP BY ALL),
p AS (SELECT pc.doc_id, m.item_id, sum(pc.cnt * m.m) / sum(pc.cnt) AS p FROM pc JOIN m ON m.pv = pc.vec_id GROUP BY ALL),
nx AS (SELECT pc.doc_id, sim.cv, max(sim.s) AS nmax FROM pc JOIN sim ON sim.pv = pc.vec_id GROUP BY ALL),
r AS (SELECT nx.doc_id, cc.item_id, sum(cc.cnt * nx.nmax) / sum(cc.cnt) AS r FROM nx JOIN cc ON cc.vec_id = nx.cv GROUP BY ALL),
prf AS (SELECT p.doc_id, p.item_id, p.p, r.r, CASE WHEN p.p + r.r = 0 THEN NULL ELSE 2 * p.p * r.r / (p.p + r.r) END AS f1
        FROM p JOIN r ON r.doc_id = p.doc_id AND r.item_id = p.item_id)
SELECT doc_id AS input_id, item_id AS misinfo_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(coalesce(f1, '-inf'::DOUBLE), 9) DESC, item_id) AS rank FROM prf)
WHERE rank <= 5"""


# ------------------------------------------------------------------ stance
def _weights_sql(c: int, dim: int) -> str:
    return f"list_transform(range({dim}), lambda j: ((31 * {c} + 17 * j) % 11 - 5) / 10.0)"


_SENT = "WITH " + _wv(glove_toks("text"), glove_toks("text")) + "," \
    + _mean_vec("pm", "documents", "doc_id") + "," + _mean_vec("cm", "benchmark", "item_id") + "," + TFIDF + """,
best AS (SELECT doc_id AS input_id, item_id AS misinfo_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, item_id) AS rk FROM tfidf_sc) WHERE rk = 1)"""


def _head(src: str, parts=("u", "v", "absdiff")) -> str:
    pieces = {"u": "u", "v": "v", "absdiff": "list_transform(range(len(u)), lambda i: abs(u[i + 1] - v[i + 1]))",
              "prod": "list_transform(range(len(u)), lambda i: u[i + 1] * v[i + 1])"}
    x = "list_concat(" + ", ".join(pieces[p] for p in parts) + ")"
    dim = 64 * len(parts)
    logits = ", ".join(f"list_dot_product(x, {_weights_sql(c, dim)}) + {(c - 1) / 10.0} AS l{c}" for c in range(3))
    return f"""
feat AS (SELECT s.*, p.vec AS u, c.vec AS v FROM {src} s JOIN pm_m p ON p.id = s.input_id JOIN cm_m c ON c.id = s.misinfo_id),
lg AS (SELECT *, {logits} FROM (SELECT *, {x} AS x FROM feat)),
pr AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1, exp(l2 - greatest(l0, l1, l2)) AS e2 FROM lg),
head AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM pr)"""


ORACLE["linear_softmax_head"] = _SENT + "," + _head("best") + """
SELECT input_id, misinfo_id,
  CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS BIGINT) AS label_id,
  round(greatest(p0, p1, p2), 6) AS confidence, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2
FROM head"""

ORACLE["softmax_stance_report"] = _SENT + "," + GOLD + "," + _head("gold") + f""",
spreds AS (SELECT 'linear-softmax' AS model_id, input_id, misinfo_id,
  CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS BIGINT) AS label_id FROM head),
cells AS (SELECT p.model_id, {_CELLS}
          FROM gold g JOIN spreds p ON p.input_id = g.input_id AND p.misinfo_id = g.misinfo_id
          GROUP BY p.model_id)
""" + _stance_report_sql("cells")

ORACLE["pair_features"] = _SENT + """,
feat AS (SELECT s.*, p.vec AS u, c.vec AS v FROM best s JOIN pm_m p ON p.id = s.input_id JOIN cm_m c ON c.id = s.misinfo_id),
x AS (SELECT input_id, misinfo_id, list_concat(u, v, list_transform(range(len(u)), lambda i: abs(u[i + 1] - v[i + 1])),
        list_transform(range(len(u)), lambda i: u[i + 1] * v[i + 1])) AS x FROM feat)
SELECT input_id, misinfo_id, CAST(len(x) AS BIGINT) AS n_features, round(list_sum(x), 6) AS feature_sum,
  round(sqrt(list_dot_product(x, x)), 6) AS feature_norm FROM x"""

ORACLE["cross_entropy"] = _SENT + "," + _head("best") + "," + GOLD + """
SELECT count(*) AS n_pairs, round(avg(greatest(l0, l1, l2) + ln(e0 + e1 + e2)
   - CASE g.gold_label WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END), 6) AS mean_loss
FROM head h JOIN gold g ON g.input_id = h.input_id AND g.misinfo_id = h.misinfo_id"""

ORACLE["triplet_margin_loss"] = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT count(*) AS n FROM embeddings),
t AS (SELECT a.v AS a, p.v AS p, q.v AS q FROM e a CROSS JOIN n
      JOIN e p ON p.vec_id = (a.vec_id + 1) % n.n JOIN e q ON q.vec_id = (a.vec_id + 2) % n.n)
SELECT count(*) AS n_triplets, round(avg(greatest(0.0,
  sqrt(list_sum(list_transform(range(len(a)), lambda i: (a[i + 1] - p[i + 1] + 1e-6) ** 2)))
  - sqrt(list_sum(list_transform(range(len(a)), lambda i: (a[i + 1] - q[i + 1] + 1e-6) ** 2))) + 1.0)), 6) AS mean_loss
FROM t"""

ORACLE["two_stage_label"] = _SENT + """,
rel AS (SELECT doc_id AS input_id, item_id AS misinfo_id, score FROM tfidf_sc),
relv AS (SELECT * FROM rel WHERE score >= 0.4),""" + _head("relv")[1:] + """
SELECT r.input_id, r.misinfo_id,
  CAST(CASE WHEN r.score >= 0.4 THEN (CASE WHEN h.p0 >= h.p1 THEN 0 ELSE 1 END) ELSE 2 END AS BIGINT) AS label_id,
  round(r.score, 6) AS confidence
FROM rel r LEFT JOIN head h ON h.input_id = r.input_id AND h.misinfo_id = r.misinfo_id"""

ORACLE["pipeline_agree_disagree"] = _SENT + """,
relv AS (SELECT * FROM best WHERE score >= 0.4),""" + _head("relv")[1:] + """
SELECT b.input_id, b.misinfo_id, b.score >= 0.4 AS relevant,
  CAST(CASE WHEN b.score >= 0.4 THEN (CASE WHEN h.l0 >= h.l1 THEN 0 ELSE 1 END) ELSE 2 END AS BIGINT) AS label_id,
  CASE WHEN b.score >= 0.4 THEN (CASE WHEN h.l0 >= h.l1 THEN 'agrees' ELSE 'disagrees' END) END AS label
FROM best b LEFT JOIN head h ON h.input_id = b.input_id AND h.misinfo_id = b.misinfo_id"""


# ------------------------------------------------------------ store / ingest
_TS = "'%Y-%m-%d %H:%M:%S'"
_PAIRS = "FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey"

ORACLE["input_output_pairs"] = f"""SELECT c.c_custkey AS input_id, o.o_orderkey AS output_id,
  c.c_mktsegment AS input_source_type, round(o.o_totalprice, 6) AS confidence, strftime(o.o_orderdate, {_TS}) AS date {_PAIRS}"""

ORACLE["pairs_by_date"] = f"""SELECT c.c_custkey AS input_id, o.o_orderkey AS output_id, strftime(o.o_orderdate, {_TS}) AS date {_PAIRS}
WHERE o.o_orderdate >= TIMESTAMP '1995-01-01' AND o.o_orderdate < TIMESTAMP '1996-01-01'"""

ORACLE["pairs_by_date_bounds"] = f"""
SELECT 'from' AS variant, count(*) AS n_pairs {_PAIRS} WHERE o.o_orderdate >= TIMESTAMP '1995-01-01'
UNION ALL SELECT 'until', count(*) {_PAIRS} WHERE o.o_orderdate < TIMESTAMP '1996-01-01'
UNION ALL SELECT 'both', count(*) {_PAIRS} WHERE o.o_orderdate >= TIMESTAMP '1995-01-01' AND o.o_orderdate < TIMESTAMP '1996-01-01'
UNION ALL SELECT 'none', count(*) {_PAIRS}"""

ORACLE["recent_k_pairs"] = f"""SELECT c.c_custkey AS input_id, o.o_orderkey AS output_id {_PAIRS} ORDER BY o.o_orderkey DESC LIMIT 10"""

ORACLE["outputs_by_model_input_misinfo"] = """SELECT l_orderkey * 10 + l_linenumber AS output_id, l_orderkey AS input_id,
  l_partkey AS misinfo_id, CAST(l_linenumber % 3 AS BIGINT) AS label_id, round(l_discount, 6) AS confidence
FROM lineitem WHERE l_returnflag = 'R'"""

ORACLE["inputs_by_source"] = """SELECT doc_id AS input_id, CAST(doc_id AS VARCHAR) AS source_id FROM documents WHERE source = 'src3'"""

ORACLE["claims_by_source"] = "WITH " + CLAIMS + """
SELECT id, canonical_sentence AS text, sources[1] AS source FROM claims WHERE sources[1] = 'src1'"""

_EVENTS = """ek AS (SELECT event_id, ts, event_type || ':' || CAST(user_id AS VARCHAR) AS source_id FROM events),
stored AS (SELECT source_id, min(event_id) AS id FROM ek WHERE ts < TIMESTAMP '2024-01-11' GROUP BY source_id),
inc AS (SELECT * FROM ek WHERE ts >= TIMESTAMP '2024-01-11'),
firsts AS (SELECT source_id, min(event_id) AS event_id FROM inc GROUP BY source_id),
new AS (SELECT * FROM firsts WHERE source_id NOT IN (SELECT source_id FROM stored))"""

ORACLE["insert_if_new"] = "WITH " + _EVENTS + """
SELECT (SELECT coalesce(max(id), 0) FROM stored) + row_number() OVER (ORDER BY event_id) AS id, source_id, event_id FROM new"""

ORACLE["insert_counts"] = "WITH " + _EVENTS + """
SELECT (SELECT count(*) FROM inc) AS given, (SELECT count(*) FROM new) AS inserted,
  (SELECT count(*) FROM inc) = (SELECT count(*) FROM new) AS success"""

ORACLE["annotation_csv_load"] = """WITH
ann AS (SELECT d.doc_id, d.doc_id % (SELECT count(*) FROM benchmark) AS misconception_id, d.text AS tweet,
   CASE WHEN l.toxic = 1 THEN 'neg' WHEN l.quality = 1 THEN 'pos' WHEN l.toxic IS NOT NULL THEN 'na' ELSE '' END AS label,
   CASE WHEN d.doc_id % 50 = 0 THEN '' ELSE CAST(d.doc_id % 500 AS VARCHAR) END AS tweet_id
   FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT * FROM ann WHERE length(label) > 0 AND length(tweet_id) > 0),
firsts AS (SELECT tweet_id, min(doc_id) AS doc_id FROM r GROUP BY tweet_id),
ids AS (SELECT tweet_id, row_number() OVER (ORDER BY doc_id) AS input_id FROM firsts)
SELECT i.input_id, r.misconception_id AS misinfo_id,
  CAST(CASE r.label WHEN 'pos' THEN 0 WHEN 'neg' THEN 1 ELSE 2 END AS BIGINT) AS label_id,
  CAST(1.0 AS DOUBLE) AS confidence, 'human' AS model_id
FROM r JOIN ids i ON i.tweet_id = r.tweet_id"""

ORACLE["claims_to_table"] = "WITH " + CLAIMS + """
SELECT id, canonical_sentence AS text, CAST(to_json(struct_pack(list := sources)) AS VARCHAR) AS url, origin AS source,
  CAST(1.0 AS DOUBLE) AS reliability,
  CAST(to_json(struct_pack(category := category, pos_variations := pos_variations, neg_variations := CAST([] AS VARCHAR[]),
                      reliability_score := reliability_score)) AS VARCHAR) AS misc
FROM (SELECT *, row_number() OVER (PARTITION BY canonical_sentence ORDER BY id) AS rn FROM claims) WHERE rn = 1"""

_TWEETS = """tw AS (SELECT event_id AS id, ts AS created_at, ['en', 'fr', 'de'][event_id % 3 + 1] AS lang,
  CAST(user_id AS VARCHAR) AS id_str, value AS followers_count, props,
  CASE WHEN event_type = 'error' THEN user_id END AS retweeted_status FROM events)"""

ORACLE["minimize_json"] = "WITH " + _TWEETS + """
SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, lang, id_str AS user_id_str,
  CAST(json_extract(props, '$.k') AS BIGINT) AS props_k
FROM tw WHERE lang = 'en' AND retweeted_status IS NULL"""

ORACLE["minimize_json_defaults"] = "WITH " + _TWEETS + """
SELECT coalesce(id, -1) AS id, coalesce(lang, 'und') AS lang, coalesce(id_str, '') AS user_id_str,
  round(coalesce(followers_count, 0.0), 6) AS user_followers_count,
  CAST(coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS BIGINT) AS props_k,
  coalesce(json_extract_string(props, '$.note'), 'n/a') AS props_note FROM tw"""

ORACLE["unique_counts"] = """SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(DISTINCT text) AS n_texts,
  count(DISTINCT source) AS n_users FROM documents"""

_ARTICLES = """art AS (SELECT page_id, url,
  trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '\\s+', ' ', 'g')) AS title,
  strftime(DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER), '%Y-%m-%d') AS publishedAt,
  regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) AS host,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, html,
  CASE WHEN contains(url, '#') THEN 500 END AS errorCode FROM pages)"""

ORACLE["keyword_domain_filter"] = "WITH " + _ARTICLES + f""",
tk AS (SELECT *, {tokens('html')} AS toks FROM art)
SELECT page_id, host, publishedAt FROM tk
WHERE (list_contains(toks, 'the') OR list_contains(toks, 'with')) AND list_contains(toks, 'and')
  AND lang = 'en' AND NOT suffix(host, '.example.org')
  AND publishedAt >= '2024-01-03' AND publishedAt < '2024-01-28'
ORDER BY publishedAt DESC, page_id LIMIT 100"""

ORACLE["crawl_queries"] = "WITH " + _ARTICLES + f""",
tk AS (SELECT page_id, lower(html) AS html, {tokens('html')} AS toks FROM art),
q AS (SELECT item_id AS query_id, {tokens('text')} AS w FROM benchmark)
SELECT query_id, page_id FROM tk, q WHERE len(w) > 0 AND list_has_any(toks, w[1:3]) AND list_has_all(toks, w[4:5])
  AND (len(w) < 6 OR contains(html, w[6]))"""

ORACLE["article_dedup"] = """WITH e AS (SELECT event_type AS category, 'https://news.example/' || CAST(user_id AS VARCHAR) AS url,
  event_id AS seq, ts FROM events),
b AS (SELECT category, url, min(seq) AS seq FROM e WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY ALL)
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.ts < TIMESTAMP '2024-01-11' AND e.category = b.category AND e.url = b.url)"""

ORACLE["article_rows"] = "WITH " + _ARTICLES + """
SELECT url, title, coalesce(publishedAt, '') AS publishedAt, 'utc-20240201-123456' AS addedAt FROM art WHERE errorCode IS NULL"""

ORACLE["default_day_window"] = """
SELECT 'since' AS variant, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'
UNION ALL
SELECT 'until', event_id FROM events WHERE ts >= TIMESTAMP '2024-01-19' AND ts < TIMESTAMP '2024-01-20'"""

ORACLE["request_batches"] = """SELECT CAST((rn - 1) // 100 AS BIGINT) AS batch, count(*) AS n_ids,
  string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1"""

ORACLE["pending_files"] = f"""WITH p AS (SELECT 'in/' || CAST(page_id AS VARCHAR) || '.jsonl' AS path, CAST(page_id AS VARCHAR) AS stem, url FROM pages),
done AS (SELECT stem FROM p WHERE {H('url')} % 3 = 0 UNION SELECT stem FROM p WHERE {H('url')} % 3 = 1)
SELECT path, stem FROM p WHERE stem NOT IN (SELECT stem FROM done)"""

ORACLE["latest_months"] = """WITH m AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders)
SELECT o_orderkey, month FROM m WHERE month IN (SELECT DISTINCT month FROM m ORDER BY month DESC LIMIT 3)"""

def _unescaped(x: str) -> str:
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{mark}')"
    return x


_CARD, _LINK = r"(?s)<article\b([^>]*)>(.*?)</article>", r"(?s)<header\b.*?<h2\b.*?<a\b([^>]*)>(.*?)</a>"


def _attr(x: str, name: str) -> str:
    return _unescaped(f"""regexp_extract({x}, '(?:^|\\s){name}\\s*=\\s*["'']([^"'']*)["'']', 1)""")


_CARD_CLAIM = "CASE WHEN len(st) > 1 THEN array_to_string(st[2:], '') ELSE array_to_string(st, '') END"
ORACLE["html_cards_to_claims"] = f"""WITH c AS (SELECT replace(replace(html, '<article><h1>', '<article id="post-' || page_id
    || '"><header><h2><a href="' || url || '"><span>' || {list(CARD_STATUS)}[CAST(page_id % {len(CARD_STATUS)} AS INTEGER) + 1]
    || '</span> '), '</h1>', '</a></h2></header>') AS html FROM pages),
u AS (SELECT unnest(regexp_extract_all(html, '{_CARD}', 1)) AS attrs, unnest(regexp_extract_all(html, '{_CARD}', 2)) AS card,
        generate_subscripts(regexp_extract_all(html, '{_CARD}', 1), 1) - 1 AS card_idx FROM c),
l AS (SELECT attrs, card_idx, regexp_extract(card, '{_LINK}', 1) AS link,
        list_filter(string_split_regex(regexp_extract(card, '{_LINK}', 2), '<[^>]*>'), lambda s: s <> '') AS st FROM u)
SELECT {_attr('attrs', 'id')} AS id, CAST(card_idx AS BIGINT) AS card_idx, {_attr('link', 'href')} AS href,
  trim(regexp_replace({_unescaped(_CARD_CLAIM)}, '\\s+', ' ', 'g')) AS claim,
  CASE WHEN len(st) > 1 THEN {_unescaped('st[1]')}[1:-2] END AS status, 'fact-check-cards' AS origin FROM l"""

ORACLE["variant_columns_wide"] = "WITH " + CLAIMS + """
SELECT id, """ + ", ".join(f"coalesce(sources[{i + 1}], '') AS source_{i + 1}" for i in range(5)) + ", " \
    + ", ".join(f"coalesce(pos_variations[{i + 1}], '') AS pos_{i + 1}" for i in range(5)) + ", " \
    + ", ".join(f"'' AS neg_{i + 1}" for i in range(5)) + """, coalesce(category[1], '') AS category FROM claims"""

ORACLE["dataset_digest"] = "WITH " + CLAIMS + """,
l AS (SELECT id, unnest(pos_variations) AS line, generate_subscripts(pos_variations, 1) AS var_idx FROM claims),
p AS (SELECT line, row_number() OVER (ORDER BY id, var_idx) AS pos FROM l),
b0 AS (SELECT (pos - 1) // 16 AS bucket, md5(string_agg(md5(line), '' ORDER BY pos)) AS h FROM p GROUP BY 1),
""" + ",\n".join(f"""c{i} AS (SELECT count(*) > 16 AS more FROM b{i}),
b{i + 1} AS (SELECT CASE WHEN more THEN bucket // 16 ELSE bucket END AS bucket,
   CASE WHEN any_value(more) THEN md5(string_agg(h, '' ORDER BY b{i}.bucket)) ELSE any_value(h) END AS h
   FROM b{i}, c{i} GROUP BY 1)""" for i in range(6)) + """
SELECT md5(string_agg(h, '' ORDER BY bucket)) AS digest, (SELECT count(*) FROM p) AS n_lines FROM b6"""

ORACLE["config_overlay"] = """WITH d AS (
  SELECT n_nationkey AS entity, 'name' AS key, n_name AS value FROM nation
  UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation
  UNION ALL SELECT n_nationkey, 'status', 'active' FROM nation),
c AS (SELECT c_nationkey AS entity, max(CASE WHEN c_acctbal < 0 THEN 'in-debt' ELSE '' END) AS status,
        max(c_mktsegment) AS segment FROM customer GROUP BY 1),
o AS (SELECT entity, 'status' AS key, status AS value FROM c UNION ALL SELECT entity, 'segment', segment FROM c),
o2 AS (SELECT * FROM o WHERE value IS NOT NULL AND value <> '')
SELECT CAST(coalesce(d.entity, o2.entity) AS BIGINT) AS entity, coalesce(d.key, o2.key) AS key,
  coalesce(o2.value, d.value) AS value FROM d FULL OUTER JOIN o2 ON d.entity = o2.entity AND d.key = o2.key"""


ORACLE["nested_overlay"] = """WITH m AS (SELECT c_custkey, json_merge_patch(
    json_object('name', n_name, 'limits', json_object('balance', json_object('min', 0, 'max', 9999), 'tier', 'plain')),
    CASE WHEN c_acctbal < 0 THEN json_object('limits', json_object('balance', json_object('min', CAST(floor(c_acctbal) AS BIGINT))),
                                             'flags', json_object('debt', true))
         ELSE json_object('limits', json_object('tier', c_mktsegment)) END) AS m
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, json_extract_string(m, '$.name') AS name,
  CAST(json_extract_string(m, '$.limits.balance.min') AS BIGINT) AS balance_min,
  CAST(json_extract_string(m, '$.limits.balance.max') AS BIGINT) AS balance_max,
  json_extract_string(m, '$.limits.tier') AS tier, json_extract_string(m, '$.flags.debt') AS debt FROM m"""


# ------------------------------------------------- variations / readable
_VARS = CLAIMS + """,
vars AS (SELECT id AS item_id, CAST(generate_subscripts(pos_variations, 1) - 1 AS BIGINT) AS var_idx,
                unnest(pos_variations) AS line FROM claims)"""

ORACLE["topk_posts_per_claim"] = "WITH " + _wv(tokens("text"), tokens("text")) + "," + _VARS + f""",
pc AS (SELECT t.doc_id, wv.vec_id, count(*) AS cnt FROM (SELECT doc_id, unnest({tokens('text')}) AS word FROM documents) t
       JOIN wv ON wv.word = t.word GROUP BY ALL),
cc AS (SELECT t.item_id, t.var_idx, wv.vec_id, count(*) AS cnt FROM (SELECT item_id, var_idx, unnest({tokens('line')}) AS word FROM vars) t
       JOIN wv ON wv.word = t.word GROUP BY ALL),
pv AS (SELECT DISTINCT vec_id FROM pc), cv AS (SELECT DISTINCT vec_id FROM cc),
sim AS (SELECT a.vec_id AS pv, b.vec_id AS cv,
          list_dot_product(ea.e, eb.e) / sqrt(list_dot_product(ea.e, ea.e) * list_dot_product(eb.e, eb.e)) AS s
        FROM pv a CROSS JOIN cv b JOIN ev ea ON ea.vec_id = a.vec_id JOIN ev eb ON eb.vec_id = b.vec_id),
m AS (SELECT sim.pv, cc.item_id, cc.var_idx, max(sim.s) AS m FROM sim JOIN cc ON cc.vec_id = sim.cv GROUP BY ALL),
p AS (SELECT pc.doc_id, m.item_id, m.var_idx, sum(pc.cnt * m.m) / sum(pc.cnt) AS p FROM pc JOIN m ON m.pv = pc.vec_id GROUP BY ALL),
nx AS (SELECT pc.doc_id, sim.cv, max(sim.s) AS nmax FROM pc JOIN sim ON sim.pv = pc.vec_id GROUP BY ALL),
r AS (SELECT nx.doc_id, cc.item_id, cc.var_idx, sum(cc.cnt * nx.nmax) / sum(cc.cnt) AS r FROM nx JOIN cc ON cc.vec_id = nx.cv GROUP BY ALL),
prf AS (SELECT p.doc_id, p.item_id, p.var_idx, CASE WHEN p.p + r.r = 0 THEN NULL ELSE 2 * p.p * r.r / (p.p + r.r) END AS f1
        FROM p JOIN r ON r.doc_id = p.doc_id AND r.item_id = p.item_id AND r.var_idx = p.var_idx),
ranked AS (SELECT prf.*, d.text AS tweet, row_number() OVER (PARTITION BY prf.item_id, prf.var_idx
             ORDER BY round(f1, 9) DESC, d.text DESC, prf.doc_id) AS rank
           FROM prf JOIN documents d ON d.doc_id = prf.doc_id WHERE f1 IS NOT NULL)
SELECT k.item_id AS id, k.var_idx, v.line AS pos_variation, k.doc_id AS input_id, k.tweet, round(k.f1, 6) AS score, k.rank
FROM ranked k JOIN vars v ON v.item_id = k.item_id AND v.var_idx = k.var_idx WHERE k.rank <= 5"""

ORACLE["best_variation_per_claim"] = "WITH " + _VARS + f""",
vt AS (SELECT item_id, var_idx, tok, count(*) AS tf FROM (SELECT item_id, var_idx, unnest({tokens('line')}) AS tok FROM vars) GROUP BY ALL),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM vars),
dfm AS (SELECT tok, count(*) AS df FROM vt GROUP BY tok),
pt AS (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS tok FROM documents) GROUP BY ALL),
pi AS (SELECT p.doc_id, p.tok, p.tf, ln((n.n + 2) / (2 + coalesce(d.df, 0))) + 1 AS i1 FROM pt p LEFT JOIN dfm d ON p.tok = d.tok CROSS JOIN n),
pn AS (SELECT doc_id, sum(tf * tf * i1 * i1) AS nn FROM pi GROUP BY doc_id),
mb AS (SELECT m.item_id, m.var_idx, sum(m.tf * m.tf * power(ln((n.n + 2) / (1 + d.df)) + 1, 2)) AS bb
       FROM vt m JOIN dfm d ON m.tok = d.tok CROSS JOIN n GROUP BY ALL),
hit AS (SELECT p.doc_id, m.item_id, m.var_idx, sum(p.tf * m.tf * p.i1 * p.i1) AS dot,
        sum(m.tf * m.tf * (p.i1 * p.i1 - power(ln((n.n + 2) / (1 + d.df)) + 1, 2))) AS corr
        FROM pi p JOIN vt m ON p.tok = m.tok JOIN dfm d ON d.tok = m.tok CROSS JOIN n GROUP BY ALL),
sc AS (SELECT h.doc_id, h.item_id, h.var_idx, h.dot / sqrt(pn.nn * (mb.bb + h.corr)) AS score
       FROM hit h JOIN pn ON pn.doc_id = h.doc_id JOIN mb ON mb.item_id = h.item_id AND mb.var_idx = h.var_idx)
SELECT doc_id AS input_id, item_id AS misinfo_id, var_idx, round(score, 6) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, item_id, var_idx) AS rk FROM sc) WHERE rk = 1"""

ORACLE["readable_predictions"] = "WITH " + TFIDF + """
SELECT s.doc_id AS input_id, first_value(round(s.score, 9)) OVER (PARTITION BY s.doc_id ORDER BY s.rank) >= 0.4 AS relevant,
  s.rank, s.item_id AS misinfo_id, round(s.score, 6) AS misinformation_score, b.text AS claim
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM tfidf_sc) s
JOIN benchmark b ON b.item_id = s.item_id WHERE s.rank <= 5"""


# ---------------------------------------------------------- training sets
def HC(*parts: str) -> str:
    """Hash of concat_ws('|', parts...) -- twin of fixtures._h."""
    return H("concat_ws('|', " + ", ".join(parts) + ")")


def _v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


_FEVER_CONVERT = f"""
fc AS (SELECT item_id AS id, text AS claim, ['SUPPORTS', 'REFUTES', 'NOT ENOUGH INFO'][item_id % 3 + 1] AS label FROM benchmark),
np AS (SELECT count(*) * 105 // 100 AS n FROM documents),
st AS (SELECT item_id AS id, s FROM benchmark, (SELECT unnest([0, 1]) AS s)),
el AS (SELECT id, s, unnest(range({HC(_v('id'), "'s'", _v('s'))} % 2 + 1)) AS j FROM st),
ev AS (SELECT id, s AS set_idx, CAST({HC(_v('id'), _v('s'), _v('j'))} % (SELECT n FROM np) AS VARCHAR) AS page,
              CAST({HC(_v('id'), _v('s'), _v('j'), "'l'")} % 3 AS INTEGER) AS line FROM el),
pg AS (SELECT DISTINCT id, page FROM ev),
miss AS (SELECT DISTINCT id FROM pg WHERE page NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)),
wl AS (SELECT CAST(doc_id AS VARCHAR) AS page,
         array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CAST(i - 1 AS VARCHAR) || chr(9) || l), chr(10)) AS lines
       FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT page FROM pg)),
wp AS (SELECT page, string_split(replace(replace(replace(replace(lines, '-LRB-', '('), '-RRB-', ')'), '-LSB-', '('), '-RSB-', ')'), chr(10)) AS parts FROM wl),
ws AS (SELECT page, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS line, unnest(parts) AS raw FROM wp),
wss AS (SELECT page, line, replace(substr(raw, instr(raw, chr(9)) + 1), chr(9), ' ') AS sentence FROM ws),
sent AS (SELECT pg.id, wss.page, wss.line, wss.sentence,
           CAST(row_number() OVER (PARTITION BY pg.id ORDER BY wss.page, wss.line) - 1 AS INTEGER) AS idx
         FROM pg JOIN wss ON wss.page = pg.page WHERE length(wss.sentence) > 0),
sagg AS (SELECT id, list(sentence ORDER BY idx) AS sentences FROM sent GROUP BY id),
es AS (SELECT ev.id, ev.set_idx, list_sort(list(sent.idx)) AS s FROM ev JOIN sent ON sent.id = ev.id AND sent.page = ev.page AND sent.line = ev.line GROUP BY ALL),
esd AS (SELECT id, s, min(set_idx) AS first FROM es GROUP BY id, s),
eagg AS (SELECT id, list(s ORDER BY first) AS evidence_sets FROM esd GROUP BY id),
conv AS (SELECT fc.id, fc.claim, CASE WHEN fc.id IN (SELECT id FROM miss) THEN 'NOT ENOUGH INFO' ELSE fc.label END AS label,
           coalesce(sagg.sentences, CAST([] AS VARCHAR[])) AS sentences, coalesce(eagg.evidence_sets, CAST([] AS INTEGER[][])) AS evidence_sets
         FROM fc LEFT JOIN sagg ON sagg.id = fc.id LEFT JOIN eagg ON eagg.id = fc.id)"""

ORACLE["fever_convert"] = "WITH " + _FEVER_CONVERT + """
SELECT id, claim, label, CAST(len(sentences) AS BIGINT) AS n_sentences, md5(array_to_string(sentences, chr(10))) AS sentences_md5,
  array_to_string(list_transform(evidence_sets, lambda s: array_to_string(s, ',')), ';') AS evidence_sets FROM conv"""


def _pick1(arr: str, seed: str, key: str) -> str:
    return (f"list_sort(list_transform({arr}, lambda i: {{'h': md5(concat_ws('|', '{seed}', {key}, CAST(i AS VARCHAR))), "
            f"'i': i}}))[1].i")


ORACLE["fever_examples"] = "WITH " + _FEVER_CONVERT + f""",
evr AS (SELECT id, claim, label, sentences, unnest(evidence_sets) AS s, generate_subscripts(evidence_sets, 1) - 1 AS set_idx
        FROM conv WHERE label <> 'NOT ENOUGH INFO' AND len(evidence_sets) > 0),
non AS (SELECT id, sentences, list_filter(range(len(sentences)), lambda i: NOT list_contains(flatten(evidence_sets), i)) AS nn
        FROM conv WHERE label <> 'NOT ENOUGH INFO' AND len(sentences) > 0)
SELECT id, 'evidence' AS kind, CAST(set_idx AS BIGINT) AS set_idx,
  array_to_string(list_transform(s, lambda i: sentences[i + 1]), ' ') AS rationale,
  CAST(CASE label WHEN 'SUPPORTS' THEN 0 ELSE 1 END AS BIGINT) AS label FROM evr
UNION ALL
SELECT id, 'nei', 0, sentences[{_pick1('range(len(sentences))', 'fever', _v('id'))} + 1], 2
FROM conv WHERE label = 'NOT ENOUGH INFO' AND len(sentences) > 0
UNION ALL
SELECT id, 'negative', 0, sentences[{_pick1('nn', 'fever', _v('id'))} + 1], 2 FROM non WHERE len(nn) > 0"""


def _pickk(arr: str, seed: str, key: str, k: str) -> str:
    return (f"list_transform(list_sort(list_transform({arr}, lambda i: {{'h': md5(concat_ws('|', '{seed}', {key}, CAST(i AS VARCHAR))), "
            f"'i': i}}))[1:{k}], lambda x: x.i)")


_KNEG = "least(1 + (" + H("concat_ws('|', 'scifact', key, 'k')") + " % 2), len(nn))"
_KCIT = "least(1 + (" + H("concat_ws('|', 'scifact', key, 'k')") + " % 2), len(abstract))"

ORACLE["scifact_examples"] = f"""WITH
corpus AS (SELECT doc_id, string_split(text, chr(10)) AS abstract FROM documents),
nd AS (SELECT count(*) AS n FROM documents),
b AS (SELECT item_id, text AS claim FROM benchmark),
ej AS (SELECT item_id, unnest(range({HC(_v('item_id'), "'d'")} % 2 + 1)) AS j FROM b WHERE item_id % 5 <> 0),
ed AS (SELECT DISTINCT item_id, {HC(_v('item_id'), "'d'", _v('j'))} % (SELECT n FROM nd) AS doc_id FROM ej),
edn AS (SELECT ed.item_id, ed.doc_id, len(c.abstract) AS n, c.abstract, b.claim FROM ed JOIN corpus c ON c.doc_id = ed.doc_id JOIN b ON b.item_id = ed.item_id),
ss AS (SELECT item_id, doc_id, n, abstract, claim, unnest(range({HC(_v('item_id'), _v('doc_id'), "'n'")} % 2 + 1)) AS s FROM edn),
st AS (SELECT item_id, doc_id, n, abstract, claim, s,
         list_sort(list_distinct(list_transform(range({HC(_v('item_id'), _v('doc_id'), _v('s'), "'m'")} % 2 + 1),
           lambda t: CAST({HC(_v('item_id'), _v('doc_id'), _v('s'), _v('t'))} % n AS INTEGER)))) AS sentences,
         CASE WHEN {HC(_v('item_id'), _v('doc_id'))} % 2 = 0 THEN 'SUPPORT' ELSE 'CONTRADICT' END AS label FROM ss),
alli AS (SELECT item_id, doc_id, any_value(abstract) AS abstract, any_value(claim) AS claim, list_sort(list_distinct(flatten(list(sentences)))) AS idx,
           any_value(label) AS label FROM st GROUP BY item_id, doc_id),
nonr AS (SELECT *, list_filter(range(len(abstract)), lambda i: NOT list_contains(idx, i)) AS nn,
           concat_ws('|', CAST(item_id AS VARCHAR), CAST(doc_id AS VARCHAR)) AS key FROM alli),
cd AS (SELECT item_id, claim, unnest([{HC(_v('item_id'), "'c0'")} % (SELECT n FROM nd), {HC(_v('item_id'), "'c1'")} % (SELECT n FROM nd)]) AS doc_id
       FROM b WHERE item_id % 5 = 0),
cdn AS (SELECT cd.*, c.abstract, concat_ws('|', CAST(cd.item_id AS VARCHAR), CAST(cd.doc_id AS VARCHAR)) AS key FROM cd JOIN corpus c ON c.doc_id = cd.doc_id)
SELECT item_id AS claim_id, doc_id, 'set' AS kind, CAST(s AS BIGINT) AS set_idx,
  array_to_string(list_transform(sentences, lambda i: trim(abstract[i + 1])), ' ') AS rationale,
  CAST(CASE label WHEN 'SUPPORT' THEN 0 ELSE 1 END AS BIGINT) AS label FROM st
UNION ALL
SELECT item_id, doc_id, 'all', 0, array_to_string(list_transform(idx, lambda i: trim(abstract[i + 1])), ' '),
  CAST(CASE label WHEN 'SUPPORT' THEN 0 ELSE 1 END AS BIGINT) FROM alli
UNION ALL
SELECT item_id, doc_id, 'negative', 0,
  array_to_string(list_transform(list_sort({_pickk('nn', 'scifact', 'key', _KNEG)}),
                                 lambda i: trim(abstract[i + 1])), ' '), 2 FROM nonr
UNION ALL
SELECT item_id, doc_id, 'cited', 0,
  array_to_string(list_transform({_pickk('range(len(abstract))', 'scifact', 'key', _KCIT)},
                                 lambda i: trim(abstract[i + 1])), ' '), 2 FROM cdn"""

_NLI = f"""u AS (SELECT conv_id, turn, text AS sentence1 FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS sentence2 FROM conversations),
nli AS (SELECT u.conv_id, u.turn, sentence1, sentence2,
          ['entailment', 'contradiction', 'neutral', '-'][{HC(_v('u.conv_id'), _v('u.turn'))} % 4 + 1] AS gold_label
        FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn),
nlx AS (SELECT *, CAST(CASE gold_label WHEN 'entailment' THEN 0 WHEN 'contradiction' THEN 1 ELSE 2 END AS BIGINT) AS label
        FROM nli WHERE gold_label IN ('entailment', 'contradiction', 'neutral'))"""

ORACLE["nli_examples"] = "WITH " + _NLI + "\nSELECT conv_id, turn, sentence1, sentence2, label FROM nlx"

ORACLE["batch_mean_accuracy"] = "WITH " + _NLI + f""",
c AS (SELECT CASE WHEN {HC(_v('conv_id'), _v('turn'), "'p'")} % 3 = label THEN 1.0 ELSE 0.0 END AS correct,
        row_number() OVER (ORDER BY conv_id, turn) AS pos FROM nlx),
bt AS (SELECT (pos - 1) // 32 AS batch, avg(correct) AS acc, count(*) AS n FROM c GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_examples, count(*) AS n_batches, round(sum(acc * n) / sum(n), 6) AS exact_accuracy,
  round(avg(acc), 6) AS batch_mean_accuracy FROM bt"""

ORACLE["retriever_training_set"] = f"""WITH
pool AS (SELECT doc_id, text, source, row_number() OVER (ORDER BY md5(concat_ws('|', 'dpr', source)),
           md5(concat_ws('|', 'dpr', CAST(doc_id AS VARCHAR))), doc_id) AS p FROM documents WHERE length(text) > 0),
np AS (SELECT count(*) AS n FROM pool),
own AS (SELECT source, min(p) AS first, count(*) AS own FROM pool GROUP BY source),
sz AS (SELECT d.source AS question, CAST(floor(count(*) * 0.5) AS BIGINT) AS neg_size,
         (SELECT n FROM np) - coalesce(any_value(own), 0) AS others, coalesce(any_value(first) - 1 + any_value(own), 0) AS after
       FROM documents d LEFT JOIN own ON own.source = d.source GROUP BY d.source),
w AS (SELECT question, others, after, ('0x' || substr(md5(concat_ws('|', 'dpr', question)), 1, 8))::BIGINT % others AS o,
        unnest(range(neg_size)) AS ctx_idx FROM sz WHERE neg_size > 0 AND others > 0)
SELECT source AS question, 'positive' AS kind, CAST(-1 AS BIGINT) AS ctx_idx, doc_id AS ctx_id, text FROM documents
UNION ALL
SELECT w.question, 'negative', w.ctx_idx, pool.doc_id, pool.text FROM w JOIN pool ON pool.p =
  (w.after + (w.o + w.ctx_idx * CASE WHEN w.others % 1000003 = 0 THEN 1 ELSE 1000003 END) % w.others) % (SELECT n FROM np) + 1"""

ORACLE["seeded_split"] = """SELECT doc_id, (pos - 1) % 4 AS worker, (pos - 1) // 4 AS local_idx FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', 'split', CAST(doc_id AS VARCHAR))), doc_id) AS pos FROM documents)"""

ORACLE["vocab_min_count"] = "WITH " + _NLI + f"""
SELECT token, count(*) AS cnt FROM (SELECT unnest(list_concat({glove_toks('sentence1')}, {glove_toks('sentence2')})) AS token FROM nlx)
GROUP BY token HAVING count(*) >= 2"""

ORACLE["bigram_df"] = f"""WITH t AS (SELECT doc_id, {tokens('text')} AS toks FROM documents),
g AS (SELECT doc_id, list_concat(toks, list_transform(range(greatest(len(toks) - 1, 0)), lambda i: toks[i + 1] || ' ' || toks[i + 2])) AS terms FROM t),
d AS (SELECT DISTINCT doc_id, unnest(terms) AS term FROM g)
SELECT term, count(*) AS df FROM d GROUP BY term HAVING count(*) >= 2"""


# --------------------------------------------------------- sources / sinks
ORACLE["jsonl_gz_roundtrip"] = """SELECT doc_id, lang, source, md5(text) AS text_md5, true AS same_plain,
  (SELECT count(*) FROM documents) AS n_plain FROM documents"""

ORACLE["named_files_roundtrip"] = """SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day, true AS same_day,
  true AS bounded FROM events"""

ORACLE["mirrored_tree_thin"] = "WITH " + _TWEETS + """
SELECT strftime(created_at, '%Y-%m-%d') AS day, id, lang, id_str AS user_id_str,
  CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM tw WHERE lang = 'en' AND retweeted_status IS NULL"""

ORACLE["csv_annotation_roundtrip"] = """WITH ann AS (SELECT d.doc_id % (SELECT count(*) FROM benchmark) AS misconception_id, d.text AS tweet,
   CASE WHEN l.toxic = 1 THEN 'neg' WHEN l.quality = 1 THEN 'pos' WHEN l.toxic IS NOT NULL THEN 'na' ELSE '' END AS label,
   CASE WHEN d.doc_id % 50 = 0 THEN '' ELSE CAST(d.doc_id % 500 AS VARCHAR) END AS tweet_id
   FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT misconception_id, md5(tweet) AS tweet_md5, label, tweet_id FROM ann"""

ORACLE["csv_news_roundtrip"] = """SELECT source AS source_title, count(*) AS n_tweets, CAST(sum(length(text)) AS BIGINT) AS total_chars
FROM documents GROUP BY source"""

ORACLE["csv_predictions_roundtrip"] = "WITH " + STANCE_PREDS + """
SELECT model_id, input_id, misinfo_id, label_id, round(confidence, 6) AS confidence, round(1.0 - confidence, 6) AS p1 FROM spreds"""

ORACLE["claims_jsonl_roundtrip"] = "WITH " + CLAIMS + """
SELECT id, CAST(generate_subscripts(pos_variations, 1) - 1 AS BIGINT) AS var_idx, unnest(pos_variations) AS sentence,
  reliability_score FROM claims"""

ORACLE["claims_table_roundtrip"] = "WITH " + CLAIMS + """
SELECT id, CAST(generate_subscripts(pos_variations, 1) - 1 AS BIGINT) AS var_idx, unnest(pos_variations) AS sentence,
  origin AS source FROM claims WHERE len(pos_variations) > 0"""

ORACLE["fever_jsonl_roundtrip"] = "WITH " + _FEVER_CONVERT + """
SELECT id, label, CAST(len(sentences) AS BIGINT) AS n_sentences,
  array_to_string(list_transform(evidence_sets, lambda s: array_to_string(s, ',')), ';') AS evidence_sets FROM conv"""

ORACLE["word_vector_file"] = """SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS BIGINT) AS dim,
  round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vec_sum FROM embeddings"""

ORACLE["id_list_roundtrip"] = "WITH " + _EVENTS + """
SELECT (SELECT coalesce(max(id), 0) FROM stored) + row_number() OVER (ORDER BY event_id) AS id FROM new"""

ORACLE["append_table_roundtrip"] = "WITH " + _EVENTS + """
SELECT source_id, id AS event_id FROM stored UNION ALL SELECT source_id, event_id FROM new"""

ORACLE["wide_sheet_roundtrip"] = ORACLE["variant_columns_wide"]


# ---------------------------------------------------------------- streaming
ORACLE["stream_stance"] = ORACLE["pipeline_agree_disagree"]
ORACLE["article_dedup_stream"] = ORACLE["article_dedup"]


# ------------------------------------------------------- more operators
def _hash_vec(src: str, id_col: str) -> str:
    return f"""SELECT {id_col} AS id, b, count(*) AS c FROM (
  SELECT {id_col}, {H('tok')} % 64 AS b FROM (SELECT {id_col}, unnest({tokens('text')}) AS tok FROM {src})) GROUP BY ALL"""


ORACLE["user_encoder_topk"] = f"""WITH pv AS ({_hash_vec('documents', 'doc_id')}), cv AS ({_hash_vec('benchmark', 'item_id')}),
pn AS (SELECT id, sqrt(sum(c * c)) AS n FROM pv GROUP BY id), cn AS (SELECT id, sqrt(sum(c * c)) AS n FROM cv GROUP BY id),
dt AS (SELECT p.id AS pid, c.id AS cid, sum(p.c * c.c) AS d FROM pv p JOIN cv c ON c.b = p.b GROUP BY ALL),
sc AS (SELECT d.doc_id AS input_id, b.item_id AS misinfo_id,
         coalesce(dt.d / (pn.n * cn.n), 0.0) AS score
       FROM documents d CROSS JOIN benchmark b LEFT JOIN dt ON dt.pid = d.doc_id AND dt.cid = b.item_id
       LEFT JOIN pn ON pn.id = d.doc_id LEFT JOIN cn ON cn.id = b.item_id)
SELECT input_id, misinfo_id, round(score, 6) AS confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY round(score, 9) DESC, misinfo_id) AS rank FROM sc)
WHERE rank <= 5"""

_REG = ", ".join(f"('{m}', 'similarity')" for m in
                 ["bow-cosine", "bert-base-cosine", "bert-ft-cosine", "ct-bert-cosine", "bert-score-base",
                  "bert-score-ft", "bert-score-ct", "glove-avg-cosine", "pyserini"])
_REG += ", " + ", ".join(f"('{m}', 'stance')" for m in
                         ["bow-log-snli", "bow-log-mnli", "bow-log-mednli", "boe-log-snli", "boe-log-mnli",
                          "boe-log-mednli", "bilstm-snli", "bilstm-mnli", "bilstm-mednli", "sbert-snli",
                          "sbert-mnli", "sbert-mednli", "sbert-snli-ct", "sbert-mnli-ct", "sbert-mednli-ct",
                          "sbert-fever-ct", "sbert-scifact-ct", "sbert-ann-ct", "comb-bilstm-snli",
                          "comb-bilstm-mnli", "comb-bilstm-mednli", "comb-sbert-snli-ct", "comb-sbert-mnli-ct",
                          "comb-sbert-mednli-ct", "comb-sbert-fever-ct", "comb-sbert-scifact-ct",
                          "comb-sbert-ann-ct"])


def _unpivot(sql: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT model_id, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM ({sql})"
                              for c in cols)


_RR_COLS = ["pos_hits_1", "pos_hits_5", "pos_hits_10", "pos_mrr", "both_hits_1", "both_hits_5", "both_hits_10", "both_mrr"]
_SR_COLS = ["accuracy", "macro_precision", "macro_recall", "macro_f1"] + \
    [f"{c}_{m}" for c in ("pos", "neg", "na") for m in ("precision", "recall", "f1")]


ORACLE["retrieval_report"] = _rounded(ORACLE["retrieval_report"], _RR_COLS)
ORACLE["stance_report"] = _rounded(ORACLE["stance_report"], _SR_COLS)
ORACLE["softmax_stance_report"] = _rounded(ORACLE["softmax_stance_report"], _SR_COLS)

ORACLE["all_models_report"] = f"""WITH reg(model_id, family) AS (VALUES {_REG}),
rr AS ({ORACLE['retrieval_report']}),
sr AS ({ORACLE['stance_report']}),
lf AS ({_unpivot('SELECT * FROM rr', _RR_COLS)} UNION ALL {_unpivot('SELECT * FROM sr', _SR_COLS)})
SELECT lf.model_id, reg.family, lf.metric, round(lf.value, 6) AS value FROM lf JOIN reg ON reg.model_id = lf.model_id"""

ORACLE["html_files_roundtrip"] = ORACLE["html_cards_to_claims"]
ORACLE["nli_jsonl_roundtrip"] = "WITH " + _NLI + "\nSELECT sentence1, sentence2, label FROM nlx"
ORACLE["fever_files_convert"] = ORACLE["fever_convert"]
ORACLE["scifact_files_examples"] = ORACLE["scifact_examples"]

_RAW_RR = ORACLE["retrieval_report"]
ORACLE["retrieval_report_line"] = "WITH rr AS (" + _RAW_RR + """)
SELECT model_id, concat_ws(' & ', """ + ", ".join(
    f"CAST(round_even({c}, {2 if c.endswith('mrr') else 1}) AS VARCHAR)" for c in _RR_COLS) + """) AS line FROM rr"""

ORACLE["retriever_jsonl_roundtrip"] = "SELECT *, CAST(0 AS BIGINT) AS n_answers FROM (" + ORACLE["retriever_training_set"] + ")"

ORACLE["stream_daily_events"] = """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n_events FROM events GROUP BY 1"""
ORACLE["mirrored_tree_stream"] = ORACLE["mirrored_tree_thin"]

ORACLE["user_scorer_top5"] = """WITH ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sc AS (SELECT a.vec_id, b.vec_id AS neighbor_id, -list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))) AS score
       FROM ev a JOIN ev b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT vec_id, neighbor_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, neighbor_id) AS rank FROM sc)
WHERE rank <= 5"""

ORACLE["topk_csv_roundtrip"] = f"""SELECT id, md5(pos_variation) AS variation_md5, md5(tweet) AS tweet_md5, score
FROM ({ORACLE["topk_posts_per_claim"]})"""

ORACLE["first_variation_best"] = ORACLE["best_variation_per_claim"].replace(_VARS, CLAIMS + """,
vars AS (SELECT id AS item_id, CAST(0 AS BIGINT) AS var_idx, pos_variations[1] AS line FROM claims WHERE len(pos_variations) > 0)""")

ORACLE["file_unique_counts"] = """SELECT 2 * count(DISTINCT doc_id % 8) AS n_files_listed, count(DISTINCT doc_id % 8) AS n_files_read,
  count(DISTINCT doc_id) AS n_ids, count(DISTINCT text) AS n_texts, count(DISTINCT source) AS n_users FROM documents"""

ORACLE["stream_unique_counts"] = """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n_events,
  count(DISTINCT user_id) AS n_users, true AS within_bound FROM events GROUP BY 1"""

ORACLE["resumed_requests"] = """SELECT doc_id, length(text) AS n_chars, count(*) AS n_written
FROM documents GROUP BY doc_id, length(text)"""

# a day is emitted once the watermark, an hour behind the last event, has passed its end
ORACLE["stream_weekly_users"] = """WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id FROM events
  WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)
SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, count(DISTINCT day) AS n_days, count(*) AS n_events,
  count(DISTINCT user_id) AS n_users, true AS within_bound FROM d GROUP BY 1"""

ORACLE["unique_counts_approx"] = """SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users,
  true AS within_bound FROM events GROUP BY event_type"""

_SPLIT = "WITH " + _NLI + """,
ex AS (SELECT *, concat_ws(':', conv_id, turn) AS ex_id FROM nlx),
sp AS (SELECT *, CASE WHEN (row_number() OVER (ORDER BY md5(concat_ws('|', 'nli', ex_id)), ex_id) - 1) % 4 = 3
                 THEN 'dev' ELSE 'train' END AS split FROM ex)"""

ORACLE["nli_split_sizes"] = _SPLIT + " SELECT split, label, count(*) AS n FROM sp GROUP BY ALL"

ORACLE["bow_vocabulary"] = _SPLIT + f""",
tx AS (SELECT ex_id, 'sentence1' AS side, {tokens('strip_accents(sentence1)')} AS w FROM sp WHERE split = 'train'
       UNION ALL SELECT ex_id, 'sentence2', {tokens('strip_accents(sentence2)')} FROM sp WHERE split = 'train'),
tm AS (SELECT DISTINCT ex_id, side, unnest(list_concat(w, list_transform(range(greatest(len(w) - 1, 0)),
         lambda i: w[i + 1] || ' ' || w[i + 2]))) AS term FROM tx)
SELECT side, term, count(*) AS df, round(ln(((SELECT count(*) FROM sp WHERE split = 'train') + 1.0) / (count(*) + 1)) + 1, 6) AS idf
FROM tm GROUP BY side, term HAVING count(*) >= 2"""

ORACLE["retriever_records"] = f"""WITH r AS ({ORACLE["retriever_training_set"]}),
n AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY kind = 'negative', ctx_idx, ctx_id) - 1 AS p FROM r)
SELECT question, p // 100 AS record,
  coalesce(string_agg(CAST(ctx_id AS VARCHAR), ',' ORDER BY p) FILTER (kind = 'positive'), '') AS pos_ids,
  coalesce(string_agg(CAST(ctx_id AS VARCHAR), ',' ORDER BY p) FILTER (kind = 'negative'), '') AS neg_ids,
  md5(coalesce(string_agg(md5(text), '' ORDER BY p), '')) AS texts_md5, CAST(0 AS BIGINT) AS n_empty FROM n GROUP BY 1, 2"""


def _softmax_sql(rounds: int, l2: str) -> str:
    """Rounds of ``gradient.fit_softmax`` over f(id, key, x, label, split),
    unrolled; the last state is ``s{rounds}``."""
    out = """,
tr AS MATERIALIZED (SELECT id, key, x, label FROM f WHERE split = 'train'),
q AS MATERIALIZED (SELECT count(*) AS n, 2.0 / max(q) AS rate FROM (SELECT id, sum(x * x) AS q FROM tr GROUP BY id)),
s0 AS MATERIALIZED (SELECT DISTINCT key, 0.0 AS w0, 0.0 AS w1, 0.0 AS w2, 0.0 AS y0, 0.0 AS y1, 0.0 AS y2 FROM tr)"""
    for r in range(rounds):
        def each(text: str) -> str:
            return ", ".join(text.replace("#", str(c)) for c in range(3))
        out += f""",
z{r} AS (SELECT id, any_value(label) AS label, {each('sum(x * y#) AS z#')} FROM tr JOIN s{r} USING (key) GROUP BY id),
e{r} AS MATERIALIZED (SELECT id, {each('exp(z# - greatest(z0, z1, z2)) / (exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))) - (label = #)::DOUBLE AS e#')} FROM z{r}),
g{r} AS (SELECT key, {each('sum(x * e#) AS g#')} FROM tr JOIN e{r} USING (id) GROUP BY key),
v{r} AS (SELECT key, {each('w#')}, {each(f"y# - rate * (g# / n + CASE WHEN key = '' THEN 0.0 ELSE {l2} END * y#) AS v#")}
         FROM g{r} JOIN s{r} USING (key), q),
s{r + 1} AS MATERIALIZED (SELECT key, {each('v# AS w#')}, {each(f'v# + {r + 1}.0 / {r + 4}.0 * (v# - w#) AS y#')} FROM v{r})"""
    return out


def _accuracy_sql(rounds: int) -> str:
    best = "CASE WHEN z0 >= greatest(z0, z1, z2) THEN 0 WHEN z1 >= greatest(z0, z1, z2) THEN 1 ELSE 2 END"
    return f""",
p AS (SELECT id, any_value(split) AS split, any_value(label) AS label, sum(x * coalesce(w0, 0)) AS z0,
             sum(x * coalesce(w1, 0)) AS z1, sum(x * coalesce(w2, 0)) AS z2
      FROM f LEFT JOIN s{rounds} USING (key) GROUP BY id)
SELECT split, count(*) AS n, avg(({best} = label)::DOUBLE) AS accuracy FROM p GROUP BY split"""


_BOW_TRAINED = _SPLIT + f""",
voc AS MATERIALIZED ({ORACLE["bow_vocabulary"].replace(_SPLIT + ",", "WITH").replace("round(ln(", "(ln(").replace(" + 1, 6)", " + 1)")}),
tk AS (SELECT ex_id, 'sentence1' AS side, {tokens('strip_accents(sentence1)')} AS w FROM sp
       UNION ALL SELECT ex_id, 'sentence2', {tokens('strip_accents(sentence2)')} FROM sp),
tt AS (SELECT ex_id, side, unnest(list_concat(w, list_transform(range(greatest(len(w) - 1, 0)),
         lambda i: w[i + 1] || ' ' || w[i + 2]))) AS term FROM tk),
tx2 AS (SELECT ex_id, side, term, count(*) * any_value(idf) AS x FROM tt JOIN voc USING (side, term) GROUP BY ALL),
f AS MATERIALIZED (SELECT ex_id AS id, key, x, label, split FROM (
       SELECT ex_id, side || '|' || term AS key, x / sqrt(sum(x * x) OVER (PARTITION BY ex_id, side)) AS x FROM tx2
       UNION ALL SELECT ex_id, '', 1.0 FROM sp) JOIN sp USING (ex_id))""" + _softmax_sql(12, "1.0 / n")

ORACLE["bow_logreg_accuracy"] = _BOW_TRAINED + _accuracy_sql(12)
ORACLE["bow_logreg_weights"] = _BOW_TRAINED + """
SELECT key, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM s12"""

_NLI_MEANS = _SPLIT + f""",
snt AS (SELECT ex_id || '#0' AS sid, sentence1 AS text FROM sp UNION ALL SELECT ex_id || '#1', sentence2 FROM sp),
wv AS (SELECT word, {H('word')} % (SELECT count(*) FROM embeddings) AS vec_id
       FROM (SELECT DISTINCT unnest({glove_toks('text')}) AS word FROM snt)),
ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),""" + _mean_vec("sm", "snt", "sid")

ORACLE["boe_logreg_accuracy"] = _NLI_MEANS + """,
uv AS (SELECT sp.ex_id, label, split, list_concat(a.vec, b.vec) AS v
       FROM sp JOIN sm_m a ON a.id = sp.ex_id || '#0' JOIN sm_m b ON b.id = sp.ex_id || '#1'),
f AS MATERIALIZED (SELECT ex_id AS id, CAST(i - 1 AS VARCHAR) AS key, x, label, split
       FROM (SELECT ex_id, label, split, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM uv) WHERE x <> 0
       UNION ALL SELECT ex_id, '', 1.0, label, split FROM uv)""" + _softmax_sql(8, "1.0 / n") + _accuracy_sql(8)


def _tanh_sql() -> str:
    out, last = "", "v"
    for l in range(4):
        width = 3 if l == 3 else 8
        unit = (f"list_sum(list_transform(range(len({last})), lambda i: {last}[i + 1] * sin(7.0 * i + 13.0 * j + {17 * l + 1}.0)"
                f" / sqrt(len({last})))) + cos(j + {3 * l}.0)")
        unit = unit if l == 3 else f"tanh({unit})"
        out += f""",
h{l} AS MATERIALIZED (SELECT ex_id, list(u ORDER BY j) AS h{l} FROM (SELECT ex_id, j, {unit} AS u
       FROM {'uv' if l == 0 else f'h{l - 1}'}, (SELECT unnest(range({width})) AS j)) GROUP BY ex_id)"""
        last = f"h{l}"
    return out


ORACLE["tanh_forward"] = _NLI_MEANS + """,
uv AS (SELECT sp.ex_id, list_concat(list_concat(a.vec, b.vec), list_concat(
         list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2])),
         list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2]))) AS v
       FROM sp JOIN sm_m a ON a.id = sp.ex_id || '#0' JOIN sm_m b ON b.id = sp.ex_id || '#1')""" + _tanh_sql() + """
SELECT ex_id, round(h3[1], 6) AS z0, round(h3[2], 6) AS z1, round(h3[3], 6) AS z2 FROM h3"""

ORACLE["user_stance_model"] = _SPLIT + f""",
w AS (SELECT ex_id, label, list_distinct({tokens("strip_accents(coalesce(sentence2, ''))")}) AS said,
             {tokens("strip_accents(coalesce(sentence1, ''))")} AS claim FROM sp),
sh AS (SELECT ex_id, label, CASE WHEN len(said) = 0 THEN 0.0 ELSE len(list_intersect(said, claim)) * 1.0 / len(said) END AS s FROM w)
SELECT ex_id, label, CAST(CASE WHEN s >= 0.2 THEN CASE WHEN s >= 1 - s THEN 0 ELSE 1 END
                              ELSE CASE WHEN s >= 1 - s THEN 1 ELSE 2 END END AS BIGINT) AS label_id,
       round(greatest(s, 1 - s), 6) AS confidence FROM sh"""

ORACLE["seed_yaml_roundtrip"] = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(NULL AS VARCHAR) AS misc FROM nation"

ORACLE["annotation_outputs_insert"] = ORACLE["annotation_csv_load"].split("firsts AS")[0] + """
i1 AS (SELECT tweet_id, row_number() OVER (ORDER BY min(doc_id)) AS input_id FROM r WHERE doc_id % 2 = 0 GROUP BY tweet_id),
i2 AS (SELECT tweet_id, (SELECT count(*) FROM i1) + row_number() OVER (ORDER BY min(doc_id)) AS input_id
       FROM r WHERE tweet_id NOT IN (SELECT tweet_id FROM i1) GROUP BY tweet_id),
o AS (SELECT doc_id, input_id, misconception_id AS misinfo_id,
             CASE label WHEN 'pos' THEN 0 WHEN 'neg' THEN 1 ELSE 2 END AS label_id
      FROM r JOIN (SELECT * FROM i1 UNION ALL SELECT * FROM i2) USING (tweet_id)),
o1 AS (SELECT input_id, misinfo_id, arg_min(label_id, doc_id) AS label_id, row_number() OVER (ORDER BY min(doc_id)) AS id
       FROM o WHERE doc_id % 2 = 0 GROUP BY ALL),
o2 AS (SELECT input_id, misinfo_id, arg_min(label_id, doc_id) AS label_id,
              (SELECT count(*) FROM o1) + row_number() OVER (ORDER BY min(doc_id)) AS id
       FROM o WHERE (input_id, misinfo_id) NOT IN (SELECT (input_id, misinfo_id) FROM o1) GROUP BY ALL)
SELECT CAST(0 AS INTEGER) AS load, id, input_id, misinfo_id, CAST(label_id AS BIGINT) AS label_id, 'human' AS model_id FROM o1
UNION ALL SELECT 1, id, input_id, misinfo_id, CAST(label_id AS BIGINT), 'human' FROM o2"""
