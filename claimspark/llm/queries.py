"""Registered queries of this subpackage: ``opN_<name>(spark, sf_dir)`` and,
where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import (decontam, hilbert, license_digest, mcd_quality, merkle, mixing, packing, periodic_runs,
                            semicrf_pii, simhash_tiles, substring_chain, subword_toxicity, url_trie)
from claimspark.llm.common import LOWER, UPPER, ascii_lower, table


def rank_file() -> str:
    """The vocabulary of the packing query; a parameter of the operator."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_substring_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_chain.shared_passages(table(spark, sf_dir, "documents"))


def op2_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd_quality.judge(table(spark, sf_dir, "documents"))


def op3_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), rank_file())


def op5_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_tiles.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash_tiles.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_semicrf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semicrf_pii.find_spans(table(spark, sf_dir, "documents"))


def op8_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_trie.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_trie.RULES)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan_licenses(table(spark, sf_dir, "documents"), license_digest.known_licenses(spark))


def op11_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "copies")


def plant_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where a tenth of the texts, by the CRC-32 of the id,
    goes on in a period from some word on: with n words, h = crc32 and
    g = h div 10, from word a = g mod n on with 1 + (n - a) div (3 + g mod 8)
    words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(
        "text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    rest = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), rest)), " ")
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(made).alias("text"))


def op12_lcp_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(plant_periods(table(spark, sf_dir, "documents")))
    best = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"),
                                                               r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                   F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = F.get(best, F.lit(0))
    return found.select(
        "doc_id", "n_runs", top["start"].alias("start"), (-top["l"]).alias("length"), top["period"].alias("period"),
        F.floor(-top["l"] * 1000 / top["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a later reader's copy: a third of the texts, by the CRC-32 of the id, have lost their capitals
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    seen = F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle.verify(table(spark, sf_dir, "documents"), {"text": seen})


QUERIES = {f.__name__: f for f in (
    op1_substring_chains, op2_mcd_quality, op3_subword_toxicity, op4_hierarchical_packing, op5_simhash_tiles,
    op6_hilbert_sharding, op7_semicrf_pii, op8_prefix_decontamination, op9_url_trie, op10_license_digests,
    op11_systematic_mixing, op12_lcp_runs, op13_merkle_manifest)}


def _decontam_sql(width: int = 10) -> str:
    words = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
             r"'[0-9a-z\x{80}-\x{10FFFF}]+')")
    return f"""
with d as (select doc_id, {words} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {words} as w from benchmark),
wins as (select distinct item, least(len(w), {width}) as n, array_to_string(w[i:i + least(len(w), {width}) - 1], ' ') as win
         from (select item, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from wins),
occ as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
hit as (select doc_id, i, occ.n as n, item from occ join wins using (win) where occ.n = wins.n),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
ids as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s
        from (select distinct doc_id, item from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(s, '')) as items_sha256, n_hit is not null as contaminated
from d left join pos using (doc_id) left join ids using (doc_id)"""


def _url_sql() -> str:
    rules = sorted(url_trie.RULES, key=lambda r: (-r[1].count("."), -len(r[2]), r[0] != "block"))
    when = [(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then", h + p, v) for v, h, p in rules]
    return f"""
with r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
           from pages),
u as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r)
select page_id, host, path, case {' '.join(f"{c} '{rule}'" for c, rule, _ in when)} end as rule,
       case {' '.join(f"{c} '{v}'" for c, _, v in when)} else 'allow' end as verdict from u"""


def _license_sql() -> str:
    def canonical(text: str) -> str:
        line = license_digest.COPYRIGHT_LINE.replace("(?mi)", "(?i)").replace("^", "(?m)^", 1)
        t = f"regexp_replace(lower(coalesce({text}, '')), '{line}', '', 'g')"
        t = rf"' ' || regexp_replace({t}, '[^\pL\pN]+', '  ', 'g') || ' '"
        for a, b in license_digest.SPELLINGS.items():
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"

    known = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in license_digest.KNOWN.items())
    return f"""
with k as (select sha256({canonical('t')}) as digest, min(id) as license_id from (values {known}) v(id, t) group by 1),
d as (select doc_id, {canonical('text')} as c from documents)
select doc_id, cast(length(c) as bigint) as n_canonical, sha256(c) as digest, license_id
from d left join k on sha256(c) = k.digest"""


def _mixing_sql() -> str:
    weights, cap = mixing.WEIGHTS, mixing.CAP
    weight = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    return rf"""
with d as (select doc_id, source, hash(text) as h,
                  cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as hugeint) as size from documents),
named as (select source, sum(size)::hugeint as s, row_number() over (order by source nulls last) - 1 as g from d group by 1),
g as (select *, (case g % {len(weights)} {weight} end)::hugeint as w from named),
around as (select *, (sum(s) over ())::hugeint as t,
                  (coalesce(sum({cap} * s) over (order by s / w, g rows between unbounded preceding and 1 preceding), 0))::hugeint as c,
                  (sum(w) over (order by s / w, g rows between current row and unbounded following))::hugeint as rest
           from g),
cut as (select *, {cap} * s * rest < (t - c) * w as capped from around),
tot as (select coalesce(sum({cap} * s) filter (where capped), 0)::hugeint as c, (sum(w) filter (where not capped))::hugeint as rest
        from cut),
filled as (select source, s, case when s = 0 then 0 when capped then {cap} else (t - tot.c) * w end as num,
                  case when s = 0 or capped then 1 else tot.rest * s end as den,
                  case when capped then ({cap} * s)::double else (t - tot.c)::double * w::double / tot.rest::double end as target,
                  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(source, '')), 1, 8))::bigint::hugeint as bits
           from cut, tot),
placed as (select *, row_number() over (partition by source order by size desc, doc_id nulls first, h) as r from d)
select doc_id, size::bigint as size, s::bigint as source_size, target,
       (((r * num + bits * den // 4294967296) // den - ((r - 1) * num + bits * den // 4294967296) // den) * size)::bigint as taken,
       ((r * num + bits * den // 4294967296) // den - ((r - 1) * num + bits * den // 4294967296) // den)::bigint as copies
from placed join filled on placed.source is not distinct from filled.source"""


def _merkle_sql(n_levels: int = 11) -> str:
    """Levels are unrolled; ``n_levels`` hold 8^11 leaves.  DuckDB has no
    CRC-32: it is folded bit by bit over the id's digits."""
    fan = merkle.FAN
    crc = ("list_reduce([4294967295] || [ord(c)::bigint for c in string_split(doc_id::varchar, '')], lambda acc, c: "
           "list_reduce([xor(acc, c)] || range(8), lambda b, _: xor(b >> 1, 3988292384 * (b & 1))))")

    def leaf(text: str) -> str:
        fields = [text if f == "text" else f"{f}::varchar" for f in merkle.FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({f})::varchar || ':' || {f}, '-')" for f in fields) + ")"

    def tree(name: str) -> str:
        out = ""
        for k in range(n_levels):
            run = f"partition by g, i // {fan} order by i rows between"
            out += f""",
{name}_s{k} as materialized (select g, i, coalesce(string_agg(d, '') over ({run} unbounded preceding and 1 preceding), '') as l,
         coalesce(string_agg(d, '') over ({run} 1 following and unbounded following), '') as r
         from {name}_n{k} where n > 1),
{name}_n{k + 1} as materialized (select g, (n + {fan - 1}) // {fan} as n, i // {fan} as i, sha256(string_agg(d, '' order by i)) as d
         from {name}_n{k} where n > 1 group by all union all select g, n, i, d from {name}_n{k} where n = 1)"""
        return out

    def climb(name: str, start: str, g: str, i: str) -> str:
        out, last = "", start
        for k in range(n_levels):
            out += f""",
{name}_c{k} as materialized (select c.* exclude (p, cur), p || coalesce(s.l || s.r, '') as p,
         case when s.l is null then cur else sha256(s.l || cur || s.r) end as cur
         from {last} c left join {name}_s{k} s on c.{g} = s.g and c.{i} // {fan ** k} = s.i)"""
            last = f"{name}_c{k}"
        return out

    last = f"{n_levels - 1}"
    return f"""
with docs as (select doc_id, lang, {leaf('text')} as leaf,
       {leaf(f"(case when xor({crc}, 4294967295) % 3 = 0 then translate(text, '{UPPER}', '{LOWER}') else text end)")} as seen
       from documents),
leaves as materialized (select *, dense_rank() over (order by lang nulls first) - 1 as g, count(*) over (partition by lang) as n,
       row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from docs),
a_n0 as materialized (select g, n, i, leaf as d from leaves){tree('a')},
b_n0 as materialized (select 0 as g, count(*) over () as n, g as i, d from a_n{n_levels}){tree('b')},
a_start as (select doc_id, g, i, leaf, '' as p, seen as cur from leaves){climb('a', 'a_start', 'g', 'i')},
b_start as (select c.*, 0 as z from a_c{last} c){climb('b', 'b_start', 'z', 'g')}
select doc_id, leaf, a.d as subroot, b.d as root, sha256(p) as proof_sha256, cur as folded_root, cur = b.d as verified
from b_c{last} c join a_n{n_levels} a on c.g = a.g, b_n{n_levels} b"""


ORACLE = {"op8_prefix_decontamination": _decontam_sql(), "op9_url_trie": _url_sql(),
          "op10_license_digests": _license_sql(), "op11_systematic_mixing": _mixing_sql(),
          "op13_merkle_manifest": _merkle_sql()}
