"""The pipeline stage by stage against brute force, and edge rows."""

import corpus_pipeline
import pytest
from test_operators_llm import brute_components, brute_hits, brute_simhash, check_packing

from claimspark.llm import semicrf_pii, subword_toxicity
from claimspark.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        now = docs.collect()
        seen.append(name)
        if name == "toxicity":
            scores = subword_toxicity.judge(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
            assert {r.doc_id for r in now} == {r.doc_id for r in scores if not r.predicted}
        elif name == "near_duplicates":
            pairs = [(d, brute_simhash(r.text)) for d, r in before.items()]
            assert {r.doc_id for r in now} == set(brute_components(pairs).values())
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            assert {r.doc_id for r in now} == {d for d, r in before.items() if not brute_hits(r.text, items)[4]}
        elif name == "personal_data":
            assert {r.doc_id for r in now} == set(before)
            assert not any(semicrf_pii.base_spans(r.text) for r in now)
            assert all(r.text == before[r.doc_id].text or semicrf_pii.base_spans(before[r.doc_id].text) for r in now)
        else:
            check_packing(now, {d: r.text for d, r in before.items()})
        if name != "packing":
            assert docs.columns == columns
            before = {r.doc_id: r for r in now}
    assert len(seen) == 5


@pytest.mark.parametrize("n", [0, 1])
def test_edge_documents(spark, tmp_path, n):
    """Empty documents; null rows, repeats, an extra column that clashes."""
    for name in ("labels", "benchmark"):
        table(spark, SF, name).limit(0 if n == 0 else 5).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = [(None, None, None, None, None, 1.0), (1, "", "en", "s", 0, 2.0), (2, "a b c", "en", None, 5, 3.0),
            (2, "a b c", "en", None, 5, 3.0), (3, "a b c", None, "s", 5, None)] * n
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
    assert sorted({r.doc_id for r in docs.collect()}) == [1, 2] * n
