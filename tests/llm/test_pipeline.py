import re

import corpus_pipeline
from skytally.llm import decontaminate, pii
from skytally.llm.common import materialise

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), "test")
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert out.columns == docs.columns and set(after) <= set(before) and after
        gone = [r.text for i, r in before.items() if i not in after]
        if name == "near_dedup":
            sets = {i: {tuple(w[k : k + 5]) for w in [r.text.lower().split()] for k in range(max(1, len(w) - 4)) if w} for i, r in before.items()}
            near = lambda a, b: a and len(a & b) >= 0.8 * len(a | b)
            kept = list(after)
            assert not any(near(sets[i], sets[j]) for n, i in enumerate(kept) for j in kept[:n])
            assert all(any(near(sets[i], sets[j]) for j in before if j != i) for i in before if i not in after)
        elif name == "decontamination":
            items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(x in decontaminate.normal(r.text) for r in after.values() for x in items)
            assert all(any(x[:20] in decontaminate.normal(t) or x[-20:] in decontaminate.normal(t) for x in items) for t in gone)
        elif name == "pii":
            assert not gone and all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in after.values())
            assert all(before[i].text == r.text for i, r in after.items() if not re.search(r"[0-9@]", before[i].text))
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and "sequence_id" in rows.columns
