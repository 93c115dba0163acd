"""Hard rows for every operator and stage: control characters, long runs of digits, long texts, nulls, repeated rows, clashing names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skytally.llm import decontaminate, licenses, near_dedup, packing, pii, quality_pu, quality_rules, toxicity, url_rules, warc

SF = "/root/testdata/sf0.001"
CLASHING = (
    "gone_id", "pii_spans", "toxicity_score", "score", "component_id", "component", "node", "ids", "parts", "level", "passed", "stratum", "t", "w", "s", "a", "b", "i", "label", "x", "n_words", "kept", "start",
    "end", "length", "item_id", "edits", "sequence_id", "spans", "fp", "sketch", "home", "key", "salt", "payload", "refers_to", "rule", "verdict", "host", "odd name`",
)


def texts():
    rng = random.Random(6)
    noise = ["".join(chr(rng.choice([rng.randrange(1, 32), rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x1F300, 0x1F600)])) for _ in range(rng.randrange(80))) for _ in range(40)]
    hard = [
        None, "", " ", "\n\n", "\x00", "\x01", "\x02", "a\x02b \x02 c\x01\x02d", "\x02" * 300, "0" * 5000 + ".1.1.1", "1" * 6000, "9 8 7 " * 300, "+1" * 900, "@" * 3000, "a@b" * 800, "x" * 200_000, "word " * 200_000,
        "[at] " * 200, "(" * 2000, "4111 1111 1111 1111 " * 40, "\u0130\u1e9e\ufb01 \u2028 \u00a0x\u3000y", "<|endoftext|>" * 20, "\r\n\x0b\x0c\r", "http://" * 60, "MIT License\n" * 60, ".!? " * 400, "a b c d e f g h i j k " * 2, "a b c d e f g h i j k " * 2,
    ]
    return hard + noise + noise[:5]


@pytest.fixture(scope="module")
def hard(docs_of):
    values = texts()
    ids = [None if k % 23 == 7 else k // 2 if k % 11 == 3 else k for k in range(len(values))]
    docs = docs_of(values, ids)
    return docs.withColumns({c: F.lit(f"clash {c}") for c in CLASHING}).repartition(4)


def rows_of(df):
    return Counter(map(repr, df.select("doc_id", "text", *CLASHING[:5], "`odd name```").collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, hard, name, stage):
    out = stage(spark, hard, SF)
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in hard.select("doc_id").collect()}
        assert stage(spark, hard.limit(0), SF).count() == 0
        return
    assert out.columns == hard.columns
    before, after = Counter(r.doc_id for r in hard.select("doc_id").collect()), Counter(r.doc_id for r in out.select("doc_id").collect())
    assert after <= before and after[None] >= 1
    if name == "pii":
        assert after == before
    else:
        assert rows_of(out) <= rows_of(hard)
    assert stage(spark, hard.limit(0), SF).columns == hard.columns and stage(spark, hard.limit(0), SF).count() == 0


def test_operators_keep_every_row(spark, hard):
    n = hard.count()
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(80)] + [(None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    net = toxicity.train([("a vile\x02 word \x02" if k % 2 else "a clean\x01 word", k % 2) for k in range(60)], rounds=2)
    slim = hard.drop("score")
    assert toxicity.score(slim, net).where("score BETWEEN 0 AND 1").count() == n and toxicity.fitted(hard, labels) is not None
    made = quality_pu.fitted(hard, labels)
    assert quality_pu.score(slim, made[0]).where("score BETWEEN 0 AND 1").count() == n
    assert pii.report(hard).count() == n and quality_rules.judge(hard, labels, stratum=F.col("lang")).count() == n and licenses.scan(hard).count() == n
    rows = near_dedup.near_duplicates(hard, words=2).collect()
    assert len(rows) == n and all(r.kept for r in rows if r.n_shingles == 0)
    bench = hard.select(F.col("doc_id").alias("key"), F.col("text").alias("words")).withColumns({"item_id": F.lit(1), "text": F.lit("no")})
    found = decontaminate.contaminated(hard, bench.drop("item_id", "text"), item_col="key", item_text_col="words")
    held = {r.doc_id for r in found.collect()}
    assert {r.doc_id for r in hard.where("length(trim(text)) > 60 AND doc_id IS NOT NULL").select("doc_id").collect() if r.doc_id is not None} & held
    pages = hard.drop("host", "rule", "verdict").select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"), *CLASHING[:30])
    assert url_rules.judge(pages).count() == n
    assert warc.page_report(warc.assemble(warc.read_archives(spark, warc.write_archives(pages)))).where("payload_bytes IS NOT NULL").count() == n
    assert packing.pack(hard).agg(F.sum("length")).first()[0] == packing.pack(hard.repartition(7)).agg(F.sum("length")).first()[0]
