from pyspark.sql import functions as F

from skytally.operators import analyst, governance
from skytally.sources import telemetry


def test_sanitise_and_redact(spark):
    text = "a​<script>x()</script> <b>\"q\"</b> mail x.y@z.com ip 1.2.3.4 card 4111111111111111 tel +1 (222) 333-4444"
    row = spark.createDataFrame([(text,)], "t string").select(governance.sanitise(F.col("t")).alias("s"), governance.redact(F.col("t")).alias("r")).first()
    assert "script" not in row.s and "​" not in row.s and "&lt;b&gt;" in row.s and "&quot;q&quot;" in row.s
    assert all(f"[REDACTED_{k}]" in row.r for k, _ in governance.PATTERNS)


def test_urls(spark):
    rows = spark.createDataFrame([("https://u:p@a.org/x",), ("javascript:1",), (None,)], "u string").select(governance.clean_url(F.col("u")).alias("u")).collect()
    assert [r.u for r in rows] == ["https://a.org/x", None, None]


def test_preserved(spark):
    cols = "event_id long, duration double, memory double, cpu double, network double, phase string, function_id string"
    a = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0, "invoke", "f"), (2, 1.0, 2.0, 3.0, 4.0, "init", None)], cols)
    b = spark.createDataFrame([(1, 1.0, 2.5, 3.0, 4.0, "invoke", "f"), (2, 1.0, 2.0, 3.0, 4.0, "init", None)], cols)
    rows = {r.event_id: r for r in governance.preserved(a, b).collect()}
    assert rows[1].at_risk == ["memory"] and rows[1].score == 0.8333 and rows[2].score == 1.0


def test_audit_chain_finds_changes(spark):
    rows = spark.createDataFrame([("a", k, k, f"p{k}") for k in range(6)] + [("b", k, k, f"q{k}") for k in range(3)], "actor string, ts long, id long, payload string")
    chain = analyst.audit_chain(rows)
    assert analyst.broken_links(chain).count() == 0
    bad = chain.withColumn("payload", F.when((F.col("actor") == "a") & (F.col("id") == 3), F.lit("x")).otherwise(F.col("payload")))
    row = analyst.broken_links(bad).collect()
    # The stored hash of row 3 no longer follows from its payload; row 4 still follows from that stored hash.
    assert [(r.actor, r.first_broken, r.n_broken) for r in row] == [("a", 3, 1)]
    # Whoever forges row 3's hash too breaks row 4, and so on to the end of the chain.
    forged = bad.withColumn("row_hash", F.when((F.col("actor") == "a") & (F.col("id") == 3), F.sha2(F.concat_ws("|", "prev_hash", "payload"), 256)).otherwise(F.col("row_hash")))
    assert [(r.actor, r.first_broken, r.n_broken) for r in analyst.broken_links(forged).collect()] == [("a", 4, 1)]
    gone = analyst.broken_links(chain.where("NOT (actor = 'b' AND id = 1)")).collect()
    assert [(r.actor, r.first_broken) for r in gone] == [("b", 2)]


def test_audit_chain_hashes_the_row_before(spark):
    import hashlib

    rows = spark.createDataFrame([("a", k, k, f"p{k}") for k in range(50)], "actor string, ts long, id long, payload string").repartition(4)
    last = ""
    for r in analyst.audit_chain(rows).orderBy("id").collect():
        assert r.prev_hash == last
        last = hashlib.sha256(f"{last}|{r.payload}".encode()).hexdigest()
        assert r.row_hash == last


def test_cases(spark):
    events = spark.createDataFrame([("c", 1, "open", None, None), ("c", 2, "open", 7, "attach"), ("c", 3, "triage", 8, "attach"), ("c", 4, "triage", 7, "detach")], "case_id string, version int, status string, detection_id long, change string")
    row = analyst.case_state(events).first()
    assert (row.status, row.version, row.n_detections) == ("triage", 4, 1)


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    for kind in ("json", "parquet", "orc", "csv"):
        path = f"file://{tmp_path}/{kind}"
        telemetry.write_rows(rows, path, kind)
        back = telemetry.read_events(spark, path, kind, "id long, s string")
        assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]
