"""Personal data by regime, digests, temporal formulas, cases and causal edges by brute force."""

import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from skytally.functions import dialect
from skytally.operators import casework, formal, governance, graph, intake, privacy, studies
from skytally.sources.telemetry import load


def plain(text, regime):
    """The same replacements with Python's expressions, one match after the other."""
    for kind in privacy.REGIMES[regime]:
        found = dict.fromkeys(m[0] for m in re.finditer(privacy.PATTERNS[kind], text, re.A))
        if kind == "credit_card":
            for m in found:
                digits = [int(d) for d in re.sub(r"\D", "", m)][::-1]
                if sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0:
                    text = text.replace(m, "[REDACTED_CREDIT_CARD]")
        else:
            text = re.sub(privacy.PATTERNS[kind], f"[REDACTED_{kind.upper()}]", text, flags=re.A)
    return text


TEXTS = [
    "mail a.b@c.org or +44 20 7946 0958, card 4111 1111 1111 1111 and 4111 1111 1111 1112", "ssn 123-45-6789, not 000-12-3456, ip 10.0.0.255 and 300.1.1.1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "DE89370400440532013000 born 1990-02-03 or 03/02/1990",
    "943 476 5919 with J18.9 and Z23", "", "nothing here", "call 555-123-4567 now",
]


@pytest.mark.parametrize("regime", sorted(privacy.REGIMES))
def test_redaction_by_regime(spark, tables, regime):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").limit(60).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", privacy.redacted(F.col("t"), regime).alias("r")).collect()
    assert {r.k: r.r for r in rows} == {k: plain(t, regime) for k, t in enumerate(texts)}


def test_pseudonyms_names_and_unknown_regimes(spark):
    row = spark.createDataFrame([("x a@b.org y",)], "t string").select(privacy.redacted(F.col("t"), pseudonym=True).alias("r")).first()
    assert row.r == f"x [PSEUDO:{hashlib.sha256(b'a@b.org').hexdigest()[:16]}] y"
    assert privacy.signalled(["email", "Mobile_no", "user", "nhs", "date_of_birth"]) == {"email": "email", "Mobile_no": "phone", "nhs": "nhs", "date_of_birth": "dob"}
    rows = privacy.protected(spark.createDataFrame([("me", "a@b.org", " ", 1), (None, None, None, 2)], "email string, note string, phone string, n int")).orderBy("n").collect()
    assert [tuple(r) for r in rows] == [("[REDACTED]", "[REDACTED_EMAIL]", " ", 1), (None, None, None, 2)]
    with pytest.raises(ValueError):
        privacy.redacted(F.lit("x"), "none")


def test_digests_and_keyed_hashes(spark):
    rows = spark.createDataFrame([(1, "fn-é")], "event_id long, function_id string")
    row = privacy.digests(rows).first()
    assert all(row[a] == hashlib.new(a, "fn-é".encode()).hexdigest() for a in ("md5", "sha1", "sha256", "sha512", "blake2b"))
    text = dialect.fill("<hmac:function_id>", dialect.SPARK)
    assert rows.selectExpr(f"{text} AS h").first().h == privacy.signature("fn-é", dialect.KEY)
    assert rows.select(privacy.keyed_blake2b(b"k")("function_id").alias("h")).first().h == hashlib.blake2b("fn-é".encode(), key=b"k").hexdigest()
    long = dialect.pads(b"x" * 100)
    assert long == dialect.pads(hashlib.sha256(b"x" * 100).digest())


def test_cleaning(spark):
    row = spark.createDataFrame([("/a/../b//./c\\d", "\ufb01\u2460", "a & b; c")], "p string, t string, s string").select(governance.clean_path(F.col("p")).alias("p"), governance.nfkc("t").alias("t"), governance.sanitise(F.col("s")).alias("s")).first()
    assert row.p == "a/b/c/d" and row.t == unicodedata.normalize("NFKC", "\ufb01\u2460") and row.s == "a  b c"


def holds(f, trace, k):
    """A formula at a place of a finite trace, by its meaning."""
    if callable(f):
        return f(trace[k])
    op, *parts = f
    at = lambda g, j: holds(g, trace, j)
    rest = range(k, len(trace))
    return {
        "not": lambda: not at(parts[0], k), "and": lambda: at(parts[0], k) and at(parts[1], k), "or": lambda: at(parts[0], k) or at(parts[1], k), "implies": lambda: not at(parts[0], k) or at(parts[1], k),
        "next": lambda: k + 1 < len(trace) and at(parts[0], k + 1), "always": lambda: all(at(parts[0], j) for j in rest), "eventually": lambda: any(at(parts[0], j) for j in rest),
        "until": lambda: any(at(parts[1], j) and all(at(parts[0], i) for i in range(k, j)) for j in rest),
    }[op]()


def test_formulas_by_their_meaning(spark):
    rng = random.Random(7)
    p, q = ("cpu > 50", lambda r: r[2] > 50), ("duration > 1", lambda r: r[3] > 1)

    def formula(depth):
        if not depth:
            return rng.choice([p, q])
        op = rng.choice(["not", "and", "or", "implies", "next", "always", "eventually", "until"])
        parts = [formula(depth - 1) for _ in range(2 if op in ("and", "or", "implies", "until") else 1)]
        return tuple([op, *(x[0] for x in parts)]), tuple([op, *(x[1] for x in parts)])

    made = {f"f{k}": formula(3) for k in range(25)}
    rows = [(k, f"t{k % 6}", float(rng.randrange(100)), float(rng.randrange(3))) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id long, function_id string, cpu double, duration double")
    got = {r.function_id: r for r in formal.properties(df, {n: f for n, (f, _) in made.items()}).collect()}
    for t in got:
        trace = sorted(r for r in rows if r[1] == t)
        assert {n: got[t][n] for n in made} == {n: holds(f, trace, 0) for n, (_, f) in made.items()}
    with pytest.raises(ValueError):
        formal.compiled({"x": ("maybe", "true")})


def test_causal_strengths_by_brute_force(spark, tables):
    rows = load(spark, tables).collect()
    want = set()
    for a in rows:
        for b in rows:
            gap = b.t_us - a.t_us
            if a.function_id == b.function_id and 0 < gap <= 300_000_000:
                odd = a.anomaly_type != "benign"
                s = 0.3 * (1 - gap / 3e8) + 0.12 + 0.1 * (0.7 if odd and b.anomaly_type != "benign" else 0.3 if odd else 0)
                if s >= 0.3:
                    want.add((a.event_id, b.event_id))
    assert {(r.source, r.target) for r in studies.run(graph.STRENGTHS, load(spark, tables)).collect()} == want


def test_suspicious_paths_follow_the_strongest(spark):
    rows = [(k, "f", k * 20_000_000, "error", "execution_failure", 1.0, 100.0, 5.0, 7.0, True) for k in range(20)]
    df = spark.createDataFrame(rows, "event_id long, function_id string, t_us long, phase string, anomaly_type string, duration double, memory double, cpu double, network double, truth boolean")
    got = {r.start: r.length for r in graph.suspicious_paths(df).collect()}
    assert got[0] == 15 and got[10] == 10 and 19 not in got
    assert graph.clusters(df).agg(F.sum("n")).first()[0] == 20 and graph.clusters(df.limit(0)).count() == 0


def test_cases_and_views(spark):
    rows = [(k, "f", k * 1000, "review" if k % 2 else "observe", 0.1 * (k % 5), "x") for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, function_id string, t_us long, decision string, fused_score double, anomaly_type string")
    (case,) = casework.run(casework.CASES, df).collect()
    told = [k for k in range(40) if k % 2]
    status = {0: "triage", 1: "contained", 2: "closed", 3: "open"}[[k for k in told if k % 5 == 0][-1] % 4]
    assert case.n_detections == sum(k % 7 > 0 for k in told) and case.status == status and case.severity == "review"
    assert casework.apply_view(df, {"decision": "review", "min_score": 0.35, "since_us": 5000, "until_us": 30_000}).count() == sum(k % 2 == 1 and 0.1 * (k % 5) >= 0.35 and 5 <= k < 30 for k in range(40))
    with pytest.raises(ValueError):
        casework.apply_view(df, {"colour": "red"})


def test_empty_tables(spark, tables):
    empty = load(spark, tables).limit(0)
    for text in (intake.ADAPTED, intake.CHECKED, intake.SIGNED, intake.PRESERVED, intake.CONTEXT, intake.INFERRED, intake.ROUTED, studies.ATTACKS, studies.CHANGES, studies.FINGERPRINTS, graph.STRENGTHS, graph.CORRELATIONS):
        assert studies.run(text, empty).count() == 0
