import random
import re

import pytest

from skytally.llm import url_rules
from skytally.llm.url_rules import HOST_RULES, PATTERN_RULES, PatternRule, judge


def test_sql(spark, tables, duck, same):
    same(judge(spark.read.parquet(f"{tables}/pages.parquet")), duck, url_rules.ORACLE_SQL)


URLS = [
    "http://a.example.com/en/7x", "https://EXAMPLE.com/en/1?x=/de/", "http://com/en/", "http://xcom/en/", "http://b.example.net/de/81", "http://b.example.net/de/9#a/b", "http://x.org/es/", "http://x.org/es", None, "",
    "no scheme", "//x.org/es/", "http://blog.cheap-pills.example.net/en/2", "http://x.io/?utm_source=spam", "http://x.io/?utm_source=spammy", "http://x.io:80/wp-content/uploads/a.exe", "a://b://c.com/en/", "http://?q", "http://x.io\n/en/",
]


def brute(url):
    m = re.search(r"(?s)^.*?://(.*)$", url or "")
    rest = m[1] if m else ""
    host = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    fits = [r for r in HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    hit = next((p for p in PATTERN_RULES if re.search(p.pattern, (url or "").translate(url_rules._LOWERED))), None)
    return host, path, None, hit.verdict if hit else "allow"


def test_brute_force(spark):
    rows = judge(spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, rule string, host string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {k: brute(u) for k, u in enumerate(URLS)}


def test_expected_verdicts(spark):
    rows = judge(spark.createDataFrame(list(enumerate(URLS[:8])), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("com/en/", "block"), (None, "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow")]


def test_rarest_token_and_bad_rules(spark):
    pages = spark.createDataFrame([(k, "http://a.b/common") for k in range(5)] + [(9, "http://a.b/common/rare")], "page_id long, url string")
    rule = PatternRule("block", "common/rare", ("common", "rare"))
    counts = url_rules.token_counts(pages, [rule])
    assert counts == {"common": 6, "rare": 1}
    assert list(url_rules.Index((), [rule], counts).patterns) == ["rare"]
    assert judge(pages, (), [rule]).where("verdict = 'block'").count() == 1
    with pytest.raises(ValueError):
        judge(pages, (), [PatternRule("block", "x", ())])
    assert judge(pages.limit(0)).count() == 0


def many_rules(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(2, 4)))
    hosts = list({(h, p): url_rules.HostRule(rng.choice(["block", "allow"]), h, p) for _ in range(800) if (h := ".".join(word() for _ in range(rng.randint(1, 2)))) and (p := "/" + word()[: rng.randint(0, 3)])}.values())
    patterns = []
    for _ in range(10_000):
        a, b = word(), word()
        patterns.append(PatternRule(rng.choice(["block", "allow"]), rf"(^|[^a-z0-9]){a}[^a-z0-9](.*[^a-z0-9])?{b}($|[^a-z0-9])", (a, b)))
    urls = [f"http://{word()}.{word()}/{word()}/{word()}-{word()}?{word()}={word()}" for _ in range(150)] + ["http://ab.cd/ef"] * 40 + URLS
    return hosts, patterns, urls


def test_ten_thousand_pattern_rules(spark, monkeypatch):
    """Sent to the tasks and joined: the same as trying every rule on every URL."""
    hosts, patterns, urls = many_rules(4)
    tried = [(p, re.compile(p.pattern)) for p in patterns]

    def force(url):
        host, path, *_ = brute(url)
        fits = [r for r in hosts if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        if fits:
            best = max(fits, key=lambda r: (len(r.name), r.verdict, r.name))
            return best.name, best.verdict, None
        hit = next((p for p, e in tried if e.search((url or "").translate(url_rules._LOWERED))), None)
        return None, hit.verdict if hit else "allow", hit.pattern if hit else None

    want = {k: force(u) for k, u in enumerate(urls)}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = lambda: {r.page_id: (r.rule, r.verdict, r.pattern) for r in judge(pages, hosts, patterns).collect()}
    assert got() == want
    monkeypatch.setattr(url_rules, "MOST_RULES", 100)
    assert got() == want and {v for _, v, _ in want.values()} == {"block", "allow"}


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"verdict": "block", "host": "b.c"}\n{"verdict": "allow", "host": "b.c", "path": "/ok"}\n{"rank": 1, "verdict": "block", "pattern": "/x1/", "tokens": ["x1"]}\n')
    pages = spark.createDataFrame([(1, "http://a.b.c/n"), (2, "http://b.c/ok"), (3, "http://d/x1/"), (4, "http://d/x12/")], "page_id long, url string")
    rows = url_rules.judge_table(pages, *url_rules.read_rules(spark, f"file://{tmp_path}/r.json")).orderBy("page_id").collect()
    assert [r.verdict for r in rows] == ["block", "allow", "block", "allow"]


@pytest.mark.parametrize("most", [200_000, 0])
def test_odd_rules_are_one_whatever_their_number(spark, monkeypatch, most):
    """Rules without a rank come last, ties go by pattern and verdict, expressions are Python's, A-Z alone are lowered."""
    monkeypatch.setattr(url_rules, "MOST_RULES", most)
    hosts = spark.createDataFrame([("block", "b.c", "/"), ("allow", "", "/")], url_rules.HOSTS)
    rows = [(None, "block", "/a1/", ["a1"]), (7, "allow", "/a1/", ["a1"]), (None, "allow", "k2", ["k2"]), (3, "block", "z3", ["z3"]), (3, "allow", "z3", ["z3"]), (1, "block", r"(?P<x>q4)/(?P=x)", ["q4"]), (2, "block", "\u212a|5e", ["5e"])]
    rules = spark.createDataFrame(rows, url_rules.PATTERNS)
    urls = ["http://x/a1/", "http://x/K2", "http://x/z3", "http://x/q4/q4", "http://x/q4/q5", "http://b.c./x", "http://a.b.c/", "http://x./a1/", "http://x/\u212a", "http://x/5e", None, "A1/a1/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict, r.pattern) for r in url_rules.judge_table(pages, hosts, rules).collect()}
    want = [(None, "allow", "/a1/"), (None, "allow", "k2"), (None, "allow", "z3"), (None, "block", r"(?P<x>q4)/(?P=x)"), (None, "allow", None), (None, "allow", None), ("b.c/", "block", None), (None, "allow", "/a1/"), (None, "allow", None), (None, "block", "\u212a|5e"), (None, "allow", None), (None, "allow", "/a1/")]
    assert found == dict(enumerate(want))
    for bad in ((1, "block", "x", []), (1, "block", "x", None), (1, "block", "x", ["X"]), (1, "block", None, ["x"])):
        with pytest.raises(ValueError):
            url_rules.judge_table(pages, hosts, spark.createDataFrame([*rows, bad], url_rules.PATTERNS)).collect()
