"""URL filtering: host/path rules, and pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression with the literal tokens that any URL it fits must contain. How many URLs hold each of
these tokens is counted over the whole table; each rule is filed under its rarest one. A URL is cut into tokens, its tokens
fetch the candidate rules, and only their expressions run. Up to ``MOST_RULES`` rules are sent to the tasks; a larger table of rules
is joined to the URLs by host and by rarest token. Both ways check the rules alike, order them alike (by rank, those without one last,
then by pattern and verdict), lower A-Z alone and run Python's expressions, so the number of rules changes no verdict.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest fitting rule wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is searched in the URL with A-Z lower-cased; ``tokens`` are whole tokens that every fitting URL holds (see ``tokens_of``)."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]


HOST_RULES = (
    HostRule("block", "com", "/en/"),
    HostRule("allow", "example.com", "/en/7"),
    HostRule("allow", "net", "/de/"),
    HostRule("block", "example.net", "/de/8"),
    HostRule("block", "org", "/es/"),
)
PATTERN_RULES = (
    PatternRule("block", r"://([^/?#]*\.)?(cheap|discount)-pills\.", ("pills",)),
    PatternRule("block", r"://([^/?#]*[.-])?casino[.-]", ("casino",)),
    PatternRule("block", r"://([^/?#]*[.-])?poker[.-]", ("poker",)),
    PatternRule("block", r"://([^/?#]*[.-])?porn[.-]", ("porn",)),
    PatternRule("block", r"://([^/?#]*\.)?free-downloads?\.", ("free",)),
    PatternRule("block", r"/wp-content/uploads/.*\.(exe|zip)([?#]|$)", ("wp", "content", "uploads")),
    PatternRule("block", r"[?&]aff_id=[0-9]+", ("aff", "id")),
    PatternRule("block", r"[?&]utm_source=spam(&|#|$)", ("utm", "source", "spam")),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)
#: More rules than this aren't sent to the tasks but joined.
MOST_RULES = 200_000
HOSTS, PATTERNS = "verdict string, host string, path string", "rank long, verdict string, pattern string, tokens array<string>"


def tokens_of(url: str) -> list[str]:
    """Runs of a-z and 0-9."""
    return re.findall(r"[a-z0-9]+", url)


def check_tokens(verdict: str | None, pattern: str | None, tokens: Sequence[str] | None) -> None:
    if verdict is None or pattern is None or not tokens or any(t is None or tokens_of(t) != [t] for t in tokens):
        raise ValueError(f"pattern rules need a verdict, a pattern and tokens of a-z and 0-9: {verdict}, {pattern}, {tokens}")
    re.compile(pattern)


class Index:
    """Host rules by host, pattern rules by their rarest token; URLs with few rule tokens run few expressions."""

    def __init__(self, hosts: Sequence[HostRule], patterns: Sequence[PatternRule], counts: dict[str, int]):
        self.hosts: dict[str, list[HostRule]] = defaultdict(list)
        for r in hosts:
            self.hosts[r.host].append(r)
        self.patterns: dict[str, list[tuple[int, PatternRule, re.Pattern]]] = defaultdict(list)
        for k, p in enumerate(patterns):
            rarest = min(p.tokens, key=lambda t: (counts.get(t, 0), t))
            self.patterns[rarest].append((k, p, re.compile(p.pattern)))

    def host_rule(self, host: str, path: str) -> HostRule | None:
        best, name = None, host
        while name:
            for r in self.hosts.get(name, ()):
                if path.startswith(r.path) and (best is None or (len(r.name), r.verdict, r.name) > (len(best.name), best.verdict, best.name)):
                    best = r
            name = name.partition(".")[2]
        return best

    def pattern_rule(self, url: str) -> PatternRule | None:
        """The first rule in the given order that fits."""
        found = {k: (p, e) for t in set(tokens_of(url)) for k, p, e in self.patterns.get(t, ())}
        return next((found[k][0] for k in sorted(found) if found[k][1].search(url)), None)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path, as text; both empty where the URL is null or has no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(pages: DataFrame, patterns: Sequence[PatternRule], url_col: str = "url") -> dict[str, int]:
    """How many URLs of the table hold each token that a rule names: as many numbers as the rules have tokens."""
    names = sorted({t for p in patterns for t in p.tokens})
    if not names:
        return {}
    found = F.array_intersect(F.split(F.translate(F.col(url_col), UPPER, LOWER), "[^a-z0-9]+"), F.array(*map(F.lit, names)))
    rows = pages.select(F.explode(found).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def judge(
    pages: DataFrame,
    hosts: Sequence[HostRule] = HOST_RULES,
    patterns: Sequence[PatternRule] = PATTERN_RULES,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pattern.

    A fitting host rule decides; else the first fitting pattern rule (``pattern``); else the verdict is allow. Null and
    malformed URLs have an empty host and path and no rule; patterns still search malformed ones. Repeated rows and null ids
    keep their rows; other columns are ignored; the work is one pass without a shuffle, besides counting the rules' tokens.
    """
    for p in patterns:
        check_tokens(p.verdict, p.pattern, p.tokens)
    if len(hosts) + len(patterns) > MOST_RULES:
        spark = pages.sparkSession
        made = spark.createDataFrame([(r.verdict, r.host, r.path) for r in hosts], HOSTS), spark.createDataFrame([(k, p.verdict, p.pattern, list(p.tokens)) for k, p in enumerate(patterns)], PATTERNS)
        return judge_by_joins(pages, *made, id_col=id_col, url_col=url_col)
    counts = token_counts(pages, patterns, url_col)
    hosts, patterns = tuple(hosts), tuple(patterns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(hosts, patterns, counts)
        for batch in batches:
            ids, urls, names, paths = batch.columns
            out = []
            for url, host, path in zip(urls.to_pylist(), names.to_pylist(), paths.to_pylist(), strict=True):
                r = index.host_rule(host, path)
                p = None if r else index.pattern_rule((url or "").translate(_LOWERED))
                out.append((r.name if r else None, r.verdict if r else p.verdict if p else "allow", p.pattern if p else None))
            more = [pa.array([x[k] for x in out], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([ids, names, paths, *more], ["page_id", "host", "path", "rule", "verdict", "pattern"])

    host, path = split_url(F.col(url_col))
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    return slim.mapInArrow(work, "page_id long, host string, path string, rule string, verdict string, pattern string")


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Host rules and pattern rules from JSON lines: {"verdict", "host", "path"} or {"rank", "verdict", "pattern", "tokens"}."""
    rows = spark.read.schema(f"{HOSTS}, rank long, pattern string, tokens array<string>").json(path)
    return rows.where("host IS NOT NULL").select("verdict", "host", F.coalesce("path", F.lit("/")).alias("path")), rows.where("pattern IS NOT NULL").select("rank", "verdict", "pattern", "tokens")


def judge_table(pages: DataFrame, hosts: DataFrame, patterns: DataFrame, **more: str) -> DataFrame:
    """``judge`` with rules from tables (see ``read_rules``): sent to the tasks if they are few, else joined."""
    n = hosts.limit(MOST_RULES + 1).count() + patterns.limit(MOST_RULES + 1).count()
    if n > MOST_RULES:
        return judge_by_joins(pages, hosts, patterns, **more)
    rows = patterns.collect()
    for r in rows:
        check_tokens(r.verdict, r.pattern, r.tokens)
    some = [PatternRule(r.verdict, r.pattern, tuple(r.tokens)) for r in sorted(rows, key=lambda r: (r["rank"] is None, r["rank"], r.pattern, r.verdict))]
    return judge(pages, [HostRule(r.verdict, r.host, r.path) for r in hosts.collect()], some, **more)


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (url, low, rank, pattern, verdict) those whose expression is found in the lowered URL."""
    compiled = lru_cache(10_000)(re.compile)
    for batch in batches:
        fits = [compiled(p).search(u) is not None for u, p in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.filter(pa.array(fits, pa.bool_())).select(["url", "rank", "pattern", "verdict"])


def judge_by_joins(pages: DataFrame, hosts: DataFrame, patterns: DataFrame, *, id_col: str = "page_id", url_col: str = "url", salts: int = 16) -> DataFrame:
    """``judge`` for any number of rules (tables of ``HOSTS`` and ``PATTERNS``).

    Distinct URLs are judged and joined back. A URL's host suffixes meet the host rules, the longest that fits wins; its tokens meet
    the pattern rules filed under their rarest token, and of those whose expression fits the first by rank wins. A common suffix or
    token is dealt over ``salts`` parts, to each of which its few rules are copied.
    """
    odd = F.coalesce(F.size("tokens") < 1, F.lit(True)) | F.exists("tokens", lambda t: t.isNull() | ~t.rlike("^[a-z0-9]+\\z"))
    for r in patterns.where(odd | F.col("verdict").isNull() | F.col("pattern").isNull()).limit(1).collect():
        check_tokens(r.verdict, r.pattern, r.tokens)
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    urls = slim.where("url IS NOT NULL").select("url").distinct().withColumns({"salt": F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int"), "low": F.translate("url", UPPER, LOWER)})
    named = urls.withColumns(dict(zip(("host", "path"), split_url(F.col("url")), strict=True)))
    copies = lambda rules: rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    by_host = named.where("host <> ''").select("url", "salt", "path", F.explode(suffixes).alias("suffix")).where("suffix <> ''")
    own = copies(hosts.select("verdict", F.col("host").alias("suffix"), F.col("path").alias("start")))
    fits = by_host.join(own, ["suffix", "salt"]).where(F.startswith("path", "start"))
    rule = fits.groupBy("url").agg(F.max(F.struct(F.length(F.concat("suffix", "start")).alias("size"), F.col("verdict"), F.concat("suffix", "start").alias("rule"))).alias("best"))
    tokens = urls.select("url", "salt", "low", F.explode(F.array_distinct(F.array_remove(F.split("low", "[^a-z0-9]+"), ""))).alias("token"))
    filed = patterns.select("rank", "verdict", "pattern", F.explode("tokens").alias("token"))
    held = tokens.join(filed.select("token").distinct().hint("shuffle_hash"), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = filed.join(held, "token", "left").groupBy("rank", "verdict", "pattern").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    hits = tokens.join(copies(rarest), ["token", "salt"]).select("url", "low", "rank", "pattern", "verdict").mapInArrow(_fitting, "url string, rank long, pattern string, verdict string")
    first = hits.groupBy("url").agg(F.min(F.struct(F.col("rank").isNull().alias("last"), "rank", "pattern", "verdict")).alias("hit"))
    judged = named.select("url").join(rule, "url", "left").join(first, "url", "left")
    out = slim.join(judged, "url", "left").withColumns(dict(zip(("host", "path"), split_url(F.col("url")), strict=True)))
    pattern = F.when(F.col("best").isNull(), F.col("hit.pattern"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(pattern.isNotNull(), F.col("hit.verdict")), F.lit("allow")).alias("verdict"), pattern.alias("pattern"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle(hosts: Sequence[HostRule] = HOST_RULES, patterns: Sequence[PatternRule] = PATTERN_RULES) -> str:
    """DuckDB SQL for ``judge`` over ``pages``."""
    longest = sorted(hosts, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    fits = lambda r: f"(host = {_quoted(r.host)} OR ends_with(host, {_quoted('.' + r.host)})) AND starts_with(path, {_quoted(r.path)})"
    rule = " ".join(f"WHEN {fits(r)} THEN {_quoted(r.name)}" for r in longest)
    verdict = " ".join(f"WHEN {_quoted(r.name)} THEN {_quoted(r.verdict)}" for r in longest)
    pattern = " ".join(f"WHEN regexp_matches(translate(url, '{UPPER}', '{LOWER}'), {_quoted(p.pattern)}) THEN {_quoted(p.pattern)}" for p in patterns)
    kinds = " ".join(f"WHEN {_quoted(p.pattern)} THEN {_quoted(p.verdict)}" for p in patterns)
    return f"""
WITH cut AS (
  SELECT page_id, url, regexp_extract(url, '^.*?://(.*)$', 1, 's') AS rest FROM pages
), parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM cut
), ruled AS (
  SELECT *, CASE {rule} END AS rule FROM parts
), matched AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL {pattern} END AS pattern FROM ruled
)
SELECT page_id, host, path, rule, pattern,
  CASE WHEN rule IS NOT NULL THEN CASE rule {verdict} END
       WHEN pattern IS NOT NULL THEN CASE pattern {kinds} END ELSE 'allow' END AS verdict
FROM matched"""


ORACLE_SQL = oracle()
