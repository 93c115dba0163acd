"""Validation rules as data: a rule names a column, what must hold of it, and how bad a breach is; all rules are one projection.

A null breaks nothing but ``required``. Values are held against types in their text form, so a text column of numbers passes as integer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

SEVERITIES = ("critical", "error", "warning", "info")
KINDS = ("required", "type", "range", "pattern", "enum", "check")
#: What a breach of each severity takes from a record's quality of 1.
COSTS = {"critical": 0.5, "error": 0.3, "warning": 0.1, "info": 0.0}
#: The last moment of a time in milliseconds. Fixed value.
LAST_TIME = 9_999_999_999_999

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"({_OCTET}[.]){{3}}{_OCTET}"
_GROUPS = "([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?"
_HEX = "[0-9A-Fa-f]"
_TIME = "[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])([T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?"
_NUMBER = "[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?"
#: Types that are a form of the text alone.
_FORMS = {
    "string": "(?s).*", "integer": "[+-]?[0-9]+", "float": _NUMBER, "boolean": "true|false", "url": "(?s)[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([/?#].*)?",
    "email": "[A-Za-z0-9!#$%&*+/=?^_`{|}~-]+([.][A-Za-z0-9!#$%&*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?[.])+[A-Za-z]{2,63}",
    "base64": "([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?", "uuid": f"(urn:uuid:)?({_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}|{_HEX}{{32}})",
}
TYPES = (*_FORMS, "timestamp", "ip_address", "json_object", "array")


@dataclass(frozen=True)
class Rule:
    """``of`` is the type's name, the pattern (from the beginning), the allowed values, or of a check the SQL that must hold; ranges have ``low`` and ``high``, either may be missing."""

    column: str
    kind: str
    of: str | Sequence[str] | None = None
    severity: str = "error"
    low: float | None = None
    high: float | None = None
    name: str = field(default="")

    def __post_init__(self) -> None:
        if self.kind not in KINDS or self.severity not in SEVERITIES:
            raise ValueError(f"no rule is of kind {self.kind} and severity {self.severity}")
        if self.kind == "type" and self.of not in TYPES:
            raise ValueError(f"no type is called {self.of}")
        if self.kind == "range" and self.low is None and self.high is None:
            raise ValueError("a range has an end at least")
        if self.kind in ("pattern", "enum", "check") and not self.of:
            raise ValueError(f"a rule of kind {self.kind} says what it allows")

    @property
    def label(self) -> str:
        return self.name or f"{self.column}:{self.kind}"


def _quoted(text: str, duckdb: bool) -> str:
    """A text as SQL has it; Spark's literals know backslashes."""
    return "'" + (text if duckdb else text.replace("\\", "\\\\")).replace("'", "''" if duckdb else "\\'") + "'"


def _is(text: str, pattern: str, duckdb: bool) -> str:
    """Whether a whole text has a form."""
    flags, rest = (pattern[:4], pattern[4:]) if pattern.startswith("(?s)") else ("", pattern)
    whole = _quoted(f"{flags}^({rest})$", duckdb)
    # A dollar also stands before a last line end in one of the engines.
    return f"(regexp_{'matches' if duckdb else 'like'}({text}, {whole}) AND {'true' if flags else f'right({text}, 1) <> chr(10)'})" if rest != ".*" else "true"


def _typed(column: str, kind: str, duckdb: bool) -> str:
    text = f"CAST({column} AS {'VARCHAR' if duckdb else 'STRING'})"
    if kind in _FORMS:
        return _is(text, _FORMS[kind], duckdb)
    if kind == "timestamp":
        number = f"({_is(text, _NUMBER, duckdb)} AND coalesce(TRY_CAST({text} AS DOUBLE) BETWEEN 0 AND {LAST_TIME}, false))"
        return f"({number} OR {_is(text, _TIME, duckdb)} AND TRY_CAST(substr({text}, 1, 10) AS DATE) IS NOT NULL)"
    if kind == "ip_address":
        # An address of the old form at the end of a new one stands for two groups.
        groups = f"regexp_replace({text}, {_quoted(f':{_IPV4}$', duckdb)}, ':0:0')"
        colons = f"length({groups}) - length(replace({groups}, ':', ''))"
        short = f"{_is(groups, f'{_GROUPS}::{_GROUPS}', duckdb)} AND {colons} - CASE WHEN {text} LIKE '::%' OR {text} LIKE '%::' THEN 1 ELSE 0 END BETWEEN 1 AND 7"
        return f"({_is(text, _IPV4, duckdb)} OR {_is(groups, f'({_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}', duckdb)} OR {short})"
    first = "[{]" if kind == "json_object" else "\\["
    begins = f"regexp_{'matches' if duckdb else 'like'}({text}, {_quoted(f'^[ \t\r\n]*{first}', duckdb)})"
    return f"({begins} AND {f'json_valid({text})' if duckdb else f'try_parse_json({text}) IS NOT NULL'})"


def _holds(rule: Rule, duckdb: bool) -> str:
    """SQL that is true where a value that isn't null keeps a rule."""
    column = f'"{rule.column}"' if duckdb else f"`{rule.column}`"
    text = f"CAST({column} AS {'VARCHAR' if duckdb else 'STRING'})"
    if rule.kind == "type":
        return _typed(column, rule.of, duckdb)
    if rule.kind == "range":
        number = f"TRY_CAST({text} AS DOUBLE)"
        ends = [f"{number} >= {float(rule.low)!r}" if rule.low is not None else "", f"{number} <= {float(rule.high)!r}" if rule.high is not None else ""]
        return f"(NOT isnan({number}) AND {' AND '.join(e for e in ends if e)})"
    if rule.kind == "pattern":
        return f"regexp_{'matches' if duckdb else 'like'}({text}, {_quoted(f'^({rule.of})', duckdb)})"
    if rule.kind == "enum":
        return f"{text} IN ({', '.join(_quoted(v, duckdb) for v in rule.of)})"
    return f"({rule.of})"


def _columns(rules: Sequence[Rule], unknown: Sequence[str], costs: Mapping[str, float], duckdb: bool) -> list[str]:
    broken: dict[str, list[tuple[str, str]]] = {s: [] for s in SEVERITIES}
    name = (lambda c: f'"{c}"') if duckdb else (lambda c: f"`{c}`")
    for rule in rules:
        column = name(rule.column)
        breach = f"{column} IS NULL" if rule.kind == "required" else f"{column} IS NOT NULL AND NOT coalesce({_holds(rule, duckdb)}, false)"
        broken[rule.severity].append((rule.label, breach))
    broken["warning"] += [(f"{c}:unknown", "true") for c in unknown]
    listed = lambda severities: "concat_ws(','" + "".join(f", CASE WHEN {b} THEN {_quoted(k, duckdb)} END" for s in severities for k, b in broken[s]) + ")" if any(broken[s] for s in severities) else "''"
    counted = lambda s: " + ".join(["0", *(f"CASE WHEN {b} THEN 1 ELSE 0 END" for _, b in broken[s])])
    tried = [r for r in rules if r.kind != "required"]
    validated = " + ".join(["0", *(f"CASE WHEN {name(r.column)} IS NOT NULL THEN 1 ELSE 0 END" for r in tried)])
    return [f"{listed(('critical', 'error'))} AS errors", f"{listed(('warning',))} AS warnings", f"{listed(('info',))} AS notes", *(f"{counted(s)} AS n_{s}" for s in SEVERITIES), f"{validated} AS n_checked"]


def _judged(costs: Mapping[str, float]) -> list[str]:
    lost = " + ".join(f"n_{s} * {float(c)!r}e0" if "e" not in repr(float(c)) else f"n_{s} * {float(c)!r}" for s, c in costs.items())
    return ["n_critical + n_error = 0 AS valid", f"round(greatest(0e0, 1e0 - ({lost})) + 1e-10, 4) AS quality"]


_GIVEN = ("errors", "warnings", "notes", *(f"n_{s}" for s in SEVERITIES), "n_checked")


def checked(records: DataFrame, rules: Sequence[Rule], *, id_col: str, known: Sequence[str] = (), costs: Mapping[str, float] = COSTS) -> DataFrame:
    """id, errors, warnings and notes by label, counts by severity, rules that met a value, valid (nothing critical, no error), quality.

    A rule of a column that isn't there finds it null. Columns that no rule nor ``known`` names are a warning each. Labels of breaches are
    in the rules' order, the critical ones before errors; two rules of one column and kind should have names. No row is shuffled.
    """
    absent = [c for c in dict.fromkeys(r.column for r in rules) if c not in records.columns]
    named = {id_col, *known, *(r.column for r in rules)}
    rows = records.selectExpr("*", *(f"CAST(NULL AS STRING) AS `{c}`" for c in absent)) if absent else records
    found = rows.selectExpr(f"`{id_col}`", *_columns(rules, [c for c in records.columns if c not in named], costs, duckdb=False))
    return found.selectExpr(f"`{id_col}`", *_GIVEN, *_judged(costs))


def checked_sql(records: str, columns: Sequence[str], rules: Sequence[Rule], *, id_col: str, known: Sequence[str] = (), costs: Mapping[str, float] = COSTS) -> str:
    absent = [c for c in dict.fromkeys(r.column for r in rules) if c not in columns]
    named = {id_col, *known, *(r.column for r in rules)}
    more = "".join(f', CAST(NULL AS VARCHAR) AS "{c}"' for c in absent)
    inner = ", ".join(_columns(rules, [c for c in columns if c not in named], costs, duckdb=True))
    return f"SELECT {id_col}, {', '.join(_GIVEN)}, {', '.join(_judged(costs))} FROM (SELECT {id_col}, {inner} FROM (SELECT *{more} FROM {records}) AS given) AS found"


#: Pages and parts of them as records: host and path of the address, digests and the title of the page; both engines run it.
PAGES = """
SELECT page_id, url, html, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, md5(url) AS digest, concat('crawl@', regexp_extract(url, '://([^/?#]*)', 1)) AS contact,
  regexp_extract(html, '<title>([^<]*)', 1) AS title, CAST(length(html) AS BIGINT) AS size, concat('{"page": ', CAST(page_id AS VARCHAR(20)), CASE WHEN page_id % 7 = 0 THEN '' ELSE '}' END) AS note FROM """
PAGE_COLUMNS = ("page_id", "url", "html", "host", "path", "digest", "contact", "title", "size", "note")
PAGE_RULES = (
    Rule("url", "required", severity="critical"), Rule("url", "type", "url"), Rule("url", "pattern", "https://", severity="warning", name="url:secure"), Rule("host", "type", "ip_address", severity="info"),
    Rule("contact", "type", "email"), Rule("digest", "type", "uuid"), Rule("path", "pattern", "/(en|de|fr|es)/[0-9]+$", severity="warning"), Rule("title", "required", severity="error"), Rule("title", "check", "length(title) BETWEEN 1 AND 60", severity="warning"),
    Rule("size", "range", low=200, high=100_000), Rule("note", "type", "json_object"), Rule("charset", "required", severity="info"), Rule("digest", "type", "base64", severity="warning", name="digest:base64"),
)
