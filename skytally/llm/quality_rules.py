"""Quality rules whose cutoffs control the risk of rejecting good documents; DataFrame functions throughout.

Each rule is a measure in whole steps, higher is worse. A fixed ladder of ``LEVELS`` joint settings gives every rule a cutoff, from
mild to strict; a row's level is the first at which any rule rejects it. On labelled good documents, by stratum (language), the
settings are tested in this order: one is taken if the exact binomial (Clopper-Pearson) upper bound of the good rows that any of
its rules rejects lies under ``LIMIT``, and testing stops at the first that fails. Testing in a fixed order needs no correction
within a stratum, and one test counts the rejections of all rules together, so nothing is divided by the number of rules; each
stratum has an equal part of ``RISK`` (Bonferroni). Thus with probability 1 - ``RISK`` no stratum loses more than ``LIMIT`` of its
good documents. A stratum needs log(RISK / strata) / log(1 - LIMIT) labelled good rows before any cutoff can pass, 217 for four
strata; the others have none and keep whatever passes the base rules.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.llm.common import SPACES, blank_null, materialise

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Good documents that a stratum may lose, and the chance that any stratum loses more.
LIMIT, RISK = 0.02, 0.05
#: Rules in order: a column of whole steps, and the steps that the mildest and the strictest setting reject. Set beforehand, as the
#: guarantee asks: what is at the mild end can hardly be prose in any language, what is at the strict end is at its edge.
RULES = {"symbols": (20, 1), "dup_lines": (48, 18), "repeats": (50, 5), "upper": (45, 15), "marks": (60, 10), "long_words": (72, 34), "short_words": (96, 89)}
LEVELS = 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cut_at(rule: str, level: int) -> int:
    """The least step that a rule rejects at a level, 1 (mild) to ``LEVELS`` (strict)."""
    mild, strict = RULES[rule]
    return mild - (mild - strict) * (level - 1) // (LEVELS - 1)


def level_of(step: Column, rule: str) -> Column:
    """The first level at which a rule rejects a row; one over the last if none does."""
    cuts = [cut_at(rule, level) for level in range(1, LEVELS + 1)]
    return F.lit(LEVELS + 1) - sum(((step >= c).cast("int") for c in cuts), F.lit(0))


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(df: DataFrame, words: str, into: str, window: int = 5) -> DataFrame:
    """Adds how many of the array's words lie in runs of ``window`` words that occur twice or more in it.

    Runs are compared by 64-bit hashes; only arrays with an equal pair are sorted and covered.
    """
    n = F.size(words)
    runs = F.when(n > window, F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(window)))))
    df = df.withColumn("_runs", runs)
    some = F.size("_runs") > F.size(F.array_distinct("_runs"))
    df = df.withColumn("_sorted", F.when(some, F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda k: F.try_element_at("_sorted", k)["h"]
    twice = F.filter("_sorted", lambda x, k: F.coalesce(near(k + 2) == x["h"], F.lit(False)) | F.when(k > 0, near(F.greatest(k, F.lit(1))) == x["h"]).otherwise(F.lit(False)))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["total"] + window - F.greatest(F.lit(0), a["end"] - i)).alias("total"), (i + window).alias("end"))
    total = F.aggregate("_at", start, step, lambda a: a["total"])
    return df.withColumn(into, F.coalesce(total, F.lit(0)).cast("long")).drop("_runs", "_sorted", "_at")


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """doc_id, stratum, the measures of the whole text, the rules' steps, the row's level and base_failed."""
    stratum = F.col("lang") if stratum is None else stratum
    text = blank_null(F.col(text_col))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum"), text.alias("t"))
    df = df.select(
        "doc_id", "stratum", F.array_remove(F.split("t", "[\\x20\\x09-\\x0D]+"), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("l"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"), _count_of(F.col("t"), SYMBOLS).alias("n_symbols"), _count_of(F.col("t"), UPPER).alias("n_upper"), _count_of(F.col("t"), "!?").alias("n_marks"),
    )
    df = df.withColumns({"n_words": F.size("w").cast("long"), "n_lines": F.size("l").cast("long"), "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long")}).drop("l")
    df = repeated_words(df, "w", "n_repeat_words").drop("w")
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    part = lambda by, x, of, most: f"least(coalesce({by} * {x} div nullif({of}, 0), 0), {most})"
    steps = {
        "symbols": part(50, "n_symbols", "word_chars", 50), "dup_lines": part(50, "n_dup_lines", "n_lines", 50), "repeats": part(50, "n_repeat_words", "n_words", 50),
        "upper": part(50, "n_upper", "word_chars", 50), "marks": part(50, "n_marks", "n_words", 100), "long_words": part(4, "word_chars", "n_words", 100), "short_words": f"100 - {part(4, 'word_chars', 'n_words', 100)}",
    }
    df = df.withColumns({k: F.expr(v) for k, v in steps.items()})
    return df.withColumn("level", F.least(*(level_of(F.col(r), r) for r in RULES)))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term from logarithms."""
    first = F.struct((n * log(1 - p)).alias("l"), F.exp(n * log(1 - p)).alias("s"))

    def add(a: Column, i: Column) -> Column:
        term = a["l"] + F.log((n - i + 1) / i) + log(p / (1 - p))
        return F.struct(term.alias("l"), (a["s"] + F.exp(term)).alias("s"))

    return F.when(k == 0, F.exp(n * log(1 - p))).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), first, add, lambda a: a["s"]))


def settings(rows: DataFrame, labels: DataFrame, *, limit: float = LIMIT, risk: float = RISK, label_col: str = "quality") -> DataFrame:
    """stratum, n_good, the last level that passed (0: none) and how many of the good rows it rejects, for strata with labelled good rows.

    Good rows that fail the base rules aren't counted. Counts by stratum and level are aggregated before the shuffle; what follows
    has at most ``LEVELS`` + 1 rows a stratum.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    held = rows.where("NOT base_failed").join(good, "doc_id", "left_semi")
    counts = held.groupBy("stratum", "level").agg(F.count("*").alias("c"))
    by = counts.groupBy("stratum").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("level", "c"))).alias("at"))
    steps = F.sequence(F.lit(1), F.lit(LEVELS))
    below = F.transform(steps, lambda t: F.aggregate(F.sequence(F.lit(1), t), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("at", i), F.lit(0).cast("long"))))
    # One row is joined to all; it has one number.
    made = by.withColumn("k", below).join(F.broadcast(by.agg(F.count("*").alias("strata"))))
    failed = F.transform("k", lambda k: (k > F.col("n") * limit) | (binomial_tail(k, F.col("n"), limit) > F.lit(risk) / F.col("strata")))
    first = F.array_position(failed, F.lit(True))
    made = made.withColumn("passed", F.when(first == 0, LEVELS).otherwise(first - 1).cast("int"))
    rejected = F.when(F.col("passed") > 0, F.try_element_at("k", F.greatest("passed", F.lit(1)))).otherwise(0)
    return made.select("stratum", F.col("n").alias("n_good"), "passed", rejected.cast("long").alias("n_good_rejected"))


def judge(docs: DataFrame, labels: DataFrame, *, limit: float = LIMIT, risk: float = RISK, stratum: Column | None = None) -> DataFrame:
    """doc_id, the five measures, base_failed, kept and the number of rules that rejected, for every row.

    A row is kept if it passes the base rules and its level lies beyond the last setting that passed in its stratum. Null texts have
    no words and fail; a null stratum is a stratum; without usable labels only the base rules count; repeated rows are judged alike
    and repeated labels count once; an empty table gives no rows. The measures are written once and read for both passes. The
    settings, one row a stratum, are joined by Spark's own choice; a stratum that holds most rows is split by its skew join.
    """
    rows = materialise(measured(docs, stratum=stratum), "measures")
    joined = rows.join(settings(rows, labels, limit=limit, risk=risk), "stratum", "left")
    passed = F.coalesce("passed", F.lit(0))
    hits = sum(((level_of(F.col(r), r) <= passed).cast("int") for r in RULES), F.lit(0))
    return joined.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & (F.col("level") > passed)).alias("kept"), hits.cast("long").alias("n_rules_hit"))


def oracle(limit: float = LIMIT, risk: float = RISK) -> str:
    """DuckDB SQL for ``judge`` over ``documents`` and ``labels``."""
    part = lambda by, x, of, most: f"least(coalesce({by} * {x} // nullif({of}, 0), 0), {most})"
    steps = {
        "symbols": part(50, "n_symbols", "word_chars", 50), "dup_lines": part(50, "n_dup_lines", "n_lines", 50), "repeats": part(50, "n_repeat_words", "n_words", 50),
        "upper": part(50, "n_upper", "word_chars", 50), "marks": part(50, "n_marks", "n_words", 100), "long_words": part(4, "word_chars", "n_words", 100), "short_words": f"100 - {part(4, 'word_chars', 'n_words', 100)}",
    }
    levels = {r: f"{LEVELS + 1} - (" + " + ".join(f"({r} >= {cut_at(r, k)})::INT" for k in range(1, LEVELS + 1)) + ")" for r in RULES}
    tail = f"(SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({limit!r}) + (n - i) * ln(1 - {limit!r}))) FROM unnest(range(0, k + 1)) AS u(i))"
    hits = " + ".join(f"(({v}) <= coalesce(passed, 0))::INT" for v in levels.values())
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d
), pos AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM cut WHERE len(w) >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM pos) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid
), f AS (
  SELECT rid, doc_id, stratum, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words
  FROM cut LEFT JOIN covered USING (rid)
), m AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {", ".join(f"{v} AS {k}" for k, v in steps.items())} FROM f
), ranked AS (
  SELECT *, least({", ".join(levels.values())}) AS level FROM m
), held AS (
  SELECT stratum, level FROM ranked WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)
), strata AS (
  SELECT stratum, count(*) AS n FROM held GROUP BY stratum
), tested AS (
  SELECT stratum, n, t, CAST((SELECT count(*) FROM held WHERE held.stratum = strata.stratum AND level <= t) AS BIGINT) AS k FROM strata, (SELECT unnest(range(1, {LEVELS + 1})) AS t)
), failing AS (
  SELECT stratum, min(t) AS t FROM tested WHERE k > n * {limit!r} OR {tail} > {risk} / (SELECT count(*) FROM strata) GROUP BY stratum
), settled AS (
  SELECT strata.stratum, coalesce(failing.t - 1, {LEVELS}) AS passed FROM strata LEFT JOIN failing USING (stratum)
), hit AS (
  SELECT ranked.*, coalesce(passed, 0) AS passed, {hits} AS n_rules_hit FROM ranked LEFT JOIN settled USING (stratum)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND level > passed AS kept, CAST(n_rules_hit AS BIGINT) AS n_rules_hit
FROM hit"""


ORACLE_SQL = oracle()
