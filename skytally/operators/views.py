"""Pages that analysts open: the list of functions, one function in detail, bulk actions on the inbox, exports, and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skytally.operators.analyst import HOUR, RANK, rank_of

DAY = 24 * HOUR
# Windows by name, the longest one, bins by the window that they suit, and how many techniques and detections a page shows.
WINDOWS = {"24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}
LONGEST = 90 * DAY
BINS = {"1h": HOUR, "6h": 6 * HOUR, "1d": DAY, "3d": 3 * DAY}
SORTS = {"last_seen_desc": (), "count_24h_desc": ("n_day",), "count_7d_desc": ("n_week",), "open_case_count_desc": ("n_open_cases",)}
TOP_LISTED, TOP_SHOWN, RECENT = 3, 5, 20
ACTIONS = ("open_case", "attach", "assign", "dismiss")


def window_of(spec: str | None = None, *, now_us: int, since_us: int | None = None, until_us: int | None = None) -> tuple[int, int]:
    """Start and end (half open) of a named window that ends now, 7d without a name; ``custom`` takes its own ends. Over 90 days is an error."""
    if spec == "custom":
        if since_us is None or until_us is None:
            raise ValueError("a custom window needs both its ends")
    elif (spec or "7d") not in WINDOWS:
        raise ValueError(f"no window is called {spec}")
    else:
        since_us, until_us = now_us - WINDOWS[spec or "7d"], now_us
    if since_us >= until_us:
        raise ValueError("a window begins before it ends")
    if until_us - since_us > LONGEST:
        raise ValueError("a window has at most 90 days")
    return since_us, until_us


def bin_of(span_us: int) -> str:
    """The bin that suits a window: an hour up to a day, six up to a week, a day up to 30, three beyond."""
    return "1h" if span_us <= DAY else "6h" if span_us <= 7 * DAY else "1d" if span_us <= 30 * DAY else "3d"


def _techniques(detections: DataFrame) -> DataFrame:
    return detections.select("function_id", F.explode(F.split("techniques", ",")).alias("technique")).where("technique <> ''").groupBy("function_id", "technique").agg(F.count("*").alias("n"))


def _first(counts: DataFrame, k: int, *order: Column) -> DataFrame:
    """The ``k`` first rows of each function."""
    return counts.withColumn("_place", F.row_number().over(Window.partitionBy("function_id").orderBy(*order))).where(F.col("_place") <= k)


def function_page(
    detections: DataFrame, attached: DataFrame, *, now_us: int, decision: str | None = None, technique: str | None = None, sort: str = "last_seen_desc", limit: int = 100, offset: int = 0,
) -> DataFrame:
    """A page of functions: last_us, n_day, n_week, worst decision, n_open_cases and the three commonest techniques, and how many functions there are in all.

    ``decision`` and ``technique`` (the beginning of its name) choose the detections that are counted; cases count by all of a function's detections.
    ``attached`` (event_id, case_id, status) says which case a detection is in; closed ones don't count. Ties go by last time, then name.
    A null function is a group like any other. No detections, no rows.
    """
    if sort not in SORTS:
        raise ValueError(f"functions aren't sorted by {sort}")
    rows = detections if decision is None else detections.where(F.col("decision") == decision)
    rows = rows if technique is None else rows.where(F.exists(F.split("techniques", ","), lambda t: F.startswith(t, F.lit(technique))))
    counted = rows.groupBy("function_id").agg(
        F.max("t_us").alias("last_us"), F.count_if(F.col("t_us") >= now_us - DAY).alias("n_day"), F.count_if(F.col("t_us") >= now_us - 7 * DAY).alias("n_week"), F.max_by("decision", rank_of(F.col("decision"))).alias("worst"),
    )
    cases = detections.select("event_id", "function_id").join(attached.where("status <> 'closed'").select("event_id", "case_id"), "event_id").groupBy("function_id").agg(F.count_distinct("case_id").alias("n_open_cases"))
    top = _first(_techniques(rows), TOP_LISTED, F.desc("n"), F.col("technique")).groupBy("function_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", "technique"))), lambda x: x["technique"]), ",").alias("top_techniques"))
    joined = counted
    for part in (cases, top):
        joined = joined.join(part.withColumnRenamed("function_id", "_of"), F.col("function_id").eqNullSafe(F.col("_of")), "left").drop("_of")
    total = counted.agg(F.count("*").alias("total"))
    page = joined.join(F.broadcast(total)).withColumns({"n_open_cases": F.coalesce("n_open_cases", F.lit(0)), "top_techniques": F.coalesce("top_techniques", F.lit(""))})
    return page.orderBy(*(F.desc(c) for c in SORTS[sort]), F.desc("last_us"), "function_id").offset(offset).limit(limit)


def function_detail(detections: DataFrame, attached: DataFrame, *, since_us: int, until_us: int, function_id: str | None = None) -> DataFrame:
    """What a function's page shows, of one function or each: decisions, the five commonest techniques, a line of counts, the latest 20 detections and open cases.

    Everything but cases is of the window (half open). Arrays of structs: ``techniques`` (technique, n), ``line`` (bin, n, worst; bins without
    detections are left out), ``recent`` (event_id, t_us, decision, anomaly_type; newest first), ``cases`` (case_id, status). Each part is cut
    by rank before it is gathered; only open cases are gathered whole. A function without detections in the window has no row.
    """
    own = detections if function_id is None else detections.where(F.col("function_id") == function_id)
    own = own.where("function_id IS NOT NULL")
    rows = own.where((F.col("t_us") >= since_us) & (F.col("t_us") < until_us))
    width = BINS[bin_of(until_us - since_us)]
    mix = rows.groupBy("function_id").agg(*(F.count_if(F.col("decision") == k).alias(k) for k in RANK))
    listed = lambda rows, name, *fields: rows.groupBy("function_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))
    top = listed(_first(_techniques(rows), TOP_SHOWN, F.desc("n"), F.col("technique")), "techniques", "technique", "n")
    bins = rows.groupBy("function_id", (F.floor(F.col("t_us") / width) * width).alias("bin")).agg(F.count("*").alias("n"), F.max_by("decision", rank_of(F.col("decision"))).alias("worst"))
    line = listed(bins.withColumn("_place", F.col("bin")), "line", "bin", "n", "worst")
    recent = listed(_first(rows, RECENT, F.desc("t_us"), F.desc("event_id")), "recent", "event_id", "t_us", "decision", "anomaly_type")
    held = own.select("event_id", "function_id").join(attached.where("status <> 'closed'").select("event_id", "case_id", "status"), "event_id").select("function_id", "case_id", "status").distinct()
    cases = listed(held.withColumn("_place", F.col("case_id")), "cases", "case_id", "status")
    out = mix
    for part in (top, line, recent, cases):
        out = out.join(part, "function_id", "left")
    return out.withColumns({c: F.coalesce(c, F.array()) for c in ("techniques", "line", "recent", "cases")})


def bulk_action(selected: DataFrame, attached: DataFrame, action: str, *, case_id: str | None = None, taken: bool = True) -> DataFrame:
    """What one action does to each selected detection (event_id): event_id, case_id that changes, ok and error.

    ``attached`` (event_id, case_id) has a case per detection at most. ``open_case`` and ``attach`` put detections into ``case_id``: those of
    another case fail (already_attached), those of the same one too (duplicate), the others go in; a case is opened with all of them or
    none. ``assign`` needs a case (no_case_attached), ``dismiss`` closes the case if there is one. Repeated detections count once, a
    null one is not_found; ``taken`` says whether the case of ``attach`` is there at all, else that is an error.
    """
    if action not in ACTIONS:
        raise ValueError(f"no bulk action is called {action}")
    if action in ("open_case", "attach") and case_id is None:
        raise ValueError(f"{action} needs a case")
    if action == "attach" and not taken:
        raise ValueError(f"there is no case {case_id}")
    held = attached.select(F.col("event_id").alias("_held"), F.col("case_id").alias("_case"))
    rows = selected.select("event_id").distinct()
    rows = rows.join(held, F.col("event_id") == F.col("_held"), "left")
    if action in ("open_case", "attach"):
        error = F.when(F.col("_case") == case_id, "duplicate").when(F.col("_case").isNotNull(), "already_attached")
        changed = F.lit(case_id)
    else:
        error = F.when(F.col("_case").isNull(), "no_case_attached") if action == "assign" else F.lit(None).cast("string")
        changed = F.col("_case")
    judged = rows.select("event_id", changed.alias("case_id"), F.when(F.col("event_id").isNull(), "not_found").otherwise(error).alias("error"))
    if action == "open_case":
        first = judged.agg(F.min("error").alias("_any"))
        judged = judged.join(F.broadcast(first)).withColumn("error", F.coalesce("error", F.when(F.col("_any").isNotNull(), "not_opened"))).drop("_any")
    return judged.select("event_id", F.when(F.col("error").isNull(), F.col("case_id")).alias("case_id"), F.col("error").isNull().alias("ok"), "error")


#: Columns of an exported detection in their order.
EXPORTED = ("event_id", "t_us", "function_id", "anomaly_type", "decision", "fused_score", "band", "techniques")


def exported(detections: DataFrame) -> DataFrame:
    """Detections as the export has them: scores with four places as text, techniques parted by semicolons, nulls as empty text."""
    as_text = {"fused_score": F.format_string("%.4f", F.round(F.col("fused_score") + 1e-10, 4)), "techniques": F.translate("techniques", ",", ";")}
    return detections.select(*(F.coalesce(as_text.get(c, F.col(c).cast("string")), F.lit("")).alias(c) for c in EXPORTED))


def write_export(detections: DataFrame, path: str) -> None:
    """The export as CSV files with a header each; quotes are doubled, so that other readers understand them."""
    exported(detections).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def audit_page(
    trail: DataFrame, *, actor: str | None = None, action: str | None = None, since: int | None = None, until: int | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """A page of the trail (actor, ts, id, action), newest first, with the number of all rows that match; both ends of the time belong to it."""
    rows = trail if actor is None else trail.where(F.col("actor") == actor)
    rows = rows if action is None else rows.where(F.col("action") == action)
    rows = rows if since is None else rows.where(F.col("ts") >= since)
    rows = rows if until is None else rows.where(F.col("ts") <= until)
    total = rows.agg(F.count("*").alias("total"))
    return rows.join(F.broadcast(total)).orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


def audit_summary(trail: DataFrame) -> DataFrame:
    """By actor and action with subtotals (null: all): rows, first and last time, and days with any. Real nulls in either are named (none)."""
    named = trail.select(*(F.coalesce(c, F.lit("(none)")).alias(c) for c in ("actor", "action")), "ts")
    return named.rollup("actor", "action").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct(F.floor(F.col("ts") / DAY)).alias("n_days"))
