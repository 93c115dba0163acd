"""Fields of foreign records brought to one's own: events under any of their names and units, and mappings by strategy.

Which columns there are is known when a query is built, so both are one projection over the record's row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# Names that a telemetry field goes by, the first one that is filled counts; phases under their names; what odd events are taken to use.
NAMES = {
    "event_id": ("event_id", "payload_id", "record_id"), "timestamp": ("timestamp", "invocation_timestamp"), "function_id": ("function_id", "function_profile_id", "function_name"),
    "anomaly_type": ("anomaly", "anomaly_type"), "phase": ("execution_phase", "phase"), "cpu": ("cpu_utilization", "cpu"), "region": ("region", "execution_environment.region"),
    "runtime_version": ("runtime_version", "execution_environment.runtime"), "trigger_type": ("trigger_type", "httpMethod"),
}
PHASES = {"init": "init", "initialization": "init", "invoke": "invoke", "execution": "invoke", "shutdown": "shutdown", "completion": "shutdown", "error": "error", "timeout": "timeout"}
TYPES = (
    "benign", "cold_start", "cpu_burst", "memory_spike", "memory_leak", "io_intensive", "network_anomaly", "starvation_fallback", "timeout_fallback", "execution_failure", "adversarial_injection", "data_exfiltration",
    "privilege_escalation", "economic_abuse", "silent_corruption",
)
MISSING = {"event_id": "runtime-event", "function_id": "runtime-function"}


def has(schema: StructType, path: str) -> bool:
    """Whether a schema has a column or nested field."""
    for name in path.split("."):
        if not isinstance(schema, StructType) or name not in schema.names:
            return False
        schema = schema[name].dataType
    return True


def filled(value: Column) -> Column:
    """A text that isn't empty, or a number that isn't 0; else null, as is false."""
    text = value.cast("string")
    return F.when(~text.isin("", "0", "0.0", "-0.0", "false"), text)


def first_filled(raw: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns or nested fields that is there and filled, as text."""
    there = [filled(F.col(n)) for n in names if has(raw.schema, n)]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def normalised(raw: DataFrame) -> DataFrame:
    """Telemetry of raw events, one row each: names and phases as the library has them, seconds, kilobytes and bytes.

    Columns that are missing count as null. A duration in milliseconds counts where there is no duration (beside a duration of 0 its number
    is taken as it is), a memory in megabytes and a number or list of network calls (1,024 bytes each) where there is none in the
    library's unit; numbers that can't be read are 0. Unknown phases are invocations, unknown types benign; an event without a name has
    one that says so.
    """
    get = lambda name: first_filled(raw, NAMES[name])
    number = lambda path, kind="double": F.coalesce(F.col(path).cast("string").try_cast(kind), F.lit(0).cast(kind)) if has(raw.schema, path) else F.lit(0).cast(kind)
    given = F.col("duration").isNotNull() if has(raw.schema, "duration") else F.lit(False)
    own, memory, network = number("duration"), number("memory_spike_kb"), number("network_io_bytes")
    kind = F.lower(get("anomaly_type"))
    kind = F.when(kind.isin(*TYPES), kind).otherwise("benign")
    phase = F.create_map(*(F.lit(x) for pair in PHASES.items() for x in pair))
    milliseconds = number("telemetry_fields.duration_ms")
    listed = has(raw.schema, "network_calls") and isinstance(raw.schema["network_calls"].dataType, ArrayType)
    calls = F.greatest(F.coalesce(F.size("network_calls"), F.lit(0)), F.lit(0)).cast("double") if listed else number("network_calls")
    cpu = F.coalesce(get("cpu").try_cast("double"), F.when(kind != "benign", 88.0).otherwise(26.0))
    return raw.select(
        F.coalesce(get("event_id"), F.lit(MISSING["event_id"])).alias("event_id"), F.coalesce(get("timestamp").try_cast("double"), F.lit(0.0)).alias("timestamp"),
        F.coalesce(get("function_id"), F.lit(MISSING["function_id"])).alias("function_id"), F.coalesce(F.try_element_at(phase, F.lower(get("phase"))), F.lit("invoke")).alias("phase"), kind.alias("anomaly_type"),
        F.when(own != 0, own).otherwise(F.when(given, milliseconds).otherwise(milliseconds / 1000)).alias("duration"), F.when(memory != 0, memory).otherwise(number("telemetry_fields.max_memory_used_mb") * 1024).alias("memory"),
        cpu.alias("cpu"), F.when(network != 0, network).otherwise(calls * 1024).alias("network"),
        (filled(F.col("fallback_mode")).isNotNull() if has(raw.schema, "fallback_mode") else F.lit(False)).__or__(filled(F.col("force_starvation")).isNotNull() if has(raw.schema, "force_starvation") else F.lit(False)).alias("fallback"),
        get("region").alias("region"), get("runtime_version").alias("runtime_version"), get("trigger_type").alias("trigger_type"),
    )


# Transforms by name.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "to_string": lambda x: x.cast("string"), "to_int": lambda x: F.floor(x.cast("string").try_cast("double")).cast("long"), "to_float": lambda x: x.cast("string").try_cast("double"), "to_bool": lambda x: F.coalesce(filled(x).isNotNull(), F.lit(False)),
    "to_lowercase": lambda x: F.lower(x.cast("string")), "to_uppercase": lambda x: F.upper(x.cast("string")), "trim": lambda x: F.trim(x.cast("string")),
    "capitalize": lambda x: F.concat(F.upper(F.substring(x.cast("string"), 1, 1)), F.lower(F.substring(x.cast("string"), 2, 2**31 - 1))),
    "round": lambda x: F.bround(x.cast("double")).cast("long"), "abs": lambda x: F.abs(x.cast("double")), "sqrt": lambda x: F.when(x.cast("double") >= 0, F.sqrt(x.cast("double"))),
    "to_timestamp": lambda x: F.unix_micros(F.try_to_timestamp(x.cast("string"))) / 1e6, "from_timestamp": lambda x: F.date_format(F.timestamp_micros((x.cast("double") * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss"),
    "format_date": lambda x: F.date_format(F.timestamp_micros((x.cast("double") * 1e6).cast("long")), "yyyy-MM-dd"), "to_json": lambda x: F.to_json(F.struct(x.alias("value"))), "from_json": lambda x: F.from_json(x.cast("string"), "map<string,string>"),
    "hash_value": lambda x: F.substring(F.md5(x.cast("string")), 1, 16), "anonymize": lambda x: F.concat(F.substring(x.cast("string"), 1, 2), F.repeat(F.lit("*"), F.greatest(F.length(x.cast("string")) - 2, F.lit(0)))),
    "normalize": lambda x: F.lower(F.trim(x.cast("string"))),
}
STRATEGIES = ("direct", "transform", "calculate", "conditional", "aggregate", "split", "merge", "default")


@dataclass(frozen=True)
class Field:
    """How ``target`` is made of ``sources``, by one of ``STRATEGIES``.

    ``by``: a transform's name; an expression (calculate); {value: condition} in order (conditional); sum, mean, min, max or count of those
    that aren't null (aggregate); (separator, part from 1) (split); a separator (merge). Where it gives null, ``default`` stands.
    """

    target: str
    strategy: str
    sources: tuple[str, ...] = ()
    by: object = None
    default: object = None
    required: bool = False
    check: str | None = field(default=None)


def _made(rows: DataFrame, f: Field) -> Column:
    if f.strategy not in STRATEGIES:
        raise ValueError(f"{f.target}: {f.strategy} is no strategy")
    got = [F.col(s) if has(rows.schema, s) else F.lit(None).cast("string") for s in f.sources]
    if f.strategy in ("direct", "transform", "split") and len(got) != 1 or f.strategy in ("aggregate", "merge") and not got:
        raise ValueError(f"{f.target}: {f.strategy} of {len(got)} sources")
    if f.strategy == "direct":
        made = got[0]
    elif f.strategy == "transform":
        if f.by not in TRANSFORMS:
            raise ValueError(f"{f.target}: there is no transform {f.by}")
        made = TRANSFORMS[f.by](got[0])
    elif f.strategy == "calculate":
        made = F.expr(str(f.by))
    elif f.strategy == "conditional":
        made = F.coalesce(*(F.when(F.expr(condition), F.lit(value)) for value, condition in f.by.items()))
    elif f.strategy == "aggregate":
        all_ = F.array_compact(F.array(*(g.cast("double") for g in got)))
        total = F.aggregate(all_, F.lit(0.0), lambda a, x: a + x)
        made = {"sum": total, "mean": F.try_divide(total, F.size(all_)), "min": F.array_min(all_), "max": F.array_max(all_), "count": F.size(all_)}[f.by]
    elif f.strategy == "split":
        made = F.nullif(F.split_part(got[0].cast("string"), F.lit(f.by[0]), F.lit(f.by[1])), F.lit(""))
    elif f.strategy == "merge":
        made = F.nullif(F.concat_ws(str(f.by), *(g.cast("string") for g in got)), F.lit(""))
    else:
        made = F.lit(None).cast("string")
    return made if f.default is None else F.coalesce(made, F.lit(f.default))


def mapped(rows: DataFrame, fields: Sequence[Field], *, keep: Sequence[str] = ()) -> DataFrame:
    """``rows`` by the fields' mappings, with the columns ``keep`` as they are, and ``errors``: required fields that are null, and those whose ``check`` (a condition over the result) fails.

    Sources that aren't there count as null; two fields of one target, unknown strategies and transforms, and a wrong number of sources are errors when the query is built.
    """
    names = [*keep, *(f.target for f in fields)]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("a target is named twice")
    out = rows.select(*keep, *(_made(rows, f).alias(f.target) for f in fields))
    wrong = [F.when(F.col(f.target).isNull(), F.lit(f"missing {f.target}")) for f in fields if f.required]
    wrong += [F.when(~F.coalesce(F.expr(f.check), F.lit(True)), F.lit(f"invalid {f.target}")) for f in fields if f.check]
    return out.withColumn("errors", F.concat_ws(",", *wrong) if wrong else F.lit(""))


#: Event tables as three kinds of sender write them, in turn; and the fields of an example mapping.
def raw_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_id") % 3
    k = F.get_json_object("props", "$.k").cast("long")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    name, when = F.concat(F.lit("fn-"), (F.col("user_id") % 20).cast("string")), F.when
    return events.select(
        when(kind == 0, F.col("event_id")).alias("event_id"), when(kind == 1, F.concat(F.lit("p-"), F.col("event_id").cast("string"))).alias("payload_id"), when(kind == 0, seconds).alias("timestamp"), when(kind != 0, seconds).alias("invocation_timestamp"),
        when(kind == 0, name).otherwise("").alias("function_id"), when(kind == 1, name).alias("function_profile_id"), F.col("event_type").alias("anomaly"), when(F.col("event_type") == "error", "cold_start").otherwise("cpu_burst").alias("anomaly_type"),
        when(F.col("event_type") == "signup", "Initialization").when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "completion").alias("execution_phase"),
        when(kind == 0, F.col("value") / 10).when(k % 5 == 0, F.lit(0.0)).alias("duration"), F.struct((F.col("value") * 100).alias("duration_ms"), k.alias("max_memory_used_mb")).alias("telemetry_fields"), when(kind == 0, k * 2048).alias("memory_spike_kb"),
        when(k > 50, k.cast("double")).alias("cpu"), (k % 7).alias("network_calls"), F.struct(F.lit("eu-1").alias("region"), F.lit("py3").alias("runtime")).alias("execution_environment"), (k % 11 == 0).alias("force_starvation"),
    )


NORMALISED_SQL = f"""
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 3 AS kind, 'fn-' || (user_id % 20) AS name FROM events)
SELECT CASE kind WHEN 0 THEN CASE WHEN event_id = 0 THEN '{MISSING["event_id"]}' ELSE event_id::VARCHAR END WHEN 1 THEN 'p-' || event_id ELSE '{MISSING["event_id"]}' END AS event_id, epoch_us(ts) / 1e6 AS timestamp,
  CASE WHEN kind = 2 THEN '{MISSING["function_id"]}' ELSE name END AS function_id, CASE event_type WHEN 'signup' THEN 'init' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'shutdown' ELSE 'invoke' END AS phase, 'benign' AS anomaly_type,
  CASE WHEN kind = 0 AND value / 10 <> 0 THEN value / 10 WHEN kind = 0 OR k % 5 = 0 THEN value * 100 ELSE value * 100 / 1000 END AS duration, CASE WHEN kind = 0 AND k <> 0 THEN k * 2048 ELSE k * 1024 END::DOUBLE AS memory,
  CASE WHEN k > 50 THEN k ELSE 26 END::DOUBLE AS cpu, (k % 7 * 1024)::DOUBLE AS network, k % 11 = 0 AS fallback, 'eu-1' AS region, 'py3' AS runtime_version, NULL::VARCHAR AS trigger_type
FROM e"""

EXAMPLE = (
    Field("function", "direct", ("function_id",), required=True), Field("kind", "transform", ("anomaly_type",), "capitalize"), Field("megabytes", "calculate", by="memory / 1024.0", check="megabytes < 150"),
    Field("load", "conditional", by={"high": "cpu >= 80", "low": "cpu < 20"}, default="normal"), Field("peak", "aggregate", ("duration", "cpu", "nowhere"), "max"), Field("number", "split", ("function_id",), ("-", 2), default="none"),
    Field("label", "merge", ("phase", "nowhere", "anomaly_type"), "/"), Field("origin", "default", default="telemetry"), Field("trigger", "direct", ("nowhere",), required=True), Field("alias", "transform", ("function_id",), "anonymize"),
    Field("day", "transform", ("seconds",), "format_date"), Field("digest", "transform", ("phase",), "hash_value"),
)


def example(telemetry: DataFrame) -> DataFrame:
    return mapped(telemetry.withColumn("seconds", F.col("t_us") / 1e6), EXAMPLE, keep=("event_id",))


def example_sql(view: str) -> str:
    return f"""
SELECT event_id, function_id AS function, upper(anomaly_type[1]) || lower(anomaly_type[2:]) AS kind, memory / 1024.0::DOUBLE AS megabytes, CASE WHEN cpu >= 80 THEN 'high' WHEN cpu < 20 THEN 'low' ELSE 'normal' END AS load, greatest(duration, cpu) AS peak,
  coalesce(nullif(split_part(function_id, '-', 2), ''), 'none') AS number, phase || '/' || anomaly_type AS label, 'telemetry' AS origin, NULL::VARCHAR AS trigger, function_id[1:2] || repeat('*', greatest(length(function_id) - 2, 0)) AS alias,
  strftime(make_timestamp(t_us), '%Y-%m-%d') AS day, md5(phase)[1:16] AS digest, concat_ws(',', 'missing trigger', CASE WHEN memory / 1024.0 >= 150 THEN 'invalid megabytes' END) AS errors
FROM {view}"""
