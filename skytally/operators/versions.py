"""Versions of a record's schema: how compatible two of them are, and moving records to one of them in one projection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from skytally.functions.dialect import SPARK, fill

Schema = dict[str, bool]  # field -> whether it is required
Links = dict[tuple[str, str], dict[str, str]]  # (from, to) -> target field -> expression over the record

#: Schemas and links of the telemetry view's records.
SCHEMAS: dict[str, Schema] = {
    "0.9": {"duration": True, "memory": True, "network": True, "phase": True},
    "1.0": {"duration": True, "memory": True},
    "1.1": {"duration": True, "memory": True, "cpu": False},
    "2.0": {"duration": True, "memory": True, "cpu": False, "memory_mb": False},
    "2.1": {"duration": True, "memory": True, "cpu": False, "memory_mb": False, "load": False},
    "3.0": {"duration": True, "memory": True, "cpu": False, "memory_mb": False, "load": False, "weight": False},
}
#: From 1.0 on a record passes three links to 3.0; 0.9 has no way there, since what it drops breaks its readers.
LINKS: Links = {
    ("0.9", "2.0"): {"memory_mb": "memory / 1024.0"}, ("1.0", "1.1"): {"cpu": "0.0"}, ("1.0", "2.0"): {"cpu": "0.0", "memory_mb": "memory / 1024.0"}, ("1.1", "2.0"): {"memory_mb": "memory / 1024.0"}, ("2.0", "1.1"): {},
    ("2.0", "2.1"): {"load": "coalesce(cpu, 50.0) / 100.0 * memory_mb"}, ("2.1", "3.0"): {"weight": "load * duration + memory_mb"}, ("2.1", "2.0"): {},
}
#: The view's records with a version each; one in five has a version that no schema names, or none.
VERSIONED = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '0.9' WHEN 1 THEN '1.0' WHEN 2 THEN '1.1' WHEN 3 THEN '2.0' WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN '7.7' END END AS schema_version, duration, memory, CASE WHEN event_id % 5 > 1 THEN cpu END AS cpu, CASE WHEN event_id % 5 = 3 THEN memory / 1024.0 END AS memory_mb, CAST(NULL AS DOUBLE) AS load, CAST(NULL AS DOUBLE) AS weight FROM {rows}"


def compatibility(old: Schema, new: Schema) -> str:
    """full, backward (nothing breaks), partial (fewer than half of the changes break) or incompatible; removed fields and fields that become required break."""
    removed = sum(f not in new for f in old)
    stricter = sum(f in old and not old[f] and need for f, need in new.items())
    other = sum(f not in old or (old[f] and not need) for f, need in new.items())
    changes, breaking = removed + stricter + other, removed + stricter
    return "full" if changes == 0 else "backward" if breaking == 0 else "partial" if 2 * breaking < changes else "incompatible"


#: What a link between schemas costs by their compatibility; others can't be passed. Fixed values.
COSTS = {"full": 0, "backward": 1, "partial": 3}


def chain(start: str, target: str, schemas: dict[str, Schema], links: Links) -> tuple[str, ...] | None:
    """The versions passed from ``start`` to ``target`` along the cheapest links; of equally cheap ways the shorter, then the first by name.

    A link is passed if both schemas are known and aren't incompatible. A version leads to itself without a link; where no way leads
    there is None. Cycles cost, so no way goes round one. Versions are as few as releases, so this runs when a query is built.
    """
    done: set[str] = set()
    waiting = [(0, 1, (start,))] if start in schemas and target in schemas else []
    while waiting:
        cost, length, way = best = min(waiting)
        waiting.remove(best)
        if way[-1] == target:
            return way
        if way[-1] in done:
            continue
        done.add(way[-1])
        for (a, b), _ in links.items():
            if a == way[-1] and b in schemas and b not in way and (kind := compatibility(schemas[a], schemas[b])) in COSTS:
                waiting.append((cost + COSTS[kind], length + 1, (*way, b)))
    return None


def composed(way: tuple[str, ...], links: Links) -> dict[str, str]:
    """Expressions over the first version's fields for what the links along ``way`` make, each put into the next."""
    made: dict[str, str] = {}
    for step in zip(way, way[1:], strict=False):
        link = links[step]
        put = lambda text: re.sub(r"(?<![\w.'])[A-Za-z_]\w*(?![\w'(])", lambda m: f"({made[m[0]]})" if m[0] in made else m[0], text)  # noqa: E731, B023
        made |= {field: put(text) for field, text in link.items()}
    return made


def migration(target: str, schemas: dict[str, Schema], links: Links) -> str:
    """Text that moves records (event_id, schema_version, fields) to ``target`` along the cheapest chain of links, in one projection.

    A record is moved if a chain leads from its version; one of the target version is ``moved`` as it is. Any other, a null or unknown
    version among them, keeps its fields and version and isn't ``moved``. ``steps`` counts the links passed.
    """
    ways = {a: way for a in schemas if a != target and (way := chain(a, target, schemas, links))}
    made = {a: composed(way, links) for a, way in ways.items()}
    fields = []
    for field in schemas[target]:
        cases = " ".join(f"WHEN '{a}' THEN {made[a][field]}" for a in ways if field in made[a])
        fields.append(f"CASE schema_version {cases} ELSE {field} END AS {field}" if cases else field)
    moved = ", ".join(f"'{v}'" for v in [target, *ways])
    steps = " ".join(f"WHEN '{a}' THEN {len(way) - 1}" for a, way in ways.items())
    told = f"CASE schema_version {steps} ELSE 0 END AS steps" if steps else "0 AS steps"
    return f"SELECT event_id, schema_version AS came_from, CASE WHEN schema_version IN ({moved}) THEN '{target}' ELSE schema_version END AS schema_version, coalesce(schema_version IN ({moved}), false) AS moved, {told}, {', '.join(fields)} FROM {{rows}}"


def migrated(records: DataFrame, target: str, schemas: dict[str, Schema] = SCHEMAS, links: Links = LINKS) -> DataFrame:
    return records.sparkSession.sql(fill(migration(target, schemas, links), SPARK), rows=records)
