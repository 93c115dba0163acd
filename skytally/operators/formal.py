"""Temporal properties of finite traces, composed from operators and evaluated with window functions, backwards once for each operator.

A formula is an SQL condition on a record, or a tuple: ("not", f), ("and", f, g), ("or", f, g), ("implies", f, g), ("next", f),
("always", f), ("eventually", f), ("until", f, g). A trace is a function's records in order of arrival; a formula holds for a trace
if it holds at its first record. At the last record "next" is false, and "until" asks that g comes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from skytally.functions.dialect import DUCKDB, SPARK, fill

Formula = str | tuple
_BACK = "OVER (PARTITION BY function_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

#: Properties of the telemetry by name.
PROPERTIES: Mapping[str, Formula] = {
    "bounded": ("always", "cpu BETWEEN 0 AND 100"),
    "shuts_down": ("eventually", "phase = 'shutdown'"),
    "errors_end": ("always", ("implies", "truth", ("eventually", "NOT truth"))),
    "invoked_after_init": ("eventually", ("and", "phase = 'init'", ("next", "phase = 'invoke'"))),
    "no_error_before_init": ("until", "NOT truth", "phase = 'init'"),
    "init_infinitely_often": ("always", ("eventually", "phase = 'init'")),
    "no_double_error": ("always", ("implies", "truth", ("next", ("not", "truth")))),
    "quick_or_busy": ("always", ("or", "duration < 15", "cpu > 5")),
}


def compiled(formulas: Mapping[str, Formula]) -> str:
    """SQL text over ``{rows}`` of function_id and each formula's value; a formula's parts are columns of nested selections."""
    layers: list[list[str]] = []
    names: dict[Formula, str] = {}

    def place(depth: int, text: str) -> str:
        while len(layers) <= depth:
            layers.append([])
        name = f"c{sum(map(len, layers))}"
        layers[depth].append(f"{text} AS {name}")
        return name

    def walk(f: Formula) -> tuple[str, int]:
        """The name of a formula's column and the layer that makes it."""
        if f in names:
            return names[f]
        if isinstance(f, str):
            made = place(0, f"coalesce({f}, false)"), 0
        else:
            op, parts = f[0], [walk(x) for x in f[1:]]
            depth, cols = 1 + max(d for _, d in parts), [c for c, _ in parts]
            bit = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
            if op == "until":
                ends = [place(depth, f"min(CASE WHEN {c} THEN event_id END) {_BACK}") for c in (f"NOT {cols[0]}", cols[1])]
                made = place(depth + 1, f"{ends[1]} IS NOT NULL AND ({ends[0]} IS NULL OR {ends[1]} <= {ends[0]})"), depth + 1
            else:
                text = {
                    "not": lambda: f"NOT {cols[0]}", "and": lambda: f"{cols[0]} AND {cols[1]}", "or": lambda: f"{cols[0]} OR {cols[1]}", "implies": lambda: f"NOT {cols[0]} OR {cols[1]}",
                    "next": lambda: f"coalesce(lag({cols[0]}) OVER (PARTITION BY function_id ORDER BY event_id DESC), false)",
                    "always": lambda: f"min({bit(cols[0])}) {_BACK} = 1", "eventually": lambda: f"max({bit(cols[0])}) {_BACK} = 1",
                }
                if op not in text:
                    raise ValueError(f"no such operator: {op}")
                made = place(depth, text[op]()), depth
        names[f] = made
        return made

    own = {name: walk(f)[0] for name, f in formulas.items()}
    text = "{rows}"
    for layer in layers:
        text = f"(SELECT *, {', '.join(layer)} FROM {text}) AS layer"
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY event_id) AS place FROM {text}) AS ranked"
    return f"SELECT function_id, {', '.join(f'{c} AS {n}' for n, c in own.items())} FROM {ranked} WHERE place = 1"


def properties(telemetry: DataFrame, formulas: Mapping[str, Formula] = PROPERTIES) -> DataFrame:
    return telemetry.sparkSession.sql(fill(compiled(formulas), SPARK), rows=telemetry)


def properties_sql(view: str, formulas: Mapping[str, Formula] = PROPERTIES) -> str:
    return fill(compiled(formulas), DUCKDB).format(rows=view)
