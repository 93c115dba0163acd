"""A panel that detectors can be added to: what is registered votes, is fused by its weight, and stands in the SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from skytally.functions.dialect import DUCKDB, SPARK, fill
from skytally.operators import decisions, detectors
from skytally.operators.detectors import Detector
from skytally.sources.telemetry import ORACLE_VIEW


class Panel:
    """Detectors with their weights in the order of registration; it begins with the 26 of the library unless told otherwise.

    A detector's texts are expressions over the record and the measures of the panel's steps (see ``detectors``), with ``s`` for its score.
    """

    def __init__(self, given: tuple[Detector, ...] = detectors.DETECTORS):
        self._held: dict[str, tuple[Detector, float]] = {}
        for d in given:
            self.register(d, decisions.weight(d.name))

    def register(self, detector: Detector, weight: float) -> Panel:
        """Adds a detector. A name that is taken or isn't one, a weight outside 0 to 1, and an empty text are errors."""
        if not re.fullmatch("[a-z][a-z0-9_]*", detector.name):
            raise ValueError(f"{detector.name!r} can't name columns")
        if detector.name in self._held:
            raise ValueError(f"{detector.name} is registered already")
        if not 0 <= weight <= 1:
            raise ValueError(f"the weight of {detector.name} is {weight}, not from 0 to 1")
        if empty := [f for f in ("guard", "score", "detected", "confidence", "type") if not getattr(detector, f).strip()]:
            raise ValueError(f"{detector.name} has no {empty[0]}")
        self._held[detector.name] = (detector, float(weight))
        return self

    def __contains__(self, name: str) -> bool:
        return name in self._held

    def __iter__(self) -> Iterator[Detector]:
        return (d for d, _ in self._held.values())

    def __len__(self) -> int:
        return len(self._held)

    @property
    def weights(self) -> dict[str, float]:
        return {name: w for name, (_, w) in self._held.items()}

    @property
    def types(self) -> list[str]:
        """The library's anomaly types and those that the detectors' texts name."""
        own = {t for d in self for t in re.findall("'([a-z_]+)'", d.type)}
        return sorted(own.union(decisions._TYPES) - {"benign", "error", "init", "invoke", "shutdown"})

    def votes(self, telemetry: DataFrame) -> DataFrame:
        return detectors.votes(telemetry, tuple(self))

    def fused(self, votes: DataFrame) -> DataFrame:
        return votes.sparkSession.sql(fill(decisions.fused_text(self.weights, self.types), SPARK), rows=votes)

    def votes_sql(self, view: str = ORACLE_VIEW) -> str:
        return detectors._dialect(detectors.panel_sql(view, tuple(self), more=detectors._PERCENTILES), DUCKDB)

    def fused_sql(self, view: str = ORACLE_VIEW) -> str:
        return fill(decisions.fused_text(self.weights, self.types), DUCKDB).format(rows=f"({self.votes_sql(view)}) AS votes")


#: A detector as a user may add it: much traffic for the time it took, against the function's mean traffic.
EXAMPLE = Detector("burst_transfer", "n >= 5 AND network_mb > 0", "network / network_mb / greatest(duration, 0.1)", "s > 0.5", "least(s / 2.0, 1.0)", "'burst_transfer'")
