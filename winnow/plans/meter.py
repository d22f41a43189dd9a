"""Rows in and out of the stages of a run, from the jobs that run anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# Stages in their order; where a stage's input is not observed, it is the output of the one before.
STAGES = ("trim", "dedup", "seen", "summarise", "route")


class Meter:
    """Observed row counts. A frame put on the meter must be read to its end by the next action on it, as a write or a
    checkpoint does; a look at its first rows would count no more than these."""

    def __init__(self) -> None:
        self._observed: dict[tuple[str, str], Observation] = {}
        # the trimmed items whose untrimmed ones are on the meter
        self.trimmed: DataFrame | None = None

    def on(self, stage: str, side: str, df: DataFrame) -> DataFrame:
        self._observed[stage, side] = seen = Observation()
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def forget(self, stage: str, side: str) -> None:
        self._observed.pop((stage, side), None)

    def rows(self, stage: str, side: str) -> int | None:
        """None for what was never put on the meter."""
        seen = self._observed.get((stage, side))
        return None if seen is None else seen.get["rows"]

    def stages(self, spark: SparkSession) -> DataFrame:
        """(stage, rows) of what each stage handed on, so that a stage that swallows rows shows."""
        names = {"fetched": "dedup", "new": "seen", "scored": "summarise", "routed": "route", "unrouted": "unrouted"}
        return spark.createDataFrame([(name, self.rows(stage, "out")) for name, stage in names.items()], "stage string, rows bigint")

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, rows_in, rows_out)"""
        out, before = [], None
        for stage in STAGES:
            given, left = self.rows(stage, "in"), self.rows(stage, "out")
            out.append((stage, before if given is None else given, left))
            before = left
        return spark.createDataFrame(out, "stage string, rows_in bigint, rows_out bigint")
