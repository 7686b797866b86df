"""How far a job has come, without a second pass: figures that Spark takes from the rows as they pass by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Progress:
    """Stages of one batch job, in the order in which they were named, and their figures once an action has run."""

    def __init__(self):
        self.stages: dict[str, Observation] = {}

    def at(self, stage: str, df: DataFrame, **figures: Column) -> DataFrame:
        """df, of which the rows (and other aggregates) are counted as they pass."""
        self.stages[stage] = Observation(stage)
        return df.observe(self.stages[stage], F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in figures.items()])

    def counts(self) -> dict[str, dict]:
        """Figures by stage; waits for the action that runs the stages. A stage that no action has run isn't to be asked for."""
        return {stage: o.get for stage, o in self.stages.items()}


class StreamProgress(StreamingQueryListener):
    """Figures of the stages of streams by batch, as rows (query, batch, stage, figures); observe(name, ...) names a stage."""

    def __init__(self):
        self.rows: list[tuple[str, int, str, dict]] = []
        self.ended: list[tuple[str, str | None]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += [(str(p.id), p.batchId, stage, figures.asDict()) for stage, figures in p.observedMetrics.items()]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append((str(event.id), event.exception))

    def totals(self) -> dict[str, int]:
        """Rows by stage over all batches; a batch that was run again counts once."""
        last = {(q, batch, stage): figures["rows"] for q, batch, stage, figures in self.rows}
        out: dict[str, int] = {}
        for (_, _, stage), n in last.items():
            out[stage] = out.get(stage, 0) + n
        return out
