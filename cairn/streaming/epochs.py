"""Epoch metrics as a stream of appended files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_rows(spark: SparkSession, folder: str, schema: StructType | str, form: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(form).load(folder)


def windowed(rows: DataFrame, by: list[str], time: str, value: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count, mean, least and greatest value of each tumbling window; rows later than ``late`` are left out."""
    grouped = rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select(*by, F.col("w.start").alias("start"), "n", "mean", "low", "high")


STATE = "attempt int, steps array<long>, values array<double>, losses array<double>"
PROGRESS = "run string, attempt int, last_step long, best_step long, best_value double, reference double, since long, stopped boolean"


def progress_of(steps: list[int], values: list[float], losses: list[float], min_delta: float, patience: int) -> tuple:
    """(last, best step, best value, reference, since, stopped) of the steps of a run in their order.

    The best step has the highest value, of equal ones the lowest loss, then comes first. The reference moves only on a
    gain above ``min_delta``; ``since`` counts the steps after it moved, and at ``patience`` the run has stopped.
    """
    best, reference, since, stopped = 0, float("-inf"), 0, False
    for i, (value, loss) in enumerate(zip(values, losses, strict=True)):
        if value > values[best] or value == values[best] and loss < losses[best]:
            best = i
        since = 0 if value > reference + min_delta else since + 1
        reference = value if since == 0 else reference
        stopped = stopped or since >= patience
    return steps[-1], steps[best], values[best], reference, since, stopped


def run_progress(rows: DataFrame, min_delta: float, patience: int) -> DataFrame:
    """A stream of (run, attempt, step, value, loss) as a stream of each run's progress after a batch that changes it.

    An attempt above the run's last one resumes it: its first step and all later ones of the attempt before are dropped, as
    a resumed training writes them anew. Rows of earlier attempts, and steps that an attempt has already, change nothing,
    so a batch that is read twice gives the same state. State is one run's steps, which are few; a run's rows meet by its name.
    """

    def update(key, batches, state):
        import pandas as pd

        attempt, steps, values, losses = state.get if state.exists else (0, [], [], [])
        held, changed = dict(zip(steps, zip(values, losses, strict=True), strict=True)), False
        arrived = pd.concat(list(batches)).dropna(subset=["step", "value"])
        for number, rows in arrived.sort_values(["attempt", "step"]).groupby("attempt"):
            if number < attempt:
                continue
            if number > attempt:
                first = rows["step"].iloc[0]
                held, attempt, changed = {s: v for s, v in held.items() if s < first}, int(number), True
            for step, value, loss in zip(rows["step"], rows["value"], rows["loss"].fillna(float("inf")), strict=True):
                if int(step) not in held:
                    held[int(step)], changed = (float(value), float(loss)), True
        if not changed or not held:
            return
        steps = sorted(held)
        values, losses = ([held[s][i] for s in steps] for i in (0, 1))
        state.update((attempt, steps, values, losses))
        yield pd.DataFrame([(key[0], attempt, *progress_of(steps, values, losses, min_delta, patience))], columns=[c.split()[0] for c in PROGRESS.split(", ")])

    return rows.groupBy("run").applyInPandasWithState(update, PROGRESS, STATE, "update", "NoTimeout")
