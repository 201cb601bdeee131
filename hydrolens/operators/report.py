"""Text report of a device's state and recent readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolens import constants as C
from hydrolens.functions import text
from hydrolens.operators.latest import history_n


def context_report(readings: DataFrame, rows: int = C.REPORT_ROWS) -> DataFrame:
    """The last readings of each device as lines of text, newest first.

    The list per device holds ``rows`` lines at most: the newest rows are picked
    before the shuffle.
    """
    line = text.summary_line(
        F.col("temperature"), F.col("ph"), F.col("conductivity"), F.col("water_level")
    )
    recent = history_n(readings, rows).select("device_id", "position", line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("position", "line")))
    return recent.groupBy("device_id").agg(
        F.concat_ws("\n", F.transform(lines, lambda one: one["line"])).alias("history")
    )
