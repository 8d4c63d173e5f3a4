"""Whether a table is small enough to be sent to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fits_broadcast(rows: DataFrame, growth: int = 1) -> bool:
    """True when the optimizer's estimate is within the broadcast threshold.

    The estimate of a scan is the size of its files. ``growth`` is how many
    times larger the data that is derived from the rows and sent may become. A
    table without an estimate, such as one built from local objects, counts as
    too large.
    """
    if not hasattr(rows, "_jdf"):
        return False
    session = rows.sparkSession._jsparkSession
    threshold = session.sessionState().conf().autoBroadcastJoinThreshold()
    estimate = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(estimate)) * growth <= threshold
