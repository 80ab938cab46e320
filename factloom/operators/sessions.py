"""Sessions: runs of events of one key with pauses of at most `gap` between them.

The same code serves tables and streams. Over a stream, a session is given out once, when the watermark (`late` behind the latest event) has passed its end; events that come later than that
change nothing, so `late` should be as long as events may take. Rows without a key or time are left out; repeated rows count each; an empty table has no sessions. A session is combined in each task before it is
shuffled, so a key with very many events moves its sessions' parts, not its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, gap: str, aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    """key, start (first event), finish (last event), n_events and the aggregates. late: for streams, how far behind the latest event one may come."""
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = rows if late is None else rows.withWatermark(time, late)
    out = rows.groupBy(key, F.session_window(time, gap).alias("span")).agg(F.min(time).alias("start"), F.max(time).alias("finish"), F.count("*").alias("n_events"), *(v.alias(k) for k, v in aggregates.items()))
    return out.drop("span")
