"""Event-log replay as a stream: completion per case with revocation, in event order, with late events.

State per case is the greatest (time, id) seen and its event, so an event that comes late but is older changes
nothing: the result is that of the batch replay whatever the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "case string, completed boolean, n_events long"
STATE = "at long, id long, completed boolean, n long"


def _step(done: str):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last, completed, n = state.get if state.exists else (-(1 << 62), -(1 << 62), False, 0)
        for pdf in batches:
            n += len(pdf)
            top = pdf.sort_values(["at", "id"]).iloc[-1]
            if (top["at"], top["id"]) > (at, last):
                at, last, completed = int(top["at"]), int(top["id"]), bool(top["event"] == done)
        state.update((at, last, completed, n))
        yield pd.DataFrame({"case": [key[0]], "completed": [completed], "n_events": [n]})

    return run


def replay_stream(events: DataFrame, case: str, event: str, at: str, event_id: str, done: str, revoked: str) -> DataFrame:
    """A streaming table of (case, completed, n_events), updated per case as events come."""
    rows = events.where(F.col(event).isin(done, revoked)).select(F.col(case).cast("string").alias("case"), F.col(event).alias("event"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(event_id).cast("bigint").alias("id"))
    return rows.groupBy("case").applyInPandasWithState(_step(done), OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind; windows close once the watermark has passed them."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
