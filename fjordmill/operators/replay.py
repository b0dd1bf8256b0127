"""Event-log replay: the last completing or revoking event of a case decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_state(events: DataFrame, case: str, event: str, order: list[str], done: str, revoked: str) -> DataFrame:
    """(case, completed, n_events) over the events that count; order breaks ties of time."""
    counted = events.where(F.col(event).isin(done, revoked))
    return counted.groupBy(case).agg((F.max_by(event, F.struct(*order)) == done).alias("completed"), F.count("*").alias("n_events"))


def pending(cases: DataFrame, events: DataFrame, *, case: str, event: str, order: list[str], done: str, revoked: str, status: str = "status", skipped: str = "skipped", finished: DataFrame | None = None, group: list[str] = (), models: tuple[str, list] | None = None, keep=None, resume: bool = True) -> DataFrame:
    """The cases that still have to run: not skipped, of the models and that ``keep`` holds for; with ``resume`` neither
    in a group that is finished nor completed by the log (a later failure revokes a completion)."""
    out = cases.where(F.coalesce(F.col(status), F.lit("")) != skipped)
    if models:
        out = out.where(F.col(models[0]).isin(*models[1]))
    if keep is not None:
        out = out.where(keep)
    if not resume:
        return out
    if finished is not None:
        out = out.join(finished.select(*group).distinct(), list(group), "left_anti")
    completed = last_state(events, case, event, order, done, revoked).where("completed").select(case)
    return out.join(completed, case, "left_anti")
