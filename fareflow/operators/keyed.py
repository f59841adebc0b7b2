"""Shared pieces of the keyed-update operators (section 2.9).

A batch of commands is applied to the current state as a join; when one
key receives several commands, arrival order decides.  "First command per
key" is computed with a ``min`` over a struct (partial aggregation, so a
hot key is combined map-side) and joined back on the key, instead of a
``row_number`` window that would sort a hot key's whole group in one task.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ts_param(x) -> Column:
    """A timestamp parameter (``'1998-12-31 00:00:00'``, a datetime or a
    Column) as ``timestamp_ntz``, independent of the session time zone."""
    if isinstance(x, Column):
        return x
    if isinstance(x, (datetime, date)):
        x = x.isoformat(sep=" ") if isinstance(x, datetime) else x.isoformat()
    return F.to_timestamp_ntz(F.lit(str(x)))


def arrival(commands: DataFrame, ts: str = "ts", col: str = "command_id") -> Column:
    """Arrival order of a command batch: its time (when the batch has one),
    then ``command_id``.  The id must be unique, so no two commands ever tie -
    a retried command that equals the first in everything else still comes
    second.  A batch without ids gets them from ``admission.assign_sequence_ids``
    over its file order."""
    if col not in commands.columns:
        raise ValueError(f"commands need a unique arrival id in column {col!r}")
    return F.struct(*[c for c in (ts, col) if c in commands.columns]).alias("_arrival")


def first_per_key(df: DataFrame, key: list[str] | str, order: list, flag: str = "is_first") -> DataFrame:
    """Add ``flag``: true on the row with the smallest ``order`` tuple of its
    key (``order`` must end with a unique column, e.g. a command id)."""
    key = [key] if isinstance(key, str) else list(key)
    first = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    out = df.join(first, key, "left")
    return out.withColumn(flag, F.coalesce(F.struct(*order) == F.col("_first"), F.lit(False))).drop("_first")


def reasons(*checks: tuple[Column, str]) -> Column:
    """First failing check's reason (checks in the reference's order), or null.
    Each check is ``(failed_condition, reason)``."""
    out = None
    for cond, reason in reversed(checks):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(reason)) if out is None else \
            F.when(F.coalesce(cond, F.lit(False)), F.lit(reason)).otherwise(out)
    return out
