"""Streaming twins of two batch rules: alert sessions and notification pacing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def live_sessions(alerts: DataFrame, entity: str, time: str, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """Alert sessions per (entity, column) over a stream; state is one line per open session.

    Like the batch rule, alerts exactly one gap apart still belong together.
    """
    window = F.session_window(time, gap)
    return (
        alerts.withWatermark(time, late)
        .groupBy(entity, "column", window)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("start_ts"), F.max(time).alias("end_ts"))
        .select(entity, "column", "start_ts", "end_ts", "n_rows")
    )


def paced_notifications(active: DataFrame, entity: str, time: str, every: str = "7 days") -> DataFrame:
    """At most one notification per (entity, column, alert start) and period, counted from the last notice.

    ``active`` carries ``since``, the start of the alert: a new alert notifies at once, a running one again when the
    period has passed since its last notice. State is one time per alert, dropped when it has been silent for a period.
    """
    period = pd.Timedelta(every)
    names, kinds = active.columns, active.schema

    def notices(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(time)
        sent = []
        for at, moment in enumerate(rows[time]):
            if last is None or moment - last >= period:
                sent.append(at)
                last = moment
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(max(int((last + period).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        if sent:
            yield rows.iloc[sent][names]

    return (
        active.withWatermark(time, every)
        .groupBy(entity, "column", "since")
        .applyInPandasWithState(notices, kinds, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )
