"""Alerts with memory: consecutive violations before an alert, and a cooldown after it, per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "account_name string, event_time timestamp, streak int"
STATE = "streak int, quiet_until double"


def losing_streaks(trades: DataFrame, consecutive: int = 5, cooldown_seconds: float = 3600.0) -> DataFrame:
    """A row whenever an account has lost ``consecutive`` times in a row and no alert in the cooldown before.

    Takes a stream with account_name, event_time and profit_loss; the state of an account is two numbers.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, quiet = state.get if state.exists else (0, 0.0)
        rows = []
        for t, p in pd.concat(list(parts)).sort_values("event_time")[["event_time", "profit_loss"]].itertuples(index=False):
            streak = streak + 1 if p <= 0 else 0
            if streak >= consecutive and t.timestamp() >= quiet:
                rows.append((key[0], t, streak))
                quiet = t.timestamp() + cooldown_seconds
        state.update((streak, quiet))
        yield pd.DataFrame(rows, columns=["account_name", "event_time", "streak"])

    return trades.groupBy("account_name").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
