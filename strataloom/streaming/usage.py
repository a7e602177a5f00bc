"""Usage as a stream: savings per window, and gets related to the last search of their session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataloom.operators.telemetry import SEARCH_TTL


def windowed_savings(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Gets and bytes per window and lane; events later than ``late`` behind the newest are left out."""
    lane = F.when(F.col("language") == "markdown", "docs").otherwise("code")
    rows = events.where("event = 'get'").withWatermark("time", late).groupBy(F.window("time", length).alias("w"), lane.alias("lane"))
    sums = rows.agg(F.count("*").alias("gets"), F.sum("symbol_bytes").alias("symbol_bytes"), F.sum("file_bytes").alias("file_bytes"))
    return sums.select(F.col("w.start").alias("start"), "lane", "gets", "symbol_bytes", "file_bytes")


_OUT = "session string, ts double, symbol_id string, search_id string, search_rank int"
_STATE = "ts double, repo string, search_id string, results array<string>"


def _relate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A session's gets in a micro-batch with the search before them; state is that one search."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values(["ts", "event"], ascending=[True, False], kind="stable")
    last = state.getOption
    out = []
    for r in rows.itertuples():
        if r.event == "search" and r.results is not None and len(r.results):
            last = (float(r.ts), r.repo, r.search_id, list(r.results))
        elif r.event == "get":
            fits = last is not None and 0 <= r.ts - last[0] <= SEARCH_TTL and last[1] == r.repo
            rank = list(last[3]).index(r.symbol_id) if fits and r.symbol_id in list(last[3]) else None
            out.append((key[0], float(r.ts), r.symbol_id, last[2] if fits else None, rank))
    if last is not None:
        state.update(last)
        state.setTimeoutTimestamp(max(int((last[0] + 2 * SEARCH_TTL) * 1000), state.getCurrentWatermarkMs() + 1))
    made = pd.DataFrame(out, columns=["session", "ts", "symbol_id", "search_id", "search_rank"])
    made["search_rank"] = made["search_rank"].astype("Int32")
    yield made


def related_gets(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each get with the id of the search that explains it and its rank there.

    State is one search per session, dropped when event time has passed twice its lifetime.
    """
    rows = events.where("event IN ('get', 'search')").withWatermark("time", late).select("time", "session", "ts", "event", "repo", "symbol_id", "search_id", "results")
    return rows.groupBy("session").applyInPandasWithState(_relate, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
