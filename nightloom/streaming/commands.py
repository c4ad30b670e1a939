"""Commands of an image engine followed as their messages come: done, failed, or out of time.

Each session has at most one running command, which is its state. A command ends with its success or error, with the start of
the next one (unfinished), or when the watermark passes its start by the limit (timeout): then the session's timer
fires, without a message. Messages behind the watermark are dropped; those of one micro-batch are taken in the order of their times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "session string, name string, outcome string, started timestamp, ended timestamp, n_logs int, progress int"
STATE = "name string, started long, n_logs int, progress int"


def completions(messages: DataFrame, limit_seconds: float, late: str = "10 seconds", session: str = "session", time: str = "time") -> DataFrame:
    """One row for each command of the stream of typed messages (session, time, kind, text, pct), when it ends."""
    limit = int(limit_seconds * 1000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        now = state.get if state.exists else None

        def end(outcome: str, at: int) -> None:
            stamp = lambda ms: pd.Timestamp(ms, unit="ms")
            done.append((key[0], now[0], outcome, stamp(now[1]), stamp(at), now[2], now[3]))

        if state.hasTimedOut:
            end("timeout", now[1] + limit)
            now = None
        else:
            rows = pd.concat(list(batches)).sort_values([time, "kind", "text"], kind="stable")
            for r in rows.itertuples(index=False):
                at, kind = int(getattr(r, time).timestamp() * 1000), r.kind
                if now is not None and at > now[1] + limit:
                    end("timeout", now[1] + limit)
                    now = None
                if kind == "starting":
                    if now is not None:
                        end("unfinished", at)
                    now = (r.text, at, 0, None)
                elif now is not None:
                    if kind in ("success", "error"):
                        end(kind, at)
                        now = None
                    elif kind == "log":
                        now = (now[0], now[1], now[2] + 1, now[3])
                    elif kind == "progress" and not pd.isna(r.pct):
                        now = (*now[:3], int(r.pct) if now[3] is None else max(now[3], int(r.pct)))
        if now is None:
            state.remove()
        else:
            state.update(now)
            state.setTimeoutTimestamp(max(now[1] + limit, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"progress": "Int32", "n_logs": "int32"})

    timed = messages.withWatermark(time, late).select(session, time, "kind", "text", "pct")
    return timed.groupBy(session).applyInPandasWithState(follow, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
