"""The settle gate as a stream: a session is closed at its quorum or at its deadline, what comes later is routed apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The closing auction and the hour at which nothing is waited for any longer, in seconds of the day.
CUT, DEADLINE = 14 * 3600 + 44 * 60, 15 * 3600 + 30 * 60
#: Milliseconds for which a session is remembered after its deadline.
KEEP = 24 * 3600 * 1000

_VOTE = "d date, arrived timestamp, at bigint, cut bigint, deadline bigint, voters int, lacking int"
_CLOSED = "d date, voters bigint, lacking bigint, wait boolean, closed_at bigint"


class _Votes(StatefulProcessor):
    """State of one (d, symbol): its first distinct minutes, as many as a vote needs, and whether it votes and is settled."""

    def __init__(self, least_bars: int):
        self.least_bars = least_bars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.vote = handle.getValueState("vote", "voter boolean, settled boolean")
        self.minutes = handle.getListState("minutes", "sec int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(rows).sort_values(["at", "sec"])
        forget = int(bars["deadline"].iloc[0]) + KEEP
        if forget <= timerValues.getCurrentWatermarkInMs():
            return
        if self.vote.exists():
            voter, settled = self.vote.get()
        else:
            voter = settled = False
            self.handle.registerTimer(forget)
        minutes = [int(x[0]) for x in self.minutes.get()]
        out = []
        for r in bars.itertuples():
            before = int(voter), int(voter and not settled)
            if not voter and r.sec not in minutes:
                minutes.append(int(r.sec))
                voter = len(minutes) >= self.least_bars
            settled = settled or r.sec >= CUT
            now = int(voter), int(voter and not settled)
            if now != before:
                out.append((key[0], r.arrived, r.at, r.cut, r.deadline, now[0] - before[0], now[1] - before[1]))
        self.vote.update((voter, settled))
        self.minutes.put([(x,) for x in minutes])
        if out:
            yield pd.DataFrame(out, columns=["d", "arrived", "at", "cut", "deadline", "voters", "lacking"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.vote.clear()
        self.minutes.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Gate(StatefulProcessor):
    """State of one session: its votes, and whether it is closed."""

    def __init__(self, share: float):
        self.share = share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "voters bigint, lacking bigint, closed boolean, deadline bigint")

    def _row(self, d, voters: int, lacking: int, at: int) -> pd.DataFrame:
        return pd.DataFrame([(d, voters, lacking, lacking >= self.share * voters, at)], columns=["d", "voters", "lacking", "wait", "closed_at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        votes = pd.concat(rows)
        cut, deadline = int(votes["cut"].iloc[0]), int(votes["deadline"].iloc[0])
        if deadline + KEEP <= timerValues.getCurrentWatermarkInMs():
            return
        if self.count.exists():
            voters, lacking, closed, _ = self.count.get()
        else:
            voters = lacking = 0
            closed = False
            self.handle.registerTimer(deadline)
        for at, some in votes.groupby("at", sort=True):
            if closed or at > deadline:
                break
            voters, lacking = voters + int(some["voters"].sum()), lacking + int(some["lacking"].sum())
            if at >= cut and lacking < self.share * voters:
                closed = True
                yield self._row(key[0], voters, lacking, int(at))
        self.count.update((voters, lacking, closed, deadline))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        voters, lacking, closed, deadline = self.count.get()
        if expiredTimerInfo.getExpiryTimeInMs() > deadline:
            self.count.clear()
            return
        self.handle.registerTimer(deadline + KEEP)
        if not closed:
            self.count.update((voters, lacking, True, deadline))
            if voters:
                yield self._row(key[0], voters, lacking, deadline)

    def close(self) -> None:
        pass


def closings(bars: DataFrame, least_bars: int = 30, share: float = 0.2, late: str = "1 minute") -> DataFrame:
    """A stream of d, voters, lacking, wait, closed_at, a row a session, from one of minute bars (symbol, d, sec, arrived).

    The clock is that of `arrived`, the time at which a bar came in; stamps may be out of order by `late`.
    A symbol votes once `least_bars` different minutes of it are there, and lacks until a bar of the
    closing auction is. From the auction on, a session is closed as soon as fewer than `share` of the
    voters lack (wait: false), else at its deadline with the votes as they are then. The row is that of
    ingest.quorum() over the bars up to closed_at; as there, a session without a voter has none. Bars that
    come twice count once, and votes after the closing not at all: routed() finds their bars.

    Bars are turned into votes symbol by symbol, so a session's task gets two short rows a symbol and
    not the session's bars. Both states go a day after the deadline. Needs calibration.STATE_STORE.
    """
    start = F.unix_millis(F.col("d").cast("timestamp"))
    timed = bars.withWatermark("arrived", late).select(
        "d", "symbol", F.col("sec").cast("int").alias("sec"), "arrived", F.unix_millis("arrived").alias("at"), (start + CUT * 1000).alias("cut"), (start + DEADLINE * 1000).alias("deadline")
    )
    timed = timed.where(F.col("symbol").isNotNull() & F.col("d").isNotNull() & F.col("sec").isNotNull() & F.col("arrived").isNotNull())
    votes = timed.groupBy("d", "symbol").transformWithStateInPandas(_Votes(least_bars), outputStructType=_VOTE, outputMode="append", timeMode="eventTime", eventTimeColumnName="arrived")
    closed = votes.groupBy("d").transformWithStateInPandas(_Gate(share), outputStructType=_CLOSED, outputMode="append", timeMode="eventTime")
    return closed.withColumn("closed_at", F.timestamp_millis("closed_at"))


def routed(bars: DataFrame, closed: DataFrame) -> DataFrame:
    """bars, a stream or a table, with is_late: whether they came after their session was closed. closed: rows of closings().

    A session that is not closed has no late bars.
    """
    at = closed.select("d", F.col("closed_at").alias("__at"))
    rows = bars.join(F.broadcast(at), "d", "left")  # a row a session
    return rows.withColumn("is_late", F.coalesce(F.col("arrived") > F.col("__at"), F.lit(False))).drop("__at")
