"""Calibration of cones as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.regime import Scale

#: The state store that processors with several state variables need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Calibrator(StatefulProcessor):
    """State of one (h, level): the scale and the last session, the days that are not known yet, the last hits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scale = handle.getValueState("scale", "s double, session int")
        self.due = handle.getListState("due", "session int, hit double")
        self.hits = handle.getListState("hits", "hit double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, session = self.scale.get() if self.scale.exists() else (1.0, -1)
        scale = Scale(int(key[0]), int(key[1]), float(s), int(session), [(int(a), float(b)) for a, b in self.due.get()], [float(x[0]) for x in self.hits.get()])
        days = pd.concat(rows).sort_values("session")  # a batch may bring several days, in any order
        out = []
        for r in days.itertuples():
            found = scale.day(int(r.session), [(c["cell"], c["n"]) for c in r.cells])
            if found is not None:
                out.append((r.d, scale.h, scale.level, *found))
        self.scale.update((scale.s, scale.session))
        for state, values in ((self.due, scale.due), (self.hits, [(x,) for x in scale.hits])):
            state.put(values) if values else state.clear()
        yield pd.DataFrame(out, columns=["d", "h", "level", "s", "hit"])

    def close(self) -> None:
        pass


def calibrated(days: DataFrame) -> DataFrame:
    """A stream of d, h, level, s, hit from a stream of regime.daily_cells() rows.

    The scale of each (h, level) learns of a day's share h sessions later. Days of one batch are taken in
    order; a day at or before the last one that was seen changes nothing, so a replayed batch gives no
    row twice. The state holds h days at most and the last 250 hits, whatever the length of the stream.
    Needs STATE_STORE as the session's state store.
    """
    schema = "d date, h int, level int, s double, hit double"
    return days.groupBy("h", "level").transformWithStateInPandas(_Calibrator(), outputStructType=schema, outputMode="append", timeMode="none")
