"""Results that one query reads several times."""

from __future__ import annotations

from collections import deque

from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Frames that are held at a time; an older one that is let go is computed anew if something still reads it.
HELD = 6
_held: deque[DataFrame] = deque()


def once(df: DataFrame) -> DataFrame:
    """df, kept in memory or on disk after its first reading, so that several branches of a query share it.

    What a lost executor held is computed anew from its lineage. Only the last HELD frames are kept.
    """
    while len(_held) >= HELD:
        try:
            _held.popleft().unpersist()
        except Exception:  # noqa: BLE001  its session has ended
            pass
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(df)
    return df
