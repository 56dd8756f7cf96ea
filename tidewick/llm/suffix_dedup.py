"""Deduplication of repeated byte strings over all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .repeats import Kind, batched, covered, identified, raw, repeated, sums, with_ranges

#: Strings of 200 bytes.
BYTES = Kind(words=False, win=200, gram=24, widths=(40, 6, 1))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, text, ranges -> the bytes that stay."""
    for batch in batches:
        texts = [raw(t) for t in batch.column(2)]
        for i, j in batched(texts):
            data, bounds = BYTES.symbols(texts[i:j])
            gone = covered(batch.column(3).slice(i, j - i), bounds, BYTES.win)
            before = np.r_[np.zeros(min(len(gone), 1), bool), gone[:-1]]
            starts = bounds[:-1][bounds[:-1] < len(gone)]
            before[starts] = False
            n_bytes, n_removed = np.diff(bounds), sums(gone, bounds)
            ends = np.r_[0, np.cumsum(n_bytes - n_removed)].astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(data[~gone])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, sums(gone & ~before, bounds))), kept],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the UTF-8 bytes of each text without strings that occur twice.

    Every occurrence of a repeated string goes. Null counts as empty. Rows of a null doc_id and rows
    that repeat a doc_id are documents like others, so rows of equal texts lose all strings that they
    have; an empty table gives no rows. Texts are searched in overlapping parts, whatever their
    length; other columns are not read.
    """
    docs = identified(docs)
    found = repeated(docs, BYTES, first_stays=False)
    return with_ranges(docs, found).mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
