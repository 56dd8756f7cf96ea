"""Substring deduplication on words by prefix-partitioned suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .repeats import Kind, batched, covered, identified, raw, repeated, split, sums, with_ranges

#: Windows of 20 words; suffixes are dealt by prefixes of 5 words, those of larger groups by 17, then by 20.
WORDS = Kind(words=True, win=20, gram=5, widths=(4, 1))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, text, ranges -> the words that stay."""
    for batch in batches:
        texts = [raw(t) for t in batch.column(2)]
        for i, j in batched(texts):
            data, first, last, bounds = split(texts[i:j])
            stays = ~covered(batch.column(3).slice(i, j - i), bounds, WORDS.win)
            n_words, n_kept = np.diff(bounds), sums(stays, bounds)
            # every word is followed by a white space, which becomes the space that joins, but after the last one
            doc = np.repeat(np.arange(j - i), n_words)[stays]
            a, b = first[stays], last[stays] + 1
            b[np.r_[doc[1:] != doc[:-1], np.ones(min(len(doc), 1), bool)]] -= 1
            kept = np.cumsum(np.bincount(a, minlength=len(data) + 1) - np.bincount(b, minlength=len(data) + 1))[:-1] > 0
            joined = data.copy()
            joined[last[stays]] = 32
            ends = np.r_[0, np.cumsum(np.bincount(doc, b - a, minlength=j - i).astype(np.int64))].astype(np.int32)
            out = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(joined[kept])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), out],
                ["doc_id", "n_words", "n_removed", "kept"],
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words of each text without those of repeated windows, joined by one space.

    Of equal windows the first one stays: that of the smallest doc_id and, within it, of the earliest
    start. Null and empty texts have no words. Rows of a null doc_id come after all others; rows that
    repeat a doc_id come in the order of a hash of their texts, and those that repeat the text too
    count as one document; an empty table gives no rows. Texts are searched in overlapping parts,
    whatever their length; other columns are not read.
    """
    docs = identified(docs)
    found = repeated(docs, WORDS, first_stays=True)
    return with_ranges(docs, found).mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(0, 20) AS r(k)),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
