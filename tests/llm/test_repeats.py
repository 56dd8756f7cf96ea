"""Substring operators on awkward tables: hashes, repeated and missing ids, hot passages, clashing columns."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tidewick.llm import ngram_jaccard, repeats, substring_dedup, suffix_dedup  # noqa: E402


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def words_result(docs):
    out = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("s"))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["s"]) for r in out.collect()), key=str)


def bytes_result(docs):
    out = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s"))
    return sorted((tuple(r) for r in out.collect()), key=str)


def expected(rows, of):
    """The brute-force form of rows whose ids may repeat or be missing: by their place in the order of occurrence."""
    out = of(list(enumerate(t for _, t in rows)))
    return sorted(((d, *out[i]) for i, (d, _) in enumerate(rows)), key=str)


def morse(n: int) -> tuple[str, str]:
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = morse(1024)
    left, right = [f"l{i}" for i in range(30)], [f"r{i}" for i in range(30)]
    rows = [(1, " ".join([*left, a, *right])), (2, " ".join([*left, b, *right]))]
    assert words_result(frame(spark, rows)) == expected(rows, brute.substring)
    rows = [(1, f"{a} two three four five"), (2, f"{b} two three four five")]
    assert {r["component_id"] for r in ngram_jaccard.link_components(frame(spark, rows)).collect()} == {1, 2}


def test_repeated_and_missing_ids(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = prose(70)
    rows = [(1, f"{shared} {prose(20)}"), (1, f"{prose(9)} {shared}"), (2, prose(40)), (None, f"{prose(30)} {shared}"), (None, f"{shared} {prose(7)}")]
    order = {r["text"]: r["h"] for r in frame(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, order[r[1]]))
    assert words_result(frame(spark, rows)) == expected(rows, brute.substring)
    assert bytes_result(frame(spark, rows)) == expected(rows, brute.suffix)
    # rows alike in id and text: one document where it is asked which is first, but two places
    twice = [(7, shared), (7, shared)]
    assert {r[2] for r in words_result(frame(spark, twice))} == {0}
    assert {r[2] for r in bytes_result(frame(spark, twice))} == {len(shared)}


@pytest.mark.parametrize(("runs", "heavy"), [(1, 1024), (3, 2), (4096, 8)])
def test_groups_of_any_size(spark, monkeypatch, runs, heavy):
    monkeypatch.setattr(repeats, "GROUP_RUNS", runs)
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    rnd = random.Random(runs)
    words = [f"w{i}" for i in range(500)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    passage = prose(60)
    rows = [(i, " ".join(prose(25) + passage + prose(25))) for i in range(40)]
    for i in range(40):  # passages that overlap in part
        a = rnd.randrange(40)
        rows.append((100 + i, " ".join(prose(8) + passage[a : a + rnd.randrange(18, 24)] + prose(8) + passage[:a])))
    assert words_result(frame(spark, rows)) == expected(rows, brute.substring)
    assert bytes_result(frame(spark, rows)) == expected(rows, brute.suffix)


def test_one_symbol_over_and_over_and_clashing_columns(spark):
    rows = [(1, "a " * 400), (2, "b" * 900), (3, "b" * 201), (4, None), (5, ""), (6, "c" * 200)]
    docs = frame(spark, rows).withColumns({c: F.lit(1) for c in ("h", "key", "lo", "hi", "u", "n", "runs", "ranges", "__d", "place", "first", "body")})
    assert words_result(docs) == expected(rows, brute.substring)
    assert bytes_result(docs) == expected(rows, brute.suffix)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_thousands_of_equal_rows(spark, doc_id):
    """Rows of one id and text are searched once, so their number costs nothing but their own output."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    text, other = prose(800), prose(60)
    rows = [(doc_id, text)] * 5000 + [(1, f"{other} {text[:900]}"), (2, other), (None, "short"), (None, "short"), (3, None), (3, None)]
    few = [(doc_id, text)] * 2 + rows[5000:]
    got, want = words_result(frame(spark, rows)), words_result(frame(spark, few))
    assert len(got) == len(rows) and set(got) == set(want)
    # equal rows count as one document for words: what the first document lacks, all of them keep
    if doc_id is None:
        one = expected(rows[5000:] + rows[:1], brute.substring)
        assert {x for x in got if x[1] == 800} == {x for x in one if x[1] == 800}
    got = bytes_result(frame(spark, rows))
    assert len(got) == len(rows) and set(got) == set(bytes_result(frame(spark, few)))
    assert {x[2] for x in got if x[1] == len(text)} == {len(text)}  # every string of theirs is there twice
    assert set(expected(few, brute.suffix)) == set(got)
