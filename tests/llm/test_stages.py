"""Pipeline stages and operators on awkward tables: clashing names, missing and repeated ids, empty tables."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tidewick.llm import exact_dedup, language_id, ngram_jaccard, quality_rules, secret_scans, sentencepieces, sharding  # noqa: E402

CLASHES = ["found", "found_", "digest", "same", "id", "gone", "__digest", "__gone", "__found", "__id", "__d", "__row", "__text", "spans", "g", "n", "h", "keep_id", "component_id", "lang_pred", "score", "kept"]
STAGES = [language_id.keep_identified, exact_dedup.drop_duplicates, ngram_jaccard.keep_one, secret_scans.mask_secrets]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rnd = random.Random(1)
    prose = lambda k: " ".join(rnd.choice(("alpha", "beta", "gamma", "delta", "eins", "zwei")) + rnd.choice("abc") for _ in range(k))
    out = [(i, prose(40), ("en", "de")[i % 2], "s", 1) for i in range(60)]
    out += [(100, out[3][1], "en", "s", 2), (101, out[4][1].upper(), None, "s", 3), (3, out[5][1], "en", "s", 4), (None, out[6][1], "en", None, 5), (None, None, None, None, None)]
    out += [out[7], (200, None, "en", "s", 6), (201, "", "en", "s", 7), (202, "²½①Ⅷ 123", "en", "s", 8), (203, "key password=hunter2secret", "en", "s", 25)]
    return out


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f.__name__)
def test_stage_keeps_columns_and_values(spark, stage):
    plain = spark.createDataFrame(rows(), SCHEMA)
    wide = plain.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in CLASHES})
    out = stage(wide)
    assert out.columns == wide.columns
    found = out.collect()
    assert all(r[c] == f"{c}{'' if r['doc_id'] is None else r['doc_id']}" for r in found for c in CLASHES)
    key = lambda r: str((r["doc_id"], r["text"]))
    assert sorted(map(key, found)) == sorted(map(key, stage(plain).collect()))


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f.__name__)
def test_stage_of_an_empty_table(spark, stage):
    out = stage(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and len(out.columns) == 5


def test_exact_dedup_of_repeated_and_missing_ids(spark):
    out = [(r["doc_id"], r["text"]) for r in exact_dedup.drop_duplicates(spark.createDataFrame(rows(), SCHEMA)).collect()]
    low = [(t or "").translate(brute.LOWER) for _, t in out]
    assert len(set(low)) == len(low) == len({(t or "").translate(brute.LOWER) for _, t, *_ in rows()})
    assert (201, "") in out and (200, None) not in out and (100, rows()[3][1]) in out


def test_near_dedup_of_repeated_and_missing_ids(spark):
    docs = [(1, "a b c d e f g h"), (1, "x y z u v w q r"), (2, "x y z u v w q r"), (3, "a b c d e f g h"), (None, "a b c d e f g h"), (4, None), (5, ""), (5, ""), (6, "one two"), (7, "ONE two")]
    out = ngram_jaccard.link_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in out.collect())
    # each row is in the component of its own text; what is linked with no one but itself is its own component
    assert got == sorted([(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 4, 1), (-1, 4, -1), (4, 0, 4), (5, 0, 5), (5, 0, 5), (6, 1, 6), (7, 1, 6)])


def test_links_across_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    monkeypatch.setattr(ngram_jaccard, "HELD", 50)
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    data = []
    for f in range(8):
        base = [rnd.choice(words) for _ in range(70)]
        for i in range(9):
            copy = base[rnd.randrange(4) :]
            for _ in range(rnd.choice((0, 1, 2))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            data.append((f * 100 + i, " ".join(copy)))
    out = ngram_jaccard.link_components(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute.components(data)


@pytest.mark.parametrize("text", ["²½①", "Ⅷ", "123 !!", "   ", ""])
def test_letterless_texts_have_no_language(spark, text):
    model = language_id.Model(["en"], __import__("numpy").ones(language_id.DIM), __import__("numpy").zeros((1, language_id.DIM)))
    assert model.predict(text) == ("und", 0.0) and model.predict(text + "é")[0] == "en"


def test_language_of_ties_and_equal_texts(spark):
    import numpy as np

    model = language_id.Model(["aa", "bb"], np.ones(language_id.DIM), np.zeros((2, language_id.DIM)))
    assert model.predict("tie") == ("aa", 0.5)
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = language_id.identify(docs, language_id.fit(language_id.training_rows(docs))).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r["text"], set()).add((r["lang_pred"], r["score"]))
    assert all(len(x) == 1 for x in by.values()) and len(out) == len(rows())


def test_quality_statistics_of_awkward_rows(spark):
    texts = [*(t for _, t, *_ in rows()), "w " * 5000, "line\n" * 300, "x" * 100_000]
    docs = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit("z") for c in ("n_words", "votes", "p_good", "__words")})
    out = quality_rules.text_stats(docs.select("doc_id", "text")).collect()
    got = sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out)
    assert got == sorted(brute.quality(t)[:5] for t in texts)


def test_secrets_of_awkward_rows(spark):
    docs = spark.createDataFrame(rows() + [(300, "token=abcdefgh " * 4000, "en", "s", 1), (301, "api_key: AKIA" + "Q" * 20, "en", "s", 1)], SCHEMA)
    out = secret_scans.scan(docs.withColumn("spans", F.lit(1)).withColumn("base", F.lit(2))).collect()
    assert len(out) == len(rows()) + 2
    assert {r["n_assign"] for r in out if r["doc_id"] == 300} == {4000}
    masked = {r["doc_id"]: r["text"] for r in secret_scans.mask_secrets(docs).collect()}
    assert masked[300] == f"{secret_scans.MASK} " * 4000 and "AKIA" not in masked[301] and masked[200] is None


def test_shards_of_repeated_rows(spark):
    data = [(1, 10), (1, 10), (None, 10), (2, 10), (2, 10), (3, 10)]
    out = sharding.byte_shards(spark.createDataFrame(data, "k long, size long").withColumn("__part", F.lit(5)).drop("__part"), ["k"], "size", 3).collect()
    assert sorted(r["shard"] for r in out) == [0, 0, 1, 1, 2, 2]


def test_pieces_of_repeated_rows_and_marks(spark):
    docs = spark.createDataFrame([(1, "a▁b"), (1, "a▁b"), (None, "a b"), (2, None)], "doc_id long, text string").withColumn("ids", F.lit(1))
    out = [(r["doc_id"], tuple(r["ids"]), r["text"]) for r in sentencepieces.decode(sentencepieces.encode(docs)).collect()]
    assert len({i for d, i, _ in out if d != 2}) == 1 and {t for d, _, t in out if d != 2} == {"a b"} and (2, (), "") in out


def _families(spread: int, edits: tuple[int, ...], n: int):
    rnd = random.Random(23)
    words = [f"w{i}" for i in range(400)]
    data = []
    for f in range(3):
        base = [rnd.choice(words) for _ in range(90)]
        for i in range(n):
            copy = base[rnd.randrange(spread) :]
            for _ in range(rnd.choice(edits)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            data.append((f * 1000 + i, " ".join(copy)))
    return data


@pytest.mark.parametrize("edits", [(0, 1), (1, 2, 3), (2, 3, 4, 5)])
def test_what_is_connected_is_not_opened_again(spark, monkeypatch, edits):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    rows, own = [], ngram_jaccard.opened
    monkeypatch.setattr(ngram_jaccard, "opened", lambda docs, jobs: rows.append(jobs.count()) or own(docs, jobs))
    data = _families(4, edits, 40)
    out = ngram_jaccard.link_components(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute.components(data)
    if edits == (0, 1):  # near copies meet in the first round: a document is in few jobs, not in one for each of the ten blocks of its group
        assert rows[0] <= 4 * len(data) and sum(rows) <= 5 * len(data)


def test_texts_that_no_group_opens_are_not_shuffled(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.format_string("text %d", "id").alias("text"))
    jobs = spark.createDataFrame([(k, b"d", (1, 0, 0), 0) for k in (7, 99)], "doc_id long, digest binary, job struct<home:long,i:int,j:int>, side int")
    plan = ngram_jaccard.opened(docs, jobs)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "__w" in line for line in plan.splitlines())
