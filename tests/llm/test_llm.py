"""The training-data operators against brute force, on small and awkward tables."""

from __future__ import annotations

import random
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tidewick.llm import (  # noqa: E402
    components,
    exact_dedup,
    language_id,
    ngram_jaccard,
    packing,
    quality_rules,
    queries,
    secret_scans,
    sentencepieces,
    sharding,
    substring_dedup,
    suffix_dedup,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8))) for _ in range(n)]


def texts() -> list[str | None]:
    rnd = random.Random(5)
    words = vocabulary(1, 400)
    passage = " ".join(rnd.choice(words) for _ in range(60))
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out: list[str | None] = [None, "", "   \n\t ", "a", "Ab c", "é ü ß 日本 😀", "x" * 700, "ab" * 400, "the same line\n" * 40, passage]
    out += [prose(n) for n in (4, 5, 19, 20, 21, 60, 300, 3000)]
    out += [f"{prose(30)} {passage} {prose(25)}" for _ in range(6)]
    base = prose(120).split()
    for k in range(12):  # near copies, with one to twelve changes
        copy = list(base)
        for i in range(k):
            copy[(i * 37 + k) % len(copy)] = f"edit{k}x{i}"
        out.append(" ".join(copy))
    out += ["Exact Copy of a text that is there again and again, in other letters too"] * 5 + ["exact copy of a text that is there again and again, in other LETTERS too"] * 3
    out += [
        'password = "hunter2secret" and api_key: abcd',
        "key AKIA" + "Q7" * 8 + " then 0123456789abcdef0123456789abcdef end, token=abc",
        "secret: Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg== and SECRET='123456'",
        "hash deadbeefdeadbeefdeadbeefdeadbeef",
    ]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(i * 3 + 1, t, ("en", "de", None)[i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(path / "none" / "documents.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(path / "none" / "embeddings.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def result(spark, sf_dir, prefix):
    name = next(k for k in queries.QUERIES if k.startswith(prefix))
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_table(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, f"{sf_dir}/none").collect() == []


def test_op1(spark, sf_dir, rows):
    out = result(spark, sf_dir, "op1_")
    assert out.keys() == rows.keys()
    sizes: dict[int, list] = {}
    for d, r in out.items():
        raw = (rows[d] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "bytes")
        sizes.setdefault(r["shard"], []).append((r["slot"], d, r["size"]))
    total, longest = sum(r["size"] for r in out.values()), max(r["size"] for r in out.values())
    last = -1
    for shard in sorted(sizes):
        own = sorted(sizes[shard])
        assert [s for s, _, _ in own] == list(range(len(own)))
        assert own[0][1] > last and [d for _, d, _ in own] == sorted(d for _, d, _ in own)  # contiguous
        last = own[-1][1]
        assert sum(n for _, _, n in own) < total / 8 + longest


def test_op2(spark, sf_dir, rows):
    for d, r in result(spark, sf_dir, "op2_").items():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(rows[d])
        assert not (r["kept"] and r["base_failed"])


def test_op2_finds_the_worse_rule(spark):
    rnd = random.Random(2)
    votes = []
    for _ in range(2000):
        good = rnd.random() < 0.7
        vote = lambda accuracy: (1 if good else -1) * (1 if rnd.random() < accuracy else -1)  # noqa: E731, B023
        votes.append(([vote(0.95), vote(0.9), vote(0.9), vote(0.6), 0],))
    fitted = quality_rules.fit_rules(spark.createDataFrame(votes, "v array<int>"), (0, 0, 0, 0, None))
    assert abs(fitted.weight[0] - 0.7) < 0.06 and fitted.chance[0, 0, 2] > 0.85 and fitted.chance[0, 3, 2] < 0.75


def test_op2_posterior_alone_drops_symbol_junk(spark):
    rnd = random.Random(6)
    words = vocabulary(8, 400)
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    clean = [(i, " ".join(prose(120))) for i in range(200)]
    junk = [(1000 + i, " ".join(w + rnd.choice(("###", "$$$", "%%%")) for w in prose(120))) for i in range(14)]
    lines = [(2000 + i, "\n".join([" ".join(prose(9))] * 12 + [" ".join(prose(60))])) for i in range(14)]
    docs = spark.createDataFrame(clean + junk + lines, "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality_rules.judge(quality_rules.text_stats(docs)).collect()}
    assert all(out[d]["kept"] for d, _ in clean)
    assert not any(out[d]["kept"] or out[d]["base_failed"] for d, _ in junk)
    assert all(out[d]["p_good"] < quality_rules.KEEP_FROM for d, _ in junk + lines)


def _judged(spark, texts):
    stats = quality_rules.text_stats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    votes = quality_rules.judge(stats).withColumn("v", F.array(*quality_rules.rules()))
    return [r for _, r in sorted((r["doc_id"], r) for r in votes.collect())]


def test_op2_good_votes_outweigh_a_bad_one_that_none_confirms(spark):
    rnd = random.Random(16)
    words = vocabulary(8, 400)
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    junk = [" ".join(w + rnd.choice(("###", "$$$")) for w in prose(120)) for _ in range(40)]
    out = _judged(spark, [" ".join(prose(120)) for _ in range(300)] + [" ".join(prose(30)) for _ in range(20)] + junk)
    short = out[300:320]
    assert all(r["v"][0] == -1 and r["kept"] for r in short)
    assert all(min(r["v"]) == -1 and not r["kept"] for r in out[320:])


def test_op2_doubts_without_any_bad_vote_drop_a_row(spark):
    rnd = random.Random(17)
    words = vocabulary(8, 400)
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    junk = [" ".join(w + rnd.choice(("###", "$$$")) for w in prose(120)) for _ in range(40)]
    tables = [" || ".join(" ".join(prose(2)) for _ in range(60)) for _ in range(40)]
    out = _judged(spark, [" ".join(prose(120)) for _ in range(300)] + junk + tables)
    assert all(r["kept"] for r in out[:300])
    assert all(min(r["v"]) == 0 and not r["kept"] and not r["base_failed"] for r in out[340:])


def test_op2_posterior_by_hand(spark):
    """The posterior of every row is what Bayes' rule gives for the fitted chances."""
    rnd = random.Random(18)
    words = vocabulary(8, 300)
    texts = [" ".join(rnd.choice(words) + rnd.choice(("", "", "##")) * rnd.randint(0, 1) for _ in range(rnd.randint(5, 150))) for _ in range(80)]
    stats = quality_rules.text_stats(spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string"))
    fitted = quality_rules.fit_rules(stats.select(F.array(*quality_rules.rules()).alias("v")))
    for r in quality_rules.judge(stats).withColumn("v", F.array(*quality_rules.rules())).collect():
        each = list(fitted.weight)
        for k in range(len(each)):
            for j, x in enumerate(r["v"]):
                each[k] *= fitted.chance[k, j, x + 1]
        assert abs(r["p_good"] - each[0] / sum(each)) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= quality_rules.KEEP_FROM)


def test_op3(spark, sf_dir, rows):
    for d, r in result(spark, sf_dir, "op3_").items():
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.secrets(rows[d])


def test_op3_finds_random_tokens_beyond_the_patterns(spark):
    rnd = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    words = vocabulary(4, 300)
    prose = lambda: " ".join(rnd.choice(words) for _ in range(80))
    data = [(i, f"{prose()} token={key(24)} {prose()}") for i in range(60)] + [(100 + i, prose()) for i in range(100)]
    planted = [(300 + i, f"{prose()} {key(60)}7 {prose()}") for i in range(20)]
    out = secret_scans.scan(spark.createDataFrame(data + planted, "doc_id long, text string")).select("doc_id", secret_scans.spans_text("spans").alias("s")).collect()
    found = {r["doc_id"] for r in out if "markov" in r["s"]}
    assert len(found & {d for d, _ in planted}) >= 18 and not found & set(range(100, 200))


def test_op3_judges_letters_short_and_hyphenated_tokens(spark):
    rnd = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    key = lambda n, of=letters + "0123456789": "".join(rnd.choice(of) for _ in range(n))
    words = vocabulary(4, 300)
    prose = lambda: " ".join(rnd.choice(words) + rnd.choice(("", "", "", "-" + rnd.choice(words))) for _ in range(80))
    data = [(i, f"{prose()} token={key(40)}") for i in range(400)] + [(500 + i, prose()) for i in range(300)]
    kinds = [lambda: key(24, letters), lambda: key(15), lambda: "-".join(key(n) for n in (8, 4, 4, 4, 12)), lambda: "session-" + key(14) + "="]
    planted = [(1000 + 100 * k + i, prose(), make(), prose()) for k, make in enumerate(kinds) for i in range(10)]
    learn = spark.createDataFrame(data, "doc_id long, text string")
    fitted = secret_scans.fit_models(learn, secret_scans.base_spans(learn))
    docs = spark.createDataFrame(data + [(d, f"{a} {t} {b}") for d, a, t, b in planted], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in secret_scans.judged(secret_scans.base_spans(docs), fitted).collect()}
    for k in range(len(kinds)):
        found = [d for d, a, t, _ in planted if d // 100 == 10 + k and [x for x in out[d] if x["kind"] == 3 and x["start"] <= len(a) + 9 and x["end"] >= len(a) + len(t)]]
        assert len(found) >= (7, 1, 7, 1)[k], (k, len(found))
    assert not [d for d in range(500, 800) if out[d]]


def test_op3_masks(spark):
    data = [(1, "a password=hunter22 b", 21, "en"), (2, "plain", 5, "de"), (3, None, None, None)]
    out = {r["doc_id"]: r for r in secret_scans.mask_secrets(spark.createDataFrame(data, "doc_id long, text string, n_chars long, spans string")).collect()}
    assert (out[1]["text"], out[1]["n_chars"], out[1]["spans"]) == ("a [secret] b", 12, "en")
    assert (out[2]["text"], out[3]["text"]) == ("plain", None)


def test_op4(spark, sf_dir, rows):
    expected = brute.substring(rows.items())
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in result(spark, sf_dir, "op4_").items()} == expected


def test_op5(spark, sf_dir, rows):
    for d, r in result(spark, sf_dir, "op5_").items():
        assert r["held_out"] == (brute.fold(d) == 2) and 0 <= r["score"] <= 1
        if not rows[d] or not any(c.isalpha() for c in rows[d]):
            assert r["lang_pred"] == "und"


def test_op5_held_out_accuracy(spark):
    rnd = random.Random(3)
    kinds = {g: vocabulary(k, 60) for k, g in enumerate(("aa", "bb", "cc"))}
    data = [(i, " ".join(rnd.choice(kinds[g]) for _ in range(12)), g) for i in range(600) for g in [rnd.choice(sorted(kinds))]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = language_id.identify(docs, language_id.fit(language_id.training_rows(docs))).collect()
    held = [r for r in out if brute.fold(r["doc_id"]) == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)


def test_op6(spark, sf_dir, rows):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = [" " * 9000, "a" * 9000, "日本" * 3000, "x" * 4095 + " " + "y" * 4097, "  Hello  world\n\tfoo bar  é̀ ﬁ ", "aaaa aaa aaaaaaaaaaaaaaaaa", "x\x00y 日本語 テスト 😀😀", "the_the==>!!!!!?????-----", None, ""]
    docs = spark.createDataFrame([*rows.items(), *((-1 - i, t) for i, t in enumerate(odd))], "doc_id long, text string")
    for r in sentencepieces.decode(sentencepieces.encode(docs)).join(docs.withColumnRenamed("text", "was"), "doc_id").collect():
        assert r["ids"] == model.encode(r["was"] or "") and r["text"] == (r["was"] or "")


def test_op7(spark, sf_dir, rows):
    out = result(spark, sf_dir, "op7_")
    groups: dict[str, list[int]] = {}
    for d, t in rows.items():
        groups.setdefault(brute.sha((t or "").translate(brute.LOWER).encode()), []).append(d)
    expected = {d: (max(g), len(g), d == max(g), h) for h, g in groups.items() for d in g}
    assert {d: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for d, r in out.items()} == expected


def test_op7_with_a_hot_group_and_repeated_rows(spark):
    data = [(i, "hot" if i % 3 == 0 else f"t{i}", 1) for i in range(3000)] + [(5, "t5", 2), (None, "hot", 3), (None, None, 4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, keep_id long")
    kept = exact_dedup.drop_duplicates(docs).collect()
    assert sum(r["text"] == "hot" for r in kept) == 1 and sum(r["doc_id"] == 5 for r in kept) == 1
    assert len(kept) == 2000 + 1 + 1 and set(kept[0].asDict()) == {"doc_id", "text", "keep_id"}


def test_op8(spark, sf_dir, rows):
    expected = brute.suffix(rows.items())
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in result(spark, sf_dir, "op8_").items()} == expected


def test_long_documents_are_searched_in_parts(spark, monkeypatch):
    from tidewick.llm import repeats

    monkeypatch.setattr(repeats, "BUFFER", 1 << 12)  # travels to the workers with the code
    rnd = random.Random(8)
    words = vocabulary(6, 500)
    long = " ".join(rnd.choice(words) for _ in range(9000))
    data = [(1, long), (2, long[20000:41000]), (3, " ".join(rnd.choice(words) for _ in range(50)))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept"].encode())) for r in substring_dedup.remove_repeats(docs).collect()}
    assert out == brute.substring(data)
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"]))) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert out == brute.suffix(data)


def test_op9(spark, sf_dir, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    name = next(k for k in queries.QUERIES if k.startswith("op9_"))
    pieces = queries.QUERIES[name](spark, sf_dir).collect()
    import struct

    for d, t in rows.items():
        ids = [*encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted((r for r in pieces if r["doc_id"] == d), key=lambda r: r["start"]):
            raw = struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]])
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(raw), len(ids))
            at += r["length"]
        assert at == len(ids)
    by: dict[int, list] = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # no sequence is padded


def test_op9_fill_leaves_no_padding():
    import numpy as np

    rnd = np.random.default_rng(1)
    sizes = [int(n) for n in (*rnd.choice(packing.TIERS, 300), *rnd.integers(1, 256, 900), *rnd.integers(257, 9000, 200))]
    found = packing.fill([p for d, n in enumerate(sizes) for p in packing.routed(d, n)])
    assert {t for t, _ in found.windows} == set(packing.TIERS) and all(sum(p.length for p in w) == t for t, w in found.windows)
    windows = found.windows + packing.close(found.left)
    assert all(n & (n - 1) == 0 and sum(p.length for p in w) == n for n, w in windows)
    by: dict[int, list] = {}
    for _, w in windows:
        for p in w:
            by.setdefault(p.doc, []).append((p.start, p.length))
    for d, n in enumerate(sizes):
        at = 0
        for start, length in sorted(by[d]):
            assert start == at
            at += length
        assert at == n
    # each tier is packed on its own: most windows begin with a document of that tier, and few documents are cut
    assert sum(map(len, (w for _, w in windows))) < 1.6 * sum(len(packing.routed(0, n)) for n in sizes)
    steps = packing.dealt(windows)
    cost = np.bincount(steps, [sum(p.length**2 for p in w) for _, w in windows])
    assert cost.max() < 2 * cost.min()


def test_op9_awkward_texts(spark):
    import struct

    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    texts = [" " * 1_200_000, "a" * 300_000, "\n" * 300_000, "x <|endoftext|> y", "one <|endoftext|>", "\ud7ff é 😀", None, ""]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "no id")], "doc_id long, text string").withColumn("start", F.lit("s"))
    rows = packing.pack(docs.repartition(3)).collect()
    for d, t in enumerate(texts):
        ids = [*encode(t or "", add_special_tokens=False).ids, 1]
        own = {(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == d}
        assert all(zlib.crc32(struct.pack(f"<{n}I", *ids[a : a + n])) == crc and total == len(ids) for a, n, crc, total in own)
        assert sum(r["length"] for r in rows if r["doc_id"] == d) == len(ids) * (2 if d == 3 else 1)
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == len(encode("no id").ids) + 1


def test_op10(spark, sf_dir, rows):
    expected = brute.components(rows.items())
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in result(spark, sf_dir, "op10_").items()} == expected


def test_op10_with_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    rnd = random.Random(4)
    words = vocabulary(2, 900)
    base = [rnd.choice(words) for _ in range(90)]
    data = []
    for i in range(150):
        copy = list(base)
        for _ in range(rnd.choice((0, 1, 2, 3, 6))):
            copy[rnd.randrange(90)] = rnd.choice(words)
        data.append((i, " ".join(copy)))
    data += [(200 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 60)))) for i in range(60)]
    out = ngram_jaccard.link_components(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute.components(data)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (100, 102), (7, 7)]
    out = {r["node"]: r["label"] for r in components.connected(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {k: v for k, v in out.items() if k != v} == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        kept = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and {r["doc_id"] for r in kept} <= set(before)
        seen[name] = (before, kept)
        docs, last = spark.createDataFrame(kept, out.schema), kept
    before, kept = seen["ngram_jaccard"]
    comp = brute.components([(d, r["text"]) for d, r in before.items()])
    assert {r["doc_id"] for r in kept} == {d for d, (_, c) in comp.items() if c == d}
    before, kept = seen["exact_dedup"]
    assert len({(r["text"] or "").translate(brute.LOWER) for r in kept}) == len(kept) == len({(r["text"] or "").translate(brute.LOWER) for r in before.values()})

    def tokens(rows):  # where documents are cut depends on which ones a task has
        out: dict = {}
        for r in rows:
            out.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        assert all(sum(n for _, n in own) == total and sorted(own)[0][0] == 0 for (_, total), own in out.items())
        return sorted(out)

    assert tokens(corpus_pipeline.run(spark, sf_dir).collect()) == tokens(last)


def test_digest_of_every_letter_kind(spark):
    rows = [(t, brute.sha((t or "").translate(brute.LOWER).encode())) for t in ("ÀB c", "PLAIN", "İstanbul", None, "")]
    for r in spark.createDataFrame(rows, "text string, e string").select(exact_dedup.digest(F.col("text")).alias("h"), "e").collect():
        assert r["h"] == r["e"]


def test_sharding_of_one_huge_row(spark):
    rows = spark.createDataFrame([(1, 5), (2, 10_000), (3, 5), (4, 5)], "k long, size long")
    out = {r["k"]: r["shard"] for r in sharding.byte_shards(rows, ["k"], "size", 4).collect()}
    assert out[1] == out[2] == 0 and out[3] == 3


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    from oracle import difference

    assert difference(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLES[name]) == ""
