"""Secret scans: fixed patterns plus character Markov models compared by log-likelihood ratio (JVM only)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stored

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: What the models read and judge: tokens of these characters. Hyphens and equals signs join the parts of one.
TOKEN = r"[A-Za-z0-9+/_][A-Za-z0-9+/_=-]{3,}(?<!-)"
PART = r"[A-Za-z0-9+/_]{4,}"
#: Symbols of the models: a-z, A-Z, 0-9 and one for the others; state * SYMBOLS + symbol.
SYMBOLS = 63
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Labelled samples: at most about so many documents with, and without, a match of the fixed patterns, by a hash of doc_id.
SAMPLE_DOCUMENTS = 2000
#: Odds of a secret before looking, as a log; the ratio must exceed it.
LOG_ODDS = 18.0
SMOOTHING = 0.5
#: So many frequent tokens are scored once and for all.
CLEARED = 10000
MASK = "[secret]"


def _matches(text: Column, pattern: str, group: int | None, keep=lambda m: F.lit(True)) -> Column:
    """array<struct<start, end, value>> of leftmost non-overlapping matches for which keep holds, in code points.

    The pieces between matches and the matches themselves alternate, so their lengths give the places.
    """
    gaps = F.split(text, pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    start0 = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    return F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("m"), value.alias("v")),
        start0,
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"),
            F.when(
                keep(x["m"]),
                F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["gap"])).alias("start"), (a["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("end"), x["v"].alias("value")))),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: a["out"],
    )


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


_ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the arrays __assign, __access and __hex of the fixed patterns' spans.

    A plain search for what each pattern cannot do without spares most texts the patterns.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    named = F.lit(False)
    for word in _ASSIGNED:
        named = named | low.contains(word)
    parts = {
        "assign": F.when(named, F.filter(_matches(t, ASSIGN, 2), lambda x: F.length(x["value"]) >= 6)),
        "access": F.when(t.contains("AKIA"), F.filter(_matches(t, ACCESS, None), lambda x: x["end"] - x["start"] >= 20)),
        "hex": F.when(t.rlike(HEX), _matches(t, HEX, None)),
    }
    return df.withColumns({f"__{k}": F.coalesce(v, _none()) for k, v in parts.items()})


def symbols(token: Column) -> Column:
    """The model symbols (0 to SYMBOLS - 1) of a token."""
    return F.transform(F.split(token, ""), lambda c: F.pmod(F.instr(F.lit(_ALPHABET), c) - 1, F.lit(SYMBOLS)))


def pair_counts(tokens: DataFrame) -> list[float]:
    """Counts of symbol pairs in the column `token`: SYMBOLS squared numbers, whatever the rows."""
    pairs = tokens.select(symbols(F.col("token")).alias("s")).select(
        F.explode(F.transform(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda x, i: F.get("s", i) * SYMBOLS + x)).alias("k")
    )
    out = [0.0] * SYMBOLS**2
    for r in pairs.groupBy("k").count().collect():
        out[r["k"]] = float(r["count"])
    return out


def log_ratio(random: list[float], ordinary: list[float]) -> list[float]:
    """log P(symbol | previous, random) - log P(symbol | previous, ordinary), smoothed."""
    import math

    out = []
    for state in range(SYMBOLS):
        rows = [x[state * SYMBOLS : (state + 1) * SYMBOLS] for x in (random, ordinary)]
        sums = [sum(r) + SMOOTHING * SYMBOLS for r in rows]
        out += [math.log((a + SMOOTHING) / sums[0]) - math.log((b + SMOOTHING) / sums[1]) for a, b in zip(*rows, strict=True)]
    return out


def _drawn(doc_id: str, of: int) -> Column:
    """About SAMPLE_DOCUMENTS of so many rows, by a hash of the id."""
    return F.pmod(F.xxhash64(F.lit(3), doc_id), F.lit(1 << 24)) < int(min(1.0, SAMPLE_DOCUMENTS / max(of, 1)) * (1 << 24))


def fit_models(docs: DataFrame, found: DataFrame) -> tuple[list[float], list[str]] | None:
    """The ratio table, and frequent tokens that it clears, from labelled samples: values that the fixed patterns matched are random strings, words of documents without a match ordinary identifiers.

    found: docs after base_spans, without texts. None without either label. The fit reads at most about
    SAMPLE_DOCUMENTS documents of each label, those of the least hashes; what reaches the driver is two
    tables of SYMBOLS squared counts.
    """
    spans = F.concat("__assign", "__access", "__hex")
    n = found.agg(F.count_if(F.size(spans) > 0).alias("hit"), F.count(F.lit(1)).alias("all")).first()
    if not n["hit"] or n["hit"] == n["all"]:
        return None
    random = found.where((F.size(spans) > 0) & _drawn("doc_id", n["hit"])).select(F.explode(spans).alias("s")).select(F.col("s.value").alias("token"))
    rest = base_spans(docs.select("doc_id", "text").where(_drawn("doc_id", n["all"]))).where(F.size(spans) == 0)
    ordinary = rest.select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token"))
    # long tokens are too often random strings themselves to be labels of ordinary ones
    ordinary = ordinary.where(F.length("token") < 16)
    ratio = [round(x, 6) for x in log_ratio(pair_counts(random), pair_counts(ordinary))]
    frequent = ordinary.groupBy("token").count().orderBy(F.desc("count"), "token").limit(CLEARED).collect()
    return ratio, [r["token"] for r in frequent if not _random(r["token"], ratio) and not any(_random(x, ratio) for x in re.split("[=-]+", r["token"]))]


def _random(token: str, ratio: list[float]) -> bool:
    s = [_ALPHABET.find(c) % SYMBOLS for c in token]
    return sum(ratio[a * SYMBOLS + b] for a, b in zip(s, s[1:])) > LOG_ODDS


def judged(found: DataFrame, fitted: tuple[list[float], list[str]] | None) -> DataFrame:
    """found (after base_spans, with its texts) with base, spans, n_assign, n_access and n_hex in place of the arrays."""
    kind = lambda name, k: F.transform(f"__{name}", lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    found = found.withColumn("base", F.sort_array(F.concat(kind("assign", 0), kind("access", 1), kind("hex", 2))))
    if fitted is None:
        more = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    else:
        ratio, cleared = fitted
        table = F.from_json(F.lit(json.dumps(ratio)), "array<double>")
        t = F.coalesce(F.col("text"), F.lit(""))

        def random(token: Column) -> Column:
            s = symbols(token)
            pairs = F.arrays_zip(F.slice(s, 1, F.length(token) - 1).alias("a"), F.slice(s, 2, F.length(token) - 1).alias("b"))
            return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.get(table, p["a"] * SYMBOLS + p["b"])) > LOG_ODDS

        # a random part among ordinary ones counts alone
        some = lambda m: random(m) | (m.rlike("[=-]") & F.exists(F.regexp_extract_all(m, F.lit(PART), F.lit(0)), random))
        rest = F.filter(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), lambda m: ~m.isin(cleared))
        any_ = F.exists(F.array_distinct(rest), some)
        found = found.withColumn("__tokens", F.coalesce(F.when(any_, _matches(t, TOKEN, None, some)), _none()))
        free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        span = lambda x, at=0: F.struct((x["start"] + at).alias("start"), F.lit(3).alias("kind"), (x["end"] + at).alias("end"))
        more = F.flatten(
            F.transform(
                "__tokens",
                lambda x: F.when(free(x) & random(x["value"]), F.array(span(x))).otherwise(
                    F.filter(F.transform(_matches(x["value"], PART, None, random), lambda y: span(y, x["start"])), free)
                ),
            )
        )
    found = found.withColumn("spans", F.sort_array(F.concat("base", more)))
    found = found.withColumns({f"n_{name}": F.size(f"__{name}").cast("long") for name in ("assign", "access", "hex")})
    return found.drop("__assign", "__access", "__hex", "__tokens")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`: array<struct<start, kind, end>> of all secrets of each text, by start, then kind.

    Kinds 0 assign, 1 access, 2 hex (fixed patterns), 3 markov: a token whose log-likelihood ratio
    exceeds LOG_ODDS and which no fixed span overlaps, or else such parts of it. n_assign, n_access, n_hex
    and `base` (the fixed spans) come with it. Every text is read twice: for what the models are fitted
    to, and to be judged by them. Null text counts as empty; equal texts get equal spans; an empty
    table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    found = stored(base_spans(docs).drop("text"))
    return judged(base_spans(docs), fit_models(docs, found)).drop("text")


def spans_text(spans: str) -> Column:
    names = F.array(*[F.lit(x) for x in ("assign", "access", "hex", "markov")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """Pipeline stage: secrets in text give way to MASK; n_chars follows. No row goes."""
    names = docs.columns
    texts = docs.select("doc_id", "text")
    ratio = fit_models(texts, stored(base_spans(texts).drop("text")))
    found = judged(base_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "text")), ratio)
    start0 = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(
        "spans",
        start0,
        lambda a, x: F.when(
            x["end"] > a["at"],
            F.struct(
                x["end"].alias("at"),
                F.when(x["start"] >= a["at"], F.concat(a["out"], F.substr("text", a["at"] + 1, x["start"] - a["at"]), F.lit(MASK))).otherwise(a["out"]).alias("out"),
            ),
        ).otherwise(a),
        lambda a: F.concat(a["out"], F.substr("text", a["at"] + 1, F.length("text"))),
    )
    found = found.withColumn("__text", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")))
    new = {"text": F.col("__text"), "n_chars": F.when(F.size("spans") > 0, F.length("__text").cast("long")).otherwise(F.col("__row.n_chars"))} if "n_chars" in names else {"text": F.col("__text")}
    return found.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in names])


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))
