"""Weak supervision for document quality: rules vote or abstain, EM learns from their agreement, a posterior decides (JVM only; EM reads counts)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, stored

NGRAM = 8
EM_ROUNDS = 50
#: What the EM starts from and is pulled to: the share of good documents, the chance that a rule of a family votes
#: rightly or, on its own kind of junk, abstains, with this weight in rows.
PRIOR_GOOD, PRIOR_RIGHT, PRIOR_DOUBT, PRIOR_WEIGHT = 0.9, 0.8, 0.2, 20.0
KEEP_FROM = 0.5
#: The family of each rule: symbols, repeats, or none for rules whose votes no other rule can confirm.
FAMILIES = (None, None, 0, 0, 0, 1, 1, 1)
FLOOR = 1e-6
_STATS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_symbol_words", "n_letters", "n_trigrams")


def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_symbol_words, n_letters and n_trigrams (longs) of the whole text.

    Everything happens within the row, in array functions: no shuffle. 8-word windows are compared by
    the 64-bit hash of their words' 64-bit hashes, and so are the different 3-word windows counted. Null
    and empty texts give zeros. Columns __* are this function's own.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__words", F.filter(F.split(t, SPACE), lambda w: w != ""))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    has_symbol = lambda w: w.rlike(r"[#*$%&|<>]")
    df = df.withColumn("n_symbol_words", F.when(F.col("n_symbols") > 0, F.size(F.filter("__words", has_symbol))).otherwise(0).cast("long"))
    df = df.withColumn("n_letters", F.length(F.regexp_replace(t, r"[^\p{L}\p{M}]+", "")).cast("long"))
    df = df.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "__grams",
        F.when(
            F.size("__h") >= NGRAM,
            F.transform(F.sequence(F.lit(1), F.size("__h") - (NGRAM - 1)), lambda i: F.xxhash64(F.slice("__h", i, NGRAM))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    three = lambda i: F.xxhash64(F.get("__h", i - 1), F.get("__h", i), F.get("__h", i + 1))
    trigrams = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("__h") - 2), three)))
    df = df.withColumn("n_trigrams", F.when(F.size("__h") >= 3, trigrams).otherwise(0).cast("long"))
    repeats = F.size(F.array_distinct("__grams")) < F.size("__grams")
    # only for texts that repeat some window: sort windows with their places, keep places of equal neighbours, measure their union
    df = df.withColumn(
        "__sorted",
        F.when(repeats, F.sort_array(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
    )
    same = lambda i, j: F.get("__sorted", i)["g"] == F.get("__sorted", j)["g"]
    df = df.withColumn(
        "__at",
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform("__sorted", lambda x, i: F.struct(x["i"].alias("i"), (F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))).alias("again"))),
                    lambda x: x["again"],
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        "__at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + NGRAM - F.greatest(a["end"], i)).cast("long").alias("n"), (i + NGRAM).alias("end")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.when(F.col("__at").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    return df.drop("__words", "__lines", "__h", "__grams", "__sorted", "__at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> list[Column]:
    """Votes: 1 good, -1 bad, 0 abstains. The first two stand alone, then three on symbols and three on repeats (FAMILIES)."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    mean = F.col("word_chars") / n
    symbols, marked, letters = F.col("n_symbols") / n, F.col("n_symbol_words") / n, F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1))
    repeated, fresh, long_enough = F.col("n_repeat_words") / n, F.col("n_trigrams") / F.greatest(n - 2, F.lit(1)), F.col("n_words") >= 3
    return [
        vote(n < 50, n >= 100),
        vote((mean < 3) | (mean > 10), (mean >= 4) & (mean <= 7)),
        vote(symbols > 1, symbols <= 0.05),
        vote(marked > 0.5, marked <= 0.05),
        vote(letters < 0.7, letters >= 0.9),
        vote(repeated > 0.3, repeated <= 0.05),
        vote(long_enough & (fresh < 0.5), long_enough & (fresh >= 0.8)),
        vote(20 * F.col("n_dup_lines") > n, F.col("n_dup_lines") == 0),
    ]


@dataclass(frozen=True)
class Fitted:
    """weight: the share of each class, the good one first, then one kind of junk for each family; chance[class, rule, vote + 1]."""

    weight: np.ndarray
    chance: np.ndarray

    def shares(self, votes: np.ndarray) -> np.ndarray:
        """P(class | votes) of each row of votes."""
        z = np.log(self.weight) + sum(np.log(self.chance[:, j, votes[:, j] + 1]).T for j in range(votes.shape[1]))
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_rules(votes: DataFrame, families: tuple[int | None, ...] = FAMILIES) -> Fitted:
    """Shares of classes and chances of votes by expectation-maximisation.

    votes has one array column `v`. Documents are first counted by their pattern of votes, of which
    there are at most 3**rules, so that EM itself runs on a table of fixed size, whatever the rows.

    Every rule has, in each class, its own chances of a bad vote, an abstention and a good vote, so a
    doubt tells as much as the data say it does. Junk comes in one kind for each family of rules,
    as symbol junk seldom repeats itself and one table for all junk would let the votes of one kind clear
    the other. What tells a rule that is right from one that is not is whether the rules of its family
    agree with it: a lone bad vote has no kind of its own to go to. Rules without a family start alike
    in all classes. No chance is held above or below anything but FLOOR.
    """
    counted = votes.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()
    v = np.array([r["v"] for r in counted], np.int64).reshape(-1, len(families))
    n = np.array([r["n"] for r in counted], float)
    kinds = 1 + max((f for f in families if f is not None), default=0)
    start = np.empty((1 + kinds, len(families), 3))
    for j, family in enumerate(families):
        all_ = np.array([n[v[:, j] == x].sum() + 1 for x in (-1, 0, 1)])
        start[:, j] = all_ / all_.sum()
        if family is not None:
            wrong = (1 - PRIOR_RIGHT) / 2
            start[0, j] = wrong, wrong, PRIOR_RIGHT
            start[1 + family, j] = 1 - wrong - PRIOR_DOUBT, PRIOR_DOUBT, wrong
    weight0 = np.array([PRIOR_GOOD, *[(1 - PRIOR_GOOD) / kinds] * kinds])
    fitted = Fitted(weight0, start)
    prior = PRIOR_WEIGHT * weight0
    for _ in range(EM_ROUNDS if len(n) else 0):
        q = fitted.shares(v) * n[:, None]
        chance = np.empty_like(start)
        for j in range(len(families)):
            for x in (-1, 0, 1):
                chance[:, j, x + 1] = (q[v[:, j] == x].sum(axis=0) + prior * start[:, j, x + 1]) / (q.sum(axis=0) + prior)
        fitted = Fitted((q.sum(axis=0) + prior) / (n.sum() + PRIOR_WEIGHT), np.maximum(chance, FLOOR))
    return fitted


def posterior(fitted: Fitted) -> Column:
    """P(good | votes): of each class the log of its share and of the chances of the votes, summed in the row."""
    logs = []
    for weight, chances in zip(np.log(fitted.weight).tolist(), np.log(fitted.chance).tolist(), strict=True):
        z = F.lit(weight)
        for rule, (bad, doubt, good) in zip(rules(), chances, strict=True):
            z = z + F.when(rule == -1, bad).when(rule == 1, good).otherwise(doubt)
        logs.append(z)
    return 1 / sum((F.exp(z - logs[0]) for z in logs[1:]), F.lit(1.0))


def judge(stats: DataFrame) -> DataFrame:
    """stats (see text_stats) with p_good, base_failed and kept.

    Rules vote or abstain; their chances among good rows and kinds of junk are estimated from all rows
    without labels, and a row stays if its posterior probability of being good is at least KEEP_FROM and
    no base rule fails. A bad vote of a rule that others do not confirm is outweighed by their good
    ones, and doubts of several rules can drop a row that no rule calls bad. A null or empty text has no
    words and fails; texts of any length are judged whole; equal texts are judged alike; an empty table
    gives no rows.
    """
    fitted = fit_rules(stats.select(F.array(*rules()).alias("v")))
    return (
        stats.withColumn("base_failed", base_failed())
        .withColumn("p_good", posterior(fitted))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM))
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    stats = stored(text_stats(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    return judge(stats).select("doc_id", "n_words", *_STATS, "base_failed", "kept", "p_good", *_MORE)
