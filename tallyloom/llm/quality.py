"""Quality rules as weak supervision, in DataFrame functions only.

Rules over counts of a text vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the vote patterns
estimates how often each rule is right and how many documents are good; a document's posterior probability of being good
follows from its votes. There are 3 ** rules patterns at most whatever the number of documents, and only
their counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import SPACE_CLASS, ids_and_text, materialize

WINDOW = 3
SYMBOLS = "#*$%&|<>"
#: Documents below this many words, or with more than half of them repeated, fail whatever the votes are.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Rounds of expectation-maximisation, and the range in which accuracies stay: a rule never counts as worse than chance.
ROUNDS, LEAST_RIGHT, MOST_RIGHT = 50, 0.55, 0.99


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def _covered(positions: Column) -> Column:
    """Words that windows at these ascending positions cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda s, p: F.struct((s.n + (p + WINDOW) - F.greatest(p, s.end)).alias("n"), (p + WINDOW).alias("end"))
    return F.aggregate(positions, start, step, lambda s: s.n)


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, the first occurrence included."""

    def of(ws: Column) -> Column:
        hashed = F.transform(ws, lambda w, i: F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, WINDOW))))
        return let(F.slice(hashed, 1, F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0))), sorted_runs)

    def sorted_runs(hs: Column) -> Column:
        keyed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(let(keyed, positions))

    def positions(ks: Column) -> Column:
        same = F.filter(ks, lambda k, j: F.coalesce(k.h == F.get(ks, j - 1).h, F.lit(False)) | F.coalesce(k.h == F.get(ks, j + 1).h, F.lit(False)))
        return _covered(F.sort_array(F.transform(same, lambda k: k.i)))

    return let(words, of)


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules vote on, one row for each row of docs. Null texts count as empty: all counts are 0."""
    rows = ids_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    spread = lambda keep: F.length("text") - F.length(F.translate("text", keep, ""))
    base = let(
        words_of(F.col("text")),
        lambda ws: F.struct(F.size(ws).alias("n_words"), repeated_words(ws).alias("n_repeat_words")),
    )
    line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return (
        rows.select(
            "doc_id",
            base.alias("w"),
            line.alias("l"),
            F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).alias("word_chars"),
            spread(SYMBOLS).alias("n_symbols"),
            spread("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
            spread("0123456789").alias("n_digits"),
        )
        .select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_digits")
        .select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits")))
    )


def _bands(part: str, whole: str, good: int, bad: int) -> Column:
    """Good up to `good` percent of the whole, bad beyond `bad` percent, else no vote."""
    x, y = F.col(part) * 100, F.col(whole)
    return F.when(y == 0, 0).when(x <= y * good, 1).when(x > y * bad, -1).otherwise(0)


def default_rules() -> dict[str, Column]:
    """Votes of each rule, in whole numbers, so that they are alike wherever they are computed."""
    return {
        "length": F.when(F.col("n_words") >= 100, 1).when(F.col("n_words") < LEAST_WORDS, -1).otherwise(0),
        "repetition": _bands("n_repeat_words", "n_words", 10, 30),
        "symbols": _bands("n_symbols", "n_words", 2, 10),
        "lines": _bands("n_dup_lines", "n_lines", 5, 30),
        "capitals": _bands("n_upper", "word_chars", 20, 50),
        "digits": _bands("n_digits", "word_chars", 10, 30),
        "word_length": F.when(F.col("n_words") == 0, 0)
        .when((F.col("word_chars") >= 3 * F.col("n_words")) & (F.col("word_chars") <= 12 * F.col("n_words")), 1)
        .when((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")), -1)
        .otherwise(0),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """Share of good documents and each rule's accuracy, by expectation-maximisation over (votes, documents)."""
    share, right = 0.5, [0.8] * rules
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good, agreed, voted = 0.0, [0.0] * rules, [0.0] * rules
        for votes, n in patterns:
            p = n * posterior(votes, share, right)
            good += p
            for r, v in enumerate(votes):
                if v:
                    voted[r] += n
                    agreed[r] += p if v > 0 else n - p
        share = min(max(good / total, 0.01), 0.99)
        right = [min(max(a / v, LEAST_RIGHT), MOST_RIGHT) if v else x for a, v, x in zip(agreed, voted, right)]
    return share, right


def posterior(votes: tuple[int, ...], share: float, right: list[float]) -> float:
    odds = math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, right))
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame, rules: Mapping[str, Column] | None = None, least: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """Counts, base_failed, quality (posterior probability, 6 decimals) and kept of every row.

    kept is false where base_failed is true, else whether quality is `least` or more. Null and empty texts fail.
    Repeated rows each have a row, an empty table gives an empty table, and other columns are ignored.
    """
    rules = dict(rules or default_rules())
    counts = materialize(text_counts(docs), "text-counts")
    voted = counts.select("*", *(v.alias(f"vote_{k}") for k, v in rules.items()))
    names = [f"vote_{k}" for k in rules]
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect()]  # at most 3 ** rules
    share, right = estimate(patterns, len(names), rounds)
    odds = sum((F.col(n) * F.lit(math.log(a / (1 - a))) for n, a in zip(names, right)), F.lit(math.log(share / (1 - share))))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return voted.select(
        *counts.columns, *names, failed.alias("base_failed"), F.round(1 / (1 + F.exp(-odds)), 6).alias("quality")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
