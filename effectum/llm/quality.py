"""Quality rules with risk-controlled cutoffs, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: What a word is not, and the characters that count as symbols.
BLANK, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: At most this share of good documents of a stratum may be rejected by all rules together, with this chance of any error in any stratum.
MAX_REJECTED, ERROR = 0.03, 0.05
#: Cutoffs of each rule, the loosest first. A rule rejects if 1000 * measure > cutoff * per.
RULES = {
    "n_symbols": ("n_words", (2000, 1000, 700, 500, 300, 200, 150, 100, 70, 50)),
    "n_marks": ("n_words", (2000, 1000, 700, 500, 300, 200, 150, 100)),
    "n_dup_lines": ("n_lines", (900, 800, 700, 600, 500, 400, 300)),
    "n_repeat_words": ("n_words", (290, 270, 250, 220, 200)),
    "word_chars": ("n_words", (30000, 25000, 20000, 17000, 15000, 13000, 12000)),
}
WINDOW = 8
#: Strata up to which the table of their steps is broadcast, which is counted.
BROADCAST_STRATA = 10_000


def path() -> dict[tuple[str, int], int]:
    """The step at which each cutoff of each rule comes into force: all first ones at step 0, then in turn the next one of each rule.

    Each step rejects what those before reject, and more.
    """
    later = [(rule, i) for i in range(1, max(len(g) for _, g in RULES.values())) for rule, (_, g) in RULES.items() if i < len(g)]
    return {(rule, 0): 0 for rule in RULES} | {x: n for n, x in enumerate(later, 1)}


STEPS = 1 + max(path().values())


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur more than once in the text.

    Windows are compared by a 64-bit hash. Only where fewer distinct hashes than windows are found, the windows
    are sorted by hash and place, and the stretches that repeated ones cover are added up.
    """

    def covered(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])

        sorted_ = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(sorted_, of_sorted))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(hashes, covered))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row's id and stratum (its language), with n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines and n_repeat_words.

    A null text has none of each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    word_lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    lines = let(word_lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    counted = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat")))
    first = docs.select(F.col("doc_id"), F.col("lang").alias("stratum"), (F.char_length(text) - gone(BLANK)).alias("word_chars"), gone(SYMBOLS).alias("n_symbols"), gone("!").alias("n_marks"), lines.alias("l"), counted.alias("w"))
    long = lambda c, name: c.cast("long").alias(name)
    return first.select(
        "doc_id", "stratum", long(F.col("w.n"), "n_words"), long(F.col("word_chars"), "word_chars"), long(F.col("n_symbols"), "n_symbols"), long(F.col("n_marks"), "n_marks"), long(F.col("l.n"), "n_lines"), long(F.col("l.dup"), "n_dup_lines"), long(F.col("w.repeat"), "n_repeat_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rejected_from() -> Column:
    """The first step at which a document is rejected; STEPS if at none."""
    at = path()
    firsts = []
    for rule, (per, grid) in RULES.items():
        case = F.lit(STEPS)
        for i, cutoff in reversed(list(enumerate(grid))):
            case = F.when(1000 * F.col(rule) > cutoff * F.col(per), at[rule, i]).otherwise(case)
        firsts.append(case)
    return F.least(*firsts)


def binomial_at_most(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X from n trials with chance p, summed exactly in logarithms; 1 where k > n p, as no bound can hold there.

    A term is the one before times (n - j) / (j + 1) * p / (1 - p).
    """
    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + odds
        top = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(a["sum"], term) - top))).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k > n * p, 1.0).otherwise(F.aggregate(terms, start, step, lambda a: F.exp(a["sum"])))


def cutoffs(measured: DataFrame, labels: DataFrame, *, max_rejected: float = MAX_REJECTED, error: float = ERROR) -> DataFrame:
    """A row for each stratum with labelled good documents: the last step that is safe, or -1, and the hold-out's n and rejected documents there.

    The good among the labelled documents that pass the base rules are the hold-out; a doc_id counts once, in the least of its strata and as
    rejected if any of its rows is. For a step, the exact binomial test asks whether all rules together may reject ``max_rejected`` or more of all good
    documents, given how many of the hold-out they reject. Steps are tested in their order and testing stops at the first that isn't shown
    to be safe, so a stratum spends its error once; over the strata found it is divided (Bonferroni). Labels that contradict each other make a document not good.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("good_id"))
    held = measured.where(~base_failed()).join(good, F.col("doc_id") == F.col("good_id"), "left_semi")
    once = held.groupBy("doc_id").agg(F.min("stratum").alias("stratum"), F.min(rejected_from()).alias("from"))
    sums = once.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("from") <= i).alias(f"k{i}") for i in range(STEPS)])
    sums = materialise(sums, "holdout")
    share = error / max(sums.count(), 1)
    safe = F.array(*[binomial_at_most(F.col("n"), F.col(f"k{i}"), max_rejected) <= share for i in range(STEPS)])
    first_unsafe = F.array_position(safe, False)
    last = F.when(first_unsafe == 0, STEPS - 1).otherwise(first_unsafe - 2).cast("int")
    return sums.select("stratum", "n", last.alias("step"), F.get(F.array(*[F.col(f"k{i}") for i in range(STEPS)]), last).alias("rejected"))


def judge(docs: DataFrame, labels: DataFrame, *, max_rejected: float = MAX_REJECTED, error: float = ERROR) -> DataFrame:
    """Measures of every document, base_failed, and kept: whether it passes the base rules and all cutoffs of its stratum.

    A null text has no words and fails the base rules. A null language is a stratum too. In a stratum without labels there is no safe cutoff, and the base rules
    alone decide. Repeated rows give repeated results; an empty table gives no rows; other columns don't matter.
    """
    measured = materialise(measures(docs), "measures")
    cuts = materialise(cutoffs(measured, labels, max_rejected=max_rejected, error=error).select(F.col("stratum").alias("of"), "step"), "cutoffs")
    few = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    out = measured.join(few, F.col("stratum").eqNullSafe(F.col("of")), "left")
    over = rejected_from() <= F.coalesce("step", F.lit(-1))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"))
