"""Quality by weak supervision, in DataFrame operations alone.

Each rule votes for a text (1), against it (-1) or abstains (0). Expectation-maximisation over the votes estimates how
often each rule votes either way on good and on bad texts; it needs the vote patterns' counts
only, of which there are at most 3 ** rules. The posterior probability of a good text then is a sum of log ratios.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE = " \t\n\x0b\f\r"
#: 8-word windows are looked for twice in a text.
WINDOW = 8
#: Fixed values: (rule, measure, votes for within, votes against outside); else the rule abstains.
RULES = [
    ("length", "n_words", (50, 1e12), (20, 1e12)),
    ("word_length", "mean_word", (3.0, 9.0), (2.0, 14.0)),
    ("symbols", "symbols_per_word", (-1.0, 0.05), (-1.0, 0.3)),
    ("symbol_chars", "symbol_share", (-1.0, 0.01), (-1.0, 0.05)),
    ("lines", "dup_line_share", (-1.0, 0.05), (-1.0, 0.3)),
    ("repeats", "repeat_share", (-1.0, 0.05), (-1.0, 0.3)),
    ("line_words", "words_per_line", (5.0, 1e12), (2.0, 1e12)),
]

#: Vote -> (its prior probability on good texts, on bad ones).
PRIOR = {-1: (0.01, 0.2), 0: (0.04, 0.05), 1: (0.95, 0.75)}
#: The assumed share of good texts.
BALANCE = 0.8


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _repeated(hashes: Column) -> Column:
    """Words in windows that occur twice or more: from the array of all windows' hashes, in order."""

    def covered(s: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        places = F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bound(ordered, covered)).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Words are runs of anything but ASCII white space; n_lines counts the lines with a word, n_dup_lines those equal to an
    earlier line; n_repeat_words the words in 8-word windows that stand in the text twice or more, the first included. Null is as empty: all 0.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def of_words(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        windows = _bound(hashed, lambda h: F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))).otherwise(F.array().cast("array<long>")))
        chars = F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
        return F.struct(F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), _bound(windows, _repeated).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    symbols = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in "#*$%&|<>"), F.lit(0).cast("long"))
    got = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _bound(words, of_words).alias("w"), _bound(lines, of_lines).alias("l"), symbols.cast("long").alias("n_symbols"))
    return got.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def measures(feats: DataFrame) -> DataFrame:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return feats.select("*", per("word_chars", "n_words").alias("mean_word"), per("n_symbols", "n_words").alias("symbols_per_word"), per("n_symbols", "word_chars").alias("symbol_share"), per("n_dup_lines", "n_lines").alias("dup_line_share"), per("n_repeat_words", "n_words").alias("repeat_share"), per("n_words", "n_lines").alias("words_per_line"))


def vote(rule: tuple) -> Column:
    _, measure, (lo, hi), (least, most) = rule
    x = F.col(measure)
    return F.when((x < least) | (x > most), -1).when((x >= lo) & (x <= hi), 1).otherwise(0)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, settled: float = 1e-9, belief: float = 0.1, balance: float = BALANCE) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the assumed share of good texts and, for each rule, vote -> (its probability on good texts, on bad ones). It starts from
    the filter that the posterior replaces: texts without a vote against are likely good, others likely not. A prior of
    `belief` times the texts says what a rule is for - votes against are rare on good texts, common on bad ones - lest the
    classes settle on two rules that merely go together; it also keeps every probability above 0.
    """
    n = len(patterns[0][0]) if patterns else 0
    good = [0.1 if min(v, default=0) < 0 else 0.9 for v, _ in patterns]
    share, tables = balance, [PRIOR for _ in range(n)]
    before = None
    for _ in range(rounds):
        total = sum(c for _, c in patterns)
        weight = max(1.0, belief * total)
        g = sum(p * c for p, (_, c) in zip(good, patterns))
        b = total - g
        tables = []
        for j in range(n):
            at = {v: [weight * x for x in PRIOR[v]] for v in (-1, 0, 1)}
            for p, (votes, c) in zip(good, patterns):
                at[votes[j]][0] += p * c
                at[votes[j]][1] += (1 - p) * c
            tables.append({v: (x / (g + weight), y / (b + weight)) for v, (x, y) in at.items()})
        logit = [math.log(share / (1 - share)) + sum(math.log(tables[j][v][0] / tables[j][v][1]) for j, v in enumerate(votes) if v) for votes, _ in patterns]
        good = [1 / (1 + math.exp(-max(-700, min(700, x)))) for x in logit]
        if before is not None and max((abs(x - y) for x, y in zip(good, before)), default=0) < settled:
            break
        before = good
    return share, tables


def posterior(share: float, tables: list[dict[int, tuple[float, float]]], names: list[str]) -> Column:
    """Probability of a good text from its votes; an abstention says nothing."""
    logit = F.lit(math.log(share / (1 - share)))
    for name, told in zip(names, tables):
        ratio = {v: math.log(told[v][0] / told[v][1]) for v in (-1, 1)}
        # whatever the fit says, a vote for never counts against, nor the other way round
        logit = logit + F.when(F.col(name) == 1, max(0.0, ratio[1])).when(F.col(name) == -1, min(0.0, ratio[-1])).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def judge_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple] | None = None, threshold: float = 0.5) -> DataFrame:
    """features() with each rule's vote (vote_<rule>), quality (the posterior, 0 to 1), base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: not base_failed and quality >= threshold.
    Null and empty texts have no words and fail. Ties and repeated rows are judged alike. An empty input gives an empty result.
    """
    rules = RULES if rules is None else rules
    names = [f"vote_{r[0]}" for r in rules]
    feats = stored(features(docs, id_col=id_col, text_col=text_col), "features")
    voted = measures(feats).select(*feats.columns, *[vote(r).alias(n) for r, n in zip(rules, names)])
    rows = voted.groupBy(*names).count().collect()  # 3 ** rules at most
    share, tables = estimate(sorted((tuple(r[n] for n in names), r["count"]) for r in rows))
    if not tables:
        tables = [PRIOR for _ in rules]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.withColumn("quality", posterior(share, tables, names)).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))
