"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote
patterns (at most 3 to the number of rules, whatever the corpus) estimates how often each
rule votes which way for good and bad documents; the posterior probability of good decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopflow.session import cut_lineage

#: name -> (vote bad if, vote good if), over the columns of ``measures``; otherwise it abstains.
RULES = {
    "length": ("false", "n_words between 60 and 100000"),
    "word_length": ("word_chars < 2.2 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.01 * n_words"),
    "letters": ("n_letters < 0.88 * word_chars", "n_letters >= 0.93 * word_chars"),
    "repeated_lines": ("n_dup_lines > 0.5 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    "repeated_words": ("n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.05 * n_words"),
    "same_neighbours": ("n_same > 0.1 * n_words", "n_same <= 0.03 * n_words"),
    "shouting": ("n_upper > 0.4 * n_letters", "n_upper <= 0.15 * n_letters"),
    "exclaiming": ("n_exclaim > 0.1 * n_words", "n_exclaim <= 0.02 * n_words"),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same", "n_upper", "n_letters", "n_exclaim"]


def measures(text: str) -> Column:
    """One struct of counts from one pass over ``text``. Arrays are bound once by one-element transforms."""
    return F.expr(rf"""
    transform(array(coalesce({text}, '')), t -> transform(array(struct(
        filter(split(t, '[ \\t-\\r]+'), w -> w <> '') as w,
        filter(split(t, '\\n'), l -> l rlike '[^ \\t-\\r]') as l)), a -> transform(array(struct(
            transform(a.w, w -> xxhash64(w)) as h)), b -> transform(array(struct(
                case when size(b.h) >= 8 then transform(sequence(1, size(b.h) - 7), i -> xxhash64(slice(b.h, i, 8))) else array() end as g)), c -> named_struct(
        'n_words', cast(size(a.w) as bigint),
        'word_chars', cast(char_length(array_join(a.w, '')) as bigint),
        'n_symbols', cast(char_length(regexp_replace(t, '[^#*$%&|<>]+', '')) as bigint),
        'n_lines', cast(size(a.l) as bigint),
        'n_dup_lines', cast(size(a.l) - size(array_distinct(a.l)) as bigint),
        'n_repeat_words', case when size(array_distinct(c.g)) = size(c.g) then 0L else
            transform(array(array_sort(transform(c.g, (g, i) -> struct(g, i)))), s -> aggregate(array_sort(filter(
                transform(s, (x, j) -> case when (j > 0 and s[j - 1].g = x.g) or (j < size(s) - 1 and s[j + 1].g = x.g) then x.i end),
                x -> x is not null)), struct(-8 as at, 0L as n), (z, x) -> struct(x as at, z.n + least(8, x - z.at) as n), z -> z.n))[0] end,
        'n_same', cast(case when size(b.h) < 2 then 0 else aggregate(sequence(1, size(b.h) - 1), 0, (z, i) -> z + case when b.h[i] = b.h[i - 1] then 1 else 0 end) end as bigint),
        'n_upper', cast(char_length(regexp_replace(t, '\\P{{Lu}}+', '')) as bigint),
        'n_letters', cast(char_length(regexp_replace(t, '\\P{{L}}+', '')) as bigint),
        'n_exclaim', cast(char_length(regexp_replace(t, '[^!]+', '')) as bigint)))[0])[0])[0])[0]
    """)


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation. ``patterns``: votes (1, -1, 0) and their count.

    Returns the log odds of good and, per rule, the log likelihood ratio of each vote. It starts from
    documents with a bad vote as bad (junk comes in kinds that different rules see, so agreement
    of rules is no start). One pseudo-count each way keeps ratios finite; a bad vote never
    speaks for good, nor a good one for bad, and to abstain says nothing.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    log_odds, ratios = 0.0, [{1: 0.0, -1: 0.0, 0: 0.0} for _ in range(n_rules)]
    posterior = [0.05 if -1 in votes else 0.95 for votes, _ in patterns]
    for _ in range(rounds):
        good = [{1: 1.0, -1: 1.0, 0: 1.0} for _ in range(n_rules)]
        bad = [{1: 1.0, -1: 1.0, 0: 1.0} for _ in range(n_rules)]
        total_good = total = 0.0
        for p, (votes, count) in zip(posterior, patterns):
            total_good += p * count
            total += count
            for i, v in enumerate(votes):
                good[i][v] += p * count
                bad[i][v] += (1 - p) * count
        new_odds = math.log((total_good + 1) / (total - total_good + 1))
        new = [{v: math.log((good[i][v] / (total_good + 3)) / (bad[i][v] / (total - total_good + 3))) for v in (1, -1, 0)} for i in range(n_rules)]
        new = [{1: max(0.0, r[1]), -1: min(0.0, r[-1]), 0: 0.0} for r in new]
        moved = max([abs(new_odds - log_odds), *(abs(a[v] - b[v]) for a, b in zip(new, ratios) for v in a)])
        log_odds, ratios = new_odds, new
        posterior = [1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds + sum(r[v] for r, v in zip(ratios, votes)))))) for votes, _ in patterns]
        if moved < 1e-9:
            break
    return log_odds, ratios


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """Votes, posterior and verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    posterior (of good) and kept. Null text has no words, so it fails the base. Equal rows
    give equal results; a null id is returned as null; an empty table gives no rows; other
    columns are ignored. The model is fitted on all rows that pass the base; a table of one
    pattern of votes is all good or all bad.
    """
    flat = cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), measures(f"`{text_col}`").alias("m")).select("doc_id", "m.*")
                       .withColumn("base_failed", F.expr(f"n_words < {min_words} or 100 * n_repeat_words > {repeat_percent} * n_words")))
    votes = F.array(*[F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for bad, good in RULES.values()])
    voted = flat.withColumn("votes", votes)
    # Documents that fail the base are settled; the model is about the others.
    counts = voted.where("not base_failed").groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    log_odds, ratios = fit([(tuple(r.votes), r.n) for r in counts])
    score = F.lit(log_odds)
    for i, r in enumerate(ratios or [{1: 0.0, -1: 0.0, 0: 0.0}] * len(RULES)):
        v = F.col("votes")[i]
        score = score + F.when(v == 1, r[1]).when(v == -1, r[-1]).otherwise(r[0])
    posterior = 1 / (1 + F.exp(-score))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", posterior.alias("posterior"),
                        (~F.col("base_failed") & (posterior >= 0.5)).alias("kept"))
