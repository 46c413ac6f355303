"""Sentence-level text-similarity metrics as column expressions; none of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segeval.functions import text
from segeval.functions.expr import let
from segeval.functions.ngrams import text_matches
from segeval.functions.sequence import edit_rate, overlap_f1
from segeval.functions.shifts import shift_rate

# N-gram orders and the recall weight of the two n-gram metrics.
BLEU_ORDERS = 4
CHRF_CHARACTER_ORDERS = 6
CHRF_WORD_ORDERS = 2
CHRF_BETA = 2


def _total(units: Column, order: int) -> Column:
    """Number of n-grams of one order in a text of ``units`` units."""
    return F.greatest(units - (order - 1), F.lit(0))


def _present(*texts: Column) -> Column:
    condition = texts[0].isNotNull()
    for t in texts[1:]:
        condition = condition & t.isNotNull()
    return condition


def bleu(hypothesis: Column, reference: Column) -> Column:
    """Sentence BLEU, 0 to 100: 13a tokens, effective order, exponential smoothing."""
    counts = text_matches(hypothesis, reference, "bleu", BLEU_ORDERS)

    def score(c: Column) -> Column:
        hyp, ref = c[BLEU_ORDERS], c[BLEU_ORDERS + 1]
        log_sum, unmatched = F.lit(0.0), F.lit(0)
        for n in range(1, BLEU_ORDERS + 1):
            total, match = _total(hyp, n), c[n - 1]
            unmatched = unmatched + F.when((total > 0) & (match == 0), 1).otherwise(0)
            # The k-th order without a match counts as half of the one before.
            smoothed = F.when(match > 0, match.cast("double")).otherwise(F.pow(F.lit(0.5), unmatched))
            log_sum = log_sum + F.when(total > 0, F.ln(100.0 * smoothed / total)).otherwise(0.0)
        penalty = F.when(hyp < ref, F.exp(1 - ref / hyp)).otherwise(1.0)
        return F.when(c[0] == 0, 0.0).otherwise(penalty * F.exp(log_sum / F.least(hyp, F.lit(BLEU_ORDERS))))

    return F.when(_present(hypothesis, reference), let(counts, score))


def chrf_plus_plus(hypothesis: Column, reference: Column) -> Column:
    """chrF++, 0 to 100: six character orders, two word orders, recall weighted by beta = 2."""
    counts = F.struct(
        text_matches(hypothesis, reference, "chrf_characters", CHRF_CHARACTER_ORDERS).alias("c"),
        text_matches(hypothesis, reference, "chrf", CHRF_WORD_ORDERS).alias("w"),
    )

    def averages(s: Column) -> Column:
        precision, recall, orders = F.lit(0.0), F.lit(0.0), F.lit(0)
        for counted, last in ((s["c"], CHRF_CHARACTER_ORDERS), (s["w"], CHRF_WORD_ORDERS)):
            for n in range(1, last + 1):
                hyp, ref = _total(counted[last], n), _total(counted[last + 1], n)
                usable = (hyp > 0) & (ref > 0)
                precision = precision + F.when(usable, counted[n - 1] / hyp).otherwise(0.0)
                recall = recall + F.when(usable, counted[n - 1] / ref).otherwise(0.0)
                orders = orders + F.when(usable, 1).otherwise(0)
        return F.struct(
            F.when(orders > 0, precision / orders).otherwise(0.0).alias("p"),
            F.when(orders > 0, recall / orders).otherwise(0.0).alias("r"),
        )

    def score(a: Column) -> Column:
        weight = CHRF_BETA**2
        f = (1 + weight) * a["p"] * a["r"] / (weight * a["p"] + a["r"])
        return F.when(a["p"] + a["r"] > 0, 100.0 * f).otherwise(0.0)

    return F.when(_present(hypothesis, reference), let(let(counts, averages), score))


def bleu_counts(hypothesis: Column, reference: Column) -> Column:
    """What a row adds to the BLEU of many rows: matches per order, n-grams per order, and both lengths."""
    counts = text_matches(hypothesis, reference, "bleu", BLEU_ORDERS)

    def listed(c: Column) -> Column:
        hyp = c[BLEU_ORDERS]
        return F.concat(F.slice(c, 1, BLEU_ORDERS), F.array(*[_total(hyp, n) for n in range(1, BLEU_ORDERS + 1)]), F.slice(c, BLEU_ORDERS + 1, 2))

    return F.when(_present(hypothesis, reference), let(counts, listed))


def corpus_bleu(c: list[Column]) -> Column:
    """BLEU of many rows, 0 to 100, from the sums of ``bleu_counts``: exponential smoothing, all orders count."""
    hyp, ref = c[2 * BLEU_ORDERS], c[2 * BLEU_ORDERS + 1]
    log_sum, unmatched = F.lit(0.0), F.lit(0)
    for match, total in zip(c[:BLEU_ORDERS], c[BLEU_ORDERS : 2 * BLEU_ORDERS]):
        unmatched = unmatched + F.when(match == 0, 1).otherwise(0)
        smoothed = F.when(match > 0, match.cast("double")).otherwise(F.pow(F.lit(0.5), unmatched))
        log_sum = log_sum + F.ln(F.try_divide(100.0 * smoothed, total))
    penalty = F.when(hyp < ref, F.exp(1 - F.try_divide(ref, hyp))).otherwise(1.0)
    # Without a match, or without an n-gram of the longest order, nothing is left to average.
    return F.when((c[0] == 0) | (c[2 * BLEU_ORDERS - 1] == 0), 0.0).otherwise(penalty * F.exp(log_sum / BLEU_ORDERS))


def chrf_counts(hypothesis: Column, reference: Column) -> Column:
    """What a row adds to the chrF++ of many rows: matches, hypothesis and reference n-grams, characters before words."""
    counts = F.struct(
        text_matches(hypothesis, reference, "chrf_characters", CHRF_CHARACTER_ORDERS).alias("c"),
        text_matches(hypothesis, reference, "chrf", CHRF_WORD_ORDERS).alias("w"),
    )

    def listed(s: Column) -> Column:
        match, hyp, ref = [], [], []
        for counted, last in ((s["c"], CHRF_CHARACTER_ORDERS), (s["w"], CHRF_WORD_ORDERS)):
            for n in range(1, last + 1):
                match.append(counted[n - 1])
                ref.append(_total(counted[last + 1], n))
                # A row whose reference has no n-gram of an order does not count for it.
                hyp.append(F.when(ref[-1] > 0, _total(counted[last], n)).otherwise(F.lit(0)))
        return F.array(*match, *hyp, *ref)

    return F.when(_present(hypothesis, reference), let(counts, listed))


def corpus_chrf(c: list[Column]) -> Column:
    """chrF++ of many rows, 0 to 100, from the sums of ``chrf_counts``."""
    orders = CHRF_CHARACTER_ORDERS + CHRF_WORD_ORDERS
    precision, recall, usable_orders = F.lit(0.0), F.lit(0.0), F.lit(0)
    for match, hyp, ref in zip(c[:orders], c[orders : 2 * orders], c[2 * orders :]):
        usable = (hyp > 0) & (ref > 0)
        precision = precision + F.when(usable, match / hyp).otherwise(0.0)
        recall = recall + F.when(usable, match / ref).otherwise(0.0)
        usable_orders = usable_orders + F.when(usable, 1).otherwise(0)
    p, r = (F.coalesce(F.try_divide(total, usable_orders), F.lit(0.0)) for total in (precision, recall))
    weight = CHRF_BETA**2
    return F.coalesce(F.try_divide(100.0 * (1 + weight) * p * r, weight * p + r), F.lit(0.0))


def word_edit_rate(hypothesis: Column, reference: Column) -> Column:
    """Word edits per 100 reference words, without block moves."""
    rate = edit_rate(F.lower(hypothesis), F.lower(reference))
    return F.when(_present(hypothesis, reference), rate)


def translation_edit_rate(hypothesis: Column, reference: Column) -> Column:
    """Word edits per 100 reference words, where moving a run of words is one edit."""
    rate = shift_rate(text.edit_words(hypothesis), text.edit_words(reference))
    return F.when(_present(hypothesis, reference), rate)


def _turned(rate: Column) -> Column:
    """A rate turned around and cut at 0: higher is better, 0 to 1."""
    # `greatest` skips NULL, so a missing rate is kept apart.
    return let(rate, lambda r: F.when(r.isNotNull(), F.greatest(F.lit(0.0), 1 - r / 100)))


def translation_edit_score(hypothesis: Column, reference: Column) -> Column:
    """``translation_edit_rate`` turned around and cut at 0: higher is better, 0 to 1."""
    return _turned(translation_edit_rate(hypothesis, reference))


def word_edit_score(hypothesis: Column, reference: Column) -> Column:
    """``word_edit_rate`` turned around and cut at 0: higher is better, 0 to 1."""
    return _turned(word_edit_rate(hypothesis, reference))


def rouge_l(hypothesis: Column, reference: Column, stem: bool = True, unicode_tokens: bool = False) -> Column:
    """ROUGE-L F1, 0 to 1: longest common subsequence of alphanumeric tokens."""
    texts = [text.spaced_words(t) if unicode_tokens else F.lower(t) for t in (hypothesis, reference)]
    return F.when(_present(hypothesis, reference), overlap_f1(*texts, stem, not unicode_tokens))
