"""Token arrays: masks after a code fence, forced tokens, and the masked policy objective's value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import let


def _close(ids: Column, think_end: int, fence: int) -> Column:
    """The place of the second fence after a think-end (fences count anew at each), else null.

    The fold's state is one number, as a struct would be made anew for each token: 8 times the place, plus 4 once a
    think-end has been seen, plus the fences since; and -1 minus the place once the second fence is found.
    """
    eight, open_ = F.lit(8).cast("bigint"), F.lit(4).cast("bigint")

    def step(s: Column, t: Column) -> Column:
        place = F.shiftright(s, 3)
        fences = F.when(s.bitwiseAND(open_) == 0, s + eight).when(s.bitwiseAND(F.lit(1).cast("bigint")) == 1, -place - 1).otherwise(s + 9)
        return F.when(s < 0, s).when(t == think_end, place * 8 + 12).when(t == fence, fences).otherwise(s + eight)

    return F.aggregate(ids, F.lit(0).cast("bigint"), step, lambda s: F.when(s < 0, (-s - 1).cast("int")))


def fence_mask(ids: Column, mask: Column, think_end: int, fence: int) -> Column:
    """The mask with zeros after the second fence that follows a think-end."""
    return let(F.struct(_close(ids, think_end, fence).alias("close"), mask.alias("mask")), lambda x: F.when(x["close"].isNull(), x["mask"]).otherwise(F.transform(x["mask"], lambda m, i: F.when(i > x["close"], 0).otherwise(m))))


def fence_done(ids: Column, think_end: int, fence: int) -> Column:
    """Whether a row has two fences after its last think-end. The fold counts them; below zero no think-end has been seen."""
    return F.aggregate(ids, F.lit(-1), lambda s, t: F.when(t == think_end, 0).when((t == fence) & (s >= 0), s + 1).otherwise(s)) >= 2


def budget_reached(ids: Column, budget: int, think_end: int) -> Column:
    return (F.size(ids) == budget) & ~F.array_contains(ids, think_end)


def forced_mask(ids: Column, mask: Column, budget: int, think_end: int) -> Column:
    """The loss mask with a zero at the budget's place if the token there is the (forced) think-end."""
    return let(F.get(ids, F.lit(budget)), lambda t: F.transform(mask, lambda m, i: F.when((i == budget) & (t == think_end), 0).otherwise(m)))


def token_kl(logps: Column, ref: Column, mask: Column) -> Column:
    """exp(r) - r - 1 with r the reference log-ratio, zeroed where masked before the exponential."""
    ratio = F.zip_with(F.zip_with(ref, logps, lambda x, y: x - y), mask, lambda r, m: F.when(m != 0, r).otherwise(0.0))
    return F.transform(ratio, lambda r: F.exp(r) - r - 1)


def masked_loss(logps: Column, ref: Column, advantage: Column, mask: Column, beta: float) -> Column:
    """The masked mean over a row's tokens of -(advantage - beta * kl), at policy ratio 1; at least one token counts in the mean."""
    each = F.zip_with(token_kl(logps, ref, mask), mask, lambda k, m: -(advantage - beta * k) * m)
    add = lambda a, x: a + x
    return F.aggregate(each, F.lit(0.0), add) / F.greatest(F.lit(1.0), F.aggregate(mask, F.lit(0.0), add))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams as strings with single spaces (tokens hold none); none for fewer than n tokens."""

    def grams(t: Column) -> Column:
        last = F.size(t) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(t, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)
