"""Answers as services return them, turned into probability maps keyed by option id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.binding import let

# Generated keys that are constants of the plan; those of longer lists are made row by row.
LISTED = 16


def binary_answer(p_true: Column) -> Column:
    return F.create_map(F.lit("false"), 1 - p_true, F.lit("true"), p_true)


def _ascending(options: Column) -> Column:
    """Ids of the options by value; equal values keep their order. Options that lie so already are not sorted."""
    keyed = F.transform(
        options, lambda o, i: F.struct(o["value"].alias("value"), i.alias("i"), o["id"].alias("id"))
    )
    values = options["value"]
    return F.when(F.sort_array(values) == values, options["id"]).otherwise(F.array_sort(keyed)["id"])


def _generated(ids: Column, prefix: str) -> Column:
    """The keys 0..k-1 behind a prefix; up to LISTED of them are constants, which stays in generated code."""
    made = F.transform(ids, lambda _, i: F.concat(F.lit(prefix), i.cast("string")))
    listed = F.array(*[F.lit(f"{prefix}{i}") for i in range(LISTED)])
    return F.when(F.array_size(ids) <= LISTED, F.slice(listed, 1, F.array_size(ids))).otherwise(made)


def _pick(ids: Column, raw: Column, prefix: str) -> Column:
    """Raw values by generated key, or NULL when the keys are not exactly 0..k-1.

    Answers usually list the keys in order already; then their values are taken as they are.
    """
    wanted, keys = _generated(ids, prefix), F.map_keys(raw)
    exact = (F.size(F.array_except(wanted, keys)) == 0) & (F.size(wanted) == F.size(keys))
    looked_up = F.transform(wanted, lambda k: F.try_element_at(raw, k))
    return F.map_from_arrays(ids, F.when(keys == wanted, F.map_values(raw)).when(exact, looked_up))


def level_answer(options: Column, raw: Column, ascending: bool = False) -> Column:
    """Score answers keyed by level index."""
    return _pick(_ascending(options) if ascending else options["id"], raw, "")


def anonymous_answer(options: Column, raw: Column) -> Column:
    """Choice answers keyed `option_0`, `option_1`, ..."""
    return _pick(options["id"], raw, "option_")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def renormalized(probabilities: Column, decimals: int = 4) -> Column:
    """Divide by the sum, only if rounding to `decimals` can explain the gap; else NULL."""
    values = F.map_values(probabilities)
    allowed = F.size(values) * F.lit(0.5 * 10.0**-decimals + 1e-6)
    inside = F.forall(values, lambda p: p.between(0.0, 1.0))

    def divided(total: Column) -> Column:
        fits = (total > 0) & (F.abs(total - 1) <= allowed) & inside
        return F.when(fits, F.transform_values(probabilities, lambda _, p: p / total))

    return let(_sum(values), divided)


def softmax(candidates: Column, log_probabilities: Column, temperature: float = 1.0) -> Column:
    """Stable softmax in candidate order; a missing or non-finite candidate gives NULL."""
    scaled = F.transform(
        candidates, lambda c: F.try_element_at(log_probabilities, c) / F.lit(float(temperature))
    )

    def usable(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))

    def shares(weights: Column) -> Column:
        return let(_sum(weights), lambda total: F.transform(weights, lambda w: w / total))

    def weighted(values: Column) -> Column:
        exps = let(F.array_max(values), lambda peak: F.transform(values, lambda v: F.exp(v - peak)))
        return F.when(F.coalesce(F.forall(values, usable), F.lit(False)), let(exps, shares))

    return let(scaled, weighted)


def uniform_answer(options: Column) -> Column:
    """The reference scorer: every option gets 1/k."""
    return F.map_from_arrays(
        options["id"], F.transform(options, lambda _: F.lit(1.0) / F.size(options))
    )


def refusal(answer_type: Column) -> Column:
    """Refused answers become abstentions."""
    return F.when(answer_type == "refusal", F.lit("refusal"))
