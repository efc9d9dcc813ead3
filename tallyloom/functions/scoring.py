"""Row-level scoring of one prediction against one soft target.

`p` and `t` are probability arrays in candidate order, see `aligned`; `probabilities` and
`target` are maps keyed by option id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.constants import SUM_TOLERANCE


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def aligned(options: Column, values: Column) -> Column:
    """Map values as an array in candidate order.

    Maps usually list the candidates in their own order already; then the values are taken
    as they are, which stays in generated code, and nothing is looked up per candidate.
    """
    looked_up = F.transform(options, lambda o: F.try_element_at(values, o["id"]))
    return F.when(F.map_keys(values) == options["id"], F.map_values(values)).when(
        values.isNotNull(), looked_up
    )


def chosen_position(p: Column) -> Column:
    """One-based position of the highest value; the first one wins exact ties."""
    return F.array_position(p, F.array_max(p))


def _at(array: Column, position: Column) -> Column:
    return F.get(array, (position - 1).cast("int"))


def chosen_id(options: Column, p: Column) -> Column:
    return _at(options["id"], chosen_position(p))


def choice_credit(p: Column, t: Column) -> Column:
    """Target mass of the chosen candidate."""
    return _at(t, chosen_position(p))


def binary_brier(probabilities: Column, target: Column) -> Column:
    gap = F.try_element_at(probabilities, F.lit("true")) - F.try_element_at(target, F.lit("true"))
    return gap * gap


def _width(options: Column) -> Column:
    return F.array_max(options["value"]) - F.array_min(options["value"])


def score_error(options: Column, p: Column, t: Column) -> Column:
    """Signed expected-value error over the width of the original scale."""
    gap = F.zip_with(p, t, lambda a, b: a - b)
    terms = F.zip_with(options["value"], gap, lambda v, g: v * g)
    return F.try_divide(_total(terms), _width(options))


def normalized_expectation(options: Column, p: Column) -> Column:
    """Expected value with the scale mapped to [0, 1].

    Low end and width are taken out of the sum: what stands inside a lambda is evaluated once
    per element, what is an argument of `zip_with` once per row.
    """
    weighted = F.zip_with(options["value"], p, lambda v, x: v * x)
    low = F.array_min(options["value"])
    return F.try_divide(_total(weighted) - low * _total(p), _width(options))


def _area(box: Column) -> Column:
    return (box["right"] - box["left"]) * (box["bottom"] - box["top"])


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; an empty union scores zero."""
    wide = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    tall = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    shared = F.greatest(wide, F.lit(0.0)) * F.greatest(tall, F.lit(0.0))
    union = _area(a) + _area(b) - shared
    return F.when(union > 0, shared / union).when(union <= 0, F.lit(0.0))


def restored_box(box: Column, payload_size: Column, content_rectangle: Column) -> Column:
    """A box on the padded payload, moved back to the edges of the original image."""

    def edge(name: str, extent: int) -> Column:
        pixels = box[name] * F.get(payload_size, F.lit(extent)) - F.get(
            content_rectangle, F.lit(extent)
        )
        share = F.try_divide(pixels, F.get(content_rectangle, F.lit(extent + 2)))
        return F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))

    return F.struct(
        edge("left", 0).alias("left"),
        edge("top", 1).alias("top"),
        edge("right", 0).alias("right"),
        edge("bottom", 1).alias("bottom"),
    )


def soft_confusion(p_true: Column, target: Column, abstained: Column) -> dict[str, Column]:
    """Fractional confusion cells at p >= 0.5; an abstention is wrong for both classes."""
    positive = F.try_element_at(target, F.lit("true"))
    negative = F.try_element_at(target, F.lit("false"))
    yes, no = p_true >= 0.5, p_true < 0.5
    return {
        "true_positive": F.when(yes, positive).when(no | abstained, F.lit(0.0)),
        "false_positive": F.when(yes | abstained, negative).when(no, F.lit(0.0)),
        "false_negative": F.when(no | abstained, positive).when(yes, F.lit(0.0)),
        "true_negative": F.when(no, negative).when(yes | abstained, F.lit(0.0)),
    }


def clip_unit(value: Column) -> Column:
    """Clip to [0, 1]. The guard matters: greatest and least skip NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def valid_probabilities(probabilities: Column, ids: Column) -> Column:
    """Keys equal the option ids, values lie in [0, 1] and sum to one."""
    values = F.map_values(probabilities)
    total = _total(values)
    keys = F.map_keys(probabilities)
    close = F.abs(total - 1) <= F.greatest(
        F.lit(SUM_TOLERANCE), F.lit(1e-9) * F.greatest(F.abs(total), F.lit(1.0))
    )
    # Most answers name the options in their order; only others are compared as sets.
    same = (keys == ids) | (F.size(F.array_except(keys, ids)) == 0) & (F.size(F.array_except(ids, keys)) == 0)
    inside = F.forall(values, lambda p: p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0))
    return F.coalesce(same & inside & close, F.lit(False))
