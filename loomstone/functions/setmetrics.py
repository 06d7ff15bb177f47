"""Set metrics over sorted id arrays, as column expressions.

Four rules exist side by side.  ``canonical``: two empty sets score 1; null counts as empty; a failed
record scores 0.  ``executor``: two empty sets score 0 but match.  ``reporting``: as canonical, the match
as a double.  ``staged``: a null prediction scores 0 throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _empty(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<bigint>"))


def metrics(pred: Column, gold: Column, rule: str = "canonical", failed: Column | None = None) -> dict[str, Column]:
    """exact_match, precision, recall and f1."""
    p, g = _empty(pred), _empty(gold)
    hits = F.size(F.array_intersect(p, g)).cast("double")
    both = (F.size(p) == 0) & (F.size(g) == 0)
    zero = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    if rule == "staged":
        zero = zero | pred.isNull()
    full = F.lit(0.0 if rule == "executor" else 1.0)

    def score(value: Column) -> Column:
        return F.when(zero, 0.0).when(both, full).otherwise(F.coalesce(value, F.lit(0.0)))

    precision, recall = F.try_divide(hits, F.size(p)), F.try_divide(hits, F.size(g))
    same = (F.size(p) == F.size(g)) & (hits == F.size(p))
    match = F.when(zero, 0).when(same, 1).otherwise(0)
    return {
        "exact_match": match.cast("double") if rule == "reporting" else match,
        "precision": score(precision),
        "recall": score(recall),
        "f1": score(F.try_divide(2 * hits, F.size(p) + F.size(g))),
    }


def missing(pred: Column, gold: Column, failed: Column | None = None) -> Column:
    """Gold that isn't predicted, sorted; all of it for a failed record."""
    out = F.array_sort(F.array_except(_empty(gold), _empty(pred)))
    return out if failed is None else F.when(failed, F.array_sort(_empty(gold))).otherwise(out)


def extra(pred: Column, gold: Column) -> Column:
    return F.array_sort(F.array_except(_empty(pred), _empty(gold)))


def contains_gold(pred: Column, gold: Column) -> Column:
    """1 if the prediction holds all gold; 0 for a null prediction."""
    return F.when(pred.isNull(), 0).when(F.size(F.array_except(gold, pred)) == 0, 1).otherwise(0)


def symbolic_intersection(branches: list[Column]) -> Column:
    """The intersection of branch predictions; null if any is null."""
    out = branches[0]
    for b in branches[1:]:
        out = F.array_intersect(out, b)
    return F.array_sort(out)


def compared(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """better, worse or tie."""
    return F.when(a - b > eps, "better").when(a - b < -eps, "worse").otherwise("tie")
