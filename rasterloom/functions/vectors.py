"""Column expressions over array<float|double> vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def vec(values: Sequence[float]) -> Column:
    """A constant vector, as one parsed literal instead of a call per number."""
    return F.expr(_literal(values))


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    """A constant array of vectors."""
    return F.expr(f"array({', '.join(_literal(r) for r in rows)})")


def _literal(values: Sequence[float]) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def dot(a: Column, b: Column) -> Column:
    """Inner product, accumulated in double."""
    products = F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    A lambda evaluates what it refers to anew for every element; a norm used
    inside a transform would be summed once per component without this.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scale(a: Column, divisor: Column) -> Column:
    return bind(divisor, lambda d: F.transform(a, lambda v: v.cast("double") / d))


def l2_normalize(a: Column, eps: float = EPS) -> Column:
    """a / (|a| + eps); a zero vector stays zero for eps > 0."""
    return scale(a, norm(a) + F.lit(eps))


def relevancy(positives: Column, negatives: Column, temperature: float = 10.0) -> Column:
    """Per positive score its smallest two-way softmax against the negative scores.

    The softmax falls as the negative grows, so only the largest negative counts.
    """
    one = F.lit(1.0)

    def against(worst: Column) -> Column:
        return F.transform(positives, lambda p: one / (one + F.exp(F.lit(-temperature) * (p - worst))))

    return bind(F.array_max(negatives), against)


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Softmax over an array, shifted by its maximum so that exp cannot overflow."""

    def weights(top: Column) -> Column:
        return F.transform(scores, lambda s: F.exp(F.lit(temperature) * (s - top)))

    def shares(w: Column) -> Column:
        total = F.aggregate(w, F.lit(0.0), lambda acc, v: acc + v)
        return bind(total, lambda t: F.transform(w, lambda v: v / t))

    return bind(bind(F.array_max(scores), weights), shares)


def argmax(scores: Column) -> Column:
    """0-based position of the largest entry, the first one on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def pick(values: Column, position: Column) -> Column:
    """Entry at a 0-based position."""
    return F.element_at(values, (position + 1).cast("int"))


def min_max(value: Column, low: Column, high: Column, eps: float = 1e-9) -> Column:
    return (value - low) / (high - low + F.lit(eps))
