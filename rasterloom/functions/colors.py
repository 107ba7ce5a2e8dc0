"""Fixed colours for class ids, as array<int> [r, g, b] columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result tables must show the same colours.
POSITIVE_ID = 200
NEGATIVE_ID = 201
POSITIVE_COLOR = (168, 123, 204)
NEGATIVE_COLOR = (182, 208, 167)
NO_LABEL_COLOR = (255, 255, 255)
CORRECT_COLOR = (0, 255, 0)
WRONG_COLOR = (255, 0, 0)
RESERVED_COLORS = {POSITIVE_ID: POSITIVE_COLOR, NEGATIVE_ID: NEGATIVE_COLOR}
FALLBACK_COLORS = (
    (31, 119, 180),
    (255, 127, 14),
    (148, 103, 189),
    (140, 86, 75),
    (227, 119, 194),
    (127, 127, 127),
    (188, 189, 34),
    (23, 190, 207),
    (174, 199, 232),
    (255, 187, 120),
    (197, 176, 213),
    (196, 156, 148),
    (247, 182, 210),
    (199, 199, 199),
    (219, 219, 141),
    (158, 218, 229),
)


def rgb(color: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(c)) for c in color])


def fallback_color(label: Column) -> Column:
    """Colour by id modulo the list length."""
    table = F.array(*[rgb(c) for c in FALLBACK_COLORS])
    return F.element_at(table, (F.pmod(label, F.lit(len(FALLBACK_COLORS))) + 1).cast("int"))


def palette_color(
    label: Column,
    configured: Mapping[int, Sequence[int]],
    reserved: Mapping[int, Sequence[int]] = RESERVED_COLORS,
) -> Column:
    """Reserved ids first, then configured colours, then the fallback list; NULL is white."""
    out = F.when(label.isNull(), rgb(NO_LABEL_COLOR))
    for known in (reserved, {k: v for k, v in configured.items() if k not in reserved}):
        for class_id, color in known.items():
            out = out.when(label == int(class_id), rgb(color))
    return out.otherwise(fallback_color(label))


def error_color(flag: Column) -> Column:
    """Green for correct, red for wrong, white for not evaluated."""
    return F.when(flag, rgb(CORRECT_COLOR)).when(~flag, rgb(WRONG_COLOR)).otherwise(rgb(NO_LABEL_COLOR))
