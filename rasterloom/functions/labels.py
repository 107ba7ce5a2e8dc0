"""Column expressions over class labels. NULL means "no label"."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _by_target(mapping: Mapping[int, int]) -> dict[int, list[int]]:
    grouped: dict[int, list[int]] = {}
    for source, target in mapping.items():
        grouped.setdefault(int(target), []).append(int(source))
    return grouped


def remap_simultaneous(label: Column, mapping: Mapping[int, int]) -> Column:
    """Replace ids in one step: every rule reads the original label."""
    out = None
    for target, sources in _by_target(mapping).items():
        rule = (label.isin(sources), F.lit(target))
        out = F.when(*rule) if out is None else out.when(*rule)
    return label if out is None else out.otherwise(label)


def merge_closure(merge_map: Mapping[int, Sequence[int]]) -> dict[int, int]:
    """Where each id ends up when the merges run one after another, in map order."""
    touched = {int(s) for sources in merge_map.values() for s in sources}
    final = {}
    for start in sorted(touched):
        current = start
        for target, sources in merge_map.items():
            if current in {int(s) for s in sources}:
                current = int(target)
        if current != start:
            final[start] = current
    return final


def merge_sequential(label: Column, merge_map: Mapping[int, Sequence[int]]) -> Column:
    """Ordered merges; a later rule sees the result of an earlier one."""
    return remap_simultaneous(label, merge_closure(merge_map))


def map_ids(label: Column, mapping: Mapping[int, int], default: int | None = 0) -> Column:
    """Map ids, sending everything unmapped to ``default``."""
    out = None
    for target, sources in _by_target(mapping).items():
        rule = (label.isin(sources), F.lit(target))
        out = F.when(*rule) if out is None else out.when(*rule)
    fallback = F.lit(default).cast("int")
    return fallback if out is None else out.otherwise(fallback)


def to_binary(label: Column, positive_ids: Iterable[int]) -> Column:
    """1 for a positive class, 0 for any other label, NULL stays NULL."""
    return F.when(label.isNotNull(), label.isin([int(c) for c in positive_ids]).cast("int"))


def collapse_levels(
    label: Column,
    positive_ids: Iterable[int],
    negative_ids: Iterable[int],
    positive_id: int = 200,
    negative_id: int = 201,
    force_positive: Column | None = None,
) -> Column:
    """Two-level view of a class label; positive wins, ``force_positive`` overrides all."""
    rule = label.isin([int(c) for c in positive_ids])
    if force_positive is not None:
        rule = F.coalesce(force_positive, F.lit(False)) | F.coalesce(rule, F.lit(False))
    return F.when(rule, F.lit(positive_id)).when(
        label.isin([int(c) for c in negative_ids]), F.lit(negative_id)
    )


def error_flag(pred: Column, truth: Column) -> Column:
    """TRUE correct, FALSE wrong, NULL where there is no truth to compare with."""
    return F.when(truth.isNotNull(), pred.eqNullSafe(truth))


def with_sentinel(label: Column, sentinel: int = -1) -> Column:
    """Restore the sentinel that files use for "no label"."""
    return F.coalesce(label, F.lit(sentinel))
