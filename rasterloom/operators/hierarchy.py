"""Labels from a typed entity tree ``entities(entity_id, type, parent_id)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.joins import lookup_join, salted_join
from rasterloom.session import cut_lineage

# Which type decides when an instance falls under several.
TYPE_PRIORITY = ("Window", "Door", "RoofSurface", "WallSurface", "GroundSurface", "Building")
DEFAULT_CLASS_TYPES = {
    1: ("WallSurface",),
    2: ("Window",),
    3: ("Door",),
    10: ("GroundSurface",),
    12: ("RoofSurface",),
}


def reached_types(entities: DataFrame, types: Sequence[str]) -> DataFrame:
    """For each entity the listed types found on it or on any ancestor: (entity_id, types).

    An entity lies below a type exactly when that type is on its path to the root.
    Paths are followed by pointer doubling: in each round every entity takes over
    what its pointer has gathered and then points twice as far, so a tree of depth
    n needs log2(n) joins. A round in which nothing is learned ends the search,
    which also ends it on cycles. Every round is checkpointed. Entities at the
    top of their path leave the loop; a parent with very many children is looked
    up through a salted join.
    """
    wanted = [str(t) for t in types]
    own = F.when(F.col("type").isin(wanted), F.array("type")).otherwise(F.array().cast("array<string>"))
    state = cut_lineage(entities.select("entity_id", F.col("parent_id").alias("ptr"), own.alias("types")))
    finished = state.filter(F.col("ptr").isNull())
    state = state.filter(F.col("ptr").isNotNull())
    while True:
        target = state.unionByName(finished).select(
            F.col("entity_id").alias("ptr"), F.col("ptr").alias("_next"), F.col("types").alias("_more")
        )
        state = cut_lineage(
            salted_join(state, target, ["ptr"], "left", salts=16).select(
                "entity_id",
                F.col("_next").alias("ptr"),
                F.when(F.col("_more").isNull(), F.col("types"))
                .otherwise(F.array_union("types", F.col("_more")))
                .alias("types"),
                (F.size(F.array_except(F.col("_more"), F.col("types"))) > 0).alias("learned"),
            )
        )
        learned, linked = state.agg(F.bool_or("learned"), F.bool_or(F.col("ptr").isNotNull())).first()
        state = state.drop("learned")
        if not (learned and linked):
            break
        finished = finished.unionByName(state.filter(F.col("ptr").isNull()))
        state = state.filter(F.col("ptr").isNotNull())
    return finished.unionByName(state).select("entity_id", "types")


def descendants(entities: DataFrame, types: Sequence[str]) -> DataFrame:
    """(type, entity_id) for every entity of, or below an entity of, each listed type."""
    reached = reached_types(entities, types)
    return reached.select(F.explode("types").alias("type"), "entity_id")


def hierarchy_labels(
    entities: DataFrame,
    instance_entity: DataFrame,
    class_types: Mapping[int, Sequence[str]] = DEFAULT_CLASS_TYPES,
    priority: Sequence[str] = TYPE_PRIORITY,
) -> DataFrame:
    """Class of each instance by the best-ranked type on its entity's path.

    Types rank by ``priority``, unlisted ones last; among classes that share the
    rank the first in ``class_types`` wins. Instances under no type get no row.
    """
    best: dict[str, tuple[int, int, int]] = {}
    for order, (class_id, types) in enumerate(class_types.items()):
        for name in types:
            rank = priority.index(name) if name in priority else len(priority)
            best[name] = min(best.get(name, (rank, order, int(class_id))), (rank, order, int(class_id)))
    ranked = F.create_map(
        *[
            part
            for name, (rank, order, class_id) in best.items()
            for part in (
                F.lit(name),
                F.struct(F.lit(rank).alias("r"), F.lit(order).alias("o"), F.lit(class_id).alias("c")),
            )
        ]
    )
    reached = reached_types(entities, list(best)).filter(F.size("types") > 0)
    chosen = F.array_min(F.transform("types", lambda t: F.element_at(ranked, t)))
    labels = reached.select("entity_id", chosen["c"].alias("label"))
    return lookup_join(instance_entity, labels, ["entity_id"]).select("instance_id", "label")
