"""Mean squared distance to the nearest points: the starting size of a splat."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.joins import lookup_join, salted_join
from rasterloom.session import cut_lineage

FLOOR = 1e-7
_POINT = ["x", "y", "z"]
_CELL = ["_gx", "_gy", "_gz"]
_OTHER = ["_ox", "_oy", "_oz", "_m"]
# Places of one cell that a place is compared with at a time.
_LIST = 256
# Below one in so many open places, the cells they ask for are looked up first.
_FEW = 100


def _cells(df: DataFrame, edge: Column) -> DataFrame:
    return df.withColumns({g: F.floor(F.col(a) / edge).cast("long") for g, a in zip(_CELL, _POINT)})


def _around(df: DataFrame) -> DataFrame:
    """Each row once per cell of the 27 around its own."""
    steps = F.array(*[F.lit(s).cast("long") for s in (-1, 0, 1)])
    for g in _CELL:
        df = df.withColumn("_s", F.explode(steps)).withColumn(g, F.col(g) + F.col("_s")).drop("_s")
    return df


def with_edges(places: DataFrame, cell: float, split: int) -> DataFrame:
    """Add ``_edge``: the largest of cell, cell / 2, ... at which no cell around the place holds over ``split`` places.

    Each halving looks only at the places near crowded cells, so a dense spot
    gives small cells to itself and its surroundings and to nothing else. Halving
    ends where cell numbers would leave 64 bits; places closer than that share a
    cell, which costs time only.
    """
    last = F.greatest(*[F.max(F.abs(a)) for a in _POINT])
    extent = float(places.agg(last).first()[0] or 0.0)
    edge, rest, done = float(cell), places, []
    while True:
        celled = _cells(rest, F.lit(edge))
        crowded = celled.groupBy(*_CELL).agg(F.count("*").alias("_n")).filter(F.col("_n") > split).select(*_CELL)
        crowded = cut_lineage(crowded)
        if crowded.isEmpty() or extent / (edge / 2.0) >= 2.0**62:
            done.append(rest.withColumn("_edge", F.lit(edge)))
            break
        near = _around(crowded).distinct().withColumn("_near", F.lit(True))
        marked = cut_lineage(lookup_join(celled, near, _CELL, "left").drop(*_CELL))
        done.append(marked.filter(F.col("_near").isNull()).drop("_near").withColumn("_edge", F.lit(edge)))
        rest = marked.filter("_near").drop("_near")
        edge /= 2.0
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def initial_scale(points: DataFrame, cell: float, k: int = 3, split: int = 64) -> DataFrame:
    """Per distinct place the mean squared distance to the ``k`` nearest other points.

    Exact, and at least 1e-7. Copies of a place are counted, not compared. Every
    place has an edge of its own, by how crowded its surroundings are; it looks at
    the 27 cells of that edge around it and is settled once its k-th neighbour lies
    within one edge. The rest try again with their edge doubled, and only the cells
    they ask for are read again. A place still open then has fewer than k
    neighbours within half an edge, so only a bounded number of open places can
    share a cell, and a dense cell is never compared with itself.
    Adds ``copies`` and ``mean_sq``.
    """
    places = cut_lineage(points.groupBy(*_POINT).agg(F.count("*").alias("copies")))
    box = places.agg(F.count("*").alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in _POINT]).first()
    if not box["n"]:
        return places.withColumn("mean_sq", F.lit(FLOOR))
    reach = math.sqrt(sum(box[a] * box[a] for a in _POINT))

    stacked = places.filter(F.col("copies") > k).select(*_POINT, "copies", F.lit(0.0).alias("sum_sq"), F.lit(k).alias("n"))
    open_places = cut_lineage(with_edges(places, cell, split).filter(F.col("copies") <= k))
    settled, asking = [stacked], box["n"]
    while True:
        found = cut_lineage(_search(open_places, places, reach, k, asking * _FEW < box["n"]))
        settled.append(found.filter("settled").select(*_POINT, "copies", "sum_sq", "n"))
        asking = found.filter("NOT settled").count()
        if not asking:
            break
        open_places = found.filter("NOT settled").select(*_POINT, "copies", (F.col("_edge") * 2.0).alias("_edge"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    mean = F.when(F.col("n") > 0, F.col("sum_sq") / F.greatest(F.col("n"), F.lit(1))).otherwise(0.0)
    return out.select(*_POINT, "copies", F.greatest(mean, F.lit(FLOOR)).alias("mean_sq"))


def _lists(others: DataFrame, on: list[str]) -> DataFrame:
    """The places of each cell as lists of about ``_LIST`` at most, however many the cell holds."""
    crowded = others.groupBy(*on).agg(F.ceil(F.count("*") / F.lit(_LIST)).alias("_parts")).filter("_parts > 1")
    dealt = lookup_join(others, cut_lineage(crowded), on, "left")
    part = F.pmod(F.xxhash64(*_OTHER[:3]), F.coalesce("_parts", F.lit(1)))
    # sorted, as the salt of a row comes from its values
    return dealt.groupBy(*on, part.alias("_part")).agg(F.sort_array(F.collect_list(F.struct(*_OTHER))).alias("_others"))


def _search(open_places: DataFrame, places: DataFrame, reach: float, k: int, few: bool) -> DataFrame:
    """One round: sum and number of the k smallest squared distances, and whether final.

    Places are laid out once for each edge in use. With ``few`` open places, only those in the cells they ask for are.
    """
    on = ["_edge", *_CELL]
    around = _around(_cells(open_places, F.col("_edge")))
    edges = [r[0] for r in open_places.select("_edge").distinct().collect()]  # at most one per halving
    laid = places.withColumn("_edge", F.explode(F.array(*[F.lit(e) for e in edges])))
    others = _cells(laid, F.col("_edge")).select(*on, *[F.col(a).alias(f"_o{a}") for a in _POINT], F.col("copies").alias("_m"))
    if few:
        others = lookup_join(others, cut_lineage(around.select(*on).distinct()), on, "left_semi")
    everything = F.col("_edge") > F.lit(reach)

    def gap2(o: Column) -> Column:
        gaps = [F.col(a) - o[f"_o{a}"] for a in _POINT]
        return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]

    # A place meets lists of a bounded number of others and keeps the k nearest of each at
    # once, so what is sorted is a few rows a list, not all pairs; those of a dense cell in parallel.
    near = F.transform("_others", lambda o: F.struct(gap2(o).alias("_d2"), *[o[c].alias(c) for c in _OTHER]))
    near = F.filter(near, lambda c: everything | (c["_d2"] <= F.col("_edge") * F.col("_edge")))
    # the place itself may be a row of weight 0, hence k + 1
    nearest = F.slice(F.sort_array(near), 1, k + 1)
    pairs = salted_join(_lists(others, on), around, on, salts=4, many=True)
    pairs = pairs.select(*_POINT, "copies", "_edge", F.inline(nearest))
    self_pair = (F.col("x") == F.col("_ox")) & (F.col("y") == F.col("_oy")) & (F.col("z") == F.col("_oz"))
    pairs = pairs.withColumn("_m", F.when(self_pair, F.col("copies") - 1).otherwise(F.col("_m")))
    order = ["_d2", *_OTHER[:3]]
    rank = F.row_number().over(Window.partitionBy(*_POINT).orderBy(*order))
    pairs = pairs.withColumn("_rank", rank).filter(F.col("_rank") <= k + 1)
    upto = Window.partitionBy(*_POINT).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    taken: Column = F.least(F.col("_m"), F.greatest(F.lit(k) - F.coalesce(F.sum("_m").over(upto), F.lit(0)), F.lit(0)))
    return (
        pairs.withColumn("_t", taken)
        .groupBy(*_POINT)
        .agg(
            F.first("copies").alias("copies"),
            F.first("_edge").alias("_edge"),
            F.sum(F.col("_t") * F.col("_d2")).alias("sum_sq"),
            F.sum("_t").cast("int").alias("n"),
        )
        .withColumn("settled", (F.col("n") >= F.lit(k)) | everything)
    )
