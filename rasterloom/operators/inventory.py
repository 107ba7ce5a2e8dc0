"""Which images and files exist, match, or are missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.paths import extension, file_name, stem
from rasterloom.session import cut_lineage


def incomplete_pairs(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Images present in one layer only, with the layer they lack."""
    a = primary.select("image").distinct().withColumn("_a", F.lit(True))
    b = secondary.select("image").distinct().withColumn("_b", F.lit(True))
    lacks = F.when(F.col("_a").isNull(), F.lit("primary")).otherwise(F.lit("secondary"))
    return (
        a.join(b, "image", "full_outer")
        .filter(F.col("_a").isNull() | F.col("_b").isNull())
        .select("image", lacks.alias("missing_in"))
    )


def require_complete(primary: DataFrame, secondary: DataFrame, shown: int = 200) -> None:
    """Raise when an image is missing from either layer, or when there is none."""
    missing = incomplete_pairs(primary, secondary)
    total = missing.count()
    if total:
        sample = missing.orderBy("missing_in", "image").limit(shown).collect()
        names = ", ".join(f"{r['image']} ({r['missing_in']})" for r in sample)
        raise FileNotFoundError(f"{total} images lack a layer: {names}")
    if not primary.select("image").limit(1).count():
        raise FileNotFoundError("no truth images")


def common_images(*tables: DataFrame) -> DataFrame:
    """Images present in every table."""
    out = tables[0].select("image").distinct()
    for table in tables[1:]:
        out = out.join(table.select("image").distinct(), "image", "left_semi")
    return out


def first_images(images: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` image names in name order; None or 0 keeps all."""
    names = images.select("image").distinct()
    return names.orderBy("image").limit(int(n)) if n else names


def anchor_image(images: DataFrame, name: str | None = None) -> DataFrame:
    """The named frame, which must exist, or else the first one by name."""
    if name is None:
        found = images.agg(F.min("image").alias("image"))
        problem = "there are no frames"
    else:
        found = images.agg(F.max(F.when(F.col("image") == name, F.col("image"))).alias("image"))
        problem = f"anchor frame not found: {name}"
    checked = F.when(F.col("image").isNotNull(), F.col("image")).otherwise(F.raise_error(F.lit(problem)))
    return found.select(checked.alias("image"))


def missing_inputs(required: DataFrame, files: DataFrame) -> DataFrame:
    """Required inputs without a file: (image, label, checked paths).

    ``required`` has one row per candidate path (image, label, path); an input is
    met when any of its candidates exists.
    """
    present = files.select("path").distinct().withColumn("_found", F.lit(True))
    return (
        required.join(present, "path", "left")
        .groupBy("image", "label")
        .agg(F.bool_or(F.coalesce("_found", F.lit(False))).alias("_met"), F.sort_array(F.collect_set("path")).alias("checked"))
        .filter(~F.col("_met"))
        .drop("_met")
    )


def require_inputs(required: DataFrame, files: DataFrame, method: str, shown: int = 200) -> None:
    """Raise when a method lacks an input, listing the first ones."""
    missing = missing_inputs(required, files)
    total = missing.count()
    if total:
        rows = missing.orderBy("image", "label").limit(shown).collect()
        lines = "; ".join(f"{r['image']}: {r['label']} {list(r['checked'])}" for r in rows)
        raise FileNotFoundError(f"{method}: {total} inputs missing: {lines}")


def name_candidates(name: Column, suffixes: Sequence[str] = ("_D", "_depth")) -> Column:
    """The name as is, then with each suffix text removed."""
    return F.array(name, *[F.replace(name, F.lit(s), F.lit("")) for s in suffixes])


def match_files(
    names: DataFrame,
    files: DataFrame,
    extensions: Sequence[str],
    suffixes: Sequence[str] = ("_D", "_depth"),
    strict: bool = False,
) -> DataFrame:
    """One file per name: exact candidates in order, then by prefix of the last one.

    ``names`` has ``name``, ``files`` has ``path``. Candidates are tried name
    first, then extension. Names left over match files that start with the last
    candidate; their lengths are few, so each leftover joins on a prefix of that
    length instead of comparing every name with every file. The first path in
    path order wins. Unmatched names get NULL, or raise when ``strict``.
    """
    allowed = [str(e) for e in extensions]
    known = (
        files.filter(extension(F.col("path")).isin(allowed))
        .select(F.col("path"), file_name(F.col("path")).alias("_file"))
        .groupBy("_file")
        .agg(F.min("path").alias("path"))
    )
    wanted = names.select("name").distinct()
    exts = F.array(*[F.lit(e) for e in allowed])
    tried = (
        wanted.select("name", F.posexplode(name_candidates(F.col("name"), suffixes)).alias("_i", "_c"))
        .select("name", "_i", "_c", F.posexplode(exts).alias("_j", "_e"))
        .withColumn("_file", F.concat("_c", "_e"))
    )
    # both sides grow with the files, so neither is broadcast, however small it looks
    exact = (
        tried.join(known.hint("merge"), "_file")
        .groupBy("name")
        .agg(F.min_by("path", F.col("_i") * F.lit(len(allowed)) + F.col("_j")).alias("path"))
    )
    matched = cut_lineage(wanted.join(exact.hint("merge"), "name", "left"))
    left = matched.filter(F.col("path").isNull()).select(
        "name", F.element_at(name_candidates(F.col("name"), suffixes), -1).alias("_prefix")
    )
    lengths = left.agg(F.collect_set(F.length("_prefix")).alias("l")).select("l").scalar()
    starts = (
        known.withColumn("_l", lengths)
        .withColumn("_n", F.explode("_l"))
        .filter(F.col("_n") <= F.length("_file"))
        .select("path", F.expr("left(_file, _n)").alias("_prefix"))
    )
    first = starts.groupBy("_prefix").agg(F.min("path").alias("path"))
    out = matched.filter(F.col("path").isNotNull()).unionByName(
        left.join(first.hint("merge"), "_prefix", "left").select("name", "path")
    )
    if strict:
        miss = F.raise_error(F.concat(F.lit("no file for "), F.col("name")))
        out = out.withColumn("path", F.when(F.col("path").isNotNull(), F.col("path")).otherwise(miss))
    return out


def by_stem(files: DataFrame) -> DataFrame:
    """First path per stem."""
    return files.groupBy(stem(F.col("path")).alias("image")).agg(F.min("path").alias("path"))


def message_list(messages: DataFrame, order: Sequence[str], shown: int = 200) -> DataFrame:
    """The first ``shown`` messages and how many there are in all (a report)."""
    total = messages.agg(F.count("*").alias("n")).select("n").scalar()
    return messages.orderBy(*order).limit(shown).withColumn("total", total)
