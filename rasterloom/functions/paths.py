"""File names and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem(path: Column) -> Column:
    """File name without folder and without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    """Last extension with its dot, or the empty string."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def joined_prompts(prompts: Column, separator: str = " . ") -> Column:
    """Trimmed, non-blank prompts in one string."""
    trimmed = F.transform(prompts, lambda p: F.trim(p))
    return F.array_join(F.filter(trimmed, lambda p: p != ""), separator)
