"""Column helpers: page identities, natural order keys, content hashes and text counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.functions.text import casefold


def page_stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(F.trim(name), "\\.[^.]*$", "")


def page_identity(name: Column) -> Column:
    """The page id where the stem is letters and digits with an optional (n); else null."""
    return F.nullif(F.regexp_extract(F.translate(page_stem(name), "（）", "()"), "^[A-Za-z0-9]+(\\([0-9]+\\))?$", 0), F.lit(""))


#: A page number with an optional insert number in parentheses, and what may stand between them.
PAGE = r"(?U)^(\d+)\s*(?:\(\s*(\d+)\s*\))?$"
WIDE = ("（）０１２３４５６７８９", "()0123456789")


def _normal_stem(name: Column) -> Column:
    """The name without its extension (a leading dot is none), with ASCII parentheses and digits, trimmed."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    return F.regexp_replace(F.translate(stem, *WIDE), r"(?U)^\s+|\s+$", "")


def _page_parts(name: Column) -> tuple[Column, Column, Column, Column]:
    """The normal stem, whether it is a page number, and page and insert number as strings that sort by value (0 without an insert)."""
    stem = _normal_stem(name)
    variant = F.coalesce(F.nullif(F.regexp_extract(stem, PAGE, 2), F.lit("")), F.lit("0"))
    return stem, stem.rlike(PAGE), by_value(F.regexp_extract(stem, PAGE, 1)), by_value(variant)


def page_key(name: Column) -> Column:
    """What makes two page files the same page: (numeric, number, variant) of a numbered page, else the case-folded name without white space; extensions do not count."""
    stem, numeric, number, variant = _page_parts(name)
    none = F.lit(None).cast("string")
    return F.struct(numeric.alias("numeric"), F.when(numeric, number).otherwise(none).alias("number"), F.when(numeric, variant).otherwise(none).alias("variant"), F.when(numeric, none).otherwise(casefold(F.regexp_replace(stem, r"(?U)\s+", ""))).alias("name"))


def natural_key(name: Column) -> Column:
    """A struct in whose order pages stand: numbered ones first, by number and insert; then others by runs of digits (by value) and text, then by extension and name."""
    stem, numeric, number, variant = _page_parts(name)
    digits = lambda p: p.rlike("^[0-9]")
    # a run of digits stands before text, whatever either is
    tokens = F.transform(F.regexp_extract_all(casefold(stem), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.struct((~digits(p)).alias("text"), F.when(digits(p), by_value(p)).otherwise(p).alias("said")))
    suffix = F.regexp_extract(name, r".(\.[^.]+)$", 1)
    return F.struct((~numeric).alias("named"), F.when(numeric, number).alias("number"), F.when(numeric, variant).alias("variant"), F.when(~numeric, tokens).alias("tokens"), F.when(~numeric, casefold(suffix)).alias("suffix"), casefold(name).alias("name"))


def by_value(digits: Column) -> Column:
    """A string that sorts runs of digits of any length by value: their number of digits comes first."""
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 10, "0"), bare)


def content_hash(*columns: str) -> Column:
    """SHA-256 of the compact JSON of the columns by name, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def visible_characters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "(?U)\\s", "")).cast("bigint")


def balanced_group(position: Column, total: Column, most: int) -> Column:
    """The group of a 0-based position when total rows are dealt into the fewest groups of at most `most`, sizes one apart, larger first."""
    groups = F.ceil(total / F.lit(most))
    size = F.floor(total / groups)
    larger = total - groups * size
    edge = larger * (size + 1)
    return F.when(position < edge, F.floor(position / (size + 1))).otherwise(larger + F.floor((position - edge) / size)).cast("bigint")


def largest_difference(left: str, right: str) -> Column:
    return F.round(F.array_max(F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double")))), 6)
