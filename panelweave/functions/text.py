"""Text helpers: Unicode forms, paths, zoned times and hashes of JSON documents."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Parts of a path that mark it as no reference, once `-` and spaces are `_`.
CONTAMINATED = ("人物参考图", "人设", "identity_sheet", "identity_reference", "character_sheet", "character_reference", "page_candidates/", "rejected")
_HEAD = re.compile("(?:[A-Za-z]:/?|/)?")
ZONED = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$"


def _by_value(text: pd.Series, spell) -> pd.Series:
    """spell of each value, once for each distinct one."""
    spelled = {x: spell(x) for x in text.dropna().unique()}
    return pd.Series([spelled.get(x) for x in text], dtype=object)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return _by_value(text, lambda x: unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return _by_value(text, str.casefold)


def _beyond_ascii(text: Column) -> Column:
    """The text where it has other characters than ASCII, so that nothing else goes to Python; else null."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), text)


def nfkc(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_nfkc(_beyond_ascii(text)), text)


def casefold(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_casefold(_beyond_ascii(text)), F.lower(text))


def page_id(name: Column) -> Column:
    """The page that a file name or path speaks of: NFKC, the last part without its extension, if that is letters and digits with an optional (n); else null."""
    last = F.regexp_extract(nfkc(name), r"([^/\\\\]*)$", 1)
    stem = F.regexp_replace(F.regexp_replace(last, r"\.[^.]*$", ""), r"(?U)^\s+|\s+$", "")
    return F.nullif(F.regexp_extract(stem, r"^[A-Za-z0-9]+(\([0-9]+\))?$", 0), F.lit(""))


def _normal(x: str) -> str | None:
    said = unicodedata.normalize("NFKC", x).strip().replace("\\", "/")
    head = _HEAD.match(said)[0]
    held: list[str] = []
    for step in said[len(head) :].split("/"):
        if step == ".." and held and held[-1] != "..":
            held.pop()
        elif step == ".." and head.endswith("/") or step in ("", "."):
            continue
        else:
            held.append(step)
    return ((head + "/".join(held)) or ".").casefold() if said else None


@F.pandas_udf(StringType())
def normal_path(path: pd.Series) -> pd.Series:
    """NFKC, forward slashes, `.` and `..` collapsed as on Windows, case-folded; blank is null.

    A drive or a leading slash stays, and `..` climbs no higher than that; without one it stays.
    """
    return _by_value(path, _normal)


#: paths that are normal as they are: ASCII in lower case, single slashes between parts that begin with no dot
PLAIN = r"^[a-z0-9_-][a-z0-9_.-]*+(?:/[a-z0-9_-][a-z0-9_.-]*+)*+$"


@F.pandas_udf(ArrayType(StringType()))
def _normal_paths(paths: pd.Series) -> pd.Series:
    return pd.Series([None if row is None else [None if x is None else _normal(x) for x in row] for row in paths], dtype=object)


def normal_paths(paths: Column | str) -> Column:
    """The normal path of each member of a list. Lists of plain paths do not go to Python."""
    paths = F.col(paths) if isinstance(paths, str) else paths
    plain = F.forall(paths, lambda x: x.isNull() | (x.rlike(PLAIN) & ~x.endswith("\n")))
    return F.coalesce(_normal_paths(F.when(~plain, paths)), paths)


def _canonical(document) -> str:
    return json.dumps(document, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


@F.pandas_udf(StringType())
def edited_json(document: pd.Series, fields: pd.Series) -> pd.Series:
    """The JSON object with the members of another set in it, spelled canonically; null if either is none."""

    def spell(x: str, y: str) -> str | None:
        try:
            return _canonical({**json.loads(x), **json.loads(y)})
        except (ValueError, TypeError):
            return None

    return pd.Series([None if x is None or y is None else spell(x, y) for x, y in zip(document, fields)], dtype=object)


def sealed_json(document: Column, field: str) -> Column:
    """The JSON object, spelled canonically, with the hash of all its other members as a member; null if it is none."""

    def spell(x: str) -> str | None:
        try:
            held = {k: v for k, v in json.loads(x).items() if k != field}
            return _canonical({**held, field: hashlib.sha256(_canonical(held).encode()).hexdigest()})
        except (ValueError, AttributeError):
            return None

    @F.pandas_udf(StringType())
    def sealed(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else spell(x) for x in column], dtype=object)

    return sealed(document)


def json_hash(document: Column, *dropped: str) -> Column:
    """SHA-256 of the JSON object without the dropped fields, spelled compactly with sorted keys; null if it is no such object or holds a number that is not finite."""

    def spell(x: str) -> str | None:
        try:
            held = {k: v for k, v in json.loads(x).items() if k not in dropped}
            return hashlib.sha256(_canonical(held).encode()).hexdigest()
        except (ValueError, AttributeError):
            return None

    @F.pandas_udf(StringType())
    def hashed(column: pd.Series) -> pd.Series:
        return _by_value(column, spell)

    return hashed(document)


def contaminated(path: Column) -> Column:
    """Whether a normal path holds a marker of identity sheets or rejected work."""
    compact = F.translate(path, "- ", "__")
    return F.exists(F.array(*map(F.lit, CONTAMINATED)), lambda m: F.contains(compact, m))


def trimmed(text: Column) -> Column:
    """Without white space of any script at the ends; blank is null."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def zoned_time(text: Column) -> Column:
    """The instant that the text names with its zone; null for times without one."""
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text))


def inside(path: Column, root: Column) -> Column:
    """Whether a normal path stays below a normal root."""
    return F.startswith(path, F.concat(root, F.lit("/"))) & ~F.concat(path, F.lit("/")).contains("/../")
