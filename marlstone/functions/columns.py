"""Scalar columns of the data model: globs, renderings, token estimates, hashes, validation. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("fact", "decision", "plan", "observation")
TTLS = ("turn", "session", "persistent")
MAX_PATH, MAX_OWNER, MAX_VALUE, MAX_KEY, MAX_META = 512, 128, 1 << 20, 64, 4096


def _segments(pattern: str) -> list[str]:
    out: list[str] = []
    for s in pattern.split("/"):
        if not (s == "**" and out and out[-1] == "**"):
            out.append(s)
    return out


def glob_regex(pattern: str) -> str:
    """The regular expression of a path glob: ``*`` is one segment, ``**`` any number of them, all else is literal."""
    parts = _segments(pattern)
    if parts == ["**"]:
        return "^(?s:.*)$"
    out, need = "", False
    for i, s in enumerate(parts):
        if s == "**" and i == 0:
            out += "(?:[^/]*/)*"
        elif s == "**":
            out += "(?:/[^/]*)*"
        else:
            out += ("/" if need else "") + ("[^/]*" if s == "*" else "".join(c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c for c in s))
        need = not (s == "**" and i == 0)
    return f"^{out}$"


def literal_prefix(pattern: str) -> str:
    """What every matching path begins with; a scan can push it down where it cannot push an expression."""
    lead: list[str] = []
    for s in pattern.split("/"):
        if s in ("*", "**"):
            break
        lead.append(s)
    return "/".join(lead)


def glob(path: Column, pattern: str) -> Column:
    """Whether ``path`` matches; null for a null path. A literal prefix is repeated as ``startswith``, which scans take."""
    if not any(s in ("*", "**") for s in pattern.split("/")):
        return path == F.lit(pattern)
    test = path.rlike(glob_regex(pattern))
    lead = literal_prefix(pattern)
    return path.startswith(lead) & test if lead else test


def glob_matches(pattern: str, path: str) -> bool:
    """The same test on the driver."""
    return re.fullmatch(glob_regex(pattern)[1:-1], path) is not None


def covers(allowed: str, requested: str) -> bool:
    """Whether every path that ``requested`` matches is matched by ``allowed``, segment by segment."""
    a, r = _segments(allowed), _segments(requested)
    seen: dict[tuple[int, int], bool] = {}

    def at(i: int, j: int) -> bool:
        if (i, j) not in seen:
            if i == len(a):
                ok = j == len(r)
            elif a[i] == "**":
                ok = at(i + 1, j) or (j < len(r) and at(i, j + 1))
            elif j == len(r) or r[j] == "**":
                ok = False
            else:
                ok = (a[i] == "*" or a[i] == r[j]) and at(i + 1, j + 1)
            seen[i, j] = ok
        return seen[i, j]

    return at(0, 0)


def _tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 4)).cast("long")


def render_full(path: Column, value: Column, owner: Column, confidence: Column) -> Column:
    return F.format_string("[%s] (%s, confidence=%.2f): %s", path, owner, confidence, value)


def render_compact(path: Column, value: Column) -> Column:
    return F.concat(F.lit("["), path, F.lit("]: "), F.substring(value, 1, 100), F.when(F.length(value) > 100, "...").otherwise(""))


def tokens_full(path: Column, value: Column, owner: Column, confidence: Column) -> Column:
    """Characters of the full rendering over four, without making it; a confidence in [0, 1] takes four characters."""
    return _tokens(F.length(path) + F.length(owner) + F.length(value) + F.lit(23))


def tokens_compact(path: Column, value: Column) -> Column:
    return _tokens(F.length(path) + F.least(F.length(value), F.lit(100)) + F.lit(4))


def tokens_path(path: Column) -> Column:
    return _tokens(F.length(path))


def prefix(path: Column) -> Column:
    """Everything before the last slash; empty where there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def domain(path: Column) -> Column:
    """The second segment, or the first where the second is missing or empty."""
    second = F.split_part(path, F.lit("/"), F.lit(2))
    return F.when(second != "", second).otherwise(F.split_part(path, F.lit("/"), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Whether two paths share a segment at the same position."""
    return F.coalesce(F.exists(F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x), F.lit(False))


def age_text(seconds: Column) -> Column:
    """Seconds whole, minutes, hours and days with one digit."""
    return (
        F.when(seconds < 60, F.format_string("%ss", F.bround(seconds).cast("long")))
        .when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
        .when(seconds < 86400, F.format_string("%.1fh", seconds / 3600))
        .otherwise(F.format_string("%.1fd", seconds / 86400))
    )


def value_hash(value: Column) -> Column:
    return F.substring(F.md5(value), 1, 16)


def normalised(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))


def refs_array(csv: Column) -> Column:
    """Comma-separated references as an array, without the empty ones."""
    return F.filter(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: x != "")


def refs_csv(refs: Column) -> Column:
    return F.array_join(refs, ",")


def metadata_map(json: Column) -> Column:
    """JSON text as a map; malformed text gives an empty map."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def metadata_prefixed(metadata: Column) -> Column:
    """Own keys without the reserved ones, as ``meta_`` fields."""
    return F.transform_keys(F.map_filter(metadata, lambda k, _: ~k.startswith("_")), lambda k, _: F.concat(F.lit("meta_"), k))


def path_problem(path: Column) -> Column:
    """Why a path is refused; null where it is well formed."""
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(F.length(path) > MAX_PATH, "too long")
        .when(F.instr(path, "\0") > 0, "null byte")
        .when(F.instr(path, "..") > 0, "dot dot")
        .when(path.startswith("/") | path.endswith("/"), "outer slash")
        .when(F.instr(path, "//") > 0, "double slash")
        .when(~path.rlike(r"^[a-zA-Z0-9/_.\-]+$"), "characters")
    )


def row_problem(value: Column, owner: Column, confidence: Column, kind: Column, ttl: Column) -> Column:
    """Why the rest of a row is refused; null where it is well formed."""
    return (
        F.when(value.isNull(), "no value")
        .when(F.length(value) > MAX_VALUE, "value too long")
        .when(owner.isNull() | (owner == ""), "no owner")
        .when(F.length(owner) > MAX_OWNER, "owner too long")
        .when(confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1), "confidence")
        .when(~F.coalesce(kind.isin(*TYPES), F.lit(False)), "type")
        .when(~F.coalesce(ttl.isin(*TTLS), F.lit(False)), "ttl")
    )


def metadata_problem(metadata: Column) -> Column:
    """Why a metadata map is refused: a reserved or too long key, or a too long value; null where it is well formed."""
    return (
        F.when(F.exists(F.map_keys(metadata), lambda k: k.startswith("_")), "reserved key")
        .when(F.exists(F.map_keys(metadata), lambda k: F.length(k) > MAX_KEY), "key too long")
        .when(F.exists(F.map_values(metadata), lambda v: F.length(v) > MAX_META), "value too long")
    )


def level(confidence: Column) -> Column:
    """The named bucket of a confidence."""
    out = F.when(confidence >= 0.9, "verified")
    for least, name in ((0.7, "confident"), (0.5, "probable"), (0.3, "uncertain"), (0.1, "doubtful")):
        out = out.when(confidence >= least, name)
    return out.when(confidence.isNotNull(), "discredited")
