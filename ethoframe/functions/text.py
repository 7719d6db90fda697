"""Strings, regular expressions, maps and JSON as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(text: Column, pattern: str, group: int = 1, fallback: str | None = None) -> Column:
    """The group of the first match, or the fallback (null by default) without a match."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group)).otherwise(F.lit(fallback).cast("string"))


def extract_and_remove(text: Column, pattern: str, group: int = 1) -> Column:
    """struct(value, whole, remaining): the group and the whole of the first match, and the text without any place of the whole match."""
    whole = first_match(text, pattern, 0)
    return F.struct(first_match(text, pattern, group).alias("value"), whole.alias("whole"), F.when(whole.isNull() | (whole == ""), text).otherwise(F.replace(text, whole, F.lit(""))).alias("remaining"))


def extract_fields(text: Column, patterns: Mapping[str, str], no_match: str | None = None, strip: str = "_ -") -> dict[str, Column]:
    """A column per pattern, each taken from what the earlier ones left, and ``remaining``; blanks given in strip go from the ends."""
    out, rest = {}, text
    for name, pattern in patterns.items():
        part = extract_and_remove(rest, pattern)
        out[name] = F.coalesce(F.trim(part["value"], F.lit(strip)), F.lit(no_match).cast("string"))
        rest = part["remaining"]
    out["remaining"] = F.trim(rest, F.lit(strip))
    return out


def replace_patterns(text: Column, replacements: Mapping[str, str]) -> Column:
    """Patterns replaced one after the other."""
    for pattern, new in replacements.items():
        text = F.regexp_replace(text, pattern, new)
    return text


def alphanumeric(text: Column, permitted: str = "._- ", replacement: str = "") -> Column:
    """Characters that are neither letters nor digits nor permitted are replaced."""
    kept = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in permitted)
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{kept}]", replacement)


def readable_bytes(size: Column, digits: int = 2) -> Column:
    """A size with its 1024-based unit; nothing is 0B."""
    names = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
    units = F.array(*map(F.lit, names))
    power = F.when(size > 0, F.least(F.lit(len(names) - 1), F.floor(F.log2(size.cast("double")) / 10).cast("int"))).otherwise(F.lit(0))
    shown = F.concat(F.round(size / F.pow(F.lit(1024.0), power), digits).cast("string"), F.lit(" "), F.element_at(units, power + 1))
    return F.when(size == 0, F.lit("0B")).otherwise(shown)


def nearest_multiple(value: Column, of: Column) -> Column:
    """value rounded to a multiple, halves to the even one; null for multiples of 0."""
    return F.rint(F.try_divide(value.cast("double"), of.cast("double"))) * of


def cm_to_inch(value: Column) -> Column:
    return value / 2.54


def inch_to_cm(value: Column) -> Column:
    return value * 2.54


def duration_text(seconds: Column, template: str = "{D} days {H}:{M}:{S}") -> Column:
    """A duration in the template's fields: days, and hours, minutes and seconds of the rest in two digits."""
    whole = F.floor(seconds).cast("long")
    fields = {"{D}": F.floor(whole / 86400), "{H}": F.floor(F.pmod(whole, F.lit(86400)) / 3600), "{M}": F.floor(F.pmod(whole, F.lit(3600)) / 60), "{S}": F.pmod(whole, F.lit(60))}
    out = F.lit(template)
    for mark, value in fields.items():
        out = F.replace(out, F.lit(mark), value.cast("long").cast("string") if mark == "{D}" else F.lpad(value.cast("long").cast("string"), 2, "0"))
    return out


def json_at(text: Column, path: Sequence[str | int]) -> Column:
    """The value at a path of keys and positions of a JSON text, as text."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.get_json_object(text, f"${steps}")


def json_leaves(df: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """ids, path, value for the members of a JSON object: one level of keys, values as text."""
    parsed = F.from_json(F.col(text), "map<string, string>")
    return df.select(*ids, F.explode(parsed).alias("path", "value"))


def numeric_values(m: Column) -> Column:
    """A map's texts as doubles where they are numbers, else null."""
    return F.transform_values(m, lambda k, v: v.try_cast("double"))


def with_defaults(values: Column, defaults: Column, ignore_null: bool = True) -> Column:
    """A map with the keys of defaults only; values stand where they have the key (and are not null)."""
    return F.transform_values(defaults, lambda k, v: F.coalesce(values[k], v) if ignore_null else F.when(F.map_contains_key(values, k), values[k]).otherwise(v))


def keys_of(m: Column, value: Column) -> Column:
    """All keys of a map with the value."""
    return F.map_keys(F.map_filter(m, lambda k, v: v == value))


def invert_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """value -> sorted keys, for rows of key and value (a value that is an array counts for each of its items)."""
    rows = df.select(key, F.explode(value).alias(value)) if dict(df.dtypes)[value].startswith("array") else df.select(key, value)
    return rows.groupBy(value).agg(F.sort_array(F.collect_set(key)).alias("keys"))


def mirror_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """All pairs and their reverses, once each, without pairs of equal ends."""
    return df.select(a, b).union(df.select(F.col(b).alias(a), F.col(a).alias(b))).where(F.col(a) != F.col(b)).distinct()


def translate_values(value: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Values replaced by a mapping; others stay, or take the default."""
    out: Column | None = None
    for old, new in mapping.items():
        out = F.when(value == F.lit(old), F.lit(new)) if out is None else out.when(value == F.lit(old), F.lit(new))
    rest = value if default is None else default
    return rest if out is None else out.otherwise(rest)


def int_synonym(numbers: Column, offset: int = 97) -> Column:
    """Small integers as one character each (code point offset + n, below 256)."""
    return F.array_join(F.transform(numbers, lambda n: F.chr(n + offset)), "")


def synonym_ints(text: Column, offset: int = 97) -> Column:
    """The inverse of int_synonym()."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)
