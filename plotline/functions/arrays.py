"""Arrays, maps and digests as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, each followed by the unit separator; a null part is an empty one."""
    end = F.lit("\x1f")
    return F.sha2(F.concat(*(x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), end))), 256)


def synthetic_id(level: str, path: Column) -> Column:
    """A negative id for a place without one: the first 15 hexadecimal digits of a digest."""
    return -F.conv(F.substring(F.sha2(F.concat(F.lit(f"{level}:"), path), 256), 1, 15), 16, 10).cast("long")


def attributes(pairs: Column) -> Column:
    """A map from an array of struct key, value: trimmed, pairs with an empty side dropped, of a repeated key the last."""
    trimmed = F.transform(pairs, lambda p: F.struct(F.trim(p["key"]).alias("key"), F.trim(p["value"]).alias("value")))
    kept = F.filter(trimmed, lambda p: (p["key"] != "") & (p["value"] != ""))
    keys = F.array_distinct(F.transform(kept, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(kept, lambda p: p["key"] == k), -1)["value"]))


def merged_flags(*flags: Column) -> Column:
    """All flags, each once, in the order in which they come first."""
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(f, F.array().cast("array<string>")) for f in flags))))


def sampled_days(days: Column, step: int) -> Column:
    """Of ascending dates those at least `step` days after the one taken before, and the newest."""
    start = F.array().cast("array<date>")
    taken = F.aggregate(days, start, lambda acc, d: F.when((F.size(acc) == 0) | (F.date_diff(d, F.element_at(F.concat(acc, F.array(d)), -2 + F.when(F.size(acc) == 0, 1).otherwise(0))) >= step), F.array_append(acc, d)).otherwise(acc))
    return F.array_distinct(F.when(F.size(days) > 0, F.array_append(taken, F.element_at(days, -1))).otherwise(start))


def evenly(items: Column, most: int) -> Column:
    """At most so many items, evenly spaced from the first to the last."""
    n = F.size(items)
    if most == 1:
        return F.slice(items, 1, 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(most - 1)), 0).cast("int"))
    return F.when(n <= most, items).otherwise(F.transform(at, lambda i: F.get(items, i)))
