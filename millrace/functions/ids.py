"""Ids of functions and of their sources: project/file:option:mode:symbol:name, built and taken apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_id(project: Column, file: Column, *parts: Column) -> Column:
    return F.concat(project, F.lit("/"), file, *[x for p in parts for x in (F.lit(":"), p)])


def id_parts(id_: Column, names: tuple[str, ...] = ("opt", "mode", "symbol", "name")) -> Column:
    """struct(project, file, names...): the last parts are cut off from the right, as a file may have colons; null if too few."""
    pattern = r"(?s)^([^/]*)/(.*)" + ":([^:]*)" * len(names) + "$"
    fits = F.regexp_like(id_, F.lit(pattern))
    part = lambda i: F.when(fits, F.regexp_extract(id_, pattern, i))
    return F.struct(part(1).alias("project"), part(2).alias("file"), *[part(i + 3).alias(n) for i, n in enumerate(names)])


def source_key(project: Column, file: Column, name: Column) -> Column:
    """The source function that all builds of it share."""
    return F.concat(project, F.lit("/"), file, F.lit(":"), name)


def base_name(path: Column) -> Column:
    """The last component of a path, slashes at its end aside."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def c_symbol(symbol: Column) -> Column:
    """A linker's symbol without the one underscore that C names get."""
    return F.regexp_replace(symbol, "^_", "")


def day(stamp: Column) -> Column:
    """The date of an ISO time as text."""
    return F.substring(stamp, 1, 10)


def anonymous_ids(names, scope: list[str], name: str, seed: str, prefix: str = "sub_"):
    """(scope, name, symbol): the distinct names of each scope numbered in hash order of seed, scope and name, as prefix and hex.

    A scope is one binary; its names are ordered in one task."""
    from pyspark.sql import Window

    from millrace.functions.text import seeded

    key = seeded(seed, F.concat_ws("\0", *scope, name))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(key)) - 1
    return names.select(*scope, name).distinct().withColumn("symbol", F.format_string(prefix + "%04x", place))
