"""Row filters that count what they drop, guards on fields, fixed subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that say nothing, in any case, as a whole (fixed values).
GENERIC = "(?i)^(main|init|foo|bar|baz|helper|test|f[0-9]+|test_.*|sub_.*)$"


def is_generic(name: Column) -> Column:
    return F.regexp_like(name, F.lit(GENERIC))


def size_reason(n: Column, name: Column, ambiguous: Column, least: int = 6, most: int = 300) -> Column:
    """Why a function is left out, or `kept`: unnamed, fragment (a dot in the name), ambiguous, short, long."""
    out = F.when(F.coalesce(name, F.lit("")) == "", "unnamed").when(F.contains(name, F.lit(".")), "fragment").when(F.coalesce(ambiguous, F.lit(False)), "ambiguous")
    return out.when(n < least, "short").when(n > most, "long").otherwise("kept")


def reasons(df: DataFrame, reason: Column) -> DataFrame:
    """(reason, n)."""
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def within_length(df: DataFrame, tokens: Column, role: str, most: int, dropped_in: tuple[str, ...] = ("train",)) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, counts (role, n, n_over, n_dropped)): rows over the limit leave the listed roles, elsewhere they are only counted."""
    over = F.coalesce(tokens > most, F.lit(False))
    gone = over & F.col(role).isin(list(dropped_in))
    counts = df.groupBy(role).agg(F.count(F.lit(1)).alias("n"), F.count_if(over).alias("n_over"), F.count_if(gone).alias("n_dropped"))
    return df.filter(~gone), counts


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows on which each rule does not hold; a rule that is null does not hold. One pass."""
    one = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n")) for name in rules])))


def pilot(names: DataFrame, name: str, order: str, fixed: tuple[str, ...], n: int) -> DataFrame:
    """(name, place): the fixed names in their order, then others by `order` until n; fails if there are fewer than n."""
    first = F.array_position(F.array(*map(F.lit, fixed)), F.col(name)).cast("long")
    chosen = names.select(name, order).distinct().withColumn("_f", F.when(first > 0, first).otherwise(len(fixed) + 1)).orderBy("_f", order, name).limit(n)
    out = chosen.agg(F.sort_array(F.collect_list(F.struct("_f", order, name))).alias("s"))
    checked = out.withColumn("_ok", F.assert_true(F.size("s") == n, "there are fewer names than the pilot needs")).filter("_ok is null")
    return checked.select(F.posexplode("s").alias("place", "e")).select(F.col(f"e.{name}").alias(name), F.col("place").cast("long"))
