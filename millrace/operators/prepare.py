"""Chat rows: messages, targets, prefixes of names, trimming to budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import budget_prefix, token_estimate


def messages(system: Column, user: Column, assistant: Column) -> Column:
    pair = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(pair("system", system), pair("user", user), pair("assistant", assistant))


def target(name: Column, text: Column, text_en: Column) -> tuple[Column, Column]:
    """(JSON target, its kind): both descriptions around the name, or the name alone."""
    both = (F.coalesce(text, F.lit("")) != "") & (F.coalesce(text_en, F.lit("")) != "")
    full = F.to_json(F.struct(text_en.alias("description_en"), name.alias("name"), text.alias("description")))
    return F.when(both, full).otherwise(F.to_json(F.struct(name.alias("name")))), F.when(both, "full").otherwise("name")


def message_of(rows: Column, role: str) -> Column:
    return F.get(F.filter(rows, lambda m: m["role"] == role), F.lit(0))["content"]


def frequent_prefixes(df: DataFrame, project: str, name: str, related: bool, least_share: float = 0.3, least: int = 5) -> DataFrame:
    """(project, prefix, n, n_names): each project's most frequent first word over distinct names, if frequent enough.

    related: only prefixes that the project's name starts with, or that start it, both without signs."""
    names = df.select(project, name).distinct()
    marked = names.withColumn("prefix", F.nullif(F.regexp_extract(name, "^([A-Za-z][A-Za-z0-9]{1,11})_", 1), F.lit("")))
    totals = marked.groupBy(project).agg(F.count(F.lit(1)).alias("n_names"))
    counts = marked.filter("prefix is not null").groupBy(project, "prefix").agg(F.count(F.lit(1)).alias("n"))
    if related:
        plain = F.lower(F.regexp_replace(project, "[_.#-]", ""))
        counts = counts.filter((F.lower("prefix") != "") & (F.startswith(plain, F.lower("prefix")) | F.startswith(F.lower("prefix"), plain)))
    top = F.row_number().over(Window.partitionBy(project).orderBy(F.desc("n"), "prefix"))
    best = counts.withColumn("_r", top).filter("_r = 1").drop("_r").join(totals, project)
    return best.filter((F.col("n") >= least) & (F.col("n") >= F.col("n_names") * least_share)).select(project, "prefix", "n", "n_names")


def first_word_prefixes(df: DataFrame, project: str, words: str, least_share: float = 0.1) -> DataFrame:
    """(project, prefix, n, n_rows): first words of names with several words, in a tenth of the project's rows at least."""
    totals = df.groupBy(project).agg(F.count(F.lit(1)).alias("n_rows"))
    counts = df.filter(F.size(words) > 1).groupBy(project, F.element_at(words, 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(totals, project).filter(F.col("n") >= F.col("n_rows") * least_share).select(project, "prefix", "n", "n_rows")


def prefix_collisions(df: DataFrame, project: str, name: str, stripped: str) -> DataFrame:
    """Names of a project that are one after stripping."""
    out = df.groupBy(project, F.lower(stripped).alias("stripped")).agg(F.count_distinct(name).alias("n_names"))
    return out.filter("n_names > 1")


def cut_prompt(asm: Column, context: Column, budget: int, counter: Callable[[Column], Column] = token_estimate) -> Column:
    """struct(asm, context, cut) within the budget: context lines go first, from the end, then assembly lines. counter gives a text's
    tokens; parts that do not fit whole are cut by the tokens of their lines."""
    of_line = lambda x: counter(F.concat(x, F.lit("\n")))
    room = budget - counter(asm)
    kept = F.when(counter(asm) + counter(context) <= budget, context).otherwise(F.when(room > 0, budget_prefix(context, room, of_line)).otherwise(""))
    body = F.when(counter(asm) <= budget, asm).otherwise(budget_prefix(asm, F.lit(budget), of_line))
    return F.struct(body.alias("asm"), kept.alias("context"), ((body != asm) | (kept != context)).alias("cut"))
