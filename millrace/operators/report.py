"""Group reports: totals, grids with forced cells, histograms, renderers for small results."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_total(df: DataFrame, group: str, *aggs: Column, total: str = "all") -> DataFrame:
    """Aggregates by group, and a row for all rows (ROLLUP told from null groups by grouping())."""
    out = df.rollup(group).agg(F.grouping(group).alias("_g"), *aggs)
    return out.withColumn(group, F.when(F.col("_g") == 1, total).otherwise(F.col(group))).drop("_g")


def grid(df: DataFrame, a: str, b: str, a_values: DataFrame, b_values: DataFrame, mean: str) -> DataFrame:
    """(a, b, n, mean) for all listed cells and both margins; empty cells have n 0 and a null mean."""
    sets = df.cube(a, b).agg(F.grouping_id(a, b).alias("_g"), F.count(F.lit(1)).alias("n"), F.avg(mean).alias("mean")).filter("_g < 3")
    sets = sets.select(F.when(F.col("_g").isin(2, 3), "all").otherwise(F.col(a)).alias(a), F.when(F.col("_g").isin(1, 3), "all").otherwise(F.col(b)).alias(b), "n", "mean")
    extra = a_values.sparkSession.range(1).select(F.lit("all").alias("v"))
    left = a_values.select(F.col(a).alias("v")).union(extra).select(F.col("v").alias(a), F.lit(1).alias("_k"))
    right = b_values.select(F.col(b).alias("v")).union(extra).select(F.col("v").alias(b), F.lit(1).alias("_k"))
    cells = left.join(right, "_k").drop("_k").filter((F.col(a) != "all") | (F.col(b) != "all"))
    return cells.join(sets, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"), "mean")


def histogram(df: DataFrame, value: str) -> Column:
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "n"))))


def top_shares(df: DataFrame, value: str, k: int, seq: str) -> DataFrame:
    """The k most frequent values, their counts and shares; ties by first seen."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("_s"))
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("_k", F.lit(1))
    top = counts.orderBy(F.desc("n"), "_s").limit(k).withColumn("_k", F.lit(1))
    return top.join(F.broadcast(total), "_k").select(value, "n", (F.col("n") / F.col("total")).alias("share"))


def canonical_json(value) -> str:
    """Sorted keys, floats to nine places without -0, no NaN, one trailing newline."""

    def plain(x):
        if isinstance(x, bool) or x is None or isinstance(x, (int, str)):
            return x
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("a report holds a number that is not finite")
            return round(x, 9) + 0.0
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x]

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n"


def markdown(df: DataFrame, order: list, most: int = 1000) -> str:
    """A table of a small result; fails rather than cutting a large one."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no table for readers")
    cell = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def row_gate(df: DataFrame, counts: dict[str, int], group: str) -> DataFrame:
    """df, which fails unless each group has exactly the rows it should have, and no other group has any: a last check before publishing."""
    from millrace.operators.joins import violations

    want = df.sparkSession.createDataFrame(list(counts.items()), "_g string, _want long")
    have = df.groupBy(F.col(group).cast("string").alias("_g")).agg(F.count(F.lit(1)).alias("_have"))
    both = want.join(have, "_g", "full")
    checked = violations(both, ~F.col("_want").eqNullSafe(F.col("_have")), "a group has not the rows it should have")
    return df.join(checked.select("_g"), F.col(group).cast("string") == F.col("_g"), "left_semi")


_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;max-width:70em;margin:auto}} section{{border:1px solid #ccc;margin:1em 0;padding:0 1em}} pre{{white-space:pre-wrap;background:#f6f6f6;padding:.5em}} dt{{font-weight:bold}}</style></head>
<body><h1>{title}</h1><p>{n} rows</p>
{cards}
</body></html>
"""


def review_sheet(df: DataFrame, order: list, title: str, code: tuple[str, ...] = (), most: int = 500) -> str:
    """A page without scripts or outside files, a card a row; columns in `code` keep their lines. Fails rather than cutting a large result."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no sheet for readers")
    show = lambda c, v: f"<pre>{html.escape(str(v))}</pre>" if c in code else html.escape("-" if v is None else str(v))
    card = lambda r: "<section><dl>" + "".join(f"<dt>{html.escape(c)}</dt><dd>{show(c, r[c])}</dd>" for c in df.columns) + "</dl></section>"
    return _PAGE.format(title=html.escape(title), n=len(rows), cards="\n".join(map(card, rows)))
