"""Lexical information of contexts under four ways of naming callees: no model is asked, so these are bounds of what a name can copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.functions import names as N

MODES = ("anonymous", "gold", "predicted", "gold_where_predicted")


def lexical_modes(rows: DataFrame, functions: DataFrame, predictions: DataFrame, scope: str, id_: str) -> DataFrame:
    """(id, project, mode, metrics): for each mode the words that a row's renamed context shares with its name.

    rows: (id, project, scope, symbol, context, gold, prefixes). functions, predictions: (scope, symbol, name); only names that are
    identifiers and not anonymous count. A row's own symbol is never renamed."""
    good = F.regexp_like("name", F.lit("^[A-Za-z_][A-Za-z0-9_]*$")) & ~F.regexp_like("name", F.lit("^sub_[0-9a-fA-F]+$"))
    gold = functions.select(scope, F.col("symbol").alias("_c"), F.col("name").alias("_g"))
    pred = predictions.filter(good).select(scope, F.col("symbol").alias("_c"), F.col("name").alias("_p"))
    slots = rows.select(id_, scope, F.explode(F.array_remove(C.symbols_of(F.col("context")), F.col("symbol"))).alias("_c"))
    slots = slots.join(gold, [scope, "_c"]).join(pred, [scope, "_c"], "left")
    table = lambda c: F.map_from_entries(F.collect_list(F.when(c.isNotNull(), F.struct("_c", c.alias("v")))))
    maps = slots.groupBy(id_).agg(table(F.col("_g")).alias("_m1"), table(F.col("_p")).alias("_m2"), table(F.when(F.col("_p").isNotNull(), F.col("_g"))).alias("_m3"))
    none = F.create_map().cast("map<string,string>")
    have = rows.join(maps, id_, "left").select(*rows.columns, *[F.coalesce(m, none).alias(m) for m in ("_m1", "_m2", "_m3")])
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), c.alias("names")) for m, c in zip(MODES, (none, F.col("_m1"), F.col("_m2"), F.col("_m3")), strict=True)]))
    each = have.select(id_, "project", "context", "gold", "prefixes", modes.alias("m")).select(id_, "project", "gold", "prefixes", F.col("m.mode").alias("mode"), C.name_candidates(C.renamed(F.col("context"), F.col("m.names"))).alias("found"))
    bare = F.transform("found", lambda n: N.strip_prefix(n, F.col("prefixes")))
    out = each.select(id_, "project", "mode", C.lexical(N.strip_prefix(F.col("gold"), F.col("prefixes")), bare).alias("x"), C.lexical(F.col("gold"), F.col("found"))["token_recall"].alias("raw_recall"))
    return out.select(id_, "project", "mode", "x.*", "raw_recall")


def lexical_summary(modes: DataFrame) -> DataFrame:
    """Per mode and project, and per mode for all: rows, any_rows, all_rows, shared_tokens, target_tokens, micro, macro, raw_macro, best_copy."""
    shared, target = F.sum("shared_tokens"), F.sum("target_tokens")
    out = modes.rollup("mode", "project").agg(
        F.grouping_id("mode", "project").alias("_g"), F.count(F.lit(1)).alias("rows"), F.count_if("any_shared").alias("any_rows"), F.count_if("all_shared").alias("all_rows"), shared.alias("shared_tokens"), target.alias("target_tokens"),
        F.coalesce(F.try_divide(shared, target), F.lit(0.0)).alias("micro"), F.avg("token_recall").alias("macro"), F.avg("raw_recall").alias("raw_macro"), F.avg("best_copy_f1").alias("best_copy"),
    )
    return out.filter("_g < 3").withColumn("project", F.when(F.col("_g") == 1, "all").otherwise(F.col("project"))).drop("_g")
