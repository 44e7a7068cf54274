"""Leaks of names into prompts: a gate with import exemptions, an audit of structure, what is left after anonymising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.functions.text import QUOTED, lines

NOTED = r";\s*->\s*([A-Za-z_][A-Za-z0-9_]*)"
REMNANT = r"(?m)^\s*[0-9a-f]+:\s|\b(?:call|j\w+|loop\w*)\s+0x|\[rip\s*[+-]|##|<[^>]+>"


def root(name: Column) -> Column:
    """A name without its leading underscores, in lower case."""
    return F.regexp_replace(F.lower(name), "^_+", "")


def imports(asm: Column, context: Column, calls: str = "calls") -> Column:
    """Names of imports that a stripped binary shows: in notes of the assembly and in a context's lists of calls."""
    listed = F.flatten(F.transform(lines(context), lambda x: F.regexp_extract_all(F.regexp_extract(x, rf"{calls} ([^;]*)", 1), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))))
    found = F.concat(F.regexp_extract_all(asm, F.lit(NOTED), F.lit(1)), listed)
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: ~F.regexp_like(n, F.lit("^(sub|dat)_")))))


def wanted_names(name: Column, target: Column, known: Column) -> Column:
    """Names to look for: the raw one, and the target unless it is an import that the row shows."""
    roots = F.transform(known, root)
    return F.array_compact(F.array(name, F.when((target != name) & ~F.array_contains(roots, root(target)), target)))


def gate_sections(asm: Column, context: Column, decompiled: Column, name: Column, known: Column, unit: str = "instructions", strings: str = "string") -> Column:
    """array of (section, text) to be searched: operands of the assembly, a context without its own words, decompiled code. In the
    first two an import whose root is that of the name is masked, as it is an outside symbol; blank sections are left out."""
    code = lambda x: F.when(F.regexp_like(x, F.lit(r":\s*$")), x).otherwise(F.regexp_extract(x, r"^\s*\S+\s+(.*)$", 1))
    operands = F.array_join(F.transform(lines(asm), code), "\n")
    plain = F.regexp_replace(context, rf"\(\d+ {unit}\)|(?<=[:;] ){strings}(?= )", " ")
    same = F.filter(known, lambda n: root(n) == root(name))
    mask = lambda text: F.aggregate(same, text, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), n, F.lit(r"\E(?![A-Za-z0-9_])")), F.lit("ext_")))
    parts = F.array(*[F.struct(F.lit(k).alias("section"), t.alias("text")) for k, t in (("asm", mask(operands)), ("context", mask(plain)), ("decompiled", decompiled))])
    return F.filter(parts, lambda p: F.trim(p["text"]) != "")


def leak_gate(rows: DataFrame, key: str, name: str, target: str, asm: str, context: str, decompiled: str) -> DataFrame:
    """(key, section, name): where a row's prompt gives away its name or target; no rows if the gate is passed."""
    a, c, d = (F.coalesce(x, F.lit("")) for x in (asm, context, decompiled))
    known = rows.select(key, name, target, a.alias("_a"), c.alias("_c"), d.alias("_d"), imports(a, c).alias("_k"))
    parts = known.select(key, wanted_names(F.col(name), F.col(target), F.col("_k")).alias("_w"), F.inline(gate_sections(F.col("_a"), F.col("_c"), F.col("_d"), F.col(name), F.col("_k"))))
    each = parts.select(key, "section", "text", F.explode("_w").alias("name"))
    return each.filter(C.name_in_code(F.col("text"), F.col("name")).isNotNull()).select(key, "section", "name")


def structure_audit(rows: DataFrame, names: DataFrame, scope: str, key: str, asm: str, context: str, allowed: str) -> DataFrame:
    """(key, kind, names): `symbol` where real names of the scope stand in operands or notes outside strings and are not among the
    row's allowed ones; `address` where remnants of addresses are left. names: (scope, name)."""
    text = F.concat(F.coalesce(asm, F.lit("")), F.lit("\n"), F.coalesce(context, F.lit("")))
    bare = rows.select(scope, key, allowed, F.regexp_replace(text, QUOTED, '""').alias("_t"))
    operand = lambda x: F.when(F.contains(x, F.lit("\t")), F.regexp_extract(x, "^[^\t]*\t(.*)$", 1)).otherwise(x)
    kept = F.array_join(F.transform(F.filter(lines(F.col("_t")), lambda x: ~F.regexp_like(x, F.lit(r"^loc_\d+:$"))), operand), "\n")
    words = F.array_distinct(F.regexp_extract_all(kept, F.lit(r"(?<![\w.$])[A-Za-z_][\w.$]*"), F.lit(0)))
    found = bare.select(scope, key, allowed, F.explode(words).alias("name")).filter(~F.array_contains(allowed, F.col("name")) & (F.length("name") > 1))
    symbols = found.join(names.select(scope, "name").distinct(), [scope, "name"]).groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("names"))
    addresses = bare.filter(F.regexp_like("_t", F.lit(REMNANT))).select(key, F.lit("address").alias("kind"), F.array().cast("array<string>").alias("names"))
    return symbols.select(key, F.lit("symbol").alias("kind"), "names").unionByName(addresses)


def with_names(rows: DataFrame, names: DataFrame, project: str, key: str, text: str) -> DataFrame:
    """rows with `_n`, the names of their project that their texts hold, and `_used`, the ranges of numbers that the project's own
    FUN_x names take: all that C.anonymise() needs, in proportion to the text. names: (project, name).

    Rows of one project and key get the names of all their texts."""
    known = names.select(project, F.col("name").alias("_word")).filter(F.col("_word").isNotNull()).distinct()
    words = rows.select(project, key, F.explode(C.words_of(F.col(text))).alias("_word"))
    held = words.join(known, [project, "_word"]).groupBy(project, key).agg(F.collect_set("_word").alias("_n"))
    number = F.regexp_extract("_word", "^FUN_x([1-9][0-9]{0,17})$", 1)
    numbers = known.filter(number != "").select(project, number.cast("long").alias("_i"))
    runs = numbers.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(project).orderBy("_i"))).groupBy(project, "_g").agg(F.min("_i").alias("first"), F.max("_i").alias("last"))
    runs = runs.groupBy(project).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_used"))
    # A text has fewer words than characters, and no more numbers are tried than twice its words and the ranges before.
    used = F.slice(F.coalesce("_used", F.array().cast("array<struct<first:bigint,last:bigint>>")), F.lit(1), F.coalesce(F.length(text), F.lit(0)) + 2)
    return rows.join(held, [project, key], "left").join(runs, project, "left").withColumn("_n", F.coalesce("_n", F.array().cast("array<string>"))).withColumn("_used", used)


def residual_names(rows: DataFrame, names: DataFrame, project: str, key: str, text: str, own: str, exempt: str, most: int = 200) -> DataFrame:
    """Per project: n (all rows), n_changed, n_replaced, n_lines; and of the first `most` rows by key: n_checked, n_before and n_after
    (rows with other functions' names in calls or addresses, before and after anonymising), n_elsewhere (in other places after).

    names: (project, name). The sample bounds a report, all rows are anonymised and counted."""
    have = with_names(rows, names, project, key, text)
    others = F.array_except("_n", F.array(own))
    done = have.select(project, key, others.alias("_o"), exempt, "_used", C.anonymise(F.col(text), F.col("_n"), F.col(exempt), F.col("_used")).alias("_x"), C.anonymise(F.col(text), others, F.col(exempt), F.col("_used")).alias("_y"))
    done = done.withColumn("_z", C.anonymise(F.col("_y.text"), F.col("_o"), F.col(exempt), F.col("_used")))
    place = F.row_number().over(Window.partitionBy(project).orderBy(key))
    done = done.select(project, F.col("_x"), F.col("_y"), F.col("_z"), (place <= most).alias("_in"))
    return done.groupBy(project).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_x.n_replaced") > 0).alias("n_changed"), F.sum("_x.n_replaced").alias("n_replaced"), F.sum("_x.n_lines").alias("n_lines"), F.count_if("_in").alias("n_checked"),
        F.count_if(F.col("_in") & (F.col("_y.n_replaced") > 0)).alias("n_before"), F.count_if(F.col("_in") & (F.col("_z.n_replaced") > 0)).alias("n_after"), F.count_if(F.col("_in") & (F.col("_z.n_elsewhere") > 0)).alias("n_elsewhere"),
    )
