"""Whole jobs made of the other operators: preparing rows, auditing data and reproductions, evaluation sets, candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.functions import names as N
from millrace.functions import text as T
from millrace.functions.ids import source_key
from millrace.operators import audit, filters, joins, leaks, prepare, select, stats

CUT_CODE = "/* ... cut */"


def fit_code(code: Column, room: Column, least: int, counter: Callable[[Column], Column] = T.token_estimate) -> Column:
    """struct(text, cut): code, or its longest run of first lines that fits the room with a mark of the cut; null where less than
    `least` would be left. counter gives a text's tokens; a line's are counted with its line end."""
    mark = counter(F.lit(CUT_CODE))
    got = T.budget_prefix(code, room - mark, lambda x: counter(F.concat(x, F.lit("\n"))))
    whole = F.struct(code.alias("text"), F.lit(False).alias("cut"))
    part = lambda t: F.when((t != "") & (counter(t) >= least), F.struct(F.concat(t, F.lit("\n" + CUT_CODE)).alias("text"), F.lit(True).alias("cut")))
    return F.when(counter(code) <= room, whole).otherwise(C.let(got, part))


def prepare_rows(functions: DataFrame, texts: DataFrame, prefixes: DataFrame, system: str, most: int, decompiled: DataFrame | None = None, least_code: int = 16, raw_in: tuple[str, ...] = ("test",), counter: Callable[[Column], Column] = T.token_estimate) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of chat rows. functions: (split, id, project, file, opt, name, asm, context); texts: (key, text, text_en) by
    source function; prefixes: (project, words).

    Generic names leave train. The target is the name without the project's prefixes (raw in the splits raw_in), with both
    descriptions if there are both. Rows over `most` tokens leave train and are counted elsewhere. With decompiled (id, code): project's
    function names in it become anonymous, imports of the assembly aside; code that shows the row's name or target, or of which too
    little fits, is left out, and `code_reason` says missing, target_name or budget.

    rows: split, id, project, opt, name, kind, messages, tokens (input, target, total), has_code, code_cut, code_reason, n_renamed.
    counts: split, n_input, n_generic, n_without_text, n_over, n_dropped, n_out."""
    f = functions.join(prefixes.select("project", F.col("words").alias("_w")), "project", "left")
    f = f.join(texts.select(F.col("key").alias("_key"), F.col("text").alias("_t"), F.col("text_en").alias("_e")), source_key(F.col("project"), F.col("file"), F.col("name")) == F.col("_key"), "left")
    raw = F.col("split").isin(list(raw_in))
    none = F.array().cast("array<string>")
    f = f.withColumn("_target", F.when(raw, F.col("name")).otherwise(N.strip_prefix(F.col("name"), F.coalesce("_w", none))))
    f = f.withColumn("_generic", (F.col("split") == "train") & filters.is_generic(F.col("name")))
    made, kind = prepare.target(F.col("_target"), F.col("_t"), F.col("_e"))
    f = f.withColumn("_made", made).withColumn("kind", kind).withColumn("_user", T.prompt(F.col("asm"), F.col("context"), F.lit(None).cast("string")))
    f = f.withColumn("_base", counter(F.lit(system)) + counter(F.col("_user")) + counter(F.col("_made")))
    blank = {"has_code": F.lit(False), "code_cut": F.lit(False), "code_reason": F.lit(None).cast("string"), "n_renamed": F.lit(0).cast("long"), "_code": F.lit(None).cast("string")}
    if decompiled is None:
        f = f.withColumns(blank)
    else:
        f = leaks.with_names(f.join(decompiled.select("id", F.col("code").alias("_raw")), "id", "left"), functions.select("project", "name"), "project", "id", "_raw")
        exempt = F.regexp_extract_all("asm", F.lit(leaks.NOTED), F.lit(1))
        # Code without a name of its project stays as it is, and is not sent to Python.
        f = f.withColumn("_y", C.anonymise(F.when(F.size("_n") > 0, F.col("_raw")), F.col("_n"), exempt, F.col("_used")))
        f = f.withColumn("_x", F.struct(F.coalesce("_y.text", "_raw").alias("text"), F.col("_y.n_replaced").alias("n_replaced")))
        leaked = C.name_in_code(F.col("_x.text"), F.col("name")).isNotNull() | C.name_in_code(F.col("_x.text"), F.col("_target")).isNotNull()
        f = f.withColumn("_leak", F.coalesce(leaked, F.lit(False))).withColumn("_fit", fit_code(F.col("_x.text"), F.lit(most) - F.col("_base") - counter(F.lit(T.DECOMPILED)), least_code, counter))
        reason = F.when(F.coalesce("_raw", F.lit("")) == "", "missing").when(F.col("_leak"), "target_name").when(F.col("_fit").isNull(), "budget")
        f = f.withColumn("code_reason", reason).withColumn("has_code", F.col("code_reason").isNull())
        f = f.withColumns({"code_cut": F.col("has_code") & F.coalesce("_fit.cut", F.lit(False)), "n_renamed": F.coalesce(F.col("_x.n_replaced"), F.lit(0)), "_code": F.when(F.col("has_code"), F.col("_fit.text"))})
    user = F.concat("_user", F.coalesce(F.concat(F.lit(T.DECOMPILED), F.col("_code")), F.lit("")))
    f = f.withColumn("_final", user)
    tokens = F.struct(counter(F.col("_final")).alias("input"), counter(F.col("_made")).alias("target"), (counter(F.lit(system)) + counter(F.col("_final")) + counter(F.col("_made"))).alias("total"))
    f = f.withColumn("tokens", tokens).withColumn("messages", prepare.messages(F.lit(system), F.col("_final"), F.col("_made")))
    over = ~F.col("_generic") & (F.col("tokens.total") > most)
    dropped = F.col("_generic") | (over & (F.col("split") == "train"))
    counts = f.groupBy("split").agg(F.count(F.lit(1)).alias("n_input"), F.count_if("_generic").alias("n_generic"), F.count_if(~F.col("_generic") & (F.col("kind") == "name")).alias("n_without_text"), F.count_if(over).alias("n_over"), F.count_if(over & dropped).alias("n_dropped"), F.count_if(~dropped).alias("n_out"))
    return f.filter(~dropped).select("split", "id", "project", "opt", "name", "kind", "messages", "tokens", "has_code", "code_cut", "code_reason", "n_renamed"), counts


def data_audit(rows: DataFrame, train: str = "train", vendor_length: int = 8, vendor_share: float = 0.2) -> DataFrame:
    """(section, split, item, value) of rows (split, id, project, file, name, target, asm, context, decompiled).

    rows and projects; shared projects, ids and source functions of each two splits (item a~b); leaks: part.kind of name or target;
    for splits other than train: copies (asm, decompiled: rows whose normalised text is in train), copy_f1 (of giving the train name
    most often attached to it), embedded rows (of projects that share distinctive names with one train project), known_names (share)."""
    base = rows.select("split", "id", "project", "name", source_key(F.col("project"), F.col("file"), F.col("name")).alias("source"), "target", *[F.coalesce(c, F.lit("")).alias(c) for c in ("asm", "context", "decompiled")])
    base = base.select("*", T.text_hash(F.col("asm")).alias("h_asm"), T.text_hash(F.col("decompiled")).alias("h_decompiled"))
    cell = lambda df, section, item="item": df.select(F.lit(section).alias("section"), "split", F.col(item).alias("item") if item == "item" else F.lit(item).alias("item"), F.col("value").cast("double").alias("value"))
    out = [cell(base.groupBy("split").agg(F.count(F.lit(1)).alias("value")), "rows", "rows"), cell(base.groupBy("split").agg(F.count_distinct("project").alias("value")), "projects", "projects")]
    for key in ("project", "id", "source"):
        has = base.select("split", F.col(key).alias("v")).distinct()
        pairs = has.join(has.select(F.col("split").alias("other"), "v"), "v").filter("split < other").groupBy("split", "other").agg(F.count(F.lit(1)).alias("value"))
        out.append(cell(pairs.select("split", F.concat_ws("~", "split", "other").alias("item"), "value"), f"shared_{key}"))
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("text")) for p in ("asm", "context", "decompiled")])).alias("p")
    looked = base.select("split", "id", parts, F.explode(F.array_distinct(F.array("name", "target"))).alias("n")).select("split", "id", "p.part", T.leak_kind(F.col("p.text"), F.col("n")).alias("kind")).filter("kind is not null").distinct()
    out.append(cell(looked.groupBy("split", F.concat_ws(".", "part", "kind").alias("item")).agg(F.count(F.lit(1)).alias("value")), "leaks"))
    own, rest = base.filter(F.col("split") == train), base.filter(F.col("split") != train)
    for part in ("asm", "decompiled"):
        named = stats.mode_first_seen(own.filter(F.col(f"h_{part}").isNotNull()), f"h_{part}", "name", "id").select(f"h_{part}", F.col("name").alias("train_name"))
        copies = rest.join(named, f"h_{part}").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(N.f1(N.tokens(F.col("train_name")), N.tokens(F.col("name")))).alias("f1"))
        out += [cell(copies.withColumn("value", F.col("n")), "copies", part), cell(copies.withColumn("value", F.col("f1")), "copy_f1", part)]
    own_names = own.select(F.col("project").alias("train_project"), "name").distinct()
    wanted = rest.filter(F.length("name") >= vendor_length).select(F.concat_ws("\0", "split", "project").alias("eval_project"), "name").distinct()
    best = joins.best_overlap(wanted, own_names.filter(F.length("name") >= vendor_length), "eval_project", "train_project", "name", vendor_share)
    inside = rest.withColumn("eval_project", F.concat_ws("\0", "split", "project")).join(best.select("eval_project", "train_project"), "eval_project").join(own_names, ["train_project", "name"], "left_semi")
    out.append(cell(inside.groupBy("split", F.concat_ws("<", "project", "train_project").alias("item")).agg(F.count(F.lit(1)).alias("value")), "embedded"))
    seen = rest.join(own.select("name").distinct().withColumn("_in", F.lit(True)), "name", "left").groupBy("split").agg(F.avg(F.col("_in").isNotNull().cast("double")).alias("value"))
    out.append(cell(seen, "known_names", "share"))
    total = out[0]
    for t in out[1:]:
        total = total.unionByName(t)
    return total


def reproduction_audit(expected: DataFrame, made: DataFrame, mapped: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects, safe, changed): expected (id, project, role, ordinal, digest) against made (id, digest) and mapped (id); made and mapped
    ids must be unique.

    projects: role, project, n, n_found, n_same, n_missing, n_changed, n_unmapped, n_safe. safe: (project, id, ordinal) of rows made
    again byte for byte and mapped. changed: (id, project) of those made differently."""
    m = joins.assert_unique(made.join(expected.select("id"), "id", "left_semi"), ["id"]).select("id", F.col("digest").alias("_d"))
    b = joins.assert_unique(mapped.join(expected.select("id"), "id", "left_semi").select("id"), ["id"]).withColumn("_m", F.lit(True))
    rows = joins.assert_unique(expected, ["id"]).join(m, "id", "left").join(b, "id", "left")
    found, mapped_in = F.col("_d").isNotNull(), F.col("_m").isNotNull()
    same = F.coalesce(F.col("_d") == F.col("digest"), F.lit(False))
    counts = {"n": F.lit(True), "n_found": found, "n_same": same, "n_missing": ~found, "n_changed": found & ~same, "n_unmapped": ~mapped_in, "n_safe": same & mapped_in}
    projects = rows.groupBy("role", "project").agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    return projects, rows.filter(same & mapped_in).select("project", "id", "ordinal"), rows.filter(found & ~same).select("id", "project")


def safe_queue(safe: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project, project_place, id, ordinal): the wanted ids (id, ordinal) by project, projects in the order of their first id; a wanted
    id that is not safe fails the query."""
    got = joins.checked_join(wanted.select("id", "ordinal"), safe.select("id", "project"), "id")
    first = got.groupBy("project").agg(F.min("ordinal").alias("project_place"))
    return got.join(first, "project").select("project", "project_place", "id", "ordinal")


def evaluation_set(functions: DataFrame, order: list, per_option: int, options: tuple[str, ...]) -> DataFrame:
    """Functions of the options without a leak, per_option of each project and option at most, by order."""
    return select.cap_per_group(functions.filter(~F.col("leaked") & F.col("opt").isin(list(options))), ["project", "opt"], per_option, order)


def candidates(found: DataFrame, known: DataFrame, trees: DataFrame, bad_name: str, bad_text: str, needed: str, platform: str, folder: str, file: str, limits: dict[str, tuple[int, int, int]], valid_share: float = 0.08) -> DataFrame:
    """(url, name, role, stars, n_files): repositories of recorded search pages that may be used.

    found: (pool, url, name, about, fork, license, stars), known: (url), trees: (url, path). A repository counts once, for test first;
    test needs library words. Its paths without excluded ones must hold between the pool's limits (least, most, how many
    repositories, by stars) of C files and no more C++ files than these. A share of train by the hash of the name is valid."""
    rows = found.withColumn("url", F.regexp_replace(F.lower("url"), "/+$", ""))
    new = rows.join(known.select(F.regexp_replace(F.lower("url"), "/+$", "").alias("url")).distinct(), "url", "left_anti")
    good = lambda **more: audit.eligible(F.col("name"), F.col("about"), F.col("fork"), F.col("license"), bad_name, bad_text, **more)
    fit = new.filter(F.when(F.col("pool") == "test", good(needed=needed, platform=platform)).otherwise(good()))
    one = select.first_by(fit.withColumn("_p", F.when(F.col("pool") == "test", 0).otherwise(1)), ["url"], ["_p", F.desc("stars")])
    files = trees.withColumn("url", F.regexp_replace(F.lower("url"), "/+$", "")).filter(~T.excluded_path(F.col("path"), folder, file))
    kinds = files.groupBy("url").agg(F.count_if(F.endswith("path", F.lit(".c"))).alias("n_files"), F.count_if(F.regexp_like("path", F.lit(r"\.(cc|cpp|cxx)$"))).alias("_cpp"))
    sized = one.join(kinds, "url").filter(F.col("_cpp") <= F.col("n_files"))
    bounds = F.when(F.lit(False), F.lit(False))
    for pool, (least, most, _) in limits.items():
        bounds = bounds.when(F.col("pool") == pool, F.col("n_files").between(least, most))
    ranked = sized.filter(F.coalesce(bounds, F.lit(False)))
    out = None
    for pool, (_, _, n) in limits.items():
        top = ranked.filter(F.col("pool") == pool).orderBy(F.desc("stars"), "url").limit(n)
        out = top if out is None else out.unionByName(top)
    role = F.when((F.col("pool") == "train") & (T.hash_share(F.col("name")) < valid_share), "valid").otherwise(F.col("pool"))
    return out.select("url", "name", role.alias("role"), "stars", "n_files")


def two_arm_plan(rows: DataFrame, valid: DataFrame, steps: int, batch: int, longest: int, new_tokens: int, most_tokens: int) -> DataFrame:
    """One row of upper bounds of a two-arm pilot: rows and padded tokens an arm, calls and tokens of its validation, their totals.
    Fails if the steps need more rows than there are or more tokens than allowed. rows, valid: a row each."""
    n = steps * batch
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(1))
    one = count(rows, "n_train").join(count(valid, "n_valid"), "_k")
    one = joins.violations(one, F.col("n_train") < n, "the steps need more rows than there are")
    one = joins.violations(one, F.lit(n * longest > most_tokens), "an arm needs more tokens than allowed")
    v = F.col("n_valid")
    long = lambda x: F.lit(x).cast("long")
    return one.select("n_train", "n_valid", long(n).alias("rows_per_arm"), long(n * longest).alias("train_tokens"), (v * longest).alias("valid_tokens"), (v * (longest - new_tokens)).alias("prompt_tokens"), (v * new_tokens).alias("new_tokens"), long(2 * steps).alias("steps_total"), (2 * v).alias("generations_total"), long(2 * n * longest).alias("train_tokens_total"))
