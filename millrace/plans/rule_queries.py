"""Queries of ids, filters, guards, joins with contracts and audits. Inputs are built from the driver's columns on both sides;
the SQL states what must come out of them, mostly without the operator's patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import ids
from millrace.functions.text import seeded, token_estimate
from millrace.operators import audit, filters, joins
from millrace.plans.registry import query, table

_FILE = "'src/' || CASE WHEN p_partkey % 3 = 0 THEN 'a:b/' ELSE '' END || replace(p_name, ' ', '_') || '.c'"


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    file = F.concat(F.lit("src/"), F.when(F.col("p_partkey") % 3 == 0, "a:b/").otherwise(""), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".c"))
    return p.select(F.col("p_partkey").alias("key"), F.lower("p_brand").alias("project"), file.alias("file"), F.concat(F.lit("-O"), (F.col("p_size") % 4).cast("string")).alias("opt"), F.concat(F.lit("sub_"), F.col("p_partkey").cast("string")).alias("symbol"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("name"))


@query(f"""SELECT p_partkey AS key, lower(p_brand) AS project, {_FILE} AS file, '-O' || CAST(p_size % 4 AS VARCHAR) AS opt, 'local' AS mode, 'sub_' || CAST(p_partkey AS VARCHAR) AS symbol, replace(p_name, ' ', '_') AS name FROM part""")
def id_parts(spark, sf_dir):
    p = _parts(spark, sf_dir)
    made = p.select("key", ids.make_id(F.col("project"), F.col("file"), F.col("opt"), F.lit("local"), F.col("symbol"), F.col("name")).alias("id"))
    return made.select("key", ids.id_parts(F.col("id")).alias("p")).select("key", "p.*")


@query(f"""SELECT lower(p_brand) || '/' || {_FILE} || ':' || replace(p_name, ' ', '_') AS source, count(*) AS n_builds, count(DISTINCT p_size % 4) AS n_opts FROM part GROUP BY 1""")
def source_keys(spark, sf_dir):
    p = _parts(spark, sf_dir)
    key = ids.source_key(F.col("project"), F.col("file"), F.col("name"))
    return p.groupBy(key.alias("source")).agg(F.count(F.lit(1)).alias("n_builds"), F.count_distinct("opt").alias("n_opts"))


@query("""SELECT p_partkey AS key, replace(p_name, ' ', '_') || '.c' AS base, CASE WHEN p_partkey % 4 = 0 THEN '_' ELSE '' END || p_brand AS symbol FROM part""")
def base_names_and_symbols(spark, sf_dir):
    p = _parts(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_brand"), "key")
    linked = F.concat(F.when(F.col("key") % 4 == 0, "__").otherwise("_"), F.col("p_brand"))
    return p.select("key", ids.base_name(F.concat("file", F.when(F.col("key") % 2 == 0, "/").otherwise(""))).alias("base"), ids.c_symbol(linked).alias("symbol"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1")
def day_prefix(spark, sf_dir):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "orders").groupBy(ids.day(stamp).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT p_brand AS project, p_name AS name, 'sub_' || lpad(lower(to_hex(row_number() OVER (PARTITION BY p_brand ORDER BY sha256('x' || chr(0) || p_brand || chr(0) || p_name)) - 1)), 4, '0') AS symbol FROM (SELECT DISTINCT p_brand, p_name FROM part) n""")
def anonymous_ids(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.col("p_name").alias("name"))
    return ids.anonymous_ids(names, ["project"], "name", "x")


@query("""WITH f AS (SELECT CAST(l_quantity AS BIGINT) * 8 AS n, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'f.part' ELSE 'f' END AS name, l_linenumber = 3 AS twice FROM lineitem)
SELECT CASE WHEN name = '' THEN 'unnamed' WHEN name = 'f.part' THEN 'fragment' WHEN twice THEN 'ambiguous' WHEN n < 6 THEN 'short' WHEN n > 300 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM f GROUP BY 1""")
def size_filter(spark, sf_dir):
    line = F.col("l_linenumber")
    name = F.when(line == 1, "").when(line == 2, "f.part").otherwise("f")
    return filters.reasons(table(spark, sf_dir, "lineitem"), filters.size_reason(F.col("l_quantity").cast("long") * 8, name, line == 3))


@query("""SELECT p_partkey AS key, p_partkey % 8 < 5 AS generic FROM part""")
def generic_names(spark, sf_dir):
    k = F.col("p_partkey")
    number = k.cast("string")
    name = F.element_at(F.array(F.lit("MAIN"), F.concat(F.lit("f"), number), F.concat(F.lit("Test_"), F.col("p_name")), F.concat(F.lit("SUB_"), number), F.lit("helper"), F.concat(F.lit("f"), number, F.lit("x")), F.lit("main_loop"), F.lit("testify")), (k % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("key"), filters.is_generic(name).alias("generic"))


@query("""WITH d AS (SELECT CASE WHEN lang = 'en' THEN 'train' ELSE lang END AS role, CAST(floor((length(text) + 3) / 4) AS BIGINT) AS t FROM documents)
SELECT role, count(*) AS n, CAST(sum(CASE WHEN t > 400 THEN 1 ELSE 0 END) AS BIGINT) AS n_over, CAST(sum(CASE WHEN t > 400 AND role = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped, CAST(sum(CASE WHEN t > 400 AND role = 'train' THEN 0 ELSE 1 END) AS BIGINT) AS n_kept FROM d GROUP BY role""")
def length_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("text", F.when(F.col("lang") == "en", "train").otherwise(F.col("lang")).alias("role"))
    kept, counts = filters.within_length(rows, token_estimate(F.col("text")), "role", 400)
    return counts.join(kept.groupBy("role").agg(F.count(F.lit(1)).alias("n_kept")), "role", "left").fillna(0, ["n_kept"])


@query("""SELECT rule, n FROM (SELECT CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS price, CAST(sum(CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 1 ELSE 0 END) AS BIGINT) AS status, CAST(0 AS BIGINT) AS id,
CAST(sum(CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS present FROM orders) x UNPIVOT (n FOR rule IN (price, status, id, present))""")
def presence_guards(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("maybe", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")))
    rules = {"id": F.col("o_orderkey").isNotNull(), "price": F.col("o_totalprice") <= 100000, "status": F.col("o_orderstatus").isin("O", "F"), "present": F.col("maybe") != ""}
    return filters.broken_rules(rows, rules)


@query("""WITH b AS (SELECT DISTINCT p_brand AS name FROM part), r AS (SELECT name, CASE name WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 3 END AS f FROM b),
o AS (SELECT name, row_number() OVER (ORDER BY f, sha256('p' || chr(0) || name), name) - 1 AS place FROM r) SELECT name, place FROM o WHERE place < (SELECT least(4, count(*)) FROM b)""")
def pilot_names(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), seeded("p", F.col("p_brand")).alias("k"))
    return filters.pilot(brands, "name", "k", ("Brand#3", "Brand#1"), min(4, brands.select("name").distinct().count()))


@query("SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(value) AS DOUBLE) IS NOT NULL AS has_sum FROM events JOIN orders ON o_orderkey = event_id WHERE event_id IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def lenient_join(spark, sf_dir):
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("priority"))
    return e.join(o, "event_id").groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("value").isNotNull().alias("has_sum"))


@query("""SELECT p_brand || '/' || CAST(p_partkey AS VARCHAR) AS key, p_brand AS project, p_name AS text, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'detail' WHEN p_size % 3 = 1 THEN 'text' ELSE 'unknown' END AS model FROM part WHERE p_partkey % 5 > 0""")
def label_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("key", F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")))
    third = F.col("p_size") % 3
    texts = p.filter("p_partkey % 5 > 0").select("key", F.col("p_name").alias("text"), F.when(third < 2, "text").alias("model"))
    details = p.select("key", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("kind"), F.when(third == 0, "detail").when(third == 1, "").alias("model"))
    return joins.label_merge(texts, details, "key", ["kind"], "unknown")


@query("""SELECT l_orderkey AS id, l_linenumber AS part, o_orderstatus AS reference, p_name AS source FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size <= 40 AND o_orderkey % 7 > 0""")
def judging_rows(spark, sf_dir):
    predictions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"), F.col("l_partkey").alias("key"))
    references = table(spark, sf_dir, "orders").filter("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("reference"))
    sources = table(spark, sf_dir, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("source"))
    return joins.for_judging(references, sources, predictions, "id", "key", strict=False).select("id", "part", "reference", "source")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal + 1 AS balance, 'n' || CAST(c_nationkey AS VARCHAR) AS context FROM customer")
def context_refresh(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("old").alias("context"), F.col("c_nationkey"))
    news = c.select("id", (F.col("balance") + 1).alias("balance"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("context"))
    return joins.refresh(c.drop("c_nationkey"), news, "id", ["balance", "context"]).select("id", "name", "balance", "context")


@query("""SELECT count(DISTINCT l_orderkey) AS n, count(DISTINCT CASE WHEN o_orderkey IS NULL THEN l_orderkey END) AS n_missing, count(DISTINCT CASE WHEN o_orderkey IS NULL THEN l_orderkey END) = 0 AS holds FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 50000) o ON o_orderkey = l_orderkey""")
def subset_test(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return joins.is_subset(lines, table(spark, sf_dir, "orders").filter("o_totalprice > 50000").select(F.col("o_orderkey").alias("id")), "id")


@query("""SELECT CAST(sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS BIGINT) AS n_both, CAST(sum(CASE WHEN a AND NOT b THEN 1 ELSE 0 END) AS BIGINT) AS n_left, CAST(sum(CASE WHEN b AND NOT a THEN 1 ELSE 0 END) AS BIGINT) AS n_right, false AS same FROM (SELECT p_size % 3 > 0 AS a, p_size % 4 > 0 AS b FROM part) x""")
def set_equality(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return joins.same_keys(p.filter("p_size % 3 > 0"), p.filter("p_size % 4 > 0"), "id")


@query("SELECT l_returnflag AS grp, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_linenumber) AS BIGINT) AS tokens, CAST(sum(floor((length(l_linestatus) + l_linenumber + 3) / 4)) AS BIGINT) AS estimated, round(sum(l_linenumber) * 0.25, 6) AS cost FROM lineitem GROUP BY 1")
def token_cost(spark, sf_dir):
    text = F.concat("l_linestatus", F.repeat(F.lit("x"), F.col("l_linenumber")))
    return audit.token_costs(table(spark, sf_dir, "lineitem").withColumn("t", text), [F.col("l_returnflag").alias("grp")], "l_linenumber", "t", 0.25).withColumn("cost", F.round("cost", 6))


@query("""WITH s AS (SELECT p_brand AS project, p_type AS opt, count(*) AS n_rows, CAST(max(p_size) AS BIGINT) AS seconds, CAST(sum(CASE WHEN p_size > 40 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed FROM part GROUP BY ALL)
SELECT project, count(*) AS n_opts, CAST(sum(n_rows) AS BIGINT) AS n_rows, max(n_rows) AS most_rows, max(seconds) AS seconds, CAST(sum(n_failed) AS BIGINT) AS n_failed, CASE WHEN sum(n_failed) = 0 THEN 'done' WHEN sum(n_failed) < sum(n_rows) THEN 'partly' ELSE 'failed' END AS status FROM s GROUP BY project""")
def status_rollup(spark, sf_dir):
    per_opt = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("project"), F.col("p_type").alias("opt")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("p_size").cast("long").alias("seconds"), F.count_if(F.col("p_size") > 40).alias("n_failed"))
    return audit.project_status(per_opt, "project")


@query("""WITH r AS (SELECT l_returnflag AS f, l_linestatus AS s, l_discount AS v FROM lineitem) SELECT grp, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT 'all' AS grp, v FROM r UNION ALL SELECT CASE WHEN f <> 'N' OR s = 'F' THEN 'hits' ELSE 'others' END, v FROM r UNION ALL SELECT 'signature:' || f, v FROM r WHERE f <> 'N' UNION ALL SELECT 'signature:F', v FROM r WHERE s = 'F') x GROUP BY grp""")
def hit_groups(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem")
    found = F.array_compact(F.array(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.when(F.col("l_linestatus") == "F", F.lit("F"))))
    return audit.hit_groups(r.select(found.alias("hits"), "l_discount"), "hits", "l_discount").withColumn("mean", F.round("mean", 6))


@query("""SELECT p_brand AS grp, count(*) AS n_rows, round(sum(p_size % 5) * 1.0 / sum(p_size % 7), 9) AS micro, round(avg(CASE WHEN p_size % 7 = 0 THEN 0 ELSE (p_size % 5) * 1.0 / (p_size % 7) END), 9) AS macro FROM part GROUP BY 1""")
def micro_macro(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), (F.col("p_size") % 5).alias("shared"), (F.col("p_size") % 7).alias("total"))
    out = audit.micro_macro(p, ["grp"], "shared", "total")
    return out.select("grp", "n_rows", F.round("micro", 9).alias("micro"), F.round("macro", 9).alias("macro"))


@query("""WITH c AS (SELECT 'l_returnflag' AS field, unnest(['A', 'N', 'R', 'X']) AS class UNION ALL SELECT 'l_linestatus', unnest(['O', 'F', 'Z'])),
n AS (SELECT 'l_returnflag' AS field, l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL)
SELECT c.field, c.class, coalesce(n, 0) AS n, round(coalesce(n, 0) * 1.0 / (SELECT count(*) FROM lineitem), 9) AS rate FROM c LEFT JOIN n ON n.field = c.field AND n.class = c.class""")
def class_rates(spark, sf_dir):
    out = audit.class_rates(table(spark, sf_dir, "lineitem"), {"l_returnflag": ("A", "N", "R", "X"), "l_linestatus": ("O", "F", "Z")})
    return out.withColumn("rate", F.round("rate", 9))


@query("""WITH r AS (SELECT p_size / 50.0 AS s, p_partkey % 4 = 0 AS f FROM part) SELECT count(*) AS n, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged, round(avg(s), 9) AS mean, round(avg(CASE WHEN f THEN s END), 9) AS mean_flagged,
round(sum(CASE WHEN f THEN 1 - s ELSE 0 END) / count(*), 9) AS gain, round(avg(CASE WHEN f THEN 1 ELSE s END), 9) AS ceiling FROM r""")
def ceiling(spark, sf_dir):
    out = audit.ceiling(table(spark, sf_dir, "part").select((F.col("p_size") / 50).alias("s"), (F.col("p_partkey") % 4 == 0).alias("f")), F.col("s"), F.col("f"))
    return out.select("n", "n_flagged", *[F.round(c, 9).alias(c) for c in ("mean", "mean_flagged", "gain", "ceiling")])


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS h FROM orders WHERE o_orderkey % 5 > 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 7 > 0)
SELECT CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1""")
def reproduction(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("h"))
    return audit.reproduction(o.filter("id % 5 > 0"), o.filter("id % 7 > 0").withColumn("h", F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("h"))), "id", "h")


@query("""WITH h AS (SELECT p_partkey AS id, p_size > 45 AS f, row_number() OVER (ORDER BY sha256('r' || chr(0) || CAST(p_partkey AS VARCHAR))) AS k FROM part), a AS (SELECT id, 'any' AS picked FROM h WHERE k <= 60),
m AS (SELECT id, row_number() OVER (ORDER BY k) AS n FROM h WHERE f AND k > 60) SELECT id, picked FROM a UNION ALL SELECT id, 'flagged' FROM m WHERE n <= 20""")
def flagged_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", seeded("r", F.col("p_partkey")).alias("k"))
    return audit.flagged_sample(rows, ["k"], F.col("p_size") > 45, 60, 20).select("id", "picked")


@query("""WITH r AS (SELECT p_brand AS grp, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r, greatest(count(*) OVER (PARTITION BY p_brand) // 4, 1) AS step FROM part) SELECT grp, id FROM r WHERE r % step = 0 AND r < 4 * step""")
def evenly_spaced(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"))
    return audit.evenly_spaced(rows, ["grp"], ["id"], 4).select("grp", "id")


@query("""WITH r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY length(text), doc_id) AS n FROM documents) SELECT lang, source, doc_id FROM r WHERE n <= 8""")
def shortest_texts(spark, sf_dir):
    return audit.shortest(table(spark, sf_dir, "documents"), ["lang", "source"], "text", "doc_id", 8).select("lang", "source", "doc_id")


@query("""SELECT p_partkey AS id, p_partkey % 6 = 0 AS fit, p_partkey % 6 IN (0, 4) AS fit_any FROM part""")
def repository_eligibility(spark, sf_dir):
    k = F.col("p_partkey") % 6
    name = F.when(k == 1, "awesome-list").otherwise(F.col("p_name"))
    about = F.when(k == 2, "a curated_list of things").when(k == 4, "an app").otherwise("small C library")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("n"), about.alias("a"), (k == 3).alias("fork"), F.when(k != 5, "MIT").alias("lic"))
    of = lambda **more: audit.eligible(F.col("n"), F.col("a"), F.col("fork"), F.col("lic"), "^awesome", "curated list", **more)
    return rows.select("id", of(needed="library").alias("fit"), of().alias("fit_any"))


@query("""SELECT doc_id, doc_id % 3 = 0 OR length(text) > 4000 AS generated FROM documents""")
def generated_files(spark, sf_dir):
    head = F.when(F.col("doc_id") % 3 == 0, "/* Generated by bison */\n").when(F.col("doc_id") % 3 == 1, F.concat(F.repeat(F.lit(" "), F.lit(2048)), F.lit("/* Generated by bison */"))).otherwise("")
    content = F.concat(head, F.lit("int x;")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", audit.is_generated(content, F.length("text"), "Generated by (bison|flex)", most=4000).alias("generated"))


@query("""WITH s AS (SELECT o_custkey AS scope, o_orderkey AS id, o_orderkey % 50 AS lo, o_orderkey % 50 + 20 AS hi FROM orders), h AS (SELECT c_custkey AS scope, unnest([5, 22, 40]) AS lo, unnest([9, 23, 52]) AS hi FROM customer),
p AS (SELECT s.scope, s.id, v FROM s, unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT))) AS x(v)), k AS (SELECT p.* FROM p LEFT JOIN h ON h.scope = p.scope AND v >= h.lo AND v < h.hi WHERE h.scope IS NULL),
g AS (SELECT *, v - row_number() OVER (PARTITION BY scope, id ORDER BY v) AS island FROM k) SELECT scope, id, min(v) AS lo, max(v) + 1 AS hi FROM g GROUP BY scope, id, island""")
def subtract_intervals(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).alias("lo"), (F.col("o_orderkey") % 50 + 20).alias("hi"))
    holes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope"), F.inline(F.array(*[F.struct(F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi")) for a, b in ((5, 9), (22, 23), (40, 52))])))
    return audit.subtract_intervals(spans, holes, "scope", 16)


@query("""WITH f AS (SELECT p_brand AS scope, p_type AS wide, p_name AS node, min(p_partkey) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), c AS (SELECT p_partkey AS id, p_brand AS scope, p_type AS wide, p_name AS callee FROM part WHERE p_partkey % 2 = 1),
w AS (SELECT wide, node, arg_min(v, scope) AS v FROM f GROUP BY ALL) SELECT c.id, coalesce(f.v, w.v) AS callee_v FROM c LEFT JOIN f ON f.scope = c.scope AND f.wide = c.wide AND f.node = c.callee LEFT JOIN w ON w.wide = c.wide AND w.node = c.callee""")
def callee_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    functions = p.filter("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("scope"), F.col("p_type").alias("wide"), F.col("p_name").alias("node")).agg(F.min("p_partkey").alias("v"))
    calls = p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("scope"), F.col("p_type").alias("wide"), F.col("p_name").alias("callee"))
    return audit.resolve_callees(calls, functions, "scope", "wide", "node", "callee", ["v"]).select("id", "callee_v")


@query(r"""WITH n AS (SELECT p_partkey AS node, p_size AS n, 'line of ' || p_name AS asm, 'sum ' || CAST(p_partkey AS VARCHAR) AS s FROM part), e AS (SELECT node, i, node // 2 + i - 1 AS c FROM n, unnest([1, 2, 3]) AS x(i)),
h AS (SELECT e.node, e.i, c.* EXCLUDE (node), c.node AS c FROM e JOIN n c ON c.node = e.c), b AS (SELECT h.node, h.i, e.i AS j, '  ' || n.s AS line FROM h JOIN e ON e.node = h.c JOIN n ON n.node = e.c WHERE h.n > 40 AND e.i <= 2),
l AS (SELECT node, i, 0 AS j, CASE WHEN n <= 40 THEN '; ' || CAST(c AS VARCHAR) || ' (' || CAST(n AS VARCHAR) || ' instructions):' || chr(10) || asm ELSE s END AS line FROM h UNION ALL SELECT * FROM b)
SELECT node, string_agg(line, chr(10) ORDER BY i, j) AS context FROM l GROUP BY node""")
def deep_context(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.lit(0).alias("scope"), k.cast("string").alias("node"), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: (F.floor(k / 2) + i).cast("string")).alias("calls"), F.col("p_size").alias("n"), F.concat(F.lit("line of "), "p_name").alias("asm"), F.concat(F.lit("sum "), k.cast("string")).alias("s"))
    return audit.deep_context(rows, ["scope"], "node", "calls", "n", "asm", "s", second=2).select(F.col("node").cast("long").alias("node"), "context")


@query("""SELECT text AS item, count(DISTINCT conv_id) AS n_values, count(*) AS n_rows FROM (SELECT CASE WHEN conv_id % 3 = 0 THEN role ELSE text END AS text, conv_id FROM conversations) c GROUP BY text HAVING count(DISTINCT conv_id) > 1""")
def conflicting_values(spark, sf_dir):
    from millrace.operators import dedupe

    rows = table(spark, sf_dir, "conversations").select(F.when(F.col("conv_id") % 3 == 0, F.col("role")).otherwise(F.col("text")).alias("item"), "conv_id")
    return dedupe.multi_valued(rows, "item", "conv_id")


@query("""WITH n AS (SELECT p_brand AS scope, p_partkey AS node, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS after FROM part) SELECT scope, node, coalesce(after, node + 1) - node AS size FROM n""")
def next_boundary(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("node"))
    after = F.lead("node").over(Window.partitionBy("scope").orderBy("node"))
    return p.select("scope", "node", (F.coalesce(after, F.col("node") + 1) - F.col("node")).alias("size"))
