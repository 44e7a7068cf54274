"""Queries of evaluations, leak audits, simulations and whole jobs, with SQL that works from the columns the inputs are made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.text import seeded
from millrace.operators import evaluate, graph, leaks, pipelines, simulate
from millrace.plans.name_queries import _DRAWS, PAIRS, pairs
from millrace.plans.registry import query, table

_NONE = "CAST([] AS VARCHAR[])"


def _runs(spark, sf_dir):
    """Parts: gold name, the next part of the brand as one run, the one after as the other; both may lack a name."""
    after = lambda n: F.coalesce(F.lead("p_name", n).over(Window.partitionBy("p_brand").orderBy("p_partkey")), F.lit(""))
    p = table(spark, sf_dir, "part").withColumn("a", after(1)).withColumn("b", after(2))
    state = F.when(F.col("p_size") % 3 == 0, "none").when(F.col("p_size") % 3 == 1, "cut").otherwise("whole")
    data = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("gold"), F.col("p_type").alias("opt"), F.col("p_brand").alias("project"), state.alias("state"), F.array(F.lit("red"), F.lit("blue")).alias("prefixes"))
    return data, *(p.select(F.col("p_partkey").alias("id"), F.col(c).alias("pred")) for c in "ab")


def _f1(a, b):
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


_BARE = "list_filter({0}, lambda t: t <> 'red' AND t <> 'blue')"
_RUNS = f"""q AS (SELECT p_partkey AS id, p_brand AS project, p_type AS opt, CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'cut' ELSE 'whole' END AS state, p_name AS gold, coalesce(lead(p_name, 1) OVER w, '') AS a, coalesce(lead(p_name, 2) OVER w, '') AS b FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
t AS (SELECT *, list_distinct(list_filter(string_split(gold, ' '), lambda x: x <> '')) AS g, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(b, ' '), lambda x: x <> '')) AS y FROM q),
u AS (SELECT *, {_BARE.format("x")} AS x1, {_BARE.format("y")} AS y1, CASE WHEN len({_BARE.format("g")}) = 0 THEN g ELSE {_BARE.format("g")} END AS g1 FROM t),
runs AS (SELECT id, project, opt, state, {_f1("x", "g")} AS f1, {_f1("y", "g")} AS base_f1, {_f1("x1", "g1")} AS bare_f1, {_f1("y1", "g1")} AS base_bare_f1, a = gold AS exact FROM u)"""
_STATES = ["none", "cut", "whole", "other"]


@query(f"""WITH {_RUNS}, s AS (SELECT coalesce(opt, 'all') AS opt, coalesce(state, 'all') AS state, count(*) AS n, avg(f1) AS f1, avg(base_f1) AS base_f1, avg(bare_f1) AS bare_f1, avg(base_bare_f1) AS base_bare_f1, CAST(sum(CASE WHEN exact THEN 1 ELSE 0 END) AS BIGINT) AS n_exact FROM runs GROUP BY CUBE (opt, state)),
c AS (SELECT o.v AS opt, s.v AS state FROM (SELECT DISTINCT p_type AS v FROM part UNION SELECT 'all') o, (SELECT unnest({_STATES + ['all']}) AS v) s)
SELECT c.opt, c.state, coalesce(n, 0) AS n, round(f1, 6) AS f1, round(base_f1, 6) AS base_f1, round(f1 - base_f1, 6) AS diff, round(bare_f1, 6) AS bare_f1, round(base_bare_f1, 6) AS base_bare_f1, coalesce(n_exact, 0) AS n_exact FROM c LEFT JOIN s ON s.opt = c.opt AND s.state = c.state""")
def paired_measurement(spark, sf_dir):
    rows = evaluate.paired_runs(*_runs(spark, sf_dir))
    opts = sorted(r["opt"] for r in rows.select("opt").distinct().collect())
    out = evaluate.paired_summary(rows, opts, _STATES)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _sql_draws(repeats, seed, low, high):
    return _DRAWS.replace("range(200)", f"range({repeats})").replace("'boot'", f"'{seed}'").replace("xs[6]", f"xs[{low + 1}]").replace("xs[196]", f"xs[{high + 1}]")


_UNITS = f"WITH {_RUNS}, un AS (SELECT project AS unit, sum(f1 - base_f1) AS total, count(*) AS weight FROM runs GROUP BY project)"


@query(_UNITS + _sql_draws(400, "pair", 10, 390).replace("SELECT round(xs", "SELECT (SELECT count(*) FROM un) AS n_clusters, (SELECT round(sum(total) / sum(weight), 6) FROM un) AS diff, round(xs"))
def paired_interval(spark, sf_dir):
    rows = evaluate.paired_runs(*_runs(spark, sf_dir))
    out = evaluate.cluster_interval(rows, "project", F.col("f1") - F.col("base_f1"), 400, "pair")
    return out.select("n_clusters", *[F.round(c, 6).alias(c) for c in ("diff", "low", "high")])


@query(_UNITS + _sql_draws(2000, "gate", 49, 1949).replace("SELECT round(xs", "SELECT (SELECT count(*) FROM un) AS n_clusters, coalesce((SELECT sum(total) / sum(weight) FROM un) >= 0.01 AND xs[50] > 0, false) AS passed, round(xs"))
def pilot_gate(spark, sf_dir):
    """The pilot's fixed places of 2,000 repeats, and its gate; both arms' answers are all valid here."""
    rows = evaluate.paired_runs(*_runs(spark, sf_dir))
    out = evaluate.cluster_interval(rows, "project", F.col("f1") - F.col("base_f1"), 2000, "gate", (49, 1949))
    gate = evaluate.screening_gate(F.col("diff"), F.col("low"), F.lit(1.0), F.lit(1.0))
    return out.select("n_clusters", gate.alias("passed"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT p_partkey AS id, (p_size % 5) / 100.0 >= 0.01 AND p_size % 7 > 2 AND p_size % 2 = 0 AS passed FROM part")
def decision_gates(spark, sf_dir):
    p, n = table(spark, sf_dir, "part"), F.col("p_size")
    low = F.when(n % 7 == 1, F.lit(None)).otherwise((n % 7 - 2) / 10)
    return p.select(F.col("p_partkey").alias("id"), evaluate.screening_gate(n % 5 / 100, low, F.when(n % 2 == 0, 0.9).otherwise(0.8), F.lit(0.9)).alias("passed"))


_SCORES = f"""WITH {PAIRS}, fo AS (SELECT *, list_distinct(g) AS gd, list_distinct(p) AS pd FROM f), b AS (SELECT *, {_BARE.format("pd")} AS p1, CASE WHEN len({_BARE.format("gd")}) = 0 THEN gd ELSE {_BARE.format("gd")} END AS g1 FROM fo),
k AS (SELECT id, f1 AS name_f1, {_f1("p1", "g1")} AS bare_f1, CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END AS exact FROM b)"""


@query(_SCORES + """ SELECT m AS metric, count(*) AS n, round(avg(v), 6) AS mean, round(avg(v - name_f1), 6) AS diff, CAST(sum(CASE WHEN v - name_f1 > 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS n_up, CAST(sum(CASE WHEN v - name_f1 < -1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS n_down
FROM (SELECT 'name_f1' AS m, name_f1 AS v, name_f1 FROM k UNION ALL SELECT 'bare_f1', bare_f1, name_f1 FROM k UNION ALL SELECT 'exact', exact, name_f1 FROM k) x GROUP BY m""")
def metric_comparison(spark, sf_dir):
    """Three of the five metrics; name_pr_synonym and narrow_match_f1 have those that fold words."""
    rows = pairs(spark, sf_dir).select("id", "gold", F.coalesce("pred", F.lit("")).alias("pred"), F.array(F.lit("red"), F.lit("blue")).alias("prefixes"))
    out = evaluate.metric_comparison(evaluate.metric_scores(rows)).filter(F.col("metric").isin("name_f1", "bare_f1", "exact"))
    return out.select("metric", "n", F.round("mean", 6).alias("mean"), F.round("diff", 6).alias("diff"), "n_up", "n_down")


_L = "l AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS system, (l_partkey % 4) AS x, (l_suppkey % 4) AS y, (l_orderkey % 3) AS z FROM lineitem)"


def _labels(spark, sf_dir):
    word = lambda c, words: F.element_at(F.array(*map(F.lit, words)), (c % len(words) + 1).cast("int"))
    r = table(spark, sf_dir, "lineitem")
    return r.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), word(F.col("l_linenumber"), "abc").alias("system"), word(F.col("l_partkey"), evaluate.LABELS).alias("x"), word(F.col("l_suppkey"), evaluate.LABELS).alias("y"), word(F.col("l_orderkey"), evaluate.INVENTED).alias("invented"))


_SUM = f"""{_L}, s AS (SELECT system, count(*) AS n, avg(((CASE x WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END) + (CASE y WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END) + CASE WHEN z = 0 THEN 1 ELSE 0 END) / 3) AS mean,
avg(((CASE WHEN x < 3 THEN 1.0 ELSE 0 END) + (CASE WHEN y < 3 THEN 1 ELSE 0 END) + CASE WHEN z < 2 THEN 1 ELSE 0 END) / 3) AS decided, sum(CASE WHEN z = 1 THEN 1 ELSE 0 END) * 1.0 / count(*) AS some_rate, sum(CASE WHEN z > 0 THEN 1 ELSE 0 END) * 1.0 / count(*) AS risk_rate FROM l GROUP BY system)"""


@query(f"WITH {_SUM} SELECT system, n, round(mean, 6) AS mean, round(decided, 6) AS decided, round(some_rate, 6) AS some_rate, round(risk_rate, 6) AS risk_rate FROM s")
def label_summary(spark, sf_dir):
    out = evaluate.label_summary(_labels(spark, sf_dir), "system", ("x", "y"))
    return out.select("system", "n", *[F.round(c, 6).alias(c) for c in ("mean", "decided", "some_rate", "risk_rate")])


@query(f"WITH {_SUM} SELECT c.system, c.decided >= r.decided AS decided_kept, c.some_rate <= r.some_rate AS some_kept, c.risk_rate <= r.risk_rate AS risk_kept, c.decided >= r.decided AND c.some_rate <= r.some_rate AND c.risk_rate <= r.risk_rate AS safe FROM s c JOIN s r ON r.system = 'a' AND c.system <> 'a'")
def safety_gates(spark, sf_dir):
    return evaluate.safety_gates(evaluate.label_summary(_labels(spark, sf_dir), "system", ("x", "y")), "system", "a")


@query("""WITH l AS (SELECT doc_id, quality AS q1, toxic AS t1, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS q2, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE toxic END AS t2 FROM labels),
c AS (SELECT 'quality' AS field, q1 AS a, q2 AS b FROM l UNION ALL SELECT 'toxic', t1, t2 FROM l), s AS (SELECT field, count(*) AS n, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS n_agree, sum(a) AS x, sum(b) AS y FROM c GROUP BY field),
k AS (SELECT field, n, n_agree, n_agree * 1.0 / n AS po, (x * y + (n - x) * (n - y)) * 1.0 / (n * n) AS pe FROM s) SELECT field, n, n_agree, round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / (1 - pe), 9) AS kappa FROM k""")
def rater_agreement(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    other = labels.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(F.col("toxic")).alias("toxic"))
    out = evaluate.agreement(labels, other, "doc_id", ("quality", "toxic"))
    return out.select("field", "n", "n_agree", *[F.round(c, 9).alias(c) for c in ("po", "pe", "kappa")])


@query("SELECT 'A' || lpad(CAST(row_number() OVER (ORDER BY sha256('43' || chr(0) || CAST(item_id AS VARCHAR) || chr(0) || s)) AS VARCHAR), 4, '0') AS sample, item_id AS id, s AS system, text FROM benchmark, unnest(['base', 'new']) AS x(s)")
def blind_package(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.explode(F.array(F.lit("base"), F.lit("new"))).alias("system"))
    return evaluate.blind_package(rows, "id", "system", "43", ["text"])


@query("""WITH s AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 3 END AS p, (o_orderkey % 11) / 11.0 AS f FROM orders) SELECT count(*) AS n, count(p) AS n_scored, count(*) - count(p) AS n_errors, round(avg(p), 6) AS mean, round(sum(CASE WHEN p = 2 THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS right_rate,
round(sum(CASE WHEN p = 2 THEN 1 ELSE 0 END) * 1.0 / count(p), 6) AS right_rate_valid, round(sum(CASE WHEN p = 1 THEN 1 ELSE 0 END) * 1.0 / count(p), 6) AS partly_rate, round(sum(CASE WHEN p = 0 THEN 1 ELSE 0 END) * 1.0 / count(p), 6) AS wrong_rate, round(avg(CASE WHEN p = 2 THEN f END), 6) AS f1_right, round(avg(CASE WHEN p = 0 THEN f END), 6) AS f1_wrong FROM s""")
def judged_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 3).alias("p"), (F.col("o_orderkey") % 11 / 11).alias("f"))
    out = evaluate.judged_summary(rows, "p", "f")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("SELECT grp AS category, n, round(mean, 6) AS mean FROM (SELECT p_type AS grp, count(*) AS n, avg(p_size % 3) AS mean FROM part WHERE p_partkey % 5 > 0 GROUP BY 1) x")
def teacher_scores(spark, sf_dir):
    """Labels that have a text, by category: the teacher's descriptions as judged."""
    from millrace.operators import joins

    p = table(spark, sf_dir, "part").withColumn("key", F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")))
    merged = joins.label_merge(p.filter("p_partkey % 5 > 0").select("key", F.col("p_name").alias("text"), F.lit("m").alias("model")), p.select("key", F.col("p_type").alias("category"), F.lit("").alias("model")), "key", ["category"], "unknown")
    scores = merged.join(p.select("key", (F.col("p_size") % 3).alias("score")), "key")
    return scores.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


_P = "p AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') AS nm, p_brand AS project, p_size AS n FROM part)"


def _fn(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("nm"), F.col("p_brand").alias("project"), F.col("p_size").alias("n"))


@query(f"""WITH {_P} SELECT k, 'context' AS section, nm AS name FROM p WHERE n % 5 = 1 UNION ALL SELECT k, 'decompiled', nm FROM p WHERE n % 5 IN (2, 3) UNION ALL SELECT k, 'asm', 'x_' || nm FROM p WHERE n % 7 = 0""")
def leak_gate(spark, sf_dir):
    """A name is no leak as a mnemonic, in a string, or as an import of the row; the same import in decompiled code is one. The
    target (without its prefix) leaks like the name unless it is an import."""
    nm, n = F.col("nm"), F.col("n")
    asm = F.concat(F.lit("push rbp\n"), nm, F.lit(" eax\n"), F.when(n % 5 == 3, F.concat(F.lit("call x ; -> _"), nm)).otherwise(F.concat(F.lit('lea rdi ; -> "'), nm, F.lit('"'))), F.when(n % 7 == 0, F.concat(F.lit("\ncall x_"), nm)).otherwise(""))
    context = F.when(n % 5 == 1, F.concat(F.lit("sub_1 (3 instructions): calls sub_2, strlen\n"), nm, F.lit(" (9 instructions)"))).otherwise("sub_1 (3 instructions): string \"a\"")
    decompiled = F.when(n % 5 == 2, F.concat(F.lit("int "), nm, F.lit("(void)"))).when(n % 5 == 3, F.concat(F.lit("x = _"), nm, F.lit("();"))).otherwise(F.concat(F.lit('puts("'), nm, F.lit('");')))
    rows = _fn(spark, sf_dir).select("k", "nm", F.concat(F.lit("x_"), "nm").alias("target"), asm.alias("a"), context.alias("c"), decompiled.alias("d"))
    return leaks.leak_gate(rows, "k", "nm", "target", "a", "c", "d")


@query(f"""WITH {_P} SELECT k, 'symbol' AS kind, nm AS names FROM p WHERE n % 4 = 0 UNION ALL SELECT k, 'address', '' FROM p WHERE n % 3 = 0""")
def structure_audit(spark, sf_dir):
    n = F.col("n")
    asm = F.concat(F.when(n % 4 == 0, F.concat(F.lit("call\t"), "nm")).when(n % 4 == 1, F.concat("nm", F.lit("\teax"))).when(n % 4 == 2, F.concat(F.lit('lea\trdi ; -> "'), "nm", F.lit('"'))).otherwise(F.concat(F.lit("call\text_"), "nm")), F.when(n % 3 == 0, "\njmp 0x12").otherwise("\nloc_1:"))
    rows = _fn(spark, sf_dir).select("project", "k", asm.alias("a"), F.array(F.lit("malloc")).alias("ok"))
    names = _fn(spark, sf_dir).select("project", F.col("nm").alias("name"))
    out = leaks.structure_audit(rows, names, "project", "k", F.col("a"), F.lit(""), "ok")
    return out.select("k", "kind", F.array_join("names", ",").alias("names"))


@query(f"""WITH {_P} SELECT project, count(*) AS n, CAST(sum(CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_changed, least(count(*), 50) AS n_checked, CAST(0 AS BIGINT) AS n_after FROM p GROUP BY project""")
def residual_names(spark, sf_dir):
    """Every second text calls another function of its project; after anonymising none is left."""
    rows = _fn(spark, sf_dir)
    other = F.min("nm").over(Window.partitionBy("project"))
    rows = rows.select("project", "k", "nm", F.when(F.col("n") % 2 == 0, F.concat(F.lit("x = "), other, F.lit("(1);"))).otherwise("y = free(x);").alias("code"), F.array(F.lit("free")).alias("ok"))
    names = rows.select("project", F.col("nm").alias("name"))
    return leaks.residual_names(rows, names, "project", "k", "code", "nm", "ok", 50).select("project", "n", "n_changed", "n_checked", "n_after")


_SIM = f"""{_P}, c AS (SELECT p.k, p.project, p.nm, o.nm AS callee, o.n % 2 = 0 AS known FROM p LEFT JOIN p o ON o.k = p.k // 2 AND o.k <> p.k AND o.project = p.project),
m AS (SELECT k, project, nm, mode, CASE WHEN mode = 'gold' THEN callee WHEN mode = 'predicted' AND known THEN 'pred_' || callee WHEN mode = 'gold_where_predicted' AND known THEN callee END AS seen FROM c, unnest(['anonymous', 'gold', 'predicted', 'gold_where_predicted']) AS x(mode)),
w AS (SELECT *, list_distinct(string_split(nm, '_')) AS t, CASE WHEN seen IS NULL THEN {_NONE} ELSE list_distinct(string_split(seen, '_')) END AS h FROM m), s AS (SELECT *, CAST(len(list_intersect(t, h)) AS BIGINT) AS sh FROM w)"""


@query(f"""WITH {_SIM}, a AS (SELECT mode, coalesce(project, 'all') AS project, count(*) AS rows, CAST(sum(CASE WHEN sh > 0 THEN 1 ELSE 0 END) AS BIGINT) AS any_rows, CAST(sum(CASE WHEN sh = len(t) THEN 1 ELSE 0 END) AS BIGINT) AS all_rows, CAST(sum(sh) AS BIGINT) AS shared_tokens, CAST(sum(len(t)) AS BIGINT) AS target_tokens,
round(sum(sh) * 1.0 / sum(len(t)), 6) AS micro, round(avg(sh * 1.0 / len(t)), 6) AS macro, round(avg(CASE WHEN sh = 0 THEN 0 ELSE 2.0 * sh / (len(t) + len(h)) END), 6) AS best_copy FROM s GROUP BY GROUPING SETS ((mode, project), (mode))) SELECT * FROM a""")
def lexical_simulation(spark, sf_dir):
    """A context names the function at half of the row's number, if that is in the same project."""
    rows = _fn(spark, sf_dir)
    symbol = lambda k: F.format_string("sub_%04x", k)
    asked = rows.select(F.col("k").alias("id"), "project", symbol(F.col("k")).alias("symbol"), F.concat(symbol(F.floor(F.col("k") / 2)), F.lit(' (3 instructions): string "'), "nm", F.lit('"; x')).alias("context"), F.col("nm").alias("gold"), F.array().cast("array<string>").alias("prefixes"))
    functions = rows.select("project", symbol(F.col("k")).alias("symbol"), F.col("nm").alias("name"))
    predictions = rows.filter("n % 2 = 0").select("project", symbol(F.col("k")).alias("symbol"), F.concat(F.lit("pred_"), "nm").alias("name")).union(rows.filter("n % 2 = 1").select("project", symbol(F.col("k")), F.lit("sub_0001")))
    out = simulate.lexical_summary(simulate.lexical_modes(asked.withColumn("scope", F.col("project")), functions.withColumnRenamed("project", "scope"), predictions.withColumnRenamed("project", "scope"), "scope", "id"))
    return out.select("mode", "project", "rows", "any_rows", "all_rows", "shared_tokens", "target_tokens", *[F.round(c, 6).alias(c) for c in ("micro", "macro", "best_copy")])


@query("""WITH n AS (SELECT p_brand AS scope, p_partkey AS node, p_partkey // 2 AS dst FROM part), k AS (SELECT n.* FROM n JOIN n m ON m.scope = n.scope AND m.node = n.dst)
SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM k) AS n_edges, (SELECT count(*) FROM n) - (SELECT count(*) FROM k) AS n_missing, CAST(0 AS BIGINT) AS n_leaves, (SELECT count(*) FROM n) - (SELECT count(*) FROM k) AS n_sinks, (SELECT count(*) FROM n) AS n_components, (SELECT count(*) FROM k WHERE node = dst) AS n_recursive""")
def graph_statistics(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("node"), F.array(F.floor(F.col("p_partkey") / 2).cast("long")).alias("calls"))
    return graph.graph_stats(nodes, "scope", "node", "calls")


@query("""WITH e AS (SELECT o_orderkey AS id, o_orderpriority AS project, o_orderstatus AS d, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END AS m, o_orderkey % 4 > 0 AS mapped FROM orders)
SELECT 'train' AS role, project, count(*) AS n, count(m) AS n_found, CAST(sum(CASE WHEN m = d THEN 1 ELSE 0 END) AS BIGINT) AS n_same, CAST(sum(CASE WHEN m IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, CAST(sum(CASE WHEN m <> d THEN 1 ELSE 0 END) AS BIGINT) AS n_changed, CAST(sum(CASE WHEN mapped THEN 0 ELSE 1 END) AS BIGINT) AS n_unmapped, CAST(sum(CASE WHEN m = d AND mapped THEN 1 ELSE 0 END) AS BIGINT) AS n_safe FROM e GROUP BY project""")
def reproduction_audit(spark, sf_dir):
    return _reproduced(spark, sf_dir)[0]


def _reproduced(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project"), F.lit("train").alias("role"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("digest"))
    made = o.filter("id % 3 > 0").select("id", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("digest")).alias("digest"))
    return pipelines.reproduction_audit(o, made, o.filter("id % 4 > 0"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderpriority AS project, -o_orderkey AS ordinal FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 4 > 0) SELECT project, min(ordinal) OVER (PARTITION BY project) AS project_place, id, ordinal FROM s""")
def safe_queue(spark, sf_dir):
    safe = _reproduced(spark, sf_dir)[1]
    return pipelines.safe_queue(safe, safe.select("id", (-F.col("id")).alias("ordinal")))


@query("""WITH r AS (SELECT p_brand AS project, '-O' || CAST(p_size % 3 AS VARCHAR) AS opt, p_partkey AS id, row_number() OVER (PARTITION BY p_brand, p_size % 3 ORDER BY sha256('e' || chr(0) || CAST(p_partkey AS VARCHAR))) AS n FROM part WHERE p_partkey % 4 > 0 AND p_size % 3 IN (0, 2)) SELECT project, opt, id FROM r WHERE n <= 12""")
def evaluation_set(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.concat(F.lit("-O"), (F.col("p_size") % 3).cast("string")).alias("opt"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4 == 0).alias("leaked"), seeded("e", F.col("p_partkey")).alias("k"))
    return pipelines.evaluation_set(rows, ["k"], 12, ("-O0", "-O2")).select("project", "opt", "id")


@query("""WITH f AS (SELECT c_custkey AS k, c_name AS name, c_custkey % 3 = 0 AS t, c_acctbal AS stars, 3 + c_custkey % 5 AS n FROM customer WHERE c_custkey % 10 > 0), g AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY stars DESC, 'https://h/' || lower(name)) AS r FROM f WHERE n BETWEEN 4 AND CASE WHEN t THEN 6 ELSE 9 END)
SELECT 'https://h/' || lower(name) AS url, name, CASE WHEN t THEN 'test' WHEN CAST(('0x' || substr(sha1(name), 1, 8)) AS BIGINT) / 4294967296.0 < 0.08 THEN 'valid' ELSE 'train' END AS role, stars, n AS n_files FROM g WHERE r <= CASE WHEN t THEN 20 ELSE 50 END""")
def candidate_repositories(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("url", F.concat(F.lit("https://h/"), "c_name"))
    found = c.select(F.when(k % 3 == 0, "test").otherwise("train").alias("pool"), F.concat("url", F.when(k % 2 == 0, "/").otherwise("")).alias("url"), F.col("c_name").alias("name"), F.lit("a C library").alias("about"), F.lit(False).alias("fork"), F.lit("MIT").alias("license"), F.col("c_acctbal").alias("stars"))
    found = found.unionByName(found.filter("pool = 'test'").withColumn("pool", F.lit("train")))
    files = F.concat(F.transform(F.sequence(F.lit(1), (3 + k % 5).cast("int")), lambda i: F.concat(F.lit("src/f"), i.cast("string"), F.lit(".c"))), F.array(F.lit("test/x.c"), F.lit(".git/y.c"), F.lit("a.cpp"), F.lit("src/x_test.c")))
    trees = c.select("url", F.explode(files).alias("path"))
    known = c.filter(k % 10 == 0).select("url")
    return pipelines.candidates(found, known, trees, "^awesome", "curated", "library", "app for", "^tests?$", r"_test\.c$", {"test": (4, 6, 20), "train": (4, 9, 50)})


@query("""WITH n AS (SELECT (SELECT count(*) FROM orders) AS t, (SELECT count(*) FROM supplier) AS v) SELECT t AS n_train, v AS n_valid, CAST(160 AS BIGINT) AS rows_per_arm, CAST(160 * 2048 AS BIGINT) AS train_tokens, v * 2048 AS valid_tokens, v * 1888 AS prompt_tokens, v * 160 AS new_tokens, CAST(20 AS BIGINT) AS steps_total, 2 * v AS generations_total, CAST(2 * 160 * 2048 AS BIGINT) AS train_tokens_total FROM n""")
def pilot_plan(spark, sf_dir):
    return pipelines.two_arm_plan(table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier"), 10, 16, 2048, 160, 1_000_000)


@query(f"""WITH {_P} SELECT k, CASE n % 3 WHEN 0 THEN 'mine' || chr(10) || '[model] ' || nm WHEN 1 THEN 'a' || chr(13) || chr(10) || '[model] x' || chr(13) || chr(10) || '[model] ' || nm ELSE '[model] old' END AS comment FROM p""")
def merged_comments(spark, sf_dir):
    old = F.when(F.col("n") % 3 == 0, "[model] was\nmine").when(F.col("n") % 3 == 1, "a\r\n[model] was\r\n").otherwise("[model] old")
    new = F.when(F.col("n") % 3 == 0, F.col("nm")).when(F.col("n") % 3 == 1, F.concat(F.lit("x\n"), "nm")).otherwise(" ")
    return _fn(spark, sf_dir).select("k", T.merge_comment(old, new).alias("comment"))


@query(f"""WITH {_P}, c AS (SELECT unnest(list_filter(['all', 'opt:-O' || CAST(n % 2 AS VARCHAR), 'size:' || CASE WHEN n < 20 THEN '<20' ELSE '20-59' END, CASE WHEN n % 3 = 0 THEN 'wrapper' END, CASE WHEN n % 5 = 0 THEN 'leaf' END, CASE WHEN n % 7 = 0 THEN 'string' END, CASE WHEN n % 4 = 0 THEN 'import' END], lambda x: x IS NOT NULL)) AS class, n FROM p) SELECT class, count(*) AS rows, round(avg(n), 6) AS mean FROM c GROUP BY class""")
def function_classes(spark, sf_dir):
    n = F.col("n")
    labels = T.function_classes(F.concat(F.lit("-O"), (n % 2).cast("string")), n, n % 3 == 0, n % 5 == 0, n % 7 == 0, n % 4 == 0)
    return _fn(spark, sf_dir).select("n", F.explode(labels).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("n"), 6).alias("mean"))


@query("""WITH d AS (SELECT doc_id, lang, source, text, doc_id % 4 = 0 AS raw FROM documents), b AS (SELECT *, 6 + floor((length(text) + 3) / 4) AS t FROM d)
SELECT CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split, count(*) AS n_input, CAST(sum(CASE WHEN lang = 'en' AND doc_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_generic FROM b GROUP BY 1""")
def prepared_counts(spark, sf_dir):
    _, counts = _prepared(spark, sf_dir)
    return counts.select("split", "n_input", "n_generic")


def _prepared(spark, sf_dir, **more):
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, "main").otherwise(F.concat("source", F.lit("_get"), F.col("doc_id").cast("string")))
    functions = d.select(F.when(F.col("lang") == "en", "train").otherwise("test").alias("split"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("project"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".c")).alias("file"), F.lit("-O0").alias("opt"), name.alias("name"), F.substring("text", 1, 2000).alias("asm"), F.lit("").alias("context"))
    texts = functions.filter("cast(id as long) % 3 > 0").select(F.concat_ws("/", "project", F.concat_ws(":", "file", "name")).alias("key"), F.lit("ein Text").alias("text"), F.lit("a text").alias("text_en"))
    prefixes = functions.select("project").distinct().select("project", F.array("project").alias("words"))
    return pipelines.prepare_rows(functions, texts, prefixes, "name it", more.pop("most", 400), **more)


@query("""WITH d AS (SELECT doc_id, lang, source, source || '_get' || CAST(doc_id AS VARCHAR) AS name FROM documents WHERE doc_id % 10 > 0) SELECT CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split, CAST(doc_id AS VARCHAR) AS id,
CASE WHEN doc_id % 3 > 0 THEN '{"description_en":"a text","name":"' || CASE WHEN lang = 'en' THEN 'get' || CAST(doc_id AS VARCHAR) ELSE name END || '","description":"ein Text"}' ELSE '{"name":"' || CASE WHEN lang = 'en' THEN 'get' || CAST(doc_id AS VARCHAR) ELSE name END || '"}' END AS target FROM d""")
def prepared_targets(spark, sf_dir):
    """Targets of all rows but generic ones, which stay in the test split only."""
    rows, _ = _prepared(spark, sf_dir, most=10_000)
    return rows.filter("name <> 'main'").select("split", "id", F.element_at("messages", 3)["content"].alias("target"))


@query("""WITH d AS (SELECT doc_id, lang, doc_id % 5 AS k FROM documents WHERE doc_id % 10 > 0) SELECT CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'target_name' WHEN 2 THEN 'budget' END AS reason, k IN (3, 4) AS has_code, k = 4 AS code_cut, CAST(CASE WHEN k = 3 THEN 1 ELSE 0 END AS BIGINT) AS n_renamed, count(*) AS n FROM d GROUP BY ALL""")
def prepared_code(spark, sf_dir):
    """Decompiled code is missing, shows the name, is one long line, fits with a call renamed, or is cut at a line."""
    name = F.concat("source", F.lit("_get"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents").filter("doc_id % 10 > 0").select("doc_id", "source")
    d = d.join(d.groupBy("source").agg(F.min(name).alias("least")), "source", "left")
    k = F.col("doc_id") % 5
    code = F.when(k == 1, F.concat(F.lit('x = "'), name, F.lit('"; y = '), F.upper(name), F.lit(";"))).when(k == 2, F.repeat(F.lit("z"), F.lit(9000))).when(k == 3, F.concat(F.lit("x = "), "least", F.lit("(1);"))).when(k == 4, F.repeat(F.lit("a = b + c;\n"), F.lit(900)))
    functions = d.select(F.lit("test").alias("split"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("project"), F.lit("f.c").alias("file"), F.lit("-O0").alias("opt"), name.alias("name"), F.lit("mov").alias("asm"), F.lit("").alias("context"))
    decompiled = d.select(F.col("doc_id").cast("string").alias("id"), code.alias("code"))
    texts = functions.select(F.lit("none").alias("key"), F.lit("").alias("text"), F.lit("").alias("text_en")).limit(1)
    prefixes = functions.select("project", F.array().cast("array<string>").alias("words")).distinct()
    rows, _ = pipelines.prepare_rows(functions, texts, prefixes, "name it", 600, decompiled)
    return rows.groupBy(F.col("code_reason").alias("reason"), "has_code", "code_cut", F.when(F.col("has_code"), F.col("n_renamed")).otherwise(0).alias("n_renamed")).agg(F.count(F.lit(1)).alias("n"))
