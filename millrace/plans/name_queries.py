"""Queries on names: parts stand for functions (gold name), the next part of the brand for the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import names as N
from millrace.functions.text import seeded, size_class
from millrace.operators import joins, prepare, report, select, stats
from millrace.plans.registry import query, table


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("gold"), after.alias("pred"), F.col("p_type").alias("grp"), F.col("p_brand").alias("project"), F.col("p_size").alias("size"))
    return rows.withColumn("g", N.tokens(F.col("gold"))).withColumn("p", N.tokens(F.coalesce("pred", F.lit(""))))


TOKENS = r"list_filter(regexp_split_to_array(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
PAIRS = f"""pairs AS (SELECT p_partkey AS id, p_name AS gold, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pred, p_type AS grp, p_brand AS project, p_size AS size FROM part),
tok AS (SELECT *, {TOKENS.format("gold")} AS g, {TOKENS.format("coalesce(pred, '')")} AS p FROM pairs),
sc AS (SELECT *, CAST(len(list_intersect(list_distinct(g), list_distinct(p))) AS BIGINT) AS c, CAST(len(list_distinct(g)) AS BIGINT) AS ng, CAST(len(list_distinct(p)) AS BIGINT) AS np FROM tok),
f AS (SELECT *, CASE WHEN ng + np = 0 THEN 0.0 ELSE 2.0 * c / (ng + np) END AS f1 FROM sc)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).withColumn("f1", N.f1(F.col("p"), F.col("g")))


@query(f"""WITH {PAIRS}
SELECT coalesce(grp, 'all') AS grp, count(*) AS n, CAST(sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS BIGINT) AS exact_hits, CAST(sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, round(avg(f1), 6) AS mean_f1
FROM f GROUP BY ROLLUP (grp)""")
def name_f1_rollup(spark, sf_dir):
    hits = F.count_if(F.col("gold") == F.col("pred")).alias("exact_hits")
    return report.with_total(scored(spark, sf_dir), "grp", F.count(F.lit(1)).alias("n"), hits, F.count_if(F.col("f1") == 0).alias("zeros"), F.round(F.avg("f1"), 6).alias("mean_f1"))


_FOLD = "CASE {0} " + " ".join(f"WHEN '{w}' THEN '{g[0]}'" for g in N.SYNONYMS for w in g[1:]) + " ELSE {0} END"


@query(f"""WITH {PAIRS}, fo AS (SELECT id, c, ng, np, list_distinct(list_transform(g, lambda w: {_FOLD.format("w")})) AS g2, list_distinct(list_transform(p, lambda w: {_FOLD.format("w")})) AS p2 FROM f)
SELECT id, c AS n_shared, ng AS n_gold, np AS n_pred, CAST(len(list_intersect(g2, p2)) AS BIGINT) AS n_shared_folded, CAST(len(g2) AS BIGINT) AS n_gold_folded, CAST(len(p2) AS BIGINT) AS n_pred_folded FROM fo""")
def name_pr_synonym(spark, sf_dir):
    g2, p2 = (N.fold(F.col(x), N.SYNONYMS) for x in "gp")
    return pairs(spark, sf_dir).select("id", N.shared(F.col("p"), F.col("g")).alias("n_shared"), N.n_distinct(F.col("g")).alias("n_gold"), N.n_distinct(F.col("p")).alias("n_pred"), N.shared(p2, g2).alias("n_shared_folded"), N.n_distinct(g2).alias("n_gold_folded"), N.n_distinct(p2).alias("n_pred_folded"))


@query(f"""WITH {PAIRS}, pre AS (SELECT project, list(w) AS ws FROM (SELECT project, g[1] AS w, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 0) x JOIN (SELECT project, count(*) AS total FROM f GROUP BY project) y USING (project) WHERE n >= total * 0.1 GROUP BY project),
s AS (SELECT f.*, list_filter(g, lambda t: NOT list_contains(coalesce(ws, CAST([] AS VARCHAR[])), t)) AS g0, list_filter(p, lambda t: NOT list_contains(coalesce(ws, CAST([] AS VARCHAR[])), t)) AS p1 FROM f LEFT JOIN pre USING (project)),
k AS (SELECT *, list_distinct(CASE WHEN len(g0) = 0 THEN g ELSE g0 END) AS g1 FROM s)
SELECT id, CAST(len(g1) AS BIGINT) AS n_gold, CAST(len(list_distinct(p1)) AS BIGINT) AS n_pred, CAST(len(list_intersect(g1, list_distinct(p1))) AS BIGINT) AS n_shared FROM k""")
def name_f1_prefix_stripped(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    words = prepare.first_word_prefixes(rows, "project", "g").groupBy("project").agg(F.collect_list("prefix").alias("ws"))
    rows = rows.join(words, "project", "left").withColumn("ws", F.coalesce("ws", F.array().cast("array<string>")))
    p, g = N.without_prefixes(F.col("p"), F.col("g"), F.col("ws"))
    return rows.select("id", N.n_distinct(g).alias("n_gold"), N.n_distinct(p).alias("n_pred"), N.shared(p, g).alias("n_shared"))


_NARROW = "CASE {0} " + " ".join(f"WHEN '{w}' THEN '{g[0]}'" for g in N.NARROW for w in g[1:]) + " ELSE {0} END"


@query(f"""WITH {PAIRS}, gs AS (SELECT id, {_NARROW.format("w")} AS k, count(*) AS n FROM (SELECT id, unnest(list_distinct(g)) AS w FROM f) x GROUP BY ALL),
ps AS (SELECT id, {_NARROW.format("w")} AS k, count(*) AS n FROM (SELECT id, unnest(list_distinct(p)) AS w FROM f) x GROUP BY ALL),
m AS (SELECT gs.id, sum(least(gs.n, ps.n)) AS m FROM gs JOIN ps ON gs.id = ps.id AND gs.k = ps.k GROUP BY gs.id)
SELECT f.id, round(CASE WHEN ng + np = 0 THEN 0.0 ELSE 2.0 * coalesce(m.m, 0) / (ng + np) END, 9) AS narrow FROM f LEFT JOIN m ON f.id = m.id""")
def narrow_match_f1(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", F.round(N.narrow_f1(F.col("p"), F.col("g")), 9).alias("narrow"))


def customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.when(F.col("c_custkey") % 3 > 0, F.concat(F.substring(F.lower("c_mktsegment"), 1, 4), F.lit("_"))).otherwise(""), F.lit("fn"), F.col("c_custkey").cast("string")).alias("name"), F.lower("c_mktsegment").alias("project"), F.col("c_custkey").alias("id"))


CUSTOMERS = "cu AS (SELECT CASE WHEN c_custkey % 3 > 0 THEN substr(lower(c_mktsegment), 1, 4) || '_' ELSE '' END || 'fn' || CAST(c_custkey AS VARCHAR) AS name, lower(c_mktsegment) AS project, c_custkey AS id FROM customer)"
_PREFIX = CUSTOMERS + """, nm AS (SELECT DISTINCT project, name FROM cu), t AS (SELECT project, count(*) AS n_names FROM nm GROUP BY project),
c AS (SELECT project, regexp_extract(name, '^([A-Za-z][A-Za-z0-9]{1,11})_', 1) AS prefix, count(*) AS n FROM nm GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, prefix) AS k FROM c WHERE prefix <> '' {where})
SELECT project, prefix, n, n_names FROM r JOIN t USING (project) WHERE k = 1 AND n >= 5 AND n >= n_names * 0.3"""


@query("WITH " + _PREFIX.replace("{where}", ""))
def prefix_rule_freq(spark, sf_dir):
    return prepare.frequent_prefixes(customers(spark, sf_dir), "project", "name", False)


@query("WITH " + _PREFIX.replace("{where}", "AND (starts_with(project, lower(prefix)) OR starts_with(lower(prefix), project))"))
def prefix_rule_related(spark, sf_dir):
    return prepare.frequent_prefixes(customers(spark, sf_dir), "project", "name", True)


@query("WITH " + CUSTOMERS + """, s AS (SELECT project, name, regexp_replace(name, '^(auto|buil|furn|hous|mach)_', '') AS st FROM cu),
x AS (SELECT project, regexp_replace(st, '[0-9]{2}$', '') AS stripped, count(DISTINCT name) AS n_names FROM s GROUP BY ALL)
SELECT project, stripped, n_names FROM x WHERE n_names > 1""")
def prefix_collisions(spark, sf_dir):
    rows = customers(spark, sf_dir)
    bare = N.strip_prefix(F.col("name"), F.array(*map(F.lit, ("auto", "buil", "furn", "hous", "mach"))))
    return prepare.prefix_collisions(rows.withColumn("s", F.regexp_replace(bare, "[0-9]{2}$", "")), "project", "name", "s")


@query(f"""WITH {PAIRS} SELECT project, max(k) AS best_copies, count(*) AS n FROM (SELECT f.project, f.id, (SELECT max(len(list_intersect(list_distinct(f.g), list_distinct(t.g)))) FROM tok t WHERE t.project = f.project AND t.id BETWEEN f.id - 40 AND f.id - 1) AS k FROM f) x GROUP BY project""")
def lexical_best_copy(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    w = Window.partitionBy("project").orderBy("id").rangeBetween(-40, -1)
    near = rows.withColumn("cand", F.collect_list("g").over(w))
    k = F.array_max(F.transform("cand", lambda c: F.size(F.array_intersect(c, F.col("g")))).cast("array<bigint>"))
    return near.withColumn("k", k).groupBy("project").agg(F.max("k").alias("best_copies"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PAIRS}, b AS (SELECT *, CASE WHEN size < 20 THEN '<20' ELSE '20+' END AS state FROM f),
g AS (SELECT grp, state, count(*) AS n, round(avg(f1), 6) AS mean FROM b GROUP BY GROUPING SETS ((grp, state), (grp), (state))),
d AS (SELECT x.grp, y.state FROM (SELECT DISTINCT p_type AS grp FROM part UNION ALL SELECT 'all') x, (SELECT '<20' AS state UNION ALL SELECT '20+' UNION ALL SELECT 'none' UNION ALL SELECT 'all') y WHERE x.grp <> 'all' OR y.state <> 'all')
SELECT d.grp, d.state, coalesce(g.n, 0) AS n, g.mean FROM d LEFT JOIN g ON coalesce(g.grp, 'all') = d.grp AND coalesce(g.state, 'all') = d.state""")
def grouping_sets_grid(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("state", F.when(F.col("size") < 20, "<20").otherwise("20+"))
    states = spark.range(1).select(F.explode(F.array(F.lit("<20"), F.lit("20+"), F.lit("none"))).alias("state"))
    out = report.grid(rows, "grp", "state", rows.select("grp").distinct(), states, "f1")
    return out.withColumn("mean", F.round("mean", 6))


@query(f"""WITH {PAIRS}, o AS (SELECT project, grp, avg(f1) AS v, count(*) AS k FROM f GROUP BY ALL)
SELECT a.grp AS a, b.grp AS b, count(*) AS n, CAST(sum(CASE WHEN b.v > a.v + 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS n_up, CAST(sum(CASE WHEN b.v < a.v - 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS n_down, round(avg(b.v - a.v), 6) AS mean_diff
FROM o a JOIN o b ON a.project = b.project AND a.grp < b.grp GROUP BY 1, 2""")
def opt_pairs(spark, sf_dir):
    o = scored(spark, sf_dir).groupBy("project", "grp").agg(F.avg("f1").alias("v"))
    a, b = o.select("project", F.col("grp").alias("a"), F.col("v").alias("va")), o.select("project", F.col("grp").alias("b"), F.col("v").alias("vb"))
    d = F.col("vb") - F.col("va")
    return a.join(b, "project").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(d > 1e-9).alias("n_up"), F.count_if(d < -1e-9).alias("n_down"), F.round(F.avg(d), 6).alias("mean_diff"))


@query(f"""WITH {PAIRS} SELECT count(*) AS n, CAST(sum(CASE WHEN f1 > 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS n_up, CAST(sum(CASE WHEN f1 < 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS n_down, round(avg(f1 - 0.25), 6) AS mean_diff FROM f""")
def paired_diff(spark, sf_dir):
    d = F.col("f1") - 0.25
    return scored(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(d > 0).alias("n_up"), F.count_if(d < 0).alias("n_down"), F.round(F.avg(d), 6).alias("mean_diff"))


_DRAWS = """, nu AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS place, count(*) OVER () AS n FROM un),
dr AS (SELECT rep, CAST(('0x' || substr(sha256('boot' || chr(0) || CAST(rep AS VARCHAR) || chr(0) || CAST(place AS VARCHAR)), 1, 8)) AS BIGINT) % n AS place FROM nu, (SELECT unnest(range(200)) AS rep) r),
sa AS (SELECT rep, sum(total) * 1.0 / sum(weight) AS v FROM dr JOIN nu USING (place) GROUP BY rep),
so AS (SELECT list_sort(list(v)) AS xs FROM sa)
SELECT round(xs[6], 6) AS low, round(xs[196], 6) AS high FROM so"""


def _boot(units: DataFrame) -> DataFrame:
    samples = stats.bootstrap_means(units.withColumn("scope", F.lit(0)), "scope", "total", "weight", 200, "boot")
    return stats.interval(samples, "scope", *stats.places(200)).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH {PAIRS}, un AS (SELECT project AS unit, sum(c) AS total, count(*) AS weight FROM f GROUP BY project)" + _DRAWS)
def cluster_bootstrap(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("c", N.shared(F.col("p"), F.col("g")))
    return _boot(rows.groupBy(F.col("project").alias("unit")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("weight")))


@query(f"WITH {PAIRS}, un AS (SELECT id AS unit, c AS total, 1 AS weight FROM f)" + _DRAWS)
def row_bootstrap(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return _boot(rows.select(F.col("id").alias("unit"), N.shared(F.col("p"), F.col("g")).alias("total"), F.lit(1).alias("weight")))


@query("""WITH h AS (SELECT p_partkey AS id, p_type AS grp, sha256('7' || chr(0) || CAST(p_partkey AS VARCHAR)) AS k FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k) AS round FROM h), t AS (SELECT *, row_number() OVER (ORDER BY round, grp, k) AS pos FROM r)
SELECT id, grp, CAST(round AS INTEGER) AS round FROM t WHERE pos <= 300""")
def round_robin_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("grp"), seeded("7", F.col("p_partkey")).alias("k"))
    return select.round_robin(rows, "grp", ["k"], 300).select("id", "grp", "round")


@query("""WITH h AS (SELECT p_partkey AS id, p_brand AS grp, sha256('5' || chr(0) || CAST(p_partkey AS VARCHAR)) AS k FROM part),
s AS (SELECT grp, count(*) AS c, (SELECT count(*) FROM part) AS t FROM h GROUP BY grp), q AS (SELECT grp, c * 100 // t AS w, (c * 100) % t AS rest FROM s),
z AS (SELECT grp, w + CASE WHEN row_number() OVER (ORDER BY rest DESC, grp) <= 100 - (SELECT sum(w) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT h.*, row_number() OVER (PARTITION BY grp ORDER BY k) AS n FROM h)
SELECT id, r.grp FROM r JOIN z ON r.grp = z.grp WHERE n <= quota""")
def largest_remainder_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), seeded("5", F.col("p_partkey")).alias("k"))
    return select.stratified(rows, "grp", ["k"], 100).select("id", "grp")


@query("""WITH h AS (SELECT p_partkey AS id, p_brand AS grp, p_type AS opt, sha256('3' || chr(0) || CAST(p_partkey AS VARCHAR)) AS k FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, opt ORDER BY k) AS n FROM h) SELECT id, grp, opt FROM r WHERE n <= 3""")
def cap_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_type").alias("opt"), seeded("3", F.col("p_partkey")).alias("k"))
    return select.cap_per_group(rows, ["grp", "opt"], 3, ["k"]).select("id", "grp", "opt")


_W4 = """WITH h AS (SELECT p_partkey AS id, p_brand AS project, p_name AS unit, -ln(1 - CAST(('0x' || substr(sha256('w' || chr(0) || CAST(p_partkey AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0) / (1 + p_size % 3) AS d FROM part),
v AS (SELECT *, row_number() OVER (PARTITION BY project, unit ORDER BY d) AS variant FROM h), v2 AS (SELECT * FROM v WHERE variant <= 2),
c AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY variant, d) AS place FROM v2), k AS (SELECT *, row_number() OVER (ORDER BY variant, d) AS pos FROM c WHERE variant = 1 OR place <= 60)
SELECT id, project, unit, CAST(variant AS INTEGER) AS variant FROM k WHERE pos <= 1200"""


@query(_W4)
def weighted_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("project"), F.col("p_name").alias("unit"), (1 + F.col("p_size") % 3).alias("w"))
    u = F.conv(F.substring(seeded("w", F.col("id")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return select.weighted_variants(rows.withColumn("u", u), ["project", "unit"], "project", F.col("w"), F.col("u"), 1200, 60).select("id", "project", "unit", "variant")


@query("""SELECT p_brand AS project, p_type AS opt, p_name AS name, count(*) AS n, CASE WHEN count(*) > 1 THEN 'many' ELSE 'one' END AS state FROM part GROUP BY ALL""")
def unique_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("project"), F.col("p_type").alias("opt"), F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("state", F.when(F.col("n") > 1, "many").otherwise("one"))


@query("""WITH want AS (SELECT l_partkey AS k, p.p_brand AS b, p.p_name AS m, p.p_type AS t, l_orderkey, l_linenumber FROM lineitem JOIN part p ON p_partkey = l_partkey),
byid AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 = 0),
b4 AS (SELECT p_brand AS b, p_name AS m, p_type AS t, min(p_size) AS v FROM part GROUP BY ALL HAVING count(*) = 1), b2 AS (SELECT p_brand AS b, p_name AS m, min(p_size) AS v FROM part GROUP BY ALL HAVING count(*) = 1),
j AS (SELECT CASE WHEN byid.v IS NOT NULL THEN 'id' WHEN b4.v IS NOT NULL THEN 'four' WHEN b2.v IS NOT NULL THEN 'two' ELSE 'none' END AS rule, coalesce(byid.v, b4.v, b2.v) AS v FROM want w LEFT JOIN byid ON byid.k = w.k LEFT JOIN b4 ON b4.b = w.b AND b4.m = w.m AND b4.t = w.t LEFT JOIN b2 ON b2.b = w.b AND b2.m = w.m)
SELECT rule, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM j GROUP BY rule""")
def fallback_ladder(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("b"), F.col("p_name").alias("m"), F.col("p_type").alias("t"), F.col("p_size").alias("v"))
    want = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).join(p.drop("v"), "k")
    rungs = [("id", p.filter("k % 3 = 0").select("k", "v"), ["k"]), ("four", joins.unique_by(p, ["b", "m", "t"], "v", "v"), ["b", "m", "t"]), ("two", joins.unique_by(p, ["b", "m"], "v", "v"), ["b", "m"])]
    return joins.fallback_ladder(want, rungs, "v").groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("long").alias("total"))


@query("""WITH l AS (SELECT DISTINCT p_brand AS a, p_name AS m FROM part WHERE p_partkey % 2 = 0), r AS (SELECT DISTINCT p_brand AS b, p_name AS m FROM part WHERE p_partkey % 2 = 1),
c AS (SELECT a, b, count(*) AS n_common FROM l JOIN r USING (m) GROUP BY a, b), s AS (SELECT a, count(*) AS n_items FROM l GROUP BY a),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n_common DESC, b) AS n FROM c)
SELECT k.a, k.b, k.n_common, s.n_items FROM k JOIN s ON s.a = k.a WHERE n = 1 AND n_common >= n_items * 0.2""")
def best_overlap_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    left = p.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("a"), F.col("p_name").alias("m")).distinct()
    right = p.filter("p_partkey % 2 = 1").select(F.col("p_brand").alias("b"), F.col("p_name").alias("m")).distinct()
    return joins.best_overlap(left, right, "a", "b", "m", 0.2)


@query("""WITH o AS (SELECT p_brand AS f, p_name AS m, min(p_size) AS v FROM part WHERE p_partkey % 3 < 2 GROUP BY ALL), n AS (SELECT p_brand AS f, p_name AS m, min(p_size) AS v FROM part WHERE p_partkey % 3 > 0 GROUP BY ALL)
SELECT coalesce(o.f, n.f) AS f, coalesce(o.m, n.m) AS m, CASE WHEN n.f IS NULL THEN 'old' WHEN o.f IS NULL THEN 'new' ELSE 'both' END AS state, n.v - o.v AS change FROM o FULL JOIN n ON o.f = n.f AND o.m = n.m""")
def version_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    side = lambda c: p.filter(c).groupBy(F.col("p_brand").alias("f"), F.col("p_name").alias("m")).agg(F.min("p_size").alias("v"))
    return joins.version_diff(side("p_partkey % 3 < 2"), side("p_partkey % 3 > 0"), ["f", "m"], "v")


@query("""SELECT CASE WHEN p_size < 10 THEN '<10' WHEN p_size < 30 THEN '10-29' ELSE '30+' END AS class, count(*) AS n, count(DISTINCT p_brand) AS n_projects, median(p_size) AS median_size FROM part GROUP BY 1""")
def size_classes(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(size_class(F.col("p_size"), (10, 30)).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("n_projects"), F.median("p_size").alias("median_size"))


@query("""WITH c AS (SELECT p_name AS name, count(*) AS n, min(p_partkey) AS s FROM part GROUP BY p_name), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, s) AS k FROM c)
SELECT name, n, round(n * 1.0 / (SELECT count(*) FROM part), 9) AS share FROM r WHERE k <= 3""")
def collapse_diagnostics(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_partkey")
    return report.top_shares(rows, "name", 3, "p_partkey").withColumn("share", F.round("share", 9))
