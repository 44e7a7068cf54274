"""Queries on keyed rows: labels, orders, line items, events, conversations, graphs."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.text import hash_share, seeded
from millrace.operators import dedupe, graph, joins, prepare, report, select, stats
from millrace.plans.registry import query, table


@query("""WITH m AS (SELECT quality AS a, 1 - toxic AS b FROM labels), t AS (SELECT count(*) AS n, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS n_agree, sum(a) AS a1, sum(b) AS b1 FROM m),
k AS (SELECT n, n_agree, n_agree * 1.0 / n AS po, (a1 * b1 + (n - a1) * (n - b1)) * 1.0 / (n * n) AS pe FROM t) SELECT n, n_agree, round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / (1 - pe), 9) AS kappa FROM k""")
def kappa(spark, sf_dir):
    out = stats.kappa(table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")), "a", "b")
    return out.select("n", "n_agree", *[F.round(c, 9).alias(c) for c in ("po", "pe", "kappa")])


@query("""SELECT quality, count(*) AS n, round(avg((quality * 1.0 + (1 - toxic) * 1.0 + CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0 END + CASE WHEN toxic = 0 THEN 1.0 ELSE 0 END) / 4), 6) AS score FROM labels GROUP BY quality""")
def rubric_score(spark, sf_dir):
    part = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = (F.col("quality") * 1.0 + (1 - F.col("toxic")) * 1.0 + F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(0.0) + part(F.col("toxic") == 0)) / 4
    return table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("score"))


@query("""WITH d AS (SELECT d.doc_id, l.quality, l.toxic, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS n, count(quality) AS n_scored, count(*) - count(quality) AS n_errors, CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_right,
round(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) * 1.0 / count(*), 9) AS rate_all, round(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) * 1.0 / count(quality), 9) AS rate_valid, round(avg(CASE WHEN quality = 0 THEN n_chars END), 6) AS mean_at_0 FROM d""")
def judge_two_denominators(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    right = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0))
    n, valid = F.count(F.lit(1)), F.count("quality")
    return d.agg(n.alias("n"), valid.alias("n_scored"), (n - valid).alias("n_errors"), right.alias("n_right"), F.round(right / n, 9).alias("rate_all"), F.round(right / valid, 9).alias("rate_valid"), F.round(F.avg(F.when(F.col("quality") == 0, F.col("n_chars"))), 6).alias("mean_at_0"))


@query("""SELECT l_returnflag AS grp, count(*) AS n, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_extendedprice, 0.99) AS p99, max(l_extendedprice) AS most FROM lineitem GROUP BY 1""")
def nearest_rank_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice")
    return stats.order_statistics(rows, "grp", "l_extendedprice", {f"p{p}": stats.nearest_rank(p) for p in (50, 90, 99)} | {"most": lambda n: n})


@query("""WITH x AS (SELECT event_type AS grp, list_sort(list(value)) AS xs, count(value) AS n FROM events GROUP BY 1)
SELECT grp, n, xs[CAST(least(n, floor(n * 0.025) + 1) AS INTEGER)] AS low, xs[CAST(least(n, floor(n * 0.975) + 1) AS INTEGER)] AS high FROM x""")
def floor_rank_quantile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), "value")
    return stats.order_statistics(rows, "grp", "value", {"low": stats.floor_rank(0.025), "high": stats.floor_rank(0.975)})


@query("SELECT o_orderpriority AS grp, count(o_totalprice) AS n, round(median(o_totalprice), 6) AS median FROM orders GROUP BY 1")
def medians_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), "o_totalprice")
    return stats.medians(rows, "grp", "o_totalprice").withColumn("median", F.round("median", 6))


@query("""WITH c AS (SELECT o_custkey AS k, o_orderpriority AS v, count(*) AS n, min(o_orderkey) AS s FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, s) AS i FROM c) SELECT k, v, n FROM r WHERE i = 1""")
def mode_first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), "o_orderkey")
    return stats.mode_first_seen(rows, "k", "v", "o_orderkey")


@query("""WITH i AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY sha256('9' || chr(0) || CAST(o_orderkey AS VARCHAR))) AS pos FROM orders)
SELECT i.pos, i.id, o.o_orderstatus AS status FROM i JOIN orders o ON o.o_orderkey = i.id""")
def ordered_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    ids = orders.select("id", seeded("9", F.col("id")).alias("k"))
    ids = select.length_buckets(ids, F.col("k"), F.lit(0), 1 << 30).select("id", F.col("position").cast("long").alias("pos"))
    return joins.ordered_lookup(ids, orders, "id", "pos").select("pos", "id", "status")


@query("""WITH u AS (SELECT o_orderkey AS id, 0 AS r, o_totalprice AS v FROM orders UNION ALL SELECT o_orderkey, 1, o_totalprice + 1 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 2, o_totalprice + 2 FROM orders WHERE o_orderkey % 3 = 0)
SELECT id, arg_max(v, r) AS v, count(*) AS versions FROM u GROUP BY id""")
def overlay_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return joins.overlay([o, o.filter("id % 2 = 0").withColumn("v", F.col("v") + 1), o.filter("id % 3 = 0").withColumn("v", F.col("v") + 2)], "id")


@query("""WITH s AS (SELECT user_id % 100 AS scope, ts AS at, min(event_id) AS start_id FROM events WHERE event_type = 'login' OR event_id % 7 = 0 GROUP BY ALL)
SELECT e.event_id, s.start_id FROM events e ASOF LEFT JOIN s ON e.user_id % 100 = s.scope AND e.ts >= s.at""")
def lower_bound_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100).alias("scope"), F.col("ts").alias("at"), "event_type")
    starts = e.filter("event_type = 'login' or event_id % 7 = 0").groupBy("scope", "at").agg(F.min("event_id").alias("start_id"))
    return joins.lower_bound(e.drop("event_type"), starts, "scope", "at", ["start_id"]).select("event_id", "start_id")


@query("""WITH e AS (SELECT user_id, ts, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS best FROM events) SELECT event_id, best FROM e""")
def running_best(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.max("value").over(w).alias("best"))


@query("SELECT count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def anti_resume(spark, sf_dir):
    todo = joins.resume(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1)
    return todo.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("""WITH m AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS first_text, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, max(CASE WHEN role = 'user' THEN turn END) AS last_user, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id) SELECT * FROM m""")
def chat_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    first = F.array_max(F.transform(F.filter("m", lambda x: x["turn"] == 0), lambda x: x["text"]))
    last_user = F.array_max(F.transform(F.filter("m", lambda x: x["role"] == "user"), lambda x: x["turn"]))
    chars = F.aggregate(F.transform("m", lambda x: F.length(x["text"])), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("conv_id", first.alias("first_text"), F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), last_user.alias("last_user"), chars.alias("chars"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'name' END AS kind, CASE WHEN p_size % 2 = 0 THEN '{"description_en":"' || p_type || '","name":"' || p_name || '","description":"' || p_brand || '"}' ELSE '{"name":"' || p_name || '"}' END AS target FROM part""")
def chat_target(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    even = F.col("p_size") % 2 == 0
    made, kind = prepare.target(F.col("p_name"), F.when(even, F.col("p_brand")), F.when(even, F.col("p_type")))
    rows = p.select(F.col("p_partkey").alias("id"), kind.alias("kind"), prepare.messages(F.lit("name it"), F.col("p_type"), made).alias("m"))
    return rows.select("id", "kind", prepare.message_of(F.col("m"), "assistant").alias("target"))


@query("""WITH h AS (SELECT o_orderkey AS id, sha256('b' || chr(0) || CAST(o_orderkey AS VARCHAR)) AS k, length(o_orderpriority) AS len FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i FROM h)
SELECT id, CAST(i // 800 AS BIGINT) AS bucket, CAST((i // 800) * 800 + row_number() OVER (PARTITION BY i // 800 ORDER BY len DESC, i) AS BIGINT) AS position FROM r""")
def length_bucket_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.length("o_orderpriority").alias("len"))
    return select.length_buckets(o, seeded("b", F.col("id")), F.col("len")).select("id", "bucket", "position")


@query("""SELECT CASE WHEN CAST(('0x' || substr(sha1(c_name), 1, 8)) AS BIGINT) / 4294967296.0 < 0.08 THEN 'valid' ELSE 'train' END AS role, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS id_sum FROM customer GROUP BY 1""")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.when(hash_share(F.col("c_name")) < 0.08, "valid").otherwise("train").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("id_sum"))


def _nodes(spark, sf_dir):
    """Parts call the parts that their number names: the scope is the brand, so some callees are missing."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("node"))
    return p.withColumn("calls", F.array(F.floor(F.col("node") / 2).cast("long"), (F.col("node") * 7 % 400).cast("long")))


_EDGES = "n AS (SELECT p_brand AS scope, p_partkey AS node FROM part), e AS (SELECT DISTINCT scope, node AS src, unnest([node // 2, node * 7 % 400]) AS dst FROM n), k AS (SELECT e.* FROM e JOIN n ON n.scope = e.scope AND n.node = e.dst)"


@query("WITH " + _EDGES + " SELECT scope, count(*) AS n_edges, (SELECT count(*) FROM e WHERE e.scope = k.scope) - count(*) AS n_missing FROM k GROUP BY scope")
def call_edges(spark, sf_dir):
    known, missing = graph.call_edges(_nodes(spark, sf_dir), ["scope"], "node", "calls")
    a = known.groupBy("scope").agg(F.count(F.lit(1)).alias("n_edges"))
    return a.join(missing.groupBy("scope").agg(F.count(F.lit(1)).alias("n_missing")), "scope", "left").select("scope", "n_edges", F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


@query("WITH RECURSIVE " + _EDGES + """, r AS (SELECT scope, src, dst FROM k UNION SELECT r.scope, r.src, k.dst FROM r JOIN k ON k.scope = r.scope AND k.src = r.dst),
m AS (SELECT a.scope, a.src AS node, a.dst AS other FROM r a JOIN r b ON b.scope = a.scope AND b.src = a.dst AND b.dst = a.src UNION SELECT scope, node, node FROM n),
c AS (SELECT scope, node, min(other) AS rep, count(*) AS component_size FROM m GROUP BY ALL), ce AS (SELECT DISTINCT k.scope, a.rep AS src, b.rep AS dst FROM k JOIN c a ON a.scope = k.scope AND a.node = k.src JOIN c b ON b.scope = k.scope AND b.node = k.dst WHERE a.rep <> b.rep),
d AS (SELECT DISTINCT scope, rep, 0 AS depth FROM c UNION SELECT ce.scope, ce.src, d.depth + 1 FROM d JOIN ce ON ce.scope = d.scope AND ce.dst = d.rep), l AS (SELECT scope, rep, max(depth) AS level FROM d GROUP BY ALL)
SELECT c.scope, c.node, c.component_size, EXISTS (SELECT 1 FROM r WHERE r.scope = c.scope AND r.src = c.node AND r.dst = c.node) AS recursive, CAST(l.level AS BIGINT) AS level, true AS callees_first FROM c JOIN l ON l.scope = c.scope AND l.rep = c.rep""")
def scc_levels(spark, sf_dir):
    """Components, levels, and whether each callee's component comes before that of the caller, or is the same."""
    nodes = _nodes(spark, sf_dir)
    known, _ = graph.call_edges(nodes, ["scope"], "node", "calls")
    found = graph.components(nodes, known, "scope", "node")
    place = found.select("scope", F.col("node").alias("dst"), F.col("component").alias("_c"))
    last = known.join(place, ["scope", "dst"]).groupBy("scope", F.col("src").alias("node")).agg(F.max("_c").alias("_last"))
    out = found.join(last, ["scope", "node"], "left")
    return out.select("scope", "node", "component_size", "recursive", "level", (F.coalesce("_last", F.lit(-1)) <= F.col("component")).alias("callees_first"))


@query("""WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS v, p_size <= 25 AS w, CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 2000000 WHEN p_partkey % 10 = 1 THEN p_partkey + 1 WHEN p_partkey % 10 = 2 THEN p_partkey - 1 ELSE p_partkey + 3 END AS callee FROM part),
c AS (SELECT a.id FROM n a JOIN n b ON a.callee = b.id AND b.callee = a.id), x AS (SELECT n.*, o.id AS oid, o.v AS ov, c.id AS cid FROM n LEFT JOIN n o ON o.id = n.callee LEFT JOIN c ON c.id = n.id)
SELECT CASE WHEN NOT w THEN 'own' WHEN cid IS NOT NULL THEN 'cycle' WHEN oid IS NULL THEN 'unresolved' WHEN ov = '' THEN 'invalid' ELSE 'moved' END AS how, count(*) AS n, CAST(sum(length(CASE WHEN w AND cid IS NULL AND oid IS NOT NULL AND ov <> '' THEN ov ELSE v END)) AS BIGINT) AS chars FROM x GROUP BY 1""")
def one_step_transfer(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    callee = F.when(k % 4 == 0, k + 2000000).when(k % 10 == 1, k + 1).when(k % 10 == 2, k - 1).otherwise(k + 3)
    rows = p.select(k.alias("id"), F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("v"), (F.col("p_size") <= 25).alias("w"), callee.alias("callee"))
    edges = rows.select(F.col("id").alias("src"), F.col("callee").alias("dst"))
    cyclic = graph.on_cycle(edges, math.ceil(math.log2(max(2, p.count()))))
    out = graph.one_step_transfer(rows, "id", "callee", "v", "w", cyclic)
    return out.groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("v")).alias("chars"))


@query("""SELECT l_linestatus AS state, map_from_entries(list_sort(list({'k': f, 'v': n}))) AS counts FROM (SELECT l_linestatus, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY ALL) x GROUP BY 1""".replace("map_from_entries(list_sort(list({'k': f, 'v': n})))", "string_agg(f || '=' || CAST(n AS VARCHAR), ',' ORDER BY f)"))
def histogram(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("state"), F.col("l_returnflag").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("state").agg(report.histogram(counts, "f").alias("m"))
    return rows.select("state", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(avg(l_discount), 6) AS mean_discount, min(l_shipdate) AS first_date FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL""")
def line_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02 00:00:00").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.min("l_shipdate").alias("first_date"))


@query("""WITH r AS (SELECT doc_id, source, lang AS role, md5(text) AS h FROM documents), a AS (SELECT DISTINCT role, h AS v FROM r), s AS (SELECT DISTINCT role, source AS v FROM r)
SELECT 'h' AS key, x.role AS left, y.role AS right, count(*) AS n FROM a x JOIN a y ON x.v = y.v AND x.role < y.role GROUP BY ALL UNION ALL SELECT 'source', x.role, y.role, count(*) FROM s x JOIN s y ON x.v = y.v AND x.role < y.role GROUP BY ALL""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def cross_split_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("role"), "source", F.md5("text").alias("h"))
    return dedupe.split_overlap(rows, "role", ["h", "source"])
