"""Queries of sources and sinks: each writes files made of a driver's table to a scratch folder, and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import audit, joins, report
from millrace.plans.registry import query, table
from millrace.sources import calls, jsonl
from millrace.sources.scratch import new_path

_ROW = "id string, name string, balance double"
_CUSTOMERS = "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS balance FROM customer"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def _text(lines, path: str) -> str:
    lines.write.text(path)
    return path


@query(_CUSTOMERS)
def jsonl_strict(spark, sf_dir):
    """Written where nothing may stand yet, read with checks of keys."""
    path = new_path(spark, "rows")
    jsonl.write_new(_customers(spark, sf_dir), path)
    return jsonl.read_strict(spark, path, _ROW, "id")


@query(_CUSTOMERS)
def jsonl_blank_lines(spark, sf_dir):
    lines = _customers(spark, sf_dir).select(F.concat(F.to_json(F.struct("id", "name", "balance")), F.lit("\n\n")).alias("value"))
    return jsonl.read_rows(spark, _text(lines, new_path(spark, "blank")), _ROW)


@query(_CUSTOMERS)
def jsonl_torn_tails(spark, sf_dir):
    """Two files, each with a last line that is cut."""
    rows = _customers(spark, sf_dir).select("id", F.to_json(F.struct("id", "name", "balance")).alias("value"))
    path = new_path(spark, "torn")
    for half in (0, 1):
        one = rows.filter(F.col("id").cast("long") % 2 == half).select("value")
        text = one.agg(F.array_join(F.collect_list("value"), "\n").alias("t")).select(F.concat("t", F.lit('\n{"id": "9", "na')).alias("value"))
        text.write.text(f"{path}/{half}")
    return jsonl.read_tolerant(spark, f"{path}/*", _ROW)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_custkey AS a, c_nationkey AS b FROM customer")
def jsonl_unique_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    lines = c.select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.struct(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("b")).alias("x"))).alias("value"))
    out = jsonl.read_unique_keys(spark, _text(lines, new_path(spark, "keys")), "id string, name string, x struct<a: long, b: int>")
    return out.select("id", "name", "x.a", "x.b")


@query("SELECT s_name AS name, s_acctbal + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS balance, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS versions FROM supplier")
def json_catalogs(spark, sf_dir):
    """Two JSON arrays; the second one's entries replace the first one's."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    paths = []
    for rows in (s, s.filter("s_suppkey % 3 = 0").withColumn("balance", F.col("balance") + 1)):
        array = rows.agg(F.to_json(F.collect_list(F.struct("name", "balance"))).alias("value"))
        paths.append(_text(array, new_path(spark, "catalog")))
    return jsonl.read_catalogs(spark, paths, "name string, balance double", "name")


@query("SELECT s_name AS id, row_number() OVER (ORDER BY s_suppkey) * 2 - 2 AS ordinal FROM supplier")
def id_list(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))
    text = s.select(F.array_join(F.transform("s", lambda x: F.concat(F.lit("  "), x["s_name"], F.lit(" \n"))), "\n").alias("value"))
    return jsonl.read_ids(spark, _text(text, new_path(spark, "ids")) + "/part-*")


@query("SELECT CASE WHEN c_nationkey < 12 THEN 'train' ELSE 'test' END AS role, lower(c_mktsegment) AS project, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer GROUP BY ALL")
def partitioned_files(spark, sf_dir):
    """<role>/<project>.jsonl; the folder and the file's name become columns."""
    c = table(spark, sf_dir, "customer").withColumn("role", F.when(F.col("c_nationkey") < 12, "train").otherwise("test")).withColumn("project", F.lower("c_mktsegment"))
    staged, path = new_path(spark, "staged"), new_path(spark, "roles")
    c.select("role", "project", F.to_json(F.struct(F.col("c_custkey").alias("id"))).alias("value")).repartition(1).write.partitionBy("role", "project").text(staged)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(staged).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for s in fs.globStatus(hadoop.Path(f"{staged}/role=*/project=*/part-*")):
        file = s.getPath()
        project, role = file.getParent().getName().split("=")[1], file.getParent().getParent().getName().split("=")[1]
        fs.mkdirs(hadoop.Path(f"{path}/{role}"))
        fs.rename(file, hadoop.Path(f"{path}/{role}/{project}.jsonl"))
    return jsonl.read_partitioned(spark, path, "id long").groupBy("role", "project").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS balance FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def projected_rows(spark, sf_dir):
    """Two columns of the rows that have an order."""
    path = new_path(spark, "wide")
    jsonl.write_new(_customers(spark, sf_dir), path)
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"))
    return jsonl.read_projected(spark, path, "id string, balance double", wanted, "id")


@query("SELECT o_custkey AS id, arg_min(o_orderpriority, o_orderkey) AS first FROM orders GROUP BY 1")
def first_writer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("first"), "o_orderkey")
    return joins.first_writer(o, "id", "first", "o_orderkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, upper(c_name) AS name, c_acctbal AS balance FROM customer")
def replaced_rows(spark, sf_dir):
    """The second write takes the place of the first."""
    path, staging = new_path(spark, "rows"), new_path(spark, "staging")
    rows = _customers(spark, sf_dir)
    jsonl.replace(rows, path, staging)
    jsonl.replace(rows.withColumn("name", F.upper("name")), path, staging)
    return jsonl.read_strict(spark, path, _ROW, "id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'late' END AS name, c_acctbal AS balance FROM customer")
def appended_rows(spark, sf_dir):
    """Half of the rows, then those that are missing."""
    path, rows = new_path(spark, "rows"), _customers(spark, sf_dir)
    jsonl.append_missing(rows.filter("id % 2 = 0"), path, "id", _ROW)
    for _ in range(2):
        jsonl.append_missing(rows.withColumn("name", F.lit("late")), path, "id", _ROW)
    return jsonl.read_strict(spark, path, _ROW, "id")


@query("""SELECT '{' || chr(10) || string_agg('  "' || p || '": {' || chr(10) || '    "n": ' || CAST(n AS VARCHAR) || ',' || chr(10) || '    "share": ' || s || chr(10) || '  }', ',' || chr(10) ORDER BY p) || chr(10) || '}' || chr(10) AS report
FROM (SELECT o_orderpriority AS p, count(*) AS n, '0.5' AS s FROM orders GROUP BY 1) x""")
def canonical_report(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    text = report.canonical_json({r["p"]: {"share": 0.1 + 0.4, "n": r["n"]} for r in counts})
    return spark.createDataFrame([(text,)], "report string")


@query("""SELECT '| grp | n | mean |' AS line UNION ALL SELECT '|---|---|---|' UNION ALL SELECT '| ' || o_orderpriority || ' | ' || CAST(count(*) AS VARCHAR) || ' | - |' FROM orders GROUP BY o_orderpriority""")
def markdown_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.lit(None).cast("double")).alias("mean"))
    return spark.createDataFrame([(x,) for x in report.markdown(rows, ["grp"]).splitlines()], "line string")


@query("SELECT doc_id % 5 AS project, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS digest, min(sha1('blob ' || CAST(octet_length(encode(text)) AS VARCHAR) || chr(0) || text)) AS first_blob FROM documents GROUP BY 1")
def text_digests(spark, sf_dir):
    """A digest of each project's ordered digests, and the least object id of its texts in a version store."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("project"), "doc_id", "text")
    blob = F.sha1(F.concat(F.lit("blob "), F.octet_length(F.encode("text", "UTF-8")).cast("string"), F.lit("\0"), "text"))
    rows = d.select("project", F.struct("doc_id", F.sha2("text", 256).alias("h")).alias("s"), blob.alias("b"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["h"]), "\n")
    return rows.groupBy("project").agg(F.sha2(ordered, 256).alias("digest"), F.min("b").alias("first_blob"))


def _shouts(request: str) -> str:
    if request.endswith("3"):
        raise ValueError("busy")
    return request.upper()


@query("SELECT s_suppkey AS id, CASE WHEN s_name LIKE '%3' THEN NULL ELSE upper(s_name) END AS answer, s_name LIKE '%3' AS failed FROM supplier")
def service_answers(spark, sf_dir):
    """One answer a row from a stand-in for a service, which always fails for some."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return calls.answers(rows, "id", "name", _shouts, tries=2, pause=0.0).select("id", "answer", F.col("error").isNotNull().alias("failed"))


def _pages(query: str, page: int) -> list[dict]:
    n = len(query) % 7
    return [{"url": f"{query}/{i}", "stars": i} for i in range((page - 1) * 3, min(n, page * 3))]


@query("SELECT n_name AS q, n_name || '/' || CAST(i AS VARCHAR) AS url, i AS stars FROM nation, unnest(range(length(n_name) % 7)) AS x(i)")
def paged_results(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("q"))
    return calls.paged(names, "q", _pages, "url string, stars long", 3, pause=0.0)


@query("""SELECT p_partkey AS id, 'Does ' || p_name || '.' AS text FROM part WHERE p_partkey % 4 > 0""")
def teacher_texts(spark, sf_dir):
    """Texts of the parts that have none yet; parts with one name and type are asked for once."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("source"), F.col("p_name").alias("name"))
    done = p.filter("id % 4 = 0").select("id", F.lit("x").alias("text"), F.lit(None).cast("string").alias("error"))
    return calls.descriptions(p, done, "id", "source", "name", lambda r: "this function does " + r.split("\n")[0] + ". And more.", pause=0.0).select("id", "text")


@query("SELECT p_partkey * 16 AS address, p_name AS symbol, CASE WHEN p_size % 4 < 3 THEN 'src/' || CAST(p_size % 4 AS VARCHAR) || '.o' END AS object FROM part")
def link_map_sources(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lines = p.select(F.concat(F.lit("0x"), F.hex(F.col("p_partkey") * 16), F.lit("\t0x10\t[  "), (F.col("p_size") % 4).cast("string"), F.lit("] _"), "p_name").alias("value"))
    objects = spark.range(3).select(F.concat(F.lit("[  "), F.col("id").cast("string"), F.lit("] src/"), F.col("id").cast("string"), F.lit(".o")).alias("value"))
    return audit.attributed(p.select((F.col("p_partkey") * 16).alias("address"), F.col("p_name").alias("symbol")), audit.link_map(lines.union(objects)))


@query("SELECT r_name AS name, r_regionkey AS id FROM region")
def gated_rows(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("id"))
    return report.row_gate(r, {x["name"]: 1 for x in r.collect()}, "name")
