"""Queries on texts: documents stand for functions (project: source, level: lang), the benchmark for the protected split."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import constants
from millrace.functions import text as T
from millrace.operators import dedupe, joins, prepare, select
from millrace.plans.registry import query, table


@query("""WITH r AS (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) SELECT doc_id, h FROM r WHERE n = 1""")
def dedupe_first_seen(spark, sf_dir):
    return select.first_by(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h")), ["h"], ["doc_id"])


@query("""WITH r AS (SELECT doc_id, md5(text) AS h, source, n_chars % 50 AS nm, CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS role FROM documents),
m AS (SELECT r.*, CASE WHEN role = 'train' AND h IN (SELECT h FROM r WHERE role = 'test') THEN 'cross' WHEN role = 'test' AND EXISTS (SELECT 1 FROM r t WHERE t.role = 'train' AND t.source = r.source AND t.nm = r.nm) THEN 'embedded' END AS reason FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY role, h, reason IS NULL ORDER BY doc_id) AS n FROM m)
SELECT doc_id, role, coalesce(reason, CASE WHEN n > 1 THEN 'repeat' ELSE 'kept' END) AS reason FROM w""")
def split_merge_reasons(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.md5("text").alias("h"), "source", (F.col("n_chars") % 50).alias("nm"), F.when(F.col("lang") == "en", "train").otherwise("test").alias("role"))
    return dedupe.merge_reasons(rows, "role", "h", ["source", "nm"], "doc_id", "test", "train").select("doc_id", "role", "reason")


_LABELS = ("sub_00a1", "dat_42", "DAT_0F", "FUN_00401a30", "LAB_1", "PTR_DAT_0a", "PTR_FUN_0b", "PTR_LOOP_0c", "thunk_FUN_11", "FUN_main", "code_review", "joined_up", "xsub_1", "sub_zz")
_KINDS = ("sub_", "dat_", "dat_", *["ghidra_"] * 6, *_LABELS[9:])


def _case(values, key="doc_id"):
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


@query(rf"""WITH n AS (SELECT doc_id, {_case(_KINDS)} || ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT sha256(trim(t)) AS h, count(*) AS n_rows, min(doc_id) AS first_id FROM n GROUP BY 1 HAVING count(*) > 1""")
def near_dup_normalised(spark, sf_dir):
    labelled = F.concat(_pick(_LABELS, F.col("doc_id")), F.lit(" \n"), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", T.text_hash(labelled).alias("h")).filter("h is not null")
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_id")).filter("n_rows > 1")


@query(r"""SELECT doc_id, sha1(regexp_replace(text, '\b(sub|dat|ext)_[0-9a-f]{4,}\b', '\1', 'g')) AS h FROM documents""")
def asm_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normal_asm(F.col("text")).alias("h"))


_NAME = "CASE doc_id % 4 WHEN 0 THEN 'token' WHEN 1 THEN 'the' WHEN 2 THEN 'tion' ELSE 'password' END"
_WHOLE = "(^|[^A-Za-z0-9_])' || nm || '($|[^A-Za-z0-9_])"


@query(f"""WITH d AS (SELECT doc_id, text, {_NAME} AS nm FROM documents) SELECT doc_id, length(nm) > 3 AND regexp_matches(text, '(?i){_WHOLE}') AS leaked FROM d""")
def leak_flag(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", T.leak_flag(F.col("text"), F.col("nm")).alias("leaked"))


def _named(spark, sf_dir):
    k = F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").withColumn("nm", F.when(k == 0, "token").when(k == 1, "the").when(k == 2, "tion").otherwise("password"))


@query(rf"""WITH d AS (SELECT doc_id, text, {_NAME} AS nm, regexp_replace(text, '"(\\.|[^"\\])*"', '""', 'g') AS bare, regexp_extract_all(text, '"(?:\\.|[^"\\])*"') AS qs FROM documents)
SELECT CASE WHEN length(nm) < 4 OR NOT contains(text, nm) THEN 'none' WHEN regexp_matches(bare, '{_WHOLE}') THEN 'identifier' WHEN len(list_filter(qs, lambda q: contains(q, nm))) > 0 THEN 'string' ELSE 'substring' END AS kind, count(*) AS n FROM d GROUP BY 1""")
def leak_kind(spark, sf_dir):
    rows = _named(spark, sf_dir).select(F.coalesce(T.leak_kind(F.col("text"), F.col("nm")), F.lit("none")).alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH d AS (SELECT doc_id, n_chars, lang, text FROM documents), l AS (SELECT doc_id, n_chars, 'all' AS class FROM d UNION ALL SELECT doc_id, n_chars, 'lang:' || lang FROM d UNION ALL SELECT doc_id, n_chars, CASE WHEN n_chars < 500 THEN 'size:<500' WHEN n_chars < 2000 THEN 'size:500-1999' ELSE 'size:2000+' END FROM d UNION ALL SELECT doc_id, n_chars, 'quoted' FROM d WHERE contains(text, '"'))
SELECT class, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM l GROUP BY class""")
def class_breakdown(spark, sf_dir):
    labels = F.array(F.lit("all"), F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("size:"), T.size_class(F.col("n_chars"), (500, 2000))), F.when(F.contains("text", F.lit('"')), "quoted"))
    rows = table(spark, sf_dir, "documents").select("n_chars", F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("class"))
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(r"""WITH d AS (SELECT doc_id, text || chr(10) || '; context' || chr(10) || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '; decompiled' || chr(10) || lang ELSE '' END AS t, source, lang FROM documents)
SELECT doc_id, length(t) AS n_prompt, source AS context, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS decompiled FROM d""")
def prompt_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", T.prompt(F.col("text"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("t")).withColumn("p", T.prompt_parts(F.col("t")))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_prompt"), "p.context", "p.decompiled")


@query(r"""SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 3 THEN array_to_string(string_split(text, chr(10))[1:3], chr(10)) || chr(10) || '; ... cut' ELSE text END AS capped FROM documents""")
def line_cap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_cap(F.col("text"), 3).alias("capped"))


@query(r"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM x)
SELECT d.doc_id, coalesce(string_agg(s.line, chr(10) ORDER BY i), '') AS head FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id AND s.total <= 600 GROUP BY d.doc_id""")
def budget_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.budget_prefix(F.col("text"), 600).alias("head"))


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS part, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p FROM lineitem),
r AS (SELECT id, part, unnest([CAST(q AS VARCHAR), '0X' || to_hex(p) || 'uL', '-' || CAST(p AS VARCHAR), CAST(q AS VARCHAR) || 'll']) AS literal, unnest([1, 2, 4, 6]) AS line FROM l)
SELECT literal, line, count(*) AS n, count(DISTINCT id) AS n_ids FROM r GROUP BY ALL""")
def numeric_literals(spark, sf_dir):
    """Numbers that count, among those in strings, comments, brackets, names and after semicolons that do not."""
    q, p = F.col("l_quantity").cast("long").cast("string"), F.col("l_partkey")
    text = F.concat(F.lit("mov [rax+16], "), q, F.lit(" ; 99\n/* 5 */ cmp 0X"), F.hex(p), F.lit('uL, x12\n"7 \\" 8" // 3\nadd r8, -'), p.cast("string"), F.lit(", 1.5\n/* 1\n2 */ push '4' "), q, F.lit("ll"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.inline_outer(T.numeric_literals(text))).filter("literal is not null")
    return rows.groupBy("literal", "line").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


_SHA256 = [f"{v:#x}" for v in constants.signatures()[4][3]]
_KEYS = "[" + ", ".join(f"'{v}'" for v in _SHA256) + "]"


@query(f"""WITH o AS (SELECT l_orderkey AS id, list(DISTINCT (l_partkey % 8) + 1) AS ks, max(l_linenumber) AS lines FROM lineitem GROUP BY 1), s AS (SELECT id, CAST(len(ks) AS BIGINT) AS n FROM o)
SELECT id, 'asm' AS source, 'sha256_round_k' AS signature, n AS n_constants FROM s WHERE n >= 4 UNION ALL SELECT id, 'code', 'adler32_modulus', 1 FROM o WHERE lines % 2 = 0 UNION ALL SELECT id, 'code', 'sha1_round_k', 2 FROM o WHERE lines % 3 = 0
UNION ALL SELECT id, 'asm', 'aes_sbox_prefix', 8 FROM o WHERE lines % 5 = 0""")
def constant_signatures(spark, sf_dir):
    """Round constants in assembly (some as sign-extended words), a packed word and a modulus in code, S-box bytes in a word."""
    key = F.element_at(F.array(*map(F.lit, _SHA256)), (F.col("l_partkey") % 8 + 1).cast("int"))
    wide = F.when(key.substr(3, 1) >= "8", F.concat(F.lit("0xffffffff"), F.substring(F.concat(F.lit("0"), key), -8, 8))).otherwise(key)
    line = F.concat(F.lit("mov eax, "), F.when(F.col("l_linenumber") % 2 == 0, wide).otherwise(key))
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(line).alias("ls"), F.max("l_linenumber").alias("lines"))
    box = F.when(F.col("lines") % 5 == 0, "\nmov rax, 0xc56f6bf27b777c63").otherwise("")
    code = F.concat(F.when(F.col("lines") % 2 == 0, "x % 65521;").otherwise("\"65521\";"), F.when(F.col("lines") % 3 == 0, " y = 0x5a8279996ed9eba1;").otherwise(""))
    rows = per.select("id", F.concat(F.array_join("ls", "\n"), box).alias("a"), code.alias("c"))
    return constants.constant_hints(rows, "id", {"asm": ("a", True), "code": ("c", False)}).select("id", "source", "signature", "n_constants")


@query(f"""SELECT l_orderkey AS id, '{constants.HEAD}' || chr(10) || 'adler32_modulus | source=code | evidence=0xfff1 | strength=weak_single_constant' || CASE WHEN max(l_linenumber) % 2 = 0 THEN chr(10) || 'sha1_round_k | source=code | evidence=0x5a827999,0xca62c1d6 | strength=multi_constant' ELSE '' END AS block FROM lineitem GROUP BY 1""")
def hint_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.when(F.max("l_linenumber") % 2 == 0, "0x5A827999 0xca62c1d6U 0x5a827999 65521").otherwise("0xfff1").alias("c"))
    return constants.hint_block(constants.constant_hints(rows, "id", {"code": ("c", False)}), "id")


_ANSWERS = (
    ('{"name":"a#"} {"name":"b"}', "a#", True), ('{"name":"read#","x":{"y":1}}', "read#", True), ('{"name": 7} see it#', "name", False), ('{"name": 7} {"name":"late#"}', "late#", True),
    ('say {"x": {"name": "in#"}} end', "in#", True), ('cut {"name": "q#", "text": "a', "q#", False), ("plain# words", "plain#", False), ("{bad} {\"name\":\"ok#\"", "ok#", False),
    ('```json\n{"name": "f#"}\n```', "f#", True), ("12 - !", "", False), ('{"name":["x"]} then', "name", False),
)


@query("""SELECT event_id, replace(""" + _case([n for _, n, _ in _ANSWERS], "event_id") + """, '#', CAST(event_id AS VARCHAR)) AS name, """ + _case([str(v).lower() for _, _, v in _ANSWERS], "event_id") + """ = 'true' AS valid_json FROM events""")
def json_answer_parse(spark, sf_dir):
    """Several objects, nested ones, numbers for names, cut and plain answers; # is the row's number."""
    text = F.replace(_pick([t for t, _, _ in _ANSWERS], F.col("event_id")), F.lit("#"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.parse_answer(text).alias("a")).select("event_id", "a.name", "a.valid_json")


@query("SELECT doc_id, CAST(floor((length(text) + 3) / 4) AS BIGINT) AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("n_tokens"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)?')) AS BIGINT) AS n_words FROM documents""")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query(r"""SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT ends_with(x, ':'))) AS BIGINT) AS n FROM documents""")
def instruction_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.instruction_count(F.col("text")).alias("n"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '([^/?#]+)([?#].*)?$', 1) AS base, len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x = 'en' OR starts_with(x, '.'))) > 0 AS excluded FROM pages""")
def path_exclusion(spark, sf_dir):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    bad = F.exists(F.split(path, "/"), lambda x: F.regexp_like(x, F.lit(r"^(en$|\.)")))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"([^/?#]+)([?#].*)?$", 1).alias("base"), bad.alias("excluded"))


@query(r"""WITH p AS (SELECT doc_id, text AS asm, source || chr(10) || lang AS ctx FROM documents) SELECT doc_id, floor((length(asm) + 3) / 4) > 500 OR floor((length(asm) + 3) / 4) + floor((length(ctx) + 3) / 4) > 500 AS cut FROM p""")
def budget_cut(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    out = prepare.cut_prompt(F.col("text"), F.concat_ws("\n", "source", "lang"), 500)
    return d.select("doc_id", out.alias("o")).select("doc_id", "o.cut")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def checked_join(spark, sf_dir):
    return joins.checked_join(table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "quality")
