"""Queries of functions on code: texts are built from the driver's columns, the SQL builds what must come out of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.functions import listing as L
from millrace.functions import text as T
from millrace.operators import graph, prepare
from millrace.plans.registry import query, table

_NL = "chr(10)"


def _lines(spark, sf_dir):
    """Line items: id, part, k (the part's key), a word of the part and numbers as text."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.split("p_name", " ")[0].alias("w"), F.col("p_size").alias("n"), F.col("p_partkey").cast("string").alias("t"))


_P = "p AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS w, p_size AS n, CAST(p_partkey AS VARCHAR) AS t FROM part)"


def _join(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query(f"WITH {_P} SELECT k, CASE WHEN n % 2 = 0 THEN 'sub_a1,sub_' || to_hex(k % 16) ELSE 'sub_' || lower(to_hex(k % 16)) END AS calls FROM p".replace("to_hex(k % 16) ELSE", "lower(to_hex(k % 16)) ELSE"))
def inner_calls(spark, sf_dir):
    """Operands and what a note at the line's end names, each target once; a note in a string is none."""
    hexed = F.lower(F.hex(F.col("k") % 16))
    text = F.when(F.col("n") % 2 == 0, _join("call sub_a1\n jmp sub_a1\ncallq [rip] ; -> sub_", hexed, "\nxcall sub_ff")).otherwise(_join("jmpq sub_", hexed, "\nmov sub_99\ncall rax ; -> \"sub_b2\""))
    return _lines(spark, sf_dir).select("k", F.array_join(T.inner_calls(text), ",").alias("calls"))


@query(f"WITH {_P} SELECT w, n % 3 AS kind, count(*) AS n_rows, CAST(sum(CASE WHEN n % 3 = 2 THEN 0 ELSE 1 END) AS BIGINT) AS n_calls FROM p GROUP BY 1, 2")
def direct_calls(spark, sf_dir):
    """Only call and jmp without suffix at the start of a line count."""
    text = F.when(F.col("n") % 3 == 0, "  call sub_0F\n").when(F.col("n") % 3 == 1, "nop\njmp\tsub_2 ; x").otherwise("callq sub_3\nx call sub_4\ncall rax ; -> sub_5")
    rows = _lines(spark, sf_dir).select("w", (F.col("n") % 3).alias("kind"), F.size(T.direct_calls(text)).cast("long").alias("c"))
    return rows.groupBy("w", "kind").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c").alias("n_calls"))


@query(f"""WITH {_P} SELECT k, 'sub_' || t || ' (' || CAST(n AS VARCHAR) || ' instructions): calls ' || w || CASE WHEN n % 2 = 0 THEN ', sub_ab' ELSE '' END || CASE WHEN n % 3 = 0 THEN '; string "' || w || '"' ELSE '' END AS line FROM p""")
def call_summary(spark, sf_dir):
    asm = _join("call x ; -> ", F.col("w"), "\n", F.when(F.col("n") % 2 == 0, "call sub_ab\n").otherwise(""), F.when(F.col("n") % 3 == 0, _join('lea rdi ; -> "', F.col("w"), '"\n')).otherwise(""), "mov rax ; -> data")
    return _lines(spark, sf_dir).select("k", C.call_summary(_join("sub_", F.col("t")), F.col("n"), asm).alias("line"))


@query(f"""WITH {_P} SELECT k, 'int ' || w || ' = ' || repeat(' ', length(w) + 4) || ';' || repeat(' ', length(t) + 3) || {_NL} || 'c = ' || repeat(' ', 3) || '; ' || repeat(' ', 2) || {_NL} || repeat(' ', length(t) + 3) || 'x' AS masked FROM p""")
def literal_mask(spark, sf_dir):
    text = _join("int ", F.col("w"), ' = "', F.col("w"), '\\"";//', F.col("t"), " \nc = '/'; /*\n", F.col("t"), " */x")
    return _lines(spark, sf_dir).select("k", C.mask(text).alias("masked"))


@query(f"WITH {_P} SELECT k, CASE n % 4 WHEN 0 THEN w || t WHEN 1 THEN '_' || upper(w) || t END AS found FROM p")
def names_in_code(spark, sf_dir):
    name = F.concat("w", "t")
    text = F.when(F.col("n") % 4 == 0, _join("x = ", name, "(1)")).when(F.col("n") % 4 == 1, _join("_", F.upper("w"), F.col("t"), ";")).when(F.col("n") % 4 == 2, _join('puts("', name, '")')).otherwise(_join(name, "_x + x", name))
    return _lines(spark, sf_dir).select("k", C.name_in_code(text, name).alias("found"))


@query(f"""WITH {_P} SELECT k, 'call sub_1' || {_NL} || '; context' || {_NL} || 'sub_1x "sub_1" ' || w || ' sub_22' || CASE WHEN n % 2 = 0 THEN {_NL} || '; decompiled' || {_NL} || 'sub_1()' ELSE '' END AS prompt FROM p""")
def context_rewrite(spark, sf_dir):
    text = T.prompt(F.lit("call sub_1"), F.lit('sub_1x "sub_1" sub_1 sub_22'), F.when(F.col("n") % 2 == 0, "sub_1()"))
    return _lines(spark, sf_dir).select("k", C.rewrite_context(text, F.create_map(F.lit("sub_1"), F.col("w"))).alias("prompt"))


@query(f"WITH {_P} SELECT k, 'jmp loc_1' || {_NL} || 'L' || t || ': loc_2 loc_1 ' || w || ' loc_3' AS text FROM p")
def ordinal_labels(spark, sf_dir):
    text = _join("jmp L_", F.col("t"), "a\nL", F.col("t"), ": L_b L_", F.col("t"), "a ", F.col("w"), " L_c")
    return _lines(spark, sf_dir).select("k", C.ordinal_labels(text, "L_[0-9a-z]+", "loc_").alias("text"))


@query(f"""WITH {_P}, f AS (SELECT k, unnest(list_filter([CASE WHEN n % 2 = 0 THEN 'name_in_string' END, CASE WHEN n % 3 = 0 THEN 'no_description' END, CASE WHEN n < 8 THEN 'too_short' END, CASE WHEN n % 5 = 0 THEN 'too_long' END, CASE WHEN n % 3 > 0 AND n % 7 = 0 THEN 'name_in_text' END, CASE WHEN n % 11 = 0 THEN 'short_description' END], lambda x: x IS NOT NULL)) AS flag FROM p) SELECT flag, count(*) AS n, min(k) AS first_id FROM f GROUP BY flag""")
def quality_flags(spark, sf_dir):
    n, name = F.col("n"), _join("fn_", F.col("t"))
    long = _join("it does a lot of work", F.when((n % 7 == 0) & (n % 3 > 0), _join(" for ", name)).otherwise(""))
    text = F.when(n % 11 == 0, "short one").otherwise("also a text of many words")
    asm = F.lit("mov\npush")
    flags = C.quality_flags(name, F.when(n % 3 > 0, long), text, F.when(n % 5 == 0, "mov\n; ... cut").otherwise(asm), F.lit("ctx"), F.when(n % 2 == 0, _join('lea ; "', name, '"\npush')).otherwise(asm), n)
    rows = _lines(spark, sf_dir).select("k", F.explode(flags).alias("flag"))
    return rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_id"))


@query(f"""WITH {_P} SELECT n % 5 AS kind, n % 5 IN (0, 1) AS valid, CASE WHEN n % 5 IN (0, 3) THEN 'yes' WHEN n % 5 = 1 THEN 'no' END AS agreement, CASE n % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE n % 3 END AS a, CASE WHEN n % 5 = 4 THEN NULL ELSE 2 END AS b, count(*) AS n_rows FROM p GROUP BY ALL""")
def judge_answers(spark, sf_dir):
    a, kind = (F.col("n") % 3).cast("string"), F.col("n") % 5
    made = F.when(kind == 0, _join('```json\n{"scores": {"a": ', a, ', "b": "2"}, "agreement": true}\n```')).when(kind == 1, _join('so {"a": "', a, '", "b": 2, "agreement": "No"} end'))
    made = made.when(kind == 2, _join('{"a": ', a, ', "b": 2, "agreement": "maybe"}')).when(kind == 3, '{"a": 3, "b": 2, "agreement": "yes"}').otherwise("no json")
    rows = _lines(spark, sf_dir).select(kind.alias("kind"), C.judge_scores(made, ("a", "b")).alias("j")).select("kind", "j.*")
    return rows.groupBy("kind", "valid", "agreement", "a", "b").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {_P} SELECT k, CASE WHEN n % 5 = 0 THEN w || t WHEN n % 5 = 1 THEN w END AS name FROM p")
def strict_names(spark, sf_dir):
    kind = F.col("n") % 5
    text = F.when(kind == 0, _join('```json\n{"name": "', F.col("w"), F.col("t"), '"}\n```')).when(kind == 1, _join(' {"name":"', F.col("w"), '"} ')).when(kind == 2, '{"name": "bad name"}').when(kind == 3, '{"name": "sub_0001"}').otherwise(_join("it is ", F.col("w")))
    return _lines(spark, sf_dir).select("k", C.strict_name(text).alias("name"))


@query(f"""WITH {_P} SELECT k, CASE WHEN n % 2 = 0 THEN repeat('x', 30) || w || repeat('y', 30 - length(w)) ELSE w END AS part FROM (SELECT k, w, n FROM p) q""")
def text_around_name(spark, sf_dir):
    text = F.when(F.col("n") % 2 == 0, F.concat(F.repeat(F.lit("x"), F.lit(100)), "w", F.repeat(F.lit("y"), F.lit(100)))).otherwise(F.col("w"))
    return _lines(spark, sf_dir).select("k", C.around(text, F.col("w"), 30).alias("part"))


@query(f"""WITH {_P} SELECT k, 'FUN_x1(); x = &FUN_x2; ' || w || '_a->f(); "' || w || '_a"; FUN_x1(1); free(2); ' || w || '_a' AS text, 3 AS n_replaced, 2 AS n_elsewhere, 1 AS n_lines FROM p""")
def anonymised_code(spark, sf_dir):
    a, b = _join(F.col("w"), "_a"), _join(F.col("w"), "_b")
    text = _join(a, "(); x = &_", b, "; ", a, '->f(); "', a, '"; ', a, "(1); free(2); ", a)
    rows = _lines(spark, sf_dir).select("k", C.anonymise(text, F.array(a, b, F.lit("free")), F.array(F.lit("free"))).alias("x"))
    return rows.select("k", "x.text", F.col("x.n_replaced").cast("int").alias("n_replaced"), F.col("x.n_elsewhere").cast("int").alias("n_elsewhere"), F.col("x.n_lines").cast("int").alias("n_lines"))


@query(f"""WITH {_P} SELECT k, 'f' || t AS name, 'int f' || t || '(int a)' || {_NL} || '{{ return "}}"[' || CAST(n AS VARCHAR) || ']; }}' AS source FROM p UNION ALL SELECT k, w, 'static void ' || w || '(a) int a; {{ if (a) {{ g(); }} }}' FROM p WHERE n % 2 = 0""")
def found_definitions(spark, sf_dir):
    """A prototype, a call and an initialiser define nothing; the parameters of the second may be declared after them."""
    first = _join("int f", F.col("t"), "(int a)\n{ return \"}\"[", F.col("n").cast("string"), "]; }")
    text = _join("#define X f(){}\nint g(void);\nint a[] = { 1 };\n", first, "\n// h() {}\n", F.when(F.col("n") % 2 == 0, _join("static void ", F.col("w"), "(a) int a; { if (a) { g(); } }")).otherwise(""))
    return _lines(spark, sf_dir).select("k", F.inline(C.definitions(text)))


@query("SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS big, CAST(o_orderkey % 128 AS VARCHAR) AS small FROM orders")
def uleb_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    seven = [F.shiftright(k, 7 * i).bitwiseAND(127) for i in range(5)]
    coded = F.concat(*[F.lpad(F.hex(s.bitwiseOR(128) if i < 4 else s), 2, "0") for i, s in enumerate(seven)], F.lpad(F.hex(k % 128), 2, "0"))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), C.uleb128(F.unhex(coded)).alias("v"))
    return rows.select("id", F.col("v")[0].cast("string").alias("big"), F.col("v")[1].cast("string").alias("small"))


@query(f"""WITH {_P} SELECT k, '"' || CASE WHEN n % 3 = 0 THEN w || '\\n\\xe9' WHEN n % 3 = 1 THEN '\\"' || w || '\\"' ELSE repeat('z', 80) END || CASE WHEN n % 3 = 2 THEN '…' ELSE '' END || '"' AS shown FROM p""".replace("END || CASE WHEN n % 3 = 2 THEN '…' ELSE '' END || '\"'", "END || CASE WHEN n % 3 = 2 THEN '…\"' ELSE '\"' END"))
def shown_strings(spark, sf_dir):
    text = F.when(F.col("n") % 3 == 0, _join(F.col("w"), "\né")).when(F.col("n") % 3 == 1, _join('"', F.col("w"), '"')).otherwise(F.repeat(F.lit("z"), F.lit(90)))
    return _lines(spark, sf_dir).select("k", C.shown(text).alias("shown"))


@query(f"""WITH {_P} SELECT k, '"' || w || '"' AS quoted, CAST(2 + n % 2 AS BIGINT) AS n FROM p""")
def quoted_strings(spark, sf_dir):
    text = _join('a("', F.col("w"), '", "x\\"y"', F.when(F.col("n") % 2 == 1, ', ""').otherwise(""), ") // '")
    found = F.regexp_extract_all(text, F.lit(T.QUOTED), F.lit(0))
    return _lines(spark, sf_dir).select("k", found[0].alias("quoted"), F.size(found).cast("long").alias("n"))


@query(f"WITH {_P} SELECT k, CASE n % 4 WHEN 0 THEN 'get_' || w || '_cogus' WHEN 1 THEN 'a_' || t ELSE NULL END AS name FROM p")
def clean_identifiers(spark, sf_dir):
    text = F.when(F.col("n") % 4 == 0, _join(" Get--", F.col("w"), "  ÇoĞüş! ")).when(F.col("n") % 4 == 1, _join("_a__", F.col("t"), "_")).when(F.col("n") % 4 == 2, "FUN_00ab").otherwise("9 lives")
    return _lines(spark, sf_dir).select("k", T.clean_identifier(text).alias("name"))


@query(f"""WITH {_P} SELECT k, CASE n % 3 WHEN 0 THEN 'Reads ' || w || ' from it.' WHEN 1 THEN 'Counts ' || array_to_string(list_transform(range(24), lambda i: 'w' || CAST(i AS VARCHAR)), ' ') || '.' END AS text FROM p""")
def clean_descriptions(spark, sf_dir):
    many = " ".join(f"w{i}" for i in range(40))
    text = F.when(F.col("n") % 3 == 0, _join("```text\nThis function reads  ", F.col("w"), " from it. And more. \n```")).when(F.col("n") % 3 == 1, f"it counts {many}").otherwise("``` ```")
    return _lines(spark, sf_dir).select("k", T.clean_description(text).alias("text"))


@query(f"""WITH d AS (SELECT doc_id, string_split(text, {_NL}) AS x, text FROM documents) SELECT doc_id, CASE WHEN len(x) > 4 THEN array_to_string(x[1:2], {_NL}) || {_NL} || '/* ... */' || {_NL} || x[-1] ELSE text END AS short FROM d""")
def shortened_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.shorten(F.col("text"), 2, 1, "/* ... */").alias("short"))


@query(f"""WITH {_P} SELECT k, 'user ' || w || CASE WHEN n % 2 = 0 THEN '' ELSE ' {{"name":"x"}}' END AS text, CASE WHEN n % 2 = 0 THEN '{{"name":"' || w || '"}}' ELSE '{{"name":"x"}}' END AS object FROM p""")
def last_objects(spark, sf_dir):
    tail = F.when(F.col("n") % 2 == 0, _join('{"a":1} then {"name":"', F.col("w"), '"}')).otherwise('{"z":{"b":2}} {"name":"x"}')
    return _lines(spark, sf_dir).select("k", _join("user ", F.col("w"), F.when(F.col("n") % 2 == 0, "").otherwise(' {"name":"x"}')).alias("text"), T.last_flat_object(tail).alias("object"))


@query(f"""WITH {_P}, m AS (SELECT k, [w, 'x', t] AS roles FROM p) SELECT k, roles[2] AS user_text, roles[3] AS answer FROM m""")
def message_by_role(spark, sf_dir):
    m = prepare.messages(F.col("w"), F.lit("x"), F.col("t"))
    return _lines(spark, sf_dir).select("k", prepare.message_of(m, "user").alias("user_text"), prepare.message_of(m, "assistant").alias("answer"))


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS node, p_partkey // 3 AS callee FROM part), l AS (SELECT node, 0 AS level, CAST(node AS VARCHAR) AS name FROM n WHERE callee = node OR callee NOT IN (SELECT node FROM n) UNION ALL SELECT n.node, l.level + 1, CAST(n.node AS VARCHAR) || '<' || l.name FROM n JOIN l ON l.node = n.callee AND n.node <> n.callee) SELECT node, CAST(level AS BIGINT) AS level, name FROM l""")
def propagated_names(spark, sf_dir):
    """Each function is named after itself and the name that its callee has got a level before."""
    nodes = table(spark, sf_dir, "part").select(F.lit(0).alias("scope"), F.col("p_partkey").alias("node"), F.array(F.floor(F.col("p_partkey") / 3).cast("long")).alias("calls"))
    edges, _ = graph.call_edges(nodes, ["scope"], "node", "calls")
    levels = graph.levels(nodes, edges, "scope", "node")
    callee = F.map_values("known")
    name = lambda rows: rows.withColumn("name", F.concat(F.col("node").cast("string"), F.coalesce(F.concat(F.lit("<"), F.get(callee, F.lit(0))), F.lit(""))))
    return graph.propagate(levels.select("node", "level"), edges, name, "node").select("node", "level", "name")


@query(f"""WITH {_P} SELECT k, 'mov eax, [rip]    ; -> "' || w || '"' || {_NL} || 'loc_1:' || {_NL} || 'call loc    ; -> sub_0001' || {_NL} || 'call loc    ; -> memcpy' || {_NL} || 'jne loc_1' || {_NL} || 'lea rax, [rip]    ; -> data' AS text FROM p""")
def object_listings(spark, sf_dir):
    """A string by its address, a function of the file, an import, a jump in the function, a section."""
    text = _join("0: mov eax, [rip + 0x10] ## 0x", F.lower(F.hex(F.col("k") + 256)), "\n3: X86_64_RELOC_SIGNED __cstring\n7: call 0x0 <_y>\n8: X86_64_RELOC_BRANCH _f", F.col("t"), "\nc: call 0x0 <_x>\nd: X86_64_RELOC_BRANCH _memcpy\n11: jne 0x7 <_own+0x7>\n13: lea rax, [rip + 0x0]\n15: X86_64_RELOC_SIGNED __const-4")
    names = F.create_map(_join("f", F.col("t")), F.lit("sub_0001"), F.lit("own"), F.lit("sub_0002"))
    return _lines(spark, sf_dir).select("k", L.anonymous_object(text, names, F.create_map(F.col("k") + 256, "w"), F.lit("own")).alias("text"))


@query(f"""WITH {_P} SELECT k, 'loc_1:' || {_NL} || 'lea rdi, [rip]    ; -> "' || substr(w, 2) || '"' || {_NL} || 'call memcpy    ; -> memcpy' || {_NL} || 'call sub_0002    ; -> sub_0002' || {_NL} || 'jmp loc_1' || {_NL} || 'mov eax, [dat_0001]' || {_NL} || 'call sub_0001    ; -> sub_0001' AS text FROM p""")
def linked_listings(spark, sf_dir):
    """The tail of a string, an import, the middle of another function, a jump back, absolute data, a call of itself."""
    base = F.col("k") * 4096 + 4096
    hexed = lambda d: F.lower(F.hex(base + d))
    texts = [("lea rdi, [rip + 0x101] ## x",), ("call 0x", hexed(512), " <_near+0x3>"), ("call 0x", hexed(290)), ("jmp 0x", hexed(0)), ("mov eax, [0x", hexed(768), "]"), ("call 0x", hexed(0))]
    code = F.array(*[F.struct((base + 7 * i).alias("address"), F.lit(7).cast("long").alias("size"), _join(*t).alias("text")) for i, t in enumerate(texts)])
    names = F.create_map(base, F.lit("sub_0001"), base + 280, F.lit("sub_0002"), base + 512, F.lit("memcpy"), base + 768, F.lit("dat_0001"))
    spans = F.array(F.struct(base.alias("start"), (base + 64).alias("end")), F.struct((base + 280).alias("start"), (base + 300).alias("end")))
    rows = _lines(spark, sf_dir).select("k", code.alias("c"), names.alias("n"), F.create_map(base + 263, "w").alias("s"), spans.alias("f"))
    return rows.select("k", L.anonymous_code("c", "n", "s", "f").alias("text"))
