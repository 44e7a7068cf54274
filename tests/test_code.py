"""Literal cases of code texts and audits."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.operators import audit, leaks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_masks_and_names_in_code(spark):
    text = 'f("a\\"b", \'x\'); // "c\ng(/* d */ 1);'
    assert one(spark, C.mask(F.lit(text))) == "f(" + " " * 6 + ", " + " " * 3 + "); " + " " * 5 + "\ng(" + " " * 7 + " 1);"
    assert one(spark, C.name_in_code(F.lit('x("read_file"); _Read_File(1)'), F.lit("read_file"))) == "_Read_File"
    assert one(spark, C.name_in_code(F.lit('x("read_file")'), F.lit("read_file"))) is None
    assert one(spark, F.length(C.mask(F.lit('"' + "a" * 200000 + '" x')))) == 200004


def test_context(spark):
    text = F.lit('asm sub_0002\n; context\nsub_0002 "sub_0002" sub_00020')
    assert one(spark, C.rewrite_context(text, F.create_map(F.lit("sub_0002"), F.lit("read")))) == 'asm sub_0002\n; context\nread "sub_0002" sub_00020'
    assert one(spark, C.name_candidates(F.lit('sub_0001 (10 instructions): calls malloc, sub_2; string "read_file"'))) == ["malloc"]
    got = one(spark, C.lexical(F.lit("read_file"), F.array(F.lit("read_buffer"), F.lit("write_file"))))
    assert (got["token_recall"], got["best_copy_f1"], got["all_shared"]) == (1.0, 0.5, True)
    assert one(spark, C.ordinal_labels(F.lit("L7 L3 L7"), "L[0-9]+", "loc_")) == "loc_1 loc_2 loc_1"
    line = C.call_summary(F.lit("sub_1"), F.lit(3), F.lit('call x ; -> malloc\nlea y ; -> "text"\ncall sub_2'))
    assert one(spark, line) == 'sub_1 (3 instructions): calls malloc, sub_2; string "text"'


def test_answers(spark):
    got = one(spark, C.judge_scores(F.lit('```json\n{"scores": {"a": "2", "b": 1}, "agreement": true}\n```'), ("a", "b")))
    assert (got["valid"], got["agreement"], got["a"], got["b"]) == (True, "yes", 2, 1)
    assert not one(spark, C.judge_scores(F.lit('{"scores": {"a": 3}}'), ("a",)))["valid"]
    assert [one(spark, C.strict_name(F.lit(t))) for t in ('```json\n{"name": "read_file"}\n```', '{"name": "bad name"}', '{"name": "sub_0001"}', "null")] == ["read_file", None, None, None]
    flags = C.quality_flags(F.lit("get"), F.lit("It gets"), F.lit(""), F.lit("a\nb"), F.lit(""), F.lit('"get x"'), F.lit(2))
    assert one(spark, flags) == ["name_in_string", "no_description", "too_short", "name_in_text", "short_description"]
    assert one(spark, C.around(F.lit("0123456789abc"), F.lit("8"), 2)) == "6789"


def test_anonymise_and_definitions(spark):
    text, n, other, rows = C.anonymised('foo(1); p = &bar; s.foo(2); q = foo; "foo(" FUN_x1', {"foo", "bar"}, set())
    assert (text, n, other, rows) == ('FUN_x2(1); p = &FUN_x3; s.foo(2); q = foo; "foo(" FUN_x1', 2, 2, 1)
    assert one(spark, C.anonymise(F.lit("foo()"), F.array(F.lit("foo")), F.array().cast("array<string>"))["text"]) == "FUN_x1()"
    c = '#define f(x) { x }\nint proto(int);\nstatic int f(int a) { if (a) { return g("}"); } return 0; }\nint k(a, b) int a; char *b; { return a; }\nint v = f(1);\n'
    assert [n for n, _ in C.found_definitions(c)] == ["f", "k"]
    assert C.found_definitions(c, {"f"})[0][1].startswith("static int f(int a) {")
    assert C.uleb_values(bytes([0xE5, 0x8E, 0x26, 0])) == [624485, 0]
    with pytest.raises(ValueError, match="finished"):
        C.uleb_values(b"\x80")
    assert one(spark, C.shown(F.lit("a\n"))) == '"a\\n"'


def test_audits(spark):
    rows = spark.createDataFrame([("x", "yes", 1.0), ("x", "no", 0.0), ("y", "yes", 0.5)], "g string, a string, s double")
    assert {(r["class"], r["n"]) for r in audit.class_rates(rows, {"a": ("yes", "no", "unknown")}).collect()} == {("yes", 2), ("no", 1), ("unknown", 0)}
    got = audit.ceiling(rows, F.col("s"), F.col("a") == "no").first()
    assert (got["n"], got["n_flagged"], got["gain"], got["ceiling"]) == (3, 1, pytest.approx(1 / 3), pytest.approx(0.5 + 1 / 3))
    spans = spark.createDataFrame([("s", 1, 0, 10), ("s", 2, 20, 30)], "f string, id long, lo long, hi long")
    holes = spark.createDataFrame([("s", 2, 4), ("s", 3, 5), ("s", 25, 40)], "f string, lo long, hi long")
    assert sorted((r["id"], r["lo"], r["hi"]) for r in audit.subtract_intervals(spans, holes, "f").collect()) == [(1, 0, 2), (1, 5, 10), (2, 20, 25)]
    a, b = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "id long, d string"), spark.createDataFrame([(1, "p"), (2, "z"), (4, "r")], "id long, d string")
    assert {r["state"]: r["n"] for r in audit.reproduction(a, b, "id", "d").collect()} == {"same": 1, "changed": 1, "missing": 1, "extra": 1}
    picks = audit.flagged_sample(spark.range(100).select("id"), ["id"], F.col("id") % 2 == 0, 10, 5).collect()
    assert sorted(r["id"] for r in picks) == [*range(10), 10, 12, 14, 16, 18]
    assert [r["id"] for r in audit.evenly_spaced(spark.range(9).withColumn("g", F.lit(1)), ["g"], ["id"], 2).orderBy("id").collect()] == [0, 4]
    fns = spark.createDataFrame([("p", "a", ["b", "c"], 9, "asm a", "sum a"), ("p", "b", [], 3, "asm b", "sum b"), ("p", "c", ["b"], 99, "asm c", "sum c")], "p string, n string, calls array<string>, k int, asm string, s string")
    assert audit.deep_context(fns, ["p"], "n", "calls", "k", "asm", "s").filter("n = 'a'").first()["context"] == "; b (3 instructions):\nasm b\nsum c\n  sum b"


def test_listings():
    from millrace.functions import listing as L

    regions = L.Regions({0x100: "sub_0001", 0x200: "sub_0002", 0x300: "memcpy"}, {0x400: "out of memory"}, [(0x100, 0x140), (0x200, 0x240)])
    assert [regions.target(a) for a in (0x300, 0x404, 0x210, 0x404 + 20)] == ["memcpy", '"of memory"', "sub_0002", "data"]
    code = [(0x100, 4, "jne 0x108"), (0x104, 4, "mov eax, [rip - 0x8]"), (0x108, 4, "call 0x100"), (0x10C, 4, "jmp 0x100")]
    assert L.linked_listing(code, regions) == "loc_2:\njne loc_1\nmov eax, [rip]    ; -> sub_0001\nloc_1:\ncall sub_0001    ; -> sub_0001\njmp loc_2"
    assert L.linked_listing([], regions) == "" and L.object_listing([""], {}, {}, "f") == ""
    assert L.object_listing(["0: jmp 0x4 <_f+0x4>", "2: <bad op>", "4: ret"], {}, {}, "f") == "jmp loc_1\nloc_1:\nret"
    assert L.object_listing(["0: call 0x5 <_g>", "1: X86_64_RELOC_BRANCH _g.part.1"], {"g": "sub_7"}, {}, "f") == "call sub_7    ; -> data"
    assert L.display("é" * 30) == '"' + "\\xe9" * 20 + '…"'


def test_prompts_are_cut_by_any_counter(spark):
    from millrace.operators import prepare

    lines = "\n".join(["aa bb"] * 10)
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    got = spark.range(1).select(prepare.cut_prompt(F.lit(lines), F.lit(lines), 25, words).alias("a"), prepare.cut_prompt(F.lit(lines), F.lit(lines), 8, words).alias("b")).first()
    assert (got["a"]["asm"], got["a"]["context"].count("aa"), got["a"]["cut"]) == (lines, 2, True)
    assert (got["b"]["asm"].count("aa"), got["b"]["context"]) == (4, "")

def test_anonymise_gets_only_names_that_its_text_holds(spark):
    names = {"foo", "_bar", "baz", "FUN_x1", "FUN_x2", "FUN_x4", "FUN_x007", ""}
    texts = {"1": 'foo(1); _bar(2); __bar(3); baz(4); "qux"', "2": "other(1); _ (2); FUN_x3 = 3;", "3": None, "4": "foo(FUN_x3(2)); bar(1)"}
    rows = spark.createDataFrame([("p", k, t) for k, t in texts.items()] + [("q", "5", "foo(1)")], "project string, id string, t string")
    known = spark.createDataFrame([("p", n) for n in sorted(names)] + [("p", f"name{i}") for i in range(500)] + [("p", None)], "project string, name string")
    got = leaks.with_names(rows, known, "project", "id", "t").withColumn("x", C.anonymise(F.col("t"), F.col("_n"), F.array().cast("array<string>"), F.col("_used"))).collect()
    every = names | {f"name{i}" for i in range(500)}
    for r in got:
        want = C.anonymised(r["t"], every if r["project"] == "p" else set(), set()) if r["t"] else (None,) * 4
        assert tuple(r["x"]) == want, r["id"]
        assert len(r["_n"]) <= 4
    assert {r["id"]: r["x"]["text"] for r in got}["1"] == 'FUN_x3(1); FUN_x5(2); FUN_x5(3); FUN_x6(4); "qux"'
