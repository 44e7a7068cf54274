"""Whole jobs on literal cases."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import evaluate, joins, leaks, pipelines

SAME = "push\trbp\nmov\trbp, rsp\nmov\teax, 0x2a\npop\trbp\nret"
SAME_C = "int sub_00aa(void)\n{\n  return 0x2a;\n}"


@pytest.fixture(scope="module")
def audited(spark):
    def row(split, no, project, name, asm, code=None, target=None):
        return (split, f"{project}/{no}", project, f"{no}.c", name, target or name, asm, None, code)

    test = [
        row("test", "0101", "snkv", "sqlite3BitvecClear", "xor\teax, eax\ninc\teax\nret", "int sub_0f00(void) { return 1; }"),
        row("test", "0102", "snkv", "kv_open_store", "mov\teax, 3\nret"),
        row("test", "0103", "toml", "toml_parse_file", 'lea\trdi, [rip + dat_0001]    ; -> "toml_parse_file failed"\nret'),
        row("test", "0104", "toml", "toml_answer", SAME, SAME_C.replace("sub_00aa", "sub_0bbb")),
    ]
    rows = [
        row("train", "0001", "sqlite", "sqlite3BitvecClear", "mov\teax, 1\nret", "int sub_0001(void) { return 1; }"),
        row("train", "0002", "sqlite", "sqlite3PagerClose", "mov\teax, 2\nret"),
        row("train", "0003", "janet", "janet_asin", "call\tasin    ; -> asin\nret", target="asin"),
        row("train", "0004", "lib", "answer_value", SAME, SAME_C), *test, *[("fixed", *r[1:]) for r in test[:2]],
    ]
    df = spark.createDataFrame(rows, "split string, id string, project string, file string, name string, target string, asm string, context string, decompiled string")
    return {(r["section"], r["split"], r["item"]): r["value"] for r in pipelines.data_audit(df).collect()}


def test_data_audit(audited):
    assert audited["rows", "train", "rows"] == audited["rows", "test", "rows"] == 4
    assert not [k for k in audited if k[0].startswith("shared") and "train" in k[2]] and audited["shared_id", "fixed", "fixed~test"] == 2
    assert audited["leaks", "train", "asm.identifier"] == 1
    assert [k for k in audited if k[:2] == ("leaks", "test")] == [("leaks", "test", "asm.string")]
    assert audited["copies", "test", "asm"] == 1 and audited["copies", "test", "decompiled"] == 2
    assert audited["embedded", "test", "snkv<sqlite"] == 1 and audited["embedded", "fixed", "snkv<sqlite"] == 1
    assert audited["known_names", "test", "share"] == 0.25


def test_prepared_rows_fit_their_budget(spark):
    schema = "split string, id string, project string, file string, opt string, name string, asm string, context string"
    functions = spark.createDataFrame([("train", "1", "p", "a.c", "-O0", "p_read", "mov", ""), ("train", "2", "p", "a.c", "-O0", "test_x", "mov", ""), ("train", "3", "p", "a.c", "-O2", "p_long", "x" * 900, "c"), ("test", "4", "p", "a.c", "-O2", "p_long", "x" * 900, "c")], schema)
    texts = spark.createDataFrame([("p/a.c:p_read", "liest", "reads")], "key string, text string, text_en string")
    prefixes = spark.createDataFrame([("p", ["p"])], "project string, words array<string>")
    code = spark.createDataFrame([("1", "p_long(1);\n" + "y = 2;\n" * 200)], "id string, code string")
    rows, counts = pipelines.prepare_rows(functions, texts, prefixes, "name it", 120, code)
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {"1", "4"} and got["4"]["tokens"]["total"] > 120 and got["1"]["tokens"]["total"] <= 120
    assert got["1"]["messages"][2]["content"] == '{"description_en":"reads","name":"read","description":"liest"}' and got["1"]["kind"] == "full"
    asked = got["1"]["messages"][1]["content"]
    assert asked.startswith("mov" + T.DECOMPILED + "FUN_x1(1);") and asked.endswith(pipelines.CUT_CODE) and got["1"]["code_cut"] and got["1"]["n_renamed"] == 1
    assert got["4"]["messages"][2]["content"] == '{"name":"p_long"}' and got["4"]["code_reason"] == "missing"
    assert {r["split"]: tuple(r)[1:] for r in counts.collect()} == {"train": (3, 1, 1, 1, 1, 1), "test": (1, 0, 1, 1, 0, 1)}


def test_gate_looks_at_sections_apart(spark):
    schema = "k long, name string, target string, a string, c string, d string"
    rows = [(1, "janet_asin", "asin", "call\tasin ; -> asin", "", ""), (2, "push", "push", "push rbp", "", ""), (3, "Abort", "Abort", "call\tabort ; -> abort", "calls abort", ""), (4, "Abort", "Abort", "", "", "void abort(void)"), (5, "f_get", "get", "mov eax", "sub_1 (2 instructions): calls get_all", 'x = "f_get";')]
    got = [tuple(r) for r in leaks.leak_gate(spark.createDataFrame(rows, schema), "k", "name", "target", "a", "c", "d").collect()]
    assert got == [(4, "decompiled", "Abort")]


def test_paired_runs_need_the_same_ids(spark):
    data = spark.createDataFrame([(1, "get_x", "-O0", "p", "none", ["p"]), (2, "a", "-O0", "q", "none", [])], "id long, gold string, opt string, project string, state string, prefixes array<string>")
    runs = spark.createDataFrame([(1, "get_x"), (2, "")], "id long, pred string")
    assert [r["f1"] for r in evaluate.paired_runs(data, runs, runs).orderBy("id").collect()] == [1.0, 0.0]
    with pytest.raises(Exception, match="differ"):
        evaluate.paired_runs(data, runs, runs.limit(1)).collect()
    with pytest.raises(Exception, match="null"):
        evaluate.paired_runs(data, runs, runs.withColumn("pred", F.lit(None).cast("string"))).collect()


def test_reproduction(spark):
    expected = spark.createDataFrame([("a", "p", "train", 1, "x"), ("b", "p", "train", 2, "x"), ("c", "q", "test", 3, "x")], "id string, project string, role string, ordinal long, digest string")
    made = spark.createDataFrame([("a", "x"), ("b", "y"), ("z", "x")], "id string, digest string")
    projects, safe, changed = pipelines.reproduction_audit(expected, made, made)
    assert {r["project"]: (r["n"], r["n_found"], r["n_same"], r["n_missing"], r["n_changed"], r["n_unmapped"], r["n_safe"]) for r in projects.collect()} == {"p": (2, 2, 1, 0, 1, 0, 1), "q": (1, 0, 0, 1, 0, 1, 0)}
    assert [r["id"] for r in safe.collect()] == ["a"] and [r["id"] for r in changed.collect()] == ["b"]
    with pytest.raises(Exception, match="no row"):
        pipelines.safe_queue(safe, spark.createDataFrame([("b", 1)], "id string, ordinal long")).collect()
    with pytest.raises(Exception, match="twice"):
        pipelines.reproduction_audit(expected, made.union(made), made)[0].collect()


def test_contracts_of_judging_and_refreshing(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, key long")
    with pytest.raises(Exception, match="no row"):
        joins.for_judging(a.select("id").limit(1), a.select("key"), a, "id", "key", strict=True).collect()
    with pytest.raises(Exception, match="differ"):
        joins.refresh(a, a.limit(1), "id", ["key"]).collect()
