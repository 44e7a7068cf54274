"""Literal cases of names, texts, joins, selection and graphs."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import names as N
from millrace.functions import text as T
from millrace.operators import graph, joins, report, select, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "words"), [("sqlite3VdbeMemSet", ["sqlite3", "vdbe", "mem", "set"]), ("XMLParser", ["xmlparser"]), ("toml.parse-file", ["toml", "parse", "file"]), ("___", [])])
def test_tokens(spark, name, words):
    assert one(spark, N.tokens(F.lit(name))) == words


@pytest.mark.parametrize(("a", "b", "score"), [("crc32_update", "update_crc", 0.5), ("adler32", "adler32_update", 2 / 3), ("get_get_value", "get_value", 1.0), ("", "x", 0.0), ("x", "", 0.0)])
def test_f1(spark, a, b, score):
    assert one(spark, N.f1(N.tokens(F.lit(a)), N.tokens(F.lit(b)))) == pytest.approx(score)


def test_f1_without_prefix_and_sql(spark):
    words = F.array(F.lit("cyaml"))
    assert one(spark, N.f1_without(N.tokens(F.lit("pool_alloc")), N.tokens(F.lit("cyaml_pool_alloc")), words)) == 1.0
    assert one(spark, N.strip_prefix(F.lit("mbedtls_mpi_core_read"), F.array(F.lit("mbedtls"), F.lit("mbedtls_mpi")))) == "core_read"
    N.register(spark)
    assert spark.sql("select name_f1('crc32_update', 'update_crc')").first()[0] == 0.5


@pytest.mark.parametrize(("name", "text", "kind"), [("asin", "call\tasin    ; -> asin", "identifier"), ("toml_parse", '; -> "toml_parse failed"', "string"), ("parse", "call\tparse_header", "substring"), ("get", "call\tget", None)])
def test_leak_kind(spark, name, text, kind):
    assert one(spark, T.leak_kind(F.lit(text), F.lit(name))) == kind


def test_text(spark):
    assert one(spark, T.line_cap(F.lit("a\nb\nc"), 2)) == "a\nb\n; ... cut"
    assert one(spark, T.line_cap(F.lit("a\nb"), 2)) == "a\nb"
    assert one(spark, T.budget_prefix(F.lit("aa\nbb\ncc"), 6)) == "aa\nbb"
    assert [tuple(n) for n in one(spark, T.numeric_literals(F.lit('mov 0x10, 7 ; 99\n"5" x3 12')))] == [("0x10", 1), ("7", 1), ("12", 2)]
    assert one(spark, T.direct_calls(F.lit("  call sub_00a1\nnop\njmp\tsub_2 ; x\nxcall sub_3"))) == ["sub_00a1", "sub_2"]
    got = one(spark, T.parse_answer(F.lit('```json\n{"name": "read_file"}\n```')))
    assert (got["name"], got["valid_json"]) == ("read_file", True)
    parts = one(spark, T.prompt_parts(T.prompt(F.lit("a"), F.lit("b"), F.lit("c"))))
    assert tuple(parts) == ("a", "b", "c")
    assert one(spark, T.shorten(F.lit("\n".join("abcdef")), 2, 1, "..")) == "a\nb\n..\nf"


@pytest.mark.parametrize(("text", "name", "valid"), [('{"name":"a"} {"name":"b"}', "a", True), ('{"name":"read_file","x":{"y":1}}', "read_file", True), ('{"name": 7}', "name", False), ('x {"name": "a\\"b", "z', 'a"b', False), ("", "", False), ('{"name":"a","name":"b"} x', "a", False)])
def test_answers(spark, text, name, valid):
    got = one(spark, T.parse_answer(F.lit(text)))
    assert (got["name"], got["valid_json"]) == (name, valid)


@pytest.mark.parametrize(("text", "want"), [("call  sub_00a1\n  mov eax, dat_0042  FUN_00401a30", "call sub_ mov eax, dat_ ghidra_"), ("code_review joined_up FUN_main", "code_review joined_up FUN_main"), ("thunk_FUN_0011", "ghidra_"), ("\u00a0 a\u2003b\x1c ", "a b")])
def test_normalise(spark, text, want):
    assert one(spark, T.normalise(F.lit(text))) == want
    assert one(spark, T.text_hash(F.lit(" \u3000\n"))) is None


def test_constants(spark):
    from millrace.functions import constants

    table = {n: v for n, _, _, v in constants.signatures()}
    assert table["sha256_round_k"][:2] == [0x428A2F98, 0x71374491] and table["sha256_round_k"][-1] == 0xC67178F2 and table["sha512_or_blake2b_iv"][0] == 0x6A09E667F3BCC908
    assert table["crc32_ieee_table_values"][:2] == [0x77073096, 0xEE0E612C] and table["md5_round_t"][0] == 0xD76AA478 and table["sha512_round_k_prefix"][7] == 0xAB1C5ED5DA6D8118
    assert one(spark, F.transform(F.array(*map(F.lit, ("0x10", "-5", "0xFFFFFFFFFFFFFFFFul", "007", "18446744073709551616", "+3"))), T.literal_bits)) == [f"{v:016x}" if v is not None else None for v in (16, 2**64 - 5, 2**64 - 1, 7, None, 3)]
    rows = [(1, "mov rax, 0x6a09e667f3bcc908", ""), (2, "db 0x63, 0x7c, 0x77, 0x7b, 0xf2, 0x6b, 0x6f, 0xc5", "0x63, 0x7c, 300, 0x77, 0x7b, 0xf2, 0x6b, 0x6f, 0xc5"), (3, None, "0x637c777bf26b6fc5 and -306674912"), (4, "push 0x1edc6f41", '"0x1edc6f41" // 65521')]
    got = constants.constant_hints(spark.createDataFrame(rows, "id long, a string, c string"), "id", {"asm": ("a", True), "code": ("c", False)}).collect()
    assert {(r["id"], r["source"], r["signature"]) for r in got} == {(2, "asm", "aes_sbox_prefix"), (3, "code", "aes_sbox_prefix"), (3, "code", "crc32_ieee_polynomial"), (4, "asm", "crc32c_polynomial")}


def test_leaf_first():
    edges = [("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("d", "c"), ("f", "f")]
    order = graph.leaf_first(list("abcdefg"), edges)
    place = {v: i for i, c in enumerate(order) for v in c}
    assert place["c"] < place["b"] < place["a"] and ["d", "e"] in order and place["c"] < place["d"]
    chain = graph.leaf_first(list(range(2500)), [(i, i + 1) for i in range(2499)])
    assert chain == [[i] for i in range(2499, -1, -1)]


def test_propagate_and_cycles(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "node long, level long")
    edges = spark.createDataFrame([(2, 1), (3, 2)], "src long, dst long")
    name = lambda df: df.withColumn("name", F.concat(F.col("node").cast("string"), F.size("known").cast("string")))
    assert {r["node"]: r["name"] for r in graph.propagate(rows, edges, name, "node").collect()} == {1: "10", 2: "21", 3: "31"}
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (5, 5), (7, 8)], "src long, dst long")
    assert {r["node"] for r in graph.on_cycle(loop, 3).collect()} == {2, 3, 5}


def test_joins_fail_on_broken_contracts(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "x")], "id long, v string")
    with pytest.raises(Exception, match="an id has no row"):
        joins.checked_join(a, b, "id").collect()
    with pytest.raises(Exception, match="an id has no row"):
        joins.checked_join(a, b, "id").filter("v = 'x'").select("v").collect()
    with pytest.raises(Exception, match="twice"):
        joins.assert_unique(b.union(b), ["id"]).collect()
    with pytest.raises(Exception, match="differ"):
        joins.aligned(a, b, "id").collect()


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(400).select("id", (F.col("id") % 3).alias("g"), T.seeded("1", F.col("id")).alias("k"))
    for f in (lambda d: select.round_robin(d, "g", ["k"], 50), lambda d: select.stratified(d, "g", ["k"], 50), lambda d: select.length_buckets(d, F.col("k"), F.col("g"), 30)):
        assert sorted(map(repr, f(rows).collect())) == sorted(map(repr, f(rows.repartition(7, F.rand(2))).collect()))


def test_reports(spark, tmp_path):
    assert report.canonical_json({"b": -0.0, "a": 0.1 + 0.2}) == '{\n  "a": 0.3,\n  "b": 0.0\n}\n'
    with pytest.raises(ValueError, match="finite"):
        report.canonical_json([float("nan")])
    assert "| 1 | - |" in report.markdown(spark.createDataFrame([(1, None)], "a long, b double"), ["a"])
    k = stats.kappa(spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 1)], "a int, b int"), "a", "b").first()
    assert k["kappa"] == pytest.approx(0.5)


def test_sources_and_stream(spark, tmp_path):
    from millrace.sources import jsonl
    from millrace.streaming.resume import answer_new

    (tmp_path / "a.jsonl").write_text('{"id": "1", "v": 1}\n\n{"id": "2", "v": 2}\n{"id": "3", "v"')
    assert jsonl.read_tolerant(spark, str(tmp_path / "a.jsonl"), "id string, v long").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n{"id": "1"}\n')
    with pytest.raises(Exception, match="twice"):
        jsonl.read_strict(spark, str(tmp_path / "b.jsonl"), "id string", "id").collect()
    (tmp_path / "ids.txt").write_text("b\n\n a \n")
    assert [(r["id"], r["ordinal"]) for r in jsonl.read_ids(spark, str(tmp_path / "ids.txt")).orderBy("ordinal").collect()] == [("b", 0), ("a", 2)]
    rows = spark.createDataFrame([("1", 1), ("2", 2)], "id string, v long")
    jsonl.write_new(rows, f"{tmp_path}/in")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        jsonl.write_new(rows, f"{tmp_path}/in")
    for _ in range(2):
        answer_new(spark, f"{tmp_path}/in", "id string, v long", f"{tmp_path}/out", f"{tmp_path}/state", "id", lambda d: d.withColumn("w", F.col("v") + 1)).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    jsonl.append_missing(spark.createDataFrame([("2", 9), ("3", 3)], "id string, v long"), f"{tmp_path}/in", "id", "id string, v long")
    spark.createDataFrame([("2", 9), ("4", 4)], "id string, v long").write.mode("append").json(f"{tmp_path}/in")
    answer_new(spark, f"{tmp_path}/in", "id string, v long", f"{tmp_path}/out", f"{tmp_path}/state", "id", lambda d: d.withColumn("w", F.col("v") + 1)).awaitTermination()
    assert sorted((r["id"], r["w"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("1", 2), ("2", 3), ("3", 4), ("4", 5)]
    (tmp_path / "twice.jsonl").write_text('{"id": "1", "x": {"a": 1, "a": 2}}\n')
    with pytest.raises(Exception, match="twice"):
        jsonl.read_unique_keys(spark, str(tmp_path / "twice.jsonl"), "id string").collect()
    (tmp_path / "torn").mkdir()
    for name, text in (("a", '{"id": "1"}\n{"id": "2"}\n{"id'), ("b", '{"id": "3"}\n{"i')):
        (tmp_path / "torn" / name).write_text(text)
    assert jsonl.read_tolerant(spark, f"{tmp_path}/torn", "id string").count() == 3
    (tmp_path / "torn" / "c").write_text('{"id": "1"\n{"id": "2"}\n')
    with pytest.raises(Exception, match="no JSON"):
        jsonl.read_tolerant(spark, f"{tmp_path}/torn", "id string").collect()


def test_calls_and_gates(spark):
    from millrace.sources import calls

    seen, waits = [], []

    def flaky():
        seen.append(1)
        if len(seen) < 3:
            raise TimeoutError("busy")
        return "ok"

    assert calls.attempted(flaky, 6, 1.0, waits.append) == ("ok", None) and len(waits) == 2 and 1 <= waits[0] <= 2 <= waits[1] <= 4
    assert calls.attempted(lambda: 1 / 0, 2, 0.0, waits.append)[1].startswith("ZeroDivisionError")
    rows = spark.createDataFrame([(1, None), (2, "a")], "id long, q string")
    assert [tuple(r) for r in calls.answers(rows, "id", "q", str.upper, pause=0.0).orderBy("id").collect()] == [(1, None, "no request"), (2, "A", None)]
    with pytest.raises(Exception, match="page 1 of"):
        calls.paged(rows.filter("id = 2"), "q", lambda q, page: 1 / 0, "url string", 3, tries=1).collect()
    with pytest.raises(Exception, match="should have"):
        report.row_gate(rows, {"1": 1, "2": 2}, "id").collect()
    with pytest.raises(Exception, match="should have"):
        report.row_gate(rows, {"1": 1}, "id").collect()
    page = report.review_sheet(spark.createDataFrame([(1, "<b>", "a\nb")], "id long, name string, code string"), ["id"], "Rows & cards", ("code",))
    assert "&lt;b&gt;" in page and "<pre>a\nb</pre>" in page and "Rows &amp; cards" in page and "<script" not in page


def test_bootstrap_meets_every_draw_in_blocks(spark, monkeypatch):
    from pyspark.sql import Window

    units = spark.range(700).select((F.col("id") % 2).cast("string").alias("s"), (-F.col("id")).alias("unit"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("t"), (F.col("id") % 3 + 0.5).cast("double").alias("w"))
    place = F.row_number().over(Window.partitionBy("s").orderBy("unit")) - 1
    numbered = units.withColumn("place", place.cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("s")))
    drawn = numbered.select("s", F.col("place").alias("slot"), "n", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("rep")).withColumn("place", stats.draw("x", F.col("n"), "rep", "slot"))
    want = drawn.join(numbered.select("s", "place", "t", "w"), ["s", "place"]).groupBy("s", "rep").agg((F.sum("t") / F.sum("w")).alias("value")).collect()
    for once, block in ((1 << 20, 1 << 24), (40 * 13, 40 * 100)):
        monkeypatch.setattr(stats, "_AT_ONCE", once)
        monkeypatch.setattr(stats, "_A_BLOCK", block)
        got = {(r["s"], r["rep"]): r["value"] for r in stats.bootstrap_means(units, "s", "t", "w", 40, "x").collect()}
        assert len(got) == 80 and got == pytest.approx({(r["s"], r["rep"]): r["value"] for r in want}, rel=1e-12)


def test_bootstrap_broadcasts_no_units_and_no_draws(spark):
    units = spark.range(50).select(F.lit(0).alias("s"), F.col("id").alias("unit"), F.col("id").alias("t"), F.lit(1).alias("w"))
    lines = stats.bootstrap_means(units, "s", "t", "w", 20, "x")._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            below = [y for j, y in enumerate(lines) if j > i and all(d > depth[i] for d in depth[i + 1 : j + 1])]
            assert not [y for y in below if "Window" in y or "Generate" in y]


def test_constants_meet_in_no_task(spark):
    from millrace.functions import constants

    df = constants.constant_hints(spark.range(3).select("id", F.lit("0xfff1; 0x5a8279996ed9eba1").alias("c")), "id", {"code": ("c", False)})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {(r["id"], r["signature"], tuple(r["evidence"])) for r in df.collect()} == {(i, *h) for i in range(3) for h in (("adler32_modulus", ("0xfff1",)), ("sha1_round_k", ("0x5a827999", "0x6ed9eba1")))}


def test_boxes_in_place_order(spark):
    from millrace.functions import constants

    box = bytes.fromhex(constants.BOXES[0][1])
    texts = [", ".join(map(str, [7, *box[2:12]])), "0x" + box[3:11][::-1].hex() + ", 0x" + box[1:9].hex(), ", ".join(map(str, box[:7])) + ", 256, " + str(box[7]), "12345678901234567890123, " + ", ".join(f"{b:#x}" for b in box[8:])]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, c string")
    got = {r["id"]: r["evidence"] for r in constants.constant_hints(rows, "id", {"code": ("c", False)}).filter("strength = 'ordered_8_bytes'").collect()}
    assert got == {0: [box[2:10].hex()], 1: [box[3:11].hex()], 3: [box[8:].hex()]}
