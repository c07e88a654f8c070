import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import audit, graph, resolve, sessions
from graphloom.plans.patterns import ladder


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, text.name_tokens(F.lit("XMLHttpRequest_foo2"))) == ["xml", "http", "request", "foo2"]
    assert one(spark, text.project(F.lit("a/b.cs"))) == "a" and one(spark, text.project(F.lit("b.cs"))) == ""
    assert one(spark, text.joined_path(F.lit("a/b"), F.lit("../c/./d"))) == "a/c/d"
    assert one(spark, text.joined_path(F.lit("a"), F.lit("../../c"))) is None
    assert one(spark, text.whole_token(F.lit("x = Foo(y)"), F.lit("Foo"))) and not one(spark, text.whole_token(F.lit("FooEx()"), F.lit("Foo")))
    assert one(spark, text.bounded_distance(F.lit("kitten"), F.lit("sitting"))) == 3
    assert one(spark, text.ancestors(F.lit("a/b/c"))) == ["a/b", "a", ""]
    assert one(spark, text.unnumbered(F.lit("m::f-12"))) == "m::f" and one(spark, text.short_name(F.lit("N.A+B"))) == "B"
    assert one(spark, text.half_up(F.lit(-2.5))) == -2 and one(spark, text.percent_tenths(F.lit(1), F.lit(3))) == 333
    assert one(spark, text.is_test_path(F.lit("src/__tests__/a.ts"))) and not one(spark, text.is_test_path(F.lit("src/latest/a.ts")))

    tests = {"a.spec.ts": 1, "a/b.test.cjs": 1, "__tests__/x.js": 1, "src/latest.cs": 0, "a/Contest.py": 0, "src/foo_test.go": 0, "pkg/__tests__/data.json": 0}
    infra = {"AuthServiceExtensions.cs": 1, "DependencyResolution/X.cs": 1, "a/SuiteBaseFixture.cs": 1, "a/CompositionRootTests.cs": 1, "a/Program.cs": 1, "Model.g.cs": 0, "a/compositionroot-x.cs": 0}
    for paths, rule in ((tests, text.is_test_path), (infra, text.is_infra_path)):
        got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", rule(F.col("p")).cast("int").alias("y"))
        assert dict(map(tuple, got.collect())) == paths
    assert one(spark, text.name_tokens(F.lit("foo2Bar-ABc"))) == ["foo2", "bar", "a", "bc"]
    assert one(spark, text.purpose(F.lit("\ufeff \n\n//  says it\nmore"))) == "says it" and one(spark, text.purpose(F.lit("\n" * 15 + "late"))) is None
    assert one(spark, text.purpose(F.lit("#\nnext"))) == "#" and one(spark, text.purpose(F.lit("x" * 101))) == "x" * 97 + "..."


def test_page_rank_takes_arcs_as_a_set_and_starts_evenly_without_seeds(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    arcs = spark.createDataFrame([("a", "b")] * 3 + [("a", "c"), ("a", "gone")], "src string, dst string")
    got = dict(map(tuple, graph.page_rank(arcs, nodes, nodes.filter("node = 'a'"), 1).collect()))
    assert got == pytest.approx({"a": 0.15, "b": 0.425, "c": 0.425})
    even = dict(map(tuple, graph.page_rank(arcs, nodes, nodes.limit(0), 1).collect()))
    assert sum(even.values()) == pytest.approx(1.0) and even["b"] == pytest.approx(even["c"])


def test_ladder_first_step_answers(spark):
    a = spark.createDataFrame([("s", "x"), ("s", "y")], "seed string, candidate string")
    b = spark.createDataFrame([("s", "z"), ("t", "z")], "seed string, candidate string")
    got = {r["seed"]: (r["step"], r["outcome"], r["candidates"]) for r in ladder([a, b], "seed", "candidate").collect()}
    assert got == {"s": (0, "ambiguous", ["x", "y"]), "t": (1, "resolved", ["z"])}


def test_impact_seed_file_is_expanded_but_no_row(spark):
    defs = spark.createDataFrame([("a", "f1"), ("b", "f1"), ("c", "f2"), ("d", "f3")], "id string, file string")
    edges = spark.createDataFrame(
        [("f1", 1, "a", "f1", None), ("f2", 1, "b", "f1", None), ("f3", 1, "a", "f1", "guess")], "from_file string, from_line int, to string, to_file string, tier string"
    )
    got = {r["file"]: (r["hop"], r["via_count"], r["heuristic_count"]) for r in graph.impact(edges, defs, defs.filter("id = 'a'").select("id")).collect()}
    # f1 refers to itself: its other definition b is in the second frontier; f3 is a guess and ends there
    assert got == {"f3": (1, 0, 1), "f2": (2, 1, 0)}


def test_closure_of_a_cycle(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    assert sorted(map(tuple, graph.closure(arcs, nodes).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_closure_stops_with_an_error_not_with_less(spark):
    arcs = spark.createDataFrame([(k, k + 1) for k in range(4)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert graph.closure(arcs, start).count() == 5
    with pytest.raises(RuntimeError):
        graph.closure(arcs, start, most=2)
    with pytest.raises(RuntimeError):
        resolve.bases(arcs.selectExpr("src AS id", "dst AS base", "false AS is_interface", "0 AS position"), most=1)
    files = spark.createDataFrame([("main.rs",), ("a.rs",), ("a/b.rs",)], "file string")
    mods = spark.createDataFrame([("main.rs", "a", 0), ("a.rs", "b", 0)], "file string, name string, seq int")
    roots = files.filter("file = 'main.rs'").selectExpr("file", "0 AS seq")
    with pytest.raises(RuntimeError):
        resolve.module_tree(roots, mods, files, most=1)


def test_stub_count_resets_on_change(spark):
    rows = spark.createDataFrame([("s", i, c, 10) for i, c in enumerate("aab" + "bb")], "session string, ts long, sha string, size long")
    got = sessions.read_state(rows, ["session"], "sha", ["ts"], "size").first()
    assert (got["read_count"], got["stub_count"], got["content"], got["bytes_delivered"]) == (5, 2, "b", 20)


def test_precision_without_edges(spark):
    empty = spark.createDataFrame([], "file string, line int, target string, tier string")
    oracle = spark.createDataFrame([], "file string, line int, target string, external boolean")
    assert audit.by_tier(audit.classify(empty, oracle)).count() == 0
    assert audit.recall(empty, oracle).first()["recall"] == 0.0
