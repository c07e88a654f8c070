from pyspark.sql import functions as F

from graphloom.operators import resolve, sessions
from graphloom.sources import relations, scanners
from graphloom.streaming.sessions import read_states


def test_conditions_and_blanking():
    assert not scanners.evaluate("DEBUG") and scanners.evaluate("!DEBUG && (true || X)") and scanners.evaluate("A == B") and scanners.evaluate("X", frozenset({"X"}))
    text = "a\n#if X\nb\n#elif !X\nc\n#if Y\nd\n#endif\n#else\ne\n#endif\nf"
    assert scanners.active(text).split("\n") == ["a", "", "", "", "c", "", "", "", "", "", "", "f"]


def test_json_with_comments():
    text = '{"a": "x // y", /* c */ "compilerOptions": {"baseUrl": ".", "paths": {"@x/*": ["src/*",],},}, // end\n}'
    assert scanners.compiler_options(text) == {"extends": None, "baseUrl": ".", "paths": {"@x/*": ["src/*"]}}
    assert scanners.compiler_options("no") == {}


def test_package_maps():
    table = {"./a": {"import": "./a.mjs", "default": "./a.js"}, "./f/*": "./src/*.js", "./f/deep/*": ["./deep/*.js", "./alt/*.js"], "./no": None}
    assert scanners.package_match(table, "./a", ("import",)) == ["./a.mjs"] and scanners.package_match(table, "./a", ()) == ["./a.js"]
    assert scanners.package_match(table, "./f/x", ()) == ["./src/x.js"] and scanners.package_match(table, "./f/deep/y", ()) == ["./deep/y.js", "./alt/y.js"]
    assert scanners.package_match(table, "./no", ()) == [] and scanners.package_match(table, "./z", ()) == []


def test_counts_templates_and_manifests():
    assert [scanners.argument_count(s) for s in ("()->void", "(a)->b", "(Map<a, b>, [x, y])->z", "f(a)", "( )->v")] == [0, 1, 2, None, 0]
    assert not any(scanners.evaluate(c) for c in ("true X", "true @", "(true", "", "true =", "1")) and scanners.evaluate("(true) != false")
    html = "<p>{{ user.name }}</p>\n<b [hidden]=\"gone\" (click)=\"save('x', item)\">{{ 'lit' }}</b>"
    assert scanners.template_reads(html) == [("user", 1), ("gone", 2), ("save", 2), ("item", 2)]
    assert scanners.crate_roots('[package]\nname = "a"\n[[bin]]\nname = "b"\n') == [("lib", "src/lib.rs"), ("bin", "src/bin/b.rs")]


def test_tree_to_facts(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "A.cs").write_text("\ufeffusing System.Text;\n#if NEVER\nclass Gone {}\n#endif\npublic sealed class Kept {}\n")
    (tmp_path / "src" / "b.ts").write_text("import { x } from './c';\nexport class B {}\n")
    (tmp_path / "node_modules" / "c.ts").write_text("export class C {}\n")
    (tmp_path / "src" / "bad.rs").write_bytes(b"// \xff\npub fn go() {}\n")
    tree = relations.read_tree(spark, str(tmp_path), ["cs", "ts", "rs"], ["node_modules"])
    got = {(r["path"].rpartition("/")[2], r["family"], r["line"], r["name"]) for r in scanners.source_facts(tree).collect()}
    assert got == {("A.cs", "definition", 5, "Kept"), ("b.ts", "import", 1, "./c"), ("b.ts", "definition", 2, "B"), ("bad.rs", "definition", 2, "go")}
    first = relations.source_lines(tree).filter(F.col("file").endswith("A.cs")).filter("line = 1").first()["text"]
    assert first == "using System.Text;"


def test_scope_ladder(spark):
    defs = spark.createDataFrame([("A.B.T", "A.B", "T"), ("A.T", "A", "T"), ("U.V", "U", "V"), ("W.V", "W", "V")], "id string, namespace string, name string")
    refs = spark.createDataFrame([(1, "f", "A.B.C", "T"), (2, "f", "A", "T"), (3, "f", "X", "V"), (4, "f", "X", "N")], "ref long, file string, namespace string, name string")
    usings = spark.createDataFrame([("f", "U"), ("f", "W")], "file string, target string")
    got = {r["ref"]: (r["outcome"], r["first"]) for r in resolve.in_scope(refs, defs, usings).collect()}
    assert got == {1: ("ambiguous", "U.V") if False else ("resolved", "A.B.T"), 2: ("resolved", "A.T"), 3: ("ambiguous", "U.V"), 4: ("not found", None)}


def test_bases_and_overrides(spark):
    inherits = spark.createDataFrame([("C", "I", True, 0), ("C", "B", False, 1), ("B", "A", False, 0), ("A", "C", False, 0)], "id string, base string, is_interface boolean, position int")
    got = {(r["id"], r["base"]): r["path"] for r in resolve.bases(inherits).collect()}
    assert got[("C", "B")] == [1] and got[("C", "A")] == [1, 1] and got[("C", "I")] == [2] and ("C", "C") not in got
    members = spark.createDataFrame([("C", "run"), ("A", "run"), ("I", "run")], "id string, member string")
    assert {(r["id"], r["base"]) for r in resolve.overridden(members, resolve.bases(inherits)).collect()} >= {("C", "A")}


def test_reexport_chain(spark):
    own = spark.createDataFrame([("c", "X", "c#X"), ("d", "X", "d#X")], "file string, name string, id string")
    re_ = spark.createDataFrame([("a", "*", "b", "*", 0), ("b", "X", "c", "X", 1), ("b", "*", "d", "*", 0), ("a", "Y", "c", "X", 1), ("b", "*", "a", "*", 2)], "file string, name string, to_file string, source string, position int")
    names = spark.createDataFrame([("a", "X"), ("a", "Y"), ("a", "Z")], "file string, name string")
    got = {(r["name"]): (r["id"], r["hop"]) for r in resolve.exported(names, own, re_).collect()}
    assert got == {"X": ("d#X", 2), "Y": ("c#X", 1)}


def test_specifiers_and_modules(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("lib/q.ts",), ("x/r.ts",)], "file string")
    imports = spark.createDataFrame([("src/z.ts", "./a"), ("src/z.ts", "./a.js"), ("src/z.ts", "./b"), ("src/z.ts", "@l/q"), ("src/z.ts", "x/r"), ("src/z.ts", "no")], "from_file string, specifier string")
    aliases = spark.createDataFrame([(0, "@l/*", 0, "gone/*"), (0, "@l/*", 1, "lib/*")], "position int, pattern string, target_position int, target string")
    got = {r["specifier"]: (r["to_file"], r["via"]) for r in resolve.specifiers(imports, aliases, files).collect()}
    assert got == {"./a": ("src/a.ts", "relative"), "./a.js": ("src/a.ts", "relative"), "./b": ("src/b/index.ts", "relative"), "@l/q": ("lib/q.ts", "alias"), "x/r": ("x/r.ts", "base")}
    rust = spark.createDataFrame([(f,) for f in ("src/lib.rs", "src/a.rs", "src/a/b.rs", "src/c.rs", "src/c/mod.rs", "src/lost.rs")], "file string")
    mods = spark.createDataFrame([("src/lib.rs", "a", 0), ("src/a.rs", "b", 0), ("src/lib.rs", "c", 1)], "file string, name string, seq int")
    tree = {r["file"]: r["module"] for r in resolve.module_tree(spark.createDataFrame([("src/lib.rs", 0)], "file string, seq int"), mods, rust).collect()}
    assert tree["src/a/b.rs"] == "crate::a::b" and tree["src/c.rs"] == "crate" and tree["src/lost.rs"] == "crate"


def test_overrides_constants_reasons(spark):
    edges = spark.createDataFrame([("f", 1, "m", "x"), ("f", 2, "m", "y")], "file string, line int, member string, to string")
    facts = spark.createDataFrame([("f", 1, "m", "z"), ("g", 9, "m", "w")], "file string, line int, member string, to string")
    got = {(r["file"], r["line"]): (r["to"], r["source"]) for r in resolve.overruled(edges, facts).collect()}
    assert got == {("f", 1): ("z", "semantic"), ("f", 2): ("y", "ladder"), ("g", 9): ("w", "semantic-discovered")}
    parts = spark.createDataFrame([("A", 0, "a", None), ("B", 0, None, "A"), ("B", 1, "-b", None), ("C", 0, None, "C")], "name string, position int, literal string, reference string")
    assert {r["name"]: r["value"] for r in resolve.constants(parts).collect()} == {"A": "a", "B": "a-b"}
    checks = spark.range(1).select(resolve.first_failure([("dirty", F.lit(True)), ("missing", F.lit(None).cast("boolean")), ("late", F.lit(False))]).alias("r"))
    assert checks.first()["r"] == "missing"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", f"p{i % 2}", "ab"[i // 3 % 2], 10, i, i) for i in range(12)]
    schema = "session string, path string, content string, size long, ts long, seq long"
    for k in range(3):
        spark.createDataFrame(rows[k * 4 : k * 4 + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.sql("select * from states").collect():
        if r["read_count"] > last.get(r["path"], (0,))[0]:
            last[r["path"]] = tuple(r[c] for c in ("read_count", "stub_count", "content", "bytes_delivered"))
    batch = sessions.read_state(spark.createDataFrame(rows, schema), ["session", "path"], "content", ["ts", "seq"], "size")
    assert last == {r["path"]: tuple(r[c] for c in ("read_count", "stub_count", "content", "bytes_delivered")) for r in batch.collect()}
