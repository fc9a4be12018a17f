"""Import resolution, paths and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scalars as N
from graphloom.operators import imports as I


def test_python_imports(spark):
    files = I.files_frame(spark, ["src/pkg/__init__.py", "src/pkg/core.py", "src/pkg/sub/__init__.py", "src/pkg/sub/x.py", "tool.py"])
    rows = [("src/pkg/core.py", 1, "sub", 1, ["x"]), ("src/pkg/sub/x.py", 2, "", 2, ["core"]), ("tool.py", 3, "pkg.core", 0, []), ("tool.py", 4, "os", 0, []), ("tool.py", 5, "", 9, ["a"])]
    imports = spark.createDataFrame(rows, "path string, line int, specifier string, level int, names array<string>").withColumn("deferred", F.col("line") == 2)
    found = I.resolve_python(imports, files)
    assert sorted((r.line, r.target) for r in found.collect()) == [(1, "src/pkg/sub/__init__.py"), (1, "src/pkg/sub/x.py"), (2, "src/pkg/__init__.py"), (2, "src/pkg/core.py"), (3, "src/pkg/core.py")]
    edges = {(r.src, r.dst): (r.weight, r.hard) for r in I.dependency_edges(imports, found).collect()}
    assert edges == {("src/pkg", "src/pkg/sub"): (2, True), ("src/pkg/sub", "src/pkg"): (2, False), ("<root>", "src/pkg"): (1, True)}
    share = I.unresolved_share(imports, found, F.col("specifier") == "").first()
    assert (share.missing, share.edges, share.share) == (1, 3, 0.25)


def test_script_imports(spark):
    files = I.files_frame(spark, ["app/a.ts", "app/lib/index.ts", "app/b.tsx", "src/util.ts"])
    rows = [("app/a.ts", 1, "./lib"), ("app/a.ts", 2, "./b.js"), ("app/lib/index.ts", 3, "../a"), ("app/a.ts", 4, "@/util"), ("app/a.ts", 5, "react"), ("app/a.ts", 6, "../../../x")]
    aliases = I.path_aliases('{ // note\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"],}, } }')
    found = I.resolve_script(spark.createDataFrame(rows, "path string, line int, specifier string"), files, aliases)
    assert sorted((r.line, r.target) for r in found.collect()) == [(1, "app/lib/index.ts"), (2, "app/b.tsx"), (3, "app/a.ts"), (4, "src/util.ts")]


def test_packages(spark):
    files = I.files_frame(spark, ["m/java/com/x/A.java", "m/java/com/x/B.java", "m/java/com/y/C.java"])
    rows = [("m/java/com/y/C.java", 1, "com.x.A"), ("m/java/com/y/C.java", 2, "com.x"), ("m/java/com/y/C.java", 3, "java.util.List")]
    packages = spark.createDataFrame([("com.x", "m/java/com/x"), ("com.y", "m/java/com/y")], "package string, folder string")
    found = I.resolve_packages(spark.createDataFrame(rows, "path string, line int, specifier string"), files, packages)
    assert sorted((r.line, r.target[-6:]) for r in found.collect()) == [(1, "A.java"), (2, "A.java"), (2, "B.java")]
    assert I.go_module("// x\nmodule example.com/y\n") == "example.com/y"
    assert I.crates({"c/Cargo.toml": '[package]\nname = "my-crate"\n'}, ["c/src/lib.rs"]) == {"my_crate": "c/src/lib.rs"}


def test_names(spark):
    df = spark.createDataFrame([("a/./b/../c.py", "_x", "python"), ("../up.py", "Name", "go"), ("x/__init__.py", "", "rust")], "path string, name string, language string")
    got = df.select(N.normal_path(F.col("path")).alias("n"), N.private_by_name(F.col("name"), F.col("language")).alias("p"), N.module_name(F.col("path")).alias("m"), N.safe_session(F.lit("a b/c")).alias("s")).collect()
    assert [(r.n, r.p) for r in got] == [("a/c.py", True), (None, False), ("x/__init__.py", None)] and got[2].m == "x" and got[0].s == "a_b_c"
    said = df.limit(1).select(N.finding_sentence(F.lit("cyclomatic"), F.lit("f"), F.lit(12.0), F.lit(10.5))).first()[0]
    assert said == "f: cyclomatic 12 is over 10.5"
    assert N.strip_jsonc('{"a": "//x", /* y */ "b": [1, ], }') == '{"a": "//x",   "b": [1 ] }'
