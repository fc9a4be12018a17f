"""Import tables to dependency edges.

Null specifiers and paths resolve to nothing; repeated imports count once for a target and each for a weight; empty tables give no edges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import component, folder, normal_path, strip_jsonc

#: Kinds of imports that exist at run time.
RUNTIME = ("value", "wildcard", "side_effect", "dynamic")
#: File endings that stand for a module, in order of preference.
SCRIPT_ENDINGS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js")


def runtime_imports(imports: DataFrame) -> DataFrame:
    """Imports that run: no type-only ones, none of declaration files."""
    return imports.where(F.col("kind").isin(*RUNTIME) & ~F.col("path").endswith(".d.ts"))


def _first(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Of ``candidates(path, line, specifier, rank, file)`` the known files of least rank."""
    known = candidates.join(files.select(F.col("path").alias("file")).distinct(), "file")
    best = F.min("rank").over(Window.partitionBy("path", "line", "specifier"))
    return known.withColumn("_b", best).where("rank = _b").select("path", "line", "specifier", F.col("file").alias("target")).distinct()


def python_roots(files: DataFrame) -> DataFrame:
    """Folders that dotted modules are spelled from: they hold a package and are none themselves; the root if it has modules."""
    packages = files.where(F.col("path").rlike(r"(^|/)__init__\.pyi?$")).select(folder(F.col("path")).alias("package")).distinct()
    above = packages.select(folder(F.col("package")).alias("root")).distinct()
    inner = above.join(packages.withColumnRenamed("package", "root"), "root", "left_anti")
    top = files.where(F.col("path").rlike(r"^[^/]+\.pyi?$")).select(F.lit("").alias("root")).limit(1)
    return inner.union(top).distinct()


def _spelled(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``(stem, root, init, file)``: how each Python file is spelled from every root above it; a package by its folder. Files meet the
    roots among their own folders, so that roots and imports never meet but by what they spell."""
    whole = F.regexp_replace("path", r"\.pyi?$", "")
    init = whole.rlike(r"(^|/)__init__$")
    rows = files.select("path").distinct().where(F.col("path").rlike(r"\.pyi?$")).select(F.col("path").alias("file"), init.cast("int").alias("init"), F.split(F.when(init, folder(F.col("path"))).otherwise(whole), "/").alias("parts"))
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.struct(F.array_join(F.slice("parts", F.lit(1), i), "/").alias("root"), F.array_join(F.slice("parts", i + 1, F.size("parts")), "/").alias("stem"))))
    return rows.select("file", "init", cut.alias("c")).select("file", "init", "c.root", "c.stem").join(roots, "root")


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """F33 for Python: ``imports(path, line, specifier, level, names)`` to targets among ``files(path)``.

    Relative imports start at the file's package, others at each root, the deepest first. A name may be a module, or a
    package, which is reached together with the imported names that are modules of it.
    """
    rows = imports.select("path", "line", "specifier", "level", "names")
    ups = F.expr("array_join(array_repeat('..', level - 1), '/')")
    base = normal_path(F.concat_ws("/", folder(F.col("path")), ups))
    dotted = F.replace(F.col("specifier"), F.lit("."), F.lit("/"))
    relative = rows.where("level > 0").select("*", F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(dotted, F.lit(""))).alias("stem"), F.lit(0).alias("order"), base.alias("_base")).where("_base is not null").drop("_base")
    rank = lambda order, root, init: F.struct(order.alias("order"), root.alias("root"), F.lit(init).alias("init")).alias("rank")
    module = [F.struct(rank(F.lit(0), F.lit(""), 0), F.concat("stem", F.lit(e)).alias("file")) for e in (".py", ".pyi")]
    inits = [F.struct(rank(F.lit(0), F.lit(""), 1), F.concat_ws("/", F.nullif("stem", F.lit("")), F.lit(f"__init__{e}")).alias("file")) for e in (".py", ".pyi")]
    near = relative.select("path", "line", "specifier", F.explode(F.array(*module, *inits)).alias("c")).select("path", "line", "specifier", "c.rank", "c.file")
    spelled = _spelled(files, python_roots(files))
    far = rows.where("level = 0 and specifier <> ''").select("path", "line", "specifier", dotted.alias("stem")).join(spelled, "stem")
    far = far.select("path", "line", "specifier", rank(-F.length("root"), F.col("root"), 0).withField("init", F.col("init")).alias("rank"), "file")
    found = _first(near.unionByName(far), files)
    packages = found.where(F.col("target").rlike(r"(^|/)__init__\.pyi?$"))
    subs = rows.join(packages, ["path", "line", "specifier"]).select("path", "line", "specifier", F.explode("names").alias("name"), folder(F.col("target")).alias("package"))
    subs = subs.select("path", "line", "specifier", F.explode(F.array(*[F.concat_ws("/", F.nullif("package", F.lit("")), F.concat("name", F.lit(e))) for e in (".py", "/__init__.py")])).alias("file"))
    more = subs.join(files.select(F.col("path").alias("file")), "file", "left_semi").select("path", "line", "specifier", F.col("file").alias("target"))
    return found.union(more).distinct()


def resolve_script(imports: DataFrame, files: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """F33 for ECMAScript: relative specifiers and path aliases (``@/*`` to folders), endings in order of preference."""
    rows = imports.select("path", "line", "specifier")
    spec = F.col("specifier")
    relative = rows.where(spec.rlike(r"^\.\.?(/|$)")).select("*", normal_path(F.concat_ws("/", folder(F.col("path")), spec)).alias("stem"), F.lit(0).alias("order"))
    stems = relative
    for i, (alias, targets) in enumerate(sorted((aliases or {}).items(), key=lambda x: (-len(x[0]), x[0]))):
        head, star, tail = alias.partition("*")
        hit = rows.where(spec.startswith(head) & spec.endswith(tail)) if star else rows.where(spec == alias)
        for j, target in enumerate(targets):
            rest = F.regexp_replace(spec, "^" + re.escape(head), "") if star else F.lit("")
            stem = normal_path(F.concat(F.lit(target.split("*")[0]), rest))
            stems = stems.unionByName(hit.select("*", stem.alias("stem"), F.lit(1 + 100 * i + j).alias("order")))
    plain = F.regexp_replace("stem", r"\.(m|c)?js$", "")
    options = [F.struct((F.col("order") * 100).alias("rank"), F.col("stem").alias("file"))]
    options += [F.struct((F.col("order") * 100 + 1 + k).alias("rank"), F.concat(plain, F.lit(e)).alias("file")) for k, e in enumerate(SCRIPT_ENDINGS)]
    return _first(stems.select("path", "line", "specifier", F.explode(F.array(*options)).alias("c")).select("path", "line", "specifier", "c.rank", "c.file"), files)


def resolve_packages(imports: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """F33 for Java and Go: a specifier reaches the files of the package ``packages(package, folder)`` it names; for a class, that class's file."""
    rows = imports.select("path", "line", "specifier")
    inside = files.select("path", folder(F.col("path")).alias("folder"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"))
    whole = rows.join(packages, rows.specifier == packages.package).join(inside.select("folder", F.col("path").alias("target")), "folder").select("path", "line", "specifier", "target")
    parent, last = F.regexp_replace("specifier", r"\.[^.]*$", ""), F.regexp_extract("specifier", r"([^.]+)$", 1)
    single = rows.withColumn("_p", parent).withColumn("stem", last).join(packages.withColumnRenamed("package", "_p"), "_p").join(inside.select("folder", "stem", F.col("path").alias("target")), ["folder", "stem"]).select("path", "line", "specifier", "target")
    return whole.union(single).where("target <> path").distinct()


def resolve_swift(imports: DataFrame, files: DataFrame) -> DataFrame:
    """F33 for Swift: a module's import reaches every Swift file below a folder ``Sources/<module>``."""
    owner = F.regexp_extract("path", r"(?:^|/)Sources/([^/]+)/", 1)
    # nested packages: each ``Sources`` folder on the way names a module
    modules = files.where(F.col("path").endswith(".swift")).select(F.col("path").alias("target"), F.explode(F.array_distinct(F.concat(F.regexp_extract_all("path", F.lit(r"(?:^|/)Sources/([^/]+)(?=/)"), F.lit(1)), F.array(owner)))).alias("specifier"))
    return imports.select("path", "line", "specifier").join(modules.where("specifier <> ''").distinct(), "specifier").select("path", "line", "specifier", "target")


#: Files that are a module themselves; other files open a folder of children beside them.
_OWN_MODULE = ("lib", "main", "mod")


def resolve_rust(imports: DataFrame, files: DataFrame, crates_: DataFrame) -> DataFrame:
    """``use`` paths (``::`` or ``.`` between segments) to the file of the deepest module that they name, one at most.

    ``crates_(crate, folder, root)``: name, folder and root file of each crate. The head tells where the rest is looked up:
    ``crate`` from the root of the file's crate (that of the longest folder about it), ``self`` from the file's own module, ``super``
    from its parent, a crate's name from that crate's root; any other head is a dependency. Segments are dropped from the end until
    ``<stem>.rs`` or ``<stem>/mod.rs`` is known; if none is, the base module's own file is the target. Candidates of
    all lengths meet the known files in one equi-join. A ``super`` in a crate's root means that root.
    """
    known = files.select(F.col("path").alias("file")).distinct()
    segments = F.filter(F.split("specifier", r"::|\."), lambda x: x != "")
    rows = imports.select("path", "line", "specifier", segments.alias("segments")).where(F.size("segments") > 0)
    rows = rows.select("path", "line", "specifier", F.get("segments", F.lit(0)).alias("head"), F.slice("segments", 2, 1000).alias("rest"))
    stem, here = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), folder(F.col("path"))
    under = lambda base, name: F.when(base == "", name).otherwise(F.concat_ws("/", base, name))
    children = F.when(stem.isin(*_OWN_MODULE), here).otherwise(under(here, stem))
    self_ = rows.where("head = 'self'").select("path", "line", "specifier", "rest", children.alias("base"), F.col("path").alias("own"))
    at_root = stem.isin("lib", "main")
    above = F.when(at_root, children).when(stem == "mod", folder(here)).otherwise(here)
    up = rows.where("head = 'super'").select("path", "line", "specifier", "rest", above.alias("base"), at_root.alias("_root"))
    homes = files.select("path").distinct().where(F.col("path").endswith(".rs"))
    spelled = homes.select(F.when(F.col("path").rlike(r"(^|/)mod\.rs$"), folder(F.col("path"))).otherwise(F.regexp_replace("path", r"\.rs$", "")).alias("base"), F.col("path").alias("_file"), F.col("path").rlike(r"(^|/)mod\.rs$").alias("_mod"))
    roots = crates_.select(folder(F.col("root")).alias("base"), F.col("root").alias("_file"))
    best = spelled.select("base", "_file", F.when(F.col("_mod"), 0).otherwise(1).alias("_k")).union(roots.select("base", "_file", F.lit(2))).groupBy("base").agg(F.min(F.struct("_k", "_file")).alias("_b")).select("base", F.col("_b._file").alias("_file"))
    super_ = up.join(best, "base", "left").select("path", "line", "specifier", "rest", "base", F.when(F.col("_root"), F.col("path")).otherwise(F.col("_file")).alias("own"))
    folders = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    about = rows.where("head = 'crate'").select("path").distinct().select("path", F.explode(folders).alias("folder")).join(crates_.select("folder", "root"), "folder")
    mine = about.groupBy("path").agg(F.max_by("root", F.length("folder")).alias("root"))
    crate = rows.where("head = 'crate'").join(mine, "path")
    other = rows.where(~F.col("head").isin("crate", "self", "super")).join(crates_.select(F.col("crate").alias("head"), "root"), "head")
    rooted = crate.select("path", "line", "specifier", "rest", "root").union(other.select("path", "line", "specifier", "rest", "root"))
    rooted = rooted.select("path", "line", "specifier", "rest", folder(F.col("root")).alias("base"), F.col("root").alias("own"))
    bases = self_.unionByName(super_).unionByName(rooted)
    lengths = bases.select("path", "line", "specifier", "base", "rest", F.explode(F.when(F.size("rest") > 0, F.sequence(F.lit(1), F.size("rest"))).otherwise(F.array().cast("array<int>"))).alias("n"))
    stems = lengths.withColumn("stem", under(F.col("base"), F.array_join(F.expr("slice(rest, 1, n)"), "/")))
    options = F.array(F.struct((-2 * F.col("n")).alias("rank"), F.concat("stem", F.lit(".rs")).alias("file")), F.struct((1 - 2 * F.col("n")).alias("rank"), F.concat("stem", F.lit("/mod.rs")).alias("file")))
    deep = _first(stems.select("path", "line", "specifier", F.explode(options).alias("c")).select("path", "line", "specifier", "c.rank", "c.file"), files)
    plain = bases.where("own is not null").join(deep, ["path", "line", "specifier"], "left_anti").join(known, bases.own == known.file, "left_semi").select("path", "line", "specifier", F.col("own").alias("target"))
    return deep.unionByName(plain).distinct()


def dependency_edges(imports: DataFrame, targets: DataFrame, granularity: str = "directory") -> DataFrame:
    """Component edges with weight, and whether an import outside functions stands behind them (``hard``)."""
    j = imports.join(targets, ["path", "line", "specifier"])
    e = j.select(component(F.col("path"), granularity).alias("src"), component(F.col("target"), granularity).alias("dst"), "deferred").where("src <> dst")
    return e.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.bool_or(~F.col("deferred")).alias("hard"))


def component_sizes(entities: DataFrame, granularity: str = "directory") -> DataFrame:
    """Lines of the root entities (``parent_id`` null) of ``entities(path, parent_id, line_count)`` by component."""
    return entities.where(F.col("parent_id").isNull()).groupBy(component(F.col("path"), granularity).alias("component")).agg(F.sum("line_count").alias("size"))


def ring_crossings(edges: DataFrame, rings: DataFrame) -> DataFrame:
    """Edges of ``edges(src, dst)`` between different nodes of one ring of ``rings(component, node)``, with the ring."""
    a = rings.select(F.col("node").alias("src"), F.col("component").alias("ring"))
    b = rings.select(F.col("node").alias("dst"), F.col("component").alias("ring"))
    return edges.select("src", "dst").distinct().where("src <> dst").join(a, "src").join(b, ["dst", "ring"]).select("src", "dst", "ring")


def cycle_facts(contract: str, edges: DataFrame, rings: DataFrame, component_of: DataFrame | None = None) -> DataFrame:
    """``(contract, src, dst)`` for each import behind a ring.

    With ``component_of(path, component)``, ``edges`` are between files and ``rings`` between their components; files without
    a component have no facts. Which edges were taken for the rings (all, or without deferred ones) is the caller's choice.
    """
    if component_of is None:
        return ring_crossings(edges, rings).select(F.lit(contract).alias("contract"), "src", "dst")
    ends = [component_of.select(F.col("path").alias(c), F.col("component").alias(k)) for c, k in (("src", "_a"), ("dst", "_b"))]
    files = edges.select("src", "dst").distinct().join(ends[0], "src").join(ends[1], "dst")
    pairs = ring_crossings(files.select(F.col("_a").alias("src"), F.col("_b").alias("dst")), rings).select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    return files.join(pairs, ["_a", "_b"], "left_semi").select(F.lit(contract).alias("contract"), "src", "dst")


def unresolved_share(imports: DataFrame, targets: DataFrame, own: Column) -> DataFrame:
    """Imports of the own code (``own``, a condition) without a target, and their share of these and the resolved."""
    hit = targets.select("path", "line", "specifier").distinct().withColumn("_t", F.lit(True))
    j = imports.join(hit, ["path", "line", "specifier"], "left")
    missing, edges = F.count_if(F.col("_t").isNull() & own), F.count_if(F.col("_t"))
    return j.agg(missing.alias("missing"), edges.alias("edges"), F.coalesce(F.try_divide(missing, missing + edges), F.lit(0.0)).alias("share"))


def imports_behind(cut: DataFrame, imports: DataFrame, targets: DataFrame, granularity: str = "directory") -> DataFrame:
    """The file imports behind each component edge of ``cut(src, dst)``, sorted."""
    j = imports.join(targets, ["path", "line", "specifier"]).select(component(F.col("path"), granularity).alias("src"), component(F.col("target"), granularity).alias("dst"), F.concat_ws(" -> ", "path", "target").alias("edge"))
    return j.join(cut.select("src", "dst"), ["src", "dst"]).groupBy("src", "dst").agg(F.sort_array(F.collect_set("edge")).alias("imports"))


def path_aliases(text: str) -> dict[str, list[str]]:
    """``compilerOptions.paths`` of a tsconfig, relative to its base."""
    options = json.loads(strip_jsonc(text)).get("compilerOptions", {})
    base = options.get("baseUrl", ".").strip("./")
    return {k: ["/".join(x for x in (base, v.removeprefix("./")) if x) for v in vs] for k, vs in options.get("paths", {}).items()}


def go_module(text: str) -> str | None:
    """The module of a go.mod."""
    found = re.search(r"(?m)^module\s+(\S+)", text)
    return found[1] if found else None


def workspace_globs(package_json: str) -> list[str]:
    """Workspace globs of a package.json."""
    found = json.loads(package_json).get("workspaces", [])
    return found if isinstance(found, list) else found.get("packages", [])


def workspace_packages(manifests: DataFrame) -> DataFrame:
    """Packages of a workspace from ``manifests(path, value)``, whole files by path below its root: (package, folder).

    The globs come from the root's ``package.json`` (``workspaces``, a list or under ``packages``), else ``pnpm-workspace.yaml``, else
    ``lerna.json``: the first that has any. A package is named by its own ``package.json``; of several with one name that of the first
    glob counts, then the least folder. ``*`` stays in a folder, ``**`` crosses them. Null and unreadable files name nothing.
    """
    from ..sources.readers import listed_under

    as_list = lambda at: F.from_json(F.get_json_object("value", at), "array<string>")
    own = F.coalesce(as_list("$.workspaces"), as_list("$.workspaces.packages"))
    globs = F.when(F.col("path") == "package.json", own).when(F.col("path") == "pnpm-workspace.yaml", listed_under(F.col("value"), "packages")).when(F.col("path") == "lerna.json", as_list("$.packages"))
    rank = F.array_position(F.array(*map(F.lit, ("package.json", "pnpm-workspace.yaml", "lerna.json"))), F.col("path"))
    declared = manifests.select(rank.alias("rank"), globs.alias("globs")).where(F.size("globs") > 0).agg(F.min_by("globs", "rank").alias("globs"))

    @F.pandas_udf("array<string>")
    def patterns(found: pd.Series) -> pd.Series:
        return found.map(lambda gs: None if gs is None else [folder_regex(g) for g in gs if g is not None])

    named = manifests.where(F.col("path").endswith("/package.json")).select(F.regexp_replace("path", "/package\\.json$", "").alias("folder"), F.get_json_object("value", "$.name").alias("package")).where("package <> ''")
    tried = named.crossJoin(F.broadcast(declared.select(patterns("globs").alias("patterns"))))  # of one row
    first = F.expr("array_position(transform(patterns, p -> concat(folder, '/') rlike p), true)")
    return tried.withColumn("rank", first).where("rank > 0").groupBy("package").agg(F.min_by("folder", F.struct("rank", "folder")).alias("folder"))


def folder_regex(glob: str) -> str:
    """A glob of folders, by segments, as a regex over the path with a slash at its end."""
    parts = [x for x in glob.split("/") if x not in ("", ".")]
    whole = "".join("(?:[^/]+/)*" if p == "**" else "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in p) + "/" for p in parts)
    return f"^(?=.)(?:{whole})(?<=/)$"


def crates(manifests: Mapping[str, str], known: Sequence[str]) -> dict[str, str]:
    """S18e: crate name (``-`` as ``_``) to its root file: the library path, else a binary's, else ``src/lib.rs`` or ``src/main.rs``."""
    import tomllib

    out = {}
    for path, text in manifests.items():
        data = tomllib.loads(text)
        name = data.get("package", {}).get("name")
        if not name:
            continue
        home = path.rpartition("/")[0]
        options = [data.get("lib", {}).get("path"), *(b.get("path") for b in data.get("bin", [])), "src/lib.rs", "src/main.rs"]
        full = ["/".join(x for x in (home, o) if x) for o in options if o]
        root = next((f for f in full if f in set(known)), None)
        if root:
            out[name.replace("-", "_")] = root
    return out


def files_frame(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string")
