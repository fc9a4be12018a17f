"""Scalar functions as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def private_by_name(name: Column, language: Column) -> Column:
    """underscore, casing or hash rule of the language; null where a name can't tell."""
    rule = (
        F.when(language == "python", name.startswith("_"))
        .when(language.isin("go"), ~F.substring(name, 1, 1).rlike(r"\p{Lu}"))
        .when(language.isin("typescript", "tsx", "javascript"), F.when(name.startswith("#"), True).otherwise(F.lit(None)))
    )
    return F.when(F.length(name) > 0, rule)


def declared_private(name: Column, language: Column, private_modifier: Column, public_modifier: Column, top_level: Column, exported: Column, module: Column) -> Column:
    """is a definition private to its file? Null where the language has no rule for it.

    Python and Go by name; Java and Swift by the modifier ``private``; Rust without any visibility modifier; TypeScript by
    name, by modifier, or at the top level of an ES ``module`` that doesn't export it; JavaScript likewise without modifiers.
    """
    hash_name, unexported = name.startswith("#"), module & top_level & ~exported
    rule = (
        F.when(language == "python", name.startswith("_"))
        .when(language == "go", ~F.substring(name, 1, 1).rlike(r"\p{Lu}"))
        .when(language.isin("java", "swift"), private_modifier)
        .when(language == "rust", ~public_modifier)
        .when(language.isin("typescript", "tsx"), hash_name | private_modifier | unexported)
        .when(language == "javascript", hash_name | unexported)
    )
    return F.coalesce(rule, F.when(language.isin("python", "go", "java", "swift", "rust", "typescript", "tsx", "javascript"), False))


def dispatched_by_name(name: Column, language: Column, owner: Column) -> Column:
    """is the member reached through its class by its name: dunder, constructor, or the class's own name."""
    return F.coalesce(
        F.when(language == "python", name.rlike("^__.*__$")).when(language.isin("typescript", "tsx", "javascript"), name == "constructor").when(language == "java", name == owner), F.lit(False)
    )


def module_name(path: Column) -> Column:
    """the path without its extension, dotted; a package's init module has the package's name."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` collapsed; a leading ``..`` that leaves the tree gives null."""
    step = lambda done, part: F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def folder(path: Column) -> Column:
    """The folder of a path, empty at the root."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def component(path: Column, granularity: str = "directory") -> Column:
    """The component of a file: its directory, its top segment or itself; the root is ``<root>``."""
    name = {"directory": folder(path), "top": F.when(path.contains("/"), F.split(path, "/")[0]).otherwise(F.lit("")), "file": path}[granularity]
    return F.when(name == "", "<root>").otherwise(name)


def safe_session(session: Column) -> Column:
    """a name for files: other characters become ``_``, 96 characters at most."""
    return F.substring(F.regexp_replace(session, r"[^A-Za-z0-9_.\-]", "_"), 1, 96)


def finding_sentence(rule: Column, entity: Column, value: Column, ceiling: Column) -> Column:
    """what is said of a finding; a missing ceiling leaves the measure alone."""
    number = lambda c: F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"\.?0+$", "")
    return F.when(ceiling.isNull(), F.concat_ws(" ", entity, F.lit("breaks"), rule)).otherwise(F.concat(entity, F.lit(": "), rule, F.lit(" "), number(value), F.lit(" is over "), number(ceiling)))


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
    plain = token.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    commas = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])')
    return commas.sub(lambda m: m[0] if m[0][0] == '"' else "", plain)
