"""Measures of any language from tables of syntax nodes and a grammar's roles.

A parser of whatever kind writes ``nodes(path, node, parent, pos, kind, field, named, text, start_byte, end_byte, line, end_line)``: numbers
by file, children in the order of ``pos``, ``text`` of leaves alone. A ``Grammar`` says which kinds of nodes play which role. Files
are groups of their own; a file without nodes has no rows, a null text is empty, a kind without a role is passed through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

NODES = "path string, node int, parent int, pos int, kind string, field string, named boolean, text string, start_byte int, end_byte int, line int, end_line int"
MEASURES = "path string, entity string, kind string, name string, start_line int, end_line int, metric_key string, value double"


def _kinds(text: str) -> frozenset[str]:
    return frozenset(text.split())


@dataclass(frozen=True)
class Grammar:
    """Roles of node kinds. ``other_way`` says how an ``if`` holds its other branch: ``direct`` in its alternative field, or ``wrapped`` in an else clause."""

    functions: frozenset[str]
    classes: frozenset[str]
    decisions: frozenset[str]
    structural: frozenset[str]
    deeper: frozenset[str]
    if_kind: str
    other_way: str
    boolean: str = "binary_expression"
    operators: frozenset[str] = frozenset({"&&", "||"})
    plain_else: frozenset[str] = frozenset({"block"})
    else_clause: str = "else_clause"
    jumps: frozenset[str] = frozenset()
    labels: frozenset[str] = frozenset()
    exits: frozenset[str] = frozenset()
    parameters: frozenset[str] = frozenset()
    receivers: frozenset[str] = frozenset()
    comments: frozenset[str] = frozenset({"comment"})
    strings: frozenset[str] = frozenset()
    calls: frozenset[str] = frozenset({"call_expression"})
    callee: str = "function"
    catch_all: frozenset[str] = frozenset()
    many_ways: frozenset[str] = frozenset()
    ways: frozenset[str] = frozenset()
    suffixes: tuple[str, ...] = field(default=())


#: Kinds of four public grammars by role.
GRAMMARS = {
    "go": Grammar(
        _kinds("function_declaration method_declaration func_literal"), _kinds("type_spec"), _kinds("if_statement for_statement expression_case type_case communication_case"),
        _kinds("if_statement for_statement expression_switch_statement type_switch_statement select_statement"), _kinds("func_literal function_declaration method_declaration"), "if_statement", "direct",
        jumps=_kinds("break_statement continue_statement goto_statement"), labels=_kinds("label_name identifier"), exits=_kinds("return_statement"), parameters=_kinds("parameter_declaration variadic_parameter_declaration"),
        strings=_kinds("interpreted_string_literal raw_string_literal"), suffixes=(".go",),
    ),
    "java": Grammar(
        _kinds("method_declaration constructor_declaration lambda_expression"), _kinds("class_declaration interface_declaration enum_declaration record_declaration annotation_type_declaration"),
        _kinds("if_statement ternary_expression for_statement enhanced_for_statement while_statement do_statement catch_clause switch_label"),
        _kinds("if_statement ternary_expression for_statement enhanced_for_statement while_statement do_statement catch_clause switch_expression switch_statement"), _kinds("lambda_expression method_declaration class_declaration"),
        "if_statement", "direct", plain_else=_kinds("block expression_statement"), jumps=_kinds("break_statement continue_statement"), labels=_kinds("identifier"), exits=_kinds("return_statement throw_statement"),
        parameters=_kinds("formal_parameter spread_parameter"), comments=_kinds("line_comment block_comment"), strings=_kinds("string_literal text_block"), calls=_kinds("method_invocation object_creation_expression"), callee="name",
        catch_all=_kinds("switch_label"), suffixes=(".java",),
    ),
    "typescript": Grammar(
        _kinds("function_declaration generator_function_declaration function_expression arrow_function method_definition"), _kinds("class_declaration abstract_class_declaration class interface_declaration enum_declaration"),
        _kinds("if_statement ternary_expression for_statement for_in_statement while_statement do_statement catch_clause switch_case"),
        _kinds("if_statement ternary_expression for_statement for_in_statement while_statement do_statement catch_clause switch_statement"), _kinds("function_declaration generator_function_declaration function_expression arrow_function method_definition"),
        "if_statement", "wrapped", jumps=_kinds("break_statement continue_statement"), labels=_kinds("statement_identifier"), exits=_kinds("return_statement throw_statement"), parameters=_kinds("required_parameter optional_parameter rest_pattern"),
        strings=_kinds("string template_string"), suffixes=(".ts", ".tsx"),
    ),
    "rust": Grammar(
        _kinds("function_item function_signature_item closure_expression"), _kinds("struct_item enum_item trait_item union_item impl_item"), _kinds("if_expression for_expression while_expression loop_expression try_expression"),
        _kinds("if_expression for_expression while_expression loop_expression match_expression"), _kinds("closure_expression function_item"), "if_expression", "wrapped", jumps=_kinds("break_expression continue_expression"),
        labels=_kinds("loop_label label"), exits=_kinds("return_expression try_expression"), parameters=_kinds("parameter self_parameter variadic_parameter"), receivers=_kinds("self_parameter"), comments=_kinds("line_comment block_comment"),
        strings=_kinds("string_literal raw_string_literal"), calls=_kinds("call_expression macro_invocation"), many_ways=_kinds("match_expression"), ways=_kinds("match_arm"), suffixes=(".rs",),
    ),
}


class Tree:
    """One file's nodes by number, with their children in order."""

    def __init__(self, rows: pd.DataFrame, grammar: Grammar) -> None:
        self.g = grammar
        self.at = {int(r.node): r for r in rows.itertuples(index=False)}
        self.below: dict[int, list[int]] = defaultdict(list)
        self.up: dict[int, int | None] = {}
        for r in sorted(self.at.values(), key=lambda r: (r.pos, r.node)):
            parent = None if pd.isna(r.parent) else int(r.parent)
            self.up[int(r.node)] = parent
            if parent is not None:
                self.below[parent].append(int(r.node))
        self.roots = [n for n, p in self.up.items() if p is None]

    def kind(self, n: int | None) -> str:
        return "" if n is None else self.at[n].kind

    def named(self, n: int) -> list[int]:
        return [c for c in self.below[n] if self.at[c].named and self.kind(c) not in self.g.comments]

    def part(self, n: int, name: str) -> int | None:
        return next((c for c in self.below[n] if self.at[c].field == name), None)

    def words(self, n: int) -> str:
        """The text of a node's leaves."""
        own = self.at[n].text
        return own if not self.below[n] and isinstance(own, str) else "".join(map(self.words, self.below[n]))

    def is_definition(self, n: int) -> bool:
        return self.kind(n) in self.g.functions or self.kind(n) in self.g.classes

    def inside(self, n: int) -> Iterator[int]:
        """Everything below a definition, nested definitions and what they hold left out."""
        stack = self.named(n)[::-1]
        while stack:
            x = stack.pop()
            if not self.is_definition(x):
                yield x
                stack += self.named(x)[::-1]

    def leaves(self, n: int) -> Iterator[int]:
        stack = [n]
        while stack:
            x = stack.pop()
            if self.kind(x) in self.g.comments:
                continue
            if self.kind(x) in self.g.strings or not self.below[x] and isinstance(self.at[x].text, str):
                yield x
            else:
                stack += self.below[x][::-1]


def operator(tree: Tree, n: int) -> str | None:
    """The boolean operator of a node, if it is one of the grammar's."""
    if tree.kind(n) != tree.g.boolean:
        return None
    found = tree.part(n, "operator")
    sign = tree.words(found) if found is not None else ""
    return sign if sign in tree.g.operators else None


def cyclomatic(tree: Tree, n: int) -> int:
    """one, and one for each decision; a branch that catches all is none, ``k`` exhaustive ways are ``k - 1``, a boolean operator is one."""
    g, total = tree.g, 1
    for x in tree.inside(n):
        kind = tree.kind(x)
        if kind in g.many_ways:
            stack, k = tree.named(x), 0
            while stack:
                y = stack.pop()
                if tree.kind(y) not in g.many_ways:
                    k += tree.kind(y) in g.ways
                    stack += tree.named(y)
            total += max(0, k - 1)
        elif kind in g.decisions:
            total += not (kind in g.catch_all and not tree.named(x))
        total += operator(tree, x) is not None
    return total


def runs(tree: Tree, n: int) -> int:
    """runs of one operator in a boolean expression, read from left to right; what isn't boolean in it ends it."""
    signs: list[str] = []

    def read(x: int | None) -> None:
        sign = None if x is None else operator(tree, x)
        if sign:
            read(tree.part(x, "left"))
            signs.append(sign)
            read(tree.part(x, "right"))

    read(n)
    return sum(a != b for a, b in zip(signs, [None, *signs], strict=False))


def cognitive(tree: Tree, n: int, name: str | None) -> int:
    """the published increments, in one walk in the order of the text.

    ``level`` is the depth that a node is met at, ``inner`` the depth of what it holds.
    """
    g, total = tree.g, 0
    level: dict[int, int] = {n: -1}
    inner: dict[int, int] = {n: 0}
    merged: set[int] = set()  # the ``if`` of an ``else if``, which has been counted
    stack = tree.named(n)[::-1]
    while stack:
        x = stack.pop()
        up, kind = tree.up[x], tree.kind(x)
        other = tree.kind(up) == g.if_kind and tree.at[x].field == "alternative"
        depth = level[up] if other else inner[up]
        gain, below = 0, depth
        sole = tree.named(x)
        if x in merged:
            below = depth + 1
        elif other and g.other_way == "direct" and (kind == g.if_kind or kind in g.plain_else):
            gain, below = 1, depth + 1
        elif kind == g.else_clause and g.other_way == "wrapped":
            if len(sole) == 1 and tree.kind(sole[0]) == g.if_kind:
                gain = 1
                merged.add(sole[0])
            elif tree.kind(up) == g.if_kind:
                gain, below = 1, depth + 1
        elif kind in g.structural:
            gain, below = 1 + depth, depth + 1
        elif kind in g.jumps:
            gain = int(any(tree.kind(c) in g.labels for c in sole))
        elif kind in g.deeper:
            below = depth + 1
        if operator(tree, x) and not operator(tree, up):
            gain += runs(tree, x)
        if name and kind in g.calls:
            callee = tree.part(x, g.callee)
            gain += callee is not None and tree.words(callee) == name
        total += gain
        level[x], inner[x] = depth, below
        stack += sole[::-1]
    return total


def nesting(tree: Tree, n: int) -> int:
    """the depth of the deepest control structure, an ``else if`` as deep as its ``if``."""
    g, depth, most = tree.g, {n: 0}, 0
    for x in tree.inside(n):
        up, kind = tree.up[x], tree.kind(x)
        chained = kind == g.if_kind and (tree.at[x].field == "alternative" or (tree.kind(up) == g.else_clause and len(tree.named(up)) == 1))
        base = depth.get(up, 0)
        depth[x] = base + (kind in g.structural and not chained)
        most = max(most, depth[x])
    return most


def parameters(tree: Tree, n: int) -> int:
    """parameters of a function, receivers left out."""
    held = tree.part(n, "parameters")
    return 0 if held is None else sum(tree.kind(c) in tree.g.parameters and tree.kind(c) not in tree.g.receivers for c in tree.named(held))


def callees(tree: Tree, n: int) -> list[str]:
    """F16: last names of what a function calls, nested definitions left out."""
    found = set()
    for x in tree.inside(n):
        callee = tree.part(x, tree.g.callee) or tree.part(x, "macro") if tree.kind(x) in tree.g.calls else None
        if callee is not None:
            last = [y for y in tree.leaves(callee) if "identifier" in tree.kind(y)]
            if last:
                found.add(tree.words(last[-1]))
    return sorted(found)


def tokens(tree: Tree, n: int) -> Iterator[tuple[str, int]]:
    """Leaves without comments and closing delimiters; names are ``$ID``, literals ``$LIT``."""
    for x in tree.leaves(n):
        kind, text = tree.kind(x), tree.words(x)
        if kind in tree.g.strings or kind.endswith("literal") or kind in ("number", "true", "false", "null", "nil"):
            yield "$LIT", int(tree.at[x].line)
        elif "identifier" in kind:
            yield "$ID", int(tree.at[x].line)
        elif text and text not in (")", "]", "}"):
            yield text, int(tree.at[x].line)


def line_counts(tree: Tree) -> dict[str, int]:
    """lines, lines with code, with comments alone, and blank ones."""
    code, comment, last = set(), set(), 0
    for x, r in tree.at.items():
        last = max(last, int(r.end_line))
        if tree.kind(x) in tree.g.comments:
            comment |= set(range(int(r.line), int(r.end_line) + 1))
    for root in tree.roots:
        for x in tree.leaves(root):
            code |= set(range(int(tree.at[x].line), int(tree.at[x].end_line) + 1))
    return {"lines": last, "sloc": len(code), "cloc": len(comment - code), "blank": last - len(code | comment)}


def entities(tree: Tree) -> Iterator[tuple[str, str, str, int]]:
    """(qualified name, kind, name, node) of named definitions; a function in a class is a method, wrappers in between don't count."""
    stack = [(c, "", False) for root in tree.roots for c in tree.named(root)][::-1]
    while stack:
        x, prefix, in_class = stack.pop()
        label = tree.part(x, "name") or (tree.part(x, "type") if tree.kind(x) in tree.g.classes else None)
        if tree.is_definition(x) and label is not None:
            name = tree.words(label)
            full = f"{prefix}.{name}" if prefix else name
            is_class = tree.kind(x) in tree.g.classes
            yield full, "class" if is_class else "method" if in_class or tree.part(x, "receiver") is not None else "function", name, x
            stack += [(c, full, is_class) for c in tree.named(x)][::-1]
        else:
            stack += [(c, prefix, in_class) for c in tree.named(x)][::-1]


def measure(path: str, tree: Tree) -> Iterator[tuple]:
    """MEASURES rows of one file."""
    for key, value in line_counts(tree).items():
        yield path, path, "module", path, 1, max((int(r.end_line) for r in tree.at.values()), default=1), key, float(value)
    methods: dict[str, list[int]] = defaultdict(list)
    found = list(entities(tree))
    for full, kind, name, n in found:
        span = int(tree.at[n].line), int(tree.at[n].end_line)
        if kind == "class":
            methods.setdefault(full, [])
            continue
        score = cyclomatic(tree, n)
        if kind == "method" and "." in full:
            methods[full.rpartition(".")[0]].append(score)
        exits = sum(tree.kind(x) in tree.g.exits for x in tree.inside(n))
        for key, value in (("cyclomatic", score), ("cognitive", cognitive(tree, n, name)), ("nesting", nesting(tree, n)), ("exits", exits), ("params", parameters(tree, n))):
            yield path, full, kind, name, *span, key, float(value)
    for full, kind, name, n in found:
        if kind == "class":
            for key, value in (("nom", len(methods[full])), ("wmc", sum(methods[full]))):
                yield path, full, kind, name, int(tree.at[n].line), int(tree.at[n].end_line), key, float(value)


def measure_trees(nodes: DataFrame, grammar: Grammar) -> DataFrame:
    """MEASURES of every file of ``nodes``, a file a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(measure(pdf["path"].iloc[0], Tree(pdf, grammar))), columns=[c.split()[0] for c in MEASURES.split(", ")])

    return nodes.groupBy("path").applyInPandas(run, MEASURES)


def token_rows(nodes: DataFrame, grammar: Grammar) -> DataFrame:
    """(path, pos, norm, line), as ``clone_classes`` takes them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf, grammar)
        rows = [t for root in tree.roots for t in tokens(tree, root)]
        return pd.DataFrame([(pdf["path"].iloc[0], i, t, line) for i, (t, line) in enumerate(rows)], columns=["path", "pos", "norm", "line"])

    return nodes.groupBy("path").applyInPandas(run, "path string, pos int, norm string, line int")


def call_rows(nodes: DataFrame, grammar: Grammar) -> DataFrame:
    """F16: (path, entity, callee)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf, grammar)
        rows = [(pdf["path"].iloc[0], full, c) for full, kind, _, n in entities(tree) if kind != "class" for c in callees(tree, n)]
        return pd.DataFrame(rows, columns=["path", "entity", "callee"])

    return nodes.groupBy("path").applyInPandas(run, "path string, entity string, callee string")
