"""Per-file measures of Python sources with the standard library's parser.

Only Python can be parsed here. A file of another language, or one that doesn't parse, gets a row with ``parse_incomplete`` and no
measures: never a zero.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_NESTED = (*_FUNCTION, ast.ClassDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
METRICS = "path string, entity string, kind string, name string, start_line int, end_line int, metric_key string, value double, explanation array<string>"


def _inside(node: ast.AST) -> Iterator[ast.AST]:
    """Everything below a definition, without what nested definitions hold."""
    stack = list(ast.iter_child_nodes(node))
    while stack:
        x = stack.pop()
        yield x
        if not isinstance(x, _NESTED):
            stack += ast.iter_child_nodes(x)


def cyclomatic(node: ast.AST) -> int:
    """one, and one for each decision; a catch-all case doesn't count, a boolean run of n operands counts n - 1."""
    n = 1
    for x in _inside(node):
        if isinstance(x, (ast.If, ast.IfExp, *_LOOPS, ast.ExceptHandler, ast.Assert)):
            n += 1
        elif isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
        elif isinstance(x, ast.match_case):
            n += not (isinstance(x.pattern, ast.MatchAs) and x.pattern.pattern is None and x.guard is None)
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
    return n


class _Cognitive:
    """the published increments: structural 1 + nesting, hybrid 1, like boolean operators 1 a run, direct recursion 1."""

    def __init__(self, name: str | None) -> None:
        self.name, self.score, self.trail = name, 0, []

    def add(self, node: ast.AST, n: int, why: str) -> None:
        self.score += n
        self.trail.append(f"{node.lineno}: {why} adds {n}")

    def many(self, nodes, depth: int) -> None:
        for x in nodes:
            self.visit(x, depth)

    def structural(self, x: ast.AST, depth: int, label: str) -> None:
        self.add(x, 1 + depth, f"`{label}`" + (f" nested {depth} deep" if depth else ""))

    def orelse(self, x, depth: int) -> None:
        if len(x.orelse) == 1 and isinstance(x, ast.If) and isinstance(x.orelse[0], ast.If) and x.orelse[0].col_offset == x.col_offset:
            inner = x.orelse[0]
            self.add(inner, 1, "`elif`")
            self.visit(inner.test, depth + 1)
            self.many(inner.body, depth + 1)
            self.orelse(inner, depth)
        elif x.orelse and isinstance(x, ast.If):
            self.add(x.orelse[0], 1, "`else`")
            self.many(x.orelse, depth + 1)
        else:
            self.many(x.orelse, depth)

    def visit(self, x: ast.AST, depth: int) -> None:
        if isinstance(x, ast.If):
            self.structural(x, depth, "if")
            self.visit(x.test, depth + 1)
            self.many(x.body, depth + 1)
            self.orelse(x, depth)
        elif isinstance(x, _LOOPS):
            self.structural(x, depth, "while" if isinstance(x, ast.While) else "for")
            self.many([x.test] if isinstance(x, ast.While) else [x.target, x.iter], depth + 1)
            self.many(x.body, depth + 1)
            self.orelse(x, depth)
        elif isinstance(x, (ast.ExceptHandler, ast.Match, ast.IfExp)):
            self.structural(x, depth, {ast.ExceptHandler: "except", ast.Match: "match"}.get(type(x), "conditional"))
            self.many(ast.iter_child_nodes(x), depth + 1)
        elif isinstance(x, _COMPREHENSIONS):
            for i, g in enumerate(x.generators):
                self.structural(x, depth + i, "for")
                for test in g.ifs:
                    self.structural(test, depth + i + 1, "if")
            self.many(ast.iter_child_nodes(x), depth + 1)
        elif isinstance(x, (*_FUNCTION, ast.Lambda)):
            self.many(ast.iter_child_nodes(x), depth + 1)
        else:
            if isinstance(x, ast.BoolOp):
                self.add(x, 1, f"boolean `{'and' if isinstance(x.op, ast.And) else 'or'}`")
            elif isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute)):
                own = x.func.id if isinstance(x.func, ast.Name) else x.func.attr if isinstance(x.func.value, ast.Name) and x.func.value.id in ("self", "cls") else None
                if own is not None and own == self.name:
                    self.add(x, 1, "recursion")
            self.many(ast.iter_child_nodes(x), depth)


def cognitive(node: ast.AST) -> tuple[int, list[str]]:
    """F10. A function that holds one function and returns it (a decorator) doesn't nest what is inside."""
    c = _Cognitive(getattr(node, "name", None))
    body = node.body if isinstance(node.body, list) else [node.body]
    real = [x for x in body if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant))]
    if len(real) == 2 and isinstance(real[0], _FUNCTION) and isinstance(real[1], ast.Return) and isinstance(real[1].value, ast.Name) and real[1].value.id == real[0].name:
        score, trail = cognitive(real[0])
        return score, trail
    c.many(body, 0)
    return c.score, c.trail


def nesting(node: ast.AST, depth: int = 0) -> int:
    """deepest nesting of control structures; an elif chain is one level."""
    best = depth
    for x in ast.iter_child_nodes(node):
        if isinstance(x, _NESTED):
            continue
        deeper = isinstance(x, (ast.If, *_LOOPS, ast.ExceptHandler, ast.Match, ast.With, ast.AsyncWith))
        chain = isinstance(node, ast.If) and isinstance(x, ast.If) and node.orelse == [x] and x.col_offset == node.col_offset
        best = max(best, nesting(x, depth + (deeper and not chain)))
    return best


def line_counts(text: str) -> dict[str, int]:
    """lines, code, comment (docstrings too), blank and logical lines."""
    code, comment, logical = set(), set(), 0
    fresh = True
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        span = set(range(t.start[0], t.end[0] + 1))
        if t.type == tokenize.COMMENT:
            comment |= span
        elif t.type == tokenize.STRING and fresh:
            comment |= span
        elif t.type == tokenize.NEWLINE:
            logical, fresh = logical + 1, True
        elif t.type not in (tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
            code |= span
            fresh = False
    n = len(text.splitlines())
    return {"lines": n, "sloc": len(code), "cloc": len(comment - code), "blank": n - len(code | comment), "lloc": logical}


def norm_tokens(text: str) -> Iterator[tuple[str, int]]:
    """Tokens without comments, layout and closing delimiters; names are ``$ID``, literals ``$LIT``."""
    import keyword

    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type in (tokenize.STRING, tokenize.NUMBER) or t.string in ("True", "False", "None", "..."):
            yield "$LIT", t.start[0]
        elif t.type == tokenize.NAME:
            yield t.string if keyword.iskeyword(t.string) else "$ID", t.start[0]
        elif t.type == tokenize.OP and t.string not in (")", "]", "}"):
            yield t.string, t.start[0]


def imports(tree: ast.AST) -> list[tuple[int, str, str, int, list[str], bool]]:
    """F32: (line, module, kind, level, names, deferred), by line and module. Imports inside functions are deferred."""
    out = []

    def walk(x: ast.AST, deferred: bool) -> None:
        for y in ast.iter_child_nodes(x):
            if isinstance(y, ast.Import):
                out.extend((y.lineno, a.name, "value", 0, [], deferred) for a in y.names)
            elif isinstance(y, ast.ImportFrom):
                names = [a.name for a in y.names]
                out.append((y.lineno, y.module or "", "wildcard" if names == ["*"] else "value", y.level, names, deferred))
            elif isinstance(y, ast.Call) and ast.unparse(y.func) in ("importlib.import_module", "__import__") and y.args and isinstance(y.args[0], ast.Constant):
                out.append((y.lineno, str(y.args[0].value), "dynamic", 0, [], deferred))
            typing_only = isinstance(y, ast.If) and ast.unparse(y.test) in ("TYPE_CHECKING", "typing.TYPE_CHECKING")
            if typing_only:
                out.extend((i.lineno, i.module or "", "type_only", i.level, [a.name for a in i.names], deferred) for i in y.body if isinstance(i, ast.ImportFrom))
                out.extend((i.lineno, a.name, "type_only", 0, [], deferred) for i in y.body if isinstance(i, ast.Import) for a in i.names)
                continue
            walk(y, deferred or isinstance(y, (*_FUNCTION, ast.Lambda)))

    walk(tree, False)
    return sorted(out)


def members(cls: ast.ClassDef) -> list[tuple[str, str, str]]:
    """(method, member, read | write | call) through the receiver of each method that has one."""
    out = set()
    for m in cls.body:
        if not isinstance(m, _FUNCTION) or any(ast.unparse(d) == "staticmethod" for d in m.decorator_list) or not m.args.args:
            continue
        receiver = m.args.args[0].arg
        called = {id(x.func) for x in ast.walk(m) if isinstance(x, ast.Call)}
        for x in ast.walk(m):
            if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == receiver:
                out.add((m.name, x.attr, "call" if id(x) in called else "write" if isinstance(x.ctx, (ast.Store, ast.Del)) else "read"))
    return sorted(out)


def callees(node: ast.AST) -> list[str]:
    """F16: last names of what is called, nested definitions left out."""
    return sorted({x.func.attr if isinstance(x.func, ast.Attribute) else x.func.id for x in _inside(node) if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute))})


def entities(tree: ast.Module, path: str) -> Iterator[tuple[str, str, str, ast.AST]]:
    """(qualified name, kind, name, node) of the module and its definitions."""
    yield path, "module", path, tree
    stack = [(tree, "", False)]
    while stack:
        node, prefix, in_class = stack.pop()
        for x in ast.iter_child_nodes(node):
            if isinstance(x, _NESTED):
                name = f"{prefix}.{x.name}" if prefix else x.name
                yield name, "class" if isinstance(x, ast.ClassDef) else "method" if in_class else "function", x.name, x
                stack.append((x, name, isinstance(x, ast.ClassDef)))
            else:
                stack.append((x, prefix, in_class))


def measure(path: str, text: str) -> Iterator[tuple]:
    """Rows of METRICS for one file."""
    try:
        tree = ast.parse(text)
        counts = line_counts(text)
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
        yield path, path, "module", path, 1, text.count("\n") + 1, "parse_incomplete", 1.0, ["the file does not parse"]
        return
    lines = text.splitlines()
    for name, kind, short, node in entities(tree, path):
        start, end = getattr(node, "lineno", 1), getattr(node, "end_lineno", len(lines))
        row = lambda key, value, why=(): (path, name, kind, short, start, end, key, float(value), list(why))  # noqa: B023, E731
        if kind == "module":
            for key, value in counts.items():
                yield row(key, value)
            continue
        if kind == "class":
            own = [m for m in node.body if isinstance(m, _FUNCTION)]
            yield row("nom", len(own))
            yield row("wmc", sum(map(cyclomatic, own)))
            continue
        score, trail = cognitive(node)
        args = node.args
        given = [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]
        receiver = kind == "method" and bool(args.args) and args.args[0].arg in ("self", "cls")
        yield row("cyclomatic", cyclomatic(node))
        yield row("cognitive", score, trail)
        yield row("params", len(given) - receiver)
        yield row("nesting", nesting(node))
        yield row("exits", sum(isinstance(x, (ast.Return, ast.Raise)) for x in _inside(node)))
        yield row("sloc", sum(bool(x.strip()) and not x.strip().startswith("#") for x in lines[start - 1 : end]))


def scopes(tree: ast.Module) -> tuple[list[tuple], list[tuple]]:
    """scopes ``(scope, parent, kind, name, start, end)`` by number, the module 0, and bindings ``(scope, name, kind, line)``.

    Functions, classes, lambdas and comprehensions open a scope. Kinds of bindings: parameter, receiver (a method's first
    parameter, unless it is static), import, definition, assignment. ``global`` and ``nonlocal`` names bind where they live; a walrus in a
    comprehension binds outside it. The first binding of a name and kind in a scope counts.
    """
    found: list[tuple] = []
    bound: dict[tuple[int, str, str], int] = {}
    moved: dict[tuple[int, str], int] = {}

    def bind(scope: int, name: str, kind: str, line: int) -> None:
        bound.setdefault((moved.get((scope, name), scope), name, kind), line)

    def opened(parent: int | None, kind: str, name: str, node: ast.AST) -> int:
        found.append((len(found), parent, kind, name, getattr(node, "lineno", 1), getattr(node, "end_lineno", None)))
        return len(found) - 1

    def outward(scope: int, name: str, whole: bool) -> int:
        """Where a ``global`` (``whole``) or ``nonlocal`` name lives."""
        while not whole and found[scope][1] is not None:
            scope = found[scope][1]
            if found[scope][2] == "function" and any(k[0] == scope and k[1] == name for k in bound):
                return scope
        return 0

    def names(target: ast.AST) -> Iterator[ast.Name]:
        return (x for x in ast.walk(target) if isinstance(x, ast.Name) and isinstance(x.ctx, (ast.Store, ast.Del)))

    def parameters(node: ast.AST, scope: int, method: bool) -> None:
        args = node.args
        static = any(ast.unparse(d) == "staticmethod" for d in getattr(node, "decorator_list", ()))
        first = [*args.posonlyargs, *args.args][:1] if method and not static else []
        for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]:
            bind(scope, a.arg, "receiver" if a in first else "parameter", a.lineno)

    def visit(node: ast.AST, scope: int) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, _FUNCTION):
                bind(scope, x.name, "definition", x.lineno)
                inner = opened(scope, "function", x.name, x)
                parameters(x, inner, found[scope][2] == "class")
                for outer in [*x.decorator_list, *x.args.defaults, *filter(None, x.args.kw_defaults)]:
                    visit(ast.Expr(outer), scope)
                for y in x.body:
                    visit(ast.Module([y], []), inner)
                continue
            if isinstance(x, ast.ClassDef):
                bind(scope, x.name, "definition", x.lineno)
                inner = opened(scope, "class", x.name, x)
                for outer in [*x.decorator_list, *x.bases, *(k.value for k in x.keywords)]:
                    visit(ast.Expr(outer), scope)
                for y in x.body:
                    visit(ast.Module([y], []), inner)
                continue
            if isinstance(x, ast.Lambda):
                inner = opened(scope, "lambda", "", x)
                parameters(x, inner, False)
                visit(ast.Expr(x.body), inner)
                continue
            if isinstance(x, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
                inner = opened(scope, "comprehension", "", x)
                for g in x.generators:
                    for n in names(g.target):
                        bind(inner, n.id, "assignment", n.lineno)
                visit(x, inner)
                continue
            if isinstance(x, (ast.Global, ast.Nonlocal)):
                for name in x.names:
                    moved[scope, name] = outward(scope, name, isinstance(x, ast.Global))
            elif isinstance(x, (ast.Import, ast.ImportFrom)):
                for a in x.names:
                    if a.name != "*":
                        bind(scope, a.asname or (a.name.split(".")[0] if isinstance(x, ast.Import) else a.name), "import", x.lineno)
            elif isinstance(x, ast.NamedExpr):
                home = scope
                while found[home][2] == "comprehension":
                    home = found[home][1]
                bind(home, x.target.id, "assignment", x.lineno)
            elif isinstance(x, (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.For, ast.AsyncFor, ast.Delete)):
                for target in x.targets if isinstance(x, (ast.Assign, ast.Delete)) else [x.target]:
                    for n in names(target):
                        bind(scope, n.id, "assignment", n.lineno)
            elif isinstance(x, ast.withitem) and x.optional_vars is not None:
                for n in names(x.optional_vars):
                    bind(scope, n.id, "assignment", n.lineno)
            elif isinstance(x, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and x.name:
                bind(scope, x.name, "assignment", x.lineno)
            elif isinstance(x, ast.MatchMapping) and x.rest:
                bind(scope, x.rest, "assignment", x.lineno)
            visit(x, scope)

    opened(None, "module", "", tree)
    visit(tree, 0)
    return found, sorted((*k, line) for k, line in bound.items())


def _mapped(files: DataFrame, make: Callable[[str, str], Iterable[tuple]], schema: str) -> DataFrame:
    """``make(path, text)``'s rows of every file that parses, a file at a time on the workers; others, and null texts, have none."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    rows = list(make(path, text)) if text is not None else []
                except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
                    rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path", "text").mapInArrow(run, schema)


def import_rows(files: DataFrame) -> DataFrame:
    """F32: (path, line, specifier, kind, level, names, deferred)."""
    return _mapped(files, lambda path, text: [(path, *row) for row in imports(ast.parse(text))], "path string, line int, specifier string, kind string, level int, names array<string>, deferred boolean")


def member_rows(files: DataFrame) -> DataFrame:
    """(path, cls, method, member, access) of all classes, nested ones by qualified name; methods without any access have null members."""

    def make(path: str, text: str) -> Iterator[tuple]:
        for name, kind, _, node in entities(ast.parse(text), path):
            if kind == "class":
                touched = members(node)
                yield from ((path, name, *row) for row in touched)
                idle = {m.name for m in node.body if isinstance(m, _FUNCTION)} - {m for m, *_ in touched}
                yield from ((path, name, m, None, None) for m in sorted(idle))

    return _mapped(files, make, "path string, cls string, method string, member string, access string")


def call_rows(files: DataFrame) -> DataFrame:
    """F16: (path, entity, callee) of functions and methods."""
    return _mapped(files, lambda path, text: [(path, name, c) for name, kind, _, node in entities(ast.parse(text), path) if kind in ("function", "method") for c in callees(node)], "path string, entity string, callee string")


def token_rows(files: DataFrame) -> DataFrame:
    """(path, pos, norm, line), as ``clone_classes`` takes them."""
    return _mapped(files, lambda path, text: [(path, i, t, line) for i, (t, line) in enumerate(norm_tokens(text))], "path string, pos int, norm string, line int")


def scope_rows(files: DataFrame) -> DataFrame:
    """(path, scope, parent, kind, name, start, end)."""
    return _mapped(files, lambda path, text: [(path, *row) for row in scopes(ast.parse(text))[0]], "path string, scope int, parent int, kind string, name string, start int, end int")


def binding_rows(files: DataFrame) -> DataFrame:
    """(path, scope, name, kind, line)."""
    return _mapped(files, lambda path, text: [(path, *row) for row in scopes(ast.parse(text))[1]], "path string, scope int, name string, kind string, line int")


def measure_files(files: DataFrame) -> DataFrame:
    """``files(path, text)`` to METRICS rows, a file at a time on the workers."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(METRICS))

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = list(measure(path, text or ""))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "text").mapInArrow(run, METRICS)
