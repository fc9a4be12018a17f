"""Measures from syntax nodes: one function, written in four grammars, scores alike."""

from __future__ import annotations

from graphloom.parse import syntax as X


def rows(path, tree):
    """Nested ``(kind, child...)`` to node rows; a child is a tree, ``(field, tree)`` or a string, an unnamed leaf. Lines follow the leaves."""
    out, line = [], [0]

    def add(node, parent, pos, field):
        if isinstance(node, str):
            out.append((path, len(out), parent, pos, node, field, False, node, 0, 0, line[0] + 1, line[0] + 1))
            return
        kind, *below = node
        own = len(out)
        out.append(None)
        first = line[0] + 1
        text = None
        if len(below) == 1 and isinstance(below[0], str) and ("identifier" in kind or "literal" in kind or "comment" in kind or "name" in kind or "label" in kind):
            text, below = below[0], []
        if kind.endswith(("statement", "comment", "expression_statement")):
            line[0] += 1
        for i, child in enumerate(below):
            named = isinstance(child, tuple) and len(child) == 2 and child[0].startswith("@")
            add(child[1] if named else child, own, i, child[0][1:] if named else None)
        out[own] = (path, own, parent, pos, kind, field, True, text, 0, 0, first, max(first, line[0]))

    add(tree, None, 0, None)
    return out


ID = lambda x, kind="identifier": (kind, x)


def both(a, sign, b, kind="binary_expression"):
    return (kind, ("@left", a), ("@operator", sign), ("@right", b))


COND = both(both(ID("a"), "&&", ID("b")), "||", ("parenthesized_expression", "(", both(ID("c"), "&&", ID("d")), ")"))


def go():
    inner = ("if_statement", ("@condition", ID("x")), ("@consequence", ("block", ("return_statement", "return"))))
    chain = ("if_statement", ("@condition", COND), ("@consequence", ("block", ("for_statement", "for", ("block", inner)))), ("@alternative", ("if_statement", ("@condition", ID("y")), ("@consequence", ("block",)), ("@alternative", ("block", ("continue_statement", "continue", ("label_name", "out")))))))
    call = ("expression_statement", ("call_expression", ("@function", ID("f")), ("argument_list", "(", ID("a"), ")")))
    params = ("parameter_list", "(", ("parameter_declaration", ID("a")), ",", ("parameter_declaration", ID("b")), ")")
    return ("source_file", ("comment", "// c"), ("function_declaration", "func", ("@name", ID("f")), ("@parameters", params), ("@body", ("block", chain, call))))


def rust():
    inner = ("if_expression", ("@condition", ID("x")), ("@consequence", ("block", ("return_expression", "return"))))
    last = ("else_clause", "else", ("block", ("continue_expression", "continue", ("label", "'out"))))
    chain = ("if_expression", ("@condition", COND), ("@consequence", ("block", ("for_expression", "for", ("block", inner)))), ("@alternative", ("else_clause", "else", ("if_expression", ("@condition", ID("y")), ("@consequence", ("block",)), ("@alternative", last)))))
    call = ("expression_statement", ("call_expression", ("@function", ID("f")), ("arguments", "(", ID("a"), ")")))
    params = ("parameters", "(", ("self_parameter", "self"), ("parameter", ID("a")), ",", ("parameter", ID("b")), ")")
    match = ("match_expression", ("match_block", ("match_arm", ID("p")), ("match_arm", ID("q")), ("match_arm", "_")))
    return ("source_file", ("impl_item", ("@type", ID("K", "type_identifier")), ("declaration_list", ("function_item", "fn", ("@name", ID("f")), ("@parameters", params), ("@body", ("block", chain, call))), ("function_item", "fn", ("@name", ID("g")), ("@body", ("block", match))))))


def frame(spark, data):
    return spark.createDataFrame(data, X.NODES)


def test_measures_in_two_styles(spark):
    got = {}
    for name, tree in (("go", go()), ("rust", rust())):
        for r in X.measure_trees(frame(spark, rows(f"a.{name}", tree)), X.GRAMMARS[name]).collect():
            got[name, r.name, r.metric_key] = (r.value, r.kind)
    # if +1, three runs of operators, for +2, inner if +3, else if +1, else +1, labelled jump +1, recursion +1
    want = {"cognitive": 13.0, "cyclomatic": 8.0, "nesting": 3.0, "params": 2.0}
    for key, value in want.items():
        assert got["go", "f", key] == (value, "function") and got["rust", "f", key] == (value, "method"), key
    assert got["go", "f", "exits"][0] == 1 and got["rust", "f", "exits"][0] == 1
    assert got["rust", "g", "cyclomatic"][0] == 3 and got["rust", "K", "nom"][0] == 2 and got["rust", "K", "wmc"][0] == 11
    assert got["go", "a.go", "cloc"][0] == 1


def test_tokens_and_calls(spark):
    nodes = frame(spark, rows("a.go", go()))
    calls = [(r.entity, r.callee) for r in X.call_rows(nodes, X.GRAMMARS["go"]).collect()]
    assert calls == [("f", "f")]
    norm = [r.norm for r in X.token_rows(nodes, X.GRAMMARS["go"]).orderBy("pos").collect()]
    assert norm[:8] == ["func", "$ID", "(", "$ID", ",", "$ID", "$ID", "&&"] and "// c" not in norm and ")" not in norm


def test_catch_all_lambdas_and_nested_functions(spark):
    labels = [("switch_label", "case", ID("x")), ("switch_label", "default")]
    body = ("block", ("switch_statement", ("switch_block", *labels)), ("expression_statement", ("lambda_expression", ("block", ("if_statement", ("@condition", ID("z")))))))
    nested = ("class_declaration", ("@name", ID("B")), ("class_body", ("method_declaration", ("@name", ID("m")), ("@parameters", ("formal_parameters",)), ("@body", body))))
    data = rows("B.java", ("program", nested)) + rows("empty.java", ("program",))
    got = {(r.path, r.name, r.metric_key): r.value for r in X.measure_trees(frame(spark, data), X.GRAMMARS["java"]).collect()}
    assert got["B.java", "m", "cyclomatic"] == 2 and got["B.java", "m", "cognitive"] == 3 and got["B.java", "B", "wmc"] == 2
    assert got["empty.java", "empty.java", "sloc"] == 0 and X.measure_trees(frame(spark, []), X.GRAMMARS["java"]).count() == 0
