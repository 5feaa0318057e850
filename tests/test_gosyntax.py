import pytest

from churnscope.gosyntax import SyntaxProblem, analyze, tokenize
from churnscope.sources.parsers import GoParser, parse_file


def source(body):
    return "package p\n\nfunc f(a, b bool, n int) int {\n" + body + "\n\treturn 0\n}\n"


@pytest.mark.parametrize(("body", "expected"), [
    ("if a { n++ }", 1), ("if a { if b { n++ } }", 3), ("for i := 0; i < n; i++ { n-- }", 1),
    ("switch n {\ncase 1:\n n++\ndefault:\n n--\n}", 5), ("select {\ncase <-c:\n n++\ndefault:\n n--\n}", 5),
    ("if a && b { n++ }", 2), ("for { break }", 2), ("for { continue }", 2), ("goto done\ndone:\n", 1),
    ("if a && b && c { }", 3), ("if a { } else if b { } else { }", 3), ("x := (a && b) == c", 2), ("x := g(a && b, c || d)", 2),
    ("g := func() bool { if a { return b && c }; return a }", 2), ("v := T{x: b && c}\nif v.x { }", 2),
    ("// if a && b\ns := \"if\"\nr := `for {`", 0),
])
def test_complexity(body, expected):
    facts = analyze(source(body))
    assert (facts.total, facts.problem) == (expected, None)


def test_symbols_and_imports():
    f = analyze('package p\nimport (\n\t"fmt"\n\tm "math"\n)\ntype S struct{ a int }\ntype (\n\tI interface{ M() }\n\tA = S\n\tK int\n)\nfunc (s *S) M() {}\nfunc F() {}\n')
    assert (f.functions, f.methods, f.imports) == (["F"], ["M"], ["fmt", "math"])
    assert f.types == [("S", "struct"), ("I", "interface"), ("K", "type")]


def test_problems_are_notes():
    assert analyze("package p\nfunc f() {").problem
    row = parse_file("a.go", b"package p\n\xff", False, [GoParser()])
    assert row["diagnostics"][0]["code"] == "invalid_utf8" and row["complexity"] == 0
    assert parse_file("a.go", b"x", True, [GoParser()])["diagnostics"][0]["code"] == "truncated_source"
    assert parse_file("a.rs", b"x", False, [GoParser()])["parser_status"] == "unsupported"


def test_newlines_end_statements_after_operands_only():
    kinds = [x for _, x in tokenize("x\n+ 1 // c\n/* a\nb */return\nfunc (\n)\n.5e+3 /* q */\n")]
    assert kinds == ["x", ";", "+", "1", ";", "return", ";", "func", "(", ")", ";", ".5e+3", ";"]
    with pytest.raises(SyntaxProblem, match="unreadable text at 4"):
        tokenize("a \t\r#")


def test_sources_of_one_small_file_are_parsed_in_several_tasks(spark):
    from churnscope.plans import made_queries  # noqa: F401
    from churnscope.plans.queries import QUERIES

    for name in ("go_structure", "parser_guards"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2
