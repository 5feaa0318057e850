"""Structure of Go source: symbols, imports and nesting-weighted complexity.

A tokenizer with automatic semicolons, then one walk over statements by keyword and
bracket. Expressions are parsed by precedence, because every binary expression
whose text holds ``&&`` or ``||`` counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Blanks, then one of: word, newline, comment, literal, op; none of them at the end of the text.
_TOKEN = re.compile(
    r"[ \t\r]*(?:([^\W\d]\w*)|(\n)|(//[^\n]*|/\*.*?\*/)"
    r"|(`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'|\.?\d(?:[eEpP][+-]|[\w.])*)"
    r"|(&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!~()\[\]{},;.:])|\Z)",
    re.S)
_WORD, _NEWLINE, _COMMENT, _LITERAL, _OP = 1, 2, 3, 4, 5
_KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = frozenset(("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))
_PRECEDENCE = {op: p for p, ops in ((1, ("||",)), (2, ("&&",)), (3, ("==", "!=", "<", "<=", ">", ">=")), (4, ("+", "-", "|", "^")), (5, ("*", "/", "%", "<<", ">>", "&", "&^"))) for op in ops}
_OPEN = {"(": ")", "[": "]", "{": "}"}


class SyntaxProblem(ValueError):
    pass


@dataclass
class GoFacts:
    functions: list[str] = field(default_factory=list)
    methods: list[str] = field(default_factory=list)
    types: list[tuple[str, str]] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    complexity: list[int] = field(default_factory=list)
    problem: str | None = None

    @property
    def total(self) -> int:
        return sum(self.complexity)

    @property
    def most(self) -> int:
        return max(self.complexity, default=0)


def tokenize(source: str) -> list[tuple[str, str]]:
    """(kind, text) tokens: word, literal, op; newlines become semicolons where Go puts them."""
    out: list[tuple[str, str]] = []
    at, ends, match, add = 0, False, _TOKEN.scanner(source).match, out.append  # ends: a newline here would end a statement
    while m := match():
        kind = m.lastindex
        if kind is None:
            at = m.end()
            break
        text, at = m[kind], m.end()
        if kind == _WORD:
            add(("word", text))
            ends = text not in _KEYWORDS or text in _ENDS
        elif kind == _OP:
            add(("op", text))
            ends = text in _ENDS
        elif kind == _LITERAL:
            add(("literal", text))
            ends = True
        elif ends and (kind == _NEWLINE or "\n" in text):
            add(("op", ";"))
            ends = False
    if at < len(source):
        raise SyntaxProblem(f"unreadable text at {at + len(source[at:]) - len(source[at:].lstrip(' \t\r'))}")
    if ends:
        add(("op", ";"))
    return out


class _Walker:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.t = tokens
        self.words = [text if kind != "literal" else "" for kind, text in tokens] + ["", "", ""]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, (kind, text) in enumerate(tokens):
            if kind == "op" and text in _OPEN:
                stack.append(i)
            elif kind == "op" and text in (")", "]", "}"):
                if not stack or _OPEN[tokens[stack[-1]][1]] != text:
                    raise SyntaxProblem("brackets do not match")
                self.match[stack.pop()] = i
        if stack:
            raise SyntaxProblem("an open bracket is not closed")

    def text(self, i: int) -> str:
        return self.words[i]

    def body_after(self, i: int, end: int) -> int:
        """The place of the ``{`` that opens a statement's body, over brackets and function literals."""
        while i < end:
            if self.text(i) == "func":
                i = self.match[self.function_body(i, end)] + 1
            elif self.text(i) in ("struct", "interface") and self.text(i + 1) == "{":
                i = self.match[i + 1] + 1
            elif self.text(i) == "{":
                return i
            else:
                i = self.match[i] + 1 if i in self.match else i + 1
        raise SyntaxProblem("a body is missing")

    def function_body(self, i: int, end: int) -> int:
        """From ``func``: its body's ``{``, over the signature."""
        i += 1
        while i < end:
            if self.text(i) in ("struct", "interface") and self.text(i + 1) == "{":
                i = self.match[i + 1] + 1
            elif self.text(i) == "{":
                return i
            else:
                i = self.match[i] + 1 if i in self.match else i + 1
        raise SyntaxProblem("a function has no body")

    def statements(self, i: int, end: int, nesting: int) -> int:
        """Complexity of the tokens from ``i`` to ``end``."""
        total, start = 0, i
        while i < end:
            kind, word = self.t[i]
            if kind == "literal" or (kind == "word" and word not in _KEYWORDS):
                i += 1
                continue
            word = word if kind == "word" else ""
            if word in ("if", "for", "switch", "select"):
                total += self.expression(start, i, nesting)
                cost, i = self.control(i, end, nesting)
                total, start = total + cost, i
            elif word in ("break", "continue", "goto"):
                total += 1 + self.expression(start, i, nesting)
                i = start = i + 1
            elif self.text(i) in (";", "{", "}") and self.t[i][0] == "op" and not self.literal_brace(i):
                total += self.expression(start, i, nesting)
                if self.text(i) == "{":
                    total += self.statements(i + 1, self.match[i], nesting)
                    i = self.match[i]
                i = start = i + 1
            elif word == "func":
                i = self.skip_function(i, end)
            else:
                i = self.match[i] + 1 if i in self.match else i + 1
        return total + self.expression(start, end, nesting)

    def literal_brace(self, i: int) -> bool:
        """Whether ``{`` continues an expression: after a type, as in T{...} or struct{...}."""
        return self.text(i) == "{" and i > 0 and (
            self.text(i - 1) in ("]", ")", "struct", "interface") or (self.t[i - 1][0] == "word" and self.t[i - 1][1] not in _KEYWORDS))

    def skip_function(self, i: int, end: int) -> int:
        try:
            return self.match[self.function_body(i, end)] + 1
        except SyntaxProblem:
            return i + 1  # a function type

    def control(self, i: int, end: int, nesting: int) -> tuple[int, int]:
        word, own, inner = self.text(i), 1 + nesting, nesting + 1
        body = self.body_after(i + 1, end)
        close = self.match[body]
        total = own + self.statements(i + 1, body, inner)
        if word in ("switch", "select"):
            return total + self.cases(body + 1, close, inner), close + 1
        total += self.statements(body + 1, close, inner)
        after = close + 1
        if word == "if" and self.text(after) == "else":
            if self.text(after + 1) == "if":
                cost, after = self.control(after + 1, end, inner)
                return total + cost, after
            if self.text(after + 1) == "{":
                return total + self.statements(after + 2, self.match[after + 1], inner), self.match[after + 1] + 1
        return total, after

    def cases(self, i: int, end: int, nesting: int) -> int:
        starts = []
        while i < end:
            if self.t[i][0] == "word" and self.t[i][1] in ("case", "default"):
                starts.append(i)
            i = self.match[i] + 1 if i in self.match else i + 1
        return sum(1 + nesting + self.statements(a + 1, b, nesting + 1) for a, b in zip(starts, [*starts[1:], end]))

    def expression(self, i: int, end: int, nesting: int) -> int:
        """Boolean chains among operands, and what brackets and function literals hold."""
        total, flags, operators, waiting = 0, [], [], True

        def close() -> None:
            nonlocal total
            total += _chains(flags, operators)
            flags.clear()
            operators.clear()

        while i < end:
            kind, text = self.t[i]
            if kind == "op" and text in _PRECEDENCE and not waiting:
                operators.append(text)
                waiting = True
            elif kind == "op" and text in _PRECEDENCE or (kind == "op" and text in ("!", "~", "<-")):
                pass  # unary
            elif kind == "op" and text == ".":
                waiting = False
            elif kind == "op" and text in _OPEN:
                total += self.statements(i + 1, self.match[i], nesting) if text != "{" else self.expression(i + 1, self.match[i], nesting)
                held = any(self.t[k][1] in ("&&", "||") or (self.t[k][0] == "literal" and ("&&" in self.t[k][1] or "||" in self.t[k][1])) for k in range(i, self.match[i]))
                if waiting or not flags:
                    flags.append(held)
                else:
                    flags[-1] = flags[-1] or held
                i, waiting = self.match[i], False
            elif kind == "word" and text == "func":
                try:
                    body = self.function_body(i, end)
                    total += self.statements(body + 1, self.match[body], nesting)
                    held = any(self.t[k][1] in ("&&", "||") for k in range(body, self.match[body]))
                    if waiting:
                        flags.append(held)
                    i, waiting = self.match[body], False
                except SyntaxProblem:
                    pass
            elif kind == "literal" or (kind == "word" and text not in _KEYWORDS) or text in ("map", "chan", "struct", "interface"):
                if waiting:
                    flags.append(kind == "literal" and ("&&" in text or "||" in text))
                waiting = False
            else:
                close()
                waiting = True
            i += 1
        close()
        return total


def _chains(flags: list[bool], operators: list[str]) -> int:
    """How many binary nodes over these operands hold a boolean operator in their text."""
    operators = operators[: max(len(flags) - 1, 0)]
    if not operators or not (any(flags) or any(o in ("&&", "||") for o in operators)):
        return 0
    total, values, pending = 0, [flags[0]], []

    def reduce() -> None:
        nonlocal total
        op, right, left = pending.pop(), values.pop(), values.pop()
        held = left or right or op in ("&&", "||")
        total += held
        values.append(held)

    for op, flag in zip(operators, flags[1:]):
        while pending and _PRECEDENCE[pending[-1]] >= _PRECEDENCE[op]:
            reduce()
        pending.append(op)
        values.append(flag)
    while pending:
        reduce()
    return total


def analyze(source: str) -> GoFacts:
    """Facts of one file; a problem keeps what was found before it."""
    facts = GoFacts()
    try:
        tokens = tokenize(source)
        w = _Walker(tokens)
        i, n = 0, len(tokens)
        while i < n:
            word = w.text(i)
            if word == "func":
                receiver = w.text(i + 1) == "("
                name = w.match[i + 1] + 1 if receiver else i + 1
                (facts.methods if receiver else facts.functions).append(w.text(name))
                try:
                    body = w.function_body(name, next((k for k in _ends(w, name, n)), n))
                except SyntaxProblem:  # declared without a body
                    facts.complexity.append(0)
                    i = name + 1
                    continue
                facts.complexity.append(w.statements(body + 1, w.match[body], 0))
                i = w.match[body] + 1
            elif word in ("import", "type"):
                grouped = w.text(i + 1) == "("
                end = w.match[i + 1] if grouped else next((k for k in _ends(w, i + 1, n)), n)
                for spec in _specs(w, i + 1 + grouped, end):
                    _import(w, spec, facts) if word == "import" else _type(w, spec, facts)
                i = end + 1
            else:
                i = w.match[i] + 1 if i in w.match else i + 1
    except (SyntaxProblem, KeyError, RecursionError) as e:
        facts.problem = str(e) or "the source could not be parsed"
    return facts


def _ends(w: _Walker, i: int, n: int):
    """Places of the semicolons that end declarations, over brackets."""
    while i < n:
        if w.text(i) == ";":
            yield i
        i = w.match[i] + 1 if i in w.match else i + 1


def _specs(w: _Walker, i: int, end: int) -> list[list[int]]:
    specs, now = [], []
    while i < end:
        if w.text(i) == ";":
            specs.append(now)
            now = []
        else:
            now.append(i)
        i = w.match[i] + 1 if i in w.match else i + 1
    return [s for s in [*specs, now] if s]


def _import(w: _Walker, spec: list[int], facts: GoFacts) -> None:
    kind, text = w.t[spec[-1]]
    if kind == "literal":
        facts.imports.append(text.strip("\"`"))


def _type(w: _Walker, spec: list[int], facts: GoFacts) -> None:
    rest = [w.text(k) for k in spec[1:]]
    if "=" in rest[:2]:
        return  # an alias
    kind = next((x for x in rest if x in ("struct", "interface")), "type") if rest and (rest[0] in ("struct", "interface") or (rest[0] == "[" and len(rest) > 1)) else "type"
    facts.types.append((w.text(spec[0]), kind))
