"""Types, functions, methods, imports and calls of Go files, from a tokenizer."""

from __future__ import annotations

import re

from .base import Source

_TOKEN = re.compile(
    rb"""(?P<space>[ \t\r\f]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|`[^`]*`)|(?P<rune>'(?:\\.|[^'\\\n])+')
    |(?P<word>[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<number>\d[\w.]*)|(?P<mark>:=|\.\.\.|.)""",
    re.X | re.S,
)
_KEYWORDS = {"if", "for", "switch", "select", "return", "go", "defer", "func", "case", "range", "else", "struct", "interface", "map", "chan", "type", "var", "const", "package", "import"}
_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}


class _Go:
    def __init__(self, source: Source):
        self.s = source
        self.tokens: list[tuple[str, str, int, int]] = []
        at = 0
        while m := _TOKEN.match(source.data, at):
            at = m.end()
            if m.lastgroup not in ("space", "comment"):
                self.tokens.append((m.lastgroup, m[0].decode("utf-8", "replace"), m.start(), at))
        self.imports: dict[str, tuple[str, tuple]] = {}  # path: local name, span
        self.defined: dict[str, str] = {}
        self.calls: list[tuple[str, str, tuple]] = []

    def text(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def span(self, i: int, k: int) -> tuple[int, int, int, int]:
        return self.s.span(self.tokens[i][2], self.tokens[min(k, len(self.tokens) - 1)][3])

    def close(self, i: int) -> int:
        """The token that closes the bracket at i."""
        depth = 0
        for k in range(i, len(self.tokens)):
            if self.kind(k) == "mark":
                depth += (self.text(k) in _OPEN) - (self.text(k) in _CLOSE)
                if depth == 0:
                    return k
        return len(self.tokens) - 1

    def specs(self, i: int) -> list[tuple[int, int]]:
        """First and last tokens of the specs after a keyword at i, grouped or single."""
        if self.text(i + 1) != "(":
            return [(i + 1, self.line_end(i + 1))]
        end, out, k = self.close(i + 1), [], i + 2
        while k < end:
            if self.kind(k) == "line" or self.text(k) == ";":
                k += 1
                continue
            stop = min(self.line_end(k), end - 1)
            out.append((k, stop))
            k = stop + 1
        return out

    def line_end(self, i: int) -> int:
        """The last token of the statement that starts at i."""
        k = i
        while k < len(self.tokens):
            if self.kind(k) == "mark" and self.text(k) in _OPEN:
                k = self.close(k)
            elif self.kind(k) == "line" or self.text(k) == ";":
                return k - 1
            k += 1
        return len(self.tokens) - 1

    def parse(self) -> None:
        i = 0
        while i < len(self.tokens):
            word = self.text(i) if self.kind(i) == "word" else ""
            if word == "import":
                for a, b in self.specs(i):
                    at = next((k for k in range(a, b + 1) if self.kind(k) == "string"), None)
                    if at is not None:
                        path = self.text(at).strip('"`')
                        local = self.text(a) if at > a and self.kind(a) == "word" else path.split("/")[-1]
                        self.imports[path] = (local, self.span(a, b))
                i = (self.close(i + 1) if self.text(i + 1) == "(" else self.line_end(i + 1)) + 1
            elif word == "type":
                for a, b in self.specs(i):
                    if self.kind(a) == "word" and self.text(a + 1) != "=":
                        span = self.span(a, b)
                        self.defined[self.text(a)] = id_ = self.s.symbol(self.s.id(self.text(a)), self.text(a), "class", span)
                        self.s.relate(self.s.file, id_, "DEFINES", span, evidence_type="AST")
                i = (self.close(i + 1) if self.text(i + 1) == "(" else self.line_end(i + 1)) + 1
            elif word == "func":
                i = self.function(i)
            else:
                self.call(i, self.s.file)
                i += 1
        for path, (_, span) in self.imports.items():
            id_ = self.s.symbol(f"module:{path}", path, "module", span)
            self.s.relate(self.s.file, id_, "IMPORTS", span, evidence_type="AST")
        local = {name: path for path, (name, _) in self.imports.items()}
        for caller, text, span in self.calls:
            target = self.resolve(text, local)
            self.s.relate(caller, target, "CALLS", span, 0.5 if target.startswith("unresolved:") else 0.9, evidence_type="AST", callee_name=text)

    def function(self, i: int) -> int:
        """A declaration at a func keyword at the top level; returns where to go on."""
        k, receiver = i + 1, None
        if self.text(k) == "(" and self.kind(self.close(k) + 1) == "word":
            end = self.close(k)
            named = [self.text(x) for x in range(k + 1, end) if self.kind(x) == "word"]
            generic = next((x for x in range(k + 1, end) if self.text(x) == "["), None)
            if generic is not None:
                named = [self.text(x) for x in range(k + 1, generic) if self.kind(x) == "word"]
            receiver, k = named[-1] if named else None, end + 1
        if self.kind(k) != "word":
            return i + 1
        name = self.text(k)
        end = self.line_end(k)
        span = self.span(i, end)
        if receiver:
            owner = self.s.id(receiver)
            id_ = self.s.symbol(self.s.id(name), name, "method", span, owner)
            self.s.relate(self.s.file, id_, "DEFINES", span, evidence_type="AST")
            self.s.relate(owner, id_, "DEFINES", span, evidence_type="AST")
        else:
            self.defined[name] = id_ = self.s.symbol(self.s.id(name), name, "function", span)
            self.s.relate(self.s.file, id_, "DEFINES", span, evidence_type="AST")
        first = self.close(k + 1) + 1 if self.text(k + 1) == "[" else k + 1  # type parameters, then parameters
        for x in range(self.close(first) + 1, end + 1):
            self.call(x, id_)
        return end + 1

    def call(self, i: int, caller: str) -> None:
        """Record a call whose arguments open at i; what is called may itself be a call, an index or a generic."""
        if self.kind(i) != "mark" or self.text(i) != "(":
            return
        first = self.operand(i - 1)
        if first is None or self.text(first - 1) in ("func", "]"):  # a declaration; a conversion to a list or map
            return
        text = self.s.data[self.tokens[first][2] : self.tokens[i - 1][3]].decode("utf-8", "replace")
        self.calls.append((caller, text, self.span(first, self.close(i))))

    def operand(self, k: int) -> int | None:
        """The first token of the operand that ends at k: names, selectors, and brackets behind them; none if it is no operand."""
        while True:
            if self.text(k) in (")", "]") and self.kind(k) == "mark":
                k = self.opening(k) - 1  # arguments, an index or type arguments
                if self.kind(k) != "word" and self.text(k) not in (")", "]"):
                    return None
                continue
            if self.kind(k) != "word" or self.text(k) in _KEYWORDS:
                return None
            if self.text(k - 1) != ".":
                return k
            k -= 2
            if self.kind(k) == "line":  # a chain may break its line only after the dot
                return None

    def opening(self, k: int) -> int:
        """The token that opens the bracket closed at k."""
        depth = 0
        for i in range(k, -1, -1):
            if self.kind(i) == "mark":
                depth += (self.text(i) in _CLOSE) - (self.text(i) in _OPEN)
                if depth == 0:
                    return i
        return 0

    def resolve(self, text: str, local: dict[str, str]) -> str:
        head, _, rest = text.partition(".")
        if not rest:
            if text in self.defined:
                return self.defined[text]
            return f"module:{local[text]}" if text in local else f"unresolved:{text}"
        if head in local:
            return f"module:{local[head]}.{rest}"
        return f"{self.defined[head]}.{rest}" if head in self.defined else f"unresolved:{text}"


def parse_go(source: Source, strict: bool = False) -> None:
    """Fill in a Go file's symbols and relationships."""
    _Go(source).parse()
