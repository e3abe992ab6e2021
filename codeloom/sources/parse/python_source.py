"""Symbols and relationships of Python files, from the standard library's syntax tree."""

from __future__ import annotations

import ast
import posixpath

from .base import Source

#: Confidence of a call or an inheritance whose target was found, and of one whose was not.
FOUND, NOT_FOUND = 0.9, 0.5


def package_of(path: str, level: int) -> list[str]:
    """The package that a relative import of so many dots starts from; empty above the top."""
    parts = [p for p in posixpath.dirname(path).split("/") if p]
    up = level - 1
    return parts[: len(parts) - up] if up <= len(parts) else []


class _Visitor(ast.NodeVisitor):
    def __init__(self, source: Source, strict: bool):
        self.s, self.strict = source, strict
        self.classes: list[str] = []  # qualified names of the enclosing classes
        self.functions: list[str] = []  # ids of the enclosing functions
        self.short_classes: dict[str, str] = {}
        self.short_functions: dict[str, str] = {}
        self.qualified: dict[str, str] = {}
        self.imports: dict[str, tuple] = {}  # module: span of the first statement
        self.bound: dict[str, str] = {}
        self.late: list[tuple] = []  # calls and inheritances, until all names are known

    def span(self, node: ast.AST) -> tuple[int, int, int, int]:
        return node.lineno, node.col_offset, node.end_lineno, node.end_col_offset

    def text(self, node: ast.AST) -> str:
        a = self.s.lines[node.lineno - 1] + node.col_offset
        b = self.s.lines[node.end_lineno - 1] + node.end_col_offset
        return self.s.data[a:b].decode("utf-8", "replace")

    def nested(self, name: str) -> str:
        if self.strict:  # joins the enclosing classes' qualified names, so deep ones repeat
            return ".".join([*self.classes, name])
        return f"{self.classes[-1]}.{name}" if self.classes else name

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for d in node.decorator_list:
            self.visit(d)
        qualified = self.nested(node.name)
        span = self.span(node)
        id_ = self.s.symbol(self.s.id(qualified), node.name, "class", span)
        self.s.relate(self.s.file, id_, "DEFINES", span)
        self.short_classes[node.name] = id_
        self.qualified[qualified] = id_
        for base in [*node.bases, *node.keywords]:
            self.late.append(("INHERITS", id_, self.text(base), None, self.span(base)))
        self.classes.append(qualified)
        for child in [*node.bases, *node.keywords, *node.body]:
            self.visit(child)
        self.classes.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        for d in node.decorator_list:
            self.visit(d)
        owner = self.classes[-1] if self.classes else None
        qualified = f"{owner}.{node.name}" if owner else node.name
        span = self.span(node)
        id_ = self.s.symbol(self.s.id(qualified), node.name, "method" if owner else "function", span, self.s.id(owner) if owner else None)
        self.s.relate(self.s.file, id_, "DEFINES", span)
        if owner:
            self.s.relate(self.s.id(owner), id_, "DEFINES", span)
        self.short_functions[node.name] = id_
        self.qualified[qualified] = id_
        self.functions.append(id_)
        for child in [node.args, *([node.returns] if node.returns else []), *node.body]:
            self.visit(child)
        self.functions.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        caller = self.functions[-1] if self.functions else self.s.file
        self.late.append(("CALLS", caller, self.text(node.func), self.classes[-1] if self.classes else None, self.span(node)))
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            self.imports.setdefault(alias.name, self.span(alias if alias.asname else node))
            if alias.asname:
                self.bound[alias.asname] = alias.name
            else:
                head = alias.name.split(".")[0]
                self.bound[head] = head

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.module == "__future__":
            return
        package = package_of(self.s.path, node.level) if node.level else []
        for alias in node.names:
            if alias.name == "*":
                continue
            if node.module:
                module = ".".join([*package, node.module])
                target = f"{module}.{alias.name}"
            else:
                module = target = ".".join([*package, alias.name])
            self.imports.setdefault(module, self.span(node))
            self.bound[alias.asname or alias.name] = target

    def resolve(self, text: str, owner: str | None) -> str:
        """The target that a name stands for in this file."""
        if not text:
            return "unresolved:"
        head, _, rest = text.partition(".")
        if head in ("self", "cls") and rest and owner:
            for name in (f"{owner}.{rest}", f"{owner}.{rest.split('.')[0]}"):
                if name in self.qualified:
                    return self.qualified[name]
            return f"unresolved:{text}"
        if not rest:
            known = self.short_functions.get(text) or self.short_classes.get(text)  # functions hide classes
            if known:
                return known
            return f"module:{self.bound[text]}" if text in self.bound else f"unresolved:{text}"
        if head in self.bound:
            return f"module:{self.bound[head]}.{rest}"
        return self.qualified.get(text, f"unresolved:{text}")


def parse_python(source: Source, strict: bool = False) -> None:
    """Fill in a Python file's symbols and relationships; a syntax error raises SyntaxError.

    With ``strict`` the qualified names of classes nested three deep repeat their prefixes,
    as the data's first producer wrote them.
    """
    visitor = _Visitor(source, strict)
    visitor.visit(ast.parse(source.data))
    for module, span in visitor.imports.items():
        id_ = source.symbol(f"module:{module}", module, "module", span)
        source.relate(source.file, id_, "IMPORTS", span, evidence_type="AST")
    for kind, origin, text, owner, span in visitor.late:
        target = visitor.resolve(text, owner)
        names = {"callee_name": text} if kind == "CALLS" else {"base_name": text}
        source.relate(origin, target, kind, span, NOT_FOUND if target.startswith("unresolved:") else FOUND, evidence_type="AST", **names)
