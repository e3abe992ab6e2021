"""Terraform definitions and their dependencies, from a tokenizer and a brace matcher."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ...functions.columns import META_ROOTS
from .base import Source

_TOKEN = re.compile(
    rb"""(?P<space>[ \t\r\f]+)|(?P<line>\n)|(?P<comment>\#[^\n]*|//[^\n]*|/\*.*?\*/)|(?P<heredoc><<[-~]?(?P<tag>[A-Za-z_]\w*)\r?\n)
    |(?P<word>[A-Za-z_\x80-\xff][\w\x80-\xff-]*)|(?P<number>\d[\w.]*)|(?P<quote>")|(?P<mark>==|!=|<=|>=|&&|\|\||=>|\.\.\.|.)""",
    re.X | re.S,
)
_LITERALS = {"true", "false", "null", "for", "in", "if", "else", "endif", "endfor"}


@dataclass
class Token:
    kind: str  # word, number, string, mark, line
    text: str
    start: int
    end: int
    inner: list[Token] = field(default_factory=list)  # of a template: the tokens of its interpolations


def _template(data: bytes, at: int, close: bytes | None, end: int) -> tuple[int, list[Token]]:
    """Read a template's text up to its end; collect the tokens inside ${ } and %{ }."""
    inner: list[Token] = []
    while at < end:
        if close and data[at : at + 1] == b"\\":
            at += 2
        elif close and data[at : at + 1] == close:
            return at + 1, inner
        elif data[at : at + 3] in (b"$${", b"%%{"):
            at += 3
        elif data[at : at + 2] in (b"${", b"%{"):
            tokens, at = tokenize(data, at + 2, end, nested=True)
            inner += [*tokens, Token("line", "\n", at, at)]
        else:
            at += 1
    return end, inner


def tokenize(data: bytes, at: int = 0, end: int | None = None, nested: bool = False) -> tuple[list[Token], int]:
    """Tokens from ``at`` on; a nested run ends at its closing brace."""
    end, out, depth = len(data) if end is None else end, [], 0
    while at < end and (m := _TOKEN.match(data, at, end)):
        kind, start, at = m.lastgroup if m.lastgroup != "tag" else "heredoc", m.start(), m.end()
        if m["heredoc"]:
            kind = "heredoc"
        if kind in ("space", "comment"):
            continue
        if kind == "quote":
            at, inner = _template(data, at, b'"', end)
            out.append(Token("string", data[start + 1 : at - 1].decode("utf-8", "replace"), start, at, inner))
        elif kind == "heredoc":
            stop = re.compile(rb"^[ \t]*" + re.escape(m["tag"]) + rb"[ \t]*\r?$", re.M).search(data, at, end)
            upto = stop.start() if stop else end
            _, inner = _template(data, at, None, upto)
            at = stop.end() if stop else end
            out.append(Token("string", data[start:at].decode("utf-8", "replace"), start, at, inner))
        else:
            text = m[0].decode("utf-8", "replace")
            if nested and kind == "mark":
                depth += (text == "{") - (text == "}")
                if depth < 0:
                    return out, at
            out.append(Token(kind, text, start, at))
    return out, at


def references(tokens: list[Token]) -> set[str]:
    """Addresses of the definitions that an expression or a body refers to."""
    found: set[str] = set()
    for i, t in enumerate(tokens):
        found |= references(t.inner)
        if t.kind != "word" or t.text in _LITERALS or (i and tokens[i - 1].text == "."):
            continue
        path, k = [t.text], i + 1
        while k + 1 < len(tokens) and tokens[k].text == "." and tokens[k + 1].kind == "word":
            path.append(tokens[k + 1].text)
            k += 2
        if k < len(tokens) and tokens[k].text == "(":
            continue
        root, n = path[0], len(path)
        if root in META_ROOTS:
            continue
        if root == "data" and n >= 3:
            found.add(".".join(path[:3]))
        elif n >= 2:
            found.add(".".join(path[:2]))
    return found


def _attributes(body: list[Token]) -> list[tuple[str, list[Token], Token, Token]]:
    """(name, value's tokens, first token, last token) of each attribute directly in a body."""
    out, i = [], 0
    while i < len(body):
        if body[i].kind == "word" and i + 1 < len(body) and body[i + 1].text == "=":
            k, depth = i + 2, 0
            while k < len(body) and not (depth == 0 and body[k].kind == "line"):
                depth += (body[k].text in ("{", "[", "(") and body[k].kind == "mark") - (body[k].text in ("}", "]", ")") and body[k].kind == "mark")
                k += 1
            out.append((body[i].text, body[i + 2 : k], body[i], body[max(i + 1, k - 1)]))
            i = k
        elif body[i].text == "{" and body[i].kind == "mark":
            i = _closing(body, i) + 1
        else:
            i += 1
    return out


def _closing(tokens: list[Token], at: int) -> int:
    depth = 0
    for k in range(at, len(tokens)):
        if tokens[k].kind == "mark":
            depth += (tokens[k].text == "{") - (tokens[k].text == "}")
            if depth == 0:
                return k
    return len(tokens) - 1


def _define(file: Source, key: str, name: str, type_: str, relation: str, address: str | None, span: tuple, body: list[Token], **metadata: object) -> None:
    known = {**metadata, **({"tf_address": address} if address else {})}
    id_ = file.symbol(file.id(key), name, type_, span, **known)
    file.relate(file.file, id_, relation, span, columns=False)
    for target in sorted(references(body) - {address}):
        file.relate(id_, f"tfaddr:{target}", "DEPENDS_ON", span, 0.9, columns=False, reference=target)


def _blocks(source: Source, tokens: list[Token]) -> None:
    i = 0
    while i < len(tokens):
        if tokens[i].kind != "word":
            i += 1
            continue
        k = i + 1
        while k < len(tokens) and tokens[k].kind in ("string", "word"):
            k += 1
        if k >= len(tokens) or tokens[k].text != "{" or tokens[k].kind != "mark":
            i += 1
            continue
        close = _closing(tokens, k)
        kind, labels, body = tokens[i].text, [t.text for t in tokens[i + 1 : k] if t.kind == "string"], tokens[k + 1 : close]
        span = source.span(tokens[i].start, tokens[close].end)
        if kind in ("resource", "data") and len(labels) >= 2:
            address = f"{labels[0]}.{labels[1]}"
            _define(source, f"tf:{kind}:{address}", labels[1], "resource", "CREATES", address if kind == "resource" else f"data.{address}", span, body, tf_kind=kind, resource_type=labels[0])
        elif kind == "variable" and labels:
            _define(source, f"tf:var:{labels[0]}", labels[0], "variable", "DEFINES", f"var.{labels[0]}", span, body, tf_kind=kind)
        elif kind == "output" and labels:
            _define(source, f"tf:output:{labels[0]}", labels[0], "variable", "DEFINES", None, span, body, tf_kind=kind)
        elif kind == "module" and labels:
            value = next((v for name, v, *_ in _attributes(body) if name == "source"), [])
            text = source.data[value[0].start : value[-1].end].decode("utf-8", "replace").strip('"') if value else None
            _define(source, f"tf:module:{labels[0]}", labels[0], "module", "CREATES", f"module.{labels[0]}", span, body, tf_kind=kind, source=text)
        elif kind == "provider" and labels:
            _define(source, f"tf:provider:{labels[0]}", labels[0], "resource", "CREATES", None, span, body, tf_kind=kind)
        elif kind == "locals":
            for name, value, first, last in _attributes(body):
                _define(source, f"tf:local:{name}", name, "variable", "DEFINES", f"local.{name}", source.span(first.start, last.end), value, tf_kind="local")
        _blocks(source, body)
        i = close + 1


def parse_hcl(source: Source, strict: bool = False) -> None:
    """Fill in a Terraform file's definitions, what creates or defines them, and what they depend on."""
    _blocks(source, tokenize(source.data)[0])
