"""A small reader of Java source: types, their members and methods, by matching braces outside literals and comments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_HIDDEN = re.compile(r'"""(?s:.*?)"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*|(?s:/\*.*?\*/)')
_TYPE = re.compile(r"(?:\b(?:class|interface|enum|record)|@interface)\s+([A-Za-z_$][\w$]*)")
_NAME = re.compile(r"([A-Za-z_$][\w$]*)\s*$")
_WORDS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "default"}
PAIRS = {"}": "{", ")": "(", "]": "["}


@dataclass
class Method:
    content: str
    class_name: str
    method_name: str
    method_signature: str
    return_type: str
    start_line: int
    end_line: int
    parameter_types: list[str] = field(default_factory=list)
    annotations: list[str] = field(default_factory=list)


@dataclass
class Source:
    package_name: str = ""
    imports: list[str] = field(default_factory=list)
    methods: list[Method] = field(default_factory=list)
    failure: str = ""


def masked(text: str) -> str:
    """The text with literals and comments blanked out, of the same length and lines."""
    return _HIDDEN.sub(lambda m: "".join(c if c == "\n" else " " for c in m.group()), text)


def matches(bare: str) -> dict[int, int] | None:
    """Where each opening brace, bracket and parenthesis closes; None if they don't match."""
    open_, out = [], {}
    for m in re.finditer(r"[{}()\[\]]", bare):
        c = m.group()
        if c in "{([":
            open_.append(m.start())
        elif not open_ or bare[open_[-1]] != PAIRS[c]:
            return None
        else:
            out[open_.pop()] = m.start()
    return None if open_ else out


def _members(bare: str, low: int, high: int, close: dict[int, int]):
    """(start, end of the head, end) of the members between two places; a member ends with ``;`` or its block."""
    at = start = low
    while at < high:
        c = bare[at]
        if c in "([":
            at = close[at] + 1
        elif c == "{":
            head, at = at, close[at] + 1
            if "=" in re.sub(r"\([^)]*\)", "", bare[start:head]):  # an initial value; the member goes on to its semicolon
                continue
            yield start, head, at
            start = at
        elif c == ";":
            yield start, at, at + 1
            at = start = at + 1
        else:
            at += 1


def _parameters(inside: str) -> list[str]:
    """The types of a parameter list."""
    out, depth, cur = [], 0, ""
    for c in inside + ",":
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth <= 0:
            words = re.sub(r"@[\w$.]+(?:\([^)]*\))?|\bfinal\b", "", cur).strip()
            if " " in words:
                out.append(words.rsplit(None, 1)[0].strip())
            cur = ""
        else:
            cur += c
    return out


def _comment_before(text: str, at: int) -> str:
    """The comment lines that end right above a place."""
    lines, out, inside = text[:at].split("\n")[:-1], [], False
    for line in reversed(lines):
        bare = line.strip()
        inside = inside or bare.endswith("*/")
        if not bare or not (inside or bare.startswith(("//", "/*", "*"))):
            break
        out.append(line)
        if bare.startswith("/*"):
            inside = False
    return "\n".join(reversed(out)).strip()


def read(text: str | None) -> Source:
    """Package, imports and the methods and constructors of all types of a compilation unit, each with its declaration context."""
    text = text or ""
    bare = masked(text)
    close = matches(bare)
    if close is None:
        return Source(failure="Braces don't match.")
    package = re.search(r"^\s*(?:@[^\n]*\n\s*)*package\s+([\w$.]+)\s*;", bare)
    out = Source(package.group(1) if package else "", [text[m.start() : m.end()].strip() for m in re.finditer(r"(?m)^\s*import\s+[^;]+;", bare)])
    for t in _TYPE.finditer(bare):
        body = t.end()
        while body < len(bare) and bare[body] not in "{;":
            body = close[body] + 1 if bare[body] in "([" else body + 1
        if body >= len(bare) or bare[body] != "{":
            continue
        first = max(bare.rfind(c, 0, t.start()) for c in ";{}") + 1
        declared = text[first:body].strip()
        low = body + 1
        if re.search(r"\benum\s+$", bare[: t.start(1)]):  # constants come first, up to a semicolon
            end = close[body]
            low = min(next((k for k in _top(bare, low, end, close) if bare[k] == ";"), end) + 1, end)
        fields, found = [], []
        for start, head, end in _members(bare, low, close[body], close):
            start += len(bare[start:head]) - len(bare[start:head].lstrip())
            h = bare[start:head]
            paren = next((k for k in range(start, head) if bare[k] == "(" and _NAME.search(bare[start:k]) and not _annotation(bare, start, k)), None)
            if _TYPE.search(h) and (paren is None or _TYPE.search(h).start() + start < paren):
                continue  # a type of its own
            if paren is None or "=" in bare[start:paren]:
                if bare[end - 1] == ";" and h.strip():
                    fields.append(text[start:end].strip())
                continue
            found.append((start, head, end, paren))
        for start, head, end, paren in found:
            lead = bare[start:paren]
            name = _NAME.search(lead).group(1)
            kind = re.sub(r"@[\w$.]+(?:\([^)]*\))?", " ", lead[: _NAME.search(lead).start()])
            kind = " ".join(w for w in re.sub(r"^(\s|\b(?:" + "|".join(_WORDS) + r")\b)*<[^(]*?>\s", " ", kind).split() if w not in _WORDS)
            comment, whole = _comment_before(text, start), text[start:end].strip()
            parts = [*([text[package.start() : package.end()].strip()] if package else []), *out.imports, declared + " {", *fields, *([comment] if comment else []), whole, "}"]
            row = Method("\n".join(parts), t.group(1), name, text[start:head].strip(), kind, text.count("\n", 0, start) + 1, text.count("\n", 0, end) + 1)
            row.parameter_types, row.annotations = _parameters(text[paren + 1 : close[paren]]), re.findall(r"@[A-Za-z_$][\w$.]*", bare[start:head])
            out.methods.append(row)
    if not out.methods:
        out.failure = "No method or constructor declaration found."
    return out


def _top(bare: str, low: int, high: int, close: dict[int, int]):
    """Places between two others that are in no block or parentheses."""
    at = low
    while at < high:
        yield at
        at = close[at] + 1 if bare[at] in "{([" else at + 1


def _annotation(bare: str, start: int, paren: int) -> bool:
    """Whether a parenthesis belongs to an annotation or stands inside one."""
    return bool(re.search(r"@[\w$.]+\s*$", bare[start:paren])) or bare.count("(", start, paren) > bare.count(")", start, paren)
