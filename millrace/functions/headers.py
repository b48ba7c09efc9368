"""Headers of Java-like methods in linear time.

A header is modifiers and white space (at least one), a type, white space, a name and a list in parentheses. Written as
one regular expression, its first parts overlap, and a long run of blanks takes time of a high power. Here each opening
parenthesis is looked at once: the name in front of it is read off, and the part before the name is walked backwards with all
readings at once (white space, type, modifiers). Every place is in one walk only, so the work follows the text's length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

#: Modifiers that may stand before a method and before the target of a test, and what a type holds beside word characters.
METHOD_MODIFIERS = ("public", "private", "protected", "static", "final", "synchronized")
TARGET_MODIFIERS = ("public", "private", "protected", "static")
TYPE_MARKS = frozenset("<>[], ?")


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _start(text: str, low: int, name: int, modifiers: Sequence[str]) -> int | None:
    """The first place from ``low`` on from which the text up to the name reads as modifiers, type and white space."""
    n, longest = name - low, max(map(len, modifiers))
    # whether the text from a place to the name reads as white space; as type, white space; as modifiers, type, white space
    gap, kind, lead = bytearray(n + 1), bytearray(n + 1), bytearray(n + 1)
    best, alive = None, n
    for i in range(n - 1, -1, -1):
        c = text[low + i]
        if c.isspace():
            gap[i] = i + 1 == n or gap[i + 1]
            lead[i] = lead[i + 1] or kind[i + 1]
        elif any(c == m[0] and i + len(m) < n and text.startswith(m, low + i) and (lead[i + len(m)] or kind[i + len(m)]) for m in modifiers):
            lead[i] = 1
        if _word(c) or c in TYPE_MARKS:
            kind[i] = kind[i + 1] or gap[i + 1]
        if lead[i]:
            best = low + i
        if gap[i] or kind[i] or lead[i]:
            alive = i
        elif alive - i > longest:
            break
    return best


def headers(text: str, modifiers: Sequence[str] = METHOD_MODIFIERS, body: bool = True) -> Iterator[tuple[int, str, str]]:
    """(start, name, what stands in the parentheses) of each header, in order and apart; with ``body`` a brace must follow."""
    low, at, close, opened = 0, text.find("("), -1, -1
    while at >= 0:
        if body and close <= at:
            close = text.find(")", at + 1)
            if close < 0:
                return
            opened = close + 1
            while opened < len(text) and text[opened].isspace():
                opened += 1
        end = at
        while end > low and text[end - 1].isspace():
            end -= 1
        name = end
        while name > low and _word(text[name - 1]):
            name -= 1
        start = None
        if low < name < end and text[name - 1].isspace() and (not body or text.startswith("{", opened)):
            start = _start(text, low, name, modifiers)
        low = at + 1
        if start is not None:
            yield start, text[name:end], text[at + 1 : close] if body else ""
            low = opened + 1 if body else low
        at = text.find("(", low)


def first_name(text: str | None, modifiers: Sequence[str] = TARGET_MODIFIERS) -> str | None:
    """The name of the first header, whether a body follows or not."""
    return next((name for _, name, _ in headers(text or "", modifiers, body=False)), None)


def methods(text: str | None) -> list[tuple[int, int]]:
    """(parameters, lines) of each method: from its header to the brace that closes it, one line where none does."""
    text = text or ""
    found = list(headers(text))
    if not found:
        return []
    braces = [k for k, c in enumerate(text) if c in "{}"]
    depth, after, closing = 0, [], {}
    for k, at in enumerate(braces):
        depth += 1 if text[at] == "{" else -1
        after.append(depth)
        if text[at] == "}":
            closing.setdefault(depth, []).append(k)
    out = []
    for start, _, inside in found:
        first = bisect_left(braces, start)
        same = closing.get(after[first - 1] if first else 0, [])
        k = bisect_left(same, first)
        lines = text.count("\n", start, braces[same[k]]) + 1 if k < len(same) else 1
        out.append((sum(1 for p in inside.split(",") if p.strip()), max(1, lines)))
    return out
