"""Regular expressions: what they can't do without, and how Java reads them.

The search language has no look-around and no back-references. Java and Python read what is left alike, but for a few spellings.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as parser

LEAST = 3
_FORBIDDEN = {C.ASSERT, C.ASSERT_NOT, C.GROUPREF, C.GROUPREF_EXISTS}


def parsed(pattern: str) -> parser.SubPattern:
    """The syntax tree; ValueError where the language doesn't have the pattern."""
    try:
        tree = parser.parse(re.sub(r"\\z$", r"\\Z", pattern))
    except (re.error, OverflowError) as e:
        raise ValueError(f"invalid regular expression {pattern!r}: {e}") from None

    def walk(node: object) -> None:
        if isinstance(node, parser.SubPattern):
            for op, av in node:
                if op in _FORBIDDEN:
                    raise ValueError(f"look-around and back-references are not supported: {pattern!r}")
                walk(av)
        elif isinstance(node, (list, tuple)):
            for x in node:
                walk(x)

    walk(tree)
    return tree


def java(pattern: str) -> str:
    """The pattern for Java, with classes in the sense of Unicode."""
    parsed(pattern)
    pattern = pattern.replace("(?P<", "(?<")
    return "(?U)" + re.sub(r"^\(\?([a-zA-Z]*)i([a-zA-Z]*)\)", r"(?\1iu\2)", pattern)


def _required(tree: parser.SubPattern) -> tuple[list[list[str]], str | None]:
    """(alternatives that each match needs one of, for some places; the text if the pattern is nothing but it)."""
    needs: list[list[str]] = []
    run, whole = "", True

    def close() -> None:
        nonlocal run
        if len(run.encode()) >= LEAST:
            needs.append([run])
        run = ""

    for op, av in tree:
        if op is C.LITERAL:
            run += chr(av)
            continue
        if op is C.AT:
            continue  # takes no text
        inner, text = [], None
        if op is C.SUBPATTERN:
            inner, text = _required(av[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and av[0] > 0:
            inner, text = _required(av[2])
            text = text * av[0] if text is not None and av[0] == av[1] and av[0] < 100 else None
        elif op is C.ATOMIC_GROUP:
            inner, text = _required(av)
        elif op is C.BRANCH:
            whole = False
            close()
            found = []
            for branch in av[1]:
                some, text = _required(branch)
                if text is not None and len(text.encode()) >= LEAST:
                    some = [[text]]
                if not some:
                    found = []
                    break
                found += max(some, key=_worth)
            if found:
                needs.append(found)
            continue
        if text is not None:
            run += text
            continue
        whole = False
        close()
        needs += inner
    text = run if whole else None
    if not whole:
        close()
    return needs, text


def _worth(alternatives: list[str]) -> tuple[int, int]:
    return min(len(x.encode()) for x in alternatives), -len(alternatives)


def literals(pattern: str) -> list[str]:
    """Texts, in lower case, of which every match has one; none where no such texts of three bytes are known."""
    needs, text = _required(parsed(pattern))
    if text is not None and len(text.encode()) >= LEAST:
        needs.append([text])
    if not needs:
        return []
    # Where case is ignored, letters beyond ASCII may stand for others: only ASCII is relied on.
    best = max(needs, key=_worth)
    if parsed(pattern).state.flags & re.IGNORECASE or "(?i" in pattern:
        best = [max(re.findall(r"[\x00-\x7f]+", re.sub("[kKsS]", "K", x)) or [""], key=len) for x in best]
        if any(len(x) < LEAST for x in best):
            return []
    return sorted({x.lower() for x in best})
