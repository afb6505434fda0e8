"""Paths: stems and extensions, display paths, globs, scopes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import col

BINARY_EXTENSIONS = (
    "7z a avi bin bmp bz2 class dll doc docx dylib eot exe gif gz ico jpeg jpg lib mkv mov mp3 mp4 o otf pdf png "
    "pyc pyo rar so svg tar ttf wav webp woff woff2 xls xlsx xz zip"
).split()


def slashes(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def normalised(path: Column | str) -> Column:
    """For comparisons: slashes, lower case."""
    return F.lower(slashes(path))


def name(path: Column | str) -> Column:
    return F.regexp_extract(slashes(path), r"([^/]*)$", 1)


def stem(path: Column | str) -> Column:
    """The name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    """Without the dot; empty if there is none."""
    return F.regexp_extract(name(path), r"(?<=.)\.([^.]*)$", 1)


def has_binary_extension(path: Column | str, more: Sequence[str] = ()) -> Column:
    return F.lower(extension(path)).isin([*BINARY_EXTENSIONS, *[x.lower().lstrip(".") for x in more]])


def display(path: Column | str, roots: Sequence[str]) -> Column:
    """The path from the first root that holds it, with the root's own name in front; the whole path if none does."""
    p = slashes(path)
    found = []
    for root in roots:
        root = root.replace("\\", "/").rstrip("/")
        shown = root.rpartition("/")[2]
        found.append(F.when(F.startswith(p, F.lit(root + "/")), F.concat(F.lit(shown), F.substring(p, F.lit(len(root) + 1), F.length(p)))))
    return F.coalesce(*found, p)


def in_scope(path: Column | str, roots: Sequence[str]) -> Column:
    """Whether a path begins with one of the roots, whatever the case."""
    p, found = normalised(path), F.lit(False)
    for root in roots:
        found = found | F.startswith(p, F.lit(root.replace("\\", "/").lower()))
    return found


def is_source(path: Column | str) -> Column:
    """Whether a path has a folder src or lib in it."""
    p = col(path)
    parts = ("/src/", "\\src\\", "/lib/", "\\lib\\")
    found = F.contains(p, F.lit(parts[0]))
    for x in parts[1:]:
        found = found | F.contains(p, F.lit(x))
    return found


# Globs


def patterns(text: str | Sequence[str] | None) -> list[str]:
    """A list of patterns, or those of a string with semicolons between them."""
    if not text:
        return []
    return [x.strip() for x in (text.split(";") if isinstance(text, str) else text) if x.strip()]


def glob_regex(pattern: str) -> str:
    """A regular expression that Java and RE2 both read, for whole paths. A star also stands for slashes.

    A pattern that is not absolute holds at any depth.
    """
    p = pattern.replace("\\", "/")
    if not (p.startswith(("/", "**/")) or ":" in p):
        p = "**/" + p
    out, i, depth = [], 0, 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if p.startswith("/**", i) and i + 3 == len(p):
            out.append("/.*")
            i += 3
            continue
        if c == "*":
            while i + 1 < len(p) and p[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = p.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed character class in glob {pattern!r}")
            inner = p[i + 1 : end]
            if inner[0] in "!^":
                inner = "^" + inner[1:]
            out.append("[" + inner.replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "/_-" else c)
        i += 1
    if depth:
        raise ValueError(f"unclosed alternates in glob {pattern!r}")
    return "(?s)^" + "".join(out) + "$"


def selected(path: Column | str, include: str | Sequence[str] | None = None, exclude: str | Sequence[str] | None = None) -> Column:
    """Whether a path matches one of the patterns to include (any, if there are none) and none of those to exclude."""
    p, keep, drop = slashes(path), F.lit(True), F.lit(False)
    if wanted := patterns(include):
        keep = F.rlike(p, F.lit("|".join(map(glob_regex, wanted))))
    if unwanted := patterns(exclude):
        drop = F.rlike(p, F.lit("|".join(map(glob_regex, unwanted))))
    return keep & ~drop


def watched_out(path: Column | str, exclude: Sequence[str]) -> Column:
    """The watcher's rule: a path with an excluded pattern, less its stars and slashes at the ends, anywhere in it."""
    p, drop = slashes(path), F.lit(False)
    for x in exclude:
        part = x.replace("\\", "/").strip("*/")
        if part:
            drop = drop | F.contains(p, F.lit(part))
    return drop
