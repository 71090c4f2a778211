"""Glob wildcards: ``*`` any run, ``?`` one character, ``\\`` takes the next as is.

A glob becomes a SQL LIKE, which Catalyst turns into a prefix, suffix or
substring test where the shape allows, and pushes to the scan for a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column


def glob_parts(glob: str) -> list[tuple[str, str]]:
    """Split into ("any", "*"), ("one", "?") and ("text", …) parts."""
    parts: list[tuple[str, str]] = []
    chars = iter(glob)
    for c in chars:
        if c == "*":
            part = ("any", c)
        elif c == "?":
            part = ("one", c)
        else:
            part = ("text", next(chars, c) if c == "\\" else c)
        if part[0] == "text" and parts and parts[-1][0] == "text":
            parts[-1] = ("text", parts[-1][1] + part[1])
        elif part[0] == "any" and parts and parts[-1][0] == "any":
            continue
        else:
            parts.append(part)
    return parts


def literal_runs(glob: str) -> list[str]:
    """The stretches of plain text every match contains."""
    return [text for kind, text in glob_parts(glob) if kind == "text"]


def glob_match(value: Column, glob: str) -> Column:
    """Does the whole value match the glob?"""
    parts = glob_parts(glob)
    if all(kind == "text" for kind, _ in parts):
        return value == "".join(text for _, text in parts)
    if parts == [("any", "*")]:
        return value.isNotNull()

    def escaped(text: str) -> str:
        return "".join("\\" + c if c in "\\%_" else c for c in text)

    wild = {"any": "%", "one": "_"}
    like = value.like("".join(wild.get(kind) or escaped(text) for kind, text in parts))
    # A pattern of several wildcards isn't pushed to the scan; its prefix is.
    has_prefix = parts[0][0] == "text" and len(parts) > 2
    return value.startswith(parts[0][1]) & like if has_prefix else like
