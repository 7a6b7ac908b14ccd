"""Structural patterns: holes, ellipses, conjunctions and alternatives over node texts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "([{", ")]}"
HOLE = re.compile(r"\$\$\$([A-Z][A-Z0-9_]*)?|\$\$([A-Z][A-Z0-9_]*)|\$(_|[A-Z][A-Z0-9_]*)")
RUN = re.compile(r"(?:[A-Za-z0-9_<>*&.]|::)+")
#: Keywords that open a definition, and the node kind they tell.
ROOTS = {"fn": "function", "def": "function", "func": "function", "function": "function", "class": "class", "struct": "struct", "enum": "enum", "trait": "trait", "interface": "interface", "impl": "impl", "mod": "module", "import": "import"}


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Hole:
    name: str | None
    many: bool


def split_top(pattern: str, sign: str) -> list[str]:
    """Parts of a pattern between signs that stand outside brackets."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        depth += (c in OPEN) - (c in CLOSE)
        if depth == 0 and pattern.startswith(sign, i):
            out.append(pattern[start:i])
            i = start = i + len(sign)
            continue
        i += 1
    return [*out, pattern[start:]]


def parse(pattern: str) -> list[list[list[Literal | Hole]]]:
    """Alternatives of conjunctions of token lists; `` && `` binds tighter than `` || ``."""
    return [[_tokens(p.strip()) for p in split_top(alt, " && ")] for alt in split_top(pattern, " || ")]


def _tokens(text: str) -> list[Literal | Hole]:
    out: list[Literal | Hole] = []
    at = 0
    for m in HOLE.finditer(text):
        if (lit := text[at : m.start()].strip()):
            out.append(Literal(lit))
        name = m[1] or m[2] or m[3]
        out.append(Hole(None if name in (None, "_") else name, m[0].startswith("$$")))
        at = m.end()
    if (lit := text[at:].strip()):
        out.append(Literal(lit))
    return out


def _balanced(text: str, i: int) -> int:
    """The place after the bracket group that opens at ``i``; -1 if it never closes."""
    depth = 0
    for k in range(i, len(text)):
        depth += (text[k] in OPEN) - (text[k] in CLOSE)
        if depth == 0:
            return k + 1
    return -1


def _at_depth_zero(text: str, i: int, lit: str) -> int:
    depth = 0
    for k in range(i, len(text) - len(lit) + 1):
        if depth == 0 and text.startswith(lit, k):
            return k
        depth += (text[k] in OPEN) - (text[k] in CLOSE)
        if depth < 0:
            return -1
    return -1


def match(tokens: list[Literal | Hole], text: str) -> dict[str, str] | None:
    """Captures if the tokens match a prefix of ``text``."""
    i, got = 0, {}
    for k, tok in enumerate(tokens):
        while i < len(text) and text[i].isspace():
            i += 1
        following = tokens[k + 1].text if k + 1 < len(tokens) and isinstance(tokens[k + 1], Literal) else None
        if isinstance(tok, Literal):
            for part in tok.text.split():
                while i < len(text) and text[i].isspace():
                    i += 1
                if not text.startswith(part, i):
                    return None
                i += len(part)
            continue
        if tok.many:
            stop = _at_depth_zero(text, i, following.split()[0]) if following else len(text)
            if stop < 0:
                return None
        elif i < len(text) and text[i] in OPEN:
            stop = _balanced(text, i)
            if stop < 0:
                return None
        else:
            m = RUN.match(text, i)
            if not m:
                return None
            stop = m.end()
            if following and (cut := text.find(following[0], i, stop)) > i:
                stop = cut
        value = text[i:stop].strip()
        if tok.name:
            squeezed = re.sub(r"\s+", "", value)
            if tok.name in got and re.sub(r"\s+", "", got[tok.name]) != squeezed:
                return None
            got.setdefault(tok.name, value)
        i = stop
    return got


def root_kind(pattern: str) -> str | None:
    """The node kind that a pattern's first word tells; none for alternatives."""
    if len(split_top(pattern, " || ")) > 1:
        return None
    word = re.match(r"(?:pub\s+|async\s+|export\s+)*([a-z]+)\b", pattern)
    return ROOTS.get(word[1]) if word else None


def find(nodes: DataFrame, pattern: str, skeletons: DataFrame | None = None) -> DataFrame:
    """(path, line, captures) where nodes (path, line, node_text) match, once per line.

    Alternatives are tried in order; within a file, the parts of a conjunction must agree on
    shared captures and the first part tells the place. Files without a node of the pattern's
    root kind are dropped by a semi-join on ``skeletons`` (path, kind).
    """
    alts = parse(pattern)
    kind = root_kind(pattern)
    if skeletons is not None and kind:
        nodes = nodes.join(skeletons.where(F.col("kind") == kind).select("path").distinct(), "path", "left_semi")

    def hits(alt, rows) -> list[tuple[int, dict[str, str]]]:
        found = None
        for part in alt:
            mine = [(line, c) for line, text in rows if (c := match(part, text)) is not None]
            if found is None:
                found = mine
            else:
                agree = lambda x, y: all(re.sub(r"\s+", "", x[k]) == re.sub(r"\s+", "", y[k]) for k in x.keys() & y.keys())
                found = [(line, {**d, **c}) for line, c in found for _, d in mine if agree(c, d)]
        return found or []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["line"], pdf["node_text"]))
        seen: dict[int, str] = {}
        for alt in alts:
            for line, captures in hits(alt, rows):
                seen.setdefault(line, json.dumps(captures))
        return pd.DataFrame([(pdf["path"].iloc[0], *x) for x in seen.items()], columns=["path", "line", "captures"])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, line, text in zip(pdf["path"], pdf["line"], pdf["node_text"]):
                for alt in alts:
                    if (c := match(alt[0], text)) is not None:
                        out.append((path, line, json.dumps(c)))
                        break
            yield pd.DataFrame(out, columns=["path", "line", "captures"])

    rows, kinds = nodes.select("path", "line", "node_text"), "path string, line int, captures string"
    if all(len(a) == 1 for a in alts):  # no file has to come together
        made = rows.mapInPandas(stream, kinds).groupBy("path", "line").agg(F.min("captures").alias("captures"))
    else:
        made = rows.groupBy("path").applyInPandas(run, kinds)
    return made.select("path", "line", F.from_json("captures", "map<string,string>").alias("captures"))
