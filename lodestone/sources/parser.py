"""Parsing source files into relations.

Python is parsed with its own syntax tree. Other languages are read by rule tables of
regular expressions over lines with comments and strings blanked out, which finds
definitions, calls, parents, imports and references but not scopes; Markdown gives headings.
Files are parsed one by one in Python workers, from the text of the whole file.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

SCHEMA = """path string, lang string,
symbols array<struct<name:string,kind:string,line:int,end_line:int,signature:string,doc:string,body_tokens:string>>,
refs array<struct<name:string,line:int,context:string>>,
call_edges array<struct<caller_name:string,caller_line:int,callee:string,line:int>>,
bound_refs array<struct<name:string,line:int,col:int,kind:string,binding:string,target:string>>,
skeletons array<struct<kind:string,parent_kind:string,ident:string,start_row:int,end_row:int,has_block:boolean>>,
includes array<struct<target:string,line:int>>,
imports array<struct<name:string,line:int>>,
hierarchy array<struct<child_name:string,parent_name:string,kind:string,line:int>>"""
SIGNATURE = 200
BODY = 400
NODES = 2000
#: Files that are parsed together, and their bytes of text if more than one.
ROWS, BYTES = 256, 4 << 20
WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
KEYWORDS = frozenset("if else for while return match switch case break continue def fn func function class struct enum trait impl import from use pub let mut const static async await try except catch finally with as in is not and or new this self super true false null None True False void int string bool".split())


@dataclass
class Parsed:
    symbols: list = field(default_factory=list)
    refs: list = field(default_factory=list)
    call_edges: list = field(default_factory=list)
    bound_refs: list = field(default_factory=list)
    skeletons: list = field(default_factory=list)
    includes: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    hierarchy: list = field(default_factory=list)


def meaningful(name: str) -> bool:
    mixed = any(c.islower() for c in name) and any(c.isupper() for c in name)
    return len(name) >= 3 and name.strip("_") != "" and name not in KEYWORDS and ("_" in name or mixed)


def cut_body(words: list[str]) -> str:
    """Distinct words joined by blanks, cut at the last blank within ``BODY`` bytes."""
    text = " ".join(dict.fromkeys(words))
    raw = text.encode()
    if len(raw) <= BODY:
        return text
    head = raw[: BODY + 1].decode(errors="ignore")
    return head[: head.rfind(" ")] if " " in head else ""


def first_line(lines: list[str], line: int) -> str:
    return lines[line - 1].strip()[:SIGNATURE] if 0 < line <= len(lines) else ""


def doc_above(lines: list[str], line: int, marks=("///", "//", "#", "--", "*", "/*")) -> str | None:
    got = []
    i = line - 2
    while i >= 0 and lines[i].strip().startswith(marks):
        got.append(lines[i].strip().lstrip("/*#-! ").rstrip("*/ "))
        i -= 1
    return "\n".join(reversed(got)) or None


class _Python(ast.NodeVisitor):
    """Symbols, calls, parents and bindings of one Python module."""

    def __init__(self, text: str):
        self.out, self.lines = Parsed(), text.split("\n")
        self.owner: list[tuple[str, int]] = [("", 0)]
        self.scopes: list[dict[str, tuple[str, str]]] = [{}]
        self.kinds: list[str] = ["module"]
        tree = ast.parse(text)
        for node in tree.body:  # names of the module are known in every scope
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                self.scopes[0][node.name] = ("module", node.name)
        self.visit(tree)

    def _symbol(self, node, kind: str) -> None:
        words = []
        for n, sub in enumerate(ast.walk(node)):
            if n >= NODES:
                break
            if isinstance(sub, ast.Name):
                words.append(sub.id)
            elif isinstance(sub, ast.Attribute):
                words.append(sub.attr)
            elif isinstance(sub, ast.Constant) and isinstance(sub.value, str):
                words += [w.lower() for w in WORD.findall(sub.value)]
        doc = ast.get_docstring(node) or doc_above(self.lines, node.lineno)
        body = cut_body([w for w in words if w not in KEYWORDS])
        self.out.symbols.append((node.name, kind, node.lineno, node.end_lineno, first_line(self.lines, node.lineno), doc, body))
        self.out.skeletons.append((kind, self.kinds[-1], node.name, node.lineno - 1, node.end_lineno - 1, True))

    def _function(self, node) -> None:
        self._symbol(node, "method" if self.kinds[-1] == "class" else "function")
        for d in node.decorator_list:
            self._call(d.func if isinstance(d, ast.Call) else d, d.lineno)
        args = node.args
        names = [a.arg for a in (*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg)))]
        self.scopes.append({a: ("local", a) for a in names})
        self.owner.append((node.name, node.lineno))
        self.kinds.append("function")
        for child in (*node.args.defaults, *node.body):
            self.visit(child)
        self.kinds.pop()
        self.owner.pop()
        self.scopes.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node) -> None:
        self._symbol(node, "class")
        for b in node.bases:
            name = b.attr if isinstance(b, ast.Attribute) else getattr(b, "id", None)
            if name:
                self.out.hierarchy.append((node.name, name, "extends", node.lineno))
            self.visit(b)
        self.kinds.append("class")
        self.scopes.append({})
        for child in node.body:
            self.visit(child)
        self.scopes.pop()
        self.kinds.pop()

    def _imported(self, node, base: str) -> None:
        for a in node.names:
            name = a.asname or a.name.split(".")[0]
            self.scopes[-1][name] = ("imported", f"{base}{a.name}")
            self.out.imports.append((f"{base}{a.name}", node.lineno))

    def visit_Import(self, node) -> None:
        self._imported(node, "")

    def visit_ImportFrom(self, node) -> None:
        self._imported(node, f"{node.module or ''}.")

    def _call(self, func, line: int) -> None:
        name = func.attr if isinstance(func, ast.Attribute) else getattr(func, "id", None)
        if name:
            self.out.call_edges.append((*self.owner[-1], name, line))

    def visit_Call(self, node) -> None:
        self._call(node.func, node.lineno)
        self.generic_visit(node)

    def visit_Name(self, node) -> None:
        if isinstance(node.ctx, ast.Store):
            where = "module" if len(self.scopes) == 1 else "local"
            self.scopes[-1].setdefault(node.id, (where, node.id))
            if len(self.scopes) == 1 and node.id.isupper():
                self.out.symbols.append((node.id, "constant", node.lineno, node.end_lineno, first_line(self.lines, node.lineno), None, ""))
            return
        binding, target = next((s[node.id] for s in reversed(self.scopes) if node.id in s), ("unresolved", None))
        self.out.bound_refs.append((node.id, node.lineno, node.col_offset, "value", binding, target))
        if meaningful(node.id):
            self.out.refs.append((node.id, node.lineno, first_line(self.lines, node.lineno)))

    def visit_Attribute(self, node) -> None:
        if meaningful(node.attr):
            self.out.refs.append((node.attr, node.lineno, first_line(self.lines, node.lineno)))
        self.generic_visit(node)


NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
#: kind -> how a line of any brace language that defines it looks.
RULES = [
    ("function", re.compile(rf"\b(?:fn|func|function|fun)\s+(?:\([^)]*\)\s*)?{NAME}")),
    ("class", re.compile(rf"\bclass\s+{NAME}")),
    ("struct", re.compile(rf"\bstruct\s+{NAME}")),
    ("enum", re.compile(rf"\benum\s+(?:class\s+)?{NAME}")),
    ("interface", re.compile(rf"\b(?:interface|protocol)\s+{NAME}")),
    ("trait", re.compile(rf"\btrait\s+{NAME}")),
    ("struct", re.compile(rf"\btype\s+{NAME}\s+struct\b")),
    ("type", re.compile(rf"\btype\s+{NAME}\s*[=<]")),
    ("module", re.compile(rf"\b(?:mod|namespace|package)\s+{NAME}")),
    ("constant", re.compile(rf"\bconst\s+(?:int\s+|auto\s+)?{NAME}\s*[:=]")),
    ("function", re.compile(rf"^\s*(?!(?:return|else|new|throw|await|yield|case|delete|goto|use|import)\b)(?:(?:public|private|protected|internal|static|final|virtual|override|async|inline|extern|unsigned|const)\s+)*[A-Za-z_][\w:<>,\s\*&\[\]]*?[\s\*&]{NAME}\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:\{{|$)")),
]
TYPE = rf"\b(?:class|interface|struct)\s+{NAME}"
#: relation -> how a line tells (child, parents).
PARENTS = [
    ("extends", re.compile(rf"{TYPE}[^{{]*?\bextends\s+([\w.,\s]+?)(?=\bimplements\b|\{{|$)")),
    ("implements", re.compile(rf"{TYPE}[^{{]*?\bimplements\s+([\w.,\s]+?)(?=\{{|$)")),
    ("extends", re.compile(rf"{TYPE}\s*(?:\([^)]*\)\s*)?:\s*([^{{]+)")),
]
IMPL = re.compile(r"\bimpl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)")
INCLUDE = re.compile(r'^\s*#\s*include\s+"([^"]+)"')
IMPORT = re.compile(r"^\s*(?:use|import|from|require|using)\s+([\w.:/*{}\", ]+)")
CALL = re.compile(rf"{NAME}\s*(?:::<[^>]*>)?\(")
BLANKS = re.compile(r"//[^\n]*|/\*.*?\*/|#(?!\s*include)[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'", re.S)


def _blank(text: str, hashes: bool) -> str:
    """Comments and strings as blanks, so that lines and columns stay."""
    keep = lambda m: m[0] if m[0].startswith("#") and not hashes else re.sub(r"[^\n]", " ", m[0])
    return BLANKS.sub(keep, text)


def _end(lines: list[str], at: int) -> int:
    """The last line of the block that opens on line ``at``, or at the start of the next; else the line itself."""
    opens = "{" in lines[at - 1] or (at < len(lines) and lines[at].lstrip().startswith("{"))
    if not opens:
        return at
    depth, opened = 0, False
    for i in range(at - 1, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        opened = opened or "{" in lines[i]
        if opened and depth <= 0:
            return i + 1
    return len(lines)


def parse_rules(text: str, lang: str) -> Parsed:
    out, raw = Parsed(), text.split("\n")
    lines = _blank(text, lang in ("ruby", "bash", "yaml", "toml")).split("\n")
    for no, line in enumerate(lines, 1):
        for kind, rule in RULES:
            m = rule.search(line)
            if m and m[1] not in KEYWORDS:
                end = _end(lines, no)
                body = cut_body([w for b in reversed(lines[no:end]) for w in reversed(WORD.findall(b)) if w not in KEYWORDS])
                out.symbols.append((m[1], kind, no, end, first_line(raw, no), doc_above(raw, no), body))
                out.skeletons.append((kind, None, m[1], no - 1, end - 1, end > no or "{" in line))
                break
        for relation, rule in PARENTS:
            if m := rule.search(line):
                for p in WORD.findall(re.sub(r"\b(?:public|private|protected|virtual)\b|\b\w+::", "", m[2])):
                    out.hierarchy.append((m[1], p, relation, no))
        if m := IMPL.search(line):
            out.hierarchy.append((m[2], m[1].split("::")[-1], "implements", no))
        if m := INCLUDE.match(raw[no - 1]):
            out.includes.append((m[1], no))
        if m := IMPORT.match(line):
            out.imports.append((m[1].strip(), no))
        for w in WORD.findall(line):
            if meaningful(w):
                out.refs.append((w, no, first_line(raw, no)))
    functions = [s for s in out.symbols if s[1] in ("function", "method")]
    defined = {(s[0], s[2]) for s in functions}
    for no, line in enumerate(lines, 1):
        for m in CALL.finditer(line):
            if m[1] in KEYWORDS or (m[1], no) in defined:
                continue
            inside = [s for s in functions if s[2] <= no <= s[3]]
            owner = min(inside, key=lambda s: s[3] - s[2], default=None)
            out.call_edges.append((*((owner[0], owner[2]) if owner else ("", 0)), m[1], no))
            out.bound_refs.append((m[1], no, m.start(), "call", "module" if any(s[0] == m[1] for s in out.symbols) else "unresolved", m[1]))
    return out


def parse_markdown(text: str) -> Parsed:
    out, lines = Parsed(), text.split("\n")
    heads, fenced = [], False
    for no, line in enumerate(lines, 1):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)):
            heads.append((len(m[1]), m[2], no))
    for i, (level, name, no) in enumerate(heads):
        end = next((n - 1 for lv, _, n in heads[i + 1 :] if lv <= level), len(lines))
        while end > no and not lines[end - 1].strip():
            end -= 1
        out.symbols.append((name, "heading", no, end, first_line(lines, no), None, cut_body([w.lower() for x in lines[no:end] for w in WORD.findall(x)])))
    return out


def parse(text: str, lang: str) -> Parsed:
    """What a file holds; a Python file that does not parse is read by rules."""
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    if lang == "markdown":
        return parse_markdown(text)
    if lang == "python":
        try:
            return _Python(text).out
        except (SyntaxError, ValueError, RecursionError):
            pass
    return parse_rules(text, lang)


def parse_files(files: DataFrame) -> DataFrame:
    """One row of nested relations for each file (path, lang, text)."""
    names = ("symbols", "refs", "call_edges", "bound_refs", "skeletons", "includes", "imports", "hierarchy")

    kinds = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in portions(whole)):
            got = [parse(t or "", lang) for t, lang in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
            rows = lambda f: [[dict(zip(f.type.value_type.names, x)) for x in getattr(p, f.name)] for p in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(rows(kinds.field(n)), kinds.field(n).type) for n in names)], schema=kinds)
            del got
        pa.default_memory_pool().release_unused()

    return files.select("path", "lang", "text").mapInArrow(run, SCHEMA)


def portions(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows (path, lang, text) of a batch, ``ROWS`` at a time, or fewer where their texts are long: what parsing makes of them stays small."""
    first, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist()):
        if i > first and (i - first == ROWS or held + n > BYTES):
            yield b.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < b.num_rows:
        yield b.slice(first)


def parse_cached(files: DataFrame, cache: DataFrame | None) -> DataFrame:
    """``parse_files`` that takes files of known content (content_hash) from ``cache``."""
    keyed = files.withColumn("content_hash", F.xxhash64("text", "lang"))
    if cache is None:
        return parse_files(keyed).join(keyed.select("path", "content_hash"), "path")
    known = cache.drop("path", "lang").dropDuplicates(["content_hash"])
    hits = keyed.select("path", "lang", "content_hash").join(known, "content_hash")
    misses = keyed.join(known.select("content_hash"), "content_hash", "left_anti")
    fresh = parse_files(misses).join(misses.select("path", "content_hash"), "path")
    return fresh.unionByName(hits.select(fresh.columns))


def relation(parsed: DataFrame, name: str) -> DataFrame:
    """One nested relation of parsed files as rows with their path."""
    return parsed.select("path", F.explode(name).alias("x")).select("path", "x.*")


def symbols(parsed: DataFrame) -> DataFrame:
    """Symbols with ids in the order of path, line, kind and name, and a module row for each file.

    Ids come from one ordered pass over ranges: a file's rows keep together, and offsets are
    counts of the ranges before.
    """
    rows = relation(parsed, "symbols").unionByName(
        parsed.select(
            "path", F.concat(F.lit("<module:"), "path", F.lit(">")).alias("name"), F.lit("module").alias("kind"), F.lit(1).alias("line"),
            F.lit(1).alias("end_line"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("doc"), F.lit("").alias("body_tokens"),
        )
    )
    return with_ids(rows, ["path", "line", "kind", "name"], "sym_id")


def with_ids(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 in the given order, without bringing all rows to one task."""
    from pyspark.sql import Window as W

    from lodestone.sources.storage import stash

    dealt = stash(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ids")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # one row a partition
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_n", "_before", "_place")


def extract_body(text, line, end_line):
    """The lines of a definition."""
    return F.array_join(F.slice(F.split(text, "\n"), line, F.greatest(end_line - line + 1, F.lit(0))), "\n")
