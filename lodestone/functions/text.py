"""Tokenizers and name predicates as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query does not search for.
STOPWORDS = (
    "the", "a", "an", "is", "are", "of", "to", "in", "for", "on", "with", "it", "this", "that",
    "and", "or", "but", "if", "as", "at", "by", "from",
)
#: What separates the words of a document.
SEPARATOR = r"[^\p{L}\p{N}_]+"


def camel_parts(name: Column) -> Column:
    """Parts of a name, cut where an ASCII lower-case letter meets an upper-case one."""
    return F.split(name, r"(?<=[a-z])(?=[A-Z])")


def identifier_tokens(name: Column) -> Column:
    """Lower-case words of an identifier: cut at ``_``, at lower|Upper and at UPPER|Word."""
    cut = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return F.filter(F.split(F.lower(cut), "_+"), lambda x: x != "")


def document_terms(text: Column) -> Column:
    """Distinct lower-case terms of at least two bytes, in order of first sight."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SEPARATOR), lambda x: F.octet_length(x) >= 2))


def query_terms(query: str) -> list[str]:
    """Terms of a query: repeats stay, stopwords and short terms go."""
    parts = re.split(r"[^\w]+", query.lower())
    return [p for p in parts if len(p.encode()) >= 2 and p not in STOPWORDS]


def name_tokens(name: Column) -> Column:
    """Keys under which a name is found: itself in lower case and its camel parts."""
    return F.array_distinct(F.concat(F.array(F.lower(name)), F.transform(camel_parts(name), lambda x: F.lower(x))))


def is_identifier(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


#: Names of standard-library methods.
STDLIB = (
    "c_str", "size", "length", "empty", "begin", "end", "cbegin", "cend", "front", "back", "push_back", "pop_back", "emplace_back",
)


def is_stdlib_or_macro(name: Column) -> Column:
    """Qualified or reserved names, common methods, and names in capitals of at most six bytes."""
    return name.startswith("std::") | name.startswith("__") | name.isin(*STDLIB) | name.rlike(r"^(?=[_0-9]*[A-Z])[A-Z_0-9]{1,6}$")


def looks_like_test(name: Column) -> Column:
    return name.rlike(r"^(test_|Test)|(_test|Test|Tests)$")


def meaningful_identifier(name: Column, keywords: tuple[str, ...] = ()) -> Column:
    """At least three characters, no keyword, and with ``_`` or both cases."""
    mixed = name.rlike("[a-z]") & name.rlike("[A-Z]")
    good = (F.length(name) >= 3) & ~name.rlike("^_+$") & (name.contains("_") | mixed)
    return good & ~name.isin(*keywords) if keywords else good


def head_lines(text: Column, n: int) -> Column:
    """The first ``n`` lines, with a note on how many more there are."""
    if n == 0:
        return F.when(text.isNotNull(), F.lit(""))
    lines = F.split(text, "\n")
    more = F.size(lines) - n
    cut = F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n... ("), more.cast("string"), F.lit(" more lines)"))
    return F.when(more > 0, cut).otherwise(text)


def signature_head(body: Column) -> Column:
    """What stands before the first ``{``, or before a ``:`` that is not ``::``, outside brackets; else the body."""
    nest = r"(?:\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|\"[^\"]*\"|::|[^{:\"])*"
    head = F.regexp_extract(body, rf"^({nest}?)(?=\{{|:(?!:))", 1)
    return F.when(F.length(head) > 0, F.rtrim(head)).otherwise(body)


def directory(path: Column) -> Column:
    """The directory of a path; ``.`` where there is none."""
    return F.when(F.instr(path, "/") > 1, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def ancestors(path: Column) -> Column:
    """``.`` and every directory above a path, from the top down."""
    parts = F.split(directory(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.concat(F.array(F.lit(".")), prefixes))


def query_shape(query: str) -> str:
    """What kind of name a query looks like, by its letters: constant, type, function or ambiguous."""
    mixed, capital = re.search("[a-z]", query), re.match("[A-Z]", query)
    if re.fullmatch("[A-Z_]{2,}", query) and "_" in query:
        return "constant"
    if capital and mixed:
        return "type"
    return "function" if "_" in query or (mixed and re.search("[A-Z]", query)) else "ambiguous"
