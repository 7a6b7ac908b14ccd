"""Path scopes and predicates: globs become one regular expression at plan time."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PATTERNS = 64
MAX_LENGTH = 256
#: Where tests live.
TEST_GLOBS = (
    "**/tests/**", "**/__tests__/**", "**/test/**", "**/spec/**", "**/tests.rs", "**/*_test.rs", "**/*_tests.rs", "**/*_test.go",
    "**/*_test.dart", "**/integration_test/**/*.dart", "**/*_test.py", "**/test_*.py", "**/*.test.ts", "**/*.test.tsx",
    "**/*.test.js", "**/*.test.jsx", "**/*.spec.ts", "**/*.spec.tsx", "**/*.spec.js", "**/*.spec.jsx", "**/*_spec.rb",
    "**/*Test.java", "**/*Tests.java", "**/*Test.kt", "**/*Tests.kt", "**/*Tests.cs", "**/*Tests.swift", "**/*.Tests/**",
    "**/test_*.cc", "**/test_*.cpp", "**/*_test.cc", "**/*_test.cpp", "**/conftest.py",
)
#: Extensions of prose.
DOC_EXTENSIONS = ("md", "markdown", "txt", "rst", "adoc")
#: Banners of generators, by tool, that one of the first ten lines may hold.
BANNERS = (
    ("automatically generated by rust-bindgen", "rust-bindgen"),
    ("@generated automatically by Diesel CLI", "diesel-cli"),
    ("auto generated by OpenAPI Generator", "openapi-generator"),
    ("Code generated by Prisma", "prisma"),
    ("Generated by the gRPC Python protocol compiler plugin", "grpc-python"),
)
#: How many lines a banner is looked for in.
BANNER_LINES = 40


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: ``*`` stays within a segment, ``**`` crosses them."""
    if len(pattern) > MAX_LENGTH:
        raise ValueError("pattern too long")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and "}" in pattern[i:]:
            stop = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, pattern[i + 1 : stop].split(","))) + ")", stop + 1
        elif c == "[" and "]" in pattern[i:]:
            stop = pattern.index("]", i)
            out, i = out + "[" + pattern[i + 1 : stop].replace("!", "^", 1) + "]", stop + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def any_glob(patterns) -> str | None:
    if len(patterns) > MAX_PATTERNS:
        raise ValueError("too many patterns")
    return "^(?:" + "|".join(glob_regex(p) for p in patterns) + ")$" if patterns else None


@dataclass(frozen=True)
class PathScope:
    """Include and exclude globs; an exclusion beats an inclusion."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def accepts(self, path: Column) -> Column:
        out = F.lit(True)
        if self.exclude:
            out = out & ~path.rlike(any_glob(self.exclude))
        if self.include:
            out = out & path.rlike(any_glob(self.include))
        return out

    def accepts_pair(self, a: Column, b: Column) -> Column:
        """Neither side excluded, and either side included."""
        out = F.lit(True)
        if self.exclude:
            x = any_glob(self.exclude)
            out = out & ~(a.rlike(x) | b.rlike(x))
        if self.include:
            x = any_glob(self.include)
            out = out & (a.rlike(x) | b.rlike(x))
        return out


def extension(path: Column) -> Column:
    """What follows the last dot of a file's name; nothing for a name that only starts with one."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def is_test_path(path: Column, globs=TEST_GLOBS) -> Column:
    return F.translate(path, "\\", "/").rlike(any_glob(globs))


def is_doc_path(path: Column) -> Column:
    return F.lower(extension(path)).isin(*DOC_EXTENSIONS)


def framework(path: Column) -> Column:
    """The test framework that a path suggests; the first rule that fits counts."""
    rules = (
        (r"(^|/)tests/.*\.rs$", "rust-integration"),
        (r"_test\.rs$", "rust-cargo"),
        (r"_test\.go$", "go-test"),
        (r"(^|/)(test_[^/]*\.py|[^/]*_test\.py|conftest\.py)$|/tests?/.*\.py$", "pytest"),
        (r"^(?=.*(\.test\.|\.spec\.|__tests__/)).*\.(ts|tsx|js|jsx)$", "jest"),
        (r"Tests?\.java$", "junit"),
        (r"Tests?\.kt$", "kotest"),
        (r"Tests\.cs$|\.Tests/.*\.cs$", "xunit"),
        (r"_test\.(cc|cpp)$|/test_.*\.(cc|cpp)$", "gtest"),
    )
    out = F.lit("unknown")
    for pattern, label in reversed(rules):
        out = F.when(path.rlike(pattern), label).otherwise(out)
    return out


def generated_by(text: Column) -> Column:
    """(tool, source) by a generator's banner in the first lines; a null tool without one.

    ``source`` is the file that a banner names on a line of its own, anywhere in those lines.
    """
    lines = F.transform(F.slice(F.split(text, "\n", BANNER_LINES + 1), 1, BANNER_LINES), lambda x: F.regexp_replace(x, "\r$", ""))

    def tool_and_source(x: Column) -> Column:
        among = lambda n, test: F.exists(F.slice(x, 1, n), test)
        has = lambda n, part: among(n, lambda y: y.contains(part))
        body = lambda y: F.regexp_extract(y, r"^\s*(?://|#|--) (.*?)\s*$", 1)
        banner = among(BANNER_LINES, lambda y: body(y).startswith("Code generated ") & body(y).endswith(" DO NOT EDIT."))
        javah = F.trim(F.get(x, 0)) == "/* DO NOT EDIT THIS FILE - it is machine generated */"
        tool = (
            F.when(banner, "code-generated-banner")
            .when(has(3, "Generated by the protocol buffer compiler.  DO NOT EDIT!"), "protoc")
            .when(has(8, "GENERATED CODE -- DO NOT EDIT!"), "protoc-js")
            .when(has(6, "Autogenerated by Thrift Compiler"), "thrift")
            .when(javah & has(3, "#include <jni.h>"), "javah")
        )
        for part, name in BANNERS:
            tool = tool.when(has(10, part), name)
        tool = tool.when(among(5, lambda y: y.rlike(r"^\s*(//|\*|#|/\*)\s*@generated")), "generated-annotation")
        named = F.transform(x, lambda y: F.trim(F.regexp_extract(body(y), "^source: (.*)$", 1)))
        source = F.get(F.filter(named, lambda y: y != ""), 0)
        return F.struct(tool.alias("tool"), F.when(tool.isNotNull(), source).alias("source"))

    # The lines are bound once, as a lambda's variable.
    return F.element_at(F.transform(F.array(lines), tool_and_source), 1)


def is_generated(text: Column) -> Column:
    """Whether one of the first lines bears a generator's banner."""
    return generated_by(text)["tool"].isNotNull()


def metadata_matches(signature: Column, visibility: str | None = None, modifiers: tuple[str, ...] = ()) -> Column:
    """Whether a signature's words hold what is asked for; a null signature fails any demand."""
    words = F.split(signature, r"[\s(<:]+")
    out = F.lit(True)
    for word in ([visibility] if visibility else []) + list(modifiers):
        out = out & F.coalesce(F.array_contains(words, word), F.lit(False))
    return out


def in_changed(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows whose path is among ``changed`` (path): a semi-join, whatever its size."""
    return rows.join(changed.select("path").distinct(), "path", "left_semi")
