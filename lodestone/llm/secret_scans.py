"""Secret scans: single-pattern spans, and multipart credentials linked within scopes.

Base kinds are found by pattern. Weak candidates (account identifiers, opaque values,
service endpoints) are too common to report alone; they are intervals which are joined
to scopes (blank-line separated blocks, at most ``SCOPE`` code points apart) and are
reported only where complementary parts, an identifier or endpoint and a secret value,
meet in one scope. A base span counts as a part too.

Edges. A null or empty text has no spans. Documents are scanned whole, one by one, so
ties, repeated rows and copies give equal rows. An empty table gives an empty result.
Invalid UTF-8 is read with replacement characters. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import prepare, text_bytes

BASE = ("assign", "access", "hex")
WEAK = ("part_id", "part_secret", "part_endpoint")
ORDER = {k: i for i, k in enumerate(BASE + WEAK)}

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run that is long enough; shorter runs are dropped anyway.
HEX = re.compile(r"[0-9a-f]{16,}")
IDENT = re.compile(r"""\b(?:client_?id|account(?:_?id)?|user(?:name)?|login|access_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
ENDPOINT = re.compile(r"\b(?:https?|wss?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+", re.A)
BLOCK = re.compile(r"\n[\x20\t\r]*\n")
SCOPE = 400
ENTROPY = 3.2


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out = []
    if ":" in text or "=" in text:
        out += [("part_id", m.start(), m.end()) for m in IDENT.finditer(text)]
    if "://" in text:
        out += [("part_endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if out or any(k == "access" for k, _, _ in base):  # values alone are never reported
        for m in OPAQUE.finditer(text):
            v = m[0]
            if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and _entropy(v) >= ENTROPY:
                out.append(("part_secret", m.start(), m.end()))
    return out


def link(text: str, base: list[tuple[str, int, int]], weak: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The weak parts that a complementary part accompanies.

    Scopes are disjoint intervals, so a part falls into one by binary search. Within a
    scope, parts sorted by place are linked to complementary ones that start at most
    ``SCOPE`` code points away: only the nearest on each side can decide that.
    """
    if not weak:
        return []
    cuts = [0, *(m.end() for m in BLOCK.finditer(text))]
    # Values that a base span covers are that span, and an endpoint's own characters no value.
    covered = sorted((s, e) for k, s, e in base + weak if k != "part_secret")
    starts = [s for s, _ in covered]
    ends, top = [], 0
    for _, e in covered:
        top = max(top, e)
        ends.append(top)

    def free(s: int) -> bool:
        i = bisect_right(starts, s) - 1
        return i < 0 or ends[i] <= s

    role = {"assign": "secret", "hex": "secret", "access": "id", "part_id": "id", "part_secret": "secret", "part_endpoint": "id"}
    parts = sorted((s, e, k) for k, s, e in base + weak if k != "part_secret" or free(s))
    ids = [s for s, _, k in parts if role[k] == "id"]
    last: dict[tuple[int, str], int] = {}
    linked: set[int] = set()
    for order in (range(len(parts)), range(len(parts) - 1, -1, -1)):
        last.clear()
        for i in order:
            s, e, k = parts[i]
            scope, mine = bisect_right(cuts, s), role[k]
            other = last.get((scope, "secret" if mine == "id" else "id"))
            if k == "part_secret" and other is not None and s < other < e:  # an id within the value is no other part
                j = bisect_left(ids, e)
                other = ids[j] if j < len(ids) and bisect_right(cuts, ids[j]) == scope else None
            if other is not None and abs(other - s) <= SCOPE:
                linked.add(i)
            last[scope, mine] = s
    return [(parts[i][2], parts[i][0], parts[i][1]) for i in sorted(linked) if parts[i][2] in WEAK]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2])))


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and linked weak spans of one text, as (kind, start, end) in code points."""
    base = base_spans(text)
    return base, link(text, base, weak_parts(text, base))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, shas, texts = [], [], []
        for x in b.column(1):
            base, more = scan(x.as_py().decode("utf-8", "replace"))
            n = Counter(k for k, _, _ in base)
            counts.append([n[k] for k in BASE] + [len(more)])
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
            texts.append(joined(base + more))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(shas, pa.string()), pa.array(texts, pa.string()), pa.array([c[3] for c in counts], pa.int64())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans and the number of linked weak ones."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    )


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
