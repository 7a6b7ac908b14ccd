"""Personal data: patterns propose spans, checksums confirm them, context adjusts scores.

DataFrame expressions only. Each kind has one pattern; the matches and the pieces
between them give every span's place in code points. Cards must pass Luhn, IBANs
mod-97, addresses and numbers their own ranges. A span's score starts at its kind's and
rises where a context word of the kind stands within ``NEAR`` code points of it.

The patterns are written so that a failing start never rescans what follows: they start
only where the maximal run starts (or where the last match ended, ``\\G``), and use
possessive quantifiers, which find the same leftmost matches as the plain forms.

Edges. A null or empty text has no spans. Ties (one place matched by two kinds) are both
reported, in order of kind. Repeated rows give equal rows, an empty table an empty
result; extra columns are not read. Texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import fresh

NEAR = 40
LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> (pattern, base score, context words)
KINDS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "e?-?mails?|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ips?|hosts?|servers?|address(?:es)?"),
    "card": (
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", 0.8, "cards?|credit|visa|pay(?:ments?)?",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.5, "(?:tele)?phones?|call|tel|mobile|fax"),
    "iban": (r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Z0-9])", 0.8, "ibans?|bank|accounts?"),
}
BASE = ("email", "ip", "card", "phone")
#: A text without the kind's mark cannot match its pattern; the mark spares the search.
MARK = {"email": "@", "ip": ".", "phone": "+"}
SPAN = "array<struct<kind:string,start:bigint,stop:bigint,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 on division by 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        a = F.ascii(c)
        return F.when(a < 58, (acc * 10 + (a - 48)) % 97).otherwise((acc * 100 + (a - 55)) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        def small(part: Column) -> Column:
            value = F.ltrim(part, F.lit("0"))
            return (F.length(value) <= 3) & (F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    return F.lit(True)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(items: Column, pos: Column, step, none: Column, context=None) -> Column:
    """(pos, out) after ``step(pos, item, held)`` for every item: it gives the next pos and an array to add.

    Arrays are copied whenever they grow. Items are folded in parts as long as there are parts,
    so n items cost n * sqrt(n) copied references and not n * n. ``context(pos, part)`` is
    worked out once for each part and handed to its steps as ``held``.
    """
    width = F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int")

    def outer(acc: Column, at: Column) -> Column:
        part = F.slice(items, at, width)
        held = context(acc["pos"], part) if context else F.lit(0)

        def inner(h: Column) -> Column:
            def add(a: Column, x: Column) -> Column:
                after, more = step(a["pos"], x, h)
                return F.struct(after.alias("pos"), F.concat(a["out"], more).alias("out"))

            return F.aggregate(part, F.struct(acc["pos"].alias("pos"), none.alias("out")), add)

        return bound(bound(held, inner), lambda g: F.struct(g["pos"].alias("pos"), F.concat(acc["out"], F.array(g["out"])).alias("out")))

    start = F.struct(pos.alias("pos"), F.slice(F.array(none), 1, 0).alias("out"))
    parts = F.aggregate(F.sequence(F.lit(1), F.size(items), width), start, outer)
    return bound(parts, lambda a: F.struct(a["pos"].alias("pos"), F.flatten(a["out"]).alias("out")))


def _spans(kind: str, m: Column, p: Column) -> Column:
    """The confirmed spans of a kind, from its matches ``m`` and the pieces ``p`` between them."""
    _, base, words = KINDS[kind]
    none = F.expr(f"cast(array() as {SPAN})")

    def step(pos: Column, i: Column, _: Column) -> tuple[Column, Column]:
        hit = F.element_at(m, i)
        stop = pos + F.length(hit).cast("long")
        near = F.lower(F.concat(F.right(F.element_at(p, i), F.lit(NEAR)), F.lit(" "), F.left(F.element_at(p, i + 1), F.lit(NEAR))))
        score = F.lit(base) + F.when(near.rlike(rf"\b(?:{words})\b"), 0.1).otherwise(0.0)
        one = F.array(F.struct(F.lit(kind).alias("kind"), pos.alias("start"), stop.alias("stop"), score.alias("score"))).cast(SPAN)
        return stop + F.length(F.element_at(p, i + 1)), F.when(confirmed(kind, hit), one).otherwise(none)

    found = fold(F.sequence(F.lit(1), F.size(m)), F.length(F.element_at(p, 1)).cast("long"), step, none)["out"]
    return F.when(F.size(m) > 0, found).otherwise(none)


def with_spans(docs: DataFrame, text: str = "text", prefix: str = "spans_") -> DataFrame:
    """``docs`` with one column ``<prefix><kind>`` for each kind, in the order of place."""
    own = fresh(docs)
    out = docs.withColumn(f"{own}t", F.coalesce(F.col(text), F.lit("")))
    t, empty = F.col(f"{own}t"), F.expr("cast(array() as array<string>)")
    matches, pieces = {}, {}
    for kind, (pattern, _, _) in KINDS.items():
        m = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        matches[f"{own}m_{kind}"] = F.when(F.contains(t, F.lit(MARK[kind])), m).otherwise(empty) if kind in MARK else m
        pieces[f"{own}p_{kind}"] = F.when(F.size(f"{own}m_{kind}") > 0, F.split(t, pattern, -1)).otherwise(empty)
    out = out.withColumns(matches).withColumns(pieces)
    out = out.withColumns({f"{own}s_{k}": _spans(k, F.col(f"{own}m_{k}"), F.col(f"{own}p_{k}")) for k in KINDS})
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"{own}s_{k}").alias(f"{prefix}{k}") for k in KINDS))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, all spans, n_iban and the highest score."""
    found = with_spans(docs.select("doc_id", "text"))
    base = F.concat(*(F.col(f"spans_{k}") for k in BASE))
    every = F.concat(*(F.col(f"spans_{k}") for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.size("spans_iban").cast("long").alias("n_iban"),
        F.array_max(F.transform(every, lambda x: x["score"])).alias("max_score"),
    )


def redact(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` with every span of at least ``min_score`` replaced by its kind in brackets.

    Where spans overlap, the one that starts first counts, and the longer one of those.
    ``n_chars`` follows the new text; rows, null texts and other columns, whatever their names,
    stay as they are. An empty table stays empty.
    """
    own = fresh(docs)
    text = F.col("text")
    every = F.concat(*(F.col(f"{own}{k}") for k in KINDS))
    key = F.transform(
        F.filter(every, lambda x: x["score"] >= min_score),
        lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("stop"), x["kind"].alias("kind")),
    )
    none = F.expr("cast(array() as array<string>)")

    def near(pos: Column, part: Column) -> Column:
        """Where a part's stretch of the text begins, and the stretch: places far into a text are found once a part."""
        stop = F.array_max(F.transform(part, lambda x: -x["stop"]))
        return F.struct(pos.alias("at"), F.substring(text, (pos + 1).cast("int"), F.greatest(F.lit(0), stop - pos).cast("int")).alias("text"))

    def step(pos: Column, x: Column, held: Column) -> tuple[Column, Column]:
        gap = F.substring(held["text"], (pos - held["at"] + 1).cast("int"), (x["start"] - pos).cast("int"))
        label = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.when(x["start"] < pos, pos).otherwise(-x["stop"]), F.when(x["start"] < pos, none).otherwise(F.array(gap, label))

    spans = F.col(f"{own}spans")
    done = fold(spans, F.lit(0).cast("long"), step, none, near)
    clean = bound(done, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["pos"] + 1).cast("int"), F.length(text))))
    hit = F.size(spans) > 0
    out = with_spans(docs, prefix=own).withColumn(f"{own}spans", F.array_sort(key)).withColumn(f"{own}clean", F.when(hit, clean))
    new = {"text": F.when(hit, F.col(f"{own}clean")).otherwise(text), "n_chars": F.when(hit, F.length(f"{own}clean").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
