"""Token counts through a digest cache.

Every text is digested together with the tokenizer's version; digests are joined to
stored counts, the distinct misses alone are encoded, and their counts are appended to
the cache. The content is normalised to its UTF-8 bytes with null as the empty text and
no further, since any other folding could change the count.

Edges. Null and empty texts have no bytes and no tokens. Copies and repeated rows share
one digest and are encoded once. Whole texts are encoded, however long. An empty table
gives an empty result and appends nothing. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import prepare, shared_dir, stash, text_bytes

#: A blank that stands alone between characters that are no white space.
ALONE = re.compile(r" (?<=\S )(?=\S)")
#: Units, and digests, that a worker remembers at a time.
MEMORY = 300_000
CACHE = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Counter:
    """Token counts of texts by the tokenizers library, unit by unit.

    Byte-level BPE splits a text before every blank that stands alone between other
    characters, and special strings hold no blank, so a text's count is the sum of its
    units' counts, a unit being the stretch from one such blank up to the next. Units come
    again and again and are encoded once while a worker remembers them.

    That is read from the tokenizer's own description: byte-level pieces by the usual pattern,
    no blank put before a text, no normaliser, no added token that holds white space or eats
    the white space beside it. Texts of any other tokenizer are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self.by_unit = self._splits_at_blanks(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _splits_at_blanks(config: dict) -> bool:
        pre = config.get("pre_tokenizer") or {}
        added = config.get("added_tokens") or []
        return (
            config.get("normalizer") is None
            and config.get("model", {}).get("type") == "BPE"
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )

    def encoded(self, units: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_unit:
            return self.encoded(texts)
        split = [ALONE.split(t) for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        new = list(set(itertools.chain.from_iterable(x[1:] for x in split)).difference(known))
        known.update(zip(new, self.encoded([" " + u for u in new])))
        heads = self.encoded([x[0] for x in split])
        return [h + sum(map(known.__getitem__, x[1:])) for h, x in zip(heads, split)]


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        seen: set[bytes] = set()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                new = []
                for d in part.column(0).to_pylist():  # repeated rows lie together; those missed are dropped below
                    new.append(d not in seen)
                    seen.add(d)
                if len(seen) > MEMORY:
                    seen.clear()
                part = part.filter(pa.array(new, pa.bool_()))
                counts = counter.count([x.as_py().decode("utf-8", "replace") for x in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return encode


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    ``cache`` is a folder in shared storage to keep between runs; without one, a fresh
    cache lives in the shared folder for this call.
    """
    spark = docs.sparkSession
    prepare(spark)
    version = tokenizer_version(tokenizer)
    cache = cache or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    table = f"{cache}/{version}"
    # The folder must exist to be read, so an empty append opens it.
    spark.createDataFrame([], CACHE).write.mode("append").parquet(table)
    text = text_bytes()
    keys = stash(
        docs.select(
            "doc_id",
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.unhex(F.sha2(F.concat(F.lit(version.encode()), text), 256)).alias("digest"),
        ),
        "tokens",
    )
    stored = spark.read.schema(CACHE).parquet(table)
    # One document stands for each digest that the cache lacks. Documents meet their
    # stand-in's id, so no digest that a third of the rows share gathers their texts.
    misses = keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored, "digest", "left_anti")
    texts = docs.select("doc_id", text.alias("text"))
    fresh = (
        texts.join(misses.where("doc_id IS NOT NULL"), "doc_id")
        # Rows that share an id need not share their text.
        .where(F.unhex(F.sha2(F.concat(F.lit(version.encode()), F.col("text")), 256)) == F.col("digest"))
        .select("digest", "text")
    )
    lone = texts.where("doc_id IS NULL").select(
        F.unhex(F.sha2(F.concat(F.lit(version.encode()), F.col("text")), 256)).alias("digest"), "text"
    ).join(misses.where("doc_id IS NULL").select("digest"), "digest", "left_semi")
    fresh.unionByName(lone).mapInArrow(_encoder(tokenizer), CACHE).dropDuplicates(["digest"]).write.mode("append").parquet(table)
    counts = spark.read.schema(CACHE).parquet(table).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = stash(counts, "counts")
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
