"""Token counts by a map-side lookup in two tiers.

A byte-level BPE cuts a text into pre-tokens and merges inside each of them, so a text's count is
the sum of its pre-tokens' counts, and most pre-tokens are repetitions of a few.  Tier one is a
compact table of frequent pre-tokens and their counts, broadcast to all tasks; tier two is a cache
in each worker for the rest, which asks the library.  Texts are counted where they are read and
pre-tokens are never shuffled.  Which pre-tokens stand in the table decides speed, not counts.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import bounded_batches, latest

# How a byte-level BPE cuts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The sample the table is made from: about so many texts, none longer than so many bytes, and the
# most entries (each of at most LONGEST characters) the table takes from it.
SAMPLE_TEXTS = 2_000
SAMPLE_TEXT_BYTES = 8_192
TABLE_ENTRIES = 32_768
LONGEST = 64
# Entries of a worker's cache; it starts anew beyond them.
CACHE_ENTRIES = 200_000
# Pre-tokens looked up at once.
_BLOCK = 100_000


class ByteBpe:
    """Pre-tokens of a byte-level BPE file and their token counts, as ``tokenizers`` gives them.

    Characters of which the library and this module's pattern may hold different views (they
    follow different Unicode versions) are found by asking the library when first met; texts that
    hold one are cut by the library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.agreed, self.disputed = {*map(chr, range(128))}, set()

    def _agree(self, text: str) -> bool:
        if text.isascii():
            return True
        for c in set(text) - self.agreed - self.disputed:
            probe = f"a{c}b1{c}2 {c} .{c}."
            ours = [m.span() for m in self.pattern.finditer(probe)]
            theirs = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(probe)]
            (self.agreed if ours == theirs else self.disputed).add(c)
        return not self.disputed or self.disputed.isdisjoint(text)

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text without special tokens, in lists of bounded length."""
        if not self._agree(text):
            spans = self.library.pre_tokenizer.pre_tokenize_str(text)
            yield [text[a:b] for _, (a, b) in spans]
        elif len(text) < _BLOCK:
            yield self.pattern.findall(text)
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            while part := list(itertools.islice(found, _BLOCK)):
                yield part

    def lengths(self, pre_tokens: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch(pre_tokens, add_special_tokens=False)]

    def parts(self, text: str) -> tuple[int, list[str]]:
        """How many special tokens a text holds, and the texts between them."""
        if self.special is None:
            return 0, [text]
        between = self.special.split(text)
        return len(between) - 1, between


class Lookup(dict):
    """Tier one; what it lacks is looked up in the worker's cache and at last in the library."""

    def __init__(self, bpe: ByteBpe, table: dict[str, int]) -> None:
        super().__init__(table)
        self.bpe = bpe
        self.cache: dict[str, int] = {}
        self.asked = 0  # how often the library had to count

    def __missing__(self, pre_token: str) -> int:
        if pre_token in self.cache:
            return self.cache[pre_token]
        return self._learn([pre_token])[0]

    def _learn(self, pre_tokens: list[str]) -> list[int]:
        self.asked += len(pre_tokens)
        found = self.bpe.lengths(pre_tokens)
        if len(self.cache) + len(pre_tokens) > CACHE_ENTRIES:
            self.cache.clear()
        self.cache.update((p, n) for p, n in zip(pre_tokens, found) if len(p) <= LONGEST)
        return found

    def count(self, text: str) -> int:
        total, between = self.bpe.parts(text)
        for part in between:
            for block in self.bpe.pre_tokens(part):
                new = [p for p in set(block) if p not in self and p not in self.cache and len(p) <= LONGEST]
                if new:
                    self._learn(new)
                total += sum(map(self.__getitem__, block))
        return total


def _check(path: str) -> None:
    """Refuse files whose pre-tokens are not counted one by one."""
    with open(path, encoding="utf-8") as text:
        made = json.load(text)
    cut = made.get("pre_tokenizer") or {}
    plain = (
        made.get("normalizer") is None
        and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True)
        and not cut.get("add_prefix_space")
        and made["model"].get("type") == "BPE"
        and not made["model"].get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in made.get("added_tokens", []))
    )
    if not plain:
        raise ValueError(f"{path} is not a byte-level BPE without normalisation")


def frequent(
    texts: DataFrame, tokenizer_path: str, text_column: str = "text", sample: int = SAMPLE_TEXTS, entries: int = TABLE_ENTRIES
) -> pa.Table:
    """The most frequent ``pre_token`` of a sample of the texts, each with its ``n_tokens``.

    The sample is spread over the table by a hash of the text; one task counts it.
    """
    known = texts.where(F.col(text_column).isNotNull() & (F.octet_length(text_column) <= SAMPLE_TEXT_BYTES))
    # COUNT(*) over the source is metadata; the share is taken of all texts, so it may find fewer
    share = F.greatest(F.lit(1), F.expr(f"cast(n div {sample} as bigint)"))
    every = texts.agg(F.count(F.lit(1)).alias("n")).select(share.alias("share")).first()["share"]
    chosen = known.where(F.pmod(F.xxhash64(text_column), F.lit(every)) == 0).select(text_column).limit(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokenizer_path)
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in bpe.parts(text)[1]:
                    for block in bpe.pre_tokens(part):
                        seen.update(p for p in block if len(p) <= LONGEST)
        most = heapq.nsmallest(entries, ((-n, p) for p, n in seen.items()))
        names = [p for _, p in most]
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(bpe.lengths(names), pa.int32())], names=["pre_token", "n_tokens"])

    return chosen.coalesce(1).mapInArrow(count, "pre_token string, n_tokens int").toArrow()


def n_tokens(documents: DataFrame, tokenizer_path: str, text_column: str = "text", entries: int = TABLE_ENTRIES) -> Column:
    """A column with the number of tokens of ``text_column``; NULL counts as empty."""
    spark = documents.sparkSession
    bounded_batches(spark)
    _check(tokenizer_path)
    table = frequent(documents, tokenizer_path, text_column, entries=entries)
    shipped = spark.sparkContext.broadcast((table["pre_token"].to_pylist(), table["n_tokens"].to_pylist()))
    version = uuid.uuid4().hex

    def lookup() -> Lookup:
        return Lookup(ByteBpe(tokenizer_path), dict(zip(*shipped.value)))

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        table = latest("token counts", version, lookup)
        return pa.array([table.count(t.as_py() or "") for t in texts], pa.int64())

    return count(F.col(text_column))


def token_counts(
    documents: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024
) -> DataFrame:
    """Id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    Counts are those of ``tokenizers`` for whole texts without added tokens; a special token's
    string inside a text counts as that token, which is the library's default.  NULL text counts
    as empty; repeated rows and NULL ids stay as they are; other columns are not looked at.
    """
    counted = documents.select(
        F.col(id_column),
        F.coalesce(F.octet_length(text_column), F.lit(0)).cast("bigint").alias("n_bytes"),
        n_tokens(documents, tokenizer_path, text_column).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
