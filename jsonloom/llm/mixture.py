"""Mixing sources of documents to target weights, measured in tokens."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.text import normal_form
from jsonloom.operators.redelivery import quoted, spare_names
from jsonloom.session import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SMALL_TARGETS = 10_000  # a target table of more rows isn't broadcast

#: Fixed value: the public pattern by which this vocabulary's pre-tokenizer cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]{1000,}")
_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def _tiktoken_counts(path: str) -> Callable[[list[str]], list[int]]:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        # Long runs of white space overflow the pattern's stack. They are pieces of their own: all of the
        # run at the end of a text, else all but its last character.
        total = last = 0
        for m in _BLANKS.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            total += len(enc.encode_ordinary(text[last : m.start()])) + len(enc._encode_single_piece(text[m.start() : end]))
            last = end
        return total + len(enc.encode_ordinary(text[last:]))

    return lambda texts: [count(t) for t in texts]


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts tokens; loaded once in each Python worker."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            _loaded[path] = _tiktoken_counts(path)
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _loaded[path] = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(s.encode(x, num_threads=1)) for x in texts]
    return _loaded[path]


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a whole text; 0 for an empty one and for NULL. ``tokenizer``: path of a vocabulary file
    (.tiktoken, .json or .model), the same on every executor."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(tokenizer)
        for s in batches:
            yield pd.Series(counter(s.tolist()), dtype="int64")

    return count(F.coalesce(text.cast("string"), F.lit("")))


def source_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, target_share, total_tokens, source_tokens, target_tokens, max_repeat, wanted_rate,
    rate, reachable), a row for each source of ``targets``.

    sizes: (source in normal form or NULL, n_tokens), one row a document. total_tokens counts all of
        them. wanted_rate: how often the source would have to be used to have its share of the total
        (NULL for an empty source); rate: that, but at most max_repeat.
    targets: (source, weight, max_repeat). NULL or negative weights count as 0, NULL max_repeat as 1;
        sources are in normal form after this, repeated ones add up their weights and take the larger
        max_repeat; without any weight every target is 0 and reachable."""
    # used twice below: written once, a row a source, so that no text is tokenized twice
    per = stage(sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens")), "sources")
    total = F.lit(per.agg(F.sum("source_tokens")).first()[0] or 0).cast("bigint")
    want = (
        targets.select(
            normal_form(F.col("source")).alias("source"),
            F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"),
            F.greatest(F.coalesce(F.col("max_repeat").cast("bigint"), F.lit(1)), F.lit(0)).alias("max_repeat"),
        )
        .where("source is not null")
        .groupBy("source")
        .agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"))
    )
    weights = F.lit(float(want.agg(F.sum("weight")).first()[0] or 0.0))
    one = want.join(per, "source", "left").withColumn("total_tokens", total).withColumn("weights", weights)
    size = F.coalesce(F.col("source_tokens"), F.lit(0))
    target = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(F.lit(0.0))
    reachable = size * F.col("max_repeat") * F.col("weights") >= F.col("weight") * F.col("total_tokens")  # without a division's rounding
    rated = one.select(
        "source", "weight", target.alias("target_share"), "total_tokens", size.alias("source_tokens"), (target * F.col("total_tokens")).alias("target_tokens"),
        "max_repeat", reachable.alias("reachable"),
    ).withColumn("wanted_rate", F.when(F.col("source_tokens") > 0, F.col("target_tokens") / F.col("source_tokens")))
    return rated.withColumn("rate", F.when(F.col("wanted_rate").isNotNull(), F.least("wanted_rate", F.col("max_repeat").cast("double"))))


def mixture(documents: DataFrame, rates: DataFrame, *, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """``documents`` (with source in normal form) times their rate, numbered by ``copy`` from 1.

    Documents: (doc_id, source, ...), any more columns but ``copy`` (ValueError). A NULL key draws like any
    other value, repeated keys draw alike. Every document comes floor(rate) times, and once more if a hash of (key, seed) falls below the
    fraction: the same draw on every run, whatever the partitioning. Documents of other sources, and of
    sources with rate 0, don't come. Nothing is exchanged: the rates join by broadcast (their number is
    checked) and each document decides alone, so a source with most of the rows costs no task more."""
    if "copy" in {c.lower() for c in documents.columns}:
        raise ValueError("the documents already have a column copy")
    rate, copies = spare_names(documents, "rate_", "copies_")
    few = rates.select("source").limit(SMALL_TARGETS + 1).count() <= SMALL_TARGETS
    r = rates.where("rate > 0").select("source", F.col("rate").alias(rate))
    joined = documents.join(F.broadcast(r) if few else r, "source")
    draw = F.shiftrightunsigned(F.xxhash64(F.col(quoted(key)), F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    whole = F.floor(F.col(rate))
    out = joined.withColumn(copies, (whole + F.when(draw < F.col(rate) - whole, 1).otherwise(0)).cast("int")).where(F.col(copies) > 0)
    return out.select(*[quoted(c) for c in documents.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias("copy"))


def mixture_shares(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """What came out: (source, target_share, rate, documents, mixed_tokens, actual_share, reachable)."""
    got = stage(mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("mixed_tokens")), "mixed")  # a row a source
    total = got.agg(F.sum("mixed_tokens")).first()[0] or 0
    out = rates.join(got, "source", "left")
    tokens = F.coalesce(F.col("mixed_tokens"), F.lit(0))
    share = tokens / F.lit(float(total)) if total else F.lit(0.0)
    return out.select(
        "source", "target_share", "rate", F.coalesce("documents", F.lit(0)).alias("documents"), tokens.alias("mixed_tokens"), share.alias("actual_share"), "reachable"
    )


def sized(documents: DataFrame, tokenizer: str = TOKENIZER, *keep: Any) -> DataFrame:
    """(doc_id, source in normal form, n_tokens, keep...)."""
    return documents.select("doc_id", normal_form(F.col("source")).alias("source"), token_count(F.col("text"), tokenizer).alias("n_tokens"), *keep)
