"""Mixing sources to target shares by hash thresholds (problem 8)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bits of the hash that one histogram resolves, and histograms before the boundary bucket is taken row by row.
BITS, LEVELS = 10, 4

_encoders: dict = {}

#: The split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """docs (without text) with `tokens`, in place of any such column: the tokens of the whole text, 0 for an empty or null one.

    path is the vocabulary's, on the driver; executors that don't have it there get it from the driver.
    """
    docs.sparkSession.sparkContext.addFile(path)
    docs = docs.drop("tokens")
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep, F.lit(0).cast("long").alias("tokens")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield pdf[keep].assign(tokens=pd.Series(n, dtype="int64", index=pdf.index))

    return docs.mapInPandas(run, schema)


def proper_source(name: str = "source"):
    """A source in its proper spelling: lower case, words joined by one underscore."""
    return F.regexp_replace(F.lower(F.trim(F.col(name))), r"[\s\-_]+", "_")


def mix_sources(records: DataFrame, weights: DataFrame, size: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(mix, report): how often each record is taken so that sources reach their shares of `size` tokens.

    records: id (unique), source, tokens, counted once by a tokenizer; weights: source, target_share, max_repeats.
    size is the tokens of all records unless given. A source is to give target_share * size tokens: whole copies of
    all its records, at most max_repeats (0 or null count as 1), and of one more copy the records whose hash is below a
    threshold. The threshold is found without sorting: tokens are summed by source and the hash's first BITS bits, the
    running sum tells the bucket where the budget ends, and only that bucket is summed again by its next bits. Thresholds are
    nested: a larger budget takes every record that a smaller one took. After LEVELS histograms the bucket is
    cut through whole, so a share misses by less than the largest record, unless equal hashes meet; refining ends
    earlier where no boundary bucket has more than one record, as that one doesn't fit anyway.

    Sources that weights don't name, and null sources, are not drawn and reported with target 0; a weight
    without records is reported short. mix: id, source, tokens, copies (>= 1). report: source, target_share, max_repeats,
    available, wanted, mixed, actual_share, shortfall.
    """
    w = weights.filter("source is not null").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("max_repeats")
    )
    r = records.select("id", "source", "tokens", F.xxhash64(F.lit(seed), "id").alias("h"))
    r = r.withColumn("h", F.shiftrightunsigned("h", 64 - BITS * LEVELS))
    sums = materialize(r.groupBy("source", F.shiftright("h", BITS * (LEVELS - 1)).alias("b")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")))
    have = sums.groupBy("source").agg(F.sum("t").alias("available"))
    total = size if size is not None else (have.agg(F.sum("available")).first()[0] or 0)
    goal = w.join(have, "source", "left").withColumns(
        {"available": F.coalesce("available", F.lit(0)), "wanted": F.coalesce("target_share", F.lit(0.0)) * F.lit(float(total))}
    )
    give = F.least(F.col("wanted"), F.col("available").cast("double") * F.col("max_repeats"))
    goal = goal.withColumn("whole", F.when(F.col("available") > 0, F.floor(give / F.col("available"))).otherwise(0).cast("int"))
    goal = materialize(goal.withColumn("budget", give - F.col("whole") * F.col("available")))
    # low: every hash below it is taken in the last, partial copy; used: the tokens of those records.
    state = goal.select("source", "budget", F.lit(0).cast("long").alias("low"), F.lit(0.0).alias("used"))
    hist = sums.withColumnRenamed("b", "at")
    for level in range(LEVELS):
        step = 1 << (BITS * (LEVELS - 1 - level))
        if level:
            # Of each source only the boundary bucket of the level before, [low, low + 2**BITS * step), is read again.
            inside = r.join(state.select("source", "low"), "source").filter((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + (step << BITS)))
            hist = inside.groupBy("source", F.expr(f"(h - low) div {step}").alias("at")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        by = Window.partitionBy("source").orderBy("at")
        run = hist.withColumn("cum", F.sum("t").over(by))
        fits = run.join(state.select("source", "budget", "used"), "source").filter(F.col("used") + F.col("cum") > F.col("budget"))
        # The first bucket that doesn't fit holds the boundary; where all fit, the boundary is at the end.
        edge = fits.groupBy("source").agg(F.min("at").alias("at"), F.min(F.struct("at", "cum", "t", "n")).alias("x"))
        edge = edge.select("source", "at", (F.col("x.cum") - F.col("x.t")).alias("before"), F.col("x.n").alias("many"))
        ends = hist.groupBy("source").agg(F.sum("t").alias("all"))
        state = materialize(
            state.drop("many").join(edge, "source", "left").join(ends, "source", "left").select(
                "source", "budget",
                F.when(F.col("at").isNotNull(), F.col("low") + F.col("at") * step).otherwise(F.col("low") + (step << BITS)).alias("low"),
                (F.col("used") + F.coalesce(F.when(F.col("at").isNotNull(), F.col("before")).otherwise(F.col("all")), F.lit(0))).alias("used"),
                "many",
            )
        )
        if state.filter("many > 1").isEmpty():
            break
    cut = goal.select("source", "whole").join(state.select("source", "low"), "source")
    mix = (
        r.join(cut, "source").withColumn("copies", F.col("whole") + (F.col("h") < F.col("low")).cast("int"))
        .filter("copies > 0").select("id", "source", "tokens", "copies")
    )
    mixed = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
    unnamed = have.join(w, "source", "left_anti").select(
        "source", F.lit(0.0).alias("target_share"), F.lit(0).alias("max_repeats"), "available", F.lit(0.0).alias("wanted")
    )
    report = goal.select("source", "target_share", "max_repeats", "available", "wanted").union(unnamed).join(mixed, "source", "left")
    report = materialize(report.withColumn("mixed", F.coalesce("mixed", F.lit(0))))
    whole = report.agg(F.sum("mixed").alias("m"))
    report = report.select(
        "*", (F.col("mixed") / F.nullif(whole.scalar(), F.lit(0))).alias("actual_share"),
        F.greatest(F.lit(0.0), F.col("wanted") - F.col("available") * F.col("max_repeats")).alias("shortfall"),
    )
    return mix, report
