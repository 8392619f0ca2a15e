"""Quality rules with adaptive thresholds.

Base counts of every text, then six ratios. For each language and source a
quantile sketch of each ratio is kept: counts of logarithmic buckets of a fixed
relative width, so that sketches merge by adding counts and a merged sketch
does not depend on how rows were dealt out. A ratio fails where it lies beyond
an outlier fence of its own group's quantiles: a tail quantile plus a multiple
of its distance from the median, or, where even the tail is zero, a quantile of
the values above zero; no constant value takes part. A group with few rows is
judged by the merged sketch of its language, or of all. Thresholds join back to
the rows.

Words are runs of bytes other than blank and U+0009 to U+000D.

Defined results: null and empty texts have zero words and fail the base rule;
null language or source is a group of its own; ties at a fence are kept; an
empty table gives an empty result; columns other than doc_id, text, lang and
source are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, materialise

#: Relative width of a bucket: quantiles are right to about 1 %.
GAMMA = 1.02
#: Values up to this one share the lowest bucket.
LEAST = 1e-4
#: Groups whose sketch of a ratio has fewer rows borrow that of their language, then of all.
LEAST_ROWS = 50
#: The tail begins at this quantile; a fence lies FENCE times as far beyond it as it lies from the median.
TAIL, FENCE = 0.9, 1.5
#: Where the tail is zero, few texts have any at all; the fence is this quantile of those that have.
#: Symbols are hardly found in prose; a few repeated lines or words are.
SPARSE = {"symbols": 0.1, "dup_lines": 0.75, "repeats": 0.75, "stutters": 0.5, "long_words": 0.5, "short_words": 0.5}
RATIOS = ("symbols", "dup_lines", "repeats", "stutters", "long_words", "short_words")
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a WINDOW-word window found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    # Equal hashes are compared word by word, so a collision counts nothing.
    views = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    a, b = order[:-1][same], order[1:][same]
    true = np.ones(len(a), bool)
    for at in range(0, len(a), 65536):
        true[at : at + 65536] = (views[a[at : at + 65536]] == views[b[at : at + 65536]]).all(1)
    hit = np.zeros(len(ids) + 1, np.int64)
    starts = np.unique(np.concatenate([a[true], b[true]]))
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + WINDOW, -1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


def count(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stutters (words equal to the one before)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    repeats = repeated_words(ids) if len(known) < len(words) else 0
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, int((ids[1:] == ids[:-1]).sum())


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutters")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, and the base counts of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = np.array([count(t) for t in part.column(3).to_pylist()], np.int64).reshape(-1, len(BASE))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), *[pa.array(got[:, k]) for k in range(len(BASE))]],
                    ["doc_id", "lang", "source", *BASE],
                )

    own = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in BASE)
    return own.mapInArrow(lean(run), f"doc_id {kind}, lang string, source string, {counts}")


def ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") * 10.0 / words,
        "repeats": F.col("n_repeat_words") / words,
        "stutters": F.col("n_stutters") / words,
        "long_words": mean,
        "short_words": 20.0 / F.greatest(mean, F.lit(0.01)),
    }


def bucket(x: Column) -> Column:
    """The sketch bucket of a value at or above 0."""
    return F.when(x <= LEAST, F.lit(0)).otherwise(F.ceil(F.log(x / LEAST) / math.log(GAMMA)).cast("int"))


def bucket_value(b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.lit(LEAST) * F.pow(F.lit(GAMMA), b - 0.5))


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n: one mergeable sketch per group and ratio.

    Summed in every map task first, so a hot group costs each task one row per bucket.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(v).alias("bucket")) for k, v in ratios().items()]))
    return (
        counted.filter(~F.col("base_failed"))
        .select("lang", "source", each.alias("x"))
        .groupBy("lang", "source", "x.ratio", "x.bucket")
        .agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """q50, tail and rows of each merged sketch by keys and ratio. A sketch has some hundreds of buckets at most."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    grouped = merged.groupBy(*keys, "ratio").agg(
        F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b")
    )

    def at(rank: Column) -> Column:
        # The first bucket whose running count reaches the rank.
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("at"))
        got = F.aggregate(
            "b",
            start,
            lambda s, x: F.struct(
                (s["seen"] + x["n"]).alias("seen"),
                F.coalesce(s["at"], F.when(s["seen"] + x["n"] >= rank, x["bucket"])).alias("at"),
            ),
        )
        return bucket_value(got["at"])

    zeros = F.coalesce(F.aggregate(F.filter("b", lambda x: x["bucket"] == 0), F.lit(0).cast("bigint"), lambda s, x: s + x["n"]), F.lit(0))
    sparse = F.create_map(*[F.lit(x) for kv in SPARSE.items() for x in kv])[F.col("ratio")]
    some = F.when(zeros < F.col("rows"), at(zeros + F.greatest(F.ceil((F.col("rows") - zeros) * sparse), F.lit(1))))
    q50, tail = at(F.ceil(F.col("rows") * 0.5)), at(F.ceil(F.col("rows") * TAIL))
    fence = F.when(tail > 0, tail + F.lit(FENCE) * (tail - q50)).otherwise(some)
    # The upper edge of the bucket, so that values of one bucket fare alike.
    return grouped.select(*keys, "ratio", "rows", q50.alias("q50"), tail.alias("tail"), (fence * GAMMA).alias("fence"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and the fence of each ratio (none where no text has any), from the group's own sketch or a merged one."""
    own = quantiles(sketch, ["lang", "source"])
    lang = quantiles(sketch, ["lang"]).select(
        F.col("lang").alias("l"), F.col("ratio").alias("r"), F.col("rows").alias("l_rows"), F.col("fence").alias("l_fence")
    )
    every = quantiles(sketch, []).select(F.col("ratio").alias("e"), F.col("fence").alias("e_fence"))
    both = own.join(lang, own["lang"].eqNullSafe(lang["l"]) & (own["ratio"] == lang["r"]))
    both = both.join(F.broadcast(every), F.col("ratio") == F.col("e"))  # one row for each of six ratios
    top = F.when(F.col("rows") >= LEAST_ROWS, F.col("fence")).when(F.col("l_rows") >= LEAST_ROWS, F.col("l_fence")).otherwise(F.col("e_fence"))
    return both.select("lang", "source", "ratio", top.alias("top")).groupBy("lang", "source").pivot("ratio", list(RATIOS)).agg(F.max("top"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, base counts, base_failed, the fences and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = materialise(base_counts(docs).withColumn("base_failed", failed), "quality-counts")
    limit = thresholds(sketches(counted))
    limit = limit.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[F.col(k).alias(f"top_{k}") for k in RATIOS])
    rows = counted.join(
        limit, counted["lang"].eqNullSafe(limit["g_lang"]) & counted["source"].eqNullSafe(limit["g_source"]), "left"
    )
    fine = F.lit(True)
    for k, v in ratios().items():
        fine = fine & (v <= F.coalesce(F.col(f"top_{k}"), F.lit(float("inf"))))
    return rows.withColumn("kept", ~F.col("base_failed") & fine).drop("g_lang", "g_source")
