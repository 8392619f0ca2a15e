"""Language identification with string kernels.

The kernel of two texts is a blended spectrum of presence: for each length n of
1 to 3 bytes (of the lower-cased UTF-8 text), the number of distinct n-grams
that both hold, over the geometric mean of what each holds; the lengths are
averaged. Landmarks give a Nyström approximation of kernel ridge regression,
one against the rest for each language; a batch is scored by two matrix
products. A softmax says which language is nearest, not that any is near; for
that, the share of a text's distinct 3-grams that any landmark holds is
measured against what labelled rows of the language show.

Defined results: a text that is null or has no letter gets `und` with score 0;
texts are read whole; equal texts get equal predictions; of equal scores the
language first in order is taken; repeated rows give a row each; an empty table
gives an empty result; with no labelled row at all, every text gets `und`;
other columns are not read, so their names may be any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lean, plain

UNDETERMINED = "und"
LENGTHS = (1, 2, 3)
#: Texts that are scored by one matrix product, and landmark n-grams that one product takes.
BLOCK, PART = 256, 16384
#: Labelled rows set how much of a text may be unknown; so many times as much is let pass.
SLACK = 3.0
LETTER = re.compile(r"[^\W\d_]")


class Grams:
    """Distinct n-grams of a text: counted in order, and marked in tables of a byte for each possible one."""

    def __init__(self) -> None:
        self.seen = [np.zeros(256**n, np.uint8) for n in LENGTHS]
        self.mark = 0

    def codes(self, text: str) -> list[np.ndarray]:
        a = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int32)
        out = [a]
        for n in LENGTHS[1:]:
            out.append((out[-1][:-1] << 8) | a[n - 1 :] if len(a) >= n else a[:0])
        return out

    def stamp(self, text: str) -> tuple[int, list[int]]:
        """The mark of this text's n-grams and the number of distinct ones by length."""
        if self.mark == 255:
            for table in self.seen:
                table.fill(0)
            self.mark = 0
        self.mark += 1
        count = []
        for table, c in zip(self.seen, self.codes(text)):
            table[c] = self.mark
            c.sort()
            count.append(int((c[1:] != c[:-1]).sum()) + (len(c) > 0))
        return self.mark, count


@dataclass
class Model:
    """Landmark n-grams (by length), which landmark holds which (one byte each), their norms, and the weights."""

    langs: list[str]
    vocab: list[np.ndarray]
    marks: list[np.ndarray]
    norms: list[np.ndarray]
    weights: np.ndarray
    #: The least share of known 3-grams by language.
    least: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def kernel(self, texts: list[str], grams: Grams) -> np.ndarray:
        """Rows: texts; columns: landmarks."""
        return self.measure(texts, grams)[0]

    def measure(self, texts: list[str], grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """The kernel, and each text's share of distinct n-grams of the greatest length that landmarks hold."""
        k = np.zeros((len(texts), len(self.norms[0])), np.float32)
        held = [np.zeros((len(texts), len(v)), np.bool_) for v in self.vocab]
        size = np.ones((len(texts), len(LENGTHS)), np.float32)
        for i, text in enumerate(texts):
            mark, count = grams.stamp(text)
            size[i] = np.maximum(count, 1)
            for n, v in enumerate(self.vocab):
                held[n][i] = grams.seen[n][v] == mark
        for n, m in enumerate(self.marks):
            both = np.zeros_like(k)
            for at in range(0, len(m), PART):
                both += held[n][:, at : at + PART].astype(np.float32) @ m[at : at + PART].astype(np.float32)
            k += both * self.norms[n] / np.sqrt(size[:, n : n + 1])
        return k / len(LENGTHS), held[-1].sum(1) / size[:, -1]

    def predict(self, texts: list[str | None], grams: Grams, block: int = BLOCK) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and whether a text is as near to its language as labelled rows are."""
        names, score, near = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not self.langs:
            return names, score, near
        there = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        for at in range(0, len(there), block):
            part = there[at : at + block]
            k, known = self.measure([texts[i] for i in part], grams)
            f = k.astype(np.float64) @ self.weights
            p = np.exp(6 * (f - f.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            near[part] = known >= self.least[best]
            for i, b, row in zip(part, best, p):
                names[i], score[i] = self.langs[b], round(float(row[b]), 6)
        return names, score, near


def labelled_sample(docs: DataFrame, per_lang: int, max_rows: int, max_bytes: int) -> list[tuple[str, str]]:
    """(lang, text) of labelled rows by a hash of id and text: per_lang rows and max_bytes of text for each language, one at least.

    Fewer rows each, but one, where languages times per_lang are over max_rows.
    Only rows with a language whose crc32(doc_id) mod 5 is not 0. A first pass
    counts the rows of each language; the second lets pass those whose hash
    lies below a share of some times per_lang, so that no task orders more
    of a language than that.
    """
    own = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(
        "lang is not null and text is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 != 0"
    )
    own = own.filter(F.regexp_like("text", F.lit(r"\p{L}"))).withColumn("mark", F.xxhash64("doc_id", "text"))
    # From 0 to 1, evenly.
    share = F.col("mark") / 2.0**64 + 0.5
    seen = own.groupBy("lang").agg(F.count("*").alias("n"), F.min("mark").alias("first")).collect()  # a row for each language
    if not seen:
        return []
    per_lang = max(1, min(per_lang, max_rows // len(seen)))
    cut = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 8.0 * per_lang / r.n + 1e-9), r.first) for r in seen], "lang string, cut double, first bigint")
    few = own.join(F.broadcast(cut), "lang").filter((share <= F.col("cut")) | (F.col("mark") == F.col("first")))
    order = Window.partitionBy("lang").orderBy("mark", "doc_id", "text")
    few = few.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_lang)
    bytes_so_far = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = few.withColumn("held", bytes_so_far).filter((F.col("held") <= max_bytes) | (F.col("nth") == 1))
    got = few.select("lang", "nth", "text").collect()  # max_rows rows and max_bytes for each language at most
    return [(r.lang, r.text) for r in sorted(got, key=lambda r: (r.lang, r.nth))]


def fit(sample: list[tuple[str, str]], landmarks_per_lang: int = 32, ridge: float = 1e-4) -> Model:
    """Nyström kernel ridge regression on the sample; its first rows of each language are landmarks."""
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return Model([], [], [], [], np.zeros((0, 0)))
    number = {lang: j for j, lang in enumerate(langs)}
    own = np.array([number[lang] for lang, _ in sample])
    taken, marked = dict.fromkeys(langs, 0), []
    for at, (lang, _) in enumerate(sample):
        if taken[lang] < landmarks_per_lang:
            taken[lang] += 1
            marked.append(at)
    grams = Grams()
    marks = [sample[at][1] for at in marked]
    vocab, held, norms = [], [], []
    for n in range(len(LENGTHS)):
        sets = [np.unique(grams.codes(t)[n]) for t in marks]
        v = np.unique(np.concatenate(sets))
        m = np.zeros((len(v), len(marks)), np.uint8)
        for j, s in enumerate(sets):
            m[np.searchsorted(v, s), j] = 1
        vocab.append(v)
        held.append(m)
        norms.append(np.array([1 / np.sqrt(max(1, len(s))) for s in sets], np.float32))
    model = Model(langs, vocab, held, norms, np.zeros((len(marks), len(langs))))
    k_mm = model.kernel(marks, grams).astype(np.float64)
    a, b = ridge * len(sample) * k_mm, np.zeros_like(model.weights)
    known = np.zeros(len(sample))
    # Each language weighs the same, however many rows it has.
    weight = (len(sample) / len(langs) / np.bincount(own))[own][:, None]
    for at in range(0, len(sample), BLOCK):
        cut = slice(at, at + BLOCK)
        k, known[cut] = model.measure([t for _, t in sample[cut]], grams)
        k = k.astype(np.float64)
        y = np.where(own[cut][:, None] == np.arange(len(langs)), 1.0, -1.0)
        a += k.T @ (weight[cut] * k)
        b += k.T @ (weight[cut] * y)
    model.weights = np.linalg.lstsq(a + 1e-8 * np.eye(len(a)), b, rcond=None)[0]
    # A landmark is measured against the other landmarks, as it knows all of its own.
    others = held[-1].sum(1, dtype=np.int64) > 1
    known[marked] = [others[held[-1][:, j] > 0].mean() if held[-1][:, j].any() else 0.0 for j in range(len(marks))]
    # SLACK times the unknown share that one in a hundred labelled rows exceeds.
    model.least = np.array([1 - SLACK * (1 - np.quantile(known[own == j], 0.01)) for j in range(len(langs))])
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """ident, lang_pred, score and near (whether the text is near its language at all) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(plain(ident).alias(ident), plain(text).alias(f"{ident}_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                names, score, near = shared.value.predict(part.column(1).to_pylist(), grams)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(near)], [ident, "lang_pred", "score", "near"]
                )

    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(lean(run), f"`{ident}` {kind}, lang_pred string, score double, near boolean")


def told(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language can be told and whose text is near it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                names, _, near = shared.value.predict(part.column(where).to_pylist(), grams)
                yield part.filter(pa.array([x != UNDETERMINED and bool(y) for x, y in zip(names, near)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def train(docs: DataFrame, per_lang: int = 400, max_rows: int = 25600, max_bytes: int = 8_000_000, landmarks: int = 256) -> Model:
    """A model from docs' own labelled rows; the bounds of the sample are the parameters.

    landmarks: of all languages together, 32 each at most and one at least.
    """
    sample = labelled_sample(docs, per_lang, max_rows, max_bytes)
    return fit(sample, max(1, min(32, landmarks // max(1, len({lang for lang, _ in sample})))))
