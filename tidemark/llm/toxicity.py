"""Toxicity by maximum-scoring segments.

Each word has a log-odds score (toxic against clean) under an informative
Dirichlet prior: the background frequencies of all words of the sample, with a
mass that is a share of the sample's own. Words are scored by themselves and
by their first four or five letters, so that inflected forms of a stem count.
A linear scan finds every maximal scoring segment of a text; a segment is
significant where its expected number in clean text of that length is small.
That number follows the extreme-value law of such segments, K * n * exp(-l * s):
l solves the law's equation for the words' chances in clean text, K is the
likeliest value for the best segments of the sample's clean rows, those without
a segment counted as censored. The best segment and the number of significant
ones give the score by a logistic curve fitted on the sample.

Defined results: null and empty texts have no segment and get the score of a
text without one; texts are read whole; equal texts get equal scores; repeated
rows give a row each; of segments that could be one or two, the shorter ones
stay; with no labelled row every score is 0; an empty table gives an empty
result; other columns are not read, so their names may be any.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, materialise, plain

WORD = re.compile(r"[^\W\d_]+")
#: Mass of the prior as a share of the tokens counted.
PRIOR = 0.1
#: A clean row weighs so many toxic ones in the curve: a filter should leave clean documents alone.
CLEAN_WEIGHT = 2.0
#: Tokens count with at least this z value and these log-odds.
LEAST_Z, LEAST_ODDS = 3.0, 2.0
#: Segments count with at most this expected number in clean text.
MOST_EXPECTED = 0.05


def segments(at: list[int], gain: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in linear time: (first, last, score) by word position.

    at: the positions with a gain, ascending; every word between costs `cost`.
    The stack has for each segment its ends, the running total before and after
    it, and a link to the nearest earlier one that begins lower. A walk follows
    the links; what it passes is either merged or behind a link from then on.
    """
    first: list[int] = []
    end: list[int] = []
    left: list[float] = []
    right: list[float] = []
    link: list[int] = []
    total, last = 0.0, -1
    for p, g in zip(at, gain):
        total -= cost * (p - last - 1)
        a, b, l, r = p, p, total, total + g
        total, last = r, p
        k = len(first) - 1
        while k >= 0 and left[k] >= l:
            k = link[k]
        while k >= 0 and right[k] < r:
            # The two and what lies between are one; its next candidate is the earlier one's own link.
            a, l, up = first[k], left[k], link[k]
            del first[k:], end[k:], left[k:], right[k:], link[k:]
            k = up
        first.append(a), end.append(b), left.append(l), right.append(r), link.append(k)
    return [(a, b, r - l) for a, b, l, r in zip(first, end, left, right)]


@dataclass
class Model:
    gain: dict[str, float] = field(default_factory=dict)
    cost: float = 0.05
    decay: float = 1.0
    scale: float = 0.1
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def weigh(self, text: str | None) -> tuple[int, list[int], list[float]]:
        """Words, and positions and scores of those above zero."""
        words = WORD.findall(text.lower()) if text else []
        at, out = [], []
        if self.gain:
            get = self.gain.get
            for i, w in enumerate(words):
                s = get(w) or get(w[:5] + "*") or get(w[:4] + "*")
                if s:
                    at.append(i)
                    out.append(s)
        return len(words), at, out

    def found(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and all maximal segments."""
        n, at, gain = self.weigh(text)
        return n, segments(at, gain, self.cost)

    def expected(self, n: int, s: float) -> float:
        """How many segments of this score clean text of n words has."""
        return self.scale * n * math.exp(-self.decay * s)

    def features(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """The evidence of the best segment, -log of the chance that clean text has one as good; and significant ones."""
        if not found:
            return 0.0, 0.0
        best = max(s for _, _, s in found)
        e = self.expected(n, best)
        p = -math.expm1(-e)
        evidence = -math.log(p) if p > 1e-12 else self.decay * best - math.log(self.scale * n)
        return max(0.0, evidence), math.log1p(sum(self.expected(n, s) <= MOST_EXPECTED for _, _, s in found))

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The score, and the significant passages: first and last word, weight."""
        n, found = self.found(text)
        x, y = self.features(n, found)
        a, b, c = self.curve
        score = 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * x + c * y))))
        return score, [f for f in found if self.expected(n, f[2]) <= MOST_EXPECTED]

    def score(self, text: str | None) -> float:
        return self.judge(text)[0]


def solve_scale(best: list[tuple[int, float]], decay: float) -> float:
    """The likeliest K for best segments (words, score; 0 for none) that are at most s with chance exp(-K * n * exp(-decay * s))."""
    mass = sum(n * math.exp(-decay * s) for n, s in best)
    return max(sum(s > 0 for _, s in best), 0.5) / mass if mass > 0 else 0.1


def solve_decay(gains: list[tuple[float, float]], cost: float) -> float:
    """The positive root l of sum(p * exp(l * gain)) + rest * exp(-l * cost) = 1; gains: (gain, chance in clean text)."""
    rest = 1 - sum(p for _, p in gains)
    low, high = 1e-3, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        over = sum(p * math.exp(mid * g) for g, p in gains) + rest * math.exp(-mid * cost) > 1
        low, high = (low, mid) if over else (mid, high)
    return low


def fit_curve(rows: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps, slopes kept at or above zero."""
    x = np.array([[1.0, a, b] for a, b, _ in rows])
    y = np.array([t for _, _, t in rows], float)
    each = np.where(y > 0, 1.0, CLEAN_WEIGHT)
    w, keep = np.zeros(3), np.array([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            x.T @ (x * (each * p * (1 - p) + 1e-9)[:, None]) + np.diag(keep), x.T @ (each * (y - p)) - keep * w
        )
        w += step
        w[1:] = np.maximum(w[1:], 0)
        if abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def sample_texts(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(text, toxic) of at most per_class labelled rows of each class, by a hash of the id.

    Only ids whose crc32 mod 5 is not 0. Of copies and near copies one counts,
    so that what a copied text happens to say does not pass for evidence: rows
    that agree in any of four least hashes of 5-word shingles are one.
    """
    own = labels.filter(
        "toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 5 != 0"
    ).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    parts = [
        own.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)
    ]
    ids = parts[0].union(parts[1])  # 2 * per_class rows at most
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter("text is not null")
    got = got.select("text", "toxic").mapInArrow(lean(_least_hashes), "text string, toxic int, h array<bigint>")
    for k in range(4):
        got = got.groupBy(F.col("h")[k].alias("key")).agg(F.min(F.struct("text", "toxic", "h")).alias("one")).select("one.*")
    return got.select("text", "toxic")


def _least_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            w = np.array([zlib.crc32(x) for x in text.lower().encode().split()] or [0], np.uint64)
            s = w[: max(1, len(w) - 4)].copy()
            for k in range(1, min(5, len(w))):
                s = s * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(s)]
            mixed = [(s ^ (s >> np.uint64(29))) * np.uint64(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
            out.append([int(((x ^ (x >> np.uint64(32))) >> np.uint64(1)).min()) for x in mixed])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["text", "toxic", "h"]
        )


def half(text: str) -> int:
    """Which half of the sample a text belongs to; each half is measured with the words of the other."""
    return zlib.crc32(text.encode()) & 1


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toks, cls = [], []
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(WORD.findall(text.lower()))
            own = words | {w[:5] + "*" for w in words if len(w) >= 5} | {w[:4] + "*" for w in words if len(w) >= 4}
            toks += own
            cls += [2 * half(text) + toxic] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(toks, pa.string()), pa.array(cls, pa.int32())], ["token", "cls"])


def log_odds(counts: DataFrame) -> tuple[dict[str, float], float]:
    """Words with their log-odds under the prior, from token, t and c (toxic and clean rows that hold it); and the decay."""
    n_t, n_c = (float(x or 1) for x in counts.agg(F.sum("t"), F.sum("c")).first())
    mass = PRIOR * (n_t + n_c)
    prior = F.lit(mass) * (F.col("t") + F.col("c")) / (n_t + n_c)
    odds = F.log((F.col("t") + prior) / (n_t + mass - F.col("t") - prior)) - F.log((F.col("c") + prior) / (n_c + mass - F.col("c") - prior))
    z = odds / F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    top = counts.filter("t >= 3").select("token", "c", odds.alias("odds"), z.alias("z"))
    top = top.filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy("token").collect()  # tokens of the sample, which is bounded
    gain = {r.token: float(r.odds) for r in top}
    return gain, solve_decay([(float(r.odds), (r.c + 0.5) / n_c) for r in top], Model.cost)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Model:
    """A model from a bounded sample: per_class labelled rows of each class.

    K and the curve are fitted on segments that words of the other half of the
    sample found, as words always fit the rows that they were taken from.
    """
    sample = materialise(sample_texts(docs, labels, per_class), "toxic-sample")
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return Model()
    each = [F.sum((F.col("cls") == k).cast("long")).alias(f"n{k}") for k in range(4)]
    counts = materialise(sample.mapInArrow(lean(_token_rows), "token string, cls int").groupBy("token").agg(*each), "toxic-counts")
    halves = []
    for h in (0, 1):
        gain, decay = log_odds(counts.select("token", F.col(f"n{2 * h + 1}").alias("t"), F.col(f"n{2 * h}").alias("c")))
        halves.append(Model(gain, decay=decay))
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value[1 - half(t)].found(t) for t in batch.column(0).to_pylist()]
            scores = [[s for _, _, s in found] for _, found in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in got], pa.int64()), pa.array(scores, pa.list_(pa.float64())), batch.column(1)], ["n", "scores", "toxic"]
            )

    rows = sorted(tuple(r) for r in sample.mapInArrow(lean(measure), "n bigint, scores array<double>, toxic int").collect())
    gain, decay = log_odds(counts.select("token", (F.col("n1") + F.col("n3")).alias("t"), (F.col("n0") + F.col("n2")).alias("c")))
    model = Model(gain, decay=decay)
    model.scale = solve_scale([(n, max(s, default=0.0)) for n, s, toxic in rows if not toxic], model.decay)
    model.curve = fit_curve([(*model.features(n, [(0, 0, x) for x in s]), toxic) for n, s, toxic in rows])
    return model


def rate(docs: DataFrame, model: Model, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """ident, score, predicted and the passages found, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(plain(ident).alias(ident), plain(text).alias(f"{ident}_text"))
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = [shared.value.judge(t) for t in part.column(1).to_pylist()]
                spans = [[{"first_word": a, "last_word": b, "weight": s} for a, b, s in found] for _, found in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([s for s, _ in got], pa.float64()),
                        pa.array([int(s >= 0.5) for s, _ in got], pa.int32()),
                        pa.array(spans, kind),
                    ],
                    [ident, "score", "predicted", "passages"],
                )

    id_kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(
        lean(run), f"`{ident}` {id_kind}, score double, predicted int, passages array<struct<first_word:int,last_word:int,weight:double>>"
    )


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that are not predicted to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield part.filter(pa.array([shared.value.score(t) < 0.5 for t in part.column(where).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
