"""Byte-level BPE encoding and decoding by ranked merges.

A text is cut into the pieces of the public pattern; each distinct piece is
folded from single bytes by repeatedly merging the adjacent pair of lowest
rank. `fold_words` is this fold of distinct words with Spark's higher-order
functions and a literal rank map; `encode` and `digest` run the same fold in
Arrow batches, over the distinct chunks that a worker has met, and are the ones
for whole tables (README has the figures of both).

Defined results: null is the empty text, which has no token; texts are read
whole; equal texts get equal ids; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import FORGET, lean

#: Bytes of chunks, ids and decoded pieces that a worker remembers before it starts anew, with what an entry costs.
CACHE_BYTES = 250_000_000
ENTRY = 330


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: merges of the lowest rank first, the leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [ranks.get(parts[i] + parts[i + 1], _NONE) for i in range(len(parts) - 1)]
    if len(parts) > 512:
        return _merge_long(parts, ranks)
    while pair:
        best = min(pair)
        if best == _NONE:
            break
        i = pair.index(best)
        parts[i] += parts.pop(i + 1)
        pair.pop(i)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


_NONE = 1 << 60


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and links, for pieces of many bytes."""
    import heapq

    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i] = a + b
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            m = after[k] if k >= 0 else n
            if m < n and (r := ranks.get(parts[k] + parts[m])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[m]))
    return [ranks[p] for p, x in zip(parts, alive) if x]


class Coder:
    """Encodes whole texts and decodes ids, remembering chunks."""

    def __init__(self, path: str):
        import regex

        self.ranks = load_ranks(path)
        self.pieces = {rank: tok for tok, rank in self.ranks.items()}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # Where single blanks part all words, a chunk is a blank and its word:
        # no match of the pattern reaches over such a border.
        self.odd_space = re.compile(r"^\s|\s\s|\s$")
        self.known: dict[str, tuple[str, bytes, int]] = {}
        self.merged: dict[str, list[int]] = {}
        self.held = 0

    def piece(self, text: str) -> list[int]:
        """Ids of a piece; chunks that differ in punctuation share their words."""
        got = self.merged.get(text)
        if got is None:
            got = self.merged[text] = merge(text.encode(), self.ranks)
            self.held += 2 * len(text) + 36 * len(got) + 200
        return got

    def learn(self, chunk: str) -> tuple[str, bytes, int]:
        ids = [i for p in self.pattern.findall(chunk) for i in self.piece(p)]
        got = ",".join(map(str, ids)), b"".join([self.pieces[i] for i in ids]), len(ids)
        self.known[chunk] = got
        self.held += 2 * len(chunk) + len(got[0]) + len(got[1]) + ENTRY
        return got

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if self.odd_space.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]]

    def code(self, text: str | None) -> tuple[str, bytes, int]:
        """Ids joined by commas, the bytes that they decode to, and their number."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.merged.clear()
            self.held = 0
        get, learn = self.known.get, self.learn
        got = [get(c) or learn(c) for c in self.chunks(text or "")]
        return ",".join([g[0] for g in got]), b"".join([g[1] for g in got]), sum([g[2] for g in got])

    def encode(self, text: str | None) -> list[int]:
        ids = self.code(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


_OPEN: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The coder of a path, kept with its chunks for the next task of the worker."""
    if path not in _OPEN:
        _OPEN[path] = Coder(path)
    FORGET["chunks"] = _OPEN.clear
    return _OPEN[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array), decoded (binary) of every text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [own.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run, "chunks"), f"doc_id {kind}, ids array<int>, decoded binary")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded bytes, without the ids themselves."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, a, b = [], [], []
                for text in part.column(1).to_pylist():
                    ids, raw, count = own.code(text)
                    n.append(count)
                    a.append(hashlib.sha256(ids.encode()).hexdigest())
                    b.append(hashlib.sha256(raw).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lean(run, "chunks"), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


#: Buckets of the literal rank map: a bucket of a vocabulary of 50,000 holds one or two entries, ten at most.
BUCKETS = 1 << 15
NO_RANK = 1 << 30


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal array of small maps, by the crc32 of a piece; Spark folds it to a constant.

    Bytes are the characters U+0000 to U+00FF. Spark looks a key up by a scan of
    its map, so one map of all ranks would cost 50,000 comparisons a look.
    """
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for tok, rank in ranks.items():
        word = tok.decode("latin-1")
        maps[zlib.crc32(word.encode()) % BUCKETS][word] = rank
    return F.from_json(F.lit(json.dumps(maps)), F.lit("array<map<string,int>>"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rank_of(table: Column, word: Column) -> Column:
    return F.get(table, (F.crc32(word) % BUCKETS).cast("int"))[word]


def fold(word: Column, table: Column) -> Column:
    """Ids of a piece (a string of bytes): its bytes, folded by the merge of lowest rank, the leftmost first.

    The state has the parts and the rank of each with its right neighbour, so a
    merge looks two pairs up. Steps after the last merge change nothing.
    """

    def paired(left: Column, right: Column) -> Column:
        return F.coalesce(rank_of(table, F.concat(left, right)), F.lit(NO_RANK))

    def merged(acc: Column, i: Column) -> Column:
        p, r = acc["p"], acc["r"]

        def put(x: Column) -> Column:
            before = F.concat(F.slice(r, F.lit(1), i - 1), F.array(paired(F.get(p, i - 1), x)))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), i), F.array(x), F.slice(p, i + 3, F.size(p))).alias("p"),
                F.concat(
                    F.when(i > 0, before).otherwise(F.array().cast("array<int>")), F.array(paired(x, F.get(p, i + 2))), F.slice(r, i + 3, F.size(r))
                ).alias("r"),
            )

        return bound(F.concat(F.get(p, i), F.get(p, i + 1)), put)

    def step(acc: Column, _: Column) -> Column:
        at = lambda low: (F.array_position(acc["r"], low) - 1).cast("int")
        return bound(F.array_min(acc["r"]), lambda low: F.when(low >= NO_RANK, acc).otherwise(bound(at(low), lambda i: merged(acc, i))))

    def run(parts: Column) -> Column:
        first = F.transform(parts, lambda p, i: paired(p, F.get(parts, i + 1)))
        steps = F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2)))
        return F.aggregate(steps, F.struct(parts.alias("p"), first.alias("r")), step, lambda acc: F.transform(acc["p"], lambda p: rank_of(table, p)))

    known = rank_of(table, word)
    return F.when(known.isNotNull(), F.array(known)).when(F.length(word) > 0, bound(F.split(word, ""), run)).otherwise(F.array().cast("array<int>"))


def fold_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """word (binary), ids and decoded of every row of words, by higher-order functions alone.

    The literal map is bound once for each row of a block of words.
    """
    pieces = [b""] * (max(ranks.values()) + 1)
    for tok, rank in ranks.items():
        pieces[rank] = tok
    listed = F.from_json(F.lit(json.dumps([t.decode("latin-1") for t in pieces])), F.lit("array<string>"))
    blocks = words.select(F.decode("word", "ISO-8859-1").alias("word")).groupBy((F.xxhash64("word") % 256).alias("block")).agg(F.collect_set("word").alias("words"))
    ids = bound(rank_map(ranks), lambda t: F.transform("words", lambda w: F.struct(w.alias("word"), fold(w, t).alias("ids"))))
    rows = blocks.select(bound(listed, lambda p: F.transform(ids, lambda x: F.struct(x["word"].alias("word"), x["ids"].alias("ids"), F.array_join(F.transform(x["ids"], lambda i: F.get(p, i)), "").alias("decoded")))).alias("x"))
    rows = rows.select(F.explode("x").alias("x"))
    return rows.select(F.encode("x.word", "ISO-8859-1").alias("word"), "x.ids", F.encode("x.decoded", "ISO-8859-1").alias("decoded"))
