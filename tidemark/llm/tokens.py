"""Word-cached use of a public tokenizer inside executors.

The word vocabulary drops white space and never joins pieces across it, and its
normaliser works on each run between white space alone. So the ids of a text
are those of its words, one after the other, and each distinct word goes
through the library once per worker and cache generation. A word of plain
letters is a single piece, so it goes to the library's BPE model directly; a
full stop or comma after it is a piece of its own. All other words go through
the library whole.
"""

from __future__ import annotations

import os
import re

import public_tokenizers

from tidemark.llm.common import FORGET

#: Bytes of words and ids that a worker remembers before it starts anew, with what a dict entry costs.
CACHE_BYTES = 96_000_000
ENTRY = 180
#: Letters of ASCII and Latin-1 (in UTF-8), then one full stop or comma at most.
PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[.,]?")


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, others for 256 and up."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + k for k, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.model = self.lib.model
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        self.ends = {c: packed(self.lib.encode(c.decode(), add_special_tokens=False).ids) for c in (b".", b",")}

    def learn(self, words: list[bytes]) -> None:
        self.held += sum(map(len, words)) + ENTRY * len(words)
        known, model, letters, other = self.known, self.model, self.letters, []
        for w in words:
            if not PLAIN.fullmatch(w):
                other.append(w)
                continue
            end = self.ends.get(w[-1:], b"")
            core = w[:-1] if end else w
            low = core.decode().lower().encode()
            ids = known.get(low)
            if ids is None:
                ids = packed([t.id for t in model.tokenize(low.decode("latin-1").translate(letters))])
                known[low] = ids
            known[w] = ids + end
        for k in range(0, len(other), 20_000):
            part = other[k : k + 20_000]
            got = self.lib.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            known.update((w, packed(e.ids)) for w, e in zip(part, got))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; none for null. Splits at ASCII white space."""
        each = [text.encode().split() if text else [] for text in texts]
        known = self.known
        if self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        self.learn([w for w in {w for words in each for w in words} if w not in known])
        return [b"".join([known[w] for w in words]) for words in each]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_OPEN: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a path, kept with its words for the next task of the worker."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    FORGET["words"] = _OPEN.clear
    return _OPEN[path]
