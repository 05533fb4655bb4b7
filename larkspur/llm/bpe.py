"""Byte-pair encoding by longest matches and backtracking, and decoding by an offset table.

A BPE result is a sequence of tokens in which every neighbouring pair is compatible: undoing the
merges of both along their common border, in order of rank, never shows a pair that would have been merged
first. So the encoder takes the longest token at each place (all matches come from one Aho-Corasick
pass), checks it against its left neighbour in the table of pairs, tries the next shorter prefix
token if they don't fit, and goes back where none fits. A place that was given up is never tried
again, so the work is linear in the length.

Normalisation, splitting and special tokens follow the tokenizer's file. Words (pre-tokens) are
encoded independently of each other; each task remembers a bounded number of them.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from larkspur.llm.common import bounded_batches, give_back, load, table_of

#: Words that a task remembers before it starts anew.
REMEMBERED = 100_000
_BIG = 1 << 60


class Spec(NamedTuple):
    """What the tokenizer's file says, small enough to send: one vocabulary."""

    tokens: list[str]  #: by id, as the file writes them
    merges: list[tuple[str, str]]
    special: dict[str, int]
    pattern: str
    suffix: str


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones for themselves,
    the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_spec(path: str) -> Spec:
    """Read a tokenizer file of the kind: BPE with word ends, byte level, one splitting pattern, no decoder."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file["pre_tokenizer"]["pretokenizers"][0]
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    vocab = model["vocab"] | special
    tokens = [""] * (max(vocab.values()) + 1)
    for text, i in vocab.items():
        tokens[i] = text
    merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    return Spec(tokens, merges, special, split["pattern"]["Regex"], model["end_of_word_suffix"] or "")


class Codec:
    """The tables of one tokenizer, made from its file's contents."""

    def __init__(self, spec: Spec):
        self.spec = spec
        letters = byte_letters()
        ids = {t: i for i, t in enumerate(spec.tokens)}
        n = len(spec.tokens)
        self.left, self.right = list(range(n)), list(range(n))
        self.rank, self.pairs = [-1] * n, {}
        for r, (a, b) in enumerate(spec.merges):
            whole = ids[a + b]
            self.left[whole], self.right[whole], self.rank[whole] = ids[a], ids[b], r
            self.pairs[ids[a], ids[b]] = whole
        self.fits: dict[tuple[int, int], bool] = {}
        # a word is the text of its bytes as code points below 256; the last one, at the word's end, is 256 higher
        keys = {}
        for text, i in ids.items():
            if i in spec.special.values():
                continue
            last = spec.suffix and text.endswith(spec.suffix) and len(text) > len(spec.suffix)
            raw = [letters[c] for c in (text[: -len(spec.suffix)] if last else text)]
            if last:
                raw[-1] += 256
            keys["".join(map(chr, raw))] = i
        sound = self._sound(n)
        keys = {k: i for k, i in keys.items() if sound[i]}
        self.length, self.shorter = [0] * n, [-1] * n
        self.trie = ahocorasick.Automaton()
        for k, i in keys.items():
            self.length[i] = len(k)
            self.trie.add_word(k, (i, len(k)))
            self.shorter[i] = next((keys[k[:j]] for j in range(len(k) - 1, 0, -1) if k[:j] in keys), -1)
        self.trie.make_automaton()
        # the offset table: every token's text with the blank that decoding puts between tokens
        texts = [t.encode() + b" " for t in spec.tokens]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.special = regex.compile("(" + "|".join(map(regex.escape, spec.special)) + ")") if spec.special else None
        self.words = regex.compile(spec.pattern.replace(r"\s", r"\p{White_Space}"))
        self.known: dict[str, bytes] = {}

    def _sound(self, n: int) -> list[bool]:
        """Tokens that their own text encodes to; merges of higher rank can leave others out of reach."""
        out = [True] * n
        for i in sorted((i for i in range(n) if self.rank[i] >= 0), key=self.rank.__getitem__):
            a, b = self.left[i], self.right[i]
            out[i] = out[a] and out[b] and self._compatible(a, b, self.rank[i])
        return out

    def _compatible(self, a: int, b: int, before: int = _BIG) -> bool:
        """Whether no merge over the border of a and b comes before the merges that made them."""
        rank, pairs = self.rank, self.pairs
        while True:
            whole = pairs.get((a, b))
            if whole is not None and rank[whole] < before:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # a's last merge came later: undo it
                before, a = ra, self.right[a]
            else:  # of two equal merges the left one comes first
                before, b = rb + 1, self.left[b]

    def pair_fits(self, a: int, b: int) -> bool:
        out = self.fits.get((a, b))
        if out is None:
            if len(self.fits) > 2 * REMEMBERED:
                self.fits.clear()
            out = self.fits[a, b] = self._compatible(a, b)
        return out

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode().decode("latin-1")
        if self.spec.suffix:
            raw = raw[:-1] + chr(256 + ord(raw[-1]))
        n = len(raw)
        longest = [-1] * n
        for end, (token, size) in self.trie.iter(raw):
            longest[end - size + 1] = token
        length, shorter, fits = self.length, self.shorter, self.pair_fits
        out: list[int] = []
        at, token, closed = 0, longest[0], bytearray(n + 1)
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if not closed[end] and (last < 0 or fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:  # nothing fits here after `last`: never come back to this place
                closed[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def _word(self, word: str) -> bytes:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        out = self.known[word] = np.array(self.encode_word(word), "<u4").tobytes()
        return out

    def _plain(self, text: str) -> Iterator[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-casing goes letter by letter
        known = self.known
        for word in self.words.findall(text.lower()):
            yield known.get(word) or self._word(word)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as unsigned 32-bit little-endian numbers."""
        parts = []
        for i, piece in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                parts.append(np.array([self.spec.special[piece]], "<u4").tobytes())
            elif piece:
                parts.extend(self._plain(piece))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with blanks between, gathered in one step by the offset table."""
        if not len(ids):
            return b""
        out = []
        for a in range(0, len(ids), 1 << 16):
            some = ids[a : a + (1 << 16)]
            sizes = self.sizes[some]
            ends = np.cumsum(sizes)
            out.append(self.bytes[np.arange(ends[-1]) + np.repeat(self.offsets[some] - (ends - sizes), sizes)].tobytes())
        return b"".join(out)[:-1]


def _map(docs: DataFrame, path: str, column: str, schema: str, row) -> DataFrame:
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path))  # bounded by the vocabulary

    def run(batches):
        codec = Codec(shared.value)  # made anew for each task, so that an idle worker doesn't hold its words
        for batch in batches:
            yield row(codec, batch, batch.column(batch.schema.get_field_index(column)))
        del codec
        give_back()

    return docs.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ``ids`` (unsigned 32-bit little-endian numbers) of each whole text; null is empty."""

    def row(codec, batch, column):
        ids = [codec.encode(t) for t in table_of(batch, "text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return _map(docs.select("doc_id", "text"), path, "text", "doc_id long, n_tokens long, ids binary", row)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded ``text`` of each row of ``encode_documents``."""

    def row(codec, batch, column):
        texts = [codec.decode(np.frombuffer(x, "<u4")).decode() for x in column.to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _map(encoded.select("doc_id", "ids"), path, "ids", "doc_id long, text string", row)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each whole text, encoded and decoded in one pass.

    A null or empty text has no tokens; rows that repeat are rows of their own; a null doc_id stays null.
    """

    def row(codec, batch, column):
        sizes, ids_sha, text_sha = [], [], []
        for text in table_of(batch, "text"):
            ids = codec.encode(text.as_py())
            sizes.append(len(ids))
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _map(docs.select("doc_id", "text"), path, "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trips(load(spark, sf_dir, "documents"), vocabulary())
