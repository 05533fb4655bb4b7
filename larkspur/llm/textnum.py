"""Words and word n-grams of many texts at once, as numpy arrays over their UTF-8 bytes.

Hashes have 64 bits. A word is read in chunks of eight bytes, each of which is taken through a
bijective mixer together with what came before, so words of at most eight bytes and equal length never
share a hash; words of over ``LONG`` bytes are hashed by BLAKE2b. N-grams join the hashes of their
halves by the same mixer. Nothing here is linear in the text, so structured words (Thue-Morse words and
their like) collide no more than others: two different words or n-grams share a hash with
a chance of about 2**-64, if the mixer behaves as a random function. The words themselves aren't compared.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

U = np.uint64


def _key(seed: str) -> U:
    return U(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "little") | 1)


LENGTH, CHUNK, LEFT, GRAM = (_key(x) for x in ("length", "chunk", "left", "gram"))
#: A longer word is hashed on its own.
LONG = 128
#: What a chunk keeps of eight bytes if a word has so many left.
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)

#: ASCII white space: the space and tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, lower-case letters and every byte beyond ASCII.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words(NamedTuple):
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: past its last byte
    first: np.ndarray  #: for each text its first word, and the number of words at the end
    doc: np.ndarray  #: the text of each word


def find_words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> Words:
    n = len(buf)
    m = table[buf]
    inside = np.zeros(n + 1, bool)  # between byte i-1 and byte i lies no border
    inside[1:n] = m[1:] & m[:-1]
    inside[off] = False
    start, end = np.flatnonzero(m & ~inside[:-1]), np.flatnonzero(m & ~inside[1:]) + 1
    first = np.searchsorted(start, off)
    return Words(start, end, first, np.repeat(np.arange(len(off) - 1), np.diff(first)))


def chunks(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, little-endian; a view of a padded copy."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(buf) + 1,), (1,))


def _first(chunk: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return mix((chunk * CHUNK) ^ (np.asarray(size).astype(U) * LENGTH))


def hash_words(buf: np.ndarray, w: Words) -> np.ndarray:
    if not len(w.start):
        return np.zeros(0, U)
    at8, size = chunks(buf), w.end - w.start
    h = _first(at8[w.start] & MASK[np.minimum(size, 8)], size)
    left = np.flatnonzero((size > 8) & (size <= LONG))
    k = 8
    while len(left):
        chunk = at8[w.start[left] + k] & MASK[np.minimum(size[left] - k, 8)]
        h[left] = mix((h[left] * LEFT) ^ (chunk * CHUNK))
        k += 8
        left = left[size[left] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[w.start[i] : w.end[i]], digest_size=8).digest(), "little")
    return h


def hash_beginnings(buf: np.ndarray, w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words have k bytes or more (k is at most 8), and hashes of their first k."""
    long = w.end - w.start >= k
    return long, _first(chunks(buf)[w.start[long]] & MASK[k], 1000 + k)


def doubled(h: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Hashes of the 1, 2, 4 ... words from each position, up to ``most`` words; the last positions have none."""
    out, k = {1: h}, 1
    while 2 * k <= most and len(out[k]) > k:
        out[2 * k] = mix((out[k][:-k] * LEFT) ^ (out[k][k:] + GRAM))
        k *= 2
    return out


def hash_ngrams(h: np.ndarray, k: int, powers: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Of the k words from each position; the last k-1 positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    powers = powers or doubled(h, k)
    out, at = None, 0
    for b in range(k.bit_length() - 1, -1, -1):
        if k >> b & 1:
            part = powers[1 << b][at : at + n]
            out = part if out is None else mix((out * LEFT) ^ (part + GRAM))
            at += 1 << b
    return mix(out + U(k))
