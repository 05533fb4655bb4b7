"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, previous word). The class is predicted by a log-linear
model over hashed features of the history: the previous word, the one before it (a skip feature),
and both together (an n-gram feature). Within the class the word is predicted by a log-linear model as well: its
share of the class's corpus counts, plus one, with one place for unknown words, times the exponential of the weight
of the n-gram feature (previous word, word), if it has one. As few of a class's words have a feature with a given previous
word, the normaliser is 1 plus the sum over these alone, and both factors sum to 1 exactly.

Everything is learned from the whole training part, in passes over the corpus:

1. word counts, exact, in shards of hashes; the most frequent words (a bounded table) are broadcast;
2. contexts of frequent words and of word endings, from which a k-means makes the classes;
3. counts of all pairs of neighbouring words, exact, in shards of previous words. Each shard fits the weights of its
   pairs by gradient rounds, scaled as iterative scaling does, until they stop moving: their expected counts become the
   observed ones less ``DISCOUNT``. All pairs of words of the table seen ``LEAST_PAIR`` times or more are features, so the model grows
   with the corpus. Of over ``PAIRS`` weights or normalisers the most frequent are broadcast, and the others stay in shards;
4. feature counts given the class, and rounds of gradient updates: tasks send the observed and the
   expected feature counts, whose difference is the gradient; each round scales it per feature as
   iterative scaling does and moves the weights, and reports the log-likelihood before it. Equal histories of a
   task are worked out once.

Words outside the table are scored through a join of packed requests with the shards of counts, and weights that
aren't broadcast through a join with theirs; a bitmap says which tokens have none there.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textnum as X
from larkspur.llm.common import bounded_batches, give_back, leanly, load, made, release, stored, text_pieces
from larkspur.llm.repeats import _planes, _unplanes
from larkspur.llm.toxicity import held_out

#: Words in the broadcast table; words with a context vector of their own; endings; classes.
TABLE_WORDS, TOP_WORDS, ENDINGS, CLASSES = 1 << 20, 12288, 4096, 32
UNITS = TOP_WORDS + ENDINGS
#: Context words, hashed feature rows, gradient rounds after the first, tokens that a task counts at once.
CONTEXTS, FEATURES, ROUNDS, TASK_TOKENS = 64, 1 << 16, 1, 2_000_000
#: Tokens whose histories or pairs a task gathers at once, and tokens for each shard of pairs.
GATHERED, SHARD_TOKENS = 800_000, 400_000
SLICES = 16
END = X.U(0x9E3779B97F4A7C15)  # the hash of the end token, which no text can write
FIRST_RATE, RATE, LIMIT = 0.6, 0.5, 16.0
#: Weights, and normalisers, that are broadcast; how often a pair of words is seen to be a feature, and what its count loses.
PAIRS, LEAST_PAIR, DISCOUNT = 1 << 21, 2, 0.6
#: Tokens for each shard of the weights that aren't broadcast, and bits of the bitmap that stands in front of them (16 MB).
WEIGHT_TOKENS, WEIGHT_BITS = 2_000_000, 1 << 27
PAIR_ROUNDS, SETTLED = 60, 1e-3
OTHER = 1 << 31  # from here on a pair's second place is the class of a word outside the table


class Tokens(NamedTuple):
    h: np.ndarray  #: word hashes, with the end token after each text's words
    ending: np.ndarray  #: ending bucket of each
    doc: np.ndarray
    size: np.ndarray  #: tokens of each text


def tokenise(buf: np.ndarray, off: np.ndarray) -> Tokens:
    buf = X.LOWER[buf]
    w = X.find_words(buf, off, X.NOT_SPACE)
    n = len(off) - 1
    size = np.diff(w.first) + 1
    ends = np.cumsum(size) - 1
    h = np.full(len(w.start) + n, END, X.U)
    ending = np.zeros(len(h), np.int64)
    doc = np.repeat(np.arange(n), size)
    if len(w.start):
        at = np.ones(len(h), bool)
        at[ends] = False
        h[at] = X.hash_words(buf, w)
        code = np.zeros(len(w.start), X.U)
        for k in (1, 2, 3):
            inside = w.end - k >= w.start
            code = code * X.U(257) + np.where(inside, buf[np.maximum(w.end - k, 0)].astype(X.U) + X.U(1), X.U(0))
        ending[at] = (X.mix(code) % X.U(ENDINGS)).astype(np.int64)
    return Tokens(h, ending, doc, size)


def _cut(keys: np.ndarray):
    """Ranges of equal values of a sorted array: (value, from, to)."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return zip(keys[begin].tolist(), begin.tolist(), np.append(begin[1:], len(keys)).tolist())


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def count_words(train: DataFrame, shards: int) -> DataFrame:
    """(shard, n, words, hashes, counts, endings): exact counts, the hashes of a shard sorted."""

    def count(batches):
        held, n = [], 0

        def flush():
            h, e = (np.concatenate(x) for x in zip(*held))
            u, at, c = np.unique(h, return_index=True, return_counts=True)
            shard = (u % X.U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            u, c, e = u[order], c[order].astype(np.uint32), e[at][order].astype(np.uint16)
            for s, a, b in _cut(shard[order]):
                yield _rows(["shard", "hashes", "counts", "endings"], [s], [u[a:b].tobytes()], [c[a:b].tobytes()], [e[a:b].tobytes()])

        for batch in batches:
            for _, _, buf, off in text_pieces(batch):
                t = tokenise(buf, off)
                held.append((t.h, t.ending.astype(np.uint16)))
                n += len(t.h)
                if n >= TASK_TOKENS:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def add(key, table):
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        h, c, e = join("hashes", np.uint64), join("counts", np.uint32), join("endings", np.uint16)
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(back, c, len(u)).astype(np.int64)
        return pa.table({"shard": [key[0].as_py()], "n": pa.array([int(total.sum())], pa.int64()), "words": pa.array([len(u)], pa.int64()), "hashes": [u.tobytes()], "counts": [total.tobytes()], "endings": [e[at].tobytes()]})

    sent = train.select("text").mapInArrow(count, "shard long, hashes binary, counts binary, endings binary")
    return stored(sent.groupBy("shard").applyInArrow(leanly(add), "shard long, n long, words long, hashes binary, counts binary, endings binary"), "words")


def _find(sorted_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash is, or would be, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    u, back = np.unique(h, return_inverse=True)  # sorted values are found faster
    at = np.minimum(np.searchsorted(sorted_, u), len(sorted_) - 1)
    return at[back], (sorted_[at] == u)[back]


class Units(NamedTuple):
    """What the classes know of a word: itself, if it is among the top words, or else its ending."""

    hashes: np.ndarray  #: of the top words, sorted
    unit: np.ndarray
    context: np.ndarray  #: for each unit the number of its context, or CONTEXTS - 1

    def of(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        at, found = _find(self.hashes, h)
        return np.where(found, self.unit[at] if len(self.unit) else 0, ending)


def _steps(c: np.ndarray) -> np.ndarray:
    """Steps of a histogram of counts: at most 1024 + 64 * 64."""
    return np.where(c < 1024, c, 1024 + np.floor(np.log2(np.maximum(c, 1)) * 64).astype(np.int64))


def _histogram(c: np.ndarray) -> pa.RecordBatch:
    step, n = np.unique(_steps(c), return_counts=True)
    return _rows(["step", "n"], step.astype(np.int64), n.astype(np.int64))


def _least(sent: DataFrame, most: int) -> tuple[int, int, int]:
    """Of the histograms (step, n) that tasks send: the least step from which on at most ``most`` remain, how many these are, and all."""
    steps = sorted(((r["step"], r["n"]) for r in sent.groupBy("step").agg(F.sum("n").alias("n")).collect()), reverse=True)
    least, total = 1 << 40, 0
    for step, n in steps:
        if total + n > most:
            break
        least, total = step, total + n
    return least, total, sum(n for _, n in steps)


class Table(NamedTuple):
    """The frequent words: sorted hashes and counts."""

    hashes: np.ndarray
    counts: np.ndarray
    endings: np.ndarray
    complete: bool  #: no word of the training part is missing


def frequent(words: DataFrame, most: int) -> tuple[Table, Units]:
    """At most ``most`` words, the most frequent ones: those above a count that a histogram gives."""

    def histogram(batches):
        for batch in batches:
            for raw in batch.column("counts"):
                yield _histogram(np.frombuffer(raw.as_buffer(), np.int64))

    least, total, distinct = _least(words.mapInArrow(histogram, "step long, n long"), most)
    complete = total == distinct

    def pick(batches):
        for batch in batches:
            for h, c, e in zip(batch.column("hashes"), batch.column("counts"), batch.column("endings")):
                h, c, e = np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64), np.frombuffer(e.as_buffer(), np.uint16)
                keep = _steps(c) >= least
                if keep.any():
                    yield _rows(["h", "c", "e"], [h[keep].tobytes()], [c[keep].tobytes()], [e[keep].tobytes()])

    got = words.mapInArrow(pick, "h binary, c binary, e binary").toArrow()
    h, c, e = (np.frombuffer(b"".join(got.column(x).to_pylist()), k) for x, k in (("h", np.uint64), ("c", np.int64), ("e", np.uint16)))
    order = np.argsort(h)
    h, c, e = h[order], c[order], e[order]
    top = np.lexsort((h, -c))[:TOP_WORDS]
    context = np.full(UNITS + 1, CONTEXTS - 1, np.int64)
    context[ENDINGS : ENDINGS + min(CONTEXTS - 2, len(top))] = np.arange(min(CONTEXTS - 2, len(top)))
    context[UNITS] = CONTEXTS - 2  # before the first word
    by_hash = np.argsort(h[top])
    return Table(h, c, e, complete), Units(h[top][by_hash], ENDINGS + by_hash, context)


def _summed(sent: DataFrame, size: int, kind, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The sum of arrays that tasks send in ``SLICES`` slices (slice, values): as many rows, of a fixed size. And that
    of ``more`` numbers in a slice of their own."""

    def add(key, table):
        total = None
        for raw in table.column("values"):
            x = np.frombuffer(raw.as_buffer(), kind)
            total = x.astype(np.float64) if total is None else total + x
        return pa.table({"slice": [key[0].as_py()], "values": [total.tobytes()]})

    out, last = np.zeros(size), np.zeros(more)
    for row in sent.groupBy("slice").applyInArrow(leanly(add), "slice long, values binary").toArrow().to_pylist():
        if row["slice"] == SLICES:
            last = np.frombuffer(row["values"], np.float64)
            continue
        part = size // SLICES
        out[row["slice"] * part : (row["slice"] + 1) * part] = np.frombuffer(row["values"], np.float64)
    return out, last


def _send(total: np.ndarray):
    part = len(total) // SLICES
    for i in range(SLICES):
        x = total[i * part : (i + 1) * part]
        if x.any():
            yield _rows(["slice", "values"], [i], [x.tobytes()])


def histories(unit: np.ndarray, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two places before each token; UNITS stands before the first."""
    start = np.cumsum(t.size) - t.size
    one, two = np.empty_like(unit), np.empty_like(unit)
    one[1:], two[2:] = unit[:-1], unit[:-2]
    one[start] = UNITS
    two[start] = UNITS
    second = start[t.size > 1] + 1
    two[second] = UNITS
    return one, two


def find_classes(train: DataFrame, shared_units) -> np.ndarray:
    """The class of each unit: k-means of its left and right contexts over the whole training part."""
    width = 2 * CONTEXTS

    def count(batches):
        units = shared_units.value
        total = np.zeros(UNITS * width, np.uint32)
        for batch in batches:
            for _, _, buf, off in text_pieces(batch):
                t = tokenise(buf, off)
                unit = units.of(t.h, t.ending)
                one, _ = histories(unit, t)
                before = one < UNITS
                for code in (unit * width + units.context[one], one[before] * width + CONTEXTS + units.context[unit[before]]):
                    code, n = np.unique(code, return_counts=True)
                    total[code] += n.astype(np.uint32)
        yield from _send(total)

    x = _summed(train.select("text").mapInArrow(count, "slice long, values binary"), UNITS * width, np.uint32)[0].reshape(UNITS, width)
    n = x.sum(1)
    x = np.sqrt((x + 0.5 * x.sum(0) / max(x.sum(), 1)) / (n + 0.5)[:, None])
    weight = np.sqrt(n)
    centres = [x[int(n.argmax())]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < CLASSES:
        centres.append(x[int((near * weight).argmax())])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    centres = np.array(centres)
    for _ in range(15):
        cls = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]).argmin(1)
        for k in range(CLASSES):
            own = weight * (cls == k)
            if own.sum() > 0:
                centres[k] = own @ x / own.sum()
    return cls


def feature_rows(one: np.ndarray, two: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashed rows of the previous word, the skipped-to one, and both (the farther one by its class)."""
    a, b = one.astype(X.U), two.astype(X.U)
    far = cls[np.minimum(two, UNITS)].astype(X.U)
    m = X.U(FEATURES - 1)
    rows = (X.mix(a * X.U(3) + X.U(1)) & m, X.mix(b * X.U(3) + X.U(2)) & m, X.mix((a << X.U(20)) + far * X.U(3) + X.U(1 << 50)) & m)
    return tuple(r.astype(np.int64) for r in rows)


class Model(NamedTuple):
    units: Units
    cls: np.ndarray  #: class of each unit, and of the place before the first word
    weights: np.ndarray  #: FEATURES x CLASSES, 32-bit
    bias: np.ndarray
    mass: np.ndarray  #: log10 of (tokens + words + 1) of each class
    tokens: int
    words: int


def odds(m: Model, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """exp of the class scores, tokens x CLASSES, and their sums. Weights are held within +-LIMIT, so nothing overflows."""
    z = np.take(m.weights, rows[0], axis=0)
    z += m.bias
    for r in rows[1:]:
        z += np.take(m.weights, r, axis=0)
    np.exp(z, out=z)
    return z, z @ np.ones(CLASSES, np.float32)


def _blocks(n: int, most: int = 1 << 12):
    """Blocks whose class scores stay in the processor's cache."""
    return ((a, min(a + most, n)) for a in range(0, n, most))


def feature_counts(train: DataFrame, shared, expected: bool) -> tuple[np.ndarray, float]:
    """Observed, or by the model expected, counts of (feature row, class) over the training part; and with the
    expected ones, the log-likelihood (base 10) of the classes a token. Tasks gather equal histories, and work each out once."""
    size = FEATURES * CLASSES
    kind = np.float32 if expected else np.uint32

    def count(batches):
        m = shared.value
        total = np.zeros(size, kind)
        grid = total.reshape(FEATURES, CLASSES)
        held, n, likelihood, tokens = [], 0, 0.0, 0

        def flush():
            nonlocal held, n, likelihood, tokens
            code = np.concatenate(held)  # (history, class)
            held, n, tokens = [], 0, tokens + len(code)
            code, times = np.unique(code, return_counts=True)
            history, k = code // CLASSES, code % CLASSES
            new = np.concatenate([[True], history[1:] != history[:-1]])
            at = np.cumsum(new) - 1
            history = history[new]
            rows = feature_rows(history // (UNITS + 1), history % (UNITS + 1), m.cls)
            if not expected:
                for r in rows:
                    place = r[at] * CLASSES + k
                    order = np.argsort(place)
                    place = place[order]
                    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                    total[place[first]] += np.add.reduceat(times[order], first).astype(kind)
                return
            weight = np.bincount(at, times).astype(np.float32)
            begin = np.flatnonzero(new)
            for a, b in _blocks(len(history)):
                p, total_p = odds(m, tuple(r[a:b] for r in rows))
                p /= total_p[:, None]
                lo, hi = int(begin[a]), int(begin[b]) if b < len(begin) else len(code)
                likelihood += float((np.log10(p[at[lo:hi] - a, k[lo:hi]]) * times[lo:hi]).sum())
                p *= weight[a:b, None]
                for r in rows:
                    order = np.argsort(r[a:b])
                    own = r[a:b][order]
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    grid[own[first]] += np.add.reduceat(p[order], first, axis=0)

        for batch in batches:
            for _, _, buf, off in text_pieces(batch):
                t = tokenise(buf, off)
                unit = m.units.of(t.h, t.ending)
                one, two = histories(unit, t)
                held.append((one * (UNITS + 1) + two) * CLASSES + m.cls[unit])
                n += len(unit)
                if n >= GATHERED:
                    flush()
                    give_back()
        if n:
            flush()
        yield from _send(total)
        yield _rows(["slice", "values"], [SLICES], [np.array([likelihood, tokens]).astype(kind).tobytes()])

    got, last = _summed(train.select("text").mapInArrow(count, "slice long, values binary"), size, kind, 2)
    return got.reshape(FEATURES, CLASSES), float(last[0] / max(last[1], 1))


def class_mass(words: DataFrame, shared_units, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class, over all words and not only those of the table."""
    shared = words.sparkSession.sparkContext.broadcast(cls)

    def count(batches):
        units = shared_units.value
        for batch in batches:
            for h, c, e in zip(batch.column("hashes"), batch.column("counts"), batch.column("endings")):
                h, c, e = np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64), np.frombuffer(e.as_buffer(), np.uint16)
                k = shared.value[units.of(h, e.astype(np.int64))]
                yield _rows(["k", "n", "v"], np.arange(CLASSES), np.bincount(k, c, CLASSES).astype(np.int64), np.bincount(k, minlength=CLASSES).astype(np.int64))

    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.mapInArrow(count, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    return n, v


class Rest(NamedTuple):
    """What is known here of the weights and normalisers that aren't broadcast: no key without its bit is among them."""

    shards: int
    bits: np.ndarray  #: shards x bytes

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and bit of each key."""
        h = X.mix(key.view(X.U))
        return (h % X.U(self.shards)).astype(np.int64), (h // X.U(self.shards) % X.U(8 * self.bits.shape[1])).astype(np.int64)

    def may_hold(self, key: np.ndarray) -> np.ndarray:
        shard, bit = self.of(key)
        return (self.bits[shard, bit >> 3] >> (7 - (bit & 7)) & 1).astype(bool)


class Pairs(NamedTuple):
    """The weights within classes, natural logarithms; both sorted by key."""

    keys: np.ndarray  #: previous word and word, as numbers in the table; the place before the first word comes after them
    weights: np.ndarray
    contexts: np.ndarray  #: previous word and class
    norms: np.ndarray  #: log of the normaliser
    rest: Rest | None = None  #: None if these are all

    def gain(self, before: np.ndarray, word: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of P(word | class, previous word) over P(word | class), as far as it is known here. ``before`` is -1, and
        ``word`` at least OTHER, for words outside the table."""
        return self.look(before, word, cls)[0]

    def look(self, before: np.ndarray, word: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The gain, and what else may add to it: tokens and keys. A context's key is negative."""
        key = (before << 32) | word
        at, found = _find(self.keys, key)
        out = np.where(found & (before >= 0), self.weights[at] if len(self.keys) else 0.0, 0.0)
        context = before * CLASSES + cls
        at, held = _find(self.contexts, context)
        out = (out - np.where(held & (before >= 0), self.norms[at] if len(self.contexts) else 0.0, 0.0)) / np.log(10)
        if self.rest is None:
            return out, np.zeros(0, np.int64), np.zeros(0, np.int64)
        one, two = np.flatnonzero(~found & (before >= 0) & (word < OTHER)), np.flatnonzero(~held & (before >= 0))
        token, key = np.concatenate([one, two]), np.concatenate([key[one], -1 - context[two]])
        there = self.rest.may_hold(key)
        return out, token[there], key[there]


def pair_places(t: Tokens, at: np.ndarray, found: np.ndarray, cls: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The previous word's number (-1 outside the table, ``words`` before the first) and the word's own of each token."""
    own = np.where(found, at, -1)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum(t.size) - t.size] = words
    return before, np.where(found, at, OTHER + cls)


def count_pairs(train: DataFrame, shared, shards: int) -> DataFrame:
    """(shard, keys, counts): exact counts of the pairs whose first word is in the table, the keys of a shard sorted."""

    def count(batches):
        m, table = shared.value
        held, n = [], 0

        def flush():
            key, c = np.unique(np.concatenate(held), return_counts=True)
            shard = (key >> 32) % shards
            order = np.argsort(shard, kind="stable")
            key, c = key[order], c[order].astype(np.uint32)
            for s, a, b in _cut(shard[order]):
                yield _rows(["shard", "keys", "counts"], [s], [_planes(np.diff(key[a:b], prepend=0))], [_planes(c[a:b])])

        for batch in batches:
            for _, _, buf, off in text_pieces(batch):
                t = tokenise(buf, off)
                at, found = _find(table.hashes, t.h)
                before, word = pair_places(t, at, found, m.cls[m.units.of(t.h, t.ending)], len(table.hashes))
                key = (before << 32) | word
                held.append(key[before >= 0])
                n += len(key)
                if n >= GATHERED:
                    yield from flush()
                    held, n = [], 0
                    give_back()
        if n:
            yield from flush()

    def add(key, table):
        keys = np.concatenate([np.cumsum(_unplanes(np.frombuffer(x.as_buffer(), np.uint8), np.int64)) for x in table.column("keys")])
        c = np.concatenate([_unplanes(np.frombuffer(x.as_buffer(), np.uint8), np.uint32) for x in table.column("counts")])
        u, back = np.unique(keys, return_inverse=True)
        return pa.table({"shard": [key[0].as_py()], "keys": [u.tobytes()], "counts": [np.bincount(back, c, len(u)).astype(np.int64).tobytes()]})

    sent = train.select("text").mapInArrow(count, "shard long, keys binary, counts binary")
    return stored(sent.groupBy("shard").applyInArrow(leanly(add), "shard long, keys binary, counts binary"), "pairs")


def _contexts(keys: np.ndarray, counts: np.ndarray, cls: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Which pairs are features; the context of every pair, the contexts and their counts; and which contexts have features."""
    before, word = keys >> 32, keys & 0xFFFFFFFF
    inside = word < OTHER
    context = before * CLASSES + np.where(inside, cls[np.where(inside, word, 0)] if len(cls) else 0, word - OTHER)
    contexts, at = np.unique(context, return_inverse=True)
    kept = inside & (counts >= least)
    return kept, at, contexts, np.bincount(at, counts, len(contexts)), np.unique(at[kept])


def fit_shard(keys: np.ndarray, counts: np.ndarray, cls: np.ndarray, share: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Keys, weights, contexts and log normalisers of a shard, which holds all pairs of its previous words.

    ``cls`` and ``share`` are the class and the share of its class of each word of the table. The gradient of a weight is
    the observed count (less the discount) minus the expected one; a round moves the weight by the log of their ratio.
    """
    kept, at, contexts, total, held = _contexts(keys, counts, cls, least)
    at, base, want = at[kept], share[keys[kept] & 0xFFFFFFFF], counts[kept] - DISCOUNT
    weight = np.zeros(len(at))
    for _ in range(PAIR_ROUNDS):
        norm = 1 + np.bincount(at, base * np.expm1(weight), len(contexts))
        step = np.log(want / (total[at] * base * np.exp(weight) / norm[at]))
        weight += step
        if not len(step) or np.abs(step).max() < SETTLED:
            break
    norm = 1 + np.bincount(at, base * np.expm1(weight), len(contexts))
    return keys[kept], weight.astype(np.float32), contexts[held], np.log(norm[held]).astype(np.float32)


def fit_pairs(pairs: DataFrame, m: Model, table: Table, most: int = PAIRS) -> tuple[Pairs, DataFrame | None]:
    """Every shard fits its own weights, those of all pairs seen ``LEAST_PAIR`` times. If there are at most ``most``, all come to
    the driver; or else the weights and the normalisers of the most frequent, ``most`` of each, and the others
    are (shard, keys, values), a row for each shard, sorted by key as unsigned numbers; the values are log10 and add up."""
    cls = m.cls[m.units.of(table.hashes, table.endings.astype(np.int64))]
    shared = pairs.sparkSession.sparkContext.broadcast((cls, (table.counts + 1) / 10 ** m.mass[cls]))  # bounded by the table

    def read(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                yield np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int64)

    def pair_histogram(batches):
        for keys, c in read(batches):
            yield _histogram(c[(keys & 0xFFFFFFFF < OTHER) & (c >= LEAST_PAIR)])

    def context_histogram(batches):
        for keys, c in read(batches):
            _, _, _, total, held = _contexts(keys, c, shared.value[0], LEAST_PAIR)
            yield _histogram(total[held].astype(np.int64))

    def fit(batches):
        for keys, c in read(batches):
            out = fit_shard(keys, c, *shared.value, LEAST_PAIR)
            yield _rows(["k", "w", "c", "z"], *[[x.tobytes()] for x in out])

    def gathered(got) -> Pairs:
        k, w, c, z = (np.frombuffer(b"".join(got.column(x).to_pylist()), kind) for x, kind in (("k", np.int64), ("w", np.float32), ("c", np.int64), ("z", np.float32)))
        one, two = np.argsort(k), np.argsort(c)
        return Pairs(k[one], w[one], c[two], z[two])

    least, here, total = _least(pairs.mapInArrow(pair_histogram, "step long, n long"), most)
    if here == total:
        return gathered(pairs.mapInArrow(fit, "k binary, w binary, c binary, z binary").toArrow()), None
    least_context, _, _ = _least(pairs.mapInArrow(context_histogram, "step long, n long"), most)
    shards = max(SLICES, m.tokens // WEIGHT_TOKENS)
    dealt = Rest(shards, np.zeros((1, 1), np.uint8))
    kinds = pa.schema([("shard", pa.int64()), *[(name, pa.binary()) for name in ("keys", "values", "k", "w", "c", "z")]])

    def deal(batches):
        held, n = [], 0

        def row(**columns):
            return pa.RecordBatch.from_pylist([{name: x.tobytes() if isinstance(x, np.ndarray) else x for name, x in columns.items()}], kinds)

        def flush():
            key, value = (np.concatenate(x) for x in zip(*held))
            shard = dealt.of(key)[0]
            order = np.argsort(shard, kind="stable")
            for s, a, b in _cut(shard[order]):
                yield row(shard=s, keys=key[order[a:b]], values=value[order[a:b]])

        for keys, c in read(batches):
            k, w, contexts, norms = fit_shard(keys, c, *shared.value, LEAST_PAIR)
            kept, _, _, total, own = _contexts(keys, c, shared.value[0], LEAST_PAIR)
            one, two = _steps(c[kept]) >= least, _steps(total[own].astype(np.int64)) >= least_context
            yield row(k=k[one], w=w[one], c=contexts[two], z=norms[two])
            held.append((np.concatenate([k[~one], -1 - contexts[~two]]), np.concatenate([w[~one], -norms[~two]]).astype(np.float64) / np.log(10)))
            n += len(held[-1][0])
            if n >= GATHERED:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def add(key, table):
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        k, value = join("keys", np.uint64), join("values", np.float64)
        order = np.argsort(k)
        return pa.table({"shard": [key[0].as_py()], "keys": [k[order].tobytes()], "values": [value[order].tobytes()]})

    before = made(pairs.sparkSession)
    fitted = stored(pairs.mapInArrow(deal, "shard long, keys binary, values binary, k binary, w binary, c binary, z binary"), "fitted")
    own = made(pairs.sparkSession) - before
    cold = stored(fitted.where("shard IS NOT NULL").groupBy("shard").applyInArrow(leanly(add), "shard long, keys binary, values binary"), "weights")
    rest = Rest(shards, np.zeros((shards, max(1, WEIGHT_BITS // 8 // shards)), np.uint8))
    width = rest.bits.shape[1]

    def mark(batches):
        for batch in batches:
            for s, keys in zip(batch.column("shard"), batch.column("keys")):
                h = X.mix(np.frombuffer(keys.as_buffer(), X.U))
                bits = np.zeros(8 * width, np.uint8)
                bits[(h // X.U(shards) % X.U(8 * width)).astype(np.int64)] = 1
                yield _rows(["shard", "bits"], [s.as_py()], [np.packbits(bits).tobytes()])

    for row in cold.mapInArrow(mark, "shard long, bits binary").toArrow().to_pylist():
        rest.bits[row["shard"]] = np.frombuffer(row["bits"], np.uint8)
    inner = gathered(fitted.where("shard IS NULL").select("k", "w", "c", "z").toArrow())._replace(rest=rest)
    release(pairs.sparkSession, own)
    return inner, cold


def train_model(train: DataFrame, words: DataFrame, table_words: int = TABLE_WORDS, rounds: int = ROUNDS, pairs: int = PAIRS) -> tuple[Model, Table, Pairs, list[float]]:
    """The model, as far as it is broadcast, and the log-likelihood of the classes a token before each round."""
    return learn(train, words, table_words, rounds, pairs)[:4]


def learn(train: DataFrame, words: DataFrame, table_words: int = TABLE_WORDS, rounds: int = ROUNDS, pairs: int = PAIRS) -> tuple[Model, Table, Pairs, list[float], DataFrame | None]:
    """The model, with the weights that aren't broadcast at the end. Rounds end when the log-likelihood no longer rises."""
    spark = train.sparkSession
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("v")).first()
    table, units = frequent(words, table_words)
    shared = spark.sparkContext.broadcast(units)  # bounded by TOP_WORDS
    cls = find_classes(train, shared)
    n, v = class_mass(words, shared, cls)
    cls = np.append(cls, 0)
    bias = np.log((n + 1) / (n.sum() + CLASSES))
    m = Model(units, cls, np.zeros((FEATURES, CLASSES), np.float32), bias.astype(np.float32), np.log10(n + v + 1), int(sums["n"]), int(sums["v"]))
    before = made(spark)
    counted = count_pairs(train, spark.sparkContext.broadcast((m._replace(weights=None), table)), max(SLICES, m.tokens // SHARD_TOKENS))
    own = made(spark) - before
    inner, weights_left = fit_pairs(counted, m, table, pairs)
    release(spark, own)  # what is left has been fitted
    seen, _ = feature_counts(train, spark.sparkContext.broadcast(m), False)
    guess = seen.sum(1, keepdims=True) * np.exp(bias)[None]  # what weights of zero expect
    weights, curve = np.zeros((FEATURES, CLASSES)), []
    for step in range(rounds + 1):
        if step:
            guess, likelihood = feature_counts(train, spark.sparkContext.broadcast(m), True)
            if curve and likelihood < curve[-1] + 1e-4:
                break
            curve.append(likelihood)
        weights += (RATE if step else FIRST_RATE) * np.log((seen + 2 * np.exp(bias)) / (guess + 2 * np.exp(bias)))
        m = m._replace(weights=np.clip(weights, -LIMIT, LIMIT).astype(np.float32))
    return m, table, inner, curve, weights_left


def token_scores(m: Model, table: Table, inner: Pairs, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token log10 of its count in the table plus 1, if it is there; whether it is; and the rest of its log10
    probability, as far as it is known here."""
    own, found, rest, _, _ = known_scores(m, table, inner, t)
    return own, found, rest


def known_scores(m: Model, table: Table, inner: Pairs, t: Tokens) -> tuple[np.ndarray, ...]:
    """``token_scores``, and the tokens and keys of weights that may add to them."""
    at, found = _find(table.hashes, t.h)
    unit = m.units.of(t.h, t.ending)
    k = m.cls[unit]
    rows = feature_rows(*histories(unit, t), m.cls)
    logp = np.empty(len(unit))
    for a, b in _blocks(len(unit)):
        p, total = odds(m, tuple(r[a:b] for r in rows))
        logp[a:b] = np.log10(p[np.arange(b - a), k[a:b]] / total)
    own = np.where(found, np.log10(table.counts[at] + 1.0) if len(table.counts) else 0.0, 0.0)
    gain, token, key = inner.look(*pair_places(t, at, found, k, len(table.hashes)), k)
    return own, found, logp - m.mass[k] + gain, token, key


SCORED = "row long, doc_id {id}, held_out boolean, n_tokens long, n_known long, base double, model double, shard long, hashes binary, rows binary"


def score_documents(docs: DataFrame, table_words: int = TABLE_WORDS, rounds: int = ROUNDS, pairs: int = PAIRS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Texts are read whole; one longer than a batch is a batch of its own, and takes some 100 bytes of memory for each word.

    A null text is empty and has its end token alone. A null doc_id is never held out. Rows that repeat
    are scored, and if they may be learned from, learned from, each for itself. Without a training part every token is unknown.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out_of = held_out(F.col("doc_id"), 7, 2)
    train = docs.where(~out_of).select("text")
    shards = max(SLICES, docs.rdd.getNumPartitions())
    words = count_words(train, shards)
    model, table, inner, _, weights = learn(train, words, table_words, rounds, pairs)
    shared = spark.sparkContext.broadcast((model, table, inner))  # bounded by table_words, pairs, WEIGHT_BITS and FEATURES
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "shard", "hashes", "rows"]
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        m, table, inner = shared.value
        norm = np.log10(m.tokens + m.words + 1)
        asked, sought, n, ids_type = [], [], 0, None

        def send():
            for held, shard_of, sign in ((asked, lambda h: (h % X.U(shards)).astype(np.int64), 0), (sought, lambda k: inner.rest.of(k)[0], -1)):
                if not held:
                    continue
                h, r = (np.concatenate(x) for x in zip(*held))
                shard = shard_of(h) ^ sign  # those of weights below zero
                order = np.argsort(shard, kind="stable")
                for s, a, b in _cut(shard[order]):
                    at = order[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array([None], k) for k in (pa.int64(), ids_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())] + [pa.array([s], pa.int64()), pa.array([_planes(h[at])]), pa.array([_planes(np.diff(r[at], prepend=0))])], names)

        for batch in batches:
            ids_type = batch.schema.field("doc_id").type
            row = batch.column("row").to_numpy()
            known, base, score, size = [], [], [], []
            for lo, hi, buf, off in text_pieces(batch):
                t = tokenise(buf, off)
                own, found, rest, token, key = known_scores(m, table, inner, t)
                texts = hi - lo
                known.append(np.bincount(t.doc, found, texts).astype(np.int64))
                base.append(np.bincount(t.doc, own - norm, texts))
                score.append(np.bincount(t.doc, own + rest, texts))
                size.append(t.size)
                if not table.complete and not found.all():
                    asked.append((t.h[~found], row[lo:hi][t.doc[~found]]))
                    n += len(asked[-1][0])
                if len(token):
                    sought.append((key, row[lo:hi][t.doc[token]]))
                    n += len(token)
            cols = [pa.array(np.concatenate(x)) for x in (size, known, base, score)]
            nothing = [pa.nulls(len(row), k) for k in (pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("held_out"), *cols, *nothing], names)
            if n >= TASK_TOKENS:
                yield from send()
                asked, sought, n = [], [], 0
        if n:
            yield from send()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", out_of.alias("held_out"), "text")
    done = rows.mapInArrow(run, SCORED.format(id=id_type))
    if not table.complete or weights is not None:
        done = stored(done, "scored")
    main, asked_of = done.where("shard IS NULL").select(*names[:7]), done.select("shard", "hashes", "rows")
    more, found, gain = F.lit(0.0), F.lit(0), F.lit(0.0)
    if not table.complete:
        extra = resolve(asked_of.where("shard >= 0"), words.select("shard", "hashes", "counts"), shards, lambda c: np.log10(c.view(np.int64) + 1.0))
        main = main.join(extra.select(F.col("row").alias("_r"), "more", "found"), F.col("row") == F.col("_r"), "left").drop("_r")
        more, found = F.coalesce("more", more), F.coalesce("found", found)
    if weights is not None:
        left = weights.select((-1 - F.col("shard")).alias("shard"), F.col("keys").alias("hashes"), F.col("values").alias("counts"))
        extra = resolve(asked_of.where("shard < 0"), left, inner.rest.shards, lambda x: x)
        main = main.join(extra.select(F.col("row").alias("_r"), F.col("more").alias("gain")), F.col("row") == F.col("_r"), "left").drop("_r")
        gain = F.coalesce("gain", gain)
    return main.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + found).cast("bigint").alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more + gain).alias("score"),
    )


def resolve(asked: DataFrame, held: DataFrame, shards: int, worth) -> DataFrame:
    """(row, more, found): for each row the sum of what its keys are worth, and how many of them are held. Held are (shard,
    hashes, counts), the hashes of a shard sorted; ``worth`` makes numbers of the counts, as 64-bit floats in memory."""

    def look(key, left, right):
        join = lambda t, name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind)
        apart = lambda name, kind: [_unplanes(np.frombuffer(x.as_buffer(), np.uint8), kind) for x in left.column(name)]
        h, r = np.concatenate([*apart("hashes", np.uint64), np.zeros(0, np.uint64)]), np.concatenate([*map(np.cumsum, apart("rows", np.int64)), np.zeros(0, np.int64)])
        u, value = join(right, "hashes", np.uint64), worth(join(right, "counts", np.float64))
        at, seen = _find(u, h)
        row, back = np.unique(r[seen], return_inverse=True)
        more, found = np.bincount(back, value[at[seen]], len(row)), np.bincount(back, minlength=len(row))
        share = (X.mix(row.view(X.U)) % X.U(shards)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        out = [(s, row[order[a:b]].tobytes(), more[order[a:b]].tobytes(), found[order[a:b]].astype(np.int64).tobytes()) for s, a, b in _cut(share[order])]
        return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate((("share", pa.int64()), ("row", pa.binary()), ("more", pa.binary()), ("found", pa.binary())))})

    def add(key, table):
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        row, back = np.unique(join("row", np.int64), return_inverse=True)
        return pa.table({"row": row, "more": np.bincount(back, join("more", np.float64), len(row)), "found": np.bincount(back, join("found", np.int64), len(row)).astype(np.int64)})

    sent = asked.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(leanly(look), "share long, row binary, more binary, found binary")
    return sent.groupBy("share").applyInArrow(leanly(add), "row long, more double, found long")


def op10_maxent_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(load(spark, sf_dir, "documents"))
