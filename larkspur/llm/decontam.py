"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every word sequence of the normalised items. Training words are streamed
through it: the state and the length of the longest match ending at each word are tracked, and
where the length reaches a window, the words of that window are hit and the state names the items
that hold it. Before that, numpy finds the stretches in which every neighbouring pair of words also
stands somewhere in an item; outside of them no match can reach a window, so only they are streamed.

Items are taken in blocks of a bounded number of words, of which a longer one is cut into overlapping parts. The
driver builds one automaton at a time and packs it into flat arrays; as many as fit ``PASS_BYTES`` go to
the executors together. More benchmark means more passes, whose hits are merged.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textnum as X
from larkspur.llm.common import bounded_batches, load, packed, stored, text_pieces, unpacked

#: Words of a window, words of the items of one automaton (about 1 KB each while it is built), bytes of the packed
#: automata of a pass (about 100 for a word; every Python worker holds them).
WINDOW, BLOCK_WORDS, PASS_BYTES = 8, 200_000, 64 << 20
#: A fixed value: what a word is, after A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def normalise(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_ASCII_LOWER))


class Automaton(NamedTuple):
    """Flat arrays. Lists of different lengths are cut from one array by the places where they begin."""

    vocabulary: np.ndarray  #: sorted word hashes
    pairs: np.ndarray  #: sorted codes of neighbouring words
    first: np.ndarray  #: where each state's transitions begin
    letter: np.ndarray  #: their words, sorted in each state
    target: np.ndarray  #: the states they lead to
    link: np.ndarray
    size: np.ndarray  #: longest match of each state
    at_window: np.ndarray  #: for states that reach a window: the state of its last ``window`` words
    item_first: np.ndarray  #: where the items of such a state begin
    items: np.ndarray
    short_first: np.ndarray  #: where the short items that end in a state begin
    short_size: np.ndarray  #: their words
    short_items: np.ndarray
    least: int  #: words of the shortest window
    window: int

    def bytes(self) -> int:
        return sum(x.nbytes for x in self if isinstance(x, np.ndarray))


def build(items: list[tuple[int, list[str]]], window: int = WINDOW) -> Automaton:
    """The generalised suffix automaton of the items (number, words), built online."""
    hashes = {}
    for _, words in items:
        for w in words:
            if w not in hashes:
                raw = np.frombuffer(w.encode(), np.uint8)
                hashes[w] = int(X.hash_words(raw, X.Words(np.array([0]), np.array([len(raw)]), np.array([0, 1]), np.array([0])))[0])
    vocabulary = np.array(sorted(set(hashes.values())), np.uint64)
    ids = {w: int(np.searchsorted(vocabulary, np.uint64(h))) for w, h in hashes.items()}
    nxt: list[dict[int, int]] = [{}]
    link, size = [-1], [0]

    def extend(last: int, c: int) -> int:
        if c in nxt[last]:  # the item repeats what an earlier one has
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else split(last, c, q)
        new = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if size[q] == size[p] + 1 else split(p, c, q)
        return new

    def split(p: int, c: int, q: int) -> int:
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    coded = [(i, [ids[w] for w in words]) for i, words in items if words]
    for _, words in coded:
        last = 0
        for c in words:
            last = extend(last, c)

    # states that reach a window: the one in whose range of lengths `window` lies
    at_window = [-1] * len(nxt)
    for s in sorted(range(1, len(nxt)), key=size.__getitem__):
        if size[s] >= window:
            at_window[s] = s if size[link[s]] < window else at_window[link[s]]
    held: dict[int, set[int]] = {}
    ends: dict[int, set[tuple[int, int]]] = {}
    pairs: set[int] = set()
    n = max(len(vocabulary), 1)
    for i, words in coded:
        s = 0
        for k, c in enumerate(words):
            s = nxt[s][c]
            if k:
                pairs.add(words[k - 1] * n + c)
            if k + 1 >= window:
                held.setdefault(at_window[s], set()).add(i)
        if len(words) < window:
            ends.setdefault(s, set()).add((len(words), i))
    short: dict[int, tuple] = {}
    if ends:
        for s in sorted(range(1, len(nxt)), key=size.__getitem__):
            own = tuple(sorted(ends.get(s, ())))
            both = short.get(link[s], ()) + own
            if both:
                short[s] = both
    least = min([len(w) for _, w in coded if len(w) < window], default=window)

    def flat(lists: dict, pick) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(nxt) + 1, np.int64)
        for s, x in lists.items():
            counts[s + 1] = len(x)
        return np.cumsum(counts).astype(np.int32), np.array([pick(x) for s in sorted(lists) for x in lists[s]], np.int64)

    steps = dict(enumerate(sorted(t.items()) for t in nxt))
    first, letter = flat(steps, lambda x: x[0])
    target = flat(steps, lambda x: x[1])[1].astype(np.int32)
    item_first, held_items = flat({s: sorted(v) for s, v in held.items()}, lambda x: x)
    short_first, short_size = flat(short, lambda x: x[0])
    short_items = flat(short, lambda x: x[1])[1]
    ints = (np.array(x, np.int32) for x in (link, size, at_window))
    return Automaton(vocabulary, np.array(sorted(pairs), np.int64), first, letter.astype(np.int32), target, *ints, item_first, held_items, short_first, short_size, short_items, least, window)


def stream(a: Automaton, words: list[int]):
    """(position past the match, its words, items) wherever a window ends."""
    first, letter, target, link, size, at_window = map(memoryview, (a.first, a.letter, a.target, a.link, a.size, a.at_window))
    item_first, short_first, window = memoryview(a.item_first), memoryview(a.short_first), a.window
    s = length = 0
    for k, c in enumerate(words, 1):
        while True:
            lo, hi = first[s], first[s + 1]
            at = lo if hi - lo == 1 else bisect_left(letter, c, lo, hi)
            if at < hi and letter[at] == c:
                s, length = target[at], length + 1
                break
            if not s:
                length = 0
                break
            s = link[s]
            length = size[s]
        if length >= window:
            w = at_window[s]
            yield k, window, a.items[item_first[w] : item_first[w + 1]].tolist()
        for i in range(short_first[s], short_first[s + 1]):
            if (n := int(a.short_size[i])) <= length:
                yield k, n, (int(a.short_items[i]),)


def find(automata: list[Automaton], buf: np.ndarray, off: np.ndarray):
    """Word positions of a piece of texts, and (text, first word, past the last, items) of each hit."""
    buf = X.LOWER[buf]
    w = X.find_words(buf, off, X.WORDLIKE)
    found: list[tuple] = []
    h = X.hash_words(buf, w)
    for a in automata if len(h) else ():
        if not len(a.vocabulary):
            continue
        at = np.minimum(np.searchsorted(a.vocabulary, h), len(a.vocabulary) - 1)
        known = a.vocabulary[at] == h
        joined = np.zeros(len(h), bool)  # joined[i]: words i-1 and i are neighbours in an item too
        both = np.flatnonzero(known[1:] & known[:-1] & (w.doc[1:] == w.doc[:-1])) + 1
        if len(a.pairs) and len(both):
            code = at[both - 1] * len(a.vocabulary) + at[both]
            place = np.minimum(np.searchsorted(a.pairs, code), len(a.pairs) - 1)
            joined[both] = a.pairs[place] == code
        begin = np.flatnonzero(known & ~joined)
        ends = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        long = ends - begin >= a.least
        for b, e in zip(begin[long].tolist(), ends[long].tolist()):
            d = int(w.doc[b])
            found += [(d, b + k - n, b + k, items) for k, n, items in stream(a, at[b:e].tolist())]
    return w, found


def _blocks(benchmark: DataFrame, block_words: int, window: int):
    """Lists of (item_id, words) of a bounded number of words, one at a time on the driver. A longer item is cut
    into parts that share window - 1 words, which hold all its windows."""
    block, n = [], 0
    for row in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").orderBy("item_id").toLocalIterator():
        words = normalise(row["text"])
        for at in range(0, max(len(words) - window + 1, 1), max(block_words, 1)):
            part = words[at : at + block_words + window - 1]
            if part:
                block.append((row["item_id"], part))
                n += len(part)
            if n >= block_words:
                yield block
                block, n = [], 0
    if block:
        yield block


def _passes(benchmark: DataFrame, block_words: int, window: int, most: int):
    """Lists of automata of bounded bytes. There is one at least, which may be empty."""
    held, n = [], 0
    for block in _blocks(benchmark, block_words, window):
        a = build(block, window)
        if held and n + a.bytes() > most:
            yield held
            held, n = [], 0
        held.append(a)
        n += a.bytes()
    yield held or [build([], window)]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), block_words: int = BLOCK_WORDS, pass_bytes: int = PASS_BYTES, cut=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``n_words``, ``n_hit``, ``hits`` (a bit for each word, packed), the
    distinct ``items`` with windows in it, and the columns in ``keep``.

    A null text has no words; null items and items without an id take no part; items that share an id
    are one item; rows that repeat are judged each for themselves; without items nothing is hit.
    ``cut`` (text, hit bits) gives the text that takes the text's place, or None for a row that goes. Texts are
    streamed whole; one longer than a batch is a batch of its own, and takes some 30 bytes of memory for each byte.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    columns = ["doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")]]
    out = docs.select(*columns)
    fields = [f for f in out.schema if f.name in ("doc_id", *columns)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["`_n` long", "`_hit` long", "`_hits` binary", "`_items` array<long>"])

    def one(df: DataFrame, automata, first: bool, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(automata)  # bounded by pass_bytes

        def run(batches):
            for batch in batches:
                n, bits, count, items, stays = [], [], [], [], []
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist() if cut and last else None
                old = None if first else (batch.column("_hits").to_pylist(), batch.column("_items").to_pylist())
                for lo, hi, buf, off in text_pieces(batch):
                    w, found = find(shared.value, buf, off)
                    hit, held = np.zeros(len(w.start) + 1, np.int32), {}
                    for d, b, e, its in found:
                        hit[b] += 1
                        hit[e] -= 1
                        held.setdefault(d, set()).update(its)
                    hit = np.cumsum(hit[:-1]) > 0
                    for d in range(hi - lo):
                        own = np.packbits(hit[w.first[d] : w.first[d + 1]])
                        if old:
                            own |= np.frombuffer(old[0][lo + d], np.uint8)
                            held.setdefault(d, set()).update(old[1][lo + d])
                        n.append(int(w.first[d + 1] - w.first[d]))
                        bits.append(own.tobytes())
                        count.append(int.from_bytes(bits[-1]).bit_count())
                        items.append(sorted(held.get(d, ())))
                        if texts is not None:
                            new = cut(texts[lo + d], np.unpackbits(own)[: n[-1]]) if count[-1] else texts[lo + d]
                            stays.append(not count[-1] or new is not None)
                            texts[lo + d] = new
                cols = [pa.array(texts, pa.string()) if texts is not None and c == "text" else batch.column(batch.schema.get_field_index(c)) for c in columns]
                out = pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(count, pa.int64()), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.int64()))], [*columns, "_n", "_hit", "_hits", "_items"])
                yield out.filter(pa.array(stays, pa.bool_())) if texts is not None else out

        return df.mapInArrow(run, schema)

    passes, first = _passes(benchmark, block_words, window, pass_bytes), True
    automata = next(passes)
    while automata is not None:
        following = next(passes, None)
        out = one(out if first else stored(out, "decontam"), automata, first, following is None)
        automata, first = following, False
    return out.select("doc_id", *[c for c in columns if c in keep and c != "doc_id"], F.col("_n").alias("n_words"), F.col("_hit").alias("n_hit"), F.col("_hits").alias("hits"), F.col("_items").alias("items"))


def removed_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = WINDOW, most_share: float = 0.5, mark: str = " ") -> DataFrame:
    """``docs`` cleaned: runs of at least ``least_words`` hit words are cut out of the text, and so are
    runs shorter than ``window``, which only whole short items can hit; documents with more than
    ``most_share`` of their words hit go altogether."""

    def cut(text, bits):
        if bits.sum() > most_share * len(bits):
            return None
        edge = np.flatnonzero(np.diff(np.concatenate([[0], bits.astype(np.int8), [0]])))
        spans = [m.span() for m in WORD.finditer(text.translate(_ASCII_LOWER))]
        out, at = [], 0
        for b, e in zip(edge[::2], edge[1::2]):
            if e - b >= least_words or e - b < window:
                out.append(text[at : spans[b][0]])
                at = spans[e - 1][1]
        return mark.join([*out, text[at:]]) if out else text

    return unpacked(matches(packed(docs), benchmark, window, ("text", "_row"), cut=cut), docs.columns)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def sql(window: int = WINDOW) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""WITH d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
        b AS MATERIALIZED (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
        win AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') AS g, least(len(w), {window}) AS n
          FROM (SELECT *, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        hit AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM pos, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)) JOIN win USING (g, n)),
        word AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), range(0, {window}) AS r(j) WHERE j < n GROUP BY doc_id),
        item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hit GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)"""
