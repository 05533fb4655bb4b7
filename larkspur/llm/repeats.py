"""Removal of long repeats by prefix-partitioned suffix groups, cut at the window's depth.

The suffixes of all texts that have a window's words left are dealt to groups by variable-length
prefixes of 1, 2, 4, 8, 16 words and at last the whole window: counts of a first pass over the corpus say which
is the shortest prefix that few enough suffixes share, so that every group fits in memory. Nodes deeper than
the window aren't built, since they remove no further word: every window of a deeper repeat is a node at
the window's depth itself. A group finds these nodes by sorting the suffixes on the fingerprint of their path,
the window's words; a node's leaves are its places. Every leaf but the earliest is marked, and the
marked windows' words are removed.

This is less than a suffix tree: suffixes carry a fingerprint in place of their words, so a group knows no node above or
below the window's depth, and reports no maximal repeats but the runs of marked windows (``repeat_spans``).
README says what the words would cost.

Equal windows within one task are settled there, so that however often one passage repeats, a
task sends it once. Windows travel as packed arrays, a row for each task and group.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textnum as X
from larkspur.llm.common import bounded_batches, filter_bit, has_bit, key_filter, leanly, load, row_batches, stored, text_pieces

WINDOW = 20
#: Windows that a task settles at once, and windows of a group.
TASK_WINDOWS, GROUP_WINDOWS = 800_000, 400_000
#: Marks of a row that a task has settled itself.
ROW_MARKS = 100_000
#: Prefixes of each length are counted in so many bins.
BINS = 1 << 16
NULL_ID = -(1 << 63)


def lengths(window: int) -> list[int]:
    """Of the prefixes, the last one the window itself."""
    return [1 << k for k in range(window.bit_length()) if 1 << k < window] + [window]


def _windows(w: X.Words, h: np.ndarray, window: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First words of the windows that lie in one text, and the hashes of their prefixes of each length."""
    if len(h) < window:
        return np.zeros(0, np.int64), [np.zeros(0, X.U)] * len(lengths(window))
    at = np.flatnonzero(w.doc[window - 1 :] == w.doc[: len(h) - window + 1])
    powers = X.doubled(h, window)
    return at, [*[powers[k][at] for k in lengths(window)[:-1]], X.hash_ngrams(h, window, powers)[at]]


def _bins(h: np.ndarray) -> np.ndarray:
    return (X.mix(h) & X.U(BINS - 1)).astype(np.int64)


def count_prefixes(docs: DataFrame, window: int) -> np.ndarray:
    """How many windows begin with a prefix of each bin, for each length. Tasks sum their own; sums of sums come to the driver."""
    shape = (len(lengths(window)), BINS)

    def count(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for _, _, buf, off in text_pieces(batch):
                w = X.find_words(buf, off, X.NOT_SPACE)
                at, prefixes = _windows(w, X.hash_words(buf, w), window)
                if len(at):
                    for row, h in zip(total, prefixes):
                        row += np.bincount(_bins(h), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    def add(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), np.int64).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    sums = docs.select("text").mapInArrow(count, "counts binary")
    parts = max(1, int(sums.rdd.getNumPartitions() ** 0.5))
    out = np.zeros(shape, np.int64)
    for row in sums.repartition(parts).mapInArrow(add, "counts binary").toLocalIterator():
        out += np.frombuffer(row["counts"], np.int64).reshape(shape)
    return out


def plan_groups(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each length and bin the first group, or -1 where a longer prefix decides, and the number of groups; and all groups.

    A bin's count holds windows that a shorter prefix has placed already, so it is an upper bound; for sharing a group
    among neighbouring light bins it is taken by the share of windows that are left. Only a window can be its
    own longest prefix: bins of whole windows that are too full are split by the window's fingerprint.
    """
    base, parts = np.full(counts.shape, -1, np.int64), np.ones(counts.shape, np.int64)
    group, left, total = 0, 1.0, max(int(counts[0].sum()), 1)
    for k, row in enumerate(counts):
        last = k == len(counts) - 1
        light = row <= most
        fill = np.where(light, row, 0) * left
        base[k] = np.where(light, group + np.floor(np.cumsum(fill) / most).astype(np.int64), -1)
        group = int(base[k].max(initial=group - 1)) + 1
        if last and not light.all():
            heavy = np.flatnonzero(~light)
            parts[k, heavy] = -(-row[heavy] // most)
            base[k, heavy] = group + np.cumsum(parts[k, heavy]) - parts[k, heavy]
            group += int(parts[k, heavy].sum())
        left *= min(1.0, float(row[~light].sum()) / total)
    return base, parts, group


def place(plan: tuple[np.ndarray, np.ndarray], prefixes: list[np.ndarray]) -> np.ndarray:
    """The group of each window: by its shortest prefix that few enough windows share."""
    base, parts = plan
    out = np.full(len(prefixes[0]), -1, np.int64)
    for k, h in enumerate(prefixes):
        open_ = np.flatnonzero(out < 0)
        if not len(open_):
            break
        at = _bins(h[open_])
        found = base[k][at]
        if k == len(prefixes) - 1:
            found = found + (h[open_] % parts[k][at].astype(X.U)).astype(np.int64)
        out[open_] = found
    return out


def _planes(a: np.ndarray) -> bytes:
    """Byte planes: leading zeros become runs, which the shuffle's codec shrinks away."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(raw: np.ndarray, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def pack(d: np.ndarray, s: np.ndarray, h: np.ndarray | None = None) -> bytes:
    dd = np.diff(d, prepend=np.int64(0))
    ds = np.diff(s.astype(np.int32), prepend=np.int32(0))
    return _planes(dd) + _planes(ds) + (h.tobytes() if h is not None else b"")


def unpack(raw, hashes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    raw = np.frombuffer(raw, np.uint8)
    n = len(raw) // (20 if hashes else 12)
    d = np.cumsum(_unplanes(raw[: 8 * n], np.int64))
    s = np.cumsum(_unplanes(raw[8 * n : 12 * n], np.int32), dtype=np.int32)
    return d, s, np.frombuffer(raw[12 * n :].tobytes(), np.uint64) if hashes else None


def settle(h: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows in any order: which are the earliest of their sequence, and which come later.

    A window at the very place of the earliest (a row that repeats) is neither.
    """
    order = np.argsort(h)
    sorted_ = h[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(h)))
    first, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    first[order[begin[size == 1]]] = True
    many = np.repeat(size > 1, size)
    if many.any():
        place = order[many]
        place = place[np.lexsort((s[place], d[place], h[place]))]
        hp, dp, sp = h[place], d[place], s[place]
        new = np.concatenate([[True], hp[1:] != hp[:-1]])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        first[place[new]] = True
        later[place[(dp != dp[lead]) | (sp != sp[lead])]] = True
    return first, later


MARKS = "doc_id long, starts binary"


def _marks(d: np.ndarray, s: np.ndarray) -> pa.Table:
    """A row for each document: the marked starts, sorted."""
    order = np.lexsort((s, d))
    d, s = d[order], s[order].astype("<u4")
    cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(d))
    return pa.table({"doc_id": pa.array(d[cut], pa.int64()), "starts": pa.array([s[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())})


def mark_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, starts): the windows whose word sequence also starts earlier, one row per document that has any.

    A null doc_id is the smallest id. Marks leave the groups as packed arrays, a row for each group and
    share of the documents, and meet again per share.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = count_prefixes(docs, window)
    most = int(min(max(counts[0].sum() // (4 * spark.sparkContext.defaultParallelism), 100_000), GROUP_WINDOWS))
    base, parts, groups = plan_groups(counts, most)
    plan = spark.sparkContext.broadcast((base, parts))  # two numbers for each length and bin
    shares = max(4 * spark.sparkContext.defaultParallelism, groups // 2)

    def run(batches):
        held, n, turn = [], 0, 0

        def flush():
            nonlocal held, n, turn
            h, d, s, group = (np.concatenate(x) for x in zip(*held))
            held, n = [], 0
            first, later = settle(h, d, s)
            marked = np.flatnonzero(later)
            for a in range(0, len(marked), ROW_MARKS):
                turn += 1
                yield -turn, pack(d[marked[a : a + ROW_MARKS]], s[marked[a : a + ROW_MARKS]])
            h, d, s, group = h[first], d[first], s[first], group[first]
            order = np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable")
            sorted_ = group[order]
            cut = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            for a, b in zip(cut, np.append(cut[1:], len(sorted_))):
                at = order[a:b]
                yield int(sorted_[a]), pack(d[at], s[at], h[at])

        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            for a, b, buf, off in text_pieces(batch):
                w = X.find_words(buf, off, X.NOT_SPACE)
                at, prefixes = _windows(w, X.hash_words(buf, w), window)
                if len(at):
                    doc = w.doc[at]
                    held.append((prefixes[-1], ids[a:b][doc], (at - w.first[doc]).astype(np.int32), place(plan.value, prefixes).astype(np.int32)))
                    n += len(at)
                if n >= TASK_WINDOWS:
                    yield from row_batches(flush(), ["group", "packed"])
        if n:
            yield from row_batches(flush(), ["group", "packed"])

    def trees(key, table):
        own = key[0].as_py() >= 0
        d, s, h = (np.concatenate(x) if x[0] is not None else None for x in zip(*[unpack(raw.as_buffer(), own) for raw in table.column("packed")]))
        if own:
            _, later = settle(h, d, s)
            d, s = d[later], s[later]
        share = (X.mix(d.view(X.U)) % X.U(shares)).astype(np.int64)
        order = np.lexsort((s, d, share))
        d, s, share = d[order], s[order], share[order]
        cut = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1]])) if len(d) else np.zeros(0, np.int64)
        packed = [pack(d[a:b], s[a:b]) for a, b in zip(cut, np.append(cut[1:], len(d)))]
        return pa.table({"share": pa.array(share[cut], pa.int64()), "packed": pa.array(packed, pa.binary())})

    def gather(key, table):
        d, s, _ = zip(*[unpack(raw.as_buffer(), False) for raw in table.column("packed")])
        return _marks(np.concatenate(d), np.concatenate(s))

    sent = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "group long, packed binary")
    marked = sent.groupBy("group").applyInArrow(leanly(trees), "share long, packed binary")
    return marked.groupBy("share").applyInArrow(leanly(gather), MARKS)


def repeat_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, end): the runs of words that a marked window covers, in words from 0, end exclusive."""

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("starts").to_pylist()):
                s = np.unique(np.frombuffer(raw, "<u4")).astype(np.int64)
                new = np.concatenate([[True], s[1:] > s[:-1] + window])
                begin = s[new]
                end = np.append(s[:-1][new[1:]], s[-1]) + window
                for c, v in zip(out, ([None if d == NULL_ID else d] * len(begin), begin.tolist(), end.tolist())):
                    c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "end"])

    return mark_repeats(docs, window).mapInArrow(run, "doc_id long, start long, end long")


def _clean(text: bytes, starts: bytes, window: int) -> tuple[bytes, int]:
    words = text.split()
    edge = np.zeros(len(words) + window + 1, np.int64)
    s = np.unique(np.frombuffer(starts, "<u4")).astype(np.int64)
    s = s[s + window <= len(words)]
    edge[s] += 1
    edge[s + window] -= 1
    keep = np.cumsum(edge)[: len(words)] == 0
    return b" ".join(compress(words, keep.tolist())), int(len(words) - keep.sum())


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and the kept ``text`` if asked for.

    A null text has no words. Rows with one doc_id are judged as one document: a place that is removed
    in one of them is removed in all, and an equal window at an equal place is not an earlier one. Texts are
    read whole; one longer than a batch is a batch of its own, and takes some 100 bytes of memory for each word.
    """
    spark = docs.sparkSession
    marks = stored(mark_repeats(docs, window), "marks")
    bitmap = key_filter(marks, "doc_id")
    bits = 64 * len(bitmap)
    shared = spark.sparkContext.broadcast(bitmap)  # 16 MB at most
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID))
    names = ["doc_id", "_key", "n_words", "sha", "_text"]

    def split(batches):
        for batch in batches:
            hit = has_bit(shared.value, batch.column("_bit").to_numpy())
            out_n, out_sha, out_text = [], [], []
            for text, h in zip(batch.column("text").to_pylist(), hit.tolist()):
                raw = (text or "").encode()
                words = raw.split()
                out_n.append(len(words))
                out_sha.append(None if h else hashlib.sha256(b" ".join(words)).hexdigest())
                out_text.append(raw if h else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), pa.array(out_n, pa.int64()), pa.array(out_sha, pa.string()), pa.array(out_text, pa.binary())], names)

    id_type = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", key.alias("_key"), "text").withColumn("_bit", filter_bit(bits, "_key"))
    rows = rows.mapInArrow(split, f"doc_id {id_type}, _key long, n_words long, sha string, _text binary")
    marks = marks.select(F.col("doc_id").alias("_k"), F.col("starts").alias("marks"))
    both = rows.join(marks, F.col("_key") == F.col("_k"), "left").select("doc_id", "n_words", "sha", "_text", "marks")

    def clean(batches):
        for batch in batches:
            removed, sha, kept = [], [], []
            for text, own, starts in zip(*[batch.column(c).to_pylist() for c in ("_text", "sha", "marks")]):
                n = 0
                if own is None:
                    text, n = _clean(text, starts or b"", window)
                    own = hashlib.sha256(text).hexdigest()
                removed.append(n)
                sha.append(own)
                kept.append(text.decode() if texts and text is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    out = both.mapInArrow(clean, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, text string")
    return out if texts else out.drop("text")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))


def sql(window: int = WINDOW) -> str:
    return rf"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
        late AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
        gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS i FROM late, range(0, {window}) AS r(j)),
        pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM pos WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = pos.doc_id AND gone.i = pos.i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
