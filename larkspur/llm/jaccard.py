"""Exact Jaccard self-join of documents on word 5-grams, by grouped prefixes.

1. Every text becomes a set of hashed shingles; equal sets are one class from here on.
2. Shingles meet by hash range. One that stands in a single class can't add to any overlap, so only
   repeated ones go on, each with its document frequency. Very frequent ones (a bounded table from
   a first pass) skip the meeting and come last in the order.
3. Per class, shingles are ordered: single ones first, then by frequency. Two sets that reach the
   threshold share a shingle among the first n - ceil(t n) + 1. Where single ones fill that prefix,
   the class has no partner and drops out. Classes with the same prefix and size form one group.
4. Groups meet in a list for each prefix shingle; lists with the same members count once. A pair of
   groups is a candidate if sizes and positions leave room for the overlap; groups are expanded to members.
5. Candidates are verified on their repeated shingles, which hold the whole overlap. First each class
   is tested against one central member of its lists, then against another; what these tests link needs
   no further one. At last the pairs of groups that leave room are listed, each once, groups that are
   connected already left out; they are expanded to members, and every pair of members that isn't
   connected yet is verified.
6. Links are counted inside the components, which hold them all: classes are dealt to blocks by size, blocks
   of sizes that can link meet, and a task counts the links of two blocks without a row for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textnum as X
from larkspur.llm.common import bounded_batches, filter_bit, has_bit, key_filter, leanly, load, row_batches, stored, text_pieces
from larkspur.llm.graph import components

SHINGLE, PERCENT = 5, 75
#: Shingles that a task handles at once, shingles of a bucket, rows of one shingle in one task.
TASK_SHINGLES, BUCKET_SHINGLES, LIST_ROWS = 1_000_000, 1_000_000, 50_000
#: A shingle is frequent if one task sees it in so many classes; the table keeps the most frequent ones.
FREQUENT, TABLE = 48, 1 << 16
SHARDS = 16
#: Rounds of tests against one member, before all pairs that are left.
ROUNDS = 3
#: Rows of a list, or lists of a class, that join as one key; more are several keys.
CELL = 256
#: Classes and shingles of a block in which links are counted.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 500_000


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE):
    """The sorted distinct shingle hashes of each text; fewer than k words are one shingle, no word none."""
    buf = X.LOWER[buf]
    w = X.find_words(buf, off, X.NOT_SPACE)
    h = X.hash_words(buf, w)
    grams = X.hash_ngrams(h, k)
    for i in range(len(off) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            yield X.hash_ngrams(h[a:b], b - a) if b > a else h[:0]


def class_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True)


def _cut(keys: np.ndarray):
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return zip(keys[begin].tolist(), begin.tolist(), np.append(begin[1:], len(keys)).tolist())


def _chunks(batches, most: int):
    """Distinct sets of a task, in chunks of about ``most`` shingles: (class ids, sizes, all shingles)."""
    ids, sizes, sets, seen, n = [], [], [], set(), 0
    for batch in batches:
        for _, _, buf, off in text_pieces(batch):
            for s in shingle_sets(buf, off):
                if len(s) and (c := class_id(s)) not in seen:
                    seen.add(c)
                    ids.append(c)
                    sizes.append(len(s))
                    sets.append(s)
                    n += len(s)
            if n >= most:
                yield np.array(ids, np.int64), np.array(sizes, np.int64), np.concatenate(sets)
                ids, sizes, sets, seen, n = [], [], [], set(), 0
    if n:
        yield np.array(ids, np.int64), np.array(sizes, np.int64), np.concatenate(sets)


class Frequent:
    """The very frequent shingles, sorted by hash, with their frequencies and ranks from the rarest up."""

    def __init__(self, h: np.ndarray, count: np.ndarray):
        order = np.argsort(h)
        self.h, self.count = h[order], count[order]
        self.rank = np.empty(len(h), np.int64)
        self.rank[np.lexsort((self.h, self.count))] = np.arange(len(h))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h


def describe(docs: DataFrame) -> tuple[DataFrame, Frequent]:
    """(doc_id, n, sid) of every row, and the table of very frequent shingles."""
    id_type = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n", "sid", "shard", "packed"]

    def run(batches):
        def info(batches):
            for batch in batches:
                n, sid = [], []
                for _, _, buf, off in text_pieces(batch):
                    for s in shingle_sets(buf, off):
                        n.append(len(s))
                        sid.append(class_id(s))
                        if len(s) and sid[-1] not in seen:
                            seen.add(sid[-1])
                            held.append(s)
                            total[0] += len(s)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())], names)

        seen, held, total = set(), [], [0]

        def count():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c >= FREQUENT], c[c >= FREQUENT].astype(np.int64)
            for s, a, b in _cut((h >> X.U(60)).astype(np.int64)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, id_kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([s], pa.int64()), pa.array([h[a:b].tobytes() + c[a:b].tobytes()])], names)

        id_kind = None

        def typed(batches):
            nonlocal id_kind
            for batch in batches:
                id_kind = batch.schema.field("doc_id").type
                yield batch

        for out in info(typed(batches)):
            yield out
            if total[0] >= TASK_SHINGLES:
                yield from count()
                seen.clear()
                held.clear()
                total[0] = 0
        if held:
            yield from count()

    def add(key, table):
        h, c = [], []
        for raw in table.column("packed"):
            x = np.frombuffer(raw.as_buffer(), np.uint64)
            h.append(x[: len(x) // 2])
            c.append(x[len(x) // 2 :].view(np.int64))
        u, back = np.unique(np.concatenate(h), return_inverse=True)
        total = np.bincount(back, np.concatenate(c), len(u)).astype(np.int64)
        best = np.lexsort((u, -total))[: TABLE // SHARDS]
        return pa.table({"h": u[best].view(np.int64), "c": total[best]})

    both = stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n long, sid long, shard long, packed binary"), "classes")
    got = both.where("shard IS NOT NULL").select("shard", "packed").groupBy("shard").applyInArrow(leanly(add), "h long, c long").toArrow()
    return both.where("shard IS NULL").select("doc_id", "n", "sid"), Frequent(got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy())


def _pack_sets(ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, h: np.ndarray, df: np.ndarray | None = None) -> bytes:
    head = np.array([len(ids)], np.int64).tobytes()
    return head + ids.tobytes() + sizes.astype(np.int32).tobytes() + counts.astype(np.int32).tobytes() + h.tobytes() + (df.astype(np.int64).tobytes() if df is not None else b"")


def _unpack_sets(raw, with_df: bool):
    raw = bytes(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids = np.frombuffer(raw, np.int64, n, 8)
    sizes, counts = np.frombuffer(raw, np.int32, n, 8 + 8 * n), np.frombuffer(raw, np.int32, n, 8 + 12 * n)
    m = int(counts.sum())
    at = 8 + 16 * n
    h = np.frombuffer(raw, np.uint64, m, at)
    df = np.frombuffer(raw, np.int64, m, at + 8 * m) if with_df else None
    return np.repeat(ids, counts), np.repeat(sizes, counts).astype(np.int64), h, df


def _by_share(sid: np.ndarray, n: np.ndarray, h: np.ndarray, df: np.ndarray, shares: int):
    """Packed rows for each share of the classes."""
    share = (X.mix(sid.view(X.U)) % X.U(shares)).astype(np.int64)
    order = np.lexsort((h, sid, share))
    sid, n, h, df, share = sid[order], n[order], h[order], df[order], share[order]
    for s, a, b in _cut(share):
        cut = list(_cut(sid[a:b]))
        first = np.array([x for _, x, _ in cut]) + a
        counts = np.array([y - x for _, x, y in cut])
        yield s, _pack_sets(sid[first], n[first], counts, h[a:b], df[a:b])


def need(n, m):
    """Least overlap of sets of sizes n and m that reach the threshold: PERCENT / (100 + PERCENT) of both, rounded up."""
    return -(-(PERCENT * (n + m)) // (100 + PERCENT))


def partners(docs: DataFrame, frequent: Frequent, shingles: int) -> DataFrame:
    """(sid, gid, n, q, single, tokens): the classes that can have partners, with their repeated shingles in order."""
    spark = docs.sparkSession
    lanes = spark.sparkContext.defaultParallelism
    most = int(min(max(shingles // (4 * lanes), 100_000), BUCKET_SHINGLES))
    buckets = max(1, -(-shingles // most))
    shares = max(2 * lanes, buckets // 2)
    shared = spark.sparkContext.broadcast(frequent)  # bounded by TABLE

    def rows_of(batches):
        common = shared.value
        for ids, sizes, h in _chunks(batches, TASK_SHINGLES):
            own = np.repeat(np.arange(len(ids)), sizes)
            at, hot = common.find(h)
            if hot.any():
                for s, raw in _by_share(ids[own[hot]], sizes[own[hot]], h[hot], (1 << 40) + common.rank[at[hot]], shares):
                    yield -1 - s, raw
            own, h = own[~hot], h[~hot]
            bucket = ((h >> X.U(32)) * X.U(buckets) >> X.U(32)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            sorted_ = bucket[order]
            for k, a, b in _cut(sorted_):
                o = own[order[a:b]]
                new = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                raw = _pack_sets(ids[o[new]], sizes[o[new]], np.diff(np.append(new, len(o))), h[order[a:b]])
                yield k, raw

    def send(batches):
        yield from row_batches(rows_of(batches), ["bucket", "packed"])

    out = pa.schema([("share", pa.int64()), ("packed", pa.binary())])

    def meet(key, table):
        k = key[0].as_py()
        if k < 0:
            return pa.table({"share": pa.array([-1 - k] * table.num_rows, pa.int64()), "packed": table.column("packed")}, out)
        sid, n, h, _ = (np.concatenate(x) if x[0] is not None else None for x in zip(*[_unpack_sets(raw.as_buffer(), False) for raw in table.column("packed")]))
        order = np.argsort(h)
        hs = h[order]
        same = hs[1:] == hs[:-1]
        order = order[np.append(same, False) | np.concatenate([[False], same])]
        sid, n, h = sid[order], n[order], h[order]
        order = np.lexsort((sid, h))
        sid, n, h = sid[order], n[order], h[order]
        new = np.ones(len(h), bool)  # a class that several tasks sent counts once
        new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
        sid, n, h = sid[new], n[new], h[new]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.append(begin, len(h)))
        df = np.repeat(times, times)
        keep = df > 1
        rows = list(_by_share(sid[keep], n[keep], h[keep], df[keep], shares))
        return pa.table({"share": pa.array([r[0] for r in rows], pa.int64()), "packed": pa.array([r[1] for r in rows], pa.binary())}, out)

    def order_sets(key, table):
        sid, n, h, df = (np.concatenate(x) for x in zip(*[_unpack_sets(raw.as_buffer(), True) for raw in table.column("packed")]))
        order = np.lexsort((h, df, sid))
        sid, n, h = sid[order], n[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (sid[1:] != sid[:-1]) | (h[1:] != h[:-1])
        sid, n, h = sid[new], n[new], h[new]
        cols = [[] for _ in range(6)]
        for s, a, b in _cut(sid):
            size, repeated = int(n[a]), b - a
            q = repeated + 1 - -(-size * PERCENT // 100)
            if q <= 0:
                continue
            single = size - repeated
            gid = s if single else int.from_bytes(hashlib.blake2b(h[a : a + q].tobytes() + size.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
            for c, v in zip(cols, (s, gid, size, q, single, h[a:b].tobytes())):
                c.append(v)
        return pa.table({k: pa.array(c, pa.binary() if k == "tokens" else pa.int64()) for k, c in zip(("sid", "gid", "n", "q", "single", "tokens"), cols)})

    sent = docs.select("text").mapInArrow(send, "bucket long, packed binary").groupBy("bucket").applyInArrow(leanly(meet), "share long, packed binary")
    return stored(sent.groupBy("share").applyInArrow(leanly(order_sets), "sid long, gid long, n long, q long, single long, tokens binary"), "partners")


def lists(sets: DataFrame, frequent: Frequent) -> DataFrame:
    """(list, part, sid, salt, gid, n, pos): members of each prefix shingle that has several; lists of equal members once.

    The rows of a very frequent shingle are dealt over several tasks and keep its name. ``part`` cuts a
    long list into runs of ``CELL`` rows, ``salt`` the lists of a class; joins take them as part of the key.
    """
    spark = sets.sparkSession
    total = sets.agg(F.coalesce(F.sum("q"), F.lit(0))).first()[0]
    lanes = spark.sparkContext.defaultParallelism
    buckets = int(max(1, -(-total // min(max(total // (2 * lanes), 50_000), BUCKET_SHINGLES // 2))))
    shared = spark.sparkContext.broadcast(frequent)
    names = ["list", "sid", "gid", "n", "pos", "salt", "part"]

    def rows_of(batches):
        common = shared.value
        for batch in batches:
            sid, gid, n, q, single = (batch.column(c).to_numpy() for c in ("sid", "gid", "n", "q", "single"))
            if not len(q):
                continue
            h = np.concatenate([np.frombuffer(raw.as_buffer(), np.uint64, k) for raw, k in zip(batch.column("tokens"), q.tolist())])
            own = np.repeat(np.arange(len(q)), q)
            pos = np.arange(len(own)) - np.repeat(np.cumsum(q) - q, q) + single[own]
            at, hot = common.find(h)
            parts = np.where(hot, -(-common.count[at] // LIST_ROWS) if len(common.h) else 1, 1)
            bucket = ((h >> X.U(32)) * X.U(buckets) >> X.U(32)).astype(np.int64)
            bucket = np.where(parts > 1, -1 - (X.mix(h + (sid[own] % parts).astype(X.U)) >> X.U(1)).astype(np.int64), bucket)
            order = np.argsort(bucket, kind="stable")
            salt = (X.mix(h) % (-(-q // CELL)).astype(X.U)[own]).astype(np.int64)
            deal = (sid[own] % parts) << 32  # apart for each task that a frequent shingle's rows go to
            rec = np.column_stack([h.view(np.int64), sid[own], gid[own], n[own], pos, salt, deal])[order]
            for b, x, y in _cut(bucket[order]):
                yield b, rec[x:y].tobytes()

    def send(batches):
        yield from row_batches(rows_of(batches), ["bucket", "packed"])

    def gather(key, table):
        rec = np.concatenate([np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, len(names)) for raw in table.column("packed")])
        h = rec[:, 0]
        rec = rec[np.lexsort((rec[:, 1], h))]
        keep, seen = [], {}
        split = key[0].as_py() < 0
        for _, a, b in _cut(rec[:, 0]):
            if split:
                keep.append(rec[a:b])
            elif b - a > 1:
                name = hashlib.blake2b(rec[a:b, 1].tobytes(), digest_size=8).digest()
                at = seen.setdefault(name, len(keep))
                if at == len(keep):
                    keep.append(rec[a:b])
                elif rec[a, 4] < keep[at][0, 4]:  # all members agree on which shingle comes first
                    keep[at] = rec[a:b]
        for own in keep:
            own[:, 6] += np.arange(len(own)) // CELL
        rec = np.concatenate(keep) if keep else rec[:0]
        return pa.table({c: rec[:, i] for i, c in enumerate(names)})

    sent = sets.mapInArrow(send, "bucket long, packed binary")
    return stored(sent.groupBy("bucket").applyInArrow(leanly(gather), "list long, sid long, gid long, n long, pos long, salt long, part long"), "lists")


def roomy(a: str, b: str) -> Column:
    """Whether sizes and positions of two list members leave room for the overlap."""
    na, nb, pa_, pb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    return F.least(na - pa_, nb - pb) * (100 + PERCENT) >= PERCENT * (na + nb)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold. Both sides' shingles come by joins, which AQE splits at a frequent id."""
    side = sets.select("sid", "n", "tokens")
    left = side.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = side.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def run(batches):
        for batch in batches:
            ok = []
            for na, nb, ta, tb in zip(*[batch.column(c).to_pylist() for c in ("na", "nb", "ta", "tb")]):
                both = np.sort(np.concatenate([np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)]))
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= PERCENT * (na + nb - inter))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def link_classes(sets: DataFrame, members: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, comp) of the classes that have a partner."""
    cells = members.groupBy("sid", "salt").agg(F.count(F.lit(1)).alias("k"))
    degree = cells.groupBy("sid").agg(F.sum("k").alias("degree"), F.collect_list("salt").alias("salts"))
    cells = stored(degree.select("sid", "degree", F.explode("salts").alias("salt")), "cells")
    base = stored(members.join(cells, ["sid", "salt"]), "members")
    links = tried = comp = None
    for r in range(rounds + 1):
        now = base.withColumn("comp", F.col("sid"))
        if comp is not None:
            known = cells.join(comp, F.col("sid") == F.col("id")).select("sid", "salt", F.col("comp").alias("known"))
            now = now.join(known, ["sid", "salt"], "left").withColumn("comp", F.coalesce("known", "sid")).drop("known")
        if r < rounds:
            rank = F.when(F.lit(r == 0), F.col("degree") * (1 << 32)).otherwise(F.lit(0)) + F.xxhash64("sid", F.lit(r)).bitwiseAND(F.lit((1 << 32) - 1))
            hub = F.max(F.struct(rank.alias("rank"), "sid", "comp", "n", "pos")).alias("hub")
            runs = now.groupBy("list", "part").agg(hub, F.min("comp").alias("low"), F.max("comp").alias("high"))
            open_ = runs.groupBy("list").agg(F.max("hub").alias("hub"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("part").alias("parts")).where("low <> high")
            open_ = open_.select(F.col("list").alias("l"), F.explode("parts").alias("p"), "hub.*", F.col("hub.rank").alias("r"))
            met = now.alias("m").join(open_.alias("h"), (F.col("m.list") == F.col("h.l")) & (F.col("m.part") == F.col("h.p"))).where((F.col("m.comp") != F.col("h.comp")) & roomy("m", "h"))
            best = met.groupBy(F.col("m.sid").alias("x")).agg(F.max(F.struct(F.col("h.r").alias("r"), F.col("h.sid").alias("y"))).alias("best"))
            pairs = best.select(F.least("x", "best.y").alias("a"), F.greatest("x", "best.y").alias("b")).distinct()
        else:
            runs = now.groupBy("list", "part").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
            open_ = runs.groupBy("list").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("part").alias("parts")).where("low <> high")
            open_ = open_.select(F.col("list").alias("l"), F.explode("parts").alias("p"))
            left = now.join(open_, (F.col("list") == F.col("l")) & (F.col("part") == F.col("p")))
            # a group stands in a list once, whatever number of members it has; low and high tell if they are connected already
            groups = left.groupBy("list", "gid").agg(F.first("n").alias("n"), F.first("pos").alias("pos"), F.min("comp").alias("low"), F.max("comp").alias("high"))
            groups = stored(groups, "groups")
            done = (F.col("m.low") == F.col("h.high")) & (F.col("m.high") == F.col("h.low"))
            on = (F.col("m.list") == F.col("h.list")) & (F.col("m.gid") < F.col("h.gid")) & roomy("m", "h") & ~done
            met = groups.alias("m").join(groups.alias("h"), on).select(F.col("m.gid").alias("ga"), F.col("h.gid").alias("gb"))
            met = met.union(groups.where("low <> high").select("gid", "gid")).distinct()
            member = sets.select("gid", "sid")
            if comp is not None:
                member = member.join(comp.select(F.col("id").alias("sid"), "comp"), "sid", "left")
            member = member.select("gid", "sid", F.coalesce("comp", "sid").alias("comp") if comp is not None else F.col("sid").alias("comp"))
            one, two = (member.select(F.col("gid").alias(f"g{x}"), F.col("sid").alias(f"s{x}"), F.col("comp").alias(f"c{x}")) for x in "ab")
            pairs = met.join(one, "ga").join(two, "gb").where("ca <> cb").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        found = stored(verify(pairs, sets), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if found.limit(1).count() or comp is None:
            comp = components(links)
    return comp


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every link of the join, as pairs (a, b) of linked classes, a < b, and the membership (doc_id, n, sid) of all rows.

    Rows of one class link with each other too, unless n is 0. Unlike in ``near_components`` every candidate pair of
    groups is verified, connected or not. The pairs of a cluster of different texts grow with its square, as its links do.
    """
    bounded_batches(docs.sparkSession)
    rows, frequent = describe(docs)
    shingles = rows.groupBy("sid").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sets = partners(docs, frequent, shingles)
    groups = lists(sets, frequent).groupBy("list", "gid").agg(F.first("n").alias("n"), F.first("pos").alias("pos"), F.count(F.lit(1)).alias("size"))
    groups = stored(groups, "groups")
    on = (F.col("m.list") == F.col("h.list")) & (F.col("m.gid") < F.col("h.gid")) & roomy("m", "h")
    met = groups.alias("m").join(groups.alias("h"), on).select(F.col("m.gid").alias("ga"), F.col("h.gid").alias("gb"))
    met = met.union(groups.where("size > 1").select("gid", "gid")).distinct()
    one, two = (sets.select(F.col("gid").alias(f"g{x}"), F.col("sid").alias(f"s{x}")) for x in "ab")
    pairs = met.join(one, "ga").join(two, "gb").where("sa <> sb").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct()
    return verify(stored(pairs, "pairs"), sets), rows


def count_links(rows: DataFrame, sets: DataFrame, comp: DataFrame) -> DataFrame:
    """(sid, n_links): to how many other rows the rows of a class link. Every link lies inside a component.

    Sizes fall into bands so wide that linked sets lie in one or in neighbouring bands. A band of a component is
    dealt to blocks of bounded classes and shingles, and each pair of blocks that can hold links is
    one group: its task counts them by the shingles the classes share, one class against a block at a time.
    Copies count by the size of their class.
    """
    size = rows.where("n > 0").groupBy("sid").agg(F.count(F.lit(1)).alias("size"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)) + F.lit(1e-9)).cast("int")
    held = sets.join(comp, F.col("sid") == F.col("id")).select("sid", "n", "tokens", "comp", band.alias("band"))
    held = stored(held.join(size, "sid"), "linked")
    bulk = held.groupBy("comp", "band").agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("tokens") / 8).alias("t"))
    parts = F.ceil(F.greatest(F.col("k") / BLOCK_CLASSES, F.col("t") / BLOCK_SHINGLES)).cast("int")
    bulk = stored(bulk.select("comp", "band", parts.alias("parts")), "bands")
    near = bulk.alias("x").join(bulk.alias("y"), (F.col("x.comp") == F.col("y.comp")) & (F.abs(F.col("x.band") - F.col("y.band")) <= 1))
    near = near.select(F.col("x.comp").alias("_c"), F.col("x.band").alias("_b"), F.col("x.parts").alias("own"), F.col("y.band").alias("other"), F.col("y.parts").alias("parts"))
    sent = held.join(near, (F.col("comp") == F.col("_c")) & (F.col("band") == F.col("_b")))
    h = F.pmod(F.xxhash64("sid"), F.col("own")).cast("int")
    sent = sent.select("sid", "n", "tokens", "size", "comp", "band", h.alias("h"), "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("g"))
    me, you = F.struct("band", "h"), F.struct(F.col("other").alias("band"), F.col("g").alias("h"))
    sent = sent.select("sid", "n", "tokens", "size", "comp", F.least(me, you).alias("low"), F.greatest(me, you).alias("high"), (me == F.least(me, you)).alias("first"))

    def count(key, table):
        first = table.column("first").to_numpy()
        sid, n, size = (table.column(c).to_numpy() for c in ("sid", "n", "size"))
        raw = [np.frombuffer(t.as_buffer(), np.uint64) for t in table.column("tokens")]
        kinds, code = np.unique(np.concatenate(raw), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
        alone = bool(first.all())  # a block with itself
        a, b = np.flatnonzero(first), np.flatnonzero(first if alone else ~first)
        total = np.zeros(len(sid), np.int64)
        if len(a) and len(b):
            there = np.concatenate([code[begin[j] : begin[j + 1]] for j in b])
            starts = np.concatenate([[0], np.cumsum(begin[b + 1] - begin[b])[:-1]])
            mark = np.zeros(len(kinds), np.int32)
            for i in a.tolist():
                own = code[begin[i] : begin[i + 1]]
                mark[own] = 1
                inter = np.add.reduceat(mark[there], starts)
                mark[own] = 0
                fine = (100 * inter >= PERCENT * (n[i] + n[b] - inter)) & (sid[b] != sid[i])
                total[i] += size[b[fine]].sum()
                if not alone:
                    total[b[fine]] += size[i]
        return pa.table({"sid": sid, "k": total})

    other = sent.groupBy("comp", "low", "high").applyInArrow(leanly(count), "sid long, k long").groupBy("sid").agg(F.sum("k").alias("k"))
    return size.join(other.select(F.col("sid").alias("_s"), "k"), F.col("sid") == F.col("_s"), "left").select("sid", (F.col("size") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"))


def near_components(docs: DataFrame, links: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: documents link where 100 |A and B| >= 75 |A or B|.

    component_id is the smallest doc_id that links reach. Texts without words have an empty set and
    are alone, also with their equals. A null doc_id is no candidate for the smallest, and a component of
    nothing else has null. Rows that repeat link with each other and are all returned. With ``links`` there is
    ``n_links`` as well, the number of other rows that a row links with. A text is read whole, whatever its
    length; one of many megabytes is a batch of its own, and takes some 30 bytes of memory for each byte.
    """
    bounded_batches(docs.sparkSession)
    rows, frequent = describe(docs)
    shingles = rows.groupBy("sid").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sets = partners(docs, frequent, shingles)
    comp = link_classes(sets, lists(sets, frequent))
    classes = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low"))
    joined = classes.join(comp, F.col("sid") == F.col("id"), "left").select("sid", "low", F.coalesce("comp", "sid").alias("comp"))
    lowest = joined.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = joined.join(lowest, "comp").select(F.col("sid").alias("_sid"), "component_id")
    if links:
        named = named.join(count_links(rows, sets, comp), F.col("_sid") == F.col("sid")).drop("sid")
    out = rows.join(named, (F.col("sid") == F.col("_sid")) & (F.col("n") > 0), "left")
    more = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest doc_id.

    Only the others' ids are joined: a bitmap of them, of bounded size, lets most rows pass unshuffled.
    Rows without a doc_id stay; rows that repeat a doc_id that stays, all stay.
    """
    spark = docs.sparkSession
    near = near_components(docs).where("component_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").cast("bigint").alias("_gone")).distinct()
    near = stored(near, "gone")
    bitmap = key_filter(near, "_gone")
    shared = spark.sparkContext.broadcast(bitmap)  # 16 MB at most
    bit = docs.withColumn("_bit", F.coalesce(filter_bit(64 * len(bitmap), "doc_id"), F.lit(-1)))

    def side(hit: bool):
        def run(batches):
            for batch in batches:
                bits = batch.column("_bit").to_numpy()
                maybe = has_bit(shared.value, np.maximum(bits, 0)) & (bits >= 0)
                yield batch.drop_columns(["_bit"]).filter(pa.array(maybe == hit))

        return bit.mapInArrow(run, docs.schema)

    apart = side(True).join(near, F.col("doc_id") == F.col("_gone"), "left_anti")
    return side(False).unionByName(apart)


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_components(load(spark, sf_dir, "documents"), links=True)


def sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pair AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        deg AS (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a)
        SELECT a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(b) AS component_id, coalesce(max(n_links), 0) AS n_links FROM reach LEFT JOIN n ON n.doc_id = a LEFT JOIN deg ON deg.doc_id = a GROUP BY a"""
