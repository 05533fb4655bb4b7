"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

1. A bounded sample of rows is drawn by the smallest hashes of doc_id: labelled ones (``MOST_TOXIC`` and
   ``MOST_CLEAN``) and ones without a label (``MOST_UNLABELLED``).
2. Words and their beginnings that go with the label in the labelled sample make the lexicons. Each lexicon
   is a voter; patterns (shouting, repeated marks, address in the second person, density and
   absence of lexicon words) are further ones, and so is the given label, which abstains where there is none.
3. The label model holds, for each voter, the probabilities of its votes (for, against, abstain)
   given the hidden class, found by expectation maximisation over all rows of the sample. No voter's error rates are
   fixed or held within bounds, so accurate voters overrule wrong labels. The correlations of the voters'
   residuals given the class are estimated as well; a voter counts the less, the more others repeat it.
4. A logistic classifier over the lexicon features is trained on the posterior labels, and scores every text.
   A text is read whole, whatever its length.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textnum as X
from larkspur.llm.common import bounded_batches, load, packed, stored, text_pieces, unpacked

#: Bounds of the sample from which all is fitted: rows with each label, and rows of which those without a label are taken.
MOST_TOXIC, MOST_CLEAN, MOST_UNLABELLED = 3000, 6000, 3000
#: Features of the classifier, lexicon voters, and documents in which a feature must occur.
FEATURES, LEXICONS, LEAST_DOCS = 2048, 40, 3
LEAST_VOTING = 64
#: A feature's share among toxic documents must lie so many standard errors and times above that among the others.
LEAST_Z, LEAST_RATIO = 4.0, 10.0
PREFIXES = (4, 5, 6)
SHARDS = 16
#: A fixed value: words of address, part of a pattern voter.
ADDRESS = re.compile(r"\b(you|your|du|dich|ihr|tu|toi|vous|te|usted)\b", re.I)
SHOUT = re.compile(r"[!?]{2,}")


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and of its first 4, 5 and 6 bytes; A-Z are lower-cased."""
    buf = X.LOWER[buf]
    w = X.find_words(buf, off, X.WORDLIKE)
    if not len(w.start):
        return w.doc, np.zeros(0, X.U)
    docs, hashes = [w.doc], [X.hash_words(buf, w)]
    for k in PREFIXES:
        long, h = X.hash_beginnings(buf, w, k)
        docs.append(w.doc[long])
        hashes.append(h)
    return np.concatenate(docs), np.concatenate(hashes)


class Lexicon(NamedTuple):
    """Selected features, sorted by hash, with a bitmap in front."""

    hashes: np.ndarray
    bitmap: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray) -> Lexicon:
        bitmap = np.zeros(1 << 20, bool)
        bitmap[(hashes & X.U((1 << 20) - 1)).astype(np.int64)] = True
        return Lexicon(np.sort(hashes), bitmap)

    def present(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature number) of the features in each text, once each."""
        d, h = features(buf, off)
        if not len(self.hashes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = self.bitmap[(h & X.U((1 << 20) - 1)).astype(np.int64)]
        d, h = d[maybe], h[maybe]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        fine = self.hashes[at] == h
        code = np.unique(d[fine].astype(np.int64) * len(self.hashes) + at[fine])
        return code // len(self.hashes), code % len(self.hashes)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def draw(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, text, toxic) of the sample, toxic null where no label is given, and the share of toxic among all
    labels that may be used. Held-out rows take no part, with or without a label."""
    may = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    may = may.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = {r["toxic"]: r["count"] for r in may.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = may.where("toxic = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(may.where("toxic = 0").orderBy(*order).limit(MOST_CLEAN))
    some = some.select(F.col("doc_id").alias("_id"), "toxic")
    drawn = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).select("doc_id").orderBy(*order).limit(MOST_UNLABELLED).select(F.col("doc_id").alias("_id")).distinct()
    given = labels.where("toxic IS NOT NULL").select(F.col("doc_id").alias("_k")).join(F.broadcast(drawn), F.col("_k") == F.col("_id")).select("_k").distinct()
    free = drawn.join(F.broadcast(given), F.col("_id") == F.col("_k"), "left_anti")  # both of MOST_UNLABELLED ids at most
    some = some.unionByName(free.select("_id", F.lit(None).cast("int").alias("toxic")))
    joined = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))  # 12000 rows of two numbers at most
    sample = joined.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    return sample, (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)


def associate(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features that go with the label most surely, most sure first, and which of them are sure enough to
    vote: the best eighth (``LEAST_VOTING`` at least), and of all features tested less than one is expected to go so far by chance. Every row of ``sample`` has a label.

    Tasks count documents per feature and class; the counts are summed per shard of hashes.
    """

    def count(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for a, _, buf, off in text_pieces(batch):
                d, h = features(buf, off)
                order = np.lexsort((d, h))
                d, h = d[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                d, h = d[new], h[new]
                begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                if not len(begin):
                    continue
                pos = np.add.reduceat(toxic[a + d].astype(np.uint32), begin)
                both = np.diff(np.append(begin, len(h))).astype(np.uint32)
                h = h[begin]
                shard = (h >> X.U(60)).astype(np.int64)
                cut = np.searchsorted(shard, np.arange(SHARDS + 1))
                packed = [h[x:y].tobytes() + pos[x:y].astype(np.uint32).tobytes() + both[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int64()), pa.array(packed, pa.binary())], ["shard", "packed"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    def choose(key, table):
        parts = []
        for raw_ in table.column("packed"):
            b = np.frombuffer(raw_.as_buffer(), np.uint8)
            n = len(b) // 16
            parts.append((b[: 8 * n].copy().view(np.uint64), b[8 * n : 12 * n].copy().view(np.uint32), b[12 * n :].copy().view(np.uint32)))
        h, pos, both = (np.concatenate(x) for x in zip(*parts))
        u, at = np.unique(h, return_inverse=True)
        pos, both = np.bincount(at, pos, len(u)), np.bincount(at, both, len(u))
        z = z_score(pos, both, n1, n0)
        ratio = (pos + 0.1) / (n1 + 1) / ((both - pos + 0.1) / (n0 + 1))
        best = np.flatnonzero((both >= LEAST_DOCS) & (z > LEAST_Z) & (ratio > LEAST_RATIO))
        best = best[np.argsort(-z[best], kind="stable")][:FEATURES]
        sure = chance(pos[best], both[best], n1, n0) + np.log((both >= LEAST_DOCS).sum() * SHARDS + 1.0) < 0
        return pa.table({"h": pa.array(u[best].view(np.int64)), "z": pa.array(z[best]), "sure": pa.array(sure)})

    got = sample.mapInArrow(count, "shard long, packed binary").groupBy("shard").applyInArrow(choose, "h long, z double, sure boolean").toArrow()
    h, z, sure = got.column("h").to_numpy().view(np.uint64), got.column("z").to_numpy(), got.column("sure").to_numpy(zero_copy_only=False).astype(bool)
    best = np.lexsort((h, -z))[:FEATURES]
    return h[best], sure[best] & (np.arange(len(best)) < max(LEAST_VOTING, len(best) // 8))


def chance(pos: np.ndarray, both: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log of Chernoff's bound on the chance that ``pos`` of ``both`` documents are toxic, if the feature told nothing."""
    q = np.clip(n1 / max(n1 + n0, 1), 1e-9, 1 - 1e-9)
    p = pos / np.maximum(both, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(p > 0, p * np.log(p / q), 0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - q)), 0)
    return np.where(p > q, -both * far, 0.0)


def z_score(pos, both, n1: int, n0: int):
    """How far the share of toxic documents with a feature lies above the share of the others."""
    p1, p0 = (pos + 0.1) / (n1 + 1), (both - pos + 0.1) / (n0 + 1)
    p = (both + 0.2) / (n1 + n0 + 2)
    return (p1 - p0) / np.sqrt(p * (1 - p) * (1 / max(n1, 1) + 1 / max(n0, 1)) + 1e-12)


class Votes(NamedTuple):
    votes: np.ndarray  #: documents x voters, of -1, 0, 1
    toxic: np.ndarray  #: the given label, or -1
    doc: np.ndarray  #: with ``feature``: what is present where
    feature: np.ndarray


def vote(sample: DataFrame, ranked: np.ndarray, sure: np.ndarray) -> Votes:
    """The voters' say on each document of the sample, and its features. Only sure features vote."""
    lex = Lexicon.of(ranked)
    rank = np.empty(len(ranked), np.int64)
    rank[np.searchsorted(lex.hashes, ranked)] = np.arange(len(ranked))
    shared = sample.sparkSession.sparkContext.broadcast((lex, rank % LEXICONS, sure[rank]))

    def run(batches):
        lex, voter, sure = shared.value
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").cast(pa.int64())
            for lo, hi, buf, off in text_pieces(batch):
                d, f = lex.present(buf, off)
                n = hi - lo
                votes = np.zeros((n, LEXICONS + 5), np.int8)
                hits = np.bincount(d, minlength=n)
                strong = np.bincount(d[sure[f]], minlength=n)
                if len(f):
                    votes[d[sure[f]], voter[f[sure[f]]]] = 1
                size = np.maximum(np.diff(off), 1)
                capitals = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
                votes[:, LEXICONS] = capitals[off[1:]] - capitals[off[:-1]] > 0.3 * size
                for i in range(n):
                    t = texts[lo + i].as_py()
                    votes[i, LEXICONS + 1] = bool(SHOUT.search(t))
                    votes[i, LEXICONS + 2] = bool(ADDRESS.search(t))
                votes[:, LEXICONS + 3] = np.where(strong == 0, -1, 0)
                votes[:, LEXICONS + 4] = np.where(strong * 2000 >= size, 1, np.where(hits * 4000 < size, -1, 0))
                cut = np.searchsorted(d, np.arange(n + 1))
                present = [f[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array([v.tobytes() for v in votes], pa.binary()), batch.column("toxic").fill_null(-1).cast(pa.int32())[lo:hi], pa.array(present, pa.binary())], ["doc_id", "votes", "toxic", "present"])

    got = sample.mapInArrow(run, "doc_id long, votes binary, toxic int, present binary").toArrow().sort_by("doc_id")
    votes = np.frombuffer(b"".join(got.column("votes").to_pylist()), np.int8).reshape(got.num_rows, -1)
    present = [np.frombuffer(b, np.int32) for b in got.column("present").to_pylist()]
    doc = np.repeat(np.arange(got.num_rows), [len(p) for p in present])
    return Votes(votes, got.column("toxic").to_numpy(), doc, np.concatenate(present) if present else np.zeros(0, np.int32))


def label_model(votes: np.ndarray, prior: float | np.ndarray, gold: np.ndarray | None = None, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, the accuracies of the voters, and their residual correlations.

    ``prior`` is the share of class 1, for all rows or for each. ``gold`` are given labels (1, 0, or -1 for none): the last
    voter, whose error rates are estimated as everyone's are. Votes are independent given the class but for the
    correlations of what the class leaves unexplained; a voter's log-odds are divided by the number of voters that it
    stands for, itself and each other one by its correlation. Before the first estimate only voters that all but repeat
    each other count as one.
    """
    if gold is not None:
        votes = np.column_stack([votes, np.where(gold < 0, 0, np.where(gold > 0, 1, -1))]).astype(np.int8)
    n, m = votes.shape
    hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)  # n x m x 3
    value = np.array([-1.0, 0.0, 1.0])

    raw = votes.var(0)

    def correlation(residual: np.ndarray, explained: float = 0.05) -> np.ndarray:
        """Of residuals; what is left of a voter that the class explains all but ``explained`` of doesn't count."""
        residual = (residual - residual.mean(0)) / np.sqrt(residual.var(0) + explained * raw + 1e-9)
        out = residual.T @ residual / n
        np.fill_diagonal(out, 1)
        return out

    corr = correlation(votes.astype(float), 0.0)
    weight = 1 / (corr > 0.95).sum(1)
    balance = votes @ weight
    y = np.where(balance > 0, 0.9, 0.1)
    odds = np.log(np.asarray(prior, float) / (1 - np.asarray(prior, float)))
    for step in range(steps):
        t1 = np.einsum("n,nmv->mv", y, hot) + [0.5, 1, 1.0]
        t0 = np.einsum("n,nmv->mv", 1 - y, hot) + [1.0, 1, 0.5]
        p1, p0 = t1 / t1.sum(1, keepdims=True), t0 / t0.sum(1, keepdims=True)
        if step % 5 == 4:
            corr = correlation(votes - (y[:, None] * (p1 @ value) + (1 - y)[:, None] * (p0 @ value)))
            weight = 1 / np.where(corr > 0.1, corr, 0).sum(1)
        logit = np.einsum("nmv,mv,m->n", hot, np.log(p1) - np.log(p0), weight) + odds
        y = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    accuracy = (p1[:, 2] * y.mean() + p0[:, 0] * (1 - y.mean())) / (1 - (hot[:, :, 1].mean(0)) + 1e-9)
    return y, np.clip(accuracy, 0, 1), corr


def fit_linear(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, weight: np.ndarray, n_features: int, steps: int = 800) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: Adam on the whole sample, small L2."""
    w, b = np.zeros(n_features + 1), None
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = weight.sum()
    for t in range(1, steps + 1):
        score = np.bincount(doc, w[feature], len(y)) + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(score, -50, 50))) - y) / total
        grad = np.append(np.bincount(feature, g[doc], n_features) + 1e-6 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    b = float(w[-1])
    return w[:-1], b


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit all of it. Without toxic labels, every text gets the prior."""
    bounded_batches(docs.sparkSession)
    sample, prior = draw(docs, labels)
    bias = float(np.log(prior / (1 - prior)))
    nothing = Model(Lexicon.of(np.zeros(0, np.uint64)), np.zeros(0), bias)
    sample = stored(sample, "sample")  # bounded rows, read three times
    ranked, sure = associate(sample.where("toxic IS NOT NULL"))
    if not len(ranked):
        return nothing
    v = vote(sample, ranked, sure)
    share = float(np.clip((v.toxic == 1).sum() / max((v.toxic >= 0).sum(), 1), 0.01, 0.99))
    y, _, _ = label_model(v.votes, np.where(v.toxic >= 0, share, prior), v.toxic)
    weight = np.where(v.toxic == 1, prior / share, np.where(v.toxic == 0, (1 - prior) / (1 - share), 1.0))  # as many as in the corpus
    w, b = fit_linear(v.doc, v.feature, y, weight, len(ranked))
    return Model(Lexicon.of(ranked), w, b)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and a score from 0 to 1 for every row; a null text is empty."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches):
        m = shared.value
        for batch in batches:
            out = []
            for a, b, buf, off in text_pieces(batch):
                d, f = m.lexicon.present(buf, off)
                z = np.bincount(d, m.weights[f] if len(f) else None, b - a) + m.bias
                out.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(out) if out else np.zeros(0))], [*keep, "_score"])

    return docs.select(*columns).mapInArrow(run, f"{schema}, _score double").withColumnRenamed("_score", "score")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents whose score is 0.5 or more."""
    return unpacked(score(packed(docs), train(docs, labels), ("text", "_row")).where("score < 0.5"), docs.columns)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = score(docs, train(docs, load(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
