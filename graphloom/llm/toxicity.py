"""Toxicity: a classifier over words and their stems, whose score must not hang on which group a text mentions."""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality

#: Groups of identity terms that can stand for each other; a parameter.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino"), ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("muslims", "christians", "jews", "hindus", "buddhists"), ("immigrants", "refugees", "foreigners", "locals"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
)
STEMS = (4, 5)
BINS = 2**18


def swapper(identities=IDENTITIES):
    """A function that replaces each identity term by the next one of its group; None if a text has none."""
    turn = {t: g[(k + 1) % len(g)] for g in identities for k, t in enumerate(g)}
    terms = re.compile(r"\b(" + "|".join(sorted(map(re.escape, turn), key=len, reverse=True)) + r")\b", re.I)

    def swap(text: str) -> str | None:
        out, n = terms.subn(lambda m: turn[m[0].lower()], text)
        return out if n else None

    return swap


def features(owners: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, feature)`` with repeats: 64-bit hashes of words and of the first 4 and 5 bytes of longer words."""
    t = common.Tokens(pieces)
    word = t.kind == 1
    docs, found = [t.doc[word]], [t.hash[word]]
    for k in STEMS:
        p = t.prefix(k)
        docs.append(t.doc[p != 0])
        found.append(p[p != 0])
    return owners[np.concatenate(docs)], np.concatenate(found)


def chosen_features(texts: list[bytes], keep) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` of whole texts, each once, of the features for which ``keep`` is true."""
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for owners, pieces in common.blocks(texts):
        doc, f = features(owners, pieces)
        own = keep(f)
        docs.append(doc[own])
        found.append(f[own])
    doc, f = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((f, doc))
    doc, f = doc[order], f[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], f[new]


def evidence(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """G-squared of presence against the label."""

    def term(a, row, column):
        return np.where(a > 0, a * np.log(np.maximum(a, 1e-9) * (n_pos + n_neg) / np.maximum(row * column, 1e-9)), 0)

    with_f, without = pos + neg, n_pos + n_neg - pos - neg
    return 2 * (term(pos, with_f, n_pos) + term(neg, with_f, n_neg) + term(n_pos - pos, without, n_pos) + term(n_neg - neg, without, n_neg))


@dataclasses.dataclass
class Model:
    """Weights of sorted 64-bit features that a text has or hasn't, and a bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.filter = np.zeros(2**22, bool)
        self.filter[(self.features & np.uint64(2**22 - 1)).astype(np.int64)] = True

    def known(self, f: np.ndarray) -> np.ndarray:
        hit = self.filter[(f & np.uint64(2**22 - 1)).astype(np.int64)]
        at = np.minimum(np.searchsorted(self.features, f[hit]), max(0, len(self.features) - 1))
        hit[hit] = self.features[at] == f[hit] if len(self.features) else False
        return hit

    def logits(self, texts: list[bytes]) -> np.ndarray:
        doc, f = chosen_features(texts, self.known)
        return self.bias + np.bincount(doc, self.weights[np.searchsorted(self.features, f)], len(texts))


def train(rows: list[tuple], y: np.ndarray, swapped: list[tuple], most: int = 2048, penalty: float = 1.0, l2: float = 1e-5, steps: int = 400) -> Model:
    """Logistic regression over the ``most`` features of strongest evidence that three rows or more have.

    rows: features of each row (sorted arrays).  swapped: ``(row, features)`` of rows with their identity terms
    swapped; the squared change of their logit is added to the loss with weight ``penalty``.
    """
    n_pos, n_neg = float(y.sum()), float(len(y) - y.sum())
    bias = float(np.log((n_pos + 0.5) / (n_neg + 0.5)))
    if not n_pos or not n_neg:
        return Model(np.zeros(0, np.uint64), np.zeros(0), bias)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names, column = np.unique(flat, return_inverse=True)
    pos = np.bincount(column, y[owner], len(names))
    neg = np.bincount(column, 1 - y[owner], len(names))
    worth = np.where(pos + neg >= 3, evidence(pos, neg, n_pos, n_neg), 0)
    chosen = np.sort(np.argsort(-worth, kind="stable")[:most])
    chosen = chosen[worth[chosen] > 6.63]  # one in a hundred by chance
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[column] >= 0
    r, c = owner[keep], place[column[keep]]
    chosen = names[chosen]
    pairs_r, pairs_c, pairs_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for k, (row, other) in enumerate(swapped):
        for s, f in ((1.0, rows[row]), (-1.0, other)):
            at = np.minimum(np.searchsorted(chosen, f), max(0, len(chosen) - 1)) if len(chosen) else np.zeros(0, np.int64)
            at = at[chosen[at] == f] if len(chosen) else at
            pairs_r.append(np.full(len(at), k))
            pairs_c.append(at)
            pairs_s.append(np.full(len(at), s))
    pr, pc, ps = map(np.concatenate, (pairs_r, pairs_c, pairs_s))
    w, b = np.zeros(len(chosen)), bias
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(r, w[c], len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.bincount(c, g[r], len(w)) + l2 * w
        if len(swapped):
            change = np.bincount(pr, ps * w[pc], len(swapped))
            grad = grad + 2 * penalty / len(swapped) * np.bincount(pc, ps * change[pr], len(w))
        grad = np.append(grad, g.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(chosen, w, float(b))


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, folds: int = 5, held_out: int = 0, identities=IDENTITIES) -> Model:
    """A model from at most ``most`` labelled documents outside the held-out fold; their whole texts count.

    Presence by class is first counted in hashed bins, whose number is fixed; then the features of the 2,048 bins of
    strongest evidence come to the driver, per sampled document.  Null texts are empty; rows of a repeated doc_id
    all enter with its label, rows without an id don't.  Without labels, or labels of one kind, the model is a bias.
    """
    sample = quality.collected(docs, quality.labelled_sample(labels, "toxic", folds, held_out, most))
    half = BINS // quality.BLOCKS

    def add(pairs, y, total):
        own, at = y[pairs // BINS], pairs % BINS
        np.add.at(total, (at // half, own, at % half), 1)

    def bins(batches):
        total = np.zeros((quality.BLOCKS, 2, half), np.float32)
        n = np.zeros(2)
        for b in batches:
            texts, y = [(t or "").encode() for t in b.column(1).to_pylist()], np.asarray(b.column(2))
            n += np.bincount(y, minlength=2)[:2]
            rest = []
            for owners, pieces in common.blocks(texts):
                doc, f = features(owners, pieces)
                pairs = np.unique(doc * BINS + (f & np.uint64(BINS - 1)).astype(np.int64))
                cut = np.isin(pairs // BINS, owners[[0, -1]])  # their texts may have more pieces in other blocks
                rest.append(pairs[cut])
                add(pairs[~cut], y, total)
            add(np.unique(np.concatenate(rest)) if rest else np.zeros(0, np.int64), y, total)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array([*range(quality.BLOCKS), -1], pa.int32()), pa.array([*(t.tobytes() for t in total), n.astype(np.float32).tobytes()], pa.binary())], names=["block", "value"])

    counted = {r["block"]: np.frombuffer(r["value"], np.float32) for r in common.summed(sample, bins).collect()}
    n_neg, n_pos = map(float, counted.pop(-1, np.zeros(2)))
    counts = np.zeros((quality.BLOCKS, 2, half))
    for k, value in counted.items():
        counts[k] = value.reshape(2, half)
    neg, pos = counts[:, 0].ravel(), counts[:, 1].ravel()
    worth = evidence(pos, neg, n_pos, n_neg) if n_pos and n_neg else np.zeros(BINS)
    strong = np.zeros(BINS, bool)
    strong[np.argsort(-worth, kind="stable")[:2048]] = True

    def chosen(batches):
        swap = swapper(identities)

        def own(texts):
            doc, f = chosen_features(texts, lambda f: strong[(f & np.uint64(BINS - 1)).astype(np.int64)])
            return [x.tobytes() for x in np.split(f, np.searchsorted(doc, np.arange(1, len(texts))))] if texts else []

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            other = [swap(t) for t in texts]
            at = [k for k, t in enumerate(other) if t is not None]
            swapped = [None] * len(texts)
            for k, f in zip(at, own([other[k].encode() for k in at])):
                swapped[k] = f
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(own([t.encode() for t in texts]), pa.binary()), pa.array(swapped, pa.binary())], names=["id", "y", "f", "s"])

    rows = sorted(common.mapped(sample, chosen, "id long, y int, f binary, s binary").collect(), key=lambda r: (r["id"], r["y"]))
    read = lambda x: np.frombuffer(x, np.uint64)
    return train([read(r["f"]) for r in rows], np.array([r["y"] for r in rows], float), [(k, read(r["s"])) for k, r in enumerate(rows) if r["s"] is not None])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row's whole text, in blocks of bytes where it is long.

    Null and empty texts get the bias alone.  Repeated rows are scored each, alike; null ids stay; other columns are not
    read; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            z = held.value.logits([(t or "").encode() for t in b.column(1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return common.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, scored as ``score`` says by what ``fit`` learns; held_out is false where doc_id is null."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr(f"coalesce({quality.fold('doc_id', 5)} = 0, false)").alias("held_out"), "score", "predicted")
