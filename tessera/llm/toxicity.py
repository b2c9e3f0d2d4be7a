"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is the embedding of its hash beside two mean embeddings of characters: of its 3- and 4-grams (word ends
marked), and of its beginnings of 5 to 9 bytes. Windows of WINDOW words, STRIDE apart so that they overlap, cover every text from the first word to the last; each goes
through a forward and a backward recurrence, an attention pools the states, and a logistic unit gives the window's
probability. A text's score is that of its most toxic window.

Training (on the driver, a fixed number of steps) sees the labels of whole texts only: in every round the network picks
the likeliest window of each text and learns from those. It takes a bounded sample: at most TRAIN_EACH labelled
texts of each class, chosen by a seeded hash, none longer than TRAIN_BYTES. Embeddings begin with the log odds of their
bucket in the sample as first coordinate. Scoring covers every row and whole texts; a word's inputs are computed once for
each distinct word of a slice.

Nulls and empty texts: one window without words, scored by the bias alone. Labels that are null are not learned from; if
a document has several labels the largest counts. Without labels of both classes every score is the share of label 1
seen (0 without any). Repeated rows get equal scores. Empty tables give no rows. Columns named held_out, score or
predicted in the input are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, blocks, bounded_sample, bucket_of, framed, mix64, row_slices, span_hashes, table, text_bytes, word_spans

BUCKETS = 16
EMBED = 6
HIDDEN = 6
WINDOW = 48
STRIDE = 36
BEGINNINGS = range(5, 10)
TRAIN_EACH = 700
TRAIN_BYTES = 1 << 15
#: Passes over the sample: so many, or more until there were STEPS steps.
ROUNDS = 14
STEPS = 160
BATCH = 128
SLICE = 1 << 19
F4 = np.float32


def grams(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character 3- and 4-grams of words (bytes end to end, offsets at), ends marked; and their word's index."""
    b, off = framed(words, at, 1, 1, 0)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    key = b.astype(np.uint64)
    out, own = [], []
    for size in (2, 3):
        key = (key[: len(b) - size + 1] << np.uint64(8)) | b[size - 1 :] if size == 2 else key
        g = (key[: len(b) - size] << np.uint64(8)) | b[size:]
        inside = owner[: len(b) - size] == owner[size:]
        out.append((mix64(g + np.uint64(size << 40))[inside] >> np.uint64(64 - BUCKETS)).astype(np.int32))
        own.append(owner[: len(b) - size][inside])
        key = g
    return np.concatenate(out), np.concatenate(own)


def beginnings(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' first BEGINNINGS bytes, as far as they go; and their word's index."""
    out, own = [], []
    for size in BEGINNINGS:
        long = np.flatnonzero(np.diff(at) >= size)
        out.append((span_hashes(words, at[long], at[long] + size) >> np.uint64(64 - BUCKETS)).astype(np.int32))
        own.append(long)
    return np.concatenate(out), np.concatenate(own)


class Parts(NamedTuple):
    """Parts of the distinct words: buckets, the word of each, both in order of words; parts of every word, one at least."""

    bucket: np.ndarray
    owner: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, bucket: np.ndarray, owner: np.ndarray, n: int) -> Parts:
        order = np.argsort(owner, kind="stable")
        return cls(bucket[order], owner[order], np.maximum(1, np.bincount(owner, minlength=n)))

    def mean(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.size), EMBED), F4)
        if len(self.bucket):
            first = np.flatnonzero(np.r_[True, self.owner[1:] != self.owner[:-1]])
            out[self.owner[first]] = np.add.reduceat(table[self.bucket], first, axis=0)
        return out / self.size[:, None].astype(F4)


class Words:
    """The distinct words of some texts: embedding buckets, their parts, and every text as indexes of words."""

    def __init__(self, raw: np.ndarray, off: np.ndarray) -> None:
        hashes, spans, starts = [], [], []
        low = LOWER[raw]
        for lo, hi, breaks in blocks(raw, off, SLICE):
            s, e = word_spans(low[lo:hi], breaks)
            hashes.append(span_hashes(low[lo:hi], s, e))
            spans.append(np.stack([s + lo, e + lo], axis=1))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        span = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
        self.at = np.searchsorted(span[:, 0], off)
        unique, first, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.bucket = (unique >> np.uint64(64 - BUCKETS)).astype(np.int32)
        s, e = span[first, 0], span[first, 1]
        size = e - s
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(ends[-1]) - np.repeat(ends[:-1] - s, size)
        self.parts = {"Ec": Parts.of(*grams(low[take], ends), len(unique)), "Ep": Parts.of(*beginnings(low[take], ends), len(unique))}

    def inputs(self, p: dict) -> np.ndarray:
        return np.concatenate([p["Ew"][self.bucket], *[part.mean(p[k]) for k, part in self.parts.items()]], axis=1)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """[windows, WINDOW] indexes of words, -1 beyond the text; and every window's text."""
        n = np.diff(self.at)
        count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
        doc = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = self.at[:-1][doc] + np.minimum(k * STRIDE, np.maximum(0, n[doc] - WINDOW))
        place = start[:, None] + np.arange(WINDOW)
        inside = place < self.at[1:][doc][:, None]
        ids = self.ids if len(self.ids) else np.zeros(1, np.int64)
        return np.where(inside, ids[np.minimum(place, len(ids) - 1)], -1), doc


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start(seed: int) -> dict:
    r = np.random.default_rng(seed)
    draw = lambda *s: (r.standard_normal(s) * 0.3).astype(F4)
    p = {k: draw(1 << BUCKETS, EMBED) * F4(0.2) for k in ("Ew", "Ec", "Ep")}
    p |= {"Wa": draw(2 * HIDDEN, HIDDEN), "ba": np.zeros(HIDDEN, F4), "v": draw(HIDDEN), "w": draw(2 * HIDDEN), "b": np.full(1, -1, F4)}
    for d in "fb":
        p |= {f"W{d}": draw(3 * EMBED, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, F4)}
    return p


def recur(x: np.ndarray, real: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
    """States [T, B, H] of one direction; x [T, B, 3H] has the inputs' share of the gates (update, reset, candidate)."""
    h = np.zeros((x.shape[1], HIDDEN), F4)
    out = np.empty((len(x), x.shape[1], HIDDEN), F4)
    for t in range(len(x)):
        g = h @ u
        zr = sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, z, r, n, g[:, 2 * HIDDEN :]))
        h = np.where(real[t][:, None], n + z * (h - n), h)
        out[t] = h
    return out


def forward(p: dict, x: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of every window; x: inputs of the distinct words."""
    ids = ids.T
    real = ids >= 0
    used = np.flatnonzero(real.any(axis=1))
    ids, real = ids[: used[-1] + 1 if len(used) else 1], real[: used[-1] + 1 if len(used) else 1]
    pad = np.zeros((1, 3 * HIDDEN), F4)
    f = np.concatenate([x @ p["Wf"] + p["cf"], pad])
    b = np.concatenate([x @ p["Wb"] + p["cb"], pad])
    kf, kb = ([], []) if keep is not None else (None, None)
    hf = recur(f[ids], real, p["Uf"], kf)
    hb = recur(b[ids[::-1]], real[::-1], p["Ub"], kb)[::-1]
    h = np.concatenate([hf, hb], axis=2)
    a = np.tanh(h @ p["Wa"] + p["ba"])
    s = np.where(real, a @ p["v"], -30)
    e = np.exp(s - s.max(axis=0)) * real
    alpha = e / np.maximum(e.sum(axis=0), 1e-9)
    c = np.einsum("tb,tbh->bh", alpha, h)
    if keep is not None:
        keep |= {"ids": ids, "real": real, "kf": kf, "kb": kb, "h": h, "a": a, "alpha": alpha, "c": c}
    return c @ p["w"] + p["b"][0]


def back_recur(dh_all: np.ndarray, real: np.ndarray, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs' share of the gates [T, B, 3H] and of u."""
    dx = np.zeros((*dh_all.shape[:2], 3 * HIDDEN), F4)
    du, dh = np.zeros_like(u), np.zeros(dh_all.shape[1:], F4)
    for t in range(len(dh_all) - 1, -1, -1):
        h, z, r, n, g = keep[t]
        dh = dh + dh_all[t]
        m = real[t][:, None]
        d = dh * m
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * g * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        dg = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ dg
        dh = np.where(m, d * z + dg @ u.T, dh)
    return dx, du


def gradients(p: dict, words: Words, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    x, k = words.inputs(p), {}
    logit = forward(p, x, ids, k)
    d = ((sigmoid(logit) - y) * weight).astype(F4)
    g = {"w": k["c"].T @ d, "b": d.sum(keepdims=True)}
    dc = d[:, None] * p["w"]
    da = np.einsum("bh,tbh->tb", dc, k["h"])
    ds = k["alpha"] * (da - (k["alpha"] * da).sum(axis=0))
    pre = ds[:, :, None] * p["v"] * (1 - k["a"] ** 2)
    g["v"] = np.einsum("tb,tbh->h", ds, k["a"])
    g["Wa"] = np.einsum("tbh,tbk->hk", k["h"], pre)
    g["ba"] = pre.sum(axis=(0, 1))
    dh = k["alpha"][:, :, None] * dc + pre @ p["Wa"].T
    df, g["Uf"] = back_recur(dh[:, :, :HIDDEN], k["real"], p["Uf"], k["kf"])
    db, g["Ub"] = back_recur(dh[::-1, :, HIDDEN:], k["real"][::-1], p["Ub"], k["kb"])
    real, ids = k["real"], k["ids"]
    at = ids[real]
    used, slot = np.unique(at, return_inverse=True)
    dx = np.zeros((len(used), 3 * EMBED), F4)
    for way, grad in (("f", df[real]), ("b", db[::-1][real])):
        per = np.zeros((len(used), 3 * HIDDEN), F4)
        np.add.at(per, slot, grad)
        g[f"W{way}"], g[f"c{way}"] = x[used].T @ per, per.sum(axis=0)
        dx += per @ p[f"W{way}"].T
    g["Ew"] = np.zeros_like(p["Ew"])
    np.add.at(g["Ew"], words.bucket[used], dx[:, :EMBED])
    back = np.full(len(words.bucket), -1)
    back[used] = np.arange(len(used))
    for i, (k, part) in enumerate(words.parts.items(), 1):
        own = back[part.owner]
        hit = own >= 0
        g[k] = np.zeros_like(p[k])
        np.add.at(g[k], part.bucket[hit], dx[own[hit], i * EMBED : (i + 1) * EMBED] / part.size[used][own[hit], None].astype(F4))
    return g


def log_odds(bucket: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of every bucket, from the shares of texts of each class that have it, drawn to 0 by 1.64 standard errors."""
    pair = np.unique(doc.astype(np.int64) << BUCKETS | bucket)
    has, cls = pair & ((1 << BUCKETS) - 1), y[pair >> BUCKETS]
    one, zero = (np.bincount(has[cls == c], minlength=1 << BUCKETS) for c in (1, 0))
    odds = np.log((one + 1) / (y.sum() + 2)) - np.log((zero + 1) / (len(y) - y.sum() + 2))
    error = np.sqrt(1 / (one + 1) + 1 / (zero + 1))
    return (np.sign(odds) * np.clip(np.abs(odds) - 1.64 * error, 0, 4)).astype(F4)  # only what is sure


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> dict:
    words = Words(*text_bytes(pa.array(texts, pa.large_string())))
    p = start(seed)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.at))
    p["Ew"][:, 0] = log_odds(words.bucket[words.ids], doc, y)
    for k, part in words.parts.items():
        first = np.concatenate([[0], np.cumsum(np.bincount(part.owner, minlength=len(words.bucket)))])
        many = np.diff(first)[words.ids]
        take = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first[words.ids], many)
        p[k][:, 0] = log_odds(part.bucket[take], np.repeat(doc, many), y)
    ids, owner = words.windows()
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    r, step = np.random.default_rng(seed), 0
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    rounds = max(ROUNDS, -(-STEPS // -(-len(texts) // BATCH)))
    for round_ in range(rounds):
        if round_ == 0:  # the window with the largest log odds stands for its text at first
            x = words.inputs(p)
            odds = np.append(x[:, 0] + x[:, EMBED] + x[:, 2 * EMBED], -9)
            score = odds[ids].max(axis=1)
        else:
            x = words.inputs(p)
            score = np.concatenate([forward(p, x, ids[i : i + 4096]) for i in range(0, len(ids), 4096)])
        order = np.lexsort((score, owner))
        best = order[np.r_[owner[order][1:] != owner[order][:-1], True]]
        chosen = r.permutation(best)
        for lo in range(0, len(chosen), BATCH):
            some = chosen[lo : lo + BATCH]
            g = gradients(p, words, ids[some], y[owner[some]], weight[owner[some]] / len(some))
            step += 1
            for k in p:
                rate = (0.002 if k in ("Ew", "Ec", "Ep") else 0.02) * min(1, 2 * (1 - round_ / rounds))
                mean[k] += F4(0.1) * (g[k].reshape(p[k].shape) - mean[k])
                square[k] += F4(0.01) * (g[k].reshape(p[k].shape) ** 2 - square[k])
                p[k] -= F4(rate) * (mean[k] / (1 - 0.9**step)).astype(F4) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6).astype(F4)
    return p


def score_texts(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            score = np.full(batch.num_rows, p["share"]) if "share" in p else np.zeros(batch.num_rows)
            for lo, hi in row_slices(off, SLICE) if "share" not in p else ():
                part = off[lo : hi + 1]
                words = Words(raw[part[0] : part[-1]], part - part[0])
                ids, owner = words.windows()
                x = words.inputs(p)
                logit = np.concatenate([forward(p, x, ids[i : i + 4096]) for i in range(0, len(ids), 4096)])
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                score[lo:hi] = sigmoid(np.maximum.reduceat(logit, first).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, seed: int = 5) -> DataFrame:
    """docs with held_out, score, predicted; learns from labels (doc_id, toxic) outside the held fold."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() not in {"held_out", "score", "predicted"}]
    rows = docs.select(*keep, (bucket_of(F.col("doc_id"), folds) == held).alias("held_out"))
    known = labels.where(F.col("toxic").isNotNull() & (bucket_of(F.col("doc_id"), folds) != held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = spark.createDataFrame(bounded_sample(known, "toxic", ["doc_id"], 4 * TRAIN_EACH, seed), known.schema)  # 4 TRAIN_EACH rows at most
    texts = rows.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES)
    sample = bounded_sample(texts.join(F.broadcast(chosen), "doc_id"), "toxic", ["doc_id", "text"], 2 * TRAIN_EACH, seed)
    sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = np.array(sample.column("toxic").to_pylist(), np.int64)
    both = 0 < y.sum() < len(y)
    model = train(sample.column("text").to_pylist(), y, seed) if both else {"share": float(y.mean()) if len(y) else 0.0}
    kept = [*keep, "held_out"]
    schema = rows.select(*kept).schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(score_texts(spark.sparkContext.broadcast(model), kept), schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
