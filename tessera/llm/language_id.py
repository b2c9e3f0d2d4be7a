"""Language ID by hierarchical discrimination: the language family first, then the closely related languages within it.

Features are the shares of hashed byte trigrams of the lower-cased whole text (A-Z only; ASCII other than letters counts
as space), scaled by the learned spread of each feature. One-versus-rest linear support vector machines pick the family;
inside it one-versus-one machines of every pair of its languages vote, the sum of margins breaks ties. All machines are
linear in the trigrams, so scoring a text is one gather and one sum.

Learning takes a bounded sample: at most TRAIN_ROWS labelled texts in all, the same number for each language, chosen by a
seeded hash of doc_id and text; a text longer than TRAIN_BYTES is not among them. Scoring covers every row and whole texts.

Nulls and texts without a letter: `und`, score 0. A null lang is never learned from. Without any label everything is
`und`; with one language all texts with letters are that language. Repeated rows get equal results. Empty tables give no
rows. Columns named held_out, lang_pred or score in the input are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bounded_sample, bucket_of, framed, own_names, row_slices, table, text_bytes

DIMS = 13
TRAIN_ROWS = 2400
TRAIN_BYTES = 1 << 16
SLICE = 1 << 19
#: ISO 639-1 codes by family; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr sl bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indo-aryan": "hi ur bn pa mr gu ne si",
    "iranian": "fa ku ps tg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

LETTERS = LOWER.copy()
for _b in range(128):
    if not 97 <= LETTERS[_b] <= 122:
        LETTERS[_b] = 32


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram of the texts (each with one space before and two after), and the n + 1 offsets among them."""
    b, at = framed(LETTERS[raw], off, 1, 2, 32)  # the last two places of each text are dropped below
    key = b[:-2].astype(np.uint32) << np.uint32(16) | b[1:-1].astype(np.uint32) << np.uint32(8) | b[2:] if len(b) > 2 else np.zeros(0, np.uint32)
    keep = np.ones(len(b), bool)
    keep[at[1:] - 1] = keep[at[1:] - 2] = False
    bucket = (key * np.uint32(2654435761)) >> np.uint32(32 - DIMS)
    return bucket[keep[: len(bucket)]], at - 2 * np.arange(len(at))


class Model(NamedTuple):
    langs: list[str]
    families: list[list[int]]  # languages of each family
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # a column for each family, then for each pair
    bias: np.ndarray


def linear_svm(blocks: list[np.ndarray], y: np.ndarray, rounds: int = 150, reg: float = 1e-4) -> np.ndarray:
    """Squared-hinge linear machine with a bias as last weight, by Nesterov's accelerated gradient steps. The rows are those of
    all blocks, which are read where they lie."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    cuts = np.cumsum([len(b) for b in blocks])[:-1]
    w = np.zeros(blocks[0].shape[1] + 1, np.float32)
    v, t = w.copy(), 1.0
    step = 1.0 / (2 * float(sum((s @ np.einsum("ij,ij->i", b, b) for b, s in zip(blocks, np.split(share, cuts), strict=True)), 0.0)) + 2 + reg)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (np.concatenate([b @ v[:-1] for b in blocks]) + v[-1]))
        g = -2 * share * y * slack
        slope = sum(b.T @ part for b, part in zip(blocks, np.split(g, cuts), strict=True))
        new = v - step * np.append(slope + reg * v[:-1], g.sum()).astype(np.float32)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


def fit(texts: list[str], langs: list[str]) -> Model:
    """The machines. The driver holds one matrix of shares (4 bytes for each text and bucket) and no copy of it: its rows are
    in order of languages, so a language's are one block."""
    names = sorted(set(langs))
    if not names:
        return Model([], [], [], np.zeros((1 << DIMS, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([names.index(x) for x in langs])
    order = np.argsort(y, kind="stable")
    y = y[order]
    by_family: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        by_family.setdefault(FAMILY_OF.get(name.lower()[:2] if "-" in name or "_" in name else name.lower(), name), []).append(i)
    families = list(by_family.values())
    pairs = [p for f in families for p in combinations(f, 2)]
    x = np.zeros((len(texts), 1 << DIMS), np.float32)
    squares = np.zeros(1 << DIMS, np.float32)
    for i, at in enumerate(order.tolist()):
        bucket, _ = trigrams(*text_bytes(pa.array([texts[at]])))
        x[i] = np.bincount(bucket, minlength=1 << DIMS) / max(1, len(bucket))
        squares += x[i] * x[i]
    scale = (1 / (np.sqrt(squares / np.float32(len(texts))) + 1e-4)).astype(np.float32)
    x *= scale
    norm = np.float32(1 / max(1e-9, np.sqrt(np.array([(row * row).sum() for row in x]).mean())))
    x *= norm
    columns = []
    family_of = np.empty(len(names), int)
    for k, f in enumerate(families):
        family_of[f] = k
    if len(families) > 1:
        columns += [linear_svm([x], np.where(family_of[y] == k, 1, -1).astype(np.float32)) for k in range(len(families))]
    ends = np.searchsorted(y, np.arange(len(names) + 1))
    for a, b in pairs:  # a < b
        blocks = [x[ends[a] : ends[b + 1]]] if b == a + 1 else [x[ends[k] : ends[k + 1]] for k in (a, b)]
        columns.append(linear_svm(blocks, np.repeat(np.float32([1, -1]), [ends[a + 1] - ends[a], ends[b + 1] - ends[b]])))
    w = np.array(columns, np.float32).reshape(len(columns), -1) if columns else np.zeros((0, (1 << DIMS) + 1), np.float32)
    return Model(names, families, pairs, np.ascontiguousarray((w[:, :-1] * scale * norm).T), w[:, -1])


def decide(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language index and score of every row of margins."""
    n, k = len(margins), len(model.families)
    sure = lambda m: 1 / (1 + np.exp(-4 * m))
    family = margins[:, :k].argmax(axis=1) if k > 1 else np.zeros(n, int)
    score = sure(margins[np.arange(n), family]) if k > 1 else np.ones(n)
    votes = np.zeros((n, len(model.langs)))
    for (a, b), m in zip(model.pairs, margins[:, k if k > 1 else 0 :].T, strict=True):
        votes[:, a] += (m > 0) + 1e-3 * np.tanh(m)
        votes[:, b] += (m <= 0) - 1e-3 * np.tanh(m)
    member = np.zeros((k, len(model.langs)), bool)
    for i, f in enumerate(model.families):
        member[i, f] = True
    lang = np.where(member[family], votes, -1).argmax(axis=1)
    worst = np.full(n, np.inf)
    for (a, b), m in zip(model.pairs, margins[:, k if k > 1 else 0 :].T, strict=True):
        worst = np.where(lang == a, np.minimum(worst, m), np.where(lang == b, np.minimum(worst, -m), worst))
    return lang, score * np.where(np.isinf(worst), 1.0, sure(np.where(np.isinf(worst), 0, worst)))


def predict(model, keep: list[str], letter_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            letter = batch.column(letter_column).to_numpy(zero_copy_only=False).astype(bool)
            if not m.langs:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(["und"] * batch.num_rows, pa.string()), pa.array(np.zeros(batch.num_rows))], [*keep, "lang_pred", "score"])
                continue
            margins = np.zeros((batch.num_rows, m.weights.shape[1]))
            for lo, hi in row_slices(off, SLICE):
                part = off[lo : hi + 1]
                bucket, at = trigrams(raw[part[0] : part[-1]], part - part[0])
                size = np.diff(at)
                some = np.flatnonzero(size > 0)
                if len(some) and m.weights.shape[1]:
                    sums = np.add.reduceat(m.weights[bucket], at[:-1][some], axis=0, dtype=np.float64)
                    margins[lo + some] = sums / size[some][:, None]
            lang, score = decide(m, margins + m.bias)
            names = np.array([*m.langs, "und"], object)[np.where(letter, lang, -1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names.tolist(), pa.string()), pa.array(np.where(letter, score, 0.0))], [*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, folds: int = 4, held: int = 2, seed: int = 6) -> DataFrame:
    """docs with held_out, lang_pred, score; learns from the rows with a lang outside the held fold."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() not in {"held_out", "lang_pred", "score"}]
    rows = docs.select(*keep, (bucket_of(F.col("doc_id"), folds) == held).alias("held_out"))
    labelled = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.select("doc_id", "lang", "text").where(F.octet_length("text") <= TRAIN_BYTES)
    sample = bounded_sample(labelled, "lang", ["doc_id", "text"], TRAIN_ROWS, seed)
    model = fit(sample.column("text").to_pylist(), sample.column("lang").to_pylist())
    (letter,) = own_names([*keep, "held_out"], "letter")
    ready = rows.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    kept = [*keep, "held_out"]
    schema = rows.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return ready.mapInArrow(predict(spark.sparkContext.broadcast(model), kept, letter), schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
