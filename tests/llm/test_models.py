"""The trained operators: held-out accuracy where a task can be learned, the model's arithmetic, and edge cases."""

from __future__ import annotations

import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_id, ppm_scoring, toxicity
from tessera.llm.common import bounded_sample, mix64, span_hashes, table, text_bytes

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def fold(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


# ---------------------------------------------------------------- language ID


def test_languages_held_out(spark):
    docs = {r.doc_id: r.lang for r in table(spark, MIDDLE, "documents").select("doc_id", "lang").collect()}
    got = language_id.op6_language_id(spark, MIDDLE).collect()
    assert len(got) == len(docs) and all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id]]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    rows = [(i, f"wort der die und {i} ung heit", "de") for i in range(20)] + [(100 + i, f"the and of {i} tion ing", "en") for i in range(20)]
    rows += [(200, None, "de"), (201, "", "en"), (202, "123 !", "en"), (None, "the and of the", None), (203, "ÄÖ " * 50_000, None)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")).collect()}
    assert {got[i] for i in (200, 201, 202)} == {"und"} and got[None] == "en" and got[203] in ("de", "en")
    none = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify(none).collect()] == ["und"]
    assert language_id.identify(none.limit(0)).count() == 0


def plain_language(model, text: str) -> tuple[str, float]:
    """Family, then votes of the pairs within it, by plain loops over the text's trigrams."""
    if not text or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    data = b" " + bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.encode().lower()) + b"  "
    grams = [data[i : i + 3] for i in range(len(data) - 2)]
    margins = [float(b) for b in model.bias]
    for g in grams:
        bucket = (int.from_bytes(g, "big") * 2654435761 % 2**32) >> (32 - language_id.DIMS)
        for k in range(len(margins)):
            margins[k] += float(model.weights[bucket, k]) / len(grams)
    sure = lambda m: 1 / (1 + np.exp(-4 * m))
    many = len(model.families) > 1
    family = max(range(len(model.families)), key=lambda k: margins[k]) if many else 0
    score, pairs = (sure(margins[family]) if many else 1.0), margins[len(model.families) if many else 0 :]
    votes = dict.fromkeys(model.families[family], 0.0)
    for (a, b), m in zip(model.pairs, pairs, strict=True):
        if a in votes:
            votes[a] += (m > 0) + 1e-3 * np.tanh(m)
            votes[b] += (m <= 0) - 1e-3 * np.tanh(m)
    best = max(votes, key=votes.get)
    own = [m if a == best else -m for (a, b), m in zip(model.pairs, pairs, strict=True) if best in (a, b)]
    return model.langs[best], score * (sure(min(own)) if own else 1.0)


def test_languages_equal_plain_loops(spark, monkeypatch):
    kept = {}
    real = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda texts, langs: kept.setdefault("model", real(texts, langs)))
    docs = table(spark, SMALL, "documents").select("doc_id", "text", "lang").where("length(text) < 3000")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "12 _ !", "en"), (-4, "É", None), (-5, "x", None), (-6, "Ab-cd  \n é", None)], docs.schema)
    docs = docs.union(odd)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language_id.identify(docs).collect():
        lang, score = plain_language(kept["model"], texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)


def test_language_fit_holds_one_matrix():
    """The driver has the matrix of shares, and no second one beside it; the texts' order leaves the machines as they are."""
    rows = [(f"{lang} {word} {i} {word[::-1]}", lang) for i in range(300) for lang, word in (("de", "wort"), ("fr", "mot"), ("en", "word"), ("es", "palabra"), ("nl", "woord"))]
    tracemalloc.start()
    model = language_id.fit(*map(list, zip(*rows, strict=True)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.3 * 4 * len(rows) * (1 << language_id.DIMS)
    again = language_id.fit(*map(list, zip(*sorted(rows, key=lambda r: r[1]), strict=True)))
    assert model.langs == again.langs == ["de", "en", "es", "fr", "nl"] and model.pairs == again.pairs
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.bias, again.bias)


def test_bounded_sample(spark):
    """Hard limits: of each label, of rows equal in key, of labels."""
    rows = [(i % 50 if i < 900 else 7, f"t{i % 300}" if i < 900 else "same", "a" if i % 10 else "b") for i in range(2000)] + [(1, "x", f"rare{i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    for total in (10, 64, 5000):
        got = bounded_sample(frame, "lang", ["doc_id", "text"], total, 1).to_pylist()
        per = Counter(r["lang"] for r in got)
        labels = min(total, 32)
        assert len(per) <= labels and max(per.values()) <= max(1, total // labels) and len({tuple(r.values()) for r in got}) == len(got)
        again = bounded_sample(frame.repartition(7), "lang", ["doc_id", "text"], total, 1).to_pylist()
        assert got == again
    assert bounded_sample(frame.limit(0), "lang", ["doc_id", "text"], 5, 1).num_rows == 0


# ---------------------------------------------------------------- toxicity


def test_gradients_match_differences():
    texts = ["a nasty word here", "all is well with this text", "nasty nasty"]
    words = toxicity.Words(*text_bytes(pa.array(texts, pa.large_string())))
    ids, _ = words.windows()
    p = {k: v.astype(np.float64) for k, v in toxicity.start(1).items()}
    y, weight = np.array([1, 0, 1]), np.ones(3)

    def loss() -> float:
        z = toxicity.forward(p, words.inputs(p), ids)
        return float(-(y * np.log(toxicity.sigmoid(z)) + (1 - y) * np.log(1 - toxicity.sigmoid(z))).sum())

    g = toxicity.gradients(p, words, ids, y, weight)
    r = np.random.default_rng(0)
    for k in p:
        flat = np.flatnonzero(np.abs(g[k].reshape(-1)) > 1e-4)
        for i in r.choice(flat, min(3, len(flat)), replace=False):
            v = p[k].reshape(-1)
            keep, h = v[i], 1e-3
            v[i] = keep + h
            up = loss()
            v[i] = keep - h
            down = loss()
            v[i] = keep
            assert (up - down) / (2 * h) == pytest.approx(g[k].reshape(-1)[i], rel=0.1, abs=5e-3), k


def test_windows_cover_and_overlap():
    n = toxicity.WINDOW * 3 + 7
    words = toxicity.Words(*text_bytes(pa.array([" ".join(f"w{i}" for i in range(n)), "", "one"], pa.large_string())))
    ids, doc = words.windows()
    assert set(ids[doc == 0].reshape(-1)) >= set(words.ids[:n]) and (doc == 1).sum() == (doc == 2).sum() == 1
    assert len(set(ids[0]) & set(ids[1])) == toxicity.WINDOW - toxicity.STRIDE


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, MIDDLE, "labels").collect()}
    got = toxicity.op5_toxicity(spark, MIDDLE).collect()
    assert len(got) == table(spark, MIDDLE, "documents").count()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (3, "word " * 40_000, "c"), (3, "word", "c")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(1, None), (3, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1  # one class only: the share of label 1
    assert toxicity.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def plain_score(p: dict, text: str) -> float:
    """The network by plain loops: word inputs, both recurrences, attention, the most toxic window."""
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())) if w]
    top, e, n = 64 - toxicity.BUCKETS, toxicity.EMBED, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(w: bytes) -> np.ndarray:
        hashed = lambda b: int(span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
        framed = b"\0" + w + b"\0"
        grams = [int(mix64(np.array([int.from_bytes(framed[i : i + k], "big") + ((k - 1) << 40)], np.uint64))[0]) >> top for k in (3, 4) for i in range(len(framed) - k + 1)]
        begin = [hashed(w[:k]) >> top for k in toxicity.BEGINNINGS if len(w) >= k]
        mean = lambda table, ids: np.mean([table[i] for i in ids], axis=0) if ids else np.zeros(e)
        return np.concatenate([p["Ew"][hashed(w) >> top], mean(p["Ec"], grams), mean(p["Ep"], begin)]).astype(float)

    def states(xs: list, d: str) -> list:
        h, out = np.zeros(n), []
        for x in xs:
            a, g = x @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
            z, r = sig(a[:n] + g[:n]), sig(a[n : 2 * n] + g[n : 2 * n])
            new = np.tanh(a[2 * n :] + r * g[2 * n :])
            h = new + z * (h - new)
            out.append(h)
        return out

    best, start = None, 0
    while best is None or start < len(words):
        at = min(start, max(0, len(words) - toxicity.WINDOW))
        xs = [vector(w) for w in words[at : at + toxicity.WINDOW]]
        logit = float(p["b"][0])
        if xs:
            both = [np.concatenate(s) for s in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
            weight = np.exp([np.tanh(h @ p["Wa"] + p["ba"]) @ p["v"] for h in both])
            logit += sum(w * h for w, h in zip(weight / weight.sum(), both, strict=True)) @ p["w"]
        best = logit if best is None else max(best, logit)
        if at + toxicity.WINDOW >= len(words):
            break
        start += toxicity.STRIDE
    return float(sig(best))


def test_toxicity_equals_plain_loops(spark, monkeypatch):
    kept = {}
    real = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y, seed: kept.setdefault("p", real(texts, y, seed)))
    docs = table(spark, SMALL, "documents").select("doc_id", "text").where("length(text) < 2500")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "Ab"), (-5, "é x Y"), (-6, "w " * 85)], docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, table(spark, SMALL, "labels")).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[:60]:
        assert got[i] == pytest.approx(plain_score(kept["p"], texts[i]), abs=2e-4)


# ---------------------------------------------------------------- LM scoring


def ppm(train: list[bytes], order: int):
    """Plain prediction by partial matching: escape method C, exclusion of the longer contexts' symbols."""
    counts = defaultdict(Counter)
    for t in train:
        s = b"\xff" * order + t + b"\xff"
        for i in range(order, len(s)):
            for j in range(order + 1):
                counts[s[i - j : i]][s[i]] += 1

    def score(t: bytes) -> float:
        s, total = b"\xff" * order + t + b"\xff", 0.0
        for i in range(order, len(s)):
            out: set[int] = set()
            for j in range(order, -1, -1):
                seen = {k: n for k, n in counts.get(s[i - j : i], {}).items() if k not in out}
                if s[i - j : i] not in counts:
                    continue
                n, d = sum(seen.values()), len(seen)
                if s[i] in seen:
                    total += log10(seen[s[i]] / (n + d))
                    break
                if d:
                    total += log10(d / (n + d))
                out |= set(seen)
            else:
                total -= log10(256 - len(counts[b""]))
        return total

    return score


def test_scores_equal_plain_ppm(spark):
    rows = [(i, t) for i, t in enumerate(["Abracadabra abra", "cadabra ABRA", "the cat sat", "the cat", "é è é", "", None, "zzz", "abra the zebra", "  "] * 4)]
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    train = [low(t) for i, t in rows if fold(i, 10)]
    score = ppm([t.encode() for t in train], ppm_scoring.ORDER)
    words = Counter(w for t in train for w in re.findall(r"[^\x20\x09-\x0D]+", t))
    n, v = sum(words.values()) + len(train), len(words) + 1
    got = {r.doc_id: r for r in ppm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, own = got[i], re.findall(r"[^\x20\x09-\x0D]+", low(t))
        base = sum(log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own) + log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (fold(i, 10) == 0, len(own) + 1, n, sum(words[w] > 0 for w in own) + 1)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score(low(t).encode()), abs=1e-6)


def test_lm_edges(spark):
    docs = spark.createDataFrame([(None, "x y"), (None, "x y"), (1, "word " * 100_000)], "doc_id long, text string")
    got = ppm_scoring.lm_scores(docs).collect()
    assert len(got) == 3 and all(r.score < 0 for r in got)
    assert ppm_scoring.lm_scores(docs.limit(0)).count() == 0


def test_cut_of_the_broadcast_table_changes_no_score(spark, monkeypatch):
    """With a node share that leaves most symbols out of the broadcast table, the scores are those of the whole counts."""
    rows = [(i, t) for i, t in enumerate(["abracadabra abra", "cadabra abra", "the cat sat", "the cat", "\u00e9 \u00e8", "", "zzz", "abra the zebra"] * 6)]
    score = ppm([t.encode() for i, t in rows if fold(i, 10)], ppm_scoring.ORDER)
    for share in (0.01, 1.0):
        monkeypatch.setattr(ppm_scoring, "NODE_SHARE", share)
        got = ppm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows)
        assert all(r.score == pytest.approx(score(rows[r.doc_id][1].encode()), abs=1e-6) for r in got)


def test_no_training_texts(spark):
    """All documents in the held fold: nothing is learned, so every token has (0 + 0.1) / (0 + 0.1) and every symbol 1/256."""
    held = [i for i in range(200) if fold(i, 10) == 0][:5]
    docs = spark.createDataFrame([(i, "ab c") for i in held], "doc_id long, text string")
    for r in ppm_scoring.lm_scores(docs).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)
        assert r.base_score == pytest.approx(0.0, abs=1e-12) and r.score == pytest.approx(5 * log10(1 / 256))
