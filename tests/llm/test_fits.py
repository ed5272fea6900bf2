"""Training loops against plain ones on small texts."""

import dataclasses
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from habitatrix.llm import quality, toxicity
from habitatrix.llm.tables import texts_of


def batch(rows):
    ids, labels, weights, texts = zip(*rows, strict=True)
    kinds = (pa.int64(), pa.int32(), pa.float64(), pa.string())
    columns = [pa.array(c, t) for c, t in zip((ids, labels, weights, texts), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "_label", "weight", "_text"])


def small_corpus(seed, n=50):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(15)] + ["vile", "fool"]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        sentences = [" ".join(rng.choice(words[:15]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 4))]
        if y:
            sentences[rng.randrange(len(sentences))] += " vile fool"
        rows.append((i, y, rng.choice([1.0, 2.0, 5.0]), ". ".join(sentences) + "."))
    return rows


def minus_log_likelihood(z, y):
    """Of a document whose sentences have the logits ``z``: toxic if any of them is."""
    clean = math.prod(1 - 1 / (1 + math.exp(-v)) for v in z)
    return -math.log(1 - clean if y else clean)


@pytest.mark.parametrize("seed", [1, 2])
def test_noisy_or_training(seed):
    """The weights of the loop, from slopes by differences of the likelihood itself."""
    rows = small_corpus(seed)
    s = dataclasses.replace(toxicity.Settings(), epochs=3, min_documents=2)
    got = next(toxicity._train(s)(iter([batch(rows)])))
    w = np.frombuffer(got.column("w")[0].as_py(), dtype="float32")

    examples = []
    for i, y, weight, text in rows:
        features, first, _, _, _ = toxicity.sentences(*texts_of(batch([(i, y, weight, text)]), "_text"))
        cut = [*first.tolist(), len(features)]
        examples.append((y, weight, [[f for word in features[a:b].tolist() for f in word] for a, b in zip(cut[:-1], cut[1:])], len(features)))
    examples = [e for _, e in sorted(enumerate(examples), key=lambda p: (rows[p[0]][0], rows[p[0]][1], p[1][3]))]
    mean = sum(e[1] for e in examples) / len(examples)
    seen: dict[int, int] = {}
    for _, _, sentences, _ in examples:
        for f in {f for x in sentences for f in x}:
            seen[f] = seen.get(f, 0) + 1
    plain: dict[int, float] = {}
    squares: dict[int, float] = {}
    bias, bias_square = s.prior, 1e-8
    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        order = rng.permutation(len(examples)).tolist()
        for at in range(0, len(order), s.batch):
            grad: dict[int, float] = {}
            some = [examples[k] for k in order[at : at + s.batch] if examples[k][2]]
            slopes = 0.0
            for y, weight, sentences, _ in some:
                z = [sum(plain.get(f, 0.0) for f in x) + bias for x in sentences]
                for k, x in enumerate(sentences):
                    up, down = [[v + (h if j == k else 0) for j, v in enumerate(z)] for h in (1e-5, -1e-5)]
                    slope = (minus_log_likelihood(up, y) - minus_log_likelihood(down, y)) / 2e-5 * weight / mean
                    slopes += slope
                    for f in x:
                        grad[f] = grad.get(f, 0.0) + slope
            for f, g in grad.items():
                g = (g + s.l2 * len(some) * plain.get(f, 0.0)) * (seen[f] >= s.min_documents)
                squares[f] = squares.get(f, 1e-8) + g * g
                plain[f] = plain.get(f, 0.0) - s.rate * g / math.sqrt(squares[f])
            bias_square += slopes**2
            bias -= s.rate * slopes / math.sqrt(bias_square)
    assert got.column("bias")[0].as_py() == pytest.approx(bias, abs=2e-3)
    assert max(abs(w[f] - v) for f, v in plain.items()) < 2e-3
    assert set(np.flatnonzero(w).tolist()) <= set(plain)


@pytest.mark.parametrize("seed", [3, 4])
def test_dual_descent_reaches_the_optimum(seed):
    """The dual variables' conditions hold, and a plain projected gradient finds nothing better."""
    rng = np.random.default_rng(seed)
    n, size = 40, 12
    dense = rng.standard_normal((n, size)) * (rng.random((n, size)) < 0.5)
    y = np.where(rng.random(n) < 0.5, 1.0, -1.0)
    cost = rng.choice([0.5, 1.0], n)
    examples = [(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in dense]
    w = quality.dual_descent(examples, y, cost, 4000, size)

    def objective(v):
        return v @ v / 2 + (cost * np.maximum(0, 1 - y * (dense @ v))).sum()

    a, q = np.zeros(n), (dense * y[:, None]) @ (dense * y[:, None]).T
    step = 1 / np.linalg.eigvalsh(q).max()
    for _ in range(40_000):
        a = np.clip(a - step * (q @ a - 1), 0, cost)
    best = (a * y) @ dense
    assert objective(w) == pytest.approx(objective(best), rel=1e-6)
    assert np.abs(w - best).max() < 1e-3


def test_log_count_ratios():
    """Ratios of the fit are those of plain counts over the rows that are not spared."""
    rng = random.Random(5)
    rows = [(i, i % 2, 1.0, " ".join(rng.choice(["good", "fine", "text"] if i % 2 else ["bad", "$$", "text"]) for _ in range(6))) for i in range(60)]
    s = quality.Settings()
    got = next(quality._train(s)(iter([batch(rows)])))
    ratio = np.frombuffer(got.column("ratio")[0].as_py(), dtype="float32")
    spared = np.random.default_rng(11).random(len(rows)) < 0.2
    counts = [{}, {}]
    for row, out in zip(rows, spared, strict=True):
        if not out:
            _, _, at, bins = next(quality._indicators([row[3]]))
            for b in set(bins.tolist()):
                counts[row[1]][b] = counts[row[1]].get(b, 0) + 1
    totals = [sum(c.values()) + s.smoothing * len(ratio) for c in counts]
    for b in set(counts[0]) | set(counts[1]):
        one, zero = (math.log((counts[k].get(b, 0) + s.smoothing) / totals[k]) for k in (1, 0))
        assert ratio[b] == pytest.approx(one - zero, abs=1e-5)


def test_follow_the_regularised_leader():
    """Weights of the fit, one coordinate at a time by the update's own definition, and the temperature."""
    from habitatrix.llm import language_id
    from habitatrix.llm.ngrams import BITS, grams

    rng = random.Random(6)
    languages, s = ["aa", "bb", "cc"], language_id.Settings(epochs=2)
    sound = {"aa": "the and of", "bb": "der und zu", "cc": "el los que"}
    rows = [(i, lang, " ".join(rng.choice(sound[lang].split()) for _ in range(rng.randint(1, 4)))) for i in range(25) for lang in [rng.choice(languages)]]
    idf = np.linspace(1, 2, 1 << BITS).astype("float32")
    kinds = (pa.int64(), pa.string(), pa.string())
    given = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "lang", "_text"])
    got = next(language_id._train(languages, idf, s)(iter([given])))
    w = np.frombuffer(got.column("w")[0].as_py(), dtype="float32").reshape(-1, 3)

    examples = []
    for _, lang, text in rows:
        points, _, _ = language_id._simplified([text])
        counts: dict[int, float] = {}
        for o in language_id.ORDERS:
            for b in grams(points, o)[1].tolist():
                counts[b] = counts.get(b, 0) + float(idf[b])
        whole = sum(counts.values())
        examples.append(({b: s.scale * v / whole for b, v in counts.items()}, languages.index(lang)))
    order = np.random.default_rng(7).permutation(len(examples)).tolist()
    kept, spared = order[len(order) // 5 :], order[: len(order) // 5]
    z: dict = {}
    n: dict = {}

    def weight(b, k):
        v = z.get((b, k), 0.0)
        if abs(v) <= s.l1:
            return 0.0
        return -(v - math.copysign(s.l1, v)) / ((s.beta + math.sqrt(n[b, k])) / s.alpha + s.l2)

    def logits(x):
        return [sum(v * weight(b, k) for b, v in x.items()) for k in range(3)]

    for _ in range(s.epochs):
        for i in kept:
            x, y = examples[i]
            e = [math.exp(v) for v in logits(x)]
            old = {(b, k): weight(b, k) for b in x for k in range(3)}
            for b, v in x.items():
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    before = n.get((b, k), 0.0)
                    n[b, k] = before + g * g
                    z[b, k] = z.get((b, k), 0.0) + g - (math.sqrt(n[b, k]) - math.sqrt(before)) / s.alpha * old[b, k]
    assert max(abs(w[b, k] - weight(b, k)) for b, k in z) < 1e-4
    assert {b for b in np.flatnonzero(np.abs(w).sum(axis=1)).tolist()} <= {b for b, _ in z}

    def loss(t):
        out = 0.0
        for i in spared:
            v = [u / t for u in logits(examples[i][0])]
            out += math.log(sum(map(math.exp, v))) - v[examples[i][1]]
        return out

    grid = [math.exp(-3 + 0.1 * i) for i in range(61)]
    assert got.column("t")[0].as_py() == pytest.approx(min(grid, key=loss))
