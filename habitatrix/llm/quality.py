"""Quality of a text: naive Bayes support vectors on character n-gram indicators.

Indicators are scaled by the classes' log-count ratios; a linear hinge-loss model is fitted to them
by dual coordinate descent, and a logistic curve turns its margins into probabilities.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix.llm.ngrams import BITS, ROWS, bounded_sample, codepoints, presence
from habitatrix.llm.tables import held_out, materialize, rows_by_bytes, ship, whole_text
from habitatrix.session import lookup

ORDERS = (1, 2, 3)


@dataclasses.dataclass(frozen=True)
class Settings:
    """``per_label`` bounds the labelled rows that the classifier is fitted on."""

    per_label: int = 3_000
    epochs: int = 12
    cost: float = 1.0
    smoothing: float = 1.0


def _indicators(texts: list[str]):
    """Row and bin of every n-gram that a text has, sorted by row."""
    import numpy as np

    for i in range(0, len(texts), ROWS):
        some = texts[i : i + ROWS]
        points, rows = codepoints(some, lower=False)
        at = np.flatnonzero(presence(points, rows, len(some), ORDERS).ravel())
        yield i, len(some), at >> BITS, at & ((1 << BITS) - 1)


def dual_descent(examples, y, cost, epochs: int, size: int):
    """Weights that minimise w.w / 2 + sum of cost * hinge; one dual variable for each example."""
    import numpy as np

    w, a = np.zeros(size), np.zeros(len(examples))
    norm = np.array([float(x @ x) for _, x in examples])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at, x = examples[i]
            if norm[i] == 0:
                continue
            grad = y[i] * float(w[at] @ x) - 1
            new = min(max(a[i] - grad / norm[i], 0.0), cost[i])
            if new != a[i]:
                w[at] += (new - a[i]) * y[i] * x
                a[i] = new
    return w


def logistic_curve(margin, y, weight):
    """Slope and shift of the probability of label 1, by Newton steps on the weighted likelihood."""
    import numpy as np

    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-6 * c
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        c = c - np.clip(np.linalg.solve(hess, grad), -5, 5)
    return float(max(c[0], 1e-3)), float(c[1])


def _train(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rows = sorted(
            (doc if doc is not None else -1, label, weight, text)
            for b in batches
            for doc, label, weight, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)
        )
        label = np.array([r[1] for r in rows], dtype="int64")
        weight = np.array([r[2] for r in rows])
        bins = []
        for _, n, row, b in _indicators([r[3] for r in rows]):
            bins += np.split(b, np.searchsorted(row, np.arange(1, n)))
        spared = np.random.default_rng(11).random(len(rows)) < 0.2
        count = np.full((2, 1 << BITS), s.smoothing)
        for i in np.flatnonzero(~spared):
            count[label[i], bins[i]] += 1
        ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())

        def scaled(i):
            x = ratio[bins[i]]
            return bins[i], x / max(float(np.sqrt(x @ x)), 1e-9)

        kept = np.flatnonzero(~spared)
        y = np.where(label[kept] == 1, 1.0, -1.0)
        w = dual_descent([scaled(i) for i in kept], y, np.full(len(kept), s.cost), s.epochs, 1 << BITS)
        check = np.flatnonzero(spared)
        margin = np.array([w[at] @ x for at, x in map(scaled, check)])
        both = len(np.unique(label[check])) == 2
        slope, shift = logistic_curve(margin, label[check], weight[check]) if both else (1.0, 0.0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ratio.astype("float32").tobytes()]),
                pa.array([(ratio * w).astype("float32").tobytes()]),
                pa.array([slope]),
                pa.array([shift]),
            ],
            names=["ratio", "w", "slope", "shift"],
        )

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        square, w, slope, shift = shared.value
        for part in rows_by_bytes(batches, "_text"):
            texts = part.column(1).to_pylist()
            margin = np.zeros(len(texts))
            for i, n, row, b in _indicators(texts):
                norm = np.sqrt(np.bincount(row, square[b], minlength=n))
                margin[i : i + n] = np.bincount(row, w[b], minlength=n) / np.maximum(norm, 1e-9)
            score = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["_row", "score"])

    return run


def score(
    docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()
) -> DataFrame:
    """Columns of ``docs`` but the text, with ``held_out`` and ``score`` for each row.

    Learns from rows that are not held out and whose label is 0 or 1.  A bounded sample of about
    ``per_label`` rows of each label is fitted in one task; every whole text is scored.  NULL and
    empty texts get the model's score for a text without n-grams; without labels of both kinds every
    score is 0.5.  Contradicting labels of one document all count.
    """
    import numpy as np

    spark = docs.sparkSession
    ship(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_label").isin(0, 1) & ~held_out())
    chosen = materialize(bounded_sample(known, "_label", settings.per_label), "quality-sample")
    narrow = docs.select("doc_id", whole_text().alias("_text"))
    sample = materialize(
        narrow.join(lookup(chosen), "doc_id").select("doc_id", "_label", "weight", "_text"), "quality-texts"
    )
    kept = [c for c in docs.columns if c.lower() not in ("text", "held_out", "score")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept], held_out().alias("held_out")).alias("_row")
    if sample.select("_label").distinct().count() < 2:
        return docs.select(row, F.lit(0.5).alias("score")).select("_row.*", "score")
    got = sample.coalesce(1).mapInArrow(
        _train(settings), "ratio binary, w binary, slope double, shift double"
    ).collect()[0]
    ratio, w = (np.frombuffer(got[k], dtype="float32").astype("float64") for k in ("ratio", "w"))
    model = spark.sparkContext.broadcast((ratio**2, w, got["slope"], got["shift"]))
    rows = docs.select(row, whole_text().alias("_text"))
    schema = rows.select("_row", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_score(model), schema).select("_row.*", "score")
