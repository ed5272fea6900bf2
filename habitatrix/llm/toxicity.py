"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is logistic in its words and word beginnings; noisy-or combines the
sentences of a document, and the weights are learned from document labels alone.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix.llm.hashing import WORDLIKE, Spans, word_spans
from habitatrix.llm.ngrams import bounded_sample
from habitatrix.llm.tables import held_out, materialize, rows_by_bytes, ship, texts_of, whole_text
from habitatrix.session import lookup

BITS = 18

#: Bytes of a word's beginning that are features besides the whole word.
BEGINNINGS = (4, 5, 6)

OFFENDING = "array<struct<start: int, stop: int, score: double>>"


@dataclasses.dataclass(frozen=True)
class Settings:
    """``per_label`` bounds the labelled rows that the classifier is fitted on."""

    per_label: int = 3_000
    epochs: int = 12
    batch: int = 64
    rate: float = 0.3
    l2: float = 1e-5
    min_documents: int = 5  # a feature of fewer sampled documents is ignored
    prior: float = -6.0  # bias of a sentence before training


def sentences(data, bounds):
    """Features of each word, the first word of each sentence, and each sentence's text and bytes.

    Sentences end after a run of ``.!?`` or at a line break; those without words are left out.
    """
    import numpy as np

    starts, ends = word_spans(data, bounds, WORDLIKE)
    spans = Spans(data, lower=True)
    hashes = [spans.hash(starts, ends)]
    hashes += [spans.hash(starts, np.minimum(ends, starts + k)) * np.uint64(k) for k in BEGINNINGS]
    features = (np.stack(hashes, axis=1) >> np.uint64(64 - BITS)).astype("int64")
    stops = np.isin(data, np.frombuffer(b".!?\n", dtype="uint8"))
    no = np.cumsum(stops)[starts] if len(starts) else np.zeros(0, dtype="int64")
    row = np.searchsorted(bounds, starts, side="right") - 1
    first = np.flatnonzero(np.append(True, (no[1:] != no[:-1]) | (row[1:] != row[:-1]))[: len(starts)])
    last = np.append(first[1:], len(starts)) - 1
    own = row[first]
    return features, first, own, starts[first] - bounds[own], ends[last] - bounds[own]


def _sums(values, first):
    import numpy as np

    return np.add.reduceat(values, first) if len(first) else np.zeros(0)


def _logistic(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _train(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        examples = []
        for part in rows_by_bytes(batches, "_text", 1 << 16):
            features, first, own, _, _ = sentences(*texts_of(part, "_text"))
            ids, label, weight = (part.column(i).to_pylist() for i in range(3))
            at = np.searchsorted(own, np.arange(part.num_rows + 1))
            word = np.append(first, len(features))
            for i in range(part.num_rows):
                f = features[word[at[i]] : word[at[i + 1]]]
                key = ids[i] if ids[i] is not None else -1
                examples.append((key, label[i], weight[i], f, first[at[i] : at[i + 1]] - word[at[i]]))
        examples.sort(key=lambda e: (e[0], e[1], len(e[3])))
        # Rows that each sampled one stands for, 1 on average: the fit sees the table's share of each label.
        mean = np.mean([e[2] for e in examples])
        seen = np.zeros(1 << BITS, dtype="int32")
        for e in examples:
            seen[np.unique(e[3])] += 1
        used = seen >= s.min_documents
        w, sq = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
        bias, bias_sq = s.prior, 1e-8
        rng = np.random.default_rng(7)
        for _ in range(s.epochs):
            order = rng.permutation(len(examples))
            for i in range(0, len(order), s.batch):
                some = [e for e in (examples[j] for j in order[i : i + s.batch]) if len(e[4])]
                if not some:
                    continue
                f = np.concatenate([e[3] for e in some])
                words = np.cumsum([0, *(len(e[3]) for e in some)])
                first = np.concatenate([e[4] + k for e, k in zip(some, words[:-1], strict=True)])
                n = np.array([len(e[4]) for e in some])
                docs = np.cumsum(n) - n
                p = _logistic(_sums(w[f].sum(axis=1), first) + bias)
                clean = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), docs))
                y = np.array([e[1] for e in some])
                # slope of the negative log likelihood in a sentence's logit
                pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
                pull = pull * np.array([e[2] for e in some]) / mean
                g = np.repeat(pull, n) * p
                per_word = np.repeat(g, np.diff(np.append(first, len(f))))
                at, back = np.unique(f.ravel(), return_inverse=True)
                grad = np.bincount(back, np.repeat(per_word, f.shape[1]), minlength=len(at))
                grad = (grad + s.l2 * len(some) * w[at]) * used[at]
                sq[at] += grad**2
                w[at] -= s.rate * grad / np.sqrt(sq[at])
                bias_sq += g.sum() ** 2
                bias -= s.rate * g.sum() / np.sqrt(bias_sq)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.astype("float32").tobytes()]), pa.array([float(bias)])], names=["w", "bias"]
        )

    return run


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        w, bias = shared.value
        for part in rows_by_bytes(batches, "_text"):
            features, first, own, start, stop = sentences(*texts_of(part, "_text"))
            p = _logistic(_sums(w[features].sum(axis=1, dtype="float64"), first) + bias)
            clean = np.bincount(own, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=part.num_rows)
            score = -np.expm1(clean)
            bad: list[list] = [[] for _ in range(part.num_rows)]
            for i in np.flatnonzero(p >= threshold):
                bad[own[i]].append({"start": int(start[i]), "stop": int(stop[i]), "score": float(p[i])})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(score), pa.array(bad, kind)], names=["_row", "score", "offending"]
            )

    return run


def score(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    settings: Settings = Settings(),
    threshold: float = 0.5,
) -> DataFrame:
    """Columns of ``docs`` but the text, with ``held_out``, ``score`` and ``offending`` for each row.

    ``offending`` lists the sentences with a probability of ``threshold`` or more, as byte ranges of
    the UTF-8 text.  Learns from rows that are not held out and whose label is 0 or 1: a bounded
    sample of about ``per_label`` rows of each, weighted by the rows it stands for, fitted in one task.  Texts without a word score 0;
    without labels of both kinds every score is 0.
    """
    import numpy as np

    spark = docs.sparkSession
    ship(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_label").isin(0, 1) & ~held_out())
    chosen = materialize(bounded_sample(known, "_label", settings.per_label), "toxic-sample")
    narrow = docs.select("doc_id", whole_text().alias("_text"))
    sample = materialize(
        narrow.join(lookup(chosen), "doc_id").select("doc_id", "_label", "weight", "_text"), "toxic-texts"
    )
    results = ("text", "held_out", "score", "offending")
    kept = [c for c in docs.columns if c.lower() not in results]
    row = F.struct(*[F.col(f"`{c}`") for c in kept], held_out().alias("held_out")).alias("_row")
    if sample.select("_label").distinct().count() < 2:
        none = F.array().cast(OFFENDING).alias("offending")
        return docs.select(row, F.lit(0.0).alias("score"), none).select("_row.*", "score", "offending")
    got = sample.coalesce(1).mapInArrow(_train(settings), "w binary, bias double").collect()[0]
    w = np.frombuffer(got["w"], dtype="float32")
    model = spark.sparkContext.broadcast((w, got["bias"]))
    rows = docs.select(row, whole_text().alias("_text"))
    none = F.array().cast(OFFENDING).alias("offending")
    schema = rows.select("_row", F.lit(0.0).alias("score"), none).schema
    scored = rows.mapInArrow(_score(model, threshold), schema)
    return scored.select("_row.*", "score", "offending")
