"""Language of a text: multinomial logistic regression on TF-IDF character n-grams.

Trained online with follow-the-regularised-leader (proximal) steps and elastic-net penalties;
a temperature, fitted on sampled rows that training left out, calibrates the probabilities.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitatrix.llm.chunked import forget
from habitatrix.llm.ngrams import BITS, ROWS, bounded_sample, codepoints, grams, letters, presence
from habitatrix.llm.tables import held_out, materialize, rows_by_bytes, ship, whole_text

UNKNOWN = "und"

#: Text that is scored at a time; every n-gram of it takes about 50 bytes.
SLICE = 1 << 19
ORDERS = (1, 2, 3)


@dataclasses.dataclass(frozen=True)
class Settings:
    """``per_language`` bounds the labelled rows that the classifier is fitted on."""

    per_language: int = 1_500
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 2e-4
    l2: float = 1e-4
    scale: float = 30.0  # a text's TF-IDF values add up to this


def _simplified(texts: list[str]):
    """Lower-cased code points with a blank for all but letters; whether each text has a letter."""
    import numpy as np

    points, rows = codepoints(texts, lower=True)
    is_letter = letters()[points]
    has = np.zeros(len(texts), dtype=bool)
    has[rows[is_letter]] = True
    return np.where(is_letter | (points == 0), points, np.uint32(32)), rows, has


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    forget()
    total, n = np.zeros(1 << BITS, dtype="int64"), 0
    for part in rows_by_bytes(batches, "_text", SLICE):
        texts = part.column(0).to_pylist()
        for i in range(0, len(texts), ROWS):
            some = texts[i : i + ROWS]
            points, rows, has = _simplified(some)
            total += presence(points, rows, len(some), ORDERS).sum(axis=0)
            n += int(has.sum())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bin", "n"]
    )


def inverse_frequencies(docs: DataFrame):
    """log((1 + texts) / (1 + texts with the bin)) + 1 over all ``docs``; the table has 65,536 bins."""
    import numpy as np

    sums = docs.mapInArrow(_frequencies, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    got = sums.toPandas()
    df = np.zeros(1 << BITS)
    seen = got["bin"] >= 0
    df[got.loc[seen, "bin"].to_numpy()] = got.loc[seen, "n"].to_numpy()
    n = float(got.loc[~seen, "n"].sum())
    return (np.log((1 + n) / (1 + df)).clip(0) + 1).astype("float32")


def _train(languages: list[str], idf, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        forget()
        rows = sorted(
            (doc if doc is not None else -1, lang, text)
            for b in batches
            for doc, lang, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
        )
        examples = []
        for _, lang, text in rows:
            points, _, _ = _simplified([text])
            bins = np.concatenate([grams(points, o)[1] for o in ORDERS])
            at, n = np.unique(bins, return_counts=True)
            x = n * idf[at]
            examples.append((at, s.scale * x / x.sum(), languages.index(lang)))
        order = np.random.default_rng(7).permutation(len(examples))
        kept, spared = order[len(order) // 5 :], order[: len(order) // 5]
        k = len(languages)
        z, sq = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))

        def weights(z, sq):
            shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
            return -shrunk / ((s.beta + np.sqrt(sq)) / s.alpha + s.l2)

        def probabilities(logits):
            e = np.exp(logits - logits.max())
            return e / e.sum()

        for _ in range(s.epochs):
            for i in kept:
                at, x, y = examples[i]
                w = weights(z[at], sq[at])
                p = probabilities(x @ w)
                p[y] -= 1
                g = np.outer(x, p)
                g2 = g * g
                z[at] += g - (np.sqrt(sq[at] + g2) - np.sqrt(sq[at])) / s.alpha * w
                sq[at] += g2
        w = weights(z, sq)
        logits = np.array([examples[i][1] @ w[examples[i][0]] for i in spared]).reshape(-1, k)
        truth = np.array([examples[i][2] for i in spared], dtype="int64")
        temperature, best = 1.0, np.inf
        for t in np.exp(np.linspace(-3, 3, 61)) if len(spared) else ():
            l = logits / t
            l = l - l.max(axis=1, keepdims=True)
            loss = (np.log(np.exp(l).sum(axis=1)) - l[np.arange(len(l)), truth]).mean()
            if loss < best:
                temperature, best = float(t), loss
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.astype("float32").tobytes()]), pa.array([temperature])], names=["w", "t"]
        )

    return run


@dataclasses.dataclass
class Model:
    languages: list[str]
    table: object  # (bins, languages + 1): weight * idf for each language, then idf
    temperature: float
    scale: float


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Model from ``_text`` and ``lang`` of ``docs``; None when no text with a letter has a language.

    IDF counts all of ``docs``.  The weights come from a sample of at most about
    ``per_language`` rows of each language, fitted in one task of that bounded size.
    """
    import numpy as np

    ship(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    sample = materialize(
        bounded_sample(usable.select("doc_id", "lang", "_text"), "lang", settings.per_language), "lang-sample"
    )
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not languages:
        return None
    idf = inverse_frequencies(usable.select("_text"))
    one = sample.select("doc_id", "lang", "_text").coalesce(1)
    row = one.mapInArrow(_train(languages, idf, settings), "w binary, t double").collect()[0]
    w = np.frombuffer(row["w"], dtype="float32").reshape(1 << BITS, len(languages))
    table = np.concatenate([w * idf[:, None] * settings.scale, idf[:, None]], axis=1).astype("float32")
    return Model(languages, np.ascontiguousarray(table), row["t"], settings.scale)


def _predict(shared, with_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        forget()
        m = shared.value
        for part in rows_by_bytes(batches, "_text", SLICE):
            texts = [t or "" for t in part.column(1).to_pylist()]
            points, rows, has = _simplified(texts)
            sums = np.zeros((len(texts), m.table.shape[1]))
            for order in ORDERS:
                at, bins = grams(points, order)
                if len(at):
                    own = rows[at]
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    for c in range(m.table.shape[1]):
                        sums[own[first], c] += np.add.reduceat(m.table[:, c][bins], first, dtype="float64")
            logits = sums[:, :-1] / np.maximum(sums[:, -1:], 1e-9) / m.temperature
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            names = np.array(m.languages, dtype=object)[best]
            names[~has] = UNKNOWN
            found = {
                "_row": part.column(0),
                "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(np.where(has, p[np.arange(len(p)), best], 0.0)),
            }
            if with_text:
                found["_text"] = part.column(1)
            yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))

    return run


def predict(docs: DataFrame, model: Model | None, with_text: bool = False) -> DataFrame:
    """Columns of ``docs`` but ``text`` and ``lang``, with ``lang_pred`` and ``score`` for each row.

    ``und`` with score 0 for texts that are NULL or have no letter, and for all without a model.
    ``with_text`` keeps ``text`` too, which goes to Python and back only once.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c.lower() not in ("text", "lang", "lang_pred", "score")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
    text = [F.col("text").cast("string").alias("_text")] if with_text else []
    named = docs.select(row, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *text)
    if model is None:
        scored = named
    else:
        narrow = docs.select(row, F.col("text").cast("string").alias("_text"))
        scored = narrow.mapInArrow(_predict(spark.sparkContext.broadcast(model), with_text), named.schema)
    texts = [F.col("_text").alias("text")] if with_text else []
    return scored.select("_row.*", *texts, "lang_pred", "score")


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on the rows that are not held out, then predict every row; adds ``held_out``."""
    learn = docs.select("doc_id", "lang", whole_text().alias("_text")).where(~held_out())
    rows = docs.withColumn("held_out", held_out())
    return predict(rows, fit(learn, settings))
