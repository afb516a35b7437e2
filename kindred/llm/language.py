"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three code points of the lower-cased text. Document frequencies are counted over every training document.
The weights are learned on a bounded, hash-picked sample with equal room for each language (`sample_rows` in all, a documented bound) by
follow-the-regularised-leader with elastic-net penalties; a part of that sample is left out to fit one temperature, which calibrates the scores. The labels left out are smoothed by one row in their number plus two:
where the languages are told apart without an error, the mean score says how many rows have shown it.
Predictions read whole texts and see nothing but the text.

Edge cases: a null text, or one without a letter, is `und` with score 0; rows with a null language are never trained on; without any training
row, everything is `und`; ties go to the language that sorts first; repeated rows get equal results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm import _vec as V

BUCKET_BITS = 15
SAMPLE_ROWS = 2400
_N = 1 << BUCKET_BITS


def gram_counts(text: str) -> np.ndarray:
    """Occurrences of each hashed n-gram of 1 to 3 code points of the whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shift = np.uint64(64 - BUCKET_BITS)
    one = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    total = np.bincount((one >> shift).astype(np.int64), minlength=_N)
    mixed = one
    for n, factor in ((2, 0xBF58476D1CE4E5B9), (3, 0x94D049BB133111EB)):
        if len(points) < n:
            break
        mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint64(29))) * np.uint64(factor) + one[n - 1 :]
        total += np.bincount(((mixed * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64), minlength=_N)
    return total


def weights_of(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in use and their unit-length TF-IDF weights."""
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / (norm or 1.0)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def train_ftrl(examples: list, n_classes: int, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """examples: (buckets, weights, class). The weights n_classes x buckets that follow-the-regularised-leader ends at."""
    z, n = np.zeros((n_classes, _N)), np.zeros((n_classes, _N))

    def solve(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, value, label = examples[i]
            zi, ni = z[:, at], n[:, at]
            w = solve(zi, ni)
            p = softmax(w @ value)
            p[label] -= 1
            g = p[:, None] * value
            squared = g * g
            z[:, at] = zi + g - (np.sqrt(ni + squared) - np.sqrt(ni)) / alpha * w
            n[:, at] = ni + squared
    return solve(z, n)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden-section search over its logarithm.
    Each label counts for 1 - 1 / (n + 2) of its row and the other languages share the rest, so that n rows without an error don't say more than n rows can."""
    if not len(labels):
        return 1.0
    n, kinds = scores.shape
    unsure = 1 / (n + 2) if kinds > 1 else 0.0
    share = np.full((n, kinds), unsure / max(1, kinds - 1))
    share[np.arange(n), labels] = 1 - unsure

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        top = s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s - top).sum(1)) + top[:, 0] - (share * s).sum(1)))

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        at, value = weights_of(gram_counts(text), self.idf)
        p = softmax(self.weights[:, at] @ value / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on the rows where `train` holds and the language is known."""
    V.tune(docs.sparkSession)
    known = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    src = known.select(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")).alias("_h"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))

    def frequencies(batches):
        df = np.zeros(_N + 1, np.int64)
        for batch in batches:
            for text in batch.column("_text"):
                df[:_N] += gram_counts(text.as_py()) > 0
            df[_N] += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "n"])

    df = np.zeros(_N + 1, np.int64)
    # one row a bucket, whatever the table's size
    for row in src.select("_text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[row["bucket"]] = row["n"]
    idf = np.log((1 + df[_N]) / (1 + df[:_N])) + 1

    sizes = {r["_lang"]: r["n"] for r in src.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], idf, np.zeros((0, _N)))
    each = max(1, sample_rows // len(languages))
    # A share of the hash range for each language that holds `each` of its rows, but for a chance of less than one in a billion.
    room = each + 7 * each**0.5 + 30
    bounds = {k: min(2**63 - 1, int(room / n * 2**64) - 2**63) for k, n in sizes.items()}
    bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])

    def features(batches):
        for batch in batches:
            rows = [(h.as_py(), k.as_py(), gram_counts(t.as_py())) for h, t, k in zip(batch.column("_h"), batch.column("_text"), batch.column("_lang"), strict=True)]
            at = [np.flatnonzero(c).astype(np.int32) for _, _, c in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                    pa.array([a.tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.int32).tobytes() for a, (_, _, c) in zip(at, rows, strict=True)], pa.binary()),
                ], names=["h", "lang", "at", "n"],
            )

    picked = src.where(F.col("_h") <= F.element_at(bound, F.col("_lang"))).mapInArrow(features, "h long, lang string, at binary, n binary")
    # `each` rows of each language, by hash; tasks pass on no more than that.
    picked = picked.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "at", "n"))).where(F.col("k") <= each)
    learn, held = [], []
    for row in picked.orderBy("h", "lang", "at", "n").collect():
        k = row["k"]
        counts = np.zeros(_N, np.int64)
        counts[np.frombuffer(row["at"], np.int32)] = np.frombuffer(row["n"], np.int32)
        example = (*weights_of(counts, idf), languages.index(row["lang"]))
        (held if k % 5 == 0 else learn).append(example)
    weights = train_ftrl(learn, len(languages))
    scores = np.array([weights[:, at] @ value for at, value, _ in held]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights.astype(np.float32), fit_temperature(scores, np.array([k for _, _, k in held], np.int64)))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """id, the columns of `keep`, lang_pred and score of every row. The model's size is languages x buckets, whatever the table's size."""
    V.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias("_id"), *keep, F.col(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column("_text")]
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([k for k, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{kinds}, lang_pred string, score double").withColumnRenamed("_id", id_col)
