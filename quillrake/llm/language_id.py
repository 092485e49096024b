"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of 1 to 3 letters of the lower-cased whole text, runs of other characters counting as one
space: (1 + ln tf) * idf, scaled to length one. The weights are trained by follow-the-regularised-leader (FTRL-Proximal)
with elastic-net penalties, and the temperature is fitted on a fifth of the sample that training leaves out.

Document frequencies cover all labelled rows. The classifier is fitted on a sample of about ``sample_rows`` labelled rows,
chosen by hash of id, text and label, and twice that many at most, also where rows repeat; that bound is the parameter. On
the driver are the sample's sparse features, one row of counts per feature (2^15) and the weights; no text.

A text that is null or has no letter is ``und`` with score 0; so is every text if nothing is labelled. Null labels are not
learned from. Very long texts count whole, in pieces. Repeated rows count as often as they stand. Extra columns
are not read; ``language_filter`` passes them through.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1 << 15
UND = "und"
_PIECE = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of the n-grams of a whole text; none without a letter."""
    total = None
    low = (text or "").lower()
    for at in range(0, len(low), _PIECE):
        c = np.frombuffer(low[max(0, at - 2) : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[c]
        if not letter.any():
            continue
        c = np.where(letter, c, np.uint32(32))
        keep = letter | np.concatenate([[True], letter[:-1]])
        c = np.concatenate([[np.uint32(32)], c[keep], [np.uint32(32)]]).astype(np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        h = np.concatenate([one, two, three]) >> np.uint32(17)
        count = np.bincount(h, minlength=BINS)
        total = count if total is None else total + count
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bins = np.flatnonzero(total)
    return bins, total[bins]


def tfidf(bins: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[bins]
    norm = np.sqrt(v @ v)
    return v / norm if norm > 0 else v


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BINS + 1, languages); the last row is the bias
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        bins, counts = ngram_counts(text)
        if not len(bins) or not self.languages:
            return UND, 0.0
        logits = (tfidf(bins, counts, self.idf) @ self.weights[bins] + self.weights[-1]) / self.temperature
        p = np.exp(logits - logits.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001, seed: int = 1) -> np.ndarray:
    """Weights by FTRL-Proximal; rows are (bins, values, class)."""
    z, n = np.zeros((BINS + 1, classes)), np.zeros((BINS + 1, classes))

    def weights(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            bins, values, y = rows[r]
            at, x = np.append(bins, BINS), np.append(values, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(u: float) -> float:
        s = logits / np.exp(u)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]))

    lo, hi, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BINS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            bins, _ = ngram_counts(text)
            df[bins] += 1
            n += len(bins) > 0
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, BINS)), pa.array(np.append(df[seen], n))], ["bin", "df"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [ngram_counts(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), pa.array([b.astype("<u2").tobytes() for b, _ in got], pa.binary()), pa.array([np.log1p(c - 1).astype("<f4").tobytes() for _, c in got], pa.binary())], ["key", "lang", "bins", "logs"])


def train_language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 2000) -> LanguageModel:
    """Fit on all rows' document frequencies and a hashed sample of about ``sample_rows`` rows."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.xxhash64(F.col(id_col), F.col(text_col), F.col(lang_col)).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    total = rows.count()
    counts = rows.select("text").mapInArrow(_document_frequency, "bin long, df long").groupBy("bin").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(BINS + 1), 0
    for r in counts:  # one row for each of the 2^15 features at most
        df[r["bin"]] = r["df"]
    n, df = df[BINS], df[:BINS]
    idf = np.log((1 + n) / (1 + df)) + 1
    share = F.pmod(F.col("key"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample_rows / max(1, total)) * (1 << 30)))
    sample = rows.where(share).mapInArrow(_features, "key long, lang string, bins binary, logs binary").orderBy("key").limit(2 * sample_rows).collect()
    sample = sorted((r for r in sample if r["bins"]), key=lambda r: (r["key"], r["lang"], r["bins"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return LanguageModel([], idf, np.zeros((BINS + 1, 0)), 1.0)
    data = []
    for r in sample:
        bins = np.frombuffer(r["bins"], "<u2").astype(np.int64)
        v = (1 + np.frombuffer(r["logs"], "<f4").astype(float)) * idf[bins]
        data.append((bins, v / np.sqrt(v @ v), languages.index(r["lang"])))
    fit, left = [x for i, x in enumerate(data) if i % 5], data[::5]
    if not fit:
        fit = data
    weights = train_ftrl(fit, len(languages))
    logits = np.array([v @ weights[b] + weights[-1] for b, v, _ in left])
    return LanguageModel(languages, idf, weights.astype(np.float32), fit_temperature(logits, np.array([y for *_, y in left])))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            got = [m.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["id", "lang_pred", "score"])

    return run


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 2000) -> DataFrame:
    """Train on the rows that are not held out, predict all: id, held_out, lang_pred, score."""
    model = train_language_model(docs.where(~held_out(id_col)), id_col, text_col, lang_col, sample_rows)
    out = predict_languages(docs, model, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def _filter(model, text_col: str, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            got = [m.predict(t) for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array([lang != UND and score >= min_score for lang, score in got], pa.bool_()))

    return run


def language_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.3, sample_rows: int = 2000) -> DataFrame:
    """The rows whose language is known with ``min_score`` at least, columns unchanged; undetermined texts go."""
    model = train_language_model(docs.where(~held_out(id_col)), id_col, text_col, lang_col, sample_rows)
    return docs.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(model), text_col, min_score), docs.schema)
