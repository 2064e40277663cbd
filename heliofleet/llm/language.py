"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of one to three signs over the whole text, weighted
(1 + log tf) * idf and scaled to length 1. Document frequencies are counted over all documents that
may be learned from, per task in one array of FEATURES entries. The weights are learned on a
bounded sample: the SAMPLE_PER_CLASS documents of each class with the smallest hash of their id,
whole texts. Follow-the-regularised-leader with L1 and L2 penalties runs over it EPOCHS times in
one task, whose input is bounded by that parameter; every fifth sample document is left out and
fits the temperature that calibrates the scores. Scoring is a map over the whole table.

Nulls, ties and repeats: a null text, or a text without a letter, is ``und`` with score 0, as is
every text when nothing can be learned. Of equal scores the first label in sorted order is
taken. Repeated rows are scored one by one. A null doc_id is no training document and not held
out. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import bounded_batches, table

FEATURES = 1 << 15
SAMPLE_PER_CLASS = 600
EPOCHS = 3
FOLDS = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: A text is worked on in parts of so many signs; parts overlap by what an n-gram needs.
PART = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
#: Odd multipliers of the n-gram hash.
MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and how often each occurs."""
    total = np.zeros(FEATURES, np.int64)
    low = text.lower()
    for at in range(0, len(low), PART):
        code = np.frombuffer(low[max(0, at - 2):at + PART].encode("utf-32-le", "surrogatepass"), "<u4")
        skip = min(at, 2)
        shift = np.uint32(17)  # 32 bits down to 15
        h = code * MIX[0]
        total += np.bincount(h[skip:] >> shift, minlength=FEATURES)
        for n in (1, 2):
            if len(code) <= n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * MIX[n] + code[n:] * MIX[0]
            total += np.bincount(h[max(0, skip - n):] >> shift, minlength=FEATURES)
    found = np.flatnonzero(total)
    return found, total[found]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, times = gram_counts(text)
    weight = (1 + np.log(times)) * idf[found]
    return found, weight / max(np.sqrt(weight @ weight), 1e-12)


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES x labels
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or text is None or not LETTER.search(text):
            return "und", 0.0
        found, value = vector(text, self.idf)
        p = softmax(value @ self.weights[found] / self.temperature)
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Per-coordinate FTRL-proximal; ``rows`` are (features, values, class)."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
    for _ in range(epochs):
        for found, value, label in rows:
            zs, ns = z[found], n[found]
            w = weights(zs, ns)
            error = softmax(value @ w)
            error[label] -= 1
            g = value[:, None] * error
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[found] = zs + g - sigma * w
            n[found] = ns + g * g
    return weights(z, n)


def temperature(rows: list, weights: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm.

    Of n rows, 1 in n + 2 counts as spread over the other labels, so that separable classes
    don't make the scores certain.
    """
    if not rows:
        return 1.0
    z = np.array([value @ weights[found] for found, value, _ in rows])
    y = np.array([label for _, _, label in rows])
    doubt, others = 1 / (len(y) + 2), max(1, z.shape[1] - 1)

    def loss(t):
        p = np.log(softmax(z / np.exp(t)) + 1e-12)
        right = p[np.arange(len(y)), y]
        return -((1 - doubt) * right + doubt * (p.sum(axis=1) - right) / others).mean()
    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts."""
    def count(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                total[gram_counts(t.as_py())[0]] += 1
                n += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found.tolist()], pa.int32()),
                                          pa.array([n, *total[found].tolist()], pa.int64())], names=["feature", "n"])
    rows = docs.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(
        F.sum("n").alias("n")).collect()  # FEATURES + 1 rows at most
    out = np.zeros(FEATURES, np.int64)
    docs_ = 0
    for r in rows:
        if r.feature < 0:
            docs_ = r.n
        else:
            out[r.feature] = r.n
    return out, docs_


def fit_language(docs: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> LanguageModel:
    """Learn from all rows of ``docs`` (doc_id, text, lang); leave out what must not be learned."""
    bounded_batches(docs.sparkSession)
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    key = F.xxhash64("doc_id", F.lit(7))
    chosen = docs.select("doc_id", "lang", key.alias("key")).withColumn(
        "at", F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))).where(
        F.col("at") <= per_class)
    sample = docs.join(chosen.select("doc_id", "at").distinct(), "doc_id")  # at most per_class texts of each label

    def vectors(batches):
        for batch in batches:
            found, values = [], []
            for t in batch.column(1).to_pylist():
                f, v = vector(t, idf)
                found.append(f.astype("<i4").tobytes())
                values.append(v.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()),
                                              pa.array(values, pa.binary()), batch.column(2), batch.column(3)],
                                             names=["key", "found", "value", "lang", "at"])
    kind = "key long, found binary, value binary, lang string, at int"
    rows = sample.select(key.alias("key"), "text", "lang", "at").mapInArrow(vectors, kind)

    def train(table_: pa.Table) -> pa.Table:
        data = sorted(zip(*(table_.column(c).to_pylist() for c in ("key", "lang", "at", "found", "value"))),
                      key=lambda r: (r[0], r[1]))
        labels = sorted({r[1] for r in data})
        full = [(np.frombuffer(f, "<i4"), np.frombuffer(v, "<f8"), labels.index(lang), at) for _, lang, at, f, v in data]
        fit, check = [r[:3] for r in full if r[3] % 5], [r[:3] for r in full if r[3] % 5 == 0]
        w = ftrl(fit or check, len(labels))
        return pa.table({"labels": pa.array([labels], pa.list_(pa.string())),
                         "weights": pa.array([w.astype("<f8").tobytes()], pa.binary()),
                         "temperature": pa.array([temperature(check, w)], pa.float64())})
    got = rows.groupBy(F.lit(0).alias("one")).applyInArrow(
        lambda t: train(t), "labels array<string>, weights binary, temperature double").collect()
    if not got:
        return LanguageModel([], idf, np.zeros((FEATURES, 0)), 1.0)
    m = got[0]
    weights = np.frombuffer(bytes(m.weights), "<f8").reshape(FEATURES, len(m.labels))
    return LanguageModel(list(m.labels), idf, weights, m.temperature)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of ``docs`` with lang_pred and score; only the text is looked at.

    Columns of ``docs`` with these two names give way to the result.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rest = {c: f"c{i}" for i, c in enumerate(kept) if c != "text"}
    others = F.struct(F.lit(0).alias("none"), *(F.col(c).alias(x) for c, x in rest.items()))
    kind = docs.select(others.alias("r")).schema["r"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x (labels + 1) numbers

    def run(batches):
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], names=["text", "_rest", "lang_pred", "score"])
    out = docs.select("text", others.alias("_rest")).mapInArrow(
        run, f"text string, _rest {kind}, lang_pred string, score double")
    return out.select(*(F.col("text") if c == "text" else F.col("_rest")[rest[c]].alias(c) for c in kept),
                      "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs.where(fold() != 0))
    return predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
