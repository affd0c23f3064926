"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Grades are ordered: 0 clean, 1 toxic, 2 and above worse. Labels with a column ``severity`` give them; where labels tell only toxic
from clean, toxic rows that hold more distinct features of toxic rows than their median are of grade 2 (``graded``). One weight
vector w is shared by all thresholds b1 < b2 < ...: P(grade >= k) = sigmoid(w.x - b_k). Expected severity is the sum of those probabilities.
Features are presences of words (A-Z lowered, ASCII punctuation dropped) and of their first STEMS bytes, which catch
inflected forms, hashed to 2**BITS slots. The fit keeps features of LEAST_DF samples or more whose share of toxic
samples differs from that of all by LEAST_Z standard deviations.

The fit uses at most ``sample`` labelled rows, the first by a hash of their id (the documented bound of the
fitting sample); all documents are scored over their whole texts.

Defined cases: text null or without words: no features, the prior's severity; no labelled rows: severity and
probability 0; a label without a document is ignored; of several labels of an id the worst counts; rows that repeat an id are scored alike, and
in the fit the first by hash counts; texts of any length are scored whole; extra columns, of any name, are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm.common import IS_SPACE, LOWER, byte_view, filled, materialize, prefix_hash, row_slices, span_hashes, tidy, word_spans

BITS, STEMS, LEAST_DF, LEAST_Z = 22, (4, 5, 6), 4, 5.0
SAMPLE = 12_000
#: Bytes that count as white space here: ASCII that is neither a letter nor a digit.
_PLAIN = LOWER.copy()
for _c in range(128):
    if not chr(_c).isalnum() and not IS_SPACE[_c]:
        _PLAIN[_c] = 32


def features(data: np.ndarray, offs: np.ndarray, weights: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The distinct features of each row; with weights only those of a weight other than 0."""
    d = _PLAIN[data]
    s, e, first = word_spans(d, offs)
    h = prefix_hash(d)
    cols = [span_hashes(h, s, e)] + [span_hashes(h, s, np.minimum(s + k, e)) for k in STEMS]
    slots = np.stack([((c + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32) for i, c in enumerate(cols)], axis=1).ravel()
    first = first * len(cols)
    if weights is not None:
        at = np.flatnonzero(weights[slots])
        slots, first = slots[at], np.searchsorted(at, first)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(slots[a:b])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _tells(df: np.ndarray, hit: np.ndarray, q: float) -> np.ndarray:
    """Which features of df samples, hit of them toxic, have another share of toxic samples than q, that of all."""
    return (df >= LEAST_DF) & (np.abs(hit - q * df) >= LEAST_Z * np.sqrt(df * q * (1 - q)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grade, slots) of samples -> (slot, samples, toxic samples), summed by batch."""
    for batch in batches:
        rows = [np.frombuffer(x, np.int32) for x in batch.column("slots").to_pylist()]
        if not rows:
            continue
        slots, at = np.unique(np.concatenate(rows), return_inverse=True)
        toxic = np.repeat(batch.column("grade").to_numpy() > 0, [len(r) for r in rows])
        df, hit = np.bincount(at, minlength=len(slots)), np.bincount(at[toxic], minlength=len(slots))
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(df), pa.array(hit)], ["slot", "df", "hit"])


def telling(samples: DataFrame, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Features of (grade, slots) that tell toxic samples, of whom all hold a share of q, from clean ones, and which of them mark toxic ones.

    Counted by the tasks: only the telling ones, of 1 << BITS at most, reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, df, hit = (batch.column(i).to_numpy() for i in range(3))
            on = np.flatnonzero(_tells(df, hit, q))
            yield pa.RecordBatch.from_arrays([pa.array(slot[on]), pa.array(hit[on] > q * df[on])], ["slot", "marks"])

    counts = samples.select("grade", "slots").mapInArrow(tidy(_counted), "slot int, df long, hit long").groupBy("slot").agg(F.sum("df").alias("df"), F.sum("hit").alias("hit"))
    got = counts.mapInArrow(tidy(run), "slot int, marks boolean").toArrow()
    slots, marks = got.column("slot").to_numpy(), got.column("marks").to_numpy()
    order = np.argsort(slots)
    return slots[order], marks[order]


def graded(rows: list[np.ndarray], toxic: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Grades of samples that are only known to be toxic or not: by how many marks of toxic rows they hold."""
    n = np.array([marks[r].sum() for r in rows])
    return np.where(toxic > 0, 1 + (n > np.median(n[toxic > 0])), 0) if (toxic > 0).any() else toxic


def fit(rows: list[np.ndarray], grade: np.ndarray, grades: int, features: int, l2: float = 3e-4, steps: int = 200, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-gradient Adam on the ordinal log-likelihood; rows: numbers below features of each sample."""
    n = len(rows)
    flat = np.concatenate(rows) if n else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    size = max(1, features)
    w = np.zeros(size)
    share = np.array([(grade >= k).mean() for k in range(1, grades)]).clip(1e-4, 1 - 1e-4)
    b = np.log((1 - share) / share)
    m1, v1, m2, v2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        z = np.bincount(doc, weights=w[flat], minlength=n)
        # P(grade >= k); the likelihood of a grade is the difference of neighbours
        p = np.concatenate([np.ones((n, 1)), _sigmoid(z[:, None] - b[None, :]), np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        like = np.maximum(p[i, grade] - p[i, grade + 1], 1e-9)
        slope = p * (1 - p)
        up, down = slope[i, grade] / like, slope[i, grade + 1] / like
        gz = -(up - down) / n
        gw = np.bincount(flat, weights=gz[doc], minlength=size) + l2 * w
        gb = np.array([((grade == k) * up - (grade == k - 1) * down).sum() / n for k in range(1, grades)])
        for x, g, m, v in ((w, gw, m1, v1), (b, gb, m2, v2)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b[:] = np.maximum.accumulate(b)
    return w[:features].astype(np.float32), b


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Telling features, their weights, and thresholds, from at most ``sample`` labelled documents."""
    told = "severity" if "severity" in labels.columns else "toxic"
    some = labels.where(F.col("doc_id").isNotNull() & F.col(told).isNotNull()).groupBy("doc_id").agg(F.max(told).cast("int").alias("grade"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in row_slices(texts):
                rows = [r.tobytes() for r in features(*byte_view(texts.slice(lo, hi - lo)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(2)), pa.array(rows, pa.binary())], ["doc_id", "grade", "slots"])

    # rows that repeat an id make one sample: ``sample`` of them at most
    own = src.join(F.broadcast(some), "doc_id").groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    own = materialize(spark, own.mapInArrow(tidy(run), "doc_id long, grade int, slots binary"), "toxicity-samples")
    n, toxic = own.agg(F.count("*"), F.count_if(F.col("grade") > 0)).first()
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0)
    slots, marks = telling(own, float(np.clip(toxic / n, 1e-4, 1 - 1e-4)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each sample only the telling features, by their numbers."""
        place = np.full(1 << BITS, -1, np.int32)
        place[slots] = np.arange(len(slots))
        for batch in batches:
            at = (place[np.frombuffer(x, np.int32)] for x in batch.column("slots").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([r[r >= 0].tobytes() for r in at], pa.binary())], ["doc_id", "grade", "at"])

    got = own.mapInArrow(tidy(pick), "doc_id long, grade int, at binary").toArrow().sort_by("doc_id")
    grade = np.maximum(np.array(got.column("grade").to_pylist(), int), 0)
    rows = [np.frombuffer(x, np.int32) for x in got.column("at").to_pylist()]
    if told == "toxic":
        grade = graded(rows, grade, marks)
    return slots, *fit(rows, grade, max(2, int(grade.max()) + 1), len(slots))


def severity(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, severity, p_toxic, toxic_pred, grade_pred) for every row of docs."""
    slots, weights, b = train(spark, docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS, np.float32)
        w[slots] = weights
        for batch in batches:
            texts = filled(batch.column(1))
            z = []
            for lo, hi in row_slices(texts):
                z += [float(w[r].sum(dtype=np.float64)) for r in features(*byte_view(texts.slice(lo, hi - lo)), w)]
            p = _sigmoid(np.array(z)[:, None] - b[None, :])
            first = p[:, 0] if len(b) else np.zeros(len(z))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(first), pa.array(first >= 0.5), pa.array((p >= 0.5).sum(axis=1).astype(np.int32))], ["doc_id", "severity", "p_toxic", "toxic_pred", "grade_pred"])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return src.mapInArrow(tidy(run), "doc_id long, severity double, p_toxic double, toxic_pred boolean, grade_pred int")
