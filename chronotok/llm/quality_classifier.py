"""Quality classifier (operator 4): two zstandard dictionaries and a calibrated difference of compressed sizes.

One dictionary is built from texts labelled good, one from texts labelled bad. A text is compressed with each; the
difference of the two sizes over the text's bytes, for the whole text and for its most bad-like ``CHUNK`` bytes, is
turned into a probability by a logistic fit on labelled texts that the dictionaries have not seen.

The fit uses a bounded sample: at most ``per_class`` documents of each label, those with the smallest hash of the
id, and of these as many whole texts in the order of another hash as reach ``FIT_BYTES``, half for the dictionaries and
half for the calibration; one task fits the model. Scoring reads every whole text in one pass; the model
(two dictionaries of at most ``DICT_BYTES`` and three numbers) is what the tasks receive.

Defined results: a null or empty text scores as one whose sizes do not differ; a document with several labels
counts with the least; null labels and null ids are not learned from; without labels of both kinds the score is the
share of good labels (one half if there are none); repeated rows are scored one by one; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from chronotok.llm.text import id_crc_mod, table

PER_CLASS = 4000
FIT_BYTES = 64_000_000
DICT_BYTES = 100_000
LEVEL = 3
CHUNK = 2048
SAMPLE_BYTES = 16_384
THRESHOLD = 0.3
HOLD_OUT = 5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]
    constant: float | None = None


def _dictionary(texts: list[bytes]) -> bytes:
    parts = [t[i:i + SAMPLE_BYTES] for t in texts for i in range(0, len(t), SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve
        return b"".join(parts)[-DICT_BYTES:]


class _Sizes:
    def __init__(self, good: bytes, bad: bytes) -> None:
        self.by = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                    write_dict_id=False).compress)

    def features(self, text: str | None) -> tuple[float, float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 0.0
        good, bad = self.by
        part = lambda t: (len(bad(t)) - len(good(t))) / len(t)
        whole = part(raw)
        if len(raw) <= CHUNK:
            return whole, whole
        return whole, min(part(raw[i:i + CHUNK]) for i in range(0, len(raw), CHUNK))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """Weights of a ridge-regularised logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> Model:
    """Model of labelled documents; ``labels`` should hold only rows that may be learned from."""
    marks = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).dropna()
             .groupBy("id").agg(F.min("y").alias("y")))
    sample = None
    for y in (0, 1):
        some = marks.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        sample = some if sample is None else sample.unionByName(some)
    # The sample has at most 2 * per_class ids, so it is small enough to broadcast, and its texts to fit in one task.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = (texts.join(F.broadcast(sample), "id").repartition(1)
            .sortWithinPartitions(F.xxhash64("id", F.lit(1)), "id", "text").select("text", F.col("y").cast("int").alias("y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, held = [], 0
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                if held < FIT_BYTES:  # the rest is passed over, one row at a time
                    taken.append((t.as_py() or "", y))
                    held += len(taken[-1][0].encode("utf-8", "surrogatepass"))
        m = _learn(taken)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.good], pa.binary()), pa.array([m.bad], pa.binary()), pa.array([list(m.weights)]),
             pa.array([m.constant], pa.float64())], ["good", "bad", "weights", "constant"])

    found = rows.mapInArrow(run, "good binary, bad binary, weights array<double>, constant double").collect()
    if not found:
        return Model(b"", b"", (0.0, 0.0, 0.0), 0.5)
    m = found[0]
    return Model(bytes(m.good), bytes(m.bad), tuple(m.weights), m.constant)


def _learn(rows: list[tuple[str, int]]) -> Model:
    by = {y: [t.encode("utf-8", "surrogatepass") for t, k in rows if k == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return Model(b"", b"", (0.0, 0.0, 0.0), len(by[1]) / len(rows) if rows else 0.5)
    half = {y: max(1, len(t) // 2) for y, t in by.items()}
    good, bad = (_dictionary(by[y][:half[y]]) for y in (1, 0))
    sizes = _Sizes(good, bad)
    held = [(t, y) for y in (0, 1) for t in (by[y][half[y]:] or by[y])]
    x = np.array([sizes.features(t.decode("utf-8", "surrogatepass")) for t, _ in held])
    return Model(good, bad, _logistic(x, np.array([y for _, y in held], float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (probability that the label is 1) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = None if model.constant is not None else _Sizes(model.good, model.bad)
        for b in batches:
            if sizes is None:
                p = np.full(b.num_rows, model.constant)
            else:
                x = np.array([sizes.features(t.as_py()) for t in b.column(1)]).reshape(-1, 2)
                z = model.weights[0] + x @ np.array(model.weights[1:])
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(id_crc_mod(F.col("doc_id"), HOLD_OUT) != 0)
    return score(docs, fit(docs, labels)).select(
        "doc_id", (id_crc_mod(F.col("doc_id"), HOLD_OUT) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
