"""Quality classifier by compression: a zstandard dictionary from good and one from bad labelled text.

Every text is cut into segments of SEGMENT bytes, all of them are compressed with either dictionary, and the difference of
the two totals, divided by the text's size and by the totals' sum (both shrunk towards 0 for tiny texts), goes through a
logistic and an isotonic calibration to a score between 0 and 1. The calibration is fitted on out-of-fold differences: dictionaries of the other
folds score each labelled text. Labels are used only from rows whose crc32(doc_id as text) mod 5 is not 0, at most
TRAIN_ROWS of each class (those of the smallest hash of doc_id); scoring reads nothing but the text.

Defined cases: null and empty texts get the score of an empty text; without labels of both classes every score is the smoothed
base rate; several labels of one doc_id all count; rows with a null doc_id are scored and are not held out; a text's
score doesn't depend on other rows. Columns named score, predicted or held_out are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, over_batches, replaced, stage
from .models import Isotonic, Logistic

#: The bound of the training sample: rows of each class, whose whole texts are read.
TRAIN_ROWS = 2500
SEGMENT, DICT_BYTES, LEVEL, FOLDS = 1024, 112 << 10, 3, 4
THRESHOLD = 0.3


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, y, weight of at most `rows` labelled rows of each class, none of them held out.

    The ids are a bounded sample (2 x rows) and are broadcast; the texts are read where they are. A row's weight is the number of
    labelled rows of its class that it stands for, so that the classes keep their true shares."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = known.limit(0).withColumn("weight", F.lit(1.0))
    for y, n in sorted(counts.items()):
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = picked.unionByName(some.withColumn("weight", F.lit(max(1.0, n / rows))))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


class Coder:
    """Compressed sizes of whole texts under the two dictionaries (an empty dictionary: none)."""

    def __init__(self, dicts: tuple[bytes, bytes]):
        self.dicts, self.made = dicts, None

    def __reduce__(self):
        return Coder, (self.dicts,)

    def features(self, data: bytes) -> tuple[float, float]:
        if self.made is None:
            self.made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_checksum=False, write_content_size=False, write_dict_id=False) for d in self.dicts]
        bad = good = 0
        for i in range(0, max(1, len(data)), SEGMENT):
            piece = data[i : i + SEGMENT]
            bad += len(self.made[0].compress(piece))
            good += len(self.made[1].compress(piece))
        return (bad - good) / (len(data) + 200), (bad - good) / (bad + good + 60)


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary from all segments of the texts, or without enough of them their plain bytes."""
    pieces = [t[i : i + SEGMENT] for t in texts for i in range(0, len(t), SEGMENT)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, k=128, d=8, f=20, accel=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICT_BYTES]


class QualityModel:
    """Fitted dictionaries and calibration; small and picklable."""

    def __init__(self, coder: Coder, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.coder, self.weigh = coder, Logistic(x, y, weight)
        self.calibrate = Isotonic(self.weigh.predict(x), y, weight)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Isotonic over logistic; a hundredth of the latter keeps apart what the steps make equal."""
        p = self.weigh.predict(np.array([self.coder.features(t) for t in texts], float).reshape(-1, 2))
        return 0.99 * self.calibrate.predict(p) + 0.01 * p


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    sample = stage(labelled(docs, labels, "quality", rows).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "quality-train")

    #: Whole texts of at most 2 x `rows` rows, in an order of their own.
    got = sample.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), "y", "fold").orderBy(F.xxhash64("text"), "text", "y").toArrow()
    whole = list(zip(*(got.column(k).to_pylist() for k in ("text", "y", "fold")), strict=True))
    parts = [[(t, fold) for t, label, fold in whole if label == y] for y in (0, 1)]
    if not all(parts):
        ys = np.array([r["y"] for r in sample.select("y").collect()], float)
        return QualityModel(Coder((b"", b"")), np.zeros((len(ys), 2)), ys, np.ones(len(ys)))
    coders = [Coder(tuple(dictionary([p for p, f in part if f != fold]) for part in parts)) for fold in range(FOLDS)]

    def differences(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [coders[f].features(t) for t, f in zip(binary(batch.column("text")), batch.column("fold").to_pylist(), strict=True)]
        x = np.array(rows, float).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("y"), batch.column("weight")], names=["a", "b", "y", "weight"])

    got = np.array(sorted(map(tuple, over_batches(sample, differences, "a double, b double, y int, weight double").collect())), float)  # four numbers of each labelled row
    return QualityModel(Coder(tuple(dictionary([p for p, _ in part]) for part in parts)), got[:, :2], got[:, 2], got[:, 3])


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted."""
    schema = replaced(docs, score=T.DoubleType())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = pa.array(model.score(binary(batch.column("text"))), pa.float64())
        return pa.RecordBatch.from_arrays([score if n == "score" else batch.column(n) for n in schema.names], names=schema.names)

    scored = over_batches(docs.select(*(f"`{n}`" for n in schema.names if n != "score")), run, schema)
    return scored.withColumn("held_out", is_held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
