"""Quality score by compression: which of two dictionaries, built from good or bad text, shortens a text more.

Zstandard dictionaries are built from texts labelled 1 and from texts labelled 0. A text is compressed with either; the
difference of the sizes, over their sum, is the raw score. A logistic curve fitted on labelled texts that are not
in the dictionaries turns it, with the normalised sizes themselves, into a probability.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from floodlens.llm.common import map_texts, texts

LEVEL = 6
#: Texts are compressed in stretches of this many bytes, so that a long text cannot serve as its own dictionary.
STRETCH = 2048


def _compressor(dictionary: bytes | None):
    kind = None if dictionary is None else zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    options = {} if kind is None else {"dict_data": kind}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **options)


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    center: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tools"}

    def measures(self, text: str) -> list[float]:
        """Normalised sizes of a text: the difference of the dictionaries and what it depends on.

        (bad - good) / (bad + good), size without dictionary and with either over the length, the logarithm of the
        length and products of these. All 0 for the empty text.
        """
        if "tools" not in self.__dict__:
            self.tools = [_compressor(self.good), _compressor(self.bad), _compressor(None)]
        data = text.encode()
        if not data:
            return [0.0] * 8
        parts = [data[i:i + STRETCH] for i in range(0, len(data), STRETCH)]
        good, bad, plain = (sum(len(tool.compress(p)) for p in parts) for tool in self.tools)
        difference, own, size = (bad - good) / (bad + good), plain / len(data), float(np.log1p(len(data)))
        return [difference, size, difference * size, own, own * own, own * size, good / len(data), bad / len(data)]

    def score(self, several: list[str]) -> np.ndarray:
        x = (np.array([self.measures(t) for t in several]) - self.center) / self.spread
        return logistic(with_one(x) @ np.array(self.weights))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton steps on the penalised log-likelihood; classes weigh as they occur."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(several: list[str], size: int, share: int = 512) -> bytes:
    """A raw-content dictionary of ``size`` bytes at most: the middles of texts, ``share`` bytes of each."""
    out = bytearray()
    for text in several:
        data = text.encode()
        begin = max(0, (len(data) - share) // 2)
        out += data[begin:begin + share]
        if len(out) >= size:
            break
    return bytes(out[:size])


def fit(good: list[str], bad: list[str], size: int = 1 << 17) -> CompressionModel:
    """Every other text of a class goes into its dictionary, the rest calibrates.

    With one class only, every score is that class's; with none, every score is 0.5.
    """
    model = CompressionModel(dictionary(good[::2], size), dictionary(bad[::2], size))
    rest = good[1::2] + bad[1::2]
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    if 0 < y.sum() < len(y):
        x = np.array([model.measures(t) for t in rest])
        model.center, model.spread = x.mean(axis=0).tolist(), np.maximum(x.std(axis=0), 1e-9).tolist()
        model.weights = fit_logistic(with_one((x - model.center) / model.spread), y).tolist()
    else:
        model.center, model.spread = [0.0] * 8, [1.0] * 8
        model.weights = [4.0 * bool(good) - 4.0 * bool(bad)] + [0.0] * 8
    return model


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string")) % 5 == 0


def fit_on_table(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, text_chars: int = 8_000) -> CompressionModel:
    """Fit on a sample of labelled documents outside the held-out fold: about ``sample_rows`` of each class, less than
    twice as many.

    Rows are chosen by a hash of their id, so nothing is sorted. Of a training text at most ``text_chars`` are read, which
    bounds what reaches the driver; scoring reads whole texts. Null labels, ids and texts are not learnt from, nor are
    documents with both labels.
    """
    known = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
             .where("quality = most").select("doc_id", "quality"))
    steps = {r["quality"]: max(1, r["count"] // sample_rows) for r in known.groupBy("quality").count().collect()}
    step = F.when(F.col("quality") == 1, steps.get(1, 1)).otherwise(steps.get(0, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), step) == 0)
    rows = (docs.where("text IS NOT NULL").select("doc_id", F.substring("text", 1, text_chars).alias("text"))
            .join(F.broadcast(chosen), "doc_id").collect())  # a bounded number of ids: texts are not shuffled
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    by = {q: [r["text"] for r in rows if r["quality"] == q] for q in (0, 1)}
    return fit(by[1], by[0])


def compression_quality(docs: DataFrame, model: CompressionModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; null and empty texts get the score of the empty text.

    A null id is in no fold (held_out null). Repeated rows score alike; other columns are not read.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # two dictionaries of fixed size

    def make():
        own = pickle.loads(frozen.value)

        def work(batch):
            return [batch.column(0), own.score(texts(batch)).tolist()]

        return work

    scored = map_texts(docs, ["doc_id", "text"], make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
