"""Text quality by compression against dictionaries of good and bad text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.store import documents, give_back

#: Bounds of the labelled sample: rows of each class, and the largest text that may be one of them.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 65_536
DICTIONARY_BYTES = 65_536
CHUNK_BYTES = 2048
LEVEL = 3
FOLDS = 5
ACCEPT = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries, and a rising curve from the size difference to the score."""

    good: bytes
    bad: bytes
    at: tuple[float, ...]
    value: tuple[float, ...]

    def scorer(self):
        """A function from texts (bytes) to scores; made inside a task."""
        compressors = _compressors(self.good, self.bad)

        def score(texts: Iterable[bytes]) -> np.ndarray:
            x = np.fromiter((difference(t, *compressors) for t in texts), np.float64)
            return np.interp(x, self.at, self.value)

        return score


def _compressors(*dictionaries: bytes) -> list[zstandard.ZstdCompressor]:
    out = []
    for data in dictionaries:
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(size with the bad dictionary - size with the good one) / size, over the whole text in pieces.

    Pieces keep a long text from becoming its own dictionary. 0 for an empty text.
    """
    more = 0
    for at in range(0, len(text), CHUNK_BYTES):
        part = text[at : at + CHUNK_BYTES]
        more += len(bad.compress(part)) - len(good.compress(part))
    return more / len(text) if text else 0.0


def _dictionary(texts: list[bytes]) -> bytes:
    parts = [t[a : a + CHUNK_BYTES] for t in texts for a in range(0, len(t), CHUNK_BYTES)]
    total = sum(map(len, parts))
    if len(parts) >= 16 and total >= 16 * 1024:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), parts, level=LEVEL).as_bytes()
    return b"".join(parts)[-DICTIONARY_BYTES:] or b"\n" * 8  # too little to train on: the text itself


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Points of a never falling curve through the weighted shares of label 1: pooled adjacent violators.

    Each pool's share is drawn to one half by a row of either label, so that no score is quite 0 or 1; the curve is
    straight between the middles of neighbouring pools.
    """
    pools: list[list[float]] = []  # weight, weight of label 1, weighted sum of x
    for i in np.argsort(x, kind="stable"):
        pools.append([weight[i], weight[i] * y[i], weight[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    at = [p[2] / p[0] for p in pools]
    value = [(p[1] + 0.5) / (p[0] + 1) for p in pools]
    return (at, np.maximum.accumulate(value).tolist()) if pools else ([0.0], [0.5])


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS)) == 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on labelled rows outside the held-out fold.

    At most SAMPLE_ROWS labels of each class are chosen by hash of the id; their texts up to SAMPLE_BYTES reach the
    driver (4 * SAMPLE_ROWS at most, should ids repeat).
    Half of them become the two dictionaries, the other half calibrates the score (a rising curve), both
    classes weighing alike: the junk to be found is the rarer one. Rows without id or label take no part. Without any label the score is 0.5.
    Empty and null texts and those beyond SAMPLE_BYTES are never in the sample, though all are scored. Of equal hashes the
    smaller id is picked; a label that is repeated counts once, an id with both labels is in both classes; texts that share
    an id are all taken. Where too little text is left for a dictionary of its own, the text itself is the dictionary.
    """
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and label_id is not null")
    known = known.where(~held_out("label_id")).distinct()
    half = F.pmod(F.xxhash64(F.lit("half"), "label_id"), F.lit(2)).cast("int").alias("half")
    order = F.xxhash64(F.lit("pick"), "label_id")
    picked = [known.where(F.col("label") == label).orderBy(order, "label_id").limit(SAMPLE_ROWS).select("label_id", "label", half) for label in (0, 1)]
    rows = documents(docs, id_col, text_col).where(F.octet_length("text").between(1, SAMPLE_BYTES))
    # At most 2 * SAMPLE_ROWS rows of three numbers: small whatever the labels are.
    sample = rows.join(F.broadcast(picked[0].unionByName(picked[1])), F.col("doc_id") == F.col("label_id"))
    texts = {}
    for row in sorted(sample.select("doc_id", "label", "half", "text").limit(4 * SAMPLE_ROWS).collect()):
        texts.setdefault((row["label"], row["half"]), []).append(row["text"].encode())
    good, bad = (_dictionary(texts.get((label, 0), [])) for label in (1, 0))
    compressors = _compressors(good, bad)
    x, y, weight = [], [], []
    for label in (0, 1):
        own = texts.get((label, 1), [])
        x += [difference(t, *compressors) for t in own]
        y += [label] * len(own)
        weight += [1 / len(own)] * len(own) if own else []
    at, value = calibrate(np.array(x), np.array(y, float), np.array(weight) * len(x) / 2)
    return QualityModel(good, bad, tuple(at), tuple(value))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, accept: float = ACCEPT) -> DataFrame:
    """doc_id, score (0 to 1, higher: better), predicted (1 if score >= accept): whole texts, no exchange.

    `keep` names further columns of `docs` to carry along unchanged, the text too if wanted. Null text counts
    as empty, whose score is that of no difference. Null and repeated ids are rows like any other.
    """

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for texts in parts:
            yield pd.Series(score(t.encode() for t in texts))
        give_back()

    value = scored(F.coalesce(F.col(text_col), F.lit("")))
    if keep is None:
        out = docs.select(F.col(id_col).cast("long").alias("doc_id"), value.alias("score"))
        return out.withColumn("predicted", (F.col("score") >= accept).cast("int"))
    name = "quality_score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.select(*keep, value.alias(name)).where(F.col(name) >= accept).select(*keep)
