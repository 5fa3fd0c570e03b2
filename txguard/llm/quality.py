"""A quality classifier: regularised quadratic discriminant analysis of document statistics.

Each class is a normal distribution over transformed statistics of a text. Its
covariance is shrunk towards the pooled covariance and that towards its own
diagonal. The score is the logistic of the difference of the classes' log
densities, whose Mahalanobis terms come from Cholesky factors made once.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.llm.text import ROW, identified, with_decisions
from txguard.session import reliable

STATISTICS = [
    "words", "word_length", "distinct", "commonest", "adjacent", "upper", "digits", "marks", "odd_marks", "bare",
    "ending", "other", "lines", "repeated_lines",
]
TOWARDS_POOLED = 0.1
TOWARDS_DIAGONAL = 0.05
#: Least variance of a statistic, on the transformed scale.
FLOOR = 1e-3


def _byte_kinds() -> np.ndarray:
    """0 other, 1 upper-case letter, 2 digit, 3 common mark, 4 other mark, 5 white space, of each byte."""
    kinds = np.zeros(256, np.int64)
    for byte in range(33, 127):
        c = chr(byte)
        kinds[byte] = 1 if c.isupper() else 2 if c.isdigit() else 3 if c in ".,;:?'\"()-" else 0 if c.isalpha() else 4
    kinds[[9, 10, 11, 12, 13, 32]] = 5
    return kinds


def _share(part: float, whole: float) -> float:
    """The logit of a share, smoothed by half a case on either side."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: bytes, kinds: np.ndarray) -> list[float]:
    """Transformed statistics of a whole text; an empty one has those of no words."""
    words = text.split()
    n = len(words)
    counts = Counter(words)
    size = len(text)
    kind = np.bincount(kinds[np.frombuffer(text, np.uint8)], minlength=6) if size else np.zeros(6, np.int64)
    letters = size - int(kind[5])
    bare = sum(c for w, c in counts.items() if not w.isalnum() and w.isascii() and not any(map(str.isalnum, w.decode())))
    ending = sum(c for w, c in counts.items() if len(w) > 2 and kinds[w[-1]] >= 3 and kinds[w[-2]] >= 3)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        float(np.log1p(n)),
        float(np.log1p(letters / n if n else 0)),
        _share(len(counts), n),
        _share(max(counts.values(), default=0), n),
        _share(sum(map(operator.eq, words, words[1:])), n),
        _share(int(kind[1]), letters),
        _share(int(kind[2]), letters),
        _share(int(kind[3]), letters),
        _share(int(kind[4]), letters),
        _share(bare, n),
        _share(ending, n),
        _share(int(kind[0]), letters),
        _share(len(lines), n),
        _share(len(lines) - len(set(lines)), len(lines)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(``__row``, ``doc_id`` and one column per statistic) of every row; a null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _byte_kinds()
        for batch in batches:
            found = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"", kinds) for t in batch.column("text")]
            values = np.array(found).reshape(-1, len(STATISTICS))
            fields = [batch.column(ROW), batch.column("doc_id"), *[pa.array(values[:, i]) for i in range(len(STATISTICS))]]
            yield pa.RecordBatch.from_arrays(fields, [ROW, "doc_id", *STATISTICS])

    rows = identified(docs).select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, ", ".join([f"{ROW} long", "doc_id long", *[f"{s} double" for s in STATISTICS]]))


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): mean, inverse Cholesky factor and constant of the log density; or a plain ``prior``."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if self.means is None:
            return np.full(len(values), self.prior)
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            whitened = (values - mean) @ factor.T
            logs.append(constant - 0.5 * (whitened**2).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame, label: str) -> Discriminant:
    """Fit on all rows of ``labelled`` from one aggregated row of sums per class.

    Without rows of both classes, the score is (n1 + 1) / (n0 + n1 + 2) everywhere.
    """
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)]
    products = [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i, j in pairs]
    rows = labelled.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()
    by_class = {row[label]: row for row in rows}
    n = np.array([by_class[c]["n"] if c in by_class else 0 for c in (0, 1)], float)
    if n.min() == 0:
        return Discriminant((n[1] + 1) / (n.sum() + 2))
    means, covariances = [], []
    for c in (0, 1):
        row = by_class[c]
        mean = np.array([row[f"s{i}"] for i in range(d)]) / n[c]
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = row[f"p{i}_{j}"]
        means.append(mean)
        covariances.append(second / n[c] - np.outer(mean, mean))
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()
    factors, constants = [], []
    for c in (0, 1):
        own = TOWARDS_POOLED + (1 - TOWARDS_POOLED) * d / (d + n[c])
        shrunk = (1 - own) * covariances[c] + own * pooled
        shrunk = (1 - TOWARDS_DIAGONAL) * shrunk + TOWARDS_DIAGONAL * np.diag(np.diag(shrunk))
        lower = np.linalg.cholesky(shrunk + FLOOR * np.eye(d))
        factors.append(np.linalg.inv(lower))
        constants.append(np.log((n[c] + 1) / (n.sum() + 2)) - np.log(np.diag(lower)).sum())
    return Discriminant((n[1] + 1) / (n.sum() + 2), np.array(means), np.array(factors), np.array(constants))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(``__row``, ``doc_id``, ``held_out``, ``score``, ``predicted``) for every row of ``docs``.

    ``labels`` (doc_id, quality) is learnt from where crc32(doc_id as text) mod 3
    is not 1; labels of null, or other than 0 and 1, teach nothing, repeated ones
    count each. A null ``doc_id`` has no label and is not held out.
    """
    found = reliable(document_statistics(docs))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    teachers = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("__quality"))
    taught = teachers.where("__quality in (0, 1) and doc_id is not null").where(~out)
    model = fit(found.join(taught, "doc_id"), "__quality")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = model.score(batch[STATISTICS].to_numpy())
            yield batch[[ROW, "doc_id", "score"]].astype({"doc_id": "Int64"})

    rows = found.mapInPandas(score, f"{ROW} long, doc_id long, score double")
    return rows.select(ROW, "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted as of good quality, with the columns of ``docs``."""
    kept = reliable(scored(docs, labels).where("predicted = 1").select(ROW))
    return with_decisions(identified(docs), kept, [ROW]).select(*docs.columns)
