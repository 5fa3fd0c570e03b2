"""Fixtures with odd rows, imported by the test modules of this folder."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

cloudpickle.register_pickle_by_value(corpus_pipeline)

LONG = " ".join(f"w{i * 7919 % 30011}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "", "en", "a", 0),
    (2, None, "en", "a", None),
    (3, "One", None, None, 3),
    (3, "One", None, None, 3),
    (None, "no id here, but some words that are quite ordinary", "en", "b", 10),
    (None, None, None, None, None),
    (4, "  \t\n\x0b\x0c\r ", "en", "b", 8),
    (5, LONG, "en", "c", len(LONG)),
    (6, LONG, "en", "c", len(LONG)),
    (7, "é 漢字 \U0001f600 <|endoftext|> \x1c\x1f   x", "fr", "ä", 20),
    (3, "another text of the same id", "en", "a", 27),
]
CLASHING = ["score", "size", "target", "copies", "component_id", "fp", "anchor", "start", "first", "words", "places", "grams", "__row", "quality"]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, null, empty and very long texts, and columns named like those of the operators."""
    rows = spark.createDataFrame(ODD, DOCS)
    from pyspark.sql import functions as F

    return rows.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def folder(spark, odd, tmp_path_factory):
    """The odd rows as given tables."""
    place = tmp_path_factory.mktemp("odd")
    odd.drop("__row").write.parquet(f"{place}/documents.parquet")
    labels = [(1, 0, 0), (3, 1, 0), (4, None, 1), (5, 1, None), (5, 1, 0), (None, 1, 1), (6, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return str(place)


@pytest.fixture(scope="session")
def empty_folder(spark, none, tmp_path_factory):
    place = tmp_path_factory.mktemp("empty")
    none.write.parquet(f"{place}/documents.parquet")
    kinds = {
        "labels": "doc_id long, quality int, toxic int",
        "pages": "page_id long, url string, html string",
        "embeddings": "vec_id long, embedding array<float>, label int",
        "conversations": "conv_id long, turn long, role string, text string",
    }
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{place}/{name}.parquet")
    return str(place)
