"""Small tables of documents for the tests."""

from __future__ import annotations

import random

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def documents(spark, texts, ids=None):
    """A table of documents with the given texts; ids count from 0."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, text, "en", "src0", None if text is None else len(text)) for i, text in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def sentence(random_: random.Random, count: int, vocabulary: int = 2000) -> str:
    return " ".join(f"w{random_.randrange(vocabulary)}" for _ in range(count))
