import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstat.llm.batches import slices
from rillstat.llm.hashing import shingles, span_hashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.none() | st.text(alphabet="ab AB\n\t é ", max_size=40), max_size=12)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_shingles_are_those_of_a_plain_scan(texts):
    hashes, bounds = word_hashes(pa.array(texts, pa.string()))
    values, edges = shingles(hashes, bounds)
    seen = {}
    for i, text in enumerate(texts):
        found = WORD.findall(lowered(text))
        assert bounds[i + 1] - bounds[i] == len(found)
        for word, value in zip(found, hashes[bounds[i]:bounds[i + 1]], strict=True):
            assert seen.setdefault(word, value) == value
        sets = {tuple(found[j:j + 5]) for j in range(len(found) - 4)} if len(found) >= 5 else {tuple(found)} if found else set()
        assert edges[i + 1] - edges[i] == len(sets)
        assert (np.diff(values[edges[i]:edges[i + 1]].astype(object)) > 0).all()
    assert len(set(seen.values())) == len(seen)


def test_long_words_and_words_over_block_borders():
    texts = ["x" * 200_000 + " tail", "y" * 32_760 + " border words here", "x" * 200_000, "tail border"]
    hashes, bounds = word_hashes(pa.array(texts))
    assert np.diff(bounds).tolist() == [2, 4, 1, 2]
    assert hashes[0] == hashes[6] and hashes[1] == hashes[7] and hashes[3] == hashes[8]


def test_span_hashes_differ_by_length():
    data = np.zeros(10, dtype=np.uint8)
    assert len(set(span_hashes(data, np.zeros(9, dtype=np.int64), np.arange(1, 10)).tolist())) == 9


def test_slices_keep_all_rows_and_their_size():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 3, 30, 0, 2)] + [None])], names=["text"])
    parts = list(slices(batch, ["text"], 10))
    assert [x for part in parts for x in part.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert [part.num_rows for part in parts] == [2, 1, 3]
