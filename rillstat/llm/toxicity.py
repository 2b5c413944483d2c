"""Toxicity by compression distance: windows of text under a toxic and an ordinary zstandard dictionary.

Words are chosen by compressed lengths. A word of one half of the toxic texts is kept if the
other half's text shortens it more than ordinary text does, and as long as it does so once
ordinary words that the kept ones shorten have been added to the ordinary dictionary. The toxic dictionary is the ordinary one with the kept words behind it, so a window's two
compressed lengths differ by the toxic matches alone. A document is scored from its
windows' differences by a logistic function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstat.llm.batches import map_slices, text_slices
from rillstat.llm.hashing import LOWER, SPACE, utf8, words
from rillstat.llm.labels import class_weights, fold, labelled_sample, logistic, sigmoid

#: Bytes of text in a window; words stay whole.
WINDOW = 16

#: Follows each window. zstandard starts no match in the last bytes of a block.
_PAD = np.full(32, 10, dtype=np.uint8)

#: Windows that the ordinary dictionary is trained on, about, and bytes of ordinary text that toxic words are held against.
TRAINED_WINDOWS = 60_000
REFERENCE = 8 << 20

#: Rounds in which ordinary words are added and toxic ones judged again, and bytes that a kept word must save.
ROUNDS = 3
GAIN = 2

#: A kept word that ordinary texts hold too is not added to their dictionary while it is so many times as frequent in toxic ones.
ODDS = 6

#: Shortest match, and windows that are compressed in one call.
_MATCH = 5
_BLOCK = 1 << 15


@dataclass
class Dictionaries:
    """The two dictionaries and the coefficients of the score."""

    ordinary: bytes
    toxic: bytes
    beta: np.ndarray


def spread(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes of all rows, white space as blanks and one blank before each row; the rows' offsets."""
    data, offsets = utf8(column)
    rows = len(offsets) - 1
    out = np.full(len(data) + rows + 1, 32, dtype=np.uint8)
    lowered = LOWER[data]
    lowered[SPACE[data]] = 32
    out[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))] = lowered
    return out, offsets + np.arange(rows + 1)


def windows(data: np.ndarray, offsets: np.ndarray, cell: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each window: the words that start in one cell of a row's grid, with a blank on both sides; a cell of 1 makes each word a window."""
    starts, ends, bounds = words(data, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    cells = (starts - offsets[rows]) // cell
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (cells[1:] != cells[:-1]) | (rows[1:] != rows[:-1])
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(starts)) - 1 if len(starts) else begin
    return starts[begin] - 1, ends[last] + 1, rows[begin]


def compressor(content: bytes, search: int = 5) -> zstandard.ZstdCompressor:
    """A compressor whose window reaches all of its dictionary."""
    log = max(17, (len(content) + 65536).bit_length())
    settings = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=log, chain_log=log - 1, hash_log=min(log, 20),
        search_log=search, min_match=_MATCH, target_length=16, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=settings)


class Scorer:
    """Compressors for both dictionaries; made once per task."""

    def __init__(self, ordinary: bytes, toxic: bytes, search: int = 5):
        self.compressors = [compressor(ordinary, search), compressor(ordinary + toxic, search)]

    def savings(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window, 0 at least. Each window is compressed under both."""
        saved = np.zeros(len(begin))
        for i in range(0, len(begin), _BLOCK):
            ordinary, toxic = self._lengths(data, begin[i:i + _BLOCK], end[i:i + _BLOCK])
            saved[i:i + _BLOCK] = np.maximum(ordinary - toxic, 0)
        return saved

    def _lengths(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Compressed lengths of the windows under the ordinary and the toxic dictionary."""
        size = end - begin
        stops = np.cumsum(size + len(_PAD))
        at = stops - size - len(_PAD)
        text = np.tile(_PAD[:1], int(stops[-1]))
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text[inside + np.repeat(at, size)] = data[inside + np.repeat(begin, size)]
        segments = np.column_stack([at, size + len(_PAD)]).astype(np.uint64)
        source = zstandard.BufferWithSegments(text.tobytes(), segments.tobytes())
        return [np.array([len(piece) for piece in each.multi_compress_to_buffer(source)]) for each in self.compressors]

    def features(self, column: pa.Array) -> np.ndarray:
        """Per row: what the windows save, in all, at most and per window; all 0 for a row without words."""
        data, offsets = spread(column)
        begin, end, rows = windows(data, offsets)
        saved, n = self.savings(data, begin, end), len(column)
        count = np.maximum(np.bincount(rows, minlength=n), 1)
        out = []
        for least in (2, 3, 4):
            hits = np.bincount(rows, saved >= least, minlength=n)
            out += [np.log1p(hits), np.minimum(hits / count, 0.1) * 20]
        total = np.bincount(rows, np.where(saved >= 2, saved, 0), minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, rows, saved)
        return np.column_stack([*out, np.log1p(total), np.minimum(total / count, 0.5) * 4, np.minimum(most, 8) / 4])


def _cut(texts: list[str], cell: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, starts, ends and rows of the windows of slices of the texts."""
    for column in text_slices(texts):
        data, offsets = spread(column)
        yield data, *windows(data, offsets, cell)


def _words(texts: list[str]) -> Counter:
    """Each word between blanks, and the texts that it is in."""
    found = Counter()
    for data, begin, end, rows in _cut(texts, 1):
        whole = data.tobytes()
        found.update(word for _, word in {
            (row, whole[a:b]) for row, a, b in zip(rows.tolist(), begin.tolist(), end.tolist(), strict=True)
        })
    return found


def _saving(ordinary: bytes, toxic: bytes, pieces: list[bytes], least: int) -> list[bytes]:
    """The pieces that the toxic text shortens by ``least`` bytes or more."""
    if not pieces or not toxic:
        return []
    stops = np.cumsum([len(piece) for piece in pieces])
    begin = np.concatenate([[0], stops[:-1]])
    saved = Scorer(ordinary, toxic, search=8).savings(np.frombuffer(b"".join(pieces), dtype=np.uint8), begin, stops)
    return [pieces[i] for i in np.flatnonzero(saved >= least).tolist()]


def _wrong(ordinary: bytes, toxic: bytes, texts: list[str], cell: int) -> Counter:
    """All windows of ordinary texts that the toxic text shortens by 2 bytes or more, and the texts that each is in."""
    scorer, wrong = Scorer(ordinary, toxic), Counter()
    for data, begin, end, rows in _cut(texts, cell):
        some = np.flatnonzero(scorer.savings(data, begin, end) >= 2).tolist()
        wrong.update(piece for _, piece in {(int(rows[i]), data[begin[i]:end[i]].tobytes()) for i in some})
    return wrong


def _joined(pieces: Counter) -> bytes:
    """Pieces as a dictionary's text: the most frequent last, where matches cost least."""
    return b"".join(sorted(pieces, key=lambda piece: (pieces[piece], piece)))


def _ordinary(texts: list[str], size: int) -> bytes:
    """A dictionary that zstandard trains on windows of ordinary texts."""
    every = max(1, sum(map(len, texts)) // WINDOW // TRAINED_WINDOWS)
    pieces: list[bytes] = []
    for data, begin, end, _ in _cut(texts, WINDOW):
        whole = data.tobytes()
        pieces += [whole[a:b] for a, b in zip(begin[::every].tolist(), end[::every].tolist(), strict=True)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(pieces)[-size:]


def _reference(texts: list[str]) -> bytes:
    """The first texts, ``REFERENCE`` bytes about."""
    out, size = [], 0
    for data, *_ in _cut(texts, WINDOW):
        out.append(data.tobytes())
        size += len(data)
        if size >= REFERENCE:
            break
    return b"".join(out)[:REFERENCE]


def train(
    texts: list[tuple[int, str]], share: float, ordinary_size: int = 65536, support: float = 0.01, miss: float = 2.0
) -> Dictionaries:
    """Both dictionaries and the score from labelled texts; the score is constant where a label is missing.

    Kept words are in ``support`` of the toxic texts at least, and in two. A quarter of the
    ordinary texts is spared from the dictionaries, for the score to be fitted on. There a
    toxic text that is missed weighs as much as ``miss`` false alarms.
    """
    y = np.array([label for label, _ in texts], dtype=float)
    if not 0 < y.sum() < len(y):
        return Dictionaries(b"", b"", np.array([-30.0 if not share else 30.0]))
    hostile, plain = ([text for label, text in texts if label == one] for one in (1, 0))
    spare, used = plain[::4] or plain, [text for i, text in enumerate(plain) if i % 4] or plain
    reference, held = _reference(used[::2]), used[1::2] or used
    halves = [_words(hostile[i::2]) for i in range(2)]
    counts = halves[0] + halves[1]
    least = max(2, support * len(hostile))
    kept = [_saving(reference, b"".join(sorted(halves[1 - i])), sorted(halves[i]), GAIN) for i in range(2)]
    ordinary = _ordinary(used, ordinary_size)
    for _ in range(ROUNDS):
        wrong = _wrong(ordinary, b"".join(kept[0] + kept[1]), held, 1)
        telling = {word for some in kept for word in some if counts[word] * len(held) > ODDS * wrong[word] * len(hostile)}
        ordinary = _joined(Counter({word: n for word, n in wrong.items() if word not in telling})) + ordinary
        kept = [_saving(ordinary, b"".join(kept[1 - i]), kept[i], GAIN) for i in range(2)]
    final = {word: counts[word] for some in kept for word in some if counts[word] >= least}
    toxic = _joined(Counter(final))
    for _ in range(2):
        wrong = _wrong(ordinary, toxic, used, WINDOW)
        chance = {piece: n for piece, n in wrong.items() if not any(b" " + word + b" " in final for word in piece.split())}
        ordinary = _joined(Counter(chance)) + ordinary
    scorer = Scorer(ordinary, toxic)
    drawn = spare + hostile
    x = np.concatenate([scorer.features(column) for column in text_slices(drawn)])
    z = np.concatenate([np.zeros(len(spare)), np.ones(len(hostile))])
    return Dictionaries(ordinary, toxic, logistic(x, z, class_weights(z, share) * np.where(z == 1, miss, 1)))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    target: str = "toxic",
    threshold: float = 0.3,
    per_label: int = 4000,
    longest: int = 40_000,
) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``; only the text goes into the score.

    Learns from at most ``per_label`` rows of each label with at most ``longest`` characters,
    none of fold 2. A null or empty text has no windows and gets the score of a text without
    toxic matches. A null id is not held out. Equal texts have equal scores, repeated rows
    come back as often as they are. Without rows of both labels the score is 0 (or 1 where all
    are toxic). An empty table gives an empty result; other columns are ignored.
    """
    sample, share = labelled_sample(docs, labels, target, id, text, per_label, longest)
    model = train(sample, share)
    cache: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "scorer" not in cache and len(model.beta) > 1:
            cache["scorer"] = Scorer(model.ordinary, model.toxic)
        x = cache["scorer"].features(batch.column(1)) if cache else np.zeros((batch.num_rows, 0))
        score = sigmoid(x @ model.beta[:-1] + model.beta[-1])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    scored = map_slices(rows, work, "id BIGINT, score DOUBLE", ["text"])
    return scored.select(
        F.col("id").alias(id),
        F.coalesce(fold("id") == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
