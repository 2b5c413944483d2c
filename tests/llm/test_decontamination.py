import random
import resource
import time

import numpy as np
from pyspark.sql import functions as F

from rillstat.llm import decontamination
from rillstat.llm.decontamination import Q, RATE, Searcher, contaminated, decontaminated, edit_distance, gram_size, grams, index_items
from tests.llm.frames import DOCS, documents, sentence

ITEMS = "item_id BIGINT, text STRING"


def least_edits(pattern, text):
    """Edits from the pattern to the nearest part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        fresh = [i]
        for j, b in enumerate(text, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (a != b)))
        row = fresh
    return min(row)


def test_banded_distance_is_the_full_one():
    r = np.random.default_rng(2)
    for _ in range(400):
        pattern = r.integers(0, 4, r.integers(3, 25))
        text = np.concatenate([r.integers(0, 4, r.integers(0, 6)), pattern, r.integers(0, 4, r.integers(0, 6))])
        for _ in range(r.integers(0, 5)):
            at = int(r.integers(0, len(text)))
            text = np.delete(text, at) if r.random() < 0.5 else np.insert(text, at, 3)
        most, least = int(r.integers(0, 5)), least_edits(pattern.tolist(), text.tolist())
        found = edit_distance(pattern, text, most)
        assert (found is None) == (least > most)
        if found:
            assert found[0] == least and least_edits(pattern.tolist(), text[found[1]:found[2]].tolist()) == least


def test_grams_are_equal_for_equal_characters_alone():
    chars = np.random.default_rng(0).integers(0, 3, 60).astype(np.uint32)
    for q in (1, 2, 5, 8, 12):
        seen = {}
        for i, value in enumerate(grams(chars, q).tolist()):
            assert seen.setdefault(tuple(chars[i:i + q].tolist()), value) == value
        assert len(set(seen.values())) == len(seen)


def test_planted_items_are_found_as_a_full_alignment_finds_them(spark):
    r = random.Random(4)
    items = [(i, sentence(r, 30, 500)) for i in range(6)]
    texts, expected = [], set()
    for i in range(90):
        number, text = r.choice(items)
        copy = list(text)
        for _ in range(r.randrange(0, 14)):
            at = r.randrange(len(copy))
            copy[at:at + 1] = r.choice([["x"], [], ["y", copy[at]]])
        whole = sentence(r, 40, 500) + " " + "".join(copy) + " " + sentence(r, 40, 500)
        texts.append(whole)
        if least_edits(text, whole) <= int(RATE * len(text)):
            expected.add((i, number))
    texts += [sentence(r, 80, 500) for _ in range(20)]
    assert 20 < len(expected) < 85
    rows = contaminated(documents(spark, texts), spark.createDataFrame(items, ITEMS)).collect()
    assert {(row["doc_id"], row["item_id"]) for row in rows} == expected
    assert len(rows) == len(expected)
    for row in rows:
        part = texts[row["doc_id"]][row["start"]:row["end"]]
        assert least_edits(dict(items)[row["item_id"]], part) == row["edits"]
    kept = {row["doc_id"] for row in decontaminated(documents(spark, texts), spark.createDataFrame(items, ITEMS)).collect()}
    assert kept == set(range(110)) - {i for i, _ in expected}


def test_case_signs_and_place(spark):
    item = "The quick brown fox jumps over the lazy dog near the old river bank at noon."
    text = "É – intro:  THE quick, brown fox  jumps over the lazy dog near the\nold river bank (at noon) end"
    rows = contaminated(documents(spark, [text]), spark.createDataFrame([(7, item)], ITEMS)).collect()
    assert [(row["item_id"], row["edits"]) for row in rows] == [(7, 0)]
    assert text[rows[0]["start"]:rows[0]["end"]].lower().startswith("the quick") and "at noon" in text[rows[0]["start"]:rows[0]["end"]]


def test_odd_rows_and_blocks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([(1, item), (0, item), (2, None), (3, ""), (4, "short"), (None, item + " lambda mu")], ITEMS)
    texts = [None, "", item, item, "nothing of the kind", "word " * 50_000 + item, item[:20]]
    docs = documents(spark, texts, [0, 1, 2, 2, 3, 4, None]).withColumn("item_id", F.lit("x")).withColumn("start", F.lit(1))
    for chars in (4_000_000, 10):
        rows = contaminated(docs, items, block_chars=chars).collect()
        assert sorted((row["doc_id"], row["item_id"]) for row in rows) == [(2, 0), (2, 0), (4, 0)]
        kept = decontaminated(docs, items, block_chars=chars)
        assert kept.columns == docs.columns
        assert sorted(-1 if row["doc_id"] is None else row["doc_id"] for row in kept.collect()) == [-1, 0, 1, 3]
    assert contaminated(docs, spark.createDataFrame([], ITEMS)).collect() == []
    assert contaminated(spark.createDataFrame([], DOCS), items).collect() == []
    assert decontaminated(docs, spark.createDataFrame([], ITEMS)).count() == 7


def test_edits_go_by_the_rate_at_every_length():
    for size in range(Q, 400):
        q, edits = gram_size(size, Q, RATE), int(RATE * size)
        assert q == Q or size < 2 * Q
        assert size - q + 1 - edits * q >= 1


def found(items, text):
    return sorted((item, text[start:end], edits) for _, item, start, end, edits in Searcher(index_items(items, Q, RATE)).search([text]))


def test_items_of_every_length():
    r = random.Random(9)
    for size in [*range(1, 40), 60, 100]:
        item = "".join(r.choice("abcdefgh") for _ in range(size))
        assert found([(1, item)], f"Say: {item}, then") == [(1, item, 0)]
        assert found([(1, item)], item) == [(1, item, 0)]
        assert found([(1, item)], f"xy {item.upper()}") == [(1, item.upper(), 0)]
        at = size // 2
        changed = item[:at] + "z" + item[at + 1:]
        assert found([(1, item)], f"so {changed} it") == ([(1, changed, 1)] if int(RATE * size) else [])
        if size < Q:
            assert found([(1, item)], f"so {item}z it z{item}") == []


def test_short_items_side_by_side():
    assert found([(1, "ab")], "ab ab, ab-ab abab") == [(1, "ab", 0)] * 4
    assert found([(1, "ab"), (2, "ab cd")], "x ab cd") == [(1, "ab", 0), (2, "ab cd", 0)]
    assert found([(1, " . ")], "a . b") == []


def test_repeated_grams_take_little_time_and_memory():
    before, begin = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    for text, item, count in (("a" * 1_000_000, "a" * 2000, 500), ("ab" * 500_000, "ba" * 1000, 500), ("1 " * 300_000, "1 " * 600, 500)):
        rows = list(Searcher(index_items([(1, item)], Q, RATE)).search([text]))
        # What is left at the end may be a match with edits.
        assert len(rows) in (count, count + 1) and all(row[4] == 0 for row in rows[:count - 1])
    assert time.process_time() - begin < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_repeated_grams_and_edits():
    r = random.Random(3)
    for unit in ("a", "ab", "0 1 ", "word "):
        item = (unit * 200)[:200].strip()
        for _ in range(20):
            copy = list(item)
            for _ in range(r.randrange(0, 16)):
                copy[r.randrange(len(copy))] = r.choice("zy")
            text = "qqq " + "".join(copy) + " qqq"
            least = least_edits(item, text)
            rows = found([(5, item)], text)
            assert bool(rows) == (least <= int(RATE * len(item)))
            assert all(row[2] == least_edits(item, row[1]) for row in rows)


def test_many_pairs_are_listed_in_pieces(monkeypatch):
    r = random.Random(8)
    items = [(i, "the same beginning of many items " + sentence(r, 8, 500)) for i in range(40)]
    texts = [" ".join(["the same beginning of many items"] * 30 + [items[i][1]]) for i in (3, 7)] + [sentence(r, 50, 500)]
    searcher = Searcher(index_items(items, Q, RATE))
    whole = list(searcher.search(texts))
    monkeypatch.setattr(decontamination, "LISTED", 50)
    assert list(searcher.search(texts)) == whole and {row[1] for row in whole} == {3, 7}


def test_the_driver_has_one_block_at_a_time(spark, monkeypatch):
    """A block's matches are written before the next one is read."""
    held, most = set(), []
    plain = decontamination._found
    monkeypatch.setattr(decontamination, "_found", lambda rows, block, q, rate: (held.add(id(block)), most.append(len(block)), plain(rows, block, q, rate))[2])
    r = random.Random(2)
    items = [(i, sentence(r, 12, 500)) for i in range(20)]
    docs = documents(spark, [text + " " + sentence(r, 20, 500) for _, text in items])
    rows = contaminated(docs, spark.createDataFrame(items, ITEMS), block_chars=150).collect()
    assert {(row["doc_id"], row["item_id"]) for row in rows} == {(i, i) for i in range(20)}
    assert len(most) > 5 and max(most) <= 4
    assert decontaminated(docs, spark.createDataFrame(items, ITEMS), block_chars=150).count() == 0
