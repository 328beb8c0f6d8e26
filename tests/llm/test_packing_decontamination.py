"""The index of sums, packing beside a caller's columns, and the windows of a benchmark block."""

from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import prose
from thermocline.llm import decontaminate, packing


def sums(left, k):
    """How many multisets of k available lengths have each sum, by listing them."""
    out = np.zeros(len(left), np.int64)
    for chosen in combinations_with_replacement(np.flatnonzero(left > 0).tolist(), k):
        if sum(chosen) < len(left) and all(left[x] >= chosen.count(x) for x in chosen):
            out[sum(chosen)] += 1
    return out.tolist()


@pytest.mark.parametrize("seed", range(6))
def test_sums_of_pairs_and_triples_follow_what_is_taken(seed):
    random = np.random.default_rng(seed)
    left = random.integers(0, 5, 40) * (random.random(40) < 0.6)
    left[0] = 0
    lengths = packing.Lengths(left)
    while True:
        assert lengths.pairs.tolist() == sums(lengths.left, 2)
        assert lengths.triples.tolist() == sums(lengths.left, 3)
        there = np.flatnonzero(lengths.left)
        if not there.size:
            break
        length = int(random.choice(there))
        lengths.take(length, int(random.integers(1, lengths.left[length] + 1)))


@pytest.mark.parametrize("seed", range(4))
def test_a_gap_is_filled_whenever_three_pieces_can(seed):
    random = np.random.default_rng(seed)
    left = random.integers(0, 3, 30) * (random.random(30) < 0.3)
    left[0] = 0
    lengths = packing.Lengths(left)
    for gap in range(1, 30):
        can = any(sums(lengths.left, k)[gap] for k in (1, 2, 3))
        found = lengths.fill(gap)
        assert (found is not None) == can
        if found:
            assert sum(found) == gap and all(found.count(x) <= left[x] for x in found)


def test_packing_keeps_columns_named_like_its_own(spark):
    names = ["_file", "_row", "_n", "_before", "_rank", "_metadata", "sequence_id"]
    rows = [(i, 0, 0, 1 + i % 50, i) for i in range(300)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").select(
        "*", *[(F.col("doc_id") * k).alias(n) for k, n in enumerate(names)])
    packed = packing.pack(pieces, 64)
    assert "Broadcast" not in packed._jdf.queryExecution().executedPlan().toString()
    found = packed.collect()
    assert {(r["doc_id"], *[r[n] for n in names[:-1]]) for r in found} == {
        (i, *[i * k for k in range(len(names) - 1)]) for i in range(300)}
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64


def test_windows_of_a_block_are_listed_once_with_all_their_items():
    texts = [prose(1, 40), prose(1, 40), prose(2, 25), "one two", "two one", "one two", "", None, "a " * 30]
    texts.append(prose(3, 12) + " " + prose(1, 40))
    items = [(str(i % 8), t) for i, t in enumerate(texts)]
    phrases = decontaminate.Phrases(items, 10)
    want = {}
    for item, text in items:
        words = decontaminate.words_of(text)
        size = min(10, len(words))
        for at in range(len(words) - size + 1) if size else ():
            want.setdefault(tuple(phrases.symbols[w] for w in words[at:at + size]), set()).add(item)
    found = {}
    for patterns, bounds, owners in phrases.patterns():
        for i, pattern in enumerate(patterns.tolist()):
            assert tuple(pattern) not in found
            found[tuple(pattern)] = set(phrases.items(owners[bounds[i]:bounds[i + 1]]))
    assert found == want and phrases.shortest == 2
    assert decontaminate.Phrases([("1", None), ("2", "...")], 10).shortest == 0


def test_windows_that_share_a_hash_stay_apart(monkeypatch):
    """With every hash equal, windows may be listed twice but keep their words and items."""
    monkeypatch.setattr(decontaminate, "HASH_STEP", 0)
    items = [("a", "x y z"), ("b", "x z y"), ("c", "x y z")]
    found = {}
    for patterns, bounds, owners in (phrases := decontaminate.Phrases(items, 3)).patterns():
        for i, pattern in enumerate(patterns.tolist()):
            found.setdefault(tuple(pattern), set()).update(phrases.items(owners[bounds[i]:bounds[i + 1]]))
    assert sorted(map(sorted, found.values())) == [["a", "c"], ["b"]]
