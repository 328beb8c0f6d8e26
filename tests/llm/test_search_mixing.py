"""Lexical search, resampling and mixing against plain re-implementations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import no_documents, odd_documents, odd_rows
from thermocline.llm import grams, lexical, mixing, ranks, resample
from thermocline.llm.grams import Interned, Words


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


TEXTS = ["a b a", None, "", "  ", "Straße,ÜNÏ漢字 A1", "x", "-", "one\0two\x7fthree", "end", "漢" * 50 + " z"]


def test_words_and_runs_are_slices_of_one_buffer():
    column = pa.chunked_array([pa.array(["cut off", *TEXTS[:4]]).slice(1), pa.array(TEXTS[4:])])
    words = Words.of(column)
    for n in (1, 2, 3):
        runs, want = words.runs(n), []
        for row, text in enumerate(TEXTS):
            found = plain_words(text)
            want += [(row, " ".join(found[i:i + n])) for i in range(len(found) - n + 1)]
        assert list(zip(runs.row.tolist(), runs.strings(np.arange(len(runs))).to_pylist())) == want
        assert runs.count.tolist() == [sum(r == row for r, _ in want) for row in range(len(TEXTS))]
    assert len(Words.of(pa.chunked_array([], pa.string()))) == 0


def test_equal_keys_are_told_apart_by_bytes(monkeypatch):
    words = Words.of(pa.chunked_array([["ab ba ab cd ab cde dc ba " * 20]]))
    monkeypatch.setattr(grams, "keys_of", lambda words: np.full(len(words), 2**64 - 1, np.uint64))
    table = Interned.of(words)
    names = words.strings(np.arange(len(words))).to_pylist()
    by_slot = defaultdict(set)
    for name, slot in zip(names, table.slot.tolist()):
        by_slot[slot].add(name)
    assert sorted(map(sorted, by_slot.values())) == [["ab"], ["ba"], ["cd"], ["cde"], ["dc"]]
    assert words.strings(table.owner[table.slot]).to_pylist() == names
    assert len(table.used()) == 5


def test_pieces_hold_whole_rows(monkeypatch):
    monkeypatch.setattr(grams, "PIECE_BYTES", 10)
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], ["text"]) for t in (["aaaa", "bbbb", "cccc"], [], ["d" * 30, None, "e"], ["f"] * 5)]
    found = [p["text"].to_pylist() for p in grams.pieces(iter(batches), rows=3)]
    assert found == [["aaaa", "bbbb"], ["cccc"], ["d" * 30], [None, "e", "f"], ["f", "f", "f"], ["f"]]
    assert list(grams.pieces(iter([]))) == []


def test_ranks_of_a_hot_value(spark):
    """Most rows are equal: they share one range of ranks, and no range of rows holds them all."""
    rows = [("g", 5, 1)] * 3000 + [("g", i, 2) for i in range(50)] + [(None, 1, 3), ("h", 2, None), ("h", None, None)]
    data = spark.createDataFrame(rows, "label string, v int, _at int").repartition(5)
    found = ranks.ranked(data, ["v"], "place", group=None).collect()
    assert sorted(r["place"] for r in found) == list(range(1, len(rows) + 1))
    order = [r["v"] for r in sorted(found, key=lambda r: r["place"])]
    assert order == sorted(order, key=lambda v: (v is not None, v or 0))
    grouped = ranks.ranked(data.where("label is not null"), ["v"], "place", group="label", descending=("v",))
    assert set(grouped.columns) == {"label", "v", "_at", "place"}
    for label in "gh":
        mine = sorted((r for r in grouped.collect() if r["label"] == label), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["v"] for r in mine] == sorted((r["v"] for r in mine), key=lambda v: -1 if v is None else v, reverse=True)


# -- lexical search ------------------------------------------------------------


def plain_search(docs, items, k):
    terms = [plain_words(text) for _, text in docs]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    holders = Counter(t for found in terms for t in set(found))
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item].update(plain_words(text))
    out = []
    for item, query in wanted.items():
        scored = []
        for (doc_id, _), found in zip(docs, terms):
            counts = Counter(found)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * holders[t] + 1)))
                * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * (100 - 90 + (90 * len(found) * n) // total)))
                for t in query if t in counts)
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found_by(spark, docs, items, k=10, parts=3):
    schema = "doc_id long, text string, shard string, ids string, score int"
    rows = [(i, t, "s", "x", 0) for i, t in docs]
    data = spark.createDataFrame(rows, schema).repartition(parts)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    return sorted((tuple(r) for r in lexical.search(lexical.build_index(data), asked, k).collect()), key=str)


def test_search_equals_plain_scores(spark):
    docs = [(r[0], r[1]) for r in odd_rows()]
    items = [(1, "alpha1 BETA2 river garden"), (1, "one"), (2, None), (3, ""), (4, "nowhere"), (5, "one one two password"),
             (None, "漢字 straße"), (6, " ".join(docs[0][1].split()[:40]))]
    assert found_by(spark, docs, items) == plain_search(docs, items, 10)
    assert found_by(spark, docs, items, k=2, parts=7) == plain_search(docs, items, 2)


def test_search_of_nothing(spark):
    assert found_by(spark, [], [(1, "a")]) == [] and found_by(spark, [(1, "a")], []) == []
    assert found_by(spark, [(1, None), (2, "")], [(1, "a")]) == []


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 60)
    docs = [(i, f"w{i % 7} w{i % 5} common " * (i % 3 + 1)) for i in range(60)]
    items = [(i, f"w{i} common w{i + 1}") for i in range(9)]
    assert found_by(spark, docs, items) == plain_search(docs, items, 10)


@pytest.mark.parametrize("seed", range(6))
def test_hybrid_search_prunes_without_loss(seed, monkeypatch):
    """Many shards, ties and skewed lists: the best documents equal those of complete sums."""
    monkeypatch.setattr(lexical, "STRETCH", 4 + 30 * (seed % 2))
    monkeypatch.setattr(lexical, "SHORT", [0, 1 / 16, 1 / 2][seed % 3])
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(30)]
    docs = [[t for i, t in enumerate(vocabulary) for _ in range(rng.choice((0, 0, 1, 3))) if rng.random() < 1 / (1 + i / 4)]
            for _ in range(400)]
    n, total = sum(map(bool, docs)), sum(map(len, docs))
    weights = {t: rng.randrange(0, 5000) for t in vocabulary}
    queries = [[(t, weights[t]) for t in rng.sample(vocabulary, size)] for size in (1, 2, 5, 12, 30)]
    best = lexical.Best(len(queries), 7)
    looked_up = 0
    for start in range(0, 400, 100):
        mine = docs[start:start + 100]
        counts = [Counter(d) for d in mine]
        lists = {t: (np.array([i for i, c in enumerate(counts) if t in c], np.int32), np.array([c[t] for c in counts if t in c]))
                 for t in vocabulary if any(t in c for c in counts)}
        ids = np.arange(1000 - start, 900 - start, -1)
        shard = lexical.Shard(lists, np.array([len(d) for d in mine]), ids, np.ones(100, bool), n, total)
        for query, terms in enumerate(queries):
            shard.search(query, terms, best)
            looked_up += len(best.of[query][0])
    for query, terms in enumerate(queries):
        want = []
        for place, doc in enumerate(docs):
            c = Counter(doc)
            score = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * len(doc) * n // total))) for t, w in terms if t in c)
            if score:
                want.append((-score, 1000 - place))
        assert list(zip((-best.of[query][0]).tolist(), best.of[query][1].tolist())) == sorted(want)[:7]


# -- resampling ------------------------------------------------------------------


def plain_resample(docs, targets, longest, buckets, percent, least):
    def features(text):
        words = plain_words(text)
        return [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(f for _, x in docs for f in features(x)), Counter(f for x in targets for f in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        found = features(text)
        weight = sum(gain[f] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, len(plain_words(text)) >= least))
    fits = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    drawn = Counter(r[:4] + (i + 1,) for i, r in enumerate(fits[:percent * len(fits) // 100]))
    drawn.update(r[:4] + (None,) for r in [*fits[percent * len(fits) // 100:], *(r for r in rows if not r[4])])
    return drawn


@pytest.mark.parametrize("longest,percent,least", [(1, 10, 20), (3, 50, 2), (2, 100, 1), (1, 0, 1)])
def test_resampling_equals_plain_counts(spark, longest, percent, least, monkeypatch):
    docs = [(r[0], r[1]) for r in odd_rows()] * 2
    data = spark.createDataFrame(
        [(i, t, 0, 0, "w", "r", 9) for i, t in docs],
        "doc_id long, text string, n_features int, weight int, score string, rank string, _place int").repartition(4)
    targets = ["alpha1 beta2 one two", None, "", "Straße river"]
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    gains = resample.learn_gains(data, target, longest, 97)
    scored = resample.store(resample.with_score(resample.weigh(data, gains, longest)), "scored")
    drawn = resample.draw(scored, percent, least)
    assert "_place" in drawn.columns and drawn.count() == len(docs)
    got = Counter(tuple(r) for r in drawn.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == plain_resample(docs, targets, longest, 97, percent, least)


def test_resampling_of_nothing(spark):
    none, some = no_documents(spark), odd_documents(spark)
    assert not resample.learn_gains(none, none).any()
    scored = resample.with_score(resample.weigh(none, resample.learn_gains(none, some)))
    assert resample.draw(scored).count() == 0
    alone = resample.store(resample.with_score(resample.weigh(some, resample.learn_gains(some, none))), "scored")
    assert resample.draw(alone).count() == some.count()


# -- mixing ----------------------------------------------------------------------


def plain_targets(sizes):
    """Round by round, exactly: full sources stop at three times their size, the rest shares the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = Fraction(3 * sizes[s])
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, None: 5}, {"a": 7}, {None: 0}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 1, "d": 1, "é": 500, "Z": 3},
    {"a": 300, "b": 200, "c": 100, None: 100}, {"a": 1, "b": 0, "c": 100000, "d": 40, "e": 2}])
def test_targets_share_the_excess(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = plain_targets(sizes)
    assert found.keys() == want.keys()
    for source in want:
        assert found[source] == pytest.approx(float(want[source]), rel=1e-12, abs=1e-9)


def test_mixture_comes_near_its_targets(spark):
    rng = random.Random(3)
    rows = [(i if i % 50 else None, rng.choice(["hot"] * 6 + ["b", "c", None]), int(rng.paretovariate(0.9) * 10) % 5000) for i in range(3000)]
    rows += [(7, "c", 11)] * 800 + [(8, "b", 0)] * 5
    data = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, source string, size long, _place string, target int, _label string")
    mixed = mixing.mix(data.repartition(6)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in mixed) == Counter(rows)
    longest, taken, of = Counter(), Counter(), {}
    for r in mixed:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] and r["_place"] == "x" and r["_label"] == "y"
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        taken[r["source"]] += r["taken"]
        of[r["source"]] = r["target"], r["source_size"]
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    want = plain_targets(dict(sizes))
    for source, (target, size) in of.items():
        assert size == sizes[source] and target == pytest.approx(float(want[source]))
        assert abs(taken[source] - target) <= longest[source]
    again = mixing.mix(data.repartition(2)).collect()
    pick = lambda found: Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in found)
    assert pick(again) == pick(mixed)
    emitted = mixing.emit(spark.createDataFrame([(1, 0), (2, 3), (3, 1)], "doc_id int, copies int"))
    assert sorted((r["doc_id"], r["copy"]) for r in emitted.collect()) == [(2, 1), (2, 2), (2, 3), (3, 1)]


def test_mixture_of_odd_rows(spark):
    docs = odd_documents(spark).withColumn("size", mixing.word_count())
    mixed = mixing.mix(docs)
    assert {*docs.columns, "source_size", "target", "copies", "taken"} == set(mixed.columns)
    sizes = Counter()
    for r in mixed.collect():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["size"]
    assert all(r["source_size"] == sizes[r["source"]] for r in mixed.collect())
    assert mixing.mix(no_documents(spark).withColumn("size", mixing.word_count())).count() == 0
