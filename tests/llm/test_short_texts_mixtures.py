"""Short near copies, language sets of any size, and columns of a caller that look like ours."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import Groups, jaccard_groups, odd_documents
from tests.oracle_check import TESTDATA
from thermocline.llm import language, simhash

SF = str(TESTDATA / "sf0.001")


def shares(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("size", range(0, 16))
def test_a_shared_subset_decides_similarity(size):
    """The numbers behind the subsets: sets are similar exactly if what either lacks is within ``_others``."""
    for shared in range(size + 1):
        for other in range(0, 16 - shared):
            similar = shared >= 0.8 * (size + other) - 1e-12 if size + other else True
            assert similar == (size - shared + other <= simhash._others(shared))
            if similar:
                assert size - shared <= simhash.left_out(size)
                assert shared + other <= simhash.SHORT or size > simhash.COVERED


def test_short_links_join_what_exact_similarity_joins(spark):
    """Sentences over few words, changed by one or two: components equal those of all exact comparisons."""
    rng = random.Random(4)
    texts = {" ", "one", "One", "one two", "a b c d e", "A b c d  e", "a b c d f"}
    for _ in range(120):
        words = [rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(rng.randrange(5, 20))]
        texts.add(" ".join(words))
        for _ in range(2):
            cut = rng.randrange(3)
            texts.add(" ".join(words[cut:]) if rng.random() < 0.5 else " ".join(words[:len(words) - cut] + ["x"] * rng.randrange(2)))
    texts = sorted(texts)
    data = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    links = [(r["a"], r["b"]) for r in simhash.short_links(data).collect()]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    fits = [i for i, s in enumerate(sets) if len(s) <= simhash.SHORT]
    want, got = Groups(), Groups()
    for a in fits:
        for b in fits:
            if a < b and shares(sets[a], sets[b]) >= 0.8:
                want.join(a, b)
    for a, b in links:
        assert shares(sets[a], sets[b]) >= 0.8
        got.join(a, b)
    assert [got.of(i) for i in fits] == [want.of(i) for i in fits]
    assert len(links) < 0.2 * len(fits) ** 2


def test_pairs_of_eight_and_nine_words_are_joined(spark):
    rng = random.Random(1)
    rows = []
    for pair in range(400):
        words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(9)]
        rows += [(2 * pair, " ".join(words[:8])), (2 * pair + 1, " ".join(words))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 800, 2))


def edited(rng, words, times):
    """The words with so many of them replaced by new ones."""
    places = set(rng.sample(range(len(words)), times))
    return " ".join(f"x{rng.getrandbits(40)}" if i in places else w for i, w in enumerate(words))


def test_a_crowd_around_the_threshold_makes_few_pairs(spark, monkeypatch):
    """Before, 30,440 pairs of the 240 texts were made, growing with the square."""
    rng, made = random.Random(8), []
    words = [f"w{i}" for i in range(150)]
    texts = [edited(rng, words, rng.choice((1, 2, 3, 4, 5, 6, 8))) for _ in range(240)]
    close = simhash._close
    monkeypatch.setattr(simhash, "_close", lambda pairs, *rest: made.append(pairs.count()) or close(pairs, *rest))
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    groups = jaccard_groups(texts)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({groups.of(i) for i in range(len(texts))})
    assert made[1] < 8 * len(texts)


def test_marks_rule_out_no_similar_pair(spark):
    """Sets of 1 to 3,000 shingles, similar or not, with as many and with fewer marks."""
    rng, rows = np.random.default_rng(2), []
    for size in (1, 5, 120, 128, 130, 300, 1020, 1100, 3000):
        for gone in (0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.3):
            for new in (0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.3):
                a = rng.integers(0, 1 << 63, size, np.uint64)
                b = np.concatenate((a[int(gone * size):], rng.integers(0, 1 << 63, int(new * size), np.uint64)))
                similarity = shares(set(a.tolist()), set(b.tolist()))
                rows += [(similarity, *((len(x), simhash.parity_bits(x).tolist()) for x in pair)) for pair in ((a, b), (b, a))]
    marks = "struct<size: int, bits: array<long>>"
    found = spark.createDataFrame(rows, f"similarity double, marks_a {marks}, marks_b {marks}").select(
        "similarity", F.size("marks_a.bits").alias("a"), F.size("marks_b.bits").alias("b"), simhash._may_be_similar().alias("open")).collect()
    assert all(r["open"] for r in found if r["similarity"] >= 0.8)
    assert any(r["open"] and r["a"] != r["b"] for r in found)
    assert not any(r["open"] for r in found if r["similarity"] < 0.7 and r["a"] <= 32)
    unmarked = spark.createDataFrame([(None, rows[0][1]), (None, None)], f"marks_a {marks}, marks_b {marks}")
    assert all(r[0] for r in unmarked.select(simhash._may_be_similar()).collect())


def test_near_dedup_leaves_columns_like_its_own_alone(spark):
    names = ["_own", "_key", "_doc", "_n", "_winner_id", "id", "root", "text_id"]
    docs = odd_documents(spark)
    extra = docs
    for name in names:
        extra = extra.withColumn(name, F.lit(name))
    kept = simhash.keep_one(extra)
    assert kept.columns == extra.columns
    assert all(r[name] == name for r in kept.collect() for name in names)
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    assert ids(kept) == ids(simhash.keep_one(docs))


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(language.training_rows(spark.read.parquet(f"{SF}/documents.parquet")))


@pytest.fixture(scope="module")
def samples():
    rows = duckdb.sql(f"SELECT lang, text FROM '{SF}/documents.parquet' WHERE len(text) > 3000 ORDER BY doc_id").fetchall()
    return {lang: text[:3000] for lang, text in reversed(rows)}


def test_a_text_of_four_languages_has_four(model, samples):
    langs = sorted(samples)
    assert len(langs) == 4
    (found,) = language.infer(["\n".join(samples[x] for x in langs)], *model)
    mixture = {m["lang"]: m["share"] for m in found[3]}
    assert sorted(mixture) == langs and all(0.15 < share < 0.35 for share in mixture.values())
    assert sum(mixture.values()) == pytest.approx(1)
    for n in (1, 2, 3):
        (found,) = language.infer(["\n".join(samples[x] for x in langs[:n])], *model)
        assert sorted(m["lang"] for m in found[3]) == langs[:n]


def test_mixtures_equal_a_plain_expectation_maximisation(model, samples):
    languages, log_p = model
    texts = [samples[x][:400] + samples[y][:900] for x in samples for y in samples]
    counted = [language._counted(t, len(log_p)) for t in texts]
    best, fit, _ = language.Mixtures(log_p, counted).select()
    for row, (found, counts) in enumerate(counted):
        p, k = np.exp(log_p[found]), len(languages)

        def fitted(start, rounds):
            share = np.array(start)
            for _ in range(rounds):
                weight = p * share
                share = (weight / weight.sum(axis=1, keepdims=True) * counts[:, None]).sum(axis=0) / counts.sum()
            return share, (counts * np.log((p * share).sum(axis=1))).sum()

        order = np.argsort(-fitted([1 / k] * k, language.ROUNDS)[0], kind="stable")
        everything = fitted([1 / k] * k, language.ROUNDS)[0]
        single = (counts[:, None] * log_p[found]).sum(axis=0)
        chosen, value, whole = np.eye(k)[single.argmax()], single.max(), single.max()
        for size in range(2, k + 1):
            start = np.where(np.isin(np.arange(k), order[:size]), everything + 1e-9, 0)
            share, total = fitted(start / start.sum(), language.ROUNDS // 2)
            penalised = total - language.OVERLAP * language.PENALTY * (size - 1) * np.log(counts.sum() + 1)
            if penalised <= value:
                break
            chosen, value, whole = share, penalised, total
        assert np.allclose(best[row], chosen, atol=1e-9) and fit[row] == pytest.approx(whole / counts.sum())


@pytest.mark.parametrize("size", [3, 10, 64])
def test_blocks_count_what_the_whole_text_counts(monkeypatch, size):
    texts = ["Ein Satz, noch einer!  Und\n\n ΣΟΦΟΣ ΣΑΣ... 12 34", "a", "..", "ab" * 40, " . a . b,,,c ", "é" * 11]
    whole = [language._counted(t, 997) for t in texts]
    monkeypatch.setattr(language, "BLOCK_CHARS", size)
    for text, (found, counts) in zip(texts, whole):
        again = language._counted(text, 997)
        assert again[0].tolist() == found.tolist() and again[1].tolist() == counts.tolist()


def test_more_languages_keep_their_buckets(spark):
    rows = [(f"l{i:03}", f"word{i} other{i}") for i in range(140)]
    languages, log_p = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert len(languages) == 140 and log_p.shape == (language.BUCKETS, 140)


def test_equal_rows_are_spread_and_columns_kept_when_sharding(spark):
    """Half of the rows are equal: no range of ranks holds them all, and shards stay as the rows ask for."""
    from thermocline.llm import ranks, sharding

    rows = [(1, "hot", 7)] * 3000 + [(i, "bc"[i % 2], i) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size int").repartition(6)
    for name in ("_label", "_hash", "_rank", "_at", "_place", "_held", "_tie", "_block", "_before"):
        docs = docs.withColumn(name, F.lit(name))
    placed = sharding.interleave(docs, 8, order=("doc_id", "size"))
    assert set(placed.columns) == {*docs.columns, "shard", "slot"}
    found = placed.collect()
    assert all(r["_label"] == "_label" and r["_before"] == "_before" for r in found)
    assert sorted((r["shard"], r["slot"]) for r in found) == [(s, i) for s in range(8) for i in range(750)]
    for shard in range(8):
        hot = sum(r["source"] == "hot" for r in found if r["shard"] == shard)
        assert abs(hot - 375) <= 2
    dealt = ranks.ranked(ranks.store(docs.select("doc_id"), "t"), ["doc_id"], "place")
    blocks = dealt.sparkSession.read.parquet(dealt.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_block").count().collect()
    assert max(r["count"] for r in blocks) < 3 * sum(r["count"] for r in blocks) / len(blocks)


@pytest.mark.parametrize("few", [simhash.FEW_PARTNERS, 0])
def test_a_group_around_the_threshold_is_joined_by_few_comparisons(spark, monkeypatch, few):
    """Copies of one text with a few words replaced: same components as comparing every pair, most pairs never compared."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(160):
        words = list(base)
        for place in rng.sample(range(90), rng.randrange(1, 9)):
            words[place] = f"new{i}x{place}"
        texts.append(" ".join(words))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    prints = [simhash.fingerprint(np.array(sorted(s), np.uint64), 6) for s in sets]
    pairs = [(a, b, int(np.bitwise_count(prints[a] ^ prints[b]).sum())) for a in range(len(texts)) for b in range(a)]
    want, got = Groups(), Groups()
    for a, b, _ in pairs:
        if shares(sets[a], sets[b]) >= 0.8:
            want.join(a, b)
    compared = []
    monkeypatch.setattr(simhash, "FEW_PARTNERS", few)
    alike = simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, grams: compared.append(pairs.count()) or alike(pairs, grams))
    links = simhash._linking(
        spark.createDataFrame(pairs, "a long, b long, distance int"), spark.createDataFrame([], "a long, b long"),
        spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)).collect()
    for r in links:
        assert shares(sets[r["a"]], sets[r["b"]]) >= 0.8
        got.join(r["a"], r["b"])
    assert [got.of(i) for i in range(len(texts))] == [want.of(i) for i in range(len(texts))]
    assert 1 < len({want.of(i) for i in range(len(texts))}) < len(texts) and len(compared) == (2 if few else 3)
    assert sum(compared) < 0.25 * len(pairs)
