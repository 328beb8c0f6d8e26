"""Text operators against plain re-implementations, on odd rows and on the small tables."""

import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import Groups, jaccard_groups, no_documents, odd_documents, odd_rows, prose
from tests.oracle_check import TESTDATA, connect, mismatch
from thermocline.llm import catalog, decontaminate, language, packing, quality, secrets, sentences, sharding, simhash

SF = str(TESTDATA / "sf0.001")
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert mismatch(catalog.queries()[name](spark, SF), SQL[name], connect(SF)) is None


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def brute_fingerprint(text, size):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    rows = catalog.queries()["op1_simhash"](spark, SF).collect()
    prints = {i: brute_fingerprint(t, 3) for i, t in documents()}
    groups, ids = Groups(), sorted(prints)
    for place, a in enumerate(ids):
        for b in ids[:place]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                groups.join(a, b)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {
        (i, f"{prints[i]:016x}", groups.of(i)) for i in ids}


def test_links_within_three_bits(spark):
    prints = [0, 7, 0b1001 << 31, 1 << 63 | 1, 0b111 << 40, 0b11 << 31, 0xFFFF, 0x7FFF, 0xFFFF0000FFFF0000, 15]
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = {frozenset(p % (1 << 64) for p in r) for r in simhash.linked_fingerprints(spark.createDataFrame(rows, "fp long")).collect()}
    assert found == {frozenset((a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 3}


def test_components_of_a_long_chain(spark):
    from thermocline.llm.graph import components

    links = [(i, i + 1) for i in range(50)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (3, 4)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_keep_one_row_of_each_group(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [t or "" for _, t, *_ in odd_rows()]
    groups, best = jaccard_groups(texts), {}
    for place, (doc_id, *_) in enumerate(odd_rows()):
        best.setdefault(groups.of(place), []).append((doc_id is None, doc_id))
    assert sorted(((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()), key=str) == sorted((min(v) for v in best.values()), key=str)
    assert simhash.keep_one(no_documents(spark)).count() == 0


def test_near_copies_of_large_groups(spark, monkeypatch):
    """Two large groups and a text near both only through one member."""
    monkeypatch.setattr(simhash, "LARGE_GROUP", 3)
    words = [f"w{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    change = lambda base, k: " ".join(base[:k] + [f"x{k}"] + base[k + 1:])
    texts = [change(words, k) for k in range(5, 150, 10)] + [change(other, k) for k in range(5, 150, 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {jaccard_groups(texts).of(i) for i in range(len(texts))}
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want == {0, 15}


def test_near_groups_equal_exact_similarity_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(documents())
    groups = jaccard_groups([t or "" for _, t in rows])
    want = {rows[min(p for p in range(len(rows)) if groups.of(p) == g)][0] for g in {groups.of(p) for p in range(len(rows))}}
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want


def test_shards_match_the_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    rows = sharding.interleave(docs, 8).collect()
    by_shard, by_both, by_source = {}, {}, {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        by_both[r["shard"], r["source"]] = by_both.get((r["shard"], r["source"]), 0) + 1
        by_source[r["source"]] = by_source.get(r["source"], 0) + 1
    assert set(by_shard) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(abs(by_both.get((s, x), 0) - n / 8) < 2 for x, n in by_source.items() for s in range(8))


def test_shards_of_odd_rows(spark):
    rows = sharding.interleave(odd_documents(spark), 5, order=("doc_id", "text")).collect()
    assert len(rows) == len(odd_rows()) and isinstance(rows[0]["shard"], int)
    assert sharding.interleave(no_documents(spark), 5).count() == 0


@pytest.mark.parametrize("texts", [None, "table"])
def test_packing_holds_every_id_once(spark, texts):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t, *_ in odd_rows()] if texts is None else documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    packed = packing.pack(packing.token_pieces(docs, keep_ids=True))
    found = packed.collect()
    want = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want.append((doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    key = lambda x: (str(x[0]), *x[1:5])
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], list(r["ids"])) for r in found], key=key) == sorted(want, key=key)
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by) == max(-(-sum(w[3] for w in want) // 4096), sum(w[3] > 2048 for w in want))
    assert sum(len(r["ids"]) for r in packing.sequences(packed).collect()) == sum(w[3] for w in want)


def test_packing_of_nothing(spark):
    assert packing.pack(packing.token_pieces(no_documents(spark))).count() == 0


@pytest.mark.parametrize("counts", [{4096: 3}, {1: 10000}, {3000: 7, 1096: 7}, {2000: 5, 1000: 5, 1096: 5}, {2049: 9}, {1366: 6, 1365: 6}, {7: 1}, {}])
def test_plans_use_every_length(counts):
    plan = packing.plan_sequences(counts, 4096)
    used = {}
    for pattern, repeats in plan:
        assert sum(x * n for x, n in pattern.items()) <= 4096
        for length, n in pattern.items():
            used[length] = used.get(length, 0) + n * repeats
    assert used == counts
    total = sum(length * n for length, n in counts.items())
    assert sum(n for _, n in plan) == max(-(-total // 4096), sum(n for length, n in counts.items() if length > 2048))


def brute_base(text):
    text = text or ""
    kinds = [
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
         r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    spans = [(m.start(), k, name, m.end()) for k, (name, p, keep) in enumerate(kinds) for m in re.finditer(p, text) if keep(m)]
    return [f"{name}:{start}:{end}" for start, _, name, end in sorted(spans)]


def test_secret_spans(spark):
    import hashlib

    random = "Zq7XvT9pLw3RkY8sBn2HdJ5m"
    extra = [(90_000, f"key {random} end"), (91_000, "id 123e4567-e89b-42d3-a456-426614174000 ok"), (92_000, "PASSWORD:ſecret TOKEN=abc"), (93_000, "é" * 5 + f" {random}")]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in odd_rows()] + extra + documents(), "doc_id long, text string")
    texts = [t for _, t, *_ in odd_rows()] + [t for _, t in extra + documents()]
    rows = secrets.scan_secrets(docs).collect()
    assert len(rows) == len(texts)
    got = sorted(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] != "token") for r in rows)
    assert got == sorted(",".join(brute_base(t)) for t in texts)
    token = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "token"] for r in rows}
    assert token[90_000] == [(4, 28)] and token[93_000] == [(6, 30)] and not token[91_000] and not token[92_000]
    assert not any(v for k, v in token.items() if k is not None and k < 90_000 and v != [(26, 46)] and k != 14)
    digests = {r["base_sha256"] for r in catalog.queries()["op6_secrets"](spark, SF).collect()}
    assert digests == {hashlib.sha256(",".join(brute_base(t)).encode()).hexdigest() for _, t in documents()}


def test_keys_behind_readable_text_are_found():
    import random
    import string

    dice = random.Random(7)
    for letters in (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_"):
        for size in (20, 24, 32, 40):
            for front in ("com/services/webhooks/integration/", "account/production/configuration/credentials/", "deployment_key=", ""):
                keys = ["".join(dice.choice(letters) for _ in range(size)) for _ in range(100)]
                keys = [k for k in keys if secrets.is_random(k) and k[0].isalnum() and k[-1].isalnum()]
                hits = sum(any(k == 3 and a <= 4 + len(front) and b >= 4 + len(front) + size for a, k, b in secrets.find(f"see {front}{key} end"))
                           for key in keys)
                assert hits >= 0.99 * len(keys) and len(keys) > 80, (letters[-2:], size, front, hits, len(keys))
    digest = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    for quiet in ("id=123e4567-e89b-42d3-a456-426614174000", f"sha256={digest}", f"objects/{digest}/123e4567-e89b-42d3-a456-426614174000",
                  "src/main/java/com/example/service/CustomerAccountController", "posts/2024/01/introduction-to-distributed-systems-part2"):
        assert not [x for x in secrets.find(f"see {quiet} end") if x[1] == 3], quiet
    key = "Zq7XvT9pLw3RkY8sBn2HdJ5m"
    assert secrets.masked(f"hooks/{digest}/{key} end") == "hooks/[SECRET]/[SECRET] end"


def test_redaction_masks_and_keeps_the_rest(spark):
    docs = odd_documents(spark)
    kept = secrets.redact_secrets(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    row = kept.where("doc_id = 14").first()
    assert row["text"] == '[SECRET]" and [SECRET] plus [SECRET] end' and row["n_chars"] == len(row["text"])
    assert kept.where("doc_id = 10").first()["text"] == prose(2, 60)
    assert secrets.redact_secrets(no_documents(spark)).count() == 0


def test_fm_index_finds_what_a_scan_finds():
    import numpy as np

    random = np.random.default_rng(3)
    for n, kinds in ((1, 3), (50, 2), (400, 4), (3000, 40)):
        symbols = np.concatenate((random.integers(1, kinds + 1, n), [0]))
        if n == 400:
            symbols[:-1] = np.tile(symbols[:20], 20)  # one long repeat
        order = decontaminate.suffix_array(symbols)
        plain = sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        assert order.tolist() == plain
        index = decontaminate.FMIndex(symbols, sample=5)
        for size in (1, 2, 3):
            if n < size:
                continue
            patterns = np.array([symbols[i:i + size] for i in random.integers(0, n - size + 1, 20)] + [[kinds + 7] * size])
            for pattern, low, high in zip(patterns, *index.search(patterns)):
                want = [i for i in range(len(symbols) - size + 1) if (symbols[i:i + size] == pattern).all()]
                assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def test_benchmark_passages_are_cut(spark, monkeypatch):
    item = prose(2, 60)
    items = spark.createDataFrame([(1, item), (1, item), (2, "two words"), (3, None), (None, prose(9, 30)), (4, "")], "item_id long, text string")
    docs = odd_documents(spark)
    whole = decontaminate.find_phrases(docs.drop("_spans"), items).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)  # several passes
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 20)
    parts = decontaminate.find_phrases(docs.drop("_spans"), items).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))
    hit = {r["doc_id"]: (r["_items"], [tuple(s) for s in r["_spans"]]) for r in whole if r["_items"]}
    assert hit == {10: (["1"], [(0, 60)]), 15: (["1"], [(0, 60)])}
    cut = decontaminate.remove_phrases(docs, items)
    assert cut.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[10] == "" and texts[15].strip(" .") == prose(4, 60).strip(" .") and texts[11] == prose(3, 5000) and texts[5] is None
    assert decontaminate.remove_phrases(no_documents(spark), items).count() == 0
    assert decontaminate.remove_phrases(docs, items.limit(0)).count() == docs.count()


def plain_parts(text):
    """Start, end and number of words of every part, by the rules of the module's docstring and nothing of its code."""
    cut = [0]
    for gap in re.finditer(r"\s*\n\s*|(?<=[.!?])\s+|(?<=[。！？।॥])\s*|\s+(?=\S)", text):
        after, blank = text[gap.end():gap.end() + 1], gap[0].strip("\n") == gap[0] and "\n" not in gap[0]
        if blank and gap[0] and text[gap.start() - 1:gap.start()] not in tuple(".!?。！？।॥") and not (after.isupper() and ord(after) < 0x600):
            continue
        cut += [gap.start(), gap.end()]
    cut.append(len(text.rstrip()))
    out = []
    sign = f"[{sentences.BLANKLESS}]"
    for start, end in zip(cut[::2], cut[1::2]):
        words = [m.span() for m in re.finditer(rf"{sign}|(?:(?!{sign})\S)+", text[:end]) if m.start() >= start]
        if not words:
            continue
        at = {0}
        if len(words) > 12:
            hashes = [zlib.crc32(text[x:y].encode()) for x, y in words]
            for i in range(len(words) - 8):
                window = hashes[i:i + 9]
                at.add(max(i + j for j in range(9) if window[j] == min(window)))
        at = [*sorted(at), len(words)]
        if len(words) <= 12:
            out.append((start, end, len(words)))
        else:
            out += [(words[x][0], words[y - 1][1], y - x) for x, y in zip(at, at[1:])]
    return out


def plain_drop(rows):
    """Texts in order of doc_id without what any earlier span covers; ``rows`` of one id are one document."""
    first, out = {}, {}
    for doc_id, text in rows:
        found, gone, mine = plain_parts(text), set(), set()
        for i in range(len(found)):
            for j in range(i + 2, len(found) + 1):
                if sum(n for _, _, n in found[i:j]) >= 15:
                    span = " ".join(" ".join(text[x:y].split()) for x, y, _ in found[i:j])
                    if first.setdefault(span, doc_id) != doc_id or span in mine:
                        gone.update(range(i, j))
                    mine.add(span)
                    break
        new, at = "", 0
        for i, (start, end, _) in enumerate(found):
            if i in gone:
                new, at = new + text[at:start], end
                while at < len(text) and text[at].isspace():
                    at += 1
        out[doc_id] = new + text[at:]
    return out


def test_repeated_sentences_against_a_scan(spark):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in odd_rows() if i is not None] + [(1000 + i, t) for i, t in documents()], "doc_id long, text string").distinct()
    want = plain_drop(sorted((r["doc_id"], r["text"] or "") for r in docs.collect()))
    for name in ("_late", "_doc", "_body", "_later", "a", "start", "own", "n"):
        docs = docs.withColumn(name, F.lit(name))
    rows = sentences.drop_repeats(docs).collect()
    assert {r["doc_id"]: r["text"] or "" for r in rows} == want
    assert all(r["_late"] == "_late" and r["_later"] == "_later" and r["own"] == "own" for r in rows)


def test_a_pasted_passage_goes_from_all_but_the_first(spark):
    passage = prose(77, 63)
    texts = [(i, f"{prose(100 + i, 40).rstrip('.')} and {passage} {prose(200 + i, 40)}") for i in range(1, 5)]
    docs = spark.createDataFrame([*texts, (9, prose(300, 80)), (None, f"word {passage} tail"), (None, f"other {passage} tail")], "doc_id long, text string")
    rows = {(r["doc_id"], r["text"]): r for r in sentences.drop_repeats(docs).collect()}
    by_id = {i: r for (i, _), r in rows.items() if i is not None}
    assert by_id[1]["text"] == texts[0][1] and by_id[9]["n_removed"] == 0
    assert all(passage[10:] not in by_id[i]["text"] and by_id[i]["n_removed"] >= 5 for i in (2, 3, 4))
    assert all(passage[10:] not in t for i, t in rows if i is None)
    odd = sentences.drop_repeats(odd_documents(spark))
    assert odd.count() == len(odd_rows()) and sentences.drop_repeats(no_documents(spark)).count() == 0


def test_rows_that_share_an_id_lose_only_their_own_repeats(spark):
    passage, other = prose(501, 60), prose(502, 60)
    docs = spark.createDataFrame([(1, passage), (2, passage), (2, other)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in sentences.drop_repeats(docs).collect()) == sorted([(1, passage), (2, ""), (2, other)])


def test_any_fifty_common_words_hold_a_span():
    import random

    dice = random.Random(11)
    lower = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    signed = [*lower, *[w.capitalize() for w in lower[:4]], *[w + "." for w in lower[4:9]], *[w + "," for w in lower[9:30]]]
    for k in range(1500):
        words = (lower, signed, [*signed[:100], *["Abc."] * (k % 40)], lower[:1 + k % 3])[k % 4]
        text = lambda n: " ".join(dice.choice(words) for _ in range(n))  # noqa: E731, B023
        passage = text(50)
        one, two = (f"{text(dice.randrange(40))} {passage} {text(dice.randrange(40))}" for _ in "ab")
        assert {s[:2] for s in sentences.spans(one)[1]} & {s[:2] for s in sentences.spans(two)[1]}, (one, two)
    signs = [chr(0x4E00 + i) for i in range(300)]
    for _ in range(100):
        text = lambda n: "".join(dice.choice(signs) for _ in range(n))
        passage = text(50)
        one, two = text(30) + passage + text(25), text(17) + passage + text(40)
        assert {s[:2] for s in sentences.spans(one)[1]} & {s[:2] for s in sentences.spans(two)[1]}
    whole = "天" * 3 + passage + "。" + passage + "地" * 3
    places, found = sentences.spans(whole)
    again = [(places[x][0], places[y - 1][1]) for i, (a, b, x, y) in enumerate(found) if (a, b) in {s[:2] for s in found[:i]}]
    new, removed = sentences.cut_out(whole, again)
    assert len(sentences.sentences(whole)) == 2 and removed and len(new) < 80


def test_quality_on_held_out_rows(spark):
    sf = str(TESTDATA / "sf0.01")
    rows = catalog.queries()["op8_quality"](spark, sf).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    checked = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(a == b for a, b in checked) / len(checked) >= 0.95


def test_machine_uses_the_sum_of_squares_identity():
    import numpy as np

    machine = quality.Machine(0.5)
    rows = [(quality.statistics(prose(i, 30 + i), None), quality.words_of(prose(i, 30 + i))) for i in range(8)]
    machine.fit(rows, np.array([0, 1] * 4, float), np.ones(8))
    index, value = machine.vector(*rows[0])
    pairs = sum(machine.factors[index[i]] @ machine.factors[index[j]] * value[i] * value[j] for i in range(len(index)) for j in range(i))
    assert np.isclose(machine.raw(index, value)[0], machine.bias + machine.weights[index] @ value + pairs)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 16)] + [(1, None), (None, 1)], "doc_id long, quality int")
    scored = quality.score_quality(odd_documents(spark), quality.learn(odd_documents(spark), labels)).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (1, 2, 4)}) == 1
    assert quality.learn(odd_documents(spark), labels.limit(0)).score("x", None) == 0.5
    assert quality.score_quality(no_documents(spark), quality.Machine(0.5)).count() == 0


def test_language_of_held_out_rows(spark):
    sf = str(TESTDATA / "sf0.01")
    rows = catalog.queries()["op9_language"](spark, sf).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.97


def test_language_mixtures_and_odd_rows(spark):
    sf = str(TESTDATA / "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.learn(docs)
    by = {}
    for lang, text in duckdb.sql(f"SELECT lang, text FROM '{sf}/documents.parquet' WHERE n_chars > 800 ORDER BY doc_id").fetchall():
        by.setdefault(lang, text[:600])
    (mixed,) = language.predict([by["en"] + " " + by["de"][:400]], *model)
    assert mixed[0] == "en" and 0.4 < mixed[1] < 0.9
    assert language.predict([None, "", "123 !?", "e"], *model)[:3] == [("und", 0.0, 0.0)] * 3
    assert language.predict(["Text"], [], model[1][:, :0])[0][0] == "und"
    long = by["fr"] * 2000
    assert language.predict([long], *model)[0][0] == "fr"
    found = language.identify(odd_documents(spark), model)
    assert found.count() == len(odd_rows())
    kept = language.keep_identified(odd_documents(spark), model)
    assert kept.columns == odd_documents(spark).columns
    assert not kept.where("text IS NULL OR doc_id IN (6, 7, 12)").count()
    assert language.identify(no_documents(spark), model).count() == 0
    assert language.learn(no_documents(spark))[0] == []
