"""Neighbour search, archive audit and the pipeline against plain re-implementations."""

import gzip
import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.cases import jaccard_groups, no_documents, odd_documents
from tests.oracle_check import TESTDATA
from thermocline.llm import ann, catalog, decontaminate, secrets, warc
from thermocline.session import scratch_path

SF = str(TESTDATA / "sf0.001")


def brute_neighbours(rows, asked, k=10):
    """(query, rank, id, distance) over valid rows (id, vector)."""
    out = []
    for query, vector in asked:
        own, found = False, []
        for i, other in rows:
            if not own and i == query and other == vector:
                own = True
                continue
            found.append((float(np.sqrt(((np.array(other) - np.array(vector)) ** 2).sum())), i))
        out += [(query, rank, i, d) for rank, (d, i) in enumerate(sorted(found)[:k], 1)]
    return out


def test_recall_on_the_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding::DOUBLE[] FROM '{SF}/embeddings.parquet'").fetchall()
    want = brute_neighbours(rows, [r for r in rows if r[0] % 100 == 0])
    got = {(r["query_id"], r["vec_id"]): r for r in catalog.queries()["op4_ann"](spark, SF).collect()}
    near = [w for w in want if (w[0], w[2]) in got]
    assert len(near) / len(want) >= 0.95 and len(got) == len(want)
    assert all(abs(got[q, i]["score"] - d) < 1e-12 for q, _, i, d in near)


def test_copies_ties_and_vectors_that_take_no_part(spark):
    random = np.random.default_rng(5)
    rows = [(i, [float(x) for x in random.normal(size=5)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(200, rows[1][1]), (200, rows[1][1])]
    odd = [(300, None), (301, [0.0] * 5), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [float("nan")] + [1.0] * 4),
           (304, [float("inf")] + [1.0] * 4), (305, [1.0, 2.0]), (306, []), (None, rows[2][1])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    found = ann.search(table, table.where("vec_id % 100 = 0"))
    want = brute_neighbours(rows, [rows[0], (100, rows[0][1]), (200, rows[1][1])])
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()) == sorted(w[:3] for w in want)


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_few_vectors_are_all_returned(spark, n):
    rows = [(i * 100, [float(i + 1), float(-i), 3.0]) for i in range(n)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(table, table.where("vec_id % 100 = 0"))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()) == sorted(w[:3] for w in brute_neighbours(rows, rows))


def test_hadamard_is_orthogonal():
    turned = ann.hadamard(np.eye(16))
    assert np.allclose(turned @ turned.T, np.eye(16))


PAGES = "page_id long, url string, html string, record string, file int"


def odd_pages(spark):
    rows = [(1, "http://a/", "<p>x</p>", "r", 7), (1, "http://a/", "<p>x</p>", "r", 7), (2, None, "b\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "r", 7),
            (None, "http://b/\r\nX: y", None, None, None), (3, "u", "", "r", 1), (4, "u", "é漢" * 70000, "r", 1), (5, "u", "plain", "r", 1)]
    return spark.createDataFrame(rows, PAGES)


def test_archive_round_trip(spark):
    placed = warc.lay_out(warc.records(odd_pages(spark)), 50_000)
    path = scratch_path(spark, "test-warc")
    warc.write_archive(placed, path)
    columns = ["file", "offset", "length", "page_id", "digest"]
    want = sorted(map(str, placed.select(columns).collect()))
    assert len({r["file"] for r in placed.collect()}) > 1
    assert sorted(map(str, warc.read_archive(spark, path).select(columns).collect())) == want
    replica = warc.read_archive(spark, path)
    assert warc.audit(placed.select(columns), replica).count() == 0


def test_damaged_bytes_are_located():
    record = b"WARC/1.1\r\nWARC-Page-ID: %d\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    good = [record % i for i in range(3)]
    whole = list(warc.parse(b"".join(good)))
    assert [p for _, _, p, _ in whole] == [0, 1, 2]
    broken = list(warc.parse(good[0] + b"XARC" + good[1][4:] + good[2]))
    assert [p for _, _, p, _ in broken] == [0, None, 2] and [b[:2] for b in broken][::2] == [w[:2] for w in whole][::2]
    assert [p for _, _, p, _ in warc.parse(good[0] + good[1][:-6])] == [0, None] and not list(warc.parse(b""))


def test_audit_tells_what_is_wrong(spark):
    step = 400_000
    rows = [(f, i * step, 10, f * 1000 + i, f"d{f}-{i}") for f in range(2) for i in range(120)]
    schema = "file int, offset long, length long, page_id long, digest string"
    other = [r for r in rows if r[3] not in (5, 1050)] + [(1, 130 * step, 10, 5, "d0-5"), (0, 200 * step, 10, 77_777, "new")]
    other = [(*r[:4], "bad") if r[3] in (0, 1119) else r for r in other]
    found = warc.audit(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)).collect()
    assert sorted((r["file"], r["offset"] // step, r["status"]) for r in found) == [
        (0, 0, "altered"), (0, 5, "moved"), (0, 200, "extra"), (1, 50, "missing"), (1, 119, "altered"), (1, 130, "moved")]


def test_replica_is_an_archive_of_its_own(spark):
    pages = spark.range(0, 3000).selectExpr("id AS page_id", "concat('http://', id) AS url", "repeat(concat('p', id % 7), 40) AS html")
    path, copy = scratch_path(spark, "test-first"), scratch_path(spark, "test-second")
    warc.write_archive(warc.lay_out(warc.records(pages), 400_000), path)
    warc.write_damaged(spark, path, copy)
    a, b = warc.read_archive(spark, path), warc.read_archive(spark, copy)
    fate = {i: int(hashlib.md5(b"fault|%d" % i).hexdigest()[:8], 16) % 97 for i in range(3000)}
    want = {i: ("altered", "missing")[v] for i, v in fate.items() if v < 2}
    got = [(r["page_id"], r["status"]) for r in warc.audit(a, b).where("status <> 'shifted'").collect()]
    assert len(set(want.values())) == 2 and sorted(got) == sorted(want.items())
    assert b.where("held IS NOT NULL").count() > 0 and b.count() < 3000


def test_cut_and_broken_files_of_a_replica_are_read(spark):
    pages = spark.range(0, 400).selectExpr("id AS page_id", "'u' AS url", "sha2(cast(id AS string), 512) AS html")
    path, copy = scratch_path(spark, "test-whole"), Path(scratch_path(spark, "test-cut").removeprefix("file:"))
    warc.write_archive(warc.lay_out(warc.records(pages), 60_000), path)
    files = sorted(Path(path.removeprefix("file:")).rglob("part-*"))
    for k, file in enumerate(files):
        content = file.read_bytes()
        to = copy / file.parent.name / file.name
        to.parent.mkdir(parents=True)
        to.write_bytes((content[:len(content) // 2], content[:-9] + b"X" + content[-8:], content)[min(k, 2)])
    found = warc.audit(warc.read_archive(spark, path), warc.read_archive(spark, str(copy))).collect()
    at = {}
    for r in found:
        at.setdefault(r["file"], []).append(r["status"])
    assert len(files) > 2 and set(at) <= {0, 1} and at[0].count("missing") > 10 and len(at.get(1, [])) <= 4


def test_a_broken_stream_is_decoded_up_to_the_break():
    plain = b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(9000))
    packed = gzip.compress(plain)
    assert warc.inflate(packed) == plain and warc.inflate(packed + packed) == plain * 2 and warc.inflate(b"") == b""
    assert warc.inflate(packed[:-5]) == plain and plain.startswith(warc.inflate(packed[:150_000])) and len(warc.inflate(packed[:150_000])) > 100_000
    assert warc.inflate(packed[:-8] + b"\0" * 8) == plain


def test_records_are_aligned_behind_a_loss():
    a = [(i * 14, 10, i, f"d{i}", None) for i in range(8)]
    b = [(0, 10, 0, "d0", None), (14, 28, None, "bad", [2, 3]), (42, 10, 5, "d5", None), (56, 10, 4, "d4", None),
         (70, 14, None, "hole", []), (84, 10, 7, "d7", None), (98, 10, 99, "new", None)]
    got = {(r[0] // 14, r[5], r[1] is None) for r in warc.align(a, b)}
    assert {(1, "missing", False), (2, "altered", False), (3, "altered", False), (6, "altered", False), (7, "shifted", False),
            (7, "extra", True)} <= got
    assert sum(s == "moved" for _, s, _ in got) == 2 and len(got) == 9


def test_no_pages(spark):
    placed = warc.lay_out(warc.records(odd_pages(spark).limit(0)))
    columns = placed.select("file", "offset", "length", "page_id", "digest")
    assert placed.count() == 0 and warc.audit(columns, columns).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = sorted(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    groups = jaccard_groups([t for _, t in docs])
    kept = [docs[p] for p in range(len(docs)) if groups.of(p) == p]
    windows = set()
    for (text,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall():
        words = decontaminate.words_of(text)
        windows |= {tuple(words[i:i + 10]) for i in range(max(1, len(words) - 9))}
    sizes = {len(w) for w in windows}
    want = []
    for doc_id, text in kept:
        words = decontaminate.words_of(text)
        hit = sorted({p for n in sizes for i in range(len(words) - n + 1) if tuple(words[i:i + n]) in windows for p in range(i, i + n)})
        runs = [{"start": p, "end": next(q for q in range(p, len(words) + 1) if q not in hit)} for p in hit if p - 1 not in hit]
        text = secrets.masked(decontaminate.without_spans(text, runs))
        from thermocline.llm import packing
        ids = packing.tokens(packing.TOKENIZER).of(text) + np.array([1], "<u4").tobytes()
        want += [(doc_id, k, at // 4, zlib.crc32(ids[at:at + 16384])) for k, at in enumerate(range(0, len(ids), 16384))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in rows) == sorted(want)


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_stages_take_odd_rows_and_none(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        stage(spark, docs, SF).count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() >= docs.count()
