"""WARC archives and their Merkle fixity audit.

``write_archive`` lays records out in files of bounded size and writes them as
WARC 1.1 with Spark's text writer (the record separator of the format is its line
separator); ``read_archive`` reads files back record by record, by their declared lengths. A
file's records are hashed, the records of each ordered offset range of ``RANGE_BYTES`` into a node, and
``FANOUT`` neighbouring nodes into the next, up to one root per file.

``audit`` compares the roots of two replicas and descends only branches that
differ: each level reads just the children of differing nodes, down to the
records. There the records of a file are aligned by page id and bytes, since a lost record shifts
all that follow it. They differ as ``altered`` (other bytes), ``missing``, ``extra``, ``moved`` (the same bytes
out of order or in another file), or only ``shifted`` (the same bytes in order at another offset).

The replica that the query audits is a second archive: the files of the first are read, damaged
and written again, and read back by their own scan.

Defined results: null url and html are empty ones, line breaks in a url become blanks; null
page ids are written empty and read back as null; rows equal in all three are separate records, in any order among
themselves; bytes that are no record are read as one damaged range up to the next record
start; a file whose compressed stream is cut or broken is read as far as it can be decoded; a damaged range
alters the records whose page ids it still holds, or else those that fill its length; an empty table has no files, no nodes and no rows. Layout, leaves and nodes are tables by file and
offset, nothing is gathered beyond one range or one file.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from thermocline.llm.common import discard, read_table, store, tidy, with_workers
from thermocline.session import scratch_path

FILE_BYTES = 32 << 20
RANGE_BYTES = 1 << 20
FANOUT = 16
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
START = re.compile(rb"WARC/1\.1\r\n")
LENGTH = re.compile(rb"(?:^|\r\n)Content-Length: (\d{1,18})(?:\r\n|$)")
PAGE = re.compile(rb"(?:^|\r\n)WARC-Page-ID: (-?\d{1,19})(?:\r\n|$)")


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def records(pages: DataFrame) -> DataFrame:
    """page_id and the WARC record (a string, without its closing separator) of each page."""
    html = F.coalesce("html", F.lit(""))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    name = F.md5(F.concat(page, F.lit("|"), url))
    uuid = F.concat_ws("-", *[F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Page-ID: "), page, F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(html, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(END), html,
    ]
    return pages.select("page_id", F.concat(*head).alias("record"))


def lay_out(rows: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``rows`` with file, offset and length; files are filled by hash to about ``file_bytes``."""
    size = F.octet_length("record").cast("long")
    total = rows.agg(F.sum(size + len(END))).first()[0] or 0
    files = -(-total // file_bytes) or 1
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    placed = rows.withColumn("length", size).withColumn("digest", F.sha2("record", 256)).withColumn(
        "file", (_bits(F.concat(page, F.lit("|"), "digest")) % files).cast("int"))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum(F.col("length") + len(END)).over(before), F.lit(0)))


def write_archive(placed: DataFrame, path: str) -> None:
    """One compressed WARC file per ``file``, its records by offset.

    ``lay_out`` and a scan of files leave each file in one partition, so nothing is moved again.
    """
    (placed.sortWithinPartitions("file", "offset").select("file", "record")
     .write.partitionBy("file").option("lineSep", END).option("compression", "gzip").text(path))


def inflate(content: bytes, step: int = 1 << 16) -> bytes:
    """The bytes of a gzip file, up to where it is cut or broken."""
    whole, out = content, []
    while content:
        stream = zlib.decompressobj(wbits=31)
        try:
            for at in range(0, len(content), step):
                out.append(stream.decompress(content[at:at + step]))
                if stream.eof:
                    content = stream.unused_data + content[at + step:]
                    break
            else:
                out.append(stream.flush())
                break
        except zlib.error:
            if step > 1:  # a failing call gives nothing of its step
                return inflate(whole, 1)
            break
    return b"".join(out)


def parse(content: bytes) -> Iterator[tuple[int, int, int | None, str]]:
    """Offset, length, page id and SHA-256 of each record, and of each damaged range."""
    for at, length, page, digest, _ in scan(content):
        yield at, length, page, digest


def scan(content: bytes) -> Iterator[tuple[int, int, int | None, str, list[int] | None]]:
    """As ``parse``, with the page ids that a damaged range holds (null for a record)."""
    at, end = 0, len(content)
    while at < end:
        head = content.find(END.encode(), at) if START.match(content, at) else -1
        declared = LENGTH.search(content[at:head]) if head >= 0 else None
        stop = head + len(END) + int(declared[1]) if declared else 0
        if declared and content[stop:stop + len(END)] == END.encode():
            page = PAGE.search(content[at:head])
            yield at, stop - at, int(page[1]) if page else None, hashlib.sha256(content[at:stop]).hexdigest(), None
            at = stop + len(END)
        else:
            following = START.search(content, at + 1)
            stop = following.start() if following else end
            held = [int(x) for x in PAGE.findall(content[at:stop]) if -(1 << 63) <= int(x) < 1 << 63]
            yield at, stop - at, None, hashlib.sha256(content[at:stop]).hexdigest(), held
            at = stop


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Leaves (file, offset, length, page_id, digest, held) of an archive that ``write_archive`` wrote."""
    with_workers(spark)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                found = list(zip(*scan(inflate(content.as_py())))) or [[]] * 5
                offset, length, page, digest, held = [list(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(offset), pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(page, pa.int64()), pa.array(digest, pa.string()), pa.array(held, pa.list_(pa.int64()))],
                    ["file", "offset", "length", "page_id", "digest", "held"])

    return _files(spark, path).mapInArrow(
        tidy(leaves), "file int, offset long, length long, page_id long, digest string, held array<long>")


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("int").alias("file"), "content")


def _grouped(children: DataFrame, place: Column, parts: list[str]) -> DataFrame:
    """Nodes over neighbouring children: the hash of their ordered descriptions."""
    ordered = F.sort_array(F.collect_list(F.struct(*parts)))
    text = F.concat_ws(";", F.transform(ordered, lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts])))
    return children.groupBy("file", place.alias("node")).agg(F.sha2(text, 256).alias("digest"))


def tree(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the records up to one node per file; ``height`` levels stand above the ranges."""
    levels = [leaves, store(_grouped(leaves, F.expr(f"offset div {RANGE_BYTES}"), ["offset", "length", "digest"]), "ranges")]
    for _ in range(height):
        levels.append(_grouped(levels[-1], F.expr(f"node div {FANOUT}"), ["node", "digest"]))
    return levels


def height_of(*replicas: DataFrame) -> int:
    """Levels needed so that the longest file ends in one node."""
    last = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas) // RANGE_BYTES
    height = 0
    while last:
        last, height = last // FANOUT, height + 1
    return height


def _differing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    both = a.select("file", key, F.col("digest").alias("digest_a")).join(
        b.select("file", key, F.col("digest").alias("digest_b")), ["file", key], "full")
    return both.where("NOT (digest_a <=> digest_b)")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differing records of two replicas' leaves: file, offset, digest_a, digest_b and what is wrong with b."""
    height = height_of(a, b)
    levels_a, levels_b = tree(a, height), tree(b, height)
    wrong = store(_differing(levels_a[-1], levels_b[-1], "node").select("file", "node"), "branches")
    for level in range(height, 0, -1):
        parent = F.expr(f"node div {FANOUT}")
        below = [side[level].withColumn("parent", parent).join(
            wrong.select("file", F.col("node").alias("parent")), ["file", "parent"], "left_semi") for side in (levels_a, levels_b)]
        following = store(_differing(*below, "node").select("file", "node"), "branches")
        discard(wrong)
        wrong = following
    columns = ["file", "offset", "length", "page_id", "digest"]
    inside = [side[0].withColumn("node", F.expr(f"offset div {RANGE_BYTES}")).join(wrong, ["file", "node"], "left_semi").select(
        *columns, F.col("held") if "held" in side[0].columns else F.lit(None).cast("array<long>").alias("held"),
        F.lit(name).alias("side")) for side, name in zip((levels_a, levels_b), "ab")]
    with_workers(a.sparkSession)
    found = store(inside[0].unionByName(inside[1]).groupBy("file").applyInArrow(
        _aligned, "file int, offset long, digest_a string, digest_b string, page_a long, page_b long, status string"), "differing")
    discard(wrong)
    # A record that is gone here and new in another file with the same bytes has moved.
    open_ = found.where("status IN ('altered', 'missing', 'extra')")
    gone = open_.where("digest_a IS NOT NULL").select(F.col("page_a").alias("page"), F.col("digest_a").alias("bytes")).distinct()
    new = open_.where("digest_b IS NOT NULL").select(F.col("page_b").alias("page"), F.col("digest_b").alias("bytes")).distinct()
    moved = gone.join(new, gone.page.eqNullSafe(new.page) & (gone.bytes == new.bytes)).select(
        gone.bytes.alias("bytes"), F.lit(True).alias("moved")).distinct()
    named = found.join(moved, (F.coalesce("digest_a", "digest_b") == F.col("bytes")) & (F.col("status") != "shifted"), "left")
    return named.select("file", "offset", "digest_a", "digest_b", F.coalesce("page_a", "page_b").alias("page_id"),
                        F.when(F.col("moved"), "moved").otherwise(F.col("status")).alias("status"))


def _aligned(table: pa.Table) -> pa.Table:
    """The differing records of one file, whose size is bounded."""
    rows = table.select(["side", "offset", "length", "page_id", "digest", "held"]).to_pydict()
    sides: dict[str, list[tuple]] = {"a": [], "b": []}
    for side, *row in zip(*rows.values()):
        sides[side].append(tuple(row))
    file = table.column("file")[0].as_py()
    ordered = [sorted(sides[x], key=lambda r: r[0]) for x in "ab"]
    out = align(*ordered, _stretches([x[:2] for side in ordered for x in side]))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*out) if out else [[]] * 6
    return pa.Table.from_arrays(
        [pa.array([file] * len(out), pa.int32()), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]],
        ["file", "offset", "digest_a", "digest_b", "page_a", "page_b", "status"])


def _stretches(places: list[tuple[int, int]]) -> dict[int, int]:
    """Number of the stretch of differing ranges that each range belongs to; equal ranges part them."""
    ranges = set()
    for offset, length in places:
        ranges.add(offset // RANGE_BYTES)
        ranges.update(range(-(-offset // RANGE_BYTES), (offset + length) // RANGE_BYTES))  # filled by one record
    out, number, last = {}, 0, None
    for node in sorted(ranges):
        number += last is not None and node > last + 1
        out[node], last = number, node
    return out


def align(a: list[tuple], b: list[tuple], stretches: dict[int, int] | None = None) -> list[tuple]:
    """(offset, digest_a, digest_b, page_a, page_b, status) of what differs between two ordered lists of leaves.

    Leaves are (offset, length, page id, digest, page ids held by a damaged range or null).
    """
    places = defaultdict(deque)
    for j, (_, _, page, digest, _) in enumerate(b):
        places[page, digest].append(j)
    same = [(i, places[page, digest].popleft()) for i, (_, _, page, digest, _) in enumerate(a) if places[page, digest]]
    kept = _in_order(same)
    out, anchors_a, anchors_b = [], [i for i, _ in kept], [j for _, j in kept]
    for i, j in kept:
        if a[i][0] != b[j][0]:
            out.append((a[i][0], a[i][3], b[j][3], a[i][2], b[j][2], "shifted"))
    for i, j in sorted(set(same) - set(kept)):
        out.append((a[i][0], a[i][3], None, a[i][2], None, "moved"))
        out.append((b[j][0], None, b[j][3], None, b[j][2], "moved"))

    matched_a, matched_b = {i for i, _ in same}, {j for _, j in same}
    left, new, used = [i for i in range(len(a)) if i not in matched_a], [j for j in range(len(b)) if j not in matched_b], set()
    stretch = lambda leaf: (stretches or {}).get(leaf[0] // RANGE_BYTES)
    gap_a = {i: (bisect_left(anchors_a, i), stretch(a[i])) for i in left}
    gap_b = {j: (bisect_left(anchors_b, j), stretch(b[j])) for j in new}

    def alter(i: int, j: int) -> None:
        used.add(j)
        out.append((a[i][0], a[i][3], b[j][3], a[i][2], b[j][2], "altered"))

    # Another record with the page's id; then a damaged range between the same neighbours that holds the id.
    pages, holders, still = defaultdict(deque), defaultdict(deque), []
    for j in new:
        if b[j][2] is not None:
            pages[b[j][2]].append(j)
        for page, n in Counter(b[j][4] or ()).items():
            holders[gap_b[j], page].extend([j] * n)
    for i in left:
        page = a[i][2]
        found = page is not None and (pages[page] or holders[gap_a[i], page])
        if found:
            alter(i, found.popleft())
        else:
            still.append(i)

    # Bytes without a known id: what stood at the place, or neighbours that fill the length.
    gaps = defaultdict(list)
    for i in still:
        gaps[gap_a[i]].append(i)
    for j in new:
        if j in used:
            continue
        mine = gaps[gap_b[j]]
        for at in _filled(b[j], [a[i] for i in mine]):
            alter(mine[at], j)
            mine[at] = None
        gaps[gap_b[j]] = [i for i in mine if i is not None]
    out += [(a[i][0], a[i][3], None, a[i][2], None, "missing") for left in gaps.values() for i in left]
    out += [(b[j][0], None, b[j][3], None, b[j][2], "extra") for j in new if j not in used]
    return out


def _in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs`` (ordered by their first place) whose second places rise too."""
    tails, ends, before = [], [], []
    for at, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        before.append(ends[k - 1] if k else -1)
        tails[k:k + 1], ends[k:k + 1] = [j], [at]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def _filled(found: tuple, lost: list[tuple]) -> range:
    """Places of neighbours in ``lost`` whose bytes ``found`` stands for; none if neither place nor length tells."""
    sizes = {found[1], found[1] + len(END)} if found[4] is None else {found[1]}
    for start in range(len(lost)):
        total = 0
        for end in range(start, len(lost)):
            total += lost[end][1] + len(END)
            if total in sizes:
                return range(start, end + 1)
            if total > found[1]:
                break
    at = next((k for k, x in enumerate(lost) if x[0] == found[0]), None)
    return range(0) if at is None else range(at, at + 1)


def damage(content: bytes) -> Iterator[bytes]:
    """The records of a file as a bad replica holds them: of 97 pages, about one altered and one lost."""
    for at, length, page, _ in parse(content):
        name = b"fault|%s" % (b"" if page is None else b"%d" % page)
        fate = int(hashlib.md5(name).hexdigest()[:8], 16) % 97
        if fate != 1:
            yield b"X" + content[at + 1:at + length] if fate == 0 else content[at:at + length]


def write_damaged(spark: SparkSession, path: str, replica: str) -> None:
    """A second archive from the stored files of the first, with the faults of ``damage``."""
    with_workers(spark)
    piece = 4 << 20

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * len(rows), pa.int32()), pa.array(range(n - len(rows), n), pa.int64()), pa.array(rows, pa.binary())],
                ["file", "offset", "record"])

        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                n, size, rows = 0, 0, []
                for record in damage(inflate(content.as_py())):
                    rows.append(record)
                    n, size = n + 1, size + len(record)
                    if size >= piece:
                        yield sent()
                        size, rows = 0, []
                yield sent()

    rows = _files(spark, path).mapInArrow(tidy(copy), "file int, offset long, record binary")
    write_archive(rows.withColumn("record", F.col("record").cast("string")), replica)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archive back, and audit a damaged replica against it.

    One row per record of the archive with its place, digest and state in the replica.
    """
    path, copy = scratch_path(spark, "warc"), scratch_path(spark, "warc-replica")
    write_archive(lay_out(records(read_table(spark, sf_dir, "pages"))), path)
    write_damaged(spark, path, copy)
    archive = store(read_archive(spark, path), "leaves")
    replica = store(read_archive(spark, copy), "replica")
    wrong = audit(archive, replica).where("digest_a IS NOT NULL AND status <> 'shifted'").select("file", "offset", "status")
    return archive.join(wrong, ["file", "offset"], "left").select(
        "page_id", "file", "offset", "length", "digest", F.coalesce("status", F.lit("intact")).alias("status"))


OP10_SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(page_id::VARCHAR, '') AS page, coalesce(html, '') AS body,
         regexp_replace(coalesce(url, ''), '[\\r\\n]', ' ', 'g') AS address FROM pages),
named AS (SELECT *, md5(page || '|' || address) AS name FROM parts),
rec AS (
  SELECT page_id, page,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
    || name[1:8] || '-' || name[9:12] || '-' || name[13:16] || '-' || name[17:20] || '-' || name[21:32]
    || '>' || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Page-ID: ' || page
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || address || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha256(body)
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)::VARCHAR
    || chr(13) || chr(10) || chr(13) || chr(10) || body AS record FROM named),
sized AS (SELECT page_id, page, strlen(record)::BIGINT AS length, sha256(record) AS digest FROM rec),
total AS (SELECT greatest(1, (sum(length + 4) + {FILE_BYTES - 1}) // {FILE_BYTES}) AS files FROM sized),
placed AS (
  SELECT sized.*, (('0x' || md5(page || '|' || digest)[1:8])::BIGINT % files)::INTEGER AS file FROM sized, total)
SELECT page_id, file,
  coalesce(sum(length + 4) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, digest
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  length, digest,
  CASE ('0x' || md5('fault|' || page)[1:8])::BIGINT % 97 WHEN 0 THEN 'altered' WHEN 1 THEN 'missing' ELSE 'intact' END AS status
FROM placed
"""
