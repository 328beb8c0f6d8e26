"""Secret scan: fixed patterns plus a token-efficiency test.

The base patterns find assignments, access keys and long hexadecimal runs. The
method adds random strings that follow no pattern: text that a byte-pair
vocabulary was built for takes few tokens, random characters take many. A run of
at least 20 key characters that mixes letters with digits, or cases, is flagged when a token
covers less than two characters on average. Since a readable path or name in front of a key would
hide it in that average, the parts of a run between signs are tested too, and its stretches of
short tokens, widened to the signs around them. Digests of known lengths,
UUIDs and time stamps are taken out of a run first, since they look random but are public
identifiers; where a base pattern covers them, the base span stays.

Whole texts are scanned, one row at a time, without a shuffle. Defined results:
a null or empty text has no spans; repeated rows get equal rows; spans of
different kinds may overlap; no rows give no rows. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from thermocline.llm.common import read_table, tidy, with_texts, with_workers

KINDS = ("assign", "access", "hex", "token")
VOCABULARY = "byte_bpe_50k.tiktoken"
MIN_CHARS = 20
MAX_CHARS_PER_TOKEN = 2.0

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
IDENTIFIER = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"  # digests
    r"|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"  # UUID
    r"|\d{4}-\d\d-\d\dT[\d+-]+Z?)", re.I | re.A)  # time stamp
INNER = re.compile(rf"(?<![A-Za-z0-9])(?:{IDENTIFIER.pattern})(?![A-Za-z0-9])", re.I | re.A)
PARTS = (re.compile(r"[^/=]+"), re.compile(r"[^/=+_-]+"))
SIGNS = "/=+_-"


@lru_cache(maxsize=4)
def encoder(file: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(file), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_mixed(run: str) -> bool:
    """Letters with digits, or both cases beyond a capital at the start."""
    has_letter, has_digit = run.upper() != run.lower(), any(c.isdigit() for c in run)
    return has_letter and (has_digit or run[1:] not in (run[1:].lower(), run[1:].upper()))


def is_random(run: str, file: str = VOCABULARY) -> bool:
    if IDENTIFIER.fullmatch(run) or not is_mixed(run):
        return False
    return len(run) < MAX_CHARS_PER_TOKEN * len(encoder(file).encode_ordinary(run))


def dense(run: str, file: str = VOCABULARY) -> list[tuple[int, int]]:
    """Maximal stretches of ``run`` in which a token covers less than two characters on average (Ruzzo and Tompa)."""
    vocabulary, at, total = encoder(file), 0, 0.0
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sums before and after, the last one with a smaller sum before
    for token in vocabulary.encode_ordinary(run):
        size = len(vocabulary.decode_single_token_bytes(token))
        at, total = at + size, total + MAX_CHARS_PER_TOKEN - size
        if size >= MAX_CHARS_PER_TOKEN:
            continue
        start, before, place = at - size, total - MAX_CHARS_PER_TOKEN + size, len(found) - 1
        while True:
            while place >= 0 and found[place][2] >= before:
                place = found[place][4]
            if place < 0 or found[place][3] >= total:
                break
            start, _, before, _, earlier = found[place]
            del found[place:]
            place = earlier
        found.append((start, at, before, total, place))
    return [(start, end) for start, end, *_ in found]


def random_parts(run: str, file: str = VOCABULARY) -> list[tuple[int, int]]:
    """Places in a run that look random: all of it, or else parts of it."""
    if is_random(run, file):
        return [(0, len(run))]
    if not is_mixed(run):
        return []
    out = [m.span() for kind in PARTS for m in kind.finditer(run) if MIN_CHARS <= len(m[0]) < len(run) and is_random(m[0], file)]
    for start, end in dense(run, file):
        low, high = start, end
        while low and run[low - 1] not in SIGNS:
            low -= 1
        while high < len(run) and run[high] not in SIGNS:
            high += 1
        while low < high and run[low] in SIGNS:
            low += 1
        whole = end - start >= MIN_CHARS and is_mixed(run[start:end])
        if whole or high - low >= MIN_CHARS and is_random(run[low:high], file):
            out.append((low, high))
    joined: list[tuple[int, int]] = []
    for start, end in sorted(out):
        if joined and start < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((start, end))
    return joined


def random_spans(text: str, file: str = VOCABULARY) -> Iterator[tuple[int, int]]:
    """Random places of every run of key characters, outside public identifiers."""
    for run in RUN.finditer(text):
        at = run.start()
        for stop, following in [*(m.span() for m in INNER.finditer(text, *run.span())), (run.end(), run.end())]:
            # The signs beside an identifier belong to neither side.
            while run.start() < at < stop and text[at] in SIGNS:
                at += 1
            end = stop
            while stop < run.end() and at < end and text[end - 1] in SIGNS:
                end -= 1
            if end - at >= MIN_CHARS:
                yield from ((at + a, at + b) for a, b in random_parts(text[at:end], file))
            at = following


def find(text: str | None, file: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """(start, kind's place in ``KINDS``, end) of every span, in order."""
    if not text:
        return []
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(start, 3, end) for start, end in random_spans(text, file)]
    return sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked(text: str | None, file: str = VOCABULARY, mask: str = "[SECRET]") -> str | None:
    """The text with every run of overlapping spans replaced by one mask."""
    spans = find(text, file)
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ]))),
])


def scan_secrets(docs: DataFrame, file: str = VOCABULARY) -> DataFrame:
    """doc_id and its spans, one row per document."""
    with_workers(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(text.as_py(), file)]
                     for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(scan), SPANS)


def redact_secrets(docs: DataFrame, file: str = VOCABULARY) -> DataFrame:
    """The same rows and columns with every secret in ``text`` masked."""
    with_workers(docs.sparkSession)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_texts(batch, [masked(text.as_py(), file) for text in batch.column("text")])

    return docs.mapInArrow(tidy(redact), docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    from pyspark.sql import functions as F

    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "token")
    return found.select(
        "doc_id", *[of(kind) for kind in KINDS[:3]], F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"), of("token"))
