"""Small text helpers: keys, snippets, fall-back labels, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Document key prefix, snippet length and the query fall-back label.
KEY_PREFIX = "doc"
SNIPPET_CHARS = 200
QUERY_LABEL = "Query "


def doc_key(doc_id: Column) -> Column:
    return F.concat(F.lit(KEY_PREFIX), doc_id.cast("string"))


def doc_id_of_key(key: Column) -> Column:
    return F.substring(key, len(KEY_PREFIX) + 1, 2**31 - 1).cast("bigint")


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    """The whole text when short, else its beginning followed by an ellipsis."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def query_label(text: Column, query_id: Column) -> Column:
    return F.coalesce(text, F.concat(F.lit(QUERY_LABEL), (query_id + 1).cast("string")))


def query_hash(text: Column) -> Column:
    return F.md5(text)
