"""URL pieces as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_parameter(query: Column, name: str) -> Column:
    """The decoded value of a parameter of ``a=1&b=2``; null if it isn't there. The last of repeated ones counts."""
    pairs = F.filter(F.split(query, "&"), lambda x: x.startswith(F.lit(name + "=")))
    return F.url_decode(F.substring(F.get(pairs, F.size(pairs) - 1), len(name) + 2, 1 << 20))


def key_path(prefix: str, key: Column) -> Column:
    """A path with the key encoded as its last segment."""
    return F.concat(F.lit(prefix), F.url_encode(key))
