"""Digests, canonical JSON and ids that depend on content alone."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def digest(value: Column) -> Column:
    """64 hexadecimal digits of SHA-256; null for null."""
    return F.sha2(value.cast("binary"), 256)


def stable_id(kind: str, *parts: Column) -> Column:
    """A prefixed id of 32 hexadecimal digits over NUL-joined parts."""
    joined = F.concat_ws("\0", *parts)
    return F.concat(F.lit(f"backup-{kind}-"), F.substring(digest(joined), 1, 32))


def record_order(record_id: Column) -> Column:
    """The order in which records of a snapshot are read."""
    return F.substring(digest(record_id), 1, 32)


def canonical_json(value) -> str:
    """Sorted keys, compact, non-ASCII kept, no NaN; values may be nested to any depth."""
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    except RecursionError:
        pass
    out, left = [], [value]
    while left:  # texts that are marked as done, and values still to be written
        now = left.pop()
        if isinstance(now, _Written):
            out.append(now.text)
        elif isinstance(now, dict):
            parts = [x for k in sorted(now) for x in (_Written(f",{json.dumps(k, ensure_ascii=False)}:"), now[k])]
            if parts:
                parts[0] = _Written(parts[0].text[1:])
            left += [_Written("}"), *reversed(parts), _Written("{")]
        elif isinstance(now, (list, tuple)):
            parts = [x for v in now for x in (_Written(","), v)][1:]
            left += [_Written("]"), *reversed(parts), _Written("[")]
        else:
            out.append(json.dumps(now, ensure_ascii=False, allow_nan=False))
    return "".join(out)


class _Written:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


@pandas_udf(StringType())
def canonical(text: pd.Series) -> pd.Series:
    """Canonical form of JSON text."""
    return text.map(lambda t: t if t is None else canonical_json(json.loads(t)))


def canonical_row(*columns: str) -> Column:
    """Canonical JSON of named flat columns: alphabetical order, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def sorted_digest(text: Column) -> Column:
    """Aggregate: the digest of a list of JSON texts in their own order, whatever order they are stored in; for groups of bounded size."""
    return digest(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(text)), ","), F.lit("]")))


def set_fingerprint(value: Column, digits: int = 16) -> Column:
    """Aggregate: a fingerprint of a group's distinct values, whatever their order.

    Digests are added up, so that no task gathers a group's values: sha256("count,sum of the first 60 bits").
    """
    bits = F.conv(F.substring(digest(value.cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.substring(digest(F.concat_ws(",", F.count(value).cast("string"), F.sum(bits).cast("string"))), 1, digits)
