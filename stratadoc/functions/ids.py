"""Deterministic identifiers: name-based UUIDs (version 5) as SQL expressions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import composed_fold

#: Namespace of canonical ids; a deployment passes its own.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "stratadoc")
SEPARATOR = "\x1f"


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The same as uuid.uuid5 of Python, for names in any script."""

    def formed(digest: Column) -> Column:
        variant = F.element_at(F.array(*(F.lit(c) for c in "89ab")), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
        part = lambda a, n: F.substring(digest, a, n)
        return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))

    # the digest is bound, so that ids of ids of ids stay small as expressions
    return F.transform(F.array(F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))), formed)[0]


@dataclass(frozen=True)
class Plain:
    """A part that is in its normal form already: an id, a digest in lower case, a number."""

    value: Column


def normalized_part(value: Column) -> Column:
    """Composed, trimmed, case folded, blanks reduced; an empty part raises."""
    out = composed_fold(value.cast("string"))
    return F.when(F.length(out) > 0, out).otherwise(F.raise_error(F.lit("identifier parts must not be empty")))


def canonical_id(kind: str, *parts: Column | Plain, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Id of a document, revision, page, region, block or chunk from its parts."""
    return uuid5(namespace, F.concat_ws(SEPARATOR, F.lit(kind), *(p.value.cast("string") if isinstance(p, Plain) else normalized_part(p) for p in parts)))


def point_id(chunk_id: Column) -> Column:
    """Id of an index row."""
    return uuid5(uuid.NAMESPACE_DNS, chunk_id)


def valid_sha256(value: Column) -> Column:
    """The digest in lower case; anything else raises."""
    out = F.lower(F.trim(value))
    return F.when(out.rlike("^[0-9a-f]{64}$"), out).otherwise(F.raise_error(F.lit("expected a SHA-256 digest of 64 hexadecimal digits")))
