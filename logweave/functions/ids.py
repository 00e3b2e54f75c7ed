"""Stable ids and content hashes. Parts that are null count as empty, so that an id is never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])


def _sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def record_id(dataset: Column | str, file: Column | str, line: Column | str) -> Column:
    """SHA-256 of where a record was read."""
    return _sha(_joined(dataset, file, line))


def entity_id(dataset: Column | str, kind: Column | str, canonical: Column | str, context: Column | str) -> Column:
    """SHA-256 of an entity's scope: equal names in other datasets or contexts are other entities."""
    return _sha(_joined(dataset, kind, canonical, context))


def node_id(kind: Column | str, value: Column | str) -> Column:
    """kind:digest, the digest being 24 hex digits of the value's SHA-256."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(":"), F.substring(_sha(F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(""))), 1, 24))


def window_id(dataset: Column | str, minutes: int, start: Column) -> Column:
    """window:digest of dataset, length and start, which is written as ISO 8601 at offset zero, as times are UTC."""
    return F.concat(F.lit("window:"), F.substring(_sha(_joined(dataset, F.lit(minutes), iso_utc(start))), 1, 16))


def iso_utc(ts: Column) -> Column:
    """The clock time of `ts` as ISO 8601 at offset zero."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def short_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(_sha(text), 1, digits)


def content_hash(text: Column) -> Column:
    """SHA-256 of a payload; null stays null."""
    return _sha(text)


def configuration_hash(settings: Column) -> Column:
    """SHA-256 of a map of settings as canonical JSON, whatever the order they were given in."""
    return _sha(canonical_json(settings))


def canonical_json(payload: Column) -> Column:
    """A map as JSON with sorted keys and no spaces: the form that all hashes of maps here are taken of."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(payload))))
