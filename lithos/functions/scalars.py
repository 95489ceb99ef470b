"""Scalar functions of the model, as column expressions (all inside code generation)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 1 << 20
#: A store's files grow in units of 64 KiB.
SPACE_UNIT = 1 << 16
#: Event letters; only T is fixed by the model, the others are this engine's.
EVENT_KINDS: Mapping[str, str] = {"T": "transaction_committed", "C": "segment_created", "R": "segment_released", "M": "metadata_modified"}
SERVER_EVENT_KINDS: Mapping[str, str] = {"C": "collection_created", "D": "collection_destroyed"}


def content_id(data: Column) -> Column:
    """SHA-1 (hex) and length in bytes: two contents are equal if both are."""
    return F.struct(F.sha1(data).alias("sha1"), F.octet_length(data).cast("long").alias("len"))


def same_content(a: Column, b: Column) -> Column:
    return (a["sha1"] == b["sha1"]) & (a["len"] == b["len"])


def event_letter(event_type: Column) -> Column:
    return F.substring(F.trim(event_type), 1, 1)


def event_kind(event_type: Column, kinds: Mapping[str, str] = EVENT_KINDS) -> Column:
    """The kind of an event, null (to be skipped) for unknown letters."""
    letter = event_letter(event_type)
    out = F.lit(None).cast("string")
    for k, name in kinds.items():
        out = F.when(letter == k, name).otherwise(out)
    return out


def valid_id(value: Column, size: int) -> Column:
    """Ids have a fixed size; anything else is no id."""
    return F.when(F.octet_length(value) == size, value)


def snapshot_name(millis: Column, uniquifier: Column) -> Column:
    """yyyy-MM-dd@HH:mm:ss.SSS-uniquifier, in the session's zone (UTC is expected)."""
    return F.concat(F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'@'HH:mm:ss.SSS"), F.lit("-"), uniquifier.cast("string"))


def block_index(offset: Column, block: int = BLOCK) -> Column:
    return F.floor(offset / block).cast("long")


def block_offset(offset: Column, block: int = BLOCK) -> Column:
    return F.pmod(offset, F.lit(block)).cast("long")


def path_parts(path: Column) -> Column:
    """Components without the empty ones of leading, doubled and trailing slashes."""
    return F.array_remove(F.split(path, "/"), "")


def parent_path(path: Column) -> Column:
    parts = path_parts(path)
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))


def leaf_name(path: Column) -> Column:
    return F.try_element_at(path_parts(path), F.lit(-1))


def without_leading(path: Column, n: int) -> Column:
    parts = path_parts(path)
    return F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), "/")


def serial_path(data_id: Column, width: int = 9) -> Column:
    """A file's path from its serial number: three digits a level, 1,000 entries a directory. Numbers
    of more than `width` digits have more levels."""
    digits = data_id.cast("string")
    levels = F.greatest(F.ceil(F.length(digits) / 3), F.lit(-(-width // 3))).cast("int")
    padded = F.lpad(digits, 3 * levels, "0")
    parts = F.transform(F.sequence(F.lit(0), levels - 1), lambda i: F.substring(padded, 3 * i + 1, F.lit(3)))
    return F.concat(F.array_join(parts, "/"), F.lit(".casseg"))


def serial_number(file_name: Column) -> Column:
    """The number a segment file's name or path says."""
    return F.regexp_replace(F.regexp_extract(file_name, r"([0-9/]+)\.casseg$", 1), "/", "").cast("long")


def id_list(text: Column) -> Column:
    """A comma-separated list, blanks around its members dropped."""
    return F.array_remove(F.split(F.trim(text), r"\s*,\s*"), "")


def limited_utf8(text: Column, most_bytes: int) -> Column:
    """The text as UTF-8, null beyond a length."""
    data = F.encode(text, "UTF-8")
    return F.when(F.octet_length(data) <= most_bytes, data)


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def hash_bucket(key_hex: Column, bits: int) -> Column:
    """The top `bits` (up to 32) of a key given in hex."""
    return F.shiftrightunsigned(F.conv(F.rpad(F.substring(key_hex, 1, 8), 8, "0"), 16, 10).cast("long"), 32 - bits)


def readable(offset: Column, length: Column, end: Column) -> Column:
    """How much a read at `offset` gives: clamped to the end, -1 beyond it."""
    return F.when(offset >= end, F.lit(-1).cast("long")).otherwise(F.least(length, end - offset))


def space_used(length: Column) -> Column:
    """Whole units and one more."""
    return (F.floor(length / SPACE_UNIT).cast("long") + 1) * SPACE_UNIT


def map_put(values: Column, key: str, value: Column) -> Column:
    return F.map_concat(map_without(values, key), F.create_map(F.lit(key), value))


def map_without(values: Column, key: str) -> Column:
    return F.map_filter(values, lambda k, _: k != key)


def map_only(values: Column, keys: Column) -> Column:
    """The entries whose keys are asked for; others and missing ones are left out."""
    return F.map_filter(values, lambda k, _: F.array_contains(keys, k))


def unreserved(key: Column, reserved: list[str]) -> Column:
    """The key, or an error if it is one that only the system may write."""
    return F.when(key.isin(reserved), F.raise_error(F.concat(F.lit("reserved metadata key: "), key))).otherwise(key)


def metadata_keys(values: Column) -> Column:
    """The keys of a metadata map in order; none for a null map."""
    return F.array_sort(F.map_keys(F.coalesce(values, F.create_map().cast("map<string,string>"))))


def metadata_default(values: Column, key: str, value: str) -> Column:
    """The map with a default for a key that it lacks."""
    return F.when(F.map_contains_key(values, key), values).otherwise(map_put(values, key, F.lit(value)))
