"""Identifiers, hashes, maps, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanworks import fixed


def checksum(value: Column) -> Column:
    return F.sha2(value, 256)


def is_uuid_v4(value: Column) -> Column:
    return value.rlike(fixed.UUID_V4)


def is_uuid(value: Column) -> Column:
    return value.rlike(fixed.UUID_ANY)


def is_semver(value: Column) -> Column:
    return value.rlike(fixed.SEMVER)


def is_sha256(value: Column) -> Column:
    return value.rlike(fixed.HEX_64)


def uuid_from(value: Column) -> Column:
    """A stable version-4 shaped identifier derived from the value."""
    digest = F.md5(value)
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("4"), F.substring(digest, 14, 3)),
        F.concat(F.lit("a"), F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def base64_text(value: Column) -> Column:
    """Base64 on one line; Spark may break long output into lines of 76 characters."""
    return F.translate(F.base64(F.encode(value, "UTF-8")), "\r\n", "")


def json_value(document: Column, dotted: str) -> Column:
    """Value at a dotted path as text; null when the path is absent."""
    return F.get_json_object(document, "$." + dotted)


def number_or_text(value: Column) -> tuple[Column, Column]:
    """Trimmed text and its numeric reading (null when it is not a number)."""
    trimmed = F.trim(value)
    return trimmed, F.when(trimmed == "", F.lit(0.0)).otherwise(trimmed.try_cast("double"))


def truthy(value: Column) -> Column:
    """Text is true unless it is empty; null stays null."""
    return value != ""


def as_array(value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(value))


def keys_matching(entries: Column, pattern: str) -> Column:
    return F.map_filter(entries, lambda key, _: key.rlike(pattern))


def merge_maps(defaults: Column, overrides: Column) -> Column:
    """Entries of both maps; ``overrides`` wins on a shared key."""
    kept = F.map_filter(defaults, lambda key, _: ~F.map_contains_key(overrides, key))
    return F.map_concat(kept, overrides)


def append_step(history: Column, step: Column) -> Column:
    return F.when(history.isNull(), F.array(step)).otherwise(F.array_append(history, step))


def mime_for_extension(ext: Column) -> Column:
    """MIME type by extension without its dot; unknown ones get the binary fallback."""
    mime = F.lit(fixed.FALLBACK_MIME)
    for name, kind in fixed.EXTENSION_MIMES.items():
        mime = F.when(ext == name, F.lit(kind)).otherwise(mime)
    return mime


def signature_matches(content: Column, mime: Column) -> Column:
    """Leading bytes agree with the MIME type; types without a known signature pass."""
    verdict = F.lit(True)
    for kind, signature in fixed.FILE_SIGNATURES.items():
        head = F.hex(F.substring(content, 1, len(signature) // 2))
        verdict = F.when(mime == kind, head == signature).otherwise(verdict)
    return verdict
