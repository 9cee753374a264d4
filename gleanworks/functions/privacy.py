"""Finding and masking personal data and secrets, column by column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from gleanworks import fixed
from gleanworks.functions.text import ascii_edges


def _occurs(text: Column, kind: str, pattern: str) -> Column:
    """Whether the pattern occurs. A cheap necessary test comes first and usually decides."""
    found = text.rlike(ascii_edges(pattern))
    return F.contains(text, F.lit("@")) & found if kind == "email" else text.rlike("[0-9]") & found


def has_pii(text: Column) -> Column:
    found = F.lit(False)
    for kind, pattern in fixed.PII_DETECT.items():
        found = found | _occurs(text, kind, pattern)
    return found


def mask_value(value: Column) -> Column:
    """The whole value becomes ``[REDACTED kind]`` for the first kind that occurs in it."""
    masked = value
    for kind, pattern in reversed(fixed.PII_MASK.items()):
        masked = F.when(_occurs(value, kind, pattern), F.lit(f"[REDACTED {kind}]")).otherwise(masked)
    return masked


def redact_spans(text: Column) -> Column:
    """Only the matching spans are replaced; the rest of the text stays."""
    for kind, pattern in fixed.PII_MASK.items():
        mark = "@" if kind == "email" else "[0-9]"
        text = F.when(text.rlike(mark), F.regexp_replace(text, pattern, f"[REDACTED {kind}]")).otherwise(text)
    return text


def mask_keys(entries: Column, keys: list[str], marker: str) -> Column:
    """Replace the values of the named keys (any case) in a string map."""
    return F.transform_values(
        entries, lambda key, value: F.when(F.lower(key).isin(*keys), F.lit(marker)).otherwise(value)
    )



def sanitise_label_keys(labels: Column) -> Column:
    return F.transform_keys(labels, lambda key, _: F.regexp_replace(key, "[^a-zA-Z0-9_]", "_"))


def redact_fields(value: Column, kind: DataType, fields: list[str] | None = None) -> Column:
    """Blank every string field with a sensitive name, at any depth of a declared type."""
    names = fields or fixed.SENSITIVE_FIELDS
    if isinstance(kind, StructType):
        parts = []
        for field in kind.fields:
            child = value.getField(field.name)
            if field.name.lower() in names and isinstance(field.dataType, StringType):
                child = F.when(child.isNotNull(), F.lit("[REDACTED]"))
            else:
                child = redact_fields(child, field.dataType, names)
            parts.append(child.alias(field.name))
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType, MapType)):
        return F.transform(value, lambda item: redact_fields(item, kind.elementType, names))
    if isinstance(kind, MapType) and isinstance(kind.valueType, StringType):
        return mask_keys(value, names, "[REDACTED]")
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, item: redact_fields(item, kind.valueType, names))
    return value


def redact_json(text: Column, kind: StructType) -> Column:
    """Redact a JSON string whose layout is declared by ``kind``."""
    return F.to_json(redact_fields(F.from_json(text, kind), kind))
