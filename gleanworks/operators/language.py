"""Entities, categories, personal-data flags, key phrases and polarity of texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanworks import fixed
from gleanworks.functions import privacy, scores, text as tx
from gleanworks.operators import joins, validation

MODEL_VERSION = "gleanworks-rules-1"


@dataclass(frozen=True)
class EntityRule:
    """A pattern that marks an entity, with its own base confidence if it has one.

    ``literal`` (lower case) and ``digits`` state what every match contains; texts
    without it are skipped before the pattern is tried.
    """

    kind: str
    pattern: str
    score: float | None = None
    literal: str = ""
    digits: bool = False


def _possible(text: Column, rules: list[EntityRule]) -> Column:
    """A JVM-side test that every text with a match passes.

    Plain words are sought together; other patterns are tried only on texts that hold
    the mark or the digits they need.
    """
    words = [r.literal for r in rules if r.literal.isalpha()]
    found = text.rlike("(?i)(?:" + "|".join(words) + ")") if words else F.lit(False)
    numeric = F.lit(False)
    for rule in rules:
        pattern = text.rlike(tx.ascii_edges(rule.pattern))
        if rule.literal.isalpha():
            continue
        if rule.digits:
            numeric = numeric | pattern
        else:
            found = found | (F.contains(text, F.lit(rule.literal)) & pattern)
    return found | (text.rlike("[0-9]") & numeric)


# A mention is marked with the words that qualify it: confidence grows with its length.
ENTITY_RULES = [
    EntityRule("DRUG", r"(?i)\baspirin(?: [a-z]+){0,2}\b", 0.95, literal="aspirin"),
    EntityRule("CONDITION", r"(?i)\b(?:severe |mild |chronic )?headache(?: with [a-z]+)?\b", 0.90, literal="headache"),
    EntityRule("DOSAGE", r"(?i)\b\d+(?:\.\d+)?\s?(?:mg|mcg|g|ml)(?: (?:once|twice|three times) (?:daily|weekly))?\b", digits=True),
    EntityRule("CLINICAL_TRIAL", r"\b(?:(?i:clinical trial|study) )?NCT\d{8}\b", digits=True),
    EntityRule("INTERACTION", r"(?i)\binteract(?:s|ed|ions?)(?: (?:with|between) [a-z]+(?: [a-z]+)?)?\b", literal="interact"),
    EntityRule("EMAIL", fixed.PII_DETECT["email"], literal="@"),
    EntityRule("PHONE", fixed.PII_DETECT["phone"], digits=True),
    EntityRule("SSN", fixed.PII_DETECT["ssn"], digits=True),
]

_SPANS = "array<struct<start:bigint,end:bigint,type:string,score:double>>"


def _spans(rules: list[EntityRule]):
    compiled = [(rule, re.compile(rule.pattern, re.ASCII)) for rule in rules]
    digit = re.compile("[0-9]")

    def find(source: str | None):
        if not source:
            return []
        lowered, numeric = source.lower(), digit.search(source) is not None
        return [
            {"start": m.start(), "end": m.end(), "type": rule.kind,
             "score": fixed.DEFAULT_ENTITY_CONFIDENCE if rule.score is None else rule.score}
            for rule, pattern in compiled
            if (numeric or not rule.digits) and rule.literal in lowered
            for m in pattern.finditer(source)
        ]

    @F.pandas_udf(_SPANS)
    def spans(source: pd.Series) -> pd.Series:
        return source.map(find)

    return spans


def entities(text: Column, rules: list[EntityRule] | None = None,
             minimum: float = fixed.MIN_ENTITY_CONFIDENCE) -> Column:
    """Array of entities at or above the confidence floor.

    Python only locates the spans, and sees only texts that can hold one.
    """
    def build(span: Column) -> Column:
        start, end = span["start"].cast("int"), span["end"].cast("int")
        found = F.substring(text, start + 1, end - start)
        return F.struct(
            found.alias("text"), span["type"].alias("type"),
            scores.entity_confidence(found, span["score"]).alias("confidence"),
            F.struct(span["start"].alias("start"), span["end"].alias("end")).alias("position"),
            tx.context_window(text, start, end).alias("context"),
            privacy.has_pii(found).alias("isPII"),
        )

    chosen = rules or ENTITY_RULES
    located = _spans(chosen)(F.when(_possible(text, chosen), text))
    return F.filter(F.transform(located, build), lambda e: e["confidence"] >= minimum)


def extract_entities(df: DataFrame, key: str, text: str, rules: list[EntityRule] | None = None) -> DataFrame:
    """One row per entity."""
    return df.select(key, F.explode(entities(F.col(text), rules)).alias("e")).select(
        key, "e.text", "e.type", "e.confidence",
        F.col("e.position.start").alias("start"), F.col("e.position.end").alias("end"),
        "e.context", F.col("e.isPII").alias("is_pii"),
    )


def categories(text: Column, rules: list[dict] | None = None) -> Column:
    """Array of category structs whose keywords occur in the text."""
    found = []
    for rule in rules or fixed.TEXT_CATEGORIES:
        entry = F.struct(
            F.lit(rule["category"]).alias("category"), F.lit(rule["confidence"]).alias("confidence"),
            *[F.array(*map(F.lit, rule[part])).alias(part) for part in ("subcategories", "hierarchy", "rules")],
        )
        found.append(F.when(tx.contains_any(text, rule["keywords"]), entry))
    return F.array_compact(F.array(*found))


def analyse(df: DataFrame, key: str, text: str, confidence: Column | None = None,
            rules: list[EntityRule] | None = None) -> DataFrame:
    """Entities, categories, PII flag, combined confidence and outcome of each text.

    Texts that are empty or too uncertain, and results below the confidence floor,
    end as FAILED with a reason; nothing is dropped.
    """
    source = F.col(text)
    readable = validation.text_processable(source, F.lit(1.0) if confidence is None else scores.unit_confidence(confidence))
    staged = (
        df.withColumn("entities", entities(source, rules))
        .withColumn("classifications", categories(source))
        .withColumn("confidence", scores.combined_confidence(
            F.transform("entities", lambda e: e["confidence"]),
            F.transform("classifications", lambda c: c["confidence"]),
        ))
        .withColumn("pii_detected", privacy.has_pii(source))
    )
    reason = (
        F.when(~validation.holds(readable), "UNREADABLE")
        .when(F.col("confidence") < fixed.MIN_RESULT_CONFIDENCE, "LOW_CONFIDENCE")
    )
    return staged.select(
        key, "entities", "classifications", "confidence", "pii_detected",
        F.lit(MODEL_VERSION).alias("model_version"), reason.alias("reason"),
    ).withColumn("status", F.when(F.col("reason").isNull(), "COMPLETED").otherwise("FAILED"))


def terms(text: Column, shortest: int = 4) -> Column:
    """Lower-case letter runs of at least ``shortest`` characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(\p{{L}}{{{shortest},}})"), 1)


#: Terms whose document frequencies are broadcast. Any other term stands in less than one in so many (document, term) pairs.
BROADCAST_TERMS = 131_072


def key_phrases(df: DataFrame, key: str, text: str, top: int = 5, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """The ``top`` terms of each text by term frequency times inverse document frequency.

    The terms of a document are brought together once and counted there. A term that occurs in every third text would
    overload one join task, so the most frequent ``broadcast_terms`` meet their document frequencies by broadcast, where the
    document is; only others are shuffled, and of these none is frequent. Document frequencies need no (document, term)
    shuffle: repeats fall away within the row.
    """
    together = df.select(key, terms(F.col(text)).alias("terms")).repartition(key)
    frequency = together.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    distinct = F.array_distinct(terms(F.col(text)))
    spread = df.select(F.explode(distinct).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    documents = df.agg(F.count("*")).scalar()
    common = F.broadcast(spread.orderBy(F.col("df").desc(), "term").limit(broadcast_terms))
    rare = spread.join(common.select("term"), "term", "left_anti")
    met = frequency.join(common, "term").unionByName(frequency.join(common.select("term"), "term", "left_anti").join(rare, "term"))
    scored = met.withColumn("score", F.round(F.col("tf") * F.log(documents / F.col("df")), 6))
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("term").asc())
    return (
        scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        .select(key, "rank", "term", "score")
    )


def sentiment(df: DataFrame, key: str, text: str, lexicon: dict[str, float]) -> DataFrame:
    """Mean polarity of the lexicon terms in each text; texts without one score zero."""
    rules = joins.rule_table(df.sparkSession, list(lexicon.items()), "term string, polarity double")
    hits = (
        df.select(key, F.explode(terms(F.col(text), 1)).alias("term")).join(rules, "term")
        .groupBy(key).agg(F.avg("polarity").alias("polarity"), F.count("*").alias("hits"))
    )
    return df.select(key).join(hits, key, "left").select(
        key, F.coalesce("polarity", F.lit(0.0)).alias("polarity"), F.coalesce("hits", F.lit(0)).alias("hits")
    )
