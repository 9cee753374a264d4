"""Extension points: collectors, text extractors, text steps, metrics and rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Collectors:
    """Named collectors: how to extract rows from pages and how to shape the outcome."""

    _known: dict[str, tuple[Stage, Stage]] = field(default_factory=dict)

    def register(self, kind: str, extract: Stage, process: Stage = lambda df: df) -> None:
        if kind in self._known:
            raise ValueError(f"collector {kind} is already registered")
        self._known[kind] = (extract, process)

    def run(self, kind: str, pages: DataFrame) -> DataFrame:
        if kind not in self._known:
            raise KeyError(f"no collector {kind}")
        extract, process = self._known[kind]
        return process(extract(pages))


@dataclass
class TextExtractors:
    """Extractors by MIME type: column expressions that read text, confidence and pages from a file's columns."""

    _known: dict[str, Column] = field(default_factory=dict)

    def register(self, mime: str, text: Column, confidence: Column, pages: Column) -> None:
        if mime in self._known:
            raise ValueError(f"an extractor for {mime} is already registered")
        self._known[mime] = F.struct(
            text.alias("text"), confidence.cast("double").alias("confidence"), pages.cast("bigint").alias("pages"), F.lit(True).alias("supported"))

    def run(self, files: DataFrame, mime: str) -> DataFrame:
        """Every file with ``extracted``; a file of an unknown type has ``supported`` false and no text."""
        none = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("confidence"),
                        F.lit(None).cast("bigint").alias("pages"), F.lit(False).alias("supported"))
        chosen = none
        for name, expression in self._known.items():
            chosen = F.when(F.col(mime) == name, expression).otherwise(chosen)
        return files.withColumn("extracted", chosen)


@dataclass
class TextSteps:
    """A caller's steps over texts, as expressions that Spark plans together with everything else."""

    _steps: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def add(self, name: str, step: Callable[[Column], Column]) -> None:
        if name in self._steps:
            raise ValueError(f"step {name} is already there")
        self._steps[name] = step

    def run(self, df: DataFrame, text: str) -> DataFrame:
        return df.withColumns({name: step(F.col(text)) for name, step in self._steps.items()})


def custom_metrics(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Caller-defined quality metrics as an open map column."""
    entries = [part for name, metric in metrics.items() for part in (F.lit(name), metric.cast("double"))]
    return df.withColumn("custom_metrics", F.create_map(*entries))
