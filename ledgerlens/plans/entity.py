"""Entities and their measures, declared once and shared by the analyses."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans.joins import profile


def pick(measures: Mapping[str, str], **names: str) -> list[Column]:
    """The SQL aggregates ``names`` points at (result column = measure name)."""
    return [F.expr(measures[m]).alias(name) for name, m in names.items()]


@dataclass(frozen=True)
class Entity:
    """A key, the sources with facts about it and the measures of each source.

    A source is a function from the tables to rows with the key; one that is not
    declared is the table of that name.  Measures are SQL aggregates.  All measures
    that an analysis takes from one source share one aggregate, and each source
    becomes one row per key before it is joined.
    """

    key: str
    measures: Mapping[str, Mapping[str, str]]
    sources: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = field(default_factory=dict)

    def figures(self, tables: Mapping[str, DataFrame], **names: str) -> list[DataFrame]:
        """One frame a source, one row per key: column ``name`` holds the
        measure ``"source.measure"``."""
        wanted: dict[str, dict[str, str]] = {}
        for name, path in names.items():
            source, measure = path.split(".")
            wanted.setdefault(source, {})[name] = measure
        rows = {s: self.sources[s](tables) if s in self.sources else tables[s] for s in wanted}
        return [rows[s].groupBy(self.key).agg(*pick(self.measures[s], **w)) for s, w in wanted.items()]

    def measured(self, rows: DataFrame, tables: Mapping[str, DataFrame], fill: bool = True, **names: str) -> DataFrame:
        """``rows`` with the named measures; without facts they are 0 (``fill``) or NULL."""
        return profile(rows, self.key, *self.figures(tables, **names), fill=fill)

    def having(self, rows: DataFrame, tables: Mapping[str, DataFrame], **names: str) -> DataFrame:
        """The ``rows`` with facts in every source named, with the measures."""
        for per_key in self.figures(tables, **names):
            rows = rows.join(per_key, self.key)
        return rows
