"""Registry of user functions: extractors, transformers, filters, enrichers, as Column to Column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


class Registry:
    """Functions by kind and name, in the order of registration; a name can be taken once."""

    KINDS = ("extractor", "transformer", "filter", "enricher")

    def __init__(self):
        self._steps: dict[str, dict[str, Step]] = {k: {} for k in self.KINDS}

    def register(self, kind: str, name: str, step: Step) -> None:
        if kind not in self._steps:
            raise ValueError(f"no such kind: {kind}")
        if any(name in steps for steps in self._steps.values()):
            raise ValueError(f"name is taken: {name}")
        self._steps[kind][name] = step

    def extractor(self, name: str, step: Step) -> None:
        self.register("extractor", name, step)

    def transformer(self, name: str, step: Step) -> None:
        self.register("transformer", name, step)

    def filter(self, name: str, step: Step) -> None:
        self.register("filter", name, step)

    def enricher(self, name: str, step: Step) -> None:
        self.register("enricher", name, step)

    def extracted(self, df: DataFrame, column: str) -> DataFrame:
        """Adds one column for each extractor."""
        return df.withColumns({n: s(F.col(column)) for n, s in self._steps["extractor"].items()})

    def extracted_variant(self, df: DataFrame, column: str, target: str = "data") -> DataFrame:
        """Adds one VARIANT column with a field for each extractor, whatever their types."""
        steps = self._steps["extractor"].items()
        return df.withColumn(target, F.to_variant_object(F.struct(*[s(F.col(column)).alias(n) for n, s in steps])))

    def transformed(self, df: DataFrame, column: str) -> DataFrame:
        """Applies the transformers after each other; an empty or null result keeps its input."""
        for step in self._steps["transformer"].values():
            new = step(F.col(column))
            df = df.withColumn(column, F.when(F.coalesce(F.length(new), F.lit(0)) > 0, new).otherwise(F.col(column)))
        return df

    def filtered(self, df: DataFrame, column: str) -> DataFrame:
        """Rows that all filters let pass, none included."""
        return reduce(lambda d, s: d.where(s(F.col(column))), self._steps["filter"].values(), df)

    def enriched(self, df: DataFrame, column: str, target: str) -> DataFrame:
        """Merges the enrichers' maps into ``target`` (map<string,string>); later ones win."""
        out = F.col(target)
        for step in self._steps["enricher"].values():
            new = step(F.col(column))
            out = F.map_concat(F.map_filter(out, _absent(new)), F.coalesce(new, F.create_map().cast("map<string,string>")))
        return df.withColumn(target, out)


def _absent(other: Column):
    return lambda k, v: ~F.array_contains(F.coalesce(F.map_keys(other), F.array().cast("array<string>")), k)
