"""Models by name: what each reads, in which order they are built, and as what.

A model is a function of `ref`, which gives it the sources and models it names.
`view` models are temporary views, `table` models are written and read back,
`ephemeral` ones are only part of others' plans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Ref = Callable[[str], DataFrame]
KINDS = ("view", "table", "ephemeral")


@dataclass
class Model:
    name: str
    build: Callable[[Ref], DataFrame]
    needs: tuple[str, ...]
    kind: str
    cluster: tuple[str, ...]


@dataclass
class Project:
    """Sources and models. `folder` holds the tables; each build writes a
    table anew and then points its view at it."""

    spark: SparkSession
    folder: str
    sources: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    models: dict[str, Model] = field(default_factory=dict)

    def source(self, name: str, read: Callable[[], DataFrame]) -> None:
        if name in self.sources or name in self.models:
            raise ValueError(f"{name} is there already")
        self.sources[name] = read

    def model(self, name: str, *needs: str, kind: str = "view", cluster: Iterable[str] = ()) -> Callable[[Callable[[Ref], DataFrame]], Callable[[Ref], DataFrame]]:
        """Declare a model and all that it refers to. `cluster`: the columns
        that a table is ranged and sorted by."""
        if kind not in KINDS:
            raise ValueError(f"{kind} is none of {KINDS}")
        if name in self.sources or name in self.models:
            raise ValueError(f"{name} is there already")

        def add(build: Callable[[Ref], DataFrame]) -> Callable[[Ref], DataFrame]:
            self.models[name] = Model(name, build, needs, kind, tuple(cluster))
            return build

        return add

    def order(self, *wanted: str) -> list[str]:
        """The models behind `wanted` (all, without any), each after what it
        needs. A name that is unknown or a circle raises."""
        done: list[str] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise ValueError("a circle: " + " > ".join([*path, name]))
            if name in self.sources or name in done:
                return
            if name not in self.models:
                raise KeyError(f"{path[-1] if path else 'build'} refers to {name}, which is neither source nor model")
            for n in self.models[name].needs:
                visit(n, (*path, name))
            done.append(name)

        for name in wanted or self.models:
            visit(name, ())
        return done

    def build(self, *wanted: str) -> dict[str, DataFrame]:
        """Build the models behind `wanted` in order; their frames by name."""
        built: dict[str, DataFrame] = {}
        for name in self.order(*wanted):
            m = self.models[name]

            def ref(other: str, m: Model = m) -> DataFrame:
                if other not in m.needs:
                    raise KeyError(f"{m.name} didn't declare that it needs {other}")
                return self.sources[other]() if other in self.sources else built[other]

            df = m.build(ref)
            if m.kind == "table":
                path = f"{self.folder}/{name}"
                if m.cluster:
                    df = df.repartitionByRange(*m.cluster).sortWithinPartitions(*m.cluster)
                df.write.mode("overwrite").parquet(path)
                df = self.spark.read.schema(df.schema).parquet(path)
            if m.kind != "ephemeral":
                df.createOrReplaceTempView(name)
            built[name] = df
        return built
