"""Providers: functions from files to contributions, registered with what they can supply."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Provider:
    name: str
    extract: Callable[[DataFrame], DataFrame]
    #: kind -> full or partial
    capabilities: dict[str, str] = field(default_factory=dict)


class Registry:
    def __init__(self) -> None:
        self.providers: list[Provider] = []

    def register(self, name: str, extract: Callable[[DataFrame], DataFrame], capabilities: dict[str, str] | None = None) -> None:
        if any(p.name == name for p in self.providers):
            raise ValueError(f"provider {name} is registered")
        self.providers.append(Provider(name, extract, capabilities or {}))

    def run(self, files: DataFrame, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
        """(contributions, failures): the union of all providers' rows; one that cannot be planned on these files is a failure row alone."""
        spark = files.sparkSession
        out, failures = spark.createDataFrame([], schema), []
        for p in self.providers:
            try:
                got = p.extract(files).select(*out.columns)
            except Exception as e:  # a provider is foreign code: its fault is data here
                failures.append((p.name, f"{type(e).__name__}: {e}"[:500]))
            else:
                out = out.unionByName(got)
        return out, spark.createDataFrame(failures, "provider_id string, reason string")

    def declarations(self, spark) -> DataFrame:
        rows = [(p.name, k, level) for p in self.providers for k, level in p.capabilities.items()]
        return spark.createDataFrame(rows, "provider_id string, kind string, level string")


#: A collector reads one file (a row as a dict) and gives rows of the wanted schema.
Collector = Callable[[dict], Iterable[dict]]


def run_isolated(files: DataFrame, collectors: dict[str, Collector], schema: StructType) -> DataFrame:
    """(collector, root_name, rel_path, row, reason): what every collector reads from every file (X13). Faults are caught in the tasks, file by file: a collector that fails on one keeps its
    rows of all others, rows that it gave before the fault and rows that do not fit the schema are dropped with that file, and the fault is a row without a value. One pass over the files; of
    a file no more than its own rows is held."""
    form = to_arrow_schema(schema)
    out = pa.schema([("collector", pa.string()), ("root_name", pa.string()), ("rel_path", pa.string()), ("row", pa.struct(list(form))), ("reason", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.slice(i, 1).to_pylist()[0]
                for name, collect in collectors.items():
                    place = {"collector": name, "root_name": file["root_name"], "rel_path": file["rel_path"]}
                    try:
                        got = pa.RecordBatch.from_pylist([place | {"row": r, "reason": None} for r in collect(file)], schema=out)
                    except Exception as e:  # a collector is foreign code: its fault is data here
                        got = pa.RecordBatch.from_pylist([place | {"row": None, "reason": f"{type(e).__name__}: {e}"[:500]}], schema=out)
                    yield got

    return files.mapInArrow(read, f"collector string, root_name string, rel_path string, row {schema.simpleString()}, reason string")


def split_failures(ran: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of run_isolated; written once first where both are read."""
    return ran.where(F.col("reason").isNull()).select("collector", "root_name", "rel_path", "row.*"), ran.where(F.col("reason").isNotNull()).select("collector", "root_name", "rel_path", "reason")
