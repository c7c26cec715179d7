"""What an analysis gives: its parameters and tables, with sinks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Results:
    mode: str
    params: dict[str, Any]
    table: DataFrame
    details: dict[str, DataFrame] = field(default_factory=dict)

    def estimate(self) -> float | None:
        """The one number of modes that give one."""
        column = {"rigorous": "mi_corrected", "conditional": "cmi", "transfer": "te_xy", "estimate": "mi"}.get(self.mode)
        return self.table.first()[column] if column else None

    def save(self, path: str) -> None:
        """The table, the details beside it, and the parameters, as Parquet and JSON; nothing is overwritten."""
        self.table.write.mode("errorifexists").parquet(f"{path}/table")
        for name, df in self.details.items():
            df.write.mode("errorifexists").parquet(f"{path}/{name}")
        spark = self.table.sparkSession
        text = json.dumps({"mode": self.mode, "params": {k: v for k, v in self.params.items() if not callable(v)}, "details": sorted(self.details)})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/params")

    @classmethod
    def load(cls, spark, path: str) -> Results:
        head = json.loads(spark.read.text(f"{path}/params").first()[0])
        return cls(head["mode"], head["params"], spark.read.parquet(f"{path}/table"), {n: spark.read.parquet(f"{path}/{n}") for n in head["details"]})

    def to_json(self, path: str) -> None:
        self.table.write.mode("errorifexists").json(path)

    def summary(self) -> str:
        """A few lines of text: the mode, its parameters and the first rows of its table."""
        rows = "\n".join(str(r.asDict()) for r in self.table.limit(10).collect())
        return f"{self.mode}\n{ {k: v for k, v in self.params.items() if not callable(v)} }\n{rows}"


def compared(results: dict[str, Results]) -> DataFrame:
    """The tables of results of one mode below each other, with their `label`."""
    if len(results) < 2 or len({r.mode for r in results.values()}) > 1:
        raise ValueError("two results or more of one mode can be compared")
    tables = [r.table.withColumn("label", F.lit(k)) for k, r in results.items()]
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    return found
