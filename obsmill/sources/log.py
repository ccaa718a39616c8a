"""An append-only log of published versions: one small row per publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PublishLog:
    """Readers take the newest entry; an entry is one file, so it appears at once or not at all."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark = spark
        self.path = path
        self.schema = T.StructType.fromDDL(schema)

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).json(self.path)
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return self.spark.createDataFrame([], self.schema)

    def newest(self, where: Column | None = None) -> Row | None:
        entries = self.read() if where is None else self.read().where(where)
        return entries.orderBy(F.desc("sequence"), F.desc("published_at")).limit(1).first()

    def append(self, where: Column | None = None, **values) -> None:
        last = self.newest(where)
        row = {**values, "sequence": 0 if last is None else last.sequence + 1}
        self.spark.createDataFrame(
            [tuple(row[name] for name in self.schema.names)], self.schema
        ).coalesce(1).write.mode("append").json(self.path)
