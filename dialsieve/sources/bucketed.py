"""Spark tables bucketed by their join key, kept at a folder of their own.

A frame that is joined with such a table on its key is shuffled into the table's buckets; the
table itself is read bucket by bucket and never shuffled.  The bucket layout is part of
the files; the catalog entry is made again from the folder whenever a session lacks it, so no
metastore is needed."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession

from ..schema import q
from ..session import observed


@dataclass(frozen=True)
class Bucketed:
    folder: str
    columns: tuple[tuple[str, str], ...]      # (name, type)
    keys: tuple[str, ...]
    buckets: int

    @property
    def name(self) -> str:
        return f"dialsieve_{uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex}"

    def _known(self, spark: SparkSession) -> str:
        columns = ", ".join(f"{q(c)} {t}" for c, t in self.columns)
        place = self.folder.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet "
                  f"CLUSTERED BY ({', '.join(map(q, self.keys))}) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return self.name

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as it stands now (other sessions may have added to it)."""
        spark.catalog.refreshTable(self._known(spark))
        return spark.table(self.name)

    def add(self, rows: DataFrame, **figures) -> Observation | None:
        """Append rows, one file a bucket; ``figures`` are taken by the job that writes."""
        name = self._known(rows.sparkSession)
        dealt, seen = self.dealt(rows.select(*[c for c, _ in self.columns])), None
        if figures:
            dealt, seen = observed(dealt, **figures)
        dealt.write.insertInto(name)
        return seen

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows shuffled into the table's buckets, by the key columns of the same names."""
        return rows.repartition(self.buckets, *self.keys)
