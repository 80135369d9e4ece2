"""Logs that arrive in batches, packed into few files while readers go on.

Rows lie by tenant, day and batch.  Packing a closed day writes all its batches
up to a number into one part, named by that number below zero: part -(n + 1)
holds batches 0 to n.  It becomes visible by one rename and takes the place of
the parts it was made of, which stay for readers that have listed them until
they are cleared away.  A batch that is replayed after its day was packed is
recognised by its number and adds nothing.
"""

from __future__ import annotations

import re
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a packed file, about.
FILE_BYTES = 128 << 20


def covered_upto(part: int) -> int:
    """The last batch whose rows a part holds."""
    return part if part >= 0 else -part - 1


def live_parts(parts: list[int]) -> list[int]:
    """The parts that hold every row once: the widest packed one and the batches behind it."""
    packed = min((p for p in parts if p < 0), default=None)
    if packed is None:
        return sorted(parts)
    return [packed, *sorted(p for p in parts if p > covered_upto(packed))]


class LogStore:
    """Logs at ``path``, written by ``write`` batch by batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._files = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName

    def _names(self, folder: str, key: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}" if folder else self.path)
        if not self._files.exists(at):
            return []
        names = (str(s.getPath().getName()) for s in self._files.listStatus(at))
        return sorted(n for n in names if n.startswith(f"{key}="))

    def parts(self, day: str) -> list[int]:
        """Numbers of the parts of a tenant-day folder."""
        return [int(n.split("=")[1]) for n in self._names(day, "batch_id")]

    def days(self, tenant_id: str | None = None, start: date | None = None, end: date | None = None) -> list[str]:
        """Folders of tenant-days, ``end`` included."""
        tenants = self._names("", "tenant_id") if tenant_id is None else [f"tenant_id={self._escape(tenant_id)}"]
        found = []
        for tenant in tenants:
            for name in self._names(tenant, "log_date"):
                if re.fullmatch(r"log_date=[0-9-]{10}", name):
                    day = date.fromisoformat(name[9:])
                    if (start is None or day >= start) and (end is None or day <= end):
                        found.append(f"{tenant}/{name}")
        return found

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Store a batch; its rows of days that are packed up to it or beyond are there already."""
        dated = rows.withColumns({"log_date": F.to_date("ts"), "batch_id": F.lit(batch_id)})
        hit = dated.select("tenant_id", "log_date").distinct().collect()  # tenant-days of one batch
        done = []
        for r in hit:
            if r.tenant_id is None or r.log_date is None:
                continue
            day = f"tenant_id={self._escape(r.tenant_id)}/log_date={r.log_date}"
            if any(p < 0 and covered_upto(p) >= batch_id for p in self.parts(day)):
                done.append((r.tenant_id, r.log_date))
        if done:
            packed = self.spark.createDataFrame(done, "tenant_id string, log_date date")
            dated = dated.join(packed, ["tenant_id", "log_date"], "left_anti")
        (
            dated.hint("rebalance", "tenant_id", "log_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("tenant_id", "log_date", "batch_id")
            .parquet(self.path)
        )

    def read(self, schema, tenant_id: str | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
        """Every stored row once, of a tenant and a range of days where these are given; ``schema`` without the folders' columns."""
        folders = [f"{day}/batch_id={p}" for day in self.days(tenant_id, start, end) for p in live_parts(self.parts(day))]
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("log_date", F.lit(None).cast("date"))
        from pyspark.sql.types import DateType, IntegerType, StringType, StructType

        inner = [f for f in schema.fields if f.name not in ("tenant_id", "log_date", "batch_id")]
        full = StructType([*inner]).add("tenant_id", StringType()).add("log_date", DateType()).add("batch_id", IntegerType())
        rows = self.spark.read.schema(full).option("basePath", self.path).parquet(*(f"{self.path}/{f}" for f in folders))
        return rows.select(*schema.fieldNames(), "log_date")

    def pack(self, before: date, file_bytes: int = FILE_BYTES) -> int:
        """Pack the days before a date into files of about ``file_bytes``; gives the number of days that were packed.

        A day with one part is left alone.  Days are packed one after the other,
        each in as many tasks as its bytes ask for.
        """
        packed = 0
        for day in self.days():
            if date.fromisoformat(day[-10:]) >= before:
                continue
            live = live_parts(self.parts(day))
            if len(live) < 2:
                continue
            folders = [f"{self.path}/{day}/batch_id={p}" for p in live]
            size = sum(self._files.getContentSummary(self._at(f)).getLength() for f in folders)
            draft = f"{self.path}/_packing/{uuid.uuid4().hex}"
            rows = self.spark.read.parquet(*folders)
            rows.repartition(max(1, -(-size // file_bytes))).write.parquet(draft)
            target = self._at(f"{self.path}/{day}/batch_id={-(max(map(covered_upto, live)) + 1)}")
            if not self._files.rename(self._at(draft), target):
                raise OSError(f"could not move {draft} to {target}")
            packed += 1
        return packed

    def clear(self) -> int:
        """Delete parts that a packed one has replaced; gives their number.  Call it when readers of old listings are done."""
        gone = 0
        for day in self.days():
            parts = self.parts(day)
            for p in set(parts) - set(live_parts(parts)):
                gone += bool(self._files.delete(self._at(f"{self.path}/{day}/batch_id={p}"), True))
        return gone
