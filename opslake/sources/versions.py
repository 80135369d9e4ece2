"""A stored table that small batches change without rewriting it.

Rows lie in folders by a hash of their key.  A batch of versioned changes reads
and rewrites only the parts in which a change is taken, into new folders.  Then
one small file, the next version, names the folders of all parts.  Readers go by
the newest version, so they see a batch whole or not at all, and a write that
fails leaves the version before it as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.functions.scratch import materialize, remove
from opslake.operators.tables import decide_changes

PARTS = 64


class StaleVersion(RuntimeError):
    """Another writer was faster; read the table again and repeat the batch."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._files = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self, rows: DataFrame, keys: list[str], parts: int = PARTS) -> None:
        """Write the first version."""
        head = {"version": 0, "keys": keys, "parts": parts, "schema": rows.schema.jsonValue()}
        self._commit({**head, "folders": self._write(rows, keys, parts)})

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/_versions")
        if not self._files.exists(folder):
            return []
        names = (str(s.getPath().getName()) for s in self._files.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def head(self, version: int | None = None) -> dict:
        """The file of a version, by default the newest."""
        number = self.versions()[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{number:012d}.json", wholetext=True).first()[0])

    def read(self, version: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its parts."""
        return self._rows(self.head(version), parts)

    def _rows(self, head: dict, parts: list[int] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(head["schema"])
        folders = [f for p, f in head["folders"].items() if parts is None or int(p) in parts]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def upsert(self, changes: DataFrame, changed_at: str = "updated_at") -> DataFrame:
        """Apply a batch as ``versioned_upsert`` does; gives the changes refused.

        Only the parts that hold a key of the batch are read, and only those
        where a change is taken are written.
        """
        head = self.head()
        keys, parts = head["keys"], head["parts"]
        batch = materialize(changes, "changes")
        touched = self._parts_of(batch, keys, parts)
        base = self._rows(head, touched)
        written, conflicts = decide_changes(base, batch, keys, changed_at)
        written, conflicts = materialize(written, "taken"), materialize(conflicts, "conflicts")
        changed = self._parts_of(written, keys, parts)
        if changed:
            kept = self._rows(head, changed).join(written.select(*keys), keys, "left_anti")
            after = kept.unionByName(written.select(*kept.columns))
            folders = {**head["folders"], **self._write(after, keys, parts)}
            self._commit({**head, "version": head["version"] + 1, "folders": folders})
        remove(batch, written)
        return conflicts

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the newest ``keep`` versions names; gives their number.  No writer may be at work."""
        numbers = self.versions()
        held = {f for n in numbers[-keep:] for f in self.head(n)["folders"].values()}
        gone = 0
        for number in numbers[:-keep]:
            for folder in set(self.head(number)["folders"].values()) - held:
                gone += bool(self._files.delete(self._at(f"{self.path}/{folder}"), True))
            self._files.delete(self._at(f"{self.path}/_versions/{number:012d}.json"), False)
        return gone

    @staticmethod
    def _part(keys: list[str], parts: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

    def _parts_of(self, rows: DataFrame, keys: list[str], parts: int) -> list[int]:
        return sorted(r.part for r in rows.select(self._part(keys, parts).alias("part")).distinct().collect())

    def _write(self, rows: DataFrame, keys: list[str], parts: int) -> dict[str, str]:
        """New folders of the parts that the rows lie in; equal keys meet in one part, a large part gets several files."""
        folder = f"rows/{uuid.uuid4().hex}"
        placed = rows.withColumn("_part", self._part(keys, parts)).hint("rebalance", "_part")
        placed.write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        names = (str(s.getPath().getName()) for s in self._files.listStatus(self._at(f"{self.path}/{folder}")))
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_part=")}

    def _commit(self, head: dict) -> None:
        """Make a version visible in one step; a version of that number must not be there yet."""
        target = self._at(f"{self.path}/_versions/{head['version']:012d}.json")
        draft = self._at(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        stream.write(bytearray(json.dumps(head).encode()))
        stream.close()
        if self._files.exists(target) or not self._files.rename(draft, target):
            self._files.delete(draft, False)
            raise StaleVersion(f"version {head['version']} of {self.path} exists")
