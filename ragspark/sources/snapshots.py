"""Tables of documents that change as a whole: immutable snapshot folders, and a manifest that one rename puts in place.

A commit writes its rows of all tables to new folders, then the manifest that lists them; what was there before is not
touched, so a failure at any point leaves the old state, and the next commit the new one.  Readers take what the last
manifest lists.  A document that comes again hides its rows of earlier snapshots: the manifest also lists deletions
(document, snapshot), which are few, as they end with the next compaction, and are taken out when a table is read.  So the
work of a commit grows with its rows, not with the table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: deletions up to which they are broadcast when a table is read; more are joined by shuffle
MOST = 1_000_000


class Snapshots:
    """Tables under ``path``, whose rows all have a document_id.  One writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        where = self._at(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(where)] if self._fs.exists(where) else []

    # ------------------------------------------------------------ manifests

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict:
        """What the last commit (or an earlier one) left: seq, tables (folders, partition columns, schema), deleted (folders, rows), notes."""
        known = self.versions()
        if not known:
            return {"seq": 0, "tables": {}, "deleted": {"folders": [], "rows": 0}, "notes": {}}
        stream = self._fs.open(self._at(f"manifests/{known[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        final, draft = self._at(f"manifests/{manifest['seq']:012d}.json"), self._at(f"manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"snapshot {manifest['seq']} of {self.path} is there already")

    def _folder(self, name: str, seq: int) -> str:
        return f"data/{name}/snapshot={seq}/try={uuid.uuid4().hex}"

    # ------------------------------------------------------------ reading

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table that are alive."""
        m = self.manifest(version)
        rows = self._scan(m, name)
        if m["deleted"]["rows"]:
            gone = self._deleted(m).groupBy("document_id").agg(F.max("seq").alias("_seq"))
            if m["deleted"]["rows"] <= MOST:
                gone = F.broadcast(gone)
            a, b = rows.alias("a"), gone.alias("b")
            rows = a.join(b, F.col("a.document_id").eqNullSafe(F.col("b.document_id")) & (F.col("a.snapshot") < F.col("b._seq")), "left_anti")
        return rows.drop("snapshot", "try")

    def _scan(self, m: dict, name: str) -> DataFrame:
        t = m["tables"][name]
        schema = StructType.fromJson(t["schema"])
        plain = StructType([f for f in schema.fields if f.name not in t["by"]])
        parts = [f for f in schema.fields if f.name in t["by"]]
        full = StructType(plain.fields).add("snapshot", "long").add("try", "string")
        for f in parts:
            full = full.add(f)
        rows = self.spark.read.schema(full).option("basePath", f"{self.path}/data/{name}").parquet(*[f"{self.path}/{f}" for f in t["folders"]])
        return rows.select(*schema.names, "snapshot", "try")

    def _deleted(self, m: dict) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in m["deleted"]["folders"]])

    # ------------------------------------------------------------ writing

    def replace(self, tables: dict[str, DataFrame], documents: DataFrame | None = None, by: dict[str, list[str]] | None = None, notes: dict | None = None) -> int:
        """Commit rows of ``tables``; those of ``documents`` (document_id) in all tables so far are hidden from now on.

        ``by``: partition columns of tables that are new.  Returns the number of the snapshot.
        """
        m = self.manifest()
        seq = m["seq"] + 1
        for name, rows in tables.items():
            t = m["tables"].setdefault(name, {"folders": [], "by": (by or {}).get(name, []), "schema": rows.schema.jsonValue()})
            names = StructType.fromJson(t["schema"]).names
            folder = self._folder(name, seq)
            writer = rows.select(*names).write.option("compression", "zstd")
            (writer.partitionBy(*t["by"]) if t["by"] else writer).parquet(f"{self.path}/{folder}")
            t["folders"].append(folder)
        if documents is not None and seq > 1:
            folder = self._folder("deleted", seq)
            documents.select("document_id", F.lit(seq).cast("long").alias("seq")).distinct().write.parquet(f"{self.path}/{folder}")
            m["deleted"]["folders"].append(folder)
            m["deleted"]["rows"] += self.spark.read.parquet(f"{self.path}/{folder}").count()
        m["notes"] |= notes or {}
        self._put(m | {"seq": seq})
        return seq

    def compact(self) -> int:
        """Write all that is alive in one snapshot, without deletions."""
        m = self.manifest()
        seq = m["seq"] + 1
        for name, t in m["tables"].items():
            folder = self._folder(name, seq)
            rows = self.read(name)
            # rows of a partition are gathered, else each task writes a file of each
            (rows.repartition(*t["by"]).write.partitionBy(*t["by"]) if t["by"] else rows.write).option("compression", "zstd").parquet(f"{self.path}/{folder}")
            t["folders"] = [folder]
        m["deleted"] = {"folders": [], "rows": 0}
        self._put(m | {"seq": seq})
        return seq

    def expire(self, keep: int = 1) -> int:
        """Delete manifests but the last ``keep``, and folders that these don't list, such as those of failed commits.  Returns the number of folders."""
        known = self.versions()
        listed: set[str] = set()
        for v in known[-keep:]:
            m = self.manifest(v)
            listed.update(f for t in m["tables"].values() for f in t["folders"])
            listed.update(m["deleted"]["folders"])
        for v in known[:-keep]:
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        gone = 0
        for name in self._names("data"):
            for snapshot in self._names(f"data/{name}"):
                for attempt in self._names(f"data/{name}/{snapshot}"):
                    folder = f"data/{name}/{snapshot}/{attempt}"
                    if folder not in listed:
                        self._fs.delete(self._at(folder), True)
                        gone += 1
        return gone
