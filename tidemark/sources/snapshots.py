"""Tables of Parquet files that rows can be taken out of: erasure rewrites the buckets that hold a subject and nothing else, and swaps them in at once.

A table is a folder with data folders and numbered manifests; a manifest names the folder of each bucket (a hash of the subject's key), and the one of the
highest number is the table. A new manifest is put in place by a rename that fails if its number is taken, so of two writers one starts again. Readers see the old
files or the new ones, never both. All file work goes through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS, BUCKET = "_manifests", "_bucket"


class Snapshot:
    """One table at ``path``; ``key`` is the subject's column and ``buckets`` how many buckets it is dealt into."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def _numbers(self) -> list[int]:
        at = self._at(MANIFESTS)
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def manifest(self) -> tuple[int, dict]:
        """The number and content of the manifest that holds: ``key, buckets, schema, folders`` (folders by bucket)."""
        numbers = self._numbers()
        if not numbers:
            raise ValueError(f"no table at {self.path}")
        text = self.spark.read.option("wholetext", True).text(str(self._at(MANIFESTS, str(numbers[-1])))).first()[0]
        return numbers[-1], json.loads(text)

    def _swap(self, number: int, content: dict) -> None:
        self._fs.mkdirs(self._at(MANIFESTS))
        draft = self._at(MANIFESTS, f"draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(draft, self._at(MANIFESTS, str(number)), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def _write(self, df: DataFrame, key: str, buckets: int) -> dict[str, list[str]]:
        """Folders by bucket of ``df``'s rows, in a new data folder."""
        folder = f"data-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
        df.withColumn(BUCKET, bucket).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(folder)) if f.isDirectory()]
        return {name.split("=")[1]: [f"{folder}/{name}"] for name in names}

    def create(self, df: DataFrame, key: str, buckets: int = 64) -> None:
        """``df`` as a new table; null keys are a bucket's rows like others. It is an error if there is a table."""
        if self._numbers():
            raise ValueError(f"there is a table at {self.path}")
        self._swap(1, {"key": key, "buckets": buckets, "schema": df.schema.json(), "folders": self._write(df, key, buckets)})

    def _rows(self, content: dict, folders: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(content["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The rows that the table has now."""
        _, content = self.manifest()
        return self._rows(content, [f for fs in content["folders"].values() for f in fs])

    def erase(self, subjects: DataFrame, archive: str | None = None) -> int:
        """Takes out all rows of ``subjects`` (a column of keys, any number of them) and returns how many there were; null keys take out nothing.

        Only the buckets that hold a subject are read and written anew; files of the others stay as they are. The rows go to ``archive`` first, if it is given. The old files are deleted once
        the new ones are in place, so the rows are gone.
        """
        number, content = self.manifest()
        key, buckets = content["key"], content["buckets"]
        wanted = subjects.select(F.col(subjects.columns[0]).alias("_subject")).where("_subject is not null").distinct()
        hit = wanted.select(F.pmod(F.xxhash64(F.col("_subject").cast("string")), F.lit(buckets)).cast("string").alias("b")).distinct()
        touched = sorted({r["b"] for r in hit.collect()} & content["folders"].keys())  # buckets at most
        old = self._rows(content, [f for b in touched for f in content["folders"][b]])
        ours: Column = old[key] == wanted["_subject"]
        gone = old.join(wanted, ours, "left_semi")
        if archive is not None:
            gone.write.mode("append").parquet(archive)
        n = gone.count()
        if not n:
            return 0
        fresh = self._write(old.join(wanted, ours, "left_anti"), key, buckets)
        kept = {b: fs for b, fs in content["folders"].items() if b not in touched}
        self._swap(number + 1, content | {"folders": kept | fresh})
        self.vacuum()
        return n

    def restore(self, archive: str) -> int:
        """Puts the rows of an archive back beside what the table has, deletes the archive, and returns how many there were."""
        number, content = self.manifest()
        rows = self._rows(content, []).unionByName(self.spark.read.parquet(archive))
        n = rows.count()
        fresh = self._write(rows, content["key"], content["buckets"]) if n else {}
        folders = {b: content["folders"].get(b, []) + fresh.get(b, []) for b in content["folders"].keys() | fresh.keys()}
        self._swap(number + 1, content | {"folders": folders})
        at = self._hadoop.Path(archive)
        at.getFileSystem(self._conf).delete(at, True)
        return n

    def vacuum(self) -> None:
        """Deletes the data folders and manifests that the table no longer uses, and the drafts of writers that failed."""
        number, content = self.manifest()
        used = {f for fs in content["folders"].values() for f in fs}
        for top in self._fs.listStatus(self._at()):
            name = top.getPath().getName()
            if name.startswith("data-"):
                inside = [f.getPath() for f in self._fs.listStatus(top.getPath()) if f.isDirectory()]
                if not any(f"{name}/{p.getName()}" in used for p in inside):
                    self._fs.delete(top.getPath(), True)
                    continue
                for p in inside:
                    if f"{name}/{p.getName()}" not in used:
                        self._fs.delete(p, True)
        for f in self._fs.listStatus(self._at(MANIFESTS)):
            if f.getPath().getName() != str(number):
                self._fs.delete(f.getPath(), False)
