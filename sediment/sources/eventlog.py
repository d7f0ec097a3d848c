"""An append-only log of rows: batches that are there whole or not at all, and once however often they are sent."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EventLog:
    """Rows of ``schema`` under ``path``, a folder of Parquet files a batch, and a numbered file a commit.

    A batch is written to a folder of its own first, which nothing reads yet. Then the next commit file is created;
    the file system lets only one writer create a number, so who comes second looks at what the first one committed
    and takes the next. A commit that broke off before its last line counts for nothing and its number is spent. A
    batch goes by the name that its sender gives it: a name that is committed already is not committed again, and
    should two writers send one batch at a time, the lower number counts. So a batch whose sending failed at any
    point can be sent again. Folders without a commit are never read; ``vacuum`` deletes them."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _place(self, *parts: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        place, fs = self._place(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def commits(self) -> list[dict]:
        """What is committed, in order: number, batch, folder, rows. One line a batch."""
        if not self._listed("commits"):
            return []
        lines = self.spark.read.text(f"{self.path}/commits", wholetext=True).select(F.input_file_name().alias("file"), "value").collect()
        whole = [{"number": int(r["file"].rsplit("/", 1)[1]), **json.loads(r["value"])} for r in lines if r["value"].endswith("\n")]
        out: dict[str, dict] = {}
        for c in sorted(whole, key=lambda c: c["number"]):
            out.setdefault(c["batch"], c)
        return list(out.values())

    def append(self, rows: DataFrame, batch: str) -> int:
        """Commits ``rows`` (the columns of the schema) under the name ``batch`` and returns the number of the commit; a batch
        that is there already is left as it is."""
        for c in self.commits():
            if c["batch"] == batch:
                return c["number"]
        folder = uuid.uuid4().hex
        self._write(rows, folder)
        n = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").count()
        return self._commit({"batch": batch, "folder": folder, "rows": n})

    def _write(self, rows: DataFrame, folder: str) -> None:
        names = self.spark.createDataFrame([], self.schema).schema
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in names]).write.parquet(f"{self.path}/data/{folder}")

    def _commit(self, what: dict) -> int:
        line = (json.dumps(what) + "\n").encode()
        number = max([int(n) for n in self._listed("commits")], default=-1) + 1
        while True:
            place, fs = self._place("commits", f"{number:012}")
            try:
                out = fs.create(place, False)
            except Py4JJavaError as taken:
                if not fs.exists(place):
                    raise taken
                for c in self.commits():
                    if c["batch"] == what["batch"]:
                        return c["number"]
                number += 1
                continue
            self._say(out, line)
            return number

    def _say(self, out, line: bytes) -> None:
        out.write(bytearray(line))
        out.close()

    def read(self, upto: int | None = None) -> DataFrame:
        """All committed rows, of commits up to number ``upto`` if given, with the columns ``batch`` and ``commit`` (its number)."""
        some = [c for c in self.commits() if upto is None or c["number"] <= upto]
        if not some:
            return self.spark.createDataFrame([], f"{self.schema}, batch string, commit long")
        known = self.spark.createDataFrame([(c["folder"], c["batch"], c["number"]) for c in some], "_folder string, batch string, commit long")
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{c['folder']}" for c in some])
        rows = rows.withColumn("_folder", F.element_at(F.split(F.input_file_name(), "/"), -2))
        return rows.join(F.broadcast(known), "_folder").drop("_folder")  # a line a commit

    def vacuum(self) -> int:
        """Deletes folders that no commit names, and says how many. Not to be run beside writers."""
        named = {c["folder"] for c in self.commits()}
        lost = [f for f in self._listed("data") if f not in named]
        for folder in lost:
            place, fs = self._place("data", folder)
            fs.delete(place, True)
        return len(lost)

    def append_stream(self, stream: DataFrame, name: str, checkpoint: str) -> None:
        """Appends what a stream has now, a commit a micro-batch; ``name`` and the number of the micro-batch make the batch's
        name, so a micro-batch that runs again after a failure is there once."""
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, n: self.append(rows, f"{name}-{n}")).start()
        query.awaitTermination()
