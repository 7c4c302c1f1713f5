"""Append-only upserts from a stream of edges, into a table of which a batch rewrites only the parts that it touches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from graphloom.operators import store
from graphloom.operators.provenance import TRIPLE

#: Versions of a table or of a run that are kept.
KEPT = 8


class Versions:
    """Numbered manifests in a folder, the greatest being current; one is written aside and then renamed, so that readers see a whole one or none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(folder))

    def numbers(self) -> list[int]:
        found = self.fs.globStatus(self._path(f"{self.folder}/manifest-*")) or []
        return sorted(int(s.getPath().getName().split("-")[1]) for s in found)

    def read(self, number: int | None = None) -> list[str]:
        """The lines of a manifest, of the current one if no number is given; none if there is no manifest."""
        numbers = self.numbers()
        if not numbers:
            return []
        at = f"{self.folder}/manifest-{numbers[-1] if number is None else number:012d}"
        return [r[0] for r in self.spark.read.text(at).collect()]

    def commit(self, lines: list[str]) -> int:
        """Write the next manifest; if another writer took its number first an error is raised and nothing changes."""
        number = (self.numbers() or [0])[-1] + 1
        aside, at = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifest-{number:012d}")
        out = self.fs.create(aside, False)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        if self.fs.exists(at) or not self.fs.rename(aside, at):
            self.fs.delete(aside, False)
            raise RuntimeError(f"another writer made version {number}")
        return number

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class GraphTable:
    """A stored edge table in `buckets` parts by the hash of the triple; a new version points to the old parts but for those that a batch touches.

    A lost task changes nothing, as the parts are written before the manifest. The last KEPT versions can be read; parts that none of them has are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.versions = Versions(spark, folder)

    def parts(self, number: int | None = None) -> dict[int, str]:
        return {int(k): v for k, v in (x.split(" ", 1) for x in self.versions.read(number) if x)}

    def read(self, number: int | None = None) -> DataFrame | None:
        """The table, None before the first upsert."""
        paths = sorted(set(self.parts(number).values()))
        return self.spark.read.parquet(*paths).drop("bucket") if paths else None

    def upsert(self, incoming: DataFrame) -> None:
        """Merging the same rows again changes nothing, so a repeated batch is harmless."""
        bucket = F.pmod(F.xxhash64(*TRIPLE), F.lit(self.buckets)).cast("int")
        incoming = incoming.withColumn("bucket", bucket)
        touched = [r[0] for r in incoming.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        old = self.parts()
        paths = sorted({old[b] for b in touched if b in old})
        new = store.merge(incoming) if not paths else store.upsert(self.spark.read.parquet(*paths).drop("bucket"), incoming)
        at = f"{self.folder}/v-{uuid.uuid4().hex}"
        new.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(at)
        self.versions.commit([f"{b} {p}" for b, p in sorted((old | {b: f"{at}/bucket={b}" for b in touched}).items())])
        self.clean()

    def reset(self) -> None:
        """An empty table; the versions before it stay until they are KEPT upserts old."""
        self.versions.commit([])

    def clean(self) -> None:
        numbers = self.versions.numbers()
        if len(numbers) > KEPT:
            kept = {p for n in numbers[-KEPT:] for p in self.parts(n).values()}
            for n in numbers[:-KEPT]:
                for p in {*self.parts(n).values()} - kept:
                    self.versions.delete(p)
                self.versions.delete(f"{self.folder}/manifest-{n:012d}")


class RunStore:
    """Tables of named runs; beyond KEPT runs the one that was begun first is dropped."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.versions = Versions(spark, folder)

    def runs(self) -> dict[str, str]:
        return dict(x.split("\t", 1) for x in self.versions.read() if x)

    def save(self, run: str, rows: DataFrame) -> None:
        at = f"{self.folder}/run-{uuid.uuid4().hex}"
        rows.write.parquet(at)
        runs = self.runs()
        gone = [runs[run]] if run in runs else []
        runs[run] = at
        gone += [runs.pop(name) for name in [*runs][: max(0, len(runs) - KEPT)]]
        self.versions.commit([f"{k}\t{v}" for k, v in runs.items()])
        for p in gone:
            self.versions.delete(p)

    def load(self, run: str) -> DataFrame | None:
        at = self.runs().get(run)
        return self.spark.read.parquet(at) if at else None


class Progress(StreamingQueryListener):
    """Keeps (batch, rows) of the streams of a session, the last `last` of them, and calls back with each."""

    def __init__(self, call=None, last: int = 1000):
        self.seen, self.call, self.last = [], call, last

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.seen = [*self.seen, (event.progress.batchId, event.progress.numInputRows)][-self.last :]
        if self.call:
            self.call(*self.seen[-1])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def upsert_stream(edges: DataFrame, target: GraphTable, checkpoint: str) -> StreamingQuery:
    """Feed a streaming frame of edges (see provenance.edges) into a graph table, one version a batch."""

    def batch(df: DataFrame, _: int) -> None:
        target.upsert(df)

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
