"""Stage borders of a pipeline: tables written to a shared folder."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "manifests"

_UNNAMED: list[StageStore] = []


def _is_local(master: str) -> bool:
    """One machine: executors and driver share its disk."""
    return master.split("[")[0] in ("local", "local-cluster")


FORMAT = 1  # part of every key; raise it when stages of older code must not be used again


class StageStore:
    """Where a pipeline keeps its stage tables.

    Each stage is written as Parquet (overwriting what an earlier run left) and
    read back: it is computed once, its lineage ends at a table that outlives
    any executor, and Spark knows the exact size of what it joins next.

    With ``resume`` a stage of an earlier run is read instead if it was made of
    the same inputs. A stage's folder carries a key: the digest of its name, the
    files its plan reads (path, length, time of change) and its parameters. An
    upstream stage is among these files under its own key, so a changed source or
    parameter gives new keys to exactly the stages that depend on it. A plan that
    reads no files is known by its name alone. A manifest of each stage says what
    it was made of; ``drop`` removes a stage with all that depend on it, ``prune``
    what this run has not used.
    """

    def __init__(self, spark: SparkSession, folder: str, resume: bool = False):
        self.spark, self.folder, self.resume = spark, folder.rstrip("/"), resume
        self.used: set[str] = set()  # keyed folders of this run
        self.written: list[str] = []  # names of stages that were not there
        self.tables: list[str] = []  # bucketed stages are known to the catalog

    @classmethod
    def for_session(cls, spark: SparkSession, run_id: str | None = None) -> StageStore:
        """A folder below the session's shared checkpoint folder
        (``spark.checkpoint.dir``): a new one, or that of the named run, whose
        completed stages are then used again.

        Where the setting is unset, a local session gets a temporary folder that
        goes away with the process. A cluster has to name a folder that all its
        executors share, so a ``file:`` path is refused there unless
        ``spark.anchorset.sharedFiles`` states that it is a shared mount.
        """
        shared = spark.conf.get("spark.checkpoint.dir", None)
        local = _is_local(spark.conf.get("spark.master", ""))
        if shared:
            own_disk = shared.startswith("file:") and spark.conf.get("spark.anchorset.sharedFiles", "") != "true"
            if own_disk and not local:
                raise ValueError("spark.checkpoint.dir is a local path, which executors do not share")
            name = f"stages-{run_id or uuid.uuid4().hex}"
            store = cls(spark, f"{shared.rstrip('/')}/{name}", resume=run_id is not None)
            if run_id is None:
                _UNNAMED.append(store)
            return store
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="stages-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        store = cls(spark, folder)
        _UNNAMED.append(store)
        return store

    @staticmethod
    def remove_all(spark: SparkSession) -> int:
        """Remove the folders of a session's unnamed runs, once their results are
        written or no longer needed; returns how many there were."""
        own = [store for store in _UNNAMED if store.spark is spark]
        for store in own:
            _UNNAMED.remove(store)
            store.remove()
        return len(own)

    def border(self, name: str, df: DataFrame, **params) -> DataFrame:
        """The stage as a stored table. ``params`` are values that shape it and
        are not seen in the files that its plan reads."""
        if not self.resume:
            return self.write(name, df)
        made_of = self._made_of(name, df, params)
        place = self._place(made_of) if made_of["files"] else name
        self.used.add(place)
        if not self.has(place):
            # The manifest goes first: a complete stage always has one.
            self._save(f"{MANIFESTS}/{place}.json", json.dumps(made_of))
            self.write(place, df)
            self.written.append(name)
        return self.read(place)

    @staticmethod
    def _place(made_of: dict) -> str:
        digest = hashlib.sha256(json.dumps(made_of, sort_keys=True).encode()).hexdigest()
        return f"{made_of['name']}-{digest[:24]}"

    def write(self, place: str, df: DataFrame) -> DataFrame:
        """Write a table below the run's folder and read it back."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{place}")
        return self.read(place)

    def bucketed(self, name: str, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """The stage as a table of the session's catalog, dealt to buckets by key
        and sorted in them: joins and aggregates of such tables on the key need no
        shuffle, however large they are. One shuffle writes it, a file a bucket."""
        table = f"stage_{uuid.uuid4().hex}_{name}"
        dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        dealt.option("path", f"{self.folder}/{name}").mode("overwrite").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def read(self, place: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{place}")

    def has(self, place: str) -> bool:
        """Whether a table was written to its end."""
        return self._complete(f"{self.folder}/{place}")

    def _made_of(self, name: str, df: DataFrame, params: dict) -> dict:
        """What a stage's key is taken from: driver-side listing of the folders
        that its plan reads, as the scans themselves list them."""
        uri = self.spark.sparkContext._jvm.java.net.URI
        paths = [self._hadoop_path(uri(p)) for p in df.inputFiles()]
        wanted, files = {p.toUri().getPath() for p in paths}, []
        for folder in {p.getParent().toString(): p.getParent() for p in paths}.values():
            for status in folder.getFileSystem(self._hadoop_conf()).listStatus(folder):
                if (path := status.getPath().toUri().getPath()) in wanted:
                    files.append([path, status.getLen(), status.getModificationTime()])
        return {"format": FORMAT, "name": name, "files": sorted(files), "params": {k: repr(v) for k, v in params.items()}}

    def manifests(self) -> dict[str, dict]:
        """What the stages of the run's folder were made of, by their place."""
        found = self._list(MANIFESTS)
        if not found:
            return {}
        texts = self.spark.read.text(f"{self.folder}/{MANIFESTS}", wholetext=True).collect()
        every = [json.loads(r[0]) for r in texts]
        placed = {self._place(m) if m["files"] else m["name"]: m for m in every}
        return {place: m for place, m in placed.items() if self.has(place)}

    def dependants(self, name: str) -> set[str]:
        """Places of the stage's versions and of every stage made of them."""
        manifests = self.manifests()
        found = {place for place, m in manifests.items() if m["name"] == name}
        while True:
            made = {
                place
                for place, m in manifests.items()
                if any(f"/{up}/" in path for path, _, _ in m["files"] for up in found)
            }
            if made <= found:
                return found
            found |= made

    def drop(self, name: str) -> set[str]:
        """Remove a stage and all that depend on it; returns their places."""
        return self._drop(self.dependants(name))

    def prune(self) -> set[str]:
        """Remove the stages that this run has not used."""
        return self._drop(set(self.manifests()) - self.used)

    def _drop(self, places: set[str]) -> set[str]:
        for place in places:
            for path in (f"{self.folder}/{place}", f"{self.folder}/{MANIFESTS}/{place}.json"):
                at = self._hadoop_path(path)
                at.getFileSystem(self._hadoop_conf()).delete(at, True)
        return places

    def _save(self, place: str, text: str) -> None:
        at = self._hadoop_path(f"{self.folder}/{place}")
        out = at.getFileSystem(self._hadoop_conf()).create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _list(self, place: str) -> list[str]:
        at = self._hadoop_path(f"{self.folder}/{place}")
        system = at.getFileSystem(self._hadoop_conf())
        return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []

    def _complete(self, path: str) -> bool:
        """A job that ended well leaves a marker; one that broke off does not."""
        marker = self._hadoop_path(f"{path}/_SUCCESS")
        return marker.getFileSystem(self._hadoop_conf()).exists(marker)

    def remove(self) -> None:
        """Delete the run's folder; tables read from it are gone then."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        folder = self._hadoop_path(self.folder)
        folder.getFileSystem(self._hadoop_conf()).delete(folder, True)

    def _hadoop_path(self, path):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _hadoop_conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def borders(self, frames: dict[str, DataFrame], key: str = "", buckets: int = 0) -> dict[str, DataFrame]:
        """Stages that do not depend on one another, written at the same time so
        that a short one does not leave the cluster idle; with ``buckets``, each
        ``bucketed`` by the key."""
        write = (lambda name, df: self.bucketed(name, df, key, buckets)) if buckets else self.border
        with ThreadPoolExecutor(len(frames)) as pool:
            done = {name: pool.submit(write, name, df) for name, df in frames.items()}
            return {name: job.result() for name, job in done.items()}
