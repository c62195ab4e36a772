"""Session helpers: table loading and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor can reach.

    Only where the setting is unset and the session runs on one machine (tests) a local temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lawlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lawlake/{label}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def rename(spark: SparkSession, src: str, dst: str) -> None:
    """Publish ``src`` as ``dst`` in one step; fails if ``dst`` exists or the rename is refused."""
    fs, a = _fs(spark, src)
    _, b = _fs(spark, dst)
    if fs.exists(b) or not (fs.mkdirs(b.getParent()) and fs.rename(a, b)):
        raise OSError(f"cannot publish {src} as {dst}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a small control file; fails if it exists. Cut off while writing, it is there incomplete."""
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the data files directly in a folder."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))


class Generations:
    """States of a store in a folder: each is written under ``data/`` and made the current one by creating a pointer.

    Pointers are numbered and only ever created, so readers see a whole state or the one before, a crash leaves
    the one before, and of two writers that start from the same state one fails.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def current(self) -> tuple[int, str | None]:
        """Number and folder of the newest complete generation; (0, None) before the first."""
        for name, _ in reversed(list_files(self.spark, f"{self.folder}/current")):
            text = read_text(self.spark, f"{self.folder}/current/{name}") or ""
            if text.endswith("\n"):  # else cut off while being written
                return int(name), f"{self.folder}/data/{text.strip()}"
        return 0, None

    def start(self) -> str:
        """A folder for the next generation."""
        return f"{self.folder}/data/{uuid.uuid4().hex}"

    def publish(self, written: str, after: int) -> None:
        """Make the written folder the current generation, if ``after`` still is the newest."""
        if self.current()[0] != after:
            raise OSError(f"another writer published after {after}")
        used = [int(name) for name, _ in list_files(self.spark, f"{self.folder}/current")]
        create_text(self.spark, f"{self.folder}/current/{max(used, default=0) + 1:012d}", written.rpartition("/")[2] + "\n")
