"""A model registry that several writers share: numbered commits, each written whole or not at all.

Records are written as parquet below ``data``. They count once a file ``commits/<number>.json``
names them; a number is taken by the one writer whose file appears under it first. Whoever
comes second reads the other's commit, checks again whether its own change still holds, and
tries the next number. So a version is registered once, and a status moves from the status
that the writer saw. A commit may hold several moves: a promotion archives the version
before in the same commit.

Taking a number needs a store that refuses to create a name twice: local and mounted folders
(hard links) and HDFS (rename) do. On object stores without that, one writer at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

COMMIT = "number long, data string, moves array<struct<model_name:string, version:string, status:string, at:string>>"
KEY = ["model_name", "version"]


def _place(spark: SparkSession, path: str):
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return java, java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder, system = _place(spark, f"{path}/commits")
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _claim(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Write commit ``number``; false if another writer has it."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    draft, system = _place(spark, f"{path}/drafts/{uuid.uuid4().hex}")
    target = java(f"{path}/commits/{number:012d}.json")
    system.mkdirs(target.getParent())
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if system.getUri().getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            system.delete(draft, False)
        return True
    if system.exists(target) or not system.rename(draft, target):
        system.delete(draft, False)
        return False
    return True


def _commit(spark: SparkSession, path: str, build: Callable[[], dict]) -> int:
    """Take the next number with what ``build`` makes of the registry as it then is."""
    while True:
        numbers = _numbers(spark, path)
        number = (numbers[-1] if numbers else 0) + 1
        if _claim(spark, path, number, {"number": number, **build()}):
            return number


def _commits(spark: SparkSession, path: str) -> DataFrame:
    numbers = _numbers(spark, path)
    if not numbers:
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).json([f"{path}/commits/{n:012d}.json" for n in numbers])


def history(spark: SparkSession, path: str) -> DataFrame:
    """Every status that a version was given: commit number, model_name, version, status, at."""
    return _commits(spark, path).select("number", F.explode("moves").alias("m")).select("number", "m.*")


def status(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each version."""
    last = F.max_by(F.struct("status", "at"), "number").alias("last")
    return history(spark, path).groupBy(*KEY).agg(last).select(*KEY, "last.status", F.col("last.at").alias("status_at"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All registered records with their present status; rows of abandoned writes are not seen."""
    folders = [r.data for r in _commits(spark, path).where("data is not null").select("data").distinct().collect()]
    if not folders:
        raise ValueError(f"no model is registered in {path}")
    records = spark.read.option("mergeSchema", "true").parquet(*sorted(folders))
    columns = records.columns
    now = status(spark, path).drop("status_at")
    return records.drop("status").join(now, KEY).select(columns)


def register(records: DataFrame, path: str) -> DataFrame:
    """Add records (model_name, version, status, trained_at, ...) in one commit and read the registry.

    Raises ValueError if a version is registered already, also by a writer at the same time.
    """
    spark = records.sparkSession
    data = f"{path}/data/{uuid.uuid4().hex}"
    records.write.parquet(data)
    written = spark.read.parquet(data)
    rows = written.select(*KEY, "status", F.col("trained_at").cast("string").alias("at")).collect()  # one row a model
    if len({(r.model_name, r.version) for r in rows}) < len(rows):
        raise ValueError("a version is given twice")

    def build() -> dict:
        known = {(r.model_name, r.version) for r in status(spark, path).collect()}
        twice = sorted(f"{r.model_name} {r.version}" for r in rows if (r.model_name, r.version) in known)
        if twice:
            raise ValueError(f"registered already: {', '.join(twice)}")
        return {"data": data, "moves": [r.asDict() for r in rows]}

    _commit(spark, path, build)
    return read(spark, path)


def move(spark: SparkSession, path: str, model_name: str, version: str, to: str, at: str,
         expected: str | None = None) -> int:
    """Give a version another status; ``expected`` is the status it must have until then."""
    def build() -> dict:
        now = {r.version: r.status for r in status(spark, path).where(F.col("model_name") == model_name).collect()}
        _check(now, model_name, version, expected)
        return {"data": None, "moves": [dict(model_name=model_name, version=version, status=to, at=at)]}
    return _commit(spark, path, build)


def promote(spark: SparkSession, path: str, model_name: str, version: str, at: str,
            expected: str | None = None) -> int:
    """Make a version the one in production and archive the one before, in one commit."""
    def build() -> dict:
        now = {r.version: r.status for r in status(spark, path).where(F.col("model_name") == model_name).collect()}
        _check(now, model_name, version, expected)
        before = sorted(v for v, s in now.items() if s == "Production" and v != version)
        moves = [(v, "Archived") for v in before] + [(version, "Production")]
        return {"data": None, "moves": [dict(model_name=model_name, version=v, status=s, at=at) for v, s in moves]}
    return _commit(spark, path, build)


def _check(now: dict[str, str], model_name: str, version: str, expected: str | None) -> None:
    if version not in now:
        raise ValueError(f"not registered: {model_name} {version}")
    if expected is not None and now[version] != expected:
        raise ValueError(f"{model_name} {version} is {now[version]}, not {expected}")
