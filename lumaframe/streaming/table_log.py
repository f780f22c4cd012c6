"""Tables that streams keep up: small writes, a log with checkpoints, rows merged by key when read.

A table lies in PARTS folders by a hash of its key, each with a few layers. A batch writes one new layer of the parts that its
keys are in; while the last two layers of a part have the same level they are merged into one of the next level, as digits
carry in a binary counter. So n batches leave log2(n) layers at most, and a row is written anew log2(n) times at most, however
long the stream runs.

What a version consists of is a log: an entry for each batch names only the parts that changed and the layers that it replaced, every
EVERY entries a checkpoint names all parts, and entries before the last checkpoint but one go. Replaced layers are removed when the
next batch comes, so a reader of the version before can finish. A batch that was written before changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders that a table is dealt over, and log entries from one checkpoint to the next.
PARTS, EVERY = 64, 10


def _system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    system, p = _system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(p)) if system.exists(p) else []


def _get(spark: SparkSession, path: str) -> dict:
    system, p = _system(spark, path)
    stream = system.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, value: dict) -> None:
    """Written aside and then named, so that no reader sees half of it."""
    system, aside = _system(spark, f"{path}.new")
    stream = system.create(aside, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    p = _system(spark, path)[1]
    system.delete(p, False)
    if not system.rename(aside, p):
        raise OSError(f"cannot name {path}")


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        system, p = _system(spark, path)
        system.delete(p, True)


def _state(spark: SparkSession, path: str) -> dict:
    """version (-1 before the first), parts {part: [[layer, level], ...]}, gone [[part, layer], ...] and how rows merge."""
    names = [n for n in _names(spark, f"{path}/log") if n.endswith(".json")]
    marks = [n for n in names if n.endswith(".checkpoint.json")]
    state = _get(spark, f"{path}/log/{marks[-1]}") if marks else {"version": -1, "parts": {}, "gone": [], "how": None}
    for n in names:
        if not n.endswith(".checkpoint.json") and int(n.split(".")[0]) > state["version"]:
            entry = _get(spark, f"{path}/log/{n}")
            state = {**entry, "parts": state["parts"] | entry["parts"]}
    return state


def version(spark: SparkSession, path: str) -> int:
    """The last batch in the table, -1 before the first."""
    return _state(spark, path)["version"]


def _merged(rows: DataFrame, how: dict) -> DataFrame:
    """One row per key: the last by an order, or sums."""
    if how["add"]:
        return rows.groupBy(*how["keys"]).agg(*[F.sum(c).alias(c) for c in how["add"]])
    columns = StructType.fromJson(how["schema"]).names
    return rows.groupBy(*how["keys"]).agg(F.max_by(F.struct(*columns), how["order"]).alias("r")).select("r.*")


def _layers(spark: SparkSession, path: str, how: dict, places: list[tuple[str, int]]) -> DataFrame:
    schema = StructType.fromJson(how["schema"])
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/v{at}/part={part}" for part, at in places])


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as its last batch left it; None before the first."""
    state = _state(spark, path)
    if state["version"] < 0:
        return None
    alone = [(p, layers[0][0]) for p, layers in state["parts"].items() if len(layers) == 1]
    several = [(p, at) for p, layers in state["parts"].items() if len(layers) > 1 for at, _ in layers]
    rows = _layers(spark, path, state["how"], alone)
    return rows.unionByName(_merged(_layers(spark, path, state["how"], several), state["how"])) if several else rows


def _write(path: str, how: dict, batch: DataFrame, number: int) -> None:
    spark = batch.sparkSession
    state = _state(spark, path)
    _remove(spark, [f"{path}/v{at}/part={p}" for p, at in state["gone"]])  # what only the version before the last one had
    if state["version"] >= number:
        return
    columns = [*how["keys"], *how["add"]] if how["add"] else batch.columns
    how = {**how, "schema": json.loads(batch.select(*columns).schema.json())}
    part = F.pmod(F.xxhash64(*how["keys"]), F.lit(how["parts"])).cast("int").alias("part")
    new = _merged(batch.select(*columns), how).select("*", part).persist()
    touched = sorted(str(r["part"]) for r in new.select("part").distinct().collect())
    parts, old = {}, []
    for p in touched:
        layers, level = [*state["parts"].get(p, [])], 0
        while layers and layers[-1][1] == level:
            old.append((p, layers.pop()[0]))
            level += 1
        parts[p] = [*layers, [number, level]]
    if touched:
        rows = new
        if old:
            both = _layers(spark, path, how, old).unionByName(new.drop("part"))
            rows = _merged(both, how).select("*", part)
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/v{number}")
    new.unpersist()
    entry = {"version": number, "parts": parts, "gone": old, "how": how}
    _put(spark, f"{path}/log/{number:020d}.json", entry)
    names = [n for n in _names(spark, f"{path}/log") if n.endswith(".json")]
    marks = [n for n in names if n.endswith(".checkpoint.json")]
    since = [n for n in names if n not in marks and (not marks or n.split(".")[0] > marks[-1].split(".")[0])]
    if len(since) >= EVERY:
        _put(spark, f"{path}/log/{number:020d}.checkpoint.json", {**entry, "parts": state["parts"] | parts})
        if marks:
            _remove(spark, [f"{path}/log/{n}" for n in names if n.split(".")[0] <= marks[-1].split(".")[0] and n != marks[-1]])


def upsert_into(path: str, keys: list[str], order: str, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last row per key by `order`, which may be a struct."""
    return lambda batch, number: _write(path, {"keys": keys, "order": order, "add": [], "parts": parts}, batch, number)


def add_into(path: str, keys: list[str], columns: list[str], parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps sums of columns per key; a batch brings changes, which may be negative."""
    return lambda batch, number: _write(path, {"keys": keys, "order": None, "add": columns, "parts": parts}, batch, number)
