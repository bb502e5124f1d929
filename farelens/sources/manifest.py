"""A relation kept as loads under a manifest, so that a publication replaces it in one step.

A publication writes a folder of its own (``data/load=<id>``) and then adds a
numbered manifest, a small JSON file that names the loads and the dates of
each that make up the relation.  Readers follow the newest whole manifest:
they see the relation before or after a publication, never between, and a
write that fails leaves nothing that a manifest names.  Replacing some dates
drops just these from older loads' lists; no file is rewritten or deleted
until ``vacuum``.

Two publications at once are told apart by the manifest's number, which only
one of them can create; the other raises and may be repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class NothingPublishedError(LookupError):
    """The path holds no manifest."""


class ConcurrentPublishError(RuntimeError):
    """Another publication took this manifest number; nothing was changed."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    fs = _fs(spark, path)
    if not fs.exists(_path(spark, path)):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(_path(spark, path)))


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """All whole manifests, oldest first; one still being written does not count."""
    out = []
    for name in _names(spark, f"{path}/manifest"):
        if not name.endswith(".json"):
            continue
        text = spark.read.text(f"{path}/manifest/{name}", wholetext=True).first()
        try:
            out.append(json.loads(text.value) if text else None)
        except json.JSONDecodeError:
            continue
    return [m for m in out if m]


def current(spark: SparkSession, path: str) -> dict:
    """The newest manifest: version and loads (id, dates or null for all); version 0 where nothing is published."""
    found = manifests(spark, path)
    return found[-1] if found else {"version": 0, "loads": []}


def _add(spark: SparkSession, path: str, manifest: dict) -> None:
    target = f"{path}/manifest/{manifest['version']:012d}.json"
    fs = _fs(spark, path)
    try:
        out = fs.create(_path(spark, target), False)
    except Exception as e:
        if fs.exists(_path(spark, target)):
            raise ConcurrentPublishError(target) from e
        raise
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()


def publish(
    spark: SparkSession,
    path: str,
    write: Callable[[str], None],
    partition: str | None,
    replace_only: bool = False,
    covers: Iterable[str] = (),
) -> dict:
    """Run ``write(folder)`` into a fresh folder and switch the relation to it.

    ``replace_only``: keep the other values of ``partition`` that earlier
    loads hold; ``covers`` names values that this load replaces even where it
    has no row of them.
    """
    if replace_only and not partition:
        raise ValueError("replacing some dates needs a partition column")
    before = current(spark, path)
    load = uuid.uuid4().hex
    folder = f"{path}/data/load={load}"
    write(folder)
    dates = None
    if partition:
        dates = [n.split("=", 1)[1] for n in _names(spark, folder) if n.startswith(f"{partition}=")]
    loads = []
    if replace_only:
        gone = {*dates, *covers}
        for old in before["loads"]:
            if old["dates"] is None:
                raise ValueError("the relation was published without partitions; it can only be replaced whole")
            if left := [d for d in old["dates"] if d not in gone]:
                loads.append({"id": old["id"], "dates": left})
    manifest = {"version": before["version"] + 1, "partition": partition, "loads": [*loads, {"id": load, "dates": dates}]}
    _add(spark, path, manifest)
    return manifest


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The relation of the newest manifest."""
    manifest = current(spark, path)
    if not manifest["loads"]:
        raise NothingPublishedError(path)
    folders = []
    for load in manifest["loads"]:
        root = f"{path}/data/load={load['id']}"
        if load["dates"] is None:
            folders.append(root)
        else:
            folders += [f"{root}/{manifest['partition']}={d}" for d in load["dates"]]
    if not folders:  # only empty loads: their schema, no rows
        return spark.read.parquet(*[f"{path}/data/load={load['id']}" for load in manifest["loads"]]).drop("load")
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("load")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete loads that none of the newest ``keep`` manifests names, and older manifests; the loads' ids."""
    if keep < 1:
        raise ValueError("the newest manifest has to stay")
    found = manifests(spark, path)
    used = {load["id"] for m in found[-keep:] for load in m["loads"]}
    fs = _fs(spark, path)
    for m in found[:-keep]:
        fs.delete(_path(spark, f"{path}/manifest/{m['version']:012d}.json"), False)
    gone = [n.split("=", 1)[1] for n in _names(spark, f"{path}/data") if n.startswith("load=") and n.split("=", 1)[1] not in used]
    for load in gone:
        fs.delete(_path(spark, f"{path}/data/load={load}"), True)
    return gone
