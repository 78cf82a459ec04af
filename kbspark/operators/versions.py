"""Tables that change one version at a time.

A table is a folder of data folders and of manifests. A manifest names the columns and, for each partition, the data folders that make it up.
A change writes new data folders beside the old ones and then one manifest; the manifest's rename makes the change visible, all partitions at
once. A failed change leaves files that no manifest names. Readers keep the version they began with; :func:`expire` removes files that no kept
version names. Two writers that begin with one version cannot both succeed: the second finds its manifest's name taken.

A manifest is as large as the list of partitions, never as the data.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .store import exists

_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another writer has made a version meanwhile."""


@dataclass
class Manifest:
    """``parts`` maps a partition (``a=1/b=x``) to its data folders, ``marks`` a stream to the last batch that is in."""

    version: int
    schema: StructType
    partitions: list[str]
    parts: dict[str, list[str]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are there, oldest first."""
    return sorted(int(n[1:-5]) for n in _names(spark, f"{path}/manifests") if n.startswith("v") and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """A version's manifest, the last one's by default; None if the table is not there."""
    known = versions(spark, path)
    if not known:
        return None
    version = known[-1] if version is None else version
    text = spark.read.option("wholetext", True).text(f"{path}/manifests/v{version:012d}.json").first()["value"]
    raw = json.loads(text)
    return Manifest(version, StructType.fromJson(raw["schema"]), raw["partitions"], raw["parts"], raw["marks"])


def _commit(spark: SparkSession, path: str, new: Manifest) -> None:
    text = json.dumps({"schema": new.schema.jsonValue(), "partitions": new.partitions, "parts": new.parts, "marks": new.marks})
    target, draft = f"{path}/manifests/v{new.version:012d}.json", f"{path}/manifests/.{uuid.uuid4().hex}"
    files, place = _files(spark, draft)
    out = files.create(place)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    _, goal = _files(spark, target)
    if exists(spark, target):
        raise Conflict(target)
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
    try:
        jvm.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(place, goal, options)
    except Exception as err:
        if exists(spark, target):
            raise Conflict(target) from err
        raise


def files_of(spark: SparkSession, path: str, root: str, part: str) -> list[str]:
    """Data files of a partition in a data folder."""
    return [n for n in _names(spark, f"{path}/data/{root}/{part}") if n.startswith("part-")]


def read(spark: SparkSession, path: str, version: int | None = None, only: set[str] | None = None) -> DataFrame:
    """The rows of a version, or those of the partitions ``only``. The files are chosen by the manifest, not by what lies in the folders."""
    now = manifest(spark, path, version)
    if now is None:
        raise FileNotFoundError(path)
    return _rows(spark, path, now, only)


def _rows(spark: SparkSession, path: str, now: Manifest, only: set[str] | None = None) -> DataFrame:
    places: dict[str, list[str]] = {}
    for part, roots in now.parts.items():
        if only is None or part in only:
            for root in roots:
                places.setdefault(root, []).append(f"{path}/data/{root}/{part}" if part else f"{path}/data/{root}")
    read = [
        spark.read.schema(now.schema).option("basePath", f"{path}/data/{root}").parquet(*sorted(folders)).select(*now.schema.names)
        for root, folders in sorted(places.items())
    ]
    return reduce(DataFrame.union, read) if read else spark.createDataFrame([], now.schema)


def _write(rows: DataFrame, path: str, partitions: list[str]) -> tuple[str, list[str]]:
    """Write rows to a new data folder: (its name, the partitions it has)."""
    spark, root = rows.sparkSession, uuid.uuid4().hex
    where = f"{path}/data/{root}"
    writer = rows.write
    (writer.partitionBy(*partitions) if partitions else writer).parquet(where)
    if not partitions:
        return root, [""]
    found = [""]
    for name in partitions:
        found = [f"{f}/{n}".lstrip("/") for f in found for n in _names(spark, f"{where}/{f}") if n.lower().startswith(f"{name.lower()}=")]
    return root, found


def _touched(rows: DataFrame, partitions: list[str], now: Manifest) -> set[str]:
    """Those partitions of the table that rows have too; as many as the table has at most."""
    if not partitions:
        return set(now.parts)
    values = {tuple(r) for r in rows.select(*[F.col(c).cast("string") for c in partitions]).distinct().collect()}

    def value(text: str) -> str | None:
        return None if text == _NO_VALUE else unquote(text)

    return {p for p in now.parts if tuple(value(x.split("=", 1)[1]) for x in p.split("/")) in values}


def _next(rows: DataFrame, now: Manifest | None, partitions: list[str]) -> Manifest:
    if now is None:
        return Manifest(1, rows.schema, partitions)
    if now.partitions != partitions:
        raise ValueError(f"the table is partitioned by {now.partitions}")
    return Manifest(now.version + 1, now.schema, partitions, {k: list(v) for k, v in now.parts.items()}, dict(now.marks))


def append(rows: DataFrame, path: str, partitions: list[str], mark: tuple[str, int] | None = None) -> int:
    """Add rows; the number of the version that has them. With ``mark`` (stream, batch), a batch that is in already is not added again."""
    spark = rows.sparkSession
    now = manifest(spark, path)
    if mark is not None and now is not None and now.marks.get(mark[0], -1) >= mark[1]:
        return now.version
    new = _next(rows, now, partitions)
    root, found = _write(rows.select(*new.schema.names), path, partitions)
    for part in found:
        new.parts.setdefault(part, []).append(root)
    if mark is not None:
        new.marks[mark[0]] = mark[1]
    _commit(spark, path, new)
    return new.version


def upsert(incoming: DataFrame, path: str, keys: list[str], partitions: list[str]) -> int:
    """Put rows in place of those with their ``keys`` in the same partitions; other partitions are neither read nor written.

    Every row of a touched partition is written once. Null keys never meet, so rows with one are added.
    """
    spark = incoming.sparkSession
    now = manifest(spark, path)
    new = _next(incoming, now, partitions)
    rows = incoming.select(*new.schema.names)
    if now is not None:
        old = _rows(spark, path, now, _touched(incoming, partitions, now))
        rows = old.join(incoming.select(*keys).distinct(), keys, "left_anti").select(*new.schema.names).unionByName(rows)
    root, found = _write(rows, path, partitions)
    for part in found:
        new.parts[part] = [root]
    _commit(spark, path, new)
    return new.version


def delete(spark: SparkSession, path: str, gone: DataFrame, keys: list[str]) -> int:
    """Remove the rows whose ``keys`` are in ``gone``. Partitions that lose nothing keep their files."""
    now = manifest(spark, path)
    if now is None:
        raise FileNotFoundError(path)
    own = now.partitions
    rows = _rows(spark, path, now)
    hit = rows.join(gone.select(*keys).distinct(), keys, "left_semi")
    touched = _touched(hit, own, now)
    new = _next(rows, now, own)
    if touched:
        left = _rows(spark, path, now, touched).join(gone.select(*keys).distinct(), keys, "left_anti").select(*now.schema.names)
        root, found = _write(left, path, own)
        for part in touched:
            new.parts.pop(part)
        for part in found:
            new.parts[part] = [root]
    _commit(spark, path, new)
    return new.version


def compact(spark: SparkSession, path: str, only: set[str], keys: list[str], file_bytes: int = 256 << 20) -> int:
    """Rewrite partitions into as few files as their bytes ask for, each row of equal ``keys`` once; the version that has them.

    A row that comes several times is kept as its least copy in the order of all columns, so a repeated run gives the same rows.
    """
    now = manifest(spark, path)
    if now is None:
        raise FileNotFoundError(path)
    only = only & set(now.parts)
    new = _next(_rows(spark, path, now, set()), now, now.partitions)
    if only:
        rows = _rows(spark, path, now, only)
        rest = [c for c in now.schema.names if c not in (*keys, *now.partitions)]
        by = list(dict.fromkeys([*now.partitions, *keys]))
        once = rows.groupBy(*by).agg(F.min(F.struct(*rest)).alias("_rest")).select(*by, "_rest.*").select(*now.schema.names)
        size = sum(_bytes(spark, f"{path}/data/{root}/{part}") for part in only for root in now.parts[part])
        files = max(1, -(-size // file_bytes))
        dealt = once.repartition(*now.partitions, F.pmod(F.xxhash64(*keys), F.lit(files))) if now.partitions else once.repartition(files)
        root, found = _write(dealt, path, now.partitions)
        for part in only:
            new.parts.pop(part)
        for part in found:
            new.parts[part] = [root]
    _commit(spark, path, new)
    return new.version


def _bytes(spark: SparkSession, path: str) -> int:
    files, place = _files(spark, path)
    return int(files.getContentSummary(place).getLength())


def expire(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all versions but the last ``keep`` and the data folders that these do not name; the number of folders removed.

    Folders of a change that is not committed yet go too, so it is for times without a writer.
    """
    known = versions(spark, path)
    kept = {root for v in known[-keep:] for roots in manifest(spark, path, v).parts.values() for root in roots}
    for v in known[:-keep]:
        files, place = _files(spark, f"{path}/manifests/v{v:012d}.json")
        files.delete(place, False)
    gone = [n for n in _names(spark, f"{path}/data") if n not in kept]
    for name in gone:
        files, place = _files(spark, f"{path}/data/{name}")
        files.delete(place, True)
    return len(gone)
