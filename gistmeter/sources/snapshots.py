"""A keyed table as versions behind manifests: merges rewrite only touched buckets and commit by one rename.

Rows lie in buckets by a hash of their key. A manifest names, for one version, the folder of each bucket; folders are
never changed once written. A merge writes new folders for the buckets its changes touch and then a manifest that
names them beside the untouched ones. The table moves on when that manifest is renamed to the next version's name,
which fails if another writer was faster. A writer that dies before leaves only folders nobody names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.sources.sinks import key_violations

_BUCKET = "_gm_bucket"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    place, system = _hadoop(spark, path)
    stream = system.create(place, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first; none for a table that does not exist."""
    place, system = _hadoop(spark, f"{path}/manifests")
    if not system.exists(place):
        return []
    names = (s.getPath().getName() for s in system.listStatus(place))
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, the newest by default."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {'' if version is None else version} of {path}")
    return json.loads(_read_text(spark, f"{path}/manifests/{known[-1] if version is None else version}.json"))


def _commit(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Make a manifest the table's version ``version``; ``Conflict`` if there is one already."""
    draft = f"{path}/manifests/draft-{uuid.uuid4().hex}"
    _write_text(spark, draft, json.dumps(content, sort_keys=True))
    jvm = spark._jvm
    place, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (draft, f"{path}/manifests/{version}.json"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(place, target, option)
    except Exception as failed:
        context.delete(place, False)
        if "FileAlreadyExists" in str(failed):
            raise Conflict(f"{path} already has version {version}") from failed
        raise


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int) -> dict[str, str]:
    """Write rows by bucket to a new folder; the folder of each bucket that has rows."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    spark = df.sparkSession
    placed = df.withColumn(_BUCKET, _bucket(keys, buckets))
    placed.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(folder)
    place, system = _hadoop(spark, folder)
    names = (s.getPath().getName() for s in system.listStatus(place))
    return {name.split("=")[1]: f"{folder}/{name}" for name in names if name.startswith(f"{_BUCKET}=")}


def _checked(df: DataFrame, keys: list[str]) -> None:
    if not key_violations(df, keys).isEmpty():
        raise ValueError(f"rows with a null or repeated key ({', '.join(keys)})")


def create(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> int:
    """Write the first version of a table and return its number, 0. Keys must be present and unique.

    A bucket is rewritten by one task, so choose ``buckets`` by the size of the table: about 256 MB each.
    """
    spark = df.sparkSession
    if versions(spark, path):
        raise Conflict(f"{path} exists")
    _checked(df, keys)
    content = {"keys": keys, "buckets": buckets, "schema": df.schema.json(), "folders": _write_buckets(df, path, keys, buckets)}
    _commit(spark, path, 0, content)
    return 0


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default; older ones stay readable."""
    return _read_folders(spark, manifest(spark, path, version))


def _read_folders(spark: SparkSession, content: dict, only: set[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(content["schema"]))
    folders = [folder for bucket, folder in sorted(content["folders"].items()) if only is None or bucket in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge(changes: DataFrame, path: str, base: int | None = None) -> int:
    """Replace rows by key, add rows of new keys, commit the next version and return its number.

    ``base`` is the version the changes were made from (the newest by default); if another writer has committed
    since, ``Conflict`` is raised and the table is as that writer left it. Changes have the table's columns and
    unique, present keys. Only buckets with changes are read and written, once; the list of these, at most one entry
    per bucket, is all that the driver sees.
    """
    spark = changes.sparkSession
    base = versions(spark, path)[-1] if base is None else base
    content = manifest(spark, path, base)
    keys, buckets = content["keys"], content["buckets"]
    schema = T.StructType.fromJson(json.loads(content["schema"]))
    changes = changes.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    _checked(changes, keys)
    touched = {str(r[0]) for r in changes.select(_bucket(keys, buckets)).distinct().collect()}
    current = _read_folders(spark, content, touched)
    kept = current.join(changes.select(*keys), keys, "left_anti").select(*changes.columns)
    written = _write_buckets(kept.unionByName(changes), path, keys, buckets) if touched else {}
    _commit(spark, path, base + 1, content | {"folders": content["folders"] | written})
    return base + 1
