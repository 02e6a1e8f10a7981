"""Published tables in versions: shards that have not changed are not written again, and a version counts once its manifest is whole.

Below a folder lie ``rows/v=N/shard=X`` and ``versions/v=N``, the manifest of version N: for each shard its rows, its digest and the version that
wrote it.  Manifests are small; their folder's success mark, which Spark writes last, is what makes a version the latest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .durable import durable

_MANIFEST = "shard string, rows long, digest string, written long"


def files(spark: SparkSession, path: str):
    """The file system of ``path`` and the path itself."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def versions_of(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions whose manifest is whole, from the names of their folders."""
    system, folder = files(spark, f"{path}/versions")
    if not system.exists(folder):
        return []
    names = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("v=")]
    whole = [n for n in names if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
    return sorted(int(n.getName()[2:]) for n in whole)


@dataclass(frozen=True)
class Published:
    """What a publication did; ``version`` is the one that counts now."""

    version: int | None
    rows: int
    written: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()


def manifest_of(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(shard, rows, digest, written) of a version, of the latest unless one is named; empty if there is none."""
    numbers = versions_of(spark, path)
    if not numbers:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/versions/v={numbers[-1] if version is None else version}")


def publish(docs: DataFrame, path: str, shard: Column, most_lost: float | None = None, force: bool = False) -> Published:
    """Makes ``docs`` the latest version at ``path``, as gzip JSON lines by ``shard``, a text of letters and digits.

    The rows are computed once.  Shards whose rows are those of the version before are not written; shards without rows are in no manifest, and go
    with the version before the last.  If nothing differs nothing is written.  With ``most_lost`` nothing is published if there are no rows or
    that share of the rows before is missing, unless forced: the version before stays, and ValueError is raised.
    """
    spark, seen = docs.sparkSession, Observation()
    values = F.to_json(F.struct(*[F.col(c) for c in docs.columns]), {"ignoreNullFields": "false"})
    staged = durable(docs.select(shard.cast("string").alias("shard"), values.alias("value")).observe(seen, F.count(F.lit(1)).alias("rows")))
    count, before = seen.get["rows"], {r.shard: r for r in manifest_of(spark, path).collect()}  # one row a shard
    previous = sum(r.rows for r in before.values())
    if most_lost is not None and not force and (count == 0 or count < previous * (1 - most_lost)):
        raise ValueError(f"refusing to publish {count} rows after {previous}")
    number = F.xxhash64("value")
    digest = F.sha2(F.concat_ws(":", F.count("*"), F.sum(number.cast("decimal(38,0)")), F.bit_xor(number)), 256)
    now = {r.shard: r for r in staged.groupBy("shard").agg(F.count("*").alias("rows"), digest.alias("digest")).collect()}
    changed = sorted(s for s, r in now.items() if s not in before or before[s].digest != r.digest)
    removed = tuple(sorted(before.keys() - now.keys()))
    numbers = versions_of(spark, path)
    if numbers and not changed and not removed:
        return Published(numbers[-1], count)
    version = numbers[-1] + 1 if numbers else 0
    if changed:
        some = staged.join(F.broadcast(spark.createDataFrame([(s,) for s in changed], "shard string")), "shard", "left_semi")
        some.repartition("shard").write.mode("overwrite").partitionBy("shard").option("compression", "gzip").text(f"{path}/rows/v={version}")
    rows = [(s, r.rows, r.digest, version if s in changed else before[s].written) for s, r in sorted(now.items())]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v={version}")
    _forget(spark, path)
    return Published(version, count, tuple(changed), removed)


def _forget(spark: SparkSession, path: str) -> None:
    """Deletes all versions but the two latest, and the shards that only they refer to."""
    numbers = versions_of(spark, path)
    shards = lambda n: {(r.shard, r.written) for r in manifest_of(spark, path, n).collect()}
    used = {x for n in numbers[-2:] for x in shards(n)}
    for n in numbers[:-2]:
        for name in [*(f"rows/v={v}/shard={s}" for s, v in shards(n) - used), f"versions/v={n}"]:
            system, folder = files(spark, f"{path}/{name}")
            system.delete(folder, True)


def published(spark: SparkSession, path: str, schema: str, shards: list[str] | None = None) -> DataFrame:
    """The rows of the latest version, of some shards only if named."""
    found = [r for r in manifest_of(spark, path).collect() if shards is None or r.shard in shards]
    paths = [f"{path}/rows/v={r.written}/shard={r.shard}" for r in found]
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)
