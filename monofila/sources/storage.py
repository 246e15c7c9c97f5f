"""Shared folder, tenant-scoped tables and sinks."""

from __future__ import annotations

from collections.abc import Iterable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir``, else one beside the warehouse.

    It is also made the checkpoint directory when none is set yet.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if folder is None:
        folder = current
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if current is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path in this application's part of the shared folder; never reused."""
    return f"{_scratch_root(spark)}/{name}-{uuid4().hex[:12]}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove everything this application wrote aside. Results that are not computed yet read
    such tables, so call it when they have been written."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(context._jsc.hadoopConfiguration()).delete(root, True)


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_tenant(df: DataFrame) -> DataFrame:
    """Tables written before tenants existed belong to tenant 0."""
    return df if "tenant" in df.columns else df.withColumn("tenant", F.lit(0))


def replace_tenants(df: DataFrame, path: str, tenants: Iterable[int], sort: Iterable[str] = ()) -> dict[int, int]:
    """Replace the given tenants' rows, leave all others alone, return rows written.

    Dynamic partition overwrite publishes at commit. It keeps the old partition of a
    tenant that now has no rows, so those are overwritten with an empty one. One tenant
    is written as it comes. Several are first rebalanced, so that not every task writes
    a small file per tenant; adaptive execution splits a tenant that holds most rows. They
    are then sorted inside files by ``sort``.
    """
    wanted = sorted(set(tenants))
    seen = Observation()
    counts = [F.count(F.when(F.col("tenant") == t, 1)).alias(str(t)) for t in wanted]
    rows = ensure_tenant(df).filter(F.col("tenant").isin(wanted)).observe(seen, *counts)
    spread = rows if len(wanted) == 1 else rows.hint("rebalance", "tenant").sortWithinPartitions("tenant", *sort)
    spread.write.partitionBy("tenant").option(
        "partitionOverwriteMode", "dynamic"
    ).mode("overwrite").parquet(path)
    written = {t: seen.get[str(t)] for t in wanted}
    for tenant in (t for t, n in written.items() if n == 0):
        nothing = df.sparkSession.createDataFrame([], rows.drop("tenant").schema)
        nothing.write.mode("overwrite").parquet(f"{path}/tenant={tenant}")
    return written


def read_tenants(spark: SparkSession, path: str, schema: T.StructType, tenant: int | None = None) -> DataFrame:
    """A tenant-partitioned table; for one tenant only its folder is listed. No rows when
    there is no such table or tenant yet."""
    target = path if tenant is None else f"{path}/tenant={tenant}"
    try:
        found = spark.read.option("basePath", path).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return ensure_tenant(found).select(*schema.names)


def replace_shared(df: DataFrame, path: str) -> None:
    """Full replace of a table all tenants share.

    Written aside first: a plain overwrite would drop the old table even when the new
    rows turn out not to fit. Such tables are small.
    """
    write_scratch(df, "shared").write.mode("overwrite").parquet(path)


def publish(spark: SparkSession, built: str, target: str) -> None:
    """Put a written folder in the place of another. The old one steps aside by a rename and goes
    once the new one is there, so a failure in between leaves both on disk."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    new, place, aside = path(built), path(target), path(f"{scratch_path(spark, 'replaced')}")
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    for folder in (place, aside):
        files.mkdirs(folder.getParent())
    if files.exists(place) and not files.rename(place, aside):
        raise OSError(f"cannot move {target} aside")
    if not files.rename(new, place):
        raise OSError(f"cannot publish {built} as {target}")
    files.delete(aside, True)


def route(rows: DataFrame, verdict: str, targets: dict[str, str]) -> None:
    """Rows to one folder per value of ``verdict``, by one write. Each folder is replaced as a
    whole, also by no rows. The rows are written under the first target's parent, on the same
    file system, before any folder is touched."""
    spark = rows.sparkSession
    parent = next(iter(targets.values())).rsplit("/", 1)[0]
    built = f"{parent}/_routed-{uuid4().hex[:12]}"
    rows.write.partitionBy(verdict).parquet(built)
    nothing = spark.createDataFrame([], rows.drop(verdict).schema)
    for value, target in targets.items():
        part = f"{built}/{verdict}={value}"
        try:
            spark.read.parquet(part)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            nothing.write.parquet(part)
        publish(spark, part, target)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(built)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_csv(df: DataFrame, path: str, tenant: int | None = None, single_file: bool = False) -> None:
    """Semicolon-separated text with header and byte-order mark, one file per task. Blanks at
    the ends of values are kept.

    Spark writes no mark, so it goes in front of the first header name. A single file is put
    together from parts written in parallel where the file system can concatenate files; its rows
    stand in the order of the partitions. Elsewhere (object stores) one task writes it; ask for
    it there only for results that small.
    """
    rows = df if tenant is None else df.filter(F.col("tenant") == tenant)
    marked = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    if not single_file:
        _csv(marked, path, header=True, mode="overwrite")
    elif _concatenates(df.sparkSession, path):
        _write_joined(marked, path)
    else:
        _csv(marked.coalesce(1), path, header=True, mode="overwrite")


def _csv(rows: DataFrame, path: str, header: bool, mode: str) -> None:
    rows.write.mode(mode).option("sep", ";").option("header", header).option("quoteAll", False).option(
        "escape", '"'
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("encoding", "UTF-8").csv(path)


def _file_system(spark: SparkSession, path: str):
    """The path, its file system, and the one below that keeps no checksums, which may be the same."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    return place, files, files.getRawFileSystem() if files.getScheme() == "file" else files


def _concatenates(spark: SparkSession, path: str) -> bool:
    place, _, plain_files = _file_system(spark, path)
    return plain_files.hasPathCapability(place, "fs.capability.paths.concat")


def _write_joined(rows: DataFrame, path: str) -> None:
    """Parts without header, then the header as a file of its own, joined by the file system.

    HDFS appends the parts to the header by moving blocks. The local file system, which is one
    machine's, copies them one after the other. The folder is replaced when the file is whole.
    """
    spark = rows.sparkSession
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    built = f"{path.rstrip('/')}-{uuid4().hex[:12]}"
    place, files, plain_files = _file_system(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(built)

    def listed() -> dict[str, int]:
        return {f.getPath().toString(): f.getLen() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")}

    try:
        _csv(rows, built, header=False, mode="overwrite")
        parts = listed()
        _csv(spark.createDataFrame([], rows.schema), built, header=True, mode="append")
        (header,) = listed().keys() - parts.keys()
        local = files.getScheme() == "file"
        # Part names begin with the number of their partition.
        sources = ([header] if local else []) + [p for p, size in sorted(parts.items()) if size]
        target = f"{built}/part-whole.csv" if local else header
        paths = gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(sources))
        for i, source in enumerate(sources):
            paths[i] = jvm.org.apache.hadoop.fs.Path(source)
        if sources:
            plain_files.concat(jvm.org.apache.hadoop.fs.Path(target), paths)
        for left in listed().keys() - {jvm.org.apache.hadoop.fs.Path(target).makeQualified(files.getUri(), folder).toString()}:
            files.delete(jvm.org.apache.hadoop.fs.Path(left), False)
        files.delete(place, True)
        if not files.rename(folder, place):
            raise OSError(f"cannot publish {built} as {path}")
    finally:
        if files.exists(folder):
            files.delete(folder, True)
