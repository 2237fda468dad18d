"""Tables that change: upserts, partial updates, relinking, retiring, archiving, deleting, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(table: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The table with the last change of each key in place of its row, or added. Partial aggregates keep the last row a task has of a key."""
    rows = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    payload = F.struct(*[c for c in rows.columns if c not in (*key, "__new")])
    last = rows.groupBy(*key).agg(F.max_by(payload, F.struct("__new", *order)).alias("r"))
    return last.select(*key, *[F.col(f"r.{c}").alias(c) for c in rows.columns if c not in (*key, "__new")])


def patched(table: DataFrame, updates: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The table with those columns from the updates (one a key) where they are not null."""
    u = updates.select(*key, *[F.col(c).alias(f"__u_{c}") for c in columns])
    j = table.join(u, key, "left")
    return j.select(*[F.coalesce(f"__u_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def relinked(table: DataFrame, moves: DataFrame, by: str, column: str = "template_family_id") -> DataFrame:
    """The table with a new value in ``column`` where ``by`` is among the moves (by, new value)."""
    m = moves.select(F.col(by).alias("__by"), F.col(column).alias("__to"))
    j = table.join(m, table[by] == m["__by"], "left")
    return j.select(*[F.coalesce(F.col("__to"), table[c]).alias(c) if c == column else table[c] for c in table.columns])


def retired(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table with status ``retired`` on those keys."""
    return relinked(table, keys.select(key, F.lit("retired").alias("status")), key, "status")


def without(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The table's rows whose key is not among those."""
    return table.join(keys, key, "left_anti")


def only(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The table's rows whose key is among those."""
    return table.join(keys, key, "left_semi")


def archived(table: DataFrame, history: DataFrame, condition: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, history with the others, each with the time it ended)."""
    gone = F.coalesce(condition, F.lit(False))
    moved = table.where(gone).withColumn("valid_to", at)
    return table.where(~gone), history.unionByName(moved, allowMissingColumns=True)


def versions(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events with their number within each key, from 1."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def representative(fingerprints: DataFrame, family: str = "template_family_id") -> DataFrame:
    """The fingerprint that stands for each family: most confident, most applied, oldest; retired ones do not stand."""
    live = fingerprints.where("status != 'retired'")
    payload = F.struct(*[c for c in live.columns if c != family])
    first = live.groupBy(family).agg(F.min_by(payload, F.struct(-F.col("confidence"), -F.col("apply_count"), "created_at", "fingerprint_hash")).alias("r"))
    return first.select(family, "r.*")


def append(df: DataFrame, path: str) -> None:
    """Rows added to a Parquet table, to the version of it that is current."""
    df.write.mode("append").parquet(current(df.sparkSession, path) or path)


def deduplicated(items: Column) -> Column:
    """JSON texts without those that equal an earlier one; objects' keys are taken in order."""
    return F.array_distinct(F.transform(items, lambda x: F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(x, "map<string,string>"))))), x)))


def relinked_either(table: DataFrame, keys: DataFrame, paths: DataFrame, source: str, target: str) -> DataFrame:
    """The rows of family ``source`` in family ``target`` where their fingerprint is among ``keys`` (fingerprint_hash) or their path among ``paths`` (invoice_path).

    A JSON column ``payload`` that names the family names the new one, on these rows.
    """
    j = table.join(keys.select("fingerprint_hash").distinct().withColumn("__k", F.lit(True)), "fingerprint_hash", "left").join(paths.select("invoice_path").distinct().withColumn("__p", F.lit(True)), "invoice_path", "left")
    moved = (F.col("template_family_id") == source) & (F.coalesce("__k", F.lit(False)) | F.coalesce("__p", F.lit(False)))
    new = {"template_family_id": F.when(moved, target).otherwise(F.col("template_family_id"))}
    if "payload" in table.columns:
        quoted = F.concat(F.lit('"template_family_id":"'), F.lit(source), F.lit('"'))
        new["payload"] = F.when(moved, F.replace("payload", quoted, F.lit(f'"template_family_id":"{target}"'))).otherwise(F.col("payload"))
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in table.columns])


def current(spark, path: str) -> str | None:
    """The folder that holds a table's files: the version that its pointer names, else the path itself; None where there is neither."""
    fs, at = _fs(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    if not fs.exists(at):
        return None
    named = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("_version-"))
    return f"{path.rstrip('/')}/{named[-1].removeprefix('_version-').split('=', 1)[1]}" if named else hadoop.Path(path).toString()


def _fs(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def replace(df: DataFrame, path: str) -> None:
    """A Parquet table written anew beside the old one; ``df`` may read the table itself.

    The new version is a folder of its own below the path. An empty marker that names it is created when it is whole, which is the one step
    that readers see; older versions go after that. So a crash at any time leaves the old table or the new one.
    """
    import uuid

    spark, root = df.sparkSession, path.rstrip("/")
    fs, at = _fs(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    before = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    last = max((int(p.getName()[9:].split("=", 1)[0]) for p in before if p.getName().startswith("_version-")), default=0)
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    fs.create(hadoop.Path(f"{root}/_version-{last + 1:012d}={name}"), False).close()
    for old in sorted(before, key=lambda p: not p.getName().startswith("_version-")):
        fs.delete(old, True)
