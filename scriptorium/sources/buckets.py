"""A store by buckets: rows and versions lie in files by a hash of their key, so merging and compacting go bucket by bucket.

The newest compacted state is one bucketed table, one row a key, sorted within its buckets. What was written since is another one, bucketed alike and
parted by version. Reading joins the two by key: both sides already lie as the join needs them, so neither is shuffled. Without
newer versions a read is a plain scan. Nothing is kept in the catalog but the names under which folders are read; a folder that is opened
by another application is registered anew.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.errors import VectorStoreError
from scriptorium.session import remove_folder

FAR = (1 << 31) - 1


class BucketedTable:
    """root/base/version=N are compacted states, root/log the versions written since then, root/gone deletions by source.

    Of rows with one key the newest version counts. A version written again replaces itself. A source that is deleted at a version
    hides the rows it had before. Rows without a key are refused.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = 16):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self._register("log", f"{schema}, version int", parts="version")
        for version in self._compacted():
            self._register(f"base/version={version}", schema)

    # ---- folders and names

    def _name(self, folder: str) -> str:
        return f"scriptorium_{hashlib.md5(f'{self.root}/{folder}'.encode()).hexdigest()}"

    def _path(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, folder: str) -> list[int]:
        path, fs = self._path(folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))

    def _compacted(self) -> list[int]:
        """A compaction counts once its writer has marked it whole."""
        done = []
        for v in self._versions("base"):
            path, fs = self._path(f"base/version={v}/_SUCCESS")
            if fs.exists(path):
                done.append(v)
        return done

    def _register(self, folder: str, schema: str, parts: str | None = None) -> None:
        name = self._name(folder)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        parted = f"PARTITIONED BY ({parts})" if parts else ""
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet {parted} CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{folder}'")
        if parts:
            path, fs = self._path(folder)
            fs.mkdirs(path)
            self.spark.sql(f"MSCK REPAIR TABLE {name}")

    def _read(self, folder: str) -> DataFrame:
        self.spark.catalog.refreshTable(self._name(folder))
        return self.spark.table(self._name(folder))

    def _dealt(self, df: DataFrame) -> DataFrame:
        """One task a bucket, with the hash that bucketed files go by, so a bucket is one file a write."""
        return df.repartition(self.buckets, self.key).sortWithinPartitions(self.key)

    # ---- reading

    def latest(self) -> int:
        """The greatest version that holds rows or deletions, 0 where there is none."""
        return max([0, *self._versions("log"), *self._compacted(), *self._versions("gone")])

    def newer(self, version: int, after: int) -> DataFrame:
        """Of the versions after one, up to another, the newest row of each key with its version: an aggregation inside the buckets."""
        rows = self._read("log").where((F.col("version") <= version) & (F.col("version") > after))
        if len([v for v in self._versions("log") if after < v <= version]) < 2:
            return rows.select(*self.columns, "version")
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in self.columns if c != self.key], "version"), "version").alias("row"))
        return newest.select(*[F.col(c) if c == self.key else F.col(f"row.{c}").alias(c) for c in self.columns], "row.version")

    def at(self, version: int) -> DataFrame:
        """The rows as of a version."""
        base = max([v for v in self._compacted() if v <= version], default=None)
        own = self._read(f"base/version={base}").select(*self.columns, F.lit(base).alias("version")) if base is not None else None
        after = -1 if base is None else base
        log, gone = any(after < v <= version for v in self._versions("log")), any(after < v <= version for v in self._versions("gone"))
        if own is None:
            rows = self.newer(version, -1)
        elif not log:
            rows = own
        else:
            new = self.newer(version, base).select(*[F.col(c).alias(f"new_{c}") for c in [*self.columns, "version"]])
            both = own.join(new, F.col(self.key) == F.col(f"new_{self.key}"), "full_outer")
            is_new = F.col(f"new_{self.key}").isNotNull()
            rows = both.select(*[F.when(is_new, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in [*self.columns, "version"]])
        if gone:
            hidden = self.spark.read.schema("source string, version int").parquet(f"{self.root}/gone").where((F.col("version") <= version) & (F.col("version") > after)).groupBy("source").agg(F.max("version").alias("hidden_at"))
            rows = rows.join(hidden, "source", "left").where("hidden_at is null or version >= hidden_at")
        return rows.select(*self.columns)

    def newest(self) -> DataFrame:
        return self.at(FAR)

    # ---- writing

    def written(self, version: int) -> DataFrame:
        """The rows of one version of the log, as they were written."""
        return self._read("log").where(F.col("version") == version).select(*self.columns)

    def write(self, version: int, df: DataFrame, again: bool = True) -> None:
        """Adds a version; of rows with one key any one stays. Only what is added is shuffled. Without `again` a version that is there is an error."""
        if not again:
            self._refuse("log", version)
        own = df.select(*self.columns).dropDuplicates([self.key])
        refused = F.raise_error(F.lit(f"{self.key} is null")).cast(own.schema[self.key].dataType)
        own = own.withColumn(self.key, F.coalesce(F.col(self.key), refused)).withColumn("version", F.lit(version))
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            self._dealt(own).write.mode("overwrite").insertInto(self._name("log"), overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    def _refuse(self, folder: str, version: int) -> None:
        if version in self._versions(folder):
            raise VectorStoreError(f"another writer has made version {version} of {self.root}/{folder}")

    def delete(self, version: int, sources: str | DataFrame, again: bool = True) -> None:
        """Hides the older rows of a source, or of all sources in a frame with that column."""
        if not again:
            self._refuse("gone", version)
        gone = self.spark.createDataFrame([(sources,)], "source string") if isinstance(sources, str) else sources.select("source").distinct()
        gone.write.mode("overwrite").parquet(f"{self.root}/gone/version={version}")

    def compact(self, version: int | None = None) -> int:
        """Writes the state as of a version as the new base, bucket by bucket: no row leaves its bucket. Readers of older versions are not hurt.

        Returns the version. What the base makes superfluous can go with `forget`.
        """
        version = self.latest() if version is None else version
        if version in self._compacted():
            return version
        folder = f"base/version={version}"
        path, fs = self._path(folder)
        if fs.exists(path):  # a compaction that did not end
            fs.delete(path, True)
        rows = self.at(version).sortWithinPartitions(self.key)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(folder)}")
        rows.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.root}/{folder}").saveAsTable(self._name(folder))
        self._register(folder, self.schema)
        return version

    def forget(self, version: int) -> None:
        """Deletes what came before a compacted version; older states can't be read any more."""
        if version not in self._compacted():
            raise VectorStoreError(f"version {version} is not compacted")
        for folder, versions in (("base", self._compacted()), ("log", self._versions("log")), ("gone", self._versions("gone"))):
            for v in versions:
                if v < version or (v == version and folder != "base"):
                    remove_folder(self.spark, f"{self.root}/{folder}/version={v}")
        self._register("log", f"{self.schema}, version int", parts="version")

    def drop_names(self) -> None:
        """Takes the names out of the catalog; the files stay."""
        for folder in ("log", *[f"base/version={v}" for v in self._compacted()]):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(folder)}")
