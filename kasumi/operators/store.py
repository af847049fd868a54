"""Tables of results by content hash, as Parquet in versioned folders.

An upsert writes the new version beside the old one, which makes it current, and a
lost executor costs a retried write only. Readers of the version before go on
undisturbed; older ones are removed. After a deletion no older version stays at all,
so that nothing of a deleted document is left in any file: readers that began before
it fail and read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables and their keys.
SCHEMAS = {
    "ner": "content_hash string, model string, flatten boolean, analysis string, created_at string",
    "documents": "content_hash string, source_kind string, source_name string, char_count long, chunk_count int, created_at string, chunks array<string>",
    "mask_draft": "content_hash string, added array<struct<start:int,end:int>>, removed array<struct<start:int,end:int>>, updated_at string",
    "llm_detection": "content_hash string, model string, flatten boolean, detector_version string, detections string, created_at string",
}
KEYS = {"ner": ["content_hash", "model", "flatten"], "documents": ["content_hash"], "mask_draft": ["content_hash"], "llm_detection": ["content_hash", "model", "flatten", "detector_version"]}


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows and the old ones that they don't replace."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def catalog(documents: DataFrame, ner: DataFrame, llm: DataFrame) -> DataFrame:
    """Documents, newest first, with their models (sorted, joined by commas) and whether the language model has seen them."""
    models = ner.groupBy("content_hash").agg(F.concat_ws(",", F.sort_array(F.collect_set("model"))).alias("models"))
    seen = llm.select("content_hash").distinct().withColumn("has_llm", F.lit(True))
    own = documents.drop("chunks").join(models, "content_hash", "left").join(seen, "content_hash", "left")
    return own.withColumn("models", F.coalesce("models", F.lit(""))).withColumn("has_llm", F.coalesce("has_llm", F.lit(False))).orderBy(F.desc("created_at"), "content_hash")


def status(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(content_hash, status) of (content_hash, detector_version): current, stale (another version) or none."""
    known = held.groupBy("content_hash").agg(F.collect_set("detector_version").alias("versions"))
    return wanted.join(known, "content_hash", "left").select("content_hash", F.when(F.col("versions").isNull(), "none").when(F.array_contains("versions", F.col("detector_version")), "current").otherwise("stale").alias("status"))


class Store:
    """The four tables under a root that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def version(self, name: str) -> int:
        """The current version's number, 0 if the table has none."""
        fs, at = self._fs(f"{self.root}/{name}")
        if not fs.exists(at):
            return 0
        found = [f.getPath().getName() for f in fs.listStatus(at)]
        return max((int(x[1:]) for x in found if x.startswith("v") and x[1:].isdigit() and fs.exists(self._fs(f"{self.root}/{name}/{x}/_SUCCESS")[1])), default=0)

    def read(self, name: str) -> DataFrame:
        at = self.version(name)
        if not at:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/v{at}")  # columns that an old file lacks are null

    def _write(self, name: str, rows: DataFrame, *, keep: int = 1) -> None:
        """Writes a new version and removes what is older than the ``keep`` versions before it, remains of failed writes too."""
        new = self.version(name) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{new}")
        fs, at = self._fs(f"{self.root}/{name}")
        for path in [f.getPath() for f in fs.listStatus(at)]:
            number = path.getName()[1:]
            if path.getName().startswith("v") and number.isdigit() and int(number) < new - keep and not fs.delete(path, True):
                raise OSError(f"{path.toString()} could not be removed")

    def put(self, name: str, rows: DataFrame) -> None:
        keys = KEYS[name]
        self._write(name, upserted(self.read(name), rows.dropDuplicates(keys), keys))

    def get(self, name: str, **key) -> DataFrame:
        """The rows with these values; the filter reaches the scan."""
        return reduce(lambda df, pair: df.where(F.col(pair[0]) == F.lit(pair[1])), key.items(), self.read(name))

    def models(self, content_hash: str) -> DataFrame:
        return self.get("ner", content_hash=content_hash).select("model").distinct().orderBy("model")

    def versions(self, content_hash: str) -> DataFrame:
        return self.get("llm_detection", content_hash=content_hash).select("detector_version").distinct().orderBy("detector_version")

    def catalog(self) -> DataFrame:
        return catalog(self.read("documents"), self.read("ner"), self.read("llm_detection"))

    def delete(self, content_hash: str, names: list[str] | None = None) -> None:
        """From all four tables, or those named, and from their older versions; nothing of a deleted document stays in them."""
        for name in names or list(SCHEMAS):
            if self.version(name):
                self._write(name, self.read(name).where(~F.col("content_hash").eqNullSafe(F.lit(content_hash))), keep=0)

    def set_source_kind(self, content_hash: str, kind: str) -> None:
        own = self.read("documents")
        self._write("documents", own.withColumn("source_kind", F.when(F.col("content_hash") == content_hash, F.lit(kind)).otherwise(F.col("source_kind"))))

    def cached(self, wanted: DataFrame, name: str, compute, *, force: bool = False) -> DataFrame:
        """Rows for the wanted keys: those that are held, and computed ones for the others, which are then held too.

        ``wanted`` has the table's keys and what ``compute`` needs; ``compute`` gives the table's rows.
        """
        keys = KEYS[name]
        missing = wanted if force else wanted.join(self.read(name).select(*keys), keys, "left_anti")
        if not missing.isEmpty():
            self.put(name, compute(missing))
        return self.read(name).join(wanted.select(*keys).distinct(), keys, "left_semi")
