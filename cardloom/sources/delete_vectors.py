"""A keyed table on plain Parquet, updated by merge-on-read.

Layout below the table's path: `data` holds row images, never rewritten; `index` says in which file and at which position the image
of a key lies; `vectors` holds, for a file and each 65,536 of its positions, a bitmap of the rows that are superseded; `log` holds
one small manifest for each version. A commit writes new files only and then creates the next manifest, which fails if another
writer was first. A read filters positions by the bitmaps.

The file system must create a file only if there is none, as one step (HDFS and local ones do; on an object store a writer needs a lock).
A lookup of few keys pushes them down to the index, whose files have statistics and Bloom filters of the key; images are read from the
files they lie in. `compact` keeps the number of index and bitmap directories small.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK_BITS, _WORDS = 16, 1024
#: Up to so many keys are pushed down as a filter, and up to so many files are named to a scan.
FEW_KEYS, FEW_FILES = 10, 2000
#: So many index directories are merged into one.
COMPACT_AT = 16


class RevisionConflict(RuntimeError):
    """Another writer committed this version first."""


class DeleteVectorTable:
    def __init__(self, spark: SparkSession, path: str, key: str, index_columns: list[str] = []):  # noqa: B006
        """`index_columns`: columns of the image that the index holds too, so that a lookup need not touch the data."""
        self.spark, self.path, self.key, self.index_columns = spark, path, key, list(index_columns)
        self._fs, self._at = self._filesystem()

    def _filesystem(self):
        jvm = self.spark.sparkContext._jvm
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        return at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    # -- versions ---------------------------------------------------------------------------------------------------------
    def version(self) -> int:
        """The newest committed version, 0 for none."""
        log = self._at(f"{self.path}/log")
        if not self._fs.exists(log):
            return 0
        return max((int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(log) if s.getPath().getName().endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "data": [], "index": [], "vectors": [], "extra": {}}
        stream = self._fs.open(self._at(f"{self.path}/log/{version:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        path = self._at(f"{self.path}/log/{manifest['version']:012d}.json")
        try:
            stream = self._fs.create(path, False)
        except Exception as e:
            raise RevisionConflict(str(manifest["version"])) from e
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()

    # -- reads ------------------------------------------------------------------------------------------------------------
    def _positions(self, paths: list[str]) -> DataFrame:
        """The rows below `paths` (directories or files of images) with file_ ("directory/name") and pos_."""
        df = self.spark.read.parquet(*[f"{self.path}/{d}" for d in paths])
        folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
        return df.withColumns({"file_": F.concat(folder, F.lit("/"), F.col("_metadata.file_name")), "pos_": F.col("_metadata.row_index")})

    def vectors(self, manifest: dict) -> DataFrame | None:
        """(file_, chunk_, words_): the newest bitmap of each chunk that has one."""
        if not manifest["vectors"]:
            return None
        df = self.spark.read.parquet(*[f"{self.path}/{d}" for d in manifest["vectors"]])
        return df.groupBy("file_", "chunk_").agg(F.max_by("words_", "version_").alias("words_"))

    def live(self, version: int | None = None) -> DataFrame | None:
        """The current images with their positions (file_, pos_); None before the first commit.

        Each data row meets the bitmap of its chunk, of at most 65,536 rows: that join has no large key, whatever the table holds.
        """
        manifest = self.manifest(version)
        if not manifest["data"]:
            return None
        rows, vectors = self._positions(manifest["data"]), self.vectors(manifest)
        if vectors is None:
            return rows
        rows = rows.withColumn("chunk_", F.shiftright("pos_", _CHUNK_BITS))
        word = F.get(F.col("words_"), F.shiftright(F.col("pos_"), 6).bitwiseAND(_WORDS - 1).cast("int"))
        dead = F.coalesce(F.getbit(word, F.col("pos_").bitwiseAND(63).cast("int")) == 1, F.lit(False))
        return rows.join(vectors, ["file_", "chunk_"], "left").filter(~dead).drop("chunk_", "words_")

    def lookup(self, keys: DataFrame | list[str], manifest: dict | None = None) -> DataFrame | None:
        """For those of `keys` (distinct; a list only of few) that the table holds: index columns and position. It reads the index alone."""
        manifest = manifest or self.manifest()
        if not manifest["index"]:
            return None
        index = self.spark.read.parquet(*[f"{self.path}/{d}" for d in manifest["index"]])
        if isinstance(keys, list):
            for at in range(0, max(1, len(keys)), FEW_KEYS):
                part = index.filter(F.col(self.key).isin(*keys[at : at + FEW_KEYS]))
                found = part if not at else found.unionAll(part)
        else:
            found = index.join(keys.select(self.key), self.key, "left_semi")
        return self._newest(found).select(self.key, "at_.*")

    def _newest(self, index: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct(*self.index_columns, "file_", "pos_"), "version_").alias("at_")
        return index.groupBy(self.key).agg(newest, F.max("version_").alias("version_"))

    def images_at(self, places: DataFrame, manifest: dict) -> DataFrame:
        """The images at the given (file_, pos_), read from the files named there (from all, if those are many)."""
        files = [r.file_ for r in places.select("file_").distinct().limit(FEW_FILES + 1).collect()]
        paths = [f"data/{f}" for f in files] if 0 < len(files) <= FEW_FILES else manifest["data"]
        return self._positions(paths).join(places.select("file_", "pos_"), ["file_", "pos_"], "left_semi").drop("file_", "pos_")

    # -- writes -----------------------------------------------------------------------------------------------------------
    def commit(self, images: DataFrame, superseded: DataFrame | None, base: dict, extra: dict | None = None) -> int:
        """Append `images` (one per key) and mark the rows at the positions `superseded` (file_, pos_); returns the new version."""
        version = base["version"] + 1
        tag = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        images.write.parquet(f"{self.path}/data/{tag}")
        placed = self._positions([f"data/{tag}"]).select(self.key, *self.index_columns, "file_", "pos_", F.lit(version).cast("long").alias("version_"))
        self._write_index(placed, tag)
        manifest = {**base, "version": version, "data": [*base["data"], f"data/{tag}"], "index": [*base["index"], f"index/{tag}"], "extra": extra or {}}
        if superseded is not None:
            bit = lambda p: F.expr(f"shiftleft(1L, cast({p} & 63 as int))")
            words = [superseded.select("file_", F.shiftright("pos_", 6).alias("word_"), bit("pos_").alias("bits_"))]
            touched = superseded.select("file_", F.shiftright("pos_", _CHUNK_BITS).alias("chunk_")).distinct()
            old = self.vectors(base)
            if old is not None:
                each = old.join(touched, ["file_", "chunk_"], "left_semi").select("file_", "chunk_", F.posexplode("words_").alias("at_", "bits_"))
                words.append(each.filter(F.col("bits_") != 0).select("file_", (F.col("chunk_") * _WORDS + F.col("at_")).alias("word_"), "bits_"))
            blank = touched.select("file_", F.explode(F.sequence(F.lit(0), F.lit(_WORDS - 1))).alias("at_"), "chunk_")
            words.append(blank.select("file_", (F.col("chunk_") * _WORDS + F.col("at_")).alias("word_"), F.lit(0).cast("long")))
            merged = reduce(DataFrame.unionAll, words).groupBy("file_", "word_").agg(F.bit_or("bits_").alias("bits_"))
            packed = merged.groupBy("file_", F.shiftright("word_", 10).alias("chunk_")).agg(F.array_sort(F.collect_list(F.struct("word_", "bits_"))).alias("words_"))
            packed.select("file_", "chunk_", F.transform("words_", lambda w: w["bits_"]).alias("words_"), F.lit(version).cast("long").alias("version_")).write.parquet(f"{self.path}/vectors/{tag}")
            manifest["vectors"] = [*base["vectors"], f"vectors/{tag}"]
        self._publish(manifest)
        return version

    def _write_index(self, rows: DataFrame, tag: str) -> None:
        rows.write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.path}/index/{tag}")

    def compact(self, extra: dict | None = None, at: int = COMPACT_AT) -> int:
        """Merge index and bitmap directories into one each, once there are `at` of either; returns the version.

        What is read stays the same, and so do the data files; older versions keep their own directories.
        """
        base = self.manifest()
        if len(base["index"]) < at and len(base["vectors"]) < at:
            return base["version"]
        version = base["version"] + 1
        tag = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        index = self._newest(self.spark.read.parquet(*[f"{self.path}/{d}" for d in base["index"]]))
        self._write_index(index.select(self.key, "at_.*", "version_"), tag)
        manifest = {**base, "version": version, "index": [f"index/{tag}"], "extra": base["extra"] if extra is None else extra}
        if base["vectors"]:
            newest = self.spark.read.parquet(*[f"{self.path}/{d}" for d in base["vectors"]])
            newest = newest.groupBy("file_", "chunk_").agg(F.max_by("words_", "version_").alias("words_"), F.max("version_").alias("version_"))
            newest.write.parquet(f"{self.path}/vectors/{tag}")
            manifest["vectors"] = [f"vectors/{tag}"]
        self._publish(manifest)
        return version
