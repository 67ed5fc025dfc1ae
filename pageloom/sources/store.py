"""The index on shared storage: versions of parquet tables behind one pointer.

A commit writes a new version beside the old ones and then moves the pointer, which is one rename: readers see the old or the
new index, never a mixture, and a writer that dies leaves the pointer where it was. Postings are range-partitioned and sorted
by term and document, so that a search reads the row groups of its terms only and a frequent term is spread over files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..operators.query import plan

SCHEMA_VERSION = 3
FILES = "id long, path string, mtime double, indexed_at string, lang string"
CONTENT = "file_id long, content string"
TABLES = {"files": FILES, "content": CONTENT, "postings": "term string, file_id long, positions array<int>, dl long", "docstats": "file_id long, dl long", "vocab": "term string, doc long, cnt long"}


class IndexVersionError(RuntimeError):
    """The index was written by an incompatible version."""


class IndexStore:
    """An index folder. ``IndexStore.open`` creates it where it is missing and refuses one of another schema version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> IndexStore:
        out = cls(spark, root)
        out._fs.mkdirs(out._path(out.root))
        found = out._pointer()
        version = found.get("schema_version") if found else SCHEMA_VERSION
        if version is not None:
            try:
                version = int(version)
            except (TypeError, ValueError):
                version = -1
            if version != SCHEMA_VERSION:
                raise IndexVersionError(f"{out.root}: schema version {version}, this program reads {SCHEMA_VERSION}")
        return out

    def _pointer(self) -> dict:
        p = self._path(f"{self.root}/current.json")
        if not self._fs.exists(p):
            return {}
        s = self._fs.open(p)
        try:
            return json.loads(bytes(s.readAllBytes()).decode())
        finally:
            s.close()

    def read(self, name: str) -> DataFrame:
        """A table of the current version, empty before the first commit; columns added later read as null."""
        v = self._pointer().get("version")
        if v is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{v}/{name}")

    def corpus(self) -> DataFrame:
        return self.read("files").join(self.read("content"), F.col("id") == F.col("file_id"), "left").select(F.col("id").alias("file_id"), "path", "mtime", "lang", F.coalesce("content", F.lit("")).alias("content"))

    def commit(self, files: DataFrame, content: DataFrame) -> str:
        """Writes a version with the given files and texts, and makes it the current one."""
        v = f"v-{uuid.uuid4().hex}"
        at = f"{self.root}/{v}"
        files.select("id", "path", "mtime", "indexed_at", "lang").repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{at}/files")
        content.select("file_id", "content").repartitionByRange("file_id").sortWithinPartitions("file_id").write.parquet(f"{at}/content")
        rows = self.spark.read.schema(CONTENT).parquet(f"{at}/content").select("file_id", F.coalesce("content", F.lit("")).alias("content"))
        search.docstats(rows).write.parquet(f"{at}/docstats")
        stats = self.spark.read.schema(TABLES["docstats"]).parquet(f"{at}/docstats")
        posts = search.postings(rows).join(stats, "file_id").select("term", "file_id", "positions", "dl")
        posts.repartitionByRange("term", "file_id").sortWithinPartitions("term", "file_id").write.parquet(f"{at}/postings")
        stored = self.spark.read.schema(TABLES["postings"]).parquet(f"{at}/postings")
        words = stored.groupBy("term").agg(F.count("*").alias("doc"), F.sum(F.size("positions")).alias("cnt"))
        words.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/vocab")
        total = stats.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        self._point(v, {"documents": total["n"], "tokens": total["t"]})
        return v

    def _point(self, version: str, totals: dict) -> None:
        self._fs.create(self._path(f"{self.root}/{version}/_COMPLETE"), True).close()
        draft = self._path(f"{self.root}/current-{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "schema_version": SCHEMA_VERSION} | totals).encode()))
        out.close()
        target = self._path(f"{self.root}/current.json")
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._sc._gateway.new_array(options, 1)
        rename[0] = options.OVERWRITE
        context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), rename)

    def apply(self, results: DataFrame, indexed_at: str, lang: str | None) -> str:
        """Merges results (path, mtime, status, text): failed ones leave what is stored, others replace it."""
        from ..operators.index import upsert
        from ..plans.runtime import cut

        merged = cut(upsert(self.read("files"), results, indexed_at, lang))
        new = merged.filter("written").select(F.col("id").alias("file_id"), F.col("text").alias("content"))
        kept = self.read("content").join(new, "file_id", "left_anti").join(merged.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        return self.commit(merged, kept.unionByName(new))

    def replace_files(self, files: DataFrame) -> str:
        """Commits after a delete or rename: texts of rows that are gone go too."""
        from ..plans.runtime import cut

        files = cut(files)
        return self.commit(files, self.read("content").join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi"))

    def _searcher(self):
        """Searches a tree in the stored postings: totals come from the pointer, frequencies of words from the vocabulary."""
        found = self._pointer()
        posts, vocab = self.read("postings"), self.read("vocab")

        def df_of(terms: list[str]) -> dict[str, int]:
            return {r["term"]: r["doc"] for r in vocab.filter(F.col("term").isin(terms)).select("term", "doc").collect()}

        return lambda tree: search.search_postings(posts, tree, found.get("documents", 0), found.get("tokens", 0), df_of)

    def _with_files(self, best: DataFrame, extra: list[str]) -> DataFrame:
        """The other columns of the best hits. Their ids (as many as the limit) become a condition on the scan of ``files``,
        which is sorted by id: only the row groups that hold them are read."""
        rows = best.collect()
        schema = best.schema
        files = self.read("files").filter(F.col("id").isin([r["file_id"] for r in rows])).withColumnRenamed("id", "file_id")
        hits = self.spark.createDataFrame(rows, schema)
        return F.broadcast(hits).join(files, "file_id").select(*extra, "path", "score", "mtime", "lang", "file_id")

    def search(self, raw: str, limit: int = 20) -> DataFrame:
        """The best hits from the stored index: the postings of the query's words and the rows of the hits are read."""
        return self._with_files(self._searcher()(plan(raw)).orderBy("score", "file_id").limit(limit), [])

    def search_fuzzy(self, raw: str, limit: int = 20, most: int | None = None) -> DataFrame:
        """Exact hits, then hits of the query widened by the stored vocabulary."""
        best = search.fuzzy_best(plan(raw), raw, limit, most, self._searcher(), lambda: self.read("vocab"))
        return self._with_files(best, ["tier"])

    def texts_of(self, hits: DataFrame) -> DataFrame:
        """(file_id, content) of hits (at most as many as a limit), by a condition on the sorted scan."""
        ids = [r["file_id"] for r in hits.select("file_id").collect()]
        return self.read("content").filter(F.col("file_id").isin(ids)).select("file_id", F.coalesce("content", F.lit("")).alias("content"))

    def bytes(self) -> int:
        """Size of the current version."""
        v = self._pointer().get("version")
        return int(self._fs.getContentSummary(self._path(f"{self.root}/{v}")).getLength()) if v else 0

    def stats(self) -> dict:
        from ..operators.index import stats

        r = stats(self.read("files")).first()
        return {"file_count": r["file_count"], "db_bytes": self.bytes(), "last_indexed_at": r["last_indexed_at"], "schema_version": self._pointer().get("schema_version")}

    def compact(self) -> dict:
        """Rewrites the current version in few files and drops older ones; sizes before and after, and what that saved.

        The version that was current stays for readers that have begun, and versions without their mark of completion are
        left to the writers that may still be at them.
        """
        before = int(self._fs.getContentSummary(self._path(self.root)).getLength())
        last = self._pointer().get("version")
        if last:
            v = self.commit(self.read("files").coalesce(max(1, self.bytes() >> 27)), self.read("content"))
            for s in self._fs.listStatus(self._path(self.root)):
                name = s.getPath().getName()
                if s.isDirectory() and name not in (v, last) and self._fs.exists(self._path(f"{self.root}/{name}/_COMPLETE")):
                    self._fs.delete(s.getPath(), True)
        after = int(self._fs.getContentSummary(self._path(self.root)).getLength())
        return {"before_bytes": before, "after_bytes": after, "reclaimed": before - after, "percent": round(100 * (before - after) / before, 2) if before else 0.0}
