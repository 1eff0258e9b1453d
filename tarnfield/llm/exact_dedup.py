"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A new batch is reduced to one row per digest, its unseen digests
are found by a sort-merge anti-join with the index, and these are appended. Everything is DataFrame expressions.

Defined results for edge cases: a null text counts as the empty text, so all null and empty texts form one group; ties
on the id cannot arise for distinct ids (rows that repeat the smallest id all stay, as do rows without an id in a group
that has none); an empty batch gives an empty result and leaves the index as it was; other columns of the batch
are carried through untouched, but for those named like the results, which ``add`` replaces and ``deduplicate`` keeps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import free_names, fresh_path, join_groups, stage, text_or_empty, unstage

INDEX_SCHEMA = "digest binary, keep_id bigint"


def normalised(text: str | Column) -> Column:
    """White space runs (space, tab to carriage return) become one space; null becomes empty."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """A persistent set of text digests with the id of the row that stays for each, bucketed and sorted by digest.

    ``table`` names a table of the catalog. ``path`` is a folder that holds the index whatever the catalog: a new session
    opens it again by the same path and number of buckets. With neither, the index is a temporary one, for ``drop``.
    Choose ``buckets`` so that one bucket of the grown index fits a task (thousands at 100 TB).
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int = 64, path: str | None = None):
        self.spark, self.buckets = spark, buckets
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}/{buckets}") if path else uuid.uuid4()
        self.table = table or f"digest_index_{name.hex}"
        self.path = f"{path.rstrip('/')}/{buckets}-buckets" if path else fresh_path(spark, self.table)
        if spark.catalog.tableExists(self.table):
            return
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if path and folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # written in another session
            spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")
        else:
            self._write(spark.createDataFrame([], INDEX_SCHEMA), self.path)

    def _write(self, rows: DataFrame, path: str | None = None) -> None:
        # repartition() hashes like bucketBy(), so each bucket is one file per append
        writer = rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append")
        (writer.option("path", path) if path else writer).saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        """Delete the index, its files too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch; return its rows without the text, with digest, keep_id, group_size (rows of the batch) and kept.

        ``keep_id`` is the id stored by an earlier batch if there is one, else the smallest id of the batch's group.
        Texts are read and hashed once. What is returned doesn't need the index any more.
        """
        batch = batch.drop(*({"digest", "keep_id", "group_size", "kept"} & set(batch.columns)))
        carried = [c for c in batch.columns if c != text_col]
        rows = stage(batch.select(*carried, F.unhex(F.sha2(F.encode(normalised(text_col), "UTF-8"), 256)).alias("digest")), "digests")
        found = rows.groupBy("digest").agg(F.min(F.col(id_col).cast("bigint")).alias("first_id"), F.count(F.lit(1)).alias("group_size"))
        found = stage(found, "digest-groups")
        total = found.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        unseen = found.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        # written apart first: the append reads the table that it changes
        fresh = stage(unseen.select("digest", F.col("first_id").alias("keep_id")), "digest-new")
        self._write(fresh)
        groups = found.join(self.read().hint("merge"), "digest", "left").select("digest", "keep_id", "group_size")
        groups = stage(groups, "digest-kept")
        unstage(found, fresh)
        return join_groups(rows, groups, "digest", "group_size", total).withColumn("kept", F.col(id_col).cast("bigint").eqNullSafe(F.col("keep_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    The rows that go are told by their id and a hash of their text as it is, so texts are not normalised again.
    """
    used = index or DigestIndex(docs.sparkSession)
    same = F.xxhash64(text_or_empty(text_col))
    judged = used.add(docs.select(F.col(id_col).cast("bigint").alias("id"), same.alias("print"), F.col(text_col).alias("text")), "id", "text")
    gone = stage(judged.where("not kept").select("id", "print").distinct(), "digest-gone")
    if index is None:
        used.drop()
    own_id, own_print = free_names(docs, "_id", "_print")
    gone = gone.withColumnsRenamed({"id": own_id, "print": own_print})
    return docs.join(gone.hint("merge"), F.col(id_col).cast("bigint").eqNullSafe(F.col(own_id)) & (same == F.col(own_print)), "left_anti")
