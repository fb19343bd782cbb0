"""Exact deduplication by a stateful stream (native DataFrame expressions only).

The documents are read as a file stream.  A keyed state on disk (RocksDB state
store, no watermark, so it never expires) holds for each SHA-256 digest the
stable identifier of the row that stays, its content locator (file and row in
the file) and the number of rows seen.  Afterwards every hit is checked on its
full bytes against the text at the locator; texts that share a digest but not
their bytes are set apart by the text itself.

Partial aggregation before the state's shuffle leaves one row for each digest
and task, so a group with a third of all rows is no hot key there.  The check
ships texts of hits only, salted by the group's counted size.

Edge cases: null text counts as empty (one group with the empty texts); rows
repeated with the same id all belong to their group, and exactly one of them
(the first by locator) stays; a null id stays only if the whole group has
none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm.common import small_side, staged
from lakesift.plans.util import scratch_path

#: Rows of one group that a task of the byte check compares at most, on average.
ROWS_PER_SALT = 2000
#: Bytes of a registry row as broadcast (digest, id, locator, count).
REGISTRY_ROW_BYTES = 400

#: Input of one micro-batch of the stream, about; a larger input comes in several,
#: and its texts meet the state of the batches before.
BYTES_PER_BATCH = 4 << 30

_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # one bounded block cache and write buffer for all stores of an executor
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    # many small stores: don't reserve disk for their logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digest, identifier and locator of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("digest"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )


def _stays() -> Column:
    """Order of the rows of a group: the largest is the one that stays (largest
    id, then the first row of the last file)."""
    return F.struct(F.col("id"), F.col("file"), (-F.col("row")).alias("back"))


def registry(spark: SparkSession, path: str, id_col: str, text_col: str) -> DataFrame:
    """Run the stream over all files of ``path``; one row per digest with the
    identifier and locator that stay and the number of rows."""
    schema = spark.read.parquet(path).schema
    before = {k: spark.conf.get(k, None) for k in _CONF}
    try:
        for k, v in _CONF.items():
            spark.conf.set(k, v)
        # a stream's plain path must be a folder; as a pattern it may be a single file too
        pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
        files = spark.readStream.schema(schema).option("maxBytesPerTrigger", BYTES_PER_BATCH).parquet(pattern)
        stream = _rows(files, id_col, text_col)
        state = stream.groupBy("digest").agg(F.max(_stays()).alias("top"), F.count(F.lit(1)).alias("n"))
        out = scratch_path(spark, "dedup-state")

        def keep_changes(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        run = (
            state.writeStream.outputMode("update").foreachBatch(keep_changes)
            .option("checkpointLocation", scratch_path(spark, "dedup-stream")).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema(f"digest string, {_top_type(schema, id_col)}, n bigint, batch int").parquet(out)
    # state only grows: the last change of a digest is the largest
    return changes.groupBy("digest").agg(F.max("top").alias("top"), F.max("n").alias("n"))


def _top_type(schema, id_col: str) -> str:
    kind = schema[id_col].dataType.simpleString()
    return f"top struct<id: {kind}, file: string, back: bigint>"


def exact_dedup(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` and the locator (``file``, ``row``)."""
    docs = _rows(spark.read.parquet(path), id_col, text_col)
    if docs.isEmpty():
        kind = spark.read.parquet(path).schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"{id_col} {kind}, keep_id {kind}, group_size bigint, kept boolean, "
                                         "text_sha256 string, file string, row bigint")
    seen = registry(spark, path, id_col, text_col)
    groups = staged(
        seen.where("n > 1").select("digest", "top", "n", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("salts")),
        "dedup-registry")
    n_groups = groups.count()

    # full bytes of every hit against the text at the locator
    hits = docs.join(small_side(groups, n_groups, REGISTRY_ROW_BYTES), "digest")
    is_top = (F.col("id").eqNullSafe(F.col("top.id"))) & (F.col("file") == F.col("top.file")) & (F.col("row") == -F.col("top.back"))
    tops = hits.where(is_top).select(
        "digest", F.col("text").alias("top_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    members = hits.withColumn("salt", F.pmod(F.xxhash64("file", "row"), F.col("salts")).cast("int"))
    differ = staged(
        members.join(tops, ["digest", "salt"]).where("text != top_text").select("digest").distinct(), "dedup-differ")
    n_differ = differ.count()

    # rows without a group keep themselves
    single = F.col("n").isNull()
    answer = docs.drop("text").join(small_side(groups, n_groups, REGISTRY_ROW_BYTES), "digest", "left").select(
        F.col("id").alias(id_col), F.when(single, F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (single | is_top).alias("kept"),
        F.col("digest").alias("text_sha256"), "file", "row")
    if n_differ:
        # digests shared by different texts: group these rows by the text itself
        odd = docs.join(differ, "digest", "left_semi")
        by_text = odd.groupBy("digest", "text").agg(F.max(_stays()).alias("top"), F.count(F.lit(1)).alias("n"))
        apart = odd.join(by_text, ["digest", "text"]).select(
            F.col("id").alias(id_col), F.col("top.id").alias("keep_id"), F.col("n").alias("group_size"),
            (_stays() == F.col("top")).alias("kept"), F.col("digest").alias("text_sha256"), "file", "row")
        answer = answer.join(differ, F.col("text_sha256") == F.col("digest"), "left_anti").unionByName(apart)
    return answer


def survivors(docs: DataFrame, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.  ``docs`` is read from
    files, or is staged as files first."""
    path = _one_path(docs)
    if path is None:
        path = scratch_path(spark, "dedup-input")
        docs.write.parquet(path)
    # the rows that go are fewer than those that stay, unless most are copies
    full = spark.read.parquet(path)
    judged = staged(exact_dedup(spark, path, id_col, text_col).select(
        F.col("file").alias("__dedup_file"), F.col("row").alias("__dedup_row"), "kept"), "dedup-judged")
    n_kept = judged.where("kept").count()
    n_gone = judged.count() - n_kept
    stays = n_kept < n_gone
    side = small_side(judged.where("kept" if stays else "not kept").drop("kept"), min(n_kept, n_gone), 200)
    located = full.withColumns({"__dedup_at": F.col("_metadata.file_path"), "__dedup_no": F.col("_metadata.row_index")})
    here = (F.col("__dedup_at") == F.col("__dedup_file")) & (F.col("__dedup_no") == F.col("__dedup_row"))
    return located.join(side, here, "left_semi" if stays else "left_anti").drop("__dedup_at", "__dedup_no")


def _one_path(docs: DataFrame) -> str | None:
    """Folder of the Parquet files that ``docs`` reads as they are, if it is one
    folder of files and nothing else is applied to them."""
    plan = docs._jdf.queryExecution().logical()
    name = plan.getClass().getSimpleName()
    if name != "LogicalRelation":
        return None
    roots = plan.relation().location().rootPaths()
    return roots.head().toString() if roots.length() == 1 else None
