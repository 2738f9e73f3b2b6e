"""The score store: JSON lines in, a table of scores keyed by text digest out.

The table is partitioned by batch and bucketed by the SHA-256 of the text. Joins on the digest read it where it lies, without an
exchange, and only its narrow columns; the texts are kept beside them and read by nobody but ``stored_texts``. A batch that is written
again replaces its own partition, so a replay leaves one record of each of its texts.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("text", "positive", "negative", "neutral")
SCORES = COLUMNS[1:]
BUCKETS = 64
# Up to so many digests, a batch names them to the scan, which then opens their buckets and pages only.
NAMED = 512


def text_key(text: str | Column = "text") -> Column:
    """What the store knows a text by."""
    return F.unhex(F.sha2(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"), 256))


def by_digest(scores: DataFrame) -> DataFrame:
    """Scores keyed by text as scores keyed by digest."""
    return scores.select(text_key().alias("digest"), *COLUMNS)


def read_score_lines(spark: SparkSession, path: str) -> DataFrame:
    """Scores of JSON lines ``{"t": text, "p": [3]}``; corrupt lines are skipped, the later line wins."""
    raw = spark.read.text(path).select(
        F.from_json("value", "t string, p array<double>", {"mode": "PERMISSIVE"}).alias("r"),
        F.monotonically_increasing_id().alias("pos"),
    )
    valid = raw.where("r.t is not null and size(r.p) = 3 and not exists(r.p, x -> x is null)")
    latest = valid.groupBy(F.col("r.t").alias("text")).agg(F.max_by("r.p", "pos").alias("p"))
    return latest.select("text", *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(COLUMNS[1:])])


def store_table(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """Name of the store's table at ``path``, which is made if it is not there.

    The number of buckets is fixed when the store is made and kept beside it (``layout``), since the files of a bucketed table only make
    sense under it. It is never less than the session's shuffle width, so that joins adopt the store's partitioning.
    """
    name = f"scores_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):
        _make(spark, name, path, buckets)
    spark.sql(f"MSCK REPAIR TABLE {name}")  # batches that other sessions wrote
    spark.catalog.refreshTable(name)
    return name


def _make(spark: SparkSession, name: str, path: str, buckets: int | None) -> None:
    try:
        buckets = spark.read.parquet(f"{path}/layout").first().buckets
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        buckets = max(buckets or BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, text STRING, positive DOUBLE, negative DOUBLE, neutral DOUBLE, batch_id BIGINT) "
        f"USING parquet PARTITIONED BY (batch_id) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/scores'"
    )
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scores")
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(folder)


def read_store(spark: SparkSession, path: str, before: int | None = None, digests: list[bytes] | None = None) -> DataFrame:
    """(digest, positive, negative, neutral): latest score of each text, of batches below ``before`` if given.

    ``digests`` limits the scan to these; a store not yet written is empty.
    """
    rows = spark.table(store_table(spark, path))
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    if digests is not None:
        rows = rows.where(F.col("digest").isin(digests)) if digests else rows.where("false")
    latest = rows.groupBy("digest").agg(F.max_by(F.struct(*SCORES), "batch_id").alias("p"))
    return latest.select("digest", "p.*")


def append_scores(scores: DataFrame, path: str, batch_id: int, buckets: int | None = None) -> None:
    """Write a batch of scores (text and probabilities), in place of what it wrote before; a later batch wins on the same text."""
    spark = scores.sparkSession
    name = store_table(spark, path, buckets)
    width = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first().data_type)
    # One file a bucket: rows are dealt as the table's buckets are.
    rows = by_digest(scores).repartition(width, "digest")
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch_id = {int(batch_id)}) SELECT * FROM {{rows}}", rows=rows)


def stored_texts(spark: SparkSession, path: str) -> DataFrame:
    """The distinct texts of the store."""
    return spark.table(store_table(spark, path)).groupBy("digest").agg(F.first("text").alias("text")).select("text")
