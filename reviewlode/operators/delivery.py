"""Messages delivered more than once (problem 5).

At-least-once delivery leaves several rows of one message, perhaps in different
batches and written differently.  ``KeepVectors`` finds the row to keep of each
identifier without moving the payload:

1. One scan reads the identifier, the delivery order and the row's place (file,
   position in the file).  The identifier becomes 16 bytes, and the first row of
   each is found with a partial aggregate on the map side, so that a third of
   all rows under one identifier is a handful of partial results.
2. The places of the winners are shuffled by (file, block of 32768 rows) and
   become bitmaps, one for each block: the file's deletion vector, inverted.
3. Wide payloads are read with their place and filtered by the bitmap of their
   block.  Bitmaps are broadcast only up to ``BROADCAST_BYTES``; larger sets are
   taken file group by file group, each within that bound.

Null and blank identifiers identify nothing: their rows are all kept and are no
duplicates.  Identifiers that are no UUID are compared as trimmed lower-case
text.  Ties in the delivery order are broken by place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of bitmaps sent to every executor at once.
BROADCAST_BYTES = 64 << 20
#: Rows of a core's share below which a table is too small to be read by all cores.
SMALL_ROWS = 100_000
#: Rows of a bitmap of Spark's bitmap functions, and its bytes.
BLOCK_ROWS, BLOCK_BYTES = 32768, 4096


def message_id(column: str) -> Column:
    """What an identifier means: the 16 bytes of a UUID however written, else its trimmed lower-case text; null if null or blank."""
    text = F.lower(F.regexp_replace(F.col(column), r"[\s\p{Z}\p{Cc}\p{Cf}]", ""))
    digits = F.regexp_replace(F.regexp_replace(text, r"^(?:urn:)?(?:uuid:)?", ""), r"[{}()\-‐-―−]", "")
    return F.when(F.length(digits) == 32, F.coalesce(F.when(digits.rlike("^[0-9a-f]{32}$"), F.unhex(digits)), text.cast("binary"))).when(
        F.length(text) > 0, text.cast("binary")
    )


def _placed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns, F.xxhash64("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("pos_"))


def _cut(df: DataFrame) -> DataFrame:
    """A result that is read several times, written once to the shared checkpoint folder where the cluster names one."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint() if sc.getCheckpointDir() else df


@dataclass
class KeepVectors:
    """Bitmaps of the rows to keep of the Parquet table at ``path``: file_, block_, keep_."""

    spark: SparkSession
    path: str
    id_column: str
    order_column: str
    vectors: DataFrame
    n_files: int
    identity: Callable[[str], Column] = message_id
    _rows: int | None = None

    @staticmethod
    def build(spark: SparkSession, path: str, id_column: str, order_column: str, identity: Callable[[str], Column] = message_id) -> KeepVectors:
        """``identity`` says what the identifier's column means; ``functions.col`` takes it as it is written."""
        files = spark.read.parquet(path).inputFiles()
        rows = _placed(spark, path, [id_column, order_column]).withColumn("id_", identity(id_column))
        first = (
            rows.where(F.col("id_").isNotNull())
            .groupBy("id_")
            .agg(F.min(F.struct(F.col(order_column).alias("o"), F.col("file_").alias("f"), F.col("pos_").alias("p"))).alias("w"))
            .select(F.col("w.f").alias("file_"), F.col("w.p").alias("p"))
        )
        blocks = first.select("file_", F.bitmap_bucket_number("p").alias("block_"), F.bitmap_bit_position("p").alias("bit_"))
        # places first, bitmaps then: a bitmap before the shuffle would be larger than the places in it
        vectors = blocks.repartition("file_", "block_").groupBy("file_", "block_").agg(F.bitmap_construct_agg("bit_").alias("keep_"))
        return KeepVectors(spark, path, id_column, order_column, vectors, len(files), identity)

    def _groups(self) -> list[DataFrame]:
        """The vectors in groups of files that are each small enough to broadcast."""
        n_blocks = self.n_rows() // BLOCK_ROWS + self.n_files  # from the footers, an upper bound
        groups = max(1, -(-n_blocks * BLOCK_BYTES // BROADCAST_BYTES))
        if groups == 1:
            return [self.vectors]
        kept = _cut(self.vectors)
        return [kept.where(F.pmod("file_", F.lit(groups)) == g) for g in range(groups)]

    def _marked(self, columns: list[str]) -> DataFrame:
        out = None
        groups = self._groups()
        for g, vectors in enumerate(groups):
            rows = _placed(self.spark, self.path, columns)
            if len(groups) > 1:
                rows = rows.where(F.pmod("file_", F.lit(len(groups))) == g)
            rows = rows.withColumn("block_", F.bitmap_bucket_number("pos_"))
            got = rows.join(F.broadcast(vectors), ["file_", "block_"], "left")
            out = got if out is None else out.unionByName(got)
        byte = F.conv(F.hex(F.expr("substring(keep_, cast(bitmap_bit_position(pos_) div 8 + 1 as int), 1)")), 16, 10).cast("int")
        bit = F.expr("shiftleft(1, cast(bitmap_bit_position(pos_) % 8 as int))")
        hit = F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
        return out.withColumn("kept_", hit | self.identity(self.id_column).isNull())

    def keep(self, columns: list[str]) -> DataFrame:
        """Exactly one row of each message, with the given columns."""
        need = list(dict.fromkeys([*columns, self.id_column]))
        return self._marked(need).where("kept_").select(*columns)

    def spread(self, df: DataFrame, key: str) -> DataFrame:
        """Rows of a table with fewer blocks than cores, spread over the cores; those of larger ones stay where they are read."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, key) if self.n_rows() < SMALL_ROWS * cores else df

    def n_rows(self) -> int:
        """Rows of the table, from the footers."""
        if self._rows is None:
            self._rows = self.spark.read.parquet(self.path).count()
        return self._rows

    def repeated(self, columns: list[str]) -> DataFrame:
        """The rows that are left out."""
        need = list(dict.fromkeys([*columns, self.id_column]))
        return self._marked(need).where("NOT kept_").select(*columns)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return KeepVectors.build(spark, f"{d}/reviews.parquet", "reviewId", "row_id").repeated(["row_id"])


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    """The reviews, each delivered once."""
    path = f"{d}/reviews.parquet"
    return KeepVectors.build(spark, path, "reviewId", "row_id").keep(spark.read.parquet(path).columns)


#: The same in SQL: the smallest row_id of each meaning of an identifier stays.
_MEANING = r"""CASE WHEN regexp_matches(regexp_replace(regexp_replace(t, '^(urn:)?(uuid:)?', ''), '[{}()\-\x{2010}-\x{2015}\x{2212}]', '', 'g'), '^[0-9a-f]{32}$')
 THEN regexp_replace(regexp_replace(t, '^(urn:)?(uuid:)?', ''), '[{}()\-\x{2010}-\x{2015}\x{2212}]', '', 'g') ELSE t END"""
_ROWS = rf"""WITH n AS (SELECT *, lower(regexp_replace(reviewId, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]', '', 'g')) AS t FROM reviews),
m AS (SELECT * EXCLUDE (t), {_MEANING} AS meaning, t FROM n),
f AS (SELECT * EXCLUDE (t, meaning), t IS NOT NULL AND t <> '' AND row_id > min(row_id) OVER (PARTITION BY meaning) AS again FROM m)"""
P5_FOUND_SQL = f"{_ROWS} SELECT row_id FROM f WHERE again"
P5_KEPT_SQL = f"{_ROWS} SELECT * EXCLUDE (again) FROM f WHERE NOT coalesce(again, FALSE)"
