"""Readers of sequence files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strandloom.functions import seq as S
from strandloom.operators.order import with_position
from strandloom.runtime import ship_package
from strandloom.sources import datasource

CLUSTER_MARK = "cluster_start"


def _placed(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """value and place (from 0) of all records of the files at ``path``, by file and place in it; large files are read in parts."""
    raw = spark.read.option("lineSep", separator).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    return with_position(raw, "place", "file_path", "file_block_start", "id", keep=["value"])


def fasta(spark: SparkSession, path: str, validate: bool = True, places: bool = False) -> DataFrame:
    """record_no, header, seq of FASTA records (plain or gzip); multi-line records are joined.

    record_no counts all records that have a sequence, valid or not, by file and place in it. With
    ``validate`` sequences are cleaned and those with other letters than ACGT go, and so do
    records without a sequence; else these have no record_no. With ``places`` the place
    among all records is given too.
    """
    raw = _placed(spark, path, "\n>").where(r"length(regexp_replace(value, '\\s', '')) > 0")
    text = F.regexp_replace("value", "^>", "")
    rows = raw.select(
        "place",
        F.regexp_replace(F.substring_index(text, "\n", 1), r"\r$", "").alias("header"),
        F.when(F.contains(text, F.lit("\n")), F.substring(text, F.locate("\n", text) + 1, F.length(text))).otherwise("").alias("body"),
    ).withColumns({"seq": S.clean("body"), "raw": F.regexp_replace("body", r"[\r\n]", "")})
    some = F.col("seq") != ""
    numbered = with_position(rows.withColumn("some", some.cast("long")), "_n", "place", sums={"record_no": "some"}).withColumn("record_no", F.when(some, F.col("record_no")))
    out = ["record_no", "header", "seq", *(["place"] if places else [])]
    if validate:
        return numbered.where(S.is_valid("seq")).select(*out)
    return numbered.withColumn("seq", F.col("raw")).select(*out)


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """record_no, header, seq, qual of records of four lines (plain or gzip).

    Lines are numbered by file and place, so large files are read in parts.
    """
    rows = _placed(spark, path).withColumnRenamed("place", "line")
    part = lambda i: F.max(F.when(F.col("line") % 4 == i, F.regexp_replace("value", r"\r$", "")))
    records = rows.groupBy(F.floor(F.col("line") / 4).alias("record_no")).agg(part(0).alias("header"), part(1).alias("seq"), part(3).alias("qual"))
    return records.where("seq IS NOT NULL").select("record_no", F.substring("header", 2, 1 << 30).alias("header"), "seq", "qual")


def sequences(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """record_no, header, seq, qual of FASTA or FASTQ files, plain, gzip or in gzip blocks, by the data source ``sequences`` and with its options.

    Plain files and files of gzip blocks are read in parts.
    """
    datasource.register(spark)
    rows = spark.read.format(datasource.NAME).options(**options).load(path)
    return with_position(rows, "record_no", "file", "part", "at", keep=["header", "seq", "qual"]).select("record_no", "header", "seq", "qual")


def fastq_to_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTQ records with their running number as header."""
    return fastq(spark, path).select("record_no", F.col("record_no").cast("string").alias("header"), "seq")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One sequence a line, cut at the first character that is no letter."""
    raw = spark.read.text(path).withColumn("record_no", F.monotonically_increasing_id())
    return raw.select("record_no", S.first_letters("value").alias("seq")).where("length(seq) > 0")


def clusters(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """cluster_id, seq_no, seq of a cluster file: a header ``cluster_start`` (or, unless exact, one that starts so) opens a cluster."""
    rows = fasta(spark, path, validate=False, places=True)
    opens = (F.col("header") == CLUSTER_MARK) if exact else F.col("header").startswith(CLUSTER_MARK)
    numbered = with_position(rows.withColumn("opens", opens.cast("long")), "at", "place", sums={"before": "opens"})
    numbered = numbered.withColumn("cluster_id", F.col("before") + F.col("opens") - 1).where("cluster_id >= 0")
    first = numbered.where("opens = 1").select("cluster_id", F.col("at").alias("first"))
    return numbered.join(first, "cluster_id").select("cluster_id", (F.col("at") - F.col("first")).alias("seq_no"), S.clean("seq").alias("seq"))


def count_clusters(spark: SparkSession, path: str) -> int:
    return fasta(spark, path, validate=False).where(F.col("header").startswith(CLUSTER_MARK)).count()


def groups(spark: SparkSession, path: str) -> DataFrame:
    """group_id, read_id of a file with the ids of a group on each line."""
    raw = spark.read.text(path).where("length(trim(value)) > 0").withColumn("group_id", F.monotonically_increasing_id())
    return raw.select("group_id", F.explode(F.split(F.trim("value"), r"\s+")).alias("id")).select("group_id", F.col("id").cast("long").alias("read_id"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """start, ch, length of the runs of a saved index."""
    return spark.read.schema("start long, ch string, length long").parquet(path)


def mate_pairs(spark: SparkSession, path: str) -> DataFrame:
    """r1, r2 of a file with two ids on each line."""
    return spark.read.csv(path, sep=" ", schema="r1 long, r2 long")


#: Bytes of text that are cut at once; a longer text stands alone.
_CUT_BYTES = 4 << 20


def _cut(ids: pa.Array, texts: pa.Array, table: np.ndarray, length: int, rest: bool) -> pa.RecordBatch:
    """doc_id, i, seq of some texts; ``table`` has the base of each byte, 0 where it is no letter."""
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    bases = table[raw]
    letter = bases > 0
    before = np.zeros(len(letter) + 1, dtype=np.int64)
    np.cumsum(letter, out=before[1:])
    off = before[off - off[0]]
    bases, sizes = bases[letter], np.diff(off)  # own bytes, turned in place
    odd = np.fmod(np.asarray(ids.fill_null(0)), 2) == 1
    for d in np.flatnonzero(odd & (sizes > 0)).tolist():
        own = bases[off[d] : off[d + 1]]
        own[:] = _COMPLEMENT[own[::-1]]
    n = -(-sizes // length) if rest else sizes // length
    if not rest:
        edge, left = np.zeros(len(bases) + 1, dtype=np.int8), sizes % length > 0
        edge[(off[:-1] + n * length)[left]] += 1
        edge[off[1:][left]] -= 1
        bases = bases[np.cumsum(edge[:-1], dtype=np.int8) == 0]
    doc = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    ends = np.concatenate([[0], np.cumsum(np.minimum(length, sizes[doc] - i * length))]).astype(np.int32)
    seq = pa.StringArray.from_buffers(len(doc), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bases)))
    return pa.record_batch([ids.take(pa.array(doc)), pa.array(i, pa.int64()), seq], names=["doc_id", "i", "seq"])


_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[list(b"ACGT")] = list(b"TGCA")


def reads_of_texts(docs: DataFrame, length: int = 100, keep_n: bool = False, rest: bool = True) -> DataFrame:
    """doc_id, i, seq: letters of each text as bases, odd ids on the other strand, cut in pieces of ``length``.

    With ``keep_n`` the letter N stays N, which gives sequences with unknown bases. The last
    piece of a text may be shorter; without ``rest`` only pieces of full ``length`` are given.
    Texts are cut as bytes (Arrow, numpy).
    """
    ship_package(docs.sparkSession)
    table = np.zeros(256, dtype=np.uint8)
    for first in b"Aa":
        table[first : first + 26] = list(b"ACGTACGTACGTA" + (b"N" if keep_n else b"C") + b"GTACGTACGTAC")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64)
            cut = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // _CUT_BYTES)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                yield _cut(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), table, length, rest)

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("i", LongType()), StructField("seq", StringType())])
    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, schema)
