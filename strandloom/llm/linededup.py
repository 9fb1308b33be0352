"""Lines that many documents share, by levelled sorted runs of line hashes. Spark expressions only.

A line's key is the line without space and 0x09-0x0D at its ends, A-Z lower-cased; keys of fewer than
``min_chars`` code points are left alone. Keys are known by two 64-bit hashes with different seeds, so two keys
are taken for one with a probability of about 2^-128 a pair.

``LineRuns`` keeps the keys of all batches seen so far in runs: tables that are bucketed and sorted by hash.
A new batch is shuffled once and anti-joined with each run by merging, run by run, without a
shuffle of the runs; the keys that no run holds are its own new run, and for the others it leaves
counts. When a level has ``fanout`` runs they are merged into one run of the next level, so there are few runs however many batches there were.

``drop_shared_lines`` adds a table batch by batch (the batches are parts of its rows of about the
same size, and may be arbitrarily large), and then drops every line of a key found in ``min_docs`` documents or more, but for the
lines in the document with the largest key value. A key in a thousandth of the documents or more, of which there can
be few, is looked up by broadcast, so that no frequent line gathers in one task.

A row is a document. Rows with the same doc_id are counted each, and keep their lines together; a null
doc_id is below all others. A null or empty text is one empty line. Lines of a repeated row are repeated.
An empty table gives no rows. All columns of the input are kept by ``drop_shared_lines``, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.runtime import checkpoint, remove, scratch

MIN_CHARS, MIN_DOCS = 20, 3
#: Parts of a table that are added one after the other, and runs of a level that are merged into one.
BATCHES, FANOUT = 4, 3
_KEY = ["h1", "h2"]
_HASHES = "array<struct<h1:bigint,h2:bigint>>"


def lines_of(text: Column) -> Column:
    """The lines of a text; an empty or null one is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(lines: Column, min_chars: int = MIN_CHARS) -> Column:
    """(pos, h1, h2) of the lines whose key is long enough."""
    key = F.transform(lines, lambda line: F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    hashed = F.transform(key, lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))
    return F.filter(hashed, lambda x: x.isNotNull())


class LineRuns:
    """Keys of all batches added so far, in sorted runs of growing size.

    A run is a table (h1, h2, n, last, seen): the documents of a batch (or of merged batches) that
    hold a key, and the largest of their ids. ``seen`` rows are counts of keys that an
    earlier run holds. Each key has one row without ``seen`` among all runs.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, max(2, fanout)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch(self.spark, "run")
        rows.write.partitionBy("seen").bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        remove(self.spark, run[1])

    def runs(self) -> list[DataFrame]:
        """All runs, the largest first."""
        return [self.spark.table(name) for level in reversed(self.levels) for name, _ in level]

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows (with h1 and h2) whose key no run holds."""
        for run in self.runs():
            rows = rows.join(run.where("NOT seen").select(*_KEY), _KEY, "left_anti")
        return rows

    def add(self, counts: DataFrame) -> None:
        """Add a batch: (h1, h2, n, last), a row for each key."""
        rows = counts.withColumn("seen", F.lit(False))
        for run in self.runs():
            held = run.where("NOT seen").select(*_KEY, F.lit(True).alias("_held"))
            rows = rows.join(held, _KEY, "left").withColumn("seen", F.col("seen") | F.coalesce("_held", F.lit(False))).drop("_held")
        self._put(0, self._write(rows))

    def _put(self, level: int, run: tuple[str, str]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(_summed(self._all(old), "seen")))
            for gone in old:
                self._drop(gone)

    def _all(self, runs: list[tuple[str, str]]) -> DataFrame:
        rows = self.spark.table(runs[0][0])
        for name, _ in runs[1:]:
            rows = rows.unionByName(self.spark.table(name))
        return rows

    def shared(self, min_docs: int) -> DataFrame:
        """(h1, h2, n, last) of the keys of ``min_docs`` documents or more."""
        return _summed(self._all([run for level in self.levels for run in level])).where(F.col("n") >= min_docs)

    def close(self) -> None:
        """Delete all runs."""
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []


def _summed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy(*_KEY, *more).agg(F.sum("n").alias("n"), F.max("last").alias("last")).select(*_KEY, "n", "last", *more)


def _counts(keyed: DataFrame) -> DataFrame:
    """(h1, h2, n, last) of rows with _id and _keys; a key counts once in a row."""
    once = F.array_distinct(F.transform("_keys", lambda k: F.struct(k["h1"].alias("h1"), k["h2"].alias("h2"))))
    rows = keyed.select("_id", F.explode(once).alias("k")).select("k.h1", "k.h2", F.lit(1).cast("long").alias("n"), F.col("_id").alias("last"))
    return _summed(rows)


def new_lines(docs: DataFrame, runs: LineRuns, key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, pos) of the lines of a new batch whose key no earlier batch had, repeats inside the batch included; the batch is added to ``runs``."""
    keyed = checkpoint(docs.select(F.col(key).alias("_id"), line_keys(lines_of(F.col("text")), min_chars).alias("_keys")))
    rows = keyed.select("_id", F.explode("_keys").alias("k")).select(F.col("_id").alias(key), "k.pos", "k.h1", "k.h2")
    out = checkpoint(runs.unseen(rows).select(key, "pos"))
    runs.add(_counts(keyed))
    return out


def _row_hash(id_: Column, text: Column) -> list[Column]:
    return [F.xxhash64(id_, text).alias("_r1"), F.xxhash64(F.lit(1), id_, text).alias("_r2")]


def drop_shared_lines(docs: DataFrame, key: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` documents or more share, and n_lines (before) and n_dropped; the largest ``key`` keeps its lines.

    Columns of ``docs`` named n_lines or n_dropped are replaced. A null text stays null.
    """
    spark = docs.sparkSession
    packed = docs.select(F.col(key).alias("_id"), F.col("text").alias("_text"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    hashes = _row_hash(F.col("_id"), F.col("_text"))
    keyed = packed.select("_id", *hashes, line_keys(lines_of(F.col("_text")), min_chars).alias("_keys")).where(F.size("_keys") > 0)
    keyed = checkpoint(keyed.withColumn("_batch", F.pmod(F.col("_r2"), F.lit(batches)).cast("int")))
    runs = LineRuns(spark, fanout)
    for i in range(batches):
        runs.add(_counts(keyed.where(F.col("_batch") == i)))
    shared = checkpoint(runs.shared(min_docs))
    runs.close()
    dropped = _dropped(keyed, shared)
    rows = packed.select("*", *hashes).join(dropped, ["_r1", "_r2"], "left")
    # the lines between dropped ones are cut out as slices, so long texts stay linear
    rows = rows.withColumn("_lines", lines_of(F.col("_text"))).withColumn("_at", F.concat(F.array(F.lit(-1)), F.coalesce("_gone", F.expr("cast(array() as array<int>)")), F.array(F.size("_lines"))))
    spans = F.transform(F.sequence(F.lit(1), F.size("_at") - 1), lambda i: F.slice("_lines", F.get("_at", i - 1) + 2, F.get("_at", i) - F.get("_at", i - 1) - 1))
    text = F.when(F.col("_text").isNotNull(), F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(spans), "\n")))
    kept = [F.col(f"_row.{c}").alias(c) if c != "text" else text.alias("text") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*kept, F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))


def _dropped(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """(_r1, _r2, _gone): the sorted positions of each row's dropped lines. Equal rows have one entry."""
    rows = keyed.select("_id", "_r1", "_r2", F.explode("_keys").alias("k")).select("_id", "_r1", "_r2", "k.pos", "k.h1", "k.h2")
    lost = ~F.col("_id").eqNullSafe(F.col("last"))
    # counts of documents add up to no more than the lines there are, so few keys can have a thousandth of them
    bar = max(1, keyed.agg(F.coalesce(F.sum(F.size("_keys")), F.lit(0)).alias("n")).first()["n"] // 1000)
    often = F.broadcast(shared.where(F.col("n") >= bar).select(*_KEY, F.col("last").alias("_last"), F.lit(True).alias("_often")))
    rows = rows.join(often, _KEY, "left")
    gone = rows.where("_often").withColumn("last", F.col("_last")).where(lost).select("_r1", "_r2", "pos")
    rare = rows.where("_often IS NULL").drop("_last", "_often").join(shared.where(F.col("n") < bar).select(*_KEY, "last"), _KEY).where(lost).select("_r1", "_r2", "pos")
    return gone.unionByName(rare).groupBy("_r1", "_r2").agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
