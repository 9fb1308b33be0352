"""Burrows-Wheeler transform of a set of reads, run lengths, rank counts, and search in the transform.

The suffixes of short reads over A, C, G, T are sorted as packed words in blocks (``suffixes``), those of short reads
with N once as strings. Where reads are longer (their suffixes together grow with the square of
the length) the order is made by prefix doubling. A suffix starts as a number that stands for
its first ``STEP`` symbols; the first sort gives each suffix the position of the first one of its number. Suffixes
that share a number and have not ended within it are open: they take the position of the
suffix ``STEP`` symbols further on in their read as second key, then of the one twice as far, and so on, until none is open.
Only open suffixes are sorted again, by two numbers; no suffix is ever moved as a string. Suffixes that end
are told apart by read_id at once.

Symbols are A, C, G, N, T and $ (which ends a read and is before all others). Reads need distinct
read_ids; an empty read has the suffix $ alone. No reads give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandloom.operators import suffixes
from strandloom.operators.order import with_position
from strandloom.runtime import checkpoint, remove, scratch, ship_package, written

SYMBOLS = "$ACGNT"
#: Symbols in the first number of a suffix: the most whose numbers of base six are longs.
STEP = 24
#: Reads of up to so many letters have their suffixes sorted once, as strings: that is half the time of doubling for 100 letters.
SHORT = 200
#: Letters in a block of the searchable index.
BLOCK = 4096


def _number(seq: str, p: str) -> Column:
    """The first STEP symbols from a place on as a number; $ and what follows are zeros."""
    digits = F.translate(F.substring(F.col(seq), F.col(p), F.lit(STEP)), SYMBOLS[1:], "12345")
    return F.conv(F.rpad(digits, STEP, "0"), 6, 10).cast("long")


def _first_ranks(rows: DataFrame) -> DataFrame:
    """read_id, p, ch, rank, open. Suffixes that have not ended within their number stay together, so their group's first place is found inside a partition."""
    tie = F.when(F.col("number") % 6 == 0, F.col("read_id")).otherwise(F.lit(-1).cast("long"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    group = Window.partitionBy("number", "tie")
    ranged = rows.withColumn("tie", tie).repartitionByRange("number", "tie").sortWithinPartitions("number", "tie")
    ranged = ranged.withColumns({"_part": F.spark_partition_id(), "_inside": inside})
    ranged = ranged.withColumns({"_first": F.min("_inside").over(group), "open": F.count(F.lit(1)).over(group) > 1})
    ranged = checkpoint(ranged.select("read_id", "p", "ch", "_part", "_first", "open"))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    return ranged.join(F.broadcast(offsets), "_part").select("read_id", "p", "ch", (F.col("_offset") + F.col("_first")).alias("rank"), "open")


def _doubled(ranks: DataFrame, step: int) -> DataFrame:
    """The ranks of the open suffixes by their next ``step`` symbols."""
    ahead = ranks.select("read_id", (F.col("p") - step).alias("p"), F.col("rank").alias("then"))
    rows = checkpoint(ranks.where("open").join(ahead, ["read_id", "p"]).select("read_id", "p", "ch", "rank", "then"))
    pairs = rows.groupBy("rank", "then").agg(F.count(F.lit(1)).alias("n"))
    placed = checkpoint(with_position(pairs, "_at", "rank", "then", sums={"_before": "n"}))
    start = placed.groupBy("rank").agg(F.min("_before").alias("_start"))
    new = placed.join(start, "rank").select("rank", "then", (F.col("rank") + F.col("_before") - F.col("_start")).alias("_new"), (F.col("n") > 1).alias("open"))
    return rows.join(new, ["rank", "then"]).select("read_id", "p", "ch", F.col("_new").alias("rank"), "open")


def suffix_ranks(reads: DataFrame) -> DataFrame:
    """read_id, p (from 1), ch (the symbol before), rank: the place of each suffix in the order of (suffix, read_id)."""
    n = F.length("seq")
    rows = reads.select("read_id", "seq", F.explode(F.sequence(F.lit(1), n + 1)).alias("p"))
    ch = F.when(F.col("p") > 1, F.substring("seq", F.col("p") - 1, F.lit(1))).otherwise("$").alias("ch")
    spark, path = reads.sparkSession, scratch(reads.sparkSession, "ranks")
    ranks = written(_first_ranks(rows.select("read_id", "p", ch, _number("seq", "p").alias("number"))), path)
    step = STEP
    while not ranks.where("open").isEmpty():
        last, path = path, scratch(spark, "ranks")
        ranks = written(ranks.where("NOT open").unionByName(_doubled(ranks, step)), path)
        remove(spark, last)
        step *= 2
    return ranks.drop("open")


def packed_length(reads: DataFrame, least: int = 0) -> int | None:
    """The longest read's letters where reads are short, over A, C, G, T alone and have ``least`` suffixes or more, else none."""
    kinds = reads.agg(F.max(F.length("seq")).alias("n"), F.bool_or(F.col("seq").rlike("[^ACGT]")).alias("others"), F.sum(F.length("seq") + 1).alias("all")).first()
    fits = (kinds["n"] or 0) <= min(SHORT, suffixes.LONGEST) and not kinds["others"] and isinstance(reads.schema["read_id"].dataType, LongType)
    return kinds["n"] or 0 if fits and (kinds["all"] or 0) >= least else None


def packed_blocks(reads: DataFrame, ids: bool = True) -> DataFrame | None:
    """The transform as ``suffixes.blocks`` where ``packed_length`` is given, else none."""
    longest = packed_length(reads)
    return None if longest is None else suffixes.blocks(reads, longest, ids)


def runs_of_reads(reads: DataFrame) -> DataFrame:
    """``run_lengths`` of the transform of reads."""
    found = packed_blocks(reads, ids=False)
    return run_lengths(checkpoint(transform(reads))) if found is None else suffixes.runs_of(found)


def ordered_runs(reads: DataFrame) -> tuple[DataFrame, bool]:
    """The runs of ``runs_of_reads`` and whether they are in order of start over their partitions."""
    found = packed_blocks(reads, ids=False)
    if found is None:
        return run_lengths(checkpoint(transform(reads))), False
    return suffixes.runs_of(found.repartitionByRange("at").sortWithinPartitions("at")), True


def ranks_of_reads(reads: DataFrame) -> DataFrame:
    """``rank_before`` of the transform of reads."""
    found = packed_blocks(reads, ids=False)
    return rank_before(transform(reads)) if found is None else suffixes.ranks_of(found)


def index_of_reads(reads: DataFrame, block: int = BLOCK) -> DataFrame:
    """``searchable`` of the transform of reads."""
    found = packed_blocks(reads, ids=False)
    return searchable(checkpoint(transform(reads)), block) if found is None else suffixes.index_of(found, block)


def transform(reads: DataFrame) -> DataFrame:
    """pos, ch, read_id: the symbol before each suffix in the order of (suffix, read_id); $ ends a read and starts it."""
    found = packed_blocks(reads)
    if found is not None:
        return suffixes.rows_of(found)
    if (reads.agg(F.max(F.length("seq")).alias("n")).first()["n"] or 0) > SHORT:
        return suffix_ranks(reads).select(F.col("rank").alias("pos"), "ch", "read_id")
    rows = reads.select("read_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") + 1)).alias("p"))
    ch = F.when(F.col("p") > 1, F.substring("seq", F.col("p") - 1, F.lit(1))).otherwise("$").alias("ch")
    rows = rows.select("read_id", F.concat(F.expr("substring(seq, p)"), F.lit("$")).alias("suffix"), ch)
    return with_position(rows, "pos", "suffix", "read_id", keep=["ch", "read_id"]).select("pos", "ch", "read_id")


def run_lengths(bwt: DataFrame) -> DataFrame:
    """start, ch, length of each run of one symbol. Runs are found inside ranges of positions; only those at the ranges' borders are put together afterwards."""
    ship_package(bwt.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, str, int] | None = None  # the run that may go on
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, ch = np.asarray(batch.column(0)), batch.column(1).dictionary_encode()
            code, names = np.asarray(ch.indices), ch.dictionary.to_pylist()
            edges = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
            start, size = pos[edges[:-1]], np.diff(edges)
            letter = code[edges[:-1]]
            found = list(zip(start[[0, -1]].tolist(), letter[[0, -1]].tolist(), size[[0, -1]].tolist()))
            rows = [] if held is None else [held]
            if rows and held[1] == names[found[0][1]]:
                rows[0] = (held[0], held[1], held[2] + found[0][2])
                start, letter, size = start[1:], letter[1:], size[1:]
            more = len(start) > 0
            held = (found[1][0], names[found[1][1]], found[1][2]) if more else rows.pop()
            upto = len(start) - more
            out = {
                "start": np.concatenate([[r[0] for r in rows], start[:upto]]).astype(np.int64),
                "ch": [r[1] for r in rows] + [names[c] for c in letter[:upto].tolist()],
                "length": np.concatenate([[r[2] for r in rows], size[:upto]]).astype(np.int64),
            }
            border = np.zeros(len(out["ch"]), dtype=bool)
            border[:1] = first
            first = first and not len(border)
            yield pa.record_batch({**{k: pa.array(v) if k != "ch" else pa.array(v, pa.string()) for k, v in out.items()}, "border": pa.array(border)})
        if held is not None:
            yield pa.record_batch({"start": pa.array([held[0]], pa.int64()), "ch": pa.array([held[1]], pa.string()), "length": pa.array([held[2]], pa.int64()), "border": pa.array([True])})

    ranged = bwt.select("pos", "ch").repartitionByRange("pos").sortWithinPartitions("pos")
    runs = checkpoint(ranged.mapInArrow(run, "start long, ch string, length long, border boolean"))
    order = Window.orderBy("start")  # over two rows a partition
    ends = runs.where("border").withColumn("_new", F.coalesce((F.lag("ch").over(order) != F.col("ch")) | (F.lag(F.col("start") + F.col("length")).over(order) != F.col("start")), F.lit(True)).cast("int"))
    joined = ends.withColumn("_run", F.sum("_new").over(order)).groupBy("_run").agg(F.min("start").alias("start"), F.first("ch").alias("ch"), F.sum("length").alias("length"))
    return runs.where("NOT border").select("start", "ch", "length").unionByName(joined.select("start", "ch", "length"))


def expand(runs: DataFrame) -> DataFrame:
    """pos and ch of runs (start, ch, length): the transform that ``run_lengths`` packed."""
    return runs.select(F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"), "ch")


def rank_before(bwt: DataFrame, block: int = 1 << 16) -> DataFrame:
    """pos, ch, rank: how often the symbol stands before this position. Counts of whole blocks are added to counts inside one."""
    rows = checkpoint(bwt.select("pos", "ch", F.floor(F.col("pos") / block).alias("block")))
    before = _before_blocks(rows).select("block", F.explode(F.map_from_arrays(F.array(*map(F.lit, SYMBOLS)), "before")).alias("ch", "earlier"))
    inside = F.row_number().over(Window.partitionBy("ch", "block").orderBy("pos")) - 1
    return rows.withColumn("inside", inside).join(before, ["ch", "block"]).select("pos", "ch", (F.col("earlier") + F.col("inside")).cast("long").alias("rank"))


def _before_blocks(rows: DataFrame) -> DataFrame:
    """block, before: for each symbol, how often it stands in earlier blocks. Sums run over ranges of blocks."""
    counts = rows.groupBy("block").agg(*(F.count_if(F.col("ch") == c).alias(f"n{i}") for i, c in enumerate(SYMBOLS)))
    placed = with_position(counts, "_at", "block", sums={f"b{i}": f"n{i}" for i in range(len(SYMBOLS))})
    return placed.select("block", F.array(*(F.col(f"b{i}") for i in range(len(SYMBOLS)))).alias("before"))


def searchable(bwt: DataFrame, block: int = BLOCK) -> DataFrame:
    """The transform as an index to search in: block, letters (of ``block`` positions), before (how often each symbol stands in earlier blocks), smaller (how often each smaller symbol stands anywhere)."""
    rows = checkpoint(bwt.select("pos", "ch", F.floor(F.col("pos") / block).alias("block")))
    letters = rows.groupBy("block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("letters"))
    total = rows.groupBy("ch").count().collect()  # six numbers
    counts = {r["ch"]: r["count"] for r in total}
    smaller = F.array(*(F.lit(sum(counts.get(d, 0) for d in SYMBOLS[:i])).cast("long") for i in range(len(SYMBOLS))))
    return letters.join(_before_blocks(rows), "block").select("block", "letters", "before", smaller.alias("smaller"))


def _step_back(rows: DataFrame, index: DataFrame, block: int) -> DataFrame:
    """``rows`` (letter, at) with rank: how many suffixes of the index are smaller than the letter before a suffix that ``at`` of them are smaller than."""
    code = F.expr(f"locate(letter, '{SYMBOLS[1:]}')")
    head = F.substring("letters", F.lit(1), (F.col("at") - F.col("block") * block).cast("int"))
    inside = F.length(head) - F.length(F.replace(head, F.col("letter")))
    rank = F.when(code > 0, F.get("smaller", code) + F.get("before", code) + inside).otherwise(0).cast("long")
    # a position right behind the last letter of a block is looked up in that block
    placed = rows.withColumn("block", F.floor(F.greatest(F.col("at") - 1, F.lit(0)) / block))
    return placed.join(index, "block").select(*rows.columns, rank.alias("rank"))


def find_patterns(index: DataFrame, patterns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``patterns`` (pattern) with low and high: suffixes at positions low to high - 1 begin with the pattern; where none does, both are 0.

    All patterns go back letter by letter together: a letter is one join of their interval ends with
    the blocks that hold them. Patterns are taken once each; a null one has no row. An empty pattern begins every suffix. A
    pattern with another letter than A, C, G, N, T is in no read.
    """
    size = index.agg(F.coalesce(F.max(F.col("block") * block + F.length("letters")), F.lit(0)).alias("n")).first()["n"]
    rows = patterns.select("pattern").where("pattern IS NOT NULL").distinct().withColumns({"low": F.lit(0).cast("long"), "high": F.lit(size).cast("long")})
    longest = patterns.agg(F.coalesce(F.max(F.length("pattern")), F.lit(0)).alias("n")).first()["n"]
    path = scratch(index.sparkSession, "intervals")
    rows = written(rows, path)
    for i in range(longest):
        letter = F.substring("pattern", F.length("pattern") - i, F.lit(1))
        live = rows.where((F.length("pattern") > i) & (F.col("low") < F.col("high")))
        ends = live.select("pattern", letter.alias("letter"), F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("low").alias("at")), F.struct(F.lit(1).alias("end"), F.col("high").alias("at")))).alias("e"))
        found = _step_back(ends.select("pattern", "letter", "e.end", "e.at"), index, block).select("pattern", "end", "rank")
        moved = found.groupBy("pattern").agg(F.max(F.when(F.col("end") == 0, F.col("rank"))).alias("low"), F.max(F.when(F.col("end") == 1, F.col("rank"))).alias("high"))
        last, path = path, scratch(index.sparkSession, "intervals")
        rows = written(rows.where((F.length("pattern") <= i) | (F.col("low") >= F.col("high"))).unionByName(moved), path)
        remove(index.sparkSession, last)
    some = F.col("low") < F.col("high")
    return rows.select("pattern", F.when(some, F.col("low")).otherwise(0).alias("low"), F.when(some, F.col("high")).otherwise(0).alias("high"))


def insert(bwt: DataFrame, reads: DataFrame, block: int = BLOCK) -> DataFrame:
    """pos and ch of the transform of the old reads, of which ``bwt`` (pos, ch) is all that is needed, and ``reads`` together.

    The read_ids of the new reads are above all old ones. All new reads go back letter by letter together
    through the old transform, one join a letter, which tells for each new suffix how many old ones are before
    it; the order among the new ones is sorted as in ``transform``. Then both are interleaved by one sort of
    three numbers. No old suffix is compared again.
    An index without rows gives the transform of ``reads``; reads with another letter than A, C, G, N, T are an error.
    """
    spark, root = bwt.sparkSession, scratch(bwt.sparkSession, "inserted")
    index = written(searchable(bwt, block), scratch(spark, "index"))
    first = index.select(F.get("smaller", F.lit(1)).alias("n")).first()
    if first is None:
        return transform(reads).select("pos", "ch")
    foreign = F.length(F.translate("seq", SYMBOLS[1:], "")) > 0
    known = F.when(foreign, F.raise_error(F.lit("a read has a letter that the index does not know"))).otherwise(F.col("seq"))
    state = reads.select("read_id", known.alias("seq"), (F.length("seq") + 1).alias("p"), F.lit(first["n"]).cast("long").alias("at"))
    paths = [f"{root}/0"]
    state = written(state, paths[0])
    while not (live := state.where("p > 1")).isEmpty():
        letter = F.substring("seq", F.col("p") - 1, F.lit(1))
        moved = _step_back(live.withColumn("letter", letter), index, block)
        paths.append(f"{root}/{len(paths)}")
        state = written(moved.select("read_id", F.expr("left(seq, p - 2)").alias("seq"), (F.col("p") - 1).alias("p"), F.col("rank").alias("at")), paths[-1])
    before = spark.read.schema("read_id long, p int, at long").parquet(*paths)
    new = suffix_ranks(reads).withColumn("p", F.col("p").cast("int")).join(before, ["read_id", "p"]).select(F.col("at").alias("place"), F.lit(0).alias("side"), "rank", "ch")
    old = bwt.select(F.col("pos").alias("place"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("rank"), "ch")
    return with_position(old.unionByName(new), "pos", "place", "side", "rank", keep=["ch"]).select("pos", "ch")
