"""N-gram Jaccard join: components of documents whose shingle sets are alike.

Two sets link when ``100 * intersection >= percent * union``. The join is exact
and never pairs all documents of a group:

1. Document frequencies of all shingles are counted (``hashcount``). A set can
   only link if ``percent`` % of its shingles occur in another document; the
   others leave with their size alone. Equal sets collapse to one node.
2. Set relations: nodes meet under a few min-hash keys, each with the most typical
   node of its key (the one whose shingles occur most often), and the overlap is
   computed. A linked node becomes a member of its most similar leader, at a known
   distance. The source of a group of near copies is the most typical of them, so
   most copies become its members at once, however many there are.
3. Index lists over prefixes (rarest shingles first) hold one block for each
   leader's members, with the block's least position and range of sizes. Lists
   that hold one component are skipped; blocks pair only if sizes and positions
   still allow the overlap and their components differ. A sketch of bit parities,
   whose Hamming distance never exceeds the sets' symmetric difference, rules out
   most of the rest before any set is moved.
4. Answers are derived from the leaders' ones: Jaccard distance is a metric, so
   the distance of two leaders bounds those of their members. Leader pairs too
   far apart are skipped whole. Links of leaders join components, and pairs inside
   one component go; else members of one side are held against the other leader,
   and only those still in reach against its members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import hashcount as hc
from strandloom.llm.textblocks import LOWER, U64, Words, mix, release, text_buffer
from strandloom.operators.components import connected_components
from strandloom.runtime import checkpoint, ship_package

N_KEYS = 3
SKETCH_BITS = 512
_SHORT = U64(0xA5A5A5A5A5A5A5A5)


def shingle_sets(part: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    buf, off = text_buffer(part.column("text"))
    words = Words(LOWER[buf], off)
    grams, valid = words.grams(size)
    edges = words.word_off.tolist()
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a:b][valid[a:b]]))
        elif b > a:
            h = np.full(1, b - a, dtype=U64)
            for k in range(a, b):
                h = mix(h * _SHORT + words.hashes[k])
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def _least_shared(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _row(key: str) -> Column:
    """A row's tag: rows of one key and text share it."""
    return F.xxhash64(key, "text")


def document_sets(docs: DataFrame, key: str, size: int, percent: int, tagged: bool = False) -> DataFrame:
    """doc_id, (row, its tag,) copies (how many equal rows it stands for), n_shingles and, where the set may link: node (its hash), shared (hashes found elsewhere too), prefix (its rarest ones) and the first one's position, keys, sketch, typical (how often its shingles occur elsewhere)."""
    own = ["doc_id", "row"] if tagged else ["doc_id"]
    rows, total = hc.batched(docs.select(F.col(key).alias("doc_id"), "text", _row(key).alias("row")), own)
    own = [*own, "copies"]
    bits = hc.bucket_bits(total // 6)

    def hashes(group: pa.Table) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=U64), *(s for part in hc.slices(group, "text") for s in shingle_sets(part, size))])

    def sets(group: pa.Table, answer: pa.Table) -> pa.Table:
        parts = list(hc.slices(group, "text"))
        every = [s for part in parts for s in shingle_sets(part, size)]
        flat = np.concatenate([np.zeros(0, dtype=U64), *every])
        _, where, _ = hc.distinct(flat, bits, False)
        levels = hc.read_levels(answer)[where] if len(flat) else np.zeros(0, dtype=np.uint8)
        out: dict[str, list] = {k: [] for k in ("n_shingles", "node", "shared", "prefix", "first", "keys", "sketch", "typical")}
        at = 0
        for s in every:
            n, lev = len(s), levels[at : at + len(s)]
            at += n
            common = lev > 0
            row = (n, *[None] * 7)
            if n and int(common.sum()) >= _least_shared(n, percent):
                node = int(mix(np.array([mix(s).sum(dtype=U64) + U64(n)], dtype=U64))[0].view(np.int64))
                order = np.lexsort((s, lev))[: n - _least_shared(n, percent) + 1]
                order = order[common[order]]  # hashes found nowhere else come first and match nothing
                first = n - _least_shared(n, percent) + 1 - len(order)
                shared = s[common]
                keys = [int(mix(shared * U64(2 * k + 3)).min().view(np.int64)) for k in range(N_KEYS)]
                odd = np.bincount((mix(s) & U64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1
                row = (n, node, shared.tobytes(), s[order].view(np.int64), first, keys, np.packbits(odd).view(np.int64), int(16 * lev.sum(dtype=np.int64) // n))
            for values, x in zip(out.values(), row):
                values.append(x)
        release()
        kept = {c: pa.chunked_array([p.column(c) for p in parts], type=group.schema.field(c).type) for c in own}
        return pa.table(
            {
                **kept,
                "n_shingles": pa.array(out["n_shingles"], pa.int64()),
                "node": pa.array(out["node"], pa.int64()),
                "shared": pa.array(out["shared"], pa.binary()),
                "prefix": pa.array(out["prefix"], pa.list_(pa.int64())),
                "first": pa.array(out["first"], pa.int32()),
                "keys": pa.array(out["keys"], pa.list_(pa.int64())),
                "sketch": pa.array(out["sketch"], pa.list_(pa.int64())),
                "typical": pa.array(out["typical"], pa.int32()),
            }
        )

    levels = hc.answers(hc.send_hashes(rows, hashes, bits), exact=False)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in own) + ", n_shingles long, node long, shared binary, prefix array<long>, first int, keys array<long>, sketch array<long>, typical int"
    return rows.groupBy("batch").cogroup(levels.groupBy("batch")).applyInArrow(sets, schema)


def overlaps(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with inter, the size of the sets' intersection, and na, nb."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    rows = pairs.join(left, "a").join(right, "b")
    keep = [*pairs.columns, "na", "nb"]

    def count(batches):
        for batch in batches:
            found = [
                len(np.intersect1d(np.frombuffer(x.as_py(), dtype=U64), np.frombuffer(y.as_py(), dtype=U64), assume_unique=True))
                for x, y in zip(batch.column("sa"), batch.column("sb"))
            ]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(found, pa.int64())], names=[*keep, "inter"])
        release()

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(count, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", inter long")


def _links(percent: int) -> Column:
    return F.expr(f"100 * inter >= {percent} * (na + nb - inter)")


def _distance() -> Column:
    return 1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))


def _may_be_within(a: str, b: str, limit: Column) -> Column:
    """Whether the sketches of a and b allow a Jaccard distance up to ``limit``."""
    h = F.aggregate(F.zip_with(f"{a}sketch", f"{b}sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return 2 * h <= (limit + 1e-9) * (F.col(f"{a}n") + F.col(f"{b}n") + h)


def _linked(docs: DataFrame, size: int, percent: int, key: str, tagged: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the sets of all rows, checkpointed; node and component of every node that links)."""
    ship_package(docs.sparkSession)
    rows = checkpoint(document_sets(docs, key, size, percent, tagged))
    far, slack = 1 - percent / 100, 1e-9
    linking = rows.where("node IS NOT NULL")
    nodes = checkpoint(linking.groupBy("node").agg(F.min("n_shingles").alias("n"), F.min(F.struct("shared", "prefix", "first", "keys", "sketch", "typical")).alias("s")).select("node", "n", "s.*"))

    # 2. leaders
    keyed = nodes.select("node", "typical", F.explode("keys").alias("key"))
    best = keyed.groupBy("key").agg(F.min(F.struct(-F.col("typical"), "node")).alias("best"), F.count(F.lit(1)).alias("m"))
    meeting = checkpoint(best.where("m > 1").select("key", F.col("best.node").alias("b")))  # a table of its own, so that a key of many rows may be split in the join
    to_leaders = keyed.join(meeting, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    found = checkpoint(overlaps(to_leaders, nodes.select("node", "n", "shared")).where(_links(percent)).select("a", "b", _distance().alias("d")))
    first = connected_components(found)
    leaders = found.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select(F.col("a").alias("node"), F.col("x.b").alias("leader"), F.col("x.d").alias("d"))
    member = checkpoint(
        nodes.select("node", "n", "sketch")
        .join(leaders, "node", "left")
        .join(first, "node", "left")
        .select("node", "n", "sketch", F.coalesce("leader", "node").alias("leader"), F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("component", "node").alias("component"))
    )

    # 3. index lists of blocks
    posts = nodes.select("node", "first", F.posexplode("prefix").alias("i", "gram")).select("node", "gram", (F.col("first") + F.col("i")).alias("pos")).join(member.drop("sketch"), "node")
    blocks = posts.groupBy("gram", "leader", "component").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("left")
    )
    mixed = blocks.groupBy("gram").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("gram")
    reach = member.groupBy("leader").agg(F.max("d").alias("r")).join(nodes.select(F.col("node").alias("leader"), "n", "sketch"), "leader")
    reach = checkpoint(reach)
    blocks = checkpoint(blocks.join(mixed, "gram", "left_semi").join(reach, "leader"))
    close = blocks.alias("x").join(
        blocks.alias("y"),
        F.expr(
            f"x.gram = y.gram AND x.leader < y.leader AND x.component <> y.component"
            f" AND 100 * x.hi >= {percent} * y.lo AND 100 * y.hi >= {percent} * x.lo"
            f" AND {100 + percent} * least(x.left, y.left) >= {percent} * (x.lo + y.lo)"
        )
        & _may_be_within("x.", "y.", far + F.col("x.r") + F.col("y.r")),
    )
    leader_pairs = checkpoint(close.select(F.col("x.leader").alias("a"), F.col("y.leader").alias("b")).distinct())

    # 4. answers from the leaders' ones
    plain = nodes.select("node", "n", "shared")
    at = overlaps(leader_pairs, plain).select("a", "b", _links(percent).alias("link"), _distance().alias("d"))
    at = at.join(reach.select(F.col("leader").alias("a"), F.col("r").alias("ra")), "a")
    at = at.join(reach.select(F.col("leader").alias("b"), F.col("r").alias("rb"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch")), "b")
    at = checkpoint(at.where(F.col("link") | (F.col("d") <= far + F.col("ra") + F.col("rb") + slack)))
    joined = found.select("a", "b").unionByName(at.where("link").select("a", "b"))
    second = checkpoint(connected_components(joined))
    of = lambda x, name: second.select(F.col("node").alias(x), F.col("component").alias(name))
    near = at.where("NOT link AND ra + rb > 0").join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").drop("ca", "cb")
    near = near.withColumnsRenamed({"a": "la", "d": "dl"}).drop("link")
    ours = member.select(F.col("leader").alias("ma"), F.col("node").alias("a"), F.col("d").alias("da"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    in_reach = (F.abs(F.col("dl") - F.col("da")) <= far + F.col("rb") + slack) & _may_be_within("a_", "b_", far + F.col("rb"))
    one = near.join(ours, (F.col("la") == F.col("ma")) & in_reach).select("a", "b", "rb").distinct()
    one = overlaps(one, plain).select("a", "b", "rb", F.col("na").alias("a_n"), _links(percent).alias("link"), _distance().alias("d"))
    one = checkpoint(one.where(F.col("link") | (F.col("d") <= far + F.col("rb") + slack)))
    two = one.where("NOT link AND rb > 0").select("a", "a_n", F.col("b").alias("lb"), "d").join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("a_sketch")), "a")
    theirs = member.select(F.col("leader").alias("mb"), F.col("node").alias("b"), F.col("d").alias("db"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"))
    in_reach = (F.abs(F.col("d") - F.col("db")) <= far + slack) & (F.col("a") != F.col("b")) & _may_be_within("a_", "b_", F.lit(far))
    two = two.join(theirs, (F.col("lb") == F.col("mb")) & in_reach).select("a", "b").distinct()
    two = overlaps(two, plain).where(_links(percent)).select("a", "b")
    stars = second.select(F.col("node").alias("a"), F.col("component").alias("b"))
    edges = stars.unionByName(one.where("link").select("a", "b")).unionByName(two)
    return rows, connected_components(edges)


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    Null and empty texts have no shingles and their own doc_id as component, as
    has every text that links with none. Rows with equal sets are one component,
    repeated rows included; a null doc_id counts for the component only if no
    other is there. Only ``key`` and ``text`` are read.
    """
    rows, components = _linked(docs, size, percent, key)
    linking = rows.where("node IS NOT NULL")

    ids = linking.groupBy("node").agg(F.min("doc_id").alias("least"))
    smallest = ids.join(components, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    whole = smallest.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = smallest.select("node", "component").join(whole, "component").select("node", "component_id")
    alone = rows.where("node IS NULL").select("doc_id", "copies", "n_shingles", F.col("doc_id").alias("component_id"))
    return hc.each(linking.select("doc_id", "copies", "n_shingles", "node").join(of_node, "node").select("doc_id", "copies", "n_shingles", "component_id").unionByName(alone))


def keep_one(docs: DataFrame, size: int = 4, percent: int = 85, key: str = "doc_id", keep_repeats: bool = True) -> DataFrame:
    """One document of each component: the smallest key, then the smallest row tag (of key and text); a null key only where no other is.

    Rows that link with none stay, null keys and texts without words included. A
    document that is repeated (same key, not null, and same text) stays as often as it
    is there with ``keep_repeats``, and once without.
    """
    rows, components = _linked(docs, size, percent, key, tagged=True)
    linking = rows.where("node IS NOT NULL").groupBy("node", "doc_id", "row").agg(F.sum("copies").alias("m"))
    least = linking.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "m")).alias("least"))
    nodes = least.join(components, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    best = nodes.groupBy("component").agg(F.min("least").alias("best"))
    nodes = checkpoint(nodes.join(best, "component").select("node", F.col("best.none").alias("none"), F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row"), F.col("best.m").alias("m")))
    beaten = linking.join(nodes.drop("m"), "node").where("NOT (doc_id <=> best_id AND row = best_row)").select("doc_id", "row")
    # copies of a row cannot be told apart: all copies of the best go, and one comes back
    copied = nodes.where("m > 1 AND none" if keep_repeats else "m > 1").select(F.col("best_id").alias("doc_id"), F.col("best_row").alias("row")).distinct()

    whole = docs.select(F.struct("*").alias("doc"), F.col(key).alias("key"), _row(key).alias("tag"))
    same = F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("tag") == F.col("row"))
    stay = whole.join(beaten.unionByName(copied), same, "left_anti").select("doc.*")
    back = whole.join(copied, same, "left_semi").groupBy("key", "tag").agg(F.first("doc").alias("doc")).select("doc.*")
    return stay.unionByName(back)
