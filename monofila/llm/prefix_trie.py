"""Conversation prefix trie by union-find over the common prefixes of sorted neighbours.

Conversations that begin with the same turns share the nodes of a trie. Every conversation is a
sequence of turn digests (128 bits of role and text). In sorted order a node is a run of
neighbours, and two neighbours share exactly the nodes down to their longest common prefix (LCP).
So the trie is built like this: take the edges between neighbours in descending depth of their LCP
and join what they connect. Every join of two components closes the chains below it and makes a
branching node at that depth; nodes between two joins have one child and the same members. What a
node needs (members, leaves, bytes below it) are sums over its run, taken from running totals.

Where it scales:

* Equal sequences are combined first, on the map side, so a conversation that a third of all repeat
  is one row.
* A sequence is dealt out in segments of ``SEGMENT`` turns, each named by a hash of all before it, so
  one conversation with a third of all turns is many rows. Turns are numbered after a range partition,
  never in one group per conversation. What lies below a segment's end comes from the segments there,
  summed up in rounds that double their reach.
* Segments are range partitioned by sequence and every partition builds its forest. Only prefixes of
  a partition's first and last row can go on in another partition; these spines, at most two segments
  per partition, leave their own nodes out of the sums, meet under their prefix hash, and get the sums
  of the merged spine nodes below them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from monofila.llm.common import scratch

#: Turns of a segment, and bytes of conversation ids hashed at a time.
SEGMENT, PIECE = 64, 8_192
#: Turns that a conversation takes over from its base at most, conversations of one base.
TAKEN, FAMILY = 8, 5
#: Odd bases of the two prefix hashes, and what sets the root of a segment's tree apart from the node
#: of the segment before that has the same prefix.
_BASES, _ROOT = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95), 0x5DEECE66D
_EMPTY = hashlib.sha256(b"").hexdigest()

_NODE = (
    "spine boolean, inner boolean, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, parent bigint, conv_id bigint, n bigint, "
    "kids bigint, leaves bigint, total bigint, held bigint, ends bigint, size bigint, above array<struct<k1:bigint,k2:bigint>>"
)


def prefix_sums(digests: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Running sums of digest * base ** place (modulo 2 ** 64) over rows, one column per base, from 0."""
    out = np.zeros((len(digests) + 1, 2), dtype=np.uint64)
    blocks, which = np.unique(at // SEGMENT, return_inverse=True)
    for k, base in enumerate(_BASES):
        near = np.array([pow(base, i, 1 << 64) for i in range(SEGMENT)], dtype=np.uint64)
        far = np.array([pow(base, SEGMENT * i, 1 << 64) for i in blocks.tolist()], dtype=np.uint64)
        if len(at):
            np.cumsum(digests[:, k] * near[at % SEGMENT] * far[which], out=out[1:, k])
    return out


# ---- turns and their places ----------------------------------------------


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, t1, t2, size): turns with their place from 1, null turns first, equal turns by
    their digest. A conversation over many partitions is numbered in all of them at once."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"), F.octet_length(text).cast("bigint").alias("size"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "t1", "t2"]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches):
        last, seen = None, 0
        for b in batches:
            conv = b.column("conv_id").to_numpy()
            if not len(conv):
                continue
            begin = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            at = np.arange(1, len(conv) + 1) - np.repeat(begin, np.diff(np.append(begin, len(conv))))
            if conv[0] == last:
                at[: begin[1] if len(begin) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(at[-1])
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("conv_id", "t1", "t2", "size", "part")} | {"at": pa.array(at)})

    rows = scratch(
        placed.select("conv_id", "t1", "t2", "size", "part").mapInArrow(run, "conv_id bigint, t1 bigint, t2 bigint, size bigint, part int, at bigint"), "turns"
    )
    runs = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # A border between partitions lies in one conversation at most, so these are fewer than partitions.
    later = runs.withColumn("before", before).filter("before > 0").select("conv_id", "part", "before")
    return rows.join(F.broadcast(later), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "t1", "t2", "size"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, at, t1, t2, size) after each conversation took its base's first turns for its
    own, and (conv_id, length, bytes) of every conversation, turnless ones too."""
    turn = F.struct("at", "t1", "t2", "size")
    found = turns.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sort_array(F.collect_list(F.when(F.col("at") <= TAKEN, turn))).alias("head"),
        F.coalesce(F.sum(F.when(F.col("at") <= F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(TAKEN + 1)), F.col("size"))), F.lit(0)).alias("lost"),
    )
    base = found.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("given"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(TAKEN + 1)).cast("int")
    plans = (
        found.select("conv_id", "n", "bytes", "lost", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"))
        .join(base, "base", "left").withColumn("given", F.filter("given", lambda x: x["at"] <= F.col("h")))
    )
    taken = F.coalesce(F.size("given"), F.lit(0))
    plans = scratch(plans.select("conv_id", "n", "bytes", "lost", "h", F.when(F.col("given").isNotNull(), taken).otherwise(0).alias("taken"), "given"), "plans")
    heads = plans.select("conv_id", F.inline("given"))
    tails = turns.join(plans.select("conv_id", "h", "taken"), "conv_id").filter("at > h").select(
        "conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "t1", "t2", "size"
    )
    head_bytes = F.aggregate(F.coalesce(F.transform("given", lambda x: x["size"]), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda x, y: x + y)
    sizes = plans.select(
        "conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        (head_bytes + F.col("bytes") - F.col("lost")).alias("bytes"),
    )
    return heads.unionByName(tails), sizes


# ---- segments --------------------------------------------------------------


def cut(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, segment, seq, sizes, h1, h2, bytes): pieces of SEGMENT turns. ``seq`` holds 16 bytes a
    turn; h1 and h2 are the segment's own part of the prefix hash."""
    item = F.struct("at", "t1", "t2", "size")
    grouped = turns.groupBy("conv_id", F.floor((F.col("at") - 1) / SEGMENT).cast("bigint").alias("segment")).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    empty = sizes.filter("length = 0").select("conv_id", F.lit(0).cast("bigint").alias("segment"), F.array().cast(grouped.schema["turns"].dataType).alias("turns"))

    def run(batches):
        for b in batches:
            lists = b.column("turns")
            count, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
            ends = np.cumsum(count)
            both = np.stack([flat.field(k).to_numpy().view(np.uint64) for k in ("t1", "t2")], axis=1) if len(flat) else np.zeros((0, 2), np.uint64)
            data = both.astype(">u8").tobytes()
            seq = [data[16 * (e - n) : 16 * e] for n, e in zip(count.tolist(), ends.tolist())]
            sums = prefix_sums(both, flat.field("at").to_numpy().astype(np.int64))
            own = sums[ends] - sums[ends - count]
            size = np.concatenate(([0], np.cumsum(flat.field("size").to_numpy())))
            yield pa.RecordBatch.from_pydict({
                "conv_id": b.column("conv_id"), "segment": b.column("segment"), "seq": pa.array(seq, pa.binary()),
                "sizes": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), flat.field("size")),
                "h1": pa.array(own[:, 0].view(np.int64) if len(own) else np.zeros(0, np.int64)),
                "h2": pa.array(np.ascontiguousarray(own[:, 1]).view(np.int64) if len(own) else np.zeros(0, np.int64)),
                "bytes": pa.array((size[ends] - size[ends - count]).astype(np.int64)),
            })

    return grouped.unionByName(empty).mapInArrow(run, "conv_id bigint, segment bigint, seq binary, sizes array<bigint>, h1 bigint, h2 bigint, bytes bigint")


def wrapped(sum_: Column) -> Column:
    """A sum of 64-bit numbers, modulo 2 ** 64."""
    whole, half = (F.lit(x).cast("decimal(21,0)") for x in (str(2**64), str(2**63)))
    rest = F.pmod(sum_, whole)
    return F.when(rest >= half, rest - whole).otherwise(rest).cast("bigint")


def segments(pieces: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct segments (segment, k1, k2, seq, sizes, n, first, ends, after, e1, e2) and where each
    conversation ends (e1, e2, conv_id). k and e are the prefix hashes before and behind a segment,
    ``after`` the bytes of its conversations behind it."""
    rows = scratch(pieces, "pieces")
    # Only what goes on past its first segment needs the hashes of those before; sums wrap on purpose.
    several = rows.filter("segment > 0").select("conv_id").distinct()
    parts = rows.join(several, "conv_id", "left_semi").select("conv_id", "segment", "h1", "h2", "bytes")
    upto = W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)

    def wide(c: str) -> Column:
        return F.sum(F.col(c).cast("decimal(20,0)")).over(upto)

    before = parts.select(
        "conv_id", "segment", wrapped(F.coalesce(wide("h1"), F.lit(0))).alias("k1"), wrapped(F.coalesce(wide("h2"), F.lit(0))).alias("k2"),
        F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("passed"),
    ).filter("segment > 0")
    none = F.lit(0).cast("bigint")
    first = rows.filter("segment = 0").withColumns({"k1": none, "k2": none, "passed": none})
    placed = first.unionByName(rows.filter("segment > 0").join(before, ["conv_id", "segment"])).join(sizes.withColumnRenamed("bytes", "all"), "conv_id")
    whole_rows = placed.withColumns({
        "e1": F.when(F.col("length") == 0, _ROOT).otherwise(wrapped(F.col("k1").cast("decimal(20,0)") + F.col("h1"))), "e2": wrapped(F.col("k2").cast("decimal(20,0)") + F.col("h2")),
        "last": F.col("length") <= (F.col("segment") + 1) * SEGMENT, "after": F.col("all") - F.col("passed") - F.col("bytes"),
    })
    told = scratch(whole_rows, "placed-pieces")
    distinct = told.groupBy("segment", "k1", "k2", "seq").agg(
        F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("first"), F.count(F.when(F.col("last"), 1)).alias("ends"),
        F.sum("after").alias("after"), F.first("e1").alias("e1"), F.first("e2").alias("e2"),
    )
    return scratch(distinct, "segments"), told.filter("last").select("e1", "e2", "conv_id")


# ---- the forest of a partition ---------------------------------------------


def common(seqs: list[bytes], tree: np.ndarray) -> np.ndarray:
    """LCP of each row with the one before it, -1 where the tree changes; one entry more at the end."""
    out = np.full(len(seqs) + 1, -1, dtype=np.int64)
    for i in range(1, len(seqs)):
        if tree[i] == tree[i - 1]:
            a, b = seqs[i - 1], seqs[i]
            n = min(len(a), len(b)) // 16
            x, y = np.frombuffer(a, ">u8", 2 * n), np.frombuffer(b, ">u8", 2 * n)
            differ = x != y
            out[i] = int(differ.argmax()) // 2 if differ.any() else n
    return out


def chains(lcp: np.ndarray, length: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(from row, to row, top depth, bottom depth, children of the bottom, smallest id) of every chain
    of nodes with the same members, by union-find over the edges in descending depth."""
    n = len(length)
    up, low, high, depth = list(range(n)), list(range(n)), list(range(n)), length.tolist()
    kids, least, out = [0] * n, first.tolist(), []
    edges = np.flatnonzero(lcp[1:n] >= 0) + 1

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in edges[np.argsort(-lcp[edges], kind="stable")].tolist():
        at, a, b = int(lcp[i]), root(i - 1), root(i)
        grown = 0
        for c in (a, b):
            if depth[c] > at:
                out.append((low[c], high[c], at + 1, depth[c], kids[c], least[c]))
                grown += 1
            else:
                grown += kids[c]
        up[b] = a
        high[a], depth[a], kids[a], least[a] = high[b], at, grown, min(least[a], least[b])
    out += [(low[c], high[c], 0, depth[c], kids[c], least[c]) for c in range(n) if up[c] == c]
    return out


def forest(rows: pa.Table) -> pa.Table | None:
    """Nodes of one sorted partition. Rows carry ``deeper``: what the segments behind them hold."""
    n = rows.num_rows
    if not n:
        return None
    col = {c: rows.column(c).to_numpy() for c in ("segment", "k1", "k2", "n", "first", "ends", "after", "d_kids", "d_leaves", "d_held")}
    seqs = rows.column("seq").to_pylist()
    tree = np.concatenate(([0], np.cumsum((col["segment"][1:] != col["segment"][:-1]) | (col["k1"][1:] != col["k1"][:-1]) | (col["k2"][1:] != col["k2"][:-1]))))
    length = np.fromiter((len(s) // 16 for s in seqs), np.int64, n)
    flat = np.concatenate(([0], np.cumsum(rows.column("sizes").combine_chunks().flatten().to_numpy()))).astype(np.int64)
    start = np.cumsum(length) - length

    def upto(row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Bytes of a row's first ``depth`` turns of this segment."""
        return flat[start[row] + np.maximum(depth, 0)] - flat[start[row]]

    digests = np.frombuffer(b"".join(seqs), ">u8").astype(np.uint64).reshape(-1, 2)
    absolute = np.repeat(col["segment"] * SEGMENT, length) + np.arange(len(digests)) - np.repeat(start, length) + 1
    sums = prefix_sums(digests, absolute)

    def key(row: np.ndarray, depth: np.ndarray, k: int) -> np.ndarray:
        own = sums[start[row] + np.maximum(depth, 0), k] - sums[start[row], k]
        whole = (own + col[f"k{k + 1}"][row].view(np.uint64)).view(np.int64)
        return whole if k else np.where(depth <= 0, whole ^ _ROOT, whole)

    def path(row: int, depth: int) -> list[dict[str, int]]:
        rows, depths = np.full(depth + 1, row), np.arange(depth + 1)
        return [{"k1": a, "k2": b} for a, b in zip(key(rows, depths, 0).tolist(), key(rows, depths, 1).tolist())]

    lcp, every = common(seqs, tree), np.arange(n)
    # Depth shared with the last row, which all nodes of its spine are introduced above.
    with_last = np.minimum.accumulate(np.append(lcp[1:n], length[-1])[::-1])[::-1]
    shared = np.maximum(lcp[:n], with_last)
    shared[0] = length[0]
    new_bytes = np.concatenate(([0], np.cumsum(upto(every, length) - upto(every, shared) + col["d_held"])))
    is_leaf = (lcp[1 : n + 1] < length) & (col["n"] == col["ends"])
    on_spine = (with_last >= length) | (every == 0)
    leaves = np.concatenate(([0], np.cumsum((is_leaf & ~on_spine) + col["d_leaves"])))
    members = np.concatenate(([0], np.cumsum(col["n"])))
    weighed = np.concatenate(([0], np.cumsum(col["n"] * upto(every, length) + col["after"])))

    found = np.array(chains(lcp, length, col["first"]), dtype=np.int64).reshape(-1, 6)
    depths = found[:, 3] - found[:, 2] + 1
    lo, hi, top, bottom, kids, least = np.repeat(found, depths, axis=0).T
    depth = top + np.arange(len(top)) - np.repeat(np.cumsum(depths) - depths, depths)
    spine = (lo == 0) | (hi == n - 1)
    edge, end = upto(lo, depth - 1), depth == bottom
    held = new_bytes[hi + 1] - new_bytes[lo]
    complete = new_bytes[hi + 1] - new_bytes[lo + 1] + upto(lo, length[lo]) - edge + col["d_held"][lo]
    held = np.where(spine, held, complete)
    ends_here = end & (length[lo] == depth)
    # Children on a spine are counted after the spines have met.
    chain, over = np.repeat(np.arange(len(found)), depths), parents(found)
    touching = (found[:, 0] == 0) | (found[:, 1] == n - 1)
    spine_kids = np.bincount(over[touching & (over >= 0)], minlength=len(found))
    count = np.where(end, kids - np.where(spine, spine_kids[chain], 0), np.where(spine, 0, 1))
    count = count + np.where(ends_here & (depth == SEGMENT), col["d_kids"][lo], 0)
    top_of = np.maximum(over[chain], 0)
    parent = np.where(depth > top, least, found[top_of, 5])
    unknown = np.where(depth > top, spine, (over[chain] < 0) | touching[top_of])
    # Above the first turn of a later segment is a node that conversations may also end at.
    unknown |= (depth == 1) & (col["segment"][lo] > 0)
    above = [path(i, d) if s else None for i, d, s in zip(lo.tolist(), depth.tolist(), spine.tolist())]
    return pa.table({
        "spine": spine, "inner": (depth == 0) & (col["segment"][lo] > 0), "depth": col["segment"][lo] * SEGMENT + depth,
        "k1": key(lo, depth, 0), "k2": key(lo, depth, 1), "p1": key(lo, depth - 1, 0), "p2": key(lo, depth - 1, 1),
        "parent": pa.array(parent, mask=unknown), "conv_id": least, "n": members[hi + 1] - members[lo], "kids": count,
        "leaves": leaves[hi + 1] - leaves[lo], "total": weighed[hi + 1] - weighed[lo] - (members[hi + 1] - members[lo]) * edge, "held": held,
        "ends": np.where(ends_here, col["ends"][lo], 0), "size": upto(lo, depth) - edge,
        "above": pa.array(above, pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))),
    })


def parents(found: np.ndarray) -> np.ndarray:
    """The chain above each chain, -1 for roots: the closest around it that ends just above it."""
    out = np.full(len(found), -1, np.int64)
    stack: list[int] = []
    for i in np.lexsort((found[:, 2], -found[:, 1], found[:, 0])).tolist():
        while stack and found[stack[-1], 1] < found[i, 1]:
            stack.pop()
        if found[i, 2] > 0:
            out[i] = stack[-1]
        else:
            stack = []
        stack.append(i)
    return out


# ---- nodes, where spines meet ----------------------------------------------

_KEY, _UP = ["k1", "k2"], ["p1", "p2"]


def nodes_of(rows: DataFrame) -> DataFrame:
    """Complete nodes (inner, depth, k1, k2, parent, conv_id, n, kids, leaves, total, held, ends) of
    segments that carry what lies behind them as d_kids, d_leaves and d_held. Parents in segments that
    are not among ``rows`` stay null."""

    def run(batches):
        found = forest(pa.Table.from_batches(got)) if (got := [b for b in batches if b.num_rows]) else None
        if found is not None:
            yield from found.to_batches(10_000)

    place = ["segment", "k1", "k2", "seq"]
    columns = [*place, "sizes", "n", "first", "ends", "after", "d_kids", "d_leaves", "d_held"]
    nodes = scratch(rows.select(columns).repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(run, _NODE), "trie-parts")

    met = scratch(nodes.filter("spine").groupBy(_KEY).agg(
        *(F.first(c).alias(c) for c in ("inner", "depth", "p1", "p2", "size", "above")), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n", "kids", "leaves", "total", "held", "ends")),
    ), "spines")
    # The first entry of a path is the root of its tree, which has no node above it there.
    more = met.filter(F.size("above") > 1).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("_kids"))
    grown = met.join(more, _KEY, "left").withColumn("kids", F.col("kids") + F.coalesce("_kids", F.lit(0)))
    below = grown.select(F.explode("above").alias("x"), (F.col("n") == F.col("ends")).cast("bigint").alias("leaf"), "size").groupBy("x.k1", "x.k2").agg(
        F.sum("leaf").alias("_leaves"), F.sum("size").alias("_held")
    )
    whole = grown.join(below, _KEY).withColumns({
        "leaves": F.col("leaves") + F.col("_leaves"), "held": F.col("held") + F.col("_held"), "parent": F.lit(None).cast("bigint"),
    })
    columns = ["inner", "depth", *_KEY, *_UP, "parent", "conv_id", "n", "kids", "leaves", "total", "held", "ends"]
    out = nodes.filter("NOT spine").select(columns).unionByName(whole.select(columns))
    over = met.filter("NOT inner").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_parent")).unionByName(
        rows.filter("n > ends").select(F.col("e1").bitwiseXOR(F.lit(_ROOT)).alias("p1"), F.col("e2").alias("p2"), F.col("first").alias("_parent"))
    )
    known = out.filter("parent IS NOT NULL").drop(*_UP)
    sought = out.filter("parent IS NULL").join(over, _UP, "left").withColumn("parent", F.when(F.col("depth") > 0, F.col("_parent"))).drop(*_UP, "_parent")
    return known.unionByName(sought)


def behind(parts: DataFrame) -> DataFrame | None:
    """(e1, e2, d_kids, d_leaves, d_held): what the segments behind a segment's end hold altogether,
    None where every conversation fits in one segment."""
    later = parts.filter("segment > 0")
    if later.isEmpty():
        return None
    none = F.lit(0).cast("bigint")
    roots = nodes_of(later.withColumns({"d_kids": none, "d_leaves": none, "d_held": none})).filter("inner")
    # Sums over ever longer ways up: after round i a tree has what lies within 2 ** i segments.
    sums = scratch(roots.select(F.col("k1").bitwiseXOR(F.lit(_ROOT)).alias("k1"), "k2", "kids", "leaves", "held"), "below")
    goes_on = parts.filter("n > ends AND segment > 0")
    ways = scratch(goes_on.select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), F.col("k1").alias("u1"), F.col("k2").alias("u2")).distinct(), "ways")
    while not ways.isEmpty():
        gain = ways.join(sums, _KEY).groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.sum("leaves").alias("_leaves"), F.sum("held").alias("_held"))
        sums = scratch(sums.join(gain, _KEY, "left").select(
            *_KEY, "kids", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "held"))
        ), "below")
        next_ = ways.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("_1"), F.col("u2").alias("_2"))
        ways = scratch(ways.join(next_, ["u1", "u2"]).select(*_KEY, F.col("_1").alias("u1"), F.col("_2").alias("u2")), "ways")
    return sums.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("kids").alias("d_kids"), F.col("leaves").alias("d_leaves"), F.col("held").alias("d_held"))


def end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of every node that a conversation ends at. Ids of one node are written as
    pieces of text wherever they lie, and one task hashes a node's pieces in order as they stream by."""

    def pieces(batches):
        for b in batches:
            one, two, conv = (b.column(c).to_numpy() for c in ("e1", "e2", "conv_id"))
            if not len(conv):
                continue
            begin = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
            cuts = np.unique(np.concatenate([np.arange(x, y, PIECE // 16) for x, y in zip(begin, np.append(begin[1:], len(conv)))]))
            said = list(map(str, conv.tolist()))
            texts = [",".join(said[x:y]) for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(conv)])]
            yield pa.RecordBatch.from_pydict({"e1": pa.array(one[cuts]), "e2": pa.array(two[cuts]), "conv_id": pa.array(conv[cuts]), "ids": pa.array(texts)})

    def hashes(batches):
        last, sha = None, None
        for b in batches:
            out = []
            for one, two, text in zip(*(b.column(c).to_pylist() for c in ("e1", "e2", "ids"))):
                if (one, two) == last:
                    sha.update(b"," + text.encode())
                else:
                    if last is not None:
                        out.append((*last, sha.hexdigest()))
                    last, sha = (one, two), hashlib.sha256(text.encode())
            yield hashed(out)
        if last is not None:
            yield hashed([(*last, sha.hexdigest())])

    def hashed(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        one, two, text = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_pydict({"k1": pa.array(one, pa.int64()), "k2": pa.array(two, pa.int64()), "ends_sha256": pa.array(text, pa.string())})

    order = ["e1", "e2", "conv_id"]
    written = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "e1 bigint, e2 bigint, conv_id bigint, ids string")
    return written.repartition("e1", "e2").sortWithinPartitions(*order).mapInArrow(hashes, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    A conversation takes the first h turns of the conversation ``conv_id - conv_id % 5`` in place of its
    own first h, h being the CRC of its decimal id modulo 9. Null roles and texts are empty; turns are
    ordered with null first, those of one number by a hash of role and text; repeated rows are repeated
    turns. Rows without a conv_id belong to no conversation. An empty table gives no rows, not even a
    root. Other columns are ignored.
    """
    turns, sizes = rebuilt(numbered(conversations))
    sizes = scratch(sizes, "lengths")
    parts, ends = segments(cut(turns, sizes), sizes)
    deeper = behind(parts)
    sums = ("d_kids", "d_leaves", "d_held")
    if deeper is None:
        rows = parts.withColumns({c: F.lit(0).cast("bigint") for c in sums})
    else:
        goes_on = F.when(F.col("n") > F.col("ends"), True).otherwise(False)
        deep = parts.filter(goes_on).join(deeper, ["e1", "e2"])
        rows = deep.select(*parts.columns, *sums).unionByName(parts.filter(~goes_on).withColumns({c: F.lit(0).cast("bigint") for c in sums}))
    nodes = nodes_of(rows).filter("NOT inner").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("total") - F.col("held")).alias("saved_tokens"), "ends", *_KEY,
    )
    ended = nodes.filter("ends > 0").join(end_hashes(ends), _KEY, "left")
    open_ = nodes.filter("ends = 0").withColumn("ends_sha256", F.lit(_EMPTY))
    return ended.unionByName(open_, allowMissingColumns=True).drop("ends", *_KEY)
