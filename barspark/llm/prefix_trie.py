"""Conversation prefix trie in flat node tables addressed by minimal perfect hashes.

A node is a distinct run of first turns.  Its key is 128 bits: the exclusive or of a hash of each turn's SHA-256 digest
bound to its position, so that keys of a long conversation's blocks can be joined.  Rows (conversation, depth) are dealt
to shards of some ``SHARD_ROWS`` by family of conversations and, in steps of ``DEPTH_BLOCK`` turns, by depth: a
conversation is in one shard a block, and what a shard holds is bounded however the rows are spread.

A shard enumerates its distinct keys, builds a minimal perfect hash over them (levels of bit arrays in which a key that
meets no other takes its place), and checks that the key in a slot, the turn's digest, the parent's key and the depth
are those of every row that got it; two prefixes with one key end the job, in a shard or between shards.  Counts are
scattered into flat arrays by slot.  Shards' tables are summed by key to one node table.  Each node then gives its
weight (its saved bytes, and one if it has no child) at the shard of its smallest member, where weights go up through
the array of parents' slots from the deepest level to the first; partial sums of all shards are summed by key.  Blocks
of depth are taken from the deepest up, a block's first turns handing theirs to their parents in the block before.

No text is dealt: a turn is its digest and its length.  Conversations are numbered over a range sort, each task counting
from nought and the offsets coming from the tasks' counts, so one conversation may lie in many tasks; the list of
members that end at a node is hashed from sorted pieces, so a list is never held as one string.

Rules: rows without a conv_id belong to no conversation; turns stand by turn (null first), then role, then the digest
of role and text; repeated rows are turns of their own; a null role or text is empty; ``c - c % 5`` takes the sign of c
as SQL does; texts of any length count by their bytes; an empty table has no node; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm._bytes import mix
from barspark.llm._spark import cut, shuffle_partitions, small_batches, table

SHARD_ROWS = 100_000
DEPTH_BLOCK = 65_536
PIECE = 1 << 16
MOST_BORROWED = 8
LOCAL = "kind int, block long, shard long, x1 long, x2 long, p1 long, p2 long, t0 long, t1 long, t2 long, t3 long, depth long, n_bytes long, n long, conv_id long"
SUMS = "kind int, x1 long, x2 long, saved long, leaves long, conv_id long"


class Slots:
    """A minimal perfect hash over distinct 128-bit keys: each gets a slot from 0 to n - 1, any other none."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = keys, 0
        while len(left):
            size = max(64, 2 * len(left))
            at = self._at(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, base + np.cumsum(alone) - 1))
            placed = alone[at]
            base += int(placed.sum())
            left = left[~placed]
        self.keys = np.empty_like(keys)
        self.keys[self._find(keys)] = keys

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = mix(keys[:, 0] + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)) ^ keys[:, 1]
            return (mix(h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._at(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 of one that isn't in the table; a slot's own key is compared."""
        found = self._find(keys)
        known = found >= 0
        known[known] = (self.keys[found[known]] == keys[known]).all(axis=1)
        return np.where(known, found, -1)


def distinct(keys: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    return ordered[new]


def _longs(batch: pa.Table, *names: str) -> list[np.ndarray]:
    return [batch.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _keys(batch: pa.Table, a: str, b: str) -> np.ndarray:
    return np.stack(_longs(batch, a, b), axis=1).view(np.uint64)


def _node_table(group: pa.Table) -> pa.Table:
    """A shard's rows (conversation by depth) to its node table and to the nodes where conversations end."""
    conv, depth, n_bytes = _longs(group, "conv_id", "depth", "n_bytes")
    order = np.lexsort((depth, conv))
    conv, depth, n_bytes = conv[order], depth[order], n_bytes[order]
    steps, carry = (_keys(group, *c)[order] for c in (("h1", "h2"), ("k1", "k2")))
    turn = np.frombuffer(b"".join(group.column("digest").to_pylist()), np.int64).reshape(-1, 4)[order]
    ends = group.column("is_end").to_numpy(zero_copy_only=False)[order]
    running = np.bitwise_xor.accumulate(steps, axis=0)
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    before = np.vstack([np.zeros((1, 2), np.uint64), running])[first]
    at = np.cumsum(np.r_[True, conv[1:] != conv[:-1]]) - 1
    key = running ^ before[at] ^ carry
    parent = key ^ steps
    slots = Slots(distinct(key))
    slot = slots(key)
    one = np.empty(len(slots.keys), np.int64)
    one[slot] = np.arange(len(slot))
    what = np.column_stack([turn, parent.view(np.int64), depth, n_bytes])
    if (slot < 0).any() or (what != what[one][slot]).any():
        raise RuntimeError("two different prefixes have one key")
    n = np.bincount(slot, minlength=len(one))
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv)
    block, shard = (group.column(c)[0].as_py() for c in ("block", "shard"))
    rows = {"kind": 0, "block": block, "shard": shard, "x1": slots.keys[:, 0].view(np.int64), "x2": slots.keys[:, 1].view(np.int64), "n": n, "conv_id": least}
    rows |= {c: what[one, i] for i, c in enumerate(("t0", "t1", "t2", "t3", "p1", "p2", "depth", "n_bytes"))}
    last = np.flatnonzero(ends)
    tail = {"kind": 1, "block": block, "shard": shard, "x1": key[last, 0].view(np.int64), "x2": key[last, 1].view(np.int64), "conv_id": conv[last]}
    return pa.concat_tables([_table(LOCAL, rows, len(one)), _table(LOCAL, tail, len(last))])


def _table(schema: str, values: dict, n: int) -> pa.Table:
    columns = {}
    for name, kind in (x.split() for x in schema.split(", ")):
        type_ = pa.int32() if kind == "int" else pa.int64()
        x = values.get(name)
        columns[name] = pa.nulls(n, type_) if x is None else pa.array(np.full(n, x) if np.isscalar(x) else x, type_)
    return pa.table(columns)


def _gathered(group: pa.Table) -> pa.Table:
    """A shard's nodes (kind 0) and weights (kind 1) to sums over subtrees, and to what its first depth hands to the block before (kind 1)."""
    kind = group.column("kind").to_numpy(zero_copy_only=False)
    nodes, given = group.filter(pa.array(kind == 0)), group.filter(pa.array(kind == 1))
    if not nodes.num_rows:
        raise RuntimeError("a weight stands at no node")
    slots = Slots(_keys(nodes, "x1", "x2"))
    depth, conv = np.empty(len(slots.keys), np.int64), np.empty(len(slots.keys), np.int64)
    own = slots(_keys(nodes, "x1", "x2"))
    depth[own], conv[own] = _longs(nodes, "depth", "conv_id")
    above = np.empty_like(slots.keys)
    above[own] = _keys(nodes, "p1", "p2")
    parent = np.where(depth > 0, slots(above), -1)
    at = slots(_keys(given, "x1", "x2"))
    if (at < 0).any():
        raise RuntimeError("a weight stands at no node")
    totals = np.zeros((len(slots.keys), 2), np.int64)
    np.add.at(totals, at, np.stack(_longs(given, "saved", "leaves"), axis=1))
    order = np.argsort(depth, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(depth[order]) != 0, True])
    for a, b in zip(bounds[-2::-1], bounds[:0:-1], strict=True):
        level = order[a:b]
        level = level[parent[level] >= 0]
        np.add.at(totals, parent[level], totals[level])
    some = np.flatnonzero(totals.any(axis=1))
    out = _table(SUMS, {"kind": 0, "x1": slots.keys[some, 0].view(np.int64), "x2": slots.keys[some, 1].view(np.int64), "saved": totals[some, 0], "leaves": totals[some, 1]}, len(some))
    up = some[(parent[some] < 0) & (depth[some] > 0)]
    handed = _table(SUMS, {"kind": 1, "x1": above[up, 0].view(np.int64), "x2": above[up, 1].view(np.int64), "saved": totals[up, 0], "leaves": totals[up, 1], "conv_id": conv[up]}, len(up))
    return pa.concat_tables([out, handed])


# ---- turns


def turns_in_order(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, i, digest, n_bytes) of every turn, i from 0 in a conversation."""
    spark = conversations.sparkSession
    small_batches(spark)
    rows = conversations.select(F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x")).filter("conv_id is not null")
    whole = F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "x")
    rows = rows.select("conv_id", "t", "r", F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length("x").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("any"))
    order = ["conv_id", F.asc_nulls_first("t"), "r", "digest", "any"]

    def counted(batches):
        part, now, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
            new = np.r_[True, conv[1:] != conv[:-1]] if len(conv) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            k = np.arange(len(conv)) - np.repeat(start, np.diff(np.r_[start, len(conv)]))
            if len(conv):
                if conv[0] == now:
                    same = int(start[1]) if len(start) > 1 else len(conv)
                    k[:same] += n
                now, n = conv[-1], int(k[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(len(conv), part), pa.int64()), pa.array(k, pa.int64()), batch.column("digest"), batch.column("n_bytes")], names=["conv_id", "part", "k", "digest", "n_bytes"])

    ordered = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    held = cut(ordered.mapInArrow(counted, "conv_id long, part long, k long, digest binary, n_bytes long"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only a task's first conversation can have begun in an earlier task: a row a task at most
    offsets = held.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", before).filter("before > 0").drop("n")
    return held.join(F.broadcast(offsets), ["conv_id", "part"], "left").select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("i"), "digest", "n_bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, n_bytes, is_end): depth 0, and every turn of the conversations that borrow their first h turns from the first one of their family of five."""
    each = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    base, h = F.col("conv_id") - F.col("conv_id") % 5, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_BORROWED + 1)).alias("h")
    named = each.select("conv_id", "n", base.alias("base"), h)
    named = named.join(each.select(F.col("conv_id").alias("base"), F.col("n").alias("nb")), "base", "left")
    lent = F.least("h", F.coalesce("nb", F.lit(0)))
    named = named.withColumn("lent", lent).withColumn("depths", F.when(F.col("base") == F.col("conv_id"), F.col("n")).otherwise(F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    own = turns.join(named, "conv_id").filter("base = conv_id or i >= h").withColumn("depth", F.when(F.col("base") == F.col("conv_id"), F.col("i") + 1).otherwise(F.col("i") - F.col("h") + F.col("lent") + 1))
    first = turns.filter(F.col("i") < MOST_BORROWED).withColumnRenamed("conv_id", "base").join(named.filter("base <> conv_id"), "base").filter("i < h").withColumn("depth", F.col("i") + 1)
    root = named.withColumn("depth", F.lit(0).cast("long")).withColumn("digest", F.unhex(F.lit("00" * 32))).withColumn("n_bytes", F.lit(0).cast("long"))
    columns = ["conv_id", "depth", "digest", "n_bytes", (F.col("depth") == F.col("depths")).alias("is_end")]
    return own.select(*columns).unionByName(first.select(*columns)).unionByName(root.select(*columns))


# ---- the trie


def _hash_of_ends(ends: DataFrame) -> DataFrame:
    """(x1, x2, ends_sha256): the hash of the ascending ids that end at a node, from pieces that sorted tasks write."""
    spark = ends.sparkSession

    def pieces(batches):
        now, held, first, rows = None, [], 0, []
        size = 0
        for batch in batches:
            for x1, x2, c in zip(*(batch.column(n).to_pylist() for n in ("x1", "x2", "conv_id")), strict=True):
                if (x1, x2) != now or size >= PIECE:
                    if held:
                        rows.append((*now, first, ",".join(held)))
                    now, held, first, size = (x1, x2), [], c, 0
                held.append(str(c))
                size += len(held[-1]) + 1
            yield _rows(rows, ("x1", "x2", "first"), "piece")
            rows = []
        yield _rows([(*now, first, ",".join(held))] if held else [], ("x1", "x2", "first"), "piece")

    def hashed(batches):
        now, made, rows = None, None, []
        for batch in batches:
            for x1, x2, piece in zip(*(batch.column(n).to_pylist() for n in ("x1", "x2", "piece")), strict=True):
                if (x1, x2) == now:
                    made.update(b"," + piece.encode())
                    continue
                if now:
                    rows.append((*now, made.hexdigest()))
                now, made = (x1, x2), hashlib.sha256(piece.encode())
            yield _rows(rows, ("x1", "x2"), "ends_sha256")
            rows = []
        yield _rows([(*now, made.hexdigest())] if now else [], ("x1", "x2"), "ends_sha256")

    n, by = shuffle_partitions(spark), ("x1", "x2", "conv_id")
    written = ends.select(*by).repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(pieces, "x1 long, x2 long, first long, piece string")
    return written.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "first").mapInArrow(hashed, "x1 long, x2 long, ends_sha256 string")


def _rows(rows: list[tuple], longs: tuple[str, ...], text: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(longs) + 1)
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.string() if i == len(longs) else pa.int64()) for i, x in enumerate(columns)], names=[*longs, text])


def trie(sequences: DataFrame, shard_rows: int = SHARD_ROWS, depth_block: int = DEPTH_BLOCK) -> DataFrame:
    """The nodes of the prefix trie of sequences (as ``rebuilt`` gives them): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = sequences.withColumn("block", F.floor(F.col("depth") / depth_block).cast("long"))
    bound = F.col("depth") > 0
    rows = rows.withColumn("h1", F.when(bound, F.xxhash64("digest", "depth")).otherwise(F.lit(0))).withColumn("h2", F.when(bound, F.xxhash64("depth", "digest", F.lit(1))).otherwise(F.lit(0)))
    size = rows.agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).first()
    shards, blocks = max(1, -(-size["n"] // shard_rows)), (size["deepest"] or 0) // depth_block + 1
    shard_of = lambda c, block: F.pmod(F.xxhash64(c - c % 5, block), F.lit(shards))
    if blocks > 1:
        earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carry = rows.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("k1"), F.bit_xor("h2").alias("k2"))
        carry = carry.withColumn("k1", F.bit_xor("k1").over(earlier)).withColumn("k2", F.bit_xor("k2").over(earlier)).filter("block > 0")
        rows = rows.join(carry, ["conv_id", "block"], "left")
    else:
        rows = rows.withColumn("k1", F.lit(0).cast("long")).withColumn("k2", F.lit(0).cast("long"))
    rows = rows.withColumn("shard", shard_of(F.col("conv_id"), F.col("block")))
    local = cut(rows.groupBy("block", "shard").applyInArrow(_node_table, LOCAL))

    tables, same = local.filter("kind = 0"), ["p1", "p2", "t0", "t1", "t2", "t3", "depth", "n_bytes"]
    nodes = tables.groupBy("x1", "x2").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *(f(c).alias(f"{c}_{f.__name__}") for c in same for f in (F.min, F.max)))
    differ = F.lit(False)
    for c in same:
        differ = differ | (F.col(f"{c}_min") != F.col(f"{c}_max"))
    checked = F.when(differ, F.raise_error(F.lit("two different prefixes have one key"))).otherwise(F.col("depth_min")).cast("long")
    nodes = nodes.select("x1", "x2", F.col("p1_min").alias("p1"), F.col("p2_min").alias("p2"), checked.alias("depth"), F.col("n_bytes_min").alias("n_bytes"), "n_convs", "conv_id")
    kids = nodes.filter("depth > 0").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(kids, ["x1", "x2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    weights = nodes.select(F.floor(F.col("depth") / depth_block).cast("long").alias("block"), "conv_id", "x1", "x2", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    parts, handed = [], None
    for block in range(blocks - 1, -1, -1):
        given = weights.filter(F.col("block") == block)
        if handed is not None:
            given = given.unionByName(handed.withColumn("block", F.lit(block).cast("long")))
        given = given.filter("saved <> 0 or leaves <> 0").withColumn("shard", shard_of(F.col("conv_id"), F.col("block"))).withColumn("kind", F.lit(1))
        both = tables.filter(F.col("block") == block).select("kind", "shard", "x1", "x2", "p1", "p2", "depth", "conv_id").unionByName(given.drop("block"), allowMissingColumns=True)
        sums = cut(both.groupBy("shard").applyInArrow(_gathered, SUMS))
        parts.append(sums.filter("kind = 0"))
        handed = sums.filter("kind = 1").select("conv_id", "x1", "x2", "saved", "leaves")
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    total = total.groupBy("x1", "x2").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    above = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = _hash_of_ends(local.filter("kind = 1"))
    out = nodes.withColumn("p1", F.when(F.col("depth") > 0, F.col("p1"))).join(above, ["p1", "p2"], "left").join(total, ["x1", "x2"], "left").join(ends, ["x1", "x2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(cut(rebuilt(turns_in_order(table(spark, sf_dir, "conversations")))))


CRC_SQL = "list_reduce(flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ord(substr(s, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295)"

ORACLE = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, r, sha256(strlen(r) || ':' || r || t)) AS xs FROM o GROUP BY 1),
c AS (SELECT conv_id, xs, conv_id - conv_id % 5 AS b, CAST(xor({CRC_SQL}, 4294967295) % 9 AS BIGINT) AS h
      FROM (SELECT *, CAST(conv_id AS VARCHAR) AS s FROM l)),
r AS (SELECT c.conv_id, list_concat(coalesce(list_slice(l.xs, 1, h), []), list_slice(c.xs, h + 1, len(c.xs))) AS xs FROM c LEFT JOIN l ON l.conv_id = c.b),
p AS (SELECT conv_id, d, list_slice(xs, 1, d) AS k, d = len(xs) AS is_end, CASE WHEN d > 0 THEN strlen(xs[d]['t']) ELSE 0 END AS bytes
      FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256 FROM p GROUP BY ALL),
kids AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
up AS (SELECT list_slice(k, 1, a) AS k, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
       FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN up USING (k) LEFT JOIN n q ON f.d > 0 AND q.k = list_slice(f.k, 1, f.d - 1)
"""
