"""Removal of repeated byte strings with a distributed, sampled suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.  Not every suffix is
sorted: an anchor is a position whose 64-byte gram has the least hash of some window of ``length`` bytes
around it, so equal windows have their anchor at the same place in them, whatever surrounds them.

1. Tasks find the anchors of their texts.  An anchor counts only if its gram occurs again; grams are counted
   across all documents, those that repeat within a batch are sent once.
2. The anchors that count take their surroundings with them: the bytes before, as many as a window can
   reach, and the suffix after.  Surroundings that a batch has more than once are settled there and sent once.
3. Surroundings with one gram meet in one partition.  Suffixes are put in order by deep-shallow sorting
   (Manzini and Ferragina, 2004): multikey quicksort to a shallow depth, that is three-way partition around a
   pivot, the equal part going on with the next eight bytes, then blind tries order the groups with long
   common prefixes.  The reversed left sides are ordered likewise.
   For each distance d that a window can start before its anchor, two anchors share that window if they agree on
   d bytes to the left and ``length - d`` to the right, which the common prefixes of neighbours tell.
4. All windows of an anchor hold it, so what it removes is one run, from the farthest start that repeats to
   the end of the nearest one.  A document's runs are united.

All comparisons are on the bytes; hashes only choose anchors and send equal grams to one place.  A partition
is read in the order of its grams and handled in portions of whole grams.  A gram with more than ``MOST``
different surroundings, such as the edge of a passage that very many documents hold, isn't gathered in one
task: its windows are grouped over all tasks, by a hash and their bytes, which gives the same runs.

Rules: a null text is empty; texts shorter than ``length`` lose nothing; texts of any length are read whole, in
blocks; rows that repeat, id included, are copies of each other and lose all their windows; equal suffixes are
ties, and what is removed doesn't depend on their order; an empty table gives an empty table; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm._bytes import BASE, BASE_INV, CODES, as_bytes, blocks, mix, powers, span_hash, sums
from barspark.llm._spark import cut, small_batches

LENGTH = 200
GRAM = 64
SHALLOW = 96
PORTION = 40_000
#: Different surroundings of one gram that a task holds at once; the windows of a gram with more are grouped over all tasks.
MOST = 120_000
PAD = 0xFF  # no byte of UTF-8
ANCHORS = "pk long, dk long, rk long, pos int, sure boolean"
SURROUNDINGS = "pk long, dk long, rk long, pos long, lo long, hi long, around binary"
RUNS = "dk long, rk long, lo long, hi long, d long, h long, window binary"


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width]."""
    done, out = 1, x
    while done * 2 <= width:
        out = op(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(buf: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors in a block of texts, each of which ends before the next start."""
    width = length - gram + 1
    if len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(buf) - gram + 1)
    h = span_hash(sums(buf, CODES), at, at + gram)
    least = _sliding(h, width, np.minimum)
    ends = np.append(starts[1:] - 1, len(buf))
    sizes = np.maximum(0, ends - starts - length + 1)
    valid = np.zeros(len(least) + 1, np.int32)
    np.add.at(valid, starts[sizes > 0], 1)
    np.add.at(valid, (starts + sizes)[sizes > 0], -1)
    least[np.cumsum(valid)[:-1] == 0] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    found = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
    return found, h[found]


def _find(length: int):
    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            docs, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dk", "rk"))
            rows, places, grams = [], [], []
            for first, last, buf, starts in blocks(texts):
                pos, h = anchors(buf, starts, length)
                row = np.searchsorted(starts, pos, side="right") - 1
                rows.append(row + first)
                places.append(pos - starts[row])
                grams.append(h)
            if not rows:
                continue
            row, pos, h = np.concatenate(rows), np.concatenate(places), np.concatenate(grams)
            _, first, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            sure = counts[inverse] > 1
            sent = np.zeros(len(h), bool)
            sent[first] = True
            # of a gram that this batch repeats, one anchor stands for all where grams are counted
            pk = np.where(sure & ~sent, mix(h ^ (keys[row].view(np.uint64) + pos.astype(np.uint64))), h)
            yield pa.RecordBatch.from_arrays([pa.array(pk.astype(np.int64)), pa.array(docs[row]), pa.array(keys[row]), pa.array(pos.astype(np.int32)), pa.array(sure)], names=["pk", "dk", "rk", "pos", "sure"])

    return run


def _united(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that overlap or touch become one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    head = np.ones(len(lo), bool)
    head[1:] = lo[1:] > hi[:-1]
    tail = np.append(head[1:], True)
    return lo[head], hi[tail]


def _surround(length: int, gram: int = GRAM):
    before = length - gram
    rng = np.random.default_rng(5)
    factors = rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def emit(pk, doc, rk, pos, lo, hi, around):
        arrays = [pa.array(np.asarray(x, np.int64)) for x in (pk, doc, rk, pos, lo, hi)]
        return pa.RecordBatch.from_arrays([*arrays, around], names=["pk", "dk", "rk", "pos", "lo", "hi", "around"])

    def portion(texts, docs, keys, lists):
        """lo and hi bound the distances at which a window before the anchor lies within its text; a settled run has no surroundings."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bases = np.concatenate([[0], np.cumsum(sizes + before + length)[:-1]])
        buf = np.frombuffer(b"".join(b"\xff" * before + t + b"\xff" * length for t in texts), np.uint8)
        row = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
        pos = np.concatenate(lists).astype(np.int64)
        width = before + length
        around = np.lib.stride_tricks.sliding_window_view(buf, width)[bases[row] + pos]
        words = np.zeros((len(pos), -(-width // 8) * 8), np.uint8)
        words[:, :width] = around
        words = words.view(np.uint64)
        h = mix((mix(words.ravel()).reshape(words.shape) * factors[np.arange(words.shape[1]) % 64]).sum(axis=1, dtype=np.uint64))
        lo, hi = np.maximum(0, length - (sizes[row] - pos)), np.minimum(before, pos)
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = (h[order[1:]] == h[order[:-1]]) & (words[order[1:]] == words[order[:-1]]).all(axis=1)
        group = np.cumsum(~same) - 1
        many = np.bincount(group)[group] > 1
        heads = order[~same]
        first = np.ascontiguousarray(words[heads]).view(np.uint8)[:, :width]
        raw = pa.array([x.tobytes() for x in first], pa.binary())
        gh = span_hash(sums(buf, CODES), bases[row[heads]] + pos[heads] + before, bases[row[heads]] + pos[heads] + before + gram)
        yield emit(gh.astype(np.int64), docs[row[heads]], keys[row[heads]], pos[heads], lo[heads], hi[heads], raw)
        settled = order[many]
        if len(settled):
            out = []
            settled = settled[np.lexsort((pos[settled], row[settled]))]
            for part in np.split(settled, np.flatnonzero(np.diff(row[settled])) + 1):
                a, b = _united(pos[part] - hi[part], pos[part] - lo[part] + length)
                i = row[part[0]]
                out.append((np.full(len(a), docs[i]), np.full(len(a), keys[i]), a, b))
            d, k, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            yield emit(mix(k.view(np.uint64) + np.uint64(1)).astype(np.int64), d, k, np.full(len(d), -1), a, b, pa.nulls(len(d), pa.binary()))

    def run(batches):
        for batch in batches:
            texts, lists = as_bytes(batch.column("text")), batch.column("places").to_pylist()
            docs, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dk", "rk"))
            first = 0
            while first < len(texts):
                last, n, size = first, 0, 0
                while last < len(texts) and (last == first or n + len(lists[last]) < 20_000 and size + len(texts[last]) < 8_000_000):
                    n += len(lists[last])
                    size += len(texts[last])
                    last += 1
                yield from portion(texts[first:last], docs[first:last], keys[first:last], lists[first:last])
                first = last

    return run


class _Node:
    __slots__ = ("depth", "children", "leaves")

    def __init__(self, depth: int, leaves: list[int] | None = None):
        self.depth, self.children, self.leaves = depth, {}, leaves


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    lo, hi = known, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def blind_trie_order(strings: list[bytes], known: int) -> list[int]:
    """Order of strings that share ``known`` bytes.

    The trie keeps only branching depths and bytes.  A string goes down by these alone to some leaf, is
    compared with it once, and branches off where the two part.
    """
    root = _Node(len(strings[0]), [0])
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node.leaves is None:
            node = node.children.get(s[node.depth]) or next(iter(node.children.values()))
        part = _common(s, strings[node.leaves[0]], known)
        if part == len(s):
            node.leaves.append(i)
            continue
        other, parent, node = strings[node.leaves[0]], None, root
        while node.leaves is None and node.depth < part:
            parent, node = node, node.children[s[node.depth]]
        leaf = _Node(len(s), [i])
        if node.leaves is None and node.depth == part:
            node.children[s[part]] = leaf
            continue
        fork = _Node(part)
        fork.children = {s[part]: leaf, other[part]: node}
        if parent is None:
            root = fork
        else:
            parent.children[s[parent.depth]] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.leaves is not None:
            out.extend(node.leaves)
        else:
            stack.extend(node.children[k] for k in sorted(node.children, reverse=True))
    return out


def multikey_quicksort(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their first ``depth`` words, and where in it a row begins that differs from the one before there.

    All segments that are not in order yet are partitioned at once, each around the median of three of its keys:
    the smaller and the greater part go on with the same word, the equal part with the next one.
    """
    n, rng = len(words), np.random.default_rng(3)
    order, head = np.arange(n), np.zeros(n, bool)
    head[:1] = True
    start, size, level = np.zeros(1, np.int64), np.full(1, n), np.zeros(1, np.int64)
    while True:
        live = (size > 1) & (level < depth)
        start, size, level = start[live], size[live], level[live]
        if not len(start):
            return order, head
        first = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(start)), size)
        rows = order[np.repeat(start - first, size) + np.arange(len(segment))]
        key = words[rows, level[segment]]
        picked = first[:, None] + (rng.random((len(start), 3)) * size[:, None]).astype(np.int64)
        pivot = np.sort(key[picked], axis=1)[segment, 1]
        part = np.where(key < pivot, 0, np.where(key == pivot, 1, 2))
        counts = np.bincount(segment * 3 + part, minlength=3 * len(start)).reshape(-1, 3)
        begin = start[:, None] + np.cumsum(counts, axis=1) - counts
        for k in range(3):
            mine = np.flatnonzero(part == k)
            earlier = np.cumsum(counts[:, k]) - counts[:, k]
            own = segment[mine]
            order[begin[own, k] + np.arange(len(mine)) - earlier[own]] = rows[mine]
        head[begin[counts > 0]] = True
        start, size, level = begin.ravel(), counts.ravel(), (level[:, None] + np.array([0, 1, 0])).ravel()


def deep_shallow_order(matrix: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of the rows, and how many bytes each row in it shares with the one before (0 for the first)."""
    n, width = matrix.shape
    full = np.zeros((n, -(-width // 8) * 8), np.uint8)
    full[:, :width] = matrix
    words = full.view(">u8").astype(np.uint64)
    order, head = multikey_quicksort(words, min(shallow // 8, words.shape[1]))
    if shallow < width:
        first = np.flatnonzero(head)
        last = np.append(first[1:], n)
        for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
            rows = order[a:b]
            strings = [matrix[i].tobytes() for i in rows]
            order[a:b] = rows[blind_trie_order(strings, min(shallow, width))]
    common = np.zeros(n, np.int64)
    for a in range(1, n, 20_000):
        b = min(n, a + 20_000)
        x, y = matrix[order[a - 1 : b - 1]], matrix[order[a:b]]
        differs = x != y
        common[a:b] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return order, common


def repeated_starts(around: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor the least and the greatest distance in [lo, hi] at which its window repeats; -1 if none does."""
    n, before = len(around), length - gram
    right_order, right_common = deep_shallow_order(around[:, before:])
    left_order, left_common = deep_shallow_order(np.ascontiguousarray(around[:, :before][:, ::-1]))
    least, most = np.full(n, -1), np.full(n, -1)
    rank = np.empty(n, np.int64)
    rank[left_order] = np.arange(n)
    left_rank = rank[right_order]  # rows stand in the order of their suffixes
    lo, hi = lo[right_order], hi[right_order]
    for d in range(before + 1):
        right = np.cumsum(right_common < length - d)
        left = np.cumsum(left_common < d)[left_rank] if d else np.zeros(n, np.int64)
        key = right * (n + 1) + left
        by = np.argsort(key, kind="stable")
        equal = key[by[1:]] == key[by[:-1]]
        again = np.zeros(n, bool)
        again[by[1:][equal]] = True
        again[by[:-1][equal]] = True
        again &= (lo <= d) & (d <= hi)
        rows = right_order[again]
        most[rows] = d
        least[rows] = np.where(least[rows] < 0, d, least[rows])
    return least, most


def window_hashes(around: np.ndarray, length: int, gram: int = GRAM) -> np.ndarray:
    """A hash of each row's windows, one column for each distance at which a window starts before the anchor."""
    n, before = len(around), length - gram
    at = before - np.arange(before + 1)
    cum = np.zeros((n, around.shape[1] + 1), np.uint64)
    np.cumsum(CODES[around] * powers(BASE_INV, around.shape[1]), axis=1, out=cum[:, 1:])
    return mix(((cum[:, at + length] - cum[:, at]) * powers(BASE, around.shape[1] + 1)[at]).ravel()).reshape(n, -1)


def _settle(length: int, portion: int, most: int, gram: int = GRAM):
    """Runs of removed bytes; for a gram with very many different surroundings, its windows instead (lo and hi both the anchor's place)."""
    names = ["dk", "rk", "lo", "hi", "d", "h", "window"]
    types = [*[pa.int64()] * 6, pa.binary()]

    def columns(table: pa.Table):
        raw = table.column("around").combine_chunks()
        around = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, 2 * length - gram)
        return around, *(table.column(c).to_numpy() for c in ("dk", "rk", "pos", "lo", "hi"))

    def batch_of(*arrays):
        rest = [pa.nulls(len(arrays[0]), t) for t in types[len(arrays) :]]
        return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(arrays, types, strict=False)), *rest], names=names)

    def runs(table: pa.Table):
        around, dk, rk, pos, lo, hi = columns(table)
        nearest, farthest = repeated_starts(around, lo, hi, length)
        keep = farthest >= 0
        return batch_of(*(x[keep] for x in (dk, rk, pos - farthest, pos - nearest + length)))

    def windows(table: pa.Table):
        for k in range(0, table.num_rows, 500):
            around, dk, rk, pos, lo, hi = columns(table.slice(k, 500))
            h, before = window_hashes(around, length), length - gram
            row, d = np.nonzero((np.arange(h.shape[1]) >= lo[:, None]) & (np.arange(h.shape[1]) <= hi[:, None]))
            raw = [around[i].tobytes() for i in range(len(around))]
            yield batch_of(dk[row], rk[row], pos[row], pos[row], d, h[row, d].astype(np.int64), [raw[i][before - x : before - x + length] for i, x in zip(row.tolist(), d.tolist(), strict=True)])

    def run(batches):
        held: list[pa.RecordBatch] = []
        large = None  # a gram that turned out to have more than ``most`` surroundings
        for batch in batches:
            settled = batch.filter(pa.compute.is_null(batch.column("around")))
            if settled.num_rows:
                yield batch_of(*(settled.column(c) for c in ("dk", "rk", "lo", "hi")))
            rest = batch.filter(pa.compute.is_valid(batch.column("around")))
            if large is not None and rest.num_rows:
                more = int(np.searchsorted(rest.column("pk").to_numpy(), large, side="right"))
                yield from windows(pa.Table.from_batches([rest.slice(0, more)]))
                rest = rest.slice(more)
                large = large if not rest.num_rows else None
            if not rest.num_rows:
                continue
            held.append(rest)
            if sum(x.num_rows for x in held) >= portion:
                table = pa.Table.from_batches(held)
                pk = table.column("pk").to_numpy()
                whole = int(np.searchsorted(pk, pk[-1]))  # the last gram may go on in the next batch
                if whole:
                    yield runs(table.slice(0, whole))
                table = table.slice(whole)
                held = table.to_batches()
                if table.num_rows > most:
                    yield from windows(table)
                    held, large = [], int(pk[-1])
        if held:
            yield runs(pa.Table.from_batches(held))

    return run


def _finish(texts_out: bool):
    def run(batches):
        for batch in batches:
            texts, lists = as_bytes(batch.column("text")), batch.column("runs").to_pylist()
            n, removed, spans, digests, kept_texts, kept_runs = [], [], [], [], [], []
            for text, runs in zip(texts, lists, strict=True):
                bounds = np.array([(r["lo"], r["hi"]) for r in runs or []], np.int64).reshape(-1, 2)
                a, b = _united(bounds[:, 0], bounds[:, 1]) if len(bounds) else (bounds[:, 0], bounds[:, 1])
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                n.append(len(text))
                removed.append(len(text) - len(kept))
                spans.append(len(a))
                digests.append(hashlib.sha256(kept).hexdigest())
                if texts_out:
                    kept_texts.append(kept)
                    kept_runs.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts_out:
                columns += [pa.array(kept_texts, pa.binary()), pa.array(kept_runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "removed_runs"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts_out: bool = True, key: str = "doc_id", text: str = "text", portion: int = PORTION, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with texts_out also kept (the remaining bytes) and removed_runs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # dk and rk name a row: its id, with a stand-in for null, and a hash of its text
    rows = rows.withColumn("dk", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("rk", F.xxhash64("text"))
    found = rows.mapInArrow(_find(length), ANCHORS)
    again = found.withColumn("n", F.count("*").over(Window.partitionBy("pk"))).filter(F.col("sure") | (F.col("n") > 1))
    places = cut(again.groupBy("dk", "rk").agg(F.collect_set("pos").alias("places")))

    joined = rows.join(places, ["dk", "rk"]).select("dk", "rk", "text", "places")
    around = joined.mapInArrow(_surround(length), SURROUNDINGS)
    settled = cut(around.repartition("pk").sortWithinPartitions("pk").mapInArrow(_settle(length, portion, most), RUNS))
    runs = settled.filter("d is null").select("dk", "rk", "lo", "hi")
    windows = settled.filter("d is not null")
    if not windows.isEmpty():
        again = windows.groupBy("h", "window").agg(F.count("*").alias("n")).filter("n > 1").select("h", "window")
        bounds = windows.join(again, ["h", "window"]).groupBy("dk", "rk", F.col("lo").alias("pos")).agg(F.min("d").alias("a"), F.max("d").alias("b"))
        runs = runs.unionByName(bounds.select("dk", "rk", (F.col("pos") - F.col("b")).alias("lo"), (F.col("pos") - F.col("a") + length).alias("hi")))
    runs = runs.groupBy("dk", "rk").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    out = rows.join(runs, ["dk", "rk"], "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return out.mapInArrow(_finish(texts_out), schema + (", kept binary, removed_runs array<struct<start:long,end:long>>" if texts_out else ""))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts_out=False)
