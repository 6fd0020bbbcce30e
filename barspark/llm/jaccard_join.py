"""N-gram Jaccard join by grouped prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles.  Two documents link when
``100 * |intersection| >= threshold * |union|``.  The steps:

1. Documents with the same set fall into one class (an aggregation by a 128-bit hash of the set).
2. Shingles are ordered by rarity: those that tasks see often come last, most frequent at the very end,
   all others by hash.  Any order is right; this one keeps common passages out of the prefixes.
3. Linked sets share a shingle among the first ``n - ceil(t * n) + 1`` of each.  Classes with the same
   size and prefix form one group, so a posting list holds groups.
4. A group's members are verified against its head; those that don't link leave it.
5. Group pairs come from the posting lists, in two steps, so that a large group of near copies costs no
   more than its posting rows: first each group with its neighbour in a random order of the list and with the
   group that has the fewest rarer shingles; then,
   of each list, the groups outside the list's largest component so far against all groups of other
   components.  Pairs inside one component need no check.
   Which groups of a list may meet is decided on its cells first (size, position, shingles left), of which there are
   few however many groups a list holds; only cells that pass meet, in blocks of ``PAIR_BLOCK`` groups a side.
6. Group pairs pass a size filter, a position filter and a bound on what they share given their common
   prefix shingles, are expanded to their members, and are verified on whole sets.

Rules: texts without words have an empty set and link with nothing; texts with fewer words than a
shingle have one shingle, the whole sequence; texts of any length count whole; null text is empty; ids repeat no
more than their rows do (rows with one id and different texts are one node); a pair at the threshold links;
shingles of equal rarity are ordered by hash; an empty table gives an empty table; further columns are ignored,
whatever their names.  In ``keep_one`` every row is a node of its own, whatever its id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm._bytes import SPACED, as_bytes, blocks, mix, ngram_hash, word_block
from barspark.llm._graph import components
from barspark.llm._spark import cut, small_batches, text_rows

#: A task reports a shingle that this many of its documents hold.
LOCAL_HEAVY = 2
#: Shingles whose counts are sent to all tasks: 16 bytes each, so 6.4 MB at most. It bounds the order's detail, not the result.
HEAVY_ROWS = 400_000
#: Shingle hashes that a task gathers before it reports their counts.
HEAVY_CHUNK = 4_000_000
#: Groups of a cell that stand in one block: a task compares so many by so many at once.
PAIR_BLOCK = 2000


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, last, buf, starts in blocks(texts):
        h, doc, _, _ = word_block(buf, starts, SPACED)
        grams = ngram_hash(h, words)
        inside = doc[: len(grams)] == doc[words - 1 :] if len(grams) else np.zeros(0, bool)
        grams, at = grams[inside], doc[: len(grams)][inside]
        cuts = np.searchsorted(at, np.arange(last - first + 1))
        ends = np.searchsorted(doc, np.arange(last - first + 1))
        for i in range(last - first):
            if cuts[i] < cuts[i + 1]:
                yield np.unique(grams[cuts[i] : cuts[i + 1]])
            elif ends[i] < ends[i + 1]:
                yield ngram_hash(h[ends[i] : ends[i + 1]], int(ends[i + 1] - ends[i]))
            else:
                yield np.zeros(0, np.uint64)


def _set_hash(values: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(values.copy()).sum(dtype=np.uint64), mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _scan(words: int):
    """Per document its size and set hash (kind 0); per shingle that many documents of a task hold, a count (kind 1)."""

    def run(batches):
        pending, size = [], 0

        def heavy():
            values, counts = np.unique(np.concatenate(pending), return_counts=True)
            keep = counts >= LOCAL_HEAVY
            values, counts = values[keep].astype(np.int64), counts[keep].astype(np.int64)
            zero = np.zeros(len(values), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(zero + 1), pa.array(values), pa.array(counts), pa.array(zero), pa.array(zero)], names=["kind", "id", "n", "h1", "h2"])

        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for values in shingle_sets(as_bytes(batch.column("text")), words):
                rows.append((len(values), *_set_hash(values)))
                if len(values):
                    pending.append(values)
                    size += len(values)
                if size >= HEAVY_CHUNK:
                    yield heavy()
                    pending, size = [], 0
            n, h1, h2 = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True)) if rows else (pa.array([], pa.int64()),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int64)), ids, n, h1, h2], names=["kind", "id", "n", "h1", "h2"])
        if pending:
            yield heavy()

    return run


def prefix_length(n: np.ndarray | int, threshold: int):
    return n - -(-n * threshold // 100) + 1


def _prefixes(words: int, threshold: int, heavy: np.ndarray, counts: np.ndarray):
    """Posting rows: shingle, id, set size, position in the prefix, hash of the prefix, and where its last shingle stands in the order."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            out = [[], [], [], [], [], [], []]
            for doc, values in zip(ids, shingle_sets(as_bytes(batch.column("text")), words), strict=True):
                n = len(values)
                if not n:
                    continue
                p = prefix_length(n, threshold)
                often = np.zeros(n, np.int64)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, values), len(heavy) - 1)
                    often = np.where(heavy[at] == values, counts[at], 0)
                    order = np.lexsort((values, often))
                    values, often = values[order], often[order]
                prefix = values[:p]
                last = int((prefix[-1] ^ np.uint64(1 << 63)).astype(np.int64))
                same = np.full(p, _set_hash(prefix)[0], np.int64)
                for column, x in zip(out, (prefix.astype(np.int64), np.full(p, doc), np.full(p, n), np.arange(p), same, np.full(p, often[p - 1]), np.full(p, last)), strict=True):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["token", "id", "n", "pos", "same", "last_c", "last_h"])

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            values = [x.astype(np.int64) for x in shingle_sets(as_bytes(batch.column("text")), words)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "shingles"])

    return run


def _overlaps(threshold: int):
    """Keeps the pairs whose sets link."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            av, bv, ao, bo = (x.to_numpy(zero_copy_only=False) for x in (a.values, b.values, a.offsets, b.offsets))
            keep = []
            for i in range(batch.num_rows):
                x, y = av[ao[i] : ao[i + 1]].view(np.uint64), bv[bo[i] : bo[i + 1]].view(np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(bool(common) and 100 * common >= threshold * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows whose count reaches the least power of 2 ** (1 / 8) that at most ``most`` rows reach."""
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in counted.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for at, n in sizes:
        total += n
        if total > most:
            break
        least = at
    return counted.filter(level >= least) if least is not None else counted.limit(0)


def _cell_pairs(ranked: DataFrame, threshold: int, block: int = PAIR_BLOCK) -> DataFrame:
    """Groups outside their list's largest component (g, theirs, g_label) against the others of the list (gid, own, label, top) whose cells may hold a pair that links.

    A cell is what the bounds of a posting depend on but for where a prefix ends; for that the larger of two sizes' rests is
    taken, so a cell pair that is left out holds no pair that could pass.
    """
    cell = ("n", "pos", "left")
    # a little more than the size ratio that still links, so that such sizes' scales differ by one at most
    step = math.log(100 / threshold) * (1 + 1e-9) if threshold < 100 else 1e-9
    rows = ranked.select("*", F.col("own.n").alias("n"), F.col("own.pos").alias("pos"), (F.col("own.again") - F.col("own.nth")).alias("left"))
    cells = rows.groupBy("token", *cell).agg(F.count("*").alias("c"), F.count_if(F.col("label") != F.col("top")).alias("m"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    cells = cut(cells.select("token", *cell, blocks("c").alias("cb"), blocks("m").alias("mb"), F.floor(F.log("n") / step).alias("scale")))
    x = cells.filter("mb > 0").select("token", *(F.col(c).alias(f"{c}_x") for c in cell), F.col("mb").alias("mb_x"), F.explode(F.array(F.col("scale") - 1, F.col("scale"), F.col("scale") + 1)).alias("scale"))
    y = cells.select("token", *(F.col(c).alias(f"{c}_y") for c in cell), F.col("cb").alias("cb_y"), "scale")
    nx, ny = F.col("n_x"), F.col("n_y")
    enough = threshold * (nx + ny)
    rest = F.ceil(F.greatest(nx, ny) * threshold / 100) - 1
    fits = (100 * F.least(nx, ny) >= threshold * F.greatest(nx, ny)) & ((100 + threshold) * F.least(nx - F.col("pos_x"), ny - F.col("pos_y")) >= enough) & ((100 + threshold) * (F.least("left_x", "left_y") + rest) >= enough)
    met = cut(x.join(y, ["token", "scale"]).filter(fits).drop("scale").distinct())
    met = met.withColumn("b_x", F.explode(F.sequence(F.lit(0), F.col("mb_x") - 1))).withColumn("b_y", F.explode(F.sequence(F.lit(0), F.col("cb_y") - 1))).drop("mb_x", "cb_y")
    dealt = rows.join(cells.drop("scale"), ["token", *cell])
    nth = F.xxhash64("gid", "token")
    minor = dealt.filter("label <> top").select("token", *(F.col(c).alias(f"{c}_x") for c in cell), F.pmod(nth, F.col("mb")).cast("int").alias("b_x"), F.col("gid").alias("g"), F.col("own").alias("theirs"), F.col("label").alias("g_label"))
    other = dealt.select("token", *(F.col(c).alias(f"{c}_y") for c in cell), F.pmod(nth, F.col("cb")).cast("int").alias("b_y"), "gid", "own", "label", "top")
    return minor.join(met, ["token", *(f"{c}_x" for c in cell), "b_x"]).join(other, ["token", *(f"{c}_y" for c in cell), "b_y"])


def jaccard_classes(docs: DataFrame, words: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row; see the module for the rules."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = text_rows(docs, key, text)
    scanned = cut(rows.mapInArrow(_scan(words), "kind long, id long, n long, h1 long, h2 long"))
    sized = scanned.filter("kind = 0").drop("kind")
    classes = cut(sized.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("class_id")))

    counted = scanned.filter("kind = 1").groupBy(F.col("id").alias("token")).agg(F.sum("n").alias("c"))
    often = _most_frequent(cut(counted), HEAVY_ROWS).toPandas()
    heavy, counts = often["token"].to_numpy(np.int64).view(np.uint64), often["c"].to_numpy(np.int64)
    order = np.argsort(heavy)

    # texts go through a sorted join at every size, so that what is shuffled follows the input
    heads = rows.hint("merge").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    token = Window.partitionBy("token")
    group = Window.partitionBy("token", "n", "same").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    postings = heads.mapInArrow(_prefixes(words, threshold, heavy[order], counts[order]), "token long, id long, n long, pos long, same long, last_c long, last_h long")
    # a class whose id stands in two rows with different texts gives each posting once
    postings = postings.withColumn("m", F.count("*").over(token)).filter("m > 1").drop("m")
    postings = cut(postings.withColumn("gid", F.first("id").over(group)).dropDuplicates(["token", "id"]).drop("same"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose sets link."""
        pairs = cut(pairs.select("u", "v").distinct())
        if pairs.isEmpty():
            return pairs
        ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
        sets = rows.hint("merge").join(ids, "doc_id", "left_semi").mapInArrow(_sets(words), "id long, shingles array<long>")
        a = sets.select(F.col("id").alias("u"), F.col("shingles").alias("set_a"))
        b = sets.select(F.col("id").alias("v"), F.col("shingles").alias("set_b"))
        return cut(pairs.join(a, "u").join(b, "v").select("u", "v", "set_a", "set_b").mapInArrow(_overlaps(threshold), "u long, v long"))

    inner = linked(postings.filter("id <> gid").select(F.col("gid").alias("u"), F.col("id").alias("v")))
    member = inner.select(F.col("v").alias("id"), F.col("u").alias("head"))
    grouped = cut(postings.drop("gid").join(member, "id", "left").filter("head is null").drop("head").withColumnRenamed("id", "gid"))

    prefixes = cut(grouped.groupBy("gid").agg(F.first("n").alias("n"), F.first("last_c").alias("last_c"), F.first("last_h").alias("last_h"), F.collect_list("token").alias("tokens")))
    beyond = F.ceil(F.col("n") * threshold / 100) - 1  # shingles after the prefix
    grouped = grouped.join(prefixes.select("gid", F.size("tokens").alias("again"), (F.size("tokens") + beyond).alias("cap"), beyond.alias("beyond")), "gid")
    nth = F.row_number().over(Window.partitionBy("gid").orderBy("pos")) - 1
    at = F.struct("n", "last_c", "last_h", "cap", "again", "beyond", "pos", nth.alias("nth"))
    grouped = cut(grouped.select("token", "gid", at.alias("own")))

    def ends_first(x, y):
        return (x["last_c"] < y["last_c"]) | ((x["last_c"] == y["last_c"]) & (x["last_h"] <= y["last_h"]))

    def after(x, y):
        """Shingles that come after the prefix that ends first."""
        return F.when(ends_first(x, y), x["beyond"]).otherwise(y["beyond"])

    def can_be_first(x, y):
        """Whether a posting that two sets have in common can be their first one, if they link: enough must be left of either, in and after the prefixes."""
        enough = threshold * (x["n"] + y["n"])
        inside = (100 + threshold) * (F.least(x["again"] - x["nth"], y["again"] - y["nth"]) + after(x, y)) >= enough
        return inside & ((100 + threshold) * F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= enough)

    def reaches(x, y, shared=None):
        """Whether two sets can link.

        Of the two prefixes, the one that ends first in the order holds every common shingle up to its end; so the
        sets share what the prefixes share, at most all of that prefix that occurs again, and what comes after it.
        """
        most = F.when(ends_first(x, y), x["cap"]).otherwise(y["cap"]) if shared is None else shared + after(x, y)
        sizes = 100 * F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"])
        return sizes & ((100 + threshold) * most >= threshold * (x["n"] + y["n"]))

    def close(pairs: DataFrame) -> DataFrame:
        """The group pairs (u, v) whose prefixes share enough."""
        side = F.struct("n", "last_c", "last_h", beyond.alias("beyond"))
        a = prefixes.select(F.col("gid").alias("u"), side.alias("x"), F.col("tokens").alias("t_u"))
        b = prefixes.select(F.col("gid").alias("v"), side.alias("y"), F.col("tokens").alias("t_v"))
        return pairs.distinct().join(a, "u").join(b, "v").filter(reaches(F.col("x"), F.col("y"), F.size(F.array_intersect("t_u", "t_v")))).select("u", "v")

    shuffled = Window.partitionBy("token").orderBy(F.xxhash64("token", "gid"), "gid")
    rarest_first = Window.partitionBy("token").orderBy("own.pos", "gid")
    seen = F.struct("gid", "own")
    chained = grouped.withColumn("near", F.array_distinct(F.array_compact(F.array(F.lag(seen).over(shuffled), F.first(seen).over(rarest_first)))))
    chained = chained.select("gid", "own", F.explode("near").alias("o")).select("gid", "own", F.col("o.gid").alias("other"), F.col("o.own").alias("theirs")).filter("gid <> other").filter(reaches(F.col("own"), F.col("theirs")))
    first = linked(close(chained.select(F.least("gid", "other").alias("u"), F.greatest("gid", "other").alias("v"))))
    found = inner.union(first)

    labels = components(found)
    labelled = grouped.join(labels.withColumnRenamed("id", "gid"), "gid", "left").withColumn("label", F.coalesce("component", "gid")).drop("component")
    per_label = labelled.withColumn("c", F.count("*").over(Window.partitionBy("token", "label")))
    main = Window.partitionBy("token")
    ranked = cut(per_label.withColumn("top", F.max(F.struct("c", "label")).over(main)["label"]).withColumn("bottom", F.min("label").over(main)).withColumn("last", F.max("label").over(main)).filter("bottom <> last").drop("bottom", "last"))
    apart = (F.col("g_label") != F.col("label")) & ((F.col("label") == F.col("top")) | (F.col("g") < F.col("gid")))
    both = _cell_pairs(ranked, threshold).filter(apart & reaches(F.col("own"), F.col("theirs")) & can_be_first(F.col("own"), F.col("theirs")))
    heads_apart = close(both.select(F.col("g").alias("u"), F.col("gid").alias("v"))).select(F.col("u").alias("g1"), F.col("v").alias("g2"))
    body = member.select(F.col("head").alias("g"), "id").union(grouped.select("gid", F.col("gid").alias("id")).distinct())
    expanded = heads_apart.join(body.select(F.col("g").alias("g1"), F.col("id").alias("a")), "g1").join(body.select(F.col("g").alias("g2"), F.col("id").alias("b")), "g2")
    rest = linked(expanded.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
    labels = components(found.union(rest))

    named = sized.join(classes, ["n", "h1", "h2"], "left")
    out = named.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component", "class_id", "id").alias("component_id"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """docs with one row of each group of linked rows: the one with the least id (null after all), of one id the one whose text has the least SHA-256; rows without words all stay."""
    names = docs.columns
    key, text = (f"c{names.index(x)}" for x in ("doc_id", "text"))
    # rows are numbered and written, so that every step sees the same numbers; no name of docs can clash with a step's
    rows = cut(docs.toDF(*(f"c{k}" for k in range(len(names)))).withColumn("row", F.monotonically_increasing_id()))
    classes = jaccard_classes(rows, words, threshold, "row", text).select(F.col("doc_id").alias("row"), "component_id")
    choice = F.struct(F.col(key).isNull().alias("a"), F.col(key).alias("b"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("c"), "row")
    kept = cut(rows.select("row", choice.alias("choice")).join(classes, "row").groupBy("component_id").agg(F.min("choice").alias("m")).select("m.row"))
    return rows.join(kept, "row", "left_semi").drop("row").toDF(*names)
