"""Ranked lexical search over per-term posting lists in geometric blocks, exact.

Terms are runs of digits, letters and characters beyond ASCII of the whole text, A-Z folded.  One map over the documents
turns each into its length and the counts of the terms that some query has (their words compared byte by byte); these
vectors are written once, and counts over all of them give the weights.  A second map searches: a task puts its vectors
together in shards of ``SHARD_DOCS``, each with a forward index and, for a term that a query comes to, a posting list
that is clustered by similarity (each document goes to the most similar of some of the list, on random projections of
its weighted vector) and cut into blocks of ``BLOCK_DOCS`` at most.  A block's summary is the largest value of its
documents for each term, so a query's product with a summary bounds the score of each document in it, in integers.

A query takes its lists shortest first and a list's blocks highest bound first.  A block is skipped only when its bound is
below the k-th best score so far; the rest of the lists is left only when the largest values of all of them together are.
A block that isn't skipped has its documents scored from the forward index.  Ties at the bound are scored.  A task hands on
k documents a query at most, which are ranked in two steps; no documents are dealt.

Queries go in blocks of ``BLOCK_MB`` of text, whose terms and counts are what is broadcast and what comes to the driver.

Rules: a null or empty text has no terms, doesn't count as a document and is never found; texts of any length count
whole; rows with equal ids, or repeated rows, are documents of their own, a null id comes last among equal scores;
queries that repeat id and text are one, queries that repeat an id alone are ranked apart; a query without terms, or
whose terms no document has, finds nothing; an empty table finds nothing; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm._bytes import ALNUM, LOWER, as_bytes, blocks, word_block
from barspark.llm._spark import cut, small_batches, table

BLOCK_MB = 16
SHARD_DOCS = 8192
SHARD_ENTRIES = 4_000_000
BLOCK_DOCS = 32
PROJECTIONS = 16
SEED = 20250101
#: The share of a length's own part in a document's length norm, in hundredths.
LENGTH_PART = 25
VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "query int, task int, doc_id long, score long, n_scored long"


class Vocabulary:
    """The terms of some texts, numbered, and their places in other texts."""

    def __init__(self, texts: list[bytes]):
        self.counts: list[Counter] = []
        known: dict[bytes, int] = {}
        for text in texts:
            buf = np.frombuffer(text or b" ", np.uint8)
            _, _, s, e = word_block(buf, np.zeros(1, np.int64), ALNUM)
            self.counts.append(Counter(known.setdefault(LOWER[buf[a:b]].tobytes(), len(known)) for a, b in zip(s, e, strict=True)))
        self.words = list(known)
        self.buf = np.frombuffer(b"".join(self.words) or b" ", np.uint8)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.length) - self.length
        joined = np.frombuffer(b" ".join(self.words) or b" ", np.uint8)
        hashes = word_block(joined, np.zeros(1, np.int64), ALNUM)[0]
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def numbers(self, buf: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The number of each word of a block, or -1."""
        out = np.full(len(h), -1)
        lo = np.searchsorted(self.hashes, h)
        at = np.flatnonzero(lo < len(self.hashes))
        at = at[self.hashes[lo[at]] == h[at]]
        lo = lo[at]
        while len(at):  # more than one round only where words share a hash
            term = self.order[lo]
            same, rest = self.length[term] == e[at] - s[at], np.arange(len(at))
            rest = rest[same]
            j = 0
            while len(rest):
                equal = LOWER[buf[s[at[rest]] + j]] == self.buf[self.start[term[rest]] + j]
                same[rest[~equal]] = False
                j += 1
                rest = rest[equal & (self.length[term[rest]] > j)]
            out[at[same]] = term[same]
            left = ~same & (lo + 1 < len(self.hashes))
            left[left] = self.hashes[lo[left] + 1] == h[at[left]]
            at, lo = at[left], lo[left] + 1
        return out


def _vectors(vocabulary: Vocabulary):
    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            n, sizes, terms, counts = [], [], [], []
            for first, last, buf, starts in blocks(texts):
                h, doc, s, e = word_block(buf, starts, ALNUM)
                n.append(np.bincount(doc, minlength=last - first))
                number = vocabulary.numbers(buf, h, s, e)
                known = number >= 0
                width = max(1, len(vocabulary.words))
                pair, times = np.unique(doc[known] * width + number[known], return_counts=True)
                sizes.append(np.bincount(pair // width, minlength=last - first))
                terms.append(pair % width)
                counts.append(times)
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            offsets = pa.array(np.r_[0, np.cumsum(flat(sizes))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(flat(x).astype(np.int32))) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(flat(n).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])

    return run


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Shard:
    """Some documents' vectors, forward and by term."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray, block_docs: int):
        self.start, self.size, self.terms, self.values, self.block_docs = offsets[:-1], np.diff(offsets), terms, values, block_docs
        order = np.argsort(terms, kind="stable")
        self.listed = np.repeat(np.arange(len(self.size)), self.size)[order]
        self.list_start = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.list_size = np.diff(self.list_start)
        self.top = np.zeros(len(weights), np.int64)
        some = np.flatnonzero(self.list_size)
        if len(some):
            self.top[some] = np.maximum.reduceat(values[order], self.list_start[some])
        self.weights, self.sketch, self.blocks = weights, None, {}

    def sketches(self) -> np.ndarray:
        if self.sketch is None:
            signs = np.random.default_rng(SEED).integers(0, 2, (len(self.weights), PROJECTIONS), np.int8) * 2 - 1
            self.sketch = np.zeros((len(self.size), PROJECTIONS), np.float32)
            doc = np.repeat(np.arange(len(self.size)), self.size)
            weighted = (self.values * self.weights[self.terms]).astype(np.float32)
            for p in range(PROJECTIONS):
                self.sketch[:, p] = np.bincount(doc, weighted * signs[self.terms, p], minlength=len(self.size))
            self.sketch /= np.maximum(np.linalg.norm(self.sketch, axis=1, keepdims=True), 1e-9)
        return self.sketch

    def block_list(self, term: int):
        """(documents by block, blocks' starts and lengths, summaries' starts, terms, largest values) of a term's list."""
        if term not in self.blocks:
            docs = self.listed[self.list_start[term] : self.list_start[term + 1]]
            new = np.zeros(len(docs), bool)
            if len(docs) > self.block_docs:
                near = self.sketches()[docs]
                centres = near[np.linspace(0, len(docs) - 1, -(-2 * len(docs) // self.block_docs)).astype(np.int64)]
                cluster = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(near, -(-len(docs) // 1024))])
                order = np.argsort(cluster, kind="stable")
                docs, cluster = docs[order], cluster[order]
                new[1:] = cluster[1:] != cluster[:-1]
            new[:1] = True
            first = np.flatnonzero(new)
            within = np.arange(len(docs)) - np.repeat(first, np.diff(np.r_[first, len(docs)]))
            start = np.flatnonzero(within % self.block_docs == 0)
            length = np.diff(np.r_[start, len(docs)])
            at = _ranges(self.start[docs], self.size[docs])
            block = np.repeat(np.repeat(np.arange(len(start)), length), self.size[docs])
            key = block * len(self.weights) + self.terms[at]
            order = np.argsort(key, kind="stable")
            key, values = key[order], self.values[at][order]
            own = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            self.blocks[term] = docs, start, length, np.searchsorted(key[own], np.arange(len(start)) * len(self.weights)), key[own] % len(self.weights), np.maximum.reduceat(values, own)
        return self.blocks[term]

    def scores(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        at, size = _ranges(self.start[docs], self.size[docs]), self.size[docs]
        return np.add.reduceat(query[self.terms[at]] * self.values[at], np.cumsum(size) - size)


class Best:
    """The k best documents of a query so far: highest score, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.floor, self.scored = k, 1, 0
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        self.scored += len(score)
        good = score >= self.floor
        if not good.any():
            return
        score, ids, null = np.r_[self.score, score[good]], np.r_[self.id, ids[good]], np.r_[self.null, null[good]]
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.score[-1]))


def _look(shard: Shard, ids: np.ndarray, null: np.ndarray, terms: np.ndarray, shares: np.ndarray, best: Best, query: np.ndarray, seen: np.ndarray) -> None:
    """One query over one shard; ``query`` and ``seen`` are all zero before and after."""
    there = shard.top[terms] > 0
    terms, shares = terms[there], shares[there]
    order = np.argsort(shard.list_size[terms], kind="stable")
    terms, shares = terms[order], shares[order]
    query[terms] = shares
    # what the lists from each one on can give a document at most
    rest = np.cumsum((shares * shard.top[terms])[::-1])[::-1]
    touched = []
    for term, most in zip(terms, rest, strict=True):
        if most < best.floor:
            break
        docs, start, length, own, keys, values = shard.block_list(int(term))
        bound = np.add.reduceat(query[keys] * values, own)
        order, at, step = np.argsort(-bound, kind="stable"), 0, 4
        while at < len(order) and bound[order[at]] >= best.floor:
            these = order[at : at + step]
            these = these[bound[these] >= best.floor]
            found = docs[_ranges(start[these], length[these])]
            found = found[~seen[found]]
            if len(found):
                seen[found] = True
                touched.append(found)
                best.add(shard.scores(found, query), ids[found], null[found])
            at, step = at + step, step * 2
    query[terms] = 0
    for x in touched:
        seen[x] = False


def _search(queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, shard_docs: int, shard_entries: int, block_docs: int):
    def searched(parts: list[pa.RecordBatch], best: list[Best]) -> None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        size = rows.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(size)  # a document without terms of any query has no score
        if not len(kept):
            return
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        terms, counts = flat("terms"), flat("counts")
        norm = 100 - LENGTH_PART + (LENGTH_PART * rows.column("n").to_numpy() * n_docs) // n_terms
        values = (1_000_000_000 * counts) // (1000 * counts + 12 * np.repeat(norm, size))
        ids = rows.column("doc_id").combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)[kept]
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)[kept]
        shard = Shard(np.r_[0, np.cumsum(size[kept])], terms, values, weights, block_docs)
        query, seen = np.zeros(len(weights), np.int64), np.zeros(len(kept), bool)
        for (own, shares), found in zip(queries, best, strict=True):
            _look(shard, ids, null, own, shares, found, query, seen)

    def run(batches):
        best, parts, docs, entries = [Best(k) for _ in queries], [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                parts.append(part)
                docs, entries = docs + part.num_rows, entries + len(part.column("terms").flatten())
                if docs >= shard_docs or entries >= shard_entries:
                    searched(parts, best)
                    parts, docs, entries = [], 0, 0
        if docs:
            searched(parts, best)
        task = TaskContext.get().partitionId()
        for first in range(0, len(best), 1000):
            rows = [(q, task, None if null else int(i), int(s), x.scored if j == 0 else 0) for q, x in enumerate(best[first : first + 1000], first) for j, (s, i, null) in enumerate(zip(x.score, x.id, x.null, strict=True))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", block_mb: float = BLOCK_MB, shard_docs: int = SHARD_DOCS, shard_entries: int = SHARD_ENTRIES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score, n_scored) of the k best documents of every query; n_scored is how many documents had their score worked out for it."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = queries.select(F.col(query_id).alias("item_id"), F.col(query_text).alias("t")).filter("t is not null").distinct()
    id_type = items.schema["item_id"].dataType.simpleString()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / (block_mb * 1e6)))
    out = None
    for block in range(n):
        asked = items.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == block).collect()
        vocabulary = Vocabulary([r["t"].encode() for r in asked])
        vectors = cut(rows.mapInArrow(_vectors(vocabulary), VECTORS)).filter("n > 0")
        totals = vectors.agg(F.count("*"), F.sum("n")).first()
        n_docs, n_terms = totals[0], totals[1] or 1
        df = np.zeros(len(vocabulary.words), np.int64)
        for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
            df[r["term"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        asked_terms = []
        for counts in vocabulary.counts:
            terms = np.array(sorted(t for t in counts if weights[t] > 0), np.int64)
            asked_terms.append((terms, np.array([counts[t] for t in terms.tolist()], np.int64) * weights[terms]))
        found = vectors.mapInArrow(_search(asked_terms, weights, n_docs, n_terms, k, shard_docs, shard_entries, block_docs), FOUND)
        # first among tasks of one remainder, then among all
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        scored = F.sum("n_scored").over(Window.partitionBy("query"))
        some = found.withColumn("part", F.col("task") % 64).withColumn("scored", F.sum("n_scored").over(Window.partitionBy("query", "part")))
        some = some.withColumn("nth", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).filter(F.col("nth") <= k)
        best = some.withColumn("n_scored", F.when(F.col("nth") == 1, F.col("scored")).otherwise(0)).withColumn("n_scored", scored)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(asked)], f"query int, item_id {id_type}")
        part = best.join(names, "query").select("item_id", "rank", "doc_id", "score", "n_scored")
        out = part if out is None else out.unionByName(part)
    return out


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_scored")


TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
x AS (SELECT item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
WHERE rank <= 20
"""
