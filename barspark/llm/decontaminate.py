"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Words are runs of digits, letters and characters beyond ASCII, A-Z folded.  An item's windows are its runs
of ``words`` consecutive words; an item of fewer words, but not none, is one window.  Every task holds the
hashes of the windows and slides over each whole document; a hit is verified on the words themselves.

The items are broadcast in blocks of ``BLOCK_MB`` of text at most (one longer item makes a block of its
own size); for a benchmark of several blocks the rows are numbered and written once, matched block by block,
and the hits of a row are merged by its number.

Rules: a null or empty text has no words; a text of any length is scanned whole; an item without words has no
window; items that repeat an id count once; items without an id hit words too and count as one, which no digest names; a document row keeps its own result, repeated ids and repeated rows
included; a document at the bound of its share is contaminated; with an empty benchmark nothing is hit, and an empty
table gives an empty table; further columns are kept as they are, but for those with the names of results; in
``decontaminate`` and ``remove_spans`` all columns are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm._bytes import ALNUM, as_bytes, blocks, ngram_hash, word_block
from barspark.llm._spark import cut, small_batches

BLOCK_MB = 16
SCANNED = "n_words long, n_hit long, item_ids array<string>, hit_words array<struct<start:long,end:long>>, hit_bytes array<struct<start:long,end:long>>"


class Windows:
    """Window hashes of some items, by window length."""

    def __init__(self, items: list[tuple[str, bytes]], words: int):
        self.items = [x for x, _ in items]
        self.words: list[list[bytes]] = []
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i, (_, text) in enumerate(items):
            buf = np.frombuffer(text or b" ", np.uint8)
            h, _, s, e = word_block(buf, np.zeros(1, np.int64), ALNUM)
            self.words.append([text[a:b].lower() for a, b in zip(s, e, strict=True)])
            if len(h):
                m = min(words, len(h))
                grams = ngram_hash(h, m)
                by_length.setdefault(m, []).append((grams, np.full(len(grams), i), np.arange(len(grams))))
        self.tables = {}
        for m, parts in by_length.items():
            grams, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(grams, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(grams >> np.uint64(44)).astype(np.int64)] = True
            self.tables[m] = (grams[order], item[order], at[order], seen)

    def hits(self, h, doc, s, e, text: bytes):
        """(first word, length, item) of every verified window in a block of documents."""
        for m, (grams, item, at, seen) in self.tables.items():
            found = ngram_hash(h, m)
            if not len(found):
                continue
            maybe = np.flatnonzero(seen[(found >> np.uint64(44)).astype(np.int64)] & (doc[: len(found)] == doc[m - 1 :]))
            lo, hi = np.searchsorted(grams, found[maybe]), np.searchsorted(grams, found[maybe], side="right")
            for k, a, b in zip(maybe[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
                own = [text[s[j] : e[j]].lower() for j in range(k, k + m)]
                for x in range(a, b):
                    if self.words[item[x]][at[x] : at[x] + m] == own:
                        yield int(k), m, int(item[x])


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scan(windows: Windows, text: str, out: pa.Schema):
    def run(batches):
        for batch in batches:
            texts, rows = as_bytes(batch.column(text)), []
            for first, last, buf, starts in blocks(texts):
                h, doc, s, e = word_block(buf, starts, ALNUM)
                cuts = np.searchsorted(doc, np.arange(last - first + 1))
                hit, items = np.zeros(len(h), bool), {}
                for k, m, item in windows.hits(h, doc, s, e, buf.tobytes() if windows.tables else b""):
                    hit[k : k + m] = True
                    items.setdefault(int(doc[k]), set()).add(windows.items[item])
                for i in range(last - first):
                    a, b = cuts[i], cuts[i + 1]
                    if i not in items:
                        rows.append((int(b - a), 0, [], [], []))
                        continue
                    lo, hi = _runs(hit[a:b])
                    spans = [{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)]
                    inside = [{"start": int(s[a + x] - starts[i]), "end": int(e[a + y - 1] - starts[i])} for x, y in zip(lo, hi, strict=True)]
                    rows.append((int(b - a), int(hit[a:b].sum()), sorted(items[i], key=lambda x: (x is None, x or "")), spans, inside))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            new = [pa.array(list(x), out.field(n).type) for n, x in zip(("n_words", "n_hit", "item_ids", "hit_words", "hit_bytes"), columns, strict=True)]
            kept = [batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*batch.schema.names, "n_words", "n_hit", "item_ids", "hit_words", "hit_bytes"])

    return run


def _merged(parts: list[DataFrame], keep: list[str]) -> DataFrame:
    """Hits of several blocks of items, by document row: word spans that meet become one."""
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    held = union.groupBy(*keep).agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
        *(F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("hit_words", "hit_bytes")),
    )

    def joined(column: str):
        empty = F.array().cast("array<struct<start:long,end:long>>")
        return F.aggregate(
            column,
            empty,
            lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
        )

    held = held.withColumn("hit_words", joined("hit_words")).withColumn("hit_bytes", joined("hit_bytes"))
    return held.withColumn("n_hit", F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]))


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_mb: float = BLOCK_MB) -> DataFrame:
    """Every row of docs with n_words, n_hit, item_ids (of items with an occurring window), hit_words (runs of hit words) and hit_bytes (the runs' UTF-8 bytes)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / (block_mb * 1e6)))
    taken = {"n_words", "n_hit", "item_ids", "hit_words", "hit_bytes"}
    rows = docs.drop(*[c for c in docs.columns if c.lower() in taken])
    out = to_arrow_schema(docs.sparkSession.createDataFrame([], SCANNED).schema)
    number = "row"
    while number in {c.lower() for c in rows.columns} | taken:
        number += "_"
    # the numbers are written with the rows, so that every block sees the same ones
    held = rows if n == 1 else cut(rows.withColumn(number, F.monotonically_increasing_id()))
    scanned = held if n == 1 else held.select(number, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in scanned.schema), SCANNED])
    parts = []
    for k in range(n):
        block = [(r[0], r[1].encode()) for r in items.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()]
        parts.append(scanned.mapInArrow(_scan(Windows(block, words), text, out), schema))
    if n == 1:
        return parts[0]
    merged = _merged([x.drop(text) for x in parts], [number])
    return held.join(merged, number).select(*rows.columns, *(f.name for f in out))


def is_contaminated(share: int = 20):
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with columns c0, c1, ... and the name of the text among them: no name of docs can clash with a result's."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), f"c{docs.columns.index('text')}"


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = 13, share: int = 20) -> DataFrame:
    """docs without the contaminated documents: those of whose words one in ``share`` at least is hit."""
    rows, text = _numbered(docs)
    return contamination(rows, benchmark, words, text).filter(~is_contaminated(share)).select(*rows.columns).toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, words: int = 13) -> DataFrame:
    """docs with the hit spans cut out of their texts; a null text stays null."""
    rows, text = _numbered(docs)
    found = contamination(rows, benchmark, words, text)
    raw = F.encode(F.col(text), "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("hit_bytes", lambda x: x["end"]))
    ends = F.concat(F.transform("hit_bytes", lambda x: x["start"]), F.array(F.octet_length(text).cast("long")))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.decode(F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "UTF-8")), "")
    return found.withColumn(text, F.when(F.size("hit_bytes") > 0, kept).otherwise(F.col(text))).select(*rows.columns).toDF(*docs.columns)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
    ids = F.array_join(F.array_sort("item_ids"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bw)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.m, iw.item_id FROM dw JOIN iw USING (m, s)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS items_sha256
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
