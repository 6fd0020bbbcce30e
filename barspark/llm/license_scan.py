"""License scans with a positional index of rare words.

Words are runs of digits, letters and characters beyond ASCII, A-Z folded.  Licence words are the words of the
templates and of the base phrases; how many documents hold each is counted over all documents, which gives
their inverse document frequencies.  The index lists, for each licence word, the templates and positions
where it stands, for the templates' highest-weight words.  A template whose mandatory phrases don't all stand in a
document is ruled out there.  For the others, all licence words that occur are looked up; each posting votes for a
template at the place where it would begin, by relative position.  A place with two votes is a candidate; it
counts if enough of the template's words stand there, and its mandatory phrases, word for word, near where the
template has them.  Whether a place counts does not depend on the rest of the document.

A base phrase is a template whose words are all mandatory: its rarest word alone leads to every place where
it can stand, and the phrase is compared there, so no place is missed.

Licence words are found by hashes and compared byte by byte.

Rules: a null or empty text has no words and no labels; a text of any length is one document, read whole;
overlapping places all count; words of equal weight are indexed in the order of their bytes; rows with one id, or
repeated rows, keep their own results; an empty table gives an empty table; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm._bytes import ALNUM, LOWER, as_bytes, blocks, word_block
from barspark.llm._license_texts import BASE, TEMPLATES
from barspark.llm._spark import small_batches, text_rows

#: Highest-frequency-weight words of a template that are indexed; half of its words at most, two at least.
KEYS = 12
#: Words by which a place may differ from the template's own spacing.
SLACK = 8
#: Share of a template's words that a place must have.
COVERAGE = 0.6

SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, places array<struct<label:string,start:long,end:long,coverage:double>>"


def _words(text: str) -> tuple[list[bytes], np.ndarray]:
    raw = text.encode()
    h, _, s, e = word_block(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64), ALNUM)
    return [raw[a:b].lower() for a, b in zip(s, e, strict=True)], h


class Index:
    """Templates, base phrases and, once frequencies are known, the postings of rare words."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.templates = [(label, _words(text)[0], [_words(p)[0] for p in phrases]) for label, text, phrases in templates]
        self.base = [(label, _words(phrase)[0]) for phrase, label in base.items()]
        by_word = {}
        for text in [*(t for _, t, _ in templates), *base, *(p for _, _, ps in templates for p in ps)]:
            words, h = _words(text)
            by_word.update(zip(words, h.tolist(), strict=True))
        self.vocabulary = sorted(by_word)
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        hashes = np.array([by_word[w] for w in self.vocabulary], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def weigh(self, holding: dict[int, int], documents: int) -> "Index":
        """Set the inverse document frequencies and the postings."""
        self.idf = np.array([math.log((documents + 1) / (holding.get(i, 0) + 1)) for i in range(len(self.vocabulary))])
        self.postings = defaultdict(list)
        for t, (_, words, _) in enumerate(self.templates):
            distinct = sorted({self.number[w] for w in words}, key=lambda i: (-self.idf[i], i))
            keys = set(distinct[: min(KEYS, max(2, len(distinct) // 2))])
            for at, w in enumerate(words):
                if self.number[w] in keys:
                    self.postings[self.number[w]].append((t, at))
        self.rarest = [(label, *self._led(words)) for label, words in self.base]
        self.marks = [[self._led(words) for words in phrases] for _, _, phrases in self.templates]
        return self

    def _led(self, words: list[bytes]) -> tuple[list[int], int]:
        """The numbers of a phrase's words and the position of the rarest one."""
        numbers = [self.number[w] for w in words]
        return numbers, max(range(len(words)), key=lambda i: (self.idf[numbers[i]], -i))

    def occurrences(self, h: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions, among words with hashes h that stand at buf[s:e], and the numbers, of licence words."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[slot] == h[at]
        at, number = at[hit], self.order[slot[hit]]
        same, by = np.zeros(len(at), bool), np.argsort(number, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(number[by])) + 1) if len(by) else ():
            word = np.frombuffer(self.vocabulary[number[part[0]]], np.uint8)
            part = part[(e - s)[at[part]] == len(word)]
            same[part] = (LOWER[buf[s[at[part]][:, None] + np.arange(len(word))]] == word).all(axis=1)
        return at[same], number[same]


def _count(index: Index):
    def run(batches):
        for batch in batches:
            seen, n = np.zeros(len(index.vocabulary), np.int64), 0
            for first, last, buf, starts in blocks(as_bytes(batch.column("text"))):
                h, doc, s, e = word_block(buf, starts, ALNUM)
                at, number = index.occurrences(h, buf, s, e)
                pairs = np.unique(doc[at] * len(index.vocabulary) + number)
                seen += np.bincount(pairs % len(index.vocabulary), minlength=len(index.vocabulary))
                n += last - first
            numbers = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(numbers, -1).astype(np.int32)), pa.array(np.append(seen[numbers], n).astype(np.int64))], names=["word", "holding"])

    return run


def _places(index: Index, at: np.ndarray, number: np.ndarray) -> tuple[list, list]:
    """Base places (label, start) and template places (label, start, end, coverage) of one document."""
    where = dict(zip(at.tolist(), number.tolist(), strict=True))
    positions_of: dict[int, list[int]] = defaultdict(list)
    for p, n in where.items():
        positions_of[n].append(p)

    def starts(numbers: list[int], lead: int) -> list[int]:
        """Where a phrase stands, in order."""
        return [p - lead for p in positions_of.get(numbers[lead], ()) if all(where.get(p - lead + i) == n for i, n in enumerate(numbers))]

    base = [(label, p) for label, numbers, lead in index.rarest for p in starts(numbers, lead)]
    marks_at: dict[int, list[list[int]]] = {}
    for t, phrases in enumerate(index.marks):
        found_at = []
        for numbers, lead in phrases:
            found_at.append(starts(numbers, lead))
            if not found_at[-1]:
                break
        else:
            marks_at[t] = found_at
    votes: dict[tuple[int, int], set[int]] = defaultdict(set)
    for p, n in where.items() if marks_at else ():
        for t, position in index.postings.get(n, ()):
            if t in marks_at:
                start = p - position
                # places within the slack of each other share a cell; both neighbours are tried
                votes[t, start // SLACK].add(position)
                votes[t, start // SLACK + 1].add(position)
    best: dict[int, list] = defaultdict(list)
    for (t, cell), positions in votes.items():
        label, words, phrases = index.templates[t]
        if len(positions) < 2:
            continue
        begin = (cell - 1) * SLACK
        first = [bisect_left(m, begin - SLACK) for m in marks_at[t]]
        marks = [m[k] for m, k in zip(marks_at[t], first, strict=True) if k < len(m) and m[k] < begin + 2 * SLACK + len(words)]
        if len(marks) < len(phrases):
            continue
        held = sum(1 for i, w in enumerate(words) if any(where.get(begin + i + s) == index.number[w] for s in range(-SLACK, 2 * SLACK)))
        coverage = held / len(words)
        if coverage < COVERAGE:
            continue
        start = min(marks, default=begin)
        best[t].append((start, max((m + len(ph) for m, ph in zip(marks, phrases, strict=True)), default=begin + len(words)), coverage))
    found = []
    for t, places in best.items():
        unique: dict[int, tuple[int, int, float]] = {}
        for start, end, coverage in places:
            if start not in unique or unique[start][2] < coverage:
                unique[start] = (start, end, coverage)
        found += [(index.templates[t][0], *x) for _, x in sorted(unique.items())]
    return base, found


def _scan(index: Index, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            rows, docs = [], batch.column("doc_id").to_pylist()
            for first, last, buf, starts in blocks(as_bytes(batch.column("text"))):
                h, doc, s, e = word_block(buf, starts, ALNUM)
                at, number = index.occurrences(h, buf, s, e)
                cuts = np.searchsorted(doc, np.arange(last - first + 1))
                mine = np.searchsorted(doc[at], np.arange(last - first + 1))
                for i in range(last - first):
                    a, b = mine[i], mine[i + 1]
                    base, found = _places(index, at[a:b] - cuts[i], number[a:b]) if b > a else ([], [])
                    labels = sorted({x[0] for x in base})
                    more = sorted({*labels, *(x[0] for x in found)})
                    score = 1.0 if base else max((x[3] for x in found), default=0.0)
                    starts_at = [x[1] for x in base]
                    places = [{"label": x[0], "start": x[1], "end": x[2], "coverage": x[3]} for x in found]
                    rows.append((docs[first + i], int(cuts[i + 1] - cuts[i]), len(base), min(starts_at, default=None), max(starts_at, default=None), labels, more, score, places))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and places of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    rows, index = text_rows(docs, key, text), Index(templates, base)
    counted = {r["word"]: r["n"] for r in rows.mapInArrow(_count(index), "word int, holding long").groupBy("word").agg(F.sum("holding").alias("n")).collect()}
    index.weigh(counted, counted.get(-1, 0))
    schema = to_arrow_schema(spark.createDataFrame([], SCANNED).schema)
    return rows.mapInArrow(_scan(index, schema), SCANNED)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *(F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")), "score")
