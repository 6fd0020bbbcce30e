"""Token counts by prefix dynamic programming.

For every text the exact count of every prefix is known: within a piece of the pre-tokenizer the count of a
prefix follows from the counts of shorter ones (see ``_bpe.Encoder.piece_counts``), and between pieces the
counts add up.  So the count of a text, where to cut it for a budget, and how many tokens a cut leaves are
lookups; nothing is encoded again.

Rules: a null or empty text has no tokens; a text of any length is counted whole; the path names the vocabulary
file, which every executor reads; rows keep their own result, repeated ids and rows included; a text of just the
budget fits; an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm._bpe import encoder
from barspark.llm._spark import small_batches, text_rows

COUNTED = "doc_id long, n_bytes long, n_tokens long, fits long"


def _count(path: str, budget: int, stored: bool):
    def run(batches):
        enc = encoder(path, prefixes=True)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_bytes, n_tokens, fits, prefixes = [], [], [], []
            for first in range(0, len(texts), 100):
                for text, counts in zip(texts[first : first + 100], enc.counts(texts[first : first + 100]), strict=True):
                    n_bytes.append(len(text.encode()))
                    n_tokens.append(int(counts[-1]))
                    fits.append(len(counts) - 1 if counts[-1] <= budget else int(np.flatnonzero(counts <= budget)[-1]))
                    if stored:
                        prefixes.append(counts)
            columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(fits, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "fits"]
            if stored:
                columns.append(pa.array(prefixes, pa.list_(pa.int64())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_counts(docs: DataFrame, path: str, budget: int = 512, stored: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fits): fits is the length in code points of the longest prefix of at most ``budget`` tokens.

    With ``stored``, prefix_tokens holds the counts of all prefixes: element i that of the first i code points.
    """
    small_batches(docs.sparkSession)
    return text_rows(docs, key, text).mapInArrow(_count(path, budget, stored), COUNTED + (", prefix_tokens array<long>" if stored else ""))


def truncate(docs: DataFrame, path: str, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_tokens): each text cut to its longest prefix of at most ``budget`` tokens, with that prefix's count."""

    def run(batches):
        enc = encoder(path, prefixes=True)
        for batch in batches:
            texts, cut, n = batch.column("text").to_pylist(), [], []
            for first in range(0, len(texts), 100):
                for t, counts in zip(texts[first : first + 100], enc.counts(texts[first : first + 100]), strict=True):
                    at = int(np.flatnonzero(counts <= budget)[-1])
                    cut.append(t[:at])
                    n.append(int(counts[at]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cut, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "text", "n_tokens"])

    small_batches(docs.sparkSession)
    return text_rows(docs, key, text).mapInArrow(run, "doc_id long, text string, n_tokens long")


def op10_token_counts(spark, sf_dir: str, limit: int = 512) -> DataFrame:
    import public_tokenizers

    counted = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), limit)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fits")
