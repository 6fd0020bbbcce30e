"""The corpus pipeline on the smallest documents, stage by stage, against plain versions."""

import re
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_text_operators import KINDS, shingles, words_of  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(names) - 1:
            assert docs.columns == columns
        seen[name] = docs.collect()
    good, once, clean, private, packed = (seen[n] for n in names)

    sets = {r.doc_id: shingles(r.text) for r in good}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    assert sorted(r.doc_id for r in once) == sorted({find(i) for i in sets})

    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words_of(r.text)
        m = min(13, len(w))
        windows |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
    by_length = defaultdict(set)
    for x in windows:
        by_length[len(x)].add(x)

    def contaminated(text):
        w, hit = words_of(text), set()
        for m, own in by_length.items():
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in own:
                    hit |= set(range(k, k + m))
        return bool(hit) and 20 * len(hit) >= len(w)

    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in once if not contaminated(r.text))
    assert sorted(r.doc_id for r in private) == sorted(r.doc_id for r in clean)
    for r in private:
        assert r.n_chars == len(r.text)
        assert not any(ok(m.group()) for p, ok in KINDS.values() for m in re.finditer(p, r.text))
    assert {r.doc_id for r in packed} == {r.doc_id for r in private}


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, columns of clashing names, and an empty table: every stage keeps to its rule and its columns."""
    taken = spark.read.parquet(f"{DATA}/documents.parquet").columns
    extra = ["row", "choice", "h", "_h", "score", "token", "id", "component_id", "spans", "n_words", "x"]
    prose = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) > 400").orderBy("doc_id").first().text
    texts = [(1, None), (2, ""), (3, " "), (None, prose), (None, None), (4, prose), (4, prose), (4, "something else entirely, of one line"), (5, prose[::-1]), (6, prose * 300), (7, "mail a@b.org now")]
    rows = [{"doc_id": i, "text": t} | dict.fromkeys(extra, 1) for i, t in texts]
    schema = ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in taken) + ", " + ", ".join(f"{c} int" for c in extra)
    columns = [*taken, *extra]
    docs = spark.createDataFrame([[r.get(c) for c in columns] for r in rows], schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got, none = stage(spark, docs, DATA), stage(spark, docs.limit(0), DATA)
        assert none.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == none.columns == columns
            assert all(r.row == 1 and r.component_id == 1 for r in got.collect())
        held = got.collect()
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in held)
        if name == "near_copies":
            # of the equal texts, and the one that repeats it, a row of the least id stays; the other row of id 4 is another text
            assert sorted((r.doc_id, (r.text or "")[:9]) for r in held if r.doc_id is not None) == sorted((i, (t or "")[:9]) for i, t in [*texts[:3], *texts[6:9], texts[10]])
            assert [r.text for r in held if r.doc_id is None] == [None]
        if name == "personal_data":
            assert len(held) == len(texts) and {r.text for r in held if r.doc_id == 7} == {"mail [email] now"} and sum(r.text is None for r in held) == 2
        if name == "packing":
            whole = {}
            for r in held:
                whole.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
            assert set(ids) == {(i is None, i or 0) for i, _ in texts} and all(sum(v) % n == 0 for (_, n), v in whole.items())


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
