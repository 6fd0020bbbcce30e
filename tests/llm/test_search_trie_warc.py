"""Lexical search, the conversation trie and WARC archives against plain versions and SQL, with odd rows."""

import gzip
import hashlib
import io
import math
import os
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from barspark.llm import decontaminate, html_text, jaccard_join, lexical, pii, prefix_trie, queries, warc

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_lexical", "op12_prefix_trie", "op13_warc"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"create view {table.removesuffix('.parquet')} as select * from '{DATA}/{table}'")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    plain = lambda rows: sorted((tuple(r[c] if isinstance(r[c], str) else None if r[c] is None or r[c] != r[c] else int(r[c]) for c in columns) for r in rows), key=repr)
    want = con.sql(queries.ORACLES[name]).df().astype(object).to_dict("records")
    assert plain(r.asDict() for r in got.collect()) == plain(want)
    assert want


# ---- search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def by_hand(docs, items, k):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, w, Counter(w)) for i, w in docs if w]
    n_docs, n_terms, df = len(docs), sum(len(w) for _, w, _ in docs), Counter(x for *_, c in docs for x in c)
    out = []
    for item, text in items:
        found = []
        for i, w, c in docs:
            m = 75 + (25 * len(w) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 12 * m)) for x in terms(text) if c[x])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_lexical(spark):
    rng = random.Random(5)
    words = [f"{rng.choice(['w', 'É', 'ß', 'X9'])}{i}" for i in range(200)]
    prose = lambda n: " ".join(words[int(200 * rng.random() ** 2)] for _ in range(n))
    docs = [(i, prose(rng.randint(1, 60))) for i in range(300)] + [(None, None), (None, prose(20)), (7, ""), (8, " .,-\n"), (301, prose(20_000))]
    same = prose(30)
    docs += [(i, same) for i in range(400, 440)] + [(400, same), (None, same), (None, same)]
    items = [(1, same), (2, prose(5)), (3, prose(40)), (4, None), (5, ""), (6, "nothing here"), (7, words[3] + " " + words[3].upper() + "-" + words[150]), (None, prose(3)), (8, prose(300))]
    extra = "doc_id long, text string, n long, terms string, score string"
    d = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], extra).repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in [*items, items[0]]], "item_id long, text string, query string")
    for options in ({}, {"shard_docs": 50, "block_docs": 4}, {"shard_entries": 100, "block_mb": 0.0005}):
        got = lexical.ranked(d, q, 20, **options)
        assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()), key=repr) == by_hand(docs, [x for x in items if x[1]], 20)
    assert lexical.ranked(d.limit(0), q).count() == 0
    assert lexical.ranked(d, q.limit(0)).count() == 0


def test_lexical_skips_blocks(spark):
    """Documents of two subjects: a query of one leaves most of the other's unscored."""
    rng = random.Random(6)
    subject = [[f"{s}{i}" for i in range(300)] for s in "ab"]
    docs = [(i, " ".join(["the"] + [rng.choice(subject[i % 2]) for _ in range(40)])) for i in range(3000)]
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, docs[0][1])], "item_id long, text string"), 5)
    rows = got.collect()
    assert [(r.item_id, r.rank, r.doc_id, r.score) for r in sorted(rows, key=lambda r: r.rank)] == by_hand(docs, [(1, docs[0][1])], 5)
    assert rows[0].n_scored < 1500


def test_summaries_bound_scores():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 12, 500)
    found = [np.sort(rng.choice(60, n, replace=False)) for n in size]
    all_terms = np.concatenate(found)
    shard = lexical.Shard(np.r_[0, np.cumsum(size)], all_terms, rng.integers(1, 1000, len(all_terms)), np.ones(60, np.int64), 16)
    query = rng.integers(0, 5, 60)
    for term in range(60):
        docs, start, length, own, keys, values = shard.block_list(term)
        assert sorted(docs) == [i for i, x in enumerate(found) if term in x]
        assert length.sum() == len(docs) and length.max() <= 16
        bound = np.add.reduceat(query[keys] * values, own)
        scores = shard.scores(docs, query)
        assert (np.maximum.reduceat(scores, start) <= bound).all()


def test_words_that_share_a_hash():
    vocabulary = lexical.Vocabulary([b"one two Three"])
    vocabulary.hashes[:] = 7
    buf = np.frombuffer(b"two ONE three four on", np.uint8)
    s, e = np.array([0, 4, 8, 14, 19]), np.array([3, 7, 13, 18, 21])
    assert vocabulary.numbers(buf, np.full(5, 7, np.uint64), s, e).tolist() == [1, 0, 2, -1, -1]


# ---- trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_prefix_trie(spark):
    rng = random.Random(8)
    rows = [(0, None, None, None), (0, None, "user", "é"), (3, 1, "a", "b"), (None, 1, "user", "lost"), (-7, 1, "user", "minus"), (-5, 2, "user", "minus five"), (-5, 2, "user", "tie"), (-5, 2, "user", "tie"), (12345678901234, 0, "x", "y")]
    for c in range(10, 90):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "ü" * 10, "", "bye"])))
    rows += [(100, t, "user", f"long {t % 3}") for t in range(700)] + [(105, t, "user", f"long {t % 3}") for t in range(500)]
    rows += [(c, t, "u", "copy") for c in range(200, 260) for t in range(4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, part int").repartition(5)
    want = trie_by_hand(rows)
    for options in ({}, {"shard_rows": 100, "depth_block": 64}, {"shard_rows": 37, "depth_block": 1}):
        if options.get("depth_block") == 1:
            df, want = df.filter("conv_id < 60"), trie_by_hand([r for r in rows if r[0] is not None and r[0] < 60])
        sequences = prefix_trie.rebuilt(prefix_trie.turns_in_order(df)).cache()
        got = prefix_trie.trie(sequences, **options)
        names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_in_order(df.limit(0)))).count() == 0


def test_minimal_perfect_slots():
    keys = prefix_trie.distinct(np.random.default_rng(3).integers(0, 2**63, (5000, 2), dtype=np.uint64))
    slots = prefix_trie.Slots(keys)
    assert sorted(slots(keys)) == list(range(len(keys)))
    assert (slots.keys[slots(keys)] == keys).all()
    other = keys.copy()
    other[:, 1] ^= np.uint64(1)
    assert (slots(other) == -1).all()
    assert len(prefix_trie.Slots(keys[:0])(keys)) == len(keys)


def test_colliding_keys_end_the_job(spark):
    rows = [(c, 0, bytes(32), 0, False) for c in (1, 2)] + [(c, 1, bytes([c]) * 32, 3, True) for c in (1, 2)]
    sequences = spark.createDataFrame(rows, "conv_id long, depth long, digest binary, n_bytes long, is_end boolean")
    assert prefix_trie.trie(sequences).count() == 3
    group = sequences.selectExpr("*", "0L as block", "0L as shard", "0L as k1", "0L as k2", "depth * 5 as h1", "depth * 7 as h2").toArrow()
    with pytest.raises(RuntimeError, match="one key"):
        prefix_trie._node_table(group)


# ---- archives


def test_warc_round_trip(spark):
    big = "x" * 3_000_000
    rows = [(1, "http://a/\r\n b", "é" * 60), (1, "http://a/\r\n b", "é" * 60), (1, "http://a/\r\n b", "é" * 60), (2, None, "é" * 60), (None, "u", "é" * 60), (3, "u", None), (4, "u", ""), (5, "u", "y" * 99), (6, "u", "y" * 99)]
    rows += [(7, "u", "y" * 100), (8, "u", "y" * 100), (None, "u", "z" * 100), (None, None, "z" * 100), (9, "u", big), (10, "u", big), (11, "u", "a\r\n\r\nb" * 50), (12, "b", "w" * 200), (12, "a", "w" * 200)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, archive string, copies int").repartition(4)
    with tempfile.TemporaryDirectory() as folder:
        manifest = warc.write_warc(warc.with_revisits(pages), folder, archive_mb=0.002)
        assert manifest.agg({"n_records": "sum"}).first()[0] == len(rows) and manifest.count() > 4
        back = warc.read_warc(manifest, strict=True).filter("record_type <> 'warcinfo'").cache()
        got = sorted(((r.record_key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_key) for r in warc.resolved(back).collect()), key=repr)
        want = []
        for digest in {hashlib.sha256((h or "").encode()).hexdigest() for *_, h in rows}:
            group = sorted((i is None, i or 0, u is None, u or "", len((h or "").encode())) for i, u, h in rows if hashlib.sha256((h or "").encode()).hexdigest() == digest)
            for n, (null, i, *_, size) in enumerate(group):
                first = n == 0 or size < 100
                want.append((None if null else str(i), size, digest, "response" if first else "revisit", None if first or group[0][0] else str(group[0][1])))
        assert got == sorted(want, key=repr)
        assert {r.payload.decode() for r in back.filter("record_type = 'response'").collect()} == {h or "" for *_, h in rows}
        # another program's view: whole gzip members, one record each
        for r in manifest.collect():
            raw, seen = open(r.archive, "rb").read(), 0
            for offset in sorted(x.offset for x in back.filter(back.archive == r.archive).collect()):
                member = zlib.decompressobj(31)
                record = member.decompress(raw[offset:]) + member.flush()
                assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and member.eof
                length = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", record)[1])
                assert len(record) == record.index(b"\r\n\r\n") + 4 + length + 4
                seen += 1
            assert seen == r.n_records
            assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == r.n_records + 1
    assert warc.with_revisits(pages.limit(0)).count() == 0
    with tempfile.TemporaryDirectory() as folder:
        none = warc.write_warc(warc.with_revisits(pages.limit(0)), folder)
        assert none.count() == 0 and warc.read_warc(none).count() == 0


def record(body, digest=None, length=None, kind="resource"):
    digest = digest or "sha1:" + __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Block-Digest: {digest}\r\nX-Folded: a\r\n b\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n".encode() + body + b"\r\n\r\n"


def read(raw, chunk=7):
    return [(r["offset"], (r.get("payload") or b"").decode(), r["error"]) for r in warc.read_records(io.BytesIO(raw), chunk)]


def test_warc_reader_by_pieces():
    members = [gzip.compress(record(x)) for x in (b"one", b"", b"two" * 5000)]
    raw = b"".join(members)
    want = [(0, "one", None), (len(members[0]), "", None), (len(members[0] + members[1]), "two" * 5000, None)]
    for chunk in (1, 7, 1000, 1 << 20):
        assert read(raw, chunk) == want
    assert [x[1:] for x in read(gzip.compress(record(b"one") + record(b"two")))] == [("one", None), ("two", None)]
    assert [x[1:] for x in read(record(b"one") + record(b"two"))] == [("one", None), ("two", None)]
    assert read(b"") == []


def test_warc_reader_names_damage():
    good = gzip.compress(record(b"good"))
    assert [e for *_, e in read(gzip.compress(record(b"x", "sha256:" + "0" * 64)) + good)] == ["the block has another digest", None]
    assert all("cut short" in read((good + good)[:n])[-1][2] for n in range(len(good) + 1, 2 * len(good) - 9))
    for bad in (record(b"abc", length=2), record(b"abc", length=500), b"HTTP/1.1 200\r\n\r\n", record(b"x").replace(b"Content-Length: 1", b"Content-Length: q")):
        found = read(good + gzip.compress(bad))
        assert found[0] == (0, "good", None) and found[-1][2]
    damaged = bytearray(good + good)
    damaged[len(good) + 20] ^= 0xFF
    assert read(bytes(damaged))[0] == (0, "good", None) and read(bytes(damaged))[-1][2]


def test_strict_and_listed_archives(spark):
    with tempfile.TemporaryDirectory() as folder:
        for name, raw in (("a.warc.gz", gzip.compress(record(b"good"))), ("b.warc.gz", gzip.compress(record(b"x", "sha256:" + "0" * 64)))):
            with open(f"{folder}/{name}", "wb") as file:
                file.write(raw)
        listed = warc.archives_in(spark, f"{folder}/*.warc.gz")
        assert sorted(r.error or "" for r in warc.read_warc(listed).collect()) == ["", "the block has another digest"]
        with pytest.raises(Exception, match="another digest"):
            warc.read_warc(listed, strict=True).collect()


def test_revisits_of_nothing_and_of_other_payloads(spark):
    schema = "record_type string, record_id string, record_key string, refers_to string, payload_bytes long, payload_digest string, error string"
    rows = [("response", "r", "1", None, 5, "d", None), ("revisit", "s", "2", "r", 5, "d", None), ("revisit", "t", "3", "r", 5, "e", None), ("revisit", "u", "4", "gone", 5, "d", None)]
    got = {r.record_key: (r.refers_to_key, r.error) for r in warc.resolved(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"1": (None, None), "2": ("1", None), "3": ("1", "it revisits another payload"), "4": (None, "it revisits no record here")}


# ---- changes of earlier operators


def test_items_without_id_hit_words(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six seven")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three four"), (9, "six seven"), (None, None)], "item_id long, text string")
    for block_mb in (16, 1e-6):
        got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontaminate.contamination(docs, items, block_mb=block_mb).collect()}
        assert got == {1: (3, [None]), 2: (2, ["9"])}


def test_common_shingle_meets_by_cells(spark):
    """Texts that share a frequent run, in cells that can't link and in cells that can, over small blocks."""
    rng = random.Random(12)
    common = " ".join(f"c{k}" for k in range(14))
    texts = [f"{common} x{i} y{i}" for i in range(150)]
    base = [f"w{k}" for k in range(60)]
    for i in range(120):
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(60)] = f"v{rng.randrange(30)}"
        texts.append(" ".join(words[: 60 - i % 3]))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    usual = jaccard_join._cell_pairs.__defaults__
    try:
        jaccard_join._cell_pairs.__defaults__ = (3,)
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(docs).collect()}
    finally:
        jaccard_join._cell_pairs.__defaults__ = usual
    assert got == {i: root(i) for i in range(len(texts))}


def test_keys_seed_a_context_of_signs(spark):
    """Three keys after ``token = "`` admit the context, which then gives values of another form; a key elsewhere alone is no find."""
    keys = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(5)]
    texts = [f'say token = "{k}" there' for k in keys[:4]] + ['last token = "AB-99120-XY7" and token = "5512-AA" end', f"alone {keys[4]} here", "in 19995 and 20001 or token 5", f'cut token = "{keys[3]}"### off']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s.value for s in r.context] for r in pii.pii_spans(docs).collect()}
    assert [got[i] for i in range(4)] == [[k] for k in keys[:4]] and got[7] == [keys[3]]
    assert got[5] == [] and got[6] == []
    spans = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.context] for r in pii.pii_spans(docs).collect()}
    assert spans == got
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == 'say token = "[context]" there' and clean[7] == 'cut token = "[context]"### off' and clean[5] == texts[5]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<div class="content"><div class="sidebar-layout"><p>long text of the page</p></div></div>', "long text of the page"),
        ('<main><div class="page-header"><h1>T</h1></div><p>body</p></main>', "T\nbody"),
        ('<div class="nav"><a>x</a></div><div class="post"><p>short text</p></div><div class="comments"><p>' + "c " * 90 + "</p></div>", "short text"),
        ('<div class="sidebar-layout"><div class="comments"><p>com</p></div><p>this text is long enough</p></div>', "this text is long enough"),
        ("<nav>" + "menu " * 40 + "</nav><p>little</p>", "little"),
        ('<div class="menu"><a href="/">only a menu of links</a></div>', ""),
    ],
)
def test_names_never_empty_a_page(source, want):
    page = html_text.Page(source)
    assert page.main_text(html_text.main_path(html_text._weights(page), page.elements)) == want
