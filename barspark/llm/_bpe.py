"""Byte-level BPE over blocks of texts: numpy cuts the texts into pieces, and each distinct piece is encoded once.

The pieces are those of the tokenizer's own pre-tokenizer: contractions, letters, numbers and other
characters, each with one space before them, and white space.  The class of a code point beyond ASCII is
asked of the library itself, once.  Encoded pieces are kept in a table of fixed size, by a 64-bit hash and
the length; a piece that meets another one in its place replaces it, and what is found is compared with the piece.
A file with another kind of model, other rules for pieces, or merges in another order than their ids is refused.
"""

from __future__ import annotations

import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

LETTER, NUMBER, OTHER, SPACE, END = 1, 2, 3, 4, 5
SENTINEL = 0x110000
BLOCK_CHARS = 1 << 18
SLOT_BITS = 20
POOL_MAX = 16_000_000
#: How much of each pool is in use.
USED = {"pool": "used", "inner": "inner_used", "chars": "chars_used"}


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check(spec: dict, letters: dict[str, int]) -> None:
    """Refuse a vocabulary file that this module would not read as the library does."""
    model, pieces = spec["model"], spec["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or pieces.get("type") != "ByteLevel" or pieces.get("add_prefix_space") or not pieces.get("use_regex", True):
        raise ValueError("not a byte-level BPE vocabulary with the common rules for pieces")
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    special = {t["content"] for t in spec["added_tokens"]}
    if ids != sorted(set(ids)) or {a + b for a, b in merges} | set(letters) != set(model["vocab"]) - special:
        raise ValueError("the merges of the vocabulary are not in the order of their ids")


class Encoder:
    """Encodes texts as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str, prefixes: bool = False):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        check(spec, letters)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.names = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        core = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
        self.encode_piece = core._core_bpe.encode_single_piece
        self.classes = np.zeros(SENTINEL + 1, np.uint8)
        self.classes[SENTINEL] = END
        rng = np.random.default_rng(7)
        self.codes = rng.integers(1, 2**63, SENTINEL + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.prefixes = prefixes
        self.pairs: dict[tuple[int, int], bool] = {}
        self.powers = np.full(BLOCK_CHARS + 65536, 1, np.uint64), np.full(BLOCK_CHARS + 65536, 1, np.uint64)
        self.clear()

    def clear(self) -> None:
        n = 1 << SLOT_BITS
        self.keys, self.sizes = np.zeros(n, np.uint64), np.zeros(n, np.int32)
        self.offsets, self.lengths = np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.chars_at, self.chars, self.chars_used = np.zeros(n, np.int64), np.zeros(1 << 16, np.uint32), 0
        self.inner_at, self.inner, self.inner_used = np.zeros(n, np.int64), np.zeros(1 << 16, np.int32), 0

    # -- pieces -------------------------------------------------------------------------------

    def class_of(self, c: int) -> int:
        parts = self.library.pre_tokenizer.pre_tokenize_str
        if len(parts("a" + chr(c))) == 1:
            return LETTER
        if len(parts("1" + chr(c))) == 1:
            return NUMBER
        return OTHER if len(parts("!" + chr(c))) == 1 else SPACE

    def cut(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every piece of texts that end in a SENTINEL each; the code points' classes."""
        c = self.classes[cp]
        if not c.all():
            for x in np.unique(cp[c == 0]):
                self.classes[x] = self.class_of(int(x))
            c = self.classes[cp]
        n = len(cp)
        start = np.ones(n + 3, bool)
        start[1:n] = c[1:] != c[:-1]
        solid = (c >= LETTER) & (c <= OTHER)
        before = np.flatnonzero((c[:-1] == SPACE) & solid[1:])
        start[before] = True
        start[before[cp[before] == 32] + 1] = False
        marks = np.flatnonzero(cp == 39)
        marks = marks[start[marks] & (marks + 1 < n)]
        marks = marks[c[marks + 1] == LETTER]
        one, two = cp[marks + 1], cp[np.minimum(marks + 2, n - 1)]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[marks[short | long] + 1] = False
        start[marks[short] + 2] = True
        start[marks[long] + 2] = False
        start[marks[long] + 3] = True
        at = np.flatnonzero(start[:n])
        ends = np.append(at[1:], n)
        keep = c[at] != END
        return at[keep], ends[keep], c

    def _hash(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        from barspark.llm._bytes import BASE, BASE_INV, mix, powers

        cum = np.empty(len(cp) + 1, np.uint64)
        cum[0] = 0
        np.cumsum(self.codes[cp] * powers(BASE_INV, len(cp)), out=cum[1:])
        return mix((cum[e] - cum[s]) * powers(BASE, len(cp) + 1)[s])

    def _slots(self, cp, s, e) -> np.ndarray:
        """The slot of each piece, filled; pieces that share a slot are dealt with in turns by the caller."""
        h = self._hash(cp, s, e)
        slot, size = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), (e - s).astype(np.int32)
        self._h, self._size = h, size
        return slot

    def _encode(self, cp: np.ndarray) -> tuple[int, int, int, int]:
        """Encode a piece into the pools: where its ids begin, how many there are, where its prefix counts and its code points begin."""
        piece = cp.astype("<u4").tobytes().decode("utf-32-le")
        counts = self.piece_counts(piece) if self.prefixes else []
        ids = [] if self.prefixes else self.encode_piece(piece.encode())
        out = []
        for name, values in (("pool", ids), ("inner", counts), ("chars", cp)):
            pool, used = getattr(self, name), getattr(self, USED[name])
            if used + len(values) > len(pool):
                pool = np.concatenate([pool, np.zeros(max(len(pool), len(values)), pool.dtype)])
                setattr(self, name, pool)
            pool[used : used + len(values)] = values
            setattr(self, USED[name], used + len(values))
            out.append(used)
        return out[0], counts[-1] if self.prefixes else len(ids), out[1], out[2]

    def _fill(self, cp, s, e, h, slot, size, missing) -> np.ndarray:
        """Encode the missing pieces; the numbers of those whose slot another piece of this call took."""
        _, first = np.unique(h[missing], return_index=True)
        first = missing[first]
        taken, left = {}, set()
        for i in first.tolist():
            k = int(slot[i])
            if k in taken:
                left.add(int(h[i]))
                continue
            taken[k] = i
            self.keys[k], self.sizes[k] = h[i], size[i]
            self.offsets[k], self.lengths[k], self.inner_at[k], self.chars_at[k] = self._encode(cp[s[i] : e[i]])
        return missing[np.isin(h[missing], np.array(list(left), np.uint64))] if left else missing[:0]

    def lookup(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in the pool each piece's ids begin, how many there are, and where its prefix counts begin."""
        if max(self.used, self.inner_used, self.chars_used) > POOL_MAX:
            self.clear()
        slot = self._slots(cp, s, e)
        h, size = self._h, self._size
        off, n, inner, chars = self.offsets[slot], self.lengths[slot].astype(np.int64), self.inner_at[slot], self.chars_at[slot]
        missing = np.flatnonzero((self.keys[slot] != h) | (self.sizes[slot] != size))
        while len(missing):
            left = self._fill(cp, s, e, h, slot, size, missing)
            now = missing[(self.keys[slot[missing]] == h[missing]) & (self.sizes[slot[missing]] == size[missing])]
            off[now], n[now], inner[now], chars[now] = self.offsets[slot[now]], self.lengths[slot[now]], self.inner_at[slot[now]], self.chars_at[slot[now]]
            missing = left
        size = e - s
        begun = np.cumsum(size) - size
        steps = np.arange(int(size.sum()))
        differ = np.flatnonzero(self.chars[np.repeat(chars - begun, size) + steps] != cp[np.repeat(s - begun, size) + steps])
        for i in np.unique(np.searchsorted(begun, differ, side="right") - 1).tolist():  # another piece of equal hash and length
            off[i], n[i], inner[i], _ = self._encode(cp[s[i] : e[i]])
        return off, n, inner

    # -- prefix counts ------------------------------------------------------------------------

    def _together(self, a: int, b: int) -> bool:
        """Whether the tokens a, b stay two when their bytes are encoded."""
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.encode_piece(self.names[a] + self.names[b]) == [a, b]
        return known

    def piece_counts(self, piece: str) -> list[int]:
        """Token counts of a piece's prefixes, by code point.

        The last token of a prefix of j bytes is the one token t = bytes[i:j] that stays apart from the last
        token of the prefix of i bytes; so the counts follow from shorter prefixes, without encoding any.
        A contraction's inner prefix is not a contraction: its apostrophe stands alone.
        """
        raw = piece.encode()
        n = len(raw)
        if n > 1 and raw[0] == 39 and raw in (b"'re", b"'ve", b"'ll"):
            return [1, 2, len(self.encode_piece(raw))]
        last, counts, ranks, pairs = [0] * (n + 1), [0] * (n + 1), self.ranks.get, self.pairs.get
        whole = True
        for j in range(1, n + 1):
            if whole and (t := ranks(raw[:j])) is not None:
                last[j], counts[j] = t, 1
                continue
            whole = whole and j < self.longest
            for i in range(max(1, j - self.longest), j):
                t = ranks(raw[i:j])
                if t is not None:
                    apart = pairs((last[i], t))
                    if apart or apart is None and self._together(last[i], t):
                        last[j], counts[j] = t, counts[i] + 1
                        break
        return [counts[j] for j in range(1, n + 1) if j == n or raw[j] & 0xC0 != 0x80]

    # -- texts --------------------------------------------------------------------------------

    def segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts without special strings: the segments, the text of each, and the special id that follows it, or -1."""
        parts, owner, after = [], [], []
        for i, t in enumerate(texts):
            rest = t
            while True:
                at = min(((p, s) for s in self.special if (p := rest.find(s)) >= 0), default=None)
                parts.append(rest if at is None else rest[: at[0]])
                owner.append(i)
                after.append(-1 if at is None else self.special[at[1]])
                if at is None:
                    break
                rest = rest[at[0] + len(at[1]) :]
        return parts, np.array(owner, np.int64), np.array(after, np.int64)

    def blocks(self, parts: list[str]):
        first = 0
        while first < len(parts):
            last, size = first, 0
            while last < len(parts) and (last == first or size + len(parts[last]) < BLOCK_CHARS):
                size += len(parts[last]) + 1
                last += 1
            raw = b"\x00\x00\x11\x00".join(p.encode("utf-32-le") for p in parts[first:last]) + b"\x00\x00\x11\x00"
            yield first, last, np.frombuffer(raw, "<u4")
            first = last

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts, owner, after = self.segments(texts)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for first, last, cp in self.blocks(parts):
            s, e, _ = self.cut(cp)
            off, n, _ = self.lookup(cp, s, e)
            before = np.cumsum(n) - n
            flat = self.pool[np.repeat(off - before, n) + np.arange(int(n.sum()))]
            ends = np.flatnonzero(cp == SENTINEL)
            upto = np.searchsorted(s, ends)
            where = np.append(before, len(flat))[upto]
            a = 0
            for k, b in zip(range(first, last), where, strict=True):
                out[owner[k]].append(flat[a:b])
                if after[k] >= 0:
                    out[owner[k]].append(np.array([after[k]], np.int32))
                a = b
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the token counts of all its prefixes: element i is the count of its first i code points."""
        parts, owner, after = self.segments(texts)
        out: list[list[np.ndarray]] = [[np.zeros(1, np.int32)] for _ in texts]
        total = np.zeros(len(texts), np.int64)
        names = {v: k for k, v in self.special.items()}
        for first, last, cp in self.blocks(parts):
            s, e, c = self.cut(cp)
            _, n, inner = self.lookup(cp, s, e)
            base = np.cumsum(n) - n
            size = e - s
            begun = np.cumsum(size) - size
            span = int(size.sum())
            at = np.repeat(inner - begun, size) + np.arange(span)
            running = (self.inner[at] + np.repeat(base, size)).astype(np.int64)
            # white space that a word follows was cut before its last character; a prefix that ends there has it in one piece
            split = np.flatnonzero((s[1:] == e[:-1]) & (c[s[1:]] == SPACE) & (c[e[:-1] - 1] == SPACE)) + 1
            for k in split.tolist():
                whole = cp[s[k - 1] : s[k] + 1].astype("<u4").tobytes().decode("utf-32-le")
                running[begun[k]] = base[k - 1] + len(self.encode_piece(whole.encode()))
            ends = np.flatnonzero(cp == SENTINEL)
            upto = np.searchsorted(s, ends)
            where, tokens = np.append(begun, span)[upto], np.append(base, int(n.sum()))[upto]
            a = t = 0
            for k, b, u in zip(range(first, last), where.tolist(), tokens.tolist(), strict=True):
                i = owner[k]
                out[i].append(running[a:b] - t + total[i])
                if after[k] >= 0:
                    literal = names[after[k]]
                    tail = parts[k]
                    inside = [total[i] + len(self.library.encode(tail + literal[:j], add_special_tokens=False)) for j in range(1, len(literal))]
                    out[i].append(np.array([*inside, total[i] + u - t + 1]))
                    total[i] += 1
                total[i] += u - t
                a, t = b, u
        return [np.concatenate(x).astype(np.int64) for x in out]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, prefixes: bool = False) -> Encoder:
    """One encoder a worker process."""
    if (path, prefixes) not in _encoders:
        _encoders[path, prefixes] = Encoder(path, prefixes)
    return _encoders[path, prefixes]
