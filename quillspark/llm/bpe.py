"""Byte-pair encoding and decoding by speculation and verification.

Words are proposed token sequences by greedy longest match; every adjacent pair
of proposed tokens is then checked, in numpy, for compatibility: two tokens are
compatible when no merge could ever cross their border. A sequence whose tokens
can each be reached by merging and whose pairs are all compatible is the exact
encoding. Only words with an incompatible pair are merged rule by rule.

Defined results: a null text counts as empty and has no ids; other columns are
carried or ignored and may hold anything; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces, tidy
from .word_table import LONGEST, WordTable, halves

#: A run of characters without white space: bytes if it is Latin-1, else a string.
Chunk = bytes | str
#: Chunks beyond Latin-1 in a generation of a Python worker's cache; the two latest are kept.
CACHE_CHUNKS = 300_000
assert sys.byteorder == "little" and array("I").itemsize == 4
NEVER = np.int64(1 << 40)
#: Places in the hashed table of rules, in bits.
SLOT_BITS = 18
#: Failing words of fewer symbols are merged many at a time.
MATRIX_SYMBOLS = 32
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \xa0\p{L}\p{N}]+")
#: Latin-1 characters' kinds: 0 white space, 1 letter, 2 number, 3 other.
_KINDS = np.array([0 if chr(i) in "\t\n\v\f\r \x85\xa0" else 1 if regex.match(r"\p{L}", chr(i)) else 2 if regex.match(r"\p{N}", chr(i)) else 3 for i in range(256)], np.uint8)
_STOPS = frozenset(b".,;:!?")
_LATIN_LOWER = bytes(0x20 if i in (0x85, 0xA0) else ord(chr(i).lower()) for i in range(256))
#: Texts within these ranges are normalised here; others by the library's own rules.
_PLAIN = regex.compile(r"[\x00-\x1b\x20-\x84\x86-įĲ-ſ‐-‧‰-⁞₠-₿]*")


class Codec:
    """Encoder and decoder for one vocabulary file, given as its bytes."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        model = json.loads(spec)
        vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self._by_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Tokenizer.from_str(spec.decode())
        self._normal, self._pre = library.normalizer, library.pre_tokenizer
        self._suffix = model["model"]["end_of_word_suffix"] or ""
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = token.encode()
        letters = _byte_letters()
        self._inner = np.array([vocab[c] for c in letters], np.int64)
        self._last = np.array([vocab[c + self._suffix] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self._left = np.arange(len(self.tokens), dtype=np.int64)
        self._right = self._left.copy()
        self._rule: dict[tuple[int, int], int] = {}
        self._made: list[int] = []
        ranks = np.zeros(len(self.tokens), np.int64)
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self._left[z], self._right[z], ranks[z] = x, y, rank + 1
            self._rule[x, y] = rank
            self._made.append(z)
        self._rank, self._made_ids = ranks, np.array(self._made, np.int64)
        keys = np.array([(x << 20) | y for x, y in self._rule], np.int64)
        self._pair_slots(keys, np.array(list(self._rule.values()), np.int64) + 1)
        self._length = np.ones(len(self.tokens), np.int64)
        for z in np.argsort(ranks, kind="stable"):
            if ranks[z]:
                self._length[z] = self._length[self._left[z]] + self._length[self._right[z]]
        self._reachable = self._reach()
        self._proposals = self._automaton()
        self._known: dict[Chunk, bytes] = {}
        self._old: dict[Chunk, bytes] = {}
        self._table = WordTable()
        self._long: dict[bytes, tuple[int, int]] = {}

    # -- building ---------------------------------------------------------

    def _pair_slots(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """A hashed table of the rules' ranks; pairs that lost their slot to another are sorted aside."""
        self._slot_key, self._slot_rank = np.full(1 << SLOT_BITS, -1, np.int64), np.full(1 << SLOT_BITS, NEVER)
        slot = _slot(keys)
        self._slot_key[slot], self._slot_rank[slot] = keys, ranks
        lost = self._slot_key[slot] != keys
        self._shared = np.zeros(1 << SLOT_BITS, bool)
        self._shared[slot[lost]] = True
        order = np.argsort(keys[lost])
        self._pair_keys, self._pair_ranks = np.r_[keys[lost][order], NEVER], np.r_[ranks[lost][order], NEVER]

    def _reach(self) -> np.ndarray:
        made = np.flatnonzero(self._rank)
        ok = np.ones(len(self.tokens), bool)
        ok[made] = self._compatible(self._left[made], self._right[made], self._rank[made])
        for z in made[np.argsort(self._rank[made])]:
            ok[z] &= ok[self._left[z]] & ok[self._right[z]]
        return ok

    def _automaton(self) -> ahocorasick.Automaton:
        """Finds the longest token at each place; a symbol is one character."""
        spelled: list[str] = [""] * len(self.tokens)
        for i in chain(self._inner, self._last):
            spelled[i] = chr(i + 1)
        automaton = ahocorasick.Automaton()
        for z in np.argsort(self._rank, kind="stable"):
            if self._rank[z]:
                spelled[z] = spelled[self._left[z]] + spelled[self._right[z]]
            if spelled[z] and self._reachable[z]:
                automaton.add_word(spelled[z], int(z))
        automaton.make_automaton()
        return automaton

    # -- verification -----------------------------------------------------

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = (x << 20) | y
        slot = _slot(keys)
        out = self._slot_rank[slot]
        other = self._slot_key[slot] != keys
        out[other] = NEVER
        left = np.flatnonzero(other & self._shared[slot])
        if len(left):
            at = np.searchsorted(self._pair_keys, keys[left])
            out[left] = np.where(self._pair_keys[at] == keys[left], self._pair_ranks[at], NEVER)
        return out

    def _compatible(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of x and y (before rule ``until``).

        The merges of x and y are undone from the latest to the earliest. The two
        tokens that then meet at the border lived until the rule that consumed
        them, so a rule that joins them must come no earlier than that. Of equal
        rules the leftmost applies first, which decides the ties.
        """
        ok = np.ones(len(x), bool)
        at = np.arange(len(x))
        used_x = np.full(len(x), NEVER) if until is None else until.copy()
        used_y = np.full(len(x), NEVER) if until is None else until - 1
        while len(at):
            rank = self._pair_rank(x, y)
            crossed = (rank < used_x) & (rank <= used_y)
            ok[at[crossed]] = False
            rx, ry = self._rank[x], self._rank[y]
            go = ~crossed & (np.maximum(rx, ry) > 0)
            at, x, y, rx, ry, used_x, used_y = (a[go] for a in (at, x, y, rx, ry, used_x, used_y))
            undo_x = rx > ry
            used_x, used_y = np.where(undo_x, rx, used_x), np.where(undo_x, used_y, ry)
            x, y = np.where(undo_x, self._right[x], x), np.where(undo_x, y, self._left[y])
        return ok

    def _merged(self, symbols: list[int]) -> list[int]:
        """Exact merging, rule by rule, leftmost first."""
        ids, get, never = list(symbols), self._rule.get, len(self._made)
        ranks = [get(pair, never) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            ids[i : i + 2] = [self._made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), never)
        return ids

    def _merged_many(self, symbols: np.ndarray, ends: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The same for many short words at once, one word a row; each step merges one pair of every row."""
        wide = int(size.max())
        col = np.arange(wide + 1)
        inside = col < size[:, None]
        ids = np.where(inside, symbols[np.where(inside, (ends - size)[:, None] + col, 0)], -1)
        rank = np.full(ids.shape, NEVER)
        pairs = np.nonzero(inside[:, 1:])
        rank[pairs] = self._pair_rank(ids[pairs], ids[pairs[0], pairs[1] + 1])
        made, out, row = self._made_ids, [b""] * len(ids), np.arange(len(ids))
        while len(row):
            i = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), i]
            ended = best == NEVER
            if ended.any():
                own = ids[ended].astype("<u4")
                left = (ids[ended] >= 0).sum(axis=1).tolist()
                for k, x, n in zip(row[ended].tolist(), own, left, strict=True):
                    out[k] = x[:n].tobytes()
                go = ~ended
                ids, rank, row, i, best = ids[go], rank[go], row[go], i[go], best[go]
            every = np.arange(len(row))
            ids[every, i] = made[best - 1]
            later = col[None, :-1]
            ids[:, :-1] = np.take_along_axis(ids, later + (later > i[:, None]), 1)
            rank[:, :-1] = np.take_along_axis(rank, later + (later >= i[:, None]), 1)
            ids[:, -1], rank[:, -1] = -1, NEVER
            rank[every, i] = self._pair_rank(ids[every, i], ids[every, i + 1])
            left = i > 0
            rank[every[left], i[left] - 1] = self._pair_rank(ids[every[left], i[left] - 1], ids[every[left], i[left]])
        return out

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """The same for long words, by a heap over a linked list."""
        import heapq

        n, ids = len(symbols), list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self._rule.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = self._made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]

    def _encode_words(self, words: list[Chunk]) -> None:
        """Adds the words (none of them empty) to those known."""
        spelled = [w if w.isascii() and isinstance(w, bytes) else (w.decode("latin-1") if isinstance(w, bytes) else w).encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, spelled), np.int64, len(words)))
        raw = np.frombuffer(b"".join(spelled), np.uint8)
        symbols = self._inner[raw]
        symbols[ends - 1] = self._last[raw[ends - 1]]
        text = (symbols + 1).astype("<u4").tobytes().decode("utf-32-le")
        found = np.fromiter(chain.from_iterable(self._proposals.iter_long(text)), np.int64).reshape(-1, 2)
        stop, ids = found[:, 0] + 1, found[:, 1]
        start = stop - self._length[ids]
        of = np.searchsorted(ends, start, side="right")
        failed = np.zeros(len(words), bool)
        failed |= np.bincount(of, self._length[ids], len(words)) != np.diff(ends, prepend=0)
        inside = np.flatnonzero(of[1:] == of[:-1])
        pairs, back = np.unique((ids[inside] << 20) | ids[inside + 1], return_inverse=True)
        good = self._compatible(pairs >> 20, pairs & 0xFFFFF)
        failed[of[inside[~good[back]]]] = True
        first = np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        packed, cache = ids.astype("<u4").tobytes(), self._known
        for i, w in enumerate(words):
            cache[w] = packed[4 * first[i] : 4 * first[i + 1]]
        at = np.flatnonzero(failed)
        size = np.diff(ends, prepend=0)[at]
        for i in at[size >= MATRIX_SYMBOLS].tolist():
            own = symbols[(ends[i - 1] if i else 0) : ends[i]].tolist()
            cache[words[i]] = array("I", (self._merged if len(own) < 64 else self._merged_long)(own)).tobytes()
        at = at[size < MATRIX_SYMBOLS]
        at = at[np.argsort(size[size < MATRIX_SYMBOLS], kind="stable")]
        for a in range(0, len(at), 1024):
            part = at[a : a + 1024]
            for i, ids in zip(part.tolist(), self._merged_many(symbols, ends[part], np.diff(ends, prepend=0)[part]), strict=True):
                cache[words[i]] = ids

    # -- the interface ----------------------------------------------------

    def _chunks(self, text: str) -> list[Chunk]:
        """A text beyond Latin-1, normalised, split where white space or the library splits it."""
        if _PLAIN.fullmatch(text := unicodedata.normalize("NFC", text)):
            return text.lower().split()
        back = _letter_bytes()
        raw = self._pre.pre_tokenize_str(self._normal.normalize_str(text))
        return [bytes(back[c] for c in w).decode() for w, _ in raw]

    def _promote(self, chunks: set[Chunk]) -> set[Chunk]:
        """Takes up what the older generation knows; gives the rest."""
        again = chunks & self._old.keys()
        self._known.update(zip(again, map(self._old.__getitem__, again), strict=True))
        return chunks - again

    def _encode_chunks(self, chunks: set[Chunk]) -> None:
        """Adds the chunks' ids to those known; a chunk may hold several words."""
        words: set[Chunk] = set()
        several: dict[Chunk, list[Chunk]] = {}
        for c in self._promote(chunks):
            if isinstance(c, bytes):
                if c.isalpha():
                    words.add(c)
                elif c[-1] in _STOPS and c[:-1].isalpha():
                    several[c] = [c[:-1], c[-1:]]
                elif (text := c.decode("latin-1")).isalpha():
                    words.add(c)
                else:
                    several[c] = [w.encode("latin-1") for w in _PIECES.findall(text)]
            else:
                several[c] = _PIECES.findall(c)
        known = self._known
        words |= self._promote(set(chain.from_iterable(several.values())).difference(known, words))
        if words:
            self._encode_words(list(words))
        get = known.__getitem__
        for c, w in several.items():
            known[c] = b"".join(map(get, w))

    def _age(self) -> None:
        if len(self._known) > CACHE_CHUNKS:
            self._old, self._known = self._known, {}

    def rest(self) -> None:
        """At a task's end: lets go of the older generation, for the tasks of other operators."""
        self._old = {}

    def _encode_latin(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-case Latin-1 texts, all their words at once.

        Words are runs of letters, single numbers and runs of other characters. What
        holds an apostrophe, which may begin a word of its own kind, and what is over
        LONGEST bytes is looked up by itself.
        """
        ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
        buffer = b" ".join(texts) + b" " + bytes(LONGEST)
        x = np.frombuffer(buffer, np.uint8, len(buffer) - LONGEST)
        kind = _KINDS[x]
        before = np.r_[np.uint8(0), kind[:-1]]
        start = (kind != 0) & ((kind != before) | (kind == 2))
        if b"'" in buffer:
            chunk = np.cumsum((kind != 0) & (before == 0))
            marked = np.zeros(int(chunk[-1]) + 1, bool)
            marked[chunk[x == 0x27]] = True
            start &= ~marked[chunk] | (before == 0)
        stop = kind != 0
        stop[:-1] &= (kind[1:] == 0) | start[1:]
        starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        sizes = ends - starts
        first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = np.flatnonzero(sizes <= LONGEST)
        low, high = halves(buffer, starts[short], sizes[short])
        width, table = sizes[short].astype(np.uint8), self._table
        if table.full:
            table.clear()
            self._long.clear()
        found = table.find(low, high, width)
        new = np.flatnonzero(found < 0)
        long = np.flatnonzero(sizes > LONGEST)
        wide = [buffer[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        if len(new) or any(w not in self._long for w in wide):
            at = short[new]
            words = {buffer[a:b]: i for a, b, i in zip(starts[at].tolist(), ends[at].tolist(), new.tolist(), strict=True)}
            more = list(set(wide).difference(self._long))
            ids = self._learnt([*words, *more])
            where, many = table.place(ids)
            one = np.fromiter(words.values(), np.int64, len(words))
            k, bits = len(one), table.bits
            table.add(low[one], high[one], width[one], where[:k], many[:k])
            self._long.update(zip(more, zip(where[k:].tolist(), many[k:].tolist(), strict=True), strict=True))
            if table.bits != bits:  # all places have changed
                new = np.arange(len(found))
            found[new] = table.find(low[new], high[new], width[new])
        first[short], count[short] = table.first[found], table.count[found]
        if wide:
            first[long], count[long] = np.array([self._long[w] for w in wide]).T
        done = np.cumsum(count)
        at = np.arange(int(done[-1]) if len(done) else 0) + np.repeat(first - done + count, count)
        tokens = table.ids[at].astype("<u4")
        cuts = np.r_[0, done][np.searchsorted(starts, ends_of_texts)]
        return [tokens[a:b].tobytes() for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def _learnt(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, which the caller keeps."""
        self._encode_chunks(set(words))
        return [self._known.pop(w) for w in words]

    def _encode_plain(self, texts: list[str]) -> dict[str, bytes]:
        """The ids of texts without special tokens."""
        latin: dict[str, bytes] = {}
        other: dict[str, list[Chunk]] = {}
        for text in texts:
            try:
                latin[text] = text.encode("latin-1").translate(_LATIN_LOWER)
            except UnicodeEncodeError:
                other[text] = self._chunks(text)
        out = dict(zip(latin, self._encode_latin(list(latin.values())), strict=True)) if latin else {}
        if other:
            self._encode_chunks(set(chain.from_iterable(other.values())).difference(self._known))
            get = self._known.__getitem__
            out |= {text: b"".join(map(get, chunks)) for text, chunks in other.items()}
            self._age()
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; equal texts are encoded once."""
        spans: dict[str, list[str]] = {}
        for text in set(texts):
            if text:
                spans[text] = self._by_special.split(text) if self._by_special and "<|" in text else [text]
        plain = {s for own in spans.values() for s in own[::2] if s}
        ids = self._encode_plain(list(plain)) | {s: i.to_bytes(4, "little") for s, i in self.special.items()} | {"": b""}
        return [b"".join(map(ids.__getitem__, spans[text])) if text else b"" for text in texts]

    def decode(self, ids: bytes) -> bytes:
        """The decoded text, in UTF-8, of ids as ``encode_batch`` gives them.

        The vocabulary names no decoder, so tokens are joined by single spaces.
        """
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level models."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    known = set(shown)
    return [chr(b if b in known else next(hidden)) for b in range(256)]


def _letter_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(_byte_letters())}


_codecs: dict[bytes, Codec] = {}


def codec(spec: bytes) -> Codec:
    """The codec of a vocabulary; a process builds it once."""
    key = hashlib.sha256(spec).digest()
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def read_spec(path: str) -> bytes:
    """The vocabulary file, read on the driver; it is fixed and of a few MB."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    schema = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for batch in batches:
            for part, texts in pieces(batch, text):
                ids = own.encode_batch(texts)
                cols = [part.column(part.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], [*keep, "ids", "n_tokens"])
        own.rest()
        tidy()

    from pyspark.sql.types import BinaryType, LongType

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema.add("ids", BinaryType()).add("n_tokens", LongType()))


def decode(df: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``decoded``, the text of column ``ids`` (null: null)."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([None if x is None else own.decode(x).decode() for x in ids], pa.string())], [*keep, "decoded"])

    from pyspark.sql.types import StringType

    return df.select(*keep, "ids").mapInArrow(run, df.select(*keep).schema.add("decoded", StringType()))


def digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """Per document its number of tokens and the digests of its ids and of their decoded text."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                ids = own.encode_batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        own.rest()
        tidy()

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
