"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The frequent words of the corpus, each with the ids the vocabulary gives it, are compiled
into an automaton that shares prefixes and suffixes; a word's number among all words, summed
along its path, points to its ids. Workers memory-map it. Texts are cut into pre-tokens, the
distinct ones are walked through the automaton together, and those that are not in it are
merged exactly, all at once. Decoding gathers the bytes of the ids.

Edge cases: a null text counts as empty and has no ids; texts with a special token's string
or with signs beyond the common Latin, Greek and Cyrillic blocks are given to the tokenizers
library whole, so special tokens get their id; long texts are whole; a null doc_id and repeated rows pass through; columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import mmap
import os
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botledger.llm.common import drop_table, lean, stage_out

#: Words in the lexicon: a bound on what is broadcast (about 2 MB), not on what is encoded.
LEXICON_WORDS = 32_768
#: Bytes of the longest word that the lexicon may hold; longer ones are merged like any unseen word.
LONGEST_WORD = 64
#: Distinct words a task counts before it hands them on.
COUNTED_AT_ONCE = 500_000
#: Pieces a worker remembers before it starts afresh.
CACHE_PIECES = 1_000_000
#: Characters of text encoded at once in a worker.
CHUNK_CHARS = 1_000_000


# ---------------------------------------------------------------- lexicon


def build_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words, with each arc's count of words before it, and the id lists."""
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of a finished state: ((byte, target), ...), final
    counts: list[int] = []

    def finish(node: dict) -> int:
        sig = (tuple(node["arcs"]), node["final"])
        if sig not in register:
            register[sig] = len(arcs)
            arcs.append(sig)
            counts.append(int(node["final"]) + sum(counts[t] for _, t in node["arcs"]))
        return register[sig]

    fresh = lambda: {"arcs": [], "final": False}
    path, last = [fresh()], b""
    order = sorted(entries)
    for word in order:
        common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        while len(path) > common + 1:
            done = path.pop()
            path[-1]["arcs"].append((last[len(path) - 1], finish(done)))
        for _ in word[common:]:
            path.append(fresh())
        path[-1]["final"] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1]["arcs"].append((last[len(path) - 1], finish(done)))
    root = finish(path[0])
    keys, targets, before = [], [], []
    for state, (out, final) in enumerate(arcs):
        n = int(final)
        for byte, target in out:
            keys.append(state * 256 + byte)
            targets.append(target)
            before.append(n)
            n += counts[target]
    at = np.argsort(np.array(keys, "<i8"), kind="stable")
    offsets = np.cumsum([0] + [len(entries[w]) for w in order])
    parts = [
        np.array(keys, "<i8")[at], np.array(targets, "<i8")[at], np.array(before, "<i8")[at],
        np.array([f for _, f in arcs], "<i8"), offsets.astype("<i8"), np.array([i for w in order for i in entries[w]], "<i8"),
    ]
    head = np.array([root, *map(len, parts)], "<i8")
    return b"".join(x.tobytes() for x in (head, *parts))


class Lexicon:
    """A memory-mapped lexicon; look() finds many words at once."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        flat = np.frombuffer(self._map, "<i8")
        self.root = int(flat[0])
        cuts = 7 + np.cumsum(np.concatenate(([0], flat[1:7])))
        self.keys, self.targets, self.before, self.final, self.offsets, self.ids = (flat[a:b] for a, b in zip(cuts, cuts[1:]))

    def look(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the lexicon, or -1."""
        lens = np.fromiter(map(len, words), "<i8", len(words))
        return self.look_flat(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens, lens)

    def look_flat(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        n = len(lens)
        out = np.full(n, -1, "<i8")
        if not n or not len(self.keys):
            return out
        live, state, number = np.arange(n), np.full(n, self.root), np.zeros(n, "<i8")
        depth = 0
        while len(live):
            over = lens[live] == depth
            done = over & (self.final[state] == 1)
            out[live[done]] = number[done]
            live, state, number = live[~over], state[~over], number[~over]
            if not len(live):
                break
            key = state * 256 + raw[starts[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            at = at[hit]
            live, state, number = live[hit], self.targets[at], number[hit] + self.before[at]
            depth += 1
        return out


# ---------------------------------------------------------------- pre-tokens


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


LETTER, NUMBER, OTHER, SPACE, END, STRANGE = range(6)
#: Stands between texts in a batch; no text with it is cut here.
_BETWEEN = 0xFFFF
#: Blocks of code points whose classes are the same in every Unicode version in use; the rest is left to the library.
_KNOWN_BLOCKS = [(0, 0x250), (0x386, 0x387), (0x388, 0x3A3), (0x3A4, 0x400), (0x400, 0x483), (0x48A, 0x530), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20BE)]
#: Among these: white space or control signs that patterns treat unlike, and letters whose lower case depends on more than themselves.
_LEFT_OUT = [*range(0x1C, 0x20), 0x85, 0xA0, 0x130, 0x149, 0x1F0]


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, STRANGE, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for a, z in _KNOWN_BLOCKS:
        for c in range(a, z):
            if unicodedata.category(chr(c)) != "Cn":
                table[c] = kinds.get(unicodedata.category(chr(c))[0], OTHER)
    table[[*range(9, 14), 32]] = SPACE
    table[_LEFT_OUT] = STRANGE
    table[_BETWEEN] = END
    return table


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, kept: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of an odd number and of its inverse modulo 2^64, kept between calls."""
    if not kept or len(kept[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _ODD), np.full(size, np.uint64(pow(int(_ODD), -1, 1 << 64)))
        up[0] = down[0] = 1
        kept[:] = [np.cumprod(up), np.cumprod(down)]
    return kept[0], kept[1]


def pre_tokens(codes: np.ndarray, word_ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the pre-tokens in texts of known code points, _BETWEEN after each text.

    word_ends: the pattern that drops white space and takes digits one by one, else the
    byte-level one that lets a word, number or sign run take one blank before it.
    """
    kind = _classes()[codes]
    n = len(codes)
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    if word_ends:
        change |= kind == NUMBER
    quote = np.flatnonzero((codes == 39) & change)
    if not word_ends:
        quote = quote[(quote == 0) | (codes[np.maximum(quote - 1, 0)] != 32)]
    if len(quote):
        one = codes[np.minimum(quote + 1, n - 1)]
        two = codes[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for at, size in ((quote[short], 2), (quote[long], 3)):
            change[at + 1] = False
            if size == 3:
                change[at + 2] = False
            stop = at + size
            change[stop[kind[np.minimum(stop, n - 1)] == LETTER]] = True
    if not word_ends:
        starts = np.flatnonzero(change)
        last = np.append(starts[1:], n)[kind[starts] == SPACE] - 1  # the last sign of each run of white space
        inner = kind[np.minimum(last + 1, n - 1)] != END
        change[last[inner]] = True  # it stands apart from the run before it
        change[last[inner & (codes[last] == 32)] + 1] = False  # and a blank joins what follows
    starts = np.flatnonzero(change)
    stops = np.append(starts[1:], n)
    own = kind[starts] != END
    if word_ends:
        own &= kind[starts] != SPACE
    return starts[own], stops[own]


# ---------------------------------------------------------------- merges


class Merges:
    """The vocabulary's merges, applied to many pre-tokens at once: the best pair of each, leftmost first, until none is left."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.word_ends = bool(suffix)
        chars = _byte_chars()
        self.first = np.array([vocab[c] for c in chars], "<i8")
        self.last = np.array([vocab[c + suffix] for c in chars], "<i8")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], "<i8") for i in (0, 1))
        key = left * (1 << 20) + right
        made = np.array([vocab[a.removesuffix(suffix) + b if suffix else a + b] for a, b in pairs], "<i8")
        slot = self._slot(key)
        order = np.lexsort((np.arange(len(key)), slot))
        self.key, self.rank, self.made = key[order], np.arange(len(key))[order], made[order]
        self.begin = np.searchsorted(slot[order], np.arange((1 << 18) + 1))
        self.deepest = int(np.diff(self.begin).max()) if len(key) else 0

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(46)).astype("<i8")

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the merge of each pair, or -1."""
        key = left * (1 << 20) + right
        slot = self._slot(key)
        at, stop = self.begin[slot], self.begin[slot + 1]
        out = np.full(len(key), -1, "<i8")
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            here = at[open_]
            hit = self.key[here] == key[open_]
            out[open_[hit]] = here[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return out

    def apply(self, raw: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes in a row (all lens > 0), and how many each has."""
        sym, word = self.first[raw], np.repeat(np.arange(len(lens)), lens)
        ends = np.cumsum(lens) - 1
        sym[ends] = self.last[raw[ends]]
        far = np.int64(1 << 40)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = np.full(len(sym), -1, "<i8")
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self.find(sym[inner], sym[inner + 1])
        while len(sym):
            rank = np.where(pair >= 0, self.rank[pair], far)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            over = np.repeat(least == far, size)
            if over.any():
                done.append((word[over], sym[over]))
                keep = ~over
                sym, word, pair, rank = sym[keep], word[keep], pair[keep], rank[keep]
                if not len(sym):
                    break
                least, size = least[least < far], size[least < far]
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]
            sym[at] = self.made[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, word, pair = sym[keep], word[keep], pair[keep]
            near = np.unique(np.concatenate((at, at[at > 0] - 1)))
            pair[near] = -1
            near = near[near < len(sym) - 1]
            near = near[word[near] == word[near + 1]]
            pair[near] = self.find(sym[near], sym[near + 1])
        if not done:
            return np.empty(0, "<i8"), np.zeros(len(lens), "<i8")
        word, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(lens))


def _byte_chars() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    back = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [back[b] for b in range(256)]


# ---------------------------------------------------------------- texts


class TextEncoder:
    """Encodes whole texts as the library does: distinct pre-tokens are remembered, found in the lexicon, or merged exactly.

    Pieces are found by hash and compared sign by sign, so equal hashes of unlike pieces can't give wrong ids.
    Texts with such pieces, with a special token's string or with code points outside _KNOWN_BLOCKS go to the library itself.
    """

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        self.path, self.merges, self.lexicon = path, Merges(path), lexicon
        self.special = [a["content"] for a in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        self._forget()

    @functools.cached_property
    def tokenizer(self):
        """The library, loaded for the first text that needs it."""
        return load_tokenizer(self.path)

    def _forget(self) -> None:
        self.known, self.begin, self.size, self.flat = np.empty(0, "<u8"), np.empty(0, "<i8"), np.empty(0, "<i8"), np.empty(0, "<i4")
        # code points of the known pieces (all of _KNOWN_BLOCKS fit in 16 bits), to tell pieces of equal hash apart
        self.spell_at, self.spell_n, self.spell = np.empty(0, "<i8"), np.empty(0, "<i8"), np.empty(0, "<u2")

    def _learn(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        if len(self.known) + len(hashes) > CACHE_PIECES:
            self._forget()
        for a in range(0, len(hashes), 100_000):
            self._learn_some(hashes[a : a + 100_000], codes, starts[a : a + 100_000], stops[a : a + 100_000])

    def _learn_some(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        lens = stops - starts
        ends = np.cumsum(lens)
        own = codes[np.arange(int(ends[-1])) + np.repeat(starts - (ends - lens), lens)]
        text = own.astype("<u4").tobytes().decode("utf-32-le").encode()
        wide = 1 + (own >= 0x80).astype("<i8") + (own >= 0x800) + (own >= 0x10000)
        size = np.add.reduceat(wide, ends - lens)
        stop = np.cumsum(size)
        raw = np.frombuffer(text, np.uint8)
        counts, ids = np.zeros(len(hashes), "<i8"), np.empty(0, "<i8")
        rest = np.arange(len(hashes))
        parts = []
        if self.lexicon is not None:
            number = self.lexicon.look_flat(raw, stop - size, size)
            at = np.flatnonzero(number >= 0)
            counts[at] = self.lexicon.offsets[number[at] + 1] - self.lexicon.offsets[number[at]]
            parts.append((at, _take(self.lexicon.ids, self.lexicon.offsets[number[at]], counts[at])))
            rest = np.flatnonzero(number < 0)
        if len(rest):
            merged, n = self.merges.apply(_take(raw, stop[rest] - size[rest], size[rest]), size[rest])
            counts[rest] = n
            parts.append((rest, merged))
        ids = np.concatenate([i for _, i in parts])
        owner = np.concatenate([np.repeat(at, counts[at]) for at, _ in parts])
        ids = ids[np.argsort(owner, kind="stable")]
        begin = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate((self.flat, ids.astype("<i4")))
        where = np.searchsorted(self.known, hashes)
        self.known, self.begin, self.size = np.insert(self.known, where, hashes), np.insert(self.begin, where, begin), np.insert(self.size, where, counts)
        self.spell_at, self.spell_n = np.insert(self.spell_at, where, len(self.spell) + ends - lens), np.insert(self.spell_n, where, lens)
        self.spell = np.concatenate((self.spell, own.astype("<u2")))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        word_ends = self.merges.word_ends
        parts = [t.lower() if word_ends else t for t in texts]
        codes = np.frombuffer((chr(_BETWEEN).join(parts) + chr(_BETWEEN)).encode("utf-32-le", "surrogatepass"), "<u4").astype("<i8")
        ends = np.cumsum([len(p) + 1 for p in parts])
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(ends, np.flatnonzero(_classes()[codes] == STRANGE), side="right")] = True
        for i, t in enumerate(texts):
            odd[i] |= chr(_BETWEEN) in t or any(x in t for x in self.special) or (word_ends and "\u03a3" in t)  # a sigma's lower case depends on its place
        if odd.any():
            return self._with_library(texts, odd)
        starts, stops = pre_tokens(codes, word_ends)
        if not len(starts):
            return np.empty(0, "<i8"), np.zeros(len(texts), "<i8")
        up, down = _powers(len(codes) + 1)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + 1).astype(np.uint64) * up[: len(codes)], dtype=np.uint64)))
        h = (prefix[stops] - prefix[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        once, first, back = np.unique(h, return_index=True, return_inverse=True)
        new = self._missing(once)
        sure = _same(codes, starts, stops - starts, codes, starts[first[back]], (stops - starts)[first[back]])
        if not new.all():
            old = np.flatnonzero(~new)
            at = np.searchsorted(self.known, once[old])
            like = np.ones(len(once), bool)
            like[old] = _same(codes, starts[first[old]], (stops - starts)[first[old]], self.spell, self.spell_at[at], self.spell_n[at])
            sure &= like[back]
        if not sure.all():  # unlike pieces of one hash: their texts go to the library
            odd[np.searchsorted(ends, starts[~sure], side="right")] = True
            return self._with_library(texts, odd)
        if new.any():
            if len(self.known) + int(new.sum()) > CACHE_PIECES:
                new[:] = True
            self._learn(once[new], codes, starts[first[new]], stops[first[new]])
        at = np.searchsorted(self.known, once)[back]
        sizes = self.size[at]
        ids = _take(self.flat, self.begin[at], sizes).astype("<i8")
        edge = np.concatenate(([0], np.cumsum(sizes)))
        cut = np.searchsorted(starts, ends)
        return ids, np.diff(edge[cut], prepend=0)

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(hashes), bool)
        return self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] != hashes

    def _with_library(self, texts: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = np.flatnonzero(~odd).tolist()
        ids, n = self.encode([texts[i] for i in plain]) if plain else (np.empty(0, "<i8"), np.empty(0, "<i8"))
        parts: list[np.ndarray] = [np.empty(0, "<i8")] * len(texts)
        for i, part in zip(plain, np.split(ids, np.cumsum(n)[:-1]) if plain else []):
            parts[i] = part
        for i in np.flatnonzero(odd).tolist():
            parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<i8")
        return np.concatenate(parts), np.array([len(p) for p in parts], "<i8")


def _take(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of flat, one after another."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)]


def _same(a: np.ndarray, a_at: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_n: np.ndarray) -> np.ndarray:
    """Which slices of a equal, sign by sign, the slices of b at the same position."""
    out = a_n == b_n
    n = np.where(out, a_n, 0)
    unlike = _take(a, a_at, n) != _take(b, b_at, n)
    if unlike.any():
        out[np.repeat(np.arange(len(n)), n)[unlike]] = False
    return out


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


# ---------------------------------------------------------------- decoding


def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens of a byte-level vocabulary in a row, and where each id's begin."""
    model = json.load(open(path, encoding="utf-8"))
    back = {c: b for b, c in enumerate(_byte_chars())}
    tokens = {i: t for t, i in model["model"]["vocab"].items()} | {a["id"]: a["content"] for a in model["added_tokens"]}
    raw = [bytes(back[c] for c in tokens.get(i, "")) for i in range(max(tokens) + 1)]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def gather_bytes(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """The bytes that the ids stand for, and where each id's end."""
    flat, offsets = table
    lens = offsets[ids + 1] - offsets[ids]
    ends = np.cumsum(lens)
    take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(offsets[ids] - (ends - lens), lens)
    return flat[take].tobytes(), ends


# ---------------------------------------------------------------- on Spark


@lean
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of every word that may enter the lexicon, counted per task as far as memory allows."""
    seen: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        seen.clear()
        return out

    for b in batches:
        for t in b.column("text"):
            seen.update((t.as_py() or "").encode().split())
            if len(seen) > COUNTED_AT_ONCE:
                yield flush()
    yield flush()


def fit_lexicon(docs: DataFrame, path: str) -> bytes:
    """Count words in every text and compile the most frequent, with a space before, into a lexicon."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "word binary, n long")
    counted = stage_out(counted.where(F.octet_length("word") <= LONGEST_WORD).groupBy("word").agg(F.sum("n").alias("n")), "words")
    # how many words have which frequency, in steps of an eighth of a power of two, says what the rarest of the lexicon holds
    step = F.floor(F.log2("n") * 8)
    least, left = 0, LEXICON_WORDS
    for r in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        least, left = r["step"], left - r["words"]
        if left <= 0:
            break
    top = counted.where(step >= least).orderBy(F.desc("n"), "word").limit(LEXICON_WORDS).collect()
    drop_table(counted)
    words = [b" " + bytes(r["word"]) for r in top]
    encoded = load_tokenizer(path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    # a pre-token is looked up, so words that are several can't be found and stay out
    single = [_one_pre_token(w.decode()) for w in words]
    return build_lexicon({w: e.ids for w, e, one in zip(words, encoded, single) if one})


def _one_pre_token(text: str) -> bool:
    codes = np.frombuffer((text + chr(_BETWEEN)).encode("utf-32-le"), "<u4").astype("<i8")
    return not (_classes()[codes] == STRANGE).any() and len(pre_tokens(codes, False)[0]) == 1


def encode_and_decode(docs: DataFrame, path: str, lexicon: bytes | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded text for every row of docs."""
    return _coded(docs, path, lexicon, digest=False)


def digests(docs: DataFrame, path: str, lexicon: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs; ids and texts stay in the workers."""
    return _coded(docs, path, lexicon, digest=True)


def _coded(docs: DataFrame, path: str, lexicon: bytes | None, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    blob = spark.sparkContext.broadcast(lexicon if lexicon is not None else fit_lexicon(docs, path))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = TextEncoder(path, Lexicon(blob.value)), byte_table(path)
        for b in batches:
            texts, keys = [t or "" for t in b.column("text").to_pylist()], b.column("doc_id")
            for at, stop in chunks(texts):
                ids, n = encoder.encode(texts[at:stop])
                raw, ends = gather_bytes(ids, table)
                stops = np.cumsum(n)
                ends = np.concatenate(([0], ends))
                wire = ids.astype("<u4").tobytes()
                rows: list[tuple] = []
                for z, k in zip(stops.tolist(), n.tolist()):
                    own = wire[4 * (z - k) : 4 * z]
                    text = raw[ends[z - k] : ends[z]].decode("utf-8", "replace")
                    if digest:
                        rows.append((k, hashlib.sha256(own).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                    else:
                        rows.append((k, own, text))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(n)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string() if digest else pa.binary()), pa.array(cols[2], pa.string())],
                    names,
                )

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
    schema = f"doc_id long, n_tokens long, {names[2]} {'string' if digest else 'binary'}, {names[3]} string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
