"""Byte-pair encoding and decoding in numpy, equal to the tokenizers library for the public vocabularies.

``WordBpe``: the vocabulary with word ends (normalised: NFC, lower case; white space dropped). ``ByteBpe``: the byte-level
vocabulary. A text is first cut into chunks at white space, where no pre-token can cross; only chunks that a worker hasn't
met lately are normalised, split and merged. ``WordBpe`` cuts, lower-cases and splits whole arrays of bytes, and asks its
memory once for each different chunk of a batch of texts. Merging is batched: the symbols of many pre-tokens lie in one flat
array, and neighbouring pairs are looked up by binary search over the sorted pair keys.

Null texts are empty, empty texts have no tokens. Texts of any length are taken whole; special strings inside texts become
their one id, as the library does by default.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex

from .common import ranges

_NONE = np.int32(2**31 - 1)
#: The pre-token patterns of the two vocabulary files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks with control characters, rare spaces, letters past the Latin blocks (whose classes differ between Unicode versions)
#: or what may be a special string go to the library's own splitter.
ODD = re.compile(rb"[\x00-\x1f\xc9-\xff]|\xc2[\x80-\xa0]|<\|")
#: Pre-tokens of more symbols than this are merged one by one.
LONG = 200


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it prints, else from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in keep else chr(256 + extra))
        extra += b not in keep
    return out


class Merges:
    """Sorted pair keys of a vocabulary, and the rank and the product of each pair."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        # Half a word holds an id of the usual vocabularies, and a shorter key is found faster.
        self.bits, kind = (16, np.uint32) if max(vocab.values()) < 1 << 16 else (31, np.uint64)
        keys = (left << self.bits | right).astype(kind)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.rank = order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)[order]
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        names = [b""] * size
        for k, v in [*vocab.items(), *self.special.items()]:
            names[v] = k.encode()
        self.names = names

    def table(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) to (rank, product), for the few words that don't fit the batched rounds."""
        if not hasattr(self, "_table"):
            keys = self.keys.astype(np.int64)
            left, right = (keys >> self.bits).tolist(), (keys & (1 << self.bits) - 1).tolist()
            self._table = dict(zip(zip(left, right), zip(self.rank.tolist(), self.made.tolist())))
        return self._table

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The start symbols of words laid end to end, and the words' lengths."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = np.take(self.first, raw)
        ends = np.cumsum(lens) - 1
        ends = ends[lens > 0]
        sym[ends] = self.last[raw[ends]]
        return sym, lens


def merge(m: Merges, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge until no pair of any word is in the table: (symbols laid end to end, number for each word).

    A round applies each word's lowest-rank pair wherever it stands in the word, from the left; words without a pair leave
    the arrays. Pairs are found by binary search, the first time all of them, then those that a round made. Words of over
    LONG symbols would need too many rounds and are merged by a heap of pairs, with the same result.
    """
    n_words = len(lens)
    word = np.repeat(np.arange(n_words, dtype=np.int32), lens)
    kind = m.keys.dtype
    done_s, done_w = [], []
    if len(lens) and lens.max() > LONG:
        starts = np.cumsum(lens) - lens
        for w in np.flatnonzero(lens > LONG).tolist():
            out = np.array(_merge_long(m, sym[starts[w] : starts[w] + lens[w]].tolist()), np.int32)
            done_s.append(out)
            done_w.append(np.full(len(out), w, np.int32))
        short = lens[word] <= LONG
        sym, word = sym[short], word[short]
    else:
        sym = sym.copy()

    def pairs(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of the pairs that begin at the places ``i``; no place is a word's last."""
        key = np.take(sym, i).astype(kind) << kind.type(m.bits) | np.take(sym, i + 1).astype(kind)
        at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
        return np.where(np.take(m.keys, at) == key, np.take(m.rank, at), _NONE), np.take(m.made, at)

    rank, made = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    if len(inner) and len(m.keys):
        rank[inner], made[inner] = pairs(inner)
    while len(sym):
        edge = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(edge, len(word)))
        least = np.minimum.reduceat(rank, edge)
        if least.max() == _NONE:
            live = np.repeat(least != _NONE, size)
            done_s.append(sym[~live])
            done_w.append(word[~live])
            sym, word, rank, made = sym[live], word[live], rank[live], made[live]
            if not len(sym):
                break
            least, size = least[least != _NONE], size[least != _NONE]
        pick = np.flatnonzero(rank == np.repeat(least, size))
        run = np.append(True, np.diff(pick) != 1)
        if not run.all():  # of a run of equal symbols every second pair
            start = np.maximum.accumulate(np.where(run, pick, 0))
            pick = pick[(pick - start) % 2 == 0]
        sym[pick] = made[pick]
        rank[pick] = _NONE
        keep = np.ones(len(sym), bool)
        keep[pick + 1] = False
        sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        pick -= np.arange(len(pick))
        near = np.concatenate([pick, pick[pick > 0] - 1])
        near = near[near < len(sym) - 1]
        same = np.take(word, near) == np.take(word, near + 1)
        near = near[same]
        rank[near], made[near] = pairs(near)
    word = np.concatenate([*done_w, np.empty(0, np.int32)])
    sym = np.concatenate([*done_s, np.empty(0, np.int32)])
    return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=n_words).astype(np.int64)


def _merge_long(m: Merges, sym: list[int]) -> list[int]:
    """One long word: a heap of (rank, place), stale entries skipped, and links to the neighbours that are left."""
    table = m.table()
    n = len(sym)
    nxt, prev, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
    heap = [(r[0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := table.get((sym[i], sym[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if gone[i] or sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i] = table[a, b][1]
        gone[j] = 1
        nxt[i] = k = nxt[j]
        if k < n:
            prev[k] = i
            if r := table.get((sym[i], sym[k])):
                heapq.heappush(heap, (r[0], i, sym[i], sym[k]))
        if (h := prev[i]) >= 0 and (r := table.get((sym[h], sym[i]))):
            heapq.heappush(heap, (r[0], h, sym[h], sym[i]))
    return [s for s, g in zip(sym, gone) if not g]


class Splitter:
    """Chunks to pre-tokens: one pattern pass over plain chunks, the file's own normaliser and splitter for the others."""

    def __init__(self, spec_json: str, pattern: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec_json)
        self.normalizer = self.library.normalizer
        self.find = regex.compile(pattern + r"|\n").findall
        self.special = {x["content"]: x["id"] for x in json.loads(spec_json).get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.back = {c: b for b, c in enumerate(byte_chars())}

    def by_library(self, s: str) -> list[bytes | int]:
        """Pre-tokens of any string; a special string gives its id."""
        out: list[bytes | int] = []
        for part in self.cut.split(s) if self.cut else [s]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = self.normalizer.normalize_str(part) if self.normalizer else part
                out += [bytes(self.back[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def plain(self, chunks: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of chunks that are not ODD laid end to end, and the number for each chunk."""
        s = b"\n".join(chunks).decode() + "\n"
        if self.normalizer:  # it would turn the line ends into spaces
            s = s.lower() if s.isascii() else "\n".join(self.normalizer.normalize_str(s.replace("\n", " ")).split(" "))
        words = self.find(s)
        end = np.flatnonzero(np.fromiter(map("\n".__eq__, words), bool, len(words)))
        return [w for w in words if w != "\n"], np.diff(end, prepend=-1) - 1


class Growing:
    """An array that is added to; it is copied only when its room runs out."""

    def __init__(self, dtype: type) -> None:
        self.room, self.n = np.empty(1 << 16, dtype), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            room = np.empty(max(2 * len(self.room), self.n + len(x)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


def chunks_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The texts cut at ASCII white space, each chunk with one space behind it, and the number for each text."""
    raw = np.frombuffer(b" ".join(texts).translate(_SPACES) + b" ", np.uint8)
    space = raw == 32
    first = ~space
    first[1:] &= space[:-1]
    begin = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    n = np.diff(np.searchsorted(np.flatnonzero(first), begin), prepend=0)
    keep = ~space
    keep[1:] |= ~space[:-1]
    raw = raw[keep]
    return _strings(raw, np.append(0, np.flatnonzero(raw == 32) + 1)), n


def _strings(raw: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The byte strings between neighbouring edges, with 64-bit offsets: a text may be as long as it likes."""
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def _laid(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of byte strings, and where each begins."""
    if not len(strings):  # its buffers may be missing
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    _, edges, raw = strings.buffers()
    edges = np.frombuffer(edges, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]], edges[:-1] - edges[0]


def strings(array: pa.Array) -> list[bytes]:
    raw, starts = _laid(array)
    data, edges = raw.tobytes(), [*starts.tolist(), len(raw)]
    return [data[a:b] for a, b in zip(edges, edges[1:])]


_SPACES = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))
_OTHER, _LETTER, _DIGIT, _END, _BAR = range(5)


class Cutter:
    """WORD_PATTERN over whole arrays of bytes, for chunks of ASCII and the letters of U+00C0 to U+00FF (two bytes, the first
    0xC3). A character is taken if the file's normaliser makes one of the same kind and length of it; chunks that hold any
    other byte or what may be a special string are left to the Splitter."""

    def __init__(self, normalizer: object | None) -> None:
        self.kind, self.low = np.full(256, _BAR, np.uint8), np.arange(256, dtype=np.uint8)
        #: The same for the second byte after 0xC3.
        self.kind_c3, self.low_c3 = np.full(256, _BAR, np.uint8), np.arange(256, dtype=np.uint8)
        self.kind[0xC3] = _LETTER
        self.kind[32] = _END
        for c in map(chr, [*range(33, 128), *range(0xC0, 0x100)]):
            raw, got = c.encode(), (normalizer.normalize_str(c) if normalizer else c).encode()
            if len(got) != len(raw) or len(got) == 2 and (got[0] != 0xC3 or not got.decode().isalpha()):
                continue
            kind, low = (self.kind, self.low) if len(raw) == 1 else (self.kind_c3, self.low_c3)
            kind[raw[-1]] = _LETTER if got.decode().isalpha() else _DIGIT if got.isdigit() else _OTHER
            low[raw[-1]] = got[-1]

    def cut(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
        """Which chunks are taken; their pre-tokens, end to end; the number for each of them."""
        kind, low = np.take(self.kind, raw), np.take(self.low, raw)
        lead = np.flatnonzero(raw == 0xC3)
        if len(lead):  # a space is behind each chunk, so none is the last byte
            kind[lead + 1] = np.take(self.kind_c3, raw[lead + 1])
            low[lead + 1] = np.take(self.low_c3, raw[lead + 1])
        bar = kind == _BAR
        bar[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
        plain = np.ones(len(starts), bool)
        if bar.any():
            plain = ~np.logical_or.reduceat(bar, starts)
            mine = np.repeat(plain, np.diff(starts, append=len(raw)))
            kind, low = kind[mine], low[mine]
        if not len(kind):
            return plain, pa.array([], pa.large_binary()).dictionary_encode(), np.empty(0, np.int64)
        new = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & (kind != _END)
        mark = np.flatnonzero((low == 39) & new)
        mark = mark[kind[mark + 1] == _LETTER]  # alone, before a letter: it may begin one of the pattern's endings
        if len(mark):
            a, b = low[mark + 1], low[np.minimum(mark + 2, len(low) - 1)]
            one = np.isin(a, list(b"stmd"))
            two = (np.isin(a, list(b"rv")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            new[mark[one | two] + 1] = False
            rest = np.concatenate([mark[one] + 2, mark[two] + 3])
            new[rest[kind[rest] == _LETTER]] = True
        inside = kind != _END
        edges = np.append(np.flatnonzero(new[inside]), np.count_nonzero(inside))
        words = _strings(low[inside], edges).dictionary_encode()
        return plain, words, np.diff(np.searchsorted(np.flatnonzero(new), np.flatnonzero(~inside)), prepend=0)


class WordBpe:
    """Encoder and decoder for the vocabulary with word ends. Build once per worker; ``keep`` bounds the chunks remembered."""

    def __init__(self, spec_json: str, keep: int = 700_000) -> None:
        self.m = _merges(spec_json)
        self.split = Splitter(spec_json, WORD_PATTERN)
        self.cut = Cutter(self.split.normalizer)
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.flat, self.start, self.size, self.hits = Growing(np.int32), Growing(np.int64), Growing(np.int64), Growing(np.int32)
        self.forget_words()

    def forget_words(self) -> None:
        self.word: dict[bytes | int, int] = {}
        self.word_flat, self.word_start, self.word_size = Growing(np.int32), Growing(np.int64), Growing(np.int64)

    def thin(self) -> None:
        """Keep the chunks that more than one batch of texts had, where that is too many the commonest half."""
        hits = self.hits.all
        again = np.flatnonzero(hits > 1)
        if len(again) > self.keep // 2:
            again = again[hits[again] > np.sort(hits[again])[-(self.keep // 2)]]
        names = list(self.seen)  # in the order of their numbers
        start, size, hits = self.start.all[again], self.size.all[again], np.minimum(hits[again], 1000)
        flat = self.flat.all[ranges(start, size)]
        words = self.word, self.word_flat, self.word_start, self.word_size
        self.forget()
        if len(words[0]) <= self.keep // 2:
            self.word, self.word_flat, self.word_start, self.word_size = words
        self.seen = {names[i]: k for k, i in enumerate(again.tolist())}
        for array, x in ((self.flat, flat), (self.size, size), (self.start, np.cumsum(size) - size), (self.hits, hits)):
            array.add(x)

    def number(self, words: list[bytes | int]) -> np.ndarray:
        """The numbers of different pre-tokens; those not met lately are merged."""
        at = np.fromiter(map(self.word.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            special = [i for i, w in enumerate(new) if isinstance(w, int)]
            raw = [b"?" if isinstance(w, int) else w for w in new] if special else new
            sym, lens = merge(self.m, *self.m.symbols(raw))
            begin = np.cumsum(lens) - lens
            for i in special:  # the string's id; "?" kept a single place for it
                sym[begin[i]] = new[i]
            at[missing] = own = self.word_start.n + np.arange(len(new))
            self.word.update(zip(new, own.tolist()))
            self.word_start.add(self.word_flat.n + begin)
            self.word_size.add(lens)
            self.word_flat.add(sym)
        return at

    def learn(self, chunks: pa.Array) -> np.ndarray:
        """Encode different chunks, each with a space behind it and no other ASCII white space, and remember them: their numbers."""
        raw, starts = _laid(chunks)
        plain, at, n = self.cut.cut(raw, starts)
        where = [self.number(strings(at.dictionary))[np.asarray(at.indices)] if len(at) else np.empty(0, np.int64)]
        count = [n]
        names = strings(chunks)
        odd, latin, rest = ODD.search, [], []
        for i in np.flatnonzero(~plain).tolist():
            (rest if odd(names[i][:-1]) else latin).append(i)
        words: list[bytes | int] = []
        if latin:
            got, n = self.split.plain([names[i][:-1] for i in latin])
            words += [w.encode() for w in got]
            count.append(n)
        more = []
        for i in rest:
            got = self.split.by_library(names[i][:-1].decode("utf-8", "replace"))
            more.append(len(got))
            words += got
        count.append(np.array(more, np.int64))
        if words:
            new = list(dict.fromkeys(words))
            code = dict(zip(new, self.number(new).tolist()))
            where.append(np.fromiter(map(code.__getitem__, words), np.int64, len(words)))
        at = np.concatenate(where)
        sizes = self.word_size.all[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.concatenate([[0], np.cumsum(np.concatenate(count))])
        begin, end = total[edges[:-1]], total[edges[1:]]
        n = self.start.n
        self.start.add(self.flat.n + begin)
        self.size.add(end - begin)
        self.flat.add(self.word_flat.all[ranges(self.word_start.all[at], sizes)])
        self.hits.add(np.zeros(len(names), np.int32))
        order = np.concatenate([np.flatnonzero(plain), np.array(latin + rest, np.int64)])
        if latin or rest:
            names = [names[i] for i in order.tolist()]
        self.seen.update(zip(names, range(n, n + len(names))))
        out = np.empty(len(names), np.int64)
        out[order] = n + np.arange(len(names))
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts laid end to end, and how many each text has."""
        if len(self.seen) > self.keep:
            self.thin()
        chunks, n = chunks_of(texts)
        met = chunks.dictionary_encode()  # a worker's memory is asked once for each different chunk
        names = strings(met.dictionary)
        at = np.fromiter(map(self.seen.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(at < 0)
        for k in range(0, len(missing), 50_000):
            part = missing[k : k + 50_000]
            at[part] = self.learn(met.dictionary.take(pa.array(part)))
        self.hits.all[at] += 1  # once for each batch of texts
        at = np.take(at, np.asarray(met.indices))
        sizes = np.take(self.size.all, at)
        ids = np.take(self.flat.all, ranges(np.take(self.start.all, at), sizes))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[edges[1:]] - ends[edges[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The library's decode() of each text's ids: the file names no decoder, so token strings joined by spaces."""
        flat, start, size = _names(self.m)
        sizes = size[ids]
        raw = flat[ranges(start[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
        return [raw[a : max(a, b - 1)] for a, b in zip(ends[edges[:-1]].tolist(), ends[edges[1:]].tolist())]


def _names(m: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not hasattr(m, "name_table"):
        raw = [x + b" " for x in m.names]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        m.name_table = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size
    return m.name_table


@lru_cache(maxsize=4)
def _merges(spec_json: str) -> Merges:
    return Merges(json.loads(spec_json))


@lru_cache(maxsize=2)
def word_bpe(spec_json: str) -> WordBpe:
    return WordBpe(spec_json)


def spec_of(path: str) -> str:
    """The vocabulary file's content; a few MB whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return f.read()


#: What the byte-level splitter doesn't take in the fast pass: besides the above, white space that isn't single and inside.
ODD_SPACE = re.compile(rb"[\x00-\x08\x0e-\x1f\xc9-\xff]|\xc2[\x80-\xa0]|<\||\s\s|^\s|\s\Z")
#: A text without these is cut at every space; others only at a space between two other characters.
RUNS = re.compile(rb"[\s\x1c-\x1f]{2}|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
LONE = re.compile(r"(?<=\S) (?=\S)")


class ByteBpe:
    """Token counts for the byte-level vocabulary. A chunk is cut off at a space, which stays with what follows it."""

    def __init__(self, spec_json: str, keep: int = 700_000) -> None:
        self.m = _merges(spec_json)
        self.split = Splitter(spec_json, BYTE_PATTERN)
        self.find = regex.compile("\x01|" + BYTE_PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}\x01]")).findall
        self.keep = keep
        self.seen: dict[bytes, int] = {}

    def learn(self, chunks: list[bytes]) -> None:
        """Count the tokens of chunks, each with its leading space if it has one, and remember the numbers."""
        odd = ODD_SPACE.search
        plain = [c for c in chunks if not odd(c[1:] if c[:1] == b" " else c)]
        words: list[bytes] = []
        count: list[int] = []
        extra: list[int] = [0] * len(plain)
        if plain:
            got = np.array(self.find(b"\x01".join(plain).decode() + "\x01"), object)
            end = np.flatnonzero(got == "\x01")
            count += (np.diff(end, prepend=-1) - 1).tolist()
            words += [w.encode() for w in got[got != "\x01"].tolist()]
        rest = list(set(chunks).difference(plain))
        for c in rest:
            parts = self.split.by_library(c.decode("utf-8", "replace"))
            inner = [w for w in parts if not isinstance(w, int)]
            words += inner
            count.append(len(inner))
            extra.append(len(parts) - len(inner))
        _, lens = merge(self.m, *self.m.symbols(words))
        total = np.concatenate([[0], np.cumsum(lens)])
        edges = np.concatenate([[0], np.cumsum(np.array(count, np.int64))])
        self.seen.update(zip(plain + rest, (total[edges[1:]] - total[edges[:-1]] + np.array(extra, np.int64)).tolist()))

    def count(self, texts: list[bytes]) -> np.ndarray:
        cut = []
        for t in texts:
            if RUNS.search(t):
                pieces = [p.encode() for p in LONE.split(t.decode("utf-8", "replace"))]
            else:
                pieces = t.split(b" ")
            cut.append((pieces[0], pieces[1:]))
        new = {b" " + c for c in set().union(*(p for _, p in cut))} | {f for f, _ in cut}
        if len(self.seen) + len(new) > self.keep:
            self.seen = {}
        new = list(new.difference(self.seen))
        for k in range(0, len(new), 50_000):
            self.learn(new[k : k + 50_000])
        get = self.seen
        return np.array([get[f] + sum([get[b" " + c] for c in p]) for f, p in cut], np.int64)


@lru_cache(maxsize=2)
def byte_bpe(spec_json: str) -> ByteBpe:
    return ByteBpe(spec_json)
