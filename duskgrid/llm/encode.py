"""Exact tokenization of whole texts through the tokenizers library, with each distinct segment encoded once.

A tokenizer's pre-tokenizer never lets a token cross certain places. Cutting a text there and encoding the segments
gives the ids of the whole text, and in natural text most segments repeat, so a cache answers for them:

- "drop" (white space vanishes from the ids): every run of ASCII white space is such a place;
- "keep" (byte-level, a word carries its leading space): a space or a line feed with no other white space beside it.

Texts for which this reasoning doesn't hold (runs of white space under "keep", special tokens spelled out) are encoded
whole, by the same library. Ids always equal Tokenizer.encode(text, add_special_tokens=False).ids.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from duskgrid.llm.common import strings

_SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"
#: Segments that a worker remembers at most before it forgets those seen in one batch only; about 120 MB.
CACHE_SEGMENTS = 600_000
#: Sentence marks that may end a word.
_MARKS = ".,;:!?"
#: Words that the model can take as they are: letters up to U+024F whose lower case is one letter too.
_LATIN = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{148}\x{14a}-\x{1bf}"
_PLAIN = f"^ ?[{_LATIN}]+$"
#: What marks may follow and be cut from: such letters, Greek and Cyrillic ones whose normal form is a letter too, ASCII digits.
_CORE = rf"[{_LATIN}0-9\x{{391}}-\x{{3a1}}\x{{3a3}}-\x{{3a9}}\x{{3ac}}-\x{{3ce}}\x{{400}}-\x{{481}}]$"
#: A byte's character in byte-level vocabularies: itself where printable, else one from U+0100 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)}
_loaded: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, segments: int | None = None, plain: bool = False) -> "Encoder":
    """The worker's own encoder for a tokenizer file; it outlives a task where Spark keeps the worker.

    segments: how many it may remember, CACHE_SEGMENTS if not given; fewer cost time, more cost memory.
    plain: special tokens spelled out in a text are ordinary text.
    """
    key = path, plain
    if key not in _loaded:
        _loaded[key] = Encoder(path, plain)
    _loaded[key].most = segments or CACHE_SEGMENTS
    return _loaded[key]


class Encoder:
    """encode() turns a large-string array without nulls into (offsets, ids)."""

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.specials = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.direct, self.most = self.tokenizer.model, False, CACHE_SEGMENTS
        self.mode = next((m for m in ("drop", "keep") if self._holds(m)), "whole")
        self.direct = self.mode != "whole" and self._direct_holds()
        self.forget()

    def forget(self) -> None:
        """Empties the cache."""
        self.index: dict[str, int] = {"": 0}  # the empty segment has no ids
        self.start, self.size, self.flat = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.int32)
        self.hits, self.used = np.zeros(1 << 12, np.int32), 0

    def _keep_frequent(self) -> None:
        """Forgets all segments that one batch only has asked for."""
        words, n = list(self.index), len(self.index)
        self.hits[0] = 0
        kept = np.flatnonzero(self.hits[:n] > 1)
        if len(kept) > n // 2:
            kept = kept[np.argsort(-self.hits[kept], kind="stable")[: n // 2]]
        kept = np.concatenate([[0], kept])
        ends, flat = self._gathered(kept)
        self.forget()
        self.index = {words[k]: i for i, k in enumerate(kept.tolist())}
        self.size, self.hits, self.flat, self.used = np.diff(ends), np.ones(len(kept), np.int32), flat, len(flat)
        self.start = ends[:-1]

    def _gathered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of entries, one after the other."""
        return _picked(self.start[entries], self.size[entries], self.flat)

    def _direct_ids(self, segments: list[str]) -> tuple[np.ndarray, list[int], list[int]]:
        """Which segments are words that the model takes as they are; how many ids each of these has, and the ids."""
        both = pa.array(segments, pa.large_string())
        plain = pc.match_substring_regex(both, _PLAIN).to_numpy(zero_copy_only=False)
        both = both.filter(pa.array(plain))
        if self.mode == "drop":
            both = pc.utf8_lower(both)
        tokenize, sizes, ids = self.model.tokenize, [], []
        for w in strings(both):
            found = tokenize(w.replace(" ", "\u0120") if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))
            sizes.append(len(found))
            ids += [t.id for t in found]
        return plain, sizes, ids

    def _direct_holds(self) -> bool:
        """Whether the model alone gives the library's ids for such words."""
        probes = ["the", " the", "Straße", " Übung", "élève", "x", " niño", "DON", "ß", " ﬁ", "İx", "ŉa"]
        if self.mode == "drop":  # where no segment begins with a space
            probes = [p.strip() for p in probes]
        plain, sizes, ids = self._direct_ids(probes)
        whole = self._whole([p for p, ok in zip(probes, plain, strict=True) if ok])
        return [len(x) for x in whole] == sizes and list(chain.from_iterable(whole)) == ids

    def _holds(self, mode: str) -> bool:
        """Whether probes with every kind of boundary encode alike whole and in segments."""
        self.mode = mode
        self.forget()
        probes = ["a b", "Don't stop, it's  x", "ab\ncd", " ab", "ab ", "x.\n\ny", "1 234 5.6", "é ñ ü\tß", "they're 'll we", "a b 　c", "foo !bar ?\n(z)", "x1, 2y?! 3... a.b; 'q': (r).", "İ. क़, ড়! ਸ਼? é: ΐ; й. ŉ, ß!"]
        off, ids = self.encode(pa.array(probes, pa.large_string()))
        return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [self.tokenizer.encode(p, add_special_tokens=False).ids for p in probes]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if self.mode == "whole":
            return _joined(self._whole(strings(texts)))
        odd = pc.match_substring_regex(texts, _SPACE + "{2}") if self.mode == "keep" else pa.array(np.zeros(n, bool))
        for s in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        counts, ids = self._segments(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts)
        if not odd.any():
            return np.concatenate([[0], np.cumsum(counts)]), ids
        at = np.flatnonzero(odd)
        own = self._whole(strings(texts.take(pa.array(at))))
        counts[at] = [len(x) for x in own]
        off = np.concatenate([[0], np.cumsum(counts)])
        out, plain = np.empty(off[-1], np.int32), np.ones(off[-1], bool)
        for i, x in zip(at, own, strict=True):
            out[off[i] : off[i + 1]] = x
            plain[off[i] : off[i + 1]] = False
        out[plain] = ids
        return off, out

    def _segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that may be cut at white space, and how many each text has."""
        if self.mode == "keep":
            parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        else:
            parts = pc.ascii_split_whitespace(texts)
        off = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values[off[0] : off[-1]].dictionary_encode()
        off = off - off[0]
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        if not len(code):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        words, mark, marks = self._without_marks(distinct)
        if self.mode == "keep":  # a word has a leading space unless it begins the text or a line
            feed = code == pc.index(distinct, "\n").as_py()
            spaced = ~feed
            spaced[1:] &= ~feed[:-1]
            spaced[off[:-1][np.diff(off) > 0]] = False
            code = code * 2 + spaced
            seen = np.zeros(2 * len(words), bool)
            seen[code] = True
            keys = np.flatnonzero(seen)
            place = np.zeros(len(seen), np.int32)
            place[keys] = np.arange(len(keys), dtype=np.int32)
            code, mark = place[code], mark[keys >> 1]
            words = [f" {words[k >> 1]}" if k & 1 else words[k >> 1] for k in keys.tolist()]
        entries = self._entries(words + marks)
        own, behind = entries[: len(words)], entries[len(words) :][mark]
        ends, flat = self._gathered(np.stack([own, behind], axis=1).ravel())  # a segment's ids are its word's and its marks'
        ends, ids = _picked(ends[:-1:2][code], np.diff(ends[::2])[code], flat)
        return np.diff(ends[off]).astype(np.int64), ids

    def _without_marks(self, distinct: pa.Array) -> tuple[list[str], np.ndarray, list[str]]:
        """Segments without closing sentence marks; the number of each one's marks, and the distinct marks, none first.

        No token crosses from a letter or digit to a mark, so the two encode on their own. Only letters that stay letters in
        every normal form count: others may end in a combining mark, which a splitter puts together with the marks behind.
        """
        words, mark, marks = strings(distinct), np.zeros(len(distinct), np.int64), {"": 0}
        cores = pc.utf8_rtrim(distinct, _MARKS)
        at = np.flatnonzero(pc.binary_length(cores).to_numpy() != pc.binary_length(distinct).to_numpy())
        cores = cores.take(pa.array(at))
        ends = pc.match_substring_regex(cores, _CORE).to_numpy(zero_copy_only=False)
        for i, core in zip(at[ends].tolist(), strings(cores.filter(pa.array(ends))), strict=True):
            mark[i] = marks.setdefault(words[i][len(core) :], len(marks))
            words[i] = core
        return words, mark, list(marks)

    def _entries(self, segments: list[str]) -> np.ndarray:
        """The cache's entry of each segment; what it lacks is encoded and added."""
        if len(self.index) > self.most:
            self._keep_frequent()
        index = self.index
        entries = np.array([index.get(s, -1) for s in segments], np.int32)
        lacking = np.flatnonzero(entries < 0).tolist()
        if lacking:
            fresh = list(dict.fromkeys(segments[i] for i in lacking))
            first = len(index)
            if self.direct:
                plain, sizes, ids = self._direct_ids(fresh)
                fresh, rest = [s for s, ok in zip(fresh, plain.tolist(), strict=True) if ok], [s for s, ok in zip(fresh, plain.tolist(), strict=True) if not ok]
            else:
                sizes, ids, fresh, rest = [], [], [], fresh
            own = self._whole(rest)
            sizes = np.array(sizes + [len(x) for x in own], np.int32)
            ids = np.fromiter(chain(ids, chain.from_iterable(own)), np.int32)
            index.update(zip(chain(fresh, rest), range(first, first + len(sizes)), strict=True))
            last, used = len(index), self.used + len(ids)
            self.start, self.size, self.hits, self.flat = _grown(self.start, last), _grown(self.size, last), _grown(self.hits, last), _grown(self.flat, used)
            self.start[first:last], self.size[first:last] = self.used + np.cumsum(sizes) - sizes, sizes
            self.flat[self.used : used] = ids
            self.used = used
            entries[lacking] = [index[segments[i]] for i in lacking]
        self.hits[entries] += 1
        return entries


def _picked(start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of flat[start[i] : start[i] + size[i]], one run after the other; a batch's ids fit 32-bit places."""
    ends = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    places = np.repeat(start - ends[:-1], size)
    places += np.arange(len(places), dtype=np.int32)
    return ends, flat[places]


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
    return off, np.fromiter(chain.from_iterable(lists), np.int32, int(off[-1]))
