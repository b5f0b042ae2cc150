"""Words of many texts at once: codes into the batch's distinct words, and hashed character n-grams of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from duskgrid.llm.common import strings

#: Everything that isn't a letter or a digit parts words.
_BETWEEN = r"[^\p{L}\p{N}]+"
#: Words whose n-grams are made at a time.
CHUNK = 40_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets of each text's words, their codes, and the distinct lower-cased words that the codes mean."""
    parts = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _BETWEEN, " ")))
    off = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values[off[0] : off[-1]].dictionary_encode()
    code, distinct = coded.indices.to_numpy(), strings(coded.dictionary)
    if "" in distinct:  # what a text without words leaves
        blank = distinct.index("")
        kept = code != blank
        off = np.concatenate([[0], np.cumsum(kept)])[off - off[0]]
        code = code[kept]
    return off - off[0], code, distinct


def byte_words(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each text's words between ASCII white space, their codes, and the distinct words that the codes mean.

    Each byte is first replaced by table[byte], so all further separators are those that it turns into spaces.
    """
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = data[off[0] : off[-1]].to_pybytes().translate(table) if data is not None and len(off) else b""
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(off - off[0])), pa.py_buffer(raw))
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(made))
    at = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values[at[0] : at[-1]].dictionary_encode()
    code, at = coded.indices.to_numpy(), at - at[0]
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # what a text without words leaves
        kept = code != blank
        at, code = np.concatenate([[0], np.cumsum(kept)])[at], code[kept]
        distinct = coded.dictionary
        return at, np.where(code > blank, code - 1, code), pa.concat_arrays([distinct[:blank], distinct[blank + 1 :]])
    return at, code, coded.dictionary


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + size[i], one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def word_ngrams(words: list[str], sizes: tuple[int, ...], buckets_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashed buckets of the n-grams of each word between boundary marks; whole words count as one too."""
    if len(words) > CHUNK:  # bounds the character matrices
        parts = [word_ngrams(words[i : i + CHUNK], sizes, buckets_log2) for i in range(0, len(words), CHUNK)]
        return np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for o, _ in parts]))]), np.concatenate([g for _, g in parts])
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    counts = sum(np.maximum(lens - n + 1, 0) for n in sizes) + 1
    off = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(off[-1], np.int32)
    shift = np.uint64(64 - buckets_log2)
    room = 1 << np.maximum(3, np.ceil(np.log2(np.maximum(lens, 1))).astype(int))
    for width in np.unique(room):
        at = np.flatnonzero(room == width)
        chars = np.array([f"<{words[i]}>" for i in at.tolist()], f"U{width}").view(np.uint32).reshape(len(at), width).astype(np.uint64)
        fill = off[at].copy()
        with np.errstate(over="ignore"):
            whole = (chars * _MULT[0] + np.arange(width, dtype=np.uint64) * _MULT[3]).copy()
            whole = ((whole ^ (whole >> np.uint64(29))) * _MULT[4]).sum(axis=1, where=np.arange(width) < lens[at, None], dtype=np.uint64)
            out[fill] = (whole * _MULT[5]) >> shift
            fill += 1
            for n in sizes:
                if n > width:
                    continue
                h = sum(chars[:, j : width - n + 1 + j] * _MULT[j % 6] for j in range(n)) + np.uint64(n)
                h = ((h ^ (h >> np.uint64(31))) * _MULT[4]) >> shift
                many = np.maximum(lens[at] - n + 1, 0)
                out[ragged(fill, many)] = h[np.arange(h.shape[1]) < many[:, None]]
                fill += many
    return off, out
