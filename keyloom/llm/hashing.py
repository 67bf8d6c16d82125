"""64-bit hashes of words, of many texts at once, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACES = [0x20, *range(0x09, 0x0E)]
_space = re.compile(b"[" + re.escape(bytes(_SPACES)) + b"]")
_in_word = np.ones(256, bool)
_in_word[_SPACES] = False
#: Texts are taken together up to so many bytes, and longer ones a piece at a time.
PIECE = 4_000_000
#: Words are hashed eight bytes at a time up to this length, beyond by BLAKE2b.
LONG = 64
_rng = np.random.default_rng(20)
MULTIPLIERS = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64 bits where each bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(raw: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and begin of each word of raw; none reaches over a cut, an offset between two bytes.

    Every eight bytes are mixed into what came before them, one-to-one; words of different lengths begin differently.
    """
    b = np.frombuffer(raw, np.uint8)
    inside = _in_word[b]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(b))]
    before[cuts] = False
    after[cuts - 1] = False
    begin = np.flatnonzero(inside & ~before)
    length = np.flatnonzero(inside & ~after) + 1 - begin
    eights = np.ndarray((len(b) + 1,), "<u8", raw + bytes(8), strides=(1,))  # those from each byte on
    h = mixed(eights[begin] & _MASKS[np.minimum(length, 8)] ^ length.astype(np.uint64) * MULTIPLIERS[0])
    rest = np.flatnonzero((length > 8) & (length <= LONG))
    at = 8
    while len(rest):
        h[rest] = mixed(h[rest] * MULTIPLIERS[1] ^ eights[begin[rest] + at] & _MASKS[np.minimum(length[rest] - at, 8)])
        at += 8
        rest = rest[length[rest] > at]
    for i in np.flatnonzero(length > LONG):
        h[i] = int.from_bytes(blake2b(raw[begin[i] : begin[i] + length[i]], digest_size=8).digest(), "little")
    return h, begin


def _of_long(raw: bytes) -> np.ndarray:
    parts, at = [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        gap = _space.search(raw, min(at + PIECE, len(raw)))
        end = gap.end() if gap else len(raw)
        parts.append(_words(raw[at:end], np.zeros(0, np.int64))[0])
        at = end
    return np.concatenate(parts)


def hashed_texts(texts: pa.Array, lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By groups of texts, in order: the hashes of all their words, and where each text's words begin, and all end, in these.

    A word is a run of characters other than space and U+0009 to U+000D; lower takes A-Z as a-z. Null has no words.
    """
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        end = max(int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1, at + 1)
        raw = data[int(offsets[at]) : int(offsets[end])].to_pybytes() if data is not None else b""
        raw = raw.lower() if lower else raw  # bytes.lower knows ASCII alone
        if len(raw) > PIECE:
            hashes = _of_long(raw)
            yield hashes, np.array([0, len(hashes)])
        else:
            own = offsets[at : end + 1] - offsets[at]
            hashes, begin = _words(raw, own)
            bounds = np.searchsorted(begin, own)
            bounds[-1] = len(hashes)
            yield hashes, bounds
        at = end


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    return next(hashed_texts(pa.array([text.encode("utf-8", "surrogatepass")], pa.binary()), lower))[0]
