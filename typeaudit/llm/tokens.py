"""Token ids of whole texts under a public byte-level vocabulary.

Lengths alone are cheaper than ids: a text's is the sum over its stretches, a blank and the word behind it, and the lengths of short stretches
are remembered in a table of fixed size in each Python worker. It is compared by all bytes, so a hash decides nothing.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

from typeaudit.llm import scan

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that the public vocabularies were made with, in the form that never goes back over a run; it cuts alike.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary in ``path``: lines of a base64 token and its id. Every node reads it from there."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(number) for token, number in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def end_id(path: str) -> int:
    """The first id that the vocabulary leaves free; it ends a text."""
    return encoder(path).max_token_value + 1


def encode(array: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a string column end to end, and where each text's begin; null counts as empty."""
    coder = encoder(path)
    found = [np.array(coder.encode_ordinary(text.as_py() or ""), np.uint32) for text in array]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
    return (np.concatenate(found) if found else np.empty(0, np.uint32)), bounds


#: Last bytes of the blanks beyond ASCII, and the bytes before these.
_BLANK_LAST = scan.byte_class((0x80, 0x8A), (0x9F, 0xA0), (0xA8, 0xA9), (0xAF, 0xAF))
_BLANK_BEFORE = scan.byte_class((0x80, 0x81), (0x9A, 0x9A), (0xC2, 0xC2))


def _ends_blank(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the bytes before each of ``end``, which is at least 1, may be a blank."""
    last = data[end - 1]
    return ~scan.NOT_BLANK[last] | (_BLANK_LAST[last] & _BLANK_BEFORE[data[np.maximum(end - 2, 0)]])


def _stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the stretches begin that give the same ids alone as within their text.

    What the pattern takes never runs from another character into a blank, and does not depend on what
    stands before it. So texts are cut before an ASCII blank that follows no blank.
    """
    blank = np.flatnonzero((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    blank = blank[blank > 0]
    cuts, heads = blank[~_ends_blank(data, blank)], offsets[:-1][np.diff(offsets) > 0]
    opens = np.zeros(len(data), bool)
    opens[cuts], opens[heads] = True, True
    return np.flatnonzero(opens)


@lru_cache(maxsize=2)
def _widths(path: str) -> np.ndarray:
    """Bytes of each id."""
    coder = encoder(path)
    widths = np.zeros(coder.n_vocab, np.int64)
    for token in coder.token_byte_values():
        widths[coder.encode_single_token(token)] = len(token)
    return widths


#: Bytes of the longest stretch whose length a worker remembers, and how many it remembers.
SHORT = 15
KNOWN = 1 << 20
#: Which bits of the two words of a stretch are its own, by its size; the highest byte holds the size.
_OWN_BITS = [np.array([(1 << 8 * min(max(n - at, 0), 8)) - 1 for n in range(SHORT + 1)] + [0], np.uint64) for at in (0, 8)]


@lru_cache(maxsize=1)
def _known(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Short stretches, as two words each, and their lengths: one for each slot, the last one that came."""
    return np.zeros(KNOWN, np.uint64), np.zeros(KNOWN, np.uint64), np.zeros(KNOWN, np.uint8)


def _two_words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and size of each stretch of at most ``SHORT`` bytes; no two different ones are equal."""
    words = np.append(data, np.zeros(24 - len(data) % 8, np.uint8)).view("<u8")
    at, shift = start >> 3, (start & 7).astype(np.uint64) << np.uint64(3)
    back = np.uint64(63) - shift
    middle = words[at + 1]
    low = (words[at] >> shift) | (middle << np.uint64(1) << back)
    high = (middle >> shift) | (words[at + 2] << np.uint64(1) << back)
    size = np.minimum(size, SHORT + 1)
    return low & _OWN_BITS[0][size], (high & _OWN_BITS[1][size]) | (size.astype(np.uint64) << np.uint64(56))


def _encoded_lengths(stretches: pa.LargeStringArray, path: str) -> np.ndarray:
    """How many ids each stretch has; equal ones are encoded once."""
    coder, found = encoder(path), stretches.dictionary_encode()
    data, offsets = scan.texts(found.dictionary)
    # Side by side, stretches keep their ids if each begins with a blank and ends with another character.
    plain = ~scan.NOT_BLANK[data[offsets[:-1]]] & ~_ends_blank(data, offsets[1:])
    length = np.empty(len(plain), np.int64)
    length[~plain] = [len(coder.encode_ordinary(s)) for s in found.dictionary.filter(pa.array(~plain)).to_pylist()]
    data, offsets = scan.texts(found.dictionary.filter(pa.array(plain)))
    ids = np.array(coder.encode_ordinary(str(data, "utf-8")), np.int64)
    length[plain] = np.diff(np.searchsorted(np.cumsum(_widths(path)[ids]), offsets, side="right"))
    return length[found.indices.to_numpy()]


def lengths(array: pa.Array, path: str) -> np.ndarray:
    """How many ids each text of a string column has; of what a worker met before, only long stretches are encoded again."""
    data, offsets = scan.texts(array)
    start = _stretches(data, offsets)
    bounds = np.append(start, len(data))
    stretches = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(data))
    size = np.diff(bounds)
    low, high = _two_words(data, start, size)
    slot = (scan.mix(low + scan.mix(high)) % np.uint64(KNOWN)).astype(np.int64)
    known_low, known_high, known_length = _known(path)
    length = known_length[slot].astype(np.int64)
    fresh = np.flatnonzero((known_low[slot] != low) | (known_high[slot] != high) | (size > SHORT))
    length[fresh] = _encoded_lengths(stretches.take(pa.array(fresh)), path)
    fresh = fresh[size[fresh] <= SHORT]
    known_low[slot[fresh]], known_high[slot[fresh]] = low[fresh], high[fresh]
    # Of several stretches for one slot, the one that is in it now gives the length.
    fresh = fresh[(known_low[slot[fresh]] == low[fresh]) & (known_high[slot[fresh]] == high[fresh])]
    known_length[slot[fresh]] = length[fresh]
    sums = np.concatenate(([0], np.cumsum(length)))
    return np.diff(sums[np.searchsorted(start, offsets)])
