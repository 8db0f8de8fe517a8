"""Cuts texts into runs of positions whose windows share their least gram, so that equal windows meet under one key."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

#: Bytes in a gram; a window is keyed by the least hash of its grams.
GRAM = 64
_RANDOM = np.random.default_rng(20_240_501)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _RANDOM.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Runs:
    """Runs of window starts in some texts: number of the text, first start, count, key of the windows and hash of the bytes that the run covers."""

    text: np.ndarray
    first: np.ndarray
    count: np.ndarray
    key: np.ndarray
    content: np.ndarray


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling."""
    h = _BYTES[data]
    size = 1
    while size < GRAM:
        h = h[:-size] * _STEPS[size.bit_length()] + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    return h


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from each position."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs_of(texts: list[bytes], window: int) -> Runs:
    """Maximal runs of window starts whose least gram is the same one, the leftmost of equal grams, in each text.

    Every start of a whole window is in exactly one run. Two equal windows, in any texts or
    in one, have equal keys and lie in different runs, as the gram has one place in a run.
    """
    joined = b"".join(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.maximum(0, sizes - window + 1)
    none = np.zeros(0, dtype=np.int64)
    if len(joined) < window:
        return Runs(none, none, none, none, none)
    grams = gram_hashes(np.frombuffer(joined, dtype=np.uint8))
    keys = sliding_minimum(grams, window - GRAM + 1)
    leaves = (keys[1:] != keys[:-1]) | (grams[: len(keys) - 1] == keys[:-1])
    cuts = np.unique(np.concatenate([np.flatnonzero(leaves) + 1, begin[:-1], begin[:-1] + starts]))
    cuts = cuts[cuts < len(keys)]
    text = np.searchsorted(begin, cuts, side="right") - 1
    end = np.minimum(np.concatenate([cuts[1:], [len(keys)]]), begin[text] + starts[text])
    good = cuts < end
    cuts, end, text = cuts[good], end[good], text[good]
    view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
    content = np.array([digest(view[a:b]) for a, b in zip(cuts.tolist(), (end + window - 1).tolist(), strict=True)], dtype=np.uint64)
    return Runs(text, cuts - begin[text], end - cuts, keys[cuts].view(np.int64), content.view(np.int64))
