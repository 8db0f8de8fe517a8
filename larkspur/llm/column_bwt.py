"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Round j inserts into the sorted list of suffixes the one of j symbols of every document that
is so long: its place follows from the transform so far, and only the common prefixes next to
it change. Each round reads and writes the transform and the prefixes once from front to back.
The caller bounds a collection, so these two sequences are arrays.

Rounds are as many as a document has symbols, and each passes over all suffixes. So symbols
are words of up to eight bytes, and a string enters as one document for each place in a word
where it can begin: an eighth of the rounds, with eight times the documents.
"""

from __future__ import annotations

import numpy as np

#: Common prefixes are counted up to this.
MOST = 255
#: Bits of a place in an occurrence, whose upper bits are the symbol.
PLACE_BITS = 32


def insert(values: np.ndarray, at: np.ndarray, new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The sequence with ``new`` at places ``at`` (of the result) and ``values`` in between; ``old`` marks their places."""
    out = np.empty(len(old), dtype=values.dtype)
    out[old] = values
    out[at] = new
    return out


class RangeMinimum:
    """Least of any range of a sequence, from the minima of all runs of 1, 2, 4 ... members."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.runs = np.empty((longest.bit_length(), len(values)), dtype=values.dtype)
        self.runs[0] = values
        for k in range(1, len(self.runs)):
            half = 1 << (k - 1)
            np.minimum(self.runs[k - 1, :-half], self.runs[k - 1, half:], out=self.runs[k, :-half])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of ``first .. last`` for each pair; every range has a member."""
        level = np.frexp((last - first + 1).astype(np.float64))[1].astype(np.int64) - 1
        row = level * self.runs.shape[1]
        flat = self.runs.reshape(-1)
        return np.minimum(flat.take(row + first), flat.take(row + last + 1 - (1 << level)))


def transform(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences, common) of a collection, whose documents end in marks of their own that sort by number.

    ``symbols`` joins the documents, ``sizes`` has the symbols of each. The transform is the
    symbol before each suffix in the order of all suffixes; it is returned turned around, as
    the sorted (symbol, place) of each of its members but those of whole documents, in one
    number: the k-th tells where the rest of the k-th suffix that isn't empty stands.
    ``common`` holds the length of a suffix's common prefix with the one before it, up to MOST.
    """
    n = len(sizes)
    mask = np.int64((1 << PLACE_BITS) - 1)
    ends = np.cumsum(sizes)
    occurrences = np.zeros(0, dtype=np.int64)
    common = np.zeros(n, dtype=np.uint8)
    active = np.flatnonzero(sizes > 0)
    place = active.copy()
    j = 0
    while len(active):
        own = symbols[ends[active] - j - 1].astype(np.int64)
        new = own << PLACE_BITS | place
        by = np.argsort(new)
        new, active, place, own = new[by], active[by], place[by], own[by]
        at = np.searchsorted(occurrences, new) + np.arange(len(new))
        old = np.ones(len(occurrences) + len(new), dtype=bool)
        old[at] = False
        occurrences = insert(occurrences, at, new, old)

        before, after = occurrences[np.maximum(at - 1, 0)], occurrences[np.minimum(at + 1, len(occurrences) - 1)]
        has, follows = (at > 0) & (before >> PLACE_BITS == own), (at + 1 < len(occurrences)) & (after >> PLACE_BITS == own)
        low, high = (before[has] & mask) + 1, after[follows] & mask
        widest = max(int((place[has] - low).max(initial=0)), int((high - place[follows]).max(initial=0))) + 1
        least = RangeMinimum(common, widest)
        shared = np.zeros(len(at), dtype=np.uint8)
        shared[has] = np.minimum(least(low, place[has]), MOST - 1) + 1
        next_shared = np.minimum(least(place[follows] + 1, high), MOST - 1) + 1

        target = at + n
        old = np.concatenate([np.ones(n, dtype=bool), old])
        common = insert(common, target, shared, old)
        common[target[follows] + 1] = next_shared
        moved = (np.flatnonzero(old) - np.arange(len(common) - len(at))).astype(np.int32)
        occurrences += moved.take(occurrences & mask)
        j += 1
        more = sizes[active] > j
        active, place = active[more], target[more]
    return occurrences, common


def documents_of(strings: list[bytes], word: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, sizes) of the documents of all strings: whole words from the first, second ... ``word``-th byte on."""
    data = np.frombuffer(b"".join(strings) + bytes(word), dtype=np.uint8).astype(np.uint64)
    words = np.zeros(len(data) - word, dtype=np.uint64)
    for i in range(word):
        words = words << np.uint64(8) | data[i : i + len(words)]
    _, ranks = np.unique(words, return_inverse=True)
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    begin = np.cumsum(sizes) - sizes
    each = np.maximum(0, (sizes[:, None] - np.arange(word)) // word).ravel()
    first = (begin[:, None] + np.arange(word)).ravel()
    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return ranks[np.repeat(first, each) + word * within].astype(np.int32), each


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, the starts of those substrings of ``length`` bytes that start at another place of the collection too."""
    word = next(w for w in (8, 4, 2, 1) if length % w == 0)
    if length // word > MOST:
        raise ValueError(f"at most {MOST} symbols")
    symbols, sizes = documents_of(strings, word)
    occurrences, common = transform(symbols, sizes)
    n = len(sizes)
    long = common >= length // word
    long[:-1] |= long[1:]
    back = np.zeros(len(common), dtype=np.int64)
    back[occurrences & ((1 << PLACE_BITS) - 1)] = np.arange(len(occurrences)) + n
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    ends = np.cumsum(lengths)
    first = ((ends - lengths)[:, None] + np.arange(word)).ravel()
    found = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=bool)
    active = np.flatnonzero(sizes > 0)
    place = active.copy()
    j = 1
    while len(active):
        place = back[place]
        if j >= length // word:
            found[first[active] + word * (sizes[active] - j)] = long[place]
        more = sizes[active] > j
        active, place = active[more], place[more]
        j += 1
    return [np.flatnonzero(found[e - s : e]) for s, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
