"""Periodic runs of words, found by block convolution with an exact integer transform."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from larkspur.llm.common import slices

#: A prime of the form 7 * 2**20 + 1 and a generator of its units.
PRIME, GENERATOR = 7340033, 3
#: A transform of more points goes through matrices of this many; with centred residues the sums stay below 2**53.
RADIX = 64
#: Longest block; twice as many points are the longest transform that the prime has.
WIDEST = 1 << 19
#: Elements of a batch of transforms.
AT_ONCE = 1 << 19
#: Words of a text that are Python objects at a time, and bytes of texts searched together.
WORDS_AT_ONCE, BYTES_AT_ONCE = 1 << 17, 1 << 22


def reduced(x: np.ndarray) -> np.ndarray:
    """Residues between -PRIME/2 and PRIME/2 of whole numbers below 2**53; zero only for multiples."""
    return x - np.rint(x * (1 / PRIME)) * PRIME


@lru_cache(maxsize=64)
def _power_table(rows: int, columns: int, points: int, inverse: bool) -> np.ndarray:
    """root**(i * k) for the root of unity of ``points``, or of its inverse."""
    root = pow(GENERATOR, (PRIME - 1) // points, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    powers = np.empty(points)
    now = 1
    for i in range(points):
        powers[i] = now
        now = now * root % PRIME
    return reduced(powers[np.outer(np.arange(rows), np.arange(columns)) % points])


def forward(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, a power of two of points, in an order that ``backward`` undoes."""
    n = x.shape[-1]
    if n <= RADIX:
        return reduced(x @ _power_table(n, n, n, False))
    m = n // RADIX
    outer = reduced(np.matmul(_power_table(RADIX, RADIX, RADIX, False), x.reshape(*x.shape[:-1], RADIX, m)))
    return forward(reduced(outer * _power_table(RADIX, m, n, False))).reshape(x.shape)


def backward(x: np.ndarray) -> np.ndarray:
    """What ``forward`` was given."""
    n = x.shape[-1]
    if n <= RADIX:
        return reduced(reduced(x @ _power_table(n, n, n, True)) * pow(n, -1, PRIME))
    m = n // RADIX
    inner = reduced(backward(x.reshape(*x.shape[:-1], RADIX, m)) * _power_table(RADIX, m, n, True))
    return reduced(reduced(np.matmul(_power_table(RADIX, RADIX, RADIX, True), inner)) * pow(RADIX, -1, PRIME)).reshape(x.shape)


def zero_mismatches(x: np.ndarray, block: int, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, distances): blocks of ``x`` that occur again ``low`` to ``low + block - 1`` symbols later.

    The squared differences of a block and the window behind it, at every distance, are the
    squares of both less twice their correlation, modulo the prime. Where that is zero the
    block occurs; a true sum that is a multiple of the prime is told from it by the extension.
    """
    blocks = len(x) // block
    if not blocks:
        return
    ids = reduced(x.astype(np.float64))
    padded = np.concatenate([ids, np.zeros(low + 2 * block)])
    squares = np.concatenate([[0.0], np.cumsum(reduced(padded * padded))])
    many = max(1, AT_ONCE // (2 * block))
    places = np.arange(2 * block)
    for a in range(0, blocks, many):
        starts = np.arange(a, min(a + many, blocks)) * block
        turned = np.zeros((len(starts), 2 * block))
        turned[:, -places[:block] % (2 * block)] = ids[starts[:, None] + places[:block]]
        windows = padded[starts[:, None] + low + places]
        met = backward(reduced(forward(turned) * forward(windows)))[:, :block]
        at = starts[:, None] + low + places[:block]
        sums = (squares[starts + block] - squares[starts])[:, None] + squares[at + block] - squares[at] - 2 * met
        row, distance = np.nonzero(reduced(sums) == 0)
        inside = starts[row] + low + distance + block <= len(x)
        yield starts[row[inside]], distance[inside] + low


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many symbols of both are equal from the start."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : at + step][: n - at] != b[at : at + step][: n - at])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def least_length(period: int, fewest: int, repeats: int) -> int:
    return max(fewest, repeats * period)


def runs_of(symbols: np.ndarray, fewest: int = 6, repeats: int = 4, widest: int = WIDEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run in ``symbols``, by scale, then place.

    A run has a smallest period and at least max(``fewest``, ``repeats`` periods) symbols;
    ``repeats`` is three at least. At scale B = 1, 2, 4 ... the runs of periods from B to 2B - 1
    are found: such a run holds two neighbouring blocks of B symbols, and their copies one
    period later. So blocks that occur again at one distance, several in a row, are extended
    symbol by symbol to both sides, which also makes sure of them. Blocks that lie with their
    copy in a run of a period no longer than a block are left out: that run has their distance, too.

    A symbol that occurs fewer than ``repeats`` times is in no run, so such symbols part
    the sequence; a scale looks only at parts that are long enough for its runs. All is
    near linear in the number of symbols, for any data.
    """
    if repeats < 3:
        raise ValueError("runs of fewer than three periods need more than two blocks")
    n = len(symbols)
    _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    rare = counts[inverse] < repeats
    ids = np.where(rare, len(counts) + np.arange(n), inverse)  # each place of a rare symbol is a symbol of its own
    cuts = np.concatenate([[-1], np.flatnonzero(rare), [n]])
    begins, lengths = cuts[:-1] + 1, np.diff(cuts) - 1
    found: list[tuple[int, int, int]] = []
    scale = 1
    while (parts := lengths >= least_length(scale, fewest, repeats)).any():
        inside = np.zeros(n + 2, dtype=np.int64)
        np.add.at(inside, begins[parts], 1)
        np.add.at(inside, begins[parts] + lengths[parts] + 1, -1)  # with the rare symbol behind each part
        where = np.flatnonzero(np.cumsum(inside)[:n])
        x = ids[where]
        block = min(scale, widest)
        reach, covered = furthest(n, found, scale), furthest(n, found, block)
        for low in range(scale, 2 * scale, block):
            seeds = list(zero_mismatches(x, block, low))
            starts, distances = (np.concatenate([s[k] for s in seeds]) if seeds else np.zeros(0, dtype=np.int64) for k in (0, 1))
            fresh = covered[where[starts]] < where[starts] + distances + block
            longer = extended(x, starts[fresh], distances[fresh], block, fewest, repeats)
            found += [(int(where[a]), m, d) for a, m, d in longer if reach[where[a]] < where[a] + m]
        scale *= 2
    return found


def furthest(n: int, found: list[tuple[int, int, int]], period: int) -> np.ndarray:
    """For each place the furthest end of a run from there or before it with at most this period."""
    reach = np.zeros(n + 1, dtype=np.int64)
    own = np.array([(a, a + m) for a, m, d in found if d <= period], dtype=np.int64).reshape(-1, 2)
    np.maximum.at(reach, own[:, 0], own[:, 1])
    return np.maximum.accumulate(reach)


def extended(x: np.ndarray, starts: np.ndarray, distances: np.ndarray, block: int, fewest: int, repeats: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, distance) of the maximal stretches that seeds lie in, where they are long enough for a run."""
    if not len(starts):
        return
    order = np.lexsort((starts, distances))
    starts, distances = starts[order], distances[order]
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != block) | (np.diff(distances) != 0)]))
    ends = np.append(fresh[1:], len(starts))
    needed = np.maximum(fewest, repeats * distances[fresh]) - distances[fresh]
    for k in np.flatnonzero((ends - fresh) * block + 2 * (block - 1) >= needed):
        lo, hi, d = int(starts[fresh[k]]), int(starts[ends[k] - 1]) + block, int(distances[fresh[k]])
        while lo < hi:
            right = agreeing(x[lo:], x[lo + d :])
            left = agreeing(x[:lo][::-1], x[d : lo + d][::-1]) if right >= block else 0
            if left + right + d >= least_length(d, fewest, repeats):
                yield lo - left, left + right + d, d
            lo += block * max(1, -(-right // block))


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: all but those after the first period of a run."""
    over = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        over[start + period] += 1
        over[start + length] -= 1
    return np.cumsum(over)[:n] == 0


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number at a time."""
    while text:
        own = text.split(None, WORDS_AT_ONCE)
        text = own.pop() if len(own) > WORDS_AT_ONCE else b""
        yield own


def read_words(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Each word as the place of the first word equal to it among the different words, and these."""
    places: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts = [np.fromiter(map(places.__getitem__, own), dtype=np.int64, count=len(own)) for own in words_of(text)]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), list(places)


def kept_text(ids: np.ndarray, words: list[bytes], keep: np.ndarray) -> bytes:
    """The kept words, joined by one space."""
    left = ids[keep]
    return b" ".join(b" ".join(map(words.__getitem__, left[i : i + WORDS_AT_ONCE].tolist())) for i in range(0, len(left), WORDS_AT_ONCE))


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(df: DataFrame, text_col: str = "text", fewest: int = 6, repeats: int = 4) -> DataFrame:
    """``df`` with word_runs, an array of (start, length, period) by start, then period, and run_collapsed, the text without the repeats of its runs.

    Words are runs of anything but ASCII white space, numbered from 0. A run is a stretch
    with a smallest period, ``repeats`` periods and ``fewest`` words at least, that no
    neighbouring word extends. Words after the first period of a run go; the others are
    joined by one space. Null and empty texts have no run and collapse to the empty text.
    Texts are searched whole, whatever their length; rows are independent, so ties,
    repeated rows and other columns pass through, and an empty table stays empty.

    Texts of a few megabytes are searched as one sequence, each word with the number of its row, so that
    no run goes over the end of a text and short ones cost no calls of their own.
    """
    taken = {"word_runs", "run_collapsed"} & set(df.columns)
    if taken:
        raise ValueError(f"columns in the way: {sorted(taken)}")
    names = df.columns
    at = names.index(text_col)
    schema = StructType([*df.schema.fields, *StructType.fromDDL("word_runs array<struct<start:bigint,length:bigint,period:bigint>>").fields, StructField("run_collapsed", StringType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).cast(pa.binary())
            first = 0
            while first < batch.num_rows:
                read, size, bases = [], 0, [0]
                while first + len(read) < batch.num_rows and (not read or size < BYTES_AT_ONCE):
                    text = texts[first + len(read)].as_py() or b""
                    read.append(read_words(text))
                    size += len(text)
                    bases.append(bases[-1] + len(read[-1][0]))
                yield _answer(batch.slice(first, len(read)), read, np.array(bases))
                first += len(read)

    def _answer(rows: pa.RecordBatch, read: list, bases: np.ndarray) -> pa.RecordBatch:
        offsets = np.cumsum([0, *(len(words) for _, words in read)])
        symbols = np.concatenate([np.concatenate([ids + o, [-1 - k]]) for k, ((ids, _), o) in enumerate(zip(read, offsets[:-1], strict=True))])
        bounds = bases + np.arange(len(bases))  # a mark of its own behind each text
        own: list[list[tuple[int, int, int]]] = [[] for _ in read]
        for start, length, period in sorted((s, p, m) for s, m, p in runs_of(symbols, fewest, repeats)):
            k = int(np.searchsorted(bounds, start, side="right")) - 1
            own[k].append((start - int(bounds[k]), period, length))
        left = [kept_text(ids, words, collapse(len(ids), runs)) for (ids, words), runs in zip(read, own, strict=True)]
        listed = pa.array([[{"start": s, "length": m, "period": p} for s, m, p in runs] for runs in own], RUNS)
        return pa.RecordBatch.from_arrays([*rows.columns, listed, pa.array(left, pa.binary()).cast(pa.string())], [*names, "word_runs", "run_collapsed"])

    return df.mapInArrow(convert, schema)
