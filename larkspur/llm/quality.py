"""Quality of texts by a generalised additive model with pairwise interactions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from larkspur.llm.common import slices, text_bytes
from larkspur.llm.periodic import read_words

#: What is measured on a text; shares are of bytes, words or lines, and bytes beyond ASCII count as letters.
FEATURES = (
    "log_bytes", "log_words", "letters", "upper_letters", "digits", "enders", "commas", "symbols", "blanks", "lines_per_byte", "byte_entropy", "packed_size",
    "word_length", "word_length_spread", "longest_word", "short_words", "distinct_words", "commonest_word", "equal_neighbours", "repeated_fives", "capital_words", "bare_words", "marked_words", "long_sentences",
    "repeated_lines", "words_per_line", "ended_lines",
)
OUTPUT = "quality_score"
BLOCK = 1 << 20
#: An odd number; a polynomial in it stands for five words in a row.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_BYTES = np.arange(256)
_IN = {
    "letters": (_BYTES >= 128) | np.isin(_BYTES, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "enders": np.isin(_BYTES, np.frombuffer(b".!?", np.uint8)),
    "commas": np.isin(_BYTES, np.frombuffer(b",;:", np.uint8)),
    "blanks": np.isin(_BYTES, np.frombuffer(b" \t\n\x0b\f\r", np.uint8)),
}
_IN["symbols"] = ~(_IN["letters"] | _IN["digits"] | _IN["enders"] | _IN["commas"] | _IN["blanks"])


def share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def different(numbers: np.ndarray) -> int:
    """How many different numbers there are; a set is faster for few, and sorting needs less memory for many."""
    return len(set(numbers.tolist())) if len(numbers) < 1 << 16 else len(np.unique(numbers))


def measured(text: bytes) -> list[float]:
    """The features of a whole text in UTF-8; an empty one has zeros."""
    counts = sum((np.bincount(np.frombuffer(text[i : i + BLOCK], np.uint8), minlength=256) for i in range(0, len(text), BLOCK)), np.zeros(256, dtype=np.int64))
    n = len(text)
    of = {k: int(counts[inside].sum()) for k, inside in _IN.items()}
    p = counts[counts > 0] / max(1, n)
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(text[i : i + BLOCK])) for i in range(0, n, BLOCK)) + len(packer.flush())
    ids, words = read_words(text)
    m = len(ids)
    often = np.bincount(ids, minlength=len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    firsts, lasts = (np.frombuffer(bytes([w[i] for w in words]), np.uint8) for i in (0, -1))
    bare = np.fromiter(map(bytes.isalpha, words), dtype=bool, count=len(words)) | ~np.fromiter(map(bytes.isascii, words), dtype=bool, count=len(words))
    odd = _IN["symbols"][lasts]
    mean = share(float(often @ lengths), m)
    numbers = ids.astype(np.uint64)
    fives = np.zeros(max(0, m - 4), dtype=np.uint64)
    for k in range(5):
        fives = fives * MULTIPLIER + numbers[k : k + len(fives)]
    lines = Counter(line.strip() for line in text.split(b"\n"))
    lines.pop(b"", None)
    rows = sum(lines.values())
    return [
        np.log1p(n), np.log1p(m), share(of["letters"], n), share(of["upper"], of["letters"]), share(of["digits"], n), share(of["enders"], n), share(of["commas"], n), share(of["symbols"], n), share(of["blanks"], n), share(int(counts[10]), n), float(-(p * np.log2(p)).sum()), share(packed, n + 20),
        mean, share(float(often @ (lengths - mean) ** 2), m) ** 0.5, np.log1p(lengths.max(initial=0)), share(int(often[lengths <= 3].sum()), m), share(len(words), m), share(int(often.max(initial=0)), m), share(int((ids[1:] == ids[:-1]).sum()), m - 1),
        1 - share(different(fives), len(fives)) if len(fives) else 0.0, share(int(often[_IN["upper"][firsts]].sum()), m), share(int(often[bare].sum()), m), share(int(often[odd].sum()), m), np.log1p(share(m, of["enders"] + 1)),
        1 - share(len(lines), rows) if rows else 0.0, np.log1p(share(m, rows)), share(sum(c for line, c in lines.items() if line[-1:] in b".!?"), rows),
    ]


@dataclass(frozen=True)
class Model:
    """Cuts of each feature into bins, a table of values for each feature and for each pair, and the sum they start from."""

    start: float
    cuts: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_tables: tuple[np.ndarray, ...]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1) if len(self.cuts) else np.zeros((len(x), 0), dtype=np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for rows of features: table values of their bins, added up."""
        bins = self.binned(x)
        total = np.full(len(x), self.start)
        for i, t in enumerate(self.tables):
            total += t[bins[:, i]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[bins[:, i], bins[:, j]]
        return 1 / (1 + np.exp(-total))


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradients ``g`` and weights ``h``; (0, 0) if none helps."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    gain[(left_h < least) | (all_h - left_h < least)] = 0
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 1e-9 else (0.0, 0)


def shallow(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Values by bin of a tree with few leaves, grown by the best cut each time."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        found = [(*best_cut(g[a:b], h[a:b], ridge, least), a, b) for a, b in parts]
        gain, at, a, b = max(found)
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def shallow_pair(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and values by pair of bins of a tree that cuts one feature, then the other on either side."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        sums_g, sums_h = np.cumsum(a, axis=0), np.cumsum(b, axis=0)
        for cut in range(1, len(a)):
            out, gain = np.zeros_like(a), 0.0
            for side, gs, hs in ((slice(0, cut), sums_g[cut - 1], sums_h[cut - 1]), (slice(cut, None), sums_g[-1] - sums_g[cut - 1], sums_h[-1] - sums_h[cut - 1])):
                won, at = best_cut(gs, hs, ridge, least)
                gain += won
                if at:
                    out[side, :at], out[side, at:] = gs[:at].sum() / (hs[:at].sum() + ridge), gs[at:].sum() / (hs[at:].sum() + ridge)
            if gain > best[0]:
                best = gain, (out.T if turned else out)
    return best


def learn(x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 6, pairs: int = 8, rounds: int = 300, patience: int = 25, rate: float = 0.1, leaves: int = 3, bags: int = 4, ridge: float = 1.0, least: float = 0.5, seed: int = 5) -> Model:
    """Learn from features ``x`` and labels ``y`` by cyclic boosting.

    A round goes through all features; each gets a shallow tree on the present residuals, whose
    values go into the table of that feature. Then the pairs that explain most of what is
    left get theirs the same way. Rounds end when rows left out of a bag no longer gain;
    the tables of several bags are averaged. Labels of one kind only give a constant, none 0.5.
    """
    share_of_one = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share_of_one / (1 - share_of_one)))
    if len(y) == 0 or y.min() == y.max():
        return Model(start if len(y) else 0.0, (), (), (), ())
    cuts = tuple(np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for i in range(x.shape[1]))
    model = Model(start, cuts, (), (), ())
    b = model.binned(x)
    sizes = [len(c) + 1 for c in cuts]
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(y)) % max(2, bags)
    tables = [np.zeros(s) for s in sizes]
    chosen: tuple[tuple[int, int], ...] = ()
    residual, weight = np.zeros(len(y)), np.zeros(len(y))
    states = []
    for bag in range(bags):
        own, out = fold != bag, fold == bag
        total = np.full(len(y), start)
        now = [np.zeros(s) for s in sizes]

        def step(i: int, own=own, total=total, now=now) -> None:
            p = 1 / (1 + np.exp(-total[own]))
            g, h = (np.bincount(b[own, i], w, minlength=sizes[i]) for w in (y[own] - p, p * (1 - p)))
            change = rate * shallow(g, h, leaves, ridge, least)
            now[i] += change
            total += change[b[:, i]]

        kept = boosted(step, range(len(sizes)), now, total, y, out, rounds, patience)
        total[:] = start + sum(t[b[:, i]] for i, t in enumerate(kept))
        for t, k in zip(tables, kept, strict=True):
            t += k / bags
        p = 1 / (1 + np.exp(-total))
        residual += (y - p) / bags
        weight += p * (1 - p) / bags
        states.append((own, out, total))
    coarse = [np.searchsorted(np.unique(np.quantile(b[:, i], np.linspace(0, 1, pair_bins + 1)[1:-1], method="lower")), np.arange(s), side="left") for i, s in enumerate(sizes)]
    wide = [int(c.max()) + 1 for c in coarse]
    small = np.stack([c[b[:, i]] for i, c in enumerate(coarse)], axis=1)

    def grid(i: int, j: int, w: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(small[rows, i] * wide[j] + small[rows, j], w, minlength=wide[i] * wide[j]).reshape(wide[i], wide[j])

    gains = [(shallow_pair(grid(i, j, residual), grid(i, j, weight), ridge, least)[0], i, j) for i, j in combinations(range(len(sizes)), 2)]
    chosen = tuple((i, j) for gain, i, j in sorted(gains, reverse=True)[:pairs] if gain > 0)
    pair_tables = [np.zeros((wide[i], wide[j])) for i, j in chosen]
    for own, out, total in states:
        now = [np.zeros_like(t) for t in pair_tables]

        def step_pair(k: int, own=own, total=total, now=now) -> None:
            i, j = chosen[k]
            p = 1 / (1 + np.exp(-total[own]))
            change = rate * shallow_pair(grid(i, j, y[own] - p, own), grid(i, j, p * (1 - p), own), ridge, least)[1]
            now[k] += change
            total += change[small[:, i], small[:, j]]

        for t, k in zip(pair_tables, boosted(step_pair, range(len(chosen)), now, total, y, out, rounds // 4, patience // 4), strict=True):
            t += k / bags
    full = tuple(t[np.ix_(coarse[i], coarse[j])] for (i, j), t in zip(chosen, pair_tables, strict=True))
    return Model(start, cuts, tuple(tables), chosen, full)


def boosted(step, turns: range, now: list[np.ndarray], total: np.ndarray, y: np.ndarray, out: np.ndarray, rounds: int, patience: int) -> list[np.ndarray]:
    """The tables ``now`` as they were when the rows ``out`` fitted best."""

    def loss() -> float:
        return float(np.mean(np.logaddexp(0, np.where(y[out] > 0, -total[out], total[out])))) if out.any() else 0.0

    best, kept, since = loss(), [t.copy() for t in now], 0
    for _ in range(rounds):
        for i in turns:
            step(i)
        reached = loss()
        if reached < best - 1e-6:
            best, kept, since = reached, [t.copy() for t in now], 0
        elif (since := since + 1) >= patience:
            break
    return kept


def features(df: DataFrame, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(the columns ``carry``, x array<double>) of each row, from whole texts; null text counts as empty."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([measured(t) for t in text_bytes(batch.column(len(carry)))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*carry, "x"])

    return df.select(*carry, text_col).mapInArrow(convert, StructType([*(df.schema[c] for c in carry), *StructType.fromDDL("x array<double>").fields]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, seed: int = 11, **how: float) -> Model:
    """Learn from the labelled rows of ``docs``; ``labels`` has (id_col, label_col 0/1), rows with nulls are left out.

    The sample is bounded at any size: of the labels the ``sample_rows`` with the least
    hashes of their ids are taken, which Spark finds as a top-k, and are sent to where the texts
    are. As many rows of features at most reach the driver, where a table has tens of bins.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("double").alias("_y"))
    drawn = known.withColumn("_h", F.xxhash64(id_col, F.lit(seed))).orderBy("_h", id_col, "_y").limit(sample_rows).drop("_h")
    rows = features(docs.select(id_col, text_col).join(F.broadcast(drawn), id_col), text_col, (id_col, "_y"))
    sample = rows.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col, "_y", "x").limit(sample_rows).toArrow()
    y = np.array(sample.column("_y").to_pylist(), dtype=float)
    x = np.array(sample.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return learn(x, (y > 0).astype(float), **how)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with quality_score (double, 0 to 1, higher where label 1 is likelier), from whole texts in one pass without a shuffle.

    Null texts score as empty ones, by the bins that a text without a byte falls into.
    Equal texts score the same; other columns pass through, but for one of that name, which is replaced.
    """
    own = [f for f in df.schema.fields if f.name != OUTPUT]
    names = [f.name for f in own]
    at = names.index(text_col)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([measured(t) for t in text_bytes(batch.column(at))], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*names, OUTPUT])

    return df.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(convert, StructType([*own, StructField(OUTPUT, DoubleType())]))
