"""Packing of token sequences by non-negative least squares on the length histogram."""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage, gapless_rank, pieces_for, text_bytes

#: Random numbers that order pieces of one length have so many bits.
KEY_BITS = 62
#: What a piece is when it fills a window by itself, and the most pieces of a combination.
DEPTH = 3
#: Pieces shorter than so many units are put into bundles of up to so many units first, by their exact lengths.
SHORT_UNITS, BUNDLE_UNITS = 4, 32


@lru_cache(maxsize=2)
def encoder(vocabulary_path: str, pattern: str) -> tiktoken.Encoding:
    """Encoder for a byte-level vocabulary file, which writes bytes as printable characters.

    A token's id is its merge rank in such a file, which is verified; then ids by rank are
    the ids of the file's own library, at a fraction of its time. Added tokens are found in
    texts first, as that library does, and what is between them is encoded piece by piece.
    Other normalizers or pre-tokenizers than the pattern on bytes are an error, and so are
    added tokens that take the space or the words around them into account.
    """
    whole = json.loads(Path(vocabulary_path).read_text(encoding="utf-8"))
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    if whole.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("this vocabulary changes or splits texts in another way")
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
    if any(model["vocab"][m.replace(" ", "")] != 256 + i for i, m in enumerate(merges)):
        raise ValueError("the ids of this vocabulary are not its merge ranks")
    added = {t["content"]: t["id"] for t in whole.get("added_tokens") or ()}
    if any(t.get(k) for t in whole.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip")) or any(a != b and a in b for a in added for b in added):
        raise ValueError("added tokens of this vocabulary need more than a search for them")
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def token_pieces(df: DataFrame, vocabulary_path: str, pattern: str, window: int, end_id: int, id_col: str, text_col: str, seed: int, keep_ids: bool) -> DataFrame:
    """Each row's ids with ``end_id`` after them, cut into pieces of ``window`` ids and a rest."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{id_col}` {kinds[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, _key long" + ", ids array<int>" * keep_ids

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path, pattern)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                which, rows, kept = [], [], []
                for k, data in enumerate(text_bytes(part.column(1))):
                    ids = np.array([*own.encode(data.decode("utf-8", "replace"), allowed_special="all"), end_id], dtype="<u4")
                    for at in range(0, len(ids), window):
                        piece = ids[at : at + window]
                        which.append(k)
                        rows.append((at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                        kept += [piece.astype(np.int32)] * keep_ids
                values = np.array(rows, dtype=np.int64)
                arrays = [part.column(0).take(pa.array(which)), *(pa.array(values[:, i]) for i in range(4)), pa.array(rng.integers(0, 1 << KEY_BITS, len(rows)))]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "_key"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(id_col, text_col).mapInArrow(convert, schema)


def combinations_filling(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All falling tuples of up to ``depth`` sizes from 1 that add up to ``bins``."""

    def parts(left: int, most: int, depth: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif depth:
            for size in range(min(left, most), 0, -1):
                for rest in parts(left - size, size, depth - 1):
                    yield (size, *rest)

    return list(parts(bins, bins, depth))


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with least |ax - b|, by the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(6 * a.shape[0] + 10):
        gain = np.where(active, -np.inf, a.T @ (b - a @ x))
        if gain.max(initial=-np.inf) <= tolerance:
            break
        active[int(gain.argmax())] = True
        while True:
            trial = np.zeros_like(x)
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            below = active & (trial <= 0)
            if not below.any():
                break
            step = np.min(x[below] / np.maximum(x[below] - trial[below], 1e-300))
            x = x + step * (trial - x)
            active &= x > 1e-12
            x[~active] = 0
        x = trial
    return x


def plan(histogram: dict[int, int], bins: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination of sizes, repeats) that use up ``histogram`` (pieces by size from 1 to ``bins``) exactly.

    Repeats of combinations that fill a window solve a least-squares problem whose rows weigh
    as much as their sizes; they are rounded and cut to what is there. The rest is packed
    largest size first, each window taking the largest sizes that still fit; as whole sizes
    are dealt with at once, that takes no more steps than there are sizes.
    """
    left = Counter({s: n for s, n in histogram.items() if n})
    chosen: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(left)
    usable = [c for c in combinations_filling(bins, depth) if all(s in left for s in c)]
    if usable:
        row = {s: i for i, s in enumerate(sizes)}
        a = np.zeros((len(sizes), len(usable)))
        for j, c in enumerate(usable):
            for s in c:
                a[row[s], j] += s
        x = nonnegative_least_squares(a, np.array([left[s] * s for s in sizes], dtype=float))
        for j in np.argsort(-x, kind="stable").tolist():
            need = Counter(usable[j])
            repeats = min(round(float(x[j])), *(left[s] // k for s, k in need.items()))
            if repeats > 0:
                chosen.append((usable[j], repeats))
                left -= Counter({s: k * repeats for s, k in need.items()})
    while left:
        room, need = bins, Counter()
        for s in sorted(left, reverse=True):
            if k := min(left[s], room // s):
                need[s], room = k, room - k * s
        repeats = min(left[s] // k for s, k in need.items())
        chosen.append((tuple(need.elements()), repeats))
        left -= Counter({s: k * repeats for s, k in need.items()})
    return chosen


def places(chosen: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By size: first number of a run of pieces, its first window, and the slot in these windows."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter[int] = Counter()
    base = 0
    for combination, repeats in chosen:
        for slot, size in enumerate(combination):
            found.setdefault(size, []).append((used[size], base, slot))
            used[size] += repeats
        base += repeats
    return {s: tuple(np.array(x, dtype=np.int64).T) for s, x in found.items()}


def placed_at(table: tuple[np.ndarray, ...], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window and slot of the pieces numbered ``rank``."""
    starts, bases, slots = table
    k = np.searchsorted(starts, rank, side="right") - 1
    return bases[k] + rank - starts[k], slots[k]


def pack_documents(df: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, unit: int = 16, end_id: int = 1, seed: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pack the ids of all texts into sequences of at most ``window`` ids.

    Returns, for each piece, id_col, start (ids of its row before it), length, ids_crc32,
    doc_tokens, sequence_id and offset (where it stands there, gapless from 0), with
    ``keep_ids`` also its ids. A row's ids end with ``end_id``; longer rows are cut at
    multiples of ``window``.

    Pieces are made in one pass and checkpointed. Their lengths, rounded up to multiples of
    ``unit``, give a histogram of window / unit counts; only this reaches the driver, where
    combinations are chosen (see ``plan``). Short pieces count by exact lengths there and are
    bundled first; a bundle then counts like a piece. Pieces of a size are numbered in random
    order, in bounded parts, and a number tells the sequence. Null and empty texts have the
    end id only; null ids are kept; repeated rows are packed each; no rows give no pieces;
    other input columns are left out.
    """
    bins = window // unit
    bundle = min(BUNDLE_UNITS, bins) * unit
    short = min(SHORT_UNITS * unit, bundle)
    size = F.when(F.col("length") < short, -F.col("length")).otherwise(F.ceil(F.col("length") / unit)).cast("int")
    pieces = token_pieces(df, vocabulary_path, pattern, window, end_id, id_col, text_col, seed, keep_ids)
    pieces = cut_lineage(pieces.withColumn("_size", size).withColumn("_row", F.monotonically_increasing_id()))
    histogram = {r["_size"]: r["count"] for r in pieces.groupBy("_size").count().collect()}
    bundles = plan({-s: n for s, n in histogram.items() if s < 0}, bundle, 0)
    bundle_tables = places(bundles)
    units = Counter({s: n for s, n in histogram.items() if s > 0})
    whole: list[tuple[int, int, int]] = []
    base = 0
    for combination, repeats in bundles:
        s = -(-sum(combination) // unit)
        whole.append((base, s, units[s]))
        units[s] += repeats
        base += repeats
    bundle_base, bundle_size, bundle_rank = np.array(whole, dtype=np.int64).reshape(-1, 3).T
    tables = places(plan(dict(units), bins))

    bits = pieces_for(max(histogram.values(), default=0), 1, 512).bit_length() - 1
    ranked = gapless_rank(pieces.withColumn("_piece", F.shiftright("_key", KEY_BITS - bits)), ["_size"], ["_key", "_row"], "_piece", "_rank")
    own = [id_col, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    fields = {f.name: f for f in pieces.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in own) + ", sequence_id long, _slot long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.array(batch.column(len(own) + i).to_numpy(zero_copy_only=False), dtype=np.int64) for i in range(2))
            inner = np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size[size < 0]).tolist():
                at = size == s
                number, inner[at] = placed_at(bundle_tables[-s], rank[at])
                k = np.searchsorted(bundle_base, number, side="right") - 1
                rank[at] = bundle_rank[k] + number - bundle_base[k]
                size[at] = bundle_size[k]
            ids, slot = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size).tolist():
                at = size == s
                ids[at], slot[at] = placed_at(tables[s], rank[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(ids), pa.array(slot * bundle + inner)], [*own, "sequence_id", "_slot"])

    placed = ranked.select(*own, "_size", "_rank").mapInArrow(place, schema)
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_slot")
