"""Removal of long byte strings that occur more than once in a corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from larkspur.llm.column_bwt import repeated_starts
from larkspur.llm.common import cut_lineage, row_hash, slices, stored, text_bytes
from larkspur.llm.minimizers import GRAM, gram_hashes, runs_of

#: Bytes of text whose positions are hashed at once.
BUFFER = 400_000
#: Strings of a collection, if no bucket has more.
COLLECTION = 600
#: Windows of a crowded key are told apart by where the gram lies in them, in classes of so many places.
CLASS = 16
#: A range of positions in one long: the first, then the count in the lowest bits.
COUNT_BITS = 8


def packed(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (np.asarray(at, dtype=np.int64) << COUNT_BITS) | np.asarray(count, dtype=np.int64)


def unpacked(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ranges >> COUNT_BITS, ranges & ((1 << COUNT_BITS) - 1)


def cut_runs(rows: DataFrame, length: int) -> DataFrame:
    """(_a, _b, _at, m, c) for each run of window starts of each text: its range, the key of its windows and the hash of its bytes."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = text_bytes(batch.column(2))
            sizes = np.cumsum([0, *map(len, texts)])
            cuts = [0, *np.searchsorted(sizes, np.arange(BUFFER, sizes[-1] + BUFFER, BUFFER)).tolist()]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < (hi := min(hi, len(texts))):
                    runs = runs_of(texts[lo:hi], length)
                    which = pa.array(runs.text + lo)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(packed(runs.first, runs.count)), pa.array(runs.key), pa.array(runs.content)], ["_a", "_b", "_at", "m", "c"])

    return rows.select("_a", "_b", "_text").mapInArrow(convert, "_a long, _b long, _at long, m long, c long")


def pack_texts(rows: DataFrame) -> DataFrame:
    """``rows`` with the text as compressed UTF-8 bytes, which makes it lighter to exchange."""
    names = [c for c in rows.columns if c != "_text"]
    schema = StructType([*(rows.schema[c] for c in names), StructField("_z", BinaryType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            z = pa.array([press.compress(x) for x in text_bytes(batch.column(len(names)))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], z], [*names, "_z"])

    return rows.select(*names, "_text").mapInArrow(convert, schema)


def slice_contents(wanted: DataFrame, length: int) -> DataFrame:
    """(m, c, s) with the bytes ``s`` of each wanted run; ``wanted`` has _z and runs (array of at, m, c)."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in slices(batches, 100):
            out: list[list] = [[], [], []]
            for z, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = unpress.decompress(z)
                for r in runs:
                    at, count = r["at"] >> COUNT_BITS, r["at"] & ((1 << COUNT_BITS) - 1)
                    for x, v in zip(out, (r["m"], r["c"], data[at : at + count + length - 1]), strict=True):
                        x.append(v)
            for i in range(0, len(out[0]), 20_000):
                part = [x[i : i + 20_000] for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["m", "c", "s"])

    return wanted.select("_z", "runs").mapInArrow(convert, "m long, c long, s binary")


def classes_of(contents: DataFrame, length: int) -> DataFrame:
    """(m, c, at, k) for each class of windows of each content: their range in it, and a key from the bytes that all windows of the class would share.

    The class of a window says where the key's gram lies in it, so equal windows have equal
    classes; the bytes shared by a class hold the gram and are in each of its windows, so
    equal windows have equal keys.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[int]] = [[], [], [], []]
            for m, c, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                grams = gram_hashes(np.frombuffer(s, dtype=np.uint8)).view(np.int64)
                gram, windows = int(np.flatnonzero(grams == m)[0]), len(s) - length + 1
                for j in range(max(0, gram - windows + 1) // CLASS, min(gram, length - GRAM) // CLASS + 1):
                    last = gram - CLASS * j
                    first = last - CLASS + 1
                    k = xxhash.xxh3_64_intdigest(s[last : first + length], j)
                    lo = max(0, first)
                    for x, v in zip(out, (m, c, (lo << COUNT_BITS) | (min(last, windows - 1) - lo + 1), k - (1 << 64) if k >> 63 else k), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["m", "c", "at", "k"])

    return contents.select("m", "c", "s").mapInArrow(convert, "m long, c long, at long, k long")


def cut_classes(wanted: DataFrame, length: int) -> DataFrame:
    """(m, c, at, k, c2, s2) with the bytes of each wanted class and their hash; ``wanted`` has m, c, s and cuts (array of at, k)."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for m, c, s, cuts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for cut in cuts:
                    lo, n = cut["at"] >> COUNT_BITS, cut["at"] & ((1 << COUNT_BITS) - 1)
                    part = s[lo : lo + n + length - 1]
                    h = xxhash.xxh3_64_intdigest(part)
                    for x, v in zip(out, (m, c, cut["at"], cut["k"], h - (1 << 64) if h >> 63 else h, part), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.binary())], ["m", "c", "at", "k", "c2", "s2"])

    return wanted.select("m", "c", "s", "cuts").mapInArrow(convert, "m long, c long, at long, k long, c2 long, s2 binary")


def ranges_of(starts: np.ndarray) -> list[int]:
    """Ascending positions as packed ranges, of no more than the packing holds each."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) != 1) + 1
    first, last = starts[np.concatenate([[0], breaks])], starts[np.concatenate([breaks - 1, [len(starts) - 1]])]
    return packed(first, last - first + 1).tolist()


def repeated_within_buckets(contents: DataFrame, length: int, partitions: int) -> DataFrame:
    """(m, c, ranges): the window starts of each content that occur twice in its bucket, found by a collection's transform.

    Buckets lie whole in a partition, in order; some thousand strings of neighbouring buckets
    make a collection. A bucket is bounded by the caller.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}

        def settle() -> pa.RecordBatch:
            names, out = list(held), []
            for name, starts in zip(names, repeated_starts(list(held.values()), length), strict=True):
                if len(starts):
                    out.append((*name, ranges_of(starts)))
            held.clear()
            m, c, r = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(c, pa.int64()), pa.array(r, pa.list_(pa.int64()))], ["m", "c", "ranges"])

        last = None
        for batch in batches:
            for m, c, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if len(held) >= COLLECTION and m != last:
                    yield settle()
                held[m, c] = s
                last = m
        if held:
            yield settle()

    return contents.select("m", "c", "s").repartition(partitions, "m").sortWithinPartitions("m").mapInArrow(convert, "m long, c long, ranges array<long>")


def repeated_windows(contents: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any size, which are keyed anew by whole windows: a 128-bit hash of each, counted in Spark."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, c, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n = len(s) - length + 1
                h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s[i : i + length]) for i in range(n)]), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m)), pa.array(np.full(n, c)), pa.array(np.arange(n)), pa.array(h[::2]), pa.array(h[1::2])], ["m", "c", "i", "h", "g"])

    windows = contents.select("m", "c", "s").mapInArrow(convert, "m long, c long, i long, h long, g long")
    twice = windows.groupBy("h", "g").count().where("count > 1").drop("count")
    return windows.join(twice, ["h", "g"]).select("m", "c", F.array(F.shiftleft("i", COUNT_BITS).bitwiseOR(F.lit(1))).alias("ranges"))


def crowded(contents: DataFrame, key: str, most: int) -> DataFrame:
    """The values of ``key`` with more than ``most`` rows."""
    return contents.groupBy(key).count().where(F.col("count") > most).select(key)


def inside(range_of: Column, r: Column) -> Column:
    """The range ``r`` within the range ``range_of``; -1 stands for the whole."""
    return F.when(r == -1, range_of).otherwise(F.shiftleft(F.shiftright(range_of, COUNT_BITS), COUNT_BITS) + r)


def repeated_in_crowds(contents: DataFrame, length: int, most: int, partitions: int) -> DataFrame:
    """(m, c, ranges) for the contents (m, c, s) of crowded keys, after keying them anew by classes of windows.

    Most new keys have one content and are done; the others take the way of any key. Where
    one is crowded again, whole windows are the keys.
    """
    parts = classes_of(contents, length)
    again = parts.groupBy("k").count().where("count > 1").select("k")
    alive = parts.join(again, "k").groupBy("m", "c").agg(F.collect_list(F.struct("at", "k")).alias("cuts"))
    cut = stored(cut_classes(contents.join(alive, ["m", "c"]), length))
    counts = cut.groupBy("k", "c2").agg(F.count("*").alias("n"), F.min("s2").alias("s"))
    counts = stored(counts.select(F.col("k").alias("m"), F.col("c2").alias("c"), "n", "s"))
    hot = crowded(counts, "m", most)
    found = repeated_within_buckets(counts.join(hot, "m", "left_anti"), length, partitions)
    found = found.union(repeated_windows(counts.join(hot, "m", "left_semi"), length))
    found = found.union(counts.where("n > 1").select("m", "c", F.array(F.lit(-1).cast("long")).alias("ranges")))
    found = found.select(F.col("m").alias("k"), F.col("c").alias("c2"), "ranges")
    each = cut.select("m", "c", "at", "k", "c2").join(found, ["k", "c2"]).select("m", "c", "at", F.explode("ranges").alias("r"))
    return each.select("m", "c", F.array(inside(F.col("at"), F.col("r"))).alias("ranges"))


def without(data: bytes, ranges: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What is left of ``data`` without the windows that start in ``ranges``, bytes removed, and maximal removed runs."""
    if not len(ranges):
        return data, 0, 0
    at, count = unpacked(ranges)
    edges = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + count + length - 1, -1)
    gone = np.cumsum(edges[:-1]) > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return np.frombuffer(data, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), length: int = 200, bucket_most: int = 2_048, keep_text: bool = True) -> DataFrame:
    """Remove every byte that is covered by a string of ``length`` bytes which also starts anywhere else.

    Strings lie within a text, the same text counts as anywhere else, overlaps count, and all
    is judged on the input. Returns id_col, the columns ``carry``, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 and, with ``keep_text``, the remaining ``text``
    (a character cut apart by a removal is dropped).

    1. Each text is cut into runs of window starts with one key, the least hash of a gram in
       the window; equal windows have equal keys. Only (row, range, key, content hash) are
       exchanged. Keys are counted; those with one run are done.
    2. A key whose runs all have the same bytes is repeated as a whole.
    3. The different contents of the other keys are fetched, once each, and gathered by key.
       The transform of such a collection and its common prefixes are built column by column;
       prefixes of ``length`` bytes tell the repeated windows. A key with more than
       ``bucket_most`` contents would be too much for one task; its windows are keyed anew by
       where the gram lies in them and by the bytes around it (see ``repeated_in_crowds``).
    4. Ranges go back to the rows, whose texts are exchanged once more and cut.

    Hot keys only ever meet in grouped counts and in joins that Spark can split. Null text
    counts as empty; texts below ``length`` bytes stay whole; a repeated row is a text like
    any other, so all of it repeats; null ids are kept; other input columns are left out.
    """
    a, b = row_hash(id_col, text_col)
    carried = [c for c in carry if c not in (id_col, text_col)]
    rows = df.select(id_col, *carried, a.alias("_a"), b.alias("_b"), F.col(text_col).cast("string").alias("_text"))
    runs, texts = cut_runs(rows, length), pack_texts(rows)

    keys = runs.groupBy("m").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    keys = cut_lineage(keys.select("m", (F.col("lo") == F.col("hi")).alias("same")))
    shared = cut_lineage(runs.join(keys, "m"))
    mixed = shared.where(~F.col("same")).select("_a", "_b", "_at", "m", "c")
    contents = cut_lineage(mixed.groupBy("m", "c").agg(F.count("*").alias("n"), F.min(F.struct("_a", "_b", "_at")).alias("w")))
    wanted = contents.select("w._a", "w._b", F.struct(F.col("w._at").alias("at"), "m", "c").alias("run"))
    fetched = slice_contents(texts.select("_a", "_b", "_z").join(wanted.groupBy("_a", "_b").agg(F.collect_list("run").alias("runs")), ["_a", "_b"]), length)
    hot = crowded(contents, "m", bucket_most)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowds = not hot.isEmpty()
    if crowds:
        fetched = stored(fetched)
    found = repeated_within_buckets(fetched.join(hot, "m", "left_anti"), length, partitions)
    if crowds:
        found = found.union(repeated_in_crowds(fetched.join(hot, "m", "left_semi"), length, bucket_most, partitions))
    several = contents.where("n > 1").select("m", "c", F.array(F.lit(-1).cast("long")).alias("ranges"))
    found = cut_lineage(found.union(several).coalesce(partitions))

    hit = mixed.join(found, ["m", "c"]).select("_a", "_b", "_at", F.explode("ranges").alias("r")).select("_a", "_b", inside(F.col("_at"), F.col("r")).alias("r"))
    hit = hit.union(shared.where("same").select("_a", "_b", "_at"))
    hits = hit.groupBy("_a", "_b").agg(F.collect_list("r").alias("_ranges"))

    own = [id_col, *carried]
    extra = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())]
    extra += [StructField("text", StringType())] * keep_text
    joined = texts.join(hits, ["_a", "_b"], "left").select(*own, "_z", "_ranges")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for part in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for z, r in zip(part.column(len(own)), part.column(len(own) + 1), strict=True):
                data = unpress.decompress(z.as_py())
                ranges = np.zeros(0, dtype=np.int64) if not r.is_valid else r.values.to_numpy(zero_copy_only=False)
                kept, removed, spans = without(data, ranges, length)
                for x, v in zip(out, (len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None), strict=True):
                    x.append(v)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)][: len(extra)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], *arrays], [*own, *(f.name for f in extra)])

    return joined.mapInArrow(finish, StructType([*(df.schema[c] for c in own), *extra]))
