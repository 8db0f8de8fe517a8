"""Byte-level BPE as a monoid: halves are encoded on their own and joined where they meet."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from larkspur.llm.common import text_bytes

#: Texts of up to so many characters are leaves of the tree.
LEAF = 2_048
#: Characters that a boundary window has on each side at first; it doubles until both ends are sure.
REACH = 32
#: Between a letter and a space with a letter after it the pattern always ends a match:
#: no alternative takes a letter and then a space, and a space before a letter begins a word.
SURE = regex.compile(r"(?<=\p{L})(?= \p{L})")


class Codec:
    """Encodes and decodes with the ranks of one file; whole texts come out as the library would encode them at once. The sure places hold for one pattern; any other is refused."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        if pattern != public_tokenizers.PATTERN:
            raise ValueError("no sure places are known for this pattern")
        lines = Path(ranks_path).read_bytes().splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines))}
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int32)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """Ids of ``text``: split in halves down to leaves, which are encoded and joined again."""
        if len(text) <= leaf:
            return self.leaf.encode_ordinary(text)
        cut = len(text) // 2
        return self.join(text[:cut], self.encode(text[:cut], leaf), text[cut:], self.encode(text[cut:], leaf))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of ``left + right`` from the ids of both.

        A window around the meeting point grows on each side until it ends at a place where
        the pattern ends a match whatever stands around. Merges never cross such a place, so
        the ids outside the window are those of the whole text; the window is encoded anew.
        Where a side has no such place the window takes all of it.
        """
        reach, start = REACH, None
        while start is None:
            low = max(0, len(left) - reach)
            found = [m.start() for m in SURE.finditer(left, low)]
            start = found[-1] if found else 0 if low == 0 else None
            reach *= 2
        reach, end = REACH, None
        while end is None:
            high = min(len(right), reach)
            m = SURE.search(right, 0, high)
            end = m.start() if m else len(right) if high == len(right) else None
            reach *= 2
        head = self.before(left_ids, len(left[start:].encode()))
        tail = self.after(right_ids, len(right[:end].encode()))
        return left_ids[:head] + self.leaf.encode_ordinary(left[start:] + right[:end]) + right_ids[tail:]

    def before(self, ids: list[int], size: int) -> int:
        """How many ids stand before the last ``size`` bytes."""
        k = len(ids)
        while size > 0:
            k -= 1
            size -= int(self.sizes[ids[k]])
        if size:
            raise AssertionError("a token crosses a sure place")
        return k

    def after(self, ids: list[int], size: int) -> int:
        """How many ids the first ``size`` bytes take."""
        k = 0
        while size > 0:
            size -= int(self.sizes[ids[k]])
            k += 1
        if size:
            raise AssertionError("a token crosses a sure place")
        return k

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        """Bytes of ``ids``: those of halves, one after the other."""
        if len(ids) <= leaf:
            return self.leaf.decode_bytes(ids)
        cut = len(ids) // 2
        return self.decode(ids[:cut], leaf) + self.decode(ids[cut:], leaf)


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each file and worker process."""
    return Codec(ranks_path, pattern)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Ids of each whole text, without special tokens, and what they decode to.

    Returns id_col, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256 and, with ``keep_ids``, ids (array of int) and decoded (string).
    One row out for each row in, in one pass without a shuffle: null text counts as empty and
    gives no ids, repeated rows give repeated results, other input columns are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{id_col}` {kinds[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                out: list[list] = [[], [], [], [], []]
                for data in text_bytes(part.column(1)):
                    ids = own.encode(data.decode("utf-8", "replace"))
                    back = own.decode(ids)
                    for x, v in zip(out, (len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), ids if keep_ids else None, back if keep_ids else None), strict=True):
                        x.append(v)
                arrays = [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    arrays += [pa.array(out[3], pa.list_(pa.int32())), pa.array([x.decode("utf-8", "replace") for x in out[4]], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(id_col, text_col).mapInArrow(convert, schema)
