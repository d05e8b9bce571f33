"""Best-fit packing by sum of squares.

A document is its token ids followed by one separator id; longer ones than a sequence are cut
into full pieces, of which the first may be shorter. Pieces go into sequences of ``size`` tokens by
the sum-of-squares rule: a piece goes where the squared counts of open sequences per residual
gap become smallest. Pieces are placed one by one, from the longest down.

The pieces are dealt, by a hash of their row, into parts of about ``PART`` pieces, and every part is
packed on its own in a task of its own; so the work is spread evenly whatever the lengths or ids are,
a task's memory is bounded, and the rule is the same at every size. A part ends 0 to 3 sequences above
the fewest that could hold it, which is what the parts cost.

Defined results: a null or empty text is a lone separator; repeated rows are packed as separate
documents (equal ids, own places), those without a doc_id too; an empty table gives no sequence; other
columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import map_batches, table, texts_of, written
from tidemark.shipping import ship

SIZE, SEPARATOR = 2048, 0
#: Pieces of a part, about. A part's sequences are numbered from its own multiple of ``STRIDE``.
PART, STRIDE = 32_768, 1 << 32
SPECIAL = {"<|endoftext|>": 50256}
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Encoder:
    """Ids as the tokenizers library gives them, with the same vocabulary's fast ranks where both agree.

    ``PATTERN`` is the pre-tokeniser's pattern without backtracking. Texts beyond Latin letters,
    where two regex engines might class a character differently, are left to the library itself.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        self.whole = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.odd = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u024f]").search

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without the separator."""
        if self.odd(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, of which the first may be shorter."""
    first = n % size or min(n, size)
    return [(0, first), *((k, size) for k in range(first, n, size))]


def pieces(docs: DataFrame, json_path: str, ranks_path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every piece of every document."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(json_path, ranks_path)
        doc, rows, ids_out = [], [], []
        for d, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            ids = encode(text) + SEPARATOR.to_bytes(4, "little")
            for p, (start, length) in enumerate(cut(len(ids) // 4, size)):
                part = ids[4 * start : 4 * (start + length)]
                doc.append(d)
                rows.append((p, start, length, zlib.crc32(part)))
                if with_ids:
                    ids_out.append(np.frombuffer(part, "<i4"))
        cols = [pa.array(doc, pa.int64())]
        cols += [pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.int64()) for k in range(4)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            cols.append(pa.array(ids_out, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), one, schema)


def places(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece: the sum-of-squares rule, piece by piece from the longest down.

    A sequence is begun only where no open one has room: measured, that leaves 0 to 3 sequences above
    the lower bound, where weighing an untouched sequence like any other leaves 0.3 to 0.5 %.
    Among equally good gaps the one that leaves least room is taken.
    """
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_at = np.zeros(size + 1, np.int64)  # open sequences by gap; full ones count nothing
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    fresh = 0
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for first, last in zip(cuts, np.append(cuts, len(order))[1:], strict=True):
        length = int(lengths[order[first]])
        # Growth of the sum of squares by the gap that would be left; never, where no open sequence has that room.
        held = open_at[length:size]
        grows = 2 * open_at[: size - length] - 2 * held + 2
        grows[:1] = 1 - 2 * held[:1]  # a full sequence is not counted
        usable = np.where(held > 0, grows, _NEVER)
        for k in order[first:last].tolist():
            left = int(usable.argmin()) if size > length else 0
            if size == length or usable[left] == _NEVER:
                left, gap = size - length, size
                sequence[k], fresh = fresh, fresh + 1
            else:
                gap = left + length
                sequence[k] = stacks[gap].pop()
                open_at[gap] -= 1
            offset[k] = size - gap
            if left:
                open_at[left] += 1
                stacks[left].append(int(sequence[k]))
            for g in {left, gap, left + length, gap + length, left - length, gap - length}:
                # The gap left g (source g + length) is weighed anew where either of its counts has changed.
                if 0 <= g < size - length:
                    n = open_at[g + length]
                    usable[g] = (2 * open_at[g] + 1 if g else 0) - 2 * n + 1 if n else _NEVER
    return sequence, offset


_NEVER = np.iinfo(np.int64).max


def pack(cut_pieces: DataFrame, size: int = SIZE, part: int = PART) -> DataFrame:
    """Add sequence_id and offset to pieces; the input must be a written table, with a unique column ``row``.

    Only row and length travel to the packing tasks, and only places travel back.
    """
    parts = max(1, -(-cut_pieces.count() // part))
    ship(cut_pieces.sparkSession)

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        sequence, offset = places(group["length"].to_numpy(), size)
        base = group["part"][0].as_py() * STRIDE
        return pa.table({"row": group["row"], "sequence_id": pa.array(base + sequence), "offset": pa.array(offset)})

    dealt = cut_pieces.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"))
    placed = dealt.groupBy("part").applyInArrow(one, "row bigint, sequence_id bigint, offset bigint")
    return cut_pieces.join(placed, "row").drop("row")


def best_fit_packing(docs: DataFrame, tokenizer: str = "byte_bpe_50k", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place, and with its ids on demand."""
    made = pieces(docs, public_tokenizers.path(f"{tokenizer}.json"), public_tokenizers.path(f"{tokenizer}.tiktoken"), size, with_ids)
    return pack(written(made.withColumn("row", F.monotonically_increasing_id()), "pieces"), size)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
