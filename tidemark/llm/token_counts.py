"""Token counts with overlap resynchronisation for huge documents.

Documents up to ``CHUNK`` characters are encoded whole. A longer one is encoded in overlapping
chunks; two neighbouring encodings are spliced at a boundary that both have inside the overlap
and that is proven stable, and where the overlap holds none it is doubled.

The proof is read from the vocabulary: two characters that no piece holds side by side are never
merged, so a cut between them leaves the tokens on either side as they are in the encoding of the
whole text. A chunk that holds no such cut is doubled and encoded anew, so the work stays
in proportion to the text whatever it consists of.

Defined results: a null text is the empty one, with no tokens; special strings inside texts are
ordinary text, as the library's default has it; repeated rows (and rows without a doc_id) are counted
one by one and alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table, texts_of

MODEL = "piece_bpe_32k.model"
CHUNK, OVERLAP = 32_768, 256
LIMIT = 4096
MARK = "▁"


@lru_cache(maxsize=4)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def merged_pairs(path: str) -> np.ndarray:
    """Every pair of neighbouring characters inside a piece, as sorted numbers."""
    sp = processor(path)
    pairs = {ord(a) << 21 | ord(b) for k in range(sp.get_piece_size()) for p in (sp.id_to_piece(k),) for a, b in zip(p, p[1:], strict=False)}
    return np.array(sorted(pairs), np.int64)


@lru_cache(maxsize=4)
def piece_chars(path: str) -> np.ndarray:
    """Characters of a text that each piece stands for; of a character's bytes the first stands for it."""
    sp = processor(path)
    byte = lambda k: int(sp.id_to_piece(k)[1:-1], 16) & 0xC0 != 0x80
    return np.array([byte(k) if sp.is_byte(k) else len(sp.id_to_piece(k)) for k in range(sp.get_piece_size())], np.int64)


def _points(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points[points == 0x20] = ord(MARK)
    return points


def stable_cuts(text: str, path: str, start: int = 0) -> np.ndarray:
    """The places, counted from ``start``, before which no merge can begin and end behind: all but 0."""
    points, pairs = _points(text), merged_pairs(path)
    keys = points[:-1] << 21 | points[1:]
    at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
    return start + 1 + np.flatnonzero(pairs[at] != keys) if len(pairs) else start + 1 + np.arange(len(keys))


def _offsets(text: str, start: int, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk, and the document's character at which each begins (-1: inside a character)."""
    sp = processor(path)
    ids = sp.encode(text, return_type="numpy")
    size = piece_chars(path)[ids]
    ends = np.cumsum(size)
    if len(ids) and ends[-1] == len(text) + 1:  # the library puts one marker before a text
        return ids, np.where(size > 0, np.maximum(start + ends - size - 1, start), -1)
    got = sp.encode(text, return_type="offset_mapping")  # a model that normalises otherwise
    begins = np.array([start + a for a, _ in got["offsets"]], np.int64)
    begins[1:][begins[1:] == begins[:-1]] = -1
    return np.array(got["ids"], np.int64), begins


def _first(at: np.ndarray, k: int) -> int:
    """The first id that begins at character k or later."""
    found = at >= k
    return int(found.argmax()) if found.any() else len(at)


def _tail(at: np.ndarray, low: int) -> list[tuple[int, int]]:
    """Number and place of the ids that begin behind character ``low``."""
    return [(int(n), int(at[n])) for n in np.flatnonzero(at > low)]


def _parts(text: str, path: str, chunk: int, overlap: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    begin, stop, least = 0, min(chunk, len(text)), 0  # the chunk in hand, and the first character still to be given out
    ids, at = _offsets(text[:stop], 0, path)
    while stop < len(text):
        wide, floor = overlap, max(begin, least)
        while not len(cuts := stable_cuts(text[(low := max(floor, stop - wide)) : stop], path, low)) and low > floor:
            wide *= 2
        if len(cuts):
            start, end = max(begin, low - 1), min(len(text), stop + chunk)
            next_ids, next_at = _offsets(text[start:end], start, path)
            mine = {int(k): n for n, k in _tail(at, low)}
            common = next(((mine[int(k)], n, int(k)) for n, k in enumerate(next_at[: stop - start]) if k in mine and k in cuts), None)
            if common:
                out.append(ids[_first(at, least) : common[0]])
                ids, at, begin, stop, least = next_ids, next_at, start, end, common[2]
                continue
        # Nothing proven in the whole chunk: twice as much at once, from the last proven cut.
        stop = min(len(text), stop + max(chunk, stop - begin))
        ids, at = _offsets(text[begin:stop], begin, path)
    return [*out, ids[_first(at, least) :]]


def encode_resync(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of the whole text, spliced from the encodings of overlapping chunks."""
    return np.concatenate(_parts(text, path, chunk, overlap)).tolist() if text else []


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sp = processor(path)
        texts = texts_of(batch)
        short = [k for k, t in enumerate(texts) if len(t) <= CHUNK]
        counts = [0] * len(texts)
        for k, ids in zip(short, sp.encode([texts[k] for k in short], num_threads=1, return_type="numpy"), strict=True):
            counts[k] = len(ids)
        for k, t in enumerate(texts):
            if len(t) > CHUNK:
                counts[k] = sum(map(len, _parts(t, path, CHUNK, OVERLAP)))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([c > limit for c in counts], pa.bool_()),
            ],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), one, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
