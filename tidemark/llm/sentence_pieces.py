"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their log scores are read from a public model file; nothing is trained. Encoding
puts the space marker first, turns spaces into markers, finds the piece sequence with the largest
total score by Viterbi over a double-array trie, and falls back to byte pieces for characters no
piece covers. Decoding joins piece bytes, turns markers into spaces and drops the first one.

A piece that holds a marker after another character would cross a word's end; where the model has
none (checked when it is loaded), the best sequence of a text is the best sequences of its words,
so each distinct word is solved once and remembered. Otherwise texts are solved whole.

Defined results: a null or empty text has no pieces and decodes to the empty text; very long texts
are encoded whole, word by word; repeated rows give equal pieces; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from functools import lru_cache
from itertools import islice
from math import inf

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table, texts_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Words remembered per worker, the longest that is remembered, words solved at once and the bytes of the longest of them.
MEMO, LONG, LOT, WIDE = 500_000, 40, 8192, 96
_WORDS = re.compile(r" *[^ ]+| +$")


def _fields(raw: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, raw[at : at + n]
            at += n


def read_model(path: str) -> tuple[list[str], np.ndarray, list[int], dict[str, bool]]:
    """Pieces, log scores, kinds and the normaliser's flags of a model file."""
    pieces, scores, kinds = [], [], []
    flags = {"dummy_prefix": True, "trim_spaces": True, "charsmap": False}
    with open(path, "rb") as f:
        raw = f.read()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            pieces.append(piece)
            scores.append(score)
            kinds.append(kind)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    flags["charsmap"] = bool(v)
                elif n == 3:
                    flags["dummy_prefix"] = bool(v)
                elif n == 4:
                    flags["trim_spaces"] = bool(v)
    return pieces, np.array(scores), kinds, flags


class DoubleArray:
    """A trie over byte strings as two arrays: the child of state s by byte b is base[s] + b + 1
    where check of that place is s; a string's end is the child by code 0, which holds its value."""

    def __init__(self, keys: list[tuple[bytes, int]]) -> None:
        keys = sorted(keys)
        size = 1 << 20
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        free = 1
        todo = [(0, 0, len(keys), 0)]  # state, range of keys, depth
        while todo:
            state, lo, hi, depth = todo.pop()
            groups, k = [], lo
            while k < hi:
                word = keys[k][0]
                code = word[depth] + 1 if len(word) > depth else 0
                j = k + 1
                if code:
                    while j < hi and keys[j][0][depth] == code - 1:
                        j += 1
                groups.append((code, k, j))
                k = j
            while used[free]:
                free += 1
            base = max(1, free - groups[0][0])
            while any(used[base + c] for c, _, _ in groups):
                base += 1
            if base + 300 > size:
                raise ValueError("the trie is too large")
            self.base[state] = base
            for code, a, b in groups:
                used[base + code] = 1
                self.check[base + code] = state
                if code:
                    todo.append((base + code, a, b, depth + 1))
                else:
                    self.base[base] = keys[a][1]
        last = len(used) - used[::-1].index(1) + 300
        self.base, self.check = self.base[:last].copy(), self.check[:last].copy()

    def prefixes(self, text: bytes, start: int = 0):
        """(end, value) of every key that text continues with at start."""
        state = 0
        for at in range(start, len(text)):
            child = self.base[state] + text[at] + 1
            if child >= len(self.check) or self.check[child] != state:
                return
            state = child
            end = self.base[state]
            if self.check[end] == state:
                yield at + 1, int(self.base[end])


class Unigram:
    def __init__(self, path: str) -> None:
        self.pieces, self.scores, kinds, flags = read_model(path)
        if flags["charsmap"] or flags["trim_spaces"]:
            raise ValueError("only models with an identity normaliser are supported")
        self.dummy = flags["dummy_prefix"]
        matched = [k for k, kind in enumerate(kinds) if kind in (NORMAL, USER)]
        self.trie = DoubleArray([(self.pieces[k].encode(), k) for k in matched])
        normal = [k for k, kind in enumerate(kinds) if kind == NORMAL]
        self.longest = max(len(self.pieces[k].encode()) for k in matched)
        self.unknown = float(self.scores[normal].min()) - 10.0
        best = float(self.scores[normal].max())
        self.score = self.scores.tolist()
        self.base, self.check = self.trie.base.tolist(), self.trie.check.tolist()
        for k in matched:  # a piece the user defined always wins, as in the library
            if kinds[k] == USER:
                self.score[k] = len(self.pieces[k]) * best - 0.1
        self.gain = np.array(self.score)
        self.unk = kinds.index(UNKNOWN)
        self.byte = np.full(256, self.unk, np.int64)
        self.raw = [MARK.encode() if k == self.unk else p.encode() for k, p in enumerate(self.pieces)]
        for k, kind in enumerate(kinds):
            if kind == BYTE:
                b = int(self.pieces[k][1:-1], 16)
                self.byte[b] = k
                self.raw[k] = bytes([b])
            elif kind in (CONTROL, UNUSED):
                self.raw[k] = b""
        self.byte_ids = self.byte.tolist()
        self.raw[self.unk] = " ⁇ ".encode()
        self.by_word = all(MARK not in self.pieces[k].lstrip(MARK) for k in matched)
        self.known: dict[str, bytes] = {}

    def solve(self, word: bytes) -> list[int]:
        """The best ids of one word (markers in place): Viterbi, with every trie walk from a reached place."""
        base, check, score, n = self.base, self.check, self.score, len(word)
        best, back, piece = [-inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here = best[at]
            if here == -inf:  # inside a character
                continue
            lead = word[at]
            one = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            state, covered = 0, False
            for end in range(at, n):
                child = base[state] + word[end] + 1
                if check[child] != state:
                    break
                state = child
                leaf = base[state]
                if check[leaf] == state:
                    k = base[leaf]
                    total = here + score[k]
                    covered = covered or end + 1 == one
                    if total > best[end + 1]:
                        best[end + 1], back[end + 1], piece[end + 1] = total, at, k
            if not covered and here + self.unknown > best[one]:
                best[one], back[one], piece[one] = here + self.unknown, at, self.unk
        at, ids = n, []
        while at:
            start = back[at]
            if piece[at] == self.unk:
                ids += [self.byte_ids[c] for c in reversed(word[start:at])]
            else:
                ids.append(piece[at])
            at = start
        return ids[::-1]

    def solve_many(self, words: list[bytes]) -> list[bytes]:
        """Packed best ids of many words of at most WIDE bytes: the trie is walked from all places at once,
        then every word takes its Viterbi steps side by side."""
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        owner = np.repeat(np.arange(n), lens)
        left = np.repeat(first + lens, lens) - np.arange(len(text))  # bytes from here to the word's end
        base, check = self.trie.base, self.trie.check
        place = np.flatnonzero((text & 0xC0) != 0x80)
        one = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        covered = np.zeros(len(text), bool)
        state, begins, ends, ids = np.zeros(len(place), np.int64), [], [], []
        for step in range(self.longest):
            alive = left[place] > step
            place, state = place[alive], state[alive]
            child = base[state] + text[place + step] + 1
            ok = check[child] == state
            place, state = place[ok], child[ok]
            if not len(place):
                break
            leaf = base[state]
            hit = check[leaf] == state
            at = place[hit]
            begins.append(at)
            ends.append(at + step + 1)
            ids.append(base[leaf[hit]])
            covered[at[one[at] == step + 1]] = True
        begin, end, piece_of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, ends, ids))
        bare = np.unique(owner[((text & 0xC0) != 0x80) & ~covered])
        word = owner[begin]
        begin, end = begin - first[word], end - first[word]
        order = np.argsort(begin, kind="stable")
        begin, end, piece_of, word = begin[order], end[order], piece_of[order], word[order]
        wide = int(lens.max()) + 1
        best = np.full(n * wide, -inf)
        best[np.arange(n) * wide] = 0.0
        back, piece = np.zeros(n * wide, np.int64), np.zeros(n * wide, np.int64)
        gain, here, there = self.gain[piece_of], word * wide + begin, word * wide + end
        cuts = np.searchsorted(begin, np.arange(wide + 1))
        for at in range(wide):
            s = slice(cuts[at], cuts[at + 1])
            total, to = best[here[s]] + gain[s], there[s]
            better = total > best[to]
            to = to[better]
            best[to], back[to], piece[to] = total[better], at, piece_of[s][better]
        row, at = np.arange(n), lens.copy()
        rows, found = [], []
        while len(row):
            cell = row * wide + at
            rows.append(row)
            found.append(piece[cell])
            at = back[cell]
            row, at = row[at > 0], at[at > 0]
        rows, found = np.concatenate(rows[::-1]), np.concatenate(found[::-1])
        order = np.argsort(rows, kind="stable")
        packed = found[order].astype("<i4").tobytes()
        edge = (np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]) * 4).tolist()
        out = [packed[a:b] for a, b in zip(edge, edge[1:], strict=False)]
        for k in bare.tolist():  # words with characters that fall back to bytes
            out[k] = array("i", self.solve(words[k])).tobytes()
        return out

    def _words(self, text: str) -> list[str]:
        """The text cut before each run of spaces; a word's one leading space is left out."""
        text = text.replace(MARK, " ")
        led = " " + text if self.dummy else text
        if not self.by_word:
            return [led]
        if led[:1] == " " and led[-1] != " " and "  " not in led and "\0" not in led:
            return led[1:].split(" ")
        return [w[1:] if w[0] == " " and w[1:2] not in ("", " ", "\0") else "\0" + w for w in _WORDS.findall(led)]

    def _raw(self, word: str) -> bytes:
        if self.by_word:
            word = word[1:] if word[:1] == "\0" else " " + word
        return word.replace(" ", MARK).encode("utf-8", "surrogatepass")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self._words(t) if t else [] for t in texts]
        missing = set().union(*cut) - self.known.keys()
        if len(self.known) + len(missing) > MEMO:
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))  # the later half stays
            missing = set().union(*cut) - self.known.keys()
        order = sorted(missing, key=len)
        for at in range(0, len(order), LOT):
            lot = order[at : at + LOT]
            raw = [self._raw(w) for w in lot]
            narrow = [k for k, w in enumerate(raw) if len(w) <= WIDE]
            self.known.update(zip([lot[k] for k in narrow], self.solve_many([raw[k] for k in narrow]) if narrow else [], strict=True))
            self.known.update((lot[k], array("i", self.solve(w)).tobytes()) for k, w in enumerate(raw) if len(w) > WIDE)
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, words)), np.int32) for words in cut]
        for word in missing:
            if len(word) > LONG:
                del self.known[word]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of a piece sequence; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy and text[:1] == " " else text


@lru_cache(maxsize=2)
def model(path: str) -> Unigram:
    return Unigram(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes_fallen_back, ids, ids_crc32 and whether decoding gives the text back."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        texts = texts_of(batch)
        ids = m.encode(texts)
        low, high = m.byte.min(), m.byte.max()
        is_byte = np.zeros(len(m.pieces), bool)
        is_byte[m.byte[m.byte != m.unk]] = True
        same = [m.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]
        flat = np.concatenate(ids) if ids else np.zeros(0, "<i4")
        ends = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([int(is_byte[i].sum()) if high >= low else 0 for i in ids], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int64), pa.int32()), pa.array(flat, pa.int32())),
                pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                pa.array(same, pa.bool_()),
            ],
            ["doc_id", "n_pieces", "n_byte_pieces", "ids", "ids_crc32", "round_trip"],
        )

    schema = "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids array<int>, ids_crc32 bigint, round_trip boolean"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), one, schema)


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
