"""Personal data: fixed patterns, widened by a linear-chain conditional random field.

The base patterns (email, ip, card, phone) are matched over the whole text, each kind leftmost
and non-overlapping, and never dropped. The random field adds what patterns miss: its
observations are word shapes, digit counts and cue words of a word and its neighbours, its
weights are trained by maximum likelihood on the small labelled table ``LABELLED``, and lines are
decoded by Viterbi in numpy batches. A label may begin only at a word that could carry it (it
holds a digit, or follows a form of address), so a line with neither is all outside and is not
decoded. Added spans that touch a base span give way to it.

Defined results: a null or empty text has no span; repeated rows give equal spans; very long
texts are searched whole, line by line, in time proportional to their length; an empty table gives an
empty result; ``found`` reads no other columns, ``redact`` hands them on untouched.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches, table, texts_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "name")
KINDS = (*BASE, *ADDED)
FIELD = ("card", "phone", "secret", "name")  # what the random field looks for
LABELS = ("O", *(f"{p}-{k}" for k in FIELD for p in "BI"))

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index into KINDS) of the base matches, by start and kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            free = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NON_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


# The random field -------------------------------------------------------------------------

TITLES = frozenset("mr mrs ms dr prof herr frau madame monsieur señor señora sr sra".split())
CUES = frozenset("call phone tel telephone fax mobile cell card visa token key secret password passwd api apikey api_key bearer pin id no order invoice version page".split())
#: The labelled table: [kind:words] marks a span, everything else is outside.
LABELLED = """
please call [phone:555-201-3344] before noon
phone [phone:(415) 555-0132] or write to us
tel: [phone:030 555 2178] in the office
you can reach me on mobile [phone:0171 555 90210] any time
fax [phone:555.310.4422] and wait
call [phone:212-555-0188] or [phone:212-555-0189] now
her cell is [phone:(650) 555 7781] today
card [card:4111111111111111] was charged
visa [card:4012888888881881] expired
pay with [card:5500005555555559] or [card:4111111111111111] please
the number [card:378282246310005] is on file
[card:4111111111111111] [card:4111111111111111] both failed
token = [secret:"9f86d081884c7d659a2feaa0c55ad015"] in the config
api_key: [secret:a3f5c9e17b2d4860912c] for tests
password [secret:hunter2x9q7] was reset
password=[secret:51ccd051a92ebcb680] in a note
passwd=[secret:9e107d9d372bb6826b]
secret = [secret:'c0ffee254729296a45a3885639ac7e11']
key = "[secret:d41d8cd98f00b204e9800998ecf8427e]"
bearer [secret:eyJ0b2tlbiI6MTIzNDU2Nzg5MH0] in the header
dear Mr [name:Karl Lindner] we thank you
ask Dr [name:Ana Flores] for help
Mrs [name:Jones] signed the form
Herr [name:Otto Brandt] und Frau [name:Lena Brandt] kamen
señora [name:Lucia Vega] llegó tarde
Monsieur [name:Paul Mercier] est parti
Prof [name:Grace Hall] will speak
in 1999 there were 4500 people in the town
order no 120045 was shipped on 2021-03-04
version 2.10.3 fixes 17 bugs and 4 crashes
page 12 of 340 in volume 7
the price rose from 1,200 to 1,350 in 3 weeks
id 88231 and invoice 2020-114 are closed
it took 10 minutes and 30 seconds at 5:45
chapter 3 verse 16 and 24 more
about 7000000 units were sold in 2018
the 2nd of 3 talks begins at 10:30
flight 447 left gate 22 at 18:05
call me at 5 or text at 6
call 911 or 112 at once
the key to room 204 is on desk 3
a token of thanks for 25 years
password must have 8 letters and 2 digits
Dr of science and Mr of nothing at all
a card for 4 people and 2 dogs
the 1234567890123456 rows were dropped
area 51 and route 66 and 7up
win32 and x86 and mp3 and h264 are names
covid19 hit in 2020 and b2b sales fell
""".strip().split("\n")

_TOKEN = re.compile(r"[^\s=]+")
_EDGE = " \t.,;:!?\"'()[]{}<>*#$%&|=“”«»"
_GROUP = re.compile(r"(X+|x+|d+)")


def shape_features(core: str) -> tuple[str, ...]:
    """What the field sees of one word: shape, digit count, cue, checksum. Never the word itself."""
    low = core.lower()
    if low in TITLES:
        return ("title",)
    cue = (f"cue={low}",) if low in CUES else ()
    digits = sum("0" <= c <= "9" for c in core)
    if not digits:
        return (*cue, "cap" if core[:1].isupper() and core[1:].islower() else "word")
    mapped = "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in core[:64])
    packed = _GROUP.sub(lambda m: m[0][0] + (str(min(len(m[0]), 5)) if m[0][0] == "d" else ""), mapped)[:16]
    out = [*cue, f"shape={packed}", f"digits={min(digits, 20) if digits < 12 else '12+'}"]
    letters = sum(c.isalpha() for c in core)
    if not letters and 12 <= digits <= 19 and digits >= len(core) - 4:
        out.append("luhn" if luhn(_NON_DIGIT.sub("", core)) else "no-luhn")
    if letters and len(core) >= 9 and core.replace("-", "").replace("_", "").isalnum() and core.isascii():
        out.append("mixed16" if len(core) >= 16 else "mixed9")
    return tuple(out)


def tokens(line: str, at: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, core) of each word, edge punctuation aside."""
    out = []
    for m in _TOKEN.finditer(line):
        core = m[0].strip(_EDGE)
        if core:
            start = at + m.start() + m[0].index(core)
            out.append((start, start + len(core), core))
    return out


class Field:
    """Weights over (feature of the word before, at, after) x label, and label pairs."""

    def __init__(self) -> None:
        lines = [self._marked(line) for line in LABELLED]
        names = sorted({f"{o}|{f}" for words, _ in lines for seq in [self._features(words)] for o, f in self._offsets(seq)})
        self.index = {n: k for k, n in enumerate(names)}
        self.weights = np.zeros((len(names), len(LABELS)))
        self.pairs = np.zeros((len(LABELS), len(LABELS)))
        self.classes: dict[tuple[str, ...], int] = {}
        self.rows: list[np.ndarray] = []
        self.barred = np.array([[b[0] == "I" and a[2:] != b[2:] for b in LABELS] for a in LABELS])
        self._train(lines)
        self.step = np.where(self.barred, -1e6, self.pairs)

    @staticmethod
    def _marked(line: str) -> tuple[list[str], list[int]]:
        words, labels = [], []
        for part in re.split(r"(\[\w+:[^\]]*\])", line):
            m = re.fullmatch(r"\[(\w+):([^\]]*)\]", part)
            kind, text = (m[1], m[2]) if m else (None, part)
            for k, (_, _, core) in enumerate(tokens(text)):
                words.append(core)
                labels.append(LABELS.index(f"{'I' if k else 'B'}-{kind}") if kind else 0)
        return words, labels

    @staticmethod
    def _features(words: list[str]) -> list[tuple[str, ...]]:
        return [shape_features(w) for w in words]

    @staticmethod
    def _offsets(seq: list[tuple[str, ...]]):
        for fs in seq:
            for f in fs:
                for o in (-1, 0, 1):
                    yield o, f

    @staticmethod
    def _allowed(seq: list[tuple[str, ...]]) -> np.ndarray:
        """Penalty for labels a word cannot carry."""
        bar = np.zeros((len(seq), len(LABELS)))
        for t, fs in enumerate(seq):
            digit = any(f.startswith("digits=") for f in fs)
            after_title = t > 0 and seq[t - 1] == ("title",)
            for k, label in enumerate(LABELS[1:], 1):
                if label[2:] == "name":
                    ok = "cap" in fs and (label[0] == "I" or after_title)
                else:
                    ok = digit
                if not ok:
                    bar[t, k] = -1e6
        return bar

    def _train(self, lines, rounds: int = 120, rate: float = 0.2, ridge: float = 0.02) -> None:
        n, size, m = len(LABELS), max(len(w) for w, _ in lines), len(lines)
        live, gold = np.zeros((m, size), bool), np.zeros((m, size), int)
        bar = np.full((m, size, n), -1e6)
        bar[:, :, 0] = 0
        which = np.zeros((m, size, len(self.index)))
        for k, (words, labels) in enumerate(lines):
            seq = self._features(words)
            live[k, : len(words)], gold[k, : len(words)] = True, labels
            bar[k, : len(words)] = self._allowed(seq)
            for t, fs in enumerate(seq):
                for o in (-1, 0, 1):
                    if 0 <= t + o < len(seq):
                        for f in fs:
                            which[k, t + o, self.index[f"{-o}|{f}"]] = 1
        hot = np.eye(n)[gold] * live[..., None]
        pair_gold = np.einsum("kti,ktj->ij", hot[:, :-1], hot[:, 1:])
        sums = [np.zeros_like(x) for x in (self.weights, self.weights, self.pairs, self.pairs)]
        lse = lambda x, axis: (mx := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - mx).sum(axis))
        for r in range(1, rounds + 1):
            emit = which @ self.weights + bar
            step = np.where(self.barred, -1e6, self.pairs)
            fwd, bwd = np.zeros((m, size, n)), np.zeros((m, size, n))
            fwd[:, 0] = emit[:, 0]
            fwd[:, 0, 2::2] -= 1e6  # nothing begins inside
            for t in range(1, size):
                fwd[:, t] = lse(fwd[:, t - 1][:, :, None] + step, 1) + emit[:, t]
            for t in range(size - 2, -1, -1):
                bwd[:, t] = lse(step + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            z = lse(fwd[:, -1], 1)
            mean = np.exp(fwd + bwd - z[:, None, None]) * live[..., None]
            both = np.exp(fwd[:, :-1, :, None] + step + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None])
            both *= (live[:, :-1] & live[:, 1:])[..., None, None]
            grads = (np.einsum("ktf,ktl->fl", which, hot - mean) - ridge * self.weights, pair_gold - both.sum((0, 1)) - ridge * self.pairs)
            for g, p, k in ((grads[0], self.weights, 0), (grads[1], self.pairs, 2)):
                sums[k] = 0.9 * sums[k] + 0.1 * g
                sums[k + 1] = 0.99 * sums[k + 1] + 0.01 * g * g
                p += rate * sums[k] / (1 - 0.9**r) / (np.sqrt(sums[k + 1] / (1 - 0.99**r)) + 1e-4)

    def emissions(self, seq: list[tuple[str, ...]]) -> np.ndarray:
        out = self._allowed(seq)
        for t, fs in enumerate(seq):
            for o in (-1, 0, 1):
                if 0 <= t + o < len(seq):
                    for f in fs:
                        k = self.index.get(f"{-o}|{f}")
                        if k is not None:
                            out[t + o] += self.weights[k]
        return out

    def decode(self, seqs: list[np.ndarray]) -> list[list[int]]:
        """Viterbi over many sequences at once, longest first so that no padding is computed."""
        order = sorted(range(len(seqs)), key=lambda k: -len(seqs[k]))
        lens = np.array([len(seqs[k]) for k in order])
        if not len(lens):
            return []
        best = np.stack([seqs[k][0] for k in order])
        best[:, 2::2] -= 1e6
        back = []
        for t in range(1, lens[0]):
            n = int((lens > t).sum())
            cand = best[:n, :, None] + self.step
            from_ = cand.argmax(1)
            back.append(from_)
            now = np.take_along_axis(cand, from_[:, None, :], 1)[:, 0] + np.stack([seqs[order[k]][t] for k in range(n)])
            best = np.concatenate([now, best[n:]])
        out: list[list[int]] = [[] for _ in seqs]
        for row, k in enumerate(order):
            label = int(best[row].argmax())
            path = [label]
            for t in range(len(seqs[k]) - 1, 0, -1):
                label = int(back[t - 1][row, label])
                path.append(label)
            out[k] = path[::-1]
        return out


@lru_cache(maxsize=1)
def field() -> Field:
    return Field()


_CUE = re.compile(r"[0-9]|\b(?:" + "|".join(sorted(TITLES)) + r")\b", re.I)
#: Words on either side of a possible span that are decoded with it; the field sees one neighbour.
REACH = 8


def _windows(line: str, at: int) -> list[list[tuple[int, int, str]]]:
    """Runs of words around those that may carry a label; the words between runs are outside."""
    words = tokens(line, at)
    near: list[list[int]] = []
    for k, (_, _, core) in enumerate(words):
        if _DIGIT.search(core) or core.lower() in TITLES:
            if near and k - REACH <= near[-1][1]:
                near[-1][1] = k + REACH
            else:
                near.append([max(0, k - REACH), k + REACH])
    return [words[a : b + 1] for a, b in near]


def added_spans(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """What the random field finds in each text, decoded together."""
    f = field()
    owners, seqs, words = [], [], []
    for k, text in enumerate(texts):
        if not _CUE.search(text):
            continue
        at = 0
        for line in text.split("\n"):
            if _CUE.search(line):
                for run in _windows(line, at):
                    owners.append(k)
                    words.append(run)
                    seqs.append(f.emissions([shape_features(core) for _, _, core in run]))
            at += len(line) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, run, path in zip(owners, words, f.decode(seqs), strict=True):
        for (a, b, _), label in zip(run, path, strict=True):
            if label:
                kind = KINDS.index(LABELS[label][2:])
                if LABELS[label][0] == "I":
                    out[k][-1] = (out[k][-1][0], b, kind)
                else:
                    out[k].append((a, b, kind))
    return out


def all_spans(texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans, and base with added ones, of each text."""
    out = []
    for text, extra in zip(texts, added_spans(texts), strict=True):
        base = base_spans(text)
        free = []
        if extra:
            taken = sorted((a, b) for a, b, _ in base)
            starts, ends = np.array([a for a, _ in taken]), np.maximum.accumulate(np.array([b for _, b in taken])) if taken else np.array([])
            for a, b, kind in extra:
                k = int(np.searchsorted(starts, b)) if taken else 0
                if not k or ends[k - 1] <= a:
                    free.append((a, b, kind))
        out.append((base, sorted(base + free, key=lambda s: (s[0], s[2], s[1]))))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans merge under the first one."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans and all spans of every document."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for base, spans in all_spans(texts_of(batch)):
            kinds = [k for _, _, k in base]
            rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        cols = [batch.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64() if k < 4 else pa.string()) for k in range(6))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), one, schema)


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data masked in text, and n_chars brought in line."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column("text").to_pylist()
        masked = [None if t is None else redacted(t, s) for t, (_, s) in zip(raw, all_spans([t or "" for t in raw]), strict=True)]
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        cols["text"] = pa.array(masked, pa.string())
        if "n_chars" in cols:
            kind = batch.schema.field("n_chars").type
            cols["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(masked, cols["n_chars"].to_pylist(), strict=True)]).cast(kind)
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return map_batches(docs, one, T.StructType(docs.schema.fields))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))
