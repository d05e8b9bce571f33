"""Quality rules by weak supervision.

Each rule looks at one document and votes good (1), bad (-1) or abstains (0). The votes of all
documents are counted by pattern (at most ``3 ** len(RULES)`` of them, however many documents
there are), expectation-maximisation on these counts estimates every rule's accuracy and the
share of good documents, and a document is kept when its posterior probability of being good
reaches ``threshold``. The hard base rules (too few words, too repetitive) reject on their own.

Defined results: a null or empty text has no words, fails the base rule and is rejected; repeated
rows are judged one by one and alike, with or without a doc_id; an empty table gives an empty result;
other columns are not read, and :func:`good_documents` hands them on untouched.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches, table, texts_of, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: (name, bad when, good when) over the measures of :func:`measures`.
RULES: tuple[tuple[str, object, object], ...] = (
    ("length", lambda m: m["n_words"] < 50, lambda m: m["n_words"] >= 60),
    ("symbols", lambda m: m["n_symbols"] > 0.2 * m["n_words"], lambda m: m["n_symbols"] < 0.04 * m["n_words"]),
    ("repeats", lambda m: m["n_repeat_words"] > 0.5 * m["n_words"], lambda m: m["n_repeat_words"] < 0.2 * m["n_words"]),
    ("dup_lines", lambda m: m["n_dup_lines"] > 0.4 * m["n_lines"], lambda m: m["n_dup_lines"] <= 0.1 * m["n_lines"]),
    ("upper", lambda m: m["n_upper"] > 0.3 * m["n_letters"], lambda m: m["n_upper"] < 0.15 * m["n_letters"]),
    ("bangs", lambda m: m["n_bangs"] > 0.3 * m["n_words"], lambda m: m["n_bangs"] < 0.05 * m["n_words"]),
    ("bars", lambda m: m["n_bars"] > 0.2 * m["n_words"], lambda m: m["n_bars"] < 0.02 * m["n_words"]),
    ("letters", lambda m: m["n_letters"] < 0.6 * m["word_chars"], lambda m: m["n_letters"] > 0.8 * m["word_chars"]),
    ("vocabulary", lambda m: m["n_distinct"] < 0.15 * m["n_words"], lambda m: m["n_distinct"] > 0.3 * np.sqrt(m["n_words"] * 10)),
)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: First bytes of UTF-8 characters that are letters, by and large: of those beyond ASCII not Latin-1's signs
#: (C2), punctuation and symbols (E2), presentation forms (EF) and the planes of emoji (F0 and above).
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xE2), *range(0xE3, 0xEF)]] = True


class _Ids(defaultdict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeat_words(ids: np.ndarray, n_distinct: int, width: int = 3) -> int:
    """Words that lie in a ``width``-word window which occurs at least twice."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    base = n_distinct + 1
    key = ids[:n].astype(np.uint64)
    if base < 2**21:
        for k in range(1, width):
            key = key * np.uint64(base) + ids[k : n + k].astype(np.uint64)
    else:  # exact ranks instead of packed digits: no two windows may share a key
        for k in range(1, width):
            _, key = np.unique(key, return_inverse=True)
            key = key.astype(np.uint64) * np.uint64(base) + ids[k : n + k].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n, bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : n + k] |= again
    return int(covered.sum())


def measures(text: str) -> dict[str, int]:
    """All figures the rules look at, over the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    ids_of = _Ids()
    ids = np.fromiter(map(ids_of.__getitem__, words), np.int64, len(words))
    seen, n_dup, n_lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if not line or line.isspace():
            continue
        n_lines += 1
        if line in seen:
            n_dup += 1
        else:
            seen.add(line)
    points = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(points, minlength=256)
    upper = int(kinds[65:91].sum())
    return {
        "n_words": len(words),
        "word_chars": len(text) - int(kinds[32] + kinds[9:14].sum()),
        "n_symbols": int(sum(kinds[ord(c)] for c in SYMBOLS)),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeat_words(ids, len(ids_of)),
        "n_lines": n_lines,
        "n_upper": upper,
        "n_letters": int(kinds[_LETTERS].sum()),
        "n_bangs": int(kinds[33]),
        "n_bars": int(kinds[124]),
        "n_distinct": len(ids_of),
    }


def vote(m: dict[str, int]) -> int:
    """The rules' votes as one base-3 number; digit 0 abstains, 1 is good, 2 is bad."""
    if not m["n_words"]:
        return 0
    code = 0
    for k, (_, bad, good) in enumerate(RULES):
        code += (2 if bad(m) else 1 if good(m) else 0) * 3**k
    return code


def base_failed(m: dict[str, int]) -> bool:
    return m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and the vote code of every document."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measures(t) for t in texts_of(batch)]
        cols = [batch.column("doc_id")]
        cols += [pa.array([m[k] for m in found], pa.int64()) for k in STATS]
        cols += [pa.array([base_failed(m) for m in found]), pa.array([vote(m) for m in found], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *STATS, "base_failed", "votes"])

    schema = "doc_id bigint, " + ", ".join(f"{k} bigint" for k in STATS) + ", base_failed boolean, votes bigint"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), one, schema)


def no_worse_than_chance(weights: np.ndarray) -> np.ndarray:
    """Vote probabilities by (bad or good, rule, vote). Where documents of the other kind would get a vote more
    often than those it speaks for, both kinds get it equally often, so that labels cannot switch."""
    share = weights / weights.sum(2, keepdims=True)
    pooled = weights.sum(0) / weights.sum((0, 2))[:, None]
    for vote_, kind in ((1, 1), (2, 0)):
        turned = share[kind, :, vote_] < share[1 - kind, :, vote_]
        share[:, turned, vote_] = pooled[turned, vote_]
    return share / share.sum(2, keepdims=True)


def fit(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Expectation-maximisation over vote patterns: pattern -> posterior probability of good."""
    if not counts:
        return {}
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[c] for c in codes], float)
    digits = (codes[:, None] // 3 ** np.arange(len(RULES))) % 3
    hot = (digits[:, :, None] == np.arange(3)).astype(float)  # pattern, rule, vote
    good, bad = (digits == 1).sum(1), (digits == 2).sum(1)
    # One clear bad vote outweighs the good ones at the start: rules aim at single defects.
    post = 1 / (1 + np.exp(-(0.5 * good - 2.5 * bad)))
    for _ in range(rounds):
        w = np.stack([1 - post, post]) * n
        share = w.sum(1) / w.sum()
        table_ = no_worse_than_chance(np.einsum("yp,prv->yrv", w, hot) + np.array([1.0, 0.2, 1.0])[None, None, :])
        like = np.einsum("prv,yrv->yp", hot, np.log(table_)) + np.log(np.maximum(share, 1e-9))[:, None]
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -60, 60)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return dict(zip(codes.tolist(), post.tolist(), strict=True))


def posteriors(votes: DataFrame, column: str = "votes") -> dict[int, float]:
    """Fit on the votes of all documents. Only their counts, bounded by the number of patterns, reach the driver."""
    return fit({r[0]: r[1] for r in votes.groupBy(column).agg(F.count(F.lit(1))).collect()})


def apply_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, statistics, base_failed, posterior and kept of every document.

    The fitted posteriors travel back as a table of as many rows as there are vote patterns.
    """
    spark = docs.sparkSession
    seen = written(measured(docs), "votes")
    known = spark.createDataFrame(list(posteriors(seen).items()) or [(-1, 0.0)], "votes bigint, posterior double")
    out = seen.join(F.broadcast(known), "votes", "left")  # at most 3 ** len(RULES) rows
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= F.lit(threshold))).drop("votes")


def good_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep: each row by its own text, without a shuffle."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measures(t) for t in texts_of(batch)]
        cols = pa.array([not base_failed(m) for m in found], pa.bool_()), pa.array([vote(m) for m in found], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "__base_passed", "__votes"])

    wider = T.StructType([*docs.schema.fields, T.StructField("__base_passed", T.BooleanType()), T.StructField("__votes", T.LongType())])
    judged = written(map_batches(docs, one, wider), "judged")
    good = [(k,) for k, p in posteriors(judged, "__votes").items() if p >= threshold]
    good = docs.sparkSession.createDataFrame(good or [(-1,)], "__votes bigint")
    return judged.where("__base_passed").join(F.broadcast(good), "__votes", "left_semi").select(docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))
