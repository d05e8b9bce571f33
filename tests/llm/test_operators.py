"""Every operator on awkward rows, and against brute force where SQL cannot say it."""

import hashlib
import random
import re
import time
import wave
import zlib
from collections import Counter
from io import BytesIO

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import best_fit_packing as packing
from tidemark.llm import chat_formatting as chat
from tidemark.llm import media_columns as media
from tidemark.llm import minhash_dedup as dedup
from tidemark.llm import personal_data as pii
from tidemark.llm import quality_rules as quality
from tidemark.llm import queries
from tidemark.llm import sentence_pieces as pieces
from tidemark.llm import token_counts as counts
from tidemark.llm import toxicity as tox
from tidemark.llm import url_filters as urls

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, votes int, id int"
WORDS = [f"w{k}" for k in range(4000)]
SENTENCE = " ".join(WORDS[:120])
AWKWARD = [None, "", " \n\t ", "a", "one two", SENTENCE, SENTENCE, SENTENCE + " extra", "é漢😀\x00 ▁x  y</s>[INST]<|endoftext|>", "x" * 50_000, "ab " * 20_000, "line\nline\nline"]


def docs(spark, texts=AWKWARD):
    return spark.createDataFrame([(k, t, None, "s", None, "clash", k, k) for k, t in enumerate(texts)], DDL)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


ROWWISE = {
    "pieces": lambda d: pieces.encoded(d, public_tokenizers.path(pieces.MODEL)),
    "media": media.media_columns,
    "pii": pii.found,
    "quality": quality.apply_rules,
    "counts": lambda d: counts.count_tokens(d, public_tokenizers.path(counts.MODEL)),
    "dedup": lambda d: dedup.near_duplicates(d, 3, 85),
    "packing": packing.best_fit_packing,
}


@pytest.mark.parametrize("name", ROWWISE)
def test_awkward_rows_and_empty_tables(spark, name):
    got = ROWWISE[name](docs(spark))
    assert {r["doc_id"] for r in got.collect()} == set(range(len(AWKWARD)))
    assert ROWWISE[name](docs(spark).where("false")).count() == 0
    twice = docs(spark, ["same text here " * 30] * 2)
    drop = {"doc_id", "component_id", "kept", "chosen", "sequence_id", "offset"} if name in ("dedup", "packing") else {"doc_id"}
    a, b = ({k: v for k, v in r.items() if k not in drop} for r in by_id(ROWWISE[name](twice)).values())
    assert a == b


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    expected = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r) for r in queries.queries()[name](spark, sf_dir).select(*names).collect()), key=repr) == expected


def test_chat_trees_and_round_trip(spark):
    hard = ["<s>", "</s>", "<\\s>", "<\\\\/s>", "[INST]x[/INST]", "[\\INST]", "<", "[", "\\", "plain", "", None]
    rows, rng = [], random.Random(3)
    for tree in ("a", "b"):
        for k in range(1, 60):
            rows.append((tree, k, None if k == 1 else rng.randint(max(1, k - 4), k - 1), rng.choice(["user", "assistant", "<s>", None]), rng.choice(hard), float(rng.randint(0, 3))))
    rows += [("orphan", 1, 99, "user", "u", 0.0), ("cycle", 1, 2, "user", "x", 0.0), ("cycle", 2, 1, "user", "y", 0.0)]
    got = {r["tree"]: r for r in chat.format_chats(spark.createDataFrame(rows, "tree string, id bigint, parent bigint, role string, text string, score double")).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert set(got) == {"a", "b", "orphan"}
    for tree in ("a", "b"):
        nodes = {r[1]: r for r in rows if r[0] == tree}
        paths = []
        for leaf in set(nodes) - {r[2] for r in nodes.values()}:
            path = [leaf]
            while nodes[path[-1]][2]:
                path.append(nodes[path[-1]][2])
            paths.append((-sum(nodes[k][5] for k in path), leaf, path[::-1]))
        _, leaf, best = min(paths)
        assert got[tree]["leaf"] == leaf
        assert [(t["role"], t["text"]) for t in got[tree]["turns"]] == [(nodes[k][3] or "", nodes[k][4] or "") for k in best]
        text = got[tree]["formatted"]
        learnt = [re.sub(r"([<\[])\\(\\*/?(?:s>|INST\]))", r"\1\2", text[s["start"] : s["end"]]) for s in got[tree]["loss_spans"]]
        assert learnt == [nodes[k][4] or "" for k in best if nodes[k][3] == "assistant"]


def test_chat_query_on_null_and_repeated_turns(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "lone"), (2, None, "user", "q")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op1_chat_formatting(spark, str(tmp_path)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 1, 2: 1, -7: 2}
    assert got[None]["loss_chars"] == 4 and got[-7]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nuser\n\n\nx\n").hexdigest()


def test_unigram_is_optimal_and_decodes(sf_dir):
    m = pieces.Unigram(public_tokenizers.path(pieces.MODEL))
    index = {p: k for k, p in enumerate(m.pieces)}

    def brute(text):
        text = "▁" + text.replace(" ", "▁")
        best = [(0.0, [])] + [(-np.inf, [])] * len(text)
        for a in range(len(text)):
            for b in range(a + 1, len(text) + 1):
                k = index.get(text[a:b])
                ok = k is not None and k > 2 and not text[a:b].startswith("<0x")
                if not ok and b == a + 1 and k is None:
                    gain, ids = m.unknown, [m.byte_ids[c] for c in text[a:b].encode()]
                elif ok:
                    gain, ids = m.score[k], [k]
                else:
                    continue
                if best[a][0] + gain > best[b][0]:
                    best[b] = (best[a][0] + gain, best[a][1] + ids)
        return best[-1][1]

    rng = random.Random(1)
    texts = ["".join(rng.choice(["th", "ing", " ", "é", "漢", "😀", ".", "a", "%%%", "\n", "E", "dat", "<0x0A>"]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    for text, ids in zip(texts, m.encode(texts), strict=True):
        assert ids.tolist() == brute(text), text
        assert m.decode(ids) == text
    assert [x.tolist() for x in m.encode(texts[:5])] == [m.encode([t])[0].tolist() for t in texts[:5]]
    assert m.encode([""])[0].tolist() == [] and m.decode(np.zeros(0, int)) == "" and len(m.encode(["z" * 500])[0]) > 0


def test_double_array():
    keys = sorted({bytes(random.Random(k).choices(b"abc\xff", k=1 + k % 5)) for k in range(200)})
    trie = pieces.DoubleArray([(w, n) for n, w in enumerate(keys)])
    for text in (b"abcabc", b"\xff\xffab", b"zzz", b""):
        assert list(trie.prefixes(text)) == [(len(w), keys.index(w)) for w in sorted(keys, key=len) if text.startswith(w)]


def test_media_round_trip(spark):
    got = by_id(media.media_columns(docs(spark), keep_media=True))
    for k, t in enumerate(AWKWARD):
        raw = (t or "").encode()
        padded = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        with wave.open(BytesIO(bytes(got[k]["media"]))) as w:
            assert w.readframes(w.getnframes()) == padded and w.getsampwidth() == 1
        assert (got[k]["n_bytes"], got[k]["payload_bytes"], got[k]["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert got[k]["payload_sha256"] == hashlib.sha256(padded).hexdigest()
    assert got[5]["feature"] == got[6]["feature"] != got[7]["feature"] and got[0]["feature"] == got[1]["feature"]
    long = (SENTENCE * 2000)[: media.HOP * (media.BLOCK + 50)]
    t, f = media.spectral_peaks(long.encode())
    assert list(zip(t, f, strict=True)) == sorted(zip(t, f, strict=True)) and t.max() > media.BLOCK


def test_media_frames_overlap_and_pairs_reach_later_frames(spark):
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choices("abcdefghij klmnopqrstuvwxyz.", k=n))
    got = media.media_columns(docs(spark, ["", "a", "b"] + [draw(n) for n in range(1, 257, 5)]), keep_media=True).collect()
    assert all(r["fingerprints"] for r in got) and len({r["feature"] for r in got}) >= len(got) - 2
    assert len({r["feature"] for r in got if r["n_bytes"] >= 16}) == sum(r["n_bytes"] >= 16 for r in got)
    text = draw(5000).encode()
    t, f = media.spectral_peaks(text)
    brute = []
    for k in range(len(t)):
        later = [j for j in range(k + 1, len(t)) if t[j] > t[k]][: media.FAN]
        brute += [int(t[k]) << 24 | int(f[k]) << 16 | int(f[j]) << 8 | int(t[j] - t[k]) for j in later if t[j] - t[k] <= media.REACH]
    assert media.fingerprints(t, f).tolist() == sorted(brute)
    assert media.fingerprints(np.array([0, 0]), np.array([5, 13])).tolist() == [5 << 16, 13 << 16]
    pairs = lambda x: Counter(h & 0xFFFFFF for h in media.fingerprints(*media.spectral_peaks(x)).tolist())
    shared = [(pairs(text) & pairs(draw(s).encode() + text)).total() / pairs(text).total() for s in range(1, 255, 23)]
    assert sum(shared) / len(shared) > 0.35
    long = draw(media.HOP * (2 * media.BLOCK + 50)).encode()
    whole = media.spectral_peaks(long)
    block, media.BLOCK = media.BLOCK, 10**6
    try:
        assert [x.tolist() for x in whole] == [x.tolist() for x in media.spectral_peaks(long)]
    finally:
        media.BLOCK = block


def test_packing_is_gapless_and_tight(spark, sf_dir):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = AWKWARD + [" ".join(rng.choices(WORDS, k=rng.randint(0, 900))) for _ in range(150)] + ["don't  stop \x1c we'll\n\n x", "١٢ ½ <|endoftext|>"]
    rows = packing.best_fit_packing(docs(spark, texts)).collect()
    for k, t in enumerate(texts):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1]] and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 2048 for r in mine[1:])
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in mine)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]] and sum(n for _, n in held) <= 2048
    assert len(places) <= -(-sum(r["length"] for r in rows) // 2048) + 2


def brute_places(lengths, size):
    """One piece at a time, longest first, where the sum of the squared counts of open sequences by gap is least."""
    n, stacks, fresh, out = [0] * (size + 1), [[] for _ in range(size + 1)], 0, {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        length, best = lengths[k], None
        for gap in range(length, size):
            if n[gap]:
                after = n[:]
                after[gap] -= 1
                after[gap - length] += 1
                cost = sum(m * m for m in after[1:size])
                if best is None or cost < best[0]:
                    best = (cost, gap)
        gap = best[1] if best else size
        if best:
            sequence = stacks[gap].pop()
            n[gap] -= 1
        else:
            sequence, fresh = fresh, fresh + 1
        out[k] = (sequence, size - gap)
        if gap > length:
            n[gap - length] += 1
            stacks[gap - length].append(sequence)
    return [out[k] for k in range(len(lengths))]


def test_packing_places_every_piece_by_the_rule():
    rng = random.Random(2)
    for size in (1, 2, 7, 16, 40):
        for _ in range(20):
            lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
            sequence, offset = packing.places(np.array(lengths, np.int64), size)
            assert list(zip(sequence.tolist(), offset.tolist(), strict=True)) == brute_places(lengths, size)
    lengths = np.array([rng.randint(1, 64) for _ in range(5000)])
    assert packing.places(lengths, 64)[0].max() + 1 <= 1.01 * lengths.sum() / 64


def test_packing_in_parts_keeps_every_piece_and_its_ids(spark, tmp_path):
    texts = [None, "a b c"] * 40 + [" ".join(WORDS[k : k + 30]) for k in range(60)]
    given = spark.createDataFrame([(k if k % 3 else None, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    json_path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    packing.pieces(given, json_path, ranks, 64, with_ids=True).withColumn("row", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "p"))
    rows = packing.pack(spark.read.parquet(str(tmp_path / "p")), 64, part=50).collect()
    tk = Tokenizer.from_file(json_path)
    want = Counter()
    for t in texts:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        want.update(tuple(ids[a : a + n]) for a, n in packing.cut(len(ids), 64))
    assert Counter(tuple(r["ids"]) for r in rows) == want and len({r["sequence_id"] // packing.STRIDE for r in rows}) > 2
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["ids"]))
    for parts in held.values():  # a sequence is rebuilt from its pieces, without gap or overlap
        assert sum(len(ids) for _, ids in parts) <= 64
        at = 0
        for offset, ids in sorted(parts):
            assert offset == at
            at += len(ids)


def brute_components(texts, width, percent):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return [len(s) for s in sets], [root(k) for k in range(len(sets))]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, width, percent):
    rng, texts = random.Random(width), list(AWKWARD)
    for _ in range(5):
        base = rng.choices(WORDS, k=rng.randint(60, 200))
        for _ in range(40):
            words = base[:]
            for _ in range(rng.randint(0, 7)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    got = by_id(dedup.near_duplicates(docs(spark, texts), width, percent))
    sizes, labels = brute_components(texts, width, percent)
    assert [got[k]["n_shingles"] for k in range(len(texts))] == sizes
    assert [got[k]["component_id"] for k in range(len(texts))] == labels
    assert all(got[k]["kept"] == (labels[k] == k) for k in range(len(texts)))


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    for n in (1, 3, 50, 3000):
        s = dedup.sketch(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)))
        assert len(s) == dedup.SLOTS and s.max() < np.iinfo(np.uint64).max
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    b = np.concatenate([a[:3600], np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))])
    assert abs((dedup.sketch(a) == dedup.sketch(np.sort(b))).mean() - 3600 / 4400) < 0.1
    for t in (0.8, 0.85):
        r = dedup.rows_per_band(t)
        assert (1 - t**r) ** (dedup.SLOTS // r) < dedup.MISS


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["id"]: r["label"] for r in dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}


BRUTE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    out = []
    for n, (kind, rule) in enumerate(BRUTE.items()):
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), n))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_personal_data(spark):
    rng = random.Random(4)
    parts = ["@", ".", "1", "25", "300", "4111111111111111", "a", "b.c", "+", "-", " ", "(", ")", "x@y.z", "1.2.3.4", "٣", "\n", "é", "+1 (555) 010-9999"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert all(pii.base_spans(t) == brute_spans(t) for t in texts)
    texts = AWKWARD + texts[:200] + ['x token = "9f86d081884c7d659a2feaa0c55ad015" y', "password=25a0bc4376e17c8019 z", "dear Mr Karl Lindner", "4465758382889437 4465758382889437", "plain words in 1999 and 20 more"]
    got = by_id(pii.found(docs(spark, texts)))
    for k, t in enumerate(texts):
        base, spans = brute_spans(t or ""), got[k]["spans"].split(",") if got[k]["spans"] else []
        joined = [f"{pii.KINDS[n]}:{a}:{b}" for a, b, n in base]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(spans)
        assert [got[k][f"n_{kind}"] for kind in pii.BASE] == [sum(n == j for _, _, n in base) for j in range(4)]
    n = len(texts)
    assert [got[k]["spans"] for k in range(n - 5, n)] == ["secret:11:43", "secret:9:27", "name:8:20", "card:0:16,card:17:33", ""]
    clean = pii.redact(docs(spark, texts)).where(F.col("doc_id") == n - 5).first()
    assert clean["text"] == 'x token = "[SECRET]" y' and clean["n_chars"] == len(clean["text"]) and clean["digest"] == "clash"


def test_secrets_are_found_behind_their_cues_and_nowhere_else(spark):
    cue = re.compile(r"(?i)\b(?:password|passwd|token|secret|api[_-]?key|key|pwd)\b\s*[=:]\s*[\"']?([^\s\"']{6,})")
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    found = wanted = 0
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        for text, (_, spans) in zip(part, pii.all_spans(part), strict=True):
            secrets = {(a, b) for a, b, k in spans if pii.KINDS[k] == "secret"}
            want = {m.span(1) for m in cue.finditer(text)}
            assert secrets <= want
            found, wanted = found + len(secrets), wanted + len(want)
    assert wanted > 100 and found >= 0.98 * wanted


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for k, w in enumerate(windows) if often[w] > 1 for j in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_verdicts(spark):
    rng = random.Random(6)
    texts = [t or "" for t in AWKWARD] + ["".join(rng.choice(["a ", "b ", "c\n", "\x0b", "# ", "é\xa0", "\x85", "a b c "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for t in texts:
        m = quality.measures(t)
        assert tuple(m[k] for k in quality.STATS) == brute_measures(t), t
    prose = [" ".join(f"{rng.choice('abcdefg')}{rng.choice('aeiou')}{rng.choice(WORDS)[1:]}x".replace("0", "o") + rng.choice("lmnop") * 4 for _ in range(120)) + "." for _ in range(200)]
    junk = [" ".join(w + "***" for w in t.split()) for t in prose[:20]] + [" ".join(w.upper() + "!!" for w in t.split()) for t in prose[20:40]]
    got = by_id(quality.apply_rules(docs(spark, prose + junk)))
    assert all(got[k]["kept"] for k in range(200)) and not any(got[k]["kept"] for k in range(200, 240))


def test_token_counts(spark, sf_dir):
    path = public_tokenizers.path(counts.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    long = ["x" * 5000, "a b" * 3000, " " * 5000, "é漢字 " * 2000, "\n\n a\n " * 2000, "漢" * 4000 + " " + "字" * 4000 + " b", "▁ ▁a ▁▁ " * 800, "ab " * 10 + "c" * 9000 + " d " * 40, "</s> <s> " * 900]
    for t in long:
        for chunk, overlap in ((500, 20), (1000, 5), (300, 64)):
            assert counts.encode_resync(t, path, chunk, overlap) == sp.encode(t), t[:20]
    got = by_id(counts.count_tokens(docs(spark), path))
    for k, t in enumerate(AWKWARD):
        n = len(sp.encode(t or ""))
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (n, len((t or "").encode()), n > 4096)


def test_token_counts_take_time_in_proportion(sf_dir):
    path = public_tokenizers.path(counts.MODEL)
    sp = counts.processor(path)
    assert not set(counts.stable_cuts("漢字 a", path)) ^ {1, 2} and 1 not in counts.stable_cuts("the", path)
    for unit in ("漢字かな", "x", " ", "helloworldthisis"):
        took = []
        for n in (250_000, 1_000_000):
            text = (unit * n)[:n]
            began = time.perf_counter()
            got = sum(map(len, counts._parts(text, path, counts.CHUNK, counts.OVERLAP)))
            took.append(time.perf_counter() - began)
            assert got == len(sp.encode(text))
        assert took[1] < 9 * took[0] + 0.5, (unit, took)


def test_url_parts_and_rules(spark):
    rows = [
        (1, "https://A.Example.net/en/x?q#f"), (2, "http://net/"), (3, "http://fishnet/"), (4, "x://b.example.com/de/"), (5, "https://wiki.org/fr/a"), (6, None),
        (7, "no scheme"), (8, "https://h.org?x=/fr/"), (9, "http://example.net"), (10, "https://z.net/en/"), (11, "http://bad.org/1"), (12, "://"), (1, "https://A.Example.net/en/x?q#f"),
    ]
    rows += [(100 + k, "http://bad.org/x") for k in range(40)] + [(200 + k, f"http://good{k % 4}.org/x") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(100 + k, 0, 1) for k in range(40)] + [(200 + k, 1, 0) for k in range(40)] + [(None, 0, 1), (5, None, None), (9999, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.url_filters(pages, urls.outcomes_of(labels)).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("net", "/", "net/", "block")
    assert got[3] == ("fishnet", "/", None, "allow") and got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("h.org", "", None, "allow") and got[9] == ("example.net", "", None, "allow")
    assert got[10][2:] == ("net/", "block") and got[11] == ("bad.org", "/1", None, "block") and got[12][:2] == ("", "") and got[200][3] == "allow"
    nothing = urls.url_filters(pages, urls.outcomes_of(labels.where("false")))
    assert nothing.where("rule is null and verdict = 'block'").count() == 0
    assert urls.url_filters(pages.where("false"), urls.outcomes_of(labels)).count() == 0


def test_hosts_without_labels_back_off(spark):
    hosts = [f"h{k}.bad.org" for k in range(4)] + [f"h{k}.good{d}.org" for d in range(6) for k in range(4)]
    rows = [(100 * n + k, f"http://{host}/x", int(".bad." in host and k < 27)) for n, host in enumerate(hosts) for k in range(30)]
    new = ["http://new.bad.org/", "http://new.good1.org/", "http://new.other.org/", "http://new.elsewhere.io/", None]
    pages = spark.createDataFrame([r[:2] for r in rows] + [(90_000 + k, u) for k, u in enumerate(new)], "page_id bigint, url string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id bigint, quality int, toxic int")
    outcomes = urls.outcomes_of(labels)
    cut = pages.select("page_id", urls.split_url(F.col("url"))[0].alias("host"))
    known = {r["host"]: r for r in urls.reputations(cut, outcomes).collect()}
    assert set(known) == {*hosts, "new.bad.org", "new.good1.org", "new.other.org", "new.elsewhere.io", ""}
    bad = known["new.bad.org"]
    assert bad["n"] == 0 and 0.85 < bad["mean"] < 0.9 and bad["low"] > urls.LIMIT and known["h0.bad.org"]["blocked"]
    assert known["new.other.org"]["low"] < known["new.other.org"]["mean"] < 0.3
    got = {r["page_id"]: r["verdict"] for r in urls.url_filters(pages, outcomes).collect()}
    assert [got[90_000 + k] for k in range(5)] == ["block", "allow", "allow", "allow", "allow"]
    assert all(got[r[0]] == ("block" if ".bad." in r[1] else "allow") for r in rows)


def test_toxicity_learns_from_documents(spark):
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ane", "ilo", "urt", "ess")]
    make = lambda bad: ". ".join(" ".join(rng.choices(plain, k=8)) + (" vileword" if bad and s == 2 else "") for s in range(5)) + "."
    texts = [make(k % 4 == 0) for k in range(400)] + [None, "", "vileword"]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(0, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    got = by_id(tox.toxicity(docs(spark, texts), labels))
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    held = [k for k in range(400) if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == (k % 4 == 0) for k in held) >= 0.97 * len(held)
    assert got[400]["score"] == got[401]["score"] == 0.0 and got[402]["score"] > 0.5
    bad = got[0]
    assert "vileword" in texts[0][bad["worst_start"] : bad["worst_end"]]
    empty = by_id(tox.toxicity(docs(spark, ["x"]), labels.where("false")))
    assert empty[0]["score"] == 0.0 and tox.toxicity(docs(spark, []), labels).count() == 0


def test_length_alone_makes_no_document_toxic(spark):
    at = "/root/testdata/sf0.1"
    labels, given = spark.read.parquet(f"{at}/labels.parquet"), spark.read.parquet(f"{at}/documents.parquet")
    model = tox.fit(given, labels)
    rows = given.join(labels, "doc_id").where("toxic is not null").select("doc_id", "text", "toxic", (tox.remainder() == 0).alias("held")).collect()
    for held in (True, False):
        long = ". ".join(r["text"] or "" for r in rows if r["held"] == held and not r["toxic"])
        for n in (500_000, 1_500_000):
            assert len(long) > n and tox.score(long[:n], model)[0] < 0.5
    found = [(tox.score(r["text"] or "", model)[0] >= 0.5, r["toxic"]) for r in rows if r["held"]]
    assert sum(a and b for a, b in found) >= 76 and sum(a and not b for a, b in found) <= 2
    bad = max((r["text"] for r in rows if r["toxic"] and r["text"]), key=lambda t: tox.score(t, model)[0])
    assert tox.score(long[:200_000] + ". " + bad, model)[0] > 0.5


def test_leak_and_scale_against_their_definition():
    texts = ["calm day. fine sea.", "vile word. calm day."] * 20 + ["fine sea. calm sea. fine day."] * 10
    labels = [0, 1] * 20 + [0] * 10
    model = tox.train(texts, labels)
    part = lambda s: np.log1p(np.exp(model.bias + sum(model.words[w] for w in s)))
    clean = [part(s) for t, y in zip(texts, labels, strict=True) if not y for s in tox.bag(t)]
    assert np.isclose(model.leak[0], np.mean(clean)) and np.isclose(model.leak[1], np.var(clean))
    for t in texts[:2]:
        sums = [part(s) for s in tox.bag(t)]
        beyond = max(0, sum(sums) - model.leak[0] * len(sums) - tox.SIGMAS * np.sqrt(model.leak[1] * len(sums)))
        assert np.isclose(tox.score(t, model)[0], 1 - np.exp(-model.scale * beyond))
    assert tox.score(texts[0], model)[0] < 0.5 < tox.score(texts[1], model)[0]


def test_every_offending_sentence_is_located(spark):
    model = tox.Model(tox.WordWeights({"vileword": 9.0, "grim": 5.5}), -6.0)
    texts = ["Fine words here. A vileword one. Calm again! VILEWORD twice? End.", "grim a. grim b. grim c.", "all calm. still calm.", "", None, "İ vileword."]
    got = by_id(tox.scored(docs(spark, texts), model))
    cut = {k: [texts[k][s["start"] : s["end"]] for s in got[k]["offending"]] for k in got}
    assert cut == {0: [" A vileword one", " VILEWORD twice"], 1: ["grim a"], 2: [], 3: [], 4: [], 5: ["İ vileword"]}
    assert got[1]["predicted"] == 1 and got[1]["worst_score"] < tox.OFFENDS and got[1]["offending"][0]["score"] == got[1]["worst_score"]
    assert all(s["score"] >= tox.OFFENDS for s in got[0]["offending"])
    untrained = by_id(tox.scored(docs(spark, texts), tox.Model(tox.WordWeights({}))))
    assert all(r["offending"] == [] for r in untrained.values())


def test_expectation_maximisation_against_plain_loops():
    rng = random.Random(12)
    counts_ = Counter()
    for _ in range(3000):
        good = rng.random() < 0.7
        code = sum((rng.choices((0, 1, 2), (2, 7, 1) if good else (2, 2, 6))[0]) * 3**k for k in range(len(quality.RULES)))
        counts_[code] += 1
    votes = {c: [c // 3**k % 3 for k in range(len(quality.RULES))] for c in counts_}
    post = {c: 1 / (1 + np.exp(-(0.5 * v.count(1) - 2.5 * v.count(2)))) for c, v in votes.items()}
    for _ in range(60):
        total = sum(counts_.values())
        share = [sum(n * (post[c] if y else 1 - post[c]) for c, n in counts_.items()) / total for y in (0, 1)]
        table = []
        for y in (0, 1):
            rows = []
            for k in range(len(quality.RULES)):
                w = [1.0, 0.2, 1.0]
                for c, n in counts_.items():
                    w[votes[c][k]] += n * (post[c] if y else 1 - post[c])
                rows.append([x / sum(w) for x in w])
            table.append(rows)
        for c, v in votes.items():
            like = [share[y] * np.prod([table[y][k][v[k]] for k in range(len(v))]) for y in (0, 1)]
            post[c] = like[1] / (like[0] + like[1])
    got = quality.fit(dict(counts_), rounds=60)
    assert all(abs(got[c] - post[c]) < 1e-6 for c in counts_)


def test_no_rule_is_worse_than_chance():
    w = np.array([[[1.0, 7.0, 2.0]] * len(quality.RULES), [[1.0, 2.0, 7.0]] * len(quality.RULES)])
    out = quality.no_worse_than_chance(w)
    assert np.allclose(out.sum(2), 1) and (out[1, :, 1] >= out[0, :, 1] - 1e-12).all() and (out[0, :, 2] >= out[1, :, 2] - 1e-12).all()
    fine = np.array([[[1.0, 2.0, 7.0]], [[1.0, 7.0, 2.0]]])
    assert np.allclose(quality.no_worse_than_chance(fine), fine / 10)
    assert quality.measures("ab — “cd” 😀 é漢")["n_letters"] == 6


def test_media_peaks_against_plain_loops():
    rng = random.Random(13)
    data = media.payload("".join(rng.choices("abc def\n.", k=700)))[1]
    x = [0.0] * media.LEAD + [b - 128.0 for b in data]
    frames = -(-len(x) // media.HOP)
    x += [0.0] * media.FRAME
    level = []
    for t in range(frames):
        part = np.array(x[t * media.HOP : t * media.HOP + media.FRAME], np.float32) * media._WINDOW
        k = np.arange(media.FRAME)
        level.append([abs((part * np.exp(-2j * np.pi * f * k / media.FRAME)).sum()) ** 2 for f in range(media.FRAME // 2 + 1)])
    want = []
    for low, high in media.BANDS:
        best = [max(range(low, high), key=lambda f: level[t][f]) for t in range(frames)]
        top = [-1.0, *(level[t][best[t]] for t in range(frames)), -1.0]
        want += [(t, best[t]) for t in range(frames) if top[t + 1] >= top[t] and top[t + 1] > top[t + 2] and top[t + 1] > 1e-6]
    t, f = media.spectral_peaks(data)
    assert list(zip(t.tolist(), f.tolist(), strict=True)) == sorted(want)


def test_remaining_links_in_families_of_every_kind(spark):
    rng, texts = random.Random(21), []
    for _ in range(3):  # chains that drift by replaced, lost and added words
        now = rng.choices(WORDS, k=150)
        for _ in range(40):
            for _ in range(rng.randint(1, 3)):
                at, kind = rng.randrange(len(now)), rng.random()
                now[at : at + (kind < 0.66)] = [rng.choice(WORDS)] if kind < 0.33 or kind >= 0.66 else []
            texts.append(" ".join(now))
    frame = rng.choices(WORDS, k=100)
    for _ in range(80):  # a template whose gaps are filled from few words
        words = frame[:]
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(100)] = rng.choice(WORDS[:20])
        texts.append(" ".join(words))
    rng.shuffle(texts)
    got = by_id(dedup.near_duplicates(docs(spark, texts), 3, 85))
    sizes, labels = brute_components(texts, 3, 85)
    assert [got[k]["component_id"] for k in range(len(texts))] == labels


def test_rows_without_or_with_shared_ids_are_judged_by_their_text(spark):
    a, b = " ".join(WORDS[:60]), " ".join(WORDS[100:160])
    rows = [(None, a), (None, b), (7, a), (7, b), (7, b), (None, None), (None, ""), (3, b + " more"), (9, " ".join(WORDS[200:260])), (9, "w1 w2 " * 9), (9, "w1 w2 " * 9)]
    given = spark.createDataFrame([(k, t, "en", 1) for k, t in rows], "doc_id bigint, text string, lang string, digest int")
    got = dedup.unique_documents(given, 5, 80)
    assert got.columns == given.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert kept == Counter([(7, a), (3, b + " more"), (None, None), (None, ""), (9, rows[8][1]), (9, rows[9][1])])
    found = dedup.near_duplicates(given, 5, 80).collect()
    assert len(found) == len(rows) and sum(r["component_id"] == 3 for r in found) == 4
    alone = [(None, a), (None, a + " x")]
    assert dedup.unique_documents(spark.createDataFrame(alone, "doc_id bigint, text string"), 5, 80).count() == 1
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert tox.clean_documents(given, labels).count() == len(rows)
    good = Counter((r["doc_id"], r["text"]) for r in quality.good_documents(given).collect())
    verdicts = Counter((r["doc_id"], r["kept"]) for r in quality.apply_rules(given).collect())
    assert sum(good.values()) == sum(n for (_, k), n in verdicts.items() if k) and sum(verdicts.values()) == len(rows)
    assert good[(None, a)] == good[(7, a)] and good[(7, b)] == 2 * good[(None, b)]


def test_chats_with_clashing_columns_and_without_rows(spark, tmp_path):
    rows = [(1, 0, "user", "q", "x", 5), (1, 1, "assistant", "a", "y", 6)]
    ddl = "conv_id bigint, turn bigint, role string, text string, parent string, score int"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "a/conversations.parquet"))
    spark.createDataFrame([], ddl).write.parquet(str(tmp_path / "b/conversations.parquet"))
    got = {r["conv_id"]: r["n_turns"] for r in chat.op1_chat_formatting(spark, str(tmp_path / "a")).collect()}
    assert got == {1: 2, -7: 2}
    assert [r["conv_id"] for r in chat.op1_chat_formatting(spark, str(tmp_path / "b")).collect()] == [-7]


def test_pipeline_against_its_parts(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "personal_data", "packing"]
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    at = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, sf_dir).persist()
        assert at.columns == given.columns
        kept = {r["doc_id"] for r in at.collect()}
        if name == "toxicity":
            assert kept == {r["doc_id"] for r in tox.toxicity(before, labels).where("predicted = 0").collect()}
        elif name == "quality":
            assert kept == {r["doc_id"] for r in quality.apply_rules(before).where("kept").collect()}
        elif name == "near_duplicates":
            rows = sorted(before.collect(), key=lambda r: r["doc_id"])
            _, roots = brute_components([r["text"] for r in rows], 5, 80)
            assert kept == {r["doc_id"] for k, r in enumerate(rows) if roots[k] == k}
        else:
            assert all(not brute_spans(r["text"]) or "[" in r["text"] for r in at.collect()) and at.count() == before.count()
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == at.count()


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, sf_dir, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, docs(spark), sf_dir).count() > 0 if stage != "quality" else run(spark, docs(spark), sf_dir).count() >= 0
    assert run(spark, docs(spark, []), sf_dir).count() == 0
