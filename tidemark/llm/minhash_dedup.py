"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A document is its set of hashed word shingles. A sketch of ``SLOTS`` coordinates is filled in rounds:
in round i every element falls into one slot with the value (i, hash), and a slot keeps its least
value; after as many rounds as slots, round SLOTS + k sends every element to slot k, so that every
coordinate is filled, and one round suffices for large sets. Bands of coordinates bring similar
documents into common buckets; the number of rows a band has follows from the threshold, so that a
pair at the threshold is missed with a chance below ``MISS``.

Exact copies (equal sets) become one class first. In each bucket the member that shares most
buckets with others is the centre, and every other member is compared with it alone (a star, not
all pairs), sieved by set size and one-bit sketches with a bound of ``SIEVE`` standard errors. Links are
confirmed on full sets and joined into components. Then only members outside their centre's component
may still link to the rest of their bucket; :func:`remaining_links` finds every such pair by the
elements in which both differ from what most of the family has. So no pair that could link
two components is left out, no group is gathered in one task, and no pair is written down that
shares none of its rarest differences.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing
and is kept; a text with fewer words than a shingle is one shingle; repeated rows are copies
of one another. Every row is judged by its own text, also where rows share a doc_id or have none; a
component's id is its smallest doc_id that is not null, and ``chosen`` marks its one
(doc_id, text), by doc_id with nulls last, then by the text's hash. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import forget, map_batches, table, texts_of, written

SLOTS, MISS, SIEVE = 252, 1e-7, 5.5
_LOW = np.uint64((1 << 40) - 1)
_ROUND = np.arange(2 * SLOTS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEED = mix((_ROUND + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    n = len(words) - size + 1
    out = mix(h[:n] + _SEED[size])
    for k in range(1, size):
        out = mix(out + h[k : n + k])
    return np.unique(out)


def sketch(items: np.ndarray) -> np.ndarray:
    """SLOTS values of a non-empty set."""
    n, slots = len(items), np.full(SLOTS, np.iinfo(np.uint64).max)
    at, step = 0, max(1, min(SLOTS, math.ceil(6 * SLOTS / n)))
    while at < SLOTS:
        to = min(SLOTS, at + step)
        x = mix(items[None, :] + _SEED[at:to, None])
        place = ((x >> np.uint64(32)) * np.uint64(SLOTS)) >> np.uint64(32)
        value = (x & _LOW) | (_ROUND[at:to, None] << np.uint64(40))
        np.minimum.at(slots, place.ravel().astype(np.int64), value.ravel())
        if slots.max() != np.iinfo(np.uint64).max:
            return slots
        at = to
    for k in np.flatnonzero(slots == np.iinfo(np.uint64).max):
        slots[k] = (mix(items + _SEED[SLOTS + k]) & _LOW).min() | (_ROUND[SLOTS + k] << np.uint64(40))
    return slots


def rows_per_band(threshold: float) -> int:
    """The most rows for which a pair at the threshold is missed with a chance below MISS."""
    return max(r for r in range(1, 13) if r == 1 or (1 - threshold**r) ** (SLOTS // r) < MISS)


def most_differing_bits(threshold: float) -> int:
    """One-bit sketches of a pair at the threshold differ in more bits only beyond SIEVE standard errors."""
    p = (1 - threshold) / 2
    return math.ceil(SLOTS * p + SIEVE * math.sqrt(SLOTS * p * (1 - p)))


def signatures(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the set, band keys and the one-bit sketch of every document."""
    rows = rows_per_band(threshold)
    bands = SLOTS // rows

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, keys, bits = [], [], [], []
        for text in texts_of(batch):
            items = shingles(text, width)
            sizes.append(len(items))
            if not len(items):
                digests.append(None)
                keys.append(None)
                bits.append([0] * 4)
                continue
            digests.append(xxhash.xxh3_128_digest(items.astype("<u8").tobytes()))
            s = mix(sketch(items))
            part = s[: bands * rows].reshape(bands, rows)
            key = _SEED[:bands].copy()
            for k in range(rows):
                key = mix(key + part[:, k])
            keys.append(key.view(np.int64))
            odd = np.zeros(256, np.uint8)
            odd[:SLOTS] = s & np.uint64(1)
            bits.append(np.packbits(odd).view(np.int64).tolist())
        cols = [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        cols += [pa.array([b[k] for b in bits], pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n_shingles", "digest", "bands", "b0", "b1", "b2", "b3"])

    schema = "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, bands array<bigint>, b0 bigint, b1 bigint, b2 bigint, b3 bigint"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), text_hash().alias("text_hash")), one, schema)


def text_hash() -> Column:
    """Tells the texts of rows with one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def may_link(left: str, right: str, percent: int) -> Column:
    """The sieve before verification: set sizes and one-bit sketches allow the threshold."""
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    differ = sum((F.bit_count(F.col(f"{left}.b{k}").bitwiseXOR(F.col(f"{right}.b{k}"))) for k in range(4)), F.lit(0))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (differ <= most_differing_bits(percent / 100))


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id and whole shingle set (64-bit words) of the documents in ``ids``: id, doc_id, text_hash."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("__d"), text_hash().alias("__h"), F.col("text").cast("string"))
    chosen = texts.join(ids, F.col("__d").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.col("text_hash")))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shingles(t, width).view(np.int64) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(got, pa.list_(pa.int64()))], ["id", "items"])

    return map_batches(chosen.select("id", "text").dropDuplicates(["id"]), one, "id bigint, items array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a").select("a", "b", "items_a", "items_b")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            merged = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((merged[1:] == merged[:-1]).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, one, "a bigint, b bigint")


def remaining_links(marked: DataFrame, sets: DataFrame, percent: int, into: list[str] | None = None) -> DataFrame:
    """Confirmed links (a, b) between members of a family whose components differ: all that matter.

    ``marked``: id, own component, family (the component of a centre whose bucket it is in). What most
    members of a family have is its common set C; a member x is known by its difference D(x) to C,
    and two members differ by ``d(x) + d(y) - 2 |D(x) & D(y)|`` elements. So with
    ``slack(x) = (100 - p) |x| - (100 + p) d(x)``, x and y link just where
    ``2 (100 + p) |D(x) & D(y)| >= -(slack(x) + slack(y))``.

    Where the right side is not positive they link whatever they share: a star around the member of
    most slack joins all of those. Every other pair must share one of the elements with which each
    begins when D is ordered from the rarest in the family on (as many as leave too few behind); only
    members outside the star's component look for partners, and only pairs found are verified.
    """
    p, q = 100 - percent, 100 + percent
    totals = marked.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.max(F.col("own") != F.col("family")).alias("open"))
    open_ = marked.join(totals.where("open").drop("open"), "family").join(sets, "id")
    open_ = written(open_.select("family", "members", "id", "own", "items"), "families", into)

    # Elements by family: how many members have them, so which of them are common.
    counted = open_.select("family", "members", F.explode("items").alias("e")).groupBy("family", "e").agg(F.count(F.lit(1)).alias("n"), F.max("members").alias("members"))
    counted = written(counted.where("n > 1").withColumn("common", 2 * F.col("n") > F.col("members")), "elements", into)
    common = counted.where("common").groupBy("family").agg(F.collect_list("e").alias("c"))
    shared = counted.select("family", "e", F.when(F.col("common"), F.col("members") - F.col("n")).otherwise(F.col("n")).alias("rare")).where("rare > 1")

    c = F.coalesce("c", F.array().cast("array<bigint>"))
    apart = open_.join(common, "family", "left").withColumn("d", F.concat(F.array_except("items", c), F.array_except(c, F.col("items"))))
    slack = p * F.size("items").cast("bigint") - q * F.size("d").cast("bigint")
    apart = written(apart.select("family", "id", "own", F.size("items").alias("n_items"), slack.alias("slack"), "d"), "differences", into)
    hubs = apart.groupBy("family").agg(F.max_by(F.struct("id", "own", "slack"), F.struct("slack", -F.col("id"))).alias("hub"))
    seen = apart.join(hubs, "family")
    certain = (F.col("slack") + F.col("hub.slack") >= 0) & (F.col("own") != F.col("hub.own"))
    star = seen.where(certain).select(F.col("hub.id").alias("a"), F.col("id").alias("b"))
    seen = seen.withColumn("own", F.when(certain, F.col("hub.own")).otherwise(F.col("own"))).withColumn("seeks", F.col("own") != F.col("hub.own"))
    seen = written(seen.select("family", "id", "own", "n_items", "slack", "d", "seeks", F.col("hub.slack").alias("most")), "seekers", into)
    most = seen.where("seeks").groupBy("family").agg(F.max("slack").alias("most_seeking"))

    # Every difference with its place in the order; unshared ones come first and need no row.
    placed = seen.join(most, "family").select("*", F.size("d").alias("n_d"), F.explode("d").alias("e")).drop("d").join(shared, ["family", "e"])
    by_rarity = Window.partitionBy("family", "id").orderBy("rare", "e")
    whole = Window.partitionBy("family", "id")
    placed = placed.withColumn("left", F.row_number().over(by_rarity) - 1 + F.col("n_d") - F.count(F.lit(1)).over(whole))
    placed = placed.withColumn("left", (2 * q) * (F.col("n_d") - F.col("left")))
    # The best partner there could be must still be within reach of what is left.
    reach = F.when(F.col("seeks"), F.col("most")).otherwise(F.col("most_seeking"))
    placed = written(placed.where(-F.col("slack") - reach <= F.col("left")).select("family", "e", "id", "own", "n_items", "slack", "left", "seeks"), "places", into)
    x, y = placed.where("seeks").alias("x"), placed.alias("y")
    meet = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.own") != F.col("y.own")) & (
        -F.col("x.slack") - F.col("y.slack") <= F.least("x.left", "y.left")
    ) & (100 * F.least("x.n_items", "y.n_items") >= percent * F.greatest("x.n_items", "y.n_items")))
    pairs = written(meet.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "pairs", into)
    return confirmed(pairs, sets, percent).unionByName(star)


def components(links: DataFrame, into: list[str] | None = None) -> DataFrame:
    """id and label (the smallest id reachable) of every end of a link.

    Each round hooks every vertex to its smallest neighbour, follows hooks twice, and contracts;
    a component's number of vertices at least halves, so rounds grow with the logarithm.
    """
    edges = written(links.where("a <> b").select("a", "b").distinct(), "edges", into)
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        hook = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "hooks", into)
        for _ in range(2):
            up = hook.select(F.col("id").alias("label"), F.col("label").alias("next"))
            hook = hook.join(up, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
        hook = written(hook, "hooks", into)
        up = hook.select(F.col("id").alias("label"), F.col("label").alias("next"))
        if labels is None:
            labels = hook
        else:
            labels = written(labels.join(up, "label", "left").select("id", F.coalesce("next", "label").alias("label")), "labels", into)
        a, b = (hook.select(F.col("id").alias(c), F.col("label").alias(f"{c}2")) for c in ("a", "b"))
        edges = written(edges.join(a, "a").join(b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges", into)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")) if labels is None else labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash and chosen of every document."""
    threshold, spent = percent / 100, []  # tables that only this function reads
    sig = written(signatures(docs, width, threshold).withColumn("row", F.monotonically_increasing_id()), "signatures")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("low")
    classes = written(sig.where("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("copies"), low), "classes", spent)
    first = sig.withColumnRenamed("row", "id").join(classes.select("id"), "id", "left_semi")
    brief = ["id", "n_shingles", "b0", "b1", "b2", "b3"]
    bits = written(first.select(*brief, "doc_id", "text_hash", "bands"), "sketches", spent)
    keys, places = bits.select("id", F.explode("bands").alias("key")), bits.select("id", "doc_id", "text_hash")
    bits = bits.select(*brief)

    # Buckets of two or more, and each one's centre.
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(keys.join(sizes, "key"), "buckets", spent)
    degree = shared.groupBy("id").agg(F.sum("size").alias("degree"))
    centres = shared.join(degree, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("centre"))
    member = written(shared.drop("size").join(centres, "key"), "members", spent)

    star = member.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    near = star.join(bits.alias("x"), F.col("a") == F.col("x.id")).join(bits.alias("y"), F.col("b") == F.col("y.id"))
    star = written(near.where(may_link("x", "y", percent)).select("a", "b"), "star", spent)
    sets = written(sets_of(docs, places.join(member.select("id").distinct(), "id", "left_semi"), width), "sets", spent)
    links = written(confirmed(star, sets, percent), "links", spent)
    labels = components(links, spent)

    # Members outside their centre's component may link to that component and to one another.
    of_id = labels.select("id", F.col("label").alias("own"))
    of_centre = labels.select(F.col("id").alias("centre"), F.col("label").alias("family"))
    marked = member.join(of_id, "id", "left").join(of_centre, "centre", "left")
    marked = marked.select("id", F.coalesce("own", "id").alias("own"), F.coalesce("family", "centre").alias("family")).distinct()
    more = written(remaining_links(written(marked, "marked", spent), sets, percent, spent), "links", spent)
    if not more.isEmpty():
        labels = components(links.union(more), spent)

    named = classes.join(labels, "id", "left").where("copies > 1 or label is not null").select("digest", "low", F.coalesce("label", "id").alias("label"))
    named = named.select("digest", "label").join(named.groupBy("label").agg(F.min("low").alias("low")), "label").drop("label")
    named = written(named, "named")
    forget(spent)
    out = sig.select("doc_id", "n_shingles", "text_hash", "digest").join(named, "digest", "left")
    alone = F.col("low").isNull()
    chosen = alone | (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("text_hash") == F.col("low.text_hash")))
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("low.doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", chosen.alias("chosen"))


def unique_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component one, and every row without words.

    Of rows that repeat both doc_id and text any one stays.
    """
    stay = near_duplicates(docs, width, percent).where("chosen").groupBy("doc_id", "text_hash")
    stay = stay.agg(((F.count(F.lit(1)) > 1) & (F.max("n_shingles") > 0)).alias("__again"))
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__again")
    whole = docs.withColumn("__own", text_hash())
    whole = whole.join(stay, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")))
    once = whole.where("not __again").unionByName(whole.where("__again").dropDuplicates(["__id", "__hash"]))
    return once.select(docs.columns)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
