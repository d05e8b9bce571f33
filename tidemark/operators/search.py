"""Full-text search: stored postings, BM25 ranking and a small query language, at any log position.

Postings carry the interval in which their document version lives, so one index answers as of every
position up to its watermark, and re-applying a document changes nothing. Stored postings are sorted by term,
so a query reads the pages of its own terms only; statistics come from one narrow row a document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.lsn import HEAD
from tidemark.schema import LSN, LSN_TO

K1, B = 1.2, 0.75
LONGEST = 40
SEPARATORS = r"[^\p{L}\p{N}]+"
DOTTED = "\u0130"


def tokens(text: Column, separators: str = SEPARATORS) -> Column:
    """Lower-case runs of letters and digits, those above 40 bytes dropped. The one letter whose lower case is a letter
    and a mark, which would end the word, becomes the letter alone."""
    lower = F.lower(F.replace(text, F.lit(DOTTED), F.lit("i")))
    return F.filter(F.split(lower, separators), lambda t: (t != "") & (F.octet_length(t) <= LONGEST))


def postings_of(words: Column) -> Column:
    """One (term, at) a different word of a row, at being its places. The words are sorted with their places and cut
    where a new one begins, all inside the row: grouping exploded words would sort the whole corpus' words."""
    pairs = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("place"))))

    def runs(s: Column) -> Column:
        every = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(every, lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]))
        run = lambda b, i, n: F.slice(s, i + 1, F.coalesce(F.get(b, n + 1), F.size(s)) - i)
        return _once(starts, lambda b: F.transform(b, lambda i, n: F.struct(F.get(s, i)["term"].alias("term"), run(b, i, n)["place"].alias("at"))))

    return _once(pairs, runs)


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, not at each place it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@dataclass(frozen=True)
class Index:
    """docs: key, __lsn, __lsn_to, <field>_len; postings: term, key, field, __lsn, __lsn_to, len, at (its places)."""

    docs: DataFrame
    postings: DataFrame
    fields: tuple[str, ...]

    def num_docs(self, lsn: int = HEAD - 1) -> DataFrame:
        return self.docs.where((F.col(LSN) <= lsn) & (F.col(LSN_TO) > lsn)).agg(F.count(F.lit(1)).alias("n"))


def key_text(key: tuple[str, ...] | list[str]) -> Column:
    """One text for a key; several columns are joined by the unit separator, as in search results."""
    return F.concat_ws("\x1f", *[F.col(k).cast("string") for k in key])


def synthetic_key(columns: list[str]) -> Column:
    """A key for rows of a table without one: equal rows of one position share it."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat(F.col(LSN).cast("string"), F.lit("-"), F.sha2(F.concat_ws("\x1f", *parts), 256))


def build_index(rows: DataFrame, key: Column, fields: list[str], separators: str = SEPARATORS, parts: int | None = None) -> Index:
    """Index versions (with __lsn and __lsn_to) or a state (with __lsn). A row's postings are made from that row
    alone; with ``parts`` the texts are first dealt by key into so many."""
    if LSN_TO not in rows.columns:
        rows = rows.withColumn(LSN_TO, F.lit(HEAD))
    plain = rows.select(key.cast("string").alias("key"), LSN, LSN_TO, *[F.col(f).cast("string").alias(f) for f in fields])
    words = [tokens(F.col(f), separators).alias(f) for f in fields]
    # A missing text has no length: the document counts, but not in the average.
    docs = plain.select("key", LSN, LSN_TO, *words).select("key", LSN, LSN_TO, *[F.array_size(f).alias(f"{f}_len") for f in fields])
    near = plain.where(F.col(LSN) < F.col(LSN_TO))
    near = (near.repartition(parts, "key") if parts else near).select("key", LSN, LSN_TO, *words)
    each = near.select("key", LSN, LSN_TO, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.array().cast("array<string>")).alias("words")) for f in fields])).alias("f"))
    named = each.select("key", LSN, LSN_TO, F.col("f.field").alias("field"), F.col("f.words").alias("words"))
    postings = named.select("key", LSN, LSN_TO, "field", F.size("words").alias("len"), F.explode(postings_of(F.col("words"))).alias("p"))
    return Index(docs, postings.select("key", LSN, LSN_TO, "field", "len", "p.term", "p.at"), tuple(fields))


# The query language


@dataclass(frozen=True)
class Clause:
    """Words in order (none: every document), or a group of clauses."""

    words: tuple[str, ...] = ()
    field: str | None = None
    must: bool = False
    must_not: bool = False
    boost: float = 1.0
    group: tuple[Clause, ...] = ()


def parse_query(query: str, fields: tuple[str, ...] = ()) -> list[Clause]:
    """Words (any of them), AND, OR, NOT, (groups), +must, -must_not, "a phrase", field:word, word^boost, * (all).

    OR splits a list into alternatives; AND marks both neighbours as required."""
    return _parse(query.strip(), 0, fields, False)[0]


def _parse(query: str, at: int, fields: tuple[str, ...], inside: bool) -> tuple[list[Clause], int]:
    lists: list[list[Clause]] = [[]]
    need = ban = split = False
    while at < len(query):
        if query[at].isspace():
            at += 1
            continue
        if query[at] == ")":
            if not inside:
                raise ValueError(f"cannot read the query at {query[at:]!r}")
            return _joined(lists, split), at + 1
        sign = query[at] if query[at] in "+-" and query[at + 1 : at + 2] == "(" else ""
        if query[at + len(sign)] == "(":
            group, at = _parse(query, at + len(sign) + 1, fields, True)
            if boost := re.match(r"\^([0-9.]+)", query[at:]):
                at += boost.end()
            if group:
                lists[-1].append(Clause((), None, need or sign == "+", ban or sign == "-", float(boost[1]) if boost else 1.0, tuple(group)))
            need = ban = False
            continue
        m = _WORD.match(query, at)
        if not m:
            raise ValueError(f"cannot read the query at {query[at:]!r}")
        at = m.end()
        operator, sign, name, phrase, term, boost = m.groups()
        if operator:
            if operator == "OR":
                lists.append([])
                split = True
            if operator == "AND":
                need = True
                if lists[-1] and not lists[-1][-1].must_not:
                    lists[-1][-1] = replace(lists[-1][-1], must=True)
            ban = ban or operator == "NOT"
            continue
        if name is not None and name not in fields:
            raise ValueError(f"unknown field {name!r}")
        if phrase is None and term != "*" and "*" in term:
            raise ValueError(f"words with a wildcard are not supported: {term!r}")
        words = tuple(w for w in re.split(r"[\W_]+", (phrase if phrase is not None else term).replace(DOTTED, "i").lower()) if w)
        if words or term == "*":
            lists[-1].append(Clause(words, name, need or sign == "+", ban or sign == "-", float(boost or 1)))
        need = ban = False
    if inside:
        raise ValueError("a group is not closed")
    return _joined(lists, split), at


_WORD = re.compile(r'(?:(AND|OR|NOT)\b(?=\s|\()|([+-])?(?:(\w+):)?(?:"([^"]*)"|([^\s"()]+?))(?:\^([0-9.]+))?(?=[\s()]|$))')


def _joined(lists: list[list[Clause]], split: bool) -> list[Clause]:
    if not split:
        return lists[0]
    return [x[0] if len(x) == 1 and not x[0].must_not else Clause(group=tuple(x)) for x in lists if x]


def _leaves(clauses: list[Clause] | tuple[Clause, ...]) -> list[Clause]:
    return [leaf for c in clauses for leaf in (_leaves(c.group) if c.group else [c])]


def search(index: Index, query: str, limit: int | None = None, lsn: int = HEAD - 1) -> DataFrame:
    """key, lsn and score of every document found as of a position, or of the ``limit`` best. Only the query's
    terms leave the postings."""
    clauses = parse_query(query, index.fields)
    leaves = _leaves(clauses)
    wanted = sorted({w for c in leaves for w in c.words})
    alive = (F.col(LSN) <= lsn) & (F.col(LSN_TO) > lsn)
    docs = index.docs.where(alive)
    hits = index.postings.where(alive & F.col("term").isin(wanted)).drop(LSN_TO).repartition("key")
    same = ["key", LSN, "field", "len", "term"]  # equal rows of a table without a key share one
    hits = hits.groupBy(*same).agg(F.flatten(F.collect_list("at")).alias("at"))
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), *[F.avg(f"{f}_len").alias(f"{f}_avg") for f in index.fields])
    counts = hits.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(F.broadcast(counts), ["term", "field"]).crossJoin(F.broadcast(stats))  # one row a term, and one
    average = F.coalesce(*[F.when(F.col("field") == f, F.col(f"{f}_avg")) for f in index.fields])
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.size("at")
    norm = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / average))
    scored = scored.withColumn("part", idf * norm)
    columns, wide = [], any(not c.words for c in leaves)
    for k, c in enumerate(leaves):
        here = F.col("term").isin(list(c.words)) & (F.col("field") == c.field if c.field else F.lit(True))
        columns.append(F.sum(F.when(here, F.col("part"))).alias(f"s{k}"))
        columns.append(F.coalesce(F.max(here), F.lit(False)).alias(f"h{k}"))
        if len(c.words) > 1:
            at = F.struct("field", "term", "at")
            columns.append(F.collect_list(F.when(here, at)).alias(f"p{k}"))
    found = scored.groupBy("key", LSN).agg(*(columns or [F.lit(0).alias("none")]))
    if wide:
        found = docs.select("key", LSN).join(found, ["key", LSN], "left")
    for k, c in enumerate(leaves):
        if not c.words:
            found = found.withColumns({f"h{k}": F.lit(True), f"s{k}": F.lit(1.0)})
        elif len(c.words) > 1:
            found = found.withColumn(f"h{k}", F.coalesce(F.col(f"h{k}") & _phrase(f"p{k}", c, index.fields), F.lit(False)))
        else:
            found = found.withColumn(f"h{k}", F.coalesce(f"h{k}", F.lit(False)))
    hit, total = _evaluate(clauses, iter(range(len(leaves))))
    best = found.where(hit).select("key", F.col(LSN).alias("lsn"), total.alias("score")).orderBy(F.desc("score"), "key")
    return best if limit is None else best.limit(limit)


def _places(column: str, field: str, word: str, behind: int) -> Column:
    """Where a phrase begins whose word ``behind`` this one would be."""
    mine = F.filter(column, lambda p: (p["field"] == field) & (p["term"] == word))
    return F.transform(F.flatten(F.transform(mine, lambda p: p["at"])), lambda x: x - F.lit(behind))


def _phrase(column: str, clause: Clause, fields: tuple[str, ...]) -> Column:
    """Whether some place of the first word has the others right behind it, in one field."""
    out = F.lit(False)
    for f in fields:
        if clause.field not in (None, f):
            continue
        starts = _places(column, f, clause.words[0], 0)
        for n, word in enumerate(clause.words[1:], 1):
            starts = F.array_intersect(starts, _places(column, f, word, n))
        out = out | (F.size(starts) > 0)
    return out


def _evaluate(clauses, numbers) -> tuple[Column, Column]:
    """Whether a list of clauses matches, and its score."""
    must, must_not, any_of, total = [], [], [], F.lit(0.0)
    for c in clauses:
        if c.group:
            hit, score = _evaluate(c.group, numbers)
        else:
            k = next(numbers)
            hit, score = F.col(f"h{k}"), F.coalesce(F.col(f"s{k}"), F.lit(0.0))
        (must_not if c.must_not else must if c.must else any_of).append(hit)
        if not c.must_not:
            total = total + F.when(hit, score * c.boost).otherwise(0.0)
    out = F.lit(bool(must))
    if not must:
        for hit in any_of:
            out = out | hit
    for hit in must:
        out = out & hit
    for hit in must_not:
        out = out & ~hit
    return out, total
