"""Secrets by regular expressions, looked for only where a trigram index says they can be.

Each rule's expression is turned into a Boolean query over trigrams that any match must hold (after the letters A-Z are
lower-cased). The index keeps, for every trigram that some query names, the rows that hold it; a rule's candidates are the
rows found by intersecting postings, and only there the expression itself is tried. A rule whose expression demands no
trigram is tried on every row.

Null and empty texts have no spans. Equal rows get equal results; rows are told apart by id and text, so ids may repeat
or be null. A column name in the input other than the id's and the text's plays no part.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as sre, _parser

from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.llm.common import stored
from pulseloom.llm.spans import found, in_order, of_kind


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str                 # in the syntax that Java and Python share
    least: tuple[int, int] = (0, 0)  # a group and the characters it must have; others are dropped


# fixed values: the rules every scan has, in their order
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (1, 12)),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# fixed values: published forms of keys
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
)
EXACT_MOST = 16  # exact texts kept of a part of an expression before only its trigrams are kept

Query = frozenset[frozenset[str]]  # any of: all of these trigrams
ANYTHING: Query = frozenset([frozenset()])


def _and(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x in a for y in b))


def _or(a: Query, b: Query) -> Query:
    return _least(a | b)


def _least(query: Query) -> Query:
    """Without alternatives that another one, demanding less, covers."""
    return frozenset(x for x in query if not any(y < x for y in query))


def _of_texts(texts: set[str]) -> Query:
    grams = [frozenset(t[i:i + 3] for i in range(len(t) - 2)) for t in texts]
    return _least(frozenset(grams)) if grams else ANYTHING


def _parts(tokens) -> list[set[str] | None | Query]:
    """A sequence of exact texts (sets), queries, and None for what may be anything."""
    out: list = []
    for op, arg in tokens:
        if op is sre.LITERAL:
            out.append({chr(arg).lower()} if chr(arg).isascii() else None)
        elif op is sre.IN:
            chars = {chr(v).lower() for kind, v in arg if kind is sre.LITERAL and v < 128}
            single = all(kind is sre.LITERAL and v < 128 for kind, v in arg)
            out.append(chars if single and len(chars) <= 8 else None)
        elif op is sre.SUBPATTERN:
            out.append(_alternatives(_parts(arg[3])))
        elif op is sre.BRANCH:
            options = [_alternatives(_parts(p)) for p in arg[1]]
            if all(isinstance(o, set) for o in options) and sum(map(len, options)) <= EXACT_MOST:
                out.append(set().union(*options))
            else:
                query = frozenset()
                for o in options:
                    query = _or(query, _of_texts(o) if isinstance(o, set) else o)
                out.append(query)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner = _alternatives(_parts(body))
            if low == 0 and high == 1 and isinstance(inner, set):
                out.append(inner | {""})
            elif low == 0:
                out.append(None)
            elif low == high and isinstance(inner, set) and len(inner) == 1 and low <= 8:
                out.append({next(iter(inner)) * low})
            else:
                out += [None, _of_texts(inner) if isinstance(inner, set) else inner, None]
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        else:
            out.append(None)
    return out


def _alternatives(parts) -> set[str] | Query:
    """The exact texts of a sequence if it has few, else its query."""
    if all(isinstance(p, set) for p in parts):
        texts = {""}
        for p in parts:
            texts = {a + b for a, b in itertools.product(texts, p)}
            if len(texts) > EXACT_MOST:
                break
        else:
            return texts
    query, run = ANYTHING, {""}
    for part in [*parts, None]:
        joined = {a + b for a, b in itertools.product(run, part)} if isinstance(part, set) else None
        if joined is not None and len(joined) <= EXACT_MOST:
            run = joined
            continue
        query = _and(query, _of_texts(run))
        run = part if isinstance(part, set) and len(part) <= EXACT_MOST else {""}
        if isinstance(part, frozenset):
            query = _and(query, part)
    return query


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of any match must hold; ``ANYTHING`` if that is no trigram at all."""
    found_ = _alternatives(_parts(_parser.parse(pattern)))
    return _of_texts(found_) if isinstance(found_, set) else found_


def trigram_index(rows: DataFrame, trigrams: list[str], *, key: list[str], text_col: str) -> DataFrame:
    """Postings ``trigram, <key>`` of the given trigrams over all rows."""
    low = rows.select(*key, F.inline(F.array(F.struct(F.lower(text_col).alias("_low")))))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in trigrams]))
    return low.select(F.explode(held).alias("trigram"), *key)


def candidates(index: DataFrame, queries: dict[str, Query], *, key: list[str]) -> DataFrame:
    """``<key>, kinds``: for each row that any rule's query admits, those rules."""
    spark = index.sparkSession
    clauses = [(kind, n, g, len(grams)) for kind, query in queries.items() for n, grams in enumerate(sorted(map(sorted, query))) for g in grams]
    table = spark.createDataFrame(clauses, "kind string, clause int, trigram string, need int")
    # a few rows for each rule
    met = index.join(F.broadcast(table), "trigram").groupBy(*key, "kind", "clause", "need").agg(
        F.collect_set("trigram").alias("_held")).filter(F.size("_held") == F.col("need"))  # rows that repeat post twice
    return met.groupBy(*key).agg(F.collect_set("kind").alias("kinds"))


def rule_spans(text: Column, rule: Rule) -> Column:
    places = found(text, rule.pattern)
    group, least = rule.least
    if least:
        places = F.filter(places, lambda s: F.length(F.regexp_extract(s["value"], rule.pattern, group)) >= least)
    return of_kind(places, rule.kind)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, spans``: for each row all spans (``kind, start, end, value``), by start and then in the order of the rules."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    everywhere = [r for r in rules if queries[r.kind] == ANYTHING]
    indexed = [r for r in rules if queries[r.kind] != ANYTHING]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(id_col, text_col).alias("_key"))
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)")
    always = rows.select("_id", "_key", F.concat(empty, *[rule_spans(F.col("_text"), r) for r in everywhere]).alias("_always"))
    if not indexed:
        return always.select(F.col("_id").alias(id_col), in_order(F.col("_always"), [r.kind for r in rules], True).alias("spans"))
    grams = sorted({g for r in indexed for clause in queries[r.kind] for g in clause})
    index = stored(trigram_index(rows, grams, key=["_key"], text_col="_text"), "postings")
    possible = candidates(index, {r.kind: queries[r.kind] for r in indexed}, key=["_key"])
    tried = rows.filter(F.length("_text") > 0).join(possible, "_key").select("_id", "_key", F.concat(*[
        F.when(F.array_contains("kinds", r.kind), rule_spans(F.col("_text"), r)).otherwise(empty) for r in indexed]).alias("_spans"))
    tried = tried.filter(F.size("_spans") > 0).dropDuplicates(["_id", "_key"]).withColumnRenamed("_id", "_other")
    both = always.join(tried, (always["_key"] == tried["_key"]) & F.col("_id").eqNullSafe(F.col("_other")), "left")
    spans = F.concat("_always", F.coalesce("_spans", empty))
    return both.select(F.col("_id").alias(id_col), in_order(spans, [r.kind for r in rules], True).alias("spans"))
