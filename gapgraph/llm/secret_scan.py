"""Secret scan over a trigram inverted index (DataFrame functions only)."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gapgraph.llm.common import Stages, compact, part_count

#: Alternatives followed at once while a regular expression is read; beyond it the strings so far become a query.
MAX_STRINGS = 64
#: Members of a character class that are told apart.
MAX_CLASS = 8
#: Candidates up to which their list is broadcast (some 50 bytes each).
BROADCAST_ROWS = 1 << 17


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` must mean the same in Java and RE2; a group in it is the value, of ``min_value`` characters or more."""

    kind: str
    pattern: str
    min_value: int = 0


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
# A run of one class is matched whole, so a minimum length inside the pattern drops the same runs as a test after it.
BASE_RULES = (
    Rule("assign", rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

Query = frozenset  # of frozensets of trigrams: one of them must be there whole; {frozenset()} is no condition
ALL: Query = frozenset({frozenset()})


def _absorb(query) -> Query:
    return frozenset(a for a in query if not any(b < a for b in query))


def _and(a: Query, b: Query) -> Query:
    return _absorb({x | y for x in a for y in b})


def _strings(items) -> set[str] | None:
    """All lower-case strings that a sequence can match, or None if they are too many."""
    found = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            one = {chr(arg).lower()}
        elif op is sre.IN and all(k in (sre.LITERAL, sre.RANGE) for k, _ in arg):
            chars = {chr(c).lower() for k, v in arg for c in ([v] if k is sre.LITERAL else range(v[0], min(v[1], v[0] + 99) + 1))}
            one = chars if len(chars) <= MAX_CLASS else None
        elif op is sre.SUBPATTERN:
            one = _strings(arg[3])
        elif op is sre.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            one = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 3:
            inner, one = _strings(arg[2]), None
            if inner is not None:
                one, power = set(), {""}
                for n in range(int(arg[1]) + 1):
                    one |= power if n >= arg[0] else set()
                    power = {a + b for a in power for b in inner}
        else:
            one = None
        if one is None or len(found) * len(one) > MAX_STRINGS:
            return None
        found = {a + b for a in found for b in one}
    return found


def _query(items) -> Query:
    def of(strings: set[str]) -> Query:
        if min(map(len, strings)) < 3:
            return ALL
        return _absorb({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})

    out, run = ALL, {""}
    for item in items:
        op, arg = item
        one = _strings([item])
        if one is not None and len(run) * len(one) <= MAX_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        out, run = _and(out, of(run)), {""}
        if one is not None:
            run = one
        elif op is sre.SUBPATTERN:
            out = _and(out, _query(arg[3]))
        elif op is sre.BRANCH:
            out = _and(out, _absorb(set().union(*(_query(x) for x in arg[1]))))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            out = _and(out, _query(arg[2]))
    return _and(out, of(run))


def trigram_query(pattern: str) -> Query:
    """The trigrams that a lower-cased text must hold for ``pattern`` to match in it, as a disjunction of conjunctions."""
    return _query(list(parser.parse(pattern)))


def _conjunctions(rules) -> list[tuple[str, int, list[str]]]:
    """(rule, number, trigrams) of each conjunction of the rules' queries; rules without a query have none."""
    return [(r.kind, i, sorted(part)) for r in rules if (query := trigram_query(r.pattern)) != ALL for i, part in enumerate(sorted(query, key=sorted))]


def postings(rows: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index (trigram, doc_id, text_hash) of rows (doc_id, text_hash, text), for the trigrams of some query."""
    wanted = sorted({t for _, _, part in _conjunctions(rules) for t in part})
    low = rows.select("doc_id", "text_hash", F.lower("text").alias("low"))
    there = F.filter(F.array(*map(F.lit, wanted)).cast("array<string>"), lambda t: F.contains(F.col("low"), t))
    return low.select(F.explode(there).alias("trigram"), "doc_id", "text_hash")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, text_hash, rules): for each text, the rules whose query its postings meet.

    The postings of a conjunction's trigrams are intersected by counting those that meet in a document.
    """
    asked = [(t, kind, i, len(part)) for kind, i, part in _conjunctions(rules) for t in part]
    queries = index.sparkSession.createDataFrame(asked, "trigram string, rule string, part int, need int")
    met = index.distinct().join(F.broadcast(queries), "trigram").groupBy("doc_id", "text_hash", "rule", "part", "need").agg(F.count(F.lit(1)).alias("n")).filter("n >= need")
    return met.groupBy("doc_id", "text_hash").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the leftmost non-overlapping matches, in code points.

    Each match is found together with the text before it, anchored where the last one ended, so
    that positions add up and a text is read once.
    """
    pattern = rf"\G((?s:.*?))({rule.pattern})"
    part = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in ((1, 2, 3) if rule.min_value else (1, 2))]
    spans = "array<struct<start:int,end:int>>"
    found = F.arrays_zip(*(p.alias(f"g{i}") for i, p in enumerate(part, 1)))

    def step(acc, x):
        start = acc["at"] + F.length(x["g1"])
        end = start + F.length(x["g2"])
        span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        keep = F.when(F.length(x["g3"]) >= rule.min_value, F.concat(acc["out"], span)).otherwise(acc["out"]) if rule.min_value else F.concat(acc["out"], span)
        return F.struct(end.cast("int").alias("at"), keep.alias("out"))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out")), step, lambda a: a["out"])


def scan_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, matches): per row the matches array<struct<start, ord, end, kind>> by start, then rule order.

    Rules with mandatory trigrams are verified only where the index names the text; the others
    scan every text. The index can name too many texts, never too few: case is folded. Its postings are
    keyed by id and text, so rows of one id, null included, don't meet unless they are repeats. While
    the index names few texts (counted), their list is broadcast; beyond that, texts that hold the trigrams
    of some query are joined with the rules that name them. All others stay where they are read. A null text is empty; repeated rows give a row each; an empty table gives none; other
    columns are not read.
    """
    rows = compact(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))).withColumn("text_hash", F.xxhash64("text"))
    indexed = [r for r in rules if trigram_query(r.pattern) != ALL]
    if not indexed:
        return _matches(rows, F.array().cast("array<string>"), rules)
    stages = Stages(docs.sparkSession, "trigrams")
    index = stages.write(postings(rows, rules), "postings")
    named = stages.write(candidates(index, rules).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "rules"), "candidates", part_count(docs))
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    no_rules = F.array().cast("array<string>")
    if named.count() <= broadcast_rows:
        return _matches(rows.join(F.broadcast(named), match, "left"), F.coalesce("rules", no_rules), rules)

    def some(low: Column) -> Column:
        any_ = F.lit(False)
        for _, _, part in _conjunctions(rules):
            every = F.lit(True)
            for t in part:
                every = every & F.contains(low, F.lit(t))
            any_ = any_ | every
        return any_

    # in a lambda, so that the text is lowered once
    met = F.exists(F.array(F.lower("text")), some)
    return _matches(rows.filter(~met), no_rules, rules).unionByName(_matches(rows.filter(met).join(named, match), F.col("rules"), rules))


def _matches(rows: DataFrame, named: Column, rules) -> DataFrame:
    """(doc_id, matches) of rows (doc_id, text): of the rules in ``named``, and of those without a query."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    cols = []
    for r in rules:
        here = F.array_contains(named, r.kind) if trigram_query(r.pattern) != ALL else F.col("text").rlike(r.pattern)
        cols.append(F.when(here, _spans(F.col("text"), r)).otherwise(none).alias(f"_s_{r.kind}"))
    rows = rows.select("doc_id", *cols)

    def labelled(order: int, kind: str) -> Column:
        return F.transform(f"_s_{kind}", lambda x: F.struct(x.start.alias("start"), F.lit(order).alias("ord"), x.end.alias("end"), F.lit(kind).alias("kind")))

    every = F.concat(*(labelled(i, r.kind) for i, r in enumerate(rules)))
    return rows.select("doc_id", F.sort_array(every).alias("matches"))


def secret_digest(matches: DataFrame) -> DataFrame:
    """The per-document counts, the checksum of the base spans and all spans as text."""

    def joined(arr: Column) -> Column:
        return F.array_join(F.transform(arr, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("matches", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("matches", lambda x: x.ord < len(BASE_RULES))
    counts = [count(r.kind) for r in BASE_RULES]
    return matches.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("matches")).alias("spans"))
