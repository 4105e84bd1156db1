"""Secret scans over a trigram inverted index, in DataFrame operations only.

1. ``trigram_query`` derives from a rule's regular expression a Boolean query over trigrams
   that every match must satisfy: an OR of ANDs, or None if nothing is mandatory.
2. ``build_index`` keeps, for each segment of ``SEGMENT`` consecutive identifiers, the list
   of documents that have each trigram of the rules' queries (case folded).  Lists are
   bounded by the segment, so no key gathers the corpus.
3. ``candidates`` intersects and unites the lists, segment by segment.
4. ``find_secrets`` verifies the rules on their candidates with the regular expressions;
   rules without a query are verified on every document.  Only documents that may be
   candidates are shuffled to meet their rules; the others stay where they are.  The index
   and its candidates are saved in the shared folder.

Spans count code points, the end exclusive.  A rule's matches are leftmost and do not
overlap; those whose part is shorter than the rule asks are dropped.

Null texts count as empty: no spans.  Rows with a null identifier are in no list and are
verified in full, where they are.  Repeated rows each keep their row.  The index is keyed by
identifier, so differing rows that share one are candidates together, which only adds
verifications.  Very long texts are searched whole.  An empty table gives no rows.  Other
columns pass through; those named like the results (``secrets``, ``kinds``) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, sifted

SEGMENT = 4096
#: Strings that an expression is taken to stand for before its trigrams are drawn.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of the match's group ``part``."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 0


# Kinds, patterns and lengths of the base, in the order of the kinds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # The runs of [0-9a-f]+ with 16 characters or more are the matches of this.
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@"),
)
RULES = BASE + MORE

Query = frozenset  # of clauses, each a frozenset of trigrams; a document must have all of one clause


def _all_of(strings: set[str]) -> Query | None:
    """Some string's trigrams must be there; None if a string is too short to have any."""
    if not strings or min(map(len, strings)) < 3:
        return None
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _least(q: Query) -> Query:
    """Without clauses that another clause implies."""
    return frozenset(c for c in q if not any(d < c for d in q))


def _and(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return b if a is None else a
    return _least(frozenset(c | d for c in a for d in b))


def _walk(nodes) -> tuple[set[str] | None, Query | None]:
    """For a sequence of parsed nodes: all strings it stands for (None: too many), and a query."""
    from re import _constants as c

    run: set[str] | None = {""}
    whole, query = True, None

    def flush() -> None:
        nonlocal run, whole, query
        query, run, whole = _and(query, _all_of(run)), {""}, False

    for op, arg in nodes:
        strings, own = None, None
        if op is c.LITERAL:
            strings = {chr(arg).lower()}
        elif op is c.IN and all(k is c.LITERAL for k, _ in arg):
            strings = {chr(v).lower() for _, v in arg}
        elif op is c.SUBPATTERN:
            strings, own = _walk(arg[3])
        elif op is c.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                each = [q if s is None else _all_of(s) for s, q in parts]
                own = None if None in each else _least(frozenset().union(*each))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, sub = arg
            strings, own = _walk(sub)
            if (low, high) == (0, 1) and strings is not None:
                strings = strings | {""}
            elif low == high and strings is not None and len(strings) ** low <= MOST_STRINGS:
                strings = {"".join(p) for p in _power(strings, low)}
            elif low == 0:
                strings, own = None, None
            else:
                own = own if strings is None else _all_of(strings)
                strings = None
        elif op is c.AT:
            continue
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        elif strings is not None:
            flush()
            run = strings
        else:
            flush()
            query = _and(query, own)
    if whole:
        return run, None
    flush()
    return None, query


def _power(strings: set[str], n: int) -> list[tuple[str, ...]]:
    return reduce(lambda out, _: [(*p, s) for p in out for s in strings], range(n), [()])


def trigram_query(pattern: str) -> Query | None:
    """A Boolean query, over trigrams of the case-folded text, that follows from a match."""
    from re import _parser

    strings, query = _walk(_parser.parse(pattern))
    return query if strings is None else _all_of(strings)


def _folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def build_index(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """segment, trigram, doc_ids (ascending): who has which of the trigrams."""
    return (
        docs.select(F.col(doc_id).alias("doc_id"), _folded(F.col(text)).alias("folded"))
        .where(F.col("doc_id").isNotNull())
        .select("doc_id", F.explode(F.array_compact(F.array(*(F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams)))).alias("trigram"))
        .groupBy(F.floor(F.col("doc_id") / SEGMENT).alias("segment"), "trigram")
        .agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    )


def _tagged(kind: str):
    return lambda d: F.struct(d.alias("doc_id"), F.lit(kind).alias("kind"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, kinds: the rules with a query that the document's trigrams satisfy."""
    lists = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "doc_ids"))).alias("lists"))
    none = F.array().cast("array<bigint>")
    found = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if query is None:
            continue
        clauses = []
        for clause in sorted(map(sorted, query)):
            posted = [F.coalesce(F.col("lists")[t], none) for t in clause]
            clauses.append(reduce(F.array_intersect, posted))
        found.append(F.transform(reduce(F.array_union, clauses), _tagged(rule.kind)))
    each = lists.select(F.explode(F.concat(*found)).alias("c")).select("c.doc_id", "c.kind")
    return each.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans as an array of structs: start, order, stop, kind."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.part)) if rule.part else whole
    # Matches and the gaps before them take turns; their lengths add up to positions.
    turns = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("whole"), part.alias("part"))
    kind = "array<struct<start:bigint,order:int,stop:bigint,kind:string>>"

    def step(acc: Column, turn: Column) -> Column:
        start = acc["at"] + F.length(turn["gap"])
        stop = start + F.coalesce(F.length(turn["whole"]), F.lit(0))
        own = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), stop.alias("stop"), F.lit(rule.kind).alias("kind")))
        keep = turn["whole"].isNotNull() & (F.length(turn["part"]) >= rule.least)
        return F.struct(stop.alias("at"), F.when(keep, F.concat(acc["out"], own)).otherwise(acc["out"]).cast(kind).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(turns, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(kind))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds ``secrets`` to every row: an array of (start, order, stop, kind), by start and
    then by the rules' order."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted(set().union(*(c for q in queries.values() if q for c in q)))
    docs = docs.drop(*({"secrets", "kinds"} & set(docs.columns)))
    body, none = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<struct<start:bigint,order:int,stop:bigint,kind:string>>")

    def verified(rows: DataFrame, able) -> DataFrame:
        """``able`` says of a rule with a query whether a row is to be verified."""
        found = [spans(body, r, i) if queries[r.kind] is None else F.when(able(r), spans(body, r, i)).otherwise(none) for i, r in enumerate(rules)]
        return rows.withColumn("secrets", F.array_sort(F.concat(*found)))

    if not trigrams:
        return verified(docs, lambda r: F.lit(True))
    work = Workspace(docs.sparkSession, "secrets")
    index = work.save(build_index(docs, trigrams, text=text), "index")
    able = work.save(candidates(index, rules), "candidates")
    may, no = sifted(docs, able.select("doc_id"), "doc_id")
    # A null identifier may share its hash with a candidate's, but it meets none in the join.
    here = verified(no.unionByName(may.where("doc_id is null")), lambda r: F.col("doc_id").isNull())
    met = verified(may.where("doc_id is not null").join(able, "doc_id", "left"), lambda r: F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)))
    return here.unionByName(met.drop("kinds"))


def digest_secrets(documents: DataFrame) -> DataFrame:
    """Counts and digest of the base's spans, and all spans as text."""
    found = find_secrets(documents.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["order"] < len(BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT row, {i} AS kind_order, {quoted(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(body, {quoted(r.pattern)}, 0) AS ms, regexp_extract_all(body, {quoted(r.pattern)}, {r.part}) AS ps, string_split_regex(body, {quoted(r.pattern)}) AS gs FROM docs"
        for i, r in enumerate(RULES)
    )
    shown = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = '{r.kind}'), 0)::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents),
found AS ({each}),
turns AS (SELECT row, kind_order, kind, least, unnest(ms) AS m, unnest(ps) AS p, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM found WHERE len(ms) > 0),
placed AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY row, kind_order ORDER BY i) AS stop FROM turns),
spans AS (SELECT row, kind_order, kind, stop::BIGINT AS stop, (stop - length(m))::BIGINT AS start FROM placed WHERE length(p) >= least)
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg({shown}, ',' ORDER BY start, kind_order) FILTER (WHERE kind_order < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg({shown}, ',' ORDER BY start, kind_order), '') AS spans
FROM docs d LEFT JOIN spans s ON s.row = d.row GROUP BY d.row, d.doc_id
"""


ORACLE = _oracle()
