r"""Secret scans by a trigram inverted index; DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived (every match must contain them). The
postings (trigram, document) of just those trigrams are built from the lower-cased texts and intersected for each
document; the documents that satisfy a rule's query are its candidates, and the regular expression then verifies them.
Rules without a mandatory trigram (``hex``) scan every text.

Positions count code points, end exclusive. A null or empty text has no spans; documents keep one row each, repeated
rows too. Extra columns are ignored. A text may hold any character: the two control characters used as marks inside
the scan are exchanged for one that no rule can match.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression; group, least: matches whose group is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


#: The three base rules, then the rules that the method adds.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35,}", base=False),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{20,}", base=False),
)


def _literal(item) -> str | None:
    """The lower-case letter that an element of a parsed expression stands for, if there is only one."""
    op, arg = item
    if op is sre.LITERAL:
        return chr(arg).lower()
    if op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len({chr(v).lower() for _, v in arg}) == 1:
        return chr(arg[0][1]).lower()
    return None


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Alternatives, of which one must hold, each a set of trigrams that must all occur; an empty set: no condition."""

    def alternatives(items) -> list[list[str]]:
        """Each alternative: the literal runs in it."""
        ways: list[list[str]] = [[""]]
        for item in items:
            op, arg = item
            if (c := _literal(item)) is not None:
                ways = [[*w[:-1], w[-1] + c] for w in ways]
                continue
            if op is sre.SUBPATTERN:
                inner = alternatives(arg[3])
            elif op is sre.BRANCH:
                inner = [w for b in arg[1] for w in alternatives(b)]
            elif op is sre.MAX_REPEAT and arg[0] > 0 and _literal(arg[2][0]) is not None and len(arg[2]) == 1:
                inner = [[_literal(arg[2][0]) * min(arg[0], 8), ""]]
            else:
                inner = [["", ""]]
            ways = [[*w[:-1], w[-1] + i[0], *i[1:]] for w in ways for i in inner]
        return ways

    return frozenset(frozenset(r[k : k + 3] for r in runs for k in range(len(r) - 2)) for runs in alternatives(_parser.parse(pattern)))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for the given trigrams: an inverted index of the lower-cased texts."""
    low = docs.select("doc_id", F.lower(text_of()).alias("low"))
    return low.select(F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))).alias("trigram"), "doc_id")


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, kind's place, end) of the verified matches of a rule."""
    place = RULES.index(rule) if rule in RULES else len(RULES)
    clean = F.translate(text, "\u0001", "\u0002")
    marked = F.regexp_replace(F.translate(clean, "\u0002", "\u0003"), rule.pattern, "\u0001$0\u0001")
    ends = F.aggregate(
        F.split(marked, "\u0001", -1),
        F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<start:int,place:int,end:int>>").alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x)).alias("at"),
            (~acc["hit"]).alias("hit"),
            F.when(acc["hit"] & (F.char_length(F.regexp_extract(x, rule.pattern, rule.group)) >= rule.least), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), F.lit(place).alias("place"), (acc["at"] + F.char_length(x)).alias("end"))))).otherwise(acc["found"]).alias("found"),
        ),
    )
    return ends["found"]


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, found (array of start, place, end, kind, base in order of start, then kind)."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [r for r in rules if all(queries[r.kind])]
    trigrams = sorted({t for r in indexed for way in queries[r.kind] for t in way})
    scanned = docs.select("doc_id", text_of().alias("text"))
    if trigrams:
        held = postings(docs, trigrams).groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))  # at most len(trigrams) of them
        tests = {r.kind: reduce(Column.__or__, (reduce(Column.__and__, (F.array_contains("held", t) for t in sorted(way))) for way in sorted(queries[r.kind], key=sorted))) for r in indexed}
        candidates = held.select("doc_id", *[v.alias(f"may_{k}") for k, v in tests.items()]).filter(reduce(Column.__or__, (F.col(f"may_{k}") for k in tests)))
        scanned = scanned.join(candidates, "doc_id", "left")
    none = F.array().cast("array<struct<start:int,place:int,end:int>>")
    each = [F.when((F.col(f"may_{r.kind}") if r in indexed else F.lit(True)) & F.col("text").rlike(r.pattern), _spans(F.col("text"), r)).otherwise(none) for r in rules]
    kinds, base = F.array(*[F.lit(r.kind) for r in RULES]), F.array(*[F.lit(r.base) for r in RULES])
    found = F.transform(F.array_sort(F.concat(*each)), lambda s: F.struct(s["start"], s["place"], s["end"], F.get(kinds, s["place"]).alias("kind"), F.get(base, s["place"]).alias("base")))
    return scanned.select("doc_id", found.alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The spans as counts, a hash of the base ones and text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
