"""Secret scans with an incremental blob ledger.

Every version of every path (a row of the input) is content-addressed: its
blob is the SHA-256 of its text. The ledger holds the (blob, rule, version)
triples that have been scanned, the findings hold what they gave. ``scan`` takes
only blobs with a rule version the ledger lacks, one row of each however many
paths hold it, runs just the missing rules over the whole text, and joins the
findings of old and new scans back to all paths. Raising a rule's version
makes exactly that rule run again.

A finding is a span of code points, end exclusive. Spark gives all matches of a
pattern (``regexp_extract_all``) and all stretches between them (``split`` at
the same pattern); running lengths of both give the places. Only DataFrame
functions; a text is dealt out once, to the row that stands for its blob.

Defined cases: a null text is an empty one; a null id is a path of its own;
repeated rows share their blob and each gets its findings; a text without
findings has an empty list; an empty table gives empty ledgers and no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import staged, text_of


@dataclass(frozen=True)
class Rule:
    """``least``: fewest code points of the match, or of its ``group``, for it
    to count. Where a shorter match could hide a longer one behind it, the
    length is checked after matching, else the pattern has it."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: The base kinds in their order, then the rules this method adds.
#: A run of hex digits or key characters shorter than asked for cannot hide a
#: longer match, so their patterns carry the length.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
FINDING = "array<struct<start:long,kind_order:int,kind:string,end:long,version:int>>"


@dataclass
class Scan:
    ledger: DataFrame    # blob binary, rule string, version int
    findings: DataFrame  # blob binary, found FINDING: those of one rule
    by_path: DataFrame   # id, blob, found FINDING: of every row of the input, all rules


def spans(text: str, rule: Rule, order: int) -> Column:
    """The findings of one rule in a text column."""
    between = F.split(text, rule.pattern, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(FINDING).alias("got"))

    def add(s, pair):
        begin = s["at"] + F.length(pair["b"])
        end = begin + F.length(pair["m"])
        one = F.struct(begin.alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), end.alias("end"), F.lit(rule.version).alias("version"))
        long_enough = F.length(F.regexp_extract(pair["m"], rule.pattern, rule.group)) >= rule.least if rule.least > 1 else F.lit(True)
        return F.struct(end.alias("at"), F.when(long_enough, F.concat(s["got"], F.array(one))).otherwise(s["got"]).alias("got"))

    # the last stretch follows the last match: no pair
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pairs = F.zip_with(between, matches, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    return F.when(F.col(text).rlike(rule.pattern), F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), start, add)["got"])


def scan(docs: DataFrame, before: Scan | None = None, rules=BASE + ADDED, id_col: str = "doc_id", text_col: str = "text") -> Scan:
    """Scan what the ledger of ``before`` lacks; findings of every path in ``docs``."""
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths = staged(texts.select("id", "blob"), "secret-paths")
    heads = paths.groupBy("blob").agg(F.min("id").alias("head"))
    todo = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    pairs = heads.select("blob", "head", F.explode(todo).alias("r")).select("blob", "head", "r.rule", "r.version")
    if before is not None:
        pairs = pairs.join(before.ledger, ["blob", "rule", "version"], "left_anti")
    unseen = staged(pairs.groupBy("blob", "head").agg(F.sort_array(F.collect_set("rule")).alias("missing")), "secret-unseen")
    open_ = unseen.select(F.col("blob").alias("b"), "head", "missing").hint("shuffle_hash")  # the texts are not sorted
    one_each = texts.join(open_, (texts["blob"] == open_["b"]) & texts["id"].eqNullSafe(open_["head"])).select("blob", "text", "missing")
    found = one_each.select("blob", F.array(*[
        F.when(F.array_contains("missing", r.kind), spans("text", r, i)) for i, r in enumerate(rules)]).alias("f"))
    found = found.select("blob", F.explode("f").alias("found")).where("size(found) > 0")
    found = found.select("blob", "found").distinct()  # a row that repeats its id and text was scanned with it
    findings = staged(found, "secret-findings")
    ledger = unseen.select("blob", F.explode(F.filter(todo, lambda t: F.array_contains("missing", t["rule"]))).alias("r")).select("blob", "r.rule", "r.version")
    if before is not None:
        now = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
        old = before.findings.where(F.array_contains(now, F.concat(F.col("found")[0]["kind"], F.lit("@"), F.col("found")[0]["version"].cast("string"))))
        ledger, findings = staged(before.ledger.unionByName(ledger), "secret-ledger"), staged(old.unionByName(findings), "secret-findings")
    per_blob = findings.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    by_path = paths.join(per_blob, "blob", "left").select(
        F.col("id").alias(id_col), "blob", F.coalesce("found", F.array().cast(FINDING)).alias("found"))
    return Scan(ledger, findings, by_path)


def span_list(found: Column) -> Column:
    """kind:start:end of findings, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
