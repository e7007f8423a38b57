"""Secret scans over all historical versions, each blob scanned once for each version of the rules.

A version of a file is a blob, addressed by the SHA-256 of its content. A ledger holds a row for each blob and rule that was
scanned at a rule version. A scan takes only pairs of blob and rule version that the ledger does not have, gives the
findings and the rows to add to the ledger, and joins the findings back to every path with that blob. Which document of
equal ones is read is settled on addresses, so texts are shuffled once, by address and document, and copies of one blob are
spread over all tasks.

Only DataFrame functions run. Spans come from splitting a text at the matches and adding up lengths, in code points.

Defined cases: a null or empty text is the empty blob and holds nothing; a null doc_id comes back as null; repeated rows
come back alike, row by row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost matches that do not overlap are findings if they are long enough.

    group: of which the length counts, 0 for all; needs: text without which there is no match, in lower case."""

    name: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    fold: bool = False


#: The three base rules as agreed, then public formats of keys and tokens.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 2, 6, ("passw", "secret", "token", "api"), True),
    Rule("access", r"AKIA[A-Z0-9]+", 1, 0, 20, ("AKIA",)),
    Rule("hex", r"[0-9a-f]+", 1, 0, 24),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", 1, 0, 40, ("gh",)),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 1, 0, 15, ("xox",)),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1, 0, 30, ("eyJ",)),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 1, 0, 27, ("PRIVATE KEY",)),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind:int,start:int,end:int>>"
#: Matches that are added up in one go.
PART = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cut(rows: Column) -> Column:
    """An array in parts of PART at most. Adding to an array copies it, so long ones are made of short ones."""
    last = F.floor((F.size(rows) - 1) / PART).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(rows, k * PART + 1, F.lit(PART)))


def starts(parts: Column) -> Column:
    """Where in the text each part starts: the lengths of all before it."""
    size = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
    add = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(F.transform(parts, size), empty, add, lambda s: s["all"])


def spans(text: Column, rule: Rule, number: int) -> Column:
    """The findings of a rule as an array of structs (kind, start, end), in code points; in time that follows their number."""
    # Every run of the base rule for hex is as long as it can be, so short ones need not be listed to be dropped.
    pattern = rule.pattern[:-1] + f"{{{rule.least},}}" if rule.group == 0 and rule.pattern == "[0-9a-f]+" else rule.pattern
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counts = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else whole
    # The text is split one time more often than it is matched: the last row has no match.
    each = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), counts.alias("own"))
    none = F.array().cast(SPANS)

    def add(state, x):
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.array(F.struct(F.lit(number).alias("kind"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["own"]) >= rule.least, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    def within(part):
        return F.aggregate(part["rows"], F.struct(part["at"].alias("at"), none.alias("found")), add, lambda s: s["found"])

    found = bound(each, lambda rows: bound(cut(rows), lambda parts: F.flatten(F.transform(F.arrays_zip(parts.alias("rows"), starts(parts).alias("at")), within))))
    if not rule.needs:
        return F.when(text.rlike(pattern), found).otherwise(none)
    base = F.lower(text) if rule.fold else text
    likely = base.contains(rule.needs[0])
    for word in rule.needs[1:]:
        likely = likely | base.contains(word)
    return F.when(likely, found).otherwise(none)


def addressed(docs: DataFrame) -> DataFrame:
    """doc_id, text and blob, its address."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows, a written table: blob, rule, version and findings (structs of kind, start, end; kind is the rule's number).

    ledger: rows of earlier scans; their pairs of blob, rule and version are not scanned again."""
    own = addressed(docs)
    # Of equal blobs the one with the least doc_id is read; a null doc_id is the last choice.
    one = own.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    names = F.array(*[F.lit(i) for i in range(len(rules))])
    if ledger is None:
        todo = one.withColumn("open", names)
    else:
        current = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
        done = ledger.where(F.col("version") == F.try_element_at(current, F.col("rule"))).select("blob", "rule").distinct()
        numbers = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
        had = done.groupBy("blob").agg(F.collect_set(F.try_element_at(numbers, F.col("rule"))).alias("had"))
        todo = one.join(had, "blob", "left").select("blob", "doc_id", F.array_except(names, F.coalesce("had", F.array().cast("array<int>"))).alias("open")).where(F.size("open") > 0)
    same = (F.col("a.blob") == F.col("b.blob")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    unseen = own.alias("a").join(todo.hint("shuffle_hash").alias("b"), same).select("a.blob", "a.text", "b.open")
    none = F.array().cast(SPANS)
    found = [F.when(F.array_contains("open", i), spans(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    per_rule = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.col(f"f{i}").alias("findings"), F.array_contains("open", i).alias("done")) for i, r in enumerate(rules)])
    each = unseen.select("blob", "open", *[f.alias(f"f{i}") for i, f in enumerate(found)])
    return written(each.select("blob", F.inline(per_rule)).where("done").drop("done").dropDuplicates(["blob", "rule"]), "ledger")


def located(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and findings of each document: all findings of the current rule versions, by start and then by rule."""
    own = addressed(docs).select("doc_id", "blob")
    current = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
    fresh = ledger.where((F.size("findings") > 0) & (F.col("version") == F.try_element_at(current, F.col("rule"))))
    # A ledger to which a scan was appended twice holds its rows twice.
    every = fresh.select("blob", "rule", "findings").distinct().groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    by_start = F.array_sort(F.transform("findings", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return own.join(every, "blob", "left").select("doc_id", F.coalesce(by_start, F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("findings"))


def written_out(findings: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    new = scan(docs, ledger)
    found = located(docs, new if ledger is None else ledger.unionByName(new))
    base = F.filter("findings", lambda x: x["kind"] < len(BASE))
    kinds = F.transform("findings", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{name}") for i, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(written_out(base, RULES).cast("binary"), 256).alias("base_sha256"), written_out(F.col("findings"), RULES).alias("spans"))
