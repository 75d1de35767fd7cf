"""Secret scans through a ledger of content, in DataFrame operations alone.

Every version of a document is named by the SHA-256 of its text.  The ledger
holds, for each content and version of a rule, the spans found; a scan reads
only contents that some rule version has not seen yet, once each however many
paths and versions hold them, and joins findings back to all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.llm.rows import shield
from gustline.llm.staging import Staging


@dataclass(frozen=True)
class Rule:
    """A pattern (Java syntax); matches go from left to right without overlap, then those of too few characters go."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    """The group whose length counts."""


#: Kinds in the order of the listing, their patterns and least lengths.
RULES = [
    Rule(
        "assign",
        1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 24),  # runs are taken whole, so shorter ones may be passed over at once
]

LEDGER_SCHEMA = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Spans [start, end) in code points of the rule's matches that are long enough.

    What lies between matches is what the text splits into, so positions are sums of lengths.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(
        F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))),
        F.arrays_zip(whole.alias("whole"), counted.alias("counted")),
        lambda gap, m: F.struct(
            F.length(gap).alias("gap"),
            F.length(m["whole"]).alias("size"),
            (F.length(m["counted"]) >= rule.least).alias("good"),
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(state: Column, s: Column) -> Column:
        start = state["at"] + s["gap"]
        end = start + s["size"]
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"), F.when(s["good"], F.concat(state["found"], span)).otherwise(state["found"]).alias("found")
        )

    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda s: s["found"])
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def contents(versions: DataFrame) -> DataFrame:
    """``versions`` with the name of its content in _blob; null counts as empty."""
    return versions.withColumn("_blob", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: list[Rule], staging: Staging) -> DataFrame:
    """New ledger rows: every content of ``versions`` under every rule version that the ledger hasn't."""
    named = contents(versions.select("text"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    unseen = (
        named.select(F.col("_blob").alias("blob"))
        .distinct()
        .select("blob", F.explode(wanted).alias("rule"))
        .select("blob", "rule.kind", "rule.version")
        .join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    )
    todo = unseen.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("_todo"))
    texts = named.select(F.col("_blob").alias("blob"), F.coalesce("text", F.lit("")).alias("_text"))
    once = texts.dropDuplicates(["blob"]).join(todo, "blob")
    cells = F.array(
        *[
            F.when(
                F.array_contains("_todo", f"{r.kind}:{r.version}"),
                F.struct(
                    F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("_text"), r).alias("spans")
                ),
            )
            for r in rules
        ]
    )
    rows = once.select("blob", F.explode(cells).alias("cell")).filter("cell is not null")
    return staging.table(rows.select("blob", "cell.kind", "cell.version", "cell.spans"), "scanned")


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def scan_versions(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: list[Rule] | None = None,
    staging: Staging | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``versions``, and the ledger with what this scan added.

    Reads ``text`` and keeps the other columns, of any name but ``found``.  Findings have ``found``, an array of
    (kind, start, end) by start, then kind in the order of the rules; empty where there are none.  A null text is an empty one.  Repeated rows and equal texts share one scan, and each row has its findings.
    Only the newest version of a rule in ``rules`` reports; the ledger keeps the others.  An empty table has no
    findings and adds nothing.
    """
    rules = RULES if rules is None else rules
    spark = versions.sparkSession
    ledger = empty_ledger(spark) if ledger is None else ledger
    fresh = scan_unseen(versions, ledger, rules, staging or Staging(spark))
    grown = ledger.unionByName(fresh)
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (f"{r.kind}:{r.version}", i)])
    listed = F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), F.col("_rank"), s["end"].alias("end"), F.col("kind"))
    )
    hits = (
        grown.withColumn("_rank", F.element_at(rank, F.concat_ws(":", "kind", "version")))
        .filter("_rank is not null and size(spans) > 0")
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list(listed))).alias("_hits"))
    )
    found = F.transform(
        F.coalesce("_hits", F.array().cast("array<struct<start:int,_rank:int,end:int,kind:string>>")),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    own, restore = shield(versions.drop("found"), "text")
    named = contents(own).drop("text")
    back = named.join(hits, named["_blob"] == hits["blob"], "left")
    kept = [c for c, name in zip(restore, versions.drop("found").columns) if name != "text"]
    return back.select(*kept, found.alias("found")), grown


def listing(found: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
