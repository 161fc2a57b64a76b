"""Secret scan with an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its content. The ledger is a folder of two tables: the
(blob, rule, version) triples that have been scanned, and the findings. A scan takes only the triples that the ledger
lacks, reads one copy of each such blob, appends, and joins the findings of all versions back to every path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table
from tidemill.session import cut_lineage, scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern with flags, the group whose length counts, its least length, and the rule's version."""

    name: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0
    version: int = 1
    base: bool = True
    hint: str = ""


#: Base kinds in the order of the contract, then those that the method adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         re.ASCII | re.IGNORECASE, 2, 12),
    # AKIA[A-Z0-9]+ of 18 or more; a shorter run has no longer match inside.
    Rule("access", r"AKIA[A-Z0-9]{14,}", hint="AKIA"),
    # [0-9a-f]+ of 16 or more.
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", base=False, hint="-----BEGIN"),
    Rule("jwt", r"(?<![\w-])eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}", base=False, hint="eyJ"),
    Rule("forge_token", r"(?<!\w)gh[opsur]_[A-Za-z0-9]{36,}", base=False, hint="gh"),
    Rule("chat_token", r"(?<!\w)xox[abprs]-[A-Za-z0-9-]{20,}", base=False, hint="xox"),
)

FOUND = "array<struct<start:int,end:int,rule:string>>"


def find(text: str, rules: list[Rule]) -> list[tuple[int, int, str]]:
    """Spans of all rules by start, then in the order of the rules."""
    out = []
    for place, rule in enumerate(rules):
        if rule.hint and rule.hint not in text:
            continue
        for m in re.compile(rule.pattern, rule.flags).finditer(text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), place, m.end(), rule.name))
    return [(start, end, name) for start, _, end, name in sorted(out)]


def _scanner(rules: list[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for names, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                wanted = set(names)
                found.append([{"start": a, "end": b, "rule": r} for a, b, r in find(
                    text.as_py(), [x for x in rules if x.name in wanted])])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)],
                                             names=["blob", "rules", "found"])

    return run


class Ledger:
    """The scanned triples and the findings, under one folder that all executors share."""

    SEEN = "blob string, rule string, version int"
    FOUND = "blob string, rule string, version int, start int, end int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("seen", self.SEEN), ("found", self.FOUND)):
            # An append of no rows makes the table readable from the start.
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def seen(self) -> DataFrame:
        """A triple written twice counts once."""
        return self._read("seen", self.SEEN)

    def findings(self) -> DataFrame:
        return self._read("found", self.FOUND).distinct()

    def append(self, scanned: DataFrame, rules: tuple[Rule, ...]) -> None:
        """``scanned``: (blob, rules, found). Findings go first: a triple is seen only once its findings are there."""
        version = F.create_map(*(x for r in rules for x in (F.lit(r.name), F.lit(r.version))))
        one = scanned.filter(F.size("found") > 0).select("blob", F.explode("found").alias("f")).select(
            "blob", "f.rule", F.element_at(version, F.col("f.rule")).alias("version"), "f.start", "f.end")
        one.write.mode("append").parquet(f"{self.path}/found")
        done = scanned.select("blob", F.explode("rules").alias("rule")).withColumn(
            "version", F.element_at(version, F.col("rule")))
        done.write.mode("append").parquet(f"{self.path}/seen")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _address() -> Column:
    return F.sha2(_text(), 256)


def unseen(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...], id_column: str = "doc_id") -> DataFrame:
    """(blob, rules, text): each blob that lacks a scan by some rule of this version, from the path of smallest id.

    Only addresses are compared with the ledger. Texts are joined to what is left by address and id, so the copies of one
    text do not meet, and no text moves when little is new.
    """
    wanted = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    known = ledger.seen().groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("known"))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), _address().alias("blob"), _text().alias("text"))
    owners = rows.groupBy("blob").agg(F.min(F.struct(F.col("id").isNull(), "id")).alias("owner"))
    lacking = F.array_except(wanted, F.coalesce(F.col("known"), F.array().cast(
        "array<struct<rule:string,version:int>>")))
    todo = owners.join(known, "blob", "left").select(
        F.col("blob").alias("b"), F.col("owner.id").alias("i"), lacking["rule"].alias("rules")).filter(F.size("rules") > 0)
    return rows.join(todo, (F.col("blob") == F.col("b")) & F.col("id").eqNullSafe(F.col("i"))).select("blob", "rules", "text")


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``blob`` and ``found``, the spans of ``rules`` by start and then in the order of the rules.

    Null text counts as empty; copies share a blob, which is scanned once (rows that repeat the id too may be scanned again,
    and count once); an empty table gives an empty result. Columns of ``docs`` named blob or found give way to the results.
    """
    schema = f"blob string, rules array<string>, found {FOUND}"
    scanned = cut_lineage(unseen(docs, ledger, rules, id_column).mapInArrow(_scanner(list(rules)), schema), "scanned")
    ledger.append(scanned, rules)
    place = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))))
    now = F.create_map(*(x for r in rules for x in (F.lit(r.name), F.lit(r.version))))
    current = ledger.findings().filter(F.col("version") == F.try_element_at(now, F.col("rule")))
    by_blob = current.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.element_at(place, F.col("rule")).alias("place"), "end", "rule"))).alias("found"))
    spans = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rule"].alias("rule")))
    paths = docs.drop("blob", "found").withColumn("blob", _address())
    return paths.join(by_blob, "blob", "left").select(
        *(F.col(f"`{c}`") for c in paths.columns), F.coalesce(spans, F.array().cast(FOUND)).alias("found"))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan: an empty ledger in a new folder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, Ledger(spark, scratch_path(spark, "ledger"))).drop("text")
    base = [r.name for r in RULES if r.base]
    by_base = F.filter("found", lambda x: x["rule"].isin(base))
    rules = F.col("found")["rule"]
    counts = [(F.size(rules) - F.size(F.array_remove(rules, r))).cast("long").alias(f"n_{r}") for r in base]
    return found.select("doc_id", *counts, F.sha2(_listed(by_base), 256).alias("base_sha256"),
                        _listed(F.col("found")).alias("spans"))
