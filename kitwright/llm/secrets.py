"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The
ledger lists which (blob, rule version) pairs have been scanned; a scan takes
only the pairs that are missing, so a blob that a thousand paths share is
scanned once, and after a rule changes only that rule runs again. Findings
belong to blobs and are joined back to all paths that hold them.

Findings count for a scan as long as the version of their rule is in use.
Those of blobs that no path holds any more are kept, and harm nothing, until
:func:`pruned` drops them.

Defined results: a null text is the empty text; equal texts share one blob and
each row gets the findings, repeated rows and repeated ids too; offsets count
code points, ends are exclusive; spans that tie go by kind as listed, then by
end; texts of any length are scanned whole; an empty table gives an empty
table. Extra columns are kept, but for those named like a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitwright.llm.common import batch, materialize


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns and least lengths of the base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)

FINDING = "blob string, rule string, kind string, span_start int, span_end int"


def blobs(versions: DataFrame, text_column: str = "text") -> DataFrame:
    """``versions`` with ``blob``, the SHA-256 of the content, in place of the text."""
    return versions.select(
        *[c for c in versions.columns if c not in (text_column, "blob")],
        F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256).alias("blob"),
    )


def _pairs(rules: tuple[Rule, ...]) -> F.Column:
    return F.explode(F.array(*[F.lit(r.key) for r in rules]))


def unseen(versions: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None, text_column: str = "text") -> DataFrame:
    """One row for each blob with work left: ``blob``, ``text`` and ``rules``, the keys of the rules to run."""
    content = F.coalesce(F.col(text_column), F.lit(""))
    # Duplicates go within each task first, so a blob that many paths share crosses the network once a task.
    one = versions.select(F.sha2(content, 256).alias("blob"), content.alias("text")).dropDuplicates(["blob"])
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return one.withColumn("rules", keys)
    done = ledger.groupBy("blob").agg(F.collect_set("rule").alias("done"))  # a few rules a blob
    left = F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))
    return one.join(done, "blob", "left").select("blob", "text", left.alias("rules")).filter(F.size("rules") > 0)


def scan(work: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of the rules that each row of :func:`unseen` asks for."""
    schema = pa.schema([("blob", pa.string()), ("rule", pa.string()), ("kind", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # [0-9a-f]+ of 24 or more is the run itself: the bound in the pattern spares a match a letter.
        compiled = [(r, re.compile(r.pattern.removesuffix("+") + f"{{{r.least},}}" if r.kind == "hex" else r.pattern)) for r in rules]
        for b in batches:
            out: list[tuple] = []
            for blob, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for r, pattern in compiled:
                    if r.key in wanted:
                        out += [(blob, r.key, r.kind, *m.span()) for m in pattern.finditer(text) if len(m[r.group]) >= r.least]
            yield batch(schema, list(zip(*out, strict=True)) if out else [[]] * 5)

    return work.select("blob", "text", "rules").mapInArrow(run, FINDING)


def update(versions: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The findings and the ledger after scanning what the ledger lacks: (findings, ledger)."""
    found = scan(unseen(versions, rules, ledger, text_column), rules)
    if findings is not None:
        found = findings.unionByName(found)
    seen = blobs(versions, text_column).select("blob").distinct().select("blob", _pairs(rules).alias("rule"))
    if ledger is not None:
        seen = ledger.select("blob", "rule").unionByName(seen).distinct()
    return found, seen


def pruned(versions: DataFrame, ledger: DataFrame, findings: DataFrame, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The findings and the ledger of blobs that ``versions`` still hold: (findings, ledger)."""
    present = blobs(versions, text_column).select("blob").distinct()
    return findings.join(present, "blob", "left_semi"), ledger.join(present, "blob", "left_semi")


def by_blob(findings: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """One row for each blob with findings: a count for each kind, and ``spans`` by start, then kind as listed."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    # A blob's findings lie in one text, which bounds the list.
    listed = F.sort_array(F.collect_list(F.struct("span_start", order[F.col("kind")].alias("at"), "span_end", "kind")))
    return findings.filter(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(
        *[F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules],
        F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["span_start"], s["span_end"])), ",").alias("spans"),
    )


def report(versions: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None, text_column: str = "text") -> DataFrame:
    """``versions`` without the text, with the counts and spans of their blobs (in place of columns of those names), after an :func:`update`."""
    found, _ = update(versions, rules, ledger, findings, text_column)
    return at_paths(versions, found, rules, text_column)


def at_paths(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, text_column: str = "text") -> DataFrame:
    """``versions`` without the text, with what ``findings`` has of their blobs."""
    versions = versions.drop("spans", *[f"n_{r.kind}" for r in rules])
    merged = materialize(by_blob(findings, rules))  # only blobs with findings
    return (
        blobs(versions, text_column)
        .join(merged, "blob", "left")
        .fillna(0, [f"n_{r.kind}" for r in rules])
        .fillna("", ["spans"])
    )
