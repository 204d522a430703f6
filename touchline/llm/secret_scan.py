"""Secret scanning over a ledger of content-addressed blobs.

Every version of every file is named by the SHA-256 of its content. The ledger holds one row for
each pair of a blob and a rule version that was scanned, with its findings. A scan reads
only pairs that the ledger lacks, appends them, and joins all findings back to every path
and version that holds the blob.

The ledger is a folder of Parquet files; each scan adds a subfolder and never changes old ones.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bound_batches, free_name, shared_files, slices

BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the length that group ``group`` of a match must have.

    Raise ``version`` with every change of a rule, so that old blobs are scanned again for it.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


#: The order is that of findings with equal starts. Letters of key words count in either case.
#: Where a match is one run of a class, its least length stands in the pattern: a shorter run
#: holds no longer one, so this equals taking all runs and dropping the short ones.
RULES = (
    Rule("assign", 1, "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, "[0-9a-f]{32,}"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", 1, "AIza[A-Za-z0-9_-]{35,}"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{15,}"),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
    Rule("key_block", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\x20\\x09-\\x0D]*"),
)
BASE_KINDS = ("assign", "access", "hex")
FINDING = "array<struct<kind: string, start: int, end: int>>"
LEDGER = f"blob string, kind string, version int, found {FINDING}"


@lru_cache(maxsize=64)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


def matches(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, without those whose group is too short; end exclusive."""
    return [
        match.span()
        for match in _compiled(rule.pattern).finditer(text)
        if len(match.group(rule.group)) >= rule.least
    ]


def span_text(findings: Column) -> Column:
    """kind:start:end of every finding, comma-joined."""
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ","
    )


def in_order(findings: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Findings by start, then by the order of the rules."""
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))
    keyed = F.transform(
        findings, lambda f: F.struct(f["start"].alias("start"), F.array_position(kinds, f["kind"]).alias("at"), f.alias("f"))
    )
    return F.transform(F.sort_array(keyed), lambda k: k["f"])


def _has_ledger(ledger: str) -> bool:
    files, folder = shared_files(ledger)
    return any(entry.base_name.startswith("run=") for entry in files.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)))


def scan(docs: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``blob`` (SHA-256 of the text) and ``findings`` to every row; all other columns stay.

    ``docs`` has a row per path and version, in any number of columns; a version is a row of
    its own. ``ledger`` is a folder in the shared store; it may not exist yet. Rows with equal
    texts share one scan. A null text is an empty one. Findings come in order of start, then
    of rule, as code points with exclusive end; a row without findings has an empty array.
    Repeated rows each keep their findings; an empty table gives an empty result. Columns
    named blob or findings are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    df = docs.drop(*(name for name in ("blob", "findings") if name != text))
    body = free_name(df, "scan_body")
    named = df.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    blobs = (
        df.select(F.coalesce(F.col(text), F.lit("")).alias(body))
        .select(F.sha2(F.col(body).cast("binary"), 256).alias("blob"), body)
        .filter(F.col(body) != "")
        .dropDuplicates(["blob"])
    )
    versions = [(rule.kind, rule.version) for rule in rules]
    wanted = F.broadcast(spark.createDataFrame(versions, "kind string, version int"))
    if _has_ledger(ledger):
        known = spark.read.schema(LEDGER).parquet(ledger).join(wanted, ["kind", "version"], "left_semi")
        seen = known.groupBy("blob").agg(F.collect_set("kind").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").filter(
            F.coalesce(F.size("seen"), F.lit(0)) < len(rules)
        )
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body, BATCH_BYTES):
            out: list[tuple] = []
            columns = (batch.column(name).to_pylist() for name in ("blob", body, "seen"))
            for blob, whole, seen in zip(*columns):
                for rule in rules:
                    if seen is None or rule.kind not in seen:
                        found = [{"kind": rule.kind, "start": a, "end": b} for a, b in matches(whole, rule)]
                        out.append((blob, rule.kind, rule.version, found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row[0] for row in out], pa.string()),
                    pa.array([row[1] for row in out], pa.string()),
                    pa.array([row[2] for row in out], pa.int32()),
                    pa.array([row[3] for row in out], _ARROW_FINDINGS),
                ],
                ["blob", "kind", "version", "found"],
            )

    scanned = blobs.select("blob", body, "seen").mapInArrow(
        search, LEDGER
    )
    scanned.write.parquet(f"{ledger}/run={uuid.uuid4().hex}")
    found = (
        spark.read.schema(LEDGER).parquet(ledger)
        .filter(F.size("found") > 0)
        .join(wanted, ["kind", "version"], "left_semi")
        .dropDuplicates(["blob", "kind"])
        .groupBy("blob")
        .agg(F.flatten(F.collect_list("found")).alias("findings"))
    )
    empty = F.array().cast(FINDING)
    return named.join(found, "blob", "left").withColumn(
        "findings", F.coalesce(in_order(F.col("findings"), rules), empty)
    )


_ARROW_FINDINGS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
)


def redact(docs: DataFrame, text: str = "text", findings: str = "findings") -> DataFrame:
    """Replace every finding by ``[kind]``; overlapping findings become one, named by the first."""
    whole = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    folded = F.aggregate(
        F.col(findings),
        start,
        lambda state, f: F.struct(
            F.when(
                f["start"] >= state["at"],
                F.concat(
                    state["done"],
                    F.substring(whole, state["at"] + 1, f["start"] - state["at"]),
                    F.lit("["), f["kind"], F.lit("]"),
                ),
            ).otherwise(state["done"]).alias("done"),
            F.greatest(state["at"], f["end"]).alias("at"),
        ),
        lambda state: F.concat(state["done"], F.substring(whole, state["at"] + 1, F.length(whole))),
    )
    return docs.withColumn(text, F.when(F.size(findings) > 0, folded).otherwise(F.col(text)))
