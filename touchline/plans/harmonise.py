"""Raw feeds to harmonised tables: one plan for a batch of matches, written by match.

A run works in batches of matches. A batch writes its outputs into folders of its own, and one
append to the manifest then makes all of them count at once: rows of the manifest name for each match
the batch that holds it, or the reason why it failed. Whatever a broken run left behind is in
no manifest row; readers never see it and the next run removes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import constants as K
from touchline.functions import scalars as S
from touchline.operators.sheets import match_sheets
from touchline.operators.trajectory import dense_frame_id, kinematics_qc
from touchline.session import exists, materialise, remove, scratch_tables, subfolders
from touchline.sources import json_feed, sinks, xml_feed
from touchline.sources.files import Files


@dataclass(frozen=True)
class Feeds:
    """Root folders of the two feeds; either may be missing."""

    xml: str | Files | None = None
    json: str | Files | None = None

    def modules(self):
        if self.xml:
            yield xml_feed, self.xml
        if self.json:
            yield json_feed, self.json


def _union(spark: SparkSession, feeds: Feeds, table: str, *args) -> DataFrame:
    out: DataFrame | None = None
    for module, folder in feeds.modules():
        part = getattr(module, table)(spark, folder, *args)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no feed given")
    return out


def harmonise_tracking(raw: DataFrame, directions: DataFrame) -> DataFrame:
    """Quality-controlled 10 Hz tracking rows with dense frame ids."""
    keyed = raw.filter(F.col("player_id").isNotNull() & F.col("period").isNotNull())
    staged = materialise(
        keyed.withColumns(
            {
                "t_s": F.unix_micros(S.to_utc(F.col("timestamp"))) / F.lit(1e6),
                "is_visible": F.coalesce("is_visible", F.lit(True)),
                "is_home": F.coalesce("is_home", F.lit(False)),
            }
        ).join(directions.select("match_id", "period", "play_direction"), ["match_id", "period"], "left")
    )
    moved = kinematics_qc(staged)
    return dense_frame_id(moved, frames=staged).drop("t_s", "play_direction")


def tracking(spark: SparkSession, feeds: Feeds) -> DataFrame:
    """Harmonised tracking of all matches of the feeds."""
    return harmonise_tracking(_union(spark, feeds, "tracking"), _union(spark, feeds, "directions"))


def actions(spark: SparkSession, feeds: Feeds) -> DataFrame:
    return _union(spark, feeds, "actions")


MANIFEST = "sequence bigint, match_id string, source string, batch string, status string, reason string, rows bigint"
TABLES = ("tracking", "frames", "sheets", "actions", "event_lines")
#: Matches that one plan handles; bounds the lists of paths in it.
MATCHES_PER_BATCH = 200
REASON_LENGTH = 500


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The latest row of each match: its batch and status (ok or failed), reason and tracking rows."""
    path = f"{out}/manifest"
    rows = spark.read.schema(MANIFEST).parquet(path) if exists(spark, path) else spark.createDataFrame([], MANIFEST)
    latest = rows.groupBy("source", "match_id").agg(F.max_by(F.struct(*rows.columns), "sequence").alias("m"))
    return latest.select("m.*")


def read(spark: SparkSession, out: str, table: str, *, schema: str | None = None) -> DataFrame:
    """Rows of an output table for matches that the manifest names as ok; ids keep their text form.

    ``schema`` names the wanted columns, batch, source and match_id among them, of a table of JSON.
    """
    reader = {"frames": "text", "event_lines": "text", "sheets": "json"}.get(table, "parquet")
    path = f"{out}/{table}"
    known = T.StructType.fromDDL(schema) if schema else spark.read.format(reader).load(path).schema
    names = ("batch", "source", "match_id")
    fixed = T.StructType([T.StructField(f.name, T.StringType() if f.name in names else f.dataType) for f in known])
    rows = spark.read.format(reader).schema(fixed).load(path)
    kept = manifest(spark, out).filter("status = 'ok'").select("match_id", "batch", *(["source"] if "source" in rows.columns else []))
    return rows.join(F.broadcast(kept), kept.columns, "left_semi").drop("batch")


@dataclass(frozen=True)
class _Batch:
    """Matches of one plan: the listed files, as (source, match_id, kind, path)."""

    listed: tuple[tuple, ...]

    def matches(self) -> list[tuple[str, str]]:
        return sorted({row[:2] for row in self.listed})

    def without(self, bad: Mapping[tuple[str, str], str]) -> _Batch:
        return _Batch(tuple(row for row in self.listed if row[:2] not in bad))

    def halves(self) -> tuple[_Batch, _Batch]:
        names = self.matches()
        first = set(names[: len(names) // 2])
        return (
            _Batch(tuple(row for row in self.listed if row[:2] in first)),
            _Batch(tuple(row for row in self.listed if row[:2] not in first)),
        )

    def feeds(self, feeds: Feeds) -> Feeds:
        """The feeds with the files of these matches only; a feed without any is left out."""

        def of(module, folder) -> Files | None:
            source = _source(module)
            paths: dict[str, list[str]] = {}
            for row in self.listed:
                if row[0] == source:
                    paths.setdefault(row[2], []).append(row[3])
            return Files(folder, paths) if paths else None

        return Feeds(**{name: of(module, folder) for name, module, folder in _named(feeds)})


def _source(module) -> str:
    return K.SOURCE_XML if module is xml_feed else K.SOURCE_JSON


def _named(feeds: Feeds):
    for module, folder in feeds.modules():
        yield "xml" if module is xml_feed else "json", module, folder


def _by_match(problems: DataFrame, source: str) -> dict[tuple[str, str], str]:
    """First reason of each match; a row per broken match of the batch."""
    rows = problems.groupBy("match_id").agg(F.min("reason").alias("reason")).collect()
    return {(source, row["match_id"]): row["reason"][:REASON_LENGTH] for row in rows}


def _missing(batch: _Batch) -> dict[tuple[str, str], str]:
    """Matches without a needed file; empty files are not listed."""
    needed = {_source(module): module.REQUIRED for module in (xml_feed, json_feed)}
    kinds: dict[tuple[str, str], set[str]] = {}
    bad: dict[tuple[str, str], str] = {}
    for source, match_id, kind, _ in batch.listed:
        kinds.setdefault((source, match_id), set()).add(kind)
    for match, found in kinds.items():
        lacking = [kind for kind in needed[match[0]] if kind not in found]
        if lacking:
            bad[match] = f"no {lacking[0]} file, or it is empty"
    return bad


def _unreadable(spark: SparkSession, batch: _Batch, feeds: Feeds, check: Callable) -> dict[tuple[str, str], str]:
    bad: dict[tuple[str, str], str] = {}
    for _, module, folder in _named(batch.feeds(feeds)):
        bad |= _by_match(check(module, folder), _source(module))
    return bad


def _write(spark: SparkSession, feeds: Feeds, out: str, batch: str) -> dict[tuple[str, str], int]:
    """Write all outputs of staged feeds; tracking rows of each match that has any."""

    def place(table: str) -> str:
        return f"{out}/{table}/batch={batch}"

    matches = materialise(_union(spark, feeds, "matches"))
    rows = materialise(tracking(spark, feeds))
    sinks.write_tracking(rows, place("tracking"))
    ids = matches.select("match_id", "home_team_id", "away_team_id")
    sinks.write_frame_lines(sinks.frame_lines(sinks.nest_frames(rows.join(ids, "match_id"))), place("frames"))
    sheets = match_sheets(
        rows, matches, _union(spark, feeds, "rosters"), _union(spark, feeds, "referees"), _union(spark, feeds, "directions")
    )
    sinks.write_sheets(sheets, place("sheets"))
    sinks.write_actions(materialise(actions(spark, feeds)), place("actions"), place("event_lines"))
    counted = rows.groupBy("source", "match_id").count().collect()
    return {(row["source"], row["match_id"]): row["count"] for row in counted}


def _process(spark: SparkSession, batch: _Batch, feeds: Feeds, out: str) -> list[tuple]:
    """Manifest rows (match_id, source, batch, status, reason, rows) of a batch, its outputs being written.

    Files that are missing or cannot be read are told apart beforehand. A plan that fails nevertheless
    is run again on each half of its matches, down to the single match that it fails for.
    """
    bad = _missing(batch)
    name = uuid.uuid4().hex
    try:
        with scratch_tables(spark):
            bad |= _unreadable(spark, batch.without(bad), feeds, lambda module, files: module.incomplete(spark, files))
            bad |= _unreadable(
                spark, batch.without(bad), feeds, lambda module, files: module.malformed(spark, module.stage(spark, files))
            )
            good = batch.without(bad)
            rows: dict[tuple[str, str], int] = {}
            if good.listed:
                staged = {n: module.stage(spark, files) for n, module, files in _named(good.feeds(feeds))}
                rows = _write(spark, Feeds(**staged), out, name)
    except (PySparkException, Py4JError) as error:
        if spark.sparkContext._jsc.sc().isStopped():
            raise
        if len(batch.matches()) > 1:
            return [row for half in batch.halves() for row in _process(spark, half, feeds, out)]
        source, match_id = batch.matches()[0]
        return [(match_id, source, name, "failed", str(error)[:REASON_LENGTH], None)]
    done = []
    for source, match_id in batch.matches():
        reason = bad.get((source, match_id))
        count = rows.get((source, match_id))
        if reason is None and count is None:
            reason = "no usable tracking rows"
        done.append((match_id, source, name, "failed" if reason else "ok", reason, count))
    return done


def discard_uncommitted(spark: SparkSession, out: str) -> None:
    """Remove output folders of batches that hold no match any more: broken or replaced ones."""
    live = {row["batch"] for row in manifest(spark, out).filter("status = 'ok'").select("batch").distinct().collect()}
    for table in TABLES:
        for folder in subfolders(spark, f"{out}/{table}"):
            if folder.removeprefix("batch=") not in live:
                remove(spark, f"{out}/{table}/{folder}")


def run(
    spark: SparkSession, feeds: Feeds, out: str, *, resume: bool = True, matches_per_batch: int = MATCHES_PER_BATCH
) -> DataFrame:
    """Write tracking, frame lines, actions, event lines and sheets below ``out``.

    With ``resume`` only matches that the manifest does not name as ok are processed; without it
    all are, and replace what was there. Files of finished matches are not read. A match whose files
    are missing, cut off or malformed fails with its reason and leaves the others alone; the next
    run tries it again. Returns one row per discovered match: status (skipped, ok or failed),
    tracking rows and reason. One run at a time may write below ``out``; ``read`` gives the tables back.
    """
    found: DataFrame | None = None
    for module, folder in feeds.modules():
        part = module.inventory(spark, folder)
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no feed given")
    discard_uncommitted(spark, out)
    before = manifest(spark, out)
    number = (before.agg(F.max("sequence")).first()[0] or 0) + 1
    # The list of files, as the driver holds it for any read of them.
    listed = sorted(tuple(row) for row in found.collect())
    done = {(r["source"], r["match_id"]) for r in before.filter("status = 'ok'").collect()} if resume else set()
    names = sorted({row[:2] for row in listed} - done)
    results: list[tuple] = [(m, s, "skipped", None, None) for s, m in sorted({row[:2] for row in listed} & done)]
    for begin in range(0, len(names), matches_per_batch):
        chosen = set(names[begin : begin + matches_per_batch])
        rows = _process(spark, _Batch(tuple(row for row in listed if row[:2] in chosen)), feeds, out)
        stamped = [(number, *row) for row in rows]
        spark.createDataFrame(stamped, MANIFEST).coalesce(1).write.mode("append").parquet(f"{out}/manifest")
        results += [(match_id, source, status, reason, count) for match_id, source, _, status, reason, count in rows]
        number += 1
    discard_uncommitted(spark, out)
    return spark.createDataFrame(
        results, "match_id string, source string, status string, reason string, rows bigint"
    ).select("match_id", "source", "status", "rows", "reason")
