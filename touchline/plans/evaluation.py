"""From the tables of a harmonised run to its evaluation: views, source shift and learning tasks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from touchline.plans import experiments as G
from touchline.plans import harmonise
from touchline.plans import views as V
from touchline.session import scratch_tables
from touchline.sources.sinks import write_report


def evaluate(
    spark: SparkSession, out: str, report: str, *, feeds: harmonise.Feeds | None = None, shift: Iterable[str] | None = None,
    presets: Iterable[str] = (), settings: V.Settings | None = None, shift_settings: Mapping | None = None,
    task_settings: Mapping | None = None, grid_settings: Mapping | None = None,
) -> dict[str, DataFrame]:
    """Evaluate the run below ``out`` and write the sections of its report below ``report``.

    ``shift`` names the views of the source-shift evaluation: all eleven by default, but for that of raw
    rows where no ``feeds`` are given. ``presets`` names learning tasks; each grid of one is the section
    ``<preset>_<grid>``. Views that several of them read are built once. What is written on the way is
    removed at the end, so the sections are read back from the report.
    """
    names = V.SHIFT_VIEWS if shift is None else tuple(shift)
    if shift is None and feeds is None:
        names = tuple(name for name in names if name != "raw_tracking_common")
    presets = tuple(presets)
    with scratch_tables(spark):
        tables = V.harmonised_tables(spark, out, feeds)
        views = V.build(tables, [*names, *(G.PRESETS[p]["view"] for p in presets)], settings)
        sections = G.shift_report({name: views[name] for name in names}, described=V.GRAPH, **(shift_settings or {})) if names else {}
        for preset in presets:
            task = G.preset_task(preset, views, V.GRAPH, **(task_settings or {}))
            for run, scores in G.run_preset(preset, task, **(grid_settings or {})).items():
                sections[f"{preset}_{run}"] = scores
        write_report(sections, report)
        schemas = {name: section.schema for name, section in sections.items()}
    return {name: spark.read.schema(schema).json(f"{report}/{name}") for name, schema in schemas.items()}
