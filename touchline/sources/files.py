"""Which files of a feed a reader takes: a whole folder, or listed files by kind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Files:
    """A feed folder, or some of its files.

    ``paths`` lists the files of each kind; None means every file that the kind's pattern finds.
    ``staged`` holds tables that were already parsed from these files and written, by name.
    """

    root: str
    paths: Mapping[str, Sequence[str]] | None = None
    staged: Mapping[str, DataFrame] = field(default_factory=dict)

    def of(self, kind: str, pattern: str) -> list[str]:
        """Paths to read; an empty list if there is no such file among the listed ones."""
        return [f"{self.root}/{pattern}"] if self.paths is None else list(self.paths.get(kind, ()))

    def with_staged(self, **tables: DataFrame) -> Files:
        return replace(self, staged={**self.staged, **tables})


def as_files(folder: str | Files) -> Files:
    return folder if isinstance(folder, Files) else Files(folder)


def list_files(
    spark: SparkSession, root: str, source: str, pattern: str, kinds: Mapping[str, str], match_id: Column
) -> DataFrame:
    """(source, match_id, kind, path) of all files with content below ``root`` whose path fits a kind.

    ``kinds`` maps each kind to a regular expression over the path. Contents are not read.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path")
    )
    kind = F.coalesce(*(F.when(F.col("path").rlike(form), F.lit(name)) for name, form in kinds.items()))
    named = listed.select(F.lit(source).alias("source"), match_id.alias("match_id"), kind.alias("kind"), "path")
    return named.filter(F.col("kind").isNotNull() & (F.col("match_id") != ""))
