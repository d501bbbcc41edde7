"""Rules and lists that change while a stream runs: a folder is looked at before every micro-batch and read anew if it changed."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import load_rules, match_rules


class RuleFolder:
    """Rules of a folder and their version, which counts the changes met. Only a changed folder is read.

    A file counts as changed by its name, size or time; a removed file takes its rules along. A folder that can't be read, in
    the midst of an edit, say, leaves the rules as they were; ``problem`` tells why.
    """

    def __init__(self, folder: str) -> None:
        self.folder, self.version, self.rules, self.problem = folder, 0, [], None
        self._seen: tuple | None = None

    def current(self) -> list[dict]:
        files = sorted([*Path(self.folder).glob("*.json"), *Path(self.folder).glob("*.yaml")])
        seen = tuple((f.name, s.st_size, s.st_mtime_ns) for f in files for s in [f.stat()])
        if seen != self._seen:
            try:
                self.rules, self.problem = load_rules(self.folder), None
                self.version += 1
                self._seen = seen
            except (OSError, ValueError, KeyError) as e:
                self.problem = str(e)
        return self.rules


def matching(folder: str | RuleFolder, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's rows with the rules that match them as the folder stands then, given to ``sink``.

    Rules become expressions of the row, so a batch is one scan, and rules need no broadcast. Batches without rules give no rows.
    """
    rules = folder if isinstance(folder, RuleFolder) else RuleFolder(folder)

    def write(batch: DataFrame, number: int) -> None:
        if found := rules.current():
            sink(match_rules(batch, found), number)

    return write


def enriched(read: Callable[[SparkSession], DataFrame], join: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch joined with a table that is read anew, so that an edited allowlist or catalogue acts on the next batch."""

    def write(batch: DataFrame, number: int) -> None:
        sink(join(batch, read(batch.sparkSession)), number)

    return write
