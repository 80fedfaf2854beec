"""Tables that a ``foreachBatch`` sink writes: a log of batches with versions.

Every micro-batch is written to a folder of its own attempt and then committed by
a small manifest, the next version of the table: the list of the folders that make
it up, in order. Readers take the newest manifest, so they see whole batches only. A
batch that is retried after a failure takes its own place in the list; one that has
already been merged is not written again.

Folders are merged in levels: as soon as a level has ``FANOUT`` folders, they become
one of the next level, folded if the caller says how. Each row is rewritten once a level,
so the cost is the logarithm of the number of batches, and so is the number of folders. Folders and
manifests that none of the last ``KEEP`` versions names are removed.

A table outlives the checkpoint of the query that writes it. Batches are known by query and number,
so a query with a new checkpoint goes on from the last version (or, with
``restart``, begins an empty one); it does not take the old batch 0 for its own.
One query writes a table at a time.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from vacancia.sources.storage import Folder

#: Folders of a level that are merged into one, and versions that stay readable.
FANOUT, KEEP = 8, 3

Fold = Callable[[DataFrame], DataFrame]


@dataclass
class Version:
    """A committed state of a table.

    ``entries`` are dicts of folder, level, query and batch (of the last batch in it);
    ``merged`` has the last batch of each query that is part of a merged folder.
    """

    number: int = -1
    entries: list[dict] = field(default_factory=list)
    merged: dict[str, int] = field(default_factory=dict)


def query_of(spark: SparkSession) -> str:
    """The running stream's id, which its checkpoint keeps; ``-`` outside of one."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "-"


class BatchLog:
    """One such table. ``fold`` reduces rows associatively: folding folds gives the fold of all."""

    def __init__(self, spark: SparkSession, path: str, fold: Fold | None = None, fanout: int | None = None,
                 keep: int | None = None) -> None:
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold
        self.fanout, self.keep = fanout or FANOUT, keep or KEEP
        self.folder = Folder(spark, self.path)

    # --- versions ---

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that of a number; an empty one if there is none."""
        known = self.versions()
        if number is None:
            if not known:
                return Version()
            number = known[-1]
        return Version(**json.loads(self.folder.read(f"manifest/{number:012d}.json")))

    def _commit(self, version: Version) -> Version:
        version = Version(version.number + 1, version.entries, version.merged)
        if not self.folder.write_new(f"manifest/{version.number:012d}.json", json.dumps(vars(version)), uuid.uuid4().hex):
            raise RuntimeError(f"{self.path}: another writer committed version {version.number}")
        self._prune()
        return version

    def _prune(self) -> None:
        """Remove what the last ``keep`` versions don't name, folders of broken-off attempts included."""
        known = self.versions()
        for number in known[:-self.keep]:
            self.folder.remove(f"manifest/{number:012d}.json")
        named = {e["folder"] for n in known[-self.keep:] for e in self.version(n).entries}
        for name in self.folder.names("data"):
            if f"data/{name}" not in named:
                self.folder.remove(f"data/{name}")

    # --- writing ---

    def _write(self, df: DataFrame, label: str) -> str:
        name = f"data/{label}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def append(self, df: DataFrame, batch_id: int, query: str | None = None, restart: bool = False,
               merge: bool = True) -> bool:
        """Add a micro-batch's rows; False if the batch is part of a merged folder already.

        Tables that have to be written together are appended without merging, and merged when all are written.
        """
        query = query or query_of(self.spark)
        now = self.version()
        if restart and all(e["query"] != query for e in now.entries) and query not in now.merged:
            now = Version(now.number)
        if batch_id <= now.merged.get(query, -1):
            return False
        entry = {"folder": self._write(df, f"{batch_id:08d}"), "level": 0, "query": query, "batch": batch_id}
        place = [i for i, e in enumerate(now.entries) if (e["query"], e["batch"]) == (query, batch_id)]
        entries = list(now.entries)
        if place:
            entries[place[0]] = entry
        else:
            entries.append(entry)
        self._commit(Version(now.number, entries, now.merged))
        if merge:
            self.merge()
        return True

    def has_merged(self, batch_id: int, query: str | None = None) -> bool:
        return batch_id <= self.version().merged.get(query or query_of(self.spark), -1)

    def merge(self) -> None:
        """Merge levels until none is full."""
        version = self.version()
        while (merged := self._merged(version)) is not None:
            version = merged

    def _merged(self, now: Version) -> Version | None:
        """The version after merging the first level that is full; none if none is."""
        for level in sorted({e["level"] for e in now.entries}):
            same = [e for e in now.entries if e["level"] == level]
            if len(same) < self.fanout:
                continue
            rows = self._rows(same)
            folder = self._write((self.fold(rows) if self.fold else rows).coalesce(max(1, len(rows.inputFiles()) // self.fanout)),
                                 f"L{level + 1}")
            merged = dict(now.merged)
            for e in same:
                merged[e["query"]] = max(merged.get(e["query"], -1), e["batch"])
            one = {"folder": folder, "level": level + 1, "query": same[-1]["query"], "batch": same[-1]["batch"]}
            at = now.entries.index(same[0])
            left = [e for e in now.entries if e["level"] != level]
            return self._commit(Version(now.number, left[:at] + [one] + left[at:], merged))
        return None

    def replace(self, df: DataFrame, batch_id: int, query: str | None = None) -> None:
        """Make ``df`` the whole state after this batch. The states of the last ``keep`` batches stay."""
        query = query or query_of(self.spark)
        now = self.version()
        entry = {"folder": self._write(df, f"{batch_id:08d}"), "level": 0, "query": query, "batch": batch_id}
        before = [e for e in now.entries if (e["query"], e["batch"]) != (query, batch_id)]
        self._commit(Version(now.number, (before + [entry])[-self.keep:], now.merged))

    # --- reading ---

    def _rows(self, entries: list[dict], schema: str | None = None) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/{e['folder']}" for e in entries])

    def rows(self, schema: str, number: int | None = None) -> DataFrame:
        """The rows of all batches of a version; a fold leaves partial results, which the reader folds."""
        return self._rows(self.version(number).entries, schema)

    def before(self, schema: str, batch_id: int, query: str | None = None) -> DataFrame | None:
        """The rows that were there before this batch, also when it is retried; none if there were none.

        A batch that has been merged cannot be taken out again.
        """
        query = query or query_of(self.spark)
        entries = self._before(batch_id, query)
        return self._rows(entries, schema) if entries else None

    def _before(self, batch_id: int, query: str) -> list[dict]:
        return [e for e in self.version().entries if (e["query"], e["batch"]) != (query, batch_id)]

    def state_before(self, schema: str, batch_id: int, query: str | None = None) -> DataFrame | None:
        """The state that this batch starts from; none for the first of all."""
        entries = self._before(batch_id, query or query_of(self.spark))
        return self._rows(entries[-1:], schema) if entries else None

    def state(self, schema: str) -> DataFrame:
        """The state after the last batch."""
        return self._rows(self.version().entries[-1:], schema)


def write_batch(df: DataFrame, path: str, batch_id: int, fold: Fold | None = None) -> None:
    """Append a micro-batch to the log at ``path``."""
    BatchLog(df.sparkSession, path, fold).append(df, batch_id)


def read_all(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches."""
    return BatchLog(spark, path).rows(schema)


def write_state(df: DataFrame, path: str, batch_id: int) -> None:
    """Store the state after a micro-batch."""
    BatchLog(df.sparkSession, path).replace(df, batch_id)


def read_before(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame | None:
    """The state that a micro-batch starts from; none for the first of all."""
    return BatchLog(spark, path).state_before(schema, batch_id)


def read_last(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The state after the last micro-batch."""
    return BatchLog(spark, path).state(schema)
