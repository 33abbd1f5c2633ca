"""A stream source that polls message channels, each with its own offset.

The log of a channel is a folder ``channel=<name>`` of Parquet files with a growing
``id``.  An offset is a map from channel to the last id taken.  A poll takes the
oldest messages after it, at most ``limit`` of each channel, so a channel that is far
ahead does not hold up the others; a channel's messages of a poll are read in parts
of ``part`` by tasks of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = "channel string, id bigint, ts timestamp, text string"
LIMIT, PART = 10_000, 2_500


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Stretch(InputPartition):
    """Messages of a channel with ids after ``start`` up to ``end``."""

    def __init__(self, channel: str, folder: str, start: int, end: int):
        super().__init__(channel)
        self.channel, self.folder, self.start, self.end = channel, folder, start, end


class ChannelReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"].rstrip("/"), schema
        self.limit, self.part = int(options.get("limit", LIMIT)), int(options.get("part", PART))
        self.checkpoint, self.source = options.get("checkpoint"), int(options.get("source", 0))
        self.taken: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def _channels(self) -> dict[str, str]:
        system, path = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = {f.base_name: f.path for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("channel=")}
        return {unquote(n.partition("=")[2]): p for n, p in sorted(names.items())}

    def _planned(self) -> dict[str, int]:
        """The end of the last poll that the query wrote down, as after a restart this object is new."""
        if not self.checkpoint:
            return {}
        system, path = _opened(self.checkpoint.rstrip("/") + "/offsets")
        numbers = [int(f.base_name) for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.isdigit()]
        if not numbers:
            return {}
        with system.open_input_stream(f"{path}/{max(numbers)}") as file:
            lines = file.read().decode().split("\n")
        # a version, the metadata of the batch, and an offset for each source
        found = json.loads(lines[2 + self.source])
        return found if isinstance(found, dict) else {}

    def _ids(self, folder: str, start: int) -> pa.Array:
        """The oldest ids after ``start``, ``limit`` at most."""
        system, path = _opened(self.path)
        files = ds.dataset(folder, filesystem=system, format="parquet")
        ids = files.to_table(columns=["id"], filter=ds.field("id") > start)["id"].combine_chunks()
        order = pc.array_sort_indices(ids)
        return ids.take(order[: self.limit])

    def latestOffset(self) -> dict:
        if self.taken is None:
            self.taken = self._planned()
        for channel, folder in self._channels().items():
            ids = self._ids(folder, self.taken.get(channel, -1))
            if len(ids):
                self.taken[channel] = ids[-1].as_py()
        return dict(self.taken)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        folders = self._channels()
        for channel, last in end.items():
            first = start.get(channel, -1)
            if last <= first:
                continue
            ids = self._ids(folders[channel], first)
            ids = ids.filter(pc.less_equal(ids, last))
            cuts = [first, *ids[self.part - 1 :: self.part].to_pylist()]
            if cuts[-1] < last:
                cuts.append(last)
            out += [Stretch(channel, folders[channel], a, b) for a, b in zip(cuts, cuts[1:])]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        files = ds.dataset(partition.folder, filesystem=system, format="parquet")
        wanted = [f.name for f in self.schema if f.name != "channel"]
        rows = files.to_table(columns=wanted, filter=(ds.field("id") > partition.start) & (ds.field("id") <= partition.end)).sort_by("id")
        columns = {n: rows[n] for n in wanted} | {"channel": pa.array([partition.channel] * len(rows), pa.string())}
        table = pa.table({f.name: columns[f.name] for f in self.schema}).cast(to_arrow_schema(self.schema))
        yield from table.to_batches(max_chunksize=10_000)

    def commit(self, end: dict) -> None:
        """Logs are kept by whoever writes them."""


class ChannelSource(DataSource):
    """``spark.readStream.format("channels")`` with the options ``path``, ``limit``, ``part`` and ``checkpoint``."""

    @classmethod
    def name(cls) -> str:
        return "channels"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> ChannelReader:
        return ChannelReader(self.options, schema)


def append(messages: DataFrame, path: str) -> None:
    """Add rows of channel, id, ts and text to the logs; ids must be larger than those of the channel so far."""
    messages.select("channel", "id", "ts", "text").write.mode("append").partitionBy("channel").parquet(path)


def read_channels(spark: SparkSession, path: str, checkpoint: str, limit: int = LIMIT, part: int = PART) -> DataFrame:
    """The stream of all channels.

    ``checkpoint`` is the checkpoint folder of the query that will read it: the
    number of messages of a poll counts from where that query is.
    """
    spark.dataSource.register(ChannelSource)
    options = {"path": path, "limit": str(limit), "part": str(part), "checkpoint": checkpoint}
    return spark.readStream.format("channels").options(**options).load()
