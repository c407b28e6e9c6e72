"""Paged listings as a source, for batches and streams: pages that a service has given, kept as files.

A listing is a folder of generations (a walk that began anew), each a folder of pages ``page-<number>.json`` that hold ``value``, a list of
records, and either ``next``, where the walk goes on, or ``delta``, where it was complete. Pages after a ``delta`` are its later changes.
Only pages up to the last complete walk are read, so that a consumer never sees half of one.

A stream's offset is a cursor: generation and page. Where the cursor's generation is no longer the newest, or its next page is gone (the
service says 410), the stream starts over with the newest generation and marks its rows with ``restart``.

Files are read with ``pyarrow.fs``, which must know the store that the path names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "quillstack_pages"
SCHEMA = "generation string, page long, place int, restart boolean, record string"
_PAGE = re.compile(r"page-(\d+)\.json")


@dataclass
class Pages(InputPartition):
    """Some pages of a generation."""

    generation: str
    numbers: list[int]
    restart: bool


class _Folder:
    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.base = fs.FileSystem.from_uri(path)
        self.select = fs.FileSelector
        self.kinds = fs.FileType

    def generations(self) -> list[str]:
        found = self.files.get_file_info(self.select(self.base, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == self.kinds.Directory)

    def numbers(self, generation: str) -> list[int]:
        found = self.files.get_file_info(self.select(f"{self.base}/{generation}", allow_not_found=True))
        return sorted(int(m[1]) for f in found if (m := _PAGE.fullmatch(f.base_name)))

    def page(self, generation: str, number: int) -> dict:
        names = [f.path for f in self.files.get_file_info(self.select(f"{self.base}/{generation}")) if (m := _PAGE.fullmatch(f.base_name)) and int(m[1]) == number]
        with self.files.open_input_stream(names[0]) as f:
            return json.loads(f.read())

    def complete(self, generation: str) -> list[int]:
        """The pages up to the last complete walk."""
        numbers = self.numbers(generation)
        while numbers and "delta" not in self.page(generation, numbers[-1]):
            numbers.pop()
        return numbers

    def newest(self) -> tuple[str, list[int]]:
        """The newest generation with a complete walk, and its pages."""
        for generation in reversed(self.generations()):
            if numbers := self.complete(generation):
                return generation, numbers
        return "", []


class _Reader:
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("pages_per_task", 8))

    def cut(self, generation: str, numbers: list[int], restart: bool) -> list[Pages]:
        return [Pages(generation, numbers[i : i + self.size], restart) for i in range(0, len(numbers), self.size)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        folder = _Folder(self.path)
        for number in partition.numbers:
            for place, record in enumerate(folder.page(partition.generation, number).get("value") or []):
                yield partition.generation, number, place, partition.restart, json.dumps(record, ensure_ascii=False)


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        generation, numbers = _Folder(self.path).newest()
        return self.cut(generation, numbers, False) or [Pages(generation, [], False)]


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"generation": "", "page": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        generation, numbers = _Folder(self.path).newest()
        return {"generation": generation, "page": numbers[-1]} if numbers else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        numbers = [n for n in _Folder(self.path).numbers(end["generation"]) if n <= end["page"]] if end["generation"] else []
        after = [n for n in numbers if n > start["page"]]
        if start["generation"] == end["generation"] and (not after or after[0] == start["page"] + 1):
            return self.cut(end["generation"], after, False)
        return self.cut(end["generation"], numbers, bool(start["generation"]))

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def read_pages(spark: SparkSession, path: str, pages_per_task: int = 8):
    """generation, page, place, restart (false) and record (JSON) of the newest complete listing below ``path``."""
    register(spark)
    return spark.read.format(NAME).option("path", path).option("pages_per_task", pages_per_task).load()


def stream_pages(spark: SparkSession, path: str, pages_per_task: int = 8):
    """The same as a stream; after a restart its rows are marked."""
    register(spark)
    return spark.readStream.format(NAME).option("path", path).option("pages_per_task", pages_per_task).load()
