"""Archive listings and TAR files as sources of ``spark.read.format``: split over tasks, read where they lie, files picked before anything is opened.

Executors open the files themselves, through Arrow's file systems, so a path is one that all of them reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veritome.sources.files import tar_frames

BYTES_PER_PARTITION = 128 << 20
#: Pieces are put together until this many tasks are left, or tasks of BYTES_PER_PARTITION: small pieces of large folders aren't a task each.
TASKS = 128
_NAMED = re.compile(r"^([A-Za-z][A-Za-z ]*) = ?(.*)$")
# Names in a listing and their columns.
LISTED = {"Path": "path", "Size": "size", "Packed Size": "packed", "Attributes": "attributes", "CRC": "crc"}


@dataclass
class Pieces(InputPartition):
    """What one task reads: path, name below the root, first byte and the byte after the last, of each file."""

    files: list[tuple[str, str, int, int]]


class _FolderReader(DataSourceReader):
    """Finds files below a root in order of name and picks them by options before anything is opened.

    Filters aren't taken from Spark: in 4.1 what one frame pushes stays with the table, so another frame over it is planned with those partitions only.
    """

    splits = False

    def __init__(self, options) -> None:
        self.root = options["path"]
        self.most = int(options.get("bytes_per_partition", BYTES_PER_PARTITION))
        self.prefix, self.suffix = options.get("prefix", ""), options.get("suffix", "")

    def partitions(self) -> list[Pieces]:
        """Small files share a task, large ones are split if the format allows it; a missing root raises."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.root)
        infos = [store.get_file_info(root)]
        if infos[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        base = root.rstrip("/") + "/"
        if infos[0].type == fs.FileType.Directory:
            infos = store.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((i.path.removeprefix(base), i.path, i.size) for i in infos if i.is_file)
        # names that begin with a dot or an underscore are the writers' own
        found = [f for f in found if f[2] and not re.search(r"(^|/)[._]", f[0]) and f[0].startswith(self.prefix) and f[0].endswith(self.suffix)]
        out: list[Pieces] = []
        task = max(self.most, min(BYTES_PER_PARTITION, -(-sum(size for *_, size in found) // TASKS)))
        held = task
        for name, path, size in found:
            step = self.most if self.splits else size
            for start in range(0, size, step):
                end = min(size, start + step)
                if held + end - start > task:
                    out.append(Pieces([]))
                    held = 0
                out[-1].files.append((path, name, start, end))
                held += end - start
        return out

    def read(self, partition: Pieces) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.root)
        for path, name, start, end in partition.files if partition else ():
            with store.open_input_file(path) as stream:
                yield from self.rows(stream, name, start, end)


class ListingReader(_FolderReader):
    """A block begins at its Path and belongs to the task in whose bytes that line begins; its end may lie beyond."""

    splits = True

    def rows(self, stream, name: str, start: int, end: int) -> Iterator[tuple]:
        lines = _lines(stream, start)
        block: dict[str, str] | None = None
        begun = 0
        for at, line in lines:
            m = _NAMED.match(line)
            if m and m[1] == "Path":
                if block is not None:
                    yield (name, begun, *(block.get(n) for n in LISTED))
                if at >= end:
                    return
                block, begun = {}, at
            elif block is None and at >= end:
                return
            if m and block is not None:
                block[m[1]] = max(block.get(m[1], ""), m[2])
        if block is not None:
            yield (name, begun, *(block.get(n) for n in LISTED))


def _lines(stream, start: int, size: int = 1 << 16) -> Iterator[tuple[int, str]]:
    """Lines that begin at ``start`` or later, with their places."""
    at = max(0, start - 1)
    stream.seek(at)
    rest, skip = b"", start > 0
    while True:
        more = stream.read(size)
        parts = (rest + more).split(b"\n")
        rest = parts.pop() if more else b""
        for part in parts:
            if not skip:
                yield at, part.removesuffix(b"\r").decode("utf-8", "replace")
            skip = False
            at += len(part) + 1
        if not more:
            return


class TarReader(_FolderReader):
    """A TAR file is a chain of headers, so one task walks it; it reads headers and seeks over contents."""

    def rows(self, stream, name: str, start: int, end: int) -> Iterator[tuple]:
        for row in tar_frames(stream, end):
            yield (name, *row)


class ArchiveListing(DataSource):
    """``file, place, path, size, packed, attributes, crc`` of the blocks of ``Name = value`` listings below a path.

    Options: bytes_per_partition (of a piece; a task of a large folder has several), prefix and suffix of ``file``. Values are text as listed, null where a block has none; lines that aren't such pairs are
    passed over, bytes that aren't UTF-8 replaced, of a name given twice in a block the greater value stays.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_listing"

    def schema(self) -> str:
        return "file string, place long, " + ", ".join(f"{c} string" for c in LISTED.values())

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


class TarMembers(DataSource):
    """``file, ordinal, path, size, kind, finding`` of the headers of TAR files below a path. Options: bytes_per_partition, prefix and suffix of ``file``."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "file string, ordinal long, path string, size long, kind string, finding string"

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(ArchiveListing)
    spark.dataSource.register(TarMembers)
