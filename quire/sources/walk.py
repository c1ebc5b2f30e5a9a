"""``walk``: a batch source that lists file trees, with hidden and empty files, which the built-in listing leaves out.

The driver lists directories level by level until there are enough of them (``SPREAD``), or none is left; these are dealt to partitions, which tasks walk. So a tree with a single
first-level directory is spread as well as any other.

A link is followed, if links are, unless it leads back to a directory that it lies in; what two links lead to is listed under both.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.globs import any_glob
from ..operators.filters import SYSTEM_FILES

#: Directories that the driver looks for before it leaves the rest to tasks, and levels that it lists at most.
SPREAD, LEVELS = 256, 4
SCHEMA = "path string, name string, parent_path string, size bigint, modified_ms bigint, depth int, error string"


class _Part(InputPartition):
    def __init__(self, tops: list[tuple[str, int, tuple[str, ...]]], recurse: bool) -> None:
        self.tops, self.recurse = tops, recurse  # (path, depth of what lies in it, real paths of the directories above)


class WalkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = json.loads(options["roots"])
        globs = lambda name: (lambda g: re.compile(any_glob(g)) if g else None)(json.loads(options.get(name, "[]")))
        self.include, self.exclude = globs("include"), globs("exclude")
        flag = lambda name, default: options.get(name, default).lower() == "true"
        self.hidden, self.system, self.follow = flag("ignorehidden", "false"), flag("ignoresystem", "true"), flag("followlinks", "false")
        self.most = int(options.get("maxdepth", 1 << 30))

    def _left_out(self, path: str, name: str) -> bool:
        return (self.hidden and name.startswith(".")) or (self.system and (name in SYSTEM_FILES or name.startswith("._"))) or bool(self.exclude and self.exclude.match(path))

    def _error(self, path: str, depth: int, error: Exception) -> tuple:
        return (path, os.path.basename(path), os.path.dirname(path), None, None, depth, f"{type(error).__name__}: {error}")

    def _entries(self, directory: str, depth: int) -> Iterator[tuple[str, str, bool, tuple | None]]:
        """(kind, path, name, row) of what lies in a directory and isn't left out; kind is ``dir``, ``file`` or ``error``."""
        try:
            entries = sorted(os.scandir(directory), key=lambda e: e.name)
        except OSError as e:
            yield "error", directory, "", self._error(directory, depth - 1, e)
            return
        for e in entries:
            if self._left_out(e.path, e.name) or (e.is_symlink() and not self.follow):
                continue
            try:
                if e.is_dir(follow_symlinks=self.follow):
                    yield "dir", e.path, e.name, None
                elif e.is_file(follow_symlinks=self.follow):
                    if not self.include or self.include.match(e.path):
                        s = e.stat(follow_symlinks=self.follow)
                        yield "file", e.path, e.name, (e.path, e.name, directory, s.st_size, int(s.st_mtime * 1000), depth, None)
                elif e.is_symlink():
                    os.stat(e.path)  # a dangling link says why
            except OSError as err:
                yield "error", e.path, e.name, self._error(e.path, depth, err)

    def partitions(self) -> list[InputPartition]:
        listed: list[tuple[str, int, tuple[str, ...]]] = []
        front = [(root, 1, ()) for root in self.roots]
        for _ in range(LEVELS):
            if len(front) >= SPREAD or not front:
                break
            below = []
            for path, depth, above in front:
                listed.append((path, depth, above))
                if os.path.isdir(path) and depth < self.most:
                    here = (*above, os.path.realpath(path))
                    below += [(p, depth + 1, here) for kind, p, _, _ in self._entries(path, depth) if kind == "dir" and os.path.realpath(p) not in here]
            front = below
        deal = lambda tops, recurse: [_Part(tops[i::SPREAD], recurse) for i in range(min(SPREAD, len(tops)))]
        return deal(listed, False) + deal(front, True)

    def read(self, part: _Part) -> Iterator[tuple]:
        for path, depth, above in part.tops:
            if os.path.isdir(path):
                yield from self._walk(path, depth, above, part.recurse)
                continue
            try:
                s = os.stat(path)
                yield (path, os.path.basename(path), os.path.dirname(path), s.st_size, int(s.st_mtime * 1000), 0, None)
            except OSError as e:
                yield self._error(path, 0, e)

    def _walk(self, path: str, depth: int, above: tuple[str, ...], recurse: bool) -> Iterator[tuple]:
        stack = [(path, depth, above)]
        while stack:
            directory, depth, above = stack.pop()
            real = os.path.realpath(directory)
            if real in above:
                continue
            for kind, p, _, row in self._entries(directory, depth):
                if row is not None:
                    yield row
                elif kind == "dir" and recurse and depth < self.most:
                    stack.append((p, depth + 1, (*above, real)))


class WalkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WalkReader(dict(self.options))


def walk(spark: SparkSession, roots: list[str], include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), ignore_hidden: bool = False, ignore_system: bool = True, follow_links: bool = False, max_depth: int | None = None) -> DataFrame:
    """Files under the roots; what can't be read is a row with an error. A root that is a file is that file."""
    spark.dataSource.register(WalkSource)
    reader = spark.read.format("walk").option("roots", json.dumps(list(roots))).option("include", json.dumps(list(include))).option("exclude", json.dumps(list(exclude)))
    reader = reader.option("ignorehidden", str(ignore_hidden)).option("ignoresystem", str(ignore_system)).option("followlinks", str(follow_links))
    return (reader if max_depth is None else reader.option("maxdepth", str(max_depth))).load()


def count_files(spark: SparkSession, roots: list[str], **options) -> int:
    return walk(spark, roots, **options).where("error is null").count()
