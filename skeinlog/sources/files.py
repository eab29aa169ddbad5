"""Transcript files by byte ranges: a data source for batches and streams, and reads of only the ends of files.

    spark.read.format("skeinlog").option("dialect", "blocks").load(root)

has a row for each complete line: folder, day, path, modified, size, line_no, bytes, line, whole. A line belongs to the
range that its line break is in, so ranges can be cut anywhere, a last line without a break belongs to none yet, and
nothing has to be known of the rest of the file. line_no is made of the line's first byte and so is the same however
the file was read. Filters on folder, day, path and modified go into the listing: folders that they rule out are not
listed and files not opened.

As a stream its offsets are (size, time of modification) of each path: of a file that has grown the new bytes are read,
and an open last line only once its break is there. A file that is shorter than before is read anew, so
that a line that begins at byte 0 tells that what was read of its path before is void. The offset has an entry for each file that is listed; the option `since` (seconds before the newest time of
modification) bounds it where older files are of no interest.

`ends` reads what a digest of a large file needs: its first lines up to the first prompt, and the last bytes from the
first line break in them on, 256 KiB at first and twice that until they hold a message and another prompt, or 4 MiB;
whole says whether the file was read as a whole. `probe` reads the first lines for a working directory only.

Files are opened through pyarrow, so roots are local paths or URIs of stores that it knows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith

from . import transcripts

#: Bytes of a range that one task reads, and bits of line_no below its number (see operators.digest).
SPLIT_BYTES, SPLIT_BITS = 32 << 20, 33
#: The windows at a file's end: the first and the largest; lines at its start that may name a working directory.
WINDOW, MAX_WINDOW, PROBE_LINES = 256 << 10, 4 << 20, 64
BLOCK, BATCH_BYTES, FILES_PER_TASK, LISTED_HERE = 256 << 10, 4 << 20, 64, 64

SCHEMA = "folder string, day date, path string, modified timestamp, size bigint, line_no bigint, bytes bigint, line string, whole boolean"
FILE = pa.schema({"folder": pa.string(), "day": pa.date32(), "path": pa.string(), "modified": pa.timestamp("us", "UTC"), "size": pa.int64()})
LINES = pa.schema([*FILE, pa.field("line_no", pa.int64()), pa.field("bytes", pa.int64()), pa.field("line", pa.string()), pa.field("whole", pa.bool_())])


@dataclass(frozen=True)
class File:
    folder: str | None
    day: date | None
    path: str
    modified: int  # microseconds
    size: int


def store_of(path: str):
    """pyarrow's file system and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return fs.LocalFileSystem(), path


def _listed(root: str) -> list[tuple[str, bool, int, int]]:
    """name, whether it is a folder, microseconds and size of what is in a folder; nothing where there is none."""
    from pyarrow import fs

    store, at = store_of(root)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((i.base_name, i.type == fs.FileType.Directory, (i.mtime_ns or 0) // 1000, i.size or 0) for i in found)


class Bounds:
    """What filters leave of folders, days, paths and times of modification."""

    def __init__(self):
        self.kept: list[Callable[[str, object], bool]] = []
        self.seen: list[str] = []

    def take(self, f: Filter) -> bool:
        """Whether the filter is one that the listing applies as a whole."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name not in ("folder", "day", "path", "modified"):
            return False
        value = getattr(f, "value", None)
        value = micros(value) if isinstance(value, datetime) else value
        test = {
            EqualTo: lambda x: x == value, In: lambda x: x in f.value, GreaterThan: lambda x: x > value, GreaterThanOrEqual: lambda x: x >= value, StringStartsWith: lambda x: x.startswith(value),
        }.get(type(f))
        if test is None or (name == "modified" and isinstance(f, In)):
            return False
        self.kept.append(lambda at, x: at != name or (x is not None and test(x)))
        return True

    def allow(self, **values) -> bool:
        return all(k(name, x) for name, x in values.items() for k in self.kept)


def micros(t: datetime) -> int:
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    whole = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (whole.days * 86_400 + whole.seconds) * 1_000_000 + whole.microseconds


def dialect_of(dialect: str | transcripts.Dialect) -> transcripts.Dialect:
    return transcripts.DIALECTS[dialect] if isinstance(dialect, str) else dialect


def list_folders(root: str, dialect: str | transcripts.Dialect, bounds: Bounds) -> list[tuple[str | None, date | None, str]]:
    """folder, day and path of the folders of a dialect's root that the bounds leave; only what is above them is listed."""
    root = root.rstrip("/")
    names = lambda at: [n for n, is_folder, _, _ in _listed(at) if is_folder]
    if dialect_of(dialect).layout == "folders":
        return [(name, None, f"{root}/{name}") for name in names(root) if bounds.allow(folder=name, day=None)]
    numbers = lambda at: [n for n in names(at) if re.fullmatch("[0-9]+", n)]
    out = []
    for y in numbers(root):
        for m in numbers(f"{root}/{y}"):
            for d in numbers(f"{root}/{y}/{m}"):
                try:
                    day = date(int(y), int(m), int(d))
                except ValueError:
                    continue
                if bounds.allow(day=day, folder=None):
                    out.append((None, day, f"{root}/{y}/{m}/{d}"))
    return out


def files_in(folder: str | None, day: date | None, at: str, d: transcripts.Dialect, bounds: Bounds) -> list[File]:
    return [File(folder, day, f"{at}/{name}", modified, size) for name, is_folder, modified, size in _listed(at) if not is_folder and d.is_file(name) and bounds.allow(path=f"{at}/{name}", modified=modified)]


def list_files(root: str, dialect: str | transcripts.Dialect, bounds: Bounds | None = None) -> list[File]:
    """The files of a dialect's root; folders that the bounds rule out are not listed."""
    bounds = bounds or Bounds()
    folders = list_folders(root, dialect, bounds)
    bounds.seen += [at for _, _, at in folders]
    return [f for folder in folders for f in files_in(*folder, dialect_of(dialect), bounds)]


def line_number(start: int) -> int:
    return (start // SPLIT_BYTES) << SPLIT_BITS | start % SPLIT_BYTES


def begin_of(f, at: int, most: int) -> int | None:
    """Where the line that byte `at` is in begins; None where that is more than `most` bytes before."""
    back = at
    while back > 0 and at - back <= most:
        size = min(BLOCK, back)
        f.seek(back - size)
        cut = f.read(size).rfind(b"\n")
        if cut >= 0:
            return back - size + cut + 1
        back -= size
    return 0 if back == 0 else None


def lines_between(f, start: int, end: int, size: int, whole_first: bool = True) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines whose breaks are in [start, end). The first line's beginning is looked for before
    start, or the line left out (whole_first=False). Lines of more than MAX_LINE bytes are left out, whatever their
    length without being held."""
    most = transcripts.MAX_LINE
    begin = 0 if start == 0 else begin_of(f, start, most) if whole_first else None
    at = start if begin is None else begin
    f.seek(at)
    held, skip = b"", begin is None
    while at < end:
        chunk = f.read(min(BLOCK, end - at))
        if not chunk:
            break
        at += len(chunk)
        parts = (held + chunk).split(b"\n")
        first = at - len(held) - len(chunk)
        for line in parts[:-1]:
            if not skip and len(line) < most:
                yield first, line
            first, skip = first + len(line) + 1, False
        held = parts[-1]
        if len(held) >= most:
            held, skip = b"", True


def parsed(line: bytes) -> dict | None:
    try:
        entry = json.loads(line)
    except ValueError:
        return None
    return entry if isinstance(entry, dict) else None


def end_lines(f, size: int, seen: Callable[[dict], str | None], window: int = WINDOW, most: int = MAX_WINDOW) -> tuple[bool, list[tuple[int, bytes]]]:
    """Whether the file was read as a whole, and the lines: its first ones to the first prompt, and those of the last
    bytes, twice as many each time until they hold a message and a prompt."""
    while window < size:
        head, prompt = [], None
        for start, line in lines_between(f, 0, size - window, size):
            head.append((start, line))
            if (entry := parsed(line)) is not None and seen(entry) == "prompt":
                prompt = start
                break
        if prompt is None:
            break
        tail = list(lines_between(f, size - window, size, size, whole_first=False))
        kinds = {seen(e) for _, line in tail if (e := parsed(line)) is not None}
        if {"prompt", "message"} <= kinds or window >= most:
            return False, head + [t for t in tail if t[0] > prompt]
        window *= 2
    return True, list(lines_between(f, 0, size, size))


def early_cwd(f, size: int, cwd: Callable[[dict], str | None], lines: int = PROBE_LINES) -> str | None:
    """The first working directory that one of the first lines names."""
    for i, (_, line) in enumerate(lines_between(f, 0, size, size)):
        if i >= lines:
            break
        if (entry := parsed(line)) is not None and (found := cwd(entry)):
            return found
    return None


def _row(f: File) -> list:
    return [f.folder, f.day, f.path, f.modified, f.size]


def batches_of(rows: Iterable[tuple[list, int, bytes, bool]]) -> Iterator[pa.RecordBatch]:
    """Rows of LINES (of a file, first byte, line, whole) in batches of some bytes."""
    columns: list[list] = [[] for _ in LINES]
    held = 0
    for file, start, line, whole in rows:
        for c, v in zip(columns, [*file, line_number(start), len(line), line.decode(errors="replace"), whole], strict=True):
            c.append(v)
        held += len(line)
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, LINES, strict=True)], schema=LINES)
            columns, held = [[] for _ in LINES], 0
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, LINES, strict=True)], schema=LINES)


@dataclass
class Ranges(InputPartition):
    """Byte ranges (file, start, end) for one task."""

    ranges: list


def _opened(path: str):
    """The file, or None if it is gone."""
    store, at = store_of(path)
    try:
        return store.open_input_file(at)
    except FileNotFoundError:
        return None


def read_ranges(ranges: list[tuple[File, int, int]]) -> Iterator[pa.RecordBatch]:
    def rows():
        for file, start, end in ranges:
            if (f := _opened(file.path)) is None:
                continue
            with f:
                for first, line in lines_between(f, start, end, file.size):
                    yield _row(file), first, line, True

    return batches_of(rows())


def split(ranges: Iterable[tuple[File, int, int]]) -> list[Ranges]:
    """Ranges of at most SPLIT_BYTES, cut at its multiples, and small ones together."""
    out, held, size = [], [], 0
    for file, start, end in ranges:
        while start < end:
            stop = min(end, (start // SPLIT_BYTES + 1) * SPLIT_BYTES)
            if held and (size + stop - start > SPLIT_BYTES or len(held) >= FILES_PER_TASK):
                out.append(Ranges(held))
                held, size = [], 0
            held.append((file, start, stop))
            size, start = size + stop - start, stop
    return [*out, Ranges(held)] if held else out


class LineReader(DataSourceReader):
    def __init__(self, root: str, dialect: str | transcripts.Dialect):
        self.root, self.dialect, self.bounds = root, dialect, Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.bounds.take(f)]

    def partitions(self) -> list[Ranges]:
        return split((f, 0, f.size) for f in list_files(self.root, self.dialect, self.bounds)) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return read_ranges(partition.ranges)


class LineStream(DataSourceStreamReader):
    def __init__(self, root: str, dialect: str | transcripts.Dialect, since: float | None):
        self.root, self.dialect, self.since = root, dialect, since

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files = list_files(self.root, self.dialect)
        newest = max((f.modified for f in files), default=0)
        return {"files": {f.path: {"size": f.size, "modified": f.modified, "folder": f.folder or "", "day": f.day.isoformat() if f.day else ""} for f in files if self.since is None or f.modified >= newest - self.since * 1e6}}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        ranges = []
        for path, now in end["files"].items():
            before = start["files"].get(path, {"size": 0})
            anew = now["size"] < before["size"]
            file = File(now["folder"] or None, date.fromisoformat(now["day"]) if now["day"] else None, path, now["modified"], now["size"])
            if anew or now["size"] > before["size"]:
                ranges.append((file, 0 if anew else before["size"], now["size"]))
        return split(ranges) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return read_ranges(partition.ranges)


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skeinlog"

    def schema(self) -> str:
        return SCHEMA

    def dialect(self) -> transcripts.Dialect:
        """What a listing has to know of the dialect: sources are planned in a process of their own, where a dialect that
        was registered in this one is unknown."""
        name = self.options.get("dialect", "blocks")
        known = transcripts.DIALECTS.get(name)
        layout, prefix = self.options.get("layout", known and known.layout), self.options.get("prefix", known and known.prefix)
        if layout is None:
            raise ValueError(f"dialect {name!r} is not known: give its layout and prefix as options, as files.lines does")
        return transcripts.Dialect(name, layout, None, None, None, prefix or "")

    def reader(self, schema) -> LineReader:
        return LineReader(self.options["path"], self.dialect())

    def streamReader(self, schema) -> LineStream:
        since = self.options.get("since")
        return LineStream(self.options["path"], self.dialect(), float(since) if since else None)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format "skeinlog" known, and has Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LineSource)
    return spark


def _told(reader, dialect: str):
    d = transcripts.DIALECTS[dialect]
    return reader.format("skeinlog").option("dialect", dialect).option("layout", d.layout).option("prefix", d.prefix)


def lines(spark: SparkSession, root: str, dialect: str) -> DataFrame:
    """The lines of a dialect's root; filter it to have it list and read less."""
    return _told(register(spark).read, dialect).load(root)


def stream(spark: SparkSession, root: str, dialect: str, since: float | None = None) -> DataFrame:
    reader = _told(register(spark).readStream, dialect)
    return (reader if since is None else reader.option("since", str(since))).load(root)


def listing(spark: SparkSession, root: str, dialect: str, bounds: Bounds | None = None, repos: Iterable[str] | None = None) -> DataFrame:
    """folder, day, path, modified and size of the files, as a listing tells; repos: only folders of these roots. The
    driver lists what is above the folders, and these too where they are few; else each is listed by a task."""
    bounds = bounds or Bounds()
    if repos is not None:
        own = transcripts.folder_test(repos)
        bounds.kept.append(lambda at, x: at != "folder" or x is None or own(x))
    folders, d = list_folders(root, dialect, bounds), transcripts.DIALECTS[dialect]
    if len(folders) <= LISTED_HERE:
        return spark.createDataFrame(_table([_row(f) for folder in folders for f in files_in(*folder, d, bounds)]))
    each = spark.createDataFrame(folders, "folder string, day date, at string").repartition(min(len(folders), 1000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _table([_row(f) for f in files_in(*folder, d, bounds)]).to_batches()

    return each.mapInArrow(run, "folder string, day date, path string, modified timestamp, size bigint")


def _table(rows: list[list]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(FILE)], schema=FILE)


def _map_files(files: DataFrame, run: Callable[[Iterator[list]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over the files of each task, which are dealt out evenly by path."""
    files = files.select("folder", "day", "path", "modified", "size")
    files = files.repartition("path")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run([c for c in zip(*(col.to_pylist() for col in batch.columns), strict=True)] for batch in batches)

    return files.mapInArrow(each, schema)


def read_ends(files: DataFrame, dialect: str, window: int = WINDOW, most: int = MAX_WINDOW) -> DataFrame:
    """SCHEMA's rows of the ends of files (folder, day, path, modified, size); whole says where that is all."""
    seen = transcripts.DIALECTS[dialect].seen

    def run(batches: Iterator[list]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for file in batch:
                    if (f := _opened(file[2])) is None:
                        continue
                    with f:
                        whole, found = end_lines(f, file[4], seen, window, most)
                    for start, line in found:
                        yield list(file), start, line, whole

        return batches_of(rows())

    return _map_files(files, run, SCHEMA)


def probe(files: DataFrame, dialect: str, lines: int = PROBE_LINES) -> DataFrame:
    """files with cwd, the first working directory that their first lines name (null: none)."""
    cwd = transcripts.DIALECTS[dialect].cwd
    form = pa.schema([*FILE, pa.field("cwd", pa.string())])

    def run(batches: Iterator[list]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file in batch:
                if (f := _opened(file[2])) is not None:
                    with f:
                        out.append([*file, early_cwd(f, file[4], cwd, lines)])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(form)], schema=form)

    return _map_files(files, run, "folder string, day date, path string, modified timestamp, size bigint, cwd string")


def read_whole(files: DataFrame) -> DataFrame:
    """SCHEMA's rows of whole files (folder, day, path, modified, size), each range of a file in a task of its own."""
    rows = files.withColumn("_at", F.explode(F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("size") - 1, F.lit(SPLIT_BYTES))).otherwise(F.array().cast("array<bigint>"))))
    rows = rows.select("folder", "day", "path", "modified", "size", "_at").repartition("path", "_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = [(File(*row[:5]), row[5], min(row[4], row[5] + SPLIT_BYTES)) for row in zip(*(col.to_pylist() for col in batch.columns), strict=True)]
            yield from read_ranges(ranges)

    return rows.mapInArrow(run, SCHEMA)


def write_lines(lines: DataFrame, root: str) -> DataFrame:
    """Writes lines (file, line_no, line) as files under root when it is run: a row of file and bytes for each. A file is
    written by one task in order, as it comes; a task that is repeated writes it again."""
    rows = lines.select("file", "line_no", "line").repartition("file").sortWithinPartitions("file", "line_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, done = None, None, []

        def close() -> None:
            if out is not None:
                done.append((name, out.tell()))
                out.close()

        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if file != name:
                    close()
                    store, at = store_of(f"{root}/{file}")
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    name, out = file, store.open_output_stream(at)
                out.write(line.encode() + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([b for _, b in done], pa.int64())], names=["file", "bytes"])

    return rows.mapInArrow(run, "file string, bytes bigint")
