"""Inventory of ZIP archives, nested ones too, as rows; text members can then be scanned as DataFrames.

Small archives come from Spark's binaryFile source: one archive is one row and
is walked inside one task.  Large ones are split: a task reads an archive's
directory only, and runs of its members are dealt to tasks of their own, which
seek to them.  Limits hold for members, depth and decompressed bytes; what a
limit or damage stops is a row with a problem, never left out silently.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import with_running_sum
from ..shared import SharedTable

MEMBERS = "archive string, ordinal long, depth int, filename string, file_size long, compress_size long, method int, flags int, crc long, problem string, content string"

# Suffixes of text files; byte order marks, longest first.
TEXT_SUFFIXES = frozenset(".md .txt .py .pyi .rs .toml .c .cc .cpp .h .hh .hpp .inc .json .jsonl .yml .yaml .xml .svg .js .mjs .cjs .ts .tsx .jsx .csv .tsv .tex .rst .html .htm .css .scss .sh .bash .zsh .ps1 .bat .cmd .java .kt .kts .go .rb .php .swift .scala .sql .ini .cfg .conf .properties .lock .lean .lake .cmake".split())
MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


@dataclass(frozen=True)
class Limits:
    members: int = 10_000
    depth: int = 4
    member_bytes: int = 64 << 20
    total_bytes: int = 1 << 30
    text_bytes: int = 4 << 20


def decode(raw: bytes) -> str:
    """By byte order mark, else as UTF-8; raises on damage."""
    return raw.decode(next((name for mark, name in MARKS if raw.startswith(mark)), "utf-8"))


def textual(raw: bytes) -> bool:
    """At most one in a hundred control characters among the first 4096 bytes."""
    head = raw[:4096]
    if any(head.startswith(mark) for mark, _ in MARKS):
        return True
    odd = sum(b < 32 and b not in b"\t\n\r\f" for b in head)
    return bool(head) and b"\0" not in head and odd * 100 <= len(head)


def unsafe(name: str) -> str | None:
    """Why a member's name can't be trusted."""
    plain = name.replace("\\", "/")
    if not name or "\0" in name:
        return "empty or NUL name"
    if plain.startswith("/") or re.match(r"[A-Za-z]:", name):
        return "absolute path"
    return "parent traversal" if ".." in plain.split("/") else None


class Walk:
    """Rows of MEMBERS of an archive and of those in it, depth first, with what the walk has used of its limits."""

    def __init__(self, limits: Limits):
        self.limits, self.members, self.bytes = limits, 0, 0

    def row(self, label, depth, info, problem, content=None) -> tuple:
        self.members += 1
        name = info.filename if info else None
        numbers = (info.file_size, info.compress_size, info.compress_type, info.flag_bits, info.CRC) if info else (None,) * 5
        return (label, self.members - 1, depth, name, *numbers, problem, content)

    def archive(self, label: str, file, depth: int = 0) -> Iterator[tuple]:
        opened, problem = directory(file)
        if problem:
            yield self.row(label, depth, None, problem)
            return
        if (text := prefix_text(file, first_offset(opened.infolist()), self.limits)) is not None:
            yield self.row(label, depth, None, "prefix before the first member", text)
        for info in opened.infolist():
            if self.members >= self.limits.members:
                yield self.row(label, depth, info, "member limit")
                return
            yield from self.member(label, opened, info, depth)

    def member(self, label: str, opened: zipfile.ZipFile, info: zipfile.ZipInfo, depth: int) -> Iterator[tuple]:
        limits = self.limits
        if not readable(info):
            yield self.row(label, depth, info, refusal(info))
            return
        if info.file_size > limits.member_bytes or self.bytes + info.file_size > limits.total_bytes:
            yield self.row(label, depth, info, "byte limit")
            return
        try:
            with opened.open(info) as member:
                data = member.read(info.file_size + 1)
        except Exception as error:  # noqa: BLE001  damaged streams raise all kinds of errors
            yield self.row(label, depth, info, f"unreadable: {type(error).__name__}")
            return
        if len(data) != info.file_size:
            yield self.row(label, depth, info, "wrong size")
            return
        self.bytes += len(data)
        suffix = "." + info.filename.rpartition(".")[2].lower() if "." in info.filename else ""
        if data[:4] in (b"PK\x03\x04", b"PK\x05\x06") or suffix == ".zip":
            yield self.row(label, depth, info, None if depth < limits.depth else "depth limit")
            if depth < limits.depth:
                yield from self.archive(f"{label}!{info.filename}", io.BytesIO(data), depth + 1)
        elif suffix not in TEXT_SUFFIXES and not textual(data):
            yield self.row(label, depth, info, None)
        elif len(data) > limits.text_bytes:
            yield self.row(label, depth, info, "text limit")
        else:
            try:
                yield self.row(label, depth, info, None, decode(data))
            except (UnicodeDecodeError, LookupError) as error:
                yield self.row(label, depth, info, f"undecodable: {type(error).__name__}")


def directory(file) -> tuple[zipfile.ZipFile | None, str | None]:
    """The archive with its directory read, or why there is none."""
    try:
        return zipfile.ZipFile(file), None
    except (zipfile.BadZipFile, ValueError, NotImplementedError, EOFError) as error:
        return None, f"invalid archive: {type(error).__name__}"


def first_offset(infos: list[zipfile.ZipInfo]) -> int:
    return min((i.header_offset for i in infos), default=0)


def prefix_text(file, prefix: int, limits: Limits) -> str | None:
    """Text before the first member, such as a script that unpacks the archive."""
    if prefix == 0:
        return None
    file.seek(0)
    raw = file.read(min(prefix, max(limits.text_bytes, 4096)))
    return raw[: limits.text_bytes].decode("utf-8", "replace") if textual(raw) else None


def refusal(info: zipfile.ZipInfo) -> str | None:
    """Why a member isn't read, as far as the directory tells."""
    if why := unsafe(info.filename):
        return why
    if info.is_dir():
        return "directory with content" if info.file_size else None
    return "encrypted" if info.flag_bits & 1 else None


def readable(info: zipfile.ZipInfo) -> bool:
    return refusal(info) is None and not info.is_dir()


def archive_members(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Rows of MEMBERS of a DataFrame with ``path`` and ``content``, such as binaryFile gives; a null content has no members."""
    limits = limits or Limits()

    def run(batches):
        import pandas as pd

        names = [c.split(" ")[0] for c in MEMBERS.split(", ")]
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                found = list(Walk(limits).archive(path, io.BytesIO(raw))) if raw is not None else []
                yield pd.DataFrame(found, columns=names).astype({n: "Int64" for n in ("ordinal", "depth", "file_size", "compress_size", "method", "flags", "crc")})

    return files.select("path", "content").mapInPandas(run, MEMBERS)


class Sought(io.RawIOBase):
    """Arrow's file as Python's readers know one: seeking before its start is an OSError."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.file.tell()

    def seek(self, offset, whence=0):
        at = offset + (0, self.file.tell() if whence == 1 else 0, self.file.size() if whence == 2 else 0)[whence]
        if at < 0:
            raise OSError("before the start of the file")
        return self.file.seek(at)

    def readinto(self, into):
        return self.file.readinto(into)

    def close(self):
        self.file.close()
        super().close()


def opened_at(path: str):
    """A file that can be sought in, on any file system that Arrow knows; a path without a scheme is local."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    system, inner = fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)
    return io.BufferedReader(Sought(system.open_input_file(inner)), 1 << 16)


#: Decompressed bytes and number of the members that are read together, about; a larger member is read by itself.
RUN_BYTES, RUN_MEMBERS = 64 << 20, 10_000
#: Members and bytes of the rows that are passed on together.
ROWS_TOGETHER, BYTES_TOGETHER = 10_000, 8 << 20
#: What a member's directory entry says beside its names: ``numbers`` has so many for each member.
NUMBERS = ("header_offset", "_end_offset", "file_size", "compress_size", "compress_type", "flag_bits", "CRC")
RUNS = "archive string, run long, first long, members long, bytes long, problem string"
#: What readers of a run need of the directory, so that they don't read it again.
ENTRIES = "prefix long, before long, names array<string>, originals array<string>, numbers array<long>"
UNKNOWN = -(1 << 63)
#: An archive without members.
EMPTY = b"PK\x05\x06" + bytes(18)


def _entries(infos: list[zipfile.ZipInfo]) -> tuple[list[str], list[str], list[int]]:
    numbers = [UNKNOWN if (n := getattr(i, field, None)) is None else n for i in infos for field in NUMBERS]
    return [i.filename for i in infos], [i.orig_filename for i in infos], numbers


def _infos(names, originals, numbers) -> list[zipfile.ZipInfo]:
    infos = []
    for at, (name, original) in enumerate(zip(names, originals)):
        info = zipfile.ZipInfo(original)
        info.filename = name
        for field, n in zip(NUMBERS, numbers[at * len(NUMBERS) : (at + 1) * len(NUMBERS)]):
            if n != UNKNOWN:
                setattr(info, field, int(n))
        infos.append(info)
    return infos


def archive_runs(paths: DataFrame, limits: Limits | None = None, run_bytes: int = RUN_BYTES) -> DataFrame:
    """RUNS and ENTRIES: runs of neighbouring members of each archive in ``path``, from the directories alone, each of which is read once.

    An archive that can't be opened is a row with the problem.
    """
    limits = limits or Limits()
    columns = [c.split(" ")[0] for c in f"{RUNS}, {ENTRIES}".split(", ")]

    def runs_of(path):
        try:
            file = opened_at(path)
        except OSError as error:
            yield path, 0, 0, 0, 0, f"invalid archive: {type(error).__name__}", 0, 0, [], [], []
            return
        with file:
            opened, problem = directory(file)
            infos = opened.infolist() if opened else []
        runs = [[0, 0, 0]]
        for at, i in enumerate(infos):
            size = min(i.file_size, limits.member_bytes) if readable(i) else 0
            if runs[-1][1] and (runs[-1][2] + size > run_bytes or runs[-1][1] == RUN_MEMBERS):
                runs.append([at, 0, 0])
            runs[-1][1] += 1
            runs[-1][2] += size
        prefix, before = first_offset(infos), 0
        for number, (first, members, size) in enumerate(runs):
            yield path, number, first, members, size, problem, prefix, before, *_entries(infos[first : min(first + members, limits.members + 1)])
            before += sum(i.file_size for i in infos[first : min(first + members, limits.members)] if counted(i, limits))

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path in batch["path"].dropna():
                held, members = [], 0
                for row in runs_of(path):
                    held.append(row)
                    members += row[3]
                    if members >= ROWS_TOGETHER:
                        yield pd.DataFrame(held, columns=columns)
                        held, members = [], 0
                if held:
                    yield pd.DataFrame(held, columns=columns)

    return paths.select("path").repartition(_width(paths), "path").distinct().mapInPandas(run, f"{RUNS}, {ENTRIES}")


def _width(df: DataFrame) -> int:
    """Partitions of rows that are few bytes and much work; Spark would put them together by their bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def counted(info: zipfile.ZipInfo, limits: Limits) -> bool:
    """Whether a member counts towards the bytes of the whole archive."""
    return readable(info) and info.file_size <= limits.member_bytes


def split_archive_members(paths: DataFrame, limits: Limits | None = None, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The rows of archive_members() of archives at ``path`` (no contents): each run of members is read by seeking, in any task.

    ``ordinal`` is the place in the whole archive.  ``depth`` and the limits of
    members and total bytes hold within a member of the archive and all that it
    contains; for the archive as a whole, members past ``members`` and bytes past ``total_bytes`` are
    left unread by the directory's sizes and have rows that say so.
    """
    limits = limits or Limits()
    names = [c.split(" ")[0] for c in MEMBERS.split(", ")]

    def members_of(file, run):
        """Rows of a run's members, with their places in the archive."""
        path, first = run["archive"], run["first"]
        if run["run"] == 0 and (text := prefix_text(file, run["prefix"], limits)) is not None:
            yield -1, *Walk(limits).row(path, 0, None, "prefix before the first member", text)
        # The entries have been read: an empty archive is given the file, and opens members by their entries.
        opened, before = zipfile.ZipFile(io.BytesIO(EMPTY)), run["before"]
        opened.fp = file
        for at, info in enumerate(_infos(run["names"], run["originals"], run["numbers"]), first):
            if at == limits.members:
                yield at, *Walk(limits).row(path, 0, info, "member limit")
                return
            walk = Walk(limits)
            before += info.file_size if counted(info, limits) else 0
            rows = [walk.row(path, 0, info, "byte limit")] if counted(info, limits) and before > limits.total_bytes else walk.member(path, opened, info, 0)
            for r in rows:
                yield at, *r

    def run(batches):
        import pandas as pd

        def table(found):
            out = pd.DataFrame([r for _, r in found], columns=["_at", *names])
            out["_archive"] = [path for path, _ in found]
            return out.astype({n: "Int64" for n in ("_at", "ordinal", "depth", "file_size", "compress_size", "method", "flags", "crc")})

        found, size, path, file = [], 0, None, None
        try:
            for batch in batches:
                for own in batch.to_dict("records"):
                    if own["problem"] is not None:
                        found.append((own["archive"], (-1, *Walk(limits).row(own["archive"], 0, None, own["problem"]))))
                        continue
                    if own["archive"] != path:
                        if file is not None:
                            file.close()
                        path, file = own["archive"], opened_at(own["archive"])
                    for row in members_of(file, own):
                        found.append((path, row))
                        size += len(row[-1] or "")
                        if len(found) >= ROWS_TOGETHER or size >= BYTES_TOGETHER:
                            yield table(found)
                            found, size = [], 0
            if found:
                yield table(found)
        finally:
            if file is not None:
                file.close()

    runs = archive_runs(paths, limits, run_bytes)
    read = runs.repartition(_width(paths), "archive", "run").mapInPandas(run, f"_at long, {MEMBERS}, _archive string")
    # One narrow row a member's tree gives the places; contents don't pass through the window.
    read = SharedTable(read, "members").df
    trees = read.groupBy("_archive", "_at").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_archive").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = trees.select("_archive", "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return read.join(starts, ["_archive", "_at"]).withColumn("ordinal", F.col("ordinal") + F.col("_start")).select(*names)


def read_split_archives(spark: SparkSession, path: str, limits: Limits | None = None, run_bytes: int = RUN_BYTES) -> DataFrame:
    """split_archive_members() of the archives in a folder, of which Spark only lists the names."""
    return split_archive_members(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path"), limits, run_bytes)


def read_archives(spark: SparkSession, path: str, limits: Limits | None = None) -> DataFrame:
    return archive_members(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path), limits)


def summary(members: DataFrame) -> DataFrame:
    """One row of counts; complete only if no row has a problem."""
    return members.agg(
        F.count("*").alias("members"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"),
        F.count("content").alias("text_members"), F.count("problem").alias("problems"), (F.count("problem") == 0).alias("complete"),
    )


def within_budget(rows: DataFrame, order: list[str], size: str, most: int, by: list[str] | None = None) -> DataFrame:
    """All columns, ``used`` and ``within``: the running sum in order, and whether it is still at most ``most``.

    With ``by`` each group has a budget of its own.  A group of any size is
    summed by ranges.
    """
    return with_running_sum(rows, order, size, "used", by).withColumn("within", F.col("used") <= most)
