"""Package archives as rows of files.

Archives are read whole by Spark's binary reader and opened in memory, never on disk and never run. One bad archive is
one error row. Limits are those of the admission rules: too many files or too many bytes is an error, and of a large
file the first part is kept.
"""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.scalars import digest

# Fixed values.
MAX_FILES, MAX_FILE, MAX_TOTAL, KEPT = 20_000, 32 << 20, 512 << 20, 4 << 20
FILES = "digest string, ecosystem string, file_idx int, path string, content binary, size long, truncated boolean, unpack_error string"


def logical_path(ecosystem: str, name: str) -> str:
    """Clean path without the archive's own root: npm's is package/, others' whatever comes first."""
    p = posixpath.normpath("/" + name.removeprefix("./").lstrip("/"))[1:]  # no way out of the archive
    if ecosystem == "npm":
        return p.removeprefix("package/")
    return p.partition("/")[2] if "/" in p else p


def _members(kind: str, data: bytes) -> Iterator[tuple[str, int, object]]:
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    with z.open(i) as f:
                        yield i.filename, i.file_size, f
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as t:
            for m in t:
                if m.isreg():
                    yield m.name, m.size, t.extractfile(m)


def archive_kind(ecosystem: str, data: bytes, filename: str | None = None) -> str:
    """By name if there is one, else by the first bytes; npm packages are always tarballs."""
    if ecosystem != "npm" and (filename.endswith(".whl") if filename else data[:4] == b"PK\x03\x04"):
        return "zip"
    return "tar.gz"


def unpack(ecosystem: str, data: bytes, filename: str | None = None) -> list[tuple[str, bytes, int, bool]]:
    """path, kept content, size, truncated of each regular file in archive order. Raises ValueError beyond a limit."""
    out, total = [], 0
    for name, size, f in _members(archive_kind(ecosystem, data, filename), data):
        if len(out) >= MAX_FILES:
            raise ValueError("too many files")
        if size > MAX_FILE:
            raise ValueError(f"file too large: {name}")
        total += size
        if total > MAX_TOTAL:
            raise ValueError("archive too large")
        kept = f.read(KEPT)
        out.append((logical_path(ecosystem, name), kept, size, size > len(kept)))
    return out


def unpacked(artifacts: DataFrame) -> DataFrame:
    """Rows of files from artifacts (digest, ecosystem, filename or null, content); a bad archive is one row with
    unpack_error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FILES.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.string()]
        for b in batches:
            for r in zip(*(b.column(c) for c in ("digest", "ecosystem", "filename", "content")), strict=True):
                d, eco, name, data = (x.as_py() for x in r)
                try:
                    rows = [(d, eco, i, *f, None) for i, f in enumerate(unpack(eco, data or b"", name))]
                except Exception as e:  # anything may be in an archive
                    rows = [(d, eco, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                for k in range(0, len(rows), 16):  # batches stay small whatever the files weigh
                    part = list(zip(*rows[k : k + 16], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(part, types, strict=True)], names)

    return artifacts.select("digest", "ecosystem", "filename", "content").mapInArrow(run, FILES)


def read_archives(spark: SparkSession, path: str, ecosystem: str) -> DataFrame:
    """digest, ecosystem, filename, content of every archive below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(digest(F.col("content")).alias("digest"), F.lit(ecosystem).alias("ecosystem"), F.substring_index("path", "/", -1).alias("filename"), "content")


def files_of(rows: DataFrame) -> DataFrame:
    return rows.filter("unpack_error IS NULL").drop("unpack_error")


def unpack_findings(rows: DataFrame) -> DataFrame:
    """A finding for each archive that could not be opened; the live gate counts it, the offline scorer doesn't."""
    from palisade.functions import fixed

    rule, severity, description = fixed.GATE_RULES["unpack"]
    bad = rows.filter("unpack_error IS NOT NULL")
    return bad.select("digest", F.lit("static").alias("stage"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(description).alias("description"), F.col("unpack_error").alias("evidence"), F.lit(-2000).cast("long").alias("ord"))
