"""Files as numbered lines, and JSON lines as walked strings; what cannot be read is a row too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.walk import parsed, shown, strings

_WALKED = "file string, line long, path string, text string, is_key boolean, unread string"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content, scannable: gzip members are listed but not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", "content", (~F.startswith("content", F.lit(b"\x1f\x8b"))).alias("scannable"))


def unscanned(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """file, why of everything below the folder that is listed and not read: compressed files, links, and what has no rights to be read."""
    packed = found.filter("NOT scannable").select(F.col("path").alias("file"), F.lit("compressed").alias("why"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    local = path.toUri().getScheme() in (None, "file")
    odd = spark.createDataFrame(_local_oddities(path.toUri().getPath()) if local else [], "file string, why string")
    return packed.unionByName(odd)


def _local_oddities(root: str) -> list[tuple[str, str]]:
    """Links are not followed, neither to files nor to folders: only local folders have them. Listed on the driver, names alone."""
    import os

    out = []
    for at, folders, names in os.walk(root, onerror=lambda e: out.append((e.filename, "unreadable"))):
        for name in sorted([*folders, *names]):
            full = os.path.join(at, name)
            if os.path.islink(full):
                out.append((full, "symlink"))
            elif name in names and not os.access(full, os.R_OK):
                out.append((full, "unreadable"))
    return sorted(out)


def lines(found: DataFrame) -> DataFrame:
    """file, line (from 1), data: a last line without its end counts only if there is something in it."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py().removeprefix(b"\xef\xbb\xbf").split(b"\n")
                if not data[-1]:
                    data.pop()
                for a in range(0, len(data), 10_000):
                    part = data[a : a + 10_000]
                    yield pa.record_batch([pa.array([path] * len(part), pa.string()), pa.array(range(a + 1, a + len(part) + 1), pa.int64()), pa.array([x.removesuffix(b"\r") for x in part], pa.binary())], names=["file", "line", "data"])

    return found.filter("scannable").select("path", "content").mapInArrow(cut, "file string, line long, data binary")


def walked(numbered: DataFrame) -> DataFrame:
    """Each line's strings and keys with their paths; a line that is no JSON gives one row that says why."""

    def walk(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for file, line, data in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist(), batch.column("data").to_pylist(), strict=True):
                value, why = parsed(data)
                if why:
                    out.append((file, line, None, None, False, why))
                else:
                    out += [(file, line, shown(p), t.encode("utf-8", "replace").decode(), k, None) for p, t, k in strings(value)]
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["file", "line", "path", "text", "is_key", "unread"])

    return numbered.select("file", "line", "data").mapInArrow(walk, _WALKED)


def places(strings_: DataFrame) -> DataFrame:
    """Where a session's string stands, by its path alone: a tool call, the model's context, stored, or unknown."""
    p = F.col("path")
    place = F.when(p.rlike(r"(^|\.)(input|arguments|args)(\.|\[|$)"), "tool_call").when(p.rlike(r"^message\.content|(^|\.)(content|text)(\.|\[|$)"), "context").when(p.rlike(r"^(toolUseResult|snapshot|attachment)"), "stored").otherwise("unknown")
    return strings_.withColumn("place", place)
