"""A folder of tables that grows by whole segments, of which a reader sees one version.

A write makes a new segment, a folder with its own rows of one or more tables, and
then a new version, a small file with the list of segments. A version file is made
once and never changed, so a reader beside a writer, or after one that failed, sees
the version before. Two writers can't make the same version: the second one raises
``Conflict`` and starts again from the new version. A segment can carry the name of
the batch that it came from; a batch that a version has is not written again.

Defined cases: a folder that isn't there is version 0, without segments; a version
file that was cut off while it was written doesn't count.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

END = "\n."


class Conflict(RuntimeError):
    """Another writer was faster."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    segments: list[dict] = field(default_factory=list)  # name, number of the version it came with, tables, batch

    @property
    def batches(self) -> set[str]:
        return {s["batch"] for s in self.segments if s.get("batch")} | {b for s in self.segments for b in s.get("batches", [])}


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, path: str) -> Version:
    """The last whole version."""
    files, at = _files(spark, f"{path}/versions")
    if not files.exists(at):
        return Version()
    names = sorted((s.getPath().toString() for s in files.listStatus(at) if s.getPath().getName().endswith(".json")), reverse=True)
    for name in names:
        text = "\n".join(r.value for r in spark.read.text(name).collect())
        if text.endswith(END):
            said = json.loads(text.removesuffix(END))
            return Version(said["number"], said["segments"])
    return Version()


def commit(spark: SparkSession, path: str, based: Version, segments: list[dict]) -> Version:
    """The version after ``based``; raises ``Conflict`` where there is one already."""
    new = Version(based.number + 1, segments)
    name = f"{path}/versions/{new.number:012d}.json"
    files, at = _files(spark, name)
    if files.exists(at) or current(spark, path).number != based.number:
        raise Conflict(name)
    try:
        out = files.create(at, False)
    except Exception as e:  # made between the look and now
        raise Conflict(name) from e
    try:
        out.write(bytearray((json.dumps({"number": new.number, "segments": segments}) + END).encode()))
    finally:
        out.close()
    return new


def new_segment(based: Version, batch: str | None = None) -> dict:
    return {"name": uuid.uuid4().hex, "number": based.number + 1, "tables": [], "batch": batch}


def put(df: DataFrame, path: str, segment: dict, table: str) -> DataFrame:
    """Writes a table of a segment, and reads it again."""
    at = f"{path}/segments/{segment['name']}/{table}"
    df.write.parquet(at)
    segment["tables"].append(table)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def rows(spark: SparkSession, path: str, version: Version, table: str, schema: str) -> DataFrame:
    """The table's rows of all segments of a version."""
    found = [f"{path}/segments/{s['name']}/{table}" for s in version.segments if table in s["tables"]]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*found)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the segments that the current version doesn't have, once no reader of an older one is left; gives their number."""
    files, at = _files(spark, f"{path}/segments")
    if not files.exists(at):
        return 0
    used = {s["name"] for s in current(spark, path).segments}
    gone = [s.getPath() for s in files.listStatus(at) if s.getPath().getName() not in used]
    for p in gone:
        files.delete(p, True)
    return len(gone)
