"""Snapshots: JSON arrays of documents, read and written; HTML file sources; uploads.

Defined cases: absent fields are null; a file without documents has no rows; what isn't an
array raises; items of an upload that can't be used stay as rows with their error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.operators.diff import hierarchy_items
from loomwell.operators.sequence import numbered
from loomwell.sources.shared import written

DOCUMENT = T.StructType(
    [
        T.StructField("docId", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("murl", T.StringType()),
        T.StructField("hierarchy", T.ArrayType(T.StringType())),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("startdate", T.StringType()),
        T.StructField("enddate", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)


def _run_sum(rows: DataFrame, value: str, into: str) -> DataFrame:
    """The sum of ``value`` over all rows before in the order of block and row: windows inside blocks, and one offset for each block."""
    sums = rows.groupBy("file", "start").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block of 128 MB
    offsets = sums.select("file", "start", before.alias("__before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("file", "start").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__inside", inside).join(offsets, ["file", "start"]).withColumn(into, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """(ord, item): the items of a JSON array, as JSON; scalars as their text. No task holds the file.

    ``path`` is a file, or a folder whose files make the array in the order of their
    names. Spark cuts it at every ``}``, in blocks of bytes. Which of these stand in
    a string follows from the quotes before, which stand at the end of an item from
    the braces and brackets before; both are running sums over blocks. The pieces up
    to the end of an item are put together and parsed. A byte order mark is skipped;
    a top level that is no array, and what can't be parsed, raises; an empty array,
    and a file of white space alone, has no items.
    """
    read = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("row"), "value")
    pieces = written(read, "pieces")
    # the last piece of a file has no } behind it, unless the bytes say that it has
    ends_of = pieces.groupBy("file").agg(F.max(F.struct("start", "row")).alias("end"), (F.sum(F.octet_length("value") + 1) - F.first("size")).isin(1, -2).alias("short"))  # -2: the reader skips a byte order mark
    cut = F.col("short") & (F.col("start") == F.col("end.start")) & (F.col("row") == F.col("end.row"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    # what stands outside of strings, of a piece that begins in one or not; a } after it does, unless a string is still open
    outside = lambda x: F.regexp_replace(x, r'(?s)"[^"]*(?:"|$)', "")
    level = lambda x: F.regexp_count(x, F.lit(r"[\[{]")) - F.regexp_count(x, F.lit(r"\]"))
    marks = pieces.join(ends_of, "file").select("file", "start", "row", cut.alias("cut"), bare.alias("bare"))
    marks = marks.select("file", "start", "row", "cut", F.regexp_count("bare", F.lit('"')).alias("quotes"), level(outside(F.col("bare"))).alias("level"), level(outside(F.regexp_replace("bare", r'(?s)^[^"]*(?:"|$)', ""))).alias("level_in"))
    # a row of numbers for each piece goes through the sums, and no text
    marks = _run_sum(written(marks, "marks"), "quotes", "quotes_before")
    closes = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0) & ~F.col("cut")
    change = F.when(F.col("quotes_before") % 2 == 1, F.col("level_in")).otherwise(F.col("level")) - closes.cast("int")
    marks = _run_sum(marks.select("file", "start", "row", "cut", closes.alias("closes"), change.alias("change")), "change", "depth")
    # the array itself is at depth 1 once its bracket is open
    ends = F.col("closes") & (F.col("depth") + F.col("change") == 1)
    placed = written(_run_sum(marks.withColumn("ends", ends.cast("int")), "ends", "group").select("file", "start", "row", "cut", "group"), "placed")
    last = placed.agg(F.max(F.struct("file", "start", "row")).alias("at"), F.max("group").alias("group")).first()
    if last["at"] is None:
        return spark.createDataFrame([], "ord long, item string")
    pieces = pieces.join(placed, ["file", "start", "row"])
    here = F.struct("file", "start", "row")
    is_last = (F.col("file") == last["at"].file) & (F.col("start") == last["at"].start) & (F.col("row") == last["at"].row)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(here.alias("at"), F.when(F.col("cut"), F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("v")))), lambda p: p["v"]), "")
    groups = pieces.groupBy("group").agg(whole.alias("json"), F.max(is_last.cast("int")).alias("is_last"))
    # each group without the array's own brackets and the comma before it, as an array of its own
    text = F.when(F.col("group") == 0, F.regexp_replace("json", "^\uFEFF?\\s*", "")).otherwise(F.regexp_replace("json", r"^\s*", ""))
    groups = groups.withColumn("text", text)
    groups = groups.filter(~((F.col("group") == 0) & (F.col("text") == "")))
    bad = F.raise_error(F.lit("the snapshot's top level is not an array"))
    begun = F.when(F.col("group") == 0, F.when(F.col("text").startswith("["), F.substring("text", 2, 2147483647)).otherwise(bad)).when(F.regexp_like("text", F.lit(r"^\]\s*$")), F.lit("]")).when(F.col("text").startswith(","), F.substring("text", 2, 2147483647)).otherwise(bad)
    whole_end = F.when(F.col("is_last") == 1, F.when(F.regexp_like("begun", F.lit(r"(?s)\]\s*$")), F.regexp_replace("begun", r"\]\s*$", "")).otherwise(F.raise_error(F.lit("the snapshot's array has no end")))).otherwise(F.col("begun"))
    listed = groups.withColumn("begun", begun).withColumn("body", whole_end)
    items = listed.withColumn("items", F.from_json(F.concat(F.lit("["), "body", F.lit("]")), T.ArrayType(T.StringType()), {"mode": "FAILFAST"})).select("group", "items")
    items = written(items.filter(F.size("items") > 0), "items")
    # nearly always one item a group; where scalars stand between objects the places after them move on
    more = items.filter(F.size("items") > 1).select(F.col("group").alias("wide"), (F.size("items") - 1).alias("extra"))
    if more.isEmpty():
        return items.select(F.col("group").cast("long").alias("ord"), F.explode("items").alias("item"))
    each = items.select("group", F.posexplode("items").alias("i", "item"))
    return numbered(each, ["group", "i"], "ord").select(F.col("ord").cast("long").alias("ord"), "item")


def _parsed(items: DataFrame, schema: T.StructType) -> DataFrame:
    return items.select("ord", F.from_json("item", schema, {"mode": "FAILFAST"}).alias("d")).select("ord", "d.*")


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT, items: DataFrame | None = None) -> DataFrame:
    """A snapshot (one JSON array, with or without a byte order mark): its documents, numbered in ``ord``.

    A hierarchy may be a list, an object of levels or a scalar: ``hierarchy`` is its
    path, ``hierarchy_json`` the JSON itself. What ``array_items`` raises for raises.
    ``items``: what ``array_items`` gave for the path, where it was read already.
    """
    open_ = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "hierarchy" else f for f in schema.fields])
    rows = _parsed(array_items(spark, path) if items is None else items, open_)
    if "hierarchy" not in rows.columns:
        return rows
    return rows.withColumn("hierarchy_json", F.col("hierarchy")).withColumn("hierarchy", hierarchy_items(F.col("hierarchy_json")))


def read_upload(spark: SparkSession, path: str, items: DataFrame | None = None) -> DataFrame:
    """An uploaded ``.json`` file's documents, each object with what it has; ``error`` says what is wrong with an item, null for a good one.

    Items that aren't objects, or have no id, stay as rows with an error. Another
    kind of file raises. ``items`` as in ``read_snapshot``.
    """
    if not path.rstrip("/").lower().endswith(".json"):
        raise ValueError("only .json files can be uploaded")
    listed = array_items(spark, path) if items is None else items
    row = F.from_json("item", T.StructType([T.StructField(f.name, T.StringType()) for f in DOCUMENT.fields]))
    error = F.when(~F.coalesce(F.ltrim("item").startswith("{"), F.lit(False)), "the item is not an object").when(F.coalesce("d.docId", F.lit("")) == "", "the document has no docId")
    return listed.select("ord", "item", row.alias("d")).select("ord", "d.*", error.alias("error"))


def write_snapshot(docs: DataFrame, path: str, order: str = "ord") -> bool:
    """One JSON array, non-ASCII characters as they are, in files that make it in the order of their names; nothing is
    written for no rows. Small snapshots are one file, large ones as many as Spark's ranges of ``order``."""
    if docs.isEmpty():
        return False
    fields = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != order])
    lines = numbered(docs.select(F.col(f"`{order}`").alias("__order"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("__json")), ["__order", "__json"], "line")
    n = docs.count()
    place = F.col("line")
    value = F.concat(F.when(place == 0, "[").otherwise(","), F.col("__json"), F.when(place == n - 1, "]").otherwise(""))
    lines.repartitionByRange(place).sortWithinPartitions(place).select(value.alias("value")).write.text(path)
    return True


def read_lines(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    """A snapshot as JSON lines, the form for large ones; malformed lines go to ``_corrupt_record``."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_lines(docs: DataFrame, path: str) -> None:
    """JSON lines, as many files as there are partitions; non-ASCII characters stay."""
    docs.write.option("ignoreNullFields", False).json(path)


def upload_rows(docs: DataFrame) -> DataFrame:
    """Uploaded documents under the retrieval side's names; rows without an id or text are left out."""
    return docs.filter(F.col("docId").isNotNull() & (F.coalesce("text", F.lit("")) != "")).select(
        F.col("docId").alias("id"), "title", F.col("text").alias("content"), "url", F.col("murl").alias("mobile_url"), "hierarchy", "metadata"
    )


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """``*.html`` files below a path: path and html; bytes that aren't UTF-8 are left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", True).load(path)
    return raw.select("path", utf8_ignoring("content").alias("html"))



def utf8_ignoring(content: str | Column) -> Column:
    """Bytes as text without those that aren't UTF-8."""
    raw = F.col(content) if isinstance(content, str) else content
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(""))


def base64_html(batch: DataFrame) -> DataFrame:
    """(filename, content_base64) to (filename, html, error): a bad item has an error and no html."""
    raw = F.try_to_binary("content_base64", F.lit("base64"))
    error = F.when(~F.lower("filename").endswith(".html"), "not an html file").when(raw.isNull(), "content is not base64")
    html = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))
    return batch.select("filename", F.when(error.isNull(), html).alias("html"), error.alias("error"))


def inline_html(items: DataFrame, column: str = "html") -> DataFrame:
    """Drops null and blank items."""
    return items.filter(F.trim(column) != "")
