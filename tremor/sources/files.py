"""File sources and sinks.

Event posts live in ``<root>/<event>/<event>.csv`` with a header row whose
column set and order differ between files. The file listing decides which
files are read (``event_files``: folder = file stem, first root that has the
event's file). Exactly these are parsed, each once, into a landed Parquet table
of positional cells; header rows and the name mapping come from that table. A
multi-line CSV file is not splittable, so a file is parsed in order by one
task: its rows get consecutive ``monotonically_increasing_id`` values, and the
row index inside the file is the distance to the file's header id.

Files are parsed as bytes (ISO-8859-1) and cells decoded as UTF-8 afterwards, so
that a file which is not UTF-8 is known as such. ``ingest`` decides per file:
bad ones go to an error table, the others go on.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.scalars import event_from_path, na_to_null, unescape_path
from ..operators.cleaning import clean_posts
from ..operators.scoring import EVENT_RESULT
from ..session import batch_rows, ensure_checkpoint_dir
from .images import verify_images

# --- fixed values that must equal the reference --------------------------------
# CSV header -> canonical column name (header list of the post CSV).
POST_COLUMNS = {
    "id": "id",
    "用户昵称": "nickname",
    "微博正文": "text",
    "发布位置": "location",
    "转发数": "reposts",
    "评论数": "comments",
    "点赞数": "likes",
    "发布时间": "published_raw",
    "processed_text": "clean_text",
}
# Image extensions in lookup order.
IMAGE_EXTS = ["jpg", "png", "jpeg"]
# -------------------------------------------------------------------------------

WIDTH = 48  # cells the parser is first asked for; wider headers are parsed again at their width
FILES_PER_READ = 100_000  # paths handed to one reader, which takes them on the driver
IMAGES_PER_BATCH = 16  # image files a task holds at once
BOM = "\ufeff"
CACHE_BUCKETS = 64
CACHE_SALTS = 8  # files per bucket and run, so that a hot event is written by several tasks
RAW = "cells array<string>, file string, mid long, root_rank int, commas int, sound boolean, quoted string"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tremor-{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the session's shared checkpoint folder and
    read it back. Later actions start from the written table: the CSV parse and
    regex cleaning run once, and a lost executor re-reads files instead of
    replaying the whole plan."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").options(**options or {}).parquet(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


CSV_OPTIONS = {
    "header": False, "multiLine": True, "escape": '"', "emptyValue": "", "encoding": "ISO-8859-1", "mode": "PERMISSIVE", "ignoreMissingFiles": True,
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "columnNameOfCorruptRecord": "_raw",
}


def csv_schema(width: int) -> StructType:
    return StructType([StructField(f"c{i}", StringType()) for i in range(width)] + [StructField("_raw", StringType())])


def cells_frame(df: DataFrame, width: int = WIDTH, root_rank: int = 0) -> DataFrame:
    """Positional CSV rows -> RAW.

    ``commas`` of a row that does not have ``width`` cells bounds how many it has. ``sound``: all
    cells are UTF-8. ``quoted``: the row as it stands in the file (bytes as characters) where a
    quote may be open in it, that is with an odd number of quotes or with quotes and a line break.
    """
    decoded = [F.encode(F.col(f"c{i}"), "ISO-8859-1").cast("string") for i in range(width)]
    raw = F.col("_raw")
    quotes = F.length(raw) - F.length(F.replace(raw, F.lit('"')))
    return df.select(
        F.array(*decoded).alias("_cells"),
        F.col("_metadata.file_path").alias("file") if "file" not in df.columns else F.col("file"),
        F.monotonically_increasing_id().alias("mid"),
        F.lit(root_rank).alias("root_rank"),
        F.coalesce(F.length(raw) - F.length(F.replace(raw, F.lit(","))), F.lit(width)).alias("commas"),
        F.when((quotes % 2 == 1) | (quotes > 0) & (raw.contains("\n") | raw.contains("\r")), raw).alias("quoted"),
    ).select(F.transform("_cells", F.make_valid_utf8).alias("cells"), "file", "mid", "root_rank", "commas",
             F.forall("_cells", lambda c: c.isNull() | F.is_valid_utf8(c)).alias("sound"), "quoted")


def widest_header(raw: DataFrame) -> int:
    """Cells of the widest header row (an upper bound)."""
    heads = raw.groupBy("file").agg(F.min_by("commas", "mid").alias("commas"))
    return (heads.agg(F.max("commas")).first()[0] or 0) + 1


_GLOB_CHARS = set("\\*?[]{}")


def _literal_path(path: str) -> str:
    """Escape glob characters so the reader takes the path literally."""
    return "".join("\\" + ch if ch in _GLOB_CHARS else ch for ch in path)


def land_cells(spark: SparkSession, files: DataFrame, width: int = WIDTH) -> DataFrame:
    """Parse the listed files (path, root_rank), each once, and land their cells.

    Paths reach the readers in batches of ``FILES_PER_READ``; no list of all of
    them is held. A batch with a header of ``width`` cells or more is parsed again
    with more cells than that, so no column is lost. A file that has vanished
    since it was listed has no rows.
    """
    out, folders = scratch_dir(spark, "cells"), []
    listed = files.select("path", F.col("root_rank") if "root_rank" in files.columns else F.lit(0).alias("root_rank"))
    rows = listed.toLocalIterator()
    while batch := list(islice(rows, FILES_PER_READ)):
        for rank in sorted({r.root_rank for r in batch}):
            paths, folder, cells = [r.path for r in batch if r.root_rank == rank], f"{out}/{len(folders)}", width
            while paths:
                try:
                    scan = spark.read.schema(csv_schema(cells)).options(**CSV_OPTIONS).csv([_literal_path(p) for p in paths])
                except AnalysisException as gone:
                    if gone.getCondition() != "PATH_NOT_FOUND":
                        raise
                    paths = [p for p in paths if path_exists(spark, p)]
                    continue
                cells_frame(scan, cells, rank).write.mode("overwrite").parquet(folder)
                needed = widest_header(spark.read.schema(RAW).parquet(folder))
                if needed <= cells:
                    folders.append(folder)
                    break
                cells = needed
    if not folders:
        return spark.createDataFrame([], RAW)
    return spark.read.schema(RAW).parquet(*folders)


CELL = re.compile(r'("(?:[^"]++|"")*+)("?)[^,\r\n]*+|[^,\r\n]*+')


def quote_is_open(row: str) -> bool:
    """Whether a CSV row ends inside a quoted cell (a quote opens at the beginning of a cell only)."""
    at = 0
    while at < len(row):
        m = CELL.match(row, at)
        if m[1] is not None and not m[2]:
            return True
        at = m.end() + 1
    return False


def unclosed_files(raw: DataFrame) -> DataFrame:
    """(file) of files whose last row ends inside a quoted cell."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [quote_is_open(r) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["file"])

    last = raw.groupBy("file").agg(F.max_by("quoted", "mid").alias("quoted")).where("quoted is not null")
    return last.mapInArrow(check, "file string")


def ingest(spark: SparkSession, files: DataFrame, width: int = WIDTH, event_pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 + E12: (canonical posts of the files that can be read, errors (event, root_rank, error) of the others).

    ``files`` are rows of ``catalogue`` (event, path, root_rank). Errors: ``file not found`` (it
    vanished after the listing, or is empty), ``not UTF-8``, ``unclosed quote``, ``no text column``;
    a file with several has the first of these. One bad file of an event makes the event an error.
    """
    raw = land_cells(spark, files, width)
    event = event_of_file(event_pattern).alias("event")
    kinds = ["file not found", "not UTF-8", "unclosed quote", "no text column"]
    heads = apply_headers(raw, event_pattern, rows=False)
    found = [
        files.select("event", "root_rank").distinct().join(raw.select(event, "root_rank").distinct(), ["event", "root_rank"], "left_anti"),
        raw.where(~F.col("sound")).select(event, "root_rank").distinct(),
        raw.join(unclosed_files(raw), "file", "left_semi").select(event, "root_rank").distinct(),
        heads.where(F.col("hidx.text") == 0).select("event", "root_rank").distinct(),
    ]
    every = None
    for n, rows in enumerate(found):
        rows = rows.select("event", "root_rank", F.lit(n).alias("kind"))
        every = rows if every is None else every.unionByName(rows)
    names = F.array(*[F.lit(k) for k in kinds])
    errors = every.groupBy("event", "root_rank").agg(F.min("kind").alias("kind")).select("event", "root_rank", F.element_at(names, F.col("kind") + 1).alias("error"))
    errors = land(errors, "ingest-errors")
    good = canonical_posts(apply_headers(raw, event_pattern)).join(errors, ["event", "root_rank"], "left_anti")
    return good, errors


def apply_headers(raw: DataFrame, event_pattern: str | None = None, columns: dict[str, str] | None = None, rows: bool = True) -> DataFrame:
    """First row of each file = its header (BOM stripped); the other rows get a
    0-based ``pos`` and ``hidx``: for each wanted column (header name ->
    canonical name, default ``POST_COLUMNS``) its 1-based cell position in that
    file, 0 when the file lacks it. ``raw`` is a landed table. Without ``rows``: the
    header rows' (event, root_rank, file, hidx) only.

    The first row of each file is a fixed-width min per file; the header rows
    become a table of a few ints per file, joined back on ``file``.
    """
    columns = POST_COLUMNS if columns is None else columns

    def position(name: str) -> F.Column:
        # a BOM may lead the first cell
        return (F.when(F.element_at("cells", 1) == F.lit(BOM + name), F.lit(1))
                .otherwise(F.array_position("cells", name)).cast("int"))

    first = raw.groupBy("file").agg(F.min("mid").alias("mid"))
    headers = raw.join(first, ["file", "mid"]).select(
        "file", "root_rank", F.col("mid").alias("hmid"), F.struct(*[position(name).alias(canon) for name, canon in columns.items()]).alias("hidx"))
    if not rows:
        return headers.select(event_of_file(event_pattern).alias("event"), "root_rank", "file", "hidx")
    posts = raw.join(headers.drop("root_rank"), "file").where(F.col("mid") != F.col("hmid"))
    return posts.select(event_of_file(event_pattern).alias("event"), "root_rank", "file", (F.col("mid") - F.col("hmid") - 1).alias("pos"),
                       "cells", "hidx")


def event_of_file(event_pattern: str | None = None) -> F.Column:
    """Event of a scanned row's ``file`` (a URI-encoded path)."""
    if event_pattern:  # key=value folder written by Spark: two rounds of escaping
        return unescape_path(F.regexp_extract("file", event_pattern, 1), 2)
    return event_from_path("file", decodes=1)


def read_raw_posts(spark: SparkSession, roots: str | list[str], width: int = WIDTH,
                   event_pattern: str | None = None, first_root_only: bool = True) -> DataFrame:
    """S1 + U1 + P11: all rows of the event files under the roots, header applied.

    -> (event, root_rank, file, pos, cells ARRAY<value>, hidx STRUCT<canonical name: position>)
    """
    files = event_files(spark, roots, event_pattern) if first_root_only else catalogue(spark, roots, event_pattern)
    return apply_headers(land_cells(spark, files, width), event_pattern)


def read_posts_of(spark: SparkSession, files: DataFrame, width: int = WIDTH, event_pattern: str | None = None) -> DataFrame:
    """S1 over chosen event files (rows of ``catalogue``): only those are parsed."""
    return canonical_posts(apply_headers(land_cells(spark, files, width), event_pattern))


def _has(canon: str) -> F.Column:
    return F.col("hidx")[canon] > 0


def _cell(canon: str) -> F.Column:
    return F.when(_has(canon), F.element_at(F.col("cells"), F.col("hidx")[canon]))


def read_posts(spark: SparkSession, roots: str | list[str], width: int = WIDTH,
               event_pattern: str | None = None, first_root_only: bool = True) -> DataFrame:
    """Canonical post rows from every event file.

    -> (event, root_rank, pos, id, nickname, text, location, reposts, comments,
    likes, published_raw, clean_text, has_time, has_counts, has_nickname,
    has_location, has_text). Missing tokens are already null (S2).
    """
    return canonical_posts(read_raw_posts(spark, roots, width, event_pattern, first_root_only))


def canonical_posts(raw: DataFrame) -> DataFrame:
    """Header-mapped rows -> canonical post columns + per-file has_* flags."""
    return raw.select(
        "event", "root_rank", "pos",
        *[na_to_null(_cell(c)).alias(c) for c in POST_COLUMNS.values()],
        _has("published_raw").alias("has_time"),
        (_has("reposts") & _has("comments") & _has("likes")).alias("has_counts"),
        _has("nickname").alias("has_nickname"),
        _has("location").alias("has_location"),
        _has("text").alias("has_text"),
    )


def first_root(rows: DataFrame) -> DataFrame:
    """S3: keep the rows of the first root (lowest ``root_rank``) holding each event.

    A per-event min (partial aggregation) joined back; never a window over an event.
    """
    win = rows.groupBy("event").agg(F.min("root_rank").alias("root_rank"))
    return rows.join(win, ["event", "root_rank"], "left_semi")


def event_files(spark: SparkSession, roots: str | list[str], event_pattern: str | None = None) -> DataFrame:
    """S3 + S4: (event, path, length, root_rank) of the files to read: for each event those of
    the first root that has its file, with or without rows."""
    return first_root(catalogue(spark, roots, event_pattern))


def catalogue(spark: SparkSession, roots: str | list[str], event_pattern: str | None = None) -> DataFrame:
    """events = folders holding ``<name>/<name>.csv``; header-only files
    are included (events with no posts, Q19).

    Only the file listing is read (binaryFile without the content column).
    Zero-byte files are skipped by Spark's file sources; the reference fails
    to parse them, so they are not valid event files either. ``event_pattern``
    (a regex whose group 1 is the event, matched on the path) replaces the
    folder = file-stem rule for layouts written by Spark
    (``event=<name>/part-*.csv``), as in ``read_posts``.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    frames = []
    for rank, root in enumerate(roots):
        ls = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
              .option("recursiveFileLookup", True).load(root).select("path", "length"))
        if event_pattern:
            # raw listing path of a Spark-written key=value folder: one round
            ev = unescape_path(F.regexp_extract("path", event_pattern, 1), 1)
            frames.append(ls.select(ev.alias("event"), "path", "length", F.lit(rank).alias("root_rank"))
                          .where(F.col("event") != ""))
            continue
        folder = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
        # listing paths are raw: names are compared as they are on disk
        frames.append(ls.select(event_from_path("path", decodes=0).alias("event"), folder.alias("_folder"),
                                "path", "length", F.lit(rank).alias("root_rank"))
                      .where(F.col("event") == F.col("_folder")).drop("_folder"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def uncached_events(requested: DataFrame, cached: DataFrame) -> DataFrame:
    """Requested events that are not in the cleaned cache."""
    return requested.select("event").distinct().join(cached.select("event"), "event", "left_anti")


def bucket_of(event: str = "event") -> F.Column:
    return F.pmod(F.xxhash64(event), F.lit(CACHE_BUCKETS)).cast("int")


def cached_events(spark: SparkSession, cache_path: str) -> DataFrame:
    """(event, run) of every event in the cache, with or without posts."""
    path = f"{cache_path.rstrip('/')}/events"
    schema = "event string, run string"
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def read_cache(spark: SparkSession, cache_path: str, schema: StructType | None = None,
               requested: DataFrame | None = None) -> DataFrame:
    """The cached posts (of the requested events). Only runs that finished count:
    an event's posts are those of the run that its entry names."""
    reader = spark.read
    if schema is not None:
        extra = [StructField("run", StringType()), StructField("bucket", IntegerType())]
        reader = reader.schema(StructType([f for f in schema.fields if f.name not in ("run", "bucket")] + extra))
    posts = reader.parquet(f"{cache_path.rstrip('/')}/posts")
    posts = posts.withColumn("run", F.col("run").cast("string")).join(cached_events(spark, cache_path), ["run", "event"], "left_semi")
    if requested is not None:
        wanted = requested.select("event").distinct().withColumn("bucket", bucket_of())
        posts = posts.join(wanted, ["bucket", "event"], "left_semi")
    return posts.drop("run", "bucket")


def cleaned_cache(spark: SparkSession, posts: DataFrame, cache_path: str, text_col: str = "text",
                  requested: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Read-through cache of cleaned posts (Parquet, bucketed folders by event).

    Only events missing from the cache are cleaned and appended; the result is
    the cache restricted to the requested events (default: the events of
    ``posts``; pass the file catalogue to avoid parsing the CSVs for it).
    The cache keeps every canonical column, so statistics can be computed
    from it. Timestamps stay typed (Q7b). Events without posts are entered
    too, so they are not looked for again. ``partitions``: see ``cleaning.spread``.
    """
    requested = (posts if requested is None else requested).select("event").distinct()
    new = land(uncached_events(requested, cached_events(spark, cache_path).select("event").distinct()), "uncached")
    todo = clean_posts(posts.join(new, "event", "left_semi"), text_col, "clean_text", partitions)
    write_cache_run(todo, new, cache_path, f"batch-{uuid.uuid4().hex}")
    return read_cache(spark, cache_path, todo.schema, requested)


def write_cache_run(cleaned: DataFrame, events: DataFrame, cache_path: str, run: str) -> None:
    """Write one run of cleaned posts to ``<cache>/posts/run=<run>/bucket=<b>``, then enter its events.

    Rows are dealt by bucket and a salt of the position: at most
    ``CACHE_BUCKETS * CACHE_SALTS`` files, and a hot event is not one task's.
    Overwriting the run's own folders makes a retried run idempotent; runs
    never touch each other's files.
    """
    root = cache_path.rstrip("/")
    (cleaned.withColumn("bucket", bucket_of())
     .repartition(CACHE_BUCKETS * CACHE_SALTS, "bucket", F.pmod(F.xxhash64("pos"), F.lit(CACHE_SALTS)))
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/posts/run={run}"))
    events.select("event").distinct().coalesce(1).write.mode("overwrite").parquet(f"{root}/events/run={run}")


# ----------------------------------------------------------------------------- JSON sources / sinks



def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label JSON list -> (event, reason, severity, position).

    The multi-line JSON reader streams the top-level array into one row per
    element (no whole-file string); a file is parsed in order by one task, so
    ``monotonically_increasing_id`` grows in file order and serves as the
    position for "last one wins".
    """
    df = (spark.read.schema("topic string, reason string, severity string")
          .option("multiLine", True).option("encoding", "UTF-8").json(path))
    return df.select(F.col("topic").alias("event"), "reason", "severity",
                     F.monotonically_increasing_id().alias("position"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Split JSON -> (event, part). Reads both layouts: ``{train_topics, val_topics}``
    objects (pretty-printed or not) and JSON lines of ``{event, part}``.

    The multi-line JSON parser streams a file's records; one pass serves both
    layouts, as a record of one kind has nulls in the fields of the other. Line
    layouts written by ``write_split`` are read line by line (splittable).
    """
    schema = "train_topics array<string>, val_topics array<string>, event string, part string"
    lines = spark.read.schema(schema + ", _raw string").option("columnNameOfCorruptRecord", "_raw").json(path)
    objects = lines
    if not lines.where("event is not null or train_topics is not null or val_topics is not null").take(1):
        objects = spark.read.schema(schema).option("multiLine", True).json(path)  # pretty-printed objects
    parts = objects.select(F.inline(F.array(
        F.struct(F.lit("train").alias("part"), F.col("train_topics").alias("events")),
        F.struct(F.lit("val").alias("part"), F.col("val_topics").alias("events")),
        F.struct(F.col("part").alias("part"), F.when(F.col("event").isNotNull(), F.array("event")).alias("events")))))
    return parts.where("events is not null and part is not null").select(F.explode("events").alias("event"), "part")


def write_split(split: DataFrame, path: str) -> None:
    """The split as JSON lines {event, part}, written by all tasks in parallel."""
    split.select("event", "part").write.mode("overwrite").json(path)


def write_split_object(split: DataFrame, path: str) -> None:
    """S8 in the reference's layout: one object ``{train_topics, val_topics}`` in one file, events sorted.

    The object is written in one line, an event at a time, by one task that sorts and streams them
    (the layout is a single file); no array of all events is built.
    """
    parts = {"train": 1, "val": 3}
    first = split.where(F.col("part").isin(*parts)).groupBy("part").agg(F.min("event").alias("first"))
    quoted = F.expr("substring(to_json(array(event)), 2, length(to_json(array(event))) - 2)")
    events = split.join(first, "part").select(
        F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("part")).alias("line"), "event",
        F.concat(F.when(F.col("event") == F.col("first"), F.lit("")).otherwise(F.lit(",")), quoted).alias("value"))
    frame = split.sparkSession.createDataFrame([(0, None, '{"train_topics": ['), (2, None, '], "val_topics": ['), (4, None, "]}")], "line int, event string, value string")
    (events.unionByName(frame).coalesce(1).sortWithinPartitions("line", "event").select("value")
     .write.mode("overwrite").option("lineSep", " ").text(path))


def write_event_results(scored: DataFrame, path: str) -> None:
    """One JSON object per event {event_name, predicted_class, predicted_label, probabilities}."""
    scored.select(*EVENT_RESULT).write.mode("overwrite").json(path)


def read_event_results(spark: SparkSession, path: str) -> DataFrame:
    schema = "event_name string, predicted_class int, predicted_label string, probabilities map<string,double>"
    return spark.read.schema(schema).json(path)


def write_post_results(results: DataFrame, path: str, partition_by_event: bool = False) -> None:
    """CSV id,text,predicted_class,predicted_label with a header (header-only when empty)."""
    # texts are written as they are (Spark's CSV writer trims by default)
    w = results.select(*(["event"] if partition_by_event else []), "id", "text", "predicted_class", "predicted_label") \
        .write.mode("overwrite").option("header", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if partition_by_event:
        w = w.partitionBy("event")
    w.csv(path)


POST_RESULT_SCHEMA = "id string, text string, predicted_class int, predicted_label string"


def read_post_results(spark: SparkSession, path: str, partitioned_by_event: bool = False) -> DataFrame:
    """Read S10 output back (texts as written; ``event`` from the folder names)."""
    schema = POST_RESULT_SCHEMA + (", event string" if partitioned_by_event else "")
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Predictions / history tables."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_event_csvs(posts: DataFrame, root: str) -> None:
    """Write posts as per-event CSV files with a header (folder per event)."""
    (posts.write.mode("overwrite").partitionBy("event").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root))


# ----------------------------------------------------------------------------- images

def image_manifest(spark: SparkSession, roots: str | list[str], verify: bool = False) -> DataFrame:
    """``<root>/<event>/images/<id>.<ext>`` files -> (event, id, path, ext,
    ext_rank, length[, format, fault, readable]). ``verify`` reads the files, a few
    at a time, and walks their containers (``images.verify_images``); the reference falls
    through on decode failure. The verdicts are written, so a file is read once."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    rank = F.array_position(F.array(*[F.lit(e) for e in IMAGE_EXTS]), F.lower(F.col("ext"))) - 1
    frames = []
    for root_rank, root in enumerate(roots):
        src = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,png,jpeg}")
               .option("recursiveFileLookup", True).load(root))
        cols = ["path", "length"] + (["content"] if verify else [])
        m = src.select(*cols).select(
            "*",
            # listing paths are raw (no %XX escaping)
            F.regexp_extract("path", r"/([^/]+)/images/[^/]+$", 1).alias("event"),
            F.regexp_extract("path", r"/images/([^/]+)\.[^./]+$", 1).alias("id"),
            F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext"),
            F.lit(root_rank).alias("root_rank"))
        m = m.where(F.col("event") != "").withColumn("ext_rank", rank.cast("int"))
        if verify:
            with batch_rows(spark, IMAGES_PER_BATCH):
                m = land(verify_images(m).withColumn("readable", F.col("fault").isNull()), "images")
        frames.append(m)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    # the first root holding the event's image folder wins (as for posts)
    return first_root(out)
