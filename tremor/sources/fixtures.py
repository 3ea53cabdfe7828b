"""Deterministic views over the driver tables that exercise the operators.

Each view is defined twice with the same meaning: as a DataFrame (used by the
registered queries) and as DuckDB SQL (used by the oracles). Definitions
follow FIXTURES.md part C. All views keep every row of their source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import argmax

DEFAULT_YEAR = 2024
CONV_CAP = 4
CONV_TRUNCATE = 30

# Decorations for fx_text, by doc_id % 14 (prefix, suffix); 8 = null text.
TEXT_DECOR = {
    0: ("", ""),
    1: ("O网页链接", ""),
    2: ("L某某的微博视频", ""),
    3: ("#a#", "#a##b#"),
    4: ("转发微博", ""),
    5: ("回复@甲:", ""),
    6: ("《", "》，。！？；：（）【】、"),
    7: ("　\t", "\t　 "),
    9: ("见 [链接](http://a.example/x) ", ""),
    10: ("(https://b.example/p?q=1) ", " HTTP://C.example/"),
    11: ("a.b+c@mail.example.org ", "//@某人: @another_one ok"),
    12: ("<p class=\"x\">", "</p><br/>"),
    13: ("😂👍", "❤️好🔥"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ----------------------------------------------------------------------------- Spark

def fx_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid, uid, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    ymd_slash = F.concat_ws("/", F.year(ts), F.month(ts), F.dayofmonth(ts))
    hm = F.concat_ws(":", F.hour(ts), F.minute(ts))
    published = (
        F.when(eid % 6 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(eid % 6 == 1, F.concat(ymd_slash, F.lit(" "), hm))
        .when(eid % 6 == 2, F.date_format(ts, "MM-dd HH:mm"))
        .when(eid % 6 == 3, F.concat(F.date_format(ts, "MM-dd HH:mm"), F.lit("乱码")))
        .when(eid % 6 == 4, F.concat(F.year(ts), F.lit("年"), F.month(ts), F.lit("月"), F.dayofmonth(ts), F.lit("日")))
    )
    return e.select(
        F.col("event_type").alias("event"),
        eid.alias("pos"),
        eid.cast("string").alias("id"),
        F.when(eid % 11 == 0, F.lit("NA")).otherwise(F.concat(F.lit("u"), uid.cast("string"))).alias("nickname"),
        F.when(eid % 5 == 0, F.lit(None).cast("string")).when(eid % 5 == 1, F.lit("未知"))
        .otherwise(F.concat(F.lit("loc"), (uid % 7).cast("string"))).alias("location"),
        F.regexp_extract("props", r"(\d+)", 1).alias("reposts"),
        F.when(eid % 13 == 0, F.lit("10万")).otherwise((uid % 50).cast("string")).alias("comments"),
        F.floor("value").cast("int").cast("string").alias("likes"),
        published.alias("published_raw"),
    )


def fx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    k = F.col("doc_id") % 14
    text = None
    for i, (pre, suf) in TEXT_DECOR.items():
        val = F.concat(F.lit(pre), F.col("text"), F.lit(suf))
        text = F.when(k == i, val) if text is None else text.when(k == i, val)
    return d.select(F.col("source").alias("event"), F.col("doc_id").alias("pos"),
                    F.col("doc_id").cast("string").alias("id"), text.alias("text"))


def fx_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels")
    sev = (F.when(F.col("toxic") == 1, "严重").when(F.col("quality") == 0, "中等").otherwise("轻微"))
    return d.join(lab, "doc_id").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("event"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("reason"),
        sev.alias("severity"),
        F.lit(0).alias("position"),
    )


def fx_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per document (the event catalogue for label queries)."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("event"))


def fx_label_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fx_labels(spark, sf_dir)
    dup = (base.where(F.substring("event", 2, 20).cast("long") % 4 == 0)
           .select("event", "reason", F.lit("严重").alias("severity"), F.lit(1).alias("position")))
    return base.unionByName(dup)


def fx_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("event"),
        F.col("turn").alias("pos"),
        F.when(F.col("turn") % 3 == 2, F.lit("")).otherwise(F.col("turn").cast("string")).alias("id"),
        F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"),
        F.col("conv_id"),
    )


def fx_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    emb = F.col("embedding").cast("array<double>")
    return v.select(
        F.col("label").cast("string").alias("event"),
        F.col("vec_id").alias("pos"),
        emb.alias("vec"),
        (F.col("vec_id") % 7 != 0).alias("valid"),
        F.element_at(emb, 1).alias("score"),
        F.slice(emb, 1, 3).alias("logits"),
        (F.col("vec_id") % 3).cast("int").alias("y"),
        F.floor(F.col("vec_id") / 4).cast("long").alias("batch"),
    )


def fx_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx_vec(spark, sf_dir)
    return v.select(F.col("pos").cast("string").alias("event"), F.col("y").alias("true"),
                    argmax("logits").alias("pred"))


def fx_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return (e.groupBy(F.dayofmonth("ts").cast("int").alias("epoch"))
            .agg(F.round(F.avg("value") / 100, 4).alias("val_f1")))


def fx_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx_conv(spark, sf_dir)
    pos = F.col("pos")
    exts = F.array(
        F.when(pos % 2 == 0, F.struct(F.lit("jpg").alias("ext"), F.lit(0).alias("ext_rank"))),
        F.when(pos % 3 == 0, F.struct(F.lit("png").alias("ext"), F.lit(1).alias("ext_rank"))),
        F.when(pos % 5 == 0, F.struct(F.lit("jpeg").alias("ext"), F.lit(2).alias("ext_rank"))),
    )
    m = c.select("event", "pos", "conv_id", F.explode(F.array_compact(exts)).alias("x"))
    return m.select(
        "event",
        F.col("pos").cast("string").alias("id"),
        F.concat(F.col("event"), F.lit("/images/"), F.col("pos").cast("string"), F.lit("."), F.col("x.ext")).alias("path"),
        F.col("x.ext").alias("ext"),
        F.col("x.ext_rank").alias("ext_rank"),
        F.when((F.col("conv_id") % 4 == 0) & (F.col("x.ext") == "jpg"), F.lit(0)).otherwise(F.lit(1024)).cast("long").alias("length"),
    )


def code_point(code: F.Column) -> F.Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def emoji_table(spark: SparkSession) -> DataFrame:
    """(seq, name) by rule: pictures, pairs of regional letters, hands with a skin tone, people joined
    with a thing, and keys; the name is `e` and the code points in hexadecimal."""
    def each(first, last):
        return spark.range(first, last + 1).select(F.col("id").alias("c"))

    def pairs(a, b, *between):
        return a.toDF("a").join(b.toDF("b"), F.lit(True)).select(F.array("a", *[F.lit(x).cast("long") for x in between], "b").alias("codes"))

    def listed(*codes):
        return spark.createDataFrame([(c,) for c in codes], "c long")

    keys = spark.range(0x30, 0x3A).select(F.array("id", F.lit(0xFE0F).cast("long"), F.lit(0x20E3).cast("long")).alias("codes"))
    tables = [each(0x1F300, 0x1F64F).select(F.array("c").alias("codes")), pairs(each(0x1F1E6, 0x1F1FF), each(0x1F1E6, 0x1F1FF)),
              pairs(each(0x1F44A, 0x1F450), each(0x1F3FB, 0x1F3FF)), pairs(listed(0x1F468, 0x1F469), listed(0x1F33E, 0x1F373, 0x1F393, 0x1F3A4), 0x200D), keys]
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    return every.select(F.array_join(F.transform("codes", code_point), "").alias("seq"),
                        F.concat(F.lit("e"), F.array_join(F.transform("codes", lambda c: F.lower(F.hex(c))), "_")).alias("name"))


def fx_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with emoji before, between and after their words."""
    d = documents(spark, sf_dir)
    n = F.col("doc_id")
    letters = [code_point(F.lit(0x1F1E6) + n % 26), code_point(F.lit(0x1F1E6) + (n * 7) % 26), code_point(F.lit(0x1F1E6) + (n * 3) % 26)]
    hand = F.concat(code_point(F.lit(0x1F44A) + n % 7), F.when(n % 2 == 0, code_point(F.lit(0x1F3FB) + n % 5)).otherwise(F.lit("")))
    person = F.concat(code_point(F.lit(0x1F468) + n % 3), F.lit("\u200d"), F.when(n % 5 == 0, F.lit("\U0001F33E")).otherwise(F.lit("\U0001F393")))
    key = F.concat(F.substring(n.cast("string"), 1, 1), F.lit("\ufe0f\u20e3"))
    return d.select(n.alias("pos"), F.concat(*letters, F.lit(" "), F.replace("text", F.lit(", "), F.concat(F.lit(", "), hand)), person, key).alias("text"))


def fx_unspaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without blanks between words, as in scripts that write none."""
    return documents(spark, sf_dir).select(F.col("source").alias("event"), F.col("doc_id").alias("pos"), F.translate("text", " \n", "").alias("text"))


def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, freq): the runs of letters of all documents."""
    words = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def fx_image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as of ``binaryFile`` (path, length, content): a small image for each document, some of them damaged."""
    import struct
    import zlib

    import pyarrow as pa

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def png(said):
        width = max(1, min(len(said), 64))
        lines = -(-max(len(said), 1) // width)
        pixels = b"".join(b"\0" + said[n * width:(n + 1) * width].ljust(width, b"\0") for n in range(lines))
        return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, lines, 8, 0, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b""))

    def jpeg(said):
        head = b"\xff\xd8\xff\xe0\x00\x04JF\xff\xc0\x00\x0b\x08\x00\x10\x00\x10\x01\x01\x11\x00"
        return head + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + said.replace(b"\xff", b"\xff\x00") + b"\xff\xd0ab\xff\xd9"

    def run(batches):
        for batch in batches:
            made = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                said, kind = (text or "").encode(), doc % 7
                data = jpeg(said) if kind in (3, 4) else b"GIF89a" if kind == 5 else b"" if kind == 6 else png(said)
                if kind == 1:
                    data = data[:-9]
                elif kind == 2:
                    data = data[:40] + bytes([data[40] ^ 1]) + data[41:]
                elif kind == 4:
                    data = data[:-2]
                made.append((f"root/e{doc % 10}/images/{doc}.{'jpg' if kind in (3, 4) else 'png'}", len(data), data))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["path", "length", "content"])

    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(run, "path string, length long, content binary")


def fx_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score network of one hidden unit for each nation: (unit, w, b, v)."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("unit"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin((n + 1) * i)).alias("w"),
                                                 (F.col("n_regionkey") / 10.0).alias("b"), F.cos(n + 1).alias("v"))


# ----------------------------------------------------------------------------- SQL

def _text_case() -> str:
    arms = []
    for i, (pre, suf) in TEXT_DECOR.items():
        arms.append(f"WHEN doc_id % 14 = {i} THEN '{pre}' || text || '{suf}'")
    return "CASE " + " ".join(arms) + " END"


SQL = {
    "fx_meta": """
SELECT event_type AS event, event_id AS pos, CAST(event_id AS VARCHAR) AS id,
  CASE WHEN event_id % 11 = 0 THEN 'NA' ELSE 'u' || CAST(user_id AS VARCHAR) END AS nickname,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '未知'
       ELSE 'loc' || CAST(user_id % 7 AS VARCHAR) END AS location,
  regexp_extract(props, '(\\d+)', 1) AS reposts,
  CASE WHEN event_id % 13 = 0 THEN '10万' ELSE CAST(user_id % 50 AS VARCHAR) END AS comments,
  CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) AS likes,
  CASE event_id % 6
    WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 1 THEN year(ts) || '/' || month(ts) || '/' || day(ts) || ' ' || hour(ts) || ':' || minute(ts)
    WHEN 2 THEN strftime(ts, '%m-%d %H:%M')
    WHEN 3 THEN strftime(ts, '%m-%d %H:%M') || '乱码'
    WHEN 4 THEN year(ts) || '年' || month(ts) || '月' || day(ts) || '日'
  END AS published_raw
FROM events""",
    "fx_text": f"""
SELECT source AS event, doc_id AS pos, CAST(doc_id AS VARCHAR) AS id, {_text_case()} AS text
FROM documents""",
    "fx_labels": """
SELECT 'd' || CAST(d.doc_id AS VARCHAR) AS event, 'doc ' || CAST(d.doc_id AS VARCHAR) AS reason,
  CASE WHEN l.toxic = 1 THEN '严重' WHEN l.quality = 0 THEN '中等' ELSE '轻微' END AS severity,
  0 AS position
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_catalogue": """
SELECT 'd' || CAST(doc_id AS VARCHAR) AS event FROM documents""",
    "fx_label_dups": """
SELECT * FROM fx_labels
UNION ALL
SELECT event, reason, '严重' AS severity, 1 AS position FROM fx_labels
WHERE CAST(substr(event, 2) AS BIGINT) % 4 = 0""",
    "fx_conv": """
SELECT 'c' || CAST(conv_id AS VARCHAR) AS event, turn AS pos,
  CASE WHEN turn % 3 = 2 THEN '' ELSE CAST(turn AS VARCHAR) END AS id,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN '  ' ELSE text END AS text,
  conv_id
FROM conversations""",
    "fx_vec": """
SELECT CAST(label AS VARCHAR) AS event, vec_id AS pos, CAST(embedding AS DOUBLE[]) AS vec,
  vec_id % 7 <> 0 AS valid, CAST(embedding[1] AS DOUBLE) AS score,
  CAST(embedding[1:3] AS DOUBLE[]) AS logits, CAST(vec_id % 3 AS INTEGER) AS y,
  CAST(floor(vec_id / 4) AS BIGINT) AS batch
FROM embeddings""",
    "fx_pred": """
SELECT CAST(pos AS VARCHAR) AS event, y AS "true",
  CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred
FROM fx_vec""",
    "fx_history": """
SELECT CAST(day(ts) AS INTEGER) AS epoch, round(avg(value) / 100, 4) AS val_f1
FROM events GROUP BY 1""",
    "fx_images": """
SELECT event, CAST(pos AS VARCHAR) AS id,
  event || '/images/' || CAST(pos AS VARCHAR) || '.' || x.ext AS path, x.ext AS ext, x.ext_rank AS ext_rank,
  CAST(CASE WHEN conv_id % 4 = 0 AND x.ext = 'jpg' THEN 0 ELSE 1024 END AS BIGINT) AS length
FROM (
  SELECT event, pos, conv_id, unnest(list_filter([
      CASE WHEN pos % 2 = 0 THEN {'ext': 'jpg', 'ext_rank': 0} END,
      CASE WHEN pos % 3 = 0 THEN {'ext': 'png', 'ext_rank': 1} END,
      CASE WHEN pos % 5 = 0 THEN {'ext': 'jpeg', 'ext_rank': 2} END], lambda s: s IS NOT NULL)) AS x
  FROM fx_conv)""",
}

# Views a view depends on (emitted first in a WITH clause).
DEPENDS = {
    "fx_label_dups": ["fx_labels"],
    "fx_pred": ["fx_vec"],
    "fx_images": ["fx_conv"],
}


def with_views(*names: str) -> str:
    """`WITH v1 AS (...), v2 AS (...)` for the named views and their dependencies."""
    order: list[str] = []

    def add(n):
        for dep in DEPENDS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n"
