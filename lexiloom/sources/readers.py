"""Readers of corpora and messages."""

from __future__ import annotations

import email
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiloom.functions import text as X
from lexiloom.operators import dedupe

MESSAGE_PARTS = "source string, msg_no long, part_no int, subject string, ctype string, charset string, payload binary"
INTERNAL = "FOLDER INTERNAL DATA"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV with a header, all columns as strings."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and the columns text and label, others kept; label as INT, copies by loader form dropped.

    Raises ValueError if a column is missing; a label that is no integer fails when rows are read. The first copy is the
    first row: of the first file by name, at the first place in it.
    """
    df = read_table(spark, path)
    missing = {"text", "label"} - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
    # rows of a file are numbered in order inside a scan's partitions, and a file of several lines a row is never split
    placed = df.withColumn("label", _whole(F.col("label")))
    placed = placed.withColumn("__at", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")))
    return dedupe.keep_first(placed.where(F.col("text").rlike(f"[^{X.SPACE}]")), X.loader_digest(F.col("text")), "__at").select(*df.columns)


def _whole(label: Column) -> Column:
    said = F.trim(label)
    return F.when(said.rlike(r"^[+-]?\d+$"), said.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no integer label: "), F.coalesce(said, F.lit("null")))).cast("int"))


def read_folder(spark: SparkSession, path: str, label: int | None = None, pattern: str | None = None) -> DataFrame:
    """(path, text[, label]): one row a file (S2); pattern is a glob on file names."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return df if label is None else df.withColumn("label", F.lit(label))


def read_two_folders(spark: SparkSession, class_0: str, class_1: str) -> DataFrame:
    """Both classes with copies by loader form dropped, the first by path kept."""
    both = read_folder(spark, class_0, 0).unionByName(read_folder(spark, class_1, 1))
    return dedupe.loader_dedupe(both, "path")


def read_headed_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): `.txt` files without a first line that begins with `header:`."""
    return read_folder(spark, path, pattern="*.txt").withColumn("text", X.drop_header_line(F.col("text")))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Message parts of mbox archives (S3); the source is the file's name, message numbers begin with 0 in each file.

    Archives are cut into messages at lines that begin with "From " after an empty line, by the reader itself, so that a
    large archive is no single row: each of its messages is parsed for itself.
    """
    raw = spark.read.text(path, lineSep="\n\nFrom ").select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("message"))
    raw = raw.where("octet_length(message) > 0").withColumn("source", F.element_at(F.split("path", "/"), -1))
    number = F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, no, data in zip(frame["source"], frame["msg_no"], frame["message"]):
                message = email.message_from_bytes(bytes(data).partition(b"\n")[2])
                for part_no, part in enumerate(p for p in message.walk() if not p.is_multipart()):
                    rows.append((name, no, part_no, str(message.get("Subject", "")), part.get_content_type(), part.get_content_charset(), part.get_payload(decode=True)))
            yield pd.DataFrame(rows, columns=["source", "msg_no", "part_no", "subject", "ctype", "charset", "payload"])

    # numbering moves positions only: the window's rows are (path, at), joined back to the messages
    numbered = raw.select("path", "at").withColumn("msg_no", number.cast("long"))
    return raw.join(numbered, ["path", "at"]).select("source", "msg_no", "message").mapInPandas(parse, MESSAGE_PARTS)


@F.pandas_udf(StringType())
def decoded(payload: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes decoded by their charset; an unknown or missing one counts as UTF-8, bad bytes become the replacement character."""

    def one(data: bytes | None, name: str | None) -> str | None:
        if data is None:
            return None
        try:
            return bytes(data).decode(name or "utf-8", errors="replace")
        except (LookupError, ValueError):
            return bytes(data).decode("utf-8", errors="replace")

    return pd.Series([one(d, c) for d, c in zip(payload, charset)], dtype=object)


def message_bodies(parts: DataFrame) -> DataFrame:
    """(source, msg_no, body) of messages (S5, P6): all plain parts joined by line feeds, else the text of the HTML parts, else ''.

    Whole-row copies count once, messages whose subject names mailbox-internal data are left out, parts without payload and
    attachments of other types are skipped. A message has a handful of parts, so its list stays small.
    """
    rows = parts.distinct().withColumn("internal", F.coalesce(F.col("subject").contains(INTERNAL), F.lit(False)))
    used = F.col("ctype").isin("text/plain", "text/html") & F.col("payload").isNotNull()
    rows = rows.withColumn("text", F.when(used, decoded("payload", "charset")))
    by = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("part_no", "ctype", "text"))))
    grouped = rows.groupBy("source", "msg_no").agg(F.max("internal").alias("internal"), by.alias("parts")).where(~F.col("internal"))
    of = lambda kind: F.transform(F.filter("parts", lambda p: p["ctype"] == kind), lambda p: p["text"])
    grouped = grouped.select("source", "msg_no", of("text/plain").alias("plain"), F.concat_ws("\n", of("text/html")).alias("markup"))
    return grouped.select("source", "msg_no", F.when(F.size("plain") > 0, F.concat_ws("\n", "plain")).otherwise(X.html_to_text(F.col("markup"))).alias("body"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A nested JSON document as one row (S6); lines: one document a line."""
    return spark.read.json(path, multiLine=not lines)


def synthetic(spark: SparkSession, per_class: int = 150, seed: int = 7) -> DataFrame:
    """Neutral sample texts, short casual ones (label 0) and long formal ones (label 1), picked by MD5 of seed, id and place; short ones end in one of five ways."""
    casual = ["hey, quick note", "not sure yet", "see you later", "that was fun", "let me check", "sounds good", "my bad", "running late", "call me back", "no worries at all"]
    formal = [
        "The committee has reviewed the schedule for the coming quarter.", "Please find the agenda of the next meeting below.", "The library will extend its opening hours in spring.", "All participants receive the minutes within a week.",
        "The garden project welcomes further volunteers.", "The report summarises the results of the survey.", "We thank every contributor for the careful work.", "The annual event takes place in the town hall.",
    ]

    draw = lambda n, i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long") % n
    from_ = lambda pool, i: F.element_at(F.array(*[F.lit(x) for x in pool]), (draw(len(pool), i) + 1).cast("int"))

    def picked(pool: list[str], low: int, spread: int) -> Column:
        size = (low + draw(spread, F.lit(0))).cast("int")
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(1), size), lambda i: from_(pool, i)))

    ids = spark.range(2 * per_class).withColumn("label", (F.col("id") >= per_class).cast("int"))
    short = F.concat(picked(casual, 3, 6), from_(["!", "!!", " ...", "?", ""], F.lit(99)))
    return ids.select("id", F.when(F.col("label") == 0, short).otherwise(picked(formal, 3, 4)).alias("text"), "label")
