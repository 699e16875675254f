"""Readers and writers with explicit schemas. All paths are read by Spark, so any store will do."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote, urlparse

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRUTH = "index int, answer string, `from` string"
PREDICTION = "image string, ocr string, finish_reason string, ok boolean"
CHAT = "messages array<struct<role:string,content:string>>, images array<string>, _page_idx int"
WORD = "struct<text:string,choices:string,classes:int,confidence:double,det_confidence:double,position:array<int>,text_direction:int,img_direction:int,l1_alert:boolean,l2_alert:boolean,siku_top1:string,siku_gap:double,suggest:string>"
LINE = f"struct<box:array<array<int>>,position:array<array<int>>,text:string,words:array<{WORD}>>"
ANNOTATION = f"pages array<struct<globalIndex:int,fileName:string,relPath:string,category:string,width:int,height:int,text:string,source:string,ocrText:string,classifiedLines:array<{LINE}>>>"


def file_name(path: Column | str) -> Column:
    """The name of a file without its extension; of one that write_named wrote, its row's name."""
    path = F.col(path) if isinstance(path, str) else path
    own = F.regexp_extract(path, "/name=([^/]+)/[^/]+$", 1)
    return F.when(own != "", own).otherwise(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def folder_name(path: Column | str) -> Column:
    """The name of the folder that a file stands in; of a partition's folder, its value."""
    return F.regexp_extract(path, "([^/=]+)/[^/]+$", 1)


#: What Spark escapes in the folder name of a partition.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _value_folder(name: str | None) -> str:
    """The folder name of a partition's value, as Spark's writers have it."""
    return "name=" + (ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name) if name else "__HIVE_DEFAULT_PARTITION__")


def write_named(files: DataFrame, path: str, mode: str = "errorifexists", extension: str = "txt") -> None:
    """A text file for each row of files(name, content), below a folder name=<name>, written by the executors.

    Rows are dealt out, since few bytes make many files. On local disks Hadoop starts several processes for each file's permissions, and
    the driver moves each folder at the end; there the tasks make the files themselves, each whole or not at all. Other stores get
    them from Spark's writers, by which content in a csv is quoted where it must be.
    """
    spark = files.sparkSession
    rows = files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("string").alias("value"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    system, place = folder_of(spark, path)
    if system.getScheme() != "file" or mode not in ("error", "errorifexists"):
        if extension not in ("txt", "csv"):
            raise ValueError(f"Spark's writers make no .{extension} files there")
        writer = dealt.write.partitionBy("name").mode(mode)
        return writer.csv(path) if extension == "csv" else writer.text(path)
    if system.exists(place):
        raise FileExistsError(path)
    root = unquote(urlparse(system.makeQualified(place).toUri().toString()).path)
    os.makedirs(root)

    def run(part):
        task = TaskContext.get()
        for k, row in enumerate(part):
            folder = f"{root}/{_value_folder(row.name)}"
            os.makedirs(folder, exist_ok=True)
            # hidden until it is whole; a task that runs again puts the same names in place
            whole, hidden = f"{folder}/part-{task.partitionId():05d}-{k}.{extension}", f"{folder}/.{task.taskAttemptId()}-{k}"
            with open(hidden, "w", encoding="utf-8", newline="") as out:
                out.write(f"{row.value or ''}\n")
            os.replace(hidden, whole)

    dealt.sortWithinPartitions("name", "value").foreachPartition(run)


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(value, path): a row for each file below a path."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth CSV; answers may span lines. By row_order, file and then record, the last of equal indices wins."""
    rows = spark.read.schema(TRUTH).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    # a file with records of several lines is read by one task from its start to its end, whatever files it shares that task with
    return rows.withColumn("row_order", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("record")))


def folder_of(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path, so that any store will do."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist."""
    return [p for p in paths if (x := folder_of(spark, p))[0].exists(x[1])]


def catalog(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """(model, files): the prediction files below a folder, by the folder that they stand in."""
    files = list_files(spark, folder, pattern).select(folder_name("path").alias("model"), "path")
    return files.groupBy("model").agg(F.array_sort(F.collect_set("path")).alias("files"))


def read_predictions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Prediction JSONL with missing keys as defaults; the model is the file's folder. Files that don't exist are skipped."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], f"{PREDICTION}, model string")
    rows = spark.read.schema(PREDICTION).json(found)
    return rows.withColumn("model", folder_name(F.col("_metadata.file_path"))).fillna({"image": "", "ocr": "", "finish_reason": "", "ok": False})


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Chat records, one JSON object a line; broken and blank lines give no row."""
    return spark.read.schema(CHAT).option("mode", "DROPMALFORMED").json(path)


def write_chat(records: DataFrame, path: str) -> None:
    """Chat records as JSONL of messages and images."""
    records.select(F.to_json(F.struct("messages", "images"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.option("header", True).option("encoding", "UTF-8").csv(path)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(book, text): one row for each file."""
    return _whole_files(spark, path).select(file_name("path").alias("book"), F.col("value").alias("text"))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(n, zh) of lines n|zh; other lines are ignored."""
    line = F.split(F.trim("value"), r"[|]", 2)
    return spark.read.text(path).filter(F.col("value").contains("|")).select(line[0].alias("n"), line[1].alias("zh"))


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """(page_idx, cell, text) of lines page|cell|text."""
    line = F.split(F.trim("value"), r"[|]", 3)
    rows = spark.read.text(path).select(line.alias("p")).filter(F.size("p") == 3)
    return rows.select(F.col("p")[0].try_cast("int").alias("page_idx"), F.col("p")[1].try_cast("int").alias("cell"), F.col("p")[2].alias("text"))


def write_comments(comments: DataFrame, path: str) -> None:
    comments.select(F.concat_ws("|", F.col("page_idx").cast("string"), F.col("cell").cast("string"), "text").alias("value")).write.text(path)


def read_settings(spark: SparkSession, path: str, separator: str = ":") -> DataFrame:
    """(file, key, value) of flat key: value or key=value files, comments cut where # follows white
    space or starts a line, quotes removed."""
    value = F.regexp_replace("value", r"(^|\s)#.*$", "")
    parts = F.split(value, F.lit(separator), 2)
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    rows = lines.select(file_name(F.col("_metadata.file_path")).alias("file"), parts.alias("p")).filter(F.size("p") == 2)
    unquoted = F.regexp_replace(F.trim(F.col("p")[1]), r"""^(["'])(.*)\1$""", "$2")
    return rows.select("file", F.trim(F.col("p")[0]).alias("key"), unquoted.alias("value")).filter("key <> ''")


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, settings map<string,string>) of YAML layouts; typed by the functions that use them."""
    # so few tasks that their pieces for each other don't grow with the square of the files
    few = read_settings(spark, path).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return few.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))


def typed(value):
    """struct(i, d, s): a setting as an integer, else as a number, else as text."""
    i = F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("long"))
    d = F.when(i.isNull(), value.try_cast("double"))
    return F.struct(i.alias("i"), d.alias("d"), F.when(i.isNull() & d.isNull(), value).alias("s"))


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length) of files whose name matches a glob; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length")


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Pages of scripts that assign one JSON object each: a row for each page."""
    json = F.regexp_replace("value", r"(?s)^[^{]*=\s*|\s*;\s*$", "")
    whole = _whole_files(spark, path).select(F.from_json(json, ANNOTATION).alias("d"))
    return whole.select(F.explode("d.pages").alias("page")).select("page.*")


def read_images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, width, height, rgb): images of any kind that Spark's image source decodes, in reading order.

    One that can't be decoded has nulls; an empty file gives no row.
    """
    read = spark.read.format("image").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("dropInvalid", False).load(folder).select("image.*")
    # the source gives blue, green and red, a fourth byte for how opaque a pixel is, or one byte of grey
    pixels, known = F.hex("data"), F.col("nChannels") > 0
    rgb = F.when(F.col("nChannels") == 1, F.regexp_replace(pixels, "(..)", "$1$1$1")).when(F.col("nChannels") == 4, F.regexp_replace(pixels, "(..)(..)(..)..", "$3$2$1")).otherwise(F.regexp_replace(pixels, "(..)(..)(..)", "$3$2$1"))
    return read.select(F.col("origin").alias("path"), *(F.when(known, F.col(c)).alias(c) for c in ("width", "height")), F.when(known, F.unhex(rgb)).alias("rgb"))
