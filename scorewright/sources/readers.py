"""Sources: delimited text, JSON in several shapes, whole texts, archives, office files, and choices among paths."""

from __future__ import annotations

import csv as csv_reader
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: Names that an object may keep its records under.
WRAPPERS = ("articles", "items", "rows", "data", "news", "results")
#: Kinds of files that discovery looks for, by ending.
KINDS = {"csv": "table", "tsv": "table", "xlsx": "table", "json": "records", "jsonl": "records", "txt": "text", "html": "text", "htm": "text", "docx": "text", "pdf": "text", "zip": "archive"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that Spark reads it by."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of a CSV file with a header, all strings, blanks as empty strings; columns it lacks are empty. A missing path is an empty table.

    A byte order mark before the header is taken off.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, path):
        return empty(spark, schema)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.lstrip("﻿").strip('"'): c for c in raw.columns}
    return raw.select(*[F.coalesce(F.col(f"`{names[c]}`"), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in columns])


def missing_columns(spark: SparkSession, path: str, required: list[str]) -> list[str]:
    """Required columns that a CSV file's header lacks (all of them if there is no file); no rows are read."""
    if not exists(spark, path):
        return list(required)
    return [c for c in required if c not in {x.lstrip("﻿") for x in spark.read.option("header", True).csv(path).columns}]


def mapped(df: DataFrame, synonyms: dict[str, Iterable[str]]) -> DataFrame:
    """Columns renamed to canonical fields: each is the first non-blank of its synonyms that the table has; others are empty."""
    have = {c.strip().lower(): c for c in df.columns}
    out = []
    for field, names in synonyms.items():
        found = [F.nullif(F.trim(F.col(f"`{have[n.lower()]}`").cast("string")), F.lit("")) for n in [field, *names] if n.lower() in have]
        out.append(F.coalesce(*found, F.lit("")).alias(field))
    return df.select(*out)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files: lines of objects, lists, or objects that keep a list under one of WRAPPERS; others are boxed as they are.

    Files are read whole, so each must fit a task; lines of a .jsonl file are records
    of their own and need not.
    """
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    fields = T._parse_datatype_string(schema)
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    listed = T.ArrayType(fields)
    shapes = [F.when(F.ltrim("value").startswith("["), F.from_json("value", listed))]
    shapes += [F.from_json(F.get_json_object("value", f"$.{w}"), listed) for w in WRAPPERS]
    shapes.append(F.array(F.from_json("value", fields)))
    return text.select(F.explode(F.coalesce(*shapes)).alias("r")).select("r.*")


def parsed_records(spark: SparkSession, folder: str, schema: str, pattern: str = "*_parsed.json") -> DataFrame:
    """One row per JSON file of a folder: its path, the parsed record, and ok (false: undecodable, a failed record)."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").isNotNull().alias("ok"), F.from_json("value", T._parse_datatype_string(schema)).alias("record"))
    return rows


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """document_id (the file's name without ending) and text of each file."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder, wholetext=True)
    return raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("document_id"), F.col("value").alias("text"))


def discovered(spark: SparkSession, folder: str, excluded: Iterable[str] = ()) -> DataFrame:
    """path, size and kind of every file below a folder whose path has no excluded part; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), ending), F.lit("other"))
    out = files.withColumn("kind", kind)
    for part in excluded:
        out = out.where(~F.contains("path", F.lit(part)))
    return out


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """path, size and sha256 of every file below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return f.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: files added, removed or altered between two checksums()."""
    j = before.select("path", F.col("sha256").alias("b")).join(after.select("path", F.col("sha256").alias("a")), "path", "full")
    return j.select("path", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "altered").alias("change")).where("change is not null")


#: Bytes that a member's rows may hold before they are passed on, and that are inflated at a time.
PIECE = 1 << 20
MEMBER = "archive string, member string, method int, crc long, size long, packed binary, error string"


def archive_members(files: DataFrame) -> DataFrame:
    """archive, member, method, crc, size, packed, error: the members of zip archives (path, content) as they are packed.

    An archive's list of members is read, and each becomes a row of its own; nothing is
    inflated here. An archive whose list cannot be read is a row without a member, a
    member that does not lie where the list says is a row with an error.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                for rows in _in_pieces(_listed(path, content), lambda r: len(r[5] or b"")):
                    yield pd.DataFrame(rows, columns=[f.split()[0] for f in MEMBER.split(", ")])

    return files.select("path", "content").where("content is not null").mapInPandas(listed, MEMBER)


def _listed(path: str, content: bytes) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
    except (zipfile.BadZipFile, ValueError, NotImplementedError, struct.error) as e:
        yield path, None, None, None, None, None, f"damaged_archive: {e}"
        return
    for i in infos:
        at = i.header_offset
        head = content[at : at + 30]
        start = at + 30 + sum(struct.unpack("<HH", head[26:30])) if len(head) == 30 and head[:4] == b"PK\x03\x04" else -1
        packed = content[start : start + i.compress_size] if start >= 0 else b""
        error = "encrypted" if i.flag_bits & 1 else "damaged_member: no header" if start < 0 else "damaged_member: cut off" if len(packed) < i.compress_size else None
        yield path, i.filename, i.compress_type, i.CRC, i.file_size, None if error else packed, error


def _in_pieces(rows: Iterator[tuple], weight: Callable[[tuple], int], most: int = 16 * PIECE) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weight(r) + 200
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _inflated(packed: bytes, method: int) -> Iterator[bytes]:
    if method == zipfile.ZIP_STORED:
        yield from (packed[i : i + PIECE] for i in range(0, len(packed), PIECE))
        return
    if method != zipfile.ZIP_DEFLATED:
        raise zipfile.BadZipFile(f"packed by method {method}")
    d = zlib.decompressobj(-15)
    rest = packed
    while not d.eof:
        piece = d.decompress(rest, PIECE)
        rest = d.unconsumed_tail
        if not piece and not rest and not d.eof:
            raise zipfile.BadZipFile("cut off")
        yield piece


def _damage(packed: bytes, method: int, crc: int, size: int) -> str | None:
    """What is wrong with a member, found by inflating it once without keeping it."""
    seen = total = 0
    try:
        for piece in _inflated(packed, method):
            seen, total = zlib.crc32(piece, seen), total + len(piece)
            if total > size:
                break
    except (zlib.error, zipfile.BadZipFile) as e:
        return f"damaged_member: {e}"
    return None if (seen, total) == (crc, size) else "damaged_member: wrong checksum"


class _Inflating(io.RawIOBase):
    """A member's bytes as a file that is inflated as it is read."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.left:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.left = piece
        n = min(len(buffer), len(self.left))
        buffer[:n], self.left = self.left[:n], self.left[n:]
        return n


def member_rows(members: DataFrame, columns: list[str], *, most_rows: int | None = None) -> DataFrame:
    """archive, member, row_ord, columns, error: rows of the CSV members that archive_members() lists, and a row for each that cannot be read (row_ord -1).

    Members are dealt out to tasks of their own. Each is checked before a row of it is
    told: a damaged one gives its error and no row, and stops no other. Missing columns and
    values are empty. A member is inflated piece by piece, so only its packed bytes are held whole.
    """
    names = ["archive", "member", "row_ord", *columns, "error"]

    def one(r: tuple) -> Iterator[tuple]:
        archive, member, method, crc, size, packed, error = r
        error = error if isinstance(error, str) else _damage(packed, int(method), int(crc), int(size))
        blank = [None] * len(columns)
        if error:
            yield archive, member, -1, *blank, error
            return
        with io.TextIOWrapper(io.BufferedReader(_Inflating(_inflated(packed, int(method))), PIECE), "utf-8-sig", errors="replace", newline="") as f:
            try:
                for k, row in enumerate(csv_reader.DictReader(f)):
                    if most_rows is not None and k >= most_rows:
                        break
                    yield archive, member, k, *((row.get(c) or "") for c in columns), None
            except csv_reader.Error as e:
                yield archive, member, -1, *blank, f"unreadable_rows: {e}"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False, name=None):
                for rows in _in_pieces(one(r), lambda x: sum(len(c or "") for c in x[3:])):
                    yield pd.DataFrame(rows, columns=names)

    wanted = members.where("member is null or error is not null or lower(member) like '%.csv'")
    return wanted.repartition("archive", "member").mapInPandas(read, "archive string, member string, row_ord long, " + ", ".join(f"`{c}` string" for c in columns) + ", error string")


def archive_rows(spark: SparkSession, path: str, columns: list[str], *, most_members: int | None = None, most_rows: int | None = None) -> DataFrame:
    """member_rows() of the zip archives at a path; Spark's source passes over files of no bytes. The limits are for inspection (the first members by name of an archive, the first rows of each); without them everything is read."""
    members = archive_members(spark.read.format("binaryFile").load(path).select("path", "content"))
    if most_members is not None:
        nth = F.row_number().over(Window.partitionBy("archive").orderBy("member"))
        members = members.where("member is null or lower(member) like '%.csv'").withColumn("nth_", nth).where(F.col("nth_") <= most_members).drop("nth_")
    return member_rows(members, columns, most_rows=most_rows)


def office_text(content: bytes, ending: str) -> tuple[str, str]:
    """(text, error) of a .docx, .xlsx, .html or text file; an error code where it cannot be read."""
    try:
        if ending == "docx":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
            space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p")), ""
        if ending == "xlsx":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = z.namelist()
                space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
                shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")] if "xl/sharedStrings.xml" in names else []
                sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
            rows = []
            for r in sheet.iter(f"{space}row"):
                cells = []
                for c in r.iter(f"{space}c"):
                    v = c.find(f"{space}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{space}t"))
                    cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else inline)
                rows.append("\t".join(x or "" for x in cells))
            return "\n".join(rows), ""
        if ending == "pdf":
            return "", "pdf_needs_extracted_text"
        text = content.decode("utf-8-sig", errors="replace")
        return (re.sub(r"<[^>]+>", " ", text) if ending in ("html", "htm") else text), ""
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError):
        return "", f"unreadable_{ending}"


def office_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, text and error of each text-like file below a folder."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [office_text(c, p.rsplit(".", 1)[-1].lower()) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "text": [g[0] for g in got], "error": [g[1] for g in got]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.lower("path").rlike(r"\.(docx|xlsx|html?|txt|pdf)$")).select("path", "content").mapInPandas(task, "path string, text string, error string")


def first_with_rows(candidates: list[DataFrame], accept: Column | None = None) -> DataFrame:
    """The first table with any (accepted) row, else the last one."""
    for df in candidates:
        if not (df if accept is None else df.where(accept)).isEmpty():
            return df
    return candidates[-1]


def simple_payload(text: str) -> dict:
    """A payload as a dictionary; anything but an object is boxed under `value`."""
    value = json.loads(text)
    return value if isinstance(value, dict) else {"value": value}
