"""Archives of dictionary files: what is in a ZIP, and names that were stored in an old code page."""

from __future__ import annotations

import io
import unicodedata
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions.shipping import ship
from lexiquarry.sources import formats as rec

#: Single-byte code pages that archivers have stored names in, the likeliest first.
CODE_PAGES = "cp1251 cp1252 cp866 koi8-r cp1250 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 iso8859-2 iso8859-5 iso8859-7 cp437 cp850".split()
#: Signs that file names are written with.
COMMON = frozenset(" ._-()[]{}'’,;&+#!~@%")


def likeness(name: str) -> int:
    """How much a reading looks like a name that a person typed: words of one script count for it, signs that no name has against it."""
    total, word = 0, []

    def closed() -> int:
        ascii_ = sum(c.isascii() for c in word)
        latin = sum(not c.isascii() and unicodedata.name(c, "").startswith("LATIN") for c in word)
        other = len(word) - ascii_ - latin
        word.clear()
        if not latin and not other:
            return ascii_
        return ascii_ + 2 * latin - 2 * other if ascii_ else 2 * other - 2 * latin

    for c in name:
        if c.isalpha():
            word.append(c)
            continue
        total += closed()
        if c.isascii() and (c.isdigit() or c in COMMON):
            total += 1
        elif not (c.isascii() and c.isprintable()) and not c.isdigit() and not c.isspace():
            total -= 4
    return total + closed()


def readings(raw: bytes, declared: bool) -> tuple[str, list[str]]:
    """The name to show and every spelling that it may be asked by. declared: whether the archive says it is UTF-8."""
    try:
        text: str | None = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = None
    if text is not None and (text.isascii() or declared):
        return text, [text]
    tried: dict[str, None] = {} if text is None else {text: None}
    for page in CODE_PAGES:
        try:
            tried.setdefault(raw.decode(page))
        except UnicodeDecodeError:
            continue
    names = list(tried) or [raw.decode("utf-8", "replace")]
    best = max(names, key=likeness)
    return (text if text is not None else best if likeness(best) > 0 else raw.decode("utf-8", "replace")), names


MEMBER = "path string, member string, spellings array<string>, size long, kind string, format string, stem string, problem string"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = "path member spellings size kind format stem problem".split()
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        rows: list[tuple] = []
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            try:
                for m in zipfile.ZipFile(io.BytesIO(content.as_py())).infolist():
                    if m.is_dir():
                        continue
                    utf8 = bool(m.flag_bits & 0x800)
                    shown, names = readings(m.orig_filename.encode("utf-8" if utf8 else "cp437"), utf8)
                    kind, form = rec.classify(shown.rsplit("/", 1)[-1])
                    rows.append((path, shown, names, m.file_size, kind, form, rec.stem(shown), None))
            except Exception as e:  # noqa: BLE001  a bad archive is reported, the others are read
                rows.append((path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        made = list(zip(*rows)) if rows else [[]] * len(columns)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(made, types)], columns)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The files inside every ZIP archive below a folder: kind, format and stem tell dictionaries and their companions; rows
    with a problem name archives that cannot be read."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)
    return files.select("path", "content").mapInArrow(_members, MEMBER)


def candidates(members: DataFrame) -> DataFrame:
    """Each dictionary of an archive with its companion files."""
    main = members.filter("kind = 'main'").select("path", "stem", F.col("member").alias("main"), "format", "size")
    other = members.filter("kind = 'companion'").groupBy(F.col("path").alias("_p"), F.col("stem").alias("_s")).agg(F.sort_array(F.collect_list("member")).alias("companions"))
    joined = main.join(other, (F.col("path") == F.col("_p")) & (F.col("stem") == F.col("_s")), "left")
    return joined.select("path", "main", "format", "size", F.coalesce("companions", F.array().cast("array<string>")).alias("companions"))
