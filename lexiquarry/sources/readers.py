"""Reads folders of dictionary files into raw records, one plan for all of them.

Files come through Spark's own binary reader, so any store that Spark reads will do. A
dictionary is the files that share a folder and a stem; one task parses one dictionary, as the formats are
sequential, and what cannot be parsed becomes a row in ``problems``, not a failure."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions.shipping import ship
from lexiquarry.sources import babylon, containers, stores
from lexiquarry.sources import formats as rec

RECORD = "dict_id string, seq long, headwords array<string>, body string, kind string, link_to string, problem string"
#: Files above this are not read, and named in ``problem``: a binary row holds the whole file.
MOST_BYTES = 1 << 30


#: The files of a StarDict dictionary beside its main one.
SETS = (".idx", ".idx.gz", ".dict", ".dict.dz", ".syn")


def _suffix_case(name: Column, what: str) -> Column:
    """Kind or format of a file name by its longest known suffix, as one CASE."""
    known = [(s, "main", f) for s, f in rec.MAIN.items()] + [(s, "companion", f) for s, f in rec.COMPANION.items()] + [(s, "candidate", "") for s in rec.CANDIDATE]
    out = None
    for suffix, kind, form in sorted(known, key=lambda k: (-len(k[0]), k[0])):
        value = F.lit(kind if what == "kind" else form)
        test = F.lower(name).endswith(suffix)
        out = F.when(test, value) if out is None else out.when(test, value)
    rest = out.otherwise(F.lit("other" if what == "kind" else ""))
    return F.when(name.rlike(rec.PART.pattern.replace(r"\.zim", r"(?i)\.zim")), F.lit("companion" if what == "kind" else "zim")).otherwise(rest)


def _stem(name: Column) -> Column:
    suffixes = sorted([*rec.MAIN, *rec.COMPANION], key=len, reverse=True)
    return F.regexp_replace(name, r"(?i)(?:\.zim[a-z]{2}|" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$", "")


def discover(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """path, name, kind, format, stem, size and mtime of the files below a folder; hidden and excluded folders are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.filter(~F.col("path").rlike(r"/\.[^/]*(/|$)"))
    for x in excluded:
        rows = rows.filter(~F.col("path").contains(f"/{x}/"))
    return rows.select("path", name.alias("name"), _suffix_case(name, "kind").alias("kind"), _suffix_case(name, "format").alias("format"), _stem(F.col("path")).alias("stem"), "size", "mtime").dropDuplicates(["path"])


def _parsed(rows):
    every = {n: c for n, c in zip(rows["name"].to_pylist(), rows["content"].to_pylist())}
    # Files that a card file includes stand under a leading NUL; they are no dictionaries here.
    included = {n[1:]: c for n, c in every.items() if n[0] == "\0" and c}
    files = {n: c for n, c in every.items() if n[0] != "\0"}
    kinds = {n: rec.classify(n) for n in files}
    out: list[tuple] = []
    own = rows["stem"][0].as_py()
    if not files:
        return pa.table([pa.array([], t) for t in _TYPES], _COLUMNS)
    by_suffix = lambda *ends: next((c for n, c in files.items() if n.lower().endswith(ends)), b"")
    for name in sorted(n for n, k in kinds.items() if k[0] == "main"):
        form = kinds[name][1]
        try:
            large = [n for n, c in files.items() if c is None and (n == name or form == "stardict" and n.lower().endswith(SETS) or rec.PART.search(n))]
            if large:
                raise ValueError(f"not read, as {', '.join(sorted(large))} is above {MOST_BYTES} bytes")
            if form == "stardict":
                found = rec.read_stardict(rec.stardict_info(files[name]), by_suffix(".idx", ".idx.gz"), by_suffix(".dict", ".dict.dz"), by_suffix(".syn"))
            elif form == "dsl":
                found = rec.read_dsl(files[name], included, name)
            elif form == "zim":
                found = containers.read_zim(files[name] + b"".join(files[n] for n in sorted(files) if n != name and rec.PART.search(n)))
            else:
                found = {"csv": rec.read_csv, "json": rec.read_json, "markdown": rec.read_markdown, "slob": rec.read_slob, "mdx": containers.read_mdx, "bgl": babylon.read_bgl, "store": stores.read_store}[form](files[name])
            for r in found:
                link = r.link_to or rec.link_target(r.body)
                out.append((own, len(out), r.headwords, "" if link else r.body, r.kind, link, None))
        except KeyError:
            out.append((own, -1, [], "", "", "", f"{name}: no reader for {form}"))
        except Exception as e:  # noqa: BLE001  a bad file is reported, the others are read
            out.append((own, -1, [], "", "", "", f"{name}: {type(e).__name__}: {e}"))
    out += [(own, -1, [], "", "", "", f"{n}: not read, as it is above {MOST_BYTES} bytes") for n in sorted(files) if files[n] is None and kinds[n][0] == "companion"]
    columns = list(zip(*out)) if out else [[]] * 7
    return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES)], _COLUMNS)


_COLUMNS = ["dict_id", "seq", "headwords", "body", "kind", "link_to", "problem"]
_TYPES = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string()]


def _includes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The card files that each card file includes: its stem and their paths in its folder, lower-cased."""
    for batch in batches:
        rows = []
        for stem, path, content in zip(batch["stem"].to_pylist(), batch["path"].to_pylist(), batch["content"]):
            try:
                names = rec.dsl_includes(content.as_py())
            except (OSError, EOFError, zlib.error):  # such a file is reported where it is read
                names = []
            rows += [(stem, f"{path.rsplit('/', 1)[0]}/{n}".lower()) for n in names]
        yield pa.record_batch({"_stem": pa.array([r[0] for r in rows], pa.string()), "_path": pa.array([r[1] for r in rows], pa.string())})


def records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of every dictionary below a folder, for ``operators.library.ingest``; rows with a problem name files
    that were not read, those above ``MOST_BYTES`` among them."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(~F.col("path").rlike(r"/\.[^/]*(/|$)"))
    name = F.element_at(F.split("path", "/"), -1)
    own = [_stem(F.col("path")).alias("stem"), name.alias("name")]
    # Large files come by name alone: their bytes are never asked for.
    rows = files.filter(F.col("length") <= MOST_BYTES).select(*own, "content").union(files.filter(F.col("length") > MOST_BYTES).select(*own, F.lit(None).cast("binary")))
    # Card files come again under the stem of each file that includes them, also by way of others (four levels).
    cards = files.filter(F.lower(name).rlike(r"\.dsl(?:\.dz)?$") & (F.col("length") <= MOST_BYTES))
    links = cards.select(_stem(F.col("path")).alias("stem"), "path", "content").mapInArrow(_includes, "_stem string, _path string").distinct()
    reach = links
    for _ in range(3):
        further = reach.join(links.select(F.col("_stem").alias("_from"), F.col("_path").alias("_to")), F.lower("_from") == F.regexp_replace("_path", r"\.dsl(?:\.dz)?$", "")).select("_stem", F.col("_to").alias("_path"))
        reach = reach.union(further).distinct()
    again = cards.join(reach, F.lower("path") == F.col("_path")).select(F.col("_stem").alias("stem"), F.concat(F.lit("\0"), name).alias("name"), "content")
    return rows.union(again).groupBy("stem").applyInArrow(_parsed, RECORD)


def dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """One row a dictionary: its files, size and newest change."""
    found = discover(spark, path)
    main = F.max(F.when(F.col("kind") == "main", F.col("format")))
    return found.filter(F.col("kind") != "other").groupBy(F.col("stem").alias("dict_id")).agg(main.alias("format"), F.sort_array(F.collect_list("name")).alias("files"), F.sum("size").alias("size"), F.max("mtime").alias("mtime")).filter(F.col("format").isNotNull())
