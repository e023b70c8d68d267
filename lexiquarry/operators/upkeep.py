"""Upkeep of a library: names of folders, states to reach, loose stores, redirects folded into articles, lemma groups,
link lists, catalogues, progress. All on tables of dictionaries, files or records."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.functions import fold as fo
from lexiquarry.functions import text as tx

#: Bytes of a folder name.
NAME_BYTES = 80


def folder_name(path: Column) -> Column:
    """The folder of a prepared source: its file name without extension (and the one below a compression suffix), made safe
    on every platform, at most NAME_BYTES bytes and never within a character."""
    name = F.element_at(F.split(path, r"[/\\\\]"), -1)
    bare = F.regexp_replace(F.regexp_replace(name, r"(?i)\.(?:dz|gz)$", ""), r"\.[^.]*$", "")
    tidy = lambda c: F.regexp_replace(F.trim(c), r"[ .]+$", "")
    safe = tidy(F.regexp_replace(bare, r'[<>:"|?*\x00-\x1f\x7f]', "-"))
    most = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(NAME_BYTES)), lambda k: F.octet_length(F.substr(safe, F.lit(1), k)) <= NAME_BYTES))
    fits = F.when(F.octet_length(safe) <= NAME_BYTES, safe).otherwise(tidy(F.substr(safe, F.lit(1), most)))
    return F.coalesce(F.nullif(fits, F.lit("")), F.lit("dictionary"))


def format_tag(path: Column) -> Column:
    """What tells sources of one name apart: the extension, below a compression suffix if there is one."""
    low = F.regexp_replace(F.lower(path), r"(\.[^./]+)\.(?:dz|gz)$", "$1")
    return F.coalesce(F.nullif(F.regexp_extract(low, r"\.([^./]+)$", 1), F.lit("")), F.lit("alt"))


def claimed(sources: DataFrame) -> DataFrame:
    """path and folder: the first of a name takes it, later ones add their tag, and a number from the second of a tag on.
    sources: path and made (the order in which they were prepared)."""
    rows = sources.select("path", "made", folder_name(F.col("path")).alias("_base"), format_tag(F.col("path")).alias("_tag"))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy("_base").orderBy("made", "path")) == 1)
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_base", "_tag", "_first").orderBy("made", "path")))
    later = F.concat("_base", F.lit(" ("), "_tag", F.when(F.col("_k") > 1, F.concat(F.lit(" "), F.col("_k").cast("string"))).otherwise(""), F.lit(")"))
    return rows.select("path", F.when(F.col("_first"), F.col("_base")).otherwise(later).alias("folder"))


def adopted(files: DataFrame) -> DataFrame:
    """path and new_path of loose stores: text and media stores beside other files move into a folder of their name."""
    store = r"(?i)/([^/]+)\.(text|media)\.db$"
    name, kind = F.regexp_extract("path", store, 1), F.lower(F.regexp_extract("path", store, 2))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.filter(F.col("path").rlike(store)).select("path", F.concat(folder, F.lit("/"), folder_name(F.concat(name, F.lit(".x"))), F.lit("/"), kind, F.lit(".db")).alias("new_path"))


def plan(states: DataFrame) -> DataFrame:
    """dict_id and the steps (text, index, media) that bring a dictionary to what is wanted of it.

    states: has_source, has_text, text_current, has_index, has_media, media_current (booleans); want_index (on, off or keep) and
    want_media (on, off, keep, repack or leave). Without a source only the index can change; what needs one is an error."""
    source, text = F.col("has_source"), F.col("has_text")
    step_text = F.when(~source & ~text, "error").when(~source, "none").when(~text, "build").when(~F.col("text_current"), "rebuild").otherwise("none")
    written = step_text.isin("build", "rebuild")
    index, media = F.col("want_index"), F.col("want_media")
    step_index = (
        F.when(step_text == "error", "none")
        .when((index == "off") & F.col("has_index"), "drop")
        .when(((index == "on") & ~F.col("has_index")) | ((index != "off") & (index.eqNullSafe("on") | F.col("has_index")) & written), "build")
        .otherwise("none")
    )
    asked = (media == "on") | (media.isin("keep", "repack") & F.col("has_media"))
    step_media = (
        F.when((media == "off") & F.col("has_media") & source, "drop")
        .when(asked & ~source, "error")
        .when(asked & ((media == "repack") | ~F.col("media_current") | written), "pack")
        .otherwise("none")
    )
    return states.select("dict_id", step_text.alias("text"), step_index.alias("index"), step_media.alias("media"))


def lemma_groups(lines: DataFrame) -> DataFrame:
    """lemma and forms of lemma lines (line: number, value), each lemma once, its forms in the order in which they are first seen."""
    fields = F.filter(F.transform(F.split(fo.lower1(F.regexp_replace("value", "^\ufeff", "")), "\t"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    rows = lines.select("line", fields.alias("f")).filter(F.size("f") > 1).select("line", F.element_at("f", 1).alias("lemma"), F.posexplode(F.slice("f", 2, 1 << 20)).alias("k", "form"))
    # A form is kept where it stands first: one row for each pair before they are gathered.
    pairs = rows.filter("form <> lemma").groupBy("lemma", "form").agg(F.min(F.struct("line", "k")).alias("at"))
    return pairs.groupBy("lemma").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "form"))), lambda x: x["form"]).alias("forms"))


def folded_redirects(entries: DataFrame, names: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names that redirects add to articles (dict_id, entry_id, seq, w), and dangling ones as articles of a link.

    A redirect goes to every article with a name equal to its target, else equal but for case; redirects to redirects dangle.
    names: dict_id, entry_id and w of all names of articles."""
    own = entries.select("dict_id", F.col("id").alias("entry_id"), "w").union(names.select("dict_id", "entry_id", "w")).distinct()
    n = own.select(F.col("dict_id").alias("_d"), "entry_id", F.col("w").alias("_w"), fo.lower1("w").alias("_l"))
    rows = links.join(n, (F.col("dict_id") == F.col("_d")) & (fo.lower1("target") == F.col("_l")), "left").withColumn("_same", F.col("_w") == F.col("target"))
    rows = rows.withColumn("_any", F.max("_same").over(Window.partitionBy("dict_id", "seq")))
    led = rows.filter(F.col("entry_id").isNotNull() & (F.col("_same") | ~F.col("_any"))).select("dict_id", "entry_id", "seq", "w").distinct()
    added = led.join(own, ["dict_id", "entry_id", "w"], "left_anti")
    link = F.concat(F.lit('<p><a href="'), tx.escape_attr(F.concat(F.lit("entry://"), tx.encode_target(F.col("target")))), F.lit('">'), tx.escape_text(F.col("target")), F.lit("</a></p>"))
    return added, rows.filter(F.col("entry_id").isNull()).select("dict_id", "seq", "w", link.alias("body"))


def looks_like_markup(c: Column) -> Column:
    return c.rlike("<[a-zA-Z/!]")


def about(c: Column) -> Column:
    """A description as HTML: markup as it is, prose as paragraphs at empty lines with line breaks inside."""
    whole = F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.regexp_replace(tx.escape_text(whole), r"\r\n?", "\n")
    prose = F.concat(F.lit("<p>"), F.regexp_replace(F.regexp_replace(lines, r"\n[ \t]*\n\s*", "</p><p>"), r"\n", "<br/>"), F.lit("</p>"))
    return F.when(whole == "", "").when(looks_like_markup(c), c).otherwise(prose)


def links_in(text: Column) -> Column:
    """The http links of free text in order, without the punctuation that prose wraps them in."""
    found = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(F.regexp_extract(t, r"(?i)https?://.*", 0), r"""[.,;:!?)\]}>"'`]+$""", ""))
    return F.filter(found, lambda u: F.char_length(u) > 8)


def anchors(page: Column) -> Column:
    """Targets of a page's links in order; those within the page are left out."""
    found = F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*" + tx.VALUE), F.lit(1)), lambda v: tx.unescape(F.regexp_replace(v, "^[\"']|[\"']$", "")))
    return F.filter(found, lambda u: (u != "") & ~u.startswith("#"))


def existing(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """archive and present: *files* where all files of an archive are in the library with their sizes, *name* where one of its
    names is, else *no*. candidates: archive, name, size; library: name, size."""
    own = library.select(F.lower("name").alias("_n"), F.col("size").alias("_s")).distinct()
    rows = candidates.join(own, F.lower("name") == F.col("_n"), "left").groupBy("archive", "name").agg(F.max(F.col("_s").eqNullSafe(F.col("size"))).alias("same"), F.max(F.col("_n").isNotNull()).alias("known"))
    return rows.groupBy("archive").agg(F.when(F.min("same"), "files").when(F.max("known"), "name").otherwise("no").alias("present"))


_ITEM = "code string, url string, sha256 string, bytes long"


def catalogue(text: DataFrame) -> DataFrame:
    """code, url, sha256, bytes and problem of the items of a lemma catalogue (value: a JSON list)."""
    rows = text.select(F.explode(F.from_json("value", f"array<struct<{_ITEM.replace(' ', ':').replace(',:', ',')}>>")).alias("i")).select("i.*")
    wrong = [("code", ~F.coalesce(F.col("code").rlike("^[a-z]{2,3}$"), F.lit(False))), ("url", ~F.coalesce(F.col("url").rlike("^https://[^/]+/."), F.lit(False))), ("sha256", ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))), ("bytes", ~F.coalesce(F.col("bytes") > 0, F.lit(False)))]
    return rows.select("*", reduce(lambda a, b: F.coalesce(a, b), [F.when(c, F.lit(n)) for n, c in wrong]).alias("problem"))


def version_signature(versions: dict[str, int]) -> str:
    """All reader versions in one string, by format: what was concluded from them is out of date once it changes."""
    return "".join(f"{k}={v}," for k, v in sorted(versions.items()))


def resolved_link(base: Column, ref: Column) -> Column:
    """path, query and fragment of a reference in the article at a stored path; null where it leaves the archive.
    Dot segments go, also percent-encoded ones, and none climbs above the root."""
    outside = (ref == "") | ref.rlike(r"^(?:#|\?|//|[a-zA-Z][a-zA-Z0-9+.-]*:)")
    fragment = F.regexp_extract(ref, "(?s)#.*$", 0)
    before = F.regexp_replace(ref, "(?s)#.*$", "")
    query = F.regexp_extract(before, r"(?s)\?.*$", 0)
    path = F.regexp_replace(before, r"(?s)\?.*$", "")
    codes = ["%", "?", "#", *map(chr, range(33)), "\x7f"]
    folder = reduce(lambda a, x: F.replace(a, F.lit(x), F.lit(f"%{ord(x):02X}")), codes, F.regexp_extract(base, "(?s)^.*/", 0))
    whole = F.when(path.startswith("/"), F.expr("''")).otherwise(folder)
    parts = F.split(F.concat(whole, F.regexp_replace(path, "^/", "")), "/")
    dots = lambda x: F.when(x.rlike(r"(?i)^(?:\.|%2e)$"), 1).when(x.rlike(r"(?i)^(?:\.|%2e){2}$"), 2).otherwise(0)
    step = lambda a, x: F.when(dots(x) == 2, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(dots(x) == 1, a).otherwise(F.array_append(a, x))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(dots(F.element_at(parts, -1)) > 0, F.array_append(kept, F.lit(""))).otherwise(kept)
    out = F.array_join(kept, "/")
    return F.when(~outside & (out != ""), F.struct(out.alias("path"), query.alias("query"), fragment.alias("fragment")))


def title_variants(word: str) -> list[str]:
    """Spellings of a title as a page names it: as typed, with a capital, with capital words; spaces stay."""
    words = " ".join(w[:1].upper() + w[1:] for w in word.replace("_", " ").split(" "))
    return list(dict.fromkeys(v for v in (word, word[:1].upper() + word[1:], words) if v))


def by_title(entries: DataFrame, word: str, n: int) -> DataFrame:
    """Entries with a title of one of its spellings, and then those that go on from one, in title order; n a dictionary."""
    tries = title_variants(word)
    exact = F.col("w").isin(tries)
    rows = entries.filter(reduce(lambda a, b: a | b, [F.col("w").startswith(v) for v in tries]))
    place = Window.partitionBy("dict_id").orderBy(F.when(exact, 0).otherwise(1), "w", "id")
    return rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= n).select("dict_id", "rank", "id", "w")


def extract_plan(resources: DataFrame) -> DataFrame:
    """dict_id, seq, name and file: where each resource is written. Names that clash where case is ignored are numbered; junk
    and names that come to nothing are left out."""
    rows = resources.filter(~tx.is_junk(F.col("name"))).withColumn("_key", tx.resource_key(F.col("name"))).filter("_key <> ''")
    safe = F.regexp_replace("_key", r'[<>:"|?*\x00-\x1f\x7f]', "-")
    rows = rows.withColumn("_file", safe).withColumn("_k", F.row_number().over(Window.partitionBy("dict_id", "_file").orderBy("seq", "name")))
    ending = r"\.[^./]*$"
    again = F.concat(F.regexp_replace("_file", ending, ""), F.lit(" ("), F.col("_k").cast("string"), F.lit(")"), F.regexp_extract("_file", ending, 0))
    file = F.when(F.col("_k") == 1, F.col("_file")).otherwise(again)
    return rows.select(*resources.columns, file.alias("file"))


def extract(resources: DataFrame, folder: str) -> None:
    """Write the resources (dict_id, seq, name, content) to files below a folder that all executors mount."""

    def write(rows: Iterator) -> None:
        for r in rows:
            path = os.path.join(folder, str(r["dict_id"]), *r["file"].split("/"))
            os.makedirs(os.path.dirname(path), exist_ok=True)
            # Written aside and moved: a task that runs again leaves whole files.
            with open(f"{path}.part", "wb") as f:
                f.write(r["content"])
            os.replace(f"{path}.part", path)

    extract_plan(resources).select("dict_id", "file", "content").foreachPartition(write)


def event(name: str, value: dict) -> str:
    """One frame of an event stream."""
    return f"event: {name}\ndata: {json.dumps(value, separators=(',', ':'), ensure_ascii=False)}\n\n"


def progress(spark: SparkSession, group: str) -> str:
    """Where the jobs of a group stand, as an event: stages running, tasks done, running and failed, and all."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [j for k in tracker.getJobIdsForGroup(group) if (j := tracker.getJobInfo(k)) is not None]
    stages = [s for j in jobs for k in j.stageIds if (s := tracker.getStageInfo(k)) is not None]
    count = lambda field: sum(getattr(s, field) for s in stages)
    states = {j.status for j in jobs}
    state = "failed" if "FAILED" in states else "running" if "RUNNING" in states else "done" if jobs else "idle"
    return event("progress", {"state": state, "stages": len(stages), "tasks": count("numTasks"), "done": count("numCompletedTasks"), "running": count("numActiveTasks"), "failed": count("numFailedTasks")})
