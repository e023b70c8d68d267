"""Library operators: ingest with redirects, exports, fingerprints, and the joins that keep a library in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import fold as fo
from lexiquarry.functions import text as tx
from lexiquarry.functions.numbering import numbered

#: Rows in a row that are numbered together.
STRETCH = 1 << 16
HISTORY_MOST, FAVOURITES_MOST, WORD_MOST = 500, 10_000, 256


def ingest(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, aliases and redirects of raw records (dict_id, seq, headwords, body, kind, link_to).

    Headwords are trimmed and empty ones dropped; a record whose first is empty is left out. Ids follow reader order
    inside a dictionary; aliases differ from their headword."""
    words = F.filter(F.transform("headwords", lambda w: F.trim(w)), lambda w: w != "")
    first = F.trim(F.get("headwords", F.lit(0)))
    rows = raw.filter(first != "").withColumn("words", words)
    links = rows.filter(F.coalesce("link_to", F.lit("")) != "").select("dict_id", "seq", F.element_at("words", 1).alias("w"), F.trim("link_to").alias("target"))
    kept = numbered(rows.filter(F.coalesce("link_to", F.lit("")) == ""), "dict_id", F.floor(F.col("seq") / STRETCH), ["seq"], "pos").withColumn("id", F.col("pos") + 1)
    entries = kept.select("dict_id", "id", F.element_at("words", 1).alias("w"), tx.body_of(F.col("body"), F.col("kind")).alias("body"))
    more = kept.select("dict_id", "id", F.element_at("words", 1).alias("first"), F.posexplode("words").alias("k", "w")).filter((F.col("k") > 0) & (F.col("w") != F.col("first")))
    more = numbered(more, "dict_id", F.floor(F.col("id") / STRETCH), ["id", "k"], "pos")
    aliases = more.select("dict_id", (F.col("pos") + 1).alias("row"), "w", F.col("id").alias("entry_id"))
    return entries, aliases, links


def resolve_redirects(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Every redirect with the entry that it leads to (null if none): per-character case is ignored, a target spelled
    the same comes first, then the least id."""
    e = entries.select(F.col("dict_id").alias("_d"), F.col("id").alias("entry_id"), F.col("w").alias("_w"), fo.lower1("w").alias("_l"))
    rows = links.withColumn("_t", fo.lower1("target")).join(e, (F.col("dict_id") == F.col("_d")) & (F.col("_t") == F.col("_l")), "left")
    best = Window.partitionBy("dict_id", "seq").orderBy((F.col("_w") != F.col("target")).cast("int"), "entry_id")
    return rows.withColumn("_k", F.row_number().over(best)).filter("_k = 1").select("dict_id", "seq", "w", "target", "entry_id")


def counters(entries: DataFrame) -> DataFrame:
    """Entries, distinct headwords and sub-entries of each dictionary."""
    return entries.groupBy("dict_id").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("w").alias("distinct_headwords"), F.count_if(F.col("w").like("@_%")).alias("subs"))


def csv_rows(entries: DataFrame, aliases: DataFrame, redirects: DataFrame) -> DataFrame:
    """word, body and alternates as a dictionary CSV has them; redirects are links; nameless rows are dropped."""
    alts = aliases.groupBy(F.col("dict_id").alias("_d"), F.col("entry_id").alias("_e")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("row", "w"))), lambda x: x["w"])).alias("alts"))
    rows = entries.filter(F.trim("w") != "").join(alts, (F.col("dict_id") == F.col("_d")) & (F.col("id") == F.col("_e")), "left")
    rows = rows.select("dict_id", F.col("w").alias("word"), "body", F.coalesce("alts", F.lit("")).alias("alts"))
    link = F.concat(F.lit('<a href="entry://'), tx.encode_target(F.col("target")), F.lit('">'), tx.escape_text(F.col("target")), F.lit("</a>"))
    return rows.unionByName(redirects.select("dict_id", F.col("w").alias("word"), link.alias("body"), F.lit("").alias("alts")))


def write_csv(rows: DataFrame, path: str, info: dict[str, str]) -> None:
    """Dictionary CSV files, a folder for each dictionary; #key rows go first as one small file."""
    head = rows.sparkSession.createDataFrame([(f"#{k}", v) for k, v in info.items()], "word string, body string")
    head.coalesce(1).write.mode("overwrite").csv(f"{path}/info")
    rows.write.mode("overwrite").partitionBy("dict_id").option("quoteAll", True).csv(f"{path}/rows")


def fingerprint(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """One digest a dictionary: per-entry digests over length-prefixed fields and sorted aliases, added up without order."""
    alts = aliases.groupBy(F.col("dict_id").alias("_d"), F.col("entry_id").alias("_e")).agg(F.concat_ws("\x1f", F.sort_array(F.collect_list("w"))).alias("alts"))
    rows = entries.join(alts, (F.col("dict_id") == F.col("_d")) & (F.col("id") == F.col("_e")), "left")
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    own = F.sha2(F.concat(part(F.col("w")), part(F.coalesce("alts", F.lit(""))), part(F.coalesce("body", F.lit("")))), 256)
    quarter = lambda k: F.sum(F.conv(F.substring(own, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy("dict_id").agg(F.count(F.lit(1)).alias("entries"), *[quarter(k).alias(f"q{k}") for k in range(4)])
    return sums.select("dict_id", "entries", F.sha2(F.concat_ws("|", "entries", *[F.col(f"q{k}").cast("string") for k in range(4)]), 256).alias("fingerprint"))


def changed(known: DataFrame, found: DataFrame) -> DataFrame:
    """dict_id and whether the source changed: size and time equal means no, else the digest decides; gone means no."""
    f = found.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("digest").alias("_h"))
    rows = known.join(f, F.col("path") == F.col("_p"), "left")
    differs = F.col("_p").isNotNull() & ~((F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m"))) & (F.col("digest") != F.col("_h"))
    return rows.select("dict_id", differs.alias("changed"))


def orphans(known: DataFrame, found: DataFrame) -> DataFrame:
    """Prepared dictionaries whose source is gone and that are not kept."""
    return known.filter(~F.col("kept")).join(found.select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_anti")


def relink(lost: DataFrame, found: DataFrame) -> DataFrame:
    """Moved sources: lost ones and new files of equal name, size and digest, one to one in order."""
    keys = ["name", "size", "digest"]
    a = lost.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("dict_id")))
    b = found.select(*keys, F.col("path").alias("new_path")).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("new_path")))
    return a.join(b, [*keys, "_k"]).select("dict_id", "path", "new_path")


def history(log: DataFrame, most: int = HISTORY_MOST) -> DataFrame:
    """Looked-up words, newest first: each once but for case, in its last spelling, the newest ``most``."""
    rows = log.withColumn("word", F.trim(F.regexp_replace("word", r"[\n\r\t]", " "))).filter((F.col("word") != "") & (F.char_length("word") <= WORD_MOST))
    own = Window.partitionBy(fo.lower1("word")).orderBy(F.desc("ts"), F.desc("seq"))
    last = rows.withColumn("_k", F.row_number().over(own)).filter("_k = 1")
    top = last.orderBy(F.desc("ts"), F.desc("seq")).limit(most)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("seq")))).select("pos", "word")


def pick(resources: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Resources that an include glob names and no exclude glob does; all of them without include globs."""
    key = tx.resource_key(F.col("name"))
    yes = F.lit(not include)
    for g in include:
        yes = yes | key.rlike(tx.glob_regex(g))
    for g in exclude:
        yes = yes & ~key.rlike(tx.glob_regex(g))
    return resources.filter(yes & ~tx.is_junk(F.col("name")))


def collisions(resources: DataFrame) -> DataFrame:
    """Names that would share a file where case is ignored."""
    key = tx.resource_key(F.col("name"))
    twice = resources.groupBy("dict_id", key.alias("path_key")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))
    return twice.filter("n > 1")


def media_pack(resources: DataFrame) -> DataFrame:
    """One row a resource name: the first of several, junk left out, with its media type."""
    own = Window.partitionBy("dict_id", tx.resource_key(F.col("name"))).orderBy("seq")
    rows = resources.filter(~tx.is_junk(F.col("name"))).withColumn("_k", F.row_number().over(own)).filter("_k = 1")
    return rows.select("dict_id", tx.resource_key(F.col("name")).alias("name"), tx.mime(F.col("name")).alias("mime"))


def ndjson(hits: DataFrame, columns: list[str]) -> DataFrame:
    """Result lines of a search, one JSON object a row, to be read with toLocalIterator."""
    return hits.select(F.to_json(F.struct(F.lit("hit").alias("type"), *columns)).alias("line"))
