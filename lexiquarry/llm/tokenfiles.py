"""Token ids as Parquet list columns, for selective reads of tokens and of metadata.

Texts are encoded with the tokenizers library, an end id closes each document, and
rows are written in ascending doc_id order (range partitions, sorted): ``row`` (ascending over all
files), ``doc_id``, ``n_tokens`` and ``ids``. Ids are dictionary encoded (a vocabulary fits
a dictionary page), row numbers, keys and lengths are delta encoded, row groups and pages have set sizes, and
Parquet's page indexes let a reader skip to the pages of a key range. The places of all
documents come from the metadata columns alone.

The tokenizers library takes about 0.26 CPU seconds a megabyte of text, more than a whole run may. So texts are cut
into pieces in numpy (``pieces``: classes and pattern are the library's own), and the library's model encodes every distinct
piece that a worker has not met before; a piece has the same ids wherever it stands. Texts with special tokens, and all texts under a
tokenizer file with another normalizer or pre-tokenizer, go to the library whole.

Defined cases: a null or empty text has the end id alone; rows with equal doc_ids follow each other in
order of text, null doc_ids come first; texts are taken whole; an empty table gives no rows; columns
besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, partitions, scratch, steps, table, text_buffers
from .pieces import Lists, Memory, byte_ends, byte_symbols, code_points, kinds, starts

END_ID = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
DICTIONARY_BYTES = 1 << 20
#: Bytes of text that are encoded at once, at least one text; pieces that a worker remembers.
STEP = 1 << 19
REMEMBERED = 1 << 20
#: New pieces that are encoded in one call of the library.
TOGETHER = 32


def _pair(merge) -> list[str]:
    return merge.split(" ") if isinstance(merge, str) else merge


class ByteBpe(Memory):
    """One byte-level tokenizer file and the pieces met lately. kind: the classes of its code points."""

    def __init__(self, data: bytes, kind: np.ndarray | None) -> None:
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_str(data.decode("utf-8")), kind
        self.specials = [t["content"].encode("utf-8") for t in json.loads(data)["added_tokens"]]
        symbol = {c: b for b, c in enumerate(byte_symbols())}
        self.symbols = {b: ord(c) for c, b in symbol.items()}
        # A byte that is in no UTF-8 text and in no merge keeps pieces apart that are encoded in one call.
        model = json.loads(data)["model"]
        merged = set("".join(a + b for a, b in map(_pair, model["merges"])))
        free = [c for c, b in symbol.items() if b >= 0xF8 and c not in merged and c in model["vocab"]]
        self.apart = (bytes([symbol[free[0]]]), model["vocab"][free[0]]) if free else None
        super().__init__(REMEMBERED)

    def reset(self) -> None:
        super().reset()
        self.ids = Lists(np.int32)

    def learn(self, words: list[bytes]) -> None:
        tokenize = self.library.model.tokenize
        if self.apart is None:
            self.ids.add([[t.id for t in tokenize(w.decode("latin-1").translate(self.symbols))] for w in words])
            return
        byte, end = self.apart
        found: list[int] = []
        for i in range(0, len(words), TOGETHER):
            found += [t.id for t in tokenize(byte.join(words[i : i + TOGETHER]).decode("latin-1").translate(self.symbols))]
            found.append(end)
        ids = np.array(found, np.int32)
        ends = np.flatnonzero(ids == end)
        self.ids.extend(np.delete(ids, ends), np.diff(ends, prepend=-1) - 1)

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after another, and where those of each text end (with a leading 0)."""
        data = flat.tobytes()
        if self.kind is None or any(s in data for s in self.specials):
            return self._whole([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if flat.max() < 128:
            code, ends, rows = flat.astype(np.uint32), None, offsets
        else:
            code = code_points(data)
            ends = byte_ends(code)
            rows = np.searchsorted(ends, offsets)
        first = rows[:-1][np.diff(rows) > 0]
        begin = np.flatnonzero(starts(code, self.kind[code], first, True))
        of_row = np.searchsorted(begin, rows)
        if ends is not None:
            begin = ends[begin]
        ids, at = self.ids_of(flat, begin)
        return ids, at[of_row]

    def ids_of(self, flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers = self.numbers(flat, begin, np.diff(begin, append=len(flat)))
        return self.ids.joined(numbers)

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.library.encode(t.decode("utf-8"), add_special_tokens=False).ids, np.int32) for t in texts]
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)


def piece_kinds(data: bytes) -> np.ndarray | None:
    """The classes of all code points, if the tokenizer file cuts texts as ``pieces`` does; else None."""
    from tokenizers import Tokenizer

    spec = json.loads(data)
    before = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or spec["model"].get("type") != "BPE" or any(t["normalized"] for t in spec["added_tokens"]):
        return None
    return kinds(Tokenizer.from_str(data.decode("utf-8")).pre_tokenizer)


_LOADED: dict[bytes, ByteBpe] = {}


def _encoded(shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, kind = shared.value
        key = hashlib.sha256(data).digest()
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = ByteBpe(data, kind)
        bpe = _LOADED[key]
        for batch in batches:
            flat, offsets = text_buffers(batch["text"])
            for i, j in steps(offsets, STEP):
                ids, ends = bpe.encode(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, ends[1:], np.int32(end_id))
                ends += np.arange(j - i + 1)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.record_batch([batch["doc_id"][i:j].cast(pa.int64()), pa.array(np.diff(ends).astype(np.int32)), lists], ["doc_id", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Write the token files of the documents to a folder."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    shared = spark.sparkContext.broadcast((data, piece_kinds(data)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = docs.select("doc_id", "text")
    ordered = rows.repartitionByRange(partitions(spark), order[0]).sortWithinPartitions(*order)
    tokens = mapped(ordered, _encoded(shared, end_id), "doc_id long, n_tokens int, ids array<int>")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.dictionary.page.size": DICTIONARY_BYTES,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#row": "false",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#n_tokens": "false",
    }
    # The number rises with the partition and inside it: the global order of rows.
    tokens.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_tokens", "ids").write.options(**options).parquet(path)


_SCHEMA = "row long, doc_id long, n_tokens int, ids array<int>"


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of token files; a condition on row or doc_id skips row groups and pages."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    rows = rows if where is None else rows.filter(where)
    return rows.select(*columns) if columns else rows


def places(rows: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """start beside every row: the ids of all rows before it. rows needs row and n_tokens; lengths are
    the same two columns from a narrower read, if there is one."""
    part = F.shiftright("row", 33)
    rows = rows.withColumn("_part", part)
    # One row a written partition.
    totals = (rows if lengths is None else lengths.withColumn("_part", part)).groupBy("_part").agg(F.sum("n_tokens").alias("_sum"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    before = Window.partitionBy("_part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return rows.join(F.broadcast(totals), "_part").withColumn("start", (F.col("_base") + F.col("_own")).cast("long")).drop("_part", "_base", "_own")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["ids"]
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.record_batch([batch["row"], batch["doc_id"], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["row", "doc_id", "n_tokens", "ids_crc32"])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer_path())
    rows = mapped(read_tokens(spark, path, columns=["row", "doc_id", "ids"]), _checksums, "row long, doc_id long, n_tokens long, ids_crc32 long")
    return places(rows, read_tokens(spark, path, columns=["row", "n_tokens"])).select("doc_id", "start", "n_tokens", "ids_crc32")
