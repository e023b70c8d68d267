"""Prepared SQLite stores of dictionaries (tables meta, entry and alias), read from their bytes.

A body is told by its first byte: 0 a raw DEFLATE stream; in version 2 also 1, a zstd frame without its magic number
over the store's raw dictionary, and 2 to 8, reserved and read as empty; anything else is the article itself."""

from __future__ import annotations

import sqlite3
import zlib
from collections.abc import Iterator

from lexiquarry.sources.formats import Record

VERSIONS = (1, 2)
MOST_BODY = 1 << 28
_ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


class Bodies:
    """Decodes the bodies of one store."""

    def __init__(self, version: int, dictionary: bytes | None = None) -> None:
        self.version = version
        self.zstd = None
        if version >= 2:
            import zstandard

            known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
            self.zstd = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()

    def decode(self, body: bytes | str | None) -> str:
        if not body:
            return ""
        raw = body.encode("utf-8") if isinstance(body, str) else body
        if raw[0] == 0:
            out = zlib.decompressobj(-15).decompress(raw[1:], MOST_BODY)
        elif self.version >= 2 and raw[0] == 1:
            out = self.zstd.decompress(_ZSTD_MAGIC + raw[1:], max_output_size=MOST_BODY)
        elif self.version >= 2 and raw[0] <= 8:
            out = b""
        else:
            out = raw
        return out.decode("utf-8", "replace")


def opened(data: bytes) -> tuple[sqlite3.Connection, int]:
    """The store in memory and its version, which has to be a known one."""
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    version = db.execute("PRAGMA user_version").fetchone()[0]
    if version not in VERSIONS:
        raise ValueError(f"a store of version {version} is not read")
    return db, version


def read_meta(data: bytes) -> dict[str, str]:
    db, _ = opened(data)
    return {k: v or "" for k, v in db.execute("SELECT key, value FROM meta")}


def read_store(data: bytes) -> Iterator[Record]:
    """Entries in id order with their aliases in row order; aliases of no entry are left out, bodies that cannot be
    decoded are empty."""
    db, version = opened(data)
    has = {n for (n,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    found = db.execute("SELECT data FROM body_dict WHERE id = 0").fetchone() if version >= 2 and "body_dict" in has else None
    bodies = Bodies(version, found[0] if found else None)
    more: dict[int, list[str]] = {}
    if "alias" in has:
        for w, entry in db.execute("SELECT w, entry_id FROM alias ORDER BY rowid"):
            more.setdefault(entry, []).append(w)
    for entry, w, m in db.execute("SELECT id, w, m FROM entry ORDER BY id"):
        try:
            body = bodies.decode(m)
        except Exception:  # noqa: BLE001  zlib and zstandard raise errors of their own
            body = ""
        yield Record([w, *more.get(entry, [])], body)
