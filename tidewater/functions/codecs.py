"""Binary formats that no built-in expression reads: bencode, base32, frames.

Values are decoded batch by batch through Arrow. A value that does not decode
gives null (or an error column, where the function has one), never a failure.
"""

from __future__ import annotations

import base64
import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Malformed(ValueError):
    """The bytes are no bencoded value."""


def bdecode(data: bytes) -> Any:
    """L1: one value that fills data: int, bytes, list or dict (bytes keys).

    Strict: no leading zeros, no minus zero, only digits, nothing after the value.
    """
    value, end = bscan(data, 0, True)
    if end != len(data):
        raise Malformed(f"{len(data) - end} bytes after the value")
    return value


def bscan(data: bytes, at: int = 0, build: bool = False) -> tuple[Any, int]:
    """The value that begins at `at` (None unless build) and the place after it. Nesting is kept on a list, not the stack."""
    open_: list[tuple[int, list]] = []
    while True:
        if at >= len(data):
            raise Malformed("ends within a value")
        mark = data[at]
        if mark in b"ld":
            open_.append((mark, []))
            at += 1
            continue
        if mark == ord("e"):
            if not open_:
                raise Malformed("end of nothing")
            kind, items = open_.pop()
            at += 1
            value: Any = items
            if kind == ord("d"):
                if len(items) % 2 or not all(isinstance(k, bytes) for k in items[::2]):
                    raise Malformed("dictionary without a value or with a key that is no string")
                value = dict(zip(items[::2], items[1::2], strict=True))
        elif mark == ord("i"):
            end = data.find(b"e", at)
            digits = data[at + 1 : end] if end > 0 else b""
            bare = digits.removeprefix(b"-")
            if not bare.isdigit() or (bare != b"0" and bare[:1] == b"0") or digits == b"-0":
                raise Malformed("bad integer")
            value, at = int(digits), end + 1
        else:
            colon = data.find(b":", at, at + 20)
            size = data[at:colon] if colon > 0 else b""
            if not size.isdigit() or (size != b"0" and size[:1] == b"0"):
                raise Malformed("bad length")
            end = colon + 1 + int(size)
            if end > len(data):
                raise Malformed("string longer than the data")
            value, at = data[colon + 1 : end], end
        if not open_:
            return (value if build else None), at
        open_[-1][1].append(value)


def bencode(value: Any) -> bytes:
    """L2: bencoding of int, bytes, str, list and dict; keys in the order of their bytes."""
    if isinstance(value, bool) or value is None or isinstance(value, float):
        raise TypeError(f"no bencoding of {value!r}")
    if isinstance(value, int):
        return b"i%de" % value
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, (bytes, bytearray)):
        return b"%d:%s" % (len(value), bytes(value))
    if isinstance(value, dict):
        items = sorted((k.encode() if isinstance(k, str) else k, v) for k, v in value.items())
        return b"d" + b"".join(bencode(k) + bencode(v) for k, v in items) + b"e"
    return b"l" + b"".join(map(bencode, value)) + b"e"


def plain(value: Any) -> Any:
    """A decoded value for JSON: bytes as text, or as {'hex': ...} where they are no UTF-8."""
    if isinstance(value, bytes):
        try:
            return value.decode()
        except UnicodeDecodeError:
            return {"hex": value.hex()}
    if isinstance(value, list):
        return [plain(x) for x in value]
    if isinstance(value, dict):
        return {k.decode("utf-8", "replace"): plain(v) for k, v in value.items()}
    return value


@F.pandas_udf(T.StringType())
def bencode_to_json(data: pd.Series) -> pd.Series:
    """L1 as a column: JSON of a bencoded binary, null if malformed."""

    def one(x):
        try:
            return None if x is None else json.dumps(plain(bdecode(bytes(x))), ensure_ascii=False)
        except (Malformed, ValueError):
            return None

    return data.map(one)


@F.pandas_udf(T.BinaryType())
def json_to_bencode(text: pd.Series) -> pd.Series:
    """L2 as a column: bencoding of JSON text, null where it has none."""

    def raw(x):
        if isinstance(x, dict):
            return bytes.fromhex(x["hex"]) if set(x) == {"hex"} else {k: raw(v) for k, v in x.items()}
        return [raw(v) for v in x] if isinstance(x, list) else x

    def one(x):
        try:
            return None if x is None else bencode(raw(json.loads(x)))
        except (TypeError, ValueError):
            return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def base32_hex(text: pd.Series) -> pd.Series:
    """Lower-case hex of base32 text without padding; bits that fill no byte are dropped."""

    def one(x):
        if x is None:
            return None
        body = x.upper().rstrip("=")
        # 1, 3 and 6 letters too many hold no whole byte: the last one is dropped
        body = body[: len(body) - (len(body) % 8 in (1, 3, 6))]
        try:
            return base64.b32decode(body + "=" * (-len(body) % 8)).hex()
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def hex_base32(text: pd.Series) -> pd.Series:
    """base32 text, without padding, of hex."""
    return text.map(lambda x: None if x is None else base64.b32encode(bytes.fromhex(x)).decode().rstrip("="))


def info_hash(topic: Column) -> Column:
    """Lower-case hex of a topic given as 40 hex digits or 32 base32 letters."""
    return F.when(F.length(topic) == 40, F.lower(topic)).when(F.length(topic) == 32, base32_hex(topic))


FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("offset", T.LongType())])
ARTIFACT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("info_hash", T.StringType()),
        T.StructField("piece_length", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("files", T.ArrayType(FILE)),
        T.StructField("pieces", T.ArrayType(T.StringType())),
        T.StructField("trackers", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


def artifact(data: bytes | None) -> dict:
    """The record of a metadata file; error says what is wrong with it, all else is then null."""
    none = dict.fromkeys(ARTIFACT.names)
    if data is None:
        return none | {"error": "no data"}
    try:
        top = bdecode(bytes(data))
        if not isinstance(top, dict):
            raise Malformed("no dictionary")
        if b"announce" not in top:
            raise Malformed("no announce")
        info = top.get(b"info")
        if not isinstance(info, dict):
            raise Malformed("no info")
        hashes = info.get(b"pieces", b"")
        if not hashes or len(hashes) % 20:
            raise Malformed("pieces are no multiple of 20 bytes")
        if b"files" in info:
            sizes = [("/".join(p.decode("utf-8", "replace") for p in f[b"path"]), f[b"length"]) for f in info[b"files"]]
        else:
            sizes = [(info[b"name"].decode("utf-8", "replace"), info[b"length"])]
        files, at = [], 0
        for path, length in sizes:
            files.append({"path": path, "length": length, "offset": at})
            at += length
        trackers = [top[b"announce"], *(t for tier in top.get(b"announce-list", []) for t in tier)]
        return {
            "name": info[b"name"].decode("utf-8", "replace"),
            "info_hash": hashlib.sha1(bencode(info)).hexdigest(),
            "piece_length": info[b"piece length"],
            "length": at,
            "files": files,
            "pieces": [hashes[i : i + 20].hex() for i in range(0, len(hashes), 20)],
            "trackers": list(dict.fromkeys(t.decode("utf-8", "replace") for t in trackers)),
            "error": None,
        }
    except (Malformed, KeyError, TypeError, AttributeError) as e:
        return none | {"error": f"missing {e}" if isinstance(e, KeyError) else str(e)}


@F.pandas_udf(ARTIFACT)
def read_artifact(data: pd.Series) -> pd.DataFrame:
    """L3 as a column: a struct of ARTIFACT."""
    return pd.DataFrame([artifact(x) for x in data], columns=ARTIFACT.names)


def build_artifact(name: str, content: bytes, piece_length: int, trackers: list[str]) -> bytes:
    """L4: a metadata file for one payload: piece hashes, info dictionary, trackers once each."""
    pieces = b"".join(hashlib.sha1(content[i : i + piece_length]).digest() for i in range(0, len(content), piece_length))
    unique = list(dict.fromkeys(trackers))
    info = {"length": len(content), "name": name, "piece length": piece_length, "pieces": pieces}
    top: dict = {"announce": unique[0] if unique else "", "info": info}
    if len(unique) > 1:
        top["announce-list"] = [[t] for t in unique]
    return bencode(top)


def frames(data: bytes) -> tuple[list[tuple[int | None, bytes]], bytes]:
    """(message id, payload) of each whole length-prefixed frame, None for a keep-alive, and the bytes left."""
    out, at = [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            break
        body = data[at + 4 : at + 4 + size]
        out.append((body[0], body[1:]) if size else (None, b""))
        at += 4 + size
    return out, data[at:]


@F.udtf(returnType="place int, message int, payload binary")
class ReadFrames:
    """H42 as a table function: a row for each whole frame of a binary."""

    def eval(self, data):
        for i, (message, payload) in enumerate(frames(bytes(data or b""))[0]):
            yield i, message, payload


@F.udtf(returnType="place int, ends int")
class ReadValues:
    """H43 as a table function: where each bencoded value of a binary ends, up to the first malformed one."""

    def eval(self, data):
        at, i, data = 0, 0, bytes(data or b"")
        while at < len(data):
            try:
                _, at = bscan(data, at)
            except Malformed:
                return
            yield i, at
            i += 1


def artifact_magnet(a: Column) -> Column:
    """The link of a record that read_artifact gave."""
    from tidewater.functions.scalars import magnet_link

    return magnet_link(a["info_hash"], a["name"], a["trackers"])
