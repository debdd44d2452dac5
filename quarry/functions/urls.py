"""URL identity: canonical form, domain and bookmark id."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .url_parser import parse


#: Addresses that are canonical up to their fragment and an empty path: a plain name, no port, no dot segment, nothing to encode.
_PLAIN = r"^https?://(?:[a-z0-9_-]+\.)*[a-z](?:[a-z0-9-]*[a-z0-9])?(?:/[A-Za-z0-9\-._~!$&'()*+,;=:@%/|]*)?(?:\?[A-Za-z0-9\-._~!$&()*+,;=:@%/?|]*)?(?:#.*)?$"
_NOT_PLAIN = r"(?i)xn--|/(?:\.|%2e){1,2}(?:[/?#]|$)"
_AUTHORITY = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?"


def _canonical_each(urls: pa.Array) -> pa.Array:
    return pa.array([None if u is None or (found := parse(u)) is None else str(found) for u in urls.to_pylist()], pa.string())


def canonical_url(url: Column | str) -> Column:
    """The one form of an absolute address: scheme and host lower-case, names in ASCII, numbers of an address in four parts, dot segments resolved, no default port, no fragment, `/` for an empty path; null without a host.

    The query, other ports, user names and passwords stay.  An expression does
    this for plain addresses, the parser for all others.
    """
    url = F.col(url) if isinstance(url, str) else url
    plain = url.rlike(_PLAIN) & ~url.rlike(_NOT_PLAIN)
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    settled = F.regexp_replace(bare, r"^(https?://[^/?]+)(?=\?|$)", "$1/")
    parsed = F.arrow_udf(_canonical_each, "string")(F.when(~plain, url))
    return F.when(plain, settled).otherwise(parsed)


def domain(url: Column | str) -> Column:
    """Host of the canonical form, without port; null where there is none."""
    found = F.regexp_extract(canonical_url(url), _AUTHORITY + r"(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(found != "", found)


#: Fixed values of the public MurmurHash3 x64 128-bit function.
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_ADD1, _ADD2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
_MIX = ((33, np.uint64(0xFF51AFD7ED558CCD)), (33, np.uint64(0xC4CEB9FE1A85EC53)))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _avalanche(k: np.ndarray) -> np.ndarray:
    for shift, factor in _MIX:
        k = (k ^ (k >> np.uint64(shift))) * factor
    return k ^ (k >> np.uint64(33))


def _hashed(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the hash, seed 0, of byte strings of similar length, all of them a block of 16 bytes at a time."""
    length = np.array([len(x) for x in data], np.uint64)
    width = int(length.max()) // 16 + 1
    words = np.frombuffer(b"".join(x.ljust(16 * width, b"\0") for x in data), "<u8").reshape(len(data), 2 * width)
    h1, h2 = np.zeros(len(data), np.uint64), np.zeros(len(data), np.uint64)
    full = (length // np.uint64(16)).astype(np.int64)
    for i in range(width):
        k1 = _rotl(words[:, 2 * i] * _C1, 31) * _C2
        k2 = _rotl(words[:, 2 * i + 1] * _C2, 33) * _C1
        a = (_rotl(h1 ^ k1, 27) + h2) * np.uint64(5) + _ADD1
        b = (_rotl(h2 ^ k2, 31) + a) * np.uint64(5) + _ADD2
        # What is left after the full blocks is only mixed in.
        h1, h2 = np.where(i < full, a, np.where(i == full, h1 ^ k1, h1)), np.where(i < full, b, np.where(i == full, h2 ^ k2, h2))
    h1, h2 = h1 ^ length, h2 ^ length
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _avalanche(h1), _avalanche(h2)
    h1 = h1 + h2
    return h1, h2 + h1


def murmur3_128(data: bytes) -> bytes:
    """16 big-endian bytes of h2 << 64 | h1."""
    h1, h2 = _hashed([data])
    return h2.astype(">u8").tobytes() + h1.astype(">u8").tobytes()


def _short_ids(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in urls:
        out = pd.Series([None] * len(batch), dtype=object)
        data = {i: u.encode() for i, u in enumerate(batch) if isinstance(u, str)}
        # Strings of one class of length, so that padding at most doubles them.
        classes: dict[int, list[int]] = {}
        for i, x in data.items():
            classes.setdefault((len(x) >> 4).bit_length(), []).append(i)
        for rows in classes.values():
            h1, h2 = _hashed([data[i] for i in rows])
            joined = np.stack([h2, h1], axis=1).astype(">u8").tobytes()
            for n, i in enumerate(rows):
                out[i] = base64.urlsafe_b64encode(joined[16 * n : 16 * n + 16]).decode().rstrip("=")
        yield out


def bookmark_id(url: Column | str) -> Column:
    """Short id of a canonical URL: unpadded URL-safe base64 of its 128-bit hash."""
    return F.pandas_udf(_short_ids, "string")(url if isinstance(url, Column) else F.col(url))
