"""Extension functions: UUIDs, regular expressions, fuzzy matching, digests and IP addresses."""

from __future__ import annotations

import base64
import ipaddress
import os
import time

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf


def _map(kind: str, f, *columns: Column) -> Column:
    """A function of one row's values over Arrow batches; a null argument gives null."""

    @pandas_udf(kind)
    def run(*xs: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*xs)], dtype=object)

    return run(*columns)


def uuid7(seconds: Column) -> Column:
    """A version 7 UUID of a time."""

    def f(s) -> str:
        ms = int(s * 1000) if s else int(time.time() * 1000)
        x = bytearray(ms.to_bytes(6, "big") + os.urandom(10))
        x[6], x[8] = x[6] & 15 | 112, x[8] & 63 | 128
        h = x.hex()
        return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"

    return _map("string", f, seconds)


def uuid7_timestamp_ms(u: Column) -> Column:
    return F.conv(F.substring(F.replace(u, F.lit("-")), 1, 12), 16, 10).cast("long")


def uuid_blob(u: Column) -> Column:
    return F.unhex(F.replace(u, F.lit("-")))


def uuid_str(b: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(b)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def osa(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, last = last, now
    return last[-1]


def damerau(a: str, b: str) -> int:
    """Damerau-Levenshtein: swaps may have edits between."""
    seen: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            if x == y:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return d[-1][-1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(mine, theirs)) // 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def fuzzy_damlev(a: Column, b: Column) -> Column:
    return _map("long", damerau, a, b)


def fuzzy_osadist(a: Column, b: Column) -> Column:
    return _map("long", osa, a, b)


def fuzzy_jarowin(a: Column, b: Column) -> Column:
    return _map("double", jaro_winkler, a, b)


def fuzzy_leven(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def fuzzy_hamming(a: Column, b: Column) -> Column:
    """Places that differ; -1 where the lengths do."""
    apart = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) != F.length(b), -1).otherwise(F.aggregate(apart, F.lit(0), lambda s, x: s + x))


def crypto(x: Column, kind: str) -> Column:
    """A digest as a blob: md5, sha1, sha256, sha384 or sha512."""
    return F.unhex({"md5": F.md5, "sha1": F.sha1}[kind](x) if kind in ("md5", "sha1") else F.sha2(x, int(kind[3:])))


def encode(x: Column, how: str) -> Column:
    """base32, base64, base85, hex or url."""
    if how in ("base32", "base85"):
        f = base64.b32encode if how == "base32" else base64.b85encode
        return _map("string", lambda v: f(v.encode() if isinstance(v, str) else bytes(v)).decode(), x)
    return {"base64": lambda v: F.base64(v.cast("binary")), "hex": lambda v: F.lower(F.hex(v)), "url": F.url_encode}[how](x)


def decode(x: Column, how: str) -> Column:
    if how in ("base32", "base85"):
        f = base64.b32decode if how == "base32" else base64.b85decode
        return _map("binary", lambda v: f(v), x)
    return {"base64": F.unbase64, "hex": F.unhex, "url": lambda v: F.url_decode(v).cast("binary")}[how](x)


def ip_number(x: Column) -> Column:
    """A dotted quad as an integer."""
    parts = F.split(F.split_part(x, F.lit("/"), F.lit(1)), r"\.")
    return sum((F.get(parts, F.lit(k)).cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0).cast("long"))


def ip_contains(net: Column, ip: Column) -> Column:
    """Whether an IPv4 network in CIDR form holds an address."""
    shift = (32 - F.split_part(net, F.lit("/"), F.lit(2)).cast("int")).cast("int")
    return F.call_function("shiftright", ip_number(net), shift) == F.call_function("shiftright", ip_number(ip), shift)


def ip_family(ip: Column) -> Column:
    return F.when(F.instr(ip, ":") > 0, 6).otherwise(4)


def ip_host(cidr: Column) -> Column:
    return F.split_part(cidr, F.lit("/"), F.lit(1))


def ip_masklen(cidr: Column) -> Column:
    return F.split_part(cidr, F.lit("/"), F.lit(2)).cast("int")


def ip_network(cidr: Column) -> Column:
    """The network of an address in CIDR form, IPv6 too."""
    return _map("string", lambda c: str(ipaddress.ip_network(c, strict=False)), cidr)


#: Fixed values of BLAKE3: its initial state, the order of words from round to round, and the flags.
_B3_START = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_B3_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_B3_FIRST, _B3_LAST, _B3_PARENT, _B3_ROOT = 1, 2, 4, 8
_M32 = 0xFFFFFFFF


def _b3_compress(chain, block: bytes, counter: int, flags: int) -> list[int]:
    words = [int.from_bytes(block[k : k + 4].ljust(4, b"\0"), "little") for k in range(0, 64, 4)]
    v = [*chain, *_B3_START[:4], counter & _M32, counter >> 32, len(block), flags]

    def quarter(a, b, c, d, x, y):
        for word, r, s in ((x, 16, 12), (y, 8, 7)):
            v[a] = (v[a] + v[b] + word) & _M32
            v[d] = ((v[d] ^ v[a]) >> r | (v[d] ^ v[a]) << (32 - r)) & _M32
            v[c] = (v[c] + v[d]) & _M32
            v[b] = ((v[b] ^ v[c]) >> s | (v[b] ^ v[c]) << (32 - s)) & _M32

    for _ in range(7):
        for k in range(4):
            quarter(k, 4 + k, 8 + k, 12 + k, words[2 * k], words[2 * k + 1])
        for k in range(4):
            quarter(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, words[8 + 2 * k], words[9 + 2 * k])
        words = [words[k] for k in _B3_ORDER]
    return [v[k] ^ v[8 + k] for k in range(8)]


def blake3_digest(data: bytes) -> bytes:
    """32 bytes: chunks of 1 KB are chained by blocks, and their values meet in a left-heavy binary tree."""

    def chunk(part: bytes, number: int, root: int) -> list[int]:
        chain, blocks = list(_B3_START), [part[k : k + 64] for k in range(0, len(part), 64)] or [b""]
        for k, block in enumerate(blocks):
            flags = (_B3_FIRST if k == 0 else 0) | (_B3_LAST | root if k == len(blocks) - 1 else 0)
            chain = _b3_compress(chain, block, number, flags)
        return chain

    def tree(first: int, n: int, root: int) -> list[int]:
        if n == 1:
            return chunk(data[first * 1024 : (first + 1) * 1024], first, root)
        left = 1 << (n - 1).bit_length() - 1
        both = b"".join(x.to_bytes(4, "little") for x in (*tree(first, left, 0), *tree(first + left, n - left, 0)))
        return _b3_compress(list(_B3_START), both, 0, _B3_PARENT | root)

    return b"".join(x.to_bytes(4, "little") for x in tree(0, max(1, -(-len(data) // 1024)), _B3_ROOT))


def blake3(x: Column) -> Column:
    """The digest of a text's or a blob's bytes, over Arrow batches."""
    return _map("binary", lambda v: blake3_digest(v.encode() if isinstance(v, str) else bytes(v)), x)
