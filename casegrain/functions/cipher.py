"""Keys, keystreams, containers and hidden payloads.

Key derivation and raster work run in numpy and hashlib, in batches; AES is Spark's own. The magic bytes of containers and
payloads are parameters, so that other tools' files can be read.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTAINER_MAGIC, HIDDEN_MAGIC = b"CGRAINC\x01\x00", b"CGRAINH\x01\x00"
SALT, IV, TAG = 16, 12, 16
CONTAINER_ROUNDS, HIDDEN_ROUNDS = 100_000, 50_000
ENCRYPTED = 1
#: Mean gradient below which a decrypted patch looks natural; candidates that are tried at most.
NATURAL, MOST_CANDIDATES, PATCH_BYTES = 35.0, 100_000, 30_000
# Start, multipliers and final shifts of the 128-bit string hash; multiplier step of the keystream.
_START = (1779033703, 3144134277, 1013904242, 27644437)
_MULTIPLIERS = (597399067, 2869860233, 951274213, 2716044179)
_SHIFTS = (18, 22, 17, 19)
_STEP = 0x6D2B79F5
_MASK = 0xFFFFFFFF


def string_hash(text: str) -> list[int]:
    """Four 32-bit words: the public-domain cyrb128, by UTF-16 units as browsers count them."""
    h = list(_START)
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist()
    for u in units:
        for k in range(4):
            # Each word takes the next one's value; the last takes the new first's.
            h[k] = h[(k + 1) % 4] ^ ((h[k] ^ u) * _MULTIPLIERS[k] & _MASK)
    mixed = list(h)
    for k in range(4):
        mixed[k] = (mixed[(k + 2) % 4] ^ h[k] >> _SHIFTS[k]) * _MULTIPLIERS[k] & _MASK
    first = mixed[0] ^ mixed[1] ^ mixed[2] ^ mixed[3]
    return [first, mixed[1] ^ mixed[0], mixed[2] ^ mixed[0], mixed[3] ^ mixed[0]]


def keystream(seed: int, n: int) -> np.ndarray:
    """``n`` bytes floor(255 * u) of the public-domain Mulberry32 generator."""
    state = (np.uint64(seed) + np.uint64(_STEP) * np.arange(1, n + 1, dtype=np.uint64)) & np.uint64(_MASK)
    t = state ^ state >> np.uint64(15)
    t = t * (state | np.uint64(1)) & np.uint64(_MASK)
    u = (t ^ t >> np.uint64(7)) * (t | np.uint64(61)) & np.uint64(_MASK)
    t ^= (t + u) & np.uint64(_MASK)
    t ^= t >> np.uint64(14)
    return (255.0 * (t.astype(np.float64) / 2.0**32)).astype(np.uint8)


def seed_of(key: str) -> int:
    """A key's seed; ``seed:`` keys name it."""
    return int(key[5:], 0) & _MASK if key.startswith("seed:") else string_hash(key)[0]


def streamed(rgb: np.ndarray, key: str) -> np.ndarray:
    """A raster XORed with a key's stream, which is its own inverse; a fourth channel stays."""
    out = rgb.copy()
    own = rgb[:, :, :3]
    out[:, :, :3] = own ^ keystream(seed_of(key), own.size).reshape(own.shape)
    return out


def cat_map(rgb: np.ndarray, rounds: int, inverse: bool = False, p: int = 1, q: int = 1, size: tuple[int, int] | None = None) -> np.ndarray:
    """Arnold's cat map on a raster padded to a square; ``size`` (height, width) cuts the inverse back."""
    if not 0 <= rounds <= 1000:
        raise ValueError("rounds must be 0 to 1000")
    n = max(rgb.shape[:2])
    out = np.zeros((n, n, rgb.shape[2]), rgb.dtype)
    out[: rgb.shape[0], : rgb.shape[1]] = rgb
    y, x = np.indices((n, n))
    to = (((p * q + 1) * x - p * y) % n, (y - q * x) % n) if inverse else ((x + p * y) % n, (q * x + (p * q + 1) * y) % n)
    for _ in range(rounds):
        out = out[to[1], to[0]]
    return out[: size[0], : size[1]] if size else out


def derived_key(password: str, salt: bytes, rounds: int = CONTAINER_ROUNDS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def key_column(password: str, salt: Column, rounds: int = CONTAINER_ROUNDS) -> Column:
    @F.pandas_udf("binary")
    def derive(salts: pd.Series) -> pd.Series:
        return salts.map(lambda s: derived_key(password, bytes(s), rounds) if s is not None else None)

    return derive(salt)


def sealed(content: Column, key: Column, salt: Column, iv: Column, magic: bytes = CONTAINER_MAGIC) -> Column:
    """magic | salt | iv | ciphertext and tag (AES-256-GCM)."""
    return F.concat(F.lit(magic), salt, F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), iv))


def is_sealed(content: Column, magic: bytes = CONTAINER_MAGIC) -> Column:
    return (F.substring(content, 1, len(magic)) == F.lit(magic)) & (F.length(content) >= len(magic) + SALT + IV + TAG)


def opened(content: Column, password: str, magic: bytes = CONTAINER_MAGIC, rounds: int = CONTAINER_ROUNDS) -> Column:
    """The content of a container; null if it is none or the password is wrong."""
    salt = F.substring(content, len(magic) + 1, SALT)
    body = F.substring(content, len(magic) + SALT + 1, 1 << 30)
    return F.when(is_sealed(content, magic), F.try_aes_decrypt(body, key_column(password, salt, rounds), F.lit("GCM")))


def hide(rgb: np.ndarray, body: bytes, flags: int = 0, length: int | None = None, magic: bytes = HIDDEN_MAGIC) -> np.ndarray:
    """A raster with magic | flags | length | body in its last bits."""
    packet = magic + bytes([flags]) + struct.pack(">I", len(body) if length is None else length) + body
    bits = np.unpackbits(np.frombuffer(packet, np.uint8))
    flat = rgb[:, :, :3].reshape(-1).copy()
    if len(bits) > len(flat):
        raise ValueError(f"{len(packet)} bytes do not fit into {len(flat) // 8}")
    flat[: len(bits)] = flat[: len(bits)] & 0xFE | bits
    return flat.reshape(rgb[:, :, :3].shape)


def found_hidden(rgb: np.ndarray, magic: bytes = HIDDEN_MAGIC) -> tuple[int, bytes] | None:
    """(flags, body) of what the last bits hide. An encrypted body has salt and iv before it and a tag after it."""
    raw = np.packbits(rgb[:, :, :3].reshape(-1)[: rgb[:, :, :3].size // 8 * 8] & 1).tobytes()
    if not raw.startswith(magic) or len(raw) < len(magic) + 5:
        return None
    flags, size = raw[len(magic)], struct.unpack(">I", raw[len(magic) + 1 : len(magic) + 5])[0]
    size += SALT + IV + TAG if flags & ENCRYPTED else 0
    body = raw[len(magic) + 5 : len(magic) + 5 + size]
    return (flags, body) if len(body) == size else None


def appended(content: Column, payload: Column) -> Column:
    return F.concat(content, payload)


def after_last_end(content: bytes) -> tuple[int, bytes] | None:
    """What follows the last end marker of a JPEG or PNG."""
    for lead, mark, more in ((b"\xff\xd8", b"\xff\xd9", 2), (b"\x89PNG", b"IEND", 8)):
        at = content.rfind(mark) + more if content.startswith(lead) and mark in content else len(content)
        if at < len(content):
            return at, content[at:]
    return None


def candidates(sources: list[DataFrame]) -> DataFrame:
    """(candidate, ordinal): words of tables (candidate, place) in order of the tables, each word once, where it comes first."""
    rows = None
    for n, source in enumerate(sources):
        own = source.select("candidate", F.struct(F.lit(n).alias("n"), F.col("place").cast("long").alias("place")).alias("at"))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.where("candidate <> ''").groupBy("candidate").agg(F.min("at").alias("at")).orderBy("at").limit(MOST_CANDIDATES)
    return first.select("candidate", (F.row_number().over(Window.orderBy("at")) - 1).alias("ordinal"))


# Words that are tried before a list of one's own.
COMMON = "password 123456 12345678 1234 12345 qwerty admin secret test pass key abc123 root master default welcome login image photo picture private hidden camera phone".split()


def usual_sources(spark, name: str, extra: list[str] | None = None, wordlist: DataFrame | None = None) -> list[DataFrame]:
    """Tables for ``candidates``: forms of a file's name, extras, common words, a list's lines (value), 0000 to 0999."""
    stem = name.rpartition("/")[2].rpartition(".")[0]
    table = lambda words: spark.createDataFrame(list(zip(words, range(len(words)), strict=True)), "candidate string, place int")
    out = [table([stem.replace("encrypted-", "").replace("scrambled-", ""), name.rpartition("/")[2], stem]), table(extra or []), table(COMMON)]
    if wordlist is not None:
        out.append(wordlist.select(F.trim("value").alias("candidate"), F.monotonically_increasing_id().alias("place")))
    return [*out, spark.range(1000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("candidate"), F.col("id").alias("place"))]


def gradient(patch: np.ndarray, key: str) -> float:
    """Mean difference of neighbours in a patch decrypted with a key: low for pictures, near 85 for noise."""
    own = streamed(patch, key)[:, :, :3].astype(int)
    across = np.abs(np.diff(own, axis=1)).mean()
    return float((across + np.abs(np.diff(own, axis=0)).mean()) / 2) if len(own) > 1 else float(across)


def recovered(words: DataFrame, rgb: np.ndarray) -> DataFrame:
    """(candidate, ordinal, score): the first candidate under which the raster's top rows look natural."""
    rows = max(2, min(len(rgb), PATCH_BYTES // (rgb.shape[1] * 3)))
    patch = np.ascontiguousarray(rgb[:rows, :, :3])

    @F.pandas_udf("double")
    def score(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: gradient(patch, k))

    return words.withColumn("score", score("candidate")).where(F.col("score") < NATURAL).orderBy("ordinal").limit(1)
