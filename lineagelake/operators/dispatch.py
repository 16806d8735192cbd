"""Facts of files by one table function, and only of files whose facts are not there yet.

The function is called laterally, once for each file, and tells by the path what to do: configuration gives its keys, a Dockerfile the images
it starts from, a WAV, FLAC or MP3 file its stream (channels, rate, milliseconds; an estimate after ``~``), anything else a file with its lines. What it finds has one form, ``kind, name, value``.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CONFIG_ENDINGS, CONTENT, PROSE_ENDINGS
from .extract import file_keys

FACTS = "kind string, name string, value string"
_FROM = re.compile(r"(?i)^\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?")


def _base(path: str) -> str:
    return path.rpartition("/")[2].lower()


def is_config(path: str) -> bool:
    """:func:`..functions.text.config_path` for one path."""
    name = _base(path)
    dot = name.rfind(".")
    inside = path == ".github" or path.startswith(".github/")
    return not inside and ((dot > 0 and name[dot + 1 :] in CONFIG_ENDINGS) or name == ".env" or name.startswith(".env."))


def is_dockerfile(path: str) -> bool:
    name = _base(path)
    return name in ("dockerfile", "containerfile") or name.startswith("dockerfile.") or name.endswith(".dockerfile")


def _images(text: str):
    stages: set[str] = set()
    for line in text.splitlines():
        if m := _FROM.match(line):
            if m[1].lower() not in stages and m[1].lower() != "scratch":
                yield "image_ref", m[1], None
            if m[2]:
                stages.add(m[2].lower())


def _wave(data: bytes):
    at, form, size = 12, None, None
    while at + 8 <= len(data) and data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt " and at + 24 <= len(data):
            form = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
        if name == b"data":
            size = n
        at += 8 + n + n % 2
    if form and size is not None and form[4] and form[2]:
        yield "audio_stream", f"{form[1]}x{form[2]}", str(size // form[4] * 1000 // form[2])


def _flac(data: bytes):
    """The stream of a FLAC file as its first block states it."""
    if len(data) >= 26 and data[:4] == b"fLaC" and data[4] & 0x7F == 0:
        packed = int.from_bytes(data[18:26], "big")
        rate, channels, frames = packed >> 44, (packed >> 41 & 7) + 1, packed & (1 << 36) - 1
        if rate:
            yield "audio_stream", f"{channels}x{rate}", str(frames * 1000 // rate) if frames else None


def _mpeg(data: bytes):
    """The stream of an MPEG layer 3 file; its length is an estimate and only told where the file counts its frames."""
    at = 10 + sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(data[6:10])) if data[:3] == b"ID3" and len(data) > 10 else 0
    while at + 4 <= len(data) and not (data[at] == 0xFF and data[at + 1] & 0xE6 == 0xE2 and data[at + 2] >> 2 & 3 < 3):
        at += 1
    if at + 4 > len(data):
        return
    version = data[at + 1] >> 3 & 3  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    if version == 1:
        return
    rate = (44_100, 48_000, 32_000)[data[at + 2] >> 2 & 3] >> {3: 0, 2: 1, 0: 2}[version]
    mono = data[at + 3] >> 6 == 3
    side = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}[version == 3, mono]
    tag = at + 4 + side
    counted = data[tag : tag + 4] in (b"Xing", b"Info") and data[tag + 7] & 1 if len(data) >= tag + 12 else False
    frames = int.from_bytes(data[tag + 8 : tag + 12], "big") * (1152 if version == 3 else 576) if counted else 0
    yield "audio_stream", f"{2 - mono}x{rate}", f"~{frames * 1000 // rate}" if frames else None


#: What reads the head of an audio file, by its ending.
AUDIO = {"wav": _wave, "flac": _flac, "mp3": _mpeg}


class Facts:
    """``eval(path, content)``: rows of :data:`FACTS` of one file, whose bytes are ``content``."""

    def eval(self, path: str, content: bytes):
        data = bytes(content or b"")
        yield "file", _base(path), str(data.count(b"\n"))
        if (read := AUDIO.get(_base(path).rpartition(".")[2])) is not None:
            yield from read(data)
            return
        text = data.decode("utf-8", "replace")
        if is_config(path):
            try:
                for key, value in file_keys(path, text).items():
                    yield "config_key", key, value
            except (ValueError, RecursionError) as e:
                yield "unread", type(e).__name__, str(e)
        elif is_dockerfile(path):
            yield from _images(text)
        elif _base(path).rpartition(".")[2] in PROSE_ENDINGS:
            yield "content", _base(path), " ".join(text.split())[:CONTENT].strip()


def register(spark: SparkSession, name: str = "file_facts") -> str:
    """Registers the table function for SQL: ``select f.* from files, lateral file_facts(path, content) f``."""
    spark.udtf.register(name, F.udtf(Facts, returnType=FACTS))
    return name


def extracted(blobs: DataFrame) -> DataFrame:
    """``path, cache_key, kind, name, value`` of blobs (path, cache_key, content), by a lateral call for each."""
    facts = F.udtf(Facts, returnType=FACTS)
    rows = blobs.select("path", "cache_key", F.col("content").cast("binary").alias("content"))
    return rows.lateralJoin(facts(F.col("path").outer(), F.col("content").outer())).select("path", "cache_key", "kind", "name", "value")


def facts_of(blobs: DataFrame, cached: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """All facts of ``blobs``, and those of the misses, which are to be added to the cache.

    ``cached`` has the rows of earlier calls. A blob is extracted only if its ``cache_key`` has none there; a key says path, content and version, so
    blobs of one key are extracted once.
    """
    missing = blobs if cached is None else blobs.join(cached.select("cache_key").distinct(), "cache_key", "left_anti")
    fresh = extracted(missing.dropDuplicates(["cache_key"]))
    if cached is None:
        return fresh, fresh
    return cached.join(blobs.select("cache_key").distinct(), "cache_key", "left_semi").select(*fresh.columns).unionByName(fresh), fresh


def key_of(path: Column, content: Column, version: int = 1) -> Column:
    """Cache key of a blob at a path."""
    return F.concat(F.sha2(content.cast("binary"), 256), F.lit("-"), F.sha2(path, 256), F.lit(f"-v{version}"))
