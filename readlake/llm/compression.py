"""Classification by compressed size: zstandard with raw-content dictionaries, one for each class."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

LEVEL, PIECE = 6, 1024


SLICE = 256


def spread(text: Column, most: int, size: int = 512) -> Column:
    """An array of pieces of that many characters from all over the text, at equal distances, at most `most` characters in all."""
    n = F.least(F.ceil(F.char_length(text) / size), F.lit(most // size)).cast("int")
    begin = lambda i: F.floor(i * (F.char_length(text) - size) / F.greatest(n - 1, F.lit(1))).cast("int") + 1
    return F.when(n <= 1, F.array(F.substring(text, 1, size))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, begin(i), F.lit(size))))


def filled(texts: list[str], most: int, size: int = SLICE) -> bytes:
    """At most that many bytes: slices of all texts, by their hash, so that no text and no part of one comes first."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    slices = {r[i : i + size] for r in raw for i in range(0, len(r), size)}
    return b"\n".join(sorted(slices, key=lambda x: (xxhash.xxh3_64_intdigest(x), x)))[:most]


class Compressors:
    """A compressor for each dictionary; made on the executor."""

    def __init__(self, dictionaries: list[bytes], level: int = LEVEL):
        self.ways = []
        for raw in dictionaries:
            if len(raw) >= 8:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                self.ways.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            else:
                self.ways.append(zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False))

    def sizes(self, texts: Iterable[bytes]) -> np.ndarray:
        """A row for each text, a column for each dictionary."""
        ways = [w.compress for w in self.ways]
        return np.array([[len(f(t)) for f in ways] for t in texts], np.float64).reshape(-1, len(ways))


def pieces(text: bytes, size: int) -> list[bytes]:
    """The whole text in pieces, so that the dictionary, not the text's own start, is what all of it is matched against."""
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def summed_sizes(ways: Compressors, texts: Iterable[bytes], size: int) -> np.ndarray:
    """Per text and dictionary, the compressed bytes of all pieces."""
    return np.array([ways.sizes(pieces(t, size)).sum(0) for t in texts], np.float64).reshape(-1, len(ways.ways))
