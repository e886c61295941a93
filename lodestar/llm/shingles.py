"""Word shingles of whole texts as sorted arrays of 64-bit hashes, in numpy."""

from __future__ import annotations

from functools import lru_cache

WORDS = 5
#: Texts are hashed together up to about so many bytes.
TOGETHER = 1_000_000


@lru_cache(1)
def _tables(longest: int):
    import numpy as np

    rng = np.random.default_rng(20)
    bytes_to = rng.integers(1, 2**64, 256, dtype="u8", endpoint=False)
    power = np.full(longest, 0x9E3779B97F4A7C15, "u8")
    power[0] = 1
    return bytes_to, np.multiply.accumulate(power)


def mixed(x):
    """A bijection that spreads every bit over all others."""
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: bytes):
    """Hash and first byte's place of each word of raw: longest runs without ASCII white space, A-Z lower-cased."""
    import numpy as np

    buf = np.frombuffer(raw.lower(), "u1")
    solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.diff(solid.view("i1"), prepend=np.int8(0), append=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, "u8"), starts
    lengths = stops - starts
    longest = int(lengths.max())
    to, power = _tables(1 << max(10, (longest - 1).bit_length()))
    inside = np.flatnonzero(solid)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    sums = np.add.reduceat(to[buf[inside]] * power[place], first)
    return mixed(sums + lengths.astype("u8") * np.uint64(0xD6E8FEB86659FD93)), starts


def shingle_sets(texts: list[str]):
    """The set of each text as a sorted array; fewer than five words are one shingle, no words are an empty set."""
    import numpy as np

    at = 0
    while at < len(texts):
        size, stop = 0, at
        raws = []
        while stop < len(texts) and (size < TOGETHER or not raws):
            raws.append(texts[stop].encode("utf-8", "surrogatepass"))
            size += len(raws[-1]) + 1
            stop += 1
        words, starts = word_hashes(b"\n".join(raws))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
        rolled = np.zeros(max(0, len(words) - WORDS + 1), "u8")
        for i in range(WORDS):
            rolled = mixed(rolled * np.uint64(0x2545F4914F6CDD1D) + words[i : len(rolled) + i])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= WORDS:
                yield np.unique(rolled[a : b - WORDS + 1])
            elif b > a:
                one = np.zeros(1, "u8")
                for w in words[a:b]:
                    one = mixed(one * np.uint64(0x2545F4914F6CDD1D) + w)
                yield mixed(one + np.uint64(b - a))
            else:
                yield np.empty(0, "u8")
        at = stop


def set_digest(own) -> bytes:
    """16 bytes that name a set."""
    import hashlib

    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()
