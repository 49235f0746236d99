"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

U = np.uint64
#: Bytes hashed in one go; longer texts are hashed piece by piece.
PIECE = 1 << 20


def _stream(seed: int, n: int) -> list[int]:
    """n odd 64-bit constants of a seeded counter generator."""
    return [xxhash.xxh3_64_intdigest(f"{seed}:{i}".encode()) | 1 for i in range(n)]


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.array(_stream(1, 256), U)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1]
BASE, MIX1, MIX2, LENGTH = _stream(2, 4)
PLACE = np.array(_stream(3, 16), U)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 4096)
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, U)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(MIX1)
    x = (x ^ (x >> U(29))) * U(MIX2)
    return x ^ (x >> U(32))


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every maximal run of non-space bytes, A-Z taken as a-z."""
    b = np.frombuffer(buffer, np.uint8)
    edge = np.diff(SPACES[b].astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, U), starts
    up, down = powers(len(b))
    sums = np.empty(len(b) + 1, U)
    sums[0] = 0
    np.cumsum(LETTER[b] * up[: len(b)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(LENGTH)), starts


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of at most PIECE bytes, cut at spaces (a longer word stays whole)."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:
                cut = min((i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := text.find(c, end)) >= 0), default=len(text))
            end = cut
        yield text[at:end]
        at = end


def texts_words(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Groups of texts: their indexes, all their word hashes and the bounds of each text's words."""
    group: list[int] = []
    size = 0

    def small() -> tuple[list[int], np.ndarray, np.ndarray]:
        hashes, starts = word_hashes(b"\n".join(texts[i] for i in group))
        begin = np.cumsum([0] + [len(texts[i]) + 1 for i in group])
        return list(group), hashes, np.searchsorted(starts, begin)

    for i, t in enumerate(texts):
        if len(t) > PIECE:
            h = np.concatenate([word_hashes(p)[0] for p in pieces(t)])
            yield [i], h, np.array([0, len(h)])
            continue
        if group and size + len(t) > PIECE:
            yield small()
            group, size = [], 0
        group.append(i)
        size += len(t) + 1
    if group:
        yield small()


def shingle_sets(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct hashes of the text's shingles) of every text.

    A text of fewer than `width` words has one shingle, the whole sequence; one without words none.
    """
    for group, words, bounds in texts_words(texts):
        full = np.zeros(max(0, len(words) - width + 1), U)
        for k in range(width):
            full += words[k : len(words) - width + 1 + k] * PLACE[k]
        full = mixed(full)
        for i, a, b in zip(group, bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield i, np.unique(full[a : b - width + 1])
            elif b > a:
                yield i, mixed((words[a:b] * PLACE[: b - a]).sum(keepdims=True) + np.array([b - a], U) * U(LENGTH))
            else:
                yield i, np.empty(0, U)


def set_digest(hashes: np.ndarray) -> int:
    """Signed 64-bit digest of a sorted set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))
