"""Bit kernels, without Spark: readers, writers, checksums, variable-length integers, code trees."""

from __future__ import annotations

import hashlib
import heapq
import hmac
from collections.abc import Sequence
from functools import lru_cache


class BitReader:
    """Reads first bit first; beyond the end come zeros and the position still moves on."""

    def __init__(self, data: bytes, pos: int = 0):
        self._value, self.size, self.pos = int.from_bytes(data, "big"), 8 * len(data), pos

    def read(self, n: int) -> int:
        end = self.pos + n
        out = self._value >> (self.size - end) if end <= self.size else self._value << (end - self.size)
        self.pos = end
        return out & ((1 << n) - 1)

    def flag(self) -> bool:
        return self.read(1) == 1

    def variable(self, n: int, groups: int = 64) -> int:
        """Groups of n bits, each with a flag for another one; a further group also counts the shorter forms."""
        value = 0
        for k in range(groups):
            value += self.read(n)
            if k == groups - 1 or not self.flag():
                break
            value = (value + 1) << n
        return value

    def count5(self) -> int:
        v = self.read(5)
        return v + self.read(7) if v == 31 else v


class BitWriter:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def write(self, value: int, n: int) -> BitWriter:
        self.value, self.size = self.value << n | value & ((1 << n) - 1), self.size + n
        return self

    def bits(self, data: bytes, n: int, start: int = 0) -> BitWriter:
        """Copy n bits of some bytes, from a bit on."""
        return self.write(BitReader(data, start).read(n), n)

    def variable(self, value: int, n: int) -> BitWriter:
        groups, first = 1, 1 << n
        base = 0
        while value - base >= first:
            base, groups, first = base + first, groups + 1, first << n
        if groups > 3:
            raise ValueError("more than three groups")
        rest = value - base
        for k in range(groups - 1, -1, -1):
            self.write(rest >> (n * k), n).write(int(k > 0), 1)
        return self

    def count5(self, value: int) -> BitWriter:
        return self.write(value, 5) if value < 31 else self.write(31, 5).write(value - 31, 7)

    def snapshot(self) -> tuple[bytes, int]:
        """The bytes so far, the last filled up with zeros, and how many bits they hold."""
        pad = -self.size % 8
        return (self.value << pad).to_bytes((self.size + pad) // 8, "big"), self.size

    def bytes(self) -> bytes:
        return self.snapshot()[0]


@lru_cache(maxsize=16)
def _crc_table(width: int, poly: int) -> tuple[int, ...]:
    mask, top = (1 << width) - 1, 1 << (width - 1)
    out = []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return tuple(out)


def crc(data: bytes, width: int, poly: int, nbits: int | None = None) -> int:
    """CRC with initial value 0, first bit first, no final xor; ``nbits`` for a length that ends within a byte."""
    nbits = 8 * len(data) if nbits is None else nbits
    table, mask, c = _crc_table(width, poly), (1 << width) - 1, 0
    for x in data[: nbits // 8]:
        c = (c << 8 & mask) ^ table[(c >> (width - 8) ^ x) & 255]
    for k in range(nbits % 8):
        bit = data[nbits // 8] >> (7 - k) & 1
        c = (c << 1 & mask) ^ (poly if (c >> (width - 1) ^ bit) & 1 else 0)
    return c


def crc16(data: bytes) -> int:
    return crc(data, 16, 0x8005)


def crc32_bits(data: bytes, nbits: int) -> int:
    return crc(data, 32, 0x04C11DB7, nbits)


def crc8_bits(data: bytes, nbits: int) -> int:
    return crc(data, 8, 0x2F, nbits)


def keyed_bits(key: bytes, key_id: int, covered: bytes, nbits: int, out_bits: int) -> int:
    """The top bits of HMAC-SHA256(key, key id and the covered bytes)."""
    return int.from_bytes(hmac.new(key, bytes([key_id]) + covered[: -(-nbits // 8)], hashlib.sha256).digest(), "big") >> (256 - out_bits)


def get_bits(data: bytes, pos: int, n: int) -> int:
    return BitReader(data, pos).read(n)


def set_bits(data: bytes, pos: int, value: int, n: int) -> bytes:
    shift = 8 * len(data) - pos - n
    mask = ((1 << n) - 1) << shift
    return (int.from_bytes(data, "big") & ~mask | value << shift & mask).to_bytes(len(data), "big")


def flip_bit(data: bytes, pos: int) -> bytes:
    return set_bits(data, pos, 1 - get_bits(data, pos, 1), 1)


def sync_bits(data: bytes, sync: int, width: int = 16, aligned: bool = False):
    """Bit places of a sync word of whole bytes, in order; the data are searched once for each of the eight shifts."""
    word, whole = sync.to_bytes(width // 8, "big"), int.from_bytes(data, "big")

    def places(shift: int):
        moved = (whole << shift & ((1 << 8 * len(data)) - 1)).to_bytes(len(data), "big") if shift else data
        at = moved.find(word)
        while at >= 0:
            if 8 * at + shift + width <= 8 * len(data):
                yield 8 * at + shift
            at = moved.find(word, at + 1)

    yield from heapq.merge(*map(places, range(1 if aligned else 8)))


def hex_bytes(text: str) -> bytes:
    """White space goes, anything else that is no digit or an odd count is an error."""
    return bytes.fromhex("".join(text.split()))


def key_bytes(text: str) -> bytes:
    """A key as hexadecimal digits, all else between them ignored; an empty or odd key is an error."""
    digits = "".join(c for c in text if c in "0123456789abcdefABCDEF")
    if not digits or len(digits) % 2:
        raise ValueError("a key has an even number of hexadecimal digits, two at least")
    return bytes.fromhex(digits)


Tree = Sequence[Sequence[int]]


def tree_decode(tree: Tree, r: BitReader) -> int:
    """One symbol of a code tree ``[[next on 0, next on 1], ...]``; a negative entry is a leaf, its complement the symbol."""
    node = 0
    for _ in range(64):
        if r.pos >= r.size:
            raise ValueError("code runs over the end")
        node = tree[node][r.read(1)]
        if node < 0:
            return ~node
        if node >= len(tree):
            raise ValueError("code leaves the tree")
    raise ValueError("code is too long")


def tree_codes(tree: Tree) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length)."""
    out, todo = {}, [(0, 0, 0)]
    while todo:
        node, code, size = todo.pop()
        for bit, nxt in enumerate(tree[node]):
            if nxt < 0:
                out[~nxt] = (code << 1 | bit, size + 1)
            else:
                todo.append((nxt, code << 1 | bit, size + 1))
    return out


def balanced_tree(symbols: int) -> list[list[int]]:
    """A tree for tests and for streams of our own: all symbols at about the same depth."""
    tree: list[list[int]] = []

    def grow(lo: int, hi: int) -> int:
        if hi - lo == 1:
            return ~lo
        me = len(tree)
        tree.append([0, 0])
        mid = (lo + hi + 1) // 2
        tree[me] = [grow(lo, mid), grow(mid, hi)]
        return me

    grow(0, max(2, symbols))
    return tree
