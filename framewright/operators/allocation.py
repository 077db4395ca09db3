"""Exponents, bit allocation and mantissa counts of the public audio-coding standard (ETSI TS 102 366)."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cache
from itertools import accumulate

#: Exponent strategies: bins that share an exponent; 0 keeps the exponents of the block before.
REUSE, D15, D25, D45 = 0, 1, 2, 3
STEP = {D15: 1, D25: 2, D45: 4}

# They must equal the standard's for right results.
BAND_WIDTHS = ((1, 28), (3, 7), (6, 6), (12, 4), (24, 5))  # (bins, bands)
HEARING = (
    (
        0x04D0, 0x04D0, 0x0440, 0x0400, 0x03E0, 0x03C0, 0x03B0, 0x03B0, 0x03A0, 0x03A0,
        0x03A0, 0x03A0, 0x03A0, 0x0390, 0x0390, 0x0390, 0x0380, 0x0380, 0x0370, 0x0370,
        0x0360, 0x0360, 0x0350, 0x0350, 0x0340, 0x0340, 0x0330, 0x0320, 0x0310, 0x0300,
        0x02F0, 0x02F0, 0x02F0, 0x02F0, 0x0300, 0x0310, 0x0340, 0x0390, 0x03E0, 0x0420,
        0x0460, 0x0490, 0x04A0, 0x0460, 0x0440, 0x0440, 0x0520, 0x0800, 0x0840, 0x0840,
    ),
    (
        0x04F0, 0x04F0, 0x0460, 0x0410, 0x03E0, 0x03D0, 0x03C0, 0x03B0, 0x03B0, 0x03A0,
        0x03A0, 0x03A0, 0x03A0, 0x03A0, 0x0390, 0x0390, 0x0390, 0x0380, 0x0380, 0x0380,
        0x0370, 0x0370, 0x0360, 0x0360, 0x0350, 0x0350, 0x0340, 0x0340, 0x0320, 0x0310,
        0x0300, 0x02F0, 0x02F0, 0x02F0, 0x02F0, 0x0300, 0x0320, 0x0350, 0x0390, 0x03E0,
        0x0420, 0x0450, 0x04A0, 0x0490, 0x0460, 0x0440, 0x0480, 0x0630, 0x0840, 0x0840,
    ),
    (
        0x0580, 0x0580, 0x04B0, 0x0450, 0x0420, 0x03F0, 0x03E0, 0x03D0, 0x03C0, 0x03B0,
        0x03B0, 0x03B0, 0x03A0, 0x03A0, 0x03A0, 0x03A0, 0x03A0, 0x03A0, 0x03A0, 0x03A0,
        0x0390, 0x0390, 0x0390, 0x0390, 0x0380, 0x0380, 0x0380, 0x0370, 0x0360, 0x0350,
        0x0340, 0x0330, 0x0320, 0x0310, 0x0300, 0x02F0, 0x02F0, 0x02F0, 0x0300, 0x0310,
        0x0330, 0x0350, 0x03C0, 0x0410, 0x0470, 0x04A0, 0x0460, 0x0440, 0x0450, 0x04E0,
    ),
)
POINTERS = (
    0, 1, 1, 1, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 6, 6, 6, 7, 7, 7, 7, 8, 8, 8, 8, 9, 9, 9, 9, 10,
    10, 10, 10, 11, 11, 11, 11, 12, 12, 12, 12, 13, 13, 13, 13, 14, 14, 14, 14, 14, 14, 14, 14, 15, 15, 15, 15, 15, 15, 15, 15, 15,
)
MANTISSA_BITS = (0, 5, 7, 3, 7, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16)


@dataclass(frozen=True)
class Tables:
    """Tables and gains of the allocation; ``standard_tables()`` unless a stream is of another kind."""

    log_add: tuple[int, ...]
    band_of_bin: tuple[int, ...]
    hearing: tuple[tuple[int, ...], ...]
    pointer: tuple[int, ...] = POINTERS
    mantissa_bits: tuple[int, ...] = MANTISSA_BITS
    # The standard's defaults where a frame sends no parameters.
    fast_decay: int = 0x53
    slow_decay: int = 0x13
    fast_gain: int = 0x280
    slow_gain: int = 0x4D8
    knee: int = 0x900
    floor: int = -2048

    def but(self, **changes) -> Tables:
        return replace(self, **changes)


@cache
def standard_tables() -> Tables:
    """Bands from their widths; log addition from 10 log10(1 + 10^(-d/10)) in units of 6 dB / 128, rounded down."""
    widths = [w for w, n in BAND_WIDTHS for _ in range(n)]
    band_of_bin = tuple(b for b, w in enumerate(widths) for _ in range(w))
    log_add = tuple(int(1280 / 6 * math.log10(1 + 10 ** (-12 * k / 1280))) for k in range(256))
    return Tables(log_add, band_of_bin, HEARING)


def frame_strategies(code: int, blocks: int = 6) -> list[int]:
    """Strategies of a frame's blocks from a five-bit code: each bit begins a new run, and longer runs are finer in frequency."""
    begins = [0] + [k for k in range(1, blocks) if code >> (blocks - 1 - k) & 1] + [blocks]
    out = [REUSE] * blocks
    for a, b in zip(begins, begins[1:]):
        out[a] = D45 if b - a == 1 else D25 if b - a < 4 else D15
    return out


def groups_of(end: int, strategy: int) -> int:
    """Seven-bit groups that hold the exponents of bins 1 to ``end`` - 1."""
    return -(-(end - 1) // (3 * STEP[strategy]))


def log_add(a: int, b: int, table: tuple[int, ...]) -> int:
    """Log of a sum of powers."""
    return max(a, b) + table[min(abs(a - b) >> 1, len(table) - 1)]


def low_compensation(comp: int, here: int, above: int, band: int) -> int:
    """Less masking at low frequencies after a steep rise."""
    if band >= 20:
        return max(0, comp - 128)
    if here + 256 == above:
        return 384 if band < 7 else 320
    return max(0, comp - 64) if here > above else comp


def ungroup(first: int, grouped: list[int], repeat: int) -> list[int]:
    """Exponents from groups of three differences of -2 to 2, each for ``repeat`` bins."""
    steps = [d - 2 for g in grouped for d in (g // 25, g // 5 % 5, g % 5)]
    return [v for v in list(accumulate(steps, initial=first))[1:] for _ in range(repeat)]


def band_power(power: list[int], t: Tables) -> list[int]:
    """Powers of bins 0 on, added up per band."""
    out: list[int] = []
    for b, p in zip(t.band_of_bin, power):
        if b == len(out):
            out.append(p)
        else:
            out[b] = log_add(out[b], p, t.log_add)
    return out


def excitation(bands: list[int], t: Tables) -> list[int]:
    """Spread of each band over those above it, by a fast and a slow decay from the first rise on.

    With seven bands (the low-frequency channel) the last has none above it to compare with.
    """
    comp = fast = slow = 0
    decaying = False
    out = []
    for b, p in enumerate(bands):
        compared = b < 22 and b + 1 < len(bands)
        if compared:
            comp = low_compensation(comp, p, bands[b + 1], b)
        fast_here, slow_here = p - t.fast_gain, p - t.slow_gain
        fast = max(fast - t.fast_decay, fast_here) if decaying else fast_here
        slow = max(slow - t.slow_decay, slow_here) if decaying else slow_here
        e = fast - (comp if b < 22 else 0)
        out.append(max(e, slow) if decaying else e)
        decaying = decaying or b == 6 or (b >= 2 and compared and p <= bands[b + 1])
    return out


def allocate(exponents: list[int], offset: int, rate: int, t: Tables) -> list[int]:
    """Mantissa sizes (pointers) of bins 0 on: power, excitation, mask, then how far each bin lies above the mask."""
    power = [3072 - (e << 7) for e in exponents]
    bands = band_power(power, t)
    masks = []
    for p, e, quiet in zip(bands, excitation(bands, t), t.hearing[rate]):
        if p < t.knee:
            e += (t.knee - p) >> 2
        masks.append((max(0, max(e, quiet) - offset - t.floor) & 0x1FE0) + t.floor)
    last = len(t.pointer) - 1
    return [t.pointer[max(0, min(last, (p - masks[b]) >> 5))] for p, b in zip(power, t.band_of_bin)]


def mantissa_bits(pointers: list[int], table: tuple[int, ...] = MANTISSA_BITS, carried: tuple[int, int, int] = (0, 0, 0)) -> tuple[int, tuple[int, int, int]]:
    """Bits of all mantissas; groups of three (pointers 1 and 2) and two (4) go on across channels: (bits, places in the groups)."""
    bits = sum(table[p] for p in pointers if p not in (1, 2, 4))
    places = []
    for p, per, at in zip((1, 2, 4), (3, 3, 2), carried):
        n = pointers.count(p)
        bits += table[p] * (-(-(at + n) // per) - -(-at // per))
        places.append((at + n) % per)
    return bits, tuple(places)
