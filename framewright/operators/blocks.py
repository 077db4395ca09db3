"""The walk over a frame's audio blocks, to the places where skip fields go. No audio is decoded."""

from __future__ import annotations

from dataclasses import dataclass, field

from framewright.functions.bits import BitReader
from framewright.operators import allocation as A
from framewright.operators.frames import audio_header, header, inject_aux, inject_full, inject_skip

CHANNELS = 5
LOW_END = 7


@dataclass
class Walk:
    """Where each block's skip field is or would be, the bit after the last block, and why a walk stopped."""

    points: list[int] = field(default_factory=list)
    end_bit: int | None = None
    flag_bit: int | None = None
    flagged: bool = False
    unsupported: str | None = None


class _Channel:
    """A channel's exponents stay until new ones come, and with them its mantissa sizes."""

    def __init__(self, end: int):
        self.end, self.exponents, self.pointers = end, None, None

    def receive(self, r: BitReader, strategy: int) -> None:
        first = r.read(4)
        grouped = [r.read(7) for _ in range(A.groups_of(self.end, strategy))]
        self.exponents = [first, *A.ungroup(first, grouped, A.STEP[strategy])][: self.end]
        self.pointers = None

    def sizes(self, offset: int, rate: int, t: A.Tables) -> list[int]:
        if self.pointers is None:
            self.pointers = A.allocate(self.exponents, offset, rate, t)
        return self.pointers


def walk(frame: bytes, tables: A.Tables | None = None) -> Walk:
    """The walk of one frame. A skip field that is there is passed (T15); anything outside the subset, or a
    walk past the frame's end, gives a reason and the points so far."""
    t = tables or A.standard_tables()
    h, head = header(frame), audio_header(frame)
    if head is None or "unsupported" in head:
        return Walk(unsupported="stream information" if head is None else head["unsupported"])
    out = Walk(flag_bit=head["skipflde_bit"], flagged=bool(head["skipflde"]))
    if h.fscod > 2:
        out.unsupported = "fscod"
        return out
    coarse, fine = head["csnroffst"], head["fsnroffst"]
    offset = ((coarse - 15) * 16 + fine) * 4
    strategies = [A.frame_strategies(c, h.blocks) for c in head["expstr"]]
    full, low = [_Channel(0) for _ in range(CHANNELS)], _Channel(LOW_END)
    r = BitReader(frame, head["end_bit"])
    for k in range(h.blocks):
        r.read(CHANNELS * (head["blkswe"] + head["dithflage"]))
        if r.flag():
            r.read(8)  # dynamic range
        if (k == 0 or r.flag()) and r.flag():
            out.unsupported = "spectral extension"
            return out
        new = [(c, s[k]) for c, s in zip(full, strategies) if s[k] != A.REUSE]
        for c, _ in new:
            c.end = 3 * (r.read(6) + 12) + 37
        if any(c.end > len(t.band_of_bin) for c, _ in new):
            out.unsupported = "bandwidth"
            return out
        for c, s in new:
            c.receive(r, s)
            r.read(2)  # gain range
        if head["lfeexpstr"][k]:
            low.receive(r, A.D15)
        if head["frmfgaincode"] and r.flag():
            out.unsupported = "fast gain"
            return out
        if r.flag():
            r.read(10)  # offset for converters
        out.points.append(r.pos)
        if out.flagged and r.flag():
            r.read(8 * r.read(9))
        if coarse or fine:
            if any(c.exponents is None for c in (*full, low)):
                out.unsupported = "exponents"
                return out
            places = (0, 0, 0)
            for c in (*full, low):
                n, places = A.mantissa_bits(c.sizes(offset, h.fscod, t), t.mantissa_bits, places)
                r.pos += n
        if r.pos > r.size - 18:
            out.unsupported = "length"
            return out
    out.end_bit = r.pos
    return out


def carry(frame: bytes, addbsi: bytes, payload: bytes, target: int = 2, tables: A.Tables | None = None) -> tuple[bytes, str] | None:
    """C18, then C17, then C16: the payload put into the middle of the frame where the walk allows it, else at
    its end: (frame, carriage). None: the frame would get too long."""
    seen = walk(frame, tables)
    if seen.unsupported is None:
        new = inject_skip(frame, addbsi, payload, seen.points, seen.flag_bit, target)
        if new is not None:
            return new, "skip"
    new = inject_full(frame, addbsi, payload)
    if new is not None:
        return new, "aux"
    new = inject_aux(frame, payload)
    return None if new is None else (new, "aux only")
