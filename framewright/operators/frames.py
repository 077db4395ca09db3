"""Frames: scanning, headers, the walk to the stream information's end, aux data, and rewriting with new sizes and checksums."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.bits import BitReader, BitWriter, crc16, get_bits, set_bits
from framewright.operators.codecs import find, mapped
from framewright.schemas import BLOCKS, FULL_CHANNELS, SAMPLE_RATES

LIMIT = 4096


@dataclass(frozen=True)
class Header:
    size: int
    strmtyp: int
    substreamid: int
    fscod: int
    blocks: int
    acmod: int
    lfe: bool
    bsid: int

    @property
    def sample_rate(self) -> int:
        return SAMPLE_RATES[self.fscod]

    @property
    def samples(self) -> int:
        return 256 * self.blocks

    @property
    def full_channels(self) -> int:
        return FULL_CHANNELS[self.acmod] if self.acmod < len(FULL_CHANNELS) else 0


def header(data: bytes) -> Header:
    """The header at the start of some bytes; what is missing reads as zero."""
    r = BitReader(data[:8], 16)
    strmtyp, sub, size, fscod, blk, acmod, lfe, bsid = (r.read(n) for n in (2, 3, 11, 2, 2, 3, 1, 5))
    return Header(2 * (size + 1), strmtyp, sub, fscod, 6 if fscod == 3 else BLOCKS[blk], acmod, bool(lfe), bsid)


def scan(chunks: Iterator[bytes], start: int = 0) -> Iterator[tuple[int, bool, bytes]]:
    """(offset, is a frame, bytes) of a stream given in chunks of any sizes.

    Junk comes out as it is passed, a truncated last frame as junk, so that all pieces put together are the
    stream; at most one frame and one chunk are held.
    """
    buf, at = b"", start
    for chunk in chunks:
        buf += chunk
        pos = 0
        while True:
            sync = buf.find(b"\x0b\x77", pos)
            if sync < 0:
                keep = 1 if buf.endswith(b"\x0b") and len(buf) > pos else 0
                if len(buf) - keep > pos:
                    yield at + pos, False, buf[pos : len(buf) - keep]
                    pos = len(buf) - keep
                break
            if sync > pos:
                yield at + pos, False, buf[pos:sync]
                pos = sync
            if len(buf) < pos + 4:
                break
            size = 2 * ((int.from_bytes(buf[pos + 2 : pos + 4], "big") & 0x7FF) + 1)
            if len(buf) < pos + size:
                break
            yield at + pos, True, buf[pos : pos + size]
            pos += size
        buf, at = buf[pos:], at + pos
    if buf:
        yield at, False, buf


def transform(chunks: Iterator[bytes], f: Callable[[Header, int, bytes], bytes | None]) -> Iterator[bytes]:
    """ST1, ST2: a function over the frames of a stream; junk stays, a result of None leaves the frame."""
    n = 0
    for _, is_frame, data in scan(chunks):
        if is_frame:
            out = f(header(data), n, data)
            n += 1
            yield data if out is None else out
        else:
            yield data


# -- the walk through the stream information (C13, C14) -------------------------------------------


@dataclass
class Info:
    fields: dict[str, int]
    infomdate_bit: int | None = None
    addbsie_bit: int | None = None
    addbsi: bytes | None = None
    end_bit: int | None = None


def info(frame: bytes) -> Info | None:
    """One walk for all positions; None unless the stream is of identification 16."""
    h = header(frame)
    if h.bsid != 16:
        return None
    r, f = BitReader(frame, 45), {}
    take = lambda name, n: f.setdefault(name, r.read(n))

    def optional(*widths: int) -> bool:
        if r.read(1):
            for n in widths:
                r.read(n)
            return True
        return False

    take("dialnorm", 5)
    if take("compre", 1):
        take("compr", 8)
    if h.acmod == 0:
        take("dialnorm2", 5)
        optional(8)
    if h.strmtyp == 1 and take("chanmape", 1):
        take("chanmap", 16)
    if take("mixmdate", 1):
        _mixing(r, h, optional)
    out = Info(f, infomdate_bit=r.pos)
    if take("infomdate", 1):
        take("bsmod", 3), r.read(2)
        if h.acmod == 2:
            r.read(4)
        if h.acmod >= 6:
            r.read(2)
        optional(5, 2, 1)
        if h.acmod == 0:
            optional(5, 2, 1)
        if h.fscod < 3:
            r.read(1)
    if h.strmtyp == 0 and h.blocks != 6:
        r.read(1)
    out.addbsie_bit = r.pos
    if take("addbsie", 1):
        n = take("addbsil", 6) + 1
        out.addbsi = BitWriter().bits(frame, 8 * n, r.pos).bytes()
        r.read(8 * n)
    out.end_bit = r.pos
    return out if r.pos <= r.size else None


def _mixing(r: BitReader, h: Header, optional: Callable[..., bool]) -> None:
    if h.acmod > 2:
        r.read(2)
        if h.acmod & 1:
            r.read(6)
    if h.acmod & 4:
        r.read(6)
    if h.lfe:
        optional(5)
    if h.strmtyp:
        return
    optional(6)
    if h.acmod == 0:
        optional(6)
    optional(6)
    kind = r.read(2)
    if kind == 3:
        r.read(8 * (r.read(5) + 2))
    else:
        r.read((0, 5, 12)[kind])
    if h.acmod < 2:
        optional(8, 6)
        if h.acmod == 0:
            optional(8, 6)
    if r.read(1):
        if h.blocks == 1:
            r.read(5)
        else:
            for _ in range(h.blocks):
                optional(5)


def extension(frame: bytes) -> tuple[bool, int] | None:
    """C14: (flag, complexity) of the additional information; None without it."""
    i = info(frame)
    if i is None or not i.addbsi or len(i.addbsi) < 2:
        return None
    return bool(i.addbsi[0] & 1), i.addbsi[1]


# -- aux data and rewriting (C15 to C19) ----------------------------------------------------------


def read_aux(frame: bytes) -> tuple[bytes, int] | None:
    """(payload from its first bit, bits) of the aux field, read from the frame's end."""
    end = 8 * len(frame) - 18
    if end < 14 or not get_bits(frame, end, 1):
        return None
    n = get_bits(frame, end - 14, 14)
    if n > end - 14:
        return None
    return BitWriter().bits(frame, n, end - 14 - n).bytes(), n


def _finish(head: BitWriter, tail: BitWriter) -> bytes | None:
    """Body and tail in the smallest even number of bytes, with size and checksum set; None: too long."""
    size = -(-(head.size + tail.size + 16) // 16) * 2
    if size > LIMIT:
        return None
    w = BitWriter().write(head.value, head.size)
    w.write(0, 8 * size - 16 - head.size - tail.size).write(tail.value, tail.size).write(0, 16)
    return sealed(w.bytes())


def sealed(frame: bytes) -> bytes:
    """The frame with its own size in the header and the checksum over all but the sync word."""
    out = set_bits(frame, 21, len(frame) // 2 - 1, 11)
    return out[:-2] + crc16(out[2:-2]).to_bytes(2, "big")


def _aux(payload: bytes, bits: int) -> BitWriter:
    """Payload, its length, the flag for it and a reserved bit; the checksum follows."""
    return BitWriter().bits(payload, bits).write(bits, 14).write(1, 1).write(0, 1)


def inject_aux(frame: bytes, payload: bytes, bits: int | None = None) -> bytes | None:
    """The frame grown by an aux field; an aux field that is there stays part of the body."""
    body = BitWriter().bits(frame, 8 * len(frame) - 18)
    return _finish(body, _aux(payload, 8 * len(payload) if bits is None else bits))


def inject_full(frame: bytes, addbsi: bytes, payload: bytes, bits: int | None = None) -> bytes | None:
    """C17: additional information and an aux field; None if the frame has such information or none can be."""
    i = info(frame)
    if i is None or i.fields["addbsie"] or not 1 <= len(addbsi) <= 64:
        return None
    w = BitWriter().bits(frame, i.addbsie_bit).write(1, 1).write(len(addbsi) - 1, 6).bits(addbsi, 8 * len(addbsi))
    w.bits(frame, 8 * len(frame) - 18 - i.end_bit, i.end_bit)
    return _finish(w, _aux(payload, 8 * len(payload) if bits is None else bits))


def inject_skip(frame: bytes, addbsi: bytes, payload: bytes, points: list[int] | None, flag_bit: int | None, target: int = 2, info_block: bool = True) -> bytes | None:
    """The payload in the skip field of one block, given the blocks' skip points and the syntax flag's bit; None: use C17.

    ``info_block`` adds an information block of zeros where there is none and its length is known (nine bits).
    """
    i, h = info(frame), header(frame)
    if i is None or i.fields["addbsie"] or not points or flag_bit is None or not 0 <= target < len(points) or len(payload) > 511 or not 1 <= len(addbsi) <= 64:
        return None
    places = [i.addbsie_bit, flag_bit, *points, 8 * len(frame) - 18]
    if any(a >= b for a, b in zip(places[:2], places[1:])) or any(a > b for a, b in zip(places[2:], places[3:])) or get_bits(frame, flag_bit, 1):
        return None
    w, at = BitWriter(), 0
    if info_block and not i.fields["infomdate"] and h.acmod == 7 and h.fscod < 3:
        w.bits(frame, i.infomdate_bit).write(1, 1).write(0, 9)
        at = i.infomdate_bit + 1
    w.bits(frame, i.addbsie_bit - at, at).write(1, 1).write(len(addbsi) - 1, 6).bits(addbsi, 8 * len(addbsi))
    w.bits(frame, flag_bit - i.end_bit, i.end_bit).write(1, 1)
    at = flag_bit + 1
    for k, p in enumerate(points):
        w.bits(frame, p - at, at).write(int(k == target), 1)
        if k == target:
            w.write(len(payload), 9).bits(payload, 8 * len(payload))
        at = p
    w.bits(frame, places[-1] - at, at)
    return _finish(w, BitWriter().write(0, 2))


def splice(frame: bytes, container: bytes, complexity: int | None = None) -> bytes | None:
    """Another container over the frame's own one, at its length; None: no container, or it doesn't fit."""
    got = find(frame)
    if got is None or len(container) > len(got[1]):
        return None
    pos, native = got
    out = set_bits(frame, pos, int.from_bytes(container.ljust(len(native), b"\0"), "big"), 8 * len(native))
    if complexity is not None:
        i = info(out)
        if i is None or not i.addbsi or len(i.addbsi) < 2:
            return None
        out = set_bits(out, i.addbsie_bit + 7 + 8, complexity, 8)
    return out[:-2] + crc16(out[2:-2]).to_bytes(2, "big")


def mutate(frame: bytes, key_id: int | None = None, corrupt_primary: bool = False, corrupt_secondary: bool = False) -> bytes | None:
    """Fields of the frame's container changed in place and the checksum renewed; None: no such container."""
    from framewright.functions.bits import flip_bit
    from framewright.operators.codecs import walk

    if key_id is not None and not 0 <= key_id <= 7:
        raise ValueError("a key id has three bits")
    got = find(frame, strict=True)
    if got is None:
        return None
    pos, moved = got
    c, out = walk(moved), frame
    if key_id is not None:
        out = set_bits(out, pos + c.key_id_bit, key_id, 3)
    if corrupt_primary:
        out = flip_bit(out, pos + c.primary_bit)
    if corrupt_secondary:
        out = flip_bit(out, pos + c.secondary_bit)
    return out[:-2] + crc16(out[2:-2]).to_bytes(2, "big")


# -- audio frame header (C20) ---------------------------------------------------------------------


def audio_header(frame: bytes) -> dict | None:
    """The audio-frame header of the supported subset, or ``{"unsupported": reason}``."""
    h, i = header(frame), info(frame)
    if i is None:
        return None
    if (h.acmod, h.lfe, h.blocks, h.strmtyp) != (7, True, 6, 0):
        return {"unsupported": "layout"}
    r = BitReader(frame, i.end_bit)
    out: dict = {}
    for name, n, must in (("expstre", 1, 0), ("ahte", 1, 0), ("snroffststr", 2, 0), ("transproce", 1, 0), ("blkswe", 1, None), ("dithflage", 1, None), ("bamode", 1, 0), ("frmfgaincode", 1, None), ("dbaflde", 1, 0)):
        out[name] = r.read(n)
        if must is not None and out[name] != must:
            return {"unsupported": name}
    out["skipflde_bit"], out["skipflde"] = r.pos, r.read(1)
    if r.read(1):
        return {"unsupported": "spxattene"}
    for k in range(h.blocks):
        if (k == 0 or r.read(1)) and r.read(1):
            return {"unsupported": "coupling"}
    out["expstr"] = [r.read(5) for _ in range(5)]
    out["lfeexpstr"] = [r.read(1) for _ in range(6)]
    out["convexpstr"] = [r.read(5) for _ in range(5)]
    out["csnroffst"], out["fsnroffst"] = r.read(6), r.read(4)
    if r.read(1):
        words = len(frame) // 2
        r.read((h.blocks - 1) * (4 + max(0, (words - 1).bit_length())))
    out["end_bit"] = r.pos
    return out


# -- synthetic streams and Spark forms ------------------------------------------------------------


def synthetic(size: int, fill: int = 0xAA) -> bytes:
    """A frame of an even size with a valid sync word and size, all else filled."""
    w = size // 2 - 1
    return bytes([0x0B, 0x77, w >> 8 & 7, w & 255]) + bytes([fill]) * (size - 4)


def scanned(streams: DataFrame) -> DataFrame:
    """``(stream_id, n, offset, is_frame, bytes)`` of whole streams ``(stream_id, data)``, gaps included."""

    def row(sid, data):
        return [(sid, n, off, ok, x) for n, (off, ok, x) in enumerate(scan(iter([data or b""])))]

    return mapped(streams, "stream_id string, n long, offset long, is_frame boolean, bytes binary", row, "stream_id", "data")


def headers(frames: DataFrame) -> DataFrame:
    """S6a, P1, P2 as columns, on the JVM side."""
    word = lambda a, n: F.conv(F.hex(F.substring("bytes", a, n)), 16, 10).cast("long")
    bits = word(3, 4)  # bits 16 to 47
    cut = lambda at, n: F.shiftright(bits, 48 - at - n).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k + 1)
    fscod, acmod = cut(32, 2), cut(36, 3)
    return frames.withColumns(
        {
            "size": (cut(21, 11) + 1) * 2, "strmtyp": cut(16, 2), "substreamid": cut(18, 3), "fscod": fscod, "sample_rate": pick(SAMPLE_RATES, fscod),
            "blocks": F.when(fscod == 3, 6).otherwise(pick(BLOCKS, cut(34, 2))), "acmod": acmod, "lfe": cut(39, 1) == 1, "bsid": cut(40, 5), "full_channels": pick(FULL_CHANNELS, acmod),
        }
    )


def transformed(frames: DataFrame, f: Callable[[Header, int, bytes], bytes | None], key: str = "frame_idx") -> DataFrame:
    """U1, ST1: a function over the rows of a frame table; None leaves a frame as it is."""

    def row(sid, idx, data):
        return [(sid, idx, f(header(data), idx, data) or data)]

    return mapped(frames, f"stream_id string, {key} long, bytes binary", row, "stream_id", key, "bytes")


def identity_check(df: DataFrame) -> DataFrame:
    """Streams made of the given bytes as junk and frames; pieces found at several chunk sizes, and whether they conserve the bytes."""

    def row(sid, fill):
        data = b"\x01\x02\x03" + synthetic(8 + 2 * (len(fill) % 20)) + fill + synthetic(32, 0xCC) + synthetic(6, 0xBB) + b"\x0b\x77\x01"
        seen = [[x for x in scan(iter([data[i : i + k] for i in range(0, len(data), k)]))] for k in (5, 8, 13, 1024)]
        same = all(b"".join(p[2] for p in s) == data for s in seen) and len({tuple((o, x) for o, ok, x in s if ok) for s in seen}) == 1
        return [(str(sid), sum(1 for x in seen[0] if x[1]), len(data), same)]

    return mapped(df, "stream_id string, frames int, bytes int, ok boolean", row, "stream_id", "fill")
