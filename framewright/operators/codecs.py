"""Nested payloads: container, object positions and mixing matrices. Kernels work on bytes; Spark forms are Arrow maps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from framewright.functions.bits import BitReader, BitWriter, Tree, balanced_tree, crc8_bits, crc32_bits, keyed_bits, sync_bits, tree_codes, tree_decode
from framewright.schemas import CONTAINER_SYNC, JOC_BANDS, JOC_CHANNELS, JOC_ID, OAMD_ID, PROTECTION_BITS


class Protector(Protocol):
    """The strategy that makes a container's protection fields; always passed on, never global."""

    key_id: int
    selectors: tuple[int, int]

    def primary(self, covered: bytes, nbits: int) -> int: ...

    def secondary(self, covered: bytes, nbits: int) -> int: ...


@dataclass(frozen=True)
class PublicCrc:
    key_id: int = 0
    selectors: tuple[int, int] = (2, 1)

    def primary(self, covered: bytes, nbits: int) -> int:
        return crc32_bits(covered, nbits)

    def secondary(self, covered: bytes, nbits: int) -> int:
        return crc8_bits(covered, nbits)


@dataclass(frozen=True)
class Keyed:
    key: bytes
    key_id: int = 0
    selectors: tuple[int, int] = (2, 1)

    def primary(self, covered: bytes, nbits: int) -> int:
        return keyed_bits(self.key, self.key_id, covered, nbits, PROTECTION_BITS[self.selectors[0]])

    def secondary(self, covered: bytes, nbits: int) -> int:
        return keyed_bits(self.key, self.key_id, covered, nbits, PROTECTION_BITS[self.selectors[1]])


# -- container (C4 to C8) -------------------------------------------------------------------------


def wrap(payloads: list[tuple[int, bytes]], protector: Protector | None = None) -> bytes:
    protector = protector or PublicCrc()
    w = BitWriter().write(0, 2).write(protector.key_id, 3)
    for kind, data in payloads:
        w.write(kind, 5).write(0, 1).write(0, 1).write(1, 1).variable(0, 2).write(0, 1).write(0, 1)  # no offset, no duration, group 0, no codec data, kept
        w.write(1, 1).write(0, 2).write(0, 7)  # frame aligned
        w.variable(len(data), 8).write(int.from_bytes(data, "big"), 8 * len(data))
    w.write(0, 5).write(protector.selectors[0], 2).write(protector.selectors[1], 2)
    for width, value in ((PROTECTION_BITS[protector.selectors[0]], protector.primary), (PROTECTION_BITS[protector.selectors[1]], protector.secondary)):
        covered, n = w.snapshot()
        w.write(value(covered, n), width)
    body = w.bytes()
    return CONTAINER_SYNC.to_bytes(2, "big") + len(body).to_bytes(2, "big") + body


@dataclass
class Container:
    payloads: list[tuple[int, bytes]] = field(default_factory=list)
    length: int = 0
    key_id: int = 0
    key_id_bit: int = 0
    selectors: tuple[int, int] = (0, 0)
    primary_bit: int = 0
    secondary_bit: int = 0
    end_bit: int = 0
    primary: int = 0
    secondary: int = 0
    truncated: bool = False


def walk(buf: bytes) -> Container | None:
    """One walk of a container that begins with its sync word: payloads, fields and their bit places (None: no sync)."""
    r = BitReader(buf)
    if r.size < 32 or r.read(16) != CONTAINER_SYNC:
        return None
    c = Container(length=r.read(16))
    r.read(2)
    c.key_id_bit, c.key_id = r.pos, r.read(3)
    while kind := r.read(5):
        offset = r.flag()
        if offset:
            r.read(12)
        if r.flag():
            r.variable(11)
        if r.flag():
            r.variable(2)
        if r.flag():
            r.read(8)
        if not r.flag():
            aligned = False
            if not offset:
                aligned = r.flag()
                if aligned:
                    r.read(2)
            if offset or aligned:
                r.read(7)
        size = r.variable(8)
        if r.pos + 8 * size > r.size:
            c.truncated = True
            return c
        c.payloads.append((kind, r.read(8 * size).to_bytes(size, "big")))
    c.selectors = (r.read(2), r.read(2))
    c.primary_bit, c.primary = r.pos, r.read(PROTECTION_BITS[c.selectors[0]])
    c.secondary_bit, c.secondary = r.pos, r.read(PROTECTION_BITS[c.selectors[1]])
    c.end_bit = r.pos
    c.truncated = r.pos > r.size
    return c


def verify(buf: bytes, protector: Protector | None = None) -> dict | None:
    """Stored protection fields beside computed ones."""
    c = walk(buf)
    if c is None or c.truncated:
        return None
    p = protector or PublicCrc()
    first, second = c.primary_bit - 32, c.secondary_bit - 32
    body = buf[4:]
    cut = lambda n: BitWriter().bits(body, n).snapshot()
    widths = PROTECTION_BITS[c.selectors[0]], PROTECTION_BITS[c.selectors[1]]
    ours = [f(*cut(n)) & ((1 << w) - 1) for f, n, w in ((p.primary, first, widths[0]), (p.secondary, second, widths[1]))]
    hexed = lambda v, w: f"{v:0{w // 4}x}" if w else ""
    return {
        "prim_bits": widths[0], "sec_bits": widths[1], "key_id": c.key_id, "stored": hexed(c.primary, widths[0]) + hexed(c.secondary, widths[1]), "ours": hexed(ours[0], widths[0]) + hexed(ours[1], widths[1]),
        "match": [c.primary, c.secondary] == ours,
    }


def find(frame: bytes, strict: bool = False) -> tuple[int, bytes] | None:
    """The first container at any bit, moved to a byte; strict: it must walk with 32 and 8 bits of protection."""
    for pos in sync_bits(frame, CONTAINER_SYNC):
        left = 8 * len(frame) - pos
        if left < 40:
            return None
        length = BitReader(frame, pos + 16).read(16)
        if not 0 < length <= left // 8 - 4:
            continue
        moved = BitWriter().bits(frame, 8 * (length + 4), pos).bytes()
        c = walk(moved)
        if c is None or c.truncated or (strict and (c.selectors != (2, 1) or c.end_bit > 8 * len(moved))) or not c.payloads:
            continue
        return pos, moved
    return None


# -- object positions (C1 to C3) ------------------------------------------------------------------


def _code(v: float, most: int) -> int:
    return int(min(1.0, max(0.0, v)) * most + 0.5)  # halves away from zero, of what isn't negative


def quantize(x: float, y: float, z: float) -> tuple[int, int, bool, int]:
    return _code((x + 1) / 2, 62), _code((1 - y) / 2, 62), z >= 0, _code(abs(z), 15)


def encode_objects(objects: list[tuple[float, float, float]], lfe: bool) -> bytes:
    """Positions of 1 to 159 objects (the bed's LFE first) in one element of one block."""
    total = len(objects) + int(lfe)
    if not 1 <= total <= 159:
        raise ValueError("1 to 159 objects")
    e = BitWriter().write(0, 2).write(0, 3).write(0, 6).write(2, 2)  # sample offset, one block, its offset, ramp code
    e.write(1, 1)
    for k in range(total):
        bed = lfe and k == 0
        e.write(0, 1)
        if bed:
            e.write(0, 2).write(1, 1)
        else:
            px, py, up, pz = quantize(*objects[k - int(lfe)])
            e.write(3, 2).write(1, 1)
            e.write(px, 6).write(py, 6).write(int(up), 1).write(pz, 4).write(0, 1).write(1, 4).write(0, 2).write(0, 1).write(0, 1)
        e.write(0, 1)
    w = BitWriter().write(0, 2).count5(total - 1)
    w.write(1, 1).write(int(lfe), 1).write(0, 1).write(1, 4)
    w.write(1, 4).variable(e.size - 1, 4).write(0, 1).write(e.value, e.size)  # the size is in bits, less one
    return w.bytes()


def decode_objects(payload: bytes) -> dict:
    """``{object_count, bed_count, objects: [{obj, block, px, py, up, pz, is_bed}], fields, pad_bits}``; differential positions are null.

    ``fields`` lists (object, block, field, value) in order, for the verbose dump (C3).
    """
    r = BitReader(payload)
    fields: list[tuple[int, int, str, int]] = []

    def take(name: str, n: int, obj: int = -1, block: int = -1) -> int:
        v = r.read(n)
        fields.append((obj, block, name, v))
        return v

    take("version", 2)
    total = r.count5() + 1
    fields.append((-1, -1, "object_count", total))
    bed = 0
    if take("dynamic_only", 1):
        bed = take("lfe", 1)
    take("alternate", 1)
    objects, pad = [], 0
    for _ in range(take("elements", 4)):
        kind = take("element_id", 4)
        bits = r.variable(4, 5) + 1
        end = r.pos + bits
        take("discard", 1)
        if kind != 1:
            r.pos = end
            continue
        take("sample_offset", 2)
        blocks = take("blocks", 3) + 1
        for b in range(blocks):
            take("block_offset", 6, -1, b)
            if take("ramp", 2, -1, b) == 3:
                take("ramp_duration", 4 if take("ramp_short", 1, -1, b) else 11, -1, b)
        take("reserved_absent", 1)
        for o in range(total):
            for b in range(blocks):
                objects.append(_object(r, take, o, b, o < bed))
        pad = max(0, end - r.pos)
        r.pos = max(r.pos, min(end, r.size))
    return {"object_count": total, "bed_count": bed, "objects": objects, "fields": fields, "pad_bits": pad}


def _object(r: BitReader, take, o: int, b: int, is_bed: bool) -> dict:
    """One object in one block. Status 1 (always in the first block) brings all groups of fields, status 3 those of a mask before them."""
    out = {"obj": o, "block": b, "px": None, "py": None, "up": None, "pz": None, "is_bed": is_bed}
    f = lambda name, n: take(name, n, o, b)

    def groups(name: str, n: int) -> int | None:
        status = 1 if b == 0 else f(f"{name}_status", 2)
        return f(f"{name}_mask", n) if status == 3 else (1 << n) - 1 if status == 1 else None

    active = not f("inactive", 1)
    basic = (groups("basic", 2) if active else None) or 0
    if basic & 2 and f("gain_idx", 2) == 2:
        f("gain", 6)
    if basic & 1 and not f("default_priority", 1):
        f("priority", 5)
    given = groups("render", 4) if active and not is_bed else None
    render = given or 0
    if render & 1:
        if b > 0 and f("differential", 1):
            for n in ("dx", "dy", "dz"):
                f(n, 3)
        else:
            out |= {"px": f("x", 6), "py": f("y", 6), "up": f("z_up", 1) == 1, "pz": f("z", 4)}
        if f("distance", 1) and not f("infinite", 1):
            f("distance_factor", 4)
    if render & 2:
        f("zone", 4)
    if render & 4:
        size = f("size_idx", 2)
        if size in (1, 2):
            f("size", 5 if size == 1 else 15)
    if render & 8 and f("screen", 1):
        f("screen_factor", 3), f("depth_factor", 2)
    if given is not None:
        f("snap", 1)
    if f("extra", 1):
        f("extra_bytes", 8 * (f("extra_size", 4) + 1))
    return out


# -- mixing matrices (C9 to C12) ------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Code trees by name (coarse and fine matrices and vectors, channel indices for five and seven); parameters, never built in."""

    matrix: tuple[Tree, Tree]
    vector: tuple[Tree, Tree]
    index: dict[int, Tree]


def own_trees() -> Trees:
    """Trees for streams that this engine writes and reads itself."""
    coarse, fine = balanced_tree(96), balanced_tree(192)
    return Trees((coarse, fine), (coarse, fine), {5: balanced_tree(5), 7: balanced_tree(7)})


def gain_code(g: float) -> int:
    v = min(abs(g / 0.1), 96.0)  # the ends of the range, for infinite gains, too
    n = int(v) + (v % 1 >= 0.5)  # halves away from zero; v + 0.5 would round itself
    return max(0, min(191, (n if g >= 0 else -n) + 96))


def encode_matrices(matrices: list[list[float]], seq: int, trees: Trees) -> bytes:
    """One broadband row of five gains per object; twelve bands, fine, dense, one point."""
    if not 1 <= len(matrices) <= 64:
        raise ValueError("1 to 64 objects")
    w = BitWriter().write(0, 3).write(len(matrices) - 1, 6).write(0, 3).write(4, 3).write(0, 5).write(seq % 1024, 10)
    for _ in matrices:
        w.write(1, 1).write(5, 3).write(0, 1).write(1, 1).write(0, 1).write(0, 1)
    codes = tree_codes(trees.matrix[1])
    for row in matrices:
        for g in row:
            for sym in [(gain_code(g) - 96) % 192, *[0] * 11]:
                w.write(*codes[sym])
    return w.bytes()


def decode_matrices(payload: bytes, trees: Trees) -> dict:
    """``{seq, channels, gain_pow, gain_frac, objects, error}``; an object has bands, sparse, quant, points and codes or (first, indices, values)."""
    r = BitReader(payload)
    out: dict = {"seq": None, "channels": None, "objects": [], "error": None}
    try:
        dmx = r.read(3)
        if dmx not in JOC_CHANNELS:
            raise ValueError(f"downmix configuration {dmx}")
        channels = out["channels"] = JOC_CHANNELS[dmx]
        count = r.read(6) + 1
        if ext := r.read(3):
            raise ValueError(f"extension {ext}")
        out["gain_pow"], out["gain_frac"], out["seq"] = r.read(3), r.read(5), r.read(10)
        for _ in range(count):
            o: dict = {"active": r.flag()}
            if o["active"]:
                o |= {"bands": JOC_BANDS[r.read(3)], "sparse": r.flag(), "quant": r.read(1), "steep": r.flag(), "points": r.read(1) + 1}
                o["offsets"] = [r.read(5) + 1 for _ in range(o["points"])] if o["steep"] else []
            out["objects"].append(o)
        for o in out["objects"]:
            if not o["active"]:
                continue
            if o["sparse"]:
                o["vectors"] = []
                for _ in range(o["points"]):
                    first = r.read(3)
                    rest = [tree_decode(trees.index[channels], r) for _ in range(o["bands"] - 1)]
                    o["vectors"].append((first, rest, [tree_decode(trees.vector[o["quant"]], r) for _ in range(o["bands"])]))
            else:
                o["matrix"] = [[[tree_decode(trees.matrix[o["quant"]], r) for _ in range(o["bands"])] for _ in range(channels)] for _ in range(o["points"])]
        if r.pos > r.size:
            raise ValueError("payload runs over its end")
    except ValueError as e:
        out["error"] = str(e)
    return out


def gains(obj: dict) -> list[list[list[float]]]:
    """Gains per point, channel and band of a dense object: running sums from 0 dB, modulo the code range."""
    span, step = (192, 0.1) if obj["quant"] else (96, 0.2)
    out = []
    for point in obj["matrix"]:
        rows = []
        for codes in point:
            value, row = span // 2, []
            for c in codes:
                value = (value + c) % span
                row.append((value - span // 2) * step)
            rows.append(row)
        out.append(rows)
    return out


# -- Spark forms ----------------------------------------------------------------------------------


def mapped(df: DataFrame, schema: str, row, *columns: str, streams: bool = False) -> DataFrame:
    """Arrow map of a kernel over rows: ``row(*values)`` gives a list of tuples, one per output row.

    ``streams`` puts the ``stream_id`` of a row, where there is one, before its output columns.
    """
    if streams and "stream_id" in df.columns:
        one = row
        schema, columns = f"stream_id string, {schema}", ("stream_id", *columns)
        row = lambda sid, *values: [(sid, *x) for x in one(*values)]
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for values in zip(*(b.column(c).to_pylist() for c in columns), strict=True) for x in row(*values)]
            yield pa.RecordBatch.from_pydict({f.name: pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(target)}, schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def payloads(frames: DataFrame) -> DataFrame:
    """``(frame_idx, n, id, payload)`` of each frame's container, wherever it is."""

    def row(idx, data):
        got = find(data or b"")
        return [(idx, n, k, p) for n, (k, p) in enumerate(walk(got[1]).payloads)] if got else []

    return mapped(frames, "frame_idx long, n int, id int, payload binary", row, "frame_idx", "bytes", streams=True)


def positions(payload: DataFrame) -> DataFrame:
    """Object rows of each OAMD payload."""

    def row(idx, kind, data):
        if kind != OAMD_ID:
            return []
        return [(idx, o["obj"], o["px"], o["py"], o["up"], o["pz"], o["is_bed"]) for o in decode_objects(data)["objects"] if o["block"] == 0]

    return mapped(payload, "frame_idx long, obj int, px int, py int, up boolean, pz int, is_bed boolean", row, "frame_idx", "id", "payload", streams=True)


def oamd_fields(payload: DataFrame) -> DataFrame:
    """Every field of each OAMD payload, in order."""

    def row(idx, kind, data):
        return [(idx, n, *f) for n, f in enumerate(decode_objects(data)["fields"])] if kind == OAMD_ID else []

    return mapped(payload, "frame_idx long, n int, obj int, block int, field string, value decimal(38,0)", lambda *a: [(*x[:-1], Decimal(x[-1])) for x in row(*a)], "frame_idx", "id", "payload", streams=True)


def matrices(payload: DataFrame, trees: Trees) -> DataFrame:
    """Dense codes in long form, or an error per payload."""

    def row(idx, kind, data):
        if kind != JOC_ID:
            return []
        d = decode_matrices(data, trees)
        if d["error"]:
            return [(idx, d["seq"], None, None, None, None, None, d["error"])]
        return [(idx, d["seq"], o, p, c, b, v, None) for o, x in enumerate(d["objects"]) if "matrix" in x for p, pt in enumerate(x["matrix"]) for c, ch in enumerate(pt) for b, v in enumerate(ch)]

    return mapped(payload, "frame_idx long, seq int, obj int, dp int, ch int, band int, code int, error string", row, "frame_idx", "id", "payload", streams=True)


def verified(frames: DataFrame, protector: Protector | None = None) -> DataFrame:
    """Protection report per frame that has a container."""

    def row(idx, data):
        got = find(data or b"")
        v = verify(got[1], protector) if got else None
        return [(idx, got[0], v["prim_bits"], v["sec_bits"], v["key_id"], v["stored"], v["ours"], v["match"])] if v else []

    return mapped(frames, "frame_idx long, bit int, prim_bits int, sec_bits int, key_id int, stored string, ours string, match boolean", row, "frame_idx", "bytes", streams=True)


def oamd_roundtrip(df: DataFrame) -> DataFrame:
    """``(frame_idx, object_count, bed_count, px, py, up, pz)`` of positions ``(frame_idx, x, y, z)`` that were encoded, wrapped, found and decoded."""

    def row(idx, x, y, z):
        c = walk(wrap([(OAMD_ID, encode_objects(list(zip(x, y, z, strict=True)), True))]))
        d = decode_objects(c.payloads[0][1])
        got = [o for o in d["objects"] if not o["is_bed"]]
        return [(idx, d["object_count"], d["bed_count"], *([o[c] for o in got] for c in ("px", "py", "up", "pz")))]

    return mapped(df, "frame_idx long, object_count int, bed_count int, px array<int>, py array<int>, up array<boolean>, pz array<int>", row, "frame_idx", "x", "y", "z")


#: Bytes of a payload of ``emdf_roundtrip``; longer texts take several containers.
PART = 16_000


def emdf_roundtrip(df: DataFrame) -> DataFrame:
    """``(frame_idx, n, bytes, payloads, ok)`` per container of four payloads for each PART bytes of ``(frame_idx, payload)``."""

    def row(idx, data):
        out = []
        for n, at in enumerate(range(0, max(1, len(data)), PART)):
            part = data[at : at + PART]
            buf = wrap([(11, part), (14, part[::-1]), (2, b"\x04\x94\x80"), (1, b"\x02\x00")])
            c = walk(buf)
            ok = [p for _, p in c.payloads] == [part, part[::-1], b"\x04\x94\x80", b"\x02\x00"] and verify(buf)["match"]
            out.append((idx, n, len(buf), len(c.payloads), ok))
        return out

    return mapped(df, "frame_idx long, n int, bytes int, payloads int, ok boolean", row, "frame_idx", "payload")


def joc_roundtrip(df: DataFrame, trees: Trees | None = None) -> DataFrame:
    """``(frame_idx, seq, objects, codes)`` of gains ``(frame_idx, rows)`` that were encoded and decoded: gain codes by object and channel, null unless all bands agree."""
    trees = trees or own_trees()

    def row(idx, rows):
        d = decode_matrices(encode_matrices(rows, idx, trees), trees)
        bands = [ch for o in d["objects"] for ch in gains(o)[0]]
        return [(idx, d["seq"], len(d["objects"]), [round(b[0] / 0.1) + 96 if len(set(b)) == 1 else None for b in bands])]

    return mapped(df, "frame_idx long, seq int, objects int, codes array<int>", row, "frame_idx", "rows")
