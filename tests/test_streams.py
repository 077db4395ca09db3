import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import bits, columns
from framewright.operators import allocation, blocks, codecs, frames, grid, mixing, timeline
from framewright.plans import jobs
from framewright.sinks import ordered
from framewright.sources import caf, events, streams

STREAMS = {
    "a": b"".join(frames.synthetic(n) for n in (8, 16, 4, 32, 6)),
    "b": b"\x01\x02\x03" + frames.synthetic(8) + b"\x10\x20" + frames.synthetic(6, 0xBB) + b"\x55",
    "d": b"\x09" + frames.synthetic(8) + b"\x11\x22" + frames.synthetic(32, 0xCC) + frames.synthetic(6, 0xBB),
    "cut": frames.synthetic(16) + frames.synthetic(32)[:20],
}


@pytest.mark.parametrize("name", STREAMS)
def test_scan_is_the_same_for_all_chunks(name):
    data = STREAMS[name]
    want = None
    for k in (1, 2, 7, 8, 13, 64, 1024):
        got = list(frames.scan(iter([data[i : i + k] for i in range(0, len(data), k)])))
        assert b"".join(x for _, _, x in got) == data
        found = [(o, x) for o, ok, x in got if ok]
        want = found if want is None else want
        assert found == want
    if name == "d":
        assert [o for o, _ in want] == [1, 11, 43]
    assert len(want) == {"a": 5, "b": 2, "d": 3, "cut": 1}[name]


def test_checksums_and_hex():
    assert bits.crc16(b"123456789") == 0xFEE8 and bits.crc32_bits(b"123456789", 72) == 0x89A1897F and bits.crc8_bits(b"123456789", 72) == 0x3E
    assert bits.key_bytes("00 ff 10") == b"\x00\xff\x10" and bits.hex_bytes("de ad") == b"\xde\xad"
    for bad in ("", "abc"):
        with pytest.raises(ValueError):
            bits.key_bytes(bad)


@pytest.mark.parametrize("v,n,b", [(0, 4, "00000"), (15, 4, "11110"), (16, 4, "0000100000"), (272, 4, "000010000100000"), (4367, 4, "111111111111110"), (255, 8, "111111110"), (3, 2, "110")])
def test_variable_bits(v, n, b):
    w = bits.BitWriter().variable(v, n)
    assert format(w.value, f"0{w.size}b") == b and bits.BitReader(w.bytes()).variable(n) == v
    assert bits.BitReader(b"\x80").read(12) == 0x800


def test_positions_and_protection():
    objects = [(2 * i / 12 - 1, 1 - 2 * i / 12, i / 12) for i in range(13)]
    buf = codecs.wrap([(11, codecs.encode_objects(objects, True))])
    d = codecs.decode_objects(codecs.walk(buf).payloads[0][1])
    assert buf[:2] == b"\x58\x38" and (d["object_count"], d["bed_count"]) == (14, 1)
    assert [o["px"] for o in d["objects"][1:]] == [0, 5, 10, 16, 21, 26, 31, 36, 41, 47, 52, 57, 62] == [o["py"] for o in d["objects"][1:]]
    assert [o["pz"] for o in d["objects"][1:]] == [0, 1, 3, 4, 5, 6, 8, 9, 10, 11, 13, 14, 15]
    assert codecs.verify(buf)["match"] and not codecs.verify(buf, codecs.Keyed(b"k"))["match"]
    a, b, c = (codecs.wrap([(11, b"x")], codecs.Keyed(k, 3)) for k in (b"\1\2\3\4", b"\1\2\3\4", b"\x09" * 4))
    assert a == b != c and codecs.walk(a).payloads == codecs.walk(c).payloads and codecs.walk(a).key_id == 3
    assert codecs.walk(buf[:-20]).truncated and codecs.walk(b"\0" * 8) is None


def test_matrices():
    rows, trees = [[1, 0, 0, 0, 0], [0, -0.5, 0.7, 0, 0.2], [0.3, 0.3, 0, 0.9, -9.5]], codecs.own_trees()
    data = codecs.encode_matrices(rows, 123, trees)
    d = codecs.decode_matrices(data, trees)
    assert (d["seq"], d["channels"], len(d["objects"]), d["error"]) == (123, 5, 3, None)
    for o, r in zip(d["objects"], rows, strict=True):
        for ch, want in zip(codecs.gains(o)[0], r, strict=True):
            assert len(ch) == 12 and all(abs(g - want) <= 0.05 + 1e-6 for g in ch)
    assert codecs.decode_matrices(data[:10], trees)["error"] and codecs.decode_matrices(b"\xff" * 9, trees)["error"]
    d5 = np.array([[1, 0, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 0.7, 0.7]])
    m = mixing.solve(d5, np.array([1, 0.25, 0.5]))
    assert np.allclose([m[0, 0], m[1, 2], m[2, 3]], [0.999652, 0.998610, 0.713779], atol=1e-5)


def head(size=256, addbsie=0):
    w = bits.BitWriter().write(0x0B77, 16).write(0, 5).write(size // 2 - 1, 11).write(0, 2).write(3, 2).write(7, 3).write(1, 1).write(16, 5)
    w.write(20, 5).write(0, 1).write(0, 1).write(0, 1).write(addbsie, 1)
    if addbsie:
        w.write(1, 6).write(0x01, 8).write(12, 8)
    return frames.sealed(w.write(0, 8 * size - w.size).bytes())


def test_rewriting():
    f = head()
    i = frames.info(f)
    assert i.addbsie_bit == 53 and i.end_bit == 54 and frames.info(frames.synthetic(64)) is None
    new = frames.inject_full(f, b"\x01\x0e", b"hello")
    assert frames.extension(new) == (True, 14) and frames.read_aux(new) == (b"hello", 40) and len(new) % 2 == 0
    assert bits.crc16(new[2:-2]).to_bytes(2, "big") == new[-2:] and frames.header(new).size == len(new)
    buf = codecs.wrap([(11, b"abc"), (14, b"d")])
    withit = frames.inject_full(f, b"\x01\x0e", buf)
    pos, got = codecs.find(withit, strict=True)
    assert got == buf
    small = codecs.wrap([(14, b"z")])
    spliced = frames.splice(withit, small, 9)
    assert codecs.walk(codecs.find(spliced)[1]).payloads == [(14, b"z")] and frames.extension(spliced)[1] == 9 and len(spliced) == len(withit)
    assert codecs.walk(codecs.find(frames.mutate(withit, key_id=5))[1]).key_id == 5
    assert not codecs.verify(codecs.find(frames.mutate(withit, corrupt_secondary=True))[1])["match"]
    assert frames.splice(f, small) is None and frames.mutate(f, 1) is None and frames.inject_aux(head(4096), b"x") is None
    skip = frames.inject_skip(f, b"\x01\x0e", buf, [70, 90, 110, 130, 150, 170], 60)
    assert codecs.find(skip)[1] == buf and len(skip) % 2 == 0 and frames.extension(skip) == (True, 14) and frames.info(skip).fields["infomdate"] == 1
    assert frames.inject_skip(f, b"\x01\x0e", buf, [50, 90, 110, 130, 150, 170], 60) is None and frames.inject_skip(f, b"", buf, [70] * 6, 60) is None


def test_jobs(spark):
    rows = [("s", i, head(128 + 2 * i)) for i in range(7)]
    t = spark.createDataFrame(rows, "stream_id string, frame_idx long, bytes binary").repartition(3)
    ev = spark.createDataFrame([(0, 1, 0, True, [0.0, 1.0, 0.0]), (1, 1, 3072, None, [1.0, 0.0, 0.5]), (2, None, 5, True, None), (3, 2, None, False, [1.0])], events.EVENT)
    got = jobs.inject_objects(t, ev, [1, 2])
    assert got.count() == 7 and got.where("not ok").count() == 0
    seen = codecs.positions(codecs.payloads(got)).where("obj = 1").orderBy("frame_idx").collect()
    assert [r["px"] for r in seen][:3] == [47, 62, 62]
    full = jobs.inject_all(t, jobs.frame_objects(jobs.starts_of(t), ev, [1, 2]), spark.createDataFrame([(0, [])], "frame_idx long, rows array<struct<d:array<double>,p:double>>"), codecs.own_trees())
    assert full.where("ok").count() == 7
    p = jobs.probe(full).collect()
    assert len(p) == 1 and (p[0]["n"], p[0]["oamd"], p[0]["joc"], p[0]["flag"]) == (7, 7, 7, 7)
    assert jobs.probe_matrices(full, codecs.own_trees()).where("error is null and objects = 2").count() == 7
    assert jobs.probe_headers(t).where("walked").count() == 7 and jobs.verify(full).where("match").count() == 7
    assert jobs.verify(jobs.mutate(full, corrupt_primary=True)).where("match").count() == 0
    grafted = jobs.graft(t, full.where("frame_idx < 3"))
    assert codecs.payloads(grafted).where("id = 14").count() == 7
    assert jobs.core_graft(full, full.where("frame_idx < 2"), 7).count() == 7
    assert jobs.dump_objects(codecs.payloads(full).where("frame_idx = 0")).where("field = 'x'").count() == 2
    assert frames.read_aux(jobs.inject_marker(t, b"mark").first()["bytes"])[0] == b"mark"
    assert {r["id"]: r["n"] for r in jobs.inspect(ev).collect()} == {1: 2, 2: 1}
    s = spark.createDataFrame([(0, 1, 1.0), (1536, 1, 1.0), (0, 9, 5.0)], "t long, id int, s double")
    mix = {r["t"]: r["mix"] for r in jobs.downmix(s, ev).collect()}
    assert set(mix) == {0, 1536} and mix[0][2] == pytest.approx(1.0)
    assert jobs.peaks(jobs.downmix(s, ev)).count() == 5


def test_timeline_edges(spark):
    k = spark.createDataFrame([("a", 10, 0, 1.0), ("a", 10, 1, 2.0), ("a", 20, 2, 4.0)], "id string, t long, seq long, v double")
    g = spark.createDataFrame([("a", 5), ("a", 10), ("a", 15), ("a", 25), ("b", 1)], "id string, t long")
    got = {(r["id"], r["t"]): r["v"] for r in timeline.interpolate(g, k, "id", "t", "v", "seq").collect()}
    assert got == {("a", 5): 1.0, ("a", 10): 2.0, ("a", 15): 3.0, ("a", 25): 4.0, ("b", 1): None}


def test_panning(spark):
    want = {(0.0, 0.0): [0, 0, 1, 0, 0], (0.0, 1.0): [0, 0, 1, 0, 0], (1.0, 0.0): [0, 0.382683, 0, 0, 0.92388], (-1.0, 0.0): [0.382683, 0, 0, 0.92388, 0], (0.0, -1.0): [0, 0, 0, 0.707107, 0.707107], (1.0, 1.0): [0, 0.95694, 0, 0, 0.290285], (1.0, -1.0): [0, 0, 0, 0.276836, 0.960917]}
    df = spark.createDataFrame(list(want), "x double, y double")
    for r in df.select("x", "y", columns.pan_vbap(F.col("x"), F.col("y")).alias("g")).collect():
        assert r["g"] == pytest.approx(want[r["x"], r["y"]], abs=1e-5)


def test_sources_and_sinks(spark, tmp_path):
    spark.dataSource.register(streams.StreamSource)
    spark.dataSource.register(caf.CafSource)
    path = tmp_path / "d.bin"
    path.write_bytes(STREAMS["d"])
    for per in (1, 2, 100):
        df = spark.read.format("frames").option("frames_per_task", per).load(str(path))
        assert [r["offset"] for r in df.orderBy("frame_idx").collect()] == [1, 11, 43]
    assert spark.read.format("frames").option("frame_start", 1).option("frame_end", 2).load(str(path)).first()["offset"] == 11
    pieces = streams.read_whole(spark, f"file://{path}")
    out = tmp_path / "o.bin"
    with out.open("wb") as f:
        ordered.write_ordered(pieces, "offset", "bytes", f)
    assert out.read_bytes() == STREAMS["d"]
    pcm = b"".join(struct.pack(">i", v << 8)[:3] for v in (1, -1, 8388607, -8388608))
    c = tmp_path / "x.caf"
    c.write_bytes(b"caff\0\1\0\0" + b"desc" + struct.pack(">q", 32) + struct.pack(">d4s5I", 48000.0, b"lpcm", 0, 6, 1, 2, 24) + b"data" + struct.pack(">q", -1) + b"\0" * 4 + pcm)
    row = spark.read.format("caf_pcm").load(str(c)).first()
    assert row["channels"] == 2 and np.allclose(caf.s24be(row["pcm"]), [2**-23, -(2**-23), 1 - 2**-23, -1])
    assert len(ordered.wav_header(6, 48000, 10)) == 58
    with pytest.raises(ValueError):
        ordered.wav_header(6, 48000, 1 << 30)
    m = events.manifest("version: 1\npresentations:\n- bedInstances:\n  - channels:\n    - {channel: lfe, ID: 3}\n  objects: [{ID: 10}]\n  other: x\n")
    assert events.only_lfe_bed(m) and events.layout(m) == [(0, 3, "bed", "lfe"), (1, 10, "object", None)]
    y = tmp_path / "e.yaml"
    y.write_text("events:\n- {ID: 1, samplePos: 5, pos: [0, 1, 0]}\n- {ID: 1, active: false}\n")
    assert [(r["seq"], r["sample_pos"], r["active"]) for r in events.read_events(spark, str(y)).collect()] == [(0, 5, None), (1, None, False)]


def test_streaming(spark, tmp_path):
    from framewright.streaming.frame_state import frames_of

    data = STREAMS["b"] + STREAMS["a"]
    src = tmp_path / "in"
    rows = [("s", n, data[i : i + 9]) for n, i in enumerate(range(0, len(data), 9))]
    spark.createDataFrame(rows, "stream_id string, seq long, data binary").orderBy("seq").coalesce(1).write.option("maxRecordsPerFile", 4).parquet(str(src))
    pieces = spark.readStream.schema("stream_id string, seq long, data binary").option("maxFilesPerTrigger", 100).parquet(str(src))
    q = frames_of(pieces).writeStream.format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = [r["offset"] for r in spark.table("got").orderBy("frame_idx").collect()]
    assert got == [o for o, ok, _ in frames.scan(iter([data])) if ok]


def test_allocation():
    t = allocation.standard_tables()
    assert allocation.ungroup(10, [62, 0], 1) == [10, 10, 10, 8, 6, 4]
    assert allocation.mantissa_bits([1, 1, 1, 2, 4, 4, 3], (0, 0, 0, 3, 0, 4)) == (3, (0, 1, 0))
    assert allocation.mantissa_bits([1, 1, 1, 2, 4, 4, 3]) == (5 + 7 + 7 + 3, (0, 1, 0))
    assert allocation.mantissa_bits([1, 1, 2, 4, 15], carried=(2, 0, 1)) == (5 + 7 + 0 + 16, (1, 1, 0))
    assert allocation.log_add(100, 100, (64, 0)) == 164 and allocation.low_compensation(0, 0, 256, 3) == 384
    assert (t.log_add[:3], t.log_add[209:211]) == ((64, 63, 62), (1, 0)) and len(t.band_of_bin) == 253 and [len(h) for h in t.hearing] == [50] * 3 and len(t.pointer) == 64
    assert allocation.frame_strategies(0) == [1, 0, 0, 0, 0, 0] and allocation.frame_strategies(8) == [2, 0, 1, 0, 0, 0] and allocation.frame_strategies(31) == [3] * 6
    assert [allocation.groups_of(76, s) for s in (1, 2, 3)] == [25, 13, 7] and allocation.groups_of(7, 1) == 2
    assert math.isclose(mixing.solve(np.eye(5), np.ones(5))[0, 0], 1 / 1.001, rel_tol=1e-3)


def test_excitation_by_hand():
    """Flat bands: the first rise is at band 2, from band 3 on both decays run; silence lies below the hearing threshold."""
    t = allocation.standard_tables()
    flat = [3072 - (4 << 7)] * 39
    e = allocation.excitation(flat, t)
    assert e[:3] == [flat[0] - 0x280] * 3 and e[3:] == [flat[0] - 0x280] * 36
    falling = [3000 - 300 * k for k in range(7)]
    comp = 0
    for b, got in enumerate(allocation.excitation(falling, t)):
        assert got == falling[b] - 0x280 - comp
    drop = [3000] * 4 + [0] * 35
    assert allocation.excitation(drop, t)[4] == max(3000 - 0x280 - 0x53, 3000 - 0x4D8 - 0x13)
    assert set(allocation.allocate([24] * 73, 0, 0, t)) == {0} and set(allocation.allocate([0] * 73, 960, 0, t)) != {0}
    rise = [1000, 1256] + [1000] * 5
    assert allocation.excitation(rise, t)[0] == 1000 - 0x280 - 384


def core(seed, strategy_codes=(8, 0, 31, 21, 2), flagged=False, csnr=9, junk=0, width=20):
    """A frame of six blocks of random exponents and mantissas, and its skip points, written field by field."""
    rng = np.random.default_rng(seed)
    t = allocation.standard_tables()
    bit = lambda n: int(rng.integers(0, 1 << n))
    w = bits.BitWriter().write(0x0B77, 16).write(0, 5).write(0, 11).write(0, 2).write(3, 2).write(7, 3).write(1, 1).write(16, 5)
    w.write(20, 5).write(0, 4)  # loudness; no compression, mixing, information or additional data
    w.write(0, 5).write(1, 1).write(0, 1).write(0, 1).write(0, 1).write(0, 1).write(int(flagged), 1).write(0, 1)  # block switches on
    w.write(0, 6)
    for c in strategy_codes:
        w.write(c, 5)
    w.write(0b100100, 6).write(bit(25), 25).write(csnr, 6).write(3 if csnr else 0, 4).write(0, 1)
    points, exps, low = [], [None] * 5, None
    strategies = [allocation.frame_strategies(c) for c in strategy_codes]
    for k in range(6):
        w.write(bit(5), 5).write(1, 1).write(bit(8), 8)
        w.write(0, 1)  # spectral extension: not in use (first block), no new strategy (others)
        new = [ch for ch in range(5) if strategies[ch][k]]
        for _ in new:
            w.write(width, 6)
        end = 3 * (width + 12) + 37
        for ch in new:
            step = {1: 1, 2: 2, 3: 4}[strategies[ch][k]]
            first, groups = 8, [int(rng.choice([62, 37, 87])) for _ in range(math.ceil((end - 1) / 3 / step))]
            w.write(first, 4)
            for g in groups:
                w.write(g, 7)
            w.write(bit(2), 2)
            exps[ch] = [first, *allocation.ungroup(first, groups, step)][:end]
        if k in (0, 3):
            w.write(6, 4).write(62, 7).write(62, 7)
            low = [6] * 7
        w.write(k % 2, 1)
        if k % 2:
            w.write(bit(10), 10)
        points.append(w.size)
        if flagged:
            w.write(int(k == 1), 1)
            if k == 1:
                w.write(3, 9).write(bit(24), 24)
        sizes = []
        for e in [*exps, low] if csnr else []:  # no offsets, no mantissas
            sizes += allocation.allocate(e, ((csnr - 15) * 16 + 3) * 4, 0, t)
        n = sum(5 * (-(-sizes.count(1) // 3)) if p == 1 else 7 * (-(-sizes.count(2) // 3)) if p == 2 else 7 * (-(-sizes.count(4) // 2)) if p == 4 else sizes.count(p) * b for p, b in enumerate(t.mantissa_bits))
        for _ in range(n // 16):
            w.write(bit(16), 16)
        w.write(0, n % 16)
    end_bit = w.size
    size = 2 * math.ceil((end_bit + 18) / 16) + junk
    return frames.sealed(w.write(0, 8 * size - w.size).bytes()), points, end_bit


@pytest.mark.parametrize("seed,flagged,width,csnr", [(1, False, 20, 9), (2, True, 20, 9), (3, False, 7, 12), (4, False, 48, 6), (5, False, 20, 0)])
def test_block_walk(seed, flagged, width, csnr):
    f, points, end = core(seed, flagged=flagged, width=width, csnr=csnr)
    seen = blocks.walk(f)
    assert (seen.unsupported, seen.points, seen.end_bit, seen.flagged) == (None, points, end, flagged)


def test_block_walk_refuses_and_carries():
    f, points, end = core(7)
    buf = codecs.wrap([(11, b"abc"), (14, b"d")])
    new, how = blocks.carry(f, b"\x01\x0e", buf)
    after = blocks.walk(new)
    assert how == "skip" and codecs.find(new)[1] == buf and frames.extension(new) == (True, 14) and frames.header(new).size == len(new)
    # an information block of nine bits, and a length of six and two bytes of additional information
    assert after.unsupported is None and after.flagged and after.points[0] == points[0] + 9 + 6 + 16
    assert after.end_bit == end + 9 + 6 + 16 + 6 + 9 + 8 * len(buf)
    assert bits.get_bits(new, after.points[5] + 1, end - points[5]) == bits.get_bits(f, points[5], end - points[5])
    assert blocks.carry(new, b"\x01\x0e", buf)[1] == "aux only" and blocks.carry(core(7, flagged=True)[0], b"\x01\x0e", buf)[1] == "aux"
    assert blocks.walk(f[:200] + f[-2:]).unsupported == "length" and blocks.walk(frames.synthetic(64)).unsupported and blocks.walk(f[:60]).unsupported
    assert blocks.carry(f, b"\x01\x0e", b"x" * 600)[1] == "aux" and blocks.carry(head(4096), b"\x01\x0e", buf) is None


def test_walk_job(spark):
    made = [core(s) for s in range(4)]
    t = spark.createDataFrame([("s", k, f) for k, (f, _, _) in enumerate(made)] + [("s", 4, frames.synthetic(64))], "stream_id string, frame_idx long, bytes binary")
    got = {r["frame_idx"]: r for r in jobs.walk_blocks(t).collect()}
    assert all(got[k]["skip_points"] == p and got[k]["end_bit"] == e for k, (_, p, e) in enumerate(made))
    assert got[4]["unsupported_reason"] and got[4]["exact"] is None and all(got[k]["exact"] == (e == 8 * len(f) - 18) for k, (f, _, e) in enumerate(made))
    ev = spark.createDataFrame([(0, 1, 0, True, [0.0, 1.0, 0.0])], events.EVENT)
    full = jobs.inject_all(t, jobs.frame_objects(jobs.starts_of(t), ev, [1]), spark.createDataFrame([(0, [])], "frame_idx long, rows array<struct<d:array<double>,p:double>>"), codecs.own_trees())
    assert [r["carriage"] for r in full.orderBy("frame_idx").collect()] == ["skip"] * 4 + ["aux only"] and full.where("ok").count() == 5


def test_object_metadata_by_bits():
    """Two elements, the first of two blocks with a long and a short ramp; a second block with masks of status 3."""
    w = bits.BitWriter
    one = w().write(0, 2).write(1, 3).write(5, 6).write(3, 2).write(1, 1).write(9, 4).write(6, 6).write(3, 2).write(0, 1).write(1000, 11).write(1, 1)
    bed = lambda e: e.write(0, 1).write(0, 2).write(1, 1).write(0, 1)
    bed(one)  # the LFE, block 0
    one.write(0, 1).write(3, 2).write(2, 2).write(1, 2).write(0, 1)  # block 1: status 3, mask 2: the gain index alone
    one.write(0, 1).write(2, 2).write(33, 6).write(0, 1).write(17, 5)  # an object, block 0: gain, priority
    one.write(31, 6).write(62, 6).write(1, 1).write(7, 4).write(1, 1).write(0, 1).write(4, 4).write(1, 4).write(2, 2).write(555, 15).write(1, 1).write(5, 3).write(2, 2).write(1, 1).write(0, 1)
    one.write(0, 1).write(0, 2).write(3, 2).write(5, 4).write(1, 1).write(1, 3).write(2, 3).write(3, 3).write(0, 1).write(1, 2).write(21, 5).write(0, 1)  # block 1: no basic group, mask 5: difference, size; snap
    one.write(1, 1).write(1, 4).write(0xABCD, 16)  # more bytes
    two = w().write(0, 2).write(0, 3).write(0, 6).write(2, 2).write(1, 1)
    bed(two)
    two.write(1, 1).write(0, 1)  # not active
    m = w().write(0, 2).count5(1).write(1, 1).write(1, 1).write(0, 1).write(2, 4)
    for e in (one, two):
        # a size counts the bits after it, the discard flag's too
        m.write(1, 4).variable(e.size, 4).write(0, 1).write(e.value, e.size)
    d = codecs.decode_objects(m.bytes())
    got = [(n, v) for o, b, n, v in d["fields"]]
    assert [v for n, v in got if n == "ramp_duration"] == [9, 1000]
    named = {(o, b, n): v for o, b, n, v in d["fields"]}
    assert (named[0, 1, "basic_mask"], named[0, 1, "gain_idx"]) == (2, 1) and (0, 1, "default_priority") not in named
    assert (named[1, 0, "gain"], named[1, 0, "priority"], named[1, 0, "distance_factor"], named[1, 0, "size"], named[1, 0, "screen_factor"], named[1, 0, "snap"]) == (33, 17, 4, 555, 5, 0) or named[1, 0, "inactive"] == 1
    assert [v for n, v in got if n in ("dx", "dy", "dz", "render_mask", "extra_bytes")] == [5, 1, 2, 3, 0xABCD]
    assert [(o["obj"], o["block"], o["px"], o["py"], o["pz"]) for o in d["objects"]] == [(0, 0, None, None, None), (0, 1, None, None, None), (1, 0, 31, 62, 7), (1, 1, None, None, None), (0, 0, None, None, None), (1, 0, None, None, None)]
    own = codecs.encode_objects([(0.0, 0.0, 0.0)] * 3, True)
    sized = bits.BitReader(own, 2 + 5 + 3 + 4 + 4).variable(4) + 1
    assert sized == 14 + 5 + 3 * (4 + 17 + 1 + 4 + 2 + 1 + 1 + 1)  # in bits


def test_numbered(spark):
    n = 1_000_000
    d = spark.range(0, n, 1, 16).select(F.expr("id * 7 + id % 2").alias("k"), "id").repartition(16)
    got = grid.numbered(d, "k", "i", bucket=50_000)
    assert got.where("i = id").count() == n
    rows = [("a", 5), ("a", 9), ("b", 1), ("b", 2), ("b", 7), (None, 3)]
    some = grid.numbered(spark.createDataFrame(rows, "s string, k long"), "k", "i", by="s", bucket=1).collect()
    assert {(r["s"], r["k"]): r["i"] for r in some} == {("a", 5): 0, ("a", 9): 1, ("b", 1): 0, ("b", 2): 1, ("b", 7): 2, (None, 3): 0}
    assert grid.numbered(spark.range(0), "id", "i").count() == 0
    r = spark.createDataFrame([(10, "x"), (20, "y"), (30, "z")], "j long, v string")
    big = {x["k"]: x["v"] for x in grid.cycle_join(d.where("id < 7"), "k", r, "j").collect()}
    assert [big[k] for k in sorted(big)] == list("xyzxyzx")
    assert grid.cycle_join(d, "k", r.limit(0), "j").count() == 0 and grid.cycle_join(d.limit(3), "k", r.limit(0), "j", how="left").count() == 3


def test_neighbours(spark):
    """Against brute force, with ties, keys without keyframes and a long timeline of one key."""
    keys = [("a", 5, 1.0, 0), ("a", 5, 2.0, 1), ("a", 9, 3.0, 2), ("b", 0, 7.0, 3)]
    at = [("a", t) for t in range(0, 12)] + [("b", 0), ("b", 4), ("c", 1)]
    got = timeline.neighbours(spark.createDataFrame(at, "id string, t long"), spark.createDataFrame(keys, "id string, t long, v double, seq long"), "id", "t", "v", "seq")
    for r in got.collect():
        own = sorted((t, s, v) for i, t, v, s in keys if i == r["id"])
        before, after = [x for x in own if x[0] <= r["t"]], [x for x in own if x[0] > r["t"]]
        assert (r["t0"], r["v0"]) == ((before[-1][0], before[-1][2]) if before else (None, None))
        assert (r["t1"], r["v1"]) == ((after[0][0], after[0][2]) if after else (None, None))
    n = 200_000
    many = spark.range(n).selectExpr("'k' as id", "id * 2 as t", "cast(id as double) as v", "id as seq")
    line = timeline.interpolate(spark.range(n).selectExpr("'k' as id", "id * 2 + 1 as t"), many, "id", "t", "v", "seq")
    assert line.where("abs(v - least((t) / 2, 199999)) > 1e-6").count() == 0 and line.count() == n


def test_two_streams(spark):
    """D5, D6, D9, D10 and the reports keep the frames of streams apart."""
    t = spark.createDataFrame([(s, i, head(128 + 2 * i)) for s in "ab" for i in range(5)], "stream_id string, frame_idx long, bytes binary").repartition(3)
    ev = spark.createDataFrame([(0, 1, 0, True, [0.0, 1.0, 0.0])], events.EVENT)
    objects = jobs.frame_objects(jobs.starts_of(t), ev, [1])
    assert objects.count() == 10 and objects.where("size(objects) = 1").count() == 10
    got = jobs.inject_objects(t, ev, [1])
    assert got.count() == 10 and got.where("ok").count() == 10 and codecs.positions(codecs.payloads(got)).select("stream_id", "frame_idx").distinct().count() == 10
    gains = spark.createDataFrame([("a", 0, [([1.0, 0.0, 0.0, 0.0, 0.0], 1.0)]), ("b", 0, [([0.0, 1.0, 0.0, 0.0, 0.0], 1.0)])], "stream_id string, frame_idx long, rows array<struct<d:array<double>,p:double>>")
    full = jobs.inject_all(t, objects, gains, codecs.own_trees())
    assert full.count() == 10 and full.where("ok").count() == 10
    first = {r["stream_id"]: r["ch"] for r in codecs.matrices(codecs.payloads(full), codecs.own_trees()).where("frame_idx = 0 and band = 0 and code > 5 and code < 100").collect()}
    assert first == {"a": 0, "b": 1}
    donors = full.where("frame_idx < 3 and (stream_id = 'a' or frame_idx < 2)")
    grafted = jobs.graft(t, donors)
    assert grafted.count() == 10 and codecs.payloads(grafted).where("id = 14").count() == 10
    assert jobs.graft(t, donors.where("stream_id = 'a'")).count() == 10
    assert jobs.core_graft(full, full.where("frame_idx < 2"), 7).count() == 10
    assert {(r["stream_id"], r["n"]) for r in jobs.probe(full).collect()} == {("a", 5), ("b", 5)}
    assert jobs.verify(full).where("match").groupBy("stream_id").count().count() == 2
