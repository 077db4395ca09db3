"""The jobs, as plans over frame tables ``(stream_id, frame_idx, bytes)``, events and samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import columns as C
from framewright.operators import allocation, blocks, codecs, frames, grid, mixing, timeline
from framewright.operators.codecs import mapped
from framewright.schemas import JOC_ID, OAMD_ID


def inspect(events: DataFrame) -> DataFrame:
    """Events per element, last position, and which elements move."""
    e = timeline.events(events)
    return e.groupBy("id").agg(F.count("*").alias("n"), F.max("sample_pos").alias("last"), F.count_if(F.col("pos").isNotNull()).alias("positions")).withColumn("moves", F.col("n") > 1)


def object_gains(events: DataFrame) -> DataFrame:
    """Keyframes of gains; an inactive object is silent."""
    e = timeline.forward_fill(timeline.events(events).withColumns({"x": F.col("pos")[0], "y": F.col("pos")[1]}), "id", "seq", {"x": 0.0, "y": 0.0, "active": True})
    g = F.when(F.col("active"), C.pan_vbap(F.col("x"), F.col("y"))).otherwise(F.array(*[F.lit(0.0)] * 5))
    return e.select("id", "seq", F.col("sample_pos").alias("t"), g.alias("gains"))


def downmix(samples: DataFrame, events: DataFrame, gain_db: float = 0.0) -> DataFrame:
    """``(t, mix)`` of samples ``(t, id, s)``: gains interpolated at each sample, objects without events left out."""
    at = samples.select("id", "t", "s")
    got = timeline.interpolate_vector(at, object_gains(events), "id", "t", "gains", "seq")
    g = float(10 ** (gain_db / 20))
    return got.groupBy("t").agg(F.array(*(F.sum(F.col("s") * F.col("gains")[c]) * F.lit(g) for c in range(5))).alias("mix"))


def peaks(mix: DataFrame) -> DataFrame:
    """Peak and level per channel."""
    p = mix.select(*(F.abs(F.col("mix")[c]).alias(f"c{c}") for c in range(5))).agg(*(F.max(f"c{c}").alias(f"c{c}") for c in range(5)))
    return p.select(F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"c{c}").alias("peak"), C.linear_to_db(F.col(f"c{c}")).alias("dbfs")) for c in range(5)))).alias("r")).select("r.*")


def probe(table: DataFrame) -> DataFrame:
    """D3: frames, sizes and signalling by stream, type and substream."""

    def row(idx, data):
        ext, got, aux = frames.extension(data), codecs.find(data), frames.read_aux(data)
        kinds = [k for k, _ in codecs.walk(got[1]).payloads] if got else []
        return [(idx, data, ext is not None and ext[0], aux is not None, OAMD_ID in kinds, JOC_ID in kinds, "bits" if got and got[0] % 8 else "bytes" if got else None)]

    seen = mapped(table, "frame_idx long, bytes binary, flag boolean, aux boolean, oamd boolean, joc boolean, carriage string", row, "frame_idx", "bytes", streams=True)
    return frames.headers(seen).groupBy(*(c for c in ("stream_id",) if c in seen.columns), "strmtyp", "substreamid").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), *(F.count_if(c).alias(c) for c in ("flag", "aux", "oamd", "joc")), F.sum(F.when(F.col("strmtyp") == 0, F.col("blocks") * 256)).alias("samples")
    )


def inject_marker(table: DataFrame, marker: bytes) -> DataFrame:
    """A marker in every frame's aux field."""
    return frames.transformed(table, lambda h, n, data: frames.inject_aux(data, marker))


def frame_objects(starts: DataFrame, events: DataFrame, ids: list[int]) -> DataFrame:
    """Every object's position at the end of each frame of each stream; no events: the origin."""
    objects = F.explode(F.array(*(F.struct(F.lit(k).alias("obj"), F.lit(i).alias("id")) for k, i in enumerate(ids))))
    at = starts.select("*", objects.alias("_o")).select("*", "_o.obj", "_o.id").select("stream_id", "frame_idx", "obj", "id", (F.col("start") + F.col("samples")).alias("t"))  # a handful of objects
    e = timeline.events(events)
    filled = e.withColumns({f"p{k}": F.col("pos")[k] for k in range(3)})
    filled = timeline.forward_fill(filled, "id", "seq", {f"p{k}": 0.0 for k in range(3)})
    keys = filled.select("id", "seq", F.col("sample_pos").alias("t"), F.array("p0", "p1", "p2").alias("pos"))
    got = timeline.interpolate_vector(at, keys, "id", "t", "pos", "seq", none=[0.0, 0.0, 0.0])
    return got.groupBy("stream_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("obj", "pos"))).alias("objects"))


def starts_of(table: DataFrame) -> DataFrame:
    """W2 of a frame table, from headers alone."""
    h = frames.headers(table).select("stream_id", "frame_idx", (F.col("strmtyp") == 0).alias("independent"), (F.col("blocks") * 256).alias("samples"))
    return grid.starts(h, "stream_id", "frame_idx", "independent", "samples")


def inject_objects(table: DataFrame, events: DataFrame, ids: list[int], protector=None) -> DataFrame:
    """Each frame with a container of its objects' positions in the aux field, and whether it reads back."""
    both = table.join(frame_objects(starts_of(table), events, ids), ["stream_id", "frame_idx"], "left")

    def row(sid, idx, data, objects):
        pos = [tuple(o["pos"]) for o in objects or []]
        new = frames.inject_aux(data, codecs.wrap([(OAMD_ID, codecs.encode_objects(pos, True))], protector))
        got = codecs.walk(frames.read_aux(new)[0]) if new else None
        return [(sid, idx, new or data, bool(got and codecs.decode_objects(got.payloads[0][1])["object_count"] == len(pos) + 1))]

    return mapped(both, "stream_id string, frame_idx long, bytes binary, ok boolean", row, "stream_id", "frame_idx", "bytes", "objects")


def inject_all(table: DataFrame, objects: DataFrame, gains: DataFrame, trees: codecs.Trees, protector=None, tables: allocation.Tables | None = None) -> DataFrame:
    """Positions ``([stream_id,] frame_idx, objects)`` and gains with powers ``([stream_id,] frame_idx, rows[d, p])`` solved, encoded and put into each frame.

    Tables without a ``stream_id`` hold for the frames of all streams.

    ``carriage`` tells where: ``skip`` (the third block's skip field), ``aux`` or ``aux only`` (the frame's end,
    with or without the flag in its additional information), ``none`` (too long; the frame is as it was).
    """
    by = lambda t: [c for c in ("stream_id", "frame_idx") if c in t.columns]
    both = table.join(objects, by(objects), "left").join(gains, by(gains), "left")

    def row(sid, idx, data, objs, rows):
        pos = [tuple(o["pos"]) for o in objs or []]
        m = mixing.solve(np.array([r["d"] for r in rows]), np.array([r["p"] for r in rows])).tolist() if rows else [[0.0] * 5] * max(1, len(pos))
        buf = codecs.wrap([(OAMD_ID, codecs.encode_objects(pos, True)), (JOC_ID, codecs.encode_matrices(m, idx, trees)), (2, b"\x04\x94\x80"), (1, b"\x02\x00")], protector)
        new, how = blocks.carry(data, bytes([1, min(len(pos) + 1, 16)]), buf, tables=tables) or (data, "none")
        back = codecs.find(new) if how != "none" else None
        return [(sid, idx, new, bool(back and len(codecs.walk(back[1]).payloads) == 4), len(buf), how)]

    return mapped(both, "stream_id string, frame_idx long, bytes binary, ok boolean, metadata_bytes int, carriage string", row, "stream_id", "frame_idx", "bytes", "objects", "rows")


def probe_matrices(table: DataFrame, trees: codecs.Trees) -> DataFrame:
    """Matrices per frame: sequence, objects, errors (first errors: order by frame_idx and limit)."""

    def row(idx, data):
        got = codecs.find(data)
        for k, p in codecs.walk(got[1]).payloads if got else []:
            if k == JOC_ID:
                d = codecs.decode_matrices(p, trees)
                return [(idx, d["seq"], d["channels"], len(d["objects"]), d["error"])]
        return []

    return mapped(table, "frame_idx long, seq int, channels int, objects int, error string", row, "frame_idx", "bytes", streams=True)


def walk_blocks(table: DataFrame, tables: allocation.Tables | None = None) -> DataFrame:
    """Each frame's skip points, and whether its last block ends where the frame's tail begins; null if the walk stopped."""

    def row(idx, data):
        seen = blocks.walk(data, tables)
        return [(idx, seen.points, seen.end_bit, None if seen.end_bit is None else seen.end_bit == 8 * len(data) - 18, seen.unsupported)]

    return mapped(table, "frame_idx long, skip_points array<int>, end_bit int, exact boolean, unsupported_reason string", row, "frame_idx", "bytes", streams=True)


def probe_headers(table: DataFrame) -> DataFrame:
    """The stream information and audio header of each frame, and why a frame is outside the subset."""

    def row(idx, data):
        i, a = frames.info(data), frames.audio_header(data)
        return [(idx, i is not None, None if i is None else i.addbsie_bit, None if i is None else i.end_bit, None if a is None else a.get("unsupported"), None if i is None else sorted(i.fields.items()))]

    return mapped(table, "frame_idx long, walked boolean, addbsie_bit int, end_bit int, unsupported_reason string, fields array<struct<name:string,value:bigint>>", lambda *x: [(*r[:-1], r[-1] and [{"name": n, "value": v} for n, v in r[-1]]) for r in row(*x)], "frame_idx", "bytes", streams=True)


def graft(core: DataFrame, reference: DataFrame) -> DataFrame:
    """Containers of the reference's frames that have matrices, over and over, into the core's frames of the same stream; gaps go.

    To pair files, give their streams one id. Frames of a stream without such a container stay as they are.
    """

    def has(idx, data):
        got = codecs.find(data)
        return [(idx, got[1])] if got and any(k == JOC_ID for k, _ in codecs.walk(got[1]).payloads) else []

    donors = mapped(reference, "ref_idx long, container binary", has, "frame_idx", "bytes", streams=True)
    both = grid.cycle_join(core.select("stream_id", "frame_idx", "bytes"), "frame_idx", donors, "ref_idx", by="stream_id", how="left")

    def row(sid, idx, data, buf):
        new = blocks.carry(data, b"\x01\x10", buf) if buf else None
        return [(sid, idx, new[0] if new else data)]

    return mapped(both, "stream_id string, frame_idx long, bytes binary", row, "stream_id", "frame_idx", "bytes", "container")


def core_graft(core: DataFrame, donor: DataFrame, complexity: int | None = None) -> DataFrame:
    """Frame i's container from frame i of the donor's same stream; where it doesn't go, the core's frame as it is."""
    both = core.select("stream_id", "frame_idx", "bytes").join(donor.select("stream_id", "frame_idx", F.col("bytes").alias("other")), ["stream_id", "frame_idx"], "left")

    def row(sid, idx, data, other):
        got = codecs.find(other) if other else None
        return [(sid, idx, (frames.splice(data, got[1], complexity) if got else None) or data)]

    return mapped(both, "stream_id string, frame_idx long, bytes binary", row, "stream_id", "frame_idx", "bytes", "other")


def dump_objects(payload: DataFrame) -> DataFrame:
    """Every field of each payload of positions."""
    return codecs.oamd_fields(payload)


def verify(table: DataFrame, protector=None) -> DataFrame:
    """Protection of each frame's container."""
    return codecs.verified(table, protector)


def mutate(table: DataFrame, key_id: int | None = None, corrupt_primary: bool = False, corrupt_secondary: bool = False) -> DataFrame:
    """Container fields changed in place, sizes and gaps kept."""
    return frames.transformed(table, lambda h, n, data: frames.mutate(data, key_id, corrupt_primary, corrupt_secondary))
