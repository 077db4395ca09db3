"""Schemas and fixed values of the frame formats."""

from __future__ import annotations

#: Fixed values of the formats.
BLOCKS = (1, 2, 3, 6)
SAMPLE_RATES = (48000, 44100, 32000, 0)
FULL_CHANNELS = (2, 1, 2, 3, 3, 4, 4, 5)
LAYOUTS = ("2/0", "1/0", "2/0", "3/0", "2/1", "3/1", "2/2", "3/2")
RING = (-110.0, -30.0, 0.0, 30.0, 110.0)
FRAME_SYNC, CONTAINER_SYNC = 0x0B77, 0x5838
OAMD_ID, JOC_ID = 11, 14
PROTECTION_BITS = (0, 8, 32, 128)
JOC_BANDS = (1, 3, 5, 7, 9, 12, 15, 23)
JOC_CHANNELS = {0: 5, 1: 7, 2: 7, 3: 5, 4: 7}

FRAME = "stream_id string, frame_idx long, offset long, size int, strmtyp int, substreamid int, blocks int, fscod int, sample_rate int, acmod int, lfe boolean, bsid int, bytes binary"
EVENT = "seq long, id int, sample_pos long, active boolean, pos array<double>"
MANIFEST = "version string, presentations array<struct<metadata:string,audio:string,bed_instances:array<struct<channels:array<struct<channel:string,id:int>>>>,objects:array<struct<id:int>>>>"
PCM = "block_start long, channels int, pcm binary"
OBJECT = "px int, py int, up boolean, pz int, is_bed boolean"
