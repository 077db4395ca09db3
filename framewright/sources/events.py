"""Manifests and event lists in YAML. Unknown fields are ignored; list order is kept as ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.operators.codecs import mapped
from framewright.schemas import EVENT, MANIFEST


def _yaml(text: str):
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    return yaml.safe_load(text) or {}


def manifest(text: str) -> dict:
    d = _yaml(text)
    channel = lambda c: {"channel": c.get("channel"), "id": c.get("ID")}
    return {
        "version": None if d.get("version") is None else str(d["version"]),
        "presentations": [
            {
                "metadata": p.get("metadata"), "audio": p.get("audio"),
                "bed_instances": [{"channels": [channel(c) for c in b.get("channels") or []]} for b in p.get("bedInstances") or []],
                "objects": [{"id": o.get("ID")} for o in p.get("objects") or []],
            }
            for p in d.get("presentations") or []
        ],
    }


def events(text: str) -> list[tuple]:
    """(seq, id, sample_pos, active, pos) per event; what an event doesn't carry is null."""
    out = []
    for seq, e in enumerate(_yaml(text).get("events") or []):
        pos = e.get("pos")
        out.append((seq, e.get("ID"), e.get("samplePos"), e.get("active"), [float(v) for v in pos] if isinstance(pos, list) else None))
    return out


def layout(m: dict) -> list[tuple[int, int, str, str | None]]:
    """(essence channel, id, kind, channel label): bed channels in order, then objects; a later equal id wins."""
    p = m["presentations"][0]
    rows = [(c["id"], "bed", c["channel"]) for b in p["bed_instances"] for c in b["channels"]] + [(o["id"], "object", None) for o in p["objects"]]
    last = {i: n for n, (i, _, _) in enumerate(rows)}
    return [(n, i, kind, label) for n, (i, kind, label) in enumerate(rows) if last[i] == n]


def only_lfe_bed(m: dict) -> bool:
    """Exactly one bed channel, and it is the LFE (in any case of letters)."""
    labels = [c["channel"] for b in m["presentations"][0]["bed_instances"] for c in b["channels"]]
    return len(labels) == 1 and (labels[0] or "").lower() == "lfe"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).selectExpr("value")
    return mapped(texts, MANIFEST, lambda t: [(m["version"], m["presentations"]) for m in (manifest(t),)], "value")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).selectExpr("value")
    return mapped(texts, EVENT, events, "value")
