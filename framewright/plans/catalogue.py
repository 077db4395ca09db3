"""Queries of the object-stream operators over the driver's tables, each with its SQL oracle.

``events`` stand for a diff-encoded event list (user = element, ts = sample position, type = which field an event
carries), ``embeddings`` for sample and gain vectors, ``lineitem`` for frame headers, texts for frames of bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import columns as C
from framewright.operators import grid, mixing, timeline

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type", "value"
    )


_EV = "SELECT event_id AS seq, user_id AS id, epoch_us(ts) AS t, event_type, value FROM events"


@query(
    f"""WITH e AS ({_EV}), c AS (SELECT *, CASE WHEN event_type IN ('click','view') THEN value END AS x, CASE WHEN event_type IN ('purchase','signup') THEN value END AS y FROM e)
    SELECT seq, id, t, coalesce(last_value(x IGNORE NULLS) OVER w, 0::double) AS x, coalesce(last_value(y IGNORE NULLS) OVER w, 0::double) AS y
    FROM c WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def ffill_state(spark, sf_dir):
    """State of each element after each event of a diff-encoded list."""
    e = _events(spark, sf_dir)
    e = e.withColumns({"x": F.when(F.col("event_type").isin("click", "view"), F.col("value")), "y": F.when(F.col("event_type").isin("purchase", "signup"), F.col("value"))})
    return timeline.forward_fill(e, "id", "seq", {"x": 0.0, "y": 0.0}).select("seq", "id", "t", "x", "y")


_STEP = 21_600_000_000


@query(
    f"""WITH k AS ({_EV}), b AS (SELECT min(t) AS lo FROM k), ids AS (SELECT DISTINCT id FROM k),
    g AS (SELECT id, lo + i * {_STEP} AS t FROM ids, b, range(120) r(i)),
    p AS (SELECT g.id, g.t, k.t AS t0, k.value AS v0 FROM g ASOF LEFT JOIN k ON g.id = k.id AND g.t >= k.t),
    q AS (SELECT p.*, k.t AS t1, k.value AS v1 FROM p ASOF LEFT JOIN k ON p.id = k.id AND p.t < k.t)
    SELECT id, t, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ((t - t0)::double / (t1 - t0)) END, 6) AS v FROM q"""
)
def asof_interp(spark, sf_dir):
    """Keyframes interpolated on a grid; first and last hold."""
    k = _events(spark, sf_dir).select("id", "t", "seq", F.col("value").alias("v"))
    lo = k.agg(F.min("t").alias("lo"))
    g = k.select("id").distinct().join(F.broadcast(lo)).select("id", F.explode(F.sequence(F.col("lo"), F.col("lo") + F.lit(119 * _STEP), F.lit(_STEP))).alias("t"))
    return timeline.interpolate(g, k, "id", "t", "v", "seq").select("id", "t", F.round("v", 6).alias("v"))


_PAN = """SELECT {key}, round(l, 6) AS g_l, round(r, 6) AS g_r, round(c, 6) AS g_c, round(ls, 6) AS g_ls, round(rs, 6) AS g_rs FROM (SELECT {key},
    CASE WHEN s = 2 THEN cos(f) WHEN s = 1 THEN sin(f) ELSE 0::double END AS l, CASE WHEN s = 3 THEN sin(f) WHEN s = 4 THEN cos(f) ELSE 0::double END AS r,
    CASE WHEN s = 0 THEN 1::double WHEN s = 2 THEN sin(f) WHEN s = 3 THEN cos(f) ELSE 0::double END AS c,
    CASE WHEN s = 1 THEN cos(f) WHEN s = 5 THEN sin(f) ELSE 0::double END AS ls, CASE WHEN s = 4 THEN sin(f) WHEN s = 5 THEN cos(f) ELSE 0::double END AS rs
    FROM (SELECT {key}, s, pi() / 2 * CASE s WHEN 1 THEN (az + 110) / 80 WHEN 2 THEN (az + 30) / 30 WHEN 3 THEN az / 30 WHEN 4 THEN (az - 30) / 80 ELSE (CASE WHEN az >= 110 THEN az - 110 ELSE az + 250 END) / 140 END AS f
    FROM (SELECT {key}, az, CASE WHEN az IS NULL THEN 0 WHEN az BETWEEN -110 AND -30 THEN 1 WHEN az BETWEEN -30 AND 0 THEN 2 WHEN az BETWEEN 0 AND 30 THEN 3 WHEN az BETWEEN 30 AND 110 THEN 4 ELSE 5 END AS s
    FROM (SELECT {key}, CASE WHEN x = 0 AND y = 0 THEN NULL ELSE degrees(atan2(x, y)) END AS az FROM {rows}))))"""


@query(_PAN.format(key="vec_id", rows="(SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings)"))
def vbap_pan(spark, sf_dir):
    """M1: constant-power pairwise pan on the ring."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    g = C.pan_vbap(F.col("x"), F.col("y"))
    return e.select("vec_id", *(F.round(g[i], 6).alias(n) for i, n in enumerate(("g_l", "g_r", "g_c", "g_ls", "g_rs"))))


@query("SELECT label, round(sum(list_sum(list_transform(embedding, lambda v: v::double * v::double))) / 1536, 9) AS power FROM embeddings GROUP BY label")
def mean_square_power(spark, sf_dir):
    """A5: mean square over the nominal frame length."""
    return mixing.mean_square(_t(spark, sf_dir, "embeddings"), ["label"], "embedding").select("label", F.round("power", 9).alias("power"))


@query(
    """SELECT label, i::int AS i, j::int AS j, round(sum(embedding[i + 1]::double * embedding[j + 1]::double * abs(embedding[6]::double)), 6) AS g
    FROM embeddings, range(5) a(i), range(5) b(j) GROUP BY label, i, j"""
)
def gram_matrix(spark, sf_dir):
    """Weighted Gram matrix of gain vectors."""
    e = _t(spark, sf_dir, "embeddings").select("label", F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double")).alias("d"), F.abs(F.col("embedding")[5].cast("double")).alias("p"))
    return mixing.gram(e, ["label"], "d", "p", 5).select("label", "i", "j", F.round("g", 6).alias("g"))


def _crc_sql(width: int, poly: int) -> str:
    mask = (1 << width) - 1
    bits = "list_transform(range(0, 4 * length(h)), lambda i: (instr('0123456789ABCDEF', substr(h, (i // 4 + 1)::int, 1)) - 1) >> (3 - i % 4)::int & 1)"
    return f"""SELECT item_id, list_reduce(list_prepend(0::bigint, list_transform({bits}, lambda b: b::bigint)),
        lambda c, b: xor((c << 1) & {mask}, CASE WHEN xor((c >> {width - 1}) & 1, b) = 1 THEN {poly}::bigint ELSE 0::bigint END))::bigint AS crc
        FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark)"""


def _crc(width: int, poly: int):
    def run(spark, sf_dir):
        b = _t(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("b"))
        return b.select("item_id", C.crc_msb(F.col("b"), width, poly).alias("crc"))

    return run


for _n, _w, _p in (("crc16_fold", 16, 0x8005), ("crc32_fold", 32, 0x04C11DB7), ("crc8_fold", 8, 0x2F)):
    QUERIES[_n] = _crc(_w, _p)
    ORACLE_SQL[_n] = _crc_sql(_w, _p)

_TREE = """WITH RECURSIVE t(node, bit, nxt) AS (SELECT * FROM (VALUES (0, 0, 1), (0, 1, 2), (1, 0, -1), (1, 1, -2), (2, 0, 3), (2, 1, -3), (3, 0, -4), (3, 1, 4), (4, 0, -5), (4, 1, -6)) v(node, bit, nxt)),
    w(nxt, code, len) AS (SELECT nxt, bit, 1 FROM t WHERE node = 0 UNION ALL SELECT t.nxt, w.code * 2 + t.bit, w.len + 1 FROM w JOIN t ON t.node = w.nxt WHERE w.nxt >= 0)
    SELECT -nxt - 1 AS sym, code, len FROM w WHERE nxt < 0"""


@query(_TREE)
def huffman_codes(spark, sf_dir):
    """C11: the code table of a decode tree."""
    from framewright.functions.bits import tree_codes

    tree = [(1, 2), (-1, -2), (3, -3), (-4, 4), (-5, -6)]
    return spark.createDataFrame([(sym, code, size) for sym, (code, size) in tree_codes(tree).items()], "sym int, code int, len int")


@query("SELECT item_id, bin(text) AS bits FROM benchmark")
def bit_string(spark, sf_dir):
    """B1: bytes as a string of bits, first bit first."""
    return _t(spark, sf_dir, "benchmark").select("item_id", C.bit_string(F.col("text").cast("binary")).alias("bits"))


_KEY = b"framewright".ljust(64, b"\0")
_IPAD, _OPAD = bytes(k ^ 0x36 for k in _KEY).hex(), bytes(k ^ 0x5C for k in _KEY).hex()


@query(f"SELECT item_id, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(text)))) AS mac FROM benchmark")
def hmac_sha256(spark, sf_dir):
    """Keyed MAC from nested digests."""
    return _t(spark, sf_dir, "benchmark").select("item_id", C.hmac_sha256(F.col("text").cast("binary"), b"framewright").alias("mac"))


@query(f"SELECT id, list(struct_pack(t := t, v := value) ORDER BY t, seq) AS keys FROM ({_EV}) GROUP BY id")
def keyframes_by_object(spark, sf_dir):
    """Each element's keyframes in order."""
    e = _events(spark, sf_dir).select("id", "t", "seq", F.col("value").alias("v"))
    return timeline.keyframes(e, "id", "t", "v", "seq")


@query(
    """SELECT a.vec_id, list_transform(range(1, 6), lambda i: round(a.embedding[i]::double + (b.embedding[i]::double - a.embedding[i]::double) * 0.25::double, 6)) AS g
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def gain_interp(spark, sf_dir):
    """M2: component-wise interpolation of gain vectors."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double")).alias("g"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("h"))
    return e.join(nxt, "vec_id").select("vec_id", F.transform(C.lerp("g", "h", F.lit(0.25)), lambda v: F.round(v, 6)).alias("g"))


@query(
    """SELECT event_id, user_id, coalesce(sum(CASE WHEN event_type <> 'view' THEN 256 * (1 + event_id % 6) ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM events"""
)
def frame_grid_start(spark, sf_dir):
    """First sample of each frame; only independent frames move on."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") != "view").alias("independent"), (256 * (1 + F.col("event_id") % 6)).alias("samples"))
    return grid.starts(e, "user_id", "event_id", "independent", "samples").select("event_id", "user_id", "start")


@query(f"SELECT id, (t // {_STEP})::bigint AS bin, round(sum(round(value * 100)::bigint * round(value * 100)::bigint)::double / 10000 / 1536, 6) AS power FROM ({_EV}) GROUP BY 1, 2")
def bin_power(spark, sf_dir):
    """Samples binned on a regular grid; squares of hundredths add up exactly."""
    e = grid.binned(_events(spark, sf_dir), "t", _STEP).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return e.groupBy("id", "bin").agg(C.rounded(F.sum(F.col("cents") * F.col("cents")).cast("double") / 10000 / 1536, 6).alias("power"))


@query(
    """SELECT label, round(sum(embedding[1]::double * embedding[2]::double) * pow(10::double, -3::double / 20), 6) AS l, round(sum(embedding[1]::double * embedding[3]::double) * pow(10::double, -3::double / 20), 6) AS r,
    round(sum(embedding[1]::double * embedding[4]::double) * pow(10::double, -3::double / 20), 6) AS c FROM embeddings GROUP BY label"""
)
def downmix_mix(spark, sf_dir):
    """Weighted mix at a gain in dB."""
    e = _t(spark, sf_dir, "embeddings")
    d = [F.col("embedding")[i].cast("double") for i in range(4)]
    return e.groupBy("label").agg(*(F.round(F.sum(d[0] * d[i]) * C.db_to_linear(F.lit(-3.0)), 6).alias(n) for i, n in ((1, "l"), (2, "r"), (3, "c"))))


@query(
    """SELECT label, round(p, 6) AS peak, CASE WHEN p > 0 THEN round(20 * log10(p), 5) END AS dbfs FROM
    (SELECT label, max(list_max(list_transform(embedding, lambda v: abs(v::double)))) AS p FROM embeddings GROUP BY label)"""
)
def peak_dbfs(spark, sf_dir):
    """Peak and its level; no level for silence."""
    p = _t(spark, sf_dir, "embeddings").groupBy("label").agg(F.max(F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))).alias("p"))
    return p.select("label", F.round("p", 6).alias("peak"), F.round(C.linear_to_db(F.col("p")), 5).alias("dbfs"))


@query(
    """SELECT vec_id, least(62, greatest(0, round((x + 1) / 2 * 62)))::int AS px, least(62, greatest(0, round((1 - y) / 2 * 62)))::int AS py, (z >= 0) AS up, least(15, round(abs(z) * 15))::int AS pz,
    least(191, greatest(0, round(x / 0.1::double) + 96))::int AS code, ((((round(x / 0.1::double) + 96) - 200)::int % 192 + 192) % 192)::int AS wrapped
    FROM (SELECT vec_id, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z FROM embeddings)"""
)
def quantize(spark, sf_dir):
    """M5, M7, M8: position and gain codes."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")))
    q = C.quantize_position(F.col("x"), F.col("y"), F.col("z"))
    raw = F.round(F.col("x") / F.lit(0.1)) + 96
    return e.select("vec_id", q["px"].alias("px"), q["py"].alias("py"), q["up"].alias("up"), q["pz"].alias("pz"), C.quantize_gain(F.col("x")).alias("code"), F.pmod((raw - 200).cast("int"), F.lit(192)).alias("wrapped"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, ((96 + sum(l_quantity::bigint) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)) % 192)::bigint AS code FROM lineitem"""
)
def band_prefix_mod(spark, sf_dir):
    """Band-differential codes."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.pmod(96 + F.sum(F.col("l_quantity").cast("long")).over(w), F.lit(192)).alias("code"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def substream_hist(spark, sf_dir):
    """A1: frames by type and substream."""
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS frames, count(*) FILTER (WHERE event_type = 'click') AS flags, count(*) FILTER (WHERE value > 50) AS over, count(*) FILTER (WHERE event_type <> 'view' AND value <= 50) AS others FROM events")
def signal_totals(spark, sf_dir):
    """A2, A3: conditional counters."""
    e = _t(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("frames"), F.count_if(F.col("event_type") == "click").alias("flags"), F.count_if(F.col("value") > 50).alias("over"), F.count_if((F.col("event_type") != "view") & (F.col("value") <= 50)).alias("others"))


@query(f"SELECT id, count(*) AS n, max(t) AS last_t, CASE WHEN count(*) > 16 THEN 'moving' ELSE 'static' END AS kind FROM ({_EV}) GROUP BY id HAVING count(*) > 1")
def movers(spark, sf_dir):
    """Elements with more than one event."""
    return timeline.movers(_events(spark, sf_dir), "id", "t", 16)


@query(
    """SELECT user_id, min(CASE WHEN prev IS NULL OR event_id % 1024 = (prev + 1) % 1024 THEN 1 ELSE 0 END)::int AS monotonic, count(*) AS n FROM
    (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) GROUP BY user_id"""
)
def seq_monotonic(spark, sf_dir):
    """Do sequence numbers go up by one, modulo 1024?"""
    return grid.monotonic(_t(spark, sf_dir, "events"), "user_id", "event_id", 1024)


@query(
    """WITH b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS j, item_id FROM benchmark WHERE length(text) > 200), a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id FROM documents)
    SELECT doc_id, item_id FROM a JOIN b ON a.i % (SELECT count(*) FROM b) = b.j"""
)
def cycle_join(spark, sf_dir):
    """The i-th row of one side with the (i mod n)-th of the other."""
    b = _t(spark, sf_dir, "benchmark").where(F.length("text") > 200).select("item_id")
    return grid.cycle_join(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", b, "item_id").select("doc_id", "item_id")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NULL AS verbatim FROM documents d LEFT JOIN labels l USING (doc_id)")
def zip_fallback(spark, sf_dir):
    """Pairing by position, verbatim where the other side has none."""
    d, o = _t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(False).alias("hit"))
    return d.join(o, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.col("hit"), F.lit(True)).alias("verbatim"))


@query("SELECT n_nationkey, r_name, (row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1)::int AS channel FROM nation JOIN region ON n_regionkey = r_regionkey")
def layout_channel(spark, sf_dir):
    """Element ids with their channels."""
    n = _t(spark, sf_dir, "nation").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", "r_name", (F.row_number().over(Window.orderBy("n_regionkey", "n_nationkey")) - 1).alias("channel"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
    SELECT doc_id, i::int AS i, (sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - strlen(line) - 1)::bigint AS at, strlen(line)::int AS size FROM l"""
)
def frame_offsets(spark, sf_dir):
    """Offsets of chained records."""
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return grid.offsets(lines.withColumn("size", F.octet_length("line")), "doc_id", "i", "size", 1).select("doc_id", "i", "at", "size")


@query("SELECT event_id, (props ->> '$.k')::int AS k FROM events")
def payload_field(spark, sf_dir):
    """A field of a tagged payload."""
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 3")
def first_n_matching(spark, sf_dir):
    """The first three that match."""
    return _t(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy("event_id").limit(3).select("event_id", "user_id", "value")


@query("SELECT lang, min(n_chars) AS least, max(n_chars) AS most, (sum(n_chars) // count(*))::bigint AS mean FROM documents GROUP BY lang")
def size_stats(spark, sf_dir):
    """Sizes, the mean rounded down."""
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.expr("sum(n_chars) div count(*)").alias("mean"))


@query("SELECT item_id, lower(hex(encode(text))) AS hex, decode(unhex(hex(encode(text)))) = text AS same FROM benchmark")
def hex_roundtrip(spark, sf_dir):
    """Hexadecimal and back."""
    b = F.col("text").cast("binary")
    return _t(spark, sf_dir, "benchmark").select("item_id", F.lower(F.hex(b)).alias("hex"), (F.unhex(F.hex(b)).cast("string") == F.col("text")).alias("same"))


@query("SELECT doc_id, len(regexp_extract_all(text, 'th'))::int AS n, CASE WHEN strpos(text, 'th') > 0 THEN 8 * strlen(left(text, strpos(text, 'th') - 1)) END::int AS first_bit FROM documents")
def sync_scan(spark, sf_dir):
    """Occurrences of a sync word and the first one's bit."""
    from framewright.functions.bits import sync_bits
    from framewright.operators.codecs import mapped

    def row(i, text):
        at = list(sync_bits((text or "").encode(), int.from_bytes(b"th", "big"), aligned=True))
        return [(i, len(at), at[0] if at else None)]

    return mapped(_t(spark, sf_dir, "documents"), "doc_id long, n int, first_bit int", row, "doc_id", "text")


@query("SELECT doc_id, strlen(text)::int AS bytes, (strlen(text) + strlen(text) % 2)::int AS even, (1536 * (1 + doc_id % 6))::bigint AS samples FROM documents")
def byte_length(spark, sf_dir):
    """Sizes in bytes, to the next even number, and samples."""
    n = F.octet_length("text")
    return _t(spark, sf_dir, "documents").select("doc_id", n.alias("bytes"), (n + n % 2).alias("even"), (1536 * (1 + F.col("doc_id") % 6)).alias("samples"))


@query(
    """SELECT DISTINCT v, CASE WHEN v < 16 THEN lpad(bin(v), 4, '0') || '0' WHEN v < 272 THEN lpad(bin((v - 16) // 16), 4, '0') || '1' || lpad(bin((v - 16) % 16), 4, '0') || '0'
    ELSE lpad(bin((v - 272) // 256), 4, '0') || '1' || lpad(bin((v - 272) // 16 % 16), 4, '0') || '1' || lpad(bin((v - 272) % 16), 4, '0') || '0' END AS bits
    FROM (SELECT (l_orderkey % 4368)::bigint AS v FROM lineitem)"""
)
def varbits_encode(spark, sf_dir):
    """Variable-length integers in groups of four bits."""
    return _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4368).alias("v")).distinct().select("v", C.variable_bits(F.col("v"), 4).alias("bits"))


def _frames(spark, sf_dir, filled: bool = True) -> DataFrame:
    """A frame per event: a header with fields of the event's number, filled with its type's letter; ``stream_id`` is the user's number."""
    e = F.col("event_id")
    words = 7 + e % 20
    head = sum(F.shiftleft(v.cast("long"), at) for v, at in ((e % 4, 30), (e % 8, 27), (words, 16), (e % 3, 14), (e % 4, 12), (e % 8, 9), (e % 2, 8), (F.lit(16), 3)))
    data = F.unhex(F.concat(F.lit("0B77"), F.lpad(F.hex(head), 8, "0"), F.expr("repeat(hex(substring(event_type, 1, 1)), cast(2 * (8 + event_id % 20) - 6 as int))")))
    return _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("frame_idx"), data.alias("bytes"))


_FRAME = """SELECT user_id::varchar AS stream_id, event_id AS frame_idx, (2 * (8 + event_id % 20))::int AS size, (event_id % 4)::int AS strmtyp, (event_id % 8)::int AS substreamid, [1, 2, 3, 6][(event_id % 4 + 1)::int]::int AS blocks,
    [48000, 44100, 32000][(event_id % 3 + 1)::int]::int AS sample_rate, (event_id % 8)::int AS acmod, event_id % 2 = 1 AS lfe, [2, 1, 2, 3, 3, 4, 4, 5][(event_id % 8 + 1)::int]::int AS full_channels, value FROM events"""


@query(f"SELECT * EXCLUDE (value), ['2/0','1/0','2/0','3/0','2/1','3/1','2/2','3/2'][acmod + 1] AS layout, 16 AS bsid FROM ({_FRAME})")
def frame_labels(spark, sf_dir):
    """Header fields of frames, by number and name."""
    from framewright.operators import frames
    from framewright.schemas import LAYOUTS

    h = frames.headers(_frames(spark, sf_dir)).withColumn("layout", F.element_at(F.array(*map(F.lit, LAYOUTS)), F.col("acmod") + 1))
    return h.select("stream_id", "frame_idx", "size", "strmtyp", "substreamid", "blocks", "sample_rate", "acmod", "lfe", "full_channels", "layout", "bsid")


@query(
    f"""SELECT stream_id, (2 * row_number() OVER w - 1)::bigint AS n, frame_idx, (3 * row_number() OVER w + sum(size) OVER w - size)::bigint AS "offset", size FROM ({_FRAME})
    WINDOW w AS (PARTITION BY stream_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)"""
)
def frame_scan(spark, sf_dir):
    """Frames found in whole streams with three bytes of junk before each."""
    from framewright.operators import frames

    f = _frames(spark, sf_dir)
    data = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "bytes"))), lambda x: F.concat(F.lit("010203"), F.hex(x["bytes"]))), ""))
    found = frames.scanned(f.groupBy("stream_id").agg(data.alias("data"))).where("is_frame")
    idx = f.select("stream_id", "frame_idx", (2 * F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_idx")) - 1).cast("long").alias("n"))
    return found.join(idx, ["stream_id", "n"]).select("stream_id", "n", "frame_idx", "offset", F.octet_length("bytes").alias("size"))


@query(f"SELECT stream_id, frame_idx, (size + 2 + 2 * ((8 * strlen(payload) + 14 + 1) // 16))::int AS least, payload FROM (SELECT *, 'user ' || stream_id AS payload FROM ({_FRAME}))")
def aux_payload(spark, sf_dir):
    """A payload put into each frame's aux field and read back; ``least`` bounds the frame's new size."""
    from framewright.operators import frames
    from framewright.operators.codecs import mapped

    def row(idx, data, sid):
        new = frames.inject_aux(data, f"user {sid}".encode())
        least = len(data) + 2 + 2 * ((8 * len(f"user {sid}") + 15) // 16)
        assert least - 2 <= len(new) <= least + 2 and frames.header(new).size == len(new), (len(data), len(new))
        return [(sid, idx, least, frames.read_aux(new)[0].decode())]

    return mapped(_frames(spark, sf_dir), "stream_id string, frame_idx long, least int, payload string", row, "frame_idx", "bytes", "stream_id")


@query(f"SELECT stream_id, strmtyp, substreamid, count(*) AS n, sum(size)::bigint AS bytes, (sum(256 * blocks) FILTER (WHERE strmtyp = 0))::bigint AS samples FROM ({_FRAME}) GROUP BY ALL")
def probe_frames(spark, sf_dir):
    """D3, A1, A3: frames, bytes and samples of each stream by type and substream."""
    from framewright.plans import jobs

    return jobs.probe(_frames(spark, sf_dir)).select("stream_id", "strmtyp", "substreamid", "n", "bytes", "samples")


@query(f"SELECT stream_id, frame_idx, coalesce(sum(CASE WHEN strmtyp = 0 THEN 256 * blocks ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM ({_FRAME})")
def frame_starts(spark, sf_dir):
    """W2 of frames: the first sample of each, from headers alone."""
    from framewright.plans import jobs

    return jobs.starts_of(_frames(spark, sf_dir)).select("stream_id", "frame_idx", "start")


@query(f"SELECT id::int AS id, count(*) AS n, max(t) AS last, count(*) FILTER (WHERE event_type = 'click') AS positions, count(*) > 1 AS moves FROM ({_EV}) GROUP BY id")
def inspect_events(spark, sf_dir):
    """Events, last place and positions of each element."""
    from framewright.plans import jobs

    pos = F.when(F.col("event_type") == "click", F.array("value", "value", "value")).when(F.col("event_type") == "view", F.array("value"))
    e = _events(spark, sf_dir).select("seq", F.col("id").cast("int").alias("id"), F.col("t").alias("sample_pos"), F.lit(True).alias("active"), pos.alias("pos"))
    return jobs.inspect(e)


@query("SELECT vec_id, list_transform(embedding[1:8], lambda v: round(v::double * 2, 6)) AS doubled FROM embeddings")
def grouped_transform(spark, sf_dir):
    """A user's Arrow function over rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def twice(batches):
        for b in batches:
            v = b.column("v").flatten()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.ListArray.from_arrays(b.column("v").offsets, pc.multiply(v, 2.0))], names=["vec_id", "v"])

    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double")).alias("v"))
    return e.mapInArrow(twice, e.schema).select("vec_id", F.transform("v", lambda v: F.round(v, 6)).alias("doubled"))


@query("SELECT (vec_id % 50)::bigint AS frame_idx, vec_id AS obj, true AS solved FROM embeddings")
def lsq_ridge(spark, sf_dir):
    """Regularised least squares of object vectors against the mix, per frame: whether each row satisfies its normal equations."""
    e = _t(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("frame_idx"), F.col("vec_id").alias("obj"), F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double")).alias("d"), F.abs(F.col("embedding")[5].cast("double")).alias("p"))
    g = mixing.gram(e, ["frame_idx"], "d", "p", 5).groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("i", "j", "g"))).alias("a"), F.sum(F.when(F.col("i") == F.col("j"), F.col("g"))).alias("trace"))
    m = mixing.ridge(e, "frame_idx", "obj", "d", "p").join(g, "frame_idx").join(e, ["frame_idx", "obj"])
    side = lambda i: F.aggregate(F.filter("a", lambda x: x["i"] == i), F.lit(0.0), lambda s, x: s + x["g"] * F.element_at("m", x["j"] + 1)) + F.element_at("m", i + 1) * (F.col("trace") * 1e-3 / 5 + 1e-12)
    worst = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.abs(side(i) - F.col("p") * F.element_at("d", i + 1))))
    return m.select("frame_idx", "obj", ((worst < 1e-9) | (F.array_max(F.transform("m", F.abs)) == 9.5)).alias("solved"))


_CODE = "list_transform(embedding[{lo}:{hi}], lambda v: least({most}, greatest(0, round({v} * {most})))::int)"


@query(
    f"""SELECT vec_id AS frame_idx, 14 AS object_count, 1 AS bed_count, {_CODE.format(lo=1, hi=13, most=62, v='((v::double + 1) / 2)')} AS px, {_CODE.format(lo=14, hi=26, most=62, v='((1 - v::double) / 2)')} AS py,
    list_transform(embedding[27:39], lambda v: v >= 0) AS up, {_CODE.format(lo=27, hi=39, most=15, v='abs(v::double)')} AS pz FROM embeddings"""
)
def oamd_roundtrip(spark, sf_dir):
    """Positions encoded, wrapped, found and decoded."""
    from framewright.operators import codecs

    xyz = (F.transform(F.slice("embedding", 1 + 13 * k, 13), lambda v: v.cast("double")).alias(c) for k, c in enumerate("xyz"))
    return codecs.oamd_roundtrip(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_idx"), *xyz))


_VAR8 = "CASE WHEN n < 256 THEN 9 WHEN n < 65792 THEN 18 ELSE 27 END"


@query(
    f"""SELECT item_id AS frame_idx, 0 AS n, (4 + (5 + 4 * 23 + 2 * ({_VAR8} + 8 * n) + 33 + 25 + 49 + 7) // 8)::int AS bytes, 4 AS payloads, true AS ok FROM (SELECT item_id, strlen(text) AS n FROM benchmark)"""
)
def emdf_roundtrip(spark, sf_dir):
    """Benchmark texts as payloads of a container, listed and verified."""
    from framewright.operators import codecs

    return codecs.emdf_roundtrip(_t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("frame_idx"), F.col("text").cast("binary").alias("payload")))


@query("SELECT vec_id AS frame_idx, (vec_id % 1024)::int AS seq, 12 AS objects, list_transform(embedding[1:60], lambda v: least(191, greatest(0, round(v::double * 20 / 0.1::double) + 96))::int) AS codes FROM embeddings")
def joc_roundtrip(spark, sf_dir):
    """Matrices encoded with a given code tree and decoded."""
    from framewright.operators import codecs

    rows = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda o: F.transform(F.slice("embedding", 5 * o + 1, 5), lambda v: v.cast("double") * 20))
    return codecs.joc_roundtrip(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_idx"), rows.alias("rows")))


@query("SELECT item_id AS stream_id, 3 AS frames, (6 + 8 + 2 * (strlen(text) % 20) + strlen(text) + 32 + 6)::int AS bytes, true AS ok FROM (SELECT item_id::varchar AS item_id, text FROM benchmark)")
def frame_identity(spark, sf_dir):
    """S5, S6, ST1, K3: streams of frames with junk between them, cut and put together again."""
    from framewright.operators import frames

    return frames.identity_check(_t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("stream_id"), F.col("text").cast("binary").alias("fill")))
