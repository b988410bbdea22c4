"""Queries over archives, streams, records and files: samples are written from rows, read back by the library, and held against the rows by SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytesx, codecs
from ..operators import demux, manifest, timing
from ..operators.staging import shared_dir, spread
from ..sources import archives, blobs, chunks, ranges, records, repair, toc, utf_table
from . import samples
from .queries import query

#: Rows of a table that make one file.
PER_FILE = 6
#: Documents that a task takes, of some kilobytes each.
TEXT_ROWS = 2000


def written(write: Callable[..., bytes], *cols: Column) -> Column:
    """A blob for each row, by a writer of its columns' values."""

    @F.pandas_udf("binary")
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([write(*x) for x in zip(*values, strict=True)])

    return run(*cols)


def _pairs(items) -> samples.Items:
    return [(x["name"], bytes(x["payload"])) for x in items]


def files_of(part: DataFrame) -> DataFrame:
    """(path, items): names and payloads of PER_FILE parts, by which their files are bounded."""
    item = F.struct(F.col("p_partkey").alias("k"), F.concat(F.lit("n"), F.col("p_partkey").cast("string"), F.lit(".bin")).alias("name"), F.encode(F.concat_ws(" ", "p_name", "p_type", F.col("p_partkey").cast("string")), "UTF-8").alias("payload"))
    dealt = spread(part.withColumn("path", F.floor(F.col("p_partkey") / PER_FILE).cast("string")), "path")
    rows = dealt.groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("path", F.transform("items", lambda x: F.struct(x["name"].alias("name"), x["payload"].alias("payload"))).alias("items"))


def read_back(payload: Column, skip: Column | int = 0) -> Column:
    """The text of a payload, less what stands before it and the zeros behind."""
    begin = skip + 1 if isinstance(skip, Column) else F.lit(skip + 1)
    return F.regexp_replace(F.decode(F.substring(payload, begin, F.length(payload)), "UTF-8"), "\\x00+$", "")


_ITEMS = f"""
p AS (SELECT p_partkey AS k, CAST(p_partkey // {PER_FILE} AS VARCHAR) AS path, 'n' || p_partkey || '.bin' AS name, p_name || ' ' || p_type || ' ' || p_partkey AS text,
  row_number() OVER (PARTITION BY p_partkey // {PER_FILE} ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_partkey // {PER_FILE}) AS n FROM part)"""


# --- archives ------------------------------------------------------------------------


@query("part", sql=f"""
WITH {_ITEMS}, f AS (SELECT unnest([{', '.join(f"'{x}'" for x in samples.SAMPLES)}]) AS form)
SELECT form, path, CASE form {' '.join(f"WHEN '{x}' THEN {s[2]}" for x, s in samples.SAMPLES.items())} END AS name, text FROM p, f""")
def archive_members(part):
    """The members of archives of every format, by name and content."""
    forms = {x: (lay, head) for x, (lay, _, _, head) in samples.SAMPLES.items()}

    @F.pandas_udf("struct<content: binary, body: binary>")
    def archive(form: pd.Series, items: pd.Series) -> pd.DataFrame:
        made = [samples.SAMPLES[f][1](_pairs(x)) for f, x in zip(form, items, strict=True)]
        return pd.DataFrame({"content": [c for c, _ in made], "body": [c if b is None else b for c, b in made]})

    every = files_of(part).withColumn("form", F.explode(F.array(*map(F.lit, forms))))
    layout = F.create_map(*[F.lit(x) for f, (lay, _) in forms.items() for x in (f, lay)])[F.col("form")]
    files = every.select(F.concat_ws("|", "form", "path").alias("file"), layout.alias("lay"), archive("form", "items").alias("a")).select("file", "lay", "a.content", "a.body")
    found = toc.entries(files, "file", "content", "lay", "body")
    form = F.split_part("file", F.lit("|"), F.lit(1))
    skip = F.create_map(*[F.lit(x) for f, (_, head) in forms.items() for x in (f, head)])[form]
    return found.select(form.alias("form"), F.split_part("file", F.lit("|"), F.lit(2)).alias("path"), "name", F.coalesce("error", read_back(F.col("payload"), skip)).alias("text"))


@query("part", sql=f"WITH {_ITEMS} SELECT path, name, text FROM p WHERE name LIKE 'n%7.bin'")
def archive_name_filter(part):
    """Members whose name fits, tested before a payload is cut."""
    files = files_of(part).select("path", written(lambda x: samples.spk(_pairs(x))[0], F.col("items")).alias("content"))
    return toc.entries(files.withColumn("lay", F.lit("spk")), "path", "content", "lay", keep=r"^n.*7\.bin$").select("path", "name", read_back(F.col("payload")).alias("text"))


@query("part", sql=f"WITH {_ITEMS} SELECT DISTINCT path, 'other signature' AS error FROM p")
def unsound_archives(part):
    """Files of another signature give one row with the reason each."""
    files = files_of(part).select("path", written(lambda x: b"XXXX" + samples.spk(_pairs(x))[0][4:], F.col("items")).alias("content")).withColumn("lay", F.lit("spk"))
    return toc.entries(files, "path", "content", "lay").select("path", "error")


@query("part", sql=f"""
WITH {_ITEMS} SELECT 'blocks' AS kind, path, CAST(i AS INT) AS part, repeat(text, 3) AS text FROM p WHERE i = 0
UNION ALL SELECT 'files', path, CAST(i AS INT), text FROM p UNION ALL SELECT 'runs', path, CAST(i AS INT), text FROM p UNION ALL SELECT 'asset', path, 0, repeat(text, 9) FROM p WHERE i = 0 UNION ALL SELECT 'padded', path, 0, repeat(text, 9) FROM p WHERE i = 0""")
def assembled_payloads(part):
    """Payloads that lie in pieces: stripped blocks, chunked files, deflated chunks of two kinds."""
    files = files_of(part)
    first = lambda n: (lambda x, n=n: _pairs(x)[0][1] * n)
    forms = {
        "blocks": (lambda x: samples.stripped_blocks(first(3)(x)), archives.stripped_blocks), "files": (lambda x: samples.chunked_files(_pairs(x)), archives.chunked_files),
        "runs": (lambda x: samples.stream_runs(_pairs(x)), archives.stream_runs), "asset": (lambda x: samples.chunked_asset(first(9)(x)), repair.chunked_asset), "padded": (lambda x: samples.padded_chunks(first(9)(x)), repair.padded_chunks),
    }
    out = None
    for kind, (write, read) in forms.items():
        got = blobs.parsed(files.select("path", written(write, F.col("items")).alias("content")), "path", "content", read, repair.CUT_SCHEMA)
        text = F.regexp_extract(F.decode("payload", "ISO-8859-1"), "(?s)^RVWS.{12}BGAV.{4}(.*?)LLIF", 1) if kind == "runs" else read_back(F.col("payload"))
        rows = got.select(F.lit(kind).alias("kind"), "path", "part", F.coalesce("error", text).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- streams --------------------------------------------------------------------------

#: Streams whose audio chunks have another id than "audi", and heads of their payloads.
_AUDIO = {"xa10": "Xa10", "ad10": "Ad11", "au00": "au01", "trimmed": "@SFA", "blocks": "00020001", "sectors": "01", "schl": "SCDl", "snh1": "1SNd", "riff": "01wb"}
_HEADS = {"xa10": 8, "ad10": 8, "au00": 8, "sectors": 20, "mul": 16, "xav": 4, "smk": 4, "vid1": 8, "vid1_le": 8}


@query("part", sql=f"""
WITH {_ITEMS}, f AS (SELECT unnest([{', '.join(f"'{x}'" for x in samples.STREAMS)}]) AS form)
SELECT form, path, string_agg(text, '|' ORDER BY i) AS audio FROM p, f GROUP BY form, path""")
def stream_audio(part):
    """The audio of movie streams of every dialect, chunk by chunk in order."""
    files = files_of(part).withColumn("form", F.explode(F.array(*map(F.lit, samples.STREAMS))))
    blob = written(lambda form, items: samples.STREAMS[form]([p for _, p in _pairs(items)]), F.col("form"), F.col("items"))
    files = files.select(F.concat_ws("|", "form", "path").alias("file"), "form", blob.alias("content"))
    found = chunks.walk(files, "file", "content", "form").withColumn("form", F.split_part("file", F.lit("|"), F.lit(1)))
    wanted = F.coalesce(F.create_map(*[F.lit(x) for kv in _AUDIO.items() for x in kv])[F.col("form")], F.lit("audi"))
    audio = (F.col("id") == wanted) & ((F.col("form") != "sectors") | (F.shiftright("type", 8).bitwiseAND(0x0E) == 4)) & ((F.col("form") != "xav") | (F.col("type") != 0x5F)) & (~F.col("form").isin("packets", "hvqm4") | (F.col("channel") == 0))
    skip = F.coalesce(F.create_map(*[F.lit(x) for kv in _HEADS.items() for x in kv])[F.col("form")], F.lit(0))
    rows = found.filter(audio | F.col("error").isNotNull()).select("file", "form", "seq", F.encode(F.concat(F.coalesce("error", read_back(F.col("payload"), skip)), F.lit("|")), "UTF-8").alias("payload"))
    joined = demux.streams(rows, ["file", "form"])
    return joined.select("form", F.split_part("file", F.lit("|"), F.lit(2)).alias("path"), F.regexp_replace(F.decode("payload", "UTF-8"), r"\|$", "").alias("audio"))


@query("part", sql=f"""
WITH {_ITEMS} SELECT path, 131073 AS stream, 0 AS part, string_agg(text, '' ORDER BY i) AS text FROM p GROUP BY path""")
def block_payloads(part):
    """Streams of opened and closed blocks, filtered by type, without padding."""
    files = files_of(part).select("path", written(lambda x: samples.blocks([p for _, p in _pairs(x)]), F.col("items")).alias("content"))
    found = demux.block_streams(chunks.walk(files, "path", "content", chunks.BLOCKS), "path", kind=1, subtype=2)
    return demux.streams(found.filter("error IS NULL"), ["path", "stream", "part"]).select("path", F.col("stream").cast("int").alias("stream"), F.col("part").cast("int").alias("part"), F.decode("payload", "UTF-8").alias("text"))


@query("part", sql=f"""
WITH {_ITEMS} SELECT path, 0 AS channel, CAST(count(*) AS BIGINT) AS sectors, md5(string_agg(text, '' ORDER BY i)) AS digest FROM p GROUP BY path""")
def sector_payloads(part):
    """Audio sectors by channel and part, cut where the end of file is marked."""
    files = files_of(part).select("path", written(lambda x: samples.sectors([p for _, p in _pairs(x)]), F.col("items")).alias("content"))
    found = demux.sector_streams(chunks.walk(files, "path", "content", chunks.SECTORS), "path").select("path", "channel", "part", "seq", F.encode(read_back(F.col("payload"), 20), "UTF-8").alias("payload"))
    count = found.groupBy("path", "channel", "part").agg(F.count("*").alias("sectors"))
    return demux.streams(found, ["path", "channel", "part"]).join(count, ["path", "channel", "part"]).select("path", "channel", "sectors", F.md5("payload").alias("digest"))


@query("documents", sql="""
WITH d AS (SELECT doc_id, text AS t FROM documents WHERE length(text) = octet_length(encode(text)) AND length(text) >= 100),
s AS (SELECT doc_id, t, CASE WHEN i = 0 THEN 0 ELSE 90 + (i - 1) * 120 END AS b, CASE WHEN i = 0 THEN 90 ELSE 120 END AS n FROM d, LATERAL (SELECT unnest(range(0, CAST(ceil((length(t) - 90) / 120.0) AS BIGINT) + 1)) AS i))
SELECT doc_id, md5(string_agg(substr(t, CAST(b AS INT) + 11, CAST(n AS INT) - 10), '' ORDER BY b)) AS digest FROM s GROUP BY doc_id""")
def deblocked_files(documents):
    """Files less the head of each block, of which the first is shorter."""
    plain = documents.filter("length(text) = octet_length(text) AND length(text) >= 100").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return demux.deblocked(plain, "content", 120, 90, 10).select("doc_id", F.md5("content").alias("digest"))


@query("part", sql=f"""
WITH {_ITEMS} SELECT path, CAST(i AS INT) AS part, text FROM p""")
def silent_window_cuts(part):
    """A file cut where its windows begin with silence."""
    def write(items) -> bytes:
        out = b""
        for i, (_, p) in enumerate(_pairs(items)):
            out += ((b"" if i == 0 else bytes(4)) + p).ljust(64 + 32 * (i % 3), b"s") + b"s" * 64
        return out

    def clean(payload: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.decode(payload, "UTF-8"), "^\\x00+", ""), "s*$", "")

    files = files_of(part).select("path", written(write, F.col("items")).alias("content"))
    found = blobs.parsed(files, "path", "content", repair.silent_cuts(64, 32), repair.CUT_SCHEMA)
    return found.select("path", "part", clean(F.col("payload")).alias("text"))


@query("part", sql=f"""
WITH {_ITEMS} SELECT path, string_agg(text, '' ORDER BY i) AS text FROM p GROUP BY path""")
def joined_parts(part):
    """Files name-001, name-002 ... as one."""
    item = F.posexplode("items").alias("i", "x")
    rows = files_of(part).select("path", item).select(F.concat(F.col("path"), F.lit("-"), F.lpad((F.col("i") + 1).cast("string"), 3, "0")).alias("file"), F.col("x.payload").alias("content"))
    return demux.joined_files(rows, "file", "content").select(F.col("stem").alias("path"), F.decode("content", "UTF-8").alias("text"))


@query("documents", sql="""
WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, doc_id % 4 AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE s WHEN 0 THEN 'fine' WHEN 1 THEN 'trimmed' WHEN 2 THEN 'extra' ELSE 'truncated' END AS state, CAST(8 + n + CASE s WHEN 2 THEN 8 WHEN 3 THEN -1 ELSE 0 END AS BIGINT) AS size FROM d WHERE n > 8""")
def riff_states(documents):
    """RIFF files put right where zeros follow them."""
    data, n, s = F.encode("text", "UTF-8"), F.octet_length("text"), F.col("doc_id") % 4
    tail = F.when(s == 1, F.unhex(F.lit("0000000000"))).when(s == 2, F.unhex(F.lit("0102030405060708"))).otherwise(F.unhex(F.lit("")))
    whole = F.concat(F.lit(b"RIFF"), bytesx.le_bytes(n, 4), data, tail)
    rows = documents.filter("octet_length(text) > 8").select("doc_id", F.when(s == 3, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("d"))
    return rows.select("doc_id", repair.riff_trimmed(F.col("d")).alias("r")).select("doc_id", "r.state", F.length("r.payload").cast("bigint").alias("size"))


# --- records ----------------------------------------------------------------------------


@query("part", sql="""
SELECT p_partkey, '1' AS field, CAST(p_partkey AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, '2', p_name FROM part UNION ALL SELECT p_partkey, '3', '(message)' FROM part
UNION ALL SELECT p_partkey, '3.1', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, '3.2', p_type FROM part UNION ALL SELECT p_partkey, '4', CAST(p_partkey * 7 AS VARCHAR) FROM part UNION ALL SELECT p_partkey, '5', CAST(p_partkey * 8589934592 AS VARCHAR) FROM part""")
def message_fields(part):
    """Fields of messages without a schema, nested ones too."""
    files = spread(part, "p_partkey").select("p_partkey", written(samples.message, F.col("p_partkey"), F.col("p_name"), F.col("p_size"), F.col("p_type")).alias("content"))
    found = records.read(files, "tlv", "p_partkey")
    field = F.array_join(F.concat(F.col("path_in").cast("array<string>"), F.array(F.col("field_no").cast("string"))), ".")
    return found.select("p_partkey", field.alias("field"), F.coalesce("text", F.col("int_value").cast("string"), F.lit("(message)")).alias("value"))


@query("part", sql=f"""
WITH {_ITEMS} SELECT path, name AS file, i AS subsong, 'TITLE' AS name, text AS value FROM p UNION ALL SELECT path, name, i, 'ALBUMARTIST', 'one, two' FROM p""")
def tag_records(part):
    """Tags of files, repeated ones joined."""
    files = files_of(part).select("path", written(lambda x: samples.external_tags(_pairs(x)), F.col("items")).alias("content"))
    return records.joined_tags(records.read(files, "external_tags"), ["path", "file", "subsong"]).select("path", "file", "subsong", "name", "value")


@query("part", sql=f"""
WITH {_ITEMS} SELECT 'bank' AS kind, path, k AS id, i AS place, CAST(2 + i % 3 AS BIGINT) AS a, CAST(4 + length(text) AS BIGINT) AS b FROM p
UNION ALL SELECT w.kind, path, k + c, i, 32000 + c, length(text) FROM p, (SELECT unnest(['waves', 'waves_be']) AS kind) w, (SELECT unnest([0, 1]) AS c)
UNION ALL SELECT 'ids', path, k, NULL, CASE WHEN i % 2 = 0 THEN 4096 + k END, length(text) FROM p""")
def bank_records(part):
    """Objects of sound banks, channels of wave containers of either byte order, ids of stream banks."""
    files = files_of(part)
    made = lambda write: files.select("path", written(lambda x: write(_pairs(x)), F.col("items")).alias("content"))
    bank = records.read(made(samples.sound_bank), "sound_bank").filter("object_no IS NOT NULL")
    out = bank.select(F.lit("bank").alias("kind"), "path", F.col("object_id").alias("id"), F.col("object_no").cast("bigint").alias("place"), F.col("object_type").cast("bigint").alias("a"), F.col("size").alias("b"))
    for kind, order in (("waves", "<"), ("waves_be", ">")):
        waves = records.read(made(samples.wave_container(order)), "wave_container").filter("channel IS NOT NULL")
        out = out.unionByName(waves.select(F.lit(kind).alias("kind"), "path", F.col("stream_id").alias("id"), F.col("stream_no").cast("bigint").alias("place"), F.col("rate").cast("bigint").alias("a"), F.col("samples").alias("b")))
    ids = blobs.parsed(made(samples.ktsr), "path", "content", records.stream_ids(samples.STREAM_KIND, samples.SOUND_KIND), records.IDS_SCHEMA).filter("error IS NULL")
    outside = F.when(F.col("offset") == F.col("stream_id") + 4096, F.col("offset"))
    return out.unionByName(ids.select(F.lit("ids").alias("kind"), "path", F.col("stream_id").alias("id"), F.lit(None).cast("bigint").alias("place"), outside.alias("a"), F.col("size").alias("b")))


@query("part", sql=f"""
WITH {_ITEMS} SELECT t.kind, path, CAST(i AS INT) AS seq, text FROM p, (SELECT unnest(['trailing', 'sized']) AS kind) t""")
def string_tables(part):
    """Tables of strings: at the file's end, and behind their sizes."""
    files = files_of(part)
    made = lambda write: files.select("path", written(lambda x: write(_pairs(x)), F.col("items")).alias("content"))
    a = records.read(made(samples.trailing_strings), "trailing_strings").select(F.lit("trailing").alias("kind"), "path", "seq", "text")
    return a.unionByName(records.read(made(samples.sized_names), "sized_names").select(F.lit("sized").alias("kind"), "path", "seq", "text"))


@query("part", sql="""
SELECT p_partkey, p_brand AS pack, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'bnk' ELSE 'wem' END AS extension, p_type AS text, CASE WHEN p_partkey % 2 = 0 THEN 'one,' || p_name ELSE '' END AS names FROM part""")
def wrapped_assets(part):
    asset = written(lambda k, n, p, b: samples.wrapped_asset(n, p.encode(), b, k % 2 == 0), F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_brand"))
    found = records.read(spread(part, "p_partkey").select("p_partkey", asset.alias("content")), "wrapped_asset", "p_partkey")
    return found.select("p_partkey", "pack", "name", "extension", read_back(F.col("payload")).alias("text"), F.array_join("names", ",").alias("names"))


@query("part", sql=f"""
WITH {_ITEMS} SELECT path, CASE WHEN i % 2 = 0 THEN 'FSB5' ELSE 'RIFF' END AS magic, text FROM p""")
def carved_objects(part):
    """Objects found by their marks and sizes in unknown data, copies once."""
    files = files_of(part).select("path", written(lambda x: samples.embedded(_pairs(x)), F.col("items")).alias("content"))
    found = blobs.parsed(files, "path", "content", records.carved({b"FSB5": records.fsb5_size, b"RIFF": records.riff_size}), records.CARVED_SCHEMA)
    return records.first_copies(found, "path").select("path", "magic", read_back(F.col("payload"), F.when(F.col("magic") == "FSB5", 0x3C).otherwise(8)).alias("text"))


@query("part", sql=f"WITH {_ITEMS} SELECT path, i AS sequence, text FROM p")
def ogg_payloads(part):
    """Pages with a good checksum, wherever they lie."""
    files = files_of(part).select("path", written(lambda x: samples.ogg(_pairs(x)), F.col("items")).alias("content"))
    return records.read(files, "ogg_pages").select("path", "sequence", F.decode("payload", "UTF-8").alias("text"))


@query("part", sql="SELECT p_partkey, p_partkey AS k, p_name AS name, p_retailprice AS price, '1,-1,null' AS items FROM part")
def packed_json(part):
    files = spread(part, "p_partkey").select("p_partkey", written(samples.msgpack, F.col("p_partkey"), F.col("p_name"), F.col("p_retailprice")).alias("content"))
    value = F.from_json("json", "k BIGINT, name STRING, price DOUBLE, list ARRAY<INT>")
    return records.read(files, "msgpack", "p_partkey").select("p_partkey", value.alias("v")).select("p_partkey", "v.k", "v.name", "v.price", F.array_join(F.col("v.list").cast("array<string>"), ",", "null").alias("items"))


@query("part", sql=f"""
WITH {_ITEMS} SELECT path, '' AS inside, i AS row, 'id' AS name, CAST(k AS VARCHAR) AS value FROM p UNION ALL SELECT path, '', i, 'text', text FROM p UNION ALL SELECT path, '', i, 'level', '-5' FROM p
UNION ALL SELECT path, 'sub[' || i || ']', 0, 'cue', name FROM p""")
def table_cells(part):
    """Cells of self-describing tables of several rows, with a default column and nested tables."""
    def write(items) -> bytes:
        rows = []
        for n, p in _pairs(items):
            inner = utf_table.build("cues", [("cue", "string", "row")], [[n]])
            rows.append([int(n[1:].split(".")[0]), p.decode(), inner])
        return utf_table.build("rows", [("id", "u32", "row"), ("text", "string", "row"), ("sub", "data", "row"), ("level", "s16", "default")], rows, {"level": -5})

    cells = utf_table.cells(files_of(part).select("path", written(write, F.col("items")).alias("content")), "path", "content")
    value = F.coalesce("text_value", F.col("int_value").cast("string"), "error")
    return cells.filter("type <> 'data' OR type IS NULL").select("path", F.array_join("table_path", "/").alias("inside"), "row", "name", value.alias("value"))


@query("part", sql="""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'no table' WHEN 1 THEN 'version 7' ELSE 'offsets out of the table' END AS error FROM part""")
def unsound_tables(part):
    """Each kind of damage gives one row that says so."""
    def write(k: int) -> bytes:
        good = utf_table.build("t", [("a", "u8", "row")], [[1]])
        return b"@UTX" + good[4:] if k % 3 == 0 else good[:8] + b"\0\7" + good[10:] if k % 3 == 1 else good[:4] + b"\0\0\0\1" + good[8:]

    return utf_table.cells(spread(part, "p_partkey").select("p_partkey", written(write, F.col("p_partkey")).alias("content")), "p_partkey", "content").select("p_partkey", "error")


# --- texts, files and tracks --------------------------------------------------------------


@query("part", "nation", sql="""
SELECT 'bytes' AS kind, p_partkey AS id, p_name AS value FROM part UNION ALL SELECT 'url', n_nationkey, 'http://new/' || n_name || '/' || i FROM nation, (SELECT unnest([1, 2]) AS i)
UNION ALL SELECT 'slice', p_partkey, 'g:' || p_brand || ':' || p_name FROM part UNION ALL SELECT 'xml', (p_partkey * 40503) % 4294967296, 'dir/' || p_name FROM part""")
def structured_texts(part, nation):
    """JSON byte lists, JSON address lists, JSON directories over a blob, XML file lists."""
    numbers = F.transform(F.split("p_name", ""), lambda c: F.ascii(c).cast("string"))
    raw = part.select("p_partkey", F.concat(F.lit('{"RawData":['), F.array_join(numbers, ","), F.lit("]}")).alias("text"))
    out = blobs.json_bytes(raw, "text").select(F.lit("bytes").alias("kind"), F.col("p_partkey").alias("id"), F.decode("content", "UTF-8").alias("value"))
    listed = nation.select("n_nationkey", F.to_json(F.struct(F.array(F.concat(F.lit("http://old/"), "n_name", F.lit("/1")), F.concat(F.lit("http://old/"), "n_name", F.lit("/2")), F.lit("skip")).alias("urls"))).alias("text"))
    urls = blobs.json_urls(listed, "text", "urls", "http://old/", "http://new/")
    out = out.unionByName(urls.join(nation, F.col("url").contains(F.concat(F.lit("/"), "n_name", F.lit("/")))).select(F.lit("url").alias("kind"), F.col("n_nationkey").cast("bigint").alias("id"), F.col("url").alias("value")))
    entries = F.array(F.struct(F.col("p_brand").alias("Name"), F.lit(3).alias("Offset"), F.length("p_name").alias("Size")))
    dirs = part.select(F.col("p_partkey").cast("string").alias("path"), F.encode(F.concat(F.lit("pad"), "p_name", F.lit("tail")), "UTF-8").alias("content"), F.to_json(F.struct(F.array(F.struct(F.lit("g").alias("Name"), entries.alias("OrderedEntries"))).alias("Groups"))).alias("text"))
    slices = blobs.json_toc(dirs, "text")
    out = out.unionByName(slices.select(F.lit("slice").alias("kind"), F.col("path").cast("bigint").alias("id"), F.concat_ws(":", "group", "name", F.decode("payload", "UTF-8")).alias("value")))
    crc = F.hex((F.col("p_partkey") * 40503) % 4294967296)
    docs = part.select(F.concat(F.lit('<L><File CrcHex="'), crc, F.lit('" Path="dir/'), "p_name", F.lit('"/></L>')).alias("text"))
    return out.unionByName(blobs.xml_files(docs, "text").select(F.lit("xml").alias("kind"), F.col("crc").alias("id"), F.col("path").alias("value")))


def _folder(df: DataFrame, name: str) -> str:
    """A new folder for files that all executors reach."""
    import uuid

    return f"{shared_dir(df.sparkSession)}/bytequarry/{name}-{uuid.uuid4().hex}"


@query("nation", "region", sql="""
WITH f AS (SELECT r_name || '/' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.wav' ELSE '.txt' END AS path, repeat(n_name || '!', 20) AS t FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT path, CAST(length(t) AS BIGINT) AS size, left(t, 96) AS head, CAST(ceil(length(t) / 64.0) AS INT) AS pieces, md5(t) AS digest FROM f WHERE path LIKE '%.wav'""")
def scanned_files(nation, region):
    """Files written by the tasks, then scanned by pattern: sizes, heads, pieces, digests."""
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    ext = F.when(F.col("n_nationkey") % 2 == 0, ".wav").otherwise(".txt")
    named = rows.select(F.concat("r_name", F.lit("/"), "n_name", ext).alias("name"), F.encode(F.repeat(F.concat("n_name", F.lit("!")), 20), "UTF-8").alias("payload"))
    folder = _folder(nation, "files")
    if manifest.write_payloads(named, folder).agg(F.count("*")).first()[0] != blobs.listing(nation.sparkSession, folder).count():
        raise RuntimeError("files are missing")
    found = blobs.scan(nation.sparkSession, folder, "*.wav")
    pieces = blobs.in_pieces(found, 64).groupBy("path").agg(F.count("*").cast("int").alias("pieces"), F.max("piece").alias("last"))
    rows = found.select("path", F.col("length").alias("size"), F.decode(blobs.head(F.col("content")), "UTF-8").alias("head"), F.md5("content").alias("digest")).join(pieces, "path")
    own = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
    return rows.select(F.replace(own, F.lit("%20"), F.lit(" ")).alias("path"), "size", "head", "pieces", "digest")


@query("documents", sql="""
WITH s AS (SELECT source || '.txt' AS file, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY source),
n AS (SELECT * FROM (VALUES (0, ' the'), (1, 'tion'), (2, 'é'), (3, chr(10))) v(needle, w))
SELECT file, needle, CAST((length(t) - length(replace(t, w, ''))) / length(w) AS BIGINT) AS places, CAST(octet_length(encode(t)) AS BIGINT) AS bytes FROM s, n WHERE contains(t, w)""")
def needles_over_seams(documents):
    """Documents appended to a file for each source, read back in blocks of 4 KiB; needles are found across seams as well."""
    folder, spark = _folder(documents, "blocks"), documents.sparkSession
    rows = documents.select(F.concat("source", F.lit(".txt")).alias("name"), "doc_id", F.concat("text", F.lit("\n")).alias("payload"))
    ranges.write_keyed(rows, folder, order=["doc_id"])
    read = ranges.blocks(spark, folder, 4096, 16)
    sizes = read.groupBy("path").agg(F.sum(F.octet_length("content")).alias("bytes"))
    found = ranges.needle_places(read, [x.encode() for x in (" the", "tion", "é", "\n")]).groupBy("path", "needle").agg(F.count("*").alias("places"))
    return found.join(sizes, "path").select(F.substring_index("path", "/", -1).alias("file"), "needle", "places", "bytes")


@query("part", sql="""
SELECT lower(replace(p_brand, '#', '_')) || '.arc' AS file, 'p' || p_partkey AS name, octet_length(encode(p_name || p_type)) AS size, md5(p_name || p_type) AS digest FROM part WHERE 'p' || p_partkey LIKE 'p1%'""")
def members_by_range(part):
    """Archives of one brand each; the filter on names reaches the source, which reads directories and the ranges of what it keeps."""
    folder, spark = _folder(part, "archives"), part.sparkSession
    rows = part.select(F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".arc")).alias("path"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.encode(F.concat("p_name", "p_type"), "UTF-8").alias("payload"))
    ranges.write_keyed(toc.packed(rows, "path", "name", "payload"), folder, "path", "content")
    kept = ranges.members(spark, folder, "flat").filter(F.col("name").startswith("p1"))
    return kept.select(F.substring_index("path", "/", -1).alias("file"), "name", F.col("size").cast("int").alias("size"), F.md5("payload").alias("digest"))


@query("nation", sql="""
SELECT 'bom' AS kind, n_nationkey AS seq, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation) THEN chr(65279) ELSE '' END || n_name || 'é' AS line FROM nation UNION ALL SELECT 'crlf', n_nationkey, n_name || chr(13) FROM nation""")
def text_manifests(nation):
    """Text files with a byte order mark, and with Windows line ends, read back line by line."""
    from ..sources import lines

    spark, folder = nation.sparkSession, _folder(nation, "texts")
    manifest.write_text(nation.select("n_nationkey", F.concat("n_name", F.lit("é")).alias("line")), f"{folder}/bom", ["n_nationkey"], bom=True)
    manifest.write_text(nation.select("n_nationkey", F.col("n_name").alias("line")), f"{folder}/crlf", ["n_nationkey"], crlf=True)
    bom = lines.numbered_lines(spark, f"{folder}/bom").select(F.lit("bom").alias("kind"), "seq", "line")
    whole = spark.read.text(f"{folder}/crlf", wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    return bom.unionByName(whole.select(F.lit("crlf").alias("kind"), "seq", "line")).filter("line <> ''")


@query("part", sql=f"""
WITH {_ITEMS}, t AS (SELECT path, sum(300 + i * 40) AS steps, coalesce(sum(300 + i * 40) FILTER (i < 2), 0) AS before, min(500 + i) AS tempo, max(i) AS m, max_by(10 + i, i) AS gate FROM p GROUP BY path)
SELECT path, CAST(path AS BIGINT) % 2 = 0 AND m >= 2 AS looped,
       round(CASE WHEN CAST(path AS BIGINT) % 2 = 0 AND m >= 2 THEN (2 * steps - before) * 500000.0 / 480000000 ELSE (steps + gate) * 500000.0 / 480000000 + 1 END, 6) AS seconds FROM t""")
def track_times(part):
    """Durations of event tracks with and without a loop mark."""
    def write(path: str, items) -> bytes:
        notes = [(10 + i, 300 + 40 * i) for i in range(len(items))]
        return samples.track(notes, 2 if int(path) % 2 == 0 else -1, 500)

    tracks = files_of(part).select("path", written(write, F.col("path"), F.col("items")).alias("content"))
    return timing.durations(tracks, "path", "content").select("path", "looped", F.round("seconds", 6).alias("seconds"))


@query("part", sql="SELECT p_partkey, p_name AS zlib, p_name AS deflate, p_name AS zstd, p_name AS lzma, p_name AS lzss, p_name || p_name AS gprs, p_name AS aes, p_name AS ctr FROM part")
def unpacked_payloads(part):
    """Names packed in each way and unpacked by the library."""
    import zlib

    import zstandard

    def raw(s: str) -> bytes:
        z = zlib.compressobj(9, zlib.DEFLATED, -15)
        return z.compress(s.encode()) + z.flush()

    def literal_runs(s: str) -> bytes:
        return b"".join(bytes([len(s[i : i + 9]) - 1, 0xFF]) + s[i : i + 9].encode() for i in range(0, len(s), 9))

    packers = {"zlib": lambda s: zlib.compress(s.encode()), "deflate": raw, "zstd": lambda s: zstandard.ZstdCompressor().compress(s.encode()), "lzma": samples.xz, "lzss": literal_runs, "gprs": samples.gprs_twice}
    name = F.col("p_name")
    out = spread(part, "p_partkey").select("p_partkey", *[F.decode(codecs.inflate(written(f, name), k), "UTF-8").alias(k) for k, f in packers.items()], *[c.alias(n) for n, c in (("_n", name),)])
    key, iv = F.lit(b"0123456789abcdef"), b"fedcba9876543210"
    sealed = F.substring(F.aes_encrypt(F.encode("_n", "UTF-8"), key, F.lit("CBC"), F.lit("PKCS"), F.lit(iv)), F.lit(17), F.lit(1 << 20))
    plain = codecs.aes_ctr(codecs.aes_ctr(F.encode("_n", "UTF-8"), b"0123456789abcdef"), b"0123456789abcdef")
    return out.withColumn("aes", F.decode(codecs.aes_cbc(sealed, key, iv), "UTF-8")).withColumn("ctr", F.decode(plain, "UTF-8")).drop("_n")


# --- objects, sections, masks ----------------------------------------------------------------

_VERSION = "([1769728, 2031632, 2425098, 2425117])[p_partkey % 4 + 1]"


@query("part", sql=f"""
WITH o AS (SELECT p_partkey AS k, {_VERSION} AS version, p_size % 2 = 0 AS big, ([1, 6, 5, 8])[p_partkey // 4 % 4 + 1] AS type, p_partkey * 3 AS c FROM part)
SELECT CASE WHEN type = 6 AND version <> 1769728 THEN c ELSE k END AS id, CAST(version AS INT) AS version, big, CAST(type AS BIGINT) AS type, CASE WHEN type IN (1, 6) THEN c END AS companion, CASE type WHEN 1 THEN true WHEN 6 THEN c % 2 = 1 END AS streamed,
       CASE type WHEN 1 THEN c % 2 = 1 WHEN 6 THEN true END AS ahead, CASE WHEN type = 5 THEN (k + 2) || ',' || (k + 3) || ',' || (k + 4) ELSE '' END AS items FROM o""")
def object_fields(part):
    """Fields of objects of four versions and both byte orders, by a table of places."""
    from ..sources import objects

    found = objects.objects(_objects(part), "p_partkey")
    return found.select("id", "version", "big", "type", "companion", "streamed", "ahead", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


def _objects(part: DataFrame) -> DataFrame:
    version = F.element_at(F.array(*map(F.lit, (0x001B0100, 0x001F0010, 0x0025010A, 0x0025011D))), (F.col("p_partkey") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit(1), F.lit(6), F.lit(5), F.lit(8)), (F.floor(F.col("p_partkey") / 4) % 4 + 1).cast("int"))
    write = lambda k, v, s, t: samples.versioned_object(v, s % 2 == 0, k, t, 3 * k, [k + 2, k + 3, k + 4])
    return spread(part, "p_partkey").select("p_partkey", written(write, F.col("p_partkey"), version, F.col("p_size"), kind).alias("content"))


@query("part", sql=f"""
WITH k AS (SELECT p_partkey AS k, {_VERSION} AS version, ([1, 6, 5, 8])[p_partkey // 4 % 4 + 1] AS type, p_partkey * 3 AS c FROM part),
o AS (SELECT CASE WHEN type = 6 AND version <> 1769728 THEN c ELSE k END AS id, * FROM k)
SELECT id, 'stream' AS role, c AS needs FROM o WHERE type = 1 OR type = 6 AND c % 2 = 1
UNION ALL SELECT id, 'ahead', CASE WHEN version = 1769728 THEN 805306368 | c ELSE c END FROM o WHERE (type = 1 AND c % 2 = 1 OR type = 6) AND id <> c
UNION ALL SELECT id, 'item' || i, id + 2 + i FROM o, (SELECT unnest([0, 1, 2]) AS i) WHERE type = 5""")
def object_companions(part):
    """What each object needs: its stream, what is kept ahead of it, its sequence's items."""
    from ..sources import objects

    return objects.companions(objects.objects(_objects(part), "p_partkey")).select("id", "role", "needs")


@query("part", sql=f"""
WITH {_ITEMS} SELECT path, 'NAME' AS section, CAST(i AS INT) AS idx, 'reqd' AS kind, 1000 + i AS a, i AS b, text FROM p
UNION ALL SELECT DISTINCT path, 'TONE', 0, 'tone', 1, 127, NULL FROM p UNION ALL SELECT DISTINCT path, 'TONE', 0, 'sub', 2, 99, NULL FROM p
UNION ALL SELECT path, 'TONE', CAST(i AS INT), CASE WHEN i % 2 = 1 THEN 'seqd' ELSE 'wave' END, k, CASE WHEN i % 2 = 1 THEN -1 ELSE i END, NULL FROM p
UNION ALL SELECT path, 'WAVE', CAST(i AS INT), 'wave', NULL, NULL, NULL FROM p UNION ALL SELECT DISTINCT path, 'LVAR', 0, 'lvar', -1500, 2250, NULL FROM p""")
def definition_sections(part):
    """Names, tones, waves and variables of sound definitions."""
    files = files_of(part).select("path", written(lambda x: samples.sound_sections(_pairs(x)), F.col("items")).alias("content"))
    return records.read(files, "sound_sections").select("path", "section", "idx", "kind", "a", "b", "text")


@query("part", sql=f"""
WITH {_ITEMS} SELECT path, CAST(i AS INT) AS part, text FROM p""")
def block_run_payloads(part):
    """Runs of flagged blocks found in unknown data."""
    files = files_of(part).select("path", written(lambda x: samples.block_run(_pairs(x)), F.col("items")).alias("content"))
    text = F.regexp_replace(F.regexp_replace(F.decode(F.substring("payload", F.lit(13), F.length("payload")), "ISO-8859-1"), "(?s)\\x00*E\\x00\\x00\\x08tail$", ""), "\\x00+$", "")
    return records.read(files, "block_runs").select("path", "part", text.alias("text"))


@query("part", sql=f"""
WITH {_ITEMS} SELECT 'dt' AS kind, path, printf('ed%04d', k) AS name, i % 2 = 1 AS looped, 100 + i AS loop_start, 150 + i AS loop_end FROM p UNION ALL SELECT 'tbb', path, left(name, 12), i % 2 = 1, 100 + i, 150 + i FROM p""")
def loop_record_tables(part):
    files = files_of(part)
    out = None
    for kind in ("dt", "tbb"):
        rows = records.read(files.select("path", written(lambda x, kind=kind: samples.loop_record(kind, _pairs(x)), F.col("items")).alias("content")), f"loop_records_{kind}")
        rows = rows.select(F.lit(kind).alias("kind"), "path", "name", "looped", "loop_start", "loop_end")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("part", sql="""
WITH p AS (SELECT p_brand AS folder, p_partkey AS k, p_size AS s, CAST(replace(p_brand, 'Brand#', '') AS INT) % 4 AS t FROM part)
SELECT folder, CASE t WHEN 0 THEN 'bgmtbl.txt' WHEN 1 THEN 'bgmtbl.txt_switch' WHEN 2 THEN 'bgmtbl.tbl' ELSE 'map.txt' END AS "table", CASE WHEN t = 3 THEN 'M' || k ELSE 'T' || k END AS title, CASE WHEN t = 3 THEN 'm' || k ELSE 'ed' || k END AS name,
       CASE WHEN t = 3 THEN k * 10 + s <> 99999999 ELSE k % 2 = 1 END AS looped, CASE WHEN t = 1 THEN CAST(floor(k * 10 * 48000 / 44100) AS BIGINT) ELSE k * 10 END AS loop_start,
       CASE t WHEN 0 THEN k * 10 + s WHEN 1 THEN CAST(floor((k * 10 + s) * 48000 / 44100) AS BIGINT) WHEN 2 THEN s ELSE k * 10 + s END AS loop_end FROM p""")
def loop_text_tables(part):
    """The first known text table of each folder, its loops by the rules of its kind."""
    from ..sources import lines

    kind = F.regexp_replace("p_brand", "Brand#", "").cast("int") % 4
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    table = F.element_at(F.array(*map(F.lit, lines.LOOP_TABLES[:4])), kind + 1)
    start = (F.col("p_partkey") * 10).cast("string")
    plain = F.concat_ws(" ", F.lit("bgmtbl"), F.concat(F.lit("T"), key), F.concat(F.lit("ed"), key), (F.col("p_partkey") % 2).cast("string"), start, size)
    mapped = F.concat_ws(" ", key, F.concat(F.lit("M"), key), F.lit("x"), start, (F.col("p_partkey") * 10 + F.col("p_size")).cast("string"))
    rows = part.select(F.col("p_brand").alias("folder"), table.alias("table"), F.col("p_partkey").alias("seq"), F.when(kind == 3, mapped).otherwise(plain).alias("line"))
    other = part.select(F.col("p_brand").alias("folder"), F.lit("t_bgm._dt").alias("table"), F.col("p_partkey").alias("seq"), plain.alias("line"))
    marks = part.select(F.col("p_brand").alias("folder"), table.alias("table"), F.lit(-1).cast("bigint").alias("seq"), F.when(kind == 3, "#BGMTable").otherwise("//tbl").alias("line")).distinct()
    return lines.loop_tables(rows.unionByName(other).unionByName(marks)).select("folder", "table", "title", "name", "looped", "loop_start", "loop_end")


@query("documents", sql="""
SELECT doc_id, k.kind, md5(text) AS digest FROM documents, (SELECT unnest(['@SFV', '@SFA', '@CUE']) AS kind) k WHERE text IS NOT NULL""")
def unmasked_streams(documents):
    """Payloads masked by a caller's masks, the video's by a writer of its own, and unmasked."""
    import hashlib

    masks = tuple(hashlib.sha256(x).digest() for x in (b"first", b"second", b"audio"))
    texts = spread(documents, "doc_id", rows=TEXT_ROWS).filter("text IS NOT NULL").select("doc_id", F.explode(F.array(F.lit("@SFV"), F.lit("@SFA"), F.lit("@CUE"))).alias("kind"), F.encode("text", "UTF-8").alias("d"))
    masked = written(lambda kind, d: samples.masked(kind, bytes(d), masks), F.col("kind"), F.col("d"))
    return texts.select("doc_id", "kind", F.md5(codecs.unmask_stream(masked, F.col("kind"), masks)).alias("digest"))


@query("part", sql=f"WITH {_ITEMS} SELECT path, text FROM p")
def validated_objects(part):
    """Objects without a mark in unknown data, by a plausible head and a check of the whole."""
    import struct
    import zlib

    def size_of(data: bytes, at: int) -> int:
        size, crc = struct.unpack_from("<II", data, at + 4)
        return size if 12 < size <= len(data) - at and zlib.crc32(data[at + 12 : at + size]) == crc else 0

    files = files_of(part).select("path", written(lambda x: samples.unmarked_objects(_pairs(x)), F.col("items")).alias("content"))
    found = blobs.parsed(files, "path", "content", records.carved_valid(records.bitpacked_head, size_of), records.CARVED_SCHEMA)
    return found.select("path", read_back(F.col("payload"), 12).alias("text"))


@query("part", sql=f"""
WITH {_ITEMS}, o AS (SELECT path, i, k, text FROM p)
SELECT path, 'mode' AS field, 10 * k + 2 AS id, i % 3 AS value, ([ 'Bank', 'Stream', 'Prefetch'])[i % 3 + 1] AS text FROM o UNION ALL SELECT path, 'source', 10 * k + 2, k + 1, NULL FROM o
UNION ALL SELECT path, 'scope', 10 * k + 3, 2, 'Global' FROM o UNION ALL SELECT path, 'action', 10 * k + 3, 4, 'Play' FROM o UNION ALL SELECT path, 'target', 10 * k + 3, k, NULL FROM o
UNION ALL SELECT path, 'action0', 10 * k + 4, k + 2, NULL FROM o UNION ALL SELECT path, 'action1', 10 * k + 4, k + 3, NULL FROM o
UNION ALL SELECT path, 'name', NULL, i, text FROM o UNION ALL SELECT DISTINCT path, 'version', NULL, 120, NULL FROM o UNION ALL SELECT DISTINCT path, 'id', NULL, 77, NULL FROM o UNION ALL SELECT DISTINCT path, 'platform', NULL, NULL, 'Linux' FROM o""")
def bank_fields(part):
    """Typed fields of banks: sounds, event actions and sequences, names, platform."""
    files = files_of(part).select("path", written(lambda x: samples.event_bank(_pairs(x)), F.col("items")).alias("content"))
    return records.read(files, "bank_details").select("path", "field", F.col("object_id").alias("id"), "value", "text")


@query("part", sql="""
WITH p AS (SELECT p_partkey AS k, p_type || ' ' || p_partkey // 2 AS w FROM part WHERE p_partkey % 2 = 0),
f AS (SELECT k, w, unnest(range(1 + k % 3)) AS i FROM p)
SELECT 's' || k || '.acb' AS file, CASE WHEN k % 8 = 0 THEN 'REM #ren s' || k || '.acb s' || k || '.acb' ELSE 'ren s' || k || '.acb cue' || k || '.acb' END AS line FROM p
UNION ALL SELECT 'w' || k || '_' || i || '.awb', 'ren w' || k || '_' || i || '.awb ' || CASE WHEN k % 8 = 0 THEN 's' ELSE 'cue' END || k || CASE WHEN i > 0 THEN '[' || i || ']' ELSE '' END || '.awb' FROM f""")
def cue_renames(part):
    """Rename commands of cue sheets and of the wave files whose checksums they name."""
    rows = spread(part, "p_partkey").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.encode(F.concat("p_type", F.lit(" "), F.floor(F.col("p_partkey") / 2).cast("string")), "UTF-8").alias("p"))
    name = F.concat(F.when(F.col("k") % 8 == 0, "s").otherwise("cue"), F.col("k").cast("string"))
    file = F.concat(F.lit("s"), F.col("k").cast("string"), F.lit(".acb"))
    sheets = rows.select(file.alias("path"), written(lambda n, p, k: samples.cue_sheet(n, bytes(p), k % 4 == 0), name, F.col("p"), F.col("k")).alias("content"))
    waves = rows.select(F.explode(F.sequence(F.lit(0), (F.col("k") % 3).cast("int"))).alias("i"), "k", "p").select(F.concat(F.lit("w"), F.col("k").cast("string"), F.lit("_"), F.col("i").cast("string"), F.lit(".awb")).alias("file"), F.md5(F.concat(F.lit(b"AFS2"), "p")).alias("wave_md5"))
    return manifest.sheet_renames(utf_table.cue_sheets(sheets).withColumnRenamed("path", "file"), waves)


@query("part", sql="""
SELECT p_partkey, 'codec = PCFX' || chr(10) || 'codec_mode = 3' || chr(10) || CASE WHEN p_partkey % 3 <> 0 THEN 'interleave = 0x' || lower(to_base(p_size * 16, 16)) || chr(10) ELSE '' END || 'channels = ' || CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END || chr(10)
       || 'sample_rate = ' || ([31468, 15734, 8000])[p_partkey % 3 + 1] || chr(10) || 'start_offset = 0x' || lower(to_base(p_partkey * 2048, 16)) || chr(10) || 'num_samples = data_size' AS header FROM part""")
def option_headers(part):
    """Text headers of raw streams from lines of encoder options."""
    from ..sources import lines

    rate = F.element_at(F.array(F.lit("31560"), F.lit("15780"), F.lit("8000")), (F.col("p_partkey") % 3 + 1).cast("int"))
    line = F.concat(F.lit("enc /f"), rate, F.when(F.col("p_partkey") % 3 == 0, " /m").otherwise(""), F.lit(" /bs0x"), F.hex((F.col("p_size") * 16).cast("bigint")), F.lit(" /lp0 /o0x"), F.hex(F.col("p_partkey") * 2048), F.lit(" out.bin"))
    return lines.stream_headers(part.select("p_partkey", line.alias("line"))).select("p_partkey", "header")


_STEPS = str(list(codecs._IMA))
_STATE = "{{'c': {c}, 'p': 0, 'i': 0, 'o': []::INT[]}}"


@query("part", sql=f"""
WITH b AS (SELECT p_partkey, list_transform(range(octet_length(encode(p_name))), lambda i: ('0x' || substr(hex(encode(p_name)), 2 * i + 1, 2))::INT) AS b FROM part),
n AS (SELECT p_partkey, b, list_prepend({_STATE.format(c="0")}, list_transform(flatten(list_transform(b, lambda x: [x & 15, x >> 4])), lambda c: {_STATE.format(c="c")})) AS n FROM b),
d AS (SELECT p_partkey, b, list_reduce(n, lambda a, y: {{'c': ({_STEPS})[a.i + 1], 'p': greatest(-32768, least(32767, a.p + (CASE WHEN y.c & 8 > 0 THEN -1 ELSE 1 END) * ((({_STEPS})[a.i + 1] >> 3) + (CASE WHEN y.c & 4 > 0 THEN ({_STEPS})[a.i + 1] ELSE 0 END) + (CASE WHEN y.c & 2 > 0 THEN ({_STEPS})[a.i + 1] >> 1 ELSE 0 END) + (CASE WHEN y.c & 1 > 0 THEN ({_STEPS})[a.i + 1] >> 2 ELSE 0 END)))),
  'i': greatest(0, least(88, a.i + CASE WHEN y.c & 4 > 0 THEN 2 * (y.c & 7) - 6 ELSE -1 END)), 'o': list_append(a.o, greatest(-32768, least(32767, a.p + (CASE WHEN y.c & 8 > 0 THEN -1 ELSE 1 END) * ((({_STEPS})[a.i + 1] >> 3) + (CASE WHEN y.c & 4 > 0 THEN ({_STEPS})[a.i + 1] ELSE 0 END) + (CASE WHEN y.c & 2 > 0 THEN ({_STEPS})[a.i + 1] >> 1 ELSE 0 END) + (CASE WHEN y.c & 1 > 0 THEN ({_STEPS})[a.i + 1] >> 2 ELSE 0 END))))) }}).o AS o FROM n)
SELECT p_partkey, array_to_string(o, ',') AS ima, array_to_string(list_transform(b, lambda x: (x - 128) * 256), ',') AS pcm8, array_to_string(list_transform(range(len(b) // 2), lambda i: CASE WHEN b[2 * i + 1] >= 128 THEN b[2 * i + 1] * 256 + b[2 * i + 2] - 65536 ELSE b[2 * i + 1] * 256 + b[2 * i + 2] END), ',') AS pcm16 FROM d""")
def decoded_samples(part):
    """Samples of names taken for audio of three codings."""
    data = F.encode("p_name", "UTF-8")
    shown = lambda c: F.array_join(c.cast("array<string>"), ",")
    return spread(part, "p_partkey").select("p_partkey", shown(codecs.samples_of("ima")(data)).alias("ima"), shown(codecs.samples_of("pcm8")(data)).alias("pcm8"), shown(codecs.samples_of("pcm16", True)(data)).alias("pcm16"))


@query("documents", sql="""
WITH d AS (SELECT doc_id, text AS a, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN left(text, 9) || chr(35) || substr(text, 11) ELSE text || 'x' END AS b FROM documents WHERE length(text) >= 12 AND length(text) = octet_length(encode(text)) AND substr(text, 10, 1) <> chr(35))
SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 9 WHEN 2 THEN length(a) END AS exact, CASE doc_id % 3 WHEN 2 THEN length(a) // 2 * 2 + CASE WHEN length(a) % 2 = 1 THEN NULL ELSE 0 END END AS grown FROM d""")
def first_differences(documents):
    """Where payloads begin to differ, byte by byte; and within a wide tolerance of samples."""
    plain = documents.filter("length(text) >= 12 AND length(text) = octet_length(text) AND substr(text, 10, 1) <> '#'")
    text, kind = F.col("text"), F.col("doc_id") % 3
    other = F.when(kind == 0, text).when(kind == 1, F.concat(F.left(text, F.lit(9)), F.lit("#"), F.substring(text, F.lit(11), F.length(text)))).otherwise(F.concat(text, F.lit("x")))
    a, b = F.encode(text, "UTF-8"), F.encode(other, "UTF-8")
    near = codecs.first_difference("s16", 65536)(a, b)
    return plain.select("doc_id", codecs.first_difference()(a, b).alias("exact"), F.when(F.length("text") % 2 == 0, near).alias("grown"))
