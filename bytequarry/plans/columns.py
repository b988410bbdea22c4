"""Queries over the column functions and the set, order, name and graph operators, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytesx, codecs, hashx, textx
from ..operators import aggregates, graph, manifest, names, ordered, sets, similar
from ..operators.staging import spread
from ..sources import blobs, lines
from .queries import query

# --- bytes ---------------------------------------------------------------------


@query("events", sql="""
WITH e AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS v FROM events)
SELECT event_id, (v >> 5) & 127 AS field, array_to_string(list_filter(range(32), lambda i: (v >> i) & 1 = 1), ',') AS bits,
       ((v & 255) << 24) + (((v >> 8) & 255) << 16) + (((v >> 16) & 255) << 8) + (v >> 24) AS swapped,
       (((v & 255) >> 3) | ((v & 255) << 5)) & 255 AS rotated, greatest(-32768, least(32767, (v >> 12) - 500000)) AS clamped,
       CASE WHEN v & 1 <> 0 THEN (v % 1000) * 2048 ELSE v % 1000 END AS placed, CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS signed
FROM e""")
def bit_fields(events):
    v = F.col("v")
    e = events.select("event_id", ((F.col("event_id") * 2654435761) % 4294967296).alias("v"))
    return e.select(
        "event_id", bytesx.bit_field(v, 5, 7).alias("field"), F.array_join(bytesx.set_bits(v).cast("array<string>"), ",").alias("bits"), bytesx.swap32(v).alias("swapped"),
        bytesx.rotate_right8(v.bitwiseAND(255), 3).alias("rotated"), bytesx.clamp16(F.shiftright(v, 12) - 500000).alias("clamped"), bytesx.scaled_offset(v % 1000, v).alias("placed"), bytesx.signed(v, 32).alias("signed"),
    )


@query("documents", sql="""
WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE strlen(text) >= 16),
b AS (SELECT doc_id, x, list_transform(range(16), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM h)
SELECT doc_id, b[1] AS u8, b[2] + 256 * b[3] AS u16, b[4] * 256 + b[5] AS u16be, b[6] + 256 * b[7] + 65536 * b[8] AS u24,
       CAST(('0x' || substr(x, 17, 16))::UBIGINT AS VARCHAR) AS u64be, least(b[1] * 16777216 + b[2] * 65536 + b[3] * 256 + b[4], b[4] * 16777216 + b[3] * 65536 + b[2] * 256 + b[1]) AS guess,
       b[1] * 16777216 + b[2] * 65536 + b[3] * 256 + b[4] < b[4] * 16777216 + b[3] * 65536 + b[2] * 256 + b[1] AS big,
       CASE WHEN b[4] * 16777216 + b[3] * 65536 + b[2] * 256 + b[1] > 1879048192 THEN b[1] * 16777216 + b[2] * 65536 + b[3] * 256 + b[4] ELSE b[4] * 16777216 + b[3] * 65536 + b[2] * 256 + b[1] END AS ranged,
       substr(x, 5, 6) AS cut, substr(x, 1, 4) || '0102' || substr(x, 9, 24) AS patched,
       substr(x, 8, 1) || substr(x, 7, 1) || substr(x, 10, 1) || substr(x, 9, 1) AS nibbles
FROM b""")
def typed_reads(documents):
    data = F.col("d")
    d = documents.filter(F.octet_length("text") >= 16).select("doc_id", F.encode("text", "UTF-8").alias("d"))
    guess, big = bytesx.u32_guess(data, 0)
    return d.select(
        "doc_id", bytesx.u8(data, 0).alias("u8"), bytesx.u16(data, 1).alias("u16"), bytesx.u16(data, 3, True).alias("u16be"), bytesx.u24(data, 5).alias("u24"), bytesx.u64(data, 8, True).cast("string").alias("u64be"), guess.alias("guess"), big.alias("big"),
        bytesx.u32_unless_over(data, 0, 0x70000000).alias("ranged"), F.hex(bytesx.slice_bytes(data, 2, 3)).alias("cut"), F.hex(bytesx.patch(bytesx.slice_bytes(data, 0, 16), 2, bytesx.le_bytes(F.lit(0x0201), 2))).alias("patched"), F.hex(bytesx.nibble_swap(bytesx.slice_bytes(data, 3, 2))).alias("nibbles"),
    )


@query("documents", sql="""
WITH h AS (SELECT doc_id, text, hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, NOT regexp_matches(text, '[\\x00-\\x08]') AND (strlen(text) = length(text) OR NOT (substr(x, 1, 2) >= '80' OR substr(x, 3, 2) >= '80' OR substr(x, 5, 2) >= '80')) AS textual,
       base64(encode(text)) AS packed, md5(text) AS digest, sha1(text) AS sha1
FROM h""")
def text_bytes(documents):
    some = documents.filter("text IS NOT NULL")
    packed = F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit(""))
    return some.select("doc_id", bytesx.looks_textual(F.encode("text", "UTF-8")).alias("textual"), packed.alias("packed"), F.md5(bytesx.from_base64(packed)).alias("digest"), F.sha1("text").alias("sha1"))


# --- hashes --------------------------------------------------------------------

_BYTES = "list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"
_JOAAT = "list_reduce(list_prepend({1}::BIGINT, " + _BYTES + "), lambda h, x: xor(((h + x) & 4294967295) * 1025 & 4294967295, (((h + x) & 4294967295) * 1025 & 4294967295) >> 6))"
_FNV = "list_reduce(list_prepend({1}::BIGINT, " + _BYTES + "), lambda h, x: xor((h * 16777619) & 4294967295, x))"


@query("part", sql=f"""
WITH w AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS head, substr(p_name, length(split_part(p_name, ' ', 1)) + 1) AS tail FROM part),
r AS (SELECT *, {_JOAAT.format("p_name", "0")} AS h FROM w), f AS (SELECT *, (h * 9) & 4294967295 AS g FROM r), k AS (SELECT *, (xor(g, g >> 11) * 32769) & 4294967295 AS joaat FROM f)
SELECT p_name, joaat, joaat AS resumed, joaat & 536870911 AS low29, list_reduce(list_prepend(0::BIGINT, {_BYTES.format("p_name")}), lambda h, x: (((h + x) & 4294967295) * 141) & 4294967295) AS affine,
       {_FNV.format("p_name", "2166136261")} AS fnv, {_FNV.format("head", "2166136261")} AS before
FROM k""")
def name_hashes(part):
    """Hashes of names, one of them resumed after its first word, one peeled back to it."""
    w = part.select("p_name").distinct().withColumn("head", F.split_part("p_name", F.lit(" "), F.lit(1)))
    tail = F.substring("p_name", F.length("head") + 1, F.length("p_name"))
    resumed = hashx.joaat(tail, hashx.joaat(F.col("head"), finish=False))
    return w.select("p_name", hashx.joaat(F.col("p_name")).alias("joaat"), resumed.alias("resumed"), hashx.low29(resumed).alias("low29"), hashx.affine_hash(F.col("p_name")).alias("affine"), hashx.fnv1(F.col("p_name")).alias("fnv"), hashx.fnv1_without_suffix(hashx.fnv1(F.col("p_name")), tail).alias("before"))


@query("part", sql=f"""
WITH t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 14514072000185962306::UBIGINT) ELSE a >> 1 END) AS v FROM range(256) x(i))),
w AS (SELECT DISTINCT p_name, {_BYTES.format("p_name")} AS b FROM part)
SELECT p_name, lower(lpad(hex(xor(list_reduce(list_prepend(18446744073709551615::UBIGINT, b::UBIGINT[]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1])), 18446744073709551615::UBIGINT)), 16, '0')) AS crc64 FROM w, t""")
def crc64_names(part):
    return part.select("p_name").distinct().select("p_name", hashx.crc64(F.encode("p_name", "UTF-8")).alias("crc64"))


# --- texts ---------------------------------------------------------------------


@query("documents", sql="""
WITH p AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.tar.gz' AS path FROM documents)
SELECT doc_id, regexp_extract(path, '^(.*)/', 1) AS folder, 'd' || doc_id || '.tar.gz' AS base, 'd' || doc_id || '.tar' AS stem, 'gz' AS ext, 'tar.gz' AS exts FROM p""")
def path_parts(documents):
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".tar.gz")))
    return documents.select("doc_id", textx.directory(path).alias("folder"), textx.base_name(path).alias("base"), textx.stem(path).alias("stem"), textx.extension(path).alias("ext"), textx.extension(path, 2).alias("exts"))


@query("part", sql="""
SELECT p_partkey, regexp_replace(p_name || ' é', '[^\\x00-\\x7F]', '_', 'g') AS plain, replace(p_brand || '*<?', '*<?', '___') AS safe, p_partkey AS lead,
       'bgm_' || CASE WHEN p_size < 100 THEN lpad(CAST(p_size AS VARCHAR), 3, '0') ELSE CAST(p_size AS VARCHAR) END AS decimal_name, 'out/x-' || p_size AS filled,
       regexp_replace(p_type, '(STEEL|TIN)$', '') AS cut, CASE WHEN length(p_name) > 9 THEN left(p_name, 9) || '...' ELSE p_name END AS short,
       len(list_filter(range(1, least(length(p_name), length(p_type)) + 1), lambda i: left(lower(p_name), i) = left(lower(p_type), i))) AS common,
       array_to_string(list_transform(list_filter(list_transform(string_split(p_type || ' ' || p_type, ' '), lambda x, i: {'x': x, 'i': i}), lambda s: list_position(string_split(p_type || ' ' || p_type, ' '), s.x) = s.i), lambda s: s.x), ', ') AS once,
       CAST(p_partkey * 48000 // 44100 AS BIGINT) AS rescaled
FROM part""")
def text_rules(part):
    name, kind = F.col("p_name"), F.col("p_type")
    hexed = F.concat(F.lit("bgm_"), F.hex(F.col("p_size").cast("bigint")))
    return part.select(
        "p_partkey", textx.ascii_only(F.concat(name, F.lit(" é"))).alias("plain"), textx.safe_name(F.concat("p_brand", F.lit("*<?"))).alias("safe"), textx.leading_int(F.concat(F.col("p_partkey").cast("string"), F.lit(" x"))).alias("lead"), textx.hex_suffix_to_decimal(hexed).alias("decimal_name"),
        F.concat(textx.filled(F.lit("{dir}/{a}-"), {"dir": "out", "a": "x"}), F.col("p_size").cast("string")).alias("filled"), textx.without_suffixes(kind, ["STEEL", "TIN"]).alias("cut"), textx.truncated(name, 9).alias("short"),
        textx.common_prefix(F.lower(name), F.lower(kind)).cast("bigint").alias("common"), textx.joined_once(F.split(F.concat(kind, F.lit(" "), kind), " ")).alias("once"), textx.rescaled(F.col("p_partkey")).alias("rescaled"),
    )


@query("part", sql="""
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_type || '(' || p_brand || '), ' || p_name, '[^A-Za-z0-9_./-@]'), lambda x: x <> ''), '|') AS tokens FROM part""")
def tokenized_names(part):
    return part.select("p_partkey", F.array_join(textx.name_tokens(F.concat("p_type", F.lit("("), "p_brand", F.lit("), "), "p_name")), "|").alias("tokens"))


@query("part", sql="""
WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.OGG' ELSE '.txt' END AS name FROM part)
SELECT p_partkey, name FROM n WHERE (name LIKE '%.wav' OR name LIKE '%.OGG') AND NOT (name LIKE '%a _%' ) AND regexp_matches(lower(name), 'red|blue|b')""")
def wildcard_filters(part):
    ext = F.when(F.col("p_partkey") % 3 == 0, ".wav").when(F.col("p_partkey") % 3 == 1, ".OGG").otherwise(".txt")
    named = part.select("p_partkey", F.concat("p_name", ext).alias("name"))
    return lines.kept(named, "name", ["*.wav", "*.OGG"], ["*a ?*"]).filter(textx.contains_any_case(F.col("name"), ["RED", "Blue", "b"]))


@query("documents", sql="""
WITH f AS (SELECT DISTINCT source || '/' || CASE WHEN doc_id % 2 = 0 THEN 'File' ELSE 'FILE' END || doc_id // 2 % 100 || CASE WHEN doc_id % 5 = 0 THEN '.TXTP' ELSE '.wem' END AS path FROM documents),
k AS (SELECT path FROM f WHERE regexp_matches(path, '/(File|FILE)[0-9]?[0-9]\\.(wem|TXTP)$') AND path NOT LIKE '%.TXTP')
SELECT min(path) AS path FROM k GROUP BY upper(path)""")
def file_filters(documents):
    """Paths by patterns, less an extension, each once whatever its case."""
    name = F.when(F.col("doc_id") % 2 == 0, "File").otherwise("FILE")
    ext = F.when(F.col("doc_id") % 5 == 0, ".TXTP").otherwise(".wem")
    files = documents.select(F.concat("source", F.lit("/"), name, (F.floor(F.col("doc_id") / 2) % 100).cast("string"), ext).alias("path"))
    return blobs.unique_by_case(blobs.filtered(files, ["File*", "FILE*"], ("txtp",)))


@query("part", "region", sql="""
WITH f AS (SELECT DISTINCT 'x/' || replace(p_name, ' ', '_') || '.bin' AS path FROM part), p AS (SELECT lower(substr(r_name, 2, 1)) AS c FROM region)
SELECT path FROM f WHERE EXISTS (SELECT 1 FROM p WHERE regexp_matches(path, '^x/' || c || '.*_..*\\.bin$'))""")
def listed_files(part, region):
    """Files that the patterns of a list name; comments name none."""
    files = part.select(F.concat(F.lit("x/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".bin")).alias("path")).distinct()
    listed = region.select(F.explode(F.array(F.concat(F.lower(F.substring("r_name", 2, 1)), F.lit("*_?*.bin")), F.lit("# *"), F.lit(""))).alias("line"))
    return blobs.from_list(files, listed)


@query("part", sql="""
SELECT DISTINCT regexp_replace(file, '\\.[^.]*$', '') AS stem, track, artist, title FROM (
  SELECT lpad(CAST(p_size AS VARCHAR), 2, '0') || ' ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' [' || p_brand || ']' ELSE '' END || '.mp3' AS file,
         CAST(p_size AS BIGINT) AS track, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS artist, p_name AS title FROM part)""")
def filename_patterns(part):
    """Tags of file names by the first of some patterns with named groups."""
    brand = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" ["), "p_brand", F.lit("]"))).otherwise("")
    file = F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(" "), "p_name", brand, F.lit(".mp3"))
    tags = textx.pattern_tags(textx.stem(F.col("file")), [r"(?<track>\d+) (?<title>.+) \[(?<artist>[^\]]+)\]", r"(?<track>\d+) (?<title>.+)"], ["track", "artist", "title"])
    return part.select(file.alias("file")).select(textx.stem(F.col("file")).alias("stem"), tags.alias("t")).select("stem", F.col("t.track").cast("bigint").alias("track"), "t.artist", "t.title").distinct()


@query("lineitem", sql="""
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 0 THEN -96 ELSE 20 * log10(l_quantity / 50) END, 6) AS decibels, 'v' || CAST(round(l_quantity / 50, 2) AS DECIMAL(9, 2)) AS command FROM lineitem""")
def volume_gains(lineitem):
    share = F.col("l_quantity") / 50
    return lineitem.select("l_orderkey", "l_linenumber", F.round(textx.decibels(share), 6).alias("decibels"), textx.volume_command(share).alias("command"))


# --- lines ---------------------------------------------------------------------


@query("nation", "region", sql="""
SELECT n_nationkey AS seq, r_name AS section, n_name AS line FROM nation JOIN region ON n_regionkey = r_regionkey""")
def line_sections(nation, region):
    """Names under headings, back to (section, line)."""
    heads = region.select((F.col("r_regionkey") * 1000).alias("seq"), F.concat(F.lit("### "), "r_name", F.lit(" NAMES")).alias("line"), F.lit(-1).alias("key"))
    body = nation.select((F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("seq"), F.col("n_name").alias("line"), F.col("n_nationkey").alias("key"))
    found = lines.sections(heads.unionByName(body).withColumn("file", F.lit("f")), ["file"])
    return found.select(F.col("key").alias("seq"), "section", "line")


@query("part", sql="""
SELECT p_partkey AS seq, (p_partkey * 2654435761) % 4294967296 AS hash, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS name FROM part WHERE p_partkey % 3 <> 2""")
def hash_lines(part):
    code = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex((F.col("p_partkey") * 2654435761) % 4294967296)), 8, "0"))
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(code, F.lit(": "), "p_name")).when(F.col("p_partkey") % 3 == 1, code).otherwise(F.col("p_name"))
    return lines.hashed_names(part.select(F.col("p_partkey").alias("seq"), line.alias("line")))


@query("supplier", sql="""
WITH s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier), n AS (SELECT *, unnest(range(1, 4)) AS i FROM s)
SELECT s_nationkey AS list, 'http://h' || s_nationkey || '.example/a/f' || s_suppkey || '_' || lpad(CAST(i AS VARCHAR), 2, '0') || '.bin' AS url,
       'n' || s_nationkey || '/a/f' || s_suppkey || '_' || lpad(CAST(i AS VARCHAR), 2, '0') || '.bin' AS path FROM n""")
def address_lists(supplier):
    """Lists with directives and numbered addresses, to addresses and local paths."""
    nation, key = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    lead = supplier.select("s_nationkey").distinct().select(F.col("s_nationkey").alias("list"), F.posexplode(F.array(F.lit("# a list"), F.concat(F.lit("prefix: http://h"), nation, F.lit(".example")), F.concat(F.lit("out: n"), nation), F.lit("suffix: .bin"), F.lit("filter: *a/f*"))).alias("seq", "line"))
    body = supplier.select(F.col("s_nationkey").alias("list"), (F.col("s_suppkey") * 2 + 100).cast("int").alias("seq"), F.concat(F.lit("a/f"), key, F.lit("_^%02i#1#3^")).alias("line"))
    other = supplier.select(F.col("s_nationkey").alias("list"), (F.col("s_suppkey") * 2 + 101).cast("int").alias("seq"), F.concat(F.lit("b/f"), key).alias("line"))
    return lines.addresses(lead.unionByName(body).unionByName(other), ["list"]).select("list", "url", "path")


# --- sets ----------------------------------------------------------------------


@query("documents", sql="""
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN '.ogg' WHEN doc_id % 2 = 0 THEN '.wav' END AS option FROM documents WHERE doc_id % 4 <> 3""")
def existing_extension(documents):
    """The first extension under which a file of the item's name is there."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    here = documents.filter("doc_id % 2 = 0").select(F.concat(name, F.lit(".wav")).alias("path")).unionByName(documents.filter("doc_id % 4 IN (0, 1)").select(F.concat(name, F.lit(".ogg")).alias("path")))
    found = sets.first_existing(documents.select(name.alias("item")), here, "item", [".wav", ".ogg"])
    return found.select(F.substring("item", 2, 20).cast("bigint").alias("doc_id"), "option")


@query("documents", sql="""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || '/d' || doc_id ELSE 'd' || doc_id END AS name FROM documents WHERE doc_id % 3 < 2""")
def suffix_match(documents):
    """Paths by the longest known name they end with."""
    base = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    known = documents.filter("doc_id % 3 < 2").select(base.alias("name")).unionByName(documents.filter("doc_id % 3 = 0").select(F.concat_ws("/", F.col("lang"), base).alias("name"))).distinct()
    items = documents.select("doc_id", F.concat_ws("/", F.col("source"), F.col("lang"), base).alias("item"))
    return items.join(sets.suffix_lookup(items, known, "item", "name"), "item").select("doc_id", "name")


@query("part", sql="""
SELECT p_partkey, p_size AS value FROM part""")
def spelling_retries(part):
    """A table whose keys are spelled in one of three ways, looked up by trying them in turn."""
    stem = F.concat(F.lit("Key_"), F.col("p_partkey").cast("string"))
    kept = F.when(F.col("p_partkey") % 3 == 0, stem).when(F.col("p_partkey") % 3 == 1, F.lower(stem)).otherwise(F.upper(stem))
    found = sets.key_spellings(part.select(stem.alias("item")), part.select(kept.alias("key"), F.col("p_size").alias("value")), "item", "key", "value", [F.col("item"), F.lower("item"), F.upper("item")])
    return found.select(F.substring("item", 5, 20).cast("bigint").alias("p_partkey"), "value")


@query("orders", sql="""
WITH x AS (SELECT DISTINCT o_orderkey AS id, 'o' || o_orderkey AS s, o_orderstatus FROM orders)
SELECT s AS stem, s || '.hd' AS hd, s || '.bd' AS bd, CASE WHEN o_orderstatus = 'F' THEN s || '.sq' END AS sq FROM x WHERE o_orderstatus <> 'P'""")
def file_bundles(orders):
    """Files of one stem side by side; one extension is optional."""
    stem = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    exts = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("hd"), F.lit("bd"), F.lit("sq"))).when(F.col("o_orderstatus") == "P", F.array(F.lit("hd"))).otherwise(F.array(F.lit("hd"), F.lit("bd")))
    files = orders.select(F.explode(exts).alias("e"), stem.alias("s")).select(F.concat_ws(".", "s", "e").alias("path"))
    return sets.bundle(files, textx.stem(F.col("path")), textx.extension(F.col("path")), {"hd": True, "bd": True, "sq": False})


@query("part", sql="""
SELECT DISTINCT id FROM (SELECT p_partkey % 256 + (p_partkey % 4) * 268435456 AS id FROM part UNION ALL SELECT p_partkey % 256 + 805306368 FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT p_partkey % 256 + 268435456 FROM part WHERE p_partkey % 4 = 2)""")
def implied_ids(part):
    ids = part.select((F.col("p_partkey") % 256 + (F.col("p_partkey") % 4) * 0x10000000).alias("id"))
    return sets.with_implied_ids(ids, "id", 0xF0000000, {0x10000000: 0x30000000, 0x20000000: 0x10000000})


@query("part", sql="""
SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_size = 1 AND b.p_size = 2 AND b.p_partkey BETWEEN a.p_partkey AND a.p_partkey + 40""")
def range_pairs(part):
    left = part.filter("p_size = 1").select(F.col("p_partkey").alias("a"))
    right = part.filter("p_size = 2").select(F.col("p_partkey").alias("b"))
    return sets.range_join(left, right, "a", "b", 40)


@query("documents", sql="""
WITH d AS (SELECT doc_id, CASE WHEN length(text) >= 40 THEN md5(substr(text, 41)) END AS digest FROM documents),
g AS (SELECT digest, count(*) AS group_size, min(doc_id) AS first_id FROM d GROUP BY digest HAVING count(*) > 1)
SELECT d.doc_id, d.digest, group_size, first_id FROM d JOIN g USING (digest)""")
def dupes_after_head(documents):
    """Texts that are alike but for what precedes character 40."""
    return sets.duplicate_groups(documents, sets.head_tail_key(F.col("text"), 40), "doc_id")


@query("part", sql="""
WITH p AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS head, split_part(p_name, ' ', 2) AS rest FROM part)
SELECT head, left(rest, 4) AS lead, p.id, min(p.id) OVER w AS first_id, count(*) OVER w AS members FROM p WINDOW w AS (PARTITION BY head, left(rest, 4)) QUALIFY count(*) OVER w > 1""")
def prefix_members(part):
    """Members of groups that share a word and the first four characters of the next."""
    rows = part.select(F.col("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("rest"))
    return sets.prefix_groups(rows, "id", ["head"], F.col("rest"), 4).select("head", F.col("prefix").alias("lead"), "id", "first_id", "members")


@query("orders", "customer", sql="""
SELECT o_orderkey, c_custkey, c_mktsegment || '_' || row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS name FROM orders JOIN customer ON o_custkey = c_custkey""")
def one_to_many_names(orders, customer):
    """Each customer's orders with a name made of the customer's and a counter."""
    joined = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    return ordered.numbered(joined, ["c_custkey"], ["o_orderkey"]).select("o_orderkey", "c_custkey", F.concat_ws("_", "c_mktsegment", F.col("n").cast("string")).alias("name"))


@query("part", sql="""
WITH w AS (SELECT DISTINCT p_name FROM part), h AS (SELECT DISTINCT md5(lower(p_name || '.wav')) AS id, p_name FROM part WHERE p_size <= 25)
SELECT DISTINCT id AS hash, w.p_name || '.wav' AS name FROM w JOIN h ON md5(lower(w.p_name || '.wav')) = id""")
def computed_name_semi(part):
    """Names with an extension whose hash, by another rule, is known."""
    made = part.select(F.concat("p_name", F.lit(".wav")).alias("name")).distinct()
    known = part.filter("p_size <= 25").select(F.md5(F.lower(F.concat("p_name", F.lit(".wav")))).alias("hash"))
    return names.recovered(made, known, hasher=lambda c: F.md5(F.lower(c)))


# --- aggregates and order --------------------------------------------------------


@query("events", sql="""
SELECT user_id, min_by(event_type, event_id) AS first, max_by(event_type, event_id) AS last, arg_min(value, event_id) FILTER (value IS NOT NULL) AS known FROM events GROUP BY user_id""")
def first_and_last(events):
    a = aggregates.first_wins(events, "user_id", "event_id", "event_type").withColumnRenamed("event_type", "first")
    b = aggregates.last_wins(events, "user_id", "event_id", "event_type").withColumnRenamed("event_type", "last")
    c = aggregates.first_wins(events.filter("value IS NOT NULL"), "user_id", "event_id", "value").withColumnRenamed("value", "known")
    return a.join(b, "user_id").join(c, "user_id", "left")


@query("embeddings", sql="""
SELECT label, round(avg(embedding[1]), 5) AS x0, round(avg(embedding[64]), 5) AS x63, bool_or(embedding[1] > 0.2) AS a0, bool_or(embedding[2] > 0.35) AS a1 FROM embeddings GROUP BY label""")
def vector_groups(embeddings):
    """Mean vectors, and which of two places any row of a group has active."""
    mean = aggregates.mean_vector(embeddings.withColumn("v", F.col("embedding").cast("array<double>")), ["label"], "v", 64)
    flags = embeddings.withColumn("on", F.array(F.get("embedding", F.lit(0)) > 0.2, F.get("embedding", F.lit(1)) > 0.35))
    active = aggregates.any_active(flags, ["label"], "on", 2)
    return mean.join(active, "label").select("label", F.round(F.get("mean", F.lit(0)), 5).alias("x0"), F.round(F.get("mean", F.lit(63)), 5).alias("x63"), F.get("active", F.lit(0)).alias("a0"), F.get("active", F.lit(1)).alias("a1"))


@query("documents", sql="""
WITH b AS (SELECT unnest(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x, i: xor(('0x' || x)::INT, ((i - 1) % 8)::INT * 3))) AS v FROM documents)
SELECT v AS byte, count(*) AS n FROM b GROUP BY v""")
def byte_histogram(documents):
    """How often each byte value occurs once a mask by position is taken out."""
    data = documents.select(F.encode("text", "UTF-8").alias("d"))
    return aggregates.byte_counts(data, "d", bytes(3 * i for i in range(8)))


@query("events", sql="""
WITH e AS (SELECT user_id, event_type AS stem, CAST(floor(value * 10) AS BIGINT) % 5 AS name FROM events)
SELECT user_id AS track, stem, array_to_string(list_sort(list(DISTINCT CAST(name AS VARCHAR))), ',') AS names FROM e WHERE name IS NOT NULL GROUP BY ALL""")
def events_by_stem(events):
    rows = events.select(F.col("user_id").alias("track"), F.col("event_type").alias("stem"), (F.floor(F.col("value") * 10) % 5).cast("string").alias("name")).filter("name IS NOT NULL")
    return aggregates.merged_names(rows, ["track"], "stem", "name").select("track", "stem", F.array_join("names", ",").alias("names"))


@query("events", sql="""
WITH o AS (SELECT event_id, user_id, ts, value, event_type, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events)
SELECT event_id, CASE WHEN event_type = 'click' THEN last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS used FROM o""")
def used_once(events):
    rows = ordered.one_shot(events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("value")), F.col("event_type") == "click", "used")
    return rows.select("event_id", "used")


@query("events", sql="""
WITH v AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'signup' THEN value END AS v FROM events)
SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS folder FROM v""")
def carried_folder(events):
    rows = ordered.carried_or_first(events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("value")), "folder")
    return rows.select("event_id", "folder")


@query("events", sql="""
WITH k AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(sum(CASE WHEN before IS NULL OR before <> event_type OR before = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM k""")
def change_islands(events):
    rows = ordered.islands_on_change(events, ["user_id"], ["ts", "event_id"], F.col("event_type"), F.col("event_type") == "error", "island")
    return rows.select("event_id", "island")


@query("events", sql="""
SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM events""")
def start_islands(events):
    return ordered.islands(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "island")


@query("conversations", sql=r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(replace(text, chr(10), chr(10) || chr(10) || chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10) || chr(10)), chr(10)), 1) - 1 AS seq FROM conversations),
b AS (SELECT *, trim(line) = '' AND coalesce(lag(trim(line) = '') OVER (PARTITION BY conv_id, turn ORDER BY seq), false) AS drop FROM l)
SELECT conv_id, turn, CAST(seq AS BIGINT) AS seq, line FROM b WHERE NOT drop""")
def single_blanks(conversations):
    rows = conversations.select("conv_id", "turn", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit("\n\n\n")), "\n")).alias("seq", "line"))
    return ordered.without_repeated_blanks(rows, ["conv_id", "turn"], "seq", "line").select("conv_id", "turn", F.col("seq").cast("bigint").alias("seq"), "line")


@query("part", sql="""
WITH l AS (SELECT p_brand AS section, p_partkey AS seq, CASE p_partkey % 4 WHEN 0 THEN '# ' || p_name WHEN 1 THEN p_size || ' ' || p_name ELSE p_name END AS line FROM part),
k AS (SELECT *, CASE WHEN line LIKE '#%' THEN 2 WHEN regexp_matches(line, '^[0-9]') THEN 1 ELSE 0 END AS kind FROM l)
SELECT section, seq, line, row_number() OVER (PARTITION BY section ORDER BY kind, CASE WHEN kind < 2 THEN lower(line) END, seq) AS rank FROM k""")
def sorted_sections(part):
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("# "), "p_name")).when(F.col("p_partkey") % 4 == 1, F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    return ordered.section_sorted(part.select(F.col("p_brand").alias("section"), F.col("p_partkey").alias("seq"), line.alias("line")), "section", "seq", "line").select("section", "seq", "line", "rank")


@query("lineitem", sql="""
SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_suppkey END NULLS LAST, coalesce(CASE WHEN l_linestatus = 'O' THEN l_linenumber END, 0), l_orderkey, l_linenumber) AS place FROM lineitem""")
def composite_order(lineitem):
    """Places in an order of several keys: what lacks the first comes last, a missing second counts as 0."""
    solved = F.when(F.col("l_returnflag") != "A", F.col("l_suppkey"))
    keys = [solved.isNull(), solved, F.coalesce(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")), F.lit(0)), F.col("l_orderkey"), F.col("l_linenumber")]
    return ordered.ranked(lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey"), keys).select("l_orderkey", "l_linenumber", "place")


# --- names -----------------------------------------------------------------------


@query("part", sql="""
WITH w AS (SELECT DISTINCT replace(p_name, ' ', '_') AS n FROM part), p AS (SELECT n, string_split(n, '_') AS p FROM w)
SELECT n, 'pair' AS kind, array_to_string(p[i:i + 1], '_') AS made FROM (SELECT n, p, unnest(range(1, len(p))) AS i FROM p)
UNION SELECT n, 'split', unnest([n, array_to_string(p[2:], '_'), array_to_string(p[:len(p) - 1], '_')]) FROM p WHERE len(p) > 1
UNION SELECT n, 'trim', substr(n, i + 1) FROM (SELECT n, unnest(range(0, 3)) AS i FROM w) UNION SELECT n, 'trim', left(n, length(n) - i) FROM (SELECT n, unnest(range(0, 3)) AS i FROM w)
UNION SELECT n, 'case', unnest([n, lower(n), upper(n), upper(left(n, 1)) || lower(substr(n, 2))]) FROM w""")
def name_variants(part):
    """Pairs of neighbouring parts, halves, trimmed forms and spellings of names."""
    w = part.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("n")).distinct()
    made = lambda kind, c: w.select("n", F.lit(kind).alias("kind"), F.explode(c).alias("made"))
    n = F.col("n")
    every = made("pair", names.ngrams(n, 2)).unionByName(w.filter(F.contains("n", F.lit("_"))).select("n", F.lit("split").alias("kind"), F.explode(names.split_variants(n)).alias("made")))
    return every.unionByName(made("trim", names.trimmed(n, 2))).unionByName(made("case", names.cases(n))).distinct()


@query("part", sql="""
WITH w AS (SELECT DISTINCT replace(p_name, ' ', '_') AS n FROM part), p AS (SELECT n, string_split(n, '_') AS p FROM w WHERE contains(n, '_')), i AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p)
SELECT array_to_string(list_transform(p, lambda x, k: CASE WHEN k = i THEN '%s' ELSE x END), '_') AS template, count(*) AS n FROM i GROUP BY 1""")
def mined_templates(part):
    return names.mined_templates(part.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("n")).distinct(), "n")


@query("part", "region", sql="""
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part), t AS (SELECT 'se_%s_' || lower(r_name) AS template FROM region)
SELECT replace(template, '%s', word) AS name FROM w, t""")
def template_words(part, region):
    """Every word in every template."""
    words = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    return names.candidates(words, region.select(F.concat(F.lit("se_%s_"), F.lower("r_name")).alias("template")))


@query("region", "nation", sql="""
WITH r AS (SELECT lower(left(r_name, 2)) AS r FROM region)
SELECT 'product' AS kind, r.r || '_' || n_name AS name FROM r, nation
UNION ALL SELECT 'repeat', a.r || '_' || b.r FROM r a, r b UNION ALL SELECT 'once', a.r || '_' || b.r || '_' || c.r FROM r a, r b, r c WHERE a.r <> b.r AND a.r <> c.r AND b.r <> c.r""")
def name_products(region, nation):
    """Products of sections, and combinations of parts with and without repeats."""
    r = region.select(F.lower(F.left("r_name", F.lit(2))).alias("p"))
    made = lambda kind, df: df.select(F.lit(kind).alias("kind"), "name")
    return made("product", names.products([r, nation.select(F.col("n_name").alias("p"))], "p")).unionByName(made("repeat", names.combinations(r, "p", 2))).unionByName(made("once", names.combinations(r, "p", 3, repeat=False)))


@query("region", sql="SELECT printf('bgm_%04d.wav', i) AS name FROM (SELECT unnest(range(10, 12010, 3)) AS i)")
def numbered_range(region):
    """Names of a numeric range, made in parallel."""
    return names.number_names(region.sparkSession, "bgm_%04d.wav", 10, 12010, 3, 8)


@query("nation", sql="""
SELECT n_nationkey, printf('v%09d_%x', i, j) AS name FROM nation, (SELECT unnest(range(0, 40, 4)) AS i), (SELECT unnest(range(0, 16)) AS j)""")
def wide_templates(nation):
    """Templates with a wide number field and a hexadecimal one."""
    return names.expanded(nation.select("n_nationkey", F.lit("v%09d:4:^40^_%x").alias("template")), "template").select("n_nationkey", "name")


@query("part", "supplier", sql="""
WITH f AS (SELECT DISTINCT p_size AS hash, p_brand || p_size AS name FROM part),
c AS (SELECT s_nationkey AS ctx_order, 'c' || s_nationkey AS ctx, s_suppkey % 50 + 1 AS hash FROM supplier), o AS (SELECT hash, min(ctx_order) AS ctx_order, min_by(ctx, ctx_order) AS ctx FROM c GROUP BY hash)
SELECT f.hash, name, ctx, row_number() OVER (ORDER BY ctx_order NULLS LAST, f.hash, lower(name), name) AS place FROM f LEFT JOIN o USING (hash)""")
def owned_names(part, supplier):
    """Names under the first context that has their hash, those of none last."""
    found = part.select(F.col("p_size").cast("bigint").alias("hash"), F.concat("p_brand", F.col("p_size").cast("string")).alias("name")).distinct()
    contexts = supplier.select(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("ctx"), F.col("s_nationkey").alias("ctx_order"), (F.col("s_suppkey") % 50 + 1).alias("hash"))
    owned = names.owned_names(found, contexts)
    placed = ordered.ranked(owned, [F.col("ctx_order").isNull(), F.col("ctx_order"), F.col("hash"), F.lower("name"), F.col("name")])
    return placed.select("hash", "name", "ctx", "place")


@query("part", sql=f"""
WITH RECURSIVE w AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS w FROM part), l AS (SELECT DISTINCT unnest(string_split(w, '')) AS c FROM w),
t AS (SELECT DISTINCT substr(w, i, 2) AS pair, substr(w, i + 2, 1) AS n FROM (SELECT w, unnest(range(1, length(w) - 1)) AS i FROM w)),
f AS (SELECT c AS name, 1 AS k FROM l UNION ALL SELECT f.name || x, k + 1 FROM f, LATERAL (SELECT c AS x FROM l WHERE length(f.name) < 2 UNION ALL SELECT n FROM t WHERE length(f.name) >= 2 AND pair = right(f.name, 2)) WHERE k < 8),
h AS (SELECT DISTINCT name, {_FNV.format("name", "2166136261")} AS hash FROM f), k AS (SELECT DISTINCT {_FNV.format("w", "2166136261")} AS hash FROM w)
SELECT hash, name FROM h SEMI JOIN k USING (hash)""")
def pruned_search(part):
    """Names letter by letter, pruned by known triples, kept where their hash is known."""
    w = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct()
    letters = w.select(F.explode(F.split("w", "")).alias("letter")).filter("letter <> ''").distinct()
    triples = w.filter("length(w) > 2").select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 2)).alias("i")).select(F.substring("w", F.col("i"), F.lit(2)).alias("pair"), F.substring("w", F.col("i") + 2, F.lit(1)).alias("next")).distinct()
    known = w.select(hashx.fnv1(F.col("w")).alias("hash")).distinct()
    return names.frontier_search(letters, triples, known, 8).distinct()


@query("documents", sql="""
WITH l AS (SELECT doc_id AS seq, text AS line FROM documents WHERE text IS NOT NULL),
s AS (SELECT * FROM l WHERE length(line) - length(replace(line, '_', '')) <= 20 AND NOT starts_with(line, '#')),
t AS (SELECT seq, unnest(list_filter(regexp_split_to_array(line, '[^A-Za-z0-9_./-@]'), lambda x: x <> '')) AS t FROM s),
b AS (SELECT seq, 0 AS o, lower(regexp_replace(t, '([a-z])([A-Z0-9])', '\\1_\\2', 'g')) AS t FROM t UNION ALL SELECT seq, 1, t FROM t)
SELECT lower(t) AS word, max_by(t, seq * 2 + o) AS original FROM b GROUP BY lower(t) HAVING count(DISTINCT t) = 1""")
def word_list(documents):
    """Words of sane lines, with camel-split forms, that are spelled in one way."""
    rows = documents.filter("text IS NOT NULL").select(F.col("doc_id").alias("seq"), F.col("text").alias("line"))
    return names.word_list(rows, "line", max_length=1 << 30).filter("alone").select("word", "original")


@query("orders", sql="""
WITH o AS (SELECT o_custkey, list(o_orderkey % 97 ORDER BY o_orderkey)[1:6] AS v FROM orders GROUP BY o_custkey HAVING count(*) >= 3),
p AS (SELECT o_custkey, list_transform(v, lambda x, i: list_position(list_sort(list_transform(v, lambda y, j: y * 100 + j)), x * 100 + i) - 1) AS p FROM o)
SELECT o_custkey, array_to_string(p, ' ') AS permutation, true AS sorted FROM p""")
def swap_lists(orders):
    """Swaps that bring a permutation into order, applied to it."""
    v = F.slice(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x % 97), 1, 6)
    rows = orders.groupBy("o_custkey").agg(v.alias("v"), F.count("*").alias("n")).filter("n >= 3")
    marked = F.array_sort(F.transform("v", lambda x, i: x * 100 + i + 1))
    rows = rows.withColumn("m", marked).withColumn("p", F.transform("v", lambda x, i: (F.array_position("m", x * 100 + i + 1) - 1).cast("int")))
    applied = F.aggregate(names.swaps(F.col("p")), F.col("p"), lambda a, s: F.transform(a, lambda x, i: F.when(i == s["a"], F.get(a, s["b"])).when(i == s["b"], F.get(a, s["a"])).otherwise(x)))
    return rows.select("o_custkey", F.array_join(F.col("p").cast("array<string>"), " ").alias("permutation"), (applied == F.array_sort("p")).alias("sorted"))


# --- graphs ------------------------------------------------------------------------


@query("region", "nation", "customer", sql="""
SELECT 'r' || n_regionkey AS root, 'c' || c_custkey AS leaf, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def leaves_in_order(region, nation, customer):
    """Leaves below each root in the order of a depth-first walk."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(name("r", "n_regionkey").alias("src"), F.col("n_nationkey").cast("int").alias("ordinal"), name("n", "n_nationkey").alias("dst"))
    edges = edges.unionByName(customer.select(name("n", "c_nationkey").alias("src"), F.col("c_custkey").cast("int").alias("ordinal"), name("c", "c_custkey").alias("dst")))
    found = graph.ordered_leaves(region.select(name("r", "r_regionkey").alias("node")), edges, F.col("dst").startswith("c"))
    return ordered.numbered(found, ["root"], ["place"], "at").select("root", "leaf", (F.col("at") + 1).cast("bigint").alias("place"))


@query("nation", "customer", "orders", sql="""
WITH a AS (SELECT n_regionkey AS r, n_nationkey AS n FROM nation), b AS (SELECT c_nationkey AS n, c_mktsegment AS s, min(c_custkey) AS i FROM customer GROUP BY ALL),
c AS (SELECT c_mktsegment AS s, o_orderpriority AS p, min(o_orderkey) AS j FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
f AS (SELECT r, p, min({'n': n, 'i': i, 'j': j}) AS k FROM a JOIN b USING (n) JOIN c USING (s) GROUP BY ALL)
SELECT 'r' || r AS root, row_number() OVER (PARTITION BY r ORDER BY k) AS place, 'r' || r || ' #' || row_number() OVER (PARTITION BY r ORDER BY k) || ': ' || p AS line FROM f""")
def ordered_playlist(nation, customer, orders):
    """Lines of each root's leaves in the order in which a walk first meets them; segments are shared by all nations."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(name("r", "n_regionkey").alias("src"), F.col("n_nationkey").cast("long").alias("ordinal"), name("n", "n_nationkey").alias("dst"))
    edges = edges.unionByName(customer.groupBy(name("n", "c_nationkey").alias("src"), name("s ", "c_mktsegment").alias("dst")).agg(F.min("c_custkey").alias("ordinal")))
    edges = edges.unionByName(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(name("s ", "c_mktsegment").alias("src"), name("leaf ", "o_orderpriority").alias("dst")).agg(F.min("o_orderkey").alias("ordinal")))
    found = graph.first_leaves(nation.select(name("r", "n_regionkey").alias("node")), edges, F.col("dst").startswith("leaf "))
    return found.select("root", "place", F.concat("root", F.lit(" #"), F.col("place").cast("string"), F.lit(": "), F.substring("leaf", 6, 1000)).alias("line"))


@query("nation", "region", sql="""
WITH own AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS base, [n_nationkey % 7, n_nationkey % 3] AS v FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, [r_regionkey, 100] FROM region),
j AS (SELECT o.node, coalesce(b.v, []) || o.v AS v FROM own o LEFT JOIN own b ON o.base = b.node)
SELECT node, array_to_string(list_transform(list_filter(list_transform(v, lambda x, i: {'x': x, 'i': i}), lambda s: list_position(v, s.x) = s.i), lambda s: s.x), ' ') AS "values" FROM j""")
def inherited_values(nation, region):
    """A base's values first, then one's own, each once."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    own = nation.select(name("n", "n_nationkey").alias("node"), F.array(F.col("n_nationkey") % 7, F.col("n_nationkey") % 3).alias("values"))
    own = own.unionByName(region.select(name("r", "r_regionkey").alias("node"), F.array(F.col("r_regionkey"), F.lit(100)).alias("values")))
    base = nation.select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("base"))
    return graph.inherited(own, base).select("node", F.array_join(F.col("values").cast("array<string>"), " ").alias("values"))


@query("region", "nation", "supplier", sql="""
SELECT r_name AS path, r_name AS line FROM region UNION ALL SELECT r_name || '/' || n_name, '  ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || '/' || n_name || '/' || s_name, '    ' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def printed_tree(region, nation, supplier):
    """Paths of a tree and its printed lines."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = region.select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nodes = nodes.unionByName(nation.select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))).unionByName(supplier.select(name("s", "s_suppkey").alias("node"), name("n", "s_nationkey").alias("parent"), F.col("s_name").alias("name")))
    return graph.printed(graph.tree_paths(nodes).withColumn("name", textx.base_name(F.col("path"))))


@query("customer", "orders", sql="SELECT c_custkey AS node FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_custkey > 3)")
def orphan_nodes(customer, orders):
    """Nodes that no resolvable reference names."""
    target = F.when(F.col("o_custkey") > 3, F.col("o_custkey")).when(F.col("o_custkey") == 1, F.lit(0xFFFFFFFF)).when(F.col("o_custkey") == 2, F.lit(-1)).otherwise(F.lit(0))
    refs = orders.filter("o_orderstatus = 'F'").select(target.cast("bigint").alias("node"))
    return graph.orphans(customer.select(F.col("c_custkey").alias("node")), refs.filter(graph.resolvable(F.col("node"))))


# --- manifests -----------------------------------------------------------------------


@query("part", sql="""
WITH p AS (SELECT p_brand AS album, p_partkey AS k, p_name AS title, left(p_brand, 5) AS maker, CASE WHEN p_size % 2 = 0 THEN p_type END AS kind FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY k) AS f FROM p),
s AS (SELECT album, count(DISTINCT upper(title)) = 1 AS t1, count(DISTINCT upper(kind)) = 1 AND count(kind) = count(*) AS k1, min_by(title, k) AS tv, min_by(kind, k) AS kv, min_by(maker, k) AS mv FROM p GROUP BY album),
l AS (SELECT album, 0 AS f, list_filter([CASE WHEN t1 THEN '# @TITLE@ ' || tv END, '# @ARTIST@ ' || mv, CASE WHEN k1 THEN '# @GENRE@ ' || kv END], lambda x: x IS NOT NULL) AS l FROM s
      UNION ALL SELECT r.album, f, list_filter([CASE WHEN NOT t1 THEN '# %TITLE% ' || title END, CASE WHEN NOT k1 THEN '# %GENRE% ' || kind END, 'f' || k || '.ogg'], lambda x: x IS NOT NULL) FROM r JOIN s USING (album))
SELECT album, CAST(f * 4 + generate_subscripts(l, 1) - 1 AS BIGINT) AS seq, unnest(l) AS line FROM l""")
def tag_playlists(part):
    """Playlists with tags, those that a whole album shares once at its top."""
    tags = part.select(F.col("p_brand").alias("album"), F.col("p_partkey").alias("k"), F.col("p_name").alias("title"), F.left("p_brand", F.lit(5)).alias("maker"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("kind"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".ogg")).alias("file"))
    return manifest.playlist(tags, ["album"], ["k"], "file", {"title": "TITLE", "maker": "ARTIST", "kind": "GENRE"}).select("album", F.col("seq").cast("bigint").alias("seq"), "line")


@query("documents", sql="""
SELECT source || '/a b/' || doc_id || '.txt' AS src, source || '/a_b/' || doc_id || '.txt' AS dst FROM documents
UNION ALL SELECT DISTINCT source || '/a b', source || '/a_b' FROM documents""")
def planned_moves(documents):
    """Renames of files and folders, as a plan."""
    file = F.concat("source", F.lit("/a b/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    paths = documents.select(file.alias("p")).unionByName(documents.select(F.concat("source", F.lit("/a b")).alias("p")).distinct()).unionByName(documents.select(F.col("source").alias("p")).distinct())
    return manifest.moves(paths, F.col("p"), F.replace("p", F.lit(" "), F.lit("_")))


@query("events", sql="""
SELECT event_id, CASE WHEN event_type = 'click' AND CAST(value * 100 AS BIGINT) > 0 THEN printf('f%d.wav #I %d %d', event_id, user_id, CAST(value * 100 AS BIGINT)) END AS line,
       round(CASE WHEN event_type = 'view' THEN value * 2 - value / 2 ELSE value + 1 END, 6) AS seconds FROM events""")
def loop_commands(events):
    """Text commands of looped files, and their times."""
    end = F.when(F.col("event_type") == "click", F.round(F.col("value") * 100).cast("bigint"))
    before = F.when(F.col("event_type") == "view", F.col("value") / 2).otherwise(-1.0)
    from ..operators import timing

    return events.select("event_id", manifest.loop_command(F.format_string("f%d.wav", "event_id"), F.col("user_id"), end).alias("line"), F.round(timing.looped_time(F.col("value"), before, 2), 6).alias("seconds"))


# --- similarity ------------------------------------------------------------------------


@query("embeddings", sql="""
WITH e AS (SELECT vec_id, label % 3 AS side, label, CAST(embedding AS DOUBLE[]) AS v, 60 + vec_id % 90 AS tempo, (vec_id % 17) / 16 AS loudness, 30 + vec_id % 200 AS seconds FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS match_id, 1 / (1 + abs(a.tempo - b.tempo)) AS t, 1 / (1 + abs(a.loudness - b.loudness)) AS l, 1 / (1 + sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))) AS e,
  list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-8) AS c
  FROM e a JOIN e b ON a.side = 0 AND b.side = 1 AND a.label + 1 = b.label AND abs(a.tempo - b.tempo) <= 20 AND abs(a.seconds - b.seconds) <= 0.1 * greatest(a.seconds, b.seconds)),
s AS (SELECT vec_id, match_id, round((0.25 * t + 0.25 * l + 1.0 * e + 0.25 * c) / 1.75, 6) AS score FROM p)
SELECT vec_id, match_id, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, match_id) = 1""")
def weighted_matches(embeddings):
    """The best match by a weighted score of tempo, loudness, distance and cosine, after cut-offs of tempo and duration."""
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), (60 + F.col("vec_id") % 90).alias("tempo"), ((F.col("vec_id") % 17) / 16).alias("loudness"), (30 + F.col("vec_id") % 200).alias("seconds"))
    left, right = rows.filter("label % 3 = 0").withColumn("block", F.col("label") + 1), rows.filter("label % 3 = 1").withColumn("block", F.col("label"))
    return similar.weighted_matches(left, right, "vec_id", "block", vector="v", tempo="tempo", loudness="loudness", seconds="seconds", tempo_apart=20, seconds_apart=0.1)


@query("lineitem", "customer", sql=f"""
WITH p AS (SELECT DISTINCT 'Order' || l_orderkey AS prefix FROM lineitem), s AS (SELECT DISTINCT '_' || l_returnflag || l_linestatus AS suffix FROM lineitem),
i AS (SELECT DISTINCT 'order' || c_custkey * 4 || '_' || CASE c_custkey % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'rf' ELSE 'af' END AS name FROM customer),
a AS (SELECT prefix, suffix, lower(prefix || suffix) AS name FROM p, s), u AS (SELECT name FROM a UNION SELECT name FROM i),
r AS (SELECT name, {_JOAAT.format("name", "0")} AS h FROM u), f AS (SELECT name, (h * 9) & 4294967295 AS g FROM r), k AS (SELECT name, (xor(g, g >> 11) * 32769) & 4294967295 AS hash FROM f)
SELECT k.hash, prefix, suffix FROM a JOIN k USING (name) WHERE k.hash IN (SELECT hash FROM k SEMI JOIN i USING (name))""")
def names_in_the_middle(lineitem, customer):
    """Names of two parts whose hash is known: prefixes hashed once, known ids pulled back over each suffix."""
    prefixes = lineitem.select(F.concat(F.lit("Order"), F.col("l_orderkey").cast("string")).alias("prefix"))
    suffixes = lineitem.select(F.concat(F.lit("_"), "l_returnflag", "l_linestatus").alias("suffix"))
    ending = F.when(F.col("c_custkey") % 3 == 0, "no").when(F.col("c_custkey") % 3 == 1, "rf").otherwise("af")
    known = customer.select(hashx.joaat(F.concat(F.lit("order"), (F.col("c_custkey") * 4).cast("string"), F.lit("_"), ending)).alias("hash"))
    return names.met_in_the_middle(prefixes, suffixes, known)


@query("embeddings", sql="""
WITH e AS (SELECT vec_id, label, (vec_id % 17) / 16 AS loudness, list_transform(range(8), lambda i: CAST(embedding[i * 8 + 1:i * 8 + 8] AS DOUBLE[])) AS f FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS match_id, 1 / (1 + abs(a.loudness - b.loudness)) AS l,
  list_transform(a.f, lambda x: list_transform(b.f, lambda y: sqrt(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))))) AS c
  FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
w AS (SELECT vec_id, match_id, l, list_last(list_reduce(list_prepend([0::DOUBLE, 'inf', 'inf', 'inf', 'inf', 'inf', 'inf', 'inf', 'inf'], c), lambda u, row:
  list_reduce(list_prepend(['inf'::DOUBLE], list_transform(range(1, 9), lambda j: [row[j] + 0::DOUBLE, least(u[j], u[j + 1])])), lambda t, x: list_append(t, x[1] + least(x[2], list_last(t)))))) / 16 AS d FROM p),
s AS (SELECT vec_id, match_id, round((0.25 * l + 2.5 / (1 + d)) / 2.75, 6) AS score FROM w)
SELECT vec_id, match_id, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, match_id) = 1""")
def warped_matches(embeddings):
    """The best match of each sequence of eight frames by warping and loudness, among those of its label."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding"), i * 8 + 1, F.lit(8)))
    rows = embeddings.select("vec_id", "label", frames.alias("frames"), ((F.col("vec_id") % 17) / 16).alias("loudness"))
    return similar.weighted_matches(rows, rows, "vec_id", "label", frames="frames", loudness="loudness", exclude_self=True)


@query("part", sql="""
WITH p AS (SELECT p_brand AS problem, p_partkey % 6 AS l, p_size % 6 AS r, max(round(p_retailprice, 2)) AS score FROM part GROUP BY ALL),
o AS (SELECT problem, list({'l': l, 'r': r, 's': score} ORDER BY score DESC, l, r) AS x FROM p GROUP BY problem),
k AS (SELECT problem, list_reduce(list_prepend({'u': []::BIGINT[], 'w': []::BIGINT[], 'k': []::STRUCT(l BIGINT, r INT, s DOUBLE)[], 'l': -1::BIGINT, 'r': -1, 's': 0::DOUBLE}, list_transform(x, lambda y: {'u': []::BIGINT[], 'w': []::BIGINT[], 'k': []::STRUCT(l BIGINT, r INT, s DOUBLE)[], 'l': y.l, 'r': y.r, 's': y.s})),
  lambda a, y: CASE WHEN list_contains(a.u, y.l) OR list_contains(a.w, y.r) THEN a ELSE {'u': list_append(a.u, y.l), 'w': list_append(a.w, y.r), 'k': list_append(a.k, {'l': y.l, 'r': y.r, 's': y.s}), 'l': y.l, 'r': y.r, 's': y.s} END).k AS k FROM o)
SELECT problem, unnest(k).l AS l, CAST(unnest(k).r AS BIGINT) AS r, unnest(k).s AS score FROM k""")
def greedy_pairs(part):
    """The greedy one-to-one choice in each problem."""
    pairs = part.groupBy(F.col("p_brand").alias("problem"), (F.col("p_partkey") % 6).alias("l"), (F.col("p_size") % 6).cast("bigint").alias("r")).agg(F.max(F.round("p_retailprice", 2)).alias("score"))
    return similar.one_to_one(pairs, "problem", "l", "r", "score")


# --- codecs ----------------------------------------------------------------------------

_OUT = "array_to_string(list_transform({0}, lambda x: lpad(upper(to_base(x, 16)), 2, '0')), '')"


@query("part", sql=f"""
WITH b AS (SELECT p_partkey, p_name, {_BYTES.format("p_name")} AS b FROM part)
SELECT p_partkey, {_OUT.format("list_transform(b, lambda x, i: CASE WHEN i <= 2 THEN x ELSE xor(x, ([11, 22, 33])[(i - 3) % 3 + 1]) END)")} AS keyed,
       {_OUT.format("list_transform(b[4:], lambda x, i: xor(x, b[(i - 1) % 3 + 1]))")} AS leading,
       {_OUT.format("list_transform(b, lambda x, i: xor(x, xor(xor(90, ((i - 1) // 2 % 4) << 1), ((i - 1) // 32 % 8) << 5)))")} AS positional,
       {_OUT.format("list_transform(b, lambda x, i: xor(x, list_reduce(list_prepend(95::BIGINT, range(i - 1)), lambda k, y: (k * 21) & 255)))")} AS stream,
       {_OUT.format("list_transform(b, lambda x, i: xor(list_reduce(list_prepend(0::BIGINT, range(8)), lambda a, j: (a << 1) | ((x >> j) & 1)), ([7, 9])[(i - 1) % 2 + 1]))")} AS reversed,
       {_OUT.format("list_transform(b, lambda x, i: (((xor(x, ([7, 9])[(i - 1) % 2 + 1]) >> 3) | (xor(x, ([7, 9])[(i - 1) % 2 + 1]) << 5)) & 255))")} AS rotated,
       {_OUT.format("list_transform(b, lambda x, i: xor(x, ('0x' || substr(md5(translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')), 2 * ((i - 1) % 16) + 1, 2))::BIGINT))")} AS named
FROM b""")
def xor_ciphers(part):
    """Names under each of the XOR families."""
    data, name = F.encode("p_name", "UTF-8"), F.col("p_name")
    return spread(part, "p_partkey").select(
        "p_partkey", F.hex(codecs.xor_key(data, bytes([11, 22, 33]), 2)).alias("keyed"), F.hex(codecs.xor_leading_key(data, 3)).alias("leading"), F.hex(codecs.xor_positional(data, 90)).alias("positional"), F.hex(codecs.xor_lcg(data, 0x5F, 0x15)).alias("stream"),
        F.hex(codecs.bit_reverse_xor(data, bytes([7, 9]))).alias("reversed"), F.hex(codecs.xor_rotate(data, bytes([7, 9]), 3)).alias("rotated"), F.hex(codecs.xor_by_name(data, name)).alias("named"),
    )
