"""The library's queries over the synthetic tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytesx, hashx, textx
from ..operators import aggregates, classify, graph, greedy, manifest, names, nearest, ordered, patterns, scans, sets, similar
from ..operators.staging import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(*tables: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of DataFrames as a query over these tables."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


# --- set comparison ------------------------------------------------------------


@query("documents", sql="""
WITH d AS (SELECT doc_id, md5(text) AS digest FROM documents),
g AS (SELECT digest, count(*) AS group_size, min(doc_id) AS first_id FROM d GROUP BY digest HAVING count(*) > 1)
SELECT d.doc_id, d.digest, group_size, first_id FROM d JOIN g USING (digest)""")
def dupes_exact(documents):
    return sets.duplicate_groups(documents, F.md5("text"), "doc_id")


@query("documents", sql="""
SELECT digest, doc_id FROM (SELECT md5(text) AS digest, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dupes_keep_first(documents):
    return sets.first_of_each(documents, F.md5("text"), "doc_id")


@query("documents", sql="""
WITH o AS (SELECT DISTINCT md5(text) AS digest FROM documents WHERE doc_id % 2 = 0),
n AS (SELECT DISTINCT md5(text) AS digest FROM documents WHERE doc_id % 2 = 1)
SELECT coalesce(o.digest, n.digest) AS digest,
       CASE WHEN n.digest IS NULL THEN 'extra_old' WHEN o.digest IS NULL THEN 'extra_new' ELSE 'same' END AS status
FROM o FULL OUTER JOIN n ON o.digest = n.digest""")
def folder_diff(documents):
    side = lambda r: documents.filter(F.col("doc_id") % 2 == r).select(F.md5("text").alias("digest")).distinct().withColumn("same", F.col("digest"))
    return sets.diff(side(0), side(1), "digest", "same")


@query("documents", "labels", sql="SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unreferenced(documents, labels):
    return sets.unreferenced(documents, labels, "doc_id").select("doc_id", "source")


@query("lineitem", sql="""
WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS m FROM lineitem GROUP BY 1)
SELECT min(l_orderkey) AS set_id, count(*) AS owners, CAST(len(m) AS BIGINT) AS n_members FROM s GROUP BY m HAVING count(*) > 1""")
def set_equal_groups(lineitem):
    return sets.equal_sets(lineitem, "l_orderkey", "l_suppkey")


@query("lineitem", sql="""
WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS m, min(l_returnflag) AS name FROM lineitem GROUP BY 1),
c AS (SELECT *, min(l_orderkey) OVER (PARTITION BY m) AS set_id, count(*) OVER (PARTITION BY m) AS a, count(*) OVER (PARTITION BY m, name) AS b FROM s)
SELECT l_orderkey, set_id, CAST(len(m) AS BIGINT) AS n_members, a - b AS partners FROM c WHERE a > b""")
def set_partners(lineitem):
    """Orders whose very suppliers another order of another name has."""
    return sets.set_partners(lineitem, "l_orderkey", "l_suppkey", "l_returnflag")


@query("documents", "labels", sql="""
SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '#?') AS tag FROM documents d LEFT JOIN labels l USING (doc_id)""")
def left_outer_tags(documents, labels):
    return documents.join(labels, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("#?")).alias("tag"))


@query("documents", sql="""
SELECT a.n_chars AS v, a.rows, CAST(sum(b.rows) AS BIGINT) AS matches
FROM (SELECT n_chars, count(*) AS rows FROM documents GROUP BY 1) a
JOIN (SELECT n_chars, count(*) AS rows FROM documents GROUP BY 1) b ON b.n_chars BETWEEN a.n_chars AND a.n_chars + 256
GROUP BY 1, 2""")
def size_range_match(documents):
    return sets.range_count(documents, documents, "n_chars", 256)


@query("part", sql="""
SELECT a.p_name, count(*) AS pairs FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_retailprice <> b.p_retailprice GROUP BY 1""")
def theta_same_key_diff(part):
    return sets.differing_pairs(part, "p_name", "p_retailprice")


@query("documents", "labels", sql="""
WITH d AS (SELECT doc_id, md5(text) AS digest FROM documents),
t AS (SELECT digest, min_by(quality, doc_id) AS q FROM d JOIN labels USING (doc_id) GROUP BY digest)
SELECT d.doc_id, coalesce(l.quality, t.q) AS quality FROM d LEFT JOIN labels l USING (doc_id) LEFT JOIN t USING (digest)""")
def fallback_lookup(documents, labels):
    rows = documents.select("doc_id", F.md5("text").alias("digest"))
    twins = rows.join(labels, "doc_id").groupBy("digest").agg(F.min_by("quality", "doc_id").alias("twin"))
    return sets.fallback_lookup(rows, [("doc_id", labels, "quality"), ("digest", twins, "twin")], "quality").select("doc_id", "quality")


@query("documents", "benchmark", sql="SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def needle_join(documents, benchmark):
    return similar.needle_hits(documents, benchmark, "doc_id", "text", "item_id", "text")


@query("part", sql="""
WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS head, left(split_part(p_name, ' ', 2), 4) AS lead FROM part)
SELECT head, lead, count(*) AS n_parts, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n_pairs FROM p GROUP BY 1, 2""")
def prefix_bucket_join(part):
    keys = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"), F.left(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(4)).alias("lead"))
    return keys.groupBy("head", "lead").agg(F.count("*").alias("n_parts"), F.expr("count(*) * (count(*) - 1) div 2").alias("n_pairs"))


@query("documents", "labels", sql="""
SELECT 'documents' AS side, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'labels', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def missing_both_sides(documents, labels):
    left = sets.unreferenced(documents.select("doc_id"), labels, "doc_id").select(F.lit("documents").alias("side"), F.col("doc_id").alias("id"))
    right = sets.unreferenced(labels.select("doc_id"), documents.filter("lang = 'en'"), "doc_id").select(F.lit("labels").alias("side"), F.col("doc_id").alias("id"))
    return left.unionByName(right)


# --- aggregates ----------------------------------------------------------------


@query("conversations", sql="SELECT role, count(*) AS n FROM conversations GROUP BY role")
def group_counts(conversations):
    return aggregates.group_counts(conversations, "role")


@query("lineitem", sql="""
WITH f AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem),
t AS (SELECT 'L_RETURNFLAG' AS name, l_returnflag AS value, l_orderkey FROM f UNION ALL SELECT 'L_LINESTATUS', l_linestatus, l_orderkey FROM f
      UNION ALL SELECT 'KIND', 'line', l_orderkey FROM f)
SELECT name, min_by(value, l_orderkey) AS value FROM t GROUP BY name
HAVING count(DISTINCT value) = 1 AND count(DISTINCT l_orderkey) = (SELECT count(DISTINCT l_orderkey) FROM f)""")
def const_promotion(lineitem):
    rows = aggregates.unpivoted(lineitem.withColumn("kind", F.lit("line")), F.col("l_orderkey"), ["l_returnflag", "l_linestatus", "kind"])
    return aggregates.constant_values(rows, "entity", "name", "value")


@query("conversations", sql="SELECT conv_id, string_agg(text, ', ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def tag_join(conversations):
    return aggregates.joined_in_order(conversations, ["conv_id"], "turn", F.col("text"), ", ", "joined")


@query("documents", sql="""
WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), g AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch)
SELECT min(ch) AS ch, max(n) AS n FROM g WHERE n = (SELECT max(n) FROM g)""")
def byte_mode(documents):
    return aggregates.mode(aggregates.character_counts(documents, "text"), "ch", "n")


_COSINE = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS match_id,
             round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-8), 6) AS score
      FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, match_id) AS r FROM s)
"""


@query("embeddings", sql=_COSINE + "SELECT vec_id, match_id, score FROM t WHERE r = 1")
def similar_top1(embeddings):
    return similar.best_matches(embeddings, embeddings, "vec_id", "embedding", "label")


@query("embeddings", sql=_COSINE.replace("a.label = b.label AND ", "") + "SELECT vec_id, match_id, score FROM t WHERE r = 1")
def nearest_of_all(embeddings):
    """The most alike of all other vectors, without a block, by cells whose bounds allow it."""
    return nearest.nearest(embeddings, embeddings, "vec_id", "embedding", cell_rows=256).select("vec_id", "match_id", "score")


@query("orders", "customer", sql="""
WITH n AS (SELECT 'o/' || o_orderkey || '_' || o_orderstatus || '.' || left(o_orderpriority, 1) AS name FROM orders),
p AS (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'o/' || c_custkey || '*' WHEN 1 THEN '*' || c_custkey || '_O.?' WHEN 2 THEN '*' || c_custkey % 100 || '?F*' WHEN 3 THEN 'o/?' || c_custkey || '_*' ELSE repeat('?', c_custkey % 17) || CASE WHEN c_custkey % 2 = 0 THEN '*' ELSE '' END END AS pattern FROM customer)
SELECT pattern, count(*) AS n_names, min(name) AS first_name FROM p JOIN n ON name GLOB pattern GROUP BY pattern""")
def many_patterns(orders, customer):
    """Names of orders that patterns of customers fit, met by the patterns' rarest literals."""
    listed = orders.select(F.format_string("o/%d_%s.%s", "o_orderkey", "o_orderstatus", F.left("o_orderpriority", F.lit(1))).alias("name"))
    k = F.col("c_custkey")
    made = F.when(k % 5 == 0, F.format_string("o/%d*", k)).when(k % 5 == 1, F.format_string("*%d_O.?", k)).when(k % 5 == 2, F.format_string("*%d?F*", k % 100)).when(k % 5 == 3, F.format_string("o/?%d_*", k))
    made = made.otherwise(F.concat(F.repeat(F.lit("?"), (k % 17).cast("int")), F.when(k % 2 == 0, "*").otherwise("")))
    found = patterns.hits(listed, customer.select(made.alias("pattern")))
    return found.groupBy("pattern").agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"))


@query("lineitem", sql="""
WITH p AS (SELECT l_suppkey AS l, l_partkey AS r, max(l_extendedprice) AS s FROM lineitem GROUP BY ALL),
o AS (SELECT list({'l': l, 'r': r, 's': s} ORDER BY s DESC, l, r) AS x FROM p),
k AS (SELECT list_reduce(x, lambda a, y: CASE WHEN list_contains(a.u, y.l) OR list_contains(a.w, y.r) THEN a ELSE {'u': list_append(a.u, y.l), 'w': list_append(a.w, y.r), 'k': list_append(a.k, y)} END,
  {'u': []::BIGINT[], 'w': []::BIGINT[], 'k': []::STRUCT(l BIGINT, r BIGINT, s DOUBLE)[]}).k AS k FROM o)
SELECT 'all' AS problem, unnest(k).l AS l_suppkey, unnest(k).r AS l_partkey, unnest(k).s AS price FROM k""")
def greedy_in_rounds(lineitem):
    """One problem over all suppliers and parts: the greedy choice by price, in rounds of pairs that are first on both sides."""
    pairs = lineitem.select(F.lit("all").alias("problem"), "l_suppkey", "l_partkey", F.col("l_extendedprice").alias("price"))
    return greedy.one_to_one_in_rounds(pairs, "problem", "l_suppkey", "l_partkey", "price", task_pairs=1000)


@query("embeddings", sql=_COSINE + "SELECT round((avg(score) + 0.5 * stddev_pop(score)) * 0.65, 6) AS threshold FROM t WHERE r = 1")
def auto_threshold(embeddings):
    best = similar.best_matches(embeddings, embeddings, "vec_id", "embedding", "label")
    return aggregates.auto_threshold(best, "score").select(F.round("threshold", 6).alias("threshold"))


@query("documents", sql="""
SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents GROUP BY ROLLUP (lang, source)""")
def rollup_sizes(documents):
    return documents.rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n", "chars")


# --- order ---------------------------------------------------------------------


@query("events", sql="""
WITH o AS (SELECT *, lag(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS opens FROM events)
SELECT event_id, user_id, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM o""")
def seq_islands(events):
    return ordered.islands_after(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "user_id", "island")


@query("events", sql="""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS carried FROM events""")
def carry_forward(events):
    return ordered.carried(events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("value")), "carried").select("event_id", "carried")


@query("documents", sql="""
WITH o AS (SELECT source, doc_id, n_chars, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM documents)
SELECT source, doc_id, "offset", coalesce(lead("offset") OVER (PARTITION BY source ORDER BY doc_id), "offset" + n_chars) - "offset" AS size FROM o""")
def next_offset_size(documents):
    placed = ordered.running_offsets(documents.select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars")
    return ordered.sizes_by_next(placed, ["source"], "offset", F.col("offset") + F.col("n_chars"), ["doc_id"]).select("source", "doc_id", "offset", "size")


@query("documents", sql="SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents")
def row_in_section(documents):
    return ordered.numbered(documents.select("source", "doc_id"), ["source"], ["doc_id"])


@query("events", sql="""
SELECT event_id, coalesce(value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS falls FROM events""")
def lag_reset(events):
    return ordered.falls(events, ["user_id"], ["ts", "event_id"], "value").select("event_id", "falls")


@query("events", sql="""
WITH o AS (SELECT *, 64 + length(props) AS size, lag(event_type = 'purchase', 1, false) OVER w AS opens FROM events WINDOW w AS (ORDER BY ts, event_id))
SELECT event_id, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS BIGINT) AS island,
       last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS carried,
       CAST(sum(size) OVER w - size AS BIGINT) AS "offset", row_number() OVER w - 1 AS n, coalesce(value < lag(value) OVER w, false) AS falls,
       CAST(coalesce(lead(event_id) OVER w, 0) - event_id AS BIGINT) AS size
FROM o WINDOW w AS (ORDER BY ts, event_id)""")
def scans_of_one_key(events):
    """All events as one run, cut into parts of some thousand rows that are scanned apart."""
    by, hot = ["ts", "event_id"], 1000
    rows = ordered.islands_after(events, [], by, F.col("event_type") == "purchase", hot=hot)
    rows = ordered.carried(rows, [], by, F.when(F.col("event_type") == "signup", F.col("value")), "carried", hot=hot)
    rows = scans.running(rows, [], by, {"offset": scans.Running("sum", 64 + F.length("props"), False), "n": scans.Running("sum", F.lit(1), False)}, hot)
    rows = ordered.sizes_by_next(ordered.falls(rows, [], by, "value", hot=hot), [], "event_id", F.lit(0), by, hot=hot)
    return rows.select("event_id", "island", "carried", "offset", "n", "falls", "size")


@query("conversations", sql="SELECT conv_id, role, string_agg(text, '' ORDER BY turn) AS stream FROM conversations GROUP BY conv_id, role")
def demux_concat(conversations):
    return aggregates.joined_in_order(conversations, ["conv_id", "role"], "turn", F.col("text"), "", "stream")


@query("part", sql="""
SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '#' || lpad(CAST(r - 1 AS VARCHAR), 4, '0') END AS out_name
FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)""")
def duplicate_names(part):
    return ordered.numbered_names(part, "p_name", ["p_partkey"]).select("p_partkey", "out_name")


@query("events", sql="""
SELECT event_id, event_id = first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS is_first FROM events""")
def first_occurrence(events):
    return ordered.first_flag(events, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "is_first")


# --- names ---------------------------------------------------------------------


@query("part", sql="""
WITH w AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS p FROM part),
i AS (SELECT p_name, p, unnest(range(1, len(p) + 1)) AS a FROM w), j AS (SELECT p_name, p, a, unnest(range(a, len(p) + 1)) AS b FROM i)
SELECT DISTINCT p_name, array_to_string(p[a:b], ' ') AS gram FROM j""")
def word_ngrams(part):
    return part.select("p_name").distinct().select("p_name", F.explode(names.subsequences(F.col("p_name"), " ")).alias("gram")).distinct()


@query("benchmark", sql="""
SELECT item_id, 'item_' || lpad(CAST(i AS VARCHAR), 2, '0') || '_' || c AS name
FROM benchmark, (SELECT unnest(range(0, 20)) AS i), (SELECT unnest(['a', 'b']) AS c)""")
def template_expand(benchmark):
    return names.expanded(benchmark.select("item_id", F.lit("item_%02d^20^_%[ab]").alias("template")), "template").select("item_id", "name")


@query("part", sql="""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
b AS (SELECT word, list_transform(range(1, length(word) + 1), lambda i: CAST(ascii(word[i]) AS BIGINT)) AS c FROM w),
r AS (SELECT word, list_reduce(list_prepend(CAST(0 AS BIGINT), c), lambda h, x:
        xor(((((h + x) & 4294967295) * 1025) & 4294967295), (((((h + x) & 4294967295) * 1025) & 4294967295) >> 6))) AS h FROM b),
f AS (SELECT word, (h * 9) & 4294967295 AS h FROM r), g AS (SELECT word, xor(h, h >> 11) AS h FROM f), k AS (SELECT word, (h * 32769) & 4294967295 AS hash FROM g)
SELECT hash, word AS name FROM k WHERE word IN (SELECT split_part(p_name, ' ', 1) FROM part)""")
def joaat_semi(part):
    """All words of names whose hash is that of some name's first word."""
    words = part.select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    known = part.select(hashx.joaat(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("hash")).distinct()
    return names.recovered(words, known)


@query("customer", sql="""
SELECT c_custkey, regexp_replace(replace(CASE WHEN starts_with(c_name, 'Customer') THEN 'c' || substr(c_name, 9) ELSE c_name END, '#', '_'), '0{3}', '-', '') AS new_name
FROM customer""")
def rename_rules(customer):
    rules = [("^Customer", "c"), ("#", "_")]
    return customer.select("c_custkey", F.regexp_replace(textx.renamed(F.col("c_name"), rules), "^([^0]*)000", "$1-").alias("new_name"))


@query("part", sql="""
WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey || ' - ' || p_brand || ' - ' || p_name WHEN 1 THEN p_partkey || ' - ' || p_name
           WHEN 2 THEN p_brand || ' - ' || p_name ELSE p_name END AS name FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN CAST(split_part(name, ' - ', 1) AS BIGINT) END AS track,
       CASE p_partkey % 4 WHEN 0 THEN split_part(name, ' - ', 2) WHEN 2 THEN split_part(name, ' - ', 1) END AS artist,
       CASE p_partkey % 4 WHEN 0 THEN split_part(name, ' - ', 3) WHEN 3 THEN name ELSE split_part(name, ' - ', 2) END AS title
FROM n""")
def filename_tags(part):
    kind, number = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    name = F.when(kind == 0, F.concat_ws(" - ", number, "p_brand", "p_name")).when(kind == 1, F.concat_ws(" - ", number, "p_name")).when(kind == 2, F.concat_ws(" - ", "p_brand", "p_name")).otherwise(F.col("p_name"))
    return part.select("p_partkey", textx.filename_tags(name).alias("t")).select("p_partkey", "t.track", "t.artist", "t.title")


@query("pages", sql=r"""
WITH u AS (SELECT page_id, regexp_replace(substr(url, 11), '^[^/]*/', '') AS p FROM pages)
SELECT page_id, translate(split_part(CASE WHEN p = '' THEN 'index' ELSE p END, '?', 1), '*<>:|"', '______') AS path FROM u""")
def url_path(pages):
    return pages.select("page_id", textx.url_path(F.col("url")).alias("path"))


@query("supplier", sql="SELECT s_suppkey, row_number() OVER (ORDER BY CAST(regexp_extract(s_name, '[0-9]+') AS BIGINT)) AS place FROM supplier")
def natural_sort(supplier):
    return ordered.ranked(supplier.select("s_suppkey", "s_name"), [textx.natural_key(F.col("s_name"))]).select("s_suppkey", "place")


@query("part", sql="SELECT p_partkey, lower(regexp_replace(p_brand, '([a-z])([A-Z0-9])', '\\1_\\2', 'g')) AS word FROM part")
def camel_split(part):
    return part.select("p_partkey", textx.camel_split(F.col("p_brand")).alias("word"))


@query("pages", sql="""
SELECT page_id, CASE WHEN left(html, 14) = '<!DOCTYPE html' THEN 'html' WHEN left(html, 5) = '<?xml' THEN 'xml' ELSE '?' END AS kind FROM pages""")
def magic_classify(pages):
    rules = [(0, b"<!DOCTYPE html", "html"), (0, b"<?xml", "xml")]
    return pages.select("page_id", F.coalesce(classify.by_signature(F.encode("html", "UTF-8"), rules), F.lit("?")).alias("kind"))


@query("documents", sql="SELECT doc_id FROM documents WHERE contains(text, 'password=') OR contains(text, 'token =')")
def needle_any(documents):
    return documents.filter(bytesx.contains_any(F.encode("text", "UTF-8"), [b"password=", b"token ="])).select("doc_id")


@query("events", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(events):
    return events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("documents", sql="""
WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE strlen(text) >= 4)
SELECT doc_id, CAST(('0x' || substr(x, 1, 8)) AS BIGINT) AS be, CAST(('0x' || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2)) AS BIGINT) AS le FROM h""")
def header_u32(documents):
    data = F.encode("text", "UTF-8")
    return documents.filter(F.octet_length("text") >= 4).select("doc_id", bytesx.u32(data, 0, True).alias("be"), bytesx.u32(data, 0).alias("le"))


@query("events", sql="""
SELECT event_id, round(CASE WHEN event_type = 'purchase' THEN value / 4 + (value - value / 4) * 2 + 10 ELSE value END, 6) AS seconds FROM events""")
def loop_seconds(events):
    v = F.col("value")
    end = F.when(F.col("event_type") == "purchase", v)
    return events.select("event_id", F.round(textx.loop_seconds(v, v / 4, end, F.lit(1), F.lit(2), F.lit(10)), 6).alias("seconds"))


@query("region", "nation", "customer", "orders", sql="""
WITH RECURSIVE e AS (
  SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region
      UNION ALL SELECT t.root, e.dst, t.depth + 1 FROM t JOIN e ON e.src = t.node)
SELECT root, depth, count(DISTINCT node) AS reached FROM t GROUP BY root, depth""")
def reachability(region, nation, customer, orders):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    edges = edges.unionByName(customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"))).unionByName(orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")))
    return graph.reach(region.select(name("r", "r_regionkey").alias("node")), edges).groupBy("root", "depth").agg(F.count_distinct("node").alias("reached"))


@query("documents", sql="SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(doc_id AS VARCHAR) AS id FROM documents")
def utf_round_trip(documents):
    """Every document as a self-describing table of one row, parsed back."""
    from ..sources import utf_table

    blobs = documents.select("doc_id", utf_table.packed(F.array(F.lit("id"), F.lit("text")), F.array(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))).alias("content"))
    rows = utf_table.pivoted(utf_table.cells(blobs, "doc_id", "content"), "doc_id", ["id", "text"])
    return rows.select("doc_id", F.md5("text").alias("digest"), "id")


@query("documents", sql="""
SELECT source, doc_id, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS digest FROM documents""")
def archive_round_trip(documents):
    """Documents muxed into an archive for each source and block of ids, then its directory exploded and each slice hashed."""
    from ..sources import toc

    blocks = documents.select(F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string")).alias("path"), F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("payload"))
    out = toc.entries(toc.packed(blocks, "path", "name", "payload"), "path", "content", toc.FLAT)
    return out.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("source"), F.col("name").cast("bigint").alias("doc_id"), F.col("size"), F.md5("payload").alias("digest"))


@query("conversations", sql="""
SELECT conv_id, role, CAST(sum(strlen(text)) AS BIGINT) AS size, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id, role""")
def chunk_round_trip(conversations):
    """Turns muxed into a chunk stream for each conversation, then demuxed into one payload for each speaker."""
    from ..operators import demux
    from ..sources import chunks

    channel = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    rows = conversations.select("conv_id", "turn", channel.alias("channel"), F.encode("text", "UTF-8").alias("payload"))
    found = chunks.walk(chunks.packed(rows, "conv_id", "turn", "channel", "payload"), "conv_id", "content", chunks.TRIMMED)
    joined = demux.streams(found.filter("id = '@SFA' AND type = 0"), ["conv_id", "channel"])
    role = F.when(F.col("channel") == 0, "user").when(F.col("channel") == 1, "assistant").otherwise("system")
    return joined.select("conv_id", role.alias("role"), F.length("payload").cast("bigint").alias("size"), F.md5("payload").alias("digest"))


@query("documents", "labels", sql="""
WITH d AS (SELECT source, doc_id, '# ' || lang AS tag, source || '/' || doc_id || '.txt' AS file FROM documents),
l AS (SELECT source, doc_id * 2 AS seq, tag AS line FROM d UNION ALL SELECT source, doc_id * 2 + 1, file FROM d)
SELECT source, seq, line FROM l""")
def tag_manifest(documents, labels):
    files = documents.select("source", "doc_id", F.array(F.concat(F.lit("# "), F.col("lang")), F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("lines"))
    return manifest.lines(files, ["source"], "doc_id", "lines", 2)


@query("documents", sql="""
WITH d AS (SELECT doc_id, text, hex(encode(text)) AS x FROM documents WHERE octet_length(encode(text)) >= 2),
b AS (SELECT doc_id, text, xor(xor(('0x' || substr(x, 1, 2))::BIGINT, 107), 95) AS a, xor(xor(('0x' || substr(x, 3, 2))::BIGINT, 101), (95 * 21) & 255) AS b FROM d)
SELECT doc_id, (a & 15) * 16 + (a >> 4) AS first, (b & 15) * 16 + (b >> 4) AS second, md5(text) AS digest FROM b""")
def codec_round_trip(documents):
    """Each text through an XOR key, a keystream and a nibble swap, what comes out first, and back."""
    from ..functions import codecs

    data = F.encode("text", "UTF-8")
    there = bytesx.nibble_swap(codecs.xor_lcg(codecs.xor_key(data, b"key"), 0x5F, 0x15))
    back = codecs.xor_key(codecs.xor_lcg(bytesx.nibble_swap(F.col("x")), 0x5F, 0x15), b"key")
    return spread(documents, "doc_id", rows=2000).filter("octet_length(text) >= 2").select("doc_id", there.alias("x")).select("doc_id", bytesx.u8(F.col("x"), 0).alias("first"), bytesx.u8(F.col("x"), 1).alias("second"), F.md5(back).alias("digest"))


@query("events", sql="""
SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def hourly_totals(events):
    """Batch form of the streaming extension's tumbling window."""
    return events.groupBy("user_id", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


from . import columns, formats  # noqa: E402, F401  (they register their queries)
