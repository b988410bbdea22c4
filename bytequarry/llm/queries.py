"""The opN queries over the synthetic tables, and their DuckDB twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The byte-level BPE file of the packing query; its path comes from the tokenizers' package.
TOKENIZER = "byte_bpe_50k.json"
SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), added=True)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards, grown, uniform_tree

    tree = uniform_tree(SHARDS)
    return assign_shards(_table(spark, sf_dir, "documents"), tree, grown(tree))


def op6_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .transcripts import fit, in_order, observed, recover, written

    ordered = in_order(observed(written(_table(spark, sf_dir, "conversations"), misleading=True)))
    return recover(ordered, fit(ordered)).drop("uid")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import strip_repeats

    return strip_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify, page_evidence

    pages = page_evidence(_table(spark, sf_dir, "pages"))
    found = identify(pages, fit(_table(spark, sf_dir, "documents")), id_col="page_id", declared_col="declared", address_col="url")
    return found.withColumnRenamed("doc_id", "page_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_ensemble import rate

    return rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_decontamination, op3_html_extraction, op4_jaccard_join, op5_sharding, op6_transcripts, op7_substring_dedup, op8_language_id, op9_warc, op10_exact_dedup, op11_rule_ensemble, op12_prefix_trie, op13_collocations]
    return {f.__name__: f for f in found}


#: u in (0, 1) of the hash of a key and a place in the tree, as SQL.
_U = "((('0x' || left(md5(k || '/' || {place}), 13))::BIGINT + 0.5) / 4503599627370496.0)"

ORACLES = {
    "op12_prefix_trie": """
WITH c AS (SELECT list(v ORDER BY i) AS c FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) x(i))),
t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM t, c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.t, [])[1:h.h], h.t[h.h + 1:]) AS t FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, len(t) = d AS ends, md5(CAST(t[1:d] AS VARCHAR) || d) AS k, CASE WHEN d > 0 THEN md5(CAST(t[1:d - 1] AS VARCHAR) || (d - 1)) END AS up, CASE WHEN d > 0 THEN strlen(t[d].x) ELSE 0 END AS b FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM r)),
n AS (SELECT k, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY k),
k AS (SELECT up AS k, count(*) AS n_children FROM n GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (k)),
s AS (SELECT a.k, sum(m.own) AS saved_tokens, count(*) FILTER (m.n_children = 0) AS n_leaves FROM m JOIN p a ON a.conv_id = m.conv_id AND a.d <= m.depth GROUP BY a.k)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (k) LEFT JOIN m u ON u.k = m.up
""",
    "op5_sharding": f"""
WITH t AS (SELECT i AS shard, i // 8 AS region, i % 8 // 4 AS rack, g FROM range({SHARDS}) a(i), (VALUES (0), (1)) b(g) UNION ALL SELECT {SHARDS}, 2, 0, 1),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS b FROM documents),
k AS (SELECT DISTINCT k FROM d),
r AS (SELECT k, g, arg_min(region, -ln({_U.format(place="region")}) / w) AS region FROM k, (SELECT g, region, count(*) AS w FROM t GROUP BY ALL) GROUP BY ALL),
q AS (SELECT k, g, region, arg_min(rack, -ln({_U.format(place="region || '.' || rack")}) / w) AS rack FROM r JOIN (SELECT g, region, rack, count(*) AS w FROM t GROUP BY ALL) USING (g, region) GROUP BY ALL),
s AS (SELECT k, g, arg_min(shard, -ln({_U.format(place="region || '.' || rack || '.' || shard")})) AS shard FROM q JOIN t USING (g, region, rack) GROUP BY ALL),
c AS (SELECT list(v ORDER BY i) AS c FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) x(i))),
h AS (SELECT doc_id, k, length(b) // 2 + 1 AS size, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(b, '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes FROM d),
z AS (SELECT doc_id, k, CAST(size AS BIGINT) AS size, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM h, c)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(o.shard AS INT) AS shard, row_number() OVER (PARTITION BY o.shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, CAST(n.shard AS INT) AS grown_shard
FROM z JOIN s o ON o.k = z.k AND o.g = 0 JOIN s n ON n.k = z.k AND n.g = 1
""",
    "op7_substring_dedup": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
x AS (SELECT doc_id, i, string_agg(word, ' ') OVER v AS k, count(*) OVER v AS c FROM p WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM x WHERE c = 20),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
""",
    "op4_jaccard_join": """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i + 1:i + 5], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
m AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM documents JOIN k ON k.a = doc_id LEFT JOIN m ON m.a = doc_id
""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op13_collocations": """
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d)),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m >= 2),
s AS (SELECT c.lang, c.m, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM c JOIN n ON n.lang = c.lang JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN b z ON z.lang = b.lang AND z.m > b.m AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' ') AND z.a >= b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM b ANTI JOIN o USING (lang, phrase) QUALIFY rank <= 2000
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
             min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM q
""",
}
