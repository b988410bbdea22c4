"""Name recovery: generate candidates, hash them, keep those whose hash is known."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashx import fnv1, fnv1_without_suffix, joaat, joaat_state, joaat_without_suffix, low29
from ..functions.textx import camel_split, name_tokens
from .staging import held, light

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def subsequences(text: Column, sep: str = "_") -> Column:
    """All runs of neighbouring parts: a_b_c gives a, b, c, a_b, b_c, a_b_c; each once."""
    parts = F.split(text, sep)
    n = F.size(parts)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.array_join(F.slice(parts, at, size), sep)))))


def ngrams(text: Column, size: int, sep: str = "_") -> Column:
    """Runs of exactly `size` parts; none if there are fewer."""
    parts = F.split(text, sep)
    return F.when(F.size(parts) >= size, F.transform(F.sequence(F.lit(1), F.size(parts) - size + 1), lambda at: F.array_join(F.slice(parts, at, size), sep))).otherwise(F.array().cast("array<string>"))


def split_variants(text: Column, sep: str = "_") -> Column:
    """The text, what follows its first separator, and what precedes its last."""
    return F.array_distinct(F.filter(F.array(text, F.regexp_extract(text, f"^[^{sep}]*{sep}(.*)$", 1), F.regexp_extract(text, f"^(.*){sep}[^{sep}]*$", 1)), lambda x: x != ""))


def trimmed(text: Column, most: int = 3) -> Column:
    """The text without up to `most` first, or last, characters."""
    k = F.sequence(F.lit(0), F.least(F.lit(most), F.length(text) - 1))
    return F.array_distinct(F.concat(F.transform(k, lambda i: F.substring(text, i + 1, F.length(text))), F.transform(k, lambda i: F.substring(text, F.lit(1), F.length(text) - i))))


def cases(text: Column) -> Column:
    return F.array_distinct(F.array(text, F.lower(text), F.upper(text), F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, F.lit(2), F.length(text))))))


#: Fields of a template: a letter, one of some characters, a number of some width, step and limit.
_FIELD = re.compile(r"%(?:(c)|\[([^\]]*)\]|(0?)(\d*)([idxX])(?::(\d+):)?(?:\^(\d+)\^)?)")


def expanded(templates: DataFrame, template: str) -> DataFrame:
    """templates with one row per expansion in `name`.

    %c is a letter, %[abc] one of these, %0Nd:step:^limit^ a number (i, d, x,
    X; all of N digits, from 0 by step, below limit); %s stays for a word. A
    field's values are a sequence that is exploded, so a wide field is as many
    rows and never a list in one task. The templates' distinct forms come to
    the driver, for each is a plan of its own: they are a short list.
    """
    forms = [r[0] for r in templates.select(template).filter(F.col(template).isNotNull()).distinct().collect()]
    out = None
    for form in forms:
        rows, at = templates.filter(F.col(template) == form).withColumn("name", F.lit("")), 0
        for m in _FIELD.finditer(form):
            letter, some, zero, digits, kind, step, limit = m.groups()
            rows = rows.withColumn("name", F.concat("name", F.lit(form[at : m.start()])))
            at = m.end()
            if kind is None:
                rows = rows.withColumn("__v", F.explode(F.array(*map(F.lit, LETTERS if letter else some)))) if letter or some else rows.withColumn("__v", F.lit(None).cast("string")).filter(F.lit(False))
            else:
                width, base = int(digits or 1), 10 if kind in "id" else 16
                last = (int(limit) if limit and int(limit) else base**width) - 1
                rows = _numbers(rows, last, int(step or 0) or 1)
                shown = F.col("__n").cast("string") if base == 10 else F.hex("__n") if kind == "X" else F.lower(F.hex("__n"))
                rows = rows.withColumn("__v", F.when(F.length(shown) >= width, shown).otherwise(F.lpad(shown, width, "0" if zero else " "))).drop("__n")
            rows = rows.withColumn("name", F.concat("name", "__v")).drop("__v")
        rows = rows.withColumn("name", F.concat("name", F.lit(form[at:])))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else templates.withColumn("name", F.lit("")).limit(0)


def _numbers(rows: DataFrame, last: int, step: int, at_once: int = 1_000_000) -> DataFrame:
    """rows with __n: 0, step, 2 * step ... up to last, by sequences of at most `at_once`."""
    n = last // step + 1
    starts = rows.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"), F.lit(at_once).cast("bigint"))))
    if n > at_once:
        starts = starts.repartition(min(1000, -(-n // at_once)), "__s")
    ends = F.least(F.col("__s") + (at_once - 1), F.lit(n - 1).cast("bigint"))
    return starts.withColumn("__n", F.explode(F.transform(F.sequence("__s", ends), lambda i: i * step))).drop("__s")


def mined_templates(words: DataFrame, word: str, sep: str = "_") -> DataFrame:
    """(template, n): names with one part replaced by %s, and how many names give it."""
    parts = F.split(F.col(word), sep)
    out = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.transform(parts, lambda p, k: F.when(k == i - 1, F.lit("%s")).otherwise(p)), sep))
    return words.filter(F.size(parts) > 1).select(F.explode(out).alias("template")).groupBy("template").agg(F.count("*").alias("n"))


def word_list(lines: DataFrame, line: str, max_length: int = 500, max_parts: int = 20) -> DataFrame:
    """(word, original, alone): tokens of sane lines and their camel-split forms; of several spellings the last by order is shown, alone says that there is no other. lines: (seq, line).

    Lines are split once and equal tokens meet before anything else is done
    with them, so all but the split costs as much as there are different ones.
    """
    sane = (F.length(line) <= max_length) & (F.length(line) - F.length(F.replace(F.col(line), F.lit("_"))) <= max_parts) & ~F.col(line).startswith("#")
    tokens = lines.filter(sane).select("seq", F.explode(name_tokens(F.col(line))).alias("t")).groupBy("t").agg(F.max("seq").alias("seq"))
    both = tokens.select("seq", F.posexplode(F.array(camel_split(F.col("t")), F.col("t"))).alias("as_is", "t"))
    return both.groupBy(F.lower("t").alias("word")).agg(F.max_by("t", F.struct("seq", "as_is")).alias("original"), (F.min("t") == F.max("t")).alias("alone"))


def candidates(words: DataFrame, templates: DataFrame, word: str = "word", template: str = "template") -> DataFrame:
    """(name): every template with every word. The template list is a small dimension, broadcast after a count; words stay where they are."""
    return words.crossJoin(light(templates.select(template))).select(F.replace(F.col(template), F.lit("%s"), F.col(word)).alias("name"))


def products(sections: list[DataFrame], col: str, sep: str = "_") -> DataFrame:
    """Names of one part from each section, in order. Sections after the first are short lists, broadcast after a count; the names stay where their first parts are."""
    out = sections[0].select(F.col(col).alias("name"))
    for s in sections[1:]:
        out = out.crossJoin(light(s.select(F.col(col).alias("__p")))).select(F.concat("name", F.lit(sep), "__p").alias("name"))
    return out


def recovered(names: DataFrame, known: DataFrame, name: str = "name", hash_col: str = "hash", fuzzy: bool = False, hasher: Callable[[Column], Column] = joaat) -> DataFrame:
    """(hash, name): names whose hash is known; fuzzy compares the low 29 bits of both. hasher: another hash of a text, such as F.crc32."""
    h = hasher(F.col(name))
    found = names.select(F.col(name), (low29(h) if fuzzy else h).alias(hash_col))
    ids = known.select((low29(F.col(hash_col)) if fuzzy else F.col(hash_col)).alias(hash_col)).distinct()
    return found.join(ids, hash_col, "left_semi").select(hash_col, name)


#: Rolling hashes whose steps can be undone: the state after a prefix, and of an id the state before a suffix.
REVERSIBLE: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "joaat": (lambda prefix: joaat(prefix, finish=False), lambda value, suffix: joaat_without_suffix(joaat_state(value), suffix)),
    "fnv1": (fnv1, fnv1_without_suffix),
}


def met_in_the_middle(prefixes: DataFrame, suffixes: DataFrame, known: DataFrame, prefix: str = "prefix", suffix: str = "suffix", hash_col: str = "hash", kind: str = "joaat") -> DataFrame:
    """(hash, prefix, suffix) of all names prefix + suffix whose hash is known, without hashing each name.

    Prefixes are hashed once; each known id is pulled back over each suffix,
    which undoes the hash's steps, and states meet in an equi-join: |P| +
    |S| x |known| hashes in place of |P| x |S|. Steps are one-to-one, so a
    meeting is a match. Use it where ids are fewer than prefixes. Nulls give
    nothing, repeated words and ids count once.
    """
    after, before = REVERSIBLE[kind]
    states = prefixes.select(F.col(prefix).alias("prefix")).dropna().distinct().withColumn("state", after(F.col("prefix")))
    ids, ends = known.select(F.col(hash_col).cast("bigint").alias("hash")).dropna().distinct(), suffixes.select(F.col(suffix).alias("suffix")).dropna().distinct()
    pulled = ids.crossJoin(light(held(ends))).withColumn("state", before(F.col("hash"), F.col("suffix")))
    return pulled.join(states, "state").select(F.col("hash").alias(hash_col), F.col("prefix").alias(prefix), F.col("suffix").alias(suffix))


def number_names(spark: SparkSession, form: str, start: int, stop: int, step: int = 1, partitions: int | None = None) -> DataFrame:
    """(name): a printf form filled with each number of a range, made in parallel."""
    return spark.range(start, stop, step, partitions).select(F.format_string(form, "id").alias("name"))


def combinations(parts: DataFrame, col: str, k: int, sep: str = "_", repeat: bool = True) -> DataFrame:
    """(name): all names of k parts; without repeat, each part once in a name. The parts are a short list, broadcast after a count."""
    out = parts.select(F.col(col).alias("name"), F.array(col).alias("used"))
    for _ in range(k - 1):
        more = light(parts.select(F.col(col).alias("__p")))
        out = out.join(more, F.lit(True) if repeat else ~F.array_contains("used", F.col("__p")))
        out = out.select(F.concat("name", F.lit(sep), "__p").alias("name"), F.array_append("used", F.col("__p")).alias("used"))
    return out.select("name")


def swap_list(order: list[int]) -> list[tuple[int, int]]:
    """Swaps of places that bring a permutation of 0 to n - 1 into order."""
    order, out = list(order), []
    for i in range(len(order)):
        j = order.index(i, i)
        if i != j:
            order[i], order[j] = order[j], order[i]
            out.append((i, j))
    return out


def swaps(order: Column) -> Column:
    """swap_list of an array column of a permutation, as an array of structs (a, b) of places."""

    @F.pandas_udf("array<struct<a: int, b: int>>")
    def run(orders: pd.Series) -> pd.Series:
        return orders.map(lambda x: [{"a": a, "b": b} for a, b in swap_list(list(x))], na_action="ignore")

    return run(order)


def owned_names(found: DataFrame, contexts: DataFrame, last: tuple[str, ...] = ("VA",)) -> DataFrame:
    """Recovered (hash, name) with the context that owns the hash: the first by order, contexts named in `last` after all others; those in none come last with a null context. contexts: (ctx, ctx_order, hash)."""
    highest = contexts.agg(F.max("ctx_order").alias("m"))
    contexts = contexts.crossJoin(F.broadcast(highest)).withColumn("ctx_order", F.when(F.col("ctx").isin(*last), F.col("ctx_order") + F.col("m") + 1).otherwise(F.col("ctx_order"))).drop("m") if last else contexts
    owner = contexts.groupBy("hash").agg(F.min_by("ctx", "ctx_order").alias("ctx"), F.min("ctx_order").alias("ctx_order"))
    return found.join(owner, "hash", "left").orderBy(F.col("ctx_order").asc_nulls_last(), F.lower("name"))


def frontier_search(letters: DataFrame, triples: DataFrame, known: DataFrame, depth: int, prefix: str = "") -> DataFrame:
    """(hash, name): names of up to `depth` characters after a prefix whose FNV-1 hash is known; each next character must make an allowed triple. letters: an alphabet; triples: (pair, next).

    Each level is held, with the hash so far, so a name costs one step of the
    hash and a level one join, whatever the depth.
    """
    known, letters, triples = (held(x.distinct()) for x in (known.select("hash"), letters.select("letter"), triples.select("pair", "next")))
    front = held(letters.select(F.concat(F.lit(prefix), "letter").alias("name"), fnv1(F.col("letter"), fnv1(F.lit(prefix))).alias("hash")))
    found = []
    for level in range(depth):
        found.append(front.join(light(known), "hash", "left_semi").select("hash", "name"))
        if level + 1 == depth:
            break
        grown = front.withColumn("pair", F.right("name", F.lit(2)))
        longer = grown.filter(F.length("name") >= 2).join(light(triples), "pair").select("name", "hash", "next")
        shorter = grown.filter(F.length("name") < 2).crossJoin(light(letters)).select("name", "hash", F.col("letter").alias("next"))
        front = held(longer.unionByName(shorter).select(F.concat("name", "next").alias("name"), fnv1(F.col("next"), F.col("hash")).alias("hash")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
