"""Language identification by Bayesian evidence fusion.

log P(language | all) = text + declared + host, up to a constant:

- text: byte trigrams inside words, naive Bayes, tempered, because trigrams of
  one text are not independent; a class "und" of even trigrams stands for text
  in no known language;
- declared: the markup's language is right with chance TRUST, else any;
- host: P(language | host), smoothed by that of the address suffix, and that
  by the whole corpus; all from grouped sums of the texts' own posteriors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, marked, numbered, spread_join, staged, text_of
from .html_blocks import leaf_blocks
from .wordhash import blocks

#: Labelled rows of each language that the trigram model is fitted on; its sample has about twice as many at most.
FIT_ROWS = 4000
#: Hashed trigrams.
BUCKETS = 1 << 15
TRUST = 0.9
#: Weight of the next wider level in a host's or suffix's prior, in documents.
KAPPA = 20.0
#: Trigrams that a text of any length counts as, at most, in its likelihood.
EVIDENCE = 200.0
UNKNOWN = "und"
UNKNOWN_PRIOR = 1e-4
#: Posterior of the unknown class from which a row is rejected.
REJECT = 0.5


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams within words that have no digit, with a space on both sides; the text of each)."""
    data = b" " + b"  ".join(texts) + b"  "
    buf = np.frombuffer(data, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    letter = (buf >= 128) | ((buf >= 97) & (buf <= 122))
    digit = (buf >= 48) & (buf <= 57)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    word = np.cumsum(space)
    bad = np.zeros(int(word[-1]) + 1, bool)
    bad[word[digit]] = True
    buf = np.where(letter, buf, 32).astype(np.uint32)
    use = letter & ~bad[word]
    at = np.flatnonzero(use[1:-1]) + 1
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = (buf[at - 1] << 16) | (buf[at] << 8) | buf[at + 1]
    gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(17)
    ends = np.cumsum(lengths)
    return gram.astype(np.int64), np.searchsorted(ends, at - 1, side="right")


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of BUCKETS trigrams for each and the unknown class), from `rows` labelled rows of each language.

    The languages are all labels of the table. The sample is, for each of them,
    the rows whose id hashes have the fewest bits that hold `rows` of them, or
    all it has; the counts are summed on the executors, so what comes back is
    BUCKETS numbers a language.
    """
    label, bits = F.col(label_col).cast("string"), F.length(F.bin(F.xxhash64(id_col)))
    named = docs.filter(F.col(label_col).isNotNull())
    seen: dict[str, list[tuple[int, int]]] = {}
    for r in named.groupBy(label.alias("l"), bits.alias("b")).agg(F.count("*").alias("n")).collect():
        seen.setdefault(r["l"], []).append((r["b"], r["n"]))
    labels = sorted(seen)
    enough: dict[int, list[str]] = {}
    for x in labels:
        least, n = sorted(seen[x]), 0
        for b, k in least:
            n += k
            if n >= rows:
                break
        enough.setdefault(b, []).append(x)
    taken = F.lit(False)
    for b, some in enough.items():
        taken |= (bits <= b) & label.isin(*some)
    sample = named.filter(taken)
    index = {x: i for i, x in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(labels), BUCKETS), np.int64)
        for b in batches:
            which = np.array([index[x] for x in b.column(0).to_pylist()], np.int64)
            texts = b.column(1).to_pylist()
            for i, j in blocks(texts):
                gram, doc = _trigrams(texts[i:j])
                np.add.at(counts, (which[i:j][doc], gram), 1)
        lang, gram = np.nonzero(counts)
        if len(lang):
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(gram, pa.int32()), pa.array(counts[lang, gram])], names=["l", "g", "n"])

    table = np.ones((len(labels) + 1, BUCKETS))
    cells = sample.select(F.col(label_col).cast("string"), _lower(text_col)).mapInArrow(run, "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    found = cells.toArrow()
    table[found["l"].to_numpy(), found["g"].to_numpy()] += found["n"].to_numpy()
    table[-1] = 1
    return labels, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _lower(text_col: str) -> Column:
    return F.encode(F.lower(text_of(text_col)), "UTF-8").alias("text")


def _scorer(table: np.ndarray):
    """(…, text) to (…, ll), text being last: tempered log likelihoods of each class and the number of trigrams last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = len(table)
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for i, j in blocks(texts):
                gram, doc = _trigrams(texts[i:j])
                n = np.bincount(doc, minlength=j - i)
                score = np.stack([np.bincount(doc, weights=table[c][gram], minlength=j - i) for c in range(classes)], axis=1).astype(float)
                score *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
                out.append(np.concatenate([score, n[:, None]], axis=1))
            flat = np.concatenate(out).ravel() if out else np.zeros(0)
            ll = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, classes + 1, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ll], names=[*b.schema.names[:-1], "ll"])

    return run


def _softmax(scores: Column) -> Column:
    """Probabilities from an array of log scores."""
    top = F.array_max(scores)
    parts = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda p: p / total)


def host_of(url: Column) -> Column:
    """The host of an address, or the value itself where it is none."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")), url, F.lit("")))


def declared_language(html: str) -> str | None:
    """The main subtag of the language that a page's markup declares: the html element's, or that of a content-language meta; null if none."""
    head = re.search(r"<html(?=[\s>])[^>]*", html, re.I)
    said = head and re.search(r"\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})\b", head[0], re.I)
    if not said:
        for meta in re.finditer(r"<meta(?=\s)[^>]*", html, re.I):
            if re.search(r"content-language", meta[0], re.I) and (said := re.search(r"\scontent\s*=\s*[\"']?\s*([a-z]{2,3})\b", meta[0], re.I)):
                break
    return said[1].lower() if said else None


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, declared, text) of web pages: the language that the markup declares, and the text of all blocks. A null html is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                html = b.column(2).to_pylist()
                said, text = [declared_language(x) for x in html], ["\n".join(y.text for y in leaf_blocks(x)) for x in html]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(text, pa.string())], names=["page_id", "url", "declared", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, declared string, text string")


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", address_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, declared, language, probability, kept.

    language is the class of the highest posterior among the known ones and
    the unknown class "und". A text without a word of letters is "und" with
    probability 1. kept is false where "und" has REJECT or more. A null or
    unknown declared language says nothing; a null address is a host of its
    own. Ties go to the language first by name. An empty table gives an empty
    result. Other columns are not read.
    """
    return _fused(docs, model, [F.col(id_col).cast("long").alias("row")], declared_col, address_col, text_col).select(F.col("row").alias("doc_id"), "declared", "language", "probability", "kept")


def _fused(docs: DataFrame, model: tuple[list[str], np.ndarray], row: list[Column], declared_col: str, address_col: str, text_col: str) -> DataFrame:
    """(row, declared, language, probability, kept): row is passed along as it is."""
    languages, table = model
    classes = [*languages, UNKNOWN]
    inputs = docs.select(*row, F.col(declared_col).cast("string").alias("declared"), host_of(F.col(address_col).cast("string")).alias("host"), _lower(text_col))
    scored = staged(inputs.mapInArrow(_scorer(table), T.StructType([*inputs.schema.fields[:-1], T.StructField("ll", T.ArrayType(T.DoubleType()))])), "language-scores")

    grams = F.element_at("ll", len(classes) + 1)
    if not languages:
        return scored.select("row", "declared", F.lit(UNKNOWN).alias("language"), F.lit(1.0).alias("probability"), F.lit(False).alias("kept"))

    # soft counts of languages by host, then by suffix, then over all
    suffix = F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise("")
    text_only = scored.filter(grams > 0).select("host", _softmax(F.slice("ll", 1, len(languages))).alias("p"))
    counts = text_only.groupBy("host").agg(*[F.sum(F.element_at("p", i + 1)).alias(f"n{i}") for i in range(len(languages))])
    every = F.aggregate(F.array(*[f"n{i}" for i in range(len(languages))]), F.lit(0.0), lambda a, x: a + x)
    counts = staged(counts.withColumn("suffix", suffix).withColumn("n", every), "host-counts")
    sums = lambda p: [F.sum(f"n{i}").alias(f"{p}{i}") for i in range(len(languages))]
    whole = counts.agg(*sums("g")).first()
    total = sum(x or 0.0 for x in whole)
    overall = [((x or 0.0) + 1.0) / (total + len(languages)) for x in whole]

    def smoothed(p: str, wider: list[Column]) -> list[Column]:
        return [(F.coalesce(f"{p}{i}", F.lit(0.0)) + KAPPA * w) / (F.col("n" if p == "n" else "whole") + KAPPA) for i, w in enumerate(wider)]

    by_suffix = counts.groupBy("suffix").agg(*sums("s"), F.sum("n").alias("whole"))
    by_suffix = by_suffix.select("suffix", *[p.alias(f"p{i}") for i, p in enumerate(smoothed("s", [F.lit(x) for x in overall]))])
    priors = counts.join(by_suffix, "suffix").select("host", "n", *[F.log(p).alias(f"prior{i}") for i, p in enumerate(smoothed("n", [F.col(f"p{i}") for i in range(len(languages))]))])
    priors = staged(priors, "host-priors")

    known = F.coalesce(F.col("declared").isin(*languages), F.lit(False))
    said = F.array(*[F.when(~known, 0.0).when(F.col("declared") == x, math.log(TRUST)).otherwise(math.log((1 - TRUST) / max(1, len(languages) - 1))) for x in languages], F.lit(math.log(UNKNOWN_PRIOR)))
    prior = F.array(*[F.coalesce(f"prior{i}", F.lit(math.log(overall[i]))) for i in range(len(languages))], F.lit(0.0))
    evidence = spread_join(scored, priors, "host", "ll", "left").select("row", "declared", grams.alias("grams"), F.slice("ll", 1, len(classes)).alias("text"), said.alias("said"), prior.alias("prior"))
    fused = evidence.withColumn("fused", F.zip_with(F.zip_with("text", "said", lambda a, b: a + b), "prior", lambda a, b: a + b))
    posterior = fused.select("row", "declared", "grams", _softmax(F.col("fused")).alias("p"))
    best = F.array_max("p")
    silent = F.col("grams") == 0
    return posterior.select(
        "row",
        "declared",
        F.when(silent, UNKNOWN).otherwise(F.element_at(F.array(*map(F.lit, classes)), F.array_position("p", best).cast("int"))).alias("language"),
        F.when(silent, 1.0).otherwise(F.round(best, 6)).alias("probability"),
        (~silent & (F.element_at("p", len(classes)) < REJECT)).alias("kept"),
    )


def drop_unknown(docs: DataFrame, model: tuple[list[str], np.ndarray], **columns: str) -> DataFrame:
    """docs with their own columns, less the rows that identify() does not keep.

    The rows are numbered in a staged copy; their evidence is fused apart from
    them, and each task learns the numbers of those to drop. Texts without a
    word of letters, null ones too, go; an empty table gives an empty one.
    """
    named = {"declared_col": "lang", "address_col": "source", "text_col": "text"} | columns
    held = numbered(docs, "numbered-documents")
    texts = held.select(F.col("uid").alias("number"), *[column_of("row", c).alias(k) for k, c in named.items()])
    judged = _fused(texts, model, [F.col("number").alias("row")], **{k: k for k in named})
    gone = staged(judged.filter("NOT kept").select(F.col("row").alias("uid")), "unknown-languages")
    return marked(held, gone, "left_anti").select("row.*")
