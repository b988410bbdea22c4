"""Mixture-controlled packing by deficit round-robin.

Each source is a queue: its documents' tokens, one after the other; sources
that have less than a token a round share queues, unless they have targets,
for no sequence could show such a share. In each
round every queue gets its quantum (target share times ROUND tokens), serves
the whole tokens of what it has been given so far, and carries the rest as its
deficit into the next round. The stream of what the rounds serve is cut into
sequences of `length` tokens, so every sequence but the last is full, and with
ROUND = length each holds every source's share to within a token or two. A
queue that runs dry leaves its place to the others.

What queue s has served after r rounds is floor(r * quantum), at most its
total; the deficit is the remainder. So any task can work out the state of the
round-robin at any round from the queues' totals alone: deficits carry across
sequences and partitions without a sequential pass. A task needs no more than
where its documents begin in their queues: these places are broadcast while
they fit, and met by a shuffle of the ids beyond that.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fits, staged, text_of

#: Quanta are in units of 2**-16 token; totals up to 2**46 tokens fit a long.
UNIT = 16
#: Chunks of text whose ids a worker remembers.
REMEMBERED = 400_000
#: Sources with targets that have queues of their own, the largest first.
MAX_TARGETS = 10_000
#: Cells (rounds times queues) of the schedule that are worked out at once, and tokens of documents that are cut at once.
CELLS, TOKENS_AT_ONCE = 1 << 18, 1 << 20


#: Spaces with no white space beside them.
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


class ChunkTokenizer:
    """Ids of a byte-level BPE file of the tokenizers library, with remembered chunks.

    The vocabulary's pre-tokenizer never joins a space-led chunk with what
    precedes it, so a text splits at single spaces between non-space
    characters; each distinct chunk is encoded once. With `added`, texts that
    hold one of the file's added tokens go through the tokenizers library, which
    finds them there by its own rules; without, their strings are ordinary text.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, tokens = file["model"]["vocab"], {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        from public_tokenizers import PATTERN

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t)}
        for t in tokens:
            ranks.pop(t.encode(), None)
        self.dtype = np.dtype("<u2") if max(*vocab.values(), *tokens.values()) < 1 << 16 else np.dtype("<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._added = re.compile("|".join(map(re.escape, tokens))).search if added and tokens else None
        self._path, self._library = path, None
        self._encode = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}

    def _bytes(self, text: str) -> bytes:
        return array(self._code, self._encode(text)).tobytes()

    def _by_library(self, text: str) -> bytes:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids of a text, in little-endian integers of self.dtype."""
        if not text:
            return b""
        if self._added and self._added(text):
            return self._by_library(text)
        chunks = text.split(" ")
        return self._joined(chunks) or self._joined(_SINGLE.split(text), split=True)

    def _joined(self, chunks: list[str], split: bool = False) -> bytes | None:
        """The ids of chunks that single spaces part; None where one of them has white space at an end, so the text must be split (split: it was) with more care. Such chunks are never remembered, so only new ones are looked at."""
        known = self._known
        first, rest = chunks[0], chunks[1:]
        if not split and (not first or first[-1].isspace()):
            return None
        out = [self._bytes(first), *map(known.get, rest)]
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            for i, x in enumerate(out):
                if x is None:
                    c = rest[i - 1]
                    if (x := known.get(c)) is None:
                        odd = not c or c[0].isspace() or c[-1].isspace()
                        if odd and not split:
                            return None
                        x = self._bytes(f" {c}")
                        if len(c) < 64 and not odd:
                            known[c] = x
                    out[i] = x
        return b"".join(out)


_tokenizers: dict[tuple[str, bool], ChunkTokenizer] = {}


def tokenizer(path: str, added: bool = False) -> ChunkTokenizer:
    """One for each worker process, file and treatment of added tokens."""
    if (path, added) not in _tokenizers:
        _tokenizers[path, added] = ChunkTokenizer(path, added)
    return _tokenizers[path, added]


def _queue_of(col: str):
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", added: bool = False) -> DataFrame:
    """Staged table (doc_id, queue, part, start, n, ids): each document's ids with an id 0 at its end, and its place in its queue within its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, tok = TaskContext.get().partitionId(), {}, tokenizer(path, added)
        end = np.zeros(1, tok.dtype).tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                piece = b.slice(i, 256)
                queues = piece.column(1).to_pylist()
                ids = [tok.ids(t) + end for t in piece.column(2).to_pylist()]
                n = [len(x) // tok.dtype.itemsize for x in ids]
                starts = []
                for q, k in zip(queues, n, strict=True):
                    starts.append(place.get(q, 0))
                    place[q] = starts[-1] + k
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "queue", "part", "start", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _queue_of(source_col).alias("queue"), text_of(text_col).alias("text"))
    return staged(rows.mapInArrow(run, "doc_id long, queue string, part int, start long, n long, ids binary"), "tokens")


class Schedule:
    """The round-robin's state at any round, from the queues' totals and target shares."""

    def __init__(self, totals: list[int], shares: list[float], round_tokens: int) -> None:
        whole = sum(shares)
        self.totals = [int(t) for t in totals]
        self.quanta = [max(1, round(round_tokens * s / whole * (1 << UNIT))) for s in shares]
        self.rounds = [-((-t << UNIT) // q) for t, q in zip(self.totals, self.quanta, strict=True)]

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """(rounds, queues) tokens that each queue has served after so many rounds; what is left of its quanta is its deficit."""
        return np.minimum((np.minimum(rounds[:, None], np.array(self.rounds, np.int64)) * np.array(self.quanta, np.int64)) >> UNIT, np.array(self.totals, np.int64))

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round in which a queue serves its token-th token."""
        q = np.array(self.quanta, np.int64)[queue]
        return -((-(token + 1) << UNIT) // q) - 1

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Cut documents (queue, start there, tokens) into pieces: (document's index, start in it, length, place in the stream)."""
        first, last = self.round_of(queue, start), self.round_of(queue, start + n - 1)
        # a queue of less than a token a round serves in some rounds only: those of its tokens
        slow = np.array(self.quanta, np.int64)[queue] < 1 << UNIT
        times = np.where(slow, n, last - first + 1)
        doc = np.repeat(np.arange(len(n)), times)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
        q = queue[doc]
        rounds = np.where(slow[doc], self.round_of(q, start[doc] + turn), first[doc] + turn)
        begin, end, place = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        order = np.argsort(rounds, kind="stable")
        each, first_at = np.unique(rounds[order], return_index=True)
        bounds = np.append(first_at, len(order))
        step = max(1, CELLS // max(1, len(self.totals)))
        for i in range(0, len(each), step):
            some = each[i : i + step]
            now, then = self.served(some), self.served(some + 1)
            # a piece stands after this round's tokens of the queues before its own
            ahead = now.sum(axis=1, keepdims=True) + np.cumsum(then - now, axis=1) - (then - now)
            own = order[bounds[i] : bounds[min(i + step, len(each))]]
            at = (np.searchsorted(some, rounds[own]), q[own])
            begin[own], end[own], place[own] = now[at], then[at], ahead[at]
        a, b = np.maximum(begin, start[doc]), np.minimum(end, (start + n)[doc])
        place += a - begin
        full = b > a
        doc, a, b, place = doc[full], a[full], b[full], place[full]
        # neighbours that no other queue parts are one piece again
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + (b - a)[:-1])
        at = np.flatnonzero(new)
        doc, a, b, place = doc[at], a[at], b[np.append(at[1:], len(b)) - 1] if len(at) else b, place[at]
        # a sequence's end cuts a piece
        lo, hi = place // length, (place + b - a - 1) // length
        times = hi - lo + 1
        i = np.repeat(np.arange(len(doc)), times)
        window = lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
        x = np.maximum(place[i], window * length)
        y = np.minimum((place + b - a)[i], (window + 1) * length)
        return doc[i], (a - start[doc])[i] + x - place[i], y - x, x


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def pack(docs: DataFrame, path: str, length: int = 1024, targets: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", added: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    targets: share of the tokens by source (as a string; None: null); sources
    that it lacks share what it leaves in proportion to their tokens. Without
    targets the shares are those of the corpus, so all queues end together.
    added: whether the file's added tokens, such as <|endoftext|>, are found
    inside texts, as the tokenizers library does by default.
    A document is its ids and an id 0: a null or empty text is one token. A
    null source is a queue of its own. Rows that repeat an id are documents of
    their own. An empty table gives an empty result. Other columns are not
    read. Only the very last sequence may be short.
    """
    rows = tokenized(docs, path, id_col, text_col, source_col, added)
    own = {("null" if k is None else f"={k}"): float(v) for k, v in (targets or {}).items()}
    totals = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    if own:
        wanted = rows.sparkSession.createDataFrame(list(own.items()), "queue string, target double")
        totals = totals.join(F.broadcast(wanted), "queue", "left")
    else:
        totals = totals.withColumn("target", F.lit(None).cast("double"))
    sizes = staged(totals.groupBy("queue", "target").agg(F.sum("n").alias("n")), "queue-sizes")
    # a source with less than a token a round shares a queue with others like it
    whole = sizes.agg(F.sum("n")).first()[0] or 0
    large = F.col("target").isNull() & (F.col("n") * length >= whole)
    named = sizes.filter("target IS NOT NULL").orderBy(F.col("n").desc(), "queue").limit(MAX_TARGETS)
    alone = staged(named.unionByName(sizes.filter(large)).select("queue", F.lit(True).alias("alone")), "queues-alone")
    rest = sizes.join(F.broadcast(alone), "queue", "left_anti").agg(F.sum("n")).first()[0] or 0
    shared = max(1, rest * length // max(1, whole))
    totals, sizes = (x.join(F.broadcast(alone), "queue", "left") for x in (totals, sizes))
    lane = F.when(F.col("alone"), F.col("queue")).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64("queue"), F.lit(shared)).cast("string")))
    order = Window.partitionBy("lane").orderBy("part", "queue").rowsBetween(Window.unboundedPreceding, -1)
    before = staged(totals.withColumn("lane", lane).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).select("queue", "part", "lane", "before"), "queue-offsets")
    free = F.when(F.col("target").isNull(), F.col("n")).otherwise(0)
    found = sizes.groupBy(lane.alias("lane")).agg(F.sum("n").alias("n"), F.sum(free).alias("free"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("target")).collect()
    found.sort(key=lambda r: r["lane"])
    names = {r["lane"]: i for i, r in enumerate(found)}
    whole_free = sum(r["free"] for r in found)
    left = max(0.0, 1.0 - sum(own.values())) if own else 1.0
    plan = Schedule([r["n"] for r in found], [r["target"] + left * r["free"] / max(1, whole_free) for r in found], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = tokenizer(path, added).dtype
        for whole in batches:
            sizes = np.cumsum(whole.column("n").to_numpy())
            i = 0
            while i < whole.num_rows:
                # documents of so many tokens together, or one that has more
                k = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + TOKENS_AT_ONCE, side="right")))
                b, i = whole.slice(i, min(k - i, 512)), min(k, i + 512)
                n = b.column("n").to_numpy()
                start = b.column("start").to_numpy() + b.column("before").to_numpy(zero_copy_only=False)
                queues = b.column("queue").to_pylist()
                doc, at, size, place = plan.pieces(np.array([names[x] for x in b.column("lane").to_pylist()]), start, n, length)
                ids = [np.frombuffer(x, dtype).astype("<u4").tobytes() for x in b.column("ids").to_pylist()]
                crc = [zlib.crc32(ids[d][4 * s : 4 * (s + k)]) for d, s, k in zip(doc.tolist(), at.tolist(), size.tolist(), strict=True)]
                took = pa.array(doc)
                source = pa.array([None if q == "null" else q[1:] for q in queues], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(took), pa.array(at), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(place // length), pa.array(place % length), source.take(took)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
                )

    placed = rows.join(F.broadcast(before) if fits(before) else before, ["queue", "part"]).select("doc_id", "queue", "lane", "start", "before", "n", "ids")
    return placed.mapInArrow(run, PIECES)


def sequences(docs: DataFrame, pieces: DataFrame, path: str, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids array<int>, doc_ids array<long>), for ids that no two rows share.

    Pieces meet their texts by id and each other by sequence, whose size is bounded by `length`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, added)
        for b in batches:
            for r in b.to_pylist():
                ids = np.append(np.frombuffer(tok.ids(r["text"]), tok.dtype), 0)
                rows = [(p["sequence_id"], p["offset"], r["doc_id"], ids[p["start"] : p["start"] + p["length"]].astype(np.int32)) for p in r["pieces"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["sequence_id", "offset", "doc_id", "ids"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    by_doc = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("pieces"))
    cut = by_doc.join(texts, "doc_id").mapInArrow(run, "sequence_id long, offset long, doc_id long, ids array<int>")
    whole = cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
