"""Main text of web pages: parse to leaf blocks, label them by a recurrent network, join what is main text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_labeller import Labeller, features, trained
from .common import text_of
from .html_blocks import leaf_blocks

#: Pages that the network reads side by side, and blocks at most, beyond which one page goes alone.
SIDE_BY_SIDE, MANY_BLOCKS = 64, 4096


def extract(pages: list[str], net: Labeller) -> list[str]:
    """The main text of each page."""
    parsed = [leaf_blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(parsed) if b), key=lambda i: len(parsed[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < SIDE_BY_SIDE and len(parsed[order[end]]) * (end - at + 1) <= MANY_BLOCKS:
            end += 1
        group = order[at:end]
        for i, p in zip(group, net.scores([features(parsed[i]) for i in group]), strict=True):
            out[i] = "\n".join(parsed[i][k].text for k in np.flatnonzero(p >= 0.5))
        at = end
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: Labeller | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    text is the article's blocks in page order, one a line, "" if there is
    none; n_chars is its code points. A null html is empty; ids and addresses
    are passed on, null or not. A <br> is white space in its block. An empty
    table gives an empty result. Other columns are not read. The network's
    weights (a fixed 0.3 MB) go with the tasks; rows need no exchange.
    """
    weights = pages.sparkSession.sparkContext.broadcast((net or trained()).params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(weights.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                texts = extract(b.column(2).to_pylist(), own)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
