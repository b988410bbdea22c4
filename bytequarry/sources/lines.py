"""Line files: lists with comments, sections and directives that hold for what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textx import matches_any, url_path
from ..operators.ordered import carried, one_shot

#: Directives of address lists and what they set.
DIRECTIVES = {"out": "out", "folder": "out", "url": "prefix", "prefix": "prefix", "suffix": "suffix", "cut": "cut", "part": "cut", "name": "name", "filevar": "filevar", "filter": "filter", "filters": "filter", "header": "header", "headers": "header", "thread": "threads", "threads": "threads", "debug": "debug"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, line) of text files; each file is read whole, so seq is its own line number."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("seq", "line"))


def sections(lines: DataFrame, group: list[str], mark: str = r"^###\s*(.*?)\s*(?:NAMES)?\s*$") -> DataFrame:
    """Lines with the section that the last heading before them names; headings go."""
    title = F.when(F.col("line").rlike(mark), F.regexp_extract("line", mark, 1))
    return carried(lines.withColumn("__t", title), group, ["seq"], F.col("__t"), "section").filter("__t IS NULL").drop("__t")


def hashed_names(lines: DataFrame) -> DataFrame:
    """(seq, hash, name) of lines `0x1234abcd` or `0x1234abcd: name`; others go."""
    form = r"^\s*#?\s*0x([0-9a-fA-F]{1,8})\s*(?::\s*(.*?))?\s*$"
    return lines.filter(F.col("line").rlike(form)).select("seq", F.conv(F.regexp_extract("line", form, 1), 16, 10).cast("bigint").alias("hash"), F.nullif(F.regexp_extract("line", form, 2), F.lit("")).alias("name"))


def _slashed(c: Column, unless_query: bool) -> Column:
    fine = c.endswith("/") | (F.contains(c, F.lit("?")) if unless_query else F.lit(False)) | (c == "")
    return F.when(fine, c).otherwise(F.concat(c, F.lit("/")))


def addresses(lines: DataFrame, group: list[str]) -> DataFrame:
    """(group, seq, url, path) of address lists (group, seq, line).

    A directive holds for later addresses only; a name is used once. Partial
    addresses get the prefix and suffix; `url` followed by a backquote has its
    name there. ^format#first#last^ stands for numbered addresses. Filters are
    patterns of the address or the name; any may fit. Repeats go.
    """
    text = F.trim("line")
    rows = lines.select(*group, "seq", text.alias("line")).filter("line <> '' AND NOT startswith(line, '#')")
    key = F.when(~F.col("line").startswith("http") & F.contains("line", F.lit(":")), F.substring_index("line", ":", 1))
    rows = rows.withColumn("__k", key).withColumn("__v", F.trim(F.regexp_replace("line", r"^[^:]*:", "")))
    what = F.create_map(*[F.lit(x) for kv in DIRECTIVES.items() for x in kv])[F.col("__k")]
    rows = rows.withColumn("__w", what)
    for d in ("out", "prefix", "suffix", "cut", "filevar"):
        value = F.col("__v")
        value = _slashed(value, d == "prefix") if d in ("out", "prefix") else value
        rows = carried(rows, group, ["seq"], F.when(F.col("__w") == d, value), f"__{d}")
    rows = one_shot(rows, group, ["seq"], F.when(F.col("__w") == "name", F.col("__v")), F.col("__k").isNull(), "__name")
    from pyspark.sql import Window

    before = Window.partitionBy(*group).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__filters", F.flatten(F.collect_list(F.when(F.col("__w") == "filter", F.transform(F.split("__v", ","), F.trim))).over(before)))
    rows = rows.filter("__k IS NULL")
    ticked = F.contains("line", F.lit("`"))
    rows = rows.withColumn("__name", F.when(ticked, F.trim(F.regexp_extract("line", "`(.*)$", 1))).otherwise(F.col("__name"))).withColumn("line", F.trim(F.substring_index("line", "`", 1)))
    part = F.concat(F.coalesce("__prefix", F.lit("")), F.regexp_replace("line", "^/", ""), F.coalesce("__suffix", F.lit("")))
    rows = rows.withColumn("url", F.replace(F.when(F.col("line").startswith("http"), F.col("line")).otherwise(part), F.lit(" "), F.lit("%20")))
    glob = lambda p: F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"([.+^$(){}|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    fits = F.exists("__filters", lambda p: F.regexp_like("url", glob(p)) | F.coalesce(F.regexp_like("__name", glob(p)), F.lit(False)))
    rows = rows.filter((F.size("__filters") <= 0) | fits)
    form = r"^([^^]*)\^([^#^]*)#(\d+)#(\d+)\^([^^]*)$"
    numbers = F.sequence(F.regexp_extract("url", form, 3).cast("int"), F.regexp_extract("url", form, 4).cast("int"))
    width = F.coalesce(F.nullif(F.regexp_extract(F.regexp_extract("url", form, 2), r"%0?(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    shown = lambda i: F.when(F.length(i.cast("string")) >= width, i.cast("string")).otherwise(F.lpad(i.cast("string"), width, "0"))
    each = F.when(F.regexp_like("url", F.lit(form)), F.transform(numbers, lambda i: F.concat(F.regexp_extract("url", form, 1), shown(i), F.regexp_extract("url", form, 5)))).otherwise(F.array("url"))
    rows = rows.select(*group, "seq", F.posexplode(each).alias("place", "url"), "__cut", "__out", "__filevar", F.col("__name"))
    name = F.when(F.col("place") == 0, F.col("__name"))
    out = rows.select(*group, "seq", "place", "url", url_path(F.col("url"), F.col("__cut"), F.col("__out"), F.col("__filevar"), name).alias("path"))
    return out.groupBy(*group, "url", "path").agg(F.min("seq").alias("seq"), F.min("place").alias("place"))


def kept(df: DataFrame, name: str, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """Rows whose name fits a pattern, and none of the excluded ones."""
    cond = matches_any(F.col(name), include) if include else F.lit(True)
    return df.filter(cond & ~matches_any(F.col(name), list(exclude)) if exclude else cond)


def stream_headers(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with `header`: the text header of a raw stream that a line of encoder options describes: /f rate, /m mono, /bs0x interleave, /o0x start. Rates a little off the standard ones are put right."""
    # Rates of the encoder and what they stand for.
    rates = {31560: 31468, 15780: 15734, 7890: 7868}
    given = F.regexp_extract(line, r"/f *(\d+)", 1).cast("bigint")
    rate = given
    for a, b in rates.items():
        rate = F.when(given == a, b).otherwise(rate)
    mono = F.regexp_like(line, F.lit(r"/m(\s|$)"))
    block, start = (F.conv(F.nullif(F.regexp_extract(line, rf"/{o} *0x([0-9a-fA-F]+)", 1), F.lit("")), 16, 10).cast("bigint") for o in ("bs", "o"))
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(F.coalesce(c, F.lit(0)))))
    said = F.array(F.lit("codec = PCFX"), F.lit("codec_mode = 3"), F.when(~mono, F.concat(F.lit("interleave = "), hexed(block))), F.concat(F.lit("channels = "), F.when(mono, "1").otherwise("2")), F.concat(F.lit("sample_rate = "), rate.cast("string")), F.concat(F.lit("start_offset = "), hexed(start)), F.lit("num_samples = data_size"))
    return lines.withColumn("header", F.array_join(said, "\n"))


# --- tables of loops ----------------------------------------------------------------

#: Tables that may stand side by side, the first of which holds.
LOOP_TABLES = ["bgmtbl.txt", "bgmtbl.txt_switch", "bgmtbl.tbl", "map.txt", "BOOT.BIN", "t_bgm._dt", "bgmtbl.tbbdec"]


def loop_tables(lines: DataFrame) -> DataFrame:
    """(folder, table, seq, title, name, looped, loop_start, loop_end) of text tables, the first of LOOP_TABLES in each folder. lines: (folder, table, seq, line).

    Lines `bgmtbl title name flag start end` give the loop's end in .tbl
    tables, else its length where the table has no comment (//tbl) or the name
    begins with ed and the title is not BGM_Nothing; `y3bg... start length`
    has names alone; lines between #BGMTable and #EndBGMTable of a map are
    `id name x start end`, whose end is none at 10000000 or 99999999. What is
    no number counts as 0. Positions of a switch table are at another rate.
    """
    from pyspark.sql import Window

    known = F.array(*map(F.lit, LOOP_TABLES))
    rank = F.array_position(known, F.col("table"))
    first = lines.filter(rank > 0).groupBy("folder").agg(F.min(rank).alias("rank"))
    rows = lines.withColumn("rank", rank).join(first, ["folder", "rank"])
    whole = Window.partitionBy("folder")
    upto = whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    said = F.max(F.when(F.col("line").startswith("//tbl"), 1).otherwise(0)).over(upto) == 1
    inside = F.last(F.when(F.col("line").startswith("#EndBGMTable"), 0).when(F.col("line").startswith("#BGMTable"), 1), ignorenulls=True).over(upto) == 1
    over = F.max(F.when(F.col("line").startswith("#EndBGMTable"), 1).otherwise(0)).over(upto) == 1
    rows = rows.withColumn("said", said).withColumn("inside", F.coalesce(inside, F.lit(False)) & ~over).withColumn("w", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""))
    word = lambda i: F.get("w", F.lit(i))
    number = lambda i: F.coalesce(F.expr(f"try_cast(get(w, {i}) AS bigint)"), F.lit(0))
    is_map = F.col("table") == "map.txt"
    std, y3 = ~is_map & F.col("line").startswith("bgmtbl"), ~is_map & F.col("line").startswith("y3bg") & (word(0) != "y3bg22_")
    mapped = is_map & F.col("inside") & ~F.col("line").startswith("//ID") & ~F.col("line").startswith("#BGMTable") & (F.size("w") > 4) & ~((word(1) == "bgm01") & word(0).startswith("//"))
    length = ~F.col("table").endswith(".tbl") & (~F.col("said") | ((word(1) != "BGM_Nothing") & word(2).startswith("ed")))
    end = F.when(std & length, number(4) + number(5)).when(std, number(5)).when(y3, number(1) + number(2)).otherwise(number(4))
    start = F.when(std, number(4)).when(y3, number(1)).otherwise(number(3))
    looped = F.when(std, number(3) != 0).when(y3, end > 0).otherwise((end > 0) & ~end.isin(10000000, 99999999))
    rate = lambda c: F.when(F.col("table").endswith("_switch"), F.floor(c * F.lit(48000) / F.lit(44100))).otherwise(c)
    out = rows.filter(std | y3 | mapped)
    return out.select("folder", "table", "seq", F.when(std, word(1)).when(is_map, F.upper(word(1))).alias("title"), F.when(std, word(2)).when(y3, word(0)).otherwise(F.lower(word(1))).alias("name"), looped.alias("looped"), rate(start).cast("bigint").alias("loop_start"), rate(end).cast("bigint").alias("loop_end"))
