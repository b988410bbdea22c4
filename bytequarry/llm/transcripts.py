"""Transcript parsing: turns and roles of raw transcripts by a hidden Markov model over lines, then canonical rendering.

A state is a role and whether a line begins a turn of it. A line's observation
is its speaker marker ("User:", "### Response:", "<|system|>"), its length and
its kind (blank, question, list, code, other). Initial, transition and emission
counts come from labelled lines by grouped sums; the best states of a
transcript are found by Viterbi, and each line that begins a turn begins one in
the rendering too. Where turns begin in the source plays no part in it.

Lines are dealt by ranges of (transcript, place), so a transcript of any
length is spread over tasks. A task first sums up the transcripts at its two
ends as best scores from each entering to each leaving state; chaining those
few matrices fixes the states at the seams, and each task then decodes its own
part. The result is as likely as that of one pass over the whole transcript;
of equally likely ones it may be another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, staged, text_of

#: Words that name a speaker, by the role they stand for.
SPEAKERS = {"user": "user|human|customer|question|instruction|prompt|me|q", "assistant": "assistant|bot|ai|model|agent|answer|response|output|a", "system": "system|context|developer|sys", "tool": "tool|function|observation|result"}
#: Feature: number of values.
FEATURES = {"marker": len(SPEAKERS) + 1, "length": 16, "kind": 5}
#: Lines that a marker of a role's own name counts as before any are seen, where a turn begins; and lines without any, elsewhere.
MARKER_PRIOR = 200.0
#: Log chance of a move that no transcript makes: to a later line of another role's turn.
NEVER = -1e9
#: Marks of a task's first and last line among its counts.
FIRST, LAST = -1, -2
#: Lines that are decoded side by side.
LINES_AT_ONCE = 20_000
#: Scores of moves that are held at once, for transcripts side by side.
MOVES_AT_ONCE = 1 << 23
#: Ways to write a speaker's marker before a turn.
STYLES = ["{Name}: ", "### {Name}:\n", "<|{name}|>\n", "**{Name}:** ", "[{Name}] "]
#: One turn in so many is written without a marker, with one in capitals, with a line that quotes another speaker's.
BARE, SHOUTED, QUOTED = 5, 4, 6
_OPEN, _CLOSE = r"(?:#{1,6}\s*|\*\*|\[|<\|?(?:im_start\|>)?|\()", r"\s*(?::?(?:\*\*|\]|\|?>|\)):?|:|$)"


def _marker(names: str) -> str:
    """A speaker's name in brackets or the like, or with a colon, at a line's start."""
    return f"(?i)^\\s*(?:{_OPEN}(?:{names})(?:\\s*\\d+)?{_CLOSE}|(?:{names})(?:\\s*\\d+)?\\s*:)\\s*"


def marker_of(line: Column) -> Column:
    """0 for a line without a speaker marker, else 1 + the place of its role in SPEAKERS."""
    out = F.lit(0)
    for i, names in reversed(list(enumerate(SPEAKERS.values()))):
        out = F.when(F.regexp_like(line, F.lit(_marker(names))), i + 1).otherwise(out)
    return out


def marker_text(line: Column, role: Column) -> Column:
    """The marker of the role at a line's start, or nothing."""
    out = F.lit("")
    for name, names in SPEAKERS.items():
        out = F.when(role == name, F.regexp_extract(line, _marker(names), 0)).otherwise(out)
    return out


def written(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role", misleading: bool = False) -> DataFrame:
    """Raw transcripts of labelled turns: (conv_id, turn, role, text), each turn after its speaker's marker in the STYLE of its conversation (its id modulo their number). A null role writes none.

    misleading writes them as careless sources do: by a hash of (conv_id, turn)
    one turn in BARE has no marker, one in SHOUTED its marker in capitals, and
    one in QUOTED goes on with a line that quotes the marker of another speaker.
    """
    conv, role, turn = F.col(conv_col).cast("long"), F.col(role_col).cast("string"), F.col(turn_col).cast("long")
    style = F.pmod(F.coalesce(conv, F.lit(0)), F.lit(len(STYLES)))

    def mark_of(who: Column) -> Column:
        mark = F.lit("")
        for i, form in enumerate(STYLES):
            before, name, after = form.replace("{Name}", "\0N\0").replace("{name}", "\0n\0").split("\0")
            mark = F.when(style == i, F.concat(F.lit(before), F.initcap(who) if name == "N" else who, F.lit(after))).otherwise(mark)
        return mark

    mark, text = F.coalesce(mark_of(role), F.lit("")), text_of(text_col)
    if misleading:
        luck = lambda salt, one_in: F.pmod(F.crc32(F.concat_ws("/", F.lit(salt), conv.cast("string"), turn.cast("string"))), F.lit(one_in)) == 0
        mark = F.when(luck("bare", BARE), "").when(luck("shouted", SHOUTED), F.upper(mark)).otherwise(mark)
        other = F.when(role == "user", "assistant").otherwise("user")
        text = F.when(luck("quoted", QUOTED), F.concat(text, F.lit("\n"), mark_of(other), F.lit("as was said before"))).otherwise(text)
    return turns.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), F.concat(mark, text).alias("text"))


def observed(transcripts: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = "role") -> DataFrame:
    """(conv_id, turn, uid, line, role, text, code) for each line of texts, which may be whole transcripts or parts of them; uid numbers the rows, code the combination of feature values."""
    role = F.col(role_col).cast("string") if role_col else F.lit(None).cast("string")
    rows = staged(transcripts.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.monotonically_increasing_id().alias("uid"), role.alias("role"), text_of(text_col).alias("text")), "transcripts")
    lines = rows.select("conv_id", "turn", "uid", "role", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    text = F.col("text")
    length = F.least(F.lit(15), F.floor(F.log2(F.length(text) + 1))).cast("int")
    kind = F.when(F.trim(text) == "", 0).when(F.rtrim(text).endswith("?"), 1).when(F.regexp_like(text, F.lit(r"^\s*(?:[-*+\u2022]|\d+[.)])\s")), 2).when(F.regexp_like(text, F.lit(r"^(?:```|    |\t)")), 3).otherwise(4)
    return lines.select("conv_id", "turn", "uid", "line", "role", "text", ((marker_of(text) * 16 + length) * 5 + kind).cast("int").alias("code"))


def in_order(observations: DataFrame) -> DataFrame:
    """Rows by (conv_id, turn, uid, line), nulls first; checkpointed, so that later passes see the same tasks."""
    shared_dir(observations.sparkSession)
    keys = ["conv_id", "turn", "uid", "line"]
    return observations.repartitionByRange(*keys).sortWithinPartitions(*keys).checkpoint()


@dataclass
class Model:
    """States are 2 * role for a turn's first line and 2 * role + 1 for its others."""

    roles: list[str]
    start: np.ndarray
    step: np.ndarray
    emit: dict[str, np.ndarray]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """(lines, states) log chance of the observations."""
        kind, rest = codes % 5, codes // 5
        length, marker = rest % 16, rest // 16
        e = self.emit
        return e["marker"][:, marker].T + e["length"][:, length].T + e["kind"][:, kind].T


def _cut(conv: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """First rows of runs of one conversation; nulls are one."""
    new = (conv[1:] != conv[:-1]) | (valid[1:] != valid[:-1])
    return np.flatnonzero(np.append(True, new))


def _convs(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    col = b.column("conv_id")
    return col.fill_null(0).to_numpy(), col.is_valid().to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else col.is_valid().to_numpy()


def fit(ordered: DataFrame) -> Model:
    """The model of labelled lines, in_order(). Counts are summed on the executors; what lies between two tasks is counted from their ends, two rows a task."""
    roles = [r[0] for r in ordered.filter("role IS NOT NULL").select("role").distinct().orderBy("role").collect()]
    n, index = 2 * len(roles), {r: i for i, r in enumerate(roles)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, before, first = np.zeros((n + 1, n), np.int64), None, None
        for b in batches:
            if not b.num_rows:
                continue
            conv, valid = _convs(b)
            later = b.column("line").to_numpy() > 0
            state = [2 * index[x] + l if x is not None else -1 for x, l in zip(b.column("role").to_pylist(), later.tolist(), strict=True)]
            for c, v, s in zip(conv.tolist(), valid.tolist(), state, strict=True):
                if before is None:  # the first of a task may stand inside a transcript
                    first = (c, v, s)
                elif before[:2] != (c, v):
                    if s >= 0:
                        counts[n, s] += 1
                elif s >= 0 and before[2] >= 0:
                    counts[before[2], s] += 1
                before = (c, v, s)
        i, j = np.nonzero(counts)
        rows = [(a, b, k, None, None) for a, b, k in zip(i.tolist(), j.tolist(), counts[i, j].tolist(), strict=True)]
        if first:
            part = TaskContext.get().partitionId()
            rows += [(kind, x[2], 1, part, x[0] if x[1] else None) for kind, x in ((FIRST, first), (LAST, before))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["i", "j", "n", "part", "conv_id"])

    moves = np.full((n + 1, n), 0.5)
    ends: dict[tuple[int, int], tuple[int | None, int]] = {}
    for r in ordered.select("conv_id", "line", "role").mapInArrow(run, "i long, j long, n long, part long, conv_id long").groupBy("i", "j", "part", "conv_id").agg(F.sum("n").alias("n")).collect():
        if r["part"] is None:
            moves[r["i"], r["j"]] += r["n"]
        else:
            ends[r["part"], r["i"]] = (r["conv_id"], r["j"])
    last = None
    for part in sorted({p for p, _ in ends}):
        conv, state = ends[part, FIRST]
        if state >= 0 and (last is None or last[0] != conv):
            moves[n, state] += 1
        elif state >= 0 and last[1] >= 0:
            moves[last[1], state] += 1
        last = ends[part, LAST]
    table = {k: np.full((n, v), 0.5) for k, v in FEATURES.items()}
    table["marker"][1::2, 0] += MARKER_PRIOR
    for k, name in enumerate(SPEAKERS):
        if name in index:
            table["marker"][2 * index[name], k + 1] += MARKER_PRIOR
    for r in ordered.filter("role IS NOT NULL").groupBy("role", (F.col("line") > 0).alias("later"), "code").count().collect():
        i, code = 2 * index[r["role"]] + r["later"], r["code"]
        for k, v in (("kind", code % 5), ("length", code // 5 % 16), ("marker", code // 80)):
            table[k][i, v] += r["count"]
    if not n:
        return Model(["user"], np.array([0.0, NEVER]), np.zeros((2, 2)), {k: np.zeros((2, v)) for k, v in FEATURES.items()})
    logs = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    start, step, s = logs(moves[-1]), logs(moves[:-1]), np.arange(n)
    start[1::2] = NEVER
    step[(s[None, :] % 2 == 1) & (s[:, None] // 2 != s[None, :] // 2)] = NEVER
    return Model(roles, start, step, {k: logs(v) for k, v in table.items()})


def viterbi(score: np.ndarray, enter: np.ndarray, step: np.ndarray, leave: int | None = None) -> np.ndarray:
    """Best states of one sequence: scores (steps, states), log chance of the first state, of moves; ties to the first role. leave: a fixed last state."""
    n, s = score.shape
    back = np.zeros((n, s), np.int64)
    best = enter + score[0]
    for t in range(1, n):
        ways = best[:, None] + step
        back[t] = ways.argmax(axis=0)
        best = ways[back[t], np.arange(s)] + score[t]
    out = np.zeros(n, np.int64)
    out[-1] = best.argmax() if leave is None else leave
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _viterbi_many(scores: list[np.ndarray], enter: list[np.ndarray], step: np.ndarray, leave: list[int | None]) -> list[np.ndarray]:
    """viterbi() of many sequences, those of about one length side by side."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and len(scores[order[end]]) == len(scores[order[at]]) and (end == at or (end - at + 1) * step.size <= MOVES_AT_ONCE):
            end += 1
        group = order[at:end]
        at = end
        e = np.stack([scores[i] for i in group], axis=1)
        n, k, s = e.shape
        back = np.zeros((n, k, s), np.int64)
        best = np.stack([enter[i] for i in group]) + e[0]
        for t in range(1, n):
            ways = best[:, :, None] + step
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + e[t]
        states = np.zeros((n, k), np.int64)
        states[-1] = [b.argmax() if leave[i] is None else leave[i] for i, b in zip(group, best, strict=True)]
        for t in range(n - 1, 0, -1):
            states[t - 1] = back[t, np.arange(k), states[t]]
        for c, i in enumerate(group):
            out[i] = states[:, c]
    return out


def _through(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best scores of paths over some lines: to each last state, from the start and from each state before them."""
    score = model.scores(codes)
    only, mat = model.start + score[0], model.step + score[0]
    for t in range(1, len(codes)):
        only = (only[:, None] + model.step).max(axis=0) + score[t]
        mat = (mat[:, :, None] + model.step).max(axis=1) + score[t]
    return only, mat


def _ends(model: Model):
    """Per task: of its first and last transcript, the best score from each state before it to each last state in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, held = None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            conv, valid = _convs(b)
            codes, cuts = b.column("code").to_numpy(), _cut(conv, valid)
            for a, z in zip(cuts, np.append(cuts[1:], len(conv)), strict=True):
                key = (int(conv[a]), bool(valid[a]))
                if key != last:
                    if last is not None and first is None:
                        first = (last, held)
                    last, held = key, []
                held.append(codes[a:z])
        rows = [(x[0], *_through(model, np.concatenate(x[1]))) for x in (first, (last, held) if last else None) if x]
        if rows:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([i for i in range(len(rows))], pa.int32()), pa.array([r[0][0] if r[0][1] else None for r in rows], pa.int64()), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64())), pa.array([r[2].ravel().tolist() for r in rows], pa.list_(pa.float64()))], names=["part", "place", "conv_id", "fresh", "through"])

    return run


def _seams(ordered: DataFrame, model: Model) -> dict[tuple[int, int | None], tuple[int | None, int | None]]:
    """(task, transcript): (state before its part there, last state of its part), for transcripts that several tasks hold. At most two rows a task come to the driver."""
    rows = sorted(ordered.select("conv_id", "code").mapInArrow(_ends(model), "part int, place int, conv_id long, fresh array<double>, through array<double>").collect(), key=lambda r: (r["part"], r["place"]))
    out: dict[tuple[int, int | None], tuple[int | None, int | None]] = {}
    s = len(model.start)
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and rows[end]["conv_id"] == rows[at]["conv_id"]:
            end += 1
        chain = rows[at:end]
        at = end
        if len(chain) < 2:
            continue
        best, back = np.array(chain[0]["fresh"]), []
        for r in chain[1:]:
            ways = best[:, None] + np.array(r["through"]).reshape(s, s)
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0)
        state = [int(best.argmax())]
        for b in reversed(back):
            state.append(int(b[state[-1]]))
        state.reverse()
        for i, r in enumerate(chain):
            out[(r["part"], r["conv_id"])] = (state[i - 1] if i else None, state[i])
    return out


def recover(ordered: DataFrame, model: Model) -> DataFrame:
    """One row per line of in_order(): conv_id, turn, uid, line, declared (the role it came with), number (of the recovered turn in its transcript, from 0), role (recovered), begins (a turn), marker, rendered.

    Declared roles, turns and places of lines play no part in the recovery. A
    null text is one empty line, a null conv_id is one transcript, a null turn
    stands first; rows that repeat a turn stand in the order of their uid.
    rendered is the line in canonical form: where a turn begins, <|role|> on a
    line of its own and the rest of the line, if any, without the marker that
    names the role; else the line as it is. What is cut stands in `marker`, so
    no text is lost; a transcript's rendering is its lines in order. An empty
    table gives an empty result.
    """
    seams = _seams(ordered, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), (None, 0)

        def decode(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal before
            t = pa.Table.from_batches(held).combine_chunks()
            conv, valid = _convs(t)
            cuts = _cut(conv, valid)
            score = model.scores(t.column("code").to_numpy())
            parts = [score[a:z] for a, z in zip(cuts, np.append(cuts[1:], len(conv)), strict=True)]
            known = [seams.get((part, int(conv[a]) if valid[a] else None), (None, None)) for a in cuts]
            enter = [model.start if e is None else model.step[e] for e, _ in known]
            paths = _viterbi_many(parts, enter, model.step, [x for _, x in known])
            seen = []
            for a, p in zip(cuts, paths, strict=True):
                key = (int(conv[a]), bool(valid[a]))
                seen.append(np.cumsum(p % 2 == 0) + (before[1] if before[0] == key else 0))
                before = (key, int(seen[-1][-1]))
            states = np.concatenate(paths)
            cols = [t.column(c).chunk(0) for c in ("conv_id", "turn", "uid", "line", "role", "text")]
            return pa.RecordBatch.from_arrays([*cols, pa.array([model.roles[i] for i in (states // 2).tolist()], pa.string()), pa.array(states % 2 == 0), pa.array(np.full(len(conv), part), pa.int32()), pa.array(np.concatenate(seen), pa.int64())], names=["conv_id", "turn", "uid", "line", "declared", "text", "role", "begins", "part", "seen"])

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            conv, valid = _convs(b)
            cut = int(_cut(conv, valid)[-1])
            if n >= LINES_AT_ONCE or b.num_rows >= LINES_AT_ONCE:
                # all but the last transcript, which may go on, unless this batch goes on with what is held
                last_c, last_v = _convs(held[-1]) if held else (None, None)
                same = held and cut == 0 and last_c[-1] == conv[0] and last_v[-1] == valid[0]
                if not same and (held or cut):
                    yield decode([*held, *([b.slice(0, cut)] if cut else [])])
                    held, n = [], 0
                    b = b.slice(cut)
            held.append(b)
            n += b.num_rows
        if held:
            yield decode(held)

    found = staged(ordered.mapInArrow(run, "conv_id long, turn long, uid long, line int, declared string, text string, role string, begins boolean, part int, seen long"), "decoded-lines")
    # turns of a transcript that earlier tasks hold: known for at most two transcripts a task
    spanning = sorted({(p, c is None, c or 0) for p, c in seams})
    shared = found.sparkSession.createDataFrame([(p, None if none else c) for p, none, c in spanning], "part int, conv_id long")
    counts = found.join(F.broadcast(shared), (found["part"] == shared["part"]) & found["conv_id"].eqNullSafe(shared["conv_id"]), "left_semi").groupBy("part", "conv_id").agg(F.max("seen").alias("n")).collect()
    so_far: dict = {}
    shift = []
    for r in sorted(counts, key=lambda r: r["part"]):
        shift.append((r["part"], r["conv_id"], so_far.get(r["conv_id"], 0)))
        so_far[r["conv_id"]] = so_far.get(r["conv_id"], 0) + r["n"]
    moved = found.sparkSession.createDataFrame(shift, "p int, c long, earlier long")
    placed = found.join(F.broadcast(moved), (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    marker = F.when(F.col("begins"), marker_text(F.col("text"), F.col("role"))).otherwise("")
    rest = F.substring("text", F.length("marker") + 1, F.length("text"))
    head = F.concat(F.lit("<|"), "role", F.lit("|>"), F.when(rest == "", "").otherwise(F.concat(F.lit("\n"), rest)))
    numbered = placed.withColumn("marker", marker).withColumn("number", F.col("seen") + F.coalesce("earlier", F.lit(0)) - 1)
    return numbered.select("conv_id", "turn", "uid", "line", "declared", "number", "role", "begins", "marker", F.when(F.col("begins"), head).otherwise(F.col("text")).alias("rendered"))


def turns_of(lines: DataFrame) -> DataFrame:
    """(conv_id, number, role, rendered): the lines of recover() joined to turns. A turn is gathered in one task, so this is for transcripts whose turns fit there."""
    rows = lines.groupBy("conv_id", "number").agg(F.first("role").alias("role"), F.sort_array(F.collect_list(F.struct("turn", "uid", "line", "rendered"))).alias("lines"))
    return rows.select("conv_id", "number", "role", F.array_join("lines.rendered", "\n").alias("rendered"))
