"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
_SPELLINGS = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "customer", "question", "q", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "answer", "a", "agent"),
}
_ROLE_OF = {s: r for r, names in _SPELLINGS.items() for s in names}
_NAMES = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
_MARKER = re.compile(rf"^\s*(?:#{{1,6}}\s*({_NAMES})\s*:?\s*$|(?:\*\*|\[)?({_NAMES})(?:\*\*|\])?\s*:(?:\*\*)?(?:\s+|$)|<\|(?:im_start\|>)?({_NAMES})(?:\|>)?\s*)", re.I)


def marker(line: str) -> tuple[str | None, str]:
    """The role that a line's speaker marker names, and what follows the marker; (None, line) without one."""
    found = _MARKER.match(line)
    if not found:
        return None, line
    return _ROLE_OF[next(g for g in found.groups() if g).lower()], line[found.end() :]


_LETTERS = {"q": "a", "a": "q"}


def markers(lines: list[str]) -> list[tuple[str | None, str]]:
    """``marker`` of each line of a transcript. A single letter, ``Q:`` or ``A:``, names a speaker only where the other one does too:
    a line such as "A: apples" in a transcript without questions is content."""
    found = [_MARKER.match(x) for x in lines]
    names = [next(g for g in f.groups() if g).lower() if f else None for f in found]
    seen = set(names)
    out: list[tuple[str | None, str]] = []
    for line, f, name in zip(lines, found, names):
        if f is None or name in _LETTERS and _LETTERS[name] not in seen:
            out.append((None, line))
        else:
            out.append((_ROLE_OF[name], line[f.end() :]))
    return out


def line_symbol(line: str, first: bool) -> int:
    """A line's features as one of 64 symbols: whether it opens a turn, its length, whether it asks, whether it's a list or code."""
    size = min(7, max(0, int(math.log2(len(line) + 1)) - 1)) if line else 0
    return first * 32 + size * 4 + line.rstrip().endswith("?") * 2 + bool(re.match(r"\s*(?:[-*`]|\d+[.)]\s|\s{4})", line))


@dataclass(frozen=True)
class RoleModel:
    """Log probabilities: of the first role, of the next turn's role, and of a line's symbol, by role.

    ``right_marker`` is how often a speaker marker names the true role. It outweighs what a few lines' style and the order of
    roles can say, even where these were learnt from few and uniform conversations. ``stay`` is how often a turn goes on at a line:
    at a plain one, after blank lines in a transcript with markers and in one without, and at a marker.
    """

    start: Mapping[str, float]
    turn: Mapping[tuple[str, str], float]
    symbol: Mapping[tuple[str, int], float]
    right_marker: float = 0.9999
    stay: Mapping[str, float] = field(default_factory=lambda: {"line": 0.995, "blank": 0.98, "parted": 0.1, "marker": 0.05})


def train_role_model(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> RoleModel:
    """A model by smoothed counts over all labelled turns: of roles, of pairs of neighbours, and of line symbols.

    Turns with null or other roles don't count. What reaches the driver is a few hundred counts. Without labelled turns all is even.
    How often blank lines lie within turns, rather than between them, says how often a turn goes on after some; where a transcript
    has markers one turn in twenty is taken to lack its own.
    """
    known = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.lower(F.trim(role_col)).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    before = F.lag("r").over(Window.partitionBy("c").orderBy("t", "r", "x"))
    gaps = F.size(F.split(F.trim("x"), "\n[ \t\r]*\n\\s*")) - 1
    pairs = known.withColumn("b", before).groupBy("b", "r").agg(F.count("*").alias("count"), F.sum(gaps).alias("gaps")).collect()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[str, int], int] = {}
        for batch in batches:
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, line in enumerate(text.strip().split("\n")):
                    key = role, line_symbol(line, n == 0)
                    count[key] = count.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.int32()), pa.array(list(count.values()), pa.int64())], ["r", "s", "n"])

    symbols = known.where(F.col("r").isin(*ROLES)).select("r", "x").mapInArrow(run, "r string, s int, n long").groupBy("r", "s").agg(F.sum("n").alias("n")).collect()
    first = {r: 1.0 for r in ROLES}
    turn = {(a, b): 0.5 for a in ROLES for b in ROLES}
    for p in pairs:
        if p["r"] in ROLES and p["b"] is None:
            first[p["r"]] += p["count"]
        elif (p["b"], p["r"]) in turn:
            turn[p["b"], p["r"]] += p["count"]
    emitted = {(r, s): 0.5 for r in ROLES for s in range(64)}
    for p in symbols:
        emitted[p["r"], p["s"]] += p["n"]

    def logs(counts: dict, group: object) -> dict:
        total: dict = {}
        for k, v in counts.items():
            total[group(k)] = total.get(group(k), 0) + v
        return {k: math.log(v / total[group(k)]) for k, v in counts.items()}

    inside, between = sum(p["gaps"] for p in pairs) + 0.5, sum(p["count"] for p in pairs if p["b"] is not None) + 0.5
    stay = {"line": 0.995, "blank": inside / (inside + 0.05 * between), "parted": inside / (inside + between), "marker": 0.05}
    return RoleModel(logs(first, lambda k: 0), logs(turn, lambda k: k[0]), logs(emitted, lambda k: k[0]), stay=stay)


def decode_roles(model: RoleModel, text: str) -> list[tuple[str, bool, str]]:
    """(role, whether a marker opens it, content) of each line of a transcript, by Viterbi; ties go to the first of ROLES.

    A line with a marker opens a turn. One after blank lines may open one: rarely in a transcript that has markers, mostly in one
    that has none. Other lines go on with their turn, all but always. Content that looks like a marker is one, but for single
    letters without their counterpart (``markers``).
    """
    lines = text.split("\n")
    marks = markers(lines)
    parted = "blank" if any(m for m, _ in marks) else "parted"
    wrong = math.log((1 - model.right_marker) / (len(ROLES) - 1))
    right = math.log(model.right_marker)
    # from role to role: the turn goes on, or another one begins, whose role follows that of the last
    move = {k: {(b, r): math.log((1 - v) * math.exp(model.turn[b, r]) + (v if b == r else 0.0)) for b in ROLES for r in ROLES} for k, v in model.stay.items()}
    best: dict[str, float] = {}
    back: list[dict[str, str]] = []
    after_blank, begun = True, False  # blank lines before all else belong to the first turn
    for n, (mark, rest) in enumerate(marks):
        opens = mark is not None or after_blank
        kind = "marker" if mark is not None else parted if after_blank and n else "line"
        symbol = line_symbol(rest, opens)
        now, come = {}, {}
        for r in ROLES:
            if not begun:
                top, via = model.start[r], r
            else:
                moved = move[kind]
                top, via = -math.inf, r
                for b in ROLES:
                    w = best[b] + moved[b, r]
                    if w > top:
                        top, via = w, b
            if rest.strip() or mark is None:
                top += model.symbol[r, symbol] if rest.strip() else 0.0
            if mark is not None:
                top += right if mark == r else wrong
            now[r], come[r] = top, via
        best = now
        back.append(come)
        begun |= mark is not None or bool(rest.strip())
        after_blank = not rest.strip() and mark is None and (n > 0 or not rest)
    role = max(ROLES, key=lambda r: best[r])
    out = []
    for n in range(len(lines) - 1, -1, -1):
        out.append((role, marks[n][0] is not None, marks[n][1]))
        role = back[n][role]
    return out[::-1]


def turns_of(model: RoleModel, text: str) -> list[tuple[str, str]]:
    """(role, content) turns: neighbouring lines of one role, without markers, stripped; turns left empty go, and neighbours of one role join."""
    turns: list[tuple[str, str]] = []
    held: list[str] = []
    role = ""

    def close() -> None:
        content = "\n".join(held).strip()
        if content:
            if turns and turns[-1][0] == role:
                turns[-1] = role, turns[-1][1] + "\n" + content
            else:
                turns.append((role, content))
        held.clear()

    for r, opens, content in decode_roles(model, text):
        if held and (r != role or opens):
            close()
        role = r
        held.append(content)
    close()
    return turns


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{content}\n<|end|>\n" for role, content in turns)


def as_transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", withhold: bool = False) -> DataFrame:
    """(conv_id, transcript): turns in order as plain text, each behind a speaker marker, in one of three styles by conversation.

    A null or other role has no marker and a blank line before it. Null texts are empty. A null conv_id is a conversation like any
    other; ties in ``turn`` are ordered by role and text; null turns come first. With ``withhold`` every other conversation, by its
    hash, has no markers at all, only blank lines before its turns, and in the others every third turn, by its number, has none.
    """
    role = F.lower(F.trim(F.col(role_col)))
    style = F.coalesce(F.pmod(F.hash(F.col(conv_col)), F.lit(3)), F.lit(0))

    def spelled(*names: str) -> Column:
        return F.when(role == "system", names[0]).when(role == "user", names[1]).when(role == "assistant", names[2]).otherwise("\n")

    mark = F.when(style == 0, spelled("System: ", "User: ", "Assistant: ")).when(style == 1, spelled("### System\n", "### Human\n", "### AI\n")).otherwise(spelled("<|system|>\n", "<|user|>\n", "<|assistant|>\n"))
    if withhold:
        bare = (F.pmod(F.xxhash64(F.col(conv_col)), F.lit(2)) == 0) | (F.pmod(F.col(turn_col), F.lit(3)) == 2)
        mark = F.when(F.coalesce(bare, F.lit(False)), F.lit("\n")).otherwise(mark)
    piece = F.struct(F.col(turn_col).alias("t"), role.alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"), mark.alias("m"))
    lines = F.transform(F.array_sort(F.collect_list(piece)), lambda p: F.concat(p["m"], p["x"]))
    return turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_join(lines, "\n").alias("transcript"))


def format_transcripts(transcripts: DataFrame, model: RoleModel, conv_col: str = "conv_id", text_col: str = "transcript") -> DataFrame:
    """(conv_id, n_turns, roles, rendered) for every transcript: recovered roles and canonical text. One narrow pass.

    A null or blank transcript has no turns and renders as the empty text. Ids may be null or repeat; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [turns_of(model, t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in every], pa.int32()), pa.array([[r for r, _ in t] for t in every], pa.list_(pa.string())), pa.array([render(t) for t in every], pa.string())],
                ["conv_id", "n_turns", "roles", "rendered"],
            )

    thin = transcripts.select(F.col(conv_col).alias("conv_id"), F.col(text_col).cast("string").alias("t"))
    kind = thin.schema["conv_id"].dataType.simpleString()
    return thin.mapInArrow(run, f"conv_id {kind}, n_turns int, roles array<string>, rendered string")
