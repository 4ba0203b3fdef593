"""Chat formatting: a hidden Markov model finds the turns and roles of a transcript, which is then rendered in one form.

The model's states say whose turn a line is in and whether it begins it. Each line that isn't blank is observed as its
speaker marker, whether a blank line or the text's start comes before it, its length and its punctuation, which are
independent given the state. All probabilities are counted from labelled transcripts; Viterbi gives the likeliest states.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import prepare

ROLES = ("system", "user", "assistant")
#: The bound on the labelled conversations that the model is counted from, and what is added to every count.
TRAIN, SMOOTHING = 2000, 0.1
#: Words that name a speaker. A line begins with a marker if it begins with such a word and a sign of one of the usual forms.
SPEAKERS = "user human customer question q prompter me assistant ai bot agent answer a gpt model system instruction instructions context".split()
_MARKER = re.compile(
    rf"^[ \t]*(?:<\|?(?:im_start\|>)?({'|'.join(SPEAKERS)})\|?>|\[({'|'.join(SPEAKERS)})\]:?|#{{1,6}} ?({'|'.join(SPEAKERS)}):?(?=\s|$)|\*\*({'|'.join(SPEAKERS)}):?\*\*:?|({'|'.join(SPEAKERS)}):)[ \t]*",
    re.IGNORECASE,
)
#: How a turn of each role begins, and what stands between turns, in the styles of the transcripts that are made from tables.
STYLES: tuple[tuple[dict[str, str], str], ...] = (
    ({"system": "System: ", "user": "User: ", "assistant": "Assistant: "}, "\n"),
    ({"system": "### Instruction:\n", "user": "### Human: ", "assistant": "### Assistant: "}, "\n"),
    ({"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}, "\n"),
    ({"system": "Context: ", "user": "Q: ", "assistant": "A: "}, "\n\n"),
    ({"system": "**System:** ", "user": "**Customer:** ", "assistant": "**Agent:** "}, "\n\n"),
    ({"system": "", "user": "", "assistant": "[AI] "}, "\n\n"),
)
_LENGTHS, _ENDS = 8, 4


@dataclass(frozen=True)
class Line:
    number: int  # in the transcript, blank lines included
    marker: int  # 0 for none, else 1 + place in SPEAKERS
    body: str  # without the marker
    gap: int  # 0 after another line, 1 after a blank one, 2 at the start
    length: int
    end: int


def lines(text: str) -> list[Line]:
    """The lines of a transcript that aren't blank, as they are observed."""
    out, gap = [], 2
    for k, raw in enumerate(text.split("\n")):
        if not raw.strip():
            gap = max(gap, 1)
            continue
        found = _MARKER.match(raw)
        name = next(g for g in found.groups() if g).lower() if found else ""
        body = raw[found.end() :] if found else raw
        bare = body.strip()
        end = 0 if not bare else 1 if bare[-1] == "?" else 2 if bare[-1] in ".!:;)\"'”»…" else 3
        out.append(Line(k, 1 + SPEAKERS.index(name) if found else 0, body, gap, min(_LENGTHS - 1, len(bare).bit_length() * 2 // 3), end))
        gap = 0
    return out


def _observed(of: list[Line]) -> np.ndarray:
    return np.array([(x.marker, x.gap, x.length, x.end) for x in of], np.int64).reshape(-1, 4)


def render_raw(turns: list[tuple[str | None, str | None]], style: int, sep: str | None = None) -> tuple[str, list[tuple[int, str]]]:
    """A transcript in one of the styles, with its own separator or another; the line that each turn begins in, and its role."""
    starts, sep = STYLES[style][0], STYLES[style][1] if sep is None else sep
    text, begins = "", []
    for k, (role, body) in enumerate(turns):
        text += sep if k else ""
        begins.append((text.count("\n"), role))
        text += starts.get(role or "", "") + (body or "")
    return text, begins


class Model:
    """Logarithms of the probabilities: states are role * 2, and one more within the turn."""

    SIZES = (1 + len(SPEAKERS), 3, _LENGTHS, _ENDS)

    def __init__(self) -> None:
        n = 2 * len(ROLES)
        self.start, self.move = np.zeros(n), np.zeros((n, n))
        self.emit = [np.zeros((n, size)) for size in self.SIZES]

    def count(self, text: str, begins: list[tuple[int, str]]) -> None:
        """Add a labelled transcript; turns of other roles or without a line are left out."""
        at = {k: role for k, role in begins}
        states, seen, role = [], [], None
        pending = None
        for x in lines(text):
            for k in sorted(k for k in at if k <= x.number):
                pending = at.pop(k)
            begin = pending is not None
            role, pending = (pending, None) if begin else (role, None)
            if role not in ROLES:
                continue
            states.append(2 * ROLES.index(role) + (not begin))
            seen.append(x)
        for k, (state, row) in enumerate(zip(states, _observed(seen))):
            if k:
                self.move[states[k - 1], state] += 1
            else:
                self.start[state] += 1
            for table, value in zip(self.emit, row):
                table[state, value] += 1

    def finish(self) -> Model:
        n = len(self.start)
        state = np.arange(n)
        inside = (state % 2).astype(bool)
        # within a turn the role can't change, and a transcript can't start within one
        ok = ~inside[None, :] | (state[:, None] // 2 == state[None, :] // 2)
        with np.errstate(divide="ignore"):
            self.start = np.log(np.where(inside, 0, self.start + SMOOTHING) / (self.start[~inside] + SMOOTHING).sum())
            move = np.where(ok, self.move + SMOOTHING, 0)
            self.move = np.log(move / move.sum(1, keepdims=True))
        # within a turn a marker is as rare whoever speaks; a role with few such lines would make it seem frequent
        self.emit[0][inside] = self.emit[0][inside].sum(0)
        self.emit = [np.log((t + SMOOTHING) / (t + SMOOTHING).sum(1, keepdims=True)) for t in self.emit]
        return self

    def viterbi(self, seen: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest states of each sequence; of equal ones the first state. All sequences advance together, the longest first."""
        size = np.array([len(s) for s in seen], np.int64)
        order = np.argsort(-size, kind="stable")
        longest = int(size.max(initial=0))
        live = np.searchsorted(-size[order], -np.arange(longest), side="left")
        back, score = [], np.empty((len(seen), len(self.start)))
        for k in range(longest):
            now = order[: live[k]]
            row = np.stack([seen[i][k] for i in now])
            here = sum(table[:, row[:, j]].T for j, table in enumerate(self.emit))
            if k == 0:
                score[: len(now)] = self.start + here
            else:
                step = score[: len(now), :, None] + self.move[None]
                back.append(step.argmax(1))
                score[: len(now)] = step.max(1) + here
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(seen)
        for place, i in enumerate(order):
            path = np.empty(size[i], np.int64)
            if len(path):
                path[-1] = score[place].argmax()
                for k in range(len(path) - 1, 0, -1):
                    path[k - 1] = back[k - 1][place, path[k]]
            out[i] = path
        return out

    def parse(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """Role and text of the turns of each transcript. Blank lines within a turn stay."""
        of = [lines(t) for t in texts]
        out = []
        for text, seen, states in zip(texts, of, self.viterbi([_observed(x) for x in of])):
            raw, turns = text.split("\n"), []
            first = [k for k, s in enumerate(states) if s % 2 == 0]
            for k, until in zip(first, [*first[1:], len(seen)]):
                last = seen[until - 1].number
                body = [seen[k].body, *raw[seen[k].number + 1 : last + 1]]
                turns.append((ROLES[states[k] // 2], "\n".join(body).strip()))
            out.append(turns)
        return out


_SIGNS = re.compile(rf"<(\\*)\|({'|'.join((*ROLES, 'end'))})\|>")
_ESCAPED = re.compile(rf"<\\(\\*)\|({'|'.join((*ROLES, 'end'))})\|>")


def canonical(turns: list[tuple[str, str]]) -> str:
    """The one form: a sign of the role, the text and a sign of its end. A sign within a text gets a backslash, so that `turns_of` gives the turns back."""
    return "".join(f"<|{role}|>\n{_SIGNS.sub(r'<\\\1|\2|>', text)}\n<|end|>\n" for role, text in turns)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The turns that `canonical` was given."""
    found = re.findall(rf"<\|({'|'.join(ROLES)})\|>\n(.*?)\n<\|end\|>\n", formatted, re.DOTALL)
    return [(role, _ESCAPED.sub(r"<\1|\2|>", text)) for role, text in found]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, style and the ordered turns of each conversation."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    # a turn without conv_id is a conversation by itself; all of them together would be one row without bound
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    own = conversations.select("conv_id", alone, "turn", "role", "text")
    return own.groupBy("conv_id", "alone").agg(turns.alias("turns")).drop("alone").withColumn("style", style)


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id and the text of every conversation, its turns joined in a style that depends on conv_id.

    Turns are ordered by turn, then role and text; a null role has no marker, a null text is empty, a null turn comes last. Repeated rows
    are repeated turns. A row without conv_id is a conversation of one turn. A transcript is one text, as a document is: it must fit in a row.
    Other columns are not read. An empty table gives no rows.
    """
    prepare(conversations.sparkSession)
    id_type = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("turns").to_pylist(), batch.column("style").to_pylist())
            texts = [render_raw([(t["role"], t["text"]) for t in turns], style)[0] for turns, style in rows]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(texts, pa.string())], names=["conv_id", "text"])

    return _turns(conversations).mapInArrow(run, f"conv_id {id_type}, text string")


def train(conversations: DataFrame, most: int = TRAIN) -> Model:
    """The model of up to `most` conversations, those with the least hash of conv_id, each rendered in its style, with and without blank lines and the system's turn.

    Turns of null or other roles are left out, as are rows without conv_id; repeated rows are repeated turns. Of an empty table
    comes a model in which everything is equally likely.
    """
    prepare(conversations.sparkSession)
    ids = conversations.where("conv_id IS NOT NULL").select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(most)
    model = Model()
    for row in _turns(conversations.join(F.broadcast(ids), "conv_id", "left_semi")).collect():
        turns, starts = [(t.role, t.text) for t in row.turns], STYLES[row.style][0]
        # a transcript may lack the system's turn; where every role has a marker, it may lack or have blank lines between turns
        for some in (turns, turns[1:]) if len(turns) > 1 and turns[0][0] == "system" else (turns,):
            for sep in ("\n", "\n\n") if all(starts.values()) else (None,):
                text, begins = render_raw(some, row.style, sep)
                model.count(text, [(k, role) for k, role in begins if role is not None])
    return model.finish()


def parse(texts: DataFrame, model: Model) -> DataFrame:
    """conv_id, n_turns, roles (divided by commas) and formatted (the canonical rendering) of every row of conv_id and text.

    The texts are transcripts in any of the usual forms, from tables or elsewhere; nothing but the text is looked at. `turns_of` reads
    the canonical form again. Of equally likely roles the first of ROLES is taken.

    A null text has null roles and formatted and 0 turns; an empty or blank one has empty ones. Whole transcripts are parsed. Repeated
    rows and null ids are rows like any other; other columns are not read. An empty table gives no rows.
    """
    prepare(texts.sparkSession)
    id_type = texts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").to_pylist()
            for at in range(0, len(column), 500):
                part = column[at : at + 500]
                found = model.parse([t or "" for t in part])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("conv_id").slice(at, len(part)),
                        pa.array([len(x) for x in found], pa.int32()),
                        pa.array([None if t is None else ",".join(r for r, _ in x) for t, x in zip(part, found)], pa.string()),
                        pa.array([None if t is None else canonical(x) for t, x in zip(part, found)], pa.string()),
                    ],
                    names=["conv_id", "n_turns", "roles", "formatted"],
                )

    return texts.select("conv_id", "text").mapInArrow(run, f"conv_id {id_type}, n_turns int, roles string, formatted string")
