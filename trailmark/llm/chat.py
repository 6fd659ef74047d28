"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole and encoded once, with the code point offsets of every token. The
places of its turns in the rendered text are known from rendering; a token is under the loss mask if
its span meets the text of a turn that is to be learnt, which two binary searches per turn find.

The template's markers are single tokens of the tokenizer that formats, so no token reaches over the
edge of a turn. Inside roles and texts every control string gets a backslash after its first
character (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), so a marker in the output is always
the template's own, and taking one backslash out gives the text back.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import small_batches, table

TOKENIZER = "byte_bpe_50k.json"
# The turns of the conversation that op12 adds, whose texts are made of the template's own markers.
OWN = "</s>[INST] ok [/INST]"
OWN_ID = -1


@dataclass(frozen=True)
class Template:
    """``begin``, then for each turn ``role`` + its role + ``body`` + its text + ``end``.

    ``reserved`` are further strings that a tokenizer would take for control tokens. No marker may
    hold a backslash, or the first character of any marker past its own first place: then escaped texts
    hold no marker, and none can arise where a text meets a marker.
    """

    begin: str = "<s>"
    role: str = "[INST]"
    body: str = "[/INST]"
    end: str = "</s>"
    reserved: tuple[str, ...] = ("<|endoftext|>",)

    def __post_init__(self):
        controls = self.controls
        firsts = {c[:1] for c in controls}
        if "" in firsts or len(set(self.markers)) < 4:
            raise ValueError("markers must be four different strings, and none empty")
        if any(x in firsts or x == "\\" for c in controls for x in c[1:]) or "\\" in firsts:
            raise ValueError("a marker holds a backslash or a marker's first character")

    @property
    def markers(self) -> tuple[str, ...]:
        return self.begin, self.role, self.body, self.end

    @property
    def controls(self) -> tuple[str, ...]:
        return (*self.markers, *self.reserved)

    @cached_property
    def _patterns(self) -> tuple[re.Pattern, re.Pattern]:
        def any_of(slashes: str) -> re.Pattern:
            return re.compile("|".join(re.escape(c[0]) + slashes + re.escape(c[1:]) for c in self.controls))

        return any_of(r"\\*"), any_of(r"\\+")

    def escape(self, text: str) -> str:
        return self._patterns[0].sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._patterns[1].sub(lambda m: m[0][0] + m[0][2:], text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text of a conversation of (role, text), and where each turn's text stands in it."""
        parts, spans, at = [self.begin], [], len(self.begin)
        for role, text in turns:
            head = self.role + self.escape(role) + self.body
            inner = self.escape(text)
            spans.append((at + len(head), at + len(head) + len(inner)))
            parts += [head, inner, self.end]
            at = spans[-1][1] + len(self.end)
        return "".join(parts), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) of a rendered conversation."""
        if not formatted.startswith(self.begin):
            raise ValueError("not a rendered conversation")
        out = []
        for turn in formatted[len(self.begin) :].split(self.end)[:-1]:
            role, text = turn[len(self.role) :].split(self.body)
            out.append((self.unescape(role), self.unescape(text)))
        return out


@cache
def tokenizer(path: str, markers: tuple[str, ...]):
    """One per worker process; the file is part of the installed tokenizers on every machine. Markers
    are added as tokens of their own, with the ids after the vocabulary's."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path)
    made.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in markers])
    return made


def meets(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens, given by ascending ``starts`` and ``ends``, share a character with one of ``spans``."""
    marks = np.zeros(len(starts) + 1, np.int64)
    a, b = np.array(spans, np.int64).reshape(-1, 2).T
    full = b > a
    np.add.at(marks, np.searchsorted(ends, a[full], "right"), 1)
    np.add.at(marks, np.searchsorted(starts, b[full], "left"), -1)
    return np.cumsum(marks)[:-1] > 0


def under(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The text under the mask, one string per stretch of masked tokens. Tokens that share a character
    (its bytes) give it once."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    first = np.concatenate([[True], np.diff(at) > 1])
    last = np.concatenate([first[1:], [True]])
    return [formatted[a:b] for a, b in zip(starts[at[first]].tolist(), ends[at[last]].tolist())]


FORMATTED = "formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"


def format_chats(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn: tuple[str, ...] = ("assistant",),
    template: Template = Template(),
    path: str | None = None,
) -> DataFrame:
    """One row per conversation: its id, the ``formatted`` text, the token ``ids`` with the code point
    offsets of each (``starts``, ``ends``), and ``loss_mask``, true where a token belongs to the text of
    a turn whose role is one of ``learn``.

    Turns stand in order of ``turn``, equal ones by role, then text, nulls first; repeated rows are
    repeated turns. Null texts and roles are empty. Rows without an id are one conversation without an id.
    Other columns of ``turns`` take no part. An empty table gives no rows. A conversation is one row,
    so the longest must fit a task; nothing else is gathered.
    """
    path = path or os.path.realpath(public_tokenizers.path(TOKENIZER))
    rows = turns.select(
        F.col(f"`{conversation}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path, template.markers)
        for batch in batches:
            out: dict[str, list] = {"formatted": [], "ids": [], "starts": [], "ends": [], "loss_mask": []}
            for listed in batch.column(1).to_pylist():
                said = [(t["role"], t["text"]) for t in listed]
                formatted, spans = template.render(said)
                coded = coder.encode(formatted, add_special_tokens=False)
                places = np.array(coded.offsets, np.int32).reshape(-1, 2)
                learnt = [s for s, (r, _) in zip(spans, said) if r in learn]
                out["formatted"].append(formatted)
                out["ids"].append(np.array(coded.ids, np.int32))
                out["starts"].append(places[:, 0])
                out["ends"].append(places[:, 1])
                out["loss_mask"].append(meets(learnt, places[:, 0], places[:, 1]))
            ints, flags = pa.list_(pa.int32()), pa.list_(pa.bool_())
            kinds = (pa.string(), ints, ints, ints, flags)
            arrays = [pa.array(v, type=t) for v, t in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["conv", *out])

    small_batches(turns.sparkSession)
    made = whole.mapInArrow(run, f"conv {kind}, {FORMATTED}")
    return made.withColumnRenamed("conv", conversation)


def read_back(chats: DataFrame, conversation: str = "conv_id", template: Template = Template()) -> DataFrame:
    """Digests of what the output of ``format_chats`` says: its turns parsed from the formatted text, and
    the text under its loss mask."""
    kind = chats.schema[conversation].dataType.simpleString()
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in names}
            for formatted, *token in zip(*(batch.column(i) for i in range(1, 5))):
                formatted = formatted.as_py()
                starts, ends, mask = (x.values.to_numpy(zero_copy_only=False) for x in token)
                said = "".join(f"{r}\n{t}\n" for r, t in template.parse(formatted))
                # a stretch is the text of one turn; each is unescaped by itself
                lost = "".join(map(template.unescape, under(formatted, starts, ends, mask)))
                out["n_turns"].append(formatted.count(template.end))
                out["turns_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
                out["loss_chars"].append(len(lost))
                out["loss_sha256"].append(hashlib.sha256(lost.encode()).hexdigest())
                out["formatted_chars"].append(len(formatted))
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            arrays = [pa.array(out[n], type=k) for n, k in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["conv", *names])

    ddl = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    source = chats.select(F.col(f"`{conversation}`").alias("conv"), "formatted", "starts", "ends", "loss_mask")
    return source.mapInArrow(run, f"conv {kind}, {ddl}").withColumnRenamed("conv", conversation)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from all formatted conversations, and from one whose texts are markers."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(OWN_ID, 0, "user", OWN), (OWN_ID, 1, "assistant", OWN)]
    added = spark.createDataFrame(own, "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(added)))


# A control string, with the backslashes that escaping has put after its first character before.
_CONTROL = r"(<\\*(?:\|endoftext\|>|/?s>)|\[\\*/?INST\])"

OP12_SQL = rf"""
WITH rows_ AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '{OWN}'), (-1, 1, 'assistant', '{OWN}')
), sized AS (
    SELECT *, length(role) + len(regexp_extract_all(role, '{_CONTROL}'))
        + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + length('[INST][/INST]</s>') AS chars
    FROM rows_
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (length('<s>') + sum(chars))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
