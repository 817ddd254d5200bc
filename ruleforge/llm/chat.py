"""Chat formatting by token-level assembly (operator 9).

Every turn is ``header text \\n</turn>\\n``.  Texts are encoded by themselves; headers and the turn's end
are reserved ids above the vocabulary, spliced between, so no text can spell a control token.  In the
formatted string the same control strings are kept apart by escapes: in a text, each control string
gets one more backslash before the backslashes that already precede it, and reading takes one away.  The
template's own control strings stand at the beginning of a line, so no text's last backslash precedes one.
A turn's place in its conversation and the loss mask (the tokens of assistant texts) are prefix sums of
segment lengths.

Turns are formatted, and read back from their tokens, row by row before anything is grouped; what
follows streams through each conversation in order with a running state, so a conversation with a third
of all rows needs no more memory than a short one.

Defined cases: null text or role is empty; a null conv_id is a conversation of its own; a null turn
comes first; turns with equal numbers go by role, then text; repeated rows count each; unknown roles
(the empty one too) get a header that spells the role; other columns are ignored; no rows, no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, encoder, vocabulary

#: Control strings in the order of their reserved ids: fixed values of the template.
CONTROL = ("### System: ", "### User: ", "### Assistant: ", "### Role: ", "<|text|>", "</turn>")
ROLES = {"system": 0, "user": 1, "assistant": 2}
OTHER, TEXT, END = 3, 4, 5
CLOSE = f"\n{CONTROL[END]}\n"
SPLIT = f"\n{CONTROL[TEXT]}"
_CONTROL = "|".join(map(re.escape, CONTROL))
_PLAIN = re.compile(rf"(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"\\(\\*)({_CONTROL})")

TURNS = "conv_id long, turn long, ids array<int>, loss_start int, loss_end int, chars long"
READ = "conv_id long, turn long, role string, text string, loss boolean, n_tokens long, chars long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\\\1\2", text) if "###" in text or "</turn>" in text or "<|text|>" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text) if "\\" in text else text


def formatted(role: str, text: str) -> str:
    """The turn as a string."""
    head = CONTROL[ROLES[role]] if role in ROLES else CONTROL[OTHER] + escape(role) + SPLIT
    return head + escape(text) + CLOSE


def read_string(turn: str) -> tuple[str, str]:
    """The inverse of formatted(), by the string alone."""
    first = re.match(_CONTROL, turn)[0]
    body = turn[len(first) : -len(CLOSE)]
    if first != CONTROL[OTHER]:
        return next(r for r, i in ROLES.items() if CONTROL[i] == first), unescape(body)
    role, text = body.split(SPLIT, 1)
    return unescape(role), unescape(text)


def read_conversation(text: str) -> list[tuple[str, str]]:
    """Role and text of all turns of a formatted conversation; only a turn's end spells CLOSE."""
    return [read_string(turn + CLOSE) for turn in text.split(CLOSE)[:-1]]


def turn_tokens(encode, first_reserved: int, role: str, text: str) -> tuple[list[int], int, int, int]:
    """Ids of a turn, where its text's tokens begin and end, by prefix sums of the segments, and the length of its
    string."""
    said = escape(text)
    if role in ROLES:
        segments, chars = [[first_reserved + ROLES[role]]], len(CONTROL[ROLES[role]])
    else:
        name = escape(role)
        segments, chars = [[first_reserved + OTHER], encode(name), [first_reserved + TEXT]], len(CONTROL[OTHER]) + len(name) + len(SPLIT)
    segments += [encode(said), [first_reserved + END]]
    sums = list(itertools.accumulate(map(len, segments)))
    return list(itertools.chain.from_iterable(segments)), sums[-3], sums[-2], chars + len(said) + len(CLOSE)


_ROLE_OF = {i: r for r, i in ROLES.items()}


def read_tokens(decode, first_reserved: int, ids: list[int], begin: int = 0, end: int = 0) -> tuple[str, str]:
    """Role and text of a turn, from its ids; the text by the loss mask's span [begin, end) where that is one."""
    head = ids[0] - first_reserved
    if head == OTHER:
        at = ids.index(first_reserved + TEXT)
        role, rest = unescape(decode(ids[1:at])), slice(at + 1, -1)
    else:
        role, rest = _ROLE_OF[head], slice(1, -1)
    return role, unescape(decode(ids[slice(begin, end) if end > begin else rest]))


def format_turns(conversations: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """A row per turn: its ids, the span of its tokens that the loss counts (empty unless the assistant
    speaks), and the length of its formatted string.  Rows keep the order (conv_id, turn, role, text)
    only through the columns that name it."""
    ranks = conversations.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        coder = encoder(ranks.value, pattern)
        first = coder.max_token_value + 1
        for batch in batches:
            ids, begin, end, chars = [], [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own, a, b, n = turn_tokens(coder.encode_ordinary, first, role, text)
                ids.append(own)
                begin.append(a)
                end.append(b if role == "assistant" else a)
                chars.append(n)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(chars, pa.int64())], names=["conv_id", "turn", "ids", "loss_start", "loss_end", "chars"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    source = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    return source.mapInArrow(run, TURNS)


def read_turns(turns: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """Role and text of every turn, read back from its tokens; loss says whether they are under the mask."""
    ranks = turns.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        coder = encoder(ranks.value, pattern)
        first = coder.max_token_value + 1
        decode = lambda ids: coder.decode_bytes(ids).decode()
        for batch in batches:
            every = [batch.column(i).to_pylist() for i in (2, 3, 4)]
            said = [read_tokens(decode, first, ids, a, b) for ids, a, b in zip(*every, strict=True)]
            loss = [r == "assistant" for r, _ in said]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([r for r, _ in said], pa.string()), pa.array([t for _, t in said], pa.string()), pa.array(loss), pa.array(map(len, every[0]), pa.int64()), batch.column(5)], names=["conv_id", "turn", "role", "text", "loss", "n_tokens", "chars"])

    return turns.mapInArrow(run, READ)


class _Running:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars, self.tokens = conv_id, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role, text, loss, n_tokens, chars):
        self.turns += 1
        self.tokens += n_tokens
        self.chars += chars
        self.all.update(f"{role}\n{text}\n".encode())
        if loss:
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self):
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens)


def _digests(batches):
    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST.split(", ")]
    make = lambda rows: pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
    now = None
    for batch in batches:
        done, c = [], batch.to_pydict()
        for conv_id, *turn in zip(c["conv_id"], c["role"], c["text"], c["loss"], c["n_tokens"], c["chars"], strict=True):
            if now is None or now.conv_id != conv_id:
                if now:
                    done.append(now.row())
                now = _Running(conv_id)
            now.add(*turn)
        yield make(done)
    if now:
        yield make([now.row()])


def digests(conversations: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """Per conversation, everything read back from the formatted tokens."""
    read = read_turns(format_turns(conversations, path, pattern), path, pattern)
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = read.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_digests, DIGEST)
