"""Chat formatting in budgeted windows.

The template marks every turn `<|turn|>role` ... `<|end|>`; inside texts and roles a backslash and a
letter stand for `\\`, `<` and `[`, which escapes every control string reversibly. A conversation's
turns are laid in order and their tokens summed up; prefix sums choose spans of whole turns that fit
the budget. A window holds the system turn (if the first turn is one), as much of the turns before it as fits the history
budget, and its own turns. Only assistant turns that are a window's own are under its loss mask, so a
target that is repeated as history is masked out.

Turns are marked and their tokens counted where they are read, as the text that is written. Conversations
are then dealt by id and sorted by turn, and a task streams through them: it holds one window and its
history, never a conversation, however long that is; what it does for a turn is to add up its tokens. So a
conversation that holds a third of all turns is one task's work, but a light one. A turn alone over the
budget is a window of its own; it is not cut.

Defined cases: a null text or role is empty; a null conversation id is a conversation; turns that tie
are ordered by role and text, repeated rows are repeated turns; a system turn that is not first is a
turn like any other; an empty table gives no windows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, stage, table

TURN, END = "<|turn|>", "<|end|>"
BUDGET, HISTORY = 1024, 256
TOKENS = "byte_bpe_50k.tiktoken"
WINDOW = "window int, first_turn long, n_system int, n_history int, n_own int, tokens long, text string, loss array<struct<start:int,end:int>>"

_CODES = {"\\": "\\b", "<": "\\l", "[": "\\k", "\n": "\\n", "\r": "\\r"}
_BACK = {code[1]: plain for plain, code in _CODES.items()}
_ESCAPED = re.compile(r"\\(.)")


def escape(text: str) -> str:
    """No backslash, `<` or `[` of the text is left, so no control string is."""
    return text.replace("\\", _CODES["\\"]).replace("<", _CODES["<"]).replace("[", _CODES["["])


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text) if "\\" in text else text


def escape_role(role: str) -> str:
    """A role holds no line break in the format."""
    return escape(role).replace("\n", _CODES["\n"]).replace("\r", _CODES["\r"])


def render(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn, and where in it the text starts and ends."""
    head, body = f"{TURN}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def counter(path: str):
    """Tokens of a text by a public byte-level vocabulary; one encoder a worker."""
    if path not in _COUNTERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        _COUNTERS[path] = tiktoken.Encoding("turns", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoding = _COUNTERS[path]
    return lambda text: sum(len(encoding.encode_ordinary(text[i : i + 65_536])) for i in range(0, len(text), 65_536))


_COUNTERS: dict = {}


class Turn:
    __slots__ = ("marked", "start", "end", "target", "upto", "tokens")

    def __init__(self, role: str, text: str, tokens: int, upto: int):
        self.marked, self.start, self.end = render(role, text)
        self.target, self.tokens, self.upto = role == "assistant", tokens, upto + tokens


def windows(turns: Iterable[tuple[str, str, int]], budget: int, history: int) -> Iterator[tuple]:
    """Windows of one conversation's (role, text, tokens) turns, in order; tokens are those of the marked turn."""
    system, past, own, upto, place, number = None, [], [], 0, 0, 0

    def close():
        parts, loss, at = ([system] if system else []) + past + own, [], 0
        for k, t in enumerate(parts):
            if t.target and k >= len(parts) - len(own):
                loss.append({"start": at + t.start, "end": at + t.end})
            at += len(t.marked)
        return number, place - len(own), int(system is not None), len(past), len(own), sum(t.tokens for t in parts), "".join(t.marked for t in parts), loss

    def limited(turns_, most):
        """The last turns whose prefix sums span at most `most` tokens."""
        floor = turns_[-1].upto - most if turns_ else 0
        return [t for t in turns_ if t.upto - t.tokens >= floor]

    for role, text, tokens in turns:
        turn = Turn(role, text, tokens, upto)
        upto = turn.upto
        if place == 0 and number == 0 and system is None and not own and role == "system":
            system = turn
            continue
        fixed = system.tokens if system else 0
        if own and fixed + turn.upto - (past or own)[0].upto + (past or own)[0].tokens > budget:
            yield close()
            past, own, number = limited(past + own, min(history, max(0, budget - fixed - turn.tokens))), [], number + 1
        own.append(turn)
        place += 1
    if own or system:
        yield close()


def grouped(batches: Iterable[pd.DataFrame], key: str) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of equal keys over batches, each as a stream of its rows."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from batch.itertuples(index=False, name=None)

    yield from groupby(rows(), key=lambda r: None if pd.isna(r[0]) else r[0])


def dealt(turns: DataFrame, *order: str) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def form(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """Windows of the conversations in turns (conv_id, turn, role, text): conv_id and the columns of WINDOW.

    loss holds the offsets of the targets in text."""
    import public_tokenizers

    path = tokenizer or public_tokenizers.path(TOKENS)
    bound_batches(turns.sparkSession)

    def tokens_of(roles: pd.Series, texts: pd.Series) -> pd.Series:
        count = counter(path)
        return pd.Series([count(render(r, t)[0]) for r, t in zip(roles, texts, strict=True)], dtype="int64")

    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = dealt(plain.withColumn("tokens", F.pandas_udf(tokens_of, "long")("role", "text")), "turn", "role", "text")

    def run(batches):
        out, held = [], 0
        for conv, rows_ in grouped(batches, "conv_id"):
            for w in windows(((r, t, n) for _, r, t, n in rows_), budget, history):
                out.append((conv, *w))
                held += len(w[6])
                if held > 4_000_000:
                    yield frame(out)
                    out, held = [], 0
        yield frame(out)

    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "role", "text", "tokens").mapInPandas(run, f"conv_id {kind}, {WINDOW}")


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["conv_id", *(x.split()[0] for x in WINDOW.replace("array<struct<start:int,end:int>>", "x").split(", "))]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"conv_id": object})


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window."""
    found = []
    for marked in text.split(f"{END}\n")[:-1]:
        role, _, body = marked[len(TURN) :].partition("\n")
        found.append((unescape(role), unescape(body)))
    return found


def summary(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": object})


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from its windows alone: turns in order, repeats left out, and the text under the loss masks."""
    rows = dealt(formatted.select("conv_id", "window", "n_system", "n_history", "text", "loss"), "window")

    def run(batches):
        out = []
        for conv, ws in grouped(batches, "conv_id"):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, window, n_system, n_history, text, spans in ws:
                parsed = parse(text)
                fresh = parsed[n_system + n_history :] if window else parsed[:n_system] + parsed[n_system + n_history :]
                for role, body in fresh:
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    body = unescape(text[s["start"] : s["end"]])
                    loss.update(body.encode("utf-8", "surrogatepass"))
                    loss_chars += len(body)
                n, chars = n + len(fresh), chars + len(text)
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 10_000:
                yield summary(out)
                out = []
        yield summary(out)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark, sf_dir):
    """op3: every conversation, and one that tries the escapes, formatted, written, and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return read_back(stage(form(turns.unionByName(odd)), "windows"))
