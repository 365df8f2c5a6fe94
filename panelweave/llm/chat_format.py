"""Chat logs folded into final messages and rendered with a reversible template.

A log holds events in sequence: a message is opened, streamed deltas are appended to it, an edit
replaces its text, a regeneration discards what was streamed so far. Events of one turn never touch
another turn, so the fold runs apart for each conversation and turn, in order of sequence, and a
conversation of any length is spread over many tasks. Only reading a whole conversation in order,
as a digest must, needs its rendered turns in one sorted stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import batch_of, map_arrow, rows_of

TURN, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that steer chat models and may not stand in a rendered text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
TRAINED_ROLE = "assistant"
_ROW = "conv_id long, turn long, part long, piece string, loss_start long, loss_end long"
_FIELDS = [("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string."""
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it stands in the formatted text, and the span under the loss mask inside it (empty if untrained)."""
    head = f"{TURN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    piece = head + body + END
    return piece, len(head), len(head) + (len(body) if role == TRAINED_ROLE else 0)


def read(piece: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    head, _, body = piece[len(TURN) : len(piece) - len(END)].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head, flags=re.DOTALL)
    return role, unescape(body)


def format_log(events: DataFrame) -> DataFrame:
    """Rendered turns of an event log: ``conv_id``, ``turn``, ``part``, ``piece``, ``loss_start``, ``loss_end``.

    The formatted conversation is its pieces joined in order of turn, then part. ``loss_start`` and ``loss_end``
    bound the trained characters inside a piece. Events have ``conv_id``, ``turn``, ``seq``, ``op``, ``role``, ``text``; ``op`` is
    ``message`` (opens a message), ``delta`` (appends), ``edit`` (replaces) or ``regenerate`` (empties); a null or other op
    opens a message. Deltas, edits and regenerations of a turn without an open message open one. Null texts and
    roles are empty; a role on a later event replaces the message's. Null conversations and turns are
    ordinary values that sort first. Ties in ``seq`` go by op (messages first), role, text, so repeated message rows
    give repeated messages. Other columns are not read.
    """
    ops = F.create_map(*(F.lit(x) for kv in {"message": 0, "regenerate": 1, "edit": 2, "delta": 3}.items() for x in kv))
    log = events.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("seq").cast("long"), F.coalesce(ops[F.col("op")], F.lit(0)).alias("op"),
        F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    log = log.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", "op", "role", "text")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, role, texts, is_open = None, 0, "", [], False

        def done() -> tuple:
            return (*key, part, *render(role, "".join(texts)))

        for b in batches:
            rows = []
            for conv, turn, op, new_role, text in rows_of(b, "conv_id", "turn", "op", "role", "text"):
                if (conv, turn) != key:
                    if is_open:
                        rows.append(done())
                    key, part, is_open = (conv, turn), -1, False
                if op == 0 or not is_open:
                    if is_open:
                        rows.append(done())
                    part, role, texts, is_open = part + 1, new_role or "", [], True
                elif op in (1, 2):
                    texts = []
                if new_role is not None:
                    role = new_role
                if op != 1:
                    texts.append(text)
            yield batch_of(rows, _FIELDS)
        if is_open:
            yield batch_of([done()], _FIELDS)

    return map_arrow(log, fold, _ROW)


def conversations_as_events(conversations: DataFrame) -> DataFrame:
    """Rows of (``conv_id``, ``turn``, ``role``, ``text``) as a log in which each row opens a message."""
    return conversations.select("conv_id", "turn", F.lit(0).alias("seq"), F.lit("message").alias("op"), "role", "text")


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, from the rendered turns alone: ``n_turns``, digests of turns and trained text, lengths.

    Pieces stream in order through one pass that keeps running digests, so memory does not grow with a
    conversation. Columns: ``conv_id``, ``n_turns``, ``turns_sha256`` (role, newline, text, newline per turn), ``loss_chars``,
    ``loss_sha256``, ``formatted_chars``.
    """
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, chars, trained, turns, loss, any_row = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), False
        for b in batches:
            rows = []
            for c, piece, start, end in rows_of(b, "conv_id", "piece", "loss_start", "loss_end"):
                if not any_row or c != conv:
                    if any_row:
                        rows.append((conv, n, turns.hexdigest(), trained, loss.hexdigest(), chars))
                    conv, n, chars, trained, turns, loss, any_row = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), True
                role, text = read(piece)
                masked = unescape(piece[start:end])
                n, chars, trained = n + 1, chars + len(piece), trained + len(masked)
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(masked.encode())
            yield batch_of(rows, fields)
        if any_row:
            yield batch_of([(conv, n, turns.hexdigest(), trained, loss.hexdigest(), chars)], fields)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_arrow(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part"), run, schema)


def formatted(pieces: DataFrame) -> DataFrame:
    """Whole conversations as one string each, with the spans under the loss mask in it.

    For conversations that fit one row; ``format_log`` has no such limit.
    """
    order: Column = F.array_sort(F.collect_list(F.struct("turn", "part", "piece", "loss_start", "loss_end")))
    whole = pieces.groupBy("conv_id").agg(order.alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    spans = F.aggregate(
        "p", start,
        lambda a, p: F.struct(
            (a["at"] + F.length(p["piece"])).alias("at"),
            F.when(p["loss_end"] > p["loss_start"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["loss_start"]).alias("start"), (a["at"] + p["loss_end"]).alias("end")))))
            .otherwise(a["spans"]).alias("spans"),
        ),
    )
    return whole.select("conv_id", F.concat_ws("", F.col("p.piece")).alias("text"), spans["spans"].alias("loss_spans"))
