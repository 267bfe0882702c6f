"""Chat formatting by token-level assembly.

Every turn is formatted by itself: control tokens are reserved ids beyond the
tokenizer's vocabulary and are spliced between separately encoded segments, so
no text can produce one.  The same turns also have a printable form

    ### <role>: <text> </turn>\\n

in which control strings that occur in a text are escaped, reversibly: in a
text, a backslash is put before every ``\\``, ``#`` that starts ``###`` and
``<`` that starts ``</turn>``.  Conversations are the turns in order, nothing
between; character and token offsets, and so the loss mask over assistant
texts, are prefix sums over the turns.

Rows, one a turn, stay rows.  They are dealt by ranges of conversation and turn,
so a long conversation is spread over tasks; offsets are running sums in a range,
and what a conversation brings from the ranges before (at most one row a range) is
added.  Formatting, parsing and decoding work turn by turn.  Only the digest of a
conversation is sequential: one fold of hashes over its turns, in a stream of
bounded memory.  A worker takes a batch in slices of some rows or bytes and keeps
its tokenizer, which runs in the task's one thread.  Null texts are empty texts; a
null role is the role "unknown"; a role may be any string (escaped as texts are,
and colons as well).  Rows of equal turn are ordered by role, then text; null turns
come first.  A null conversation id is a conversation of its own.  Extra columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.llm.storage import durable

HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
#: Reserved ids, counted from the size of the vocabulary.
TURN, TEXT, END = 0, 1, 2
TRAINED = "assistant"

_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Put a backslash before every character that could start a control string, and before backslashes."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    """Roles are also free of the string that ends them."""
    return re.sub(r"\\|:|#(?=##)|<(?=/turn>)", lambda m: "\\" + m[0], role)


TURNS = (
    "conv_id long, turn long, role string, text string, formatted string, text_start int, text_end int, "
    "ids array<int>, loss array<boolean>, n_chars long, n_tokens long"
)
PLACED = ", part int, char_start long, token_start long"

#: What is taken from a batch at once: as Python objects, ids and texts are many times as large as in the batch.
ROWS, BYTES = 512, 1 << 20


def _slices(batch: pa.RecordBatch, *texts: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of ROWS rows and BYTES bytes of these columns at most, or of one row."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch[k]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in texts))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, BYTES + (ends[at - 1] if at else 0), "right"))
        end = min(max(end, at + 1), at + ROWS)
        yield batch.slice(at, end - at)
        at = end


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    """A worker's tokenizer, read once for all its tasks.  A task has one core, so it runs in one thread."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _format(path: str):
    """Sorted turns as TURNS, with their range and their offsets since the conversation began in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = _tokenizer(path)
        base = tokenizer.get_vocab_size(with_added_tokens=True)
        part, now, at = TaskContext.get().partitionId(), object(), [0, 0]
        for whole in batches:
            for batch in _slices(whole, "role", "text"):
                roles, texts = batch["role"].to_pylist(), batch["text"].to_pylist()
                segments = [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(roles + texts, add_special_tokens=False)]
                out: dict[str, list] = {k: [] for k in ("formatted", "text_start", "text_end", "n_chars", "n_tokens", "char_start", "token_start")}
                ids, loss = [], []
                for conv, role, text, who, said in zip(batch["conv_id"].to_pylist(), roles, texts, segments[: len(roles)], segments[len(roles) :], strict=True):
                    head = HEAD + escape_role(role) + MIDDLE
                    body = escape(text)
                    own = np.concatenate([[base + TURN], who, [base + TEXT], said, [base + END]])
                    mask = np.zeros(len(own), bool)
                    mask[len(who) + 2 : -1] = role == TRAINED
                    ids.append(own)
                    loss.append(mask)
                    if conv != now:
                        now, at = conv, [0, 0]
                    formatted = head + body + TAIL
                    for k, x in zip(out, (formatted, len(head), len(head) + len(body), len(formatted), len(own), *at), strict=True):
                        out[k].append(x)
                    at = [at[0] + len(formatted), at[1] + len(own)]
                places = pa.array(np.cumsum([0, *out["n_tokens"]]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["conv_id"], batch["turn"], batch["role"], batch["text"], pa.array(out["formatted"], pa.string()),
                        pa.array(out["text_start"], pa.int32()), pa.array(out["text_end"], pa.int32()),
                        pa.ListArray.from_arrays(places, pa.array(np.concatenate(ids), pa.int32())), pa.ListArray.from_arrays(places, pa.array(np.concatenate(loss))),
                        *(pa.array(out[k], pa.int64()) for k in ("n_chars", "n_tokens")), pa.array([part] * batch.num_rows, pa.int32()),
                        *(pa.array(out[k], pa.int64()) for k in ("char_start", "token_start")),
                    ],
                    [x.split()[0] for x in (TURNS + PLACED).split(", ")],
                )

    return run


#: Characters of a role and of a text that count when ranges are told apart.
PREFIX = 64


def _range_keys() -> list:
    """In the order of conversation, turn, role and text, but short: Spark takes a sample of them to the driver.

    A text counts only where the role is whole.  Rows that begin alike share a range and are sorted there.
    """
    return [F.col("conv_id"), F.col("turn"), F.substring("role", 1, PREFIX), F.when(F.length("role") < PREFIX, F.substring("text", 1, PREFIX))]


def format_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """TURNS of ``conv_id, turn, role, text`` with ``char_start`` and ``token_start`` in the conversation.

    ``formatted`` and ``ids`` are the turn's part of the conversation's string
    and tokens; ``text_start`` and ``text_end`` bound the escaped text in
    ``formatted``; ``loss`` marks the ids that are trained on.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    keys = ["conv_id", "turn", "role", "text"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(n, *_range_keys()).sortWithinPartitions(*keys).mapInArrow(_format(tokenizer), TURNS + PLACED)
    placed = durable(ranges, "chat-turns")
    sums = placed.groupBy("conv_id", "part").agg(F.sum("n_chars").alias("chars"), F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", F.col("part").alias("to"), F.sum("chars").over(before).alias("chars"), F.sum("tokens").over(before).alias("tokens")).filter("chars is not null")
    carried = F.broadcast(carried.withColumnRenamed("conv_id", "of"))  # a range begins within one conversation at most
    out = placed.join(carried, (F.col("part") == F.col("to")) & F.col("conv_id").eqNullSafe(F.col("of")), "left")
    starts = {f"{k}_start": F.col(f"{k}_start") + F.coalesce(f"{k}s", F.lit(0)) for k in ("char", "token")}
    return out.withColumns(starts).drop("part", "to", "of", "chars", "tokens")


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted string; start and end bound the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn at {at}")
        at += len(HEAD)
        colon = re.compile(r"(?:[^\\:]|\\.)*", re.DOTALL).match(formatted, at).end()
        role, start = unescape(formatted[at:colon]), colon + len(MIDDLE)
        end = start
        while not formatted.startswith(TAIL, end):
            end += 2 if formatted[end] == "\\" else 1
            skip = re.compile(r"[^\\ ]*").match(formatted, end)
            end = skip.end()
            if end > len(formatted):
                raise ValueError("a turn does not end")
        out.append((role, unescape(formatted[start:end]), start, end))
        at = end + len(TAIL)
    return out


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


PARTS = "conv_id long, char_start long, token_start long, n_chars long, n_tokens long, n int, said string, trained string"


def _read_turns(path: str):
    """Turn by turn: parse the formatted string, decode the masked tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for whole in batches:
            for batch in _slices(whole, "formatted"):
                formatted = batch["formatted"].to_pylist()
                sizes = pc.list_value_length(batch["ids"])
                if sizes != pc.list_value_length(batch["loss"]):
                    raise ValueError("a turn's mask is not as long as its tokens")
                ids, loss = batch["ids"].flatten().to_numpy(), batch["loss"].flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes.to_numpy())
                masked = [own[mask].tolist() for own, mask in zip(np.split(ids, ends[:-1]), np.split(loss, ends[:-1]), strict=True)]
                found = [parse(x) for x in formatted]
                said = ["".join(f"{role}\n{text}\n" for role, text, _, _ in turns) for turns in found]
                columns = {
                    "n_chars": pa.array([len(x) for x in formatted], pa.int64()), "n_tokens": sizes.cast(pa.int64()), "n": pa.array([len(x) for x in found], pa.int32()),
                    "said": pa.array(said, pa.string()), "trained": pa.array(tokenizer.decode_batch(masked, skip_special_tokens=False), pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*(batch[k] for k in ("conv_id", "char_start", "token_start")), *columns.values()], [x.split()[0] for x in PARTS.split(", ")])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream over turns sorted by conversation and place: digests and counts."""
    now, state = None, None
    done: list[tuple] = []

    def close() -> None:
        if state is not None:
            done.append((now[0], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["tokens"]))

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in READ.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
        done.clear()
        return batch

    for batch in (x for whole in batches for x in _slices(whole, "said", "trained")):
        for conv, char_start, token_start, n_chars, n_tokens, n, said, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or now != (conv,):
                close()
                now = (conv,)
                state = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0}
            if (char_start, token_start) != (state["chars"], state["tokens"]):
                raise ValueError(f"conversation {conv}: a turn at {char_start}, {token_start} follows {state['chars']}, {state['tokens']}")
            state["n"] += n
            state["turns"].update(said.encode())
            state["loss"].update(trained.encode())
            state["loss_chars"] += len(trained)
            state["chars"] += n_chars
            state["tokens"] += n_tokens
        if len(done) >= 1000:
            yield flush()
    close()
    if done:
        yield flush()


def read_back(turns: DataFrame, tokenizer: str) -> DataFrame:
    """READ for each conversation, from nothing but the formatted turns: strings, ids, masks and offsets."""
    rows = turns.select("conv_id", "formatted", "ids", "loss", "char_start", "token_start").mapInArrow(_read_turns(tokenizer), PARTS)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "char_start").mapInArrow(_digest, READ)


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(format_turns(turns.unionByName(extra), path), path)
