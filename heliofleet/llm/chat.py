r"""Chat formatting at token level, with a loss mask, and reading it back.

A turn is ``### Role: content</turn>`` and a line end. Its segments are encoded separately and
three reserved ids, which no text can give, are spliced in: TURN_START, ROLE_END and TURN_END,
which stand for ``### ``, ``: `` and ``</turn>\n``. In role and content, a control string gets a
backslash in front, and so does a backslash, so that the rendered text can be read back too.
The loss mask covers the content ids of assistant turns: +1 where such a segment starts, -1
where it ends, summed up along the batch.

Each row is formatted by itself, so a conversation of very many turns is spread over all tasks;
reading back streams over conversations sorted by turn and holds digests only.

Nulls, ties and repeats: a null text or role is empty; a null conv_id is a conversation of its
own; null turns come first. Rows with the same turn are ordered by role and text, so repeated
rows stand next to each other, each as a turn. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import encoder
from .common import bounded_batches, table
from .words import vocabulary_path

TURN_START, ROLE_END, TURN_END = 50257, 50258, 50259
SIGNS = {TURN_START: "### ", ROLE_END: ": ", TURN_END: "</turn>\n"}
TRAINED_ROLE = "assistant"
CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(.)", re.S)
#: Roles that are written with a capital; all others come as they are, behind a mark.
PLAIN_ROLE = re.compile("[a-z]*")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turns(turns: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, ids (int array) and mask (0/1 array) for every row of ``turns``."""
    bounded_batches(turns.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        enc = encoder(path, specials=False)
        for batch in batches:
            roles = [x or "" for x in batch.column(2).to_pylist()]
            texts = [x or "" for x in batch.column(3).to_pylist()]
            titles = [escape(r.capitalize() if PLAIN_ROLE.fullmatch(r) else "=" + r) for r in roles]
            found = [np.frombuffer(x, "<u4") for x in
                     enc.pieces.encode_all([y for t, x in zip(titles, texts) for y in (t, escape(x))])]
            segments, sizes = [], []
            start, mid, end = (np.array([x], "<u4") for x in (TURN_START, ROLE_END, TURN_END))
            for title, body in zip(found[::2], found[1::2]):
                own = (start, title, mid, body, end)
                segments.extend(own)
                sizes.extend(map(len, own))
            edges = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
            change = np.zeros(edges[-1] + 1, np.int8)
            trained = 5 * np.flatnonzero([r == TRAINED_ROLE for r in roles]) + 3
            np.add.at(change, edges[trained], 1)
            np.add.at(change, edges[trained + 1], -1)
            rows = pa.array(edges[::5], pa.int32())
            ids = np.concatenate(segments).astype(np.int32) if segments else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(rows, pa.array(ids)),
                 pa.ListArray.from_arrays(rows, pa.array(np.cumsum(change, dtype=np.int8)[:-1]))],
                names=["conv_id", "turn", "role", "text", "ids", "mask"])
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role", "text")}
    return turns.select(*kinds).mapInArrow(
        run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", ids array<int>, mask array<tinyint>")


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Digests per conversation of ``formatted``, taken from its ids and mask alone."""
    bounded_batches(formatted.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        enc = encoder(path, specials=False)
        state = None  # conv_id, turns, digest of turns, loss code points, digest of the loss, code points
        for batch in batches:
            ids, masks = batch.column(1), batch.column(2)
            out = []
            for k, conv in enumerate(batch.column(0).to_pylist()):
                if state is None or state[0] != conv:
                    out += [state] if state else []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turn = ids[k].values.to_numpy(zero_copy_only=False)
                mask = masks[k].values.to_numpy(zero_copy_only=False).astype(bool)
                mid = int(np.flatnonzero(turn == ROLE_END)[0])
                text_of = lambda x: enc.decode(x.astype("<u4").tobytes())
                title, body = text_of(turn[1:mid]), text_of(turn[mid + 1:-1])
                role = unescape(title)
                role = role[1:] if role[:1] == "=" else role[:1].lower() + role[1:]
                loss = unescape(text_of(turn[mask]))
                state[1] += 1
                state[2].update(f"{role}\n{unescape(body)}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(title) + len(body) + sum(map(len, SIGNS.values()))
            yield rows(out)
        yield rows([state] if state else [])

    kind = formatted.schema["conv_id"].dataType

    def rows(states):
        from pyspark.sql.pandas.types import to_arrow_type

        cols = list(zip(*states)) or [()] * 6
        hexed = lambda x: [d.hexdigest() for d in x]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], to_arrow_type(kind)), pa.array(cols[1], pa.int64()), pa.array(hexed(cols[2]), pa.string()),
             pa.array(cols[3], pa.int64()), pa.array(hexed(cols[4]), pa.string()), pa.array(cols[5], pa.int64())],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(
        run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, "
             "loss_sha256 string, formatted_chars long")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "'\\\\### Assistant: </turn> ok'"
    more = spark.sql(f"SELECT -7L AS conv_id, turn, role, {said} AS text "
                     "FROM VALUES (0L, 'user'), (1L, 'assistant') t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_turns(turns))


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
         replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS title FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(title) + CASE WHEN regexp_full_match(role, '[a-z]*') THEN 0 ELSE 1 END + length(body) + 14) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""
