"""Packing token sequences by minimum bin slack.

A document is its token ids and one end id. Longer documents are cut into full sequences from
their end, so that the first piece may be shorter. Full pieces are sequences of their own. How
the other pieces are packed depends on the number of pieces of each length only, a table of at
most CAPACITY rows, which is all that the driver sees. Bin by bin, the longest length left is
put in and a bitset subset-sum program over the lengths available (each as often as it is
available) finds the fullest feasible bin; its lengths are then removed. The same combination
stays the fullest as long as its lengths last, so it is taken as often as they allow: at most
CAPACITY different combinations arise, whatever the number of bins.

The pieces of one length are numbered over many tasks and take the places that the
combinations have for that length, by number.

Nulls, ties and repeats: a null text is the empty text, which is one end id. Pieces of one
length are numbered by document and piece; it makes no difference to the number of sequences
which of them takes which place. Repeated rows are packed one by one. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import PATTERN, byte_signs
from .common import bounded_batches, salted_rank, table, texts_of, work_folder, written
from .words import Pieces, vocabulary_path

CAPACITY = 2048
END_ID = 0
#: Rows of one length that one task numbers, about.
ROWS_A_SALT = 500_000
#: Pieces that a worker keeps ids of, and code points that it works on at a time: about 150 MB in all.
KEPT_PIECES, PART_CHARS = 150_000, 1_000_000


class LibraryEncoder:
    """Ids by an installed tokenizer library, from the ranks of a tokenizers vocabulary file."""

    def __init__(self, path: str):
        import json
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = byte_signs()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(signs[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in special}
        self.special = list(special)
        self.library = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size_of = np.array([len(x) for x in sorted(ranks, key=ranks.get)], np.int64)
        self.pieces = Pieces(self.encode_pieces, most=KEPT_PIECES)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        joint = [i for i, p in enumerate(pieces) if p[:1] == " " and not p[-1].isspace()]
        text = "".join([pieces[i] for i in joint])
        if any(x in text for x in self.special):
            joint, text = [], ""
        ids = np.array(self.library.encode_ordinary(text), np.int64)
        ends = np.cumsum([len(pieces[i].encode()) for i in joint])
        at = [0, *(4 * np.searchsorted(np.cumsum(self.size_of[ids]), ends, "right")).tolist()]
        body = ids.astype("<u4").tobytes()
        for i, s, e in zip(joint, at, at[1:]):
            out[i] = body[s:e]
        done = set(joint)
        for i, p in enumerate(pieces):
            if i not in done and p:
                out[i] = np.array(self.library.encode(p, allowed_special="all"), "<u4").tobytes()
        return out


_LIBRARY: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _LIBRARY:
        _LIBRARY[path] = LibraryEncoder(path)
    return _LIBRARY[path]


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
               keep_ids: bool = False) -> DataFrame:
    """doc_id, row (of the document), piece, start, length, ids_crc32 (and ids) of every piece."""
    bounded_batches(docs.sparkSession)
    path = path or vocabulary_path()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        enc = library_encoder(path)
        for batch in batches:
            ids, rows, doc, piece, start, length, crc, body = batch.column(0), batch.column(1), [], [], [], [], [], []
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for k, found in enumerate(enc.pieces.encode_all(texts, PART_CHARS)):
                found += end
                n = len(found) // 4
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                for p, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    part = found[4 * s:4 * e]
                    doc.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        body.append(part)
            doc = pa.array(doc, pa.int64())
            columns = [ids.take(doc), rows.take(doc), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(body, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts_of(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(
        run, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long"
             + (", ids binary" if keep_ids else ""))


def fullest_bin(available: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """How often each length goes into the fullest bin that holds the longest length.

    ``available`` has (length, count), longest first. The bitset after each step says which
    sums are feasible with the lengths so far; going back over the steps finds one way to the
    largest sum.
    """
    longest = available[0][0]
    mask = (1 << capacity + 1) - 1
    reach, steps, full = 1 << longest, [], 1 << capacity
    for i, (length, count) in enumerate(available):
        left = min(count - (i == 0), capacity // length)
        take = 1
        while left > 0 and not reach & full:
            n = min(take, left)
            steps.append((length, n, reach))
            reach |= reach << length * n & mask
            left -= n
            take *= 2
        if reach & full:
            break
    at, out = reach.bit_length() - 1, {longest: 1}
    for length, n, earlier in reversed(steps):
        if not earlier >> at & 1:
            out[length] = out.get(length, 0) + n
            at -= length * n
    return out


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(copies, {length: times}) of every combination, for ``counts`` pieces of each length."""
    left = {k: n for k, n in counts.items() if n}
    plan = []
    while left:
        combination = fullest_bin(sorted(left.items(), reverse=True), capacity)
        copies = min(left[k] // n for k, n in combination.items())
        plan.append((copies, combination))
        for k, n in combination.items():
            left[k] -= copies * n
            if not left[k]:
                del left[k]
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, row, piece, length, ...) with sequence_id and offset.

    ``pieces`` is read twice: give a written table.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    places, first_bin, taken = [], 0, {k: 0 for k in counts}
    for copies, combination in plan_bins(counts, capacity):
        offset = 0
        for length, times in sorted(combination.items(), reverse=True):
            places.append((length, taken[length], taken[length] + copies * times, times, first_bin, offset))
            taken[length] += copies * times
            offset += length * times
        first_bin += copies
    salts = max(8, -(-max(counts.values(), default=0) // ROWS_A_SALT))
    ranked = salted_rank(pieces, ["length"], ["row", "piece"], salts, "at")
    # a place's numbers: from, to, times per bin, first bin, offset in the bin; at most capacity**2 / 2 rows, a few thousand in fact
    by_length: dict[int, list] = {}
    for length, *place in places:
        by_length.setdefault(length, []).append(place)
    kinds = "length long, places array<struct<lo:long,hi:long,times:long,bin:long,offset:long>>"
    slots = spark.createDataFrame(list(by_length.items()), kinds).select("length", F.inline("places"))
    found = ranked.join(slots, (ranked["length"] == slots["length"]) & (F.col("at") >= F.col("lo"))
                        & (F.col("at") < F.col("hi"))).drop(slots["length"])
    number = F.col("at") - F.col("lo")
    return found.select(
        *pieces.columns,
        (F.col("bin") + F.floor(number / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("offset") + number % F.col("times") * F.col("length")).cast("long").alias("offset"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = written(cut_pieces(table(spark, sf_dir, "documents")), work_folder(spark, "packing"), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
