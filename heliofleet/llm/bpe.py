"""Byte-level BPE encoding by a pair occurrence index, and decoding.

Texts are encoded in Arrow batches. All words of a batch that have no ids yet lie one after
another in one symbol list. The index maps each mergeable pair to all its positions in that
list; the active ranks are applied in ascending order. Applying a rank visits exactly the
positions listed for it, joins the two symbols there, and adds the two pairs that arise to the
lists of their own ranks (a position listed in vain is recognised by its changed symbols).

Words are the pre-tokens of the vocabulary file's byte-level pattern; merges never cross them.
Ids found for words are kept in the worker process for later batches, in a table of bounded
size: it decides how often a word is encoded, never what its ids are.

Nulls, ties and repeats: a null or empty text has no ids and decodes to the empty text.
Occurrences of one pair are merged from left to right. Rows are encoded one by one, so repeated
rows give repeated results; an empty table gives an empty result. Special tokens of the file
are recognised in texts, as the library does by default; ``specials=False`` takes their strings
as ordinary text.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, table, texts_of
from .words import Pieces, vocabulary_path

#: Fixed value: the published pattern that byte-level BPE vocabularies split texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes without a printable sign of their own get the code points from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_signs() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexEncoder:
    """Ids of words and texts, and back. One instance lives in each worker process."""

    def __init__(self, path: str, specials: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = byte_signs()
        vocab = spec["model"]["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        for t in spec["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.byte_id = np.array([vocab[c] for c, _ in sorted(signs.items(), key=lambda x: x[1])], np.int32)
        merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self._table(np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64))
        self.parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.pattern = regex.compile(PATTERN)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]} if specials else {}
        self.added = {k: np.uint32(v).tobytes() for k, v in added.items()}
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") \
            if added else None
        self.pieces = Pieces(self.encode_pieces, most=300_000)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids (little-endian uint32) of texts that are encoded independently of each other."""
        words, counts, added = [], np.zeros(len(pieces), np.int64), {}
        joint = [i for i, p in enumerate(pieces) if p[:1] == " " and not p[-1].isspace()]
        text = "".join([pieces[i] for i in joint])
        if any(x in text for x in self.added):
            joint, text = [], ""
        # pieces that start with a space and end with a visible sign don't change each other
        words = self.pattern.findall(text)
        ends = np.cumsum([len(pieces[i]) for i in joint])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts[joint] = np.diff(np.searchsorted(np.cumsum(lengths), ends, "right"), prepend=0)
        single, joined = [], set(joint)
        for i in (i for i in range(len(pieces)) if i not in joined):
            parts = self.cut_added.split(pieces[i]) if self.cut_added else [pieces[i]]
            own: list[str] = []
            for x in parts:
                own.extend((x,) if x in self.added else self.pattern.findall(x))
            single.append((i, len(own)))
            words.extend(own)
        ids, at = self.encode_words(words)
        out: list[bytes] = [b""] * len(pieces)
        where = 0
        for i, n in [*zip(joint, counts[joint].tolist()), *single]:
            out[i] = ids[at[where]:at[where + n]]
            where += n
        return out

    def _table(self, keys):
        """A hash table of the merges: layer n has, for each slot, the (n+1)-th pair that falls there."""
        self.factor, self.shift = np.int64(-7046029254386353131), np.uint64(64 - 20)
        slot = (keys * self.factor).view(np.uint64) >> self.shift
        self.slot_key, self.slot_rank = [], []
        left = np.arange(len(keys))
        while len(left) or not self.slot_key:
            key, rank = np.full(1 << 20, -1, np.int64), np.full(1 << 20, -1, np.int32)
            _, first = np.unique(slot[left], return_index=True)
            key[slot[left[first]]], rank[slot[left[first]]] = keys[left[first]], left[first]
            self.slot_key.append(key)
            self.slot_rank.append(rank)
            left = np.delete(left, first)

    def ranks_of(self, left, right):
        """The rank of each pair of symbols, -1 where there is no merge."""
        key = left.astype(np.int64) << 32 | right
        key[(left < 0) | (right < 0)] = 0
        slot = (key * self.factor).view(np.uint64) >> self.shift
        out = np.where(self.slot_key[0][slot] == key, self.slot_rank[0][slot], -1)
        for keys, ranks in zip(self.slot_key[1:], self.slot_rank[1:]):
            out = np.where(keys[slot] == key, ranks[slot], out)
        return out

    def encode_words(self, words: list[str]) -> tuple[bytes, list[int]]:
        """The pair occurrence index over all ``words``: their ids one after another, and cuts."""
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        points = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        upto = points[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))] if words else points[:0]
        ends = upto + np.arange(1, len(words) + 1)
        sizes = np.diff(upto, prepend=0)
        symbol = np.full(len(raw) + len(words) + 2, -1, np.int32)
        symbol[np.arange(1, len(raw) + 1) + np.repeat(np.arange(len(words)), sizes)] = self.byte_id[raw]
        for k in [k for k, w in enumerate(words) if w in self.added] if self.added.keys() & set(words) else ():
            symbol[ends[k] - sizes[k]:ends[k]] = -2  # a special token is one symbol
            symbol[ends[k] - sizes[k]] = np.frombuffer(self.added[words[k]], "<u4")[0]
        after = np.arange(1, len(symbol) + 1, dtype=np.int32)
        before = np.arange(-1, len(symbol) - 1, dtype=np.int32)
        index: dict[int, list] = {}
        active: list[int] = []

        def enter(positions, ranks):
            """Add positions to the lists of their ranks."""
            listed = ranks >= 0
            positions, ranks = positions[listed], ranks[listed]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            if not len(ranks):
                return
            starts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()]
            for rank, s, e in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)]):
                if rank in index:
                    index[rank].append(positions[s:e])
                else:
                    index[rank] = [positions[s:e]]
                    heapq.heappush(active, rank)

        enter(np.arange(len(symbol) - 1, dtype=np.int32), self.ranks_of(symbol[:-1], symbol[1:]))
        while active:
            rank = heapq.heappop(active)
            a, b, joined = self.parts[rank]
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b:
                at = self._apart(np.unique(at), after)
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone] = joined, -2
            nxt = after[gone]
            after[at], before[nxt] = nxt, at
            prv = before[at]
            enter(np.concatenate((at, prv)), self.ranks_of(
                np.concatenate((symbol[at], symbol[prv])), np.concatenate((symbol[nxt], symbol[at]))))
        alive = np.flatnonzero(symbol >= 0)
        cuts = np.searchsorted(alive, ends) * 4
        return symbol[alive].astype("<u4").tobytes(), [0, *cuts.tolist()]

    @staticmethod
    def _apart(at, after):
        """Of the positions of a pair of equal symbols, those merged when going left to right."""
        keep, taken = [], -1
        for i, j in zip(at.tolist(), after[at].tolist()):
            if i != taken:
                keep.append(i)
                taken = j
        return np.array(keep, np.int64)

    def encode(self, text: str) -> bytes:
        return self.pieces.encode(text)

    def decode(self, ids: bytes) -> str:
        """Invalid UTF-8 that cut ids may leave becomes U+FFFD."""
        table_ = self.bytes_of
        return b"".join([table_[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_ENCODERS: dict[tuple, PairIndexEncoder] = {}


def encoder(path: str, specials: bool = True) -> PairIndexEncoder:
    """The encoder of this worker process; ``path`` must be readable on every machine."""
    if (path, specials) not in _ENCODERS:
        _ENCODERS[path, specials] = PairIndexEncoder(path, specials)
    return _ENCODERS[path, specials]


def bpe_encode(docs: DataFrame, path: str | None = None, specials: bool = True) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian uint32) for every document."""
    bounded_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        enc = encoder(path, specials)
        for batch in batches:
            ids = list(enc.pieces.encode_all([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts_of(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``encoded`` with the text that ``ids`` stand for as ``decoded``; an earlier column of
    that name gives way."""
    encoded = encoded.drop("decoded")
    bounded_batches(encoded.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            out = [enc.decode(x.as_py() or b"") for x in batch.column(batch.schema.names.index("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())],
                                             names=[*batch.schema.names, "decoded"])
    from pyspark.sql import types as T
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(table(spark, sf_dir, "documents"))
    return bpe_decode(encoded).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
