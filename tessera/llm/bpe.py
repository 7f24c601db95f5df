"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Within one pre-token, the positions whose pair can merge are kept in one bucket per merge rank. A two-level bitmap (a
summary integer over 256-bit words) marks the ranks with a non-empty bucket, so the next rank is a find-first-set, and
a merge touches two neighbours in a linked list. Entries that a merge has made stale stay in their bucket and are
skipped when met, so a pre-token of n bytes costs O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import worker

#: Pre-tokens, and space-delimited chunks, whose ids a worker keeps; beyond it the older half goes.
CACHE_ENTRIES = 300_000
#: Rows of an output batch.
SLICE = 500
#: Longer pre-tokens are encoded each time: they hardly repeat.
CACHE_LONGEST = 64


class _Memo(dict):
    """Two generations: when the young one is full it becomes the old one, so memory stays bounded."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_LONGEST:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def _packed(ids: Iterable[int]) -> bytes:
    """Four bytes an id: remembered ids take a fraction of what tuples of integers would."""
    return array("i", ids).tobytes()


class BpeCodec:
    """Encodes as the ranks and the pre-token pattern say, without special tokens; decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.none = max(ranks.values()) + 1  # stands for a merged-away position and for both ends
        after: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None:
                    after.setdefault(left, {})[right] = rank
        nothing: dict[int, int] = {}
        self.pair = [after.get(i, nothing).get for i in range(self.none + 1)]
        self.bit = [1 << i for i in range(256)]
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.text_at = np.array([str(i) for i in range(self.none)], dtype=object)
        self.bytes_at = np.array([self.bytes_of.get(i) for i in range(self.none)], dtype=object)
        self.words = [0] * ((max(ranks.values()) >> 8) + 1)
        self.piece_ids = _Memo(lambda piece: _packed(self._encode_piece(piece)))
        self.chunk_ids = _Memo(self._encode_chunk)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BpeCodec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.merge(data)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: lowest rank first, leftmost first among equals."""
        n = len(data)
        none, pair, bit, words = self.none, self.pair, self.bit, self.words
        ids = [*map(self.byte_id.__getitem__, data), none]  # ids[-1], before the first, is none too
        after, before = list(range(1, n + 2)), list(range(-1, n))
        buckets: dict[int, list[int]] = {}
        summary = 0
        for i, rank in enumerate([pair[left](right) for left, right in pairwise(ids)]):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= bit[rank & 255]
                    summary |= bit[rank >> 8]
        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            low = bits & -bits
            words[w] = bits ^ low
            if bits == low:
                summary ^= bit[w]
            rank = (w << 8) + low.bit_length() - 1
            waiting = buckets.pop(rank)
            if len(waiting) == 1:  # the usual case: nothing else of this rank can be left waiting
                i = waiting[0]
                k = after[i]
                if pair[ids[i]](ids[k]) != rank:
                    continue  # stale
                ids[i], ids[k] = rank, none
                after[i] = m = after[k]
                before[m] = i
                p = before[i]
                new = pair[rank](ids[m])
                if new is not None:
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        words[new >> 8] |= bit[new & 255]
                        summary |= bit[new >> 8]
                new = pair[ids[p]](rank)
                if new is not None:
                    if new in buckets:
                        buckets[new].append(p)
                    else:
                        buckets[new] = [p]
                        words[new >> 8] |= bit[new & 255]
                        summary |= bit[new >> 8]
                continue
            waiting.sort()
            lowest = rank
            nth = 0
            for i in waiting:
                nth += 1
                k = after[i]
                if pair[ids[i]](ids[k]) != rank:
                    continue  # stale
                ids[i], ids[k] = rank, none
                after[i] = m = after[k]
                before[m] = i
                p = before[i]
                right, left = pair[rank](ids[m]), pair[ids[p]](rank)
                for new, at in ((right, i), (left, p)):
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(at)
                        else:
                            buckets[new] = [at]
                            words[new >> 8] |= bit[new & 255]
                            summary |= bit[new >> 8]
                        if new < lowest:
                            lowest = new
                if lowest < rank:  # a lower rank has come up: it goes first, the rest of this bucket waits
                    if rest := waiting[nth:]:
                        buckets[rank] = rest
                        words[rank >> 8] |= low
                        summary |= bit[w]
                    break
        return tuple([x for x in ids if x != none])

    def _encode_chunk(self, chunk: str) -> bytes:
        pieces = self.find(" " + chunk)
        if len(pieces) == 1:  # remembered as a chunk, so not as a piece too
            return _packed(self._encode_piece(pieces[0]))
        return b"".join(map(self.piece_ids.__getitem__, pieces))

    #: A space between two white spaces, or a last one, does not begin a pre-token.
    _joined = re.compile(r"\s \s|\s \Z").search

    def encode(self, text: str) -> list[int]:
        """A space after and before anything else than white space begins a pre-token, whatever stands around it; so the
        text is cut there, and the ids of whole chunks are remembered. Other texts go through the pattern in one piece."""
        return self.encode_array(text).tolist()

    def encode_array(self, text: str) -> np.ndarray:
        """As ``encode``, in 32-bit integers."""
        if text[-1:] == " " or text[:2] == "  " or self._joined(text):
            found = map(self.piece_ids.__getitem__, self.find(text))
            return np.frombuffer(b"".join(found), dtype=np.int32)
        first, *rest = text.split(" ")
        head = b"".join(map(self.piece_ids.__getitem__, self.find(first)))
        return np.frombuffer(head + b"".join(map(self.chunk_ids.__getitem__, rest)), dtype=np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_array(self, ids: np.ndarray) -> bytes:
        """As ``decode``, of what ``encode_array`` gives."""
        return b"".join(self.bytes_at[ids].tolist())

    def told(self, ids: np.ndarray) -> bytes:
        """The decimal ids, joined by one space."""
        return " ".join(self.text_at[ids].tolist()).encode()


_codecs: dict[tuple[str, str], BpeCodec] = {}


def codec(path: str, pattern: str) -> BpeCodec:
    """One per worker process; the vocabulary file is part of the installation, not of the data."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BpeCodec.from_file(path, pattern)
    return _codecs[path, pattern]


def forget() -> None:
    """Drop this worker's codecs, with their tables (24 MB for 50,000 ranks) and all ids that they remember."""
    _codecs.clear()


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Rows of ``keep`` (default: all columns but the text), with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if
    asked, ``ids``. One narrow pass, no shuffle; null texts count as empty, repeated rows come out repeated. Columns of
    ``docs`` that clash with the outputs are left out."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text and c not in made]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["ids array<int>"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.use("bpe", forget)
        bpe = codec(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):  # texts and ids of whole batches would take much memory
                part = batch.slice(start, SLICE)
                encoded = [bpe.encode_array(t) for t in part.column(part.num_columns - 1).to_pylist()]
                size = np.array([len(x) for x in encoded], dtype=np.int64)
                out = [pa.array(size), pa.array([hashlib.sha256(bpe.told(x)).hexdigest() for x in encoded]), pa.array([hashlib.sha256(bpe.decode_array(x)).hexdigest() for x in encoded])]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(np.concatenate(encoded), pa.int32())))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], [*part.schema.names[:-1], *made])

    return rows.mapInArrow(run, schema)


def decode_column(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text that ``ids`` stand for; ids that end inside a character decode with the replacement character. Null
    ids give null."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        bpe = codec(path, pattern)
        return column.map(lambda x: None if x is None else bpe.decode(x).decode("utf-8", "replace"))

    return tokens.withColumn(out, decoded(F.col(ids)))
