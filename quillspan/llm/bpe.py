"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A vocabulary file of ranks (base64 token, rank) becomes a BPE model whose symbols are the usual characters for bytes:
every way in which two tokens make up a third is a merge, ordered by the third's rank, so that merging goes by rank as in
rank-based encoders. Texts are cut by the pattern in the Python worker, by a library whose Unicode tables are new enough; a group's distinct pieces are encoded once, and the ids and
offsets of all pieces are gathered from them. Decoding reverses the byte table and joins the bytes before reading them as
UTF-8, so that characters whose bytes are split over tokens come back whole.

Null texts count as empty and have no ids; special tokens are never made or recognised. Repeated rows get equal results, an empty table an empty one.
Texts are encoded whole, in groups of bounded size, a very long one some pieces at a time. Ids outside the vocabulary fail decoding. Input columns
may have any name but those that are made, which are replaced.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import flat, groups
from .common import freed, packed, unpacked, wider

#: Distinct pieces that a worker remembers before it starts anew.
REMEMBER = 200_000
#: Pieces that are gathered, and ids that are decoded, at a time; bytes of texts that make up a batch.
GROUP, BATCH = 200_000, 4_000_000
_CODECS: dict[str, Codec] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b in set(printable) else chr(256 + rest.index(b)) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        char = byte_characters()
        write = lambda token: "".join([char[b] for b in token])
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        merges = [(write(t[:i]), write(t[i:])) for t, _ in by_rank for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={write(t): r for t, r in by_rank}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.ends = np.cumsum([len(t) for t in self.token])
        self.forget()

    def forget(self) -> None:
        """Of each known piece: its number, and by number its first id, how many there are, and the ids and, if told, the offsets themselves."""
        self.known: dict[str, int] = {}
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.spans: np.ndarray | None = None

    def learn(self, new: list[str], offsets: bool) -> None:
        """Encodes pieces that aren't known, each by itself."""
        e = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        n = np.bincount(np.array(e.word_ids, np.int32), minlength=len(new))
        self.begin = np.append(self.begin, np.cumsum(n) - n + len(self.ids))
        self.count = np.append(self.count, n)
        self.ids = np.append(self.ids, np.array(e.ids, np.int32))
        if offsets:
            own = np.array(e.offsets, np.int32).reshape(-1, 2)
            self.spans = own if self.spans is None else np.concatenate([self.spans, own])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))

    def encode(self, pieces: list[str], offsets: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Number of tokens of each piece, all ids, and their character offsets in the piece (n x 2)."""
        distinct = set(pieces)
        if offsets and self.spans is None and self.known:
            self.forget()
        new = list(distinct.difference(self.known))
        if len(self.known) + len(new) > REMEMBER:
            self.forget()
            new = list(distinct)
        if new:
            self.learn(new, offsets or self.spans is not None)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        many = self.count[at]
        pick = np.repeat(self.begin[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return many, self.ids[pick], self.spans[pick].astype(np.int64) if offsets else None

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The bytes of each text, given its number of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token)):
            raise ValueError("an id outside the vocabulary")
        size = np.diff(np.append(0, self.ends))[ids]
        pick = np.repeat(self.ends[ids] - size - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        data = self.bytes[pick].tobytes()
        ends = np.append(0, np.cumsum(size))[np.cumsum(n)]
        return [data[a:b] for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]


def codec(path: str) -> Codec:
    """One codec for each file and process; the file is read where the tokenizers package is installed, on each executor."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _decode_lists(c: Codec, lists: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids, some texts at a time."""
    n = np.diff(lists.offsets.to_numpy().astype(np.int64))
    found = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(n)
    data: list[bytes] = []
    i = 0
    while i < len(n):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + GROUP, "right")))
        data += c.decode(found[done : ends[j - 1]], n[i:j])
        i = j
    return pa.array(data, pa.binary())


def _pieces(texts: list[str | None], pattern: regex.Pattern) -> Iterator[tuple[list[str], list[int]]]:
    """The pieces of texts in order, about GROUP at a time, and how many texts end after how many pieces of the group."""
    pieces: list[str] = []
    ends: list[int] = []
    for text in texts:
        found = pattern.findall(text or "") if len(text or "") < GROUP else (m[0] for m in pattern.finditer(text))
        if not isinstance(found, list):  # a very long text, some pieces at a time
            while len(part := list(islice(found, GROUP))) == GROUP:
                yield pieces + part, ends
                pieces, ends = [], []
            found = part
        pieces += found
        ends.append(len(pieces))
        if len(pieces) >= GROUP:
            yield pieces, ends
            pieces, ends = [], []
    yield pieces, ends


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """The columns of `docs` without the text, and `ids` (array<int>).

    If asked for also `offsets` (array<struct<start: int, end: int>>, in characters of the text), and `decoded` (binary):
    what the ids decode to, in the same pass, as decode_ids would find it.
    """
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    made = ["ids", *["offsets"] * offsets, *["decoded"] * decoded]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row"), F.col(text).cast("string").alias("text"))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cutter = codec(path), regex.compile(pattern)
        for b in (big.slice(i, j - i) for big in batches for i, j in groups(flat(big.column(1))[1], BATCH)):
            ids, spans, lengths, ends, counts = [], [], [], [], []
            done = 0
            for pieces, stops in _pieces(b.column(1).to_pylist(), cutter):
                many, found, inside = c.encode(pieces, offsets)
                ids.append(found)
                counts.append(many)
                ends += [done + x for x in stops]
                done += len(pieces)
                if offsets:
                    spans.append(inside)
                    lengths.append(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            many, off = np.concatenate(counts), np.append(0, ends)
            before = pa.array(np.append(0, np.cumsum(many))[off].astype(np.int32))
            out = [pa.ListArray.from_arrays(before, pa.array(np.concatenate(ids)))]
            if offsets:
                # Characters before each piece, less those before its text.
                start = np.append(0, np.cumsum(np.concatenate(lengths)))
                start = start[:-1] - np.repeat(start[off[:-1]], np.diff(off))
                whole = np.concatenate(spans) + np.repeat(start, many)[:, None]
                out.append(pa.ListArray.from_arrays(before, pa.StructArray.from_arrays([pa.array(whole[:, k].astype(np.int32)) for k in (0, 1)], fields=list(span))))
            if decoded:
                out.append(_decode_lists(c, out[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), *out], ["row", *made])

    ddl = "ids array<int>" + ", offsets array<struct<start: int, end: int>>" * offsets + ", decoded binary" * decoded
    return unpacked(given.mapInArrow(freed(run), wider(rest, ddl)), rest.columns, *made)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded` (binary): the bytes of the ids' tokens. Cast it to string to read it. Null ids decode to no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            lists = b.column(0).field(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), _decode_lists(c, lists)], ["row", "decoded"])

    return unpacked(packed(encoded).mapInArrow(freed(run), wider(encoded, "decoded binary")), encoded.columns, "decoded")
