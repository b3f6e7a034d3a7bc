"""Byte-level BPE encoding and decoding with the tokenizers library.

The rank file is read on the driver; from it come the merge list (each token is
split again by the lower ranks, which leaves its two parts) and the byte
alphabet of byte-level tokenizers. The tokenizer travels as one JSON text of
the vocabulary's size.

Encoding runs over Arrow batches. A text falls into pieces before every single
space that stands between two non-space characters: no match of the split
pattern crosses such a place, so the pieces can be encoded apart. Each distinct
piece is encoded once per worker (many in one call; token byte lengths tell the
pieces apart again) and kept in a bounded table. Ids come out packed as
little-endian unsigned 32-bit integers; ``offsets`` gives the characters that
each token covers, through the byte-to-character map of the text.

Decoding joins the byte strings of the ids, so characters split over tokens are
whole again; bytes that are no UTF-8 decode to U+FFFD in ``text``, ``raw`` has
them as they are.

Defined cases: null or empty text = no tokens; special tokens never appear;
repeated rows are encoded each; other columns are kept, columns of the names
that are added are replaced.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TABLE_SIZE = 300_000        # pieces a worker remembers
CALL_SIZE = 4_000           # pieces in one call of the tokenizer
ENCODED = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
DECODED = [T.StructField("raw", T.BinaryType()), T.StructField("text_decoded", T.StringType())]
_RUN = re.compile(r"\A\s|\s\s|\s\Z")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """The text cut at every single space between two non-space characters. All
    pieces but the first follow such a space, which belongs to them."""
    return _CUT.split(text) if _RUN.search(text) else text.split(" ")


# ---------------------------------------------------------------- vocabulary
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def byte_alphabet() -> list[str]:
    """Character of each byte: printable Latin-1 characters stand for themselves,
    the other bytes take the code points from 256 on, in order."""
    shown = [chr(b).isprintable() and chr(b) != " " for b in range(256)]
    spare = iter(range(256, 512))
    return [chr(b) if shown[b] else chr(next(spare)) for b in range(256)]


def parts_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``."""
    limit, parts = ranks[token], [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        ranked = [(ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(ranked)
        if rank >= limit:
            raise ValueError(f"token of rank {limit} can't be made by merges")
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    alphabet = byte_alphabet()
    shown = lambda raw: "".join(alphabet[b] for b in raw)
    merges = [tuple(map(shown, parts_of(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tok = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok.to_str()


class Codec:
    """Tokenizer, byte table and remembered pieces of one worker."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = self.tok.get_vocab()
        self.raw = [b""] * (max(vocab.values()) + 1)
        for shown, i in vocab.items():
            self.raw[i] = bytes(byte_of[c] for c in shown)
        self.lengths = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.table: dict[str, bytes] = {}

    def pack(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces, each after a space, and remember their packed ids."""
        for at in range(0, len(pieces), CALL_SIZE):
            some = pieces[at:at + CALL_SIZE]
            packed = self.pack([" " + " ".join(some)])[0]
            ends = np.cumsum([len(p.encode()) + 1 for p in some])
            cuts = np.searchsorted(np.cumsum(self.lengths[np.frombuffer(packed, dtype="<u4")]), ends) + 1
            start = 0
            for p, cut in zip(some, cuts.tolist()):
                self.table[p] = packed[start * 4:cut * 4]
                start = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [pieces(t) for t in texts]
        wanted = set().union(*(rest for _, *rest in split))
        if len(self.table) > TABLE_SIZE:
            self.table.clear()
        self.learn([p for p in wanted if p not in self.table])
        get = self.table.__getitem__
        return [head + b"".join(map(get, rest)) for head, (_, *rest) in zip(self.pack([s[0] for s in split]), split)]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))

    def offsets(self, text: str, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character and end (exclusive) of each token; a token that holds
        part of a character covers that character."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[np.frombuffer(packed, dtype="<u4")])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return (char[starts], char[ends - 1] + 1) if len(ends) else (ends, ends)


@functools.lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    return Codec(spec)


# ------------------------------------------------------------------ operators
def _with(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n not in added]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *added.values()],
                                      names=[*(batch.schema.names[i] for i in kept), *added])


def _schema(df: DataFrame, added: list[T.StructField]) -> T.StructType:
    names = {f.name for f in added}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + added)


def encode(df: DataFrame, text: str, rank_path: str, pattern: str, with_offsets: bool = False) -> DataFrame:
    """``df`` with ``ids`` (binary: packed ids) and ``n_tokens`` (long); with
    ``with_offsets`` also ``token_starts`` and ``token_ends`` (characters)."""
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(rank_path), pattern))
    added = list(ENCODED)
    if with_offsets:
        added += [T.StructField(n, T.ArrayType(T.LongType())) for n in ("token_starts", "token_ends")]

    return df.mapInArrow(_encoder(spec, text, with_offsets), _schema(df, added))


def _encoder(spec, text: str, with_offsets: bool = False):
    def run(batches):
        c = codec(spec.value)
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            ids = c.encode(texts)
            cols = {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64())}
            if with_offsets:
                both = [c.offsets(t, i) for t, i in zip(texts, ids)]
                cols["token_starts"] = pa.array([s.tolist() for s, _ in both], pa.list_(pa.int64()))
                cols["token_ends"] = pa.array([e.tolist() for _, e in both], pa.list_(pa.int64()))
            yield _with(b, cols)

    return run


def decode(df: DataFrame, ids: str, rank_path: str, pattern: str) -> DataFrame:
    """``df`` with ``raw`` (binary: the bytes of the ids) and ``text_decoded``
    (string; bytes that are no UTF-8 become U+FFFD). Null ids decode to no bytes."""
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(rank_path), pattern))
    return df.mapInArrow(_decoder(spec, ids), _schema(df, DECODED))


def _decoder(spec, ids: str):
    def run(batches):
        c = codec(spec.value)
        for b in batches:
            raw = [c.decode(i or b"") for i in b.column(ids).to_pylist()]
            yield _with(b, {"raw": pa.array(raw, pa.binary()),
                            "text_decoded": pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())})

    return run


def round_trip(df: DataFrame, text: str, rank_path: str, pattern: str) -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass over the batches: a task
    needs one worker and one tokenizer instead of two."""
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(rank_path), pattern))
    encoded, decoded = _encoder(spec, text), _decoder(spec, "ids")
    return df.mapInArrow(lambda batches: decoded(encoded(batches)), _schema(df, ENCODED + DECODED))
