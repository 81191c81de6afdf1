"""The whole corpus as ids of a public tokenizer.

A text is cut into pieces of PIECE characters, which are encoded by tasks of their own and joined in a tree over the tasks,
level by level, two neighbours at a time: around each join a growing window is encoded anew until its first ids agree with
the left side and its last with the right side; from there on both sides are what encoding the whole would give, so the
result is exact. Byte-level BPE over a pre-tokenizer has this locality: a boundary between ids that survives a re-encoding of
both its neighbours is one that the whole text has too. A text of a single piece is a tree of one leaf and is not shuffled.
"""

from __future__ import annotations

import base64
import importlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from geolathe.session import materialize, ship

TOKENIZER = "byte_bpe_50k"
PIECE = 4096  # characters of a piece
IDS = T.ArrayType(T.IntegerType())


class Codec:
    """encode, decode and count of one vocabulary file. `folder`: where the files are; by default the installed package's place."""

    def __init__(self, name: str = TOKENIZER, folder: str | None = None):
        import tiktoken

        mod = importlib.import_module("public_tokenizers")
        path = f"{folder}/{name}.tiktoken" if folder else mod.path(f"{name}.tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding(name, pat_str=mod.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.enc.encode_ordinary

    def text(self, ids) -> str | None:
        """The ids' text, or None if they do not start and end between characters."""
        try:
            return b"".join(self.enc.decode_single_token_bytes(i) for i in ids).decode()
        except UnicodeDecodeError:
            return None


def codec(name: str = TOKENIZER, folder: str | None = None) -> Codec:
    """One codec per Python worker."""
    kept = sys.__dict__.setdefault("_geolathe_codecs", {})
    if (name, folder) not in kept:
        kept[name, folder] = Codec(name, folder)
    return kept[name, folder]


def join_ids(c: Codec, left: list[int], right: list[int], start: int = 8) -> list[int]:
    """The ids of the concatenated text, given the ids of its two parts, by re-encoding a growing window around the join.

    The pre-tokenizer's rules look one character ahead and at runs of one class, so agreement of a single id could be
    chance inside a run; a window is accepted when `agree` ids at both ends agree and the text between spans a place at
    which the pre-tokenizer must cut on either side, or when it has grown to the whole text.
    """
    if not left or not right:
        return left or right
    k = start
    while True:
        a, b = min(k, len(left)), min(k, len(right))
        # Grow to character boundaries, so that the window is text.
        while (t := c.text(left[len(left) - a :] + right[:b])) is None and (a < len(left) or b < len(right)):
            a, b = min(a + 1, len(left)), min(b + 1, len(right))
        if t is None:  # bytes that are no text at all cannot come from encode
            raise ValueError("ids do not decode to text")
        ids = c.encode(t)
        if a == len(left) and b == len(right):
            return ids
        old = left[len(left) - a :] + right[:b]
        m = _agree(ids, old, a == len(left), b == len(right))
        if m and _cuts(c, old, m, a == len(left), b == len(right)):
            return left[: len(left) - a] + ids + right[b:]
        k *= 2


def _agree(ids, old, whole_left, whole_right) -> int:
    """The number of ids that agree at both ends, at least 2, else 0; an end that is the end of the text need not agree."""
    m = max(2, len(old) // 8)
    if len(ids) < m or len(old) < m:
        return 0
    return m if (whole_left or ids[:m] == old[:m]) and (whole_right or ids[-m:] == old[-m:]) else 0


def _cuts(c: Codec, old, m, whole_left, whole_right) -> bool:
    """Whether the agreed ids at each inner end hold a pre-token boundary that no longer context can move.

    A boundary before a blank followed by a letter, or between a letter and a digit or mark, depends on the two
    characters beside it only.
    """

    def firm(ids):
        t = b"".join(c.enc.decode_single_token_bytes(i) for i in ids).decode("utf-8", "ignore")
        return any((x.isalpha() and y == " " and z.isalpha()) for x, y, z in zip(t, t[1:], t[2:]))

    return (whole_left or firm(old[:m])) and (whole_right or firm(old[-m:]))


def encode_tree(c: Codec, parts: list[list[int]]) -> list[int]:
    """Joins the ids of consecutive parts pairwise, level by level."""
    while len(parts) > 1:
        parts = [join_ids(c, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def _lists(rows: list) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))


def token_ids(docs: DataFrame, *, tokenizer: str = TOKENIZER, folder: str | None = None, piece: int = PIECE) -> DataFrame:
    """(doc_id, ids): the ids of each text without special tokens; special strings in a text are ordinary text.

    docs: doc_id, text; others are ignored. A null and an empty text have the empty list, a blank text its own ids. One row
    per input row, so repeated rows stay. Empty tables give no rows. Each text is encoded once, whatever its length.
    """
    ship(docs.sparkSession)
    d = docs.select("doc_id", "text")
    of_id = d.schema["doc_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, folder)
        for b in batches:
            rows = [c.enc.encode_to_numpy(t) if t else np.zeros(0, np.uint32) for t in b.column("text").to_pylist()]
            rest = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), _lists(rows)], names=[*rest, "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(lo, 64) for b in batches for lo in range(0, len(b), 64)):
            parts = [[t[i : i + piece] for i in range(0, len(t), piece)] for t in b.column("text").to_pylist()]
            at = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int64())
            k, text = pa.array([k for p in parts for k in range(len(p))], pa.int32()), pa.array([x for p in parts for x in p], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("doc_id").take(at), k, text], names=["row", "doc_id", "k", "text"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours k and k + 1, k even, of rows in order become piece k / 2; a last one without neighbour stays as it is."""
        c = codec(tokenizer, folder)
        held = None
        for b in batches:
            out = []
            for r in zip(*(b.column(n).to_pylist() for n in ("row", "doc_id", "k")), (x.values.to_numpy() for x in b.column("ids"))):
                if held and held[0] == r[0] and held[2] + 1 == r[2]:
                    out.append((*held[:2], held[2] // 2, join_ids(c, held[3].tolist(), r[3].tolist())))
                    held = None
                else:
                    if held:
                        out.append((*held[:2], held[2] // 2, held[3]))
                    held = r
            yield batch(out)
        yield batch([(*held[:2], held[2] // 2, held[3])] if held else [])

    def batch(rows: list) -> pa.RecordBatch:
        row, doc, k = (pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, doc_type), (2, pa.int32())))
        return pa.RecordBatch.from_arrays([row, doc, k, _lists([r[3] for r in rows])], names=["row", "doc_id", "k", "ids"])

    doc_type = to_arrow_type(of_id.dataType)
    out_schema = T.StructType([of_id, T.StructField("ids", IDS)])
    leaf = F.coalesce(F.length("text") <= piece, F.lit(True))
    whole = d.where(leaf).mapInArrow(encode, out_schema)

    # Each row is named apart, as doc_id may repeat.
    key = T.StructType([T.StructField("row", T.LongType()), of_id, T.StructField("k", T.IntegerType())])
    pieces = d.where(~leaf).withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, T.StructType([*key, T.StructField("text", T.StringType())]))
    level_schema = T.StructType([*key, T.StructField("ids", IDS)])
    level = materialize(pieces.repartition("row", "k").mapInArrow(encode, level_schema), "pieces")
    last = level.agg(F.max("k")).first()[0] or 0
    while last:
        level = level.repartition("row", F.floor(F.col("k") / 2)).sortWithinPartitions("row", "k").mapInArrow(join, level_schema)
        last //= 2
    return whole.unionByName(level.select("doc_id", "ids"))
