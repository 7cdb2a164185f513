"""Best-fit packing of documents into sequences by the sum-of-squares rule.

1. Every document becomes token ids and the end id; one longer than a sequence
   is cut into whole sequences and one shorter first piece.
2. Pieces are dealt by hash into shards of about ``SHARD_ROWS``.  A shard
   places its pieces, the longest first, each where the sum over all residual
   gaps of the squared number of open bins with that gap becomes smallest
   (a new bin counts as one with the whole gap; ties to the tighter bin).
3. Bins that are not nearly full are dealt out and packed again together with
   those of other shards, ``ROUNDS`` times in all: what one shard lacks to
   fill its last bins, others have.

Token ids come from a public tokenizer's file, which is read on the driver and
sent to the tasks.

Defined cases: a null text counts as empty and becomes one piece of the end id;
repeated rows are packed as often as they occur; an empty table gives an empty
table.  Only the id and text columns are used, so extra columns cannot clash.
"""

from __future__ import annotations

import json
import os
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import release_memory, text_slices
from prefspark.session import materialize

if TYPE_CHECKING:
    import pandas as pd

CAPACITY, END = 2048, 0
SHARD_ROWS, ROUNDS = 8_192, 3
NEARLY_FULL = 8  # tokens that a bin may lack to be left alone
# Fixed value: how a byte-level vocabulary's texts are cut into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, "Encoder"] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of the tokens' bytes, if the file is a plain byte-level vocabulary whose merges are ranked by their ids; else None.

    Such a file cuts texts by ``WORDS``, changes nothing in them before or
    after, and each of its tokens is one byte or what one merge makes, in the
    order of the ids: then the lowest id of all mergeable pairs is the first merge.
    """
    model, cut = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    vocab, letters = model.get("vocab") or {}, {c: b for b, c in byte_letters().items()}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if (model.get("type") != "BPE" or any(model.get(k) for k in odd) or spec.get("normalizer") or spec.get("post_processor")
            or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex")):
        return None
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges") or []]
    known = set(made) | {vocab.get(c, -1) for c in letters}
    if -1 in known or len(known) != len(vocab) or made != sorted(made) or min(made, default=0) < max(vocab[c] for c in letters):
        return None
    return {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items()}


class Encoder:
    """Token ids of texts as little-endian bytes, four for each id.

    Ids are those of the tokenizer file. A plain byte-level vocabulary is
    applied by ``tiktoken`` from the file's own ranks, which gives the same ids
    in less than half the time and remembers no words; any other file, and
    texts that hold a special token, go through ``tokenizers``.
    """

    def __init__(self, spec: str):
        import tiktoken
        self.spec, content = spec, json.loads(spec)
        self.special = [t["content"] for t in content.get("added_tokens") or []]
        ranks = byte_level_ranks(content)
        self.fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self._tokenizer = None  # takes far more memory; most texts need it only if there is no ``fast``

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer
            self._tokenizer = Tokenizer.from_str(self.spec)
        return self._tokenizer

    @classmethod
    def of(cls, spec: str) -> "Encoder":
        """The worker's encoder for a tokenizer file's contents."""
        if spec not in _ENCODERS:
            _ENCODERS[spec] = cls(spec)
        return _ENCODERS[spec]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        return np.asarray(ids, dtype="<u4").tobytes()


def cut_points(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than ``capacity``."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def token_pieces(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (binary: little-endian unsigned 32-bit) of every piece of every document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    tail = int(end).to_bytes(4, "little")
    id_type = docs.schema["doc_id"].dataType

    def cut(batches):
        encoder = Encoder.of(spec)
        for batch in (x for b in batches for x in text_slices(b, 1)):
            row, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                b = encoder.encode(text) + tail
                for k, (s, n) in enumerate(cut_points(len(b) // 4, capacity)):
                    row.append(i), piece.append(k), start.append(s), length.append(n)
                    ids.append(b[4 * s:4 * (s + n)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"])
        release_memory()

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    return docs.mapInArrow(cut, schema)


def sum_of_squares(sizes, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin), items placed in the given order; sizes 1 to capacity."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    for i, size in enumerate(map(int, sizes)):
        # what the sum of squares changes by, in a new bin and in an open one of each gap
        gap, change = capacity, 2 * count[capacity - size] + 1 if size < capacity else 0
        if size + 1 < capacity:
            open_ = count[size + 1:capacity]
            by = np.where(open_ > 0, 2 * (count[1:capacity - size] - open_) + 2, 2 ** 62)
            j = int(by.argmin())
            if by[j] <= change:
                gap, change = size + 1 + j, by[j]
        if size < capacity and count[size] and 1 - 2 * count[size] <= change:
            gap = size
        if gap == capacity:
            b = len(fill)
            fill.append(0)
        else:
            b = bins[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        if fill[b] < capacity:
            count[capacity - fill[b]] += 1
            bins[capacity - fill[b]].append(b)
    return where, offset, np.array(fill, dtype=np.int64)


def _placer(k: int, capacity: int):
    """Packs one shard of round ``k``."""
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd  # here, as it takes memory in the workers of all other stages
        pdf = pdf.sort_values(["length", "__row"], ascending=[False, True])
        where, offset, fill = sum_of_squares(pdf["length"].to_numpy(), capacity)
        base = (k << 60) + (int(pdf["shard"].iloc[0]) << 24)
        return pd.DataFrame({"__row": pdf["__row"], "length": pdf["length"], "sequence_id": base + where,
                             "offset": offset, "gap": capacity - fill[where]})

    return place


def pack(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (length 1 to ``capacity``) with sequence_id and offset.

    ``items`` is written once, so that every round sees the same rows; later
    rounds handle lengths only.
    """
    items = materialize(items.withColumn("__row", F.monotonically_increasing_id()), "pack-items")
    # a piece that fills a sequence has no choice
    full = items.where(F.col("length") == capacity).select(
        "__row", (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, placed = items.where(F.col("length") < capacity).select("__row", "length"), [full]
    for k in range(rounds):
        n = left.count()
        if not n:
            break
        shards = -(-n // shard_rows)
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("__row", F.lit(k)), F.lit(shards)))
        done = materialize(dealt.groupBy("shard").applyInPandas(
            _placer(k, capacity), "__row long, length long, sequence_id long, offset long, gap long"), "packed")
        last = k == rounds - 1
        placed.append((done if last else done.where(F.col("gap") <= NEARLY_FULL)).select("__row", "sequence_id", "offset"))
        left = done.where(F.col("gap") > NEARLY_FULL).select("__row", "length")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return items.join(out, "__row").drop("__row")


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length and ids (binary) of every sequence, from packed pieces that carry their ids.

    A group is one sequence: ``capacity`` ids at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select(
        "sequence_id", "length", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def read_spec(path: str) -> str:
    """The contents of a tokenizer file (a few MB), for the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True, **options) -> DataFrame:
    """Packed pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if wanted."""
    pieces = token_pieces(docs, read_spec(tokenizer), capacity=capacity, **options)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    return pack(pieces if with_ids else pieces.drop("ids"), capacity)
