import bisect
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefspark.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "a  b   c    d", " lead", "trail ", "x \n y\n\n z\t t", "one two  three", "é ü 漢字 😀",
         "it's we'll THEY'RE 12 345", "<|endoftext|> in the middle <|endoftext|>", "word " * 3000, "a" * 9000,
         "\x1c a\x1d b", "a\r\n b \r\n", "1 2  3", "-- -- ... !!!", "x" * 2046]


def naive(text):
    t = Tokenizer.from_file(PATH)
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_equal_the_tokenizers():
    encoder = P.Encoder(P.read_spec(PATH))
    rng = random.Random(3)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "1", "'s", ".", " ", " ", "\x1f", "😀", "zz", "ö", "&&&", "\u00a0", "\u200b", "²", "ǅ", "म", "ि", "\x00", "'", "ll"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(6000)]
    assert encoder.fast is not None
    got = [encoder.encode(x) for x in texts]
    t = Tokenizer.from_file(PATH)
    for text, ids, want in zip(texts, got, t.encode_batch([x or "" for x in texts], add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)


def test_very_long_runs():
    encoder, t = P.Encoder(P.read_spec(PATH)), Tokenizer.from_file(PATH)
    for part in ("a", " ", "\n", "!?", "12", "漢"):
        text = part * 150_000
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_any_other_file_goes_through_the_tokenizers_library():
    """Files that are no plain byte-level vocabulary are told apart: another kind, a prefix space, a normalizer, ranks out of order."""
    other = P.Encoder(P.read_spec(public_tokenizers.path("word_bpe_49k.json")))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None
    for text in TEXTS[1:]:
        assert np.frombuffer(other.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    plain = json.loads(P.read_spec(PATH))
    assert P.byte_level_ranks(plain)
    merges = plain["model"]["merges"]
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**plain["pre_tokenizer"], "add_prefix_space": True}},
                   {"pre_tokenizer": None}, {"model": {**plain["model"], "merges": merges[::-1]}},
                   {"model": {**plain["model"], "merges": merges[1:]}}, {"model": {**plain["model"], "dropout": 0.1}}):
        assert P.byte_level_ranks(plain | change) is None


def test_pieces_cover_documents_and_sequences_are_gapless(spark):
    rng = random.Random(1)
    texts = TEXTS * 2 + [" ".join(rng.choices(["alpha", "beta", "x1"], k=rng.randint(1, 900))) for _ in range(300)]
    df = spark.createDataFrame([(i % 200 if i % 11 else None, t, "s", 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, ids string, length int")
    rows = P.pack_documents(df, PATH).collect()
    seqs = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
        assert r["length"] == 2048 or r["piece"] == 0
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    want = sorted(str((i % 200 if i % 11 else None, k, s, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())))
                  for i, t in enumerate(texts) for ids in [naive(t)] for k, (s, n) in enumerate(P.cut_points(len(ids))))
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["ids_crc32"])) for r in rows) == want
    total = sum(r["length"] for r in rows)
    assert len(seqs) <= -(-total // 2048) + 2
    whole = P.packed_sequences(P.pack_documents(df, PATH)).collect()
    assert sum(r["length"] for r in whole) == total and all(len(r["ids"]) == 4 * r["length"] for r in whole)


def test_each_item_goes_where_the_squares_become_smallest():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 21, 300)
    where, offset, fill = P.sum_of_squares(sizes, 20)

    def squares(fills):
        gaps = [20 - f for f in fills if f < 20]
        return sum(gaps.count(g) ** 2 for g in set(gaps))

    fills = []
    for size, b, o in zip(sizes.tolist(), where.tolist(), offset.tolist()):
        options = [squares(fills[:i] + [f + size] + fills[i + 1:]) for i, f in enumerate(fills) if f + size <= 20]
        options.append(squares(fills + [size]))
        if b == len(fills):
            fills.append(0)
        assert fills[b] == o
        fills[b] += size
        assert squares(fills) == min(options)
    assert fills == fill.tolist()


@pytest.mark.parametrize("n", [0, 1, 2500])
def test_pack_bounds(spark, n):
    rng = random.Random(n)
    df = spark.createDataFrame([(i, rng.randint(1, 2048)) for i in range(n)], "k long, length long")
    rows = P.pack(df, shard_rows=400).collect()
    assert len(rows) == n
    used = len({r["sequence_id"] for r in rows})
    gaps, best = [], 0  # best fit of all items, the longest first
    for size in sorted((r["length"] for r in rows), reverse=True):
        i = bisect.bisect_left(gaps, size)
        best += i == len(gaps)
        gap = (gaps.pop(i) if i < len(gaps) else 2048) - size
        bisect.insort(gaps, gap) if gap else None
    assert used <= 1.04 * best + 1  # even sizes are the rule's hard case; see README for documents
