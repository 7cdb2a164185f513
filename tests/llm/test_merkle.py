import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from prefspark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, witness string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    last, out = tree([trees[g][-1][0] for g in names]), []
    for place, g in enumerate(names):
        for p, (_, _, digest, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            text = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            now = leaf((*r[:4], text)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else digest
            siblings = []
            for levels, at in ((trees[g], p), (last, place)):
                for level in levels[:-1]:
                    run = level[at // 8 * 8:at // 8 * 8 + 8]
                    siblings += run[:at % 8] + run[at % 8 + 1:]
                    now = h(*run[:at % 8], now, *run[at % 8 + 1:])
                    at //= 8
            root = last[-1][0]
            out.append((r[0], digest, trees[g][-1][0], root, h(*siblings), now, now == root))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in merkle.tampered_manifest(df).collect()), key=str)


def rows_of(n, rng):
    return [(rng.randrange(10 ** 6), f"s{i % 3}", rng.choice(["en", "en", "en", "de", "É", None, ""]), i, f"Text É {i}") for i in range(n)]


@pytest.mark.parametrize("height", [1, 4])
def test_equals_brute_force(spark, monkeypatch, height):
    """Blocks of 8 (several rounds of block roots) and of 4,096 (one) give the same manifest."""
    appended = merkle.appended
    monkeypatch.setattr(merkle, "appended", lambda nodes, _=None: appended(nodes, height))
    rows = rows_of(700, random.Random(5))
    rows += [rows[0], rows[0], (rows[1][0], None, "en", None, None), (None, "s", "en", 1, "A"), (None, "s", "en", 2, ""),
             (3, "s", "only", 1, "x" * 200_000)]
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_empty(spark):
    assert run(spark, []) == []
    one = [(7, "s", "en", 3, "Abc")]
    assert run(spark, one) == brute(one)
    nine = [(i, None, None, None, "A b") for i in range(9)]
    assert run(spark, nine) == brute(nine)


def test_partial_witnesses_grow():
    """A leaf's witness is extended when, and only when, a run above it is complete."""
    stream = merkle.WitnessStream(2)
    for i in range(8):
        stream.append(bytes([i]) * 32)
        assert len(stream.witnesses[0]) == (0 if i < 7 else 2 + 7 * 32)
    stream.append(bytes([9]) * 32)
    assert len(stream.witnesses[8]) == 0
    root = stream.close()
    assert merkle.folded(bytes([8 + 1]) * 32, bytes(stream.witnesses[8]))[0] == root.hex()
    assert merkle.folded(bytes([3]) * 32, bytes(stream.witnesses[3]))[0] == root.hex()
    assert merkle.folded(bytes([4]) * 32, bytes(stream.witnesses[3]))[0] != root.hex()


def test_carried_columns(spark):
    df = spark.createDataFrame([(i, "g", h(str(i)), "x") for i in range(10)], "key long, `group` string, leaf string, pos string")
    out = merkle.manifest(df.withColumnRenamed("pos", "extra"))
    assert set(df.columns) - {"pos"} <= set(out.columns) and out.where(F.col("extra") == "x").count() == 10
