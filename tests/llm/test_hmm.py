import random
from collections import Counter
from itertools import product
from math import isclose, log10
from zlib import crc32

import numpy as np
import pytest

from prefspark.llm import hmm
from prefspark.llm.queries import op5_hmm

SCHEMA = "doc_id long, text string, score string, row string"


def model(rng, states, symbols):
    def rows(n, m):
        x = rng.random((n, m)) + 0.05
        return x / x.sum(axis=1, keepdims=True)
    return hmm.Model(rows(1, states)[0], rows(states, states), rows(states, symbols).T)


def paths(seq, m):
    """(probability, path) of every state path."""
    for path in product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[o, b]
        yield p, path


def test_likelihood_and_expected_counts_equal_all_paths(monkeypatch):
    rng = np.random.default_rng(3)
    m = model(rng, 3, 5)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 2, 6, 4, 1)]
    monkeypatch.setattr(hmm.groups, "__defaults__", (8,))
    got = hmm.log_likelihoods(seqs, m)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, g in zip(seqs, got):
        every = list(paths(s, m))
        total = sum(p for p, _ in every)
        assert isclose(g, log10(total), rel_tol=1e-9)
        for p, path in every:
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for o, a in zip(s, path):
                emit[o, a] += p / total
    for a, b in zip(hmm.expected_counts(seqs, m), (start, move, emit)):
        assert np.allclose(a, b)


def whole_counts(seqs, m):
    """Expected counts by the plain forward-backward recursion, token by token over each whole sequence."""
    start, move, emit = np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit)
    for s in seqs:
        a, b = [m.start * m.emit[s[0]]], [np.ones(len(m.start))]
        for o in s[1:]:
            a.append((a[-1] / a[-1].sum()) @ m.move * m.emit[o])
        for o in s[:0:-1]:
            x = m.move @ (m.emit[o] * b[-1])
            b.append(x / x.sum())
        b.reverse()
        for t, o in enumerate(s):
            g = a[t] * b[t] / (a[t] @ b[t])
            emit[o] += g
            if t:
                x = a[t - 1][:, None] * m.move * (m.emit[o] * b[t])
                move += x / x.sum()
            else:
                start += g
    return start, move, emit


def test_training_counts_are_those_of_whole_texts(spark):
    rng = np.random.default_rng(6)
    vocab = hmm.Vocabulary([b"a", b"b", b"c"], np.ones(hmm.CLASSES + 4), np.ones(hmm.CLASSES), 1, 1)
    m = model(rng, 3, vocab.size)
    seqs = [rng.integers(0, 6, n) for n in (1, 255, 256, 257, 512, 513, 700, 1500, 3)]
    for a, b in zip(hmm.expected_counts(seqs, m), whole_counts(seqs, m)):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
    df = spark.createDataFrame([(bytearray(s.astype("<u2").tobytes()),) for s in seqs], "symbols binary").repartition(2)
    got, want = hmm.baum_welch(df, vocab, m), hmm.next_model(vocab, *whole_counts(seqs, m))
    for name in ("start", "move", "emit"):  # a start and no border transition at every 256 tokens would show here
        assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-9), name


def brute_base(rows):
    train = [hmm.words_of(t) for i, t in rows if crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t + ["<end>"])
    n, v = sum(c.values()), len(c)
    return n, [(i, crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(own), sum(c[w] > 0 for w in own),
                sum(log10((c[w] + 1) / (n + v + 1)) for w in own)) for i, t in rows for own in [hmm.words_of(t) + ["<end>"]]]


@pytest.mark.parametrize("head", [3, 40_000])
def test_base_score_and_odd_inputs(spark, head):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["The", "the", "cat", "é", "zz9", f"w{i}"], k=rng.randint(0, 30)))) for i in range(80)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, "the the"), (90, None), (91, ""), (92, "x" * 100_000), (93, "the " * 20_000)]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)
    out = hmm.score_documents(df, head=head).collect()
    n, want = brute_base(rows)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in out), key=str)
    for a, b in zip(got, sorted(want, key=str)):
        assert a[:4] == b[:4] and isclose(a[4], b[4], rel_tol=1e-9)
    assert all(r["train_tokens"] == n and r["score"] < 0 and np.isfinite(r["score"]) for r in out)


def test_head_is_filled_from_the_range_that_crosses_the_limit(spark):
    rows = [(f"one{i}".encode(), 0, 1) for i in range(300)] + [(b"top", 0, 9), (b"next", 0, 7)]
    rows += [(f"big{i}".encode(), 0, 5000 + i) for i in range(20)]  # within one per cent
    df = spark.createDataFrame([(bytearray(w), k, c) for w, k, c in rows], "word binary, class int, c long").repartition(3)
    for head in (0, 1, 5, 21, 22, 23, 150, 321, 322, 400):
        got = hmm.head_words(df, head)
        counts = sorted((c for _, _, c in rows), reverse=True)[:head]
        assert [r["c"] for r in got] == counts and len({bytes(r["word"]) for r in got}) == len(counts), head


def test_no_training_text_and_empty_table(spark):
    assert hmm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    out_id = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    r = hmm.score_documents(spark.createDataFrame([(out_id, "a b", "", "")], SCHEMA)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0


def test_probabilities_of_one_word_texts_sum_to_one(spark):
    """All one-word texts that the model can tell apart, unseen words of each class as one, given one word and the end."""
    docs = [(i, t) for i, t in enumerate(["a b c", "b c dd", "ee a a", "ff gg a", "b b"] * 4)]
    df = spark.createDataFrame([(i, t, "", "") for i, t in docs], SCHEMA)
    train = df.select("doc_id", "text").where(~hmm.held_out(df.doc_id))
    counts = hmm.count_words(train)
    vocab = hmm.vocabulary(counts, train.count(), 3)
    within = Counter()
    for r in counts.collect():
        if bytes(r["word"]) not in vocab.head:
            within[r["class"]] += r["c"] + 1
    for k in range(hmm.CLASSES):  # known words and the unseen one
        assert isclose((within[k] + 1) / vocab.class_mass[k], 1.0)
    m = hmm.next_model(vocab, np.ones(2), np.ones((2, 2)), np.ones((vocab.size, 2)))
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1) and isclose(m.start.sum(), 1)


def test_held_out_text_is_likelier_than_by_words_alone(spark):
    rows = op5_hmm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    per_token = [sum(r[c] for r in rows) / sum(r["n_tokens"] for r in rows) for c in ("base_score", "score")]
    assert len(rows) > 100 and per_token[1] > per_token[0] + 0.05, per_token
