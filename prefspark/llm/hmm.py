"""Hidden Markov language model, trained and scored over whole texts.

Observations are words (A-Z lower-cased, cut at ASCII white space) and one end
token a document.  The most frequent training words, ``HEAD`` at most, are
symbols of their own; all others fall into ``CLASSES`` symbols by their last bytes, within
which a word has probability (c + 1) / (sum of c + 1 over the class, + 1 for
words not seen).  So the model proper has a fixed size, and every distinct
training word still counts: its count is joined to the documents that hold it.

1. Training words are counted in the tasks and summed by word.
2. Documents are written as sequences of symbols, with their rarer words.
3. States start from groups of the most frequent symbols that occur in the same
   documents (co-occurrence counts over all training documents).
4. Baum-Welch: each task runs the scaled forward-backward recursion over its
   whole documents and sums expected counts of starts, transitions and
   emissions; Spark sums these over tasks, and the driver, which gets a table of
   fixed size, forms the next model.  Windows of ``WINDOW`` tokens are worked on
   side by side: the products of their transition matrices give the forward and
   backward vectors at every border first, so nothing is cut there.
5. The scaled forward recursion over each whole document gives the exact
   likelihood of its symbols; the counts of its rarer words complete it.

base_score is the add-one unigram score over all training tokens.

Defined cases: a null or empty text is the end token alone; a null id counts as
empty text when its crc32 is taken; repeated rows are learned from and scored
as often as they occur; without training text every count is 0 and the score is
that of a uniform model; an empty table gives an empty table.  Only the id and
text columns are used.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.session import materialize

HEAD, CLASSES, SUFFIX = 40_000, 1_024, 4
STATES, ITERATIONS, WINDOW, ANCHORS = 8, 2, 256, 256
STAY, PULL, SMOOTH = 0.9, 0.9, 100.0  # first transition to the same state; an anchor's share in its state; prior tokens
BATCH_TOKENS, FLUSH_WORDS, SLICE_ROWS = 400_000, 400_000, 500


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def symbol_class(word: bytes) -> int:
    return crc32(word[-SUFFIX:]) % CLASSES


@dataclass
class Vocabulary:
    """Fixed-size part of the counts: symbols are head words by rank, then classes, then the end token."""

    head: list[bytes]
    counts: np.ndarray  # training tokens of each symbol
    class_mass: np.ndarray  # sum of (c + 1) of each class's words, + 1
    tokens: int  # N
    distinct: int  # V

    @property
    def size(self) -> int:
        return len(self.head) + CLASSES + 1

    @property
    def end(self) -> int:
        return self.size - 1

    def log_mass(self) -> np.ndarray:
        """log10 of a symbol's word mass: what a word's own count is divided by within its symbol."""
        out = np.zeros(self.size)
        out[len(self.head):-1] = np.log10(self.class_mass)
        return out


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), class, c over all rows of ``docs`` (text): counted in the tasks, summed by word."""
    def count(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                if len(seen) > FLUSH_WORDS:
                    yield partial(seen)
                    seen = Counter()
        if seen:
            yield partial(seen)

    def partial(seen):
        return pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.binary()), pa.array(map(symbol_class, seen), pa.int32()), pa.array(seen.values(), pa.int64())],
            names=["word", "class", "c"])

    return docs.select("text").mapInArrow(count, "word binary, class int, c long").groupBy("word").agg(
        F.min("class").alias("class"), F.sum("c").alias("c"))


def head_words(counts: DataFrame, head: int) -> list:
    """The ``head`` most frequent rows, those with equal counts by the word's hash, the most frequent first.

    The counts fall into a fixed number of ranges (exact up to 4,096, then by
    1 %), whose sizes tell from which range on all rows can be fetched.  The
    range that fits in part is looked into by exact count, then by slices of the
    hash, so at most ``head`` rows are fetched.
    """
    c, digest = F.col("c"), F.xxhash64("word")
    at = F.when(c <= 4096, c).otherwise(4096 + F.floor(F.log(c / 4096) / F.log(F.lit(1.01)))).cast("long")
    slices = [F.pmod(F.shiftright(digest, 12 * k), F.lit(4096)) for k in range(5)]
    part, rows, room = counts, [], head
    for key in (at, c, *slices):
        least, crossing = None, None
        for r in sorted(part.groupBy(key.alias("key")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["key"]):
            if r["n"] > room:
                crossing = r["key"]
                break
            least, room = r["key"], room - r["n"]
        if least is not None:
            rows += part.where(key >= least).collect()
        if crossing is None or not room:
            break
        part = part.where(key == crossing)
    return sorted(rows, key=lambda r: (-r["c"], bytes(r["word"])))


def vocabulary(counts: DataFrame, documents: int, head: int = HEAD) -> Vocabulary:
    """At most ``head`` words and sums of fixed size reach the driver."""
    top = head_words(counts, head)
    all_classes = {r["class"]: r for r in counts.groupBy("class").agg(
        F.sum("c").alias("c"), F.sum(F.col("c") + 1).alias("mass"), F.count("*").alias("v")).collect()}
    tokens, mass = np.zeros(CLASSES), np.ones(CLASSES)
    for k, r in all_classes.items():
        tokens[k], mass[k] = r["c"], r["mass"] + 1
    for r in top:  # these are symbols of their own
        tokens[r["class"]] -= r["c"]
        mass[r["class"]] -= r["c"] + 1
    n = sum(r["c"] for r in all_classes.values()) + documents
    v = sum(r["v"] for r in all_classes.values()) + (documents > 0)
    symbols = np.concatenate([[r["c"] for r in top], tokens, [documents]])
    return Vocabulary([bytes(r["word"]) for r in top], symbols, mass, int(n), int(v))


def sequences(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """id, held_out, n_tokens, n_head, head_sum, symbols (binary, 16 bits each), words and times (the rarer ones)."""
    logs = np.log10(vocab.counts + 1)
    first, end = len(vocab.head), vocab.end

    def encode(batches):
        index = {w: i for i, w in enumerate(vocab.head)}
        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            n, known, head_sum, symbols, words, times = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                own = words_of(text)
                s = np.array([index.get(w, -1) for w in own] + [end], dtype=np.int32)
                rare = np.flatnonzero(s < 0)
                rarer = [own[i] for i in rare]
                s[rare] = [first + symbol_class(w) for w in rarer]
                n.append(len(s))
                known.append(len(s) - len(rare) - (vocab.counts[end] == 0))
                head_sum.append(float(logs[np.delete(s, rare)].sum()))
                symbols.append(s.astype("<u2").tobytes())
                by_word = Counter(rarer)
                words.append(list(by_word.keys()))
                times.append(list(by_word.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(head_sum, pa.float64()), pa.array(symbols, pa.binary()), pa.array(words, pa.list_(pa.binary())),
                 pa.array(times, pa.list_(pa.int64()))],
                names=["id", "held_out", "n_tokens", "n_head", "head_sum", "symbols", "words", "times"])

    schema = (f"id {docs.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_head long, head_sum double, "
              "symbols binary, words array<binary>, times array<long>")
    return docs.select("id", "held_out", "text").mapInArrow(encode, schema)


def packed(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, the longest first, laid out time by time: (symbols, sequences still running at each time, offsets)."""
    lengths = np.array([len(s) for s in seqs])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    offset = np.cumsum(active) - active
    flat = np.empty(lengths.sum(), dtype=np.int64)
    for j, s in enumerate(seqs):
        flat[offset[:len(s)] + j] = s
    return flat, active, offset


def groups(lengths: np.ndarray, limit: int = BATCH_TOKENS):
    """Index arrays of sequences, the longest first, with at most ``limit`` tokens together (or one sequence)."""
    order, total, start = np.argsort(-lengths, kind="stable"), 0, 0
    for i, k in enumerate(order):
        if i > start and total + lengths[k] > limit:
            yield order[start:i]
            start, total = i, 0
        total += lengths[k]
    if start < len(order):
        yield order[start:]


def log_likelihoods(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 probability of each sequence, by the scaled forward recursion."""
    out = np.zeros(len(seqs))
    for group in groups(np.array([len(s) for s in seqs])):
        flat, active, offset = packed([seqs[k] for k in group])
        total = np.zeros(len(group))
        a = model.start * model.emit[flat[:active[0]]]
        for t in range(len(active)):
            n = active[t]
            if t:
                a = (a[:n] @ model.move) * model.emit[flat[offset[t]:offset[t] + n]]
            scale = a.sum(axis=1)
            a /= scale[:, None]
            total[:n] += np.log10(scale)
        out[group] = total
    return out


def window_products(parts: list[np.ndarray], model: Model) -> np.ndarray:
    """Of each window, the scaled probability of its symbols and last state given its first state."""
    states = len(model.start)
    out = np.empty((len(parts), states, states))
    for group in groups(np.array([len(s) for s in parts])):
        flat, active, offset = packed([parts[k] for k in group])
        r = np.eye(states) * model.emit[flat[:active[0]], None, :]
        for t, (n, o) in enumerate(zip(active, offset)):
            if t:
                out[group[n:len(r)]] = r[n:]
                r = (r[:n].reshape(-1, states) @ model.move).reshape(n, states, states) * model.emit[flat[o:o + n], None, :]
            r /= r.sum(axis=(1, 2), keepdims=True)
        out[group[:len(r)]] = r
    return out


def windows(seqs: list[np.ndarray], model: Model) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all sequences, and for each what the rest of its sequence says: (windows, starts, before, after).

    ``before`` is the scaled forward vector at the border ahead of a window that
    starts no sequence, ``after`` the scaled backward vector at its last token.
    """
    parts = [[s[i:i + WINDOW] for i in range(0, len(s), WINDOW)] for s in seqs]
    products = window_products([w for p in parts if len(p) > 1 for w in p], model)
    flat = [w for p in parts for w in p]
    starts, before, after = np.zeros(len(flat), dtype=bool), np.zeros((len(flat), len(model.start))), np.ones((len(flat), len(model.start)))
    at = used = 0
    for p in parts:
        starts[at] = True
        if len(p) > 1:
            own, a, b = products[used:used + len(p)], model.start, after[at]
            for k in range(len(p) - 1):
                a = a @ own[k]
                before[at + k + 1] = a = a / a.sum()
                a = a @ model.move
            for k in range(len(p) - 1, 0, -1):
                b = model.move @ (own[k] @ b)
                after[at + k - 1] = b = b / b.sum()
            used += len(p)
        at += len(p)
    return flat, starts, before, after


def expected_counts(seqs: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over whole sequences of expected starts, transitions and emissions (symbol x state), window by window."""
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    parts, starts, before, after = windows(seqs, model)
    for group in groups(np.array([len(s) for s in parts])):
        flat, active, offset = packed([parts[k] for k in group])
        begins, ahead, behind = starts[group], before[group], after[group]
        prior = np.where(begins[:, None], model.start, ahead @ model.move)
        given = model.emit[flat]
        alpha, scale = np.empty_like(given), np.empty(len(flat))
        a = prior * given[:active[0]]
        for t, (n, o) in enumerate(zip(active, offset)):
            if t:
                a = (a[:n] @ model.move) * given[o:o + n]
            scale[o:o + n] = s = a.sum(axis=1)
            a = a / s[:, None]
            alpha[o:o + n] = a

        def last(t, low):
            """Backward vectors of the windows from ``low`` on that end at time t."""
            b, o = behind[low:active[t]], offset[t]
            return b / (alpha[o + low:o + active[t]] * b).sum(axis=1, keepdims=True)

        gamma, beta = alpha, last(len(active) - 1, 0)
        pairs = np.zeros((states, states))
        for t in range(len(active) - 2, -1, -1):
            n, o, m, p = active[t], offset[t], active[t + 1], offset[t + 1]
            later = given[p:p + m] * beta / scale[p:p + m, None]
            pairs += alpha[o:o + m].T @ later
            gamma[p:p + m] *= beta
            beta = np.concatenate([later @ model.move.T, last(t, m)])
        # transitions over the border ahead of a window, which starts at its prior
        later = given[:active[0]] * beta / scale[:active[0], None]
        pairs += ahead.T @ later
        gamma[:active[0]] *= beta
        move += pairs * model.move
        start += gamma[:active[0]][begins].sum(axis=0)
        for s in range(states):
            emit[:, s] += np.bincount(flat, weights=gamma[:, s], minlength=len(emit))
    return start, move, emit


def co_occurrence(train: DataFrame, anchors: int) -> np.ndarray:
    """In how many training documents each two of the first symbols occur together; a table of fixed size."""
    def count(batches):
        total = np.zeros((anchors, anchors))
        for batch in batches:
            x = np.zeros((batch.num_rows, anchors), dtype=np.float32)
            for i, b in enumerate(batch.column(0)):
                s = np.frombuffer(b.as_py(), dtype="<u2")
                x[i, s[s < anchors]] = 1
            total += x.T @ x
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(list(total[rows]), pa.list_(pa.float64()))],
                                         names=["a", "together"])

    parts = train.select("symbols").mapInArrow(count, "a int, together array<double>")
    cells = parts.select("a", F.posexplode("together").alias("b", "n")).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((anchors, anchors))
    for r in cells:
        out[r["a"], r["b"]] = r["n"]
    return out


def grouped_anchors(together: np.ndarray, states: int) -> np.ndarray:
    """A group for each anchor: k-means over how much more often than by chance it occurs with each other one."""
    own = np.maximum(np.diag(together), 1)
    lift = np.log1p(together / np.sqrt(np.outer(own, own)) * 4)
    lift /= np.maximum(np.linalg.norm(lift, axis=1, keepdims=True), 1e-12)
    centres = [lift[0]] if len(lift) else []
    while 0 < len(centres) < min(states, len(lift)):  # each the farthest from those before
        near = np.max(lift @ np.array(centres).T, axis=1)
        centres.append(lift[near.argmin()])
    group = np.zeros(len(lift), dtype=np.int64)
    for _ in range(20 if centres else 0):
        group = np.argmax(lift @ np.array(centres).T, axis=1)
        for g in range(len(centres)):
            if (group == g).any():
                c = lift[group == g].mean(axis=0)
                centres[g] = c / max(np.linalg.norm(c), 1e-12)
    return group


def first_model(vocab: Vocabulary, group: np.ndarray, states: int) -> Model:
    share = np.full((vocab.size, states), 1 / states)
    share[:len(group)] = (1 - PULL) / max(1, states - 1)
    share[np.arange(len(group)), group] = PULL
    emit = (vocab.counts + 1)[:, None] * share
    move = np.full((states, states), (1 - STAY) / states) + STAY * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def next_model(vocab: Vocabulary, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """Expected counts, smoothed with ``SMOOTH`` tokens of the corpus's own symbol frequencies."""
    prior = (vocab.counts + 1) / (vocab.counts + 1).sum()
    return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True),
                 (emit + SMOOTH * prior[:, None]) / (emit.sum(axis=0) + SMOOTH))


def baum_welch(train: DataFrame, vocab: Vocabulary, model: Model) -> Model:
    """One iteration over all training sequences."""
    states = len(model.start)

    def count(batches):
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros((vocab.size, states))]
        for batch in batches:
            seqs = [np.frombuffer(b.as_py(), dtype="<u2") for b in batch.column(0)]
            for total, part in zip(sums, expected_counts(seqs, model)):
                total += part
        rows = np.concatenate([sums[0][None], sums[1], sums[2]])
        at = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(rows[at, s]) for s in range(states)]],
                                         names=["row", *[f"s{s}" for s in range(states)]])

    names = [f"s{s}" for s in range(states)]
    parts = train.select("symbols").mapInArrow(count, "row int, " + ", ".join(f"{c} double" for c in names))
    rows = np.zeros((1 + states + vocab.size, states))
    for r in parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).collect():
        rows[r["row"]] = [r[c] for c in names]
    return next_model(vocab, rows[0], rows[1:1 + states], rows[1 + states:])


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES,
                    iterations: int = ITERATIONS, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    docs = docs.select(F.col(doc_id).alias("id"), held_out(F.col(doc_id)).alias("held_out"),
                       F.col(text).cast("string").alias("text"))
    train = docs.where("not held_out")
    counts = materialize(count_words(train), "word-counts")
    vocab = vocabulary(counts, train.count(), head)
    seqs = materialize(sequences(docs, vocab).withColumn("row", F.monotonically_increasing_id()), "sequences")
    learn = seqs.where("not held_out")
    anchors = min(ANCHORS, len(vocab.head))
    group = grouped_anchors(co_occurrence(learn, anchors), states) if anchors else np.zeros(0, dtype=np.int64)
    model = first_model(vocab, group, states)
    for _ in range(iterations):
        model = baum_welch(learn, vocab, model)

    # the rarer words of each document meet their counts; head words cannot be among them
    rare = seqs.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    tail = rare.join(counts.withColumnRenamed("word", "words"), "words").groupBy("row").agg(
        F.sum("times").alias("n_tail"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("tail_sum"))

    mass = vocab.log_mass()

    def score(batches):
        for batch in batches:
            s = [np.frombuffer(b.as_py(), dtype="<u2") for b in batch.column(5)]
            logs = log_likelihoods(s, model) - np.array([mass[x].sum() for x in s])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], batch.column(6), pa.array(logs, pa.float64())],
                                             names=["id", "held_out", "n_tokens", "n_head", "head_sum", "row", "hmm"])

    scored = seqs.select("id", "held_out", "n_tokens", "n_head", "head_sum", "symbols", "row").mapInArrow(
        score, f"id {docs.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_head long, "
               "head_sum double, row long, hmm double")
    out = scored.join(tail, "row", "left")
    tail_sum = F.coalesce("tail_sum", F.lit(0.0))
    return out.select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + tail_sum - F.col("n_tokens") * log10(vocab.tokens + vocab.distinct + 1)).alias("base_score"),
        (F.col("hmm") + tail_sum).alias("score"))
