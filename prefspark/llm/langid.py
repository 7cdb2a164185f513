"""Language identification by cross-parsing.

A suffix automaton is built from a sample of labelled text of each language.
A text, lower-cased, with white space as one space, is parsed as a whole
against each automaton into phrases, each the longest match that the language's
text holds (a character it lacks is a phrase of its own).  The language that
needs the fewest phrases, each costing the logarithm of its sample's length,
wins: its text foretells this text best.

All texts of a slice are parsed side by side.  The transitions of all automata
are one hash table; texts are cut into segments that are parsed from a fresh
start, and the counts at their borders are put right by parsing on from the
state that the segment before ends in until both parses are in the same state,
from where they are equal.  The counts are those of one parse of the text.

The sample is the fitted model's only input: ``LANG_CHARS`` characters a
language, from pieces of at most ``PIECE`` characters at a place of the document
that its hash gives; distinct texts are taken by smallest hash.  Prediction
parses every text as a whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
a null label is not learned from; with nothing to learn from every text is
``und``; ties go to the first language in alphabetical order; texts that repeat
are learned from once; an empty table gives an empty table.  Only the text
decides a prediction.  Input columns named like an output column are replaced.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import unit_hash, without

LANG_CHARS, PIECE = 120_000, 2_000
SEGMENT, SLICE_CHARS = 4_096, 4_000_000
UNKNOWN = "und"
LETTER = r"\p{L}"
OUT = ("lang_pred", "score")
_MODELS: dict[tuple, "Model"] = {}


class SuffixAutomaton:
    """All substrings of a text: ``step[state]`` maps a character to the next state, from state 0."""

    def __init__(self, text: str):
        self.step: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.step)
            self.step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.step[p]:
                self.step[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:  # the strings of q that end here get a state of their own
                    copy = len(self.step)
                    self.step.append(dict(self.step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.step[p].get(c) == q:
                        self.step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def phrases(self, text: str) -> int:
        """Number of phrases of the greedy longest-match parse."""
        state, n, step = 0, 0, self.step
        for c in text:
            nxt = step[state].get(c)
            if nxt is None:
                n += state != 0
                nxt = step[0].get(c)
                if nxt is None:
                    n, nxt = n + 1, 0
            state = nxt
        return n + (state != 0)


class Transitions:
    """(state, character class) -> state for many pairs at a time, in one table with open addresses."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(3 * len(keys)).bit_length())  # a sixth to a third full
        self.shift, self.mask = np.uint64(64 - bits), 2 ** bits - 1
        # an entry is its key and, in the low bits, its value: one read for both
        self.low = int(values.max(initial=0)).bit_length()
        if int(keys.max(initial=0)).bit_length() + self.low > 63:
            raise ValueError("the samples have too many languages or characters for one table")
        self.entries = np.full(2 ** bits, -1, dtype=np.int64)
        at, entries = self._place(keys), keys << self.low | values
        while len(entries):
            free = self.entries[at] < 0
            self.entries[at[free]] = entries[free]
            left = self.entries[at] != entries
            entries, at = entries[left], (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, places of the keys that have none: what is there in the values means nothing)."""
        at = self._place(keys)
        found = self.entries.take(at)
        out = found & (1 << self.low) - 1
        other = np.flatnonzero((found >> self.low) != keys)  # few: most keys stand where they belong
        full = found.take(other) >= 0
        none, todo = [other[~full]], other[full]
        at, keys = at.take(todo), keys.take(todo)
        while len(todo):
            at = (at + 1) & self.mask
            found = self.entries.take(at)
            hit = (found >> self.low) == keys
            out[todo[hit]] = found[hit] & (1 << self.low) - 1
            none.append(todo[found < 0])
            on = ~hit & (found >= 0)
            todo, at, keys = todo[on], at[on], keys[on]
        return out, np.concatenate(none)


class Model:
    """The automata of all languages.  State 0 of all of them is the one between phrases."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        self.cost = np.array([log2(len(text) + 2) for _, text in samples])
        letters = sorted({ord(c) for _, text in samples for c in text})
        self.classes = len(letters) + 1  # 0: in no sample
        self.class_of = np.zeros(0x110000, dtype=np.int32)
        self.class_of[letters] = np.arange(1, self.classes)
        self.first = np.zeros((self.classes, len(samples)), dtype=np.int64)
        keys, values, base = [], [], 1
        for k, (_, text) in enumerate(samples):
            step = SuffixAutomaton(text).step
            for c, to in step[0].items():
                self.first[self.class_of[ord(c)], k] = base + to
            for state, nexts in enumerate(step):
                for c, to in nexts.items():
                    keys.append((base + state) * self.classes + int(self.class_of[ord(c)]))
                    values.append(base + to)
            base += len(step)
        self.next = Transitions(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64))

    @classmethod
    def of(cls, samples: tuple[tuple[str, str], ...]) -> "Model":
        """The worker's model for these samples."""
        if samples not in _MODELS:
            _MODELS[samples] = cls(samples)
        return _MODELS[samples]

    def _step(self, state: np.ndarray, letter: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, places where a phrase begins) of parses side by side."""
        to, begins = self.next.get(state * self.classes + letter)
        to[begins] = self.first[letter.take(begins), lang.take(begins)]
        return to, begins

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text, by language."""
        langs, sizes = len(self.langs), np.array([len(t) for t in texts], dtype=np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letters = self.class_of[codes]
        # segments: where they begin, how long they are, whose they are
        count = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(sizes) - sizes, count) + nth * SEGMENT
        length = np.minimum(SEGMENT, sizes[text] - nth * SEGMENT)
        n, fresh_end = self._fresh(letters, start, length)
        end = fresh_end.copy()
        total = np.zeros((len(texts), langs), dtype=np.int64)
        np.add.at(total, text, n)
        # borders: what parsing on from the segment before changes
        change = np.zeros_like(n)
        which = [np.repeat(np.flatnonzero(nth > 0), langs), np.tile(np.arange(langs), int((nth > 0).sum()))]
        while len(which[0]):
            seg, lang = which
            change[seg, lang], last, met = self._joined(letters, start[seg], length[seg], lang, end[seg - 1, lang])
            # a parse that does not meet the fresh one leaves the segment in another state
            last = np.where(met, fresh_end[seg, lang], last)
            other = end[seg, lang] != last
            end[seg[other], lang[other]] = last[other]
            after = other & (np.append(nth, 0)[seg + 1] > 0)
            which = [seg[after] + 1, lang[after]]
        np.add.at(total, text, change)
        return total

    def _fresh(self, letters: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases, end state) of segments by language, each parsed on its own."""
        langs = len(self.langs)
        order = np.argsort(-length, kind="stable")
        begin, active = start[order], np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
        n, state = np.zeros(len(order) * langs, dtype=np.int64), np.zeros(len(order) * langs, dtype=np.int64)
        lang = np.tile(np.arange(langs), len(order))
        for i, a in enumerate(active.tolist()):
            letter, lanes = np.repeat(letters[begin[:a] + i], langs), a * langs
            state[:lanes], begins = self._step(state[:lanes], letter, lang[:lanes])
            n[begins] += 1
        back = np.argsort(order)
        return n.reshape(-1, langs)[back], state.reshape(-1, langs)[back]

    def _joined(self, letters, start, length, lang, state) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parses from ``state``: (phrases more than a fresh parse has, end state, whether the two parses meet)."""
        more, last, met = np.zeros(len(start), dtype=np.int64), state.copy(), state == 0
        open_, i, fresh, mine = np.flatnonzero(~met), 0, np.zeros(int((~met).sum()), dtype=np.int64), state[~met]
        while len(open_):
            letter = letters[start[open_] + i]
            mine, begun = self._step(mine, letter, lang[open_])
            fresh, begun_fresh = self._step(fresh, letter, lang[open_])
            more[open_[begun]] += 1
            more[open_[begun_fresh]] -= 1
            last[open_], met[open_] = mine, mine == fresh
            i += 1
            on = ~met[open_] & (length[open_] > i)
            open_, fresh, mine = open_[on], fresh[on], mine[on]
        return more, last, met

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        has = [bool(self.langs and t) and any(map(str.isalpha, t)) for t in texts]
        out = [(UNKNOWN, 0.0)] * len(texts)
        where = [i for i, h in enumerate(has) if h]
        at = 0
        while at < len(where):
            part, chars = [], 0
            while at < len(where) and (not part or chars + len(texts[where[at]]) <= SLICE_CHARS):
                part.append(where[at])
                chars += len(texts[where[at]])
                at += 1
            for i, row in zip(part, self.phrases([plain(texts[i]) for i in part]) * self.cost):
                best, others = int(row.argmin()), np.delete(row, int(row.argmin()))
                out[i] = self.langs[best], 1.0 if not len(others) else float(1 - row[best] / others.min())
        return out


def plain(text: str) -> str:
    """Lower-cased, with white space as one space, also around the text."""
    return " " + " ".join(text.lower().split()) + " "


def learning_sample(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang",
                    chars: int = LANG_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, sample text) of every language among the rows where ``learn`` holds; ``chars`` of each."""
    use = F.coalesce(learn, F.lit(False)) & F.col(lang).isNotNull() & F.col(text).rlike(LETTER)
    known = docs.where(use).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
                                   unit_hash(F.lit("lang"), F.col(text)).alias("u"))
    # rows that repeat a text count once
    size = F.max(F.least(F.length("text"), F.lit(PIECE))).alias("n")
    sizes = known.groupBy("lang", "u").agg(size).groupBy("lang").agg(F.sum("n"))
    sizes = dict(sizes.collect())  # a number per language
    if not sizes:
        return ()
    # three times the share is expected to fall under the hash bound
    bound = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 3.0 * chars / n)))])
    room = F.greatest(F.length("text") - PIECE, F.lit(0))
    place = F.floor(unit_hash(F.lit("place"), F.col("text")) * (room + 1)).cast("int") + 1
    rows = known.where(F.col("u") < bound[F.col("lang")]).withColumn("piece", F.substring(F.col("text"), place, F.lit(PIECE)))
    rows = rows.groupBy("lang", "u").agg(F.min("piece").alias("piece")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["u"])):
        texts = out.setdefault(r["lang"], [])
        if sum(map(len, texts)) < chars:
            texts.append(r["piece"])
    return tuple((k, plain(" ".join(v))) for k, v in sorted(out.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1: by how much the runner-up needs more)."""
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = Model.of(samples)
        return pd.DataFrame(model.predict(texts.tolist()), columns=list(OUT))

    udf = F.pandas_udf(predict, "lang_pred string, score double")
    return without(docs, *OUT).withColumn("__p", udf(F.col(text))).select("*", "__p.*").drop("__p")
