"""Ranked lexical search by dense blocked matrix products.

Terms are maximal runs of ASCII letters and digits and of all characters beyond
ASCII, with A-Z lower-cased.  A query's score of a document is a sum of whole
numbers, weight * impact, over the query's terms.

1. Queries are dealt into blocks of about ``BLOCK_ENTRIES`` (query, term)
   entries; a block's vocabulary is bounded by its entries and goes to the
   tasks.  Each block is one pass over the documents' texts.
2. The pass writes, for every document with a term, its number of terms and the
   frequencies of the block's terms; document frequencies and the corpus sums
   come from that table.
3. Within a block, tiles of ``QUERY_TILE`` queries have a compact vocabulary of
   their own.  A query tile (queries x terms, weight times repeats) is
   multiplied with a document tile (documents x terms, impacts) by BLAS in
   float64.  Terms are cut into ranges whose sums stay below 2 ** 53, so every
   partial product is an exact whole number; ranges are summed in 64 bits.
4. Every task keeps the k best of each query over its tiles, by score and then
   id, so that ties never depend on the tiling; a window takes the k best.

Defined cases: a null text has no terms, as a query it has no results and as a
document it counts nowhere; an empty table gives an empty table; repeated
queries each have their results, repeated documents each take a rank; equal
scores are ordered by id, null last.  Only the id and text columns are used.
Very long texts are tokenised one at a time; a query of more entries than a
block has a block of its own.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.session import materialize

K = 20
BLOCK_ENTRIES, QUERY_TILE, DOC_TILE, TERM_TILE = 65_536, 64, 512, 4_096
EXACT = 2 ** 53
MAX_IMPACT = 1_000_000  # 10 ** 9 * tf div (1000 * tf + 12 * m) is below it
NULL_ID = 2 ** 63 - 1  # stands for a null id inside tasks, so that it sorts last
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n_terms: int, n_docs: int, all_terms: int) -> int:
    return 75 + (25 * n_terms * n_docs) // all_terms


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """uid, query_id, term (binary), times of every distinct term of every query."""
    rows = materialize(queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(text).cast("string").alias("text"))
                       .withColumn("uid", F.monotonically_increasing_id()), "queries")

    def build(batches):
        for b in batches:
            for uid, qid, t in zip(*(b.column(c).to_pylist() for c in ("uid", "query_id", "text"))):
                times = Counter(terms_of(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid] * len(times), pa.int64()), pa.array([qid] * len(times), pa.int64()),
                     pa.array(list(times), pa.binary()), pa.array(list(times.values()), pa.int64())],
                    names=["uid", "query_id", "term", "times"])

    return rows.mapInArrow(build, "uid long, query_id long, term binary, times long")


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in ``vocabulary``) and tfs of every document that has a term."""
    def count(batches):
        for b in batches:
            for at in range(0, b.num_rows, DOC_TILE):
                part = b.slice(at, DOC_TILE)
                keep, n, sizes, terms, tfs = [], [], [], [], []
                for i in range(part.num_rows):
                    words = terms_of(part.column(1)[i].as_py())
                    if not words:
                        continue
                    found = Counter(map(vocabulary.get, words))
                    found.pop(None, None)
                    keep.append(i), n.append(len(words)), sizes.append(len(found))
                    terms.extend(found), tfs.extend(found.values())
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


class QueryTile:
    """Some queries over the terms they have: ``columns`` are places in the block's vocabulary, sorted."""

    def __init__(self, queries: list[tuple[list[int], list[int]]], weights: np.ndarray):
        self.columns = np.unique(np.concatenate([np.asarray(t, dtype=np.int64) for t, _ in queries]))
        self.columns = self.columns[weights[self.columns] > 0]
        matrix = np.zeros((len(queries), len(self.columns)), dtype=np.int64)
        for row, (terms, times) in enumerate(queries):
            terms, times = np.asarray(terms, dtype=np.int64), np.asarray(times, dtype=np.int64)
            has = weights[terms] > 0
            matrix[row, np.searchsorted(self.columns, terms[has])] = times[has] * weights[terms[has]]
        self.ranges = exact_ranges(matrix)

    def scores(self, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_rows: int) -> np.ndarray:
        """(queries, documents) exact scores of a document tile with entries (row, term, impact)."""
        out = np.zeros((self.ranges[0][2].shape[0] if self.ranges else 0, n_rows), dtype=np.int64)
        if not self.ranges:
            return out
        at = np.minimum(np.searchsorted(self.columns, terms), len(self.columns) - 1)
        hit = self.columns[at] == terms
        rows, at, impacts = rows[hit], at[hit], impacts[hit]
        for low, high, part in self.ranges:
            here = (at >= low) & (at < high)
            tile = np.zeros((n_rows, high - low))
            tile[rows[here], at[here] - low] = impacts[here]
            out += (part @ tile.T).astype(np.int64)
        return out


def exact_ranges(matrix: np.ndarray, columns: int = TERM_TILE) -> list[tuple[int, int, np.ndarray]]:
    """(low, high, float64 part) whose row sums times any impact stay below 2 ** 53; the parts sum to ``matrix``."""
    out, todo = [], [(low, min(low + columns, matrix.shape[1]), matrix[:, low:low + columns])
                     for low in range(0, matrix.shape[1], columns)]
    while todo:
        low, high, part = todo.pop()
        if int(part.sum(axis=1).max(initial=0)) * MAX_IMPACT < EXACT:
            out.append((low, high, part.astype(np.float64)))
        elif high - low > 1:
            middle = (low + high) // 2
            todo += [(low, middle, part[:, :middle - low]), (middle, high, part[:, middle - low:])]
        else:  # one term repeated very often
            todo += [(low, high, part // 2), (low, high, part - part // 2)]
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, ties to the smaller id."""
    able = np.flatnonzero(scores > 0)
    if len(able) > k:
        least = np.partition(scores[able], len(able) - k)[len(able) - k]
        able = able[scores[able] >= least]  # all that tie with the k-th
    return able[np.lexsort((ids[able], -scores[able]))][:k]


def _search_block(docs: DataFrame, entries: list, k: int) -> DataFrame | None:
    """uid, query_id, doc_id (NULL_ID: null), score: the k best of every task for the queries of one block."""
    vocabulary: dict[bytes, int] = {}
    queries: dict[int, tuple[int, list[int], list[int]]] = {}
    for e in entries:
        q = queries.setdefault(e["uid"], (e["query_id"], [], []))
        q[1].append(vocabulary.setdefault(bytes(e["term"]), len(vocabulary))), q[2].append(e["times"])
    counted = materialize(term_counts(docs, vocabulary), "term-counts")
    n_docs, all_terms = counted.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the block
        df[r["t"]] = r["count"]
    weights = np.array([weight(n_docs, int(x)) for x in df], dtype=np.int64)
    order = sorted(queries)
    groups = [order[at:at + QUERY_TILE] for at in range(0, len(order), QUERY_TILE)]

    def search(batches):
        tiles = [QueryTile([queries[u][1:] for u in g], weights) for g in groups]
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for at in range(0, b.num_rows, DOC_TILE):
                part = b.slice(at, DOC_TILE)
                ids = part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                m = np.array([length_norm(n, n_docs, all_terms) for n in part.column(1).to_pylist()], dtype=np.int64)
                rows = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy(zero_copy_only=False))
                terms = part.column(2).flatten().to_numpy(zero_copy_only=False)
                tfs = part.column(3).flatten().to_numpy(zero_copy_only=False)
                impacts = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[rows])
                for g, tile in zip(groups, tiles):
                    scores = tile.scores(rows, terms, impacts, part.num_rows)
                    for row in np.flatnonzero(scores.max(axis=1, initial=0) > 0):
                        u, s = g[row], scores[row]
                        if u not in best:
                            best[u] = ids[:0], s[:0]
                        old_ids, old = best[u]
                        new = np.flatnonzero(s >= (old[-1] if len(old) == k else 1))
                        if len(new):
                            all_ids, all_s = np.concatenate([old_ids, ids[new]]), np.concatenate([old, s[new]])
                            top = best_of(all_ids, all_s, k)
                            best[u] = all_ids[top], all_s[top]
        for u, (doc, s) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc), u)), pa.array([queries[u][0]] * len(doc), pa.int64()), pa.array(doc), pa.array(s)],
                names=["uid", "query_id", "doc_id", "score"])

    return counted.mapInArrow(search, "uid long, query_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
                  query_id: str = "item_id", query_text: str = "text", block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k best documents of every query, of those with a score above 0."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    terms = materialize(query_terms(queries, query_id, query_text), "query-terms")
    blocks = max(1, -(-terms.count() // block_entries))
    terms = terms.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    hits = None
    for i in range(blocks):
        entries = terms.where(F.col("block") == i).drop("block").collect()  # about block_entries rows
        found = _search_block(docs, entries, k) if entries else None
        if found is not None:
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], "uid long, query_id long, doc_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "doc_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"),
                         F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "score")
