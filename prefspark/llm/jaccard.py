"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are the 64-bit hashes of its distinct word shingles, and
two documents link when 100 * |x & y| >= ``percent`` * |x | y|.  Documents with
equal sets are one node.  A set of n tokens can lack at most
e = n - ceil(percent * n / 100) of them in a set that it links with, and both
sides order tokens alike, so among a prefix with room for more than e errors
something is shared:

1. Screen.  With tokens in hash order, of the first e + l tokens at least l are
   shared by a partner.  Nodes with fewer tokens that another node's prefix
   holds can link with nothing and go.  The others' whole sets are read again.
2. Signatures.  Tokens of the remaining nodes are ordered by frequency, rare
   first.  Rare tokens are indexed one by one, frequent ones by combinations of
   two, very frequent ones by combinations of three, within buckets of tokens.
   A bucket with x tokens and combinations of k stays silent only with
   x - k + 1 errors, so the prefix is extended until these sum to more than e;
   then linked nodes share a signature.  Buckets (by hash, about 20 tokens of a
   set each) keep the number of combinations in proportion to the prefix; their
   number depends on the size band of the set, and sets near a band's end are
   indexed in both bands.
3. Families.  Each signature's nodes join the family of its most central node
   (the one whose tokens are the most frequent, as the original of edited
   copies is).  Every node is verified with its most central family head, and
   linked nodes form components.
4. Verification.  In families that still span several components, nodes of the
   head's component meet the others, and the others each other, in blocks of
   bounded size; all links between different components are found by counting
   common tokens.  Components of all links are the classes.

No step emits the pairs of a group: a family gives one row for each node and
block, and a block at most one link for each node.

Defined cases: words are lower-cased (A-Z) and cut at ASCII white space; a text
with fewer words than a shingle is one shingle; a null or empty text has no
shingle, links with nothing and is its own component; a null id never is the
smallest, unless alone; repeated rows are equal sets; an empty table gives an
empty table.  Only the id and text columns are used.
"""

from __future__ import annotations

from itertools import combinations
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.llm.common import release_memory, small_or_not, text_slices
from prefspark.llm.graph import components
from prefspark.session import materialize

if TYPE_CHECKING:
    import pandas as pd

WORDS, PERCENT = 4, 85
FREQUENT, VERY_FREQUENT = 32, 1_000  # nodes with a token, beyond which two, three tokens are combined
BUCKET_TOKENS, BLOCK = 20, 256
MEMO_WORDS, MEMO_BYTES, COLUMNS = 200_000, 48, 4_096
SIGNATURES = 250_000  # that a task holds at a time
_HASHES: dict[bytes, int] = {}
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, remembered within a worker."""
    if len(_HASHES) > MEMO_WORDS:
        _HASHES.clear()
    new = set(words).difference(_HASHES)
    for w in new:
        _HASHES[w] = xxhash.xxh3_64_intdigest(w)
    out = np.array(list(map(_HASHES.__getitem__, words)), dtype=np.uint64)
    for w in new:
        if len(w) > MEMO_BYTES:
            del _HASHES[w]
    return out


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    h = word_hashes((text or "").encode().lower().split())
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)  # the length counts for texts with fewer words
    for i in range(k):
        out = _mixed(out * _M1 + h[i:len(h) - k + 1 + i])
    return np.unique(out.view(np.int64))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n shares at least with a set that it links with."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    """By how many tokens the screen's prefix is extended."""
    return max(1, -(-n // 10))


def linked(common: Column, n1: Column, n2: Column, percent: int) -> Column:
    return 100 * common >= percent * (n1 + n2 - common)


def lone(n: int, percent: int) -> bool:
    """Whether a set of n can only link with an equal set."""
    return least_overlap(n + 1, percent) > n and least_overlap(n, percent) > n - 1


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """id, n, key (128-bit hash of the set) and the screen's prefix of every row."""
    def build(batches):
        for batch in (x for b in batches for x in text_slices(b, 1)):
            n, keys, prefixes = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                upto = 0 if lone(len(s), percent) else len(s) - least_overlap(len(s), percent) + spare(len(s))
                prefixes.append(s[:upto])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), _lists(prefixes)],
                names=["id", "n", "key", "prefix"])
        _HASHES.clear()
        release_memory()

    schema = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()),
                           T.StructField("prefix", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(build, schema)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _screened(nodes: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """node, n, id, key of the nodes whose prefix shares enough tokens with other nodes' prefixes.

    ``copies`` are the rows that are no nodes, as their sets are those of other
    rows.  They go by a join that leaves the prefixes where they are, if small.
    """
    reps = nodes.where("n > 0").join(small_or_not(copies), "node", "left_anti")
    own = reps.where(F.size("prefix") > 0)
    tokens = own.select("node", F.explode("prefix").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    shared = tokens.join(common, "token").groupBy("node").agg(F.count("*").alias("shared"))
    # of a partner, which has at least least_overlap(n) tokens
    smallest = F.ceil(F.col("n") * percent / 100)
    need = F.greatest(F.lit(1), F.ceil(smallest / 10))
    enough = small_or_not(materialize(shared, "shared"))
    return reps.drop("prefix").join(enough, "node").where(F.col("shared") >= need).select("node", "n", "id", "key")


def _whole_sets(docs: DataFrame, kept: DataFrame, words: int) -> DataFrame:
    """node, n, tokens of the nodes of ``kept``: their documents are read again."""
    side = small_or_not(kept.withColumnRenamed("id", "kept_id"))
    found = docs.join(side, F.col("id").eqNullSafe(F.col("kept_id"))).select("node", "n", "key", "text")

    def build(batches):
        for batch in (x for b in batches for x in text_slices(b, 3)):
            rows = [(i, s) for i, (text, key) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()))
                    for s in [shingle_set(text, words)] if xxhash.xxh3_128_digest(s.tobytes()) == key]
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), _lists([s for _, s in rows])],
                                             names=["node", "n", "tokens"])
        _HASHES.clear()
        release_memory()

    sets = found.mapInArrow(build, "node long, n long, tokens array<long>")
    sets = materialize(sets.withColumn("place", F.monotonically_increasing_id()), "whole-sets")
    # rows with equal ids and texts give a node more than once: the others go by their place, and no set is moved
    first = sets.groupBy("node").agg(F.min("place").alias("first"), F.count("*").alias("c")).where("c > 1")
    more = materialize(sets.select("node", "place").join(first, "node").where("place <> first").select("place"), "more-sets")
    return sets.join(small_or_not(more), "place", "left_anti").drop("place")


def node_signatures(n: int, tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT,
                    classes: tuple[int, int] = (FREQUENT, VERY_FREQUENT)) -> np.ndarray:
    """Signatures of a set of n tokens, of which ``tokens`` are in ``counts`` > 1 sets (the others in no other)."""
    errors = n - least_overlap(n, percent)
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order].view(np.uint64), counts[order]
    kinds = np.where(counts <= classes[0], 1, np.where(counts <= classes[1], 2, 3))
    out = []
    band = n.bit_length() - 1
    # a set is in the band of its size, and in the one before if it can link with a set there
    for j in {band, (least_overlap(n, percent)).bit_length() - 1}:
        buckets, room, members = max(1, 2 ** j // BUCKET_TOKENS), n - len(tokens), {}
        where = np.where(kinds > 1, _mixed(tokens) % np.uint64(buckets), np.uint64(0)).tolist()
        for t, kind, bucket in zip(tokens, kinds.tolist(), where):
            if room > errors:
                break
            own = members.setdefault((kind, bucket), [])
            own.append(t)
            room += len(own) >= kind
        if room <= errors:
            continue  # cannot be: see the module's text; sets that are too small are no nodes here
        for (kind, _), own in members.items():
            if len(own) < kind:
                continue
            sets = np.array(list(combinations(own, kind)), dtype=np.uint64)
            sig = np.full(len(sets), 4 * j + kind, dtype=np.uint64)
            for c in range(kind):
                sig = _mixed(sig * _M1 + sets[:, c])
            out.append(sig)
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def signature_rows(*columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["sig", "node", "centrality"])


def _signatures(sets: DataFrame, percent: int) -> DataFrame:
    """sig, node, centrality (mean frequency of the node's tokens)."""
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = tokens.join(counts, "token").groupBy("node").agg(
        F.first("n").alias("n"), F.collect_list("token").alias("tokens"), F.collect_list("c").alias("counts"))
    shared = shared.where(100 * F.size("tokens") >= percent * F.col("n"))

    def build(batches):
        for batch in batches:
            sigs, nodes, central, made = [], [], [], 0
            for node, n, own, c in zip(*[batch.column(k).to_pylist() if k < 2 else batch.column(k) for k in range(4)]):
                c = c.values.to_numpy()
                sigs.append(node_signatures(n, own.values.to_numpy(), c, percent))
                nodes.append(np.full(len(sigs[-1]), node))
                central.append(np.full(len(sigs[-1]), (c.sum() + n - len(c)) / n))
                made += len(sigs[-1])
                if made >= SIGNATURES:
                    yield signature_rows(sigs, nodes, central)
                    sigs, nodes, central, made = [], [], [], 0
            if sigs:
                yield signature_rows(sigs, nodes, central)
        release_memory()

    return shared.mapInArrow(build, "sig long, node long, centrality double")


def _families(sigs: DataFrame) -> DataFrame:
    """head, head_centrality, node: each signature's nodes under its most central one (ties: the smallest)."""
    heads = sigs.groupBy("sig").agg(F.count("*").alias("c"), F.min(F.struct((-F.col("centrality")).alias("x"), "node")).alias("h"))
    heads = heads.where("c > 1").select("sig", F.col("h.node").alias("head"), F.col("h.x").alias("x"))
    return sigs.select("sig", "node").join(heads, "sig").groupBy("head", "node").agg(F.first("x").alias("x"))


def _with_head(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges between nodes and their most central heads, verified."""
    best = family.where("head <> node").groupBy("node").agg(F.min(F.struct("x", "head")).alias("b")).select(
        "node", F.col("b.head").alias("head"))
    mine = sets.select("node", F.col("n").alias("n1"), F.col("tokens").alias("t1"))
    theirs = sets.select(F.col("node").alias("head"), F.col("n").alias("n2"), F.col("tokens").alias("t2"))
    best = materialize(best, "best-heads")
    # with few families only the sets in them move, not those of all nodes
    heads = small_or_not(best.select("head").distinct())
    pairs = mine.join(small_or_not(best), "node").join(theirs.join(heads, "head", "left_semi"), "head")
    common = F.size(F.array_intersect("t1", "t2"))
    return pairs.where(linked(common, F.col("n1"), F.col("n2"), percent)).select(
        F.col("node").alias("u"), F.col("head").alias("v"))


def common_tokens(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common tokens of every left with every right set."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not left or not right:
        return out
    flat = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(*flat)
    if not len(both):
        return out
    hits = []  # (set, place in ``both``) of the tokens that occur on both sides
    for side, tokens in zip((left, right), flat):
        at = np.minimum(np.searchsorted(both, tokens), len(both) - 1)
        hit = both[at] == tokens
        hits.append((np.repeat(np.arange(len(side)), [len(s) for s in side])[hit], at[hit]))
    for low in range(0, len(both), COLUMNS):
        tables = []
        for side, (row, at) in zip((left, right), hits):
            here = (at >= low) & (at < low + COLUMNS)
            table = np.zeros((len(side), COLUMNS), dtype=np.float32)
            table[row[here], at[here] - low] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _block_links(percent: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd  # here, as it takes memory in the workers of all other stages
        first, second = pdf[pdf["first"]], pdf[pdf["second"]]
        common = common_tokens(first["tokens"].tolist(), second["tokens"].tolist())
        n = first["n"].to_numpy()[:, None] + second["n"].to_numpy()[None, :]
        rows, cols = np.nonzero(100 * common.astype(np.int64) >= percent * (n - common.astype(np.int64)))
        node = [first["node"].to_numpy()[rows], second["node"].to_numpy()[cols]]
        comp = [first["component"].to_numpy()[rows], second["component"].to_numpy()[cols]]
        parent, out = {}, []

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for u, v, cu, cv in zip(*node, *comp):  # a link for each two components that are still apart
            ru, rv = root(cu), root(cv)
            if ru != rv:
                parent[ru] = rv
                out.append((u, v))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return links


def _in_blocks(family: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Edges within families between nodes of different components."""
    members = family.select("head", "node").join(comp, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    heads = members.where(F.col("head") == F.col("node")).select("head", F.col("component").alias("main"))
    members = members.join(heads, "head").withColumn("inner", F.col("component") == F.col("main"))
    sizes = members.groupBy("head").agg(
        F.ceil(F.count(F.when(F.col("inner"), 1)) / BLOCK).cast("int").alias("inners"),
        F.ceil(F.count(F.when(~F.col("inner"), 1)) / BLOCK).cast("int").alias("outers")).where("outers > 0")
    m = materialize(members.join(sizes, "head").withColumn("b", F.pmod(
        F.xxhash64("node"), F.when(F.col("inner"), F.col("inners")).otherwise(F.col("outers"))).cast("int")), "families")

    # a block of others (i) meets blocks of others (j >= i) and of the head's component (j < 0)
    outer, inner = m.where(~F.col("inner")), m.where(F.col("inner"))
    meets = [
        outer.select("*", F.col("b").alias("i"), F.explode(F.sequence(-F.col("inners"), F.col("outers") - 1)).alias("j"))
        .where("j < 0 or j >= b").withColumns({"first": F.lit(True), "second": F.col("j") == F.col("b")}),
        outer.where("b > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("i"), F.col("b").alias("j"))
        .withColumns({"first": F.lit(False), "second": F.lit(True)}),
        inner.select("*", F.explode(F.sequence(F.lit(0), F.col("outers") - 1)).alias("i"), (-1 - F.col("b")).alias("j"))
        .withColumns({"first": F.lit(False), "second": F.lit(True)}),
    ]
    columns = ["head", "i", "j", "node", "component", "first", "second"]
    rows = meets[0].select(*columns).unionByName(meets[1].select(*columns)).unionByName(meets[2].select(*columns))
    rows = small_or_not(materialize(rows, "blocks"))  # then the sets move once, into their blocks
    return sets.join(rows, "node").groupBy("head", "i", "j").applyInPandas(_block_links(percent), "u long, v long")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every row."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100: below, small sets have too few tokens for their prefixes")
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    nodes = materialize(_sets(docs, words, percent).withColumn("row", F.monotonically_increasing_id()), "sets")
    # equal sets are one node: its smallest row, with that row's id to find the text again
    classes = nodes.where("n > 0").groupBy("key").agg(
        F.min("row").alias("node"), F.min("id").alias("class_id"), F.first("n").alias("n"))
    classes = materialize(classes, "classes")
    copies = nodes.where("n > 0").select(F.col("row").alias("copy"), "key").join(classes.select("key", "node"), "key")
    copies = materialize(copies.where("copy <> node").select(F.col("copy").alias("node")), "copies")
    kept = materialize(_screened(nodes.withColumnRenamed("row", "node"), copies, percent), "screened")
    sets = _whole_sets(docs, kept, words)
    sigs = materialize(_signatures(sets, percent), "signatures")
    family = materialize(_families(sigs), "family")
    edges = materialize(_with_head(family, sets, percent), "head-links")
    comp = materialize(components(edges).withColumnRenamed("component", "c").select(
        F.col("node"), F.col("c").alias("component")), "head-components")
    more = materialize(_in_blocks(family, sets, comp, percent), "block-links")
    final = materialize(components(edges.unionByName(more)), "components")
    # smallest id of each component, then of each class
    of_class = classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = of_class.groupBy("component").agg(F.min("class_id").alias("component_id"))
    labels = of_class.join(ids, "component").select(F.col("key").alias("k"), F.col("component_id").alias("c"))
    out = nodes.select("id", "n", "key").join(labels, (F.col("key") == F.col("k")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` but for one of each component: the smallest id's (null last), of equal ids any one.

    Rows are known by a number of their own, so repeated ids and rows are told
    apart; what goes is joined away, and broadcast only if it is small.
    """
    keyed = materialize(docs.select(F.struct("*").alias("__row"), F.monotonically_increasing_id().alias("__n")), "one-of-each")
    plain = keyed.select("__n", F.col(f"__row.`{doc_id}`").alias("__id"), F.col(f"__row.`{text}`").alias("__text"))
    labels = jaccard_classes(plain, "__n", "__text", **options).withColumnRenamed("doc_id", "__n")
    members = materialize(labels.join(plain.select("__n", "__id"), "__n"), "members")
    order = F.struct(F.col("__id").isNull().alias("a"), F.col("__id").alias("b"), F.col("__n").alias("c"))
    first = members.groupBy("component_id").agg(F.min(order).alias("f"), F.count("*").alias("k")).where("k > 1")
    gone = members.join(first, "component_id").where(F.col("__n") != F.col("f.c")).select("__n")
    gone = small_or_not(materialize(gone, "gone"))
    return keyed.join(gone, "__n", "left_anti").select("__row.*")
