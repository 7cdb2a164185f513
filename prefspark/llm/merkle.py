"""Merkle manifest of a table, with a witness for every row.

Rows are leaves, in the order of their key within a group; every ``ARITY``
consecutive nodes of a level become their parent, until one is left: the
group's subroot.  Subroots, in the order of their groups, are the leaves of a
last tree, whose root is the manifest's.

1. Leaves are dealt by range of (group, key), written once, and numbered from
   the counts of each range: no task sorts more than a range.
2. Aligned blocks of ``ARITY ** BLOCK_HEIGHT`` leaves are streamed: each append
   opens a subtree with an empty witness, and whenever a run of siblings is
   complete the witnesses of all leaves under it are extended by their
   siblings.  A block leaves its root and a partial witness for each leaf.
3. Block roots are further appends: blocks of them are streamed alike, until
   each group has one root, and then the subroots.
4. A leaf's witness is its own partial one and that of its block root, which
   is joined by (group, block): no join has a group alone as its key.

A witness holds, level by level, the node's place in its run, the run's size
and the siblings' digests.  Folding a leaf with it gives the root again if, and
only if, neither was changed.

Defined cases: every null field counts as ``-``; null groups and null keys are
first; rows with equal keys are ordered by their digests; repeated rows are
leaves of their own; a single leaf is its own subroot (and root, if alone) and
has an empty witness; an empty table gives an empty manifest.  Only the named
columns are read; carried columns must not have the names of the output.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.session import materialize

ARITY, BLOCK_HEIGHT = 8, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, ``:`` and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def height(n: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree with n of them."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


class WitnessStream:
    """Appends nodes, in order, to a tree of at most ``height`` levels; digests are 32 bytes.

    ``open`` holds the nodes of each level whose parent is not complete yet,
    each with the range of leaves under it.
    """

    def __init__(self, height: int, arity: int = ARITY):
        self.height, self.arity = height, arity
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(height)]
        self.witnesses: list[bytearray] = []
        self.root: bytes | None = None

    def append(self, digest: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append(bytearray())
        self._push(0, digest, at, at + 1)

    def _push(self, level: int, digest: bytes, first: int, end: int) -> None:
        if level == self.height:
            self.root = digest
            return
        self.open[level].append((digest, first, end))
        if len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for i, (_, first, end) in enumerate(run):
            step = bytes([i, len(run)]) + b"".join(d for k, (d, _, _) in enumerate(run) if k != i)
            for leaf in range(first, end):
                self.witnesses[leaf] += step
        parent = sha256("".join(d.hex() for d, _, _ in run).encode()).digest()
        self._push(level + 1, parent, run[0][1], run[-1][2])

    def close(self) -> bytes | None:
        """The root, after the runs that are still open have ended as they are."""
        for level in range(self.height):
            if self.open[level]:
                self._complete(level)
        return self.root


def folded(leaf: bytes, *witnesses: bytes) -> tuple[str, str]:
    """(root that follows from a leaf and its witness, SHA-256 of the witness's siblings), both as hex text."""
    digest, proof = leaf.hex(), sha256()
    for w in witnesses:
        at = 0
        while at < len(w):
            place, size = w[at], w[at + 1]
            end = at + 2 + 32 * (size - 1)
            siblings = w[at + 2:end].hex()
            proof.update(siblings.encode())
            digest = sha256((siblings[:64 * place] + digest + siblings[64 * place:]).encode()).hexdigest()
            at = end
    return digest, proof.hexdigest()


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in ``order`` within ``group``) and ``n`` (rows of the group); group is not null."""
    row = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "unordered")  # spreads equal keys
    keys = [group, *order, "__row"]
    dealt = row.repartitionByRange(*[F.asc_nulls_first(k) for k in keys]).sortWithinPartitions(
        *[F.asc_nulls_first(k) for k in keys])
    dealt = materialize(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
                        .drop("__row"), "ordered")
    parts = dealt.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    in_group = Window.partitionBy(group)  # as many rows as ranges
    before = in_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
                         F.sum("__n").over(in_group).alias("n"))
    return dealt.join(parts, [group, "__part"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop(
        "__part", "__at", "__shift")


def appended(nodes: DataFrame, block_height: int = BLOCK_HEIGHT) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Streams ``nodes`` (g, n, pos, digest binary) in blocks, then their block roots, until each g has one.

    Gives the nodes with block and witness, the one root of each g (g, digest),
    and for each round of block roots those with block and witness.
    """
    size = ARITY ** block_height
    carried = [f for f in nodes.schema.fields if f.name not in ("pos", "digest", "n")]
    schema = T.StructType([*carried, T.StructField("pos", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("block", T.LongType()),
                           T.StructField("witness", T.BinaryType()), T.StructField("root", T.BinaryType())])
    order = schema.fieldNames()

    def stream(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        total = table.column("n")[0].as_py()
        tree = WitnessStream(min(block_height, height(total)))
        for d in table.column("digest").to_pylist():
            tree.append(d)
        root = tree.close()
        rows = len(table)
        new = {"witness": pa.array([bytes(w) for w in tree.witnesses], pa.binary()),
               "root": pa.array([None] * (rows - 1) + [root], pa.binary())}
        return pa.table([new[c] if c in new else table.column(c) for c in order], names=order)

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    done = materialize(blocks.groupBy("g", "block").applyInArrow(stream, schema), "witnesses")
    roots = done.where(F.col("root").isNotNull()).select(
        "g", F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("block").alias("pos"), F.col("root").alias("digest"))
    if not roots.where("n > 1").limit(1).count():
        return done.drop("root"), roots.select("g", "digest"), []
    upper, top, more = appended(roots, block_height)
    return done.drop("root"), top, [upper, *more]


def manifest(leaves: DataFrame, key: str = "key", group: str = "group", digest: str = "leaf",
             block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """``leaves`` with subroot, root (hex text), witness and block_witness (binary; a leaf's witness is one after the other).

    ``group`` is a string column, ``digest`` the leaf's hex digest; other columns are carried along.
    """
    # an order-keeping key that is never null: "-" comes before "=..."
    g = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-"))
    rows = leaves.select(*[F.col(f"`{c}`") for c in leaves.columns], g.alias("g"), F.unhex(digest).alias("digest"))
    nodes, tops, rounds = appended(numbered(rows, "g", [key, "digest"]), block_height)
    # subroots are the leaves of the last tree
    named = tops.select(F.lit("").alias("all"), F.col("g").alias("of"), "digest")
    last, root, last_rounds = appended(numbered(named.withColumnRenamed("all", "g"), "g", ["of"]), block_height)
    above = _with_upper(last, last_rounds).select(F.col("of").alias("g"), F.col("digest").alias("subroot"), "g_witness")
    only = root.select("digest").first()  # the one root
    above = above.withColumn("root", F.lit(only["digest"] if only else None).cast("binary"))
    # the groups' witnesses join the highest round, so that a large group's leaves meet them by block
    blocks = _blocks_of(nodes, rounds).join(above, "g").withColumn("block_witness", F.concat("block_witness", "g_witness"))
    out = nodes.join(blocks.drop("g_witness"), ["g", "block"])
    return out.select(*[F.col(f"`{c}`") for c in leaves.columns], F.lower(F.hex("subroot")).alias("subroot"),
                      F.lower(F.hex("root")).alias("root"), "witness", "block_witness")


def _with_upper(nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``nodes`` with g_witness: their whole witness up to the one root of g."""
    blocks = _blocks_of(nodes, rounds)
    return nodes.join(blocks, ["g", "block"]).withColumn("g_witness", F.concat("witness", "block_witness"))


def _blocks_of(nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """g, block, block_witness of every block of ``nodes``."""
    if not rounds:  # each g is one block
        return nodes.select("g", "block").distinct().withColumn("block_witness", F.lit(b""))
    return _with_upper(rounds[0], rounds[1:]).select("g", F.col("pos").alias("block"), F.col("g_witness").alias("block_witness"))


def verified(rows: DataFrame, digest: str) -> DataFrame:
    """``rows`` of a manifest with proof_sha256, folded_root (from the hex ``digest``) and verified, without the witnesses."""
    kept = [c for c in rows.columns if c not in ("witness", "block_witness")]
    schema = T.StructType([rows.schema[c] for c in kept] + [
        T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType()),
        T.StructField("verified", T.BooleanType())])

    def fold(batches):
        for b in batches:
            results = [folded(bytes.fromhex(d), w, u) for d, w, u in zip(
                *(b.column(c).to_pylist() for c in (digest, "witness", "block_witness")))]
            roots, proofs = [r for r, _ in results], [p for _, p in results]
            ok = [r == x for r, x in zip(roots, b.column("root").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array(proofs, pa.string()), pa.array(roots, pa.string()), pa.array(ok, pa.bool_())],
                names=[*kept, "proof_sha256", "folded_root", "verified"])

    return rows.mapInArrow(fold, schema)


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Where 3 divides crc32 of the decimal doc_id, the folded leaf is that of the lower-cased text.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = leaf_digest(*[F.col(c) for c in columns])
    changed = leaf_digest(*[F.col(c) for c in columns[:-1]], lower_ascii(F.col("text")))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    leaves = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf.alias("leaf"),
                         F.when(hit, changed).otherwise(leaf).alias("checked_leaf"))
    found = manifest(leaves, "doc_id", "lang", "leaf")
    return verified(found.drop("lang"), "checked_leaf").drop("checked_leaf")
