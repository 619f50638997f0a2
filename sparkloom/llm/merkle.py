"""Merkle manifest of a dataset: a tree over each group's rows in order, a tree over the groups, and proofs for every row.

``H`` is the lowercase hex SHA-256 of its inputs, concatenated; digests enter as hex text. A row's leaf is H of its fields, each ``-`` if null,
else its UTF-8 length, a colon and its value. Rows of a group ascend by key; every ``fanout`` consecutive nodes become their H, and a last run
of fewer nodes is hashed as it is, without padding, until one is left, the group's subroot. Subroots, ordered by group (null first, bytewise),
give the root in the same way. Node ``i`` of level ``l`` stands for the leaves from ``i * fanout**l`` on.

How it is computed:

1. leaves, the only pass over the texts, are positioned by range, counts and offsets (``operators.numbering``);
2. each task runs through its contiguous leaves with a mountain-range stack: a leaf that completes a run of ``fanout`` nodes carries, as in a
   counter with that base. Completed nodes are records of the manifest; what cannot be completed, because its run began or goes on
   elsewhere, stays as the interval's peaks, at most 2 (fanout - 1) a level;
3. peaks of all intervals meet in aligned blocks of some 4,096 leaves, then of 4,096 such blocks, and so on, where the same stack goes on.
   Each block gets few rows, however the intervals were cut. The group's size is known, so short runs are completed where they end;
4. proofs: aligned blocks of some 8,192 leaves recompute their own nodes and get the siblings above from the records, once a block.

Rows that repeat a key are ordered by leaf. Null keys come first. A row whose key or group is null is a row like others. An empty table has no rows and no
root. Extra columns, also such whose names differ only in case, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace, partitions_for, plain, tidy
from sparkloom.operators.numbering import running

BLOCK, MEET = 8192, 4096
NODE = "g string, n long, level int, idx long, hash binary, peak boolean"


def H(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf_of(fields: Sequence[Column]) -> Column:
    """The leaf of a row as 32 bytes."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def levels_in(leaves: int, fanout: int) -> int:
    """The level whose nodes stand for at most ``leaves`` leaves, 1 at least."""
    k = 1
    while fanout ** (k + 1) <= leaves:
        k += 1
    return k


def width(n: int, level: int, fanout: int) -> int:
    return -(-n // fanout**level)


class MountainRange:
    """Nodes pushed in the order of their places; runs that are complete carry. ``peaks()`` is what is left."""

    def __init__(self, n: int, fanout: int):
        self.n, self.fanout, self.rows = n, fanout, []
        self.widths: list[int] = []

    def push(self, level: int, idx: int, digest: bytes) -> Iterator[tuple[int, int, bytes]]:
        """The nodes that this one completes."""
        while True:
            while len(self.rows) <= level:
                self.widths.append(width(self.n, len(self.rows), self.fanout))
                self.rows.append([])
            row, many = self.rows[level], self.widths[level]
            row.append((idx, digest))
            first = idx - idx % self.fanout
            last = min(first + self.fanout, many) - 1
            size = last - first + 1
            if many == 1 or idx != last or len(row) < size or row[-size][0] != first:
                return
            digest = H(*[d for _, d in row[-size:]])
            del row[-size:]
            level, idx = level + 1, idx // self.fanout
            yield level, idx, digest

    def peaks(self) -> Iterator[tuple[int, int, bytes]]:
        for level, row in enumerate(self.rows):
            for idx, digest in row:
                yield level, idx, digest


class _Records:
    """Rows of NODE, given out by thousands."""

    def __init__(self):
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[]] * 6
        self.rows = []
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["g", "n", "level", "idx", "hash", "peak"])


def climb(fanout: int):
    """For mapInArrow over (g, n, pos, leaf), sorted by (g, pos) in each contiguous interval: records and peaks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, hill, at = _Records(), None, (None, None, None)
        for b in batches:
            for g, n, pos, leaf in zip(*[b.column(c).to_pylist() for c in ("g", "n", "pos", "leaf")], strict=True):
                if (g, n, pos) != at:
                    if hill is not None:
                        out.rows += [(at[0], at[1], *p, True) for p in hill.peaks()]
                    hill = MountainRange(n, fanout)
                out.rows += [(g, n, *x, False) for x in hill.push(0, pos, leaf)]
                at = (g, n, pos + 1)
            if len(out.rows) >= 5000:
                yield out.batch()
        if hill is not None:
            out.rows += [(at[0], at[1], *p, True) for p in hill.peaks()]
        yield out.batch()

    return rows


def meet(fanout: int):
    """For applyInArrow over the peaks of a block: the nodes that they complete together, and the peaks that are left."""

    def block(peaks: pa.Table) -> pa.Table:
        rows = sorted(zip(*[peaks.column(c).to_pylist() for c in ("level", "idx", "hash")], strict=True), key=lambda r: r[1] * fanout ** r[0])
        g, n = peaks.column("g")[0].as_py(), peaks.column("n")[0].as_py()
        hill, out = MountainRange(n, fanout), _Records()
        for r in rows:
            out.rows += [(g, n, *x, False) for x in hill.push(*r)]
        out.rows += [(g, n, *p, True) for p in hill.peaks()]
        return pa.Table.from_batches([out.batch()])

    return block


def forest(ws: Workspace, placed: DataFrame, most: int, fanout: int, name: str, together: int = MEET) -> tuple[DataFrame, DataFrame]:
    """nodes (g, level, idx, hash; leaves are not among them) and tops (g, n, hash) of the trees over ``placed`` (g, n, pos, leaf), of ``most`` leaves at most."""
    made = ws.write(placed.select("g", "n", "pos", "leaf").mapInArrow(tidy(climb(fanout)), NODE), f"{name}-climbed")
    nodes, peaks = [made.where("NOT peak")], made.where("peak")
    step = levels_in(together, fanout)
    level = 0
    while fanout**level < most:
        level += step
        start = F.expr(f"CAST(idx DIV CAST({fanout ** level} / power({fanout}, level) AS BIGINT) AS BIGINT)")
        low = peaks.where(F.col("level") < level)
        met = low.groupBy("g", start.alias("_block")).applyInArrow(meet(fanout), NODE)
        met = ws.write(met, f"{name}-met-{level}")
        nodes.append(met.where("NOT peak"))
        peaks = peaks.where(F.col("level") >= level).unionByName(met.where("peak"))
    every = nodes[0]
    for x in nodes[1:]:
        every = every.unionByName(x)
    return every.select("g", "level", "idx", "hash"), peaks.select("g", "n", "hash")


@dataclass
class Manifest:
    """leaves: group, key, g, n, pos, leaf, other; nodes and tops as of :func:`forest`, for the rows and for the groups; root: one row, ``root``."""

    workspace: Workspace
    fanout: int
    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    group_leaves: DataFrame
    group_nodes: DataFrame
    root: DataFrame


def manifest(spark: SparkSession, docs: DataFrame, fields: Sequence[str], key: str, by: str, fanout: int = 2, changed: dict[str, Column] | None = None, when: Column | None = None, together: int = MEET) -> Manifest:
    """The manifest of ``docs``. Where ``when`` holds, ``other`` is the leaf of the row with the columns ``changed``, for tests of proofs."""
    ws = Workspace(spark, "merkle")
    rows = plain(docs, *dict.fromkeys([*fields, key, by]))
    own = leaf_of([F.col(c) for c in fields])
    other = F.when(when, leaf_of([(changed or {}).get(c, F.col(c)) for c in fields])) if when is not None else F.lit(None).cast("binary")
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))  # never null, in the same order
    leaves = ws.write(rows.select(group.alias("g"), F.col(by).alias("group"), F.col(key).alias("key"), own.alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("_row")), "leaves")
    order = [F.asc_nulls_first("key"), F.col("leaf"), F.col("_row")]
    placed = running(leaves, order, "pos", by=["g"], total="n", parts=partitions_for(spark, docs), write=lambda df: ws.write(df, "sorted"))
    placed = ws.write(placed.sortWithinPartitions("g", "pos").drop("_row"), "placed")
    most = placed.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    nodes, tops = forest(ws, placed, most, fanout, "rows", together)
    tops = ws.write(tops, "tops")
    over = running(tops.select(F.col("g").alias("_of"), F.col("hash").alias("leaf")), [F.col("_of")], "pos", total="n", write=lambda df: ws.write(df, "groups-sorted"))
    over = ws.write(over.select(F.lit("").alias("g"), "_of", "n", "pos", "leaf").sortWithinPartitions("pos"), "groups")
    group_nodes, top = forest(ws, over, over.count(), fanout, "groups", together)
    return Manifest(ws, fanout, placed, nodes, tops, over, group_nodes, top.select(F.col("hash").alias("root")))


# ---------------------------------------------------------------- proofs


def siblings(starts: DataFrame, nodes: DataFrame, level: int, fanout: int, depth: int) -> DataFrame:
    """g, idx, path of the nodes ``starts`` (g, n, idx) of a level: for each level from there to the top, the place in the run and the others' digests.

    path: array of (level, place, others), ascending; ``others`` are joined digests.
    """
    at = F.explode(F.sequence(F.lit(level), F.lit(max(level, depth - 1)))).alias("level")
    step = starts.select("g", "n", "idx", at).select("*", F.expr(f"CAST(idx DIV CAST(power({fanout}, level - {level}) AS BIGINT) AS BIGINT)").alias("_own"), F.expr(f"CAST(ceil(n / power({fanout}, level)) AS BIGINT)").alias("_many")).where("_many > 1")
    first = F.col("_own") - F.col("_own") % fanout
    others = F.explode(F.sequence(first, F.least(first + fanout, F.col("_many")) - 1))
    asked = step.select("g", F.col("idx").alias("_start"), "level", (F.col("_own") % fanout).cast("int").alias("place"), "_own", others.alias("idx"))
    own = F.col("idx") == F.col("_own")
    found = asked.where(~own).join(nodes.where(F.col("level") >= level), ["g", "level", "idx"]).select("g", "_start", "level", "place", "idx", "hash")
    alone = asked.where(own).select("g", "_start", "level", "place", F.lit(-1).cast("long").alias("idx"), F.lit(b"").alias("hash"))  # runs of one have no others
    rows = found.unionByName(alone).groupBy("g", "_start").agg(F.array_sort(F.collect_list(F.struct("level", "place", "idx", "hash"))).alias("path"))
    return starts.select("g", "idx").join(rows.withColumnRenamed("_start", "idx"), ["g", "idx"], "left")


def _path(rows: list[dict] | None) -> list[tuple[int, list[bytes]]]:
    out: dict[int, tuple[int, list[bytes]]] = {}
    for r in rows or []:
        out.setdefault(r["level"], (r["place"], []))
        if r["idx"] >= 0:
            out[r["level"]][1].append(r["hash"])
    return [out[k] for k in sorted(out)]


PROOF = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(fanout: int, block_level: int):
    """For a cogroup of a block's leaves with the one row of what stands above it."""

    def block(leaves: pa.Table, above: pa.Table) -> pa.Table:
        rows = sorted(zip(*[leaves.column(c).to_pylist() for c in ("pos", "key", "leaf", "other")], strict=True), key=lambda r: r[0])
        up = above.to_pylist()[0]
        n, subroot, root = up["n"], up["subroot"].hex(), up["root"].hex()
        higher = [(k, [x.hex() for x in d]) for k, d in [*_path(up["path"]), *_path(up["over"])]]
        # the block's own nodes, as hex, and where each level starts
        start, grid, level = rows[0][0], [[r[2].hex() for r in rows]], 0
        begin = [start]
        while level < block_level and width(n, level, fanout) > 1:
            low = grid[-1]
            grid.append([hashlib.sha256("".join(low[i : i + fanout]).encode()).hexdigest() for i in range(0, len(low), fanout)])
            begin.append(begin[-1] // fanout)
            level += 1
        rest = "".join(x for _, others in higher for x in others)
        tails = [rest] * len(grid[-1])  # of each node, the siblings from its level on
        for k in range(level - 1, 0, -1):
            row = grid[k]
            tails = ["".join(row[j - j % fanout : j]) + "".join(row[j + 1 : j - j % fanout + fanout]) + tails[j // fanout] for j in range(len(row))]
        out = []
        for i, (_, key, leaf, other) in enumerate(rows):
            if level:
                row, run = grid[0], i - i % fanout
                proof = "".join(row[run:i]) + "".join(row[i + 1 : run + fanout]) + tails[i // fanout]
            else:
                proof = rest
            digest, j = (leaf if other is None else other).hex(), i
            for k in range(level):
                row, run = grid[k], j - j % fanout
                digest = hashlib.sha256(("".join(row[run:j]) + digest + "".join(row[j + 1 : run + fanout])).encode()).hexdigest()
                j //= fanout
            for place, others in higher:
                digest = hashlib.sha256("".join([*others[:place], digest, *others[place:]]).encode()).hexdigest()
            out.append((key, leaf.hex(), subroot, root, hashlib.sha256(proof.encode()).hexdigest(), digest, digest == root))
        names = [x.split()[0] for x in PROOF.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return block


def proofs(m: Manifest, block: int = BLOCK) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    ws, f = m.workspace, m.fanout
    level = levels_in(block, f)
    size = f**level
    depth = lambda n: next(k for k in range(400) if width(n, k, f) <= 1)
    most, groups = m.tops.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    blocks = m.tops.select("g", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"CAST((n - 1) DIV {size} AS BIGINT)"))).alias("idx"))
    lower = siblings(blocks, m.nodes, level, f, depth(most)).select("g", F.col("idx").alias("block"), "path")
    nodes = m.group_nodes.unionByName(m.group_leaves.select("g", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash")))
    over = siblings(m.group_leaves.select("g", "n", F.col("pos").alias("idx")), nodes, 0, f, depth(groups))
    over = m.group_leaves.select("_of", F.col("pos").alias("idx")).join(over.drop("g"), "idx").select(F.col("_of").alias("g"), F.col("path").alias("over"))
    tops = m.tops.select("g", "n", F.col("hash").alias("subroot")).join(over, "g")
    above = ws.write(lower.join(tops, "g").crossJoin(F.broadcast(m.root)), "above")  # a row a block; the root is one row
    leaves = m.leaves.select("g", F.expr(f"CAST(pos DIV {size} AS BIGINT)").alias("block"), "pos", "key", "leaf", "other")
    return leaves.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(prove(f, level), PROOF)


def document_proofs(spark: SparkSession, docs: DataFrame, fanout: int = 2, every: int = 7, block: int = BLOCK, together: int = MEET) -> DataFrame:
    """Proofs of ``documents``, by language and doc_id; where ``every`` divides the CRC-32 of a decimal doc_id, one is added to n_chars."""
    m = manifest(spark, docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", fanout, {"n_chars": F.col("n_chars") + 1}, F.crc32(F.col("doc_id").cast("string")) % every == 0, together)
    return proofs(m, block).withColumnRenamed("key", "doc_id")
