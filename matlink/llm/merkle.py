"""Merkle manifest of a dataset: a hash tree a group, a root above the groups, proofs of every row.

Leaves get their places by a range partitioning on (group, id, leaf) and the sizes of its
partitions. Each aligned block of fanout**depth nodes then is one group of a Spark job: its hex
digests are one contiguous numpy matrix of 64 bytes a row, that is reshaped to runs of fanout rows
and hashed run by run, level by level. Only the top digest of a block goes on, so the next stage
has as many times fewer nodes, until each tree has one. Proofs come down the same stages: a
block's siblings are slices of its levels, found by index arithmetic, and the path above a block is
joined to it. No task holds more than a block, whatever the size of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matlink.llm.common import cut

FANOUT, DEPTH = 8, 4
_HEX = 64
#: Rows of a range partition, near.
_PART_ROWS = 1 << 20
_NODE = "tree string, ref string, node string, place long, total long"
_PATH = "tree string, ref string, place long, path binary, subroot string"


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def field(value: Column) -> Column:
    """A value's part of a leaf: - for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def _levels(total: int, fanout: int, depth: int) -> int:
    """Levels that a block climbs: depth, or as many as the whole tree has left."""
    levels = 0
    while total > 1 and levels < depth:
        total, levels = -(-total // fanout), levels + 1
    return levels


def reduce_levels(leaves: np.ndarray, levels: int, fanout: int) -> list[np.ndarray]:
    """All levels of a block, from its (n, 64) matrix of hex digests to its top."""
    out = [leaves]
    for _ in range(levels):
        now = out[-1]
        full = len(now) // fanout
        runs = now[: full * fanout].reshape(full, fanout * _HEX)
        made = [hashlib.sha256(r).hexdigest() for r in runs]
        if full * fanout < len(now):
            made.append(hashlib.sha256(now[full * fanout :].tobytes()).hexdigest())
        out.append(np.frombuffer("".join(made).encode(), np.uint8).reshape(-1, _HEX))
    return out


def _matrix(table: pa.Table, column: str = "node") -> np.ndarray:
    return np.frombuffer("".join(table[column].to_pylist()).encode(), np.uint8).reshape(-1, _HEX)


def siblings(levels: list[np.ndarray], at: int, fanout: int) -> Iterator[tuple[bytes, bytes]]:
    """What stands left and right of leaf number at, level by level, in its run."""
    for level in levels[:-1]:
        run = at // fanout * fanout
        yield level[run:at].tobytes(), level[at + 1 : run + fanout].tobytes()
        at //= fanout


def pack_path(path: list[tuple[bytes, bytes]]) -> bytes:
    """Pairs of siblings as bytes: their numbers, then their digests, level by level."""
    return b"".join(bytes([len(a) // _HEX, len(b) // _HEX]) + a + b for a, b in path)


def unpack_path(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(data):
        a, b = at + 2 + _HEX * data[at], at + 2 + _HEX * (data[at] + data[at + 1])
        out.append((data[at + 2 : a], data[a:b]))
        at = b
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = _sha(left + leaf + right)
    return leaf


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, their number within their tree in this order, and total, the rows of the tree."""
    rows = cut(rows)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // _PART_ROWS), 1)
    keys = [F.col(c) for c in ("tree", *order)]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("part"), index.alias("index")))
    sizes = dealt.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("index").alias("low"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    placed = dealt.join(sizes, ["tree", "part"])
    return cut(placed.select(*rows.columns, (F.col("index") + F.col("shift")).cast("long").alias("place"), F.col("total").cast("long").alias("total")))


def _climb(placed: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """The stages of all trees: placed nodes, the tops of their blocks, and so on to one node a tree."""
    block = fanout**depth

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        total, place = table["total"][0].as_py(), table["place"][0].as_py()
        levels = _levels(total, fanout, depth)
        node = reduce_levels(_matrix(table), levels, fanout)[-1].tobytes().decode()
        rows = {"tree": table["tree"][:1], "ref": [None], "node": [node], "place": [place // block], "total": [max(1, -(-total // fanout**levels))]}
        return pa.table(rows, schema=pa.schema([("tree", pa.string()), ("ref", pa.string()), ("node", pa.string()), ("place", pa.int64()), ("total", pa.int64())]))

    stages = [placed]
    while (stages[-1].agg(F.max("total")).first()[0] or 1) > 1:
        now = stages[-1].select("tree", "node", "place", "total", F.expr(f"place div {block}").alias("block"))
        stages.append(cut(now.groupBy("tree", "block").applyInArrow(top, _NODE)))
    return stages


def _down(stages: list[DataFrame], above: DataFrame, fanout: int, depth: int, finish, kind: str) -> DataFrame:
    """finish(table of a block, its levels, path above, subroot) of each block of the first stage.

    above: (tree, path, subroot) of the trees' tops. Subroots travel with the paths, one a block.
    """
    block = fanout**depth

    def joined(stage: DataFrame, paths: DataFrame, each, kind: str) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by("place")
            levels = reduce_levels(_matrix(left), _levels(left["total"][0].as_py(), fanout, depth), fanout)
            return each(left, levels, unpack_path(right["path"][0].as_py()), right["subroot"][0].as_py())

        rows = stage.withColumn("block", F.expr(f"place div {block}"))
        return rows.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(run, kind)

    def paths_of(table: pa.Table, levels: list[np.ndarray], path: list, subroot: str | None) -> pa.Table:
        made = [pack_path([*siblings(levels, i, fanout), *path]) for i in range(len(table))]
        return pa.table({"tree": table["tree"], "ref": table["ref"], "place": table["place"], "path": pa.array(made, pa.binary()), "subroot": pa.array([subroot] * len(table), pa.string())})

    now = above.select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
    for stage in reversed(stages[1:-1]):
        now = cut(joined(stage, now, paths_of, _PATH)).select("tree", F.col("place").alias("block"), "path", "subroot")
    return joined(stages[0], now, finish or paths_of, kind if finish else _PATH)


@dataclass(frozen=True)
class Manifest:
    """root: of the dataset, None for no rows; subroots: (grp, subroot) by group; rows: proofs of all rows."""

    root: str | None
    subroots: DataFrame
    rows: DataFrame


def manifest(docs: DataFrame, group_col: str, id_col: str, leaf: Column, claimed: Column | None = None, fanout: int = FANOUT, depth: int = DEPTH, with_paths: bool = False) -> Manifest:
    """Hash trees of the rows of docs, one a value of group_col, and a root above them.

    Leaves ascend by id in their group; groups ascend bytewise, null first. While a tree has
    several nodes, each fanout consecutive ones (the last run: fewer) become their hash.
    leaf: hex digest of a row; claimed: digest that is to be verified in its place, null where it is
    the leaf itself. rows: id_col, leaf, subroot, root, proof_sha256 (of the siblings from the leaf
    to the root), folded_root (of claimed and these siblings), verified (is that the root); with_paths
    adds path, the siblings themselves (see unpack_path).

    Null ids come first in their group; rows of equal ids ascend by leaf, and equal rows may change
    places. An empty table has a root of None and no rows. Other columns of docs are ignored.
    """
    group = F.col(group_col).cast("string")
    tree = F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group))  # "-" comes before "="
    rows = docs.select(tree.alias("tree"), F.lit(None).cast("string").alias("ref"), F.col(id_col).cast("long").alias("id"), leaf.alias("node"), (F.lit(None) if claimed is None else claimed).cast("string").alias("claimed"))
    stages = _climb(_placed(rows, ["id", "node"]), fanout, depth)
    subs = stages[-1].select("tree", "node")
    tops = _climb(_placed(subs.select(F.lit("").alias("tree"), F.col("tree").alias("ref"), "node"), ["ref"]), fanout, depth)
    top = tops[-1].select("node").first()
    root = top[0] if top else None
    start = tops[-1].select("tree", F.lit(b"").alias("path"), F.lit(None).cast("string").alias("subroot"))
    above = _down(tops, start, fanout, depth, None, _PATH).select(F.col("ref").alias("tree"), "path")
    above = cut(above.join(subs.withColumnRenamed("node", "subroot"), "tree"))
    known = (root or "").encode()
    schema = pa.schema([("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("path", pa.binary())])

    def prove(table: pa.Table, levels: list[np.ndarray], path: list, subroot: str) -> pa.Table:
        proofs, folded, packed = [], [], []
        rest = b"".join(a + b for a, b in path)
        for i, (leaf, claim) in enumerate(zip(table["node"].to_pylist(), table["claimed"].to_pylist(), strict=True)):
            own = list(siblings(levels, i, fanout))
            proofs.append(hashlib.sha256(b"".join([*(a + b for a, b in own), rest])).hexdigest())
            folded.append(fold((claim or leaf).encode(), [*own, *path]).decode())
            packed.append(pack_path([*own, *path]) if with_paths else None)
        columns = [table["id"], table["node"], [subroot] * len(table), proofs, folded, [f.encode() == known for f in folded], packed]
        return pa.table([c.cast(t) if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    done = _down(stages, above, fanout, depth, prove, "id long, leaf string, subroot string, proof_sha256 string, folded_root string, verified boolean, path binary")
    columns = [F.col("id").alias(id_col), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", "verified", *(["path"] if with_paths else [])]
    grp = F.when(F.col("tree") != "-", F.expr("substring(tree, 2)"))
    return Manifest(root, subs.select(grp.alias("grp"), F.col("node").alias("subroot")), done.select(*columns))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, where a third of them is verified with changed letters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["doc_id", "source", "lang", "n_chars"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    values = [F.col(c) for c in names]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claimed = F.when(changed, leaf_hash([*values, lower]))
    return manifest(docs, "lang", "doc_id", leaf_hash([*values, F.col("text")]), claimed).rows
