"""Merkle manifest of a table by butterfly exchange (operator 11).

Leaves are hashed by column expressions in one scan; from then on only digests
move.  Within each group (language) they are ranked by id, and ranks are cut
into aligned blocks of ``fanout ** LOCAL_LEVELS`` leaves, each of which one task
folds to its subtree root.  The blocks then exchange roots in rounds: in
round r a block holds the root of its own subtree of ``fanout ** r`` blocks and
swaps it with the blocks at the same place of the sibling subtrees in
its aligned run.  Each of them hashes the common parent for itself and appends the
siblings it was sent to its path, so after the last round every block knows the
group's root and all its upper proofs, and nothing is passed down.  At the
right edge, where the last subtree of a run holds only m blocks, its block l
serves the places l, l + m, l + 2m and so on.  The group roots form the leaves of one more
tree, built by the same function.

Digests are lower-case hex SHA-256 of the concatenated hex texts of the parts.

Defined cases: a null column contributes ``-``; a null id sorts first; rows of one
id are ordered by leaf, so repeated rows are leaves of their own with equal
digests; a null group sorts before all; a row with a null id is never tampered
with; a group of one leaf has that leaf as its root, and a table of one row
the empty proof; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lowrank.llm.common import by_value, numbered_rows, read_table, save_table

by_value(__name__)

FANOUT = 8
LOCAL_LEVELS = 4                   # a block holds at most 8^4 leaves: 260 kB of digests
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<left:string,right:string>"


def _part(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(_part, columns)), 256)


def leaves(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS,
           text_col: str = "text") -> DataFrame:
    """(group, id, leaf, shown): ``shown`` is the leaf of the tampered row where
    3 divides the CRC-32 of the id, whose text is lower-cased, else the leaf itself."""
    own = [F.col(c) for c in columns]
    changed = [F.translate(c, UPPER, LOWER) if n == text_col else c for n, c in zip(columns, own)]
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 0, F.lit(False))
    return docs.select(F.col(group_col).alias("group"), F.col(id_col).cast("long").alias("id"),
                       leaf_digest(own).alias("leaf"), F.when(hit, leaf_digest(changed)).otherwise(leaf_digest(own)).alias("shown"))


def _height(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def _join(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes: list[str], height: int, fanout: int) -> list[list[str]]:
    """Nodes of each level from the leaves up, ``height`` levels above them."""
    out = [nodes]
    for _ in range(height):
        nodes = [_join(nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def _block_root(fanout: int, local: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.sort_by("slot")
        height = min(local, _height(rows.column("total")[0].as_py(), fanout))
        root = _levels(rows.column("leaf").to_pylist(), height, fanout)[-1][0]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()),
                         pa.array([rows.column("total")[0].as_py()], pa.int64()), pa.array([root])],
                        names=["g", "block", "total", "node"])
    return run


def butterfly(blocks: DataFrame, size: int, fanout: int = FANOUT) -> DataFrame:
    """(g, block, node, path): from each block's own root (g, block, total,
    node) to its group's root and the siblings on the way, by rounds of
    exchange.  ``total`` is the number of leaves, ``size`` the leaves of a full block."""
    most = blocks.agg(F.max("total")).first()[0] or 0
    count = F.ceil(F.col("total") / F.lit(size)).cast("long")      # blocks of the group
    state = blocks.withColumn("path", F.lit(None).cast(f"array<{STEP}>"))
    stride = 1
    for _ in range(_height(-(-most // size), fanout)):
        subtree, low = F.floor(F.col("block") / stride), F.col("block") % stride
        held = F.least(F.lit(stride), count - subtree * stride)    # blocks of the own subtree
        run = F.floor(subtree / fanout) * fanout
        place = subtree - run
        siblings = F.sequence(run, F.least(run + fanout, F.ceil(count / stride)) - 1)
        # To a sibling subtree t of m blocks go the messages for its blocks l, l + held, ... below m.
        there = F.flatten(F.transform(siblings, lambda t: F.when(t == subtree, F.array("block")).otherwise(
            F.transform(F.filter(F.sequence(low, F.lit(stride - 1), held), lambda x: t * stride + x < count), lambda x: t * stride + x))))
        sent = state.where(count > stride).select(
            "g", "total", place.alias("place"), "node", F.col("block").alias("source"), F.explode(there).alias("block"),
            "path")
        mine = F.col("source") == F.col("block")
        run_of = F.array_sort(F.collect_list(F.struct("place", "node")))
        got = (sent.groupBy("g", "total", "block")
               .agg(run_of.alias("run"), F.max(F.when(mine, F.col("place"))).alias("own"),
                    F.first(F.when(mine, F.col("path")), ignorenulls=True).alias("path")))

        def text(keep) -> Column:
            return F.array_join(F.transform(F.filter("run", keep), lambda x: x["node"]), "")

        step = F.struct(text(lambda x: x["place"] < F.col("own")).alias("left"), text(lambda x: x["place"] > F.col("own")).alias("right"))
        risen = got.select("g", "block", "total", F.sha2(text(lambda x: F.lit(True)), 256).alias("node"),
                           F.concat(F.coalesce("path", F.array().cast(f"array<{STEP}>")), F.array(step)).alias("path"))
        state = save_table(risen.unionByName(state.where(count <= stride)), "butterfly")
        stride *= fanout
    return state.withColumn("path", F.coalesce("path", F.array().cast(f"array<{STEP}>")))


def _fold(node: str, path) -> str:
    for left, right in path:
        node = _join([left, node, right])
    return node


def _local_paths(levels: list[list[str]], fanout: int) -> Iterator[list[tuple[str, str]]]:
    """(left, right) siblings of each leaf, level by level below the last."""
    for i in range(len(levels[0])):
        path = []
        for level in levels[:-1]:
            first = i - i % fanout
            path.append(("".join(level[first:i]), "".join(level[i + 1:first + fanout])))
            i //= fanout
        yield path


def _prove(fanout: int, local: int):
    """Proofs of the leaves of one block from its leaves and its upper path."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by("slot")
        block = right.to_pylist()[0]
        upper = [(s["left"], s["right"]) for s in block["path"]]
        above = "".join(a + b for a, b in upper)
        nodes = rows.column("leaf").to_pylist()
        levels = _levels(nodes, min(local, _height(block["total"], fanout)), fanout)
        proofs, folded = [], []
        for path, shown in zip(_local_paths(levels, fanout), rows.column("shown").to_pylist()):
            proofs.append(_join([a + b for a, b in path] + [above]))
            folded.append(_fold(shown, path + upper))
        n, root = len(nodes), block["root"]
        return pa.table([rows.column("id"), rows.column("leaf"), pa.array([block["subroot"]] * n), pa.array([root] * n),
                         pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])],
                        names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return run


def _group_paths(fanout: int, local: int):
    """Paths above the groups of one block of the top tree."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by("slot")
        block = right.to_pylist()[0]
        nodes = rows.column("leaf").to_pylist()
        levels = _levels(nodes, min(local, _height(block["total"], fanout)), fanout)
        out = [[{"left": a, "right": b} for a, b in path] + block["path"] for path in _local_paths(levels, fanout)]
        n = len(nodes)
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table([rows.column("pos"), pa.array(nodes), pa.array([block["node"]] * n), pa.array(out, kind)],
                        names=["g", "subroot", "root", "above"])
    return run


def _tree(ranked: DataFrame, fanout: int, local: int) -> DataFrame:
    """Blocks (g, block, total, node, path) of ranked leaves (g, pos, total, leaf)."""
    size = fanout ** local
    cut = ranked.select("g", F.floor(F.col("pos") / size).alias("block"), (F.col("pos") % size).alias("slot"), "total", "leaf")
    roots = cut.groupBy("g", "block").applyInArrow(_block_root(fanout, local), "g long, block long, total long, node string")
    return butterfly(save_table(roots, "merkle-blocks"), size, fanout)


def manifest(table: DataFrame, fanout: int = FANOUT, local: int = LOCAL_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of
    the rows of ``leaves``."""
    size = fanout ** local
    table = save_table(table, "merkle-leaves")
    # Groups get numbers by order; their roots are ranked by these at the end.
    groups = numbered_rows(table.groupBy("group").agg(F.count("*").alias("total")), [], ["group"], "merkle-groups")
    groups = save_table(groups.select("group", F.col("pos").alias("g"), "total"), "merkle-group-numbers")
    ranked = (numbered_rows(table, ["group"], ["id", "leaf"], "merkle-ranked")
              .join(groups.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of")))
              .select("g", "pos", "total", "id", "leaf", "shown"))
    ranked = save_table(ranked, "merkle-places")
    blocks = save_table(_tree(ranked, fanout, local), "merkle-paths")
    n_groups = groups.agg(F.count("*")).first()[0]
    subroots = blocks.where("block = 0").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"),
                                                F.lit(n_groups).cast("long").alias("total"), F.col("node").alias("leaf"))
    top = save_table(subroots, "merkle-subroots")
    tops = _tree(top, fanout, local)
    # The top tree's proofs per group: its leaves against its blocks' paths.
    upper = (top.select(F.floor(F.col("pos") / size).alias("block"), (F.col("pos") % size).alias("slot"), "pos", "leaf")
             .groupBy("block").cogroup(tops.groupBy("block"))
             .applyInArrow(_group_paths(fanout, local), f"g long, subroot string, root string, above array<{STEP}>"))
    paths = (blocks.join(save_table(upper, "merkle-upper"), "g")
             .select("g", "block", "total", F.concat("path", "above").alias("path"), "subroot", "root"))
    cut = ranked.select("g", F.floor(F.col("pos") / size).alias("block"), (F.col("pos") % size).alias("slot"), "id", "leaf", "shown")
    return (cut.groupBy("g", "block").cogroup(paths.groupBy("g", "block"))
            .applyInArrow(_prove(fanout, local), "doc_id long, leaf string, subroot string, root string, "
                          "proof_sha256 string, folded_root string, verified boolean"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(leaves(read_table(spark, sf_dir, "documents")))


# The same tree in DuckDB: CRC-32 by its bits, levels and folds by recursion.
ORACLE = """
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
             lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295::BIGINT) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), d AS (
  SELECT t.doc_id, t.lang, coalesce(c % 3 = 0, false) AS hit, t.text,
         concat(coalesce(strlen(CAST(t.doc_id AS VARCHAR)) || ':' || t.doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head
  FROM documents t LEFT JOIN crc USING (doc_id)
), h AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS shown
  FROM d
), l AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, count(*) OVER (PARTITION BY lang) AS n,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM h
), tree AS (
  SELECT g, 0 AS level, pos, n, leaf AS node FROM l
  UNION ALL
  SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, level, pos // 8, n
), subroots AS (SELECT g, level AS height, node AS subroot FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, g - 1 AS pos, (SELECT count(*) FROM subroots) AS n, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8, n
), steps AS (
  SELECT a.g, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lhs,
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rhs
  FROM tree a JOIN tree b ON a.g = b.g AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
  UNION ALL
  SELECT 0, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''),
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
  FROM top a JOIN top b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
), fold AS (
  SELECT l.g AS g, l.pos AS leaf_pos, l.g AS tree, 0 AS level, l.pos AS pos, height, shown AS node, '' AS proof
  FROM l JOIN subroots USING (g)
  UNION ALL
  SELECT f.g, leaf_pos, CASE WHEN f.tree > 0 AND f.level = height THEN 0 ELSE f.tree END,
         CASE WHEN f.tree > 0 AND f.level = height THEN 0 ELSE f.level + 1 END,
         CASE WHEN f.tree > 0 AND f.level = height THEN f.g - 1 ELSE f.pos // 8 END, height,
         CASE WHEN f.tree > 0 AND f.level = height THEN f.node ELSE sha256(concat(lhs, f.node, rhs)) END,
         CASE WHEN f.tree > 0 AND f.level = height THEN f.proof ELSE concat(proof, lhs, rhs) END
  FROM fold f LEFT JOIN steps s ON s.g = f.tree AND s.level = f.level AND s.pos = f.pos
  WHERE (f.tree > 0 AND f.level = height) OR s.lhs IS NOT NULL
)
SELECT l.doc_id, l.leaf, s.subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM l JOIN subroots s USING (g) CROSS JOIN (SELECT node FROM top WHERE n = 1) r
JOIN fold f ON f.g = l.g AND f.leaf_pos = l.pos AND f.tree = 0
WHERE NOT EXISTS (SELECT 1 FROM steps t WHERE t.g = 0 AND t.level = f.level AND t.pos = f.pos)
"""
