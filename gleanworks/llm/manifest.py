"""Merkle manifest of a table, with a proof per row, from ranks in bitmaps instead of a sort.

Within a tree (one per language) leaves follow their id. Ids are gathered in bitmap containers of 4,096, kept as their
words of 64 bits that are not empty, with a popcount directory: how many leaves stand before each word. What stands
before a container is added up over a radix tree of 4,096 children a node, so no step holds a whole tree. A leaf's
place is then the directory's entry plus the bits set below its own.

Places deal leaves into slot arrays of ``arity ** levels`` neighbours. Each array is filled by place and reduced by
several levels at once; what it leaves is a slot of the next array. On the way down each array hands its slots the
siblings of its own levels followed by what it got from above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.llm.common import discard, stored
from gleanworks.operators import ordered

ARITY = 2
#: Levels that one slot array reduces: 2**10 slots.
LEVELS = 10
#: log2 of the ids of a container, and of the children of a node above the containers.
RADIX = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The container of rows without an id, below that of every number.
_NO_ID = -(1 << (63 - RADIX)) - 1


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hex sha256 of each field's byte count, a colon and its value, or of ``-`` for a null."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown)), 256)


def _same_tree(tree: str, other: str) -> Column:
    return F.col(tree).eqNullSafe(F.col(other))


def leaf_places(rows: DataFrame, leaf: list[str]) -> DataFrame:
    """``rows`` (tree, id, leaf columns, ...) with ``place`` in the tree (from 0, by id, null first) and ``leaves`` of the tree.

    Rows that share an id follow each other by ``leaf``. Hot trees spread over containers, hot ids over ranges.
    """
    low = F.col("id").bitwiseAND(F.lit((1 << RADIX) - 1))
    spot = [F.coalesce(F.shiftright("id", RADIX), F.lit(_NO_ID)).alias("k0"), F.coalesce(F.shiftright(low, 6), F.lit(0).cast("long")).cast("int").alias("word"),
            F.coalesce(low.bitwiseAND(F.lit(63)), F.lit(0).cast("long")).cast("int").alias("bit")]
    rows = rows.select("*", *spot)
    ids = rows.groupBy("tree", "k0", "word", "bit").agg(F.count("*").alias("m"))
    more = F.when(F.col("m") > 1, F.struct("bit", (F.col("m") - 1).alias("m")))
    words = ids.repartition("tree", "k0").groupBy("tree", "k0", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("m").alias("n"), F.collect_list(more).alias("more"))
    before = F.sum("n").over(Window.partitionBy("tree", "k0").orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    containers = stored(
        words.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
        .groupBy("tree", "k0").agg(F.sum("n").alias("n"), F.collect_list(F.struct("word", "bits", "before", "more")).alias("set")), "containers")
    # what stands before a container: sums over the earlier children of each node above it
    level, base = containers.select("tree", "k0", "n"), containers.select("tree", "k0", "set")
    sums, depth = F.lit(0).cast("long"), 0
    while True:
        here, above = f"k{depth}", f"k{depth + 1}"
        span = level.agg(F.min(here), F.max(here)).first()
        level = level.withColumn(above, F.shiftright(here, RADIX))
        node = ["tree"] if span[0] is None or span[1] - span[0] < 1 << RADIX else ["tree", above]
        earlier = Window.partitionBy(*node).orderBy(here).rowsBetween(Window.unboundedPreceding, -1)
        counted = level.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))).select(F.col("tree").alias("t"), F.col(here).alias("h"), "earlier")
        base = base.withColumn(here, F.shiftright("k0", RADIX * depth) if depth else F.col("k0"))
        base = base.join(counted, _same_tree("tree", "t") & (F.col(here) == F.col("h"))).drop("t", "h")
        base = base.withColumn(f"s{depth}", F.col("earlier")).drop("earlier")
        sums = sums + F.col(f"s{depth}")
        if len(node) == 1:
            break
        level = level.groupBy("tree", above).agg(F.sum("n").alias("n"))
        depth += 1
    trees = containers.groupBy("tree").agg(F.sum("n").alias("leaves")).withColumnRenamed("tree", "t")
    directory = stored(base.withColumn("base", sums).join(trees, _same_tree("tree", "t")).select(
        "t", F.col("k0").alias("k"), "leaves", F.transform("set", lambda w: w["word"]).alias("words"),
        F.transform("set", lambda w: F.struct(w["bits"].alias("bits"), (w["before"] + F.col("base")).alias("before"), w["more"].alias("more"))).alias("set")), "directory")
    discard(containers)
    met = rows.join(directory, _same_tree("tree", "t") & (F.col("k0") == F.col("k")))
    entry = F.element_at("set", F.array_position("words", F.col("word")).cast("int"))
    below = F.bit_count(entry["bits"].bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, bit)")))).cast("long")
    extra = F.aggregate(F.filter(entry["more"], lambda e: e["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda total, e: total + e["m"])
    shared = F.exists(entry["more"], lambda e: e["bit"] == F.col("bit"))
    kept = [c for c in rows.columns if c not in ("k0", "word", "bit")]
    placed = stored(met.select(*kept, "leaves", (entry["before"] + below + extra).alias("place"), shared.alias("shared")), "placed")
    discard(directory)
    alone, several = (placed.where(c).drop("shared") for c in ("not shared", "shared"))
    if several.isEmpty():
        return alone
    nth = ordered.with_position(several, ["tree", "id"], leaf, "nth")
    return alone.unionByName(nth.withColumn("place", F.col("place") + F.col("nth") - 1).drop("nth"))


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _levels(leaves: int, arity: int, levels: int) -> int:
    """Levels that arrays of a tree with so many nodes reduce: all that are left, or ``levels``."""
    depth, n = 0, leaves
    while n > 1 and depth < levels:
        n, depth = -(-n // arity), depth + 1
    return depth


def reduce_slots(slots: list[str], depth: int, arity: int) -> list[list[str]]:
    """All levels of a slot array: every ``arity`` neighbours (the last run may be shorter, even one) become their hash."""
    levels = [slots]
    for _ in range(depth):
        slots = [_hex("".join(slots[k:k + arity]).encode()) for k in range(0, len(slots), arity)]
        levels.append(slots)
    return levels


def _filled(digests: list, places: np.ndarray, width: int) -> tuple[list[str], np.ndarray]:
    """The digests by their slot, and the slot of each; slots are gapless."""
    spot = places % width
    slots: list = [None] * len(digests)
    for k, digest in zip(spot.tolist(), digests, strict=True):
        slots[k] = digest
    return slots, spot


def _by_array(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Whole slot arrays from batches that are sorted by tree and array: some arrays in each table."""
    waiting = []
    for batch in batches:
        if not len(batch):
            continue
        waiting.append(batch)
        rows = pa.Table.from_batches(waiting)
        cuts = _edges(rows, width)
        if cuts[-2] and len(rows) >= 16 * width:
            yield rows.slice(0, cuts[-2])
            waiting = rows.slice(cuts[-2]).combine_chunks().to_batches()
    if waiting:
        yield pa.Table.from_batches(waiting)


def _edges(rows: pa.Table, width: int) -> list[int]:
    """Where arrays begin, and the end."""
    tree, array = rows["number"].to_numpy(), rows["place"].to_numpy() // width
    new = np.ones(len(rows), bool)
    new[1:] = (tree[1:] != tree[:-1]) | (array[1:] != array[:-1])
    return [*np.flatnonzero(new).tolist(), len(rows)]


def _dealt(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes with those of one slot array together."""
    return nodes.withColumn("array", F.expr(f"place div {width}")).repartition("number", "array").sortWithinPartitions("number", "array").drop("array")


def _up(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """One node per slot array: (number, place, leaves, digest) of the next round."""
    width = arity**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_array(batches, width):
            edges, place, leaves = _edges(rows, width), rows["place"].to_numpy(), rows["leaves"].to_numpy()
            digests, out = rows["digest"].to_pylist(), []
            for a, b in zip(edges, edges[1:], strict=False):
                slots, _ = _filled(digests[a:b], place[a:b], width)
                out.append(reduce_slots(slots, _levels(int(leaves[a]), arity, levels), arity)[-1][0])
            at = np.array(edges[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(rows["number"].to_numpy()[at]), pa.array(place[at] // width), pa.array(-(-leaves[at] // width)), pa.array(out)],
                                             ["number", "place", "leaves", "digest"])

    return _dealt(nodes.select("number", "place", "leaves", "digest"), width).mapInArrow(run, "number long, place long, leaves long, digest string")


def _siblings(levels: list[list[str]], spot: int, arity: int) -> list[tuple[str, str]]:
    """Per level, what stands left and right of the node above ``spot`` in its run."""
    out = []
    for nodes in levels[:-1]:
        begin = spot - spot % arity
        out.append(("".join(nodes[begin:spot]), "".join(nodes[spot + 1:begin + arity])))
        spot //= arity
    return out


def _path(text: str) -> list[tuple[str, str]]:
    """Siblings from their written form: per level left, a comma, right; levels parted by line feeds."""
    return [tuple(level.split(",")) for level in text.split("\n")[:-1]]


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root from a leaf and its siblings."""
    for left, right in path:
        digest = _hex(f"{left}{digest}{right}".encode())
    return digest


def _down(nodes: DataFrame, above: DataFrame, arity: int, levels: int, last: bool) -> DataFrame:
    """Each node's siblings up to the root; for leaves (``last``) the digests of the manifest instead."""
    width = arity**levels
    above = above.select(F.col("number").alias("n"), F.col("place").alias("p"), "path")
    first = F.col("place") % width == 0  # one slot of each array brings what comes from above
    brings = nodes.where(first).join(above, (F.col("number") == F.col("n")) & (F.expr(f"place div {width}") == F.col("p"))).drop("n", "p")
    dealt = _dealt(brings.unionByName(nodes.where(~first).withColumn("path", F.lit(None).cast("string"))), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_array(batches, width):
            edges, place, leaves = _edges(rows, width), rows["place"].to_numpy(), rows["leaves"].to_numpy()
            digests, paths = rows["digest"].to_pylist(), rows["path"].to_pylist()
            started = rows["shown"].to_pylist() if last else digests
            told = []
            for a, b in zip(edges, edges[1:], strict=False):
                slots, spots = _filled(digests[a:b], place[a:b], width)
                from_above = next(p for p in paths[a:b] if p is not None)
                tree = reduce_slots(slots, _levels(int(leaves[a]), arity, levels), arity)
                higher = _path(from_above) if last else []
                for k, spot in enumerate(spots.tolist(), a):
                    path = _siblings(tree, spot, arity)
                    if last:
                        told.append((_hex("".join(left + right for left, right in [*path, *higher]).encode()), fold(started[k], [*path, *higher])))
                    else:
                        told.append("".join(f"{left},{right}\n" for left, right in path) + from_above)
            if last:
                proof, folded = zip(*told, strict=True)
                yield pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in ("id", "leaf", "number")), pa.array(proof), pa.array(folded)],
                                                 ["id", "leaf", "number", "proof_sha256", "folded_root"])
            else:
                yield pa.RecordBatch.from_arrays([rows["number"].combine_chunks(), rows["place"].combine_chunks(), pa.array(told, pa.string())], ["number", "place", "path"])

    schema = "id long, leaf string, number long, proof_sha256 string, folded_root string" if last else "number long, place long, path string"
    return dealt.mapInArrow(run, schema)


def _tower(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """Written node tables from the given one up to that with one node per tree."""
    tower, most = [nodes], nodes.agg(F.max("leaves")).first()[0] or 0
    while most > 1:
        tower.append(stored(_up(tower[-1], arity, levels), "nodes"))
        most = -(-most // arity**levels)
    return tower


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", shown: Column | None = None,
             arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Input: ``doc_id``, ``tree`` and the columns of ``fields``; others are ignored. ``shown`` is a column of the leaf that a
    reader holds where it differs (null: the true one): it is folded with the true siblings, and ``verified`` says
    whether the root comes out. Trees are ordered by their value (null first, by bytes), leaves by doc_id (null first), rows
    of one doc_id by their leaf. Repeated rows are leaves of their own. With one row its leaf is the root; an empty
    table gives no rows.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("id"), F.col(tree).cast("string").alias("tree"), leaf_hash(*(F.col(f) for f in fields)).alias("leaf"),
                              (F.lit(None) if shown is None else shown).cast("string").alias("shown")), "leaves")
    placed = leaf_places(rows.withColumn("shown", F.coalesce("shown", "leaf")), ["leaf", "shown"])
    # the number of trees is not bounded either: their positions come from ranges of their values
    trees = stored(ordered.with_position(rows.select("tree").distinct().withColumn("all", F.lit(0)), ["all"], ["tree"], "number").select(
        F.col("tree").alias("t"), (F.col("number") - 1).alias("number")), "trees")
    leaves = stored(placed.join(trees, _same_tree("tree", "t")).select("id", "number", "place", "leaves", F.col("leaf").alias("digest"), "leaf", "shown"), "leaf-places")
    tower = _tower(leaves, arity, levels)
    subroots = tower[-1].select("number", F.col("digest").alias("subroot"))
    nodes = subroots.select(F.lit(0).cast("long").alias("number"), F.col("number").alias("place"), F.lit(trees.count()).cast("long").alias("leaves"), F.col("subroot").alias("digest"))
    top = _tower(nodes, arity, levels)
    root = top[-1].first()
    path = top[-1].select("number", "place", F.lit("").alias("path"))
    for nodes in top[-2::-1]:
        path = _down(nodes, path, arity, levels, False)
    path = path.select(F.col("place").alias("number"), F.lit(0).cast("long").alias("place"), "path")
    for nodes in tower[-2:0:-1]:
        path = _down(nodes, path, arity, levels, False)
    told = _down(leaves, stored(path, "paths"), arity, levels, True)
    discard(rows)
    return told.join(subroots, "number").withColumn("root", F.lit(root["digest"] if root else None).cast("string")).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered_leaf() -> Column:
    """The leaf with one added to n_chars, for each seventh row by the crc32 of its id; null for the others."""
    more = leaf_hash(*(F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS))
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, more)



SQL = """
    WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
        || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
        coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
        FROM documents),
    h AS (SELECT doc_id, lang, coalesce(crc % 7 = 0, false) AS wrong, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
        sha256(head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS changed FROM f),
    l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM h),
    up AS (SELECT lang, 0 AS lv, pos, leaf AS h, n FROM l UNION ALL
        SELECT lang, lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, lv, n, pos // 2),
    s AS (SELECT lang, h AS subroot, lv AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS number, count(*) OVER () AS trees FROM up WHERE n = 1),
    top AS (SELECT 0 AS lv, number AS pos, subroot AS h, trees AS n FROM s UNION ALL
        SELECT lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lv, n, pos // 2),
    node AS (SELECT s.number, up.lv, up.pos, up.h, up.n > 1 AS inner_ FROM up JOIN s ON up.lang IS NOT DISTINCT FROM s.lang),
    walk AS (SELECT l.doc_id, l.leaf, s.subroot, s.number, s.depth, l.pos, 0::BIGINT AS lv, CASE WHEN l.wrong THEN l.changed ELSE l.leaf END AS folded, '' AS proof, l.pos AS own
            FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang UNION ALL
        SELECT w.doc_id, w.leaf, w.subroot, w.number, w.depth, CASE WHEN w.lv + 1 = w.depth THEN w.number ELSE w.pos // 2 END, w.lv + 1,
            sha256(CASE WHEN w.pos % 2 = 1 THEN o.h || w.folded ELSE w.folded || coalesce(o.h, '') END), w.proof || coalesce(o.h, ''), w.own
        FROM walk w LEFT JOIN node o ON o.number = w.number AND o.lv = w.lv AND o.pos = xor(w.pos, 1) WHERE w.lv < w.depth),
    rise AS (SELECT doc_id, leaf, subroot, number AS pos, 0 AS lv, folded, proof, number, own FROM walk WHERE lv = depth UNION ALL
        SELECT r.doc_id, r.leaf, r.subroot, r.pos // 2, r.lv + 1, sha256(CASE WHEN r.pos % 2 = 1 THEN o.h || r.folded ELSE r.folded || coalesce(o.h, '') END),
            r.proof || coalesce(o.h, ''), r.number, r.own
        FROM rise r LEFT JOIN top o ON o.lv = r.lv AND o.pos = xor(r.pos, 1) WHERE r.lv < (SELECT max(lv) FROM top))
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
    FROM rise, (SELECT h AS root FROM top WHERE n = 1) WHERE lv = (SELECT max(lv) FROM top)
"""
