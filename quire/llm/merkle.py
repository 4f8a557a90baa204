"""Merkle manifest of a dataset: built level by level, proved by a recursive query that climbs from the leaves.

H is the lowercase hex sha256 of its inputs one after the other. A row's leaf is H of its columns; the leaves of each
group (language), in the order of their ids, are hashed in runs of eight, and the runs again, until one node remains,
the group's subroot. The subroots, in the order of the groups, give the root in the same way.

The rows are sorted once by range, so that a row's place in its group is its number in its partition plus the rows
before it: no group, however large, meets in one task. Each level is grouped by place div 8 from the level below and
stored as node rows, one per run: the digests of the run and the place of its parent, which in the last run of a group
is a place among the subroots. A recursive query then climbs. A row of it holds the leaves of one run, which share
every node above their parent: at each level it joins the run of the node where it stands, appends the siblings to the
proof and folds the hash of every leaf that it holds. A level is a join of rows by place, so rounds grow with the
logarithm of the table. Near the root all rows meet few runs: a run is therefore stored once for each ASKED rows that
will come by, and the rows are dealt to these copies.

Defined cases: a null column counts as `-`; rows without a group come first, as a group of their own; rows without an id
come first in their group; rows with one id are ordered by leaf, and rows that are equal in all columns are
interchangeable; a group of one row has that leaf as subroot, a table of one group that subroot as root; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, released, stored

#: The columns of documents that a leaf is made of.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run.
FAN = 8
#: Rows of the climb that one copy of a run serves.
ASKED = 512
#: The name of the tree above the subroots; those of groups begin with 0 or 1.
TOP = "top"


def leaf(columns: list[Column]) -> Column:
    """H of the values, each as its length in bytes, a colon and itself, or `-`."""
    shown = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*shown), 256)


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row as the contract tampers with it: a third of the ids have their text's A-Z lower-cased."""
    changed = leaf([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS])
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed).otherwise(leaf([F.col(c) for c in COLUMNS]))


def _placed(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows with their place in their tree, and the number of nodes by tree (place, n; tree). rows: tree and others."""
    # the last key spreads rows that are alike over partitions
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    keys = ["tree", *order, "spread"]
    ordered = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("spread")
    # partition number above 33 bits, number in the partition below them
    table = stored(ordered.withColumn("number", F.monotonically_increasing_id()), name)
    part = F.shiftright("number", 33)
    # one row per partition
    sizes = sorted((r["part"], r["n"]) for r in table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    offsets = rows.sparkSession.createDataFrame(starts, "part long, rows_before long")
    ranked = table.join(F.broadcast(offsets), part == F.col("part")).withColumn("rank", F.col("rows_before") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "rows_before", "number")
    trees = ranked.groupBy("tree").agg(F.min("rank").alias("first_rank"), F.count("*").alias("n"))
    return ranked, trees


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _levels(nodes: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """Stored runs of all levels above nodes (tree, place, digest, n, climbs): (tree, level, run, n, digests, digest, climbs).

    largest: the most nodes that a tree has. climbs: how many rows of the climb come by, summed up.
    """
    levels = []
    while largest > 1:
        runs = nodes.where("n > 1").groupBy("tree", "n", F.expr(f"place DIV {FAN}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("run_nodes"), F.sum("climbs").alias("climbs"))
        runs = runs.select("tree", F.lit(len(levels)).alias("level"), "run", "n", F.col("run_nodes.digest").alias("digests"), "climbs")
        levels.append(stored(runs.withColumn("digest", _joined(F.col("digests"))), f"{name}-{len(levels)}"))
        nodes = levels[-1].select("tree", F.col("run").alias("place"), "digest", F.ceil(F.col("n") / FAN).alias("n"), "climbs")
        largest = -(-largest // FAN)
    return levels


def _below(level: int) -> int:
    """Copies of a run of a group's tree: so many rows climb by it that one serves ASKED of them."""
    return max(1, FAN**level // ASKED)


def _counted(climbs: str) -> Column:
    """Copies of a run above the subroots, where groups of all sizes meet."""
    return F.ceil(F.col(climbs) / ASKED)


def _linked(runs: DataFrame, places: DataFrame | None, level: int) -> DataFrame:
    """Runs of a level with the place of their parent (in the next level, or among the subroots, or null at the root) and
    the copies of the run that it stands in.

    places: (tree, top_place, top_copies) of the subroots, None for the runs above the subroots themselves.
    """
    if places is None:
        runs = runs.withColumns({"top_place": F.lit(None).cast("long"), "top_copies": F.lit(None).cast("long")})
    else:
        runs = runs.join(places, "tree", "left")
    inside, over = F.col("n") > FAN, F.col("top_place").isNotNull()
    up = {
        "up_tree": F.when(inside, F.col("tree")).when(over, F.lit(TOP)),
        "up_level": F.when(inside, F.col("level") + 1).when(over, F.lit(0)),
        "up_place": F.when(inside, F.col("run")).otherwise(F.col("top_place")),
        "copies": F.when(inside, F.lit(_below(level + 1)).cast("long")).otherwise(F.col("top_copies")),
    }
    return runs.withColumns(up)


#: Climbs with all leaves of a run at once, carrying digests as bytes. {base}: what climb holds at the start; {runs}: the stored node rows.
CLIMB = """
WITH RECURSIVE climb(members, proof, up_tree, up_level, up_place, spread, copies, subroot, digest) AS (
  SELECT members, proof, up_tree, up_level, up_place, spread, copies, CAST(NULL AS STRING), digest FROM {base}
  UNION ALL
  SELECT
    transform(c.members, m -> named_struct('id', m.id, 'leaf', m.leaf,
      'fold', unhex(sha2(concat(array_join(slice(r.digests, 1, CAST(c.up_place % {fan} AS INT)), ''), lower(hex(m.fold)), array_join(slice(r.digests, CAST(c.up_place % {fan} + 2 AS INT), {fan}), '')), 256)))),
    concat(c.proof, unhex(concat(array_join(slice(r.digests, 1, CAST(c.up_place % {fan} AS INT)), ''), array_join(slice(r.digests, CAST(c.up_place % {fan} + 2 AS INT), {fan}), '')))),
    r.up_tree, r.up_level, r.up_place, c.spread, r.copies,
    CASE WHEN c.up_tree = '{top}' AND c.up_level = 0 THEN r.digests[CAST(c.up_place % {fan} AS INT)] ELSE c.subroot END,
    r.digest
  FROM climb c JOIN {runs} r ON r.tree = c.up_tree AND r.level = c.up_level AND r.run = c.up_place DIV {fan} AND r.copy = c.spread % c.copies
)
SELECT members, proof, coalesce(subroot, digest) AS subroot, digest AS root FROM climb WHERE up_tree IS NULL"""


def merkle_manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) for every row of docs.

    proof: the digests that lead from the leaf to the root, one after the other. changed: the leaf as it is found at the
    time of the check, by default that of `tampered`.
    """
    spark = docs.sparkSession
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("tree")
    rows = docs.select(tree, F.col("doc_id").alias("id"), leaf([F.col(c) for c in COLUMNS]).alias("leaf"), (tampered(docs) if changed is None else changed).alias("found"))
    ranked, trees = _placed(rows, ["id", "leaf"], "merkle-leaves")
    trees = stored(trees, "merkle-trees")
    largest, groups = trees.agg(F.max("n"), F.count("*")).first()
    leaves = ranked.join(trees, "tree").withColumn("place", F.col("rank") - F.col("first_rank"))
    low = _levels(leaves.select("tree", "place", F.col("leaf").alias("digest"), "n", F.lit(1).cast("long").alias("climbs")), largest or 0, "merkle-nodes")

    # the subroots, and the levels above them
    of_one = leaves.where("n = 1").select("tree", F.col("leaf").alias("digest"), F.lit(1).cast("long").alias("climbs"))
    # the leaves of a run climb in one row, so this counts up to eight times the rows
    subroots = of_one
    for level in low:
        subroots = subroots.unionByName(level.where(F.col("n") <= FAN).select("tree", "digest", "climbs"))
    top_nodes, _ = _placed(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), "digest", "climbs"), ["group"], "merkle-subroots")
    top_nodes = stored(top_nodes.select("tree", "group", F.col("rank").alias("place"), "digest", F.lit(groups).cast("long").alias("n"), "climbs"), "merkle-tops")
    high = _levels(top_nodes, groups, "merkle-tops")
    places = top_nodes.where("n > 1").select(F.col("group").alias("tree"), F.col("place").alias("top_place"))
    if high:
        places = places.join(high[0].select(F.col("run").alias("top_run"), _counted("climbs").alias("top_copies")), F.expr(f"top_place DIV {FAN}") == F.col("top_run")).drop("top_run")
    else:
        places = places.withColumn("top_copies", F.lit(1).cast("long"))
    schema = "tree string, level int, run long, digests array<string>, digest string, up_tree string, up_level int, up_place long, copies long, own long"
    runs = spark.createDataFrame([], schema)
    # the climb starts above the first level
    for k, level in list(enumerate(low))[1:]:
        linked = _linked(level, places, k).withColumn("own", F.lit(_below(k)).cast("long"))
        runs = runs.unionByName(linked.select(*runs.columns))
    for k, level in enumerate(high):
        linked = _linked(level, None, k).withColumn("own", _counted("climbs"))
        if k + 1 < len(high):
            above = high[k + 1].select(F.col("run").alias("up_run"), _counted("climbs").alias("up_copies"))
            linked = linked.join(above, F.expr(f"up_place DIV {FAN}") == F.col("up_run"), "left").withColumn("copies", F.col("up_copies"))
        runs = runs.unionByName(linked.select(*runs.columns))
    runs = stored(runs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1))).drop("own"), "merkle-runs")

    # a row per run of leaves; a leaf alone in its group stands among the subroots at once
    base = leaves.groupBy("tree", "n", F.expr(f"place DIV {FAN}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "leaf", "found"))).alias("held"))
    digests = F.col("held.leaf")
    fold = lambda m, i: F.when(F.col("n") == 1, m["found"]).otherwise(_joined(F.transform(digests, lambda x, k: F.when(k == i, m["found"]).otherwise(x))))
    members = F.transform("held", lambda m, i: F.struct(m["id"].alias("id"), F.unhex(m["leaf"]).alias("leaf"), F.unhex(fold(m, i)).alias("fold")))
    digest = F.when(F.col("n") == 1, digests[0]).otherwise(_joined(digests))
    base = _linked(base.withColumn("level", F.lit(0)), places, 0)
    base = base.select(members.alias("members"), F.lit(b"").alias("proof"), "up_tree", "up_level", "up_place", F.col("run").alias("spread"), "copies", digest.alias("digest"))

    text = lambda c: F.lower(F.hex(c))
    found = _climb(base, runs).withColumn("digests", F.transform("members.leaf", text)).select("*", F.posexplode("members").alias("i", "m"))
    proof = F.concat(F.array_join(F.filter("digests", lambda x, k: k != F.col("i")), ""), text(F.col("proof")))
    folded = text(F.col("m.fold"))
    released(*low, *high, top_nodes, runs)
    return found.select(
        F.col("m.id").alias("doc_id"), text(F.col("m.leaf")).alias("leaf"), "subroot", "root", proof.alias("proof"), F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified")
    )


def _climb(base: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of base at the root, stored, as the limit on rows of recursive queries is lifted only meanwhile."""
    spark, limit = base.sparkSession, "spark.sql.cteRecursionRowLimit"
    names = {"base": f"merkle_base_{uuid.uuid4().hex}", "runs": f"merkle_runs_{uuid.uuid4().hex}"}
    before = spark.conf.get(limit, None)
    base.createOrReplaceTempView(names["base"])
    runs.createOrReplaceTempView(names["runs"])
    spark.conf.set(limit, "-1")
    try:
        return stored(spark.sql(CLIMB.format(fan=FAN, top=TOP, **names)), "merkle-climbed")
    finally:
        spark.conf.set(limit, before) if before is not None else spark.conf.unset(limit)
        for name in names.values():
            spark.catalog.dropTempView(name)
