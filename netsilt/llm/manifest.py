"""Merkle manifest of a dataset: digests of rows, one tree per source, one tree of sources.

Rows are written as digests first, so texts are read once and never shuffled. They
are put in order by ranges and numbered within their source from per-range counts; no
task holds a source. Level by level, a window over runs of ``FAN_OUT`` nodes reads the siblings of each
node with lag and lead at fixed offsets, masked by the node's slot and the run's length;
the row in the first slot hashes its run into the parent. A source stops at one node,
and the sources' last nodes form a tree of the same kind. The way back down joins each
node with its parent's path, which gives every row all siblings up to the root.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsilt.llm.common import share, stored

FAN_OUT = 16
RANGE_ROWS = 500_000     # rows of digests one task puts in order
LEAST_RANGES = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def row_digest(*values: Column) -> Column:
    """Digest of a row: per value ``-`` if null, else its length in bytes, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return hashed(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def in_groups(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``grp`` (number of the group in order, null first), ``pos`` (place in the group by
    ``order``, nulls first) and ``n`` (rows of the group), all from 0. Rows equal in all of these may change places."""
    ranges = share(rows.count(), RANGE_ROWS, LEAST_RANGES)
    tied = rows.withColumn("tie", F.monotonically_increasing_id())   # equal rows fill several ranges, too
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "tie")]
    sorted_ = tied.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("tie")
    number = F.monotonically_increasing_id()
    placed = stored(sorted_.select("*", F.spark_partition_id().alias("range"), number.bitwiseAND((1 << 33) - 1).alias("at")), "ranges")
    named = [F.col(group).isNull().alias("nameless"), F.coalesce(group, F.lit("")).alias("name")]
    found = stored(placed.groupBy("range", *named).agg(F.count("*").alias("rows"), F.min("at").alias("first")), "pieces")
    of_group = Window.partitionBy("nameless", "name")
    before = F.coalesce(F.sum("rows").over(of_group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.select("*", before.alias("before"), F.sum("rows").over(of_group).alias("n"))
    begins = F.when(F.col("before") == 0, 1).otherwise(0)      # the piece with which a group begins
    in_range = F.sum(begins).over(Window.partitionBy("range").orderBy("first"))
    found = stored(found.select("*", in_range.cast("long").alias("begun")), "pieces")
    per_range = found.groupBy("range").agg(F.max("begun").alias("begun"))      # one row per range
    earlier = F.coalesce(F.sum("begun").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.join(per_range.select("range", earlier.alias("earlier")), "range")
    pieces = found.select(F.col("range").alias("r"), F.col("nameless").alias("u"), F.col("name").alias("m"), "before", "n", "first",
                          (F.col("earlier") + F.col("begun") - 1).alias("grp"))
    same = (F.col("range") == F.col("r")) & (F.col(group).isNull() == F.col("u")) & (F.coalesce(group, F.lit("")) == F.col("m"))
    pos = F.col("before") + F.col("at") - F.col("first")
    return stored(placed.join(pieces, same).select(*rows.columns, "grp", pos.alias("pos"), "n"), "placed")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes(grp, pos, n, digest)`` with ``run`` and the siblings' digests before (``left``) and after
    (``right``), joined: empty where there are none."""
    run, slot = F.floor(F.col("pos") / FAN_OUT).cast("long"), F.col("pos") % FAN_OUT
    nodes = nodes.select("*", run.alias("run"), slot.alias("slot"), F.least(F.lit(FAN_OUT), F.col("n") - run * FAN_OUT).alias("size"))
    w = Window.partitionBy("grp", "run").orderBy("pos")
    left = [F.when(F.col("slot") >= k, F.lag("digest", k).over(w)) for k in range(FAN_OUT - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < F.col("size"), F.lead("digest", k).over(w)) for k in range(1, FAN_OUT)]
    return nodes.select("*", F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right")).drop("size")


def _parents(nodes: DataFrame) -> DataFrame:
    first = with_siblings(nodes.filter("n > 1")).filter("slot = 0")
    return first.select("grp", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN_OUT).cast("long").alias("n"),
                        hashed("digest", "right").alias("digest"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The nodes of all groups' trees, leaves first; a group ends at the level where it has one node."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    out = [leaves.select("grp", "pos", "n", "digest")]
    while most > 1:
        out.append(stored(_parents(out[-1]), "nodes"))
        most = math.ceil(most / FAN_OUT)
    return out


def tops(tree: list[DataFrame]) -> DataFrame:
    """``grp, digest``: the last node of each group."""
    found = [nodes.filter("n = 1").select("grp", "digest") for nodes in tree]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def paths(tree: list[DataFrame], base: DataFrame, lowest: int) -> DataFrame:
    """``grp, pos, path, top`` of all nodes from level ``lowest`` on: siblings up to the top of the group and
    what ``base(g, path, top)`` has beyond it."""
    top_of = lambda nodes: nodes.filter("n = 1").join(base, F.col("grp") == F.col("g")).select("grp", "pos", "path", "top")
    found = stored(top_of(tree[-1]), "paths")
    for nodes in reversed(tree[lowest:-1]):
        found = stored(below(nodes, found).select("grp", "pos", "path", "top").unionByName(top_of(nodes)), "paths")
    return found


def below(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` of groups with more than one of them, with their path and top: their parents' are in ``above``."""
    up = above.select(F.col("grp").alias("g"), F.col("pos").alias("of"), F.col("path").alias("beyond"), "top")
    step = F.array(F.struct("left", "right"))
    joined = with_siblings(nodes.filter("n > 1")).join(up, (F.col("grp") == F.col("g")) & (F.col("run") == F.col("of")))
    return joined.withColumn("path", F.concat(step, "beyond").cast(PATH)).drop("g", "of", "beyond", "left", "right", "run", "slot")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda acc, s: hashed(s["left"], acc, s["right"]))


def manifest(leaves: DataFrame) -> DataFrame:
    """The rows of ``leaves(row, id, source, leaf)`` with ``path``, ``subroot`` and ``root``.

    Leaves of a source ascend by id, null first; rows of one id by their digest, and of rows
    equal in that, too, any order gives the same digests. A source may be null, and comes first then.
    An empty table gives no rows.
    """
    placed = in_groups(leaves.withColumn("digest", F.col("leaf")), "source", "id", "digest")
    tree = levels(placed)
    found = stored(tops(tree).select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), "digest"), "subroots")
    sources = found.withColumn("n", F.lit(found.count()).cast("long"))
    upper = levels(sources)
    last = upper[-1].select("digest").first()
    root = F.lit(last.digest if last else None).cast("string")
    ends = upper[-1].select(F.col("grp").alias("g"), F.array().cast(PATH).alias("path"), F.lit("").alias("top"))
    of_source = paths(upper, ends, 0).select(F.col("pos").alias("at"), "path")
    base = sources.join(of_source, F.col("pos") == F.col("at")).select(F.col("pos").alias("g"), "path", F.col("digest").alias("top"))
    base = stored(base, "subroots")
    alone = placed.filter("n = 1").join(base, F.col("grp") == F.col("g")).select(*leaves.columns, "path", "top")
    out = alone
    if len(tree) > 1:
        out = below(placed, paths(tree, base, 1)).select(*leaves.columns, "path", "top").unionByName(alone)
    return out.select(*leaves.columns, "path", F.col("top").alias("subroot"), root.alias("root"))


def proofs(docs: DataFrame, changed: Column, tampered: dict[str, Column]) -> DataFrame:
    """Manifest of ``docs(doc_id, source, lang, n_chars, text)`` and a check of it: ``doc_id, leaf, subroot, root,
    proof_sha256`` (digest of all siblings up to the root), ``folded_root`` and ``verified``.

    Where ``changed`` holds, the leaf is computed again with the columns of ``tampered`` in place of the given ones
    and folded with the manifest's siblings; verified tells whether that gives the root. Null values and empty texts
    have digests of their own; repeated rows are leaves each; other columns take no part.
    """
    def digest(replaced: dict[str, Column]) -> Column:
        return row_digest(*[replaced.get(c, F.col(c)) for c in COLUMNS])
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), digest({}).alias("leaf"),
                       F.when(changed, digest(tampered)).alias("other"))
    leaves = stored(rows.select(F.struct("doc_id", "other").alias("row"), F.col("doc_id").alias("id"), "source", "leaf"), "leaves")
    found = manifest(leaves)
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    out = found.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                       folded(F.col("path"), F.coalesce(F.col("row.other"), F.col("leaf"))).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_case(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)
