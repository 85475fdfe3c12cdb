"""A prefix trie of conversations, by partition refinement.

1. Rows are numbered within their conversation by a range sort, so that one conversation may
   hold any share of the rows: the sort cuts it into pieces, each piece is numbered by itself
   and the pieces' counts are added up. From here on a turn is 128 bits of its SHA-256 digest
   and its length.
2. Equal conversations are folded into one sequence with a number of copies.
3. All sequences start in one class, the root. A round splits the classes that still hold
   several sequences by their next turn; a class is named by its smallest member. A class of one
   sequence retires: the rest of the sequence is a chain of nodes with one child each.
4. Fold back: from the deepest round to the root, children add leaves and saved lengths to
   their parents. A chain's sums are known from the sequence's running lengths.

The rounds are as many as turns that two different conversations share from the start, plus one.

Defined results: rows without a conv_id take no part; rows of one conversation with equal turn
follow by role, then text, and repeated rows are repeated turns; null roles and texts are empty;
``%`` keeps the sign of conv_id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.session import discard, materialize, reread

#: conv_ids of one chunk of the lists that are hashed: 2^12 neighbours.
CHUNK_BITS = 12
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key (128 bits of role and text), chars, upto (chars of the turns up to this one)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_row")]  # _row spreads equal rows
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", digest.alias("key"), F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("_at"))
    placed = materialize(placed.withColumn("piece", F.shiftright("_at", 33)), "trie-turns")
    # A piece of a conversation is at most one partition of the sort.
    own = W.partitionBy("conv_id", "piece").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    local = placed.select("conv_id", "piece", "key", "chars", F.count(F.lit(1)).over(own).alias("pos"), F.sum("chars").over(own).alias("upto"))
    sizes = placed.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("m"))
    before = W.partitionBy("conv_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "piece", F.sum("n").over(before).alias("n0"), F.sum("m").over(before).alias("m0")).filter("n0 > 0")
    # Only conversations that a cut of the sort splits have a later piece: fewer rows than partitions.
    sizes = materialize(sizes, "trie-pieces")
    whole = local.join(F.broadcast(sizes), ["conv_id", "piece"], "left")
    zero = F.lit(0).cast("long")
    out = whole.select("conv_id", (F.col("pos") + F.coalesce("n0", zero)).alias("pos"), "key", "chars", (F.col("upto") + F.coalesce("m0", zero)).alias("upto"))
    out = materialize(out, "trie-numbered")
    discard(placed, sizes)
    return out


def opening_length(conv_id: str = "conv_id", most: int = 6) -> Column:
    """How many turns of the opening conversation replace a conversation's own first ones."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % most).cast("int")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """``numbered`` turns with each conversation's opening taken from the one whose id is the multiple of ``every`` below.

    A row of pos 0, key null, stands for each conversation, even one that has no turn now.
    """
    h = opening_length(most=most)
    convs = turns.groupBy("conv_id").agg(F.max(F.when(F.col("pos") <= h, F.col("upto"))).alias("own")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every, "own": F.coalesce("own", F.lit(0).cast("long"))})
    heads = turns.filter((F.col("pos") < most) & (F.col("conv_id") % every == 0)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("pos", "key", "chars", "upto"))).alias("head"))  # most - 1 turns at most
    convs = convs.join(heads, "base", "left").withColumn("head", F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("head", 1, 0)).otherwise(F.slice("head", 1, F.greatest("h", F.lit(1)))))
    convs = convs.withColumns({"taken": F.greatest(F.coalesce(F.size("head"), F.lit(0)), F.lit(0)), "lead": F.coalesce(F.try_element_at("head", F.lit(-1))["upto"], F.lit(0).cast("long"))})
    convs = materialize(convs, "trie-convs")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("upto"))
    opening = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    rest = turns.join(convs.select("conv_id", "h", "taken", "lead", "own"), "conv_id").filter("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "chars", (F.col("upto") - F.col("own") + F.col("lead")).alias("upto"))
    return roots.unionByName(opening).unionByName(rest)


def folded(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal conversations as one: (rep, n, copies, ends_sha256) and the turns of each rep from pos 1, with
    ``rest``, the characters from this turn to the last."""
    turns = materialize(turns, "trie-rebuilt")
    seeds = [F.sum(F.xxhash64(F.lit(s), "pos", "key").cast("decimal(38,0)")).alias(f"d{s}") for s in (1, 2)]
    whole = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max("upto").alias("total"), *seeds)
    whole = materialize(whole, "trie-whole")
    same = ["n", "d1", "d2"]
    reps = whole.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("total").alias("total"))
    # Ids of a group are hashed in order, as a stream of chunks of neighbours; SHA-256 has no parallel form.
    chunks = whole.groupBy(*same, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    digests = chunks.repartition(*same).sortWithinPartitions(*same, "chunk").mapInArrow(_stream_sha256, "n long, d1 decimal(38,0), d2 decimal(38,0), ends_sha256 string")
    reps = materialize(reps.join(digests, same).select("rep", "n", "copies", "total", "ends_sha256"), "trie-reps")
    own = turns.filter("pos > 0").join(reps.select(F.col("rep").alias("conv_id"), "n", "copies", "total"), "conv_id")
    own = own.select(F.col("conv_id").alias("rep"), "pos", "key", "chars", "n", "copies", (F.col("total") - F.col("upto") + F.col("chars")).alias("rest"))
    own = materialize(own.repartition("rep", "pos").sortWithinPartitions("pos"), "trie-sequences")  # a round reads its pages only
    discard(turns, whole)
    return reps, own


def _stream_sha256(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest of each run of equal (n, d1, d2), whose chunks come in order."""
    names, at, state = ["n", "d1", "d2", "ends_sha256"], None, None
    for batch in batches:
        out = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("n", "d1", "d2", "ids")), strict=True):
            if key == at:
                state.update(b"," + ids.encode())
            else:
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
        yield _digests(out, names)
    if at is not None:
        yield _digests([(*at, state.hexdigest())], names)


def _digests(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep"]


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations given as turns (conv_id, pos, key, chars, upto), with a row of pos 0 for each."""
    reps, own = folded(turns)
    root = reps.agg(F.min("rep")).first()[0]
    if root is None:
        return reps.select(*(F.lit(None).cast("long").alias(c) for c in NODE[:-1]), "ends_sha256").limit(0)
    zero = F.lit(0).cast("long")
    active = materialize(reps.select("rep", "n", "copies", "total", F.lit(root).cast("long").alias("class")), "trie-active")
    sums = [F.sum("copies").alias("n_convs"), F.count(F.lit(1)).alias("n_reps"), F.max("n").alias("n")]
    top = active.groupBy(F.col("class").alias("conv_id")).agg(*sums, F.max("total").alias("rest")).withColumns({"parent_conv_id": F.lit(None).cast("long"), "chars": zero})
    levels = [(materialize(top, "trie-level"), active)]
    while levels[-1][0].filter("n_reps > 1").limit(1).count():
        depth, (_, active) = len(levels), levels[-1]
        step = materialize(active.select("rep", "class").join(own.filter(F.col("pos") == depth), "rep"), "trie-step")
        groups = step.groupBy("class", "key").agg(F.min("rep").alias("conv_id"), *sums, F.max("chars").alias("chars"), F.max("rest").alias("rest"))
        groups = materialize(groups, "trie-level")
        split = groups.filter("n_reps > 1").select("class", "key", F.col("conv_id").alias("next"))
        active = step.join(split, ["class", "key"]).select("rep", "n", "copies", F.col("next").alias("class"))
        levels.append((groups.withColumnRenamed("class", "parent_conv_id").drop("key"), materialize(active, "trie-active")))
        discard(step)
    nodes = _folded_back(levels)
    retired = reduce(DataFrame.union, (found.filter("n_reps = 1").select(F.col("conv_id").alias("rep"), F.lit(d).alias("d")) for d, (found, _) in enumerate(levels)))
    chain = own.join(retired, "rep").filter("pos > d").select(
        F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("copies").alias("n_convs"), (F.col("pos") < F.col("n")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("copies") - 1) * F.col("rest")).alias("saved_tokens"), F.when(F.col("pos") == F.col("n"), F.col("rep")).alias("end_rep"),
    )
    nodes = materialize(nodes.select(*NODE).unionByName(chain), "trie-nodes")
    ended = nodes.filter("end_rep IS NOT NULL").join(reps.select(F.col("rep").alias("end_rep"), "ends_sha256"), "end_rep")
    passed = nodes.filter("end_rep IS NULL").withColumn("ends_sha256", F.lit(EMPTY_SHA256))
    return passed.unionByName(ended).drop("end_rep")


def _folded_back(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The nodes of all rounds with what their subtrees hold, from the last round up."""
    done: list[DataFrame] = []
    for depth in reversed(range(len(levels))):
        found, active = levels[depth]
        found = found.withColumn("depth", F.lit(depth).cast("long"))
        one = found.filter("n_reps = 1").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n") > depth).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("rest")).alias("saved_tokens"), F.when(F.col("n") == depth, F.col("conv_id")).alias("end_rep"),
        )
        if done:
            below = done[-1].groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
            ends = active.filter(F.col("n") == depth).select(F.col("class").alias("conv_id"), F.col("rep").alias("end_rep"))  # one a class: reps differ
            many = found.filter("n_reps > 1").join(below, "conv_id").join(ends, "conv_id", "left")
            one = one.unionByName(many.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars") + F.col("saved")).select(*NODE))
        done.append(materialize(one, "trie-done"))
    return reread(*done)


def conversation_trie(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations, as the query op11 returns them."""
    return prefix_trie(rebuilt(numbered(conversations), every, most))


def plain_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of the conversations as they are."""
    turns = numbered(conversations)
    roots = turns.filter("pos = 1").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("upto"))
    return prefix_trie(turns.unionByName(roots))


SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
         lambda crc, b: xor(xor(crc, b) >> 1, 3988292384 * (xor(crc, b) & 1))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, p, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p <= h
  UNION ALL SELECT c.conv_id, p, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND p > h
), prefixes AS (
  SELECT conv_id, row_number() OVER g AS depth, length(text) AS chars, list(struct_pack(role, text)) OVER g AS path FROM rebuilt WINDOW g AS (PARTITION BY conv_id ORDER BY p)
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs
), members AS (
  SELECT conv_id, depth, chars, min(conv_id) OVER (PARTITION BY depth, path) AS node, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM prefixes
), nodes AS (
  SELECT depth, node, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY depth, node
), parents AS (
  SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN members p ON p.conv_id = n.node AND p.depth = n.depth - 1
), counted AS (
  SELECT p.depth, p.node, any_value(p.parent) AS parent, any_value(p.n_convs) AS n_convs, any_value(p.chars) AS chars, any_value(p.ends_sha256) AS ends_sha256, count(c.node) AS n_children
  FROM parents p LEFT JOIN parents c ON c.parent = p.node AND c.depth = p.depth + 1 GROUP BY p.depth, p.node
), summed AS (
  SELECT m.depth, m.node, count(*) FILTER (c.n_children = 0) AS n_leaves, CAST(sum((c.n_convs - 1) * c.chars) AS BIGINT) AS saved
  FROM counted c JOIN members m ON m.conv_id = c.node AND m.depth <= c.depth GROUP BY m.depth, m.node
)
SELECT c.node AS conv_id, c.depth, c.parent AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved AS saved_tokens, c.ends_sha256
FROM counted c JOIN summed s USING (depth, node)
"""
