"""A trie of sequences' prefixes by van Emde Boas recursion, on conversations as sequences of turns.

Sequences are cut at half their depth, the halves again, and so on down to single steps; all cuts of one level are made at once. Going
up, every block of steps gets a name from those of its halves. Going down, the upper half of a block stays in its block's group,
and the lower half gets a group of its own, named by the block's group and the upper half: the name of the cut prefix. So the
upper tries and all lower forests of a level are found side by side, and after the last level every prefix has a name (128 bits of
SHA-256) that equal prefixes share. Levels below CHUNK steps are made within rows that hold a chunk of a sequence each;
chunks of longer sequences are the steps of the next such recursion.

Counts of a node are one aggregate. What is summed over subtrees is grafted upward level by level: a lower forest's totals are added up for
the cut node that it hangs from, and given to that node's ancestors in the upper half, which its smallest member's path names. A level
adds each total once to each node of an upper half, so all levels together move (steps x levels) small rows at most, and later
levels fewer and fewer.

Hot nodes are sums with partial aggregates; rows of a sequence that holds a large share of all steps are numbered and joined by
ranges and by broadcast of the few heavy keys (fewer than HEAVY by their definition). A node's ending members are hashed in two steps, of
which the second streams pieces of text. Intermediate tables are written to the shared folder, so lost executors repeat one step.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, stored
from .periodic_runs import CRC32

#: Steps of a sequence that one row holds, a power of two.
CHUNK = 64
#: A key is heavy if it has over a HEAVY-th of all rows; there can't be that many such keys.
HEAVY = 1000
#: Bytes of one piece of a node's list of ending members.
PIECE = 1 << 16
ROOT = bytes(16)


def _pair(x: str, y: str) -> str:
    """The name of two names, in SQL."""
    return f"substring(unhex(sha2(concat({x}, {y}), 256)), 1, 16)"


def _power(k: int) -> int:
    return 1 << k


def join_by_weight(many: DataFrame, few: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """many joined with few, which has one row a key and their number of rows in many: heavy keys are broadcast, the others meet by key."""
    heavy, light = few.where(F.col(rows) * HEAVY > total), few.where(F.col(rows) * HEAVY <= total)
    rest = many.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return many.join(F.broadcast(heavy), key).unionByName(rest)


def numbered(steps: DataFrame, seq: str, order: list[str]) -> DataFrame:
    """steps with pos, the place in the sequence from 0. Ranges of (sequence, order) are numbered side by side; the count that a range takes
    over from those before it is one row for each range that a sequence goes over, fewer than two a range."""
    n = partitions(steps.sparkSession)
    dealt = stored(steps.repartitionByRange(n, seq, *order).withColumn("_part", F.spark_partition_id()), "trie-steps")
    counts = dealt.groupBy(seq, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(seq).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.withColumn("_before", before).where("_before is not null").select(seq, "_part", "_before")
    own = F.row_number().over(Window.partitionBy(seq, "_part").orderBy(*order)) - 1
    placed = dealt.withColumn("pos", own).join(F.broadcast(carried), [seq, "_part"], "left")
    return placed.withColumn("pos", F.col("pos") + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def named(steps: DataFrame, longest: int) -> DataFrame:
    """seq, chunk, names, weights: the names of the prefixes before the chunk's first step, after it, after the second, and so on.

    steps: seq, pos, item (binary), weight.
    """
    k_top = CHUNK.bit_length() - 1
    each = F.sort_array(F.collect_list(F.struct("pos", "item", "weight")))  # at most CHUNK entries
    got = steps.groupBy("seq", F.expr(f"pos div {CHUNK}").alias("chunk")).agg(each.alias("steps"))
    got = got.select("seq", "chunk", F.size("steps").alias("m"), F.col("steps.item").alias("n0"), F.col("steps.weight").alias("weights"))
    for k in range(1, k_top + 1):  # going up: blocks of 2^k steps
        name = _pair(f"n{k - 1}[2 * i]", f"n{k - 1}[2 * i + 1]")
        got = got.withColumn(f"n{k}", F.expr(f"if(m < {_power(k)}, cast(array() as array<binary>), transform(sequence(0, cast(m div {_power(k)} as int) - 1), i -> {name}))"))
    got = got.withColumn("whole", F.get(f"n{k_top}", F.lit(0)))
    if longest > CHUNK:
        got = stored(got, "trie-chunks")
        upper = got.where(f"chunk > 0 or m = {CHUNK}").select("seq", F.col("chunk").alias("pos"), F.col("whole").alias("item"), F.lit(0).cast("bigint").alias("weight"))
        upper = named(upper, -(-longest // CHUNK))
        every = F.expr(f"explode(transform(sequence(0, size(names) - 2), i -> struct(chunk * {CHUNK} + i as chunk, names[i] as before, names[i + 1] as after)))")
        got = got.join(upper.select("seq", every.alias("of")).select("seq", "of.*"), ["seq", "chunk"], "left")
        got = got.withColumn("before", F.coalesce("before", F.lit(ROOT)))
    else:
        got = got.withColumn("before", F.lit(ROOT)).withColumn("after", F.expr(_pair("before", "whole")))
    got = got.withColumn(f"g{k_top}", F.when(F.col("m") == CHUNK, F.array("before", "after")).otherwise(F.array("before")))
    for k in range(k_top - 1, -1, -1):  # going down: groups of the halves of blocks of 2^(k+1) steps
        group = f"g{k + 1}[cast(j div 2 as int)]"
        got = got.withColumn(f"g{k}", F.expr(f"transform(sequence(0, cast(m div {_power(k)} as int)), j -> if(j % 2 = 0, {group}, {_pair(group, f'n{k}[j - 1]')}))"))
    return got.select("seq", "chunk", F.col("g0").alias("names"), "weights")


def prefix_trie(steps: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie, and the node where each sequence ends.

    steps: seq, pos (from 0, without holes), item (binary, equal for equal steps), weight (bigint, a function of item). members: seq, each
    once, those without steps too. Nodes: node, depth, seq (smallest member), parent_seq, n_members, n_children, n_leaves, saved (over the
    subtree: members less one, times the weight of the last step). Ends: node, seq. Without members there are no nodes; without
    steps there is the root. Rows with a null seq must not come.
    """
    longest = (steps.agg(F.max("pos").alias("p")).first()["p"] or 0) + 1
    paths = stored(named(steps, longest), "trie-paths")
    entry = F.expr(f"explode(transform(sequence(0, size(names) - 2), i -> struct(names[i + 1] as node, names[i] as parent, chunk * {CHUNK} + i as pos, weights[i] as weight)))")
    visits = paths.select("seq", entry.alias("of")).select("seq", "of.*")
    counted = [F.min("seq").alias("seq"), F.count("*").alias("n_members")]
    found = visits.groupBy("node").agg(*counted, F.min("parent").alias("parent"), F.min("pos").alias("pos"), F.min("weight").alias("weight"))
    root = members.agg(*counted).where("n_members > 0").select(F.lit(ROOT).alias("node"), "seq", "n_members", F.lit(None).cast("binary").alias("parent"), F.lit(-1).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("weight"))
    found = stored(found.unionByName(root), "trie-found")
    children = found.groupBy("parent").agg(F.count("*").alias("n_children")).where("parent is not null").withColumnRenamed("parent", "node")
    found = stored(found.join(children, "node", "left").fillna(0, ["n_children"]), "trie-counted")
    parents = found.where("n_children > 0").select(F.col("node").alias("parent"), F.col("seq").alias("parent_seq"), F.col("n_children").alias("rows"))
    placed = join_by_weight(found.where("parent is not null"), parents, "parent", "rows", found.count()).drop("rows")
    placed = placed.unionByName(found.where("parent is null").withColumn("parent_seq", F.lit(None).cast("bigint")))
    own = [(F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_members") - 1) * F.col("weight")).alias("saved")]
    nodes = stored(placed.select("node", "seq", "n_members", "parent", "parent_seq", "pos", "n_children", *own), "trie-nodes")

    summed = [F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")]
    total = nodes.select("node", "parent", "parent_seq", "pos", "n_leaves", "saved")
    for k in range((longest - 1).bit_length()):  # grafts: forests of lower halves of 2^k steps
        size, top = _power(k), F.col("pos") % _power(k + 1) == _power(k)
        forests = total.where(top).groupBy("parent", "pos").agg(F.max("parent_seq").alias("seq"), *summed).drop("parent")
        first = f"(pos - {size})"
        if size <= CHUNK:
            forests = forests.select("seq", F.expr(f"{first} div {CHUNK}").alias("chunk"), F.expr(f"cast({first} % {CHUNK} as int)").alias("at"), "n_leaves", "saved")
        else:
            forests = forests.select("seq", F.explode(F.expr(f"sequence({first} div {CHUNK}, (pos - 1) div {CHUNK})")).alias("chunk"), F.lit(0).alias("at"), "n_leaves", "saved")
        reached = F.expr(f"explode(transform(sequence(at, at + {min(size, CHUNK) - 1}), i -> struct(names[i + 1] as node, names[i] as parent, chunk * {CHUNK} + i as pos)))")
        gained = forests.join(paths.select("seq", "chunk", "names"), ["seq", "chunk"]).select(reached.alias("of"), "n_leaves", "saved").select("of.*", "n_leaves", "saved")
        gained = stored(gained.groupBy("node", "parent", "pos").agg(*summed), f"trie-graft-{k}")
        total = total.unionByName(gained.withColumn("parent_seq", F.lit(None).cast("bigint")))
    below = total.where("pos = 0").select(F.lit(ROOT).alias("node"), "n_leaves", "saved")
    total = total.select("node", "n_leaves", "saved").unionByName(below).groupBy("node").agg(*summed)
    nodes = nodes.drop("n_leaves", "saved").join(total, "node").withColumn("depth", F.col("pos") + 1).drop("pos", "parent")

    last = paths.groupBy("seq").agg(F.max_by(F.element_at("names", -1), "chunk").alias("node"))
    return nodes, members.join(last, "seq", "left").select(F.coalesce("node", F.lit(ROOT)).alias("node"), "seq")


def listed_sha256(ends: DataFrame, key: str = "node", value: str = "seq") -> DataFrame:
    """key, sha256: of the key's values in ascending order, decimal, joined by commas. No task holds a key's whole list: ranges of (key, value)
    are written out as pieces of text, and each key's pieces are streamed through the hash in their order."""
    kind = ends.schema[key].dataType.simpleString()

    def pieces(batches):
        at, first, parts, size = None, None, [], 0
        names = ["key", "first", "piece"]

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(parts)], pa.string())], names=names)

        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if parts and (k != at or size > PIECE):
                    yield out()
                    parts, size = [], 0
                if not parts:
                    at, first = k, v
                parts.append(str(v))
                size += 20
        if parts:
            yield out()

    def digests(batches):
        at, digest, done = None, None, []
        for batch in batches:
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != at or digest is None:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(piece.encode())
            if len(done) > 5000:
                yield told(done)
                done = []
        if digest is not None:
            done.append((at, digest.hexdigest()))
        if done:
            yield told(done)

    def told(rows):
        keys, hashes = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "sha256"])

    small_batches(ends.sparkSession)
    n = partitions(ends.sparkSession)
    rows = ends.select(F.col(key).cast("binary").alias("key"), F.col(value).cast("bigint").alias("value"))
    ranged = rows.repartitionByRange(n, "key", "value").sortWithinPartitions("key", "value").mapInArrow(pieces, "key binary, first bigint, piece string")
    streamed = ranged.repartition(n, "key").sortWithinPartitions("key", "first").select("key", "piece").mapInArrow(digests, "key binary, sha256 string")
    return streamed.select(F.col("key").cast(kind).alias(key), "sha256")


def turn_steps(conversations: DataFrame) -> DataFrame:
    """seq, pos, item, weight of a table of turns (conv_id, turn, role, text): steps in the order of turn, null first. Null role and text are
    empty; equal turns go by a hash of role and text; rows without a conv_id are left out. The weight is the number of words."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    item = F.substring(F.unhex(F.sha2(F.concat(F.sha2(role, 256), text), 256)), 1, 16)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("seq"), "turn", item.alias("item"), words.alias("weight"))
    return numbered(turns, "seq", ["turn", "item"]).select("seq", F.col("pos").cast("bigint").alias("pos"), "item", "weight")


HEAD = 3  # turns of another conversation that one can begin with


def rebuilt(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, members) of conversations that begin with the first h turns of the conversation c - c % 20, h = crc32(c) % 4."""
    heads = steps.where(f"seq % 20 = 0 and pos < {HEAD}").groupBy(F.col("seq").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "item", "weight"))).alias("head"))  # at most HEAD
    own = steps.groupBy("seq").agg(F.count("*").alias("rows"))
    own = own.withColumn("h", (F.crc32(F.col("seq").cast("string").cast("binary")) % 4).cast("int")).withColumn("base", F.expr("seq - seq % 20"))
    own = own.join(heads, "base", "left").select("seq", "rows", "h", F.slice(F.coalesce("head", F.array()), 1, F.col("h")).alias("head"))
    own = stored(own, "trie-conversations")
    begun = own.select("seq", F.explode("head").alias("of")).select("seq", "of.*")
    shifts = own.select("seq", "rows", "h", F.size("head").alias("taken"))
    rest = join_by_weight(steps, shifts, "seq", "rows", steps.count()).where("pos >= h")
    rest = rest.select("seq", (F.col("pos") - F.col("h") + F.col("taken")).cast("bigint").alias("pos"), "item", "weight")
    return stored(begun.unionByName(rest), "trie-rebuilt"), own.select("seq")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    steps, members = rebuilt(stored(turn_steps(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns"))
    nodes, ends = prefix_trie(steps, members)
    got = nodes.join(listed_sha256(ends), "node", "left")
    return got.select(
        F.col("seq").alias("conv_id"), "depth", F.col("parent_seq").alias("parent_conv_id"), F.col("n_members").alias("n_convs"), "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


OP11_SQL = rf"""
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, h % 4 AS h FROM (SELECT conv_id, {CRC32.format("conv_id")} AS h FROM (SELECT DISTINCT conv_id FROM o))),
r AS (
  SELECT c.conv_id, 0 AS part, o.k, role, text FROM c JOIN o ON o.conv_id = c.base AND o.k <= c.h
  UNION ALL SELECT c.conv_id, 1, o.k, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.h),
p AS (SELECT conv_id, row_number() OVER w AS d, role, text, list(sha256(role) || sha256(text)) OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
v AS (
  SELECT conv_id, d, sha256(array_to_string(path, ' ')) AS node, CASE WHEN d > 1 THEN sha256(array_to_string(path[:d - 1], ' ')) ELSE '' END AS parent,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM p
  UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c),
n AS (SELECT node, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM v GROUP BY node, d),
kids AS (SELECT parent AS node, count(*) AS n FROM n WHERE parent IS NOT NULL GROUP BY parent),
own AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
below AS (
  SELECT v.node, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM own u JOIN v ON v.conv_id = u.conv_id AND v.d <= u.d GROUP BY v.node),
ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS said
  FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM v) WHERE d = last GROUP BY node)
SELECT own.conv_id, own.d::BIGINT AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves,
  below.saved::BIGINT AS saved_tokens, sha256(coalesce(said, '')) AS ends_sha256
FROM own JOIN below USING (node) LEFT JOIN ends USING (node) LEFT JOIN own up ON up.node = own.parent
"""
