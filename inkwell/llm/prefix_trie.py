"""The prefix trie of conversations: which share their first turns, and what sharing saves.

Every prefix of a conversation has a digest, the XOR of one 128-bit key for each
of its turns, made of depth, role and text; XOR can be summed in pieces, so a
conversation of any length is digested by many tasks. A prefix is owned by the
smallest conversation that has it. Owning is monotone: who owns a prefix owns
all its longer ones. So the first depth that a conversation owns is found by
binary search, all conversations at once: each round joins one probed prefix of
each open conversation with the minima of the digests that several have. The
owned depths of a conversation are its chain, each node of the trie is in one
chain, and the owner of the last depth not owned is the parent of the chain.

Sums over subtrees go bottom-up over chains by doubling: after k rounds a chain
holds the sums of all chains less than 2**k below it. Sums inside a chain are
running sums in blocks of ``BLOCK`` depths.

Defined results: turns are ordered by turn (null first), then role, then text;
null roles and texts are empty; repeated rows are separate turns; rows without
conv_id belong to no conversation and are left out; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, text_of, written

#: Depths whose digests and sums are run over in one window, and bytes of text that one task numbers.
BLOCK, TASK_BYTES = 4096, 64 << 20
#: Rows of a conversation keep their order in this many bits of a row number.
ROW_BITS = 33


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, number, turn_key, chars), written: the turns of each conversation from 0, without a task for a whole conversation."""
    role, text = text_of(F.col("role")), text_of(F.col("text"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    n_bytes = turns.agg(F.sum(F.octet_length("role") + F.octet_length("text") + 16)).first()[0] or 0
    ranged = turns.repartitionByRange(max(16, math.ceil(n_bytes / TASK_BYTES)), "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    ranged = ranged.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = written(ranged.select("conv_id", F.monotonically_increasing_id().alias("at"), key.alias("turn_key"), F.length("text").cast("long").alias("chars")), "turns")
    part = F.shiftright("at", ROW_BITS)
    pieces = rows.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Few conversations lie in more than one range; the others start from nothing.
    pieces = pieces.select(F.col("conv_id").alias("_ik_conv"), F.col("part").alias("_ik_part"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    at = rows.join(pieces, (F.col("conv_id") == F.col("_ik_conv")) & (part == F.col("_ik_part")))
    numbered = written(at.select("conv_id", (F.col("at") - F.col("first") + F.col("ahead")).alias("number"), "turn_key", "chars"), "numbered")
    discard(rows)
    return numbered


def rebuilt(turns: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, turn_key, chars) and all conversations (conv_id, n_turns) after the first turns are replaced.

    Conversation c takes its first h turns from conversation c - c % block, where
    h is the crc32 of c in decimal modulo ``heads``, and goes on with its own.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    c = F.col("conv_id")
    convs = sizes.select("conv_id", "n_own", (c - c % block).alias("base"), F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(heads)).cast("long").alias("h"))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(of_base, "base", "left").withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0)))).drop("n_base")
    convs = written(convs.withColumn("n_turns", F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))), "convs")
    head = turns.where(F.col("number") < heads - 1).select(F.col("conv_id").alias("base"), "number", "turn_key", "chars")
    head = head.join(convs.select("base", "conv_id", "h"), "base").where("number < h").select("conv_id", (F.col("number") + 1).alias("depth"), "turn_key", "chars")
    own = turns.join(convs.select("conv_id", "h", "n_head"), "conv_id").where("number >= h")
    own = own.select("conv_id", (F.col("number") - F.col("h") + F.col("n_head") + 1).alias("depth"), "turn_key", "chars")
    return head.union(own), convs.select("conv_id", "n_turns")


def run_over(rows: DataFrame, sums: dict[str, tuple], down: bool = False) -> DataFrame:
    """``rows`` with running aggregates over the depths of each conversation, this one included.

    ``sums`` maps a new column to an aggregate and the way to add two of it.
    ``down`` starts from the last depth. In blocks, so that no task holds a long
    conversation; those of one block, nearly all, need nothing from the others.
    """
    block = F.floor(F.col("depth") / BLOCK)
    depth, at = (F.col("depth").desc(), F.col("_ik_block").desc()) if down else (F.col("depth"), F.col("_ik_block"))
    blocked = rows.withColumn("_ik_block", block)
    inside = Window.partitionBy("conv_id", "_ik_block").orderBy(depth).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("conv_id", "_ik_block").agg(*[agg.alias(f"_ik_t_{c}") for c, (agg, *_) in sums.items()])
    over = lambda c: sums[c][2](F.col(f"_ik_t_{c}")).over(before).alias(f"_ik_a_{c}")
    ahead = totals.select(F.col("conv_id").alias("_ik_conv"), F.col("_ik_block").alias("_ik_of"), *[over(c) for c in sums])
    ahead = ahead.where(F.col(f"_ik_a_{next(iter(sums))}").isNotNull())
    local = blocked.withColumns({c: agg.over(inside) for c, (agg, *_) in sums.items()})
    both = local.join(ahead, (F.col("conv_id") == F.col("_ik_conv")) & (F.col("_ik_block") == F.col("_ik_of")), "left")
    return both.withColumns({c: add(F.col(c), F.coalesce(f"_ik_a_{c}", F.lit(0))) for c, (_, add, _) in sums.items()}).drop(
        "_ik_block", "_ik_conv", "_ik_of", *[f"_ik_a_{c}" for c in sums]
    )


def prefixes_of(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, chars): two longs of digest for the first ``depth`` turns of each conversation."""
    salted = lambda k: F.xxhash64(F.lit(k), "depth", "turn_key")
    keyed = turns.select("conv_id", "depth", "chars", salted(1).alias("kx"), salted(2).alias("ky"))
    xor = lambda c: (F.bit_xor(c), lambda a, b: a.bitwiseXOR(b), F.bit_xor)
    return run_over(keyed, {"x": xor("kx"), "y": xor("ky")}).select("conv_id", "depth", "x", "y", "chars")


def chains_of(prefixes: DataFrame, shared: DataFrame, convs: DataFrame, root: int) -> DataFrame:
    """(conv_id, n_turns, first, up): the first depth that each conversation owns, and the owner of the one before.

    ``first`` is n_turns + 1 where it owns nothing; ``up`` is null for the root's own chain.
    """
    low, high = F.lit(1).cast("long"), F.col("n_turns") + 1
    at_root = F.col("conv_id") == root
    state = convs.select("conv_id", "n_turns", F.when(at_root, 0).otherwise(low).alias("lo"), F.when(at_root, 0).otherwise(high).alias("hi"), F.when(~at_root, F.lit(root)).cast("long").alias("up"))
    state = written(state, "search")
    minima = shared.select(F.col("depth").alias("_ik_depth"), F.col("x").alias("_ik_x"), F.col("y").alias("_ik_y"), "low")
    settled = state.where("lo >= hi")
    steps = [state]
    while not (open_ := steps[-1].where("lo < hi")).isEmpty():
        probes = open_.withColumn("mid", F.expr("(lo + hi) div 2"))
        digests = prefixes.select(F.col("conv_id").alias("_ik_conv"), F.col("depth").alias("_ik_at"), "x", "y")
        probed = probes.join(digests, (F.col("conv_id") == F.col("_ik_conv")) & (F.col("mid") == F.col("_ik_at")))
        found = probed.join(minima, (F.col("mid") == F.col("_ik_depth")) & (F.col("x") == F.col("_ik_x")) & (F.col("y") == F.col("_ik_y")), "left")
        owned = F.coalesce(F.col("low") == F.col("conv_id"), F.lit(True))
        moved = found.select(
            "conv_id", "n_turns", F.when(owned, F.col("lo")).otherwise(F.col("mid") + 1).alias("lo"),
            F.when(owned, F.col("mid")).otherwise(F.col("hi")).alias("hi"), F.when(owned, F.col("up")).otherwise(F.col("low")).alias("up"),
        )
        steps.append(written(moved, "search"))
        settled = settled.union(steps[-1].where("lo >= hi"))
    chains = written(settled.select("conv_id", "n_turns", F.col("lo").alias("first"), "up"), "chains")
    discard(*steps)
    return chains


def summed_below(chains: DataFrame, values: list[str]) -> DataFrame:
    """``values`` of each chain (conv_id, up, values) summed over it and all chains below, in a logarithmic number of rounds."""
    rounds = [written(chains.select("conv_id", "up", *values), "sums")]
    while not rounds[-1].where("up IS NOT NULL").isEmpty():
        now = rounds[-1]
        sent = now.where("up IS NOT NULL").groupBy(F.col("up").alias("_ik_to")).agg(*[F.sum(v).alias(f"_ik_{v}") for v in values])
        above = now.where("up IS NOT NULL").select(F.col("conv_id").alias("_ik_conv"), F.col("up").alias("_ik_next"))
        more = now.join(sent, F.col("conv_id") == F.col("_ik_to"), "left").join(above, F.col("up") == F.col("_ik_conv"), "left")
        rounds.append(written(more.select("conv_id", F.col("_ik_next").alias("up"), *[(F.col(v) + F.coalesce(f"_ik_{v}", F.lit(0))).alias(v) for v in values]), "sums"))
        discard(now)
    return rounds[-1]


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of the ids of each node, which come sorted; a node of any size is hashed as its ids pass by."""
    node, digest = None, None
    for frame in frames:
        out, begin = [], 0
        owner, depth, ids = frame["owner"].to_numpy(), frame["n_turns"].to_numpy(), frame["conv_id"].to_numpy()
        cuts = [*(((owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])).nonzero()[0] + 1), len(frame)]
        for end in cuts if len(frame) else []:
            text = ",".join(map(str, ids[begin:end].tolist())).encode()
            if (owner[begin], depth[begin]) == node:
                digest.update(b"," + text)
            else:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (owner[begin], depth[begin]), hashlib.sha256(text)
            begin = end
        yield pd.DataFrame(out, columns=["owner", "depth", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["owner", "depth", "ends_sha256"])


def conversation_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (conv_id, depth from 1, turn_key, chars) and ``convs`` every
    (conv_id, n_turns), those without turns too.
    """
    convs = written(convs, "sizes")
    root, n_all = convs.agg(F.min("conv_id"), F.count("*")).first()
    root = root or 0
    prefixes = written(prefixes_of(turns), "prefixes")
    shared = prefixes.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    shared = written(shared, "shared")
    chains = chains_of(prefixes, shared, convs, root)

    # The nodes: owned prefixes, and the root.
    owned = prefixes.select("conv_id", "depth", "chars").join(chains.select("conv_id", "first", "n_turns", "up"), "conv_id").where("depth >= first")
    top = chains.where("first = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "first", "n_turns", "up")
    counts = shared.select(F.col("low").alias("conv_id"), "depth", "n").union(top.select("conv_id", "depth", F.lit(n_all).cast("long").alias("n")))
    attached = chains.where("first > 0 AND first <= n_turns").groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("n_attached"))
    nodes = owned.union(top).join(counts, ["conv_id", "depth"], "left").join(attached, ["conv_id", "depth"], "left")
    n_convs, n_attached = F.coalesce("n", F.lit(1)).cast("long"), F.coalesce("n_attached", F.lit(0)).cast("long")
    nodes = nodes.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("up")).alias("parent_conv_id"), n_convs.alias("n_convs"),
        (n_attached + (F.col("depth") < F.col("n_turns")).cast("long")).alias("n_children"), ((n_convs - 1) * F.col("chars")).alias("saved"),
    )
    nodes = written(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "nodes")
    discard(prefixes, shared)

    # Chains bottom-up, then the depths of each chain.
    own = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    totals = summed_below(chains.where("first <= n_turns").select("conv_id", "up").join(own, "conv_id"), ["saved", "leaf"])
    below = totals.select(F.col("conv_id").alias("_ik_conv"), F.col("saved").alias("_ik_saved"), F.col("leaf").alias("_ik_leaf"))
    below = below.join(chains.where("first > 0").select(F.col("conv_id").alias("_ik_conv"), "first", "up"), "_ik_conv")
    below = below.groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.sum("_ik_saved").alias("more_saved"), F.sum("_ik_leaf").alias("more_leaf"))
    weighed = nodes.join(below, ["conv_id", "depth"], "left").withColumns({
        "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)), "leaf": F.col("leaf") + F.coalesce("more_leaf", F.lit(0)),
    }).drop("more_saved", "more_leaf")
    add: tuple = (lambda a, b: a + b, F.sum)
    out = run_over(weighed, {"saved_tokens": (F.sum("saved"), *add), "n_leaves": (F.sum("leaf"), *add)}, down=True)

    ends = chains.select(F.when(F.col("first") <= F.col("n_turns"), F.col("conv_id")).otherwise(F.col("up")).alias("owner"), "n_turns", "conv_id")
    ends = ends.repartition("owner", "n_turns").sortWithinPartitions("owner", "n_turns", "conv_id").mapInPandas(_ends, "owner long, depth long, ends_sha256 string")
    ends = ends.select(F.col("owner").alias("conv_id"), "depth", "ends_sha256")
    out = out.join(ends, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations after their first turns are replaced by those of their block's first one."""
    numbered = numbered_turns(conversations)
    trie = conversation_trie(*rebuilt(numbered))
    discard(numbered)
    return trie
