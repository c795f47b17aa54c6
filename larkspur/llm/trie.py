"""Conversation prefix trie by partition refinement.

All conversations start in one class. Turn by turn an active class is split by its members' next turn; a class of one
sequence is retired, and its tail is emitted as a chain of nodes without further splitting; counts are then folded back from the
deepest level to the root. Equal conversations are one sequence with a weight. A class with more turns left than TASK_TURNS is split
by a job of the cluster, smaller ones are refined in tasks, many at once, by sorting arrays. Turns are known by 128-bit hashes, and
texts are read once. No conversation is gathered whole: tails are rows from their reading to the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Scratch, column, joined

#: Turns that are left in a class from which on it is split by a job of its own.
TASK_TURNS = 4096
#: Turns that a task refines at once, at least.
BATCH_TURNS = 1 << 16
#: Ids of a sequence that travel as one piece of text.
PIECE_IDS = 8192
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"
SEQ = ["len", "a", "b"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, turn_hash, words of each row that has a conv_id; null role and text are empty. A word is a run of no ASCII white space."""
    role, text = (F.coalesce(column(c), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)  # tells role and text apart
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return conversations.filter(column("conv_id").isNotNull()).select(column("conv_id").cast("long").alias("conv_id"), column("turn").alias("turn"), role.alias("role"), F.unhex(F.md5(both)).alias("turn_hash"), words.cast("long").alias("words"))


def numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """turn_rows as conv_id, pos (from 0, by turn, null first, then role and hash), turn_hash, words, before (words of earlier turns).

    A range of all rows is a task's, so a long conversation is many tasks'; what a task doesn't know, the turns and words
    that its first conversation has in earlier ranges, is added by a join with at most a row for each range.
    """

    def run(batches):
        from pyspark import TaskContext

        part, conv, pos, before = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            ids, words = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            size = np.diff(np.append(start, len(ids)))
            own = np.arange(len(ids)) - np.repeat(start, size)
            total = np.cumsum(words) - words
            own_before = total - np.repeat(total[start], size)
            if ids[0] == conv:
                own[: size[0]] += pos
                own_before[: size[0]] += before
            conv, pos, before = ids[-1], int(own[-1]) + 1, int(own_before[-1] + words[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), batch.column(1), batch.column(2), pa.array(own_before), pa.array(np.full(len(ids), part, np.int32))], names=["conv_id", "pos", "turn_hash", "words", "before", "part"])

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("turn_hash")]
    ranges = scratch.stage(turns, "turns").repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn_hash", "words")
    rows = scratch.stage(ranges.mapInArrow(run, "conv_id long, pos long, turn_hash binary, words long, before long, part int"), "ranges")
    held = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a range has earlier ranges
    later = held.select("conv_id", "part", F.sum("n").over(earlier).alias("n"), F.sum("w").over(earlier).alias("w")).filter("n is not null")
    out = rows.join(F.broadcast(scratch.stage(later, "later")), ["conv_id", "part"], "left")
    more = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
    return out.select("conv_id", more("pos", "n"), "turn_hash", "words", more("before", "w"))


def sequences(turns: DataFrame, conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """rep (smallest id of equal conversations), weight, len, total (words), ends_sha256 (of their ids), of turns (conv_id, pos, turn_hash, words) and conversations (conv_id)."""
    place = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "turn_hash"))
    facts = turns.groupBy("conv_id").agg(F.count("*").alias("len"), F.sum("words").alias("total"), place(1).alias("a"), place(2).alias("b"))
    facts = scratch.stage(conversations.join(facts, "conv_id", "left").na.fill(0), "facts")
    return facts.groupBy(*SEQ).agg(F.count("*").alias("weight"), F.min("conv_id").alias("rep"), F.max("total").alias("total")).join(_hashed_ids(facts.select(*SEQ, "conv_id")), SEQ)


def _hashed_ids(members: DataFrame) -> DataFrame:
    """SEQ, ends_sha256: of the ids, ascending, joined by commas. Ranges of ids become pieces of text in many tasks; one hash goes over a sequence's pieces."""
    kinds = [pa.int64()] * 3

    def pieces(batches):
        for batch in batches:
            key, ids = np.stack([batch.column(k).to_numpy() for k in range(3)]), batch.column(3).to_numpy()
            if not len(ids):
                continue
            new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
            start = np.flatnonzero(new)
            cuts = np.concatenate([np.arange(a, b, PIECE_IDS) for a, b in zip(start, np.append(start[1:], len(ids)), strict=True)])
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, np.append(cuts[1:], len(ids)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[cuts], t) for k, t in zip(key, kinds, strict=True)), pa.array(ids[cuts]), pa.array(texts)], names=[*SEQ, "first", "piece"])

    def hashes(batches):
        key, digest, done = None, None, []
        for batch in batches:
            for *own, _, piece in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if own == key:
                    digest.update(b"," + piece.encode())
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(piece.encode())
            if len(done) > PIECE_IDS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*SEQ, "ends_sha256"])
                done = []
        if key is not None:
            done.append((*key, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*SEQ, "ends_sha256"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seq = "len long, a long, b long"
    parts = members.repartitionByRange(n, *SEQ, "conv_id").sortWithinPartitions(*SEQ, "conv_id").mapInArrow(pieces, f"{seq}, first long, piece string")
    return parts.repartition(*SEQ).sortWithinPartitions(*SEQ, "first").mapInArrow(hashes, f"{seq}, ends_sha256 string")


def refined(cls, depth, parent, rep, weight, length, total, turn, top_words, words, before):
    """Splits whole classes, all at once. Arrays of rows in order of class, rep, pos, from each class's depth on; turn is two unsigned numbers a row; a rep without further turns has one row.

    -> nodes (conv, depth, parent conv, n, children, leaves, saved, ends: rep or -1), those of the classes themselves first, the rows where
    classes start, and (row of a retired rep's first own turn, parent conv).
    """
    first = np.flatnonzero(np.append(True, (cls[1:] != cls[:-1]) | (rep[1:] != rep[:-1])))
    node_of = np.cumsum(np.append(True, cls[first][1:] != cls[first][:-1])) - 1
    tops = first[np.flatnonzero(np.append(True, node_of[1:] != node_of[:-1]))]
    made = {"conv": [rep[tops]], "depth": [depth[tops]], "parent": [parent[tops]], "up": [np.full(len(tops), -1)], "words": [top_words[tops]], "n": [np.bincount(node_of, weight[first]).astype(np.int64)]}
    tails, tail_up, ends, step = [], [], [], 0
    active, base = np.arange(len(first)), 0
    while len(active):
        row = first[active]
        done = length[row] == depth[row] + step
        ends.append(np.stack([node_of[active[done]], rep[row[done]]]))
        active = active[~done]
        at = first[active] + step
        order = np.lexsort((active, turn[at, 1], turn[at, 0], node_of[active]))
        active, at = active[order], at[order]
        same = (node_of[active][1:] == node_of[active][:-1]) & (turn[at][1:] == turn[at][:-1]).all(axis=1)
        group = np.cumsum(np.append(True, ~same)) - 1 if len(active) else np.zeros(0, int)
        size = np.bincount(group) if len(active) else np.zeros(0, int)
        start = np.cumsum(size) - size
        single = size[group] == 1
        tails.append(at[single])
        tail_up.append(node_of[active[single]])
        new = start[size > 1]
        base += len(made["up"][-1])
        made["conv"].append(rep[at[new]])
        made["depth"].append(depth[at[new]] + step + 1)
        made["up"].append(node_of[active[new]])
        made["parent"].append(np.concatenate(made["conv"])[node_of[active[new]]] if len(new) else np.zeros(0, np.int64))
        made["words"].append(words[at[new]])
        made["n"].append(np.bincount(group, weight[at], len(size)).astype(np.int64)[size > 1])
        number = np.cumsum(size > 1) - 1 + base
        active, group = active[~single], group[~single]
        node_of[active] = number[group]
        step += 1
    levels = [len(u) for u in made["up"]]
    out = {k: np.concatenate(v) for k, v in made.items()}
    children, leaves, saved = (np.zeros(len(out["up"]), np.int64) for _ in range(3))
    ended = np.full(len(out["up"]), -1)
    for node, who in ends:
        ended[node] = who
    tails, tail_up = np.concatenate(tails), np.concatenate(tail_up)
    np.add.at(children, tail_up, 1)
    np.add.at(leaves, tail_up, 1)
    np.add.at(saved, tail_up, (weight[tails] - 1) * (total[tails] - before[tails]))
    stop = len(out["up"])
    for size in reversed(levels):  # fold back
        own = np.arange(stop - size, stop)
        leaves[own[children[own] == 0]] = 1
        saved[own] += (out["n"][own] - 1) * out["words"][own]
        own = own[out["up"][own] >= 0]
        np.add.at(children, out["up"][own], 1)
        np.add.at(leaves, out["up"][own], leaves[own])
        np.add.at(saved, out["up"][own], saved[own])
        stop -= size
    return {**out, "children": children, "leaves": leaves, "saved": saved, "ends": ended}, tops, (tails, out["conv"][tail_up])


REFINED = f"up binary, {NODE}, since long"


def _refine_small(rows: DataFrame) -> DataFrame:
    """The nodes of small classes (up: the class above, of a class's own node only), and, with since, the depth where its tail starts, each retired rep as conv_id."""

    def one(table: pa.Table):
        c = {k: table.column(k).combine_chunks() for k in table.column_names}
        get = lambda k: c[k].fill_null(-1).to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(t if t is not None else bytes(16) for t in c["turn_hash"].to_pylist()), ">u8").reshape(-1, 2)
        codes = c["class"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
        nodes, tops, (tails, parents) = refined(codes, get("depth"), get("parent"), get("rep"), get("weight"), get("len"), get("total"), raw, get("top_words"), get("words"), get("before"))
        size, k = len(nodes["up"]), len(tails)
        up = c["up"].take(pa.array(tops)).to_pylist() + [None] * (size - len(tops) + k)
        gone = np.append(np.zeros(size, bool), np.ones(k, bool))

        def both(own, others=None, mask=None):
            return pa.array(np.append(own, np.zeros(k) if others is None else others).astype(np.int64), mask=gone if others is None else mask)

        ends = np.append(nodes["ends"] < 0, np.ones(k, bool))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(up, pa.binary()), both(nodes["conv"], get("rep")[tails]), both(nodes["depth"]), both(nodes["parent"], parents), both(nodes["n"]), both(nodes["children"]),
                both(nodes["leaves"]), both(nodes["saved"]), both(nodes["ends"], np.zeros(k), ends), both(np.zeros(size), get("pos")[tails] + 1, ~gone),
            ],
            names=[f.split()[0] for f in REFINED.split(", ")],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size < BATCH_TURNS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.column("class")[-1]
            kinds = table.column("class").to_pylist()
            cut = len(kinds)
            while cut and kinds[cut - 1] == last.as_py():
                cut -= 1  # the last class may go on in the next batch
            if cut:
                yield from one(table.slice(0, cut))
            held, size = table.slice(cut).to_batches(), len(kinds) - cut
        if held:
            yield from one(pa.Table.from_batches(held))

    return rows.repartition("class").sortWithinPartitions("class", "rep", "pos").mapInArrow(run, REFINED)


def prefix_trie(turns: DataFrame, conversations: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """turns (conv_id, pos from 0 without gaps, turn_hash of 16 bytes, words, before), conversations (conv_id, each once) -> a row for each node.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens
    (over the subtree, (n_convs - 1) x words of the last turn), ends_sha256 (of the ids of the conversations that end there).
    Conversations without turns end at the root; equal ones share all nodes; without conversations there are no nodes.
    """
    scratch = Scratch(turns.sparkSession)
    reps = scratch.stage(sequences(turns, conversations, scratch).select("rep", "weight", "len", "total", "ends_sha256"), "sequences")
    rows = scratch.stage(joined(turns.withColumnRenamed("conv_id", "rep"), reps.filter("len > 0").select("rep", "len"), ["rep"], "len", "left_semi"), "turns")
    root = reps.agg(F.min("rep").alias("conv"), F.sum("weight").alias("n")).first()
    if root.conv is None:
        return turns.sparkSession.createDataFrame([], _RESULT)
    whole = lambda v: F.lit(v).cast("long")
    classes = reps.limit(1).select(F.lit(b"").alias("class"), F.lit(None).cast("binary").alias("up"), whole(root.conv).alias("conv"), whole(None).alias("parent"), whole(root.n).alias("n"), whole(0).alias("words"))
    members = reps.select("rep", "weight", "len", "total", F.lit(b"").alias("class"), whole(root.conv).alias("conv"))
    levels, small, tails, depth = [], [], [], 0
    while True:  # as many rounds as classes with more than task_turns turns left share turns
        following = members.filter(F.col("len") > depth).join(rows.filter(F.col("pos") == depth), "rep")
        split = following.select("rep", "weight", "len", "total", "words", "before", F.col("conv").alias("parent"), F.col("class").alias("up"), F.unhex(F.md5(F.concat("class", "turn_hash"))).alias("class"))
        split = scratch.stage(split, "split")
        facts = [F.count("*").alias("reps"), F.min("rep").alias("conv"), F.sum("weight").alias("n"), F.sum(F.col("len") - depth - 1).alias("turns"), *(F.max(c).alias(c) for c in ("words", "total", "before", "up", "parent"))]
        found = scratch.stage(split.groupBy("class").agg(*facts), "found")
        single, big = F.col("reps") == 1, (F.col("reps") > 1) & (F.col("turns") > task_turns)
        tails.append(found.filter(single).select(F.col("conv").alias("rep"), whole(depth + 1).alias("since"), "parent"))
        several = found.filter(~single).select("class", "reps", "up", "parent", "conv", F.col("words").alias("top_words"), big.alias("big"), whole(depth + 1).alias("depth"))
        several = scratch.stage(joined(split.select("rep", "weight", "len", "total", "class"), several, ["class"], "reps"), "several")
        small.append(several.filter(~F.col("big")))
        ends = members.filter(F.col("len") == depth).select("class", F.col("rep").alias("ends"))
        levels.append((depth, classes, ends, found.filter(single).select("up", whole(1).alias("leaves"), ((F.col("n") - 1) * (F.col("total") - F.col("before"))).alias("saved"))))
        members = several.filter("big").select("rep", "weight", "len", "total", "class", "conv")
        classes = found.filter(big).select("class", "up", "conv", "parent", "n", "words")
        depth += 1
        if classes.isEmpty():
            break
    few = small[0]
    for s in small[1:]:
        few = few.unionByName(s)
    own = rows.select(F.col("rep").alias("own"), "pos", "turn_hash", "words", "before")
    few = few.join(own, (F.col("rep") == F.col("own")) & (F.col("pos") >= F.col("depth")), "left")
    few = few.select("rep", "class", "up", "depth", "parent", "weight", "len", "total", "top_words", "pos", "turn_hash", "words", "before")
    done = scratch.stage(_refine_small(few), "refined")
    inner = done.filter("since is null").drop("since")
    nodes, below = [inner], inner.filter("up is not null").select("depth", "up", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    for depth, own, ends, singles in reversed(levels):  # fold back
        parts = singles.unionByName(below.filter(F.col("depth") == depth + 1).drop("depth"))
        sums = parts.groupBy(F.col("up").alias("class")).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        node = own.join(sums, "class", "left").join(ends, "class", "left").select(
            "up", F.col("conv").alias("conv_id"), whole(depth).alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), zero("n_children").alias("n_children"),
            F.greatest(zero("leaves"), F.lit(1)).cast("long").alias("n_leaves"), (zero("saved") + (F.col("n") - 1) * F.col("words")).cast("long").alias("saved_tokens"), "ends",
        )
        node = scratch.stage(node, "level")
        nodes.append(node)
        below = below.unionByName(node.select("depth", "up", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    retired = done.filter("since is not null").select(F.col("conv_id").alias("rep"), "since", F.col("parent_conv_id").alias("parent"))
    for t in tails:
        retired = retired.unionByName(t)
    retired = scratch.stage(retired.join(reps, "rep").withColumn("turns", F.col("len")), "retired")
    out, hashes = _chains(rows, retired), reps.select(F.col("rep").alias("ends"), "ends_sha256")
    for n in nodes:
        out = out.unionByName(n.filter("ends is null").withColumn("ends_sha256", F.sha2(F.lit(""), 256)).drop("ends", "up")).unionByName(n.filter("ends is not null").join(hashes, "ends").drop("ends", "up"))
    scratch.drop(rows, reps, done, retired, *nodes[1:])
    return out.select(*_RESULT.fieldNames())


_RESULT = T.StructType([T.StructField(c, T.StringType() if c == "ends_sha256" else T.LongType()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")])


def _chains(rows: DataFrame, retired: DataFrame) -> DataFrame:
    """The tails of retired reps: a node for each turn from their depth on."""
    tail = joined(rows, retired, ["rep"], "turns").filter(F.col("pos") + 1 >= F.col("since"))
    last = F.col("pos") + 1 == F.col("len")
    return tail.select(
        F.col("rep").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(F.col("pos") + 1 == F.col("since"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("weight") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens"),
        F.when(last, F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie of conversations (conv_id, turn, role, text; other columns are left out), as they are.

    Turns are in order of turn, null first, then role and hash; a null role or text is empty; rows without conv_id belong to no
    conversation and are left out; repeated rows are turns of their own; a very long text is its hash and word count. No rows, no nodes.
    """
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.stage(numbered(turn_rows(conversations), scratch), "numbered")
    scratch.drop(turns)
    return prefix_trie(turns, turns.filter("pos = 0").select("conv_id"))


def regrafted(turns: DataFrame, base: Column, head: Column, scratch: Scratch, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its first `head` turns (below `most`) replaced by those of conversation `base` (all if that has fewer, none if it is absent): (turns, conversations).

    base and head are functions of conv_id.
    """
    sized = scratch.stage(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    early = turns.filter(F.col("pos") < most)
    slots = F.array_sort(F.collect_list(F.struct("pos", "turn_hash", "words", "before")))  # at most `most`
    asked = sized.select("conv_id", "n", base.alias("base"), head.alias("head"))
    heads = early.join(sized.select(base.alias("conv_id")).distinct(), "conv_id", "left_semi").groupBy(F.col("conv_id").alias("base")).agg(slots.alias("theirs"))
    mine = early.groupBy("conv_id").agg(slots.alias("mine"))
    info = asked.join(heads, "base", "left").join(mine, "conv_id")
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n.cast("int")), F.lit(0).cast("long"), lambda s, t: s + t["words"])
    theirs = F.slice(F.coalesce("theirs", F.array().cast("array<struct<pos:long,turn_hash:binary,words:long,before:long>>")), F.lit(1), F.col("head").cast("int"))
    info = scratch.stage(info.select("conv_id", "n", "head", theirs.alias("theirs"), total(F.col("mine"), F.col("head")).alias("cut")), "heads")
    grafted = info.select("conv_id", F.explode("theirs").alias("t")).select("conv_id", "t.*")
    shift = info.select("conv_id", "n", "head", F.size("theirs").cast("long").alias("new"), "cut", total(F.col("theirs"), F.col("head")).alias("gain"))
    own = joined(turns, shift, ["conv_id"], "n").filter(F.col("pos") >= F.col("head"))
    own = own.select("conv_id", (F.col("pos") - F.col("head") + F.col("new")).alias("pos"), "turn_hash", "words", (F.col("before") - F.col("cut") + F.col("gain")).alias("before"))
    return scratch.stage(grafted.unionByName(own), "grafted"), sized.select("conv_id")
