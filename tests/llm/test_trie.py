"""The conversation trie against a plain walk over all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("larkspur.llm.queries")

from larkspur.llm import trie  # noqa: E402
from larkspur.llm.common import Scratch  # noqa: E402
from larkspur.llm.queries import QUERIES  # noqa: E402


def ordered(rows):
    """conv_id -> [(role, text)] of (conv_id, turn, role, text) rows."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            out[c].append(((turn is not None, turn or 0), role or "", digest, text or ""))
    return {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(np.fix(c / 20)) * 20
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = own + sum(saved[k] for k in children[p])
    return sorted(str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())) for p, m in members.items())


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "clash", 1) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, class string, pos int")


def found(df):
    return sorted(str(tuple(r)) for r in df.collect())


def many(seed=3, convs=120, long=90):
    """Copies, prefixes of each other, a hot first turn, long shared prefixes, nulls, ties, repeated rows."""
    rng, rows = random.Random(seed), []
    texts = ["hi there", "", None, "a b  c", "x\x0by", "yes", "no no no", "word " * 3000]
    for c in range(convs):
        n = rng.randrange(1, 7)
        rows += [(c, t if rng.random() < 0.97 else None, "user" if t % 2 == 0 else rng.choice(["assistant", None]), texts[0] if t == 0 and c % 3 == 0 else rng.choice(texts)) for t in range(n)]
    for c in (500, 501, 502, 503):  # the same until some turns before the end
        rows += [(c, t, "user", f"turn {t}" if t < long - 10 or c < 502 else f"turn {t} of {c}") for t in range(long)]
    rows += [(600 + k, t, r, x) for k in range(40) for t, r, x in [(0, "user", "hot start"), (1, "assistant", "hot reply"), (2, "user", "bye")]]
    rows += [(700, 0, "user", "hot start"), (701, 0, "user", "hot start"), (701, 0, "user", "hot start"), (None, 0, "user", "nobody's"), (-45, 0, "user", "below zero"), (-40, 0, "user", "base below zero")]
    return rows


@pytest.mark.parametrize("task_turns", [4096, 300, 0], ids=["tasks", "both", "jobs"])
def test_whole_trie(spark, task_turns):
    rows = many(long=90 if task_turns > 300 else 20 if task_turns else 4)
    scratch = Scratch(spark)
    turns = scratch.stage(trie.numbered(trie.turn_rows(table(spark, rows).repartition(5)), scratch), "numbered")
    assert found(trie.prefix_trie(turns, turns.filter("pos = 0").select("conv_id"), task_turns)) == brute(ordered(rows))


def test_rebuilt_conversations(spark, tmp_path):
    rows = many(9, 300)
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == brute(rebuilt(ordered(rows)))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_prefix_trie"](spark, sf)) == brute(rebuilt(ordered(rows)))


def test_small_tables(spark):
    assert not trie.conversation_trie(table(spark, [])).collect()
    for rows in ([(5, None, None, None)], [(5, 0, "u", "a"), (3, 9, "u", "a")], [(5, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "u", "b")]):
        assert found(trie.conversation_trie(table(spark, rows))) == brute(ordered(rows))
    assert not trie.conversation_trie(table(spark, [(None, 0, "u", "a")])).collect()


def test_ids_of_one_sequence_travel_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    rows = [(k * 3, 0, "u", "all the same") for k in range(200)] + [(1, 0, "u", "other")]
    assert found(trie.conversation_trie(table(spark, rows).repartition(6))) == brute(ordered(rows))


def test_a_long_conversation_is_numbered_over_many_ranges(spark):
    rows = [(1, t, "u", f"turn {t}") for t in range(500)] + [(2, 0, "u", "turn 0"), (0, 0, "u", "x")]
    got = trie.numbered(trie.turn_rows(table(spark, rows).repartition(4)), Scratch(spark)).orderBy("conv_id", "pos").collect()
    assert [(r.conv_id, r.pos, r.before) for r in got] == [(0, 0, 0), *((1, t, 2 * t) for t in range(500)), (2, 0, 0)]
