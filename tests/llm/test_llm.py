"""The training-data operators against brute force, on small tables with nulls, empty and very long texts, ties and repeated rows."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("larkspur.llm.queries")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from larkspur.llm import bitpack, common, decontaminate, media, packing, sharding, simhash, substring, tokens, toxicity, unigram, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, __key string"


def words(n, seed, alphabet=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(alphabet)}" for _ in range(n))


def sample():
    """Clashing extra columns, nulls everywhere, repeated rows, copies, a very long text, odd white space."""
    shared = words(50, 99)
    texts = [words(80, i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(20, texts[0]), (21, texts[0]), (22, texts[1] + " tail"), (23, f"{words(30, 50)} {shared} {words(30, 51)}"), (24, f"{shared}\n{words(10, 52)}")]
    rows += [(25, ""), (26, None), (None, words(9, 53)), (None, None), (27, "   \n\t "), (28, words(30_000, 54, 40_000)), (29, texts[3]), (29, texts[3]), (30, "a\x0bb\xa0c 日本 語"), (31, "x"), (32, ("same words here " * 40).strip())]
    return [(i, t, "en", "clash") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def encoder(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,style", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_chunked_encoding_is_the_library_s(name, style):
    texts = ["", " ", "a  b\n\n c", "x  y\n z", "don't we'll; it's,'s", "  lead", "trail  ", "aé, bé,", "tab\t\tx \n", "“q” — z", "<|endoftext|> a|b | c", "5km,3.2%", "\x1c a", "日本 語　x", "ΣΣ AΣ.", "a\xa0 b", "É È"] + [t or "" for _, t, _, _ in sample()]
    own = tokens.ChunkTokenizer(public_tokenizers.path(name), style)
    for _ in range(2):
        ids, counts = own.encode(pa.array([t.encode() for t in texts], pa.large_binary()))
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [encoder(name)(t) for t in texts]
        tokens.CACHE_CHUNKS = 0  # nothing further is held
        own = tokens.ChunkTokenizer(public_tokenizers.path(name), style)
    tokens.CACHE_CHUNKS = 400_000


def test_op1_catches_asked_again_items_and_leaves_others(spark, none):
    schema = "item_id long, text string"
    item = "a train leaves the station at 10 km per hour and after 3 hours it meets Anna who walks at 4 km per hour toward the same old town"
    bench = spark.createDataFrame([(1, item), (2, words(30, 7)), (3, None), (4, ""), (5, "three word item")], schema)
    again = item.replace("10 km", "25 km").replace("3 hours", "7 hours").replace("Anna", "Berta").replace("4 km", "6 km")
    mixed = words(40, 8)
    rows = [(1, f"{mixed} {item} {mixed}"), (2, f"{mixed} {again} {mixed}"), (3, mixed), (4, None), (5, ""), (6, f"so {words(30, 7).upper()} then"), (None, words(30, 7)), (7, "says three word item here"), (8, "a train leaves the station at 10 km per hour"), (9, words(20_000, 9, 90_000))]
    df = spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], DOCS)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 2), (None, 2), (7, 5)}
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed == 4
    kept = decontaminate.keep_uncontaminated(df, bench)
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 8, 9} and kept.columns == df.columns
    assert not decontaminate.leaks(none, bench).count() and not decontaminate.leaks(df, bench.limit(0)).count()


def test_op1_slots_that_clash_are_no_leak(spark):
    item = "there are 5 red apples and 5 green apples in the big box by the door of the house"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    same, clash = item.replace("5", "8"), item.replace("5 red", "8 red").replace("5 green", "9 green")
    docs = spark.createDataFrame([(1, same), (2, clash)], "doc_id long, text string")
    got = {r.doc_id: r.n_windows for r in decontaminate.leaks(docs, bench).collect()}
    assert 1 in got and got.get(2, 0) < got[1]


def test_op1_changed_values_may_coincide(spark):
    item = "a train leaves the station at 10 km per hour and after 3 hours it meets Anna who walks at 4 km per hour toward the same old town"
    again = item.replace("10 km", "6 km").replace("3 hours", "6 hours").replace("4 km", "6 km")
    short = "add 7 red balls and 3 blue balls and 2 old green balls"
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    docs = spark.createDataFrame([(1, again), (2, short.replace("7", "4").replace("3", "4").replace("2", "4"))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 1), (2, 2)}


def test_op1_first_words_and_long_items(spark):
    item, story, long = "Carla gives 3 old coins to the shop", "Compute the sum of all odd primes below forty", words(400, 60, 5000)
    bench = spark.createDataFrame([(1, item), (2, story), (3, long)], "item_id long, text string")
    texts = [f"so it was and {item} again", "it is said that Berta gives 8 old coins to the shop", "It ended. Berta gives 8 old coins to the shop", f"please do this now, {story} or else", f"{words(9, 61)} {' '.join(long.split()[100:130])} {words(9, 62)}"]
    texts += ["we saw 3 old coins to the shop", "they gives 3 old coins to the shop", f"{words(9, 63)} {' '.join(long.split()[100:115])} {words(9, 64)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 3)}


def test_op1_items_of_numbers_and_short_ones(spark):
    item, table = "Compute 12 + 7 - 3 + 5 - 2 + 9", " ".join(map(str, range(100, 160)))
    bench = spark.createDataFrame([(1, item), (2, table), (3, "12 + 7"), (4, "Carla 3 coins 4 keys")], "item_id long, text string")
    texts = [f"please {item} today", f"It reads: {table}.", "12 + 7", "so Carla 3 coins 4 keys", "Compute 12 + 7 - 3 + 5 - 2 + 8", "say 12 + 7", " ".join(map(str, range(200, 260))), ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(0, 1), (1, 2), (2, 3), (3, 4)}


def removed(texts, size):
    """Brute force: kept words of each text."""
    lists = [(t or "").encode().split() for t in texts]
    spans = {}
    for n, w in enumerate(lists):
        for i in range(len(w) - size + 1):
            spans.setdefault(tuple(w[i : i + size]), []).append((n, i))
    gone = [set() for _ in lists]
    for places in spans.values():
        if len(places) > 1:
            for n, i in places:
                gone[n].update(range(i, i + size))
    return [b" ".join(x for i, x in enumerate(w) if i not in g).decode() for w, g in zip(lists, gone, strict=True)]


@pytest.mark.parametrize("options", [{}, {"batches": 6, "fanout": 2, "block_rows": 4}, {"batches": 4, "window": 8, "gram": 5, "block_rows": 2}])
def test_op2_against_brute_force(docs, none, options):
    got = sorted((str(r.doc_id), r.kept_text, r.n_words, r.n_removed) for r in substring.substring_report(docs, **options).collect())
    rows = sample()
    kept = removed([t for _, t, _, _ in rows], options.get("window", 35))
    count = lambda t: len((t or "").encode().split())
    assert got == sorted((str(i), k, count(t), count(t) - count(k)) for (i, t, _, _), k in zip(rows, kept, strict=True))
    assert not substring.substring_report(none, **options).count()


@pytest.mark.parametrize("fanout", [1, 3])
def test_op2_later_calls_go_on_with_the_index(spark, tmp_path, fanout):
    """Five calls on one folder: each one's rows lose what repeats in all rows so far, and runs are compacted on the way."""
    folder = f"file://{tmp_path}/index"
    texts = [t for _, t, _, _ in sample() if t and len(t) < 9000]
    random.Random(4).shuffle(texts)
    parts = [texts[n::5] for n in range(5)]
    seen: list[str] = []
    for own in parts:
        df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
        got = {r.doc_id: r.kept_text for r in substring.substring_report(df, batches=2, index=folder, fanout=fanout, block_rows=2, window=12, gram=6).collect()}
        want = removed([*seen, *own], 12)[len(seen) :]
        assert [got[n] for n in range(len(own))] == want
        seen += own
    held = substring.SubstringIndex(spark, folder, window=12, gram=6, fanout=fanout)
    for index in (held.anchors, held.windows):
        assert index.batches == 10 and index.joins == 9 and index.compactions >= 2 and 1 <= len(index.runs) <= fanout
    with pytest.raises(ValueError):
        substring.SubstringIndex(spark, folder, window=13, gram=6)


def test_op2_compacts_with_its_defaults(spark, docs, tmp_path):
    held = substring.SubstringIndex(spark, f"file://{tmp_path}/index")
    held.add(docs.select("doc_id", "text"), last=True)
    assert held.anchors.batches == substring.BATCHES and held.anchors.joins == substring.BATCHES - 1 and held.anchors.compactions >= 1


def test_op2_stage_keeps_columns_and_untouched_texts(docs):
    out = substring.strip_repeats(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert kept[27] == "   \n\t " and 0 not in kept and kept[22] == "tail"


def test_op3_round_trip(docs, none):
    rows = media.features(media.store(docs)).collect()
    want = sorted(media.padded((t or "").encode()) for _, t, _, _ in sample())
    assert sorted(bytes(r.payload) for r in rows) == want
    by_text = {}
    for r in rows:
        assert by_text.setdefault(bytes(r.payload), (bytes(r.media), bytes(r.hash))) == (bytes(r.media), bytes(r.hash))
    assert not media.features(media.store(none)).count()


def test_op3_reader_undoes_all_filters_and_tests_checksums():
    rng = np.random.default_rng(1)
    for channels in (1, 3):
        stride, height = 7 * channels, 11
        image = rng.integers(0, 256, (height, stride), dtype=np.uint8)
        body = bytearray()
        for y in range(height):
            kind = y % 5
            body.append(kind)
            for x in range(stride):
                a = int(image[y, x - channels]) if x >= channels else 0
                b = int(image[y - 1, x]) if y else 0
                c = int(image[y - 1, x - channels]) if y and x >= channels else 0
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                body.append((int(image[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        assert (media.unfilter(bytes(body), height, stride, channels) == image).all()
    good = media.encode(bytes(range(256)) * 9)
    assert media.decode(good).tobytes() == bytes(range(256)) * 9
    bad = bytearray(good)
    bad[60] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(bad))
    with pytest.raises(ValueError):
        media.decode(good[:-12])


@pytest.mark.parametrize("length,windows", [(64, 3), (2048, 16)])
def test_op4_pieces_hold_each_id_once(docs, none, length, windows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path, length=length, windows=windows).collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length and r.length > 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    total = sum(r.length for r in rows)
    assert len(by_seq) == -(-total // length)  # only the last sequence has padding
    encode = encoder("byte_bpe_50k.json")
    want = sorted(tuple(encode(t)) + (1,) for _, t, _, _ in sample())
    parts = {}
    for r in rows:
        parts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, np.uint32).tolist()))
    joined = []
    for (_, n), own in parts.items():
        own.sort()
        copies = len([1 for s, _ in own if s == 0])
        if copies == 1:
            joined.append(tuple(x for _, p in own for x in p))
            assert len(joined[-1]) == n
    assert set(joined) <= set(want) and len(joined) >= len({i for i, _, _, _ in sample()}) - 3
    assert not packing.pack_documents(none, path).count()


def test_op5_files_round_trip(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bitpack.token_files(docs, path).orderBy("start").collect()
    encode = encoder("word_bpe_49k.json")
    order = sorted(sample(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t, _, _) in zip(rows, order, strict=True):
        ids = encode(t) + [2]
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (i, start, ids)
        start += len(ids)
    assert not bitpack.token_files(none, path).count()


@pytest.mark.parametrize("vocabulary", [2, 3, 257, 1000, 49_408, 1 << 20])
def test_op5_bits_and_random_access(tmp_path, vocabulary):
    bits = bitpack.bits_for(vocabulary)
    assert (1 << bits) >= vocabulary > (1 << bits) // 2
    ids = np.random.default_rng(3).integers(0, vocabulary, 1000, dtype=np.uint32)
    with open(tmp_path / "f", "wb") as f:
        writer = bitpack.Writer(f, bits, block=64)
        writer.add(["a", None], [700, 0], ids[:700])
        writer.add(["b"], [300], ids[700:])
        writer.finish()
    with open(tmp_path / "f", "rb") as f:
        r = bitpack.Reader(f)
        for i, j in [(0, 0), (0, 1), (63, 65), (5, 999), (0, 1000), (960, 1000)]:
            assert (r.tokens(i, j) == ids[i:j]).all()
        assert (r.document(2) == ids[700:]).all() and r.docs == ["a", None, "b"]
        with pytest.raises(IndexError):
            r.tokens(0, 1001)


def test_op6_round_trip(spark):
    rows = [(i, f"http://x/{i}", h) for i, h in [(5, "a"), (3, "a"), (9, "a"), (4, None), (6, ""), (7, "é" * 9000), (None, "a"), (8, "b"), (8, "b")]] + [(2, None, "c"), (1, "http://x/\r\nevil", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive(pages, roll=200).collect()
    first = {"a": 3, "": 4, "b": 8, "c": 1, "é" * 9000: 7}
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        low = first[h or ""]
        want.append((str(i), len(data), warc.digest(data), "response" if i == low else "revisit", None if i == low else low))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    only = warc.archive(pages, least=2).filter("record_type = 'revisit'")
    assert only.count() == 0
    assert warc.archive(pages.limit(0)).count() == 0


def test_op6_bytes_are_the_same_each_time_and_tests_digests(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "html" * i) for i in range(30)], "page_id long, url string, html string")
    one, two = (warc.write_warc(pages.repartition(n), common.fresh_path(spark, f"w{n}"), roll=500) for n in (2, 5))
    assert [m["sha256"] for m in one] == [m["sha256"] for m in two]
    member = warc.record(1, "u", b"payload")
    assert [f["X-Page-Id"] for f, _ in warc.records(member + warc.record(2, "u", b"x", 1, "u", True))] == ["1", "2"]
    import gzip

    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(gzip.decompress(member).replace(b"payload", b"PAYLOAD"))))


def test_op7_law_and_groups(spark, docs, none):
    for big in (8192, 4):  # alone, and in bundles
        rows = sharding.shard_documents(docs, 8, big).collect()
        assert len(rows) == len(sample())
        place, slots = {}, {}
        for r in rows:
            assert place.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard and 0 <= r.shard < 8
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, _, _ in sample())
    assert not sharding.shard_documents(none).count()
    even = spark.createDataFrame([(i, "x" * (10 + i % 37) + str(i)) for i in range(400)], "doc_id long, text string")
    load = [r.b for r in sharding.shard_documents(even).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(load) - min(load) <= 60


def test_op7_longest_first():
    items = [(n, s) for n, s in enumerate([9, 7, 6, 5, 5, 4, 4, 2])]
    place = sharding.longest_first(items, 3)
    loads = [sum(s for k, s in items if place[k] == x) for x in range(3)]
    assert max(loads) <= 15 and place == sharding.longest_first(items[::-1], 3)


def test_op8_learns_planted_words_without_held_out_labels(spark, none):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1200):
        text = words(60, i, 800).split()
        toxic = i % 8 == 0
        if toxic:
            text[::15] = rng.choices(["vile", "rotten", "grim"], k=4)
        rows.append((i, " ".join(text), "en", "clash"))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    rows += [(5000, None, None, None), (5001, "", "", ""), (None, words(9, 1), None, None), (5002, words(30_000, 2, 800), "en", ""), (1, rows[1][1], "en", "")]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    own = [r for r in got if r.held_out and r.doc_id < 1200]
    assert np.mean([r.predicted == int(r.doc_id % 8 == 0) for r in own]) > 0.97
    turned = lab.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((str(r.doc_id), r.score) for r in toxicity.toxicity(df, turned).collect()) == sorted((str(r.doc_id), r.score) for r in got)
    assert {r.doc_id for r in toxicity.keep_clean(df, lab).collect()} >= {5000, 5001, 5002}
    assert not toxicity.toxicity(none, lab).count() and toxicity.toxicity(df.limit(3), lab.limit(0)).count() == 3


def test_op9_against_a_plain_programme(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = unigram.load_pieces(path)
    longest = max(map(len, pieces))

    def plain(word):
        s = unigram.MARK + word
        best = [(0.0, 0)]
        for i in range(1, len(s) + 1):
            found = [(best[j][0] + pieces[s[j:i]], best[j][1] + 1) for j in range(max(0, i - longest), i) if s[j:i] in pieces]
            size = len(s[i - 1].encode())
            top = max(found, key=lambda f: f[0], default=(best[-1][0] + unigram.UNKNOWN * size, best[-1][1] + size))
            best.append(top)
        return best[-1]

    rows = [r for r in sample() if len(r[1] or "") < 9000]
    want = sorted((str(i), len((t or "").encode().split()), sum(plain(w.decode())[1] for w in (t or "").encode().split())) for i, t, _, _ in rows)
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in unigram.token_counts(docs, path).collect() if r.doc_id != 28)
    assert got == want
    counter = unigram.TrieCounter(pieces)
    shared = sorted(f"prefixprefix{x}" for x in "abcdef")
    counter.count_all(shared)
    assert counter.steps < sum(map(len, shared)) / 3
    assert not unigram.token_counts(none, path).count()


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    low = {f: f for f in fps}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    fps = sorted(fps)
    for n, a in enumerate(fps):
        for b in fps[:n]:
            if (a ^ b).bit_count() <= 3:
                low[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_op10_against_brute_force(docs, none):
    fps = [(i, brute_fingerprint(t)) for i, t, _, _ in sample()]
    comp = brute_components({f for _, f in fps})
    low = {}
    for i, f in fps:
        if i is not None:
            low[comp[f]] = min(i, low.get(comp[f], i))
    want = sorted((str(i), f"{f:016x}", str(low.get(comp[f]))) for i, f in fps)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert not simhash.near_duplicates(none).count()
    kept = simhash.keep_one(docs)
    rows = kept.collect()
    assert len(rows) == len({comp[f] for _, f in fps}) and kept.columns == docs.columns


def dense(seed):
    """A dense ball, a chain of three bits at a time, and strangers."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    for _ in range(150):
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    x = base
    for b in range(0, 60, 3):
        x ^= 7 << b
        fps.add(x)
    return fps | {int(v) for v in rng.integers(0, 1 << 63, 300)}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("tile,slab", [(5, 1 << 14), (64, 40), (7, 9), (64, 1 << 14)])
def test_op10_links_of_dense_groups_and_chains(spark, tile, slab):
    fps = dense(tile)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    scratch = common.Scratch(spark)
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, len(fps), scratch, tile=tile, slab=slab), scratch).collect()}
    want = brute_components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(roots.get(signed(f), signed(f)), set()).add(want[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))
    scratch.drop()


@pytest.mark.parametrize("tile", [4, 64])
def test_op10_tiles_find_all_links_and_skip_by_population_count(tile):
    fps = np.array(sorted(dense(3), key=lambda f: f.bit_count()), np.uint64)
    tiles = simhash.Tiles(tile=tile)
    a, b = tiles.links(np.zeros(len(fps), np.int64), fps)
    low = {int(f): int(f) for f in fps} | {int(x) & (1 << 64) - 1: int(y) & (1 << 64) - 1 for x, y in zip(a, b)}
    want = brute_components({int(f) for f in fps})
    assert len({(low[f], want[f]) for f in want}) == len(set(low.values())) == len(set(want.values()))
    pairs = -(-len(fps) // tile) * (-(-len(fps) // tile) + 1) // 2
    assert tiles.compared + tiles.skipped <= pairs and (tile > 4 or tiles.skipped > 0)
    # units of their own have no links with each other
    a, _ = simhash.Tiles(tile=tile).links(np.arange(len(fps)), fps)
    assert not len(a)


@pytest.mark.parametrize("radius,count", [(1, 10), (3, 10), (3, 10**8), (3, 10**11), (5, 10**9)])
def test_op10_masks_miss_no_pair(radius, count):
    rng = random.Random(radius)
    own = simhash.masks(count, radius)
    assert count >> min(m.bit_count() for m in own) <= simhash.GROUP * 2
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), radius))
        assert any(x & m == y & m for m in own)


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


def test_pipeline(spark):
    if not os.path.exists(os.path.join(os.path.dirname(__file__), "../../corpus_pipeline.py")):
        pytest.skip("no pipeline")
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        counts.append(len(rows))
        if name == "simhash near-dedup":
            comp = brute_components({brute_fingerprint(r.text) for r in docs.collect()})
            low = {}
            for r in docs.collect():
                c = comp[brute_fingerprint(r.text)]
                low[c] = min(r.doc_id, low.get(c, r.doc_id))
            assert sorted(r.doc_id for r in rows) == sorted(low.values())
        if name == "substring dedup":
            own = docs.collect()
            want = {r.doc_id: k for r, k in zip(own, removed([r.text for r in own], 35), strict=True)}
            assert {r.doc_id for r in rows} == {r.doc_id for r in own if want[r.doc_id] or not r.text.split()}
            assert all(r.text.split() == want[r.doc_id].split() and r.n_chars == len(r.text) for r in rows)
        if name == "benchmark decontamination":
            leaked = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} - leaked
        docs = spark.createDataFrame(rows, docs.schema)
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == counts[-1]
    whole = corpus_pipeline.run(spark, sf)
    assert whole.agg(F.sum("length")).first()[0] == pieces.agg(F.sum("length")).first()[0]
