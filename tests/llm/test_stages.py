"""What every operator and pipeline stage must bear: nulls, empty and long texts, ties, repeated rows, empty tables, clashing and dotted names, ids of any type."""

import datetime
import decimal
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("larkspur.llm.queries")
import public_tokenizers  # noqa: E402

from larkspur.llm import bitpack, common, decontaminate, media, packing, sharding, simhash, substring, toxicity, unigram, warc  # noqa: E402

TEMPORARY = ["_key", "__key", "__bad", "_fp", "__fp", "_row", "_tie", "__root", "__component", "_block", "__block", "_batch", "_words", "__words", "_removed", "__removed", "_kept", "__kept", "_score", "__score", "key", "row", "fp", "low", "root", "hash", "part", "open", "name", "a.b", "kind", "digest"]


def rows(spark, ids="long"):
    long = " ".join(f"v{i}" for i in range(20_000))
    passage = " ".join(f"p{i}" for i in range(60))
    item = "the old mill of Rosa makes 12 kg of flour in 3 hours and sells all of it at the small market by the river"
    texts = [None, "", "one two", f"start {passage} end", f"other {passage} close", f"so {item} then", long, "same text of a few words here", "same text of a few words here", "vile grim words here " * 9]
    own = [(n if n < 8 else 7, t) for n, t in enumerate(texts)] + [(None, "no id has this text"), (None, None)]
    names = ", ".join(f"`{c}` string" for c in TEMPORARY)
    df = spark.createDataFrame([(i, t, *[f"x{n}" for n in range(len(TEMPORARY))]) for i, t in own], f"doc_id long, text string, {names}")
    return df.withColumn("doc_id", F.col("doc_id").cast(ids)), spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string"), spark.createDataFrame([(9, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")


STAGES = {
    "toxicity": lambda d, b, lab: toxicity.keep_clean(d, lab),
    "simhash": lambda d, b, lab: simhash.keep_one(d),
    "substring": lambda d, b, lab: substring.strip_repeats(d),
    "decontaminate": lambda d, b, lab: decontaminate.keep_uncontaminated(d, b),
}


@pytest.mark.parametrize("name", STAGES)
def test_stage_keeps_all_columns(spark, name):
    docs, bench, labels = rows(spark)
    out = STAGES[name](docs, bench, labels)
    assert out.columns == docs.columns
    got = out.collect()
    assert all([r[c] for c in TEMPORARY] == [f"x{n}" for n in range(len(TEMPORARY))] for r in got)
    ids = [r.doc_id for r in got]
    if name == "simhash":  # null and empty texts are alike; of two equal rows one stays
        assert sorted(ids, key=str) == sorted([0, 2, 3, 4, 5, 6, 7, 7, None], key=str) or len(ids) == len(set(r.text for r in got))
    elif name == "substring":
        assert {r.doc_id: r.text for r in got}[3] == "start end" and len(got) == docs.count()
    elif name == "decontaminate":
        assert 5 not in ids and len(ids) == docs.count() - 1
    else:
        assert len(ids) >= docs.count() - 1
    empty = STAGES[name](docs.limit(0), bench, labels)
    assert empty.columns == docs.columns and not empty.collect()
    assert STAGES[name](docs, bench.limit(0), labels.limit(0)).columns == docs.columns


def test_keep_one_is_the_same_each_time(spark):
    """Of rows with one id the text decides, however they are dealt out."""
    texts = [f"{' '.join(f'w{i}' for i in range(40))} {tail}" for tail in ("", "  ", "\n", "\t")]
    df = spark.createDataFrame([(1, t) for t in texts] + [(2, texts[0])], "doc_id long, text string")
    kept = {tuple(r.text for r in simhash.keep_one(df.repartition(n)).collect()) for n in (1, 2, 5)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1


OPERATORS = {
    "op1": lambda d, b: decontaminate.leaks(d, b),
    "op2": lambda d, b: substring.substring_report(d),
    "op3": lambda d, b: media.features(media.store(d)),
    "op4": lambda d, b: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
    "op5": lambda d, b: bitpack.token_files(d, public_tokenizers.path("word_bpe_49k.json")),
    "op6": lambda d, b: warc.archive(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))),
    "op7": lambda d, b: sharding.shard_documents(d),
    "op9": lambda d, b: unigram.token_counts(d, public_tokenizers.path("piece_bpe_32k.model")),
    "op10": lambda d, b: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_takes_clashing_names_and_empty_tables(spark, name):
    docs, bench, _ = rows(spark)
    got = OPERATORS[name](docs, bench).collect()
    if name == "op1":
        assert [(r.doc_id, r.item_id) for r in got] == [(5, 1)]
    elif name == "op4":
        assert sum(r.length for r in got if r.start == 0) and len({(r.doc_id, r.doc_tokens) for r in got}) >= 10
    else:
        assert len(got) == docs.count()
    assert not OPERATORS[name](docs.limit(0), bench).collect()


@pytest.mark.parametrize("kind,value", [("smallint", 7), ("decimal(20,3)", decimal.Decimal("7.000")), ("string", "7"), ("date", datetime.date(1970, 1, 8)), ("binary", b"7"), ("double", 7.0)])
def test_ids_of_any_type(spark, kind, value):
    docs = spark.createDataFrame([(7, "some text"), (None, None)], "doc_id int, text string")
    own = docs.withColumn("doc_id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("doc_id")) if kind == "date" else F.col("doc_id").cast("string").cast(kind))
    for name in ("op5", "op6", "op10", "op2"):
        out = OPERATORS[name](own, None)
        ids = {bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in out.collect()}
        assert ids == {value, None} and out.schema[0].dataType == own.schema[0].dataType


def test_op8_features_against_plain_counts():
    rng = np.random.default_rng(2)
    stock = ["vile", "Vileness", "grim", "a", "\u00e9t\u00e9s", "(grim)", "rottenly", "!!"]
    texts = [" ".join(rng.choice(stock, n)) for n in (0, 1, 3, 20, 60)] + ["\x0b grim\tgrim\n"]
    row, slot = toxicity.Features()(pa.array([t.encode() for t in texts], pa.large_binary()))
    for n, t in enumerate(texts):
        counts: dict = {}
        for w in t.encode().lower().split():
            for x in toxicity.word_slots(w):
                counts[x] = counts.get(x, 0) + 1
        want = {s for x, c in counts.items() for s, level in zip(x, toxicity.LEVELS) if c >= level}
        assert sorted(slot[row == n].tolist()) == sorted(want)


def test_op8_risk_and_gradient():
    """The non-negative risk by its definition; the gradient by differences, of the whole risk or, below zero, of the negatives' part turned round."""
    rng = np.random.default_rng(3)
    p, u = rng.integers(0, 2, (40, 5)).astype(float), rng.integers(0, 2, (90, 5)).astype(float)
    loss = lambda z: np.log1p(np.exp(-z))
    for prior, scale in ((0.1, 0.5), (0.9, 3.0)):
        w = rng.normal(size=5) * scale
        parts = lambda v: (prior * loss(p @ v).mean(), loss(-(u @ v)).mean() - prior * loss(-(p @ v)).mean())
        value, grad = toxicity.risk(w, p, u, prior)
        one, two = parts(w)
        assert np.isclose(value, one + max(0, two))
        aim = (lambda v: sum(parts(v))) if two >= 0 else (lambda v: -parts(v)[1])
        step = 1e-6
        assert np.allclose(grad, [(aim(w + step * e) - aim(w - step * e)) / (2 * step) for e in np.eye(5)], atol=1e-4)


def test_op8_sample_is_bounded_by_distinct_texts(spark):
    """Many rows of one id and of one text count once."""
    docs = spark.createDataFrame([(1, f"vile text {n % 3}") for n in range(300)] + [(2 + n, f"calm words {n % 4} here") for n in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    toxicity.train = lambda positive, unlabelled, *rest: seen.append((len(positive), len(unlabelled))) or train(positive, unlabelled, *rest)
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = train
    assert seen[0][0] <= 3 and seen[0][1] <= 8


def test_scratch_is_swept(spark):
    out = simhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string"))
    assert out.count() == 2
    root = common.shared_dir(spark).removeprefix("file://")
    held = len(os.listdir(root))
    common.sweep(spark)
    assert len([d for d in os.listdir(root) if os.listdir(f"{root}/{d}")]) < held
