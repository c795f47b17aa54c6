"""Headings and banners against a plain reading of the same rules."""

import random
from collections import Counter

from larkspur.operators import structure as S

SCHEMA = "doc_id long, idx int, page int, kind string, text string, text_level int, doc_type string"


def rows(seed):
    rnd = random.Random(seed)
    texts = ["Draft 7"] * 6 + ["Draft  7", "Page:", None, "", "1 Scope", "2 Terms", "1.2 Parts", "SECTION 4 Duties", "• point", "2020 report", "x" * 130, "Body of text"]
    return [(d, i, rnd.choice([i // 4, i // 4, None]), rnd.choice(["text", "text", "text", "header", None]), rnd.choice(texts), rnd.choice([None, None, 1, 2]), rnd.choice(["law", "news", None])) for d in range(12) for i in range(rnd.choice([3, 24, 40]))]


def plain_kept(data):
    pages, places = {}, {}
    for d, i, page, kind, text, *_ in data:
        if page is not None:
            pages[d] = max(pages.get(d, 0), page + 1)
        norm = " ".join((text or "").split())
        if kind not in (*S.NOISE, None) and norm and norm[-1] not in ":：":
            places.setdefault((d, norm), []).append(page)
    banners = {k for k, p in places.items() if pages.get(k[0], 0) >= 4 and len(p) >= 3 and len(Counter(x for x in p if x is not None)) >= pages[k[0]] * 0.5}
    return {(r[0], r[1]) for r in data if r[3] not in (*S.NOISE, None) and (r[0], " ".join((r[4] or "").split())) not in banners}, banners


def test_headings_are_those_of_all_elements(spark):
    for seed in (1, 2):
        data = rows(seed)
        e = spark.createDataFrame(data, SCHEMA)
        kept, banners = plain_kept(data)
        assert banners and len(kept) < len(data)
        levels = S.leveled(e).select("doc_id", "idx", "level").collect()
        assert {(r.doc_id, r.idx) for r in levels} == kept and len(levels) == len(kept)
        heads = {(r.doc_id, r.idx, r.level) for r in S.headings(e).collect()}
        assert heads == {tuple(r) for r in levels if r.level is not None} and heads
        assert {(r.doc_id, r.norm) for r in S.banners(e).collect()} == banners


def test_headings_of_nothing(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert not S.headings(e).count() and not S.leveled(e).count()
