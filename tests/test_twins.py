"""Folds that look back, over whole small tables, against plain loops of their own."""

import hashlib
import re

import duckdb

from larkspur.operators import structure as S
from larkspur.operators.chunking import BUDGETS, DEFAULT_BUDGET
from larkspur.plans.base import DOC_TYPES
from larkspur.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def matches(pattern, text):
    return re.search(pattern, text, re.ASCII) is not None


def plain_levels(lines, doc_type):
    """idx -> level of the headings, and which lines are kept."""
    norm = [re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ") for t in lines]
    pages = (len(lines) - 1) // 20 + 1
    banner = set()
    if pages >= 4:
        for n in {n for n in norm if n and n[-1] not in ":："}:
            at = [i for i, m in enumerate(norm) if m == n]
            if len(at) >= 3 and len({i // 20 for i in at}) >= pages * 0.5:
                banner.add(n)
    kept = [i for i in range(len(lines)) if norm[i] not in banner]
    plain = lambda t: matches(S.TOC_LEADER, t) or matches(S.TOC_TAIL, t) or len(t) > S.MAX_HEADING or matches(S.BULLET, t)
    hint = {i: len(lines[i]) % 3 + 1 for i in kept if len(lines[i]) < 40}
    number = {}
    for i in kept:
        m = re.match(r"\s*(\d+(?:\.\d+)*)", lines[i].strip(" "), re.ASCII)
        if m and not re.fullmatch(r"(19|20)\d\d", m[1].split(".")[0]):
            number[i] = m[1]
    rising = [int(number[i]) for i in kept if i in number and "." not in number[i] and i in hint and not plain(lines[i].strip(" "))]
    promote = all(b > a for a, b in zip(rising, rising[1:]))
    levels = {}
    for i in kept:
        t = lines[i].strip(" ")
        if plain(t):
            continue
        if doc_type == "law" and matches(S.LAW_SECTION, t):
            levels[i] = 1
        elif i in hint:
            dotted = i in number and "." in number[i]
            levels[i] = len(number[i].split(".")) if dotted else 1 if i in number and promote else hint[i]
    return levels, kept


def plain_chunks(doc_id, text, lang):
    lines, doc_type = text.split("\n"), DOC_TYPES[doc_id % 5]
    ratio = 1.7 if lang.lower().startswith(("ch", "zh")) else 4.0
    least, target, most = BUDGETS.get(doc_type, DEFAULT_BUDGET)
    levels, kept = plain_levels(lines, doc_type)
    runs, head = [], None
    for i in kept:
        if i in levels:
            head = i
        elif lines[i].strip(" "):
            if not runs or runs[-1][0] != head:
                runs.append((head, []))
            runs[-1][1].append(i)
    out = []
    for head, own in runs:
        groups, room = [], 0.0
        for i in own:
            size = len(lines[i]) / ratio
            if size > most:
                piece = []
                for sentence in re.split(r"(?<=[。！？.!?])\s+", lines[i]):
                    if piece and len(" ".join([*piece, sentence])) > most * ratio:
                        groups.append([(i, " ".join(piece).strip())])
                        piece = []
                    piece.append(sentence)
                groups.append([(i, " ".join(piece).strip())])
                room = 0.0
            elif groups and 0 < room and size <= room:
                groups[-1].append((i, lines[i]))
                room -= size
            else:
                groups.append([(i, lines[i])])
                room = target - size
        joined = []
        for g in groups:
            length = lambda x: sum(len(t) for _, t in x) / ratio
            if joined and length(g) < least and length(g) + length(joined[-1]) <= most:
                joined[-1] = joined[-1] + g
            else:
                joined.append(g)
        for g in joined:
            body, pages = "\n".join(t for _, t in g), [i // 20 for i, _ in g]
            flags = ["multi_page"] if pages[0] != pages[-1] else []
            out.append((doc_id, f"{doc_id}#{len(out):04d}", round(len(body) / ratio), pages[0], pages[-1], [i for i, _ in g], hashlib.md5(body.encode()).hexdigest(), flags, head))
    return out


def test_chunks_of_all_documents(spark):
    docs = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' where text is not null").fetchall()
    want = sorted((r for d in docs for r in plain_chunks(*d)), key=lambda r: r[:2])
    names = ["doc_id", "chunk_id", "n_tokens", "page_start", "page_end", "source_indices", "h", "flags", "sec_head"]
    got = sorted((tuple(r[n] for n in names) for r in QUERIES["pack_chunks"](spark, SF).collect()), key=lambda r: r[:2])
    assert len(want) > 200 and got == want
