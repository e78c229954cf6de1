"""Licence scans against plain loops."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import licences as L
from sparkquarry.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def plain(docs, notices=L.NOTICES):
    files = [(i, re.findall(L.WORD, (t or "").translate(LOWER))) for i, t in docs]
    df = Counter(w for _, ws in files for w in set(ws))
    indexes = []
    for notice in notices:
        own = L.words_of(notice.text)
        if not all(df[w] for p in notice.mandatory for w in L.words_of(p)):
            indexes.append([])
            continue
        rare = sorted({w for w in own if df[w]}, key=lambda w: (df[w], w))[: L.RARE]
        weight = {w: math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[w] + 1))) for w in rare}
        indexes.append([(w, at, weight[w]) for at, w in enumerate(own) if w in weight and 10 * weight[w] >= L.TENTHS * max(weight.values())])
    out = []
    for i, ws in files:
        line, base, found = f" {' '.join(ws)} ", [], {}
        for phrase, label in L.PHRASES:
            size = len(phrase.split())
            base += [(at, label) for at in range(len(ws)) if " ".join(ws[at : at + size]) == phrase]
        places = {}
        for at, w in enumerate(ws):
            places.setdefault(w, []).append(at)
        for notice, index in zip(notices, indexes):
            lined = Counter()
            for w, at, weight in index:
                for bin_ in {(shift, (pos - at + L.BASE + shift) // L.SLACK) for pos in places.get(w, ()) for shift in (0, L.SLACK // 2)}:
                    lined[bin_] += weight
            total = sum(x[2] for x in index)
            share = max(lined.values(), default=0) / total if total else 0
            if share >= L.LEAST and all(f" {' '.join(L.words_of(p))} " in line for p in notice.mandatory):
                found[notice.label] = max(share, found.get(notice.label, 0))
        starts, own = [at for at, _ in base], {label for _, label in base}
        out.append((i, len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | set(found))), max([1.0 if base else 0.0, *found.values()])))
    return sorted(map(repr, out))


def got(spark, docs):
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, word string").withColumns({"row": F.lit(1), "w": F.lit("x"), "base": F.lit(2), "id": F.lit(3)}).repartition(3)
    return sorted(map(repr, map(tuple, L.licence_digests(L.scan(frame)).select(*COLUMNS).collect())))


def labels(rows):
    return {eval(r)[0]: eval(r)[6] for r in rows}


FILLER = " ".join(f"word{i}" for i in range(60))


def test_notices(spark):
    """Each notice is found: alone, in prose, wrapped as comments, with words left out or put in; parts and mentions aren't."""
    docs, want = [], {}
    for i, n in enumerate(L.NOTICES):
        words = n.text.split()
        docs += [(10 * i, n.text), (10 * i + 1, f"{FILLER}\n{n.text.upper()}\n{FILLER}"), (10 * i + 2, "\n".join(f" * {' '.join(words[k : k + 6])}" for k in range(0, len(words), 6)))]
        docs.append((10 * i + 3, " ".join(words[:4])))  # a part of it
        want |= {10 * i + k: n.label for k in (0, 1, 2)}
    docs += [(900 + i, f"{FILLER} {i} the license of any software is a public work; permission, copyright and warranty by the general version") for i in range(30)]
    docs.append((1000, L.NOTICES[2].text.replace("and binary forms", "and binary forms, however made and kept,") + FILLER))
    want[1000] = "bsd"
    rows = got(spark, docs)
    assert rows == plain(docs)
    found = labels(rows)
    assert all(label in found[i].split(",") for i, label in want.items())
    assert not any(found[i] for i in found if i >= 900 and i != 1000) and not any(found[10 * i + 3] for i in range(len(L.NOTICES)))


@pytest.mark.parametrize(
    "docs",
    [
        [],
        [(1, None), (2, ""), (None, " .\x00\n")],
        [
            (1, "Under the MIT license, under the mit license"), (1, "Under the MIT license, under the mit license"), (2, "CC-BY-NC cc by nc by nc"), (3, "Apache License, Version 2.0 ! under the mit licenses"), (4, "under the mit"),
            (5, "é under_the MIT-license"), (None, "cc by nc"), (6, "ünder the mit license"), (7, "cc by nc " * 20_000), (8, "mit " * 50_000 + "under the mit license"), (9, None),
        ],
    ],
    ids=["no rows", "no words", "phrases"],
)
def test_edges(spark, docs):
    assert got(spark, docs) == plain(docs)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    rows = sorted(map(repr, map(tuple, queries.op13_license_scan(spark, folder).select(*COLUMNS).collect())))
    assert rows == plain(docs)
    planted = {i for i, t in docs if t and "licensed under the GNU General Public License, version 3" in t}
    assert planted == {i for i, found in labels(rows).items() if "gpl-3" in found}
