"""The registered queries on the driver's smallest tables, each against another way to the same rows."""

import hashlib
import re

import duckdb
import pytest

from sparkquarry.llm import queries, secrets
from sparkquarry.llm.queries import tokenizer_file

from . import test_katz

FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


def rows_of(spark, name, *columns):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, FOLDER).select(*columns).collect())


def test_token_counts(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = [(i, len((t or "").encode()), n, n > 4096) for i, t, _ in docs for n in (len(library.encode(t or "")),)]
    assert rows_of(spark, "op1_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_exact_dedup(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLES["op2_exact_dedup"]).fetchall())
    assert rows_of(spark, "op2_exact_dedup", "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_language_id(spark, docs):
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, FOLDER).collect()}
    assert got.keys() == {i for i, *_ in docs}
    held = [(r, lang) for i, t, lang in docs for r in (got[i],) if r["held_out"] and lang and re.search(r"[^\W\d_]", t or "")]
    assert len(held) > 20 and sum(r["lang_pred"] == lang for r, lang in held) == len(held)  # held-out accuracy of one
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_secrets(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r["doc_id"]: r for r in queries.op4_secret_scan(spark, FOLDER).collect()}
    for i, t, _ in docs:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"], got[i]["base_sha256"]) == (*(sum(k == x for _, k, _ in spans) for x in range(3)), sha(text))
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = []
    for i, t, _ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert rows_of(spark, "op8_bpe_encoding", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_lm_scores(spark, docs):
    words = {i: [w.decode("utf-8", "surrogateescape") for w in (t or "").encode().lower().split()] for i, t, _ in docs}
    plain = test_katz.Plain([w for i, w in words.items() if not test_katz.held(i)])
    got = {r["doc_id"]: r for r in queries.op10_lm_scoring(spark, FOLDER).collect()}
    assert got.keys() == words.keys()
    for i, w in words.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["held_out"], got[i]["train_tokens"]) == (len(w) + 1, sum(plain.ones[x] > 0 for x in [*w, None]), test_katz.held(i), plain.tokens)
        assert got[i]["score"] == pytest.approx(plain.score(w), rel=1e-9)
