"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, common


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; SPARKQUARRY_TOKENIZERS names another folder."""
    if folder := os.environ.get("SPARKQUARRY_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(common.table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(common.table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM n
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs, file = common.table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")
    model = language_id.fit(docs.where(~language_id.held_out()), file)
    return language_id.predict(docs, model, file).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets, secret_digests

    return secret_digests(scan_secrets(common.table(spark, sf_dir, "documents")))


#: A conversation of the contract whose texts hold the template's own marks.
PLANTED = "\\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    # the planted conversation comes as one record with a list of messages
    messages = F.array(*(F.struct(F.lit(role).alias("role"), F.lit(PLANTED).alias("content")) for role in ("user", "assistant")))
    planted = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.to_variant_object(F.struct(F.lit("planted").alias("id"), messages.alias("messages"))).alias("record"))
    # a record that no mapping knows stays as a turn without role and text
    turns = chat_format.canonical_turns(rows.unionByName(planted), "record").select("conv_id", "turn", F.posexplode_outer("turns").alias("part", "t"))
    chats = chat_format.format_chats(turns.select("conv_id", "turn", "part", "t.role", "t.text"), order_cols=("turn", "part"))
    return chat_format.chat_digests(chats)


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_trie import encoding_digests

    return encoding_digests(common.table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_text

    return extract_text(common.table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score_documents

    return score_documents(common.table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical

    index = lexical.build(common.table(spark, sf_dir, "documents"))
    try:
        return lexical.ranked(common.table(spark, sf_dir, "benchmark"), index)
    finally:
        lexical.forget(index)


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
total AS (SELECT count(*)::BIGINT AS nn, sum(len(words))::BIGINT AS ll FROM d WHERE len(words) > 0),
p AS (SELECT doc, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d) GROUP BY ALL),
i AS (
  SELECT DISTINCT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY term, nn),
s AS (
  SELECT item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), total GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle

    docs = common.table(spark, sf_dir, "documents")
    return merkle.verified_rows(docs, common.remainder("doc_id", 2) == 0, ["doc_id", "source", "lang", "n_chars", "text"])


#: CRC-32 of a decimal number by its digits, bit by bit, and the rows' leaves and trees level by level.
OP12_SQL = r"""
WITH RECURSIVE field_rows AS (
  SELECT doc_id, source, coalesce('s' || source, '-') AS tree, text,
    [coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
     coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')] AS head,
    list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')],
      lambda a, c: list_reduce([xor(a, c)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, b: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, tree, sha256(array_to_string(head, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295::BIGINT) % 2 = 0
      THEN sha256(array_to_string(head, '') || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS changed
  FROM field_rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
own AS (
  SELECT tree, 0 AS level, idx, leaf AS h, n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM own WHERE n > 1 GROUP BY tree, level, idx // 3),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM own WHERE n = 1),
top AS (
  SELECT 0 AS level, idx, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, idx // 3),
sides AS (
  SELECT p.doc_id, p.tree, p.leaf, p.idx AS pos, o.level,
    coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx < p.idx // (3 ** o.level)::BIGINT), '') AS l,
    coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx > p.idx // (3 ** o.level)::BIGINT), '') AS r
  FROM placed p JOIN own o ON o.tree = p.tree AND o.n > 1 AND o.idx // 3 = p.idx // (3 ** (o.level + 1))::BIGINT GROUP BY ALL),
top_sides AS (
  SELECT s.tree, t.level,
    coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx < s.idx // (3 ** t.level)::BIGINT), '') AS l,
    coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx > s.idx // (3 ** t.level)::BIGINT), '') AS r
  FROM subroots s JOIN top t ON t.n > 1 AND t.idx // 3 = s.idx // (3 ** (t.level + 1))::BIGINT GROUP BY ALL),
paths AS (
  SELECT p.tree, p.idx, any_value(p.doc_id) AS doc_id, any_value(p.leaf) AS leaf, any_value(p.changed) AS changed,
    list({'l': x.l, 'r': x.r} ORDER BY x.level) FILTER (x.level IS NOT NULL) AS proof
  FROM placed p LEFT JOIN (
    SELECT tree, pos, level, l, r FROM sides
    UNION ALL
    SELECT q.tree, q.idx, 1000 + t.level, t.l, t.r FROM placed q JOIN top_sides t ON t.tree = q.tree) x ON x.tree = p.tree AND x.pos = p.idx
  GROUP BY p.tree, p.idx),
folds AS (
  SELECT tree, idx, doc_id, leaf, coalesce(proof, []) AS proof, coalesce(changed, leaf) AS h, 1 AS i FROM paths
  UNION ALL
  SELECT tree, idx, doc_id, leaf, proof, sha256(proof[i].l || h || proof[i].r), i + 1 FROM folds WHERE i <= len(proof))
SELECT f.doc_id, f.leaf, s.subroot, r.h AS root, sha256(array_to_string([x.l || x.r FOR x IN f.proof], '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM folds f JOIN subroots s USING (tree), (SELECT h FROM top WHERE n = 1) r WHERE f.i > len(f.proof)
"""


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licences

    return licences.licence_digests(licences.scan(common.table(spark, sf_dir, "documents")))


def op13_sql() -> str:
    """Words by unnesting, phrases by looking ahead, notices by counts of all pairs of a file's and a notice's places."""
    from . import licences as L

    listed = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    templates = listed((i, n.label, at, w) for i, n in enumerate(L.NOTICES) for at, w in enumerate(L.words_of(n.text)))
    mandatory = listed((i, " " + " ".join(L.words_of(p)) + " ") for i, n in enumerate(L.NOTICES) for p in n.mandatory)
    phrases = listed((" ".join(L.words_of(p)), label, len(L.words_of(p))) for p, label in L.PHRASES)
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS MATERIALIZED (SELECT doc, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
phrase(phrase, label, size) AS (VALUES {phrases}),
base AS (
  SELECT doc, pos, label FROM (
    SELECT doc, pos, word || ' ' || CASE WHEN lead(pos, 2) OVER o = pos + 2 THEN lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o END AS three,
      CASE WHEN lead(pos, 3) OVER o = pos + 3 THEN lead(word, 3) OVER o END AS fourth
    FROM w WHERE word IN (SELECT unnest(string_split(phrase, ' ')) FROM phrase) WINDOW o AS (PARTITION BY doc ORDER BY pos)
  ) JOIN phrase ON phrase = CASE WHEN size = 3 THEN three ELSE three || ' ' || fourth END),
template(t, label, nth, word) AS (VALUES {templates}),
mandatory(t, phrase) AS (VALUES {mandatory}),
df AS (SELECT word, count(DISTINCT doc) AS df FROM w WHERE word IN (SELECT word FROM template) GROUP BY word),
rare AS (
  SELECT t, word, floor(1000 * ln((2 * (SELECT count(*) FROM d) + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT DISTINCT t, word FROM template) JOIN df USING (word)
  WHERE t NOT IN (SELECT t FROM (SELECT t, unnest(string_split(trim(phrase), ' ')) AS word FROM mandatory) WHERE word NOT IN (SELECT word FROM df))
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY df, word) <= {L.RARE} AND 10 * weight >= {L.TENTHS} * max(weight) OVER (PARTITION BY t)),
postings AS (SELECT t, label, nth, word, weight FROM template JOIN rare USING (t, word)),
totals AS (SELECT t, sum(weight) AS total FROM postings GROUP BY t),
lined AS (
  SELECT doc, t, label, sum(weight) AS lined FROM (
    SELECT DISTINCT doc, t, label, shift, (pos - nth + {L.BASE} + shift) // {L.SLACK} AS bin, nth, weight FROM w JOIN postings USING (word), (VALUES (0), ({L.SLACK // 2})) s(shift))
  GROUP BY doc, t, label, shift, bin),
able AS MATERIALIZED (SELECT doc, t, label, max(lined / total) AS share FROM lined JOIN totals USING (t) WHERE total > 0 AND lined / total >= {L.LEAST} GROUP BY doc, t, label),
lacking AS (
  SELECT doc, t FROM (SELECT doc, ' ' || array_to_string(words, ' ') || ' ' AS line FROM d WHERE doc IN (SELECT doc FROM able)) JOIN able USING (doc) JOIN mandatory USING (t)
  WHERE NOT contains(line, phrase)),
found AS (SELECT doc, label, max(share) AS share FROM able a WHERE NOT EXISTS (SELECT 1 FROM lacking l WHERE l.doc = a.doc AND l.t = a.t) GROUP BY doc, label),
b AS (SELECT doc, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label ORDER BY label) AS labels FROM base GROUP BY doc),
f AS (SELECT doc, list(DISTINCT label ORDER BY label) AS labels, max(share) AS share FROM found GROUP BY doc)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(f.labels, []))), ',') AS labels, greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0))::DOUBLE AS score
FROM d LEFT JOIN b USING (doc) LEFT JOIN f USING (doc)
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_exact_dedup, op3_language_id, op4_secret_scan, op5_near_dedup,
        op6_decontamination, op7_chat_formatting, op8_bpe_encoding, op9_html_extraction, op10_lm_scoring,
        op11_lexical_search, op12_merkle_manifest, op13_license_scan,
    )
}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op11_lexical_search": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_license_scan": op13_sql()}
