"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldglass.llm.common import table
from fieldglass.llm.exact_dedup import exact_dedup
from fieldglass.llm.language_id import identify_language
from fieldglass.llm.lm_scoring import backoff_scores
from fieldglass.llm.manifest import manifest
from fieldglass.llm.mixing import MARGINS, POWERS, RATE, ROUNDS, mix
from fieldglass.llm.near_dup import near_duplicates
from fieldglass.llm.packing import pack
from fieldglass.llm.pii import personal_data
from fieldglass.llm.secret_scan import scan_secrets
from fieldglass.llm.sentencepiece_codec import encode_documents
from fieldglass.llm.topk import top_k
from fieldglass.llm.toxicity import toxicity
from fieldglass.llm.vector_codes import ENTRIES, PARTS, compress
from fieldglass.llm.vector_codes import ROUNDS as CODE_ROUNDS


def piece_model() -> str:
    """The public 32k byte-pair piece model that this machine offers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_tokenizer() -> str:
    """The public tokenizer with ends of words that this machine offers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Rounds of the SQL's search for the sampling factor; more change nothing once no further cell is whole.
CAP_ROUNDS = 12


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _mixing_sql() -> str:
    """Raking by windows, round after round, as CTEs."""
    steps = [r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN contains(coalesce(text, ''), 'token = ') THEN 'configuration' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
      WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), 'License') THEN 'licence' ELSE 'prose' END AS topic,
    greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1) AS n_tokens
  FROM documents
), cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS mass FROM t GROUP BY ALL)"""]
    for m in MARGINS:
        steps.append(
            f"{m}_p AS (SELECT {m}, pow(sum(mass)::DOUBLE, {POWERS[m]}) AS p FROM cells GROUP BY {m}), "
            f"{m}_t AS (SELECT {m}, p / sum(p) OVER () AS {m}_to FROM {m}_p)"
        )
    steps.append("f0 AS (SELECT cells.*, mass::DOUBLE AS w, source_to, lang_to, topic_to FROM cells JOIN source_t USING (source) JOIN lang_t USING (lang) JOIN topic_t USING (topic))")
    n = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            steps.append(f"f{n + 1} AS MATERIALIZED (SELECT * REPLACE ({m}_to * w / sum(w) OVER (PARTITION BY {m}) AS w) FROM f{n})")
            n += 1
    steps.append(
        f"k0 AS (SELECT source, lang, topic, mass, sum(mass::DOUBLE) OVER () AS all_mass, w / sum(w) OVER () * sum(mass::DOUBLE) OVER () / mass AS weight, {RATE}::DOUBLE AS k FROM f{n})"
    )
    for i in range(CAP_ROUNDS):
        steps.append(
            f"k{i + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(greatest(k, (all_mass * {RATE} - sum(CASE WHEN k * weight >= 1 THEN mass ELSE 0 END) OVER ())"
            f" / nullif(sum(CASE WHEN k * weight >= 1 THEN 0.0::DOUBLE ELSE mass * weight END) OVER (), 0)), k) AS k) FROM k{i})"
        )
    return ", ".join(steps) + f"""
SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, floor(weight * 1e6 + 0.5) / 1e6 AS weight,
  floor(least(1.0, k * weight) * 1e6 + 0.5) / 1e6 AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < least(1.0, k * weight) AS kept
FROM t JOIN k{CAP_ROUNDS} USING (source, lang, topic)
"""


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents
), n AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM w),
g AS (
  SELECT doc_id, i, t[i] AS a, CASE WHEN i > 1 THEN t[i - 1] || ' ' || t[i] END AS b, CASE WHEN i > 2 THEN t[i - 2] || ' ' || t[i - 1] || ' ' || t[i] END AS c,
    CASE WHEN i > 1 THEN t[i - 1] END AS before_a, CASE WHEN i > 2 THEN t[i - 2] || ' ' || t[i - 1] END AS before_b FROM n
), c1 AS (SELECT a, count(*) AS n1 FROM g GROUP BY a), c2 AS (SELECT b, count(*) AS n2 FROM g WHERE b IS NOT NULL GROUP BY b), c3 AS (SELECT c, count(*) AS n3 FROM g WHERE c IS NOT NULL GROUP BY c),
s AS (
  SELECT doc_id, ln(CASE WHEN i = 1 THEN n1 / (SELECT count(*) FROM g) WHEN i = 2 THEN n2 / p1 ELSE n3 / p2 END) AS x FROM g JOIN c1 USING (a) LEFT JOIN c2 USING (b) LEFT JOIN c3 USING (c)
  LEFT JOIN (SELECT a AS before_a, n1 AS p1 FROM c1) USING (before_a) LEFT JOIN (SELECT b AS before_b, n2 AS p2 FROM c2) USING (before_b)
), d AS (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id)
SELECT w.doc_id, len(t)::BIGINT AS n_tokens, round(coalesce(x, 0.0::DOUBLE), 3) AS log_score, round(x / nullif(len(t), 0), 6) AS mean_log_score FROM w LEFT JOIN d USING (doc_id)
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), piece_model(), keep_pieces=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op6_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' ')))) AS shingle
  FROM w WHERE len(words) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT c.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.id
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _codes_sql() -> str:
    """Rounds of assignment and means as CTEs, over parts of eight components."""
    means = ", ".join(f"CAST(floor(CAST(sum(x[{i}]) AS DOUBLE) / count(*)) AS BIGINT)" for i in range(1, 9))
    steps = [f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT vec_id, label, part, x[part * 8 + 1 : part * 8 + 8] AS x FROM v, range({PARTS}) t(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES})"""]
    for k in range(CODE_ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(label) AS label, any_value(x) AS x,
  min(CAST(list_sum(list_transform(range(1, 9), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) * {ENTRIES} + e) AS k FROM p JOIN b{k} USING (part) GROUP BY vec_id, part)""")
        if k < CODE_ROUNDS:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(n.c, b{k}.c) AS c FROM b{k}
  LEFT JOIN (SELECT part, k % {ENTRIES} AS e, [{means}] AS c FROM a{k} GROUP BY part, k % {ENTRIES}) n USING (part, e))""")
    last = CODE_ROUNDS
    return ", ".join(steps) + f""", r AS (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', k % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(k // {ENTRIES}) AS BIGINT) AS error FROM a{last} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM b{last}) AS codebooks_sha256 FROM r
"""


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF.format("n_chars")} AS leaf, {_LEAF.format("(n_chars + 1)")} AS changed,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 7 = 0, false) AS hit,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents
), nodes AS (
  SELECT tree, 0 AS level, place AS i, leaf AS h, n FROM d
  UNION ALL SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2
), subroots AS (SELECT tree, h FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS i, h, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, i // 2
), steps AS (
  SELECT doc_id, l.level, (place >> l.level) % 2 AS odd, s.h FROM d JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) l USING (tree)
  LEFT JOIN nodes s ON s.tree = d.tree AND s.level = l.level AND s.i = xor(place >> l.level, 1)
  UNION ALL
  SELECT doc_id, 1000 + l.level, (tree >> l.level) % 2, s.h FROM d CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) l
  LEFT JOIN tops s ON s.level = l.level AND s.i = xor(tree >> l.level, 1)
), ways AS (
  SELECT doc_id, list({{'l': CASE WHEN odd = 1 THEN coalesce(h, '') ELSE '' END, 'v': '', 'r': CASE WHEN odd = 0 THEN coalesce(h, '') ELSE '' END}} ORDER BY level) AS way,
    coalesce(string_agg(h, '' ORDER BY level), '') AS proof FROM steps GROUP BY doc_id
), f AS (
  SELECT d.doc_id, leaf, subroots.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend({{'l': '', 'v': CASE WHEN hit THEN changed ELSE leaf END, 'r': ''}}, coalesce(way, [])), lambda a, s: {{'l': '', 'v': sha256(s.l || a.v || s.r), 'r': ''}}).v AS folded_root
  FROM d JOIN subroots USING (tree) LEFT JOIN ways ON ways.doc_id IS NOT DISTINCT FROM d.doc_id
)
SELECT *, folded_root = root AS verified FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_topk": op2_topk,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_backoff_lm": op4_backoff_lm,
        "op5_language_id": op5_language_id,
        "op6_semi_markov_pii": op6_semi_markov_pii,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_minhash": op8_minhash,
        "op9_toxicity": op9_toxicity,
        "op10_secret_forest": op10_secret_forest,
        "op11_packing": op11_packing,
        "op12_vector_codes": op12_vector_codes,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _mixing_sql(), "op2_topk": OP2_SQL, "op4_backoff_lm": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op8_minhash": OP8_SQL,
            "op12_vector_codes": _codes_sql(), "op13_manifest": OP13_SQL}
