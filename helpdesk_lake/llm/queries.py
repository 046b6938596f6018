"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, graph_ann, lm_bloom, merkle_manifest, minhash_forest, passage_chains, phrase_stripes, quality_rules, secret_scan,
               token_counts, toxic_cnn, vector_packing, word_bpe)
from .common import table, tokenizer_path


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_chains.repeated_passages(table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.search(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.language_scores(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_cnn.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verified_documents(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_stripes.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_quality, op3_repeated_passages, op4_ann, op5_token_counts, op6_decontamination,
                                 op7_bpe, op8_lm_scores, op9_toxicity, op10_secrets, op11_merkle_manifest, op12_packing, op13_collocations,
                                 pipeline)}

_WORDS = r"""
low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM low)"""

_ALPHABETS = "\n".join(f"WHEN regexp_full_match(v, '{p[1:-1]}') THEN '{a}'" for p, a in secret_scan.ENCODINGS[:-1])
_SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, 0 AS k, string_split_regex(t, $p${secret_scan.ASSIGN}$p$) AS ps, regexp_extract_all(t, $p${secret_scan.ASSIGN}$p$, 0) AS ms,
         regexp_extract_all(t, $p${secret_scan.ASSIGN}$p$, 1) AS vs FROM d
  UNION ALL SELECT doc_id, 1, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 2, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT doc_id, 3, string_split_regex(t, '{secret_scan.LONG}'), regexp_extract_all(t, '{secret_scan.LONG}'), regexp_extract_all(t, '{secret_scan.LONG}') FROM d),
one AS (SELECT doc_id, k, unnest(list_transform(ps[:len(ms)], lambda x: length(x))) AS p, unnest(list_transform(ms, lambda x: length(x))) AS n,
               unnest(vs) AS v, unnest(range(1, len(ms) + 1)) AS i FROM m),
span AS (SELECT doc_id, k, v, e - n AS s, e FROM (
           SELECT *, sum(p + n) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM one)
         WHERE length(v) >= CASE k WHEN 0 THEN 12 WHEN 1 THEN 18 WHEN 2 THEN 16 ELSE 20 END),
base AS (SELECT doc_id, k, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM span WHERE k < 3),
cand AS (SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, translate(v, '-_', '+/') AS w, CAST(length(v) AS DOUBLE) AS n,
                CASE {_ALPHABETS} ELSE '{secret_scan.ENCODINGS[-1][1]}' END AS abc FROM span WHERE k = 3),
sym AS (SELECT doc_id, s, i, n, CAST(length(abc) AS DOUBLE) AS k, CAST(instr(abc, substr(w, i, 1)) - 1 AS DOUBLE) AS x,
               CASE WHEN substr(w, i, 1) BETWEEN 'A' AND 'Z' THEN 'U' WHEN substr(w, i, 1) BETWEEN 'a' AND 'z' THEN 'L'
                    WHEN substr(w, i, 1) BETWEEN '0' AND '9' THEN 'D' ELSE 'S' END AS c
        FROM (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS i FROM cand)),
sq AS (SELECT doc_id, s, sum(q * q) AS q FROM (SELECT doc_id, s, x, count(*) AS q FROM sym GROUP BY ALL) GROUP BY ALL),
pre AS (SELECT *, lag(x) OVER w AS y, lag(c) OVER w AS b, avg(x) OVER (PARTITION BY doc_id, s) AS mu FROM sym WINDOW w AS (PARTITION BY doc_id, s ORDER BY i)),
agg AS (SELECT doc_id, s, any_value(n) AS n, any_value(k) AS k, CAST(sum(CASE WHEN x >= k / 2 THEN 1 ELSE 0 END) AS DOUBLE) AS ones,
               CAST(sum(CASE WHEN y IS NOT NULL AND (x >= k / 2) <> (y >= k / 2) THEN 1 ELSE 0 END) AS DOUBLE) AS flips,
               CAST(sum(CASE WHEN b IS NOT NULL AND b <> c THEN 1 ELSE 0 END) AS DOUBLE) AS ch,
               sum((x - mu) * (x - mu)) AS var, sum(coalesce((x - mu) * (y - mu), 0)) AS lagged FROM pre GROUP BY doc_id, s),
z AS (SELECT doc_id, s, n, ch / (n - 1) AS rate, greatest((k / n * q - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n), 0) AS z1,
             CASE WHEN 2 * ones * (n - ones) * (2 * ones * (n - ones) - n) > 0 THEN (flips - 2 * ones * (n - ones) / n)
               / sqrt(2 * ones * (n - ones) * (2 * ones * (n - ones) - n) / (n * n * (n - 1))) ELSE 30 END AS z2,
             CASE WHEN var > 0 THEN (lagged / var + 1 / n) * sqrt(n) ELSE 30 END AS z3 FROM agg JOIN sq USING (doc_id, s)),
top AS (SELECT doc_id, s, greatest(least(abs(z1), 30), least(abs(z2), 30), least(abs(z3), 30)) AS a,
               CASE WHEN rate > 0.1 THEN exp(-(n - 1) * (rate * ln(greatest(rate, 1e-9) / 0.1) + (1 - rate) * ln(greatest(1 - rate, 1e-9) / 0.9))) ELSE 1 END AS p FROM z),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, s) AS r, count(*) OVER (PARTITION BY doc_id) AS size FROM top),
last AS (SELECT doc_id, max(r) AS r FROM ranked WHERE p <= 0.001 * r / size GROUP BY doc_id),
extra AS (SELECT c.doc_id, 3 AS k, c.s, c.e FROM ranked x JOIN last l ON l.doc_id = x.doc_id AND x.r <= l.r JOIN cand c ON c.doc_id = x.doc_id AND c.s = x.s
          WHERE 3 * 2 / (1 + exp(1.5976 * a + 0.07056 * a * a * a)) >= 0.001
            AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
said AS (SELECT doc_id, k, s, e, concat_ws(':', CASE k WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'random' END, s, e) AS w
         FROM (SELECT * FROM base UNION ALL SELECT * FROM extra))
SELECT d.doc_id, CAST(count(*) FILTER (k = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (k = 1) AS BIGINT) AS n_access,
       CAST(count(*) FILTER (k = 2) AS BIGINT) AS n_hex, sha256(coalesce(string_agg(w, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
       coalesce(string_agg(w, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN said USING (doc_id) GROUP BY d.doc_id"""

# level by level: a run's nodes joined give the node above; `part` 0 is a source's tree, 1 the tree over all subroots
_MERKLE = """
WITH RECURSIVE f AS (
  SELECT doc_id, source, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, text,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
           lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda x, e: CASE WHEN e < 0 THEN xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) ELSE xor(x, e) END)) AS crc FROM documents),
h AS (SELECT *, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
             CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS bad FROM f),
d AS (SELECT doc_id, leaf, coalesce(bad, leaf) AS claimed, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS id,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n,
             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM h),
low AS (SELECT t, 0 AS l, p AS i, leaf AS h, n FROM d
        UNION ALL SELECT t, l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM low WHERE n > 1 GROUP BY t, l, i // 16, n),
sub AS (SELECT t, h AS subroot FROM low WHERE n = 1),
high AS (SELECT -1 AS t, 0 AS l, t AS i, subroot AS h, count(*) OVER () AS n FROM sub
         UNION ALL SELECT t, l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM high WHERE n > 1 GROUP BY t, l, i // 16, n),
top AS (SELECT h AS root FROM high WHERE n = 1),
node AS (SELECT 0 AS part, * FROM low WHERE n > 1 UNION ALL SELECT 1, * FROM high WHERE n > 1),
place AS (SELECT d.id, v.part, v.l, v.t, CASE v.part WHEN 0 THEN d.p ELSE d.t END // (CAST(1 AS BIGINT) << (4 * v.l)) AS own
          FROM d JOIN (SELECT DISTINCT part, t, l FROM node) v ON v.t = CASE v.part WHEN 0 THEN d.t ELSE -1 END),
step AS (SELECT e.id, e.part, e.l, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS a, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS b
         FROM place e JOIN node ON node.part = e.part AND node.t = e.t AND node.l = e.l AND node.i // 16 = e.own // 16 GROUP BY e.id, e.part, e.l),
way AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, l) AS k, count(*) OVER (PARTITION BY id) AS ks FROM step),
fold AS (SELECT id, CAST(1 AS BIGINT) AS k, claimed AS h FROM d
         UNION ALL SELECT fold.id, fold.k + 1, sha256(a || fold.h || b) FROM fold JOIN way ON way.id = fold.id AND way.k = fold.k),
done AS (SELECT id, arg_max(h, k) AS folded FROM fold GROUP BY id),
proof AS (SELECT id, string_agg(a || b, '' ORDER BY k) AS s FROM way GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(s, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM d JOIN sub USING (t) JOIN done USING (id) LEFT JOIN proof USING (id), top"""

ORACLES = {
    "op1_minhash_dedup": f"""
WITH RECURSIVE {_WORDS},
sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM tok),
one AS (SELECT doc_id, unnest(s) AS x FROM sh),
size AS (SELECT doc_id, len(s) AS n FROM sh),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk(v, r) AS (SELECT doc_id, doc_id FROM size UNION SELECT edge.b, walk.r FROM walk JOIN edge ON edge.a = walk.v)
SELECT size.doc_id, CAST(n AS BIGINT) AS n_shingles, min(r) AS component_id, size.doc_id = min(r) AS kept
FROM size JOIN walk ON walk.v = size.doc_id GROUP BY size.doc_id, n""",
    "op10_secrets": _SECRETS,
    "op11_merkle_manifest": _MERKLE,
    "op13_collocations": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT id, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(string_split_regex(t, '[.,;:!?\x0A-\x0D]'), 1) AS q FROM d),
w AS (SELECT id, lang, q, unnest(regexp_extract_all(piece, '[^\x20\x09]+')) AS x, generate_subscripts(regexp_extract_all(piece, '[^\x20\x09]+'), 1) AS i FROM p),
v AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY id, q ORDER BY i)),
g AS (SELECT lang, 1 AS k, [x] AS g FROM v UNION ALL SELECT lang, 2, [x, y] FROM v WHERE y IS NOT NULL UNION ALL SELECT lang, 3, [x, y, z] FROM v WHERE z IS NOT NULL),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT c.lang, c.g, c.a, s.k AS cut, x.f AS l, y.f AS r, CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f) AS score
        FROM c JOIN (VALUES (1), (2)) s(k) ON s.k < c.k JOIN f x ON x.lang = c.lang AND x.g = c.g[:s.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[s.k + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
longer AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM c WHERE k = 3) GROUP BY lang, g),
kept AS (SELECT best.*, array_to_string(g, ' ') AS phrase FROM best WHERE NOT EXISTS (
           SELECT 1 FROM longer o WHERE o.lang = best.lang AND o.g = best.g AND 100 * o.a >= 50 * best.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
