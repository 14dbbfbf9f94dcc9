"""The registered queries of the operators here, one for each, and their SQL.

Each query applies its operator to its whole table with production parameters
and derives the digest columns from the operator's real outputs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import dac, fim, jaccard, language, line_dedup, mix, mtree, onebit, packing, quality, secrets, viterbi, whitening
from tillsight.session import scratch_path

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, factor=256.0)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), threshold=0.8, size=5).drop("text_key")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "threshold")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents")).by_path
    base = F.filter("found", lambda x: x["kind_order"] < len(secrets.BASE))
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[of(r.kind) for r in secrets.BASE], F.sha2(secrets.span_list(base), 256).alias("base_sha256"),
                        secrets.span_list(F.col("found")).alias("spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix.mix(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "source_size", "target", mix.taken(F.col("takes")).alias("taken"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    model = language.fit(docs, ~held_out)
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "shares")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"llm-ids-{uuid.uuid4().hex}")
    dac.write(table(spark, sf_dir, "documents"), path, tokenizer())
    return dac.read(spark, path)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = packing.pack(table(spark, sf_dir, "documents"), tokenizer())
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.transform(table(spark, sf_dir, "documents"), unit="line", rate=100, spm_rate=50, seed=7)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings"), k=32, scale=64.0, offset=1_000_000))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
k AS (SELECT r, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, count(*) AS n_lines, count(h.key) AS n_dropped,
                coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE h.key IS NULL), '') AS body
         FROM k LEFT JOIN hot h ON k.key = h.key GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(body) AS kept_sha256
FROM kept JOIN d USING (r)
"""


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r, r AS m FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.m)
SELECT d.doc_id, min(o.doc_id) AS class_id, CAST((SELECT count(*) FROM e WHERE e.a = d.r) AS BIGINT) AS n_links
FROM d JOIN reach USING (r) JOIN d o ON o.r = reach.m GROUP BY d.r, d.doc_id
"""


def _spans_sql(order: int, kind: str, pattern: str, check: str = "TRUE") -> str:
    p = pattern.replace("'", "''")
    return f"""
SELECT r, {order} AS o, '{kind}' AS kind, s AS b, s + length(m) AS e FROM (
  SELECT r, m, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT r, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_split_to_array(t, '{p}')[1:len(regexp_extract_all(t, '{p}'))]) AS g,
               generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i FROM d)
  WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE {check}"""


_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans_sql(0, 'assign', _ASSIGN, "length(regexp_extract(m, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 12")}
UNION ALL {_spans_sql(1, 'access', 'AKIA[A-Z0-9]+', 'length(m) >= 18')}
UNION ALL {_spans_sql(2, 'hex', '[0-9a-f]+', 'length(m) >= 16')}
UNION ALL {_spans_sql(3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----')}
UNION ALL {_spans_sql(4, 'login', r'://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@')}),
f AS (SELECT r, count(*) FILTER (WHERE o = 0) AS a, count(*) FILTER (WHERE o = 1) AS k, count(*) FILTER (WHERE o = 2) AS h,
             string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, o) FILTER (WHERE o < 3) AS base,
             string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, o) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (r)
"""


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l FROM d),
c AS (SELECT *, len(l) AS n, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS UBIGINT) FOR i IN range(4)] AS g FROM u),
k AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b FROM c),
p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:], '') AS suf,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 100 THEN 'plain'
                  WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


QUERIES = (op1_line_dedup, op2_top_k, op3_jaccard_join, op4_quality_rules, op5_secret_scan, op6_token_counts, op7_source_mix, op8_language,
           op9_token_ids, op10_pack, op11_fill_in_middle, op12_whitening, op13_nearest)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracles() -> dict:
    return {"op1_line_dedup": OP1_SQL, "op2_top_k": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op5_secret_scan": OP5_SQL, "op11_fill_in_middle": OP11_SQL}
