"""The registered queries of this package, one per operator, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lines, negatives, packing, phrases, repeats, secrets, simhash, spotsigs, tokens, toolcalls, topk
from .common import public_tokenizer, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return register


@query("""
    WITH RECURSIVE c AS (
        SELECT conv_id, CAST(turn AS VARCHAR) AS call_id, turn, text, CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name,
               CAST(CASE WHEN turn >= 2 THEN turn - 2 WHEN turn = 1 THEN 0 END AS VARCHAR) AS parent_id
        FROM conversations WHERE role IN ('user', 'system')),
    a AS (SELECT conv_id, CAST(turn - 1 AS VARCHAR) AS call_id, text AS content FROM conversations WHERE role IN ('assistant', 'tool')),
    d AS (SELECT conv_id, call_id, 0 AS depth FROM c
          WHERE parent_id IS NULL OR (conv_id, parent_id) NOT IN (SELECT (conv_id, call_id) FROM c)
          UNION ALL SELECT c.conv_id, c.call_id, d.depth + 1 FROM c JOIN d ON c.conv_id = d.conv_id AND c.parent_id = d.call_id),
    l AS (SELECT c.*, d.depth, a.call_id IS NULL AS lone, content, p.call_id IS NULL AND c.parent_id IS NOT NULL AS lost
          FROM c JOIN d USING (conv_id, call_id) LEFT JOIN a USING (conv_id, call_id)
          LEFT JOIN c p ON p.conv_id = c.conv_id AND p.call_id = c.parent_id),
    u AS (SELECT conv_id, call_id, parent_id, name, CAST(depth AS BIGINT) AS depth, 1 AS copies, CASE WHEN lone THEN 0 ELSE 1 END AS n_results,
                 concat_ws(',', CASE WHEN length(text) < 1 OR length(text) > (CASE name WHEN 'reply' THEN 1000 ELSE 8000 END) THEN 'prompt:range' END,
                                CASE WHEN name = 'configure' AND turn <> 0 THEN 'turn:range' END,
                                CASE WHEN lost THEN 'no parent' END, CASE WHEN lone THEN 'no result' END) AS errors,
                 '{"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"id":"' || call_id || '","name":"' || name || '","parent":'
                 || coalesce('"' || parent_id || '"', 'null') || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS message
          FROM l
          UNION ALL
          SELECT conv_id, call_id, NULL, NULL, NULL, 0, 1, 'no call',
                 '{"arguments":null,"id":"' || call_id || '","name":null,"parent":null,"result":' || to_json(content) || '}'
          FROM a WHERE (conv_id, call_id) NOT IN (SELECT (conv_id, call_id) FROM c))
    SELECT conv_id, call_id, parent_id, name, depth, CAST(copies AS BIGINT) AS copies, CAST(n_results AS BIGINT) AS n_results, errors, message FROM u
""")
def op1_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    calls, results = toolcalls.conversation_calls(table(spark, sf, "conversations"))
    return toolcalls.link_calls(calls, results, toolcalls.TURNS).withColumn("errors", F.array_join("errors", ","))


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[]) AS BIGINT) AS score
          FROM e q JOIN e d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op2_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").where(topk.usable("embedding")).select("vec_id", topk.scaled("embedding").alias("v"))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return topk.top_k(queries, rows)


@query("""
    WITH l AS (SELECT doc_id, md5(text) AS h, source, unnest(string_split(text, chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
    common AS (SELECT line, min((doc_id, h, place)) AS at FROM l WHERE length(line) >= 20
               GROUP BY line HAVING count(DISTINCT source) >= 5),
    marked AS (SELECT l.*, common.line IS NOT NULL AND (l.doc_id, l.h, l.place) <> common.at AS gone FROM l LEFT JOIN common USING (line))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
""")
def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf, "documents"), counts=("n_lines", "n_removed"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizer("word_bpe_49k.json"))


@query()
def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf, "documents"), public_tokenizer("byte_bpe_50k.json"))


@query()
def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    found = langid.identify(table(spark, sf, "documents"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query()
def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op10_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secrets.BASE],
                        F.sha2(joined(of(*secrets.BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query()
def op11_spotsigs(spark: SparkSession, sf: str) -> DataFrame:
    found = spotsigs.edited_fingerprints(table(spark, sf, "documents"))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                        spotsigs.fingerprint("signatures").alias("fingerprint"),
                        spotsigs.fingerprint("edited_signatures").alias("edited_fingerprint"),
                        spotsigs.likeness("signatures", "edited_signatures").alias("near_edited"),
                        spotsigs.likeness("signatures", "next_signatures").alias("near_next"))


@query(r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
    t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
    g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
    c AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
    longer AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS a
               FROM (SELECT lang, a, ws, s, unnest(range(1, k - s + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS s) WHERE k > s) GROUP BY 1, 2),
    cut AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j + 1:], ' ') AS rest
            FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
    s AS (SELECT cut.lang, cut.phrase, cut.a, j, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * cut.a) // (x.a + y.a) AS BIGINT) AS score
          FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    k AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 80 * b.a),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
    SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
""")
def op12_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


@query("""
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))::DOUBLE[] AS v FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (SELECT q.vec_id AS anchor_id, d.vec_id, q.label = d.label AS same, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
          FROM e q JOIN e d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
          FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
""")
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").where(topk.usable("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), topk.scaled("embedding", 256).alias("v"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)
