"""Queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import ann, bpe, collocation, exact, langid, minhash, packing, preference, quality, spelling, suffix, toxicity, warc
from palisade.llm.common import fold_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, d):
    return suffix.remove_repeats(table(spark, d, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query("op2_ann")
def op2_ann(spark, d):
    return ann.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op3_minhash")
def op3_minhash(spark, d):
    return minhash.near_groups(table(spark, d, "documents"))


@query("op4_packing")
def op4_packing(spark, d):
    pieces = packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op5_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op5_exact_dedup(spark, d):
    found = exact.exact_groups(table(spark, d, "documents"), digest=True)
    return found.withColumn("kept", F.col("doc_id") == F.col("keep_id"))  # null for a null id, as in SQL


@query("op6_byte_bpe")
def op6_byte_bpe(spark, d):
    return bpe.encode_decode(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                             public_tokenizers.PATTERN, digests=True)


@query("op7_preference", """
WITH turns AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, turn,
                      coalesce(role, 'user') AS role, coalesce(text, '') AS text
               FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS k,
                  '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM turns),
differ AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k
           FROM (SELECT * FROM placed WHERE side) a
           FULL JOIN (SELECT * FROM placed WHERE NOT side) b ON a.pair_id = b.pair_id AND a.k = b.k
           WHERE a.k IS NULL OR b.k IS NULL OR a.role <> b.role OR a.text <> b.text),
cut AS (SELECT p.pair_id, coalesce(min(d.k) - 1, max(p.k)) AS n
        FROM placed p LEFT JOIN differ d ON p.pair_id = d.pair_id GROUP BY p.pair_id),
tails AS (SELECT p.*, sum(length(head) + length(body)) OVER (PARTITION BY p.pair_id, side ORDER BY k) AS stop
          FROM placed p JOIN cut c ON p.pair_id = c.pair_id WHERE p.k > c.n),
done AS (SELECT pair_id, side, string_agg(head || body, '' ORDER BY k) AS body,
                string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY k)
                    FILTER (role = 'assistant') AS mask
         FROM tails GROUP BY pair_id, side)
SELECT c.pair_id::BIGINT AS pair_id, c.n::BIGINT AS n_prompt_turns,
       coalesce((SELECT string_agg(head || body, '' ORDER BY k) FROM placed p
                 WHERE p.pair_id = c.pair_id AND p.k <= c.n AND p.side), '') AS prompt,
       CASE WHEN EXISTS (SELECT 1 FROM placed p WHERE p.pair_id = c.pair_id AND p.side)
            THEN coalesce(a.body, '') END AS chosen,
       CASE WHEN EXISTS (SELECT 1 FROM placed p WHERE p.pair_id = c.pair_id AND NOT p.side)
            THEN coalesce(b.body, '') END AS rejected,
       coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask
FROM cut c LEFT JOIN done a ON a.pair_id = c.pair_id AND a.side
           LEFT JOIN done b ON b.pair_id = c.pair_id AND NOT b.side
""")
def op7_preference(spark, d):
    """Conversation 2k is the chosen answer, 2k + 1 the rejected one."""
    rows = table(spark, d, "conversations").select(
        F.expr("conv_id div 2").alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("chosen"), "turn", "role", "text")
    spans = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ","), F.lit(""))  # noqa: E731,E501
    return preference.preference_pairs(rows).withColumns(
        {c: spans(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


@query("op8_langid")
def op8_langid(spark, d):
    docs = table(spark, d, "documents")
    held = fold_of("doc_id", 4) == 2
    model = langid.fit_profiles(docs.where(~held))
    found = langid.identify(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def _scored(scores: DataFrame, least: float) -> DataFrame:
    return scores.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))


@query("op9_quality")
def op9_quality(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = quality.fit_quality(docs, labels.where(fold_of("doc_id", 5) != 0))
    return _scored(quality.score_quality(docs, model), 0.3)


@query("op10_toxicity")
def op10_toxicity(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(fold_of("doc_id", 5) != 0))
    return _scored(toxicity.score_toxicity(docs, model), 0.5)


@query("op11_warc", """
WITH own AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
hashed AS (SELECT *, sha1(html) AS hex FROM own)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1), '' ORDER BY i, s DESC)
        FROM (SELECT i, ('0x' || substr(hex, i * 5 + 1, 5))::BIGINT AS v FROM range(8) t(i)) five, (VALUES (15), (10), (5), (0)) f(s)) AS payload_digest,
       CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last IS NULL OR page_id = last THEN NULL ELSE last END AS refers_to
FROM hashed
""")
def op11_warc(spark, d):
    return warc.archived(table(spark, d, "pages"))


@query("op12_collocations", """
WITH pieces AS (
    SELECT row_number() OVER () AS piece, lang, list_filter(string_split(replace(t, chr(9), ' '), ' '), lambda x: x <> '') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[.,;:!?\x0A-\x0D]')) AS t FROM documents)),
grams AS (
    SELECT lang, k.k AS k, array_to_string(w[i.i:i.i + k.k - 1], ' ') AS phrase, count(*) AS f
    FROM pieces, range(1, 5) k(k), unnest(range(1, len(w) - k.k + 2)) i(i) GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
inner_parts AS (
    SELECT g.lang, g.f, array_to_string(string_split(g.phrase, ' ')[a.a:b.b], ' ') AS phrase
    FROM grams g, range(1, 4) a(a), range(2, 5) b(b)
    WHERE g.k > 2 AND b.b <= g.k AND b.b - a.a >= 1 AND b.b - a.a + 1 < g.k),
most AS (SELECT lang, phrase, max(f) AS f FROM inner_parts GROUP BY ALL),
kept AS (SELECT g.* FROM grams g LEFT JOIN most m USING (lang, phrase) WHERE g.k > 1 AND NOT coalesce(100 * m.f >= 80 * g.f, false)),
cuts AS (
    SELECT g.lang, g.phrase, g.f AS a, c.c AS c, x.f AS l, y.f AS r,
           ((2000000 * g.f::HUGEINT) // (x.f + y.f))::BIGINT AS score
    FROM kept g, range(1, 4) c(c)
    JOIN grams x ON x.lang = g.lang AND c.c < g.k AND x.phrase = array_to_string(string_split(g.phrase, ' ')[1:c.c], ' ')
    JOIN grams y ON y.lang = g.lang AND y.phrase = array_to_string(string_split(g.phrase, ' ')[c.c + 1:], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""")
def op12_collocations(spark, d):
    return collocation.collocations(table(spark, d, "documents"))


@query("op13_spelling")
def op13_spelling(spark, d):
    return spelling.spelling_variants(table(spark, d, "documents"))
