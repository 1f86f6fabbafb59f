"""The corpus queries of the driver's contract, each a thin layer on its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm.bpe import bpe_roundtrip
from tidecast.llm.centroids import cluster
from tidecast.llm.chat_views import rotate_perspectives
from tidecast.llm.collocations import collocations
from tidecast.llm.common import read
from tidecast.llm.exact_dedup import exact_dedup
from tidecast.llm.line_dedup import line_groups
from tidecast.llm.packing import pack
from tidecast.llm.repeats import runs_removed
from tidecast.llm.set_join import similar_texts
from tidecast.llm.simhash import simhash_groups
from tidecast.llm.tiff import media_features
from tidecast.llm.toxicity import score_toxicity, train
from tidecast.llm.url_filter import filter_urls


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on the driver."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_groups(read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_removed(read(spark, sf_dir, "documents"))


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read(spark, sf_dir, "documents"))


def op7_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(read(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, read(spark, sf_dir, "labels")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def op12_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_simhash, op3_exact_dedup, op4_packing, op5_repeats, op6_tiff, op7_chat_views, op8_toxicity, op9_bpe, op10_url_filter, op11_centroids, op12_set_join, op13_collocations)}


NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Each round as a table of centroid components; integers throughout."""
    ctes = [
        """own AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding AS e FROM embeddings
          WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0)""",
        "v AS MATERIALIZED (SELECT r, vec_id, i, floor(1024 * e[i]::DOUBLE)::BIGINT AS x FROM own, range(1, 65) t(i))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS c FROM own ORDER BY c LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN v USING (r))",
    ]
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d FROM v JOIN c{n} m USING (i) GROUP BY r, c) GROUP BY r)")
        if n < rounds:
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, o.x)::BIGINT AS x FROM c{n} o LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN v USING (r) GROUP BY c, i) USING (c, i))")
    return f"""WITH {', '.join(ctes)},
        digest AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN own USING (r) JOIN digest USING (c)"""


ORACLE = {
    "op12_set_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({NORM}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle FROM d, unnest(range(1, greatest(len(ws) - 2, 2))) u(i) WHERE len(ws) > 0),
        size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY a, b),
        e AS MATERIALIZED (SELECT a, b FROM met JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * c >= 85 * (s.n + t.n - c)),
        reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reached JOIN e ON e.a = other)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN size USING (doc_id)""",
    "op13_collocations": rf"""
        WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(norm, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, {NORM} AS norm FROM documents)),
        cut AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
        total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM cut GROUP BY lang),
        f AS MATERIALIZED (SELECT lang, ws[i:i + k - 1] AS p, count(*) AS a FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM cut, range(1, 6) t(k)) GROUP BY lang, p HAVING count(*) >= 100),
        covered AS (SELECT lang, p[2:] AS p, a FROM f WHERE len(p) > 2 UNION SELECT lang, p[:len(p) - 1], a FROM f WHERE len(p) > 2),
        cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f ANTI JOIN covered USING (lang, p, a) WHERE len(p) > 1),
        scored AS (SELECT lang, c.p, c.a, x.a AS l, y.a AS r, n, k, ((1000 * c.a::HUGEINT * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
          FROM cuts c JOIN total USING (lang) JOIN f x USING (lang) JOIN f y USING (lang) WHERE x.p = c.p[:k] AND y.p = c.p[k + 1:]),
        best AS (SELECT *, array_to_string(p, ' ') AS phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM best WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000""",
    "op11_centroids": clusters_sql(),
    "op3_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {NORM} AS norm FROM documents) WINDOW w AS (PARTITION BY norm)""",
    "op5_repeats": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        windows AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM d, unnest(range(1, len(ws) - 48)) u(s) WHERE len(ws) >= 50),
        firsts AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, p FROM windows JOIN firsts USING (h), unnest(range(s, s + 50)) u(p) WHERE first_id < doc_id),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS line, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_chat_views": """
        WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations),
        who AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
        marked AS (
          SELECT t.*, perspective, role IS NOT DISTINCT FROM perspective AS own,
                 '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
                   WHEN role IS NULL THEN 'user' ELSE 'user name=' || role END || chr(10) AS opening
          FROM t JOIN who USING (conv_id)),
        lines AS (SELECT *, opening || text || '<|im_end|>' || chr(10) AS rendered FROM marked),
        placed AS (
          SELECT *, coalesce(CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, rendered
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM lines)
        SELECT conv_id, perspective, turn, role, rendered, start,
               CASE WHEN own THEN start + length(opening) END AS mask_start,
               CASE WHEN own THEN start + length(rendered) END AS mask_end
        FROM placed""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
