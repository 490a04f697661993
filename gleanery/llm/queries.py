"""The ten operators as queries over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import chat, ctw, langid, mixing, packing, pivots, rans, secrets, simhash, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_groups(_table(spark, sf_dir, "embeddings"))


def _altered(j: int):
    return lambda x, i: x * (1 + 0.02 * j * ((i * 7 + j) % 5 - 2))


def embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first operator over all vectors and three altered copies of each, of which it has to find the links."""
    t = _table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    made = [F.transform(v, _altered(j)) for j in range(3)]
    made.append(made[0])
    parts = [t.select((F.col("vec_id") * 4 + j).alias("vec_id"), x.alias("embedding")) for j, x in enumerate(made)]
    return pivots.near_groups(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


def op2_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated set of queries, rows whose id is divisible by 20, against all rows."""
    t = _table(spark, sf_dir, "embeddings")
    return topk.search(t.where("vec_id % 20 = 0"), t)


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op8_rans_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_shards(_table(spark, sf_dir, "documents"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_pairs, op2_code_length, op3_packing, op4_topk, op5_simhash_groups, op6_language, op7_perspectives,
        op8_rans_shards, op9_mixture, op10_secrets, embedding_copies,
    )
}

_VECTORS = """
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
"""


def _near_groups(vectors: str) -> str:
    """Copies, links and classes of ``vectors(vec_id, v)``, all pairs compared."""
    return f"""
        WITH RECURSIVE x AS ({vectors}),
        d AS (
            SELECT v, min(vec_id) AS least, count(*) AS n, row_number() OVER () AS node FROM x
            WHERE vec_id IS NOT NULL AND len(v) > 0 AND list_dot_product(v, v) > 0 GROUP BY v
        ),
        e AS (
            SELECT a.node AS a, b.node AS b FROM d a JOIN d b ON a.node <> b.node AND len(a.v) = len(b.v)
            WHERE round(list_cosine_similarity(a.v, b.v), 6) >= {pivots.THRESHOLD}
        ),
        r AS (SELECT node, node AS reached FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
        c AS (SELECT r.node, min(d.least) AS class_id FROM r JOIN d ON d.node = r.reached GROUP BY r.node),
        l AS (SELECT a, count(*) AS links FROM e GROUP BY a)
        SELECT x.vec_id, coalesce(c.class_id, x.vec_id) AS class_id, coalesce(d.n - 1, 0)::BIGINT AS n_copies, coalesce(l.links, 0)::BIGINT AS n_links
        FROM x LEFT JOIN d ON x.v = d.v AND x.vec_id IS NOT NULL LEFT JOIN c USING (node) LEFT JOIN l ON l.a = d.node
    """


ORACLE = {
    "op1_embedding_pairs": _near_groups("SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings"),
    "embedding_copies": _near_groups("""
        SELECT vec_id * 4 + j AS vec_id, list_transform(embedding, lambda x, i: x::DOUBLE * (1 + 0.02::DOUBLE * (j % 3) * (((i - 1) * 7 + j % 3) % 5 - 2))) AS v
        FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS j)
    """),
    "op4_topk": f"""
        WITH x AS ({_VECTORS}),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
            FROM x a JOIN x b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id)::INTEGER AS rank, neighbor_id, similarity
        FROM s QUALIFY rank <= {topk.K}
    """,
    "op6_language": f"""
        WITH n AS (
            SELECT doc_id, lang, row_number() OVER () AS r,
                string_split(trim(regexp_replace(lower(text), '[^a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')), ' ') AS words
            FROM documents
        ),
        t AS (SELECT r, lang, hex(encode(' ' || word || ' ')) AS h, count(*) AS times FROM (SELECT r, lang, unnest(words) AS word FROM n) WHERE word <> '' GROUP BY ALL),
        g AS (
            SELECT r, lang, times, substr(h, 2 * i + 1, 2 * size) AS gram
            FROM (SELECT r, lang, h, times, size, unnest(range(0, length(h) // 2 - size + 1)) AS i FROM t, (SELECT unnest([1, 2, 3]) AS size))
        ),
        c AS (
            SELECT r, lang, gram, sum(times)::BIGINT AS times FROM g
            WHERE gram <> '20' AND NOT (length(gram) = 6 AND substr(gram, 3, 2) = '20') GROUP BY r, lang, gram
        ),
        d AS (SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY times DESC, gram) - 1 AS rank FROM c QUALIFY rank < {langid.TOP}),
        p AS (
            SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(times) DESC, gram) - 1 AS rank
            FROM c WHERE lang IS NOT NULL GROUP BY lang, gram QUALIFY rank < {langid.TOP}
        ),
        l AS (SELECT DISTINCT lang FROM p),
        s AS (
            SELECT d.r, l.lang, sum(coalesce(abs(d.rank - p.rank), {langid.TOP}))::DOUBLE / (count(*) * {langid.TOP}.0::DOUBLE) AS dist
            FROM d CROSS JOIN l LEFT JOIN p ON p.lang = l.lang AND p.gram = d.gram GROUP BY ALL
        ),
        o AS (SELECT r, lang, dist, row_number() OVER (PARTITION BY r ORDER BY dist, lang) AS nth FROM s),
        b AS (SELECT r, max(lang) FILTER (nth = 1) AS lang, max(dist) FILTER (nth = 1) AS near, max(dist) FILTER (nth = 2) AS second FROM o GROUP BY r)
        SELECT doc_id, CASE WHEN fits THEN lang ELSE '{langid.UNKNOWN}' END AS detected,
            floor(near * 1e6 + 0.5) / 1e6 AS distance, floor(second * 1e6 + 0.5) / 1e6 AS runner_up, NOT fits AS rejected
        FROM (
            SELECT n.doc_id, b.lang, near, second,
                coalesce(near <= {langid.REJECT}, false) AND NOT coalesce(near > {langid.DOUBT} AND second - near < {langid.MARGIN}::DOUBLE, false) AS fits
            FROM n LEFT JOIN b USING (r)
        )
    """,
    "op7_perspectives": """
        WITH t AS (
            SELECT conv_id, turn, replace(CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END, '<|', '< |') AS who,
                replace(coalesce(text, ''), '<|', '< |') AS said
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, said) AS nth FROM t),
        p AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'),
        m AS (
            SELECT conv_id, perspective, nth, who = perspective AS own, said || '<|im_end|>' AS body,
                '<|im_start|>' || CASE WHEN who = perspective THEN 'assistant' WHEN who = 'system' THEN who ELSE 'user name=' || who END || chr(10) AS head
            FROM o JOIN p USING (conv_id)
        ),
        a AS (
            SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY nth) - length(body) - 1 AS pos FROM m
        )
        SELECT conv_id, perspective, count(*) AS n_turns, coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_trained,
            string_agg(head || body, chr(10) ORDER BY nth) || chr(10) AS chat,
            coalesce(string_agg(pos::BIGINT || '-' || (pos + length(body))::BIGINT, ',' ORDER BY nth) FILTER (own), '') AS mask
        FROM a GROUP BY conv_id, perspective
    """,
    "op9_mixture": f"""
        WITH d AS (
            SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(text), '') AS key,
                CASE WHEN length(text) > 0 THEN greatest(1, floor(sqrt(length(text)))) ELSE 0 END::BIGINT AS mass
            FROM documents
        ),
        b AS (SELECT source, sum(mass)::BIGINT AS mass_all, count(*) AS n FROM d GROUP BY source),
        w AS (SELECT *, CASE WHEN mass_all > 0 THEN sqrt(n::DOUBLE) ELSE 0 END AS w, round(sum(n) OVER () * {mixing.RATE}::DOUBLE)::BIGINT AS total FROM b),
        s AS (SELECT *, total * w / sum(w) OVER () AS share FROM w QUALIFY w > 0),
        q AS (
            SELECT source, mass_all, floor(share)::BIGINT + (row_number() OVER (ORDER BY share - floor(share) DESC, source NULLS FIRST)
                <= total - sum(floor(share)::BIGINT) OVER ())::BIGINT AS places
            FROM s
        ),
        e AS (
            SELECT doc_id, d.source, places, places::DOUBLE * mass / mass_all AS expected, floor(expected)::BIGINT AS whole, expected - whole AS p,
                (('0x' || substr(md5(key || '|{mixing.SEED}'), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r}::DOUBLE AS u
            FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE mass > 0
        ),
        r AS (
            SELECT *, places - sum(whole) OVER (PARTITION BY source) AS missing,
                row_number() OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id NULLS FIRST) AS nth
            FROM e
        )
        SELECT doc_id, source, expected, whole + (p > 0 AND nth <= missing)::BIGINT AS copies FROM r WHERE copies > 0
    """,
}
