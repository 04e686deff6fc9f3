"""The operators applied to the given tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against every passage of every document; a row for each pair found."""
    from netgrid.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of at least 0.9."""
    from netgrid.llm.jaccard import jaccard_join

    members, _ = jaccard_join(table(spark, sf_dir, "documents"), k=3, num=9, den=10)
    return members.select("doc_id", "n_shingles", "component_id")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from netgrid.llm.html import extract_text

    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold 2 of 4 by crc32 is held out."""
    from netgrid.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held=2, modulus=4)


def op3_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written and read back; payloads of 1000 bytes and more are stored once."""
    from netgrid.llm.warc import warc_round_trip

    records, _ = warc_round_trip(table(spark, sf_dir, "pages"), least=1000)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens of the byte-level vocabulary, end id 2."""
    from netgrid.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2, capacity=1024)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold 0 of 5 by crc32 is held out."""
    from netgrid.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held=0, modulus=5)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of every text and of its edited text, and their likeness."""
    from netgrid.llm.syncmers import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold 0 of 5 by crc32 is held out."""
    from netgrid.llm.language import languages

    return languages(table(spark, sf_dir, "documents"), held=0, modulus=5)


def op8_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the word-end vocabulary, end id 2, written and read back."""
    from netgrid.llm.elias_fano import token_id_files

    return token_id_files(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2)[0]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf per document, a tree per source and one over the sources, a proof per leaf."""
    from netgrid.llm.merkle import merkle_manifest

    return merkle_manifest(table(spark, sf_dir, "documents"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are removed from every document."""
    from netgrid.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is an anchor; labels of every seventh are moved on by one."""
    from netgrid.llm.negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), positives=5, negatives=5, low=80, high=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_warc_writer": op3_warc_writer,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_language_id": op7_language_id,
    "op8_token_id_files": op8_token_id_files,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_suffix_array_dedup": op12_suffix_array_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        often AS (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1),
        t AS (SELECT s.* FROM s SEMI JOIN often USING (shingle)),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 90 * (x.n + y.n - m)),
        b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
        r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE r.root < b.v)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id)
        JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = w.doc_id""",
    "op3_warc_writer": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS html, sha1(encode(coalesce(html, ''))) AS payload_digest,
                 octet_length(encode(coalesce(html, ''))) AS payload_bytes
          FROM pages),
        g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN top <> page_id THEN top END AS refers_to
        FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000""",
    # levels of sixteen a step; crc32 of the id's digits, bit by bit
    "op11_merkle_manifest": """
        WITH RECURSIVE f AS (
          SELECT doc_id, source,
            coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
            || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
            || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
            text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
            xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
              lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda z, i: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END, xor(c, b)),
              CAST(4294967295 AS BIGINT))) % 5 = 0 AS hit
          FROM documents),
        l AS (
          SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
            CASE WHEN hit THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS bad,
            row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
          FROM f),
        t AS (
          SELECT source, 0 AS lvl, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, leaf AS h FROM l
          UNION ALL
          SELECT source, any_value(lvl) + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, i // 16),
        s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (
          SELECT 0 AS lvl, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, subroot AS h FROM s
          UNION ALL
          SELECT any_value(lvl) + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // 16),
        -- for every node that has a level above: the siblings left and right of it
        a AS (
          SELECT x.source, x.lvl, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS r
          FROM t x JOIN t y ON x.source IS NOT DISTINCT FROM y.source AND x.lvl = y.lvl AND x.i // 16 = y.i // 16 WHERE x.n > 1 GROUP BY 1, 2, 3),
        b AS (
          SELECT x.lvl, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS r
          FROM u x JOIN u y ON x.lvl = y.lvl AND x.i // 16 = y.i // 16 WHERE x.n > 1 GROUP BY 1, 2),
        p AS (
          SELECT source, doc_id, 0 AS lvl, i, coalesce(bad, leaf) AS h, '' AS proof, n FROM l
          UNION ALL
          SELECT p.source, doc_id, p.lvl + 1, p.i // 16, sha256(a.l || p.h || a.r), proof || a.l || a.r, (p.n + 15) // 16
          FROM p JOIN a ON p.source IS NOT DISTINCT FROM a.source AND p.lvl = a.lvl AND p.i = a.i WHERE p.n > 1),
        q AS (
          SELECT doc_id, s.source, subroot, 0 AS lvl, s.i, h, proof, s.n FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source WHERE p.n = 1
          UNION ALL
          SELECT doc_id, source, subroot, q.lvl + 1, q.i // 16, sha256(b.l || q.h || b.r), proof || b.l || b.r, (q.n + 15) // 16
          FROM q JOIN b ON q.lvl = b.lvl AND q.i = b.i WHERE q.n > 1)
        SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, q.h AS folded_root, q.h = root.h AS verified
        FROM q JOIN l USING (doc_id) CROSS JOIN (SELECT h FROM u WHERE n = 1) root WHERE q.n = 1""",
    # bytes as pairs of hex digits
    "op12_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS later
              FROM (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS p FROM d))),
        r AS (SELECT doc_id, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k
              FROM (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, TRUE) AS new FROM w WHERE later)),
        s AS (SELECT doc_id, k, min(p) AS lo, max(p) + 100 AS hi FROM r GROUP BY doc_id, k),
        g AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS was FROM s),
        k AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, string_agg(substr(x, 2 * was + 1, 2 * (lo - was)), '' ORDER BY lo) AS kept, max(hi) AS upto
              FROM g JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN spans IS NULL THEN x ELSE kept || substr(x, 2 * upto + 1) END)) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op13_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                 CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5""",
}
