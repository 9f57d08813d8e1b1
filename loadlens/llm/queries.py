"""The registered queries of the operators, opN_<name>, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm import bpe, collocations, decontam, langid, lattice, linedup, neardup, ngramjoin, pii, rules, sharding, variants, warc
from loadlens.llm.common import crc_mod, table
from loadlens.sources.shared import stage

Query = Callable[[SparkSession, str], DataFrame]


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of repeated line runs of 50 words or more."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.dedup_lines(documents).select("doc_id", "text", "n_lines", "n_deleted_lines")


OP7_SQL = r"""
WITH l AS (
    SELECT doc_id, text, u.n - 1 AS i, string_split(text, chr(10))[u.n] AS content
    FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n) u
), w AS (
    SELECT *, len(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) AS words FROM l
), c AS (
    SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
           count(*) OVER (PARTITION BY content) AS places
    FROM w
), r AS (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS stretch FROM c WHERE places > 1
), runs AS (
    -- every shortest run of 50 words from a line on, and back from a line
    SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM r a JOIN r b
        ON a.doc_id = b.doc_id AND a.stretch = b.stretch AND b.i >= a.i AND b.before + b.words - a.before >= 50
        GROUP BY ALL
    UNION
    SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM r a JOIN r b
        ON a.doc_id = b.doc_id AND a.stretch = b.stretch AND b.i >= a.i AND b.before + b.words - a.before >= 50
        GROUP BY b.doc_id, b.stretch, b.i
), contents AS (
    SELECT x.doc_id, x.s, x.e, string_agg(r.content, chr(10) ORDER BY r.i) AS body
    FROM runs x JOIN r ON r.doc_id = x.doc_id AND r.i BETWEEN x.s AND x.e GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY body, e - s ORDER BY doc_id, s) AS copy FROM contents
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM ranked WHERE copy > 1
)
SELECT w.doc_id, coalesce(string_agg(w.content, chr(10) ORDER BY w.i) FILTER (WHERE g.i IS NULL), '') AS text,
       count(*) AS n_lines, count(g.i) AS n_deleted_lines
FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i
GROUP BY w.doc_id
"""


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and lattice scores of all documents, learned from those that are not held out."""
    documents = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 7) == 2
    held = F.coalesce(held_out, F.lit(False)).alias("held_out")
    pieces = lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice.score(documents, ~held_out, pieces, keep=(F.col("doc_id"), held))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document; the ids themselves stay in the tasks."""
    return bpe.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        ids=False,
    )


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC archives and read them back as chunk rows."""
    chunks = warc.chunk_rows(table(spark, sf_dir, "pages"))
    manifest = warc.write_archives(chunks, warc.new_folder(spark))
    rows = warc.read_chunks(spark, manifest).where("last")
    # the digest of a response is the one computed while reading
    return rows.select(
        F.col("record_key").cast("long").alias("page_id"),
        F.when(F.col("record_type") == "response", F.col("bytes_so_far"))
        .otherwise(F.col("payload_bytes"))
        .alias("payload_bytes"),
        F.coalesce("digest_so_far", "payload_digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    documents = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    # a null id has no remainder: such rows are not held out and not learned from
    model = langid.train(documents.where(~held_out))
    held = F.coalesce(held_out, F.lit(False)).alias("held_out")
    return langid.predict(documents, model, keep=(F.col("doc_id"), held))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its best window."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are 0.85 alike."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of the learned decision list."""
    counts = stage(rules.statistics(table(spark, sf_dir, "documents")), "text-counts")
    learned = rules.learn(counts, rules.pick_labels(table(spark, sf_dir, "labels")))
    failed = F.expr(rules.BASE_FAILED)
    return counts.select(
        "doc_id",
        *rules.BASE,
        failed.alias("base_failed"),
        (~failed & rules.verdict(learned)).alias("kept"),
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, base forms and discovered identifiers."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, form and root."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH crc AS (
    -- the table of crc32 by its rule: eight steps from each byte
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM (SELECT unnest(range(0, 256)) AS i)
), r AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
    FROM documents
), d AS (
    SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL
), b AS (
    SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x:
        CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]::BIGINT[] END)) AS bytes
    FROM d
), h AS (
    SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
        list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) END AS h
    FROM b, crc
), v AS (
    SELECT CASE WHEN h % 31 = 0 THEN run[:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word, sum(n)::BIGINT AS n
    FROM h GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7
), cut AS (
    -- every word without one code point, and whole
    SELECT word, n, k, CASE WHEN k = 0 THEN word ELSE word[:k - 1] || word[k + 1:] END AS rest
    FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS k FROM v)
), near AS (
    SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest
    WHERE a.word <> b.word AND (a.k = b.k AND a.k > 0 OR a.k = 0 AND b.k > 0 OR a.k > 0 AND b.k = 0)
), best AS (
    SELECT word, n, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, near)) AS near FROM near GROUP BY word, n
), f AS (
    SELECT v.word, CASE WHEN most >= 10 * v.n THEN near END AS form, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
           CASE WHEN most >= 10 * v.n THEN most END AS form_n
    FROM v LEFT JOIN best ON v.word = best.word
), chain AS (
    WITH RECURSIVE c(word, root) AS (
        SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL
    )
    SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN chain ON f.word = chain.word
"""


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), totals AS (
    SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), places AS (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k
), g AS (
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
    SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2
), inside AS (
    SELECT DISTINCT a.lang, a.phrase FROM candidates a JOIN candidates b ON a.lang = b.lang AND b.k > a.k AND 100 * b.f >= 100 * a.f
        AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ')
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, cut, ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
    JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[:cut], ' ')
    JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ')
    JOIN totals t ON t.lang = c.lang
), scored AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS weakest FROM cuts
), ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM scored s ANTI JOIN inside i ON s.lang = i.lang AND s.phrase = i.phrase WHERE weakest = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are 0.9 alike."""
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def _components_sql(percent: int) -> str:
    """Components by all pairs of documents that share a three-word shingle."""
    return rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(ws) > 0 THEN list_distinct(list_transform(
        range(1, greatest(len(ws) - 2, 1) + 1), lambda i: array_to_string(ws[i:i + 2], ' '))) ELSE [] END AS shingles
    FROM w
), e AS (
    SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), reach AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
    SELECT a, min(b) AS b FROM reach GROUP BY a
), c AS (
    SELECT doc_id, coalesce(len(shingles), 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
    FROM s LEFT JOIN least ON a = doc_id
)
"""


OP5_SQL = _components_sql(85) + "SELECT doc_id, n_shingles, component_id, component_id = doc_id AS kept FROM c"
OP13_SQL = _components_sql(90) + "SELECT doc_id, n_shingles, component_id FROM c"


QUERIES: dict[str, Query] = {
    "op1_warc_chunks": op1_warc_chunks,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_histogram_shards": op4_histogram_shards,
    "op5_minhash_near_dup": op5_minhash_near_dup,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_lattice_lm": op8_lattice_lm,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_personal_data": op10_personal_data,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}
ORACLES: dict[str, str] = {
    "op1_warc_chunks": OP1_SQL,
    "op5_minhash_near_dup": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_phrase_collocations": OP12_SQL,
    "op13_ngram_jaccard": OP13_SQL,
}
