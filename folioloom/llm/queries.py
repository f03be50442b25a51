"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import encode, leakage, markup, pairs, pii, scan_noise, site_lines, split
from folioloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return pairs.found(table(spark, directory, "query_summaries"))


def p1_labels(spark: SparkSession, directory: str) -> DataFrame:
    return pairs.labels(table(spark, directory, "query_summaries")).select("run_id", "answer_field", "defect", F.round("posterior", 3).alias("posterior"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, directory, "ocr_blocks")).select("block_key", "line_no")


def p2_templates(spark: SparkSession, directory: str) -> DataFrame:
    return site_lines.templates(table(spark, directory, "ocr_blocks"))


def p2_clean(spark: SparkSession, directory: str) -> DataFrame:
    return site_lines.without_repeated(table(spark, directory, "ocr_blocks"))


def p3_pieces(spark: SparkSession, directory: str) -> DataFrame:
    return split.split_chunks(*(table(spark, directory, t) for t in ("chunks", "sentences", "chunking_configs")))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return p3_pieces(spark, directory).where("oversized AND piece_no = 1").select("chunk_key")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return markup.markup_found(table(spark, directory, "ocr_blocks"))


def p4_clean(spark: SparkSession, directory: str) -> DataFrame:
    return markup.without_markup(table(spark, directory, "ocr_blocks"))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return scan_noise.noise_found(table(spark, directory, "ocr_blocks"))


def p5_paragraphs(spark: SparkSession, directory: str) -> DataFrame:
    return scan_noise.paragraphs(table(spark, directory, "ocr_blocks"))


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode.encode_texts(table(spark, directory, "documents"))


def p6_decoded(spark: SparkSession, directory: str) -> DataFrame:
    return encode.decode_ids(encode.encode_texts(table(spark, directory, "documents")))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return leakage.leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items")).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, directory: str) -> DataFrame:
    return leakage.without_leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items"))


_REPEATED = """
WITH cut AS (
    SELECT block_key, source, document_id, string_split(block_content, chr(10)) AS parts FROM ocr_blocks
    WHERE block_content IS NOT NULL AND coalesce(lower(trim(block_label)), '') NOT IN ('doc_title', 'paragraph_title', 'figure_title', 'table', 'number')
), lines AS (
    SELECT block_key, source, document_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM cut
), keyed AS (
    SELECT block_key, source, document_id, line_no, regexp_replace(lower(line), '[^\\p{L}]+', '', 'g') AS letters FROM lines
), repeated AS (
    SELECT block_key, line_no FROM keyed JOIN (
        SELECT source, letters FROM keyed WHERE length(letters) >= 10 GROUP BY 1, 2 HAVING count(DISTINCT document_id) >= 5
    ) USING (source, letters)
)
"""


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return pii.personal(table(spark, directory, "documents"))


def p8_masked(spark: SparkSession, directory: str) -> DataFrame:
    return pii.masked(table(spark, directory, "documents"))


_WORDS = "regexp_extract_all(lower(regexp_replace({}, '<!--.*?-->|</?[A-Za-z][^<>]*>|&[a-z]+;|&#[0-9]+;', ' ', 'gs')), '[\\p{{L}}\\p{{N}}]+')"


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_labels, p2_found, p2_templates, p2_clean, p3_found, p3_pieces, p4_found, p4_clean, p5_found, p5_paragraphs, p6_ids, p6_decoded, p7_found, p7_clean, p8_found, p8_masked)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"{_REPEATED} SELECT block_key, line_no FROM repeated",
        "p2_clean": f"""{_REPEATED}, gone AS (SELECT block_key, list(line_no) AS gone FROM repeated GROUP BY 1)
            SELECT block_key,
                   CASE WHEN gone IS NULL THEN block_content ELSE array_to_string(list_filter(string_split(block_content, chr(10)),
                       lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS block_content,
                   coalesce(len(gone), 0)::INT AS removed
            FROM ocr_blocks LEFT JOIN gone USING (block_key)""",
        "p3_found": """
            SELECT chunk_key FROM chunks JOIN chunking_configs USING (config_id)
            WHERE len(regexp_extract_all(text, '[^\\s\\x1c-\\x1f\\x0b\\x{85}\\p{Z}]+')) > max_tokens""",
        "p7_found": f"""WITH d AS (SELECT doc_id AS k, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
            i AS (SELECT item_id AS k, {_WORDS.format('item_text')} AS w FROM eval_items),
            dg AS (SELECT DISTINCT k, array_to_string(w[p : p + 7], ' ') AS gram FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
            ig AS (SELECT k, len(w) AS n, p, array_to_string(w[p : p + 7], ' ') AS gram FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS p FROM i)),
            hit AS (SELECT DISTINCT dg.k AS doc_id, ig.k AS item_id, n, unnest(range(p, p + 8)) AS nr FROM dg JOIN ig USING (gram))
            SELECT doc_id, item_id FROM hit GROUP BY doc_id, item_id, n HAVING count(DISTINCT nr) >= 0.4::DOUBLE * n""",
        # a text survives encoding and decoding unchanged
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
