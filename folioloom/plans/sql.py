"""The same queries in SQL, for the operators that SQL can say."""

from __future__ import annotations

_SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_LETTER = r"\p{L}\p{N}_"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _unix(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _trimmed(x: str) -> str:
    each = f"list_transform(string_split({_unix(x)}, chr(10)), lambda s: {_strip('s')})"
    return f"regexp_replace(array_to_string({each}, chr(10)), '^\\n+|\\n+$', '', 'g')"


def _unescape(x: str) -> str:
    out = f"replace({x}, '&#8217;', '’')"
    for name, sign in (("lt", "<"), ("gt", ">"), ("nbsp", " "), ("copy", "©")):
        out = f"replace({out}, '&{name};', '{sign}')"
    return f"replace({out}, '&amp;', '&')"


def _words(x: str) -> str:
    flat = f"coalesce({_collapse(x)}, '')"
    return f"CASE WHEN {flat} = '' THEN 0 ELSE len(string_split({flat}, ' ')) END"


def _compact(x: str, most: int) -> str:
    flat = f"coalesce({_collapse(x)}, '')"
    return f"CASE WHEN length({flat}) <= {most} THEN {flat} ELSE rtrim(left({flat}, {most - 3})) || '...' END"


def _slug(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(regexp_replace(coalesce({_collapse(x)}, ''), '[^{_LETTER}.\\-]+', '_', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g')"
    return f"left(CASE WHEN {bare} = '' THEN 'defaulttitle' ELSE {bare} END, 80)"


def _safe(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(coalesce({x}, ''), '[^{_LETTER}\\-]', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"CASE WHEN {bare} = '' THEN 'document' ELSE {bare} END"


def _key(x: str) -> str:
    bare = _strip(f"coalesce({x}, '')")
    return f"CASE WHEN {bare} = '' THEN 'noquery' ELSE left(md5({bare}), 8) END"


_FIELDS = f"""
fields AS (
    SELECT block_key, document_id, page_index, block_id, block_order,
           coalesce(lower({_strip('block_label')}), '') AS label,
           coalesce({_trimmed(_unescape('block_content'))}, '') AS content,
           len(block_bbox) >= 4 AND block_bbox[1] IS NOT NULL AND block_bbox[2] IS NOT NULL AND block_bbox[3] IS NOT NULL AND block_bbox[4] IS NOT NULL AS whole,
           CASE WHEN whole THEN least(block_bbox[1], block_bbox[3])::DOUBLE END AS x1,
           CASE WHEN whole THEN least(block_bbox[2], block_bbox[4])::DOUBLE END AS y1,
           CASE WHEN whole THEN greatest(block_bbox[1], block_bbox[3])::DOUBLE END AS x2,
           CASE WHEN whole THEN greatest(block_bbox[2], block_bbox[4])::DOUBLE END AS y2
    FROM ocr_blocks
)"""
_KEPT = "content <> '' AND label NOT IN ('table', 'chart', 'image', 'seal', 'formula') AND NOT contains(label, 'image')"
_READING = "coalesce(block_order::DOUBLE, 1000000), coalesce(y1, 0), coalesce(x1, 0), coalesce(block_id, 1000000), block_key"
_PART = f"CASE label WHEN 'doc_title' THEN '# ' || {_collapse('content')} WHEN 'paragraph_title' THEN '## ' || {_collapse('content')} ELSE content END"
_MARKDOWN = f"""
markdown AS (
    SELECT document_id, page_index, string_agg({_PART}, chr(10) || chr(10) ORDER BY {_READING}) || chr(10) AS markdown, count(*)::INT AS blocks
    FROM fields WHERE {_KEPT} GROUP BY 1, 2
)"""
_TITLED = f"""
assets AS (
    SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_index, {_READING})::INT AS asset_index FROM fields WHERE label = 'table' AND whole
), pairs AS (
    SELECT a.block_key, t.block_key AS title_key, t.content AS title, t.label AS title_label, t.x1 AS tx1, t.y1 AS ty1, t.x2 AS tx2, t.y2 AS ty2,
           (t.y1 + t.y2) / 2 < (a.y1 + a.y2) / 2 AS above, (t.y1 + t.y2) / 2 > (a.y1 + a.y2) / 2 AS below,
           greatest(0, least(a.x2, t.x2) - greatest(a.x1, t.x1)) / greatest(1, least(a.x2 - a.x1, t.x2 - t.x1)) AS shared,
           greatest(0, CASE WHEN above THEN a.y1 - t.y2 ELSE t.y1 - a.y2 END) AS distance,
           CASE WHEN above THEN -t.y2 ELSE t.y1 END AS edge
    FROM assets a JOIN fields t ON a.document_id = t.document_id AND a.page_index = t.page_index AND a.block_key <> t.block_key
    WHERE t.whole AND t.label LIKE '%\\_title' ESCAPE '\\'
), best AS (
    SELECT * FROM pairs WHERE (above OR below) AND shared >= 0.15::DOUBLE AND distance <= 160
    QUALIFY row_number() OVER (PARTITION BY block_key ORDER BY CASE WHEN above THEN 0 ELSE 1 END, distance, edge, title_key) = 1
), titled AS (
    SELECT a.*, b.title_key, b.title, b.title_label, b.tx1, b.ty1, b.tx2, b.ty2, b.distance FROM assets a LEFT JOIN best b USING (block_key)
), sizes AS (
    SELECT document_id, page_index, arg_max_null(width, (landed_at, width)) AS width, arg_max_null(height, (landed_at, height)) AS height FROM ocr_pages GROUP BY 1, 2
), cropped AS (
    SELECT t.*, greatest(0, least(least(x1, tx1) - 8, width)) AS cx1, greatest(0, least(least(y1, ty1) - 8, height)) AS cy1,
           greatest(0, least(greatest(x2, tx2) + 8, width)) AS cx2, greatest(0, least(greatest(y2, ty2) + 8, height)) AS cy2
    FROM titled t JOIN sizes USING (document_id, page_index)
), manifest AS (
    SELECT document_id, 'table' AS asset_kind, asset_index, label AS asset_label, coalesce({_collapse('title')}, 'defaulttitle') AS name,
           printf('%s_%04d_page_%04d_%s.png', 'table', asset_index, (page_index + 1)::INT, {_slug("coalesce(title, 'defaulttitle')")}) AS filename,
           page_index + 1 AS page, [x1, y1, x2, y2]::DOUBLE[] AS bbox, title_label,
           CASE WHEN tx1 IS NOT NULL THEN [tx1, ty1, tx2, ty2]::DOUBLE[] END AS title_bbox, [cx1, cy1, cx2, cy2]::DOUBLE[] AS crop_bbox
    FROM cropped
)"""
_PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array({_unix('{x}')}, '\\n[ \\t]*\\n+'), lambda p: {_collapse('p')}), lambda p: p <> '')"
_SPLIT = r"""CASE WHEN regexp_matches({p}, '^#{{1,6}} +(.+)$') THEN [regexp_extract({p}, '^#{{1,6}} +(.+)$', 1)]
    ELSE list_filter(string_split(regexp_replace({p}, '([.!?]["”’)]*) (["“‘(]*[A-ZÀ-ÖØ-Þ0-9¿¡])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda s: s <> '') END"""


def _sentences(source: str, keys: str, column: str) -> str:
    paragraphs = _PARAGRAPHS.replace("{x}", column)
    return f"SELECT {keys}, flatten(list_transform({paragraphs}, lambda q: {_SPLIT.format(p='q')})) AS all_ FROM {source} WHERE {column} IS NOT NULL"


_CURRENT = f"""
sentence AS (
    SELECT document_id, sentence_id, min({_collapse('text')}) AS text, min(coalesce(page, (page_index + 1)::INT)) AS page
    FROM sentences WHERE {_collapse('text')} <> '' GROUP BY 1, 2
)"""
_CHUNKS = """
chunk AS (
    SELECT *, list_sort(list_distinct(list_filter(sentence_ids, lambda x: x IS NOT NULL))) AS ids FROM chunks
    QUALIFY row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY built_at DESC, chunk_key DESC) = 1
), held AS (SELECT * FROM chunk WHERE len(ids) > 0)"""
_ORDER = r"ids[1], ids[-1], len(ids), regexp_extract(chunk_id, '^(.*?)\d*$', 1), coalesce(try_cast(regexp_extract(chunk_id, '(\d+)$', 1) AS BIGINT), -1), chunk_id"
_WINDOWS = """
placed AS (
    SELECT document_id, list(sentence_id ORDER BY sentence_id) AS ids FROM sentence GROUP BY 1
), windows AS (
    SELECT document_id, k::INT AS block_id, ids[1 + k * 4 : k * 4 + 6] AS sentence_ids
    FROM (SELECT document_id, ids, unnest(range(0, greatest(0, ceil((len(ids) - 6) / 4.0))::BIGINT + 1)) AS k FROM placed)
)"""
_PIECES = f"""{_CURRENT}, {_CHUNKS}, {_WINDOWS}, pieces AS (
    SELECT document_id, document_id || '/' || chunk_id AS chunk_key, chunk_id, ids FROM held
    UNION ALL SELECT document_id, document_id || '/w' || block_id, 'w' || block_id, sentence_ids FROM windows
), flat AS (SELECT document_id, chunk_key, len(ids) AS n, unnest(ids) AS sid FROM pieces
), shared AS (
    SELECT a.document_id, a.chunk_key AS a, b.chunk_key AS b, a.n AS na, b.n AS nb, count(*) AS shared
    FROM flat a JOIN flat b ON a.document_id = b.document_id AND a.sid = b.sid AND a.chunk_key <> b.chunk_key GROUP BY ALL
), contained AS (
    SELECT document_id, a AS chunk_key, b AS target_key FROM shared WHERE shared = na AND (nb > na OR (nb = na AND b < a))
    QUALIFY row_number() OVER (PARTITION BY document_id, a ORDER BY nb DESC, b) = 1
)"""
_NEAR = "list_min(flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: abs(x - y)))))"
_VECTORS = """
records AS (SELECT vec_id, ['text', 'table', 'image'][label % 3 + 1] AS modality, embedding FROM embeddings),
asked AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
hits AS (
    SELECT query_id, modality, vec_id, list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS score,
           row_number() OVER (PARTITION BY query_id, modality ORDER BY score DESC, vec_id)::INT AS rank
    FROM asked q, records r QUALIFY rank <= CASE modality WHEN 'text' THEN 15 ELSE 5 END
)"""


def _retrieved(limit: float | str, within: bool = False) -> str:
    source = _VECTORS.replace("FROM asked q, records r", "FROM asked q JOIN records r ON q.label % 5 = r.label % 5").replace("embedding FROM", "embedding, label FROM") if within else _VECTORS
    return f"""{source}, marked AS (SELECT *, score >= ({limit})::DOUBLE AS passed FROM hits),
modes AS (
    SELECT q.query_id, CASE WHEN count(*) FILTER (passed AND modality = 'text') >= 6 THEN 'text_only'
        WHEN count(*) FILTER (passed) = 0 AND count(m.vec_id) > 0 THEN 'raw_fallback' ELSE 'multimodal' END AS mode
    FROM asked q LEFT JOIN marked m USING (query_id) GROUP BY 1
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY query_id, modality ORDER BY NOT passed, rank) AS place FROM marked
), chosen AS (
    SELECT p.* FROM placed p JOIN modes USING (query_id)
    WHERE (mode = 'text_only' AND modality = 'text' AND passed) OR mode = 'raw_fallback'
       OR (mode = 'multimodal' AND passed AND (modality = 'text' OR place <= CASE modality WHEN 'table' THEN 4 ELSE 3 END))
), retrieved AS (
    SELECT m.query_id, mode, modality, vec_id, rank, round(score, 6) AS score, passed FROM modes m LEFT JOIN chosen USING (query_id)
)"""


def _contexts(most: int = 80) -> str:
    return f"""{_retrieved(0.2)}, contexts AS (
    SELECT g.query_id, modality, vec_id, rank, round(g.score, 3) AS score, printf('rec_%06d', vec_id) AS id, query AS title, generated_answer AS content,
           coalesce(nullif(expected_answer, ''), generated_answer) AS summary, CASE WHEN modality <> 'text' THEN vec_id % 7 END AS page,
           CASE WHEN page > 3 THEN [page::DOUBLE, 2.5::DOUBLE] END AS bbox, CASE WHEN page IS NULL AND vec_id % 2 = 0 THEN [vec_id % 5, vec_id % 5 + 1] END AS page_span,
           row_number() OVER (PARTITION BY g.query_id, modality ORDER BY rank) AS place,
           CASE modality WHEN 'text' THEN 'E' WHEN 'table' THEN 'T' ELSE 'I' END || place AS evidence_id
    FROM retrieved g LEFT JOIN query_summaries s ON s.run_id = g.vec_id WHERE g.vec_id IS NOT NULL
), rendered AS (
    SELECT *, '[' || evidence_id || ']' || chr(10) || coalesce(nullif(concat_ws(chr(10),
        'Location: ' || nullif(concat_ws(', ', CASE WHEN page <> 0 THEN 'page ' || page END, CASE WHEN len(page_span) > 0 THEN 'page_span [' || array_to_string(page_span, ', ') || ']' END,
            CASE WHEN len(bbox) > 0 THEN 'bbox [' || array_to_string(list_transform(bbox, lambda v: v::VARCHAR), ', ') || ']' END), ''),
        'Score: ' || score::VARCHAR,
        'Title: ' || nullif({_compact('title', 240)}, ''),
        CASE WHEN {_compact('summary', most)} <> '' AND {_compact('summary', most)} <> {_compact('content', most)} THEN 'Summary: ' || {_compact('summary', most)} END,
        'Content: ' || nullif({_compact('content', most)}, '')), ''), 'Content: None.') AS lines
    FROM contexts
)"""


def _montage(width: int, columns: int) -> str:
    return f"""WITH images AS (
    SELECT run_id // 5 AS query_id, run_id % 5 + 1 AS place, 300 + run_id % 900 AS width, 200 + run_id % 700 AS height FROM query_summaries
), cells AS (
    SELECT query_id, (place - 1) // {columns} AS row, greatest(1, round_even(height * ({width}::DOUBLE / width), 0))::INT + 48 AS cell FROM images
), rows AS (SELECT query_id, row, max(cell) AS high, count(*) AS n FROM cells GROUP BY ALL
), raw AS (
    SELECT query_id, sum(n)::BIGINT AS cells, (24 + sum(high) + 24 * count(*))::INT AS raw_height, {24 + columns * (width + 24)} AS raw_width FROM rows GROUP BY 1
), scaled AS (SELECT *, {_scale('raw_width', 'raw_height')} AS s FROM raw
) SELECT query_id, cells, raw_width, raw_height, {_fit('raw_width', 'raw_height', 'width')}, {_fit('raw_width', 'raw_height', 'height')} FROM scaled"""


def _scale(w: str, h: str) -> str:
    return f"CASE WHEN {w}::DOUBLE * {h} > 1003520 THEN sqrt(1003520::DOUBLE / ({w}::DOUBLE * {h})) WHEN {w}::DOUBLE * {h} < 200704 THEN sqrt(200704::DOUBLE / ({w}::DOUBLE * {h})) ELSE 1::DOUBLE END"


def _fit(w: str, h: str, side: str) -> str:
    fw, fh = (f"greatest(1, floor({x} * s))::INT" for x in (w, h))
    over = f"({fw} * {fh} > 1003520)"
    wide = f"CASE WHEN {over} THEN greatest(1, {fw} - 1) ELSE {fw} END"
    high = f"CASE WHEN {over} THEN greatest(1, floor(1003520::DOUBLE / greatest(1, {fw} - 1)))::INT ELSE {fh} END"
    return f"(CASE WHEN abs(s - 1) < 0.01::DOUBLE THEN {w if side == 'width' else h} ELSE {wide if side == 'width' else high} END)::INT AS {side}"


_OUTPUTS = f"""WITH {_FIELDS}, {_TITLED}, files AS (
    SELECT document_id, (asset_index - 1) // 5 AS batch_no, list(filename ORDER BY filename) AS expected FROM manifest GROUP BY 1, 2
), given AS (
    SELECT *, list_concat(list_concat(expected[1 : greatest(1, len(expected) - 1)], expected[1:1]), ['unknown.png']) AS names FROM files
), outputs AS (
    SELECT document_id, batch_no, expected, array_to_string(list_transform(names, lambda f: '[F] ' || f || chr(10) || '[T] DRY RUN' || chr(10) || '[M] Dry run metadata.' || chr(10) || '[C] Dry run content.'), chr(10) || chr(10)) AS output, names FROM given
), parsed AS (
    SELECT document_id, batch_no, position, filename, 'DRY RUN' AS title, 'Dry run metadata.' AS metadata, 'Dry run content.' AS content,
           CASE WHEN NOT list_contains(expected, filename) THEN 'unexpected' WHEN row_number() OVER (PARTITION BY document_id, batch_no, filename ORDER BY position) > 1 THEN 'duplicate' ELSE 'item' END AS status
    FROM (SELECT document_id, batch_no, expected, unnest(range(0, len(names)))::INT AS position, unnest(names) AS filename FROM outputs)
)"""
_DISTANCES = """WITH pair AS (
    SELECT label, vec_id, embedding::DOUBLE[] AS a, (lead(embedding) OVER (PARTITION BY label ORDER BY vec_id))::DOUBLE[] AS b FROM embeddings
), distances AS (
    SELECT label, vec_id, round(1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 9) AS distance FROM pair WHERE b IS NOT NULL
)"""
_LATEST = """latest AS (
    SELECT document_id, page_index, source, page_count, width, height, landed_at FROM ocr_pages
    QUALIFY row_number() OVER (PARTITION BY document_id, page_index ORDER BY landed_at DESC) = 1
)"""
_MARKS = r"\[x\]|\[ \]|\(x\)|\( \)|[☐☑☒□▢▣■✓✔✕✗✘]"
_STATUS = "'n/a','na','not applicable','none','nil','true','false','ok','okay','done','complete','completed','incomplete','pending','approved','denied','selected','unselected','checked','unchecked','pass','passed','fail','failed','valid','invalid','met','not met'"

SQL: dict[str, str] = {
    "block_fields": f"WITH {_FIELDS} SELECT block_key, label, content, x1, y1, x2, y2 FROM fields",
    "block_filter": f"WITH {_FIELDS} SELECT block_key, label FROM fields WHERE {_KEPT}",
    "block_filter_keep_set": f"WITH {_FIELDS} SELECT block_key, label FROM fields WHERE content <> '' AND label IN ('doc_title', 'paragraph_title', 'table')",
    "label_filter": f"WITH {_FIELDS} SELECT block_key, label FROM fields WHERE label IN ('table', 'figure_title')",
    "block_label_counts": f"WITH {_FIELDS} SELECT CASE label WHEN '' THEN '<missing>' ELSE label END AS label, count(*) FILTER ({_KEPT}) AS kept, count(*) FILTER (NOT ({_KEPT})) AS dropped FROM fields GROUP BY 1",
    "reading_order": f"WITH {_FIELDS} SELECT block_key, row_number() OVER (PARTITION BY document_id, page_index ORDER BY {_READING})::INT AS position FROM fields",
    "text_markdown": f"WITH {_FIELDS}, {_MARKDOWN} SELECT * FROM markdown",
    "page_index": "SELECT document_id, landed_at, page_index AS given, page_index FROM ocr_pages",
    "latest_pages": f"WITH {_LATEST} SELECT * FROM latest",
    "box_ops": f"WITH {_FIELDS} SELECT block_key, [greatest(0, least(x1 - 8, 1224)), greatest(0, least(y1 - 8, 1584)), greatest(0, least(x2 + 8, 1224)), greatest(0, least(y2 + 8, 1584))]::DOUBLE[] AS grown FROM fields WHERE whole",
    "page_boxes": f"WITH {_FIELDS} SELECT document_id, page_index, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM fields WHERE whole GROUP BY 1, 2",
    "box_overlap": f"""WITH {_FIELDS}, nxt AS (
        SELECT block_key, x1, x2, lead(x1) OVER w AS nx1, lead(x2) OVER w AS nx2 FROM fields WHERE whole WINDOW w AS (PARTITION BY document_id, page_index ORDER BY block_id, block_key))
        SELECT block_key, round(greatest(0, least(x2, nx2) - greatest(x1, nx1)) / greatest(1, least(x2 - x1, nx2 - nx1)), 9) AS ratio FROM nxt WHERE nx1 IS NOT NULL""",
    "title_blocks": f"WITH {_FIELDS} SELECT block_key, label FROM fields WHERE label LIKE '%\\_title' ESCAPE '\\' OR label = 'header'",
    "nearest_title": f"WITH {_FIELDS}, {_TITLED} SELECT block_key, title_key, distance FROM titled",
    "asset_numbering": f"WITH {_FIELDS}, {_TITLED} SELECT block_key, asset_index FROM assets",
    "crop_rect": f"WITH {_FIELDS}, {_TITLED} SELECT block_key, [cx1, cy1, cx2, cy2]::DOUBLE[] AS crop FROM cropped",
    "asset_manifest": f"WITH {_FIELDS}, {_TITLED} SELECT document_id, asset_kind, asset_index, asset_label, filename, page, bbox, name AS title, title_label, title_bbox, crop_bbox FROM manifest",
    "asset_slug": f"WITH {_FIELDS} SELECT block_key, {_slug('content')} AS slug, {_safe('content')} AS safe FROM fields WHERE label LIKE '%\\_title' ESCAPE '\\'",
    "whitespace_collapse": f"SELECT doc_id, {_collapse('text')} AS text FROM documents",
    "html_unescape": f"SELECT block_key, {_unescape('block_content')} AS content FROM ocr_blocks WHERE block_content IS NOT NULL",
    "trimmed_lines": f"SELECT block_key, {_trimmed('block_content')} AS content FROM ocr_blocks WHERE block_content IS NOT NULL",
    "paragraph_split": f"SELECT doc_id, unnest(range(0, len(p)))::INT AS paragraph_no, unnest(p) AS paragraph FROM (SELECT doc_id, {_PARAGRAPHS.replace('{x}', 'text')} AS p FROM documents WHERE text IS NOT NULL)",
    "heading_strip": f"""WITH p AS (SELECT doc_id, unnest(range(0, len(p)))::INT AS paragraph_no, unnest(p) AS paragraph FROM (SELECT doc_id, {_PARAGRAPHS.replace('{x}', 'text')} AS p FROM documents WHERE text IS NOT NULL))
        SELECT doc_id, paragraph_no, regexp_extract(paragraph, '^#{{1,6}} +(.+)$', 1) AS heading FROM p WHERE heading <> ''""",
    "sentence_split": f"SELECT doc_id, unnest(range(0, len(all_)))::INT AS sentence_id, unnest(all_) AS sentence FROM ({_sentences('documents', 'doc_id', 'text')})",
    "page_sentences": f"""WITH {_FIELDS}, {_MARKDOWN}, each_ AS (SELECT document_id, page_index, unnest(range(0, len(all_))) AS k, unnest(all_) AS sentence FROM ({_sentences('markdown', 'document_id, page_index', 'markdown')}))
        SELECT document_id, page_index, (row_number() OVER (PARTITION BY document_id ORDER BY page_index, k) - 1)::INT AS sentence_id, sentence FROM each_""",
    "sentence_items": f"WITH {_CURRENT} SELECT * FROM sentence",
    "short_answer_reasons": f"""WITH v AS (
        SELECT run_id, trim(regexp_replace(regexp_replace({_collapse('generated_answer')}, '^[>\\-*• ]+', ''), '^\\(?[a-zA-Z0-9]{{1,3}}\\)?[.)] +', '')) AS v FROM query_summaries WHERE generated_answer IS NOT NULL
    ), w AS (SELECT *, regexp_replace(lower(v), '^[.;:]+|[.;:]+$', '', 'g') AS low, replace(v, ' ', '') AS solid FROM v)
    SELECT run_id, CASE WHEN v = '' THEN []::VARCHAR[] ELSE list_filter([
        CASE WHEN regexp_matches(lower(v), '{_MARKS}') THEN 'checkbox' END,
        CASE WHEN regexp_matches(v, '[0-9]') AND {_words('v')} <= 8 AND regexp_full_match(v, $$[0-9 ,.\\-+/$%():'’A-Za-z]*$$)
              AND length(regexp_replace(solid, $$[^0-9,.\\-+/$%():'’]$$, '', 'g')) / greatest(length(solid), 1)::DOUBLE >= 0.45::DOUBLE THEN 'numeric_like' END,
        CASE WHEN low IN ({_STATUS}) THEN 'short_status' END,
        CASE WHEN regexp_full_match(low, '(yes|no)( +[☐☑☒])?( +(yes|no) +[☐☑☒])?') THEN 'yes_no_answer' END], lambda x: x IS NOT NULL) END AS reasons FROM w""",
    "token_count": f"SELECT chunk_key, ({_words('text')})::INT AS words FROM chunks",
    "compact_text": f"SELECT doc_id, {_compact('text', 120)} AS text FROM documents",
    "record_hashes": f"SELECT run_id, md5(coalesce(query, '')) AS hash, {_key('query')} AS query_key, ({_safe('document_id')}) || '_table_montage_' || ({_key('query')}) || '.jpg' AS montage_name FROM query_summaries",
    "document_names": r"SELECT DISTINCT input_path, regexp_extract(input_path, '([^/]+)\.[^./]+$', 1) AS name FROM ocr_pages",
    "sliding_windows": f"WITH {_CURRENT}, {_WINDOWS} SELECT * FROM windows",
    "config_windows": """WITH c AS (SELECT config_id, window_size AS w, coalesce(step_size, window_size - overlap) AS s FROM chunking_configs)
        SELECT config_id, k::INT AS block_id, range(0, 13)[1 + k * s : k * s + w] AS ids FROM (SELECT *, unnest(range(0, greatest(0, ceil((13 - w) / s::DOUBLE))::BIGINT + 1)) AS k FROM c)""",
    "adjacent_distance": f"{_DISTANCES} SELECT * FROM distances",
    "percentile_breaks": f"""{_DISTANCES}, placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS nr FROM distances
        ), sizes AS (SELECT label, greatest(0, ceil((max(nr) + 2 - 6) / 4.0))::BIGINT AS last FROM placed GROUP BY 1
        ), blocks AS (SELECT label, unnest(range(0, last + 1)) AS block_id FROM sizes
        ), held AS (SELECT p.*, block_id::INT AS block_id FROM placed p JOIN blocks b ON p.label = b.label AND p.nr BETWEEN block_id * 4 AND block_id * 4 + 4
        ), limits AS (SELECT label, block_id, quantile_cont(distance, 0.95::DOUBLE) AS threshold FROM held GROUP BY 1, 2)
        SELECT label, block_id, vec_id, round(threshold, 11) AS threshold, coalesce(sum((distance > threshold)::INT) OVER (PARTITION BY label, block_id ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS segment
        FROM held JOIN limits USING (label, block_id)""",
    "chunk_text": f"""WITH {_CURRENT}, {_CHUNKS}, ids AS (SELECT chunk_key, document_id, unnest(ids) AS sentence_id FROM held), built AS (
        SELECT chunk_key, string_agg(text, ' ' ORDER BY sentence_id) AS text, coalesce(list_sort(list(DISTINCT page) FILTER (page IS NOT NULL)), []) AS pages FROM ids JOIN sentence USING (document_id, sentence_id) GROUP BY 1)
        SELECT chunk_key, text, pages, ({_words('text')})::INT AS words FROM built""",
    "page_span": f"""WITH {_CURRENT}, {_CHUNKS}, ids AS (SELECT chunk_key, document_id, unnest(ids) AS sentence_id FROM held)
        SELECT chunk_key, min(page) AS first_page, max(page) AS last_page FROM ids JOIN sentence USING (document_id, sentence_id) GROUP BY 1""",
    "chunk_order": f"WITH {_CHUNKS} SELECT chunk_key, row_number() OVER (PARTITION BY document_id ORDER BY {_ORDER})::INT AS place FROM held",
    "chunk_overlap_pairs": f"WITH {_PIECES} SELECT document_id, a AS first_key, b AS second_key, shared, shared / least(na, nb)::DOUBLE AS overlap FROM shared WHERE a < b AND shared / least(na, nb)::DOUBLE >= 0.5::DOUBLE",
    "duplicate_overlap": f"WITH {_PIECES} SELECT document_id, a AS first_key, b AS second_key, shared, shared / least(na, nb)::DOUBLE AS overlap FROM shared WHERE a < b AND shared / least(na, nb)::DOUBLE >= 0.8::DOUBLE",
    "chunk_containment": f"WITH {_PIECES} SELECT * FROM contained",
    "containment_cleanup": f"""WITH {_PIECES}, taken AS (SELECT target_key AS chunk_key, list_sort(list(DISTINCT chunk_id)) AS absorbed FROM contained JOIN pieces USING (chunk_key) GROUP BY 1)
        SELECT document_id, chunk_key, ids, coalesce(absorbed, []) AS absorbed FROM pieces LEFT JOIN taken USING (chunk_key) WHERE chunk_key NOT IN (SELECT chunk_key FROM contained)""",
    "prev_continuation": f"""WITH {_PIECES} SELECT s.document_id, s.chunk_key, e.chunk_key AS previous_key FROM pieces s JOIN pieces e ON s.document_id = e.document_id AND e.ids[-1] + 1 = s.ids[1] AND e.chunk_key <> s.chunk_key
        QUALIFY row_number() OVER (PARTITION BY s.document_id, s.chunk_key ORDER BY len(e.ids) DESC, e.ids[1], e.chunk_key) = 1""",
    "position_reasons": f"""WITH {_CHUNKS}, nxt AS (
        SELECT document_id, chunk_key AS first_key, ids AS a, CASE WHEN len(page_span) > 0 THEN page_span END AS ap, lead(chunk_key) OVER w AS second_key, lead(ids) OVER w AS b, lead(CASE WHEN len(page_span) > 0 THEN page_span END) OVER w AS bp
        FROM held WINDOW w AS (PARTITION BY document_id ORDER BY {_ORDER}))
        SELECT document_id, first_key, second_key, {_NEAR.format(a='a', b='b')} AS gap, list_filter([CASE WHEN list_has_any(a, b) THEN 'sentence_overlap' END, CASE WHEN {_NEAR.format(a='a', b='b')} <= 3 THEN 'sentence_gap' END,
            CASE WHEN {_NEAR.format(a='ap', b='bp')} <= 1 THEN 'same_or_adjacent_page' END], lambda x: x IS NOT NULL) AS reasons FROM nxt WHERE second_key IS NOT NULL""",
    "validate_chunks": f"""WITH {_PIECES}, docs AS (SELECT DISTINCT document_id FROM pieces), c AS (SELECT document_id, count(*) AS n FROM contained GROUP BY 1),
        p AS (SELECT document_id, count(*) AS n FROM shared WHERE a < b AND shared / least(na, nb)::DOUBLE >= 0.8::DOUBLE GROUP BY 1)
        SELECT document_id, coalesce(c.n, 0) AS contained, coalesce(p.n, 0) AS duplicates, coalesce(c.n, 0) = 0 AND coalesce(p.n, 0) = 0 AS passed FROM docs LEFT JOIN c USING (document_id) LEFT JOIN p USING (document_id)""",
    "provenance_union": f"""WITH {_CHUNKS}, flat AS (SELECT document_id, chunk_key, len(ids) AS n, unnest(ids) AS sid FROM held
        ), shared AS (SELECT a.document_id, a.chunk_key AS a, b.chunk_key AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM flat a JOIN flat b ON a.document_id = b.document_id AND a.sid = b.sid AND a.chunk_key <> b.chunk_key GROUP BY ALL
        ), contained AS (SELECT a AS chunk_key, b AS target_key FROM shared WHERE shared = na AND (nb > na OR (nb = na AND b < a)) QUALIFY row_number() OVER (PARTITION BY a ORDER BY nb DESC, b) = 1)
        SELECT coalesce(target_key, h.chunk_key) AS chunk_key, list_sort(list(DISTINCT chunk_id)) AS chunk_ids, list_sort(list_distinct(flatten(list(source_block_ids)))) AS block_ids, list_sort(list_distinct(flatten(list(coalesce(page_span, []))))) AS pages
        FROM held h LEFT JOIN contained c ON c.chunk_key = h.chunk_key GROUP BY 1""",
    "dry_run_enrichment": f"{_OUTPUTS} SELECT document_id, batch_no, expected, output FROM outputs",
    "enrichment_parse": f"{_OUTPUTS} SELECT * FROM parsed",
    "enrichment_missing": f"""{_OUTPUTS}, items AS (SELECT document_id, batch_no, list(filename) FILTER (status = 'item') AS items, list_sort(list(DISTINCT filename) FILTER (status = 'unexpected')) AS unexpected, list_sort(list(DISTINCT filename) FILTER (status = 'duplicate')) AS duplicates FROM parsed GROUP BY 1, 2)
        SELECT document_id, batch_no, list_filter(expected, lambda x: NOT list_contains(items, x)) AS missing, unexpected, duplicates FROM outputs JOIN items USING (document_id, batch_no)""",
    "enrichment_join": f"{_OUTPUTS} SELECT p.document_id, 'table' AS asset_kind, printf('table_%06d', p.batch_no * 5 + p.position + 1) AS id, p.filename, p.title, p.content, md5(p.content) AS hash, m.page, m.bbox FROM parsed p JOIN manifest m ON p.document_id = m.document_id AND p.filename = m.filename WHERE status = 'item'",
    "preview_join": f"""{_OUTPUTS} SELECT m.document_id, 'table' AS modality, printf('table_%06d', m.asset_index) AS id, m.filename, coalesce(p.title, m.name) AS title, p.metadata AS summary, coalesce(p.content, p.title, m.name) AS content, m.page, m.bbox
        FROM manifest m LEFT JOIN (SELECT * FROM parsed WHERE status = 'item') p ON p.document_id = m.document_id AND p.filename = m.filename WHERE asset_index <= 4""",
    "enrichment_counts": f"""{_OUTPUTS}, done AS (SELECT DISTINCT document_id, filename FROM parsed WHERE status = 'item'), files_ AS (SELECT DISTINCT document_id, filename FROM manifest)
        SELECT f.document_id, count(*) AS total, count(d.filename) AS success, count(*) - count(d.filename) AS failed FROM files_ f LEFT JOIN done d ON d.document_id = f.document_id AND d.filename = f.filename GROUP BY 1""",
    "enrichment_retry": f"{_OUTPUTS} SELECT DISTINCT document_id, filename, 'DRY RUN' AS title, 'Dry run metadata.' AS metadata, 'Dry run content.' AS content FROM manifest",
    "text_records": f"""WITH {_CHUNKS}, named AS (SELECT *, printf('text_%06d', row_number() OVER (PARTITION BY document_id ORDER BY {_ORDER})) AS id FROM held)
        SELECT document_id, chunk_key, id, row_number() OVER (PARTITION BY document_id ORDER BY {_ORDER}) AS index_id, text AS content, md5(text) AS hash, page_span FROM named WHERE coalesce(trim(text), '') <> ''""",
    "records_without_span": f"WITH {_CHUNKS} SELECT document_id, count(*) FILTER (page_span IS NULL) AS without_span FROM held WHERE coalesce(trim(text), '') <> '' GROUP BY 1",
    "manifest_stats": f"WITH {_VECTORS} SELECT 'all' AS document_id, modality, count(*) AS count, max(len(embedding))::INT AS dimension FROM records GROUP BY 2",
    "vec_topk": f"WITH {_VECTORS} SELECT query_id, modality, vec_id, rank, round(score, 6) AS score FROM hits",
    "vec_threshold": f"WITH {_VECTORS} SELECT query_id, modality, vec_id, rank, round(score, 6) AS score, true AS passed FROM hits WHERE score >= 0.2::DOUBLE",
    "vec_all_modalities": f"WITH {_VECTORS} SELECT query_id, list(vec_id ORDER BY rank) FILTER (modality = 'text') AS text, list(vec_id ORDER BY rank) FILTER (modality = 'table') AS \"table\", list(vec_id ORDER BY rank) FILTER (modality = 'image') AS image FROM hits GROUP BY 1",
    "retrieve_mode": f"WITH {_retrieved(0.2)} SELECT * FROM retrieved",
    "retrieve_trace": f"""WITH {_retrieved(0.2)} SELECT query_id, mode, count(*) FILTER (modality = 'text') AS texts, count(*) FILTER (modality = 'table') AS tables, count(*) FILTER (modality = 'image') AS images, count(vec_id) AS total,
        count(*) FILTER (passed = false) AS below, mode <> 'text_only' AS fallback_triggered, mode = 'raw_fallback' AS threshold_fallback FROM retrieved GROUP BY 1, 2""",
    "retrieve_by_document": f"WITH {_retrieved(0.2, True)} SELECT * FROM retrieved",
    "retrieve_multimodal": f"WITH {_retrieved("CASE modality WHEN 'text' THEN 0.3 ELSE 0.2 END")} SELECT * FROM retrieved",
    "raw_fallback": f"WITH {_retrieved(1.5)} SELECT * FROM retrieved",
    "context_normalize": f"WITH {_contexts()} SELECT query_id, modality, vec_id, summary FROM contexts",
    "evidence_ids": f"WITH {_contexts()} SELECT query_id, modality, vec_id, evidence_id FROM contexts",
    "evidence_format": f"WITH {_contexts()} SELECT query_id, evidence_id, lines FROM rendered",
    "answer_dry_run": f"""WITH {_contexts(1200)}, parts AS (
        SELECT query_id, string_agg(lines, chr(10) || chr(10) ORDER BY place) FILTER (modality = 'text') AS e, string_agg(lines, chr(10) || chr(10) ORDER BY place) FILTER (modality = 'table') AS t,
               string_agg(lines, chr(10) || chr(10) ORDER BY place) FILTER (modality = 'image') AS i FROM rendered GROUP BY 1
    ), prompts AS (
        SELECT q.query_id, 'Question: ' || coalesce(s.query, '') || chr(10) || chr(10) || 'Text evidence:' || chr(10) || coalesce(e, 'None.') || chr(10) || chr(10)
               || 'Table evidence:' || chr(10) || coalesce(t, 'None.') || chr(10) || chr(10) || 'Image evidence:' || chr(10) || coalesce(i, 'None.') AS prompt
        FROM asked q LEFT JOIN query_summaries s ON s.run_id = q.query_id LEFT JOIN parts p ON p.query_id = q.query_id
    ) SELECT query_id, length(prompt)::INT AS prompt_chars, 'Dry run answer ' || left(md5(prompt), 8) AS answer FROM prompts""",
    "evidence_package": f"""WITH {_contexts()}, ranked AS (SELECT *, CASE modality WHEN 'text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END AS kind FROM contexts)
        SELECT q.query_id, any_value(s.query) AS query, count(*) FILTER (kind = 0)::INT AS texts, count(*) FILTER (kind = 1)::INT AS tables, count(*) FILTER (kind = 2)::INT AS images,
               {", ".join(f"coalesce(list({'c.' + n} ORDER BY kind, place) FILTER (c.query_id IS NOT NULL), []) AS {n}" for n in ("evidence_id", "id", "page", "score", "title", "summary", "content"))}
        FROM asked q LEFT JOIN query_summaries s ON s.run_id = q.query_id LEFT JOIN ranked c ON c.query_id = q.query_id GROUP BY 1""",
    "evidence_trace": f"""WITH {_contexts()} SELECT q.query_id, count(*) FILTER (modality = 'text')::INT AS texts, count(*) FILTER (modality = 'table')::INT AS tables, count(*) FILTER (modality = 'image')::INT AS images,
        tables > 0 AS table_montage, images > 0 AS image_montage FROM asked q LEFT JOIN contexts c ON c.query_id = q.query_id GROUP BY 1""",
    "montage_label": f"WITH {_contexts()} SELECT query_id, evidence_id, concat_ws(' | ', evidence_id, CASE WHEN page <> 0 THEN 'page ' || page END, nullif(left(trim(coalesce(nullif(title, ''), id)), 90), '')) AS label FROM contexts",
    "montage_vertical": _montage(1400, 1),
    "montage_grid": _montage(900, 2),
    "pixel_fit": f"WITH p AS (SELECT p_partkey, (p_size * 61)::INT AS w, (p_partkey % 1700 + 20)::INT AS h FROM part), scaled AS (SELECT *, {_scale('w', 'h')} AS s FROM p) SELECT p_partkey, {_fit('w', 'h', 'width')}, {_fit('w', 'h', 'height')} FROM scaled",
    "catalog_upsert": f"WITH {_LATEST} SELECT document_id, max(page_count) AS pages, max(landed_at) AS landed_at, CASE WHEN max(page_count) % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM latest GROUP BY 1",
    "catalog_latest": "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "catalog_missing_paths": "SELECT DISTINCT document_id, input_path AS path FROM ocr_pages WHERE input_path NOT IN (SELECT input_path FROM ocr_pages WHERE page_index > 0)",
    "metadata_merge": "SELECT document_id, page_index, landed_at, coalesce(nullif(source, ''), 'unknown') AS source, coalesce(nullif(form_type, ''), 'none') AS form, 'ocr' AS engine, 3 AS entries FROM ocr_pages",
    "first_present": "SELECT run_id, coalesce(CASE WHEN trim(retrieval_mode) <> '' THEN retrieval_mode END, CASE WHEN trim(document_id) <> '' THEN document_id END, 'none') AS value, coalesce(try_cast(query AS DOUBLE)::BIGINT, 0) AS number, coalesce(fallback_triggered, false) AS fallback FROM query_summaries",
    "retrieval_summary": "SELECT coalesce(retrieval_mode, '<none>') AS mode, count(*) AS runs, count(*) FILTER (fallback_triggered) AS fallbacks, sum(text_hits)::BIGINT AS text_hits, sum(table_hits)::BIGINT AS table_hits, sum(image_hits)::BIGINT AS image_hits FROM query_summaries GROUP BY 1",
}

# the default embedder: words counted with a sign in the dimension that their MD5 names
SQL["index_embedding"] = f"""WITH r AS ({SQL['text_records']}), words AS (
    SELECT chunk_key, md5(unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'))) AS m FROM r
), sums AS (
    SELECT chunk_key, (('0x' || left(m, 8))::UBIGINT % 64)::INT AS dim, sum(CASE WHEN ('0x' || substr(m, 9, 2))::INT % 2 = 1 THEN 1 ELSE -1 END) AS v FROM words GROUP BY 1, 2
), held AS (SELECT chunk_key, list(CASE WHEN v > 0 THEN dim + 1 ELSE -dim - 1 END ORDER BY dim) AS filled FROM sums WHERE v <> 0 GROUP BY 1)
SELECT chunk_key, 64 AS dimension, CASE WHEN filled IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS length, coalesce(filled, []) AS filled FROM r LEFT JOIN held USING (chunk_key)"""
