"""The registered queries once more, as independent SQL over the supplied tables."""

FIXTURES = {
    "catalog": """
SELECT doc_id, doc_id AS seq,
  concat('doc_', doc_id, CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.DOCX' WHEN 3 THEN '.txt' ELSE '' END) AS name,
  CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'docx' WHEN 3 THEN 'txt' END AS file_type,
  n_chars * 1000 AS size_bytes, source AS owner_id,
  strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INT), '%Y-%m-%d') AS upload_date,
  CASE WHEN doc_id % 7 <> 0 THEN doc_id % 4 END AS images_count
FROM documents""",
    "lines": """
SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS idx,
  unnest(string_split(text, chr(10))) AS text FROM documents""",
    "paragraphs": """
SELECT doc_id, CASE WHEN idx % 6 < 4 THEN (idx // 6) * 4 + idx % 6 ELSE idx // 6 END AS idx, text,
  CASE idx % 6 WHEN 5 THEN 'table' WHEN 4 THEN 'header' ELSE 'body' END AS scope FROM lines""",
    "raw_blocks": """
SELECT doc_id, CAST(floor(idx / 20) AS BIGINT) AS page_num, idx % 20 AS block_no,
  CASE WHEN idx % 20 = 7 THEN 1 ELSE 0 END AS block_type,
  CASE WHEN idx % 20 = 3 THEN '  ' WHEN idx % 20 = 5 THEN concat(' ', text, chr(9)) ELSE text END AS text
FROM lines""",
    "stripped": r"""
SELECT doc_id, page_num, block_no, block_type, regexp_replace(text,
  '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+\z',
  '', 'g') AS text
FROM raw_blocks""",
    "blocks": """
SELECT doc_id, page_num, block_no, text FROM stripped WHERE block_type = 0 AND text <> ''""",
    "doc_pages": """
SELECT DISTINCT doc_id, page_num FROM raw_blocks
UNION ALL SELECT doc_id, max(page_num) + 1 AS page_num FROM raw_blocks GROUP BY doc_id""",
    "runs": r"""
SELECT doc_id, idx, scope, run_no, text,
  CASE run_no % 3 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Times New Roman' END AS font_name,
  CASE WHEN run_no % 2 = 0 THEN 11.0::DOUBLE END AS font_size
FROM (SELECT doc_id, idx, scope, unnest(range(len(r))) AS run_no, unnest(r) AS text
      FROM (SELECT *, regexp_extract_all(text, '(\S+\s*|\s+)', 1) AS r FROM paragraphs))""",
    "edits": """
SELECT user_id AS doc_id, event_id AS seq,
  CASE WHEN event_id % 13 <> 0 THEN event_id % 5 END AS idx,
  CASE WHEN event_id % 11 <> 0 THEN event_id % 3 END AS page_num,
  event_id % 20 AS block_no, concat('edit ', event_id) AS text
FROM events""",
    "latest": """
SELECT doc_id, idx, arg_max(text, seq) AS new_text FROM edits WHERE idx IS NOT NULL AND text IS NOT NULL GROUP BY doc_id, idx""",
    "edited": """
SELECT p.doc_id, p.idx, p.scope, p.text AS old_text, coalesce(l.new_text, p.text) AS new_text,
  l.new_text IS NOT NULL AND l.new_text <> p.text AS changed
FROM paragraphs p LEFT JOIN latest l ON p.doc_id = l.doc_id AND p.idx = l.idx AND p.scope = 'body'""",
    "accounts": """
SELECT DISTINCT source AS user_id FROM documents WHERE source <> 'src3'""",
    "requests": """
SELECT request_id, doc_id, CASE WHEN request_id % 2 = 0 THEN concat('src', doc_id % 20) ELSE concat('src', user_id % 25) END AS user_id
FROM (SELECT event_id AS request_id, user_id, (event_id * 7) % ((SELECT count(*) FROM documents) * 6 // 5) AS doc_id FROM events)""",
    "signups": """
SELECT c_custkey AS seq, concat(lower(c_name), '@example.com') AS email, c_name AS name FROM customer
UNION ALL SELECT c_custkey + 1000000, concat(lower(c_name), '@example.com'), concat(c_name, ' again') FROM customer WHERE c_custkey % 5 = 0""",
    "images": """
SELECT l_orderkey AS doc_id, CAST(floor(l_linenumber / 3) AS BIGINT) AS page_num,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos,
  l_partkey AS part_id FROM lineitem""",
    "first_images": """
SELECT doc_id, part_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS image_no
FROM images GROUP BY doc_id, part_id""",
    "image_requests": """
SELECT o_orderkey AS doc_id, o_orderkey % 6 - 1 AS target_index,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('img', o_orderkey) END AS image FROM orders""",
    "sections": """
SELECT d.doc_id, s.section_no, p.part, n.para_no, concat(p.part, ' ', n.para_no) AS text
FROM documents d CROSS JOIN (SELECT 0 AS section_no UNION ALL SELECT 1) s
CROSS JOIN (SELECT 'header' AS part UNION ALL SELECT 'footer') p
CROSS JOIN (SELECT 0 AS para_no UNION ALL SELECT 1) n WHERE d.doc_id % 10 <> 0""",
    "style_patches": """
SELECT doc_id, doc_id AS seq,
  CASE doc_id % 5 WHEN 0 THEN 'Times New Roman' WHEN 1 THEN 'Courier New' WHEN 2 THEN 'Calibri' WHEN 3 THEN '' END AS font_name,
  CAST(CASE doc_id % 3 WHEN 0 THEN 12 WHEN 1 THEN 0 END AS DOUBLE) AS font_size,
  CASE doc_id % 4 WHEN 0 THEN 'New header' WHEN 1 THEN '' END AS header_text,
  CASE doc_id % 6 WHEN 0 THEN 'New footer' END AS footer_text
FROM documents""",
    "fonts": """
SELECT doc_id, CASE WHEN font_name ILIKE '%times%' THEN 'tiro' WHEN font_name ILIKE '%courier%' THEN 'cour' ELSE 'helv' END AS page_font,
  CASE WHEN font_size IS NULL OR font_size = 0 THEN 10.0::DOUBLE ELSE font_size END AS page_font_size
FROM style_patches""",
    "stamps": """
SELECT doc_id, 'header' AS part, header_text AS new_text FROM style_patches WHERE header_text IS NOT NULL
UNION ALL SELECT doc_id, 'footer', footer_text FROM style_patches WHERE footer_text IS NOT NULL""",
    "styled_runs": """
SELECT r.doc_id, r.idx, r.scope, r.run_no,
  CASE WHEN r.scope <> 'header' AND s.font_name <> '' THEN s.font_name ELSE r.font_name END AS font_name,
  CASE WHEN r.scope <> 'header' AND s.font_size <> 0 THEN s.font_size ELSE r.font_size END AS font_size,
  r.font_name AS old_name, r.font_size AS old_size
FROM runs r LEFT JOIN style_patches s USING (doc_id)""",
    "commands": """
SELECT conv_id * 1000 + turn AS command_id, conv_id AS doc_id, f, r, conv_id % 3 = 0 AS is_text,
  CASE WHEN conv_id % 3 = 0 THEN text ELSE concat('Replace "', f, '" with "', r, '".') END AS prompt
FROM (SELECT conv_id, turn, text, regexp_extract(text, '([A-Za-z]+)', 1) AS f, concat(regexp_extract(text, '([A-Za-z]+)', 1), '_new') AS r
      FROM conversations WHERE role = 'user') t""",
    "prompts": """
SELECT conv_id * 1000 + turn AS command_id, conv_id AS doc_id, f, kind, page, size FROM (
  SELECT *, CASE WHEN f <> '' THEN (conv_id + turn) % 7 ELSE 6 END AS kind FROM (
    SELECT conv_id, turn, regexp_extract(text, '([A-Za-z]+)', 1) AS f, conv_id % 3 + 1 AS page, CAST(turn + 8.5 AS DOUBLE) AS size
    FROM conversations WHERE role = 'user'))""",
    "slots": r"""
SELECT *, trim(regexp_extract(trim(prompt), pattern, 1)) AS find_text, trim(regexp_extract(trim(prompt), pattern, 2)) AS replace_text
FROM (SELECT *, '(?i)^replace\s+(?:the\s+)?["''“”]?([^"''“”]+?)["''“”]?\s+(?:with|by|to)\s+["''“”]?([^"''“”]+?)["''“”]?\.?\s*\z' AS pattern FROM commands)""",
    "parsed": """
SELECT *, find_text <> '' AND replace_text <> '' AS understood FROM slots""",
    "rules": r"""
SELECT doc_id, 1 AS seq,
  CASE doc_id % 5 WHEN 0 THEN 'the' WHEN 1 THEN 'que' WHEN 2 THEN '$' WHEN 3 THEN 'en' ELSE '' END AS find_text,
  CASE doc_id % 3 WHEN 0 THEN '$1' WHEN 1 THEN '\1' ELSE 'a\b' END AS replace_text,
  doc_id % 2 = 0 AS case_sensitive
FROM documents""",
    "first_rule": r"""
SELECT p.doc_id, p.scope, p.idx, r.replace_text AS z, CASE WHEN r.find_text = '' THEN 0 WHEN r.case_sensitive THEN (length(p.text) - length(replace(p.text, r.find_text, ''))) / length(r.find_text)
    ELSE len(regexp_extract_all(p.text, '(?i)' || regexp_escape(r.find_text))) END AS n, CASE WHEN r.find_text = '' THEN p.text WHEN r.case_sensitive THEN replace(p.text, r.find_text, r.replace_text)
    ELSE regexp_replace(p.text, '(?i)' || regexp_escape(r.find_text), replace(r.replace_text, '\', '\\'), 'g') END AS t
FROM paragraphs p JOIN rules r ON p.doc_id = r.doc_id""",
    "first_block_rule": r"""
SELECT p.doc_id, p.page_num, p.block_no, p.text, r.replace_text AS z, CASE WHEN r.find_text = '' THEN 0 WHEN r.case_sensitive THEN (length(p.text) - length(replace(p.text, r.find_text, ''))) / length(r.find_text)
    ELSE len(regexp_extract_all(p.text, '(?i)' || regexp_escape(r.find_text))) END AS n, CASE WHEN r.find_text = '' THEN p.text WHEN r.case_sensitive THEN replace(p.text, r.find_text, r.replace_text)
    ELSE regexp_replace(p.text, '(?i)' || regexp_escape(r.find_text), replace(r.replace_text, '\', '\\'), 'g') END AS t
FROM blocks p JOIN rules r ON p.doc_id = r.doc_id""",
    "requested": """
SELECT q.request_id, q.doc_id, q.no, q.find_text, q.replace_text, q.cs, c.file_type,
  CAST(CASE WHEN q.user_id NOT IN (SELECT user_id FROM accounts) THEN 401 WHEN q.user_id <> c.owner_id THEN 404
    WHEN coalesce(c.file_type, '') NOT IN ('docx', 'pdf') THEN 400 ELSE 200 END AS BIGINT) AS status
FROM (SELECT d.doc_id * 2 AS request_id, d.doc_id, 0 AS no, CASE WHEN d.doc_id % 4 = 0 THEN 'src1' ELSE d.source END AS user_id,
    r.find_text, r.replace_text, r.case_sensitive AS cs FROM documents d JOIN rules r ON d.doc_id = r.doc_id
  UNION ALL SELECT d.doc_id * 2 + 1, d.doc_id, 1, d.source, r.replace_text, 'z', true FROM documents d JOIN rules r ON d.doc_id = r.doc_id) q
JOIN catalog c ON q.doc_id = c.doc_id""",
    "request_texts": r"""
SELECT doc_id, sum(n) AS n0, sum((length(t) - length(replace(t, z, ''))) / length(z)) AS n1
FROM (SELECT p.doc_id, r.replace_text AS z,
    CASE WHEN r.status <> 200 THEN 0 ELSE CASE WHEN r.find_text = '' THEN 0 WHEN r.cs THEN (length(p.text) - length(replace(p.text, r.find_text, ''))) / length(r.find_text)
    ELSE len(regexp_extract_all(p.text, '(?i)' || regexp_escape(r.find_text))) END END AS n,
    CASE WHEN r.status <> 200 THEN p.text ELSE CASE WHEN r.find_text = '' THEN p.text WHEN r.cs THEN replace(p.text, r.find_text, r.replace_text)
    ELSE regexp_replace(p.text, '(?i)' || regexp_escape(r.find_text), replace(r.replace_text, '\', '\\'), 'g') END END AS t
  FROM (SELECT doc_id, text, 'docx' AS kind FROM paragraphs WHERE scope IN ('body', 'table') UNION ALL SELECT doc_id, text, 'pdf' FROM blocks) p
  JOIN requested r ON p.doc_id = r.doc_id AND p.kind = r.file_type AND r.no = 0)
GROUP BY doc_id""",
    "command_steps": r"""
SELECT doc_id, scope, idx, page_num, block_no, text, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS command_id, CAST(0 AS BIGINT) AS hits FROM (
  SELECT p.doc_id, p.scope, p.idx, CAST(-1 AS BIGINT) AS page_num, CAST(-1 AS BIGINT) AS block_no, p.text
  FROM paragraphs p JOIN catalog c ON p.doc_id = c.doc_id WHERE c.file_type = 'docx' AND p.scope IN ('body', 'table')
  UNION ALL SELECT b.doc_id, 'page', -1, b.page_num, b.block_no, b.text FROM blocks b JOIN catalog c ON b.doc_id = c.doc_id WHERE c.file_type = 'pdf')
UNION ALL SELECT s.doc_id, s.scope, s.idx, s.page_num, s.block_no,
  regexp_replace(s.text, '(?i)' || regexp_escape(c.find_text), replace(c.replace_text, '\', '\\'), 'g'), s.n + 1, c.command_id,
  CAST(len(regexp_extract_all(s.text, '(?i)' || regexp_escape(c.find_text))) AS BIGINT)
FROM command_steps s JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY command_id) AS no FROM parsed WHERE understood) c
ON c.doc_id = s.doc_id AND c.no = s.n + 1""",
    "saves": """
SELECT s.request_id, s.doc_id, c.file_type, s.n_items, CAST(CASE WHEN s.user_id NOT IN (SELECT user_id FROM accounts) THEN 401 WHEN c.doc_id IS NULL OR c.owner_id <> s.user_id THEN 404
    WHEN coalesce(c.file_type, '') NOT IN ('docx', 'pdf') THEN 400 ELSE 200 END AS BIGINT) AS status
FROM (SELECT request_id, doc_id, n_items, concat('src', doc_id % CASE WHEN request_id % 3 > 0 THEN 20 ELSE 25 END) AS user_id
  FROM (SELECT event_id // 4 AS request_id, (event_id // 4) * 7 % ((SELECT count(*) FROM documents) * 6 // 5) AS doc_id, count(*) AS n_items FROM events GROUP BY 1, 2)) s
LEFT JOIN catalog c ON s.doc_id = c.doc_id""",
    "saved": """
SELECT s.doc_id, s.file_type, e.seq, e.idx, e.page_num, e.block_no, CASE WHEN e.seq % 17 <> 0 THEN e.text END AS text
FROM edits e JOIN saves s ON e.seq // 4 = s.request_id WHERE s.status = 200""",
    "style_saves": """
SELECT q.*, c.file_type, CAST(CASE WHEN q.user_id NOT IN (SELECT user_id FROM accounts) THEN 401 WHEN c.doc_id IS NULL OR c.owner_id <> q.user_id THEN 404
    WHEN coalesce(c.file_type, '') NOT IN ('docx', 'pdf') THEN 400 ELSE 200 END AS BIGINT) AS status
FROM (SELECT doc_id * 2 AS request_id, doc_id, concat('src', doc_id % CASE WHEN doc_id % 3 > 0 THEN 20 ELSE 25 END) AS user_id,
    font_name, font_size, header_text, footer_text, CAST(NULL AS BIGINT) AS image_index, CAST(NULL AS VARCHAR) AS image FROM style_patches
  UNION ALL SELECT doc_id * 2 + 1, doc_id, concat('src', doc_id % 20), NULL, 9.5, NULL, 'Second', doc_id % 4, concat('img', doc_id) FROM documents) q
JOIN catalog c ON q.doc_id = c.doc_id""",
    "style_counted": """
SELECT s.*, CASE WHEN s.status <> 200 THEN -1 WHEN s.file_type = 'docx' THEN coalesce(i.n_all, 0) ELSE coalesce(i.n_parts, 0) END AS images_count,
  CASE WHEN s.status <> 200 THEN '' ELSE concat('Updated styling: font=', coalesce(s.font_name, 'None'), ', size=', coalesce(CAST(s.font_size AS VARCHAR), 'None'),
    ', header=', CASE WHEN s.header_text IS NULL THEN 'False' ELSE 'True' END, ', footer=', CASE WHEN s.footer_text IS NULL THEN 'False' ELSE 'True' END,
    ', img=', CASE WHEN s.image_index IS NULL THEN 'False' ELSE 'True' END) END AS action
FROM style_saves s LEFT JOIN (SELECT l_orderkey AS doc_id, count(*) AS n_all, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1) i ON s.doc_id = i.doc_id""",
    "style_final": """
SELECT doc_id, any_value(file_type) AS file_type, arg_max(font_name, request_id) FILTER (font_name <> '') AS font_name, arg_max(font_size, request_id) FILTER (font_size <> 0) AS font_size,
  arg_max(header_text, request_id) FILTER (header_text IS NOT NULL) AS header_text, arg_max(footer_text, request_id) FILTER (footer_text IS NOT NULL) AS footer_text
FROM style_saves WHERE status = 200 GROUP BY doc_id""",
    "history": """
SELECT doc_id, CAST(-1 AS BIGINT) AS seq, upload_date AS date, 'Uploaded document' AS action FROM catalog
UNION ALL SELECT user_id, event_id, strftime(ts, '%Y-%m-%d'), 'Edited text content (1 block(s))' FROM events""",
    "answer_pairs": """
SELECT a.conv_id, a.turn, a.text AS candidate, q.text AS reference FROM conversations a
JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE a.role = 'assistant' AND q.role = 'user'""",
    "totals": """
SELECT doc_id, CAST(sum((length(text) - length(replace(text, 'the', ''))) / 3) AS BIGINT) AS matches
FROM paragraphs WHERE scope IN ('body', 'table') GROUP BY doc_id""",
    "counted_edits": """
SELECT e.doc_id, e.n_submitted, e.n_pending, CAST(coalesce(c.n_changed, 0) AS BIGINT) AS n_changed
FROM (SELECT doc_id, count(*) AS n_submitted, count(DISTINCT idx) AS n_pending FROM edits GROUP BY doc_id) e
LEFT JOIN (SELECT doc_id, count(*) FILTER (changed) AS n_changed FROM edited GROUP BY doc_id) c ON e.doc_id = c.doc_id""",
}
NEEDS = {
    "saves": ["catalog", "accounts"],
    "saved": ["saves", "edits"],
    "style_saves": ["style_patches", "catalog", "accounts"],
    "style_counted": ["style_saves"],
    "style_final": ["style_saves"],
    "paragraphs": ["lines"],
    "raw_blocks": ["lines"],
    "first_rule": ["paragraphs", "rules"],
    "first_block_rule": ["blocks", "rules"],
    "requested": ["catalog", "accounts", "rules"],
    "request_texts": ["requested", "paragraphs", "blocks"],
    "command_steps": ["parsed", "catalog", "paragraphs", "blocks"],
    "stripped": ["raw_blocks"],
    "blocks": ["stripped"],
    "doc_pages": ["raw_blocks"],
    "runs": ["paragraphs"],
    "latest": ["edits"],
    "edited": ["paragraphs", "latest"],
    "first_images": ["images"],
    "fonts": ["style_patches"],
    "stamps": ["style_patches"],
    "styled_runs": ["runs", "style_patches"],
    "slots": ["commands"],
    "parsed": ["slots"],
    "prompts": [],
    "history": ["catalog"],
    "totals": ["paragraphs"],
    "counted_edits": ["edits", "edited"],
}


def _with_fixtures(names, body):
    """``body`` preceded by the fixtures it names and those they need."""
    wanted, ordered = list(names), []
    while wanted:
        name = wanted.pop(0)
        ordered = [name, *(n for n in ordered if n != name)]
        wanted.extend(NEEDS.get(name, []))
    clauses = ", ".join(f"{name} AS ({FIXTURES[name]})" for name in ordered)
    return f"WITH RECURSIVE {clauses} {body}" if clauses else body


REPLACED_CS = """SELECT doc_id, scope, idx, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS matches,
  replace(text, 'the', '{new}') AS new_text FROM paragraphs"""
# pages as one text, the ends of blocks a character that no text has
PAGES_CI = r"""
SELECT doc_id, page_num, nos[i] AS block_no,
  CAST(length(new[i]) - length(replace(new[i], chr(57348), '')) AS BIGINT) AS matches, replace(new[i], chr(57348), '') AS new_text
FROM (SELECT *, unnest(range(1, len(nos) + 1)) AS i FROM (
  SELECT doc_id, page_num, nos, string_split(regexp_replace(page, '(?i)' || replace('{needle}', ' ', '(?:(' || chr(57344) || ')|\s+)'),
    chr(57348) || '{new}\1', 'g'), chr(57344)) AS new
  FROM (SELECT doc_id, page_num, list(block_no ORDER BY block_no) AS nos, string_agg({text}, chr(57344) ORDER BY block_no) AS page
    FROM blocks GROUP BY doc_id, page_num)))"""
BLOCKS_CS = """SELECT doc_id, page_num, block_no,
  CASE WHEN {condition} THEN CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) ELSE 0 END AS matches,
  CASE WHEN {condition} THEN replace(text, 'the', 'THE') ELSE text END AS new_text FROM blocks"""
IMAGES_REPLACED = """SELECT i.doc_id, i.page_num, i.part_id, coalesce(t.image, '') AS new_image
FROM images i LEFT JOIN (
  SELECT n.doc_id, n.part_id, q.image FROM {numbered} n
  JOIN image_requests q ON n.doc_id = q.doc_id AND n.image_no = q.target_index WHERE q.image <> '') t
ON i.doc_id = t.doc_id AND i.part_id = t.part_id"""

BODIES = {
    "upload_gate": (["catalog"], r"""
SELECT doc_id, name, ext, ext IN ('.pdf', '.docx') AND size_bytes <= 10485760 AS accepted,
  CASE WHEN ext NOT IN ('.pdf', '.docx') THEN 'file_type' WHEN size_bytes > 10485760 THEN 'file_size' ELSE '' END AS reject_reason
FROM (SELECT *, regexp_extract(lower(name), '[^./][^/]*?(\.[^./]*)\z', 1) AS ext FROM catalog)"""),
    "register_documents": (["catalog"], """
SELECT c.doc_id, c.name, c.file_type, c.owner_id,
  CAST(coalesce(CASE c.file_type WHEN 'docx' THEN i.n_all ELSE i.n_parts END, 0) AS BIGINT) AS images_count,
  c.upload_date AS date, 'Uploaded document' AS action
FROM catalog c LEFT JOIN (
  SELECT l_orderkey AS doc_id, count(*) AS n_all, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_orderkey) i
ON c.doc_id = i.doc_id
WHERE c.file_type IN ('pdf', 'docx') AND c.size_bytes <= 10485760"""),
    "content_paragraphs": (["lines"], "SELECT doc_id, idx, text FROM lines"),
    "content_blocks": (["blocks", "doc_pages"], """
SELECT p.doc_id, p.page_num, coalesce(b.block_no, -1) AS block_no, coalesce(b.text, '') AS text
FROM doc_pages p LEFT JOIN blocks b ON p.doc_id = b.doc_id AND p.page_num = b.page_num"""),
    "html_blocks": ([], r"""
SELECT doc_id, CAST(0 AS BIGINT) AS page_num, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS BIGINT) AS block_no,
  trim(text, chr(10) || ' ') AS text
FROM (
  SELECT doc_id, place, replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(trim(regexp_replace(raw, '[ \t\n\f\r]+', ' ', 'g'), ' '), ' ?\x02 ?', chr(10), 'g'),
    '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text
  FROM (
    SELECT page_id AS doc_id, unnest(range(len(parts))) AS place, unnest(parts) AS raw FROM (
      SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<!--.*?-->|<!doctype[^>]*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<title\b[^>]*>.*?</title\s*>', '', 'g'),
        '(?i)<br\s*/?>', chr(2), 'g'),
        '(?i)</?(html|head|body|p|h[1-6]|li|ul|ol|nav|div|article|footer|header|section|table|tr|td|th|blockquote|pre|dl|dt|dd)(\s[^>]*)?/?>', chr(1), 'g'),
        '<[^>]*>', '', 'g'), chr(1)) AS parts
      FROM pages)))
WHERE trim(text, chr(10) || ' ') <> ''"""),
    "docx_binary_scan": (["lines"], """
SELECT * FROM (WITH good AS (SELECT * FROM documents WHERE doc_id % 50 <> 49), kept AS (SELECT * FROM lines WHERE doc_id % 50 <> 49),
pictures AS (SELECT doc_id, unnest(range(doc_id % 3)) AS n FROM good),
found(doc_id, kind, scope, idx, run_no, section_no, para_no, text, font_name, font_size, part_id) AS (
  SELECT doc_id, 'paragraph', 'body', idx, -1, -1, -1, text, '', 0.0, '' FROM kept
  UNION ALL SELECT doc_id, 'run', 'body', idx, 0, -1, -1, substr(text, 1, 5), 'Arial', 10.5, '' FROM kept
  UNION ALL SELECT doc_id, 'run', 'body', idx, 1, -1, -1, substr(text, 6), '', 0.0, '' FROM kept
  UNION ALL SELECT doc_id, 'paragraph', 'table', 0, -1, -1, -1, text, '', 0.0, '' FROM kept WHERE idx = 0
  UNION ALL SELECT doc_id, 'run', 'table', 0, 0, -1, -1, text, '', 0.0, '' FROM kept WHERE idx = 0
  UNION ALL SELECT k.doc_id, 'paragraph', 'body', max(idx) + 1, -1, -1, -1, '', '', 0.0, '' FROM kept k WHERE k.doc_id % 3 > 0 GROUP BY k.doc_id
  UNION ALL SELECT p.doc_id, 'run', 'body', k.last + 1, p.n, -1, -1, '', '', 0.0, ''
    FROM pictures p JOIN (SELECT doc_id, max(idx) AS last FROM kept GROUP BY doc_id) k ON p.doc_id = k.doc_id
  UNION ALL SELECT doc_id, 'picture', '', n, -1, -1, -1, '', '', 0.0, 'media/image' || n || '.png' FROM pictures
  UNION ALL SELECT doc_id, 'section', '', -1, -1, 0, -1, '', '', 0.0, '' FROM good
  UNION ALL SELECT doc_id, 'stamp', 'header', -1, -1, 0, 0, 'header ' || doc_id, '', 0.0, '' FROM good WHERE doc_id % 10 > 0
  UNION ALL SELECT doc_id, 'stamp', 'header', -1, -1, 0, 1, '', '', 0.0, '' FROM good WHERE doc_id % 10 > 0
  UNION ALL SELECT doc_id, 'error', '', -1, -1, -1, -1, '', '', 0.0, '' FROM documents WHERE doc_id % 50 = 49)
SELECT doc_id, kind, scope, CAST(idx AS BIGINT) AS idx, CAST(run_no AS BIGINT) AS run_no, CAST(section_no AS BIGINT) AS section_no,
  CAST(para_no AS BIGINT) AS para_no, text, font_name, CAST(font_size AS DOUBLE) AS font_size, part_id FROM found)"""),
    "text_file_scan": (["lines"], "SELECT doc_id, idx, text FROM lines"),
    "snapshot_write": (["edited", "catalog"], """
SELECT e.doc_id, e.scope, e.idx, e.new_text AS text, coalesce(c.file_type, 'other') AS file_type
FROM edited e JOIN catalog c ON e.doc_id = c.doc_id"""),
    "export_text": (["paragraphs", "catalog"], """
SELECT p.doc_id, coalesce(c.file_type, 'other') AS file_type, p.idx AS line_no, p.text AS line
FROM paragraphs p LEFT JOIN (SELECT * FROM catalog WHERE doc_id % 9 <> 0) c ON p.doc_id = c.doc_id WHERE p.scope = 'body'"""),
    "storage_keys": (["catalog"], r"""
SELECT doc_id, concat(sha256(concat(doc_id, '|', name)), regexp_extract(name, '[^./][^/]*?(\.[^./]*)\z', 1)) AS storage_path
FROM catalog"""),
    "list_owner_documents": (["catalog"], "SELECT doc_id, name FROM catalog WHERE owner_id = 'src7'"),
    "document_listing": (["catalog"], """
SELECT doc_id AS id, name, coalesce(file_type, '') AS file_type, coalesce(images_count, 0) AS images_count, upload_date FROM catalog"""),
    "route_by_type": (["catalog"], """
SELECT doc_id, CASE file_type WHEN 'docx' THEN 'paragraphs' WHEN 'pdf' THEN 'blocks' ELSE 'unsupported' END AS route FROM catalog"""),
    "valid_block_filter": (["blocks"], "SELECT * FROM blocks"),
    "valid_edits": (["edits", "catalog", "doc_pages"], """
SELECT doc_id, seq, reason = '' AS valid, reason FROM (
  SELECT e.doc_id, e.seq, CASE
    WHEN coalesce(c.file_type, '') NOT IN ('docx', 'pdf') THEN 'unsupported'
    WHEN c.file_type = 'docx' AND e.idx IS NULL THEN 'no_index'
    WHEN c.file_type = 'pdf' AND (e.page_num IS NULL OR e.block_no IS NULL) THEN 'no_address'
    WHEN c.file_type = 'pdf' AND p.page_num IS NULL THEN 'no_such_page' ELSE '' END AS reason
  FROM edits e LEFT JOIN catalog c ON e.doc_id = c.doc_id
  LEFT JOIN doc_pages p ON e.doc_id = p.doc_id AND e.page_num = p.page_num)"""),
    "apply_region_edits": (["blocks"], """
SELECT b.doc_id, b.page_num, b.block_no, coalesce(l.new_text, b.text) AS new_text, coalesce(l.new_text <> b.text, false) AS changed
FROM blocks b LEFT JOIN (
  SELECT k.doc_id, k.page_num, k.block_no, arg_max(e.text, e.seq) AS new_text
  FROM (SELECT doc_id, page_num, block_no, block_no % 4 * 150 AS x0, block_no // 4 * 40 AS y0,
    block_no % 4 * 150 + 140 + doc_id % 3 * 20 AS x1, block_no // 4 * 40 + 30 AS y1 FROM blocks) k
  JOIN (SELECT user_id AS doc_id, event_id % 3 AS page_num, event_id AS seq, event_id * 37 % 600 AS x0, event_id * 53 % 220 AS y0,
    event_id * 37 % 600 + event_id % 5 * 60 AS x1, event_id * 53 % 220 + 10 + event_id % 7 * 30 AS y1, concat('region edit ', event_id) AS text
    FROM events WHERE event_id % 11 <> 0 AND event_id % 5 > 0) e
  ON k.doc_id = e.doc_id AND k.page_num = e.page_num AND k.x0 < e.x1 AND e.x0 < k.x1 AND k.y0 < e.y1 AND e.y0 < k.y1
  GROUP BY k.doc_id, k.page_num, k.block_no) l
ON b.doc_id = l.doc_id AND b.page_num = l.page_num AND b.block_no = l.block_no"""),
    "prompt_slots": (["prompts"], """
SELECT command_id, ['replace_text', 'delete_text', 'change_font', 'change_font', 'align_text', 'replace_text', ''][kind + 1] AS action,
  CASE WHEN kind IN (0, 1, 5) THEN f ELSE '' END AS old_text, CASE WHEN kind IN (0, 5) THEN concat(f, '_new') ELSE '' END AS new_text,
  CASE WHEN kind IN (0, 3, 5) THEN page ELSE 0 END AS page, CASE WHEN kind = 2 THEN 'Courier New' ELSE '' END AS font_name,
  CASE WHEN kind IN (2, 3) THEN size ELSE 0.0::DOUBLE END AS font_size, CASE WHEN kind = 4 THEN 'right' ELSE '' END AS alignment
FROM prompts"""),
    "slot_accuracy": (["prompts"], """
SELECT unnest(['action', 'old_text', 'new_text', 'page', 'font_name', 'font_size', 'alignment']) AS slot,
  count(*) AS n_prompts, count(*) AS n_exact, 1.0::DOUBLE AS share FROM prompts"""),
    "prompt_fonts": (["prompts", "runs"], """
SELECT r.doc_id, r.scope, r.idx, r.run_no, coalesce(CASE WHEN r.scope <> 'header' AND s.font THEN 'Courier New' ELSE r.font_name END, '') AS font_name,
  coalesce(CASE WHEN r.scope <> 'header' AND s.font THEN s.size ELSE r.font_size END, 0.0) AS font_size
FROM runs r LEFT JOIN (SELECT doc_id, true AS font, arg_max(size, command_id) AS size FROM prompts WHERE kind = 2 GROUP BY doc_id) s ON r.doc_id = s.doc_id"""),
    "apply_prompts": (["prompts", "catalog", "paragraphs", "blocks"], """
SELECT command_id, doc_id, CAST(sum(n) AS BIGINT) AS matches FROM (
  SELECT command_id, doc_id, 0 AS n FROM prompts WHERE kind IN (0, 1, 5)
  UNION ALL SELECT command_id, doc_id, n FROM (
    WITH RECURSIVE rules AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY command_id) AS step, CASE WHEN kind = 1 THEN '' ELSE concat(f, '_new') END AS new
      FROM prompts WHERE kind IN (0, 1, 5)
    ), contents AS (
      SELECT doc_id, 'p' || scope || idx AS place, CAST(NULL AS BIGINT) AS page, text FROM paragraphs WHERE scope IN ('body', 'table')
      UNION ALL SELECT doc_id, 'b' || page_num || '-' || block_no, page_num + 1, text FROM blocks
    ), steps AS (
      SELECT doc_id, place, page, text, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS command_id, CAST(0 AS BIGINT) AS n FROM contents
      UNION ALL
      SELECT s.doc_id, s.place, s.page, CASE WHEN hit THEN regexp_replace(s.text, '(?i)' || s.f, s.new, 'g') ELSE s.text END,
        s.step + 1, s.rule_id, CASE WHEN hit THEN CAST(len(regexp_extract_all(s.text, '(?i)' || s.f)) AS BIGINT) ELSE 0 END
      FROM (SELECT c.*, r.f, r.new, r.command_id AS rule_id, coalesce(r.kind = 1 OR r.page = c.page, false) AS hit
        FROM steps c JOIN rules r ON c.doc_id = r.doc_id AND r.step = c.step + 1) s
    ) SELECT * FROM steps WHERE command_id IS NOT NULL)) GROUP BY command_id, doc_id"""),
    "page_labels": (["doc_pages", "blocks"], """
SELECT doc_id, page_num, concat('Page ', page_num + 1) AS label,
  CASE WHEN EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = p.doc_id AND b.page_num = p.page_num) THEN '' ELSE 'This page appears to be blank.' END AS placeholder
FROM doc_pages p"""),
    "page_scoped_replace": (["blocks"], BLOCKS_CS.format(condition="page_num = 1")),
    "resolve_requests": (["requests", "accounts", "catalog"], """
SELECT r.request_id, r.doc_id, r.user_id, CAST(CASE WHEN a.user_id IS NULL THEN 401 WHEN c.doc_id IS NULL THEN 404
  WHEN coalesce(c.file_type, '') NOT IN ('docx', 'pdf') THEN 400 ELSE 200 END AS BIGINT) AS status
FROM requests r LEFT JOIN accounts a ON r.user_id = a.user_id
LEFT JOIN catalog c ON r.doc_id = c.doc_id AND r.user_id = c.owner_id"""),
    "apply_paragraph_edits": (["edited"], "SELECT doc_id, scope, idx, new_text, changed FROM edited"),
    "apply_block_edits": (["blocks", "doc_pages", "edits"], """
SELECT b.doc_id, b.page_num, b.block_no, coalesce(l.new_text, b.text) AS new_text, l.new_text IS NOT NULL AND l.new_text <> b.text AS changed
FROM blocks b LEFT JOIN (
  SELECT e.doc_id, e.page_num, e.block_no, arg_max(e.text, e.seq) AS new_text
  FROM edits e JOIN doc_pages p ON e.doc_id = p.doc_id AND e.page_num = p.page_num GROUP BY ALL) l
ON b.doc_id = l.doc_id AND b.page_num = l.page_num AND b.block_no = l.block_no"""),
    "edit_runs": (["runs", "edited"], """
SELECT r.doc_id, r.scope, r.idx, r.run_no,
  CASE WHEN NOT e.changed THEN r.text WHEN r.run_no = 0 THEN e.new_text ELSE '' END AS text
FROM runs r JOIN edited e ON r.doc_id = e.doc_id AND r.scope = e.scope AND r.idx = e.idx
UNION ALL SELECT doc_id, scope, idx, 0, new_text FROM edited WHERE changed AND old_text = ''"""),
    "image_replacements": (["images", "image_requests", "by_occurrence"], IMAGES_REPLACED.format(numbered="by_occurrence")),
    "image_replacements_distinct": (["images", "image_requests", "first_images"], IMAGES_REPLACED.format(numbered="first_images")),
    "new_accounts": (["signups"], """
SELECT email, min(seq) AS seq, arg_min(name, seq) AS name FROM signups
WHERE email NOT IN (SELECT concat(lower(c_name), '@example.com') FROM customer WHERE c_custkey % 3 = 0) GROUP BY email"""),
    "known_documents": (["requests"], "SELECT request_id, doc_id FROM requests WHERE doc_id IN (SELECT doc_id FROM documents)"),
    "stamp_sections": (["sections", "stamps"], """
SELECT s.doc_id, CAST(s.section_no AS BIGINT) AS section_no, s.part, CAST(s.para_no AS BIGINT) AS para_no,
  CASE WHEN p.doc_id IS NULL THEN s.text WHEN s.para_no = 0 THEN p.new_text ELSE '' END AS text
FROM sections s LEFT JOIN stamps p ON s.doc_id = p.doc_id AND s.part = p.part
UNION ALL SELECT doc_id, unnest([0, 1]), part, 0, new_text FROM stamps WHERE doc_id % 10 = 0"""),
    "stamp_pages": (["doc_pages", "stamps", "fonts"], """
SELECT p.doc_id, p.page_num, s.part, s.new_text AS text, f.page_font, f.page_font_size
FROM doc_pages p JOIN stamps s ON p.doc_id = s.doc_id JOIN fonts f ON p.doc_id = f.doc_id"""),
    "picture_counts": (["catalog"], """
SELECT c.doc_id, count(l.l_orderkey) AS images_count FROM catalog c LEFT JOIN lineitem l ON c.doc_id = l.l_orderkey
WHERE c.file_type = 'docx' GROUP BY c.doc_id"""),
    "distinct_image_counts": (["catalog"], """
SELECT c.doc_id, count(DISTINCT l.l_partkey) AS images_count FROM catalog c LEFT JOIN lineitem l ON c.doc_id = l.l_orderkey
WHERE c.file_type = 'pdf' GROUP BY c.doc_id"""),
    "replaced_totals": (["totals"], "SELECT doc_id, matches FROM totals"),
    "edits_by_page": (["edits"], """
SELECT doc_id, page_num, count(*) AS n_edits, count(DISTINCT block_no) AS n_blocks, min(seq) AS first_seq, max(seq) AS last_seq
FROM edits WHERE page_num IS NOT NULL AND block_no IS NOT NULL GROUP BY doc_id, page_num"""),
    "page_stats": (["doc_pages", "blocks"], """
SELECT p.doc_id, p.page_num, count(b.block_no) AS n_blocks, count(b.block_no) = 0 AS is_blank
FROM doc_pages p LEFT JOIN blocks b ON p.doc_id = b.doc_id AND p.page_num = b.page_num GROUP BY p.doc_id, p.page_num"""),
    "document_stats": (["doc_pages", "blocks"], """
SELECT p.doc_id, count(DISTINCT p.page_num) AS n_pages, count(b.block_no) AS n_blocks,
  count(DISTINCT p.page_num) - count(DISTINCT b.page_num) AS n_blank_pages, count(b.block_no) = 0 AS is_blank
FROM doc_pages p LEFT JOIN blocks b ON p.doc_id = b.doc_id AND p.page_num = b.page_num GROUP BY p.doc_id"""),
    "edit_counts": (["counted_edits"], "SELECT * FROM counted_edits"),
    "page_ordinals": ([], """
SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS page_num
FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)"""),
    "picture_ordinals": (["images"], "SELECT doc_id, part_id, pos AS image_no FROM images"),
    "image_ordinals": (["first_images"], "SELECT doc_id, part_id, image_no FROM first_images"),
    "latest_edits": (["latest"], "SELECT doc_id, idx, new_text FROM latest"),
    "latest_block_edits": (["edits"], """
SELECT doc_id, page_num, block_no, arg_max(text, seq) AS new_text FROM edits
WHERE page_num IS NOT NULL AND block_no IS NOT NULL GROUP BY doc_id, page_num, block_no"""),
    "documents_newest_first": (["catalog"], """
SELECT doc_id, seq, name, row_number() OVER (ORDER BY seq DESC) - 1 AS position FROM catalog"""),
    "history_timeline": (["history"], """
SELECT doc_id, seq, date, action, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS entry_no FROM history"""),
    "reconstruct_documents": (["paragraphs"], """
SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) AS text FROM paragraphs WHERE scope = 'body' GROUP BY doc_id"""),
    "reconstruct_pages": (["blocks"], """
SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY 1, 2"""),
    "content_all": (["catalog", "paragraphs", "blocks"], """
SELECT c.doc_id, c.file_type, p.idx, CAST(-1 AS BIGINT) AS page_num, CAST(-1 AS BIGINT) AS block_no, p.text
FROM catalog c JOIN paragraphs p ON c.doc_id = p.doc_id WHERE c.file_type = 'docx' AND p.scope = 'body'
UNION ALL SELECT c.doc_id, c.file_type, -1, b.page_num, b.block_no, b.text
FROM catalog c JOIN blocks b ON c.doc_id = b.doc_id WHERE c.file_type = 'pdf'"""),
    "replace_body_and_tables": (["paragraphs"], REPLACED_CS.format(new="THE") + " WHERE scope IN ('body', 'table')"),
    "history_append": (["catalog", "style_patches", "counted_edits", "totals"], """
SELECT doc_id, CAST(0 AS BIGINT) AS seq, upload_date AS date, 'Uploaded document' AS action FROM catalog
WHERE file_type IN ('pdf', 'docx') AND size_bytes <= 10485760
UNION ALL SELECT doc_id, 1, '2024-02-01', concat('Updated styling: font=', coalesce(font_name, 'None'), ', size=', coalesce(CAST(font_size AS VARCHAR), 'None'),
  ', header=', CASE WHEN header_text IS NULL THEN 'False' ELSE 'True' END,
  ', footer=', CASE WHEN footer_text IS NULL THEN 'False' ELSE 'True' END, ', img=False') FROM style_patches
UNION ALL SELECT doc_id, 2, '2024-02-01', concat('Edited text content (', n_submitted, ' block(s))') FROM counted_edits
UNION ALL SELECT doc_id, 3, '2024-02-01', concat('Find & Replace: ''the'' -> ''THE'' (', matches, ' matches)') FROM totals WHERE matches > 0"""),
    "find_replace_cs": (["paragraphs"], REPLACED_CS.format(new="THE")),
    "find_replace_ci": (["paragraphs"], r"""
SELECT doc_id, scope, idx, CAST(len(regexp_extract_all(text, '(?i)the')) AS BIGINT) AS matches,
  regexp_replace(text, '(?i)the', '$1\\', 'g') AS new_text FROM paragraphs"""),
    "find_replace_sharp_s": (["paragraphs"], r"""
SELECT doc_id, scope, idx, CAST(len(regexp_extract_all(text, '[ßẞ]')) AS BIGINT) AS matches,
  regexp_replace(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'ß', 'ẞ') ELSE text END, '[ßẞ]', 'ss', 'g') AS new_text
FROM paragraphs"""),
    "find_replace_blocks": (["blocks"], BLOCKS_CS.format(condition="true")),
    "find_replace_blocks_ci": (["blocks"], PAGES_CI.format(needle="of the", new="OF THE", text="text")),
    "find_replace_pages": (["blocks"], "SELECT doc_id, page_num, CAST(sum(matches) AS BIGINT) AS matches FROM ("
        + PAGES_CI.format(needle="\\. the", new="x", text="text") + ") GROUP BY doc_id, page_num"),
    "page_scoped_replace_ci": (["blocks"], "SELECT doc_id, page_num, block_no, CASE WHEN page_num = 0 THEN new_text ELSE text END AS new_text, "
        "CASE WHEN page_num = 0 THEN matches ELSE 0 END AS matches FROM ("
        + PAGES_CI.format(needle="\\. the", new="$1", text="text") + ") JOIN blocks USING (doc_id, page_num, block_no)"),
    "replace_page_phrases": (["blocks"], """
SELECT b.doc_id, b.page_num, b.block_no, CASE WHEN b.doc_id % 3 = 0 THEN b.text ELSE p.new_text END AS new_text,
  CASE WHEN b.doc_id % 3 = 0 THEN 0 ELSE p.matches + CAST((length(b.text) - length(replace(b.text, 'and', ''))) / 3 AS BIGINT) END AS matches
FROM blocks b JOIN (""" + PAGES_CI.format(needle="\\. the", new="OT", text="replace(text, 'and', 'of')") + """) p
ON b.doc_id = p.doc_id AND b.page_num = p.page_num AND b.block_no = p.block_no"""),
    "find_replace_blocks_outer_blank": (["blocks"], """
SELECT doc_id, page_num, block_no, CAST(0 AS BIGINT) AS matches, text AS new_text FROM blocks"""),
    "replace_by_rule": (["first_rule"], """
SELECT doc_id, scope, idx, CAST(n + (length(t) - length(replace(t, z, ''))) / length(z) AS BIGINT) AS matches, replace(t, z, 'z') AS new_text FROM first_rule"""),
    "rejected_rules": (["rules"], """
SELECT doc_id, CAST(seq AS BIGINT) AS seq FROM rules WHERE find_text = '' UNION ALL SELECT doc_id, 3 FROM documents"""),
    "delete_text": (["paragraphs"], REPLACED_CS.format(new="")),
    "cross_run_replace": (["runs", "paragraphs"], """
SELECT r.doc_id, r.scope, r.idx, r.run_no, CASE WHEN n = 0 THEN r.text WHEN r.run_no = 0 THEN replace(p.text, 'of the', 'OF THE') ELSE '' END AS text, p.n AS matches
FROM runs r JOIN (SELECT *, CASE WHEN scope = 'header' THEN 0 ELSE CAST((length(text) - length(replace(text, 'of the', ''))) / 6 AS BIGINT) END AS n FROM paragraphs) p
ON r.doc_id = p.doc_id AND r.scope = p.scope AND r.idx = p.idx"""),
    "apply_run_style": (["styled_runs"], """
SELECT doc_id, scope, idx, run_no, coalesce(font_name, '') AS font_name, coalesce(font_size, 0.0::DOUBLE) AS font_size FROM styled_runs"""),
    "font_family_map": (["fonts"], "SELECT * FROM fonts"),
    "history_actions": (["style_patches"], """
SELECT doc_id, concat('Updated styling: font=', coalesce(font_name, 'None'), ', size=', coalesce(CAST(font_size AS VARCHAR), 'None'),
  ', header=', CASE WHEN header_text IS NULL THEN 'False' ELSE 'True' END,
  ', footer=', CASE WHEN footer_text IS NULL THEN 'False' ELSE 'True' END, ', img=False') AS action FROM style_patches"""),
    "parse_replace_command": (["parsed"], """
SELECT command_id, CASE WHEN understood THEN find_text ELSE '' END AS find_text, CASE WHEN understood THEN replace_text ELSE '' END AS replace_text FROM parsed"""),
    "strip_text": (["stripped"], "SELECT doc_id, page_num, block_no, text FROM stripped"),
    "apply_commands": (["command_steps"], """
SELECT p.command_id, p.doc_id, p.find_text, p.replace_text, CAST(coalesce(m.n, 0) AS BIGINT) AS matches
FROM parsed p LEFT JOIN (SELECT command_id, sum(hits) AS n FROM command_steps WHERE n > 0 GROUP BY command_id) m
ON p.command_id = m.command_id WHERE p.understood"""),
    "apply_commands_text": (["command_steps"], """
SELECT doc_id, scope, idx, page_num, block_no, arg_max(text, n) AS new_text FROM command_steps GROUP BY ALL"""),
    "edit_stack": ([], """
SELECT doc_id, replace(b, 'que', 'QUE') AS text,
  CAST((length(text) - length(replace(text, 'the', ''))) / 3 + (length(a) - length(replace(a, 'THE', ''))) / 3
    + (length(b) - length(replace(b, 'que', ''))) / 3 AS BIGINT) AS matches
FROM (SELECT *, replace(a, 'THE', 'x') AS b FROM (SELECT doc_id, text, replace(text, 'the', 'THE') AS a FROM documents))"""),
    "edit_stack_many": ([], """
SELECT doc_id, replace(b, 'que', 'QUE') AS text,
  CAST((length(text) - length(replace(text, 'the', ''))) / 3 + (length(a) - length(replace(a, 'THE', ''))) / 3
    + (length(b) - length(replace(b, 'que', ''))) / 3 AS BIGINT) AS matches
FROM (SELECT *, replace(a, 'THE', 'x') AS b FROM (SELECT doc_id, text, replace(text, 'the', 'THE') AS a FROM documents))"""),
    "edit_stack_by_document": ([], """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(b, '(?i)que', 'q', 'g') ELSE b END AS text,
  CAST((length(text) - length(replace(text, 'the', ''))) / 3 + (length(a) - length(replace(a, 'THE', ''))) / 3
    + CASE WHEN doc_id % 2 = 0 THEN len(regexp_extract_all(b, '(?i)que')) ELSE 0 END AS BIGINT) AS matches
FROM (SELECT *, replace(a, 'THE', concat('x', doc_id % 3)) AS b FROM (SELECT doc_id, text, replace(text, 'the', 'THE') AS a FROM documents))"""),
    "replace_blocks_by_rule": (["first_block_rule"], """
SELECT doc_id, page_num, block_no, CASE WHEN off THEN 0 ELSE matches END AS matches, CASE WHEN off THEN text ELSE new_text END AS new_text
FROM (SELECT doc_id, page_num, block_no, text, doc_id % 7 = 0 AND page_num <> 1 AS off, CAST(n + (length(t) - length(replace(t, z, ''))) / length(z) AS BIGINT) AS matches, replace(t, z, 'z') AS new_text FROM first_block_rule)"""),
    "find_replace_requests": (["requested", "request_texts"], """
SELECT q.request_id, q.doc_id, q.status, q.matches,
  CASE WHEN q.matches > 0 THEN concat('Find & Replace: ''', q.find_text, ''' -> ''', q.replace_text, ''' (', q.matches, ' matches)') ELSE '' END AS action
FROM (SELECT r.*, CAST(CASE WHEN r.status <> 200 THEN 0 WHEN r.no = 0 THEN coalesce(m.n0, 0) ELSE coalesce(m.n1, 0) END AS BIGINT) AS matches
  FROM requested r LEFT JOIN request_texts m ON r.doc_id = m.doc_id) q"""),
    "upload_dates": (["catalog"], "SELECT doc_id, upload_date FROM catalog"),
    "stream_latest_edits": (["latest"], "SELECT doc_id, idx, new_text FROM latest"),
    "stream_uploads": (["catalog"], r"""
SELECT doc_id, name, file_type, concat(sha256(concat(doc_id, '|', name)), regexp_extract(name, '[^./][^/]*?(\.[^./]*)\z', 1)) AS storage_path
FROM catalog WHERE file_type IN ('pdf', 'docx') AND size_bytes <= 10485760"""),
    "keyword_topk": ([], r"""
WITH tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
scored AS (SELECT doc_id, word, round(tf * ln((SELECT count(*) FROM documents) / df), 6) AS score FROM tf JOIN df USING (word)),
ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rank, word, score FROM scored)
SELECT doc_id, rank, word, score FROM ranked WHERE rank <= 3"""),
    "content_requests": (["saves"], """
SELECT request_id, doc_id, status, n_items, CASE WHEN status = 200 THEN concat('Edited text content (', n_items, ' block(s))') ELSE '' END AS action FROM saves"""),
    "content_requests_text": (["saved", "paragraphs", "blocks", "doc_pages"], """
SELECT p.doc_id, p.scope, p.idx, CAST(-1 AS BIGINT) AS page_num, CAST(-1 AS BIGINT) AS block_no, l.text AS new_text
FROM paragraphs p JOIN (SELECT doc_id, idx, arg_max(text, seq) AS text FROM saved WHERE file_type = 'docx' AND idx IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2) l
ON p.doc_id = l.doc_id AND p.idx = l.idx AND p.scope = 'body' WHERE p.text <> l.text
UNION ALL SELECT b.doc_id, 'page', -1, b.page_num, b.block_no, l.text
FROM blocks b JOIN (SELECT s.doc_id, s.page_num, s.block_no, arg_max(s.text, s.seq) AS text FROM saved s
  JOIN doc_pages p ON s.doc_id = p.doc_id AND s.page_num = p.page_num WHERE s.file_type = 'pdf' AND s.text IS NOT NULL GROUP BY ALL) l
ON b.doc_id = l.doc_id AND b.page_num = l.page_num AND b.block_no = l.block_no WHERE b.text <> l.text"""),
    "style_requests": (["style_counted"], "SELECT request_id, doc_id, status, action, CAST(images_count AS BIGINT) AS images_count FROM style_counted"),
    "style_requests_runs": (["runs", "style_final"], """
SELECT r.doc_id, r.scope, r.idx, r.run_no, coalesce(CASE WHEN r.scope <> 'header' THEN s.font_name END, r.font_name, '') AS font_name,
  coalesce(CASE WHEN r.scope <> 'header' THEN s.font_size END, r.font_size, 0.0::DOUBLE) AS font_size
FROM runs r JOIN style_final s ON r.doc_id = s.doc_id WHERE s.file_type = 'docx'"""),
    "style_requests_stamps": (["sections", "doc_pages", "style_final"], """
SELECT n.doc_id, CAST(n.section_no AS BIGINT) AS place, n.part, coalesce(n.new_text, x.text) AS text FROM (
  SELECT f.doc_id, s.section_no, 'header' AS part, f.header_text AS new_text FROM style_final f CROSS JOIN (SELECT 0 AS section_no UNION ALL SELECT 1) s WHERE f.file_type = 'docx'
  UNION ALL SELECT f.doc_id, s.section_no, 'footer', f.footer_text FROM style_final f CROSS JOIN (SELECT 0 AS section_no UNION ALL SELECT 1) s WHERE f.file_type = 'docx') n
LEFT JOIN (SELECT * FROM sections WHERE para_no = 0) x ON n.doc_id = x.doc_id AND n.section_no = x.section_no AND n.part = x.part
WHERE n.new_text IS NOT NULL OR x.doc_id IS NOT NULL
UNION ALL SELECT p.doc_id, p.page_num, 'header', f.header_text FROM doc_pages p JOIN style_final f ON p.doc_id = f.doc_id WHERE f.file_type = 'pdf' AND f.header_text IS NOT NULL
UNION ALL SELECT p.doc_id, p.page_num, 'footer', f.footer_text FROM doc_pages p JOIN style_final f ON p.doc_id = f.doc_id WHERE f.file_type = 'pdf' AND f.footer_text IS NOT NULL"""),
    "style_requests_images": (["style_saves", "images", "by_occurrence", "first_images"], """
SELECT i.doc_id, i.page_num, i.part_id, coalesce(t.image, '') AS new_image
FROM images i JOIN (SELECT DISTINCT doc_id, file_type FROM style_saves WHERE status = 200) d ON i.doc_id = d.doc_id
LEFT JOIN (SELECT DISTINCT n.doc_id, n.part_id, s.image FROM (
    SELECT doc_id, part_id, image_no, 'docx' AS kind FROM by_occurrence UNION ALL SELECT doc_id, part_id, image_no, 'pdf' FROM first_images) n
  JOIN style_saves s ON n.doc_id = s.doc_id AND n.image_no = s.image_index AND n.kind = s.file_type WHERE s.status = 200) t
ON i.doc_id = t.doc_id AND i.part_id = t.part_id"""),
    "catalog_state": (["catalog", "history", "style_counted"], """
SELECT c.doc_id, CAST(coalesce(n.images_count, c.images_count, -1) AS BIGINT) AS images_count,
  row_number() OVER (PARTITION BY c.doc_id ORDER BY h.seq) - 1 AS entry_no, h.date, h.action
FROM catalog c JOIN (SELECT doc_id, seq, date, action FROM history
  UNION ALL SELECT doc_id, request_id + 1000000000, '2024-02-01', action FROM style_counted WHERE action <> '') h ON c.doc_id = h.doc_id
LEFT JOIN (SELECT doc_id, max(images_count) AS images_count FROM style_counted WHERE status = 200 GROUP BY doc_id) n ON c.doc_id = n.doc_id"""),
    "validate_records": ([], """
SELECT conv_id, turn, reason = '' AS valid, reason FROM (
  SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN 'no_text' WHEN role NOT IN ('system', 'user', 'assistant') THEN 'unknown_role'
    WHEN row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) > 1 THEN 'duplicate' ELSE '' END AS reason
  FROM (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 AND role = 'assistant' THEN 'bot' ELSE role END AS role,
    CASE WHEN conv_id % 11 = 0 THEN '  ' ELSE text END AS text
    FROM (SELECT * FROM conversations UNION ALL SELECT * FROM conversations WHERE conv_id % 5 = 0)))"""),
    "rouge_l_scores": (["answer_pairs"], r"""
SELECT conv_id, turn, n_candidate, n_reference, n_common,
  CASE WHEN n_candidate + n_reference > 0 THEN round(2 * n_common / (n_candidate + n_reference), 6) ELSE 0.0::DOUBLE END AS f1
FROM (
  WITH RECURSIVE split AS (
    SELECT conv_id, turn, regexp_extract_all(lower(candidate), '\p{L}+') AS c, regexp_extract_all(lower(reference), '\p{L}+') AS r FROM answer_pairs
  ), prefixes AS (
    SELECT conv_id, turn, 0 AS i, unnest(range(1, len(r) + 1)) AS j, CAST(0 AS BIGINT) AS n FROM split WHERE len(c) > 0
    UNION ALL
    SELECT conv_id, turn, i, j, max(greatest(n, hit)) OVER (PARTITION BY conv_id, turn ORDER BY j) AS n FROM (
      SELECT p.conv_id, p.turn, p.i + 1 AS i, p.j, p.n,
        CASE WHEN s.c[p.i + 1] = s.r[p.j] THEN 1 + coalesce(lag(p.n) OVER (PARTITION BY p.conv_id, p.turn ORDER BY p.j), 0) ELSE 0 END AS hit
      FROM prefixes p JOIN split s ON p.conv_id = s.conv_id AND p.turn = s.turn WHERE p.i < len(s.c))
  )
  SELECT s.conv_id, s.turn, CAST(len(c) AS BIGINT) AS n_candidate, CAST(len(r) AS BIGINT) AS n_reference, coalesce(max(p.n), 0) AS n_common
  FROM split s LEFT JOIN prefixes p ON s.conv_id = p.conv_id AND s.turn = p.turn GROUP BY s.conv_id, s.turn, c, r)"""),
    "label_balance": ([], """
SELECT quality, n, round(n / sum(n) OVER (), 6) AS share, round(n / min(n) OVER (), 6) AS ratio
FROM (SELECT CAST(quality AS BIGINT) AS quality, count(*) AS n FROM labels GROUP BY 1)"""),
    "balanced_labels": ([], """
SELECT doc_id, quality FROM (
  SELECT doc_id, CAST(quality AS BIGINT) AS quality, row_number() OVER (PARTITION BY quality ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS no FROM labels)
WHERE no <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))"""),
    "split_80_10_10": ([], """
SELECT conv_id, turn, CASE WHEN v % 10 < 8 THEN 'train' WHEN v % 10 < 9 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT conv_id, turn, (strpos('0123456789abcdef', substr(h, 1, 1)) - 1) * 268435456 + (strpos('0123456789abcdef', substr(h, 2, 1)) - 1) * 16777216 + (strpos('0123456789abcdef', substr(h, 3, 1)) - 1) * 1048576 + (strpos('0123456789abcdef', substr(h, 4, 1)) - 1) * 65536 + (strpos('0123456789abcdef', substr(h, 5, 1)) - 1) * 4096 + (strpos('0123456789abcdef', substr(h, 6, 1)) - 1) * 256 + (strpos('0123456789abcdef', substr(h, 7, 1)) - 1) * 16 + (strpos('0123456789abcdef', substr(h, 8, 1)) - 1) * 1 AS v FROM (SELECT conv_id, turn, md5(CAST(conv_id AS VARCHAR)) AS h FROM conversations))"""),
    "rouge_scores": (["answer_pairs"], r"""
SELECT p.conv_id, p.turn, CAST(coalesce(t.c, 0) AS BIGINT) AS n_candidate, CAST(coalesce(t.r, 0) AS BIGINT) AS n_reference,
  CAST(coalesce(t.both_, 0) AS BIGINT) AS n_common, CASE WHEN coalesce(t.c + t.r, 0) > 0 THEN round(2 * t.both_ / (t.c + t.r), 6) ELSE 0.0::DOUBLE END AS f1
FROM answer_pairs p LEFT JOIN (
  SELECT conv_id, turn, sum(c) AS c, sum(r) AS r, sum(least(c, r)) AS both_ FROM (
    SELECT conv_id, turn, gram, sum(side) AS c, sum(1 - side) AS r FROM (
      SELECT conv_id, turn, 1 AS side, unnest(w) AS gram FROM (SELECT conv_id, turn, regexp_extract_all(lower(candidate), '\p{L}+') AS w FROM answer_pairs)
      UNION ALL SELECT conv_id, turn, 0, unnest(w) FROM (SELECT conv_id, turn, regexp_extract_all(lower(reference), '\p{L}+') AS w FROM answer_pairs))
    GROUP BY ALL) GROUP BY conv_id, turn) t ON p.conv_id = t.conv_id AND p.turn = t.turn"""),
    "rouge_2_scores": (["answer_pairs"], r"""
SELECT p.conv_id, p.turn, CAST(coalesce(t.c, 0) AS BIGINT) AS n_candidate, CAST(coalesce(t.r, 0) AS BIGINT) AS n_reference,
  CAST(coalesce(t.both_, 0) AS BIGINT) AS n_common, CASE WHEN coalesce(t.c + t.r, 0) > 0 THEN round(2 * t.both_ / (t.c + t.r), 6) ELSE 0.0::DOUBLE END AS f1
FROM answer_pairs p LEFT JOIN (
  SELECT conv_id, turn, sum(c) AS c, sum(r) AS r, sum(least(c, r)) AS both_ FROM (
    SELECT conv_id, turn, gram, sum(side) AS c, sum(1 - side) AS r FROM (
      SELECT conv_id, turn, 1 AS side, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT conv_id, turn, regexp_extract_all(lower(candidate), '\p{L}+') AS w FROM answer_pairs)
      UNION ALL SELECT conv_id, turn, 0, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM (SELECT conv_id, turn, regexp_extract_all(lower(reference), '\p{L}+') AS w FROM answer_pairs))
    GROUP BY ALL) GROUP BY conv_id, turn) t ON p.conv_id = t.conv_id AND p.turn = t.turn"""),
    "slot_exact_match": (["parsed"], """
SELECT count(*) AS n_prompts, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS n_exact, round(avg(CAST(hit AS INT)), 6) AS share
FROM (SELECT CASE WHEN is_text THEN NOT understood ELSE understood AND find_text = f AND replace_text = r END AS hit FROM parsed)"""),
    "style_preservation": (["styled_runs"], """
SELECT doc_id, count(*) AS n_runs, count(*) FILTER (same) AS n_kept, round(count(*) FILTER (same) / count(*), 6) AS share
FROM (SELECT doc_id, font_name IS NOT DISTINCT FROM old_name AND font_size IS NOT DISTINCT FROM old_size AS same FROM styled_runs)
GROUP BY doc_id"""),
}
FIXTURES["by_occurrence"] = "SELECT DISTINCT doc_id, part_id, pos AS image_no FROM images"
NEEDS["by_occurrence"] = ["images"]

ORACLES = {name: _with_fixtures(*spec) for name, spec in BODIES.items()}
