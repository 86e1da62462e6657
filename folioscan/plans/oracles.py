"""The SQL that says what each query of the catalogue returns, for DuckDB over the same tables."""

from __future__ import annotations

_CORPUS = "corpus AS (SELECT doc_id AS document_id, '/'||source||'/'||lang||'/doc_'||doc_id||'.txt' AS path, 'doc_'||doc_id AS title, sha256(text) AS sha256, strlen(text)::BIGINT AS size, text FROM documents)"
_HITS = "hits AS (SELECT c.document_id, c.path, c.text, list_inner_product(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS raw FROM embeddings e JOIN corpus c ON e.vec_id = c.document_id)"
# Sentences by marking, as there is no look-around; the first rule's mark may stand before a second one.
_MARKED = "string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+([A-Z\\x{C0}-\\x{24F}\\d\"''(\\[])', '\\1'||chr(1)||'\\2', 'g'), '\\n\\n+', chr(10)||chr(1), 'g'), chr(1))"
def _sentences(key: str, src: str) -> str:
    """s(key, a): the sentences of src(key, text) as arrays."""
    return (
        f"p AS (SELECT {key}, {_MARKED} AS p FROM {src}), "
        f"m AS (SELECT {key}, 1 AS i, p, [p[1]] AS a FROM p UNION ALL SELECT {key}, i+1, p, CASE WHEN length(a[-1]) < 20 THEN a[:-2] || [a[-1]||p[i+1]] ELSE a || [p[i+1]] END FROM m WHERE i < len(p)), "
        f"s AS (SELECT {key}, list_filter(a, lambda x: length(regexp_replace(x, '\\s', '', 'g')) > 0) AS a FROM m WHERE i = len(p))"
    )


_OVER = "len(cur) > 0 AND length(array_to_string(cur, '')) + length(a[i+1]) > 500"
_KEPT = "list_filter(cur, lambda x, j: j = len(cur) OR length(array_to_string(cur[j:], '')) <= 50)"
_CHUNKED = (
    _sentences("doc_id", "documents") + ", "
    f"f AS (SELECT doc_id, 0 AS i, a, []::VARCHAR[] AS done, []::VARCHAR[] AS cur FROM s UNION ALL SELECT doc_id, i+1, a, CASE WHEN {_OVER} THEN done || [array_to_string(cur, '')] ELSE done END, CASE WHEN {_OVER} THEN {_KEPT} || [a[i+1]] ELSE cur || [a[i+1]] END FROM f WHERE i < len(a)), "
    "r AS (SELECT doc_id, CASE WHEN len(cur) > 0 THEN done || [array_to_string(cur, '')] ELSE done END AS cs FROM f WHERE i = len(a)), "
    "chunks AS (SELECT doc_id AS document_id, (generate_subscripts(cs, 1) - 1)::INTEGER AS chunk_index, unnest(cs) AS text FROM r)"
)
_NEXT = "CASE WHEN {st}+3000 < n AND contains(substring(text, {st}+2401, 600), chr(10)) THEN {st}+3000-strpos(reverse(substring(text, {st}+2401, 600)), chr(10))+1 ELSE {st}+3000 END"
_PAGES = (
    "d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), "
    f"t AS (SELECT doc_id, text, n, 1 AS page, 0 AS st, {_NEXT.format(st=0)} AS en FROM d UNION ALL SELECT doc_id, text, n, page+1, en, {_NEXT.format(st='en')} FROM t WHERE en < n), "
    "pages_ AS (SELECT doc_id, page::INTEGER AS page, substring(text, st+1, least(en, n)-st) AS text FROM t WHERE length(regexp_replace(substring(text, st+1, least(en, n)-st), '\\s', '', 'g')) > 0)"
)
_PAGED = (
    _PAGES + ", " + _sentences("doc_id, page", "pages_") + ", "
    "u AS (SELECT doc_id, page, unnest(a) AS x, generate_subscripts(a, 1) AS k FROM s), "
    "g AS (SELECT doc_id, list(x ORDER BY page, k) AS a, list(page ORDER BY page, k) AS pg FROM u GROUP BY doc_id), "
    f"f AS (SELECT doc_id, 0 AS i, a, pg, []::VARCHAR[] AS done, []::VARCHAR[] AS cur, []::INTEGER[] AS dp, pg[1] AS cp FROM g UNION ALL SELECT doc_id, i+1, a, pg, CASE WHEN {_OVER} THEN done || [array_to_string(cur, '')] ELSE done END, CASE WHEN {_OVER} THEN {_KEPT} || [a[i+1]] ELSE cur || [a[i+1]] END, CASE WHEN {_OVER} THEN dp || [cp] ELSE dp END, CASE WHEN {_OVER} THEN pg[i+1] ELSE cp END FROM f WHERE i < len(a)), "
    "r AS (SELECT doc_id, done || [array_to_string(cur, '')] AS cs, dp || [cp] AS ps FROM f WHERE i = len(a)), "
    "chunks AS (SELECT doc_id AS document_id, (generate_subscripts(cs, 1) - 1)::INTEGER AS chunk_index, unnest(cs) AS text, unnest(ps)::INTEGER AS page FROM r)"
)
_EXISTING = "existing AS (SELECT document_id, replace(path, '/', '\\') AS path, title, CASE WHEN document_id % 5 = 0 THEN 'old'||sha256 ELSE sha256 END AS sha256, size FROM corpus WHERE document_id % 4 <> 0)"
_STATUSES = "st AS (SELECT c.document_id, c.path, c.title, c.sha256, c.size, CASE WHEN e.sha256 IS NULL THEN 'inserted' WHEN e.sha256 = c.sha256 THEN 'skipped' ELSE 'updated' END AS status FROM corpus c LEFT JOIN existing e ON replace(e.path, '\\', '/') = c.path)"
_TOP3 = "top3 AS (SELECT (row_number() OVER (ORDER BY raw DESC, document_id))::INTEGER AS hit_rank, document_id, path FROM hits ORDER BY raw DESC, document_id LIMIT 3)"
_HYBRID = (
    "n AS (SELECT document_id, count(*) AS n FROM chunks WHERE document_id IN (SELECT document_id FROM top3) GROUP BY 1), "
    "hy AS (SELECT t.hit_rank, t.document_id, t.path, k.chunk_index, k.text FROM top3 t JOIN n USING (document_id) JOIN chunks k USING (document_id) WHERE n.n <= 20 OR k.chunk_index BETWEEN 12-10 AND 12+10)"
)
# A fold over the rows of the answer, in order: header and text of each, as far as the budget goes.
_ASSEMBLED = (
    "o AS (SELECT *, row_number() OVER (ORDER BY hit_rank, document_id, chunk_index) AS r, '--- Document: '||path||' ---' AS header FROM hy), "
    "w AS (SELECT 0::BIGINT AS r, ''::VARCHAR AS txt, 0::BIGINT AS total, (-1)::BIGINT AS doc, false AS closed, false AS done UNION ALL "
    "SELECT r2, CASE WHEN dn OR skip THEN txt WHEN fits THEN o2||chr(10)||chr(10)||t WHEN 16000-t2 > 100 THEN o2||chr(10)||chr(10)||substring(t, 1, (16000-t2)::INTEGER)||' [...]' ELSE o2 END, CASE WHEN dn OR skip THEN total WHEN fits THEN t2+length(t) ELSE t2 END, CASE WHEN dn THEN doc ELSE d END, CASE WHEN dn THEN closed WHEN skip THEN true ELSE NOT fits END, dn FROM ("
    "SELECT o.r AS r2, w.txt, w.total, w.doc, w.closed, o.document_id AS d, o.text AS t, (w.done OR (o.document_id <> w.doc AND w.doc >= 0 AND w.total >= 16000)) AS dn, (o.document_id = w.doc AND w.closed) AS skip, "
    "CASE WHEN o.document_id <> w.doc THEN CASE WHEN w.txt = '' THEN o.header ELSE w.txt||chr(10)||chr(10)||o.header END ELSE w.txt END AS o2, CASE WHEN o.document_id <> w.doc THEN w.total+length(o.header) ELSE w.total END AS t2, "
    "(CASE WHEN o.document_id <> w.doc THEN w.total+length(o.header) ELSE w.total END) + length(o.text) <= 16000 AS fits FROM w JOIN o ON o.r = w.r + 1) z), "
    "ctx AS (SELECT txt AS context FROM w ORDER BY r DESC LIMIT 1)"
)
_ANSWER = f"WITH RECURSIVE {_CORPUS}, {_HITS}, {_TOP3}, {_CHUNKED}, {_HYBRID}, {_ASSEMBLED}"
_SYSTEM = "You are a helpful assistant that answers questions based on the provided document context. Use ONLY the information from the context below to answer. If the context does not contain enough information, say so clearly. Answer in the same language as the user''s question."
_LOGIT = "len(list_intersect(list_distinct(string_split_regex(lower(text), '\\s+')), ['what', 'is', 'the', 'of', 'and']))::DOUBLE / 5 * 4 - 2"
_MD = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)`{{1,3}}[^`]*`{{1,3}}', '', 'g'), '!\\[.*?\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '\\*{{1,3}}([^*\\n]+)\\*{{1,3}}', '\\1', 'g'), '(?m)^[-*_]{{3,}}\\s*$', '', 'g'), '(?m)^#{{1,6}}\\s+', '', 'g'), chr(32)||chr(9)||chr(10)||chr(13))"
)
# Pages of a clicked chunk, or its window where it has none; documents with odd ids have no pages here.
_AROUND = (
    "c AS (SELECT * FROM chunks WHERE {which}), q AS (SELECT document_id, page AS center_page FROM c WHERE chunk_index = {center} AND document_id % 2 = 0), "
    "x AS (SELECT c.*, center_page, abs(page - center_page) AS dd FROM c JOIN q USING (document_id)), y AS (SELECT *, dense_rank() OVER (PARTITION BY document_id, CASE WHEN dd = 0 THEN 0 ELSE 1 END ORDER BY dd) AS rk FROM x), "
    "z AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY dd, page, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM y WHERE dd = 0 OR rk = dd), "
    "around AS (SELECT document_id, chunk_index, text FROM z WHERE dd = 0 OR b < {budget} UNION ALL SELECT document_id, chunk_index, text FROM c WHERE document_id NOT IN (SELECT document_id FROM q) AND chunk_index BETWEEN greatest({center} - 10, 0) AND {center} + 10)"
)
_BUDGETED = (
    "b1 AS (SELECT document_id, chunk_index, text, sum(length(text)) OVER (PARTITION BY document_id ORDER BY chunk_index) AS cum FROM {src}), "
    "o1 AS (SELECT *, sum(CASE WHEN cum > {budget} THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY chunk_index) AS ov, {budget}-(cum-length(text)) AS room FROM b1), "
    "o2 AS (SELECT document_id, chunk_index, CASE WHEN ov = 0 THEN text ELSE substring(text, 1, room::INTEGER)||' [...]' END AS text FROM o1 WHERE ov = 0 OR (ov = 1 AND room > 100))"
)
_SYSTEM_PAGE = "You are a helpful assistant that answers questions based on the provided document context. Use ONLY the information from the context below. If the context does not contain enough information, say so clearly. Answer in the same language as the user''s question."
# crc32 of a word's UTF-8 bytes, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex(encode(w))), 2), lambda i: (strpos('0123456789ABCDEF', substring(hex(encode(w)), i, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substring(hex(encode(w)), i + 1, 1)) - 1)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_PATHS = ["a\\b\\c", "/x/y/", "/x/y///", "/", "C:/", "C:\\", "C:\\x\\", "", "x", "x/", "//", "/Ä/b c/"]
_PROPS = "CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN NULL WHEN event_id % 10 = 2 THEN '{\"page\": '||(event_id % 7)||'}' ELSE props END"

ORACLE_SQL: dict[str, str] = {
    "q01_knn_topk": f"WITH {_CORPUS}, {_HITS} SELECT document_id, path, round(raw, 6) AS score FROM hits ORDER BY raw DESC, document_id LIMIT 10",
    "q02_knn_folder_filter": f"WITH {_CORPUS}, {_HITS} SELECT document_id, path, round(raw, 6) AS score FROM hits WHERE path ILIKE '/src1/%' OR path ILIKE '/SRC2/en/%' ORDER BY raw DESC, document_id LIMIT 10",
    "q03_knn_all": f"WITH {_CORPUS}, {_HITS} SELECT document_id, path, round(raw, 6) AS score FROM hits",
    "q04_knn_batch": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS document_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS raw FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id CROSS JOIN embeddings q WHERE q.vec_id % 100 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, document_id)::INTEGER AS rank FROM s) SELECT query_id, rank, document_id, round(raw, 6) AS score FROM r WHERE rank <= 5",
    "q05_rerank_two_stage": f"WITH {_CORPUS}, {_HITS}, c AS (SELECT *, {_LOGIT} AS logit FROM (SELECT * FROM hits ORDER BY raw DESC, document_id LIMIT 30) t) SELECT document_id, round(1/(1+exp(-logit)), 6) AS score, round(raw, 6) AS embedding_score, round(logit, 6) AS rerank_score FROM c ORDER BY logit DESC, raw DESC, document_id LIMIT 10",
    "q06_threshold_fallback": f"WITH {_CORPUS}, {_HITS}, t AS (SELECT document_id, raw FROM hits ORDER BY raw DESC, document_id LIMIT 30), u AS (SELECT document_id, raw AS s, 0 AS query_id FROM t UNION ALL SELECT document_id, raw/100, 1 FROM t), v AS (SELECT *, max(CASE WHEN s >= 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS passed FROM u) SELECT document_id, round(s, 6) AS score, query_id FROM v WHERE s >= 0.2 OR passed = 0",
    "q07_result_format": f"WITH {_CORPUS}, {_HITS} SELECT document_id, substring(replace(text, chr(10), ' '), 1, 180) AS snippet, printf('%.4f', round(raw, 4)) AS score_text, floor(round(raw, 6)*100+0.5)::INTEGER AS percent, regexp_extract(path, '\\.([^.]+)$', 1) AS ext, array_to_string(string_split(path, '/')[-3:], '/') AS short_path, '&lt;b&gt;'||path||'&lt;/b&gt;' AS escaped FROM hits ORDER BY raw DESC, document_id LIMIT 10",
    "q08_chunk_fixed": "WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS st FROM documents) SELECT doc_id, (st // 1000)::INTEGER AS chunk_index, substring(text, st+1, 1200) AS text FROM s",
    "q09_chunk_stream": "WITH n AS (SELECT doc_id, text, CASE WHEN length(text) >= 1200 THEN (length(text)-1200)//1000+1 ELSE 0 END AS n FROM documents), s AS (SELECT doc_id, text, n, unnest(range(0, n+1)) AS k FROM n) SELECT doc_id, k::INTEGER AS chunk_index, CASE WHEN k < n THEN substring(text, k*1000+1, 1200) ELSE substring(text, n*1000+1) END AS text FROM s WHERE k < n OR length(text) > n*1000",
    "q10_sentence_split": f"WITH RECURSIVE {_sentences('doc_id', 'documents')} SELECT doc_id, (generate_subscripts(a, 1)-1)::INTEGER AS sentence, unnest(a) AS text FROM s",
    "q11_chunk_sentences": f"WITH RECURSIVE {_CHUNKED} SELECT * FROM chunks",
    "q12_txt_pages": f"WITH RECURSIVE {_PAGES} SELECT doc_id AS document_id, page, text FROM pages_",
    "q13_chunk_paged": f"WITH RECURSIVE {_PAGED} SELECT * FROM chunks",
    "q14_md_sections": "WITH t AS (SELECT conv_id, string_agg('# '||role||chr(10)||'**'||text||'**'||chr(10), '' ORDER BY turn) AS x FROM conversations GROUP BY 1), "
    f"p AS (SELECT conv_id, string_split(regexp_replace(x, '(?m)^(#{{1,6}}\\s)', chr(1)||'\\1', 'g'), chr(1)) AS p FROM t), c AS (SELECT conv_id, list_filter(list_transform(p, lambda x: {_MD.format(x='x')}), lambda x: x <> '') AS c FROM p) SELECT conv_id, generate_subscripts(c, 1)::INTEGER AS page, unnest(c)||chr(10) AS text FROM c",
    "q15_para_pages": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), s AS (SELECT doc_id, k, trim(x, chr(32)||chr(9)||chr(13)) AS x FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM s WHERE x <> '') SELECT doc_id, ((n-1)//10+1)::INTEGER AS page, string_agg(x, chr(10) ORDER BY n)||chr(10) AS text FROM n GROUP BY 1, 2",
    "q16_normalize_ws": "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, '.', ' '||chr(10)||' '||chr(10)), chr(10)), lambda x: trim(x, chr(32)||chr(9)||chr(13))), lambda x: x <> ''), chr(10)) AS text FROM documents",
    "q17_table_markdown": "SELECT '| key | name | region |'||chr(10)||'| --- | --- | --- |'||chr(10)||string_agg('| '||n_nationkey||' | '||n_name||' | '||CASE WHEN n_regionkey <> 2 THEN 'r '||n_regionkey ELSE '' END||' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation",
    "q18_block_table_overlap": "WITH b AS (SELECT * FROM (VALUES (1,0,0,100,20,' top ',0),(1,10,50,90,100,'in table',0),(1,0,90,100,140,'half out',0),(1,0,200,50,220,'image',1),(1,0,300,100,320,'end',0),(2,0,0,10,10,'only',0),(2,0,20,10,20,'flat',0)) AS t(page,x0,y0,x1,y1,text,type)), "
    "t AS (SELECT * FROM (VALUES (1,0,40,100,110,'| t |'),(2,0,100,10,120,'')) AS t(page,x0,y0,x1,y1,markdown)), "
    "k AS (SELECT page, y0, 0 AS kind, trim(text) AS text FROM b WHERE type = 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND least(b.x1,t.x1) > greatest(b.x0,t.x0) AND least(b.y1,t.y1) > greatest(b.y0,t.y0) AND (least(b.x1,t.x1)-greatest(b.x0,t.x0))*(least(b.y1,t.y1)-greatest(b.y0,t.y0)) > 0.5*(b.x1-b.x0)*(b.y1-b.y0)) UNION ALL SELECT page, y0, 1, markdown FROM t WHERE markdown <> '') "
    "SELECT page, string_agg(text, chr(10)||chr(10) ORDER BY y0, kind, text) AS text FROM k WHERE text <> '' GROUP BY 1",
    "q19_change_detection": f"WITH {_CORPUS}, {_EXISTING}, {_STATUSES} SELECT document_id, path, status FROM st",
    "q20_upsert_state": f"WITH {_CORPUS}, {_EXISTING}, {_STATUSES} SELECT document_id, path, title, sha256, size FROM existing WHERE replace(path, '\\', '/') NOT IN (SELECT path FROM st WHERE status <> 'skipped') UNION ALL SELECT document_id, path, title, sha256, size FROM st WHERE status <> 'skipped'",
    "q21_index_stats": f"WITH {_CORPUS}, {_EXISTING}, {_STATUSES}, x AS (SELECT CASE WHEN document_id % 50 = 3 THEN 'error' ELSE status END AS s FROM st) SELECT count(*) FILTER (s = 'inserted') AS inserted, count(*) FILTER (s = 'updated') AS updated, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s NOT IN ('inserted', 'updated', 'skipped')) AS failed, count(*) AS processed FROM x",
    "q22_list_documents": f"WITH RECURSIVE {_CORPUS}, {_CHUNKED}, n AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) SELECT c.document_id AS id, path, title, sha256, (c.document_id + 0.5)::DOUBLE AS mtime, size, 1700000000 + c.document_id AS created_at, 1700000000 + c.document_id + (c.document_id * 7919) % 100000 AS updated_at, coalesce(n.n, 0) AS chunk_count FROM corpus c LEFT JOIN n USING (document_id)",
    "q23_list_directories": f"WITH {_CORPUS}, p AS (SELECT path FROM corpus UNION ALL SELECT unnest(['x.txt', '/x.txt', 'C:/a/x', 'C:/a/y'])) SELECT CASE WHEN NOT contains(path, '/') THEN '.' WHEN regexp_matches(path, '^/[^/]*$') THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS path, count(*) AS count FROM p GROUP BY 1",
    "q24_stats": f"WITH RECURSIVE {_CORPUS}, {_CHUNKED} SELECT (SELECT count(*) FROM corpus) AS document_count, (SELECT sum(size)::BIGINT FROM corpus) AS total_size, (SELECT count(*) FROM chunks) AS chunk_count",
    "q25_all_chunks": f"WITH RECURSIVE {_CHUNKED} SELECT document_id, chunk_index, text, count(*) OVER () AS chunk_count FROM chunks WHERE document_id = 3",
    "q26_context_window": f"WITH RECURSIVE {_CHUNKED}, h AS (SELECT doc_id AS document_id, (doc_id % 30)::INTEGER AS center FROM documents) SELECT h.document_id, center, chunk_index, text FROM chunks JOIN h USING (document_id) WHERE chunk_index BETWEEN greatest(center-10, 0) AND center+10",
    "q27_context_by_page": f"WITH RECURSIVE {_PAGED}, x AS (SELECT c.*, (document_id % 4)::INTEGER AS center_page, abs(page - document_id % 4) AS dd FROM chunks c), y AS (SELECT *, dense_rank() OVER (PARTITION BY document_id, CASE WHEN dd = 0 THEN 0 ELSE 1 END ORDER BY dd) AS rk FROM x), z AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY dd, page, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM y WHERE dd = 0 OR rk = dd) SELECT document_id, center_page, chunk_index, page, text FROM z WHERE dd = 0 OR b < 4000",
    "q28_hybrid_context": f"WITH RECURSIVE {_CORPUS}, {_HITS}, {_TOP3}, {_CHUNKED}, {_HYBRID} SELECT * FROM hy",
    "q29_context_budget": f"WITH RECURSIVE {_CHUNKED}, c AS (SELECT *, sum(length(text)) OVER (PARTITION BY document_id ORDER BY chunk_index) AS cum FROM chunks), o AS (SELECT *, sum(CASE WHEN cum > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY chunk_index) AS ov, 2000-(cum-length(text)) AS room FROM c) SELECT document_id, chunk_index, CASE WHEN ov = 0 THEN text ELSE substring(text, 1, room::INTEGER)||' [...]' END AS text FROM o WHERE ov = 0 OR (ov = 1 AND room > 100)",
    "q30_context_multi_doc": f"{_ANSWER} SELECT context FROM ctx",
    "q31_rag_prompt": f"{_ANSWER} SELECT 'system' AS role, '{_SYSTEM}' AS content UNION ALL SELECT 'user', 'Context:'||chr(10)||context||chr(10)||chr(10)||'Question: What is the of and the'||chr(10)||chr(10)||'Answer based only on the context above:' FROM ctx",
    "q32_delete": f"WITH {_CORPUS} SELECT document_id, path FROM corpus WHERE document_id <> 5 AND path <> '/src7/en/doc_7.txt'",
    "q33_prune_missing": f"WITH {_CORPUS} SELECT document_id, path FROM corpus WHERE document_id IN (SELECT doc_id FROM labels)",
    "q34_scan_stats": "WITH p AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+', '') AS path, length(html)::BIGINT AS n FROM pages) SELECT lower(regexp_extract(path, '[^/\\\\](\\.[^./\\\\]+)$', 1)) AS ext, count(*) AS file_count, sum(n)::BIGINT AS total_size, count(*) FILTER (n >= 3000) AS large_count FROM p GROUP BY 1",
    "q35_exclude_paths": f"WITH {_CORPUS} SELECT document_id, path FROM corpus WHERE document_id % 3 <> 0",
    "q36_tiers": "WITH m AS (SELECT r::INTEGER AS r FROM range(0, 40000, 500) t(r)), w AS (SELECT r, least(12, r//1000+1) AS b FROM m), v AS (SELECT r, CASE WHEN b > 2 THEN b-1 ELSE b END AS b FROM w) SELECT r AS ram_mb, CASE WHEN r >= 16384 THEN 'Qwen2.5-7B-Instruct' WHEN r >= 8192 THEN 'Qwen2.5-3B-Instruct' ELSE 'Qwen2.5-1.5B-Instruct' END AS model, CASE WHEN r >= 16384 THEN '~4.7 GB' WHEN r >= 8192 THEN '~2.1 GB' ELSE '~1.1 GB' END AS size_label, CASE WHEN r >= 4096 THEN 64 WHEN r >= 2048 THEN 32 WHEN r >= 1024 THEN 16 WHEN r >= 512 THEN 8 ELSE 4 END::INTEGER AS batch_size, CASE WHEN r >= 1024 THEN 0.0 WHEN r >= 512 THEN 0.05 ELSE 0.2 END::DOUBLE AS sleep, greatest(1, least(b, r//1000+1, CASE WHEN r < 2048 THEN 2 WHEN r < 4096 THEN 3 WHEN r < 8192 THEN 6 ELSE 8 END))::INTEGER AS workers, greatest(1, least(r//500, 50))::INTEGER AS top_k FROM v",
    "q37_l2_normalise": "WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label+1)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v) SELECT vec_id, (generate_subscripts(v, 1)-1)::INTEGER AS place, round(unnest(v)/n, 6) AS x FROM n",
    "q38_metadata_json": f"WITH p AS (SELECT event_id, {_PROPS} AS p FROM events), m AS (SELECT event_id, CASE WHEN p IS NULL OR p = '' THEN '{{}}' ELSE p END AS m FROM p) SELECT event_id, m AS metadata, coalesce((m->>'$.page')::INTEGER, 0) AS page, (m->>'$.k')::BIGINT AS k FROM m",
    "q39_path_normalise": "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{p}')" for k, p in enumerate(_PATHS)) + ") AS t(k, p)) SELECT k::INTEGER AS k, replace(p, '\\', '/') AS path, regexp_replace(replace(p, '\\', '/'), '([^:])/+$', '\\1') AS folder FROM p",
    "q40_embed_text": f"WITH w AS (SELECT doc_id AS document_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents), d AS (SELECT DISTINCT w FROM w), h AS (SELECT w, {_CRC} AS h FROM d), "
    "c AS (SELECT document_id, h % 64 AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::BIGINT AS v FROM w JOIN h USING (w) GROUP BY 1, 2), n AS (SELECT document_id, sqrt(sum(v * v)) AS n FROM c GROUP BY 1), "
    "g AS (SELECT doc_id AS document_id, unnest(range(64)) AS place FROM documents) "
    "SELECT document_id, place::INTEGER AS place, round(coalesce(CASE WHEN n > 0 THEN (v / n)::FLOAT ELSE v::FLOAT END, 0::FLOAT)::DOUBLE, 6) AS x FROM g LEFT JOIN c USING (document_id, place) LEFT JOIN n USING (document_id)",
    "q41_incremental_stream": f"WITH RECURSIVE {_CORPUS}, {_CHUNKED}, n AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) SELECT path, title, sha256, size, coalesce(n.n, 0) AS chunk_count FROM corpus c LEFT JOIN n USING (document_id)",
    "q42_page_or_window": f"WITH RECURSIVE {_PAGED}, {_AROUND.format(center=4, budget=4000, which='true')} SELECT * FROM around",
    "q43_page_prompt": f"WITH RECURSIVE {_PAGED}, {_AROUND.format(center=2, budget=2000, which='document_id = 4')}, {_BUDGETED.format(src='around', budget=2000)}, e AS (SELECT document_id, string_agg(text, chr(10)||chr(10) ORDER BY chunk_index) AS context FROM o2 GROUP BY 1) SELECT document_id, 'system' AS role, '{_SYSTEM_PAGE}' AS content FROM e UNION ALL SELECT document_id, 'user', 'Context:'||chr(10)||context||chr(10)||chr(10)||'Question: What is the of and the' FROM e",
    "q44_joined_chunks": f"WITH RECURSIVE {_CHUNKED}, {_BUDGETED.format(src='chunks', budget=3000)} SELECT document_id, string_agg(text, chr(10)||chr(10) ORDER BY chunk_index) AS context FROM o2 GROUP BY 1",
    "q45_ask": f"WITH RECURSIVE {_CORPUS}, {_HITS}, {_TOP3}, hy AS (SELECT t.hit_rank, t.document_id, t.path, 0 AS chunk_index, c.text FROM top3 t JOIN corpus c USING (document_id)), {_ASSEMBLED}, s AS (SELECT string_agg(path||'#0', ',' ORDER BY hit_rank) AS sources FROM top3) "
    f"SELECT 'system '||length('{_SYSTEM}')||' user '||(length(context) + length('Context:') + 1 + 2 + length('Question: What is the of and the') + 2 + length('Answer based only on the context above:')) AS answer, context, sources FROM ctx, s",
    "q46_scan_totals": "SELECT count(*) AS file_count, coalesce(sum(length(html)), 0)::BIGINT AS total_size_bytes FROM pages",
    "q47_large_files": "WITH p AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+', '') AS path, length(html)::BIGINT AS n FROM pages) SELECT regexp_extract(path, '([^/\\\\]*)$', 1) AS name, path, n AS size_bytes FROM p WHERE n >= 3000",
    "q48_backends": "WITH m AS (SELECT k, ['darwin', 'linux', 'win32'][k % 3 + 1] AS platform, ['arm64', 'x86_64'][(k // 3) % 2 + 1] AS machine, ['cuda', 'rocm', 'mps', NULL][(k // 6) % 4 + 1] AS gpu, ['', 'CUDAExecutionProvider', 'ROCMExecutionProvider', 'CPUExecutionProvider', ''][(k // 24) % 5 + 1] AS provider, CASE WHEN k % 7 <> 0 THEN k * 100 END AS ram FROM range(240) t(k)), "
    "r AS (SELECT *, CASE WHEN platform = 'darwin' AND machine = 'arm64' THEN 1 WHEN gpu = 'cuda' AND provider = 'CUDAExecutionProvider' THEN 2 WHEN gpu = 'cuda' THEN 3 WHEN gpu = 'rocm' AND provider = 'ROCMExecutionProvider' THEN 4 WHEN gpu = 'rocm' THEN 5 WHEN provider <> '' THEN 6 WHEN gpu = 'mps' THEN 7 ELSE 8 END AS rule FROM m) "
    "SELECT k, CASE WHEN rule IN (1, 2, 4, 6) THEN 'onnx' ELSE 'torch' END AS backend, CASE WHEN rule = 1 THEN 'onnx/model_qint8_arm64.onnx' END AS model_file, CASE WHEN rule IN (3, 5) THEN 'cuda' WHEN rule = 7 THEN 'mps' WHEN rule = 8 THEN 'cpu' END AS device, CASE WHEN (platform = 'darwin' AND machine = 'arm64') OR gpu = 'cuda' THEN -1 ELSE 0 END::INTEGER AS gpu_layers, coalesce(ram, 8192)::INTEGER AS ram_mb FROM r",
    "q49_hits_by_path": f"WITH {_CORPUS}, {_HITS}, {_TOP3} SELECT (hit_rank + 1)::INTEGER AS hit_rank, replace(path, '/', '\\') AS path, document_id FROM top3",
}
