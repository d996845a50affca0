"""SQL for the queries whose results SQL can express, over whole tables."""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingles(name: str, key: str, table: str) -> str:
    """name_w (key, w, n) and name (key, pos, s): five-word shingles; the whole sequence if it is shorter."""
    return f"""{name}_w AS (SELECT {key}, w, len(w) AS n FROM (SELECT {key}, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL)),
{name} AS (SELECT {key}, p AS pos, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM (SELECT {key}, w, unnest(range(greatest(1, n - 4))) AS p FROM {name}_w WHERE n > 0))"""


OP2 = f"""WITH RECURSIVE {_shingles("sh", "doc_id", "documents")},
st AS (SELECT doc_id, count(DISTINCT s) AS k FROM sh GROUP BY doc_id),
ds AS (SELECT DISTINCT doc_id, s FROM sh),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM ds a JOIN ds b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
ln AS (SELECT a, b FROM pr JOIN st x ON x.doc_id = a JOIN st y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.k + y.k - shared)),
sy AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln),
re AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT re.node, sy.b FROM re JOIN sy ON sy.a = re.seen),
co AS (SELECT node, min(seen) AS c FROM re GROUP BY node)
SELECT d.doc_id, coalesce(st.k, 0) AS n_shingles, co.c AS component_id, d.doc_id = co.c AS kept FROM documents d JOIN co ON co.node = d.doc_id LEFT JOIN st ON st.doc_id = d.doc_id"""

OP5 = f"""WITH {_shingles("sh", "doc_id", "documents")}, {_shingles("it", "item_id", "benchmark")},
ic AS (SELECT item_id, s, count(*) AS c FROM it GROUP BY 1, 2),
isz AS (SELECT item_id, count(*) AS m FROM it GROUP BY 1),
dsz AS (SELECT doc_id, count(*) AS m FROM sh GROUP BY 1),
hit AS (SELECT sh.doc_id, ic.item_id, sh.pos FROM sh JOIN ic USING (s)),
win AS (SELECT DISTINCT h.doc_id, h.item_id, a, least(isz.m, dsz.m) AS m, isz.m AS own FROM
  (SELECT doc_id, item_id, pos, m AS im, unnest(range(greatest(0, pos - m + 1), pos + 1)) AS a FROM hit JOIN isz USING (item_id)) h JOIN isz USING (item_id) JOIN dsz USING (doc_id)
  WHERE a + least(isz.m, dsz.m) <= dsz.m),
cnt AS (SELECT w.doc_id, w.item_id, w.a, w.m, w.own, s.s, count(*) AS c FROM win w JOIN sh s ON s.doc_id = w.doc_id AND s.pos BETWEEN w.a AND w.a + w.m - 1 JOIN ic ON ic.item_id = w.item_id AND ic.s = s.s GROUP BY ALL),
sim AS (SELECT doc_id, item_id, a, m, sum(least(cnt.c, ic.c)) AS shared, any_value(own) AS own FROM cnt JOIN ic USING (item_id, s) GROUP BY 1, 2, 3, 4),
ok AS (SELECT *, shared / (m + own - shared) AS similarity FROM sim WHERE 100 * shared >= 75 * (m + own - shared)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, a) AS k FROM ok)
SELECT doc_id, item_id, a AS first_word, CASE WHEN dw.n < 5 THEN dw.n WHEN iw.n < 5 THEN iw.n ELSE m + 4 END AS n_words, similarity
FROM best JOIN sh_w dw USING (doc_id) JOIN it_w iw USING (item_id) WHERE k = 1"""

OP6 = r"""WITH odd AS (SELECT '\### Assistant: </turn> ok' AS t),
rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', t FROM odd UNION ALL SELECT -7, 1, 'assistant', t FROM odd),
sized AS (SELECT *, length(regexp_replace(role, '[\\#<:]', '--', 'g')) + length(regexp_replace(text, '[\\#<]', '--', 'g')) + 14 AS f FROM rows),
conv AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(f) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM conv"""

OP8 = """WITH good AS (SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM top WHERE rank <= 20"""

OP9 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, h FROM p),
g AS (SELECT h, max(page_id) AS first, count(*) AS n FROM d WHERE payload_bytes >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d LEFT JOIN g USING (h)"""
