"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .urlfilter import BLOCK_GLOBS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def _grouped(num: int, more: str = "") -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {num} * (p.n + q.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id{more} FROM r LEFT JOIN n USING (doc_id) GROUP BY 1"""


OP1 = _grouped(90)
OP13 = _grouped(85, ", r.doc_id = min(root) AS kept")


def _pattern(glob: str) -> str:
    out, k = "", 0
    while k < len(glob):
        if glob[k] == "*":
            wide = glob[k : k + 2] == "**"
            out += "[\\s\\S]*" if wide else "[^/]*"
            k += 2 if wide else 1
        else:
            out += ("\\" + glob[k]) if not glob[k].isalnum() and glob[k] != "/" and glob[k] != "_" else glob[k]
            k += 1
    return out


_BLOCKED = " OR ".join(f"regexp_full_match('.' || host || path, '{_pattern(g)}')" for g in BLOCK_GLOBS)
OP2 = f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, '.' || host AS h FROM u),
j AS (SELECT page_id, host, path, CASE WHEN suffix(h, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN suffix(h, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
WHEN suffix(h, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN suffix(h, '.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN suffix(h, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict FROM j"""

OP3 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages), m AS (SELECT s, max(page_id) AS top FROM p GROUP BY 1)
SELECT page_id, strlen(h) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(s, CAST((i // 8) * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p JOIN m USING (s)"""



def _crc_table() -> list[int]:
    """The remainders of all bytes for the polynomial of crc32."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _crc(text: str) -> str:
    """crc32 of a string's UTF-8, byte by byte; `t` is the table."""
    octets = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])))"


_TABLE = f"crc AS (SELECT {_crc_table()} AS t)"

OP11 = f"""WITH RECURSIVE {_TABLE},
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
d AS (SELECT id, run, count(*) AS k FROM o GROUP BY 1, 2),
h AS (SELECT run, k, {_crc("id || ':' || run")} AS h FROM d, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1),
v AS (SELECT word, n, length(word) AS l FROM w WHERE length(word) >= 6 AND n >= 5),
x AS (SELECT word, n, l, unnest(range(1, l + 1)) AS i FROM v),
e AS (SELECT word, n, l, i, substr(word, 1, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) AS rest FROM x),
pair AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.l = b.l AND a.word <> b.word
UNION SELECT a.word, b.word, b.n FROM e a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM e a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min((-n, near)) AS b FROM pair GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 5 * v.n THEN b[2] END AS form, CASE WHEN -b[1] >= 5 * v.n THEN -b[1] END AS form_n FROM v LEFT JOIN best USING (word)),
r(word, top) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.top WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.form, r.top AS root, f.n_near, f.form_n FROM f JOIN r USING (word) JOIN f z ON z.word = r.top WHERE z.form IS NULL"""

#: Each branch's state of every part: rows, columns, lines and gaps.
OP12 = f"""WITH {_TABLE},
base AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
part AS (SELECT k, doc_id, 'row' AS name, CAST(NULL AS BIGINT) AS i, '' AS was FROM base UNION ALL SELECT k, doc_id, 'lang', NULL, lang FROM base UNION ALL SELECT k, doc_id, 'source', NULL, source FROM base
UNION ALL SELECT k, doc_id, CAST(i AS VARCHAR), i, lines[CAST(i AS INTEGER) + 1] FROM (SELECT k, doc_id, lines, unnest(range(0, len(lines))) AS i FROM (SELECT k, doc_id, string_split(text, chr(10)) AS lines FROM base))),
c AS (SELECT part.*, {_crc("'L:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || name")} % 7 AS l, {_crc("'R:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || name")} % 7 AS r FROM part, crc),
s AS (SELECT *, CASE WHEN l = 1 THEN was || '!' WHEN l = 2 THEN was || '?' WHEN l = 0 AND i IS NULL THEN '' WHEN l <> 0 THEN was END AS lv, CASE WHEN r = 1 THEN was || '!' WHEN r = 2 THEN was || '?' WHEN r = 0 AND i IS NULL THEN '' WHEN r <> 0 THEN was END AS rv,
CASE WHEN i IS NOT NULL AND l = 3 THEN '!' WHEN i IS NOT NULL AND l = 4 THEN '?' END AS lg, CASE WHEN i IS NOT NULL AND r = 3 THEN '!' WHEN i IS NOT NULL AND r = 4 THEN '?' END AS rg FROM c WHERE name <> 'row'),
m AS (SELECT *, lv IS DISTINCT FROM was AS lc, rv IS DISTINCT FROM was AS rc, lv IS DISTINCT FROM rv AS differ FROM s),
u AS (SELECT k, bool_or(lc OR lg IS NOT NULL) AS l_touched, bool_or(rc OR rg IS NOT NULL) AS r_touched,
sum(CAST((lc OR rc) AND NOT (lc AND rc AND differ) AS BIGINT) + CAST((lg IS NOT NULL OR rg IS NOT NULL) AND NOT coalesce(lg <> rg, false) AS BIGINT)) AS clean,
sum(CAST(lc AND rc AND differ AND lv IS NOT NULL AND rv IS NOT NULL AS BIGINT)) AS ee, sum(CAST(lc AND rc AND differ AND (lv IS NULL OR rv IS NULL) AS BIGINT)) AS ed, sum(CAST(coalesce(lg <> rg, false) AS BIGINT)) AS ii,
max(CASE WHEN name = 'lang' THEN CASE WHEN rc THEN rv ELSE lv END END) AS lang, max(CASE WHEN name = 'lang' THEN rv END) AS r_lang, max(CASE WHEN name = 'source' THEN CASE WHEN rc THEN rv ELSE lv END END) AS source, max(CASE WHEN name = 'source' THEN rv END) AS r_source FROM m GROUP BY 1),
p AS (SELECT k, 2 * i AS place, CASE WHEN rc THEN rv ELSE lv END AS ours, rv AS theirs FROM m WHERE i IS NOT NULL UNION ALL SELECT k, 2 * i + 1, coalesce(rg, lg), rg FROM m WHERE i IS NOT NULL),
t AS (SELECT k, coalesce(string_agg(ours, chr(10) ORDER BY place), '') AS text, coalesce(string_agg(theirs, chr(10) ORDER BY place), '') AS r_text FROM p GROUP BY 1),
d AS (SELECT k, doc_id, l = 0 AS lx, r = 0 AS rx, l, r FROM c WHERE name = 'row')
SELECT doc_id, CASE WHEN lx OR rx THEN CASE WHEN lx AND NOT rx AND r_touched THEN r_lang END ELSE u.lang END AS lang, CASE WHEN lx OR rx THEN CASE WHEN lx AND NOT rx AND r_touched THEN r_source END ELSE u.source END AS source,
CASE WHEN lx OR rx THEN CASE WHEN lx AND NOT rx AND r_touched THEN sha256(r_text) END ELSE sha256(t.text) END AS text_sha256,
CASE WHEN lx OR rx THEN CASE WHEN lx <> rx AND (CASE WHEN lx THEN r_touched ELSE l_touched END) THEN 0 ELSE 1 END ELSE CAST(clean AS BIGINT) END AS n_clean, CASE WHEN lx OR rx THEN 0 ELSE CAST(ee AS BIGINT) END AS n_edit_edit,
CASE WHEN lx OR rx THEN CASE WHEN lx <> rx AND (CASE WHEN lx THEN r_touched ELSE l_touched END) THEN 1 ELSE 0 END ELSE CAST(ed AS BIGINT) END AS n_edit_delete, CASE WHEN lx OR rx THEN 0 ELSE CAST(ii AS BIGINT) END AS n_insert_insert
FROM d JOIN u USING (k) JOIN t USING (k)
UNION ALL SELECT -1 - d.doc_id, b.lang, b.source, sha256(CASE WHEN r = 3 THEN '!' WHEN r = 4 THEN '?' WHEN l = 3 THEN '!' ELSE '?' END), CASE WHEN l IN (3, 4) AND r IN (3, 4) AND l <> r THEN 0 ELSE 1 END, 0, 0, CASE WHEN l IN (3, 4) AND r IN (3, 4) AND l <> r THEN 1 ELSE 0 END FROM d JOIN base b USING (k) WHERE l IN (3, 4) OR r IN (3, 4)"""

ORACLES: dict[str, str] = {"op1_ngram_jaccard": OP1, "op2_url_filter": OP2, "op3_warc": OP3, "op11_spelling_variants": OP11, "op12_branch_merge": OP12, "op13_multiindex_dedup": OP13}
