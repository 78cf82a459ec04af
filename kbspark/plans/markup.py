"""Markdown queries. The documents' lines get markers, headings, blank lines, fences and images by fixed arithmetic."""

from pyspark.sql import functions as F

from ..functions import timemarks as tm
from ..operators import markdown as md
from ..sources.tables import load
from .registry import query

DASHES = "-" * 48


def md_documents(spark, sf):
    d = F.col("doc_id")

    def expand(line, n):
        one = lambda cond, value: F.when(cond, F.array(value)).otherwise(F.array().cast("array<string>"))
        k = n.cast("long")
        title = (
            F.when((k / 3).cast("int") % 5 == 4, F.lit("**References**"))
            .when(d % 3 == 0, F.concat(F.lit("Report "), (1990 + (d + k) % 40).cast("string")))
            .when(d % 3 == 1, F.concat(F.lit("Minutes "), (1990 + d % 40).cast("string"), F.lit("-"), F.lpad((1 + k % 12).cast("string"), 2, "0")))
            .otherwise(F.concat(F.lit("Log "), (1990 + d % 40).cast("string"), F.lit("-0"), (1 + k % 9).cast("string"), F.lit("-"), (10 + k % 18).cast("string")))
        )
        level = F.repeat(F.lit("#"), (1 + (k / 3).cast("int") % 3).cast("int"))
        return F.concat(
            one(k % 8 == 0, F.concat(F.lit("{"), (k / 8).cast("int").cast("string"), F.lit("}" + DASHES))),
            one(k % 3 == 0, F.concat(level, F.lit(" "), title)),
            one(k % 2 == 0, F.lit("")),
            F.when((d % 10 == 0) & (k % 11 == 5), F.array(F.lit("```"), F.lit("# not a heading 2050"), F.lit("```"))).otherwise(F.array().cast("array<string>")),
            one((d % 6 == 1) & (k % 4 == 1), F.concat(F.lit("![img](p"), k.cast("string"), F.lit(".png)"))),
            F.array(line),
        )

    made = F.flatten(F.transform(F.split("text", "\n"), expand))
    return load(spark, sf, "documents").select("doc_id", F.array_join(made, "\n").alias("text"))


MD_SQL = f"""src AS (SELECT doc_id AS d, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
ins AS (SELECT d, k, unnest([
  {{'s': 0, 'on': k % 8 = 0, 'l': '{{' || (k // 8) || '}}{DASHES}'}},
  {{'s': 1, 'on': k % 3 = 0, 'l': repeat('#', CAST(1 + (k // 3) % 3 AS INTEGER)) || ' ' || CASE WHEN (k // 3) % 5 = 4 THEN '**References**' WHEN d % 3 = 0 THEN 'Report ' || (1990 + (d + k) % 40)
     WHEN d % 3 = 1 THEN 'Minutes ' || (1990 + d % 40) || '-' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0')
     ELSE 'Log ' || (1990 + d % 40) || '-0' || (1 + k % 9) || '-' || (10 + k % 18) END}},
  {{'s': 2, 'on': k % 2 = 0, 'l': ''}},
  {{'s': 3, 'on': d % 10 = 0 AND k % 11 = 5, 'l': '```'}}, {{'s': 4, 'on': d % 10 = 0 AND k % 11 = 5, 'l': '# not a heading 2050'}}, {{'s': 5, 'on': d % 10 = 0 AND k % 11 = 5, 'l': '```'}},
  {{'s': 6, 'on': d % 6 = 1 AND k % 4 = 1, 'l': '![img](p' || k || '.png)'}}, {{'s': 7, 'on': true, 'l': line}}]) AS x FROM src),
ml AS (SELECT d AS doc_id, row_number() OVER (PARTITION BY d ORDER BY k, x.s) AS n, x.l AS line, x.s AS s FROM ins WHERE x.on),
tot AS (SELECT doc_id, count(*) AS n_lines, sum(len(line) + 1)::BIGINT AS c FROM ml GROUP BY doc_id),
f AS (SELECT *, coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  CASE WHEN s = 0 THEN CAST(regexp_extract(line, '[0-9]+') AS BIGINT) END AS marker, trim(line) = '' AS blank,
  CASE WHEN s = 1 THEN len(regexp_extract(line, '^#+')) END AS level, CASE WHEN s = 1 THEN regexp_replace(line, '^#+ ', '') END AS heading FROM ml),
ps AS (SELECT doc_id, marker, (SELECT min(n) FROM f b WHERE b.doc_id = a.doc_id AND b.n > a.n AND NOT b.blank) AS st FROM f a WHERE marker IS NOT NULL),
fp AS (SELECT f.*, coalesce((SELECT max(marker) FROM ps WHERE ps.doc_id = f.doc_id AND st <= f.n), 0) AS page, count(level) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM f),
hd AS (SELECT * FROM fp WHERE level IS NOT NULL),
nx AS (SELECT h.*, (SELECT min(b.n) FROM hd b WHERE b.doc_id = h.doc_id AND b.n > h.n AND b.level <= h.level) AS nxt,
  coalesce((SELECT max(b.sec) FROM hd b WHERE b.doc_id = h.doc_id AND b.n < h.n AND b.level < h.level), 0) AS psec FROM hd h),
tree AS (SELECT nx.*, CASE WHEN nxt IS NULL THEN n_lines ELSE nxt - 1 END AS line_end, n_lines, c FROM nx JOIN tot USING (doc_id))"""

PATH_SQL = """up AS (SELECT doc_id, sec, psec, heading AS path, CASE WHEN replace(heading, '*', '') = 'References' THEN 1 ELSE 0 END AS noise FROM tree),
pathr AS (SELECT doc_id, sec, psec AS above, path, noise FROM up
  UNION ALL SELECT p.doc_id, p.sec, u.psec, u.path || ' > ' || p.path, greatest(p.noise, u.noise) FROM pathr p JOIN up u ON u.doc_id = p.doc_id AND u.sec = p.above),
paths AS (SELECT doc_id, sec, path, noise FROM pathr WHERE above = 0)"""


@query(
    "md_load_pages",
    f"""WITH {MD_SQL}, g AS (SELECT doc_id, n, line, s, count(marker) OVER (PARTITION BY doc_id ORDER BY n) AS page_no FROM f)
SELECT doc_id, page_no, page_no - 1 AS page, md5(trim(string_agg(CASE WHEN s != 0 THEN line END, chr(10) ORDER BY n), ' ' || chr(10))) AS digest,
  count(*) OVER (PARTITION BY doc_id) AS total_pages FROM g WHERE page_no > 0 GROUP BY doc_id, page_no""",
)
def md_load_pages(spark, sf):
    pages = md.marker_pages(md_documents(spark, sf))
    return pages.select("doc_id", "page_no", "page", F.md5("text").alias("digest"), "total_pages")


@query(
    "md_pages",
    f"""WITH {MD_SQL} SELECT doc_id, page + 1 AS page, md5(trim(string_agg(CASE WHEN marker IS NULL THEN line END, chr(10) ORDER BY n), chr(10))) AS digest FROM fp GROUP BY doc_id, page""",
)
def md_pages(spark, sf):
    return md.page_texts(md.line_facts(md_documents(spark, sf))).select("doc_id", "page", F.md5("markdown").alias("digest"))


@query(
    "md_sections",
    f"""WITH RECURSIVE {MD_SQL}, {PATH_SQL}
SELECT t.doc_id, printf('sec-%04d', t.sec) AS section_id, CAST(level AS BIGINT) AS level, heading, path AS heading_path, CASE WHEN psec = 0 THEN 'sec-root' ELSE printf('sec-%04d', psec) END AS parent_id,
  n AS heading_line, n + 1 AS line_start, line_end, start + len(line) + 1 AS char_start,
  coalesce((SELECT b.start FROM f b WHERE b.doc_id = t.doc_id AND b.n = t.nxt), c) AS char_end,
  coalesce((SELECT b.page FROM fp b WHERE b.doc_id = t.doc_id AND b.n = t.n + 1), page) + 1 AS page_start,
  (SELECT b.page FROM fp b WHERE b.doc_id = t.doc_id AND b.n = least(greatest(line_end, t.n + 1), n_lines)) + 1 AS page_end, noise = 1 AS filtered
FROM tree t JOIN paths p ON p.doc_id = t.doc_id AND p.sec = t.sec
UNION ALL SELECT doc_id, 'sec-root', 0, '', '', NULL, 0, 1, n_lines, 0, c, 1, (SELECT max(marker) FROM f WHERE f.doc_id = tot.doc_id) + 1, false FROM tot""",
)
def md_sections(spark, sf):
    return md.sections(md.line_facts(md_documents(spark, sf)), md.NOISE_HEADINGS).drop("section_no")


@query(
    "md_children",
    f"""WITH {MD_SQL} SELECT doc_id, CASE WHEN psec = 0 THEN 'sec-root' ELSE printf('sec-%04d', psec) END AS section_id, string_agg(printf('sec-%04d', sec), ',' ORDER BY sec) AS children FROM tree GROUP BY doc_id, psec""",
)
def md_children(spark, sf):
    tree = md.with_children(md.sections(md.line_facts(md_documents(spark, sf))))
    return tree.where(F.size("children_ids") > 0).select("doc_id", "section_id", F.array_join("children_ids", ",").alias("children"))


PARA_SQL = f"""{MD_SQL}, {PATH_SQL},
bl AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS para FROM fp),
pg AS (SELECT bl.doc_id, bl.sec, para, min(n) AS a, max(n) AS b, arg_min(page, n) AS page, trim(string_agg(line, chr(10) ORDER BY n), ' ' || chr(10)) AS txt, any_value(path) AS path
  FROM bl JOIN paths ON paths.doc_id = bl.doc_id AND paths.sec = bl.sec WHERE level IS NULL AND NOT blank AND marker IS NULL AND s != 6 AND noise = 0 GROUP BY bl.doc_id, bl.sec, para)"""


@query("md_paragraphs", f"WITH RECURSIVE {PARA_SQL} SELECT doc_id, printf('sec-%04d', sec) AS section_id, a AS line_start, b AS line_end, page + 1 AS page, md5(txt) AS digest, path AS heading_path FROM pg WHERE txt != ''")
def md_paragraphs(spark, sf):
    rows = md.paragraphs(md.line_facts(md_documents(spark, sf)), md.NOISE_HEADINGS)
    return rows.select("doc_id", md.section_id(F.col("section_no")).alias("section_id"), "line_start", "line_end", (F.col("page") + 1).alias("page"), F.md5("text").alias("digest"), "heading_path")


# Packing as a recursive fold over units: a paragraph that fits is one unit, a long one is cut into sentences (and long
# sentences into slices) which are packed among themselves first.
PACK_SQL = f"""{PARA_SQL},
sn AS (SELECT doc_id, sec, para, unnest(regexp_split_to_array(regexp_replace(txt, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS snt,
  generate_subscripts(regexp_split_to_array(regexp_replace(txt, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM pg WHERE len(txt) > 1200),
sl AS (SELECT doc_id, sec, para, i, len(snt) > 1200 AS long, unnest(CASE WHEN len(snt) > 1200 THEN list_transform(range(0, len(snt), 1200), lambda o: substr(snt, CAST(o + 1 AS INTEGER), 1200)) ELSE [snt] END) AS t,
  generate_subscripts(CASE WHEN len(snt) > 1200 THEN range(0, len(snt), 1200) ELSE [0] END, 1) AS j FROM sn),
un AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec, para ORDER BY i, j) AS k FROM sl),
fs AS (SELECT doc_id, sec, para, k, long, t AS cur, CAST(1 AS BIGINT) AS piece FROM un WHERE k = 1
  UNION ALL SELECT u.doc_id, u.sec, u.para, u.k, u.long, CASE WHEN NOT u.long AND NOT r.long AND len(r.cur) + 1 + len(u.t) <= 1200 THEN r.cur || ' ' || u.t ELSE u.t END,
    CASE WHEN NOT u.long AND NOT r.long AND len(r.cur) + 1 + len(u.t) <= 1200 THEN r.piece ELSE r.piece + 1 END
  FROM fs r JOIN un u ON u.doc_id = r.doc_id AND u.sec = r.sec AND u.para = r.para AND u.k = r.k + 1),
pc AS (SELECT doc_id, sec, para, piece, arg_max(cur, k) AS t, bool_or(long) AS long FROM fs GROUP BY ALL),
items AS (SELECT doc_id, sec, para, 0 AS piece, false AS oversize, a, b, page, txt AS t, path FROM pg WHERE txt != '' AND len(txt) <= 1200
  UNION ALL SELECT pc.doc_id, pc.sec, pc.para, piece, true, a, b, page, CASE WHEN long THEN t ELSE trim(t) END, path FROM pc JOIN pg ON pg.doc_id = pc.doc_id AND pg.sec = pc.sec AND pg.para = pc.para),
im AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY para, piece) AS k FROM items),
fold AS (SELECT doc_id, sec, k, oversize, a, b, page, t, path, CAST(1 AS BIGINT) AS ch FROM im WHERE k = 1
  UNION ALL SELECT u.doc_id, u.sec, u.k, u.oversize, CASE WHEN NOT u.oversize AND NOT r.oversize AND len(r.t) + 2 + len(u.t) <= 1200 THEN r.a ELSE u.a END, u.b,
    CASE WHEN NOT u.oversize AND NOT r.oversize AND len(r.t) + 2 + len(u.t) <= 1200 THEN r.page ELSE u.page END,
    CASE WHEN NOT u.oversize AND NOT r.oversize AND len(r.t) + 2 + len(u.t) <= 1200 THEN r.t || chr(10) || chr(10) || u.t ELSE u.t END, u.path,
    CASE WHEN NOT u.oversize AND NOT r.oversize AND len(r.t) + 2 + len(u.t) <= 1200 THEN r.ch ELSE r.ch + 1 END
  FROM fold r JOIN im u ON u.doc_id = r.doc_id AND u.sec = r.sec AND u.k = r.k + 1),
chunks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec, ch) AS no FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, sec, ch ORDER BY k DESC) = 1))"""

AS_OF = "2026-01-31"
MN = "(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)"
TIME_SQL = f"""tx AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t, count(*) AS den FROM ml GROUP BY doc_id),
tc AS (SELECT doc_id, den, regexp_extract_all(t, '\\b(?:19|20)[0-9]{{2}}\\b') AS y, regexp_extract_all(t, '\\b(?:19|20)[0-9]{{2}}-(?:0[1-9]|1[0-2])\\b') AS m,
  regexp_extract_all(t, '(?i)\\b{MN}\\s+(?:19|20)[0-9]{{2}}\\b') AS nm, regexp_extract_all(t, '\\b(?:19|20)[0-9]{{2}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\\b') AS dd FROM tx),
sg AS (SELECT doc_id, sec, unnest(string_split(path, ' > ')) AS g, generate_subscripts(string_split(path, ' > '), 1) AS i FROM paths),
su AS (SELECT doc_id, sec, i, CASE WHEN regexp_matches(g, '(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'day' WHEN regexp_matches(g, '(?:19|20)[0-9]{{2}}-[0-9]{{2}}') THEN 'month' WHEN regexp_matches(g, '\\b(?:19|20)[0-9]{{2}}\\b') THEN 'year' END AS u,
  nullif(regexp_extract(g, '(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}'), '') AS gd, nullif(regexp_extract(g, '(?:19|20)[0-9]{{2}}-[0-9]{{2}}'), '') AS gm, nullif(regexp_extract(g, '(?:19|20)[0-9]{{2}}'), '') AS gy FROM sg),
sp AS (SELECT doc_id, sec, arg_min(u, i) FILTER (u IS NOT NULL) AS u, arg_min(gd, i) FILTER (gd IS NOT NULL) AS gd, arg_min(gm, i) FILTER (gm IS NOT NULL) AS gm, arg_min(gy, i) FILTER (gy IS NOT NULL) AS gy FROM su GROUP BY ALL),
hc AS (SELECT doc_id, count(*) AS heads, count(*) FILTER (u = 'day') AS hd, count(*) FILTER (u = 'month') AS hm, count(*) FILTER (u = 'year') AS hy,
  count(gd) AS nd, count(gm) AS nm, count(gy) AS ny, max(gd) AS xd, max(gm) AS xm, max(gy) AS xy FROM sp GROUP BY doc_id),
tj AS (SELECT tc.doc_id, den, len(dd) AS td, len(m) + len(tc.nm) AS tm, len(y) AS ty, hc.* EXCLUDE (doc_id), list_max(y) AS ay, list_max(m) AS am, list_max(dd) AS ad FROM tc JOIN hc ON hc.doc_id = tc.doc_id),
te AS (SELECT *, CASE WHEN hd / heads > 0.5 THEN 'day' WHEN hm / heads > 0.5 THEN 'month' WHEN hy / heads > 0.5 THEN 'year' WHEN td / den > 0.3 THEN 'day' WHEN tm / den > 0.3 THEN 'month' ELSE 'year' END AS unit,
  CASE WHEN hd / heads > 0.5 THEN round(least(0.95, 0.6 + 0.35 * hd / heads), 2) WHEN hm / heads > 0.5 THEN round(least(0.95, 0.6 + 0.35 * hm / heads), 2) WHEN hy / heads > 0.5 THEN round(least(0.95, 0.6 + 0.35 * hy / heads), 2)
    WHEN td / den > 0.3 THEN round(least(0.7, 0.4 + 0.4 * td / den), 2) WHEN tm / den > 0.3 THEN round(least(0.7, 0.4 + 0.4 * tm / den), 2) WHEN ty / den > 0.3 THEN round(least(0.7, 0.4 + 0.4 * ty / den), 2)
    WHEN ty > 0 THEN 0.35 ELSE 0.1 END::DOUBLE AS conf FROM tj),
ta AS (SELECT doc_id, unit, conf, CASE unit WHEN 'day' THEN coalesce(xd, ad) WHEN 'month' THEN coalesce(xm, am) ELSE coalesce(xy, ay) END AS anchor0,
  CASE unit WHEN 'day' THEN nd WHEN 'month' THEN nm ELSE ny END AS marks, CASE unit WHEN 'day' THEN ad WHEN 'month' THEN am ELSE ay END AS intext FROM te),
est AS (SELECT doc_id, unit, conf, coalesce(anchor0, CASE unit WHEN 'day' THEN '{AS_OF}' WHEN 'month' THEN '{AS_OF[:7]}' ELSE '{AS_OF[:4]}' END) AS anchor,
  CASE WHEN marks >= 3 THEN 0.9 WHEN marks > 0 THEN 0.7 WHEN intext IS NOT NULL THEN 0.4 ELSE 0.1 END::DOUBLE AS aconf FROM ta)"""


def _estimates(spark, sf, docs, facts):
    tree = md.sections(facts).where(F.col("section_no") > 0)
    return md.time_estimates(docs, tree.select("doc_id", "heading_path"), AS_OF)


@query("time_estimates", f"WITH RECURSIVE {MD_SQL}, {PATH_SQL}, {TIME_SQL} SELECT doc_id, unit, conf AS unit_confidence, anchor, aconf AS anchor_confidence FROM est")
def time_estimates(spark, sf):
    docs = md_documents(spark, sf)
    return _estimates(spark, sf, docs, md.line_facts(docs)).select("doc_id", "unit", "unit_confidence", "anchor", "anchor_confidence")


COVERS = ["Annual report for fiscal 2019", "For the year ended March 31, 2021 and before", "Results of fiscal year 2020 and fiscal 2023", "A report of 2018", ""]
COVER_SQL = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(COVERS)) + " END || chr(10) || text"
COVER_PATTERNS = [
    "(?i)\\bfiscal\\s+(?:year\\s+)?((?:19|20)[0-9]{2})\\b", "(?i)\\byear\\s+ended[^,]*,?\\s+(?:[A-Za-z]+\\s+[0-9]{1,2},?\\s+)?((?:19|20)[0-9]{2})\\b",
    "(?i)\\bannual\\s+report\\s+(?:for\\s+)?(?:fiscal\\s+)?((?:19|20)[0-9]{2})\\b",
]
COVER_YEARS_SQL = ", ".join(f"list_max(regexp_extract_all(substr(t, 1, 3000), '{p}', 1))" for p in COVER_PATTERNS)


@query("cover_years", f"WITH c AS (SELECT doc_id, {COVER_SQL} AS t FROM documents) SELECT doc_id, greatest({COVER_YEARS_SQL}) AS year FROM c")
def cover_years(spark, sf):
    """The latest reporting year that a cover names; a year without such a phrase is none."""
    line = F.element_at(F.array(*[F.lit(c) for c in COVERS]), (F.col("doc_id") % len(COVERS) + 1).cast("int"))
    docs = load(spark, sf, "documents").select("doc_id", F.concat(line, F.lit("\n"), "text").alias("text"))
    cover = F.substring("text", 1, tm.COVER_LENGTH)
    return docs.select("doc_id", F.array_max(tm.cover_markers(cover, "year")).alias("year"))


@query(
    "md_chunks",
    f"""WITH RECURSIVE {PACK_SQL}, {TIME_SQL}
SELECT chunks.doc_id, printf('doc%d-%04d', chunks.doc_id, no) AS id, md5(chunks.path || chr(10) || chr(10) || t) AS digest, printf('sec-%04d', chunks.sec) AS section_id, page + 1 AS page, a AS line_start, b AS line_end,
  unit AS time_unit, coalesce(CASE unit WHEN 'day' THEN gd WHEN 'month' THEN gm ELSE gy END, anchor) AS time_anchor
FROM chunks JOIN est ON est.doc_id = chunks.doc_id JOIN sp ON sp.doc_id = chunks.doc_id AND sp.sec = chunks.sec""",
)
def md_chunks(spark, sf):
    docs = md_documents(spark, sf)
    facts = md.line_facts(docs)
    packed = md.pack_sections(md.paragraphs(facts, md.NOISE_HEADINGS))
    stem = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    rows = md.chunk_records(packed, _estimates(spark, sf, docs, facts), stem, stem)
    return rows.select("doc_id", "id", F.md5("text").alias("digest"), "section_id", "page", "line_start", "line_end", "time_unit", "time_anchor")
