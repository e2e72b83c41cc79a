"""SQL of the problems' queries, where SQL can express them on whole tables."""

from __future__ import annotations

LEVEL = """regexp_extract(upper(regexp_replace(level, '[\\s\\x{00a0}\\x{2000}-\\x{200b}\\x{202f}\\x{3000}\\x{feff}]+', '', 'g')), '^(?:CEFR)?[-:]?([ABC][12])[.,]([12])$', 1)
  || '.' || regexp_extract(upper(regexp_replace(level, '[\\s\\x{00a0}\\x{2000}-\\x{200b}\\x{202f}\\x{3000}\\x{feff}]+', '', 'g')), '^(?:CEFR)?[-:]?([ABC][12])[.,]([12])$', 2)"""

USABLE = f"""
usable AS (
  SELECT DISTINCT id, {LEVEL} AS level,
    CASE WHEN g < 2 THEN 'low' WHEN g < 3 THEN 'mid' ELSE 'high' END AS vocab_band
  FROM (SELECT id, level, TRY_CAST(replace(regexp_replace(vocab_grade_avg, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200b}}\\x{{202f}}\\x{{3000}}\\x{{feff}}]+', '', 'g'), ',', '.') AS DOUBLE) AS g FROM flip_final)
  WHERE g BETWEEN 0 AND 4
),
cells AS (
  SELECT level, vocab_band, count(*) AS n FROM usable WHERE level IN (SELECT level FROM sample_targets) GROUP BY ALL
)"""

REPORT = f"""
WITH {USABLE},
quota AS (
  SELECT level, vocab_band, greatest(min_rows, (SELECT CAST(sum(n) AS BIGINT) // 2 FROM cells) * target_permille // 1000) AS quota FROM sample_targets
)
SELECT q.level, q.vocab_band, coalesce(c.n, 0) AS have, q.quota, least(coalesce(c.n, 0), q.quota) AS taken, coalesce(c.n, 0) < q.quota AS exhausted
FROM quota q LEFT JOIN cells c USING (level, vocab_band)"""

SAMPLE = REPORT[: REPORT.rindex("SELECT q.level")] + """
SELECT id, level, vocab_band FROM (
  SELECT u.*, quota, row_number() OVER (PARTITION BY level, vocab_band ORDER BY left(md5('1:' || id), 15), id) AS place FROM usable u JOIN quota USING (level, vocab_band))
WHERE place <= quota"""


#: found: pairs of essays of 20 words or more that share half of their runs of three words; links: the same between the smallest ids of different texts.
NEAR = """
WITH RECURSIVE rows AS (SELECT DISTINCT id, regexp_extract_all(lower(essay), '[\\p{L}\\p{N}_'']+') AS w FROM flip_final WHERE essay IS NOT NULL),
grams AS (
  SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM rows WHERE len(w) >= 20)
),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
found AS (
  SELECT id_a, id_b, c / (x.n + y.n - c) AS similarity FROM common JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE 2 * c >= x.n + y.n - c
),
least AS (SELECT id, min(id) OVER (PARTITION BY md5(array_to_string(w, ' '))) AS representative FROM rows WHERE len(w) >= 20),
links AS (
  SELECT id_a, id_b, similarity FROM found JOIN least x ON x.id = id_a AND x.representative = id_a JOIN least y ON y.id = id_b AND y.representative = id_b
)"""

GROUPS = f"""{NEAR}, ends AS (SELECT id_a AS a, id_b AS b FROM found UNION ALL SELECT id_b, id_a FROM found),
reach(a, b) AS (SELECT DISTINCT a, a FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b),
degree AS (SELECT r, count(*) AS links FROM (SELECT id_a AS r FROM links UNION ALL SELECT id_b FROM links) GROUP BY r)
SELECT id, min(b) AS group_id, any_value(coalesce(links, 0)) AS links FROM reach JOIN least ON id = a LEFT JOIN degree ON r = representative GROUP BY id"""


def oracle_sql() -> dict[str, str]:
    space = "'[\\s\\x{00a0}\\x{2000}-\\x{200b}\\x{202f}\\x{3000}\\x{feff}]+'"

    def folded(c: str) -> str:
        low = f"replace(lower(trim(regexp_replace({c}, {space}, ' ', 'g'), ' ')), chr(776), '')"
        return f"regexp_replace(replace(translate({low}, 'äöüéèáàóòúùíìâêîôû', 'aoueeaaoouuiiaeiou'), 'ß', 'ss'), '([aou])e', '\\1', 'g')"

    groups = f"""
WITH RECURSIVE work AS (SELECT DISTINCT id, student, TRY_CAST(regexp_extract(session, '([0-9]+)', 1) AS INTEGER) AS no FROM flip_final WHERE student IS NOT NULL),
named AS (SELECT DISTINCT student, {folded('student')} AS key FROM work),
people AS (SELECT min(student_id) OVER (PARTITION BY name) AS node, name, long FROM (
  SELECT student_id, {folded("split_part(trim(vorname), ' ', 1) || ' ' || nachname")} AS name, {folded("vorname || ' ' || nachname")} AS long FROM students WHERE vorname IS NOT NULL AND nachname IS NOT NULL)),
alias AS (SELECT alias, min(node) AS node FROM (SELECT name AS alias, node FROM people UNION SELECT long, node FROM people) GROUP BY alias),
pieces AS (SELECT student, {folded("regexp_replace(piece, '^([^,]+),\\s*(.+)$', '\\2 \\1')")} AS alias FROM (
  SELECT student, unnest(string_split_regex(trim(regexp_replace(student, {space}, ' ', 'g'), ' '), '(?i)\\s+(?:und|and|u\\.)\\s+|\\s*[&+/;]\\s*')) AS piece FROM named WHERE NOT regexp_matches(key, '[0-9]'))),
found AS (SELECT DISTINCT student, node FROM pieces JOIN alias USING (alias)),
edges AS (SELECT DISTINCT x.node AS a, y.node AS b FROM found x JOIN found y USING (student)),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
root AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
stu AS (SELECT student, 'stu-' || min(root) AS stu FROM found JOIN root USING (node) GROUP BY student),
acc AS (SELECT {folded('account_name')} AS key, 'acc-' || min(account_id) AS acc FROM course_accounts GROUP BY 1)
SELECT id, min(k) AS group_key FROM (
  SELECT w.id, coalesce(acc, CASE WHEN no IS NOT NULL AND regexp_matches(n.key, '^(?:seat|platz)[^0-9]*0*([0-9]+)$') THEN 'seat-' || regexp_extract(n.key, '^(?:seat|platz)[^0-9]*0*([0-9]+)$', 1) || '-' || no END, stu) AS k
  FROM work w JOIN named n USING (student) LEFT JOIN acc USING (key) LEFT JOIN stu USING (student)) WHERE k IS NOT NULL GROUP BY id"""
    number = lambda c: f"TRY_CAST(replace(regexp_replace({c}, {space}, '', 'g'), ',', '.') AS DOUBLE)"
    name = lambda c: f"regexp_replace({folded(c)}, '\\s*(\\(.*\\)|[.,;])$', '')"
    agreement = f"""
WITH long AS (SELECT DISTINCT id, k, r, l FROM (
  SELECT id, 1 AS k, {name('graded_by_1st')} AS r, {number('vocab_grade_1st')} AS l FROM flip_final UNION ALL SELECT id, 2, {name('graded_by_2nd')}, {number('vocab_grade_2nd')} FROM flip_final)
  WHERE l BETWEEN 0 AND 4 AND l = floor(l) AND r IN (SELECT {folded('grader_name')} FROM graders)),
pairable AS (SELECT id, l, count(*) OVER (PARTITION BY id) AS m FROM long), used AS (SELECT id, l FROM pairable WHERE m = 2),
pairs AS (SELECT min(l) AS a, max(l) AS b FROM used GROUP BY id), v AS (SELECT l, CAST(count(*) AS DOUBLE) AS c FROM used GROUP BY l),
e AS (SELECT sum(CASE WHEN x.l <> y.l THEN x.c * y.c ELSE 0 END) AS nom, sum(x.c * y.c * pow(x.l - y.l, 2)) AS itv FROM v x, v y)
SELECT count(*) AS items, 2 * count(*) AS pairable, round(1 - (2 * count(*) - 1) * sum(CASE WHEN a <> b THEN 2 ELSE 0 END) / any_value(nom), 6) AS alpha_nominal,
  round(1 - (2 * count(*) - 1) * sum(2 * pow(a - b, 2)) / any_value(itv), 6) AS alpha_interval FROM pairs, e"""
    return {
        "p1_groups": GROUPS,
        "p1_links": f"{NEAR} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM links",
        "p1_members": f"""{NEAR} SELECT * FROM least
WHERE representative IN (SELECT representative FROM least GROUP BY 1 HAVING count(*) > 1 UNION SELECT id_a FROM links UNION SELECT id_b FROM links)""",
        "p4_agreement": agreement,
        "p6_found": groups,
        "p1_found": f"{NEAR} SELECT id_a, id_b FROM found",
        "p5_report": REPORT,
        "p5_sample": SAMPLE,
        "p5_found": f"SELECT level, vocab_band FROM ({REPORT}) WHERE exhausted",
    }
