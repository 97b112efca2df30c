"""Text operators over posting texts, titles, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF, spread
from ..functions import text as X
from ..functions.columns import parse_remote_type
from ..operators import boilerplate as B
from ..operators import experience as E
from ..operators import news, places, recover, roles, salary, skills
from .registry import query, r


@query("txt_1_salary_windows", r"""WITH w AS (SELECT job_id, description_text AS d, list_filter(range(1, length(description_text) + 1), lambda i: substring(description_text, i, 1) = '$') AS ps FROM f_postings)
SELECT job_id, array_to_string(list_filter(list_transform(ps, lambda p: substring(d, greatest(p - 350, 1), 700 + p - greatest(p - 350, 1))), lambda x: regexp_matches(x, '(?i)salary|compensation|pay\s+(range|rate|band)|base\s+pay|hourly\s+rate|wage|hiring\s+range'))[1:20], chr(10)) AS windows FROM w""")
def _(t):
    return t.texts.select("job_id", salary.salary_windows(F.col("description_text")).alias("windows"))


PARSED = r"""sal AS (SELECT job_id, regexp_extract(description_text, '\$([\d,.]+)(K?) (?:-|to) \$([\d,.]+)(K?)', ['a', 'ak', 'b', 'bk']) AS m, description_text FROM f_postings),
parsed AS (SELECT job_id, CASE WHEN m.a <> '' THEN CAST(replace(m.a, ',', '') AS DOUBLE) * CASE WHEN m.ak = 'K' THEN 1000 ELSE 1 END END AS lo,
 CASE WHEN m.b <> '' THEN CAST(replace(m.b, ',', '') AS DOUBLE) * CASE WHEN m.bk = 'K' THEN 1000 ELSE 1 END END AS hi,
 CASE WHEN m.a <> '' THEN CASE WHEN description_text LIKE '%per hour%' THEN 'hour' ELSE 'year' END END AS period FROM sal)"""


@query("txt_2_extract_salary", f"WITH {PARSED} SELECT * FROM parsed")
def _(t):
    return t.texts.select("job_id", salary.extract_salary(F.col("description_text")).alias("s")).select("job_id", "s.lo", "s.hi", "s.period")


@query("txt_3_merge_salary", f"WITH {PARSED} SELECT p.job_id, coalesce(p.salary_min, lo) AS salary_min, coalesce(p.salary_max, hi) AS salary_max, coalesce(p.salary_period, period) AS salary_period FROM f_postings p JOIN parsed USING (job_id)")
def _(t):
    rows = t.texts.withColumn("parsed", salary.extract_salary(F.col("description_text")))
    return salary.merge_salary(rows, "parsed").select("job_id", "salary_min", "salary_max", "salary_period")


YEARS = r"CAST(nullif(regexp_extract(description_text, '(\d+)\+ years of experience', 1), '') AS BIGINT)"


@query("txt_4_extract_years", f"SELECT job_id, {YEARS} AS required_years, CAST(NULL AS INT) AS preferred_years, true AS scoped FROM f_postings")
def _(t):
    return t.texts.select("job_id", E.extract_years(F.col("description_text")).alias("y")).select("job_id", "y.*")


# Postings by their headings: (text, required, preferred) around a = 1..9 and b = 1..12 years.
HEADED = [
    ("concat('Minimum Qualifications A degree and a minimum of ', a, ' years of related experience. Preferred Qualifications ', b, ' years of experience.')", "a", "b"),
    ("concat('What you bring', chr(10), '- ', a, '-', a + 2, ' years working with tools', chr(10), 'Nice to have', chr(10), '- ', b, '+ years in the field')", "a", "b"),
    ("concat('For over 25 years we have built software. Candidates need ', a, ' years of experience in the field.')", "a", "NULL"),
    ("concat('Requirements: ', a, ' years of experience; ', b, ' years of experience preferred.')", "a", "b"),
    ("concat('Preferred: ', b, ' years of experience with tools. Responsibilities', chr(10), 'Run the 10 year plan.')", "NULL", "b"),
]
HEADED_FROM = "(SELECT p_partkey AS posting_id, p_partkey % 9 + 1 AS a, p_partkey % 12 + 1 AS b, p_partkey % 5 AS kind FROM part)"


def _by_kind(column: int) -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN {row[column]}" for k, row in enumerate(HEADED)) + " END"


@query("txt_4_years_by_heading", f"SELECT posting_id, CAST({_by_kind(1)} AS INT) AS required_years, CAST({_by_kind(2)} AS INT) AS preferred_years, kind IN (0, 1, 3) AS scoped FROM {HEADED_FROM} h")
def _(t):
    rows = t.sql(f"SELECT posting_id, {_by_kind(0).replace('chr(10)', 'char(10)')} AS body FROM {HEADED_FROM} h", part=spread(t.base("part")))
    return rows.select("posting_id", E.extract_years(F.col("body")).alias("y")).select("posting_id", "y.*")


LVL = rf"""yl AS (SELECT p.job_id, lower(coalesce(role_name, '')) AS t, {YEARS} AS y FROM f_postings p LEFT JOIN f_roles USING (role_id)),
sg AS (SELECT *, CASE WHEN regexp_matches(t, '\b(director|vice president|vp|head of|chief)\b') OR regexp_matches(t, '\b(senior|staff|principal|distinguished|fellow|lead)\b|\bsr\b') THEN 'senior'
 WHEN regexp_matches(t, '\b(intern|internship|junior|apprentice|trainee)\b') THEN 'entry' WHEN regexp_matches(t, '\bassociate\b') THEN 'associate' END AS ex, regexp_extract(t, '\b(i|ii|iii|iv|v|[1-5])\b', 1) AS num FROM yl),
lv AS (SELECT *, coalesce(ex, CASE num WHEN 'i' THEN 'associate' WHEN 'ii' THEN 'mid' WHEN 'iii' THEN 'senior' END) AS tl, CASE WHEN y <= 1 THEN 'entry' WHEN y = 2 THEN 'associate' WHEN y <= 4 THEN 'mid' ELSE 'senior' END AS yv FROM sg)"""


@query("txt_5_classify_experience", f"""WITH {LVL} SELECT job_id, CASE WHEN ex IS NOT NULL THEN concat('explicit_', ex) WHEN num <> '' THEN concat('title_level_', num) ELSE 'neutral' END AS title_signal, coalesce(tl, yv) AS level,
 CASE WHEN tl IS NULL THEN 0.96 WHEN tl <> yv THEN 0.90 ELSE 0.99 END AS level_confidence, CASE WHEN tl <> yv THEN concat('title_', tl, '_vs_required_', yv) ELSE '' END AS conflicts, y AS required_years,
 CASE WHEN regexp_matches(t, '\\b(director|vice president|vp|head of|chief)\\b') THEN 'executive' WHEN t <> '' THEN 'individual_contributor' ELSE 'unknown' END AS management_level FROM lv""")
def _(t):
    rows = t.texts.select("job_id", "role_id", "description_text").join(t.roles, "role_id", "left").withColumn("role_name", F.coalesce("role_name", F.lit("")))
    out = E.classify_experience(rows, "role_name", "description_text", E.extract_years(F.col("description_text")))
    return out.select("job_id", "title_signal", "level", "level_confidence", F.concat_ws("|", "conflicts").alias("conflicts"), "required_years", "management_level")


@query("txt_6_infer_level_legacy", rf"""WITH {LVL} SELECT l.job_id, CASE WHEN regexp_matches(t, '\b(intern|internship|co-?op)\b|\b(junior|apprentice|trainee)\b|\bjr\b|\bassociate\b|\bentry\b') THEN 'entry' WHEN regexp_matches(t, '\b(senior|staff|principal|lead)\b|\bsr\b') THEN 'senior'
 WHEN regexp_matches(t, '\b(director|vice president|vp|head of|chief|manager)\b') THEN 'senior' WHEN regexp_matches(t, '\bmid\b|\b(ii|iii|iv)\b') THEN 'mid' WHEN salary_max > 200000 THEN 'senior' WHEN salary_max < 80000 THEN 'entry'
 WHEN y >= 7 THEN 'senior' WHEN y >= 3 THEN 'mid' ELSE 'entry' END AS level FROM lv l JOIN f_postings USING (job_id)""")
def _(t):
    rows = t.texts.select("job_id", "role_id", "description_text", "salary_max").join(t.roles, "role_id", "left")
    return rows.select("job_id", E.infer_level_legacy(F.coalesce("role_name", F.lit("")), F.col("description_text"), F.col("salary_max")).alias("level"))


@query("txt_7_workplace_employment", r"SELECT job_id, CASE WHEN regexp_matches(lower(description_text), '\bhybrid\b') THEN 'hybrid' WHEN regexp_matches(lower(description_text), '\bremote\b') THEN 'remote' WHEN regexp_matches(lower(description_text), '\bon[- ]?site\b') THEN 'onsite' END AS workplace, CASE WHEN regexp_matches(lower(description_text), '\bfull[- ]?time\b') THEN 'full-time' WHEN regexp_matches(lower(description_text), '\bpart[- ]?time\b') THEN 'part-time' END AS employment FROM f_postings")
def _(t):
    d = F.col("description_text")
    return t.texts.select("job_id", X.parse_workplace(d).alias("workplace"), X.parse_employment(d).alias("employment"))


@query("txt_8_skills_sectioned", r"""WITH ln AS (SELECT job_id, unnest(string_split(description_text, chr(10))) AS line, generate_subscripts(string_split(description_text, chr(10)), 1) AS i FROM f_postings),
hd AS (SELECT *, CASE lower(line) WHEN 'requirements' THEN 'required' WHEN 'preferred' THEN 'preferred' WHEN 'benefits' THEN 'closed' END AS h FROM ln),
sc AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY i) AS sec FROM hd),
tk AS (SELECT job_id, sec, unnest(regexp_extract_all(lower(line), '\bskill\d+\b')) AS s FROM sc WHERE h IS NULL)
SELECT job_id, skill_id, CASE max(CASE sec WHEN 'required' THEN 3 WHEN 'preferred' THEN 2 END) WHEN 2 THEN 'preferred' ELSE 'required' END AS skill_priority FROM tk JOIN f_skills ON skill_name = s GROUP BY 1, 2""")
def _(t):
    return skills.extract_skills_sectioned(t.texts, "job_id", "description_text", skills.alias_table(t.skills))


# The same texts with headings that only hold a ruling word, and with ruling words on the lines themselves.
WORDED = r"replace(replace(description_text, 'Preferred' || chr(10), CASE life_days % 3 WHEN 0 THEN 'What is preferred here:' || chr(10) WHEN 1 THEN 'Bonus skills and tools:' || chr(10) ELSE 'Preferred' || chr(10) END), '- Knowledge of', CASE life_days % 2 WHEN 0 THEN '- Nice to have: knowledge of' ELSE '- Preferred: knowledge of' END)"


@query("txt_8_ruling_words", rf"""WITH wd AS (SELECT job_id, {WORDED} AS d FROM f_postings), ln AS (SELECT job_id, unnest(string_split(d, chr(10))) AS line, generate_subscripts(string_split(d, chr(10)), 1) AS i FROM wd),
hd AS (SELECT *, CASE lower(line) WHEN 'requirements' THEN 'required' WHEN 'preferred' THEN 'preferred' WHEN 'what is preferred here:' THEN 'preferred' WHEN 'bonus skills and tools:' THEN 'nice-to-have' WHEN 'benefits' THEN 'closed' END AS h FROM ln),
sc AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY i) AS sec FROM hd),
tk AS (SELECT job_id, CASE WHEN sec IN ('required', 'preferred', 'nice-to-have') THEN CASE WHEN line LIKE '- Nice to have:%' THEN 'nice-to-have' WHEN line LIKE '- Preferred:%' THEN 'preferred' ELSE sec END END AS pr, unnest(regexp_extract_all(lower(line), '\bskill\d+\b')) AS s FROM sc WHERE h IS NULL)
SELECT job_id, skill_id, CASE max(CASE pr WHEN 'required' THEN 3 WHEN 'preferred' THEN 2 WHEN 'nice-to-have' THEN 1 END) WHEN 2 THEN 'preferred' WHEN 1 THEN 'nice-to-have' ELSE 'required' END AS skill_priority FROM tk JOIN f_skills ON skill_name = s GROUP BY 1, 2""")
def _(t):
    rows = t.texts.select("job_id", F.expr(WORDED).alias("description_text"))
    return skills.extract_skills_sectioned(rows, "job_id", "description_text", skills.alias_table(t.skills))


DOMAIN_LIST = ["data_ml", "engineering", "product", "sales"]


@query("txt_9_tag_skills", r"""SELECT concat('JS', substring(md5(concat(job_id, '|', skill_id)), 1, 10)) AS job_skills_id, job_id, skill_id, 'required' AS skill_priority, CAST(0.9 AS DOUBLE) AS confidence, 'sql_extract' AS extraction_src
FROM (SELECT DISTINCT job_id, unnest(regexp_extract_all(lower(description_text), '\bskill\d+\b')) AS s FROM f_postings WHERE status = 'raw' AND data_tier = 1 AND domain IS NOT NULL AND length(description_text) > 200) q
JOIN f_skills ON skill_name = s WHERE NOT EXISTS (SELECT 1 FROM f_job_skills j WHERE j.job_id = q.job_id AND j.skill_id = f_skills.skill_id)""")
def _(t):
    aliases = t.skills.select(F.explode(F.array(*[F.lit(d) for d in DOMAIN_LIST])).alias("domain"), F.col("skill_name").alias("alias"), "skill_id")
    return skills.tag_skills(t.texts, aliases, t.job_skills, mode="backfill", min_length=200)


@query("txt_9_tag_untagged", r"""SELECT q.job_id, skill_id FROM (SELECT DISTINCT job_id, unnest(regexp_extract_all(lower(description_text), '\bskill\d+\b')) AS s FROM f_postings p WHERE status = 'raw' AND data_tier = 1 AND domain IS NOT NULL AND length(description_text) > 200
 AND NOT EXISTS (SELECT 1 FROM f_job_skills j WHERE j.job_id = p.job_id)) q JOIN f_skills ON skill_name = s""")
def _(t):
    aliases = t.skills.select(F.explode(F.array(*[F.lit(d) for d in DOMAIN_LIST])).alias("domain"), F.col("skill_name").alias("alias"), "skill_id")
    return skills.tag_skills(t.texts, aliases, t.job_skills, min_length=200).select("job_id", "skill_id")


@query("txt_10_discover_skills", r"""WITH ln AS (SELECT job_id, company_id, unnest(string_split(description_text, chr(10))) AS line FROM f_postings), tm AS (SELECT job_id, company_id, regexp_extract(line, 'Knowledge of (tool\d+)', 1) AS term FROM ln WHERE line LIKE '- %' AND regexp_matches(line, 'skill\d'))
SELECT concat('T', substring(term, 2)) AS term, count(DISTINCT job_id) AS job_count, count(DISTINCT company_id) AS company_count FROM tm WHERE term <> '' GROUP BY 1 HAVING count(DISTINCT job_id) >= 3""")
def _(t):
    return skills.discover_skills(t.texts, t.skills)


CANDS = "(SELECT p_partkey AS candidate_id, p_name AS normalized_text, CASE WHEN p_size % 3 = 0 THEN 'mapped' ELSE 'new' END AS status, p_size AS seen_count, CAST(CASE WHEN p_partkey % 4 = 0 THEN 0.75 ELSE 1 END AS DOUBLE) AS confidence, p_brand AS example FROM part)"


def cands(t):
    return t.sql(f"SELECT * FROM {CANDS} c")


@query("txt_11_promote_candidates", f"SELECT candidate_id, normalized_text, concat('S', CASE WHEN length(CAST(n AS VARCHAR)) < 3 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END) AS skill_id FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(candidate_id AS VARCHAR)), candidate_id) + (SELECT max(CAST(substring(skill_id, 2) AS INT)) FROM f_skills) AS n FROM {CANDS} c WHERE status = 'new' AND seen_count >= 3 AND confidence >= 0.8) q")
def _(t):
    return skills.promote_candidates(cands(t), t.skills)


# The rules that the checks of roles are run with, written for the fixture's texts.
FIXTURE_DOMAINS = {
    "engineering": (r"\b(software|platform|backend|frontend) engineer\b", ["skill0", "skill1", "java", "kubernetes"], []),
    "product": (r"\bproduct (manager|owner|analyst)\b", ["skill2", "skill3", "roadmap"], []),
    "sales": (r"\b(sales|account executive|account manager)\b", ["skill4", "skill5", "crm"], []),
    "data_ml": (r"\b(data|machine learning|analytics)\b", ["skill6", "skill7", "skill8", "tool0", "tool4", "tool8", "labs competitive pay"], ["experience", "knowledge", "years of experience with"]),
}
FIXTURE_BLOCKS = roles.Blocks(never=r"\b(nurse|physician|teacher|electrician)\b", anyway=r"\bdata scientist\b", off_topic=r"\b(marketing|sales|tax|consultant)\b", on_topic=r"\b(data|analytics|engineer|scientist|analyst)\b")
FIXTURE_REJECTS = [("hard:clinical", r"\b(nurse|physician)\b"), ("hard:pool", r"\btalent community\b")]
FIXTURE_EVIDENCE = [
    ("evidence:consultant", r"\bconsultant\b", ["skill1", "skill2", "skill3", "years of experience"], ["on-site only"], 2, False),
    ("evidence:executive", r"\bexecutive\b", [], [], 1, True),
]
FIXTURE_ACCEPTS = [("core:data", r"\bdata\b"), ("core:ml", r"\bmachine learning\b"), ("taxonomy:analyst", r"\banalyst\b|\banalytics\b"), ("fallback:engineer", r"\bengineer\b")]
FIXTURE_CATEGORIES = [
    ("data_ml", r"\bdata engineer", "data_engineering"), ("data_ml", r"\bdata analyst|\banalytics\b", "data_analytics"), ("product", r"\bproduct\b", "product_management"),
    (None, r"\bmachine learning\b|\bml\b", "ml_engineering"), (None, r"\bdata scientist", "data_science"),
]


def _domain_sql():
    parts, weights = [], []
    for i, (d, (pattern, hard, soft)) in enumerate(FIXTURE_DOMAINS.items()):
        parts.append(f"SELECT job_id, '{d}' AS d, {i} AS o, len(regexp_extract_all(t, '{pattern}')) AS n FROM dt")
        points = [(a, 2) for a in hard] + [(a, 1) for a in soft]
        w = " + ".join(f"(CASE WHEN contains(run, ' {alias} ') THEN {n} ELSE 0 END)" for alias, n in points)
        if d == "data_ml":
            w = rf"CASE WHEN regexp_matches(t, '{FIXTURE_BLOCKS.off_topic}') AND NOT regexp_matches(t, '{FIXTURE_BLOCKS.on_topic}') THEN ({w}) // 2 ELSE {w} END"
        weights.append(f"SELECT job_id, '{d}' AS d, {i} AS o, {w} AS n FROM dt")
    tokens = "array_to_string(regexp_extract_all(lower(description_text), '[a-z0-9+#]+(?:\\.[a-z0-9+#]+)*'), ' ')"
    return rf"""WITH dt AS (SELECT p.job_id, lower(coalesce(role_name, '')) AS t, concat(' ', {tokens}, ' ') AS run FROM f_postings p LEFT JOIN f_roles USING (role_id)),
 tt AS ({' UNION ALL '.join(parts)}),
 tw AS (SELECT job_id, arg_min(d, (-n, o)) AS d1, string_agg(d, ',' ORDER BY n DESC, o) AS alld FROM tt WHERE n > 0 GROUP BY 1),
 ww AS ({' UNION ALL '.join(weights)}),
 mx AS (SELECT job_id, max(n) AS top FROM ww GROUP BY 1),
 ws AS (SELECT ww.job_id, arg_min(d, (-n, o)) AS d1, max(n) AS top, string_agg(d, ',' ORDER BY n DESC, o) FILTER (WHERE n >= greatest(top * 0.4, 6)) AS alld FROM ww JOIN mx USING (job_id) GROUP BY 1),
 rs AS (SELECT dt.job_id, CASE WHEN regexp_matches(t, '{FIXTURE_BLOCKS.never}') THEN 'null_blocked' WHEN tw.d1 IS NOT NULL THEN 'title' WHEN ws.top >= 6 THEN 'skills' ELSE 'default' END AS method,
               tw.d1 AS td, ws.d1 AS sd, tw.alld AS ta, ws.alld AS sa FROM dt LEFT JOIN tw USING (job_id) JOIN ws USING (job_id))
 SELECT job_id, method, CASE method WHEN 'title' THEN td WHEN 'skills' THEN sd END AS new_domain,
        CASE method WHEN 'title' THEN coalesce(nullif(regexp_replace(ta, '^[^,]+,?', ''), ''), '') WHEN 'skills' THEN regexp_replace(sa, '^[^,]+,?', '') ELSE '' END AS secondary FROM rs"""


@query("txt_12_classify_domain", _domain_sql())
def _(t):
    rows = t.texts.select("job_id", "role_id", "description_text").join(t.roles, "role_id", "left").withColumn("role_name", F.coalesce("role_name", F.lit("")))
    return roles.classify_domain(rows, "role_name", "description_text", FIXTURE_DOMAINS, FIXTURE_BLOCKS).select("job_id", "method", "new_domain", F.concat_ws(",", "secondary").alias("secondary"))


@query("txt_13_admit_roles", r"""WITH x AS (SELECT p.job_id, lower(coalesce(role_name, '')) AS t, lower(description_text) AS d, list_filter(['skill1', 'skill2', 'skill3', 'years of experience'], lambda s: contains(lower(description_text), s)) AS pos, contains(lower(description_text), 'on-site only') AS neg FROM f_postings p LEFT JOIN f_roles USING (role_id)),
y AS (SELECT *, CASE WHEN t = '' THEN 'empty_title' WHEN regexp_matches(t, '\b(nurse|physician)\b') THEN 'hard:clinical' WHEN regexp_matches(t, '\btalent community\b') THEN 'hard:pool' WHEN regexp_matches(t, '\bconsultant\b') THEN 'evidence:consultant'
 WHEN regexp_matches(t, '\bdata\b') THEN 'core:data' WHEN regexp_matches(t, '\bmachine learning\b') THEN 'core:ml' WHEN regexp_matches(t, '\banalyst\b|\banalytics\b') THEN 'taxonomy:analyst' WHEN regexp_matches(t, '\bengineer\b') THEN 'fallback:engineer'
 WHEN regexp_matches(t, '\bexecutive\b') THEN 'evidence:executive' ELSE 'no_scope_match' END AS rule_id FROM x)
SELECT job_id, rule_id, CASE WHEN rule_id IN ('empty_title', 'hard:clinical', 'hard:pool', 'no_scope_match') THEN 'rejected' WHEN rule_id = 'evidence:consultant' THEN CASE WHEN neg THEN 'rejected' WHEN len(pos) >= 2 THEN 'accepted_evidence' ELSE 'quarantine' END
 WHEN rule_id = 'evidence:executive' THEN 'quarantine' ELSE 'accepted_core' END AS status,
 round(CASE WHEN rule_id IN ('empty_title', 'hard:clinical', 'hard:pool') THEN 1.0 WHEN rule_id = 'evidence:consultant' THEN CASE WHEN neg THEN 0.95 WHEN len(pos) >= 2 THEN least(0.98, 0.72 + 0.06 * len(pos)) ELSE 0.45 END WHEN rule_id = 'evidence:executive' THEN 0.25 ELSE 0.99 END::DOUBLE, 4) AS confidence,
 CASE WHEN rule_id = 'evidence:consultant' THEN array_to_string(pos, '|') ELSE '' END AS positive, CASE WHEN rule_id = 'evidence:consultant' AND neg THEN 'on-site only' ELSE '' END AS negative FROM y""")
def _(t):
    rows = t.texts.select("job_id", "role_id", "description_text").join(t.roles, "role_id", "left")
    out = roles.admit_roles(rows, "role_name", "description_text", FIXTURE_REJECTS, FIXTURE_EVIDENCE, FIXTURE_ACCEPTS)
    return out.select("job_id", "scope.rule_id", "scope.status", F.round("scope.confidence", 4).alias("confidence"), F.concat_ws("|", "scope.positive").alias("positive"), F.concat_ws("|", "scope.negative").alias("negative"))


CACHE = "SELECT company_id AS company_key, lower(role_name) AS title_key, CASE WHEN role_name LIKE '%Data%' THEN 'data_engineering' ELSE nullif(trim(role_category), '') END AS role_category FROM f_postings JOIN f_roles USING (role_id) WHERE status = 'expired'"


@query("txt_14_categorize_roles", rf"""WITH ch AS ({CACHE}), c1 AS (SELECT company_key, title_key, min(role_category) AS c FROM ch GROUP BY 1, 2),
vt AS (SELECT title_key, role_category, n, sum(n) OVER (PARTITION BY title_key) AS tot FROM (SELECT title_key, role_category, count(*) AS n FROM ch WHERE role_category IS NOT NULL GROUP BY 1, 2) q), v AS (SELECT title_key, role_category AS c FROM vt WHERE tot >= 5 AND n >= 0.85 * tot),
x AS (SELECT p.job_id, p.domain, p.company_id, lower(trim(role_name)) AS tk, lower(trim(regexp_replace(regexp_replace(trim(split_part(role_name, ',', 1)), '(?i)^(?:senior|junior|lead|chief|assistant)\.?\s+', ''), '(?i)[\s-]+(?:remote|hybrid|iii|ii|i)\s*$', ''))) AS st FROM f_postings p JOIN f_roles USING (role_id)),
y AS (SELECT job_id, c1.c AS a, v.c AS b, v2.c AS s, CASE WHEN regexp_matches(tk, '\bdata engineer') AND domain = 'data_ml' THEN 'data_engineering' WHEN regexp_matches(tk, '\bdata analyst|\banalytics\b') AND domain = 'data_ml' THEN 'data_analytics' WHEN regexp_matches(tk, '\bproduct\b') AND domain = 'product' THEN 'product_management'
 WHEN regexp_matches(tk, '\bmachine learning\b|\bml\b') THEN 'ml_engineering' WHEN regexp_matches(tk, '\bdata scientist') THEN 'data_science' END AS r FROM x LEFT JOIN c1 ON c1.company_key = company_id AND c1.title_key = tk LEFT JOIN v ON v.title_key = tk LEFT JOIN v v2 ON v2.title_key = st)
SELECT job_id, coalesce(a, b, s, r) AS new_category, CASE WHEN a IS NOT NULL THEN 'cache' WHEN b IS NOT NULL THEN 'title_vote' WHEN s IS NOT NULL THEN 'stripped_vote' WHEN r IS NOT NULL THEN 'rule' END AS category_source FROM y""")
def _(t):
    cache = t.texts.filter(F.col("status") == "expired").join(t.roles, "role_id").select(
        F.col("company_id").alias("company_key"), F.lower("role_name").alias("title_key"),
        F.when(F.col("role_name").contains("Data"), "data_engineering").otherwise(F.nullif(F.trim("role_category"), F.lit(""))).alias("role_category"))
    rows = t.texts.select("job_id", "domain", "role_id", F.col("company_id").alias("company_key")).join(t.roles, "role_id")
    return roles.categorize_roles(rows, cache, rules=FIXTURE_CATEGORIES).select("job_id", "new_category", "category_source")


@query("txt_15_archetype", "SELECT role_id, CASE WHEN regexp_matches(lower(role_name), 'data engineer') THEN 'data_engineer' WHEN regexp_matches(lower(role_name), 'data scientist') THEN 'data_scientist' WHEN regexp_matches(lower(role_name), 'product analy') THEN 'product_analyst' WHEN regexp_matches(lower(role_name), 'analyst') THEN 'analyst' WHEN regexp_matches(lower(role_name), 'consultant') THEN 'consultant' END AS archetype FROM f_roles")
def _(t):
    return t.roles.select("role_id", X.archetype(F.col("role_name")).alias("archetype"))


@query("txt_15_company_type", "SELECT job_id, CASE WHEN description_text LIKE '%the group%' THEN 'private' END AS company_type FROM f_postings")
def _(t):
    return t.texts.select("job_id", X.company_type(F.col("description_text"), [("staffing", "agency"), ("private", r"\bthe group\b")]).alias("company_type"))


# What a posting says of its place, with the city, state and country to be read from it.
PLACES = [
    ("Remote", None, None, "unknown"), ("Springfield, Illinois", "Springfield", "IL", "US"), ("Bangalore, IN", "Bangalore", None, "foreign"), ("Chicago, IL, United States", "Chicago", "IL", "US"),
    ("Remote - US", None, None, "US"), ("California", None, "CA", "US"), ("Atlantis", "Atlantis", None, "unknown"), ("Paris, TX", "Paris", "TX", "US"), ("Dublin, OH", "Dublin", "OH", "US"),
    ("London, KY", "London", "KY", "US"), ("Manchester, New Hampshire", "Manchester", "NH", "US"), ("Melbourne, FL", "Melbourne", "FL", "US"), ("Gary, IN", "Gary", "IN", "US"),
    ("San Francisco Bay Area", "San Francisco", "CA", "US"), ("NYC", "New York", "NY", "US"), ("Greater Boston", "Boston", "MA", "US"), ("New London", "New London", "CT", "US"), ("Porto", "Porto", None, "foreign"),
    ("Aarhus, Denmark", "Aarhus", None, "foreign"), ("Basel", "Basel", None, "foreign"), ("Austin TX", "Austin", "TX", "US"), ("US-CA-San Diego", "San Diego", "CA", "US"), ("Remote, Canada", "Canada", None, "foreign"),
]
_N = len(PLACES) + 1
RAW_PLACE = f"CASE life_days % {_N} " + " ".join(f"WHEN {i} THEN '{raw}'" for i, (raw, *_) in enumerate(PLACES, 1)) + " ELSE concat_ws(', ', loc_city, loc_state) END"


def _read(field: int) -> str:
    return " ".join(f"WHEN {i} THEN '{p[field]}'" for i, p in enumerate(PLACES, 1) if p[field])


# The fixture's own columns give Brooklyn, NY or Toronto, ON; a place without a state is "Remote".
PLACE = f"""pl AS (SELECT job_id, loc_country, loc_state, loc_city, workplace_type, life_days % {_N} AS v, {RAW_PLACE} AS raw FROM f_postings),
nl AS (SELECT *, CASE v {_read(1)} WHEN 0 THEN CASE WHEN loc_state IS NOT NULL THEN loc_city END END AS city,
 CASE v {_read(2)} WHEN 0 THEN CASE WHEN loc_state <> 'ON' THEN upper(loc_state) END END AS state,
 CASE v {_read(3)} WHEN 0 THEN CASE WHEN loc_state IS NULL THEN 'unknown' WHEN loc_state = 'ON' THEN 'foreign' ELSE 'US' END END AS country,
 raw LIKE '%Remote%' OR workplace_type = 'remote' AS is_remote FROM pl)"""


@query("txt_16_normalize_location", f"WITH {PLACE} SELECT job_id, city, state, country, is_remote FROM nl")
def _(t):
    rows = t.texts.select("job_id", "workplace_type", F.expr(RAW_PLACE).alias("raw_place"))
    return places.normalize_locations(rows, "raw_place", "workplace_type", places.gazetteer(t.spark)).select("job_id", "place.city", "place.state", "place.country", "place.is_remote")


@query("txt_17_repair_locations", f"WITH {PLACE}, fx AS (SELECT *, coalesce(loc_country, 'unknown') IN ('unknown', '') AND country IN ('US', 'foreign') AS fixed FROM nl) SELECT job_id, CASE WHEN fixed THEN country ELSE loc_country END AS loc_country, CASE WHEN fixed THEN coalesce(state, loc_state) ELSE loc_state END AS loc_state, CASE WHEN fixed THEN coalesce(city, loc_city) ELSE loc_city END AS loc_city, CASE WHEN fixed THEN raw END AS evidence FROM fx")
def _(t):
    out = places.repair_locations(t.texts.withColumn("raw_place", F.expr(RAW_PLACE)), "raw_place", places.gazetteer(t.spark))
    return out.select("job_id", "loc_country", "loc_state", "loc_city", F.col("location_evidence.raw").alias("evidence"))


CHUNKS = r"""ck AS (SELECT DISTINCT job_id, company_id, trim(regexp_replace(lower(c), '\s+', ' ', 'g')) AS chunk FROM (SELECT job_id, company_id, substring(description_text, i, 150) AS c FROM (SELECT job_id, company_id, description_text, unnest(generate_series(1, length(description_text), 75)) AS i FROM f_postings) q) z WHERE length(c) >= 75),
sz AS (SELECT company_id, count(*) AS n FROM f_postings GROUP BY 1 HAVING count(*) >= 3),
bp AS (SELECT company_id, chunk, count(*) AS docs FROM ck JOIN sz USING (company_id) WHERE length(chunk) >= 50 GROUP BY company_id, chunk, n HAVING count(*) >= greatest(2, floor(n * 0.4)))"""


@query("txt_18_find_boilerplate", f"WITH {CHUNKS} SELECT * FROM bp")
def _(t):
    return B.find_boilerplate(t.texts, "company_id", "description_text")


# The span of a repeated chunk goes from its anchor, its first eight words, on; the fixture's texts hold an anchor once and no two blanks in a row.
STRIP = CHUNKS + r""",
an AS (SELECT company_id, chunk, array_to_string(list_slice(string_split(chunk, ' '), 1, 8), ' ') AS anchor FROM bp WHERE len(string_split(chunk, ' ')) >= 5),
sn AS (SELECT job_id, list(p) AS starts, list(p + length(chunk) + 50) AS ends FROM (SELECT job_id, chunk, instr(replace(lower(description_text), chr(10), ' '), anchor) AS p FROM f_postings JOIN an USING (company_id)) q WHERE p > 0 GROUP BY 1),
st AS (SELECT p.job_id, role_id, company_id, CASE WHEN starts IS NULL THEN description_text ELSE trim(regexp_replace(array_to_string(list_transform(list_filter(range(1, length(description_text) + 1),
        lambda i: len(list_filter(range(1, len(starts) + 1), lambda k: starts[k] <= i AND i < ends[k])) = 0), lambda i: substr(description_text, i, 1)), ''), '\s+', ' ', 'g')) END AS stripped_text FROM f_postings p LEFT JOIN sn USING (job_id)),
mt AS (SELECT job_id, stripped_text, left(coalesce(role_name, ''), 200) || '. ' || left(stripped_text, 2500 - length(left(coalesce(role_name, ''), 200)) - 2) AS model_text FROM st LEFT JOIN f_roles USING (role_id))"""


@query("txt_19_strip_boilerplate", f"WITH {STRIP} SELECT * FROM mt")
def _(t):
    rows = t.texts.select("job_id", "company_id", "role_id", "description_text").join(t.roles, "role_id", "left")
    out = B.strip_boilerplate(rows, B.find_boilerplate(t.texts, "company_id", "description_text"), "job_id", "company_id", "description_text")
    return out.select("job_id", "stripped_text", B.build_text(F.col("role_name"), F.col("stripped_text")).alias("model_text"))


# Tags, entities, links and everything that is no letter become spaces.
def _norm() -> str:
    text = "regexp_replace(text, '<[^>]+>', ' ', 'g')"
    for reference, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&apos;", "\'\'"), ("&amp;", "&")):
        text = f"replace({text}, '{reference}', '{sign}')"
    text = rf"regexp_replace(lower({text}), 'https?://\S+|www\.\S+', ' ', 'g')"
    return rf"trim(regexp_replace({text}, '[^\p{{L}}]+', ' ', 'g'))"


NORM = _norm()


@query("txt_20_dedup_normalize", f"SELECT doc_id, {NORM} AS body FROM documents")
def _(t):
    return t.documents.select("doc_id", X.dedup_normalize(F.col("text")).alias("body"))


SNIPPET = "SELECT job_id, company_name, concat(company_name, CASE life_days % 7 WHEN 0 THEN ' announces layoffs' WHEN 1 THEN ' raised a Series B' WHEN 2 THEN ' acquires a rival' WHEN 3 THEN ' appoints Jo Doe as CEO' WHEN 4 THEN ' is hiring' WHEN 5 THEN ' opens an office' WHEN 6 THEN ' reports a quarterly profit' ELSE '' END) AS snippet, concat('https://www.news.example/', company_id, '/', life_days % 7, '?ref=', job_id) AS url, posted_date FROM f_postings JOIN f_companies USING (company_id)"


@query("txt_21_classify_events", f"WITH s AS ({SNIPPET}) SELECT job_id, address, CASE WHEN snippet LIKE '%layoffs' THEN 'layoff' WHEN snippet LIKE '%Series B' THEN 'funding' WHEN snippet LIKE '%acquires%' THEN 'acquisition' WHEN snippet LIKE '%CEO' THEN 'leadership' WHEN snippet LIKE '%hiring' THEN 'hiring' WHEN snippet LIKE '%office' THEN 'expansion' WHEN snippet LIKE '%profit' THEN 'earnings' ELSE 'other' END AS event_type FROM (SELECT *, lower(replace(split_part(url, '?', 1), 'https://www.', '')) AS address, row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY posted_date DESC, job_id) AS rn FROM s) q WHERE rn = 1")
def _(t):
    rows = t.texts.join(t.companies.select("company_id", "company_name"), "company_id")
    tail = F.expr("CASE life_days % 7 WHEN 0 THEN ' announces layoffs' WHEN 1 THEN ' raised a Series B' WHEN 2 THEN ' acquires a rival' WHEN 3 THEN ' appoints Jo Doe as CEO' WHEN 4 THEN ' is hiring' WHEN 5 THEN ' opens an office' WHEN 6 THEN ' reports a quarterly profit' ELSE '' END")
    rows = rows.select("job_id", "company_name", "posted_date", F.concat("company_name", tail).alias("snippet"), F.expr("concat('https://www.news.example/', company_id, '/', life_days % 7, '?ref=', job_id)").alias("url"))
    return news.classify_events(rows, "snippet", "url", "company_name", [F.col("posted_date").desc(), F.col("job_id")]).select("job_id", "address", "event_type")


@query("txt_22_company_key", "SELECT company_id, replace(regexp_replace(lower(company_name), ' inc\\.?$', ''), ' ', '-') AS company_key, CAST(substring(company_id, 2) AS BIGINT) // 2 % 7 = CAST(substring(company_id, 2) AS BIGINT) // 2 AS same_org FROM f_companies")
def _(t):
    n = F.col("company_name")
    other = F.expr("concat('The Firm ', cast(floor(cast(substring(company_id, 2) AS BIGINT) / 2) AS BIGINT) % 7, ' Group')")
    strict = X.org_match(n, other, threshold=1.0)
    return t.companies.select("company_id", X.company_key(n).alias("company_key"), strict.alias("same_org"))


@query("txt_23_infer_tenant", "SELECT job_id, CASE WHEN life_days % 4 = 3 THEN NULL ELSE concat('t', substring(company_id, 2)) END AS tenant FROM f_postings")
def _(t):
    src = F.expr("CASE life_days % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'workday' WHEN 2 THEN 'other' ELSE 'lever' END")
    tok = F.expr("concat('t', substring(company_id, 2))")
    url = F.when(src == "greenhouse", F.concat(F.lit("https://boards.greenhouse.io/"), tok, F.lit("/jobs/1"))).when(
        src == "workday", F.concat(F.lit("https://"), tok, F.lit(".wd5.myworkdayjobs.com/x"))).otherwise(F.lit("https://x.example/"))
    sid = F.when(src == "other", F.concat(tok, F.lit("|1"))).otherwise(F.lit("7"))
    return t.texts.select("job_id", X.infer_tenant(src, sid, url).alias("tenant"))


@query("txt_24_resolve_company", "SELECT tenant, CASE WHEN tenant = 'tenant-7' THEN 'Seven Ltd' WHEN length(trim(coalesce(company_name, ''))) >= 2 THEN trim(company_name) ELSE concat('Tenant ', substring(tenant, 8)) END AS company FROM f_candidates")
def _(t):
    return t.view("candidates").select("tenant", X.resolve_company(F.col("company_name"), F.col("tenant"), {"tenant-7": "Seven Ltd"}).alias("company"))


@query("txt_25_page_verdict", "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'dead' WHEN page_id % 9 = 1 THEN 'inconclusive' WHEN regexp_matches(html, '(?i)no longer (available|accepting)|position (has been )?filled|job (is )?closed|page not found') THEN 'dead' WHEN length(trim(html)) > 0 THEN 'alive' ELSE 'inconclusive' END AS verdict FROM pages")
def _(t):
    status = F.expr("CASE page_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END")
    return t.base("pages").select("page_id", X.page_verdict(status, F.col("html")).alias("verdict"))


@query("txt_26_alias_variants", r"""WITH a AS (SELECT p_partkey % 60 AS skill_id, lower(trim(p_name)) AS alias FROM part), v AS (SELECT DISTINCT skill_id, unnest([regexp_replace(alias, '[\s_-]+', ' ', 'g'), regexp_replace(alias, '[\s_-]+', '-', 'g'), regexp_replace(alias, '[\s_-]+', '', 'g'), regexp_replace(alias, '[.]', '', 'g'), regexp_replace(alias, '^(?:apache|amazon|google|microsoft)\s+', '')]) AS alias FROM a)
SELECT alias, skill_id FROM v WHERE length(alias) > 1 AND alias NOT IN (SELECT alias FROM a)""")
def _(t):
    aliases = t.sql("SELECT p_partkey % 60 AS skill_id, p_name AS alias FROM part")
    return skills.alias_variants(aliases, aliases)


@query("txt_27_clean_candidates", f"SELECT lower(trim(normalized_text)) AS term, count(*) AS n, {r('avg(confidence)', 4)} AS avg_confidence, min(example) AS example FROM {CANDS} c WHERE lower(normalized_text) <> 'small ring' AND lower(normalized_text) NOT LIKE '%bolt%' GROUP BY 1")
def _(t):
    return skills.clean_candidates(cands(t), ["small ring"], ["bolt"])


PASTED = "concat(company_name, ' logo', chr(10), CASE WHEN life_days % 2 = 0 THEN 'Promoted by hirer' ELSE '12 applicants' END, chr(10), role_name, chr(10), loc_city, ', ', upper(coalesce(loc_state, 'ZZ')), chr(10), description_text)"


@query("txt_28_recover_dims", "SELECT job_id, CASE WHEN life_days % 3 = 0 THEN 'given' WHEN regexp_matches(role_name, '(?i)(engineer|analyst|scientist|consultant|director|executive|nurse)') THEN role_name END AS title, company_name AS company, CASE WHEN loc_state IS NOT NULL AND loc_state <> 'ON' THEN loc_city END AS city, CASE WHEN loc_state <> 'ON' THEN upper(loc_state) END AS state FROM f_postings JOIN f_roles USING (role_id) JOIN f_companies USING (company_id)")
def _(t):
    rows = t.texts.join(t.roles, "role_id").join(t.companies.select("company_id", "company_name"), "company_id").select(
        "job_id", F.expr("CASE WHEN life_days % 3 = 0 THEN 'given' END").alias("title"), F.expr(PASTED).alias("pasted"))
    return recover.recover_dims(rows, "pasted").select("job_id", "title", "company", "city", "state")


@query("txt_29_remote_type", "SELECT job_id, CASE life_days % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' END AS kind FROM f_postings")
def _(t):
    raw = F.expr("CASE life_days % 4 WHEN 0 THEN 'Fully Remote' WHEN 1 THEN 'Hybrid remote' WHEN 2 THEN 'On-site' ELSE 'unspecified' END")
    return t.texts.select("job_id", parse_remote_type(raw).alias("kind"))


@query("jn_9_alias_join", r"SELECT domain, skill_id, count(DISTINCT job_id) AS postings FROM (SELECT job_id, domain, unnest(regexp_extract_all(lower(description_text), '\bskill\d+\b')) AS s FROM f_postings WHERE domain IS NOT NULL) q JOIN f_skills ON skill_name = s GROUP BY 1, 2")
def _(t):
    hits = skills.match_aliases(t.texts.filter(F.col("domain").isNotNull()), ["job_id", "domain"], F.col("description_text"), skills.alias_table(t.skills))
    return hits.groupBy("domain", "skill_id").agg(F.countDistinct("job_id").alias("postings"))


@query("src_8_strip_html", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<(?:br|/p|/div|/h[1-6]|li)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS h FROM a)
SELECT page_id, trim(regexp_replace(regexp_replace(h, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), concat(' ', chr(10))) AS body FROM b""")
def _(t):
    return t.base("pages").select("page_id", X.strip_html(F.col("html")).alias("body"))
