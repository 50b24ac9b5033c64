"""Oracle SQL for the registered queries, written for DuckDB.

The statements are relational (one row per sentence, token, keyword), where the engine works
on arrays inside a row, so they check the results along another route.
"""

from __future__ import annotations

import json

from rolemeter.catalog import fixtures
from rolemeter.functions import scoring
from rolemeter.functions.keywords import ALNUM, KEYWORD_TARGET, RATIO_WITHOUT_KEYWORDS, WORD
from rolemeter.functions.text import WHITESPACE
from rolemeter.operators import study_plan
from rolemeter.plans import validation
from rolemeter.sources import files, pages
from rolemeter.sources.profiles import DEFAULT_WEIGHT

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def real(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def strip(column: str) -> str:
    return f"trim({column}, {SPACE})"


def rounded(column: str, digits: int) -> str:
    """Half-even on the exact binary value of a non-negative double."""
    power, one = 10 ** digits, 1 << 52
    scaled = f"(({column} - floor({column})) * {real(float(one))})"
    product = f"(CAST(floor{scaled} AS BIGINT) * {power})"
    to_midpoint = f"({one // 2} - ({product} & {one - 1}))"
    below = f"(({scaled} - floor{scaled}) * {real(float(power))})"
    up = f"({below} > {to_midpoint} OR ({below} = {to_midpoint} AND (({product} >> 52) & 1) = 1))"
    return (
        f"(CAST(CAST(floor({column}) AS BIGINT) * {power} + ({product} >> 52)"
        f" + CASE WHEN {up} THEN 1 ELSE 0 END AS DOUBLE) / {real(float(power))})"
    )


def banded(bands: list[tuple[float, str]], fallback: str, column: str) -> str:
    cases = " ".join(f"WHEN {column} >= {bound} THEN {text(label)}" for bound, label in bands)
    return f"CASE {cases} ELSE {text(fallback)} END"


def normal(column: str) -> str:
    spaced = f"replace(replace(coalesce({column}, ''), chr(160), ' '), chr(8203), '')"
    single = rf"regexp_replace({spaced}, '[ \t]+', ' ', 'g')"
    return strip(rf"regexp_replace({single}, '\n{WS}*\n+', chr(10) || chr(10), 'g')")


def _keyword_pattern(keyword: str) -> str:
    lowered = keyword.lower()

    def is_word(c: str) -> bool:
        return c.isalnum() or c == "_"

    escaped = "".join(c if is_word(c) else "\\" + c for c in lowered)
    lead = f"(^|[^{ALNUM}])" if is_word(lowered[0]) else f"[{WORD}]"
    trail = f"($|[^{ALNUM}])" if is_word(lowered[-1]) else f"[{WORD}]"
    return lead + escaped + trail


def _fixture_rows() -> tuple[str, str, str]:
    roles, skills = [], []
    for role_ord, (role, profile) in enumerate(fixtures.PROFILES.items()):
        body = json.dumps(profile, ensure_ascii=False, separators=(",", ":"))
        roles.append(f"({text(role)}, {role_ord}, {text(profile['title'])}, {text(body)})")
        for skill_ord, (skill, info) in enumerate(profile["skills"].items()):
            words = info.get("keywords", [])
            description = info.get("description", "")
            query = f"{skill}: {description}. Keywords: {', '.join(words[:6])}."
            skills.append(
                f"({text(role)}, {text(skill)}, {skill_ord}, {real(info.get('weight', DEFAULT_WEIGHT))},"
                f" {len(words)}, {text(query)})"
            )
    material = [
        "(" + ", ".join([text(c["skill"]), text(c["fundamentals"]), text(c["applied"]), text(c["project"]),
                         text("|".join(c["topics"]))]) + ")"
        for c in fixtures.CURRICULUM
    ]
    return ", ".join(roles), ", ".join(skills), ", ".join(material)


_ROLES, _SKILLS, _MATERIAL = _fixture_rows()
DIM, FLOOR, CEILING = fixtures.SEMANTIC.dim, fixtures.SEMANTIC.floor, fixtures.SEMANTIC.ceiling


def _tokens(column: str) -> str:
    return rf"unnest(regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{N}}]+'))"


def _bucket(column: str) -> str:
    return f"CAST(('0x' || substr(md5({column}), 1, 8))::BIGINT % {DIM} AS BIGINT)"


def _score(semantic: str) -> str:
    boost = f"CASE WHEN n_matched > 0 THEN {real(scoring.KEYWORD_BOOST)} ELSE {real(0.0)} END"
    mixed = f"{real(scoring.SEMANTIC_SHARE)} * {semantic} + {real(scoring.KEYWORD_SHARE)} * ratio + {boost}"
    return f"least({real(scoring.SCORE_MAX)}, greatest({real(scoring.SCORE_MIN)}, ({mixed}) * {real(100.0)}))"


def _hits() -> str:
    """One branch per keyword, as a constant pattern is compiled once and not per row."""
    branches = [
        f"SELECT resume_id, {text(skill)} AS skill, {i} AS kw_ord, {text(word)} AS keyword,"
        f" regexp_matches(lower(text), {text(_keyword_pattern(word))}) AS hit"
        f" FROM resumes WHERE target_role = {text(role)}"
        for role, profile in fixtures.PROFILES.items()
        for skill, info in profile["skills"].items()
        for i, word in enumerate(info.get("keywords", []))
    ]
    return " UNION ALL ".join(branches)


_HITS = _hits()

CTES: dict[str, tuple[list[str], str]] = {
    "roles": ([], f"SELECT * FROM (VALUES {_ROLES}) t(role, role_ord, title, profile)"),
    "skills": ([], f"SELECT * FROM (VALUES {_SKILLS}) t(role, skill, skill_ord, weight, n_keywords, query_text)"),
    "material": ([], f"SELECT * FROM (VALUES {_MATERIAL}) t(skill, fundamentals, applied, project, topics)"),
    "texts": ([], f"""
        SELECT doc_id AS resume_id,
               CASE lang WHEN 'en' THEN 'Role EN' WHEN 'de' THEN 'Role DE' WHEN 'fr' THEN 'Role FR'
                    ELSE CASE WHEN doc_id % 2 = 0 THEN 'Role EMPTY' ELSE 'Role Unknown' END END AS target_role,
               {normal('text')} AS text
        FROM documents"""),
    "resumes": (["texts"], f"SELECT * FROM texts WHERE length({strip('text')}) >= 10"),
    "lines": (["resumes"], """
        SELECT resume_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS line_no FROM resumes"""),
    "pieces": (["lines"], rf"""
        SELECT resume_id, line_no, unnest(p) AS piece, unnest(range(len(p))) AS piece_no
        FROM (SELECT resume_id, line_no,
                     string_split(regexp_replace({strip('line')}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)) AS p
              FROM lines WHERE {strip('line')} <> '')"""),
    "sentences": (["pieces"], """
        SELECT resume_id, sentence,
               row_number() OVER (PARTITION BY resume_id ORDER BY line_no, piece_no) - 1 AS sentence_no
        FROM (SELECT *, trim(piece, ' ' || chr(8226) || '-*' || chr(8211) || chr(9)) AS sentence FROM pieces)
        WHERE length(sentence) > 10"""),
    "windows": (["sentences"], f"""
        SELECT resume_id, start, {strip("string_agg(sentence, ' ' ORDER BY sentence_no)")} AS chunk
        FROM (SELECT *, sentence_no - sentence_no % 2 AS start FROM sentences
              UNION ALL
              SELECT *, sentence_no - 2 AS start FROM sentences WHERE sentence_no % 2 = 0 AND sentence_no >= 2)
        GROUP BY resume_id, start"""),
    "chunks": (["resumes", "sentences", "windows"], """
        SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY start) - 1 AS chunk_no, chunk
        FROM windows WHERE length(chunk) > 15
        UNION ALL
        SELECT resume_id, sentence_no, sentence FROM sentences
        WHERE resume_id NOT IN (SELECT resume_id FROM windows WHERE length(chunk) > 15)
        UNION ALL
        SELECT resume_id, 0, CASE WHEN text = '' THEN 'General resume content' ELSE left(text, 500) END FROM resumes
        WHERE resume_id NOT IN (SELECT resume_id FROM sentences)"""),
    "asked": (["resumes", "skills"], """
        SELECT r.resume_id, r.target_role AS role, s.skill, s.skill_ord, s.weight, s.n_keywords, s.query_text
        FROM resumes r JOIN skills s ON r.target_role = s.role"""),
    "hits": (["resumes"], _HITS),
    "coverage": (["asked", "hits"], f"""
        SELECT a.*, coalesce(matched, '') AS matched, coalesce(missing, '') AS missing,
               CAST(coalesce(n, 0) AS BIGINT) AS n_matched,
               CASE WHEN n_keywords = 0 THEN {real(RATIO_WITHOUT_KEYWORDS)}
                    ELSE least({real(1.0)}, CAST(coalesce(n, 0) AS DOUBLE)
                               / CAST(least(n_keywords, {KEYWORD_TARGET}) AS DOUBLE)) END AS ratio
        FROM asked a LEFT JOIN (
            SELECT resume_id, skill, count(*) FILTER (hit) AS n,
                   string_agg(keyword, '|' ORDER BY kw_ord) FILTER (hit) AS matched,
                   string_agg(keyword, '|' ORDER BY kw_ord) FILTER (NOT hit) AS missing
            FROM hits GROUP BY resume_id, skill) h USING (resume_id, skill)"""),
    "chunk_tf": (["chunks"], f"""
        SELECT resume_id, chunk_no, {_bucket('token')} AS bucket, count(*) AS tf
        FROM (SELECT resume_id, chunk_no, {_tokens('chunk')} AS token FROM chunks) WHERE token <> ''
        GROUP BY ALL"""),
    "chunk_norm": (["chunk_tf"], """
        SELECT resume_id, chunk_no, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS norm FROM chunk_tf GROUP BY ALL"""),
    "query_tf": (["skills"], f"""
        SELECT role, skill, {_bucket('token')} AS bucket, count(*) AS tf
        FROM (SELECT role, skill, {_tokens('query_text')} AS token FROM skills) WHERE token <> '' GROUP BY ALL"""),
    "query_norm": (["query_tf"], """
        SELECT role, skill, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS norm FROM query_tf GROUP BY ALL"""),
    "dots": (["resumes", "chunk_tf", "query_tf"], """
        SELECT c.resume_id, r.target_role AS role, q.skill, c.chunk_no, CAST(sum(c.tf * q.tf) AS DOUBLE) AS dot
        FROM chunk_tf c JOIN resumes r USING (resume_id) JOIN query_tf q ON q.role = r.target_role AND q.bucket = c.bucket
        GROUP BY ALL"""),
    "similarity": (["dots", "chunk_norm", "query_norm", "chunks"], """
        SELECT resume_id, skill, sum(sim) / any_value(least(2, n_chunks)) AS similarity
        FROM (SELECT d.resume_id, d.skill, dot / (q.norm * c.norm) AS sim,
                     row_number() OVER (PARTITION BY d.resume_id, d.skill ORDER BY dot / (q.norm * c.norm) DESC) AS place
              FROM dots d JOIN chunk_norm c USING (resume_id, chunk_no) JOIN query_norm q USING (role, skill)) s
        JOIN (SELECT resume_id, count(*) AS n_chunks FROM chunks GROUP BY resume_id) n USING (resume_id)
        WHERE place <= 2 GROUP BY resume_id, skill"""),
    "raw_scores": (["coverage", "similarity"], f"""
        SELECT c.*, coalesce(similarity, {real(0.0)}) AS similarity,
               least({real(1.0)}, greatest({real(0.0)},
                   (coalesce(similarity, {real(0.0)}) - {real(FLOOR)}) / ({real(CEILING)} - {real(FLOOR)}))) AS semantic
        FROM coverage c LEFT JOIN similarity USING (resume_id, skill)"""),
    "scores": (["raw_scores"], f"""
        SELECT *, {banded(scoring.LEVELS, scoring.LOWEST_LEVEL, 'score')} AS level
        FROM (SELECT *, {rounded('raw', 1)} AS score, {rounded('similarity', 3)} AS semantic_similarity
              FROM (SELECT *, {_score('semantic')} AS raw FROM raw_scores))"""),
    "keyword_scores": (["coverage"], f"""
        SELECT *, {rounded('raw', 1)} AS score FROM (SELECT *, {_score(real(0.0))} AS raw FROM coverage)"""),
}


def _readiness(scores: str) -> str:
    """Readiness per resume with a known role, from one row per resume and skill."""
    fold = "list_reduce(list({} ORDER BY skill_ord), lambda a, b: a + b)"
    return f"""
        SELECT resume_id, role, {rounded('mean', 1)} AS readiness_score, n_skills, n_gaps
        FROM (SELECT r.resume_id, r.target_role AS role, coalesce(n_skills, 0) AS n_skills, coalesce(n_gaps, 0) AS n_gaps,
                     coalesce(least({real(100.0)}, greatest({real(0.0)},
                         scored / CASE WHEN total <= 0 THEN {real(1.0)} ELSE total END)), {real(0.0)}) AS mean
              FROM resumes r JOIN roles ON roles.role = r.target_role LEFT JOIN (
                  SELECT resume_id, CAST(count(*) AS BIGINT) AS n_skills,
                         CAST(count(*) FILTER (score < {scoring.WEAK_BELOW}) AS BIGINT) AS n_gaps,
                         {fold.format('score * weight')} AS scored, {fold.format('weight')} AS total
                  FROM {scores} GROUP BY resume_id) s USING (resume_id))"""


CTES["readiness"] = (["resumes", "roles", "scores"], _readiness("scores"))
CTES["keyword_readiness"] = (["resumes", "roles", "keyword_scores"], _readiness("keyword_scores"))
CTES["gaps"] = (["scores"], f"""
    SELECT *, {rounded(f"({real(100.0)} - score)", 1)} AS gap,
           row_number() OVER (PARTITION BY resume_id ORDER BY weight DESC, score, skill_ord) AS priority
    FROM scores WHERE score < {scoring.WEAK_BELOW}""")
CTES["focus"] = (["gaps"], """
    SELECT resume_id, role, p, coalesce(s0, p) AS s, coalesce(t0, s0, p) AS t, gaps3
    FROM (SELECT resume_id, role, max(skill) FILTER (priority = 1) AS p, max(skill) FILTER (priority = 2) AS s0,
                 max(skill) FILTER (priority = 3) AS t0,
                 list(skill ORDER BY priority) FILTER (priority <= 3) AS gaps3
          FROM gaps GROUP BY resume_id, role)""")
CTES["heaviest"] = (["scores", "gaps"], """
    SELECT resume_id, role, list(skill ORDER BY place) AS top3
    FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY weight DESC, skill_ord) AS place FROM scores)
    WHERE place <= 3 AND resume_id NOT IN (SELECT resume_id FROM gaps) GROUP BY resume_id, role""")


def _template_rows(weeks: tuple[study_plan.Week, ...]) -> str:
    rows = []
    for number, week in enumerate(weeks, 1):
        cells = [week.title, week.theme, "|".join(week.objectives), week.project, "|".join(week.resources)]
        rows.append(f"({number}, " + ", ".join(text(c) for c in cells) + ")")
    return f"(VALUES {', '.join(rows)}) w(week, title, theme, objectives, project, resources)"


def _filled(column: str, slots: dict[str, str]) -> str:
    for slot, value in slots.items():
        column = f"replace({column}, {text('{' + slot + '}')}, {value})"
    return column


_GAP_SLOTS = {
    "p": "p", "s": "s", "t": "t", "role": "role", "gaps": "array_to_string(gaps3, ', ')",
    "p.fundamentals": "pf", "p.applied": "pa", "p.project": "pp", "s.fundamentals": "sf", "s.project": "sp",
    "t.applied": "ta",
}
_TOP_SLOTS = {"a": "top3[1]", "ab": "array_to_string(top3[1:2], ', ')", "role": "role"}


def _default(rank: str, field: str) -> str:
    value = study_plan.MISSING_MATERIAL[rank][field]
    return f"replace({text(value if isinstance(value, str) else '|'.join(value))}, '{{skill}}', {rank})"


CTES["gap_slots"] = (["focus", "material"], f"""
    SELECT f.*, coalesce(mp.fundamentals, {_default('p', 'fundamentals')}) AS pf,
           coalesce(mp.applied, {_default('p', 'applied')}) AS pa, coalesce(mp.project, {_default('p', 'project')}) AS pp,
           coalesce(ms.fundamentals, {_default('s', 'fundamentals')}) AS sf, coalesce(ms.project, {_default('s', 'project')}) AS sp,
           coalesce(mt.applied, {_default('t', 'applied')}) AS ta,
           coalesce(mp.topics, {_default('p', 'topics')}) AS pt, coalesce(ms.topics, {_default('s', 'topics')}) AS st,
           coalesce(mt.topics, {_default('t', 'topics')}) AS tt,
           p || CASE WHEN s <> p THEN '|' || s ELSE '' END AS week2,
           CASE WHEN s <> p THEN p || '|' || s WHEN t <> p THEN p || '|' || t ELSE p END AS week3
    FROM focus f LEFT JOIN material mp ON mp.skill = p LEFT JOIN material ms ON ms.skill = s
    LEFT JOIN material mt ON mt.skill = t""")
CTES["gap_plan"] = (["gap_slots"], f"""
    SELECT resume_id, role, CAST(week AS BIGINT) AS week, {_filled('title', _GAP_SLOTS)} AS title,
           CASE week WHEN 1 THEN p WHEN 2 THEN week2 WHEN 3 THEN week3 ELSE array_to_string(gaps3, '|') END AS focus_skills,
           theme, {_filled('objectives', _GAP_SLOTS)} AS weekly_objectives,
           {_filled('project', _GAP_SLOTS)} AS hands_on_project,
           CASE week WHEN 1 THEN pt || '|' WHEN 2 THEN st || '|' WHEN 3 THEN tt || '|' ELSE '' END
               || {_filled('resources', _GAP_SLOTS)} AS key_resources
    FROM gap_slots CROSS JOIN {_template_rows(study_plan.GAP_WEEKS)}""")
CTES["mastery_plan"] = (["heaviest"], f"""
    SELECT resume_id, role, CAST(week AS BIGINT) AS week, {_filled('title', _TOP_SLOTS)} AS title,
           CASE week WHEN 1 THEN top3[1] WHEN 2 THEN array_to_string(top3[1:2], '|')
                WHEN 3 THEN array_to_string(top3, '|') ELSE {_filled(text(study_plan.LEADERSHIP_FOCUS), _TOP_SLOTS)} END
               AS focus_skills,
           theme, {_filled('objectives', _TOP_SLOTS)} AS weekly_objectives,
           {_filled('project', _TOP_SLOTS)} AS hands_on_project, {_filled('resources', _TOP_SLOTS)} AS key_resources
    FROM heaviest CROSS JOIN {_template_rows(study_plan.MASTERY_WEEKS)}""")
CTES["ranked"] = (["scores"], """
    SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY score DESC, skill_ord) AS place FROM scores""")
CTES["vectors"] = ([], """
    SELECT v.vec_id, v.label, CAST(q.label AS VARCHAR) AS skill,
           list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])
             / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))
                * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS similarity
    FROM embeddings v JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) q
      ON v.label % 2 = q.label % 2""")
_PAGE_LINE = rf"regexp_replace(replace(replace(coalesce(text, ''), chr(160), ' '), chr(8203), ''), '[ \t]+', ' ', 'g')"
CTES["page_rows"] = ([], f"""
    SELECT conv_id AS doc_id, turn AS page_no, unnest(l) AS line, unnest(range(len(l))) AS i
    FROM (SELECT conv_id, turn, string_split({_PAGE_LINE}, chr(10)) AS l FROM conversations)""")
CTES["page_lines"] = (["page_rows"], f"""
    SELECT doc_id, CAST(page_no AS BIGINT) AS page_no,
           CAST(row_number() OVER w - 1 AS BIGINT) AS line_no, line,
           coalesce(i > lag(i) OVER w + 1, true) AS gap
    FROM page_rows WHERE {strip('line')} <> '' WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY i)""")
CTES["paged_texts"] = ([], f"""
    SELECT conv_id AS doc_id, {normal("string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> '')")} AS text
    FROM conversations GROUP BY conv_id""")
_KIND = "(doc_id % 20)"
_STEM = "source || '_' || CAST(doc_id AS VARCHAR)"
_ROLE = """CASE lang WHEN 'en' THEN 'Role EN' WHEN 'de' THEN 'Role DE' WHEN 'fr' THEN 'Role FR'
    ELSE CASE WHEN doc_id % 2 = 0 THEN 'Role EMPTY' ELSE 'Role Unknown' END END"""
CTES["uploads"] = ([], f"""
    SELECT *, CAST(doc_id AS VARCHAR) || coalesce('/' || filename, '') AS path FROM (
        SELECT doc_id, {_ROLE} AS target_role,
               CASE WHEN {_KIND} = 1 THEN {_STEM} || '.docx' WHEN {_KIND} = 2 THEN NULL WHEN {_KIND} = 3 THEN {_STEM} || '.TXT'
                    WHEN {_KIND} BETWEEN 9 AND 11 THEN {_STEM} || '.pdf' ELSE {_STEM} || '.txt' END AS filename,
               text AS content, NULL AS fault
        FROM documents
        UNION ALL
        SELECT doc_id, {_ROLE}, {_STEM} || ending, CASE {_KIND} WHEN 4 THEN chr(10) WHEN 5 THEN source ELSE ending END, ending
        FROM documents JOIN (VALUES (4, '_blank.txt'), (5, '_tiny.txt'), (12, '_empty.pdf'), (13, '_locked.pdf'),
                                    (14, '_broken.pdf'), (15, '_scan.pdf')) f(k, ending) ON k = {_KIND})""")
CTES["checked"] = (["uploads"], f"""
    SELECT *, CASE WHEN coalesce(filename, '') = '' THEN {text(files.NO_FILE)}
                   WHEN NOT (lower(filename) LIKE '%.txt' OR lower(filename) LIKE '%.pdf')
                        THEN replace({text(files.UNSUPPORTED)}, '%s', filename)
                   WHEN trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''
                        THEN {text(files.EMPTY_FILE)} END AS refused,
           lower(filename) LIKE '%.pdf' AS is_pdf,
           CASE WHEN lower(filename) LIKE '%.pdf' THEN {normal("replace(content, chr(10), chr(10) || chr(10))")}
                ELSE {normal('content')} END AS text
    FROM uploads""")
CTES["taken"] = (["checked"], f"""
    SELECT *, CASE WHEN refused IS NOT NULL THEN refused
                   WHEN fault = '_empty.pdf' THEN {text(files.NO_PAGES)}
                   WHEN fault = '_locked.pdf' THEN {text(files.ENCRYPTED_PDF)}
                   WHEN fault = '_broken.pdf' THEN {text(files.CORRUPT_PDF + 'no header')}
                   WHEN is_pdf AND length(text) < {pages.MIN_PAGED_CHARS} THEN {text(pages.TOO_LITTLE_TEXT)}
                   WHEN NOT is_pdf AND length(text) < 10 THEN {text(files.UNREADABLE_TXT)} END AS unread
    FROM checked""")


_PAGED_RESUMES = """
    SELECT doc_id AS resume_id, CASE doc_id % 3 WHEN 0 THEN 'Role EN' WHEN 1 THEN 'Role DE' ELSE 'Role FR' END AS target_role,
           text FROM paged_texts"""


def statement(needs: list[str], body: str, **replaced: tuple[list[str], str]) -> str:
    """A query with the common table expressions it needs, in dependency order."""
    order: list[str] = []
    ctes = {**CTES, **replaced}

    def visit(name: str) -> None:
        for parent in ctes[name][0]:
            visit(parent)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    shared = ", ".join(f"{name} AS MATERIALIZED ({ctes[name][1]})" for name in order)
    return f"WITH {shared} {body}"


_TIER = banded(scoring.TIERS, scoring.LOWEST_TIER, "readiness_score")
_FIVE = "array_to_string(string_split(missing, '|')[1:5], '|')"
_PERCENT = "CAST(trunc(weight * 100) AS BIGINT)"


def _list(column: str) -> str:
    return f"CASE WHEN {column} = '' THEN [] ELSE string_split({column}, '|') END"


_PLAN = "resume_id, role, week, title, focus_skills, theme, weekly_objectives, hands_on_project, key_resources"

ORACLE: dict[str, str] = {
    "q_normalize": statement(["texts"], "SELECT resume_id, md5(text) AS text_md5, length(text) AS n_chars FROM texts"),
    "q_sentences": statement(["sentences"], "SELECT resume_id, sentence_no, sentence FROM sentences"),
    "q_chunks": statement(["chunks"], "SELECT resume_id, chunk_no, chunk FROM chunks"),
    "q_keyword_hits": statement(["coverage"], """
        SELECT resume_id, skill, matched AS matched_keywords, missing AS missing_keywords, n_matched FROM coverage"""),
    "q_keyword_ratio": statement(["coverage"], "SELECT resume_id, skill, ratio FROM coverage"),
    "q_keyword_readiness": statement(["keyword_readiness"], f"""
        SELECT resume_id, role, readiness_score, {_TIER} AS readiness_tier FROM keyword_readiness"""),
    "q_query_text": statement(["skills", "resumes"], """
        SELECT role, skill, query_text, (SELECT count(*) FROM resumes r WHERE r.target_role = s.role) AS n_resumes FROM skills s"""),
    "q_roles": statement(["roles", "skills", "texts"], """
        SELECT r.role, CAST(role_ord AS BIGINT) AS role_ord,
               (SELECT count(*) FROM skills s WHERE s.role = r.role) AS n_skills,
               CAST((SELECT coalesce(sum(n_keywords), 0) FROM skills s WHERE s.role = r.role) AS BIGINT) AS n_keywords,
               (SELECT count(*) FROM texts t WHERE t.target_role = r.role) AS n_resumes,
               title, profile
        FROM roles r"""),
    "q_dense_similarity": statement(["vectors"], f"""
        SELECT vec_id, skill, similarity FROM (
            SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, skill DESC) AS place
            FROM (SELECT vec_id, skill, sign(similarity) * {rounded('abs(similarity)', 3)} AS similarity FROM vectors))
        WHERE place = 1"""),
    "q_dense_top2": statement(["vectors"], f"""
        SELECT label, skill, sign(mean) * {rounded('abs(mean)', 3)} AS semantic_similarity
        FROM (SELECT CAST(label AS BIGINT) AS label, skill, sum(similarity) / count(*) AS mean
              FROM (SELECT *, row_number() OVER (PARTITION BY label, skill ORDER BY similarity DESC, vec_id) AS place
                    FROM vectors) WHERE place <= 2 GROUP BY label, skill)"""),
    "q_hashed_vectors": statement(["chunks", "chunk_tf", "chunk_norm"], f"""
        SELECT c.resume_id, c.chunk_no, coalesce(buckets, '') AS buckets,
               {rounded(f'coalesce(norm, {real(0.0)})', 3)} AS norm
        FROM chunks c LEFT JOIN chunk_norm USING (resume_id, chunk_no)
        LEFT JOIN (SELECT resume_id, chunk_no, string_agg(CAST(bucket AS VARCHAR), ',' ORDER BY bucket) AS buckets
                   FROM (SELECT resume_id, chunk_no, bucket, unnest(range(tf)) FROM chunk_tf) GROUP BY ALL)
        USING (resume_id, chunk_no)"""),
    "q_skill_scores": statement(["scores"], """
        SELECT resume_id, role, skill, CAST(skill_ord AS BIGINT) AS skill_ord, score, weight, level,
               matched AS matched_keywords, missing AS missing_keywords, semantic_similarity FROM scores"""),
    "q_levels": statement(["scores"], "SELECT role, level, count(*) AS n FROM scores GROUP BY role, level"),
    "q_readiness": statement(["readiness"], f"""
        SELECT resume_id, role, readiness_score, {_TIER} AS readiness_tier, n_skills, n_gaps FROM readiness"""),
    "q_gaps": statement(["gaps"], f"""
        SELECT resume_id, role, priority, skill, score, weight, gap, level, matched AS matched_keywords,
               {_FIVE} AS missing_keywords FROM gaps"""),
    "q_gap_focus": statement(["gap_slots"], """
        SELECT resume_id, p AS first_gap, s AS second_gap, t AS third_gap, week2 AS week2_focus, week3 AS week3_focus
        FROM gap_slots"""),
    "q_gap_plan": statement(["gap_plan"], f"SELECT {_PLAN} FROM gap_plan"),
    "q_mastery_plan": statement(["mastery_plan"], f"SELECT {_PLAN} FROM mastery_plan"),
    "q_study_plan": statement(["gap_plan", "mastery_plan"], f"""
        SELECT {_PLAN} FROM gap_plan UNION ALL SELECT {_PLAN} FROM mastery_plan"""),
    "q_strongest_skill": statement(["ranked"], f"""
        SELECT resume_id, role, place, skill, score, level,
               {banded(scoring.LEVEL_BANDS, scoring.LOWEST_LEVEL_BAND, 'score')} AS level_band, {_PERCENT} AS weight_percent,
               CASE WHEN n_matched > 0 THEN array_to_string(string_split(matched, '|')[1:4], ', ')
                    ELSE {text(scoring.NO_KEYWORDS_FOUND)} END AS matched_shown
        FROM ranked"""),
    "q_gap_review": statement(["gaps"], f"""
        SELECT resume_id, role, priority, skill, score, gap, {_PERCENT} AS weight_percent,
               CASE WHEN missing <> '' THEN array_to_string(string_split(missing, '|')[1:3], ', ')
                    ELSE {text(scoring.NO_KEYWORDS_MISSING)} END AS review
        FROM gaps"""),
    "q_report": statement(["readiness", "ranked"], f"""
        SELECT r.resume_id, r.role, readiness_score, {_TIER} AS readiness_tier,
               {banded(scoring.BADGES, scoring.LOWEST_BADGE, 'readiness_score')} AS badge,
               CASE WHEN readiness_score = {scoring.BENCHMARK} THEN {text(scoring.AT_BENCHMARK)}
                    ELSE printf('%.1f%% vs. Benchmark', readiness_score - {real(scoring.BENCHMARK)}) END AS delta_text,
               readiness_score - {real(scoring.BENCHMARK)} AS delta, n_skills, n_gaps,
               b.skill AS strongest_skill, b.score AS strongest_score,
               {banded(scoring.SCREENING, scoring.LOWEST_SCREENING, 'readiness_score')} AS screening_probability,
               {banded(scoring.STRATEGIES, scoring.LOWEST_STRATEGY, 'readiness_score')} AS strategy
        FROM readiness r LEFT JOIN (SELECT * FROM ranked WHERE place = 1) b USING (resume_id)"""),
    "q_result_json": statement(["readiness", "scores", "gaps", "gap_plan", "mastery_plan"], f"""
        SELECT r.resume_id, to_json({{
            'readiness_score': readiness_score,
            'skill_breakdown': coalesce(breakdown, MAP {{}}),
            'missing_skills': coalesce(missing_skills, []),
            'readiness_tier': {_TIER},
            'study_plan': coalesce(study_plan, [])}})::VARCHAR AS json
        FROM readiness r
        LEFT JOIN (
            SELECT resume_id, map_from_entries(list({{'k': skill, 'v': {{
                'score': score, 'weight': weight, 'level': level, 'matched_keywords': {_list('matched')},
                'missing_keywords': {_list('missing')}, 'semantic_similarity': semantic_similarity}}}} ORDER BY skill_ord)) AS breakdown
            FROM scores GROUP BY resume_id) USING (resume_id)
        LEFT JOIN (
            SELECT resume_id, list({{'skill': skill, 'score': score, 'weight': weight, 'gap': gap, 'level': level,
                'matched_keywords': {_list('matched')}, 'missing_keywords': {_list('missing')}[1:5]}} ORDER BY priority) AS missing_skills
            FROM gaps GROUP BY resume_id) USING (resume_id)
        LEFT JOIN (
            SELECT resume_id, list({{'week': week, 'title': title, 'focus_skills': string_split(focus_skills, '|'),
                'theme': theme, 'weekly_objectives': string_split(weekly_objectives, '|'),
                'hands_on_project': hands_on_project, 'key_resources': string_split(key_resources, '|')}} ORDER BY week) AS study_plan
            FROM (SELECT * FROM gap_plan UNION ALL SELECT * FROM mastery_plan) GROUP BY resume_id) USING (resume_id)"""),
    "q_rejects": statement(["texts", "resumes", "roles", "skills"], f"""
        SELECT resume_id, 'analyse' AS stage, {text(validation.TOO_SHORT)} AS reason FROM texts
        WHERE resume_id NOT IN (SELECT resume_id FROM resumes)
        UNION ALL
        SELECT resume_id, 'role', 'Invalid target role ''' || target_role || '''. Available roles are: ['
               || (SELECT string_agg('''' || role || '''', ', ' ORDER BY role_ord) FROM roles) || ']'
        FROM resumes WHERE target_role NOT IN (SELECT role FROM roles)
        UNION ALL
        SELECT resume_id, 'plan', {text(validation.NO_SKILLS)} FROM resumes
        WHERE target_role IN (SELECT role FROM roles) AND target_role NOT IN (SELECT role FROM skills)"""),
    "q_files": statement(["checked"], """
        SELECT doc_id, filename, md5(text) AS text_md5, length(text) AS n_chars FROM checked
        WHERE refused IS NULL AND NOT is_pdf AND length(text) >= 10"""),
    "q_file_rejects": statement(["checked"], f"""
        SELECT doc_id, filename, CASE WHEN refused IS NULL THEN 'parse' ELSE 'upload' END AS stage,
               coalesce(refused, {text(files.UNREADABLE_TXT)}) AS reason
        FROM checked WHERE refused IS NOT NULL OR NOT is_pdf AND length(text) < 10"""),
    "q_pages": statement(["page_lines"], "SELECT doc_id, page_no, line_no, line, gap FROM page_lines"),
    "q_paged_documents": statement(["paged_texts", "page_lines"], f"""
        SELECT doc_id, CAST(coalesce(n_pages, 0) AS BIGINT) AS n_pages, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
               length(text) AS n_chars,
               CASE WHEN length(text) < {pages.MIN_PAGED_CHARS} THEN {text(pages.TOO_LITTLE_TEXT)} ELSE '' END AS reason
        FROM paged_texts LEFT JOIN (SELECT doc_id, count(DISTINCT page_no) AS n_pages, count(*) AS n_lines
                                    FROM page_lines GROUP BY doc_id) USING (doc_id)"""),
}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(column: str) -> str:
    counts = ", ".join(f"length(lower({column})) - length(replace(lower({column}), '{c}', ''))" for c in _LETTERS)
    return f"[{counts}]::DOUBLE[]"


_M = fixtures.MODEL_SEMANTIC
_MODEL = dict(
    letter_chunks=(["chunks"], f"""
        SELECT resume_id, chunk_no, v, sqrt(list_dot_product(v, v)) AS norm
        FROM (SELECT resume_id, chunk_no, {_letters('chunk')} AS v FROM chunks)"""),
    letter_queries=(["skills"], f"""
        SELECT role, skill, v, sqrt(list_dot_product(v, v)) AS norm
        FROM (SELECT role, skill, {_letters('query_text')} AS v FROM skills)"""),
    similarity=(["letter_chunks", "letter_queries", "resumes"], f"""
        SELECT resume_id, skill, sum(sim) / count(*) AS similarity
        FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, skill ORDER BY sim DESC) AS place
              FROM (SELECT c.resume_id, q.skill, CASE WHEN q.norm * c.norm > 0
                           THEN list_dot_product(q.v, c.v) / (q.norm * c.norm) ELSE {real(0.0)} END AS sim
                    FROM letter_chunks c JOIN resumes r USING (resume_id) JOIN letter_queries q ON q.role = r.target_role))
        WHERE place <= 2 GROUP BY resume_id, skill"""),
    raw_scores=(["coverage", "similarity"], CTES["raw_scores"][1].replace(real(FLOOR), real(_M.floor)).replace(real(CEILING), real(_M.ceiling))),
)
ORACLE["q_model_provider"] = statement(["scores"], "SELECT resume_id, skill, score, semantic_similarity FROM scores", **_MODEL)
for _same, _as in (
    ("q_stream_readiness", "q_readiness"), ("q_large_scores", "q_skill_scores"), ("q_large_gaps", "q_gaps"),
    ("q_large_study_plan", "q_study_plan"), ("q_large_readiness", "q_readiness"), ("q_stream_rejects", "q_rejects"),
):
    ORACLE[_same] = ORACLE[_as]
_PAGED = {"resumes": (["paged_texts"], _PAGED_RESUMES + f" WHERE length(text) >= {pages.MIN_PAGED_CHARS}")}
ORACLE["q_paged_texts"] = statement(["paged_texts"], f"""
    SELECT doc_id, md5(text) AS text_md5 FROM paged_texts WHERE length(text) >= {pages.MIN_PAGED_CHARS}""")
# Chunk numbers only order the chunks of a document: the start of the window, halved.
ORACLE["q_paged_chunks"] = statement(["resumes", "sentences", "windows", "chunks"], """
    SELECT resume_id, CAST(start // 2 AS BIGINT) AS chunk_no, chunk FROM windows WHERE length(chunk) > 15
    UNION ALL
    SELECT resume_id, chunk_no, chunk FROM chunks
    WHERE resume_id NOT IN (SELECT resume_id FROM windows WHERE length(chunk) > 15)""", **_PAGED)
ORACLE["q_paged_scores"] = statement(["scores"], """
    SELECT resume_id, role, skill, CAST(skill_ord AS BIGINT) AS skill_ord, score, weight, level,
           matched AS matched_keywords, missing AS missing_keywords, semantic_similarity FROM scores""", **_PAGED)
ORACLE["q_paged_readiness"] = statement(["readiness"], f"""
    SELECT resume_id, role, readiness_score, {_TIER} AS readiness_tier, n_skills, n_gaps FROM readiness""", **_PAGED)

_TAKEN = {"resumes": (["taken"], "SELECT path AS resume_id, target_role, text FROM taken WHERE unread IS NULL")}
ORACLE["q_intake_readiness"] = statement(["readiness"], f"""
    SELECT resume_id AS path, role, readiness_score, {_TIER} AS readiness_tier, n_skills, n_gaps FROM readiness""", **_TAKEN)
ORACLE["q_intake_rejects"] = statement(["taken", "resumes", "roles", "skills"], f"""
    SELECT path, CASE WHEN refused IS NULL THEN 'parse' ELSE 'upload' END AS stage, unread AS reason FROM taken WHERE unread IS NOT NULL
    UNION ALL
    SELECT resume_id, 'role', 'Invalid target role ''' || target_role || '''. Available roles are: ['
           || (SELECT string_agg('''' || role || '''', ', ' ORDER BY role_ord) FROM roles) || ']'
    FROM resumes WHERE target_role NOT IN (SELECT role FROM roles)
    UNION ALL
    SELECT resume_id, 'plan', {text(validation.NO_SKILLS)} FROM resumes
    WHERE target_role IN (SELECT role FROM roles) AND target_role NOT IN (SELECT role FROM skills)""", **_TAKEN)

# Two requests of one resume are two rows with numbers of their own, so the statements stay as they are.
_TWO = {"resumes": (["texts"], f"""
    SELECT resume_id * 4 + k AS resume_id, role AS target_role, text
    FROM (SELECT resume_id, text, unnest(roles) AS role, unnest(range(len(roles))) AS k
          FROM (SELECT *, list_distinct([target_role, CASE resume_id % 3 WHEN 0 THEN 'Role EN' WHEN 1 THEN 'Role DE' ELSE 'Role FR' END]) AS roles
                FROM texts WHERE length({strip('text')}) >= 10))""")}


def _two_roles(form: str, **replaced: tuple[list[str], str]) -> str:
    return statement(["readiness", "coverage", "gaps", "gap_plan", "mastery_plan"], f"""
        SELECT {text(form)} AS form, r.resume_id // 4 AS resume_id, r.role, readiness_score, n_skills, n_gaps,
               CAST(coalesce(n_hits, 0) AS BIGINT) AS n_hits, coalesce(gap_order, '') AS gap_order, coalesce(week1_focus, '') AS week1_focus
        FROM readiness r
        LEFT JOIN (SELECT resume_id, sum(n_matched) AS n_hits FROM coverage GROUP BY resume_id) USING (resume_id)
        LEFT JOIN (SELECT resume_id, string_agg(skill, '|' ORDER BY priority) AS gap_order FROM gaps GROUP BY resume_id) USING (resume_id)
        LEFT JOIN (SELECT resume_id, focus_skills AS week1_focus
                   FROM (SELECT * FROM gap_plan UNION ALL SELECT * FROM mastery_plan) WHERE week = 1) USING (resume_id)""", **_TWO, **replaced)


ORACLE["q_two_roles"] = " UNION ALL ".join(
    f"SELECT * FROM ({body})" for body in (_two_roles("rows"), _two_roles("long"), _two_roles("model", **_MODEL))
)


def _repeated(form: str, **replaced: tuple[list[str], str]) -> str:
    return statement(["readiness"], f"""
        SELECT {text(form)} AS form, CASE WHEN resume_id % 10 <> 0 THEN CAST(resume_id - resume_id % 3 AS VARCHAR) ELSE 'none' END AS resume_id, role, readiness_score, n_skills, n_gaps
        FROM (SELECT *, unnest(range(CASE WHEN resume_id % 7 = 0 THEN 2 ELSE 1 END)) FROM readiness)""", **replaced)


# Repeated and null ids change nothing but the id.
ORACLE["q_repeated_ids"] = " UNION ALL ".join(
    f"SELECT * FROM ({body})" for body in (*map(_repeated, ("rows", "shuffled", "long", "stream")), _repeated("model", **_MODEL))
)
