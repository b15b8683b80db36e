"""DuckDB SQL of the relations and of what the operators derive from them, written apart from them."""

from __future__ import annotations

from ..functions.vocabulary import ENTITY_RULES, PHASES, PROMISES, STOPWORDS
from .corpus import RELATIONS


def spans(pattern: str, source: str, columns: str, where: str = "true") -> str:
    """SQL: columns, value, start (from 0) of every match of pattern in raw_text of source."""
    p = pattern.replace("'", "''")
    return f"""SELECT {columns}, m[i] AS value, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(raw_text, '{p}') AS m, string_split_regex(raw_text, '{p}') AS p FROM {source} WHERE raw_text IS NOT NULL AND {where}))"""


SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def squeeze(x: str) -> str:
    return SQUEEZE.format(x)


_MENTIONS = " UNION ALL ".join(spans(p, "artifacts", f"artifact_id, project_id, raw_text, '{kind}' AS kind, {conf} AS confidence") for kind, p, conf in ENTITY_RULES)
_PROMISES = " UNION ALL ".join(spans("(?i)" + p, "artifacts", "artifact_id, project_id") for p in PROMISES)
_DATES = spans(r"\b\d{4}-\d{2}-\d{2}\b|\bMarch \d{1,2}, \d{4}\b|(?i:\blast week\b)|\b(?:19|20)\d{2}\b", "artifacts", "artifact_id, project_id")
_PHASES = ", ".join(f"({i}, '{d}', {o}, '{n}')" for i, (d, o, n) in enumerate(PHASES))
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_ISO = r"^\d{4}-\d{2}-\d{2}$"
_RANK = "CASE source WHEN 'content' THEN 3 WHEN 'doc_meta' THEN 2 ELSE 1 END"
_DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


DERIVED = rf"""
raw_mentions AS ({_MENTIONS}),
m1 AS (SELECT artifact_id, project_id, raw_text, kind, confidence, regexp_replace(value, '\.+$', '') AS value, start FROM raw_mentions),
m2 AS (SELECT *, start + length(value) AS "end",
  CASE WHEN kind <> 'cost' OR try_cast(regexp_replace(value, '[^0-9.]', '', 'g') AS DOUBLE) IS NULL THEN lower({squeeze("value")})
    ELSE printf('%.2f', try_cast(regexp_replace(value, '[^0-9.]', '', 'g') AS DOUBLE) * CASE WHEN regexp_matches(value, '[kK]\b') THEN 1e3 WHEN regexp_matches(value, '[mM]\b') THEN 1e6 ELSE 1 END) END AS normalized_value FROM m1),
mentions AS (SELECT artifact_id, project_id, kind, value, normalized_value, start, "end",
  substring(raw_text, greatest(start - 40, 0) + 1, least("end" + 40, length(raw_text)) - greatest(start - 40, 0)) AS context, confidence FROM m2),
fs AS (SELECT * FROM (SELECT artifact_id, project_id, fs_created AS ts, 'filesystem' AS source, 0.35 AS confidence, 'Artifact.fs_created' AS evidence, 0 AS ordinal FROM artifacts
  UNION ALL SELECT artifact_id, project_id, fs_modified, 'filesystem', 0.25, 'Artifact.fs_modified', 1 FROM artifacts) WHERE ts IS NOT NULL),
meta AS (SELECT artifact_id, project_id,
    CASE WHEN value LIKE 'D:%' THEN strptime(substr(value, 3), '%Y%m%d%H%M%S') WHEN value LIKE '____:%' THEN strptime(value, '%Y:%m:%d %H:%M:%S') ELSE try_cast(value AS TIMESTAMP) END AS ts,
    'doc_meta' AS source, CASE WHEN key = 'ModDate' THEN 0.55 ELSE 0.7 END AS confidence, concat(key, '=', value) AS evidence, ordinal + 10 AS ordinal FROM metadata WHERE key <> 'Title'),
known AS (SELECT *, CAST(NULL AS TIMESTAMP) AS anchor FROM fs UNION ALL SELECT *, NULL FROM meta),
anchors AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY {_RANK} DESC, confidence DESC, ordinal) AS rn FROM known) WHERE rn = 1),
phrases AS ({_DATES}),
content_dates AS (SELECT p.artifact_id, p.project_id,
    CASE WHEN length(value) = 4 THEN make_timestamp(CAST(value AS BIGINT), 1, 1, 0, 0, 0) WHEN regexp_matches(value, '{_ISO}') THEN try_strptime(value, '%Y-%m-%d') WHEN lower(value) = 'last week' THEN a.ts - INTERVAL 7 DAY ELSE try_strptime(value, '%B %d, %Y') END AS ts,
    'content' AS source, CASE WHEN length(value) = 4 THEN 0.45 WHEN lower(value) = 'last week' THEN 0.6 ELSE 0.85 END AS confidence, value AS evidence, CAST(start + 1000 AS BIGINT) AS ordinal, CASE WHEN lower(value) = 'last week' THEN a.ts END AS anchor
  FROM phrases p LEFT JOIN anchors a USING (artifact_id)),
content_kept AS (SELECT * FROM content_dates WHERE year(ts) BETWEEN 1970 AND 2100),
resolved AS (SELECT * EXCLUDE (rn), rn = 1 AS is_chosen FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY {_RANK} DESC, confidence DESC, ordinal) AS rn FROM (SELECT * FROM known UNION ALL SELECT * FROM content_kept))),
chosen AS (SELECT artifact_id, project_id, ts, source, confidence, evidence, anchor FROM resolved WHERE is_chosen),
templates AS (SELECT * FROM (VALUES {_PHASES}) AS v(phase_id, domain, ordinal, phase_name)),
domains AS (SELECT project_id, CASE WHEN confidence >= 0.5 AND domain IN (SELECT domain FROM templates) THEN domain ELSE 'generic' END AS template_domain FROM classification),
coverage AS (SELECT p.project_id, t.phase_id, t.phase_name, count(DISTINCT a.artifact_id) AS artifacts
  FROM projects p CROSS JOIN phases t LEFT JOIN assignments a ON a.project_id = p.project_id AND a.phase_id = t.phase_id GROUP BY ALL),
all_keys AS (SELECT project_id, artifact_id, lower(trim(original_filename)) AS key, 'filename' AS kind FROM artifacts UNION ALL SELECT project_id, artifact_id, lower(trim(label)), 'title' FROM headings),
match_keys AS (SELECT project_id, key, min(artifact_id) AS dst, min(kind) AS kind FROM all_keys WHERE length(key) >= 6 GROUP BY 1, 2 HAVING count(DISTINCT artifact_id) = 1),
named AS ({spans(r"(?i)note_\d{6}\.txt|Protocol alpha \d{6}", "artifacts", "artifact_id, project_id, raw_text")}),
refs0 AS (SELECT n.project_id, n.artifact_id AS src, k.dst, k.kind, CASE k.kind WHEN 'filename' THEN 0.9 ELSE 0.75 END AS confidence, n.start,
    substring(n.raw_text, greatest(n.start - 40, 0) + 1, least(n.start + length(value) + 40, length(n.raw_text)) - greatest(n.start - 40, 0)) AS evidence
  FROM named n JOIN match_keys k ON n.project_id = k.project_id AND lower(n.value) = k.key WHERE n.artifact_id <> k.dst),
refs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC, start) AS rn FROM refs0) WHERE rn = 1),
oriented AS (SELECT r.*, CASE WHEN a.ts > b.ts THEN 'builds_on' ELSE 'references' END AS edge_type FROM refs r LEFT JOIN chosen a ON a.artifact_id = src LEFT JOIN chosen b ON b.artifact_id = dst),
per AS (SELECT project_id, kind, normalized_value, artifact_id, arg_min(context, start) AS context FROM mentions WHERE kind IN ('experiment', 'hypothesis', 'citation') GROUP BY ALL),
rare AS (SELECT project_id, kind, normalized_value FROM per GROUP BY ALL HAVING count(*) BETWEEN 2 AND 4),
chain0 AS (SELECT p.*, c.ts FROM per p JOIN rare USING (project_id, kind, normalized_value) JOIN chosen c ON c.artifact_id = p.artifact_id),
chain1 AS (SELECT *, lag(artifact_id) OVER w AS dst, lag(ts) OVER w AS before FROM chain0 WINDOW w AS (PARTITION BY project_id, kind, normalized_value ORDER BY ts, artifact_id)),
chain AS (SELECT project_id, artifact_id AS src, dst, 0.55 AS confidence, context AS evidence FROM chain1 WHERE dst IS NOT NULL AND ts > before),
edges AS (SELECT project_id, src, dst, edge_type, confidence, evidence FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC, rank, start, evidence) AS rn FROM (
    SELECT project_id, src, dst, edge_type, confidence, evidence, 0 AS rank, start FROM oriented UNION ALL SELECT project_id, src, dst, 'mentioned_by', confidence, evidence, 1, 0 FROM chain)) WHERE rn = 1 AND src <> dst AND confidence >= 0.5),
last_date AS (SELECT project_id, max(ts) AS latest FROM chosen GROUP BY 1),
profile AS (SELECT v.project_id, v.cluster_id, count(*) AS members, max(c.ts) AS last_active, any_value(l.latest) AS latest, coalesce(v.cluster_id <> -1 AND max(c.ts) >= any_value(l.latest) - INTERVAL 90 DAY, false) AS recent
  FROM vectors v LEFT JOIN chosen c USING (artifact_id) LEFT JOIN last_date l ON l.project_id = v.project_id GROUP BY 1, 2),
member AS (SELECT v.*, c.ts, p.last_active, p.recent AS cluster_recent, p.recent OR (v.cluster_id = -1 AND coalesce(c.ts >= p.latest - INTERVAL 90 DAY, false)) AS recent
  FROM vectors v JOIN profile p USING (project_id, cluster_id) LEFT JOIN chosen c USING (artifact_id)),
unit AS (SELECT project_id, list_transform(CAST(vector AS DOUBLE[]), lambda x: x / sqrt({dot("vector", "vector")})) AS u FROM member WHERE recent),
means AS (SELECT project_id, i, avg(x) AS x FROM (SELECT project_id, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS i FROM unit) GROUP BY 1, 2),
mean_list AS (SELECT project_id, list(x ORDER BY i) AS c FROM means GROUP BY 1),
centroid AS (SELECT project_id, list_transform(c, lambda x: x / sqrt({dot("c", "c")})) AS centroid FROM mean_list),
sig_a AS (SELECT m.artifact_id, m.project_id, CASE WHEN c.centroid IS NULL THEN NULL WHEN m.recent THEN 0.6 + 0.4 * sim ELSE 0.4 * sim END AS signal_a
  FROM (SELECT m.*, c.centroid, greatest(0.0, least(1.0, ({dot("m.vector", "c.centroid")} / sqrt({dot("m.vector", "m.vector")}) / sqrt({dot("c.centroid", "c.centroid")}) + 1) / 2)) AS sim FROM member m LEFT JOIN centroid c USING (project_id)) m LEFT JOIN centroid c USING (project_id)),
emb AS (SELECT v.artifact_id, v.project_id, c.ts FROM vectors v LEFT JOIN chosen c USING (artifact_id)),
sig_small AS (SELECT artifact_id, project_id, CASE WHEN ts IS NULL THEN NULL WHEN max(ts) OVER w = min(ts) OVER w THEN 0.5 ELSE (epoch_us(ts) - epoch_us(min(ts) OVER w)) / CAST(epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w) AS DOUBLE) END AS signal_a FROM emb WINDOW w AS (PARTITION BY project_id)),
later_ref AS (SELECT e.dst AS artifact_id, max(s.ts) AS last_ref FROM edges e JOIN chosen s ON s.artifact_id = e.src LEFT JOIN chosen o ON o.artifact_id = e.dst WHERE o.ts IS NULL OR s.ts > o.ts GROUP BY 1),
sig_b AS (SELECT v.artifact_id, v.project_id, CASE WHEN coalesce(r.last_ref, c.ts) IS NOT NULL THEN greatest(0.0, least(1.0, 1 - (epoch_us(l.latest) - epoch_us(coalesce(r.last_ref, c.ts))) / 86400e6 / 90)) END AS signal_b, r.last_ref
  FROM vectors v LEFT JOIN chosen c USING (artifact_id) LEFT JOIN later_ref r USING (artifact_id) LEFT JOIN last_date l ON l.project_id = v.project_id),
sizes AS (SELECT project_id, count(*) < 6 AS small FROM vectors GROUP BY 1),
both_signals AS (SELECT v.artifact_id, v.project_id, s.small, CASE WHEN s.small THEN ss.signal_a ELSE sa.signal_a END AS a, sb.signal_b AS b
  FROM vectors v JOIN sizes s USING (project_id) JOIN sig_a sa ON sa.artifact_id = v.artifact_id JOIN sig_small ss ON ss.artifact_id = v.artifact_id JOIN sig_b sb ON sb.artifact_id = v.artifact_id),
scored AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b) END AS score,
  CASE WHEN small AND a IS NOT NULL THEN least(CASE WHEN b IS NOT NULL THEN 1 - abs(a - b) ELSE 0.6 END, 0.35) WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 - abs(a - b) ELSE 0.6 END AS sure FROM both_signals),
labels0 AS (SELECT artifact_id, project_id, CASE WHEN score IS NULL OR sure < 0.3 THEN 'unclear' WHEN score >= 0.6 THEN 'current' WHEN score <= 0.4 AND NOT small THEN 'superseded' ELSE 'unclear' END AS label, CASE WHEN score IS NULL THEN 0.0 ELSE sure END AS confidence, a AS signal_a, b AS signal_b FROM scored),
latest_feedback AS (SELECT artifact_id, any_value(project_id) AS project_id, arg_max(label, given_at) AS label FROM feedback GROUP BY 1),
labels AS (SELECT *, false AS confirmed FROM labels0 WHERE artifact_id NOT IN (SELECT artifact_id FROM latest_feedback) UNION ALL SELECT artifact_id, project_id, label, 1.0, NULL, NULL, true FROM latest_feedback),
promise_spans AS (SELECT artifact_id, project_id, start, start + length(value) AS "end" FROM ({_PROMISES})),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY artifact_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY artifact_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 20 THEN 0 ELSE 1 END AS fresh FROM promise_spans)),
merged AS (SELECT artifact_id, project_id, min(start) AS start, max("end") AS "end" FROM islands GROUP BY artifact_id, project_id, island),
around AS (SELECT m.*, raw_text AS t, greatest(m.start - 200, 0) AS lo, least(m."end" + 200, length(raw_text)) AS hi FROM merged m JOIN artifacts a USING (artifact_id)),
bounds AS (SELECT artifact_id, project_id, t, "end", lo + length(regexp_extract(replace(substring(t, lo + 1, start - lo), chr(10) || chr(10), '.' || chr(10)), '(?s)^(.*[.!?])', 1)) AS l,
    CASE WHEN regexp_matches(after, '[.!?]') THEN "end" + length(regexp_extract(after, '(?s)^([^.!?]*[.!?])', 1)) ELSE hi END AS r
  FROM (SELECT *, replace(substring(t, "end" + 1, hi - "end"), chr(10) || chr(10), '.' || chr(10)) AS after FROM around)),
promises AS (SELECT artifact_id, project_id, start, evidence FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, lower({squeeze("evidence")}) ORDER BY start) AS rn FROM (
    SELECT artifact_id, project_id, l + length(substring(t, l + 1, "end" - l)) - length(regexp_replace(substring(t, l + 1, "end" - l), '^\s+', '')) AS start, trim(regexp_replace(substring(t, l + 1, r - l), '^\s+', '')) AS evidence FROM bounds)) WHERE rn = 1),
later AS (SELECT s.artifact_id, s.project_id, a.artifact_id AS later_id, d.ts AS later_ts FROM (SELECT DISTINCT artifact_id, project_id FROM promises) s LEFT JOIN chosen o USING (artifact_id)
  JOIN artifacts a ON a.project_id = s.project_id AND a.artifact_id <> s.artifact_id LEFT JOIN chosen d ON d.artifact_id = a.artifact_id WHERE o.ts IS NULL OR d.ts > o.ts),
tokens AS (SELECT artifact_id, start, list_filter(list_distinct(regexp_extract_all(lower(evidence), '[a-z]{{4,}}')), lambda w: w NOT IN ({_STOP})) AS tokens FROM promises),
shares AS (SELECT t.artifact_id, t.start, max(len(list_filter(t.tokens, lambda w: contains(lower(a.raw_text), w))) / len(t.tokens)) AS best
  FROM tokens t JOIN later l USING (artifact_id) JOIN artifacts a ON a.artifact_id = l.later_id WHERE len(t.tokens) > 0 GROUP BY 1, 2),
fulfilled AS (SELECT p.*, coalesce(s.best, 0) AS best, coalesce(s.best, 0) >= 0.6 AS fulfilled FROM promises p LEFT JOIN shares s USING (artifact_id, start)),
promised AS (SELECT project_id, 'promised_unfulfilled' AS type, CAST(NULL AS INT) AS phase_id, evidence AS description, CAST(artifact_id AS VARCHAR) AS evidence, CASE WHEN artifact_id IN (SELECT artifact_id FROM later) THEN 0.35 ELSE 0.55 END AS confidence FROM fulfilled WHERE NOT fulfilled),
totals AS (SELECT project_id, count(*) AS n FROM artifacts GROUP BY 1),
structural AS (SELECT c.project_id, 'structural' AS type, phase_id,
    CASE WHEN artifacts = 0 THEN concat('No artifacts detected for the ''', phase_name, ''' phase.') ELSE concat('Only ', artifacts, ' artifact(s) detected for the ''', phase_name, ''' phase (expected at least 2).') END AS description,
    concat(artifacts, ' of ', n, ' project artifact(s) mapped to phase ''', phase_name, ''' via PhaseAssignment (threshold: 2).') AS evidence, CASE WHEN artifacts = 0 THEN 0.9 ELSE 0.7 END AS confidence
  FROM coverage c JOIN totals USING (project_id) WHERE artifacts < 2),
drafts AS (SELECT * FROM structural UNION ALL SELECT * FROM promised),
events AS (SELECT r.project_id, r.artifact_id, ts AS event_date, CASE WHEN is_chosen THEN concat('placement:', source) ELSE 'content_described' END AS source,
    CASE WHEN NOT is_chosen THEN evidence WHEN source = 'content' THEN concat(original_filename, ' — ', evidence) ELSE original_filename END AS description, r.confidence
  FROM resolved r JOIN artifacts a USING (artifact_id) WHERE is_chosen OR source = 'content'),
current_versions AS (SELECT * FROM (SELECT *, lead(version_id) OVER (PARTITION BY artifact_id ORDER BY version) AS superseded_by FROM versions) WHERE superseded_by IS NULL),
names AS (SELECT a.artifact_id, coalesce(nullif(v.suggested_name, ''), a.original_filename) AS name FROM artifacts a LEFT JOIN current_versions v USING (artifact_id)),
categories AS (SELECT artifact_id, phase_name AS category FROM (SELECT a.*, p.phase_name, row_number() OVER (PARTITION BY artifact_id ORDER BY confidence DESC, source = 'human' DESC, phase_id, phase_id DESC) AS rn FROM assignments a JOIN phases p USING (phase_id)) WHERE rn = 1),
top_own AS (SELECT artifact_id, kind, normalized_value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY n DESC, kind, normalized_value) AS rank FROM (SELECT artifact_id, kind, normalized_value, count(*) AS n FROM mentions GROUP BY ALL)) WHERE rank <= 3),
slugs AS (SELECT a.artifact_id, a.project_id, c.ts, trim(regexp_replace(lower(regexp_replace(original_filename, '\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
    trim(regexp_replace(lower(coalesce(t.normalized_value, '')), '[^a-z0-9]+', '-', 'g'), '-') AS tag, coalesce(g.category, 'Uncategorized') AS category
  FROM artifacts a LEFT JOIN chosen c USING (artifact_id) LEFT JOIN top_own t ON t.artifact_id = a.artifact_id AND t.rank = 1 LEFT JOIN categories g ON g.artifact_id = a.artifact_id),
views AS (SELECT *, concat(category, '/', coalesce(strftime(ts, '%Y-%m'), 'undated'), '/', suggested_name) AS virtual_path FROM (
    SELECT artifact_id, project_id, category, ts, concat(coalesce(strftime(ts, '%Y-%m-%d') || '_', ''), trim(substring(CASE WHEN tag <> '' AND NOT contains(slug, tag) THEN concat(slug, '-', tag) ELSE slug END, 1, greatest(1, 80 - 4 - CASE WHEN ts IS NULL THEN 0 ELSE 11 END)), '-'), '.txt') AS suggested_name FROM slugs)),
span AS (SELECT project_id, min(event_date) AS earliest, max(event_date) AS latest, CAST(floor((epoch_us(max(event_date)) - epoch_us(min(event_date))) / 86400000000) AS BIGINT) AS days FROM events WHERE source LIKE 'placement:%' GROUP BY 1)
"""


def oracle(select: str, recursive: str = "") -> str:
    more = f", {recursive}" if recursive else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + RELATIONS.replace("sha2_256(raw_text)", "sha256(raw_text)") + ", " + DERIVED + more + " " + select
