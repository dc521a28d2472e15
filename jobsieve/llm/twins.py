"""SQL twin of problem 7: every part of every value compared with every name, without keys or segments."""

from __future__ import annotations

from jobsieve.llm import canonical as C


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fold(x: str) -> str:
    return C.FOLD.replace("{x}", x)


def _key(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, chr(39), ''), '[^a-z0-9]+', ' ', 'g'))"


def _values(field: str) -> str:
    strip = _quoted(C.PARTS[field])
    part = f"trim(regexp_replace(regexp_replace({_fold('trim(x)')}, {strip}, '', 'g'), {strip}, '', 'g'))"
    split = f"regexp_split_to_array(replace(lower(trim(raw)), 'a/d ', 'a. d. '), {_quoted(C.SPLIT)})"
    return f"SELECT '{field}' AS field_name, raw, unnest(list_filter(list_transform({split}, lambda x: {part}), lambda x: x <> '')) AS part FROM (SELECT DISTINCT {field} AS raw FROM jobs WHERE {field} IS NOT NULL)"


_LETTERS = r"regexp_replace({x}, '([a-z])', '\1[a-z]*', 'g')"
_INITIALS = r"regexp_replace(ref_key, '([a-z])[a-z]*( |$)', '\1', 'g')"
_SHORT = _LETTERS.replace("{x}", "t")
_DOTTED = "array_to_string(list_transform(string_split(t, '.')[:-2], lambda g: " + _LETTERS.replace("{x}", "g") + "), '') || string_split(t, '.')[-1]"
_PATTERN = f"""trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(part, '[^a-z0-9.]+', ' ', 'g'), ' '),
  lambda t: CASE WHEN NOT contains(t, '.') AND length(t) <= 3 AND length(key) > 3 THEN {_SHORT} WHEN contains(t, '.') THEN {_DOTTED} ELSE t END), ' '), ' +', ' ', 'g'))"""


def canonical_sql() -> str:
    """A statement up to its last WITH table, mapped (job_id, field_name, raw, ref_id)."""
    return f"""
WITH names AS (SELECT 'location' AS field_name, place_id AS ref_id, place_name AS name, true AS main FROM ref_places UNION ALL SELECT 'location', place_id, alt_name, false FROM ref_places
  UNION ALL SELECT 'job_type', type_id, type_name, true FROM ref_job_types UNION ALL SELECT 'job_type', type_id, unnest(string_split(alt_names, '|')), false FROM ref_job_types),
refs AS (SELECT DISTINCT field_name, ref_id, {_key(_fold("name"))} AS key FROM (SELECT field_name, ref_id, unnest([name, replace(replace(replace(lower(name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')]) AS name FROM names WHERE name IS NOT NULL) WHERE {_key(_fold("name"))} <> ''),
vals AS ({_values("location")} UNION ALL {_values("job_type")}),
parts AS (SELECT DISTINCT field_name, part, {_key("part")} AS key FROM vals WHERE {_key("part")} <> ''),
equal AS (SELECT p.field_name, p.part, r.ref_id, 0 AS rule, 0 AS cost FROM parts p JOIN refs r ON p.field_name = r.field_name AND p.key = r.key),
rest AS (SELECT p.*, {_PATTERN} AS pattern FROM parts p WHERE NOT EXISTS (SELECT 1 FROM equal e WHERE e.field_name = p.field_name AND e.part = p.part)),
met AS (SELECT p.field_name, p.part, p.key, p.pattern, r.ref_id, r.key AS ref_key, CASE WHEN abs(length(p.key) - length(r.key)) <= {C.EDITS} THEN levenshtein(p.key, r.key) ELSE 99 END AS d FROM rest p JOIN refs r ON p.field_name = r.field_name),
spelled AS (SELECT field_name, part, ref_id, 1 AS rule, d AS cost FROM met WHERE length(key) >= 4 AND length(ref_key) >= 4 AND (d = 1 OR (d = 2 AND (least(length(key), length(ref_key)) >= {C.LONG} OR list_sort(string_split(key, '')) = list_sort(string_split(ref_key, '')))))),
short AS (SELECT field_name, part, ref_id, length(ref_key) AS l, CASE WHEN regexp_matches(ref_key, '^' || pattern || '$') AND pattern <> key AND length(key) >= 4 THEN 2 WHEN field_name = 'job_type' AND length(key) >= 4 AND starts_with(ref_key, key) THEN 3
  WHEN field_name = 'job_type' AND length(key) BETWEEN 2 AND 3 AND key = {_INITIALS} THEN 3 WHEN field_name = 'job_type' AND length(split_part(key, ' ', 1)) >= 4 AND starts_with(ref_key, split_part(key, ' ', 1) || ' ') THEN 4
  WHEN field_name = 'job_type' AND length(key) >= 6 AND starts_with(ref_key, substring(key, 1, 6)) THEN 6 END AS rule FROM met),
tokens AS (SELECT field_name, part, ref_id, 5 AS rule, length(ref_key) AS cost FROM met WHERE field_name = 'job_type' AND contains(key, ' ') AND list_contains(string_split(key, ' '), ref_key) AND length(ref_key) >= 5),
found AS (SELECT * FROM equal UNION ALL SELECT * FROM spelled UNION ALL SELECT * FROM tokens UNION ALL SELECT field_name, part, ref_id, rule, CASE WHEN rule IN (4, 6) THEN 0 ELSE l END FROM short WHERE rule IS NOT NULL),
whole AS (SELECT v.field_name, v.raw, f.ref_id, min(f.rule * 1000 + f.cost) AS best FROM vals v JOIN found f ON v.field_name = f.field_name AND v.part = f.part GROUP BY ALL),
lowest AS (SELECT field_name, raw, min(best) AS best FROM whole GROUP BY ALL),
matched AS (SELECT w.field_name, w.raw, min(w.ref_id) AS ref_id FROM whole w JOIN lowest b ON w.field_name = b.field_name AND w.raw = b.raw AND w.best = b.best GROUP BY ALL HAVING count(DISTINCT w.ref_id) = 1),
typed AS (SELECT job_id, 'location' AS field_name, location AS raw FROM jobs UNION ALL SELECT job_id, 'job_type', job_type FROM jobs),
mapped AS (SELECT t.job_id, t.field_name, t.raw, CAST(coalesce(m.ref_id, -1) AS INT) AS ref_id FROM typed t LEFT JOIN matched m ON t.field_name = m.field_name AND t.raw = m.raw
  WHERE t.raw IS NOT NULL AND regexp_matches(t.raw, '[^\\s\\x{{00a0}}]') AND NOT EXISTS (SELECT 1 FROM names n WHERE n.main AND n.field_name = t.field_name AND n.name = t.raw))"""
