"""Freely typed values mapped to a reference list (problem 7), in SQL only.

Distinct values are folded (case, accents, transliterated umlauts) and cut into parts at separators; prefixes such as
postcodes and words around a name are dropped. A part names an entry by the first rule that fits: equal; spelled with up to
two edits; written in short (by equal initials, first words or beginnings). Edits are found by the partition-based pigeonhole join: each reference string is cut into k+1
segments, one of which must stand unchanged in any string within k edits, at a position bounded by the difference in
length; segments and positional substrings are joined by equality and the pairs verified with levenshtein. Values
without an entry are reported through an anti-join.

The reference list goes to all workers if it has at most SENT_NAMES names; every other join, and all of them for a longer
list, shuffles the distinct values, which are few beside the rows. Steps are written to a folder of their own, which is
removed when the mapping is done.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame

from jobsieve.session import Scratch, write_once

#: Edits tolerated; a reference string is cut into one segment more.
EDITS = 2
#: Names of a reference list that are sent to all workers at most.
SENT_NAMES = 200_000
#: Strings shorter than this need one edit or a swap of neighbours at most.
LONG = 9

#: Folding of letters: accents off. References are entered with plain and with transliterated umlauts (u, ue).
FOLD = r"replace(translate(lower({x}), 'äáàâãåëéèêïíìîöóòôõøüúùûñçœæ’´`', 'aaaaaaeeeeiiiioooooouuuuncoa'), 'ß', 'ss')"

PARTS = {
    "location": (
        r"^(?:[a-z]{1,2}[- ])?\d{4,6}\s+|^(?:region|raum|grossraum|greater|near|bei|nahe|naehe|nahe bei|metropolregion|zona|region de|regio|provincia di|area)\s+|"
        r"\s+(?:und umgebung|and surroundings|umgebung|umland|area|metropolitan area|metro|vor ort|on site|onsite|hybrid|remote|home[- ]?office|region)$|[- ](?:mitte|nord|sud|sued|ost|west|zentrum|centre|center|centro|innenstadt)$|[.\s]+$"
    ),
    "job_type": r"^(?:art|type|typ|tipo|status)\s*:?\s+|\s+(?:gesucht|wanted|ab sofort)$|\s*\b\d+(?:[.,]\d+)?\s*(?:h|std|stunden|hrs|hours|heures|monate|months|mois|%|prozent)\b.*$|[*!\s]+$",
}
SPLIT = r"[,;|()\[\]{}/+:#*]+|\s+[-–—]\s+"

VALUES = """
SELECT field_name, raw, explode(filter(transform(split(replace(lower(trim(raw)), 'a/d ', 'a. d. '), '{split}'), x -> trim(regexp_replace(regexp_replace({fold}, '{strip}', ''), '{strip}', ''))), x -> x <> '')) AS part
FROM (SELECT DISTINCT '{field}' AS field_name, {field} AS raw FROM {rows} WHERE {field} IS NOT NULL)
"""

KEY = r"""trim(regexp_replace(replace({x}, "'", ''), '[^a-z0-9]+', ' '))"""

#: The steps of the match; each is written once, so that none is computed again for every later use.
STEPS = {
    "refs": """
  SELECT DISTINCT field_name, ref_id, {ref_key} AS key FROM (
    SELECT field_name, ref_id, explode(array(name, replace(replace(replace(lower(name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'))) AS name FROM {names} WHERE name IS NOT NULL
  ) WHERE {ref_key} <> ''
""",
    "parts": """
  SELECT DISTINCT field_name, part, {part_key} AS key FROM {values} WHERE {part_key} <> ''
""",
    "equal": """
  SELECT {send} p.field_name, p.part, r.ref_id, 0 AS rule, 0 AS cost FROM {parts} p JOIN {refs} r ON p.field_name = r.field_name AND p.key = r.key
""",
    "rest": """
  SELECT /*+ MERGE(p, e) */ p.* FROM {parts} p LEFT ANTI JOIN {equal} e ON p.field_name = e.field_name AND p.part = e.part
""",
    "spelled": """
WITH keyed AS (
  SELECT DISTINCT field_name, key, length(key) AS len FROM {rest} WHERE length(key) >= 4
), segments AS (
  SELECT field_name, ref_id, key, length(key) AS len, i, 1 + i * (length(key) div {pieces}) AS pos,
         IF(i = {edits}, length(key) - i * (length(key) div {pieces}), length(key) div {pieces}) AS width
  FROM {refs} LATERAL VIEW explode(sequence(0, {edits})) AS i WHERE length(key) >= 4
), shapes AS (
  SELECT DISTINCT field_name, len, i, pos, width FROM segments
), probes AS (
  SELECT /*+ BROADCAST(s) */ k.field_name, k.key, s.len AS ref_len, s.i, substring(k.key, at, s.width) AS seg
  FROM keyed k JOIN (SELECT *, explode(sequence(len - {edits}, len + {edits})) AS value_len FROM shapes) s ON k.field_name = s.field_name AND k.len = s.value_len
  LATERAL VIEW explode(sequence(greatest(1, s.pos - ({edits} - (k.len - s.len)) div 2), least(k.len, s.pos + ({edits} + (k.len - s.len)) div 2))) AS at
), near AS (
  SELECT {send} DISTINCT p.field_name, p.key, r.key AS ref_key, r.ref_id
  FROM probes p JOIN segments r ON p.field_name = r.field_name AND p.ref_len = r.len AND p.i = r.i AND p.seg = substring(r.key, r.pos, r.width)
), verified AS (
  SELECT field_name, key, ref_key, ref_id, levenshtein(key, ref_key, {edits}) AS d FROM near
)
  SELECT /*+ MERGE(t, v) */ t.field_name, t.part, v.ref_id, 1 AS rule, v.d AS cost
  FROM {rest} t JOIN verified v ON t.field_name = v.field_name AND t.key = v.key
  WHERE v.d = 1 OR (v.d = 2 AND (least(length(v.key), length(v.ref_key)) >= {long} OR array_sort(split(v.key, '')) = array_sort(split(v.ref_key, ''))))
""",
    "shortened": """
WITH short AS (
  SELECT field_name, part, key, regexp_replace(trim(regexp_replace(regexp_replace(part, '([a-z])[.](?=[a-z0-9])', '$1'), '[^a-z0-9]+', ' ')), '([a-z0-9])[a-z0-9]*( |$)', '$1') AS initials,
         trim(regexp_replace(array_join(transform(split(regexp_replace(part, '[^a-z0-9.]+', ' '), ' '), t -> IF(t NOT LIKE '%.%' AND length(t) <= 3 AND length(key) > 3, regexp_replace(t, '([a-z])', '$1[a-z]*'), replace(regexp_replace(t, '([a-z])(?=[a-z]*[.])', '$1[a-z]*'), '.', ''))), ' '), ' +', ' ')) AS pattern
  FROM {rest}
), asked AS (
  SELECT *, explode(filter(array(IF(part LIKE '%.' OR length(split_part(key, ' ', -1)) <= 3, concat('words ', initials), concat('words ', initials, ' ', right(key, 3))), IF(field_name = 'job_type' AND length(key) BETWEEN 2 AND 3, concat('words ', key), NULL),
         IF(field_name = 'job_type' AND length(key) >= 4, concat('start ', substring(key, 1, 4)), NULL)), x -> x IS NOT NULL)) AS at FROM short
), named AS (
  SELECT field_name, ref_id, key, explode(array(concat('words ', initials), concat('words ', initials, ' ', right(key, 3)), concat('start ', substring(key, 1, 4)))) AS at
  FROM (SELECT *, regexp_replace(key, '([a-z0-9])[a-z0-9]*( |$)', '$1') AS initials FROM {refs})
), met AS (
  SELECT {send} s.field_name, s.part, r.ref_id, s.key, s.pattern, r.key AS ref_key FROM asked s JOIN named r ON s.field_name = r.field_name AND s.at = r.at
)
  SELECT DISTINCT field_name, part, ref_id,
         CASE WHEN ref_key RLIKE concat('^', pattern, '$') AND pattern <> key AND length(key) >= 4 THEN 2
              WHEN field_name = 'job_type' AND length(key) >= 4 AND startswith(ref_key, key) THEN 3
              WHEN field_name = 'job_type' AND length(key) <= 3 AND key = regexp_replace(ref_key, '([a-z])[a-z]*( |$)', '$1') AND length(key) > 1 THEN 3
              WHEN field_name = 'job_type' AND length(split_part(key, ' ', 1)) >= 4 AND startswith(ref_key, concat(split_part(key, ' ', 1), ' ')) THEN 4
              WHEN field_name = 'job_type' AND length(key) >= 6 AND startswith(ref_key, substring(key, 1, 6)) THEN 6
         END AS rule, length(ref_key) AS length_
  FROM met
""",
    "tokens": """
  SELECT {send} t.field_name, t.part, r.ref_id, 5 AS rule, length(r.key) AS cost
  FROM (SELECT field_name, part, key, explode(split(key, ' ')) AS token FROM {rest} WHERE field_name = 'job_type' AND key LIKE '% %') t
  JOIN {refs} r ON t.field_name = r.field_name AND t.token = r.key WHERE length(t.token) >= 5
""",
    "whole": """
WITH found AS (
  SELECT * FROM {equal} UNION ALL SELECT * FROM {spelled} UNION ALL SELECT * FROM {tokens}
  UNION ALL SELECT field_name, part, ref_id, rule, IF(rule IN (4, 6), 0, length_) FROM {shortened} WHERE rule IS NOT NULL
)
  SELECT /*+ MERGE(v, f) */ v.field_name, v.raw, f.ref_id, min(struct(f.rule, f.cost)) AS best
  FROM {values} v JOIN found f ON v.field_name = f.field_name AND v.part = f.part GROUP BY v.field_name, v.raw, f.ref_id
""",
    "matched": """
WITH best AS (
  SELECT field_name, raw, min(best) AS least FROM {whole} GROUP BY field_name, raw
)
SELECT /*+ MERGE(w, b) */ w.field_name, w.raw, min(w.ref_id) AS ref_id
FROM {whole} w JOIN best b ON w.field_name = b.field_name AND w.raw = b.raw AND w.best = b.least
GROUP BY w.field_name, w.raw HAVING count(DISTINCT w.ref_id) = 1
""",
}

RESULT = """
SELECT DISTINCT {id_col}, field_name, ref_id FROM (
  SELECT {id_col}, 'location' AS field_name, location AS raw FROM {rows} UNION ALL SELECT {id_col}, 'job_type' AS field_name, job_type AS raw FROM {rows}
) r JOIN {mapping} m USING (field_name, raw)
"""


def _sql(text: str, **frames: DataFrame) -> DataFrame:
    """Run a statement whose {names} stand for frames."""
    spark = next(iter(frames.values())).sparkSession
    views = []
    for name, frame in frames.items():
        view = f"jobsieve_{name}_{uuid4().hex}"
        frame.createOrReplaceTempView(view)
        views.append(view)
        text = text.replace("{" + name + "}", view)
    out = spark.sql(text)  # names are resolved here, so that the views are not needed any longer
    for view in views:
        spark.catalog.dropTempView(view)
    return out


def reference_names(places: DataFrame, types: DataFrame) -> DataFrame:
    """(field_name, ref_id, name, main): every name of every entry; main for the entry's own name."""
    return _sql(
        """
        SELECT 'location' AS field_name, CAST(place_id AS INT) AS ref_id, place_name AS name, true AS main FROM {places}
        UNION ALL SELECT 'location', CAST(place_id AS INT), alt_name, false FROM {places}
        UNION ALL SELECT 'job_type', CAST(type_id AS INT), type_name, true FROM {types}
        UNION ALL SELECT 'job_type', CAST(type_id AS INT), explode(split(alt_names, '[|]')), false FROM {types}
        """,
        places=places, types=types,
    )


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def typed_values(rows: DataFrame) -> DataFrame:
    """(field_name, raw, part): the parts of every distinct non-blank value."""
    one = lambda field, strip: _sql(VALUES.replace("{fold}", FOLD.replace("{x}", "trim(x)")).replace("{field}", field).replace("{split}", _literal(SPLIT)).replace("{strip}", _literal(strip)), rows=rows)
    return one("location", PARTS["location"]).unionByName(one("job_type", PARTS["job_type"]))


def map_values(rows: DataFrame, names: DataFrame, sent_names: int = SENT_NAMES) -> DataFrame:
    """(field_name, raw, ref_id) of every distinct non-blank value that is no entry's own name; -1 where none is meant.

    A value that fits two entries equally well is reported as -1 as well.
    """
    with Scratch(rows.sparkSession) as scratch:
        frames = {"names": scratch.write(names), "values": scratch.write(typed_values(rows))}
        send = "/*+ BROADCAST(r) */" if frames["names"].count() <= sent_names else "/*+ MERGE(r) */"
        for name, sql in STEPS.items():
            sql = sql.replace("{send}", send).replace("{edits}", str(EDITS)).replace("{pieces}", str(EDITS + 1)).replace("{long}", str(LONG))
            sql = sql.replace("{ref_key}", KEY.replace("{x}", FOLD.replace("{x}", "name"))).replace("{part_key}", KEY.replace("{x}", "part"))
            frames[name] = scratch.write(_sql(sql, **{k: f for k, f in frames.items() if "{" + k + "}" in sql}))
        return write_once(
            _sql(
                """
                WITH typed AS (
                  SELECT DISTINCT field_name, raw FROM (SELECT 'location' AS field_name, location AS raw FROM {rows} UNION ALL SELECT 'job_type', job_type FROM {rows})
                  WHERE raw IS NOT NULL AND raw RLIKE '[^\\\\s\\u00a0]'
                ), r AS (
                  SELECT DISTINCT field_name, name FROM {names} WHERE main
                ), named AS (
                  SELECT {send} t.* FROM typed t LEFT ANTI JOIN r ON t.field_name = r.field_name AND t.raw = r.name
                )
                SELECT /*+ MERGE(n, m) */ n.field_name, n.raw, coalesce(m.ref_id, -1) AS ref_id FROM named n LEFT JOIN {matched} m ON n.field_name = m.field_name AND n.raw = m.raw
                """.replace("{send}", send),
                rows=rows, names=frames["names"], matched=frames["matched"],
            )
        )


def map_to_references(rows: DataFrame, places: DataFrame, types: DataFrame, id_col: str = "job_id") -> DataFrame:
    """Distinct (id_col, field_name, ref_id) of every non-blank value that is not exactly an entry's own name.

    Null and blank values give no row; empty reference lists map everything to -1; repeated rows give one row; null ids
    come out as null; very long values are taken whole.
    """
    base = rows.select(id_col, "location", "job_type")
    mapping = map_values(base, reference_names(places, types))
    return _sql(RESULT.replace("{id_col}", id_col), rows=base, mapping=mapping)
