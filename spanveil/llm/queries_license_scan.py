"""Query op7 over ``documents``.

The table has no paths, so each document gets one: ``source/lang/doc_id.txt``
(a level without value is left out); a document of which the licence lines are at
least half stands as the licence file of its directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.license_scan import HEADER, TEMPLATES, TERM, THRESHOLD, header_of, scan_licences
from spanveil.storage import table


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    half = 2 * F.length(header_of(F.col("text"), F.lit(False))) >= F.length("text")
    mostly = F.coalesce(half & (F.length("text") > 0), F.lit(False))
    name = F.when(mostly, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licences(docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", name).alias("path")))


_VALUES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
_HEADER, _TERM = HEADER.removeprefix("(?i)"), TERM

SQL = f"""
WITH templates(template, licence, text) AS (VALUES {_VALUES}),
lines AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_HEADER}', 'i')) AS kept
  FROM documents
), named AS (
  SELECT doc_id, text, array_to_string(kept, chr(10)) AS header,
         length(text) > 0 AND 2 * length(array_to_string(kept, chr(10))) >= length(text) AS is_file,
         concat_ws('/', source, lang) AS dir
  FROM lines
), files AS (
  SELECT doc_id, is_file, dir, CASE WHEN is_file THEN text ELSE header END AS header,
         concat_ws('/', nullif(dir, ''), CASE WHEN is_file THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END) AS path
  FROM named
), terms AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(header), '{_TERM}')) AS term FROM files WHERE header <> '')
  GROUP BY ALL
), n AS (SELECT count(DISTINCT doc_id) AS n FROM terms),
idf AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (count(*) + 1)) + 1 AS idf FROM terms GROUP BY term),
weighed AS (SELECT doc_id, term, tf * idf AS w FROM terms JOIN idf USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY doc_id),
template_terms AS (
  SELECT template, licence, term, count(*) * any_value(coalesce(idf, ln(1.0 + (SELECT n FROM n)) + 1)) AS tw
  FROM (SELECT template, licence, unnest(regexp_extract_all(lower(text), '{_TERM}')) AS term FROM templates) LEFT JOIN idf USING (term)
  GROUP BY template, licence, term
), template_norms AS (SELECT template, sqrt(sum(tw * tw)) AS tn FROM template_terms GROUP BY template),
scored AS (
  SELECT doc_id, licence, max(score) AS score FROM (
    SELECT doc_id, template, licence, round(sum(w * tw) / (any_value(norm) * any_value(tn)), 6) AS score
    FROM weighed JOIN template_terms USING (term) JOIN norms USING (doc_id) JOIN template_norms USING (template)
    GROUP BY doc_id, template, licence)
  GROUP BY doc_id, licence
), best AS (
  SELECT doc_id, licence, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1
), own AS (SELECT f.*, b.licence, b.score FROM files f LEFT JOIN best b ON b.doc_id = f.doc_id AND b.score >= {THRESHOLD}),
dirs AS (
  SELECT dir, licence AS dir_licence FROM (SELECT dir, licence, count(*) AS c FROM own WHERE is_file AND licence IS NOT NULL GROUP BY dir, licence)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY c DESC, licence) = 1
), near AS (
  SELECT o.doc_id, d.dir AS licence_dir, d.dir_licence
  FROM own o JOIN dirs d ON o.licence IS NULL AND (o.dir = d.dir OR d.dir = '' OR starts_with(o.dir, d.dir || '/'))
  QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY length(d.dir) DESC) = 1
)
SELECT o.doc_id, o.path, coalesce(o.licence, near.dir_licence) AS licence, o.score,
       CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN near.dir_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       near.licence_dir
FROM own o LEFT JOIN near USING (doc_id)
"""
