"""Named queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import encode, entity_match, formatting_copies, mixture, page_lines, reference_map, scan_repair, stuffed_pages, term_counts, unify

Query = Callable[[SparkSession, str], DataFrame]


def _page_texts(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.page_texts(table(spark, d, "scan_log"), table(spark, d, "last_scans"))


def _scan_model(spark: SparkSession, d: str) -> scan_repair.Model:
    """The models, trained on the bounded clean sample of the documents, with what all documents and scans show."""
    docs = table(spark, d, "documents")
    words, trigrams = scan_repair.known_text(docs)
    return scan_repair.fit(scan_repair.clean_sample(docs), words=words, trigrams=trigrams, furniture=page_lines.furniture_words(_page_texts(spark, d)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines with scan noise and the kind of noise."""
    return scan_repair.noisy_lines(_page_texts(spark, d), _scan_model(spark, d))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every page text in continuous paragraphs."""
    return scan_repair.repaired_texts(_page_texts(spark, d), _scan_model(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Values with characters their plain spelling doesn't have."""
    return unify.mixed_values(unify.name_values(table(spark, d, "findings"), table(spark, d, "ingredient_entries"), table(spark, d, "catalog_entries")))


def p2_plain(spark: SparkSession, d: str) -> DataFrame:
    """Every value in its one form."""
    return unify.unified(unify.name_values(table(spark, d, "findings"), table(spark, d, "ingredient_entries"), table(spark, d, "catalog_entries"))).select("field", "row_id", "pos", F.col("val").alias("plain"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common."""
    return p3_counts(spark, d).filter("mark is not null").select("field", "term", "mark")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    return term_counts.scan_and_corpus_terms(table(spark, d, "scan_log"), table(spark, d, "corpus_tokens"))


def _both(spark: SparkSession, d: str, f: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    parts = [f(table(spark, d, name), key).withColumn("src_table", F.lit(name)) for name, key in (("ingredient_entries", "entry_no"), ("catalog_entries", "cat_no"))]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each further copy of a dictionary record with the record that stays."""
    return _both(spark, d, formatting_copies.copies).filter("keep_no <> copy_no").select("src_table", "keep_no", "copy_no")


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Each dictionary record once, with the number of its copies."""
    return _both(spark, d, lambda t, key: formatting_copies.copies(t, key).filter("keep_no = copy_no")).select("src_table", "keep_no", F.col("copies").alias("n_copies"))


def _entered(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings")
    parts = [f.select(F.lit(f"findings.{c}").alias("field"), F.col("finding_id").alias("row_id"), F.lit(0).alias("pos"), F.col(c).alias("val")) for c in ("raw", "matched_term")]
    names = table(spark, d, "ingredient_entries").select(F.lit("ingredient_entries.names").alias("field"), F.col("entry_no").alias("row_id"), F.posexplode("names").alias("pos", "val"))
    return parts[0].unionAll(parts[1]).unionAll(names).filter("val is not null")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean a term of the list without being one of its spellings."""
    return reference_map.spelled_otherwise(_entered(spark, d), table(spark, d, "reference_terms"))


def p6_map(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct value, its rows, and its term; unmatched values have none."""
    return reference_map.mapped_values(_entered(spark, d), table(spark, d, "reference_terms")).withColumn("status", F.when(F.col("term_id").isNull(), "unmatched").otherwise("matched"))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of rows for the same ingredient, with the confidence of the match."""
    return entity_match.matches(table(spark, d, "ingredient_entries"), table(spark, d, "catalog_entries"), "entry_no", "cat_no", (("status", "vegan"), ("category", "vegetarian")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of rows for the same ingredient."""
    return p7_matches(spark, d).select("entry_no", "cat_no")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encoded(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The text of the token ids of every document."""
    return encode.decoded(encode.encoded(table(spark, d, "documents")))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the mixture and how often it is used."""
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), total="all")[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), total="all")[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are mostly repeated keywords, links or tags."""
    return stuffed_pages.stuffed_pages(table(spark, d, "documents")).select("doc_id")


def p10_measures(spark: SparkSession, d: str) -> DataFrame:
    """The measures of those documents and which were too high."""
    return stuffed_pages.stuffed_pages(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_plain, p3_found, p3_counts, p5_found, p5_collapsed, p6_found, p6_map, p7_found, p7_matches, p8_ids, p8_decoded, p9_mixture, p9_report, p10_found, p10_measures)}

_P3 = """
WITH miss AS (SELECT rec_id, unnest(miss) AS term FROM scan_log),
a AS (SELECT 'scan_log.miss' AS field, term, count(*) AS n_occurrences, count(DISTINCT rec_id) AS n_records FROM miss WHERE term IS NOT NULL GROUP BY term),
am AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records > 0.10 * (SELECT count(*) FROM scan_log) THEN 'common' END AS mark FROM a),
b AS (SELECT 'corpus_tokens.raw' AS field, raw AS term, CAST(sum(n) AS BIGINT) AS n_occurrences, count(*) AS n_records FROM corpus_tokens WHERE bucket IS NOT NULL AND raw IS NOT NULL GROUP BY raw),
bm AS (SELECT *, CASE WHEN n_occurrences <= 2 THEN 'rare' WHEN n_occurrences > 0.02 * (SELECT sum(n) FROM corpus_tokens WHERE bucket IS NOT NULL) THEN 'common' END AS mark FROM b)
SELECT {} FROM (SELECT * FROM am UNION ALL SELECT * FROM bm) {}
"""

_PLAIN = "lower(regexp_replace(x, '[\\s\\p{Z}\\p{P}\\x00-\\x1f]+', '', 'g'))"


def _p5(select: str) -> str:
    def form(cols: list[tuple[str, str]]) -> str:
        out = []
        for c, kind in cols:
            if kind == "list":
                v = f"CAST(to_json(list_sort(list_transform({c}, lambda x: coalesce('=' || {_PLAIN}, 'null')))) AS VARCHAR)"
            elif kind == "text":
                v = _PLAIN.replace("(x,", f"({c},")
            else:
                v = f"CAST({c} AS VARCHAR)"
            out.append(f"coalesce('=' || {v}, 'null')")
        return " || chr(1) || ".join(out)

    ie = form([("names", "list"), ("status", "text"), ("confidence", "text"), ("basis", "text"), ("reviewed", "raw"), ("category", "text"), ("reasoning", "text"), ("sources", "list"), ("e_number", "text")])
    ce = form([("names", "list"), ("src", "text"), ("e_number", "text"), ("vegan", "text"), ("vegetarian", "text"), ("palm_oil", "text")])
    return f"""
WITH r AS (SELECT 'ingredient_entries' AS src_table, entry_no AS copy_no, {ie} AS form FROM ingredient_entries
UNION ALL SELECT 'catalog_entries', cat_no, {ce} FROM catalog_entries),
g AS (SELECT src_table, copy_no, min(copy_no) OVER (PARTITION BY src_table, form) AS keep_no, count(*) OVER (PARTITION BY src_table, form) AS n_copies FROM r)
{select}"""


ORACLE: dict[str, str] = {
    "p3_found": _P3.format("field, term, mark", "WHERE mark IS NOT NULL"),
    "p3_counts": _P3.format("*", ""),
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p5_found": _p5("SELECT src_table, keep_no, copy_no FROM g WHERE keep_no <> copy_no"),
    "p5_collapsed": _p5("SELECT src_table, keep_no, n_copies FROM g WHERE keep_no = copy_no"),
}
