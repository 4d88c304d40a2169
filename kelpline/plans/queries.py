"""Named queries of the core, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance, geometry, noise, section, text, tokens
from ..operators import corpus, etl, evaluate, match, pass_join, search
from ..operators.split_values import split_values
from ..sources import files
from ..session import spread, spread_small
from ..sources.tables import table
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(statement: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if statement is not None:
            ORACLE[f.__name__] = statement
        return f

    return add


# --- packed fields ------------------------------------------------------------------------------------


def packed_fields(spark: SparkSession, d: str) -> DataFrame:
    """(field, row_id, elem, text) of every field that may hold several ingredients."""
    ls = table(spark, d, "last_scans").select(F.lit("last_scans.section").alias("field"), F.col("row_id").alias("row_id"), F.lit(0).alias("elem"), F.col("section").alias("text"))
    sl = table(spark, d, "scan_log").select(F.lit("scan_log.section").alias("field"), F.col("rec_id").alias("row_id"), F.lit(0).alias("elem"), F.col("section").alias("text")).filter("not contains(text, '\n')")
    gt = table(spark, d, "gt_records").select(F.lit("gt_records.ingredients").alias("field"), F.col("gt_id").alias("row_id"), F.posexplode("ingredients.raw").alias("elem", "text"))
    return ls.unionAll(sl).unionAll(gt)


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the strings that hold two or more."""
    return split_values(packed_fields(spark, d), min_values=2)


@query()
def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every list, those of one value included."""
    return split_values(packed_fields(spark, d))


def _wide(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table for costly expressions, spread over the cores where its file is too small to be split."""
    return spread(table(spark, d, name))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents, for costly expressions."""
    return _wide(spark, d, "documents")


# --- normalisation ------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {sql.normalized('text')} AS key FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """The normal form of whole texts, without NFKC."""
    return _docs(spark, d).select("doc_id", text.normalized(F.col("text"), compat=False).alias("key"))


@query()
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    """The normal form of every name, with NFKC."""
    ie = table(spark, d, "ingredient_entries").select(F.col("entry_no").alias("no"), F.posexplode("names").alias("pos", "name"))
    ce = table(spark, d, "catalog_entries").select(F.col("cat_no").alias("no"), F.posexplode("names").alias("pos", "name"))
    return ie.unionAll(ce).select("no", "pos", text.normalized(F.col("name")).alias("key"))


@query(f"SELECT finding_id, {sql.folded('raw')} AS folded, {sql.normalized('raw', False)} AS build_key FROM findings")
def phrase_and_char_folds(spark: SparkSession, d: str) -> DataFrame:
    """Folded tokens, and the form dictionaries are built with."""
    return _wide(spark, d, "findings").select("finding_id", text.folded(F.col("raw")).alias("folded"), text.normalized(F.col("raw"), folds=False, compat=False).alias("build_key"))


_GT = "(SELECT gt_id, file_name, unnest(ingredients) AS i, generate_subscripts(ingredients, 1) - 1 AS gi FROM gt_records)"
_FLAT = sql.drop("i.raw", r"[()（）\[\]［］【】]")


@query(
    f"SELECT gt_id, gi, {sql.surface('i.raw')} AS surface, {sql.core('i.raw')} AS core, {_FLAT} AS flat, "
    + sql.drop(sql.surface(sql.drop(f"({sql.core('i.raw')})", r"[()（）\[\]［］【】]")), "[0-9.,]+(%|mg|kg|g|ml)?")
    + f" AS loose FROM {_GT}"
)
def evaluation_forms(spark: SparkSession, d: str) -> DataFrame:
    """The forms in which hand-made items and findings are compared."""
    gt = table(spark, d, "gt_records").select("gt_id", F.posexplode("ingredients.raw").alias("gi", "raw"))
    c = F.col("raw")
    return gt.select("gt_id", F.col("gi").cast("bigint").alias("gi"), text.surface_form(c).alias("surface"), text.core_form(c).alias("core"), text.flat_form(c).alias("flat"), text.loose_form(c).alias("loose"))


_STATUS = [("mush", "doubtful"), ("doubt", "doubtful"), ("suspect", "doubtful"), ("mas", "doubtful"), ("may", "doubtful"), ("y", "listed"), ("n", "refused")]


@query(
    f"SELECT cat_no, {sql.code('e_number')} AS code, CASE "
    + " ".join(f"WHEN starts_with(lower(trim(vegan)), '{p}') THEN '{v}'" for p, v in _STATUS)
    + " ELSE 'unknown' END AS status FROM catalog_entries"
)
def codes_and_status(spark: SparkSession, d: str) -> DataFrame:
    """Additive codes in one spelling, and free-text statuses."""
    return table(spark, d, "catalog_entries").select("cat_no", text.norm_code(F.col("e_number")).alias("code"), text.norm_status(F.col("vegan"), _STATUS).alias("status"))


_SLUG = f"substr({sql.drop(sql.normalized('term_ja'), '[^0-9a-z぀-ヿ㐀-鿿]')}, 1, 24)"


@query(f"SELECT term_id, CASE WHEN {_SLUG} = '' THEN 'x' ELSE {_SLUG} END AS slug FROM reference_terms")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    """Short ids from names."""
    return table(spark, d, "reference_terms").select("term_id", text.slug(F.col("term_ja")).alias("slug"))


@query("SELECT gt_id, lower(trim(replace(file_name, chr(92), '/'))) AS path, regexp_extract(lower(trim(replace(file_name, chr(92), '/'))), '([^/]*)$', 1) AS base FROM gt_records")
def paths(spark: SparkSession, d: str) -> DataFrame:
    """File paths in one form."""
    return table(spark, d, "gt_records").select("gt_id", text.norm_path(F.col("file_name")).alias("path"), text.basename(F.col("file_name")).alias("base"))


@query(
    r"""WITH h AS (SELECT rec_id, unnest(hits) AS hit, generate_subscripts(hits, 1) - 1 AS pos FROM scan_log)
SELECT rec_id, pos, regexp_extract(hit, '^(.+)=([^=]*)\(([^(]*)\)[^)]*$', 1) AS raw, regexp_extract(hit, '^(.+)=([^=]*)\(([^(]*)\)[^)]*$', 2) AS status,
regexp_extract(hit, '^(.+)=([^=]*)\(([^(]*)\)[^)]*$', 3) AS entry_id FROM h WHERE regexp_matches(hit, '^(.+)=([^=]*)\(([^(]*)\)[^)]*$')"""
)
def finding_tokens(spark: SparkSession, d: str) -> DataFrame:
    """raw=status(entry) tokens taken apart."""
    h = table(spark, d, "scan_log").select("rec_id", F.posexplode("hits").alias("pos", "hit"))
    return h.select("rec_id", F.col("pos").cast("bigint").alias("pos"), text.finding_token(F.col("hit")).alias("t")).filter("t is not null").select("rec_id", "pos", "t.*")


# --- sections -----------------------------------------------------------------------------------------

_M = section.DEFAULT
_LINES = "regexp_split_to_array(text, '\\r?\\n')"


@query(
    f"""WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, {sql.q(_M.start)})), true) AS k0 FROM l),
r AS (SELECT doc_id, ls[k0] AS head, ls[k0 + 1:] AS rest FROM a WHERE k0 > 0),
s AS (SELECT doc_id, head, rest, list_position(list_transform(rest, lambda x: regexp_matches(x, {sql.q(_M.stop)}) OR regexp_matches(x, {sql.q(_M.digits)})), true) AS stop FROM r)
SELECT doc_id, regexp_replace(head, {sql.q('^.*?' + _M.start)}, '') || coalesce(array_to_string(list_transform(CASE WHEN stop > 0 THEN rest[:stop - 1] ELSE rest END, lambda x: regexp_replace(x, '^[|｜\\s　]+', '')), ''), '') AS listed FROM s"""
)
def section_after_header(spark: SparkSession, d: str) -> DataFrame:
    """What stands between the header of the list and the next part of the label."""
    docs = _docs(spark, d).filter("text is not null")
    cut = docs.select("doc_id", section.lines_of(F.col("text")).alias("ls")).withColumn("k", section.first_index(F.col("ls"), _M.start)).filter("k > 0")
    return cut.select("doc_id", section.listed_after(F.col("ls"), F.col("k")).alias("listed"))


@query()
def section_extract(spark: SparkSession, d: str) -> DataFrame:
    """The ingredient list of every label text, with what stands before the header and repaired first items."""
    return section.sections(_docs(spark, d).select("doc_id", "text").filter("text is not null"), "text").drop("text")


@query(
    f"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS lines, count_if(regexp_matches(line, {sql.q(_M.start)})) AS headers, count_if(regexp_matches(line, {sql.q(_M.stop)}) OR regexp_matches(line, {sql.q(_M.digits)})) AS boundaries FROM l GROUP BY doc_id"""
)
def boundary_flags(spark: SparkSession, d: str) -> DataFrame:
    """Header and boundary lines of every text."""
    lines = _docs(spark, d).filter("text is not null").select("doc_id", F.explode(section.lines_of(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(section.is_header(F.col("line"))).alias("headers"), F.count_if(section.is_boundary(F.col("line"))).alias("boundaries"))


@query()
def crop_rects(spark: SparkSession, d: str) -> DataFrame:
    """The crop round the list, from text lines laid out as frames 20 high and 10 wide a character."""
    docs = _docs(spark, d).filter("text is not null")
    frames = F.transform(section.lines_of(F.col("text")), lambda x, i: F.struct(x.alias("text"), (i * 20).alias("top"), F.lit(0).alias("left"), (F.length(x) * 10).alias("width"), F.lit(20).alias("height")))
    f = docs.select("doc_id", frames.alias("f"))
    width, height = F.array_max(F.transform("f", lambda x: x["width"])), F.size("f") * 20
    return f.select("doc_id", geometry.list_crop(F.col("f"), width, height).alias("r")).filter("r is not null").select("doc_id", "r.*")


@query(
    """WITH p AS (SELECT p_partkey, p_size * 100 AS w, 200 AS h, CAST(p_retailprice AS INTEGER) % 100 AS chars FROM part),
t AS (SELECT *, (w / h >= 3 OR h < 240) AND chars < greatest(20, floor(w * 0.07 + 0.5)) AS tiled FROM p)
SELECT p_partkey, tiled, CAST(i * 700 AS INTEGER) AS x, CAST(least(800, w - i * 700) AS INTEGER) AS width FROM t, LATERAL (SELECT unnest(range(0, CAST(greatest(0, ceil((w - 800) / 700.0)) AS BIGINT) + 1)) AS i)"""
)
def tile_rects(spark: SparkSession, d: str) -> DataFrame:
    """Whether a strip is tiled, and its tiles."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100).alias("w"), F.lit(200).alias("h"), (F.col("p_retailprice").cast("decimal(18,0)").cast("int") % 100).alias("chars"))
    t = p.select("p_partkey", geometry.needs_tiles(F.col("w"), F.col("h"), F.col("chars")).alias("tiled"), F.explode(geometry.tiles(F.col("w"), F.col("h"))).alias("r"))
    return t.select("p_partkey", "tiled", "r.x", "r.width")


@query(
    r"""WITH l AS (SELECT rec_id, unnest(flatten(list_transform(list_filter(raw, lambda x: x.text IS NOT NULL), lambda x: regexp_split_to_array(x.text, '\r?\n')))) AS v,
generate_subscripts(flatten(list_transform(list_filter(raw, lambda x: x.text IS NOT NULL), lambda x: regexp_split_to_array(x.text, '\r?\n'))), 1) AS i FROM scan_log),
k AS (SELECT rec_id, v, i, regexp_replace(v, '[\s　]', '', 'g') AS k FROM l),
f AS (SELECT rec_id, k, min(i) AS i, arg_min(v, i) AS v FROM k WHERE k <> '' GROUP BY rec_id, k)
SELECT rec_id, string_agg(v, chr(10) ORDER BY i) AS merged, CAST(sum(length(k)) AS BIGINT) AS coverage, sum(length(k)) < 180 AS low_quality FROM f GROUP BY rec_id"""
)
def merged_passes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all passes of a scan once each, and whether they cover too little."""
    texts = F.filter("raw.text", lambda x: x.isNotNull())
    m = _wide(spark, d, "scan_log").select("rec_id", section.merged_lines(texts).alias("merged")).filter("merged is not null and merged <> ''")
    cover = F.length(F.regexp_replace("merged", r"[\s　]", "")).cast("bigint")
    return m.select("rec_id", "merged", cover.alias("coverage"), (cover < 180).alias("low_quality"))


# --- tokens and noise ---------------------------------------------------------------------------------

_CAND = f"SELECT row_id, unnest(c) AS raw, generate_subscripts(c, 1) - 1 AS ord FROM (SELECT row_id, {sql.candidates('section')} AS c FROM last_scans WHERE section IS NOT NULL)"


@query(_CAND)
def candidate_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Candidate terms of every section, repeats included."""
    return _wide(spark, d, "last_scans").select("row_id", F.posexplode(tokens.candidates(F.col("section"))).alias("ord", "raw")).withColumn("ord", F.col("ord").cast("bigint"))


_TOK = f"SELECT doc_id, unnest(t) AS raw, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {sql.corpus_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)"


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).select("doc_id", "lang", "source", F.posexplode(tokens.corpus_tokens(F.col("text"))).alias("i", "raw"))
    return t.withColumn("term", text.normalized(F.col("raw"), folds=False, compat=False)).withColumn("at", F.col("doc_id") * 1000000 + F.col("i") + 1)


@query(f"WITH t AS (SELECT *, {sql.normalized('raw', False)} AS term, doc_id * 1000000 + i AS k0 FROM ({_TOK})) SELECT term, count(*) AS n, arg_min(raw, k0) AS raw, min(k0) AS first_seen FROM t GROUP BY term ORDER BY n DESC, first_seen LIMIT 500")
def token_freq_topn(spark: SparkSession, d: str) -> DataFrame:
    """The 500 most frequent terms of the documents, ties by first place (a top-k report)."""
    return corpus.top_terms(corpus.token_frequency(_corpus(spark, d), "term", "at"), 500)


_BUCKET = """WITH r AS (SELECT bucket, raw, sum(n) AS n, min(token_id) AS first_seen FROM corpus_tokens WHERE bucket IS NOT NULL GROUP BY bucket, raw),
g AS (SELECT '(all)' AS bucket, raw, sum(n) AS n, min(token_id) AS first_seen FROM corpus_tokens WHERE bucket IS NOT NULL GROUP BY raw),
u AS (SELECT * FROM r UNION ALL SELECT * FROM g)
SELECT bucket, raw, CAST(n AS BIGINT) AS n, first_seen, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, first_seen) AS rank FROM u QUALIFY rank <= 50"""


@query(_BUCKET)
def token_freq_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most frequent forms of each bucket and of all (a top-k report)."""
    c = table(spark, d, "corpus_tokens").filter("bucket is not null")
    agg = [F.sum("n").alias("n"), F.min("token_id").alias("first_seen")]
    both = c.groupBy("bucket", "raw").agg(*agg).unionByName(c.groupBy(F.lit("(all)").alias("bucket"), "raw").agg(*agg))
    return corpus.top_terms(both, 50, ("bucket",)).withColumn("rank", F.col("rank").cast("bigint"))


_RULES = {"drink": "(?i)(drink|tea|coffee|飲料)", "sweet": "(?i)(cookie|jelly|ゼリー|クッキー)", "meal": "(?i)(curry|noodle|soup|カレー|スープ)"}


@query(
    "WITH b AS (SELECT doc_id, unnest(CASE WHEN len(h) > 0 THEN h ELSE ['other'] END) AS bucket FROM (SELECT doc_id, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, {sql.q(p)}) THEN '{b}' END" for b, p in _RULES.items())
    + "], lambda x: x IS NOT NULL) AS h FROM documents WHERE text IS NOT NULL)) SELECT bucket, count(*) AS n, count(DISTINCT doc_id) AS docs FROM b GROUP BY bucket"
)
def document_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Documents in each of several overlapping buckets."""
    b = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(corpus.buckets(F.col("text"), _RULES)).alias("bucket"))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT coalesce(lang, '?') AS lang, count(*) AS docs, count(DISTINCT source) AS sources, count(DISTINCT site) AS sites, count(DISTINCT text) AS texts FROM documents GROUP BY 1")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counts by language."""
    return table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources"), F.countDistinct("site").alias("sites"), F.countDistinct("text").alias("texts"))


_BIG = "list_distinct(list_transform(range(0, CAST(ceil(length({0}) / 2.0) AS BIGINT)), lambda i: substr({0}, CAST(i * 2 + 1 AS BIGINT), 2)))"


@query(
    f"SELECT term_id, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 6) AS jaccard FROM (SELECT term_id, {_BIG.format('reading')} AS a, {_BIG.format('term_ja')} AS b FROM reference_terms)"
)
def jaccard_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of two spellings by two-character chunks."""
    return table(spark, d, "reference_terms").select("term_id", F.round(tokens.jaccard(tokens.chunk_bigrams(F.col("reading")), tokens.chunk_bigrams(F.col("term_ja"))), 6).alias("jaccard"))


@query("SELECT part, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(length(term) - 2, 0) + 1), lambda i: substr(term, i, 3))) AS part FROM reference_terms) GROUP BY part")
def sliding_parts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all three-character windows of the terms."""
    return table(spark, d, "reference_terms").select(F.explode(tokens.sliding(F.col("term"), F.lit(3))).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


_R = noise.DEFAULT


def _hits(e: str, p: str) -> str:
    return f"len(list_distinct(regexp_extract_all({e}, {sql.q(p)}, 1)))"


def _m(e: str, p: str) -> str:
    return f"regexp_matches({e}, {sql.q(p)})"


_SOUP = f"(length(t) >= 8 AND regexp_matches(t, '\\d') AND ({_m('t', _R.nutrition)} OR {_hits('t', _R.stems)} >= 2))"
_AMOUNT = f"(regexp_matches(t, '\\d') AND {_m('t', _R.units)})"
_NOTE = f"({_m('t', _R.allergen_mark)} AND NOT {_m('t', _R.meat)} AND {_hits('t', _R.allergens)} >= 2)"
_WORDS = f"t IN ({', '.join(map(sql.q, _R.words))})"
_NOISE = f"""CASE WHEN t = '' THEN true WHEN {_m('t', _R.meat)} THEN (len(regexp_extract_all(t, {sql.q(_R.meat)})) = 1 AND {_m('t', _R.claim)}) OR {_SOUP} OR {_AMOUNT}
WHEN {_WORDS} THEN true WHEN {_m('t', _R.parts)} OR {_m('t', _R.address)} THEN true WHEN {_AMOUNT} OR {_SOUP} OR {_NOTE} THEN true ELSE regexp_matches(t, '^[¥$]?\\d') END"""
_TERMS = f"(SELECT DISTINCT {sql.normalized('raw')} AS t FROM findings WHERE raw IS NOT NULL)"


@query(f"WITH c AS ({_CAND}), n AS (SELECT *, {sql.normalized('raw')} AS t FROM c) SELECT row_id, t AS term, arg_min(raw, ord) AS raw, min(ord) AS ord FROM n WHERE t <> '' AND NOT ({_NOISE}) GROUP BY row_id, t")
def candidate_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first candidate of each normal form that is no boilerplate."""
    return tokens.candidate_rows(table(spark, d, "last_scans"), "row_id", "section", compat=False).withColumn("ord", F.col("ord").cast("bigint"))


def _finding_terms(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, "findings").filter("raw is not null").select(text.normalized(F.col("raw"), compat=False).alias("term"))


@query(f"SELECT t AS term, {_NOISE} AS noise, {_WORDS} AS word, {_SOUP} AS soup, {_NOTE} AS note, {_AMOUNT} AS amount, regexp_matches(t, '^[\\x20-\\x7e]{{1,5}}\\z') AS short FROM {_TERMS}")
def noise_flags(spark: SparkSession, d: str) -> DataFrame:
    """The boilerplate cascade and its parts for every distinct token."""
    t = F.col("term")
    return _finding_terms(spark, d).distinct().select("term", noise.is_noise(t).alias("noise"), noise.is_exact_noise(t).alias("word"), noise.is_soup(t).alias("soup"), noise.is_allergen_note(t).alias("note"), noise.is_amount(t).alias("amount"), noise.is_short_ascii(t).alias("short"))


@query(f"SELECT file_name, count(*) AS n, count_if({_NOISE}) AS noisy FROM (SELECT file_name, {sql.normalized('raw')} AS t FROM findings WHERE raw IS NOT NULL) GROUP BY file_name")
def noise_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and boilerplate of every image."""
    f = _wide(spark, d, "findings").filter("raw is not null").select("file_name", text.normalized(F.col("raw"), compat=False).alias("t"))
    return f.groupBy("file_name").agg(F.count("*").alias("n"), F.count_if(noise.is_noise(F.col("t"))).alias("noisy"))


_SPIRIT = "(?i)(sake|mirin|wine|酒|beer)"


@query(
    f"""SELECT entry_no, coalesce(list_bool_or(list_transform(names, lambda x: coalesce(regexp_matches(x, {sql.q(_SPIRIT)}), false))), false) AS spirits,
list_filter(names, lambda x: regexp_matches(x, '([぀-ヿ㐀-鿿]|^[Ee]\\d{{3,4}})') AND x NOT IN ('unknown', 'n/a', '-', '') AND NOT contains(x, '[object Object]')) AS valid FROM ingredient_entries"""
)
def name_filters(spark: SparkSession, d: str) -> DataFrame:
    """Names that point to spirits, and names fit for a Japanese dictionary."""
    return table(spark, d, "ingredient_entries").select("entry_no", noise.any_name(F.col("names"), _SPIRIT).alias("spirits"), F.filter("names", noise.valid_name).alias("valid"))


_KINDS = [("label_", "label"), ("menu_", "menu"), ("shelf_", "shelf"), ("leaflet_", "leaflet"), ("card", "card")]


@query(
    "SELECT gt_id, CASE "
    + " ".join(f"WHEN regexp_matches(file_name, '{p}') THEN '{v}'" for p, v in _KINDS)
    + " ELSE 'other' END AS kind, array_to_string(list_filter([CASE WHEN len(ingredients) = 0 THEN 'empty' END, CASE WHEN len(ingredients) > 5 THEN 'long' END, CASE WHEN notes IS NOT NULL THEN 'noted' END, CASE WHEN len(list_filter(ingredients, lambda x: coalesce(x.hazard, false))) > 0 THEN 'hazard' END], lambda x: x IS NOT NULL), ' ') AS flags FROM gt_records"
)
def record_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of image by path, and difficulty flags."""
    conds = {"empty": F.size("ingredients") == 0, "long": F.size("ingredients") > 5, "noted": F.col("notes").isNotNull(), "hazard": F.exists("ingredients", lambda x: F.coalesce(x["hazard"], F.lit(False)))}
    return table(spark, d, "gt_records").select("gt_id", noise.first_category(F.col("file_name"), _KINDS, "other").alias("kind"), F.array_join(noise.flags(conds), " ").alias("flags"))


# --- sources ------------------------------------------------------------------------------------------


@query("SELECT entry_no, id, coalesce(confidence, 'high') AS confidence, coalesce(basis, 'fiqh-rule') AS basis, coalesce(reviewed, true) AS reviewed FROM ingredient_entries")
def load_curated(spark: SparkSession, d: str) -> DataFrame:
    """Curated entries with defaults."""
    return etl.with_defaults([table(spark, d, "ingredient_entries")], {"confidence": "high", "basis": "fiqh-rule", "reviewed": True}).select("entry_no", "id", "confidence", "basis", "reviewed")


_CATSTATUS = "CASE WHEN vegan = 'yes' THEN 'halal' WHEN vegan = 'no' OR vegetarian = 'no' THEN 'syubhat' ELSE 'unknown' END"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("vegan") == "yes", "halal").when((F.col("vegan") == "no") | (F.col("vegetarian") == "no"), "syubhat").otherwise("unknown")
    return table(spark, d, "catalog_entries").withColumn("status", status)


@query(f"SELECT cat_no, id, {_CATSTATUS} AS status, concat_ws(' ', 'src:' || src, 'vegan:' || vegan, 'palm:' || palm_oil) AS reasoning FROM catalog_entries")
def load_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entries with status and reasoning from their flags."""
    return _catalog(spark, d).select("cat_no", "id", "status", F.concat_ws(" ", F.concat(F.lit("src:"), "src"), F.concat(F.lit("vegan:"), "vegan"), F.concat(F.lit("palm:"), "palm_oil")).alias("reasoning"))


@query("SELECT rec_id, sid, scanned_at, ms FROM scan_log WHERE rec_type IS NULL OR rec_type = 'scan'")
def log_scans(spark: SparkSession, d: str) -> DataFrame:
    """The scans of the log."""
    return files.scan_records(table(spark, d, "scan_log")).select("rec_id", "sid", "scanned_at", "ms")


@query("SELECT sid, rec_id, received_at FROM scan_log QUALIFY row_number() OVER (PARTITION BY sid ORDER BY received_at DESC, rec_id DESC) <= 1")
def log_keep_last_n(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each scan."""
    return files.keep_last(table(spark, d, "scan_log"), "sid", ("received_at", "rec_id"), 1).select("sid", "rec_id", "received_at")


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def events_keep_last_n(spark: SparkSession, d: str) -> DataFrame:
    """The last three events of each user."""
    return files.keep_last(table(spark, d, "events"), "user_id", ("ts", "event_id"), 3).select("user_id", "event_id", "ts")


_CODELINE = f"SELECT cat_no AS line_no, substr({sql.code('e_number')}, 2) || '   ' || names[1] || CASE WHEN palm_oil = 'maybe' THEN ' *' ELSE '' END AS line FROM catalog_entries"


_CODENAME = "replace(regexp_split_to_array(rest, '\\s{2,}')[1], '*', '')"


@query(
    rf"""WITH l AS ({_CODELINE}), r AS (SELECT line_no, upper(regexp_extract(line, '^\s*(\d{{3,4}}[a-zA-Z]?)\s+(\S.*)$', 1)) AS code, regexp_extract(line, '^\s*(\d{{3,4}}[a-zA-Z]?)\s+(\S.*)$', 2) AS rest FROM l WHERE regexp_matches(line, '^\s*(\d{{3,4}}[a-zA-Z]?)\s+(\S.*)$'))
SELECT 'E' || code AS code, arg_min({sql.drop(_CODENAME, sql.ENDS)}, line_no) AS name, arg_min(CASE WHEN contains(rest, '*') THEN 'doubtful' ELSE 'listed' END, line_no) AS status FROM r GROUP BY code"""
)
def code_table(spark: SparkSession, d: str) -> DataFrame:
    """A text table of codes, printed from the catalogue and read again."""
    c = table(spark, d, "catalog_entries")
    line = F.concat(F.substring(text.norm_code(F.col("e_number")), 2, 99), F.lit("   "), F.col("names")[0], F.when(F.col("palm_oil") == "maybe", " *").otherwise(""))
    return files.code_table(c.select(F.col("cat_no").alias("line_no"), line.alias("line")).filter("line is not null"))


@query(f"SELECT code, arg_max(vegan, cat_no) AS vegan FROM (SELECT {sql.code('e_number')} AS code, vegan, cat_no FROM catalog_entries) WHERE code IS NOT NULL AND vegan IS NOT NULL GROUP BY code")
def last_row_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last status of each code."""
    return etl.last_wins(table(spark, d, "catalog_entries").withColumn("code", text.norm_code(F.col("e_number"))), "code", "vegan", "cat_no")


# --- matching -----------------------------------------------------------------------------------------

_RULE_LIST = [
    {"id": "spirits", "status": "haram", "patterns": ["mirin", "ワイン", r"(?<![a-z])wine"]},
    {"id": "pork", "status": "haram", "patterns": ["豚", r"(?<![a-z])pork"]},
    {"id": "gelatin", "status": "syubhat", "patterns": ["ゼラチン", "gelatin", "zerachin"]},
    {"id": "collagen", "status": "syubhat", "patterns": ["コラーゲン", "collagen", "koragen"]},
    {"id": "emulsion", "status": "syubhat", "patterns": ["乳化", "emulsion"]},
    {"id": "glycerin", "status": "syubhat", "patterns": ["グリセリン", "glycerin"]},
    {"id": "dairy", "status": "halal", "patterns": ["乳糖", "乳清", "lactose", "whey", "牛乳", "milk"]},
    {"id": "seaweed", "status": "halal", "patterns": ["昆布", "若布", "kelp", "wakame"]},
    {"id": "starch", "status": "halal", "patterns": ["澱粉", "starch"]},
    {"id": "vinegar", "status": "halal", "patterns": ["食酢", "vinegar"]},
    {"id": "vegetable", "status": "halal", "patterns": ["人参", "carrot", "玉葱", "onion", "南瓜", "pumpkin"]},
    {"id": "grain", "status": "halal", "patterns": ["小麦", "wheat", "大麦", "barley", "玄米", "brown ?rice"]},
    {"id": "flavour", "status": "unknown", "patterns": ["香料", "flavou?r"]},
    {"id": "extract", "status": "unknown", "patterns": ["抽出物", "extract"]},
]
_PLAIN_RULES = [r | {"patterns": [p.replace("(?<![a-z])", "") for p in r["patterns"]]} for r in _RULE_LIST]
_RULESQL = "CASE " + " ".join(f"WHEN regexp_matches(t, {sql.q('|'.join(f'(?:{p})' for p in r['patterns']))}) THEN 'rule:{r['id']}'" for r in _PLAIN_RULES) + " END"

_RULESTATUS = "CASE " + " ".join(f"WHEN regexp_matches(t, {sql.q('|'.join(f'(?:{p})' for p in r['patterns']))}) THEN '{r['status']}'" for r in _PLAIN_RULES) + " END"


def _dict(spark: SparkSession, d: str, compat: bool) -> tuple[DataFrame, DataFrame]:
    term = text.normalized(F.col("alias"), compat=compat)
    curated = match.dictionary(etl.with_defaults([table(spark, d, "ingredient_entries")], {"reviewed": True}), "entry_no", term, ("reviewed",))
    return curated, match.dictionary(_catalog(spark, d), "cat_no", term)


_DICT = f"(SELECT entry_no AS ord, id, status, alias_no, {sql.normalized('alias')} AS term FROM (SELECT entry_no, id, status, unnest(names) AS alias, generate_subscripts(names, 1) - 1 AS alias_no FROM ingredient_entries))"
_INDEX = f"(SELECT term, id, status, ord, n_aliases FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY {sql.strictness('status')}, ord, alias_no) AS k, count(*) OVER (PARTITION BY term) AS n_aliases FROM {_DICT} WHERE term <> '') WHERE k = 1)"


@query(f"SELECT term, id, status, ord, n_aliases FROM {_INDEX}")
def index_strictest_wins(spark: SparkSession, d: str) -> DataFrame:
    """The entry that stands for each term."""
    return match.exact_index(_dict(spark, d, False)[0]).select("term", "id", "status", "ord", "n_aliases")


@query(f"SELECT f.finding_id, x.id AS dict_id, x.status AS dict_status FROM (SELECT finding_id, {sql.normalized('raw')} AS term FROM findings WHERE raw IS NOT NULL) f LEFT JOIN {_INDEX} x ON f.term = x.term AND (length(f.term) > 1 OR f.term IN ({', '.join(map(sql.q, tokens.SINGLES))}))")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Every finding with the entry of its term."""
    f = _wide(spark, d, "findings").filter("raw is not null").select("finding_id", text.normalized(F.col("raw"), compat=False).alias("term"))
    return match.exact_match(f, match.exact_index(_dict(spark, d, False)[0])).select("finding_id", F.col("entry.id").alias("dict_id"), F.col("entry.status").alias("dict_status"))


@query(f"SELECT t AS term, {_RULESQL} AS rule FROM {_TERMS}")
def rule_first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first rule of each distinct token."""
    return _finding_terms(spark, d).distinct().select("term", match.first_rule(F.col("term"), _PLAIN_RULES)["id"].alias("rule"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    raw = spread_small(table(spark, d, "findings").select("raw").filter("raw is not null").distinct())
    terms = text.computed_once(raw, "term", text.normalized(F.col("raw"))).select("term")
    return terms.filter("term <> ''").distinct().filter(~noise.is_noise(F.col("term")))


@query()
def fuzzy_top1(spark: SparkSession, d: str) -> DataFrame:
    """The best near term of every token, plain distances. (DuckDB's levenshtein counts bytes.)"""
    return match.fuzzy_match(_tokens(spark, d), _dict(spark, d, True)[0], weighted=False).withColumn("score", F.round("score", 6))


@query()
def weighted_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The best near term of every token, distances weighted by look."""
    return match.fuzzy_match(_tokens(spark, d), _dict(spark, d, True)[0]).withColumn("score", F.round("score", 6))


@query()
def shadow_guard(spark: SparkSession, d: str) -> DataFrame:
    """Tokens within the allowance of a refused term."""
    terms = _dict(spark, d, True)[0].filter("status = 'haram'").select(F.col("term").alias("near"))
    return pass_join.near_pairs(_tokens(spark, d), terms, "term", "near")


@query()
def layered_match(spark: SparkSession, d: str) -> DataFrame:
    """Every token resolved through all layers."""
    curated, catalog = _dict(spark, d, True)
    return match.layered_match(_tokens(spark, d), curated, catalog, _RULE_LIST).withColumn("score", F.round("score", 6))


def _found(spark: SparkSession, d: str) -> DataFrame:
    f = _wide(spark, d, "findings").filter("raw is not null and file_name is not null")
    score = F.when(F.col("kind") == "exact", 1.0).when(F.col("kind") == "fuzzy", 0.8)
    status = F.when(F.col("status") == "unmatched", None).otherwise(F.col("status"))
    return f.select("file_name", F.col("finding_id").alias("ord"), text.normalized(F.col("raw"), compat=False).alias("term"), status.alias("status"), score.alias("score")).filter("term <> ''")


@query()
def collapse_weak(spark: SparkSession, d: str) -> DataFrame:
    """Findings of every image without repeats and without weak ones beside a strong one."""
    return match.collapsed(_found(spark, d), "file_name")


@query(
    f"SELECT file_name, term, arg_min(ord, (CASE WHEN score IS NULL THEN 1 ELSE 0 END, -coalesce(score, 0), ord)) AS ord, max(score) AS score FROM (SELECT file_name, finding_id AS ord, {sql.normalized('raw')} AS term, CASE kind WHEN 'exact' THEN 1.0 WHEN 'fuzzy' THEN 0.8 END AS score FROM findings WHERE raw IS NOT NULL AND file_name IS NOT NULL) WHERE term <> '' GROUP BY file_name, term"
)
def best_of_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The best finding of each term in each image."""
    w = Window.partitionBy("file_name", "term").orderBy(F.col("score").desc_nulls_last(), "ord")
    return _found(spark, d).withColumn("k", F.row_number().over(w)).filter("k = 1").select("file_name", "term", "ord", "score")


@query()
def term_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Plain and weighted likeness of each finding's raw form and matched term, and whether letters were only added or lost."""
    f = table(spark, d, "findings").filter("raw is not null and matched_term is not null").select("raw", "matched_term").distinct()
    a, b = F.col("raw"), F.col("matched_term")
    return f.select("raw", "matched_term", F.round(distance.similarity(a, b), 6).alias("plain"), F.round(distance.weighted_similarity(a, b), 6).alias("weighted"), distance.pure_indel(a, b).alias("indel"))


# --- dictionary building ------------------------------------------------------------------------------

_VEGAN = "CASE vegan WHEN 'yes' THEN 'halal' WHEN 'no' THEN 'haram' WHEN 'maybe' THEN 'syubhat' END"
_SOURCES = f"""o AS (SELECT code, arg_min(status, {sql.strictness('status')}) AS o FROM (SELECT {sql.code('e_number')} AS code, status FROM ingredient_entries) WHERE code IS NOT NULL GROUP BY code),
c AS (SELECT code, arg_max(s, cat_no) AS c FROM (SELECT {sql.code('e_number')} AS code, {_VEGAN} AS s, cat_no FROM catalog_entries WHERE src = 'tax') WHERE code IS NOT NULL AND s IS NOT NULL GROUP BY code),
t AS (SELECT code, arg_max(s, cat_no) AS t FROM (SELECT {sql.code('e_number')} AS code, {_VEGAN} AS s, cat_no FROM catalog_entries WHERE src = 'jp') WHERE code IS NOT NULL AND s IS NOT NULL GROUP BY code)"""


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ie = table(spark, d, "ingredient_entries").withColumn("code", text.norm_code(F.col("e_number"))).filter("code is not null")
    official = ie.groupBy("code").agg(F.min_by("status", match.strictness(F.col("status"))).alias("status"))
    s = F.when(F.col("vegan") == "yes", "halal").when(F.col("vegan") == "no", "haram").when(F.col("vegan") == "maybe", "syubhat")
    ce = table(spark, d, "catalog_entries").withColumn("code", text.norm_code(F.col("e_number"))).withColumn("status", s)
    return official, *(etl.last_wins(ce.filter(F.col("src") == k), "code", "status", "cat_no") for k in ("tax", "jp"))


@query(
    f"""WITH {_SOURCES}, j AS (SELECT * FROM o FULL JOIN c USING (code) FULL JOIN t USING (code))
SELECT code, CASE WHEN o = c OR o = t THEN o WHEN o IS NOT NULL AND c IS NULL AND t IS NULL THEN o
WHEN o IS NOT NULL THEN CASE WHEN 'haram' IN (o, coalesce(c, ''), coalesce(t, '')) THEN 'haram' WHEN 'syubhat' IN (o, coalesce(c, ''), coalesce(t, '')) THEN 'syubhat' ELSE o END
WHEN c = t THEN c WHEN c IS NOT NULL AND t IS NOT NULL THEN 'syubhat' ELSE coalesce(c, t, 'unknown') END AS status,
CASE WHEN o = c OR o = t THEN 'cross-source' WHEN o IS NOT NULL AND c IS NULL AND t IS NULL THEN 'official' WHEN o IS NOT NULL THEN 'conflict'
WHEN c = t THEN 'cross-source' WHEN c IS NOT NULL AND t IS NOT NULL THEN 'conflict' WHEN coalesce(c, t) IS NOT NULL THEN 'single-source' ELSE 'none' END AS basis,
CAST(o IS NOT NULL AS INTEGER) + CAST(c IS NOT NULL AS INTEGER) + CAST(t IS NOT NULL AS INTEGER) AS n_sources FROM j"""
)
def arbitration_3way(spark: SparkSession, d: str) -> DataFrame:
    """One status a code from three sources."""
    return etl.arbitrated(*_sources(spark, d), "code", "status")


_CODENAMES = "SELECT {} AS code, min(names[1]) AS name FROM {} WHERE e_number IS NOT NULL AND names[1] IS NOT NULL GROUP BY 1"


@query(
    f"WITH a AS ({_CODENAMES.format(sql.code('e_number'), 'ingredient_entries')}), b AS ({_CODENAMES.format(sql.code('e_number'), 'catalog_entries')}), k AS (SELECT code FROM a UNION SELECT code FROM b) SELECT code, coalesce(a.name, b.name, code) AS name FROM k LEFT JOIN a USING (code) LEFT JOIN b USING (code) WHERE code IS NOT NULL"
)
def preferred_names(spark: SparkSession, d: str) -> DataFrame:
    """The name of each code by priority of sources."""
    parts = [table(spark, d, t).filter("e_number is not null").select(text.norm_code(F.col("e_number")).alias("code"), F.get("names", F.lit(0)).alias("name")).filter("code is not null and name is not null") for t in ("ingredient_entries", "catalog_entries")]
    return etl.preferred_names(parts[0].select("code").union(parts[1].select("code")), parts, "code", "name")


_OWN = f"SELECT DISTINCT {sql.code('e_number')} AS code, {sql.normalized('name')} AS name FROM (SELECT e_number, unnest(names) AS name FROM catalog_entries WHERE e_number IS NOT NULL)"


@query(f"WITH r AS ({_OWN}) SELECT code, name FROM r WHERE code IS NOT NULL AND name <> '' QUALIFY count(*) OVER (PARTITION BY name) = 1 OR lower(regexp_replace(name, '[^0-9A-Za-z]', '', 'g')) = lower(code)")
def duplicate_name_owner(spark: SparkSession, d: str) -> DataFrame:
    """Names of codes, those claimed by several left out unless they spell the code."""
    n = table(spark, d, "catalog_entries").filter("e_number is not null").select(text.norm_code(F.col("e_number")).alias("code"), F.explode("names").alias("n"))
    return etl.owned_names(n.select("code", text.normalized(F.col("n"), compat=False).alias("name")).filter("code is not null and name <> ''"), "code", "name")


_KNOWN = f"SELECT DISTINCT {sql.normalized('name', False)} AS term FROM (SELECT unnest(names) AS name FROM catalog_entries)"


@query(
    f"""WITH t AS (SELECT {sql.normalized('raw', False)} AS term, raw, token_id FROM corpus_tokens), f AS (SELECT term, arg_min(raw, token_id) AS raw, min(token_id) AS k0 FROM t WHERE term NOT IN ({_KNOWN}) AND term IS NOT NULL GROUP BY term)
SELECT 'jp-' || CAST(row_number() OVER (ORDER BY k0) - 1 AS VARCHAR) AS id, term, raw FROM f"""
)
def anti_join_new_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Harvested forms the catalogue doesn't know, numbered in order of first sight."""
    t = _wide(spark, d, "corpus_tokens").select(text.normalized(F.col("raw"), folds=False, compat=False).alias("term"), "raw", "token_id").filter("term is not null")
    known = table(spark, d, "catalog_entries").select(F.explode("names").alias("n")).select(text.normalized(F.col("n"), folds=False, compat=False).alias("term"))
    return etl.new_tokens(t, known, "term", "token_id")


@query(
    f"""WITH t AS (SELECT {sql.normalized('raw')} AS term, sum(n) AS n FROM corpus_tokens WHERE bucket IS NOT NULL AND raw IS NOT NULL GROUP BY 1), x AS (SELECT term FROM {_INDEX}),
k AS (SELECT DISTINCT {sql.normalized('name')} AS term FROM (SELECT unnest(names) AS name FROM catalog_entries))
SELECT term AS term, CAST(n AS BIGINT) AS n, CASE WHEN term IN (SELECT term FROM k) THEN 'catalog' ELSE 'unlabelled' END AS tag FROM (SELECT term AS t, * FROM t) WHERE term NOT IN (SELECT term FROM x) AND {_RULESQL} IS NULL"""
)
def unlabelled_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Harvested terms without a curated entry and without a rule, and whether the catalogue has them."""
    c = _wide(spark, d, "corpus_tokens").filter("bucket is not null and raw is not null").groupBy(text.normalized(F.col("raw"), compat=False).alias("term")).agg(F.sum("n").alias("n"))
    curated, catalog = _dict(spark, d, False)
    left = c.join(curated.select("term").distinct(), "term", "left_anti").filter(match.first_rule(F.col("term"), _PLAIN_RULES).isNull())
    tagged = left.join(catalog.select("term", F.lit("catalog").alias("tag")).distinct(), "term", "left")
    return tagged.select("term", "n", F.coalesce("tag", F.lit("unlabelled")).alias("tag"))


@query(
    f"""WITH c AS (SELECT DISTINCT {sql.normalized('name')} AS term, o AS org, org_no FROM (SELECT unnest(names) AS name, sources FROM ingredient_entries), LATERAL (SELECT unnest(sources) AS o, generate_subscripts(sources, 1) AS org_no)),
n AS (SELECT cat_no, {sql.normalized('name')} AS term, ord FROM (SELECT cat_no, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS ord FROM catalog_entries)),
f AS (SELECT cat_no, org, min((ord, org_no)) AS k0 FROM n JOIN c USING (term) WHERE term <> '' GROUP BY cat_no, org)
SELECT cat_no, string_agg(org, ' ' ORDER BY k0, org) AS orgs FROM f GROUP BY cat_no"""
)
def citation_orgs(spark: SparkSession, d: str) -> DataFrame:
    """The sources that cite any name of a catalogue entry."""
    cited = table(spark, d, "ingredient_entries").select(F.explode("names").alias("n"), "sources").select(text.normalized(F.col("n"), compat=False).alias("term"), F.posexplode("sources").alias("org_no", "org")).filter("term <> ''").distinct()
    names = table(spark, d, "catalog_entries").select("cat_no", F.posexplode("names").alias("ord", "n")).select("cat_no", "ord", text.normalized(F.col("n"), compat=False).alias("term"))
    return etl.citations(names, cited, "cat_no", "term", "org").select("cat_no", F.array_join("orgs", " ").alias("orgs"))


@query(
    f"""WITH p AS (SELECT id, 'cross-source' AS basis, ['seen:' || coalesce(category, 'none')] AS sources FROM ingredient_entries WHERE status = 'unknown' UNION ALL SELECT 'new-' || CAST(term_id AS VARCHAR), 'single-source', ['list'] FROM reference_terms)
SELECT coalesce(c.id, p.id) AS id, coalesce(p.basis, c.basis) AS basis, array_to_string(CASE WHEN c.sources IS NULL THEN p.sources WHEN p.sources IS NULL THEN c.sources ELSE list_concat(c.sources, list_filter(p.sources, lambda x: NOT list_contains(c.sources, x))) END, ' ') AS sources FROM ingredient_entries c FULL JOIN p ON c.id = p.id"""
)
def upsert_expand(spark: SparkSession, d: str) -> DataFrame:
    """The curated table after a proposal: sources merged, basis refreshed, new entries appended."""
    cur = table(spark, d, "ingredient_entries").select("id", "basis", "sources")
    seen = table(spark, d, "ingredient_entries").filter("status = 'unknown'").select("id", F.lit("cross-source").alias("basis"), F.array(F.concat(F.lit("seen:"), F.coalesce("category", F.lit("none")))).alias("sources"))
    new = table(spark, d, "reference_terms").select(F.concat(F.lit("new-"), F.col("term_id").cast("string")).alias("id"), F.lit("single-source").alias("basis"), F.array(F.lit("list")).alias("sources"))
    return etl.upsert(cur, seen.unionByName(new), "id", ("sources",), ("basis",)).select("id", "basis", F.array_join("sources", " ").alias("sources"))


_PROP = f"(SELECT token_id AS ord, {sql.normalized('raw')} AS t FROM corpus_tokens WHERE raw IS NOT NULL)"


@query(
    f"""WITH s AS (SELECT ord, t, CASE WHEN length(t) < 3 THEN 'fragment' WHEN {_NOISE} THEN 'noise' WHEN t IN (SELECT term FROM {_INDEX}) THEN 'covered' END AS skip FROM {_PROP}),
m AS (SELECT ord, t AS term, skip, row_number() OVER (PARTITION BY t, skip IS NULL ORDER BY ord) AS k FROM s)
SELECT ord, term, CASE WHEN skip IS NULL AND k > 1 THEN 'duplicate-id' ELSE skip END AS skip FROM m"""
)
def label_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposed labels with the first reason to skip each."""
    items = _wide(spark, d, "corpus_tokens").filter("raw is not null").select(F.col("token_id").alias("ord"), text.normalized(F.col("raw"), compat=False).alias("term"))
    known = _dict(spark, d, False)[0].select("term", F.lit(True).alias("_known")).distinct()
    j = items.join(known, "term", "left")
    skips = {"fragment": F.length("term") < 3, "noise": noise.is_noise(F.col("term")), "covered": F.col("_known")}
    return etl.proposals(j, skips, "term").select("ord", "term", "skip")


@query(
    f"""WITH a AS (SELECT DISTINCT t AS term FROM {_TERMS}), b AS (SELECT a.term, x.status AS before, coalesce(x.status, {_RULESTATUS}) AS after FROM (SELECT term, term AS t FROM a) a LEFT JOIN {_INDEX} x ON a.term = x.term)
SELECT before, after, count(*) AS n FROM b WHERE before IS DISTINCT FROM after GROUP BY before, after"""
)
def verdict_flips(spark: SparkSession, d: str) -> DataFrame:
    """What changes for the tokens when the rules are added to the dictionary."""
    terms = _finding_terms(spark, d).distinct()
    before = terms.join(match.exact_index(_dict(spark, d, False)[0]).select("term", "status"), "term", "left")
    after = before.select("term", F.coalesce("status", match.first_rule(F.col("term"), _PLAIN_RULES)["status"]).alias("status"))
    return etl.flips(before, after, "term", "status")


@query(f"SELECT a.code, a.status AS left_status, b.status AS right_status FROM (SELECT DISTINCT {sql.code('e_number')} AS code, status FROM ingredient_entries) a JOIN (SELECT DISTINCT {sql.code('e_number')} AS code, {_CATSTATUS} AS status FROM catalog_entries) b ON a.code = b.code WHERE a.status <> b.status")
def status_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Codes that two tables judge differently."""
    parts = [t.select(text.norm_code(F.col("e_number")).alias("code"), "status") for t in (table(spark, d, "ingredient_entries"), _catalog(spark, d))]
    return etl.status_conflicts(parts[0], parts[1], "code", "status")


@query(f"SELECT term, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses, count(*) AS n FROM {_DICT} WHERE term <> '' GROUP BY term HAVING count(DISTINCT status) > 1")
def duplicate_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms that entries of different status share."""
    return evaluate.duplicate_terms(_dict(spark, d, False)[0])


@query()
def content_version(spark: SparkSession, d: str) -> DataFrame:
    """A short version of the curated table's content."""
    return etl.content_version(table(spark, d, "ingredient_entries"))


@query("SELECT 'left' AS side, count(*) AS n FROM (SELECT raw FROM findings EXCEPT ALL SELECT matched_term FROM findings) UNION ALL SELECT 'right', count(*) FROM (SELECT matched_term FROM findings EXCEPT ALL SELECT raw FROM findings)")
def reproducibility(spark: SparkSession, d: str) -> DataFrame:
    """How far two columns differ as multisets, the check of a rebuilt file against the stored one."""
    f = table(spark, d, "findings")
    return etl.same_content(f.select("raw"), f.select(F.col("matched_term").alias("raw")))


@query("WITH a AS (SELECT raw, sum(n) AS n, 0 AS s FROM corpus_tokens WHERE bucket IS NULL GROUP BY raw UNION ALL SELECT raw, max(n), 1 FROM corpus_tokens WHERE bucket IS NOT NULL GROUP BY raw) SELECT raw, CAST(arg_min(n, s) AS BIGINT) AS n FROM a GROUP BY raw")
def fallback_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Counts from the totals where there are some, else from the buckets."""
    c = table(spark, d, "corpus_tokens")
    return corpus.first_of_sources([c.filter("bucket is null").groupBy("raw").agg(F.sum("n").alias("n")), c.filter("bucket is not null").groupBy("raw").agg(F.max("n").alias("n"))], "raw", "n")


# --- corpus and evaluation ----------------------------------------------------------------------------


@query(
    f"""WITH c AS (SELECT t, n, CASE WHEN t IN (SELECT term FROM {_INDEX}) THEN 'covered' WHEN {_NOISE} THEN 'noise' ELSE 'unknown' END AS kind FROM (SELECT {sql.normalized('raw')} AS t, n FROM corpus_tokens WHERE bucket IS NOT NULL AND raw IS NOT NULL))
SELECT kind, count(*) AS terms, CAST(sum(n) AS BIGINT) AS n, floor(sum(n) / (SELECT sum(n) FROM c) * 1000 + 0.5) / 10 AS percent FROM c GROUP BY kind"""
)
def weighted_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of the harvest, by count, the dictionary covers."""
    c = _wide(spark, d, "corpus_tokens").filter("bucket is not null and raw is not null").select(text.normalized(F.col("raw"), compat=False).alias("term"), "n")
    known = _dict(spark, d, False)[0].select("term", F.lit(True).alias("_known")).distinct()
    j = c.join(known, "term", "left")
    return corpus.coverage(j, F.coalesce(F.col("_known"), F.lit(False)), noise.is_noise(F.col("term")))


@query("SELECT kind_of_image, status, count(*) AS n FROM findings GROUP BY kind_of_image, status")
def status_tally(spark: SparkSession, d: str) -> DataFrame:
    """Findings by kind of image and status."""
    return evaluate.histogram(table(spark, d, "findings"), "status", ("kind_of_image",))


@query("SELECT kind_of_image, status, count(*) AS n, count(DISTINCT file_name) AS images, grouping(kind_of_image, status) AS g FROM findings GROUP BY ROLLUP (kind_of_image, status)")
def kind_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Findings and images by kind and status, with subtotals."""
    return table(spark, d, "findings").rollup("kind_of_image", "status").agg(F.count("*").alias("n"), F.countDistinct("file_name").alias("images"), F.grouping_id().alias("g"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def median_mean_run(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean and exact median of event values."""
    return evaluate.run_summary(table(spark, d, "events"), "value", ("event_type",))


@query("SELECT passes, count(ms) AS n, round(avg(ms), 6) AS mean, round(median(ms), 6) AS median, min(ms) AS least, max(ms) AS most FROM scan_log WHERE rec_type IS NULL OR rec_type = 'scan' GROUP BY passes")
def scan_times(spark: SparkSession, d: str) -> DataFrame:
    """Scan times by number of passes."""
    return evaluate.run_summary(files.scan_records(table(spark, d, "scan_log")), "ms", ("passes",))


_ITEMS = f"""g AS (SELECT gt_id, file_name, category, i.raw AS raw, lower(trim(i.expected)) AS expected, coalesce(i.hazard, false) AS hazard, {sql.normalized('i.raw')} AS term FROM (SELECT gt_id, file_name, category, unnest(ingredients) AS i FROM gt_records)),
f AS (SELECT file_name, term, arg_min(CASE WHEN status = 'unmatched' THEN NULL ELSE status END, finding_id) FILTER (WHERE status <> 'unmatched') AS status, count(*) AS n FROM (SELECT file_name, finding_id, status, {sql.normalized('raw')} AS term FROM findings WHERE raw IS NOT NULL) GROUP BY file_name, term),
x AS (SELECT g.*, f.status, f.term IS NOT NULL AS matched FROM g LEFT JOIN f ON g.file_name = f.file_name AND g.term = f.term),
r AS (SELECT *, CASE WHEN NOT matched THEN 'unmatched' WHEN expected IS NULL THEN 'unjudged' WHEN status IS NULL THEN 'unexpected' WHEN expected = status THEN 'correct' WHEN status = 'unknown' THEN 'unknown' ELSE 'wrong' END AS outcome FROM x)"""
_METRICS = """count(*) AS items, count(DISTINCT file_name) AS images, count_if(outcome IN ('correct', 'wrong')) AS judged, count_if(outcome = 'correct') AS correct,
CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count_if(outcome IN ('correct', 'wrong')) / CAST(count(*) AS DOUBLE), 6) END AS classification_recall,
CASE WHEN count_if(hazard) = 0 THEN 1.0 ELSE round(count_if(hazard AND outcome <> 'unmatched') / CAST(count_if(hazard) AS DOUBLE), 6) END AS hazard_recall,
CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count_if(outcome = 'unknown') / CAST(count(*) AS DOUBLE), 6) END AS unknown_rate, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count_if(outcome = 'unmatched') / CAST(count(*) AS DOUBLE), 6) END AS unmatched_rate,
CASE WHEN count_if(outcome IN ('correct', 'wrong')) = 0 THEN 0.0 ELSE round(count_if(outcome = 'correct') / CAST(count_if(outcome IN ('correct', 'wrong')) AS DOUBLE), 6) END AS accuracy, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count_if(outcome = 'correct') / CAST(count(*) AS DOUBLE), 6) END AS end_to_end,
count_if(status = 'halal' AND expected = 'haram') AS false_allowed, count_if(status = 'haram' AND expected = 'halal') AS false_denied"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Items with the finding of the same term in the same image, judged."""
    gt = table(spark, d, "gt_records")
    g = evaluate.facts(gt, "gt_id", "file_name", "ingredients").join(gt.select("gt_id", "category"), "gt_id").withColumn("term", text.normalized(F.col("raw"), compat=False))
    f = _wide(spark, d, "findings").filter("raw is not null").select("file_name", "finding_id", F.when(F.col("status") != "unmatched", F.col("status")).alias("status"), text.normalized(F.col("raw"), compat=False).alias("term"))
    best = f.groupBy("file_name", "term").agg(F.min_by("status", F.when(F.col("status").isNotNull(), F.col("finding_id"))).alias("status"), F.lit(True).alias("_m"))
    j = g.join(best, ["file_name", "term"], "left").withColumn("matched", F.coalesce("_m", F.lit(False)))
    return j.withColumn("outcome", evaluate.outcome(F.col("expected"), F.col("status"), F.col("matched")))


@query(f"WITH {_ITEMS} SELECT outcome, expected, count(*) AS n FROM r GROUP BY outcome, expected")
def scoring_facts(spark: SparkSession, d: str) -> DataFrame:
    """What became of the hand-made items, by expected status."""
    return evaluate.histogram(_scored(spark, d), "expected", ("outcome",))


@query(f"WITH {_ITEMS} SELECT {_METRICS} FROM r")
def gt_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metric suite over all images."""
    return evaluate.metrics(_scored(spark, d))


@query(f"WITH {_ITEMS} SELECT category, {_METRICS} FROM r GROUP BY category")
def category_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metric suite by category."""
    return evaluate.metrics(_scored(spark, d), ("category",))


_LIMITS = {"classification_recall": (">=", 0.85), "accuracy": (">=", 0.9), "false_allowed": ("<=", 0.0)}


@query(
    f"WITH {_ITEMS}, m AS (SELECT {_METRICS} FROM r), t AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({k} AS DOUBLE) AS value, {v} AS limit_value, {k} {op} {v} AS passed FROM m" for k, (op, v) in _LIMITS.items())
    + ") SELECT metric, value, CAST(limit_value AS DOUBLE) AS limit_value, passed, (SELECT bool_and(passed) FROM t) AS all_passed FROM t"
)
def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    """The metrics against their limits."""
    return evaluate.thresholds(evaluate.metrics(_scored(spark, d)), _LIMITS)


@query(f"WITH {_ITEMS}, l AS (SELECT f.file_name, f.term, g.term IS NOT NULL AS hit FROM f LEFT JOIN (SELECT DISTINCT file_name, term FROM g) g ON f.file_name = g.file_name AND f.term = g.term WHERE f.status IS NOT NULL AND f.file_name IN (SELECT file_name FROM g)) SELECT file_name, count(*) AS verdicts, count_if(NOT hit) AS leaked FROM l GROUP BY file_name")
def noise_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Judged terms of each image that its record doesn't list."""
    gt = evaluate.facts(table(spark, d, "gt_records"), "gt_id", "file_name", "ingredients").select("file_name", text.normalized(F.col("raw"), compat=False).alias("term"))
    f = _wide(spark, d, "findings").filter("raw is not null and status <> 'unmatched'").select("file_name", text.normalized(F.col("raw"), compat=False).alias("term")).distinct()
    known = f.join(gt.select("file_name").distinct(), "file_name", "left_semi").join(gt.distinct().withColumn("hit", F.lit(True)), ["file_name", "term"], "left")
    return known.groupBy("file_name").agg(F.count("*").alias("verdicts"), F.count_if(F.col("hit").isNull()).alias("leaked"))


@query()
def greedy_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Items and findings of each image aligned one to one by likeness."""
    gt = evaluate.facts(table(spark, d, "gt_records"), "gt_id", "file_name", "ingredients")
    items = gt.select("file_name", (F.col("gt_id") * 1000 + F.col("gi")).alias("gt_no"), F.col("raw").alias("term")).filter("trim(term) <> '' and file_name is not null")
    f = _wide(spark, d, "findings").filter("raw is not null").select("file_name", F.col("finding_id").alias("finding_no"), F.col("raw").alias("term"), "matched_term").filter("trim(term) <> ''")
    return evaluate.aligned(items, f).withColumn("score", F.round("score", 6))


@query()
def preferred_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The alignment of items and findings after the repair pass for expected statuses."""
    gt = evaluate.facts(table(spark, d, "gt_records"), "gt_id", "file_name", "ingredients")
    items = gt.select("file_name", (F.col("gt_id") * 1000 + F.col("gi")).alias("gt_no"), F.col("raw").alias("term"), "expected").filter("trim(term) <> '' and file_name is not null")
    f = _wide(spark, d, "findings").filter("raw is not null").select("file_name", F.col("finding_id").alias("finding_no"), F.col("raw").alias("term"), "matched_term", "status").filter("trim(term) <> ''")
    return evaluate.preferred(items, f, evaluate.aligned(items.drop("expected"), f.drop("status"))).withColumn("score", F.round("score", 6))


@query("SELECT gt_id, concat_ws(' | ', nullif(trim(source), ''), nullif(trim(product_name), ''), nullif(trim(notes), '')) AS source_text FROM gt_records")
def source_texts(spark: SparkSession, d: str) -> DataFrame:
    """One text from the descriptive fields of each record."""
    return table(spark, d, "gt_records").select("gt_id", text.source_text(F.col("source"), F.col("product_name"), F.col("notes"), sep=" | ").alias("source_text"))


@query(
    """WITH a AS (SELECT sid, row_id, row_number() OVER (PARTITION BY sid ORDER BY created_at, row_id) AS k, count(*) OVER (PARTITION BY sid) AS n FROM last_scans WHERE sid IS NOT NULL),
b AS (SELECT sid, rec_id, row_number() OVER (PARTITION BY sid ORDER BY scanned_at, rec_id) AS k, count(*) OVER (PARTITION BY sid) AS n FROM scan_log WHERE sid IS NOT NULL)
SELECT a.sid, row_id, rec_id FROM a JOIN b ON a.sid = b.sid AND a.k = b.k AND a.n = b.n"""
)
def device_positions(spark: SparkSession, d: str) -> DataFrame:
    """Saved scans and log records of one sid paired by position where there are equally many."""
    a = table(spark, d, "last_scans").filter("sid is not null")
    b = table(spark, d, "scan_log").filter("sid is not null")
    return evaluate.zipped(a, b, "sid", "row_id", "rec_id", "created_at", "scanned_at")


_MARKERS = ("natural", "powder")


@query("SELECT token_id, regexp_matches(raw, '(?i)(wine|sake|pork)') AND NOT (contains(raw, 'natural') OR contains(raw, 'powder')) AS guarded FROM corpus_tokens WHERE raw IS NOT NULL")
def marker_guard(spark: SparkSession, d: str) -> DataFrame:
    """Harvested forms with a marker that no exception excuses."""
    return table(spark, d, "corpus_tokens").filter("raw is not null").select("token_id", noise.guarded(F.col("raw"), "(?i)(wine|sake|pork)", _MARKERS).alias("guarded"))


@query(
    """WITH i AS (SELECT gt_id, unnest(ingredients) AS i FROM gt_records)
SELECT 'missing_file' AS problem, count(*) FILTER (WHERE file_name IS NULL OR file_name = '') AS n FROM gt_records UNION ALL SELECT 'no_items', count(*) FILTER (WHERE ingredients IS NULL OR len(ingredients) = 0) FROM gt_records
UNION ALL SELECT 'empty_item', count(*) FILTER (WHERE coalesce(i.raw, '') = '') FROM i UNION ALL SELECT 'invalid_expected', count(*) FILTER (WHERE lower(trim(coalesce(i.expected, ''))) NOT IN ('halal', 'haram', 'syubhat', 'unknown')) FROM i
UNION ALL SELECT 'repeated_item', CAST(coalesce(sum(n - d), 0) AS BIGINT) FROM (SELECT gt_id, count(*) AS n, count(DISTINCT trim(i.raw)) AS d FROM i WHERE trim(i.raw) <> '' GROUP BY gt_id)
UNION ALL SELECT 'repeated_file', count(*) FROM (SELECT file_name FROM gt_records WHERE file_name IS NOT NULL GROUP BY file_name HAVING count(*) > 1)"""
)
def record_quality(spark: SparkSession, d: str) -> DataFrame:
    """Problems of the hand-made records."""
    return evaluate.record_quality(table(spark, d, "gt_records"), "gt_id", "file_name", "ingredients", ("halal", "haram", "syubhat", "unknown"))


@query("SELECT category, count(*) AS n, count(*) >= 100 AS enough, count(DISTINCT source) AS sources FROM gt_records GROUP BY category")
def record_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Whether each category has enough records."""
    return table(spark, d, "gt_records").groupBy("category").agg(F.count("*").alias("n"), (F.count("*") >= 100).alias("enough"), F.countDistinct("source").alias("sources"))


@query("WITH k AS (SELECT DISTINCT lower(trim(file_name)) AS p, regexp_extract(lower(trim(file_name)), '([^/]*)$', 1) AS b FROM gt_records) SELECT DISTINCT file_name AS path FROM findings WHERE file_name IS NOT NULL AND (lower(trim(file_name)) IN (SELECT p FROM k) OR regexp_extract(lower(trim(file_name)), '([^/]*)$', 1) IN (SELECT b FROM k))")
def disjointness(spark: SparkSession, d: str) -> DataFrame:
    """Images that stand in both the findings and the hand-made records."""
    return evaluate.overlap(table(spark, d, "findings"), table(spark, d, "gt_records"), "file_name")


@query("SELECT term, count(*) AS n, count(DISTINCT rec_id) AS records FROM (SELECT rec_id, unnest(miss) AS term FROM scan_log) WHERE term IS NOT NULL GROUP BY term ORDER BY n DESC, term LIMIT 100")
def miss_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent unmatched terms (a top-k report)."""
    return table(spark, d, "scan_log").select("rec_id", F.explode("miss").alias("term")).filter("term is not null").groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("rec_id").alias("records")).orderBy(F.col("n").desc(), "term").limit(100)


_DISPLAY = "CASE status WHEN 'haram' THEN 1 WHEN 'syubhat' THEN 2 WHEN 'unknown' THEN 3 WHEN 'halal' THEN 4 ELSE 5 END"


@query(
    f"SELECT sid, finding_id, place, greatest(n - 8, 0) AS more FROM (SELECT sid, finding_id, row_number() OVER (PARTITION BY sid ORDER BY {_DISPLAY}, CASE kind WHEN 'exact' THEN 1.0 WHEN 'fuzzy' THEN 0.8 END DESC NULLS LAST, finding_id) AS place, count(*) OVER (PARTITION BY sid) AS n FROM findings WHERE sid IS NOT NULL) WHERE place <= 8"
)
def display_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first eight findings of every scan in display order, and how many more there are."""
    f = table(spark, d, "findings").filter("sid is not null").select("sid", "finding_id", F.col("finding_id").alias("ord"), "status", F.when(F.col("kind") == "exact", 1.0).when(F.col("kind") == "fuzzy", 0.8).alias("score"))
    return search.display_order(f, "sid").select("sid", "finding_id", F.col("place").cast("bigint").alias("place"), F.col("more").cast("bigint").alias("more"))


@query(
    f"""WITH e AS (SELECT 0 AS branch, id, term, status, length(term) AS size FROM {_INDEX} WHERE term = 'saffron'), h AS (SELECT id, term, status, ord, alias_no FROM {_DICT} WHERE starts_with(term, 'sa') AND term <> 'sa'),
p AS (SELECT 1 AS branch, id, arg_min(term, (ord, alias_no)) AS term, arg_min(status, (ord, alias_no)) AS status, length(arg_min(term, (ord, alias_no))) AS size FROM h GROUP BY id), u AS (SELECT * FROM e UNION ALL SELECT * FROM p)
SELECT row_number() OVER (ORDER BY branch, size, term, id) AS rank, id, term, CASE WHEN starts_with(id, 'ing-') OR starts_with(id, 'rule:') THEN status ELSE 'unknown' END AS status, (SELECT count(*) FROM u) AS total, (SELECT count(*) FROM u) > 30 AS truncated FROM u QUALIFY rank <= 30"""
)
def search_prefix_topk(spark: SparkSession, d: str) -> DataFrame:
    """One page of a search by prefix, with the total."""
    curated = _dict(spark, d, False)[0]
    exact = match.exact_index(curated).filter("term = 'saffron'")
    return search.searched(exact, search.prefix_hits(curated, "sa")).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def search_layered(spark: SparkSession, d: str) -> DataFrame:
    """One page of a search: what the layers make of each token of the query, then entries of either dictionary by prefix."""
    curated, catalog = _dict(spark, d, True)
    asked = spark.createDataFrame([("carrot powder、saffrom、sa",)], "q string").select(F.explode(tokens.candidates(F.col("q"))).alias("raw"))
    terms = text.computed_once(asked, "term", text.normalized(F.col("raw"))).select("term").filter("term <> ''").distinct()
    found = match.layered_match(terms, curated, catalog, _RULE_LIST).filter("id is not null").groupBy("id").agg(F.min_by("matched_term", "term").alias("term"), F.min("status").alias("status"))
    both = curated.select("id", "term", "alias", "status", "ord", "alias_no").unionByName(catalog.select("id", "term", "alias", "status", "ord", "alias_no"))
    return search.searched(found, search.prefix_hits(both, "sa", found)).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT category, count_if(i.hazard) AS hazards, count(*) AS items, floor(count_if(i.hazard) / count(*) * 1000 + 0.5) / 10 AS percent FROM (SELECT category, unnest(ingredients) AS i FROM gt_records) GROUP BY category")
def hazard_percent(spark: SparkSession, d: str) -> DataFrame:
    """The share of hazards among the items of each category, in percent."""
    items = table(spark, d, "gt_records").select("category", F.explode("ingredients").alias("i")).groupBy("category").agg(F.count_if("i.hazard").alias("hazards"), F.count("*").alias("items"))
    return items.withColumn("percent", text.percent(F.col("hazards"), F.col("items")))


@query()
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """200 harvested forms drawn by count without replacement (a sampling operator)."""
    c = table(spark, d, "corpus_tokens").filter("bucket is not null").groupBy("raw").agg(F.sum("n").alias("n"))
    return corpus.weighted_sample(c, "n", 200, 17, "raw")


def _synthetic(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus_tokens").filter("bucket is not null").groupBy("raw").agg(F.sum("n").alias("n"))
    return corpus.synthetic_labels(c, "raw", "n", table(spark, d, "gt_records"), "gt_id")


@query()
def synthetic_labels(spark: SparkSession, d: str) -> DataFrame:
    """A made-up label for every record."""
    return _synthetic(spark, d)


@query()
def robustness_curve(spark: SparkSession, d: str) -> DataFrame:
    """How much of made-up labels is still recognised after reading errors, by error rate."""
    rates = F.explode(F.array(F.lit(0.0), F.lit(0.15), F.lit(0.3))).alias("rate")
    items = _synthetic(spark, d).select("gt_id", F.posexplode(F.split("text", "、")).alias("i", "term")).select("gt_id", "i", "term", rates)
    swaps = [(a, b) for g, c in distance.GROUPS if c <= 0.3 for a in g for b in g if a != b]
    read = items.withColumn("read", corpus.corrupted(F.col("term"), F.col("rate"), F.xxhash64("gt_id", "i", "rate"), swaps))
    terms = read.select("rate", "term", "read").distinct()
    index = items.select("term").distinct()
    # both the term and what was read of it go through all layers, each distinct token once; found is what comes to the same entry
    key = lambda c: text.normalized(F.col(c))
    pairs = text.computed_once(text.computed_once(terms, "a", key("term")), "b", key("read"))
    curated, catalog = _dict(spark, d, True)
    asked = pairs.select(F.col("a").alias("term")).union(pairs.select("b")).filter("term <> ''").distinct()
    got = match.layered_match(asked, curated, catalog, _RULE_LIST).select("term", "id")
    ids = pairs.join(got.select(F.col("term").alias("a"), F.col("id").alias("want_id")), "a", "left").join(got.select(F.col("term").alias("b"), F.col("id").alias("got_id")), "b", "left")
    j = read.join(ids.select("rate", "term", "read", "want_id", "got_id"), ["rate", "term", "read"])
    return j.groupBy("rate").agg(F.count("*").alias("items"), F.count("want_id").alias("known"), F.count_if(F.col("got_id") == F.col("want_id")).alias("found"))


@query()
def device_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Saved scans and log records of one sid: by position where there are equally many, else by the likeness of their sections."""
    a = table(spark, d, "last_scans").filter("sid is not null").select("sid", "row_id", "created_at", tokens.chunk_bigrams(F.col("section")).alias("a"))
    b = table(spark, d, "scan_log").filter("sid is not null").select("sid", "rec_id", "scanned_at", tokens.chunk_bigrams(F.col("section")).alias("b"))
    whole = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.length(x) == 2)
    return evaluate.correlated(a, b, "sid", "row_id", "rec_id", "created_at", "scanned_at", tokens.jaccard(whole("a"), whole("b"))).withColumn("score", F.round("score", 6))


@query("SELECT kind_of_image, CASE WHEN reviewed = false AND status = 'halal' THEN 'unknown' ELSE status END AS shown, count(*) AS n FROM findings GROUP BY 1, 2")
def shown_tally(spark: SparkSession, d: str) -> DataFrame:
    """Findings by kind of image and by the status that may be shown."""
    shown = evaluate.effective_status(F.col("status"), F.col("reviewed"))
    return evaluate.histogram(table(spark, d, "findings").withColumn("shown", shown), "shown", ("kind_of_image",))


@query(f"WITH {_ITEMS} SELECT file_name, count(*) AS n, count_if(outcome IN ('correct', 'wrong')) AS judged, count_if(outcome = 'unknown') AS unknown, count_if(outcome = 'unmatched') AS unmatched, count_if(outcome = 'correct') AS correct FROM r GROUP BY file_name")
def image_rollup(spark: SparkSession, d: str) -> DataFrame:
    """What became of the items of each image."""
    return evaluate.image_rollup(_scored(spark, d))


@query("WITH c AS (SELECT DISTINCT unnest(names) AS name, sources FROM ingredient_entries), o AS (SELECT DISTINCT name, unnest(sources) AS org FROM c) SELECT org, count(*) AS n FROM o WHERE org IS NOT NULL AND name IS NOT NULL GROUP BY org ORDER BY n DESC, org LIMIT 10")
def issuer_tally(spark: SparkSession, d: str) -> DataFrame:
    """The ten sources that cite most names (a top-k report)."""
    cited = table(spark, d, "ingredient_entries").select(F.explode("names").alias("name"), "sources").select("name", F.explode("sources").alias("org")).filter("name is not null and org is not null").distinct()
    return cited.groupBy("org").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "org").limit(10)


def _aligned_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items with the finding they are aligned with, judged by the status that may be shown; and the judged findings of these images."""
    gt = table(spark, d, "gt_records")
    items = evaluate.facts(gt, "gt_id", "file_name", "ingredients").join(gt.select("gt_id", "category"), "gt_id").withColumn("gt_no", F.col("gt_id") * 1000 + F.col("gi"))
    named = items.select("file_name", "gt_no", F.col("raw").alias("term"), "expected").filter("trim(term) <> '' and file_name is not null")
    every = table(spark, d, "findings").select("file_name", F.col("finding_id").alias("finding_no"), F.col("raw").alias("term"), "matched_term", "status", "reviewed")
    f = every.filter("trim(term) <> ''").drop("reviewed")
    pairs = evaluate.preferred(named, f, evaluate.aligned(named.drop("expected"), f.drop("status"))).select("gt_no", "finding_no")
    shown = every.select("finding_no", evaluate.effective_status(F.col("status"), F.col("reviewed")).alias("status"))
    rows = items.join(pairs.join(shown, "finding_no"), "gt_no", "left")
    matched = F.col("status").isNotNull() & (F.col("status") != "unmatched")
    rows = rows.withColumn("outcome", evaluate.outcome(F.col("expected"), F.col("status"), matched))
    judged = every.filter("status in ('halal', 'haram', 'syubhat')").join(gt.select("file_name").distinct(), "file_name", "left_semi")
    return rows, judged.select("file_name", "finding_no").join(pairs.select("finding_no", F.lit(True).alias("hit")).distinct(), "finding_no", "left")


@query()
def aligned_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metric suite over the aligned items, by category."""
    return evaluate.metrics(_aligned_rows(spark, d)[0], ("category",))


@query()
def aligned_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Judged findings of each image that no item is aligned with."""
    return _aligned_rows(spark, d)[1].groupBy("file_name").agg(F.count("*").alias("verdicts"), F.count_if(F.col("hit").isNull()).alias("leaked"))


__all__ = ["ORACLE", "QUERIES", "query"]
