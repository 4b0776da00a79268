"""Named queries over the driver's tables, each with its twin in DuckDB SQL where SQL can say it.

A text column plays a section (see ``extract.text_container``):

    documents.text      StringData        pages.html       Resources
    pages.url           StringData        conversations    ReadOnlyData
    events.props        WritableData
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphsift import container_queries
from glyphsift.functions import classify, rank, sections
from glyphsift.functions.demangle import demangle
from glyphsift.operators import aggregate, dedup, extract, select
from glyphsift.plans import pipeline, sinks
from glyphsift.sources.config import PROFILES, Config, merged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: table, key, column, section name, section type
CONTAINERS = {
    "documents": ("documents", "doc_id", "text", "documents.text", "StringData"),
    "urls": ("pages", "page_id", "url", "pages.url", "StringData"),
    "html": ("pages", "page_id", "html", "pages.html", "Resources"),
    "conversations": ("conversations", "conv_id * 1000 + turn", "text", "conversations.text", "ReadOnlyData"),
    "events": ("events", "event_id", "props", "events.props", "WritableData"),
}
TEXT = Config(extraction=extract.Extraction(encodings=("ascii",), drop_padding=False))


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def container(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, key, column, section, kind = CONTAINERS[name]
    rows = table(spark, sf_dir, source).select(F.expr(key).alias("key"), F.col(column).alias("text"))
    return extract.text_container(extract.spread(rows), "key", "text", section, kind)


def runs(spark: SparkSession, sf_dir: str, *names: str, config: Config = TEXT) -> DataFrame:
    out = [pipeline.strings_of_texts(container(spark, sf_dir, n), config) for n in names or ("documents",)]
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    return out[0]


def found(spark: SparkSession, sf_dir: str, *names: str, config: Config = TEXT) -> DataFrame:
    plain = merged(config, {"output": {"dedup": False}})
    return pipeline.found_strings(runs(spark, sf_dir, *names, config=config), plain)


# --- SQL pieces -------------------------------------------------------------------------------------------

P = classify.PATTERNS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def runs_sql(*names: str, least: int = 4, most: int = 1024, entropy: bool = False) -> str:
    """CTEs up to ``runs``: path, section, section_type, text, "offset" in bytes, length; and entropy, top_share."""
    parts = []
    for n in names or ("documents",):
        source, key, column, section, kind = CONTAINERS[n]
        parts.append(f"SELECT '{section}/' || CAST({key} AS VARCHAR) AS path, '{section}' AS section, '{kind}' AS section_type, regexp_extract_all({column}, '[\\x20-\\x7E\\t]+|[^\\x20-\\x7E\\t]') AS toks FROM {source} WHERE {column} IS NOT NULL")
    sql = f"""WITH lists AS ({' UNION ALL '.join(parts)}),
toks AS (SELECT path, section, section_type, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM lists),
offs AS (SELECT *, CAST(coalesce(sum(strlen(tok)) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM toks),
runs AS (SELECT path, section, section_type, tok AS text, "offset", CAST(strlen(tok) AS BIGINT) AS length FROM offs WHERE regexp_matches(tok, '^[\\x20-\\x7E\\t]') AND length(tok) BETWEEN {least} AND {most})"""
    if entropy:
        sql += """,
shares AS (SELECT *, list_transform(list_distinct(string_split(text, '')), lambda c: (length(text) - length(replace(text, c, ''))) / length(text)) AS s FROM runs),
stats AS (SELECT * EXCLUDE (s), list_sum(list_transform(s, lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END)) AS entropy, list_max(s) AS top_share, length(regexp_replace(text, '[^\\x20-\\x7E]+', '', 'g')) / length(text) AS printable FROM shares)"""
    return sql


TLDS = ", ".join(map(q, classify.GENERIC_TLDS))
SQL_TLD = "lower(regexp_extract(text, '[a-zA-Z0-9.-]+\\.([a-zA-Z]{2,})', 1))"
SQL_TAG = {
    "url": f"regexp_matches(text, {q(P['url'])})",
    "domain": f"(regexp_matches(text, {q(P['domain'])}) AND NOT regexp_matches(text, {q(P['url'])}) AND strlen(text) >= 4 AND (length({SQL_TLD}) = 2 OR {SQL_TLD} IN ({TLDS})))",
    "ipv4": f"(regexp_extract(text, {q(P['ipv4'])}) <> '' AND len(list_filter(string_split(regexp_extract(text, {q(P['ipv4'])}), '.'), lambda x: TRY_CAST(x AS INTEGER) > 255)) = 0)",
    "ipv6": f"regexp_matches(text, {q(P['ipv6'])})",
    "filepath": f"(regexp_matches(text, {q(P['posix_path'])}) OR regexp_matches(text, {q(P['windows_path'])}))",
    "regpath": f"regexp_matches(text, {q(P['regpath'])})",
    "guid": f"regexp_matches(text, {q(P['guid'])})",
    "email": f"regexp_matches(text, {q(P['email'])})",
    "fmt": f"regexp_matches(text, {q(P['fmt'])})",
    "b64": f"((regexp_extract(text, {q(P['b64'])}) <> '' AND length(regexp_extract(text, {q(P['b64'])})) % 4 = 0) OR (regexp_matches(text, {q(P['url'])}) AND regexp_matches(regexp_extract(text, '\\?(.*)$', 1), {q(P['b64'])})))",
    "user-agent-ish": f"regexp_matches(text, {q(P['user-agent-ish'])})",
    "version": f"(section_type = 'Resources' AND regexp_matches(text, {q(P['version'])}))",
}
SQL_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {SQL_TAG[t]} THEN '{t}' END" for t in (*classify.ORDER, "version")) + "], lambda x: x IS NOT NULL)"


def cases(values: dict, key: str, otherwise: str = "0") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in values.items()) + f" ELSE {otherwise} END"


SQL_WEIGHT = cases(rank.SECTION_WEIGHTS, "section_type")
SQL_BOOST = f"(list_sum(list_append(list_transform(tags, lambda t: {cases(rank.BOOSTS, 't')}), 0)) + CASE WHEN len(tags) > 1 THEN (len(tags) - 1) * 3 ELSE 0 END)"
SQL_CONTEXT = f"CASE WHEN section_type IN ('StringData', 'Resources') THEN ({SQL_BOOST}) * 6 // 5 ELSE {SQL_BOOST} END"
SQL_ENTROPY = "CASE WHEN entropy > 4.5 THEN -15 WHEN entropy > 3.8 THEN -8 ELSE 0 END"
SQL_LENGTH = "CASE WHEN length <= 50 THEN 0 WHEN length <= 200 THEN -2 WHEN length <= 500 THEN -5 WHEN length <= 1000 THEN -10 ELSE -20 END"
SQL_REPEAT = "CASE WHEN top_share > 0.7 THEN -12 WHEN top_share > 0.5 THEN -6 ELSE 0 END"
SQL_HEX = "length(regexp_replace(text, '[^0-9a-fA-F]+', '', 'g'))"
SQL_NOISE = f"CASE WHEN NOT regexp_matches(text, '[^ \\x00]') THEN -20 WHEN {SQL_HEX} * 10 > strlen(text) * 8 THEN -10 WHEN length(text) - length(replace(text, chr(9), '')) > 3 OR length(text) - length(replace(text, ',', '')) > 5 THEN -8 ELSE 0 END"
SQL_ENCODING = "CASE WHEN printable > 0.95 THEN 10 WHEN printable > 0.80 THEN 7 ELSE 3 END"
SQL_SCORE = f"CAST(least(100, greatest(0, {SQL_WEIGHT} + {SQL_ENCODING} + {SQL_CONTEXT} + {SQL_ENTROPY} + {SQL_LENGTH} + {SQL_REPEAT} + {SQL_NOISE})) AS INTEGER)"


def tagged_sql(*names: str, then: str, where: str = "true") -> str:
    return f"{runs_sql(*names)}, tagged AS (SELECT *, {SQL_TAGS} AS tags FROM runs) {then.format(t=f'(SELECT * FROM tagged WHERE {where})')}"


def found_sql(*names: str, then: str) -> str:
    """``then`` reads {t}: path, section, section_type, text, offset, length, tags, score."""
    return f"{runs_sql(*names, entropy=True)}, tagged AS (SELECT *, {SQL_TAGS} AS tags FROM stats), found AS (SELECT path, section, section_type, text, \"offset\", length, tags, {SQL_SCORE} AS score FROM tagged) {then.format(t='found')}"


def flat(df: DataFrame, *columns) -> DataFrame:
    """Arrays joined by commas, for comparison."""
    return df.select(*[F.array_join(c, ",").alias(c) if c in ("tags", "surrounding") else c for c in columns])


NETWORK = ("url", "domain", "ipv4", "ipv6")
SQL_NETWORK = "list_has_any(tags, ['url', 'domain', 'ipv4', 'ipv6'])"


@query("top_network_indicators", found_sql("documents", "urls", "html", then="SELECT text, array_to_string(tags, ',') AS tags, score, path, \"offset\" FROM {t} WHERE " + SQL_NETWORK + ' ORDER BY score DESC, path, "offset", text LIMIT 100'))
def top_network_indicators(spark, d):
    best = select.top(select.only(found(spark, d, "documents", "urls", "html"), *NETWORK), 100)
    return flat(best, "text", "tags", "score", "path", "offset")


# --- extraction -------------------------------------------------------------------------------------------


@query("ext_1_ascii_runs", runs_sql(most=1 << 30) + " SELECT path, count(*) AS n, CAST(sum(length) AS BIGINT) AS n_bytes FROM runs GROUP BY path")
def ext_1(spark, d):
    every = merged(TEXT, {"extraction": {"max_length": 1 << 30}})
    return runs(spark, d, config=every).groupBy("path").agg(F.count("*").alias("n"), F.sum("length").alias("n_bytes"))


@query("ext_1_byte_offsets", runs_sql() + ' SELECT path, "offset", length, text FROM runs')
def ext_1_offsets(spark, d):
    return runs(spark, d).select("path", "offset", "length", "text")


@query("ext_2_utf8_runs", "SELECT doc_id, count(*) AS n, CAST(sum(strlen(r)) AS BIGINT) AS n_bytes FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:[\\x20-\\x7E\\t]|[^\\x00-\\x7F]){4,}')) AS r FROM documents) GROUP BY doc_id")
def ext_2(spark, d):
    every = merged(TEXT, {"extraction": {"max_length": 1 << 30, "encodings": ["utf-8"]}})
    each = runs(spark, d, config=every).groupBy("path").agg(F.count("*").alias("n"), F.sum("length").alias("n_bytes"))
    return each.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "n", "n_bytes")


def wide(spark, d, encoding: str, codec: str, *others: str) -> DataFrame:
    """The documents as UTF-16 bytes, between two NULs so that runs end."""
    body = F.concat(F.lit(b"\x00\x00").cast("binary"), F.encode(F.regexp_replace("text", r"[^\x20-\x7E]", "\n"), codec), F.lit(b"\x00\x00").cast("binary"))
    rows = extract.spread(table(spark, d, "documents").select("doc_id", "text")).select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.lit("Unknown").alias("format"), F.lit("documents").alias("section"), F.lit("StringData").alias("section_type"), F.lit(0).cast("long").alias("base_offset"), F.lit(None).cast("decimal(20,0)").alias("base_rva"), F.lit("SectionData").alias("source"), body.alias("content"))
    how = extract.Extraction(encodings=(encoding, *others), drop_padding=False)
    return extract.bounded(extract.scan(rows, how), how).select("path", "text", "offset", "length")


WIDE_SQL = r"""WITH l AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x20-\x7E]', chr(10), 'g'), '[\x20-\x7E]+|\n') AS toks FROM documents),
t AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM l),
o AS (SELECT *, 2 + 2 * CAST(coalesce(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM t)
SELECT 'documents/' || CAST(doc_id AS VARCHAR) AS path, tok AS text, off AS "offset", CAST(2 * length(tok) AS BIGINT) AS length FROM o WHERE tok <> chr(10) AND length(tok) >= 3 AND length(tok) <= 1024"""


@query("ext_3_utf16le", WIDE_SQL)
def ext_3(spark, d):
    return wide(spark, d, "utf-16le", "UTF-16LE")


@query("ext_4_utf16be", WIDE_SQL)
def ext_4(spark, d):
    return wide(spark, d, "utf-16be", "UTF-16BE")


@query("ext_5_wide_confidence", "SELECT p, t, n, CASE WHEN p > 0.9 AND t THEN 'high' WHEN p > 0.7 AND n >= 3 THEN 'medium' WHEN p > 0.5 THEN 'low' ELSE 'none' END AS confidence FROM (SELECT CAST(p AS DOUBLE) AS p, t, n FROM (VALUES (0.95, true, 5), (0.95, false, 5), (0.6, true, 5), (0.3, true, 9)) v(p, t, n))")
def ext_5(spark, d):
    rows = spark.createDataFrame([(0.95, True, 5), (0.95, False, 5), (0.6, True, 5), (0.3, True, 9)], "p double, t boolean, n int")
    return rows.withColumn("confidence", extract.wide_confidence(F.col("p"), F.col("t"), F.col("n")))


@query("ext_6_interleaved", WIDE_SQL)
def ext_6(spark, d):
    """With ASCII wanted too, a wide run isn't found a second time as plain text."""
    return wide(spark, d, "utf-16le", "UTF-16LE", "ascii")


@query("ext_7_length_bounds", runs_sql(least=6, most=64) + " SELECT length, count(*) AS n FROM runs GROUP BY length")
def ext_7(spark, d):
    return runs(spark, d, config=merged(TEXT, {"extraction": {"min_length": 6, "max_length": 64}})).groupBy("length").agg(F.count("*").alias("n"))


@query("ext_8_section_minimums", runs_sql("documents", "events") + " SELECT section, count(*) AS n FROM runs WHERE length >= CASE WHEN section_type = 'WritableData' THEN 6 ELSE 4 END GROUP BY section")
def ext_8(spark, d):
    how = merged(TEXT, {"extraction": {"section_minimums": True}})
    return runs(spark, d, "documents", "events", config=how).groupBy("section").agg(F.count("*").alias("n"))


@query("ext_9_encoding_filter", runs_sql("urls") + " SELECT path, 'ascii' AS encoding, count(*) AS n FROM runs GROUP BY path")
def ext_9(spark, d):
    """Of all encodings wanted by the scan only one is let through by its alias."""
    how = merged(TEXT, {"extraction": {"encodings": ["a"]}})
    return runs(spark, d, "urls", config=how).groupBy("path", "encoding").agg(F.count("*").alias("n"))


@query("ext_10_section_filter", runs_sql("urls") + " SELECT section, count(*) AS n FROM runs GROUP BY section")
def ext_10(spark, d):
    how = merged(TEXT, {"extraction": {"include_sections": ["pages.url"]}})
    return runs(spark, d, "urls", "html", "conversations", config=how).groupBy("section").agg(F.count("*").alias("n"))


@query("ext_12_padding", runs_sql() + " SELECT count(*) AS n FROM runs WHERE length(replace(text, left(text, 1), '')) > 0")
def ext_12(spark, d):
    return runs(spark, d, config=merged(TEXT, {"extraction": {"drop_padding": True}})).agg(F.count("*").alias("n"))


# --- tags -------------------------------------------------------------------------------------------------

#: Strings of the tags that the tables don't hold: each rule's plain case, its bounds and near misses.
SAMPLES = (
    "https://docs.garden.io/beds?row=7", "http://garden.io/?q=Um9zZXMgYW5kIHR1bGlwcyBpbiByb3dz", "ftp://garden.io/beds", "HTTP://GARDEN.IO", "https://",
    "seeds.garden.org", "garden.invalidtld", "a.de", "x.y", "tool-shed.co.uk/path",
    "8.8.4.4", "255.255.255.255", "256.1.1.1", "1.2.3", "010.001.000.009", "fe80:0:0:0:1:2:3:4", "fe80::4", "12:34",
    "/var/lib/garden/beds.db", "/", "relative/path", "D:\\Garden\\beds.txt", "D:", "\\\\server\\share",
    "HKEY_CURRENT_USER\\Software\\Garden", "HKCU\\Software", "HKEY_CLASSES_ROOT", "{0A1B2C3D-4E5F-6071-8293-A4B5C6D7E8F9}", "0a1b2c3d-4e5f-6071-8293-a4b5c6d7e8f9", "{0A1B2C3D-4E5F}",
    "gardener@seeds.garden.org", "gardener@", "@garden.org", "%d beds of %s", "100% %", "row {2} of {bed}", "{}",
    "Um9zZXMgYW5kIHR1bGlwcyBpbiByb3dz", "Um9zZXMgYW5kIHR1bGlwcyBpbiByb3d", "Um9zZXM=", "Opera/9.80 (X11; Linux i686)", "Mozilla/4.0 (compatible)", "4.15.0.2", "v10.4", "release 12",
    "api_key=fedcba9876543210fedcba9876543210", "token: none", "nothing of the kind", "192.0.2.7 ö ß",
)
SAMPLES_SQL = "(SELECT text, section_type FROM (VALUES " + ", ".join(f"({q(s)})" for s in SAMPLES) + ") v(text), (VALUES ('StringData'), ('Resources')) w(section_type))"


def samples(spark) -> DataFrame:
    return spark.createDataFrame([(s, k) for s in SAMPLES for k in ("StringData", "Resources")], "text string, section_type string").withColumn("source", F.lit("SectionData"))


def tag_rows(spark, d) -> DataFrame:
    """The samples and the strings of urls, html and conversations: section, section_type, source, text."""
    columns = ("section", "section_type", "source", "text")
    own = samples(spark).withColumn("section", F.lit("samples"))
    return runs(spark, d, "urls", "html", "conversations").select(*columns).unionByName(own.select(*columns))


TAG_ROWS_SQL = runs_sql("urls", "html", "conversations") + f", every AS (SELECT section, section_type, text FROM runs UNION ALL SELECT 'samples', section_type, text FROM {SAMPLES_SQL} s)"


def _tag_query(number: str, tag: str) -> None:
    predicate: Callable[[Column], Column] = classify.PREDICATES[tag]
    name = f"cls_{number}_{tag.replace('-', '_')}"

    def run(spark, d):
        own = samples(spark).where("section_type = 'StringData'").select(F.lit("samples").alias("section"), "text")
        rows = runs(spark, d, "documents", "urls", "html", "conversations").select("section", "text").unionByName(own)
        return rows.where(predicate(F.col("text"))).groupBy("section", "text").agg(F.count("*").alias("n"))

    sql = runs_sql("documents", "urls", "html", "conversations") + f", every AS (SELECT section, text FROM runs UNION ALL SELECT 'samples', text FROM {SAMPLES_SQL} s WHERE section_type = 'StringData') SELECT section, text, count(*) AS n FROM every WHERE {SQL_TAG[tag]} GROUP BY section, text"
    query(name, sql)(run)


for _n, _t in (("1", "url"), ("2", "domain"), ("3", "ipv4"), ("4", "ipv6"), ("5", "filepath"), ("7", "regpath"), ("8", "guid"), ("9", "email"), ("10", "fmt"), ("11", "b64"), ("12", "user-agent-ish")):
    _tag_query(_n, _t)


@query("cls_6_windows_path", runs_sql("documents", "urls", "html", "conversations") + f", every AS (SELECT section, text FROM runs UNION ALL SELECT 'samples', text FROM {SAMPLES_SQL} s WHERE section_type = 'StringData') SELECT section, text, count(*) AS n FROM every WHERE regexp_matches(text, '[A-Za-z]:' || chr(92) || chr(92) || '[^' || chr(92) || 'x00\\n\\r]*') GROUP BY section, text")
def cls_6(spark, d):
    own = samples(spark).where("section_type = 'StringData'").select(F.lit("samples").alias("section"), "text")
    rows = runs(spark, d, "documents", "urls", "html", "conversations").select("section", "text").unionByName(own)
    return rows.where(F.col("text").rlike(P["windows_path"])).groupBy("section", "text").agg(F.count("*").alias("n"))


@query("cls_13_version", f"{TAG_ROWS_SQL} SELECT section, text FROM every WHERE {SQL_TAG['version']}")
def cls_13(spark, d):
    return tag_rows(spark, d).where(classify.is_version(F.col("text"), F.col("section_type"))).select("section", "text")


@query("cls_14_source_tags", "SELECT * FROM (VALUES ('ImportName', 'import'), ('ExportName', 'export'), ('ResourceString', 'resource'), ('SectionData', '')) v(source, tags)")
def cls_14(spark, d):
    rows = spark.createDataFrame([("ImportName",), ("ExportName",), ("ResourceString",), ("SectionData",)], "source string").withColumn("text", F.lit("plain"))
    return flat(rows.withColumn("tags", classify.tags(F.col("text"), F.lit("Other"), F.col("source"))), "source", "tags")


@query("cls_16_multi_tag", f"{TAG_ROWS_SQL} SELECT text, section_type, array_to_string({SQL_TAGS}, ',') AS tags FROM every")
def cls_16(spark, d):
    return flat(pipeline.tagged(tag_rows(spark, d)), "text", "section_type", "tags")


@query("cls_17_custom", f"SELECT doc_id, name FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1, text FROM {SAMPLES_SQL} s WHERE section_type = 'StringData') t, (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in classify.CUSTOM.items()) + ") c(name, p) WHERE regexp_matches(text, p)")
def cls_17(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").unionByName(samples(spark).where("section_type = 'StringData'").select(F.lit(-1).cast("long").alias("doc_id"), "text"))
    found_ = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in classify.CUSTOM.items()]), lambda x: x.isNotNull())
    return rows.select("doc_id", F.explode(found_).alias("name"))


#: Mangled names and what they say: paths with and without a hash, escapes, and names that only look mangled.
MANGLED = (
    ("_ZN6garden4beds3sow17h00ff00ff00ff00ffE", "garden::beds::sow"), ("_ZN6garden3sowE", "garden::sow"), ("__ZN6garden3sowE", "garden::sow"), ("ZN6garden3sowE", "garden::sow"),
    ("_ZN29_$LT$garden..Bed$u20$as$GT$E", "_ZN29_$LT$garden..Bed$u20$as$GT$E"), ("_ZN5_$LT$E", "<"), ("_ZN9short", "_ZN9short"), ("_ZNE", "_ZNE"), ("sow", "sow"), ("", ""),
)


@query("cls_19_demangle", "SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in MANGLED) + ") v(name, plain)")
def cls_19(spark, d):
    rows = spark.createDataFrame([r[:1] for r in MANGLED], "name string")
    return rows.withColumn("plain", demangle(F.col("name")))


SQL_CONFIDENCE = f"least(1.0, 0.5 + CASE tag WHEN 'url' THEN CASE WHEN starts_with(text, 'https://') THEN 0.3 ELSE 0.0 END + CASE WHEN length({SQL_TLD}) = 2 OR {SQL_TLD} IN ({TLDS}) THEN 0.2 ELSE 0.0 END WHEN 'filepath' THEN CASE WHEN section_type = 'StringData' THEN 0.2 ELSE 0.0 END + CASE WHEN regexp_matches(text, '^(/[^/]+)+/?$') OR regexp_matches(text, '^[A-Za-z]:\\\\') THEN 0.2 ELSE 0.0 END ELSE 0.0 END)"


@query("cls_21_confidence", f"SELECT text, section_type, tag, CAST(round({SQL_CONFIDENCE}, 3) AS DOUBLE) AS confidence FROM (SELECT text, section_type, unnest({SQL_TAGS}) AS tag FROM (SELECT text, section_type FROM {SAMPLES_SQL} s UNION ALL SELECT url, 'StringData' FROM pages))")
def cls_21(spark, d):
    rows = samples(spark).unionByName(table(spark, d, "pages").select(F.col("url").alias("text"), F.lit("StringData").alias("section_type"), F.lit("SectionData").alias("source")))
    tags = classify.tags(F.col("text"), F.col("section_type"), F.col("source"))
    each = rows.withColumn("r", F.explode(classify.results(F.col("text"), tags, F.col("section_type"))))
    return each.select("text", "section_type", F.col("r.tag").alias("tag"), F.round("r.confidence", 3).alias("confidence"))


@query("cls_22_thresholds", f"{TAG_ROWS_SQL} SELECT text, section_type, tag FROM (SELECT text, section_type, unnest({SQL_TAGS}) AS tag FROM every) WHERE round({SQL_CONFIDENCE}, 3) >= CASE tag WHEN 'url' THEN 0.8 WHEN 'domain' THEN 0.75 WHEN 'filepath' THEN 0.6 ELSE 0.7 END")
def cls_22(spark, d):
    rows = tag_rows(spark, d)
    tags = classify.tags(F.col("text"), F.col("section_type"), F.col("source"))
    kept = classify.confident(classify.results(F.col("text"), tags, F.col("section_type")))
    return rows.withColumn("r", F.explode(kept)).select("text", "section_type", F.col("r.tag").alias("tag"))


@query("cls_23_toggles", f"{TAG_ROWS_SQL} SELECT section, text FROM every WHERE {SQL_TAG['url']}")
def cls_23(spark, d):
    only_urls = classify.Detect(domains=False, ips=False, paths=False, registry=False, guids=False, emails=False, formats=False, base64=False, user_agents=False, versions=False)
    rows = tag_rows(spark, d)
    return rows.where(F.size(classify.tags(F.col("text"), F.col("section_type"), F.col("source"), only_urls)) > 0).select("section", "text")


# --- scores -----------------------------------------------------------------------------------------------


@query("rnk_1_section_weight", "SELECT * FROM (VALUES " + ", ".join(f"({q(k)}, {v})" for k, v in rank.SECTION_WEIGHTS.items()) + ") v(section_type, weight)")
def rnk_1(spark, d):
    return spark.createDataFrame([(k,) for k in rank.SECTION_WEIGHTS], "section_type string").withColumn("weight", rank.section_weight(F.col("section_type")))


@query("rnk_2_format_bonus", "SELECT * FROM (VALUES ('Elf', '.rodata.str1.1', 5), ('Pe', '.rsrc', 5), ('MachO', '__TEXT,__cstring', 5), ('Elf', '.rsrc', 0)) v(format, section, bonus)")
def rnk_2(spark, d):
    rows = spark.createDataFrame([("Elf", ".rodata.str1.1"), ("Pe", ".rsrc"), ("MachO", "__TEXT,__cstring"), ("Elf", ".rsrc")], "format string, section string")
    return rows.withColumn("bonus", rank.format_bonus(F.col("format"), F.col("section")))


@query("rnk_3_encoding_confidence", runs_sql(entropy=True) + f" SELECT path, \"offset\", {SQL_ENCODING} AS confidence FROM stats")
def rnk_3(spark, d):
    return runs(spark, d).select("path", "offset", rank.encoding_confidence(F.col("encoding"), F.col("printable")).alias("confidence"))


@query("rnk_4_semantic_boost", f"{TAG_ROWS_SQL} SELECT text, section_type, CAST({SQL_BOOST} AS INTEGER) AS boost FROM (SELECT *, {SQL_TAGS} AS tags FROM every)")
def rnk_4(spark, d):
    rows = pipeline.tagged(tag_rows(spark, d))
    return rows.select("text", "section_type", rank.semantic_boost(F.col("tags")).alias("boost"))


@query("rnk_5_context_boost", f"{TAG_ROWS_SQL} SELECT text, section_type, CAST({SQL_CONTEXT} + CASE WHEN text LIKE '%garden%' THEN 5 ELSE 0 END AS INTEGER) AS boost FROM (SELECT *, {SQL_TAGS} AS tags FROM every)")
def rnk_5(spark, d):
    """Strings about gardens play symbols here."""
    rows = pipeline.tagged(tag_rows(spark, d))
    return rows.select("text", "section_type", rank.context_boost(rank.semantic_boost(F.col("tags")), F.col("section_type"), F.col("text").contains("garden")).alias("boost"))


@query("rnk_6_entropy", runs_sql(entropy=True) + f" SELECT path, \"offset\", round(entropy, 6) + 0.0 AS entropy, {SQL_ENTROPY} AS penalty FROM stats")
def rnk_6(spark, d):
    return runs(spark, d).select("path", "offset", (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"), rank.entropy_penalty(F.col("entropy")).alias("penalty"))


@query("rnk_7_length_penalty", runs_sql() + f" SELECT length, {SQL_LENGTH} AS penalty, count(*) AS n FROM runs GROUP BY ALL")
def rnk_7(spark, d):
    return runs(spark, d).groupBy("length", rank.length_penalty(F.col("length")).alias("penalty")).agg(F.count("*").alias("n"))


@query("rnk_8_repetition", runs_sql(entropy=True) + f" SELECT path, \"offset\", {SQL_REPEAT} AS penalty FROM stats")
def rnk_8(spark, d):
    return runs(spark, d).select("path", "offset", rank.repetition_penalty(F.col("top_share")).alias("penalty"))


@query("rnk_9_noise", runs_sql("documents", "html") + f" SELECT {SQL_NOISE} AS penalty, count(*) AS n FROM runs GROUP BY ALL")
def rnk_9(spark, d):
    return runs(spark, d, "documents", "html").groupBy(rank.noise_penalty(F.col("text")).alias("penalty")).agg(F.count("*").alias("n"))


@query("rnk_10_score", found_sql("documents", "urls", "html", "conversations", "events", then='SELECT path, "offset", score FROM {t}'))
def rnk_10(spark, d):
    return found(spark, d, "documents", "urls", "html", "conversations", "events").select("path", "offset", "score")


@query("rnk_11_multipliers", f"{runs_sql('urls', 'conversations', entropy=True)}, tagged AS (SELECT *, {SQL_TAGS} AS tags FROM stats) SELECT path, \"offset\", CAST(least(100, greatest(0, CASE section_type WHEN 'StringData' THEN 30 ELSE 45 END + {SQL_ENCODING} + ({SQL_CONTEXT}) // 2 + 2 * ({SQL_ENTROPY} + {SQL_LENGTH} + {SQL_REPEAT} + {SQL_NOISE}))) AS INTEGER) AS score FROM tagged")
def rnk_11(spark, d):
    own = rank.Ranking(section_weights={"StringData": 20, "ReadOnlyData": 30}, section_weight_multiplier=1.5, semantic_boost_multiplier=0.5, noise_penalty_multiplier=2.0)
    return found(spark, d, "urls", "conversations", config=merged(TEXT, {"ranking": own})).select("path", "offset", "score")


@query("rnk_12_bands", found_sql("documents", "urls", "conversations", then="SELECT CASE " + " ".join(f"WHEN score >= {low} THEN '{n}'" for low, n in rank.BANDS) + " END AS band, count(*) AS n FROM {t} GROUP BY ALL"))
def rnk_12(spark, d):
    return aggregate.by_band(found(spark, d, "documents", "urls", "conversations"))


# --- groups -----------------------------------------------------------------------------------------------

SQL_CANON = "trim(regexp_replace(text, '[\\t\\n\\r]', ' ', 'g'))"


@query("agg_1_dedup", runs_sql("documents", "html") + f" SELECT path, {SQL_CANON} AS canonical_text, arg_max(section, {SQL_WEIGHT} * 100000000000 - \"offset\") AS best_section, 'ascii' AS primary_encoding, count(*) AS n_occurrences, min(\"offset\") AS first_offset FROM runs GROUP BY path, {SQL_CANON}")
def agg_1(spark, d):
    groups = dedup.deduplicate(runs(spark, d, "documents", "html"))
    return groups.select("path", "canonical_text", "best_section", "primary_encoding", F.size("occurrences").cast("long").alias("n_occurrences"), F.get("occurrences", F.lit(0))["offset"].alias("first_offset"))


@query("agg_2_canonical", runs_sql("documents", "html") + f' SELECT path, "offset", {SQL_CANON} AS canonical_text FROM runs')
def agg_2(spark, d):
    return runs(spark, d, "documents", "html").select("path", "offset", dedup.canonical(F.col("text")).alias("canonical_text"))


@query("agg_3_best_section", runs_sql("urls", "html") + f" SELECT {SQL_CANON} AS canonical_text, arg_max(section, {SQL_WEIGHT} * 100000000000 - \"offset\") AS best_section FROM runs GROUP BY path, {SQL_CANON}")
def agg_3(spark, d):
    return dedup.deduplicate(runs(spark, d, "urls", "html")).select("canonical_text", "best_section")


@query("agg_8_no_dedup", found_sql("urls", "conversations", then="SELECT path, text, count(*) AS n FROM {t} GROUP BY ALL"))
def agg_8(spark, d):
    return found(spark, d, "urls", "conversations").groupBy("path", "text").agg(F.count("*").alias("n"))


@query("agg_4_count_by_tag", tagged_sql("documents", "urls", "html", then="SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM {t}) GROUP BY tag"))
def agg_4(spark, d):
    return aggregate.count_by_tag(pipeline.tagged(runs(spark, d, "documents", "urls", "html")))


@query("agg_5_count_by_section", runs_sql("documents", "urls", "html", "conversations", "events") + " SELECT section, count(*) AS n FROM runs GROUP BY section")
def agg_5(spark, d):
    return aggregate.count_by_section(runs(spark, d, "documents", "urls", "html", "conversations", "events"))


@query("agg_6_distinct", runs_sql() + " SELECT DISTINCT text FROM runs")
def agg_6(spark, d):
    return aggregate.distinct_texts(runs(spark, d))


@query("agg_7_summary", found_sql("documents", "urls", then="SELECT count(*) AS total_strings, count(*) FILTER (WHERE score >= 80) AS high_confidence FROM {t}"))
def agg_7(spark, d):
    return aggregate.summary(found(spark, d, "documents", "urls"))


@query("agg_9_by_category", found_sql("documents", "urls", "html", then="SELECT tags[1] AS category, count(*) AS n, count(DISTINCT text) AS n_texts, max(score) AS best FROM {t} WHERE len(tags) > 0 GROUP BY tags[1]"))
def agg_9(spark, d):
    return aggregate.by_category(found(spark, d, "documents", "urls", "html"))


@query("agg_10_by_confidence", found_sql("documents", "urls", then="SELECT CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM {t} GROUP BY ALL"))
def agg_10(spark, d):
    return aggregate.by_confidence(found(spark, d, "documents", "urls"))


# --- windows, joins, sets ---------------------------------------------------------------------------------


@query("win_1_neighbours", runs_sql("conversations") + ' SELECT path, "offset", array_to_string(list(text) OVER (PARTITION BY path, section ORDER BY "offset" ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), \',\') AS surrounding FROM runs')
def win_1(spark, d):
    return flat(select.neighbours(runs(spark, d, "conversations")), "path", "offset", "surrounding")


@query("win_3_rule_ids", found_sql("urls", then="SELECT path, \"offset\", tag || '_' || CAST(row_number() OVER (PARTITION BY path, tag ORDER BY score DESC, \"offset\", text) AS VARCHAR) AS rule_id FROM (SELECT *, regexp_replace(coalesce(tags[1], 'string'), '[^a-z0-9]', '_', 'g') AS tag FROM {t})"))
def win_3(spark, d):
    return sinks.rule_ids(found(spark, d, "urls")).select("path", "offset", "rule_id")


@query("win_4_top_per_container", found_sql("documents", then='SELECT path, "offset", score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, "offset", text) AS r FROM {t}) WHERE r <= 3'))
def win_4(spark, d):
    return select.top_each(found(spark, d), 3).select("path", "offset", "score", "rank")


HALVES = "SELECT text FROM runs WHERE CAST(split_part(path, '/', 2) AS BIGINT) % 2 = {r}"


def half(spark, d, r: int) -> DataFrame:
    """Strings of the documents with even or odd ids; only those are scanned."""
    sections_ = container(spark, d, "documents").where(F.element_at(F.split("path", "/"), -1).cast("long") % 2 == r)
    return pipeline.strings_of_texts(sections_, TEXT).select("text")


@query("joi_1_section_attributes", runs_sql("urls", "conversations") + """, sections AS (SELECT 'pages.url/' || CAST(page_id AS VARCHAR) AS path, 'pages.url' AS section, CAST(strlen(url) AS BIGINT) AS size, 40 AS weight FROM pages WHERE page_id % 3 > 0
UNION ALL SELECT 'conversations.text/' || CAST(conv_id * 1000 + turn AS VARCHAR), 'conversations.text', CAST(strlen(text) AS BIGINT), 25 FROM conversations WHERE (conv_id * 1000 + turn) % 3 > 0)
SELECT path, section, text, "offset", size, weight FROM runs JOIN sections USING (path, section)""")
def joi_1(spark, d):
    """Attributes of two thirds of the sections; strings of the others have no partner."""
    chosen = container(spark, d, "urls").unionByName(container(spark, d, "conversations")).where(F.element_at(F.split("path", "/"), -1).cast("long") % 3 > 0)
    attributes = chosen.select("path", "section", F.octet_length("content").cast("long").alias("size"), rank.section_weight(F.col("section_type")).alias("weight"))
    return select.section_attributes(runs(spark, d, "urls", "conversations"), attributes).select("path", "section", "text", "offset", "size", "weight")


@query("joi_3_known_names", runs_sql("urls") + " SELECT text, is_known, count(*) AS n FROM (SELECT text, text IN (SELECT url FROM pages WHERE url LIKE 'http:%') AS is_known FROM runs) GROUP BY text, is_known")
def joi_3(spark, d):
    """The urls without encryption are the known names."""
    names = table(spark, d, "pages").where("url LIKE 'http:%'").select(F.col("url").alias("name"))
    return select.known_names(runs(spark, d, "urls"), names).groupBy("text", "is_known").agg(F.count("*").alias("n"))


@query("joi_4_diff", runs_sql() + f", a AS (SELECT DISTINCT * FROM ({HALVES.format(r=0)})), b AS (SELECT DISTINCT * FROM ({HALVES.format(r=1)})) SELECT text, 'removed' AS change FROM a WHERE text NOT IN (SELECT text FROM b) UNION ALL SELECT text, 'added' FROM b WHERE text NOT IN (SELECT text FROM a)")
def joi_4(spark, d):
    return select.changes(half(spark, d, 0), half(spark, d, 1))


@query("joi_5_weight_lookup", tagged_sql("urls", then=f"SELECT tag, {cases(rank.BOOSTS, 'tag')} AS boost, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM {{t}}) GROUP BY ALL"))
def joi_5(spark, d):
    each = pipeline.tagged(runs(spark, d, "urls")).select(F.explode("tags").alias("tag"))
    return each.groupBy("tag", rank.lookup(rank.BOOSTS, F.col("tag")).alias("boost")).agg(F.count("*").alias("n"))


@query("joi_7_references", runs_sql("conversations") + ", a AS (SELECT path, text, \"offset\" AS rva, length FROM runs), r AS (SELECT path, CAST(rva + length / 2 AS BIGINT) AS address FROM a WHERE length % 2 = 0) SELECT a.path, text, rva, address FROM a JOIN r ON a.path = r.path AND address >= rva AND address < rva + length")
def joi_7(spark, d):
    strings = runs(spark, d, "conversations").select("path", "text", F.col("offset").alias("rva"), "length")
    pointers = strings.where("length % 2 = 0").select("path", (F.col("rva") + (F.col("length") / 2).cast("long")).alias("address"))
    return select.referenced(strings, pointers, bin_bytes=64)


@query("fil_12_mask", runs_sql("urls") + " SELECT path, \"offset\" FROM runs WHERE text NOT IN (SELECT url FROM pages WHERE url LIKE 'http:%')")
def fil_12(spark, d):
    """The urls without encryption are the mask."""
    return select.mask(runs(spark, d, "urls"), table(spark, d, "pages").where("url LIKE 'http:%'").select(F.col("url").alias("text"))).select("path", "offset")


@query("set_1_union", runs_sql("documents", "conversations", "urls") + " SELECT section, count(*) AS n, count(DISTINCT text) AS n_texts FROM runs GROUP BY section")
def set_1(spark, d):
    return runs(spark, d, "documents", "conversations", "urls").groupBy("section").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"))


@query("set_2_except_all", runs_sql() + f" {HALVES.format(r=0)} EXCEPT ALL {HALVES.format(r=1)}")
def set_2(spark, d):
    return half(spark, d, 0).exceptAll(half(spark, d, 1))


@query("set_3_intersect", runs_sql() + f" {HALVES.format(r=0)} INTERSECT {HALVES.format(r=1)}")
def set_3(spark, d):
    return half(spark, d, 0).intersect(half(spark, d, 1))


# --- filters and orders -----------------------------------------------------------------------------------


@query("fil_1_only", tagged_sql("documents", "html", where="list_has_any(tags, ['email', 'ipv4'])", then="SELECT path, \"offset\", array_to_string(tags, ',') AS tags FROM {t}"))
def fil_1(spark, d):
    return flat(select.only(pipeline.tagged(runs(spark, d, "documents", "html")), "email", "ipv4"), "path", "offset", "tags")


@query("fil_2_exclude", tagged_sql("urls", "html", where="NOT list_has_any(tags, ['filepath'])", then='SELECT path, "offset" FROM {t}'))
def fil_2(spark, d):
    return select.exclude(pipeline.tagged(runs(spark, d, "urls", "html")), "filepath").select("path", "offset")


@query("fil_3_sections", runs_sql("documents", "urls", "html") + " SELECT section, count(*) AS n FROM runs WHERE section IN ('pages.url', 'pages.html') GROUP BY section")
def fil_3(spark, d):
    return select.in_sections(runs(spark, d, "documents", "urls", "html"), "pages.url", "pages.html").groupBy("section").agg(F.count("*").alias("n"))


@query("fil_4_lengths", runs_sql(least=10, most=20) + " SELECT text FROM runs")
def fil_4(spark, d):
    return runs(spark, d, config=merged(TEXT, {"extraction": {"min_length": 10, "max_length": 20}})).select("text")


@query("fil_5_encoding", runs_sql("urls") + " SELECT 'ascii' AS encoding, count(*) AS n FROM runs")
def fil_5(spark, d):
    both = merged(TEXT, {"extraction": {"encodings": ["ascii", "utf-16le"]}})
    return runs(spark, d, "urls", config=both).where(F.col("encoding").isin("ascii")).groupBy("encoding").agg(F.count("*").alias("n"))


@query("fil_6_min_score", found_sql("documents", "urls", then='SELECT path, "offset", score FROM {t} WHERE score >= 70'))
def fil_6(spark, d):
    return select.min_score(found(spark, d, "documents", "urls"), 70).select("path", "offset", "score")


@query("fil_7_no_debug", runs_sql("documents", "urls") + " SELECT section, count(*) AS n FROM runs WHERE section <> 'pages.url' GROUP BY section")
def fil_7(spark, d):
    """Urls play a debug section here."""
    rows = runs(spark, d, "documents", "urls")
    rows = rows.withColumn("section_type", F.when(F.col("section") == "pages.url", "Debug").otherwise(F.col("section_type")))
    return select.without_debug(rows).groupBy("section").agg(F.count("*").alias("n"))


_SECURE = "', '".join(PROFILES["security"]["output"]["only"])


@query("fil_8_profile_security", found_sql("urls", "documents", then=f"SELECT path, \"offset\", score FROM {{t}} WHERE length >= 6 AND score >= 70 AND list_has_any(tags, ['{_SECURE}'])"))
def fil_8(spark, d):
    return found(spark, d, "urls", "documents", config=merged(TEXT, PROFILES["security"])).select("path", "offset", "score")


@query("fil_9_stream_filters", found_sql("urls", "html", then="SELECT path, text, score FROM {t} WHERE list_contains(tags, 'url') AND score > 60 AND section = 'pages.url'"))
def fil_9(spark, d):
    strings = found(spark, d, "urls", "html")
    return strings.where(F.array_contains("tags", "url") & (F.col("score") > 60) & (F.col("section") == "pages.url")).select("path", "text", "score")


@query("fil_10_project", runs_sql() + " SELECT text FROM runs WHERE length(text) > 10")
def fil_10(spark, d):
    return runs(spark, d).where(F.length("text") > 10).select("text")


@query("fil_11_no_classify", runs_sql("urls") + " SELECT path, '' AS tags FROM runs")
def fil_11(spark, d):
    return flat(found(spark, d, "urls", config=merged(TEXT, {"output": {"classify": False, "rank": False}})), "path", "tags")


@query("fil_13_false_positives", f"{TAG_ROWS_SQL} SELECT text, {SQL_TAG['domain']} AS is_domain, {SQL_TAG['b64']} AS is_b64 FROM every")
def fil_13(spark, d):
    text = F.col("text")
    return tag_rows(spark, d).select("text", classify.is_domain(text).alias("is_domain"), classify.PREDICATES["b64"](text).alias("is_b64"))


@query("srt_1_rank_order", found_sql("urls", then='SELECT path, "offset", row_number() OVER (ORDER BY score DESC, path, "offset", text) AS place FROM {t}'))
def srt_1(spark, d):
    return select.numbered(found(spark, d, "urls")).select("path", "offset", "place")


@query("srt_2_top_n", found_sql("documents", "urls", then='SELECT path, "offset", score FROM {t} ORDER BY score DESC, path, "offset", text LIMIT 100'))
def srt_2(spark, d):
    return select.top(found(spark, d, "documents", "urls")).select("path", "offset", "score")


@query("srt_3_first_n", found_sql("urls", then='SELECT text FROM {t} ORDER BY score DESC, path, "offset", text LIMIT 10'))
def srt_3(spark, d):
    return select.top(found(spark, d, "urls"), 10).select("text")


@query("srt_4_by_offset", runs_sql("urls") + ' SELECT path, "offset" FROM runs ORDER BY path, "offset"')
def srt_4(spark, d):
    return runs(spark, d, "urls").select("path", "offset").orderBy("path", "offset")


# --- lines of text ----------------------------------------------------------------------------------------


@query("snk_2_jsonl", found_sql("urls", "html", "conversations", then="SELECT '{{\"text\":\"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(9), chr(92) || 't') || '\",\"encoding\":\"ascii\",\"offset\":' || CAST(\"offset\" AS VARCHAR) || ',\"rva\":null,\"section\":\"' || section || '\",\"length\":' || CAST(length AS VARCHAR) || ',\"tags\":[' || array_to_string(list_transform(tags, lambda t: '\"' || t || '\"'), ',') || '],\"score\":' || CAST(score AS VARCHAR) || ',\"source\":\"SectionData\"}}' AS value FROM {t}"))
def snk_2(spark, d):
    """Of ASCII runs JSON escapes quotes, backslashes and tabs."""
    return sinks.json_lines(found(spark, d, "urls", "html", "conversations"))


@query("snk_3_human", found_sql("urls", then="SELECT lpad(CAST(score AS VARCHAR), 5, ' ') || '  ' || rpad('0x' || lower(printf('%x', \"offset\")), 10, ' ') || '  ' || rpad(section, 16, ' ') || '  ' || rpad('ascii', 8, ' ') || '  ' || rpad(array_to_string(tags, ','), CAST(greatest(20, length(array_to_string(tags, ','))) AS INTEGER), ' ') || '  ' || CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS value FROM {t}"))
def snk_3(spark, d):
    return sinks.human(found(spark, d, "urls"))


@query("snk_6_csv", found_sql("urls", "conversations", then="SELECT CASE WHEN regexp_matches(text, '[\",\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END || ',ascii,' || CAST(\"offset\" AS VARCHAR) || ',' || section || ',' || array_to_string(tags, '|') || ',' || CAST(score AS VARCHAR) AS value FROM {t}"))
def snk_6(spark, d):
    return sinks.csv(found(spark, d, "urls", "conversations"))


@query("snk_4_yara")
def snk_4(spark, d):
    return sinks.yara(found(spark, d, "urls"), least=60)


SQL_SHOWN = "CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END"


@query("snk_6_markdown", found_sql("urls", "conversations", then="SELECT '| ' || CAST(score AS VARCHAR) || ' | ' || section || ' | ' || array_to_string(tags, ',') || ' | ' || replace(" + SQL_SHOWN + ", '|', chr(92) || '|') || ' |' AS value FROM {t}"))
def snk_6_markdown(spark, d):
    return sinks.markdown(found(spark, d, "urls", "conversations"))


@query("snk_6_xml", found_sql("urls", "html", then="SELECT '<string score=\"' || CAST(score AS VARCHAR) || '\" offset=\"' || CAST(\"offset\" AS VARCHAR) || '\" encoding=\"ascii\" tags=\"' || array_to_string(tags, ',') || '\">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</string>' AS value FROM {t}"))
def snk_6_xml(spark, d):
    """ASCII runs have no control character but the tab, which XML can hold."""
    return sinks.xml(found(spark, d, "urls", "html"))


# --- containers -------------------------------------------------------------------------------------------

#: One row for each branch, its bounds, and names that only look like one of it.
ELF_ROWS = (
    (".init", 0x6, "Code"), (".rodata", 0x4, "Code"), (".rodata", 0x2, "StringData"), (".rodata.str1.8", 0x32, "StringData"), (".rodata.cst16", 0x12, "Other"), (".note.gnu.build-id", 0x2, "StringData"),
    (".data.rel.ro.local", 0x3, "ReadOnlyData"), (".data.rel", 0x3, "Other"), (".bss", 0x3, "WritableData"), (".tbss", 0x403, "Other"),
    (".debug_", 0, "Debug"), (".debug", 0, "Other"), (".symtab", 0, "Debug"), (".strtab", 0x20, "Debug"), ("", 0, "Other"),
)
PE_ROWS = (
    ("CODE", 0x60000020, "Code"), (".rsrc", 0x20, "Code"), (".rodata", 0x40000040, "StringData"), (".rdata", 0xC0000040, "StringData"), (".data", 0x40000040, "ReadOnlyData"), (".data", 0xC0000040, "WritableData"),
    (".bss", 0x40000080, "WritableData"), (".rsrc", 0x40000040, "Resources"), (".xdata", 0x40000040, "Debug"), (".debug$S", 0x42000040, "Debug"), (".dbg", 0x40000040, "Other"), (".RSRC", 0x40000040, "Other"),
)
MACHO_ROWS = (
    ("__TEXT", "__stub_helper", "Code"), ("__TEXT", "__const", "StringData"), ("__TEXT", "__unwind_info", "Other"), ("__DATA", "__cstring", "WritableData"), ("__DATA", "__text", "WritableData"), ("__DATA_CONST", "__got", "ReadOnlyData"),
    ("__DATA_CONST", "__cfstring", "StringData"), ("__DATA", "__cfstring", "WritableData"), ("__DWARF", "__apple_names", "Debug"), ("__OTHER", "__debug_line", "Debug"), ("__OTHER", "__text", "Other"), ("__LINKEDIT", "", "Other"),
)


def values_sql(rows, names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else f"CAST({x} AS BIGINT)" for x in r) + ")" for r in rows) + f") v({names})"


@query("con_6_elf_class", values_sql(ELF_ROWS, "name, flags, section_type"))
def con_6(spark, d):
    rows = spark.createDataFrame([r[:2] for r in ELF_ROWS], "name string, flags long")
    return rows.withColumn("section_type", sections.elf_section_type(F.col("name"), F.col("flags")))


@query("con_10_pe_class", values_sql(PE_ROWS, "name, flags, section_type"))
def con_10(spark, d):
    rows = spark.createDataFrame([r[:2] for r in PE_ROWS], "name string, flags long")
    return rows.withColumn("section_type", sections.pe_section_type(F.col("name"), F.col("flags")))


@query("con_14_macho_class", values_sql(MACHO_ROWS, "segment, section, section_type"))
def con_14(spark, d):
    rows = spark.createDataFrame([r[:2] for r in MACHO_ROWS], "segment string, section string")
    return rows.withColumn("section_type", sections.macho_section_type(F.col("segment"), F.col("section")))


@query("con_1_unknown", "SELECT doc_id, 'Unknown' AS format FROM documents")
def con_1(spark, d):
    from glyphsift.sources import binaries

    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return binaries.containers(binaries.parse(files)).select(F.col("path").cast("long").alias("doc_id"), "format")


QUERIES |= container_queries.QUERIES
ORACLE |= container_queries.ORACLE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
