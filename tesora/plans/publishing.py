"""Queries on the record store, publishing, versions, manifests, files and pages."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesora.operators import datasets as ds
from tesora.operators import reconcile as rc
from tesora.operators import spending as sp
from tesora.plans import inputs as data
from tesora.plans.registry import query, rounded, sql_round as r
from tesora.session import shared_folder, shuffle_width
from tesora.sources import delimited as dl
from tesora.sources import files as fl
from tesora.sources import publish as pb
from tesora.sources import store as st
from tesora.sources import web
from tesora.sources import workbook as wb

# ---- record store ------------------------------------------------------------


def _records(spark, sf):
    nation = data.read(spark, sf, "nation").select(F.col("n_name").alias("municipality_name"), F.col("n_regionkey").alias("region"))
    supplier = data.read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"),
        F.col("s_name").alias("object_name"),
        F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("object_oktmo"),
    )
    yearly = (
        data.at_buyer(spark, sf, data.read(spark, sf, "orders"))
        .groupBy(F.col("n_name").alias("geography_name"), F.year("o_orderdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    registry = data.read(spark, sf, "nation").where(F.col("n_nationkey") < 20).select(
        F.col("n_name").alias("municipality_name"), F.lpad(F.col("n_nationkey").cast("string"), 8, "0").alias("oktmo")
    )
    return st.build_records({"nations": nation, "suppliers": supplier, "yearly": yearly}, registry)


_RECORDS_SQL = """reg AS (SELECT n_name, lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS code FROM nation WHERE n_nationkey < 20),
yearly AS (SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
records AS (
  SELECT 'nations' AS dataset, n_name AS municipality, coalesce(code, '') AS oktmo, '' AS period, CAST(to_json({'municipality_name': n_name, 'region': n_regionkey}) AS VARCHAR) AS payload
    FROM nation LEFT JOIN reg USING (n_name)
  UNION ALL SELECT 'suppliers', s_name, lpad(CAST(s_suppkey AS VARCHAR), 8, '0'), '', CAST(to_json({'key': s_suppkey, 'object_name': s_name, 'object_oktmo': lpad(CAST(s_suppkey AS VARCHAR), 8, '0')}) AS VARCHAR) FROM supplier
  UNION ALL SELECT 'yearly', n_name, coalesce(code, ''), CAST(y AS VARCHAR), CAST(to_json({'geography_name': n_name, 'year': y, 'orders': n}) AS VARCHAR) FROM yearly LEFT JOIN reg USING (n_name))"""


@query("record_store", f"WITH {_RECORDS_SQL} SELECT * FROM records")
def record_store(spark, sf):
    return _records(spark, sf)


@query(
    "record_store_page",
    f"WITH {_RECORDS_SQL} SELECT * FROM records WHERE dataset = 'yearly' AND period = '1998' ORDER BY municipality LIMIT 10 OFFSET 5",
)
def record_store_page(spark, sf):
    rows = st.select_records(_records(spark, sf), dataset="yearly", period="1998")
    return st.page(rows, order=["municipality"], limit=10, offset=5)


@query(
    "record_store_reads",
    f"WITH {_RECORDS_SQL} SELECT dataset, municipality, count(*) AS total FROM records WHERE dataset = 'yearly' AND municipality = 'NATION_3' GROUP BY 1, 2",
)
def record_store_reads(spark, sf):
    path = shared_folder(spark, "record_store")
    st.write_records(_records(spark, sf), path)
    stored = spark.read.parquet(path)
    rows = st.select_records(stored, dataset="yearly", municipality="NATION_3")
    return rows.groupBy("dataset", "municipality").agg(F.count(F.lit(1)).alias("total"))


@query(
    "store_municipalities",
    f"""WITH {_RECORDS_SQL} SELECT municipality AS name, max(nullif(oktmo, '')) AS oktmo,
  CASE WHEN max(nullif(oktmo, '')) IS NULL THEN 'code_missing' ELSE 'code_present_requires_verification' END AS identity_status FROM records WHERE municipality <> '' GROUP BY 1""",
)
def store_municipalities(spark, sf):
    return st.municipalities(_records(spark, sf))


@query("store_datasets", f"WITH {_RECORDS_SQL} SELECT dataset, count(*) AS row_count FROM records GROUP BY 1")
def store_datasets(spark, sf):
    return st.datasets(_records(spark, sf))


_SLICES_SQL = ", ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))


@query(
    "snapshot_digest",
    f"""WITH t AS (SELECT sha256('{{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}}') AS d FROM customer)
SELECT count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_SLICES_SQL})) AS snapshot_id FROM t""",
)
def snapshot_digest(spark, sf):
    return fl.table_digest(data.read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


# ---- versions and publishing -------------------------------------------------


@query(
    "contract_drift",
    """SELECT p_brand || '-' || p_type AS source, CAST(p_size AS VARCHAR) AS schema_version, CASE WHEN p_size > 40 THEN 'NEW' WHEN p_size > 20 THEN 'DRIFTED' ELSE 'SAME' END AS contract_state
FROM part GROUP BY p_brand, p_type, p_size""",
)
def contract_drift(spark, sf):
    sources = data.read(spark, sf, "part").select(
        F.concat_ws("-", "p_brand", "p_type").alias("source"), F.col("p_size").cast("string").alias("schema_version"), "p_size"
    ).distinct()
    now = sources.withColumn("contract_digest", pb.mapping_digest(F.col("source"), F.lit("all")))
    then = F.when(F.col("p_size") > 20, F.lit("food")).otherwise("all")
    known = sources.where(F.col("p_size") <= 40).withColumn("contract_digest", pb.mapping_digest(F.col("source"), then))
    return pb.contract_drift(now, known)


@query(
    "publish_status",
    """WITH s AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) >= 4000 AS ok FROM customer GROUP BY 1, 2),
g AS (SELECT c_nationkey, count(*) AS sources, count(*) FILTER (ok) AS accepted FROM s GROUP BY 1)
SELECT *, CASE WHEN accepted = 0 THEN 'stale' WHEN accepted < sources THEN 'partial' ELSE 'fresh' END AS status, accepted > 0 AS publish FROM g""",
)
def publish_status(spark, sf):
    runs = data.read(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("b"))
    runs = runs.withColumn("status", F.when(F.col("b") >= 4000, "accepted").otherwise("quarantined"))
    return pb.publish_status(runs, allow_partial=True, by=["c_nationkey"])


_FEEDS = {"first": ("view", "click"), "third": ("purchase",)}
_FEED_SQL = "CASE WHEN indicator IN ('view', 'click') THEN 'first' WHEN indicator = 'purchase' THEN 'third' ELSE 'second' END"


@query(
    "published_aggregates",
    f"""WITH {data.AGGREGATES_SQL}, a AS (SELECT *, {_FEED_SQL} AS feed, available_at >= period AS good FROM agg)
SELECT 'rows' AS part, indicator AS item, count(*) AS n_rows, {r("sum(value)", 2)} AS total, NULL AS status, NULL AS error FROM a WHERE good AND feed = 'third' GROUP BY indicator
UNION ALL SELECT '0001 fresh', feed, count(*), NULL, 'accepted', NULL FROM a WHERE good GROUP BY feed
UNION ALL SELECT '0002 partial', feed, CASE WHEN feed = 'third' THEN count(*) FILTER (good) ELSE 0 END, NULL, CASE WHEN feed = 'third' THEN 'accepted' ELSE 'quarantined' END,
  CASE feed WHEN 'first' THEN 'RELEASE_BEFORE_PERIOD' WHEN 'second' THEN 'CONTRACT_DRIFT' END FROM a GROUP BY feed""",
)
def published_aggregates(spark, sf):
    """Two runs: all sources good, then one with bad rows and one with a changed mapping; published rows and both reports."""
    from tesora.operators.contracts import Split

    root = shared_folder(spark, "published")
    every = data.aggregates(spark, sf)
    good = every.where(F.col("available_at") >= F.col("period"))
    none = good.select(F.lit("x").alias("reason_code")).where(F.lit(False))
    kind = F.when(F.col("indicator").isin(*_FEEDS["first"]), "first").when(F.col("indicator").isin(*_FEEDS["third"]), "third").otherwise("second")
    feed = lambda df, name: Split(df.where(kind == name), none)
    names = ("first", "second", "third")
    mappings = {name: {"schema_version": "1", "category": name} for name in names}
    pb.publish_aggregates(spark, {n: feed(good, n) for n in names}, root=root, run_id="0001", mappings=mappings)
    later = {"first": feed(every, "first"), "second": feed(good, "second"), "third": feed(good, "third")}
    mappings["second"] = {"schema_version": "1", "category": "changed"}
    pb.publish_aggregates(spark, later, root=root, run_id="0002", mappings=mappings, allow_partial=True)
    table = pb.read_published(spark, root).groupBy(F.lit("rows").alias("part"), F.col("indicator").alias("item")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total")
    )
    report = spark.read.parquet(f"{root}/status").select(
        F.concat_ws(" ", "run_id", "run_status").alias("part"), F.col("source").alias("item"), F.col("rows").alias("n_rows"), "status", "error"
    )
    return rounded(table.unionByName(report, allowMissingColumns=True), 2, "total")


@query(
    "merged_sources",
    f"""WITH {data.AGGREGATES_SQL} SELECT oktmo, period, category, indicator, {r("value", 2)} AS value, unit, source, available_at, is_estimated FROM agg""",
)
def merged_sources(spark, sf):
    """Two sources whose columns stand in a different order, one table."""
    df = data.aggregates(spark, sf)
    early = F.col("category") == "all"
    return rounded(df.where(early).unionByName(df.where(~early).select(*reversed(df.columns))), 2, "value")


@query(
    "accepted_version",
    f"""WITH {data.FISCAL_CORE_SQL} SELECT year, municipality_name, {r("total_expense", 2)} AS total_expense FROM core WHERE ingest_seq = 2 AND total_expense > 0""",
)
def accepted_version(spark, sf):
    root = shared_folder(spark, "intake")
    core = data.fiscal_core(spark, sf)
    for stamp, df in (
        ("2026-01-01T00-00-00", core.where(F.col("ingest_seq") == 1)),
        ("2026-02-01T00-00-00", core.where((F.col("ingest_seq") == 2) & (F.col("total_expense") > 0))),
    ):
        verdict = ds.quality(ds.validation_report(df, "reference_core"))
        line = ds.dataset_summary(df).first()
        pb.accept_version(
            df,
            verdict,
            dataset="reference_core",
            root=root,
            accepted_at=stamp,
            source_name="core.csv",
            source_digest="none",
            entities=line["entities"],
            period=line["period_label"],
        )
    active = pb.read_active(spark, root, "reference_core")
    return rounded(active.select("year", "municipality_name", "total_expense"), 2, "total_expense")


@query(
    "resolved_versions",
    """WITH u AS (SELECT c_custkey AS dataset_key, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT c_custkey AS dataset_key, -1.0::DOUBLE AS balance FROM customer WHERE c_nationkey < 10)
SELECT coalesce(u.dataset_key, b.dataset_key) AS dataset_key, coalesce(u.balance, b.balance) AS balance, CASE WHEN u.dataset_key IS NULL THEN 'built_in' ELSE 'uploaded' END AS mode
FROM u FULL JOIN b ON u.dataset_key = b.dataset_key""",
)
def resolved_versions(spark, sf):
    customer = data.read(spark, sf, "customer")
    key = F.col("c_custkey").alias("dataset_key")
    uploaded = customer.where(F.col("c_mktsegment") == "BUILDING").select(key, F.col("c_acctbal").alias("balance"))
    built_in = customer.where(F.col("c_nationkey") < 10).select(key, F.lit(-1.0).alias("balance"))
    return pb.resolve_versions(uploaded, built_in)


@query("log_tail", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def log_tail(spark, sf):
    return pb.recent_log(data.read(spark, sf, "events").select("event_id", "ts", "event_type"), order=["ts", "event_id"])


@query(
    "source_overview",
    """SELECT n_name AS source_id, n_regionkey AS authority, count(s_suppkey) AS manifest_files, max(s_acctbal) AS last_download,
  CASE WHEN count(s_suppkey) > 0 THEN 'DOWNLOADED' ELSE 'CONFIGURED' END AS status FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1, 2""",
)
def source_overview(spark, sf):
    configured = data.read(spark, sf, "nation").select(F.col("n_name").alias("source_id"), F.col("n_regionkey").alias("authority"))
    rich = data.read(spark, sf, "supplier").where(F.col("s_acctbal") > 5000)
    manifest = rich.join(data.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("source_id"), F.col("s_acctbal").alias("downloaded_at")
    )
    return pb.source_overview(configured, manifest)


@query(
    "overview_counts",
    """SELECT (SELECT count(*) FROM nation) AS configured_sources, count(*) AS manifest_files, count(DISTINCT s_nationkey) AS raw_sources FROM supplier""",
)
def overview_counts(spark, sf):
    manifest = data.read(spark, sf, "supplier").withColumnRenamed("s_nationkey", "source_id")
    return pb.overview_counts(data.read(spark, sf, "nation"), manifest)


@query(
    "manifest_upsert",
    """WITH old AS (SELECT s_nationkey AS source_id, s_name AS path FROM supplier), new AS (SELECT c_nationkey AS source_id, c_name AS path FROM customer WHERE c_acctbal > 9800)
SELECT * FROM old WHERE source_id NOT IN (SELECT source_id FROM new) UNION ALL SELECT * FROM new""",
)
def manifest_upsert(spark, sf):
    old = data.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("source_id"), F.col("s_name").alias("path"))
    rich = data.read(spark, sf, "customer").where(F.col("c_acctbal") > 9800)
    new = rich.select(F.col("c_nationkey").alias("source_id"), F.col("c_name").alias("path"))
    return fl.upsert_manifest(old, new)


@query(
    "canonical_sink",
    f"""WITH {data.SPENDING_SQL} SELECT category_code, CAST(year(period) AS INTEGER) AS year, count(*) AS n_rows, {r("sum(value)", 2)} AS spent FROM stated WHERE identity_status = 'OKTMO_RESOLVED' GROUP BY 1, 2""",
)
def canonical_sink(spark, sf):
    from tesora.plans.identity import _tables

    path = shared_folder(spark, "canonical")
    tables = _tables(spark, sf)
    pb.write_canonical(tables.canonical, tables.quarantine, tables.profile, path)
    stored = spark.read.parquet(f"{path}/canonical")
    out = stored.groupBy("category_code", F.year("period_start").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("spending_nominal").alias("spent")
    )
    return rounded(out, 2, "spent")


# ---- delimited files ---------------------------------------------------------


@query(
    "export_scan",
    f"""WITH {data.SPENDING_SQL} SELECT category_15, count(*) AS n_rows, {r("sum(v)", 2)} AS spent
FROM (SELECT category_15, value AS v FROM exported UNION ALL SELECT category_15, value FROM exported WHERE period = DATE '1998-01-01') GROUP BY 1""",
)
def export_scan(spark, sf):
    path = shared_folder(spark, "export")
    raw = data.spending_export(spark, sf).withColumnRenamed("period", " period ")
    raw.write.option("header", True).option("sep", ";").csv(path)
    checked = sp.check_export(dl.scan_export(spark, path, sp.EXPORT_COLUMNS)).clean
    out = checked.groupBy("category_15").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("spent"))
    return rounded(out, 2, "spent")


@query(
    "zipped_export_scan",
    f"""WITH {data.SPENDING_SQL} SELECT category_15, count(*) AS n_rows, {r("sum(v)", 2)} AS spent
FROM (SELECT category_15, value AS v FROM exported UNION ALL SELECT category_15, value FROM exported WHERE period = DATE '1998-01-01') GROUP BY 1""",
)
def zipped_export_scan(spark, sf):
    """The export as one small zip per supplier and category, read back from files."""
    raw = data.spending_export(spark, sf)
    head = ";".join(sp.EXPORT_COLUMNS)
    line = F.concat_ws(";", *[F.col(c).cast("string") for c in sp.EXPORT_COLUMNS])
    # one archive per supplier, category and year: at most 24 months in two copies
    texts = raw.groupBy("mo", "category_15", F.year("period").alias("y")).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    path = shared_folder(spark, "zipped")
    books = texts.select(packed(F.array(F.lit("export.csv")), F.array(F.concat(F.lit(head + "\n"), "body"))).alias("content"))
    rows = books.withColumn("path", F.uuid())
    rows.write.parquet(path)
    landed = dl.unpacked_exports(spark.read.schema("content binary, path string").parquet(path), sp.EXPORT_COLUMNS).clean
    checked = sp.check_export(landed.drop("path", "line_no")).clean
    out = checked.groupBy("category_15").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("spent"))
    return rounded(out, 2, "spent")


@query(
    "mapped_scan",
    """SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS oktmo, TIMESTAMP '2025-12-31' AS period, 'all' AS category, c_mktsegment AS indicator, c_acctbal AS value, 'rub' AS unit,
  'fns_7_ndfl' AS source, TIMESTAMP '2026-06-09' AS available_at, false AS is_estimated FROM customer WHERE c_acctbal >= 0""",
)
def mapped_scan(spark, sf):
    path = shared_folder(spark, "mapped")
    amount = F.format_string("%.2f", "c_acctbal")
    spaced = F.regexp_replace(F.translate(amount, ".", ","), r"(\d)(?=(\d{3})+,)", "$1 ")
    data.read(spark, sf, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"),
        F.lit("31.12.2025").alias("day"),
        F.col("c_mktsegment").alias("metric"),
        spaced.alias("amount"),
        F.lit("rub").alias("unit"),
    ).write.option("header", True).option("sep", ";").csv(path)
    config = {
        "source": "fns_7_ndfl",
        "category": "all",
        "separator": ";",
        "period_format": "dd.MM.yyyy",
        "available_at": "2026-06-09",
        "columns": {"oktmo": "code", "period": "day", "indicator": "metric", "value": "amount", "unit": "unit"},
    }
    return dl.scan_mapped(spark, path, config).clean


@query(
    "uploaded_tables",
    """SELECT 'order-' || o_orderkey AS path, o_orderpriority AS priority, o_totalprice AS amount FROM orders""",
)
def uploaded_tables(spark, sf):
    """Each order as one small uploaded file: separators and encodings differ between files."""
    comma = F.col("o_orderstatus") == "F"
    sep = F.when(comma, ",").otherwise(";")
    body = F.concat_ws("\n", F.concat(F.lit("Приоритет"), sep, F.lit(" сумма")), F.concat("o_orderpriority", sep, F.col("o_totalprice").cast("string")))
    # Cyrillic letters keep their distance in the one-byte code page, shifted to the upper half
    one_byte = F.translate(body, "".join(chr(0x410 + i) for i in range(64)), "".join(chr(0xC0 + i) for i in range(64)))
    content = F.when(F.col("o_orderstatus") == "P", F.encode(one_byte, "ISO-8859-1")).otherwise(F.encode(body, "UTF-8"))
    uploads = data.read(spark, sf, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("path"), content.alias("content"))
    named = dl.rows_with_header(dl.text_records(uploads), ["Приоритет", "сумма"])
    return named.select("path", F.col("Приоритет").alias("priority"), F.col("сумма").cast("double").alias("amount"))


# ---- files -------------------------------------------------------------------


@query(
    "file_signatures",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'PDF' WHEN 'de' THEN 'ZIP_OR_XLSX' WHEN 'fr' THEN 'RAR' ELSE 'UNKNOWN' END AS signature FROM documents""",
)
def file_signatures(spark, sf):
    lead = F.when(F.col("lang") == "en", "%PDF-1.4").when(F.col("lang") == "de", "PK\x03\x04").when(F.col("lang") == "fr", "Rar!\x1a\x07").otherwise("")
    docs = data.read(spark, sf, "documents")
    return docs.select("doc_id", fl.signature(F.encode(F.concat(lead, "text"), "UTF-8")).alias("signature"))


def _page_files(spark, sf):
    content = F.encode(F.replace("html", F.lit("<p>"), F.lit("\r\n<p>")), "UTF-8")
    pages = data.read(spark, sf, "pages").select(
        F.concat(F.lit("file:/data/pages/"), F.col("page_id").cast("string"), F.when(F.length("html") > 3000, ".csv").otherwise(".txt")).alias("path"),
        content.alias("content"),
    )
    return pages.withColumn("length", F.length("content").cast("long"))


@query(
    "file_manifest",
    """SELECT 'pages/' || page_id || '.csv' AS path, sha256(replace(html, '<p>', chr(10) || '<p>')) AS sha256, CAST(octet_length(encode(replace(html, '<p>', chr(10) || '<p>'))) AS BIGINT) AS size_bytes
FROM pages WHERE length(html) > 3000""",
)
def file_manifest(spark, sf):
    return fl.build_manifest(_page_files(spark, sf), root="/data", exclude=["^cache/"])


@query(
    "lineage_rows",
    """SELECT 'pages' AS source_id, page_id || CASE WHEN length(html) > 3000 THEN '.csv' ELSE '.txt' END AS source_file, sha256(replace(html, '<p>', chr(13) || chr(10) || '<p>')) AS source_sha256,
  CAST(octet_length(encode(replace(html, '<p>', chr(13) || chr(10) || '<p>'))) AS BIGINT) AS size_bytes FROM pages""",
)
def lineage_rows(spark, sf):
    return fl.lineage(_page_files(spark, sf), "pages")


@query(
    "file_set_diff",
    """SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN quality = 0 AND toxic = 1 THEN 'missing' WHEN quality = 1 AND toxic = 1 THEN 'changed' ELSE 'unlisted' END AS state
FROM labels WHERE toxic = 1 OR quality = 0""",
)
def file_set_diff(spark, sf):
    labels = data.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("path"), "quality", "toxic")
    listed = labels.where((F.col("quality") == 1) | (F.col("toxic") == 1)).withColumn("sha256", F.lit("a"))
    found = labels.where(~((F.col("quality") == 0) & (F.col("toxic") == 1)))
    found = found.withColumn("sha256", F.when(F.col("toxic") == 1, "b").otherwise("a"))
    return rc.file_set_diff(listed, found)


@query(
    "source_dispatch",
    """WITH n AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'budget_quality' WHEN '2-HIGH' THEN 'classification_mapping' WHEN '3-MEDIUM' THEN 'budget_execution_archive'
  WHEN '4-NOT SPECIFIED' THEN 'article136' ELSE 'unknown' END AS parser_id FROM orders)
SELECT parser_id, CASE WHEN parser_id = 'unknown' THEN 'QUARANTINE' ELSE 'READY' END AS status, count(*) AS n_files FROM n GROUP BY 1, 2""",
)
def source_dispatch(spark, sf):
    names = {
        "1-URGENT": "Расчет по итогам исполнения ",
        "2-HIGH": "Приложение к порядку ",
        "3-MEDIUM": "ИСПОЛНЕНИЕ ",
        "4-NOT SPECIFIED": "Перечень ст.136 бюджет ",
        "5-LOW": "misc ",
    }
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    path = F.concat(F.lit("/in/бюджет/"), F.element_at(table, F.col("o_orderpriority")), F.col("o_orderkey").cast("string"), F.lit(".xlsx"))
    files = fl.dispatch(data.read(spark, sf, "orders").select(path.alias("path")))
    return files.groupBy("parser_id", "status").agg(F.count(F.lit(1)).alias("n_files"))


# ---- pages -------------------------------------------------------------------

_LINKS_SQL = r"""links AS (SELECT regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || regexp_extract(a, 'href="([^"]*)"', 1) AS url,
  trim(regexp_replace(regexp_replace(regexp_replace(a, '^<a\b[^>]*>', ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title
  FROM (SELECT url, unnest(regexp_extract_all(html, '<a [^>]*>[^<]*</a>')) AS a FROM pages)),
best AS (SELECT url, arg_min(title, (-length(title), title)) AS title, count(*) AS occurrences FROM links GROUP BY 1)"""


@query(
    "discovered_links",
    f"""WITH {_LINKS_SQL} SELECT url, title, lower(regexp_extract(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '[^/](\\.[^./]*)$', 1)) AS extension, occurrences FROM best""",
)
def discovered_links(spark, sf):
    return web.discover_links(data.read(spark, sf, "pages"), extensions=None)


_HOSTS = ("blog.tionsh.example.com", "thther.example.com", "www.ththhe.example.com", "blog.tionsh.example.net", "tionble.example.org")


@query(
    "official_links",
    f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS site FROM pages)
SELECT regexp_replace(site, '^http:', 'https:') || '/files/budget.xlsx' AS url, '«Adopted» budget & annexes – № 5' AS title, '.xlsx' AS extension, 2 * count(*) AS occurrences
FROM p WHERE lower(regexp_extract(site, '://(.*)$', 1)) IN {_HOSTS} GROUP BY 1""",
)
def official_links(spark, sf):
    """Pages with an added file link in two spellings, one of them deep below and with named references; only listed hosts count."""
    pages = data.read(spark, sf, "pages")
    site = F.regexp_replace(F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), "^http:", "https:")
    added = F.concat(
        F.lit("<p><A class='x' HREF='"), site, F.lit("/a/b/./c/d/e/f/../../../../../../files/x/../budget.xlsx'>&laquo;Adopted&raquo; <b>budget</b>\n &amp;&nbsp;annexes &ndash; &#8470; 5</A>"),
        F.lit('<a href="'), site, F.lit('/files/budget.xlsx">Budget</a><a href="/files/budget.zip">zip</a>'),
    )
    return web.discover_links(pages.select("url", F.concat("html", added).alias("html")), hosts=_HOSTS)


# ---- archives and workbooks built from rows ----------------------------------


@F.pandas_udf(T.BinaryType())
def packed(names: pd.Series, texts: pd.Series) -> pd.Series:
    """One zip archive per row from parallel lists of member names and contents."""

    def pack(members, contents) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, text in zip(members, contents):
                archive.writestr(name, text)
        return buffer.getvalue()

    return pd.Series([pack(n, t) for n, t in zip(names, texts)])


#: Ways to break an archive, in the order of the rows that show them; the first leaves it whole.
_BROKEN = ("WHOLE", "ENCRYPTED", "UNSUPPORTED_COMPRESSION", "CORRUPT", "CUT")


@F.pandas_udf(T.BinaryType())
def broken(contents: pd.Series, ways: pd.Series) -> pd.Series:
    """Archives as they arrive when an upload goes wrong."""

    def spoil(content: bytes, way: str) -> bytes:
        out = bytearray(content)
        if way in ("ENCRYPTED", "UNSUPPORTED_COMPRESSION"):
            at, bits = (6, 1) if way == "ENCRYPTED" else (8, 99)
            out[at] |= bits  # in the member's own header and in the directory
            out[out.find(b"PK\x01\x02") + at + 2] |= bits
        elif way == "CORRUPT":
            start = 30 + int.from_bytes(out[26:28], "little")
            out[start : start + 4] = b"\xff" * 4
        elif way == "CUT":
            del out[-30:]
        return bytes(out)

    return pd.Series([spoil(c, w) for c, w in zip(contents, ways)])


def _way(key):
    return F.element_at(F.array(*[F.lit(w) for w in _BROKEN]), (key % len(_BROKEN)).cast("int") + 1)


@query(
    "broken_workbooks",
    """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN CASE WHEN s_nationkey % 5 = 0 THEN 'BAD_REFERENCE' ELSE 'READ' END WHEN 1 THEN 'ENCRYPTED'
  WHEN 2 THEN 'UNSUPPORTED_COMPRESSION' WHEN 3 THEN 'CORRUPT' ELSE 'UNSUPPORTED_WORKBOOK' END AS outcome, CASE WHEN s_suppkey % 5 = 0 AND s_nationkey % 5 > 0 THEN 3 ELSE 0 END AS cells FROM supplier""",
)
def broken_workbooks(spark, sf):
    """One workbook a supplier, four of five damaged and some naming a text they lack: every file by what came of it."""
    supplier = data.read(spark, sf, "supplier")
    sheet = _sheet([(F.col("s_name"), True), (F.col("s_nationkey").cast("string"), False), (F.col("s_acctbal").cast("string"), False)])
    sheet = F.when(F.col("s_nationkey") % 5 == 0, F.replace(sheet, F.lit('<c r="C1">'), F.lit('<c r="C1" t="s">'))).otherwise(sheet)
    book = packed(F.array(F.lit("xl/worksheets/sheet1.xml")), F.array(sheet))
    books = supplier.select(F.col("s_suppkey").cast("string").alias("path"), broken(book, _way(F.col("s_suppkey"))).alias("content"))
    parts = wb.workbook_cells(books)
    read = parts.clean.groupBy("path").agg(F.lit("READ").alias("outcome"), F.count(F.lit(1)).alias("cells"))
    out = read.unionByName(parts.quarantine.select("path", F.col("reason_code").alias("outcome"), F.lit(0).cast("long").alias("cells")))
    return out.select(F.col("path").cast("long").alias("s_suppkey"), "outcome", "cells")


@query(
    "broken_exports",
    """SELECT CASE c_custkey % 5 WHEN 0 THEN 'READ' WHEN 1 THEN 'ENCRYPTED' WHEN 2 THEN 'UNSUPPORTED_COMPRESSION' WHEN 3 THEN 'CORRUPT' ELSE 'BAD_ARCHIVE' END AS outcome,
  count(*) AS files, sum(CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END)::BIGINT AS n_rows FROM customer GROUP BY 1""",
)
def broken_exports(spark, sf):
    """One zipped export a customer, four of five damaged."""
    # a row of the small table is an archive to make and read: spread them before
    customer = data.read(spark, sf, "customer").repartition(shuffle_width(spark), "c_custkey")
    text = F.concat(F.lit("name;segment\n"), F.repeat(F.concat_ws(";", "c_name", F.concat("c_mktsegment", F.lit("\n"))), F.lit(2)))
    content = broken(packed(F.array(F.lit("export.csv")), F.array(text)), _way(F.col("c_custkey")))
    parts = dl.unpacked_exports(customer.select(F.col("c_custkey").cast("string").alias("path"), content.alias("content")), ["name", "segment"])
    files = parts.marked.groupBy("path", F.coalesce("reason_code", F.lit("READ")).alias("outcome")).agg(F.count_if(F.col("reason_code").isNull()).alias("n"))
    return files.groupBy("outcome").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("n_rows"))


@query(
    "archive_members",
    """SELECT conv_id || '-' || turn AS path, CASE WHEN role = 'system' THEN '../text.txt' ELSE 'turn/text.txt' END AS member_name, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
  role = 'system' AS unsafe FROM conversations UNION ALL SELECT conv_id || '-' || turn, 'role.txt', length(role), false FROM conversations""",
)
def archive_members(spark, sf):
    """Every turn as a small archive with its text and its role."""
    folder = F.when(F.col("role") == "system", "../").otherwise("turn/")
    files = data.read(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("path"),
        packed(F.array(F.concat(folder, F.lit("text.txt")), F.lit("role.txt")), F.array("text", "role")).alias("content"),
    )
    return fl.archive_members(files).drop("compressed_bytes", "problem")


@query(
    "safe_archives",
    """SELECT conv_id || '-' || turn AS path, CAST(2 AS BIGINT) AS members, CAST(octet_length(encode(text)) + length(role) AS BIGINT) AS size_bytes FROM conversations WHERE role <> 'system'""",
)
def safe_archives(spark, sf):
    folder = F.when(F.col("role") == "system", "../").otherwise("turn/")
    files = data.read(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("path"),
        packed(F.array(F.concat(folder, F.lit("text.txt")), F.lit("role.txt")), F.array("text", "role")).alias("content"),
    )
    return fl.safe_archives(fl.archive_members(files))


def _sheet(cells):
    """Sheet XML of one row of inline strings and numbers."""
    parts = [
        F.concat(F.lit(f'<c r="{chr(65 + i)}1" t="inlineStr"><is><t>'), c, F.lit("</t></is></c>")) if text else F.concat(F.lit(f'<c r="{chr(65 + i)}1"><v>'), c, F.lit("</v></c>"))
        for i, (c, text) in enumerate(cells)
    ]
    head = '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1">'
    return F.concat(F.lit(head), *parts, F.lit("</row></sheetData></worksheet>"))


@query(
    "workbook_cells",
    """SELECT s_suppkey, 0 AS col, s_name AS text, CAST(NULL AS DOUBLE) AS num FROM supplier UNION ALL SELECT s_suppkey, 1, CAST(s_nationkey AS VARCHAR), CAST(s_nationkey AS DOUBLE) FROM supplier
UNION ALL SELECT s_suppkey, 2, NULL, s_acctbal FROM supplier""",
)
def workbook_cells(spark, sf):
    supplier = data.read(spark, sf, "supplier")
    sheet = _sheet([(F.col("s_name"), True), (F.col("s_nationkey").cast("string"), False), (F.col("s_acctbal").cast("string"), False)])
    books = supplier.select(
        F.col("s_suppkey").cast("string").alias("path"), packed(F.array(F.lit("xl/worksheets/sheet1.xml")), F.array(sheet)).alias("content")
    )
    cells = wb.workbook_cells(books).clean
    text = F.when(F.col("col") < 2, F.col("text"))
    return cells.select(F.col("path").cast("long").alias("s_suppkey"), "col", text.alias("text"), "num")


# budgets laid out as workbook cells: header row, labelled rows, one column per year


_YEARS = tuple(range(1995, 2002))


def _budget_cells(spark, sf):
    amounts = (
        data.at_supplier(spark, sf, data.read(spark, sf, "lineitem"))
        .groupBy(F.col("n_name").alias("municipality_name"), F.year("l_shipdate").alias("year"), "l_returnflag", "l_linestatus")
        .agg(data.money("l_extendedprice").alias("v"))
        .groupBy("municipality_name", "year")
        .agg(
            F.sum("v").alias("total"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("v"))).alias("base"),
            F.sum(F.when(F.col("l_returnflag") != "R", F.col("v")) * 2).alias("spent"),
            F.sum(F.when(F.col("l_linestatus") == "O", F.col("v"))).alias("fin"),
            F.sum(F.when(F.col("l_returnflag") == "N", F.col("v"))).alias("exc"),
            F.sum(F.when(F.col("l_returnflag") == "A", F.col("v"))).alias("svc"),
        )
    )
    col = F.col("year") - _YEARS[0] + 2
    zero, none = F.lit(0), F.lit(None).cast("double")

    def cell(part, row, column, text, num):
        return F.struct(F.lit(part).alias("part"), F.lit(row).alias("row"), column.alias("col"), text.alias("text"), num.alias("num"))

    def line(part, row, label, code, value):
        text = lambda s: F.lit(s)
        return [cell(part, row, zero, text(code), none), cell(part, row, zero + 1, text(label), none), cell(part, row, col, value.cast("string"), value)]

    rows = []
    for part in ("revenue", "financing", "expenditure"):
        rows.append(cell(part, 0, zero, F.lit("Бюджет, тыс. рублей"), none))
        rows.append(cell(part, 1, col, F.concat(F.col("year").cast("string"), F.lit(" год")), none))
    rows += line("revenue", 2, "Налоговые и неналоговые доходы", "100", F.col("base"))
    rows += line("revenue", 3, "Прочие доходы", "200", F.col("total") - F.col("base"))
    rows += line("revenue", 4, "ВСЕГО доходов", "", F.col("total"))
    rows += line("financing", 2, "Изменение остатков средств", "01", F.col("exc"))
    rows += line("financing", 3, "Продажа акций", "02", -F.col("exc"))
    rows += line("financing", 4, "Всего источников", "", -F.col("fin"))
    rows += line("expenditure", 2, "Общегосударственные вопросы", "01", F.col("spent") - F.col("svc"))
    rows += line("expenditure", 3, "Обслуживание муниципального долга", "13", F.col("svc"))
    rows += line("expenditure", 4, "Всего расходов", "", F.col("spent"))
    return amounts.select("municipality_name", F.inline(F.array(*rows))).distinct()


_BUDGET_CELLS_SQL = """w AS (SELECT n_name AS municipality_name, CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS f, l_linestatus AS s, l_extendedprice AS v
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT municipality_name, year, sum(v) AS total, sum(v) FILTER (f = 'R') AS base, 2 * sum(v) FILTER (f <> 'R') AS spent, sum(v) FILTER (s = 'O') AS fin,
  sum(v) FILTER (f = 'N') AS exc, sum(v) FILTER (f = 'A') AS svc FROM w GROUP BY 1, 2)"""
_ADOPTED = ("total_revenue", "revenue_base", "transfers", "expenditure", "financing_sources", "eligible_exceptions", "debt_service", "deficit")


@query(
    "adopted_budget",
    f"""WITH {_BUDGET_CELLS_SQL} SELECT municipality_name, year, {r("total", 2)} AS total_revenue, {r("base", 2)} AS revenue_base, {r("total - base", 2)} AS transfers, {r("spent", 2)} AS expenditure,
  {r("fin", 2)} AS financing_sources, {r("exc", 2)} AS eligible_exceptions, {r("svc", 2)} AS debt_service, {r("greatest(spent - total, 0)", 2)} AS deficit FROM m""",
)
def adopted_budget(spark, sf):
    return rounded(wb.adopted_budget(_budget_cells(spark, sf), years=_YEARS).clean, 2, *_ADOPTED)


@query(
    "expenditure_sections",
    f"""WITH {_BUDGET_CELLS_SQL} SELECT municipality_name, year, '01' AS section_code, 'Общегосударственные вопросы' AS section_name, {r("spent - svc", 2)} AS amount FROM m
UNION ALL SELECT municipality_name, year, '13', 'Обслуживание муниципального долга', {r("svc", 2)} FROM m""",
)
def expenditure_sections(spark, sf):
    cells = _budget_cells(spark, sf).where(F.col("part") == "expenditure").drop("part")
    return rounded(wb.expenditure_sections(cells, years=_YEARS).clean, 2, "amount")


@query("unit_scale", "SELECT n_name AS municipality_name, 1000.0::DOUBLE AS unit_scale FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey)")
def unit_scale(spark, sf):
    return wb.unit_scale(_budget_cells(spark, sf), ["municipality_name"])


@query(
    "budget_plan_rows",
    f"""WITH {_BUDGET_CELLS_SQL} SELECT municipality_name, year, CASE WHEN year = min(year) OVER (PARTITION BY municipality_name) THEN 'ADOPTED' ELSE 'PLAN_PERIOD' END AS stage, {r("total", 2)} AS total_revenue,
  CASE WHEN year = 1999 THEN 1234.5::DOUBLE ELSE 0.0 END AS debt_upper_limit FROM m""",
)
def budget_plan_rows(spark, sf):
    cells = _budget_cells(spark, sf)
    budgets = wb.adopted_budget(cells, years=_YEARS).clean
    limits = budgets.where(F.col("year") == 1999).select("municipality_name", "year", F.lit(1234500.0).alias("debt_limit"))
    rows = wb.plan_rows(budgets, wb.unit_scale(cells, ["municipality_name"]), limits)
    return rounded(rows.select("municipality_name", "year", "stage", "total_revenue", "debt_upper_limit"), 2, "total_revenue")


@query(
    "budget_structure_rows",
    f"""WITH {_BUDGET_CELLS_SQL}, l AS (SELECT municipality_name, year, 'REVENUE' AS budget_side, 'Собственные доходы' AS grp, base AS amount, '' AS item_code, 0 AS is_transfer, 0 AS is_debt_service FROM m
  UNION ALL SELECT municipality_name, year, 'REVENUE', 'Безвозмездные поступления', total - base, '', 1, 0 FROM m
  UNION ALL SELECT municipality_name, year, 'FINANCING', 'Источники финансирования', fin, '', 0, 0 FROM m
  UNION ALL SELECT municipality_name, year, 'EXCEPTION', 'Допустимые исключения', exc, '', 0, 0 FROM m
  UNION ALL SELECT municipality_name, year, 'EXPENDITURE', 'Общегосударственные вопросы', spent - svc, '01', 0, 0 FROM m
  UNION ALL SELECT municipality_name, year, 'EXPENDITURE', 'Обслуживание муниципального долга', svc, '13', 0, 1 FROM m)
SELECT municipality_name, year, budget_side, grp AS "group", {r("amount", 2)} AS amount, item_code, is_transfer, is_debt_service FROM l""",
)
def budget_structure_rows(spark, sf):
    cells = _budget_cells(spark, sf)
    years = _YEARS
    budgets = wb.adopted_budget(cells, years=years).clean
    sections = wb.expenditure_sections(cells.where(F.col("part") == "expenditure").drop("part"), years=years).clean
    out = wb.structure_rows(budgets, sections)
    cols = ("municipality_name", "year", "budget_side", "group", "amount", "item_code", "is_transfer", "is_debt_service")
    return rounded(out.select(*cols), 2, "amount")


@query("filtered_scan", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_nationkey = 7")
def filtered_scan(spark, sf):
    supplier = data.read(spark, sf, "supplier")
    return supplier.where(F.col("s_nationkey") == 7).select("s_suppkey", "s_name", "s_acctbal")


@query("scan_counts", "SELECT count(*) AS actual_rows, count(*) FILTER (s_nationkey = 7) AS kept_rows FROM supplier")
def scan_counts(spark, sf):
    return data.read(spark, sf, "supplier").agg(
        F.count(F.lit(1)).alias("actual_rows"), F.count_if(F.col("s_nationkey") == 7).alias("kept_rows")
    )
