"""Queries over project files that are packed from the star-schema tables and read back, each beside its SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.operators import selection, text
from lodestone.sources import columns, files, legacy, payloads, unicode

from .catalog import contents, query, t

FILE = 500


def packed(rows: DataFrame, make) -> DataFrame:
    """file, content of each group of rows (file, r: array of structs), by a packing function."""
    files.ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            for key, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([make(r)], pa.binary())], names=["file", "content"])

    return rows.mapInArrow(run, "file bigint, content binary")


def order_files(spark, folder):
    return t(spark, folder, "orders").groupBy(F.floor(F.col("o_orderkey") / FILE).alias("file")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice", "o_orderstatus"))).alias("r"))


def project(r: list[dict]) -> bytes:
    price = columns.encode_numbers([None if x["o_orderstatus"] == "P" else x["o_totalprice"] for x in r])
    key = columns.encode_numbers([float(x["o_orderkey"]) for x in r])
    text = f"<OriginStorage><label>{len(r)}</label><OriginStorage>x</OriginStorage></OriginStorage>".encode()
    return unicode.pack_file([unicode.pack_column("Book1_A", key), unicode.pack_column("Book1_B@2", price, b"\0\1"), bytes(100), text, bytes(7), unicode.pack_region(text), b"tail"])


SQL_FILES = f"o AS (SELECT *, o_orderkey // {FILE} AS file, row_number() OVER (PARTITION BY o_orderkey // {FILE} ORDER BY o_orderkey) - 1 AS \"row\" FROM orders)"


@query(f"""
WITH {SQL_FILES} SELECT file, 1 AS ordinal, 'Book1_A' AS name, "row", 'float' AS kind, o_orderkey::DOUBLE AS f64 FROM o UNION ALL SELECT file, 2, 'Book1_B@2', "row", CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE 'float' END, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END FROM o""")
def unicode_project_cells(spark, folder):
    return files.unicode_cells(packed(order_files(spark, folder), project), "file").select("file", "ordinal", "name", "row", "kind", "f64")


@query(f"""
WITH {SQL_FILES} SELECT file, 1 AS ordinal, 'Book1_A' AS name, count(*) AS n_rows, 0::BIGINT AS n_missing, 'numeric' AS value_type FROM o GROUP BY 1 UNION ALL SELECT file, 2, 'Book1_B@2', count(*), count(*) FILTER (o_orderstatus = 'P'), CASE WHEN count(*) FILTER (o_orderstatus <> 'P') > 0 THEN 'numeric' ELSE 'empty' END FROM o GROUP BY 1""")
def unicode_project_columns(spark, folder):
    return files.unicode_columns(packed(order_files(spark, folder), project), "file").select("file", "ordinal", "name", "n_rows", "n_missing", "value_type")


@query(f"""
WITH {SQL_FILES}, f AS (SELECT file, '<OriginStorage><label>' || count(*) || '</label><OriginStorage>x</OriginStorage></OriginStorage>' AS text FROM o GROUP BY 1) SELECT file, source, text FROM f, (VALUES ('raw'), ('decoded')) v(source)""")
def storage_regions(spark, folder):
    return files.storage_regions(packed(order_files(spark, folder), project), "file").select("file", "source", "text")


@query(f"""
WITH {SQL_FILES}, f AS (SELECT DISTINCT file FROM o) SELECT file, kind, n::BIGINT AS n FROM f, (VALUES ('header', 1), ('column', 2), ('raw_region', 1), ('decoded_region', 1), ('gap', 3)) v(kind, n)""")
def unicode_project_walk(spark, folder):
    return files.unicode_elements(packed(order_files(spark, folder), project), "file").groupBy("file", "kind").agg(F.count("*").alias("n"))


@query("SELECT p_partkey // 100 AS file, p_brand || '_' || p_partkey AS name, p_retailprice AS value FROM part")
def parameter_scan(spark, folder):
    own = t(spark, folder, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("file")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_brand", "p_retailprice"))).alias("r"))
    made = packed(own, lambda r: unicode.pack_parameters([(f"{x['p_brand']}_{x['p_partkey']}", x["p_retailprice"]) for x in r]))
    return files.parameters(made, "file").select("file", "name", "value")


@query("SELECT p_partkey // 100 AS file, p_name || ' ' || p_partkey AS text FROM part")
def length_block_scan(spark, folder):
    own = t(spark, folder, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("file")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("r"))
    made = packed(own, lambda r: b"CPYA 4.2673 552#\n" + b"".join(legacy.pack_frame(f"{x['p_name']} {x['p_partkey']}".encode()) for x in r))
    return files.length_blocks(made, "file").select("file", F.decode("payload", "UTF-8").alias("text"))


@query("""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'unicode_project' WHEN 1 THEN 'legacy_project' WHEN 2 THEN 'zip' WHEN 3 THEN 'png' ELSE 'unknown' END AS detected_type FROM documents""")
def format_detection(spark, folder):
    heads = [b"CPYUA 4.3380 200\n", b"CPYA 4.2673 552#\n", b"PK\x03\x04", b"\x89PNG\r\n\x1a\n", b"", b"xCPYA"]
    head = F.element_at(F.array(*(F.lit(h) for h in heads)), (F.col("doc_id") % 6 + 1).cast("int"))
    made = contents(spark, folder).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.concat(head, F.col("content")).alias("content")).withColumn("length", F.octet_length("content").cast("bigint"))
    found = files.documents(made).select(F.col("path").cast("bigint").alias("doc_id"), "detected_type")
    return found.select("doc_id", "detected_type")


@query("SELECT doc_id, hex(encode(substr(regexp_replace(text, '[^ -~]', '?', 'g') || repeat('.', 64), 11, 20))) AS bytes FROM documents")
def byte_ranges(spark, folder):
    own = t(spark, folder, "documents").select("doc_id", F.concat(F.regexp_replace("text", "[^ -~]", "?"), F.lit("." * 64)).cast("binary").alias("content"))
    return own.select("doc_id", F.hex(files.byte_range(F.col("content"), 10, 20)).alias("bytes"))


@query("SELECT page_id, 'svg' AS kind, octet_length(encode(html))::BIGINT AS \"offset\", 5 + length(page_id::VARCHAR) + 6 AS length FROM pages")
def image_carve(spark, folder):
    own = t(spark, folder, "pages").select("page_id", F.concat(F.col("html").cast("binary"), F.lit(b"<svg>"), F.col("page_id").cast("string").cast("binary"), F.lit(b"</svg>tail")).alias("content"))
    return files.images(own, "page_id").where("kind = 'svg'").select("page_id", "kind", "offset", F.col("length").cast("bigint").alias("length"))


@query("SELECT event_id, event_type AS text, (octet_length(encode(event_type)) + 1)::INTEGER AS length FROM events")
def tagged_string_scan(spark, folder):
    size = F.unhex(F.lpad(F.hex((F.octet_length("event_type") + 1).cast("bigint")), 2, "0"))
    own = t(spark, folder, "events").select("event_id", F.concat(F.lit(b"\x01"), size, F.lit(b"\x80\x2a"), F.col("event_type").cast("binary"), F.lit(b"\x00")).alias("content"))
    return files.tagged_strings(own, "event_id").select("event_id", F.col("value").alias("text"), "length")


@query("""
WITH b AS (SELECT doc_id, text, phase FROM documents, (VALUES (0), (1), (2)) v(phase)), s AS (SELECT doc_id, phase, length(text) - length(regexp_replace(text, '[^ -~]', '', 'g')) + CASE WHEN phase = doc_id % 3 THEN 0 ELSE 1 END AS odd FROM b)
SELECT doc_id, arg_min(phase, {'a': odd, 'b': phase}) AS phase, min(odd)::INTEGER AS suspicious FROM s GROUP BY 1""")
def phase_recovery(spark, folder):
    own = t(spark, folder, "documents").select("doc_id", "text", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("phase"))
    odd = F.length("text") - F.length(F.regexp_replace("text", "[^ -~]", "")) + F.when(F.col("phase") == F.col("doc_id") % 3, 0).otherwise(1)
    return selection.best(own.withColumn("suspicious", odd), ["doc_id"], [F.col("suspicious"), F.col("phase")], ["phase", "suspicious"])


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'mser_strings_pset' WHEN 1 THEN 'storage_cell_ref_data' WHEN 2 THEN 'origin_storage_xml' WHEN 3 THEN 'recognized_payload_invalid' ELSE 'unknown' END AS family, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN p_size END AS n_records FROM part""")
def payload_family(spark, folder):
    def make(b):
        kinds = (lambda x: payloads.pack_strings([x["p_name"], ""]), lambda x: payloads.pack_references(x["p_size"]), lambda x: b"<OriginStorage/>", lambda x: payloads.pack_strings([x["p_name"]]) + b"\0", lambda x: x["p_name"].encode())
        return [kinds[x["p_partkey"] % 5](x) for x in b]

    files.ship(spark)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(make(b.to_pylist()), pa.binary())], names=["p_partkey", "content"])

    made = t(spark, folder, "part").select("p_partkey", "p_size", "p_name").mapInArrow(run, "p_partkey bigint, content binary")
    return files.payload_families(made, "p_partkey")


@query("""
WITH c AS (SELECT p_partkey, 'CPYUA 4.3380 200' || chr(10) || p_name || (['', ' Project x', ' Origin', ' analysis of Project'])[p_partkey % 4 + 1] || repeat('z', p_size * 8) AS x FROM part), s AS (SELECT p_partkey, CASE WHEN length(x) < 256 THEN x ELSE substr(x, 1, 512) END AS x FROM c),
m AS (SELECT p_partkey, x, v.k, instr(x, v.marker) - 1 AS i FROM s, (VALUES (0, 'Requires OriginPro'), (1, 'Signed-rank'), (2, 'Origin'), (3, 'Project'), (4, 'analysis')) v(k, marker)),
g AS (SELECT p_partkey, k, substr(x, greatest(0, i - 40) + 1, least(length(x), i + 160) - greatest(0, i - 40)) AS span FROM m WHERE i >= 0), b AS (SELECT p_partkey, arg_max(span, {'a': length(span), 'b': -k}) AS span FROM g GROUP BY 1)
SELECT p.p_partkey, CASE WHEN length(trim(span, chr(10) || ' ')) > 160 THEN substr(trim(span, chr(10) || ' '), 1, 157) || '...' WHEN length(trim(span, chr(10) || ' ')) > 1 THEN trim(span, chr(10) || ' ') END AS description FROM part p LEFT JOIN b ON b.p_partkey = p.p_partkey""")
def project_descriptions(spark, folder):
    tail = F.element_at(F.array(*(F.lit(x) for x in ("", " Project x", " Origin", " analysis of Project"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("CPYUA 4.3380 200\n"), "p_name", tail, F.repeat(F.lit("z"), F.col("p_size") * 8))
    return t(spark, folder, "part").select("p_partkey", names.description(text.cast("binary")).alias("description"))


@query("""
WITH f AS (SELECT p_partkey, p_partkey % 50 AS n, p_size AS b, p_size + 0.5 * (p_partkey % 50 - 1) AS e FROM part WHERE p_partkey % 4 <> 3)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'polar' ELSE 'normal' END AS type, n AS points, CASE WHEN n > 0 THEN b::VARCHAR END AS first, CASE WHEN n > 0 THEN CASE WHEN e = floor(e) THEN e::BIGINT::VARCHAR ELSE e::DOUBLE::VARCHAR END END AS last FROM f""")
def function_metadata(spark, folder):
    files.ship(spark)

    def run(batches):
        for b in batches:
            made = [legacy.pack_function(x["p_partkey"] % 50, float(x["p_size"]), 0.5, x["p_partkey"] % 3 == 0) if x["p_partkey"] % 4 != 3 else bytes(200) for x in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["p_partkey", "content"])

    made = t(spark, folder, "part").select("p_partkey", "p_size").mapInArrow(run, "p_partkey bigint, content binary")
    return files.function_records(made, "p_partkey")


@query("""
WITH r AS (SELECT p_partkey, '<Report Label="' || p_name || '"><N>' || p_size || '</N><Mean>' || floor(p_retailprice)::BIGINT || '</Mean><Pair ID="a">1</Pair><Pair ID="b">' || p_size || '</Pair></Report>' AS x FROM part)
SELECT p_partkey, regexp_extract(x, 'Label="([^"]*)"', 1) AS label, regexp_extract(x, '<N>([0-9]+)</N>', 1)::INTEGER AS n, regexp_extract(x, '<Mean>([0-9]+)</Mean>', 1)::DOUBLE AS mean, 2 AS n_pairs, regexp_extract(x, 'ID="b">([^<]*)<', 1) AS last_pair FROM r""")
def report_fields(spark, folder):
    x = F.concat(F.lit('<Report Label="'), "p_name", F.lit('"><N>'), "p_size", F.lit("</N><Mean>"), F.floor("p_retailprice"), F.lit('</Mean><Pair ID="a">1</Pair><Pair ID="b">'), "p_size", F.lit("</Pair></Report>"))
    return text.report_fields(t(spark, folder, "part").select("p_partkey", x.alias("x")), "p_partkey", "x")
