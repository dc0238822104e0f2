"""Table readers and the derived fixtures that the registered queries run on.

A fixture is one SQL text that Spark and DuckDB both read: table names stand in braces, so that Spark binds
DataFrames to them and DuckDB sees its own views. Types are spelled as both engines know them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of text rendered from an order, with damage by key: missing label, Arabic-Indic digits, a misread year, a second total, noise.
RENDERED = r"""
SELECT o_orderkey AS doc_id, CAST(line_idx AS INTEGER) AS line_idx, text FROM (
  SELECT o_orderkey, 0 AS line_idx, CASE WHEN o_orderkey % 3 = 0 THEN 'RECEIPT' WHEN o_orderkey % 3 = 1 THEN 'TAX INVOICE' ELSE 'Page 1' END AS text FROM {orders}
  UNION ALL SELECT o_orderkey, 1, CASE WHEN o_orderkey % 11 = 0 THEN concat('No ', CAST(o_orderkey AS STRING)) ELSE concat('Invoice No : ', lpad(CAST(o_orderkey AS STRING), 8, '0')) END FROM {orders}
  UNION ALL SELECT o_orderkey, 2, concat('Date : ', CASE WHEN o_orderkey % 4 = 1 THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', CAST(year(o_orderdate) AS STRING))
    WHEN o_orderkey % 4 = 2 THEN concat(CAST(year(o_orderdate) AS STRING), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))
    ELSE concat(CASE WHEN o_orderkey % 13 = 0 THEN '2928' ELSE CAST(year(o_orderdate) AS STRING) END, '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0')) END) FROM {orders}
  UNION ALL SELECT o_orderkey, 3, concat('Customer : Customer ', CAST(o_custkey AS STRING)) FROM {orders}
  UNION ALL SELECT o_orderkey, 4, CASE WHEN o_orderkey % 5 = 0 THEN translate(concat('Total : ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' EGP'), '0123456789', '٠١٢٣٤٥٦٧٨٩') ELSE concat('Total : ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' EGP') END FROM {orders}
  UNION ALL SELECT o_orderkey, 5, concat('Total ', CAST(CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 2 AS STRING)) FROM {orders} WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, 6, '© § oe a il' FROM {orders} WHERE o_orderkey % 4 = 0
) AS r
"""

FIXTURES: dict[str, str] = {
    "rendered": RENDERED,
    # Texts of the documents with other scripts, symbols, digits and markdown put in front by key.
    "mixed": r"""
SELECT doc_id, concat(CASE doc_id % 9
    WHEN 0 THEN 'متجر الرحيم ١٢٣ ' WHEN 1 THEN '© ' WHEN 2 THEN 'Привет мир, ' WHEN 3 THEN '漢字 ไทย हिन्दी '
    WHEN 4 THEN 'aaaaaaaa 99 12.50 Word123, ' WHEN 5 THEN 'abcdefghijklmnopqrstuvwxyz0123456789 ' WHEN 6 THEN 'tag tag tag TAG '
    WHEN 7 THEN '-- :: ** ' ELSE '' END, text) AS text FROM {documents}
""",
    # Short fragments, one a row, from every part of the tables.
    "fragments": r"""
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS k, CASE l_partkey % 16
    WHEN 0 THEN concat('SAR ', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), ',', lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0'), '.', lpad(CAST(l_linenumber AS STRING), 2, '0'))
    WHEN 1 THEN translate(concat('- ', CAST(l_partkey AS STRING), '.5 USD'), '0123456789', '٠١٢٣٤٥٦٧٨٩')
    WHEN 2 THEN translate(CAST(l_partkey AS STRING), '0123456789', '۰۱۲۳۴۵۶۷۸۹')
    WHEN 3 THEN concat(lpad(CAST(l_partkey % 28 + 1 AS STRING), 2, '0'), '/', CAST(l_suppkey % 12 + 1 AS STRING), '/', CAST(2000 + l_linenumber AS STRING))
    WHEN 4 THEN concat(CAST(2010 + l_linenumber AS STRING), '-', lpad(CAST(l_suppkey % 12 + 1 AS STRING), 2, '0'), '-', lpad(CAST(l_partkey % 28 + 1 AS STRING), 2, '0'))
    WHEN 5 THEN concat(CAST(l_suppkey % 40 AS STRING), '-', CAST(l_linenumber AS STRING), '-2028 18:30:12')
    WHEN 6 THEN concat('010', lpad(CAST(l_partkey * 7919 % 100000000 AS STRING), 8, '0'))
    WHEN 7 THEN concat('+20 1', CAST(l_suppkey % 3 AS STRING), lpad(CAST(l_partkey * 104729 % 100000000 AS STRING), 8, '0'))
    WHEN 8 THEN concat('Tel: 0', CAST(6 + l_suppkey % 3 AS STRING), CAST(l_linenumber % 6 AS STRING), lpad(CAST(l_partkey * 31 % 100000000 AS STRING), 8, '0'), ' / 123')
    WHEN 9 THEN CASE l_suppkey % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'نعم' WHEN 2 THEN 'لا' WHEN 3 THEN 'FALSE' WHEN 4 THEN '1' ELSE 'maybe' END
    WHEN 10 THEN CASE l_suppkey % 4 WHEN 0 THEN 'usd' WHEN 1 THEN ' EGP ' WHEN 2 THEN 'xyz' ELSE '' END
    WHEN 11 THEN concat('accountNumber', CAST(l_linenumber AS STRING), ' (رقم)--', l_returnflag)
    WHEN 12 THEN CASE l_suppkey % 3 WHEN 0 THEN 'constructor' WHEN 1 THEN '__proto__' ELSE 'toString' END
    WHEN 13 THEN concat('say "', l_returnflag, '", ok')
    WHEN 14 THEN concat('أحمد  إلى   مدرسة ىـي ', CAST(l_linenumber AS STRING))
    ELSE concat('x‎y‫ ', CAST(l_partkey AS STRING), ' Z') END AS s
FROM {lineitem}
""",
    # Word boxes, one for each line item; several may share a line.
    "boxes": r"""
SELECT l_orderkey AS doc_id, l_linenumber AS line_idx,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS INTEGER) AS word_idx,
       CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(20 * l_linenumber + l_suppkey % 5 AS DOUBLE) AS y,
       CAST(20 + l_quantity AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height, CAST(1 - 5 * l_discount AS DOUBLE) AS confidence,
       CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_partkey * 37 AS STRING) ELSE concat('w', CAST(l_partkey AS STRING)) END AS text
FROM {lineitem}
""",
    # Fields read from the rendered orders, some of them invented or misplaced.
    "candidates": r"""
SELECT doc_id, CAST(ord AS INTEGER) AS ord, key, type, raw, CAST(confidence AS DOUBLE) AS confidence FROM (
  SELECT o_orderkey AS doc_id, 0 AS ord, 'invoice_number' AS key, 'string' AS type, CASE WHEN o_orderkey % 17 = 0 THEN '99999999' ELSE lpad(CAST(o_orderkey AS STRING), 8, '0') END AS raw, 0.9 AS confidence FROM {orders}
  UNION ALL SELECT o_orderkey, 1, 'invoice_date', 'date', concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0')), 0.8 FROM {orders}
  UNION ALL SELECT o_orderkey, 4, 'seller_tax_id', 'string', lpad(CAST(o_orderkey AS STRING), 8, '0'), 0.6 FROM {orders} WHERE o_orderkey % 6 = 0
  UNION ALL SELECT o_orderkey, 6, 'buyer_name', 'string', concat('customer  ', CAST(o_custkey AS STRING)), 0.85 FROM {orders} WHERE o_orderkey % 23 <> 0
  UNION ALL SELECT o_orderkey, 9, 'currency', 'enum', CASE WHEN o_orderkey % 8 = 0 THEN 'xyz' ELSE 'egp' END, 0.7 FROM {orders}
  UNION ALL SELECT o_orderkey, 12, 'tax_rate', 'number', CASE WHEN o_orderkey % 2 = 0 THEN '14' ELSE '140' END, 0.5 FROM {orders} WHERE o_orderkey % 10 < 4
  UNION ALL SELECT o_orderkey, 15, 'total_amount', 'currency', CAST(CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS STRING), 0.95 FROM {orders} WHERE o_orderkey % 29 <> 0
  UNION ALL SELECT o_orderkey, 21, 'notes', 'text', CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE '© § oe a il' END, 0.25 FROM {orders} WHERE o_orderkey % 4 = 0
) AS f
""",
    # A graph over each document's boxes: the document, its lines and its words. Faults by key: a repeated id, a box that leaves its line, a word on another page, an unknown parent, a word that is its own parent, a document whose parent is a line of its own.
    "faulty_nodes": r"""
WITH b AS (__BOXES__), w AS (SELECT doc_id, line_idx, word_idx, concat('w-', CAST(line_idx AS STRING), '-', CAST(word_idx AS STRING)) AS id, x, y, width, height, confidence FROM b)
SELECT doc_id, 'word' AS level, id, CASE WHEN doc_id % 37 = 0 AND line_idx = 1 THEN 'l-ghost' WHEN doc_id % 59 = 0 AND line_idx = 1 THEN id ELSE concat('l-', CAST(line_idx AS STRING)) END AS parent, CASE WHEN doc_id % 31 = 0 AND line_idx = 2 THEN 2 ELSE 1 END AS page, x, y, CASE WHEN doc_id % 13 = 0 AND line_idx = 1 THEN width + 600 ELSE width END AS width, height,
  CASE WHEN doc_id % 41 = 0 AND line_idx = 3 THEN 1.5 WHEN doc_id % 43 = 0 AND line_idx = 2 THEN NULL ELSE confidence END AS confidence FROM w
UNION ALL SELECT doc_id, 'word', id, concat('l-', CAST(line_idx AS STRING)), 1, x, y, width, height, confidence FROM w WHERE doc_id % 11 = 0 AND line_idx = 1 AND word_idx = 0
UNION ALL SELECT doc_id, 'line', concat('l-', CAST(line_idx AS STRING)), 'd', 1, min(x), min(y), max(x + width) - min(x), max(y + height) - min(y), avg(confidence) FROM w GROUP BY doc_id, line_idx
UNION ALL SELECT doc_id, 'document', 'd', CASE WHEN doc_id % 53 = 0 THEN concat('l-', CAST(max(line_idx) AS STRING)) END, 1, min(x), min(y), max(x + width) - min(x), max(y + height) - min(y), avg(confidence) FROM w GROUP BY doc_id
""",
    # Its edges. Faults by key: a repeated edge, a second parent, a reading cycle, a loop of unknown kind, a loop, a missing node, a missing mirror, a second successor, a word that contains its document, a document that is read.
    "faulty_edges": r"""
WITH b AS (__BOXES__), w AS (SELECT doc_id, line_idx, concat('w-', CAST(line_idx AS STRING), '-', CAST(word_idx AS STRING)) AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_idx, word_idx) AS INTEGER) AS pos, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n FROM b),
c AS (SELECT *, lead(id) OVER (PARTITION BY doc_id ORDER BY pos) AS next_id, first_value(id) OVER (PARTITION BY doc_id ORDER BY pos) AS first_id, CAST(20 + (doc_id * 7 + pos * 13) % 80 AS DOUBLE) / 100 AS score FROM w)
SELECT doc_id, type, from_id, to_id, score, CAST(ord AS INTEGER) AS ord, CAST(place AS INTEGER) AS place FROM (
  SELECT doc_id, 'CONTAINS' AS type, concat('l-', CAST(line_idx AS STRING)) AS from_id, id AS to_id, score, pos AS ord, 0 AS place FROM c
  UNION ALL SELECT DISTINCT doc_id, 'CONTAINS', 'd', concat('l-', CAST(line_idx AS STRING)), CAST(0.9 AS DOUBLE), 1000000 + line_idx, 0 FROM c
  UNION ALL SELECT doc_id, 'CONTAINS', concat('l-', CAST(line_idx AS STRING)), id, score, 2000000, 0 FROM c WHERE doc_id % 7 = 0 AND pos = 1
  UNION ALL SELECT doc_id, 'CONTAINS', 'd', id, CAST(0.99 AS DOUBLE), 2000001, 0 FROM c WHERE doc_id % 17 = 0 AND pos = 1
  UNION ALL SELECT doc_id, 'READING_NEXT', id, next_id, score, 3000000 + pos, pos FROM c WHERE next_id IS NOT NULL
  UNION ALL SELECT doc_id, 'READING_PREVIOUS', next_id, id, score, 4000000 + pos, pos + 1 FROM c WHERE next_id IS NOT NULL AND NOT (doc_id % 29 = 0 AND pos = 1)
  UNION ALL SELECT doc_id, 'READING_NEXT', id, first_id, score, 5000000, pos FROM c WHERE doc_id % 5 = 0 AND pos = n AND n > 1
  UNION ALL SELECT doc_id, 'NEAR', id, id, score, 5000001, pos FROM c WHERE doc_id % 19 = 0 AND pos = 1
  UNION ALL SELECT doc_id, 'READING_NEXT', id, id, CAST(0.1 AS DOUBLE), 5000002, pos FROM c WHERE doc_id % 47 = 0 AND pos = 1
  UNION ALL SELECT doc_id, 'CONTAINS', id, 'd', CAST(0.3 AS DOUBLE), 2000003, 0 FROM c WHERE doc_id % 61 = 0 AND pos = 1
  UNION ALL SELECT doc_id, 'READING_NEXT', 'd', id, score, 3999999, 0 FROM c WHERE doc_id % 67 = 0 AND pos = 1
  UNION ALL SELECT doc_id, 'CONTAINS', id, 'ghost', score, 5000003, 0 FROM c WHERE doc_id % 23 = 0 AND pos = 1
) AS e
""",
    # The rendered lines as boxes of a page, 40 px apart but for a second total beside the first, eight px a character.
    "sheet": r"""
SELECT doc_id, line_idx, text, CAST((line_idx * 7 + doc_id) % 10 AS DOUBLE) / 10 AS conf, CAST(doc_id % 3 * 40 AS DOUBLE) AS x, CAST(CASE WHEN line_idx = 5 THEN 170 ELSE 40 * line_idx END AS DOUBLE) AS y, CAST(8 * length(text) AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height,
  CASE WHEN line_idx <= 3 THEN 'header' WHEN line_idx <= 5 THEN 'footer' WHEN doc_id % 8 = 0 THEN NULL ELSE 'body' END AS region, CAST(floor(line_idx / 2) AS INTEGER) AS block, CASE WHEN line_idx > 5 THEN 1 ELSE 0 END AS page
FROM (__RENDERED__) AS r
""",
    # The sheets with more lines: labels without values, a long number weakly read, a broken date, items; some share rows.
    "scans": r"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS line_idx, text, CAST(conf AS DOUBLE) AS conf, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(8 * length(text) AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height FROM (
  SELECT doc_id, line_idx AS ord, text, CAST(20 + (line_idx * 37 + doc_id * 11) % 80 AS DOUBLE) / 100 AS conf, x, y FROM (__SHEET__) AS s
  UNION ALL SELECT o_orderkey, 7, 'Reference', 0.9, 0, 290 FROM {orders} WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 8, 'Mobile phone :', 0.95, 150, CASE WHEN o_orderkey % 4 = 0 THEN 295 ELSE 330 END FROM {orders} WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 9, concat('[6070218301', lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0'), ')'), CAST(50 + o_orderkey % 50 AS DOUBLE) / 100, 0, 360 FROM {orders} WHERE o_orderkey % 5 < 3
  UNION ALL SELECT o_orderkey, 10, concat('Date : 45-13-20', CAST(10 + o_orderkey % 20 AS STRING)), 0.8, 20, CASE WHEN o_orderkey % 6 = 1 THEN 365 ELSE 400 END FROM {orders} WHERE o_orderkey % 3 = 1
  UNION ALL SELECT o_orderkey, 11, CASE WHEN o_orderkey % 2 = 0 THEN 'Cash' ELSE 'Change due' END, 0.9, 0, 430 FROM {orders} WHERE o_orderkey % 7 < 3
  UNION ALL SELECT o_orderkey, 12, concat('Customer no 12a', CAST(o_custkey AS STRING), '4567 8901234'), 0.85, 0, 460 FROM {orders} WHERE o_orderkey % 9 = 2
  UNION ALL SELECT o_orderkey, 13, concat('code : ', lpad(CAST(o_orderkey % 10000 AS STRING), 9, '8'), ' x'), 0.99, 0, 490 FROM {orders} WHERE o_orderkey % 8 = 5
) AS r
""",
    # What a second reader finds in each of a page's regions, boxes in no order.
    "rereads": r"""
SELECT o_orderkey AS doc_id, CAST(region AS INTEGER) AS region, CAST(item AS INTEGER) AS item, CASE (o_orderkey * 5 + region * 7 + item * 3) % 13
    WHEN 0 THEN 'Total' WHEN 1 THEN concat(CAST(100 + o_orderkey % 900 AS STRING), '.40') WHEN 2 THEN concat('Date: ', CAST(1 + o_orderkey % 28 AS STRING), '/05/2024') WHEN 3 THEN 'Reference'
    WHEN 4 THEN lpad(CAST(o_orderkey * 7919 % 1000000000 AS STRING), 10, '0') WHEN 5 THEN 'thanks' WHEN 6 THEN concat('Transaction ', lpad(CAST(o_orderkey * 104729 AS STRING), 16, '7')) WHEN 7 THEN '12x456'
    WHEN 8 THEN concat('terminal ', CAST(100 + o_orderkey % 900 AS STRING)) WHEN 9 THEN concat('Customer 55', lpad(CAST(o_custkey AS STRING), 6, '0')) WHEN 10 THEN lpad(CAST(o_orderkey AS STRING), 8, '0')
    WHEN 11 THEN concat('(6070218309', lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0'), ') x') ELSE concat('Total ', CAST(45 + o_orderkey % 50 AS STRING), '.10') END AS text,
  CAST(60 + (o_orderkey * 3 + region * 17 + item * 29) % 41 AS DOUBLE) / 100 * CASE WHEN (o_orderkey + item) % 19 = 0 THEN 0 ELSE 1 END AS confidence,
  CASE WHEN (o_orderkey + region + item) % 23 = 0 THEN NULL ELSE CAST((o_orderkey * 7 + item * 211) % 400 AS DOUBLE) END AS x, CAST(20 + item * CASE WHEN (o_orderkey + region) % 4 = 0 THEN 70 ELSE 14 END + (o_orderkey + region * 3 + item * 5) % 9 + region * (o_orderkey % 4) * 15 AS DOUBLE) AS y,
  CAST(60 AS DOUBLE) AS width, CAST(10 + item % 3 * 2 AS DOUBLE) AS height, CAST((o_orderkey * 13 + region * 701) % 6000 AS INTEGER) AS latency
FROM {orders} JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS r(region) ON o_orderkey % 11 <> region JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS i(item) ON (o_orderkey + region) % 5 + 2 >= item
""",
    "budgets": "SELECT o_orderkey AS doc_id, CAST(3000 + o_orderkey * 977 % 30000 AS INTEGER) AS budget, o_orderkey % 3 <> 0 AS recall FROM {orders}",
    # Lines of Arabic and mixed pages as a reader misreads them: parted and doubled letters, glued scripts, stray edges.
    "arabic_lines": r"""
SELECT o_orderkey AS doc_id, CAST(k AS INTEGER) AS line_idx, CASE (o_orderkey * 7 + k * 5) % 15
    WHEN 0 THEN 'ا ل ر ح ي م متجر' WHEN 1 THEN concat('متجر الللرحيم ', CAST(o_orderkey AS STRING)) WHEN 2 THEN 'اااالرحيم و ت' WHEN 3 THEN concat('SuperPay', CAST(o_orderkey AS STRING), ' SA12', CAST(o_custkey AS STRING))
    WHEN 4 THEN concat('رقم', CAST(o_orderkey AS STRING), ' العملية') WHEN 5 THEN concat('gla المطلوب : ', CAST(o_custkey AS STRING), '.38') WHEN 6 THEN concat('له SuperPay ', CAST(o_custkey AS STRING)) WHEN 7 THEN translate(concat('الرحيمABC ', CAST(o_custkey AS STRING)), '0123456789', '٠١٢٣٤٥٦٧٨٩')
    WHEN 8 THEN concat('hello world ', CAST(o_orderkey AS STRING)) WHEN 9 THEN concat(CAST(o_custkey AS STRING), ' ريال المطلوب ;') WHEN 10 THEN 'glad | العلى' WHEN 11 THEN 'ab المجموع الكلي cd :' WHEN 12 THEN 'x ا ه' WHEN 13 THEN concat('tax12 ضريبةvat ', CAST(o_orderkey AS STRING)) ELSE 'أحمد' END AS text,
  CAST(50 + (o_orderkey + k * 3) % 50 AS DOUBLE) / 100 AS conf, CAST(10 AS DOUBLE) AS x, CAST(30 * k AS DOUBLE) AS y, CAST(300 AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height
FROM {orders} JOIN (VALUES (0), (1), (2), (3)) AS l(k) ON o_orderkey % 4 >= k
""",
    # What a schema asks of each order: keys with the expected value, where there is one.
    "asked": r"""
SELECT o_orderkey AS doc_id, 'invoice_number' AS key, CASE WHEN o_orderkey % 9 = 0 THEN '12345678' ELSE lpad(CAST(o_orderkey AS STRING), 8, '0') END AS expected FROM {orders}
UNION ALL SELECT o_orderkey, 'total_amount', CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN '7' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END FROM {orders}
UNION ALL SELECT o_orderkey, 'buyer_name', NULL FROM {orders}
UNION ALL SELECT o_orderkey, 'payment_method', CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS STRING) END FROM {orders}
""",
    # Replies of a model about each order: fenced, in prose with a trailing comma, plain, none, unclosed, a list.
    "replies": r"""
SELECT o_orderkey AS k, CASE o_orderkey % 6
    WHEN 0 THEN concat('```json', chr(10), '{"data": {"a": ', CAST(o_custkey AS STRING), '}}', chr(10), '```')
    WHEN 1 THEN concat('Sure: {"fields": {"b": [', CAST(o_custkey AS STRING), ', 2,], "c": "x}"}} done')
    WHEN 2 THEN concat('{"d": ', CAST(o_custkey AS STRING), ', "confidence": {"d": 0.5}}')
    WHEN 3 THEN concat('nothing ', CAST(o_custkey AS STRING))
    WHEN 4 THEN concat('{"open": {"e": ', CAST(o_custkey AS STRING), '}')
    ELSE concat('[', CAST(o_custkey AS STRING), ', 2, 3,]') END AS reply, o_custkey AS v FROM {orders}
""",
    # A model's verdicts on each order's type.
    "verdicts": r"""
SELECT o_orderkey AS k, CASE o_orderkey % 4
    WHEN 0 THEN concat('```json', chr(10), '{"type": "Invoice ", "confidence": ', CAST(o_custkey % 3 AS STRING), '.25, "reasons": ["a", "b", "c", "d", "e", "f"]}', chr(10), '```')
    WHEN 1 THEN 'I think {"type": "memo", "confidence": "x"} ok'
    WHEN 2 THEN concat('none ', CAST(o_custkey AS STRING))
    ELSE concat('{"type": "receipt", "confidence": 0.', CAST(1 + o_custkey % 9 AS STRING), ', "reasons": []}') END AS reply, o_custkey AS v FROM {orders}
""",
    # Replies of a reader of pages: lines as JSON, as plain text, none.
    "pages_read": r"""
SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN concat('{"lines": [{"text": "total ', CAST(o_custkey AS STRING), '", "confidence": 0.9}, {"text": "end"}]}')
    WHEN 1 THEN concat('plain ', CAST(o_custkey AS STRING), chr(10), 'text') ELSE '{"lines": []}' END AS reply, o_custkey AS v FROM {orders}
""",
    "jobs": r"""
SELECT event_id AS job_id, user_id, ts AS updated_at,
       CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'extracting' WHEN 'signup' THEN 'validating' WHEN 'purchase' THEN 'complete' ELSE 'error' END AS status,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('key-', CAST(event_id % 97 AS STRING)) END AS idempotency_key
FROM {events}
""",
}


FIXTURES["sheet"] = FIXTURES["sheet"].replace("__RENDERED__", RENDERED.strip())
FIXTURES["scans"] = FIXTURES["scans"].replace("__SHEET__", FIXTURES["sheet"].strip())
for _name in ("faulty_nodes", "faulty_edges"):
    FIXTURES[_name] = FIXTURES[_name].replace("__BOXES__", FIXTURES["boxes"].strip())


def evenly(df: DataFrame, column: str, rows: int) -> DataFrame:
    """df dealt by a column to tasks of about so many rows: for tables whose rows make many more in their task, where the size of what is dealt tells nothing."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), column)


def derived(spark: SparkSession, sf_dir: str, sql: str, dealt: dict[str, str | tuple[str, int]] | None = None) -> DataFrame:
    """The rows of a SQL text whose table names stand in braces; other braces are its own. dealt: columns by which tables are dealt over tasks before, or with them the rows of a task."""
    plain = re.sub(r"\{\{(\w+)\}\}", r"{\1}", sql.replace("{", "{{").replace("}", "}}"))
    used = set(re.findall(r"\{(\w+)\}", sql)) & set(TABLES)

    def read(t: str) -> DataFrame:
        by = (dealt or {}).get(t)
        found = table(spark, sf_dir, t)
        return found if by is None else found.repartition(by) if isinstance(by, str) else evenly(found, *by)

    return spark.sql(plain, **{t: read(t) for t in used})


def fixture(spark: SparkSession, sf_dir: str, name: str, dealt: dict[str, str | tuple[str, int]] | None = None) -> DataFrame:
    return derived(spark, sf_dir, FIXTURES[name], dealt)


def fixture_sql(name: str) -> str:
    """The fixture as a parenthesized DuckDB subquery."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", FIXTURES[name]).strip() + ")"


def with_fixtures(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS {fixture_sql(n)}" for n in names)


def rows(spark: SparkSession, columns: str, data: list[tuple]) -> DataFrame:
    return spark.createDataFrame(data, columns)


def rows_sql(columns: str, data: list[tuple]) -> str:
    """The same rows as a DuckDB subquery; columns as in a Spark schema string."""

    def lit(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else repr(v)

    names, kinds = zip(*(c.strip().split(" ", 1) for c in columns.split(",")), strict=True)
    kinds = [{"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}[k.strip()] for k in kinds]
    casts = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True))
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in data)
    return f"(SELECT {casts} FROM (VALUES {body}) AS v({', '.join(names)}))"
