"""Queries of profiles as tables (inventory 2.7 and 2.14): documents of several profiles in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import profiles as P
from docloom.operators.stages import run
from docloom.plans.grounding import BASE, lines
from docloom.registry import query
from docloom.sources import dimensions as D
from docloom.sources.tables import derived, fixture, with_fixtures

REGISTRY = P.Registry()
#: Every order as an invoice, a receipt or a contract, or of a type that no profile has.
KINDS = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 7 WHEN 0 THEN 'receipt' WHEN 1 THEN 'contract' WHEN 2 THEN 'memo' WHEN 3 THEN 'receipt' ELSE 'invoice' END AS profile FROM {orders}"
#: The orders' fields under the keys of their profile, some blank, some of no profile.
VALUES = """SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 3) THEN CASE key WHEN 'invoice_number' THEN 'receipt_number' WHEN 'invoice_date' THEN 'receipt_date' WHEN 'seller_tax_id' THEN 'transaction_id' WHEN 'buyer_name' THEN 'mobile_number' ELSE key END
  WHEN doc_id % 7 = 1 THEN CASE key WHEN 'invoice_number' THEN 'contract_title' WHEN 'invoice_date' THEN 'contract_date' WHEN 'buyer_name' THEN 'party_a_name' ELSE key END ELSE key END AS key,
  CASE WHEN doc_id % 31 = 0 AND ord = 1 THEN ' ' WHEN key = 'seller_tax_id' AND doc_id % 4 = 0 THEN lpad(raw, 16, '7') WHEN key = 'buyer_name' AND doc_id % 5 = 0 THEN '01012345678' ELSE raw END AS value FROM (__CANDIDATES__) AS c"""


def values_text() -> str:
    from docloom.sources.tables import FIXTURES

    return VALUES.replace("__CANDIDATES__", FIXTURES["candidates"].strip())


def kinds(spark, sf_dir):
    return derived(spark, sf_dir, KINDS)


def values(spark, sf_dir):
    return derived(spark, sf_dir, values_text())


def plain(sql: str) -> str:
    return sql.replace("{orders}", "orders")


def rule_test(r: tuple) -> str:
    _, kind, _, pattern, low, high, listed = r
    if listed:
        return f"upper(v) IN ({', '.join(f"'{c}'" for c in D.CURRENCIES)})"
    if pattern:
        return f"regexp_matches(v, '{pattern}')"
    if kind == "date":
        return r"regexp_matches(v, '^\d{4}-\d{2}-\d{2}$')"
    if kind in ("number", "currency"):
        return "TRY_CAST(v AS DOUBLE) IS NOT NULL" + (f" AND TRY_CAST(v AS DOUBLE) >= {low}" if low is not None else "") + (f" AND TRY_CAST(v AS DOUBLE) <= {high}" if high is not None else "")
    return "true"


def rules_sql() -> str:
    parts = []
    for profile, (_, rules) in D.PROFILES.items():
        for n, r in enumerate(rules):
            must = r[2] and profile not in D.LENIENT
            parts.append(f"SELECT d.doc_id, d.profile, {n} AS rule, '{r[0]}' AS key, CASE WHEN v IS NULL THEN {str(not must).lower()} ELSE coalesce({rule_test(r)}, false) END AS ok, {1.0 if must else 0.5}::DOUBLE AS weight, CASE WHEN v IS NULL AND {str(must).lower()} THEN '{r[0]}' END AS missing FROM d LEFT JOIN vv ON vv.doc_id = d.doc_id AND vv.key = '{r[0]}' WHERE d.profile = '{profile}'")
    return " UNION ALL ".join(parts)


NAMES = ", ".join(f"'{p}'" for p in D.PROFILES)
CHECKED = f"WITH d0 AS ({plain(KINDS)}), d AS (SELECT doc_id, CASE WHEN profile IN ({NAMES}) THEN profile ELSE 'unknown' END AS profile FROM d0), vals AS ({plain(values_text())}), vv AS (SELECT doc_id, key, nullif(trim(value), '') AS v FROM vals)"


@query("val_profiles", f"{CHECKED} SELECT doc_id, profile, rule, key, ok, weight, missing FROM ({rules_sql()}) AS c")
def val_profiles(spark, sf_dir):
    """Every rule of every document's own profile."""
    return P.checked(REGISTRY, kinds(spark, sf_dir), values(spark, sf_dir))


KNOWN = " UNION ALL ".join(f"SELECT '{p}' AS profile, '{f[0]}' AS key, '{f[1]}' AS type, {str(f[3]).lower()} AS required" for p, (fields, _) in D.PROFILES.items() for f in fields)


@query("val_unknown_rule", f"{CHECKED} SELECT d.doc_id, d.profile, vals.key FROM d JOIN vals USING (doc_id) ANTI JOIN ({KNOWN}) k ON k.profile = d.profile AND k.key = vals.key")
def val_unknown_rule(spark, sf_dir):
    """Values of keys that their document's profile does not have: no rule is known for them."""
    return P.unknown_keys(REGISTRY, kinds(spark, sf_dir), values(spark, sf_dir))


WORDS = {f[0]: P.E.label_words(f[2], P.group_of(f[0]) or "") for fields, _ in D.PROFILES.values() for f in fields if f[1] not in ("array", "enum")}


def word_sql(words: list[str]) -> str:
    tests = [f"WHEN {f"regexp_matches(nline, '\\b\\Q{w}\\E\\b')" if w.isascii() else f"contains(nline, '{w}')"} THEN '{w}'" for w in words]
    return f"CASE {' '.join(tests)} END"


TO_DATE = "CASE WHEN regexp_matches(r, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN r WHEN length(p1) = 4 THEN p1 || '-' || p2 || '-' || p3 WHEN length(p3) = 4 THEN p3 || '-' || p2 || '-' || p1 END"
LACK = f"lack AS (SELECT d.doc_id, d.profile, k.key, k.type FROM d JOIN ({KNOWN}) k ON k.profile = d.profile AND k.required ANTI JOIN (SELECT doc_id, key FROM vals WHERE trim(value) <> '') h ON h.doc_id = d.doc_id AND h.key = k.key)"
FOUND = f"""{BASE}, {CHECKED.removeprefix('WITH ')}, {LACK}, hits AS ({' UNION ALL '.join(f"SELECT w.doc_id, w.line_idx, w.ocr, w.nline, l.key, l.type, {word_sql(ws)} AS word FROM w JOIN lack l ON l.doc_id = w.doc_id AND l.key = '{k}'" for k, ws in WORDS.items() if any(f[0] == k and f[3] for fields, _ in D.PROFILES.values() for f in fields))}),
aft AS (SELECT *, trim(regexp_replace(list_last(string_split(nline, word)), '^[\\s:：.\\-#]+', '')) AS a FROM hits WHERE word IS NOT NULL),
rw AS (SELECT *, CASE WHEN type = 'date' THEN list_last(regexp_extract_all(nline, '[0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,4}}')) WHEN type IN ('number', 'currency') THEN list_last(regexp_extract_all(a, '[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?')) ELSE nullif(a, '') END AS raw FROM aft),
dt AS (SELECT *, replace(raw, '.', '-') AS r, regexp_extract(replace(raw, '.', '-'), '^([0-9]{{1,4}})[/-]([0-9]{{1,2}})[/-]([0-9]{{1,4}})$', 1) AS p1, lpad(regexp_extract(replace(raw, '.', '-'), '^([0-9]{{1,4}})[/-]([0-9]{{1,2}})[/-]([0-9]{{1,4}})$', 2), 2, '0') AS p2, regexp_extract(replace(raw, '.', '-'), '^([0-9]{{1,4}})[/-]([0-9]{{1,2}})[/-]([0-9]{{1,4}})$', 3) AS p3 FROM rw WHERE raw IS NOT NULL),
cd AS (SELECT doc_id, key, line_idx, raw, CASE WHEN type = 'date' THEN {TO_DATE.replace("THEN p1 || '-' || p2 || '-' || p3", "THEN p1 || '-' || p2 || '-' || lpad(p3, 2, '0')").replace("|| p2 || '-' || p1 END", "|| p2 || '-' || lpad(p1, 2, '0') END")} WHEN type IN ('number', 'currency') THEN replace(raw, ',', '') ELSE raw END AS value, least(0.5, coalesce(ocr, 0.7) * 0.7) AS confidence FROM dt)"""


def missing(spark, sf_dir):
    return P.lacking(REGISTRY, kinds(spark, sf_dir), values(spark, sf_dir))


@query("rec_profiles", f"{FOUND} SELECT doc_id, key, line_idx, raw, value, round(confidence, 6)::DOUBLE AS confidence FROM cd WHERE value IS NOT NULL")
def rec_profiles(spark, sf_dir):
    """Candidates for every required field that a document of any profile lacks."""
    found = P.recovery(REGISTRY, lines(spark, sf_dir), missing(spark, sf_dir))
    return found.withColumn("confidence", F.round("confidence", 6))


@query("rec_profiles_decide", f"{FOUND}, pd AS (SELECT doc_id, key, count(DISTINCT value) AS n, min(value) AS v, max(confidence) AS c, array_to_string(list_sort(list(DISTINCT value)), '|') AS alternatives FROM cd WHERE value IS NOT NULL GROUP BY 1, 2) SELECT doc_id, key, CASE WHEN n = 1 THEN 'flagged' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN v END AS value, round(CASE WHEN n = 1 THEN c ELSE 0 END, 6)::DOUBLE AS confidence, alternatives FROM pd WHERE n > 1 OR EXISTS (SELECT 1 FROM w WHERE w.doc_id = pd.doc_id AND contains(w.nline, pd.v))")
def rec_profiles_decide(spark, sf_dir):
    ln = lines(spark, sf_dir)
    out = P.recovered(P.recovery(REGISTRY, ln, missing(spark, sf_dir), tell=True), ln)
    return out.select("doc_id", "key", "status", "value", F.round("confidence", 6).alias("confidence"), F.array_join("alternatives", "|").alias("alternatives"))


@query("rec_retry_eligible", f"{FOUND} SELECT l.doc_id, l.key FROM lack l ANTI JOIN (SELECT doc_id, key FROM cd WHERE value IS NOT NULL) c ON c.doc_id = l.doc_id AND c.key = l.key")
def rec_retry_eligible(spark, sf_dir):
    """Required fields without a value and without a candidate: only these are asked for again."""
    lack = missing(spark, sf_dir)
    return lack.join(P.recovery(REGISTRY, lines(spark, sf_dir), lack).select("doc_id", "key"), ["doc_id", "key"], "left_anti").select("doc_id", "key")


def stages():
    """Load, classify, validate: a document without lines, of no profile or with broken rules stops where that shows."""

    def load(state):
        n = state["lines"].groupBy("doc_id").agg(F.count("*").alias("n"))
        out = state["docs"].join(n, "doc_id", "left").select("doc_id", F.when(F.coalesce("n", F.lit(0)) < 5, "EMPTY_SOURCE").alias("error"), F.concat(F.col("n").cast("string"), F.lit(" lines")).alias("detail"))
        return state, out

    def classify(state):
        profile = REGISTRY.resolved(F.col("profile"))
        return state, state["docs"].select("doc_id", F.when(profile == P.FALLBACK, "PROFILE_NOT_FOUND").alias("error"), profile.alias("detail"))

    def validate(state):
        c = P.checked(REGISTRY, state["docs"], state["values"])
        n = c.groupBy("doc_id").agg(F.count_if(~F.col("ok")).alias("bad"), F.count("missing").alias("missing"))
        return state | {"checks": c}, n.select("doc_id", F.when(F.col("missing") > 0, "EXTRACTION_FAILED").alias("error"), F.concat(F.col("bad").cast("string"), F.lit(" broken")).alias("detail"))

    return [("load", load), ("classify", classify), ("validate", validate)]


TRACED = f"""{with_fixtures('scans')}, {CHECKED.removeprefix('WITH ')}, ld AS (SELECT d0.doc_id, d0.profile, coalesce(n, 0) AS n FROM d0 LEFT JOIN (SELECT doc_id, count(*) AS n FROM scans GROUP BY 1) USING (doc_id)), cs AS (SELECT * FROM ld JOIN (SELECT doc_id, profile AS known FROM d) USING (doc_id) WHERE n >= 5),
rl AS (SELECT doc_id, count(*) FILTER (NOT ok) AS bad, count(missing) AS missing FROM ({rules_sql()}) GROUP BY 1), vd AS (SELECT doc_id, bad, missing FROM cs JOIN rl USING (doc_id) WHERE known <> 'unknown')"""


@query("trc_events", f"{TRACED} SELECT doc_id, 0 AS ord, 'load' AS stage, 'start' AS event, NULL AS detail FROM ld UNION ALL SELECT doc_id, 0, 'load', CASE WHEN n < 5 THEN 'error' ELSE 'finish' END, CASE WHEN n < 5 THEN 'EMPTY_SOURCE' ELSE n || ' lines' END FROM ld UNION ALL SELECT doc_id, 1, 'classify', 'start', NULL FROM cs UNION ALL SELECT doc_id, 1, 'classify', CASE WHEN known = 'unknown' THEN 'error' ELSE 'finish' END, CASE WHEN known = 'unknown' THEN 'PROFILE_NOT_FOUND' ELSE known END FROM cs UNION ALL SELECT doc_id, 2, 'validate', 'start', NULL FROM cs WHERE known <> 'unknown' UNION ALL SELECT doc_id, 2, 'validate', CASE WHEN missing > 0 THEN 'error' ELSE 'finish' END, CASE WHEN missing > 0 THEN 'EXTRACTION_FAILED' ELSE bad || ' broken' END FROM vd")
def trc_events(spark, sf_dir):
    """What each stage started, finished or failed at, document by document."""
    state = {"docs": kinds(spark, sf_dir), "lines": fixture(spark, sf_dir, "scans"), "values": values(spark, sf_dir)}
    return run(stages(), state)[1]
