"""Queries over text functions (inventory 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.registry import query
from docloom.sources.tables import FIXTURES, derived, fixture, table, with_fixtures

# DuckDB spellings of the shared patterns.
SP = r"[\s\x{0b}\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BD = r"[\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"
DIG = "translate({}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def count_sql(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def over(name: str, fix: str, column, sql: str, key: str = "k", text: str = "s"):
    """Register one expression over a whole fixture."""

    @query(name, f"{with_fixtures(fix)} SELECT {key}, {sql} AS result FROM {fix}")
    def run(spark, sf_dir):
        return fixture(spark, sf_dir, fix).select(key, column(F.col(text)).alias("result"))

    return run


NORMAL = f"translate(lower(trim(regexp_replace(regexp_replace({DIG.format('s')}, '{BD}', '', 'g'), '{SP}+', ' ', 'g'))), 'آأإٱٳٵىیۍېۑٸةـ', 'ااااااييييييه')"
over("str_unify_digits", "fragments", T.unify_digits, DIG.format("s"))
over("str_normalize_text", "fragments", T.normalize, NORMAL)
over("str_strip_bidi", "fragments", T.strip_bidi, f"regexp_replace(s, '{BD}', '', 'g')")

ARABIC = r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]"
LATIN = r"[A-Za-z\x{c0}-\x{24f}]"


@query("str_script_counts", f"{with_fixtures('mixed')} SELECT doc_id, {count_sql('text', ARABIC)} AS arabic, {count_sql('text', LATIN)} AS latin, regexp_matches(text, '[٠-٩۰-۹]') AS arabic_digit FROM mixed")
def script_counts(spark, sf_dir):
    s = F.col("text")
    return fixture(spark, sf_dir, "mixed").select("doc_id", T.count(s, ARABIC).alias("arabic"), T.count(s, LATIN).alias("latin"), s.rlike("[٠-٩۰-۹]").alias("arabic_digit"))


def script_sql(x: str, name: str) -> str:
    """Letters of a script: letters are kept first, then those of the range are counted."""
    kept = f"regexp_replace({x}, '[^\\p{{L}}]', '', 'g')"
    if name == "latin":
        every = "".join(T.SCRIPTS.values())
        return f"length(regexp_replace({kept}, '[{every}]', '', 'g'))"
    return f"length(regexp_replace({kept}, '[^{T.SCRIPTS[name]}]', '', 'g'))"


NAMES = (*T.SCRIPTS, "latin")
LETTERS = "length(regexp_replace({}, '[^\\p{{L}}]', '', 'g'))"


@query("str_letter_script", f"{with_fixtures('mixed')} SELECT doc_id, {', '.join(f'{script_sql("text", n)} AS {n}' for n in NAMES)} FROM mixed")
def letter_script(spark, sf_dir):
    return fixture(spark, sf_dir, "mixed").select("doc_id", *(T.script_letters(F.col("text"), n).alias(n) for n in NAMES))


def ratio_sql(part: str, whole: str, empty: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN {empty} ELSE {part} / {whole} END"


@query("str_arabic_ratio", f"{with_fixtures('mixed')} SELECT doc_id, round({ratio_sql(script_sql('text', 'arabic'), LETTERS.format('text'), '0.0')}, 9) AS ratio FROM mixed")
def arabic_ratio(spark, sf_dir):
    return fixture(spark, sf_dir, "mixed").select("doc_id", F.round(T.script_ratio(F.col("text"), "arabic"), 9).alias("ratio"))


@query("str_latin_ratio", f"{with_fixtures('mixed')} SELECT doc_id, round({ratio_sql(script_sql('text', 'latin'), LETTERS.format('text'), '0.0')}, 9) AS ratio FROM mixed")
def latin_ratio(spark, sf_dir):
    return fixture(spark, sf_dir, "mixed").select("doc_id", F.round(T.script_ratio(F.col("text"), "latin"), 9).alias("ratio"))


PRINTABLE = ratio_sql(count_sql("{t}", rf"[\p{{L}}\p{{N}}\p{{P}}\p{{S}}]|{SP}").replace("{t}", "TXT"), "length(TXT)", "1.0")
CONSISTENT = ratio_sql("greatest(" + ", ".join(script_sql("TXT", n) for n in NAMES) + ")", LETTERS.format("TXT"), "1.0")
TOKENS = f"list_filter(regexp_split_to_array(regexp_replace(TXT, '{BD}', '', 'g'), '{SP}+'), lambda t: t <> '')"
QUALITY_OF = (
    "CASE WHEN length(t) > 60 THEN 0.0 WHEN NOT regexp_matches(t, '\\p{L}') THEN CASE WHEN regexp_matches(t, '[0-9]') THEN 0.5 ELSE 0.1 END "
    "WHEN len(regexp_extract_all(t, '\\p{L}')) / length(t) < 0.4 THEN 0.25 "
    "WHEN len(regexp_extract_all(t, '\\p{L}')) / length(t) < 0.9 AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[\\p{P}\\p{S}]') THEN 0.25 "
    "WHEN length(t) >= 4 AND len(list_distinct(regexp_extract_all(t, '(?s).'))) <= 2 THEN 0.0 ELSE 1.0 END"
)
QUALITY = f"CASE WHEN len({TOKENS}) = 0 THEN 1.0 ELSE list_avg(list_transform({TOKENS}, lambda t: {QUALITY_OF})) END"
HISTOGRAM = f"map_values(list_histogram(list_transform({TOKENS}, lambda t: lower(t))))"
REPEATED = f"CASE WHEN len({TOKENS}) < 3 THEN 0.0 ELSE len(list_filter({HISTOGRAM}, lambda n: n >= 3)) / len({HISTOGRAM}) END"
PUNCT = T.COMMON_PUNCTUATION.replace("'", "''")
FAULT_OF = f"CASE WHEN length(t) > 24 AND regexp_matches(t, '\\p{{L}}') AND regexp_matches(t, '[0-9]') THEN 'oversized' WHEN NOT regexp_matches(t, '\\p{{L}}|[0-9]') AND NOT regexp_matches(t, '{PUNCT}') THEN 'symbol' END"
SOLID = f"regexp_replace(TXT, '{SP}+', '', 'g')"
GARBAGE = f"coalesce(list_filter(list_transform({TOKENS}, lambda t: {FAULT_OF}), lambda f: f IS NOT NULL)[1], CASE WHEN length(TXT) >= 4 AND len(regexp_extract_all({SOLID}, '[\\p{{P}}\\p{{S}}]')) > 0.5 * length({SOLID}) THEN 'dominated' END)"


def measure(name: str, column, sql: str, rounded: bool = True):
    body = sql.replace("TXT", "text")
    body = f"round(({body})::DOUBLE, 9)" if rounded else body

    @query(name, f"{with_fixtures('mixed')} SELECT doc_id, {body} AS result FROM mixed")
    def run(spark, sf_dir):
        value = column(F.col("text"))
        return fixture(spark, sf_dir, "mixed").select("doc_id", (F.round(value, 9) if rounded else value).alias("result"))


measure("str_printable_ratio", T.printable_ratio, PRINTABLE)
measure("str_script_consistency", T.script_consistency, CONSISTENT)
measure("str_token_quality", T.token_quality, QUALITY)
measure("str_repetition", T.repetition, REPEATED)
measure("str_structural_garbage", T.structural_garbage, GARBAGE, rounded=False)

LINES = f"{with_fixtures('mixed')}, lines AS (SELECT doc_id, unnest(generate_series(0, len(l) - 1))::INTEGER AS line_idx, unnest(l) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM mixed))"
MEASURED = f"SELECT doc_id, line_idx, text, {PRINTABLE.replace('TXT', 'text')} AS printable, {CONSISTENT.replace('TXT', 'text')} AS consistent, {QUALITY.replace('TXT', 'text')} AS token, {REPEATED.replace('TXT', 'text')} AS repeated, {GARBAGE.replace('TXT', 'text')} AS fault, CASE WHEN line_idx % 3 = 0 THEN NULL ELSE (line_idx % 10) / 10.0 END AS ocr FROM lines"
NOISE = "CASE WHEN fault IS NOT NULL THEN 1.0 ELSE least(1.0, greatest(0.0, (1 - printable) * 0.3 + (1 - consistent) * 0.25 + (1 - token) * 0.25 + repeated * 0.1 + coalesce((1 - ocr) * 0.1, 0.0))) END"


def mixed_lines(spark, sf_dir):
    from docloom.sources.documents import lines

    return lines(fixture(spark, sf_dir, "mixed")).withColumn("ocr", F.when(F.col("line_idx") % 3 != 0, (F.col("line_idx") % 10) / 10))


@query("str_noise_score", f"{LINES}, m AS ({MEASURED}) SELECT doc_id, line_idx, round(({NOISE})::DOUBLE, 9) AS noise, ({NOISE}) > 0.55 AS is_noise FROM m")
def noise_score(spark, sf_dir):
    noise = T.noise_score(F.col("text"), F.col("ocr"))
    found = mixed_lines(spark, sf_dir).select("doc_id", "line_idx", noise.alias("n"))
    return found.select("doc_id", "line_idx", F.round("n", 9).alias("noise"), (F.col("n") > T.NOISE_THRESHOLD).alias("is_noise"))


@query(
    "str_line_quality",
    f"""{LINES}, m AS ({MEASURED}) SELECT doc_id, line_idx, round(({ratio_sql(script_sql('text', 'arabic'), LETTERS.format('text'), '0.0')})::DOUBLE, 9) AS arabic_ratio,
round(printable::DOUBLE, 9) AS printable_ratio, round(consistent::DOUBLE, 9) AS script_consistency, round(ocr::DOUBLE, 9) AS ocr_confidence, round(({NOISE})::DOUBLE, 9) AS noise_score,
concat_ws(',', fault, CASE WHEN printable < 0.9 THEN 'printable' END, CASE WHEN consistent < 0.75 THEN 'scripts' END, CASE WHEN token < 0.75 THEN 'tokens' END, CASE WHEN repeated > 0.5 THEN 'repetitive' END, CASE WHEN ocr < 0.5 THEN 'ocr' END) AS reasons FROM m""",
)
def line_quality(spark, sf_dir):
    from docloom.operators.quality import line_quality as quality

    q = quality(mixed_lines(spark, sf_dir), "ocr")
    numbers = ("arabic_ratio", "printable_ratio", "script_consistency", "ocr_confidence", "noise_score")
    return q.select("doc_id", "line_idx", *(F.round(n, 9).alias(n) for n in numbers), F.array_join("reasons", ",").alias("reasons"))


BLOCKED = ", ".join(f"'{b}'" for b in T.BLOCKED_KEYS)
SNAKE = f"lower(regexp_replace(regexp_replace(regexp_replace({trim_sql('s')}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g'))"
over("str_safe_key", "fragments", T.safe_key, f"CASE WHEN {SNAKE} IN ({BLOCKED}) THEN '' ELSE {SNAKE} END")

KEYS = "SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN concat('account_number_', CAST(o_custkey AS STRING)) WHEN 1 THEN concat('totalTax', CAST(o_custkey AS STRING)) WHEN 2 THEN 'a_b__c' WHEN 3 THEN '' WHEN 4 THEN concat('vat-id_no ', CAST(o_custkey AS STRING)) WHEN 5 THEN 'ÉTAT_civil' WHEN 6 THEN concat(CAST(o_custkey AS STRING), 'nd_line') ELSE '_lead UPPER_low' END AS key FROM {orders}"


@query("str_humanize_key", f"SELECT k, array_to_string(list_transform(regexp_extract_all(replace(key, '_', ' '), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: CASE WHEN regexp_matches(w, '^[a-z]') THEN upper(w[1]) || w[2:] ELSE w END), '') AS label FROM ({KEYS.replace('{orders}', 'orders')})")
def humanize_key(spark, sf_dir):
    return derived(spark, sf_dir, KEYS).select("k", T.humanize_key(F.col("key")).alias("label"))


RUNS = f"list_filter(list_transform(regexp_extract_all({DIG.format(trim_sql('s'))}, '[0-9\\-+().]+'), lambda r: regexp_replace(r, '[\\-+().]', '', 'g')), lambda r: r <> '')"
NATIONAL = "CASE WHEN regexp_matches(R, '^200?1[0125][0-9]{8}$') THEN CASE WHEN R[3] = '0' THEN R[3:] ELSE '0' || R[3:] END END"
TRIES = ", ".join(f"CASE WHEN r[{p}] = '{seen}' AND regexp_matches(r[:{p - 1}] || '{to}' || r[{p + 1}:], '^01[0125][0-9]{{8}}$') THEN r[:{p - 1}] || '{to}' || r[{p + 1}:] END" for p in (2, 3) for seen, many in T.MISREAD.items() for to in many)


@query(
    "str_sanitize_mobile",
    f"""{with_fixtures('fragments')}, r AS (SELECT k, {trim_sql('s')} AS s, {RUNS} AS runs FROM fragments)
SELECT k, coalesce({NATIONAL.replace('R', "array_to_string(runs, '')")},
  list_filter(list_transform(runs, lambda r: CASE WHEN regexp_matches(r, '^01[0125][0-9]{{8}}$') THEN r ELSE {NATIONAL.replace('R', 'r')} END), lambda x: x IS NOT NULL)[1],
  list_filter(list_transform(runs, lambda r: CASE WHEN regexp_matches(r, '^0[0-9]{{10}}$') THEN coalesce({TRIES}) END), lambda x: x IS NOT NULL)[1],
  list_filter(runs, lambda r: length(r) = list_max(list_transform(runs, lambda z: length(z))))[1], s) AS result FROM r""",
)
def sanitize_mobile(spark, sf_dir):
    return fixture(spark, sf_dir, "fragments").select("k", T.sanitize_mobile(F.col("s")).alias("result"))


FIELDS = "SELECT doc_id, ord, concat(CASE (doc_id + ord) % 6 WHEN 0 THEN 'mobile_' WHEN 1 THEN 'contact_phone_' WHEN 2 THEN 'my_mobile_' ELSE '' END, key) AS key, CASE doc_id % 5 WHEN 0 THEN 'phone' WHEN 1 THEN 'buyer' END AS grp FROM (__CANDIDATES__) AS c".replace("__CANDIDATES__", FIXTURES["candidates"].strip())


@query("str_is_mobile_field", f"SELECT doc_id, ord, coalesce(grp = 'phone', false) OR key LIKE 'mobile%' OR key LIKE '%phone%' AS is_mobile FROM ({FIELDS.replace('{orders}', 'orders')})")
def is_mobile_field(spark, sf_dir):
    return derived(spark, sf_dir, FIELDS).select("doc_id", "ord", T.is_mobile_field(F.col("key"), F.col("grp")).alias("is_mobile"))


MARKED = "SELECT page_id, concat('# T', CAST(page_id AS STRING), chr(10), '> ', html, chr(10), '- **b** and _i_ `c` ![a](u) [l](v)', chr(10), '```py', chr(10), 'x = 1', chr(10), '```', chr(10), chr(10), chr(10), '1. one', chr(10), '---') AS md FROM {pages}"


def _strip_sql() -> str:
    out = "md"
    for wrapper in T.wrappers():
        out = f"regexp_replace({out}, '{wrapper}', '\\1', 'g')"
    for pattern, to in ((T.LINE_HEAD, ""), (T.ITEM_HEAD, ""), (T.TAG, ""), (T.GAP, "\n\n")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return trim_sql(out)


def marked(spark, sf_dir):
    return spark.sql(MARKED, pages=table(spark, sf_dir, "pages"))


@query("str_strip_markdown", f"SELECT page_id, md5({_strip_sql()}) AS digest FROM ({MARKED.replace('{pages}', 'pages')})")
def strip_markdown(spark, sf_dir):
    return marked(spark, sf_dir).select("page_id", F.md5(T.strip_markdown(F.col("md"))).alias("digest"))


INLINE = {"bold": r"\*\*([^*]+)\*\*", "code": "`([^`]+)`", "image": r"!\[([^\]]*)\]\([^)]+\)", "link": r"\[([^\]]+)\]\([^)]+\)", "strike": "~~([^~]+)~~"}


@query("str_parse_inline", f"SELECT page_id, {', '.join(f"array_to_string(regexp_extract_all(md, '{p}', 1), '|') AS {n}" for n, p in INLINE.items())} FROM ({MARKED.replace('{pages}', 'pages')})")
def parse_inline(spark, sf_dir):
    return marked(spark, sf_dir).select("page_id", *(F.array_join(F.regexp_extract_all("md", F.lit(p), F.lit(1)), "|").alias(n) for n, p in INLINE.items()))


KINDS = [("fence", "^```"), ("heading", r"^#{1,6}\s"), ("rule", r"^[-*_]{3,}\s*$"), ("quote", r"^>\s?"), ("bullet", r"^\s*[-*+]\s"), ("ordered", r"^\s*\d+\.\s"), ("table", r"^\s*\|.*\|\s*$"), ("blank", r"^\s*$")]


@query(
    "str_parse_markdown",
    f"SELECT page_id, line_idx, CASE {' '.join(f"WHEN regexp_matches(l, '{p}') THEN '{n}'" for n, p in KINDS)} ELSE 'paragraph' END AS kind FROM (SELECT page_id, unnest(generate_series(0, len(a) - 1))::INTEGER AS line_idx, unnest(a) AS l FROM (SELECT page_id, string_split(md, chr(10)) AS a FROM ({MARKED.replace('{pages}', 'pages')})))",
)
def parse_markdown(spark, sf_dir):
    kind = F.coalesce(*(F.when(F.col("l").rlike(p), n) for n, p in KINDS), F.lit("paragraph"))
    return marked(spark, sf_dir).select("page_id", F.posexplode(F.split("md", "\n")).alias("line_idx", "l")).select("page_id", "line_idx", kind.alias("kind"))


over("str_contains_rtl", "fragments", lambda s: s.rlike(r"[\x{590}-\x{8ff}]"), r"regexp_matches(s, '[\x{590}-\x{8ff}]')")


@query("str_truncate_middle", "SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN text[:1000] || '\n[...]\n' || right(text, 1000) ELSE text END) AS digest FROM documents")
def truncate_middle(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncate_middle(F.col("text"), 2000, "\n[...]\n")).alias("digest"))


PROMPT = "Profile: {profile}\nFields: {fields}\nDocument:\n{text}"


@query("str_build_prompt", f"SELECT conv_id, turn, md5(replace(replace(replace('{PROMPT}', '{{profile}}', role), '{{fields}}', 'total, date'), '{{text}}', text)) AS digest FROM conversations")
def build_prompt(spark, sf_dir):
    filled = F.lit(PROMPT)
    for name, value in (("{profile}", F.col("role")), ("{fields}", F.lit("total, date")), ("{text}", F.col("text"))):
        filled = F.replace(filled, F.lit(name), value)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(filled).alias("digest"))


over("str_csv_escape", "fragments", T.csv_escape, "CASE WHEN regexp_matches(s, '[\",\n\r]') THEN '\"' || replace(s, '\"', '\"\"') || '\"' ELSE s END")

#: What a user might send about each order: messages, ids, addresses, passwords, types and sizes, good and bad.
CHECKS = """SELECT o_orderkey AS k, repeat(CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'x' END, CAST(o_orderkey % 4 * 3334 AS INT)) AS message,
  concat(substr(md5(CAST(o_orderkey AS STRING)), 1, 8), '-', substr(md5(CAST(o_orderkey AS STRING)), 9, 4), '-', substr(md5(CAST(o_orderkey AS STRING)), 13, 4), '-', substr(md5(CAST(o_orderkey AS STRING)), 17, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 4 END), '-', substr(md5(CAST(o_orderkey AS STRING)), 21, 12)) AS id,
  concat('user.', CAST(o_custkey AS STRING), CASE o_orderkey % 4 WHEN 0 THEN '@mail.example.org' WHEN 1 THEN '@x' WHEN 2 THEN '+tag@a-b.io' ELSE '' END) AS email, repeat('p', CAST(o_orderkey % 140 AS INT)) AS password,
  CASE o_orderkey % 4 WHEN 0 THEN 'Text/Plain; charset=utf-8' WHEN 1 THEN 'application/zip' WHEN 2 THEN 'image/png' ELSE '' END AS mime, o_orderkey * 40009 % 60000000 AS size FROM {orders}"""
UUID = "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
MIMES = ("application/pdf", "text/csv", "text/plain", "text/markdown", "application/json", "image/jpeg", "image/png", "image/webp", "audio/mpeg", "video/mp4", "text/html")


@query(
    "str_validators",
    f"""SELECT k, md5(message) AS message, length(trim(message)) > 0 AND length(message) <= 10000 AS message_ok, regexp_matches(id, '{UUID}') AS id_ok,
regexp_matches(email, '{EMAIL}') AND length(email) <= 320 AS email_ok, length(password) BETWEEN 8 AND 128 AS password_ok,
trim(split_part(lower(mime), ';', 1)) IN ({', '.join(f"'{m}'" for m in MIMES)}) AS mime_ok, size > 0 AND size <= 52428800 AS size_ok FROM ({CHECKS.replace('{orders}', 'orders')})""",
)
def validators(spark, sf_dir):
    c = F.col
    # A message is of up to 10,000 characters: the orders that make them are dealt over tasks first.
    return derived(spark, sf_dir, CHECKS, {"orders": ("o_orderkey", 20_000)}).select(
        "k",
        F.md5("message").alias("message"),
        (~T.is_blank(c("message")) & (F.char_length("message") <= 10000)).alias("message_ok"),
        c("id").rlike(UUID).alias("id_ok"),
        (c("email").rlike(EMAIL) & (F.char_length("email") <= 320)).alias("email_ok"),
        F.char_length("password").between(8, 128).alias("password_ok"),
        F.trim(F.split_part(F.lower("mime"), F.lit(";"), F.lit(1))).isin(*MIMES).alias("mime_ok"),
        ((c("size") > 0) & (c("size") <= 50 * 1024 * 1024)).alias("size_ok"),
    )


TAGGED = "SELECT conv_id, turn, concat(text, CASE WHEN turn % 2 = 0 THEN concat(' [GENERATE_IMAGE: a cat ', CAST(conv_id AS STRING), '] [GENERATE_IMAGE: b]') ELSE ' [FILE_EDIT: x]' END) AS t FROM {conversations}"


@query("str_generate_image_tags", f"SELECT conv_id, turn, array_to_string(regexp_extract_all(t, '\\[GENERATE_IMAGE:\\s*([^\\]]+)\\]', 1), '|') AS prompts FROM ({TAGGED.replace('{conversations}', 'conversations')})")
def image_tags(spark, sf_dir):
    t = spark.sql(TAGGED, conversations=table(spark, sf_dir, "conversations"))
    return t.select("conv_id", "turn", F.array_join(F.regexp_extract_all("t", F.lit(r"\[GENERATE_IMAGE:\s*([^\]]+)\]"), F.lit(1)), "|").alias("prompts"))


@query("str_file_edit_tags", f"SELECT conv_id, turn, contains(t, '[FILE_EDIT:') AS has_edit FROM ({TAGGED.replace('{conversations}', 'conversations')})")
def file_edit_tags(spark, sf_dir):
    return spark.sql(TAGGED, conversations=table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("t").contains("[FILE_EDIT:").alias("has_edit"))


FOUND = f"regexp_extract({DIG.format(f"regexp_replace(s, '{SP}+', '', 'g')")}, '[-+]?[0-9][0-9,]*(\\.[0-9]+)?')"
NUMBER = f"TRY_CAST(replace(nullif({FOUND}, ''), ',', '') AS DOUBLE)"
over("num_coerce", "fragments", T.to_number, NUMBER)


@query("num_key", f"{with_fixtures('fragments')}, n AS (SELECT k, TRY_CAST(regexp_replace(s, '[^0-9.-]', '', 'g') AS DOUBLE) AS value FROM fragments) SELECT k, value, floor(abs(value)) AS magnitude FROM n")
def num_key(spark, sf_dir):
    found = fixture(spark, sf_dir, "fragments").select("k", T.number_key(F.col("s")).alias("value"))
    return found.withColumn("magnitude", F.floor(F.abs("value")).cast("double"))


over("num_canonical", "fragments", T.digits_only, "regexp_replace(s, '[^0-9]', '', 'g')")
over("num_is_numeric_word", "fragments", T.is_numeric_word, "len(regexp_extract_all(s, '[0-9]')) >= 4 AND len(regexp_extract_all(s, '[0-9]')) / length(s) >= 0.6 AND len(regexp_extract_all(s, '[^0-9.,:/-]')) <= 2")
over("num_longest_digit_run", "fragments", T.longest_digit_run, "coalesce(list_reduce(list_filter(regexp_extract_all(s, '[0-9]+'), lambda r: length(r) >= 2), lambda a, r: CASE WHEN length(r) > length(a) THEN r ELSE a END, ''), '')")
CLEANED = f"list_transform(regexp_split_to_array(s, '{SP}+'), lambda t: regexp_replace(t, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))"
over("num_token_most_digits", "fragments", T.token_with_most_digits, f"list_reduce(list_filter({CLEANED}, lambda t: len(regexp_extract_all(t, '[0-9]')) >= 2), lambda a, t: CASE WHEN len(regexp_extract_all(t, '[0-9]')) > len(regexp_extract_all(a, '[0-9]')) THEN t ELSE a END, '')")

STANDALONE = f"{with_fixtures('boxes')}, w AS (SELECT *, lag(text) OVER o AS prev, lead(text) OVER o AS next, count(*) OVER (PARTITION BY doc_id, line_idx) AS n FROM boxes WINDOW o AS (PARTITION BY doc_id, line_idx ORDER BY word_idx))"


@query(
    "num_standalone_token",
    f"{STANDALONE} SELECT doc_id, line_idx, word_idx, length(regexp_replace(text, '[^0-9]', '', 'g')) >= 5 AND length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) >= 0.85 AND coalesce(next IS NULL OR prev = ':' OR next = ':' OR n <= 2, false) AS standalone FROM w",
)
def standalone_token(spark, sf_dir):
    from docloom.operators.numeric import standalone_tokens

    return standalone_tokens(fixture(spark, sf_dir, "boxes"), least_digits=5).select("doc_id", "line_idx", "word_idx", "standalone")


DATED = f"""{with_fixtures('fragments')}, t AS (SELECT k, s, {trim_sql('s')} AS v FROM fragments),
u AS (SELECT k, s, coalesce(nullif(regexp_extract(v, '^([0-9]{{1,4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,4}})\\s+[0-9]{{1,2}}:[0-9]{{2}}', 1), ''), v) AS v FROM t),
p AS (SELECT k, s, v, regexp_extract(v, '^([0-9]{{1,4}})[/-]([0-9]{{1,2}})[/-]([0-9]{{1,4}})$', 1) AS a, regexp_extract(v, '^([0-9]{{1,4}})[/-]([0-9]{{1,2}})[/-]([0-9]{{1,4}})$', 2) AS b, regexp_extract(v, '^([0-9]{{1,4}})[/-]([0-9]{{1,2}})[/-]([0-9]{{1,4}})$', 3) AS c FROM u),
dated AS (SELECT k, s, CASE WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN v WHEN length(a) = 4 THEN a || '-' || lpad(b, 2, '0') || '-' || CASE WHEN length(c) = 1 THEN '0' || c ELSE c END
  WHEN length(c) = 4 THEN c || '-' || lpad(b, 2, '0') || '-' || CASE WHEN length(a) = 1 THEN '0' || a ELSE a END END AS result FROM p)"""


@query("date_coerce", f"{DATED} SELECT k, result FROM dated")
def date_coerce(spark, sf_dir):
    return fixture(spark, sf_dir, "fragments").select("k", T.to_date(F.col("s")).alias("result"))


ORDER_DATES = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%d') AS d, CAST(month(o_orderdate) AS VARCHAR) AS bm, CAST(day(o_orderdate) AS VARCHAR) AS bd FROM orders"
FORMS = [f"{a} || '{sep}' || {b} || '{sep}' || y" for sep in "-/." for a, b in (("d", "m"), ("bd", "bm"))] + ["d || m || y"]


@query("date_variants", f"WITH o AS ({ORDER_DATES}), v AS (SELECT o_orderkey, unnest([{', '.join(FORMS)}]) AS form FROM o) SELECT DISTINCT o_orderkey, form FROM v")
def date_variants(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(T.date_variants(iso)).alias("form"))


@query("date_iso_variants", f"WITH o AS ({ORDER_DATES}) SELECT o_orderkey, replace(iso, '-', '/') || '|' || replace(iso, '-', '.') || '|' || replace(iso, '-', '') AS forms FROM o")
def date_iso_variants(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.iso_variants(F.date_format("o_orderdate", "yyyy-MM-dd")), "|").alias("forms"))


WORDS = lambda x: ", ".join(f"'{w}'" for w in x)
BOOLEAN = f"CASE WHEN lower({trim_sql('s')}) IN ({WORDS(T.TRUE_WORDS)}) THEN true WHEN lower({trim_sql('s')}) IN ({WORDS(T.FALSE_WORDS)}) THEN false END"
over("bool_coerce", "fragments", T.to_boolean, BOOLEAN)
CURRENCIES = ["EGP", "USD", "SAR"]
ENUM = f"CASE WHEN upper({trim_sql('s')}) IN ({WORDS(CURRENCIES)}) THEN upper({trim_sql('s')}) END"
over("enum_coerce", "fragments", lambda s: T.to_enum(s, CURRENCIES), ENUM)


@query(
    "typed_coerce",
    f"""{DATED}, typed AS (SELECT k, CASE k % 5 WHEN 0 THEN 'currency' WHEN 1 THEN 'date' WHEN 2 THEN 'boolean' WHEN 3 THEN 'enum' ELSE 'string' END AS type, s, result FROM dated)
SELECT k, type, CASE WHEN type = 'currency' THEN {NUMBER} END AS number, CASE type WHEN 'date' THEN result WHEN 'enum' THEN {ENUM} WHEN 'string' THEN nullif({trim_sql('s')}, '') END AS string,
CASE WHEN type = 'boolean' THEN {BOOLEAN} END AS flag FROM typed""",
)
def typed_coerce(spark, sf_dir):
    from docloom.operators.coerce import coerce

    kinds = F.array(*(F.lit(x) for x in ("currency", "date", "boolean", "enum", "string")))
    f = fixture(spark, sf_dir, "fragments").withColumn("type", F.get(kinds, (F.col("k") % 5).cast("int")))
    return coerce(f, "s", "type", CURRENCIES).select("k", "type", "number", "string", "flag")


@query("vision_coerce", f"{with_fixtures('fragments')} SELECT k, TRY_CAST(replace(s, ',', '') AS DOUBLE) AS number, CASE lower(s) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag, CASE WHEN TRY_CAST(replace(s, ',', '') AS DOUBLE) IS NULL AND lower(s) NOT IN ('true', 'false') THEN s END AS string FROM fragments")
def vision_coerce(spark, sf_dir):
    number = F.when(F.col("s").rlike(r"^[-+]?[0-9,]*\.?[0-9]+$"), F.replace("s", F.lit(",")).try_cast("double"))
    flag = F.when(F.lower("s") == "true", True).when(F.lower("s") == "false", False)
    return fixture(spark, sf_dir, "fragments").select("k", number.alias("number"), flag.alias("flag"), F.when(number.isNull() & flag.isNull(), F.col("s")).alias("string"))


@query("str_normalize_arabic")
def normalize_arabic(spark, sf_dir):
    from docloom.functions.udf import normalize_arabic as fold

    return fixture(spark, sf_dir, "fragments").select("k", fold(F.col("s")).alias("result"))
