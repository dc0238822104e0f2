"""Repair of Arabic OCR over tables of words: letters that belong together, doubled letters, glued scripts, stray edges, reading order.

Words keep their boxes and confidence throughout. Runs of words (islands) and line edges are windows within a line, so a page of any
number of lines is dealt by line; nothing but whole words moves, and every change is a row of a log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.functions.udf import normalize_arabic
from docloom.operators.quality import line_quality

# Letter ranges, confidence of doubled glyphs, runs that are always doubled, letters of a stray edge at most.
ARABIC = r"\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}"
LATIN = r"A-Za-z\x{c0}-\x{24f}"
MARKS = r"[\x{64b}-\x{65f}\x{670}]"
DOUBLED_CONF, DOUBLED_RUN, STRAY_LETTERS = 0.8, 4, 4

LINE = ["doc_id", "line_idx"]
WORD = [*LINE, "word_idx", "text", "conf", "x", "y", "width", "height"]
CUT = "\x1f"


def arabic_letters(s: Column) -> Column:
    return T.count(s, f"[{ARABIC}]")


def latin_letters(s: Column) -> Column:
    return T.count(s, f"[{LATIN}]")


def _texts(order: str = "word_idx") -> Column:
    """The words of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda w: w["text"]), " ")


def joined(words: DataFrame) -> DataFrame:
    """Runs of two or more single Arabic letters as one word: least confidence, enclosing box."""
    at = Window.partitionBy(*LINE).orderBy("word_idx")
    single = F.regexp_replace("text", MARKS, "").rlike(f"^[{ARABIC}]$")
    w = words.withColumn("_one", single)
    w = w.withColumn("_run", F.when(F.col("_one") & F.coalesce(F.lag("_one").over(at), F.lit(False)), 0).otherwise(1))
    w = w.withColumn("_run", F.sum("_run").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    b = G.Box()
    out = w.groupBy(*LINE, "_run").agg(
        F.min("word_idx").alias("word_idx"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda p: p["text"]), "").alias("text"),
        F.min("conf").alias("conf"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(b.right).alias("_r"), F.max(b.bottom).alias("_b"),
    )
    return out.withColumns({"width": F.col("_r") - F.col("x"), "height": F.col("_b") - F.col("y")}).select(*WORD)


def undoubled(text: Column, conf: Column) -> Column:
    """Runs of an Arabic letter as one: of DOUBLED_RUN or more always, of three where the reader was unsure."""
    always = rf"([\x{{621}}-\x{{64a}}])\1{{{DOUBLED_RUN - 1},}}"
    unsure = r"([\x{621}-\x{64a}])\1{2,}"
    return F.when(F.coalesce(conf, F.lit(1.0)) < DOUBLED_CONF, F.regexp_replace(text, unsure, "$1")).otherwise(F.regexp_replace(text, always, "$1"))


def parted(text: Column) -> Column:
    """Pieces of a word between scripts, and between letters and digits where the word is long enough to be two."""
    scripts = rf"(?<=[{ARABIC}])(?=[A-Za-z])|(?<=[A-Za-z])(?=[{ARABIC}])"
    numbers = rf"(?<=[{ARABIC}A-Za-z])(?=[0-9])|(?<=[0-9])(?=[{ARABIC}A-Za-z])"
    arabic, latin = arabic_letters(text), T.count(text, "[A-Za-z]")
    long_ = (F.char_length(text) >= 4) & (((arabic >= 3) & (latin == 0)) | (latin >= 5))
    return F.split(F.when(long_, F.regexp_replace(text, f"{scripts}|{numbers}", CUT)).otherwise(F.regexp_replace(text, scripts, CUT)), CUT)


def edges(words: DataFrame) -> DataFrame:
    """words with part: 0 for the line itself, 1 and 2 for a stray run of the other script at its start and end."""
    line = Window.partitionBy(*LINE)
    at = line.orderBy("word_idx")
    w = words.withColumns({"_ar": arabic_letters(F.col("text")), "_la": latin_letters(F.col("text")), "_n": F.count("*").over(line)})
    w = w.withColumns({"_ars": F.sum("_ar").over(line), "_las": F.sum("_la").over(line)})
    rtl = F.col("_ars") >= F.col("_las")
    other, own = F.when(rtl, F.col("_la")).otherwise(F.col("_ar")), F.when(rtl, F.col("_ar")).otherwise(F.col("_la"))
    stray = ~F.col("text").rlike("[0-9]") & (((F.col("_ar") == 0) & (F.col("_la") == 0)) | ((other > 0) & (own == 0)))
    w = w.withColumns({"_other": other, "_stray": stray.cast("int")})
    w = w.withColumn("_lead", F.min("_stray").over(at.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    w = w.withColumn("_trail", ~F.col("_lead") & (F.min("_stray").over(at.rowsBetween(0, Window.unboundedFollowing)) == 1))
    most = F.greatest("_ars", "_las")
    letters = lambda run: F.sum(F.when(F.col(run), F.col("_other")).otherwise(0)).over(line)
    fits = lambda run: letters(run).between(1, STRAY_LETTERS) & (most >= letters(run))
    both = (F.col("_n") >= 2) & (F.col("_ars") > 0) & (F.col("_las") > 0)
    w = w.withColumn("part", F.when(both & F.col("_lead") & fits("_lead"), 1).when(both & F.col("_trail") & fits("_trail"), 2).otherwise(0))
    # A line is never left empty.
    w = w.withColumn("part", F.when(F.min("part").over(line) > 0, 0).otherwise(F.col("part")))
    return w.select(*WORD, "part")


def _lines(words: DataFrame, name: str) -> DataFrame:
    return words.groupBy(*LINE).agg(_texts().alias(name))


def repaired(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words with part, log) of words (doc_id, line_idx, word_idx, text, conf, box).

    log: doc_id, line_idx, step, pos, kind, original, repaired: what was changed, in order."""
    plain = words.withColumn("text", normalize_arabic(F.col("text"))).select(*WORD)
    one = joined(plain)
    two = one.withColumn("_t", undoubled(F.col("text"), F.col("conf")))
    once = two.withColumn("text", F.col("_t")).select(*WORD)
    pieces = once.select(*WORD[:3], F.posexplode(parted(F.col("text"))).alias("_k", "text"), *WORD[4:])
    place = F.row_number().over(Window.partitionBy(*LINE).orderBy("word_idx", "_k")) - 1
    split = pieces.withColumn("_w", place).select(*LINE, F.col("_w").cast("int").alias("word_idx"), *WORD[3:])
    out = edges(split)

    told = lambda df, step, kind: df.select(*LINE, F.lit(step).alias("step"), "pos", F.lit(kind).alias("kind"), "original", "repaired")
    change = lambda a, b, step, kind: told(_lines(a, "original").join(_lines(b, "repaired"), LINE).filter("original <> repaired").withColumn("pos", F.lit(0)), step, kind)
    doubled = two.filter("text <> _t").select(*LINE, F.col("word_idx").alias("pos"), F.col("text").alias("original"), F.col("_t").alias("repaired"))
    main = out.groupBy(*LINE).agg(_texts().alias("original"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == 0, F.struct("word_idx", "text")))), lambda w: w["text"]), " ").alias("repaired"))
    moved = out.filter("part > 0").select(*LINE, F.col("part").alias("pos")).distinct().join(main, LINE)
    log = change(plain, one, 1, "join-isolated-letters").unionByName(told(doubled, 2, "collapse-duplicated-letters")).unionByName(change(once, split, 3, "insert-boundary-spaces")).unionByName(told(moved, 4, "detach-edge-fragment"))
    return out, log


def reordered(words: DataFrame, keys: list[str]) -> DataFrame:
    """words with place: a right-to-left line whose words stand in the order of x is turned round; any other stays. Words without a box leave their line as it is."""
    line = Window.partitionBy(*keys)
    at = line.orderBy("word_idx")
    w = words.withColumns({"_prev": F.lag("x").over(at), "_k": F.row_number().over(at), "_n": F.count("*").over(line)})
    w = w.withColumns({"_ar": F.sum(arabic_letters(F.col("text"))).over(line), "_la": F.sum(latin_letters(F.col("text"))).over(line), "_boxed": F.count("x").over(line), "_bad": F.sum(F.coalesce((F.col("x") < F.col("_prev")).cast("int"), F.lit(0))).over(line)})
    turn = (F.col("_n") >= 2) & (F.col("_boxed") == F.col("_n")) & (F.col("_ar") > 0) & (F.col("_ar") >= F.col("_la")) & (F.col("_bad") == 0)
    return w.withColumn("place", F.when(turn, F.col("_n") - F.col("_k")).otherwise(F.col("_k") - 1).cast("int")).drop("_prev", "_k", "_n", "_ar", "_la", "_boxed", "_bad")


def post_processed(lines: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, log) after the repair: doc_id, line_idx (anew), source_line, text, original, repaired, conf, box, and the quality of each line.

    lines: doc_id, line_idx, text, conf and a box, which are kept where a line's words have none. Stray edges follow their line as lines of their own."""
    out, log = repaired(words)
    keys = [*LINE, "part"]
    w = reordered(out.withColumn("text", T.unify_digits(F.col("text"))), keys)
    b = G.Box()
    made = w.groupBy(*keys).agg(_texts("place").alias("made"), F.avg("conf").alias("_conf"), F.min("x").alias("_x"), F.min("y").alias("_y"), F.max(b.right).alias("_r"), F.max(b.bottom).alias("_b"))
    of = lines.select(*LINE, F.col("text").alias("original"), "conf", "x", "y", "width", "height")
    m = made.join(of, LINE)
    boxed = F.col("_x").isNotNull()
    m = m.select(
        "doc_id", F.col("line_idx").alias("source_line"), "part", F.col("made").alias("text"), "original", (F.col("made") != F.col("original")).alias("repaired"), F.coalesce("_conf", "conf").alias("conf"),
        F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"), F.when(boxed, F.col("_r") - F.col("_x")).otherwise(F.col("width")).alias("width"), F.when(boxed, F.col("_b") - F.col("_y")).otherwise(F.col("height")).alias("height"),
    )
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("source_line", "part")) - 1
    return line_quality(m.withColumn("line_idx", number.cast("int")).drop("part"), "conf"), log
