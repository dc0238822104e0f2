"""The rescue pass: which regions of a weak page are read again, and what of the second reading is taken.

Pages are lines and words; a second reader's texts are an input table by page and region (models stay outside).
Everything goes page by page in joins and windows keyed by doc_id; what depends on what was taken before
(a value is not put in twice, at most MOST_INSERTED a region) is one fold over a page's few steps, in native expressions.

Deviation: lines are known by their identity, so lines put in earlier don't shift what a later region refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.operators.anchors import anchored
from docloom.operators.grounding import label_group
from docloom.operators.ocr import USED, number_status, verify
from docloom.sources.cut import cut

# Milliseconds, counts, confidences, shares of a row, px.
LEAST_BUDGET, REGION_COST = 4000, 5200
MOST_REGIONS, MOST_INSERTED, MOST_CANDIDATES = 6, 8, 6
LEAST_CONF, DIGIT_LINE_CONF, WEAK_LINE, LONG_DIGITS = 0.85, 0.6, 0.93, 8
COVERED, SAME_ROW, SAME_LINE, PAIR_GAP = 0.5, 0.8, 16, 48
FEW_LINES, FEW_NUMBERS = 5, 3
FOUR_DIGITS = r"(?:[0-9][^0-9]*){4}"
#: Boxes of a reading that are folded as one array.
SMALL = 512
VERIFY_BUDGET, DOUBT, AGREED_CONF = 2000, 0.6, 0.5
REFERENCE = r"المرجع|مرجعي|مرجقي|ref"
TRANSACTION = r"المعامله|عمليه|عملية|transaction"
#: Words of a page that ask for an amount.
AMOUNT_WORDS = [r"total|جملة", r"cash|نقداً|نقدي", r"change|باقي"]
KIND_OF_GROUP = {"date": "date", "total": "amount", "pos": "account", "buyer": "customer"}

BOX = ("x", "y", "width", "height")
PAGE = "doc_id"


def digits(s: Column) -> Column:
    return T.count(s, "[0-9]")


def digit_token(s: Column) -> Column:
    """The token of the most digits, two or more; the first of equals; null if there is none."""
    counted = F.transform(F.split(s, r"\s+"), lambda t: F.struct(t.alias("t"), digits(t).alias("n")))
    best = F.aggregate(counted, F.struct(F.lit(None).cast("string").alias("t"), F.lit(1).alias("n")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    return best["t"]


def kind_of_label(group: Column, line: Column, phone: bool = False) -> Column:
    """Kind of number that a line's label announces; null if none."""
    plain = F.lower(T.strip_bidi(line))
    number = F.when(plain.rlike(REFERENCE), "reference").when(plain.rlike(TRANSACTION), "transaction").otherwise("number")
    known = F.create_map(*(F.lit(x) for pair in KIND_OF_GROUP.items() for x in pair))[group]
    return F.when(group == "number", number).when((group == "phone") & F.lit(phone), "number").otherwise(known)


def kind_of_value(s: Column) -> Column:
    bare = F.regexp_replace(s, r"\s+", "")
    amount = bare.rlike(r"^\d{1,9}([.,]\d{1,2})?$") | bare.rlike(r"^\d{1,3}([.,]\d{3})+([.,]\d{1,2})?$")
    return F.when(bare.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$"), "date").when(amount, "amount").otherwise("number")


def row_overlap(a: G.Box, b: G.Box) -> Column:
    """Shared height over the smaller height."""
    least = F.least(a.height, b.height)
    return G.overlap_y(a, b) / F.when(least == 0, 1.0).otherwise(least)


def words_in(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda t: t != "")


def center(prefix: str = "") -> Column:
    return F.col(f"{prefix}y") + F.col(f"{prefix}height") / 2


def has_box(prefix: str = "") -> Column:
    return F.col(f"{prefix}x").isNotNull() & F.col(f"{prefix}y").isNotNull()


# --- What is wrong with a page ------------------------------------------------------------------------------------


def worded(lines: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """lines with words: array of (word_idx, text, conf, box) in order. Without a table of words, each gets its share of the line's box by characters without spaces.

    A line's own words are made where the line is: nothing is dealt or sorted for them."""
    if words is not None:
        held = words.groupBy(PAGE, "line_idx").agg(F.sort_array(F.collect_list(F.struct("word_idx", "text", F.col("conf").cast("double").alias("conf"), *BOX))).alias("words"))
        return lines.join(held, [PAGE, "line_idx"], "left")
    start = F.struct(F.array().cast("array<struct<w:string,before:int>>").alias("ws"), F.lit(0).alias("n"))
    step = lambda a, w: F.struct(F.array_append(a["ws"], F.struct(w.alias("w"), a["n"].alias("before"))).alias("ws"), (a["n"] + F.char_length(w)).alias("n"))

    def placed(a: Column) -> Column:
        return F.transform(a["ws"], lambda w, k: F.struct(
            k.alias("word_idx"), w["w"].alias("text"), F.col("conf").cast("double").alias("conf"), (F.col("x") + w["before"] / a["n"] * F.col("width")).alias("x"), F.col("y").alias("y"),
            (F.char_length(w["w"]) / a["n"] * F.col("width")).alias("width"), F.col("height").alias("height")))

    return lines.withColumn("words", F.aggregate(words_in(F.col("text")), start, step, placed))


def total(values: Column) -> Column:
    """Sum of an array's numbers that are known; null if none is."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v))


def marked(lines: DataFrame, words: DataFrame | None = None, most: int = MOST_CANDIDATES) -> DataFrame:
    """lines with numbers (its numeric words), mean (confidence of its words; null where these are shares of a line of less than four digits), group (category of its label) and found: its numeric candidates (place, kind, line_idx, word_idx, members, text, conf, others_sum, others_n, box), of a page's the first `most`.

    A line whose label announces a kind gives its numeric words as one candidate; any other line gives its standalone long numbers.
    lines: doc_id, line_idx, text; words: doc_id, line_idx, word_idx, text, conf and a box, which every numeric word of a line needs; None: the lines' own (worded()).
    members: the word_idx of its words; others_sum and others_n: sum and number of the confidences of its line's other words.
    All of a line's is found in its array of words; a page's lines meet once, in the running number of candidates."""
    ws = F.col("words")
    numeric = F.filter(F.transform(ws, lambda w, k: F.struct(w.alias("w"), F.get(ws, k - 1)["text"].alias("prev"), F.get(ws, k + 1)["text"].alias("next"))), lambda s: T.is_numeric_word(s["w"]["text"]))
    confs = lambda array: F.transform(array, lambda w: w["conf"])
    known = lambda array: F.size(F.filter(array, lambda w: w["conf"].isNotNull())).cast("long")
    read = worded(lines, words)
    if words is None:  # A numeric word has four digits: lines with fewer have none, and their words are not made.
        read = read.withColumn("words", F.when(F.col("text").rlike(FOUR_DIGITS), F.col("words")))
    read = read.withColumn("_numeric", numeric).withColumns({"numbers": F.coalesce(F.array_size("_numeric"), F.lit(0)), "mean": total(confs(ws)) / known(ws), "group": label_group(F.col("text"))})
    kind = F.when(F.col("numbers") > 0, kind_of_label(F.col("group"), F.col("text")))
    read = read.withColumns({"_kind": kind, "_boxed": F.coalesce(F.forall("_numeric", lambda s: s["w"]["x"].isNotNull() & s["w"]["y"].isNotNull()), F.lit(True))})
    own = F.transform("_numeric", lambda s: s["w"])

    def candidate(kind: Column, word_idx: Column, members: Column, text: Column, conf: Column, others_sum: Column, others_n: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
        of = {"kind": kind, "line_idx": F.col("line_idx"), "word_idx": word_idx, "members": members, "text": text, "conf": conf, "others_sum": others_sum, "others_n": others_n, "x": x, "y": y, "width": width, "height": height}
        return F.struct(*(c.alias(n) for n, c in of.items()))

    each = lambda f: F.transform(own, f)
    x, y = F.array_min(each(lambda w: w["x"])), F.array_min(each(lambda w: w["y"]))
    right, bottom = F.array_max(each(lambda w: w["x"] + w["width"])), F.array_max(each(lambda w: w["y"] + w["height"]))
    one = candidate(F.col("_kind"), F.get(own, F.lit(0))["word_idx"], each(lambda w: w["word_idx"]), F.array_join(each(lambda w: w["text"]), " "), total(confs(own)) / known(own), total(confs(ws)) - total(confs(own)), known(ws) - known(own), x, y, right - x, bottom - y)

    def stands(s: Column) -> Column:
        w, n = s["w"], digits(s["w"]["text"])
        alone = (n >= LONG_DIGITS) & (n / F.char_length(w["text"]) >= 0.85) & (T.count(w["text"], "[^0-9.,:/-]") <= 3)
        beside = (w["word_idx"] == F.get(ws, F.size(ws) - 1)["word_idx"]) | F.coalesce(s["prev"] == ":", F.lit(False)) | F.coalesce(s["next"] == ":", F.lit(False)) | (F.size(ws) <= 2)
        return alone & beside

    free = F.transform(F.filter("_numeric", stands), lambda s: candidate(F.lit("number"), s["w"]["word_idx"], F.array(s["w"]["word_idx"]), s["w"]["text"], s["w"]["conf"], total(confs(ws)) - F.coalesce(s["w"]["conf"], F.lit(0.0)), known(ws) - s["w"]["conf"].isNotNull().cast("long"), s["w"]["x"], s["w"]["y"], s["w"]["width"], s["w"]["height"]))
    found = F.when((F.col("numbers") == 0) | ~F.col("_boxed"), None).when(F.col("_kind").isNotNull(), F.array(one)).otherwise(free)
    before = Window.partitionBy(PAGE).orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    read = read.withColumn("_found", found).drop("words", "_numeric", "_kind", "_boxed")
    read = read.withColumn("_before", F.coalesce(F.sum(F.coalesce(F.array_size("_found"), F.lit(0))).over(before), F.lit(0)))
    first = F.slice("_found", 1, F.greatest(F.lit(0), F.lit(most) - F.col("_before")).cast("int"))
    fields = ["kind", "line_idx", "word_idx", "members", "text", "conf", "others_sum", "others_n", *BOX]
    return read.withColumn("found", F.transform(first, lambda c, k: F.struct((F.col("_before") + k + 1).cast("int").alias("place"), *(c[n].alias(n) for n in fields)))).drop("_found", "_before")


CANDIDATE = (PAGE, "kind", "line_idx", "word_idx", "members", "text", "conf", "others_sum", "others_n", *BOX, "place")


def candidates_of(read: DataFrame) -> DataFrame:
    """The candidates of marked() lines, a row each."""
    return read.select(PAGE, F.explode_outer("found").alias("_c")).filter("_c IS NOT NULL").select(PAGE, "_c.*").select(*CANDIDATE)


def detected(lines: DataFrame, words: DataFrame | None = None, most: int = MOST_CANDIDATES) -> DataFrame:
    """Numeric candidates of pages, a row each, the first `most` of a page: those of marked()."""
    return candidates_of(marked(lines, words, most))


def is_digit_line() -> Column:
    """Whether a marked() line is weak and has a long, well-formed number: a suspect of misread digits."""
    # The cheap tests come first; only what passes them is cut into tokens, once: what several tests read goes through one-element arrays.
    weak = has_box() & (F.coalesce("mean", "conf", F.lit(1.0)) < WEAK_LINE) & F.col("text").rlike(FOUR_DIGITS) & (digits(F.col("text")) >= LONG_DIGITS)
    long = F.filter(F.array(digit_token(F.col("text"))), lambda t: digits(t) >= LONG_DIGITS)
    bare = F.transform(long, lambda t: F.regexp_replace(t, "^[^0-9]+|[^0-9]+$", ""))
    valid = F.exists(F.transform(bare, lambda b: F.struct(kind_of_value(b).alias("kind"), b.alias("b"))), lambda x: number_status(x["kind"], x["b"]) == "valid")
    return F.when(weak, valid).otherwise(False)


def is_label_line() -> Column:
    """Whether a marked() line has words and a label but no number."""
    return F.coalesce(has_box() & (F.col("numbers") == 0) & F.col("text").rlike(r"\S") & F.col("group").isNotNull(), F.lit(False))


def _paged(read: DataFrame) -> DataFrame:
    """marked() lines with severe and missing of their page, which windows over the page tell."""
    page = Window.partitionBy(PAGE)
    read = read.withColumn("_lower", F.lower("text"))
    read = read.withColumns({f"_asks{k}": F.col("_lower").rlike(p).cast("int") for k, p in enumerate(AMOUNT_WORDS)}).drop("_lower")
    asked = [F.max(f"_asks{k}").over(page) for k in range(len(AMOUNT_WORDS))]
    amount = F.max(F.coalesce(F.exists("found", lambda c: c["kind"] == "amount"), F.lit(False))).over(page)
    severe = (F.count("*").over(page) <= FEW_LINES) | (F.sum("numbers").over(page) < FEW_NUMBERS)
    return read.withColumns({"severe": severe, "missing": F.when(amount, 0).otherwise(sum(asked[1:], asked[0]))})


def evidence(read: DataFrame) -> DataFrame:
    """(doc_id, severe, missing) of marked() lines: whether a page has too few lines or numbers, and how many amounts its words ask for in vain."""
    asked = [F.max(F.lower("text").rlike(p).cast("int")) for p in AMOUNT_WORDS]
    amount = F.bool_or(F.coalesce(F.exists("found", lambda c: c["kind"] == "amount"), F.lit(False)))
    per = read.groupBy(PAGE).agg(F.count("*").alias("_lines"), F.sum("numbers").alias("_numbers"), amount.alias("_amount"), sum(asked[1:], asked[0]).alias("_asked"))
    return per.select(PAGE, ((F.col("_lines") <= FEW_LINES) | (F.col("_numbers") < FEW_NUMBERS)).alias("severe"), F.when(F.col("_amount"), 0).otherwise(F.col("_asked")).alias("missing"))


ASKED = "array<struct<rank:struct<cls:int,n:int>,kind:string,label:string,wants:string,line_idx:int,place:int,x:double,y:double,width:double,height:double>>"


def triggers(read: DataFrame) -> DataFrame:
    """Regions of marked() lines that ask to be read again, in order of their rank: (doc_id, rank, kind, label, wants, line_idx, place, box).

    Every line tells its own; a page's first line tells the page's, so that lines are gone over once."""
    nothing = F.lit(None)

    def region(cls: int, n: Column, kind: str, label: Column, wants: Column = nothing, line_idx: Column = nothing, place: Column = nothing, box: tuple = (nothing,) * 4) -> Column:
        return F.struct(F.struct(F.lit(cls).alias("cls"), n.cast("int").alias("n")).alias("rank"), F.lit(kind).alias("kind"), label.cast("string").alias("label"), wants.cast("string").alias("wants"), line_idx.cast("int").alias("line_idx"), place.cast("int").alias("place"), *(v.cast("double").alias(c) for c, v in zip(BOX, box, strict=True)))

    line, own = F.col("line_idx"), tuple(F.col(c) for c in BOX)
    some = lambda test, array: F.when(test, array).otherwise(F.array().cast(ASKED))
    head = F.col("_head") == 1
    problems = F.filter("found", lambda c: number_status(c["kind"], c["text"]) != "valid")
    parts = [
        some(head & F.col("severe"), F.array(region(0, F.lit(0), "full_page", nothing))),
        some(F.col("_digits"), F.array(region(1, line, "digit_line", F.col("text"), line_idx=line, box=own))),
        some(F.array_size("found") > 0, F.transform(problems, lambda c: region(2, c["place"], "candidate", c["text"], c["kind"], c["line_idx"], c["place"], tuple(c[n] for n in BOX)))),
        some(F.col("_label"), F.array(region(3, line, "label", F.col("text"), line_idx=line, box=own))),
        some(head & (F.col("missing") > 0), F.transform(F.sequence(F.lit(1), "missing"), lambda k: region(4, k, "missing_field", F.lit("missing_amount"), F.lit("amount")))),
    ]
    read = _paged(read).withColumn("_head", F.row_number().over(Window.partitionBy(PAGE).orderBy("line_idx")))
    # A plain explode() is planned with a filter on the array's size, which makes all regions twice more; an outer one makes them once.
    asked = read.withColumns({"_digits": is_digit_line(), "_label": is_label_line()}).select(PAGE, F.concat(*parts).alias("_asked"))
    return asked.select(PAGE, F.explode_outer("_asked").alias("_a")).filter("_a IS NOT NULL").select(PAGE, "_a.*")


def planned(asked: DataFrame, most: int = MOST_REGIONS) -> DataFrame:
    """asked with region (its place in the plan, null if it has none) and covered_by (the region that covers half its rows or more).

    Greedy by rank: the first open region is taken, and open candidates and labels that it covers go; `most` rounds, each one window
    over rows that stay dealt by page. What is open after the last round has neither."""
    page = Window.partitionBy(PAGE)
    out = asked.withColumns({"region": F.lit(None).cast("int"), "covered_by": F.lit(None).cast("int")})
    for k in range(1, most + 1):
        free = F.col("region").isNull() & F.col("covered_by").isNull()
        out = out.withColumn("_top", F.min(F.when(free, F.struct("rank", *BOX))).over(page))
        taken = free & (F.col("rank") == F.col("_top.rank"))
        mine, top = G.Box(), G.Box("_top.")
        hides = free & ~taken & F.col("kind").isin("candidate", "label") & has_box("_top.") & (row_overlap(mine, top) >= COVERED)
        out = out.withColumns({"region": F.when(taken, k).otherwise(F.col("region")), "covered_by": F.when(F.coalesce(hides, F.lit(False)), k).otherwise(F.col("covered_by"))}).drop("_top")
    return out


def verification(candidates: DataFrame, reads: DataFrame, budget: int = VERIFY_BUDGET) -> DataFrame:
    """candidates with reason, value and agreed: what a second look at the doubtful ones decides, while the time lasts.

    A valid one that is read well is left as it is (reason null). Once what was spent exceeds the budget, all that follow are skipped (budget_exhausted).
    reads: doc_id, place, read, read_conf, again, again_conf, cost; nothing read is no row or a null."""
    status = number_status(F.col("kind"), F.col("text"))
    doubtful = ~((status == "valid") & (F.col("conf").isNull() | (F.col("conf") >= DOUBT)))
    before = Window.partitionBy(PAGE).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    c = candidates.join(reads, [PAGE, "place"], "left").withColumns({"_status": status, "_doubt": doubtful})
    c = c.withColumn("_spent", F.coalesce(F.sum(F.when(F.col("_doubt"), F.coalesce("cost", F.lit(0))).otherwise(0)).over(before), F.lit(0)))
    decided_ = verify(F.col("text"), F.col("conf"), F.col("_status"), F.col("read"), F.col("read_conf"), number_status(F.col("kind"), F.col("read")))
    reason = F.when(F.col("_spent") > budget, "budget_exhausted").when(F.col("_doubt"), decided_)
    c = c.withColumn("reason", reason)
    value = F.when(F.col("reason").isin(*USED), F.col("read")).otherwise(F.col("text"))
    agreed = F.col("reason").isNotNull() & (F.col("reason") != "budget_exhausted") & F.coalesce((F.col("again_conf") >= AGREED_CONF) & (T.digits_only(F.col("read")) == T.digits_only(F.col("again"))), F.lit(False))
    return c.withColumns({"value": value, "agreed": agreed}).drop("_status", "_doubt", "_spent", "read", "read_conf", "again", "again_conf", "cost")


# --- What a second reading offers ---------------------------------------------------------------------------------


def by_size(items: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """items of groups of at most `most` rows, and those of larger groups; None if no group is larger, which one count tells."""
    large = items.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*keys)
    if large.isEmpty():
        return items, None
    large = cut(large)
    return items.join(large, keys, "left_anti"), items.join(large, keys, "left_semi")


def bucketed(items: DataFrame, keys: list[str], most: int = SMALL) -> DataFrame:
    """Boxes of a reading with bucket (place of its first one by centre) and row (reading order): a visual line is all within SAME_LINE of its first centre.

    items: keys, item, x, y, width, height. Boxes of a visual line are ordered by x, whatever order they were read in.
    A reading of at most `most` boxes is one array that is folded where it lies; larger ones find their starts by windows and pointers (anchored())."""
    columns = items.columns
    rest = [c for c in columns if c not in keys]
    few, many = by_size(items, keys, most)
    held = few.withColumn("_at", center().cast("double")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "x", "item", F.struct(*rest).alias("r")))).alias("_items"))
    start = F.struct(F.array().cast("array<int>").alias("firsts"), F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("first"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        opens = F.coalesce(s["_at"] - a["anchor"] > SAME_LINE, F.lit(True))
        first = F.when(opens, a["n"] + 1).otherwise(a["first"])
        return F.struct(F.array_append(a["firsts"], first).alias("firsts"), F.when(opens, s["_at"]).otherwise(a["anchor"]).alias("anchor"), first.alias("first"), (a["n"] + 1).alias("n"))

    firsts = F.aggregate("_items", start, step, lambda a: a["firsts"])
    ordered = F.transform(F.array(firsts), lambda f: F.sort_array(F.transform("_items", lambda s, k: F.struct(f[k].alias("_first"), s["x"].alias("x"), k.alias("_row"), s["r"].alias("r")))))[0]
    small = held.select(*keys, F.posexplode(ordered).alias("_pos", "_s")).select(*keys, *(F.col(f"_s.r.{c}").alias(c) for c in rest), F.col("_s._first").alias("bucket"), (F.col("_pos") + 1).alias("row"))

    small = small.select(*columns, "bucket", "row")
    if many is None:
        return small
    out = anchored(many, keys, center(), SAME_LINE, [F.col("x"), F.col("item")])
    order = Window.partitionBy(*keys).orderBy("_first", "x", "_row")
    large = out.withColumn("bucket", F.col("_first")).withColumn("row", F.row_number().over(order))
    return small.unionByName(large.select(*columns, "bucket", "row"))


def paired(items: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered boxes (bucketed()) with outcome: label, candidate, value_without_label or pair_not_adjacent, and value, kind, merged text and confidence.

    A line without a number becomes the open label; a labelled number stands for itself and closes it; another number takes the open label
    if it is beside or just below it. So rows since the last label or labelled number are a segment, all numbers of a segment are tested against
    its label, and the first that is adjacent takes it: those before are apart, those after have none."""
    at = Window.partitionBy(*keys).orderBy("row")
    e = items.withColumns({"value": digit_token(F.col("text")), "group": label_group(F.col("text"))})
    resets = F.col("value").isNull() | F.col("group").isNotNull()
    e = e.withColumn("_seg", F.sum(resets.cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    seg = Window.partitionBy(*keys, "_seg").orderBy("row")
    open_ = F.first(F.when(F.col("value").isNull(), F.struct("text", "confidence", *BOX))).over(seg.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    e = e.withColumn("_l", open_)
    beside = F.abs(center() - center("_l.")) <= SAME_LINE
    gap = F.col("y") - (F.col("_l.y") + F.col("_l.height"))
    plain = F.col("value").isNotNull() & F.col("group").isNull()
    near = plain & F.col("_l").isNotNull() & (beside | (gap >= 0)) & (gap <= PAIR_GAP)
    e = e.withColumn("_near", F.coalesce(near, F.lit(False)))
    e = e.withColumn("_taken", F.min(F.when(F.col("_near"), F.col("row"))).over(Window.partitionBy(*keys, "_seg")))
    held = F.col("_l").isNotNull() & (F.col("_taken").isNull() | (F.col("row") <= F.col("_taken")))
    outcome = F.when(F.col("value").isNull(), "label").when(F.col("group").isNotNull(), "candidate").when(~held, "value_without_label").when(F.col("_near"), "candidate").otherwise("pair_not_adjacent")
    kind = F.coalesce(kind_of_label(F.col("group"), F.col("text"), phone=True), kind_of_value(F.col("value")))
    e = e.withColumns({"outcome": outcome, "kind": kind})
    with_label = F.col("group").isNull() & F.col("outcome").isin("candidate", "pair_not_adjacent")
    merged = {"text": F.when(with_label, F.concat_ws(" ", "_l.text", "text")).otherwise(F.col("text")), "confidence": F.when(with_label, F.least("_l.confidence", "confidence")).otherwise(F.col("confidence"))}
    return e.withColumns(merged).drop("_seg", "_l", "_near", "_taken", "group")


def conflicting(offers: DataFrame, candidates: DataFrame) -> DataFrame:
    """offers (doc_id, kind, value, box) with conflict: a valid first reading of the kind says something else on the same row. At most MOST_CANDIDATES meet a page's offers."""
    valid = candidates.filter(number_status(F.col("kind"), F.col("text")) == "valid")
    held = valid.groupBy(PAGE).agg(F.collect_list(F.struct("kind", T.digits_only(F.col("text")).alias("digits"), *BOX)).alias("_held"))
    mine = T.digits_only(F.col("value"))
    shared = lambda c: F.greatest(F.lit(0.0), F.least(F.col("y") + F.col("height"), c["y"] + c["height"]) - F.greatest(F.col("y"), c["y"]))
    least = lambda c: F.least(F.col("height"), c["height"])
    same_row = lambda c: shared(c) / F.when(least(c) == 0, 1.0).otherwise(least(c)) >= SAME_ROW
    clash = F.exists("_held", lambda c: (c["kind"] == F.col("kind")) & (c["digits"] != mine) & same_row(c))
    return offers.join(held, PAGE, "left").withColumn("conflict", F.coalesce(clash, F.lit(False))).drop("_held")


# --- What is taken of it ------------------------------------------------------------------------------------------


def executed(plan: DataFrame, latencies: DataFrame, budgets: DataFrame) -> DataFrame:
    """Regions of the plan that the budget lets run: before each of them REGION_COST must be left. latencies: doc_id, region, latency; budgets: doc_id, budget."""
    before = Window.partitionBy(PAGE).orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    p = plan.filter("region is not null").join(latencies, [PAGE, "region"], "left").join(budgets, PAGE)
    p = p.withColumn("_spent", F.coalesce(F.sum(F.coalesce("latency", F.lit(0))).over(before), F.lit(0)))
    return p.filter(F.col("budget") - F.col("_spent") >= REGION_COST).drop("_spent", "latency", "budget")


def steps(lines: DataFrame, candidates: DataFrame, regions: DataFrame, readings: DataFrame) -> DataFrame:
    """What each region of a page tries, in order: (doc_id, region, kind, seq, action, line_idx, value, text, confidence, conf, box, first, last, counted).

    action: insert, replace or none; first and last: reasons against it that rank before and after the test of what is already present;
    text and conf: of the line it makes; counted: whether MOST_INSERTED holds for it.
    readings: doc_id, region, item, text, confidence, x, y, width, height."""
    met = regions.select(PAGE, "region", F.col("kind").alias("region_kind"), "label", "wants", "line_idx", "place", *(F.col(c).alias(f"r_{c}") for c in BOX))
    columns = [PAGE, "region", F.col("region_kind").alias("kind"), "seq", "action", "line_idx", "value", "text", "confidence", "conf", *BOX, "first", "last", "counted"]
    nothing = F.lit(None).cast("string")

    # Regions that look for one number: the text of the most digits, the first of equals.
    single = met.filter(F.col("region_kind").isin("candidate", "digit_line"))
    picks = readings.groupBy(PAGE, "region").agg(F.max_by(F.struct("text", "confidence"), F.struct(digits(F.col("text")), -F.col("item"))).alias("pick"))
    s = single.join(picks, [PAGE, "region"], "left").select("*", F.col("pick.text").alias("read"), F.col("pick.confidence").alias("confidence"))
    s = s.join(lines.select(PAGE, "line_idx", F.col("text").alias("line")), [PAGE, "line_idx"], "left")
    s = s.join(candidates.select(PAGE, "place", "members", "others_sum", "others_n"), [PAGE, "place"], "left")
    s = conflicting(s.withColumns({c: F.col(f"r_{c}") for c in BOX} | {"kind": F.col("wants"), "value": F.col("read")}), candidates)
    original = digit_token(F.col("line"))
    run = T.longest_digit_run(F.col("read"))
    token = F.coalesce(F.nullif(run, F.lit("")), digit_token(F.col("read")), F.col("read"))
    line_kind = F.coalesce(kind_of_label(label_group(F.col("label")), F.col("label"), phone=True), kind_of_value(original))
    weak = lambda least: F.col("confidence") < least
    as_candidate = F.when(F.col("read").isNull(), "no_numeric").when(weak(LEAST_CONF), "low_conf").when(number_status(F.col("kind"), F.col("read")) != "valid", "invalid").when(F.col("conflict"), "conflict_with_valid_primary")
    as_line = (
        F.when(original.isNull(), "line_not_found").when(F.col("read").isNull(), "no_numeric").when(weak(DIGIT_LINE_CONF), "low_conf").when(digits(token) < digits(original), "shorter")
        .when(T.digits_only(token) == T.digits_only(original), "unchanged").when(number_status(line_kind, token) != "valid", "invalid")
    )
    is_line = F.col("region_kind") == "digit_line"
    reason = F.when(is_line, as_line).otherwise(as_candidate)
    # A candidate's first word becomes the reading, its other words go.
    put = lambda w, k: F.when(k == F.col("members")[0], F.col("read")).when(~F.array_contains("members", k), w)
    at = F.position(original, F.col("line"))
    once = F.concat(F.left("line", at - 1), token, F.substr("line", at + F.char_length(original)))
    fresh = F.when(is_line, once).otherwise(F.array_join(F.array_compact(F.transform(words_in(F.col("line")), put)), " "))
    conf = F.when(is_line, F.col("confidence")).otherwise((F.coalesce("others_sum", F.lit(0.0)) + F.col("confidence")) / (F.col("others_n") + 1))
    told = F.coalesce("read", F.when(is_line, F.coalesce(original, "label")).otherwise(F.col("label")))
    s = s.withColumns({"seq": F.lit(0), "action": F.when(reason.isNull(), "replace").otherwise("none"), "first": reason, "last": nothing, "text": F.when(reason.isNull(), fresh), "conf": conf, "counted": F.lit(False), "value": told}).select(*columns)

    # Regions that look for lines: pairs of a label and a value.
    open_ = met.filter(F.col("region_kind").isin("full_page", "label", "missing_field"))
    items = readings.filter(has_box() & (F.col("confidence") > 0)).join(open_.select(PAGE, "region", "region_kind", "wants"), [PAGE, "region"])
    p = paired(bucketed(items, [PAGE, "region"]), [PAGE, "region"]).filter("outcome <> 'label'")
    other = (F.col("region_kind") == "missing_field") & (F.col("kind") != F.col("wants"))
    refused = F.col("outcome") != "candidate"
    reason = F.when(refused, F.col("outcome")).when(other, "kind_mismatch").when(weak(LEAST_CONF), "low_conf").when(number_status(F.col("kind"), F.col("value")) != "valid", "invalid")
    p = conflicting(p, candidates)
    # Refused pairs are told before any candidate is tried.
    seq = F.row_number().over(Window.partitionBy(PAGE, "region").orderBy(refused.desc(), "row"))
    p = p.withColumns({"seq": seq, "action": F.when(reason.isNull(), "insert").otherwise("none"), "first": reason, "last": F.when(F.col("conflict"), "conflict_with_valid_primary"), "value": F.when(refused, F.col("text")).otherwise(F.col("value")), "line_idx": F.lit(None).cast("int"), "conf": F.col("confidence"), "counted": ~refused})
    return s.unionByName(p.select(*columns))


def decided(lines: DataFrame, tried: DataFrame) -> DataFrame:
    """tried with verdict: accepted, the first reason against it, or null where its region was full before it.

    A page's steps are folded in order over the digits of its lines in reading order, with what was put in between."""
    mid = F.when(has_box(), center())
    page = lines.groupBy(PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", mid.alias("c"), T.digits_only(F.col("text")).alias("d")))), lambda l: F.struct(l["line_idx"].cast("int").alias("k"), l["c"].cast("double").alias("c"), l["d"].alias("d"))).alias("_lines"))
    step = F.struct("region", "seq", "action", "first", "last", "counted", F.col("line_idx").cast("int").alias("k"), center().cast("double").alias("c"), T.digits_only(F.col("text")).alias("all"), T.digits_only(F.col("value")).alias("own"))
    todo = tried.groupBy(PAGE).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    verdicts = F.array().cast("array<struct<region:int,seq:int,verdict:string>>")
    start = F.struct(F.col("_lines").alias("lines"), verdicts.alias("told"), F.lit(0).alias("region"), F.lit(0).alias("n"))

    def one(a: Column, s: Column) -> Column:
        n = F.when(a["region"] == s["region"], a["n"]).otherwise(0)
        full = s["counted"] & (n >= MOST_INSERTED)
        present = F.array_join(F.transform(a["lines"], lambda l: l["d"]), "").contains(s["own"])
        verdict = F.when(full, None).when(s["first"].isNotNull(), s["first"]).when((s["action"] == "insert") & present, "value_already_present").when((s["action"] == "insert") & s["last"].isNotNull(), s["last"]).otherwise("accepted")
        yes = F.coalesce(verdict == "accepted", F.lit(False))
        beyond = F.array_position(F.transform(a["lines"], lambda l: F.coalesce(l["c"] > s["c"], F.lit(False))), True).cast("int")
        before = F.when(beyond > 0, beyond - 1).otherwise(F.size(a["lines"]))
        new = F.array(F.struct(F.lit(-1).alias("k"), s["c"].alias("c"), s["all"].alias("d")))
        put = F.concat(F.slice(a["lines"], F.lit(1), before), new, F.slice(a["lines"], before + 1, F.size(a["lines"])))
        swapped = F.transform(a["lines"], lambda l: F.when(l["k"] == s["k"], F.struct(l["k"].alias("k"), l["c"].alias("c"), s["all"].alias("d"))).otherwise(l))
        lines_ = F.when(yes & (s["action"] == "insert"), put).when(yes & (s["action"] == "replace"), swapped).otherwise(a["lines"])
        row = F.struct(s["region"].alias("region"), s["seq"].alias("seq"), verdict.alias("verdict"))
        return F.struct(lines_.alias("lines"), F.array_append(a["told"], row).alias("told"), s["region"].alias("region"), (n + (yes & (s["action"] == "insert")).cast("int")).alias("n"))

    told = todo.join(page, PAGE).select(PAGE, F.explode(F.aggregate("_steps", start, one, lambda a: a["told"])).alias("t")).select(PAGE, "t.*")
    return tried.join(told, [PAGE, "region", "seq"])


def inserted(lines: DataFrame, additions: DataFrame) -> DataFrame:
    """lines with the additions (doc_id, ord, text, conf, box) put in by centre: all of lines' columns, line_idx numbered anew, was (the old line_idx, null for additions) and ord.

    An addition goes before the first line whose centre lies below its own, or to the end. The largest centre so far never falls,
    so the number of lines before that one is a count over a running maximum, and additions of one place follow by centre."""
    at = Window.partitionBy(PAGE).orderBy("line_idx").rowsBetween(Window.unboundedPreceding, 0)
    low = F.lit(float("-inf"))
    mid = F.when(has_box(), center()).otherwise(low)
    old = lines.withColumns({"_level": F.max(mid).over(at), "_place": F.row_number().over(Window.partitionBy(PAGE).orderBy("line_idx")), "was": F.col("line_idx"), "ord": F.lit(None).cast("int"), "_new": F.lit(0)})
    new = additions.withColumns({"_level": center().cast("double"), "_place": F.lit(None).cast("int"), "was": F.lit(None).cast("int"), "_new": F.lit(1)})
    both = old.drop("line_idx").unionByName(new, allowMissingColumns=True)
    upto = Window.partitionBy(PAGE).orderBy("_level", "_new").rowsBetween(Window.unboundedPreceding, 0)
    slot = F.when(F.col("_new") == 0, F.col("_place")).otherwise(F.count("_place").over(upto) + 1)
    both = both.withColumn("_slot", slot)
    order = Window.partitionBy(PAGE).orderBy("_slot", F.desc("_new"), "_level", "ord")
    return both.withColumn("line_idx", (F.row_number().over(order) - 1).cast("int")).drop("_level", "_place", "_slot", "_new")


def shared_words(lines: DataFrame) -> DataFrame:
    """(doc_id, line_idx, word_idx, text, conf, box) of lines: each word gets its share of the line's box by characters without spaces."""
    return worded(lines).select(PAGE, "line_idx", F.explode("words").alias("_w")).select(PAGE, "line_idx", "_w.*")


def moved(references: DataFrame, merged: DataFrame) -> DataFrame:
    """references (doc_id, line_idx, ...) to lines as inserted() has numbered them anew."""
    of = merged.filter("was is not null").select(PAGE, F.col("was").alias("line_idx"), F.col("line_idx").alias("_now"))
    return references.join(of, [PAGE, "line_idx"]).withColumn("line_idx", F.col("_now")).drop("_now")


def rescued(lines: DataFrame, words: DataFrame | None, readings: DataFrame, budgets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, record, pages) of the pass.

    log: every step with its verdict. record: doc_id, skipped, regions, attempts, accepted. pages: lines after it (doc_id, line_idx, text, conf, box, was).
    budgets: doc_id, budget (ms), recall (whether the page's text was found lacking). readings: as of steps(), with latency (ms) of their region."""
    # Each part is written once: several later ones read it.
    read = cut(marked(lines, words))
    candidates = candidates_of(read)
    asked = cut(triggers(read))
    per = asked.groupBy(PAGE).agg(F.count_if(F.col("kind") != "missing_field").alias("_problems"), F.max(F.when(F.col("kind") == "digit_line", True)).alias("_digits"))
    gate = budgets.join(per, PAGE, "left")
    early = F.when(F.col("budget") < LEAST_BUDGET, "budget_too_small").when(~F.col("recall") & F.col("_digits").isNull(), "recall_not_detected").when(F.coalesce("_problems", F.lit(0)) == 0, "no_numeric_problem")
    gate = cut(gate.select(PAGE, "budget", early.alias("skipped")))
    plan = cut(planned(asked.join(gate.filter("skipped is null").select(PAGE), PAGE, "left_semi")).filter("region is not null"))
    latencies = readings.groupBy(PAGE, "region").agg(F.max("latency").alias("latency"))
    ran = cut(executed(plan, latencies, budgets.select(PAGE, "budget")))
    log = cut(decided(lines, cut(steps(lines, candidates, ran, readings))).filter("verdict is not null"))
    tried = ran.groupBy(PAGE).agg(F.count("*").alias("attempts"))
    taken = log.groupBy(PAGE).agg(F.count_if(F.col("verdict") == "accepted").alias("accepted"))
    wanted = plan.groupBy(PAGE).agg(F.count("*").alias("regions"))
    record = gate.join(wanted, PAGE, "left").join(tried, PAGE, "left").join(taken, PAGE, "left").fillna(0, ["regions", "attempts", "accepted"])
    record = record.select(PAGE, F.coalesce("skipped", F.when(F.col("attempts") == 0, "budget_exhausted")).alias("skipped"), "regions", "attempts", "accepted")
    yes = log.filter("verdict = 'accepted'")
    swaps = yes.filter("action = 'replace'").select(PAGE, "line_idx", F.col("text").alias("_text"), F.col("conf").alias("_conf"))
    fresh = lines.join(swaps, [PAGE, "line_idx"], "left").withColumns({"text": F.coalesce("_text", "text"), "conf": F.coalesce("_conf", "conf")}).drop("_text", "_conf")
    additions = yes.filter("action = 'insert'").select(PAGE, (F.col("region") * 1000 + F.col("seq")).alias("ord"), "text", "conf", *BOX)
    return log, record, inserted(fresh.select(PAGE, "line_idx", "text", "conf", *BOX), additions)
