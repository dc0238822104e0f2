"""Texts that hold given quotes: candidate pairs of ids meet on a hash of words inside the quote, the exact test follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a key, and characters of a key inside one word and on either side of a space: the largest that a quote has room for.
WORDS, INSIDE, BESIDE = (1, 3, 5), (1, 2, 4, 6), (1, 2, 4)
#: Most distinct quotes whose ids and hashes (16 bytes each) are sent to the texts; more meet them in a shuffle.
BROADCAST_QUOTES = 200_000


def fold(s: Column) -> Column:
    """Lower case, single spaces, no white space at the ends."""
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def _quote_keys(q: DataFrame) -> DataFrame:
    """q (_q) with the way in which it is keyed (words, or characters before and after a space) and its key."""
    w = F.split("_q", " ")
    fit = lambda n, sizes: F.coalesce(*(F.when(n >= k, k) for k in reversed(sizes)), F.lit(0))
    inner = F.when(F.size(w) > 2, fit(F.size(w) - 2, WORDS)).otherwise(F.size(w) - 2)
    before, after, inside = fit(F.char_length(w[0]), BESIDE), fit(F.char_length(F.get(w, F.lit(1))), BESIDE), fit(F.char_length("_q"), INSIDE)
    way = F.when(inner >= 1, F.struct(F.lit("words").alias("kind"), inner.alias("a"), F.lit(0).alias("b"))).when(inner == 0, F.struct(F.lit("pair").alias("kind"), before.alias("a"), after.alias("b"))).otherwise(F.struct(F.lit("part").alias("kind"), inside.alias("a"), F.lit(0).alias("b")))
    pair = F.concat(F.right(w[0], before), F.lit(" "), F.left(F.get(w, F.lit(1)), after))
    key = F.when(inner >= 1, F.array_join(F.slice(w, F.lit(2), F.greatest(inner, F.lit(1))), " ")).when(inner == 0, pair).otherwise(F.left("_q", inside))
    return q.withColumns({"_way": way, "_key": key})


def _text_keys(t: Column, kind: str, a: int, b: int) -> Column:
    """All keys of one way in a folded text. Patterns look ahead from every place, so a text costs its length, however long its words are."""
    if kind == "words":
        # The cut text is an element, not an expression: it is made once and not for every run.
        runs = lambda words: F.transform(F.sequence(F.lit(1), F.size(words) - a + 1), lambda k: F.array_join(F.slice(words, k, a), " "))
        return F.array_distinct(F.transform(F.array(F.split(t, " ")), lambda words: F.when(F.size(words) >= a, runs(words)))[0])
    pattern = rf"(?=(\S{{{a}}} \S{{{b}}}))" if kind == "pair" else rf"(?=(\S{{{a}}}))"
    return F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))


def holding(texts: DataFrame, quotes: DataFrame, text: str = "text", quote: str = "quote", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of texts joined with the rows of quotes whose folded quote the folded text holds, each pair once.

    Only the first and the last word of a quote may lie inside a longer word of the text. A quote of three words or more is keyed by its inner
    words, one of two by the characters around its space, one of one word by its first characters, which lie inside a word of the text. Texts are keyed in
    the ways that some quote needs (at most 16, a row each on the driver), as pairs of id and hash; only ids meet, and then the texts and quotes of the pairs.
    Empty quotes are in no text; rows of texts are told apart by keys (all columns but the text, if none are named); without a value in one of them they take no part."""
    keys = keys or tuple(c for c in texts.columns if c != text)
    q = _quote_keys(quotes.withColumn("_q", fold(F.col(quote))).filter("_q <> ''").withColumn("_id", F.xxhash64("_q")))
    hashed = lambda kind, a, b: lambda k: F.xxhash64(F.lit(kind), F.lit(a), F.lit(b), k)
    found = q.groupBy("_way").agg(F.count_distinct("_id").alias("n")).collect()
    ways = sorted(tuple(r["_way"]) for r in found)
    own = F.xxhash64(F.col("_way.kind"), F.col("_way.a"), F.col("_way.b"), F.col("_key")).alias("_hash")
    wanted = q.select("_id", own).distinct()
    if sum(r.n for r in found) <= BROADCAST_QUOTES:
        wanted = F.broadcast(wanted)
    t = texts.dropna(subset=list(keys)).withColumn("_t", fold(F.col(text)))
    made = [F.coalesce(F.transform(_text_keys(F.col("_t"), *way), hashed(*way)), F.array().cast("array<long>")) for way in ways]
    keyed = t.select(*keys, F.explode(F.flatten(F.array(*made))).alias("_hash")) if ways else t.select(*keys, F.lit(0).cast("long").alias("_hash")).limit(0)
    pairs = keyed.join(wanted, "_hash").select(*keys, "_id").distinct()
    # A folded quote is tested once, however many rows have it.
    met = pairs.join(t, list(keys)).join(q.select("_id", "_q").distinct(), "_id").filter(F.col("_t").contains(F.col("_q"))).drop("_id", "_t")
    return met.join(q.select(*quotes.columns, "_q"), "_q").drop("_q")
