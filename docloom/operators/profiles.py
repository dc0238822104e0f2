"""Profiles as tables: fields, rules and label words by profile, joined to documents by their type. New profiles are rows.

A registry is small (a row for each field, rule or word of each profile, made on the driver), so its tables are broadcast. Documents of
different profiles go through one plan: what differs between them is data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import extraction as E
from docloom.operators.grounding import contains_join
from docloom.sources import dimensions as D
from docloom.sources.cut import cut

FIELDS = "profile string, ord int, key string, type string, label string, grp string, required boolean, cross boolean"
RULES = "profile string, rule int, key string, kind string, required boolean, pattern string, low double, high double, listed boolean"
FALLBACK = "unknown"


def group_of(key: str) -> str | None:
    """Category whose words announce a field: named for it, or by what its key begins and ends with."""
    named = D.GROUP_OF_FIELD.get(key) or D.GROUP_OF_KEY.get(key)
    if named:
        return named
    if key.startswith("mobile") or "phone" in key:
        return "phone"
    if key.endswith("_date") or key == "date":
        return "date"
    return "number" if key.endswith(("_number", "_no")) or key == "number" else None


@dataclass(frozen=True)
class Registry:
    """Enabled profiles by name: (fields, rules), and those whose missing fields are no fault."""

    profiles: dict = field(default_factory=lambda: dict(D.PROFILES))
    lenient: tuple = tuple(D.LENIENT)

    def register(self, name: str, fields: list[tuple], rules: list[tuple], lenient: bool = False) -> Registry:
        """With one profile more, or another of its name."""
        return replace(self, profiles=self.profiles | {name: (fields, rules)}, lenient=(*self.lenient, name) if lenient else tuple(x for x in self.lenient if x != name))

    def without(self, name: str) -> Registry:
        return replace(self, profiles={k: v for k, v in self.profiles.items() if k != name})

    def resolved(self, profile: Column) -> Column:
        """A document's profile; the fallback, which has no fields, if it is none of these."""
        return F.when(profile.isin(*self.profiles), profile).otherwise(FALLBACK)

    def fields(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, k, f[0], f[1], f[2], group_of(f[0]), f[3], f[4]) for p, (fields, _) in self.profiles.items() for k, f in enumerate(fields)], FIELDS)

    def rules(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, k, *r) for p, (_, rules) in self.profiles.items() for k, r in enumerate(rules)], RULES)

    def patterns(self) -> list[str]:
        return sorted({r[3] for _, rules in self.profiles.values() for r in rules if r[3]})


def checked(registry: Registry, docs: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, profile, rule, key, ok, weight, missing) for every rule of each document's profile. docs: doc_id, profile; values: doc_id, key, value."""
    spark = docs.sparkSession
    of = docs.select("doc_id", registry.resolved(F.col("profile")).alias("profile"))
    every = of.join(F.broadcast(registry.rules(spark)), "profile").join(values.select("doc_id", "key", F.nullif(F.trim("value"), F.lit("")).alias("v")), ["doc_id", "key"], "left")
    v, number = F.col("v"), F.col("v").try_cast("double")
    # Patterns are few and known here, so each is a literal that is compiled once.
    fits = F.lit(False)
    for p in registry.patterns():
        fits = F.when(F.col("pattern") == p, v.rlike(p)).otherwise(fits)
    ranged = number.isNotNull() & F.coalesce(number >= F.col("low"), F.lit(True)) & F.coalesce(number <= F.col("high"), F.lit(True))
    test = F.when(F.col("listed"), F.upper(v).isin(*D.CURRENCIES)).when(F.col("pattern").isNotNull(), fits).when(F.col("kind") == "date", v.rlike(r"^\d{4}-\d{2}-\d{2}$")).when(F.col("kind").isin("number", "currency"), ranged).otherwise(True)
    must = F.col("required") & ~F.col("profile").isin(*(registry.lenient or [""]))
    ok = F.when(v.isNull(), ~must).otherwise(F.coalesce(test, F.lit(False)))
    return every.select("doc_id", "profile", "rule", "key", ok.alias("ok"), F.when(must, 1.0).otherwise(0.5).alias("weight"), F.when(v.isNull() & must, F.col("key")).alias("missing"))


def unknown_keys(registry: Registry, docs: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, profile, key): values of keys that the document's profile does not have."""
    of = docs.select("doc_id", registry.resolved(F.col("profile")).alias("profile"))
    known = F.broadcast(registry.fields(docs.sparkSession).select("profile", "key"))
    return of.join(values.select("doc_id", "key"), "doc_id").join(known, ["profile", "key"], "left_anti").select("doc_id", "profile", "key")


def lacking(registry: Registry, docs: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, profile, key, type): required fields without a value."""
    need = registry.fields(docs.sparkSession).filter("required").select("profile", "key", "type")
    have = values.filter(F.trim("value") != "").select("doc_id", "key")
    return docs.select("doc_id", registry.resolved(F.col("profile")).alias("profile")).join(F.broadcast(need), "profile").join(have, ["doc_id", "key"], "left_anti").select("doc_id", "profile", "key", "type")


def recovery(registry: Registry, lines: DataFrame, wanted: DataFrame, tell: bool = False) -> DataFrame:
    """(doc_id, key, line_idx, raw, value, confidence) for wanted fields (doc_id, key, type): what follows a label word of the field on a line. tell: also own, whether that line holds the value as it is.

    Lines meet the fields that their document lacks before anything is looked for: each pair is tested for that field's words only."""
    words = {f[0]: E.label_words(f[2], group_of(f[0]) or "") for fields, _ in registry.profiles.values() for f in fields if f[1] not in ("array", "enum")}
    norm = F.col("norm")
    own = [(F.col("key") == key, E.label_word(norm, ws)) for key, ws in words.items()]
    word = reduce(lambda found, test: found.when(*test), own[1:], F.when(*own[0]))
    met = lines.withColumn("norm", T.normalize(F.col("text"))).hint("merge").join(wanted.select("doc_id", "key", "type"), "doc_id")
    found = met.withColumn("word", word).filter("word IS NOT NULL")
    kind = F.col("type")
    after = F.trim(F.regexp_replace(F.split_part(norm, F.col("word"), F.lit(-1)), r"^[\s:：.\-#]+", ""))
    dates = F.regexp_extract_all("norm", F.lit(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"), F.lit(0))
    numbers = F.regexp_extract_all(after, F.lit(r"[-+]?\d[\d,]*(?:\.\d+)?"), F.lit(0))
    number = kind.isin("number", "currency")
    raw = F.when(kind == "date", F.try_element_at(dates, F.lit(-1))).when(number, F.try_element_at(numbers, F.lit(-1))).otherwise(F.nullif(after, F.lit("")))
    value = F.when(kind == "date", T.to_date(F.regexp_replace("raw", r"\.", "-"))).when(number, F.replace("raw", F.lit(","), F.lit(""))).otherwise(F.col("raw"))
    out = found.withColumn("raw", raw).filter("raw IS NOT NULL").withColumn("value", value).filter("value IS NOT NULL")
    held = [norm.contains(T.normalize(F.col("value"))).alias("own")] if tell else []
    return out.select("doc_id", "key", "line_idx", "raw", "value", F.least(F.lit(0.5), F.coalesce("ocr", F.lit(0.7)) * 0.7).alias("confidence"), *held)


def recovered(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, key, status, value, confidence, alternatives): one distinct value that a line still holds is flagged, several are ambiguous, with all of them.

    Candidates are gone over once. Only values that the line they were read from does not tell to hold (own) are looked for in the others."""
    own = F.bool_or("own") if "own" in candidates.columns else F.lit(False)
    per = candidates.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("value")).alias("alternatives"), F.max("confidence").alias("_c"), own.alias("_own"))
    one = F.size("alternatives") == 1
    value = F.when(one, F.get("alternatives", F.lit(0)))
    decided = cut(per.select("doc_id", "key", F.when(one, "flagged").otherwise("ambiguous").alias("status"), value.alias("value"), F.when(one, F.col("_c")).otherwise(0.0).alias("confidence"), "alternatives", "_own"))
    known = (F.col("status") == "ambiguous") | F.col("_own")
    open_ = decided.filter(~known).withColumn("needle", T.normalize(F.col("value")))
    held = contains_join(open_, lines.select("doc_id", "text"), F.col("nline").contains(F.col("needle"))).select(*decided.columns).dropDuplicates(["doc_id", "key"])
    return decided.filter(known).unionByName(held).drop("_own")
