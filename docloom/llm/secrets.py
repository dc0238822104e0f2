"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of credential characters that hold a digit (numbers, addresses and paths are among them),
values of any kind assigned to a credential's name, passwords in addresses, and private key blocks. Each is
described by its length, its character transitions, how much of it dictionary words cover, the path it comes from
and its neighbouring words, which are hashed. A random forest, trained on a bounded sample of labelled findings,
keeps those whose mean vote reaches THRESHOLD. Scanning is one pass over the text in which the exported trees
vote on all candidates of a slice at once: no shuffle.

Labelled findings: a table (value, before, after, path, label). Where a caller has none, label_findings()
labels candidates of the corpus by rules (label_of: assignments to credential names, vendors' fixed formats,
addresses, plain numbers, dictionary words, announced checksums); made_findings() adds kinds that a corpus may
lack, made by rule. No feature is one of the rules: names, assignments and "@" are not told to the forest. It can
learn them only as far as neighbouring words and the shares of characters show them, so it stands for the rules
on what they leave undecided, not for an independent judgement of them. The dictionary is counted over all
documents, with a pre-aggregated count by word.

Cases: null and empty texts have no findings; texts of any length are scanned whole; an empty or one-sided
sample gives a forest that votes that side; a null path is an empty path; repeated rows have equal findings; an
empty table gives an empty result; columns of docs named like an output (n_candidates, findings, redacted) are
replaced by it, all others stay as they are.
"""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import durable, frugal

#: Labelled findings that training uses at most, chosen by a hash.
LABELLED_ROWS = 20_000
#: Words that are at least one in so many of all documents' words make the dictionary, which is no larger by arithmetic.
DICTIONARY = 20_000
#: Documents with a candidate whose findings may be labelled, chosen by a hash of their id.
SAMPLE_DOCUMENTS = 20_000
TREES = 24
DEPTH = 6
THRESHOLD = 0.5
REDACTED = "[SECRET]"
CONTEXT = 48
#: Texts whose results are held as Python objects at once.
SCAN_ROWS = 256

#: Runs of 16 or more characters of credentials and of what is mistaken for them (numbers, addresses, paths).
candidates_of = re.compile(r"[A-Za-z0-9_+/\-][A-Za-z0-9_+/\-.@]{14,}[A-Za-z0-9_+/\-]={0,2}").finditer
_digit = re.compile(r"\d").search
_word = re.compile(r"[^\W\d_]+")
#: Names under which credentials are assigned (fixed values).
NAMES = re.compile(r"(?i)(token|secret|passw(or)?d|api[_-]?key|access[_-]?key|credential|auth|bearer|private[_-]?key)\w*$")
#: Names that announce checksums and revisions (fixed values).
CHECKSUMS = re.compile(r"(?i)(sha\d*|md5|checksum|digest|commit|revision|etag|uuid|guid)\w*$")
#: Vendors' fixed formats (fixed values).
VENDORS = re.compile(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_(live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20})$")

#: Values assigned to a name, passwords in addresses, private key blocks.
assigned_of = re.compile(r"""[:=]\s*["'`]?([^\s"'`,;<>]{6,})""").finditer
address_of = re.compile(r"://[^\s:/@]+:([^\s@/]{4,})@").finditer
block_of = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+").finditer

#: Buckets of the hashed neighbouring words, on either side.
BUCKETS = 16
FEATURES = (
    "length", "digits", "upper", "lower", "marks", "hex", "entropy", "transitions", "to_digit", "case_changes", "repeats", "longest_class", "covered", "path_depth", "path_test", "quoted", "plain_neighbours",
    *(f"before_{k}" for k in range(BUCKETS)), *(f"after_{k}" for k in range(BUCKETS)),
)


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def describe(value: str, before: str, after: str, path: str, dictionary: frozenset[str]) -> list[float]:
    """The FEATURES of one candidate."""
    n = len(value)
    kinds = [_class(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    steps = list(zip(kinds, kinds[1:], strict=False))
    longest = run = 1
    for a, b in steps:
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    covered = sum(len(w) for w in _word.findall(value) if w.lower() in dictionary)
    sides = _word.findall(before[-CONTEXT:])[-3:], _word.findall(after[:CONTEXT])[:3]
    near = [[0.0] * BUCKETS for _ in sides]
    for bucket, words in zip(near, sides, strict=True):
        for w in words:
            bucket[zlib.crc32(w.lower().encode()) % BUCKETS] = 1.0
    both = sides[0] + sides[1]
    return [
        float(n), share[0], share[2], share[1], share[3],
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        entropy,
        sum(a != b for a, b in steps) / max(1, n - 1),
        sum(b == 0 and a != 0 for a, b in steps) / max(1, n - 1),
        sum({a, b} == {1, 2} for a, b in steps) / max(1, n - 1),
        sum(x == y for x, y in zip(value, value[1:], strict=False)) / max(1, n - 1),
        longest / n,
        covered / n,
        float(path.count("/")),
        float(bool(re.search(r"(?i)test|example|sample|mock|doc", path))),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and before[-1:] != ""),
        sum(w.lower() in dictionary for w in both) / max(1, len(both)),
        *near[0], *near[1],
    ]


def _names(before: str) -> bool:
    return bool(NAMES.search(before[-CONTEXT:].rstrip(" \"'`=:>(")))


def spans(text: str) -> list[tuple[int, int]]:
    """Places of all candidates, in order; of those that overlap the longest, then the first."""
    found = [m.span() for m in candidates_of(text) if _digit(m.group())]
    if ":" in text or "=" in text:
        found += [m.span(1) for m in assigned_of(text) if _names(text[max(0, m.start() - CONTEXT) : m.start()])]
        found += [m.span(1) for m in address_of(text)]
    if "-----BEGIN" in text:
        found += [m.span() for m in block_of(text)]
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(found)):
        if out and start < out[-1][1]:
            if end - start > out[-1][1] - out[-1][0]:
                out[-1] = (start, end)
        else:
            out.append((start, end))
    return out


def scan(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, value, before, after) of every candidate of a text."""
    for start, end in spans(text):
        yield start, end, text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]


def label_of(value: str, before: str, after: str, dictionary: frozenset[str]) -> int | None:
    """1 or 0 where the rules decide, else None."""
    left = before.rstrip(" \"'`=:>(")
    assigned = "=" in before[len(left) :] or ":" in before[len(left) :]
    covered = sum(len(w) for w in _word.findall(value) if w.lower() in dictionary)
    plain = covered * 2 > len(value) and not _digit(value)
    if VENDORS.match(value) or value.startswith("-----BEGIN") or (assigned and not plain and NAMES.search(left)):
        return 1
    if after[:1] == "@" and "://" in before and ":" in before[-2:]:
        return 1
    if plain or "@" in value or "@" in before[-2:] or "@" in after[:2] or CHECKSUMS.search(left):
        return 0
    if covered * 2 > len(value) or sum(c.isdigit() for c in value) * 10 > len(value) * 9:
        return 0
    return 0 if not assigned and value.islower() and not all(c in "0123456789abcdef-" for c in value) else None


def made_findings(n: int = 40) -> list[tuple[str, str, str, str, int]]:
    """n labelled findings of each kind that a corpus may lack, by rule: short and digit-free values, addresses, keys, and what looks like them."""
    rnd = random.Random(11)
    some = lambda chars, least, most: "".join(rnd.choice(chars) for _ in range(rnd.randint(least, most)))
    low, all_ = string.ascii_lowercase, string.ascii_letters + string.digits
    names = ("password", "passwd", "token", "secret", "api_key", "access_key", "auth")
    prose = lambda: " ".join(some(low, 3, 8) for _ in range(3))
    out = []
    for k in range(n):
        name, quote = rnd.choice(names), rnd.choice(("", '"', "'"))
        begin = f"{prose()} {name}{rnd.choice((' = ', '=', ': '))}{quote}"
        out.append((some(low, 5, 8) + some(string.digits, 1, 3) + some(low, 0, 8), begin, f"{quote} {prose()}", "", 1))
        out.append((some(all_ + "&!$%#", 8, 14), begin, f"{quote} {prose()}", "", 1))
        out.append((some(all_, 20, 44), begin, f"{quote} {prose()}", "", 1))
        out.append((some(low, 16, 30), begin, f"{quote} {prose()}", "", 1))
        out.append((some(all_, 6, 14), f"{prose()} {rnd.choice(('postgres', 'https', 'amqp', 'redis'))}://{some(low, 1, 6)}:", f"@{some(low, 2, 8)}/x", "", 1))
        out.append((rnd.choice(("AKIA" + some(string.ascii_uppercase + string.digits, 16, 16), "ghp_" + some(all_, 36, 36))), f"{prose()} ", f" {prose()}", "", 1))
        out.append(("-----BEGIN PRIVATE KEY-----\n" + some(all_ + "+/", 200, 400), f"{prose()}\n", "-----END PRIVATE KEY-----", "", 1))
        out.append((f"{some(low, 4, 9)}.{k}@{some(low, 3, 6)}.example.com", f"{prose()} ", f" {prose()}", "", 0))
        out.append((f"{some(low, 4, 8)}/{some(low, 4, 8)}/{some(low, 3, 6)}-{k}", f"{prose()} ", f" {prose()}", "", 0))
        out.append((".".join(str(rnd.randrange(256)) for _ in range(4)), f"{prose()} ", f" {prose()}", "", 0))
        out.append((some(string.digits, 16, 18), f"{prose()} ", f" {prose()}", "", 0))
        out.append((f"{2000 + k}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}T{rnd.randint(10, 23)}-{rnd.randint(10, 59)}", f"{prose()} ", f" {prose()}", "", 0))
        out.append((some("0123456789abcdef", 40, 40), f"{prose()} {rnd.choice(('commit', 'sha', 'digest', 'checksum'))} ", f" {prose()}", "", 0))
    return out


@dataclass(frozen=True)
class Forest:
    """Exported trees: for each node feature, threshold, children, and the probability of label 1 at its leaves."""

    trees: tuple[tuple[np.ndarray, ...], ...]
    dictionary: frozenset[str]
    rate: float

    def vote(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.rate)
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at], left[at], right[at])
                at = np.where(f < 0, at, go)
            total += value[at]
        return total / len(self.trees)


FINDING = "array<struct<value:string,before:string,after:string,label:int>>"


def label_findings(docs: DataFrame, dictionary: frozenset[str], text: str = "text", path: str = "source") -> DataFrame:
    """(value, before, after, path, label) for the candidates that are certain on their own."""

    @F.arrow_udf(FINDING)
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([*((n, pa.string()) for n in ("value", "before", "after")), ("label", pa.int32())]))
        for batch in batches:
            out = []
            for x in batch:
                found = [(v, b, a, label_of(v, b, a, dictionary)) for _, _, v, b, a in scan(x.as_py() or "")]
                out.append([{"value": v, "before": b, "after": a, "label": k} for v, b, a, k in found if k is not None])
            yield pa.array(out, type=kind)

    return docs.select(F.explode(run(F.col(text))).alias("f"), F.coalesce(path, F.lit("")).alias("path")).select("f.*", "path").distinct()


def dictionary_of(docs: DataFrame, text: str = "text", share: int = DICTIONARY) -> frozenset[str]:
    """The words of four letters or more that are at least one in `share` of all such words of all documents. Collected: at most `share` words."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("w")).filter(F.length("w") >= 4)
    counts = durable(words.groupBy("w").agg(F.count("*").alias("n")), "secret-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.w for r in counts.filter(F.col("n") * share >= F.lit(total)).select("w").collect())


def train(findings: DataFrame, dictionary: frozenset[str], most_rows: int = LABELLED_ROWS) -> Forest:
    """Forest over at most most_rows labelled findings (value, before, after, path, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    fields = StructType([StructField(n, DoubleType()) for n in FEATURES])

    @F.arrow_udf(fields)
    def features(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [describe(*(x.as_py() for x in row), dictionary) for row in zip(*batch, strict=True)]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], type=pa.float64()) for k in range(len(FEATURES))], names=list(FEATURES))

    chosen = findings.orderBy(F.xxhash64("value", "before", "after"), "value").limit(most_rows)
    rows = durable(chosen.select(F.col("label").cast("double").alias("label"), features(*(F.col(c) for c in ("value", "before", "after", "path"))).alias("f")).select("label", "f.*"), "secret-findings")
    known = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(known) < 2:
        return Forest((), dictionary, next(iter(known), 0.0))
    weighted = rows.withColumn("weight", F.when(F.col("label") == 1.0, 0.5 / known[1.0]).otherwise(0.5 / known[0.0]) * sum(known.values()))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(weighted)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, weightCol="weight", featureSubsetStrategy="sqrt", minInstancesPerNode=2).fit(table)
    return Forest(tuple(_export(t) for t in model.trees), dictionary, known[1.0] / sum(known.values()))


def _export(tree) -> tuple[np.ndarray, ...]:
    feature, threshold, left, right, value = [], [], [], [], []

    def visit(node) -> int:
        at = len(feature)
        for x, first in ((feature, -1), (threshold, 0.0), (left, at), (right, at), (value, 0.0)):
            x.append(first)
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            value[at] = stats[1] / max(sum(stats), 1e-12)
        else:
            split = node.split()
            feature[at], threshold[at] = split.featureIndex(), split.threshold()
            left[at], right[at] = visit(node.leftChild()), visit(node.rightChild())
        return at

    visit(tree._call_java("rootNode"))
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


SCAN = "struct<n_candidates:int,findings:array<struct<start:int,end:int,vote:double>>,redacted:string>"


def scan_texts(text: Column, path: Column, forest: Forest, threshold: float = THRESHOLD) -> Column:
    """Number of candidates, kept findings (code points) and the text with each finding replaced."""

    @F.arrow_udf(SCAN)
    @frugal
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        finding = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("vote", pa.float64())])
        kind = pa.struct([("n_candidates", pa.int32()), ("findings", pa.list_(finding)), ("redacted", pa.string())])
        for texts, paths in batches:
            parts = [pa.array([], type=kind)]
            for at in range(0, len(texts), SCAN_ROWS):
                out = []
                for cell, where in zip(texts[at : at + SCAN_ROWS], paths[at : at + SCAN_ROWS], strict=True):
                    text = cell.as_py()
                    found = list(scan(text or ""))
                    kept = []
                    if found:
                        votes = forest.vote(np.array([describe(v, b, a, where.as_py() or "", forest.dictionary) for _, _, v, b, a in found]))
                        kept = [{"start": s, "end": e, "vote": float(p)} for (s, e, *_), p in zip(found, votes, strict=True) if p >= threshold]
                    clean = text
                    for k in reversed(kept):
                        clean = clean[: k["start"]] + REDACTED + clean[k["end"] :]
                    out.append({"n_candidates": len(found), "findings": kept, "redacted": clean})
                parts.append(pa.array(out, type=kind))
            yield pa.concat_arrays(parts)

    return run(text, path)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", most_documents: int = SAMPLE_DOCUMENTS) -> Forest:
    """A dictionary of all documents, and a forest from labelled findings: the rules' labels in a bounded sample of
    the documents that have a candidate (those with the smallest hashes of their key), and the made ones."""
    order = F.xxhash64(key)
    body = F.col(text)
    likely = docs.filter((body.rlike(r"[A-Za-z0-9_+/\-]{16,}") & body.rlike(r"\d")) | body.rlike(r"(?i)(token|secret|passw|key|credential|auth|bearer)\w*[\"'` ]{0,3}[:=]") | body.contains("://"))
    # Only the hashes are ordered; the texts of the sample never meet in one task.
    last = likely.select(order.alias("o")).orderBy("o").limit(most_documents).agg(F.max("o")).first()[0]
    chosen = likely.filter(order <= F.lit(last).cast("long")).select(body.alias("text"), F.col(path).alias("source"))
    dictionary = dictionary_of(docs, text)
    found = label_findings(durable(chosen, "secret-sample"), dictionary)
    made = docs.sparkSession.createDataFrame(made_findings(), "value string, before string, after string, path string, label int")
    return train(found.unionByName(made), dictionary)


def secrets(docs: DataFrame, forest: Forest, text: str = "text", path: str = "source") -> DataFrame:
    """docs with n_candidates, findings and redacted (the text without them)."""
    names = ("n_candidates", "findings", "redacted")
    held = docs.select(F.struct(*(F.col(c) for c in docs.columns if c not in names)).alias("row"), scan_texts(F.col(text), F.col(path), forest).alias("scan"))
    return held.select("row.*", *(F.col(f"scan.{n}").alias(n) for n in names))
