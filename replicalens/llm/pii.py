"""Personal data: fixed patterns, and contexts learned from what they find.

``base_spans`` finds e-mail and IP addresses, card and phone numbers by the contract's patterns. ``discovered`` boots
from them: the string of every found span is a seed; the words beside it (one before, two before, one behind, both
sides) are lexical patterns for its kind. Other tokens that look roughly like an identifier are instances that are not
yet known, and so are longest runs of tokens of digits and separators with single spaces between them. In ROUNDS
rounds Spark scores the graph of patterns and instances: a pattern's confidence in a kind is the mean confidence of all different strings it touches, seeds of that kind counting 1, those of another 0; an instance's
is the noisy-or over its patterns that have at least SUPPORT different seeds and a confidence of CONFIDENT or more.
Instances that end at CONFIDENT are new spans wherever they stand. Strings are counted once, so copies of a document
support nothing. Patterns and instances stay in tables; nothing of them is collected.

A word ends at white space and where a span of the fixed patterns begins or ends, however long it is. All scanning takes
time in proportion to the text's length.

Spans are code points, end exclusive. Defined cases: a null text counts as empty and has no spans; the counts and the
digest are those of the fixed patterns, ``spans`` also lists what was discovered; rows that repeat doc_id and text have
the same spans; unbroken texts of any length are searched whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: These two also match what only begins like theirs (no group 1), so that a long run is not tried from each of its places.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)?")
IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
ROUNDS, SUPPORT, CONFIDENT = 3, 5, 0.8
MARKS, GAP, TOKEN = re.compile(r"[@0-9]"), re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")
#: A token with fewer digits, and no @, is no identifier.
DIGITS = 5
EDGE = " \t\n\v\f\r.,;:!?\"'()[]{}<>"
_DIGITS = r"[0-9]+(?:[().-]{1,2}[0-9]+){0,18}\)?"
#: Starts and ends where tokens do, but for what EDGE strips; "+" or "(" before it are added where it is found.
#: No identifier has more than 19 digits; the limit keeps the search linear.
RUN = re.compile(rf"[0-9](?<![^{re.escape(EDGE)}+][0-9])(?:{_DIGITS}|(?:[().-]{{1,2}}[0-9]+){{0,18}}\)?)(?:\x20\(?{_DIGITS})+(?=[{re.escape(EDGE.strip())}]*(?:[\x20\x09-\x0D]|\Z))")


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    found = []
    if not text:
        return found
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text) if m[1]]
    for m in IP.finditer(text) if "." in text else ():
        if m[1] and all(len(x) <= 3 and int(x or 0) <= 255 for x in (x.lstrip("0") for x in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def looks_like(token: str) -> int | None:
    """The kind that an unmatched token could be, by its characters."""
    digits, token = len(NOT_DIGIT.sub("", token)), token.replace(" ", "-")
    if "@" in token:
        return 0 if re.fullmatch(r"[^@]+@[^@]+", token) else None
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", token):
        return 1
    if re.fullmatch(r"[0-9][0-9-]*[0-9]", token) and 13 <= digits <= 19:
        return 2
    if re.fullmatch(r"\+?[0-9(][0-9().-]*[0-9]", token) and 7 <= digits <= 12:
        return 3
    return None


def runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of the longest runs of digits that hold single spaces."""
    found = []
    for m in RUN.finditer(text):
        run = m[0].rstrip(")")
        start = m.start()
        if run.count(")") > run.count("(") and text[max(0, start - 1) : start] == "(":
            start -= 1
        if text[max(0, start - 1) : start] == "+":
            start -= 1
        found.append((start, m.start() + len(run)))
    return found


def marked_tokens(text: str):
    """(start, end) of the tokens with an @ or at least DIGITS digits."""
    at = 0
    while m := MARKS.search(text, at):
        # Only up to where the last token ended: what is between is looked at once.
        start = max(at, *(text.rfind(c, at, m.start()) + 1 for c in EDGE[:6]))
        gap = GAP.search(text, m.end())
        end = gap.start() if gap else len(text)
        token = text[start:end]
        if "@" in token or len(NOT_DIGIT.sub("", token)) >= DIGITS:
            yield start, end
        at = end


class Contexts:
    """The lexical patterns around places of a text: words beside them, as far as the nearest span of base."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.text, self.tokens = text, [m.span() for m in TOKEN.finditer(text)]
        self.starts, self.ends = [s for s, _ in self.tokens], [e for _, e in self.tokens]
        self.span_starts, self.span_ends = sorted(s for s, _, _ in base), sorted(e for _, _, e in base)
        self.reach = list(accumulate((e for _, _, e in base), max))  # base is sorted by start

    def meets_base(self, start: int, end: int) -> bool:
        n = bisect_left(self.span_starts, end)
        return n > 0 and self.reach[n - 1] > start

    def __call__(self, start: int, end: int) -> list[str]:
        low, high = bisect_right(self.span_ends, start), bisect_left(self.span_starts, end)
        low, high = self.span_ends[low - 1] if low else 0, self.span_starts[high] if high < len(self.span_starts) else len(self.text)

        def word(i: int, low: int, high: int) -> str:
            a, b = (max(self.starts[i], low), min(self.ends[i], high)) if 0 <= i < len(self.tokens) else (0, 0)
            return self.text[a:b].strip(EDGE).lower() if a < b else ""

        before = bisect_left(self.starts, start) - 1
        left, farther, right = word(before, low, start), word(before - 1, low, start), word(bisect_right(self.ends, end), end, high)
        out = []
        if left:
            out.append(f"l:{left}")
            if farther:
                out.append(f"ll:{farther} {left}")
        if right:
            out.append(f"r:{right}")
            if left:
                out.append(f"lr:{left} {right}")
        return out


def instances(text: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool, str, list[str]]]:
    """(start, kind, end, whether a seed, the string itself, patterns) of the base spans and of other tokens and runs that look like identifiers."""
    text = text or ""
    other = []
    for a, b in marked_tokens(text):
        token = text[a:b].strip(EDGE)
        if token:
            a += len(text[a:b]) - len(text[a:b].lstrip(EDGE))
            other.append((a, a + len(token)))
    other = [(a, kind, b) for a, b in [*other, *runs(text)] if (kind := looks_like(text[a:b])) is not None]
    if not base and not other:
        return []
    around = Contexts(text, base)
    out = [(s, k, e, True, text[s:e], around(s, e)) for s, k, e in base]
    return out + [(s, k, e, False, text[s:e], around(s, e)) for s, k, e in other if not around.meets_base(s, e)]


def _span_type():
    return pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


SPANS = "array<struct<start:int,kind:int,end:int>>"
FOUND = "array<struct<start:int,kind:int,end:int,seed:boolean,value:string,patterns:array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, __pii_key (of doc_id and text), base spans and instances for each row of docs(doc_id, text)."""

    def find(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))
        for batch in batches:
            spans, found = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                found.append([dict(zip(("start", "kind", "end", "seed", "value", "patterns"), x, strict=True)) for x in instances(text, base)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__pii_key"), pa.array(spans, _span_type()), pa.array(found, kind)], names=["doc_id", "__pii_key", "base", "found"])

    common.small_batches(docs.sparkSession)
    return keyed(docs.select("doc_id", "text")).mapInArrow(find, f"doc_id long, __pii_key string, base {SPANS}, found {FOUND}")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __pii_key, which rows of equal doc_id and text share."""
    return docs.withColumn("__pii_key", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit(""))), 256))


def discovered(scanned: DataFrame, folder: str) -> DataFrame:
    """__pii_key and the spans that high-confidence patterns add, for the documents that have any."""
    found = scanned.select("__pii_key", F.explode("found").alias("x")).select("__pii_key", "x.*")
    unseen = common.stage(found.where(~F.col("seed")), f"{folder}/unseen")
    edges = common.stage(unseen.select("value", "kind", F.explode("patterns").alias("pattern")).distinct(), f"{folder}/edges")
    # Only patterns that touch an instance without a kind can find one; seeds count once for each of their strings.
    touching = edges.select("pattern").distinct()
    seeds = found.where("seed").select("value", "kind", F.explode("patterns").alias("pattern")).join(touching, "pattern", "left_semi").distinct()
    seeds = common.stage(seeds.groupBy("pattern", "kind").agg(F.count("*").alias("seeds")), f"{folder}/seeds")
    touched = seeds.select("pattern", F.col("seeds").alias("n")).unionByName(edges.groupBy("pattern").agg(F.count("*").alias("n")))
    strong = seeds.where(F.col("seeds") >= SUPPORT).join(touched.groupBy("pattern").agg(F.sum("n").alias("touched")), "pattern")
    strong = common.stage(strong, f"{folder}/strong")
    accepted = edges.select("value", "kind", F.lit(0.0).alias("conf")).limit(0)
    for n in range(ROUNDS):
        if strong.isEmpty():
            break
        more = edges.join(accepted, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("conf").alias("more"))
        trust = strong.join(more, ["pattern", "kind"], "left").select("pattern", "kind", ((F.col("seeds") + F.coalesce("more", F.lit(0.0))) / F.col("touched")).alias("trust"))
        told = edges.join(trust.where(F.col("trust") >= CONFIDENT), ["pattern", "kind"])
        belief = told.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("conf"))
        accepted = common.stage(belief, f"{folder}/accepted{n}")
    new = unseen.join(accepted.where(F.col("conf") >= CONFIDENT).select("value", "kind"), ["value", "kind"])
    return new.groupBy("__pii_key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("extra"))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, __pii_key, base and spans (base and discovered, sorted) for each row of docs(doc_id, text)."""
    folder = common.new_folder(docs.sparkSession, "pii")
    scanned = common.stage(scan(docs), f"{folder}/scan")
    extra = discovered(scanned, folder)
    rows = common.joined(scanned.drop("found"), extra, ["__pii_key"], "left")
    return rows.select("doc_id", "__pii_key", "base", F.array_sort(F.coalesce(F.concat("base", "extra"), F.col("base"))).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """docs, its columns as they are, with every span of text replaced by its kind in brackets."""
    folder = common.new_folder(docs.sparkSession, "pii")
    names = docs.columns
    scanned = common.stage(scan(docs), f"{folder}/scan")
    spans = detect_spans(scanned, folder)
    rows = keyed(docs)
    with_any = common.joined(rows, spans.withColumnRenamed("spans", "__pii_spans"), ["__pii_key"], "left")

    def put(batches):
        for batch in batches:
            texts = [mask(t, [(s["start"], s["kind"], s["end"]) for s in x]) if x else t for t, x in zip(batch.column("text").to_pylist(), batch.column("__pii_spans").to_pylist(), strict=True)]
            i = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == i else batch.column(j) for j in range(len(names))], names=names)

    return with_any.select(*names, "__pii_spans").mapInArrow(put, docs.schema)


def detect_spans(scanned: DataFrame, folder: str) -> DataFrame:
    """__pii_key and all spans, for documents that have any."""
    both = scanned.select("__pii_key", "base").dropDuplicates(["__pii_key"]).join(discovered(scanned, folder), "__pii_key", "left")
    return both.select("__pii_key", F.coalesce(F.concat("base", "extra"), F.col("base")).alias("spans")).where(F.size("spans") > 0)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans that overlap are masked as one, by the kind of the first."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined_spans(column) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8(spark, sf_dir: str) -> DataFrame:
    found = detect(common.in_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    counts = [F.size(F.filter("base", lambda x: x["kind"] == F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
