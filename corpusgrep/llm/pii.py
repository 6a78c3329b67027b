"""Personal data: fixed patterns, and identifiers that bootstrapped contexts find.

Entities that the fixed patterns find are seeds.  The words around them are
lexical patterns, and the other tokens with a digit or an at sign, runs of
digit groups and spelt-out addresses that stand in the same contexts are
instances.  Patterns and instances form a bipartite
graph by kind, scored in turns by joins: a pattern by the share of its
distinct instances that are believed, where one of which nothing is known
weighs less than one of another kind, an instance by the patterns that
it stands in, until nothing is added.  Instances found by patterns of high confidence are identifiers
that no fixed pattern describes; they add spans to the fixed ones.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrep.llm.common import Stages, fresh, slices, tidy

KINDS = ("email", "ip", "card", "phone")
#: Distinct seeds that a pattern needs, confidence that a pattern needs, weight of the prior against a pattern, weight against it of an
#: instance of which nothing is known, movement of all scores that counts as rest.
SUPPORT = 5
CONFIDENCE = 0.75
PRIOR = 1.0
UNKNOWN = 0.75
MOVED = 1e-6
#: Characters that an unseen identifier has at least, and those up to which it stands for itself in the graph; longer ones are hashed.
LEAST, PLAIN = 5, 64

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D\"'()\[\]{}<>,;|=]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Two or more whole groups of digits, joined by a dot or by up to three blanks, hyphens and parentheses; a dot and a blank end a sentence.
_RUN = re.compile(r"(?:\+\x20?\(?|\(|(?<![^\W_]))[0-9]++(?![^\W_])(?:(?:\.|[-()\x20\x09\xA0]{1,3})[0-9]++(?![^\W_]))++")
#: An address spelt out: words joined by bracketed words or signs or by "dot", or by a bare "at" that "dot" follows.
_BRACKETED = r"\x20?[\[({<]\x20?(?:[^\W\d_]{1,8}|[@.])\x20?[\])}>]\x20?"
_PART, _FIRST, _DOT = r"[\w-]++(?:\.[\w-]++)*+", r"(?<![\w.%+-])[\w.%+-]++", r"\x20dot\x20"
_SPELT = re.compile(rf"{_FIRST}(?:(?:(?:{_BRACKETED}|{_DOT}){_PART})*+\x20at\x20{_PART}(?:{_DOT}{_PART})++(?!\x20at\x20)|(?:(?:{_BRACKETED}|{_DOT}){_PART})++)", re.IGNORECASE)
_JOINED = re.compile(rf"{_BRACKETED}|\x20dot\x20", re.IGNORECASE)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at sign: the run of local characters before it, not before the last match's end, and the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the fixed patterns, sorted; offsets in code points.

    Each kind is matched from the left without overlap; a match that fails its check is dropped and
    not tried again.  Spans of different kinds may overlap.
    """
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if any(d in text for d in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def _clean(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>").lower()


class Words:
    """A text's words, for the words around a place, however far they are."""

    def __init__(self, text: str):
        self.text, self.places = text, [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.places]

    def before(self, start: int, n: int) -> list[str]:
        """The last n words that begin before the place, in order; what is written directly before it counts as one."""
        out, i = [], bisect_left(self.starts, start) - 1
        while i >= 0 and len(out) < n:
            a, b = self.places[i]
            if word := _clean(self.text[a:min(b, start)]):
                out.append(word)
            i -= 1
        return out[::-1]

    def after(self, end: int) -> str:
        """The next word; of two, if the first has no letters."""
        i = bisect_left(self.starts, end)
        some = self.places[max(0, i - 1):i + 2]
        found = [w for w in [_clean(self.text[max(a, end):b]) for a, b in some if b > end][:2] if w]
        return found[0] if found else ""


def contexts(words: Words, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: one word before it, two, three, one after it, and one on each side.

    Words that have digits or an at sign don't count.  What is written directly before the place,
    like a label with a colon, is the first word before it.
    """
    before, after = words.before(start, 3), words.after(end)
    plain = lambda words: not any(c.isdigit() or c == "@" for w in words for c in w)
    out = []
    for n in (1, 2, 3):
        if len(before) >= n and plain(before[-n:]):
            out.append(f"{n} {' '.join(before[-n:])} _")
    if after and plain([after]):
        out.append(f"0 _ {after}")
        if before and plain(before[-1:]):
            out.append(f"1 {before[-1]} _ {after}")
    return out


def _runs(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of digit groups outside the spans, with the parentheses that belong to them."""
    pieces, done = [], 0
    for a, b in spans:
        if b > done:
            pieces += [text[done:max(a, done)], "\0" * (b - max(a, done))]
            done = b
    text = "".join([*pieces, text[done:]])
    for m in _RUN.finditer(text):
        start, end = m.span()
        if m[0][0] == "(" and ")" not in m[0]:
            start += 1
        if text.count("(", start, end) > text.count(")", start, end) and text[end:end + 1] == ")":
            end += 1
        yield start, end


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Places of LEAST characters or more that overlap no base span, sorted.

    They are tokens with a digit or an at sign, whole runs of neighbouring digit groups, and
    addresses spelt out.  A token of a run is a place of its own as well.
    """
    spans, found = sorted((a, b) for a, _, b in taken), set()
    if "@" in text or any(d in text for d in "0123456789"):
        for m in _TOKEN.finditer(text):
            token = m[0].rstrip(".:!?")
            if any("0" <= c <= "9" or c == "@" for c in token):
                found.add((m.start(), m.start() + len(token)))
        found.update(_runs(text, spans))
    if _JOINED.search(text):
        found.update(m.span() for m in _SPELT.finditer(text) if _JOINED.search(m[0]))
    at = 0
    for start, end in sorted(found):
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        if end - start >= LEAST and not (at < len(spans) and spans[at][0] < end):
            yield start, end


def _instance(string: str) -> str:
    string = string.lower()
    return string if len(string) <= PLAIN else "sha256 " + hashlib.sha256(string.encode("utf-8", "surrogatepass")).hexdigest()


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k, base, places) of each row: base spans, and every place that may be an instance.

    A null text has neither.  k is a hash of id and text, so that equal rows share it.  Places are
    (start, end, kind's index or null, the string or its hash, context).  No shuffle.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(key, text).alias("k"), F.col(text).alias("t"))
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    place = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()), ("context", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            bases, places = [], []
            for t in batch.column("t"):
                t = t.as_py() or ""
                base = base_spans(t)
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                some = [*base, *((a, None, b) for a, b in candidates(t, base))]
                words = Words(t) if some else None
                places.append([{"start": a, "end": b, "kind": k, "instance": _instance(t[a:b]), "context": c} for a, k, b in some for c in contexts(words, a, b)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k"), pa.array(bases, pa.list_(span)), pa.array(places, pa.list_(place))], ["doc_id", "k", "base", "places"])

    return rows.mapInArrow(tidy(run), "doc_id long, k long, base array<struct<start:int,kind:int,end:int>>, "
                                "places array<struct<start:int,end:int,kind:int,instance:string,context:string>>")


def discover(stages: Stages, scanned: DataFrame) -> DataFrame:
    """(doc_id, k, start, kind, end) of the spans that patterns of high confidence add.

    The graph has an edge for each distinct context and string, however many copies it has; all
    scoring is joins and aggregations on it.  Contexts with fewer strings than a pattern needs are
    dropped first.  Instances that were found count as seeds in the next turn.  Scores never fall,
    so sets only grow, and the turns end when nothing is added and the scores rest.
    """
    places = scanned.select("doc_id", "k", F.explode("places").alias("p")).select("doc_id", "k", "p.*")
    seen = stages.write(places.groupBy("context", "instance").agg(F.min("kind").alias("kind")), "seen")
    sizes = stages.write(seen.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT), "sizes")
    known = seen.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
    edges = stages.write(seen.select("context", "instance").join(sizes.select("context"), "context").join(known, "instance", "left"), "edges")
    against = stages.write(edges.groupBy("context").agg((F.count("kind") + UNKNOWN * (F.count("*") - F.count("kind"))).alias("against")), "against")
    seeds = edges.where("kind is not null").groupBy("context", F.col("kind").alias("of")).agg(
        F.count("*").cast("double").alias("mass"), F.count("*").alias("support"), F.lit(0.0).alias("gained"))
    seeds, unseen = stages.write(seeds, "seeds"), edges.where("kind is null").select("context", "instance")
    stages.drop("seen")
    found, before, turn = None, (0, 0, 0.0), 0
    while True:
        mass = seeds if found is None else seeds.unionByName(
            unseen.join(found, "instance").groupBy("context", "of").agg(F.sum("score").alias("mass"), F.count("*").alias("support"), F.sum("score").alias("gained")))
        confidence = F.round(F.col("mass") / (F.col("against") + (1 - UNKNOWN) * F.col("gained") + PRIOR), 9)
        patterns = mass.groupBy("context", "of").agg(F.sum("mass").alias("mass"), F.sum("support").alias("support"), F.sum("gained").alias("gained")).where(F.col("support") >= SUPPORT).join(
            against, "context").select("context", "of", confidence.alias("confidence")).where(F.col("confidence") >= CONFIDENCE)
        patterns = stages.write(patterns, f"patterns-{turn}")
        # An instance is as likely as that not all of its patterns are wrong.
        found = stages.write(unseen.join(patterns, "context").groupBy("instance", "of").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score")), f"found-{turn}")
        if turn:
            stages.drop(f"patterns-{turn - 1}", f"found-{turn - 1}")
        count, total = found.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        now = (patterns.count(), count, total)
        if not count or now[:2] == before[:2] and abs(total - before[2]) <= MOVED * max(1.0, total * 1e-6):
            break
        before, turn = now, turn + 1
    best = places.where("kind is null").join(patterns.select("context", "of"), "context").join(found, ["instance", "of"]).groupBy("doc_id", "k", "start", "end").agg(
        F.max(F.struct("score", (-F.col("of")).alias("less"))).alias("best"))
    # Of places inside one another the outermost counts.
    earlier = Window.partitionBy("doc_id", "k").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = best.withColumn("__reach", F.max("end").over(earlier)).where("__reach is null or end > __reach")
    return outer.select("doc_id", "k", "start", (-F.col("best.less")).alias("kind"), "end")


def find_spans(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k, base, spans) of every row: arrays of (start, kind's index, end), sorted; spans has base and more.

    A null or empty text has no spans, and an empty table gives an empty result.  Repeated rows get
    the same spans each; however often a string stands in a context, it counts there once.  Of
    several kinds that a place could be, the one of the highest score counts, and of equal scores
    the first of KINDS; of added places inside one another the outermost counts, and they never
    overlap base spans.  Other columns are ignored.
    """
    stages = Stages(spark, "pii")
    scanned = stages.write(scan(df, key, text), "scanned")
    added = discover(stages, scanned).groupBy("doc_id", "k").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added")).select(
        F.col("doc_id").alias("__d"), F.col("k").alias("__k"), "added")
    joined = scanned.join(added, scanned["doc_id"].eqNullSafe(F.col("__d")) & (F.col("k") == F.col("__k")), "left")
    spans = F.sort_array(F.concat("base", F.coalesce("added", F.slice("base", 1, 0))))
    return joined.select("doc_id", "k", "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def mask(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with every found span of the text replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null texts stay null.  Texts without spans are not touched.  Columns of any names stay.
    """
    d, h, at, key_, merged_ = fresh(df, "__d", "__k", "__spans", "__key", "__merged")
    found = find_spans(spark, df, key, text).where(F.size("spans") > 0).select(F.col("doc_id").alias(d), F.col("k").alias(h), F.col("spans").alias(at)).distinct()
    joined = df.withColumn(key_, F.xxhash64(key, text)).join(
        found, F.col(key).cast("long").eqNullSafe(F.col(d)) & (F.col(key_) == F.col(h)), "left")
    # Merge overlapping spans, then write the pieces between them and the names in turn.
    merged = F.aggregate(at, F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["start"].alias("start"), F.element_at(done, -1)["kind"].alias("kind"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    joined = joined.withColumn(merged_, merged)
    pieces = F.transform(merged_, lambda s, i: F.concat(
        F.substring(F.col(text), F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(merged_, i)["end"]) + 1,
                    s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(merged_, i)["end"])),
        F.element_at(names, s["kind"] + 1)))
    masked = F.concat(F.array_join(pieces, ""), F.substring(F.col(text), F.element_at(merged_, -1)["end"] + 1, F.lit(2**31 - 1)))
    return joined.select(*(F.when(F.col(merged_).isNull(), F.col(text)).otherwise(masked).alias(c) if c == text else F.col(c) for c in df.columns))


def op4_bootstrapped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the personal data of every document; see find_spans for all special cases."""
    found = find_spans(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {"op4_bootstrapped_contexts": op4_bootstrapped_contexts}
ORACLES: dict[str, str] = {}
