"""Personal data: seed patterns, and bootstrapped contextual extraction of what they miss.

Seeds are e-mail addresses, IP addresses, card and phone numbers in fixed forms, and long hexadecimal
identifiers. Every other word with enough digits is a candidate. Each seed and candidate stands in a lexical
pattern: the two whole words before it and what is glued to it, where a seed or candidate is a word of its
own. Candidates hold five digits or more, so an identifier without digits is not found. Patterns and instances form a graph. In every
round a pattern's confidence in a kind is the share of its distinct instances that are known to be of that kind,
and a candidate's confidence is that of its best confident pattern; it then counts for further patterns.
The candidates of the last round are the spans that the seeds alone do not find.

Patterns and instances meet by aggregates over distinct pairs and by joins, so neither a frequent pattern nor
an instance that is copied everywhere is gathered.

Defined cases: a null or empty text has no spans; repeated rows are scanned each; an empty table gives an empty
one; ``find`` ignores other columns, ``redact`` keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spare, stage

#: In the order of the listed kinds; ``id`` is the method's own.
KINDS = ("email", "ip", "card", "phone", "id")
SUPPORT = 3
CONFIDENT = 0.7
ROUNDS = 3

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a run of digits fails at all its places if it fails at the first one, so only that is tried
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HEX = re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}(?![0-9A-Za-z])")
CANDIDATE = re.compile(r"(?<![0-9A-Za-z])[0-9A-Za-z](?:[0-9A-Za-z.@_+()/-]*[0-9A-Za-z])?")
CANDIDATE_DIGITS = 5
DIGIT = re.compile(r"[0-9]")
GLUE = "\"'=:(<[{#"
#: Longer patterns and instances are known by their digest; nothing of them is cut.
KEY_CHARS = 200

SPAN = "struct<kind: int, start: int, end: int>"
FOUND = f"base array<{SPAN}>, seen array<struct<kind: int, start: int, end: int, pattern: string, instance: string>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the listed kinds, leftmost and non-overlapping for each, by start then kind."""
    spans = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL_PART))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            spans.append((0, start, m.end()))
        # no local part reaches back over an @, so none is looked at twice
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if DIGIT.search(text):
        spans += [(1, *m.span()) for m in IP.finditer(text) if all(
            len(d := p.lstrip("0") or "0") < 4 and int(d) < 256 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
    if "+" in text:
        spans += [(3, *m.span()) for m in PHONE.finditer(text)
                  if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def identity(text: str) -> str:
    return text if len(text) <= KEY_CHARS else hashlib.sha256(text.encode()).hexdigest()


def with_patterns(text: str, seen: list) -> list:
    """(kind, start, end, pattern, instance) of the places in ``seen``, which are ordered by their start.

    A pattern is the last two words before the place and what is glued to it; digits are not part of it. A place is a
    word itself, so every stretch between two places is read once. Overlapping places stand behind the same words.
    """
    rows, words, done, stop = [], [], 0, 0
    for kind, start, end in seen:
        if start >= stop:                              # the former places are words now
            if stop > done:
                words = (words + text[done:stop].split())[-2:]
            between = text[stop:start]
            plain = between.rstrip(GLUE)
            before, done = (words + plain.rsplit(None, 2)[-2:])[-2:], start
            glued, words = between[len(plain):], (words + between.rsplit(None, 2)[-2:])[-2:]
        pattern = DIGIT.sub("0", " ".join([*before, "_" + glued]).lower())
        rows.append((kind, start, end, identity(pattern), identity(text[start:end].lower())))
        stop = max(stop, end)
    return rows


def clear_of(taken: list[tuple[int, int]], matches):
    """The matches that overlap no span of ``taken``; both are ordered by start."""
    k = 0
    for m in matches:
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            yield m


def sightings(text: str) -> tuple[list, list]:
    """Base spans, and all seeds and candidates with pattern and instance (kind -1 for a candidate)."""
    base = base_spans(text)
    if not base and not DIGIT.search(text):
        return [], []
    taken = [(s, e) for _, s, e in base]
    own = [(4, *m.span()) for m in clear_of(taken, HEX.finditer(text))]
    taken = sorted([*taken, *((s, e) for _, s, e in own)])
    rich = (m for m in CANDIDATE.finditer(text) if sum("0" <= c <= "9" for c in m[0]) >= CANDIDATE_DIGITS)
    free = [(-1, *m.span()) for m in clear_of(taken, rich)]
    return base, with_patterns(text, sorted([*base, *own, *free], key=lambda s: (s[1], s[0])))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``row``, the base spans and everything that takes part in the graph."""

    def run(batches):
        for batch in batches:
            found = [sightings(t or "") for t in batch.column("_scanned").to_pylist()]
            span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
            sight = pa.struct([*span, ("pattern", pa.string()), ("instance", pa.string())])
            rows = [[dict(zip(("kind", "start", "end", "pattern", "instance"), s)) for s in part]
                    for pair in found for part in pair]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(batch.num_columns - 1)),
                 pa.array(rows[0::2], pa.list_(span)), pa.array(rows[1::2], pa.list_(sight))],
                names=[*names, "base", "seen"])

    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col("text").alias("_scanned"))
    names = rows.columns[:-1]
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(FOUND).fields])
    return stage(rows.mapInArrow(run, schema), "sightings")


def _confident(known: DataFrame, pairs: DataFrame, support: int, confident: float) -> DataFrame:
    """``pattern, kind, score`` of the patterns that are confident in a kind."""
    total = pairs.groupBy("pattern").agg(F.count("*").alias("total"))
    right = pairs.join(known, "instance").groupBy("pattern", "kind").agg(
        F.sum("score").alias("right"), F.count("*").alias("n"))
    scored = right.join(total, "pattern").withColumn("score", F.col("right") / F.col("total"))
    best = scored.where((F.col("n") >= support) & (F.col("score") >= confident))
    return best.groupBy("pattern").agg(F.max_by("kind", "score").alias("kind"), F.max("score").alias("score"))


def bootstrap(scanned: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT,
              rounds: int = ROUNDS) -> DataFrame:
    """``row, kind, start, end`` of the candidates in confident patterns of the last round."""
    sights = scanned.select(F.col("_row").alias("row"), F.explode("seen").alias("s")).select("row", "s.*")
    seeds = sights.where("kind >= 0").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn(
        "score", F.lit(1.0))
    pairs = stage(sights.select("pattern", "instance").distinct(), "pattern-instances")
    known = stage(seeds, "known-instances")
    patterns = stage(_confident(known, pairs, support, confident), "patterns")
    for _ in range(rounds - 1):
        guessed = (pairs.join(patterns, "pattern").groupBy("instance")
                   .agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
                   .join(seeds, "instance", "left_anti"))
        known = stage(seeds.union(guessed), "known-instances")
        patterns = stage(_confident(known, pairs, support, confident), "patterns")
    found = sights.where("kind < 0").drop("kind").join(patterns, "pattern").select("row", "kind", "start", "end")
    own = sights.where("kind = 4").select("row", "kind", "start", "end")
    return found.union(own)


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_spans(scanned: DataFrame) -> DataFrame:
    """Add ``spans``, base and found ones by start, then kind."""
    more = bootstrap(scanned).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    both = F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))
    by_place = F.array_sort(F.transform(both, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return scanned.join(more, scanned["_row"] == more["row"], "left").withColumn(
        "spans", F.transform(by_place, lambda s: F.struct(s["kind"], s["start"], s["end"])))


def find(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every row."""
    rows = _with_spans(scan(docs, ["doc_id"]))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *(count(k) for k in range(4)), F.sha2(_listed("base"), 256).alias("base_sha256"),
                       _listed("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars`` follows if there."""
    names = docs.columns
    whole = scan(docs.select(F.struct(*names).alias("doc"), "text"), ["doc"])
    rows = _with_spans(whole).select(*(F.col("doc").getField(c).alias(c) for c in names),
                                      F.col("spans").alias(spare("spans", docs)))
    place = names.index("text")

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()):
                if spans:
                    parts, stop = [], 0
                    for s in spans:
                        if s["start"] >= stop:
                            parts += [text[stop:s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                        stop = max(stop, s["end"])
                    text = "".join([*parts, text[stop:]])
                texts.append(text)
            columns = [batch.column(k) for k in range(len(names))]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    done = rows.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return done
