"""Operator 3: personal data by fixed forms, and by contexts that are bootstrapped from them.

Matches of the fixed forms are seeds. The words around a seed on its line are lexical patterns: the one before it, the
two before it, and the one after it. Other strings of a looser form are candidates. Patterns and strings make a graph
that Spark scores in rounds: a pattern that stands by enough strings held to be personal data is worth the share of all
its occurrences in the corpus that such strings explain, a string what its patterns make likely. Strings that become
likely lend support to further patterns, until a round changes nothing. Candidates by high-confidence patterns become spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonloom.llm.common import binary_lists, discard, map_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Patterns up to so many go to each task; with more, all words are counted and joined by shuffle.
MOST_BROADCAST = 100_000

_HINT = re.compile("[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser forms by kind: what a pattern of that kind may discover.
_LOOSE = (
    re.compile(r"(?<!\S)[A-Za-z0-9._%+-]+(?:@|\[at\]|\(at\))[A-Za-z0-9.-]+[A-Za-z0-9]"),
    re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?![\w:])"),
    re.compile(r"(?<![\w+-])[0-9]{4}(?:[\x20-]?[0-9]){8,15}(?![\w-])"),
    re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?(?:[\x20./-]?[0-9]{2,5}){1,4}(?![\w-])"),
)
#: Words of contexts: runs without white space, cut after the marks that join a label to its value.
_MARKS, _SPACE = r":=<(\"\[", r"\x20\x09-\x0D"
_WORD = re.compile(rf"[^{_SPACE}{_MARKS}]*[{_MARKS}]|[^{_SPACE}{_MARKS}]+")
#: Longer words and pairs of words stand as their digest.
PLAIN = 64
FORMS = ("before", "two before", "after")


def luhn(digits: str) -> bool:
    twice = [(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, leftmost and not overlapping within a kind, by kind and start."""
    out, free = [], 0
    if not _HINT.search(text):
        return out
    for m in _DOMAIN.finditer(text):  # the local part is the run of its characters before the @
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            free = m.end()
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in (x.lstrip("0")[:4] or "0" for x in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of looser forms that touch no span of the fixed ones."""
    if not _HINT.search(text):
        return []
    ends: list[int] = []
    starts: list[int] = []  # of what the fixed forms cover, joined up
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    free = lambda a, b: (k := bisect_right(ends, a)) == len(ends) or starts[k] >= b
    digits = lambda x: sum("0" <= c <= "9" for c in x)
    bounds = ((0, 10**9), (0, 10**9), (12, 19), (7, 15))
    return [(k, *m.span()) for k, form in enumerate(_LOOSE) for m in form.finditer(text) if bounds[k][0] <= digits(m[0]) <= bounds[k][1] and free(*m.span())]


def _named(words: str) -> str:
    """Words as they stand in a pattern: A-Z lower-cased, long ones as a digest."""
    raw = words.encode("utf-8", "replace").lower()
    return raw.decode("utf-8", "replace") if len(words) <= PLAIN else hashlib.md5(raw).hexdigest()


def contexts(text: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, str]]]:
    """For each span (start, end) its patterns (form, words): whole words beside it on its line, however far away or long."""
    if not spans:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    begins, ends = [a for a, _ in words], [b for _, b in words]
    out = []
    for start, end in spans:
        line, line_end = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        before, after = bisect_right(ends, start) - 1, bisect_left(begins, end)
        near = []
        if before >= 0 and begins[before] >= line:
            last = text[begins[before] : ends[before]]
            near.append((0, _named(last)))
            if before and begins[before - 1] >= line:
                near.append((1, _named(text[begins[before - 1] : ends[before - 1]] + " " + last)))
        if after < len(words) and (line_end < 0 or begins[after] < line_end):
            near.append((2, _named(text[begins[after] : ends[after]])))
        out.append(near)
    return out


def find(spark: SparkSession, docs: DataFrame, rounds: int = 200, least_seeds: int = 3, sure: float = 0.6) -> DataFrame:
    """(doc_id, base, found): arrays of (kind, start, end) of each row of docs (doc_id, text).

    base: matches of the fixed forms, by kind as in KINDS, then start; found: further spans, beside a pattern with
    at least `least_seeds` different strings held to be personal data and a confidence of at least `sure` (ties
    count). Places are code points, the end exclusive. Null text counts as empty and has no spans; repeated rows have equal
    spans, also where doc_id is null. Other columns are not read. Candidates overlap no base span; overlapping candidates
    of a kind cannot occur. Scoring ends when a round changes no
    confidence in its first six digits; if that takes more than `rounds`, it is an error.
    """
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    context = [("form", pa.int32()), ("pattern", pa.string())]
    seen = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("item", pa.string()), ("near", pa.list_(pa.struct(context)))]))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bases, strings = [], []
        for raw in binary_lists(batch, "text"):
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            rest = candidates(text, base)
            bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            near = contexts(text, [(a, b) for _, a, b in (*base, *rest)])
            strings.append([{"kind": k, "start": a, "end": b, "seed": n < len(base), "item": _named(text[a:b]), "near": [{"form": f, "pattern": p} for f, p in c]} for n, ((k, a, b), c) in enumerate(zip((*base, *rest), near, strict=True)) if c])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(bases, span), pa.array(strings, seen)], ["doc_id", "text_key", "base", "strings"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    fields = "array<struct<kind:int,start:int,end:int>>"
    spans = table(map_batches(kept, each, f"doc_id long, text_key long, base {fields}, strings array<struct<kind:int,start:int,end:int,seed:boolean,item:string,near:array<struct<form:int,pattern:string>>>>", by="text"), "pii-spans")
    strings = spans.select("doc_id", "text_key", F.explode("strings").alias("s")).select("doc_id", "text_key", "s.*")
    occurrences = strings.withColumn("n", F.explode("near")).select("doc_id", "text_key", "kind", "start", "end", "seed", "item", "n.*")
    patterns = pattern_scores(spark, docs, occurrences, rounds, least_seeds, sure)
    hits = occurrences.where("not seed").join(patterns.where(F.col("confidence") >= sure).select("kind", "form", "pattern"), ["kind", "form", "pattern"], "left_semi")
    found = hits.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("found"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "found")
    joined = spans.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("t")), "left")
    return joined.select("doc_id", "base", F.coalesce("found", F.array().cast(fields)).alias("found"))


_RAW_WORD = re.compile(_WORD.pattern.encode())


def _raw_name(words: bytes) -> bytes:
    """_named() of lower-cased bytes."""
    if len(words) <= PLAIN or len(words.decode("utf-8", "replace")) <= PLAIN:
        return words
    return hashlib.md5(words).hexdigest().encode()


def occurrences_of(texts: Iterable[bytes], known: frozenset[bytes] | None) -> Counter:
    """How often words and pairs of neighbours stand in texts, line breaks not regarded: those that are known, or (None) all."""
    out: Counter = Counter()
    firsts = None if known is None else {w.split(b" ")[0] for w in known if b" " in w}
    # a pair whose name is a digest shows no first word
    digests = known is not None and any(len(w) == 32 and b" " not in w for w in known)
    for text in texts:
        words = _RAW_WORD.findall(text.lower())
        if known is None:
            out.update(map(_raw_name, words))
            out.update(_raw_name(a + b" " + b) for a, b in zip(words, words[1:], strict=False))
            continue
        out.update(filter(known.__contains__, words))
        for k, w in enumerate(words):
            if len(w) > PLAIN and (name := _raw_name(w)) != w and name in known:
                out[name] += 1
            if k + 1 < len(words) and (w in firsts or digests and len(w) + len(words[k + 1]) >= PLAIN):
                name = _raw_name(w + b" " + words[k + 1])
                if name in known:
                    out[name] += 1
    return out


def pattern_scores(spark: SparkSession, docs: DataFrame, occurrences: DataFrame, rounds: int, least_seeds: int, sure: float) -> DataFrame:
    """(kind, form, pattern, confidence) of the patterns with enough support, as they are when a round over the graph of patterns and strings changes nothing."""
    key = ["kind", "form", "pattern"]
    edges = table(occurrences.groupBy(*key, "item").agg(F.max("seed").alias("seed"), F.count("*").alias("times")), "pii-edges")
    # only these can ever have support; each has its occurrences in the whole corpus, line breaks not regarded
    usable = table(edges.groupBy(*key).agg(F.count("*").alias("strings")).where(F.col("strings") >= least_seeds).select(*key), "pii-patterns")
    names = usable.select("pattern").distinct()
    known = frozenset(r.pattern.encode() for r in names.collect()) if names.count() <= MOST_BROADCAST else None

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = occurrences_of(binary_lists(batch, "text"), known)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["pattern", "n"])

    corpus = map_batches(docs.select("text"), count, "pattern string, n long", by="text").groupBy("pattern").agg(F.sum("n").alias("total"))
    totals = corpus if known is not None else corpus.join(names, "pattern", "left_semi")
    graph = table(edges.join(usable.join(totals, "pattern", "left"), key), "pii-graph")
    discard(edges, usable)
    scores = graph.groupBy("kind", "item").agg(F.max(F.col("seed").cast("double")).alias("score"))
    worth = F.sum(F.col("times") * F.col("score")) / (F.greatest(F.max("total"), F.sum("times")) + 1)
    support = F.count(F.when(F.col("score") >= sure, 1))
    before = None
    for _ in range(rounds):
        patterns = graph.join(scores, ["kind", "item"]).groupBy(*key).agg(worth.alias("confidence"), support.alias("support")).where(F.col("support") >= least_seeds)
        patterns = table(patterns.select(*key, F.round("confidence", 6).alias("confidence")), "pii-round")
        if before is not None:
            # no pattern goes and no confidence falls from one round to the next: what is new shows every change
            settled = patterns.join(before, [*key, "confidence"], "left_anti").isEmpty()
            discard(before)
            if settled:
                discard(graph)
                return patterns
        before = patterns
        # a pattern without support says nothing; least() alone would pass over its null and make it nearly certain
        doubt = F.exp(F.sum(F.log(1.0 - F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))))
        scores = graph.join(patterns, key, "left").groupBy("kind", "item").agg(F.when(F.max("seed"), 1.0).otherwise(1.0 - doubt).alias("score"))
    raise RuntimeError(f"the scores of patterns still change after {rounds} rounds")
