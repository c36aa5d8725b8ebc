"""Operator 7: near-duplicate documents by the Jaccard similarity of their word n-grams, joined on rare-first prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonloom.llm.common import binary_lists, components, discard, map_batches, table, text_bytes
from carbonloom.llm.packed import PART_TEXT, bucket_count, edges_of, mixed, packed_rows, part_of, part_rows, part_texts, text_keys, unpack_shared

#: 64-bit words of a text's bits; rounds in which n-grams pair their texts with one of them.
WORDS_OF_BITS, PIVOT_ROUNDS = 32, 5

_STEP = np.uint64(0x9E3779B97F4A7C15)


#: A random value for each byte, the same for a letter of either case; bytes that part words. Base of the hash of a word and its inverse modulo 2^64.
_VALUE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once.
HASHED = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, in order, and where the words of each text begin, and the end.

    The bytes of a word are digits of a number, which is the difference of two prefix sums over all texts.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # a blank behind each text
    turns = np.diff(_BLANK[raw].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * _powers(_BASE, len(raw)), dtype=np.uint64)])
    hashes = mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw))[starts])
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return hashes, np.searchsorted(starts, begins)


def shingles_of(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each UTF-8 text the sorted distinct 64-bit hashes of its word n-grams, A-Z lower-cased; fewer words: of the whole sequence."""
    out: list[np.ndarray] = []
    size = np.cumsum([len(x) for x in texts])
    while len(out) < len(texts):
        first = len(out)
        some = texts[first : max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + HASHED, side="right")))]
        h, begins = _word_hashes(some)
        n = max(0, len(h) - words + 1)
        grams = h[:n].copy()
        for k in range(1, words):
            grams = mixed(grams * _STEP + h[k : k + n])
        for text, a, b in zip(some, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if b - a >= words:
                own = np.sort(grams[a : b - words + 1])
                out.append(own[edges_of(own)[:-1]])
            elif b > a:
                out.append(mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()), 1)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def required(total: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least overlap of two sets of `total` elements together whose similarity reaches percent."""
    return -(-percent * total // (100 + percent))


def overlap_at_least(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether two sorted sets share `need` elements. The suffix filter first: no range of values can add more than its smaller part."""
    if min(len(a), len(b)) < need:
        return False
    if len(a) > 32:
        probes = a[:: max(1, len(a) // 8)][1:]
        parts = [np.diff(np.concatenate([[0], np.searchsorted(x, probes), [len(x)]])) for x in (a, b)]
        if np.minimum(*parts).sum() < need:
            return False
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) >= need


def shared_shingles(docs: DataFrame, words: int, total: int, parts: int) -> DataFrame:
    """part_rows() of the n-grams (tokens) that stand in two different texts or more, with the number of texts (dfs)."""
    packed = packed_rows(docs, lambda texts: [(x, None) for x in shingles_of(texts, words)], bucket_count(total))

    def share(group: pa.Table) -> pa.Table:
        keys, h, o, _ = unpack_shared(group)
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])  # a text repeated in the corpus counts once
        h, o = h[once], o[once]
        texts = np.diff(edges_of(h))
        df = np.repeat(texts, texts).astype("<i4")
        h, o, df = h[df > 1], o[df > 1], df[df > 1]
        return part_rows(keys, o, parts, tokens=h, dfs=df)

    return packed.groupBy("bucket").applyInArrow(share, "part int, keys binary, counts binary, tokens binary, dfs binary")


def link_candidates(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, n, tokens, prefix, places, bits): the texts that share enough n-grams to link at all. shared and classes have the same parts.

    tokens: shared n-grams by value; prefix: the shared ones among the first n - ceil(t n) + 1 in order of
    rarity, then value, with their places in that order. N-grams of one text only come first and match nothing.
    bits: 2048 bits in which each shared n-gram sets one.
    """

    def gather(packed: pa.Table, known: pa.Table) -> pa.Table:
        keys, ends, (tokens, dfs) = part_texts(packed, tokens="<u8", dfs="<i4")
        place = dict(zip(map(tuple, keys.tolist()), zip(ends, ends[1:], strict=False), strict=True))
        out = []
        for key in zip(*(known.column(c).to_pylist() for c in ("k1", "k2", "id", "n")), strict=True):
            *key, i, n = key
            a, b = place.get(tuple(key), (0, 0))
            least = -(-percent * n // 100)
            if b - a < least or not b:
                continue
            own, df = tokens[a:b], dfs[a:b]
            rare = np.lexsort((own, df))
            alone = n - len(own)
            length = max(0, n - least + 1 - alone)
            bits = np.zeros(64 * WORDS_OF_BITS, np.uint8)
            bits[own % np.uint64(len(bits))] = 1
            out.append((i, n, np.sort(own).tobytes(), own[rare[:length]].view("<i8").tolist(), list(range(alone, alone + length)), np.packbits(bits).view("<i8").tolist()))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.table([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], ["id", "n", "tokens", "prefix", "places", "bits"])

    both = shared.groupBy("part").cogroup(classes.select("part", "k1", "k2", "id", "n").groupBy("part"))
    return both.applyInArrow(gather, "id long, n long, tokens binary, prefix array<long>, places array<int>, bits array<long>")


def _passing(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, that the length and the positional filter let pass; pairs has their sizes and places."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    need = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    most = 1 + F.least(F.col("n_a") - F.col("place_a") - 1, F.col("n_b") - F.col("place_b") - 1)
    pairs = pairs.where((100 * small >= percent * large) & (F.col("a") != F.col("b")))
    swap = F.col("a") > F.col("b")
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"), most.alias("most"))
    return ordered.groupBy("a", "b", "n_a", "n_b").agg(F.max("most").alias("most")).where(F.col("most") >= need).select("a", "b", "n_a", "n_b")


def _may_reach(percent: int) -> Column:
    """Whether bits leave room for the overlap that a pair needs: a bit that only one text has stands for an n-gram that the other lacks."""
    alone = lambda x, y: sum((F.bit_count(x[k].bitwiseAND(F.bitwise_not(y[k]))) for k in range(1, WORDS_OF_BITS)), F.bit_count(x[0].bitwiseAND(F.bitwise_not(y[0]))))
    need = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    a, b = F.col("bits_a"), F.col("bits_b")
    return (F.col("n_a") - alone(a, b) >= need) & (F.col("n_b") - alone(b, a) >= need)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, each looked at once."""
    one = sets.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a"))
    two = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        need = required(batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy(), percent).tolist()
        sides = zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist(), need, strict=True)
        good = [overlap_at_least(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), k) for x, y, k in sides]
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "good"])

    return map_batches(pairs.join(one, "a").join(two, "b"), each, "a long, b long, good boolean", by="tokens_a")


def _open(prefix: DataFrame, groups: DataFrame | None, name: str) -> DataFrame:
    """Prefix rows of the n-grams whose texts are not all connected, with their component and the n-gram's largest one."""
    own = prefix.withColumn("component", F.col("id")) if groups is None else prefix.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = own.groupBy("token", "component").agg(F.count("*").alias("texts"))
    largest = parts.groupBy("token").agg(F.max(F.struct("texts", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    return table(own.join(largest.select("token", F.col("most.component").alias("main")), "token"), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    A document's set holds its distinct n-grams of `words` words (fewer words: the whole sequence). Documents
    link when 100 times the intersection reaches `percent` times the union; component_id is the smallest doc_id
    reachable. Null, empty and blank texts have empty sets and link with nothing (component_id is their own doc_id), as do
    rows without doc_id (null). Equal texts are compared once. Rows that repeat a doc_id with another text are documents
    of their own: each belongs to the group of its text. Other columns are not read.

    Groups do not make all their pairs. In some rounds each prefix n-gram pairs its texts with one of them, another one
    each time; texts that are connected are not paired again. The last round takes all pairs that share a prefix n-gram and
    are not connected yet, without those of the n-gram's largest component among themselves, as far as the
    length, positional and bit filters let them pass. No pair that could join two components is left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(x) for x in shingles_of(binary_lists(batch, "text"), words)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64())], ["doc_id", "k1", "k2", "n"])

    sizes = table(map_batches(rows.select("doc_id", *text_keys(F.col("text")), "text"), count, "doc_id long, k1 long, k2 long, n long", by="text"), "shingle-counts")
    # a class: one text with its smallest doc_id; id numbers the classes, as texts may share a doc_id
    classes = sizes.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"))

    def numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(part_of(batch.column("k1").to_numpy(), parts))], [*batch.schema.names, "part"])

    known = rows.where("doc_id is not null")
    total = known.agg(text_bytes(known)).first()[0]
    parts = max(1, -(-total // PART_TEXT))
    classes = map_batches(classes, numbered, "k1 long, k2 long, least long, n long, part int")
    classes = table(classes.withColumn("id", F.monotonically_increasing_id()), "shingle-classes")
    sets = table(link_candidates(shared_shingles(known, words, total, parts), classes, percent), "shingle-sets")
    prefix = sets.select("id", "n", F.posexplode(F.arrays_zip("prefix", "places")).alias("nth", "p")).select(F.col("p.prefix").alias("token"), "id", "n", F.col("p.places").alias("place"), "nth")
    prefix = table(prefix, "shingle-prefixes")

    links, groups, used = None, None, []
    for k in range(PIVOT_ROUNDS):
        open_ = _open(prefix, groups, f"prefixes-open{k}")
        pivot = open_.groupBy("token").agg(F.min_by(F.struct("id", "n", "place", "component"), F.struct(F.xxhash64(F.lit(k), F.col("token") % (1 + 3 * min(k, 1)), "id"), "id")).alias("p")).select("token", "p.*")
        pivot = pivot.toDF("token", "a", "n_a", "place_a", "component_a")
        pairs = open_.withColumnsRenamed({"id": "b", "n": "n_b", "place": "place_b", "component": "component_b"}).join(pivot, "token").where("component_a <> component_b")
        pairs = _passing(pairs, percent)
        if links is not None:
            pairs = pairs.join(links.select("a", "b"), ["a", "b"], "left_anti")
        found = table(verified(pairs, sets.select("id", "tokens"), percent), f"pairs{k}")
        discard(open_)
        links = found if links is None else links.unionByName(found)
        used.append(found)
        if found.where("good").isEmpty():
            break
        old, groups = groups, components(links.where("good").select("a", "b"))
        if old is not None:
            discard(old)

    candidates = _open(prefix, groups, "prefixes-open")
    open_ = candidates.join(sets.select("id", "bits", "prefix"), "id")
    part = lambda side: {c: f"{c}_{side}" for c in ("n", "place", "nth", "component", "bits", "prefix")} | {"id": side}
    outside, every = open_.where("component <> main").withColumnsRenamed(part("a")).drop("main"), open_.withColumnsRenamed(part("b")).drop("main")
    size = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    room = 1 + F.least(F.col("n_a") - F.col("place_a") - 1, F.col("n_b") - F.col("place_b") - 1) >= F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    # a pair comes with its first common n-gram only
    earlier = F.arrays_overlap(F.slice("prefix_a", 1, F.col("nth_a")), F.slice("prefix_b", 1, F.col("nth_b")))
    rest = outside.join(every, (outside["token"] == every["token"]) & (F.col("component_a") != F.col("component_b")) & size & room & _may_reach(percent) & ~earlier)
    rest = _passing(rest, percent).join(links.select("a", "b"), ["a", "b"], "left_anti")
    last = table(verified(rest, sets.select("id", "tokens"), percent).where("good"), "pairs-last")
    discard(candidates, sets, prefix)
    if groups is None or not last.isEmpty():
        old, groups = groups, components(links.where("good").unionByName(last).select("a", "b"))
        if old is not None:
            discard(old)
    linked = classes.join(groups, "id").select("id", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("first"))
    linked = linked.select("id", "component").join(least, "component").select("id", "first")
    of_class = table(classes.join(linked, "id", "left").select("k1", "k2", F.coalesce("first", "least").alias("component")), "shingle-groups")
    discard(classes, last, groups, *used)
    out = sizes.join(of_class, ["k1", "k2"], "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
