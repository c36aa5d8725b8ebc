"""Operator 9: license notices, found by conditional compression and confirmed by their wording."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonloom.llm.common import binary_lists, map_batches
from carbonloom.llm.license_texts import TEMPLATES

#: Bytes of wording below which no match of a template can save a zstandard frame anything.
SHORT = 28

_SENTENCE = re.compile(r"(?<=[.!?:])\s+(?![\s\d])")
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", re.ASCII | re.IGNORECASE)


def wording(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _numbered(word: str) -> bool:
    return any(c.isdigit() for c in word)


class Scanner:
    """The templates' words, joined by spaces as raw-content dictionaries, so that case and line breaks do not count."""

    def __init__(self, templates: dict[str, str], level: int = 3):
        self.plain = zstandard.ZstdCompressor(level=level)
        self.words = {name: wording(t) for name, t in templates.items()}
        self.with_dict = {name: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, w in self.words.items()}
        self.edits = {name: len(w) // 8 for name, w in self.words.items()}
        # the longest words that together stand more often than words may be missing: a notice has at least one of them
        self.cues: dict[str, list[str]] = {}
        for name, w in self.words.items():
            count, times = Counter(w), 0
            for cue in sorted(count, key=lambda x: (-len(x), x)):
                if times > self.edits[name]:
                    break
                self.cues.setdefault(cue, []).append(name)
                times += count[cue]
        self.cue_bytes = [c.encode() for c in self.cues]

    def saved(self, words: list[str], name: str) -> tuple[int, float]:
        """The bytes by which the template as a dictionary reduces the compressed size of words, and their share of it."""
        raw = " ".join(words).encode()
        plain = len(self.plain.compress(raw))
        fewer = plain - len(self.with_dict[name].compress(raw))
        return fewer, fewer / plain

    def ends(self, seen: list[str], name: str) -> np.ndarray:
        """Places in `seen` where the template's wording may end: all words of it with at most the edits that it may have."""
        own, most = self.words[name], self.edits[name]
        if sum((Counter(own) - Counter(seen)).values()) > most:
            return np.zeros(0, np.int64)
        never, number = most + 1, {w: k for k, w in enumerate(dict.fromkeys(own))}
        codes = np.array([number.get(w, -1) for w in seen])
        added = np.concatenate([[0], np.cumsum([never if _numbered(w) else 1 for w in seen])])
        row = np.zeros(len(seen) + 1, np.int64)
        for word in own:
            new = row + (never if _numbered(word) else 1)
            np.minimum(new[1:], np.where(codes == number[word], row[:-1], 1 << 40), out=new[1:])
            row = np.minimum.accumulate(new - added) + added
        return np.flatnonzero(row <= most)

    def places(self, seen: list[str], name: str) -> list[tuple[int, int, int, int]]:
        """(begin, end, missing, added) of the template's wording within `seen`: no number or version may differ, and one word in eight.

        Words before and after it are free; places may overlap.
        """
        out, ends, reach = [], self.ends(seen, name).tolist(), len(self.words[name]) + self.edits[name]
        while ends:  # the ends of one place lie close together
            n = next((k for k in range(1, len(ends)) if ends[k] - ends[k - 1] > reach), len(ends))
            first = max(0, ends[0] - reach)
            out += [(first + a, first + b, *edits) for a, b, *edits in self._aligned(seen[first : ends[n - 1]], name)]
            ends = ends[n:]
        return out

    def _aligned(self, seen: list[str], name: str) -> list[tuple[int, int, int, int]]:
        own, most = self.words[name], self.edits[name]
        never = most + 1
        before = [(0, 0, j) for j in range(len(seen) + 1)]  # (edits, missing, begin) with the template's first words done, up to each place
        for word in own:
            drop = never if _numbered(word) else 1
            row = [(before[0][0] + drop, before[0][1] + 1, 0)]
            for j, other in enumerate(seen):
                ways = [(before[j + 1][0] + drop, before[j + 1][1] + 1, before[j + 1][2]), (row[j][0] + (never if _numbered(other) else 1), row[j][1], row[j][2])]
                if word == other:
                    ways.append(before[j])
                row.append(min(ways, key=lambda x: (x[0], x[1], -x[2])))
            before = row
        return [(begin, end, missing, edits - missing) for end, (edits, missing, begin) in enumerate(before) if edits <= most and begin < end]

    def saves(self, block: list[str], name: str) -> bool:
        """Whether the template as a dictionary saves anything of a block. The shortest cannot, and are always looked for."""
        return sum(map(len, self.words[name])) + len(self.words[name]) <= SHORT or self.saved(block, name)[0] > 0

    def notices(self, words: list[str]) -> list[tuple[int, str, float, int, int]]:
        """(place of the first word, template, reduction, missing, added) of all notices in a text's words, in order.

        A block reaches a template's length to both sides of each of its cues. Blocks of which the template saves anything
        are joined up where they overlap, and confirmed by wording, at the place of fewest edits. Of notices that overlap the
        one whose words its template reduces by most bytes is taken, then the one with most words in common, the first name.
        """
        spots: dict[str, list[int]] = {}
        for k, word in enumerate(words):
            for name in self.cues.get(word, ()):
                spots.setdefault(name, []).append(k)
        found = set()
        for name, at in spots.items():
            reach = len(self.words[name]) + self.edits[name]
            regions: list[list[int]] = []
            for k in at:
                begin, end = max(0, k + 1 - reach), k + reach
                if regions and begin < regions[-1][1] and k < regions[-1][1]:  # the cue lies in a region that is compared anyway
                    regions[-1][1] = end
                elif self.saves(words[begin:end], name):
                    regions.append([begin, end])
            for begin, end in regions:
                found |= {(missing + added, begin + a, begin + b, name, missing, added) for a, b, missing, added in self.places(words[begin:end], name)}
        ranked, closest = [], {}
        for _, a, b, name, missing, added in sorted(found):
            # of one template's places that overlap the one with fewest edits
            if not closest.setdefault(name, set()).isdisjoint(range(a, b)):
                continue
            closest[name].update(range(a, b))
            fewer, share = self.saved(words[a:b], name)
            ranked.append((-fewer, missing - len(self.words[name]) + added, missing + added, name, a, b, missing, added, share))
        ranked.sort()
        out, taken = [], set()
        for *_, name, a, b, missing, added, share in ranked:
            if taken.isdisjoint(range(a, b)):
                taken.update(range(a, b))
                out.append((a, name, share, missing, added))
        return sorted(out)


@cache
def scanner(templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES.items())) -> Scanner:
    return Scanner(dict(templates))


def notices(text: bytes, own: Scanner | None = None) -> list[dict]:
    """The notices of a text, with the line and the sentence of that line in which each begins."""
    own = own or scanner()
    low = text.lower()
    if not any(c in low for c in own.cue_bytes):
        return []
    plain = text.decode("utf-8", "replace")
    words = list(_WORD.finditer(plain))
    out = []
    for k, name, saved, missing, added in own.notices([w[0].lower() for w in words]):
        at = words[k].start()
        begin = plain.rfind("\n", 0, at) + 1
        out.append({"line": plain.count("\n", 0, at), "sentence": len(_SENTENCE.findall(plain[begin : at + 1])), "license": name, "reduction": saved, "missing": missing, "added": added})
    return out


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, notices): for each row of docs (doc_id, text) its license notices, in order.

    A notice has the line and sentence (from 0) in which it begins, license, reduction (share of the compressed size of
    its words saved by the template as a raw dictionary), missing and added words against the template. It may be
    wrapped over lines, stand within a longer sentence or beside others. Blocks of words around a template's cues are
    compressed with the template; where that saves anything they are compared word by word. `templates`: other
    wordings by name, of up to some hundred words. Null and empty texts have no
    notices; repeated rows have equal ones; a null doc_id stays null. Other columns are not read.
    """
    kind = pa.list_(pa.struct([("line", pa.int32()), ("sentence", pa.int32()), ("license", pa.string()), ("reduction", pa.float64()), ("missing", pa.int32()), ("added", pa.int32())]))

    wordings = tuple(templates.items())

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = scanner(wordings)
        found = [notices(text, own) for text in binary_lists(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "notices"])

    fields = "doc_id long, notices array<struct<line:int,sentence:int,license:string,reduction:double,missing:int,added:int>>"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, fields, by="text")
