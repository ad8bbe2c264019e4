"""Same or nearly the same requests on both sides of a split, by similarity-hash fingerprints.

A request's text is reduced to words and numbers (letter case, spacing, punctuation and the writing of numbers vanish).
Its features, the letter triples of each word and, with more weight, each number, are summed into a 64-bit similarity
hash, so that slips, filler and interchanged words move few bits and a change of order none.  Rows of the same words in
the same order form a class; classes of the two sides that have the same numbers are joined on segments of the hash
(``SEGMENTS``; no pair within ``SURE`` bits can be missed), kept within the Hamming ``RADIUS``, and verified: a ``Grammar``
reads both texts into conditions (field, comparison, value), which must be the same; where it cannot read one in
full, the declared pairs (where both have them) must be the same and the numbers with the words before each nearly so.  The vocabulary is an
argument and plays no part in the hash; copies of one text never meet each other in the join.  ``overlaps`` gives pairs
of rows, ``class_pairs`` classes, their members and the links between classes.

Defined results: null and blank prompts ask for nothing and match nothing; a null or untidy composition only
withholds a check; repeated rows are each reported; rows of a split that is neither side are ignored; a null
record type matches nothing; texts of any length are read whole; empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

SEGMENTS = [(6 * i - max(0, i - 4), 6 if i < 4 else 5) for i in range(12)]  # (first bit, width): 4 of 6 bits, 8 of 5
SURE = len(SEGMENTS) - 1
RADIUS = 24
SIMILAR = 0.8
NUMBER_WEIGHT, PIECE_WEIGHT = 6.0, 0.25
_TOKEN = re.compile(r"\d+(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+[.,]\d+|\.\d+|\d+|[^\W\d_][^\W_]*|!=|[<>]=?|[=≤≥≠]|,")
_PAIR = re.compile(r"([a-z0-9_]+)\s*:\s*([a-z]+)")


@dataclass(frozen=True)
class Grammar:
    """The closed vocabulary of requests.  Phrases are lower-case words; ``values`` only helps to mend slips."""

    fields: dict[str, list[str]]
    comparisons: dict[str, list[str]]
    values: list[str]
    filler: list[str]
    phrases: dict[tuple[str, ...], tuple[str, str]] = field(init=False)
    near: dict[str, list[str]] = field(init=False)
    known: frozenset[str] = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        phrases = {tuple(p.split()): ("field", f) for f, ps in self.fields.items() for p in ps} | {tuple(p.split()): ("op", o) for o, ps in self.comparisons.items() for p in ps} | {tuple(p.split()): ("filler", "") for p in self.filler}
        words = {w for p in phrases for w in p} | {w for v in self.values for w in v.split()}
        near: dict[str, list[str]] = {}
        for w in sorted(words):
            if len(w) > 3:
                for x in {w, *_shorter(w)}:
                    near.setdefault(x, []).append(w)
        for name, value in (("phrases", phrases), ("near", near), ("known", frozenset(words)), ("longest", max(map(len, phrases), default=1))):
            object.__setattr__(self, name, value)

    def mend(self, word: str) -> str:
        """The vocabulary word a slip away: two letters swapped, one lost or doubled, one changed; in long words two slips."""
        if word in self.known or len(word) < 3 or not word.isalpha():
            return word
        found = {w for x in (word, *_shorter(word)) for w in self.near.get(x, ()) if _slip(word, w)}
        if not found and len(word) > 5:
            once = {x[:i] + x[i + 1] + x[i] + x[i + 2 :] for x in (word, *_shorter(word)) for i in range(len(x) - 1)}
            found = {w for x in (*once, *(y for x in once for y in _shorter(x))) for w in self.near.get(x, ()) if len(w) > 5 and abs(len(w) - len(word)) < 2}
        return min(found, key=lambda w: (sorted(w) != sorted(word), len(w) == len(word), set(w) != set(word), w)) if found else word


def _shorter(w: str) -> list[str]:
    return [w[:i] + w[i + 1 :] for i in range(len(w))]


def _slip(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        at = [i for i in range(len(a)) if a[i] != b[i]]
        return len(at) < 2 or (len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return short in _shorter(long)


def number(text: str) -> str:
    if re.fullmatch(r"\d{1,3}(,\d{3})+(\.\d+)?", text) and not text.startswith("0,"):
        text = text.replace(",", "")
    return f"{Decimal(text.replace(',', '.')).normalize():f}"


@dataclass
class Request:
    conditions: list[tuple[str, str, str]]
    values: list[str]
    words: list[str]
    complete: bool


def read(prompt: str, grammar: Grammar, mended: dict[str, str]) -> Request:
    tokens = []
    for t in _TOKEN.findall(unicodedata.normalize("NFKC", prompt).lower()):
        if t[0].isalpha():
            if (m := mended.get(t)) is None:
                m = grammar.mend(t)
                if len(mended) < 200_000:
                    mended[t] = m
            t = m
        tokens.append(t)
    conditions, values, left = [], [], 0
    at, name, op, early = 0, "", "", None
    n = len(tokens)
    while at < n:
        t = tokens[at]
        if t[0].isdigit() or t[0] == ".":
            value = number(t)
            values.append(value)
            if name and op:
                conditions.append((name, op, value))
                name = op = ""
            elif op:
                early, op = (op, value), ""
            else:
                left += 1
            at += 1
            continue
        kind, what, size = "", "", 1
        for size in range(min(grammar.longest, n - at), 0, -1):
            if (hit := grammar.phrases.get(tuple(tokens[at : at + size]))) is not None:
                kind, what = hit
                break
        else:
            size = 1
        at += size
        if kind == "field":
            left += bool(name)
            name = what
            if early:
                conditions.append((name, *early))
                name, early = "", None
        elif kind == "op":
            op = what
            if name and op in ("eq", "ne"):
                begin = at
                while at < n and tokens[at] not in (",", "and", "with") and not (at > begin and any(tuple(tokens[at : at + s]) in grammar.phrases for s in range(1, grammar.longest + 1))):
                    at += 1
                value = " ".join(tokens[begin:at])
                if value:
                    value = number(value) if at == begin + 1 and value[0].isdigit() else value
                    values.append(value)
                    conditions.append((name, op, value))
                    name = op = ""
    return Request(sorted(conditions), sorted(values), sorted({t for t in tokens if t != ","}), bool(conditions) and not left and not name and not op and not early)


def signs(feature: str) -> np.ndarray:
    """64 signs from a hash of a feature."""
    return np.unpackbits(np.array([xxhash.xxh64_intdigest(feature)], dtype=np.uint64).view(np.uint8)).astype(np.float32) * 2 - 1


class Votes(dict):
    """What each word or number adds to the sum of its text's signs; remembered up to a size."""

    def __missing__(self, token: str) -> np.ndarray:
        if token[0].isalpha():
            whole = f"^{token}$"
            votes = PIECE_WEIGHT * np.sum([signs(whole[i : i + 3]) for i in range(len(whole) - 2)], axis=0)
        else:
            votes = NUMBER_WEIGHT * signs(f"number {token}")
        if len(self) < 100_000:
            self[token] = votes
        return votes


_PLAIN = re.compile(r"\d+(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+[.,]\d+|\.\d+|\d+|[^\W\d_][^\W_]*")


def plain(prompt: str) -> list[str]:
    """Words and numbers of a request, as compared."""
    return [t if t[0].isalpha() else number(t) if t.isascii() else t for t in _PLAIN.findall(unicodedata.normalize("NFKC", prompt).lower())]


def simhash(tokens: Iterable[str], votes: Votes) -> int:
    """64 bits of the sum of the votes of the distinct words and numbers."""
    held = [votes[t] for t in dict.fromkeys(tokens)]
    return int(np.packbits(np.sum(held, axis=0) > 0).view(np.int64)[0]) if held else 0


def placed(tokens: list[str]) -> list[str]:
    """Each word with the number it comes before, and each number: what the words say of which value."""
    out, value = set(), ""
    for t in reversed(tokens):
        if not t[0].isalpha():
            value = t
            out.add(t)
        elif value:
            out.add(f"{value} {t}")
    return sorted(out) or sorted(set(tokens))


def fingerprints(df: DataFrame, row_id: str, split: str, group: str, prompt: str, composition: str, grammar: Grammar) -> DataFrame:
    """Every readable row: id, split, group, hash of its words (cls) and of its numbers (vals), the 64-bit code, and what verification
    needs: conditions read (sig), whether they are complete, declared field:comparison pairs, words with their numbers."""
    src = df.select(F.col(row_id).cast("bigint"), F.col(split).cast("string"), F.col(group).cast("string"), F.col(prompt).cast("string"), F.col(composition).cast("string"))
    names = ["id", "split", "group", "cls", "vals", "code", "sig", "complete", "pairs", "placed"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mended: dict[str, str] = {}
        votes = Votes()
        for batch in batches:
            rows = []
            for row, side, kind, text, declared in zip(*(c.to_pylist() for c in batch.columns)):
                if row is None or side is None or kind is None or text is None or not (tokens := plain(text)):
                    continue
                r = read(text, grammar, mended)
                side, kind = side.strip().lower(), kind.strip().lower()
                pairs = sorted(f"{f}:{o}" for f, o, _ in r.conditions)
                stated = sorted(f"{f}:{o}" for f, o in _PAIR.findall(declared.lower())) if declared else None
                complete = r.complete and (not stated or stated == pairs)
                numbers = " ".join(sorted(t for t in tokens if not t[0].isalpha()))
                sig = "; ".join(" ".join(c) for c in r.conditions) if complete else " ".join(stated or [])
                whole = "\x01".join((kind, " ".join(tokens), sig, str(complete)))
                rows.append((row, side, kind, xxhash.xxh3_128_digest(whole), xxhash.xxh64_intdigest(numbers) - (1 << 63), simhash(tokens, votes), sig, complete, " ".join(stated) if stated else None, placed(tokens)))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return src.mapInArrow(run, "id bigint, split string, group string, cls binary, vals bigint, code bigint, sig string, complete boolean, pairs string, placed array<string>")


def _segments(code: Column) -> Column:
    return F.array(*(F.struct(F.lit(i).cast("byte").alias("no"), F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("short").alias("part")) for i, (shift, width) in enumerate(SEGMENTS)))


def class_pairs(prints: DataFrame, train: list[str], held_out: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members, links).  Members: side (0 train, 1 held out), cls, id.  Links: cls_0, cls_1, distance, one row a pair of classes that ask for
    the same; a text on both sides is linked to itself."""
    asks = ["sig", "complete", "pairs", "placed"]
    members = cut(prints.withColumn("side", F.when(F.col("split").isin(train), 0).when(F.col("split").isin(held_out), 1)).where("side is not null").drop("split"))
    classes = cut(members.groupBy("side", "cls").agg(*(F.first(c).alias(c) for c in ("group", "vals", "code", *asks))))
    # only ids and codes meet in the join; what a class asks for is fetched for the pairs within the radius
    cut_up = classes.select("side", "group", "vals", "cls", "code", F.explode(_segments(F.col("code"))).alias("s")).select("side", "group", "vals", "cls", "code", "s.no", "s.part")
    side = lambda n: cut_up.where(F.col("side") == n).drop("side").withColumnsRenamed({"cls": f"cls_{n}", "code": f"code_{n}"})
    met = side(0).join(side(1), ["group", "vals", "no", "part"])
    differ = F.col("code_0").bitwiseXOR(F.col("code_1"))
    earlier = reduce(lambda a, b: a | b, [(F.col("no") > i) & (F.shiftrightunsigned(differ, shift).bitwiseAND(F.lit((1 << width) - 1)) == 0) for i, (shift, width) in enumerate(SEGMENTS[:-1])])
    near = met.withColumn("distance", F.bit_count(differ)).where((F.col("distance") <= RADIUS) & ~earlier).select("cls_0", "cls_1", "distance")
    asked = lambda n: classes.where(F.col("side") == n).select(F.col("cls").alias(f"cls_{n}"), *(F.col(c).alias(f"{c}_{n}") for c in asks))
    known = near.join(asked(0), "cls_0").join(asked(1), "cls_1")
    alike = F.size(F.array_intersect("placed_0", "placed_1")) / F.size(F.array_union("placed_0", "placed_1")) >= SIMILAR
    same = F.when(F.col("complete_0") & F.col("complete_1"), F.col("sig_0") == F.col("sig_1")).otherwise(F.coalesce(F.col("pairs_0") == F.col("pairs_1"), F.lit(True)) & alike)
    return members.select("side", "cls", "id"), known.where(same).select("cls_0", "cls_1", "distance")


def overlaps(prints: DataFrame, train: list[str], held_out: list[str]) -> DataFrame:
    """(id_a, id_b, train_id, held_out_id, distance): every row of ``train`` splits with every held-out row that asks for the same; smaller id first."""
    members, links = class_pairs(prints, train, held_out)
    rows = lambda n: members.where(F.col("side") == n).select(F.col("cls").alias(f"cls_{n}"), F.col("id").alias(f"id_{n}"))
    out = rows(0).join(links, "cls_0").join(rows(1), "cls_1")
    return out.select(F.least("id_0", "id_1").alias("id_a"), F.greatest("id_0", "id_1").alias("id_b"), F.col("id_0").alias("train_id"), F.col("id_1").alias("held_out_id"), "distance")
