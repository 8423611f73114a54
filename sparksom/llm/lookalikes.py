"""One consistent form for texts that look the same, and the pairs of such texts.

The skeleton of a text follows the published confusables method: decompose canonically,
replace every character by its prototype, decompose again. Two texts look the same if
their skeletons are equal. The prototype of a character is

* nothing, where the character shows nothing: default-ignorable characters (zero-width,
  selectors, fillers, soft hyphens, marks of direction) and control characters except line
  ends. A zero-width joiner counts between pictographs and tags count after a flag, where
  they change what is shown, and so does the right-to-left override, which turns the order;
* a plain space, for any blank within a line (tabs, non-breaking, thin, ideographic ...);
* its compatibility decomposition, where that changes width or splits joined letters
  (full and half width, ligatures, presentation forms, Roman numerals ...) but not where
  it changes the looks (super- and subscripts, circled, fractions, font styles);
* the prototype of the published table of confusable characters of all scripts, as the
  ICU library in Spark's jars has it;
* else itself. Case, accents, digits, punctuation, the number of blanks and line ends stay.

"Visibly different stays different" demands exceptions from the table: characters of ASCII
never change (so l, 1, I and | stay apart, and 0 and O, and rn and m), look-alikes of several
go to the one of their kind (capital, small letter, digit or sign); combining marks,
spacing accents, quotation marks and dashes stay; an i without its dot (or another mark above) is
no i; letters and digits do not become signs, nor signs letters; and of prototypes of several
characters only those of a letter and its marks are taken.
"""
from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import lookup_join, materialize, release

#: Where shapes agree otherwise than the published table has it.
LOOKALIKES = {
    "ꓲ": "I", "ǀ": "|", "ǃ": "!", "ɩ": "ı", "ι": "ı", "ı": "ı", "ꙇ": "ı", "ɪ": "ı", "Ӕ": "Æ", "ӕ": "æ",
    "ӏ": "l", "Ԛ": "Q",
    "‐": "-", "\u2011": "-", "˗": "-", "ʼ": "’", "ʻ": "‘", "։": ":", "ː": ":",
    "\u06f0": "\u0660",  # the two Arabic zeros
}
#: Compatibility characters (ranges) that look like their decomposition.
JOINED = ((0xB5, 0xB5), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x587, 0x587), (0x2024, 0x2026),
          (0x2033, 0x2037), (0x203C, 0x203C), (0x2047, 0x2049), (0x2103, 0x2103), (0x2109, 0x2109),
          (0x2135, 0x2138), (0x2160, 0x217F), (0x222C, 0x2230), (0x2A74, 0x2A76), (0x2E9F, 0x2E9F),
          (0x2EF3, 0x2EF3), (0x2F00, 0x2FD5), (0x3131, 0x318E), (0xFB00, 0xFB17), (0xFB4F, 0xFB4F))
#: Kinds of compatibility decomposition that change the looks, and that keep them.
CHANGED_LOOKS = ("<font>", "<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>", "<small>")
SAME_LOOKS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Line ends, which count.
LINE_ENDS = "\n\r\x0b\x0c\x85\u2028\u2029"
#: A blank of another script that shows nothing, the override that turns the order.
FILLERS, TURNS = "\u2800", "\u202e"
#: A joiner between pictographs (a selector or a skin tone may follow the first), and the tags of a flag.
KEPT = re.compile("(?<=[^\\w\\s])\u200d(?=[^\\w\\s])|(?<=\U0001f3f4)[\U000e0020-\U000e007f]+")
JOINER = "\u200d"
#: A dotless i that has a mark above looks like an i that has it, and with a dot above like i.
DOTTED = re.compile("ı\u0307|ı(?=[\u0300-\u0306\u0308-\u0314])")
#: Surrogates, which no text of Arrow's can hold, stand for kept joiners and tags.
KEPT_JOINER, KEPT_TAGS = "\ud800", 0xD820 - 0xE0020
_BACK = {ord(KEPT_JOINER): JOINER, **{p + KEPT_TAGS: chr(p) for p in range(0xE0020, 0xE0080)}}


class Skeleton:
    """The consistent form of a text, a function: equal for texts that look the same.

    ``published`` has the prototypes of the published table that differ from a character's
    canonical decomposition, ``ignorable`` the ranges of characters that show nothing.
    """

    def __init__(self, published: dict[int, str], ignorable: list[tuple[int, int]]):
        self.published, self.ignorable = published, ignorable

    @classmethod
    def of(cls, spark: SparkSession) -> Skeleton:
        """With the tables of the session's ICU library, read once (some 0.5 s)."""
        context = spark.sparkContext
        known = getattr(context, "_sparksom_skeleton", None)
        if known is None:
            known = context._sparksom_skeleton = cls(*_published(context._jvm.com.ibm.icu.text))
        return known

    @cached_property
    def prototypes(self) -> _Prototypes:
        return _Prototypes(self)

    def __getstate__(self):
        return self.published, self.ignorable

    def __setstate__(self, state):
        self.published, self.ignorable = state

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.translate(self.prototypes)
        text = unicodedata.normalize("NFD", text)
        kept = JOINER in text or "\U0001f3f4" in text
        if kept:
            text = KEPT.sub(_stand_in, text)
        text = unicodedata.normalize("NFD", text.translate(self.prototypes))
        if "ı" in text:
            text = DOTTED.sub("i", text)
        return text.translate(_BACK) if kept else text

    def prototype(self, char: str) -> str:
        category, point = unicodedata.category(char), ord(char)
        if char in LINE_ENDS or char == TURNS or category == "Cs":
            return char
        if char == "\t" or category == "Zs":
            return " "
        if category == "Cc" or char in FILLERS or any(a <= point <= b for a, b in self.ignorable):
            return ""
        if char in LOOKALIKES:
            return LOOKALIKES[char]
        kind, *points = unicodedata.decomposition(char).split() or [""]
        if kind in SAME_LOOKS or (kind == "<compat>" and any(a <= point <= b for a, b in JOINED)):
            inner = unicodedata.normalize("NFD", "".join(chr(int(p, 16)) for p in points))
            return "".join(self.prototypes[ord(c)] for c in inner)
        if point < 128 or category[0] == "M" or category in ("Sk", "Pd", "Pi", "Pf") or kind in CHANGED_LOOKS:
            return char
        return self._shape(char, category)

    def _shape(self, char: str, category: str) -> str:
        shape = self.published.get(ord(char), char)
        size = 2 if shape.startswith("rn") else 1
        base, marks = shape[:size], shape[size:]
        ascii_ones = self._ascii.get(base, base if len(base) == 1 else "")
        if not ascii_ones or any(unicodedata.category(m)[0] != "M" for m in marks):
            return char
        wanted = "N" if category[0] == "N" else category if category in ("Lu", "Ll") else "S" if category[0] in "PS" else "Ll"
        base = next((c for c in ascii_ones if unicodedata.category(c).startswith(wanted)), ascii_ones[0])
        other_kind = category != "Lm" and (category[0] in "PS") != (unicodedata.category(base)[0] in "PS")
        if other_kind or base in "\"'`-":
            return char
        return (base if base == char else self.prototypes[ord(base)]) + marks

    @cached_property
    def _ascii(self) -> dict[str, str]:
        """Characters of ASCII by their common prototype."""
        out: dict[str, str] = {}
        for point in sorted(range(33, 127), key=lambda p: (chr(p).upper() == chr(p), not chr(p).isalpha(), p)):
            shape = self.published.get(point, chr(point))
            out[shape] = out.get(shape, "") + chr(point)
        return out


class _Prototypes(dict):
    """Code point to prototype, worked out when first asked for; for ``str.translate``."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton = skeleton

    def __missing__(self, point: int) -> str:
        result = self[point] = self.skeleton.prototype(chr(point))
        return result


def _published(icu) -> tuple[dict[int, str], list[tuple[int, int]]]:
    """Prototypes and ignorable ranges from the ICU library."""
    checker = getattr(icu, "SpoofChecker$Builder")().build()
    points = [p for p in range(0x80) if chr(p) != "\n"]
    points += [p for p in range(0x80, 0x110000) if unicodedata.category(chr(p)) not in ("Cn", "Cs", "Co")]
    table = {}
    for start in range(0, len(points), 20_000):
        some = points[start:start + 20_000]
        shapes = checker.getSkeleton("\n".join(map(chr, some))).split("\n")
        table.update((p, s) for p, s in zip(some, shapes, strict=True) if s != unicodedata.normalize("NFD", chr(p)))
    hidden = icu.UnicodeSet("[:Default_Ignorable_Code_Point:]")
    return table, [(hidden.getRangeStart(i), hidden.getRangeEnd(i)) for i in range(hidden.getRangeCount())]


def _stand_in(found: re.Match) -> str:
    text, at = found.string, found.start()
    if found.group() != JOINER:
        return "".join(chr(ord(c) + KEPT_TAGS) for c in found.group())
    while at and (text[at - 1] == "\ufe0f" or unicodedata.category(text[at - 1]) == "Sk"):
        at -= 1
    around = text[at - 1: at] + text[found.end()]
    return KEPT_JOINER if [unicodedata.category(c) for c in around] == ["So", "So"] else JOINER


def skeleton_column(df: DataFrame, text: str, out: str = "skeleton") -> DataFrame:
    """``df`` with the consistent form of ``text`` in its place, as column ``out``.

    Null stays null, empty stays empty. Whole texts, nothing shuffled, one Arrow pass.
    Another column already named ``out`` is replaced; all others pass through.
    """
    names = [c for c in df.columns if c not in (text, out)]
    skeleton = Skeleton.of(df.sparkSession)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + f", `{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [None if t is None else skeleton(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(forms, pa.string())], [*names, out])

    return df.select(*names, text).mapInArrow(run, schema)


def look_classes(df: DataFrame, item: str, text: str) -> DataFrame:
    """``item, look, text_key``: what each text looks like, and which text it is.

    Both keys are 128-bit digests (of the skeleton and of the text), so the rows that go
    on are narrow however long the texts. Null texts and texts without a visible
    character have no look and are left out.
    """
    kind, skeleton = df.schema[item].dataType.simpleString(), Skeleton.of(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, looks, keys = [], [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                form = skeleton(value) if value else ""
                if form and not form.isspace():
                    keep.append(i)
                    looks.append(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    keys.append(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            items = batch.column(item).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([items, pa.array(looks, pa.binary()), pa.array(keys, pa.binary())], ["item", "look", "text_key"])

    return df.select(item, text).mapInArrow(run, f"item {kind}, look binary, text_key binary")


def lookalike_pairs(df: DataFrame, item: str, text: str, part_rows: int = 10_000) -> DataFrame:
    """``a, b`` (a < b): the items whose texts differ but look the same, each pair once.

    ``df`` has each item once. Exact copies form one class of their look; only looks of
    at least two classes go on, and classes, not members, are paired. A pair of classes
    is then expanded to its members, a large class in parts of about ``part_rows``, so
    neither a look nor a class that a third of all texts share is ever in one task.
    """
    members = materialize(look_classes(df, item, text), "looks")
    classes = members.groupBy("look", "text_key").agg(F.count(F.lit(1)).alias("n"))
    several = classes.groupBy("look").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("look")
    classes = materialize(classes.join(several, "look", "left_semi"), "look-classes")
    parts = F.ceil(F.col("n") / F.lit(part_rows)).cast("int")
    inside = lookup_join(members, classes, ["look", "text_key"], "inner", salt_by="item").select(
        "item", "text_key", F.pmod(F.xxhash64("item"), parts).cast("int").alias("part"))
    inside = materialize(inside, "look-members")
    release(members)

    first, second = (classes.select("look", F.col("text_key").alias(f"key_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    pairs = first.join(second, "look").where("key_a < key_b")
    for side in "ab":
        last = F.ceil(F.col(f"n_{side}") / F.lit(part_rows)).cast("int") - 1
        one = inside.select(F.col("text_key").alias(f"key_{side}"), "part", F.col("item").alias(f"item_{side}"))
        pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), last))).join(one, [f"key_{side}", "part"]).drop("part")
    return pairs.select(F.least("item_a", "item_b").alias("a"), F.greatest("item_a", "item_b").alias("b"))
