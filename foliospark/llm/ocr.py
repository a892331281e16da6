"""Text of scanned pages: finding its noise and repairing it into paragraphs.

1. `layout` orders the tokens of a page into lines, by window functions over
   the page. `furniture_lines` finds running headers, footers and page numbers by
   their recurrence over the pages of a document; how such lines look is counted
   and decides the pages of documents too short for that. The last token of a
   text line that ends in a dividing mark and its follower are two halves.
   `text_words` does the same for texts without boxes, from their lines.
2. `lexicon` counts the words of all pages. Those that make up a share RARE of all
   words, and the frequent shapes of codes and numbers, become a vocabulary trie;
   the share bounds its size. The counts of all other words stay a table, from
   which `with_counts` joins them to the words to be judged.
3. `judge` decides each distinct word, or pair of halves, once: its path through
   the trie, or a bit-parallel Levenshtein automaton of it beyond distance 1,
   yields every vocabulary word within its distance: 1, and while no nearer word explains a
   rare word, 2 from six letters (names nine) and 3 from ten on. A word is misread
   if such a word is so much more frequent that the other can only be its
   distortion; among several candidates the words before and after decide in
   `paragraphs`, by the numbers of all adjacent pairs. Halves are judged by the
   joined word against the hyphenated one.
4. The judgements join the tokens again; hot words, which are in the vocabulary
   and sound, are taken out before by a broadcast of the vocabulary's spellings.

Look-alike and invisible characters are folded first and are no misreading.

Defined results: tokens of NULL text are left out, a token without boxes stays
in its line, repeated rows count once, empty tables and NULL texts give no rows.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm import canonical
from foliospark.session import saved

SPELLINGS = 50_000  # sound spellings broadcast at most; what isn't among them joins
RARE = 2e-6  # share of all words from which a word is in the vocabulary: at most its inverse, 500,000 words, can be
SOUND = 5e-4  # share of all words from which a word is sound whatever resembles it
COMMON = 1.5e-4  # share from which a word is no rarity,
COMMON_NAME = 2e-5  # and a name: a word that hardly occurs in lower case
RATIO = 8  # words so many times as frequent explain a rarity
COMMON_RATIO = 40  # and a word that is no rarity
FAR_RATIO = 20  # and a rarity at distance 2 or more
SHAPE = 2e-4  # share of all words from which the shape of a code is an established one

MARKS = "-¬–=‐‑－"
NOISE = re.compile(r"[\^~_|]")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_DIGIT = re.compile(r"\d")
_ALNUM = re.compile(r"[^\W_]")
# Characters that recognisers take for one another (fixed values): seen, meant.
CONFUSED = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("m", "rn"), ("d", "cl"), ("h", "li"), ("nn", "m"), ("fi", "h")]
_TO_DIGIT = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "!": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "b": "6", "G": "6", "B": "8", "g": "9", "q": "9"})
# Characters that look alike out of focus (fixed values): each group reads as its first.
_BLUR = str.maketrans({c: g[0] for g in ("oc0eađdơ@", "tfl1i!jI|", "hbk", "vyg9q", "nru", "s5", "z2", "6b") for c in g[1:] if not (g[0] == "6")})


@functools.cache
def _fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    return canonical.stand_ins(), canonical.look_alikes()


def fold(text: str) -> str:
    """A token without stand-ins, look-alikes, invisible characters and apart accents."""
    if text.isascii():
        return text
    plain, like = _fold_tables()
    out = "".join(plain.get(c, c) for c in text)
    letters = [c for c in out if c.isalpha()]
    foreign = [c for c in letters if "Ͱ" <= c < "԰"]
    if foreign and all(c in like for c in foreign) and (len(foreign) < len(letters) or len(letters) > 1 or _DIGIT.search(out)):
        out = "".join(like.get(c, c) for c in out)
    return unicodedata.normalize("NFC", out)


def core(text: str) -> str:
    """The word in a folded token, in lower case and without the punctuation around it."""
    return _EDGE.sub("", text).lower()


def blurred(word: str) -> str:
    """A word as it looks when out of focus: without accents, characters that look alike as one."""
    flat = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return flat.translate(_BLUR)


def shape(word: str) -> str:
    """The pattern of a code or number: runs of digits, and each letter's case."""
    return re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", re.sub(r"\d+", "9", word))


class Trie:
    """Words with counts; each node knows the highest count below it."""

    __slots__ = ("most", "count", "next")

    def __init__(self) -> None:
        self.most, self.count, self.next = 0, 0, {}

    def add(self, word: str, count: int) -> None:
        node = self
        node.most = max(node.most, count)
        for c in word:
            node = node.next.setdefault(c, Trie())
            node.most = max(node.most, count)
        node.count = count

    def near(self, word: str, distance: int, least: int) -> list[tuple[str, int]]:
        """All words of at least the count within the Levenshtein distance.

        The automaton of the word is a set of positions per number of errors,
        held as bits; a branch ends when no position is left or no word below
        it is frequent enough. For one error no automaton is needed: the words
        leave the path of this one at one node, and what follows must be alike.
        """
        if distance == 1:
            return self._near_one(word, least)
        m, bits = len(word), {}
        for i, c in enumerate(word):
            bits[c] = bits.get(c, 0) | 1 << i
        accept, full = 1 << m, (1 << m + 1) - 1
        start = tuple((1 << k + 1) - 1 for k in range(distance + 1))
        found, stack = [], [(self, start, "")]
        while stack:
            node, state, prefix = stack.pop()
            for c, child in node.next.items():
                if child.most < least:
                    continue
                b = bits.get(c, 0)
                old = state[0]
                new = (old & b) << 1
                after = [new]
                for r in state[1:]:
                    new = ((r & b) << 1 | old | old << 1 | new << 1) & full
                    after.append(new)
                    old = r
                if new:
                    if child.count >= least and new & accept:
                        found.append((prefix + c, child.count))
                    if child.next:
                        stack.append((child, tuple(after), prefix + c))
        return found

    def _near_one(self, word: str, least: int) -> list[tuple[str, int]]:
        found, node, m = {}, self, len(word)
        for i in range(m + 1):
            # here and the next character, which must follow one that is added or another in this place; none at the end
            same, after = word[i : i + 1], word[i + 1 : i + 2]
            for c, child in node.next.items():
                if child.most < least:
                    continue
                if (not same or same in child.next) and (n := child._count_of(word, i)) >= least:
                    found[word[:i] + c + word[i:]] = n
                if same and (not after or after in child.next) and (n := child._count_of(word, i + 1)) >= least:
                    found[word[:i] + c + word[i + 1 :]] = n
            if not same:
                break
            if (n := node._count_of(word, i + 1)) >= least:
                found[word[:i] + word[i + 1 :]] = n
            node = node.next.get(same)
            if node is None or node.most < least:
                break
        return list(found.items())

    def _count_of(self, word: str, start: int) -> int:
        """The count of what the word has from start on, below this node."""
        node = self
        for k in range(start, len(word)):
            node = node.next.get(word[k])
            if node is None:
                return 0
        return node.count


_SIGN = re.compile(r"[^\w!]|_")
_AS_DIGITS = "".join(sorted({chr(c) for c in _TO_DIGIT}))


def _signs(code: str) -> str:
    """The signs of a code or a shape, which no letter is taken for."""
    return "".join(_SIGN.findall(code))


@functools.cache
def _overlay(shape_: str) -> re.Pattern:
    """A pattern of what a shape looks like where letters stand for digits; every second group is a run of digits."""
    parts = re.split("(9)", shape_)
    letters = lambda part: "".join({"A": r"[^\W\d_]", "a": r"[^\W\d_]"}.get(c, re.escape(c)) for c in part)
    return re.compile("".join(f"([0-9{_AS_DIGITS}]+)" if n % 2 else f"({letters(x)})" for n, x in enumerate(parts)))


class Lexicon:
    """The vocabulary, established shapes and hyphenated words of a corpus."""

    def __init__(self, counts: dict[str, int], shapes: set[str], names: set[str], total: int | None = None):
        self.counts, self.shapes, self.names = counts, shapes, names
        self.by_signs: dict[str, list[str]] = {}
        for x in sorted(shapes):
            self.by_signs.setdefault(_signs(x), []).append(x)
        self.trie = Trie()
        for w, n in counts.items():
            self.trie.add(w, n)
        self.total = total or sum(counts.values()) or 1
        self.alike: dict[str, list[str]] = {}
        for w in counts:
            self.alike.setdefault(blurred(w), []).append(w)
        self.before_hyphen = {w.split("-")[0] for w, n in counts.items() if "-" in w and not _DIGIT.search(w)}
        self.known: dict[tuple[str, bool], list[str]] = {}
        self.others: dict[str, int] = {}  # counts of the words now judged that are not in the vocabulary

    def own(self, word: str) -> int:
        """How often the word occurs on all pages."""
        return self.counts.get(word) or self.others.get(word, 0)

    def others_in(self, a: str, b: str) -> list[str]:
        """The words outside the vocabulary whose counts the judgement of a token (b = '') or of two halves needs; codes have none."""
        if not b:
            words = {core(NOISE.sub("", fold(a)))}
        else:
            x, y = core(NOISE.sub("", fold(a).rstrip()[:-1])), core(NOISE.sub("", fold(b)))
            words = {x + y, f"{x}-{y}", y}
        return sorted(w for w in words if w and w not in self.counts and not _DIGIT.search(w))

    def candidates(self, word: str, name: bool = False) -> list[str]:
        """All vocabulary words of which this word can only be a distortion, most frequent first; none if it is sound.

        For a name, short names being alike, only words at distance 1 count.
        """
        got = self.known.get((word, name))
        if got is None:
            got = self.known[word, name] = self._candidates(word, name)
        return got

    def _candidates(self, word: str, name: bool) -> list[str]:
        own, n = self.own(word), len(word)
        if not word:
            return []
        if own >= max(20, SOUND * self.total):
            return []
        rare = own <= max(2, (COMMON_NAME if name or word in self.names else COMMON) * self.total)
        variants = {word.replace(a, b, 1) for a, b in CONFUSED if a in word}
        near = {v: self.counts[v] for v in variants if v in self.counts}
        if n > 1:
            near.update(self.trie.near(word, 1, 2 * max(1, own)))
        if n > 2:
            near.update({v: self.counts[v] for v in self.alike.get(blurred(word), ()) if self.counts[v] > 2 * own})
        near.pop(word, None)
        if sum(near.values()) < (RATIO if rare else COMMON_RATIO) * max(1, own):
            near = {}
        if not near and rare and n >= (9 if name else 6):
            least = max(3, FAR_RATIO * max(1, own))
            near = dict(self.trie.near(word, 2, least))
            for v in variants:
                near.update(self.trie.near(v, 1, least))
            if not near and n >= 10:
                near = dict(self.trie.near(word, 3, least))
            near.pop(word, None)
        return sorted(near, key=lambda w: (-near[w], w))

    def misread(self, text: str) -> tuple[bool, list[str]]:
        """Whether a folded token is misread, and what it may be instead."""
        if not _ALNUM.search(text):
            return False, []
        clean = NOISE.sub("", text)
        noisy = clean != text
        bare = _EDGE.sub("", clean)
        word = bare.lower()
        if any(ord(c) > 0x36F and c.isalpha() and not 0x1E00 <= ord(c) < 0x1F00 for c in word) or re.search(r"[²³₀-₉½¼¾]", word):
            return noisy, []
        digits, letters = len(_DIGIT.findall(word)), sum(c.isalpha() for c in word)
        if digits:
            if shape(bare) in self.shapes:
                return noisy, [word] if noisy else []
            if letters > digits and (got := self.candidates(word)):
                return True, got
            fixed = self.code(bare)
            return noisy or fixed is not None, [fixed] if fixed else []
        if word in self.counts and noisy:
            return True, [word]
        if bare.isupper() and 1 < len(bare) <= 4 and not noisy and not self.counts.get(word, 0):
            return (True, [f]) if (f := self.code(bare)) else (False, [])
        if re.fullmatch(r"[^\W\d_]([.'’\-][^\W\d_])*|[ivx]+", word) and not noisy and len(word) < 2:
            return False, []
        got = self.candidates(word, bare[:1].isupper() and bare[1:].islower())
        return noisy or bool(got), got

    def code(self, bare: str) -> str | None:
        """A code or number of an established shape that this one shows with letters for digits; the one with fewest changes.

        A shape is laid over the whole code, however many letters it has: runs
        of digits are matched by characters that look like digits.
        """
        if shape(bare) in self.shapes or not _DIGIT.search(bare):
            return None
        fits = []
        for s in self.by_signs.get(_signs(bare), ()):
            m = _overlay(s).fullmatch(bare)
            if m:
                new = "".join(g.translate(_TO_DIGIT) if n % 2 else g for n, g in enumerate(m.groups()))
                if new != bare and shape(new) == s:
                    fits.append((sum(x != y for x, y in zip(new, bare)), new))
        return min(fits)[1] if fits else None

    def halves(self, a: str, b: str) -> tuple[bool, bool, bool, list[str]]:
        """Of two folded halves: is the mark no part of the word, is the first, is the second misread, and the word or what it may be, best first."""
        first, second = a[:-1], b
        x, y = core(NOISE.sub("", first)), core(NOISE.sub("", second))
        whole, dashed = x + y, f"{x}-{y}"
        noisy = bool(NOISE.search(first)), bool(NOISE.search(second))
        n_whole, n_dashed = self.own(whole), self.own(dashed)
        if max(n_whole, n_dashed) > 0 and not (max(n_whole, n_dashed) < 3 and self.candidates(whole, first[:1].isupper())):
            return n_whole >= n_dashed, *noisy, [whole if n_whole >= n_dashed else dashed]
        to_whole = self.candidates(whole, first[:1].isupper()) if len(whole) > 3 else []
        to_dashed = [w for w in self.candidates(dashed) if "-" in w]
        if to_dashed and not any(len(w) >= len(whole) - 1 and "-" not in w for w in to_whole):
            good = to_dashed[0]
            head, _, tail = good.partition("-")
            return False, noisy[0] or head != x, noisy[1] or tail != y, to_dashed
        to_whole = [w for w in to_whole if "-" not in w]
        if to_whole:
            good = to_whole[0]
            ok_a, ok_b = good.startswith(x), good.endswith(y)
            if ok_a and ok_b:
                ok_b = False
            return True, noisy[0] or not ok_a, noisy[1] or not ok_b, to_whole
        alone = self.misread(second)[0] if y not in self.counts else False
        keeps = a[-1] in "-‐‑－" and (x in self.before_hyphen or bool(_DIGIT.search(x)) or x in self.counts and y in self.counts)
        return not keeps, noisy[0], noisy[1] or alone, [dashed if keeps else whole]


def _plainer() -> tuple[str, str]:
    """Characters and what they look like out of focus, for translate: accented Latin, wide and look-alike letters, by rule."""
    plain, like = _fold_tables()
    cps = [*range(0x21, 0x250), *range(0x1E00, 0x1F00), *(ord(c) for c in plain if len(c) == 1 and c < "\U00010000"), *(ord(c) for c in like)]
    seen, out = [], []
    for c in dict.fromkeys(chr(cp) for cp in cps):
        flat = blurred(fold_char(c, plain, like).lower())
        if len(flat) == 1 and flat != c and c.lower() == c:
            seen.append(c)
            out.append(flat)
    return "".join(seen), "".join(out)


def fold_char(c: str, plain: dict[str, str], like: dict[str, str]) -> str:
    c = plain.get(c, c)
    return like.get(c, c)


EDGE = 3  # lines at either end of a page whose beginnings and ends are compared; whole lines may recur anywhere
_DIGITS = ("oilzsbgq", "01125699")


PAGE = ["document_id", "page_index", "source"]
LINE = [*PAGE, "line"]


def page_lines(tokens: DataFrame) -> DataFrame:
    """Per line of a page: y0, its place from the top and among `lines`, its shift from the margin in heights, and its words in order.

    ws holds token_id, at (the number on the page) and text of each distinct token.
    """
    by_page = Window.partitionBy(*PAGE)
    order = by_page.orderBy("token_pos", "token_id")
    t = tokens.where("text is not null").select("token_id", *PAGE, "token_pos", "text", "x0", "y0", "y1")
    t = t.select("*", F.row_number().over(order).alias("at"), *(F.lag(c).over(order).alias(f"{c}_before") for c in ("token_id", "x0", "y0"))).where("at = 1 or token_id_before <> token_id")
    step = (F.abs(F.col("y0") - F.col("y0_before")) > 0.65 * (F.col("y1") - F.col("y0"))) | (F.col("x0") < F.col("x0_before") - 60)
    # no two rows of a page are equal in the order any more
    t = t.withColumn("line", F.sum(((F.col("at") == 1) | F.coalesce(step, F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lines = t.groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct("at", "token_id", "text"))).alias("ws"), F.min_by("y0", "at").alias("y0"), F.min_by("x0", "at").alias("x0"), F.min("x0").alias("least"), F.max(F.col("y1") - F.col("y0")).alias("height"))
    # what all lines of a page share is found from its lines, which are far fewer than its words
    lines = lines.withColumn("lines", F.max("line").over(by_page)).withColumn("left", F.min("least").over(by_page))
    shift = F.floor((F.col("x0") - F.col("left")) / (2 * F.greatest(F.col("height"), F.lit(1.0))))
    return lines.select(*LINE, "lines", "y0", F.least(F.coalesce(shift, F.lit(0)), F.lit(5)).cast("int").alias("shift"), "ws")


def _low(ws: Column) -> Column:
    """The words of a line in lower case, one below the other."""
    return F.lower(F.array_join(ws["text"], "\n"))


def _bare(low: Column) -> Column:
    """The same without marks and signs."""
    return F.regexp_replace(low, "[\\p{Cf}\\p{M}\\p{P}\\p{S}]+", "")


def _pattern(bare: Column, n_words: Column) -> Column:
    """The same out of focus, with each number as #."""
    seen, flat = _plainer()
    numbers = F.regexp_replace(bare, f"(?m)^{_NUMBER}$", "#")
    numbers = F.when(n_words <= 3, F.regexp_replace(numbers, "(?m)^(?:[oilzsbgq]{1,3}|[ivxl]+)$", "#")).otherwise(numbers)
    return F.regexp_replace(F.translate(numbers, seen.replace("#", ""), flat), "[^\\p{L}#\\n]+", "")


_NUMBER = "(?=[oilzsbgq]*[0-9])[0-9oilzsbgq]{1,4}"


def with_pattern(lines: DataFrame) -> DataFrame:
    return lines.withColumn("pattern", F.replace(_pattern(_bare(_low(F.col("ws"))), F.size("ws")), F.lit("\n"), F.lit("")))


def furniture_lines(lines: DataFrame) -> DataFrame:
    """document_id, page_index, source, line, kind of the lines that are running headers, footers or page numbers.

    A header or footer is known by its recurrence: at the same place from the
    same end of half the document's pages, and three at least, a line begins or
    ends with the same two words (both pages of two: with all of these pairs), or
    the line recurs as a whole, wherever it stands. A page number advances with
    the page. Where most lines recur, as in forms, only those that stand apart
    from their margin count. What such lines look like (end of the page, place
    from there, shift from the margin, a number's pattern or not) is counted
    over the documents of three pages or more, and decides lines of documents
    that are too short to show a recurrence.
    """
    below = F.col("lines") - F.col("line") + 1
    side = F.when((F.col("line") <= EDGE) & (F.col("line") <= below), "top").when(below <= EDGE, "bottom")
    e = lines.select(*LINE, side.alias("side"), F.least(F.col("line"), below).alias("rank"), "shift", F.size("ws").alias("n"), _low(F.col("ws")).alias("low"))
    edge = F.col("side").isNotNull()
    # only the ends of a page are put out of focus; of other lines the letters are compared
    e = e.withColumn("bare", F.when(edge, _bare(F.col("low"))))
    e = e.withColumn("parts", F.when(edge, _pattern(F.col("bare"), F.col("n"))))
    e = e.withColumn("value", F.when(edge, F.translate(F.regexp_extract("bare", f"(?m)^({_NUMBER})$", 1), *_DIGITS).try_cast("int")))
    e = e.withColumn("pattern", F.replace("parts", F.lit("\n"), F.lit(""))).withColumn("bones", F.filter(F.split("parts", "\n"), lambda b: (b != "#") & (b != "")))
    b = F.col("bones")
    key = lambda spot, of: F.struct(F.lit(spot).alias("spot"), of.alias("key"))
    none = F.array().cast("array<struct<spot:string,key:string>>")
    pair = lambda name, k: key("pair", F.concat_ws(" ", "side", "rank", F.lit(name), F.slice(b, k, F.lit(2))))
    numbered = F.regexp_count("pattern", F.lit("#")).between(1, 2) & F.col("value").isNotNull()
    ahead = key("ahead", F.concat_ws(" ", "side", F.col("value") - F.col("page_index")))
    whole = F.when(edge, F.array_join("bones", "")).otherwise(F.regexp_replace("low", "[^\\p{L}]+", ""))
    keys = F.concat(
        F.when(F.size(b) > 2, F.array(pair("start", F.lit(1)), pair("second", F.lit(2)), pair("end", F.size(b) - 1))).when(F.size(b) == 2, F.array(pair("start", F.lit(1)))).otherwise(none),
        F.when(numbered, F.array(ahead)).when(whole != "", F.array(key("whole", whole))).otherwise(none),
    )
    e = saved(e.select(*LINE, "side", "rank", "shift", "pattern", keys.alias("keys")), "edges")
    rows = e.select(*LINE, F.inline("keys"))
    pages = e.groupBy("document_id").agg(F.countDistinct("page_index").alias("pages"))
    # the keys that stand on many pages of their document are few: only these meet the lines again
    seen_on = rows.groupBy("document_id", "spot", "key").agg(F.countDistinct("page_index").alias("on")).where("on > 1")
    often = seen_on.join(pages, "document_id").where("on >= least(3, pages) and 2 * on >= pages and (spot <> 'whole' or on > 2)").select("document_id", "spot", "key")
    of = lambda spot: F.count_if(F.col("spot") == spot)
    found = rows.join(often, ["document_id", "spot", "key"]).groupBy(*LINE).agg(of("pair").alias("n_pair"), (of("whole") > 0).alias("again"), (of("ahead") > 0).alias("advances"))
    e = e.drop("keys").join(pages, "document_id").where("page_index is not null and source is not null").join(found, LINE, "left").where("side is not null or again")
    e = e.fillna({"n_pair": 0, "again": False, "advances": False})
    e = e.withColumn("recurs", F.col("again") | (F.col("n_pair") >= F.when(F.col("pages") > 2, 1).otherwise(3)))
    e = saved(e.select(*LINE, "pattern", "side", "rank", "shift", "pages", "advances", "recurs"), "evidence")
    # where most lines at the ends of a document's pages recur its pages are copies or forms: only what stands apart from their margin can be furniture
    copied = e.groupBy("document_id").agg((2 * F.count_if("recurs") > F.count("*")).alias("copied")).where("copied")
    e = e.join(copied, "document_id", "left").withColumn("recurs", F.col("recurs") & (F.col("copied").isNull() | (F.col("shift") > 0)))
    # at most a thousand patterns hold a thousandth of the advancing lines
    patterns = [r.pattern for r in frequent_patterns(e.where("advances")).collect()]
    known = F.array(*(F.lit(x) for x in patterns)).cast("array<string>")
    near = lambda p: (F.col("pattern") == p) | ((F.length(p) > 4) & (F.levenshtein("pattern", p, 1) >= 0))
    e = e.withColumn("numbered", F.col("advances") | F.contains("pattern", F.lit("#")) & F.exists(known, near))
    look = ["side", "rank", "shift", "numbered"]
    # a page number is furniture where it advances, another line where it recurs
    true = F.when(F.col("numbered"), F.col("advances")).otherwise(F.col("recurs"))
    looks = e.where("pages >= 3 and side is not null").groupBy(*look).agg(F.avg(true.cast("int")).alias("odds"))  # at most 72 rows
    e = e.join(F.broadcast(looks), look, "left").where(F.col("advances") | F.col("recurs") | (F.col("odds") >= 0.5))
    return e.select(*LINE, F.when(F.col("numbered"), "page_number").otherwise("header").alias("kind"))


def frequent_patterns(lines: DataFrame) -> DataFrame:
    """The patterns that a thousandth of the lines have: at most a thousand."""
    n = lines.groupBy("pattern").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all"))), F.col("n") * 1000 >= F.col("all")).select("pattern")  # one row


def layout(tokens: DataFrame) -> DataFrame:
    """The lines of all pages with their kind (body, header, page_number)."""
    lines = saved(page_lines(tokens), "lines")
    # a page has a few such lines; joined by page, so that the windows of a page that follow need no other shuffle
    kinds = furniture_lines(lines).groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("line", "kind"))).alias("kinds"))
    j = lines.select(*LINE, "y0", "ws").join(kinds, PAGE, "left")
    return j.withColumn("kind", F.coalesce(F.try_element_at("kinds", "line"), F.lit("body"))).drop("kinds")


def with_halves(lines: DataFrame) -> DataFrame:
    """Lines with what a division at their ends needs: splits (the last word is a first half), next (its mate), open (the half before).

    The last word of a body line that ends in a dividing mark and the first of the next body line are halves.
    """
    # one column, so that all windows share one order
    order = Window.partitionBy(*PAGE, "body").orderBy("line")
    l = lines.withColumn("body", F.col("kind") == "body").withColumn("first", F.try_element_at("ws", F.lit(1))["text"]).withColumn("last", F.try_element_at("ws", F.lit(-1))["text"])
    marked = F.col("body") & F.regexp_replace("last", "\\p{Cf}", "").rlike(f"[\\p{{L}}\\p{{N}}][{MARKS}]$")
    l = l.withColumn("marked", F.coalesce(marked, F.lit(False)))
    l = l.select("*", F.lead("first").over(order).alias("next_word"), F.lag("last").over(order).alias("prev_word"), F.lag("marked").over(order).alias("follows"))
    splits, opened = F.col("marked") & F.col("next_word").isNotNull(), F.col("follows") & F.col("first").isNotNull()
    return l.select(*LINE, "y0", "kind", splits.alias("splits"), F.when(opened, F.col("prev_word")).alias("open"), F.when(splits, F.col("next_word")).alias("next"), "prev_word", "next_word", "ws")


def words_of(lines: DataFrame) -> DataFrame:
    """Per word of `with_halves`: token_id, at, line, y0, kind, text, role (0 whole, 1 first half, 2 second half) and its mate."""
    w = lines.select(*LINE, "y0", "kind", "splits", "open", "next", F.size("ws").alias("n"), F.posexplode("ws").alias("k", "w"))
    first, second = F.col("splits") & (F.col("k") == F.col("n") - 1), F.col("open").isNotNull() & (F.col("k") == 0)
    role = F.when(first, 1).when(second, 2).otherwise(0)
    return w.select("w.token_id", *PAGE, "w.at", "line", "y0", "kind", "w.text", role.alias("role"), F.when(first, F.col("next")).when(second, F.col("open")).otherwise("").alias("mate"))


def _halves(words: DataFrame) -> DataFrame:
    """a, b per token: the token itself and '', or the two halves in order."""
    a = F.when(F.col("role") == 2, F.col("mate")).otherwise(F.col("text"))
    b = F.when(F.col("role") == 2, F.col("text")).otherwise(F.col("mate"))
    return words.withColumn("a", a).withColumn("b", b)


def _keys(words: DataFrame) -> DataFrame:
    """The same of body tokens."""
    return _halves(words.where("kind = 'body'"))


def word_counts(types: DataFrame) -> DataFrame:
    """word, shape, n, lower of the distinct words a (b = '') with their counts n, folded; a code has no word, other words no shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, shapes, lower = [], [], []
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = _EDGE.sub("", fold(text))
                coded = bool(_DIGIT.search(w))
                words.append("" if coded else w.lower())
                shapes.append(shape(w) if coded else "")
                lower.append(n if w[:1].islower() else 0)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(shapes, pa.string()), batch.column(1), pa.array(lower, pa.int64())], names=["word", "shape", "n", "lower"])

    return types.where("b = ''").select("a", "n").mapInArrow(run, "word string, shape string, n bigint, lower bigint").groupBy("word", "shape").agg(F.sum("n").alias("n"), F.sum("lower").alias("lower"))


def lexicon(cores: DataFrame) -> Lexicon:
    """The lexicon of `word_counts`.

    Words and shapes come to the driver from a share of all words on, so that
    arithmetic bounds their number (1 / RARE and 1 / SHAPE), whatever the corpus.
    """
    total = cores.agg(F.sum("n")).first()[0] or 1
    words = cores.where((F.col("word") != "") & (F.col("n") >= RARE * total)).groupBy("word").agg(F.sum("n").alias("n"), F.sum("lower").alias("lower")).collect()
    shapes = cores.where((F.col("shape") != "") & (F.col("n") >= max(5, SHAPE * total))).select("shape").distinct().collect()
    return Lexicon({r.word: r.n for r in words}, {r.shape for r in shapes}, {r.word for r in words if r.lower < 0.3 * r.n}, total)


def _own(shared: Broadcast) -> Lexicon:
    """The lexicon of a broadcast, built once in each Python worker and kept with the broadcast."""
    if not hasattr(shared, "lexicon"):
        shared.lexicon = Lexicon(*shared.value)
    return shared.lexicon


def with_counts(types: DataFrame, lex: Lexicon, cores: DataFrame) -> DataFrame:
    """a, b of distinct words or pairs of halves, and others: the counts of the words in them that are not in the vocabulary."""
    shared = types.sparkSession.sparkContext.broadcast((lex.counts, lex.shapes, lex.names, lex.total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(shared)
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            asked = [own.others_in(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(asked, pa.list_(pa.string()))], names=["a", "b", "asked"])

    asked = types.select("a", "b").mapInArrow(run, "a string, b string, asked array<string>").select("a", "b", F.explode_outer("asked").alias("word"))
    counted = asked.join(cores.where("word <> ''").select("word", "n"), "word", "left")
    # few bytes but much work a row: a fixed number of partitions isn't coalesced
    counted = counted.repartition(int(types.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    return counted.groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n")))).alias("others"))


def judge(types: DataFrame, lex: Lexicon, cores: DataFrame) -> DataFrame:
    """a, b, hyphen, wrong_a, wrong_b, better of each distinct word or pair of halves that shows noise."""
    shared = types.sparkSession.sparkContext.broadcast((lex.counts, lex.shapes, lex.names, lex.total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(shared)
        for batch in batches:
            rows = []
            own.known = {}
            own.others = dict(pair for counts in batch.column(2).to_pylist() for pair in counts)
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b:
                    hyphen, wa, wb, good = own.halves(fold(a).rstrip(), fold(b))
                    rows.append((a, b, hyphen, wa, wb, good))
                else:
                    wrong, better = own.misread(fold(a))
                    if wrong:
                        rows.append((a, b, False, True, False, better))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["a", "b", "hyphen", "wrong_a", "wrong_b", "better"])

    return with_counts(types, lex, cores).mapInArrow(run, "a string, b string, hyphen boolean, wrong_a boolean, wrong_b boolean, better array<string>")


class Pages:
    """The words of all pages, with boxes or not, and the judgement of each distinct word; kept in the shared folder.

    Pages without boxes are texts of a few pages, by id; they share the lexicon
    and the judgements, but only pages with boxes are counted.
    """

    def __init__(self, tokens: DataFrame, texts: DataFrame | None = None):
        lines = saved(with_halves(layout(tokens)), "halves")
        self.lines = lines.withColumn("src", F.lit("page"))
        self.words = words_of(lines).withColumn("src", F.lit("page"))
        types = saved(_keys(self.words).where("role < 2").groupBy("a", "b").agg(F.count("*").alias("n")), "types")
        counted = types
        if texts is not None:
            patterns = [r.pattern for r in frequent_patterns(with_pattern(lines.where("kind = 'page_number'"))).collect()]
            more = saved(with_halves(text_lines(texts, header_wordings(lines, types), patterns)), "text-halves")
            self.lines = self.lines.unionByName(more.withColumn("src", F.lit("text")))
            more = words_of(more).withColumn("src", F.lit("text"))
            self.words = self.words.unionByName(more)
            types = saved(types.unionByName(_keys(more).where("role < 2").groupBy("a", "b").agg(F.lit(0).cast("bigint").alias("n"))).groupBy("a", "b").agg(F.sum("n").alias("n")), "all-types")
        self.counts = saved(word_counts(counted), "counts")
        self.lexicon = lexicon(self.counts)
        self.judged = saved(judge(types, self.lexicon, self.counts), "judged")
        # spellings that are sound and frequent: what joins afterwards is the rest
        bad = self.judged.where("b = ''").select("a")
        self.sound = types.where("b = ''").orderBy(F.desc("n"), "a").limit(SPELLINGS).join(bad, "a", "left_anti").select("a")

    def noise(self) -> DataFrame:
        """src (page or text), its page, line, token_id, at, role, noise, better of every noisy token; token_id is the id of a text."""
        key = ["src", *LINE, "token_id", "at"]
        body = F.col("kind") == "body"
        words = _halves(self.words).select(*key, "kind", "role", "a", "b")
        sound = F.broadcast(self.sound.select(F.col("a").alias("s")))  # at most SPELLINGS rows
        rest = words.join(sound, (F.col("a") == F.col("s")) & (F.col("role") == 0) & body, "left_anti")
        j = rest.join(self.judged, ["a", "b"], "left")
        wrong = F.when(F.col("role") == 2, F.col("wrong_b")).otherwise(F.col("wrong_a"))
        kinds = F.when(body, F.array_compact(F.array(F.when(F.col("hyphen") & (F.col("role") == 1), F.lit("hyphen")), F.when(wrong, F.lit("misread"))))).otherwise(F.array("kind"))
        return j.select(*key, "role", F.explode(kinds).alias("noise"), F.when(body, F.col("better")).alias("better"))

    def found(self) -> DataFrame:
        """src, row_id (token or text) and noise, distinct."""
        return self.noise().select("src", F.col("token_id").alias("row_id"), "noise").distinct()

    def paragraphs(self) -> DataFrame:
        """src, document_id, page_index, source, paragraph, text: the repaired pages and texts in continuous paragraphs.

        A new paragraph begins where the distance between lines is clearly
        larger than the page's usual one, or after a blank line of a text, but
        not within an open sentence. A page has a bounded number of tokens. Of
        texts, document_id is the id.
        """
        page = ["src", *PAGE]
        key = [*page, "line", "at", "role"]
        body = self.lines.where("kind = 'body'")
        marks = self.noise().where("noise = 'hyphen' or noise = 'misread'").groupBy(*key).agg(F.max("better").alias("better"), F.bool_or(F.col("noise") == "hyphen").alias("hyphen"), F.bool_or(F.col("noise") == "misread").alias("wrong"))
        marks = saved(marks, "marks")
        # what stands before and after a word with several candidates; a half has context on its outer side only
        asked = marks.where("size(better) > 1").select(*key, "better")
        near = asked.join(body.select(*page, "line", "ws", "prev_word", "next_word"), [*page, "line"])
        k = F.array_position(F.transform("ws", lambda w: w["at"]), F.col("at")).cast("int")
        text = lambda i: F.when(i > 0, F.try_element_at("ws", F.greatest(i, F.lit(1)))["text"])
        before = F.when(F.col("role") != 2, F.lower(F.coalesce(text(k - 1), F.col("prev_word"))))
        after = F.when(F.col("role") != 1, F.lower(F.coalesce(text(k + 1), F.col("next_word"))))
        wrong = near.select(*key, before.alias("before"), after.alias("after"), F.posexplode("better").alias("rank", "word"))
        # only the few pairs that are asked for are looked up among all pairs
        pairs = wrong.select(F.col("before").alias("x"), F.col("word").alias("y")).unionByName(wrong.select(F.col("word").alias("x"), F.col("after").alias("y"))).distinct().join(self._bigrams(body), ["x", "y"])
        left = wrong.join(pairs.select(F.col("x").alias("before"), F.col("y").alias("word"), F.col("n").alias("n1")), ["before", "word"], "left")
        both = left.join(pairs.select(F.col("x").alias("word"), F.col("y").alias("after"), F.col("n").alias("n2")), ["word", "after"], "left")
        best = F.max_by("word", F.struct(F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0)), -F.col("rank")))
        chosen = both.groupBy(*key).agg(best.alias("chosen"))
        fixes = marks.join(chosen, key, "left").select(*page, F.struct("at", "hyphen", "wrong", F.coalesce("chosen", F.try_element_at("better", F.lit(1))).alias("chosen")).alias("f"))
        fixes = fixes.groupBy(*page).agg(F.collect_list("f").alias("fixes"))
        # all words go to their page once, line by line; the few repairs meet them there
        pages = body.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("line", "y0", "splits", F.col("open").isNotNull().alias("opened"), F.transform("ws", lambda w: F.struct(w["at"].alias("at"), w["text"].alias("text"))).alias("ws")))).alias("lines"))
        pages = pages.join(fixes, page, "left")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples():
                    fixed = {f["at"]: f for f in (r.fixes if r.fixes is not None else [])}
                    out += [(r.src, r.document_id, r.page_index, r.source, n, text) for n, text in enumerate(reflow(list(page_words(r.lines, fixed))))]
                yield pd.DataFrame(out, columns=[*page, "paragraph", "text"])

        return pages.mapInPandas(run, "src string, document_id string, page_index int, source string, paragraph int, text string")

    def _bigrams(self, body: DataFrame) -> DataFrame:
        """All pairs of adjacent words of pages, over the ends of lines too, in lower case, with their number."""
        texts = F.concat(F.transform("ws", lambda w: F.lower(w["text"])), F.when(F.col("next_word").isNotNull(), F.array(F.lower("next_word"))).otherwise(F.array().cast("array<string>")))
        zipped = F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("x"), F.slice("t", F.lit(2), F.size("t") - 1).alias("y"))
        w = body.where("src = 'page'").select(texts.alias("t")).where("size(t) > 1").select(F.explode(zipped).alias("p"))
        return w.groupBy("p.x", "p.y").agg(F.count("*").alias("n"))


def page_words(lines: list[dict], fixed: dict[int, dict]) -> Iterator[dict]:
    """The words of a page in order, each with its role and its repair."""
    for l in lines:
        for k, w in enumerate(l["ws"]):
            role = 1 if l["splits"] and k == len(l["ws"]) - 1 else 2 if l["opened"] and k == 0 else 0
            f = fixed.get(w["at"]) or {"hyphen": None, "wrong": None, "chosen": None}
            yield {"line": l["line"], "y0": l["y0"], "text": w["text"], "role": role, "hyphen": f["hyphen"], "wrong": f["wrong"], "chosen": f["chosen"]}


def recased(seen: str, good: str) -> str:
    """A vocabulary word in the case and punctuation of the token it replaces."""
    body = _EDGE.sub("", seen)
    head, _, tail = seen.partition(body) if body else ("", "", "")
    tail = re.sub(r"[\^~_|]", "", tail)
    word = good.upper() if len(body) > 1 and body.isupper() else good[:1].upper() + good[1:] if body[:1].isupper() else good
    return re.sub(r"[\^~_|!]", "", head) + word + tail


def reflow(words: list[dict]) -> list[str]:
    """Paragraphs of one page from its words in order, halves joined, misreadings replaced."""
    tops: dict[int, float] = {}
    for w in words:
        if w["y0"] is not None:
            tops.setdefault(w["line"], w["y0"])
    lines = sorted(tops)
    gaps = sorted(b - a for a, b in zip((tops[i] for i in lines), (tops[i] for i in lines[1:])))
    usual = gaps[len(gaps) // 2] if gaps else 0.0
    out: list[list[str]] = []
    last_line, open_half = None, None
    for w in words:
        line, text = w["line"], fold(w["text"]).strip()
        gap = line in tops and last_line in tops and tops[line] - tops[last_line] > 1.35 * usual
        if gap and out and out[-1] and text[:1].islower() and not re.search(r"[.!?:;。！？…]['\"”’)\]]*$", out[-1][-1]):
            gap = False  # an open sentence goes on
        if line != last_line and (last_line is None or (gap and open_half is None)):
            out.append([])
        last_line = line
        if w["role"] == 1:
            open_half = w
            continue
        if w["role"] == 2 and open_half is not None:
            first = fold(open_half["text"]).strip()
            first = first[:-1] if open_half["hyphen"] else first
            tail = re.search(r"[\W_]*$", text).group()
            good = open_half["chosen"] or w["chosen"]
            text = recased(first, good) + tail if good and core(first + text) != good and (open_half["wrong"] or w["wrong"]) else NOISE.sub("", first + text)
        elif w["wrong"] and w["chosen"]:
            text = recased(text, w["chosen"])
        elif w["wrong"]:
            text = NOISE.sub("", text)
        open_half = None
        if text:
            out[-1].append(text)
    return [" ".join(p) for p in out if p]


def documents(paragraphs: DataFrame) -> DataFrame:
    """document_id, source, paragraph, first_page, last_page, text: paragraphs that run over page ends put together.

    A page's last paragraph goes on where it ends in no closing mark and the
    next page begins in lower case. How far a run of such pages reaches is found
    in blocks of pages, then over the blocks, so no document comes into one task.
    """
    page = ["document_id", "source", "page_index"]
    p = paragraphs.withColumn("open", ~F.col("text").rlike("[.!?:;。！？…]['\"”’)\\]]*\\s*$")).withColumn("goes_on", F.col("text").rlike("^[\\p{Ll}]"))
    ends = p.groupBy(*page).agg(F.max_by("open", "paragraph").alias("open"), F.min_by("goes_on", "paragraph").alias("goes_on"), F.max("paragraph").alias("last"))
    before = ends.select("document_id", "source", (F.col("page_index") + 1).alias("page_index"), F.col("open").alias("open_before"), F.col("last").alias("last_before"))
    e = ends.join(before, page, "left").withColumn("joins", F.coalesce(F.col("open_before") & F.col("goes_on"), F.lit(False)))
    # a page of one paragraph that joins passes the beginning on; all others begin anew
    begins = F.when(~(F.col("joins") & (F.col("last") == 0)), F.struct("page_index", "last"))
    e = e.withColumn("block", F.floor(F.col("page_index") / 1024))
    inside = Window.partitionBy("document_id", "source", "block").orderBy("page_index")
    e = e.withColumn("own", F.last(begins, True).over(inside))
    blocks = e.groupBy("document_id", "source", "block").agg(F.max_by("own", "page_index").alias("end"))
    blocks = blocks.withColumn("carried", F.last("end", True).over(Window.partitionBy("document_id", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    e = e.join(blocks.drop("end"), ["document_id", "source", "block"]).withColumn("start", F.coalesce("own", "carried"))
    start_before = e.select("document_id", "source", (F.col("page_index") + 1).alias("page_index"), F.col("start").alias("start_before"))
    e = e.join(start_before, page, "left").select(*page, "joins", "start_before")
    j = p.join(e, page)
    first = F.col("joins") & (F.col("paragraph") == 0)
    j = j.withColumn("home", F.when(first, F.col("start_before")).otherwise(F.struct("page_index", F.col("paragraph").alias("last"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "paragraph", "text"))), lambda x: x["text"]), " ")
    return j.groupBy("document_id", "source", "home").agg(text.alias("text"), F.max("page_index").alias("last_page")).select("document_id", "source", F.col("home.page_index").alias("first_page"), F.col("home.last").alias("paragraph"), "last_page", "text")


_ROMAN = re.compile(r"[ivxl]+", re.I)
_LOOSE = re.compile(r"[oilzsbgq]{1,3}|[ivxl]+")
_STRICT = re.compile(r"(?=.*[0-9])[0-9oilzsbgq]{1,4}")
_SIGNED = re.compile(r"\s*[-–—|]\s*\S+\s*[-–—|]\s*")


@functools.lru_cache(1 << 16)
def _folded(word: str) -> str:
    return fold(word)


@functools.lru_cache(1 << 16)
def _bone(word: str) -> str:
    return re.sub(r"[\W\d_]+", "", blurred(word.lower()))


def _distance_at_most(a: str, b: str, k: int) -> bool:
    if a == b:
        return True
    # what both begin and end with doesn't count, and letters that only one has must be edited
    n = len(commonprefix((a, b)))
    a, b = a[n:], b[n:]
    n = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - n], b[: len(b) - n]
    if abs(len(a) - len(b)) > k or max((Counter(a) - Counter(b)).total(), (Counter(b) - Counter(a)).total()) > k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > k:
            return False
    return row[-1] <= k


def line_pattern(line: str) -> tuple[str, int | None]:
    """A folded line's words out of focus with its numbers as #, and its first number: the pattern of `page_lines`."""
    out, first = [], None
    words = line.split()
    for w in words:
        part, value = _part(w, len(words) <= 3)
        out.append(part)
        first = value if first is None else first
    return "".join(out), first


@functools.lru_cache(1 << 16)
def _part(word: str, loose: bool) -> tuple[str, int | None]:
    """A word out of focus, or # and the number it may be."""
    bare = re.sub(r"[\W_]+", "", word.lower())
    if _STRICT.fullmatch(bare):
        return "#", int(bare.translate(_TO_DIGIT))
    return ("#", None) if loose and _LOOSE.fullmatch(bare) else (_bone(word), None)


def furniture(lines: list[str], worded: set[int], patterns: frozenset[str]) -> dict[int, str]:
    """Line number to 'header' or 'page_number' of the lines of one to four pages without boxes.

    A page number has the pattern of the corpus's page numbers with words or
    signs; a bare number is one at an end, beside a header, or where it continues
    another. A header recurs among the lines, or stands at an end or beside a
    page number and has the wording of the corpus's headers (`worded`).
    Recurrence is found by keys of a line's words, each line being compared
    with the last one of the same key, so that the work grows with the lines.
    """
    full = [i for i, x in enumerate(lines) if x.strip()]
    if not full:
        return {}
    out: dict[int, str] = {}
    pattern, value = {}, {}
    for i in full:
        pattern[i], value[i] = line_pattern(lines[i])
    near_pattern = lambda p: p in patterns or len(p) > 4 and any(len(q) > 4 and _distance_at_most(p, q, 1) for q in patterns)
    bare, wordy = [], {}
    for i in full:
        p = pattern[i]
        if 1 <= p.count("#") <= 2:
            if p == "#" * len(p):
                if _SIGNED.fullmatch(lines[i]) or "/" in lines[i]:
                    out[i] = "page_number"
                elif p == "#":
                    bare.append(i)
            elif near_pattern(p):
                out[i] = "page_number"
            else:
                wordy.setdefault(p, []).append(i)
    for same in wordy.values():  # a pattern of its own whose number goes on from line to line
        if len(same) > 1 and all(value[i] is not None for i in same) and all(0 < value[b] - value[a] <= 3 for a, b in zip(same, same[1:])) and len(pattern[same[0]]) <= 12:
            out.update(dict.fromkeys(same, "page_number"))
    closed = re.compile(r"[.;]\s*$")
    place = {i: n for n, i in enumerate(full)}
    near = lambda i: [full[place[i] + d] for d in (-1, 1) if 0 <= place[i] + d < len(full)]
    follower = {i: lines[j].split()[:2] for i, j in zip(full, full[1:])}
    last: dict[tuple, int] = {}
    whole: dict[int, str] = {}
    for i in full:
        if i in out or i in bare or closed.search(lines[i]):
            continue
        words = [b for w in lines[i].split() if (b := _bone(w))]
        bones = whole[i] = "".join(words)
        if not bones or (len(bones) < 5 and i not in (full[0], full[-1]) and not any(out.get(j) == "page_number" for j in near(i))):
            continue
        k = max(1, len(bones) // 6)
        for key in {("all", bones), ("start", *words[:2]), ("end", *words[-2:]), ("middle", *words[1:3]), ("outer", words[0], words[-1], len(words))}:
            j = last.get(key)
            last[key] = i
            if j is None or i - j < 2:
                continue
            # a repeated sentence goes on alike, below a running header the text differs
            alike = i in follower and j in follower and follower[i] == follower[j] and i not in worded
            if not alike and _distance_at_most(bones, whole[j], k):
                out[i] = out[j] = "header"
    numbers = [i for i in bare if value[i] is not None]
    runs = {x for a, b in zip(numbers, numbers[1:]) if 0 < value[b] - value[a] <= 3 for x in (a, b)}
    for i in bare:
        roman = bool(_ROMAN.fullmatch(lines[i].strip())) and not _DIGIT.search(lines[i])
        if i in runs or roman or i in (full[0], full[-1]) or any(out.get(j) == "header" for j in near(i)):
            out[i] = "page_number"
    for i in full:
        if i in worded and i not in out and not closed.search(lines[i]) and (i in (full[0], full[-1]) or any(out.get(j) == "page_number" for j in near(i))):
            out[i] = "header"
    return out


def _wording(text: Column) -> Column:
    """Words, one below the other, as headers are compared by: out of focus, numbers and codes as #, signs as they are."""
    seen, flat = _plainer()
    low = F.lower(F.regexp_replace(text, "[\\p{Cf}\\p{M},.^~_]+", ""))
    return F.translate(F.regexp_replace(low, "(?md)^[^\\n0-9]*+[0-9][^\\n]*+", "#"), seen, flat)


def header_wordings(lines: DataFrame, types: DataFrame) -> DataFrame:
    """x: words that headers hold far more often than text does; types are the distinct words of pages with their numbers."""
    header = lines.where("kind = 'header'").select(F.explode(F.transform("ws", lambda w: w["text"])).alias("a")).groupBy("a").agg(F.count("*").alias("h"), F.lit(0).cast("bigint").alias("b"))
    body = types.where("b = ''").select("a", F.lit(0).cast("bigint").alias("h"), F.col("n").alias("b"))
    n = header.unionByName(body).groupBy(_wording(F.col("a")).alias("x")).agg(F.sum("h").alias("h"), F.sum("b").alias("b"))
    return n.where("h > 3 * b + 1 and x <> '#' and x <> ''").select("x")


def text_lines(texts: DataFrame, wordings: DataFrame, patterns: list[str]) -> DataFrame:
    """The lines of texts that come without boxes, in the form of `layout`: token_id is the text's id.

    texts has id and text. Lines that may be headers (at an end, or beside a
    line with few letters and a number) learn from a join with the wordings
    whether they have the wording of headers. y0 numbers the lines that are left
    without furniture, blank ones too.
    """
    t = texts.where("text is not null").select(F.col("id").cast("bigint").alias("id"), "text").distinct()
    full = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda l: F.trim(l["x"]) != "")
    few = lambda l: l["x"].rlike("[0-9]|^\\W*\\w{1,4}\\W*$") & ~l["x"].rlike("[.;,]\\s*$") & (F.length(F.regexp_replace(l["x"], "[^\\p{L}]+", "")) <= 24)
    lines = t.select("id", full.alias("ls")).where("size(ls) > 0").withColumn("few", F.transform("ls", few))
    beside = lambda _, i: (i == 0) | (i == F.size("ls") - 1) | F.try_element_at("few", i).eqNullSafe(F.lit(True)) | F.try_element_at("few", i + 2).eqNullSafe(F.lit(True))
    maybe = lines.select("id", F.explode(F.filter("ls", beside)).alias("l")).select("id", "l.i", _wording(F.regexp_replace("l.x", "\\s+", "\n")).alias("ws"))
    known = maybe.select("id", "i", F.explode(F.array_distinct(F.split("ws", "\n"))).alias("x")).join(wordings, "x").groupBy("id").agg(F.collect_set("i").alias("worded"))
    known_patterns = frozenset(patterns)
    kind = pa.list_(pa.struct([("i", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, worded in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = [" ".join(map(_folded, x.split())) for x in text.split("\n")]
                out.append([{"i": i, "kind": k} for i, k in sorted(furniture(lines, set(worded or ()), known_patterns).items())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["id", "text", "kinds"])

    edges = t.join(known, "id", "left").select("id", "text", "worded").mapInArrow(run, "id bigint, text string, kinds array<struct<i:int,kind:string>>")
    l = edges.select("id", "kinds", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    l = l.withColumn("kind", F.coalesce(F.try_element_at(F.filter("kinds", lambda k: k["i"] == F.col("line")), F.lit(1))["kind"], F.lit("body")))
    y0 = F.col("line") - F.size(F.filter("kinds", lambda k: k["i"] < F.col("line")))
    ws = F.transform(F.filter(F.split("x", "\\s+"), lambda w: w != ""), lambda w, k: F.struct((F.col("line").cast("bigint") * (1 << 31) + k).alias("at"), F.col("id").alias("token_id"), w.alias("text")))
    l = l.select(F.col("id").cast("string").alias("document_id"), F.lit(0).alias("page_index"), F.lit("text").alias("source"), "line", y0.cast("double").alias("y0"), ws.alias("ws"), "kind")
    return l.where("size(ws) > 0")
