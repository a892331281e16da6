"""Text decoded with the wrong character encoding: finding it and restoring the original.

Every character is mapped back to the byte it had in a legacy encoding; a
byte-structure automaton for UTF-8 finds the maximal well-formed multibyte
spans, and only those are decoded, again and again while spans turn up, so
that text encoded twice is restored too. The encoding is the one under which
most characters become plausible. Text in which a double-byte encoding swallowed
UTF-8, and text of one single-byte Cyrillic encoding read as another, is
re-encoded run by run and accepted if the result is structurally or
statistically right. Lost bytes, private characters and words that mix scripts
because of a broken font map are found but cannot be restored.

A page is affected if a garbled span stands in a word. Garbled characters that
stand alone, one by one, on an otherwise sound page are a quotation.

Defined results: NULL and empty text is sound; properly foreign text has no
well-formed spans and is sound; repeated rows count once; very long texts are
processed whole, in time linear in their length.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SINGLE = ("cp1252", "cp1250", "cp1251", "cp437", "mac_roman", "cp850", "cp866", "koi8_r", "cp1258", "cp1254", "cp1253", "cp1257", "iso8859_2", "iso8859_15", "iso8859_5", "cp852", "mac_cyrillic")
DOUBLE = ("gb18030", "big5", "shift_jis", "euc_kr")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
# The letters of Russian by falling frequency (fixed value).
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
# Well-formed multibyte sequences of UTF-8, over characters that stand for bytes.
UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
UTF8_RUN = re.compile(f"(?:{UTF8.pattern})+")
_HIGH = re.compile("[^\x00-\x7f]+")
_WIDE = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\uff00-\uffef]")
_HANZI = re.compile("[㐀-鿿]")
_MIXED = re.compile(r"(?:[A-Za-zÀ-ɏḀ-ỿ]+[Ѐ-ӿ]|[Ѐ-ӿ]+[A-Za-zÀ-ɏḀ-ỿ])[^\W\d_]*")
_PAIR = re.compile("[^\x00-\x7f]{2}")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?:[^.!?。\n]|[.!?](?!\s))+")
FILLED = 0.6  # share of the high characters of a garbled sentence that its spans hold at least
_LOST = re.compile("�")
_CONTROL = re.compile("[\x80-\x9f\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd]")  # control and private characters


@functools.cache
def to_bytes(codec: str) -> dict[int, str]:
    """For str.translate: a character to the one that stands for its byte; other characters to a mark."""

    class Table(dict):
        def __missing__(self, cp: int) -> str:
            self[cp] = "␀"  # at most one entry per character there is
            return "␀"

    table = Table({b: chr(b) for b in range(256)})
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            pass
    own = {ord(c) for b in range(128, 256) if len(c := bytes([b]).decode(codec, "ignore")) == 1}
    for b in range(160, 256):  # a byte's own character only where the encoding leaves it undefined
        if b not in own and bytes([b]).decode(codec, "ignore"):
            table[b] = "␀"
    return table


@functools.cache
def _begins(codec: str) -> re.Pattern:
    """A lead byte with a continuation byte, in the characters of an encoding: without any there is no span."""
    table = to_bytes(codec)
    of = lambda lo, hi: "[" + "".join(re.escape(chr(cp)) for cp, b in table.items() if len(b) == 1 and lo <= ord(b) <= hi) + "]"
    return re.compile(of(0xC2, 0xF4) + of(0x80, 0xBF))


@functools.cache
def plausible(c: str) -> bool:
    """Whether a decoded character is one that texts hold."""
    cp = ord(c)
    if c.isalpha():
        return cp < 0x180 or c in "ƒƠơƯưȘșȚț" or 0x1EA0 <= cp < 0x1EFA or 0x386 <= cp < 0x3CF or 0x401 <= cp < 0x460 or 0x4E00 <= cp < 0xA000
    return 0xA0 <= cp < 0xC0 or cp in (0x2C6, 0x2DC, 0xD7, 0xF7, 0x2116, 0x2122) or 0x2010 <= cp <= 0x2044 or 0x20A0 <= cp <= 0x20BF or 0x3000 <= cp < 0x3020 or 0xFF01 <= cp <= 0xFF5E or 0x300 <= cp < 0x330 or 0x2190 <= cp < 0x2300


def decode_spans(text: str, codec: str) -> tuple[str, int, list[tuple[int, int]]]:
    """Text with its well-formed spans decoded, the number of characters won, and the spans.

    Sentence by sentence: where text was decoded wrongly, most of its high
    characters lie in well-formed spans; a chance pair in sound foreign text is
    surrounded by characters that fit no span.
    """
    raw = text.translate(to_bytes(codec))
    out, last, won, spans = [], 0, 0, []
    for sentence in _SENTENCE.finditer(raw):
        at, part = sentence.start(), sentence.group()
        runs = list(UTF8_RUN.finditer(part))
        if not runs or sum(m.end() - m.start() for m in runs) < FILLED * sum(map(len, _HIGH.findall(part))):
            continue
        for m in runs:
            decoded = m.group().encode("latin-1").decode("utf-8")
            good = sum(map(plausible, decoded))
            if good + sum("\x80" <= c <= "\x9f" for c in decoded) == len(decoded):
                won += good
                out += [text[last : at + m.start()], decoded]
                last = at + m.end()
                spans.append((at + m.start(), last))
    return "".join([*out, text[last:]]), won, spans


def _double(text: str, codec: str) -> tuple[str, list[tuple[int, int]]]:
    """Runs that a double-byte encoding made of UTF-8 bytes, decoded as far as the bytes survived."""
    out, last, spans = [], 0, []
    for m in _HIGH.finditer(text):
        kept = m.group().replace("�", "").encode(codec, "ignore").decode("latin-1")
        whole = sum(len(x) for x in UTF8_RUN.findall(kept))
        if len(m.group()) > 1 and kept and whole >= 0.7 * len(kept):
            raw = "".join(c if c == "�" else c.encode(codec, "ignore").decode("latin-1") for c in m.group())
            decoded = raw.replace("�", "?").encode("latin-1").decode("utf-8", "replace")
            letters = [c for c in decoded if c not in "?�"]
            if letters and sum(map(plausible, letters)) >= 0.9 * len(letters):
                out += [text[last : m.start()], decoded]
                last = m.end()
                spans.append(m.span())
    return "".join([*out, text[last:]]), spans


class _Ranks(dict):
    """Score of a letter: high for frequent ones of Russian, low for any other character."""

    def __missing__(self, c: str) -> float:
        return -0.5


_RANK = _Ranks({c: 1 - i / len(RUSSIAN) for i, c in enumerate(RUSSIAN)})


def russian(words: list[str]) -> float:
    """How Russian words look, by letter frequency; capitals inside a word count against it."""
    score = n = 0.0
    for w in words:
        n += len(w)
        if w.isupper():
            w = w.lower()
        elif not w.islower():
            w = w[0].lower() + w[1:]
        score += sum(map(_RANK.__getitem__, w))
    return score / n if n else 0.0


def _cyrillic(text: str) -> tuple[str, bool]:
    """Text of one Cyrillic encoding read as another, or as a Western one, line by line."""
    changed, lines = False, []
    for line in text.split("\n"):
        high = [w for w in _WORD.findall(line) if not w.isascii()]
        best, score = line, russian(high) + 0.2
        if score > 0.75:  # sound Russian
            lines.append(line)
            continue
        foreign = [w for w in high if all(127 < ord(c) < 0x530 or 0x2500 <= ord(c) < 0x25A1 for c in w)]
        if sum(map(len, foreign)) >= 6 and sum(map(len, foreign)) >= 0.6 * sum(map(len, high)):
            for seen in ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1252", "latin_1", "mac_roman", "cp437"):
                for meant in CYRILLIC:
                    if seen != meant:
                        new = _transcode(line, seen, meant)
                        got = [w for w in _WORD.findall(new) if "Ѐ" <= w[0] < "Ѡ"]
                        if got and sum(map(len, got)) >= 0.7 * sum(map(len, foreign)) and (s := russian(got) * min(1.0, sum(map(len, got)) / sum(map(len, foreign)))) > max(score, 0.45):
                            best, score = new, s
        changed |= best != line
        lines.append(best)
    return "\n".join(lines), changed


@functools.cache
def _recoding(seen: str, meant: str) -> dict[int, str]:
    """Characters of one single-byte encoding to those that their bytes are in another."""
    table = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(seen))] = bytes([b]).decode(meant)
        except UnicodeDecodeError:
            pass
    return table


def _transcode(line: str, seen: str, meant: str) -> str:
    return line.translate(_recoding(seen, meant))


def _hanzi(text: str) -> tuple[str, bool]:
    """Double-byte Chinese read as a Western encoding: runs of high characters that pair up to common characters."""
    changed, out, last = False, [], 0
    for m in re.finditer("[\x80-\xffŒ-ƒˆ˜–-™]{4,}", text):
        raw = m.group().translate(to_bytes("cp1252"))
        if "␀" in raw or len(raw) % 2:
            continue
        try:
            got = raw.encode("latin-1").decode("gb2312")
        except UnicodeDecodeError:
            continue
        if len(_HANZI.findall(got)) >= 0.8 * len(got):
            out += [text[last : m.start()], got]
            last, changed = m.end(), True
    return "".join([*out, text[last:]]), changed


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether a span is a whole word of its own that decodes to one character."""
    before, after = text[start - 1 : start], text[end : end + 1]
    return not (before.isalnum() or after.isalnum()) and end - start <= 4


def repair(text: str | None) -> tuple[bool, str | None]:
    """(affected, text with all that can be restored restored)."""
    if not text or text.isascii():
        return False, text
    affected, now = False, text
    while _PAIR.search(now):  # every round makes the text shorter
        options = [(*decode_spans(now, c), c) for c in SINGLE if _begins(c).search(now)] or [(now, 0, [], "")]
        best = max(options, key=lambda o: o[1])
        if not best[1]:
            break
        in_words = [s for s in best[2] if not _stands_alone(now, *s)]
        if not in_words:
            break
        affected, now = True, best[0]
    for codec in DOUBLE if _WIDE.search(now) else ():
        fixed, spans = _double(now, codec)
        if spans:
            affected, now = True, fixed
            break
    if not affected:
        for step in (_cyrillic, _hanzi):
            fixed, changed = step(now)
            if changed:
                affected, now = True, fixed
                break
    if not affected:
        affected = _unrestorable(now)
    return affected, now


def _unrestorable(text: str) -> bool:
    """Lost bytes in words, control or private characters, or words that mix scripts."""
    for m in _LOST.finditer(text):
        if text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum() or text[m.end() : m.end() + 1] == "�":
            return True
    if _CONTROL.search(text):
        return True
    return len(_MIXED.findall(text)) >= 2


def restore(df: DataFrame, id_col: str = "page_input_id", text_col: str = "text") -> DataFrame:
    """id, affected, restored of every distinct row; other columns are ignored."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [repair(t) for t in pdf[text_col]]
            yield pd.DataFrame({id_col: pdf[id_col], "affected": [d[0] for d in done], "restored": [d[1] for d in done]})

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, affected boolean, restored string")


def found(df: DataFrame) -> DataFrame:
    """The affected pages, one distinct row each."""
    return restore(df).where("affected").select("page_input_id").distinct()
