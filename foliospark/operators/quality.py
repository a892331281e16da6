"""Explainable quality of extracted text, verdicts and routes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Thai", "Devanagari")


@dataclass(frozen=True)
class Thresholds:
    min_chars: int = 200
    mixed: float = 0.10
    unexpected: float = 0.10
    replacement: float = 0.02
    control: float = 0.02
    min_alpha: float = 0.30
    digit_in_word: float = 0.30
    expected: tuple[str, ...] = ("Latin",)


def signals(df: DataFrame, text: str = "text", th: Thresholds = Thresholds(), normalise: bool = True) -> DataFrame:
    """Counts, six ratios, reasons and verdict of each row's text; NULL counts as empty.

    Only the normalisation leaves the JVM, and only where it is wanted.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_t", T.normalised(t, "NFKC") if normalise else t)
    t = F.col("_t")
    count = lambda p: F.regexp_count(t, F.lit(p))
    df = df.withColumn("n_chars", F.length(t).cast("bigint")).withColumn("n_alpha", count("\\p{L}")).withColumn("n_unexpected", F.col("n_alpha") - count("[" + "".join(f"\\p{{Is{s}}}" for s in th.expected) + "&&\\p{L}]"))
    df = df.withColumn("n_replacement", count("\\x{FFFD}")).withColumn("n_control", count("[\\p{Cc}\\p{Cn}\\p{Co}\\p{Cs}&&[^\\s\\x1c-\\x1f\\x85]]"))
    df = df.withColumn("_w", T.tokens(t))
    scripts = lambda w: sum((w.rlike(f"[\\p{{Is{s}}}&&\\p{{L}}]").cast("int") for s in SCRIPTS), F.lit(0))
    plain = F.filter("_w", lambda w: ~T.url_like(w))
    df = df.withColumn("n_words", F.size("_w").cast("bigint")).withColumn("n_mixed", F.size(F.filter("_w", lambda w: scripts(w) > 1)))
    df = df.withColumn("n_plain", F.size(plain)).withColumn("n_digit", F.size(F.filter(plain, lambda w: w.rlike("\\p{L}") & w.rlike("\\p{Nd}"))))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    df = df.withColumns({
        "alpha_ratio": share("n_alpha", "n_chars"),
        "mixed_script_word_ratio": share("n_mixed", "n_words"),
        "unexpected_script_ratio": share("n_unexpected", "n_alpha"),
        "replacement_ratio": share("n_replacement", "n_chars"),
        "control_ratio": share("n_control", "n_chars"),
        "digit_in_word_ratio": share("n_digit", "n_plain"),
    })
    tests = [("mixed_script_words", F.col("mixed_script_word_ratio") > th.mixed), ("unexpected_script_chars", F.col("unexpected_script_ratio") > th.unexpected), ("replacement_chars", F.col("replacement_ratio") > th.replacement), ("control_chars", F.col("control_ratio") > th.control), ("alpha_ratio", F.col("alpha_ratio") < th.min_alpha), ("digit_in_word", F.col("digit_in_word_ratio") > th.digit_in_word)]
    short = F.col("n_chars") < th.min_chars
    reasons = F.when(short, F.array(F.lit("insufficient_text"))).otherwise(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests))))
    return df.withColumn("reasons", reasons).withColumn("suspicious", ~short & (F.size("reasons") > 0)).drop("_t", "_w", "n_plain")


def text_verdict(suspicious: Column, reasons: Column, n_chars: Column) -> Column:
    """trusted or suspicious; NULL where there is nothing to verify."""
    nothing = (n_chars == 0) | (reasons == F.array(F.lit("insufficient_text")))
    return F.when(~nothing, F.when(suspicious, "suspicious").otherwise("trusted"))


def measured_verdict(ratio: Column, trusted: float, invalid: float) -> Column:
    """trusted from one bound, invalid up to another, suspicious between; nothing measured is trusted."""
    return F.when(ratio.isNull() | (ratio >= trusted), "trusted").when(ratio <= invalid, "invalid").otherwise("suspicious")


def table_verdict(confidence: Column) -> Column:
    return F.when(confidence.isNull() | (confidence >= 0.75), "trusted").when(confidence <= 0.3, "invalid").otherwise("suspicious")


def agreement_verdict(agreement: Column) -> Column:
    return F.when(agreement < 0.5, "suspicious").otherwise("trusted")


def route(kind: Column, text_page_ratio: Column, suspicious_ratio: Column) -> Column:
    """Which way a file goes, by its kind and the text profile of its pages."""
    return (
        F.when(kind.isin("docx", "xlsx", "pptx"), "office").when(kind.startswith("image"), "image")
        .when((kind == "pdf") & (text_page_ratio < 0.6), "scanned_pdf").when((kind == "pdf") & (suspicious_ratio > 0.34), "scanned_pdf")
        .when(kind == "pdf", "digital_pdf").otherwise("unknown")
    )


# First bytes of images in hexadecimal, members that tell office archives, old office
# containers by extension, and kinds by extension where no byte tells.
IMAGES = {"89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "474946383761": "gif", "474946383961": "gif", "49492A00": "tiff", "4D4D002A": "tiff", "424D": "bmp"}
MEMBERS = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}
LEGACY = {"doc": "doc_legacy", "xls": "xls_legacy", "ppt": "ppt_legacy"}
BY_EXTENSION = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp"}


def _chosen(pairs: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*(F.when(c, F.lit(v)) for c, v in pairs))


def sniff(content: Column, path: Column) -> Column:
    """Kind and confidence of a file by its content; the extension only speaks where no byte does.

    An archive is an office file if its directory, which stands uncompressed at
    the end behind a mark, names the part that makes it one. An archive without
    directory is broken.
    """
    head = F.hex(F.substring(content, 1, 8))
    ext = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    inside = lambda text: F.contains(content, F.lit(text))
    image = _chosen([(head.startswith(h), f"image/{k}") for h, k in IMAGES.items()])
    archive, whole = head.startswith("504B"), inside(b"PK\x05\x06")
    office = _chosen([(inside(m.encode()), k) for m, k in MEMBERS.items()])
    ole, named = head == "D0CF11E0A1B11AE1", _chosen([(ext == e, k) for e, k in BY_EXTENSION.items()])
    kind = (
        F.when(head.startswith("25504446"), "pdf").when(image.isNotNull(), image)
        .when(archive, F.when(whole, F.coalesce(office, F.lit("zip_unknown"))).otherwise("unknown"))
        .when(ole, F.coalesce(_chosen([(ext == e, k) for e, k in LEGACY.items()]), F.lit("ole_legacy"))).otherwise(F.coalesce(named, F.lit("unknown")))
    )
    certain = (
        F.when(head.startswith("25504446") | image.isNotNull(), 1.0).when(archive, F.when(~whole, 0.0).when(office.isNotNull(), 1.0).otherwise(0.3))
        .when(ole, 0.5).when(named.isNotNull(), 0.4).otherwise(0.0)
    )
    return F.struct(kind.alias("kind"), certain.alias("confidence"))
