import unicodedata

from foliospark.llm import canonical as C

CASES = {
    "ｔｈｅ　ｅｎｄ": "the end", "be​fore­": "before", "a b c": "a b c", "tổ": "tổ", "ỏ̂": "ổ", "á̂": "ấ",
    "Τһе": "The", "50.633-В": "50.633-B", "ﬁne ﬃ": "fine ffi", "low‑contrast": "low-contrast", "сһο": "cho", "𝐀1": "A1",
    "склад": "склад", "αβγδ σ=4 Ω-12 μm m² ½ № …": "αβγδ σ=4 Ω-12 μm m² ½ № …", "": "", "Điểm": "Điểm", "x̰̄": "x̰̄",
}


def test_forms(spark):
    df = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "text string")
    got = {r.text: r.canonical for r in C.with_canonical(df, "text").collect()}
    assert {k: got[k] for k in CASES} == CASES and got[None] is None


def test_rebuilds_long_text_and_keeps_rows(spark):
    long = "éｘ " * 20_000
    df = spark.createDataFrame([(1, long, "k"), (1, long, "k"), (2, "plain", "k")], "id int, text string, text_key string")
    rows = C.with_canonical(df.drop("text_key"), "text").collect()
    assert len(rows) == 3 and {r.canonical for r in rows if r.id == 1} == {"éx " * 20_000}


def test_prefilter_is_exact():
    import re

    # every single character that some step changes is in the class of suspicious ones
    chars = {*C.stand_ins(), *C.look_alikes()}
    assert all(unicodedata.normalize("NFC", c) == c or c in chars or 0x300 <= ord(c) < 0x370 for c in map(chr, range(0x20, 0x2000)) if unicodedata.category(c) in ("Ll", "Lu") and not unicodedata.decomposition(c).startswith("<") and len(unicodedata.decomposition(c).split()) == 2)
    assert re.compile(C._char_class(["a", "b", "d"]).replace("\\x{61}-\\x{62}", "ab").replace("\\x{64}", "d")).search("d")


def test_found(spark):
    t = spark.createDataFrame([(1, "ｔhe", 0), (1, "ｔhe", 0), (2, "the", 0), (3, "low‐", 0), (4, None, 0), (5, "vụ­", 0)], "token_id bigint, text string, row int")
    g = spark.createDataFrame([(1, [None, ["a", None, "b c", ""]])], "grid_id bigint, grid array<array<string>>")
    h = spark.createDataFrame([(1, None), (2, [None, "оf"])], "hard_case_id bigint, must_contain array<string>")
    assert {tuple(r) for r in C.found(t, g, h).collect()} == {("ocr_tokens", 1, 0, 0), ("ocr_tokens", 5, 0, 0), ("annotated_grids", 1, 1, 2), ("hard_cases", 2, 1, 0)}
    assert C.found(t.limit(0), g.limit(0), h.limit(0)).count() == 0
