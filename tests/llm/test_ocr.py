import itertools
import random

from foliospark.llm import ocr as O


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return new


def test_automaton_finds_all_words_within_the_distance():
    r = random.Random(1)
    words = {"".join(r.choice("abcđ") for _ in range(r.randint(1, 7))) for _ in range(300)}
    trie = O.Trie()
    for n, w in enumerate(sorted(words), 1):
        trie.add(w, n)
    count = {w: n for n, w in enumerate(sorted(words), 1)}
    for _ in range(60):
        q = "".join(r.choice("abcđx") for _ in range(r.randint(1, 8)))
        for d, least in itertools.product((1, 2, 3), (1, 150)):
            assert sorted(trie.near(q, d, least)) == sorted((w, count[w]) for w in words if distance(q, w) <= d and count[w] >= least)


def page(doc, index, lines, source="a", start=0):
    rows, n = [], start
    for k, (x, text) in enumerate(lines):
        for i, w in enumerate(text.split()):
            rows.append((n, doc, index, source, n, w, x + 60.0 * i, 100 + 30.0 * k, x + 60.0 * i + 50, 117 + 30.0 * k))
            n += 1
    return rows


SCHEMA = "token_id bigint, document_id string, page_index int, source string, token_pos int, text string, x0 double, y0 double, x1 double, y1 double"


def corpus():
    rows, n = [], 0
    for p in range(60):
        lines = [(400.0, "Kelmora Registry bound volume"), (90.0, "the second inspection of the building"), (90.0, "was closed by the off-site board in exceptional form"), (90.0, "after the inspection the building was closed again"), (400.0, f"Page {p + 1}")]
        if p == 7:
            lines[1] = (90.0, "tbe second insp^ection of the excep-")
            lines[2] = (90.0, "tional board was closed off-")
            lines[3] = (90.0, "site the buildinq 12 LX331 was closed")
        rows += page("d", p, lines, start=n)
        n = len(rows)
    return rows


def test_noise_and_paragraphs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + rows[:200] + [(99999, "d", 0, "a", 5000, None, 1.0, 1.0, 1.0, 1.0)], SCHEMA)
    pages = O.Pages(df)
    text = {r[0]: r[5] for r in rows}
    on = {r[0]: r[2] for r in rows}
    got = [(on[r.row_id], text[r.row_id], r.noise) for r in pages.found().collect()]
    assert sorted(x for x in got if x[0] == 7) == sorted([(7, w, "header") for w in ("Kelmora", "Registry", "bound", "volume")] + [(7, "Page", "page_number"), (7, "8", "page_number"), (7, "tbe", "misread"), (7, "insp^ection", "misread"), (7, "excep-", "hyphen"), (7, "buildinq", "misread")])
    assert not [x for x in got if x[0] != 7 and x[2] not in ("header", "page_number")]
    seven = [r.text for r in pages.paragraphs().where("page_index = 7").collect()]
    assert seven == ["the second inspection of the exceptional board was closed off-site the building 12 LX331 was closed"]


def test_empty(spark):
    pages = O.Pages(spark.createDataFrame([], SCHEMA))
    assert pages.found().count() == 0 and pages.paragraphs().count() == 0


def kinds(text, worded=(), patterns=()):
    return {i: k for i, k in O.furniture([O.fold(x) for x in text.split("\n")], set(worded), frozenset(patterns)).items()}


def test_lines_without_boxes():
    text = "Kelmora Depot internal use\nthe excep-\ntional board closed\n- 3 -\nKelmora Depot internal use\ntbe off-\nsite board\n- 4 -"
    assert kinds(text) == {0: "header", 3: "page_number", 4: "header", 7: "page_number"}
    assert kinds("the board closed.\n\n390\nthe off-site board closed") == {}
    assert kinds("") == {}
    # a header that does not recur has the corpus's wording, a page number its pattern, however far out of focus
    assert kinds("Kelmora Depot internal use\nthe board closed\nPagc 4", {0}, {O.line_pattern("page 4")[0]}) == {0: "header", 2: "page_number"}
    # long lines and short ones recur too, whatever stands between
    long = "Kelmora " * 40
    assert kinds(f"{long}\none thing\nPage 1\n{long}\nanother\nPage 2") == {0: "header", 2: "page_number", 3: "header", 5: "page_number"}


def noise_of(spark, texts, tokens=None):
    pages = O.Pages(spark.createDataFrame(tokens if tokens is not None else corpus(), SCHEMA), spark.createDataFrame(texts, "id bigint, text string"))
    got = {}
    for r in pages.found().where("src = 'text'").collect():
        got.setdefault(r.row_id, set()).add(r.noise)
    return got, pages


def test_texts_without_boxes_share_the_judgement(spark):
    texts = [(1, "the second inspection of the excep-\ntional board was closed"), (2, "tbe second insp^ection was closed\n\nthe building"), (2, "tbe second insp^ection was closed\n\nthe building"), (3, None), (4, ""), (5, "Kelmora Registry bound volume\nthe board was\nPage 9\nKelmora Registry bound volume\nclosed again\nPage 10")]
    got, pages = noise_of(spark, texts)
    assert got == {1: {"hyphen"}, 2: {"misread"}, 5: {"header", "page_number"}}
    text = {}
    for r in pages.paragraphs().where("src = 'text'").orderBy("document_id", "paragraph").collect():
        text.setdefault(r.document_id, []).append(r.text)
    assert text == {"1": ["the second inspection of the exceptional board was closed"], "2": ["the second inspection was closed the building"], "5": ["the board was closed again"]}


def test_headers_at_the_left_margin_are_found_by_recurrence(spark):
    rows, n = [], 0
    words = ["inspection", "building", "second", "closed", "form", "board", "site", "exceptional", "after", "again", "depot", "annex"]
    for p in range(12):
        body = [(90.0, " ".join(words[(7 * p + 5 * k + i * (k + 1)) % 12] for i in range(5))) for k in range(6)]
        rows += page("d", p, [(90.0, "Kelmora Registry volume"), *body, (90.0, f"{p + 3}")], start=n)
        n = len(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.row_id: r.noise for r in O.Pages(df).found().where("noise in ('header', 'page_number')").collect()}
    want = {r[0]: "header" for r in rows if r[5] in ("Kelmora", "Registry", "volume")} | {r[0]: "page_number" for r in rows if r[5].isdigit()}
    assert got == want


def test_no_word_is_too_long():
    word = "pneumono" * 6
    assert O.Lexicon({word: 500, "the": 500}, set(), set()).misread(word[:-1] + "x") == (True, [word])


def test_codes_of_any_length_take_an_established_shape():
    lex = O.Lexicon({}, {"A-9/9", "9.9"}, set())
    assert lex.code("X-OO1lSS0O0OlOZ8/2O") == "X-0011550000102" + "8/20"
    assert lex.code("X-2001/20") is None and lex.code("12") is None and lex.code("l2.O4") == "12.04"


def test_documents_join_paragraphs_over_pages(spark):
    rows = [("d", 0, "a", 0, "First."), ("d", 0, "a", 1, "It begins"), ("d", 1, "a", 0, "goes on"), ("d", 2, "a", 0, "and ends."), ("d", 2, "a", 1, "New."), ("d", 4, "a", 0, "after a gap"), ("d", 5, "a", 0, "Upper begins anew"), ("e", 1023, "a", 0, "over a"), ("e", 1024, "a", 0, "block"), ("e", 1025, "a", 0, "and further")]
    got = [tuple(r) for r in O.documents(spark.createDataFrame(rows, "document_id string, page_index int, source string, paragraph int, text string")).orderBy("document_id", "first_page", "paragraph").collect()]
    assert got == [("d", "a", 0, 0, 0, "First."), ("d", "a", 0, 1, 2, "It begins goes on and ends."), ("d", "a", 2, 1, 2, "New."), ("d", "a", 4, 0, 4, "after a gap"), ("d", "a", 5, 0, 5, "Upper begins anew"), ("e", "a", 1023, 0, 1025, "over a block and further")]


def test_rare_word_below_the_vocabulary_keeps_its_own_count(spark, monkeypatch):
    monkeypatch.setattr(O, "RARE", 0.01)  # as on large inputs, where counts below 4 or 40 are under the floor
    lines = [(90.0, "the second inspection of the building was closed")] * 40 + [(90.0, "velmar and dolmar of the building")] * 30
    rows = page("d", 0, lines + [(90.0, "dolmor was closed")] * 4 + [(90.0, "the velmar-")] + [(90.0, "dolmor inspection")])
    pages = O.Pages(spark.createDataFrame(rows, SCHEMA))
    assert "dolmor" not in pages.lexicon.counts and "dolmar" in pages.lexicon.counts
    text = {r[0]: r[5] for r in rows}
    assert "dolmor" not in {text[r.row_id] for r in pages.found().where("noise = 'misread'").collect()}
    got, _ = noise_of(spark, [(1, "the dolmor was closed"), (2, "the dolmcr was closed")], rows)
    assert got == {2: {"misread"}}


def test_all_pairs_rank_whole_and_divided_words(spark, monkeypatch):
    monkeypatch.setattr(O, "BIGRAMS", 1, raising=False)
    lines = ["the board was closed"] * 60 + ["a long beard grew here"] * 40 + ["one long bxard grew here", "one long bx-", "ard grew here"]
    pages = O.Pages(spark.createDataFrame(page("d", 0, [(90.0, x) for x in lines]), SCHEMA))
    got = " ".join(r.text for r in pages.paragraphs().orderBy("paragraph").collect())
    assert got.endswith("a long beard grew here one long beard grew here one long beard grew here")


def test_no_candidate_is_left_out():
    words = {w: 900 - 100 * n for n, w in enumerate(("bat", "cat", "hat", "mat", "rat", "sat", "vat"))}
    assert O.Lexicon(words, set(), set()).misread("xat") == (True, list(words))


def test_lines_of_texts_are_brought_into_order_once(spark):
    ws = "array<struct<at:bigint,token_id:bigint,text:string>>"
    rows = [("1", 0, 1.0, [(1, 1, "the"), (2, 1, "excep-")], "body"), ("1", 1, 2.0, [(3, 1, "Page"), (4, 1, "3")], "page_number"), ("1", 2, 3.0, [(5, 1, "tional"), (6, 1, "board")], "body")]
    lines = spark.createDataFrame(rows, f"document_id string, line int, y0 double, ws {ws}, kind string")
    halves = O.with_halves(lines.selectExpr("document_id", "0 as page_index", "'text' as source", "line", "y0", "ws", "kind"))
    assert halves._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = [(r.splits, r.open, r.next, r.prev_word, r.next_word) for r in halves.orderBy("line").collect()]
    assert got == [(True, None, "tional", None, "tional"), (False, None, None, None, None), (False, "excep-", None, "excep-", None)]


def test_words_of_a_line_are_put_out_of_focus_together(spark):
    words = ["Kelmora", "No.12", "Straße,", "٣", "...", "vol A4"]
    df = spark.createDataFrame([("\n".join(words),), *((w,) for w in words)], "x string")
    whole, *each = (r[0] for r in df.select(O._wording(df.x)).collect())
    assert whole.split("\n") == each and each[1] == "#" and each[-1] == "#"


def test_one_error_needs_no_automaton():
    trie = O.Trie()
    for n, w in enumerate(("bat", "cat", "at", "cats", "coat", "act"), 1):
        trie.add(w, n)
    near = trie._near_one
    assert sorted(near("cat", 1)) == [("at", 3), ("bat", 1), ("cat", 2), ("cats", 4), ("coat", 5)] and sorted(near("cat", 3)) == [("at", 3), ("cats", 4), ("coat", 5)]
    assert near("", 1) == near("x", 1) == [] and near("t", 1) == [("at", 3)]
