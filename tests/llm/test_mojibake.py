import random

import pytest

from foliospark.llm import mojibake as M

SOUND = [
    "Café receipts, façade plans and the résumé file are kept apart.", "Khối chữ ký được đánh số tại phòng mười hai.", "Служебная записка хранится до пятницы.",
    "请确认第210页的保存期限。", "SÃO TIRELLO and MAÇÃ DEPOT are branch names.", "Herr Löwenzähler’s ledger shows 115 °C.", "An old tool showed Ã© for é and â€™ for an apostrophe.", "The sign � stands alone.", "", None,
]
TEXTS = ["Café receipts and résumé files are kept apart.", "Đề nghị lưu giữ biên bản bàn giao tại tầng hai.", "The clerk’s note reads “seen and agreed” — twice."]


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_stays(text):
    assert M.repair(text) == (False, text)


@pytest.mark.parametrize("codec", ["latin-1", "cp437", "cp850", "mac_roman", "koi8_r"])
@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text, codec):
    assert M.repair(text.encode().decode(codec)) == (True, text)


def test_twice_and_in_part():
    twice = TEXTS[0].encode().decode("latin-1").encode().decode("latin-1")
    assert M.repair(twice) == (True, TEXTS[0])
    part = "Phòng đào tạo đã chuyển giao. " + TEXTS[1].encode().decode("latin-1")
    assert M.repair(part) == (True, "Phòng đào tạo đã chuyển giao. " + TEXTS[1])


def test_single_byte_cyrillic_and_lost_text():
    ru = "Служебная записка номер пять хранится до пятницы в архиве отдела."
    assert M.repair(ru.encode("koi8_r").decode("cp1251")) == (True, ru)
    assert M.repair(ru.encode("cp1251").decode("latin-1")) == (True, ru)
    assert M.repair("Kh��ng thay đ��i")[0] and M.repair("Betweeя 17.03 aяю the eяgiяeeчs")[0]


def test_long_text_in_linear_time():
    random.seed(1)
    text = "".join(random.choice(TEXTS) + " " for _ in range(3000))
    assert M.repair(text.encode().decode("latin-1")) == (True, text)


def test_found(spark):
    df = spark.createDataFrame([(1, TEXTS[0].encode().decode("latin-1"), 0), (1, TEXTS[0].encode().decode("latin-1"), 0), (2, TEXTS[0], 0), (3, None, 0)], "page_input_id bigint, text string, affected int")
    assert [r[0] for r in M.found(df).collect()] == [1]
    assert M.found(df.limit(0)).count() == 0


def test_any_number_of_rounds():
    from foliospark.llm.mojibake import repair

    text = "Điểm này được kiểm tra tại phòng mười hai"
    for rounds in range(1, 7):
        bad = text
        for _ in range(rounds):
            bad = bad.encode().decode("latin-1")
        assert repair(bad) == (True, text)
