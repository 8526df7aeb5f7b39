from pyspark.sql import functions as F

from citewright.functions import rules as R
from citewright.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_tones(spark):
    moved = {"hoà": "hòa", "khoẻ": "khỏe", "huỷ": "hủy", "xoá": "xóa", "thuỷ": "thủy"}
    stay = ["quý", "hoàn", "khoản", "hoặc", "hòa", "toàn", "thúy"]
    for a, b in {**moved, **{w: w for w in stay}}.items():
        assert T._move_tones(a) == b and T._move_tones(b) == b
    assert one(spark, T.normalize_tone, "Hoà Huỷ") == "Hòa Hủy"


def test_lines(spark):
    assert one(spark, T.normalize_line, "•  Nộp hồ sơ\u200b  tại  xã ;") == "- Nộp hồ sơ tại xã;"
    assert one(spark, T.normalize_line, "-5 ngày") == "-5 ngày"
    assert one(spark, T.normalize_line, None) is None
    assert one(spark, T.lines, " a \n\n b") == ["a", "b"]
    assert one(spark, T.split_sentences, "Một. Hai; ba: bốn") == ["Một.", "Hai;", "ba:", "bốn"]


def test_tokens_and_accents(spark):
    assert one(spark, T.tokens, "Đăng ký, số 12_a!") == ["đăng", "ký", "số", "12_a"]
    assert one(spark, T.strip_accents, "Đăng Ký Khai Sinh") == "dang ky khai sinh" == one(spark, T.strip_latin, "Đăng Ký Khai Sinh")
    assert one(spark, T.has_diacritics, "Đăng") and not one(spark, T.has_diacritics, "dang ky")
    assert one(spark, lambda c: T.ngrams(T.tokens(c), 1, 2), "a b c") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, lambda c: T.ngrams(T.tokens(c), 1, 2), "") == []
    assert one(spark, lambda c: T.expand_words(c, R.ABBREVIATIONS), "Ko biết, ntn?") == "không biết, như thế nào?"
    assert one(spark, T.slug, "a/b c.d-") == "a_b_c.d-"
    assert one(spark, T.clean_cell, " 2.0 ") == "2" and one(spark, T.clean_cell, None) == ""
    assert one(spark, lambda c: T.sigmoid(c), 0.0, "double") == 0.5


def test_rules(spark):
    kind = lambda q: one(spark, R.expected_type, q)
    assert kind("Đăng ký khai sinh mất bao lâu?") == "thoi_han" and kind("lệ phí kết hôn bao nhiêu tiền") == "so_tien"
    assert kind("le phi ket hon bao nhieu tien") == "so_tien" and kind("khai sinh ở đâu") is None and kind("không khai sinh bị phạt bao nhiêu") == "muc_phat"
    evidence = lambda k, t: spark.createDataFrame([(k, [t])], "k string, t array<string>").select(R.has_evidence(F.col("k"), F.col("t"))).first()[0]
    assert evidence("thoi_han", "trong 60 ngày") and not evidence("so_tien", "trong 60 ngày") and evidence(None, "")
    assert not evidence("muc_phat", "án phạt tù") and evidence("muc_phat", "bị phạt tiền")
    scope = lambda q: one(spark, R.out_of_scope, q)
    assert scope("làm hộ chiếu ở đâu") == "hộ chiếu, xuất nhập cảnh" and scope("khai sinh có cần căn cước không") is None
    assert scope("ly hôn thì chia tài sản thế nào") == "chia tài sản, cấp dưỡng khi ly hôn"
    assert one(spark, R.procedures, "khai sinh và kết hôn") == ["Khai sinh", "Kết hôn"]
    assert one(spark, R.is_underspecified, "Đăng ký mất bao lâu?") and not one(spark, R.is_underspecified, "Đăng ký khai sinh mất bao lâu?")
    assert one(spark, R.aspect, "khai sinh cần giấy tờ gì") == "ho_so" and one(spark, R.aspect, "khai sinh mất bao lâu") == "thoi_gian_giai_quyet"
    assert one(spark, R.aspect, "kết hôn") == "ho_so" and one(spark, R.aspect, "khai sinh muộn có sao không") == "lam_muon"
    assert one(spark, R.content_syllables, "Đăng ký khai sinh ở đâu 12") == ["dang", "ky", "khai", "sinh"]
    assert one(spark, R.content_syllables, "dang ky khai sinh o dau") == ["dang", "ky", "khai", "sinh"]
