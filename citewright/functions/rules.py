"""Rules on questions and texts: intents, evidence, topics and scope, as column expressions.

A pattern is written with accents. It is searched in the lower-cased text if that has
accents, else its stripped form in the stripped text.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewright.functions import text as T

# --- Fixed values: words and patterns that the results depend on. ---
QUESTION_WORD = r"\b(gì|đâu|bao lâu|bao nhiêu|mấy|thế nào|ra sao|làm sao|ai|nào|khi nào)\b|\bkhông\s*\??$"
SEPARATOR = r"(?iu)\s*(?:,|;|\?\s+|\s(?:và|va|còn|rồi)\s)\s*"
HEAD_STOP = "thì cần phải nộp làm ở mất trong có được bao gì đâu ai mấy khi là hết từ".split()
STOPWORDS = (
    "thì là có không được cần gì nào đâu bao lâu nhiêu mấy của cho và hay hoặc với ở tại để khi nếu làm sao thế như những các một tôi em mình bạn ạ nhé vậy ai phải đi mà này đó ra vào lại"
    " rồi đã sẽ đang bị theo về trong từ đến xong mất gồm phần việc muốn xin hỏi giúp ko k"
).split()
PLAIN_EXCEPTIONS = ("dang", "do", "ma", "the", "da", "di")
ABBREVIATIONS = {
    "k": "không", "ko": "không", "kg": "không", "khg": "không", "hok": "không", "hk": "không", "dc": "được", "đc": "được", "j": "gì",
    "ntn": "như thế nào", "vs": "với", "cx": "cũng", "mk": "mình", "mik": "mình", "r": "rồi",
}
#: (type, what asks for it, what a text must hold to answer it), in the order they are tried.
ANSWER_TYPES = (
    ("muc_phat", r"\b(xử phạt|mức phạt|bị phạt(?!\s+(hiện|tù))|phạt bao nhiêu|phạt tiền|phạt hành chính|chế tài)\b", r"\bphạt\b(?!\s+tù)"),
    (
        "so_tien", r"\b(lệ phí|phí|tiền)\b.*\b(bao nhiêu|mấy|mức)\b|\b(bao nhiêu|mấy|mức)\b.*\b(lệ phí|phí|tiền)\b",
        r"\d[\d.,]*\s*(đồng|nghìn|ngàn|triệu)\b|miễn lệ phí|miễn thu|không thu lệ phí|không phải nộp lệ phí",
    ),
    ("do_tuoi", r"\b(bao nhiêu tuổi|mấy tuổi|độ tuổi|đủ tuổi)\b", r"\d+\s*tuổi"),
    ("thoi_han", r"\b(bao lâu|mấy ngày|bao nhiêu ngày|thời hạn|hạn bao nhiêu|trong vòng)\b", r"\d+\s*(ngày|tháng|năm|giờ)\b|ngay trong ngày"),
)
PROCESSING_TIME = (
    r"\b(mất|hết|chờ|đợi) (bao lâu|mấy ngày|bao nhiêu ngày)|\b(bao lâu|mấy ngày|bao nhiêu ngày|bao giờ|khi nào)( làm việc)? (thì |mới )?"
    r"(xong|có kết quả|có giấy|lấy được|nhận được|được cấp)|\bthời hạn giải quyết|\bgiải quyết (trong )?(bao lâu|mấy ngày)"
)
DOCUMENTS = (
    r"\b(giấy tờ|hồ sơ|giấy) gì\b|\b(cần|nộp|chuẩn bị|mang theo|mang|xuất trình)( những| các)?( giấy tờ| giấy| hồ sơ)? (gì|nào)\b|\bhồ sơ (gồm|cần)\b|\bcần những giấy"
    r"|\b(cần|nộp) giấy( (?!để\b)\w+){1,4} gì\b"
)
LATE = r"\b(muộn|trễ|quá hạn|chậm|không (đi )?(đăng ký|khai|làm))\b.*\b(có bị gì|bị gì|có sao|bị sao|hậu quả|ảnh hưởng gì)"
#: What a text must hold to answer an aspect.
ASPECT_EVIDENCE = {
    "thoi_gian_giai_quyet": r"ngay sau khi nhận (đủ )?(giấy tờ|được yêu cầu)|ngay trong ngày|\d+\s*ngày làm việc|thời hạn giải quyết",
    "ho_so": r"\b(nộp|xuất trình)( lại| các| những| thêm| kèm theo| kèm)? (giấy|tờ khai|hồ sơ|bản sao|bản chính|văn bản|trích lục)|hồ sơ[^.;:]{0,60}\bgồm\b|giấy tờ sau",
    "lam_muon": r"\d+ ngày,? kể từ ngày (sinh|có người chết|chết)",
}
PROCEDURES = (
    ("Khai sinh", r"khai sinh|giấy chứng sinh|trẻ bị bỏ rơi|sinh con|mới đẻ|mới sinh"),
    ("Kết hôn", r"kết hôn|lấy chồng|lấy vợ|vợ chồng"),
    ("Xác nhận tình trạng hôn nhân", r"tình trạng hôn nhân|độc thân"),
    ("Khai tử", r"khai tử|báo tử|qua đời|chết|mất tích"),
    ("Nhận cha, mẹ, con", r"nhận cha|nhận mẹ|nhận con|cha, mẹ, con|cha mẹ con"),
    ("Giám hộ", r"giám hộ"),
    ("Thay đổi, cải chính hộ tịch", r"thay đổi|cải chính|bổ sung thông tin|bổ sung hộ tịch|xác định lại dân tộc|đổi tên|sửa (tên|thông tin|giấy)"),
    ("Ly hôn, hủy kết hôn", r"ly hôn|hủy việc kết hôn"),
    ("Trích lục, bản sao", r"trích lục|bản sao"),
    ("Đăng ký lại", r"đăng ký lại|làm lại (giấy )?(khai sinh|khai tử|chứng nhận kết hôn)"),
    ("Hộ tịch điện tử, trực tuyến", r"trực tuyến|online|điện tử|cơ sở dữ liệu"),
)
OUT_OF_SCOPE = (
    ("hộ chiếu, xuất nhập cảnh", r"hộ chiếu|visa|thị thực|xuất cảnh|nhập cảnh"),
    ("căn cước, định danh", r"căn cước|cccd|cmnd|chứng minh nhân dân|định danh điện tử|vneid"),
    ("cư trú", r"đăng ký thường trú|đăng ký tạm trú|khai báo tạm trú|nhập hộ khẩu|tách hộ khẩu|chuyển hộ khẩu"),
    ("đất đai, nhà ở", r"đất đai|thửa đất|sử dụng đất|sổ đỏ|sổ hồng|nhà đất|mua nhà|bán nhà"),
    ("thuế", r"thuế"),
    ("giao thông", r"bằng lái|giấy phép lái xe|đăng ký xe|đăng kiểm|xe máy|ô tô"),
    ("quốc tịch", r"quốc tịch"),
    ("bảo hiểm, lao động", r"bảo hiểm xã hội|bhxh|lương hưu|hợp đồng lao động|thất nghiệp"),
    ("doanh nghiệp, kinh doanh", r"thành lập công ty|doanh nghiệp|đăng ký kinh doanh|hộ kinh doanh|giấy phép kinh doanh|an toàn thực phẩm"),
)
OUT_OF_SCOPE_ALWAYS = (
    ("chia tài sản, cấp dưỡng khi ly hôn", r"tài sản chung|chia tài sản|cấp dưỡng|quyền nuôi con"),
    ("Luật Hộ tịch mới (hiệu lực 2027, chưa có trong kho)", r"luật hộ tịch (mới|năm 2026|năm 2027|2026|2027)|03/2026/qh16"),
)
IN_SCOPE_NAMES = (
    r"\b(?:khai sinh|giấy chứng sinh|kết hôn|khai tử|báo tử|hộ tịch|tình trạng hôn nhân|nhận cha|nhận mẹ|nhận con|giám hộ|cải chính|trích lục|đăng ký lại|ly hôn|thay đổi họ|đổi tên|xác định lại dân tộc)"
)
GENERAL_TOPIC = "Quy định chung"
# --- end of fixed values ---


def plain(pattern: str) -> str:
    """A pattern without accents."""
    d = unicodedata.normalize("NFD", pattern.replace("đ", "d").replace("Đ", "D"))
    return "".join(c for c in d if not unicodedata.combining(c))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def of_text(question: Column, rule) -> Column:
    """rule(x) on the cleaned question: x.low in lower case, x.bare also without accents."""
    return let(T.clean_query(question), lambda q: let(F.struct(F.lower(q).alias("low"), T.strip_latin(q).alias("bare")), rule))


def holds(x: Column, pattern: str) -> Column:
    return F.when(x["low"] != x["bare"], x["low"].rlike(f"(?U){pattern}")).otherwise(x["bare"].rlike(f"(?U){plain(pattern)}"))


def found(question: Column, pattern: str) -> Column:
    return of_text(question, lambda x: holds(x, pattern))


def _first(x: Column, named) -> Column:
    out = None
    for name, pattern in named:
        hit = holds(x, pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def _content(x: Column) -> Column:
    accented = T.content(T.tokens(x["low"]), tuple(STOPWORDS))
    stripped = T.content(T.tokens(x["bare"]), tuple(sorted({plain(w) for w in STOPWORDS} - set(PLAIN_EXCEPTIONS))))
    return F.when(x["low"] != x["bare"], F.transform(accented, T.strip_latin)).otherwise(stripped)


def content_syllables(question: Column) -> Column:
    """Content words, stripped: the stop list applies with accents if the text has any."""
    return of_text(question, _content)


def expected_type(question: Column) -> Column:
    return of_text(question, lambda x: _first(x, [(name, ask) for name, ask, _ in ANSWER_TYPES]))


def _holds(pattern: str):
    return lambda t: F.lower(T.clean_query(t)).rlike(f"(?U){pattern}")


def has_evidence(kind: Column, texts: Column) -> Column:
    """Whether any text holds a number of the kind; true if none is asked for."""
    out = F.when(kind.isNull(), True)
    for name, _, evidence in ANSWER_TYPES:
        out = out.when(kind == name, F.exists(texts, _holds(evidence)))
    return out


def _procedures(x: Column) -> Column:
    return F.array_compact(F.array(*[F.when(holds(x, rf"\b(?:{p})"), F.lit(name)) for name, p in PROCEDURES]))


def procedures(text: Column) -> Column:
    """Names of all procedures mentioned, in the order of the list."""
    return of_text(text, _procedures)


def _bare(x: Column) -> Column:
    return (F.size(_procedures(x)) == 1) & (F.size(_content(x)) <= 4) & ~holds(x, QUESTION_WORD)


def is_bare_procedure(question: Column) -> Column:
    return of_text(question, _bare)


def aspect(question: Column) -> Column:
    return of_text(question, lambda x: F.when(holds(x, PROCESSING_TIME), "thoi_gian_giai_quyet").when(holds(x, DOCUMENTS) | _bare(x), "ho_so").when(holds(x, LATE), "lam_muon"))


def answers_aspect(aspect_: Column, text: Column) -> Column:
    out = F.when(aspect_.isNull(), True)
    for name, evidence in ASPECT_EVIDENCE.items():
        out = out.when(aspect_ == name, F.lower(text).rlike(f"(?U){evidence}"))
    return out


def topic(*titles: Column) -> Column:
    """The first procedure of the first title that names one."""
    return F.coalesce(*[F.get(procedures(t), F.lit(0)) for t in titles], F.lit(GENERAL_TOPIC))


def is_underspecified(question: Column, most: int = 5) -> Column:
    return of_text(question, lambda x: (F.size(_procedures(x)) == 0) & (F.size(_content(x)) <= most))


def out_of_scope(question: Column) -> Column:
    """The field that a question belongs to, if it is none of ours; null otherwise."""
    border = lambda named: [(name, rf"\b(?:{p})") for name, p in named]
    return of_text(question, lambda x: F.coalesce(_first(x, border(OUT_OF_SCOPE_ALWAYS)), F.when(~holds(x, IN_SCOPE_NAMES), _first(x, border(OUT_OF_SCOPE)))))
