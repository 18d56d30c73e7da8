"""Topics, news types, statuses: fixed rule tables and the expressions made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, col, filled, has_alias, like, normalize, text_key, to_ascii

# Labels, aliases and word lists that results must share.
STATUSES = ("approved", "deleted", "pending", "rejected")
CLIENT_TOPICS = ("Tin tức chung", "Tin tức PTIT", "Giáo dục", "Khoa học - Công nghệ", "Kinh doanh", "Pháp luật", "Sức khỏe", "Thế giới", "Thể thao", "Thời sự", "Giải trí")
PUBLIC = ("approved", "published", "publish", "public", "posted", "dang", "da dang", "duyet", "da duyet")
GROUPS = {
    "published": PUBLIC,
    "pending": ("pending", "waiting", "draft", "review", "cho duyet", "can duyet", "moi"),
    "rejected": ("rejected", "reject", "hidden", "unpublished", "tu choi", "bi tu choi", "go khoi client"),
    "deleted": ("deleted", "delete", "removed", "archived", "xoa", "da xoa"),
}
BY_CATEGORY = {"Khoa học - Công nghệ": "Khoa học - Công nghệ", "Giáo dục": "Giáo dục", "Khoa giáo - Khoa học công nghệ": "Khoa học - Giáo dục", "Tin tức chung": "Tin tức PTIT"}
KEYWORDS = {
    "Thời sự": ("chính phủ", "quốc hội", "ubnd", "hà nội", "tp hcm", "mưa lớn", "ngập", "cháy", "tai nạn", "cứu hộ", "dự án"),
    "Kinh doanh": ("giá", "thị trường", "chứng khoán", "vn-index", "xăng", "doanh nghiệp", "ngân hàng", "lãi suất", "bất động sản", "đầu tư", "tài chính"),
    "Giáo dục": ("đại học", "học sinh", "sinh viên", "thi tốt nghiệp", "tuyển sinh", "giáo dục", "điểm chuẩn", "du học"),
    "Khoa học - Công nghệ": ("ai", "trí tuệ nhân tạo", "chatgpt", "công nghệ", "robot", "phần mềm", "dữ liệu", "startup", "bán dẫn", "điện thoại", "khoa học"),
    "Thể thao": ("bóng đá", "world cup", "cầu thủ", "hlv", "ngoại hạng", "tennis", "bóng chuyền", "sea games", "olympic"),
    "Sức khỏe": ("bệnh viện", "bệnh nhân", "sức khỏe", "hiến tạng", "bác sĩ", "thuốc", "ung thư", "sàng lọc", "dịch bệnh"),
    "Pháp luật": ("buôn lậu", "khởi tố", "bị bắt", "công an", "đường dây", "tạm giam", "điều tra", "truy tố", "xét xử"),
    "Giải trí": ("ca sĩ", "diễn viên", "hoa hậu", "phim", "âm nhạc", "nghệ sĩ", "showbiz", "concert"),
    "Thế giới": ("nga", "mỹ", "trung quốc", "ukraine", "israel", "gaza", "châu âu", "tổng thống", "thủ tướng"),
}
NEWS_TYPES = {"vnexpress": "Báo điện tử", "báo chính phủ": "Cổng thông tin Chính phủ", "baochinhphu": "Cổng thông tin Chính phủ", "ptit": "Trang tin trường đại học", "dân trí": "Báo điện tử tổng hợp", "dantri": "Báo điện tử tổng hợp", "24h": "Trang tin tổng hợp"}
CANONICAL = {
    "Giáo dục": ("giao duc",), "Khoa học - Công nghệ": ("khoa giao", "khoa hoc", "cong nghe"), "Kinh doanh": ("kinh doanh",), "Pháp luật": ("phap luat",), "Sức khỏe": ("suc khoe",),
    "Thế giới": ("the gioi",), "Thể thao": ("the thao",), "Thời sự": ("thoi su",), "Giải trí": ("giai tri",),
}
CANONICAL_LIKE = {
    "Giáo dục": ("Giáo dục", "giao duc"), "Khoa học - Công nghệ": ("Khoa giáo", "Khoa học", "Công nghệ", "khoa hoc", "cong nghe"), "Kinh doanh": ("Kinh doanh",),
    "Pháp luật": ("Pháp luật", "phap luat"), "Sức khỏe": ("Sức khỏe", "suc khoe"), "Thế giới": ("Thế giới", "the gioi"), "Thể thao": ("Thể thao", "the thao"),
    "Thời sự": ("Thời sự", "thoi su"), "Giải trí": ("Giải trí", "giai tri"),
}
SOURCE_ALIASES = {"VNExpress": ("vnexpress", "vn express", "vnex"), "Báo Chính phủ": ("bao chinh phu", "chinh phu"), "PTIT": ("ptit", "hoc vien cong nghe buu chinh vien thong")}
TOPIC_ALIASES = {
    "công nghệ": ("cong nghe", "ai", "tri tue nhan tao", "chatgpt", "phan mem", "iphone"), "kinh doanh": ("kinh doanh", "thi truong", "chung khoan", "bat dong san", "doanh nghiep", "gia vang"),
    "giáo dục": ("giao duc", "sinh vien", "hoc tap", "truong", "dai hoc", "thi tot nghiep"), "thể thao": ("the thao", "bong da", "world cup", "v league", "tennis"), "giải trí": ("giai tri", "dien anh", "am nhac", "nghe si"),
    "sức khỏe": ("suc khoe", "y te", "benh", "bac si"), "pháp luật": ("phap luat", "toa an", "cong an", "vu an"), "đời sống": ("doi song", "xa hoi", "gia dinh", "du lich"), "thời sự": ("thoi su", "chinh phu", "quoc hoi"),
}
STOP_WORDS = ("khong", "nao", "moi", "nhat", "hom", "nay", "cho", "toi", "xem", "tin", "bai", "bao", "co", "tim", "ve")
COUNT_WORDS = ("bao nhieu", "so luong", "co may", "tong so", "dem")
TODAY_WORDS = ("hom nay", "trong ngay", "ngay nay", "moi hom nay")
SUMMARY_WORDS = ("tom tat", "tong hop", "diem tin")
ADVICE_WORDS = ("dang doc", "nen doc", "quan trong", "noi bat", "goi y")
LATEST_WORDS = ("tin moi", "moi nhat", "hom nay", "gan day")
LOOSE_WORDS = ("tim", "bai ve", "lien quan den", "ve ai", "ai", "sinh vien", "hoc tap", "viec lam")


def first_of(rules: list[tuple[Column, Column | str]], default: Column) -> Column:
    """The value of the first rule that holds."""
    out = None
    for test, value in rules:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default) if out is not None else default


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """text holds one of the words."""
    test = F.lit(False)
    for w in words:
        test = test | text.contains(w)
    return test


def raw_topic() -> Column:
    return F.coalesce(filled("category"), filled("content_topic"), F.lit(""))


def canonical_topic() -> Column:
    """On folded text; the label of an unknown topic is the trimmed text, or that of fresh news."""
    raw = F.regexp_replace(raw_topic(), r"(?U)^\s+|\s+$", "")
    key = text_key(raw)
    rules = [(text_key("source").contains("ptit") | key.contains("ptit"), "Tin tức PTIT")]
    rules += [(any_of(key, words), label) for label, words in CANONICAL.items()]
    rules += [(key.contains("tin tuc chung"), "Thời sự")]
    return first_of(rules, F.when(raw == "", F.lit("Tin mới")).otherwise(raw))


def canonical_topic_like() -> Column:
    """By LIKE, with ASCII case folding; it differs from canonical_topic on purpose."""
    raw = raw_topic()
    rules = [(like(F.coalesce("source", F.lit("")), "%PTIT%") | like(raw, "%PTIT%"), "Tin tức PTIT")]
    for label, words in {**CANONICAL_LIKE, "Thời sự ": ("Tin tức chung", "tin tuc chung")}.items():
        test = F.lit(False)
        for w in words:
            test = test | like(raw, f"%{w}%")
        rules.append((test, label.strip()))
    return first_of(rules, raw)


def resolve_topic(c: Column) -> Column:
    """The client topic of equal fold, else the trimmed text."""
    key = text_key(c)
    folds = F.create_map(*[x for t in CLIENT_TOPICS for x in (text_key(F.lit(t)), F.lit(t))])
    return F.coalesce(F.element_at(folds, key), F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))


def classify_topic(title: str, summary: str, default: str) -> Column:
    text = F.lower(F.concat(col(title), F.lit(" "), col(summary)))
    rules = [(col(default) == k, v) for k, v in BY_CATEGORY.items()] + [(any_of(text, words), topic) for topic, words in KEYWORDS.items()]
    return first_of(rules, F.coalesce(filled(default), F.lit("Khác")))


def classify_news_type(source: str) -> Column:
    text = F.lower(F.coalesce(col(source), F.lit("")))
    return first_of([(text.contains(k), v) for k, v in NEWS_TYPES.items()], F.lit("Không xác định"))


def status_group(status: str) -> Column:
    value = F.regexp_replace(to_ascii(F.lower(F.regexp_replace(F.coalesce(col(status), F.lit("")), r"(?U)^\s+|\s+$", ""))), r"[\s_-]+", " ")
    return first_of([(value.isin(*names), group) for group, names in GROUPS.items()], F.lit("other"))


def is_public(status: str = "status") -> Column:
    return ascii_lower(F.trim(status)).isin(*PUBLIC)


def is_publishable(status: str = "status") -> Column:
    plain = F.trim(F.regexp_replace(F.lower(to_ascii(F.trim(F.coalesce(col(status), F.lit(""))))), r"\s+", " "))
    return (F.trim(F.coalesce(col(status), F.lit(""))) == "Đã đăng") | plain.isin("approved", "published", "da dang")


def hints(message: str) -> dict[str, Column]:
    """source, topic and keyword that a message asks for."""
    text = normalize(message)
    pick = lambda table: first_of([(_any_alias(text, a), label) for label, a in table.items()], F.lit(""))
    source, topic = pick(SOURCE_ALIASES), pick(TOPIC_ALIASES)
    asked = F.regexp_extract(text, r"(?:tim|bai ve|lien quan den|ve|chu de)\s+(.+)", 1)
    words = lambda c, test, n: F.array_join(F.slice(F.filter(F.split(c, " "), test), 1, n), " ")
    cleaned = words(asked, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 1), 8)
    long = words(text, lambda w: F.length(w) > 2, 6)
    keyword = F.when(asked != "", cleaned).when((source == "") & (topic == ""), long).otherwise(F.lit(""))
    return {"source": source, "topic": topic, "keyword": keyword}


def _any_alias(text: Column, aliases: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for a in aliases:
        test = test | has_alias(text, a)
    return test


def intent(message: str, source: str = "source", topic: str = "topic", keyword: str = "keyword") -> Column:
    """struct(type, simple, keyword) from a message and its hints."""
    text = normalize(message)
    s, t, k = (F.col(c) for c in (source, topic, keyword))
    explicit = text.rlike(r"\b(tim|bai ve|lien quan den|chu de|ve)\b")
    count, today = any_of(text, COUNT_WORDS), any_of(text, TODAY_WORDS)
    made = lambda kind, simple=True, word=k: F.struct(F.lit(kind).alias("type"), F.lit(simple).alias("simple"), word.alias("keyword"))
    word = F.when(~explicit & (s == "") & (t == ""), F.lit("")).otherwise(k)
    return first_of(
        [(count & today, made("count_today", True, word)), (count, made("count", True, word)), (any_of(text, SUMMARY_WORDS), made("summarize", False)), (any_of(text, ADVICE_WORDS), made("recommend", False)),
         (explicit & (k != ""), made("search")), (s != "", made("source")), (t != "", made("topic")), (any_of(text, LATEST_WORDS), made("latest")), (any_of(text, LOOSE_WORDS) | (k != ""), made("search"))],
        made("search", False))


