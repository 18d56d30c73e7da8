"""Texts of posts and messages, file names, image addresses, error classes."""

from __future__ import annotations

from functools import reduce
from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import clean, col, filled, html_escape, slugify, truncate

#: White space without the line feed.
INNER = r"[\t\x0B\f\r\x{85}\p{Z}]"
WIDTH, HEIGHT = 1080, 610
SUMMARY_STEPS = (450, 320, 220, 140, 80, 0)
#: What stands for the house itself where an article names no source, and the lines around a post's own text. Parameters, not results to match.
HOUSE = "Newsflow"
INTRO_LINES = ("TIN TỨC MỚI", "👉 Bấm vào từng ảnh để xem nội dung chi tiết.")


def caption_text(c: Column | str) -> Column:
    """Lines trimmed, blanks in lines single, runs of empty lines single, none at the ends."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), rf"{INNER}*\n{INNER}*", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), rf"^(?:\n|{INNER})+|(?:\n|{INNER})+$", "")


def is_http_url(c: Column | str) -> Column:
    return F.trim(F.coalesce(col(c), F.lit(""))).rlike(r"^(?i:https?)://[^/?#]+")


def photo_caption(order: Column | str, title: Column | str, summary: Column | str, source: Column | str, url: Column | str, house: str = HOUSE) -> Column:
    """'N. title', the summary unless it is the title, source and link. NULL for rows without a title or with a url that is not http(s)."""
    head, short, link = clean(title), truncate(summary), clean(url)
    lines = F.concat_ws(
        "\n",
        F.concat(col(order).cast("int").cast("string"), F.lit(". "), head),
        F.when((short != "") & (F.lower(short) != F.lower(head)), F.concat(F.lit("\n"), short)),
        F.concat(F.lit("\nNguồn: "), F.coalesce(filled(clean(source)), F.lit(house))),
        F.when(link != "", F.concat(F.lit("🔗 Xem chi tiết: "), link)),
    )
    return F.when((head != "") & ((link == "") | is_http_url(link)), caption_text(lines))


def main_caption(moment: Column | str, intro: Column | str, lines: tuple[str, str] = INTRO_LINES) -> Column:
    """Caption of a whole post; moment is a timestamp."""
    m = col(moment)
    when = F.concat(F.lit("Cập nhật ngày "), F.date_format(m, "dd/MM/yyyy"), F.lit(" lúc "), F.date_format(m, "HH:mm"))
    return caption_text(F.concat_ws("\n", F.lit(lines[0]), when, F.lit(""), clean(intro), F.lit(""), F.lit(lines[1])))


def _trim(c: Column, limit: int) -> Column:
    text = clean(c)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(0, limit - 3))), F.lit("...")))


def telegram_message(row: dict[str, Column] | None = None, summary_chars: int = 450, house: str = HOUSE) -> Column:
    """HTML message of an article; row replaces the columns of the same names."""
    at = lambda c: (row or {}).get(c, F.col(c))
    part = lambda c, limit: html_escape(_trim(c, limit))
    category = F.coalesce(filled(at("category")), filled(at("content_topic")), F.lit("Tin tức"))
    moment = part(F.coalesce(filled(at("published_at")), filled(at("crawled_at")), F.lit("")), 80)
    return F.concat(
        F.lit(f"📰 {house} | "), part(category, 120),
        F.lit("\n\n<b>"), part(F.coalesce(filled(at("title")), F.lit("Không có tiêu đề")), 300),
        F.lit("</b>\n\n📝 Tóm tắt:\n"), part(F.coalesce(filled(at("summary")), F.lit("Chưa có tóm tắt.")), summary_chars),
        F.lit("\n\n📌 Nguồn: "), part(F.coalesce(filled(at("source")), F.lit(house)), 160),
        F.when(moment != "", F.concat(F.lit("\n🗓 Ngày đăng: "), moment)).otherwise(""),
        F.lit("\n🏷 Chủ đề: "), part(F.coalesce(filled(at("content_topic")), category), 120),
        F.lit("\n🔗 Đọc bài viết: "), part(at("url"), 900),
    )


def fit_telegram(limit: int) -> Column:
    """The message with the longest summary that fits; then with title and url cut; then cut itself."""
    whole = [telegram_message(summary_chars=n) for n in SUMMARY_STEPS]
    small = telegram_message({"summary": F.lit(""), "title": _trim(F.col("title"), 120), "url": _trim(F.col("url"), 500)}, 0)
    fits = [F.when(F.length(m) <= limit, m) for m in (*whole, small)]
    return F.coalesce(*fits, F.concat(F.rtrim(F.substring(small, 1, limit - 3)), F.lit("...")))


def card_filenames(df: DataFrame, key: str = "id", index: Column | None = None, house: str = HOUSE.lower()) -> DataFrame:
    """df with `filename`: [NNN-]source-category-title as a slug of 180 characters; later rows of one name get -2, -3 and so on."""
    slug = lambda c: filled(F.substring(slugify(F.trim(c), ""), 1, 100))
    title = F.coalesce(slug(F.col("title")), F.concat(F.lit("article-"), F.substring(F.sha1(F.encode(F.coalesce("url", F.lit("")), "UTF-8")), 1, 10)))
    category = F.coalesce(slug(F.coalesce(filled("category"), filled("content_topic"), F.lit(""))), F.lit("news"))
    parts = [F.coalesce(slug(F.col("source")), F.lit(house)), category, title]
    if index is not None:
        parts.insert(0, F.lpad(index.cast("string"), 3, "0"))
    df = df.withColumn("stem", F.regexp_replace(F.substring(F.concat_ws("-", *parts), 1, 180), "^-+|-+$", ""))
    n = F.row_number().over(Window.partitionBy("stem").orderBy(key))
    return df.withColumn("filename", F.concat("stem", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".jpg"))).drop("stem")


def srcset_best(c: Column | str) -> Column:
    """The widest candidate of a srcset; an `x` counts 1080, a candidate without a width 0, of equals the last one wins."""
    items = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: clean(x)), lambda x: x != "")

    def scored(item: Column, i: Column) -> Column:
        words = F.split(F.lower(item), " ")
        numbers = F.transform(
            F.slice(words, 2, F.size(words)),
            lambda w: F.when(w.rlike(r"^\d*\.?\d+w$"), F.regexp_extract(w, r"^(.*)w$", 1).cast("double")).when(w.rlike(r"^\d*\.?\d+x$"), F.regexp_extract(w, r"^(.*)x$", 1).cast("double") * WIDTH).otherwise(0.0),
        )
        return F.struct(F.coalesce(F.array_max(numbers), F.lit(0.0)).alias("width"), i.alias("i"), F.split_part(item, F.lit(" "), F.lit(1)).alias("url"))

    return F.coalesce(F.array_max(F.transform(items, scored))["url"], F.lit(""))


#: Query keys of signed addresses, and those that set a size or quality.
SIGNED = ("s", "sig", "signature", "token", "auth", "expires", "exp")
WIDTH_KEYS, HEIGHT_KEYS, QUALITY_KEYS = ("w", "width", "maxwidth", "imgmax"), ("h", "height", "maxheight"), ("q", "quality")


def variants_of(url: str) -> list[str]:
    """The address asked for full size, without its query, and as it is; signed ones only as they are."""
    parts = urlparse(url)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return [url]
    asked = dict(parse_qsl(parts.query, keep_blank_values=True))
    if {k.lower() for k in asked} & set(SIGNED):
        return [url]
    sized = {k: str(WIDTH) for k in WIDTH_KEYS} | {k: str(HEIGHT) for k in HEIGHT_KEYS}
    full = asked
    if asked.keys() & sized.keys():
        forced = sized | {k: "100" for k in QUALITY_KEYS}
        full = {k: forced.get(k, v) for k, v in asked.items()}
        full = {**full, "q": full.get("q", "100"), "dpr": "1", "fit": full.get("fit", "crop")}
    options = (urlunparse(parts._replace(query=q)) for q in (urlencode(full), ""))
    return [*dict.fromkeys(x for x in options if x != url), url]


@F.pandas_udf(ArrayType(StringType()))
def image_url_variants(url: pd.Series) -> pd.Series:
    return url.fillna("").map(lambda x: variants_of(x.strip()))


@F.pandas_udf(StringType())
def normalize_url(base: pd.Series, url: pd.Series) -> pd.Series:
    """Address relative to base made absolute; '' for none, the text itself where it cannot be parsed."""

    def joined(b: str, u: str) -> str:
        try:
            return urljoin(b, u.strip()) if u else ""
        except ValueError:
            return u.strip()

    return pd.Series([joined(b or "", u or "") for b, u in zip(base, url, strict=True)], dtype=object)


#: Error codes of the posting service by class, and words of its messages.
ERRORS = (("auth", (190, 463, 467), ("expired",)), ("permission", (10, 200, 298), ("pages_manage_posts", "permission")), ("rate", (4, 17, 32, 613), ("rate",)))


def error_class(code: Column | str, message: Column | str) -> Column:
    """auth, permission, rate, page or other: the first whose code or word fits."""
    said = F.lower(F.coalesce(col(message), F.lit("")))
    number = F.coalesce(col(code), F.lit(0))
    rules = [(name, number.isin(*codes) | reduce(Column.__or__, (said.contains(w) for w in words))) for name, codes, words in ERRORS]
    rules.append(("page", (number == 100) & (said.contains("object") | said.contains("page"))))
    chain = F.when(rules[0][1], rules[0][0])
    for name, rule in rules[1:]:
        chain = chain.when(rule, name)
    return chain.otherwise("other")


def thumbnail_score(width: Column | str, height: Column | str) -> Column:
    """How well an image of this size fills the card's picture area; NULL without a size. The best of several is a max_by."""
    w, h = col(width).cast("double"), col(height).cast("double")
    upscale = F.greatest(F.lit(float(WIDTH)) / w, F.lit(float(HEIGHT)) / h, F.lit(0.01))
    misfit = F.abs(w / h - F.lit(WIDTH / HEIGHT)) / F.lit(WIDTH / HEIGHT)
    return F.when((w > 0) & (h > 0), F.lit(1.0) / upscale + F.least(w * h / F.lit(float(WIDTH * HEIGHT)), F.lit(2.0)) * 0.18 - misfit * 0.08)
