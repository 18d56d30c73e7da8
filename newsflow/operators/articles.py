"""Listing, search, dashboard, merge and publication operators on article DataFrames.

Wall-clock values are parameters (`as_of`), never read from the clock. Input order is an explicit column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import topics
from ..functions.publishing import HOUSE
from ..functions.text import blank, clean, filled, like, matches, normalize
from ..shared import scratch

UNSET_ORDER = 2147483647
DATES = {
    "approved": ("approved_at", "reviewed_at", "updated_at", "published_at", "crawled_at"), "pending": ("crawled_at", "updated_at", "published_at"),
    "rejected": ("reviewed_at", "updated_at", "published_at", "crawled_at"), "deleted": ("deleted_at", "updated_at", "published_at", "crawled_at"), "": ("published_at", "crawled_at"),
}


def moment(c: Column) -> Column:
    """Timestamp of text that starts like a date, else NULL; never an error."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c.try_cast("timestamp"))


def date_text(status: str) -> Column:
    return F.coalesce(*(filled(c) for c in DATES.get(status, DATES[""])), F.col("created_at"))


def business_order() -> list[Column]:
    """Fixed places first, then days, newest first; within a day the institute's own news before others."""
    placed = F.coalesce("client_order", F.lit(0)) > 0
    when = moment(date_text("approved"))
    own = like("source", "%ptit%") | like("source", "%buu chinh%") | like("source", "%bưu chính%")
    return [F.when(placed, 0).otherwise(1).asc(), F.when(placed, F.col("client_order")).otherwise(UNSET_ORDER).asc(), F.to_date(when).desc(), when.desc(), F.when(own, 0).otherwise(1).asc(), filled("published_at").desc(), F.col("id").desc()]


def default_order(status: str) -> list[Column]:
    when = moment(date_text(status))
    return [F.to_date(when).desc(), when.desc(), filled("published_at").desc(), F.col("id").desc()]


def recent_order() -> list[Column]:
    out = []
    for c in ("published_at", "crawled_at"):
        out += [moment(filled(c)).desc(), filled(c).desc()]
    return [*out, moment(filled("created_at")).desc(), F.col("id").desc()]


def order_of(status: str) -> list[Column]:
    return business_order() if status == "approved" else default_order(status)


def where(df: DataFrame, status: str = "", q: str = "", topic: str = "", source: str = "", date: str = "", canonical: bool = True) -> DataFrame:
    """The conjunction of the given filters; empty ones do not filter."""
    tests = []
    if status:
        tests.append(F.col("status") == status)
    if q:
        tests.append(like("title", f"%{q}%") | like("summary", f"%{q}%") | like("source", f"%{q}%"))
    if topic and not canonical:
        tests.append((F.col("content_topic") == topic) | (F.col("category") == topic))
    elif topic == "Tin tức chung":
        s = F.coalesce("source", F.lit(""))
        tests.append(~(like(s, "%ptit%") | like(s, "%buu chinh%") | like(s, "%bưu chính%")))
    elif topic:
        tests.append(topics.canonical_topic_like() == topic)
    if source:
        tests.append(F.col("source") == source)
    if date:
        tests.append(F.to_date(moment(date_text(status))) == F.lit(date).cast("date"))
    for t in tests:
        df = df.where(t)
    return df


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 12, total: int | None = None) -> DataFrame:
    """One page in order with its positions. The number is clamped to the pages there are, when the total is known."""
    if total is not None:
        number = max(1, min(number, -(-total // size) or 1))
    skip = (max(number, 1) - 1) * size
    rows = df.orderBy(*order).limit(skip + size).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    return rows.where(F.col("pos") > skip)


def keep_first(df: DataFrame, key: str = "url", order: str = "ord") -> DataFrame:
    """Rows with a key, the first of each key by the explicit order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.where(F.coalesce(key, F.lit("")) != "").withColumn("_n", n).where("_n = 1").drop("_n")


def last_by_key(df: DataFrame, key: str = "url", order: str = "ord") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return df.where(F.coalesce(key, F.lit("")) != "").withColumn("_n", n).where("_n = 1").drop("_n")


def new_rows(latest: DataFrame, master: DataFrame) -> DataFrame:
    """Latest rows whose url the master does not have, first of each url."""
    known = master.select("url").where("url <> ''").distinct()
    return keep_first(latest.join(known, "url", "left_anti"))


def merge_master(master: DataFrame, latest: DataFrame, columns: list[str]) -> DataFrame:
    """Master rows overlaid with the non-blank values of the last latest row of their url, then the new rows."""
    over = last_by_key(latest).select("url", *(F.col(c).alias(f"_{c}") for c in columns if c != "url"))
    old = master.join(over, "url", "left").select("ord", *(F.col("url") if c == "url" else F.coalesce(filled(f"_{c}"), F.col(c)).alias(c) for c in columns))
    new = new_rows(latest, master).select(F.col("ord") + 1_000_000_000, *columns)
    return keep_first(old.union(new))


def replace_by_url(target: DataFrame, updated: DataFrame, columns: list[str]) -> DataFrame:
    """Target rows replaced whole by the last update of their url; updates without a target row are appended."""
    over = last_by_key(updated).select(F.struct(*columns).alias("_new"), F.col("url").alias("_url"))
    old = target.join(over, F.col("url") == F.col("_url"), "left").select(F.when(F.col("_url").isNotNull(), F.col("_new")).otherwise(F.struct(*columns)).alias("r"))
    new = updated.where(F.coalesce("url", F.lit("")) != "").join(target.select("url").distinct(), "url", "left_anti").select(F.struct(*columns).alias("r"))
    return old.union(new).select("r.*")


def public_window(df: DataFrame, limit: int) -> DataFrame:
    """The newest public rows among which a search of `limit` results looks; filters apply after this limit."""
    return df.where(topics.is_public()).orderBy(*recent_order()).limit(max(limit * 20, 250))


def search(df: DataFrame, keyword: str = "", topic: str = "", source: str = "", limit: int = 5) -> DataFrame:
    """Folded search inside the window of newest public rows."""
    fold = lambda s: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in _plain(s)).split())
    rows = public_window(df, limit)
    text = {c: normalize(c) for c in ("title", "summary", "source", "category", "content_topic")}
    if source:
        rows = rows.where(matches(fold(source), text["source"]))
    if topic:
        n = fold(topic)
        rows = rows.where(matches(n, text["content_topic"]) | matches(n, text["category"]) | matches(n, text["title"]) | matches(n, text["summary"]))
    if keyword:
        every = normalize(F.concat_ws(" ", "title", "summary", "source", "category", "content_topic"))
        rows = rows.where(matches(fold(keyword), every))
    order = recent_order()
    return rows.orderBy(*order).limit(limit).withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def _plain(text: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFKD", text.lower().replace("đ", "d")).encode("ascii", "ignore").decode()


def tally(df: DataFrame, label: Column, name: str, total: str = "total") -> DataFrame:
    return df.groupBy(label.alias(name)).agg(F.count("*").alias(total))


def status_counts(df: DataFrame) -> DataFrame:
    """Every known status, also with 0, and unknown ones as they are."""
    known = df.sparkSession.createDataFrame([(s,) for s in topics.STATUSES], "status string")
    return known.withColumn("total", F.lit(0).cast("bigint")).union(tally(df, F.col("status"), "status")).groupBy("status").agg(F.sum("total").alias("total"))


def facebook_counts(df: DataFrame) -> DataFrame:
    n = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("bigint")
    posted = F.coalesce("facebook_posted", F.lit(0)) == 1
    return df.agg(n(posted).alias("posted"), n((F.col("status") == "approved") & ~posted).alias("approved_not_posted"), n(F.col("facebook_publish_status") == "failed").alias("failed"), n(F.col("facebook_publish_status") == "posting").alias("posting"))


def quality_warnings(df: DataFrame) -> DataFrame:
    n = lambda test: F.count_if(test)
    return df.agg(n(blank("summary")).alias("missing_summary"), n(blank("thumbnail") & blank("image_path")).alias("missing_image"), n(blank("url")).alias("missing_url"))


def numbered(df: DataFrame, order: list[Column], name: str = "pos", kind: str = "int") -> DataFrame:
    """Positions 1..n over all rows. Rows are dealt out by ranges of the order, sorted there and written to the shared folder; a row's position
    is its place there after the rows of the ranges before, of which there is one count each. No window spans all rows."""
    spark = df.sparkSession
    path = scratch(spark, "numbered")
    part, place = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")
    df.orderBy(*order).select("*", part, place).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", "_first", before.alias("_before"))
    return rows.join(starts, "_part").select(*df.columns, (F.col("_before") + F.col("_place") - F.col("_first") + 1).cast(kind).alias(name))


def move(df: DataFrame, article: int, step: int) -> DataFrame:
    """Approved rows numbered 1..n in business order after one of them changed place with its neighbour. At an edge nothing moves."""
    ranked = numbered(df.where("status = 'approved'"), business_order(), "rank").select("id", "rank")
    at = ranked.agg(F.max(F.when(F.col("id") == article, F.col("rank"))).alias("at"), F.count("*").alias("n")).first()
    if at["at"] is None:
        raise ValueError("the article is not in the list")
    i, j = at["at"], at["at"] + step
    if not 1 <= j <= at["n"]:
        return ranked.select("id", F.col("rank").alias("client_order"))
    return ranked.select("id", F.when(F.col("rank") == i, j).when(F.col("rank") == j, i).otherwise(F.col("rank")).alias("client_order"))


def set_status(df: DataFrame, ids: list[int] | Column | DataFrame, status: str, now: str) -> DataFrame:
    """Rows of the ids (a list, a table with `id`, or a condition) get the status and its timestamps; a return to pending keeps the old ones.

    approval_status, where there is one, follows all but a deletion.
    """
    if status not in topics.STATUSES:
        raise ValueError("unknown status")
    columns = df.columns
    if isinstance(ids, DataFrame):
        df = df.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
        hit = F.col("_hit").isNotNull()
    else:
        hit = ids if isinstance(ids, Column) else F.col("id").isin(ids)
    stamp = {"updated_at"} | ({"reviewed_at"} if status in ("approved", "rejected") else set()) | ({"approved_at"} if status == "approved" else set()) | ({"deleted_at"} if status == "deleted" else set())
    named = {"status"} | ({"approval_status"} & set(columns) if status != "deleted" else set())
    values = {**dict.fromkeys(sorted(named), status), **dict.fromkeys(sorted(stamp), now)}
    return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}).select(*columns)


def batches(df: DataFrame, group: str, order: str, ident: str, most: int = 10) -> DataFrame:
    """Posts of a group's items in order: (group, batch, batch_id, photos). A post takes `most` items, never fewer than two are allowed as bound;
    batch_id is a digest of its ids, of which there are `most` at most."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    rows = df.withColumn("_n", n).withColumn("batch", F.floor((F.col("_n") - 1) / max(2, most)).cast("bigint"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(ident).cast("string").alias("id")))), lambda x: x["id"])
    digest = F.substring(F.sha2(F.array_join(ids, ","), 256), 1, 16)
    return rows.groupBy(group, "batch").agg(digest.alias("batch_id"), F.count("*").alias("photos"))


def images_of(df: DataFrame, images: DataFrame, slug: str = "slug", gram: int = 6) -> DataFrame:
    """(id, image_id): the newest image whose stem contains the article's slug. Slug and stem meet on the slug's first `gram`
    characters, of which a stem offers every place, so no article is compared with every image."""
    heads = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda n: F.substr("stem", i, n)))))
    offered = images.where("stem <> ''").select("image_id", "stem", "mtime", F.explode(heads).alias("head"))
    asked = df.where(F.col(slug) != "").select("id", F.col(slug).alias("slug"), F.substring(slug, 1, gram).alias("head"))
    met = asked.join(offered, "head").where(F.col("stem").contains(F.col("slug")))
    return met.groupBy("id").agg(F.max_by("image_id", "mtime").alias("image_id"))


def upsert(cms: DataFrame, rows: DataFrame, now: str, place: bool = False) -> DataFrame:
    """CMS rows with a crawl merged by url: eight columns take new non-blank values, summaries only fill blanks; the rest is inserted as pending.

    Rows of a url after its first one update what the first inserted, so an insert has, per column, the last non-blank value.
    Rows without a url are inserted each. With `place`, `ord` says which row inserted a new one (null for old rows).
    """
    good = rows.where(~F.trim(F.coalesce("source", F.lit(""))).isin("Dân trí", "24h") & ~blank("title")).withColumn("url", F.trim(F.coalesce("url", F.lit(""))))
    take = ("source", "title", "published_at", "crawled_at", "thumbnail", "newspaper_type", "content_topic", "category")
    keep = ("summary", "summary_source")
    some = lambda c: F.when(~blank(c), F.col(c))
    last = lambda c: F.max_by(some(c), F.when(~blank(c), F.col("ord"))).alias(f"n_{c}")
    first = lambda c: F.min_by(some(c), F.when(~blank(c), F.col("ord"))).alias(f"n_{c}")
    by_url = good.where("url <> ''").groupBy("url").agg(*(last(c) for c in take), *(first(c) for c in keep), F.min("ord").alias("ord"))
    merged = cms.join(by_url, "url", "left")
    old = merged.select(F.col("id"), "url", *(F.coalesce(f"n_{c}", c).alias(c) for c in take), *(F.when(blank(c), F.coalesce(f"n_{c}", c)).otherwise(F.col(c)).alias(c) for c in keep), "status",
                        F.when(F.col("n_title").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"), F.lit(None).cast("bigint").alias("ord"))
    fresh = by_url.join(cms.select("url").where("url <> ''").distinct(), "url", "left_anti").select("url", *(F.coalesce(f"n_{c}", F.lit("")).alias(c) for c in take + keep), "ord")
    loose = good.where("url = ''").select("url", *(F.coalesce(c, F.lit("")).alias(c) for c in take + keep), "ord")
    new = fresh.union(loose).select(F.lit(None).cast("bigint").alias("id"), "url", *take, *keep, F.lit("pending").alias("status"), F.lit(now).alias("updated_at"), F.col("ord").cast("bigint").alias("ord"))
    out = old.unionByName(new)
    return out if place else out.drop("ord")


#: What Python's strip() takes off ASCII texts, summary sources that a forced run replaces, the least summary.
STRIP = " \t\n\r\x0b\f\x1c\x1d\x1e\x1f"
UPGRADEABLE = ("fallback", "missing_content", "pending")
MIN_SUMMARY = 30


def edit_content(df: DataFrame, edits: DataFrame, now: str, house: str = HOUSE) -> DataFrame:
    """Articles with the edits of their id: texts stripped, a blank source is the house, the caption goes unless the article was posted.

    An edit with a blank title or an order that is no whole number changes nothing; `edit_error` says which. Edits hold one row an id.
    """
    text = ("source", "title", "url", "published_at", "summary", "content_topic", "category")
    strip = lambda c: F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(STRIP))
    new = edits.select("id", *(strip(c).alias(f"n_{c}") for c in (*text, "client_order")), F.lit(True).alias("asked"))
    number = F.when(F.col("n_client_order") == "", 0).when(F.col("n_client_order").rlike(r"^[+-]?[0-9]{1,9}$"), F.greatest(F.col("n_client_order").try_cast("int"), F.lit(0)))
    rows = df.join(new, "id", "left").withColumn("number", number)
    rows = rows.withColumn("edit_error", F.when(F.col("asked"), F.when(F.col("n_title") == "", "title").when(F.col("number").isNull(), "client_order").otherwise("")).otherwise(""))
    hit = F.col("asked").isNotNull() & (F.col("edit_error") == "")
    value = {c: F.col(f"n_{c}") for c in text} | {"source": F.coalesce(filled("n_source"), F.lit(house)), "client_order": F.col("number"), "updated_at": F.lit(now)}
    value = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in value.items()}
    value["facebook_caption"] = F.when(hit & (F.coalesce("facebook_posted", F.lit(0)) != 1), "").otherwise(F.col("facebook_caption"))
    return rows.withColumns(value).select(*df.columns, "edit_error")


def enrich_plan(df: DataFrame, cache: DataFrame, contents: DataFrame, budget: int | None = None, force: bool = False, provider: str = "fallback") -> DataFrame:
    """What a summary run does with each article (id, url, summary, summary_source): keep, cache, generate, or pending beyond the budget.

    Articles are taken in id order. A url that was summarised in this run is cached for its later articles; an article without
    content is asked again each time and ends as missing_content. `contents` and `cache` hold one row a url. The budget is
    the only global count: a top-N of the ids to generate, never a window over all rows.
    """
    weak = lambda c: F.lit(force) & F.coalesce(F.col(c), F.lit("")).isin(*UPGRADEABLE)
    known = cache.select("url", F.coalesce("summary_source", F.lit("cache")).alias("cached"), F.lit(True).alias("in_cache"))
    rows = df.select("id", "url", "summary", "summary_source").join(known, "url", "left").join(contents.select("url", F.lit(True).alias("content")), "url", "left")
    kept = (F.length(clean("summary")) >= MIN_SUMMARY) & ~weak("summary_source")
    rows = rows.withColumn("action", F.when(kept, "keep").when(F.col("in_cache").isNotNull() & ~weak("cached"), "cache").otherwise("generate"))
    again = F.col("content").isNotNull() & ~F.lit(force and provider in UPGRADEABLE)
    asked = rows.where("action = 'generate'")
    first = asked.where(again).groupBy("url").agg(F.min("id").alias("first_id"))
    calls = asked.where(~again).select("id").union(first.select("first_id"))
    rows = rows.join(first, "url", "left")
    own = F.when((F.col("action") == "generate") & again, F.col("first_id")).otherwise(F.col("id"))
    rows = rows.withColumn("call", own)
    within = F.lit(True)
    if budget is not None:
        rows = rows.join(calls.orderBy("id").limit(budget).select(F.col("id").alias("call"), F.lit(True).alias("paid")), "call", "left")
        within = F.col("paid").isNotNull()
    action = F.when(F.col("action") != "generate", F.col("action")).when(~within, "pending").when(F.col("call") < F.col("id"), "cache").otherwise("generate")
    source = F.coalesce(filled("summary_source"), F.when(F.col("plan") == "keep", "crawler").otherwise("pending"))
    made = F.when(F.col("content").isNull(), "missing_content").otherwise(F.lit(provider))
    final = F.when(F.col("plan").isin("keep", "pending"), source).when(F.col("action") == "cache", F.col("cached")).otherwise(made)
    return rows.withColumn("plan", action).select("id", F.col("plan").alias("action"), final.alias("summary_source"))
