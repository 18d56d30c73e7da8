"""Review, dashboard, retrieval and run operators: what the CMS and its scheduler decide, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import topics
from ..functions.publishing import card_filenames
from ..functions.text import blank, filled, normalize
from . import articles as ar
from . import search_index as ix

# Status groups in the order shown, labels of the cards, roots of media paths, a source for uploads.
GROUPS = ("published", "pending", "rejected", "deleted", "other")
CARDS = (
    ("Tổng số bài viết", "overview"),
    ("Đã đăng / approved", "overview"),
    ("Chờ duyệt / pending", "overview"),
    ("Bị từ chối / rejected", "overview"),
    ("Đã xóa / deleted", "overview"),
    ("Đã đăng Facebook", "facebook"),
    ("Đã duyệt chưa đăng FB", "facebook"),
    ("Lỗi đăng Facebook", "facebook"),
    ("Đang đăng Facebook", "facebook"),
    ("Thiếu summary", "quality"),
    ("Thiếu thumbnail", "quality"),
    ("Nguồn báo có dữ liệu", "quality"),
    ("Ngày đăng mới nhất", "quality"),
)
GENERATED, UPLOADS = "data/generated_images/", "data/uploads/"
UPLOAD_SOURCE = "Admin upload"
FOLDER_DATES = ("crawled_at", "published_at", "created_at", "approved_at", "updated_at")


def group_totals(df: DataFrame) -> DataFrame:
    """The five status groups with their articles, also those with none."""
    none = df.sparkSession.createDataFrame([(i, g) for i, g in enumerate(GROUPS, 1)], "pos int, group string")
    found = df.groupBy(topics.status_group("status").alias("group")).agg(F.count("*").alias("n"))
    return none.join(found, "group", "left").select("pos", "group", F.coalesce("n", F.lit(0)).alias("total"))


def dashboard(df: DataFrame) -> DataFrame:
    """The thirteen cards, in order, from one pass over the articles: pos, label, group and value as text."""
    group, posted = topics.status_group("status"), F.coalesce("facebook_posted", F.lit(0)) == 1
    source = F.coalesce(filled(F.trim("source")), F.lit("Không rõ"))
    tests = [group == g for g in GROUPS[:4]]
    tests += [posted, (F.col("status") == "approved") & ~posted, F.col("facebook_publish_status") == "failed", F.col("facebook_publish_status") == "posting"]
    tests += [blank("summary"), blank("thumbnail") & blank("image_path")]
    values = [F.count("*"), *(F.count_if(t) for t in tests), F.countDistinct(source)]
    latest = F.coalesce(F.max(filled("published_at")), F.max(filled("crawled_at")), F.lit("Chưa có"))
    one = df.agg(F.array(*(v.cast("string") for v in values), latest).alias("values"))
    cards = df.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(CARDS, 1)], "pos int, label string, group string")
    return cards.join(one).select("pos", "label", "group", F.element_at("values", F.col("pos")).alias("value"))


def client_topics(df: DataFrame, status: str = "approved") -> DataFrame:
    """Topics of the articles: first those of the client's menu in its order, then others by name (pos within each part).

    The topic of general news is there as soon as one article is not of the institute itself.
    """
    rows = df.where(F.col("status") == status) if status else df
    named = rows.select(topics.canonical_topic().alias("topic"), (~topics.text_key("source").contains("ptit")).alias("general"))
    seen = named.groupBy("topic").agg(F.max("general").alias("general"))
    general = seen.where("general").select(F.lit(topics.CLIENT_TOPICS[0]).alias("topic"))
    menu = F.array_position(F.array(*map(F.lit, topics.CLIENT_TOPICS)), F.col("topic"))
    return seen.select("topic").union(general).distinct().select("topic", F.when(menu > 0, menu).alias("menu_pos"))


def uploads(forms: DataFrame, now: str) -> DataFrame:
    """Articles of upload forms (texts of the fields, publish_now, image_path); a form without a title gives `error` and no article."""
    strip = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    status = F.when(F.col("publish_now") == "on", "approved").otherwise("pending")
    stamp = F.when(F.col("publish_now") == "on", now).otherwise("")
    return forms.select(
        "form_id", F.coalesce(filled(strip("source")), F.lit(UPLOAD_SOURCE)).alias("source"), *(strip(c).alias(c) for c in ("title", "url", "summary", "newspaper_type", "content_topic", "category")),
        *(F.lit(now).alias(c) for c in ("crawled_at", "published_at", "created_at", "updated_at")), F.lit("").alias("thumbnail"), strip("image_path").alias("image_path"), strip("image_path").alias("generated_poster_image"),
        status.alias("status"), status.alias("approval_status"), stamp.alias("approved_at"), stamp.alias("reviewed_at"), F.when(strip("title") == "", "title").otherwise("").alias("error"),
    )


def backfill(df: DataFrame) -> DataFrame:
    """The six updates that give older rows what newer columns hold; run again, they change nothing."""
    reviewed = F.col("status").isin("pending", "approved", "rejected")
    approval = F.when(reviewed, F.col("status")).when(blank("approval_status"), F.coalesce(filled("approval_status"), F.lit("pending"))).otherwise(F.col("approval_status"))
    return df.withColumns({
        "published_at": F.when(blank("published_at"), F.coalesce(filled("published_at"), filled("crawled_at"), "created_at")).otherwise(F.col("published_at")),
        "approved_at": F.when((F.col("status") == "approved") & blank("approved_at"), F.coalesce(filled("approved_at"), filled("reviewed_at"))).otherwise(F.col("approved_at")),
        "approval_status": approval,
        "facebook_publish_status": F.when(blank("facebook_publish_status"), F.when(F.coalesce("facebook_posted", F.lit(0)) == 1, "success").otherwise("not_posted")).otherwise(F.col("facebook_publish_status")),
        "generated_poster_image": F.when(blank("generated_poster_image") & ~blank("image_path"), F.coalesce(filled("generated_poster_image"), filled("image_path"), F.lit(""))).otherwise(F.col("generated_poster_image")),
    })


def requests(intents: DataFrame) -> DataFrame:
    """The searches that answer an intent (type, source, topic, keyword), in order of preference: step, today, and the three wishes.

    The first step that finds an article counts; an intent has one to four.
    """
    wish = lambda s=None, t=None, k=None, today=False: F.struct(F.lit(today).alias("today"), *(F.coalesce(x, F.lit("")).alias(c) for x, c in ((s, "source"), (t, "topic"), (k, "keyword"))))
    nothing = F.lit("")
    s, t, k = F.col("source"), F.col("topic"), F.col("keyword")
    any_, by_s, by_t, by_k = wish(nothing, nothing, nothing), wish(s, nothing, nothing), wish(nothing, t, nothing), wish(nothing, nothing, k)
    context = F.array(F.when(s != "", by_s).when(t != "", by_t).when(k != "", by_k).otherwise(any_))
    found = F.concat(F.array(by_k), F.when(t != "", F.array(by_t)).when(s != "", F.array(by_s)).otherwise(F.array()))
    search = F.when(k != "", found).otherwise(context)
    today = F.concat(F.array(wish(s, t, k, True)), F.when((s == "") & (t == "") & (k == ""), F.array(any_)).otherwise(search))
    kind = F.col("type")
    steps = F.when(kind == "count_today", today).when(kind == "count", context).when(kind == "latest", F.array(any_)).when(kind == "source", F.array(by_s)).when(kind == "topic", F.array(by_t))
    steps = steps.when(kind.isin("summarize", "recommend"), F.array(F.when(t != "", by_t).when(s != "", by_s).otherwise(any_))).otherwise(search)
    return intents.select("*", F.posexplode(steps).alias("step", "wish"))


def retrieve(df: DataFrame, intents: DataFrame, as_of: str, limit: int = 5, today_window: int = 100_000) -> DataFrame:
    """Up to `limit` articles for every intent: the columns of `intents` and pos, id.

    Equal wishes are answered once, by an index of the rows that they look at: the newest max(20 x limit, 250) public ones, and of the
    newest `today_window` those of the day `as_of`. A wish has up to three needs (source, topic, keyword), each is looked up
    once for all wishes that have it; of the rows with all needs of a wish the newest `limit` stay.
    """
    wishes = requests(intents)
    shown = F.coalesce(filled("published_at"), filled("crawled_at"), filled("created_at"), filled("updated_at"), F.lit(""))
    newest = df.where(topics.is_public()).orderBy(*ar.recent_order()).limit(max(today_window, 20 * limit, 250))
    ranked = ar.numbered(newest, ar.recent_order(), "w", "bigint")
    near = F.col("w") <= max(20 * limit, 250)
    rows = ranked.withColumn("now", shown.startswith(as_of) & (F.col("w") <= today_window)).withColumn("near", near).where("now OR near")
    every = F.concat_ws(" ", "title", "summary", "source", "category", "content_topic")
    groups = {"source": ix.folded("source"), "topic": ix.folded("content_topic", "category", "title", "summary"), "keyword": ix.folded("_every")}
    index = ix.build(rows.withColumn("_every", every), groups)
    places = rows.select("id", "w", "now", "near")
    asked = wishes.select("wish.*").distinct()
    needs = F.filter(F.array(*(F.struct(F.lit(c).alias("grp"), normalize(c).alias("needle")) for c in groups)), lambda x: x["needle"] != "")
    asked = asked.withColumn("needs", needs)
    single = asked.select("today", "source", "topic", "keyword", F.size("needs").alias("n"), F.explode("needs").alias("need")).select("*", "need.*").drop("need")
    hits = single.join(ix.search(index, single.select("grp", "needle")), ["grp", "needle"])
    all_needs = hits.groupBy("today", "source", "topic", "keyword", "id").agg(F.count("*").alias("k"), F.max("n").alias("n")).where("k = n")
    fits = (F.col("today") & F.col("now")) | (~F.col("today") & F.col("near"))
    key = ["today", "source", "topic", "keyword"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("w"))
    some = all_needs.join(places, "id").where(fits).withColumn("place", rank).where(F.col("place") <= limit).select(*key, "w", "id")
    first = lambda flag: places.where(flag).orderBy("w").limit(limit).select(F.lit(flag == "now").alias("today"), "w", "id")
    any_ = asked.where(F.size("needs") == 0).select(*key).join(first("now").union(first("near")), "today").select(*key, "w", "id")
    best = some.union(any_).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("w", "id"))).alias("found"))
    answered = wishes.join(best.select(F.struct(*key).alias("wish"), "found"), "wish")
    keys = intents.columns
    chosen = answered.groupBy(*keys).agg(F.min_by("found", "step").alias("found"))
    return chosen.select(*keys, F.posexplode("found").alias("pos", "hit")).select(*keys, (F.col("pos") + 1).alias("pos"), "hit.id")


def breaker(calls: DataFrame, run: str = "run", failures: int = 3) -> DataFrame:
    """calls (run, provider, ord, outcome: ok, failed, limited) with `skipped`: a provider is left alone for the rest of a run once
    it is rate limited or has failed `failures` times in a row."""
    by = Window.partitionBy(run, "provider").orderBy("ord")
    rows = calls.withColumn("good", F.sum(F.when(F.col("outcome") == "ok", 1).otherwise(0)).over(by))
    since = Window.partitionBy(run, "provider", "good").orderBy("ord")
    row = F.sum(F.when(F.col("outcome") == "ok", 0).otherwise(1)).over(since)
    rows = rows.withColumn("trips", (F.col("outcome") == "limited") | (row >= failures))
    before = F.max("trips").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(*calls.columns, F.coalesce(before, F.lit(False)).alias("skipped"))


def date_folder() -> Column:
    """The day of the first of five moments that looks like one."""
    texts = [F.trim(F.coalesce(c, F.lit(""))) for c in FOLDER_DATES]
    return F.coalesce(*(F.when((F.length(t) >= 10) & (F.substring(t, 5, 1) == "-") & (F.substring(t, 8, 1) == "-"), F.substring(t, 1, 10)) for t in texts), F.lit("uncategorized"))


def media_path(c: str) -> Column:
    """A stored path relative to the data root; addresses and absolute paths have none."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text.rlike("^(https?://|/)"), "").otherwise(text)


def card_plan(df: DataFrame, date: str = "", include_uploads: bool = False) -> DataFrame:
    """Which cards a regeneration draws, and where to: id, folder, action, target. Cards that live on uploads are skipped unless asked for."""
    ours = lambda c: (c != "") & (c.startswith(GENERATED) | (F.lit(include_uploads) & c.startswith(UPLOADS)))
    paths = [media_path(c) for c in ("generated_poster_image", "image_path")]
    current = F.coalesce(*(F.when(ours(p), p) for p in paths), F.lit(""))
    on_upload = paths[0].startswith(UPLOADS) | paths[1].startswith(UPLOADS)
    rows = card_filenames(df).withColumn("folder", date_folder()).withColumn("current", current)
    rows = rows.where(F.col("folder") == date) if date else rows
    skip = F.lit(not include_uploads) & on_upload & (F.col("current") == "")
    target = F.when(skip, "").when(F.col("current") != "", F.col("current")).otherwise(F.concat(F.lit(GENERATED), "folder", F.lit("/"), "filename"))
    return rows.select("id", "folder", F.when(skip, "skipped_upload").otherwise("regenerated").alias("action"), target.alias("target"))


def lock_state(now: Column, held_since: Column, stale: int = 1800) -> Column:
    """What a run finds (seconds): free, stale (older than `stale`, to be taken over) or busy."""
    return F.when(held_since.isNull(), "free").when(now - held_since > stale, "stale").otherwise("busy")


def retry_at(first: Column, attempt: Column, wait: int = 300, most: int = 288) -> Column:
    """When (seconds) a busy run tries again after its n-th attempt, counted from 0; NULL after the last."""
    return F.when(attempt < most, first + (attempt + 1) * wait)


def backoff(attempt: Column, most: int = 8) -> Column:
    return F.least(F.pow(F.lit(2), attempt), F.lit(most)).cast("bigint")


def date_parameter(c: Column, as_of: str) -> Column:
    """The day a listing is asked for: missing or senseless means today, 'all' and 'any' no day (''), none lies in the future."""
    text = F.lower(F.trim(c))
    return F.when(c.isNull(), as_of).when(text.isin("all", "any"), "").when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.least(text, F.lit(as_of))).otherwise(as_of)


def page_links(totals: DataFrame, size: int = 12) -> DataFrame:
    """Per total (any columns and `total`) every page that there is, with the first and last of the up to five links shown."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint")
    rows = totals.withColumn("pages", pages).withColumn("page", F.explode(F.sequence(F.lit(1).cast("bigint"), "pages")))
    first = F.greatest(F.lit(1), F.least(F.col("page") - 2, F.col("pages") - 4))
    return rows.withColumn("first", first).withColumn("last", F.least("pages", F.greatest(F.col("page") + 2, F.lit(5))))
