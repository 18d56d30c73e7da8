"""Lines and sizes against plain loops, on titles and texts of the tables and on odd ones."""

import pytest
from pyspark.sql import functions as F

from newsflow.functions import layout as lo

SF = "/root/testdata/sf0.001"
LONG = "Học viện Công nghệ Bưu chính Viễn thông đóng góp luận cứ khoa học về đo lường kinh tế số tại Hội nghị chuyên đề của Thành phố Hồ Chí Minh"


def em(text):
    table = {c: w for characters, w in lo.WIDTHS for c in characters}
    return sum(table.get(c, lo.OTHER) for c in text)


def wrap(text, size, width):
    lines, line = [], ""
    fits = lambda t: em(t) * size <= width * 1000
    for word in text.split():
        joined = f"{line} {word}" if line else word
        if fits(joined):
            line = joined
            continue
        if line:
            lines.append(line)
            line = ""
        for c in word:
            if line and not fits(line + c):
                lines.append(line)
                line = c
            else:
                line += c
    return lines + [line] * (line != "")


def fit(text, box):
    for size in range(box.largest, box.least - 1, -box.step):
        lines = wrap(text, size, box.width)
        if len(lines) <= box.lines and len(lines) * (size * lo.HEIGHT // 1000 + box.spacing) <= box.height:
            return size, lines
    lines, room = wrap(text, box.least, box.width), min(box.lines, box.height // (box.least * lo.HEIGHT // 1000 + box.spacing))
    if len(lines) <= room or not room:
        return box.least, lines[:room]
    last = lines[room - 1]
    while last and em(last + lo.ELLIPSIS) * box.least > box.width * 1000:
        last = last[:-1].rstrip()
    return box.least, [*lines[: room - 1], last + lo.ELLIPSIS]


@pytest.mark.parametrize("box", [lo.TITLE, lo.SUMMARY, lo.Box(60, 3, 90, 30, 10, 2), lo.Box(968, 4, 20, 64, 48, 12), lo.Box(300, 2, 400, 40, 40, 0)])
def test_fit_equals_loops(spark, box):
    texts = [(i, t) for i, t in enumerate(["", None, "x", LONG, "W" * 400, "i " + "W" * 90 + " tail", " ".join(["Nội dung bài viết cần được trình bày rõ ràng và cân đối."] * 20), "a\n\nb\tc", "word " * 300])]
    rows = spark.createDataFrame(texts, "id bigint, t string").union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 100, F.substring("text", 1, 220)))
    for r in rows.withColumn("f", lo.fit("t", box)).collect():
        text = " ".join((r.t or "").split())
        assert (r.f.size, r.f.lines) == fit(text, box), r.t
        assert all(em(x) * r.f.size <= box.width * 1000 for x in r.f.lines if x != lo.ELLIPSIS and len(x) > 1)


def test_a_long_title_is_made_smaller_and_a_long_summary_is_cut(spark):
    r = spark.createDataFrame([(LONG, "Nội dung bài viết cần được trình bày rõ ràng và cân đối. " * 20)], "t string, s string").select(lo.fit("t", lo.TITLE).alias("t"), lo.fit("s", lo.SUMMARY).alias("s")).first()
    assert r.t.size < 64 and len(r.t.lines) <= 4 and lo.ELLIPSIS not in " ".join(r.t.lines)
    assert r.s.size == 34 and len(r.s.lines) <= 5 and r.s.lines[-1].endswith(lo.ELLIPSIS)


def test_texts_are_fitted_a_batch_at_a_time(spark):
    """Twenty thousand titles and summaries in seconds: as folds of expressions they took minutes."""
    import time

    rows = spark.range(20000).selectExpr("id", f"concat('{LONG} ', id) AS t", f"concat(id, repeat(' {LONG}', 3)) AS s")
    began = time.time()
    got = rows.select("t", "s", lo.fit("t", lo.TITLE).alias("a"), lo.fit("s", lo.SUMMARY).alias("b"))
    assert got.agg(F.sum(F.size("a.lines") + F.size("b.lines"))).first()[0] > 0
    assert time.time() - began < 60
    assert all((r.a.size, r.a.lines) == fit(r.t, lo.TITLE) and (r.b.size, r.b.lines) == fit(r.s, lo.SUMMARY) for r in got.where("id % 1000 = 7").collect())


def test_lines_and_short_ends_as_columns(spark):
    rows = spark.createDataFrame([("W" * 40 + " tail of it", 40), (None, 12), (LONG, 48)], "t string, n int")
    for r in rows.select("t", "n", lo.wrap("t", F.col("n"), 300).alias("w"), lo.shortened(F.coalesce("t", F.lit("")), F.col("n"), 300).alias("s")).collect():
        assert r.w == wrap(r.t or "", r.n, 300)
        assert r.s.endswith(lo.ELLIPSIS) and em(r.s) * r.n <= 300000
