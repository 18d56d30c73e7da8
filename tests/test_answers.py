"""Chat answers: the budget, prompts, providers that fail, the fallback and the log."""

from newsflow.operators import answers as an
from newsflow.sources.stored import Stored

ARTICLE = "id int, title string, source string, content_topic string, category string, url string, summary string"
KEYS = ["conv_id", "turn"]


def asked(spark, budget=1000):
    articles = spark.createDataFrame([(i, f"title {i}", "", None if i % 2 else "news", "", f"http://a/{i}", "s" * 50 * i) for i in range(1, 15)], ARTICLE)
    found = spark.createDataFrame([(1, 0, p, p) for p in range(1, 15)] + [(2, 0, 1, 14), (2, 0, 2, 1)], "conv_id bigint, turn bigint, pos int, id int")
    messages = spark.createDataFrame([(1, 0, "what", "summarize"), (2, 0, "é" * 900, "search"), (3, 0, None, "latest")], "conv_id bigint, turn bigint, message string, type string")
    packing = an.packed(found, articles, KEYS, budget)
    return packing, an.prompts(messages, packing, KEYS)


def test_budget_keeps_a_run_from_the_first_on(spark):
    packing, _ = asked(spark, 100)
    for conv in (1, 2):
        rows = sorted(packing.where(f"conv_id = {conv}").collect(), key=lambda r: r.pos)
        total = 0
        for r in rows:
            assert r.tokens == -(-len(r.entry) // 4)
            total += r.tokens
            assert r.total == total and r.fits == (total <= 100)
        assert len(rows) == (an.MOST if conv == 1 else 2)
    assert not packing.where("conv_id = 2 AND fits").count()  # the first is too long; the short one after it is not taken either


def test_prompts(spark):
    by = {r.conv_id: r for r in asked(spark)[1].collect()}
    assert by[3].prompt is None and by[3].message == "" and by[3].articles == 0 and by[3].listing == ""
    assert len(by[2].message) == an.MESSAGE_CHARS and by[2].articles == 2
    assert by[2].prompt.startswith(an.RULES) and by[2].prompt.index("title 14") < by[2].prompt.index("title 1 |")
    assert by[1].listing.count("\n") == an.LISTED - 1 and by[1].listing.startswith(f"- title 1 ({an.HOUSE}, {an.UNKNOWN_TOPIC}): sss")


def test_providers_in_order_and_fallback(spark):
    def down(prompt):
        raise ConnectionError("busy")

    rows = asked(spark)[1]
    good = an.answered(rows, [("a", down), ("b", lambda p: None), ("c", lambda p: "  said \n\n  more " + "x" * 9000)])
    by = {r.conv_id: r for r in good.collect()}
    assert (by[1].provider, by[1].mode, by[1].failures) == ("c", "ai", "a: ConnectionError; b: empty")
    assert by[1].answer.startswith("said\n  more x") and len(by[1].answer) == an.ANSWER_CHARS
    assert (by[3].provider, by[3].mode, by[3].failures, by[3].answer) == ("none", "fallback", "", an.NOTHING)
    bad = {r.conv_id: r for r in an.answered(rows, [("a", down)]).collect()}
    assert bad[1].answer == an.LEADS["summarize"] + "\n\n" + bad[1].listing and bad[2].answer.startswith(an.LEADS[""]) and bad[1].provider == "none"
    assert an.answered(rows.limit(0), [("a", down)]).count() == 0


def test_a_logged_run_is_not_asked_again(spark, tmp_path):
    def once(prompt):
        with open(f"{tmp_path}/calls", "a") as f:
            f.write("x")
        return "answer"

    _, rows = asked(spark)
    store = Stored(spark, f"file://{tmp_path}/log")
    store.create(spark.createDataFrame([], an.LOG), KEYS, 4)
    for run, now in (("r1", "1"), ("r1", "2"), ("r2", "3")):
        an.log(store, run, an.answered(rows, [("p", once)]), now)
    assert len((tmp_path / "calls").read_text()) == 4  # two prompts, two runs
    got = store.read().collect()
    assert sorted((r.conv_id, r.mode, r.created_at) for r in got) == [(1, "ai", "3"), (2, "ai", "3"), (3, "fallback", "3")]
