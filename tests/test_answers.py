import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plaudit.config import DEFAULTS
from plaudit.operators.items import ranked, reported
from plaudit.operators.metrics import review_cube
from plaudit.operators.scoring import categorise, categorised_batches, listed_items, score_actionability, score_categories
from plaudit.plans import decode
from plaudit.plans.flows import analyse, analyse_by_rules, categorise_export, deck
from plaudit.plans.messages import message_stream, platform_blocks
from plaudit.plans.prompts import analysis_frame, analysis_prompts, categorise_prompts
from plaudit.plans.report import REPORT_ORDER, RULE
from plaudit.plans.responder import ResponderFailed, answered, failed_prompts
from plaudit.sources.documents import categorised_document, read_categorised, write_lines, write_messages
from plaudit.sources.exports import rated_text, read_export
from test_exports import export

ANSWER = {"summary": "All fine.", "theme_counts": {"Login": 2, "Fees": 1}, "actionable_items": [
    {"review_id": "r1", "actionability_score": 4, "category": "App Crash", "reason": "crashes"},
    {"review_id": "none", "actionability_score": 9, "category": "Invented", "reason": "?"},
    {"review_id": "r2", "category": "Slow Shipping", "reason": "late"}]}


def test_responses_of_all_shapes(spark, rows_of):
    text = json.dumps(ANSWER)
    shapes = [f"```json\n{text}\n```", f"Sure:\n```\n{text}\n```\nBye", text, "I cannot do that", "```json\n{broken\n```", "[1, 2]", None]
    responses = spark.createDataFrame(list(enumerate(shapes, 1)), "batch_no long, response string")
    items = decode.decode_analysis(responses)
    assert rows_of(items.filter("batch_no = 2"), "pos", "review_id", "score", "category") == [
        (0, "r1", 4, "App Crash"), (1, "none", 9, "Invented"), (2, "r2", None, "Slow Shipping")]
    assert items.count() == 9
    assert rows_of(decode.theme_counts(responses)) == [("Fees", 3), ("Login", 6)]
    assert rows_of(decode.summaries(responses), "batch_no") == [(1,), (2,), (3,)]
    assert rows_of(decode.rejected_responses(responses), "batch_no") == [(4,), (5,), (6,), (7,)]
    sentence = decode.themes_sentence(decode.theme_counts(responses)).first().summary
    assert sentence == "Most frequent themes: Login (6), Fees (3)."


def test_ill_typed_values_cost_their_own_element(spark, rows_of):
    item = {"review_id": "a", "actionability_score": 4, "category": "c", "reason": "r"}
    answers = [
        {"summary": "s", "theme_counts": {"x": 2, "y": "many", "z": "3"}, "actionable_items": [
            item, {**item, "review_id": "b", "actionability_score": "5"}, {**item, "review_id": "c", "actionability_score": 4.5}, "text",
            {**item, "review_id": "d", "actionability_score": 3.0}, {**item, "review_id": "e", "actionability_score": None}]},
        {"summary": 7, "theme_counts": "none", "actionable_items": {"review_id": "f"}}]
    responses = spark.createDataFrame([(at, json.dumps(one)) for at, one in enumerate(answers, 1)], "batch_no long, response string")
    assert rows_of(decode.decode_analysis(responses), "batch_no", "review_id", "score")[:4] == [(1, "a", 4), (1, "b", 5), (1, "d", 3), (1, "e", None)]
    assert rows_of(decode.rejected_entries(responses), "batch_no", "pos") == [(1, 2), (1, 3)]
    assert rows_of(decode.theme_counts(responses)) == [("x", 2), ("z", 3)]
    assert rows_of(decode.summaries(responses)) == [(1, "s"), (2, "7")]
    months = json.dumps({"2026-01": [{"review_id": "a", "category": "other"}, 5], "2026-02": "none", "2026-03": [{"review_id": "b", "category": 1}]})
    responses = spark.createDataFrame([("pos", 1, months)], "sentiment string, batch_no long, response string")
    assert rows_of(decode.decode_categories(responses), "month", "item_no", "review_id", "category") == [
        ("2026-01", 0, "a", "other"), ("2026-03", 0, "b", "1")]
    assert rows_of(decode.rejected_category_entries(responses), "month", "entry") == [("2026-01", "5"), ("2026-02", "none")]
    assert decode.rejected_categories(responses).count() == 0


def test_frame_of_the_analysis_prompt():
    before, between, after = analysis_frame(DEFAULTS)
    assert before == (
        "Task: read customer reviews of our company and pick out what a team can act on.\nA review is an item if it names a concrete "
        "problem that someone could reproduce, trace or repair. Score each item from 1 (hardly) to 5 (at once) by how clearly it says "
        "what went wrong. Opinions without such a problem are no items.\n\nNumber of reviews: ")
    assert between == "\n\n" and after.startswith("\n\nAnswer with a JSON object of this form only:\n{")
    assert all(json.dumps(label) in after for label in DEFAULTS.actionable_labels)


@pytest.mark.parametrize("batches", [1, 2, 300])
def test_messages_have_one_form(spark, batches):
    items = spark.createDataFrame([(1, 0, "r1", 3, "Odd", "why")], "batch_no long, pos int, review_id string, score int, category string, reason string")
    raw = spark.createDataFrame([("r1", "2026-01-01", "A", "GP", 1.0, "t", "u", "2026-01")],
                                "review_id string, published string, author string, source string, rating double, review string, url string, month string")
    told = spark.range(1, batches + 1).selectExpr("id as batch_no", "'One.' as summary")
    themes = spark.createDataFrame([("Late", 3)], "theme string, n long")
    found = message_stream(review_cube(raw), reported(items, raw), told, themes, "x.csv", "now").collect()
    assert len(found) == batches + 4
    assert json.loads(next(row for row in found if (row.group_ord, row.item_ord) == (0, 0)).blocks_json)[8]["text"]["text"] == "Most frequent themes: Late (3)."


def test_any_number_of_sources_makes_blocks_of_one_size(spark):
    sources = 100_000
    raw = spark.range(sources).selectExpr("concat('r', id) as review_id", "'2026-01-01' as published", "'A' as author", "concat('source ', lpad(id, 6, '0')) as source",
                                          "double(1 + id % 5) as rating", "'t' as review", "'u' as url", "'2026-01' as month")
    cube = review_cube(raw)
    blocks = platform_blocks(cube).withColumn("lines", F.size(F.split("text", "\n")))
    assert tuple(blocks.agg(F.count("*"), F.min("lines"), F.max("lines"), F.max(F.length("text"))).first())[:3] == (sources // 20, 20, 20)
    third = blocks.filter("block_no = 3").first().text.splitlines()
    assert [line.split("*")[1] for line in third] == [f"source {at:06}" for at in range(40, 60)]
    assert platform_blocks(cube, replace(DEFAULTS, lines_per_block=30_000)).filter("block_no = 4").first().text.count("\n") == 9_999
    items = spark.createDataFrame([(1, 0, "r1", 3, "Odd", "why")], "batch_no long, pos int, review_id string, score int, category string, reason string")
    told = spark.createDataFrame([(1, "One.")], "batch_no long, summary string")
    found = message_stream(cube, reported(items, raw), told, spark.createDataFrame([("Late", 3)], "theme string, n long"), "x.csv", "now")
    assert found.filter("group_ord = 0").agg(F.max(F.length("blocks_json")), F.max("item_ord")).first()[1] == sources // 20 + 1
    assert found.agg(F.max(F.length("blocks_json"))).first()[0] < 4_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(source" not in plan


@pytest.mark.parametrize("name, most", [("item_blocks", 8), ("items_with_reviews", 6), ("report_lines", 10), ("message_stream", 12)])
def test_reports_read_few_tables(spark, name, most):
    from plaudit.catalog.queries import QUERIES
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= most


def test_category_responses(spark, rows_of):
    good = '```json\n{"2026-01":[{"review_id":"a","category":"pricing"},{"review_id":"b","category":"other"}],"2026-02":[]}\n```'
    responses = spark.createDataFrame([("neg", 1, good), ("neg", 2, "sorry"), ("pos", 1, '{"2026-02":[{"review_id":"c"}]}')],
                                      "sentiment string, batch_no long, response string")
    assert rows_of(decode.merge_responses(responses)) == [
        ("neg", "2026-01", "a", "pricing"), ("neg", "2026-01", "b", "other"), ("pos", "2026-02", "c", None)]
    assert rows_of(decode.rejected_categories(responses), "batch_no") == [(2,)]
    asked = spark.createDataFrame([("neg", "2026-01", "a"), ("neg", "2026-01", "z")], "sentiment string, month string, review_id string")
    assert rows_of(decode.unanswered(asked, decode.merge_responses(responses)), "review_id") == [("z",)]


def reviews(spark, count):
    return spark.createDataFrame(
        [(f"r{at}", "GP", 4.0, "Ann", None, f"text {at} " + "é" * 600) for at in range(count)],
        "review_id string, source string, rating double, author string, title string, review string")


def test_analysis_prompts_hold_every_review_once(spark):
    prompts = analysis_prompts(reviews(spark, 310)).orderBy("batch_no").collect()
    assert [(row.batch_no, row.n_reviews, row.total_batches) for row in prompts] == [(1, 150, 3), (2, 150, 3), (3, 10, 3)]
    ids = [line[5:-1] for row in prompts for line in row.prompt.splitlines() if line.startswith("[ID: ")]
    assert sorted(ids) == sorted(f"r{at}" for at in range(310))
    block = prompts[2].prompt.split("[ID: ")[-1].split("\n\n")[0]
    assert "Source: GP | Rating: 4.0★ | Author: Ann\nTitle: nan\nReview: text" in block
    assert len(block.split("Review: ")[1]) == 500


def test_categorise_prompts_hold_json_by_month(spark):
    rows = [(side, month, f"{side}{month}{at}", f'say "{at}"\n') for side in ("pos", "neg") for month in ("2026-01", "2026-02") for at in range(100)]
    buckets = spark.createDataFrame(rows, "sentiment string, month string, review_id string, review string")
    prompts = categorise_prompts(buckets).orderBy("sentiment", "batch_no").collect()
    assert [(row.sentiment, row.batch_no, row.n_reviews) for row in prompts] == [
        ("neg", 1, 150), ("neg", 2, 50), ("pos", 1, 150), ("pos", 2, 50)]
    listed = json.loads(prompts[0].prompt.split("by month:\n\n")[1].split("\n\nGive every")[0])
    assert [(month, len(found)) for month, found in listed.items()] == [("2026-01", 100), ("2026-02", 50)]
    assert listed["2026-01"][0]["review"].startswith('say "')
    assert '"good products"' in prompts[2].prompt and '"vendor issues"' in prompts[0].prompt


def test_store_is_asked_once(spark, tmp_path, rows_of):
    prompts = spark.createDataFrame([(1, "one"), (2, "two"), (3, "two")], "batch_no long, prompt string").withColumn(
        "prompt_hash", F.sha2("prompt", 256))
    store = str(tmp_path / "store")
    first = answered(spark, prompts.filter("batch_no < 3"), lambda prompt: prompt.upper(), store)
    assert rows_of(first, "batch_no", "response") == [(1, "ONE"), (2, "TWO")]

    def never(prompt):
        raise RuntimeError("asked again")

    again = answered(spark, prompts, never, store)
    assert rows_of(again, "batch_no", "response") == [(1, "ONE"), (2, "TWO"), (3, "TWO")]
    with pytest.raises(Exception, match="asked again"):
        answered(spark, prompts.withColumn("prompt_hash", F.lit("new")), never, store)


def test_a_failing_prompt_costs_itself_alone(spark, tmp_path, rows_of):
    """Some prompts raise, some are answered by no text: the others are answered, a rerun asks for these alone."""
    prompts = spark.range(40).selectExpr("id as batch_no", "concat('prompt ', id) as prompt").withColumn("prompt_hash", F.sha2("prompt", 256))
    store, log = str(tmp_path / "store"), tmp_path / "asked"
    log.mkdir()

    def sometimes(prompt):
        (log / f"{prompt.split()[1]}-{len(list(log.glob(prompt.split()[1] + '-*')))}").touch()
        number = int(prompt.split()[1])
        if number % 10 == 3:
            raise ValueError(f"no answer to {number}")
        return None if number == 20 else prompt.upper()

    found = answered(spark, prompts, sometimes, store, parallelism=3, at_once=4, round_prompts=9)
    failed = [3, 13, 20, 23, 33]
    assert rows_of(found.filter("response is not null"), "batch_no", "response") == [(at, f"PROMPT {at}") for at in range(40) if at not in failed]
    assert rows_of(failed_prompts(found), "batch_no", "error") == [
        (3, "ValueError: no answer to 3"), (13, "ValueError: no answer to 13"), (20, "no text but NoneType"),
        (23, "ValueError: no answer to 23"), (33, "ValueError: no answer to 33")]
    again = answered(spark, prompts, str.title, store)
    assert rows_of(again, "batch_no", "response", "error") == [(at, f"Prompt {at}" if at in failed else f"PROMPT {at}", None) for at in range(40)]
    assert len(list(log.iterdir())) == 40


def test_rounds_that_are_stored_survive_a_failure(spark, tmp_path):
    """The run ends at the first round without an answer; what came before is not asked for again."""
    prompts = spark.range(30).selectExpr("id as batch_no", "concat('prompt ', id) as prompt").withColumn("prompt_hash", F.sha2("prompt", 256))
    store, stop = str(tmp_path / "store"), tmp_path / "stop"

    def until(prompt):
        if stop.exists():
            raise ConnectionError("closed")
        if prompt == last:
            stop.touch()
        return prompt

    rounds = {row.prompt: row.nth for row in prompts.select("prompt", F.pmod(F.xxhash64("prompt_hash"), F.lit(6)).alias("nth")).collect()}
    last = next(prompt for prompt, nth in rounds.items() if nth == 2)
    with pytest.raises(ResponderFailed, match="closed"):
        answered(spark, prompts, until, store, parallelism=1, at_once=1, round_prompts=5)
    stored = spark.read.parquet(store).filter("response is not null").count()
    assert sum(nth < 2 for nth in rounds.values()) < stored < 30
    stop.unlink()
    assert answered(spark, prompts, str.upper, store).filter("response = prompt_hash or response is null").count() == 0


LINES = [
    "r1,2026-01-02,Ann,BBB,1,Bad,App crashes all the time,http://a",
    "r2,2026-02-03,Bob,Google Play,2,Late,My order is late,http://b",
    "r3,2026-02-04,,Google Play,5,Good,great,http://c",
    "r4,junk,Di,,4,Good,great,",
    "r5,2026-02-05,Eve,Google Play,3,Blank, ,",
]


def test_analysis_from_export_to_report(spark, tmp_path, rows_of):
    text = json.dumps(ANSWER)
    result = analyse(spark, read_export(spark, export(tmp_path, *LINES)), lambda prompt: text, str(tmp_path / "store"),
                     "export.csv", "2026-03-04 14:32")
    assert rows_of(result.items, "review_id", "score") == [("none", 9), ("r1", 4)]
    assert rows_of(result.rejected_items, "review_id") == [("none",)]
    assert result.rejected_responses.count() == result.rejected_entries.count() == result.rejected_ratings.count() == 0
    lines = [row.line for row in result.report.orderBy(*REPORT_ORDER).collect()]
    assert lines == [
        "", RULE, "  AI REVIEW ANALYSIS REPORT", "  Generated: 2026-03-04 14:32  |  Source: export.csv", RULE, "", "STATS",
        "  Total reviews in export:          5", "  Avg star rating:                  ★ 3.00",
        "  Date range:                       2026-01-02 → 2026-02-05", "", "  Per-platform breakdown:",
        "    BBB: 1 reviews  |  ★ avg 1.0  |  👍 0 (0%)  👎 1 (100%)",
        "    Google Play: 3 reviews  |  ★ avg 3.3  |  👍 1 (33%)  👎 2 (67%)",
        "", RULE, "  MOST ACTIONABLE THEMES  (2 flagged)", RULE,
        "", "  [1] Actionability: 9/5  █████████  |  Invented", "      Source: N/A  |  Rating: ?  |  Author: N/A", "      Date:   N/A",
        "      WHY:    ?", '      Review: ""',
        "", "  [2] Actionability: 4/5  ████░  |  App Crash", "      Source: BBB  |  Rating: ★☆☆☆☆  |  Author: Ann",
        "      Date:   2026-01-02", "      WHY:    crashes", '      Review: "App crashes all the time"',
        "      URL:    https://app.reviewtrackers.com/reviews/r1",
        "", RULE, "  SENTIMENT SUMMARY — Recurring Themes", RULE, "", "  All fine.", "", RULE, ""]
    write_lines(result.report, "line", str(tmp_path / "report"), REPORT_ORDER)
    parts = sorted((tmp_path / "report").glob("part-*"))
    assert "".join(part.read_text(encoding="utf-8") for part in parts) == "\n".join(lines) + "\n"

    messages = result.messages.orderBy("group_ord", "item_ord").collect()
    assert [(row.group_ord, row.item_ord, row.parent_ord, row.text) for row in messages] == [
        (0, 0, None, "AI Review Analysis Report"), (0, 1, 0, "Platforms 1"), (0, 2, 0, "Summary 1"), (7, 0, None, "Core Issues (2 reviews)"),
        (7, 1, 7, "[1] Invented"), (7, 2, 7, "[2] App Crash")]
    main = json.loads(messages[0].blocks_json)
    assert [block["type"] for block in main] == [
        "header", "context", "divider", "section", "divider", "section", "divider", "section", "section"]
    assert main[0]["text"] == {"type": "plain_text", "text": "AI Review Analysis Report", "emoji": True}
    assert main[5]["text"]["text"].endswith("(2 flagged) — see threads below\n\n:hammer_and_wrench:  *Core Issues*: 2 reviews")
    assert main[8] == {"type": "section", "text": {"type": "mrkdwn", "text": "Most frequent themes: Login (2), Fees (1)."}}
    assert json.loads(messages[1].blocks_json)[0]["text"]["text"] == (
        "  • *BBB*: 1 reviews  |  ★ avg 1.0  |  :thumbsup: 0 (0%)  :thumbsdown: 1 (100%)\n"
        "  • *Google Play*: 3 reviews  |  ★ avg 3.3  |  :thumbsup: 1 (33%)  :thumbsdown: 2 (67%)")
    assert json.loads(messages[2].blocks_json)[0]["text"]["text"] == "All fine."
    assert json.loads(messages[3].blocks_json)[0]["text"]["text"] == (
        ":hammer_and_wrench: *Core Issues* — 2 actionable reviews (67% of negative reviews)\n\n"
        '_Example: "" — Unknown_')
    assert json.loads(messages[5].blocks_json)[0]["text"]["text"] == (
        "*[2] App Crash*  `4/5  ████░`\n*Source:* BBB  |  *Rating:* ★☆☆☆☆  |  *Author:* Ann\n*Why actionable:* crashes\n"
        "_App crashes all the time_\n<https://app.reviewtrackers.com/reviews/r1|View review>")
    write_messages(result.messages, str(tmp_path / "messages"))
    assert spark.read.json(str(tmp_path / "messages")).count() == 6


def test_report_without_items(spark, tmp_path):
    empty = json.dumps({"summary": "Nothing.", "theme_counts": {}, "actionable_items": []})
    result = analyse(spark, read_export(spark, export(tmp_path, *LINES)), lambda prompt: empty, str(tmp_path / "store"),
                     "export.csv", "now")
    lines = [row.line for row in result.report.orderBy(*REPORT_ORDER).collect()]
    at = lines.index("  MOST ACTIONABLE THEMES  (0 flagged)")
    assert lines[at + 1:at + 6] == [RULE, "", "  No actionable items identified.", "", ""]
    assert [row.text for row in result.messages.orderBy("item_ord").collect()] == [
        "AI Review Analysis Report", "Platforms 1", "Summary 1"]
    assert "No themes were found." in result.messages.orderBy("item_ord").first().blocks_json


def test_unmatched_items_and_several_batches(spark, rows_of):
    items = spark.createDataFrame([(1, 0, "gone", 3, "Odd", "why")], "batch_no long, pos int, review_id string, score int, category string, reason string")
    raw = spark.createDataFrame([("r1", "2026-01-01", "A", "GP", 1.0, "t", "u", "2026-01")],
                                "review_id string, published string, author string, source string, rating double, review string, url string, month string")
    told = spark.createDataFrame([(1, "One."), (2, "Two.")], "batch_no long, summary string")
    themes = spark.createDataFrame([("Late", 3)], "theme string, n long")
    found = message_stream(review_cube(raw), reported(items, raw), told, themes, "x.csv", "now").orderBy("group_ord", "item_ord").collect()
    assert [(row.group_ord, row.item_ord, row.parent_ord) for row in found] == [(0, 0, None), (0, 1, 0), (0, 2, 0), (0, 3, 0), (7, 0, None), (7, 1, 7)]
    assert json.loads(found[0].blocks_json)[8]["text"]["text"] == "Most frequent themes: Late (3)."
    assert json.loads(found[1].blocks_json)[0]["text"]["text"].startswith("  • *GP*: 1 reviews")
    assert json.loads(found[3].blocks_json)[0]["text"]["text"] == "Two."
    assert '_Example: "" — Unknown_' in json.loads(found[4].blocks_json)[0]["text"]["text"]
    assert json.loads(found[5].blocks_json)[0]["text"]["text"] == (
        "*[1] Odd*  `3/5  ███░░`\n*Source:* N/A  |  *Rating:* ?  |  *Author:* N/A\n*Why actionable:* why\n__")


def test_categories_from_export_to_charts(spark, tmp_path, rows_of):
    def answer(prompt):
        listed = json.loads(prompt.split("by month:\n\n")[1].split("\n\nGive every")[0])
        return json.dumps({month: [{"review_id": row["review_id"], "category": "other"} for row in rows]
                           for month, rows in listed.items()})

    raw = read_export(spark, export(tmp_path, *LINES))
    result = categorise_export(spark, raw, answer, str(tmp_path / "store"))
    assert rows_of(result.categorised, "sentiment", "month", "review_id", "category") == [
        ("neg", "2026-02", "r2", "other"), ("pos", "2026-02", "r3", "other"), ("pos", "junk", "r4", "other")]
    assert result.unanswered.count() == result.rejected_entries.count() == 0
    assert rows_of(categorise_export(spark, raw, answer, str(tmp_path / "valid"), validate_month=True).asked, "review_id") == [("r1",), ("r2",), ("r3",)]
    tables = deck(raw, result.categorised)
    assert rows_of(tables["positive_categories"], "category", "month_1", "n_1", "month_2", "n_2") == [("other", "Feb 2026", 1, "junk", 1)]
    assert rows_of(tables["monthly"], "month", "pos", "neg", "avg_label") == [
        ("2026-01", 0, 0, None), ("2026-02", 1, 2, "3.33"), ("junk", 1, 0, "4.00")]


def test_document_round_trip(spark, tmp_path, rows_of):
    rows = [("pos" if at % 3 else "neg", f"2026-0{1 + at % 2}", f"r{at}", "other") for at in range(700)]
    categorised = spark.createDataFrame(rows, "sentiment string, month string, review_id string, category string")
    document = categorised_document(categorised_batches(categorised))
    assert document.count() == 2 + 4
    write_lines(document, "document", str(tmp_path / "lines"), ["sentiment", "batch_no"])
    columns = ["sentiment", "month", "review_id", "category"]
    assert rows_of(read_categorised(spark, str(tmp_path / "lines"), multi_line=False), *columns) == sorted(rows)
    single = {"pos": {"2026-01": [{"review_id": "a", "category": "x"}]}, "neg": {}}
    (tmp_path / "one.json").write_text(json.dumps(single, indent=2))
    assert rows_of(read_categorised(spark, str(tmp_path / "one.json")), *columns) == [("pos", "2026-01", "a", "x")]


def test_rule_scorers(spark, rows_of):
    frame = spark.createDataFrame(
        [("a", 1.0, "2026-01", "x " * 600 + "The APP crash and freezes"), ("b", 5.0, "2026-01", "Great price"), ("c", 2.0, "2026-01", "meh")],
        "review_id string, rating double, month string, review string")
    lexicon = (("App Crash", "crash", 1), ("App Crash", "freezes", 1), ("Slow Shipping", "crash", 1))
    assert rows_of(score_actionability(frame, lexicon), "review_id", "score", "category", "reason") == [
        ("a", 3, "App Crash", "crash, freezes")]
    lexicons = ((("fair prices", "price", 3), ("fair prices", "cheap", 1)), (("functionality", "app", 1),))
    scores = {(row.review_id, row.category): row.confidence for row in score_categories(frame, lexicons).collect()}
    assert (scores["b", "fair prices"], scores["b", "other"], scores["a", "functionality"], scores["c", "pricing"]) == (75, 0, 100, 0)
    assert rows_of(categorise(rated_text(frame.withColumn("rating_raw", F.col("rating").cast("string"))), lexicons), "review_id", "category") == [
        ("a", "functionality"), ("b", "fair prices"), ("c", "other")]


def test_copies_of_a_scored_review_fill_batches(spark):
    rows = [("copy", 4, "App Crash", "crash")] * 400 + [(f"r{at}", 3, "App Crash", "crash") for at in range(60)]
    items = listed_items(spark.createDataFrame(rows, "review_id string, score int, category string, reason string"))
    places = sorted((row.batch_no, row.pos) for row in items.collect())
    assert places == [(1 + at // 150, at % 150) for at in range(460)]
    assert sorted(row.item_no for row in ranked(items).collect()) == list(range(1, 461))


def test_analysis_by_rules(spark, tmp_path, rows_of):
    lexicon = (("App Crash", "crash", 1), ("App Crash", "all the time", 1), ("Slow Shipping", "late", 1))
    result = analyse_by_rules(spark, read_export(spark, export(tmp_path, *LINES)), "export.csv", "now", lexicon)
    assert rows_of(result.items, "batch_no", "review_id", "score", "category") == [(1, "r1", 3, "App Crash")]
    assert rows_of(result.themes) == [("App Crash", 1), ("Slow Shipping", 1)]
    lines = [row.line for row in result.report.orderBy(*REPORT_ORDER).collect()]
    assert "      WHY:    crash, all the time" in lines
    assert "  Most frequent themes: App Crash (1), Slow Shipping (1)." in lines
    assert result.messages.count() == 5
