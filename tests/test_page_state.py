"""Page states, reruns, error kinds."""

import pytest
from pyspark.sql import functions as F

from quire.functions import page_state as ps
from quire.operators import pages

REPLY = ("job_id long, page int, r_sent boolean, r_markdown string, r_no_text boolean, r_note string, r_uncertain array<string>, r_error string,"
         "r_model string, r_provider string, r_input_tokens long, r_output_tokens long, r_cost_usd double")


def drafts(spark, rows):
    return ps.draft_from_text(spark.createDataFrame(rows, "job_id long, page int, markdown string"))


def reply(page, md=None, no_text=False, note=None, uncertain=None, error=None, usage=None):
    tokens = usage or (None, None, None)
    return (1, page, True, md, no_text, note, uncertain, error, "m", "p", *tokens)


@pytest.fixture(scope="module")
def finals(spark):
    text = "第一页的文字层，足够长，超过三十个字符，所以不会要求复核，这里再补几个字。"
    d = drafts(spark, [(1, i, text) for i in range(1, 7)] + [(1, 7, "")])
    r = spark.createDataFrame([
        reply(1, f" {text} ", usage=(5, 6, 0.0)), reply(2, no_text=True, note="photo"), reply(3, ""), reply(4, error="请求超时（34s 未返回）。"),
        reply(5, text + "[unclear]", uncertain=["x"]), reply(7, error="fetch failed")], REPLY)
    return pages.with_replies(d, r).cache()


def test_outcomes(finals):
    got = {r["page"]: r["o"] for r in finals.select("page", ps.outcome().alias("o")).collect()}
    assert got == {1: "ai", 2: "noText", 3: "fallback", 4: "fallback", 5: "ai", 6: "local", 7: "fallback"}


def test_reasons_and_fields(finals):
    p = {r["page"]: r for r in finals.collect()}
    assert p[1]["status"] == "good" and p[1]["reasons"] == [] and p[1]["input_tokens"] == 5 and p[1]["cost_usd"] == 0.0
    assert not p[1]["markdown"].startswith(" ")
    assert p[2]["markdown"] == "" and p[2]["reasons"] == ["AI 检测：未发现可提取的文字（photo）"] and p[2]["line_count"] == 0
    assert p[3]["reasons"] == ["AI 结果未通过程序校验：模型返回空白内容"]
    assert p[4]["reasons"] == ["AI 识别失败，已回退 PDF 文字层：请求超时（34s 未返回）。"] and p[4]["model"] is None
    assert p[5]["status"] == "review" and p[5]["reasons"] == ["模型标记不确定：x", "结果中仍有无法辨认的符号"]
    assert p[7]["reasons"][-1] == "AI 识别失败，且此页没有文字层可回退：fetch failed" and len(p[7]["reasons"]) == 2
    assert p[6]["raw_markdown"] is None and p[6]["ai_attempted"] is False


def test_redraft_is_stable_and_clean(finals):
    once = ps.to_draft(finals).collect()
    p = {r["page"]: r for r in once}
    assert all(not r["reasons"] or r["page"] == 7 for r in once)
    assert p[2]["method"] == "surya" and p[2]["markdown"] != "" and p[2]["status"] == "review"
    assert p[4]["method"] == "text" and p[7]["method"] == "empty" and p[7]["reasons"] == ["文字层过少；扫描页或公式页请改用本地高精度"]


def test_causes_summary(finals):
    got = {r["kind"]: (r["pages"], r["empty_pages"], r["blocker"]) for r in pages.failure_causes(finals).collect()}
    assert got == {"rejected": (1, 0, False), "timeout": (1, 0, False), "network": (1, 1, False)}


def test_rerun_of_fallback_pages_only(spark, finals):
    todo, keep = pages.fallback_rerun(finals)
    assert sorted(r["page"] for r in todo.collect()) == [3, 4, 7] and keep.count() == 4


def test_rescue_replaces_only_what_now_works(spark, finals):
    text = "新的结果" * 20
    second = pages.with_replies(
        drafts(spark, [(1, 4, "第一页的文字层"), (1, 7, "")]),
        spark.createDataFrame([reply(4, text), reply(7, error="fetch failed")], REPLY))
    p = {r["page"]: r for r in pages.rescue(finals, second).collect()}
    assert len(p) == 7 and p[4]["method"] == "ai" and p[4]["markdown"] == text and p[4]["reasons"] == []
    assert p[7]["method"] == "empty" and "ai_failed" not in p[7].asDict()


VALIDATION = [
    ("x" * 200, "x" * 79, ["模型结果比本地初稿短太多"]), ("x" * 200, "x" * 95, []), ("x" * 119, "y", []),
    ("$a$ $b$", "$a$", ["模型结果丢失了本地已识别公式"]), ("A. x\nB. y", "A. x", ["模型结果丢失了选项标签"]), ("A. x", "z", []),
    ("x" * 200, " \n", ["模型返回空白内容", "模型结果比本地初稿短太多"]),
]


def test_validation(spark):
    d = drafts(spark, [(1, i, a) for i, (a, _, _) in enumerate(VALIDATION)])
    r = spark.createDataFrame([reply(i, b) for i, (_, b, _) in enumerate(VALIDATION)], REPLY)
    got = ps.checked(d.join(r, ["job_id", "page"])).orderBy("page").collect()
    assert [g["_failures"] for g in got] == [w for _, _, w in VALIDATION]


# messages seen in practice: message, kind, does a rerun help
ERRORS = [
    ("请求超时（34s 未返回）。", "timeout", True), ("fetch failed", "network", True),
    ("模型请求失败（429）：Your prepayment credits are depleted.", "credits", False),
    ("模型请求失败（429）：Resource has been exhausted (e.g. check quota). RESOURCE_EXHAUSTED", "rateLimit", True),
    ("模型请求失败（400）：Model output became abnormal while generating a JSON response.", "badOutput", True),
    ("模型请求失败（404）：No endpoints found for x.", "model", False), ("模型没有返回有效 JSON。", "badOutput", True),
    ("Unterminated string in JSON at position 1920", "badOutput", True), ("模型请求失败（401）：Incorrect API key provided", "auth", False),
    ("The PDF file is empty, i.e. its size is zero bytes.", "emptyFile", False), ("上传没有完成：aborted", "unknown", None),
    ("请先在设置中填写 API Key。", "auth", False), ("连不上本机服务：ECONNREFUSED", "network", True),
]


def test_error_kinds(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _, _) in enumerate(ERRORS)], "i int, m string")
    kind = ps.error_kind(F.col("m"), F.lit("call"))
    rows = df.select("i", kind.alias("k"), ps.retry_helps(kind).alias("r")).orderBy("i").collect()
    assert [(r["k"], r["r"]) for r in rows] == [(k, h) for _, k, h in ERRORS]
    assert df.select(ps.error_kind(F.col("m"), F.lit("check"))).distinct().collect() == [("rejected",)]


def test_states_after_cancel_and_patch(spark):
    df = spark.createDataFrame([(True, "done"), (False, "queued"), (False, "running")], "has boolean, s string")
    now, old = F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    rows = df.select(ps.settle_cancelled(F.col("has")), F.to_date(ps.patched_finish(F.col("s"), old, now)).cast("string")).collect()
    assert [tuple(r) for r in rows] == [("done", "2024-01-02"), ("cancelled", None), ("cancelled", "2024-01-01")]
