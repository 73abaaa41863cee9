"""The scorer loop: every outcome of a call, and a chat service that misbehaves."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from scorewright.operators import scorer
from scorewright.sources.chat import Chat, ChatError

GOOD = '{"score": 4, "evidence": "MDA_P001", "reason": "as  stated"}'


def faulty():
    """A call that goes wrong in the way its prompt begins with."""
    good, retry = GOOD, scorer.RETRY

    def call(prompt: str, attempt: int):
        kind = prompt.split()[0]
        if kind == "down" or (kind == "late" and attempt == 1):
            raise TimeoutError(f"no answer {attempt}")
        return {
            "late": good,
            "good": good,
            "fence": f"```json\n{good}\n```",
            "second": good if attempt > 1 and prompt.endswith(retry) else "sorry",
            "third": (good, 10) if attempt > 2 else ('{"score": 9, "evidence": "p", "reason": ""}', 10),
            "never": '{"score": 3, "evidence": "MDA_P002", "reason": "2 + 2", "more": [1]}',
            "list": "[1, 2]",
            "greedy": (good, 3686),
            "silent": "",
        }[kind]

    return call


def test_every_outcome(spark):
    kinds = ["good", "fence", "second", "third", "never", "list", "late", "down", "silent"]
    rows = [(i, k, f"{k} prompt", "[MDA_P001] text", "MDA", "x") for i, k in enumerate(kinds)] + [(90, "long", "w " * 5000, "[MDA_P001]", "MDA", "x")]
    tasks = spark.createDataFrame(rows, "id int, kind string, prompt string, text string, prefix string, raw string")
    got = {r["kind"]: r.asDict() for r in scorer.scored(tasks, faulty(), id_cols=["id", "kind"]).collect()}
    assert len(got) == 10
    short = {k: (v["status"], v["score"], v["attempts"], v["parse_status"], v["schema_status"], v["error_type"]) for k, v in got.items()}
    assert short == {
        "good": ("success", 4, 1, "parsed", "valid", ""),
        "fence": ("success", 4, 1, "parsed", "valid", ""),
        "second": ("success", 4, 2, "parsed", "valid", ""),
        "third": ("success", 4, 3, "parsed", "valid", ""),
        "never": ("failed", None, 3, "parsed", "invalid", "manual_required"),
        "list": ("failed", None, 3, "parsed", "invalid", "manual_required"),
        "late": ("failed", None, 2, "parsed", "valid", "request_failed"),
        "down": ("failed", None, 3, "not_attempted", "invalid", "request_failed"),
        "silent": ("failed", None, 3, "parse_failed", "invalid", "manual_required"),
        "long": ("failed", None, 0, "not_attempted", "invalid", "context_budget_failed"),
    }
    assert got["good"]["evidence"] == "MDA_P001" and got["good"]["reason"] == "as stated"
    assert got["never"]["error_message"] == "evidence_locator_not_found;nested_value_more;reason_contains_arithmetic;unexpected_field_more"
    assert got["list"]["error_message"] == got["silent"]["error_message"] == "json_parse_failed"
    assert (got["late"]["error_message"], got["down"]["error_message"]) == ("no answer 1", "no answer 3")


def test_tokens_that_the_model_saw(spark):
    assert scorer.seen_limit() == 3686
    rows = [(1, "greedy", "[MDA_P001]", "MDA"), (2, "third", "[MDA_P001]", "MDA"), (3, "good", None, "MDA")]
    tasks = spark.createDataFrame(rows, "id int, prompt string, text string, prefix string")
    got = {r["id"]: (r["status"], r["attempts"], r["error_type"], r["error_message"]) for r in scorer.scored(tasks, faulty(), id_cols=["id"], most_seen=scorer.seen_limit()).collect()}
    assert got == {1: ("failed", 1, "prompt_eval_too_high", "prompt tokens 3686"), 2: ("success", 3, "", ""), 3: ("failed", 1, "prompt_eval_too_high", "prompt tokens unknown")}
    assert scorer.scored(tasks.where("1 = 0"), faulty(), id_cols=["id"]).collect() == []


def plain_issues(payload, text: str, prefix: str) -> list[str]:
    import re

    if not isinstance(payload, dict):
        return ["payload_not_object"]
    out = [f"unexpected_field_{k}" for k in payload if k not in scorer.FIELDS] + [f"nested_value_{k}" for k, v in payload.items() if isinstance(v, dict | list)] + [f"missing_field_{f}" for f in scorer.FIELDS if f not in payload]
    try:
        score = int(payload.get("score"))
    except (TypeError, ValueError):
        score = None
        out.append("score_not_integer")
    out += ["score_out_of_range"] * (score not in (1, 2, 3, 4, 5))
    found = re.search(rf"{prefix}_P\d{{3}}", str(payload.get("evidence", "")))
    out += ["empty_evidence"] if not found else ["evidence_locator_not_found"] * (f"[{found[0]}]" not in text)
    reason = " ".join(str(payload.get("reason", "")).split())
    out += ["empty_reason"] * (not reason) + ["reason_too_long"] * (len(reason) > 240) + ["reason_contains_arithmetic"] * bool(re.search(r"\d+\s*[+\-*/]\s*\d+", reason))
    return sorted(set(out))


def test_issues_against_plain_rules(spark):
    scores = [1, 5, 0, 6, 3.7, -0.5, "3", " 4 ", "3.7", "", True, False, None, [3], 1e300]
    payloads = [{"score": s, "evidence": "see [NEWS_P002]", "reason": "ok"} for s in scores]
    payloads += [{"score": 3, "evidence": e, "reason": r} for e in ("NEWS_P001", "NEWS_P1", "MDA_P001", None, 7, {"a": 1}) for r in ("", " \t ", None, "x" * 241, "x " * 120, "5 / 3", 12, ["a"])]
    payloads += [{}, {"x": {}}, {"score": 2, "evidence": "NEWS_P001", "reason": "r", "b": None}, [1], 3]
    df = spark.createDataFrame([(i, json.dumps(p), "[NEWS_P001] a [NEWS_P002] b", "NEWS") for i, p in enumerate(payloads)], "i int, p string, t string, x string")
    got = {r["i"]: r["issues"] for r in df.select("i", scorer.answer_issues(F.col("p"), F.col("t"), F.col("x")).alias("issues")).collect()}
    assert got == {i: plain_issues(p, "[NEWS_P001] a [NEWS_P002] b", "NEWS") for i, p in enumerate(payloads)}


class Service(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        asked = body["messages"][1]["content"]
        code, said = 200, json.dumps({"message": {"content": GOOD}, "prompt_eval_count": len(asked)})
        if "old" in asked and "think" in body:
            code, said = 400, "this model does not support think"
        elif "broken" in asked:
            code, said = 500, "broken"
        elif "words" in asked:
            said = "not json"
        elif "blank" in asked:
            said = ""
        self.send_response(code)
        self.end_headers()
        self.wfile.write(said.encode())

    def log_message(self, *_):
        pass


def test_a_chat_service(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        chat = Chat(f"http://127.0.0.1:{server.server_port}/api/chat", "m", timeout=10)
        assert chat("fine", 1) == (GOOD, 4) and chat("old", 1) == (GOOD, 3) and chat("blank", 1) == ("", None)
        for asked, said in (("broken", "HTTP 500"), ("words", "no JSON")):
            with pytest.raises(ChatError, match=said):
                chat(asked, 1)
        tasks = spark.createDataFrame([(1, "fine", "[MDA_P001]", "MDA"), (2, "broken", "", "MDA")], "id int, prompt string, text string, prefix string")
        got = {r["id"]: (r["status"], r["error_type"], r["attempts"]) for r in scorer.scored(tasks, chat, id_cols=["id"]).collect()}
        assert got == {1: ("success", "", 1), 2: ("failed", "request_failed", 3)}
    finally:
        server.shutdown()
    with pytest.raises(ChatError):
        Chat(f"http://127.0.0.1:{server.server_port}/none", "m", timeout=2)("x", 1)


def test_python_gets_prompts_alone_in_batches_that_long_texts_make_shorter(spark, tmp_path):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]

    def sized(prompt: str, attempt: int) -> str:
        import sys

        frame = sys._getframe()
        while "b" not in frame.f_locals or frame.f_code.co_name != "ask":
            frame = frame.f_back
        b = frame.f_locals["b"]
        # what a batch holds: one column of so many rows and characters
        (tmp_path / f"{len(b)}-{b.ndim}-{int(b.str.len().sum())}").touch()
        return GOOD

    tasks = spark.range(0, 1500, 1, 1).select("id", F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 8000)).alias("prompt"), F.lit("[MDA_P001]").alias("text"), F.lit("MDA").alias("prefix"))
    got = scorer.scored(tasks, sized, id_cols=["id"], attempts=1).groupBy("status", "score").count().collect()
    assert [tuple(r) for r in got] == [("success", 4, 1500)]
    batches = [tuple(map(int, f.name.split("-"))) for f in tmp_path.iterdir()]
    assert all(columns == 1 and rows <= 1000 and size <= 5 << 20 for rows, columns, size in batches)
    assert [spark.conf.get(k) for k in keys] == before
