"""Encoder and model behind HTTP, with a transport of the test's own."""

import json

import pytest
from pyspark.sql import functions as F

from mnemospark import errors
from mnemospark.providers import encode_column
from mnemospark.service import Memory
from mnemospark.sources import http


def replies(*given):
    """A transport that gives these replies in turn (the last again and again), and the calls it had."""
    calls, left = [], list(given)

    def send(method, url, body, headers, timeout):
        calls.append((method, url, json.loads(body) if body else None, headers))
        found = left.pop(0) if len(left) > 1 else left[0]
        if isinstance(found, Exception):
            raise found
        return found

    return send, calls


def chat_reply(text):
    return 200, json.dumps({"choices": [{"message": {"content": text}}]}).encode()


def constant(method, url, body, headers, timeout):
    text = json.loads(body)["input"] if body else ""
    return 200, json.dumps({"embeddings": [[float(len(text)), 1.0]]}).encode()


def code(call):
    with pytest.raises(errors.MemoryError_) as e:
        call()
    return e.value.code


def test_addresses():
    assert http.chat_address(" http://h/ ") == http.chat_address("http://h/v1") == http.chat_address("http://h/v1/chat/completions/")
    assert http.chat_address("https://h:1/a") == "https://h:1/a/v1/chat/completions"
    for wrong in ("", "h:80", "ftp://h", "http://"):
        assert code(lambda wrong=wrong: http.HttpEncoder(wrong, "m", 2)) == errors.CONFIG


def test_encoder():
    send, calls = replies((200, b'{"embeddings": [[1, 2.5]]}'))
    encoder = http.HttpEncoder("http://h/", "m", 2, transport=send)
    assert encoder.encode("text") == [1.0, 2.5]
    assert calls == [("POST", "http://h/api/embed", {"model": "m", "input": "text"}, {"Content-Type": "application/json"})]
    wrong = [(500, b"down"), (200, b"{"), (200, b'{"embeddings": []}'), (200, b'{"embeddings": [[1]]}'), (200, b"[]"), OSError("gone")]
    for reply in wrong:
        encoder = http.HttpEncoder("http://h", "m", 2, transport=replies(reply)[0])
        assert code(lambda encoder=encoder: encoder.encode("x")) == errors.ENCODER


def test_health(monkeypatch):
    now = [100.0]
    monkeypatch.setattr(http.time, "monotonic", lambda: now[0])
    send, calls = replies((204, b""), (404, b""), OSError("gone"))
    encoder = http.HttpEncoder("http://h", "m", 2, transport=send)
    assert encoder.available() and encoder.available() and len(calls) == 1
    now[0] += http.HEALTH_SECONDS
    assert not encoder.available() and not encoder.available() and len(calls) == 2
    now[0] += http.HEALTH_SECONDS
    assert not encoder.available() and [c[:2] for c in calls] == [("HEAD", "http://h/")] * 3


def test_attempts():
    waited = []
    send, calls = replies((503, b""), (429, b""), chat_reply("[]"))
    assert http.HttpModel("http://h", "m", "secret", transport=send, wait=waited.append).consolidate("p") == []
    assert waited == [0.5, 2.0] and len(calls) == 3 and calls[0][3]["Authorization"] == "Bearer secret"
    for reply, attempts in (((500, b"x"), 3), ((400, b"x"), 1), (OSError("gone"), 1), ((200, b'{"choices": []}'), 1)):
        send, calls = replies(reply)
        model = http.HttpModel("http://h", "m", transport=send, wait=lambda s: None)
        assert code(lambda model=model: model.keywords("x")) == errors.LLM and len(calls) == attempts


def test_replies():
    model = lambda *r: http.HttpModel("http://h", "m", transport=replies(*map(chat_reply, r))[0])
    assert model('```json\n["b", " a ", "b", "", 3]\n```').keywords("x") == ["b", "a"]
    assert model("sorry", '[{"merged_summary": "s"}, 1]').consolidate("x") == [{"merged_summary": "s"}]
    assert model('{"emotion": {}}').distill("x") == {"emotion": {}}
    assert model('[{"name": "n"}]').crystallize("x") == [{"name": "n"}]
    assert code(lambda: model("{}").consolidate("x")) == errors.LLM


def test_in_the_engine(spark, tmp_path):
    encoder = http.HttpEncoder("http://h", "m", 2, transport=constant)
    rows = spark.createDataFrame([("ab",), (None,)], "t string").select(encode_column(encoder, F.col("t")).alias("v")).collect()
    assert [list(r["v"]) for r in rows] == [[2.0, 1.0], [0.0, 1.0]]
    # A service that is not well opens no store, and leaves no lock behind.
    ill = http.HttpEncoder("http://h", "m", 2, transport=replies((500, b""))[0])
    assert code(lambda: Memory(spark, f"file://{tmp_path}", encoder=ill)) == errors.ENCODER
    Memory(spark, f"file://{tmp_path}", encoder=encoder).close()
