import json

from kgloom.operators import conversations as CV

TABLE = [("red", "rot"), ("blue", "blau")]


def asker(log):
    """Asks for two words at once, then with broken arguments, then stays silent once, then ends."""

    def load():
        def talk(talks, tools):
            with open(log, "a") as f:
                f.write("x" * len(talks))
            out = []
            for t in talks:
                n = sum(m["role"] == "assistant" for m in t)
                call = lambda i, name, a: {"id": f"{n}-{i}", "function": {"name": name, "arguments": a}}
                if t[0]["content"] == "silent":
                    out.append({"content": ""})
                elif n == 0:
                    out.append({"tool_calls": [call(0, "say", json.dumps({"word": t[0]["content"]})), call(1, "say", json.dumps({"word": "none"})), call(2, "other", "{}")]})
                elif n == 1:
                    out.append({"tool_calls": [call(0, "say", "{"), call(1, "say", '{"x": 1}')]})
                else:
                    out.append({"content": "done"})
            return out

        return talk

    return load


def run(spark, folder, log, rounds=5):
    tool = CV.lookup_tool("say", "A word in German.", "word", spark.createDataFrame(TABLE, "key string, content string"))
    talks = CV.first_messages(spark.createDataFrame([("1", "red"), ("2", "blue"), ("3", "silent")], "id string, content string"))
    loop = CV.ToolRounds(asker(log), lambda: lambda talks: [float(len(t)) for t in talks], [tool], rounds, folder)
    return {r.id: (r.confidence, [(m.role, m.content) for m in r.messages]) for r in loop.run(talks).collect()}


def test_rounds_and_resuming(spark, tmp_path):
    log, folder = tmp_path / "log", f"file://{tmp_path}/talks"
    got = run(spark, folder, log)
    said = [c for _, c in got["1"][1]]
    assert said[0] == "red" and said[2:5] == ["rot", "No results.", "Error: unknown tool other"] and said[6:8] == ["Error: arguments are no JSON", "Error: word is missing"]
    assert said[8] == "done" and len(said) == 10 and got["1"][0] == 10.0 and got["2"][1][2] == ("tool", "blau")
    assert [r for r, _ in got["3"][1]] == ["user", "user"]  # asked in every round, never answered
    asked = len(log.read_text())
    assert asked == 3 + 3 + 3 + 1 + 1  # only unfinished talks go on
    # the last round's end is lost: its replies are there, and no other talk is sent again
    (tmp_path / "talks/round-004/open/_SUCCESS").unlink()
    assert run(spark, folder, log) == got and len(log.read_text()) == asked
    (tmp_path / "talks/round-004/open/_SUCCESS").unlink()
    (tmp_path / "talks/round-004/replies/_SUCCESS").unlink()
    assert run(spark, folder, log) == got and len(log.read_text()) == asked + 1
