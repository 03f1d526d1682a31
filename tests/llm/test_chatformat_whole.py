"""What a template takes from far behind the window is in the pieces, also where the newest turns don't show that it looks there."""

import __spark_entry__ as entry
from factloom.llm import chatformat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_no_text_differs_from_the_whole_render(spark):
    def again(turns):
        """Texts that were said before carry a mark."""
        return "".join(f"<{'again ' if (role, text) in turns[:k] else ''}{text}>" for k, (role, text) in enumerate(turns))

    rows = [(c, t, "assistant" if t % 2 else "user", f"t{t % 10 if c == 1 else t}") for c, n in ((1, 24), (2, 24), (3, 4), (None, 11)) for t in range(n)]
    said = spark.createDataFrame(rows, SCHEMA)
    whole = {c: again([(r, x) for k, _, r, x in rows if k == c]) for c in (1, 2, 3, None)}
    found = chatformat.complete(said, again, window=3)
    assert {r["conv_id"]: r["formatted"] for r in chatformat.assembled(found).collect()} == whole
    lost = {r["conv_id"]: r["formatted"] for r in chatformat.assembled(chatformat.formatted(said, again, window=3)).collect()}
    assert lost[1] != whole[1] and lost[2] == whole[2]  # the window alone doesn't tell


def test_query_formats_conversations_whole(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(chatformat, "complete", lambda df, *rest: taken.append(df) or chatformat.formatted(df, *rest))
    entry.queries()["op13_chat_formatting"](spark, "/root/testdata/sf0.001")
    assert len(taken) == 1
