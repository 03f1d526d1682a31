"""Templates that look behind the window are rendered whole."""

from factloom.llm import chatformat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_no_turn_is_lost_behind_the_window(spark):
    def numbered(turns):  # the first turns of a conversation carry no number
        return "".join(f"<{k if k >= 3 else '-'}:{t}>" for k, (_, t) in enumerate(turns))

    rows = [(c, t, "assistant" if t % 2 else "user", f"t{t}") for c, n in ((1, 2), (2, 12), (None, 7)) for t in range(n)]
    said = spark.createDataFrame(rows, SCHEMA)
    assert chatformat.formatted(said, numbered, window=3).where("status = 'remote'").count() > 0
    got = {r["conv_id"]: r["formatted"] for r in chatformat.assembled(chatformat.complete(said, numbered, window=3)).collect()}
    assert got == {c: numbered([(r, x) for k, _, r, x in rows if k == c]) for c in (1, 2, None)}
