"""Chat formatting against whole renders, exact round trips and templates that don't only append."""

import collections
import hashlib
import random

from factloom.llm import chatformat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece string, status string, position int"
BITS = ["[", "]", "<", ">", "/", "\\", "s", "INST", "ROLE", "SAYS", "user", "\n", "é", "🙂", "0", "1", *chatformat.CONTROLS]


def talk(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


def in_order(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(said)] for c, said in by.items()}


def noise(rng):
    return "".join(rng.choices(BITS, k=rng.randint(0, 12)))


def corner(rng):
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "", "[INST]"]), noise(rng)) for c in range(30) for t in range(rng.randint(1, 40))]
    return rows + [(40, None, "assistant", None), (40, None, "assistant", None), (40, 3, "user", ""), (None, 1, "assistant", "x"), (None, 0, None, "y"),
                   (41, 1, "assistant", "b"), (41, 1, "assistant", "a"), (42, 0, "assistant", "long </s> " * 100_000), (-7, 5, "assistant", "[INST]")]


def test_escaping_is_reversible():
    rng = random.Random(1)
    for _ in range(5000):
        text = noise(rng)
        kept = chatformat.escaped(text)
        assert chatformat.unescaped(kept) == text and not any(c in kept for c in chatformat.CONTROLS)
        turns = [(rng.choice(["user", "assistant", "system", noise(rng)]), noise(rng)) for _ in range(rng.randint(1, 5))]
        assert [t for t, _ in chatformat.read_marked(chatformat.marked(turns))] == turns


def test_pieces_equal_whole_renders_and_read_back(spark):
    given = corner(random.Random(2))
    want = in_order(given)
    pieces = chatformat.formatted(talk(spark, given))
    whole = {r["conv_id"]: r for r in chatformat.assembled(pieces).collect()}
    read = {r["conv_id"]: r for r in chatformat.digests(pieces).collect()}
    assert set(whole) == set(read) == set(want)
    for c, turns in want.items():
        text = chatformat.marked(turns)
        said = "".join(t for r, t in turns if r == "assistant")
        assert whole[c]["formatted"] == text
        assert [chatformat.unescaped(text[s["start"]:s["end"]]) for s in whole[c]["loss"]] == [t for r, t in turns if r == "assistant"]
        assert read[c]["formatted_chars"] == len(text) and read[c]["n_turns"] == len(turns) and read[c]["loss_chars"] == len(said)
        assert read[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert read[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_empty_table(spark):
    assert chatformat.digests(chatformat.formatted(talk(spark, []))).count() == 0


def statuses(turns, render, window=3):
    r = chatformat.Renderer(render, window=window)
    return [r.add(t) for t in turns]


TURNS = [("system", "be brief"), ("user", "a"), ("assistant", "think: b"), ("user", "c"), ("assistant", "d"), ("user", "e"), ("assistant", "f")]


def test_templates_that_rewrite_history_are_found():
    def last_thought(turns):  # earlier thoughts go as soon as the user answers
        last = max(k for k, t in enumerate(turns) if t[0] == "user") if any(r == "user" for r, _ in turns) else 0
        return "".join(f"<{r}>{t.replace('think: ', '') if k < last else t}" for k, (r, t) in enumerate(turns))

    def system_last(turns):  # the system text moves into the newest turn
        head = [t for r, t in turns if r == "system"]
        rest = [(r, t) for r, t in turns if r != "system"]
        return "".join(f"<{r}>{t}" for r, t in rest[:-1]) + "".join(f"<{r}>{' '.join(head)}{t}" for r, t in rest[-1:])

    assert [s[3] for s in statuses(TURNS, last_thought)] == ["appends"] * 3 + ["rewrites"] + ["appends"] * 3
    assert "rewrites" in [s[3] for s in statuses(TURNS, system_last, window=8)]
    assert all(s[0] is None and s[1] is None for s in statuses(TURNS, last_thought) if s[3] != "appends")


def test_templates_that_look_behind_the_window_are_found():
    def numbered(turns):
        return "".join(f"<{k}:{t}>" for k, (_, t) in enumerate(turns))

    assert [s[3] for s in statuses(TURNS, numbered)] == ["appends"] * 3 + ["remote"] * 4
    assert [s[3] for s in statuses(TURNS, numbered, window=8)] == ["appends"] * 7


def test_text_is_located_in_any_template():
    def trimmed(turns):
        return "".join(f"[{r}] 0{t.strip()}1 [end]\n" for r, t in turns)

    got = statuses([("user", " a "), ("assistant", " 01 "), ("assistant", "1 [end]\n")], trimmed)
    assert [p[h:h + c] for p, h, c, _ in got[1:]] == ["01", "1 [end]"] and got[0][1] is None

    def silent(turns):
        return "".join(f"[{r}]" for r, _ in turns)

    assert statuses([("assistant", "a")], silent) == [("[assistant]", None, None, "appends")]
