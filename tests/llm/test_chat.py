"""Turns and their texts come back; what looks like a marker but is none stays text; the best path is the best of all."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from earthworks.llm import chat


def turns_of(spark, talks):
    """Talks as lists of transcript rows; the turns of each."""
    rows = [(c, k, t) for c, talk in enumerate(talks) for k, t in enumerate(talk)]
    df = spark.createDataFrame(rows, "c long, k long, text string")
    found = [[] for _ in talks]
    for r in sorted(chat.turns(df, "c", ["k"]).collect(), key=lambda r: (r.c, r.turn)):
        found[r.c].append((r.role, r.text))
    return found


LIST = "Steps:\na) first\nb) second\nAnswer: five"
TALKS = [
    (["User: How?\nContext: none", f"Assistant: {LIST}", "User: thanks"],
     [("user", "How?\nContext: none"), ("assistant", LIST), ("user", "thanks")]),
    (["Human: run it", "AI: calling", "Tool: {'x': 1}\nmodel: b", "AI: it is 1"],
     [("user", "run it"), ("assistant", "calling"), ("tool", "{'x': 1}\nmodel: b"), ("assistant", "it is 1")]),
    (["**Q:** why?", "**A:** because\n(a) one\n(b) two\n**Answer:** so", "**Q:** ah"],
     [("user", "why?"), ("assistant", "because\n(a) one\n(b) two\n**Answer:** so"), ("user", "ah")]),
    (["Question: what is it?", "Answer: a thing\nme) x", "Question: which?"],
     [("user", "what is it?"), ("assistant", "a thing\nme) x"), ("user", "which?")]),
    ([LIST], [("user", LIST)]),
    (["### Instructions:\nBe kind.\n### Context\nnone", "### Human:\nhi", "### AI:\n# Answer\nyes", "### Participant:\nme too"],
     [("system", "Be kind.\n### Context\nnone"), ("user", "hi"), ("assistant", "# Answer\nyes"), ("other", "me too")]),
    (["[user] a", "[assistant] AI: the future of work\n[a] see below", "[user] b"],
     [("user", "a"), ("assistant", "AI: the future of work\n[a] see below"), ("user", "b")]),
]


def test_turns_and_texts_come_back(spark):
    assert turns_of(spark, [t for t, _ in TALKS]) == [w for _, w in TALKS]


def test_unknown_roles_keep_their_turns(spark):
    rows = [(c, k, role, f"text {k}") for c in range(12) for k, role in enumerate(["user", "tool", None, "moderator", "assistant", "Tool "])]
    df = spark.createDataFrame(rows, "c long, k long, role string, text string")
    shown = df.select("c", "k", chat.transcript(df["c"], df["role"], df["text"]).alias("text"))
    found = {}
    for r in sorted(chat.turns(shown, "c", ["k"], model=chat.fitted(df)).collect(), key=lambda r: (r.c, r.turn)):
        found.setdefault(r.c, []).append((r.role, r.text, r.rendered))
    wanted = [(r, f"text {k}", f"<|{r}|>\ntext {k}<|end|>\n") for k, r in enumerate(["user", "tool", "other", "other", "assistant", "tool"])]
    assert len(found) == 12 and all(t == wanted for t in found.values())


@pytest.mark.parametrize("seed", range(12))
def test_path_is_the_best_of_all_paths(seed):
    """Viterbi against every sequence of states, for random models and lines; also between given ends."""
    rng = np.random.default_rng(seed)
    n = 4
    model = chat.default_model()
    lines = [["User: a?", "b", "", "Assistant: c"][k] for k in rng.integers(0, 4, n)]
    scores, _ = chat.seen(lines, model, chat.speakers(chat.styles_of(lines)))
    scores = scores + rng.normal(0, 0.5, scores.shape)

    def value(states, before):
        first = model.start if before is None else model.step[before]
        return first[states[0]] + sum(scores[k, s] for k, s in enumerate(states)) + sum(model.step[a, b] for a, b in zip(states, states[1:], strict=False))

    for before, last in ((None, None), (1, None), (None, 3), (2, 5)):
        ways = [s for s in product(range(chat.N), repeat=n) if last is None or s[-1] == last]
        best = max(value(s, before) for s in ways)
        assert abs(value(chat.path(scores, model, before, last).tolist(), before) - best) < 1e-9


def test_counted_lines_move_the_model(spark):
    rows = [("user", "one line?")] * 200 + [("assistant", "a\n\nb\nc")] * 200 + [("moderator", "x" * 300)] * 50
    model = chat.fitted(spark.createDataFrame(rows, "role string, text string"))
    user, assistant, other = (chat.STATES.index((chat.ROLES.index(r), True)) for r in ("user", "assistant", "other"))
    goes_on = lambda s: np.exp(model.step[s, s + 1])
    assert goes_on(user) < 0.1 and 0.7 < goes_on(assistant) < 0.8
    assert np.exp(model.asks[1, user]) > 0.9 and np.exp(model.long[1, other]) > 0.75 and np.exp(model.blank[1, assistant + 1]) > 0.2
    assert np.allclose(np.exp(chat.fitted(spark.createDataFrame([], "role string, text string")).step), np.exp(chat.default_model().step))
