"""Chat formatting: roles recovered from transcripts by a hidden Markov model, then turns rendered in one form.

Each line of a transcript begins a turn of a role or goes on with it; these are the hidden states. What is seen of a line
is its speaker marker, whether it is blank or follows a blank one, whether it asks, and its length. The Viterbi path over
all lines of a conversation gives the turns; markers are taken off where a turn of their role begins, and each turn is
rendered as ``<|role|>`` line break, text, ``<|end|>`` line break.

What marks a speaker is a matter of the whole conversation: a name and its dress (plain, heading, bold, bracketed) are
counted over all its lines, and ``speakers`` keeps those that recur. Names that texts use too ("Answer:", "Context:") only
count where no clearer name stands for their role, and beside a marker of another role in the same dress; so lists, headings
and "Answer: 42" stay text. How long turns are and what their lines look like is counted from turns whose
roles are known (``fitted``); the order of roles and the trust in markers are set by hand.

Rows are dealt out by ranges of (conversation, order), so a very long conversation is spread over many tasks. A part of a
conversation that others share is first summed up as a matrix of best scores between the states at its ends; the matrices
of a conversation, one per task at most, give the states at all cuts, and each part is then solved on its own.

Defined results: rows without a text are one empty line. Rows without an id form a conversation of their own. Rows are
ordered by ``order``, nulls first, then by a hash of the text; repeated rows are repeated lines. A conversation whose first
line has no marker begins with the likeliest role. Roles that are no known one are ``other``. Of equal paths the one whose
states come first in STATES is taken. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earthworks.llm.store import kept

ROLES = ("system", "user", "assistant", "tool", "other")
# Names of speakers in transcripts; the clear ones are hardly used otherwise.
CLEAR = {
    "system": "system systemprompt sistema système",
    "user": "user human customer usuario utilisateur nutzer benutzer",
    "assistant": "assistant ai bot chatbot asistente",
    "tool": "tool",
    "other": "participant",
}
VAGUE = {
    "system": "instruction instructions context",
    "user": "client person me you question prompt q frage",
    "assistant": "model agent answer response a antwort réponse respuesta",
    "tool": "function plugin observation",
    "other": "speaker other",
}
ROLE_OF = {name: k for k, r in enumerate(ROLES) for name in (CLEAR[r] + " " + VAGUE[r]).split()}
IS_CLEAR = frozenset(name for names in CLEAR.values() for name in names.split())
ALONE = {("bold", "q"), ("bold", "a")}  # vague names that are as good as clear ones in this dress
_NAME = "|".join(sorted(ROLE_OF, key=len, reverse=True))
MARKER = re.compile(
    rf"[^\S\n]*(?:\#{{1,6}}[^\S\n]*(?:(?P<heading>{_NAME})[^\S\n]*\d*[^\S\n]*:|(?P<title>{_NAME})[^\S\n]*\d*[^\S\n]*$)"
    rf"|(?P<mark>\*{{1,3}}|_{{1,3}})(?P<bold>{_NAME})[^\S\n]*\d*[^\S\n]*(?::(?P=mark)|(?P=mark)[^\S\n]*:)"
    rf"|(?:\[(?=[^\]\n]*\])|\((?=[^)\n]*\))|<\|?(?=[^>\n]*>))(?P<bracket>{_NAME})[^\S\n]*\d*(?:\]|\)|\|?>):?"
    rf"|>?[^\S\n]*(?P<plain>{_NAME})[^\S\n]*\d*[^\S\n]*:)[^\S\n]*", re.I)
STATES = [(role, begins) for role in range(len(ROLES)) for begins in (True, False)]
N = len(STATES)


def style(line: str) -> tuple[str, str, re.Match] | None:
    """Dress and name of the marker that a line begins with, if it does."""
    if not (found := MARKER.match(line)):
        return None
    dress = next(k for k in ("heading", "title", "bold", "bracket", "plain") if found[k])
    return dress, found[dress].lower(), found


def speakers(counts: dict[tuple[str, str], int]) -> set[tuple[str, str]]:
    """The styles that mark speakers in a conversation, by how many of its lines begin with each.

    Of the clear names of a role the most frequent, and others that occur at least twice and half as often; of the vague
    ones the most frequent, if the role has no clear one, and another role has a style in its dress.
    """
    kept = set()
    for role in range(len(ROLES)):
        mine = {s: n for s, n in counts.items() if ROLE_OF[s[1]] == role}
        clear = {s: n for s, n in mine.items() if s[1] in IS_CLEAR}
        if clear:
            most = max(clear.values())
            top = min(s for s, n in clear.items() if n == most)
            kept |= {s for s, n in clear.items() if s == top or n >= max(2, most / 2)}
        elif mine:
            beside = {d for d, name in counts if ROLE_OF[name] != role}
            kept.add(min(mine, key=lambda s: (s[0] not in beside, -mine[s], s)))
    dresses = {d: {ROLE_OF[name] for x, name in kept if x == d} for d, _ in kept}
    return {s for s in kept if s[1] in IS_CLEAR or s in ALONE or len(dresses[s[0]]) > 1}


@dataclass(frozen=True)
class Model:
    """Log scores: ``start`` of the first line, ``step`` between states, and of what is seen in each state."""

    start: np.ndarray
    step: np.ndarray
    marker: np.ndarray  # by marker (0 none, then roles)
    blank: np.ndarray  # by no, yes
    gap: np.ndarray
    asks: np.ndarray
    long: np.ndarray


@dataclass(frozen=True)
class Lines:
    """Of each role: turns, their lines, and shares of lines that are blank, end with a question mark, are long."""

    goes_on: np.ndarray
    blank: np.ndarray
    asks: np.ndarray
    long: np.ndarray


PRIOR = Lines(goes_on=np.array([0.6, 0.6, 0.75, 0.75, 0.6]), blank=np.array([0.1] * 5),
              asks=np.array([0.08, 0.35, 0.08, 0.02, 0.2]), long=np.array([0.25, 0.25, 0.45, 0.3, 0.25]))
PULL = 20  # how many lines the prior counts for
LONG = 200


def default_model(lines: Lines = PRIOR) -> Model:
    first = np.array([0.12, 0.75, 0.05, 0.03, 0.05])
    # the next turn's role
    after = np.array([[0.04, 0.83, 0.08, 0.02, 0.03], [0.02, 0.07, 0.84, 0.04, 0.03], [0.02, 0.82, 0.05, 0.08, 0.03],
                      [0.01, 0.08, 0.80, 0.08, 0.03], [0.03, 0.35, 0.35, 0.02, 0.25]])
    step = np.empty((N, N))
    for a, (role, _) in enumerate(STATES):
        for b, (other, begins) in enumerate(STATES):
            step[a, b] = (1 - lines.goes_on[role]) * after[role, other] if begins else lines.goes_on[role] * (role == other)
    start = np.array([first[r] if begins else 0.0 for r, begins in STATES])
    marker = np.full((len(ROLES) + 1, N), 0.004)
    blank, gap, asks, long = (np.empty((2, N)) for _ in range(4))
    for s, (role, begins) in enumerate(STATES):
        marker[0, s] = 0.12 if begins else 0.98
        if begins:
            marker[1 + role, s] = 0.864
        share = 0.01 if begins else lines.blank[role]
        blank[:, s] = 1 - share, share
        gap[:, s] = (0.6, 0.4) if begins else (0.88, 0.12)
        asks[:, s] = 1 - lines.asks[role], lines.asks[role]
        long[:, s] = 1 - lines.long[role], lines.long[role]
    with np.errstate(divide="ignore"):
        return Model(*(np.log(x) for x in (start, step, marker, blank, gap, asks, long)))


def known_role(role: Column) -> Column:
    """One of ROLES; a null or unknown role is ``other``."""
    plain = F.lower(F.trim(role))
    return F.when(plain.isin(*ROLES), plain).otherwise("other")


def fitted(turns: DataFrame, role: str = "role", text: str = "text") -> Model:
    """The model with lengths and looks of lines counted from turns whose roles are known; one row per role is collected."""
    cut = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    share = lambda test: F.sum(F.size(F.filter(cut, test)))
    sums = {r["role"]: r for r in turns.groupBy(known_role(F.col(role)).alias("role")).agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.size(cut)).alias("lines"), share(lambda x: ~x.rlike(r"\S")).alias("blank"),
        share(lambda x: x.rlike(r"[?？]\s*$")).alias("asks"), share(lambda x: F.length(x) > LONG).alias("long")).collect()}

    def counted(what: str, prior: np.ndarray) -> np.ndarray:
        seen = [sums.get(r) for r in ROLES]
        hits = np.array([0 if r is None else r["lines"] - r["turns"] if what == "on" else r[what] for r in seen])
        return (hits + PULL * prior) / (np.array([0 if r is None else r["lines"] for r in seen]) + PULL)

    return default_model(Lines(counted("on", PRIOR.goes_on), counted("blank", PRIOR.blank), counted("asks", PRIOR.asks),
                               counted("long", PRIOR.long)))


def seen(
    lines: list[str], model: Model, valid: set[tuple[str, str]], gap: bool = False,
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log scores of every line in every state, and its marker's role (-1: none) and length.

    ``valid`` are the conversation's styles of speakers. ``gap``: a blank line comes before the first.
    """
    marks = []
    for line in lines:
        found = style(line)
        marks.append((ROLE_OF[found[1]], found[2].end()) if found and found[:2] in valid else (-1, 0))
    kind = np.array([1 + role for role, _ in marks], np.int64)
    blank = np.array([not x.strip() for x in lines], np.int64)
    before = np.append(int(gap), blank[:-1])
    asks = np.array([x.rstrip().endswith(("?", "？")) for x in lines], np.int64)
    long = np.array([len(x) > LONG for x in lines], np.int64)
    total = model.marker[kind] + model.blank[blank] + model.gap[before] + model.asks[asks] + model.long[long]
    return total, marks


def styles_of(lines: list[str]) -> Counter:
    return Counter(found[:2] for x in lines if (found := style(x)))


def transfer(scores: np.ndarray, model: Model, first: bool) -> np.ndarray:
    """Best scores from the state before these lines (a single row, if there is none) to the state of the last one."""
    best = (model.start + scores[0])[None] if first else model.step + scores[0]
    for line in scores[1:]:
        best = (best[:, :, None] + model.step).max(axis=1) + line
    return best


def path(scores: np.ndarray, model: Model, before: int | None, last: int | None) -> np.ndarray:
    """The best states of these lines, between given states before the first and at the last line if there are any."""
    reach = (model.start if before is None else model.step[before]) + scores[0]
    back = np.zeros(scores.shape, np.int64)
    for k, line in enumerate(scores[1:], 1):
        ways = reach[:, None] + model.step
        back[k] = ways.argmax(axis=0)
        reach = ways.max(axis=0) + line
    states = np.empty(len(scores), np.int64)
    states[-1] = int(reach.argmax()) if last is None else last
    for k in range(len(scores) - 1, 0, -1):
        states[k - 1] = back[k, states[k]]
    return states


def _segments(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[dict, list[str]]]:
    """Runs of rows with one part and conversation, with the lines of all their texts. Columns: c, part, ..., text.

    A run's row also has the Arrow ``type`` of c, which a null alone does not tell.
    """
    open_, lines = None, []
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for values in zip(*(c.to_pylist() for c in columns), strict=True):
            row = dict(zip(names, values, strict=True)) | {"type": columns[0].type}
            if open_ is not None and (open_["c"], open_["part"]) != (row["c"], row["part"]):
                yield open_, lines
                open_ = None
            if open_ is None:
                open_, lines = row, []
            lines += (row["text"] or "").split("\n")
    if open_ is not None:
        yield open_, lines


def _valid(row: dict) -> set[tuple[str, str]]:
    return {tuple(x.split(" ", 1)) for x in row["styles"] or ()}


def _styles(lines: DataFrame, within: DataFrame, kind: str) -> DataFrame:
    """``sc``, ``sp``, ``styles``: the styles that mark speakers in a conversation, for each of its parts.

    Each task counts its own lines; a conversation has as many rows here as it has styles, at most a few hundred.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict = {}
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := styles_of((text or "").split("\n")):
                    sums.setdefault(c, Counter()).update(found)
            rows = [(c, " ".join(s), n) for c, found in sums.items() for s, n in found.items()]
            ids, names, numbers = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch({"c": pa.array(ids, batch.column(0).type), "style": pa.array(names, pa.string()),
                                   "n": pa.array(numbers, pa.int64())})

    counted = lines.select("c", "text").mapInArrow(count, f"c {kind}, style string, n long")
    counted = counted.groupBy("c", "style").agg(F.sum("n").alias("n"))
    listed = counted.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("style", "n"))).alias("found"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [sorted(" ".join(s) for s in speakers({tuple(x["style"].split(" ", 1)): x["n"] for x in found}))
                      for found in batch.column(1).to_pylist()]
            yield pa.record_batch({"sc": batch.column(0), "styles": pa.array(chosen, pa.list_(pa.string()))})

    chosen = listed.mapInArrow(choose, f"sc {kind}, styles array<string>")
    parts = within.select("c", F.col("part").alias("sp"))
    return kept(chosen.join(parts, F.col("c").eqNullSafe(F.col("sc"))).select("sc", "sp", "styles"), "styles")


def _cuts(parts: DataFrame, model: Model) -> DataFrame:
    """``c``, ``part``, ``before``, ``last``: the states at the ends of each part of a conversation that is cut."""

    def chain(held: pa.Table) -> pa.Table:
        order = np.argsort(held.column("part").to_numpy())
        tables = [np.array(held.column("m")[int(k)].as_py()).reshape(-1, N) for k in order]
        reach, back = tables[0][0], []
        for t in tables[1:]:
            ways = reach[:, None] + t
            back.append(ways.argmax(axis=0))
            reach = ways.max(axis=0)
        last = [int(reach.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last.reverse()
        ids = held.take(pa.array(order))
        return pa.table({"c": ids.column("c"), "part": ids.column("part"), "last": pa.array(last, pa.int32()),
                         "before": pa.array([None, *last[:-1]], pa.int32())})

    kind = parts.schema["c"].dataType.simpleString()
    # one row per task that holds a part of the conversation
    return parts.groupBy("c").applyInArrow(chain, f"c {kind}, part int, last int, before int")


def turns(df: DataFrame, conversation: str, order: list[Column | str], text: str = "text", model: Model | None = None) -> DataFrame:
    """``conversation``, ``turn`` (from 0), ``role``, ``text`` and ``rendered`` of every recovered turn."""
    model = model or default_model()
    sent = df.sparkSession.sparkContext.broadcast(model)  # a few small tables
    places = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = df.select(F.col(conversation).alias("c"), *[p.alias(f"o{k}") for k, p in enumerate(places)],
                     F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("u"), F.col(text).alias("text"))
    along = ["c", *[f"o{k}" for k in range(len(places))], "h", "u"]
    dealt = rows.repartitionByRange(*along).withColumn("part", F.spark_partition_id())
    lines = kept(dealt, "transcripts")
    within = lines.select("c", "part").distinct()
    shared = kept(within.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("first")).where("n > 1"), "shared")
    same = F.col("c").eqNullSafe(F.col("sc"))
    marked = shared.select(F.col("c").alias("sc"), "first")
    kind = rows.schema["c"].dataType.simpleString()
    named = _styles(lines, within, kind)
    with_styles = lines.join(named, same & (F.col("part") == F.col("sp")), "left").drop("sc", "sp")

    def dealt_again(frame: DataFrame) -> DataFrame:
        return frame.repartition("part").sortWithinPartitions("part", *along)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, found in _segments(batches, ["c", "part", "first", "styles", "text"]):
            table = transfer(seen(found, sent.value, _valid(row))[0], sent.value, row["part"] == row["first"])
            yield pa.record_batch({"c": pa.array([row["c"]], row["type"]), "part": pa.array([row["part"]], pa.int32()), "m": [table.ravel().tolist()]})

    sums = dealt_again(with_styles.join(marked, same)).mapInArrow(sum_up, f"c {kind}, part int, m array<double>")
    cuts = kept(_cuts(kept(sums, "parts"), model), "cuts")
    ends = cuts.select(F.col("c").alias("sc"), F.col("part").alias("sp"), "last", "before")
    joined = with_styles.join(ends, same & (F.col("part") == F.col("sp")), "left")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, found in _segments(batches, ["c", "part", "before", "last", "styles", "text"]):
            scores, marks = seen(found, sent.value, _valid(row))
            states = path(scores, sent.value, row["before"], row["last"])
            begins = np.array([STATES[s][1] for s in states])
            number = np.cumsum(begins)  # 0: goes on with the turn of the part before
            starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            # a marker comes off only where it says what the state says
            bodies = [x[end:] if STATES[s] == (role, True) else x for x, (role, end), s in zip(found, marks, states, strict=True)]
            texts = ["\n".join(bodies[a:b]) for a, b in zip(starts, [*starts[1:], len(found)], strict=True)]
            yield pa.record_batch({
                "c": pa.array([row["c"]] * len(starts), row["type"]), "part": pa.array([row["part"]] * len(starts), pa.int32()),
                "number": pa.array(number[starts], pa.int64()),
                "role": [ROLES[STATES[states[a]][0]] for a in starts], "text": texts})

    pieces = kept(dealt_again(joined).mapInArrow(solve, f"c {kind}, part int, number long, role string, text string"), "pieces")
    ended = pieces.groupBy("c", "part").agg(F.max("number").alias("n"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ended.join(marked.select("sc"), same, "left_semi").withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    shift = shift.select(F.col("c").alias("sc"), F.col("part").alias("sp"), "shift")
    numbered = pieces.join(shift, same & (F.col("part") == F.col("sp")), "left").withColumn(
        "turn", F.col("number") + F.coalesce("shift", F.lit(0)) - 1)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n")
    whole = numbered.groupBy("c", "turn").agg(F.first("role").alias("role"), F.trim(body, F.lit(" \t\r\n")).alias("text"))
    return whole.select(F.col("c").alias(conversation), "turn", "role", "text", rendered(F.col("role"), F.col("text")).alias("rendered"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


# Speaker markers of four styles of transcripts, by role.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: ", "tool": "Tool: ", "other": "Participant: "},
    {"system": "### Instructions:\n", "user": "### Human:\n", "assistant": "### AI:\n", "tool": "### Tool:\n",
     "other": "### Participant:\n"},
    {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] ", "tool": "[tool] ", "other": "[participant] "},
    {"system": "**Context:** ", "user": "**Q:** ", "assistant": "**A:** ", "tool": "**Tool:** ", "other": "**Participant:** "},
)


def transcript(conversation: Column, role: Column, text: Column) -> Column:
    """A turn as a transcript shows it: its text behind a marker in the conversation's style."""
    style = F.pmod(F.xxhash64(conversation), F.lit(len(STYLES)))
    mark, who = F.lit(""), known_role(role)
    for k, names in enumerate(STYLES):
        for name, marker in names.items():
            mark = F.when((style == k) & (who == name), marker).otherwise(mark)
    return F.concat(mark, F.coalesce(text, F.lit("")))
