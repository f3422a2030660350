"""Language identification as a mixture of languages, by expectation-maximisation.

Learning counts the byte n-grams of all training texts by language, in buckets of a hash. A document's n-grams are then
taken as drawn from a mixture of the languages: expectation-maximisation estimates the proportions, first with all
languages; nested sets of its strongest languages are fitted again, and the set with the highest likelihood less a
penalty per language is chosen. The prediction is the language with the largest proportion in that set.

Sets of every size are tried, up to all languages; a size is left out only if all languages beyond it together add less to
the likelihood of the first fit than one penalty. ``fit`` says how well the chosen mixture explains the text: its mean log
likelihood per n-gram, less that of texts of the same mixture. It is near 0 for learned languages, and far below for a
language that was never learned, whatever the shares of the learned ones in it.

Only runs of letters count, lower-cased, with a mark at both ends; digits and signs say nothing of a language.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could be
learned. Rows without a language teach nothing. Ties go to the language that comes first by code point. Repeated rows each
get a result. Very long texts are read whole, in pieces of letters. Empty tables give empty results. Other columns of the
input are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earthworks.llm.store import kept
from earthworks.llm.words import pieces

BUCKETS = 1 << 15
ORDER = 3
STEPS = 12
PENALTY = 3.0
SMOOTH = 0.5
MOST_LANGUAGES = 1000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str | None, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs. Runs of letters are joined by one blank."""
    total, found = None, (np.empty(0, np.int64), np.empty(0, np.int64))
    for piece in pieces(text or ""):
        if not (runs := LETTERS.findall(piece.lower())):
            continue
        data = np.frombuffer((" " + " ".join(runs) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint64)
        grams = np.zeros(max(len(data) - order + 1, 1), np.uint64)
        for k in range(min(order, len(data))):
            grams = (grams << np.uint64(8)) | data[k : k + len(grams)]
        spread = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - buckets.bit_length() + 1)
        if total is None and len(piece) == len(text):
            return np.unique(spread.astype(np.int64), return_counts=True)
        total = (0 if total is None else total) + np.bincount(spread.astype(np.int64), minlength=buckets)
        found = np.flatnonzero(total), total[total > 0]
    return found


@dataclass(frozen=True)
class Model:
    """Languages in order, the probability of each bucket in each of them, and their share of the training texts."""

    languages: list[str]
    likelihood: np.ndarray  # buckets x languages
    prior: np.ndarray


def counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``bucket``, ``n`` over all rows; bucket -1 counts the texts. Each task sends its own sums only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1), strict=True):
                table = sums.setdefault(name.as_py(), np.zeros(BUCKETS + 1, np.int64))
                at, n = features(body.as_py())
                table[at] += n
                table[-1] += 1
        for name, table in sums.items():
            at = np.flatnonzero(table)
            yield pa.record_batch({"lang": pa.array([name] * len(at), pa.string()),
                                   "bucket": np.where(at == BUCKETS, -1, at), "n": table[at]})

    parts = df.select(lang, text).where(F.col(lang).isNotNull()).mapInArrow(count, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_LANGUAGES) -> Model:
    """The model; on the driver it is one number for each bucket and language, of which there may be ``most``."""
    table = kept(counts(df, text, lang), "language-counts")
    languages = sorted(r.lang for r in table.select("lang").distinct().limit(most + 1).collect())
    if len(languages) > most:
        raise ValueError(f"more than {most} languages: raise the bound if the driver has the memory")
    place = {name: k for k, name in enumerate(languages)}
    n, texts = np.full((BUCKETS, len(languages)), SMOOTH), np.ones(len(languages))
    found = table.toArrow()
    column = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    bucket, total = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    body = bucket >= 0
    n[bucket[body], column[body]] += total[body]
    texts[column[~body]] += total[~body]
    return Model(languages, n / n.sum(axis=0), texts / max(texts.sum(), 1))


def _fit(p: np.ndarray, n: np.ndarray, starts: np.ndarray, row: np.ndarray, allowed: np.ndarray, prior: np.ndarray,
         steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of every document over the languages it is allowed. One segment per document."""
    share = allowed * prior
    share /= share.sum(axis=1, keepdims=True)
    for _ in range(steps):
        part = p * share[row]
        part *= (n / part.sum(axis=1))[:, None]
        # each document's prior counts as one n-gram, so that very short texts lean on it
        share = np.add.reduceat(part, starts) + allowed * prior
        share /= share.sum(axis=1, keepdims=True)
    return share, np.add.reduceat(n * np.log((p * share[row]).sum(axis=1)), starts)


def infer(model: Model, bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The proportions of all languages, the chosen set, and the fit, for documents with at least one n-gram."""
    sizes = np.array([len(at) for at, _ in bags])
    starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)
    at, n = (np.concatenate(x) for x in zip(*bags, strict=True))
    p, n = model.likelihood[at], n.astype(float)
    total = np.add.reduceat(n, starts)
    most = len(model.languages)
    share, whole = _fit(p, n, starts, row, np.ones((len(bags), most)), model.prior, STEPS)
    penalty = PENALTY * np.log(total + 1)
    by_share = -np.sort(-share, axis=1)
    rest = -np.log(np.minimum(np.cumsum(by_share, axis=1), 1)) * total[:, None]  # what the languages beyond each size add
    rest[:, -1] = 0
    limit = 1 + np.argmax(rest <= penalty[:, None], axis=1)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    best, likely = np.zeros_like(share), np.zeros(len(bags))
    score, chosen = np.full(len(bags), -np.inf), np.zeros(share.shape, bool)
    for size in range(1, int(limit.max()) + 1):
        docs = np.flatnonzero(limit >= size)
        allowed = rank[docs] < size
        if size == most:
            fitted, found = share[docs], whole[docs]
        else:
            mine = (limit >= size)[row]
            fitted, found = _fit(p[mine], n[mine], np.cumsum(sizes[docs]) - sizes[docs], np.repeat(np.arange(len(docs)), sizes[docs]),
                                 allowed.astype(float), model.prior, STEPS if size > 1 else 0)
        worth = found - penalty[docs] * size
        better = worth > score[docs]
        at = docs[better]
        best[at], likely[at], score[at], chosen[at] = fitted[better], found[better], worth[better], allowed[better]
    own = (model.likelihood * np.log(model.likelihood)).sum(axis=0)
    return best, chosen, likely / total - best @ own


def predicted(df: DataFrame, model: Model, keys: list[Column | str], text: str = "text") -> DataFrame:
    """The keys, ``lang_pred``, ``score`` (the language's proportion), ``fit`` and ``languages`` with their proportions."""
    rows = df.select(*keys, F.col(text))
    names = rows.columns[:-1]
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField(
        "score", T.DoubleType()), T.StructField("fit", T.DoubleType()), T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for whole in batches:
            step = max(2048 // max(len(of.languages), 4), 1)  # a table of n-grams by languages has bounded size
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                bags = [features(t.as_py()) for t in batch.column(len(names))] if of.languages else []
                some = [k for k, (places, _) in enumerate(bags) if len(places)]
                label, score, fit = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                sets: list[list] = [[] for _ in range(batch.num_rows)]
                if some:
                    share, chosen, fit[some] = infer(of, [bags[k] for k in some])
                    for k, s, c in zip(some, share, chosen, strict=True):
                        label[k], score[k] = of.languages[int(s.argmax())], min(float(s.max()), 1.0)
                        sets[k] = [(of.languages[x], float(s[x])) for x in np.flatnonzero(c)]
                yield pa.RecordBatch.from_arrays(
                    batch.columns[:-1] + [pa.array(label, pa.string()), pa.array(score), pa.array(fit),
                                          pa.array(sets, pa.map_(pa.string(), pa.float64()))],
                    names=[*names, "lang_pred", "score", "fit", "languages"])

    return rows.mapInArrow(predict, schema)
