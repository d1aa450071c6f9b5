"""Toxic spans by a linear-chain conditional random field; documents are scored from its marginals.

Only documents carry labels, so tokens get theirs from counts over all
labelled documents: a word, or the first four, five or six bytes of one, may
be suspect if its share of toxic documents is far above theirs at large. Where
toxic documents are copied, all their words look so; therefore suspects are
chosen one after the other, each for the toxic documents that earlier ones
leave unexplained. In a toxic document the suspect tokens are toxic,
everything else is clean.

The field has two states. A token's score for the toxic state is a bias plus
weighted log odds of its word and prefixes; neighbours interact by transition
scores. Tokens with no suspect part all score alike, so a run of them is a
power of one 2 x 2 matrix, and the forward and backward passes go from one
suspect token to the next without losing a position. A document's score is a
logistic function of the marginals of its suspect tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from panelforge.llm.base import Words, col, flat, mixed, query, slices, starts_of, table, without
from panelforge.llm.contamination import letters_and_digits

SLICE = 1 << 19
PREFIXES = (4, 5, 6)


def parts(words: Words, data: np.ndarray, offsets: np.ndarray):
    """For each word its keys (the whole word, then prefixes; 0 where it is too short), start and end; offsets of texts."""
    hashes, starts, ends, of = words(data, offsets)
    padded = np.concatenate([words.kinds[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))[starts]
    keys = [hashes | np.uint64(1)]
    for k in PREFIXES:
        prefix = mixed((eight & np.uint64(256**k - 1)) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) | np.uint64(1)
        keys.append(np.where(ends - starts >= k, prefix, np.uint64(0)))
    return keys, starts, ends, of


def _counted(text: str):
    """Keys of a batch with the numbers of toxic and of clean texts that have them."""

    def run(batches):
        words = Words(letters_and_digits(), 5)
        for batch in batches:
            toxic = np.asarray(batch.column("_toxic"))
            data, offsets = flat(batch.column(text))
            found = []
            for a, b in slices(offsets, SLICE):
                keys, _, _, of = parts(words, data[offsets[a] : offsets[b]], offsets[a : b + 1])
                row = np.repeat(np.arange(a, b), np.diff(of))
                key, row = np.concatenate(keys), np.tile(row, len(keys))
                order = np.lexsort((row, key))
                at = order[starts_of(key[order], row[order])]
                found.append((key[at], toxic[row[at]]))
            if found:
                key, bad = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(key)
                at = starts_of(key[order])
                if len(at):
                    bad = np.add.reduceat(bad[order].astype(np.int64), at)
                    total = np.diff(np.append(at, len(order)))
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key[order][at].view(np.int64)), "toxic": pa.array(bad), "clean": pa.array(total - bad)})

    return run


@dataclass
class Model:
    """Suspect keys with log odds, scores of the field, and the logistic function over its marginals."""

    keys: np.ndarray
    odds: np.ndarray
    field: np.ndarray
    logistic: np.ndarray

    def suspects(self, keys: list[np.ndarray]):
        """The words with a suspect part, and log odds of the parts."""
        values = np.zeros((len(keys[0]), len(keys)), np.float64)
        if len(self.keys) and len(keys[0]):
            for j, key in enumerate(keys):
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                values[:, j] = np.where(self.keys[at] == key, self.odds[at], 0.0)
        at = np.flatnonzero(values.any(1))
        return at, values[at]


class Chains:
    """Suspect tokens of many texts, arranged so that the n-th ones of all texts are handled together."""

    def __init__(self, position: np.ndarray, values: np.ndarray, of: np.ndarray, length: np.ndarray):
        self.count = np.diff(of)
        self.length, self.values = length, values
        before = np.empty(len(position), np.int64)
        before[1:] = position[:-1]
        text = np.repeat(np.arange(len(self.count)), self.count)
        begin = of[:-1][self.count > 0]
        before[begin] = -1
        self.gap = position - before - 1
        last = of[1:] - 1
        self.tail = np.where(self.count > 0, length - 1 - (position[np.maximum(last, 0)] if len(position) else 0), length)
        order = np.argsort(-self.count, kind="stable")
        self.order = order
        self.steps = []
        for n in range(int(self.count.max(initial=0))):
            some = order[: np.searchsorted(-self.count[order], -n, side="left")]
            self.steps.append((some, of[:-1][some] + n))
        self.text = text

    def powers(self, field: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th powers of the matrix of a plain token, each scaled by its largest value, with the log of the scale."""
        bias, t01, t10, t11 = field[0], field[-3], field[-2], field[-1]
        m = np.array([[1.0, np.exp(t01 + bias)], [np.exp(t10), np.exp(t11 + bias)]])
        values, vectors = np.linalg.eig(m)
        ratio = (values / np.abs(values).max())[None, :] ** n[:, None]
        out = np.einsum("ij,nj,jk->nik", vectors, ratio, np.linalg.inv(vectors)).real
        return np.maximum(out, 0), n * np.log(np.abs(values).max())

    def passes(self, field: np.ndarray):
        """Marginals of the suspect tokens and the log of the sum over all label sequences of each text."""
        bias, t01, t10, t11 = field[0], field[-3], field[-2], field[-1]
        score = np.exp(np.clip(bias + self.values @ field[1:-3], -30, 30))
        gap, gap_log = self.powers(field, self.gap)
        tail, tail_log = self.powers(field, self.tail)
        step = np.array([[1.0, np.exp(t01)], [np.exp(t10), np.exp(t11)]])
        n = len(self.count)
        state, total = np.tile([1.0, 0.0], (n, 1)), tail_log.copy()
        forward = np.zeros((len(score), 2))
        for texts, at in self.steps:
            f = np.einsum("ni,nij,jk->nk", state[texts], gap[at], step)
            f[:, 1] *= score[at]
            norm = f.sum(1)
            total[texts] += np.log(norm) + gap_log[at]
            state[texts] = forward[at] = f / norm[:, None]
        total += np.log(np.einsum("ni,nij->n", state, tail))
        back = tail.sum(2)
        marginal = np.zeros(len(score))
        for texts, at in reversed(self.steps):
            both = forward[at] * back[texts]
            marginal[at] = both[:, 1] / both.sum(1)
            b = back[texts].copy()
            b[:, 1] *= score[at]
            b = np.einsum("nij,jk,nk->ni", gap[at], step, b)
            back[texts] = b / b.sum(1)[:, None]
        return marginal, total

    def likelihood(self, field: np.ndarray, toxic: np.ndarray) -> float:
        """Mean log likelihood of the labels: suspect tokens of toxic texts are toxic, all else is clean."""
        bias, t01, t10, t11 = field[0], field[-3], field[-2], field[-1]
        label = toxic[self.text]
        before = np.zeros(len(label), bool)
        if len(label):
            before[1:] = label[:-1] & (self.text[1:] == self.text[:-1]) & (self.gap[1:] == 0)
        gain = np.where(label, bias + self.values @ field[1:-3] + np.where(before, t11, t01), np.where(before, t10, 0.0)).sum()
        # A toxic token is left for a clean one unless the text ends or the next token is toxic too.
        after = np.zeros(len(label), bool)
        if len(label):
            follows = np.zeros(len(label), bool)
            follows[:-1] = (self.text[1:] == self.text[:-1]) & (self.gap[1:] == 0)
            ends = np.ones(len(label), bool)
            ends[:-1] = self.text[1:] != self.text[:-1]
            after = label & ~follows & ~(ends & (self.tail[self.text] == 0))
        gain += t10 * after.sum()
        return float((gain - self.passes(field)[1].sum()) / max(1, self.length.sum())) - 1e-6 * float(field @ field)


def fit_field(chains: Chains, toxic: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Climb the likelihood: its gradient in the few scores by differences, a step that grows while it helps."""
    field = np.concatenate([[-6.0], np.full(1 + len(PREFIXES), 1.0), [0.0, 0.0, 0.0]])
    value, pace = chains.likelihood(field, toxic), 64.0
    for _ in range(rounds):
        slope = np.empty_like(field)
        for j in range(len(field)):
            d = np.zeros_like(field)
            d[j] = 1e-4
            slope[j] = (chains.likelihood(field + d, toxic) - chains.likelihood(field - d, toxic)) / 2e-4
        while pace > 1e-3:
            step = pace * slope
            step *= min(1.0, 1.0 / max(1e-12, float(np.abs(step).max())))
            new = np.clip(field + step, -12, 12)
            if (better := chains.likelihood(new, toxic)) > value:
                field, value, pace = new, better, pace * 2
                break
            pace /= 4
        else:
            break
    return field


def features(chains: Chains, marginal: np.ndarray) -> np.ndarray:
    """Of each text: a constant, the log of one plus the summed marginals, the largest marginal."""
    n = len(chains.count)
    most = np.zeros(n)
    np.maximum.at(most, chains.text, marginal)
    return np.stack([np.ones(n), np.log1p(np.bincount(chains.text, marginal, n)), most], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _candidates(model, text: str):
    """Which candidate keys each distinct word of a text has, by number, -1 for none: one row of parts after the other."""

    def run(batches):
        (known, order), words = model.value, Words(letters_and_digits(), 5)
        for batch in batches:
            data, offsets = flat(batch.column(text))
            found = []
            for a, b in slices(offsets, SLICE):
                keys, _, _, of = parts(words, data[offsets[a] : offsets[b]], offsets[a : b + 1])
                number = np.full((len(keys[0]), len(keys)), -1, np.int64)
                for j, key in enumerate(keys):
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    number[:, j] = np.where(known[at] == key, order[at], -1)
                for i in range(b - a):
                    own = slice(of[i], of[i + 1])
                    at = own.start + np.unique(keys[0][own], return_index=True)[1]
                    rows = number[at]
                    found.append(rows[(rows >= 0).any(1)].ravel())
            yield pa.RecordBatch.from_pydict({"numbers": pa.array(found, pa.list_(pa.int64()))})

    return run


def chosen(texts: list[np.ndarray], clean: np.ndarray, share: float, least: float, width: int) -> list[int]:
    """Candidates that explain toxic texts, best first; a text is explained by two suspect words.

    ``texts`` has the candidates of each word of each toxic text, ``clean``
    the expected number of clean texts of each candidate.
    """
    if not texts:
        return []
    number = np.concatenate(texts).reshape(-1, width)
    word_of = np.repeat(np.arange(len(texts)), [len(t) // width for t in texts])
    row, column = np.nonzero(number >= 0)
    key, text = number[row, column], word_of[row]
    # A candidate counts once in a text.
    pair = np.unique(text * len(clean) + key, return_index=True)[1]
    used, hits = np.zeros(len(number), bool), np.zeros(len(texts), np.int64)
    picked: list[int] = []
    while True:
        some = pair[(hits[text[pair]] < 2) & ~used[row[pair]]]
        t = np.bincount(key[some], minlength=len(clean)).astype(float)
        p = t / np.maximum(t + clean, 1e-9)
        gain = t * np.log(np.maximum(p, 1e-9) / share) + clean * np.log(np.maximum(1 - p, 1e-9) / (1 - share))
        gain = np.where(p > 4 * share / (1 + 3 * share), gain, 0.0)
        best = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or gain[best] <= least:
            return picked
        picked.append(best)
        now = np.unique(row[key == best])
        now = now[~used[now]]
        used[now] = True
        np.add.at(hits, word_of[now], 1)


def _suspects(model, text: str):
    """The suspect tokens of each text: the input of a fit, a few numbers a text."""

    def run(batches):
        m, words = model.value, Words(letters_and_digits(), 5)
        for batch in batches:
            data, offsets = flat(batch.column(text))
            length, positions, values = [], [], []
            for a, b in slices(offsets, SLICE):
                keys, _, _, of = parts(words, data[offsets[a] : offsets[b]], offsets[a : b + 1])
                at, value = m.suspects(keys)
                cut = np.searchsorted(at, of)
                for i in range(b - a):
                    length.append(int(of[i + 1] - of[i]))
                    positions.append(at[cut[i] : cut[i + 1]] - of[i])
                    values.append(value[cut[i] : cut[i + 1]].ravel())
            yield pa.RecordBatch.from_pydict({
                "toxic": batch.column("_toxic"), "length": pa.array(length, pa.int64()),
                "at": pa.array(positions, pa.list_(pa.int64())), "odds": pa.array(values, pa.list_(pa.float64())),
            })

    return run


def train(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = 4000) -> Model:
    """Fit on ``labels`` (id, 0 or 1; the larger one if an id has both, null ones are none).

    Counts of words and prefixes cover all labelled documents. Suspects are
    chosen on ``sample`` toxic documents, the field and the logistic function
    fitted on ``sample`` labelled ones, both taken by a hash of the id. Only
    candidates in those toxic documents can be chosen; they are all kept, so
    what is sent to the workers is bounded by the words of the sample.
    """
    spark = docs.sparkSession
    marks = labels.select(col(id_).alias("_id"), col(label).cast("int").alias("_t")).where("_id is not null and _t is not null")
    marks = marks.groupBy("_id").agg((F.max("_t") > 0).alias("_toxic"))
    texts = docs.select(col(id_).alias("_id"), col(text))
    counts = texts.join(marks.hint("merge"), "_id").select("_toxic", col(text)).mapInArrow(_counted(text), "key long, toxic long, clean long")
    counts = counts.where("key <> 0").groupBy("key").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    totals = marks.agg(F.count_if("_toxic").alias("t"), F.count_if(~F.col("_toxic")).alias("c")).first()
    bad, good = int(totals.t or 0), int(totals.c or 0)
    share, n = (bad + 0.5) / (bad + good + 1), F.col("t") + F.col("c")
    p = F.col("t") / n
    # How much better its own share of toxic documents explains a key than the share at large.
    gain = F.col("t") * F.log(p / share) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1))
    ranked = counts.withColumns({"odds": odds, "gain": gain}).where(f"t >= 2 and odds > {np.log(4)} and gain > 8")
    toxic_ones = marks.where("_toxic").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    here = texts.join(F.broadcast(toxic_ones), "_id").select("_toxic", col(text)).mapInArrow(_counted(text), "key long, toxic long, clean long")
    ranked = ranked.join(here.select("key").distinct().hint("merge"), "key", "left_semi")
    rows = ranked.orderBy(F.desc("gain"), "key").select("key", "odds", "c").toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    picked: list[int] = []
    if len(keys):
        known = spark.sparkContext.broadcast((keys[order], order))
        bad_texts = [np.array(r.numbers, np.int64) for r in texts.join(F.broadcast(toxic_ones), "_id").select(col(text)).mapInArrow(_candidates(known, text), "numbers array<long>").collect()]
        clean = rows.column("c").to_numpy().astype(float) * len(bad_texts) / max(1, bad)
        picked = sorted(chosen(bad_texts, clean, share, 8.0, 1 + len(PREFIXES)), key=lambda i: int(keys[i]))
    model = Model(keys[picked], np.minimum(rows.column("odds").to_numpy()[picked], 8.0), np.zeros(0), np.zeros(0))
    some = marks.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    used = texts.join(F.broadcast(some), "_id").select("_toxic", col(text))
    got = used.mapInArrow(_suspects(spark.sparkContext.broadcast(model), text), "toxic boolean, length long, at array<long>, odds array<double>").collect()
    length = np.array([r.length for r in got], np.int64)
    toxic = np.array([r.toxic for r in got], bool)
    of = np.concatenate([[0], np.cumsum([len(r["at"]) for r in got])]).astype(np.int64)
    width = 1 + len(PREFIXES)
    at = np.concatenate([np.array(r["at"], np.int64) for r in got]) if got else np.zeros(0, np.int64)
    odds = np.concatenate([np.array(r.odds, float) for r in got]).reshape(-1, width) if got else np.zeros((0, width))
    chains = Chains(at, odds, of, length)
    model.field = fit_field(chains, toxic)
    model.logistic = fit_logistic(features(chains, chains.passes(model.field)[0]), toxic.astype(float)) if len(got) else np.zeros(3)
    return model


def _scored(model, text: str):
    def run(batches):
        m, words = model.value, Words(letters_and_digits(), 5)
        for batch in batches:
            data, offsets = flat(batch.column(text))
            scores, spans = [np.zeros(0)], []
            for a, b in slices(offsets, SLICE):
                part = data[offsets[a] : offsets[b]]
                keys, starts, ends, of = parts(words, part, offsets[a : b + 1])
                at, values = m.suspects(keys)
                cut = np.searchsorted(at, of)
                chains = Chains(at - of[:-1][np.searchsorted(of, at, side="right") - 1], values, cut, np.diff(of))
                marginal, _ = chains.passes(m.field)
                scores.append(1 / (1 + np.exp(-np.clip(features(chains, marginal) @ m.logistic, -30, 30))))
                for i in range(b - a):
                    own = at[cut[i] : cut[i + 1]][marginal[cut[i] : cut[i + 1]] >= 0.5]
                    runs = []
                    if len(own):
                        base = offsets[a + i] - offsets[a]
                        character = np.cumsum((part[base : offsets[a + i + 1] - offsets[a]] & 0xC0) != 0x80)
                        for k in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                            runs.append([int(character[starts[k[0]] - base]) - 1, int(character[ends[k[-1]] - base - 1])])
                    spans.append(runs)
            score = np.concatenate(scores)
            out = batch
            for name, column, kind in (
                ("score", score, pa.float64()), ("predicted", (score >= 0.5).astype(np.int32), pa.int32()), ("toxic_spans", spans, pa.list_(pa.list_(pa.int64()))),
            ):
                out = out.append_column(name, pa.array(column, kind))
            yield out

    return run


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.5 on) and toxic_spans (character offsets of runs of toxic tokens).

    A null or empty text has no spans and the score of a text without suspect
    tokens. Every row is scored alone, so rows that repeat agree. Columns of
    ``docs`` with these names go.
    """
    df = without(docs, "score", "predicted", "toxic_spans")
    out = StructType([*df.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("toxic_spans", ArrayType(ArrayType(LongType())))])
    return df.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model), text), out)


def held_out(id_: str = "doc_id"):
    return F.crc32(F.coalesce(col(id_).cast("string"), F.lit(""))) % 5 == 0


@query("op2_toxicity")
def op2_toxicity(spark, folder):
    """All documents; learns from labels whose crc32 modulo 5 is not 0."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels").where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
