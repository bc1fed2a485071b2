"""Language ID by interpolated Kneser-Ney character language models, one for each language.

A model predicts every letter of a word, and the word's end, from up to four characters before it, the word's start
among them. N-grams of an order below the highest count by how many characters precede them, save those at a word's start; each order has its own
discount n1 / (n1 + 2 n2) and is interpolated with the next lower one, the lowest with equal chances. The models are merged into one sorted array of n-gram
hashes with each language's log-probability, backed off where it lacks the n-gram, and one of context hashes with back-off weights. Lookups are binary
searches, from the longest n-gram down to the first that any language has.

A text's cross-entropy under a model is the negative log-probability of its lower-cased letter runs for each character
predicted. The language with the lowest one is chosen. Two things are calibrated on every fifth sampled text, which the counts leave out:
the temperature that turns cross-entropies into a probability of being right, and each language's limits, one for each length class, above which a
text is rejected. For these the held-out texts are cut into excerpts of each length; a limit lets all but ``REJECT`` of the excerpts pass, in units of their
deviation, and is then widened by ``MARGIN``, as few excerpts lie so far out.

Fitting uses a sample with a documented bound: of each language about ``per_lang`` rows, those whose ids have the smallest hashes.
Prediction covers whole texts of all rows. Tables hold at most the n-grams of their sample, so their broadcast is bounded by it too.

Edge cases: a text that is null or has no letter is `und`, score 0, rejected. Ties go to the language that sorts first.
Equal texts get equal results; an empty table gives an empty one. Where no language can be learned all are `und`. Extra columns pass through ``identify`` untouched, but for
columns of the names that it adds, which it replaces.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.llm import _shared as S

ORDER, PER_LANG, CACHE, TOGETHER = 5, 1000, 500_000, 4
#: Length classes in predicted characters; the share of own-language excerpts to reject and the margin on it; steps and the least deviation of cross-entropies.
LENGTHS, REJECT, MARGIN, STEP, LEAST_DEVIATION = 2 ** np.arange(3, 14), 1e-3, 1.5, 0.02, 0.03
_M = S.multipliers(ORDER, 2)


def _letters(text: str | None) -> list[str]:
    return S.LETTERS.findall(text.lower()) if text else []


class _Grams:
    """Hashes of the n-grams that end at each predicted character of some words."""

    def __init__(self, words: list[str]):
        c = S.code_points(" " + " ".join(words) + " ").astype(np.uint64)
        spaces = c == 32
        word = np.cumsum(spaces) - 1  # a word's starting space counts with it
        place = np.arange(len(c))
        self.end = place[1:]  # every character but the first space is predicted; a space also starts the next word
        self.owner = word[self.end] - spaces[self.end]
        self.most = np.minimum(self.end - place[spaces][self.owner] + 1, ORDER)  # characters from the word's start on
        self.starts = self.end - place[spaces][self.owner] + 1
        self.c = c

    def hashes(self, n: int, of: np.ndarray, back: int = 0) -> np.ndarray:
        """Of the n characters that end ``back`` before the predicted ones numbered ``of``."""
        end = self.end[of] - back
        h = np.full(len(of), n, np.uint64)
        for j in range(n):
            h += (self.c[end - j] + np.uint64(1)) * _M[j]
        return S.mix(h)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    once, at = np.unique(keys, return_inverse=True)
    return once, np.bincount(at, values, len(once))


def fit_model(words: Counter) -> dict:
    """Sorted hash arrays of one language's model, from counts of its words."""
    kinds = sorted(words)
    g = _Grams(kinds)
    times = np.array([words[w] for w in kinds], np.float64)[g.owner]
    n_all = np.arange(len(g.end))
    count: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in range(ORDER, 0, -1):
        of = n_all[g.most >= n]
        whole = (g.starts[of] == n) | (n == ORDER)  # nothing can stand before it
        keys, sums = [g.hashes(n, of[whole])], [times[of[whole]]]
        if n < ORDER:  # each longer n-gram once
            longer = of[~whole]
            _, first = np.unique(g.hashes(n + 1, longer), return_index=True)
            keys.append(g.hashes(n, longer[first]))
            sums.append(np.ones(len(first)))
        count[n] = _sums(np.concatenate(keys), np.concatenate(sums))
    chars = len(np.unique(g.c)) + 1  # one more for any unknown
    gram, logp, ctx, weight, suffix, before = [], [], [], [], [], []
    lower = {}
    for n in range(1, ORDER + 1):
        keys, a = count[n]
        n1, n2 = (a == 1).sum(), (a == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        of = n_all[g.most >= n]
        h, first = np.unique(g.hashes(n, of), return_index=True)
        of = of[first]  # h is keys: each n-gram with a place where it stands
        context = g.hashes(n - 1, of, 1) if n > 1 else np.zeros(len(of), np.uint64)
        ctx_keys, total = _sums(context, a)
        _, kinds_after = _sums(context, np.ones(len(a)))
        gamma = discount * kinds_after / total
        at = np.searchsorted(ctx_keys, context)
        below = np.full(len(h), 1 / chars) if n == 1 else lower["p"][np.searchsorted(lower["keys"], g.hashes(n - 1, of))]
        p = np.maximum(a - discount, 0) / total[at] + gamma[at] * below
        lower = {"keys": keys, "p": p}
        gram.append(keys)
        logp.append(np.log(p))
        suffix.append(g.hashes(n - 1, of) if n > 1 else context)
        before.append(context)
        if n > 1:
            ctx.append(ctx_keys)
            weight.append(np.log(gamma))
        else:
            unknown = float(np.log(gamma[0] / chars))
    orders = [len(x) for x in gram]
    gram, logp, suffix, before = (np.concatenate(x) for x in (gram, logp, suffix, before))
    ctx, weight = (np.concatenate(x) if x else np.empty(0) for x in (ctx, weight))
    by = np.argsort(ctx)
    return {"gram": gram, "logp": logp, "suffix": suffix, "before": before, "orders": orders, "ctx": ctx[by], "weight": weight[by], "unknown": unknown}


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def merged(models: list[dict]) -> dict:
    """One sorted array of the n-grams of all models, with each model's log-probability, backed off where it lacks the n-gram; the same for contexts and weights."""
    ctx = np.unique(np.concatenate([m["ctx"] for m in models]))
    weight = np.zeros((len(ctx), len(models)))
    for k, m in enumerate(models):
        weight[np.searchsorted(ctx, m["ctx"]), k] = m["weight"]
    unknown = np.array([m["unknown"] for m in models])
    grams, probabilities = [], []
    lower_keys, lower = np.empty(0, np.uint64), np.empty((0, len(models)))
    for n in range(1, ORDER + 1):
        parts = [slice(sum(m["orders"][: n - 1]), sum(m["orders"][:n])) for m in models]
        keys, first = np.unique(np.concatenate([m["gram"][x] for m, x in zip(models, parts, strict=True)]), return_index=True)
        suffix, before = (np.concatenate([m[c][x] for m, x in zip(models, parts, strict=True)])[first] for c in ("suffix", "before"))
        if n == 1:
            p = np.tile(unknown, (len(keys), 1))
        else:
            at, there = _found(ctx, before)
            p = lower[np.searchsorted(lower_keys, suffix)] + np.where(there[:, None], weight[at], 0)
        for k, (m, x) in enumerate(zip(models, parts, strict=True)):
            p[np.searchsorted(keys, m["gram"][x]), k] = m["logp"][x]
        grams.append(keys)
        probabilities.append(p)
        lower_keys, lower = keys, p
    gram, p = np.concatenate(grams), np.concatenate(probabilities)
    order = np.argsort(gram)
    return {"gram": gram[order], "logp": p[order].astype(np.float32), "ctx": ctx, "weight": weight.astype(np.float32), "unknown": unknown}


def tables(models: dict[str, dict]) -> dict:
    """The merged tables of TOGETHER languages each, so that their size stays in proportion to the models'."""
    langs = sorted(models)
    return {"langs": langs, "tables": [merged([models[x] for x in langs[i : i + TOGETHER]]) for i in range(0, len(langs), TOGETHER)]}


def word_scores(model: list[dict], words: list[str]) -> np.ndarray:
    """Log-probability of each word, its end included, under each model of some merged tables."""
    g = _Grams(words)
    out = []
    for m in model:
        p = np.zeros((len(g.end), len(m["unknown"])))
        rest = np.arange(len(g.end))  # whose n-gram isn't found yet
        for n in range(ORDER, 0, -1):
            may = g.most[rest] >= n
            of = rest[may]
            at, ok = _found(m["gram"], g.hashes(n, of))
            p[of[ok]] += m["logp"][at[ok]]
            missing = of[~ok]
            if n > 1:
                by, there = _found(m["ctx"], g.hashes(n - 1, missing, 1))
                p[missing[there]] += m["weight"][by[there]]
            else:
                p[missing] += m["unknown"]
            rest = np.concatenate([rest[~may], missing])
        out += [np.bincount(g.owner, column, len(words)) for column in p.T]
    return np.column_stack(out)


class Scorer:
    """Cross-entropies of texts; what stands between white space is scored once and kept, about CACHE stretches, then afresh."""

    def __init__(self, model: dict):
        self.langs, self.model = model["langs"], model["tables"]
        self.kept = S.Kept(CACHE, np.float64)

    def _learn(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        width = len(self.langs) + 1
        words = [_letters(s.decode()) for s in stretches]
        flat = [w for own in words for w in own]
        out = np.zeros((len(stretches), width))
        if flat:
            owner = np.repeat(np.arange(len(words)), [len(x) for x in words])
            values = np.column_stack([word_scores(self.model, flat), [len(w) + 1 for w in flat]])
            for k in range(width):
                out[:, k] = np.bincount(owner, values[:, k], len(stretches))
        return out.ravel(), np.full(len(stretches), width)

    def stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each stretch the log-probability under each model and the number of characters predicted; stretches before each text and the last one's end."""
        different, which, before = S.stretched(texts, S.at_blanks)
        numbers = self.kept.numbers(different, self._learn)[which]
        return self.kept.flat[: self.kept.used].reshape(-1, len(self.langs) + 1)[numbers], before

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text under each model, and the number of characters predicted (0: nothing to predict)."""
        values, before = self.stretches(texts)
        sums = np.zeros((len(texts), len(self.langs) + 1))
        some = before[1:] > before[:-1]
        if some.any():
            sums[some] = np.add.reduceat(values, before[:-1][some], axis=0)
        n = sums[:, -1]
        return -sums[:, :-1] / np.maximum(n, 1)[:, None], n


def length_class(n: np.ndarray) -> np.ndarray:
    """Which of the LENGTHS a text of n predicted characters is read by: the longest that isn't longer."""
    return np.maximum(np.searchsorted(LENGTHS, n, side="right") - 1, 0)


def excerpts(values: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length class the cross-entropies, under model k, of the excerpts of that length that a text falls into. values: of its stretches."""
    ends = np.cumsum(values[:, -1])
    for c, length in enumerate(LENGTHS):
        if len(ends) and ends[-1] >= length:
            part = ((ends - values[:, -1]) // length).astype(np.int64)
            n = np.bincount(part, values[:, -1])
            yield c, (-np.bincount(part, values[:, k]) / np.maximum(n, 1))[n >= 0.75 * length]


def calibrated_temperature(truth: np.ndarray, ce: np.ndarray) -> float:
    best, temperature = np.inf, 8.0
    for t in 2.0 ** np.arange(0, 8):
        z = -t * ce
        loss = (np.logaddexp.reduce(z, axis=1) - z[np.arange(len(z)), truth]).mean() if len(z) else np.inf
        if loss < best - 1e-9:
            best, temperature = loss, float(t)
    return temperature


def limits(langs: list[str], rows: list[tuple[str, int, int, int]]) -> np.ndarray:
    """For each language and length class the cross-entropy above which a text is rejected. rows: language, class, cross-entropy in steps of STEP, excerpts.

    In each class, excerpts' distances from their language's mean are put in units of its deviation; their (1 - REJECT) quantile over all languages, times
    MARGIN, is the limit. A class without excerpts has the limit of the next shorter one that has some, none: no limit."""
    count: dict[tuple[str, int], Counter] = {}
    for lang, c, step, n in rows:
        count.setdefault((lang, c), Counter())[step] += n
    out = np.full((len(langs), len(LENGTHS)), np.inf)
    for c in range(len(LENGTHS)):
        about, distances, weights = {}, [], []
        for k, lang in enumerate(langs):
            if own := count.get((lang, c)):
                x, n = np.array(list(own)) * STEP, np.array(list(own.values()), np.float64)
                mean = (x * n).sum() / n.sum()
                about[k] = (mean, max(float(np.sqrt((n * (x - mean) ** 2).sum() / n.sum())), LEAST_DEVIATION))
                distances.append((x - mean) / about[k][1])
                weights.append(n / n.sum())
        if about:
            d, w = np.concatenate(distances), np.concatenate(weights)
            order = np.argsort(d)
            reached = np.cumsum(w[order])
            z = d[order][np.searchsorted(reached, (1 - REJECT) * reached[-1])]
            for k, (mean, deviation) in about.items():
                out[k, c] = mean + MARGIN * max(z, 1.0) * deviation
        if c:
            out[:, c] = np.where(np.isinf(out[:, c]), out[:, c - 1], out[:, c])
    return out


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> dict:
    """docs: doc_id, text, lang, only those that may be learned from."""
    spark = docs.sparkSession
    docs = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row for each language
    nothing = {"langs": [], "tables": [], "temperature": 1.0, "limits": np.empty((0, len(LENGTHS))), "key": uuid.uuid4().hex}
    if not counts:
        return nothing
    limit = F.coalesce(*(F.when(F.col("lang") == k, F.lit(int(min(1.0, per_lang / n) * 2**62))) for k, n in counts.items()))
    sample = docs.withColumn("rank", F.xxhash64("doc_id", F.lit(2)).bitwiseAND(F.lit(2**62 - 1))).where(F.col("rank") <= limit)
    sample = S.written(sample.dropDuplicates(["lang", "text"]), "language-sample")  # of the sample, not of docs
    held = F.col("rank") % 5 == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = Counter((lang, w) for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in _letters(text))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in of], pa.string()), "word": pa.array([w for _, w in of], pa.string()), "n": pa.array(list(of.values()), pa.int64())})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for b in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words.setdefault(lang, Counter())[word] += n
        for lang, own in words.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "model": [pickle.dumps(fit_model(own))]})

    counted = sample.where(~held).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = counted.repartition(min(len(counts), S.partitions(spark)), "lang").mapInArrow(learn, "lang string, model binary").collect()
    if not rows:
        return nothing
    model = tables({r["lang"]: pickle.loads(r["model"]) for r in rows})
    shipped = spark.sparkContext.broadcast(model)
    langs = model["langs"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for b in batches:
            of: Counter[tuple] = Counter()
            values, before = scorer.stretches(b.column("text"))
            ce, n = scorer(b.column("text"))
            for i, lang in enumerate(b.column("lang").to_pylist()):
                if lang in langs and n[i] > 0:
                    of[lang, -1, i] = 1
                    for c, own in excerpts(values[before[i] : before[i + 1]], langs.index(lang)):
                        for step, times in zip(*np.unique(np.round(own / STEP).astype(np.int64), return_counts=True), strict=True):
                            of[lang, c, int(step)] += int(times)
            whole = [ce[step].tolist() if c < 0 else None for _, c, step in of]
            columns = zip(*of, strict=True) if of else [[]] * 3
            kinds = (pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns, kinds, strict=True)), pa.array(list(of.values()), pa.int64()), pa.array(whole, pa.list_(pa.float64()))], names=["lang", "class", "step", "n", "ce"])

    found = S.written(sample.where(held).select("lang", "text").mapInArrow(measure, "lang string, class int, step long, n long, ce array<double>"), "language-held-out")
    own = found.where("class < 0").collect()  # a row for each held-out text of the sample
    steps = found.where("class >= 0").groupBy("lang", "class", "step").agg(F.sum("n").alias("n")).collect()  # of a few hundred steps in each class
    truth = np.array([langs.index(r["lang"]) for r in own], np.int64)
    ce = np.array([r["ce"] for r in own]).reshape(len(own), len(langs))
    return model | {"temperature": calibrated_temperature(truth, ce), "limits": limits(langs, [(r["lang"], r["class"], r["step"], r["n"]) for r in steps]), "key": uuid.uuid4().hex}


def decide(model: dict, ce: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    langs = model["langs"]
    if not langs:
        return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n), bool)
    z = -model["temperature"] * ce
    p = np.exp(z.max(axis=1) - np.logaddexp.reduce(z, axis=1))
    best = ce.argmin(axis=1)
    some = n > 0
    low = ce[np.arange(len(best)), best] <= model["limits"][best, length_class(n)]
    return [langs[k] if s else "und" for k, s in zip(best, some, strict=True)], np.where(some, p, 0.0), some & low


def identify(docs: DataFrame, model: dict, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """docs with the language, the chance that it is right and whether it is accepted, in the columns ``out``; columns of these names are replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names, kept = docs.columns, [i for i, c in enumerate(docs.columns) if c.lower() not in {x.lower() for x in out}]
    key, at = model["key"], names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        scorer = S.held(("language", key), lambda: Scorer(m))
        for b in batches:
            for part in S.slices(b, at):
                lang, p, ok = decide(m, *scorer(part.column(at))) if m["langs"] else decide(m, np.empty((part.num_rows, 0)), np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(lang, pa.string()), pa.array(p), pa.array(ok)], names=[*(names[i] for i in kept), *out])

    added = [T.StructField(c, t) for c, t in zip(out, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    return docs.mapInArrow(run, T.StructType([*(docs.schema[i] for i in kept), *added]))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(S.remainder(F.col("doc_id"), 4) != 2)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    model = fit(learnable(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (S.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
