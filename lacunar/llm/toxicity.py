"""Toxicity scores by weak supervision.

1. Terms, words and word beginnings, that stand out in documents marked toxic are mined from a bounded sample of
   labelled rows, and dealt out, with a seed lexicon, over many voters: lexicons, beginnings, and density patterns. A
   voter fires on a document or abstains.
2. A generative label model learns from all documents, without labels, how good the voters are: given the class, voters
   are independent but for a few pairs, so the covariances of their votes are of rank one outside those pairs. The
   factor gives each voter's firing rates in both classes, the pairs that stick out are its correlations, and a voter
   with correlated partners counts for less.
3. A linear classifier over the terms is trained in numpy on the model's posterior labels and scores every document.

The texts are read once. What they leave, a short list of term numbers and a word of vote bits per document, feeds the
statistics and the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, row_of, short_batches, store

#: Seed lexicon of the first voter: common insults in four languages. Fixed values.
SEEDS = (
    "asshole bastard bitch clown crap cretin disgusting dumb filthy fool garbage idiot imbecile jerk loser moron pathetic "
    "scum shit stupid trash vermin worthless "
    "abschaum arschloch depp dreck idiotin trottel wertlos widerlich "
    "abruti connard crétin débile imbécile merde minable ordure salaud "
    "asqueroso basura cabrón estúpido gilipollas idiota imbécil inútil mierda"
).split()
BEGINNINGS = (4, 5, 6)
WORDS = regex.compile(r"[\p{L}\p{N}]+")


def mine_terms(docs: DataFrame, labels: DataFrame, rows: int, most: int, seed: int, false_share: float = 0.05) -> tuple[list[str], float]:
    """Terms over-represented in toxic documents, best first, and the share of toxic rows. A word is written w:..., a
    beginning of k letters k:.... Learns from at most `rows` labelled rows that are not held out, chosen by hash. Of
    several labels of one document the majority counts, 1 if they tie.

    The limits below (5 documents, 5 standard errors, a log ratio of 2.5, 5 % and 1 % clean documents) are the best of
    thirteen settings by five folds over the rows of the sample tables that are not held out; see the README."""
    marked = labels.select(F.col("doc_id").alias("k"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1)").where(~held_out(F.col("k")))
    marked = marked.groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    n = marked.count()
    if not n:
        return [], 0.0
    marked = marked.where(F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(n)) < rows).orderBy(F.xxhash64(F.lit(seed), "k"), "k").limit(rows)
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    begin = lambda k: F.array_distinct(F.transform(F.filter("w", lambda w: F.char_length(w) > k), lambda w: F.concat(F.lit(f"{k}:"), F.substring(w, 1, k))))
    found = docs.join(marked, docs["doc_id"] == marked["k"]).select("k", "y", words.alias("all"))
    # copies and near copies are no evidence of their own: of documents with the same min-hash of word triples one counts
    triple = lambda x, i: F.xxhash64(x, F.get("all", i + 1), F.get("all", i + 2))
    copies = found.withColumn("m", F.array_min(F.transform("all", triple))).groupBy("m", "y")
    found = copies.agg(F.min_by("all", F.struct("k", F.xxhash64("all"))).alias("all")).select("y", F.array_distinct("all").alias("w"))
    total = found.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).first()
    if not total["n"] or not total["t"] or total["t"] == total["n"]:
        return [], (total["t"] or 0) / max(1, total["n"])
    t1, t0 = total["t"], total["n"] - total["t"]
    terms = found.select("y", F.explode(F.concat(F.transform("w", lambda w: F.concat(F.lit("w:"), w)), *(begin(k) for k in BEGINNINGS))).alias("term"))
    seen = cut(terms.groupBy("term").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).where("n >= 3"))
    # a term of n documents is all toxic by chance with probability share ** n; the least n is one where that explains few of those seen
    share = t1 / (t1 + t0)
    by_n = {r["n"]: r for r in seen.where("n <= 16").groupBy("n").agg(F.count(F.lit(1)).alias("all"), F.sum((F.col("a") == F.col("n")).cast("long")).alias("pure")).collect()}
    least = next((n for n in range(16, 2, -1) if n in by_n and 2 * by_n[n]["all"] * share**n > max(0.5, false_share * by_n[n]["pure"])), 2) + 1
    least = max(least, 5)
    p1, p0 = F.col("a") / t1, (F.col("n") - F.col("a") + 0.5) / (t0 + 1)
    pooled = F.col("n") / (t1 + t0)
    z = (F.col("a") / t1 - (F.col("n") - F.col("a")) / t0) / F.sqrt(pooled * (1 - pooled) * (1 / t1 + 1 / t0))
    # a beginning stands for words never seen, so hardly any clean document may hold it
    pure = F.col("n") - F.col("a") <= F.col("n") * F.when(F.col("term").startswith("w:"), F.lit(0.05)).otherwise(F.lit(0.01))
    best = seen.where(pure & (F.col("n") >= least) & (F.log(p1 / p0) > 2.5) & (z > 5.0)).select("term", z.alias("z")).orderBy(F.col("z").desc(), "term").limit(most).collect()
    return [r["term"] for r in best], t1 / (t1 + t0)


class Voters:
    """Which terms a text holds, and the votes they cast: bit j is voter j."""

    def __init__(self, terms: list[str], lexicons: int, patterns: int):
        self.terms = [*terms, *(f"w:{s}" for s in SEEDS if f"w:{s}" not in set(terms))]
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.mined = len(terms)
        words = [i for i in range(self.mined) if terms[i][0] == "w"]
        starts = [i for i in range(self.mined) if terms[i][0] != "w"]
        self.votes_of = np.zeros(len(self.terms), np.int64)
        for k, i in enumerate(words):
            self.votes_of[i] |= 1 << (1 + k % lexicons)
        for k, i in enumerate(starts):
            self.votes_of[i] |= 1 << (1 + lexicons + k % patterns)
        for s in SEEDS:
            self.votes_of[self.number[f"w:{s}"]] |= 1
        self.n = 1 + lexicons + patterns + 3
        self.words = {t[2:] for t in self.terms if t[0] == "w"}
        self.starts = {k: {t[2:] for t in self.terms if t[0] == str(k)} for k in BEGINNINGS}

    def hits(self, text: str | None) -> tuple[list[int], int]:
        words = set(WORDS.findall((text or "").lower()))
        out = [self.number[f"w:{w}"] for w in words & self.words]
        for k, known in self.starts.items():
            if known:
                out += [self.number[f"{k}:{w}"] for w in {w[:k] for w in words if len(w) > k} & known]
        votes = 0
        for i in out:
            votes |= int(self.votes_of[i])
        for j, least in enumerate((2, 4)):  # density patterns: several terms at once
            if len(out) >= least:
                votes |= 1 << (self.n - 3 + j)
        if out and len(out) * 50 >= len(words):
            votes |= 1 << (self.n - 1)
        return sorted(out), votes


def read_votes(docs: DataFrame, voters: Voters, text_col: str) -> DataFrame:
    """(row, hits array<int>, votes bigint) of every whole text; `row` holds the columns of `docs`."""
    at, rows = docs.columns.index(text_col), docs.select(row_of(docs))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):  # the texts go back too: a little at a time
                b = whole.slice(begin, 512)
                got = [voters.hits(t.as_py()) for t in b.column(0).field(at)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.int64())], ["row", "hits", "votes"])

    return rows.mapInArrow(each, f"row {rows.dtypes[0][1]}, hits array<int>, votes bigint")


def vote_moments(votes: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Number of documents, and how often each pair of voters fires together, over all of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((n, n)), 0
        for b in batches:
            v = b.column(0).to_numpy()
            v, times = np.unique(v, return_counts=True)
            bits = (v[:, None] >> np.arange(n) & 1).astype(float)
            total += bits.T @ (bits * times[:, None])
            rows += int(times.sum())
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*i, -1], pa.int32()), pa.array([*j, -1], pa.int32()), pa.array([*total[i, j], float(rows)])], ["i", "j", "c"])

    out, rows = np.zeros((n, n)), 0
    for r in votes.select("votes").mapInArrow(each, "i int, j int, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).collect():  # n squared at most
        if r["i"] < 0:
            rows = int(r["c"])
        else:
            out[r["i"], r["j"]] = r["c"]
    return rows, out


class LabelModel:
    """Firing rates of each voter in toxic and clean documents, and its weight given its correlations."""

    def __init__(self, rows: int, together: np.ndarray, prior: float, stick_out: float = 3.0):
        n = len(together)
        self.prior = prior = min(max(prior, 1e-3), 0.5)
        mean = np.diag(together) / max(rows, 1)
        cov = together / max(rows, 1) - np.outer(mean, mean)
        off = ~np.eye(n, dtype=bool)
        use, u = off, np.sqrt(np.maximum(np.diag(cov), 0) * 0.5)
        chance = 4 * np.sqrt(np.outer(np.diag(cov), np.diag(cov)) / max(rows, 1))  # what sampling alone may leave
        for _ in range(4):  # fit the factor, set aside the pairs that stick out, fit again
            for _ in range(100):
                for i in range(n):  # one at a time: all at once would swing between scales
                    weight = use[i] @ u**2
                    if weight > 1e-12:
                        u[i] = max((use[i] * cov[i]) @ u / weight, 0.0)
            left = cov - np.outer(u, u)
            spread = np.median(np.abs(left[off])) * 1.4826 if n > 1 else 0.0
            odd = np.abs(left) > np.maximum(stick_out * spread, chance)
            use = off & ~odd
            use[use.sum(1) < 2] |= off[use.sum(1) < 2]
            use = use & use.T | use & ~odd
        scale = u / np.sqrt(prior * (1 - prior))
        self.toxic = np.clip(mean + (1 - prior) * scale, 1e-4, 0.999)
        self.clean = np.clip(mean - prior * scale, 1e-4, 0.999)
        self.correlated = off & odd & (left > 0)
        self.weight = 1 / np.sqrt(1 + self.correlated.sum(1))
        self.gain = np.where((mean > 0) & (self.toxic > self.clean), self.weight * np.log(self.toxic / self.clean), 0.0)
        # nobody fires: the evidence of the voters together, tempered as theirs is
        self.silence = float((self.weight * np.log((1 - self.toxic) / (1 - self.clean)))[mean > 0].sum())

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        bits = (votes[:, None] >> np.arange(len(self.gain)) & 1).astype(float)
        z = log(self.prior / (1 - self.prior)) + np.where(votes == 0, min(self.silence, -2.0), bits @ self.gain)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_linear(hits: list[list[int]], y: np.ndarray, n: int, share: np.ndarray | None = None, rounds: int = 600, rate: float = 0.1, l2: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights of the terms and bias of a logistic regression on soft labels (full batches, Adam). share: how many
    documents each row stands for."""
    share = np.full(len(y), 1 / max(1, len(y))) if share is None else share / share.sum()
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    cols = np.array([c for h in hits for c in h], int)
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(rows, w[cols], minlength=len(hits))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g = np.r_[np.bincount(cols, d[rows], minlength=n) + l2 * w, d.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:n], b - step[n]
    return w, float(b)


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, keep: bool, rows: int = 12_000, terms: int = 1024, lexicons: int = 24, patterns: int = 16, threshold: float = 0.3, seed: int = 5) -> DataFrame:
    """(row, score, predicted, posterior). `row` is the document's row, or without `keep` its id alone."""
    short_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    mined, prior = mine_terms(text, labels, rows, terms, seed)
    voters = Voters(mined, lexicons, patterns)
    votes = read_votes(docs if keep else docs.select(id_col, text_col), voters, text_col)
    id_ = F.col("row")[id_col]
    read = store(votes if keep else votes.select(F.struct(id_.alias(id_col)).alias("row"), "hits", "votes"), "votes")
    n, together = vote_moments(read, voters.n)
    model = LabelModel(n, together, prior or 0.1)
    free = read.select(id_.alias("id"), "hits", "votes").where(~held_out(F.col("id")))
    size = free.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("votes") != 0).cast("int")).alias("v")).first()
    h = F.xxhash64(F.lit(seed + 1), "id")
    # fired and silent documents in halves, each weighted by what it stands for
    weights, bias = np.zeros(len(voters.terms)), log(model.prior / (1 - model.prior))
    if size["n"]:
        half = lambda q, k: free.where(q).where(F.pmod(h, F.lit(max(1, k))) < rows // 2).orderBy(h, "id", "votes").limit(rows // 2).select("hits", "votes").collect()
        fired = half("votes <> 0", size["v"])
        silent = half("votes = 0", size["n"] - size["v"])
        some = fired + silent
        y = model.posterior(np.array([r["votes"] for r in some], np.int64))
        stands = lambda part, n: np.full(len(part), n / max(1, len(part)))
        share = np.r_[stands(fired, size["v"]), stands(silent, size["n"] - size["v"])]
        weights, bias = train_linear([r["hits"] for r in some], y, len(voters.terms), share)
    known = F.array(*(F.lit(float(w)) for w in weights)) if len(weights) else F.array().cast("array<double>")
    z = F.aggregate("hits", F.lit(bias), lambda a, i: a + F.get(known, i))
    s = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    gain = F.array(*(F.lit(float(g)) for g in model.gain))
    lp = F.lit(log(model.prior / (1 - model.prior))) + F.when(F.col("votes") == 0, F.lit(min(model.silence, -2.0))).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(voters.n - 1)), F.lit(0.0), lambda a, j: a + F.when(F.getbit("votes", j) == 1, F.get(gain, j)).otherwise(F.lit(0.0))))
    out = read.select("row", s.alias("score"), (1 / (1 + F.exp(-lp))).alias("posterior"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, score double, predicted int, posterior double) of every whole text.

    Labels come from `labels` (doc_id, toxic), held-out rows aside, `rows` (12,000) of them at most; the classifier is
    fitted on at most as many documents. Null and empty texts hold no term and get the score of such texts. Without labels
    only the seed lexicon votes, at an assumed prior of 0.1. Repeated rows and null ids come back as they are. Of `docs`
    only the id and the text are read, so other columns can't clash."""
    return _scored(docs, labels, id_col, text_col, False, **options).select(F.col("row")[id_col].alias(id_col), "score", "predicted", "posterior")


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are not predicted toxic. They travel with their votes, so nothing is joined or shuffled."""
    kept = _scored(docs, labels, id_col, text_col, True, **options).where("predicted = 0")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
