"""Toxic documents by weak supervision.

1. Voters. Each is one lexicon entry (a word, or the beginning of a word) or a pattern. Some lexicons are built in;
   the other entries are induced from a bounded sample of labelled rows by a greedy cover of its toxic texts.
2. Label model. Over all documents it counts how often each voter, and each pair of voters, fires in each language.
   In a language the voters' covariance is a rank-one matrix (given the class they are independent) and a sparse rest
   (pairs that are correlated beyond that); a robust fit separates the two, which gives each voter's rate in toxic and
   in clean texts and the correlated pairs. Labels enter in two places: the share of toxic rows is the class balance, and a voter's
   precision on the sample (shrunk: of built-in voters to PRECISION, of induced ones to the class balance) is where the fit begins and the
   most that a voter is trusted. It alone counts where fewer than three voters fire in a language, since their covariance can't tell them
   apart. Without labels a voter's precision is taken to be PRECISION.
3. Classifier. Documents of all rows, labelled or not, are drawn by hash on either side of the model's posterior, bounded by a parameter;
   their posteriors (never their labels) are the targets of a logistic regression on words and word beginnings.

Nulls and empty texts contain no word, so they get the classifier's bias alone, which is below the threshold.
Each row is judged for itself: ties, repeated rows and the frame's other columns (whatever their names) have no influence. Very long texts
are read whole, in time that grows with their length. An empty table gives an empty result, and a model that rejects nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common, textops

PREFIXES = (4, 5, 6)
#: Labelled rows of each class that voters are induced from, at most; rows on each side of the posterior that the classifier is fitted on.
SAMPLE_PER_CLASS, TRAINING = 1500, 2000
#: Languages that have a label model of their own, the most frequent ones; the others share one. A voter's precision without labels.
LANGUAGES, PRECISION = 64, 0.9
#: Rows that a voter's precision on the sample is shrunk with; standard errors that a fitted rate is lowered by.
PRIOR_ROWS, CAUTION = 2, 2.0
#: Most voters that are induced; how often each toxic row of the sample is to be covered.
INDUCED, COVERS = 96, 4
#: Evidence that an induced entry needs; documents of the training rows that a feature of the classifier stands in at least, and its evidence.
EVIDENCE, LEAST_DOCS, FEATURE_EVIDENCE = 12.0, 3, 8.0
DIMS = 1 << 18
THRESHOLD = 0.5

LEXICONS = {
    "insult_en": "idiot moron imbecile stupid dumb scum trash garbage loser clown pathetic worthless disgusting filthy vermin scumbag bastard bitch asshole fuck fucking shit dickhead retard whore slut cunt",
    "insult_de": "arschloch scheiße idiot dummkopf trottel vollidiot schlampe hurensohn missgeburt abschaum wichser fotze drecksau",
    "insult_fr": "connard connasse salope putain merde abruti crétin débile enculé ordure pourriture imbécile",
    "insult_es": "gilipollas cabrón puta mierda idiota imbécil estúpido pendejo maricón escoria basura hijoputa",
    "threat_en": "kill murder exterminate hang strangle rape lynch behead",
}
_MARKS, _CAPITALS = re.compile("!!+"), re.compile(r"[A-ZÄÖÜÉÈÊÇÑÁÍÓÚ]{4}[^\n]{0,40}\Z")
_YOU = re.compile(r"\b(?:you|you're|ur|du|tu|vous|eres)\s+(?:are\s+|bist\s+|es\s+|êtes\s+|un[ae]?\s+|an?\s+|such\s+)*(?:idiot|moron|stupid|scum|trash|loser|clown|pathetic|worthless|disgusting|dumm|débile|idiota)", re.I)


def shouts(text: str) -> bool:
    """Four capitals or more, and within 40 characters of the line two exclamation marks. What is before the marks is looked at, so the time is linear."""
    return any(_CAPITALS.search(text, max(0, m.start() - 44), m.start()) for m in _MARKS.finditer(text))


PATTERNS = {"shouting": shouts, "addressed": lambda text: _YOU.search(text) is not None}


def _pairs(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, by document."""
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[first], d[first]


def induce(docs: list[np.ndarray], toxic: np.ndarray, most: int = INDUCED, covers: int = COVERS) -> np.ndarray:
    """Hashes of the words and beginnings that a greedy multiple cover of the toxic rows picks.

    An entry must be twenty times as frequent in toxic rows as in the others, on evidence (twice the log-likelihood ratio) that chance
    doesn't give to one of very many entries.
    """
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    if not toxic.any():
        return np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    h = np.concatenate(docs)
    values, inverse = np.unique(h, return_inverse=True)
    in1 = np.bincount(inverse, toxic[row], len(values))
    in0 = np.bincount(inverse, ~toxic[row], len(values))
    share = n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * (in1 * np.log(in1 / ((in1 + in0) * share)) + np.where(in0 > 0, in0 * np.log(in0 / ((in1 + in0) * (1 - share))), 0))
    good = (in1 >= 3) & (in1 / n1 > 20 * (in0 + 0.1) / n0) & (evidence > EVIDENCE)
    keep = np.flatnonzero(good[inverse] & toxic[row])
    lists: dict[int, np.ndarray] = {}
    by = np.argsort(inverse[keep], kind="stable")
    which, where = inverse[keep][by], row[keep][by]
    cuts = np.flatnonzero(np.diff(which)) + 1
    for v, rows in zip(which[np.concatenate(([0], cuts))] if len(which) else [], np.split(where, cuts) if len(which) else []):
        lists[int(v)] = rows
    need = np.full(len(docs), covers)
    chosen: list[int] = []
    while lists and len(chosen) < most:
        gain = {v: int((need[r] > 0).sum()) for v, r in lists.items()}
        best = max(gain, key=lambda v: (gain[v], -in0[v], -v))
        if gain[best] < 3:
            break
        need[lists.pop(best)] -= 1
        chosen.append(best)
        lists = {v: r for v, r in lists.items() if gain[v] >= 3}
    return values[chosen]


class Voters:
    """The voters and their votes: a voter votes "toxic" where it fires and abstains elsewhere."""

    def __init__(self, induced: np.ndarray):
        built_in = [[textops.word_hash(w) for w in words.split()] for words in LEXICONS.values()]
        owner = [i for i, words in enumerate(built_in) for _ in words] + [len(built_in) + i for i in range(len(induced))]
        hashes = np.array([h for words in built_in for h in words] + [int(x) for x in induced], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], np.array(owner, np.int64)[order]
        self.n = len(built_in) + len(induced) + len(PATTERNS)
        self.induced = (np.arange(self.n) >= len(built_in)) & (np.arange(self.n) < len(built_in) + len(induced))

    @staticmethod
    def patterns(text: str | None) -> list[int]:
        """Numbers of the patterns that a text has."""
        return [k for k, p in enumerate(PATTERNS.values()) if text and p(text)]

    def fired(self, patterns: list[list[int]], hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, voter) pairs that fire."""
        found = [np.zeros(0, np.int64)]
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[at] == hashes)
        at, d = at[hit], docs[hit]
        while len(at):  # an entry can stand in several lexicons
            found.append(d * self.n + self.owner[at])
            more = np.flatnonzero((at + 1 < len(self.hashes)) & (self.hashes[np.minimum(at + 1, len(self.hashes) - 1)] == self.hashes[at]))
            at, d = at[more] + 1, d[more]
        found.append(np.array([i * self.n + self.n - len(PATTERNS) + k for i, ks in enumerate(patterns) for k in ks], np.int64))
        keys = np.unique(np.concatenate(found))
        return keys // self.n, keys % self.n


def label_model(n: float, single: np.ndarray, pair: np.ndarray, prior: float, precision: np.ndarray) -> dict[str, np.ndarray]:
    """Rates of each voter in toxic and in clean texts, and its weight for correlations, from the counts.

    ``precision``: what a voter's precision is at most; it is taken to be this in a language in which fewer than three voters
    fire (there the covariance can't tell them apart).
    """
    p = single / max(n, 1)
    active = np.flatnonzero(single >= 3)
    u, weight = np.zeros(len(p)), np.ones(len(p))
    scale = np.sqrt(prior * (1 - prior))
    delta = np.clip((precision * p / prior - (1 - precision) * p / (1 - prior)), 0, 1)
    if len(active) >= 3:
        c = pair[np.ix_(active, active)] / n - np.outer(p[active], p[active])
        np.fill_diagonal(c, 0)
        sd = np.sqrt(np.outer(p[active] * (1 - p[active]), p[active] * (1 - p[active])) / n) + 1e-12
        used = ~np.eye(len(active), dtype=bool)
        x = np.maximum(delta[active] * scale, 1e-9)
        for _ in range(40):
            for _ in range(15):
                x = 0.5 * x + 0.5 * np.maximum((used * c) @ x / np.maximum(used @ (x * x), 1e-18), 0)
            rest = np.abs(c - np.outer(x, x)) / sd
            cut = max(4.0, float(np.quantile(rest[used], 0.9)) if used.any() else 4.0)
            after = ~np.eye(len(active), dtype=bool) & (rest <= cut)
            if (after == used).all():
                break
            used = after
        u[active] = x
        error = np.sqrt((used * sd**2) @ (x * x)) / np.maximum(used @ (x * x), 1e-18)
        sure = np.clip((x - CAUTION * error) / scale, 0, 1)  # rare voters count for what is certain
        delta[active] = np.minimum(sure, delta[active])  # rare words are correlated by texts' lengths too
        # a voter that is correlated with k others beyond the class shares its weight with them
        s = np.sqrt(p[active] * (1 - p[active])) + 1e-12
        rho = np.clip((c - np.outer(x, x)) / np.outer(s, s), 0, 1) * (rest > 4)
        np.fill_diagonal(rho, 0)
        weight[active] = 1 / (1 + rho.sum(1))
    alpha = np.clip(p + (1 - prior) * delta, 1e-4, 0.999)
    beta = np.clip(p - prior * delta, 0.3 / max(n, 1) / (1 - prior), None)
    beta = np.minimum(beta, alpha)
    return {"fire": weight * np.log(alpha / beta), "abstain": weight * np.log((1 - alpha) / (1 - beta)), "alpha": alpha, "beta": beta, "prior": np.array(prior)}


def posterior(model: dict[str, np.ndarray], fires: np.ndarray) -> np.ndarray:
    """P(toxic) of each row of a matrix of votes."""
    prior = float(model["prior"])
    z = np.log(prior / (1 - prior)) + fires @ model["fire"] + (1 - fires) @ model["abstain"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: list[np.ndarray], target: np.ndarray, l2: float = 0.02) -> np.ndarray:
    """Weights by hash bucket, the bias last, of a logistic regression on which words and beginnings stand in a row."""
    weights = np.zeros(DIMS + 1, np.float32)
    weights[-1] = -4.0
    if not len(docs) or target.max(initial=0) < 0.5:
        return weights
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    key = np.unique(row * DIMS + (np.concatenate(docs) & np.uint64(DIMS - 1)).astype(np.int64))
    row, b = key // DIMS, key % DIMS
    n, n1 = len(docs), target.sum()
    df, d1 = np.bincount(b, minlength=DIMS), np.bincount(b, target[row], DIMS)
    e1 = df * n1 / n
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(d1 > 0, d1 * np.log(d1 / e1), 0) + np.where(df - d1 > 1e-9, (df - d1) * np.log(np.maximum(df - d1, 1e-9) / (df - e1)), 0))
    chosen = np.flatnonzero((df >= LEAST_DOCS) & (g2 > FEATURE_EVIDENCE))
    place = np.full(DIMS, -1)
    place[chosen] = np.arange(len(chosen))
    j = place[b]
    r, j = row[j >= 0], j[j >= 0]
    balance = np.where(target > 0.5, 0.5 / max(1e-9, (target > 0.5).mean()), 0.5 / max(1e-9, (target <= 0.5).mean()))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = x[-1] + np.bincount(r, x[j], n)
        q = 1 / (1 + np.exp(-z))
        f = float((balance * (np.logaddexp(0, z) - target * z)).sum() / n + l2 / 200 * (x[:-1] @ x[:-1]))
        g = balance * (q - target) / n
        return f, np.concatenate((np.bincount(j, g[r], len(chosen)) + l2 / 100 * x[:-1], [g.sum()]))

    x = common.minimise(loss, np.zeros(len(chosen) + 1), 200)
    weights[chosen], weights[-1] = x[:-1], min(x[-1], -0.7)
    return weights


def _drawn(slim: DataFrame, some: DataFrame, columns: list[str]) -> tuple[list[np.ndarray], pa.Table]:
    """Word hashes of the rows of ``slim`` whose key is drawn, and the columns and patterns; equal texts once, by key. ``some`` is of bounded size."""

    def features(texts: list) -> dict:
        h, d = _pairs(*textops.word_features(texts, PREFIXES))
        cut = np.searchsorted(d, np.arange(len(texts) + 1))
        return {"h": [h[cut[i] : cut[i + 1]].tobytes() for i in range(len(texts))], "patterns": [Voters.patterns(t) for t in texts]}

    rows = slim.join(F.broadcast(some), "k").withColumn("m", F.md5("t"))
    rows = rows.withColumn("nth", F.expr("row_number() over (partition by m order by k)")).where("nth = 1").drop("nth")  # a bounded number of rows
    table = rows.select("k", *columns, common.text_udf("h binary, patterns array<int>", features)("t").alias("x")).select("k", *columns, "x.*").toArrow().sort_by("k")
    return [np.frombuffer(h.as_buffer(), np.uint64) for h in table.column("h")], table.drop_columns("h")


def fit(docs: DataFrame, labels: DataFrame | None, text: str = "text", key: str = "doc_id", lang: str = "lang", sample: int = SAMPLE_PER_CLASS, training: int = TRAINING) -> dict:
    """The voters, the label model of each language and the classifier. ``sample`` bounds the labelled rows of a class, ``training`` the rows on a side of the posterior."""
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("l"))
    feats, gold, fired, share = [], np.zeros(0, bool), [], 0.1
    if labels is not None:
        known = labels.where(F.col("toxic").isin(0, 1)).select(F.col(key).alias("k"), F.col("toxic").cast("int").alias("y")).distinct()
        feats, rest = _drawn(slim, common.sample_rows(known, "k", sample, "y"), ["y"])
        gold, fired = rest.column("y").to_numpy() == 1, rest.column("patterns").to_pylist()
        g = known.agg(F.avg("y").alias("m"), F.count("*").alias("n")).first()
        share = ((g.m or 0) * g.n + 1) / (g.n + 10)
    voters = Voters(induce(feats, gold))
    v = voters.n

    def vote(patterns: list[list[int]], feats: list[np.ndarray]) -> np.ndarray:
        fires = np.zeros((len(feats), v))
        for i, h in enumerate(feats):
            fires[i, voters.fired([patterns[i]], h, np.zeros(len(h), np.int64))[1]] = 1
        return fires

    precision = np.full(v, PRECISION)
    if len(feats):
        fires = vote(fired, feats)
        shrunk = np.where(voters.induced, min(max(share, 0.005), 0.5), PRECISION)  # the sample is what chose the induced ones
        precision = (fires[gold].sum(0) + PRIOR_ROWS * shrunk) / (fires.sum(0) + PRIOR_ROWS)
    del feats

    def votes(texts: list) -> dict:
        d, w = voters.fired([Voters.patterns(t) for t in texts], *textops.word_features(texts, PREFIXES))
        cut = np.searchsorted(d, np.arange(len(texts) + 1))
        return {"v": [w[cut[i] : cut[i + 1]].tolist() for i in range(len(texts))]}

    # the votes of every document; counts of voters and of pairs: languages x voters^2 rows come back at most
    voted = common.stored(slim.select("k", "l", common.text_udf("v array<int>", votes)("t")["v"].alias("v")), "votes")
    own = [r.l for r in voted.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()]
    group = F.when(F.col("l").isin(own), F.col("l")).otherwise(F.lit("")).alias("l")
    both = F.transform("v", lambda a: F.transform("v", lambda b: F.struct(a.alias("a"), b.alias("b"))))
    counted = voted.select(group, F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))), F.flatten(both))).alias("x")).groupBy("l", "x.a", "x.b").count().collect()
    single: dict[str, np.ndarray] = {r.l: np.zeros(v) for r in counted}
    pair: dict[str, np.ndarray] = {l: np.zeros((v, v)) for l in single}
    total: dict[str, float] = {}
    for r in counted:
        if r.a < 0:
            total[r.l] = r["count"]
        elif r.a == r.b:
            single[r.l][r.a] = r["count"]
        else:
            pair[r.l][r.a, r.b] = r["count"]
    models = {l: label_model(n, single[l], pair[l], min(max(share, 0.005), 0.5), precision) for l, n in total.items()}
    none = np.zeros(v)
    base = {l: float(posterior(m, none)) for l, m in models.items()}

    def judge(l: pa.Array, vs: pa.Array) -> pa.Array:
        out = []
        for name, hit in zip(l.to_pylist(), vs.to_pylist()):
            if hit:
                fires = none.copy()
                fires[hit] = 1
                out.append(float(posterior(models[name], fires)))
            else:
                out.append(base[name])
        return pa.array(out, pa.float64())

    judge.__annotations__ = {"l": pa.Array, "vs": pa.Array, "return": pa.Array}
    judged = voted.select("k", group, "v").select("k", F.arrow_udf(judge, "double")("l", "v").alias("p")).withColumn("side", F.col("p") >= 0.5)
    drawn = common.sample_rows(judged, "k", training, "side").groupBy("k").agg(F.max("p").alias("p"))
    feats, rest = _drawn(slim, drawn, ["p"])
    common.discard(voted)
    weights = train(feats, rest.column("p").to_numpy())
    feats = rest = counted = fired = None
    textops.tidy()  # the driver has little memory beside its JVM
    return {"voters": voters, "models": models, "weights": weights, "precision": precision}


def scorer(weights: np.ndarray):
    """Column function text -> P(toxic)."""
    on = weights[:-1] != 0

    def work(texts: list) -> pa.Array:
        h, d = textops.word_features(texts, PREFIXES)
        b = (h & np.uint64(DIMS - 1)).astype(np.int64)
        hit = np.flatnonzero(on[b])
        key = np.unique(d[hit] * DIMS + b[hit])
        z = np.bincount(key // DIMS, weights[key % DIMS], len(texts)) + weights[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())

    return common.text_udf("double", work)


def toxicity(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_toxic, toxic) of every row of ``docs``. Without rows in ``labels`` the built-in lexicons alone vote."""
    p = scorer(fit(docs, labels)["weights"])(F.col("text").cast("string"))
    return docs.select("doc_id", p.alias("p_toxic")).select("doc_id", "p_toxic", (F.col("p_toxic") >= threshold).alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    return docs.where(scorer(fit(docs, labels)["weights"])(F.col("text").cast("string")) < threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
