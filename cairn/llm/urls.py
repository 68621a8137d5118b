"""URL filter: host words by unigram Viterbi, then multinomial naive Bayes over host and path tokens.

Words and their frequencies: a built-in list of words that are common in host names, and the hosts' own labels counted over
all distinct hosts. Path words aren't counted there: paths are split at what isn't a letter. A label that others are concatenated from
is found by its frequency; Viterbi takes the split of least cost, a word costs minus the logarithm of its probability, an unknown stretch
a fixed cost and more for each letter. All counted labels are words, however many there are: each label is joined with the counts of its
substrings.

Naive Bayes is fitted on all rows of the table by expectation and maximisation: seed words of unwanted and of ordinary hosts give the first
model; it says how likely each row is unwanted; the rows' other tokens, counted with these probabilities, and the seeds make the next
model. Counts from rows are scaled, for each class, to the mass of its seeds (or to less if the table has fewer tokens than the seeds
count), so a large table and many copies of it give the same model. Counts of rows are kept by hash bucket, so the model's size is fixed.
Tokens that stand in rows of both kinds alike decide nothing.

Null, empty and malformed URLs have no host: null words and score, not blocked, and no part in the fit. Equal URLs get equal results, and
repeated rows count repeatedly; hosts are compared in lower case without port, user and leading "www". Queries and fragments of URLs
aren't read. Very long URLs are read whole, in time that grows with their length. An empty table gives an empty result. Other columns aren't
read, whatever they are called. Each distinct label is segmented once; of equal costs the one with the longer last word is taken.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common

#: A URL is blocked from this probability on.
THRESHOLD = 0.7
#: How many observations a seed word stands for.
SEED_WEIGHT = 10
#: Share of unwanted rows; smoothing; rounds of the fit; hash buckets of the rows' counts.
PRIOR, SMOOTH, ROUNDS, DIMS = 0.1, 0.5, 2, 1 << 18
#: Cost of an unknown stretch, and of each of its letters, in nats; longest word.
UNKNOWN, LETTER, LONGEST = 9.0, 2.2, 24

SEEDS = {
    "bad": """casino win jackpot slots poker roulette blackjack bets bet betting bookmaker gamble gambling lottery bingo free bets casino bonus
        spins adult xxx porn sex sexy nude naked cams escort hot girls milf tube fetish hentai adult dating hookup
        cheap pills viagra cialis pharmacy meds drugs steroids weight loss diet pills cheap rx online pharmacy
        spam farm link farm seo backlinks click bait clickbait ads track ad tracker tracking adserver popup banner ads doubleclick affiliate
        malware phishing virus crack warez torrent pirate keygen serial hack hacks cheats
        payday loan loans quick cash fast money make money easy money get rich crypto doubler replica watches fake rolex
        spam mail bulk mail free gift free iphone winner prize sweepstakes""",
    "good": """news school university library museum research science journal paper docs wiki community support help
        city county government health hospital clinic bank finance weather travel hotel food recipe garden home house family kids
        music film book books art photo video game sport football tennis running bike car auto tech software code developer cloud data
        open project group team world daily times post press review guide learn study course language history nature
        energy water climate animal plant space free cheap track farm win link cash mail weight loss easy quick online education""",
}
WORDS = """the and of to in for on with by from at as is be this that it are was or an you we our your my one two day time year people way man
    woman child life world hand part place work week case point company number group problem fact new good first last long great little own other old
    right big high small large next early young important few public bad same able best better real pro plus max top go get my mega super ultra net"""


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, null if there is none."""
    h = F.lower(F.regexp_extract(F.trim(url.cast("string")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    return F.when(h == "", None).otherwise(F.regexp_replace(h, r"^www\.|\.$", ""))


def path_of(url: Column) -> Column:
    """Path of a URL in lower case; queries hold parameters' names rather than words."""
    return F.lower(F.regexp_extract(F.trim(url.cast("string")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1))


def labels_of(host: str) -> list[str]:
    """Runs of letters of the host without its public ending."""
    parts = host.split(".")
    return [x for p in (parts[:-1] if len(parts) > 1 else parts) for x in re.findall(r"[^\W\d_]+", p)]


def path_tokens(path: str | None) -> list[str]:
    return [x for x in re.findall(r"[^\W\d_]+", path or "")]


def parts_of(label: str) -> set[str]:
    """The substrings of a label that can be words."""
    return {label[i:j] for i in range(len(label)) for j in range(i + 1, min(len(label), i + LONGEST) + 1)}


class Segmenter:
    """Unigram Viterbi over a table of words and counts."""

    def __init__(self, counts: dict[str, float], more: tuple[int, int] = (0, 0)):
        """``more``: the sum and the number of the counts that ``split`` gets a label's share of."""
        total = self.total = sum(counts.values()) + more[0] + len(counts) + more[1] + 1
        self.cost = {w: -math.log((c + 1) / total) for w, c in counts.items()}
        self.longest = LONGEST if more[1] else min(LONGEST, max(map(len, counts), default=1))
        self.known: dict[str, list[str]] = {}

    def split(self, label: str, counts: dict[str, int] | None = None) -> list[str]:
        """Words of one concatenated label; equal costs go to the longer last word. ``counts``: further words."""
        if not counts and label in self.known:
            return self.known[label]
        cost = self.cost
        if counts:
            cost = {w: -math.log((c + 1) / self.total) for w, c in counts.items()}
            cost.update((w, self.cost[w]) for w in parts_of(label) if w in self.cost)
        n = len(label)
        best, back, odd = [0.0] + [math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                c = cost.get(label[j:i])
                if c is not None and best[j] + c < best[i]:
                    best[i], back[i], odd[i] = best[j] + c, j, False
            # an unknown stretch grows by one letter, or begins here
            j = i - 1
            c = best[j] + LETTER + (0.0 if odd[j] and j else UNKNOWN)
            if c < best[i]:
                best[i], back[i], odd[i] = c, (back[j] if odd[j] and j else j), True
        out, i = [], n
        while i:
            out.append(label[back[i] : i])
            i = back[i]
        out.reverse()
        if not counts and len(self.known) < 200_000:
            self.known[label] = out
        return out


class Bayes:
    """Multinomial naive Bayes of two classes with additive smoothing: counts of seed words, and of rows' tokens by bucket."""

    def __init__(self, bad: Counter, good: Counter, rows: np.ndarray | None = None, prior: float = PRIOR, smooth: float = SMOOTH):
        """``rows``: two lines of DIMS counts, of unwanted and of ordinary rows."""
        self.seeds, self.smooth, self.bias, self.known = (bad, good), smooth, math.log(prior / (1 - prior)), {}
        mass = [sum(c.values()) for c in self.seeds]
        total = np.zeros(2) if rows is None else rows.sum(1)
        share = min(1.0, total.sum() / max(sum(mass), 1))
        self.rows = np.zeros((2, DIMS)) if rows is None else rows * (share * np.array(mass) / np.maximum(total, 1e-9))[:, None]
        words = len(set(bad) | set(good)) + int((self.rows.sum(0) > 0).sum()) + 1
        self.total = [m + r + smooth * words for m, r in zip(mass, self.rows.sum(1))]

    def weight(self, token: str) -> float:
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            b = bucket(token)
            seed = token in self.seeds[0] or token in self.seeds[1]
            x, y = ((s[token] + (0 if seed else r[b]) + self.smooth) / n for s, r, n in zip(self.seeds, self.rows, self.total))
            self.known[token] = math.log(x) - math.log(y)
        return self.known[token]

    def score(self, tokens: list[str]) -> float:
        """P(unwanted); tokens that the model doesn't know say nothing."""
        z = self.bias + sum(self.weight(t) for t in tokens if self.knows(t))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def knows(self, token: str) -> bool:
        return token in self.seeds[0] or token in self.seeds[1] or self.rows[:, bucket(token)].any()


def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) % DIMS


def seeds() -> tuple[Counter, Counter]:
    """Counts of the seed words of unwanted and of ordinary hosts."""
    bad, good = (Counter({w: SEED_WEIGHT * c for w, c in Counter(SEEDS[k].split()).items()}) for k in ("bad", "good"))
    return bad, good


def tokens_of(given: str) -> list[str]:
    """Host words and path tokens of "words<tab>path"."""
    words, _, path = given.partition("\t")
    return words.split() + path_tokens(path)


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Bayes:
    """The model fitted on the frame (given), one string "words<tab>path" a row, null for rows without a host."""
    model = Bayes(*seeds())
    schema = pa.schema([("b", pa.int32()), ("bad", pa.float64()), ("good", pa.float64())])
    for _ in range(rounds):

        def count(batches, model=model):
            sums = np.zeros((2, DIMS))
            for batch in batches:
                for given in batch.column(0).to_pylist():
                    tokens = tokens_of(given)
                    p = model.score(tokens)
                    for t in tokens:
                        if t in model.seeds[0] or t in model.seeds[1]:  # what they say is given
                            continue
                        b = bucket(t)
                        sums[0, b] += p
                        sums[1, b] += 1 - p
            at = np.flatnonzero(sums.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[0, at]), pa.array(sums[1, at])], schema=schema)

        parts = rows.where("given is not null").select("given").mapInArrow(count, "b int, bad double, good double")
        counts = np.zeros((2, DIMS))
        for r in parts.groupBy("b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect():  # DIMS rows at most
            counts[:, r.b] = r.bad, r.good
        model = Bayes(*seeds(), counts)
    return model


def split_labels(labels: DataFrame) -> DataFrame:
    """(w, words) of every distinct label (w, c), c being how often the hosts have it."""
    built_in = Counter({w: 1000 for w in (WORDS + " " + SEEDS["good"] + " " + SEEDS["bad"]).split()})
    plain = Segmenter(built_in)

    # a label that known words make up is a concatenation, not a word
    def is_word(texts: list) -> list:
        return [any(p not in built_in for p in plain.split(t)) for t in texts]

    words = common.stored(labels.where(common.text_udf("boolean", is_word)(F.col("w"))), "words")
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    segmenter = Segmenter(built_in, (int(size[0]), int(size[1])))
    part = F.explode(common.text_udf("array<string>", lambda texts: [sorted(parts_of(t)) for t in texts])(F.col("w"))).alias("part")
    found = labels.select("w", part).join(words.select(F.col("w").alias("part"), "c"), "part")
    found = found.groupBy("w").agg(F.concat_ws(",", F.collect_list(F.concat("part", F.lit(" "), F.col("c").cast("string")))).alias("counts"))

    def split(texts: list) -> list:
        out = []
        for t in texts:
            label, _, counts = t.partition("\t")
            out.append(segmenter.split(label, {w: int(c) for w, c in (x.split(" ") for x in counts.split(",") if x)}))
        return out

    given = F.concat("w", F.lit("\t"), F.coalesce("counts", F.lit("")))
    return labels.select("w").join(found, "w", "left").select("w", common.text_udf("array<string>", split)(given).alias("words"))


def host_words(urls: DataFrame, url: str = "url") -> DataFrame:
    """(host, words) of every distinct host that has labels."""
    hosts = urls.select(host_of(F.col(url)).alias("host")).where("host is not null").distinct()
    labels = common.text_udf("array<string>", lambda texts: [labels_of(t) for t in texts])(F.col("host"))
    rows = common.stored(hosts.select("host", F.posexplode(labels).alias("at", "w")), "labels")
    split = split_labels(common.stored(rows.groupBy("w").agg(F.count("*").alias("c")), "counts"))
    lists = rows.join(split, "w").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("l"))
    return lists.select("host", F.flatten("l.words").alias("words"))


def scorer(model: Bayes):
    """Column function "words<tab>path" -> score."""
    return common.text_udf("double", lambda texts: [None if t is None else round(model.score(tokens_of(t)), 6) for t in texts])


def filter_urls(urls: DataFrame, key: str = "page_id", url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """(key, host, words, score, blocked) of every row."""
    rows = urls.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).join(host_words(urls, url), "host", "left")
    rows = rows.withColumn("words", F.when(F.col("host").isNotNull(), F.coalesce("words", F.array().cast("array<string>"))))
    given = F.concat(F.array_join("words", " "), F.lit("\t"), F.col("path"))
    rows = common.stored(rows.select(key, "host", "words", given.alias("given")), "urls")
    found = rows.select(key, "host", "words", scorer(fit(rows))(F.col("given")).alias("score"))
    return found.select(key, "host", "words", "score", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("blocked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
