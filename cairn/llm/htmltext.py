"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A tolerant parser makes a tree of elements (void elements, implied ends, unclosed and stray tags, comments, raw text of scripts
and styles, truncated pages) in time linear in the page, however deep it is nested. Each element has features: length, link density, tag
density and punctuation of its subtree, its own text, depth, place and number among its siblings, the siblings' lengths, place in the
page, and hashed tokens of its tag and of its class, id and role attributes. Trees boosted on a bounded sample of pages estimate whether
its text is content; their targets come from pages that say so themselves (article and main elements against nav, footer, aside, header,
form). These tags are what the targets are made of, so the features never see them: in training and in scoring they count as div, of the
element and of its parent alike. A page without them gets the same text as one with them.
Decoding: each subtree is kept whole, dropped whole, or mixed, in which case its children are decided by themselves; a dynamic programme
takes the most probable consistent choice, so a kept node never has a dropped ancestor, nor a dropped one a kept ancestor.

A null page has null text; an empty one, or one without text, the empty text. Without a page that labels itself, built-in rules on
link density and length stand for the trees; an empty table gives an empty result. Very long pages are parsed whole. Rows are judged one by
one, so repeated rows and equal ids have rows of their own; where keeping and dropping a subtree tie it is kept. Other columns aren't read.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common, textops

#: Pages that the trees are fitted on, at most.
SAMPLE = 600
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
#: What a mixed subtree costs, in nats: single nodes don't break up a whole without evidence.
MIXED = 1.0
TOKENS = 24

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "title"}
CONTENT, BOILER = frozenset(("article", "main")), frozenset(("nav", "footer", "aside", "header", "form", "script", "style", "head"))
#: Tags that the targets are made of.
MASKED = CONTENT | BOILER - {"script", "style", "head"}
_IMPLIED = {"li": (("li",), ("ul", "ol")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)")
_REST = re.compile(r"([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "svg", "iframe")}
_PUNCT = re.compile(r"[.,;:!?](?:\s|$)")
_WORD = re.compile(r"[^\W_]+")


class Page:
    """Elements by number (0 is the root): parent, tag, attribute tokens; text pieces (element, text, block number)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens, self.pieces = [-1], ["#root"], [[]], []
        stack, at, block = [0], 0, 0
        places: dict[str, list[int]] = {}  # where the open elements of each tag stand in the stack

        def text(raw: str) -> None:
            if raw and not raw.isspace():
                self.pieces.append((stack[-1], entities.unescape(raw), block))
            elif raw and self.pieces:
                self.pieces.append((stack[-1], " ", block))

        def close(k: int) -> None:
            """End the open elements from place k on."""
            while len(stack) > k:
                places[self.tag[stack.pop()]].pop()

        def nearest(tags: tuple) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        quotes, last = True, source.rfind(">")  # no tag ends behind the last one
        i = source.find("<")
        while 0 <= i:
            if source.startswith("<!--", i):
                end = source.find("-->", i + 4)
                text(source[at:i])
                at = end + 3 if end >= 0 else len(source)
            elif i > last:
                if re.match(r"<[/a-zA-Z!?]", source[i : i + 2]):  # a tag that was cut off
                    text(source[at:i])
                    at = len(source)
                    break
                i = source.find("<", i + 1)
                continue
            elif source.startswith(("<!", "<?"), i):
                text(source[at:i])
                at = source.find(">", i) + 1
            elif m := _NAME.match(source, i):
                rest = _REST.match(source, m.end()) if quotes else None
                quotes = rest is not None  # once a quote isn't closed, quotes no longer count in this page
                end = rest.end(1) if rest else source.find(">", m.end())
                text(source[at:i])
                at = end + 1
                self._tag(m[2].lower(), bool(m[1]), source[m.end() : end], stack, places, close, nearest)
                if m[2].lower() in BLOCK or m[2].lower() == "br" and not m[1]:
                    block += 1
                if not m[1] and m[2].lower() in _RAW:  # its text isn't text of the page
                    found = _RAW[m[2].lower()].search(source, at)
                    at = found.end() if found else len(source)
            else:
                i = source.find("<", i + 1)
                continue
            i = source.find("<", at)
        text(source[at:])

    def _tag(self, name: str, closing: bool, attributes: str, stack: list[int], places: dict, close, nearest) -> None:
        if closing:
            if places.get(name):
                close(places[name][-1])
            return
        if name in CLOSES_P and places.get("p"):
            close(places["p"][-1])
        if name in _IMPLIED:
            ends, scope = _IMPLIED[name]
            if (k := nearest(ends)) > nearest(scope):
                close(k)
        if name not in VOID:
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.tokens.append([x for a in _ATTR.finditer(attributes) for x in _WORD.findall((a[2] or a[3] or a[4] or "").lower())])
            if name not in _RAW and not attributes.rstrip().endswith("/"):
                places.setdefault(name, []).append(len(stack))
                stack.append(len(self.tag) - 1)

    def sums(self, own: np.ndarray) -> np.ndarray:
        """Sum of a value over each subtree (children come after their parents)."""
        total = own.astype(np.float64).copy()
        for i in range(len(total) - 1, 0, -1):
            total[self.parent[i]] += total[i]
        return total

    def features(self) -> np.ndarray:
        n = len(self.tag)
        chars, words, punct, first = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, np.nan)
        seen = 0
        for i, t, _ in self.pieces:
            chars[i] += len(t)
            words[i] += len(_WORD.findall(t))
            punct[i] += len(_PUNCT.findall(t))
            if np.isnan(first[i]):
                first[i] = seen
            seen += len(t)
        parent = np.array(self.parent)
        link = np.zeros(n, bool)
        depth, place, count = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            link[i] = link[p] or self.tag[i] == "a"
            depth[i] = depth[p] + 1
            place[i] = count[p]
            count[p] += 1
        all_chars, all_words, all_punct, size, linked = self.sums(chars), self.sums(words), self.sums(punct), self.sums(np.ones(n)), self.sums(np.where(link, chars, 0))
        start = np.where(np.isnan(first), 0, first)
        up = np.maximum(parent, 0)
        before, after = np.zeros(n), np.zeros(n)
        last: dict[int, int] = {}
        for i in range(1, n):
            j = last.get(parent[i])
            if j is not None:
                before[i], after[j] = all_chars[j], all_chars[i]
            last[parent[i]] = i
        hashed = np.zeros((n, TOKENS))
        for i in range(n):
            for t in ("div" if self.tag[i] in MASKED else self.tag[i], *("." + x for x in self.tokens[i])):
                hashed[i, _bucket(t)] = 1
        total = max(seen, 1)
        dense = np.stack((np.log1p(chars), np.log1p(all_chars), np.log1p(words), all_chars / size, linked / np.maximum(all_chars, 1), all_punct / np.maximum(all_words, 1), punct, all_chars / np.maximum(all_words, 1), depth, place, count[up], count, np.log1p(before), np.log1p(after), all_chars / total, start / total, all_chars[up] / total), 1)
        return np.concatenate((dense, hashed, hashed[up]), 1)

    def labels(self) -> np.ndarray:
        """1 within content elements, 0 elsewhere, -1 on every node of a page that has none."""
        y = np.zeros(len(self.tag), np.int64)
        for i in range(1, len(y)):
            y[i] = 0 if self.tag[i] in BOILER else 1 if self.tag[i] in CONTENT else y[self.parent[i]]
        return y if y.any() else np.full(len(y), -1)

    def weights(self) -> np.ndarray:
        own = np.zeros(len(self.tag))
        for i, t, _ in self.pieces:
            own[i] += len(t.strip())
        return np.sqrt(own)

    def decode(self, p: np.ndarray, mixed: float = MIXED) -> np.ndarray:
        """Which elements keep their own text: the best consistent choice for the probabilities."""
        w = self.weights()
        p = np.clip(p, 1e-4, 1 - 1e-4)
        keep_own, drop_own = w * np.log(p), w * np.log(1 - p)
        keep, drop = self.sums(keep_own), self.sums(drop_own)
        part = np.maximum(keep_own, drop_own) - mixed  # plus the children's best
        best = np.zeros(len(p))
        for i in range(len(p) - 1, -1, -1):
            best[i] = max(keep[i], drop[i], part[i])
            if i:
                part[self.parent[i]] += best[i]
        state = np.zeros(len(p), np.int64)  # 1 kept, 0 dropped, 2 mixed
        out = np.zeros(len(p), bool)
        for i in range(len(p)):
            above = state[self.parent[i]] if i else 2
            state[i] = above if above != 2 else 1 if keep[i] >= max(drop[i], part[i]) and w_any(keep[i], drop[i]) else 0 if drop[i] >= part[i] else 2
            out[i] = state[i] == 1 or state[i] == 2 and keep_own[i] > drop_own[i]
        return out

    def text(self, kept: np.ndarray) -> str:
        """Text of the kept elements: a line for each block, white space collapsed."""
        lines: dict[int, list[str]] = {}
        for i, t, b in self.pieces:
            if kept[i]:
                lines.setdefault(b, []).append(t)
        out = (" ".join("".join(x).split()) for _, x in sorted(lines.items()))
        return "\n".join(x for x in out if x)


def w_any(keep: float, drop: float) -> bool:
    """False for a subtree without text, which is dropped."""
    return keep != 0 or drop != 0


_buckets: dict[str, int] = {}


def _bucket(token: str) -> int:
    if token not in _buckets:
        if len(_buckets) > 100_000:
            _buckets.clear()
        _buckets[token] = int(textops.mix(np.array([hash_of(token)], np.uint64))[0] % np.uint64(TOKENS))
    return _buckets[token]


def hash_of(token: str) -> int:
    h = 0xCBF29CE484222325
    for b in token.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Gradient-boosted trees for the logistic loss; each tree is complete: feature, threshold by node, value by leaf."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin b: edges[b-1] < x <= edges[b]
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    f = np.full(len(y), np.log(prior / (1 - prior)))
    base, model = float(f[0]) if len(f) else 0.0, []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            width, off = 2**level, 2**level - 1
            best_gain = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                nb = len(edges[j]) + 1
                key = (node - off) * nb + binned[:, j]
                gs, hs = np.bincount(key, g, width * nb).reshape(width, nb).cumsum(1), np.bincount(key, h, width * nb).reshape(width, nb).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = (gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1))[:, :-1]
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best_gain
                best_gain = np.where(better, gain[np.arange(width), k], best_gain)
                for q in np.flatnonzero(better):
                    feature[off + q], threshold[off + q] = j, edges[j][k[q]]
            right = x[np.arange(len(y)), feature[node]] > threshold[node]
            node = 2 * node + 1 + right
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        f += value[leaf]
        model.append((feature, threshold, value))
    return {"base": base, "trees": model, "depth": depth}


def predict(model: dict | None, x: np.ndarray) -> np.ndarray:
    """P(content) of each row; without a model, from link density (column 4) and the subtree's length (column 1)."""
    if model is None:
        f = 3 - 8 * x[:, 4] + np.where(x[:, 1] > np.log1p(80), 0, -2)
    else:
        f, rows = np.full(len(x), model["base"]), np.arange(len(x))
        for feature, threshold, value in model["trees"]:
            node = np.zeros(len(x), np.int64)
            for _ in range(model["depth"]):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            f += value[node - (2 ** model["depth"] - 1)]
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE) -> dict | None:
    """Trees from at most ``sample`` pages, those that label themselves; None if there is none."""

    def nodes(texts: list) -> dict:
        x, y = [], []
        for t in texts:
            page = Page(t or "")
            label, own = page.labels(), page.weights() > 0
            x.append(page.features()[own].astype(np.float32).tobytes())
            y.append(label[own].astype(np.int8).tobytes())
        return {"x": x, "y": y}

    src = pages.select(F.col(key).alias("k"), F.col(html).cast("string").alias("h"))
    labelled = src.where(F.col("h").rlike("(?i)<(article|main)\\b"))
    rows = common.sample_rows(labelled, "k", sample).select("k", common.text_udf("x binary, y binary", nodes)("h").alias("n")).select("k", "n.*").collect()
    rows = [r for r in sorted(rows, key=lambda r: r.k) if r.y]
    if not rows:
        return None
    y = np.concatenate([np.frombuffer(r.y, np.int8) for r in rows]).astype(np.float64)
    x = np.concatenate([np.frombuffer(r.x, np.float32) for r in rows]).astype(np.float64).reshape(len(y), -1)
    return boost(x[y >= 0], y[y >= 0])


def extractor(model: dict | None):
    """Column function html -> struct(text, n_nodes, n_kept)."""

    def work(texts: list) -> dict:
        out: dict[str, list] = {"text": [], "n_nodes": [], "n_kept": []}
        pages = [None if t is None else Page(t) for t in texts]
        x = [p.features() for p in pages if p]
        at = np.cumsum([0] + [len(f) for f in x])
        score, i = predict(model, np.concatenate(x)) if x else np.zeros(0), 0
        for p in pages:
            if p is None:
                for v in out.values():
                    v.append(None)
                continue
            kept = p.decode(score[at[i] : at[i + 1]])
            i += 1
            out["text"].append(p.text(kept))
            out["n_nodes"].append(len(p.tag) - 1)
            out["n_kept"].append(int(kept[1:].sum()))
        return out

    return common.text_udf("text string, n_nodes int, n_kept int", work)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text, n_nodes, n_kept) of every page."""
    x = extractor(fit(pages, key, html))(F.col(html).cast("string"))
    return pages.select(F.col(key), x.alias("x")).select(key, "x.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
