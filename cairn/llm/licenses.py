"""Licence scan: matching statistics against a generalised suffix automaton of licence texts.

The automaton holds every run of tokens (words in lower case) of all templates. A text is streamed through it: at each token
the state is the longest run ending there that stands in some template, which are the matching statistics. Its suffix links lead to
the shorter runs that stand in other places; at each place the longest run that the template can't extend on either side is a match
if it has MIN_MATCH tokens or more. For each template matches that
follow each other, with gaps of at most MAX_GAP tokens on either side, are chained by dynamic programming over covered
tokens. A chain that covers enough of the template is a finding. Of findings that overlap in the text the one stays
whose covered tokens exceed its template's missing ones by more (a notice that is whole goes before a longer one in pieces); equal
ones go to the more covered tokens, then to the template's name.

Only stretches of tokens that all stand in the templates' vocabulary can hold a match; they are found by whole-array operations, and only they
are streamed. Null and empty texts and an empty table have no findings, so they give no rows; texts of any length are scanned whole. Repeated
rows give repeated findings. Of the frame only key and text are read, whatever its other columns are called.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common, textops
from cairn.llm.licensetexts import TEMPLATES

MIN_MATCH, MAX_GAP = 3, 6
#: Share of a template's tokens that a finding covers at least.
COVERAGE = 0.75


class Automaton:
    """Generalised suffix automaton over token numbers; every state knows one end place of its runs in each template."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for t, tokens in enumerate(templates):
            last = 0
            for i, x in enumerate(tokens):
                last = self._extend(last, x, ends)
                ends[last].add((t, i + 1))
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            ends[self.link[s]] |= ends[s]
        self.ends = [sorted(e) for e in ends]

    def _new(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, x: int, ends: list) -> int:
        """The state of the run p + x, made by splitting the one that p leads to if that one is longer."""
        q = self.next[p][x]
        if self.length[p] + 1 == self.length[q]:
            return q
        c = self._new(self.length[p] + 1, ends)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, x: int, ends: list) -> int:
        if x in self.next[last]:  # another template had this run
            return self._split(last, x, ends)
        s, p = self._new(self.length[last] + 1, ends), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = s
            p = self.link[p]
        self.link[s] = 0 if p < 0 else self._split(p, x, ends)
        return s

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """At each token: the length of the longest run of the templates that ends there, and its state."""
        out, s, n = [], 0, 0
        nxt, link, length = self.next, self.link, self.length
        for x in tokens:
            while s and x not in nxt[s]:
                s = link[s]
                n = length[s]
            if x in nxt[s]:
                s = nxt[s][x]
                n += 1
            else:
                n = 0
            out.append((n, s))
        return out


class Scanner:
    def __init__(self, templates: dict[str, str], least: int = MIN_MATCH, gap: int = MAX_GAP, coverage: float = COVERAGE):
        self.names = sorted(templates)
        hashes = [textops.words([templates[n]])[0] for n in self.names]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        tokens = [np.searchsorted(self.vocabulary, h).tolist() for h in hashes]
        self.sizes, self.least, self.gap, self.coverage = [len(t) for t in tokens], least, gap, coverage
        self.automaton = Automaton(tokens)
        self.tokens = tokens
        self.shorter: dict[int, list[tuple[int, int, int]]] = {}

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Token numbers, -1 for tokens of no template."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def _shorter(self, s: int) -> list[tuple[int, int, int]]:
        """(template, end, length) of the places that the state's own runs lack, from the states down its suffix links."""
        if s not in self.shorter:
            a, out = self.automaton, []
            p, q = s, a.link[s]
            while q > 0 and a.length[q] >= self.least:
                lacking = set(a.ends[q]).difference(a.ends[p])
                out += [(t, end, a.length[q]) for t, end in sorted(lacking)]
                p, q = q, a.link[q]
            self.shorter[s] = out
        return self.shorter[s]

    def matches(self, tokens: list[int]) -> list[tuple[int, int, int, int]]:
        """(template, begin in the text, begin in the template, length) of all runs that can't be extended on either side."""
        a, out = self.automaton, []
        for i, (n, s) in enumerate(a.statistics(tokens)):
            if n < self.least:
                continue
            nxt = tokens[i + 1] if i + 1 < len(tokens) else -1
            for t, end, k in [*((t, end, n) for t, end in a.ends[s]), *self._shorter(s)]:
                if end == self.sizes[t] or self.tokens[t][end] != nxt:
                    out.append((t, i + 1 - k, end - k, k))
        return out

    def findings(self, numbers: np.ndarray) -> list[tuple[str, int, int, int]]:
        """(template, first token, end, covered tokens) of one text's token numbers."""
        flags = numbers >= 0
        starts, ends = textops.runs(flags)
        long = ends - starts >= self.least
        by: dict[int, list[tuple[int, int, int]]] = {}
        for b, e in zip(starts[long].tolist(), ends[long].tolist()):
            for t, x, y, n in self.matches(numbers[b:e].tolist()):
                by.setdefault(t, []).append((b + x, y, n))
        found = [f for t, m in by.items() for f in self._chains(t, m)]
        # overlapping findings: most covered tokens, less the template's others, first
        size = dict(zip(self.names, self.sizes))
        found.sort(key=lambda f: (size[f[0]] - 2 * f[3], -f[3], f[0], f[1]))
        kept: list[tuple[str, int, int, int]] = []
        taken: list[tuple[int, int]] = []
        for f in found:
            i = bisect.bisect_left(taken, (f[1], f[2]))
            if (i == len(taken) or taken[i][0] >= f[2]) and (i == 0 or taken[i - 1][1] <= f[1]):
                taken.insert(i, (f[1], f[2]))
                kept.append(f)
        return sorted(kept, key=lambda f: (f[1], f[2], f[0]))

    def _chains(self, t: int, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int]]:
        """Best chain ending in each match; then disjoint chains by covered tokens. Matches are (text, template, length)."""
        m = sorted(set(matches))
        best = [n for _, _, n in m]
        begin = [i for i, _, _ in m]
        reach = self.sizes[t] + self.gap
        low = 0
        for j, (x, y, n) in enumerate(m):
            while m[low][0] + m[low][2] + reach < x:
                low += 1
            for i in range(low, j):
                px, py, pn = m[i]
                cut = max(0, px + pn - x, py + pn - y)  # an overlap is counted once
                if px < x and py < y and cut < n and x + cut - (px + pn) <= self.gap and y + cut - (py + pn) <= self.gap and best[i] + n - cut > best[j]:
                    best[j], begin[j] = best[i] + n - cut, begin[i]
        need = max(self.least, self.coverage * self.sizes[t])
        out: list[tuple[str, int, int, int]] = []
        for c, b, e in sorted(((best[j], begin[j], m[j][0] + m[j][2]) for j in range(len(m))), key=lambda f: (-f[0], f[1], f[2])):
            if c >= need and all(e <= f[1] or b >= f[2] for f in out):
                out.append((self.names[t], b, e, c))
        return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, first_token, end_token, covered, coverage) of every finding in every row."""
    common.bounded_batches()
    schema = pa.schema([(key, pa.int64()), ("license", pa.string()), ("first_token", pa.int32()), ("end_token", pa.int32()), ("covered", pa.int32()), ("coverage", pa.float64())])

    def run(batches):
        scanner = Scanner(templates)
        sizes = dict(zip(scanner.names, scanner.sizes))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in textops.passes(texts):
                h, at = textops.words(texts[a:b])
                numbers = scanner.numbers(h)
                # texts in which some stretch is long enough
                flags = (numbers >= 0).astype(np.int32)
                doc = np.repeat(np.arange(b - a), np.diff(at))
                inside = np.zeros(max(len(h) - scanner.least + 1, 0), bool)
                if len(inside):
                    inside[:] = True
                    for k in range(scanner.least):
                        inside &= flags[k : k + len(inside)] > 0
                    inside &= doc[: len(inside)] == doc[scanner.least - 1 :]
                rows = [(ids[a + i], *f) for i in np.unique(doc[: len(inside)][inside]).tolist() for f in scanner.findings(numbers[at[i] : at[i + 1]])]
                cols = [[r[k] for r in rows] for k in range(5)] + [[round(r[4] / sizes[r[1]], 6) for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"{key} long, license string, first_token int, end_token int, covered int, coverage double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
