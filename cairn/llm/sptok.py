"""SentencePiece encoding and decoding with the tokenizers library as back end.

The model's protobuf is parsed here: pieces with scores and types, the model type, and the normaliser's settings. From them
a tokenizers model is rebuilt: Unigram from the scores, or BPE with merges in the order of the scores; byte fallback; the
metaspace marker. Where no piece has the marker behind another character, words (a run of markers and what follows)
are encoded one by one without changing the result, so every distinct word of a task is encoded once: new words go to the
back end in multithreaded batches; known ones come from a table of bounded size. Each new word with one marker in front (nearly all) is
encoded by the sentencepiece library as well: ``parity`` is false for rows with a word on which the two differ.
Such words are encoded many in one text, on both sides; the words of a text on which the two differ are encoded again one by one.
Every row's ids are decoded again, by one gather of the pieces' bytes for a whole batch, and ``round_trip`` says whether they give the
normalised text.

The model file is sent to the executors with the job; its path is a parameter. Nulls have null ids; the empty text has none and no tokens.
Texts of any length are encoded whole. Rows are independent: repeated rows and ties have equal results, an empty table an empty one. Of the
frame only doc_id and text are read, whatever its other columns are called.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common

#: The model file; a parameter of every function here.
MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Distinct words of a generation, of which a task keeps two; words that go to the back end at once.
KNOWN, AT_ONCE = 50_000, 4_000
#: New words that make one text for the back end and the library.
JOINED = 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(field number, value) of a protobuf message: int, or bytes for the other wire types."""
    i, n = 0, len(data)
    while i < n:
        tag = shift = 0
        while True:
            b = data[i]
            i += 1
            tag |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        kind = tag & 7
        if kind == 0:
            value = shift = 0
            while True:
                b = data[i]
                i += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
            yield tag >> 3, value
        elif kind == 2:
            size = shift = 0
            while True:
                b = data[i]
                i += 1
                size |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
            yield tag >> 3, data[i : i + size]
            i += size
        else:
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[i : i + size]
            i += size


def parse(path: str) -> dict:
    """Pieces [(text, score, type)], model type ("unigram" or "bpe"), and the normaliser's settings."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, out = [], {"type": "unigram", "byte_fallback": False, "unk": 0, "prefix": True, "collapse": True, "escape": True, "charsmap": b"", "normalizer": ""}
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    text = v.decode("utf-8", "surrogateescape")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            pieces.append((text, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    out["type"] = {1: "unigram", 2: "bpe", 3: "word", 4: "char"}[v]
                elif k == 35:
                    out["byte_fallback"] = bool(v)
                elif k == 40:
                    out["unk"] = v
        elif number == 3:
            for k, v in _fields(value):
                if k == 1:
                    out["normalizer"] = v.decode()
                elif k == 2:
                    out["charsmap"] = v
                elif k == 3:
                    out["prefix"] = bool(v)
                elif k == 4:
                    out["collapse"] = bool(v)
                elif k == 5:
                    out["escape"] = bool(v)
    return out | {"pieces": pieces}


def build(model: dict):
    """The tokenizers back end of a parsed model; it expects normalised text with markers."""
    from tokenizers import Tokenizer, decoders, models

    vocab = {p: i for i, (p, _, _) in enumerate(model["pieces"])}
    if model["type"] == "unigram":
        back = models.Unigram([(p, s) for p, s, _ in model["pieces"]], unk_id=model["unk"], byte_fallback=model["byte_fallback"])
    elif model["type"] == "bpe":
        merges = []
        normal = {p: s for p, s, k in model["pieces"] if k in (NORMAL, USER, UNUSED)}
        for piece, score in normal.items():
            merges += [(-score, vocab[piece[:i]], vocab[piece[i:]], piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in normal and piece[i:] in normal]
        merges.sort(key=lambda m: m[:3])
        back = models.BPE(vocab, [(a, b) for *_, a, b in merges], unk_token=model["pieces"][model["unk"]][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError(f"models of type {model['type']} aren't supported")
    t = Tokenizer(back)
    t.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
    return t


class Codec:
    """Encoder and decoder of one model; made once in each Python worker."""

    def __init__(self, path: str = MODEL, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = parse(path)
        self.back = build(self.model)
        self.pieces = [p for p, _, _ in self.model["pieces"]]
        self.kinds = [k for _, _, k in self.model["pieces"]]
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode("utf-8", "surrogateescape") for p, k in zip(self.pieces, self.kinds)]
        self.bytes, self.sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.marked = np.array([p.startswith(MARK) for p in self.pieces], bool)
        inner = any(MARK in p.lstrip(MARK) for p, _, k in self.model["pieces"] if k in (NORMAL, USER))
        self.split = None if inner or model_needs_whole(self.model) else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.normaliser = None
        if self.model["charsmap"]:
            from tokenizers import normalizers

            self.normaliser = normalizers.Precompiled(self.model["charsmap"])
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.path, self.library = path, None
        self.bad: set[str] = set()  # words on which the library differs; none is known

    def normalise(self, text: str) -> str:
        """As the model's normaliser does it: character map, spaces collapsed, marker in front, markers for spaces."""
        if self.normaliser is not None:
            text = self.normaliser.normalize_str(text)
        if self.model["collapse"]:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.model["prefix"]:
            text = " " + text
        return text.replace(" ", MARK) if self.model["escape"] else text

    def forget(self) -> None:
        """Drop the words at a task's end; the next task may be of another kind."""
        self.table, self.older = {}, {}

    def _learn(self, words: list[str]) -> None:
        """Encode new words with the back end and, if plain (one marker, in front), with the library; note those on which they differ."""
        plain, other = [], words
        if self.split and self.model["prefix"]:
            plain = [w for w in words if w[0] == MARK and len(w) > 1 and MARK not in w[1:]]
            other = [w for w in words if w[0] != MARK or len(w) == 1 or MARK in w[1:]] if len(plain) < len(words) else []
        for i in range(0, len(plain), AT_ONCE):
            if rest := self._learn_joined(plain[i : i + AT_ONCE]):
                self._learn_each(rest, True)
        for i in range(0, len(other), AT_ONCE):
            self._learn_each(other[i : i + AT_ONCE], False)

    def _learn_each(self, words: list[str], plain: bool) -> None:
        found = [e.ids for e in self.back.encode_batch_fast(words, add_special_tokens=False)]
        self.table.update((w, array("i", ids).tobytes()) for w, ids in zip(words, found))
        if plain:
            theirs = self._theirs([w[1:] for w in words])
            self.bad.update(w for w, t, ids in zip(words, theirs, found) if t != ids and self.normalise(w[1:]) == w)

    def _learn_joined(self, words: list[str]) -> list[str]:
        """Learn plain words in texts of many; the words of texts on which the two differ, or whose words can't be told apart, are returned.

        No piece has a marker behind another character, so the pieces of a text are those of its words, and each word begins with its marker.
        """
        parts = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        texts = ["".join(ws) for ws in parts]
        found = [e.ids for e in self.back.encode_batch_fast(texts, add_special_tokens=False)]
        same = [t == ids for t, ids in zip(self._theirs([t[1:].replace(MARK, " ") for t in texts]), found)]
        known = words if all(same) else [w for ws, ok in zip(parts, same) if ok for w in ws]
        ids = np.array([x for f, ok in zip(found, same) if ok for x in f], np.int32)
        first = np.flatnonzero(self.marked[ids])
        if len(first) != len(known):
            return words
        flat, ends = ids.tobytes(), (4 * np.append(first, len(ids))).tolist()
        self.table.update(zip(known, [flat[a:b] for a, b in zip(ends, ends[1:])]))
        return [w for ws, ok in zip(parts, same) if not ok for w in ws]

    def _theirs(self, texts: list[str]) -> list[list[int]]:
        if self.library is None:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self.library.encode(texts, num_threads=2)

    def text_bytes(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all pieces, one text after another; where each text begins (its ids begin at ``at``), and the end."""
        n = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        return self.bytes[np.repeat(self.begins[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes(), ends[at]

    def encode(self, texts: list[str | None]) -> tuple[list, list, list]:
        """Ids of each text (null for null), whether decoding them gives the normalised text back, and whether the library agrees."""
        normal = [None if t is None else self.normalise(t) for t in texts]
        split = [None if t is None else (self.split.findall(t) if self.split else [t] if t else []) for t in normal]
        if len(self.table) > KNOWN:
            self.older, self.table = self.table, {}
        new = {w for ws in split if ws for w in ws if w not in self.table}
        if self.older:
            seen = [w for w in new if w in self.older]
            self.table.update((w, self.older[w]) for w in seen)
            new.difference_update(seen)
        if new:
            self._learn(list(new))
        get, ids = self.table.__getitem__, []
        for ws in split:
            ids.append(None if ws is None else np.frombuffer(b"".join(map(get, ws)), np.int32))
        same = [None if ws is None else not self.bad or self.bad.isdisjoint(ws) for ws in split]
        at = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in ids])))
        back, begin = self.text_bytes(np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]]), at)
        want = [b"" if t is None else t.encode() for t in normal]
        whole = back == b"".join(want)
        ok = [None if t is None else whole or back[begin[i] : begin[i + 1]] == want[i] for i, t in enumerate(normal)]
        return ids, ok, same

    def decode(self, lists: list) -> list[str | None]:
        """The texts: markers are spaces again, the one in front goes; control pieces give nothing."""
        at = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in lists])))
        back, begin = self.text_bytes(np.concatenate([np.zeros(0, np.int32), *[np.asarray(x, np.int32) for x in lists if x is not None]]), at)
        out: list[str | None] = []
        for i, x in enumerate(lists):
            text = back[begin[i] : begin[i + 1]].decode("utf-8", "replace").replace(MARK, " ")
            out.append(None if x is None else text[1:] if self.model["prefix"] and text.startswith(" ") else text)
        return out


def model_needs_whole(model: dict) -> bool:
    """User-defined pieces may cross words; then texts are encoded whole."""
    return any(k == USER and MARK not in (p[0], p) and p.strip(MARK) != p.lstrip(MARK) for p, _, k in model["pieces"] if p)


@lru_cache(maxsize=4)
def codec(path: str, threads: int = 2) -> Codec:
    return Codec(path, threads)


def parity(texts: list[str], path: str = MODEL) -> list[bool]:
    """For each text: whether the sentencepiece library gives the same ids, and our decoding the same text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = codec(path).encode(texts)[0]
    return [sp.encode(t) == i.tolist() and sp.decode(i.tolist()) == back for t, i, back in zip(texts, ids, codec(path).decode(ids))]


def _sent(path: str):
    """The model goes to the executors with the job; the function gives its place there."""
    SparkSession.active().sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: SparkFiles.get(name)


def encode_column(path: str = MODEL):
    """Column function text -> struct(ids, n_tokens, round_trip, parity)."""
    local = _sent(path)

    def work(texts: list) -> dict:
        ids, ok, same = codec(local()).encode(texts)
        size = np.array([0 if x is None else len(x) for x in ids], np.int64)
        offs = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(size, out=offs[1:])
        flat = np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]])
        null = np.array([x is None for x in ids], bool)
        lists = pa.ListArray.from_arrays(pa.array(offs, mask=np.append(null, False)) if null.any() else pa.array(offs), pa.array(flat))
        return {"ids": lists, "n_tokens": pa.array(size.astype(np.int32), mask=null), "round_trip": ok, "parity": same}

    return common.text_udf("ids array<int>, n_tokens int, round_trip boolean, parity boolean", work, lambda: codec(local()).forget())


def decode_column(path: str = MODEL):
    """Column function ids -> text, by Arrow batches."""
    local = _sent(path)

    def run(ids: pa.Array) -> pa.Array:
        flat, offs = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        return pa.array(codec(local()).decode([flat[a:b] if v else None for a, b, v in zip(offs, offs[1:], ids.is_valid().to_pylist())]), pa.string())

    run.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def encode(docs: DataFrame, path: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, round_trip, parity, ids) of every row, behind doc_id the columns ``keep``."""
    x = encode_column(path)(F.col("text").cast("string"))
    return docs.select("doc_id", *keep, x.alias("x")).select("doc_id", *keep, "x.n_tokens", "x.round_trip", "x.parity", "x.ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.documents(spark, sf_dir))
