"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled to three machines: the normaliser (:class:`Normaliser`: a dummy space in front, spaces to the
mark U+2581, runs of spaces to one where the model says so), the pieces (a trie whose final states emit an id and lead back
to its root), and byte fallback (an arc for each byte; a character that no piece starts with takes those of its UTF-8
bytes). Each input is composed with them as it is read: the normaliser's output walks the trie from each place that has a
path, and the path of least weight in the tropical semiring (min, +) gives the ids.

Weights come from the model. In a unigram model a piece weighs minus its score. In a BPE model, segmentations are not
ranked by a sum of scores, so the weight is on pairs of neighbouring pieces: 0 where merging the two pieces' characters
by the model's merges gives the two back, infinite otherwise. A segmentation all of whose neighbours are so is the BPE
segmentation, and there is one, so a state is (place, last piece), each place has one state of finite weight, and the
shortest path equals the library's ids. It is found in Dijkstra's order, of places as near the furthest first, so most
places aren't come to; a unigram model's places are relaxed in order.

No piece holds the mark after another character, so a path passes through every place where a run of marks begins; the
lattice is cut there, and the paths of short stretches are remembered. A Python worker holds ``REMEMBER`` of them and as
many pair weights at most: about a hundred MB when both are full, whatever the input. A worker keeps them between tasks.

Edge cases: a null or empty text has no ids and decodes to the empty string. Decoding gives the text back exactly, save
that a mark U+2581 written in the text comes back as a space (``round_trip`` is false there). Repeated rows and null
ids give a row each; extra columns are not carried. Models with a character map are refused with a ValueError.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.llm.common import table, whole

MODEL = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"
MARK = "▁"
REMEMBER = 400_000
#: Longer stretches are not remembered.
REMEMBER_CHARS = 48
START, CHARACTER = -1, -2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


class Normaliser:
    """A transducer over characters. ``arcs`` of a state: character to (output, next state); any other character takes the
    state's ``copy`` arc (what is put before it, next state). Every state is final."""

    def __init__(self, dummy: int, collapse: int, escape: int):
        space = MARK if escape else " "
        front = space if dummy else ""
        if collapse:  # 0 before the text, 1 in it, 2 after spaces in it, which are lost at its end
            self.arcs = {0: {" ": ("", 0)}, 1: {" ": ("", 2)}, 2: {" ": ("", 2)}}
            self.copy = {0: (front, 1), 1: ("", 1), 2: (space, 1)}
        else:
            self.arcs = {0: {" ": (front + space, 1)}, 1: {" ": (space, 1)}}
            self.copy = {0: (front, 1), 1: ("", 1)}
        #: states that are never left: a character's output there doesn't depend on what came before
        self.loops = {s: {ord(c): out for c, (out, _) in self.arcs[s].items()} for s in self.arcs if self.copy[s] == ("", s) and all(n == s for _, n in self.arcs[s].values())}

    def run(self, text: str) -> str:
        """The output of the path that reads a text."""
        state, out = 0, []
        for k, c in enumerate(text):
            if state in self.loops:
                rest, said = text[k:], self.loops[state]
                if len(said) == 1:  # several times as fast as a table
                    ((c, to),) = said.items()
                    out.append(rest.replace(chr(c), to))
                else:
                    out.append(rest.translate(said))
                break
            said, following = self.arcs[state].get(c, (None, 0))
            if said is None:
                before, following = self.copy[state]
                said = before + c
            out.append(said)
            state = following
        return "".join(out)


class Transducer:
    """The compiled model: :meth:`encode` a text to little-endian 32-bit ids, :meth:`decode` them."""

    # numbers of the model file's fields and piece types
    PIECES, TRAINER, NORMALIZER = 1, 2, 3
    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in fields if k == self.PIECES]
        trainer = next((dict(_fields(v)) for k, v in fields if k == self.TRAINER), {})
        rules = next((dict(_fields(v)) for k, v in fields if k == self.NORMALIZER), {})
        if rules.get(2):
            raise ValueError("normalisers with a character map are not supported")
        self.dummy, self.escape = rules.get(3, 1), rules.get(5, 1)
        self.normaliser = Normaliser(self.dummy, rules.get(4, 1), self.escape)
        self.bpe = trainer.get(3, 1) == 2
        texts = [p.get(1, b"").decode() for p in pieces]
        kinds = [p.get(3, self.NORMAL) for p in pieces]
        scores = [float(np.frombuffer(p.get(2, bytes(4)), "<f4")[0]) for p in pieces]
        self.size = len(pieces)
        self.texts = texts
        self.ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k in (self.NORMAL, self.USER)}
        self.scores = scores
        self.bytes = {int(texts[i][3:5], 16): i for i, k in enumerate(kinds) if k == self.BYTE}
        self.is_byte = np.array([k == self.BYTE for k in kinds])
        self.unknown = kinds.index(self.UNKNOWN)
        self.unknown_cost = 10.0 - min(scores[i] for i in self.ids.values())
        self.out = [bytes([int(t[3:5], 16)]) if k == self.BYTE else b"" if k == self.CONTROL else " ⁇ ".encode() if k == self.UNKNOWN else t.encode() for t, k in zip(texts, kinds, strict=True)]
        self.trie: list = [None, {}]  # a node: the id that ends there, and the nodes after it
        for t, i in self.ids.items():
            node = self.trie
            for c in t:
                node = node[1].setdefault(c, [None, {}])
            node[0] = i
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("pieces with a mark inside are not supported")
        # a line feed that no longer piece holds is a stretch of its own
        alone = "" if any("\n" in t and len(t) > 1 for t in self.ids) else "\n"
        self.stretch = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + ("|\n" if alone else ""))
        self.longest = max(map(len, self.ids))
        #: in a BPE model whose characters are all pieces, one path of finite weight comes to each place
        self.one_path = all(c in self.ids for c in set("".join(self.ids)))
        self.bigrams = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        self.pairs: dict[int, float] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # weights

    def _merged(self, chars: list[str]) -> list[str]:
        """What the model's merges make of a short list of characters: best score first, leftmost of equals."""
        ids, scores = self.ids, self.scores
        while True:
            best, at = -math.inf, -1
            for k in range(len(chars) - 1):
                i = ids.get(chars[k] + chars[k + 1])
                if i is not None and scores[i] > best:
                    best, at = scores[i], k
            if at < 0:
                return chars
            chars[at : at + 2] = [chars[at] + chars[at + 1]]

    def _pair_weight(self, last: int, piece: int) -> float:
        """Of two neighbours in a BPE model; a place's first piece, or one after a character without a piece, stands alone."""
        parts = [self.texts[p] for p in (last, piece) if p >= 0]
        return 0.0 if self._merged(list("".join(parts))) == parts else math.inf

    def weight(self, last: int, piece: int) -> float:
        if not self.bpe:
            return -self.scores[piece]
        if last < 0:
            last = START
        key = (last + 1) * self.size + piece
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > REMEMBER:
                self.pairs.clear()
            found = self.pairs[key] = self._pair_weight(last, piece)
        return found

    # composition and shortest path

    def _fallback(self, char: str) -> list[int]:
        ids = [self.bytes.get(b) for b in char.encode()]
        return [self.unknown] if None in ids or not ids else ids

    def _arcs(self, text: str, i: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs that leave a place of the lattice, short ones first."""
        (_, after), out = self.trie, []
        for j, c in enumerate(text[i : i + self.longest], i + 1):
            node = after.get(c)
            if node is None:
                break
            piece, after = node
            if piece is not None:
                out.append((j, piece))
        if not out and text[i] not in self.ids or out and out[0][0] > i + 1:
            out.insert(0, (i + 1, CHARACTER))
        return out

    def path(self, text: str) -> list[int]:
        """Ids along the shortest path through a stretch of normalised text."""
        return self._furthest_first(text) if self.bpe and self.one_path else self._in_order(text)

    def _furthest_first(self, text: str) -> list[int]:
        """The path in Dijkstra's order, where finite weights are all 0: of the places that are as near, those furthest on
        are settled first, and an arc is weighed when its turn comes. The first arc to a place is the one that there is."""
        n, size, pairs, root = len(text), self.size, self.pairs, self.trie[1]
        last: list[int | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        last[0] = START
        i, waiting = 0, []
        while i < n:
            after, none = root, True
            for j in range(i, n):
                node = after.get(text[j])
                if node is None:
                    break
                piece, after = node
                if piece is not None:
                    waiting.append((i, j + 1, piece))
                    none = False
            if none:  # no other arc leaves here
                waiting.append((i, i + 1, CHARACTER))
            while True:
                at, j, piece = waiting.pop()
                if last[j] is not None:
                    continue
                if piece != CHARACTER:
                    before = last[at]
                    weight = pairs.get((before + 1) * size + piece) if before >= 0 else None
                    if (self.weight(before, piece) if weight is None else weight) == math.inf:
                        continue
                last[j], back[j] = piece, at
                i = j
                break
        return self._back(text, last, back)

    def _back(self, text: str, last: list[int], back: list[int]) -> list[int]:
        """Ids of the path that ends behind the text."""
        n, ids = len(text), []
        while n:
            ids += self._fallback(text[back[n] : n])[::-1] if last[n] == CHARACTER else [last[n]]
            n = back[n]
        return ids[::-1]

    def _in_order(self, text: str) -> list[int]:
        """Places in order, arcs relaxed by (min, +)."""
        n, bpe, size, pairs, scores = len(text), self.bpe, self.size, self.pairs, self.scores
        cost, last, back = [math.inf] * (n + 1), [START] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            here, before = cost[i], last[i]
            if here == math.inf:  # no path comes here
                continue
            for j, piece in self._arcs(text, i):
                if piece == CHARACTER:
                    weight = 0.0 if bpe else self.unknown_cost
                elif bpe:
                    weight = pairs.get((before + 1) * size + piece) if before >= 0 else None
                    weight = self.weight(before, piece) if weight is None else weight
                else:
                    weight = -scores[piece]
                if here + weight < cost[j]:
                    cost[j], last[j], back[j] = here + weight, piece, i
        return self._back(text, last, back)

    def _stretch_ids(self, text: str) -> bytes:
        """The ids of a stretch that isn't among the ones just used."""
        ids = self.older.get(text)
        if ids is None:
            cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.bigrams]  # no piece spans these
            parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            if cuts:
                ids = b"".join([self.known.get(p) or self._stretch_ids(p) for p in parts])
            else:
                path = self.path(text)
                ids = struct.pack(f"<{len(path)}I", *path)
        if len(text) <= REMEMBER_CHARS:
            if len(self.known) >= REMEMBER // 2:
                self.known, self.older = {}, self.known
            self.known[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        ids = self._stretch_ids
        return b"".join([self.known.get(s) or ids(s) for s in self.stretch.findall(self.normaliser.run(text))])

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        text = text.replace(MARK, " ") if self.escape else text
        return text[1:] if self.dummy and text.startswith(" ") else text


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """(doc_id, ids, n_bytes, decoded, round_trip) of every document; n_bytes counts ids of byte fallback."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fst = transducer(model)
        for rows in batches:
            for at in range(0, len(rows), 256):
                part = rows.iloc[at : at + 256]
                ids = [fst.encode(t) for t in part["t"]]
                decoded = [fst.decode(x) for x in ids]
                arrays = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": arrays, "n_bytes": [int(fst.is_byte[a].sum()) for a in arrays], "decoded": decoded, "round_trip": [a == b for a, b in zip(decoded, part["t"], strict=True)]})

    return docs.select("doc_id", whole(F.col(text)).alias("t")).mapInPandas(run, "doc_id long, ids array<int>, n_bytes long, decoded string, round_trip boolean")


def digests(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids_sha256, round_trip): what :func:`encode` finds, with the ids as the SHA-256 of
    their little-endian 32-bit form, made beside the path so that no array leaves the worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fst = transducer(model)
        for rows in batches:
            out = []
            for t in rows["t"]:
                ids = fst.encode(t)
                a = np.frombuffer(ids, "<u4")
                out.append((len(a), int(fst.is_byte[a].sum()), hashlib.sha256(ids).hexdigest(), fst.decode(ids) == t))
            found = pd.DataFrame(out, columns=["n_tokens", "n_bytes", "ids_sha256", "round_trip"])
            found.insert(0, "doc_id", rows["doc_id"].to_numpy())
            yield found

    return docs.select("doc_id", whole(F.col(text)).alias("t")).mapInPandas(run, "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
