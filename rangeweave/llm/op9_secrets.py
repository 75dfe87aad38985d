"""Secret scans by assignment-aware lexing.

Besides the base patterns (assign, access, hex), each text is read as source and configuration. A lexer sets comments
apart (``#`` and ``//`` to the end of the line, ``/* */``, ``<!-- -->``; not inside strings). ``name = expression``, ``name:
expression``, ``name: type = expression``, ``name := expression`` and ``name => expression`` give name-literal pairs, and so do
YAML block scalars, XML elements, and XML or JSON entries that say their name in one field and their value in another.
An expression is a chain of quoted literals (in one, three or backward quotes), bare words and names joined by ``+``. Names
assigned earlier in the text stand for their literals (constant propagation), so the literal behind ``KEY = "..."; password
= KEY`` is scored by ``password``; names assigned in a comment stand for nothing outside it. Chains have any number of
terms, and scores go back from name to name once, at the end of the text. A literal's score is that of the most sensitive
name it reaches, less ``COMMENTED`` in a comment, raised by its mix of characters, all of them counted; literals that score
``THRESHOLD`` or more become spans of kind ``named`` at the place they are written.

Edge cases: a null or empty text has no spans, counts of zero and the SHA-256 of the empty string. Repeated rows and
null ids give a row each; extra columns are not carried. Time is linear in a text's length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.llm.common import table, whole

KINDS = ("assign", "access", "hex", "named")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_BASE_NAMES = ("password", "passwd", "secret", "token")
_ASSIGN = re.compile(rf"""({"|".join(map(_either, _BASE_NAMES))}|{_either("api")}_?{_either("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
_HINTS = (*_BASE_NAMES, "key")

#: Name parts and the score of what is assigned to them, out of 100.
SENSITIVE = {"password": 70, "passwd": 70, "pwd": 60, "passphrase": 70, "secret": 70, "token": 60, "apikey": 70, "accesskey": 60, "privatekey": 70, "credential": 60, "auth": 50}
THRESHOLD = 70
MIN_LITERAL = 8
#: What a literal in a comment scores less.
COMMENTED = 10
_PLACEHOLDER = re.compile(r"(?i:change_?me|example|placeholder|none|null|true|false|todo)")
_NAME = re.compile(r"""(?<![A-Za-z0-9_.-])["']?([A-Za-z_][A-Za-z0-9_.-]*+)["']?[\x20\t]*+(?::=|=>|=(?!=)|:(?!:))[\x20\t]*+""")
_TERM = re.compile(
    r"""(?:"(?P<d>[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+)"|'(?P<s>[^'\\\n]*+(?:\\[^\n][^'\\\n]*+)*+)'|(?P<n>[A-Za-z_][A-Za-z0-9_]*+)(?![^\s;,)\]}+])|(?P<b>[^\s;,"'(){}\[\]]++))"""
)
_PLUS = re.compile(r"[\x20\t]*+\+[\x20\t]*+")
_TYPE = re.compile(r"[A-Za-z_][A-Za-z0-9_.\[\]|]*+[\x20\t]*+=(?![=>])[\x20\t]*+")
_OPENS = re.compile(r"""\"{3}|'{3}|["'`]|/\*|<!--|(?<!\S)(?:\#|//)""")
_CLOSES = {'"""': '"""', "'''": "'''", "`": "`", "/*": "*/", "<!--": "-->"}
_QUOTED = {'"': re.compile(r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'), "'": re.compile(r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'")}
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[\x20\t]*+(?:\#[^\n]*+)?\n")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>\s*+([^<>]*+)</\1\s*+>")
_ENTRY = re.compile(r"[<{][^<>{}]*+[>}]")
_FIELD = re.compile(r"""(?<![A-Za-z0-9_.:-])["']?(key|name|id|value)["']?\s*+[=:]\s*+(?:"([^"\n]*+)"|'([^'\n]*+)')""")


def comments(text: str) -> list[tuple[int, int]]:
    """Spans of the text's comments, in order. A quote or comment that isn't closed opens nothing."""
    found: list[tuple[int, int]] = []
    open_ended: set[str] = set()  # what isn't closed from some place on isn't looked for again
    at = 0
    while m := _OPENS.search(text, at):
        what, at = m[0], m.end()
        if what in ("#", "//"):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
            found.append((m.start(), at))
        elif what in _QUOTED:
            quoted = _QUOTED[what].match(text, m.start())
            at = quoted.end() if quoted else at
        elif what not in open_ended:
            end = text.find(_CLOSES[what], at)
            if end < 0:
                open_ended.add(what)
                continue
            at = end + len(_CLOSES[what])
            if what in ("/*", "<!--"):
                found.append((m.start(), at))
    return found


def _block(text: str, start: int, at: int) -> tuple[int, int] | None:
    """The span of a block scalar's lines, which are indented deeper than the line that ``start`` is in."""

    def indent(begin: int) -> int:
        k = begin
        while k < len(text) and text[k] == " ":
            k += 1
        return k - begin

    depth, first, last = indent(text.rfind("\n", 0, start) + 1), None, at
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if not text[at:end].isspace() and end > at:
            if indent(at) <= depth:
                break
            first, last = at + indent(at) if first is None else first, end
        at = end + 1
    return None if first is None else (first, last)


def _base(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place of the kind) of the base spans."""
    low = text.lower()
    found = []
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return found


def _sensitivity(name: str) -> int:
    plain = re.sub(r"[^a-z]", "", name.lower())
    return max((score for part, score in SENSITIVE.items() if part in plain), default=0)


def _mixes(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[tuple[int, int], int]]:
    """Each span and its literal's 0 to 30: bits of entropy per character, six of them being the most that count; -1 for a
    placeholder. Literals may end at one place, as those of ``a=b=c`` do: characters are counted from the end on, once."""
    counts: Counter[str] = Counter()
    last = (0, -1)
    for start, end in sorted(spans, key=lambda x: (x[1], -x[0])):
        if end != last[1]:
            counts, last = Counter(), (end, end)
        counts.update(text[start : last[0]])
        last = start, end
        n = end - start
        whole = text[start] in "<[{$%" or text[start : start + 5].lower() in ("your-", "your_")
        if len(counts) == 1 or whole and text.find("\n", start, end) < 0 or _PLACEHOLDER.fullmatch(text, start, end):
            yield (start, end), -1
        else:
            yield (start, end), round(5 * min(6.0, -sum(c / n * math.log2(c / n) for c in counts.values())))


def _fields(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
    """(name, span of the literal) of XML elements, and of entries with a name and a value in fields of their own."""
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            yield m[1], (m.start(2), m.start(2) + len(m[2].rstrip()))
    if "value" in text:
        for m in _ENTRY.finditer(text):
            name = value = None
            for f in _FIELD.finditer(text, m.start(), m.end()):
                if f[1] == "value":
                    value = f.span(2) if f[2] is not None else f.span(3)
                else:
                    name = f[2] or f[3] or name
            if name and value:
                yield name, value


def named_literals(text: str) -> list[tuple[int, int, int]]:
    """(start, end, score) of the literals that reach a sensitive name."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    apart = comments(text)
    starts = [a for a, _ in apart]

    def scope(at: int) -> int:
        """The comment that a place is in, -1 for none."""
        k = bisect_right(starts, at) - 1
        return k if k >= 0 and at < apart[k][1] else -1

    known: dict[tuple[int, str], int] = {}  # the last assignment of each name, by scope
    chains: list[tuple[int, list[tuple[int, int]], list[int]]] = []  # sensitivity, own literals, earlier assignments
    open_ended: set[str] = set()
    block_end, bare = 0, (0, 0)
    for m in _NAME.finditer(text):
        at, parts, names, where = m.end(), [], [], scope(m.start())
        if text[at - 1 : at] != "=" and (kind := _TYPE.match(text, at)) and ":" in m[0][len(m[1]) :]:
            at = kind.end()
        if m.start() >= block_end and _sensitivity(m[1]) and (head := _BLOCK.match(text, at)):
            span = _block(text, m.start(), head.end())
            if span:
                block_end = span[1]
                chains.append((_sensitivity(m[1]), [span], []))
                continue
        while True:
            quote = next((q for q in ('"""', "'''", "`") if text.startswith(q, at)), None)
            end = -1 if quote is None or quote in open_ended else text.find(quote, at + len(quote))
            if quote and end < 0:
                open_ended.add(quote)
            if end >= 0:
                parts.append((at + len(quote), end))
                at = end + len(quote)
            elif bare[0] < at < bare[1]:  # inside a bare word: the rest of it
                parts.append((at, bare[1]))
                at = bare[1]
            elif term := _TERM.match(text, at):
                if term["n"] is not None and (where, term["n"]) in known:
                    names.append(known[where, term["n"]])
                else:
                    group = next(g for g in "dsnb" if term[g] is not None)
                    parts.append(term.span(group))
                    bare = term.span("b") if group == "b" else bare
                at = term.end()
            else:
                break
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        if not parts and not names:
            continue
        known[where, m[1]] = len(chains)
        chains.append((_sensitivity(m[1]), parts, names))
    reached = [score for score, _, _ in chains]
    best: dict[tuple[int, int], int] = {}
    for k in range(len(chains) - 1, -1, -1):  # names stand for earlier assignments only, so all that reaches k is done
        score = reached[k]
        for j in chains[k][2]:
            reached[j] = max(reached[j], score)
        if score:
            for span in chains[k][1]:
                best[span] = max(best.get(span, 0), score)
    for name, span in _fields(text):
        if score := _sensitivity(name):
            best[span] = max(best.get(span, 0), score)
    able = [(a, b) for (a, b), score in best.items() if b - a >= MIN_LITERAL and score + 30 >= THRESHOLD]
    scored = [(*span, best[span] + mix - COMMENTED * (scope(span[0]) >= 0)) for span, mix in _mixes(text, able) if mix >= 0]
    return sorted((start, end, min(100, score)) for start, end, score in scored if score >= THRESHOLD)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, end, k in sorted(spans, key=lambda s: (s[0], s[2])))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for text in rows["t"]:
            base, named = _base(text), named_literals(text)
            n = Counter(k for _, _, k in base)
            spans = base + [(start, end, 3) for start, end, _ in named]
            out.append((n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(named), max((s for _, _, s in named), default=0)))
        found = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named", "top_score"])
        found.insert(0, "doc_id", rows["doc_id"].to_numpy())
        yield found


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per document: counts, digest of the base spans, all spans, and the best score of a named literal."""
    at = docs.select("doc_id", whole(F.col(text)).alias("t"))
    return at.mapInPandas(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long, top_score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
