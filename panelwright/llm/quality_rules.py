"""Quality rules as a short-circuit cascade.

Counts that every verdict reports are taken in one pass over the words of a text, whatever the rules say. The rules
run as a cascade: a document that passes the base rule leaves at the first rule that rejects it. A hash sample of
documents that pass the base rule gives each rule's cost (seconds a document) and selectivity (share it rejects, of
those that the rules before it keep); the next rule is that of the most rejections per second. The order changes
only the work and which rule is named in rejected_by: a document is kept if no rule rejects it.

Defined results: a null or empty text has no words and fails the base rule. Lines are split at \\n; a
line without a word is no duplicate. A letter is a code point of Unicode's category L. Only key and text are read;
other columns are dropped by `quality_verdicts`. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import map_arrow, texts_of

#: The symbols that the symbol rule counts.
SYMBOLS = "#*$%&|<>"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Documents, about, whose rule costs and selectivities are measured.
SAMPLE_DOCUMENTS = 500
#: Characters of a text of that sample at most.
SAMPLE_CHARS = 20_000


#: The columns of the counts, all of whole texts.
COUNT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Document:
    text: str
    words: list[str]
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


@dataclass(frozen=True)
class Rule:
    """rejects(document) is true for a document that has to go."""

    name: str
    rejects: Callable[[Document], bool]


def _few_distinct(d: Document) -> bool:
    return 100 * len(set(d.words)) < 10 * min(d.n_words, 1000)


def _has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def _few_alphabetic(d: Document) -> bool:
    return 100 * sum(map(_has_letter, d.words)) < 70 * d.n_words


#: Every rule is a comparison of integers, so that SQL states it exactly.
RULES = (
    Rule("alphabetic_words", _few_alphabetic),
    Rule("distinct_words", _few_distinct),
    Rule("mean_word_length", lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 15 * d.n_words),
    Rule("duplicate_lines", lambda d: d.n_dup_lines >= 3 and 100 * d.n_dup_lines > 30 * d.n_lines),
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
)


def repeated_positions(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of width words found at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == n:
        return 0
    seen, again = set(), set()
    for w in windows:
        (again if w in seen else seen).add(w)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if w in again:
            covered += i + width - max(i, upto)
            upto = i + width
    return covered


def read(text: str) -> Document:
    words = _WORDS.findall(text)
    seen, dup, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if line and _WORDS.search(line):
            n_lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return Document(text, words, sum(map(len, words)), sum(map(text.count, SYMBOLS)), n_lines, dup, repeated_positions(words))


def measure(found: list[Document], rule: Rule) -> tuple[list[Document], float]:
    """(the documents that the rule keeps, the seconds it took)."""
    began = time.perf_counter()
    kept = [d for d in found if not rule.rejects(d)]
    return kept, time.perf_counter() - began


def ordered(rules: tuple[Rule, ...], found: list[Document], measure: Callable = measure) -> list[Rule]:
    """rules, the next always that with the most rejections a second of the documents that are left; ties keep their order."""
    left, out = list(rules), []
    while left:
        tried = [measure(found, rule) for rule in left]
        rates = [(len(found) - len(kept)) / max(seconds, 1e-9) for kept, seconds in tried]
        best = rates.index(max(rates))
        out.append(left.pop(best))
        found = tried[best][0]
    return out


def sample_of(docs: DataFrame, key: str, text: str, size: int, longest: int) -> list[str]:
    """About size whole texts of at most longest characters, chosen by a hash of their key and length over all rows."""
    share = size / max(size, docs.count())
    drawn = F.pmod(F.xxhash64(key, F.length(text)), F.lit(1 << 30)) < int(share * (1 << 30))
    return [r[0] for r in docs.filter(drawn & (F.length(text) <= longest)).select(text).limit(4 * size).collect()]


def quality_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE_DOCUMENTS, longest: int = SAMPLE_CHARS) -> DataFrame:
    """One row per document: the counts, base_failed, kept and the rule of the cascade that rejected it.

    sample and longest bound the whole texts that the rules' order is measured on; kept doesn't depend on the order.
    """
    docs = docs.select(key, text)
    passed = [d for d in map(read, sample_of(docs, key, text, sample, longest)) if not d.base_failed]
    cascade = ordered(rules, passed)

    def rows(batch):
        found = [read(t) for t in texts_of(batch, text)]
        first = ["base" if d.base_failed else next((r.name for r in cascade if r.rejects(d)), None) for d in found]
        longs = [pa.array([getattr(d, n) for d in found], pa.int64()) for n in COUNT_COLUMNS]
        flags = [pa.array([d.base_failed for d in found], pa.bool_()), pa.array([f is None for f in first], pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column(key), *longs, *flags, pa.array(first, pa.string())], names=[key, *COUNT_COLUMNS, "base_failed", "kept", "rejected_by"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs, rows, ", ".join([f"`{key}` {kind}", *[f"{n} bigint" for n in COUNT_COLUMNS], "base_failed boolean, kept boolean, rejected_by string"]))
