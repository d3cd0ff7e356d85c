"""Terms and their context in one note, in time that grows with its text.

Runs inside tasks over batches of notes. Terms are found word by word: a word that begins a term leads on to longer ones as long as a term goes on
like the text. Cues of a sentence are listed once, in order; what holds for a mention follows from the nearest cues before and
behind it by binary search, so a sentence of many mentions costs no more a mention than one of few.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

from cohortloom.functions import assertion as ctx

_WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _joins_word(text: str, at: int) -> bool:
    """Whether the character there belongs to the word beside it: a letter, a digit, an underscore or a mark that is set on a letter."""
    return 0 <= at < len(text) and (_in_word(text[at]) or unicodedata.category(text[at])[0] == "M")


def _gap(text: str) -> str:
    return " " if text.isspace() else text


class Lexicon:
    """Terms by their words. A term without any letter or digit is left out; any run of white space equals any other."""

    def __init__(self, terms: Iterable[str]):
        # The words of a term so far -> the terms that end there, as (what stands before its first word, what stands behind its last, the term).
        self.nodes: dict[str, list[tuple[str, str, str]]] = {}
        self.first: set[str] = set()
        for term in terms:
            low = fold(term)
            words = [m.span() for m in _WORD.finditer(low)]
            if not words:
                continue
            key = low[slice(*words[0])]
            self.first.add(key)
            for (_, before), (start, end) in zip(words, words[1:]):
                self.nodes.setdefault(key, [])
                key += _gap(low[before:start]) + low[start:end]
            self.nodes.setdefault(key, []).append((low[: words[0][0]], low[words[-1][1] :], term))

    def places(self, low: str) -> list[int]:
        """Where words stand with which a term may begin."""
        first, out, at = self.first, [], 0
        for word in [word for word in _WORD.findall(low) if word in first]:
            # The next place where it stands by itself and not within another word.
            while True:
                at = low.index(word, at)
                end = at + len(word)
                if not (at and _in_word(low[at - 1])) and not (end < len(low) and _in_word(low[end])):
                    break
                at += 1
            out.append(at)
            at = end
        return out

    def find(self, low: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, term) from left to right without overlaps, at each place the longest term; edges of letters or digits are edges of words."""
        words = [m.span() for m in _WORD.finditer(low)]
        until = 0
        for i, (start, end) in enumerate(words):
            key = low[start:end]
            if start < until or key not in self.first:
                continue
            best, last = None, i
            while (ending := self.nodes.get(key)) is not None:
                end = words[last][1]
                for lead, tail, term in ending:
                    a, b = start - len(lead), end + len(tail)
                    if a < until or low[a:start] != lead or low[end:b] != tail:
                        continue
                    if (not lead and _joins_word(low, start - 1)) or ((not tail or tail[-1].isalnum()) and _joins_word(low, b)):
                        continue
                    if best is None or (a, -b) < (best[0], -best[1]):
                        best = (a, b, term)
                last += 1
                if last == len(words):
                    break
                key += _gap(low[words[last - 1][1] : words[last][0]]) + low[slice(*words[last])]
            if best is not None:
                yield best
                until = best[1]


class _Spans:
    """Matches of a pattern in a sentence, in order."""

    def __init__(self, pattern: re.Pattern, text: str, without: _Spans | None = None):
        found = [m.span() for m in pattern.finditer(text)]
        if without is not None and without.starts:
            found = [span for span in found if not without.holds(*span)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    def holds(self, start: int, end: int) -> bool:
        """Whether one match holds the whole range."""
        at = bisect_right(self.starts, start) - 1
        return at >= 0 and self.ends[at] >= end

    def last_end(self, before: int) -> int:
        at = bisect_right(self.ends, before) - 1
        return self.ends[at] if at >= 0 else 0

    def next_start(self, after: int, otherwise: int) -> int:
        at = bisect_left(self.starts, after)
        return self.starts[at] if at < len(self.starts) else otherwise

    def between(self, start: int, end: int) -> bool:
        """Whether the last match that ends before `end` begins behind `start`."""
        at = bisect_right(self.ends, end) - 1
        return at >= 0 and self.starts[at] >= start

    def follows(self, start: int, latest: int, end: int) -> bool:
        """Whether the first match from `start` on begins no later than `latest` and ends by `end`."""
        at = bisect_left(self.starts, start)
        return at < len(self.starts) and self.starts[at] <= latest and self.ends[at] <= end


_NONE = _Spans(re.compile("x"), "")


class Context:
    """The cues of one sentence."""

    def __init__(self, sentence: str, section: str):
        self.length, self.section = len(sentence), section
        words = set(_WORD.findall(fold(sentence)))
        spans: dict[str, _Spans] = {}
        for name, pattern in ctx.CUES.items():  # kinds that make others void come before those
            possible = name not in ctx.CUE_WORDS or not ctx.CUE_WORDS[name].isdisjoint(words)
            spans[name] = _Spans(pattern, sentence, spans.get(ctx.VOID_INSIDE.get(name))) if possible else _NONE
        self.spans = spans

    def of(self, start: int, end: int) -> tuple[bool, str, str, str]:
        """negation, certainty, temporality and subject of the mention there."""
        spans = self.spans
        left, right = spans["clause"].last_end(start), spans["clause"].next_start(end, self.length)
        stop, dot = (spans[name].next_start(end, right) for name in ("stop", "dot"))
        before = lambda name, since=left: spans[name].between(since, start)
        behind = lambda name, latest=stop: spans[name].follows(end, latest, right)
        negated = before("negated_before", max(left, spans["asserting"].last_end(start))) or behind("negated_after") or self.section.startswith(ctx.NEGATIVE_SECTION)
        family = before("family") or behind("family_after", dot) or ctx.FAMILY_SECTION in self.section
        if negated:
            certainty = "negated"
        elif before("hypothetical_before") or behind("hypothetical_after"):
            certainty = "hypothetical"
        else:
            certainty = "uncertain" if before("uncertain_before") or behind("uncertain_after") else "positive"
        if family:
            return negated, certainty, "family", "family"
        historical = before("historical_before") or behind("historical_after")
        return negated, certainty, "historical" if historical else "current", "other" if before("other_person") else "patient"


def sentences(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, section heading) of every sentence."""
    starts = sorted({0, *(m.start() for m in ctx.SECTION_START.finditer(text)), len(text)})
    for start, end in zip(starts, starts[1:]):
        heading = ctx.HEADING.match(text, start, end)
        section = heading.group().strip(" ") if heading else ""
        at = start
        for mark in ctx.SENTENCE_END.finditer(text, start, end):
            yield at, mark.end(), section
            at = mark.end()
        if at < end:
            yield at, end, section


def mentions(text: str, lexicon: Lexicon) -> Iterator[tuple]:
    """(term, text, start, end, negation, certainty, temporality, subject) of every mention; places count characters."""
    low = fold(text)
    places = lexicon.places(low)
    if not places:
        return
    at = 0
    for start, end, section in sentences(text):
        if at == len(places):
            return
        if places[at] >= end:
            continue
        at = bisect_left(places, end, at)
        context = None
        for a, b, term in lexicon.find(low[start:end]):
            context = context or Context(text[start:end], section)
            yield (term, text[start + a : start + b], start + a, start + b, *context.of(a, b))
