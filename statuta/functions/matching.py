"""Many patterns over a text in one reading: an Aho-Corasick automaton of the literals that they can't do without.

A pattern's regular expression runs only over texts in which one of its literals was met, at word edges where the pattern asks
for them. A pattern that is nothing but a literal between word edges is counted by the automaton itself. Letters are matched in
any case, as ``re.IGNORECASE`` does: the automaton reads the text in lower case, with the few letters that match an ASCII one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick

# Letters beyond ASCII that match i, i and s in any case (the Kelvin sign becomes k in lower case).
_LIKE_ASCII = {0x130: "i", 0x131: "i", 0x17F: "s"}
_ODD = re.compile("[İıſ]")
_TOKEN = re.compile(r"(?P<edge>\\b)|(?P<any>\\[dsw]|\[[^\]]*\]|\((?:\\.|[^()])*\)|\.)|\\?(?P<char>.)", re.DOTALL)
_REPEAT = re.compile(r"[?*+]|\{\d*,?\d*\}")


def normal(text: str) -> str:
    """Lower case, in which what matches in any case is equal; as long as the text."""
    return (text.translate(_LIKE_ASCII) if _ODD.search(text) else text).lower()


def literals(pattern: str) -> list[tuple[str, bool, bool, bool]]:
    """(literal, edge before, edge after, whether that is all) of which every match holds one.

    The longest run of plain characters counts; a plain character that may be left out makes two literals if it is in that run.
    Patterns may use word edges, classes, groups without alternatives inside and repeats.
    """
    runs: list[list[str]] = [[]]  # parts: "\\b", a character, or a character and "?"
    at = 0
    while at < len(pattern):
        m = _TOKEN.match(pattern, at)
        repeat = _REPEAT.match(pattern, m.end())
        at = repeat.end() if repeat else m.end()
        if m["edge"]:
            runs[-1].append("\\b")
        elif m["char"] and (repeat is None or repeat[0] == "?"):
            runs[-1].append(m["char"] + ("?" if repeat else ""))
        else:
            runs.append([])
    run = max(runs, key=lambda r: sum(len(x) == 1 for x in r))
    before, after = run[:1] == ["\\b"], run[-1:] == ["\\b"]
    found = [""]
    for part in run:
        if part != "\\b":
            found = [x + part[0] for x in found] + (found if part.endswith("?") else [])
    return [(normal(x), before, after, len(runs) == 1 and before and after) for x in dict.fromkeys(found) if x]


class Matcher:
    """Numbers of matches of ``patterns``, in any case, and what else their expressions find."""

    def __init__(self, patterns: Sequence[str]):
        self.expressions = [re.compile(p, re.IGNORECASE) for p in patterns]
        self.automaton, held = ahocorasick.Automaton(), {}
        for i, p in enumerate(patterns):
            for literal, before, after, whole in literals(p):
                held.setdefault(literal, []).append((i, before, after, whole))
            if not literals(p):
                raise ValueError(f"no literal in {p}")
        for literal, owners in held.items():
            self.automaton.add_word(literal, (len(literal), owners))
        self.automaton.make_automaton()

    def met(self, text: str) -> tuple[dict[int, int], set[int]]:
        """Matches of the patterns that are literals, and patterns that may match."""
        low, counts, maybe = normal(text), {}, set()
        word = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
        for end, (size, owners) in self.automaton.iter(low):
            start = end - size
            left = right = None
            for i, before, after, whole in owners:
                if before:
                    left = word(start) != word(start + 1) if left is None else left
                    if not left:
                        continue
                if after:
                    right = word(end) != word(end + 1) if right is None else right
                    if not right:
                        continue
                if whole:
                    counts[i] = counts.get(i, 0) + 1
                else:
                    maybe.add(i)
        return counts, maybe

    def counts(self, text: str) -> dict[int, int]:
        """Of each pattern that matches, how often."""
        counts, maybe = self.met(text)
        for i in maybe:
            if i not in counts and (n := sum(1 for _ in self.expressions[i].finditer(text))):
                counts[i] = n
        return counts


@lru_cache(maxsize=32)
def matcher(patterns: tuple[str, ...]) -> Matcher:
    """Made once in a worker."""
    return Matcher(patterns)
