"""License scan by template matching.

A template is license wording with markup: `<<beginOptional>> .. <<endOptional>>` may be left out, `<<var;name="x";words="a-b">>` stands for a to b
words of any kind, `<<choice;of="x|y">>` for one of some wordings. Templates are compiled into one automaton over words, made deterministic as it is used. A place in a text matches if
the mandatory wording stands there exactly, with optional parts present or absent and replaceable parts filled.
Texts are scanned whole inside Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LETTERS, as_bytes
from .license_texts import TEMPLATES

#: Fixed by the task: words that stand consecutively, and the label of each such place.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

MARK = re.compile(r'<<(beginOptional|endOptional|var;name="[^"]*";words="(\d+)-(\d+)"|choice;of="([^"]*)")>>')


def words_of(text: str) -> list[str]:
    return [w.decode() for w in LETTERS.findall(text.encode().lower())]


def parse(template: str) -> list:
    """A list of words, ("optional", list), ("any", least, most) and ("choice", lists)."""
    stack, at = [[]], 0
    for m in MARK.finditer(template):
        stack[-1].extend(words_of(template[at : m.start()]))
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError(f"optional part ends before it begins: {template}")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif m[4] is not None:
            stack[-1].append(("choice", [words_of(x) for x in m[4].split("|")]))
        else:
            stack[-1].append(("any", int(m[2]), int(m[3])))
    if len(stack) > 1:
        raise ValueError(f"optional part does not end: {template}")
    return [*stack[0], *words_of(template[at:])]


def expression(parts: list) -> str:
    """The same wording as a regular expression over words that are each followed by a space."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(f"{p} ")
        elif p[0] == "optional":
            out.append(f"(?:{expression(p[1])})?")
        elif p[0] == "choice":
            out.append(f"(?:{'|'.join(expression(x) for x in p[1])})")
        else:
            out.append(f"(?:[^ ]+ ){{{p[1]},{p[2]}}}")
    return "".join(out)


@dataclass
class Automaton:
    """Word automaton of many templates. States of the deterministic form are sets of positions, made when first reached."""

    edges: list[dict[str | None, set[int]]] = field(default_factory=list)  # by state and word; None: any word
    free: list[set[int]] = field(default_factory=list)
    accepts: dict[int, str] = field(default_factory=dict)

    def _new(self) -> int:
        self.edges.append({})
        self.free.append(set())
        return len(self.edges) - 1

    def _chain(self, parts: list, at: int) -> int:
        for p in parts:
            if isinstance(p, str):
                new = self._new()
                self.edges[at].setdefault(p, set()).add(new)
                at = new
            elif p[0] == "optional":
                end = self._chain(p[1], at)
                skip = self._new()
                self.free[end].add(skip)
                self.free[at].add(skip)
                at = skip
            elif p[0] == "choice":
                end = self._new()
                for x in p[1]:
                    self.free[self._chain(x, at)].add(end)
                at = end
            else:
                end = self._new()
                for i in range(p[2] + 1):
                    if i >= p[1]:
                        self.free[at].add(end)
                    if i < p[2]:
                        new = self._new()
                        self.edges[at].setdefault(None, set()).add(new)
                        at = new
                at = end
        return at

    @classmethod
    def of(cls, templates) -> Automaton:
        out = cls()
        start = out._new()
        for label, text in templates:
            first = out._new()
            out.free[start].add(first)
            out.accepts[out._chain(parse(text), first)] = label
        out.start = out._closed({start})
        out.known = {}
        return out

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def step(self, state: frozenset[int], word: str) -> frozenset[int]:
        reached: set[int] = set()
        for s in state:
            reached |= self.edges[s].get(word, set()) | self.edges[s].get(None, set())
        return self._closed(reached)

    def first_words(self) -> set[str]:
        found = set().union(*(self.edges[s].keys() for s in self.start))
        if None in found:
            raise ValueError("a template has to begin with wording, not with a replaceable part")
        return found

    def labels(self, state: frozenset[int]) -> set[str]:
        return {self.accepts[s] for s in state if s in self.accepts}

    def match(self, words: list[str], start: int) -> list[tuple[str, int, int]]:
        """Labels accepted from `start`, each with its longest span."""
        state, longest = self.start, {}
        for end in range(start, len(words)):
            key = (state, words[end] if any(words[end] in self.edges[s] for s in state) else None)
            if key not in self.known:
                after = self.step(*key) if key[1] is not None else self.step(state, "")
                self.known[key] = (after, self.labels(after))
            state, found = self.known[key]
            if not state:
                break
            for label in found:
                longest[label] = end + 1
        return [(label, start, end) for label, end in longest.items()]


def scan(docs: DataFrame, templates=TEMPLATES, base=None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    `score` is 1 if a template is accepted somewhere, 0.5 if only a base phrase stands there, else 0. `spans` lists (label, start, end) of every accepted template, in words.
    A null text is an empty one: no words, no places (first_word and last_word null), empty label texts, score 0. Repeated rows give repeated results;
    other columns are not read; an empty table gives no rows.
    """
    base = BASE if base is None else base
    phrases = [(f" {p} ".encode(), label) for p, label in base.items()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton.of(templates)
        starts = re.compile(rb" (?:" + b"|".join(re.escape(w.encode()) for w in sorted(machine.first_words())) + rb")(?= )")
        for batch in batches:
            out = [[] for _ in range(8)]
            for text in as_bytes(batch.column("text")):
                found = LETTERS.findall(text.lower())
                line = b" " + b" ".join(found) + b" " if found else b""
                places, labels = [], set()
                for phrase, label in phrases:
                    at = line.find(phrase)
                    while at >= 0:
                        places.append(line.count(b" ", 0, at + 1) - 1)
                        labels.add(label)
                        at = line.find(phrase, at + 1)
                spans, words = [], None
                for m in starts.finditer(line):
                    if words is None:
                        words = [w.decode() for w in found]
                    spans.extend(machine.match(words, line.count(b" ", 0, m.start() + 1) - 1))
                own = labels | {s[0] for s in spans}
                values = (len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(own)),
                          1.0 if spans else 0.5 if labels else 0.0, [{"label": a, "start": b, "end": c} for a, b, c in spans])
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, t) for x, t in zip(out, kinds)]], names=["doc_id", *NAMES])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(find, schema)


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def scan_sql() -> str:
    """The scan's columns, without spans, as DuckDB SQL over `documents`."""
    def places(phrase: str) -> str:
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        return f"list_filter(range(1, len(w) + 1), lambda i: {same})"

    labels = {label: [] for label, _ in TEMPLATES}
    for label, text in TEMPLATES:
        labels[label].append(f"regexp_matches(line, ' {expression(parse(text))}')")
    tests = {label: f"len({places(p)}) > 0" for p, label in BASE.items()}
    every = tests | {label: f"({' OR '.join(x)})" for label, x in labels.items()}
    text_of = lambda found: "coalesce(array_to_string([" + ", ".join(f"CASE WHEN {found[k]} THEN '{k}' END" for k in sorted(found)) + "], ','), '')"
    own = " OR ".join(f"({' OR '.join(x)})" for x in labels.values())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = "list_concat(" + ", list_concat(".join(places(p) for p in list(BASE)[:-1]) + f", {places(list(BASE)[-1])}" + ")" * (len(BASE) - 1)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
l AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d),
p AS (SELECT *, {at} AS spots FROM l)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, CAST(list_min(spots) - 1 AS BIGINT) AS first_word, CAST(list_max(spots) - 1 AS BIGINT) AS last_word,
  {text_of(tests)} AS base_labels, {text_of(every)} AS labels, CASE WHEN {own} THEN 1.0::DOUBLE WHEN len(spots) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM p"""
