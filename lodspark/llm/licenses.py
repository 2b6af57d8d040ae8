"""License scans: template markup compiled to automata over words.

A template is the wording of a license or of a notice, with two kinds of regions:
`<<beginOptional>>...<<endOptional>>` may be left out (regions may nest), and `<<var;words=a..b>>`
stands for a to b words of any kind, such as a holder's name. All other words are mandatory: a place
in a text is accepted only if it has each of them, in order, and nothing between.

The states of a template's automaton are the words that may come next, kept as the bits of a number;
reading a word keeps the states that take it, moves them on, and adds what may be left out from there.
Automata start only where the hash of two consecutive words is one that a template can begin with,
which one pass over hashed words finds; from there on words are compared, not hashes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spans_of, utf8
from .words import FOLD_BYTES, split_words, window_hashes, word_hashes

#: Bytes of text that are hashed together; words that are read at a time behind a candidate.
SLICE, AHEAD = 1 << 20, 32
#: Score of a text with a phrase only, and with a template.
PHRASE_SCORE, TEMPLATE_SCORE = 0.5, 1.0

#: Phrases that name a license, and their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Public wordings of licenses and of the notices that refer to them, by identifier.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;words=1..6>>
        <<beginOptional>>and associated documentation files<<endOptional>> <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction,
        including without limitation <<beginOptional>>on<<endOptional>> the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND <<var;words=1..2>>. IN NO EVENT SHALL <<var;words=1..20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""),
    ("mit", "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT <<beginOptional>>(Expat)<<endOptional>> license"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words=1..12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<var;words=0..1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<var;words=0..1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<var;words=0..1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<var;words=0..1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        <<var;words=0..1>> Neither the name of <<var;words=1..20>> may be used to endorse or promote products derived from this software without specific prior written permission"""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at <<var;words=1..8>> LICENSE 2.0<<endOptional>>"""),
    ("gpl-2.0", "GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2"),
    ("gpl-3.0", "GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"),
    ("lgpl-2.1", "GNU Lesser General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2.1"),
    ("lgpl-3.0", "GNU Lesser General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"),
    ("agpl-3.0", "GNU Affero General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> <<beginOptional>>v. 2.0<<endOptional>> <<beginOptional>>2.0<<endOptional>>"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons Attribution<<endOptional>> <<beginOptional>>CC BY<<endOptional>> 4.0"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC <<beginOptional>>license<<endOptional>> <<beginOptional>>version<<endOptional>> 4.0"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("cc0-1.0", "Creative Commons <<beginOptional>>Zero<<endOptional>> <<beginOptional>>CC0<<endOptional>> <<beginOptional>>v<<endOptional>> 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
OUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(_PLACE))])

_REGION = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)\.\.(\d+))>>")


def compiled(markup: str) -> tuple[list[bytes | None], list[tuple[int, int]]]:
    """The words of a template in order (None: any word) and the jumps (from, to) over what may be left out."""
    items: list[bytes | None] = []
    jumps, opened, at = [], [], 0
    for m in _REGION.finditer(markup):
        items += split_words(markup[at : m.start()].encode())
        at = m.end()
        if m[1] == "beginOptional":
            opened.append(len(items))
        elif m[1] == "endOptional":
            if not opened:
                raise ValueError(f"an optional region ends that never began: {markup[:80]}")
            jumps.append((opened.pop(), len(items)))
        else:
            least, most = int(m[2]), int(m[3])
            end = len(items) + most
            jumps += [(len(items) + k, end) for k in range(least, most)]
            items += [None] * most
    items += split_words(markup[at:].encode())
    if opened or not items:
        raise ValueError(f"an optional region never ends, or there are no words: {markup[:80]}")
    return items, jumps


class Automaton:
    """One template: sets of states as bits, state i waits for item i, the last state accepts."""

    def __init__(self, label: str, markup: str, template: bool):
        self.label, self.template = label, template
        items, jumps = compiled(markup)
        self.accept = 1 << len(items)
        over = defaultdict(list)
        for a, b in jumps:
            over[a].append(b)
        self.closure = [0] * (len(items) + 1)
        for k in range(len(items), -1, -1):  # jumps go forward only
            self.closure[k] = 1 << k
            for b in over[k]:
                self.closure[k] |= self.closure[b]
        self.any = sum(1 << k for k, x in enumerate(items) if x is None)
        self.takes: dict[bytes, int] = defaultdict(int)
        for k, x in enumerate(items):
            if x is not None:
                self.takes[x] |= 1 << k
        if self.closure[0] & (self.any | self.accept):
            raise ValueError(f"a template has to begin with a word of its own: {markup[:80]}")
        #: The first two words of what is accepted; None: any word, or no more.
        self.begins = set()
        for k in _bits(self.closure[0]):
            self.begins |= {(items[k], None if 1 << j == self.accept else items[j]) for j in _bits(self.closure[k + 1])}

    def longest(self, words: Iterator[bytes]) -> int:
        """Number of words of the longest accepted beginning, 0 for none."""
        states, best = self.closure[0], 0
        for n, word in enumerate(words, 1):
            took, states = states & (self.takes.get(word, 0) | self.any), 0
            for k in _bits(took):
                states |= self.closure[k + 1]
            if states & self.accept:
                best = n
            if not states & ~self.accept:
                break
        return best


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


class Scanner:
    """All automata, and the hashes of the words that they begin with."""

    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]):
        self.automata = [Automaton(label, markup, kind) for kind, told in ((False, phrases), (True, templates)) for label, markup in told]
        self.by_first: dict[bytes, list[Automaton]] = defaultdict(list)
        begins = set().union(*(a.begins for a in self.automata)) if self.automata else set()
        for a in self.automata:
            for first in {first for first, _ in a.begins}:
                self.by_first[first].append(a)
        of = lambda *words: word_hashes(np.frombuffer(b" ".join(words), np.uint8), np.array([0, len(b" ".join(words))]))[0]
        self.ones = np.unique(np.array([of(a)[0] for a, b in begins if b is None], np.uint64))
        self.twos = np.unique(np.array([window_hashes(of(a, b), 2)[0] for a, b in begins if b is not None], np.uint64))

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the words that a template may begin at."""
        at = [np.flatnonzero(_among(words, self.ones)), np.flatnonzero(_among(window_hashes(words, 2), self.twos))]
        return np.unique(np.concatenate(at))

    def places(self, text: bytes, starts: list[int], first: np.ndarray) -> list[tuple[str, bool, int, int]]:
        """Accepted places (label, template, start, length) among the candidate words `starts`; `first` has the first byte of each word."""
        found = []
        for i in starts:
            words = _ahead(text, first, i)
            head = next(words, b"")
            found += [(a.label, a.template, i, n) for a in self.by_first.get(head, ()) if (n := a.longest(_ahead(text, first, i)))]
        return found


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each hash is known: few are, and a table of their low bits says no first."""
    if not len(known) or not len(hashes):
        return np.zeros(len(hashes), bool)
    low = np.zeros(1 << 16, bool)
    low[known & np.uint64(0xFFFF)] = True
    found = low[hashes & np.uint64(0xFFFF)]
    maybe = np.flatnonzero(found)
    found[maybe] = known[np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)] == hashes[maybe]
    return found


def _ahead(text: bytes, first: np.ndarray, i: int) -> Iterator[bytes]:
    """The words of a text from word i on, read in small pieces: most automata stop soon."""
    while i < len(first):
        stop = min(i + AHEAD, len(first))
        yield from split_words(text[first[i] : first[stop] if stop < len(first) else len(text)])
        i = stop


def _word_starts(raw: np.ndarray) -> np.ndarray:
    word = np.frombuffer(raw.tobytes().translate(FOLD_BYTES), np.uint8) != 32
    word[1:] &= ~word[:-1].copy()
    return np.flatnonzero(word)


@lru_cache(4)
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(list(phrases), list(templates))


def find_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """`docs` with `n_words` and `places` (label, template, start, length): where phrases and templates are accepted, in words from 0.

    A phrase is a template without regions; `template` says which of the two lists it is from. From
    each start the longest accepted wording counts; places may overlap, and are sorted by start, label
    and length; a label twice at one start with equal length is one place. Words are runs of ASCII
    letters in lower case, digits and non-ASCII characters. Null and empty texts have no words and no
    places. Rows are looked at one by one: repeated rows and null ids stay as they are, an empty table
    gives an empty one. All columns pass through; those named like the new ones are replaced.
    """
    docs = docs.drop(*OUT.names)
    names = [*docs.columns, *OUT.names]
    key = tuple(phrases), tuple(templates)
    _scanner(*key)  # faults in a template are the driver's
    kind = pa.list_(pa.struct([("label", pa.string()), ("template", pa.bool_()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*key)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in spans_of(offsets, SLICE):
                words, first = word_hashes(data, offsets[low : high + 1])
                places = [[] for _ in range(high - low)]
                at = scanner.candidates(words)
                of = np.searchsorted(first, at, "right") - 1
                edge = np.flatnonzero(np.diff(of, prepend=-1))
                for a, b in zip(edge, np.append(edge, len(at))[1:], strict=True):
                    d = int(of[a])
                    raw = data[offsets[low + d] : offsets[low + d + 1]]
                    told = scanner.places(raw.tobytes(), (at[a:b] - first[d]).tolist(), _word_starts(raw))
                    places[d] = [dict(zip(_PLACE.names, p, strict=True)) for p in sorted(set(told), key=lambda p: (p[2], p[0], p[3], p[1]))]
                arrays = [*batch.slice(low, high - low).columns, pa.array(np.diff(first).astype(np.int64)), pa.array(places, kind)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *OUT.fields]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: phrases and templates of licenses in every whole text; the score says whether a whole template is there, or a phrase only."""
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("places", lambda p: ~p["template"])
    found = found.select("doc_id", "n_words", "places", base.alias("base"))
    labels: Callable = lambda x: F.array_join(F.array_sort(F.array_distinct(F.col(x)["label"])), ",")
    score = F.when(F.exists("places", lambda p: p["template"]), TEMPLATE_SCORE).when(F.size("base") > 0, PHRASE_SCORE).otherwise(0.0)
    starts = F.col("base")["start"]
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels("base").alias("base_labels"), labels("places").alias("labels"), score.alias("score"))


def pattern(markup: str) -> str:
    """A template as a regular expression over ` word word ... word `: what the automaton accepts, said in another way for SQL."""
    out, at = [""], 0
    plain = lambda s: "".join(" " + w.decode() for w in split_words(s.encode()))
    for m in _REGION.finditer(markup):
        out[-1] += plain(markup[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            out.append("")
        elif m[1] == "endOptional":
            inner = out.pop()
            out[-1] += f"(?:{inner})?"
        else:
            out[-1] += f"(?: [^ ]+){{{m[2]},{m[3]}}}"
    return out[0] + plain(markup[at:]) + " "


def _oracle() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    base = []
    for label, phrase in PHRASES:
        same = " AND ".join(f"w[i + {k}] = '{x.decode()}'" for k, x in enumerate(split_words(phrase.encode()), 1))
        base.append(f"[{{'label': '{label}', 'at': i}} FOR i IN range(len(w)) IF {same}]")
    more = [f"CASE WHEN regexp_matches(s, '{pattern(t)}') THEN ['{label}'] ELSE [] END" for label, t in TEMPLATES]
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {" || ".join(base)} AS base FROM d),
m AS (SELECT *, {" || ".join(more)} AS more FROM b)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base,
       CAST(list_min([x.at FOR x IN base]) AS BIGINT) AS first_word, CAST(list_max([x.at FOR x IN base]) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct([x.label FOR x IN base])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct([x.label FOR x IN base] || more)), ',') AS labels,
       CAST(CASE WHEN len(more) > 0 THEN {TEMPLATE_SCORE} WHEN len(base) > 0 THEN {PHRASE_SCORE} ELSE 0 END AS DOUBLE) AS score
FROM m
"""


ORACLE = _oracle()
