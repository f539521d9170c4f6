"""License scans with a generalised suffix automaton (operator 2).

The automaton holds the words of all templates. A file is streamed through it word by word; the state gives
the longest template passage that ends at each word (matching statistics). Maximal matches are chained, template by template
and in template order, into spans, and a span that covers enough of its template is a finding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ._common import flagged, read, unflagged

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label -> notices, in words. Wording of well-known public notices; a label may have several.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "cc-by-4.0": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "proprietary": ("all rights reserved",),
}
MIN_MATCH = 3
MAX_GAP = 8
MIN_COVER = 0.8

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word-id sequences; every state knows where in which sequence it first and last occurs."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].add((k, i))
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def matches(self, ids: list[int], offset: int, least: int) -> list[tuple[int, int, int]]:
        """Maximal matches of at least `least` words: (start, length, state); matching statistics are kept on the fly."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        out = []
        for i, c in enumerate(ids):
            grown = c in nxt[v]
            if not grown and n >= least:
                out.append((offset + i - n, n, v))
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
        if n >= least:
            out.append((offset + len(ids) - n, n, v))
        return out


class Scanner:
    """Base phrases and templates, ready to scan texts."""

    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, tuple[str, ...]] = TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        notices = [(label, words(t)) for label, ts in templates.items() for t in ts]
        self.base = [(words(p), label) for p, label in base.items()]
        vocabulary = sorted({w for _, ws in notices for w in ws} | {w for ws, _ in self.base for w in ws})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.base_ids = [([self.ids[w] for w in ws], label) for ws, label in self.base]
        self.labels, self.sizes = [label for label, _ in notices], [len(ws) for _, ws in notices]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in ws] for _, ws in notices])
        self.least, self.max_gap, self.min_cover = min_match, max_gap, min_cover

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans); spans: (label, first word, last word, cover)."""
        ws = words(text)
        get = self.ids.get
        known = np.fromiter((get(w, 0) for w in ws), np.int32, len(ws))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (known > 0).astype(np.int8), [0]))))
        starts, found, hits = [], set(), []
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi - lo < 2:
                continue
            ids = known[lo:hi].tolist()
            for phrase, label in self.base_ids:
                n = len(phrase)
                if n <= hi - lo and phrase[0] in ids:
                    at = [lo + i for i in range(hi - lo - n + 1) if ids[i : i + n] == phrase]
                    if at:
                        starts += at
                        found.add(label)
            if hi - lo >= self.least:
                hits += self.automaton.matches(ids, lo, self.least)
        spans = self._chain(hits)
        score = max([s[3] for s in spans], default=1.0 if starts else 0.0)
        labels = found | {s[0] for s in spans}
        return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found)), ",".join(sorted(labels)), float(min(1.0, max(score, 1.0 if starts else 0.0))), spans

    def _chain(self, hits: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chain matches that follow each other in the file and in one template; keep chains that cover enough of it."""
        chains: dict[int, list[list[int]]] = {}
        open_: dict[int, list[list[int]]] = {}
        for start, n, state in hits:  # starts never fall, so a chain that ended too far before one of them can't grow any more
            for k, end in sorted(self.automaton.ends[state]):
                first = end - n + 1
                own = open_[k] = [c for c in open_.get(k, ()) if start - c[1] <= self.max_gap]
                for c in reversed(own):  # [first word, word after the last, template words used up to, words covered]
                    skip = max(0, c[1] - start, c[2] - first)
                    if skip < n and first + skip - c[2] <= self.max_gap:
                        c[1], c[2], c[3] = start + n, end + 1, c[3] + n - skip
                        break
                else:
                    own.append([start, start + n, end + 1, n])
                    chains.setdefault(k, []).append(own[-1])
        return sorted({(self.labels[k], c[0], c[1] - 1, min(1.0, c[3] / self.sizes[k])) for k, own in chains.items() for c in own if c[3] / self.sizes[k] >= self.min_cover}, key=lambda s: (s[1], s[0], s[2], s[3]))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,cover:double>>"


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Findings of every whole text of docs (doc_id, text), a row per row.

    A null or empty text has no words, no findings, empty labels and score 0. The automaton is built from the templates alone, so its size doesn't
    depend on the corpus; texts never leave their task and nothing is shuffled.
    """
    scanner = scanner or Scanner()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [scanner.scan(t) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            for c in ("first_word", "last_word"):
                out[c] = pd.array(out[c], dtype="Int64")
            out["spans"] = [[dict(zip(("label", "first_word", "last_word", "cover"), s)) for s in r] for r in out["spans"]]
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            out["__null"] = pdf["__null"].to_numpy()
            yield out

    return unflagged(flagged(docs).mapInPandas(run, f"{SCHEMA}, __null boolean"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
