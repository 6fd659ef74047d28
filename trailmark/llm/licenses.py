"""License scans by an exact set-similarity join of text blocks and license templates.

Tokens are ordered by how many documents hold them, rarest first. A block that holds at least the
threshold's share of a template's tokens must hold one of the template's first few (prefix filter),
must have enough different tokens (length filter), and after the first match enough must be left on
both sides (positional filter). What passes is verified, so every block that meets the threshold is
found.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import flat_texts, map_texts, table

THRESHOLD = 0.8  # share of a template's different tokens that a block must hold
BLOCK, STRIDE = 64, 32  # words; a passage of up to 33 words lies whole in some block

# Phrases and labels that a scan must report wherever they stand.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Sentences of widely used public license notices, with the label they give.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance "
     "with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
     "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the "
     "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without "
     "fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring "
     "rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Words after lower-casing A-Z: runs of digits, a-z and non-ASCII characters."""
    return _WORD.findall(text.lower())


def document_counts(docs: DataFrame, tokens: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each of ``tokens`` occurs; one row per token reaches the driver."""

    def work(batches) -> Iterator[dict]:
        count: Counter = Counter()
        for _, texts in batches:
            for t in texts:
                count.update(tokens.intersection(words_of(t)))
        yield {"token": list(count), "n": list(count.values())}

    rows = flat_texts(docs, [], "token binary, n long", work).groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


class Scanner:
    """Templates with their tokens in global order, ready to meet blocks."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        sets = [(label, set(text.encode().split())) for label, text in templates]
        vocabulary = sorted(set().union(*[s for _, s in sets]), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.templates = []  # label, ranks in order, overlap needed
        self.prefix: dict[int, list[tuple[int, int]]] = {}  # rank -> (template, position)
        for label, s in sets:
            ranks = sorted(self.rank[w] for w in s)
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            number = len(self.templates)
            self.templates.append((label, ranks, need))
            for position, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefix.setdefault(r, []).append((number, position))
        self.first = frozenset(vocabulary[r] for r in self.prefix)

    def blocks(self, words: list[bytes]) -> Iterator[tuple[int, str, float]]:
        """(first word, label, containment) of every block and template at or over the threshold."""
        if self.first.isdisjoint(words):
            return
        rank, prefix = self.rank, self.prefix
        starts = sorted(
            {
                k * STRIDE
                for i, w in enumerate(words)
                if w in self.first
                for k in (i // STRIDE - 1, i // STRIDE)
                if k >= 0
            }
        )
        for start in starts:
            block = set(words[start : start + BLOCK])
            held = sorted(rank[w] for w in block if w in rank)
            tried = set()
            for at, r in enumerate(held):
                for number, position in prefix.get(r, ()):
                    if number in tried:
                        continue
                    tried.add(number)
                    label, ranks, need = self.templates[number]
                    if len(block) < need:
                        continue
                    if 1 + min(len(ranks) - position - 1, len(held) - at - 1) < need:
                        continue
                    overlap = len(set(ranks).intersection(held))
                    if overlap >= need:
                        yield start, label, overlap / len(ranks)


def phrase_places(words: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after another."""
    found = []
    for phrase, label in phrases.items():
        size, at = len(phrase), -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if tuple(words[at : at + size]) == phrase:
                found.append((at, label))
    return found


def scan(
    docs: DataFrame,
    keep: list[str],
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Columns ``keep`` with what the phrases and the templates find in each whole text; templates
    are few and travel with the code."""
    tokens = frozenset(w for _, t in templates for w in t.encode().split())
    scanner = Scanner(templates, document_counts(docs, tokens), threshold)
    split = {tuple(p.encode().split()): label for p, label in phrases.items()}

    def work(texts: list[bytes]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ADDED}
        for t in texts:
            words = words_of(t)
            base = phrase_places(words, split)
            blocks = list(scanner.blocks(words))
            labels = {label for _, label in base}
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(min((i for i, _ in base), default=None))
            out["last_word"].append(max((i for i, _ in base), default=None))
            out["base_labels"].append(",".join(sorted(labels)))
            out["labels"].append(",".join(sorted(labels | {label for _, label, _ in blocks})))
            out["score"].append(1.0 if base else max((s for _, _, s in blocks), default=0.0))
            out["n_blocks"].append(len(blocks))
        return out

    return map_texts(docs, keep, ", ".join(f"{c} {t}" for c, t in ADDED.items()), work)


ADDED = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string",
    "labels": "string", "score": "double", "n_blocks": "long",
}


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, labels and template blocks of every document.

    Null and empty texts have no words, places or labels and score 0; repeated rows each get a row;
    an empty table gives none.
    """
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])
