"""Licence scan with a positional index of rare words.

Method: the inverse document frequencies of the words of the notices' key phrases are counted over all documents. In
each file the words of the highest IDF of each notice's key phrase, however common, are looked up with their place in
the notice; places in the file minus places in the notice are intersected: a notice is proposed where its rare words
agree on its beginning. The proposal is compared with the notice word by word: half of them must match, and the key
phrase must stand in place. Hence every notice that passes is also proposed, and IDF decides only what is looked up
first: the labels of a file do not depend on the other files.

Besides, every place of the base phrases is reported. Words are maximal runs of ASCII letters, digits and non-ASCII
characters, A-Z lower-cased. Defined cases: null or empty text has no words and no labels; an empty table gives an
empty table; rows are judged one by one; an input column that bears a result's name is replaced.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import packed, unpacked

#: Base phrases and their labels; openings of public licence notices, their labels and key phrases.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
NOTICES = (
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except"
     " in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or"
     " without modification are permitted provided that the following conditions are met"),
    ("cc-by", "cc by", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public"
     " license as published by the free software foundation"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this"
     " software and associated documentation files"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Rarest words of each notice's key phrase that are looked up, and the share of a notice that must match.
RAREST, MIN_SHARE = 2, 0.5
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
_CLEAN = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_CLEAN).split()


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(text.encode().split())


class Index:
    """Places of the key phrases' words in the notices."""

    def __init__(self, notices=NOTICES, phrases=PHRASES) -> None:
        self.notices = [(label, _words(key), _words(text)) for label, key, text in notices]
        self.phrases = [(_words(p), label) for p, label in phrases]
        self.firsts = [next(k for k in range(len(text)) if text[k:k + len(key)] == key) for _, key, text in self.notices]
        self.vocabulary = frozenset(w for key in (*(k for _, k, _ in self.notices), *(p for p, _ in self.phrases)) for w in key)

    def rarest(self, idf: dict[bytes, float]) -> list[list[tuple[bytes, int]]]:
        """(word, place in the notice) of the rarest key words of each notice."""
        return [[(w, first + key.index(w)) for w in sorted(set(key), key=lambda w: (-idf[w], w))[:RAREST]]
                for first, (_, key, _) in zip(self.firsts, self.notices)]


def stands_at(words: list[bytes], at: int, phrase: tuple[bytes, ...]) -> bool:
    return tuple(words[at:at + len(phrase)]) == phrase


def base_places(words: list[bytes], places: dict[bytes, list[int]], index: Index) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    return [(at, label) for phrase, label in index.phrases if all(w in places for w in phrase)
            for at in places[phrase[0]] if stands_at(words, at, phrase)]


def notice_places(words: list[bytes], places: dict[bytes, list[int]], rarest: list[list[tuple[bytes, int]]],
                  index: Index) -> list[tuple[str, int, float]]:
    """(label, first word, matching share) of the notices found."""
    found = []
    for (label, key, text), first, rare in zip(index.notices, index.firsts, rarest):
        if not all(w in places for w in key):
            continue
        for shift in set.intersection(*({at - offset for at in places[w]} for w, offset in rare)):
            if shift + first < 0 or not stands_at(words, shift + first, key):
                continue
            share = sum(0 <= shift + k < len(words) and words[shift + k] == w for k, w in enumerate(text)) / len(text)
            if share >= MIN_SHARE:
                found.append((label, max(shift, 0), share))
    return sorted(found)


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of documents (text), and of those with each licence word: a table as small as the vocabulary."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, Counter()
        for part in parts:
            for text in part.column(0).to_pylist():
                n += 1
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([b"", *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())],
                                         names=["word", "n"])

    rows = docs.mapInArrow(batches, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


KIND = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double,"
        " places array<struct<label:string,word:bigint,share:double>>")


def scan_licences(docs: DataFrame, text: str = "text", notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """The input's columns with the places of base phrases and notices, the labels and the best matching share."""
    index = Index(notices, phrases)
    n, counts = document_frequencies(docs.select(docs[f"`{text}`"].alias("text")), index.vocabulary)
    rarest = index.rarest({w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in index.vocabulary})

    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for value in texts:
            words = words_of(value)
            known = index.vocabulary.intersection(words)
            if not known:
                out.append((len(words), 0, None, None, "", "", 0.0, []))
                continue
            places: dict[bytes, list[int]] = defaultdict(list)
            for at, word in enumerate(words):
                if word in known:
                    places[word].append(at)
            base = base_places(words, places, index)
            more = notice_places(words, places, rarest, index)
            own = sorted({label for _, label in base})
            out.append((len(words), len(base), min((a for a, _ in base), default=None), max((a for a, _ in base), default=None),
                        ",".join(own), ",".join(sorted({*own, *(label for label, _, _ in more)})),
                        max((s for _, _, s in more), default=0.0),
                        [{"label": a, "word": b, "share": c} for a, b, c in more]))
        frame = pd.DataFrame(out, columns=list(RESULTS))
        return frame.astype({"first_word": "Int64", "last_word": "Int64"})

    done = docs.select(packed(docs), F.pandas_udf(scan, KIND)(docs[f"`{text}`"]).alias("done"))
    return done.select(*unpacked(docs.columns, replaced=set(RESULTS)), "done.*")
