"""License scan with a positional rare-token index.

Templates (texts, notices, phrases and identifiers) are indexed by word: a word's postings are its places in them. Of each template that a
file may hold, the file's ``RARE`` words of the highest inverse document frequency are looked up. An occurrence of such a word and a
posting of it agree on where the template would start; the starts of all looked-up words are intersected by relative position, with a
tolerance (``slack``) for words put in or left out, and a start on which at least ``AGREE`` of them agree is a placement. A placement is
verified: every mandatory key phrase must stand in the file, in one piece, within the tolerance of its place, and the template's
coverage, the share of its words that stand within the tolerance of theirs, must reach ``COVERAGE``.

A file may hold a template if all words of its key phrases occur in it, so no notice of a file hides another. Base labels come from
phrases that stand consecutively anywhere, all places counted; the scan adds labels of its own and keeps those.

Texts are lower-cased (A-Z); words are runs of digits, letters and code points above 0x7F. The index is fixed and small; files are
scanned whole, in tasks, without a shuffle. The document frequencies of the templates' words are one small
aggregate over all files.

Defined results: a null or empty text has no words, no places (first and last word null), empty labels and score 0; a null doc_id
is kept; equal rows get equal results; words of equal frequency are looked up in order of their hash; an occurrence counts once however many
placements it supports; a long file costs its template words, not placements times words; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltlab.llm import tokens as T

# Phrases whose consecutive occurrence gives a base label.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Licence texts and notices as they are commonly worded, with the key phrases that must be present.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the "
        "following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any "
        "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied",
        ("except in compliance with the license", "apache org licenses license 2 0"),
    ),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("except in compliance with the license", "apache org licenses license 2 0"),
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation",
        ("redistribute it and or modify", "gnu general public license"),
    ),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        ("free and unencumbered software",),
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
    # identifiers
    *(
        (label, f"spdx license identifier {name}", (f"spdx license identifier {name}",))
        for label, name in (
            ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-3", "gpl 3 0"), ("gpl-2", "gpl 2 0"), ("lgpl", "lgpl"), ("agpl", "agpl 3 0"), ("mpl-2", "mpl 2 0"),
            ("bsd", "bsd"), ("isc", "isc"), ("unlicense", "unlicense"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nc", "cc by nc 4 0"),
        )
    ),
)

COVERAGE = 0.6
RARE = 8
AGREE = 0.5


def slack(n_words: int) -> int:
    """Words by which places in a template of ``n_words`` may be off."""
    return 3 + n_words // 8


@dataclass
class Template:
    label: str
    words: np.ndarray
    keys: list[tuple[int, int]]  # (offset, length) of the key phrases in the template


def _hashes(text: str) -> np.ndarray:
    return T.words(pa.array([text]), T.NOT_ALNUM, lower=True).hash


def _find(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Starts of a consecutive phrase."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[words[at + k] == phrase[k]]
    return at


def _near(places: np.ndarray, spots: np.ndarray, within: int) -> np.ndarray:
    """Whether some of the sorted ``places`` lies within so many words of each spot."""
    at = np.searchsorted(places, spots - within)
    found = at < len(places)
    found[found] = places[at[found]] <= spots[found] + within
    return found


class RareTokenIndex:
    """Postings of the templates' words, and the words' document frequencies once known."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES):
        self.templates = []
        for label, text, keys in templates:
            words = _hashes(text)
            spots = []
            for key in keys:
                found = _find(words, _hashes(key))
                spots.append((int(found[0]), len(_hashes(key))))
            self.templates.append(Template(label, words, spots))
        self.phrases = [(_hashes(phrase), label) for phrase, label in phrases]
        flat = np.concatenate([t.words for t in self.templates] + [p for p, _ in self.phrases])
        self.vocabulary = np.unique(flat)
        self.kinds = [np.searchsorted(self.vocabulary, t.words) for t in self.templates]
        # The places of a word in a template.
        self.postings = [{int(k): np.flatnonzero(kinds == k) for k in np.unique(kinds)} for kinds in self.kinds]
        # The words without which a file holds no template, or no base phrase.
        self.needs = np.zeros((len(self.templates) + len(self.phrases), len(self.vocabulary)), bool)
        for t, (template, kinds) in enumerate(zip(self.templates, self.kinds, strict=True)):
            for start, length in template.keys:
                self.needs[t, kinds[start : start + length]] = True
        for t, (phrase, _) in enumerate(self.phrases, start=len(self.templates)):
            self.needs[t, np.searchsorted(self.vocabulary, phrase)] = True
        self.needed = self.needs.sum(axis=1)

    def count_files(self, frequency: np.ndarray) -> None:
        """Take the words' document frequencies: each template's words from the rarest on."""
        self.by_rarity = [np.array(sorted(postings, key=lambda k: (frequency[k], k))) for postings in self.postings]

    def match(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that occur in some template, and which words."""
        spot = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[spot] == hashes)
        return at, spot[at]

    def possible(self, held: np.ndarray) -> np.ndarray:
        """Templates, then base phrases, all of whose needed words are among ``held`` (by file)."""
        return held.astype(np.float32) @ self.needs.T.astype(np.float32) >= self.needed

    def placements(self, template: int, places: dict[int, np.ndarray], present: np.ndarray) -> np.ndarray:
        """Starts on which enough of the file's rarest words of the template agree; ``places`` are a word's in the file."""
        order = self.by_rarity[template]
        looked_up = [int(k) for k in order[present[order]][:RARE]]
        within = slack(len(self.kinds[template]))
        starts = [np.unique((places[k][:, None] - self.postings[template][k]).ravel()) for k in looked_up]
        every = np.unique(np.concatenate(starts))
        agree = np.zeros(len(every), np.int64)
        for mine in starts:
            agree += _near(mine, every, within)
        return every[agree >= max(1, AGREE * len(looked_up))]

    def scan(self, words: np.ndarray, at: np.ndarray, kind: np.ndarray, possible: np.ndarray, coverage: float) -> tuple[set[str], float]:
        """Labels verified in one file and the best coverage; ``at`` and ``kind`` are its template words."""
        order = np.argsort(kind, kind="stable")
        heads = np.searchsorted(kind[order], np.arange(len(self.vocabulary) + 1))
        present = heads[1:] > heads[:-1]
        places = {int(k): at[order[heads[k] : heads[k + 1]]] for k in np.flatnonzero(present)}
        labels, best = set(), 0.0
        for t in np.flatnonzero(possible[: len(self.templates)]):
            template, kinds = self.templates[t], self.kinds[t]
            within = slack(len(kinds))
            phrases = [_find(words, template.words[first : first + length]) for first, length in template.keys]
            if not all(len(p) for p in phrases):
                continue
            starts = self.placements(t, places, present)
            for (first, _), stands in zip(template.keys, phrases, strict=True):
                starts = starts[_near(stands, starts + first, within)]
            if not len(starts):
                continue
            same = np.zeros(len(starts), np.int64)
            for k, word in enumerate(kinds.tolist()):
                if present[word]:
                    same += _near(places[word], starts + k, within)
            share = float(same.max() / len(kinds))
            best = max(best, share)
            if share >= coverage:
                labels.add(template.label)
        return labels, best


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    spark = docs.sparkSession
    narrow = docs.select("doc_id", "text")
    index = RareTokenIndex(templates, phrases)
    plain = spark.sparkContext.broadcast(index)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(plain.value.vocabulary), np.int64)
        for piece in T.pieces(batches):
            found = T.words(piece.column("text"), T.NOT_ALNUM, lower=True)
            at, kind = plain.value.match(found.hash)
            owner = np.searchsorted(found.first, at, side="right") - 1
            pairs = np.unique(owner * len(total) + kind)
            total += np.bincount(pairs % len(total), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["word", "files"])

    counted = narrow.select("text").mapInArrow(frequencies, "word long, files long").groupBy("word").agg(F.sum("files").alias("files"))
    frequency = np.zeros(len(index.vocabulary), np.int64)
    for word, files in counted.collect():  # at most one row for each template word
        frequency[word] = files
    index.count_files(frequency)
    shared = spark.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for piece in T.pieces(batches):
            found = T.words(piece.column("text"), T.NOT_ALNUM, lower=True)
            at, kind = index.match(found.hash)
            bounds = np.searchsorted(at, found.first)
            held = np.zeros((len(found), len(index.vocabulary)), bool)
            held[np.repeat(np.arange(len(found)), np.diff(bounds)), kind] = True
            possible = index.possible(held)
            rows = {"n_base": [], "first_word": [], "last_word": [], "base_labels": [], "labels": [], "score": []}
            for i in range(len(found)):
                words = found.hash[found.first[i] : found.first[i + 1]]
                part = slice(bounds[i], bounds[i + 1])
                places, base, labels, score = [], set(), set(), 0.0
                if possible[i].any():
                    for phrase, label in index.phrases:
                        spots = _find(words, phrase)
                        if len(spots):
                            base.add(label)
                            places.append(spots)
                    labels, score = index.scan(words, at[part] - found.first[i], kind[part], possible[i], coverage)
                spots = np.concatenate(places) if places else None
                rows["n_base"].append(0 if spots is None else len(spots))
                rows["first_word"].append(None if spots is None else int(spots.min()))
                rows["last_word"].append(None if spots is None else int(spots.max()))
                rows["base_labels"].append(",".join(sorted(base)))
                rows["labels"].append(",".join(sorted(base | labels)))
                rows["score"].append(1.0 if base else score)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(found.counts()), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))], names=["doc_id", "n_words", *rows]
            )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return narrow.mapInArrow(scan, schema)
