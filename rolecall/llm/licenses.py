r"""License scans over a positional index of licence templates.

Templates are licence phrases. Their words are looked up in the corpus once to weigh them
(inverse document frequency over all documents). The index is a sorted array of words with postings (template,
position in it): of each template it holds the ``LEADS`` heaviest words of the mandatory key phrases, so common words
have no postings. A batch of files takes one look-up of all its words, whatever the number of templates; the
postings of a file's heavy licence words are intersected by relative position, and a template is
compared word by word only where all its leads agree on a start. Short phrases (``PHRASES``) must agree in every word; longer
templates (``TEMPLATES``) tolerate single different words, which their mandatory key phrases, the
version among them where the label names one, do not.

Defined cases: words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased; a
null or empty text has no words; overlapping places all count; a phrase's label is given once per
file. The score is the best weighted share of a verified template found in the file: 1 where a
phrase or a whole template stands, 0 where nothing does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import LOWER, NOT_WORD, Words, pieces, utf8, words

#: Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
_FREE = "is free software you can redistribute it and or modify it under the terms of the"
_BY_FSF = "as published by the free software foundation either version"
#: Licences of the Free Software Foundation: name, version, label.
_GNU = (
    ("gnu general public license", "1", "gpl-1"),
    ("gnu general public license", "2", "gpl-2"),
    ("gnu general public license", "3", "gpl-3"),
    ("gnu affero general public license", "3", "agpl-3"),
    ("gnu library general public license", "2", "lgpl-2"),
    ("gnu lesser general public license", "2 1", "lgpl-2.1"),
    ("gnu lesser general public license", "3", "lgpl-3"),
)
#: Creative Commons terms and their labels.
_COMMONS = (
    ("attribution", "cc-by"),
    ("attribution sharealike", "cc-by-sa"),
    ("attribution noderivatives", "cc-by-nd"),
    ("attribution noncommercial", "cc-by-nc"),
    ("attribution noncommercial sharealike", "cc-by-nc-sa"),
    ("attribution noncommercial noderivatives", "cc-by-nc-nd"),
)
#: Opening passages of public licences with label and mandatory key phrases.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "permission is hereby granted free of charge"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2", "apache license version 2 0"),
    *((f"licensed under the {name} version {v}", label, name, f"version {v}") for name, v, label in _GNU),
    *((f"under the terms of the {name} version {v} as published by the free software foundation", label, name, f"version {v} as") for name, v, label in _GNU),
    *((f"this {what} {_FREE} {name} {_BY_FSF} {v} of the license", label, name, f"version {v} of the license") for name, v, label in _GNU for what in ("program", "library")),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", "gnu lesser general public license"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "redistribution and use in source and binary forms"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", "mozilla public license v 2 0"),
    ("the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license", "mpl-1.1", "mozilla public license version 1 1"),
    *((f"this work is licensed under a creative commons {terms} {v} license", label, f"creative commons {terms} {v[:3]}") for terms, label in _COMMONS for v in ("4 0 international", "3 0 unported", "2 5 generic", "2 0 generic", "1 0 generic")),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc", "distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", "0bsd", "distribute this software for any purpose with or without fee is hereby granted the software is"),
    ("has waived all copyright and related or neighboring rights to this work", "cc0", "waived all copyright and related or neighboring rights"),
    ("creative commons legal code cc0 1 0 universal", "cc0", "cc0 1 0 universal"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "free and unencumbered software"),
    ("distributed under the boost software license version 1 0", "bsl-1", "boost software license version 1 0"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib", "in no event will the authors be held liable"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "epl-2", "eclipse public license 2 0"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "epl-1", "eclipse public license v1 0"),
)
#: Least weighted share of a longer template's words that must stand in place.
COVER = 0.8
#: How many of a template's heaviest mandatory words have postings.
LEADS = 2


def _hash(text: str) -> np.ndarray:
    data, offsets = utf8(pa.array([text]))
    return words(data, offsets, NOT_WORD, LOWER).hash


class Template(NamedTuple):
    words: np.ndarray
    weight: np.ndarray
    label: str
    base: bool
    must: np.ndarray  # which words belong to the mandatory key phrases


class Index(NamedTuple):
    """Postings of the leading words: those of ``words[i]`` are ``first[i]`` to ``first[i + 1]``."""

    templates: list[Template]
    words: np.ndarray
    first: np.ndarray
    template: np.ndarray
    place: np.ndarray
    leads: np.ndarray  # number of leading words of each template


def vocabulary(entries: tuple = (*PHRASES, *TEMPLATES)) -> list[str]:
    return sorted({w for text, *_ in entries for w in text.split()})


def file_words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    data, offsets = utf8(texts)
    return words(data, offsets, NOT_WORD, LOWER), offsets


def document_counts(docs: DataFrame, text: str) -> tuple[int, dict[int, int]]:
    """Number of documents, and of those that hold each vocabulary word, over all of them. Every
    task sends at most one row per vocabulary word."""
    vocab = np.sort(np.concatenate([_hash(w) for w in vocabulary()]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                w, _ = file_words(part.column("text"))
                at = np.minimum(np.searchsorted(vocab, w.hash), len(vocab) - 1)
                hit = vocab[at] == w.hash
                pair = np.unique(w.row[hit].astype(np.int64) * len(vocab) + at[hit])
                total += np.bincount(pair % len(vocab), minlength=len(vocab))
                n += part.num_rows
        yield pa.RecordBatch.from_pydict({"word": pa.array([*range(len(vocab)), -1], pa.int64()), "n": pa.array([*total.tolist(), n], pa.int64())})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row per vocabulary word
    found = {r["word"]: r["n"] for r in rows}
    return found.pop(-1, 0), {int(vocab[k]): n for k, n in found.items()}


def build_index(n_docs: int, counts: dict[int, int], entries: tuple = (*PHRASES, *TEMPLATES)) -> Index:
    """The index of (text, label, mandatory key phrases ...) entries; one without key phrases is a base phrase."""
    templates, postings = [], []
    for k, (text, label, *key) in enumerate(entries):
        h = _hash(text)
        weight = np.array([math.log((n_docs + 1) / (counts.get(int(x), 0) + 0.5)) for x in h])
        weight = np.maximum(weight, 0.01)
        body, must = text.split(), np.zeros(len(h), bool)
        for phrase in (x.split() for x in key or (text,)):
            at = next(i for i in range(len(body)) if body[i : i + len(phrase)] == phrase)
            must[at : at + len(phrase)] = True
        templates.append(Template(h, weight, label, not key, must))
        leading = sorted(np.flatnonzero(must).tolist(), key=lambda i: -weight[i])[:LEADS]
        postings += [(int(h[i]), k, i) for i in leading]
    postings.sort()
    word = np.array([x[0] for x in postings], np.uint64)
    distinct, first = np.unique(word, return_index=True)
    template, place = (np.array([x[c] for x in postings], np.int64) for c in (1, 2))
    return Index(templates, distinct, np.append(first, len(word)), template, place, np.bincount(template, minlength=len(templates)))


class Places(NamedTuple):
    row: np.ndarray
    first: np.ndarray
    template: np.ndarray
    cover: np.ndarray


def candidates(w: Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, template) wherever all leading words of a template stand in their relative places."""
    at = np.minimum(np.searchsorted(index.words, w.hash), len(index.words) - 1)
    hit = np.flatnonzero(index.words[at] == w.hash)
    word = at[hit]
    n = index.first[word + 1] - index.first[word]
    posting = np.repeat(index.first[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, template = np.repeat(w.row[hit], n).astype(np.int64), index.template[posting]
    longest = max(len(t.words) for t in index.templates)  # a start may lie before the text's first word
    start = np.repeat(hit, n) - index.place[posting] + longest
    span, kinds = len(w.hash) + 2 * longest, len(index.templates)
    key, agree = np.unique((row * span + start) * kinds + template, return_counts=True)
    key = key[agree == index.leads[key % kinds]]
    return key // kinds // span, key // kinds % span - longest, key % kinds


def find_places(w: Words, index: Index) -> Places:
    """All places where a template stands: postings intersected, then the words compared."""
    row, first, template = candidates(w, index)
    cover, good = np.zeros(len(row)), np.zeros(len(row), bool)
    for k in np.unique(template).tolist():
        t, mine = index.templates[k], np.flatnonzero(template == k)
        place = first[mine][:, None] + np.arange(len(t.words))
        inside = (place >= 0) & (place < len(w.hash))
        place = np.where(inside, place, 0)
        same = inside & (w.hash[place] == t.words) & (w.row[place] == row[mine][:, None])
        cover[mine] = same @ t.weight / t.weight.sum()
        good[mine] = same[:, t.must].all(axis=1) & (cover[mine] >= (0 if t.base else COVER))
    return Places(row[good], first[good], template[good], np.minimum(cover[good], 1.0))


def scan_licenses(docs: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_base, first_word, last_word, base_labels,
    labels, score, and the places (label, first word, share of the template)."""
    index = build_index(*document_counts(docs, text))
    kind = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,places:array<struct<label:string,word:long,share:double>>>"

    @F.arrow_udf(kind)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows: list[dict] = []
            for part in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
                w, _ = file_words(part.column("text"))
                mine = [{"n_words": int(n), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "places": []} for n in np.diff(w.first)]
                p = find_places(w, index)
                for row, first, k, cover in sorted(zip(p.row.tolist(), p.first.tolist(), p.template.tolist(), p.cover.tolist(), strict=True)):
                    one, t, at = mine[row], index.templates[k], first - int(w.first[row])
                    one["places"].append({"label": t.label, "word": at, "share": cover, "base": t.base})
                for one in mine:
                    if one["places"]:
                        base = [x for x in one["places"] if x["base"]]
                        one |= {"n_base": len(base), "labels": ",".join(sorted({x["label"] for x in one["places"]})), "score": max(x["share"] for x in one["places"])}
                        if base:
                            one |= {"first_word": min(x["word"] for x in base), "last_word": max(x["word"] for x in base), "base_labels": ",".join(sorted({x["label"] for x in base}))}
                        one["places"] = [{k: v for k, v in x.items() if k != "base"} for x in one["places"]]
                rows += mine
            yield pa.array(rows, _KIND)

    return docs.withColumn(out, scan(F.col(text)))


_KIND = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())])))])
