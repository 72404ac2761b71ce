"""License scans by template markup.

Templates carry the markup of published license lists: optional regions and replaceable
ones. Each is compiled into a token automaton; a text is accepted where the mandatory
wording matches word for word, optional regions are there whole or not at all, and
replaceable ones hold an allowed alternative or up to so many words of any kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurespark.llm.shared import by_bytes, flat_text
from procurespark.llm.simhash import LOWER
from procurespark.llm.words import codes_of, word_spans

BATCH_BYTES = 1 << 20

#: Fixed phrases and their labels.
BASE_PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Fixed templates. <opt>...</opt> may be left out; <var:a|b> is one of the alternatives;
#: <var:n> is at most n words of any kind.
TEMPLATES = [
    ("mit", "<var:released|licensed|distributed|available|provided> under <opt>the terms of</opt> the mit <var:license|licence>"),
    ("mit", """<opt><opt>the</opt> mit license</opt> <opt>copyright <opt>c</opt> <var:24></opt> permission is hereby granted free of charge to any person
        obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <opt>including the next
        paragraph</opt> shall be included in all copies or substantial portions of the software <opt>the software is provided as is without warranty of any
        kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement</opt>"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies"""),
    ("apache-2", "licensed under the apache license <opt>version</opt> 2 0 <opt>the license</opt>"),
    ("gpl-3", "<opt>this <var:work|software|program|file> is</opt> <var:licensed|released|distributed> under the <opt>terms of the</opt> gnu general public license <opt>version</opt> 3"),
    ("cc-by", "<opt>this work is</opt> <var:licensed|released> under <var:a|the> creative commons attribution <var:3|4> 0 <opt>international</opt> <var:license|licence>"),
    ("cc-by-nc", "<opt>this work is</opt> <var:licensed|released> under <var:a|the> creative commons attribution noncommercial <var:3|4> 0 <opt>international</opt> <var:license|licence>"),
    ("cc-by-nc", "<var:licensed|released> under cc by nc <opt><var:3|4> 0</opt>"),
    ("apache-2", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of
        the license at <var:http|https> www apache org licenses license 2 0 <opt>unless required by applicable law or agreed to in writing software distributed under the
        license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language
        governing permissions and limitations under the license</opt>"""),
    ("bsd-2-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <opt>1</opt> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <opt>2</opt> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution this software is provided by <var:8> as is and any express or implied warranties"""),
    ("bsd-3-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <opt>1</opt> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <opt>2</opt> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution <opt>3</opt> neither the name of <var:12> nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission"""),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 <opt>if a copy of the mpl was not distributed with this file you can
        obtain one at <var:http|https> mozilla org mpl 2 0</opt>"""),
    ("gpl-2", """this <var:program|library|software|file> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published
        by the free software foundation either version 2 of the license or at your option any later version"""),
    ("gpl-3", """this <var:program|library|software|file> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published
        by the free software foundation either version 3 of the license or at your option any later version"""),
    ("lgpl-2.1", """this <var:program|library|software|file> is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as
        published by the free software foundation either version 2 1 of the license or at your option any later version"""),
    ("lgpl-3", """this <var:program|library|software|file> is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as
        published by the free software foundation either version 3 of the license or at your option any later version"""),
    ("agpl-3", """this <var:program|library|software|file> is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as
        published by the free software foundation either version 3 of the license or at your option any later version"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
        either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this
        software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to
        the following restrictions"""),
    ("bsl-1", "distributed under the boost software license version 1 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license <opt><var:v|version></opt> 2 0"),
    ("cc0", "to the extent possible under law <var:24> has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa", "<opt>this work is</opt> <var:licensed|released> under <var:a|the> creative commons attribution sharealike <var:2|3|4> 0 <opt>international</opt> <var:license|licence>"),
]

#: Fixed identifiers of license lines in source files, word by word, and their labels.
IDENTIFIERS = [
    ("mit", "mit"), ("isc", "isc"), ("apache-2", "apache 2 0"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("mpl-2", "mpl 2 0"), ("gpl-2", "gpl 2 0"),
    ("gpl-3", "gpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3", "lgpl 3 0"), ("agpl-3", "agpl 3 0"), ("unlicense", "unlicense"), ("zlib", "zlib"), ("bsl-1", "bsl 1 0"), ("epl-2", "epl 2 0"),
    ("cc0", "cc0 1 0"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nc", "cc by nc 4 0"),
]
TEMPLATES += [(label, f"spdx license identifier {words} <opt>only</opt> <opt>or later</opt>") for label, words in IDENTIFIERS]


class Automaton:
    """States of a template: each has words that lead on, and states reached without a word."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.words: list[dict[str | None, set[int]]] = [{}]  # None: any word
        self.free: list[set[int]] = [set()]
        self.mandatory: set[str] = set()
        opened: list[int] = []
        at = 0
        for part in re.findall(r"<[^>]*>|[^<\s]+", template):
            if part == "<opt>":
                opened.append(at)
            elif part == "</opt>":
                self.free[opened.pop()].add(at)
            elif m := re.fullmatch(r"<var:(\d+)>", part):
                first = at
                for _ in range(int(m[1])):
                    at = self._next(at, [None])
                for k in range(first, at):
                    self.free[k].add(at)
            else:
                choices = part[5:-1].split("|") if part.startswith("<var:") else [part]
                if len(choices) == 1 and not opened:
                    self.mandatory.add(part)
                at = self._next(at, choices)
        self.last = at
        self.first = {w for k in self._closed({0}) for w in self.words[k]}

    def _next(self, at: int, choices: list[str | None]) -> int:
        self.words.append({})
        self.free.append(set())
        for w in choices:
            self.words[at].setdefault(w, set()).add(len(self.words) - 1)
        return len(self.words) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for k in self.free[todo.pop()] - out:
                out.add(k)
                todo.append(k)
        return out

    def accepts(self, words: Iterator[str]) -> int:
        """The number of words of the longest accepted beginning; 0 if there is none."""
        states, best = self._closed({0}), 0
        for n, word in enumerate(words, 1):
            states = self._closed({k for s in states for key in (word, None) for k in self.words[s].get(key, ())})
            if not states:
                break
            if self.last in states:
                best = n
        return best


@lru_cache(4)
def automata(templates: tuple[tuple[str, str], ...]) -> list[Automaton]:
    return [Automaton(label, template) for label, template in templates]


def _scan(data: np.ndarray, offsets: np.ndarray, templates: tuple[tuple[str, str], ...]) -> dict[str, list]:
    n = len(offsets) - 1
    lowered = LOWER[data]
    inside = ((lowered >= 0x30) & (lowered <= 0x39)) | ((lowered >= 0x61) & (lowered <= 0x7A)) | (lowered >= 0x80)
    starts, ends, owner = word_spans(inside, offsets)
    code, known = codes_of(lowered, starts, ends)
    counts = np.bincount(owner, minlength=n)
    first = np.cumsum(counts) - counts
    wanted = {w for p, _ in BASE_PHRASES for w in p.split()} | {w for a in automata(templates) for w in a.first | a.mandatory if w}
    number = pa.compute.index_in(pa.array([w.encode() for w in sorted(wanted)], pa.large_binary()), value_set=known).to_pylist()
    of = {w: -1 if k is None else k for w, k in zip(sorted(wanted), number, strict=True)}

    places: dict[int, list[int]] = {}
    base: dict[int, set[str]] = {}
    covered: dict[int, list[tuple[int, int]]] = {}
    for phrase, label in BASE_PHRASES:
        want = [of[w] for w in phrase.split()]
        size = len(want)
        if min(want) < 0 or len(code) < size:
            continue
        ok = owner[: len(code) - size + 1] == owner[size - 1 :]
        for k, w in enumerate(want):
            ok &= code[k : len(code) - size + 1 + k] == w
        for at in np.flatnonzero(ok).tolist():
            d = int(owner[at])
            places.setdefault(d, []).append(at - int(first[d]))
            base.setdefault(d, set()).add(label)
            covered.setdefault(d, []).append((at, at + size))
    found = {d: set(x) for d, x in base.items()}
    times = np.bincount(code, minlength=len(known))
    for a in automata(templates):
        holding = None  # texts with every mandatory word, the rarest first
        for w in sorted(a.mandatory, key=lambda w: times[of[w]] if of[w] >= 0 else -1):
            own = set(np.unique(owner[code == of[w]]).tolist()) if of[w] >= 0 else set()
            holding = own if holding is None else holding & own
            if not holding:
                break
        for d in sorted(holding or ()):
            own = slice(int(first[d]), int(first[d] + counts[d]))
            leads = np.isin(code[own], [of[w] for w in a.first if w])
            for at in (np.flatnonzero(leads) + own.start).tolist():
                size = a.accepts(known[int(c)].as_py().decode() for c in code[at : own.stop])
                if size:
                    found.setdefault(d, set()).add(a.label)
                    covered.setdefault(d, []).append((at, at + size))
    score = [0.0] * n
    for d, spans in covered.items():
        end = total = 0
        for x, y in sorted(spans):
            total += max(0, y - max(x, end))
            end = max(end, y)
        score[d] = total / int(counts[d])
    joined = lambda held, d: ",".join(sorted(held.get(d, ())))
    return {
        "n_words": counts.tolist(),
        "n_base": [len(places.get(d, ())) for d in range(n)],
        "first_word": [min(places[d]) if d in places else None for d in range(n)],
        "last_word": [max(places[d]) if d in places else None for d in range(n)],
        "base_labels": [joined(base, d) for d in range(n)],
        "labels": [joined(found, d) for d in range(n)],
        "score": score,
    }


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base phrases and accepted templates (label and markup; TEMPLATES if none are given) of each row's text.

    ``score`` is the share of the text's words inside phrases and accepted wording. A
    null or wordless text has no words, no labels (empty strings), null places and score
    0; null ids stay null; repeated rows come back each; other columns are not read; an
    empty table gives an empty result.
    """
    used = tuple(TEMPLATES if templates is None else templates)
    schema = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            for a, b in by_bytes(offsets, BATCH_BYTES):
                made = _scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], used)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(made[f.name], f.type) for f in schema)], ["doc_id", *schema.names])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
