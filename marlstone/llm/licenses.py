"""Licence scans: a trained paragraph classifier with a calibrated unknown class and template confirmation.

Paragraphs are lines, wrapped lines joined. Multinomial logistic regression over word n-grams (1 to 3) is trained on
statements made from templates (carrier phrase and licence name, and the clauses of the licences' texts and notices, with
words dropped and surrounded by other text) and on a bounded sample of whole paragraphs as the unknown class. A
temperature fitted on held-out statements calibrates its probabilities; what stays under the threshold is unknown. A
prediction counts as confirmed when enough of one of its family's templates is in the paragraph.

Every paragraph of every text is classified, all of a slice at once: its words are hashed, its n-grams are looked up
among the model's by hash, and their weights are added up. A paragraph without any such n-gram has the bias alone.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import NONWORD, SPACE, U64, Grams, buffers, lean, plain, sample_ids, slices, word_hashes, word_spans

FIT_ROWS, FIT_PARAGRAPHS, THRESHOLD, CONFIRM = 400, 4000, 0.6, 0.6
UNKNOWN = "unknown"
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "ASL 2.0"],
    "MIT": ["MIT License", "MIT licence", "MIT/X11 license", "Expat License", "MIT"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0", "GPLv3", "GNU General Public License version 3 or later", "GPL-3.0-or-later"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPLv2", "GNU General Public License version 2 or later", "GPL-2.0-only"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv2.1", "GNU Lesser General Public License, version 2.1"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "AGPL-3.0", "AGPLv3"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD-3-Clause", "BSD 2-Clause License", "BSD-2-Clause", "New BSD license", "Simplified BSD License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial License"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0", "CC0-1.0", "Creative Commons Zero"],
    "ISC": ["ISC License", "ISC licence"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
CARRIERS = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.",
    "This work is licensed under {}.", "This work is licensed under a {}.", "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}",
    "This software is made available under the {}.", "This file is part of a project covered by the {}.", "License: {}", "Published under the {}.",
    "You may use this file under the terms of the {}.", "The source code is licensed under the {}.", "See the {} for details.",
]
CLAUSES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "to deal in the Software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "you may not use this file except in compliance with the License",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder may be used to endorse or promote products",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "You are free to share and adapt the material for any purpose, even commercially, under the terms of Creative Commons Attribution: you must give appropriate credit, provide a link to the license, and indicate if changes were made.",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original (ShareAlike).",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "NonCommercial: you may not use the material for commercial purposes.",
    ],
    "CC0-1.0": [
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "the person who associated a work with this deed has dedicated the work to the public domain",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "For more information, please refer to http://unlicense.org/",
    ],
}
DECOYS = [
    "He lost his driving licence last year.", "The licence plate was found at the works.", "This version of the apache helicopter story is new.",
    "Researchers at MIT published a report.", "All rights reserved.", "Copyright by the authors.", "The software was released in version 2.0 last week.",
    "Version 3 of the public report is under review.", "Under the terms of the agreement the work is done.", "The general public may attend.",
    "He is licensed to practise in four states.", "See the manual for details.", "This file is part of the archive.", "Licensed premises close at ten.",
    "Licensed under the terms agreed with the owner.", "Released under embargo until noon.", "This work is licensed under a private contract.",
    "Attribution of the painting is uncertain.", "The commons were enclosed in 1820.", "Version 2.0 is available.", "Licensed under the Foo License.",
    "This work is licensed under the Example Source Licence, version 9.", "Licensed under ZZ 7.1.", "Released under the Quux Terms.",
]


STOPS = np.zeros(256, bool)
STOPS[list(b".!?:;")] = True
INNER = (b"\xe2\x80", b"\xe2\x81", b"\xc2\xab", b"\xc2\xbb", b"\xc2\xa0")  # how general punctuation, guillemets and hard blanks begin


def normal(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes and row offsets of a column, with punctuation beyond ASCII made blank."""
    raw, off = buffers(pc.utf8_lower(text))
    if len(raw) > 1 and (raw > 127).any():
        raw = raw.copy()
        for a, b in INNER:
            at = np.flatnonzero((raw[:-1] == a) & (raw[1:] == b))
            for k in range(3 if a == 0xE2 else 2):
                raw[np.minimum(at + k, len(raw) - 1)] = 32
    return raw, off


def spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end byte of each paragraph: lines; one that does not end a sentence goes on in the next one, up to
    a line of white space or the text's end."""
    breaks = np.flatnonzero(raw == 10)
    end = np.union1d(breaks, off[1:])  # a line ends at its break or at its row's end
    start = np.concatenate([[0], end[:-1] + (end[:-1] < len(raw)) * (raw[np.minimum(end[:-1], max(len(raw) - 1, 0))] == 10)]) if len(raw) else end
    row = np.searchsorted(off, start, side="right") - 1
    some = start < end
    start, end, row = start[some], end[some], row[some]
    solid = np.flatnonzero(~SPACE[raw])
    last = np.searchsorted(solid, end) - 1
    full = (last >= 0) & (solid[np.maximum(last, 0)] >= start) if len(solid) else np.zeros(len(start), bool)
    at = np.flatnonzero(full)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    alone = np.ones(len(at), bool)  # whether the paragraph ends with this line
    alone[:-1] = (row[at[1:]] != row[at[:-1]]) | (at[1:] != at[:-1] + 1) | (start[at[1:]] > end[at[:-1]] + 1) | STOPS[raw[solid[last[at[:-1]]]]]
    head = np.concatenate([[True], alone[:-1]])
    return row[at[head]], start[at[head]], end[at[alone]]


def tokens(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    raw, off = normal(pa.array([text], pa.string()))
    starts, ends, _ = word_spans(raw, off, NONWORD)
    data = raw.tobytes()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def gram_hash(gram: str) -> int:
    """The hash of an n-gram as ``Grams`` has it for its words in a text."""
    raw = np.frombuffer(gram.encode(), np.uint8)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), SPACE)
    return int(Grams(word_hashes(raw, starts, ends)).at(np.array([0]), len(starts))[0])


@dataclass
class Model:
    families: list[str]
    column: dict[str, int]
    weights: np.ndarray  # (features + 1) x families; the last row is the bias
    temperature: float
    templates: dict[str, list[frozenset]]

    def __post_init__(self):
        hashes = np.array([gram_hash(g) for g in self.column], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.of = hashes[order], np.array(list(self.column.values()), np.int64)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes >> U64(44)).astype(np.int64)] = True

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = sorted(self.column[g] for g in grams(words) if g in self.column)
        return self._calibrated((self.weights[at].sum(axis=0) + self.weights[-1])[None])[0]

    def _calibrated(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def classify(self, raw: np.ndarray, off: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities (paragraphs x families) of all paragraphs, which begin at ``first``, at once."""
        starts, ends, _ = word_spans(raw, off, NONWORD)
        whose = np.searchsorted(first, starts, side="right") - 1
        runs = Grams(word_hashes(raw, starts, ends))
        found = []
        for n in (1, 2, 3):
            h = runs.all(n)
            at = np.flatnonzero(self.maybe[(h >> U64(44)).astype(np.int64)])
            at = at[whose[at] == whose[at + n - 1]]
            k = np.minimum(np.searchsorted(self.hashes, h[at]), max(len(self.hashes) - 1, 0))
            hit = self.hashes[k] == h[at] if len(self.hashes) else np.zeros(0, bool)
            found.append(whose[at[hit]] * (len(self.column) + 1) + self.of[k[hit]])
        pairs = np.unique(np.concatenate(found))  # an n-gram counts once in a paragraph
        z = np.zeros((len(first), len(self.families)))
        part = pairs // (len(self.column) + 1)
        head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
        if len(part):
            z[part[head]] = np.add.reduceat(self.weights[pairs % (len(self.column) + 1)], head, axis=0)
        return self._calibrated(z + self.weights[-1])

    def confirmed_by(self, family: str, words: list[str]) -> float:
        """The largest share of a template's word pairs that the paragraph has."""
        own = set(zip(words, words[1:]))
        return max((len(own & t) / len(t) for t in self.templates.get(family, []) if t), default=0.0)

    def scan(self, text: pa.Array, threshold: float) -> tuple[np.ndarray, list[list[tuple[int, str, float, float]]]]:
        """By row: number of paragraphs, and (paragraph, family, probability, template share) of those not unknown."""
        raw, off = normal(text)
        row, first, end = spans(raw, off)
        n = np.bincount(row, minlength=len(text))
        out: list[list[tuple[int, str, float, float]]] = [[] for _ in range(len(text))]
        if not len(row):
            return n, out
        p = self.classify(raw, off, first)
        best = p.argmax(axis=1)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        for i in np.flatnonzero((best != self.families.index(UNKNOWN)) & (p[np.arange(len(row)), best] >= threshold)).tolist():
            family = self.families[best[i]]
            words = tokens(raw[first[i] : end[i]].tobytes().decode("utf-8", "replace"))
            out[int(row[i])].append((int(number[i]), family, float(p[i, best[i]]), self.confirmed_by(family, words)))
        return n, out


def softmax_fit(rows: list[list[int]], width: int, target: np.ndarray, classes: int, rounds: int = 120, l2: float = 2e-5) -> np.ndarray:
    """Multinomial logistic regression on sparse 0/1 rows by Adam; the last row of the result is the bias."""
    rows = [[*r, width] for r in rows]
    col = np.array([c for r in rows for c in r], np.int64)
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(col, kind="stable")
    present, first = np.unique(col[order], return_index=True)
    wanted = np.eye(classes)[target]
    weight = (len(rows) / classes / np.maximum(wanted.sum(axis=0), 1))[target]
    weight = np.sqrt(weight / weight.mean())[:, None]
    w, m, v = np.zeros((width + 1, classes)), np.zeros((width + 1, classes)), np.zeros((width + 1, classes))
    for k in range(1, rounds + 1):
        z = np.add.reduceat(w[col], start, axis=0)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        miss = weight * (e / e.sum(axis=1, keepdims=True) - wanted) / len(rows)
        g = l2 * w
        g[present] += np.add.reduceat(miss[row[order]], first, axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return w


def fit(ordinary: list[str], seed: int = 11) -> Model:
    """Trains on template statements and, as unknown, decoys and ``ordinary`` paragraphs, whole; deterministic."""
    rng = np.random.Generator(np.random.PCG64(seed))
    plain_words = [tokens(p) for p in ordinary] or [["lorem", "ipsum", "dolor"]]
    families = [*NAMES, UNKNOWN]
    texts, target = [], []
    statements = {f: [c.format(n) for n in NAMES[f] for c in CARRIERS] + CLAUSES.get(f, []) for f in NAMES}
    for k, family in enumerate(NAMES):
        names = {tuple(tokens(n)) for n in NAMES[family]}
        for s in statements[family]:
            words = tokens(s)
            for copy in range(2 if s in CLAUSES.get(family, []) or len(words) < 4 else 1):
                around = plain_words[rng.integers(len(plain_words))][: int(rng.integers(0, 8))] if rng.random() < 0.4 else []
                kept = [w for w in words if rng.random() > 0.04 or any(w in n for n in names)]
                texts.append([*around, *kept] if rng.random() < 0.5 else [*kept, *around])
                target.append(k)
    negative = [tokens(d) for d in DECOYS] * 6 + plain_words
    for _ in range(300):  # carriers of unheard-of names
        made = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 9))))
        negative.append(tokens(CARRIERS[rng.integers(len(CARRIERS))].format(f"{made} {'license' if rng.random() < 0.6 else rng.integers(1, 9)}")))
    texts += negative
    target += [len(families) - 1] * len(negative)
    target = np.array(target)
    held = rng.random(len(texts)) < 0.2
    df = Counter(g for words in texts for g in grams(words))
    statement_grams = {g for s in statements.values() for x in s for g in grams(tokens(x))} | {g for d in DECOYS for g in grams(tokens(d))}
    column = {g: k for k, g in enumerate(sorted(g for g in statement_grams if df[g] >= 2))}
    rows = [sorted(column[g] for g in grams(words) if g in column) for words in texts]
    train = np.flatnonzero(~held)
    w = softmax_fit([rows[i] for i in train], len(column), target[train], len(families))
    z = np.stack([w[[*rows[i], len(column)]].sum(axis=0) for i in np.flatnonzero(held)])

    def loss(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), target[held]]).mean())

    temperature = min((0.25 * 1.25**k for k in range(14)), key=loss)
    templates = {f: [frozenset(zip(t, t[1:])) for t in map(tokens, statements[f] + NAMES[f])] for f in NAMES}
    return Model(families, column, w, temperature, templates)


SCHEMA = (
    "doc_id bigint, n_paragraphs int, license string, probability double, template_share double, confirmed boolean, "
    "found array<struct<paragraph:int,license:string,probability:double,template_share:double>>"
)


def ordinary_paragraphs(docs: DataFrame, rows: int = FIT_ROWS, most: int = FIT_PARAGRAPHS) -> list[str]:
    """At most ``most`` different paragraphs of at most ``rows`` documents (the lowest by hash of doc_id), those lowest
    by hash from anywhere in the texts, as examples of the unknown class; those that speak of licences are left out."""
    texts = plain(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    picked = texts.join(F.broadcast(sample_ids(texts, "doc_id", rows, salt=4)), "doc_id").select("text")

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                raw, off = normal(part.column("text"))
                data = raw.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([data[a:b].decode("utf-8", "replace").strip() for _, a, b in zip(*(x.tolist() for x in spans(raw, off)))], pa.string())], names=["p"])

    about = r"licen[cs]e|spdx|copyright|\bcc|hereby granted|without restriction|redistribut|warrant|public domain|unencumbered|free software|sharealike|noncommercial"
    found = picked.mapInArrow(lean(cut), "p string").where(~F.col("p").rlike(about)).distinct()
    return [r["p"] for r in found.orderBy(F.xxhash64("p"), "p").limit(most).collect()]


def scan(docs: DataFrame, rows: int = FIT_ROWS, threshold: float = THRESHOLD, confirm: float = CONFIRM, model: Model | None = None) -> DataFrame:
    """One row for each row of ``docs``: its most probable licence (null where all paragraphs are unknown), that
    paragraph's probability and template share, whether the template confirms it, and all paragraphs ``found``.

    A null text has null n_paragraphs, an empty one (or one of white space) 0. An empty table gives no rows. Ties go to
    the earlier paragraph, then to the family listed first. Null doc_id and repeated rows are carried through one to one;
    other columns are ignored, whatever their names. Every paragraph of every text is classified, however long. The model
    (some thousand n-grams, whatever the input) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(ordinary_paragraphs(docs, rows)))

    def work(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                counts, listed = own.scan(part.column("text"), threshold)
                out = []
                for null, n, found in zip(part.column("text").is_null().to_pylist(), counts.tolist(), listed):
                    best = max(found, key=lambda f: (f[2], -f[0])) if found else (None, None, None, None)
                    out.append((None if null else n, best[1], best[2], best[3], None if best[3] is None else best[3] >= confirm, found))
                n, name, p, share, ok, found = zip(*out)
                item = pa.struct([("paragraph", pa.int32()), ("license", pa.string()), ("probability", pa.float64()), ("template_share", pa.float64())])
                lists = [[dict(zip(("paragraph", "license", "probability", "template_share"), f)) for f in fs] for fs in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int32()), pa.array(name, pa.string()), pa.array(p, pa.float64()), pa.array(share, pa.float64()), pa.array(ok, pa.bool_()), pa.array(lists, pa.list_(item))],
                    names=["doc_id", "n_paragraphs", "license", "probability", "template_share", "confirmed", "found"],
                )

    return plain(docs, "doc_id", "text").mapInArrow(lean(work), SCHEMA)
