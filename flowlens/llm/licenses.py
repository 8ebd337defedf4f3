"""License scan by word-bigram Dice coefficient (operator 10).

Texts are cut into units: every line, every paragraph (between blank lines) and
the whole text. A unit is normalised (lower case, everything but letters and
digits becomes a space) and turned into the set of its word bigrams; one word
alone is its own bigram. Its Dice coefficient with a template is twice the
shared bigrams over the sum of both sizes. A coefficient of at least t needs
sizes within a factor (2 - t) / t of each other, so only templates of a fitting
size are compared at all; that size bound loses nothing. Neither does the other
one: a match needs so many of its template's bigrams that it holds one of a few
key words, so units without any are not cut into bigrams.

Everything happens within a row: templates are constants of the plan, and no
row is shuffled. A document gets its best template (ties: more shared bigrams, then the
earlier template) at or above the threshold.

Defined cases: null and empty texts match nothing; equal rows get equal
answers; a null id is kept; an empty table gives an empty result; extra
columns pass through ``scan``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import NOT_SPACE, fresh, let, positions, quoted

THRESHOLD_PERCENT = 80

# Short public notices by which documents declare a license.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of "
                         "the GNU General Public License as published by the Free Software Foundation, either "
                         "version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the terms of the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Proprietary", "All rights reserved."),
)

# Names by which notices call a license; its SPDX identifier is the key.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GPL v2", "the GPLv2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GPL v3", "the GPLv3"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "the LGPL v2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "the LGPL v3"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "the AGPL v3"),
    "MIT": ("the MIT License",),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License"),
    "ISC": ("the ISC License",),
    "Unlicense": ("the Unlicense",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "the CC0 1.0 Universal License"),
}
WORDINGS = (
    "Licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under {}.",
    "Licensed under the terms of {}.", "Released under the terms of {}.", "Distributed under the terms of {}.",
    "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.",
    "This software is released under {}.", "This project is released under {}.", "This software is distributed under {}.",
)
TAGS = {
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only"), "GPL-2.0-or-later": ("GPL-2.0-or-later",),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only"), "GPL-3.0-or-later": ("GPL-3.0-or-later",),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only"), "LGPL-2.1-or-later": ("LGPL-2.1-or-later",),
    "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only"), "LGPL-3.0-or-later": ("LGPL-3.0-or-later",),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only"), "AGPL-3.0-or-later": ("AGPL-3.0-or-later",),
}


def _usual() -> list[tuple[str, str]]:
    said = [(name, w.format(x)) for name, called in NAMES.items() for x in called for w in WORDINGS]
    return said + [(n, f"SPDX-License-Identifier: {tag}") for n in {**NAMES, **TAGS} for tag in TAGS.get(n, (n,))]


_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_VERSIONED = (
    "This {kind} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
)
# Paragraphs that stand in license texts, each where it is told from other licenses.
BODIES: tuple[tuple[str, str], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
                     "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
                     "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                     "other materials provided with the distribution. " + _AS_IS),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
                  "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL-2.0-or-later", _VERSIONED.format(kind="program", name="General Public License", v="2")),
    ("LGPL-2.1-or-later", _VERSIONED.format(kind="library", name="Lesser General Public License", v="2.1")),
    ("LGPL-3.0-or-later", _VERSIONED.format(kind="library", name="Lesser General Public License", v="3")),
    ("AGPL-3.0-or-later", _VERSIONED.format(kind="program", name="Affero General Public License", v="3")),
)

# Notices come first: with equal scores the earlier template counts.
TEMPLATES: tuple[tuple[str, str], ...] = tuple(dict.fromkeys([*NOTICES, *_usual(), *BODIES]))

# Words of everyday prose, taken as key words only where a template has nothing else.
_COMMON = frozenset("a an and any are as at be by for from in is it no not of on or that the this to under with you".split())


def key_words(bigrams: Sequence[Sequence[str]], threshold: int) -> list[str]:
    """Words of which every unit that reaches the threshold with some template holds one.

    Such a unit shares at least threshold / (200 - threshold) of the template's
    bigrams, so key words need to stand in more bigrams than may be missing.
    """
    left = {}
    for k, b in enumerate(bigrams):
        may_miss = len(b) - -(-len(b) * threshold // (200 - threshold))
        left[k] = may_miss + 1, {tuple(x.split(" ")) for x in b}
    chosen = []
    while left:
        gain: dict[str, int] = {}
        for _, open_ in left.values():
            for word in {w for b in open_ for w in b}:
                gain[word] = gain.get(word, 0) + sum(word in b for b in open_)
        best = min(gain, key=lambda w: (w in _COMMON or w.isdigit(), -gain[w], w))
        chosen.append(best)
        for k, (needed, open_) in list(left.items()):
            rest = {b for b in open_ if best not in b}
            needed -= len(open_) - len(rest)
            if needed > 0:
                left[k] = needed, rest
            else:
                del left[k]
    return sorted(chosen)


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order of appearance."""
    found = re.sub(r"[^\w]+|_", " ", text.lower()).split()
    pairs = [" ".join(p) for p in zip(found, found[1:])] or found
    return list(dict.fromkeys(pairs))


def _constant(value: list, kind: str) -> Column:
    """A list as one constant, which plans faster than a column per entry."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _words(unit: Column) -> Column:
    spaced = F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(spaced, " "), "")


def _bigrams(w: Column) -> Column:
    two = F.transform(positions(F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return F.when(F.size(w) > 1, F.array_distinct(two)).otherwise(w)


def units(text: Column) -> Column:
    """Distinct non-blank lines, paragraphs and the whole text."""
    whole = F.coalesce(text, F.lit(""))
    pieces = F.concat(F.split(whole, "\n"), F.split(whole, r"\n[\x20\x09-\x0D]*\n"), F.array(whole))
    return F.filter(F.array_distinct(pieces), lambda u: u.rlike(NOT_SPACE))


def best_match(text: Column, templates: Sequence[tuple[str, str]], threshold: int) -> Column:
    """Struct (license, template, shared, unit_size, template_size) of the best template, or null."""
    bigrams = [template_bigrams(t) for _, t in templates]
    known = _constant([{"i": i, "size": len(b), "b": b} for i, b in enumerate(bigrams)],
                      "array<struct<i:int,size:int,b:array<string>>>")

    def compare(unit: Column) -> Column:
        size = F.size(unit)
        fitting = F.filter(
            known,
            lambda t: (size * threshold <= t["size"] * (200 - threshold))
            & (t["size"] * threshold <= size * (200 - threshold)),
        )
        scored = F.transform(
            fitting,
            lambda t: F.struct(F.size(F.array_intersect(unit, t["b"])).alias("s"), t["size"].alias("t"), t["i"].alias("i")),
        )
        hits = F.filter(scored, lambda t: 200 * t["s"] >= threshold * (size + t["t"]))
        return F.transform(
            hits,
            lambda t: F.struct(
                (2 * t["s"] / (size + t["t"])).alias("dice"), t["s"].alias("shared"), (-t["i"]).alias("order"),
                size.alias("unit_size"), t["t"].alias("template_size"),
            ),
        )

    largest = max(len(b) for b in bigrams) * (200 - threshold) // threshold
    names = _constant([name for name, _ in templates], "array<string>")
    keys = _constant(key_words(bigrams, threshold), "array<string>")
    possible = F.filter(F.transform(units(text), _words), lambda w: F.arrays_overlap(w, keys))
    found = F.flatten(F.transform(
        F.filter(F.transform(possible, _bigrams), lambda b: (F.size(b) > 0) & (F.size(b) <= largest)), compare
    ))
    return let(
        F.array_max(found),
        lambda m: F.when(
            m.isNotNull(),
            F.struct(
                F.get(names, -m["order"]).alias("license"), (-m["order"]).alias("template"), m["shared"].alias("shared"),
                m["unit_size"].alias("unit_size"), m["template_size"].alias("template_size"), m["dice"].alias("dice"),
            ),
        ),
    )


def scan(
    docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: int = THRESHOLD_PERCENT, out: str = "license_match",
) -> DataFrame:
    """``docs`` with a struct column of the best license match, null where none reaches the threshold."""
    return docs.withColumn(fresh(docs, out), best_match(quoted(text), templates, threshold))


def document_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, license, shared, unit_size, template_size) of every document."""
    found = scan(docs.select("doc_id", "text"))
    m = found[found.columns[-1]]
    return found.select(
        "doc_id", m["license"].alias("license"), m["shared"].alias("shared"),
        m["unit_size"].alias("unit_size"), m["template_size"].alias("template_size"),
    )
