"""License scan against brute force over all templates, and odd rows."""

import random
import re

from flowlens.llm import licenses


def _bigrams(text):
    found = re.sub(r"[\W_]+", " ", text.lower()).split()
    return {" ".join(p) for p in zip(found, found[1:])} or set(found)


def _brute(text):
    best = None
    whole = text or ""
    units = whole.split("\n") + re.split(r"\n[\x20\x09-\x0D]*\n", whole) + [whole]
    for unit in units:
        b = _bigrams(unit)
        for k, (name, template) in enumerate(licenses.TEMPLATES):
            t = _bigrams(template)
            shared = len(b & t)
            if b and 200 * shared >= 80 * (len(b) + len(t)):
                score = (2 * shared / (len(b) + len(t)), shared, -k, len(b), len(t), name)
                best = max(best, score) if best else score
    return (best[5], best[1], best[3], best[4]) if best else (None, None, None, None)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    filler = "the of and this work is licensed under a general public license version terms apache".split()
    texts = [None, "", " \n ", "MIT", "license", "x" * 100_000]
    for _ in range(150):
        words = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(filler)
        notice = " ".join(w.upper() if rng.random() < 0.2 else w for w in words)
        if rng.random() < 0.3:
            notice = notice.replace(" ", "\n", 3)
        prose = " ".join(rng.choices(filler, k=rng.randint(0, 60)))
        texts.append(rng.choice([f"{prose}\n{notice}\n{prose}", notice, f"{prose}\n \n{notice}\n\n{prose}", prose]))
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, license int")
    found = {r[0]: tuple(r)[1:] for r in licenses.document_licenses(docs).collect()}
    assert found == {k: _brute(t) for k, t in enumerate(texts)}
    assert sum(v[0] is not None for v in found.values()) > 50


def test_size_bound_is_exact(spark):
    """A pair on the bound counts, and extra columns stay."""
    docs = spark.createDataFrame([(1, "Alpha beta gamma", 9)], "doc_id long, text string, license_match int")
    out = licenses.scan(docs, templates=[("T", "alpha beta gamma delta")])
    assert out.columns == ["doc_id", "text", "license_match", "license_match_"]
    m = out.first()["license_match_"]
    assert (m.license, m.shared, m.unit_size, m.template_size, m.dice) == ("T", 2, 2, 3, 0.8)


NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Distributed under the MIT license"),
    ("MIT", "This project is licensed under the MIT License."), ("MIT", "// SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache 2.0 license"), ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "Released under the GNU General Public License v3.0."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"), ("BSD-3-Clause", "Released under the 3-clause BSD license"),
    ("BSD-2-Clause", "Distributed under the BSD 2-Clause License"), ("ISC", "Released under the ISC license."),
    ("MPL-2.0", "Distributed under the Mozilla Public License 2.0"), ("CC-BY-SA-4.0", "Released under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."), ("Unlicense", "This software is released under the Unlicense."),
    (None, "The museum was released from its terms under the new management."),
]


def test_usual_wordings_are_found(spark):
    """Notices written down without a look at the templates."""
    rows = [(k, f"Some prose stands before.\n{notice}\nMore prose stands after it.") for k, (_, notice) in enumerate(NOTICES)]
    found = licenses.document_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {NOTICES[r.doc_id][1]: r.license for r in found} == {notice: name for name, notice in NOTICES}


TEXTS = [
    ("MIT", "MIT\n\nCopyright (c) 2021 A. Writer\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
            "of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, "
            "including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
            "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following "
            "conditions:\n\n" + "The rest follows here. " * 200),
    ("ISC", "Copyright 2019 B\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without "
            "fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nEnd"),
    ("BSD-3-Clause", "Conditions\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to "
                     "endorse or promote products derived from\n   this software without specific prior written permission.\n\nEnd"),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n" + "Many words. " * 500),
    ("Apache-2.0", "  Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/\n\n" + "Many words. " * 500),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\n" + "Many words. " * 500),
]


def test_license_texts_are_found(spark):
    rows = [(k, text) for k, (_, text) in enumerate(TEXTS)]
    found = licenses.document_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.license for r in sorted(found)] == [name for name, _ in TEXTS]


def test_key_words_lose_nothing():
    """Every smallest match of a template still holds a key word."""
    for threshold in (50, 80, 100):
        bigrams = [licenses.template_bigrams(t) for _, t in licenses.TEMPLATES] + [["word"], ["the of"]]
        keys = set(licenses.key_words(bigrams, threshold))
        for b in bigrams:
            without = [x for x in b if not keys & set(x.split(" "))]
            assert 200 * len(without) < threshold * (len(without) + len(b))


def test_empty_table(spark):
    assert licenses.document_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
