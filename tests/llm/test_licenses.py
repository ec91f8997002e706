import random

from paperloom.llm import licenses


def slow_best(text, name, template, threshold=licenses.THRESHOLD):
    """Largest Dice coefficient of any stretch as long as the template."""
    from collections import Counter

    pairs, own = licenses.bigrams(licenses.words_of(text)), Counter(licenses.bigrams(licenses.words_of(template)))
    width = min(len(pairs), sum(own.values()))
    return max((licenses.dice(Counter(pairs[i : i + width]), own) for i in range(len(pairs) - width + 1)), default=0.0)


def test_scan_finds_what_all_stretches_show():
    rng, words = random.Random(3), "the of and licensed license under version work is a this".split()
    for _ in range(150):
        name, template = rng.choice(licenses.TEMPLATES)
        notice = template.split()
        for _ in range(rng.randint(0, 3)):
            notice[rng.randrange(len(notice))] = rng.choice(words)
        text = " ".join([*rng.choices(words, k=rng.randint(0, 30)), *notice, *rng.choices(words, k=rng.randint(0, 30))])
        scanner = licenses.Scanner(((name, template),))
        best = slow_best(text, name, template)
        found = scanner.scan(text)
        assert bool(found) == (best >= licenses.THRESHOLD)
        if found:
            assert abs(max(f[3] for f in found) - best) < 1e-12


def test_size_bound_is_the_least_overlap():
    for size in range(1, 60):
        for shared in range(size + 1):
            for other in range(max(1, shared), 4 * size):
                if 2 * shared / (size + other) >= 0.8:
                    assert shared >= licenses.needed(size, 0.8)


def test_hard_rows(hard, clashing, empty, spark):
    for docs in (hard, clashing):
        rows = licenses.scan(docs).collect()
        assert len(rows) == 12 and all(r.license is None and r.dice == 0 and r.matches == [] for r in rows)
    assert licenses.scan(empty).count() == 0
    text = "Hello.\nReleased under the MIT license! More prose here. Licensed under CC BY-NC 4.0. Bye"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.license, row.dice, [m.license for m in row.matches]) == ("MIT", 1.0, ["MIT", "CC-BY-NC-4.0"])


def test_notices_of_the_tables(spark, medium):
    found = {r.doc_id: {m.license for m in r.matches} for r in licenses.op2_license_scans(spark, medium).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "LicenseRef-all-rights-reserved"}
    for r in spark.read.parquet(f"{medium}/documents.parquet").collect():
        assert found[r.doc_id] == {name for line, name in lines.items() if line in r.text}


def notice(name, words):
    return next(text for key, text in licenses.TEMPLATES if key == name and words in text)


def test_related_licences_are_told_apart():
    scanner = licenses.Scanner()
    texts = {
        "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "BSD-2-Clause": notice("BSD-2-Clause", "NO EVENT"),
        "BSD-3-Clause": notice("BSD-3-Clause", "NO EVENT"),
        "ISC": notice("ISC", "NO EVENT"),
        "MIT": notice("MIT", "NO EVENT"),
    }
    for name, text in texts.items():
        assert [m[0] for m in scanner.scan(f"Some file. {text} More words follow here.")] == [name]


def test_many_notices_in_one_text():
    import time

    scanner, text = licenses.Scanner(), "Released under the MIT License. Other words. " * 8000
    began = time.time()
    assert len(scanner.scan(text)) == 8000
    assert time.time() - began < 10
