"""Licences told apart from their relatives, and the scan against the Dice coefficients of all windows."""

from __future__ import annotations

import re

import numpy as np

from sparkbars.llm import licences as l


def scan(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in l.licence_passages(frame).collect():
        found.setdefault(r.doc_id, []).append((r.licence, r.dice, r.start, r.end))
    return found


def test_every_template_is_found_as_itself(spark):
    names = sorted(l.TEMPLATES)
    texts = [f"Some words of prose come first here\n\n{l.TEMPLATES[n]}\n\nand others follow" for n in names]
    found = scan(spark, texts)
    for k, name in enumerate(names):
        assert {x[0] for x in found[k]} == {name}, name
    assert len(names) >= 30


def test_relatives_versions_and_negations(spark):
    cases = {
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0 (long)"},
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": {"CC-BY-NC-4.0 (long)"},
        "Licensed under CC BY-SA 4.0.": {"CC-BY-SA-4.0 (declared)"},
        "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0 (declared)"},
        "Licensed under the Apache License, Version 1.1.": set(),
        "This is not released under the MIT License.": set(),
        "It was never\nmentioned. Released under the MIT License.": {"MIT (declared)"},
        "Licensed under the Apache License, Version 2.0.": {"Apache-2.0 (declared)"},
        l.TEMPLATES["BSD-3-Clause"].replace("copyright holder nor", "Foundation nor"): {"BSD-3-Clause"},
        l.TEMPLATES["LGPL-2.1-or-later"].replace("library is", "package is"): {"LGPL-2.1-or-later"},
        l.TEMPLATES["GPL-2.0-or-later"].split("You should")[0]: {"GPL-2.0-or-later"},
    }
    found = scan(spark, list(cases))
    for k, (text, want) in enumerate(cases.items()):
        assert {x[0] for x in found.get(k, [])} == want, text[:80]


def test_the_best_window_has_the_dice_of_brute_force(spark):
    """Declarations changed at random inside prose: where any window of words reaches the least Dice, a passage as good is given."""
    rng = np.random.default_rng(3)
    name, template = "GPL-3.0 (declared)", l.TEMPLATES["GPL-3.0 (declared)"]
    split = lambda t: re.findall("[a-z0-9]+", t.lower())
    pairs = lambda w: set(zip(w[:-1], w[1:], strict=True))
    want, texts, best = pairs(split(template)), [], []
    for _ in range(60):
        own = split(template)
        for _ in range(rng.integers(0, 5)):
            at = int(rng.integers(0, len(own)))
            own[at:at + int(rng.integers(0, 2))] = ["stone"] * int(rng.integers(0, 2))
        words = [*rng.choice(["river", "cloud", "the", "work"], 9), *own, *rng.choice(["river", "cloud", "general"], 9)]
        texts.append(" ".join(words))
        top = 0.0
        inside = [pair in want for pair in zip(words[:-1], words[1:], strict=True)]
        for a in np.flatnonzero(inside):
            ends = [(2 * len(pairs(words[a:b + 2]) & want) / (len(pairs(words[a:b + 2])) + len(want)), b) for b in np.flatnonzero(inside) if b >= a]
            dice, b = max(ends)
            if "3" in words[a:b + 2]:
                top = max(top, dice)
        best.append(top)
    found = scan(spark, texts)
    for k, top in enumerate(best):
        got = max([x[1] for x in found.get(k, []) if x[0] == name], default=0.0)
        assert abs(got - top) < 1e-9 if top >= l.LEAST else got == 0.0, texts[k]
    assert sum(b >= l.LEAST for b in best) > 15 < sum(b < l.LEAST for b in best) + 15
