from __future__ import annotations

import random
import re

from voxweave.llm.licences import CUE, TEMPLATES, align, license_notices, op5_license_scan, scan


def test_every_template_has_a_cue_and_finds_itself():
    for name, text, fixed in TEMPLATES:
        assert re.search(CUE, text)
        found = {x[0] for x in scan(f"some words before it.\n{text}\nand some words after it")}
        assert name in found, (name, found)


def test_alignment():
    assert align(["a", "b", "c"], ["x", "a", "b", "c", "y"]) == (1, 4, [])
    assert align(["a", "b", "c", "d"], ["x", "a", "q", "c", "d"]) == (1, 5, [("b", "q")])
    assert align(["a", "b", "c", "d"], ["a", "b", "d"])[2] == [("c", "")]


def test_wording(spark, none):
    pad = "lorem ipsum dolor " * 400
    rows = [
        (1, pad + "Released under the MIT License." + pad), (2, "released  under\tthe mit license"), (3, "Released under the XYZ License."),
        (4, "This work is licensed under the GNU General Public License, version 2."), (5, "This work was licensed under the GNU General Public License, version 3."),
        (6, "the license of this copyright is a permission"), (7, None), (8, ""), (None, "Licensed under CC BY-NC 4.0."),
        (9, "Released under the MIT License. Licensed under the Apache License, Version 2.0."), (2, "released  under\tthe mit license"), (10, "license " * 3000),
    ]
    got = sorted((str(r.doc_id), r.license, r.n_differ) for r in license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", "MIT", 0), ("2", "MIT", 0), ("2", "MIT", 0), ("4", "GPL-2.0", 0), ("5", "GPL-3.0", 1), ("None", "CC-BY-NC-4.0", 0), ("9", "Apache-2.0", 0), ("9", "MIT", 0)])
    assert license_notices(none).count() == 0


def test_query_against_plain_search(spark, sf):
    lines = {t: n for n, t, _ in TEMPLATES if len(t) < 80}
    want = sorted((r.doc_id, n) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for t, n in lines.items() if t in (r.text or ""))
    got = sorted((r.doc_id, r.license) for r in op5_license_scan(spark, sf).collect())
    assert got == want and got


def test_notices_in_cue_dense_text():
    """However long the block, every verbatim notice in it is found, and once."""
    rng = random.Random(4)
    some = ["".join(rng.choice("abdegilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    for n in (500, 2000, 5000, 50_000):
        for name, text, _ in TEMPLATES if n <= 2000 else TEMPLATES[2:14:5]:
            filler = ["copyright" if k % 80 == 40 else rng.choice(some) for k in range(n)]
            at = rng.randrange(n)
            whole = " ".join([*filler[:at], text.rstrip("."), *filler[at:]])
            start = len(" ".join(filler[:at])) + (at > 0)
            found = [(x[0], x[4]) for x in scan(whole) if start <= x[1] < x[2] <= start + len(text)]
            assert found == [(name, 0)], (n, name, found)


def test_a_closer_wrong_version_hides_nothing():
    """Version 2 verbatim is closer to the version 3 wording than version 3 with two changes."""
    said = "This work is licensed under the GNU General Public License, version 2. All work was licensed under the GNU General Public License, version 3."
    assert [(x[0], x[4]) for x in scan(said)] == [("GPL-2.0", 0), ("GPL-3.0", 2)]
