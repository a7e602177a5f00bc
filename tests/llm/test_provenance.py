"""Origins of files: evidence, belief propagation against brute force, and edge cases."""

import itertools
import math

import numpy as np
import pytest

from strataloom.llm import provenance as P

PLAIN = b"import os\n\n\ndef main(path):\n    for x in os.listdir(path):\n        print(x)\n    return None\n"


@pytest.mark.parametrize(
    ("path", "content", "label"),
    [
        ("a.py", PLAIN, "handwritten"),
        ("a.py", b"# Code generated by x. DO NOT EDIT.\n" + PLAIN, "generated"),
        ("a.py", PLAIN + b"\n# Code generated by x. DO NOT EDIT.\n", "generated"),
        ("a.py", b"# This file used to be generated, the generator is gone.\n" + PLAIN, "handwritten"),
        ("a.py", PLAIN + b'HEADER = "# Code generated by %s. DO NOT EDIT."\n', "handwritten"),
        ("a.py", b"# Copyright (c) 2020 Some One\n# Licensed under the terms found in LICENSE.\n" + PLAIN, "handwritten"),
        ("a.py", b"# lib v1.2.3\n# Copyright (c) 2020 X\n# Released under the MIT licence\n" + PLAIN, "vendored"),
        ("x.min.js", b"var a=1;", "minified"),
        ("x.js", b"!function(a,b){a.c=b||{};void 0===this&&a.c()}(x,y);" * 40, "minified"),
        ("t.py", b"DATA = [\n" + b"    0x45, 0x9a, 0x95, 0x1f, 0xbc, 0x30, 0x8d,\n" * 40 + b"]\n", "blob"),
        ("t.go", b"package a\nconst (\n" + b"".join(b"\tA_%d = 0x%04x\n" % (i, i * 7) for i in range(60)) + b")\n", "generated"),
        ("m_pb2.py", b"", "generated"),
        ("a.py", b"", "handwritten"),
        ("a.py", None, "handwritten"),
        (None, None, "handwritten"),
    ],
)
def test_evidence(path, content, label):
    found = P.file_evidence(path, content)
    assert P.LABELS[int(np.argmax(found))] == label


def schema_row(i, path, content=PLAIN, language="python", repo="r"):
    return (i, repo, path, language, bytearray(content) if content is not None else None, "extra")


FILES = "file_id long, cache_key string, rel_path string, language string, content binary, e0 string"


CODE = "def total(values):\n    return sum(v.price for v in values)\n\nclass Basket:\n    pass\n\nprint(total(Basket().rows))\n"
LICENCE = "# Permission is granted to anyone, as the terms below say.\n"


@pytest.mark.parametrize(
    ("content", "label"),
    [
        (LICENCE * 60 + "# Code generated by tool. DO NOT EDIT.\n" + CODE, "generated"),
        ("/* " + "x " * 300 + "Code generated by tool. DO NOT EDIT. */ " + CODE, "generated"),
        ("import os\nfrom a import (\n    b,\n)\n\n# Code generated by tool. DO NOT EDIT.\n" + CODE, "generated"),
        ("import os\n\n# Vendored from github.com/a/b@v1.2\n" + CODE, "vendored"),
        ('"""Basket.\n\nRows and totals.\n"""\n# Code generated by tool. DO NOT EDIT.\n' + CODE, "generated"),
        (CODE + "# Code generated by tool. DO NOT EDIT.\n" + "# more\n" * 20, "generated"),
    ],
)
def test_marks_far_from_the_start(content, label):
    assert P.LABELS[int(np.argmax(P.file_evidence("src/a.py", content.encode())))] == label


def test_beliefs_equal_brute_force(spark):
    paths = ["a/vendor/x.py", "a/y.py", "b/gen/z.py", "b/w.min.js", "c.py"]
    rows = spark.createDataFrame([schema_row(i, p) for i, p in enumerate(paths)], FILES).drop("e0")
    found = {r.path: [r[x] for x in P.LABELS] for r in P.propagate(P.evidence_table(rows)).collect()}
    dirs = ["", "a", "a/vendor", "b", "b/gen"]
    n = len(P.STATES)
    name = lambda d: d.rsplit("/", 1)[-1]
    own = {d: [4.0 * (x == "minified" and name(d) in P.BUILD_DIRS) for x in P.STATES] if d else list(P.ROOT_PRIOR) for d in dirs}
    kind = {d: 1 if name(d) in P.VENDOR_DIRS else 2 if name(d) in P.GENERATED_DIRS else 0 for d in dirs}
    up = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    evidence = {p: P.file_evidence(p, PLAIN) for p in paths}
    total = {p: np.zeros(n) for p in paths}
    message = {p: np.exp(np.array(evidence[p])[None, :] + P.COMPATIBLE) for p in paths}
    for states in itertools.product(range(n), repeat=len(dirs)):
        at = dict(zip(dirs, states))
        w = sum(own[d][at[d]] for d in dirs) + sum(P.COMPATIBLE_DIRS[kind[d]][at[up(d)], at[d]] for d in dirs if d)
        sums = {p: message[p][at[up(p)]] for p in paths}
        every = math.exp(w) * math.prod(v.sum() for v in sums.values())
        for p in paths:
            total[p] += every * sums[p] / sums[p].sum()
    for p in paths:
        joined = np.array([sum(total[p][i] for i, x in enumerate(P.STATES) if x.split("_")[0] == label) for label in P.LABELS])
        assert np.allclose(found[p], joined / joined.sum(), atol=1e-9)


VENDORED = b"// Vendored from github.com/a/b@v1.2\n" + PLAIN


def labels_of(spark, files):
    rows = spark.createDataFrame([schema_row(i, p, content=c) for i, (p, c) in enumerate(files)], FILES).drop("e0")
    return {r.rel_path: r.label for r in P.origin_of_files(rows).collect()}


def test_siblings_alone_turn_a_label(spark):
    other = [(f"src/m{i}.js", PLAIN) for i in range(6)]
    marked = [(f"pkg/b{i}.js", VENDORED) for i in range(6)]
    # A file without any mark is handwritten by itself, and vendored among vendored ones.
    assert labels_of(spark, [("pkg/a.js", PLAIN), *other])["pkg/a.js"] == "handwritten"
    assert labels_of(spark, [("pkg/a.js", PLAIN), *marked, *other])["pkg/a.js"] == "vendored"
    assert labels_of(spark, [("pkg/a.js", PLAIN), *marked, *other])["src/m0.js"] == "handwritten"


def posterior(own, *siblings):
    """Handwritten share of a file with evidence ``own`` in a directory with ``siblings`` below a root."""
    files = np.array([own, *siblings])
    messages = P.to_parent(files)
    below = messages.sum(axis=0)
    root = np.array(P.ROOT_PRIOR) + 6 * P.to_parent(np.array([P.UNMARKED]))[0]
    directory = below + P.to_child(root[None], P.COMPATIBLE_DIRS[0][None])[0]
    z = files[0] + P.to_child((directory - messages[0])[None])[0]
    z = np.exp(z - z.max())
    return z[0] / z.sum()


def test_handwritten_siblings_turn_a_weak_mark():
    weak = (0.0, 4.7, 0.0, 0.0, 0.0, 4.7 - P.MARKED, -P.MARKED)
    assert posterior(weak) < 0.5 < posterior(weak, *[P.UNMARKED] * 8)
    strong = (0.0, 9.0, 0.0, 0.0, 0.0, 9.0 - P.MARKED, -P.MARKED)
    assert posterior(strong, *[P.UNMARKED] * 50) < 0.5


def test_unmarked_files_speak_for_nothing_but_handwritten():
    assert posterior(*[P.UNMARKED] * 5000) > 0.9
    assert np.isfinite(P.COMPATIBLE).all() and np.isfinite(P.COMPATIBLE_DIRS).all() and np.abs(P.COMPATIBLE_DIRS).max() < 25


def test_paths_tell(spark):
    rows = [schema_row(1, "src/vendors/a.py"), schema_row(2, "src/vendor/lib/a.py"), schema_row(3, "x/generators/a.py"), schema_row(4, "x/generated/deep/er/a.py"), schema_row(5, "node_modules/p/README.md", language="markdown"), schema_row(6, None, None), schema_row(2, "src/vendor/lib/a.py")]
    assert {r.file_id for r in P.not_handwritten(spark.createDataFrame(rows, FILES)).collect()} == {2, 4}


def test_nothing_and_nulls(spark):
    assert P.not_handwritten(spark.createDataFrame([], FILES)).count() == 0
    found = P.origin_of_files(spark.createDataFrame([schema_row(1, "a.py", repo=None), (None, None, None, None, None, None)], FILES)).collect()
    assert [(r.file_id, r.label) for r in found] == [(1, "handwritten")]
