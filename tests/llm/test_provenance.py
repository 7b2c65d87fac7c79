import random

from conftest import rows
from strataquery.llm import provenance
from test_texts import kinds, source


def test_forks_are_one_family(spark, scratch):
    """Files that only a project and its fork hold are its own; a copy in a third, unrelated repository is one."""
    own = [(i, 1, f"src/f{i}.py", source(500 + i)) for i in range(20)]
    fork = [(100 + i, 2, f"src/f{i}.py", source(500 + i)) for i in range(19)] + [(150, 2, "src/new.py", source(600))]
    other = [(200 + i, 3, f"lib/g{i}.py", source(700 + i)) for i in range(9)] + [(250, 3, "lib/taken.py", source(503))]
    got = kinds(spark, scratch, own + fork + other)
    assert {k for k, v in got.items() if v == "vendored"} == {3, 103, 250}
    few = kinds(spark, scratch, own[:3] + fork[:3])  # too few files to tell relatives
    assert {k for k, v in few.items() if v == "vendored"} == {0, 1, 2, 100, 101, 102}


def test_families(spark, scratch):
    held = [(r, i.to_bytes(4, "big")) for r, keys in ((1, range(40)), (2, range(2, 42)), (3, range(100, 140)), (4, range(3)), (5, range(3))) for i in keys]
    got = dict(rows(provenance.families(spark.createDataFrame([(s, r) for r, s in held], "s binary, repo long"), scratch)))
    assert set(got) == {1, 2} and got[1] == got[2]
    assert rows(provenance.families(spark.createDataFrame([], "s binary, repo long"), scratch)) == []


def test_planted_copies_without_header_or_folder(spark, scratch):
    """Copies with a changed line or an added tail, in plain folders: at least nine in ten are found, and no other file."""
    rng = random.Random(4)
    own = [(i, i % 30, f"src/own{i}.py", source(1000 + i)) for i in range(300)]
    copies = []
    for k in range(100):
        lines = source(1000 + 3 * k).split("\n")
        at = rng.randrange(len(lines))
        lines[at : at + 1] = ["changed_line = 1"] if k % 2 else [lines[at], "added = 2"]
        copies.append((1000 + k, 100 + k % 40, f"util/part{k}.py", "\n".join(lines)))
    got = {k for k, v in kinds(spark, scratch, own + copies).items() if v == "vendored"}
    planted = {c[0] for c in copies}
    assert len(got & planted) >= 0.9 * len(planted)
    assert not {i for i in range(300) if i % 3 or i >= 300} & got
