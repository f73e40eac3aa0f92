"""Conflict resolution against the sequential greedy definition on adversarial inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from legible.operators import folders as FO


def greedy(cands, existing):
    """cands: [(folder, parent, base)] in path order; existing: set of (parent, name)."""
    taken, out = set(), {}
    for folder, parent, base in sorted(cands):
        n, target = 2, base
        while (parent, target) in existing or (parent, target) in taken:
            target = base + str(n)
            n += 1
        taken.add((parent, target))
        out[folder] = target
    return out


BASES = st.sampled_from(["foo", "foo2", "foo22", "foo3", "bar", "bar1", "bar12"])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["p", "q"]), BASES), min_size=1, max_size=9),
       st.lists(st.tuples(st.sampled_from(["p", "q"]), BASES), max_size=4))
def test_resolution_matches_greedy(spark, members, extra_existing):
    cands = [("%s/c%02d" % (parent, i), parent, base) for i, (parent, base) in enumerate(members)]
    existing = {(parent, folder.split("/")[1]) for folder, parent, _ in cands} | set(extra_existing)
    seg = spark.createDataFrame(cands, "folder string, parent string, segment string")
    ex = spark.createDataFrame(sorted(existing), "parent string, name string")
    got = {r.folder: r.target for r in FO.resolve_name_conflicts(seg, ex).collect()}
    assert got == greedy(cands, existing)
