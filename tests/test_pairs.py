import random
from collections import Counter
from itertools import combinations

import pytest

from talentgrid.operators import ecosystem, pairs as PR


@pytest.fixture
def jobs():
    rng = random.Random(11)
    pool = ["python", "sql", "aws", "tableau", "excel", "spark", "r", "java"]
    made = [(i, "2025_01", "Senior", rng.sample(pool, rng.randint(1, 6))) for i in range(120)]
    made.append((500, "2025_01", "Senior", pool + [f"x{i}" for i in range(13)]))
    return made


def brute_pairs(jobs, most=10**6):
    return Counter(
        p for j in jobs if 2 <= len(j[3]) <= most for p in combinations(sorted(j[3]), 2)
    )


@pytest.mark.parametrize("most", [None, 20])
def test_pair_counts_of_jobs_of_any_length(posted, jobs, most):
    """One job has 21 skills: it counts unless a bound is asked for."""
    found = PR.pair_counts(posted(jobs), most=most).collect()
    got = {(r["skill_1"], r["skill_2"]): r["mentions"] for r in found}
    assert got == dict(brute_pairs(jobs, most or 10**6))
    assert (("x0", "x1") in got) == (most is None)


def test_top_pairs_then_threshold(posted, jobs):
    got = [(r["skill_1"], r["skill_2"], r["mentions"]) for r in PR.skill_pairs(posted(jobs), 1, 5).collect()]
    want = sorted(((a, b, n) for (a, b), n in brute_pairs(jobs).items()),
                  key=lambda t: (-t[2], t[0], t[1]))[:5]
    assert sorted(got) == sorted(want)
    assert PR.skill_pairs(posted(jobs), 10_000, 5).count() == 0


def test_overlap_is_over_all_jobs(posted, jobs):
    p = posted(jobs)
    for r in PR.job_set_overlap(p, PR.skill_pairs(p, 1, 6)).collect():
        a = {j[0] for j in jobs if r["skill_1"] in j[3]}
        b = {j[0] for j in jobs if r["skill_2"] in j[3]}
        assert (r["jobs_with_both"], r["jobs_with_either"]) == (len(a & b), len(a | b))
        assert 0 <= r["co_occurrence_rate"] <= 1


def test_clusters_match_greedy_by_hand(posted, jobs):
    counts = Counter(s for j in jobs for s in j[3])
    names = sorted(counts, key=lambda s: (-counts[s], s))[:6]
    used, want = set(), []
    for name in names:
        if name in used:
            continue
        scored = []
        for other in names:
            if other != name and other not in used:
                both = sum(1 for j in jobs if name in j[3] and other in j[3])
                if both >= 10:
                    scored.append((other, both))
        scored.sort(key=lambda t: (-t[1], t[0]))
        if scored:
            members = [name] + [s for s, _ in scored[:4]]
            used.update(members)
            want.append((members, sum(n for _, n in scored[:4]) / len(scored[:4])))
    got = PR.skill_clusters(posted(jobs), 6, 10).orderBy("cluster").collect()
    assert [(r["skills"], r["avg_co_occurrence"]) for r in got] == want
    assert all(r["size"] == len(r["skills"]) for r in got)


def test_universal_and_specialized(posted):
    one = [(i, "2025_01", "Senior", ["python", "sql"]) for i in range(10)]
    two = [(i, "2025_01", "Senior", ["python", "r"]) for i in range(10, 20)]
    both = posted(one, "A").unionByName(posted(two, "B"))
    got = {(r["kind"], r["skill"]): (r["role_count"], r["primary_role"])
           for r in ecosystem.universal_specialized(both).collect()}
    assert got == {("universal", "python"): (2, None), ("specialized", "sql"): (1, "A"),
                   ("specialized", "r"): (1, "B")}
    assert set(ecosystem.skill_ecosystem(both)) == {
        "top_combinations", "natural_clusters", "role_specializations", "skill_universality"}


def test_pairs_need_no_join(posted, jobs):
    plan = PR.pair_counts(posted(jobs))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "partial_count" in plan


@pytest.mark.parametrize("listed", [PR.LISTED, 3])
@pytest.mark.parametrize("least", [1, 2, 5, 20, 60])
def test_pruned_counts_are_exact(posted, jobs, least, listed, monkeypatch):
    """By a held set of names, and by a join where there are more names than that."""
    monkeypatch.setattr(PR.with_only, "__kwdefaults__", {"listed": listed})
    found = PR.pair_counts(posted(jobs), least=least).collect()
    got = {(r["skill_1"], r["skill_2"]): r["mentions"] for r in found}
    assert got == {p: n for p, n in brute_pairs(jobs).items() if n >= least}


@pytest.mark.parametrize("listed", [PR.LISTED, 0])
def test_rare_skills_write_no_pairs(posted, jobs, listed):
    """A posting of 5,000 skills that no other has: 12.5 million pairs if written out."""
    p = posted(jobs + [(900, "2025_01", "Senior", ["python", "sql"] + [f"rare{i}" for i in range(5000)])])
    frequent = PR.skill_jobs(p).where("mentions >= 2")
    written = PR.pair_rows(PR.with_only(p, frequent, listed=listed)).count()
    known = {s for j in jobs for s in j[3] if not s.startswith("x")}
    want = sum(len(known & set(j[3])) * (len(known & set(j[3])) - 1) // 2 for j in jobs) + 1
    assert written == want < 2000


@pytest.mark.parametrize("both", [None, "mentions"])
def test_overlap_by_counts_in_hand_or_anew(posted, jobs, both):
    p = posted(jobs)
    pairs = PR.skill_pairs(p, 1, 30)
    got = {(r["skill_1"], r["skill_2"]): r for r in PR.job_set_overlap(p, pairs, both).collect()}
    assert len(got) == 30
    for (one, other), r in got.items():
        a, b = ({j[0] for j in jobs if s in j[3]} for s in (one, other))
        assert (r["jobs_with_both"], r["jobs_with_either"]) == (len(a & b), len(a | b))
