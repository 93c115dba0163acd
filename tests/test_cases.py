"""Commands on cases against a plain run through the log, whatever the blocks; maps of blocks against every start."""

import random

import pytest

from skytally.operators import cases


def plainly(log):
    """Command by command, with dictionaries."""
    version, holder, out = {}, {}, {}
    for command, case, kind, expected, status, _, detection in sorted(log):
        now = version.get(case, 0)
        if case is None:
            outcome = "not_found"
        elif kind in ("create", "update") and status is not None and status not in cases.STATES:
            outcome = "invalid_status"
        elif kind == "create":
            outcome = "exists" if now else "ok"
            version[case] = now or 1
        elif kind not in ("update", "delete", "comment", "attach", "detach"):
            outcome = "unknown"
        elif not now:
            outcome = "not_found"
        elif kind == "delete":
            outcome, version[case] = "ok", 0
            holder = {d: c for d, c in holder.items() if c != case}
        elif kind == "update":
            outcome = "ok" if expected == now else "version_conflict"
            version[case] = now + (outcome == "ok")
        elif kind == "attach":
            got = holder.get(detection)
            outcome = "not_attached" if detection is None else "ok" if got is None else "duplicate" if got == case else "already_attached"
            if outcome == "ok":
                holder[detection] = case
        elif kind == "detach":
            outcome = "ok" if detection is not None and holder.get(detection) == case else "not_attached"
            holder = {d: c for d, c in holder.items() if outcome != "ok" or d != detection}
        else:
            outcome = "ok"
        out[command] = (outcome, version.get(case, 0))
    return out


def log_of(seed, n):
    rng = random.Random(seed)
    kinds = ["create"] * 3 + ["update"] * 6 + ["delete", "comment", "attach", "attach", "attach", "detach", "frobnicate", None]
    case = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    return [(k, case(), rng.choice(kinds), rng.choice([1, 2, 3, 4, 5, None]), rng.choice([None, None, "open", "closed", "triage", "lost"]), rng.choice([None, "", "x", "y"]), rng.choice([None, 1, 2, 3, 4])) for k in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("block", [1, 7, 5000])
def test_outcomes(spark, block):
    log = log_of(block, 400)
    rows = cases.outcomes(spark.createDataFrame(log, cases._COLUMNS).repartition(3), block).collect()
    assert {r.command_id: (r.outcome, r.version) for r in rows} == plainly(log) and len(rows) == 400
    assert len({r.outcome for r in rows}) == 9


def test_no_commands(spark):
    assert cases.outcomes(spark.createDataFrame([], cases._COLUMNS)).count() == 0


def test_maps_of_blocks():
    """From any version a block's map leads where its commands do, and blocks follow each other."""
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(12)
        kinds = [rng.choice(["create", "update", "update", "update", "delete", "comment"]) for _ in range(n)]
        expected = [rng.choice([None, 0, 1, 2, 3, 9]) for _ in range(n)]
        for start in (0, 1, 2, 3, 4, 9, 10, 77):
            end = start
            for _, end in cases.judged(kinds, expected, [None] * n, start):
                pass
            cut = rng.randrange(n + 1)
            assert cases.follow(start, cases.block_map(kinds, expected)) == end
            assert cases.follow(cases.follow(start, cases.block_map(kinds[:cut], expected[:cut])), cases.block_map(kinds[cut:], expected[cut:])) == end
