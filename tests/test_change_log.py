import hashlib

import pytest

from tidemark.plans.registry import QUERIES

NAMES = ("revisions_from_log", "current_state_from_log", "first_seen_dedup", "revision_counts")
TURNS = [
    (1, 0, "user", "Same first letter"), (1, 1, "user", "Same first letter, then another end"), (1, 2, "user", "Same first letter, then another end"), (1, 3, "user", "S"),
    (2, 0, "user", "a"), (2, 1, "assistant", "a"), (3, 0, None, None), (3, 1, None, ""), (3, 2, "", "x" * 5_000), (3, 3, "", "x" * 4_999 + "y"), (4, 0, "user", "alone"),
]


def plain(turns):
    """The four results by a walk over each conversation in the order of its turns."""
    logs = {}
    for conv, turn, role, text in sorted(turns, key=lambda t: t[:2]):
        logs.setdefault(conv, []).append((conv, turn, hashlib.sha256(f"{role or ''}\x1f{text or ''}".encode()).hexdigest()))
    changed = {(own[i]) for own in logs.values() for i in range(1, len(own)) if own[i][2] != own[i - 1][2]}
    counts = {(str(c), n) for c in logs if (n := sum(x[0] == c for x in changed))}
    return dict(zip(NAMES, (changed, {own[-1] for own in logs.values()}, {own[0] for own in logs.values()}, counts), strict=True))


@pytest.fixture(scope="module")
def rewrites(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_rewrites_that_keep_the_first_letter_count(spark, rewrites, name):
    got = [tuple(r) for r in QUERIES[name](spark, rewrites).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(TURNS)[name]


@pytest.mark.parametrize("name", NAMES)
def test_given_conversations_equal_a_plain_walk(spark, sf_dir, name):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in QUERIES[name](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(turns)[name]
