"""Targets, nearness to them, and the same choice again."""

from collections import Counter

import pytest

from frameloom.llm import mixing
from frameloom.session import settle


def mixed(docs):
    sizes = settle(mixing.sized(docs).drop("text"))
    return mixing.mix(sizes, mixing.plan(sizes))


def water(sizes, weights, most=3):
    """Targets by sharing what is above again until none is."""
    total, capped = sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        target = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        above = {i for i in open_ if target[i] >= most * sizes[i]}
        if not above:
            return [most * sizes[i] if i in capped else target[i] for i in range(len(sizes))]
        capped |= above


def test_sources_meet_their_targets(documents):
    sources = ["b", "a", None, "é", "tiny", "B"]
    rows = [(i, "w " * (1 + i * 7 % 40), sources[i % 6]) for i in range(3000) if i % 6 != 4 or i < 60]
    out = mixed(documents(*rows)).collect()
    assert len(out) == len(rows)
    order = ["B", "a", "b", "tiny", "é", None]
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    target = dict(zip(order, water([size[s] for s in order], [5, 2, 1, 5, 2, 1]), strict=True))
    taken = Counter()
    for row in out:
        taken[row.source] += row.taken
        assert row.source_size == size[row.source]
        assert row.target == pytest.approx(target[row.source])
        assert row.taken % max(row.size, 1) == 0 and row.taken <= 3 * row.size
    assert target["tiny"] == 3 * size["tiny"]
    for source in order:
        assert target[source] - 40 < taken[source] <= target[source]


def test_order_and_partitions_do_not_matter(documents):
    rows = [(i, "a b c " * (i % 9), f"s{i % 4}") for i in range(400)]
    one = {tuple(row) for row in mixed(documents(*rows)).select("doc_id", "taken").collect()}
    two = {tuple(row) for row in mixed(documents(*rows[::-1]).repartition(7)).select("doc_id", "taken").collect()}
    assert one == two


def test_odd_rows(documents):
    docs = documents((1, None), (2, ""), (None, "a b"), (3, "x " * 100_000), (3, "x " * 100_000), (4, "é b c", None), extra=["size", "taken", "place"])
    rows = mixed(docs).collect()
    assert sorted(row["size"] for row in rows) == [0, 0, 2, 2, 100_000, 100_000]
    assert all(row.taken <= 3 * row["size"] for row in rows)
    assert mixed(docs.limit(0)).count() == 0
    assert {row.target for row in mixed(documents((1, ""), (2, None))).collect()} == {0.0}


def test_rows_are_repeated_as_often_as_taken(documents):
    docs = documents(*[(i, "a b c d", "big" if i < 90 else "small") for i in range(100)], extra=["size"])
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    counts = Counter(row.doc_id for row in rows.collect())
    taken = {row.doc_id: row.taken // 4 for row in mixed(docs).collect()}
    assert counts == {k: v for k, v in taken.items() if v}
    assert max(counts.values()) <= 3 and mixing.mixed_rows(docs.limit(0)).count() == 0


def test_many_sources_without_broadcast(documents, monkeypatch):
    import frameloom.llm.common as common

    rows = [(i, "w " * (1 + i % 5), f"s{i % 30}") for i in range(300)]
    usual = sorted(map(tuple, mixed(documents(*rows)).select("doc_id", "taken").collect()))
    monkeypatch.setattr(common.small, "__defaults__", (3,))
    assert sorted(map(tuple, mixed(documents(*rows)).select("doc_id", "taken").collect())) == usual


@pytest.mark.parametrize("same", [False, True])
def test_rows_of_one_id_do_not_stand_together(documents, same):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(900)]
    rows += [(None, "x y z" if same else f"n{i} " + "w " * (i % 5), f"s{i % 3}") for i in range(450)]  # about a third of the words
    size, taken, goal = Counter(), Counter(), {}
    for row in mixed(documents(*rows).repartition(5)).collect():
        size[row.source] += row["size"]
        taken[row.source] += row.taken
        goal[row.source] = row.target
        assert row.taken % row["size"] == 0 and row.taken <= 3 * row["size"]
    assert all(goal[s] - 7 < taken[s] <= goal[s] for s in goal) and sum(size.values()) == pytest.approx(sum(goal.values()))


def test_equal_rows_are_taken_by_count(documents):
    docs = documents(*[(None, "a b c", "one")] * 50, *[(None, "a b c", "two")] * 90, *[(7, "a b", None)] * 40)
    rows = mixed(docs.repartition(4)).collect()
    taken, goal = Counter(), {}
    for row in rows:
        taken[row.source] += row.taken
        goal[row.source] = row.target
    assert len(rows) == 180 and all(goal[s] - 3 < taken[s] <= goal[s] for s in goal)
    assert len(mixing.mixed_rows(docs).collect()) == sum(taken[s] // (2 if s is None else 3) for s in goal)
