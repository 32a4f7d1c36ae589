import itertools
import random

import pytest

from rill.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, part int, rendered string"


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return (bool(body) or not roles) and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))


def least_cost(roles):
    """By trying every merge, relabelling and number of insertions."""
    names = ["system", "user", "assistant"]
    best = 10**9
    for labels in itertools.product(names, repeat=len(roles)):
        base = sum(C.RELABEL for a, b in zip(roles, labels) if a != b)
        for joins in itertools.product((False, True), repeat=len(roles)):
            if joins[:1] == (True,) or any(j and labels[i] != labels[i - 1] for i, j in enumerate(joins)):
                continue
            kept = [x for x, j in zip(labels, joins) if not j]
            cost = base + C.MERGE * sum(joins)
            for fill in itertools.product(((), ("user",), ("assistant",), ("user", "assistant")), repeat=len(kept) + 1):
                seq = [r for f, k in zip(fill, [*kept, None]) for r in (*f, k) if r]
                if legal(seq):
                    best = min(best, cost + C.INSERT * (len(seq) - len(kept)))
    return best


def parse(rendered):
    if not rendered:
        return []
    assert rendered.endswith("<|end|>\n")
    turns = rendered.removesuffix("<|end|>\n").split("<|end|>\n")
    return [(t[2 : t.index("|>")], t[t.index("|>") + 3 :]) for t in turns]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_cost_is_least(n):
    for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=n):
        row = C.render(1, 0, 1, list(roles), ["x"] * n, C.START, C.WHOLE)
        turns = parse(row[8])
        assert legal([r for r, _ in turns]) and row[3] == len(turns)
        assert row[4] == least_cost(roles), roles
        assert row[4] == C.MERGE * row[5] + C.RELABEL * row[6] + C.INSERT * row[7]


def made():
    rnd = random.Random(2)
    rows = []
    for c in range(30):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", "user", "assistant", "system", None]), f"c{c}t{t} <|end|>"))
    rows += [(100, 0, "user", None), (100, 0, "user", ""), (101, None, "assistant", "last"), (101, 3, " User ", "first")]
    rows += [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (7, 1, "user", "twin"), (7, 1, "user", "twin")]
    rnd.shuffle(rows)
    return [(*r, 1, "clash") for r in rows]


def test_whole_conversations(spark):
    rows = made()
    got = {r.conv_id: r for r in C.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        want = C.render(c, 0, 1, [x[2] for x in own], [x[3] for x in own], C.START, C.WHOLE)
        assert tuple(r) == want
        texts = [t for _, t in parse(r.rendered)]
        assert "".join(texts).count("< |end|>") == sum("<|end|>" in (x[3] or "") for x in own)


def joined(parts):
    """The parts of one conversation as one row: counts and cost added up, renderings joined."""
    parts = sorted(parts, key=lambda r: r.part)
    assert [r.part for r in parts] == list(range(parts[0].n_parts)) and len({r.n_parts for r in parts}) == 1
    sums = [sum(r[n] for r in parts) for n in ("turns", "cost", "merged", "relabelled", "inserted")]
    return (*sums, "".join(r.rendered for r in parts))


def by_conversation(df, **options):
    out = {}
    for r in C.format_chats(df, **options).collect():
        out.setdefault(r.conv_id, []).append(r)
    return out


@pytest.mark.parametrize("part_turns", [1, 2, 7])
def test_parts_join_to_the_whole(spark, part_turns):
    """Cost, counts and text, and so the choices among equals, whatever the parts; ends of parts included."""
    rnd = random.Random(4)
    rows = made() + [(500, t, rnd.choice(["user", "assistant", "tool", "system"]), f"t{t}", 1, "") for t in range(300)]
    rows += [(600 + i, t, r, "x", 1, "") for i, r3 in enumerate(itertools.product(["user", "assistant", "tool"], repeat=3)) for t, r in enumerate(r3)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, parts = by_conversation(df), by_conversation(df, part_turns=part_turns)
    assert whole.keys() == parts.keys() and max(map(len, parts.values())) > 40 and all(len(w) == 1 for w in whole.values())
    for c, own in parts.items():
        assert joined(own) == joined(whole[c]), c


def test_around_the_length_of_a_part(spark):
    rnd = random.Random(8)
    sizes = {c: C.PART_TURNS + c for c in (-1, 0, 1)}
    rows = [(c, t, rnd.choice(["user", "assistant", "tool"]), f"t{t}") for c, n in sizes.items() for t in range(n)]
    got = by_conversation(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {c: own[0].n_parts for c, own in got.items()} == {-1: 1, 0: 1, 1: 2}
    for c in sizes:
        own = [r for r in rows if r[0] == c]
        assert joined(got[c]) == C.render(c, 0, 1, [r[2] for r in own], [r[3] for r in own], C.START, C.WHOLE)[3:]


def test_no_rows(spark):
    assert C.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
