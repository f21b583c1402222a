"""Packing by loss masks: every token once, and all limits on the real masks."""

import random

import numpy as np
import pytest

from reportloom.llm import chat, loss_packing, queries


def check(pieces, examples, capacity, segments, limit):
    """Of pieces (id, start, length, n_loss, sequence, offset) over examples (id, mask), ids being unique."""
    by, own = {}, {}
    for p in pieces:
        by.setdefault(p[4], []).append(p)
        own.setdefault(p[0], []).append(p)
    assert {i for i, m in examples if len(m)} == set(own)
    for i, m in examples:
        at = 0
        for _, start, n, loss, _, _ in sorted(own.get(i, []), key=lambda p: p[1]):
            assert start == at and n > 0 and loss == sum(m[start : start + n])
            at += n
        assert at == len(m)
    for ps in by.values():
        ps.sort(key=lambda p: p[5])
        at = 0
        for p in ps:
            assert p[5] == at
            at += p[2]
        assert at <= capacity and len(ps) <= segments and sum(p[3] for p in ps) <= limit
    return by


def masks(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        m = []
        for turn in range(r.randrange(8)):
            m += [turn % 2 == 1] * r.choice((0, 3, 40, 300, 900))
        out.append((k, m))
    return out


@pytest.mark.parametrize("limits", [(2048, 16, 512), (256, 4, 64), (100, 100, 1), (64, 1, 64)])
def test_limits(spark, limits):
    examples = masks(sum(limits), 60)
    df = spark.createDataFrame(examples, "id long, loss array<boolean>").repartition(3)
    by = check([tuple(r) for r in loss_packing.pack_masked(df, *limits).drop("part").collect()], examples, *limits)
    tokens, loss = sum(len(m) for _, m in examples), sum(map(sum, (m for _, m in examples)))
    assert len(by) <= 3 + 1.5 * max(tokens / limits[0], loss / limits[2], sum(bool(m) for _, m in examples) / limits[1]) + len(examples) / 4


def test_windows_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(loss_packing, "WINDOW", 8)
    p, got = loss_packing.MaskPacker(256, 4, 64), []
    examples = masks(9, 100)
    for i, m in examples:
        p.add(i, np.array(m, bool))
        if len(p.items) >= 8:
            got += p.pack()
    got += p.pack(last=True)
    check([(i, s, n, loss, q, o) for i, s, n, q, o, loss in got], examples, 256, 4, 64)
    odd = spark.createDataFrame([(None, [True, False], 7), (3, None, 8), (4, [], 9)], "id long, loss array<boolean>, start long")
    assert [(r.id, r.start, r.length, r.n_loss) for r in loss_packing.pack_masked(odd).collect()] == [(None, 0, 2, 1)]
    assert loss_packing.pack_masked(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        loss_packing.MaskPacker(max_loss=0)


def test_packed_chats(spark, tmp_path):
    """Conversations whose assistant turns alternate with long others; more loss than one sequence takes."""
    r = random.Random(2)
    rows = [(c, t, ("user", "assistant")[t % 2], " ".join(r.choice(("alpha", "beta", "gamma")) for _ in range(r.choice((5, 200, 700))))) for c in range(12) for t in range(r.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    examples = [(x.conv_id, x.loss) for x in chat.format_chats(df).select("conv_id", "loss").collect()]
    pieces = [tuple(x) for x in queries.queries()["chats_packed_by_loss"](spark, str(tmp_path)).drop("part").collect()]
    check(pieces, examples, 2048, 16, 512)
    assert any(sum(m) > 512 for _, m in examples)
