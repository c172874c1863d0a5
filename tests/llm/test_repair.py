from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillspan.llm import queries, repair

LEGAL_ROLES = re.compile("(s?(ua)+)?")
NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """The rows of one conversation after damage, in order, by the words of the contract."""
    out = []
    for conv_id, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{space(conv_id)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    digest = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        letters = NOT_BLANK.findall(text)
        out.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def shape(initials):
    """What of the roles so far decides which may follow, or None where no ending makes them legal."""
    if not any(LEGAL_ROLES.fullmatch(initials + more) for more in ("", "a", "ua")):
        return None
    return initials if len(initials) < 2 else "ua" if initials[-1] == "a" else "u"


def cheapest(rows, fault):
    """(cost, audit, repaired): every way to every shape of roles, row by row."""
    reached = {"": (0, "", ())}

    def offer(ways, initials, way):
        now = shape(initials)
        if now is not None and (now not in ways or way[:2] < ways[now][:2]):
            ways[now] = way

    for at in range(len(rows) + 1):
        for _ in range(4):  # more inserts in a row only repeat a shape
            for roles, (cost, audit, told) in list(reached.items()):
                for role in ("user", "assistant"):
                    offer(reached, roles + role[0], (cost + 3, audit + "I", (*told, f"{role}:")))
        if at == len(rows):
            return min(way for roles, way in reached.items() if LEGAL_ROLES.fullmatch(roles))
        _, role, said = rows[at]
        fee, ways = 3 if fault[at] == "truncated" else 0, {}
        for roles, (cost, audit, told) in reached.items():
            offer(ways, roles, (cost + 4, audit + "D", told))
            if fault[at] not in ("blank", "duplicate"):
                offer(ways, roles + role[:1], (cost + fee, audit + "K", (*told, f"{role}:{said}")))
                for new in ("user", "assistant"):
                    offer(ways, roles + new[0], (cost + fee + 3, audit + "R", (*told, f"{new}:{said}")))
        reached = ways


def contract(conv_id, rows):
    rows = damaged(rows)
    fault = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, repaired = cheapest(rows, fault)
    return (
        conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
        hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
    )


def wanted(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return sorted((contract(c, r) for c, r in groups.items()), key=repr)


def run(spark, tmp_path, rows, columns="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(rows, columns).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op11_conversation_repair"](spark, sf_dir).collect()), key=repr) == wanted(rows)


def made_up(seed, convs, turns):
    source = random.Random(seed)
    return [
        (c, source.choice([t, t, t, t + 3, None]), source.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]),
         source.choice([None, "", " \t", "Yes.", "No!", "half", f"Turn {t}.", f"cut {t}", "Ends. \n", "é?"]))
        for c in convs for t in range(source.randint(1, turns))
    ]


def test_odd_conversations_equal_brute_force(spark, tmp_path):
    rows = made_up(3, range(150), 9) + [(None, t, "user", "Hm.") for t in range(3)] + [(900, 1, "user", "same")] * 7
    assert run(spark, tmp_path, rows) == wanted(rows)


@pytest.mark.parametrize("segment", [1, 2, 5])
def test_conversations_over_many_tasks_and_segments(spark, tmp_path, monkeypatch, segment):
    """Long conversations, one of them with most rows, cut into many tasks and into segments of few rows."""
    rows = made_up(segment, [1], 400) + made_up(segment + 50, range(2, 9), 40) + [(1, t, "user", f"More {t}.") for t in range(400, 700)]
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, tmp_path, rows) == wanted(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_segments_chain_like_one_search():
    source = random.Random(8)
    for _ in range(400):
        rows = tuple((source.choice(["s", "u", "a", "t", "u", "a"]), source.random() < 0.3) for _ in range(source.randint(0, 12)))
        whole = repair.search(rows, repair.NOTHING, True)[repair.NOTHING]
        step = source.randint(1, 4)
        tables = [
            {(start, end): way for start in range(4) for end, way in repair.search(rows[k:k + step], start, False).items()}
            for k in range(0, len(rows), step)
        ]
        cost, pieces, more = repair.closed(repair.chain(tables, repair.NOTHING))
        assert (cost, "".join(pieces) + "I" * more) == whole


def test_bounds_are_never_above_the_cost():
    source = random.Random(4)
    for _ in range(300):
        rows = tuple((source.choice(["s", "u", "a", "t", ""]), source.random() < 0.4) for _ in range(source.randint(0, 8)))
        least = min(repair.search(rows, start, True)[repair.NOTHING][0] for start in range(4))
        assert repair.suffix_bounds(rows)[0] <= least


def test_turns_of_the_repair(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "Hello."), (1, 1, "user", "Anyone?"), (1, 2, "assistant", "Yes."), (1, 3, "system", "Late.")],
        "conv_id long, turn long, role string, text string",
    )
    turns = repair.prepared(turns)
    found = repair.repairs(turns)
    assert [(r["cost"], r["audit"]) for r in found.collect()] == [(7, "KIKKD")]
    told = repair.repaired_turns(turns, found).orderBy("place").collect()
    assert [(r["place"], r["role"], r["text"], r["edit"]) for r in told] == [
        (0, "user", "Hello.", "K"), (1, "assistant", "", "I"), (2, "user", "Anyone?", "K"), (3, "assistant", "Yes.", "K"),
    ]


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    frame = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    for name in ("mark", "part", "copies", "first", "audit", "a.b", "_conv"):
        frame = frame.withColumn(name, F.lit("clash"))
    frame.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    found = [tuple(r) for r in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()]
    assert found == wanted([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")])
