import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from sentrylake.llm import conversation_repair, queries

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        c, t, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, flags):
    """Least (cost, audit, repaired) by a search over all states of the pattern, whole audits as keys."""
    best = {"": (0, "", [])}
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    def closed(best):
        for _ in range(3):
            for q, (cost, audit, out) in list(best.items()):
                new = (cost + 5, audit + "I", out + [("user" if step[q] == "u" else "assistant", "")])
                best[step[q]] = min(best.get(step[q], new), new)
        return best

    for (_, _, role, text), flag in zip(rows, flags):
        new = {}
        for q, (cost, audit, out) in closed(best).items():
            more = 5 if flag == "truncated" else 0
            options = [(q, (cost + 2, audit + "D", out))]
            if flag not in ("blank", "duplicate"):
                if role[:1] == step[q] or (q == "" and role[:1] == "s"):
                    options.append((role[:1], (cost + more, audit + "K", out + [(role, text)])))
                options.append((step[q], (cost + 1 + more, audit + "R", out + [("user" if step[q] == "u" else "assistant", text)])))
            for to, x in options:
                new[to] = min(new.get(to, x), x)
        best = new
    return min(x for q, x in closed(best).items() if q in ("", "a"))


def brute(rows, hurt=True):
    ids = {r[0] for r in rows}
    rows = damage(rows) if hurt else [(c, t, *(" " if x is None else x for x in r)) for c, t, *r in rows]
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, flags = set(), []
        for _, _, role, text in own:
            end = text.strip(SPACE)[-1:]
            flags.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        cost, audit, fixed = cheapest(own, flags)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(flags.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = got(queries.op13_conversation_repair(spark, SF))
    assert out == brute(rows)
    assert len({r[7] for r in out}) > 20


def made(n, seed):
    pick = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "umpire"]
    texts = ["Yes.", "No!", "Why", "", " \n", None, "So?\t ", "é…", "Yes."]
    return [(pick.choice([*range(40), None]), pick.choice([None, 0, 1, 2, 3, 5, 9]), pick.choice(roles[: pick.choice((2, 3, 7))]), pick.choice(texts)) for _ in range(n)]


def test_odd_rows_equal_brute_force(spark):
    rows = made(700, 3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(None).cast("string") for c in ("fault", "costs", "step", "edit", "kind", "seen")}).repartition(5)
    assert got(conversation_repair.summaries(df, conversation_repair.repair(df))) == brute(rows, hurt=False)
    hurt = conversation_repair.damaged(df)
    assert got(conversation_repair.summaries(df, conversation_repair.repair(hurt))) == brute(rows)


def test_edits(spark):
    rows = [(1, 0, "system", "A."), (1, 1, "user", "B."), (1, 2, "user", "C."), (1, 5, "assistant", ""), (1, 6, "user", "B.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = conversation_repair.repair(df).orderBy("step").collect()
    assert [(r.edit, r.role, r.text, r.fault) for r in out] == [("K", "system", "A.", None), ("K", "user", "B.", None), ("R", "assistant", "C.", None), ("D", None, "", "blank"), ("D", None, "B.", "duplicate")]
    assert {r.cost for r in out} == {5}


def test_all_rows_dropped_and_none(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    out = got(conversation_repair.summaries(df, conversation_repair.repair(conversation_repair.damaged(df))))
    assert out == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    none = df.limit(0)
    assert got(conversation_repair.summaries(none, conversation_repair.repair(none))) == []


def test_one_long_conversation(spark):
    pick = random.Random(4)
    rows = [(7, i // 2, pick.choice(["user", "assistant"]), f"t{i % 900}" + pick.choice(".!.")) for i in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = got(conversation_repair.summaries(df, conversation_repair.repair(df)))
    assert len(row[7].replace("I", "")) == 20_000 and row[3] == 20_000 - len({r[2:] for r in rows})
