import hashlib
import random
import re
import zlib

from freshet.llm import conversation_repair as cr

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """All edit sequences no dearer than deleting everything; the cheapest, then ASCII-least, that gives the grammar."""
    best = None
    todo = [(0, 0, "", "", ())]
    most = 2 * len(rows)
    while todo:
        i, cost, audit, roles, texts = todo.pop()
        if cost > most or not re.match(r"s?(ua)*u?$|$", roles):
            continue
        if i == len(rows) and GRAMMAR.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, texts)
        for r in ("user", "assistant"):
            todo.append((i, cost + 5, audit + "I", roles + r[0], (*texts, f"{r}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            todo.append((i + 1, cost + 2, audit + "D", roles, texts))
            if fault not in ("b", "d"):
                more = cost + 5 * (fault == "t")
                todo.append((i + 1, more, audit + "K", roles + (role[:1] or "-"), (*texts, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    todo.append((i + 1, more + 1, audit + "R", roles + r[0], (*texts, f"{r}:{text}")))
    return best


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = convs.setdefault(conv, [])
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        held += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        seen, faults = set(), []
        for _, role, text in held:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-")
            seen.add((role, text))
        cost, audit, texts = cheapest([(r, t, f) for (_, r, t), f in zip(held, faults)])
        turns = {t for t, _, _ in held if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *map(faults.count, "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def test_repair_equals_exhaustive_search():
    draw = random.Random(4)
    for _ in range(300):
        rows = [(draw.choice(["system", "user", "assistant", "tool", ""]), "x", draw.choice("---bdt")) for _ in range(draw.randrange(6))]
        codes = "".join((r[:1] if r[:1] in ("s", "u", "a") and r else "-") + f for r, _, f in rows)
        assert cr.repair(codes) == cheapest(rows)[:2], rows


def test_repaired_equals_brute_force_on_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(cr, "CHUNK_BITS", 1)
    draw, rows = random.Random(9), []
    for conv in [*range(60), None]:
        turns = [None, *range(0, 12, 2)] if conv is None or conv % 7 == 0 else range(draw.randrange(1, 6))
        for t in turns:
            rows.append((conv, t, draw.choice(["user", "assistant", "user", "assistant", "system", None, "", "User"]), draw.choice(["Yes.", "Why?\n", "no", "", None, " \t", "É!", "x. y"])))
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    # a clashing column of other content
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.repaired(docs.withColumn("seq", docs["turn"]).withColumn("code", docs["text"])).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], (c, got[c], want[c])
    assert cr.repaired(docs.where("1 = 0")).collect() == []


def test_repeats_of_one_row_are_duplicates(spark):
    rows = [(1, 0, "user", "Hi.")] * 500 + [(1, 1, "assistant", "Yes.")]
    got = cr.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 1 and got[0]["duplicate"] >= 499 and got[0]["audit"].count("D") == got[0]["duplicate"]
